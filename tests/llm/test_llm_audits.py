"""Filter audit, conversation trie and token counts against brute-force versions, with nulls, empties, long texts, ties and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewater.llm import conversationtrie, filteraudit, tokencounts
from tidewater.llm.queries import TOKEN_LIMIT, tokenizer_path

DOCS = "doc_id long, text string, lang string, mask int, part string, n long, n_bytes long, rid long, k long, word string, _digest string"
TURNS = "conv_id long, turn long, role string, text string, n long, pos long, path long, grp string, digest string, conv long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, 3, 4, 5, "w", "d") for r in rows], DOCS)


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "g", "d", 4) for r in rows], TURNS)


def fails(text):
    words = WORD.findall(text)
    return (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text))


def brute_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = [(lang or "", (*fails(t or ""), i is not None and i > first[t or ""]), i) for i, t, lang in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations(range(5)):
            alive = set(range(len(own)))
            for step, f in enumerate(order, 1):
                hit = {k for k in range(len(own)) if own[k][1][f]}
                gone = hit & alive
                alive -= gone
                ids = [own[k][2] for k in gone]
                out[part, "".join("ABCDE"[x] for x in order), step] = [len(alive), len(gone), len(hit - gone), sum(sum(own[k][1]) == 1 for k in hit), sum(i in good for i in ids), sum(i in toxic for i in ids)]
        for f in "ABCDE":
            keys = [(p, o, s) for p, o, s in out if p == part and o[s - 1] == f]
            total = sum(out[k][1] for k in keys)
            for k in keys:
                out[k].append(total)
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(3)
    texts = ["", "one", "a b " * 150, " ".join(f"w{k}" for k in range(300)), "BIG " * 250, "x|y", "\x0b \x0c", " ".join(f"Ä{k}" for k in range(250)) + " $", "Zoë " + "é" * 20000, "\x1cno\x1dspace"]
    rows = [(k, rng.choice(texts), rng.choice(["en", "de", "", None])) for k in range(120)]
    rows += [(5, texts[2], "en"), (5, texts[2], "en"), (None, texts[2], "en"), (None, None, None), (-3, texts[3], "fr"), (200, None, "fr")]
    labels = [(k, k % 2, k % 3 % 2) for k in range(0, 120, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1), (9999, 1, 1), (200, 1, 1)]
    label_rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = filteraudit.interaction_audit(docs_frame(spark, rows), label_rows).collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want) == 4 * 600
    for r in got:
        assert want[r.part, r.filter_order, r.step] == (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)


def test_filter_audit_orders_and_empty(spark):
    empty = docs_frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.interaction_audit(empty, labels).count() == 0
    cells = spark.createDataFrame([("p", 3, 10, 4, 1), ("p", 0, 5, 5, 0)], "part string, mask int, n long, n_good long, n_toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filteraudit.audit(cells, "AB", ["AB"]).collect()}
    assert got == {("AB", 1): (5, 10, 0, 0, 10), ("AB", 2): (5, 0, 10, 0, 0)}
    with pytest.raises(ValueError):
        filteraudit.audit(cells, "AB", ["AA"])


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            x = f"{len(role or '')}:{role or ''}{text or ''}"
            convs.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.sha256(x.encode()).digest(), len(WORD.findall(text or ""))))
    turns = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    nodes, words = {}, {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            key = tuple(x[0] for x in p[:d])
            nodes.setdefault(key, []).append(c)
            words[key] = p[d - 1][1] if d else 0
    kids, leaves, saved = {}, {}, {}
    for key in nodes:
        if key:
            kids[key[:-1]] = kids.get(key[:-1], 0) + 1
    for key, members in nodes.items():
        for d in range(len(key) + 1):
            up = key[:d]
            leaves[up] = leaves.get(up, 0) + (key not in kids)
            saved[up] = saved.get(up, 0) + (len(members) - 1) * words[key]
    out = []
    for key, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(key))))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), kids.get(key, 0), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=str)


def made_conversations(seed, n=150):
    """Shared openings, copies, a long one, absent conversations, ties, nulls and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 40 == 20 or rng.random() < 0.05:
            continue
        if c % 3 == 0:
            texts = ["system prompt here", "same question", "same answer"]
        elif c % 3 == 1:
            texts = ["system prompt here", "same question"] + [rng.choice(["yes", "no", "it depends"]) for _ in range(rng.randint(0, 5))]
        else:
            texts = [f"own {rng.randint(0, 50)}"] + [f"turn {rng.randint(0, 2)}" for _ in range(rng.randint(0, 3))]
        rows += [(c, k if rng.random() < 0.95 else None, "user" if k % 2 else "assistant", t) for k, t in enumerate(texts)]
    rows += [(7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "user", "another tie"), (8, 2, None, None), (8, 2, "", ""), (None, 0, "user", "of no conversation")]
    rows += [(n + 9, k, "user", f"long {k} " * 3) for k in range(700)]
    rows += [(n + 11, k, "user", f"long {k} " * 3) for k in range(650)]
    return rows


@pytest.mark.parametrize("seed,limit", [(1, None), (2, 20), (3, 3)])
def test_conversation_trie(spark, seed, limit):
    rows = made_conversations(seed)
    got = nodes_of(conversationtrie.conversation_trie(turns_frame(spark, rows), limit))
    assert got == brute_trie(rows)


def test_conversation_trie_of_little(spark):
    assert nodes_of(conversationtrie.conversation_trie(turns_frame(spark, []))) == []
    assert nodes_of(conversationtrie.conversation_trie(turns_frame(spark, [(None, 1, "user", "x")]))) == []
    # 21 takes its first turn from 20, which there isn't: it has none of its own left.
    lonely = next(c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    rows = [(lonely, 0, None, None)]
    got = nodes_of(conversationtrie.conversation_trie(turns_frame(spark, rows)))
    assert got == brute_trie(rows) and len(got) == 1 and got[0][5] == 1


def test_long_id_lists_and_places(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 2).alias("path"), (3 * F.col("id") - 4000).alias("conv"), F.lit(1500).alias("n"))
    for block in (4096, 64):
        monkeypatch.setattr(conversationtrie, "ID_BLOCK", block)
        got = {r.path: r.sha256 for r in conversationtrie.id_list_sha256(rows, "path", "conv").collect()}
        for p in (0, 1):
            ids = ",".join(str(3 * k - 4000) for k in range(p, 3000, 2))
            assert got[p] == hashlib.sha256(ids.encode()).hexdigest()
    keyed = spark.range(2000).select(F.when(F.col("id") < 1900, 1).otherwise(2).alias("key"), "id")
    for most in (100_000, 500):
        placed = conversationtrie.numbered(keyed, "key", [F.col("id").desc()], most)
        assert all(r.pos == (1899 if r.key == 1 else 1999) - r.id for r in placed.collect())


@pytest.fixture(scope="module")
def bytes_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def odd_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéßXYZ019'.,|#字中́") for _ in range(rng.randint(1, 12)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 400))) for _ in range(30)]
    texts += ["", None, " ", "\n\n  \n", "a\x00b c\x00 d", "it's  what we'll   do\t\tnow \n\n ", "a  b  c\x85 d\x1c e", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>z <|endoftext|", "e" * 5000, "ab1" * 3000, " " * 4000]
    texts += ["字" * 4000, "字中文，" * 900, "naïve<|endoftext|>" * 300, "\n".join(word() * 60 for _ in range(40)), "'s " * 900, "😀 " * 900 + "😀" * 900, ("x" * 999 + " ") * 6, "q" * 3000 + " end. " + "w" * 2500]
    return texts


@pytest.mark.parametrize("chunk,overlap", [(tokencounts.CHUNK_BYTES, tokencounts.OVERLAP_BYTES), (512, 16), (300, 4)])
def test_token_counts(spark, bytes_library, chunk, overlap):
    texts = odd_texts()
    rows = [(k if k % 7 else None, t, "en") for k, t in enumerate(texts)] + [(1, texts[1], "en"), (1, texts[1], "en"), (1, "another text " * 400, "en")]
    frame = docs_frame(spark, rows).repartition(3)
    got = tokencounts.token_counts(frame, tokenizer_path("byte_bpe_50k.json"), TOKEN_LIMIT, chunk_bytes=chunk, overlap=overlap).collect()
    n = lambda t: len(bytes_library.encode(t or "", add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), n(t), n(t) > TOKEN_LIMIT) for i, t, _ in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)) for r in got)


def test_token_counts_of_nothing(spark):
    assert tokencounts.token_counts(docs_frame(spark, []), tokenizer_path("byte_bpe_50k.json"), 5).count() == 0


def test_stable_places(bytes_library):
    """Splitting a text at any stable place leaves its tokens as they are."""
    for t in filter(None, odd_texts()):
        whole = bytes_library.encode(t, add_special_tokens=False).ids
        for m in list(tokencounts._STABLE.finditer(t))[::37]:
            a, b = t[: m.end()], t[m.end() :]
            assert bytes_library.encode(a, add_special_tokens=False).ids + bytes_library.encode(b, add_special_tokens=False).ids == whole

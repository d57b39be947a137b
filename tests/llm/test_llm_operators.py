"""Each operator against a brute-force version, with nulls, empties, long texts, ties and clashing columns."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import blocknames, chunks, hyperlang, lshforest, mincut, packing, perplexity, quotes, records, urlrules
from tidewater.llm.queries import END_ID, tokenizer_path
from tidewater.llm.words import coder

CLASH = "doc_id long, text string, lang string, name string, key string, kept boolean, score double, length int, rid int, n int, row string"


def docs_frame(spark, rows):
    """Rows (doc_id, text, lang) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "x", "k", True, 0.5, 3, 1, 2, "r") for r in rows], CLASH)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(5)
    long = words(rng, 9000)
    base = [words(rng, rng.randint(1, 300)) for _ in range(20)]
    rows = [(i, t, "en") for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 3], "de") for i in range(9)]
    rows += [(200, None, None), (201, "", "en"), (202, long, "fr"), (203, long, "fr"), (204, long[:-1] + "!", None), (7, "again the same id", "en"), (7, "again the same id", "en"), (None, "no id", "en")]
    rows += [(300, "Größe ﬁne 中文字 😀 <|endoftext|> it's\x0bİstanbul \u2028 end", "de"), (301, "字" * 3000, "en"), (302, "a" * 5000 + " b", "en")]
    return rows


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_exact_dedup(spark, sample):
    got = blocknames.exact_dedup(docs_frame(spark, sample), block_bytes=64).collect()
    assert len(got) == len(sample)
    groups = {}
    for i, t, _ in sample:
        groups.setdefault(t or "", []).append(i)
    shas = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    seen = {}
    for r in got:
        own = shas[r.text_sha256]
        assert (r.group_size, r.keep_id) == (len(own), max((x for x in own if x is not None), default=None))
        seen.setdefault(r.text_sha256, []).append(r.kept)
    assert all(sum(v) == 1 for v in seen.values())
    kept = blocknames.kept_rows(docs_frame(spark, sample))
    assert kept.columns == docs_frame(spark, []).columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted(groups)
    assert blocknames.exact_dedup(docs_frame(spark, [])).count() == 0


def test_block_names_of_a_hot_group(spark):
    rows = [(i, "same text " * 30, "en") for i in range(400)] + [(1000 + i, f"other {i}", "en") for i in range(200)]
    got = blocknames.exact_dedup(docs_frame(spark, rows), block_bytes=16)
    assert got.filter("kept").count() == 201
    assert got.agg(F.max("group_size"), F.max("keep_id")).first()[0] == 400


def test_words_agree_with_the_library(library):
    rng = random.Random(1)
    alphabet = [chr(i) for i in range(1, 0x250)] + list("\u0300\u0301\u03a3\u0130\u2028\u3000\x85中😀\u1e9e\u212b") + ["<|endoftext|>", "'s", "'LL", "<|"] + [" ", "\n"] * 60
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", None]
    code = coder(tokenizer_path())
    ids, at = code.encode(pa.array(texts))
    for k, t in enumerate(texts):
        own = ids[at[k] : at[k + 1]]
        assert own.tolist() == ids_of(library, t).tolist()
        assert code.decode(own) == library.decode(own.tolist(), skip_special_tokens=False)


def test_chunks_repair_joins(library, monkeypatch):
    monkeypatch.setattr(chunks, "REACH_BYTES", 40)
    monkeypatch.setattr(chunks, "MEAN_BYTES", 64)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh中é1!'" if rng.random() < 0.7 else "ñ中文😀 ,.'\n") for _ in range(rng.choice([0, 3, 50, 400, 2500]))) for _ in range(120)]
    code = chunks.ChunkCoder(coder(tokenizer_path()))
    got = code.encode(pa.array(texts + texts))
    assert [g.tolist() for g in got] == [ids_of(library, t).tolist() for t in texts] * 2
    assert code.encoded < code.met


def test_encode_decode(spark, sample, library):
    frame = docs_frame(spark, sample)
    got = chunks.encode_decode_digests(frame, tokenizer_path()).collect()
    want = []
    for i, t, _ in sample:
        own = ids_of(library, t)
        text = library.decode(own.tolist(), skip_special_tokens=False)
        want.append((i, len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert chunks.encode_decode(docs_frame(spark, []), tokenizer_path()).count() == 0


def brute_links(rows):
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [{j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
    least = [min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]) for i in range(len(rows))]
    return sorted((rows[i][0], least[i], len(links[i])) for i in range(len(rows)))


@pytest.mark.parametrize("block", [300_000, 500])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(lshforest, "BLOCK_SHINGLES", block)
    rng = random.Random(11)
    rows = []
    for g in range(6):
        w = words(rng, 120).split()
        for k in range(rng.randint(1, 8)):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = words(rng, 1)
            rows.append((len(rows), " ".join(v), "en"))
    rows += [(500, rows[0][1], "en"), (501, None, "en"), (502, "", "en"), (503, "two words", "en"), (504, "two words", None), (505, words(rng, 3000), "en")]
    got = lshforest.jaccard_join(docs_frame(spark, rows))
    assert sorted(map(tuple, got.select("doc_id", "class_id", "n_links").collect())) == brute_links(rows)
    kept = lshforest.one_per_class(docs_frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute_links(rows)})
    assert lshforest.jaccard_join(docs_frame(spark, [])).count() == 0


@pytest.mark.parametrize("leaders, hold, parts", [(1024, 500_000, 4), (1024, 10, 37), (3, 500_000, 4), (1, 10, 61)])
def test_crowded_and_spread_buckets(spark, monkeypatch, leaders, hold, parts):
    """A passage in all texts, a group of many near copies and few leaders a bucket, over few and many tasks."""
    monkeypatch.setattr(lshforest, "LEADERS", leaders)
    monkeypatch.setattr(lshforest, "HOLD", hold)
    rng = random.Random(41)
    passage, rows = words(rng, 60), []
    for g in range(25):
        own = words(rng, 40).split()
        for k in range(rng.randint(1, 3)):
            v = list(own)
            v[rng.randrange(len(v))] = words(rng, 1)
            rows.append((len(rows), f"{passage} {' '.join(v)}", "en"))
    base = words(rng, 150).split()
    for k in range(40):
        v = list(base)
        for _ in range(rng.randint(1, 2)):
            v[rng.randrange(len(v))] = words(rng, 1)
        rows.append((len(rows), " ".join(v), "en"))
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", parts < 50)
    try:
        got = lshforest.jaccard_join(docs_frame(spark, rows)).select("doc_id", "class_id", "n_links").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
    assert sorted(map(tuple, got)) == brute_links(rows)


def test_rows_without_ids_are_linked(spark):
    rng = random.Random(42)
    t, u = words(rng, 120), words(rng, 120)
    rows = [(None, t, "en"), (1, t + " tail", "en"), (None, u, "en"), (None, u + " tail", "en"), (4, u, "en"), (4, t, "en")]
    got = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in lshforest.jaccard_join(docs_frame(spark, rows)).collect())
    assert got == [(0, 1, 2), (0, 4, 2), (0, 4, 2), (1, 1, 2), (4, 1, 2), (4, 4, 2)]


def test_cover_joins_what_chains_of_leaders_join():
    rng = np.random.default_rng(43)
    sketches = rng.integers(0, 1 << 63, (60, 2), dtype=np.uint64)
    sketches[20:40] = sketches[0] ^ (np.uint64(1) << rng.integers(0, 63, (20, 2), dtype=np.uint64))
    edges, leaders, done = lshforest.cover(sketches, 0.4, 0.8, None, True)
    assert done and leaders == [k for k in range(60) if not 20 <= k < 40]
    assert {k for e in edges for k in e} >= {0, *range(20, 40)}
    assert lshforest.cover(sketches, 0.4, 0.8, 5, False)[2] is False


def test_one_row_a_class_where_ids_repeat(spark):
    rng = random.Random(17)
    a, b, c, d = (words(rng, 120) for _ in range(4))
    near = lambda t, k: f"{t} {'x' * (k + 1)}"
    rows = [(1, a, "en"), (5, near(a, 0), "en"), (5, b, "en")]  # 5 is a copy on one row, a text of its own on the other
    rows += [(6, c, "en"), (6, near(c, 0), "en"), (8, near(c, 1), "en")]  # the smallest id on two rows
    rows += [(None, d, "en"), (None, near(d, 0), "en"), (None, None, "en"), (9, "", "en")]
    kept = lshforest.one_per_class(docs_frame(spark, rows))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs_frame(spark, []).columns and len(got) == 6
    assert {(1, a), (5, b), (None, None), (9, "")} <= set(got)
    assert sum(i == 6 for i, _ in got) == 1 and sum(i is None and t is not None for i, t in got) == 1
    assert lshforest.one_per_class(docs_frame(spark, [])).count() == 0


def test_forest_prefix_is_shortened_to_the_target():
    depth = lshforest.depth_for(0.8, 40, 0.99999, 10)
    reach = lambda d: 1 - (1 - 0.8**d) ** 40
    assert reach(depth) >= 0.99999 > reach(depth + 1)


def test_packing(spark, sample, library):
    got = packing.pack_documents(docs_frame(spark, sample), tokenizer_path(), END_ID).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    for i, t, _ in sample:
        if i in (7, None):
            continue
        ids, at = np.append(ids_of(library, t), END_ID).astype("<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert packing.pack_documents(docs_frame(spark, []), tokenizer_path(), END_ID).count() == 0


def test_packing_plan_holds_the_histogram():
    rng = random.Random(2)
    histogram = {}
    for combo in rng.sample(packing.combinations(64), 60):  # so that windows can be filled without a gap
        n = rng.randint(1, 200)
        for k in combo:
            histogram[k] = histogram.get(k, 0) + n
    patterns = packing.plan(histogram, 64)
    held = {}
    for pattern, repeats in patterns:
        assert sum(k * n for k, n in pattern.items()) <= 64 and repeats > 0
        for k, n in pattern.items():
            held[k] = held.get(k, 0) + n * repeats
    assert held == {k: n for k, n in histogram.items() if n}
    full = sum(k * n for k, n in histogram.items()) / 64
    assert sum(r for _, r in patterns) <= 1.02 * full + 2


def test_nnls_against_the_conditions():
    rng = np.random.default_rng(4)
    a, b = rng.random((12, 30)), rng.random(12) * 5
    x = packing.solve_nnls(a, b)
    gradient = a.T @ (b - a @ x)
    assert (x >= 0).all() and (gradient <= 1e-6).all() and np.abs(gradient[x > 0]).max() < 1e-6


def test_records_round_trip(spark, sample, library, tmp_path):
    path = f"file://{tmp_path}/records"
    records.write_token_records(docs_frame(spark, sample), path, tokenizer_path(), END_ID)
    got = sorted(records.read_token_records(spark, path).collect(), key=lambda r: r.start)
    ordered = sorted(sample, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in ordered]
    at = 0
    for r, (_, t, _) in zip(got, ordered):
        own = np.append(ids_of(library, t), END_ID).astype("<u4")
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(own), own.tobytes())
        at += len(own)
    shard = records.read_manifest(path)["shards"][0]["name"]
    doc_id, offset, size = records.read_index(path, shard)[0].tolist()
    assert records.read_record(path, shard, offset, size)[0] in (doc_id, None)
    empty = f"file://{tmp_path}/none"
    records.write_token_records(docs_frame(spark, []), empty, tokenizer_path(), END_ID)
    assert records.read_token_records(spark, empty).count() == 0


def test_damaged_records_raise():
    good = records.frame(records.pack(5, np.arange(9), False))
    payload, end = records.unframe(memoryview(good), 0)
    assert end == len(good) and records.unpack(payload)[1].tolist() == list(range(9))
    for at in (0, 9, 20, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(memoryview(bytes(bad)), 0)
    assert records.masked(b"") == (zlib.crc32(b"") + records.MASK_DELTA) & 0xFFFFFFFF
    assert struct.unpack("<Q", good[:8])[0] == len(payload)


def test_language_id(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 60, "abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz") for i in range(80)]
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None), (903, "abc abd", None), (904, "vwxy " * 20000, None), (None, "xyz wxy", "zz"), (7, "abcd", "aa")]
    got = {r.doc_id: r for r in hyperlang.identify(docs_frame(spark, rows)).collect()}
    for i in range(80):
        if i != 7:
            assert got[i].lang_pred == ("aa" if i % 2 else "zz") and 0 <= got[i].score <= 1
            assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "aa", "zz"]
    kept = hyperlang.language_filter(docs_frame(spark, rows))
    assert kept.columns == docs_frame(spark, []).columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect())
    assert hyperlang.identify(docs_frame(spark, [])).count() == 0


def test_unlearned_languages_go(spark):
    rng = random.Random(16)
    rows = [(i, words(rng, 80, "abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz") for i in range(200)]
    rows += [(500 + i, words(rng, 80, "klmnop"), None) for i in range(30)] + [(600 + i, words(rng, 80, "бвгджз"), None) for i in range(30)]
    rows += [(700, words(rng, 3, "abcde"), None)]
    kept = {r.doc_id for r in hyperlang.language_filter(docs_frame(spark, rows)).collect()}
    assert kept == {*range(200), 700}


def test_bound_vectors_are_what_they_say():
    own = hyperlang.Profiler()
    want = np.zeros(hyperlang.DIMENSIONS)
    for gram in ("ab ", "b c", " cd"):
        v = np.ones(hyperlang.DIMENSIONS)
        for k, c in enumerate(gram):
            v = v * np.roll(hyperlang.letter_vector(ord(c)), 2 - k)
        want += v
    got, sizes = own.bundles(["Ab, cd", "7!", "Ab, cd Ab, cd"])
    assert np.array_equal(got[0], want) and sizes.tolist()[:2] == [3, 0] and not got[1].any()


def test_bundles_in_any_way_agree(monkeypatch):
    rng = random.Random(31)
    texts = [words(rng, rng.randint(0, 200), "abcdefgäöü字") for _ in range(30)] + ["", "a", "ab"]
    want, sizes = hyperlang.Profiler().bundles(texts)
    for name, value in (("DENSE", 0), ("MEMO_GRAMS", 300), ("BLOCK_GRAMS", 100), ("CHUNK_GRAMS", 7)):
        monkeypatch.setattr(hyperlang, name, value)
        got, n = hyperlang.Profiler().bundles(texts)
        assert np.array_equal(got, want) and np.array_equal(n, sizes)


def test_predictions_agree_with_brute_force(spark):
    """Prototypes, cosines and scores by dictionaries of letters, bound and bundled one n-gram at a time."""
    rng = random.Random(32)
    rows = [(i, words(rng, 40, letters), lang) for lang, letters in (("en", "abcdefgh"), ("de", "fghijklm"), ("fr", "hkmnopaq")) for i in rng.sample(range(5000), 30)]

    def vector(text):
        text = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split(" "))
        total = np.zeros(hyperlang.DIMENSIONS)
        for i in range(len(text) - 2):
            v = np.ones(hyperlang.DIMENSIONS)
            for k, c in enumerate(text[i : i + 3]):
                v = v * np.roll(hyperlang.letter_vector(ord(c)), 2 - k)
            total += v
        return total / np.linalg.norm(total)

    unit = lambda v: v / np.linalg.norm(v)
    sums = {}
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + vector(t)
    middle = np.mean([unit(v) for v in sums.values()], axis=0)
    want = []
    for i, t, _ in rows:
        cosine = {k: float(unit(unit(v) - middle) @ unit(vector(t) - middle)) for k, v in sums.items()}
        best = max(sorted(cosine), key=cosine.get)
        want.append((i, zlib.crc32(str(i).encode()) % 4 == 2, best, (1 + cosine[best]) / 2))
    got = sorted(tuple(r) for r in hyperlang.identify(docs_frame(spark, rows)).collect())
    want.sort()
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-5)


def brute_counts(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += line in seen and bool(line.strip(" \t\n\x0b\x0c\r"))
        seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover)


def test_base_counts():
    rng = random.Random(8)
    texts = ["", None, "a", " x  y\n\nx y\n", "é\u00a0b c\x1cd"] + ["\n".join(" ".join(rng.choice("ab|#é") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 6))) for _ in range(200)]
    got = perplexity.base_counts(pa.array(texts))
    for k, t in enumerate(texts):
        assert tuple(int(got[c][k]) for c in perplexity.COUNTS) == brute_counts(t or ""), t


def brute_kneser_ney(texts):
    """Interpolated modified Kneser-Ney over symbols, by dictionaries."""
    from collections import Counter, defaultdict

    n = perplexity.ORDER
    counts = {n: Counter()}
    for t in texts:
        s = (0,) * (n - 1) + tuple(perplexity.symbols(t).tolist())
        counts[n].update(s[i : i + n] for i in range(len(s) - n + 1))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, total, spare = {}, {}, {}
    for k in range(1, n + 1):
        have = Counter(counts[k].values())
        y = have[1] / (have[1] + 2 * have[2]) if have[1] + have[2] else 0.5
        cut[k] = [min(max(i - (i + 1) * y * have[i + 1] / have[i], 0), i) if have[i] else 0.5 for i in (1, 2, 3)]
        total[k], spare[k] = Counter(), defaultdict(float)
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            spare[k][g[:-1]] += cut[k][min(c, 3) - 1]

    def p(g):
        k, lower = len(g), 1 / 1024 if len(g) == 1 else None
        context = g[:-1]
        if not total[k][context]:
            return p(g[1:])
        lower = lower if k == 1 else p(g[1:])
        c = counts[k][g]
        own = (c - cut[k][min(c, 3) - 1]) / total[k][context] if c else 0.0
        return own + spare[k][context] / total[k][context] * lower

    def score(t):
        s = (0,) * (n - 1) + tuple(perplexity.symbols(t).tolist())
        return -sum(np.log(p(s[i : i + n])) for i in range(len(s) - n + 1)) / len(t)

    return score


def test_kneser_ney_agrees_with_dictionaries(spark):
    rng = random.Random(9)
    texts = [words(rng, 60, "abcd") for _ in range(30)]
    model = perplexity.fit(docs_frame(spark, [(i, t, "en") for i, t in enumerate(texts)]))
    score = brute_kneser_ney(texts)
    got = model.text_scores([*texts[:5], "zzz qq abab", ""])
    want = [score(t) for t in [*texts[:5], "zzz qq abab"]]
    assert np.allclose(got[:-1], want, rtol=0.02) and np.isnan(got[-1])


def test_kneser_ney_keeps_grams_apart(spark):
    rng = random.Random(18)
    letters = [chr(p) for p in range(0x100, 0x250) if chr(p).lower() == chr(p) and chr(p).isalpha()]
    text = lambda: "".join(rng.choice(letters) for _ in range(6000))
    texts = [text() for _ in range(50)]
    model = perplexity.fit(docs_frame(spark, [(i, t, "en") for i, t in enumerate(texts)]))
    probes = [*texts[:2], text()]
    score = brute_kneser_ney(texts)
    assert np.allclose(model.text_scores(probes), [score(t) for t in probes], rtol=1e-5)


def test_bands_and_verdicts_against_brute_force(spark):
    """Two languages apart: medians, deviations and verdicts by numpy from the exact model's scores."""
    rng = random.Random(33)
    rows = [(i, words(rng, rng.randint(60, 200), "abcdefg"), "en") for i in range(0, 80, 2)] + [(i, words(rng, rng.randint(60, 200), "xyzuvwr"), "de") for i in range(1, 80, 2)]
    rows += [(100, words(rng, 120, "#%&0123"), "en"), (101, words(rng, 120, "mnopqst"), None), (102, "ab " * 300, "de")]
    got = {r.doc_id: r for r in perplexity.quality(docs_frame(spark, rows)).collect()}
    model = perplexity.fit(docs_frame(spark, rows))
    score = dict(zip([i for i, _, _ in rows], model.text_scores([t for _, t, _ in rows])))
    n = {i: len(t.split()) for i, t, _ in rows}
    for i, _, lang in rows:
        assert abs(got[i].log_perplexity - score[i]) < 1e-5
        own = [j for j, _, other in rows if other == lang and not got[j].base_failed]
        if not own:
            assert not got[i].kept
            continue
        value = np.array([score[j] for j in own])
        middle = np.sort(value)[(len(value) - 1) // 2]
        apart = (value - middle) * np.sqrt([n[j] for j in own])
        side = lambda x: 1.4826 * np.sort(x)[(len(x) - 1) // 2] if len(x) else 0.0
        low = middle - max(perplexity.LEAST_HALF_BAND, perplexity.LOWER * side(-apart[apart < 0]) / np.sqrt(n[i]))
        high = middle + max(perplexity.LEAST_HALF_BAND, perplexity.WIDTH * side(apart[apart > 0]) / np.sqrt(n[i]))
        assert abs(got[i].low - low) < 1e-4 and abs(got[i].high - high) < 1e-4
        assert got[i].kept == (not got[i].base_failed and low <= score[i] <= high)
    assert not got[100].kept and not got[102].kept


def test_quality_by_join_agrees(spark, monkeypatch):
    rng = random.Random(19)
    rows = [(i, words(rng, 80), "en") for i in range(40)] + [(7, words(rng, 90), None), (90, None, "en"), (None, "short", "en")]
    order = lambda got: sorted((tuple(r)[:7], r.kept, round(r.log_perplexity or 0, 9)) for r in got.fillna(-1, ["doc_id"]).collect())
    frame = docs_frame(spark, rows)
    want, kept = order(perplexity.quality(frame)), sorted(r.doc_id for r in perplexity.quality_filter(frame).collect())
    monkeypatch.setattr(perplexity, "BROADCAST_GRAMS", 0)
    assert order(perplexity.quality(frame)) == want and len(want) == len(rows)
    assert sorted(r.doc_id for r in perplexity.quality_filter(frame).collect()) == kept


def test_quality(spark):
    rng = random.Random(10)
    rows = [(i, words(rng, 150, "abcdefg"), "en") for i in range(60)]
    odd = " ".join("".join(rng.choice("#%&vwxyz0") for _ in range(7)) for _ in range(150))
    rows += [(900, None, "en"), (901, "", None), (902, "one two three " * 60, "en"), (903, odd, "en"), (903, odd, "en")]
    got = {r.doc_id: r for r in perplexity.quality(docs_frame(spark, rows)).collect()}
    assert all(got[i].kept and not got[i].base_failed for i in range(60))
    assert [got[i].base_failed for i in (900, 901, 902, 903)] == [True, True, True, False]
    assert not any(got[i].kept for i in (900, 901, 902, 903))
    kept = perplexity.quality_filter(docs_frame(spark, rows))
    assert kept.columns == docs_frame(spark, []).columns and sorted(r.doc_id for r in kept.collect()) == list(range(60))
    assert perplexity.quality(docs_frame(spark, [])).count() == 0


def test_url_parts_and_rules(spark):
    urls = [
        ("HTTP://WWW.Example.ORG/es/a?x=1#f", "www.example.org", "/es/a", "example.org/es/", "block"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("x://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
        ("x://a.com/de/#/", "a.com", "/de/", "com/de/", "block"),
        ("x://a.com?u=http://b.org/", "a.com", "", None, "allow"),
        ("x://org/", "org", "/", "org/", "allow"),
        ("no scheme/de/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "h", "v") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: tuple(r)[1:5] for r in urlrules.judge(pages, labels).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert urlrules.judge(pages.limit(0), labels).count() == 0


def test_mined_rules(spark):
    rng = random.Random(12)
    pages, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        host = "spam.example.net" if bad else rng.choice(["a.example.net", "b.example.net"])
        pages.append((i, f"http://{host}/{rng.choice(['x', 'y'])}/{i}?k=1"))
        labels.append((i, None if i == 1 else int(not bad), 0))
    frame = spark.createDataFrame(pages, "page_id long, url string")
    got = urlrules.judge(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all((r.verdict == "block") == (r.page_id % 4 == 0) for r in got)
    assert all("d:spam" in r.mined_rule for r in got if r.verdict == "block")


def test_constant_parameters_are_one_item(spark):
    """Thirty parameters that always stand together are 2**30 token sets, but one item."""
    tail = "&".join(f"p{k}=1" for k in range(30))
    pages = [(i, f"http://www.shop.example.net/{'cheap' if i % 3 == 0 else 'fine'}/{i}?{tail}") for i in range(90)] + [(100, "http://x.test/cheap/?p7=2"), (101, "http://other.test/")]
    labels = [(i, int(i % 3 != 0), 0) for i in range(60)]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlrules.judge(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i] == ("block" if i % 3 == 0 else "allow") for i in range(90)) and got[100] == "block" and got[101] == "allow"
    baskets = spark.createDataFrame([(["a", "b", "c"], True), (["a", "b"], True), (["c", "d", "e"], False)], "tokens array<string>, bad boolean")
    assert {r.token: r["item"] for r in urlrules.token_classes(baskets).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d"}


def test_mined_rules_of_four_tokens(spark):
    four = ["d:ads", "d:example", "p:de", "q:ref"]
    # All four tokens only on bad urls; each three of them, and fewer, mostly on good ones.
    baskets = [(four, True)] * 20 + [([t for t in four if t != left], False) for left in four for _ in range(30)]
    rules = urlrules.mine(spark.createDataFrame(baskets, "tokens array<string>, bad boolean"))
    assert [(sorted(r.tokens), r.n, r.confidence) for r in rules.filter("verdict = 'block'").collect()] == [(four, 20, 1.0)]
    urls = spark.createDataFrame([("u", four), ("v", four[:3])], "row string, tokens array<string>")
    got = {r.row: r.verdict for r in urlrules.match(urls, rules).collect()}
    assert got["u"] == "block" and got.get("v", "allow") == "allow"


PAGES = {
    "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>Head &amp; shoulders</h1><p>First  <b>bold</b>\ntext, long enough to be read as content.<p>Second.</article><footer>&copy; me</footer>": "Head & shoulders\n\nFirst bold text, long enough to be read as content.\n\nSecond.",
    "<div id=main><p>A real paragraph with a fair number of words in it, and an end.</p><div class='comments'><p>Nice post, I liked it a lot!</p></div><aside>Side</aside></div><form><p>Mail</p><input></form>": "A real paragraph with a fair number of words in it, and an end.",
    "<article><p>One.</p><div class=\"ad-banner\">Buy</div><script>var t='</p>';</script><!-- <p>no</p> --><p>Two.</p></article>": "One.\n\nTwo.",
    "": "",
    "<nav>only a menu</nav>": "",
}


def test_mined_rules_against_all_token_sets(spark):
    """An independent miner: every set of tokens of every url counted, pruned by any subset."""
    from itertools import combinations

    rng = random.Random(51)
    rows = []
    for _ in range(400):
        tokens = sorted({rng.choice("abcdef") for _ in range(rng.randint(0, 5))})
        odds = 0.9 if {"a", "b", "c"} <= set(tokens) else 0.8 if "d" in tokens else 0.3
        rows.append((tokens, rng.random() < odds))
    got = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.6, 5)
    full = [(frozenset(t), b) for t, b in rows if t]
    least, share = max(0.02, 5 / len(full)) * len(full), sum(b for _, b in full) / len(full)
    counts = {}
    for tokens, bad in full:
        for k in range(1, len(tokens) + 1):
            for some in combinations(sorted(tokens), k):
                counts.setdefault(some, [0, 0])[bad] += 1
    seen = {(some, v): n[v] / sum(n) for some, n in counts.items() for v in (0, 1) if n[v] >= least}
    want = set()
    for (some, v), c in seen.items():
        below = [seen.get((sub, v), 0.0) for k in range(1, len(some)) for sub in combinations(some, k)]
        if c >= 0.6 and c > (share if v else 1 - share) and all(b < c for b in below):
            want.add((some, "block" if v else "allow", counts[some][v], round(c, 9)))
    assert len(want) > 5
    assert {(tuple(r.tokens), r.verdict, r.n, round(r.confidence, 9)) for r in got.collect()} == want


def test_main_text(spark):
    rows = [(i, "u", h) for i, h in enumerate(PAGES)] + [(90, None, None), (91, "u", "<article>" + "<p>Long text here.</p>" * 3000), (0, "twice", next(iter(PAGES)))]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r for r in mincut.extract(frame).collect()}
    for i, want in enumerate(PAGES.values()):
        assert got[i, "u"].text == want and got[i, "u"].n_chars == len(want)
    assert got[0, "twice"].text == got[0, "u"].text and got[90, None].text == ""
    assert got[91, "u"].text.count("\n\n") == 2999
    assert mincut.extract(frame.limit(0)).count() == 0


STORY = "<p>A real paragraph with a fair number of words in it, and an end.</p><p>One more of them, which also says something and ends.</p>"
STORY_TEXT = "A real paragraph with a fair number of words in it, and an end.\n\nOne more of them, which also says something and ends."
NAMED = {
    f"<nav><a href=x>Home</a></nav><article class='post tag-newsletter'>{STORY}</article>": STORY_TEXT,
    f"<div class='content has-sidebar'><article>{STORY}</article><aside>Side</aside></div>": STORY_TEXT,
    f"<div class='has-sidebar'><main>{STORY}</main></div><footer>me</footer>": STORY_TEXT,
    f"<nav><a href=x>Home</a></nav><div class='post comments-open'>{STORY}</div>": STORY_TEXT,
    f"<article><div class='article-header'><h1>Title</h1></div>{STORY}</article>": "Title\n\n" + STORY_TEXT,
    f"<article><div><svg><title>t</title></div>{STORY}</article>": STORY_TEXT,
    f"<article>{STORY}<noscript><p>Turn it on.</p></noscript><p>Let <math><mi>x</mi></math> be <svg><title>t</title></svg>one.</p></article>": STORY_TEXT + "\n\nLet x be one.",
    f"<article>{STORY}</article><div id=comments><article class=comment><p>Nice post, I liked it a lot!</p></article></div>": STORY_TEXT,
}


def test_names_do_not_lose_articles(spark):
    # Ordinary pages beside them, so that the model of shape has something to learn from.
    plain = f"<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article>{STORY}</article><footer>&copy; me</footer>"
    rows = [(i, "u", h) for i, h in enumerate(NAMED)] + [(100 + i, "u", plain) for i in range(20)]
    got = {r.page_id: r.text for r in mincut.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(NAMED))] == list(NAMED.values())


def test_minimum_cut_is_minimal():
    rng = random.Random(13)
    for _ in range(150):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randint(0, 14))]

        def cost(labels):
            own = sum(max(g, 0) if not x else max(-g, 0) for g, x in zip(gain, labels))
            return own + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(mincut.minimum_cut(gain, edges)) == pytest.approx(best)


def test_quotation_links(spark):
    rows = [
        (1, 0, "user", "Shall we meet?\n\nI am free on Monday.", "x"),
        (1, 1, "assistant", "On Tuesday X wrote:\n> I am  FREE on monday.\nMonday is fine.", "x"),
        (1, 2, "user", "> > Shall we meet?\n> Monday is fine.\nGood.", "x"),
        (1, 3, "assistant", "> Shall we meet?\nStill yes.", "x"),
        (2, 0, "user", ">> Monday is fine.\n", "x"),
        (2, 1, "user", None, "x"),
        (None, 1, "user", "> never said\nhm", "x"),
        (2, 2, None, "", "x"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level string")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(frame).collect()}
    assert len(got) == len(rows)
    assert got[1, 1].text == "Monday is fine." and got[1, 1].reply_to == 0
    assert (got[1, 2].reply_to, got[1, 2].thread, got[1, 2].depth, got[1, 2].quote_levels, got[1, 2].n_quotes, got[1, 2].n_linked) == (1, 0, 2, 2, 2, 2)
    assert (got[1, 3].thread, got[1, 3].depth, got[1, 0].thread, got[1, 0].depth) == (0, 1, 0, 0)
    assert (got[2, 0].text, got[2, 0].reply_to, got[2, 0].n_linked) == ("", None, 1)
    assert (got[None, 1].text, got[None, 1].reply_to, got[None, 1].n_linked) == ("hm", None, 0)
    assert [r.turn for r in sorted((r for (c, _), r in got.items() if c == 1), key=lambda r: (r.thread, r.turn))] == [0, 1, 2, 3]
    assert quotes.link_quotes(frame.limit(0)).count() == 0


def test_quotes_of_what_the_own_conversation_says_later(spark):
    rows = [(1, 0, "user", "> the passage X"), (1, 5, "user", "the passage X"), (2, 0, "user", "the passage X"), (3, 1, "user", "> the passage X")]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 0].n_quotes, got[1, 0].n_linked, got[1, 0].reply_to) == (1, 1, None)
    assert got[3, 1].n_linked == 1 and got[1, 0].text == ""


def brute_quotes(rows):
    """(conv, turn) -> (reply_to, n_quotes, n_linked, thread, depth) of messages of single-line quotes."""
    plain = lambda t: " ".join(t.lower().split())
    said = {}
    for c, t, text in rows:
        for line in text.split("\n"):
            if not line.startswith(">"):
                said.setdefault(plain(line), set()).add((c, t))
        body = "\n".join(x for x in text.split("\n") if not x.startswith(">"))
        said.setdefault(plain(body), set()).add((c, t))
    out = {}
    for c, t, text in rows:
        quoted = [plain(x[1:]) for x in text.split("\n") if x.startswith(">")]
        near = [min(own) for q in quoted if (own := [b for a, b in said.get(q, ()) if a == c]) and min(own) < t]
        linked = sum(1 for q in quoted if [b for a, b in said.get(q, ()) if a == c and b < t] or [a for a, _ in said.get(q, ()) if a != c])
        out[c, t] = [max(near, default=None), len(quoted), linked]
    for (c, t), r in out.items():
        thread, depth = t, 0
        while out[c, thread][0] is not None:
            thread, depth = out[c, thread][0], depth + 1
        r += [thread, depth]
    return {k: tuple(v) for k, v in out.items()}


def test_quotes_against_brute_force(spark):
    """Long chains, common lines and repeated texts; each quote is one line, so a passage is a line."""
    rng, rows = random.Random(8), []
    for c in range(60):
        turns = 400 if c == 0 else rng.randint(1, 12)
        for t in range(turns):
            own = [f"line {c if rng.random() < 0.7 else 0} {rng.randint(0, t)} {t}", f"step {t}" if c == 0 else rng.choice(["thanks", "ok then", f"only {rng.randint(0, 200)}"])]
            quote = rng.choice([x[2].split("\n")[-1] for x in rows[-3:]] or ["nothing"]) if c and rng.random() < 0.6 else rows[-1][2].split("\n")[-1] if t else "nothing"
            rows.append((c, t, f"> {quote}\n" + "\n".join(own) if rng.random() < 0.8 or c == 0 else "\n".join(own)))
    want = brute_quotes(rows)
    got = quotes.link_quotes(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string"))
    assert {(r.conv_id, r.turn): (r.reply_to, r.n_quotes, r.n_linked, r.thread, r.depth) for r in got.collect()} == want
    assert max(v[4] for v in want.values()) > 50


def test_near_copies_choose_the_same_leaders(spark):
    rng = random.Random(44)
    base, rows = words(rng, 200).split(), []
    for k in range(60):
        v = list(base)
        v[rng.randrange(len(v))] = words(rng, 1)
        rows.append((k, " ".join(v), "en"))
    docs = lshforest._numbered(docs_frame(spark, rows).select("doc_id", "text"))
    depth = lshforest.depth_for()
    signed = lshforest._signed(docs, 5, lshforest.TREES, depth, lshforest.MAX_DEPTH)
    edges, few = lshforest.forest_edges(signed.select("key", "highs", "lows", "sketch_a", "sketch_b"), depth)
    assert edges.count() < 12 * len(rows) and not few.count()

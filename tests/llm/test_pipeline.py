"""The pipeline's stages together and one by one, on nulls, empties, repeated rows and clashing columns."""

import random
import zlib

import pytest

import corpus_pipeline
from tidewater.llm import common, perplexity
from tidewater.llm.queries import END_ID, tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, _sha string, _id long, c0 string"
LETTERS = {"en": "abcdefgh", "de": "klmnopqr"}


def words(rng, n, letters):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [(i, words(rng, rng.randint(80, 160), LETTERS[lang]), lang) for i, lang in enumerate(["en", "de"] * 20)]
    more = [(100 + k, base[k][1], base[k][2]) for k in range(5)]  # exact copies
    more += [(200 + k, base[k][1] + " qq", base[k][2]) for k in range(5, 9)]  # near copies
    more += [(300, None, "en"), (301, "", None), (302, "few words", "en"), (303, "1 2 3 " * 60, "de"), (None, words(rng, 90, LETTERS["en"]), "en")]
    more += [(7, base[7][1], base[7][2])]  # a row twice
    return [(i, t, lang, "s", len(t or ""), 5, "x", 9, "y") for i, t, lang in base + more]


def test_stages(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    docs, ids = spark.createDataFrame(rows, COLUMNS), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append(sorted((r.doc_id for r in docs.select("doc_id").collect()), key=lambda i: (i is None, i)))
    quality, language, exact, near = ids[:4]
    assert not {300, 301, 302, 303} & set(quality) and None in quality and language == quality
    # The largest id of equal texts stays, then the smallest of near copies.
    assert not set(range(5)) & set(exact)
    assert set(range(100, 105)) <= set(exact) and exact.count(7) == 1
    assert set(near) == set(exact) - set(range(205, 209))
    kept = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    library = Tokenizer.from_file(tokenizer_path())
    own = {i: [*library.encode(t, add_special_tokens=False).ids, END_ID] for i, t in kept.items()}
    pieces = docs.collect()
    assert sum(p.length for p in pieces) == sum(map(len, own.values()))
    for p in pieces:
        data = b"".join(x.to_bytes(4, "little") for x in own[p.doc_id][p.start : p.start + p.length])
        assert zlib.crc32(data) == p.ids_crc32


def test_run_agrees_with_stages_and_cleans_up(spark, rows, tmp_path):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or -1, r.start, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert len(got) > 30 and len(common._made) < 12
    again = sorted((r.doc_id or -1, r.start, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == again


def test_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], COLUMNS), "").count() == 0


def test_what_docs_still_reads_stays(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS)
    first = corpus_pipeline.quality_rules(spark, docs, "")
    second = corpus_pipeline.language_id(spark, first, "")  # not written in between
    assert first.count() >= second.count() > 0
    assert perplexity.quality_filter(docs).count() == first.count()


def test_runs_leave_each_other_alone(spark, rows, tmp_path):
    """The result of one run can be read after another one, and documents without a language stay."""
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    first = corpus_pipeline.run(spark, str(tmp_path))
    second = corpus_pipeline.run(spark, str(tmp_path))
    read = lambda df: sorted((r.doc_id or -1, r.start, r.length) for r in df.collect())
    assert read(first) == read(second) and len(read(first)) > 30
    nameless = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows], COLUMNS)
    kept = sorted(r.doc_id or -1 for r in corpus_pipeline.language_id(spark, nameless, "").collect())
    assert kept == sorted(r[0] or -1 for r in rows if any(c.isalpha() for c in r[1] or ""))

"""The operators' queries over their whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import blocknames, chunks, conversationtrie, filteraudit, hyperlang, lshforest, mincut, packing, perplexity, quotes, records, tokencounts, urlrules
from tidewater.llm.common import shared_dir

END_ID = 2


#: A document of more tokens is over the limit of ``op13_overlap_resync``.
TOKEN_LIMIT = 1024


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(_table(spark, sf_dir, "conversations"))


def op2_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.encode_decode_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.jaccard_join(_table(spark, sf_dir, "documents"))


def op5_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op6_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperlang.identify(_table(spark, sf_dir, "documents"))


def op7_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality(_table(spark, sf_dir, "documents"))


def op8_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A page was made from the document whose number ends its path; the labels are that document's.
    number = F.regexp_extract(urlrules.path_of(F.col("url")), r"(\d{1,18})(?:\.\w+)?/?$", 1)
    return urlrules.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"), label_key=number.try_cast("long"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = records.fresh_folder(shared_dir(spark))
    records.write_token_records(_table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return records.read_token_records(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.extract(_table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.interaction_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversationtrie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_overlap_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), TOKEN_LIMIT)


_QUERIES = [op1_quotation_links, op2_block_naming, op3_chunk_reuse, op4_lsh_forest, op5_nnls_packing, op6_hyperdimensional, op7_ngram_perplexity, op8_association_rules, op9_token_records, op10_minimum_cut, op11_filter_audit, op12_conversation_trie, op13_overlap_resync]

_ORACLES = {
    "op2_block_naming": """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
        doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_filter_audit": r"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(x, '[ \t-\r]+'), lambda e: e <> '') AS ws, min(doc_id) OVER (PARTITION BY x) AS least FROM t),
    m AS (SELECT w.part, coalesce(l.quality, 0) = 1 AS good, coalesce(l.toxic, 0) = 1 AS toxic,
        [len(ws) < 200, 100 * list_unique(ws) < 50 * len(ws), 100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 3 * length(x),
         regexp_matches(x, '[#$%&*|]'), w.doc_id > least] AS f FROM w LEFT JOIN labels l ON l.doc_id = w.doc_id),
    c AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM m GROUP BY 1, 2),
    d AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
    o AS (SELECT [a.k, b.k, c.k, d1.k, e.k] AS ks FROM d a, d b, d c, d d1, d e WHERE len(list_distinct([a.k, b.k, c.k, d1.k, e.k])) = 5),
    s AS (SELECT part, f, n, g, x, ks, d.k AS step, ks[d.k] AS j, list_bool_or(list_transform(ks[1:d.k - 1], lambda i: f[i])) AS gone FROM c, o, d),
    r AS (SELECT part, ks, step, j, sum(CASE WHEN NOT coalesce(gone, false) AND NOT f[j] THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN NOT coalesce(gone, false) AND f[j] THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN coalesce(gone, false) AND f[j] THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN f[j] AND len(list_filter(f, lambda e: e)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN NOT coalesce(gone, false) AND f[j] THEN g ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN NOT coalesce(gone, false) AND f[j] THEN x ELSE 0 END)::BIGINT AS toxic_lost FROM s GROUP BY 1, 2, 3, 4)
    SELECT part, array_to_string(list_transform(ks, lambda i: substr('ABCDE', i::INTEGER, 1)), '') AS filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        sum(removed) OVER (PARTITION BY part, j)::BIGINT AS shapley FROM r""",
    "op12_conversation_trie": r"""WITH o AS (SELECT conv_id AS c, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS x, coalesce(text, '') AS t, turn FROM conversations WHERE conv_id IS NOT NULL),
    a AS (SELECT c, list(sha256(x) ORDER BY turn NULLS FIRST, sha256(x)) AS xs, list(len(regexp_extract_all(t, '[^ \t-\r]+')) ORDER BY turn NULLS FIRST, sha256(x)) AS ws FROM o GROUP BY c),
    crc AS (SELECT c, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''), lambda e: [ascii(e)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda r, v: CASE WHEN v >= 0 THEN xor(r, v) ELSE xor(r >> 1, 3988292384 * (r & 1)) END), 4294967295) % 4 AS h FROM a),
    h AS (SELECT a.c, b.xs AS bx, b.ws AS bw, a.xs, a.ws, crc.h FROM a LEFT JOIN a b ON b.c = a.c - a.c % 20 JOIN crc ON crc.c = a.c),
    p AS (SELECT c, list_concat(coalesce(bx, [])[1:h], xs[h + 1:]) AS xs, list_concat(coalesce(bw, [])[1:h], ws[h + 1:]) AS ws FROM h),
    q AS (SELECT c, xs, ws, unnest(range(0, len(xs) + 1)) AS d FROM p),
    n AS (SELECT xs[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(ws[d]) AS w,
        sha256(coalesce(string_agg(CASE WHEN len(xs) = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM q GROUP BY 1, 2),
    e AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
    u AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN e ON e.k = n.k),
    z AS (SELECT k[1:j] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * coalesce(w, 0))::BIGINT AS saved_tokens
        FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM u) GROUP BY 1)
    SELECT u.conv_id, u.d AS depth, o.conv_id AS parent_conv_id, u.n_convs, u.n_children, z.n_leaves, z.saved_tokens, u.ends_sha256
    FROM u JOIN z ON z.k = u.k LEFT JOIN n o ON u.d > 0 AND o.k = u.k[1:u.d - 1]""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)

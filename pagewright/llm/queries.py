"""The queries of the subpackage: each applies its operator to the whole of its table, under its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.base import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, a directory for each source and each thousand ids in it."""
    from pagewright.llm.licenses import scan

    path = F.concat_ws("/", "source", F.expr("cast(doc_id div 1000 as string)"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm import language_id as op

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(op.bucket_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return op.identify(docs, op.learn(op.labelled_rows(docs))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.byte_bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm import toxicity as op

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(op.bucket_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return op.toxicity(docs, op.learn(op.labelled_rows(docs, labels))).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.topk_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), k=5, scale=256)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.html_extraction import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.warc import round_trip

    back = round_trip(table(spark, sf_dir, "pages"), least=0, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), width=4, percent=80)


def _mined_label() -> Column:
    """The label of a row; where the id is divisible by 7, the next one."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives(rows, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), _mined_label())


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.filter_audit import audit, text_filters

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), text_filters(), copies="E")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.suffix_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_license_scan, op3_language_id, op4_topk_search, op5_html_extraction, op6_minhash_near_dedup, op7_warc, op8_best_fit_packing, op9_toxicity, op10_byte_bpe, op11_hard_negatives, op12_filter_audit, op13_suffix_dedup)}

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op4_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        ) SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
        ), p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS positive_rank FROM s WHERE same
        ), n AS (
            SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id,
                positive_score, s.score AS negative_score, CAST(positive_rank AS INTEGER) AS positive_rank
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score WHERE positive_rank <= 5
        ) SELECT * FROM n WHERE rank <= 3
    """,
    "op12_filter_audit": """
        WITH w AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
                coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e FROM documents
        ), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
        ), f AS (
            SELECT part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
                regexp_matches(text, '[#$%&*|]') AS d, e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)
        ), g AS (SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS fails, good, toxic, count(*) AS n FROM f GROUP BY ALL
        ), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
            SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
        ), steps AS (
            SELECT filter_order, CAST(step AS INTEGER) AS step, CAST(pow(2, ascii(filter_order[step]) - 65) AS INTEGER) AS bit,
                CAST(list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda y: CASE WHEN y = '' THEN 0 ELSE CAST(pow(2, ascii(y) - 65) AS INTEGER) END)) AS INTEGER) AS before
            FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
        ), c AS (
            SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (WHERE fails & (before | bit) = 0), 0) AS BIGINT) AS kept,
                CAST(coalesce(sum(n) FILTER (WHERE fails & before = 0 AND fails & bit <> 0), 0) AS BIGINT) AS removed,
                CAST(coalesce(sum(n) FILTER (WHERE fails & before <> 0 AND fails & bit <> 0), 0) AS BIGINT) AS redundant,
                CAST(coalesce(sum(n) FILTER (WHERE fails = bit), 0) AS BIGINT) AS unique_fails,
                CAST(coalesce(sum(n) FILTER (WHERE fails & before = 0 AND fails & bit <> 0 AND good), 0) AS BIGINT) AS good_lost,
                CAST(coalesce(sum(n) FILTER (WHERE fails & before = 0 AND fails & bit <> 0 AND toxic), 0) AS BIGINT) AS toxic_lost
            FROM g, steps GROUP BY ALL
        ) SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM c
    """,
}

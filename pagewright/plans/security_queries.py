"""Security and policy queries over documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import fixed as V
from pagewright.functions import security as S
from pagewright.functions import text as T
from pagewright.plans.augment import AUGMENTED_SQL, FOLDED_SQL, augmented_text, read

_COUNT_SQL = [f"len(regexp_extract_all(t, '(?i){p}'))" for p, _, _ in V.INJECTION_PATTERNS]
_VERBS = "|".join(V.IMPERATIVE_VERBS)


def _round6(c):
    return F.floor(c * 1e6 + 0.5).cast("bigint")


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, counts, density and score of the folded texts, risk level of each."""
    folded = docs.select("doc_id", T.for_matching(augmented_text()).alias("t"))
    counted = folded.select("doc_id", "t", S.pattern_counts(F.col("t")).alias("counts"), S.imperative_density(F.col("t")).alias("density"))
    value = S.score(F.col("counts"), F.col("density"), F.lit(False))
    return counted.withColumn("score", value).withColumn("risk_level", S.risk_level(F.col("score")))


def _samples_sql() -> str:
    """A row for each pattern: its groups, or all of it, at the first three matches."""

    def one(pattern: str, name: str) -> str:
        parts = [f"regexp_extract_all(t, '(?i){pattern}', {i})" for i in (range(1, re.compile(pattern).groups + 1) or [0])]
        joined = " || '|' || ".join(f"{p}[i]" for p in parts)
        samples = f"array_to_string(list_transform(range(1, least(3, len({parts[0]})) + 1), lambda i: {joined}), ';')"
        return f"SELECT doc_id, '{name}' AS pattern, len({parts[0]}) AS occurrences, {samples} AS samples FROM f WHERE len({parts[0]}) > 0"

    return f"WITH f AS (SELECT doc_id, {FOLDED_SQL} AS t FROM documents) " + " UNION ALL ".join(one(p, name) for p, _, name in V.INJECTION_PATTERNS)


def _scored_sql() -> str:
    parts = " + ".join(
        f"CASE WHEN c{i} > 0 THEN CAST({w} AS DOUBLE) * (1 + CAST({V.LOG_FACTOR} AS DOUBLE) * log2(CAST(c{i} AS DOUBLE))) ELSE 0 END"
        for i, (_, w, _) in enumerate(V.INJECTION_PATTERNS)
    )
    counts = ", ".join(f"{c} AS c{i}" for i, c in enumerate(_COUNT_SQL))
    most = ", ".join(f"c{i}" for i in range(len(_COUNT_SQL)))
    risk = " ".join(f"WHEN score >= CAST({least} AS DOUBLE) THEN '{name}'" for name, least in V.RISK_LEVELS)
    return f"""
        f AS (SELECT doc_id, {FOLDED_SQL} AS t FROM documents),
        c AS (SELECT doc_id, {counts}, len(regexp_extract_all(lower(t), '\\b\\w+\\b')) AS words,
              len(regexp_extract_all(lower(t), '\\b({_VERBS})\\b')) AS verbs FROM f),
        d AS (SELECT *, CASE WHEN words > 0 THEN CAST(verbs AS DOUBLE) / words ELSE 0 END AS density, greatest({most}) AS most FROM c),
        p AS (SELECT *, least(1.0, least(CAST(1 AS DOUBLE), {parts}) + least(density * CAST({V.DENSITY_FACTOR} AS DOUBLE), CAST({V.DENSITY_MOST} AS DOUBLE))) AS base FROM d),
        s AS (SELECT *, CASE WHEN most >= {V.REPEATS} THEN greatest(base, CAST({V.REPEATS_FLOOR} AS DOUBLE)) ELSE base END AS score FROM p),
        r AS (SELECT *, CASE {risk} ELSE 'safe' END AS risk_level FROM s)"""


def injection_scan_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.size(F.filter("counts", lambda n: n > 0))
    return scored(read(spark, sf_dir, "documents")).select(
        "doc_id", found.cast("bigint").alias("patterns"), _round6(F.col("density")).alias("density_millionths"), _round6(F.col("score")).alias("score_millionths"), "risk_level"
    )


def pattern_counts_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for _, _, n in V.INJECTION_PATTERNS])
    rows = scored(read(spark, sf_dir, "documents")).select("doc_id", F.explode(F.arrays_zip(names.alias("name"), F.col("counts").alias("n"))).alias("x"))
    return rows.where("x.n > 0").groupBy(F.col("x.name").alias("pattern")).agg(F.count("*").alias("documents"), F.sum("x.n").cast("bigint").alias("occurrences"))


def imperative_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents")).select("doc_id", _round6(F.col("density")).alias("density_millionths"))


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.POLICY_PRESETS, "policy_name string, block double, warn double")


def risk_policy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(read(spark, sf_dir, "documents")).select("score", "risk_level")
    # Four presets in both modes, a constant of eight entries, go with each distinct score.
    every = F.array(*[F.struct(F.lit(n).alias("policy_name"), F.lit(strict).alias("strict"), S.thresholds(F.lit(b), F.lit(w), F.lit(strict)).alias("x")) for n, b, w in V.POLICY_PRESETS for strict in (False, True)])
    with_all = rows.groupBy("score", "risk_level").agg(F.count("*").alias("n")).select("*", F.explode(every).alias("k")).select("score", "risk_level", "n", "k.*")
    decided = with_all.withColumn("policy_action", S.action(F.col("score"), F.col("x.block"), F.col("x.warn")))
    return decided.groupBy("policy_name", "strict", "risk_level", "policy_action").agg(F.sum("n").alias("documents"))


_LIMITS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({b} AS DOUBLE), CAST({w} AS DOUBLE))" for n, b, w in V.POLICY_PRESETS) + ") AS v(policy_name, block, warn)"
_THRESHOLD_SQL = f"""
    k AS (SELECT policy_name, strict, CASE WHEN strict THEN least(block, CAST(0.5 AS DOUBLE)) ELSE block END AS block,
          CASE WHEN strict THEN least(warn, CAST(0.3 AS DOUBLE)) ELSE warn END AS warn FROM ({_LIMITS_SQL}) CROSS JOIN (VALUES (true), (false)) AS s(strict)),
    l AS (SELECT policy_name, strict, block, CASE WHEN warn >= block THEN CASE WHEN block > CAST(0.01 AS DOUBLE) THEN block - CAST(0.01 AS DOUBLE) WHEN block > 0 THEN block * CAST(0.9 AS DOUBLE) ELSE 0 END ELSE warn END AS warn FROM k)"""


def policy_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits that customers set, some missing, out of range or the wrong way round, made safe."""
    id_ = F.col("c_custkey")
    block = F.when(id_ % 11 > 0, (id_ % 130) / 100.0)
    warn = F.when(id_ % 7 > 0, (id_ % 90) / 100.0 - 0.1)
    rows = read(spark, sf_dir, "customer").select("c_custkey", S.thresholds(block, warn, id_ % 3 == 0).alias("x"))
    return rows.select("c_custkey", _round6(F.col("x.block")).alias("block_millionths"), _round6(F.col("x.warn")).alias("warn_millionths"))


def rule_scan_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", S.matched_rules(augmented_text()).alias("rules"))
    return rows.where(F.size("rules") > 0).select("doc_id", F.array_join("rules", ",").alias("rules"), F.size("rules").cast("bigint").alias("n_rules"))


def pattern_merge_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of two pattern sets for a document, merged by name: summed, the larger weight, the first samples."""
    own = [(r"\bact\s+as\s+a\s+\w+", 0.5, "Role-play instruction (weak signal)"), (r"\bclerk\b", 0.4, "custom_pattern_1")]
    folded = read(spark, sf_dir, "documents").select("doc_id", T.for_matching(augmented_text()).alias("t"))
    each = folded.select("doc_id", F.explode(F.concat(S.pattern_matches(F.col("t")), S.pattern_matches(F.col("t"), own))).alias("m"))
    return each.groupBy("doc_id", F.col("m.pattern").alias("pattern")).agg(
        F.sum("m.occurrences").cast("bigint").alias("occurrences"), F.max("m.weight").alias("weight")
    )


def pattern_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the groups of each pattern took at its first three matches in a document."""
    folded = read(spark, sf_dir, "documents").select("doc_id", T.for_matching(augmented_text()).alias("t"))
    each = folded.select("doc_id", F.explode(S.pattern_matches(F.col("t"))).alias("m"))
    taken = F.array_join(F.transform("m.samples", lambda x: F.array_join(x, "|")), ";")
    return each.select("doc_id", F.col("m.pattern").alias("pattern"), F.col("m.occurrences").cast("bigint").alias("occurrences"), taken.alias("samples"))


def ascii_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.ascii_fold(F.col("text")).alias("folded"))


def zero_width_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.regexp_replace("text", "e", "e​­")
    return read(spark, sf_dir, "documents").select("doc_id", T.without_zero_width(noisy).alias("stripped"), F.length(noisy).cast("bigint").alias("noisy_length"))


def flags_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(read(spark, sf_dir, "documents"))
    found = S.flags(F.col("counts"), F.lit(0.0), F.col("doc_id") % 5 == 0, F.lit(False))
    return rows.select("doc_id", F.array_join(found, "|").alias("flags"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = read(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id")).where("copies > 1")


def score_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density and words by role of a conversation, and the turn before."""
    rows = read(spark, sf_dir, "conversations")
    words = F.regexp_count(F.lower(T.ascii_fold(F.col("text"))), F.lit(r"\b\w+\b"))
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select("role", before.alias("previous_role"), words.alias("words")).groupBy("role", "previous_role").agg(F.count("*").alias("turns"), F.sum("words").cast("bigint").alias("words"))


def labelled_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(read(spark, sf_dir, "documents")).select("doc_id", "risk_level").join(read(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("risk_level", "toxic", "quality").agg(F.count("*").alias("documents"))


def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark text (anti join on content hashes), by source."""
    docs = read(spark, sf_dir, "documents").select("source", T.content_hash(F.col("text")).alias("h"))
    items = read(spark, sf_dir, "benchmark").select(T.content_hash(F.col("text")).alias("h"))
    return docs.join(items, "h", "left_anti").groupBy("source").agg(F.count("*").alias("documents"))


_RULES_SQL = ", ".join(
    "CASE WHEN " + " OR ".join("(" + " AND ".join(f"contains(lower(t), '{k}')" for k in every) + ")" for every in alternatives) + f" THEN '{name}' END"
    for name, _, _, alternatives in V.KEYWORD_RULES
)
_FOUND_SQL = " + ".join(f"CAST(c{i} > 0 AS BIGINT)" for i in range(len(_COUNT_SQL)))
_OWN_SQL = [("\\bact\\s+as\\s+a\\s+\\w+", 0.5, "Role-play instruction (weak signal)"), ("\\bclerk\\b", 0.4, "custom_pattern_1")]
_MERGE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS pattern, CAST({w} AS DOUBLE) AS weight, len(regexp_extract_all(t, '(?i){p}')) AS n FROM f"
    for p, w, name in [*[(p, w, n) for p, w, n in V.INJECTION_PATTERNS], *_OWN_SQL]
)
_PAT_SQL = " UNION ALL ".join(f"SELECT '{name}' AS pattern, c{i} AS n FROM c" for i, (_, _, name) in enumerate(V.INJECTION_PATTERNS))

QUERIES = {
    f.__name__: f
    for f in (
        injection_scan_augmented, pattern_counts_augmented, imperative_density, risk_policy_matrix, policy_thresholds, rule_scan_augmented, pattern_merge_augmented, pattern_samples,
        ascii_fold, zero_width_strip, flags_array, content_hash, exact_duplicates, score_by_role, labelled_risk, benchmark_overlap,
    )
}

ORACLE_SQL = {
    "pattern_samples": _samples_sql(),
    "injection_scan_augmented": f"WITH {_scored_sql()} SELECT doc_id, {_FOUND_SQL} AS patterns, CAST(floor(density * 1e6 + 0.5) AS BIGINT) AS density_millionths, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS score_millionths, risk_level FROM r",
    "pattern_counts_augmented": f"WITH {_scored_sql()} SELECT pattern, count(*) AS documents, CAST(sum(n) AS BIGINT) AS occurrences FROM ({_PAT_SQL}) WHERE n > 0 GROUP BY pattern",
    "imperative_density": f"WITH {_scored_sql()} SELECT doc_id, CAST(floor(density * 1e6 + 0.5) AS BIGINT) AS density_millionths FROM r",
    "risk_policy_matrix": f"WITH {_scored_sql()}, {_THRESHOLD_SQL} SELECT policy_name, strict, risk_level, CASE WHEN score >= block THEN 'block' WHEN score >= warn THEN 'warn' ELSE 'allow' END AS policy_action, count(*) AS documents FROM r CROSS JOIN l GROUP BY ALL",
    "policy_thresholds": """WITH g AS (SELECT c_custkey, c_custkey % 3 = 0 AS strict, coalesce(least(1, greatest(0, CASE WHEN c_custkey % 11 > 0 THEN CAST(c_custkey % 130 AS DOUBLE) / 100 END)), 1) AS block,
            coalesce(CASE WHEN c_custkey % 7 > 0 THEN least(1, greatest(0, CAST(c_custkey % 90 AS DOUBLE) / 100 - CAST(0.1 AS DOUBLE))) END, CAST(0.5 AS DOUBLE)) AS warn,
            CASE WHEN c_custkey % 11 > 0 THEN 1 ELSE 0 END AS set FROM customer),
        c AS (SELECT c_custkey, CASE WHEN set = 0 THEN CASE WHEN strict THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END WHEN strict THEN least(block, CAST(0.5 AS DOUBLE)) ELSE block END AS block, CASE WHEN strict THEN least(warn, CAST(0.3 AS DOUBLE)) ELSE warn END AS warn FROM g)
        SELECT c_custkey, CAST(floor(block * 1000000 + 0.5) AS BIGINT) AS block_millionths, CAST(floor(CASE WHEN warn >= block THEN CASE WHEN block > CAST(0.01 AS DOUBLE) THEN block - CAST(0.01 AS DOUBLE) WHEN block > 0 THEN block * CAST(0.9 AS DOUBLE) ELSE 0 END ELSE warn END * 1000000 + 0.5) AS BIGINT) AS warn_millionths FROM c""",
    "rule_scan_augmented": f"SELECT doc_id, array_to_string(rules, ',') AS rules, CAST(len(rules) AS BIGINT) AS n_rules FROM (SELECT doc_id, list_filter([{_RULES_SQL}], lambda x: x IS NOT NULL) AS rules FROM (SELECT doc_id, {AUGMENTED_SQL} AS t FROM documents)) WHERE len(rules) > 0",
    "pattern_merge_augmented": f"WITH f AS (SELECT doc_id, {FOLDED_SQL} AS t FROM documents) SELECT doc_id, pattern, CAST(sum(n) AS BIGINT) AS occurrences, max(weight) AS weight FROM ({_MERGE_SQL}) WHERE n > 0 GROUP BY ALL",
    "ascii_fold": "SELECT doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') AS folded FROM documents",
    "zero_width_strip": "SELECT doc_id, text AS stripped, length(replace(text, 'e', 'e' || chr(8203) || chr(173))) AS noisy_length FROM documents",
    "flags_array": f"WITH {_scored_sql()} SELECT doc_id, array_to_string(list_filter([CASE WHEN {_FOUND_SQL} > 0 THEN 'injection_patterns_detected:' || ({_FOUND_SQL}) END, CASE WHEN doc_id % 5 = 0 THEN 'hidden_content' END, CASE WHEN {_FOUND_SQL} > {V.MANY_PATTERNS} THEN 'multiple_injection_attempts' END], lambda x: x IS NOT NULL), '|') AS flags FROM r",
    "content_hash": "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents",
    "exact_duplicates": "SELECT 'sha256:' || sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "score_by_role": "SELECT role, previous_role, count(*) AS turns, CAST(sum(words) AS BIGINT) AS words FROM (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role, len(regexp_extract_all(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '\\b\\w+\\b')) AS words FROM conversations) GROUP BY ALL",
    "labelled_risk": f"WITH {_scored_sql()} SELECT risk_level, toxic, quality, count(*) AS documents FROM r JOIN labels USING (doc_id) GROUP BY ALL",
    "benchmark_overlap": "SELECT source, count(*) AS documents FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text) GROUP BY source",
}

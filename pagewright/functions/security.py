"""Prompt-injection scoring as columns: pattern counts, density of imperatives, score, risk, flags, policy."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import fixed as V
from pagewright.functions import text as T
from pagewright.functions.resolution import let
from pagewright.functions.slices import small_batches


def pattern_counts(text: Column, patterns=V.INJECTION_PATTERNS) -> Column:
    """An array with the number of matches of each pattern in a text of ``text.for_matching``.

    Only texts that hold a literal of each group that the pattern needs are searched for it.
    """
    known = {p: gate for (p, _, _), gate in zip(V.INJECTION_PATTERNS, V.PATTERN_GATES, strict=True)}
    gates = [known.get(p) for p, _, _ in patterns]

    def count(pattern: str, gate: list[list[str]] | None, low: Column) -> Column:
        found = F.regexp_count(text, F.lit(f"(?i){pattern}"))
        if gate is None:
            return found
        may = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in group]) for group in gate])
        return F.when(may, found).otherwise(0)

    return let(F.lower(text), lambda low: F.array(*[count(p, g, low) for (p, _, _), g in zip(patterns, gates, strict=True)]))


def pattern_matches(text: Column, patterns=V.INJECTION_PATTERNS, samples: int = 3) -> Column:
    """An array of (pattern, weight, occurrences, samples) of the patterns that match.

    A sample is what the pattern's groups took, in their order, or the whole match of one without groups; the first
    ``samples`` of them in the text.
    """

    def taken(pattern: str) -> Column:
        groups = re.compile(pattern).groups
        each = [F.slice(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(i)), 1, samples) for i in (range(1, groups + 1) if groups else [0])]
        return F.transform(each[0], lambda x, i: F.array(x, *(F.get(more, i) for more in each[1:])))

    def matched(counts: Column) -> Column:
        one = [
            F.when(F.get(counts, F.lit(i)) > 0, F.struct(F.lit(name).alias("pattern"), F.lit(w).alias("weight"), F.get(counts, F.lit(i)).alias("occurrences"), taken(p).alias("samples")))
            for i, (p, w, name) in enumerate(patterns)
        ]
        return F.array_compact(F.array(*one))

    return let(pattern_counts(text, patterns), matched)


def imperative_density(text: Column) -> Column:
    """Imperative verbs as a share of the words of a folded text; 0 without words. The text is cut into words once."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda x: x != "")
    return let(words, lambda w: F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: x.isin(*V.IMPERATIVE_VERBS))) / F.size(w)).otherwise(F.lit(0.0)))


def score(counts: Column, density: Column, hidden: Column, patterns=V.INJECTION_PATTERNS, too_deep: Column | bool = False) -> Column:
    """Weighted patterns, each more by the logarithm of its matches, plus shares for hidden text and imperatives.

    An encoding that is too deep counts as one match of a pattern of its own.
    """
    at = [F.element_at(counts, i + 1) for i in range(len(patterns))]
    parts = [F.when(n > 0, F.lit(w) * (1 + F.lit(V.LOG_FACTOR) * F.log2(n.cast("double")))).otherwise(0.0) for n, (_, w, _) in zip(at, patterns, strict=True)]
    total = F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts) + F.when(F.lit(too_deep), V.DEEP_WEIGHT).otherwise(0.0))
    total = total + F.when(hidden, V.HIDDEN_WEIGHT).otherwise(0.0) + F.least(density * V.DENSITY_FACTOR, F.lit(V.DENSITY_MOST))
    total = F.least(F.lit(1.0), total)
    return F.when(F.array_max(counts) >= V.REPEATS, F.greatest(total, F.lit(V.REPEATS_FLOOR))).otherwise(total)


def risk_level(value: Column) -> Column:
    out = F.when(value.isNull() | F.isnan(value), "critical")
    for name, least in V.RISK_LEVELS:
        out = out.when(value >= least, name)
    return out.otherwise("safe")


def flags(counts: Column, density: Column, hidden: Column, too_deep: Column) -> Column:
    found = F.size(F.filter(counts, lambda n: n > 0)) + too_deep.cast("int")
    return F.array_compact(
        F.array(
            F.when(found > 0, F.concat(F.lit("injection_patterns_detected:"), found.cast("string"))),
            F.when(hidden, F.lit("hidden_content")),
            F.when(density > V.DENSITY_FLAG, F.format_string("high_imperative_density:%.2f", density)),
            F.when(too_deep, F.lit("decoding_iteration_limit_reached")),
            F.when(found > V.MANY_PATTERNS, F.lit("multiple_injection_attempts")),
        )
    )


def matched_rules(text: Column, rules=V.KEYWORD_RULES) -> Column:
    """Names of the keyword rules that hold for a text, in their order."""
    low = F.lower(text)

    def holds(alternatives: list[list[str]]) -> Column:
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains(low, F.lit(k)) for k in every]) for every in alternatives])

    return F.array_compact(F.array(*[F.when(holds(alt), F.lit(name)) for name, _, _, alt in rules if alt])) if rules else F.array().cast("array<string>")


def scanned(rows: DataFrame, text_col: str = "text", patterns=V.INJECTION_PATTERNS, rules=V.KEYWORD_RULES) -> DataFrame:
    """``rows`` with what patterns find: counts, density, too_deep, and rules, the names of keyword rules that hold.

    Patterns are counted in the text with its encodings undone; if that took too many rounds, in the text as it is as
    well, and the larger number counts. The density is that of the text as it is.
    """
    small_batches(rows.sparkSession)
    out = rows.withColumn("__found", T.matchable(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.select("*", "__found.too_deep", F.col("__found.bare").alias("__bare"), F.col("__found.own").alias("__own"))
    own = F.when(F.col("too_deep"), pattern_counts(F.col("__own"), patterns))
    both = F.zip_with(pattern_counts(F.col("__bare"), patterns), F.coalesce(own, F.array()), lambda a, b: F.greatest(a, b))
    out = out.withColumn("counts", both).withColumn("density", imperative_density(F.col("__own"))).withColumn("rules", matched_rules(F.coalesce(F.col(text_col), F.lit("")), rules))
    return out.drop("__found", "__bare", "__own")


def scored(rows: DataFrame, hidden: Column | bool = False, advanced: bool = False, patterns=V.INJECTION_PATTERNS, block: Column | float = 0.7, warn: Column | float = 0.4, custom: list[tuple[str, float, str]] = (), rules=V.KEYWORD_RULES) -> DataFrame:
    """``rows`` of ``scanned`` with basic_score, rule_score, injection_score, flags, scan_method and explanation.

    With ``advanced`` a keyword rule that holds counts with its confidence, and the larger score is the document's.
    ``custom``, a user's patterns from ``guards.custom_patterns``, were counted after ``patterns``; they make a score and
    flags of their own, of which the larger and each once count.
    """
    hidden, block, warn = F.lit(hidden), F.lit(block), F.lit(warn)
    counts = F.slice("counts", 1, len(patterns)) if custom else F.col("counts")
    basic = score(counts, F.col("density"), hidden, patterns, F.col("too_deep"))
    if custom:
        extra = F.slice("counts", len(patterns) + 1, len(custom))
        basic = F.greatest(basic, score(extra, F.col("density"), hidden, custom, F.col("too_deep")))
    held = F.size("rules") > 0
    confidence = F.when(held, V.RULE_CONFIDENCE).otherwise(0.0) if advanced else F.lit(None).cast("double")
    out = rows.withColumn("basic_score", basic).withColumn("rule_score", confidence)
    out = out.withColumn("injection_score", F.greatest("basic_score", F.coalesce("rule_score", F.lit(0.0))))
    out = out.withColumn("scan_method", F.lit("rules" if advanced else "basic"))
    own = flags(counts, F.col("density"), hidden, F.col("too_deep"))
    if custom:
        many = F.when(F.size(F.filter("counts", lambda n: n > 0)) > V.MANY_PATTERNS, F.array(F.lit("multiple_injection_attempts")))
        own = F.array_distinct(F.concat(own, flags(extra, F.col("density"), hidden, F.col("too_deep")), F.coalesce(many, F.array().cast("array<string>"))))
    if advanced:
        named = F.transform("rules", lambda r: F.concat(F.lit("rule:"), r))
        kinds = F.array_compact(F.array(*[F.when(F.array_contains("rules", n), F.lit(f"category:{kind}")) for n, _, kind, _ in rules]))
        severity = F.when(F.col("rule_score") >= 0.7, "high").when(F.col("rule_score") >= 0.3, "medium").otherwise("low")
        own = F.array_distinct(F.concat(own, F.when(held, F.concat(named, kinds, F.array(F.concat(F.lit("severity:"), severity)))).otherwise(F.array().cast("array<string>"))))
    out = out.withColumn("flags", own)
    found = F.size(F.filter("counts", lambda n: n > 0)) + F.col("too_deep").cast("int")
    names = F.array(*[F.lit(n) for _, _, n in [*patterns, *custom]])
    triggers = F.filter(F.arrays_zip(names.alias("name"), F.col("counts").alias("occurrences")), lambda x: x["occurrences"] > 0)
    told = F.struct(
        F.col("scan_method"),
        action(F.col("injection_score"), block, warn).alias("recommendation"),
        F.format_string("Detected %d heuristic pattern groups with imperative density %.3f.", found, F.col("density")).alias("summary"),
        triggers.alias("patterns"),
        (F.col("rules") if advanced else F.array().cast("array<string>")).alias("rules"),
        hidden.alias("hidden_content_detected"),
    )
    return out.withColumn("explanation", told)


def rule_score(value: Column) -> Column:
    """A rule scanner's score made safe: 0.75 if it is missing or no number, at least the confidence floor if failed."""
    return F.when(value.isNull() | F.isnan(value), 0.75).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def thresholds(block: Column, warn: Column, strict: Column) -> Column:
    """(block, warn), in range, capped if strict, and apart."""
    def bounded(c: Column, missing: float) -> Column:
        return F.when(c.isNull() | F.isnan(c), F.lit(missing)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))

    block, warn = bounded(block, 1.0), bounded(warn, 0.5)
    block = F.when(strict, F.least(block, F.lit(0.5))).otherwise(block)
    warn = F.when(strict, F.least(warn, F.lit(0.3))).otherwise(warn)
    apart = F.when(block > 0.01, block - 0.01).otherwise(F.when(block > 0, block * 0.9).otherwise(0.0))
    return F.struct(block.alias("block"), F.when(warn >= block, apart).otherwise(warn).alias("warn"))


def action(value: Column, block: Column, warn: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value) | (value >= block), "block").when(value >= warn, "warn").otherwise("allow")

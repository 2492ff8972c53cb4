"""The library's front: pages in, documents, blocks, chunks, links, reports and statistics out, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import outcomes as O
from pagewright.functions import security as S
from pagewright.functions import urls as U
from pagewright.functions.fixed import POLICY_PRESETS
from pagewright.functions import fixed as V
from pagewright.functions.guards import config_of, custom_patterns, keyword_rules, unknown_keys, with_weights
from pagewright.functions.resolution import held
from pagewright.operators import chunks as C
from pagewright.operators import pages as P
from pagewright.operators.policies import first_policy
from pagewright.operators.requests import batch_summary
from pagewright.sources.tables import POLICY


@dataclass(frozen=True)
class Config:
    policy: str = "normal"
    strict: bool = False
    chunking: str = "none"
    chunk_size: int = 2000
    chunk_overlap: int = 0
    advanced_security: bool = False
    custom_patterns: tuple[str | tuple[str, float], ...] = field(default=())
    pattern_weights: tuple[tuple[str, float], ...] = field(default=())
    rule_text: str = ""
    mode: str = "auto"
    extract_metadata: bool = False
    extract_links: bool = True
    extract_blocks: bool = True
    output_formats: tuple[str, ...] = field(default=("markdown",))
    output_profile: str = "default"
    blocked_selectors: tuple[str, ...] = field(default=())
    unwrap_selectors: tuple[str, ...] = field(default=())
    blocked_tags: tuple[str, ...] = field(default=())
    allowed_tags: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        C.validate(self.chunk_size, self.chunk_overlap)
        if self.chunking not in ("none", "size", "heading"):
            raise ValueError(f"unknown chunking {self.chunking!r}")
        self.limits()
        if self.mode not in ("auto", "fast", "render"):
            raise ValueError(f"unknown mode {self.mode!r}")
        self.scan()

    def scan(self) -> dict:
        """What ``documents`` searches for: the patterns with a user's weights, custom ones, keyword rules of a rule file."""
        weighted = with_weights(V.INJECTION_PATTERNS, dict(self.pattern_weights))
        known = len(V.INJECTION_PATTERNS)
        custom = [*weighted[known:], *custom_patterns(list(self.custom_patterns))]
        rules = [*V.KEYWORD_RULES, *keyword_rules(self.rule_text)] if self.rule_text else V.KEYWORD_RULES
        return {"patterns": weighted[:known], "custom": custom, "keyword_rules": rules}

    @classmethod
    def of(cls, *layers: dict | None) -> Config:
        """A configuration of several layers, the first of which count most, over its output profile's values."""
        merged = config_of(*layers)
        unknown = unknown_keys(merged, {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**merged)

    def limits(self) -> tuple[float, float]:
        """(block, warn) of the preset; strict caps them at 0.5 and 0.3."""
        known = {name: (block, warn) for name, block, warn in POLICY_PRESETS}
        name = "normal" if self.policy == "moderate" else self.policy
        if name not in known:
            raise ValueError(f"unknown policy {self.policy!r}")
        block, warn = known[name]
        return (min(block, 0.5), min(warn, 0.3)) if self.strict else (block, warn)


def _documents(pages: DataFrame, config: Config, block, warn, rules=None, keep: tuple[str, ...] = (), **same) -> DataFrame:
    """Documents with what the configuration asks for: metadata, links, mode."""
    if config.extract_metadata:
        pages, keep = P.with_metadata(pages), (*keep, "metadata")
    docs = P.documents(pages, block, warn, config.advanced_security, rules=rules, keep=keep, **config.scan(), **same)
    docs = docs.select(*(c for c in docs.columns if c not in keep), *keep)
    docs = docs if config.extract_links else docs.drop("anchors", "internal", "external", "links_total")
    return docs.withColumn("mode", F.lit(config.mode))


def ingest(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """Documents of pages (page_id, url, html)."""
    block, warn = config.limits()
    rules = {name: getattr(config, name) for name in ("blocked_selectors", "unwrap_selectors", "blocked_tags", "allowed_tags")}
    return _documents(pages, config, block, warn, **rules)


def ingest_by_domain(pages: DataFrame, policies: DataFrame | list[dict], config: Config = Config()) -> DataFrame:
    """Documents under the first policy that matches a page's host, with ``domain`` and ``notes``, in one pass over pages.

    ``policies``: a table of ``sources.tables.POLICY``, or dicts with such keys, whose order is their priority. What a
    policy doesn't set, and pages without a policy, follow ``config``; so does a policy whose preset isn't known in a
    table (in a list it raises). A policy is data: its rules and thresholds come to the page by the join with its host.
    """
    spark = pages.sparkSession
    if isinstance(policies, list):
        fields_of = [f.strip().partition(" ")[0] for f in POLICY.split(", ")]
        for p in policies:
            unknown = unknown_keys(p, set(fields_of))
            if unknown:
                raise ValueError(f"unknown settings of a policy: {', '.join(unknown)}")
            if p.get("policy_name"):
                replace(config, policy=p["policy_name"]).limits()
        rows = [{"priority": i, "include_subdomains": False, **p} for i, p in enumerate(policies)]
        policies = spark.createDataFrame([tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) and f != "priority" else v for f, v in ((f, r.get(f)) for f in fields_of)) for r in rows], POLICY)
    absent = [f for f in POLICY.split(", ") if f.strip().partition(" ")[0] not in policies.columns]
    policies = policies.withColumns({f.strip().partition(" ")[0]: F.lit(None).cast(f.strip().partition(" ")[2]) for f in absent}) if absent else policies
    own = first_policy(pages.select("page_id", "url", "html", U.host(F.col("url")).alias("host")), policies)

    def preset(which: int) -> F.Column:
        found = F.create_map(*(F.lit(x) for row in POLICY_PRESETS for x in (row[0], float(row[which]))))
        named = F.when(F.col("policy_name") == "moderate", "normal").otherwise(F.col("policy_name"))
        return F.coalesce(F.try_element_at(found, named), F.lit(replace(config, strict=False).limits()[which - 1]))

    strict = F.coalesce("strict", F.lit(config.strict))
    limits = S.thresholds(F.coalesce("block_threshold", preset(1)), F.coalesce("warn_threshold", preset(2)), strict)
    own = held(own, "__limits", limits)
    given = {name: F.array(*map(F.lit, getattr(config, name))).cast("array<string>") for name in ("blocked_selectors", "unwrap_selectors", "blocked_tags", "allowed_tags")}
    rules = F.struct(*(F.coalesce(F.col(name), value).alias(name) for name, value in given.items()))
    return _documents(own, config, F.col("__limits.block"), F.col("__limits.warn"), rules, ("domain", "notes"))


def serialised(docs: DataFrame, config: Config = Config(), content: bool = True) -> DataFrame:
    """page_id and the document as JSON; its formats as the configuration asks, without the text if not ``content``.

    With a chunking the document has its chunks.
    """
    kept = docs
    if config.chunking != "none":
        kept = kept.withColumn("chunks", C.chunk_array(F.col("blocks"), config.chunking, config.chunk_size, config.chunk_overlap))
    names = [("markdown", F.lit(True)), ("blocks", F.lit(config.extract_blocks) & (F.size("blocks") > 0)), ("chunks", F.size("chunks") > 0 if config.chunking != "none" else F.lit(False))]
    names += [("metadata", F.lit("metadata" in docs.columns)), ("security", F.lit(True))]
    has = F.array_compact(F.array(*(F.when(there, F.lit(name)) for name, there in names)))
    kept = kept.withColumn("emitted_formats", O.emitted_formats(F.array(*[F.lit(x) for x in config.output_formats]), has))
    gone = [] if config.extract_blocks else ["blocks"]
    kept = kept.drop(*gone) if content else kept.drop("markdown", "blocks", "chunks")
    return kept.select("page_id", F.to_json(F.struct(*(c for c in kept.columns if c != "page_id"))).alias("document_json"))


def chunks(docs: DataFrame, config: Config) -> DataFrame:
    return C.chunks(docs.select("page_id", "blocks"), config.chunking, config.chunk_size, config.chunk_overlap)


def stats(docs: DataFrame) -> DataFrame:
    """Pages, successes and errors, by policy action."""
    return docs.groupBy("policy_action").agg(F.count("*").alias("pages"), F.count_if(F.col("error").isNull()).alias("successful"))


def summary(docs: DataFrame) -> DataFrame:
    return batch_summary(docs.select(F.col("error").isNull().alias("ok")))


blocks, links, metadata, security_report, compare_extractors = P.blocks, P.links, P.metadata, P.security_report, P.compare_extractors

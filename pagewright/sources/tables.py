"""Sources and sinks: URL lists, page files, policies, cache and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources.charsets import decoded

POLICY = (
    "priority int, domain string, include_subdomains boolean, mode string, policy_name string, strict boolean, block_threshold double, warn_threshold double, "
    "request_interval double, allowed_tags array<string>, blocked_tags array<string>, blocked_selectors array<string>, unwrap_selectors array<string>, notes string"
)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; blank lines and those that begin with # don't count."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')")


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """url (the file's own) and html of HTML files, in the charset that their bytes tell: see ``sources.charsets``."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.monotonically_increasing_id().alias("page_id"), F.col("path").alias("url"), decoded(F.col("content")).alias("html"))


def policies(spark: SparkSession, path: str) -> DataFrame:
    """Domain policies of a JSON file, an array or one object, of fixed columns.

    ``priority`` is a policy's place in the array, or what the file says. An array is one list of a user's own policies,
    so its file is read whole.
    """
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{POLICY}>>").alias("x"))
    each = whole.select(F.posexplode("x").alias("place", "p")).select("place", "p.*")
    return each.withColumn("priority", F.coalesce("priority", "place")).drop("place")


def write_markdown(docs: DataFrame, path: str) -> None:
    docs.where("error is null").select("page_id", "url", "markdown").write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_batch_json(docs: DataFrame, path: str) -> None:
    """A JSON line for each page, results and errors alike."""
    docs.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)

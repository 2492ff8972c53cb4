"""Policies by domain: the first in list order that matches a page's host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suffixes(host: F.Column) -> F.Column:
    """a.b.c gives a.b.c, b.c and c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def first_policy(pages: DataFrame, policies: DataFrame) -> DataFrame:
    """Every page (page_id, host) with its policy's columns, null if none matches; list order (priority) decides.

    A suffix match is an equi-join on the host's suffixes, so no page meets a policy that doesn't match. Pages that share
    a host share the result, so hosts are joined, not pages. Spark broadcasts the policies if their size in bytes allows.
    """
    hosts = pages.where("host is not null").select("host").distinct().select("host", F.posexplode(suffixes(F.col("host"))).alias("depth", "domain"))
    matched = hosts.join(policies, "domain").where("depth = 0 or include_subdomains")
    first = matched.groupBy("host").agg(F.min_by(F.struct(*policies.columns), "priority").alias("p")).select("host", "p.*")
    return pages.join(first, "host", "left")

"""spark-submit front: ingest, batch (with a summary), compare or report over a table of pages."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pagewright import api


def main() -> None:
    parser = argparse.ArgumentParser(prog="pagewright")
    parser.add_argument("verb", choices=["ingest", "batch", "compare", "report"])
    parser.add_argument("pages", help="Parquet table with page_id, url and html")
    parser.add_argument("output", help="folder for the result")
    parser.add_argument("--policy", default="normal")
    parser.add_argument("--strict", action="store_true")
    args = parser.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    pages = spark.read.parquet(args.pages).select("page_id", "url", "html")
    docs = api.ingest(pages, api.Config(policy=args.policy, strict=args.strict))
    result = {"compare": lambda: api.compare_extractors(pages), "report": lambda: api.security_report(docs)}.get(args.verb, lambda: docs)()
    result.write.mode("overwrite").parquet(args.output)
    if args.verb == "batch":
        api.summary(spark.read.parquet(args.output)).show(truncate=False)


if __name__ == "__main__":
    main()

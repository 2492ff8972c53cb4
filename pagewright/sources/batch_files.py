"""A sink of Markdown files, one for each document, with a summary: ``df.write.format("pagewright_batch")``; and its reader.

Each task writes into a folder of its own under ``_staging``, and a job's commit gives those of the tasks that Spark
counts, one rename each, their place; files of lost or repeated attempts go with ``_staging``. An abort leaves nothing of
the job. Options: ``path``, a folder that the executors and the driver share as a file system. Columns: n (long, the
document's number), markdown (null: empty), error (null: success). A success is ``doc_NNN.md``; failures are counted and
listed in their task's ``errors.jsonl``; ``summary.json`` has the totals.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from pagewright.functions.slices import SLICE_BYTES, SLICE_ROWS

STAGING = "_staging"
#: About as many files are one task's when they are read. Spark's own readers count a file as 4 MB, so 32 are a task.
FILES_OF_A_TASK = 4096
_FILE = re.compile(r"doc_(-?\d+)\.md")
_READ = pa.schema([("n", pa.int64()), ("markdown", pa.string())])


@dataclass
class Written(WriterCommitMessage):
    folder: str
    successful: int
    failed: int


class BatchFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagewright_batch"

    def schema(self) -> str:
        return "n long, markdown string"

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options["path"].removeprefix("file://"))

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        missing = {"n", "markdown", "error"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        made = BatchWriter(self.options["path"].removeprefix("file://"), overwrite)
        made.begin()
        return made


@dataclass
class Share(InputPartition):
    folder: str
    which: int
    of: int


class BatchReader(DataSourceReader):
    """Tasks list their folder themselves and take the files whose names fall to them; the driver only counts."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Share]:
        out = []
        for folder in sorted(f.path for f in os.scandir(self.path) if f.name.startswith("part-")):
            shares = -(-sum(1 for _ in os.scandir(folder)) // FILES_OF_A_TASK)
            out += [Share(folder, i, shares) for i in range(shares)]
        return out

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str]] = []
        size = 0
        for file in os.scandir(partition.folder) if partition else ():
            found = _FILE.fullmatch(file.name)
            if not found or zlib.crc32(file.name.encode()) % partition.of != partition.which:
                continue
            with open(file.path, encoding="utf-8", errors="replace", newline="") as f:
                rows.append((int(found[1]), f.read()))
            size += len(rows[-1][1])
            if len(rows) == SLICE_ROWS or size >= SLICE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), _READ.types, strict=True)], schema=_READ)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), _READ.types, strict=True)], schema=_READ)


class BatchWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def begin(self) -> None:
        """Make the job's folder, on the driver: a task that outlives an abort finds none, and makes none."""
        os.makedirs(os.path.join(self.path, STAGING, self.job))

    def write(self, iterator: Iterator[Row]) -> Written:
        folder = uuid.uuid4().hex
        here = os.path.join(self.path, STAGING, self.job, folder)
        os.mkdir(here)
        counts = [0, 0]
        with open(os.path.join(here, "errors.jsonl"), "w", encoding="utf-8") as errors:
            for row in iterator:
                failed = row["error"] is not None
                counts[failed] += 1
                if failed:
                    errors.write(json.dumps({"n": row["n"], "error": row["error"]}) + "\n")
                    continue
                with open(os.path.join(here, f"doc_{row['n']:03d}.md"), "w", encoding="utf-8", newline="") as f:
                    f.write(row["markdown"] or "")
        return Written(folder, *counts)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        if self.overwrite:
            for name in os.listdir(self.path) if os.path.isdir(self.path) else ():
                if name.startswith("part-"):
                    shutil.rmtree(os.path.join(self.path, name))
        for i, m in enumerate(done):
            os.replace(os.path.join(self.path, STAGING, self.job, m.folder), os.path.join(self.path, f"part-{i:05d}-{self.job}"))
        totals = {"successful": sum(m.successful for m in done), "failed": sum(m.failed for m in done)}
        with open(os.path.join(self.path, f"{STAGING}.json"), "w", encoding="utf-8") as f:
            json.dump({"total": sum(totals.values()), **totals}, f)
        os.replace(f.name, os.path.join(self.path, "summary.json"))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        mine = os.path.join(self.path, STAGING, self.job)
        for _ in range(100):  # a task that is still writing may put a file where one was removed
            shutil.rmtree(mine, ignore_errors=True)
            if not os.path.exists(mine):
                break
            time.sleep(0.05)
        for folder in (os.path.join(self.path, STAGING), self.path):
            try:
                os.rmdir(folder)
            except OSError:  # another job's, or not empty
                break


def write_documents(docs: DataFrame, path: str, number: str = "page_id") -> None:
    """Documents as files: the sink of this module over page number, Markdown and error."""
    docs.sparkSession.dataSource.register(BatchFiles)
    docs.select(F.col(number).cast("long").alias("n"), "markdown", "error").write.format("pagewright_batch").option("path", path).mode("append").save()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(n, markdown) of the files that ``write_documents`` wrote."""
    spark.dataSource.register(BatchFiles)
    return spark.read.format("pagewright_batch").option("path", path).load()

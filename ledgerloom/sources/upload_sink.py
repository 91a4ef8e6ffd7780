"""A table of uploads that is written by tasks and committed by the driver.

Every task writes its rows to one file of a new name and reports it; only when all tasks have, the driver names their files in one
manifest. What no manifest names doesn't exist for a reader: neither the files of a task that failed, which removes its own, nor
those of a lost executor, nor those of a job that failed, which ``abort`` removes. A repeated task hence leaves no duplicate.
Paths are those of Spark's cluster (file, hdfs, s3); tasks and driver reach them through Arrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ledgerloom.sources.byte_ranges import place

NAME = "ledgerloom_uploads"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written; no file if it had no row."""

    file: str | None
    rows: int


class UploadWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = place(self.path)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if out is None:
                    system.create_dir(f"{root}/data", recursive=True)
                    out = pq.ParquetWriter(system.open_output_stream(f"{root}/data/{name}"), batch.schema, compression="zstd")
                out.write_batch(batch)
                rows += batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
                system.delete_file(f"{root}/data/{name}")
            raise
        if out is not None:
            out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = place(self.path)
        system.create_dir(f"{root}/commits", recursive=True)
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{root}/commits/_{name}") as out:
            for m in messages:
                if m is not None and m.file:
                    out.write((json.dumps({"file": m.file, "rows": m.rows}) + "\n").encode())
        system.move(f"{root}/commits/_{name}", f"{root}/commits/{name}.json")  # readers pass over names that begin with _

    def abort(self, messages: list[Written | None]) -> None:
        system, root = place(self.path)
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{root}/data/{m.file}")


class UploadSink(DataSource):
    """``df.write.format("ledgerloom_uploads").mode("append").save(path)``, after ``register``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> UploadWriter:
        if overwrite:
            raise ValueError("a table of uploads is only appended to")
        return UploadWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UploadSink)


def write_uploads(rows: DataFrame, path: str) -> None:
    register(rows.sparkSession)
    rows.write.format(NAME).mode("append").save(path)


def read_uploads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed files."""
    committed = spark.read.schema("file string, rows bigint").json(f"{path}/commits").select("file").distinct()
    rows = spark.read.schema(schema).parquet(f"{path}/data").select("*", F.col("_metadata.file_name").alias("file_"))
    return rows.join(committed, F.col("file_") == F.col("file"), "left_semi").drop("file_")

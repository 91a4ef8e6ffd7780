"""Containers of any size, read in byte ranges by several tasks.

A line belongs to the range in which it begins. Ranges have a fixed length, so a file is cut alike however often and wherever it is
read. A task reads one range, or several small ones if there are more than TASKS, up to RANGE_BYTES. A line's number is its number within the range plus what the ranges before hold, and a range inherits the last section marker of
those before it. Both are sums over one row a range. The digest of a body goes through its lines in order with one state, in constant
memory; it is the one thing that a single task does for a file. Paths are reached through Arrow's file systems, on the driver for sizes
only.
"""

from __future__ import annotations

import hashlib
import io
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME, RANGE_BYTES, BATCH_LINES = "ledgerloom_ranges", 32 << 20, 4096
#: Ranges beyond so many share tasks.
TASKS = 256
SCHEMA = "path string, part bigint, row bigint, line string, section string"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Range:
    path: str
    part: int
    low: int
    high: int


class Ranges(InputPartition):
    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


class RangeReader(DataSourceReader):
    def __init__(self, root: str, length: int):
        self.root, self.length = root, length

    def partitions(self) -> list[Ranges]:
        system, top = place(self.root)
        info = system.get_file_info(top)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top, recursive=True))
        plain = [f for f in files if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", "."))]
        ranges = [Range(f.path, k, low, min(f.size, low + self.length)) for f in sorted(plain, key=lambda f: f.path) for k, low in enumerate(range(0, f.size, self.length))]
        n = max(1, min(RANGE_BYTES // self.length, -(-len(ranges) // TASKS)))
        return [Ranges(ranges[i : i + n]) for i in range(0, len(ranges), n)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        """The lines that begin in each range, each with the last marker above it in its range; a file is opened once."""
        system, _ = place(self.root)
        rows: list[tuple] = []
        for path, ranges in itertools.groupby(partition.ranges, key=lambda r: r.path):
            with io.BufferedReader(system.open_input_file(path), 1 << 20) as file:
                for own in ranges:
                    for row in self.lines(file, own):
                        rows.append(row)
                        if len(rows) >= BATCH_LINES:
                            yield self.batch(rows)
                            rows = []
        if rows:
            yield self.batch(rows)

    def lines(self, file: io.BufferedReader, own: Range) -> Iterator[tuple]:
        at = own.low
        file.seek(max(0, at - 1))
        if at:  # a line begins after a line's end
            at += len(file.readline()) - 1
        row, section = 0, None
        while at < own.high and (raw := file.readline()):
            at += len(raw)
            line = (raw[:-1] if raw.endswith(b"\n") else raw).decode("utf-8", "replace")
            if line.startswith("@"):
                section = line[1:].strip()
            yield own.path, own.part, row, line, section
            row += 1

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "part", "row", "line", "section"])


class RangeSource(DataSource):
    """``spark.read.format("ledgerloom_ranges").option("rangeBytes", n).load(path)``, after ``register``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RangeSource)


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, pos, line, section) of the lines of a file or of all files of a folder: their number, and the section of the last marker at or above them."""
    register(spark)
    raw = spark.read.format(NAME).option("rangeBytes", range_bytes).load(path)
    held = raw.groupBy("path", "part").agg(F.count("*").alias("n"), F.max_by("section", "row").alias("last"))
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = held.select("path", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.last("last", ignorenulls=True).over(before).alias("above"))
    return raw.join(starts, ["path", "part"]).select("path", (F.col("start") + F.col("row")).alias("pos"), "line", F.coalesce("section", "above").alias("section"))


def body(lines: DataFrame) -> DataFrame:
    """The lines behind magic line and header."""
    return lines.filter("pos >= 2")


def records(lines: DataFrame) -> DataFrame:
    """(path, pos, section, record): the body without markers and blank lines."""
    return body(lines).filter(~F.startswith("line", F.lit("@")) & (F.trim("line") != "")).select("path", "pos", "section", F.col("line").alias("record"))


OVERVIEW = "path string, magic string, head string, n_lines bigint, digest string"


def _read_through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a file from its lines in order; only the batch at hand is held."""
    names, one, state = [c.split()[0] for c in OVERVIEW.split(", ")], None, None
    for batch in batches:
        done = []
        for path, line in zip(batch["path"], batch["line"], strict=True):
            if one is None or path != one[0]:
                if one is not None:
                    done.append((*one, state.hexdigest()))
                one, state = [path, None, None, 0], hashlib.sha256()
            if one[3] < 2:
                one[1 + one[3]] = line
            else:
                state.update(("\n" + line if one[3] > 2 else line).encode())
            one[3] += 1
        yield pd.DataFrame(done, columns=names).astype({"n_lines": "int64"})
    if one is not None:
        yield pd.DataFrame([(*one, state.hexdigest())], columns=names)


def overview(lines: DataFrame) -> DataFrame:
    """(path, magic, head, n_lines, digest): the first two lines of each file, the number of all, and the sha256 of the body's, markers and blank ones included."""
    ordered = lines.select("path", "pos", "line").repartition("path").sortWithinPartitions("path", "pos")
    return ordered.select("path", "line").mapInPandas(_read_through, OVERVIEW)


def checksums(lines: DataFrame) -> DataFrame:
    """(path, digest): of an empty body that of the empty text."""
    return overview(lines).select("path", "digest")

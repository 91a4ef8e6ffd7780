"""A table of the latest row of each key, kept in buckets by the key's hash and named by manifests.

A batch rewrites only the buckets that its keys fall into, in a folder of its own; a manifest then names the folder of every bucket, and
the highest manifest is the table. The merge takes the later row whatever came first, so a batch that runs twice, an old batch that
comes late, and a stream that begins anew with another checkpoint all leave the right rows. A batch that dies before its manifest
leaves a folder that no one reads; ``clean`` removes it, and the folders that only older manifests name. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.usage import latest
from ledgerloom.sources.byte_ranges import place

BUCKET = "bucket_"


class UsageTable:
    def __init__(self, path: str, key: str, *order: str, buckets: int = 64):
        self.path, self.key, self.order, self.buckets = path, key, order, buckets
        self.system, self.root = place(path)

    def manifests(self) -> list[int]:
        """The versions there are, oldest first."""
        info = self.system.get_file_info(fs.FileSelector(f"{self.root}/manifests", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in info if f.base_name.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Version, number of buckets, and the folder of each bucket that has rows."""
        versions = self.manifests()
        if not versions:
            return {"version": -1, "buckets": self.buckets, "folders": {}}
        with self.system.open_input_stream(f"{self.root}/manifests/{versions[-1] if version is None else version}.json") as file:
            return json.loads(file.read())

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def read(self, spark: SparkSession, schema: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of the table, or of some buckets."""
        folders = self.manifest(version)["folders"]
        chosen = [folder for b, folder in folders.items() if only is None or int(b) in only]
        if not chosen:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*(f"{self.path}/data/{folder}" for folder in sorted(chosen)))

    def merge(self, rows: DataFrame) -> int:
        """Merge a batch and give the version that holds it; an empty batch changes nothing."""
        spark, now = rows.sparkSession, self.manifest()
        rows = rows.withColumn(BUCKET, self.bucket(now["buckets"]))
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # as many as buckets at most
        if not touched:
            return now["version"]
        own = [c for c in rows.columns if c != BUCKET]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema.fields)
        old = self.read(spark, schema, only=touched).withColumn(BUCKET, self.bucket(now["buckets"]))
        folder = uuid.uuid4().hex
        latest(old.unionByName(rows), self.key, *self.order).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
        folders = now["folders"] | {str(b): f"{folder}/{BUCKET}={b}" for b in touched}
        version = now["version"] + 1
        self.system.create_dir(f"{self.root}/manifests", recursive=True)
        with self.system.open_output_stream(f"{self.root}/manifests/_{folder}") as out:
            out.write(json.dumps({"version": version, "buckets": now["buckets"], "folders": folders}).encode())
        self.system.move(f"{self.root}/manifests/_{folder}", f"{self.root}/manifests/{version}.json")
        return version

    def clean(self, keep: int = 2) -> None:
        """Remove what only versions before the last ``keep`` name, and what none does."""
        versions = self.manifests()
        needed = {folder for v in versions[-keep:] for folder in self.manifest(v)["folders"].values()}
        for v in versions[:-keep]:
            self.system.delete_file(f"{self.root}/manifests/{v}.json")
        for top in self.system.get_file_info(fs.FileSelector(f"{self.root}/data", allow_not_found=True)):
            kept = {folder.partition("/")[2] for folder in needed if folder.startswith(f"{top.base_name}/")}
            if not kept:
                self.system.delete_dir(top.path)
                continue
            for part in self.system.get_file_info(fs.FileSelector(top.path)):
                if part.type == fs.FileType.Directory and part.base_name not in kept:
                    self.system.delete_dir(part.path)


def usage_sink(path: str, key: str, *order: str, buckets: int = 64, keep: int = 2):
    """A function for ``foreachBatch`` that merges each batch into the table at ``path``."""
    table = UsageTable(path, key, *order, buckets=buckets)

    def merge(rows: DataFrame, batch: int) -> None:
        table.merge(rows)
        table.clean(keep)

    return merge

"""A folder of queued items as a stream.

The source remembers how far it has read by time of change and name, so files that arrive between batches come next, and a state
that is written anew comes again. The driver lists names and times; contents are read by tasks, FILES a task. Files changed within the
last ``settle`` seconds wait, as others of the same instant may still appear beside them.
"""

from __future__ import annotations

import datetime
import json
import time
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor

from ledgerloom.sources.byte_ranges import place

NAME, SCHEMA, FILES = "ledgerloom_queue", "name string, content string, modified timestamp", 500
# Names in the folder of a queue, and the time of an item that was never tried.
STATE_SUFFIX, CONFIG, NEVER = ".state.json", "config.json", "1970-01-01T00:00:00.000Z"
LISTED = "name string, attempts int, next_attempt_at string, last_error string"
#: Keys of the listing's state; how often a bucket is looked through in the time that items are kept, at most.
BUCKETS, CLEANINGS = 1024, 16


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class QueueReader(DataSourceStreamReader):
    def __init__(self, root: str, settle: float):
        self.root, self.settle = root, settle

    def listed(self, after: dict, until: dict | None = None) -> list[tuple[int, str, str]]:
        """(time, name, path) of JSON files behind an offset, in order."""
        system, top = place(self.root)
        found = sorted((f.mtime_ns, f.base_name, f.path) for f in system.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.type == fs.FileType.File and f.base_name.endswith(".json") and f.base_name != CONFIG)
        low, high = (after["ns"], after["name"]), (until["ns"], until["name"]) if until else (time.time_ns() - int(self.settle * 1e9), "")
        return [f for f in found if low < f[:2] <= high]

    def initialOffset(self) -> dict:
        self.at = {"ns": 0, "name": ""}
        return self.at

    def latestOffset(self) -> dict:
        known = getattr(self, "at", {"ns": 0, "name": ""})
        files = self.listed(known)
        if files:
            self.at = {"ns": files[-1][0], "name": files[-1][1]}
            self.seen = known, self.at, files
        return getattr(self, "at", known)

    def partitions(self, start: dict, end: dict) -> list[Files]:
        """What lies between two offsets, as it was listed last or, after a restart, listed anew."""
        self.at = max(end, getattr(self, "at", end), key=lambda o: (o["ns"], o["name"]))
        *ends, found = getattr(self, "seen", (None, None, None))
        self.seen = None, None, None
        files = [(path, ns) for ns, _, path in (found if ends == [start, end] else self.listed(start, end))]
        return [Files(files[i : i + FILES]) for i in range(0, len(files), FILES)]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = place(self.root)
        for path, ns in partition.files:
            try:
                with system.open_input_stream(path) as file:
                    content = file.read().decode("utf-8", "replace")
            except FileNotFoundError:  # delivered meanwhile
                continue
            yield path.rpartition("/")[2], content, datetime.datetime.fromtimestamp(ns / 1e9, datetime.UTC)

    def commit(self, end: dict) -> None:
        pass


class QueueFiles(DataSource):
    """``spark.readStream.format("ledgerloom_queue").option("settle", seconds).load(path)``, after ``register``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> QueueReader:
        return QueueReader(self.options["path"], float(self.options.get("settle", 1)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(QueueFiles)


def read_queue_stream(spark: SparkSession, path: str, settle: float = 1) -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).option("settle", settle).load(path)


def state_of(content: str) -> tuple[int, str, str | None]:
    """Attempts, next attempt and last error of a state's text; what is missing or of another type counts as never tried."""
    try:
        state = json.loads(content)
    except ValueError:
        state = None
    state = state if isinstance(state, dict) else {}
    attempts, following, error = (state.get(k) for k in ("attempts", "next_attempt_at", "last_error"))
    number = isinstance(attempts, int | float) and not isinstance(attempts, bool)
    return int(attempts) if number else 0, following if isinstance(following, str) else NEVER, error if isinstance(error, str) else None


def listed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in LISTED.split(", ")], dtype=object).astype({"attempts": "int32"})


class Listing(StatefulProcessor):
    """An item and its latest state, whichever comes first; forgotten ``keep`` after its last change.

    A key is a bucket of items, so that a batch costs a call for each bucket and two short ones for each changed item. A bucket has one
    timer, which removes what is forgotten, at most CLEANINGS times in ``keep``; an item that is due counts as forgotten until then.
    """

    def __init__(self, keep: int):
        self.keep = 1000 * keep

    def init(self, handle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item string", "there boolean, state_ms bigint, last_ms bigint, attempts int, following string, error string")
        self.cleaning = handle.getValueState("cleaning", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        forgotten, found = timerValues.getCurrentWatermarkInMs() - self.keep, {}
        for batch in rows:
            for item, name, content, ms in zip(batch["item"], batch["name"], batch["content"], batch["ms"].tolist(), strict=True):
                if item not in found:
                    known = self.items.getValue((item,))
                    found[item] = [False, -1, -1, 0, NEVER, None] if known is None or known[2] <= forgotten else list(known)
                one = found[item]
                one[2] = max(ms, one[2])
                if not name.endswith(STATE_SUFFIX):
                    one[0] = True
                elif ms >= one[1]:
                    one[1], one[3:] = ms, state_of(content)
        for item, one in found.items():
            self.items.updateValue((item,), tuple(one))
        if found and not self.cleaning.exists():
            self.clean_at(min(one[2] for one in found.values()) + self.keep)
        yield listed([(item, *one[3:]) for item, one in found.items() if one[0]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last = {item: one[2] for item, one in self.items.iterator()}
        for item, ms in last.items():
            if ms + self.keep <= now:
                self.items.removeKey(item)
        self.cleaning.clear()
        if left := [ms for ms in last.values() if ms + self.keep > now]:
            self.clean_at(max(min(left) + self.keep, now + self.keep // CLEANINGS))
        yield listed([])

    def clean_at(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.cleaning.update((ms,))

    def close(self) -> None:
        pass


def listing(files: DataFrame, keep: int = 7 * 86_400, late: str = "1 hour") -> DataFrame:
    """A stream of ``read_queue_stream`` as the stream of items with their states (LISTED), a row whenever either changes. Needs ``outbox.use_timers``."""
    item = F.when(F.endswith("name", F.lit(STATE_SUFFIX)), F.expr(f"substring(name, 1, length(name) - {len(STATE_SUFFIX)})")).otherwise(F.col("name"))
    timed = files.withWatermark("modified", late).select(F.pmod(F.xxhash64(item), F.lit(BUCKETS)).alias("bucket"), item.alias("item"), "name", "content", F.unix_millis("modified").alias("ms"), "modified")
    return timed.groupBy("bucket").transformWithStateInPandas(Listing(keep), LISTED, "Update", "EventTime")

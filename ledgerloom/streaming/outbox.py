"""The outbox as a stream: items wait in keyed state, timers wake their queue when a backoff ends.

Every queue is a key. Its waiting items live in the state store, in blocks of BLOCK, so that a call to the store moves many and
a run writes only the blocks it changes; long contents lie apart. One timer stands for the next moment at which any of
them may be sent; nothing has to arrive for a retry. A run sends up to ``limit`` due items in the order of their names and
leaves the rest to a run ``pause`` later; items that can't be read go to quarantine and use nothing up. Ended items are
remembered for ``keep``, so that an item that arrives again meanwhile isn't sent again. The clock is the wall clock or,
with ``event_time``, the watermark: then all runs that a new watermark makes due happen in their own order at their own
times, and the result doesn't depend on how the input was cut into batches.

``deliver`` is called inside tasks, at least once a try, as a lost executor repeats its batch; receivers know an item by its
id. A queue that holds a great part of all items can be dealt over ``lanes``, each with a limit of its own.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ledgerloom.functions.scalars import BACKOFF_BASE, BACKOFF_CAP, MOST_ATTEMPTS
from ledgerloom.operators.outbox import MOST_ERROR, SENDS
from ledgerloom.streaming.delivery import step

Deliver = Callable[[str, str, int], tuple[int, str | None]]
OUTPUT = "queue string, lane int, name string, outcome string, attempts int, next_attempt_at timestamp, last_status int, last_error string, at timestamp, content string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
#: Items of a block of state; characters of a content that is held with its item.
BLOCK, HELD_CONTENT = 256, 1024


def readable(content: str | None) -> bool:
    try:
        json.loads(content or "")
    except ValueError:
        return False
    return True


def written(items: dict) -> str:
    return json.dumps(items, ensure_ascii=False, separators=(",", ":"))


def frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of OUTPUT; times are milliseconds."""
    made = dict(zip(_COLUMNS, zip(*rows, strict=True) if rows else [()] * len(_COLUMNS), strict=True))
    for c in ("next_attempt_at", "at"):
        made[c] = np.array(["NaT" if ms is None else ms for ms in made[c]], "datetime64[ms]")
    made |= {c: np.array(made[c], "int32") for c in ("lane", "attempts")} | {"last_status": pd.array(made["last_status"], "Int32")}
    return pd.DataFrame({c: v if not isinstance(v, tuple) else pd.Series(v, dtype=object) for c, v in made.items()})


class Outbox(StatefulProcessor):
    """``deliver`` takes (name, content, attempts so far) and gives (status, error); what it raises counts as status 0."""

    def __init__(self, deliver: Deliver, limit: int, most: int, pause: int, keep: int, base: int, cap: int, event_time: bool):
        self.deliver, self.limit, self.most, self.base, self.cap, self.event_time = deliver, limit, most, base, cap, event_time
        self.pause, self.keep = 1000 * pause, 1000 * keep

    def init(self, handle) -> None:
        self.handle = handle
        #: Items in blocks, each a JSON object of name: [attempts, next_ms, status, error, content], or False for a content that lies apart.
        self.blocks = handle.getMapState("blocks", "block int", "items string")
        #: Contents too long to be held with all other items of a queue.
        self.contents = handle.getMapState("contents", "name string", "content string")
        #: Blocks of ended items, each a JSON object of name: ms.
        self.ended = handle.getListState("ended", "items string", None if self.event_time else self.keep)
        self.last = handle.getValueState("last", "ms bigint")

    def held(self) -> dict[int, dict[str, list]]:
        return {block: json.loads(items) for (block,), (items,) in self.blocks.iterator()}

    def known(self) -> dict[str, int]:
        """The ended items that are remembered."""
        return {name: ms for (items,) in self.ended.get() for name, ms in json.loads(items).items()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held()
        names, new, first = {name for items in held.values() for name in items}.union(self.known()), {}, None
        for batch in rows:
            for name, content, ms in zip(batch["name"], batch["content"], batch["ms"].tolist(), strict=True):
                if name in names:
                    continue
                names.add(name)
                long = content is not None and len(content) > HELD_CONTENT
                if long:
                    self.contents.updateValue((name,), (content,))
                new[name] = [0, ms, None, None, False if long else content]
                first = ms if first is None else min(ms, first)
        self.deal(held, new)
        if not self.event_time:
            yield self.run(key, timerValues.getCurrentProcessingTimeInMs(), held)
        elif first is not None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))

    def deal(self, held: dict[int, dict[str, list]], new: dict[str, list]) -> None:
        """New items go to blocks with room, then to further ones."""
        left, block = iter(new.items()), 0
        rest = len(new)
        while rest:
            items = held.get(block, {})
            if room := min(rest, BLOCK - len(items)):
                items.update(itertools.islice(left, room))
                held[block] = items
                self.blocks.updateValue((block,), (written(items),))
                rest -= room
            block += 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.run(key, timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs(), self.held())

    def run(self, key, clock: int, held: dict[int, dict[str, list]]) -> pd.DataFrame:
        """All runs up to ``clock``; by the wall clock that is one, now."""
        later = [(state[1], name, block) for block, items in held.items() for name, state in items.items()]
        heapq.heapify(later)
        last = before = self.last.get()[0] if self.last.exists() else None
        due: list[tuple] = []
        rows: list[tuple] = []
        changed: set[int] = set()
        ended: dict[str, int] = {}
        while due or later:
            at = later[0][0] if not due else last
            if last is not None:
                at = max(at, last + self.pause)
            if at > clock:
                self.handle.registerTimer(at)
                break
            if not self.event_time:
                at = clock
            while later and later[0][0] <= at:
                _, name, block = heapq.heappop(later)
                heapq.heappush(due, (name, block))
            sent, last = 0, at
            while due and sent < self.limit:
                name, block = heapq.heappop(due)
                changed.add(block)
                sent += self.attempt(key, name, block, held[block], at, rows, later, ended)
        if last != before:
            self.last.update((last,))
        for block in changed:
            if held[block]:
                self.blocks.updateValue((block,), (written(held[block]),))
            else:
                self.blocks.removeKey((block,))
        self.remember(ended, clock)
        return frame(rows)

    def remember(self, ended: dict[str, int], clock: int) -> None:
        """Ended items are kept as they come; with event time, old ones go here, else by their time to live."""
        if self.event_time:
            known = self.known()
            kept = {name: ms for name, ms in (known | ended).items() if ms + self.keep >= clock}
            if kept != known:
                self.ended.put([(written(kept),)]) if kept else self.ended.clear()
        elif ended:
            self.ended.appendList([(written(ended),)])

    def attempt(self, key, name: str, block: int, items: dict[str, list], at: int, rows: list[tuple], later: list[tuple], ended: dict[str, int]) -> bool:
        """One item's turn: its row, its next state, and whether it was sent."""
        attempts, _, status, _, content = items[name]
        long, next_ms = content is False, None
        if long:
            content = self.contents.getValue((name,))[0]
        sent = readable(content)
        if sent:
            try:
                status, error = self.deliver(name, content, attempts)
            except Exception as failure:  # a try never ends the stream
                status, error = 0, str(failure)
            attempts, outcome, wait = step(attempts, status, self.most, self.base, self.cap)
            next_ms = None if wait is None else at + 1000 * wait
        else:
            outcome, error = "quarantined", "unreadable item"
        error = None if error is None or outcome == "delivered" else error[:MOST_ERROR]
        if next_ms is None:
            del items[name]
            if long:
                self.contents.removeKey((name,))
            ended[name] = at
        else:
            items[name] = [attempts, next_ms, status, error, False if long else content]
            heapq.heappush(later, (next_ms, name, block))
        rows.append((*key, name, outcome, attempts, next_ms, status, error, at, content if outcome == "quarantined" else None))
        return sent

    def close(self) -> None:
        pass


def outbox(
    items: DataFrame, deliver: Deliver, limit: int = SENDS, most: int = MOST_ATTEMPTS, pause: int = 30, keep: int = 86_400,
    base: int = BACKOFF_BASE, cap: int = BACKOFF_CAP, lanes: int = 1, event_time: bool = False,
) -> DataFrame:
    """A stream (queue, name, content, arrived) as the stream of what becomes of its items: one row a try. ``pause``, ``keep``, ``base`` and ``cap`` are seconds.

    With ``event_time`` the stream needs a watermark on ``arrived``. Needs the state store that ``use_timers`` sets.
    """
    lane = F.pmod(F.xxhash64("name"), F.lit(lanes)).cast("int")
    keyed = items.select(F.col("queue").cast("string").alias("queue"), lane.alias("lane"), "name", "content", F.unix_millis(F.col("arrived")).alias("ms"), "arrived")
    processor = Outbox(deliver, limit, most, pause, keep, base, cap, event_time)
    return keyed.groupBy("queue", "lane").transformWithStateInPandas(processor, OUTPUT, "Update", "EventTime" if event_time else "ProcessingTime")


def use_timers(spark) -> None:
    """Keyed state with timers needs this store; set before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

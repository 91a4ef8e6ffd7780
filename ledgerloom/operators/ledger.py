"""The effective view of a ledger: retired nodes go, the narrowest scope wins each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.scalars import scope_rank
from ledgerloom.operators.blocks import ordered_blocks
from ledgerloom.vocab import OPERATIONS, RETIRING_OPERATIONS


class UnknownOperationError(ValueError):
    """A patch has an operation that nobody has classed as retiring or not."""


def guard_operations(patches: DataFrame) -> None:
    """Fail before any node is looked at. An action, as a column that raises could be optimised away."""
    unknown = patches.filter(F.col("operation").isNull() | ~F.col("operation").isin(*OPERATIONS)).select("id", "operation").take(1)
    if unknown:
        raise UnknownOperationError(f"patch {unknown[0].id}: unknown operation {unknown[0].operation}")


def retired_ids(patches: DataFrame) -> DataFrame:
    return patches.filter(F.col("operation").isin(*RETIRING_OPERATIONS)).select(F.explode("target_ids").alias("id")).distinct()


def candidates(nodes: DataFrame, patches: DataFrame, session_id: Column | str | None = None) -> DataFrame:
    """Active nodes and this session's own that no patch has retired."""
    own, asked = F.lit(False), _asked(session_id)
    if session_id is not None:
        own = (F.col("status") == "active_session") & (asked != "") & F.coalesce(F.col("scope.session") == asked, F.lit(False))
    live = nodes.filter((F.col("status") == "active") | own)
    return live.join(retired_ids(patches), "id", "left_anti")


def _asked(session_id: Column | str | None) -> Column:
    return session_id if isinstance(session_id, Column) else F.lit(session_id).cast("string")


def rank(session_id: Column | str | None = None) -> Column:
    """A node's rank in the view of a session."""
    return scope_rank(F.col("status"), F.col("scope.session"), F.col("scope.project"), F.col("scope.workspace"), _asked(session_id))


def scope_precedence(live: DataFrame, session_id: Column | str | None = None) -> DataFrame:
    """One node for each key: the highest rank, then the latest ``updated_at`` as text, then the first by ``ord``; nodes without a key all stay.

    Nodes without a key are no group: they bypass the ranking.
    """
    keyed, free = live.filter("key <> ''"), live.filter("coalesce(key, '') = ''")
    best = Window.partitionBy("key").orderBy(rank(session_id).desc(), F.coalesce("updated_at", F.lit("")).desc(), "ord")
    return free.unionByName(keyed.withColumn("rn_", F.row_number().over(best)).filter("rn_ = 1").drop("rn_"))


def effective_view(nodes: DataFrame, patches: DataFrame, session_id: Column | str | None = None, guard: bool = True) -> DataFrame:
    """The nodes in force. ``nodes`` has id, key, status, updated_at, scope and ord, the order of loading."""
    if guard:
        guard_operations(patches)
    return scope_precedence(candidates(nodes, patches, session_id), session_id)


def effective_order(nodes: DataFrame, patches: DataFrame, session_id: Column | str | None = None, guard: bool = True) -> DataFrame:
    """The view with ``place``: nodes without a key first as loaded, then winners where their key was first seen."""
    if guard:
        guard_operations(patches)
    live = candidates(nodes, patches, session_id)
    seen = live.filter("key <> ''").groupBy(F.col("key").alias("key_")).agg(F.min("ord").alias("first_"))
    return scope_precedence(live, session_id).join(seen, F.col("key") == F.col("key_"), "left").withColumn("place", F.struct(F.col("key_").isNotNull().alias("keyed"), F.coalesce("first_", "ord").alias("at"))).drop("key_", "first_")


def source_labels(view: DataFrame, group: str = "ledger", order: str = "place") -> DataFrame:
    """(ledger, labels): distinct source labels, the first of the view's order first."""
    one = view.filter(F.coalesce("label", F.lit("")) != "").groupBy(group, "label").agg(F.min(order).alias("at"))
    return one.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("labels"))


def summary(view: DataFrame, group: str = "ledger", nodes: int = 5, chars: int = 480, order: str = "place") -> DataFrame:
    """(ledger, summary): the contents of the view's first nodes, trimmed, blank ones left out, joined and cut."""
    top = view.withColumn("n_", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("n_") <= nodes)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n_", F.coalesce("content", F.lit("")).alias("content")))), lambda x: F.trim(x["content"]))
    text = F.array_join(F.filter(parts, lambda x: x != ""), " / ")
    return top.groupBy(group).agg(text.alias("t_")).select(group, F.when(F.length("t_") > chars, F.concat(F.substring("t_", 1, chars - 1), F.lit("…"))).otherwise(F.col("t_")).alias("summary"))


def id_blocks(rows: DataFrame, group: str, order: str, size: int = 10_000) -> DataFrame:
    """(group, block, items): the ids of a group in order, in arrays of at most ``size``; no task holds a group."""
    return ordered_blocks(rows, group, (order,), "id", size)


def container_envelope(view: DataFrame, patches: DataFrame, group: str = "ledger", order: str = "place") -> DataFrame:
    """One row a ledger: its effective nodes' ids in the view's order, all its patches' ids as loaded (``ord``), labels, summary and counts.

    The lists of ids are made of ``id_blocks``: what a task holds beside one block is the row that it gives.
    """

    def whole(rows: DataFrame, by: str, ids: str, n: str) -> DataFrame:
        blocks = F.transform(F.array_sort(F.collect_list(F.struct("block", "items"))), lambda x: x["items"])
        return id_blocks(rows, group, by).groupBy(group).agg(F.flatten(blocks).alias(ids)).withColumn(n, F.size(ids).cast("bigint"))

    ids, own = whole(view, order, "node_ids", "n_nodes"), whole(patches, "ord", "patch_ids", "n_patches")
    return ids.join(own, group, "left").join(source_labels(view, group, order), group, "left").join(summary(view, group, order=order), group, "left")


def with_container(envelopes: DataFrame, containers: DataFrame, checksum: Column, overrides: dict[str, Column] | None = None, group: str = "ledger") -> DataFrame:
    """Envelopes with their container's verbatim text and its recorded checksum; overrides come last."""
    kept = containers.select(group, F.col("content").alias("container_text"), checksum.alias("container_checksum"))
    return envelopes.join(kept, group, "left").withColumns(overrides or {})

"""Rules for the records of a ledger, and for what they refer to.

Each function gives problems, one row each: the record's own ``id`` (and ``ledger`` and ``ord`` where the records have them), the
``rule`` broken, its ``place`` within the record, and the ``problem`` as text. ``all_problems`` puts those of all kinds of records in
the order of reading: kinds, records, rules, places. References are checked by anti-joins that keep their places, within a ledger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.operators.blocks import ordered_blocks

OWN = ("ledger", "ord", "id")
#: References come behind all rules of a record.
REFERENCES = 1000


def _said(kind: str, template: str, **parts: Column | str) -> Column:
    """A problem's text: the kind and id of its record, and the template with its parts, where a missing one is ``undefined``."""
    pieces: list[Column] = [F.lit(f"{kind} "), F.coalesce("id", F.lit("undefined")), F.lit(": ")]
    while template:
        plain, _, rest = template.partition("{")
        name, _, template = rest.partition("}")
        pieces.append(F.lit(plain))
        if name:
            part = parts[name]
            pieces.append(F.lit(part) if isinstance(part, str) else F.coalesce(part.cast("string"), F.lit("undefined")))
    return F.concat(*pieces)


def _own(rows: DataFrame) -> list[str]:
    return [c for c in OWN if c in rows.columns]


def _problems(kind: str, rows: DataFrame, rules: Sequence[tuple[Column, Column]]) -> DataFrame:
    said = F.array(*(F.when(F.coalesce(broken, F.lit(False)), text) for broken, text in rules))
    return rows.select(*_own(rows), F.posexplode(said).alias("rule", "problem"), F.array(F.lit(0)).alias("place")).filter("problem is not null")


def _missing(kind: str, fields: Sequence[str], template: str) -> list[tuple[Column, Column]]:
    """``present`` holds a record's keys, as a null value counts as present."""
    return [(~F.array_contains("present", name), _said(kind, template, field=name)) for name in fields]


def _outside(column: str, known: Sequence[str]) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(*known)


def _is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def validate_nodes(nodes: DataFrame, version: str) -> DataFrame:
    """Rules of nodes; ``relations``, where the nodes have it, is JSON text."""
    t, say = vocab.NODE_PROBLEMS, lambda i, **parts: _said("node", vocab.NODE_PROBLEMS[i], **parts)
    grounded = (F.coalesce("label", F.lit("")) != "") | F.coalesce(F.exists("span_sources", lambda s: F.coalesce(s, F.lit("")) != ""), F.lit(False))
    return _problems("node", nodes, [
        *_missing("node", vocab.NODE_FIELDS, t[0]),
        (~F.col("schema_version").eqNullSafe(F.lit(version)), say(1, version=version)),
        (~F.startswith(F.coalesce("id", F.lit("")), F.lit("mem_")), say(2)),
        (_outside("type", vocab.NODE_TYPES), say(3, type=F.col("type"))),
        (_outside("status", vocab.NODE_STATUSES), say(4, status=F.col("status"))),
        (F.trim(F.coalesce("content", F.lit(""))) == "", say(5)),
        (~grounded & ~F.coalesce("status", F.lit("")).isin(*vocab.UNGROUNDED_STATUSES), say(6)),
        *([(~_is_object(F.col("relations")), say(7))] if "relations" in nodes.columns else []),
    ])


def validate_patches(patches: DataFrame, version: str) -> DataFrame:
    t, operation = vocab.PATCH_PROBLEMS, F.col("operation")
    say = lambda i, **parts: _said("patch", t[i], **parts)
    return _problems("patch", patches, [
        *_missing("patch", vocab.PATCH_FIELDS, t[0]),
        (~F.col("schema_version").eqNullSafe(F.lit(version)), say(1, version=version)),
        (~F.startswith(F.coalesce("id", F.lit("")), F.lit("patch_")), say(2)),
        (_outside("operation", vocab.OPERATIONS), say(3, operation=operation)),
        ((F.coalesce(operation, F.lit("")) != "create") & (F.coalesce(F.size("target_ids"), F.lit(0)) <= 0), say(4, operation=operation)),
        (operation.isin(*vocab.CONTENT_OPERATIONS) & (F.coalesce("new_content", F.lit("")) == ""), say(5, operation=operation)),
    ])


def validate_edges(edges: DataFrame, version: str) -> DataFrame:
    t, say = vocab.EDGE_PROBLEMS, lambda i, **parts: _said("edge", vocab.EDGE_PROBLEMS[i], **parts)
    return _problems("edge", edges, [
        *_missing("edge", vocab.EDGE_FIELDS, t[0]),
        (~F.col("schema_version").eqNullSafe(F.lit(version)), say(1, version=version)),
        (~F.startswith(F.coalesce("id", F.lit("")), F.lit("edge_")), say(2)),
        (_outside("type", vocab.EDGE_TYPES), say(3, type=F.col("type"))),
    ])


def validate_sessions(sessions: DataFrame, version: str) -> DataFrame:
    t, say = vocab.SESSION_PROBLEMS, lambda i, **parts: _said("session", vocab.SESSION_PROBLEMS[i], **parts)
    return _problems("session", sessions, [
        *_missing("session", vocab.SESSION_FIELDS, t[0]),
        (~F.col("schema_version").eqNullSafe(F.lit(version)), say(1, version=version)),
        (_outside("status", vocab.SESSION_STATUSES), say(2, status=F.col("status"))),
    ])


def _unknown(references: DataFrame, known: DataFrame) -> DataFrame:
    """The references (ledger, ref) that name no record of their ledger; a null one names nothing that is known."""
    return references.join(known.select("ledger", F.col("id").alias("ref")).distinct(), ["ledger", "ref"], "left_anti")


def node_references(nodes: DataFrame) -> DataFrame:
    """Problems of nodes' relations: what is no list, and what names no node. Relations that are no object are a rule's."""
    own = [F.col(c) for c in OWN]
    objects = nodes.filter(_is_object(F.col("relations")))
    entries = objects.select(*own, F.posexplode(F.from_json("relations", "map<string,variant>")).alias("at", "relation", "value"))
    listed = F.schema_of_variant("value").startswith("ARRAY")
    odd = entries.filter(~listed).select(*own, F.lit(REFERENCES).alias("rule"), _said("node", vocab.NODE_PROBLEMS[8], relation=F.col("relation")).alias("problem"), F.array("at").alias("place"))
    ids = F.transform(F.try_variant_get("value", "$", "array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("null")))
    refs = entries.filter(listed).select(*own, "at", "relation", F.posexplode(ids).alias("nth", "ref"))
    lost = _unknown(refs, nodes).select(*own, F.lit(REFERENCES).alias("rule"), _said("node", vocab.NODE_PROBLEMS[9], relation=F.col("relation"), ref=F.col("ref")).alias("problem"), F.array("at", "nth").alias("place"))
    return odd.unionByName(lost)


def patch_references(patches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Problems of patches' targets and new nodes."""
    found = []
    for i, (column, text) in enumerate((("target_ids", 6), ("new_node_ids", 7))):
        refs = patches.select(*OWN, F.posexplode(column).alias("nth", "ref"))
        found.append(_unknown(refs, nodes).select(*OWN, F.lit(REFERENCES + i).alias("rule"), _said("patch", vocab.PATCH_PROBLEMS[text], ref=F.col("ref")).alias("problem"), F.array("nth").alias("place")))
    return found[0].unionByName(found[1])


def edge_references(edges: DataFrame, nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """Problems of edges' ends and source patches; an edge without a source patch has none."""
    found = []
    for i, (column, text, known) in enumerate((("from", 4, nodes), ("to", 5, nodes), ("source_patch_id", 6, patches))):
        refs = edges.select(*OWN, F.col(column).alias("ref"))
        refs = refs.filter(F.coalesce("ref", F.lit("")) != "") if known is patches else refs
        found.append(_unknown(refs, known).select(*OWN, F.lit(REFERENCES + i).alias("rule"), _said("edge", vocab.EDGE_PROBLEMS[text], ref=F.col("ref")).alias("problem"), F.array(F.lit(0)).alias("place")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def all_problems(nodes: DataFrame, patches: DataFrame, edges: DataFrame, sessions: DataFrame, versions: dict[str, str]) -> DataFrame:
    """(ledger, kind, ord, rule, place, id, problem): all that is wrong with a ledger's records; ordered so, it is the order of reading."""
    every = [
        (0, validate_nodes(nodes, versions["node"])), (0, node_references(nodes)),
        (1, validate_patches(patches, versions["patch"])), (1, patch_references(patches, nodes)),
        (2, validate_edges(edges, versions["edge"])), (2, edge_references(edges, nodes, patches)),
        (3, validate_sessions(sessions, versions["session"])),
    ]
    found = None
    for kind, rows in every:
        one = rows.select("ledger", F.lit(kind).alias("kind"), "ord", "rule", "place", "id", "problem")
        found = one if found is None else found.unionByName(one)
    return found


def dangling(references: DataFrame, known: DataFrame, reference: str = "ref", key: str = "id") -> DataFrame:
    """The references that name nothing known; null and blank ones name nothing on purpose."""
    return references.filter(F.coalesce(F.col(reference).cast("string"), F.lit("")) != "").join(known.select(F.col(key).alias(reference)).distinct(), reference, "left_anti")


def problem_blocks(problems: DataFrame, group: str = "ledger", order: Sequence[str] = ("kind", "ord", "rule", "place"), size: int = 1000) -> DataFrame:
    """(group, block, problems, n_problems): the problems of a group in order, as texts of at most ``size`` problems; no task holds a group."""
    blocks = ordered_blocks(problems, group, order, "problem", size)
    return blocks.select(group, "block", F.array_join("items", "; ").alias("problems"), F.size("items").cast("bigint").alias("n_problems"))


def problem_text(problems: DataFrame, group: str = "ledger", order: Sequence[str] = ("kind", "ord", "rule", "place"), size: int = 1000) -> DataFrame:
    """(group, problems): all problems of a group as one text, in order; made of blocks, so a task holds whole texts only."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("block", "problems"))), lambda x: x["problems"])
    return problem_blocks(problems, group, order, size).groupBy(group).agg(F.array_join(one, "; ").alias("problems"), F.sum("n_problems").alias("n_problems"))

"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic; the tokens of the cells are raked, one dimension
after the other, until the marginals of all three meet their targets. Each cell then gets a probability,
its raked weight over its tokens times one factor, at most 1, chosen so that the expected tokens are the
asked share; documents are kept by a uniform number from their id's hash. The same id is always decided
alike, so a rerun or a lost executor changes nothing.

Counting is one pre-aggregated pass over all documents. Every source and language is a level of its own;
only a dimension that MOST_LEVELS names folds those beyond its heaviest. A table of up to MOST_CELLS cells
is raked on the driver, a larger one by aggregates in Spark, with the same steps and the same results.

Null sources and languages are levels of their own. Texts without a word weigh one token, so that they
can be sampled too. Very long texts count whole. Repeated rows count as often and are decided alike, as are
ties. An empty table gives an empty one. ``sample`` keeps all columns as they are, whatever their names.

A level that MOST_LEVELS folds away can't have a target of its own: asking for one is an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import drop_table, quoted, stage_table, unused, whole

DIMENSIONS = ("source", "lang", "topic")
#: Levels of a dimension that are raked on their own, where the others are to be folded. None are by default.
MOST_LEVELS: dict[str, int] = {}
#: Cells that go to the driver at most.
MOST_CELLS = 100_000
OTHER, MISSING = "(other)", "(none)"
#: Targets are the natural shares to this power: below 1 it raises what is rare.
POWER = 0.7
#: The expected share of all tokens that is kept.
SHARE = 0.9
ROUNDS, CLOSE = 200, 1e-9


@dataclass(frozen=True)
class Mix:
    """Target shares by dimension and level; a dimension left out gets shares by POWER."""

    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    share: float = SHARE
    power: float = POWER


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def topic_of(text: Column, words: Column) -> Column:
    """The form of a text: tables and code apart, else by its length."""
    return F.when(words == 0, "empty").when(text.rlike(r"\|.*\|"), "table").when(text.rlike(r"[{};]\s*\n"), "code").when(words < 100, "short").when(words < 1000, "medium").otherwise("long")


def described(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of every row, with no null but the id's."""
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    one = docs.select("doc_id", level(source).alias("source"), level(lang).alias("lang"), whole(text).alias("t")).withColumn("words", n_words(F.col("t")))
    return one.select("doc_id", "source", "lang", topic_of(F.col("t"), F.col("words")).alias("topic"), F.greatest("words", F.lit(1)).cast("bigint").alias("tokens"))


def fit_cells(tokens: np.ndarray, at: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Rake positive cells, given by their levels' numbers in each dimension, to the marginals, as far as the cells allow."""
    w = tokens / tokens.sum()
    for _ in range(ROUNDS):
        worst = 0.0
        for own, target in zip(at, targets, strict=True):
            now = np.bincount(own, w, len(target))
            factor = np.divide(target, now, out=np.zeros_like(now), where=now > 0)
            worst = max(worst, float(np.abs(now - target).max()))
            w = w * factor[own]
        if worst < CLOSE:
            break
    return w / w.sum()


def fit(tokens: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """``fit_cells`` of a table with an axis for each dimension (0: no cell)."""
    at = np.nonzero(tokens)
    out = np.zeros(tokens.shape)
    out[at] = fit_cells(tokens[at], list(at), targets)
    return out


def probabilities(tokens: np.ndarray, raked: np.ndarray, share: float) -> np.ndarray:
    """Inclusion probabilities in proportion to raked weight over tokens, at most 1, that keep the share of tokens."""
    ratio = np.divide(raked, tokens, out=np.zeros_like(raked), where=tokens > 0)
    top = float(tokens[ratio > 0].sum())
    want, factor = min(share * tokens.sum(), top), 0.0
    order = np.argsort(-ratio, axis=None)
    r, t = ratio.ravel()[order], tokens.ravel()[order]
    sure = 0.0  # tokens of the cells that are kept whole
    rest = np.append(np.cumsum((r * t)[::-1])[::-1], 0.0)
    for i in range(len(r)):
        if r[i] <= 0:
            break
        factor = (want - sure) / rest[i] if rest[i] > 0 else 0.0
        if factor * r[i] <= 1:
            break
        sure += t[i]
        factor = np.inf
    return np.where(ratio > 0, np.minimum(1.0, ratio * factor) if np.isfinite(factor) else 1.0, 0.0)


def fold(level: Column, kept: list[str] | None) -> Column:
    return level if kept is None else F.when(level.isin(kept), level).otherwise(F.lit(OTHER))


def levels(found: DataFrame) -> tuple[DataFrame, dict[str, list[str] | None]]:
    """``found`` with the levels beyond the heaviest folded into one where MOST_LEVELS asks for it, and the levels kept there."""
    kept: dict[str, list[str] | None] = dict.fromkeys(DIMENSIONS)
    for name in MOST_LEVELS:
        sums = found.groupBy(name).agg(F.sum("tokens").alias("sum_"))
        kept[name] = [r[0] for r in sums.orderBy(F.desc("sum_"), name).limit(MOST_LEVELS[name]).select(name).collect()]
        found = found.withColumn(name, fold(F.col(name), kept[name]))
    return found, kept


def refuse_folded(mix: Mix, kept: dict[str, list[str] | None]) -> None:
    """An error if a target names a level that has been folded away."""
    for d, asked in mix.targets.items():
        if kept.get(d) is not None and (lost := sorted(set(asked) - set(kept[d]) - {OTHER})):
            raise ValueError(f"{d}: no level of its own for {lost[:5]}; raise MOST_LEVELS")


CELL = "source string, lang string, topic string, probability double"


def cell_probabilities(found: DataFrame, mix: Mix) -> DataFrame:
    """(source, lang, topic, probability) of every cell."""
    cells = stage_table(found.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "levels")
    if cells.count() > MOST_CELLS:
        return table_probabilities(cells, mix)
    rows = cells.collect()  # MOST_CELLS bounds them
    if not rows:
        return found.sparkSession.createDataFrame([], CELL)
    tokens, at, targets = np.array([float(r.tokens) for r in rows]), [], []
    for d in DIMENSIONS:
        own = sorted({r[d] for r in rows})
        number = {v: i for i, v in enumerate(own)}
        at.append(np.array([number[r[d]] for r in rows]))
        target = np.array([mix.targets[d].get(v, 0.0) for v in own]) if d in mix.targets else np.bincount(at[-1], tokens) ** mix.power
        targets.append(target / target.sum())
    p = probabilities(tokens, fit_cells(tokens, at, targets), mix.share)
    return F.broadcast(found.sparkSession.createDataFrame([(*(r[d] for d in DIMENSIONS), x) for r, x in zip(rows, p.tolist(), strict=True)], CELL))


def table_probabilities(cells: DataFrame, mix: Mix) -> DataFrame:
    """``cell_probabilities`` of any number of cells: what ``fit_cells`` and ``probabilities`` do, by aggregates of the table."""
    spark, total = cells.sparkSession, float(cells.agg(F.sum("tokens")).first()[0])
    targets = {}
    for d in DIMENSIONS:
        own = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("natural"))
        if d in mix.targets:
            asked = spark.createDataFrame([(k, float(v)) for k, v in mix.targets[d].items()], f"{d} string, asked double")
            own = own.join(asked, d, "left").select(d, F.coalesce("asked", F.lit(0.0)).alias("target"))
        else:
            own = own.select(d, F.pow("natural", F.lit(float(mix.power))).alias("target"))
        own = stage_table(own, "targets")
        targets[d] = own.withColumn("target", F.col("target") / F.lit(float(own.agg(F.sum("target")).first()[0])))
    w = stage_table(cells.withColumn("w", F.col("tokens") / F.lit(total)), "raked")
    for _ in range(ROUNDS):
        worst, before = 0.0, w
        for d in DIMENSIONS:
            sums = stage_table(w.groupBy(d).agg(F.sum("w").alias("now")).join(targets[d], d), "sums")
            worst = max(worst, sums.agg(F.max(F.abs(F.col("now") - F.col("target")))).first()[0])
            w = w.join(sums.select(d, F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(0.0).alias("factor")), d).select(*DIMENSIONS, "tokens", (F.col("w") * F.col("factor")).alias("w"))
        w = stage_table(w, "raked")
        drop_table(before)
        if worst < CLOSE:
            break
    ratio = F.col("w") / F.col("tokens")
    top = float(w.filter("w > 0").agg(F.sum("tokens")).first()[0])
    want, factor, sure = min(mix.share * total, top), 0.0, -1.0
    while True:  # cells that the factor takes to 1 are kept whole, which raises it for the others
        r = w.filter("w > 0").agg(F.sum(F.when(ratio * factor > 1, F.col("tokens"))).alias("sure"), F.sum(F.when(ratio * factor > 1, 0.0).otherwise(F.col("w"))).alias("rest")).first()
        if float(r.sure or 0) <= sure:
            break
        sure = float(r.sure or 0)
        if not r.rest:
            factor = math.inf
            break
        factor = max(factor, (want - sure) / r.rest)
    p = F.least(F.lit(1.0), ratio * factor) if math.isfinite(factor) else F.lit(1.0)
    return stage_table(w.select(*DIMENSIONS, F.when(F.col("w") > 0, p).otherwise(0.0).alias("probability")), "probabilities")


def uniform(key: Column | str) -> Column:
    """A number in [0, 1) from the id's hash; a null id hashes as the empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(col.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, kept) of every row."""
    found, kept = levels(stage_table(described(docs), "cells"))
    refuse_folded(mix, kept)
    table = cell_probabilities(found, mix)
    return found.join(table, list(DIMENSIONS)).select("doc_id", *DIMENSIONS, "tokens", F.round("probability", 9).alias("probability")).withColumn("kept", uniform("doc_id") < F.col("probability"))


def sample(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` that the mix keeps, with their own columns."""
    found, kept = levels(stage_table(described(docs), "cells"))
    refuse_folded(mix, kept)
    names = {d: unused(docs, d) for d in (*DIMENSIONS, "words", "chance")}
    table = cell_probabilities(found, mix).toDF(*(names[d] for d in (*DIMENSIONS, "chance")))
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    rows = docs.withColumn(names["words"], n_words(whole("text")))
    rows = rows.withColumns({names["source"]: fold(level("source"), kept["source"]), names["lang"]: fold(level("lang"), kept["lang"]), names["topic"]: fold(topic_of(whole("text"), F.col(names["words"])), kept["topic"])})
    joined = rows.join(table, [names[d] for d in DIMENSIONS])
    return joined.filter(uniform("doc_id") < F.round(names["chance"], 9)).select(*map(quoted, docs.columns))

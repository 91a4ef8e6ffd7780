"""Language identification by cross-parsing against a suffix automaton of each language.

A bounded sample of labelled text per language is indexed by a suffix automaton. A text is parsed into
phrases, each the longest match in the language's sample from where the last one ended; the language that
needs the fewest bits, phrases times the cost of a pointer into its sample, wins. Every text is parsed
whole, in every learned language.

A text that is null or has no letter is ``und`` with score 0, as is every text where nothing was learned.
Ties go to the language first in alphabetical order. Null languages are not learned. Repeated rows stay, and
count once in a sample. Very long texts are parsed whole; a sample takes the beginning of one. An empty table
gives an empty one. Only key, text and language are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_remainder, stage_table

UNDETERMINED = "und"
#: The sample of a language: so many code points, from so many documents at most, those of the smallest hash.
SAMPLE_CHARS, SAMPLE_DOCS = 40_000, 120
#: Code points of all samples together: with more than 32 languages, each gets an equal share of them.
ALL_CHARS = 32 * SAMPLE_CHARS
#: More languages than this are an error, as each needs a sample of some length.
MOST_LANGUAGES = 4096


def suffix_automaton(text: str) -> dict:
    """The root of the automaton of all substrings of ``text``; a state maps a letter to the next state."""
    nexts: list[dict] = [{}]
    length, link = [0], [-1]
    last = 0
    for c in text:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:  # q also ends longer matches: part them
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
        last = new
    for state in nexts:
        for c, to in state.items():
            state[c] = nexts[to]
    return nexts[0]


def phrases(text: str, root: dict) -> int:
    """How many longest matches cover the text; a letter without any match is a phrase of its own."""
    n, state = 0, root
    for c in text:
        to = state.get(c)
        if to is None:
            n += 1  # the open phrase ends, or the letter stands alone
            to = root
            if state is not root:
                to = root.get(c)
                if to is None:
                    n, to = n + 1, root
        state = to
    return n + (state is not root)


@dataclass(frozen=True)
class Languages:
    """Samples by language."""

    samples: dict[str, str]

    @functools.cached_property
    def roots(self) -> list[tuple[str, dict, float]]:
        return [(lang, suffix_automaton(sample), math.log2(len(sample) + 2)) for lang, sample in sorted(self.samples.items())]

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.samples or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        folded = plain(text)
        bits = [(phrases(folded, root) * cost, lang) for lang, root, cost in self.roots]
        best, lang = min(bits)
        return lang, 1 / sum(2.0 ** -min(60.0, b - best) for b, _ in bits)


def plain(text: str) -> str:
    """Lower case, one space for each run of white space."""
    return " ".join(text.lower().split())


def learn(docs: DataFrame, rows: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Languages:
    """Samples from the rows for which the condition on the key holds."""
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).filter(F.col("l").isNotNull() & F.col("t").isNotNull() & rows)
    place = F.dense_rank().over(Window.partitionBy("l").orderBy("h"))
    drawn = known.select("l", F.xxhash64("k", "t").alias("h")).withColumn("place", place).filter(F.col("place") <= SAMPLE_DOCS)
    drawn = stage_table(drawn.select("l", "h").distinct(), "drawn")  # MOST_LANGUAGES and SAMPLE_DOCS bound it
    n = drawn.select("l").distinct().count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"{n} languages; at most {MOST_LANGUAGES} can be told apart")
    letters = max(1, min(SAMPLE_CHARS, ALL_CHARS // max(1, n)))
    hashed = known.select("l", F.xxhash64("k", "t").alias("h"), F.substring("t", 1, letters).alias("t"))
    chosen = hashed.join(F.broadcast(drawn), ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t")).select("l", "t")
    samples = {}
    ordered = stage_table(chosen, "samples").orderBy("l", F.xxhash64("t"))
    for name, rows_ in itertools.groupby(ordered.toLocalIterator(), lambda r: r.l):  # one language at a time
        texts = [plain(r.t) for r in rows_]
        share = max(200, letters // max(1, min(len(texts), SAMPLE_DOCS)))
        joined = "\n".join([t[:share] for t in texts] + [t[share:] for t in texts])
        if joined.strip():
            samples[name] = joined[:letters]
    return Languages(samples)


def predict_column(docs: DataFrame, languages: Languages, text: str = "text") -> Column:
    """struct<lang_pred:string, score:double>"""
    sent = docs.sparkSession.sparkContext.broadcast(languages)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = sent.value
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(F.col(text))


def language_report(docs: DataFrame) -> DataFrame:
    """Per document its predicted language, learned without the held-out quarter."""
    languages = learn(docs, id_remainder("k", 4) != 2)
    return docs.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), predict_column(docs, languages).alias("p")).select("doc_id", "held_out", "p.*")

"""Quality rules, line first: lines that fail a rule go, then documents that lose too much text go.

Each line is judged by itself: it must close with a mark of punctuation or hold the end of a sentence or clause (``punctuation``), must not be a list of
links or a button's label (``navigation``), must not state a licence, a notice or a script's warning (``boilerplate``),
and must not be full of symbols (``symbols``). The first rule that a line breaks, in that order, is named. What is
left is the cleaned text. A document is kept unless it fails the base rules (fewer than LEAST_WORDS words, or too many
words in 8-word windows that come back) or loses more than MOST_LOST percent of the characters of its words.

Windows are compared by a hash of their words and then word by word, so a count is exact; all windows of the whole text
take part. A text needs some 20 bytes of memory for each of its own, whatever its number of lines.

A null text counts as empty in counts, has no words and is not kept; cleaned, it stays null. Lines without a word are
never judged. Repeated rows and ties don't influence each other, as each text is judged by itself; an empty table gives
an empty one. Result columns replace columns of the same names, all others are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import unused, whole

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30

#: What a line's last sign may be, or the end of a sentence or clause within the line.
CLOSING = r"""[.!?…。！？:;"'”’»)\]][\x20\x09-\x0D]*$|[.!?…。！？,;:]["'”’»)]*[\x20\x09-\x0D]"""
#: Two or more separators of links, or a label and nothing else. A-Z is lower case here and below.
NAVIGATION = (
    r"[\x20\x09][|»›•·>][\x20\x09](.*[\x20\x09])?[|»›•·>]([\x20\x09]|$)"
    r"|^[\x20\x09-\x0D]*(home|menu|search|log[ -]?in|log[ -]?out|sign[ -]?(in|up|out)|register|subscribe|share|tweet|print|next|previous|back( to top)?|read more|skip to (main )?content|contact( us)?|about( us)?|site ?map|faq|help|top)[.!:»›>]*[\x20\x09-\x0D]*$"
)
BOILERPLATE = (
    r"\b(all rights reserved|terms (of|and) (use|service|conditions)|privacy policy|cookie (policy|settings)|(uses?|accept) cookies|(enable|requires?) javascript|javascript is (disabled|required)"
    r"|(licen[sc]ed|released|distributed) under|general public licen[sc]e|creative commons|lorem ipsum|powered by|follow us on|click here|copyright (\(c\)|[0-9]{4}))\b|©"
)
RULES = ("punctuation", "navigation", "boilerplate", "symbols")


@dataclass(frozen=True)
class LineRules:
    """Patterns of a line in which A-Z is lower case; ``most_symbols`` percent of a line's word characters may be symbols, ``most_lost`` of a text's may go."""

    closing: str = CLOSING
    navigation: str = NAVIGATION
    boilerplate: str = BOILERPLATE
    most_symbols: int = 5
    most_lost: int = 30


DEFAULT = LineRules()
REPORT = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,lost_lines:array<bigint>,lost_chars:bigint,cleaned:string>"


class LineJudge:
    """Compiled rules. Built once a task."""

    def __init__(self, rules: LineRules = DEFAULT):
        self.rules = rules
        self.closing, self.navigation, self.boilerplate = (re.compile(x, re.ASCII | re.IGNORECASE).search for x in (rules.closing, rules.navigation, rules.boilerplate))

    def broken(self, line: str) -> int:
        """The number of the first rule that a line with words breaks, or -1."""
        if not self.closing(line):
            return 0
        if self.navigation(line):
            return 1
        if self.boilerplate(line):
            return 2
        symbols = sum(map(line.count, SYMBOLS))
        if symbols and 100 * symbols > self.rules.most_symbols * word_chars(line):
            return 3
        return -1

    def clean(self, text: str) -> tuple[list[int], int, str]:
        """(lines lost by rule, word characters lost, the rest)."""
        kept, lost, chars = [], [0] * len(RULES), 0
        for line in text.split("\n"):
            rule = self.broken(line) if line.strip(SPACE) else -1
            if rule < 0:
                kept.append(line)
            else:
                lost[rule] += 1
                chars += word_chars(line)
        return lost, chars, "\n".join(kept)


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, SPACE))


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return len(lines) - len(set(lines))


def repeated_words(words: list[str], size: int = WINDOW) -> int:
    """The words covered by windows of ``size`` words (a power of two) that are found twice or more."""
    if len(words) <= size:
        return 0
    mixed, width = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), 1
    while width < size:
        mixed = mixed[:-width] * np.uint64(0x9E3779B97F4A7C15) ^ (mixed[width:] >> np.uint64(7)) + mixed[width:]
        width *= 2
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    change = np.zeros(len(words) + 1, np.int64)
    bounds = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))  # runs of equal hashes
    for low, high in zip(bounds[::2].tolist(), bounds[1::2].tolist(), strict=True):
        at = order[low : high + 1].tolist()
        first = words[at[0] : at[0] + size]
        if any(words[i : i + size] != first for i in at):  # two windows of one hash
            number: dict[tuple[str, ...], list[int]] = {}
            for i in at:
                number.setdefault(tuple(words[i : i + size]), []).append(i)
            at = [i for group in number.values() if len(group) > 1 for i in group]
        change[at] += 1
        change[[i + size for i in at]] -= 1
    return int((np.cumsum(change) > 0).sum())


def quality_facts(docs: DataFrame, text: str = "text", rules: LineRules = DEFAULT, out: str = "quality") -> DataFrame:
    """``docs`` with a struct of counts, lines lost by rule (in the order of RULES) and the cleaned text under ``out``."""

    @F.pandas_udf(REPORT)
    def facts(texts: pd.Series) -> pd.DataFrame:
        judge, rows = LineJudge(rules), []
        for t in texts:
            words = WORD.findall(t)
            repeats = repeated_words(words)
            chars, number = word_chars(t), len(words)
            del words
            rows.append((number, chars, sum(map(t.count, SYMBOLS)), duplicate_lines(t), repeats, *judge.clean(t)))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_lines", "lost_chars", "cleaned"])

    return docs.withColumn(out, facts(whole(text)))


def _verdict(name: str, rules: LineRules):
    base = (F.col(f"{name}.n_words") < LEAST_WORDS) | (100 * F.col(f"{name}.n_repeat_words") > MOST_REPEATED * F.col(f"{name}.n_words"))
    return base, ~base & (100 * F.col(f"{name}.lost_chars") <= rules.most_lost * F.col(f"{name}.word_chars"))


def clean_documents(docs: DataFrame, text: str = "text", rules: LineRules = DEFAULT) -> DataFrame:
    """The documents that pass, their texts without the lines that don't; columns stay as they are."""
    name = unused(docs, "_quality")
    found = quality_facts(docs, text, rules, name)
    return found.filter(_verdict(name, rules)[1]).withColumn(text, F.col(f"{name}.cleaned")).select(*(F.col(f"`{c}`") for c in docs.columns))


def quality_report(docs: DataFrame, rules: LineRules = DEFAULT) -> DataFrame:
    """Per document its counts, both verdicts, the lines lost by rule and the digest of the cleaned text."""
    found = quality_facts(docs.select("doc_id", "text"), rules=rules)
    failed, kept = _verdict("quality", rules)
    return found.select(
        "doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"), kept.alias("kept"),
        *(F.col("quality.lost_lines")[i].alias(f"lost_{rule}") for i, rule in enumerate(RULES)),
        "quality.lost_chars", F.sha2("quality.cleaned", 256).alias("cleaned_sha256"),
    )


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: The same by lists of words and lines.
QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{_WORD}+') AS w FROM d),
v AS (SELECT r, i, w[i:i + {WINDOW - 1}] AS win FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT r, unnest(range(i, i + {WINDOW})) AS pos FROM v JOIN (SELECT r, win FROM v GROUP BY r, win HAVING count(*) > 1) USING (r, win)),
again AS (SELECT r, count(DISTINCT pos) AS n FROM twice GROUP BY r),
l0 AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
l AS (SELECT r, pos, line, length(regexp_replace(line, '{_SPACE}', '', 'g')) AS chars, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
  translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM l0),
j AS (SELECT r, pos, line, chars, CASE WHEN chars = 0 THEN NULL WHEN NOT regexp_matches(low, {_quoted(CLOSING)}) THEN 0 WHEN regexp_matches(low, {_quoted(NAVIGATION)}) THEN 1
  WHEN regexp_matches(low, {_quoted(BOILERPLATE)}) THEN 2 WHEN 100 * symbols > {DEFAULT.most_symbols} * chars THEN 3 END AS rule FROM l),
s AS (SELECT r, sum(chars) AS word_chars, count(*) FILTER (chars > 0) - count(DISTINCT line) FILTER (chars > 0) AS dup,
  {", ".join(f"count(*) FILTER (rule = {i}) AS lost_{x}" for i, x in enumerate(RULES))}, coalesce(sum(chars) FILTER (rule IS NOT NULL), 0) AS lost_chars,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (rule IS NULL), '') AS cleaned FROM j GROUP BY r),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(dup AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, s.* EXCLUDE (r, word_chars, dup, cleaned, lost_chars), CAST(lost_chars AS BIGINT) AS lost_chars, cleaned
  FROM d JOIN w USING (r) JOIN s USING (r) LEFT JOIN again USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost_chars <= {DEFAULT.most_lost} * word_chars AS kept,
  {", ".join(f"lost_{x}" for x in RULES)}, lost_chars, sha256(cleaned) AS cleaned_sha256
FROM a
"""

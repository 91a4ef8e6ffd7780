"""Fill-in-the-middle transformation by a matcher of constant memory.

A text's units are the matches of UNIT from left to right. A first pass over them only counts; a second one
advances a lazy iterator to the smaller and then to the larger of two ranks drawn from the document's id, and
keeps the offset of the last match. No array of units, offsets or pieces is ever made, so that beyond the text
itself and its output a text of any length takes the same memory. The draws are digits of a digest of seed and
id: they don't depend on the order of rows, on partitions or on attempts of a task.

A null text counts as empty; empty texts, and texts that hold a marker, stay plain, so each output can be turned
back into its text. A null id draws as the empty text does; repeated rows, and rows of one id with equal texts, come
out alike; ties of the two ranks leave an empty middle. An empty table gives an empty one. Result columns replace
columns of the same names, all others are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import whole

#: A word with the white space before it, or white space that nothing follows.
UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MADE = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


def draws(key: str, seed: int = 42) -> list[int]:
    """Four numbers below 2**32."""
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def advance(matches: Iterator[re.Match], steps: int, at: int) -> int:
    """Where the match lies that so many steps lead to; ``at`` if none are taken."""
    last = deque(islice(matches, steps), maxlen=1)
    return last[0].end() if last else at


def cut(text: str, first: int, second: int) -> tuple[int, int, int]:
    """(number of units, end of the prefix, end of the middle), for two draws."""
    n = sum(1 for _ in UNIT.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    matches = UNIT.finditer(text)
    start = advance(matches, low, 0)
    return n, start, advance(matches, high - low, start)


def transform(text: str, key: str, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix and of the middle, output); ``rate`` and ``suffix_first`` are percentages."""
    h1, h2, h3, h4 = draws(key, seed)
    n, start, end = cut(text, h1, h2)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if h4 % 100 < suffix_first:
        return n, "spm", start, end - start, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", start, end - start, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text behind an output. The text holds no marker, so the first one of each kind is the right one."""
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    second, third = output.index(two), output.index(MIDDLE)
    left, right, middle = output[len(one) : second], output[second + len(two) : third], output[third + len(MIDDLE) :]
    return right + middle + left if form == "spm" else left + middle + right


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", out: str = "fim", seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """``docs`` with a struct (n, form, prefix_chars, middle_chars, output) under ``out``."""

    @F.pandas_udf(MADE)
    def made(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = [transform(t, k, seed, rate, suffix_first) for t, k in zip(texts, keys, strict=True)]
        found = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return found.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64", "form": object, "output": object})

    return docs.withColumn(out, made(whole(text), whole(F.col(key).cast("string"))))


def restored(output: Column | str, form: Column | str) -> Column:
    """The text behind a column of outputs."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restore(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return back(output, form)


def middle_report(docs: DataFrame) -> DataFrame:
    """Per document the form, the sizes of its pieces and the digests of output and restored text."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    return made.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(restored("fim.output", "fim.form"), 256).alias("restored_sha256"),
    )


#: The same with the lists of units that the operator avoids.
MIDDLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
r AS (SELECT *, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, len(units) AS n, form, list_aggregate(units[1:lo], 'string_agg', '') AS a, list_aggregate(units[lo + 1:hi], 'string_agg', '') AS b,
  list_aggregate(units[hi + 1:], 'string_agg', '') AS c FROM r),
q AS (SELECT doc_id, t, n, form, coalesce(a, '') AS a, coalesce(b, '') AS b, coalesce(c, '') AS c FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM q
"""

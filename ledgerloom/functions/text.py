"""Text functions: redaction, blanks, numbers, cuts.

Patterns keep the word boundary and white space of the records' own format: a boundary knows ASCII word
letters only, so a secret glued to other scripts is found; white space includes U+00A0, U+3000 and others. All of it
runs as built-in expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
SPACES = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# What is hidden, in this order, what stands for it, and in lower case what every match holds. A pattern begins
# with its letters and looks back from there; an address begins at the first word letter of its run, the only boundary that counts.
SECRETS = (
    (rf"sk-(?<![A-Za-z0-9_]sk-)[A-Za-z0-9_-]{{20,}}{BOUNDARY}", "[REDACTED_OPENAI_KEY]", "sk-"),
    (rf"gh(?<![A-Za-z0-9_]gh)[pousr]_[A-Za-z0-9_]{{20,}}{BOUNDARY}", "[REDACTED_GITHUB_TOKEN]", "gh"),
    (rf"(?i)bearer(?<![A-Za-z0-9_]bearer)[{SPACES}]+[A-Za-z0-9._~+/=-]{{20,}}{BOUNDARY}", "Bearer [REDACTED_TOKEN]", "bearer"),
    (rf"(?<![A-Za-z0-9_])[A-Za-z0-9_][A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{BOUNDARY}", "[REDACTED_EMAIL]", "@"),
)
PATHS = ((rf"/Users/[^/{SPACES}]+", "/Users/[REDACTED_USER]", "/Users/"), (rf"/home/[^/{SPACES}]+", "/home/[REDACTED_USER]", "/home/"))


def _replaced(text: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Each pattern is only looked for where its literal is. An array of one names the text, so that no step is computed twice."""

    def hide(pattern: str, mark: str, literal: str):
        holds = lambda t: F.contains(F.lower(t) if pattern.startswith("(?i)") else t, F.lit(literal))
        return lambda t: F.when(holds(t), F.regexp_replace(t, pattern, mark.replace("[", r"\["))).otherwise(t)

    for rule in rules:
        text = F.transform(F.array(text), hide(*rule))[0]
    return text


def redact(text: Column, mode: str | Column = "default") -> Column:
    """``off`` leaves the text, ``default`` hides secrets, ``strict`` also home folders. ``mode`` may be a column."""
    if isinstance(mode, str):
        return _replaced(text, {"off": (), "default": SECRETS, "strict": SECRETS + PATHS}[mode])
    return F.when(mode == "off", text).when(mode == "strict", _replaced(text, SECRETS + PATHS)).otherwise(_replaced(text, SECRETS))


def redact_text(text: str, mode: str = "default") -> str:
    """The same for one Python string."""
    for pattern, mark, _ in () if mode == "off" else SECRETS + (PATHS if mode == "strict" else ()):
        text = re.sub(pattern, mark, text)
    return text


#: A JSON text's tokens: a string, with the colon that makes it a key, or what stands between strings. Quotes stand nowhere else.
TOKEN = r'"(?:[^"\\]|\\.)*+"(?:[\x20\t\n\r]*+:)?|[^"]++'


def _plain(token: Column) -> Column:
    """The text that a JSON string stands for."""
    return F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]


def _written(text: Column) -> Column:
    """The JSON string of a text."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def redact_json(document: Column, mode: str | Column = "default") -> Column:
    """Redact all string values of a JSON text, at any depth; keys stay, white space between tokens goes.

    Text that is no JSON, or whose objects name a key twice, becomes null. Values are told from keys by their tokens, so no depth needs a walk.
    """
    tokens = F.regexp_extract_all(document, F.lit(TOKEN), F.lit(0))
    value = lambda t: F.startswith(t, F.lit('"')) & ~F.endswith(t, F.lit(":"))
    hidden = lambda t: F.when(value(t), _written(redact(_plain(t), mode))).otherwise(F.when(F.startswith(t, F.lit('"')), F.regexp_replace(t, r'[\x20\t\n\r]+:$', ":")).otherwise(F.regexp_replace(t, r"[\x20\t\n\r]+", "")))
    return F.when(F.try_parse_json(document).isNotNull(), F.array_join(F.transform(tokens, hidden), ""))


def keys_at_any_depth(document: Column, wanted: tuple[str, ...]) -> Column:
    """The sorted distinct keys of a JSON text, as written, that are among ``wanted`` in any case. Text that is no JSON has none."""
    tokens = F.filter(F.regexp_extract_all(document, F.lit(TOKEN), F.lit(0)), lambda t: F.startswith(t, F.lit('"')) & F.endswith(t, F.lit(":")))
    keys = F.transform(tokens, lambda t: _plain(F.regexp_replace(t, r'[\x20\t\n\r]*:$', "")))
    found = F.array_sort(F.array_distinct(F.filter(keys, lambda k: F.lower(k).isin(*wanted))))
    return F.when(F.size(keys) > 0, F.when(F.try_parse_json(document).isNotNull(), found).otherwise(F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def trimmed(text: Column) -> Column:
    """Without white space at either end; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, rf"^[{SPACES}]+|[{SPACES}]+$", ""), F.lit(""))


def first_filled(*texts: Column) -> Column:
    return F.coalesce(*(trimmed(t) for t in texts))


def _in_base(text: Column, mark: str, digits: str, base: int) -> Column:
    """A whole number written after 0 and ``mark``, of any length."""
    found = F.nullif(F.regexp_extract(text, rf"^[{SPACES}]*0[{mark}]([{digits}]+)[{SPACES}]*$", 1), F.lit(""))
    short = F.conv(found, base, 10).try_cast("double")
    each = F.transform(F.split(F.lower(found), ""), lambda d: (F.instr(F.lit("0123456789abcdef"), d) - 1).cast("double"))
    long = F.aggregate(F.filter(each, lambda d: d >= 0), F.lit(0.0), lambda n, d: n * base + d)
    return F.when(F.length(found) * {2: 1, 8: 3, 16: 4}[base] <= 53, short).otherwise(long)


def number(text: Column) -> Column:
    """A finite number from its text, else null. Suffixes and words for numbers are no numbers; whole numbers of base 2, 8 and 16 are.

    Those of more than 53 bits are rounded digit by digit.
    """
    plain = F.regexp_extract(text, rf"^[{SPACES}]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[{SPACES}]*$", 1).try_cast("double")
    found = F.coalesce(plain, _in_base(text, "xX", "0-9a-fA-F", 16), _in_base(text, "bB", "01", 2), _in_base(text, "oO", "0-7", 8))
    return F.when(F.abs(found) < float("inf"), found)


def cut(text: Column, units: int) -> Column:
    """The first so many UTF-16 units; a letter outside the basic plane is two."""
    short = F.substring(text, 1, units)
    wide = F.decode(F.substring(F.encode(text, "UTF-16BE"), 1, 2 * units), "UTF-16BE")
    return F.when(F.length(F.encode(short, "UTF-16BE")) <= 2 * units, short).otherwise(wide)

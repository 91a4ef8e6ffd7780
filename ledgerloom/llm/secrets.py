"""Secret scans with one combined deterministic automaton.

Rules are compiled together (``automaton``) on the driver, and the transition arrays, whose size depends on the rules alone,
are broadcast. One pass over a text's bytes follows a single row of transitions and notes where a rule's acceptance ends; from
there the rule's reversed automaton walks back to the leftmost start. A rule must stay accepting until its match ends, which
holds for patterns that close with a repeated class or a literal; matches of a rule are leftmost and do not overlap. A match
that fails its rule's bounds is dropped with all it holds; only where the last word was too short may the next one begin in it.

Null and empty texts have no span; masked, a null stays null. Offsets count code points, ends are exclusive. Texts of any length
are scanned whole, in memory for their bytes and spans. Spans of several rules that begin together go by the order of rules. Repeated
rows stay repeated and are scanned alike, an empty table gives an empty one. A result column replaces a column of the same name;
all others are kept.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.automaton import Nfa, Tables, compiled
from ledgerloom.llm.common import whole, worker_store


@dataclass(frozen=True)
class Rule:
    """``least`` bounds the match in characters, ``least_value`` what follows the first colon or equals sign, ``least_last`` the last word.

    A ``whole_word`` rule starts at no letter, digit or underscore's back.
    """

    kind: str
    pattern: bytes
    ignore_case: bool = False
    least: int = 1
    least_value: int = 0
    least_last: int = 0
    whole_word: bool = False

    def holds(self, match: bytes) -> bool:
        if len(match) < self.least or self.least_last and len(match.split()[-1]) < self.least_last:
            return False
        if not self.least_value:
            return True
        value = match[min(i for i in map(match.find, (b":", b"=")) if i >= 0) + 1 :].lstrip(b" ")
        return len(value[1:] if value[:1] in (b'"', b"'") else value) >= self.least_value


#: The kinds of the base scan, in their order.
BASE_RULES = (
    Rule("assign", rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, least_value=6),
    Rule("access", rb"AKIA[A-Z0-9]+", least=20),
    Rule("hex", rb"[0-9a-f]{6,}", least=24),
)
#: A line of a private key, base64 or a header (Proc-Type, DEK-Info), with the blanks that follow.
KEY_LINE = rb"([A-Za-z0-9+/=]+(-([TI][a-z]*(:[\t\x20-\x5B\x5D-~]*)?)?)?)?[\t\x20]*"
#: Public formats of tokens and keys. A private key goes on over its headers and its lines of base64, whose breaks may be
#: written as escapes; the line that ends it is a rule of its own, as a rule stays accepting until its match ends.
MORE_RULES = (
    Rule("forge", rb"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("cloud", rb"AIza[A-Za-z0-9_-]+", least=39),
    Rule("private_key", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----" + KEY_LINE + rb"([\r\n][\t\x20]*" + KEY_LINE + rb"|\\" + KEY_LINE + rb")*"),
    Rule("private_key_end", rb"-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("service", rb"sk-[A-Za-z0-9_-]+", least=23, whole_word=True),
    Rule("bearer", rb"bearer[\t-\r\x20]+[A-Za-z0-9._~+/=-]+", True, least_last=20, whole_word=True),
)
DEFAULT_RULES = BASE_RULES + MORE_RULES


WORD = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def tables(rules: tuple[Rule, ...]) -> tuple[Tables, list[Tables]]:
    """The automaton of all rules, and the reversed one of each."""
    nfa = Nfa()
    ends = [nfa.add(rule.pattern, rule.ignore_case) for rule in rules]
    back = nfa.reversed()
    together = compiled(nfa, [s for s, _ in ends], {e: 1 << i for i, (_, e) in enumerate(ends)}, anywhere=True)
    return together, [compiled(back, [e], {s: 1}, anywhere=False) for s, e in ends]


class SecretScanner:
    """Transition rows of a set of rules. Made once in each Python worker."""

    def __init__(self, rules: tuple[Rule, ...] = DEFAULT_RULES, made: tuple[Tables, list[Tables]] | None = None):
        self.rules = rules
        together, back = made or tables(rules)
        self.start, self.back = together.start_row(), [t.start_row() for t in back]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """Where acceptance stops, with the rules (bits) that stop there: one pass over all bytes."""
        found, row, on = [], self.start, 0
        for i, b in enumerate(data):
            row = row[b]
            if row[256] != on:
                if on & ~row[256]:
                    found.append((i, on & ~row[256]))
                on = row[256]
        if on:
            found.append((len(data), on))
        return found

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, number of the rule), in code points, by start and then rule."""
        data = text.encode("utf-8", "surrogatepass")
        found, done = [], [0] * len(self.rules)
        for end, bits in self.ends(data):
            for r, rule in enumerate(self.rules):
                if not bits >> r & 1:
                    continue
                row, start = self.back[r], -1
                for i in range(end - 1, done[r] - 1, -1):
                    row = row[data[i]]
                    if row is None:
                        break
                    if row[256] and not (rule.whole_word and i and data[i - 1] in WORD):
                        start = i
                if start >= 0:
                    holds = rule.holds(data[start:end])
                    if holds:
                        found.append((start, end, r))
                    if holds or not rule.least_last:
                        done[r] = end
        if found and len(data) != len(text):
            found = [(len(data[:s].decode("utf-8", "surrogatepass")), len(data[:e].decode("utf-8", "surrogatepass")), r) for s, e, r in found]
        return sorted(found, key=lambda x: (x[0], x[2]))


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> SecretScanner:
    return SecretScanner(rules)


@functools.lru_cache(maxsize=4)
def _tables(rules: tuple[Rule, ...]) -> tuple[Tables, list[Tables]]:
    return tables(rules)


def _sent(docs: DataFrame, rules: tuple[Rule, ...]) -> Callable[[], SecretScanner]:
    """What gives a worker its scanner of these rules; one is kept at a time."""
    sent, name = docs.sparkSession.sparkContext.broadcast(_tables(rules)), f"secrets {rules}"
    return lambda: worker_store(name, lambda: SecretScanner(rules, sent.value))


def scan_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES, out: str = "secrets") -> DataFrame:
    """``docs`` with an array of (kind, start, end) under ``out``."""

    made = _sent(docs, rules)

    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def scan(texts: pd.Series) -> pd.Series:
        find = made().spans
        return pd.Series([[{"kind": rules[r].kind, "start": s, "end": e} for s, e, r in find(t)] for t in texts], dtype=object)

    return docs.withColumn(out, scan(whole(text)))


def mask_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; overlapping spans count as one, a null text stays null."""

    made = _sent(docs, rules)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        find, out = made().spans, []
        for t in texts:
            parts, at = [], 0
            for s, e, _ in find(t) if t is not None else ():
                if s >= at:
                    parts += [t[at:s], mask]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]) if parts else t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, masked(F.col(text)))


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document the number of base secrets by kind, the digest of their spans, and all spans."""
    base = [rule.kind for rule in BASE_RULES]
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    found = scan_secrets(docs.select("doc_id", "text"))
    own = F.filter("secrets", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        *(number(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(written(own), 256).alias("base_sha256"),
        written(F.col("secrets")).alias("spans"),
    )


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The digest of a list of spans as ``secret_report`` writes it."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()

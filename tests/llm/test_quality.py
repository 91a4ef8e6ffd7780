import hashlib
import random
import re

import compare
from ledgerloom.llm.quality import BOILERPLATE, CLOSING, NAVIGATION, QUALITY_SQL, RULES, LineRules, clean_documents, quality_facts, quality_report, repeated_words

PROSE = "Rain fell on the harbour, and the boats came in one by one while people on the quay counted them. Nobody spoke of the storm."
OTHER = "In the morning the roofs were white, yet the road down to the mill had dried already, as if it had never been wet at all."


def brute(text):
    """The contract's counts and our rules, as plainly as they can be written."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    lost, gone, left = [0] * 4, 0, []
    for line in text.split("\n"):
        chars, low = len(re.sub(r"[\x20\x09-\x0D]", "", line)), "".join(c.lower() if c.isascii() else c for c in line)
        broken = [not re.search(CLOSING, low), re.search(NAVIGATION, low, re.A), re.search(BOILERPLATE, low, re.A), 20 * len(re.findall(r"[#*$%&|<>]", line)) > chars]
        if chars and any(broken):
            lost[[bool(x) for x in broken].index(True)] += 1
            gone += chars
        else:
            left.append(line)
    chars = sum(map(len, words))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    cleaned = hashlib.sha256("\n".join(left).encode()).hexdigest()
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed, not failed and 100 * gone <= 30 * chars, *lost, gone, cleaned)


def random_texts(n):
    rng = random.Random(12)
    lines = [PROSE, PROSE.replace(". ", ".\n"), "Home | News | Sport | Weather", "Sign in", "Read more »", "All rights reserved.", "Released under the MIT License.", "Blue### red### of*** the$$$.", "no mark here at all", "", "  \t", "K. © 2020.", "é | x | 漢.", "Und so weiter, und", "a b c d e f g h i j a b c d e f g h i j.", "x " * 30]
    return ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_report_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(random_texts(400))] + [(900, None), (901, ""), (901, ""), (None, PROSE), (902, "tick " * 40_000), (903, "\n" * 5000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, quality string, n_words int")
    got = sorted(tuple(r) for r in quality_report(docs).na.fill({"doc_id": -1}).collect())
    assert got == sorted((-1 if i is None else i, *(brute(t) if len(t or "") < 100_000 else (40_000, 160_000, 0, 0, 40_000, True, False, 1, 0, 0, 0, 160_000, hashlib.sha256(b"").hexdigest()))) for i, t in rows)
    assert quality_report(docs.limit(0)).count() == 0


def test_windows_with_equal_hashes():
    """Hashes that clash leave the counts exact."""

    class Same(str):
        def __hash__(self):
            return 7

    words = [Same(x) for x in "a b c d e f g h a b c d e f g h z a q w e r t y u i o p".split()]
    assert repeated_words(words) == 16 == repeated_words([str(x) for x in words])
    assert repeated_words(["x"] * 8) == 0 and repeated_words(["x"] * 9) == 9


def test_cleaned_documents(spark):
    text = "\n".join([PROSE, "Home | News | Sport | Weather", OTHER, "All rights reserved."])
    docs = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (3, "short.", "c"), (4, "\n".join([PROSE, " ".join(f"word{i}" for i in range(40))]), "d"), (5, text, "e")], "doc_id bigint, text string, _quality string")
    got = {r.doc_id: r for r in clean_documents(docs).collect()}
    assert set(got) == {1, 5} and got[1].text == f"{PROSE}\n{OTHER}" and got[5]._quality == "e"
    assert {r.doc_id for r in clean_documents(docs, rules=LineRules(most_lost=80)).collect()} == {1, 4, 5}
    lost = {r.doc_id: dict(zip(RULES, r.quality.lost_lines, strict=True)) for r in quality_facts(docs).collect()}
    assert lost[1] == {"punctuation": 1, "navigation": 0, "boilerplate": 1, "symbols": 0} and lost[2] == dict.fromkeys(RULES, 0)


def test_each_rule_is_named(spark):
    lines = ["no mark here at all", "Home | News | Sport. | Weather.", "Licensed under the Apache License.", "Red### and blue*** are here."]
    got = [r.quality.lost_lines for r in quality_facts(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got == [[1 if i == k else 0 for k in range(4)] for i in range(4)]


def test_report_equals_sql(spark, sf):
    from ledgerloom.llm.queries import queries

    assert compare.differences(queries()["op12_quality_rules"](spark, sf), compare.connect(sf), QUALITY_SQL) == ""


def test_clean_documents_are_kept(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
    report = quality_report(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id")
    assert report.filter("not base_failed and not kept").count() == 0

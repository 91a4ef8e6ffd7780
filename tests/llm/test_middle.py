import hashlib
import random
import re
import tracemalloc

import compare
import pytest
from ledgerloom.llm.middle import MIDDLE_SQL, cut, fill_in_middle, middle_report, restore, transform


def brute(key, text):
    """The contract, with a list of all units."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    x = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 80 else "psm"
    return len(units), form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


PARTS = ["a", "word", " ", "\n", "\t\x0b", "é漢", "<", "<P", "S>", "M", ">", "\x00", "\x1c", " ", "😀"]


def test_report_equals_brute_force(spark):
    rng = random.Random(13)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "x <M> y"), (1003, "long text, " * 30_000), (1003, "long text, " * 30_000), (-7, " \n ")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "no id", "x")], "doc_id bigint, text string, form string")
    got = sorted(tuple(r) for r in middle_report(docs).na.fill({"doc_id": -1}).na.fill(-1).collect())
    want = [(i, *brute(i, t)) for i, t in rows] + [(-1, *brute("", "no id"))]
    assert got == sorted(tuple(-1 if v is None else v for v in r) for r in want)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert middle_report(docs.limit(0)).count() == 0


def test_pieces_that_look_like_marks_are_restored():
    for text in ("<", "<<", "P><S", "<S <P <M", "a<S b>M> <P", "<P\n>"):
        for i in range(200):
            n, form, p, m, output = transform(text, str(i), rate=100)
            assert form != "plain" and restore(output, form) == text and 0 <= p <= p + m <= len(text)


def test_memory_does_not_grow_with_the_units():
    peaks = []
    for n in (1_000, 100_000):
        text = "ab " * n
        tracemalloc.start()
        assert cut(text, n // 3, n // 2)[0] == n + 1
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 20_000 and peaks[1] < 2 * peaks[0] + 5_000


@pytest.mark.parametrize(("rate", "first", "form"), [(0, 0, "plain"), (100, 0, "psm"), (100, 100, "spm")])
def test_rates(spark, rate, first, form):
    docs = spark.createDataFrame([(i, f"one two three {i}", "kept") for i in range(40)], "doc_id int, text string, fim string")
    got = fill_in_middle(docs, out="made", rate=rate, suffix_first=first).collect()
    assert {r.made.form for r in got} == {form} and {r.fim for r in got} == {"kept"} and all(restore(r.made.output, form) == r.text for r in got)


def test_report_equals_sql(spark, sf):
    from ledgerloom.llm.queries import queries

    assert compare.differences(queries()["op13_fill_in_middle"](spark, sf), compare.connect(sf), MIDDLE_SQL) == ""

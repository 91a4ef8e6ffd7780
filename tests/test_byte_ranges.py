"""Files read in ranges give the rows that one reader of the whole file gives."""

import hashlib
import random

import pytest
from ledgerloom.sources import byte_ranges, container


def plain(text):
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    section, out = None, []
    for pos, line in enumerate(lines):
        section = line[1:].strip() if line.startswith("@") else section
        out.append((pos, line, section))
    return out


def test_every_line_is_in_one_range(tmp_path):
    """Without Spark: cuts at every byte, inside letters of several bytes too."""
    for text in ("a\n\nbb\n@x\né漢\n", "\n", "abc", "\n\n", "a\r\nb"):
        (tmp_path / "f").write_bytes(text.encode())
        for length in range(1, 12):
            reader = byte_ranges.RangeReader(str(tmp_path / "f"), length)
            assert [line for p in reader.partitions() for b in reader.read(p) for line in b.column(3).to_pylist()] == [line for _, line, _ in plain(text)]


@pytest.mark.parametrize("length", [150, 1 << 20])
def test_lines_of_ranges(spark, tmp_path, length):
    rng = random.Random(length)
    texts = ["M\t1\n{}\n" + "\n".join(rng.choice(["@nodes", "@ patches ", "", '{"id":"é"}', "x" * 90, "漢"]) for _ in range(rng.randint(0, 40))) + rng.choice(["", "\n", "\n\n"]) for _ in range(12)]
    texts += ["one line", "\n", "\n\n\n", "@a"]
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}").write_bytes(t.encode())
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"x\n")
    lines = byte_ranges.read_lines(spark, str(tmp_path), length)
    got = {}
    for r in lines.collect():
        got.setdefault(r.path.rpartition("/")[2], []).append((r.pos, r.line, r.section))
    assert {k: sorted(v) for k, v in got.items()} == {f"f{i}": plain(t) for i, t in enumerate(texts)}
    sums = {r.path.rpartition("/")[2]: r for r in byte_ranges.overview(lines).collect()}
    for i, t in enumerate(texts):
        body = [line for _, line, _ in plain(t)][2:]
        assert sums[f"f{i}"].digest == hashlib.sha256("\n".join(body).encode()).hexdigest() and sums[f"f{i}"].n_lines == len(plain(t))


def test_one_file_by_several_tasks(spark, tmp_path):
    """The same records, sections and digest as when the file is one row; ranges are read by tasks of their own."""
    text = "LOOM\t0.1\n{}\n@nodes\n" + "".join(f'{{"id":"mem_{i}"}}\n' for i in range(20_000)) + "\n@patches\n" + "".join(f'{{"id":"p{i}"}}\n' for i in range(5_000))
    (tmp_path / "big").write_text(text)
    lines = byte_ranges.read_lines(spark, f"file://{tmp_path}/big", 50_000)
    assert spark.read.format(byte_ranges.NAME).option("rangeBytes", 50_000).load(f"{tmp_path}/big").rdd.getNumPartitions() == -(-len(text) // 50_000)
    files = container.read_containers(spark, str(tmp_path))
    assert sorted(r[1:] for r in byte_ranges.records(lines).collect()) == sorted(r[1:] for r in container.records(files).collect())
    from pyspark.sql import functions as F

    assert byte_ranges.checksums(lines).first().digest == files.select(container.checksum(F.col("content")).alias("d")).first().d


def test_small_ranges_share_tasks(tmp_path):
    """Many ranges of a few bytes are read by at most TASKS tasks, with the parts and rows they have alone; large ones are not put together."""
    texts = {f"f{i}": "".join(f"@s{j}\n" if j % 50 == 0 else f"line {i} {j}\n" for j in range(300 * i)) for i in range(5)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    reader = byte_ranges.RangeReader(str(tmp_path), 40)
    dealt = reader.partitions()
    alone = [own for p in dealt for own in p.ranges]
    assert len(alone) > 2 * byte_ranges.TASKS >= 2 * len(dealt)
    rows = lambda parts: [r for p in parts for b in reader.read(p) for r in zip(*b.to_pydict().values(), strict=True)]
    got = rows(dealt)
    assert got == rows([byte_ranges.Ranges([own]) for own in alone])
    assert {name: [r[3] for r in got if r[0].endswith(f"/{name}")] for name in texts} == {name: text.split("\n")[:-1] for name, text in texts.items()}
    assert all(r[2] == 0 or r[1] == before[1] for before, r in zip(got, got[1:]))
    assert [len(p.ranges) for p in byte_ranges.RangeReader(str(tmp_path), byte_ranges.RANGE_BYTES).partitions()] == [1] * 4

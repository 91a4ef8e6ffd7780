"""The sink's commits: a task that fails once leaves no duplicate, a job that fails leaves nothing."""

import os
import subprocess
import sys

import pytest
from ledgerloom.operators import documents
from ledgerloom.operators import events as ev
from ledgerloom.sources import upload_sink
from pyspark.sql import functions as F

ONCE = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from ledgerloom.sources import upload_sink
spark = SparkSession.builder.master("local[3, 4]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "10").getOrCreate()
@F.udf("string")
def shaky(i):
    at = TaskContext.get()
    if at.attemptNumber() == 0 and at.partitionId() == 1 and i % 100 == 70:
        raise RuntimeError("lost")
    return f"row {i}"
rows = spark.range(0, 300, 1, 3).select(F.col("id"), shaky("id").alias("content"))
upload_sink.write_uploads(rows, sys.argv[1])
back = upload_sink.read_uploads(spark, sys.argv[1], "id bigint, content string").collect()
assert sorted(r.id for r in back) == list(range(300)) and all(r.content == f"row {r.id}" for r in back)
"""


def test_a_task_that_fails_once(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", ONCE, f"file://{tmp_path}/t"], capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": root})
    assert run.returncode == 0, run.stderr[-2000:]
    assert "lost" in run.stderr and len(os.listdir(tmp_path / "t/data")) == 3


def test_a_job_that_fails(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    upload_sink.write_uploads(spark.range(5).select("id"), path)
    with pytest.raises(Exception, match="broken"):
        upload_sink.write_uploads(spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("bigint").alias("id")), path)
    upload_sink.write_uploads(spark.range(7, 9).select("id"), path)
    upload_sink.write_uploads(spark.range(0).select("id"), path)
    assert sorted(r.id for r in upload_sink.read_uploads(spark, path, "id bigint").collect()) == [0, 1, 2, 3, 4, 7, 8]
    (tmp_path / "t/data/orphan.parquet").write_bytes(next((tmp_path / "t/data").iterdir()).read_bytes())  # of a lost executor
    assert upload_sink.read_uploads(spark, path, "id bigint").count() == 7


def test_blocks_are_redacted_by_each_events_mode(spark):
    text = '{"a":[{"home":"/home/ann/x","mail":"me@x.org"}],"me@x.org":1}'
    rows = [(m, text, "no json me@x.org", None) for m in ("off", "default", "strict")]
    events = spark.createDataFrame(rows, "mode string, metadata string, service string, ledger string").select(
        F.struct(F.col("mode").alias("redaction")).alias("content_policy"), "metadata", "service", "ledger", *(F.lit("t").alias(c) for c in ("title", "summary", "intent", "cwd")))
    got = {r.content_policy.redaction: r for r in ev.redact_event(events, documents.BLOCKS).collect()}
    assert got["off"].metadata == text and got["off"].service == "no json me@x.org"
    assert got["default"].metadata == '{"a":[{"home":"/home/ann/x","mail":"[REDACTED_EMAIL]"}],"me@x.org":1}' and got["default"].service == "no json [REDACTED_EMAIL]"
    assert got["strict"].metadata == '{"a":[{"home":"/home/[REDACTED_USER]/x","mail":"[REDACTED_EMAIL]"}],"me@x.org":1}' and got["strict"].ledger is None

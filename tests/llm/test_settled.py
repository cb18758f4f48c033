"""What operators settle takes few files, and in a local folder few processes that set their permissions."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.llm import op04_mixing, op05_line_dedup
from quillon.plans.settle import settle

SCRIPT = """
from pyspark.sql import SparkSession
from quillon.plans.settle import settle
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert settle(spark.range(0, 100, 1, 4)).count() == 100
spark.stop()
"""


def test_processes_of_a_settled_table(tmp_path):
    (tmp_path / "chmod").write_text(f'#!/bin/sh\necho "$2" >> {tmp_path}/calls\nexec /bin/chmod "$@"\n')
    (tmp_path / "chmod").chmod(0o755)
    env = os.environ | {"PATH": f"{tmp_path}:{os.environ['PATH']}", "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    subprocess.run([sys.executable, "-c", SCRIPT], env=env, check=True, capture_output=True, timeout=120)
    calls = (tmp_path / "calls").read_text().splitlines()
    assert sum("attempt_" in c for c in calls) == 2 * 4  # a task's folder and its file
    assert not [c for c in calls if c.endswith((".crc", "_SUCCESS"))]


@pytest.fixture
def settled(monkeypatch):
    """Files of each table that the two operators settle, in order."""
    files = []

    def noted(df, **how):
        out = settle(df, **how)
        files.append(len(out.inputFiles()))
        return out

    for module in (op04_mixing, op05_line_dedup):
        monkeypatch.setattr(module, "settle", noted)
    return files


@pytest.fixture
def docs(spark):
    text = F.concat(F.lit("a line of more than forty characters that repeats here\n"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" words ")), 20))
    return spark.range(0, 4000, 1, 16).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), (F.col("id") % 21).cast("string")).alias("source"))


def test_line_dedup_writes_a_file_for_each_part_of_the_documents(spark, docs, settled):
    scattered = docs.repartition(16)  # every part holds ids of all four batches
    out = op05_line_dedup.line_dedup(scattered)
    assert settled[0] <= 16
    assert {r.doc_id for r in out.where("n_dropped = 0").collect()} == {3999}


def test_mixing_does_not_write_a_file_for_each_part(spark, docs, settled):
    assert op04_mixing.mix(docs).count() > 0
    assert settled[0] <= 4

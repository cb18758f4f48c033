"""The pipeline's stages on a small corpus, against what each should keep, and on odd tables."""

import random
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillon.llm.op07_bpe import encoding, vocabulary
from quillon.plans.settle import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "kept long, spans string, fp string, key string, score string, copies string, h string, predicted string, held_out string"


def write(spark, at, rows, labels, extra=False):
    made = spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, f"src{(i or 0) % 21}", len(t or "")) for i, t in rows], SCHEMA)
    for column in EXTRA.split(", ") if extra else []:
        made = made.withColumn(column.split()[0], F.lit("7").cast(column.split()[1]))
    made.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, rows, labels = random.Random(1), [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        if toxic:
            words[10:10] = ["vile", "scum", "hate", "them"]
        rows.append((i, " ".join(words) + ("\nThis very line stands in a good many of the documents" if i % 7 == 3 else "")))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1]) for i in (1, 2)] + [(1100 + i, rows[i][1] + " tail") for i in (6, 7)]
    return write(spark, tmp_path_factory.mktemp("corpus"), rows, labels), dict(rows)


def test_each_stage(spark, corpus):
    at, texts = corpus
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        if name != "bpe":
            assert out.dtypes == docs.dtypes
        rows = out.collect()
        kept[name] = {r.doc_id: r for r in rows}
        assert len(kept[name]) == len(rows)
        docs = spark.createDataFrame(rows, out.schema)
    clean = {i for i in texts if i % 5 or i >= 1000}
    assert set(kept["toxicity"]) == clean
    line = "This very line stands in a good many of the documents"
    holders = {i for i in clean if line in texts[i]}
    for i, r in kept["line_dedup"].items():
        assert r.text == (texts[i] if i not in holders or i == max(holders) else texts[i].replace("\n" + line, "")) and r.n_chars == len(r.text)
    assert set(kept["simhash_near_dedup"]) == clean - {1001, 1002, 1106, 1107}
    tokens = lambda s: sum(len(kept["line_dedup"][i].text.split()) for i in s)
    near = set(kept["simhash_near_dedup"])
    assert set(kept["mixing"]) <= near and tokens(kept["mixing"]) <= 0.9 * tokens(near) and tokens(kept["mixing"]) > 0.3 * tokens(near)
    enc = encoding(**vocabulary())
    assert {i: list(r.ids) for i, r in kept["bpe"].items()} == {i: enc.encode_ordinary(r.text) for i, r in kept["mixing"].items()}


def test_run_writes_the_same_and_leaves_no_tables(spark, corpus):
    at, _ = corpus
    folder = Path(shared_dir(spark).removeprefix("file://"))
    count = lambda: sum(1 for _ in folder.glob("*/*"))
    before = count()
    a = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, at).collect()}
    assert a and count() == before + 1  # the last stage's input


def test_odd_and_empty_tables(spark, tmp_path):
    rows = [(None, "null id"), (None, None), (1, None), (2, ""), (3, " \n\n"), (4, "x" * 40_000), (5, "same text of a few words " * 9), (5, "same text of a few words " * 9), (6, "same text of a few words " * 9), (7, "w " * 30_000)]
    labels = [(1, 1, 1), (5, 1, 0), (5, 0, None), (None, 0, 1), (99, 1, 0)]
    got = corpus_pipeline.run(spark, write(spark, tmp_path / "odd", rows, labels, extra=True)).collect()
    assert {r.doc_id for r in got} <= {None, 1, 2, 3, 4, 5, 7}
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "empty", [], [], extra=True)).collect() == []
    assert len(corpus_pipeline.run(spark, write(spark, tmp_path / "unlabelled", [(1, "a b"), (2, "c d")], [])).collect()) <= 2

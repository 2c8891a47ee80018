import zlib

import numpy as np
from pyspark.sql import functions as F

from tablerecon.llm import quality, toxicity
from tablerecon.llm.queries import QUERIES
from tablerecon.llm.sampling import fold

GOOD = ["the house is on the hill {}", "we walked to the sea and back {}", "a letter came from the city {}"]
BAD = ["BUY!! NOW!! CHEAP!! {}", "win win win win win {}", "$$$ %%% *** {}"]


def corpus(spark, make, n=240):
    rows = [(i, make(i)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_quality_separates_held_out_rows(spark):
    docs = corpus(spark, lambda i: (GOOD if i % 2 else BAD)[i % 3].format(f"w{i}"))
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(160)], "doc_id long, quality int, score string")
    model = quality.fit(docs, labels, "quality")
    got = quality.score(docs.selectExpr("*", "1 AS score"), model).collect()
    assert len(got) == 240 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got if r.doc_id >= 160]) > 0.95


def test_quality_edge_cases(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs(["a"]), none, "quality")
    odd = docs([None, "", "a", "a", "x" * 50_000, (None, "a b")], "score double, text2 string")
    assert {r.score for r in quality.score(odd, model).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (0, 1), (None, 1), (1, None)], "doc_id long, quality int")
    assert quality.fit(docs(["a", "b"]), one, "quality").prior == 1.0
    assert quality.score(docs([]), model).count() == 0


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    def text(i):
        words = [f"common{(i * 7 + k) % 40}" for k in range(30)]
        return " ".join(words + (["badword", f"nastiness{i}"] if i % 10 == 0 else []))

    docs = corpus(spark, text, 600)
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((s >= 0.5) == (i % 10 == 0) for i, s in got.items())
    assert "nast-" in model.weights


def test_toxicity_edge_cases(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs(["a"]), none)
    got = toxicity.score(docs([None, "", "bad bad", "x" * 50_000, (None, "a")], "score string"), model).collect()
    assert len(got) == 5 and all(r.score < 1e-9 for r in got)
    assert toxicity.score(docs([]), model).count() == 0


def test_negative_risk_never_turns_training_over():
    # The unlabelled rows hold fewer toxic ones than the prior says: the estimate falls below zero.
    model = toxicity.non_negative_pu([{"bad", "worse"}] * 50, [{"ok"}] * 96 + [{"bad", "worse"}] * 4, 0.1)
    assert sum(model.weights.values()) + model.bias > 0 > model.bias
    assert toxicity.non_negative_pu([], [{"a"}], 0.1).weights == {}


def test_folds_are_zlib_s(spark):
    got = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_queries_never_see_labels_of_held_out_rows(spark, sf_dir):
    got = QUERIES["op5_quality"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_scores_do_not_hang_on_labels_of_held_out_rows(spark, sf_dir, tmp_path):
    """Turning every held-out label round, and adding rows for held-out documents, changes no score."""
    held = {"op3_toxicity": (5, 0), "op5_quality": (3, 1)}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, (folds, out) in held.items():
        changed = labels
        for label in ("quality", "toxic"):
            changed = changed.withColumn(label, F.when(fold(F.col("doc_id"), folds) == out, 1 - F.col(label)).otherwise(F.col(label)))
        more = spark.read.parquet(f"{sf_dir}/documents.parquet").where(fold(F.col("doc_id"), folds) == out)
        more = more.select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic"))
        folder = tmp_path / name
        changed.unionByName(more).write.parquet(str(folder / "labels.parquet"))
        spark.read.parquet(f"{sf_dir}/documents.parquet").write.parquet(str(folder / "documents.parquet"))
        before = {r.doc_id: (r.score, r.predicted) for r in QUERIES[name](spark, sf_dir).collect()}
        after = {r.doc_id: (r.score, r.predicted) for r in QUERIES[name](spark, str(folder)).collect()}
        assert before == after and len(before) > 100


def test_training_mends_what_counting_gets_wrong(monkeypatch):
    """Five words that always come together are one piece of evidence; counting takes them for five."""
    rng = np.random.default_rng(4)
    group = [f"often{i}" for i in range(5)]

    def row(toxic):
        words = {f"w{i}" for i in rng.integers(0, 30, 12)}
        words |= set(group) if rng.random() < (0.45 if toxic else 0.05) else set()
        return words | ({"slur"} if toxic and rng.random() < 0.8 else set())

    def errors(model):
        wrong = 0
        for toxic, rows in ((1, test[0]), (0, test[1])):
            wrong += sum((sum(model.weights.get(w, 0) for w in r) + model.bias >= 0) != toxic for r in rows)
        return wrong

    known, mixed = [row(True) for _ in range(600)], [row(rng.random() < 0.1) for _ in range(3000)]
    test = [row(True) for _ in range(200)], [row(False) for _ in range(1800)]
    monkeypatch.setattr(toxicity, "LEAST_PURITY", 0.3)
    trained = errors(toxicity.non_negative_pu(known, mixed, 0.1))
    monkeypatch.setattr(toxicity, "EPOCHS", 0)
    counted = errors(toxicity.non_negative_pu(known, mixed, 0.1))
    assert trained < 0.8 * counted, (trained, counted)

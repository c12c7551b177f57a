import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import m09_ordinal, queries

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    model = m09_ordinal.train(docs, labels.where("doc_id % 5 > 0"), grade, 3)
    held = labels.where("doc_id % 5 = 0").withColumn("grade", grade)
    got = m09_ordinal.score(docs, model, 2, 0.7).join(held, "doc_id").toPandas()
    kept = got[got["grade"] == 2]["kept"].mean(), got[got["grade"] == 1]["kept"].mean(), got[got["grade"] == 0]["kept"].mean()
    assert kept[0] > 0.97 and kept[1] < 0.2 and kept[2] < 0.02, kept
    assert (np.diff(model.thresholds) > 0).all()


def test_odd_rows(spark):
    rows = [(1, "good words here"), (2, "bad*** words###"), (3, None), (4, ""), (5, "x" * 50_000), (6, "good words here"), (None, "good words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("grade", F.lit("clash"))
    ratings = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, None), (99, 0), (None, 1)], "doc_id long, g int")
    model = m09_ordinal.train(docs, ratings, F.col("g"), 2, least_documents=1, least_z=0.0)
    got = m09_ordinal.score(docs, model, 1).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].kept and not by[2].kept and by[1].score == by[6].score == by[None].score and by[3].score == by[4].score
    for r in got:
        assert 0 <= r.tail_probability <= 1 and abs(r.expected_grade - r.tail_probability) < 1e-9
    nothing = m09_ordinal.train(docs, ratings.limit(0), F.col("g"), 3)
    assert m09_ordinal.score(docs, nothing, 2).count() == len(rows)
    assert m09_ordinal.score(docs.limit(0), model, 1).count() == 0


def test_grade_probabilities_are_cumulative_logistic():
    m = m09_ordinal.OrdinalModel(np.zeros(1), np.array([-1.0, 0.5]))
    p = m.grade_probabilities(0.2)
    logistic = lambda x: 1 / (1 + np.exp(-x))
    assert np.allclose(p, [logistic(-1.2), logistic(0.3) - logistic(-1.2), 1 - logistic(0.3)])


def test_registered():
    assert "op9_ordinal_quality" in queries.QUERIES


def test_fit_against_a_plain_version():
    """The fitted model lowers the written-out objective to where its numeric gradient vanishes; and scores are sums."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 12, rng.integers(1, 7))).astype(np.int32) for _ in range(400)]
    latent = np.array([r.sum() / 8 for r in rows]) + rng.logistic(size=400)
    grades = np.digitize(latent, [1.0, 2.5])
    model = m09_ordinal.fit([r.copy() for r in rows], grades, 3, least_documents=1, least_z=0.0, steps=3000, ridge=1e-3)

    def objective(x):
        w, theta = x[:12], x[12:]
        total = 0.0
        for r, g in zip(rows, grades):
            below = [0.0, *(1 / (1 + np.exp(-(t - w[r].sum()))) for t in theta), 1.0]
            total -= np.log(below[g + 1] - below[g])
        return total / len(rows) + 1e-3 / 2 * (w**2).sum()

    best = np.concatenate([model.weights[:12], model.thresholds])
    slope = [(objective(best + 1e-5 * e) - objective(best - 1e-5 * e)) / 2e-5 for e in np.eye(14)]
    assert np.abs(slope).max() < 2e-3, slope
    start = objective(np.concatenate([np.zeros(12), [-0.5, 0.5]]))
    assert objective(best) < start - 0.05


def test_scores_against_a_plain_version(spark):
    """Every row's score, grade and tail, recomputed from its words with a plain loop."""
    import zlib

    texts = ["Good, good words here!! and MORE", "bad*** words### x", None, "", "a b", "one one one two", "é ÄÖÜ ß"]
    rng = np.random.default_rng(2)
    model = m09_ordinal.OrdinalModel(rng.normal(size=1 << m09_ordinal.BITS), np.array([-0.4, 0.9]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in m09_ordinal.score(docs, model, 2, 0.3).collect():
        words = (texts[r.doc_id] or "").encode().split()
        names = {b"tall"}
        if sum(a == b for a, b in zip(words, words[1:])) * 5 > len(words) > 0:
            names.add(b"tstutter")
        if len(words) < 5:
            names.add(b"tshort")
        for w in words:
            core = w.lower().strip(b".,!?*#$%&|;:\"'()<>")
            if core:
                names |= {b"w" + core, b"4" + core[:4], b"5" + core[:5]}
            end = w[len(w.rstrip(b"!?*#$%&|;:<>")) :][:2]
            if end:
                names.add(b"m" + end)
            if len(w) > 2 and w.isupper():
                names.add(b"upper")
        s = sum(model.weights[i] for i in {zlib.crc32(n) % (1 << m09_ordinal.BITS) for n in names})
        below = [1 / (1 + np.exp(s - t)) for t in model.thresholds]
        assert abs(r.score - s) < 1e-9 and abs(r.tail_probability - (1 - below[1])) < 1e-9
        assert abs(r.expected_grade - ((1 - below[0]) + (1 - below[1]))) < 1e-9 and r.kept == (1 - below[1] >= 0.3)

import numpy as np
from pyspark.sql import functions as F

from panelloom.llm import quality as Q
from panelloom.llm.common import held_out

GOOD = "The house on the hill was old, and nobody had lived there for years. It stood."
BAD = "BUY!! NOW!! CHEAP!! ### $$$ OFFER!! | | | "


def rows(n):
    return [(k, (GOOD if k % 3 else BAD) * (1 + k % 5)) for k in range(n)]


def labels(spark, n):
    return spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(n)], "doc_id long, quality int, toxic int")


def test_scores_separate_classes_and_ignore_labels(spark, docs):
    df = docs(rows(300), "score _score label stats")
    model = Q.fit(Q.with_statistics(df), labels(spark, 300))
    kept = Q.keep_good(df, model)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [k for k in range(300) if k % 3]
    stats = Q.with_statistics(df)
    a = {r.doc_id: r.s for r in stats.select("doc_id", Q.score_statistics(model, stats.stats).alias("s")).collect()}
    b = {r.doc_id: r.s for r in df.select("doc_id", Q.score(model, df.text).alias("s")).collect()}
    assert a == b and all(0 <= s <= 1 for s in a.values())


def test_model_equals_numpy(spark, docs):
    df = docs(rows(400))
    stats = Q.with_statistics(df)
    model = Q.fit(stats, labels(spark, 400))
    learn = [(int(r.doc_id % 3 > 0), r.stats) for r in stats.where(~held_out(stats.doc_id)).collect()]
    for k in (0, 1):
        x = np.array([s for y, s in learn if y == k])
        assert np.allclose(model.mean[k], x.mean(axis=0))
    ys = np.array([y for y, _ in learn])
    scatter = [np.cov(np.array([s for y, s in learn if y == k]).T, bias=True) * (ys == k).sum() for k in (0, 1)]
    pooled = sum(scatter) / len(ys)
    own = 0.8 * scatter[1] / (ys == 1).sum() + 0.2 * pooled
    cov = 0.99 * own + 0.01 * (np.trace(own) / len(own) + 1e-9) * np.eye(len(own))
    assert np.allclose(model.whiten[1].T @ model.whiten[1], np.linalg.inv(cov), rtol=1e-4, atol=1e-3)


def test_nulls_empty_long_and_missing_labels(spark, docs):
    df = docs([(1, None), (2, ""), (None, "x"), (4, "word " * 30_000), (4, "word " * 30_000)])
    none = labels(spark, 0)
    model = Q.fit(Q.with_statistics(df), none)
    got = df.select("doc_id", Q.score(model, df.text).alias("s")).collect()
    assert [r.s for r in got] == [0.5] * 5
    one = Q.fit(Q.with_statistics(df), spark.createDataFrame([(1, 1, 0), (4, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int"))
    assert {r.s for r in df.select(Q.score(one, df.text).alias("s")).collect()} == {1.0}
    full = Q.fit(Q.with_statistics(docs(rows(100))), labels(spark, 100))
    s = [r.s for r in df.select(Q.score(full, df.text).alias("s")).collect()]
    assert all(0 <= x <= 1 for x in s) and s[0] == s[1] and s[3] == s[4]
    assert Q.keep_good(docs([]), full).collect() == [] and Q.with_statistics(docs([])).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    df, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    stats = Q.with_statistics(df)
    model = Q.fit(stats, y)
    scored = stats.select("doc_id", Q.score_statistics(model, stats.stats).alias("s")).join(y, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert np.mean([(r.s >= Q.THRESHOLD) == (r.quality == 1) for r in scored]) > 0.95

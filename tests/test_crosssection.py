import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import crosssection as X
from panelloom.operators.store import written


def ranks(v):
    v = np.asarray(v, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


@pytest.fixture(scope="module")
def skewed(spark):
    """One group has most rows and one value fills a third of it."""
    rng = np.random.default_rng(5)
    rows = []
    for g, n in ((1, 900), (2, 30), (3, 1), (4, 12)):
        v = np.round(rng.standard_t(2, n) * 10.0 ** (g - 2), 3)
        v[: n // 3] = 0.25
        rows += [(g, float(x)) for x in v]
    rows.append((2, None))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, g int, v double")
    return written(df, "skewed"), rows


def test_average_rank(skewed):
    df, rows = skewed
    got = {r.id: (r["rank"], r.n) for r in X.average_rank(df, ["g"], "v", salts=7).collect()}
    for g in (1, 2, 3, 4):
        ids = [i for i, r in enumerate(rows) if r[0] == g and r[1] is not None]
        want = ranks([rows[i][1] for i in ids])
        assert [got[i][0] for i in ids] == list(want)
        assert {got[i][1] for i in ids} == {len(ids)}
    assert len(got) == len(rows) - 1


def test_quantiles(skewed):
    df, rows = skewed
    fr = [k / 10 for k in range(1, 10)]
    got = {r.g: r for r in X.quantiles(df, ["g"], "v", fr, rows="all").collect()}
    for g in (1, 2, 3, 4):
        v = [r[1] for r in rows if r[0] == g and r[1] is not None]
        assert got[g].breakpoints == pytest.approx(list(np.percentile(v, [10 * k for k in range(1, 10)])), abs=1e-9)
        assert got[g].n_values == len(v)
    assert got[2]["all"] == 31


def test_rank_of_everything_without_groups(skewed):
    df, rows = skewed
    out = X.average_rank(df.withColumn("one", F.lit(1)), ["one"], "v")
    v = [r[1] for r in rows if r[1] is not None]
    assert sorted(r["rank"] for r in out.collect()) == sorted(ranks(v))


def test_equal_pairs_are_spread_over_salts(spark):
    """Zero returns under a constant score: one value, many keys."""
    rows = spark.range(640).selectExpr("1 AS g", "0.0D AS v", "id")
    assert rows.select(X.salt_of(*rows.columns).alias("s")).distinct().count() > 30
    assert {r["rank"] for r in X.average_rank(written(rows, "equal"), ["g"], "v").collect()} == {320.5}


def test_chunks_split_one_group_evenly(spark):
    # one group, values in a narrow range: no chunk holds more than a share of it
    df = spark.range(4000).selectExpr("1 AS g", "100 + id * 1e-9 AS v", "1L AS _c")
    placed, offsets = X._chunks(df, ["g"], "v")
    sizes = [r["_in"] for r in offsets.orderBy("_part").collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * 4000 / len(sizes)
    assert [r["_before"] for r in offsets.orderBy("_part").collect()] == [sum(sizes[:i]) for i in range(len(sizes))]
    assert placed.count() == 4000


def test_value_on_a_breakpoint_belongs_below(make):
    df = make([(1.0,), (2.0,), (2.1,), (9.0,)], "v double").withColumn("b", F.array(F.lit(1.0), F.lit(2.0)))
    assert [r.q for r in df.select(X.quantile_of("v", "b").alias("q")).collect()] == [1, 2, 3, 3]


def test_top_n_is_exact_with_ties(make):
    rows = [(1, i, float(i % 5)) for i in range(500)] + [(2, i, 1.0) for i in range(3)]
    df = make(rows, "g int, id long, v double")
    got = X.top_n(df, ["g"], [F.col("v").desc(), F.col("id")], 120, salts=5).collect()
    want = sorted([r for r in rows if r[0] == 1], key=lambda r: (-r[2], r[1]))[:120]
    assert [(r.id, r.rn) for r in sorted(got, key=lambda r: (r.g, r.rn)) if r.g == 1] == [(w[1], i + 1) for i, w in enumerate(want)]
    assert sum(r.g == 2 for r in got) == 3


@pytest.mark.parametrize("bracket", [0.01, 0.2])
def test_medians_order_only_the_values_near_them(spark, monkeypatch, bracket):
    rng = np.random.default_rng(5)
    rows = [(g, None if k % 11 == 0 else float(rng.normal()), float(rng.integers(0, 3)), None) for g in (1, 2) for k in range(4000 + g)] + [(3, 1.5, 2.5, None)]
    df = written(spark.createDataFrame(rows, "mi int, a double, b double, c double"), "medians")
    ordered, chunks = [], X._chunks

    def spy(counts, by, value):
        ordered.append(counts.filter("_column = 'a'").agg(F.sum("_c")).first()[0])
        return chunks(counts, by, value)

    monkeypatch.setattr(X, "_chunks", spy)
    got = {(r.mi, r._column): (r.breakpoints[0], r.n_values) for r in X.medians(df, ["mi"], ["a", "b", "c"], bracket).collect()}
    for g in (1, 2, 3):
        for i, c in enumerate("ab", 1):
            values = [r[i] for r in rows if r[0] == g and r[i] is not None]
            assert got[g, c] == (pytest.approx(float(np.median(values)), abs=1e-15), len(values))
    assert len(got) == 6
    assert ordered[0] <= 3 * bracket * 7274 and len(ordered) == 1


def test_medians_outside_their_bracket_are_found_among_all_values(spark, monkeypatch):
    df = written(spark.createDataFrame([(1, float(k)) for k in range(10)], "mi int, a double"), "medians")
    monkeypatch.setattr(X.F, "percentile_approx", lambda *_: F.array(F.lit(0.0), F.max(F.lit(1.0))))
    assert X.medians(df, ["mi"], ["a"]).first().breakpoints == [4.5]

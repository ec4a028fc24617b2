import duckdb
import pytest

import __spark_entry__ as entry
from panelloom.operators import panel as P
from panelloom.operators.store import drop_written
from panelloom.plans.registry import ITEMS
from panelloom.plans.tables import read, tables

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_check_has_a_query_and_inventory_items():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and set(ITEMS) == set(q) - set(entry.TEXT_QUERIES) and all(ITEMS.values())


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert {r.portfolio for r in rows} == {"1", "2", "3", "long_short"} and all(r.n_months > 50 for r in rows)


@pytest.mark.parametrize("name", ["panel", "cumulative_returns", "eligibility", "target_ret_rank_norm", "monthly_spearman", "top_k_returns"])
def test_queries_agree_with_sql_on_the_smallest_folder(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for c, x, y in zip(cols, a, b):
            assert x == (pytest.approx(y, abs=1e-6) if isinstance(x, float) else y), (name, c, a, b)


def test_panel_windows_need_no_shuffle(spark):
    plan = plan_of(P.candidates(tables(spark, SMALL).panel))
    assert "Window" in plan and "Exchange" not in plan


def test_scan_reads_needed_columns_only(spark):
    from panelloom.plans.tables import build_panel

    plan = plan_of(build_panel(spark, SMALL))
    assert "l_comment" not in plan and "l_tax" not in plan and "CartesianProduct" not in plan


def test_filters_reach_the_scan(spark):
    from panelloom.sources.securities import load_panel

    t = tables(spark, SMALL)
    plan = load_panel(t.raw.selectExpr("* except (YYYYMM, MthCalDt, MthPrc, MthRet, MthCap)", "YYYYMM", "to_date(MthCalDt) MthCalDt",
                                       "double(MthPrc) MthPrc", "try_cast(MthRet as double) MthRet", "double(MthCap) MthCap"), "1996-01", "1996-12")
    assert "PushedFilters: [IsNotNull(YYYYMM)" in plan_of(plan) and "GreaterThanOrEqual(YYYYMM" in plan_of(plan)


def test_written_tables_can_be_dropped(spark):
    assert read(spark, SMALL, "region").count() == 5
    from panelloom.plans.tables import forget

    forget()
    assert drop_written(spark)

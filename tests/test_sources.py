import datetime as dt
import json

import pytest

from panelloom.operators.store import new_path
from panelloom.sources import constituents as CO
from panelloom.sources import rates as R
from panelloom.sources import results as RS
from panelloom.sources import securities as SE

HEADER = "PERMNO,YYYYMM,MthCalDt,MthPrc,MthRet,MthCap,PrimaryExch,USIncFlg,SecurityType,ShareType,SecuritySubType,MthDelFlg,DelReasonType"


@pytest.fixture
def vendor_csv(tmp_path):
    rows = [
        "1,200001,2000-01-31,-10.5,0.1,100,N,Y,EQTY,NS,COM,N,",
        "1,200002,2000-02-29,11,C,200,N,Y,EQTY,NS,COM,Y,552",
        "1,200002,2000-02-29,11,C,150,N,Y,EQTY,NS,COM,Y,552",
        "2,200001,2000-01-31,5,.,NA,Q,Y,EQTY,SB,ETF,N,",
        "3,200001,bad,5,NaN,7,A,Y,EQTY,AD,X,N,231",
        "4,200001,2000-01-31,5,0.2,7,Z,Y,EQTY,NS,COM,N,",
    ]
    p = tmp_path / "monthly.csv"
    p.write_text("\n".join([HEADER, *rows]))
    return str(p)


def test_text_scan_and_panel(spark, vendor_csv):
    raw = SE.scan(spark, vendor_csv)
    rows = {(r.PERMNO, r.MthCap): r for r in raw.collect()}
    assert rows[(1, 200.0)].MthRet is None and rows[(2, None)].MthRet is None and rows[(3, 7.0)].MthCalDt is None
    p = SE.load_panel(raw, "2000-01", "2000-12", ids=["1", "x", "2"]).orderBy("mi").collect()
    assert [(r.id, r.date, r.price, r.ret, r.mcap) for r in p] == [
        (1, dt.date(2000, 1, 31), 10.5, 0.1, 100.0), (1, dt.date(2000, 2, 29), 11.0, -0.30, 200.0)]
    assert SE.load_panel(raw, "2000-02", "2000-02", handle_delisting=False).first().ret is None
    assert [r.id for r in SE.load_returns(raw, "2000-01", "2000-01").orderBy("id").collect()] == [1, 4]
    with pytest.raises(ValueError):
        SE.universe("moon")


def test_conversion(spark, vendor_csv, tmp_path):
    out = SE.convert(spark, vendor_csv, str(tmp_path / "out"))
    assert out.count() == 6 and out.schema["DelReasonType"].dataType.simpleString() == "string"
    assert SE.preview(out, 2).count() == 2
    assert {r.column: r.type for r in SE.schema_table(out).collect()}["MthCalDt"] == "date"


def test_conversion_keeps_codes_and_late_text(spark, tmp_path):
    """Codes keep their zeros; a column that turns to text after 100,000 lines is text; dates and numbers have their type."""
    n = 100_500
    line = lambda k, cusip, mark, odd: f"{k},200001,2000-01-31,5,0.1,7,N,Y,EQTY,NS,COM,N,,{cusip},000{k % 7},{mark},2000-02-{k % 28 + 1:02d},{k}.5,{odd}"
    rows = [line(k, "00036110", k, "1") for k in range(n)] + [line(n, "0003611A", "late", "2D"), line(n + 1, ".", "NA", "3")]
    path = tmp_path / "long.csv"
    path.write_text("\n".join([HEADER + ",CUSIP,Ticker,Mark,DisExDt,Number,Odd", *rows]))
    out = SE.convert(spark, str(path), str(tmp_path / "out"))
    types = {f.name: f.dataType.simpleString() for f in out.schema}
    assert {c: types[c] for c in ("CUSIP", "Ticker", "Mark", "DisExDt", "Number", "Odd")} == {
        "CUSIP": "string", "Ticker": "string", "Mark": "string", "DisExDt": "date", "Number": "double", "Odd": "string"}
    got = {r.PERMNO: (r.CUSIP, r.Ticker, r.Mark, r.DisExDt, r.Number, r.Odd) for r in out.where(f"PERMNO in (3, {n}, {n + 1})").collect()}
    assert got == {
        3: ("00036110", "0003", "3", dt.date(2000, 2, 4), 3.5, "1"),
        n: ("0003611A", f"000{n % 7}", "late", dt.date(2000, 2, n % 28 + 1), n + 0.5, "2D"),
        n + 1: (None, f"000{(n + 1) % 7}", None, dt.date(2000, 2, (n + 1) % 28 + 1), n + 1.5, "3"),
    }
    assert out.count() == n + 2


@pytest.fixture
def day_folder(tmp_path):
    root = tmp_path / "days"
    (root / "2011").mkdir(parents=True)
    (root / "2012").mkdir()

    def day(name, lines):
        (root / name[:4] / f"{name}.csv").write_bytes(b"\n".join([b"date,wind_code,sec_name,CLOSE", *lines]))

    name = "中国银行".encode("gb18030")
    day("20110428", [b"2011-04-28,AAPL.O," + name + b",10.0", b"2011-04-28,BRK-B.N,\xff\xfe,5.0"])
    day("20110429", [b"2011-04-29,AAPL.O," + name + b",11.0", b"2011-04-29,AAPL.O,x,12.0"])
    day("20110531", [b"2011-05-31,AAPL.O,x,24.0", b"2011-05-31,NONE.N,x,"])
    day("20120131", [b"2012-01-31,AAPL.O,x,30.0"])
    (root / "2011" / "readme.csv").write_text("date,wind_code,sec_name,CLOSE\n2011-04-30,ZZZ.N,x,1\n")
    return str(root)


def test_constituent_files(spark, day_folder):
    d = {(r.date.isoformat(), r.id): r.close for r in CO.read_days(spark, day_folder, "2011-01-01", "2011-12-31").collect()}
    assert d == {("2011-04-28", "AAPL"): 10.0, ("2011-04-28", "BRK-B"): 5.0, ("2011-04-29", "AAPL"): 12.0,
                 ("2011-05-31", "AAPL"): 24.0, ("2011-05-31", "NONE"): None}
    p = CO.build_panel(spark, day_folder, "2011-01-01", "2012-12-31", fill="forward")
    got = {(r.id, r.date.isoformat()): (r.price, r.ret, r.filled) for r in p.collect()}
    assert got == {("AAPL", "2011-05-31"): (24.0, 1.0, False), ("AAPL", "2012-01-31"): (30.0, None, False),
                   ("BRK-B", "2011-05-31"): (5.0, 0.0, True), ("BRK-B", "2012-01-31"): (5.0, None, True)}
    with pytest.raises(FileNotFoundError):
        CO.read_days(spark, day_folder + "x", "2011-01-01", "2011-12-31")
    with pytest.raises(ValueError):
        CO.read_days(spark, day_folder, "2013-01-01", "2013-12-31")


def test_files_without_a_date_column(spark, tmp_path):
    (tmp_path / "2011").mkdir()
    (tmp_path / "2011" / "20110104.csv").write_text("wind_code,i_weight,close,VOLUME\n000001.SZ,1,9.5,3\n600519.SHX,1,,3\n")
    rows = CO.read_days(spark, str(tmp_path), "2011-01-01", "2011-12-31", CO.CN).collect()
    assert [(r.date, r.id, r.close) for r in rows] == [(dt.date(2011, 1, 4), "000001", 9.5)]


def test_price_cache_is_reused(spark, day_folder):
    path = new_path(spark, "monthly")
    a = CO.build_panel(spark, day_folder, "2011-01-01", "2011-12-31", cache=path).count()
    b = CO.build_panel(spark, "/nowhere", "2011-01-01", "2011-12-31", cache=path).count()
    assert a == b > 0


def test_risk_free_text(spark, tmp_path):
    p = tmp_path / "ff.txt"
    p.write_text("header\n,Mkt-RF,SMB,HML,RF\n 196307,  -0.39, -0.41, -0.97, 0.27\n1963,1,2,3,4\n196308,5.0,1\n")
    assert [tuple(r) for r in R.read_risk_free(spark, str(p)).collect()] == [(196307, 1963 * 12 + 6, dt.date(1963, 7, 1), 0.0027)]


def test_wide_forecasts(make):
    w = make([(dt.date(2000, 1, 31), 1.0, None), (dt.date(2000, 2, 29), float("nan"), 2.0)], "date date, `10.1` double, b double")
    assert {(r.mi, r.id): r.score for r in RS.long_forecasts(w).collect()} == {(24000, "10.1"): 1.0, (24001, "b"): 2.0}
    with pytest.raises(ValueError):
        RS.long_forecasts(w.select("date"))


def test_windows(spark, tmp_path):
    assert RS.read_windows(spark, str(tmp_path / "none.json")).count() == 6
    p = tmp_path / "windows.json"
    p.write_text(json.dumps({"windows": [{"train_end": "1963-06", "forecast_start": "1963-07", "forecast_end": "1974-12", "model_dir": "w", "index": 1}]}, indent=2))
    assert [r.model_dir for r in RS.read_windows(spark, str(p)).collect()] == ["w"]


def test_dataset_store(spark):
    store = RS.DatasetStore(spark, new_path(spark, "store"))
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    key = RS.dataset_key("s", ["b", "a"], "x", "y")
    assert key == RS.dataset_key("s", ["a", "b"], "x", "y") != RS.dataset_key("s", ["a"], "x", "y")
    assert store.load(key, build).count() == store.load(key, build).count() == 3 and len(calls) == 1
    assert store.clear()
    with pytest.raises(ValueError):
        RS.read_source(spark, "nothing")


def test_damaged_day_files_are_listed_and_the_others_read(spark, day_folder):
    from pathlib import Path

    year = Path(day_folder) / "2011"
    (year / "20110601.csv").write_bytes(b"date,wind_co")
    (year / "20110602.csv").write_bytes(b"PK\x03\x04\x00\x00\x00\xff\xfe")
    (year / "20110603.csv").write_bytes(b"\n \n")
    (year / "20110606.csv").write_bytes(b"date,wind_code,sec_name,CLOSE\n")
    # columns in another order, and a last line that breaks off
    (year / "20110607.csv").write_bytes(b'CLOSE,date,sec_name,wind_code\r\n7.5,2011-06-07,"a, ""b""",AAPL.O\r\n8.5,2011-06-07,x')
    rows, skipped = CO.tolerant_days(spark, day_folder, "2011-01-01", "2011-12-31")
    assert {(r.file_date.isoformat(), r.status) for r in skipped.collect()} == {
        ("2011-06-01", "truncated"), ("2011-06-02", "undecodable"), ("2011-06-03", "empty"), ("2011-06-06", "truncated"),
    }
    got = {(r.date.isoformat(), r.id): r.close for r in rows.collect()}
    assert got == {("2011-04-28", "AAPL"): 10.0, ("2011-04-28", "BRK-B"): 5.0, ("2011-04-29", "AAPL"): 12.0,
                   ("2011-05-31", "AAPL"): 24.0, ("2011-05-31", "NONE"): None, ("2011-06-07", "AAPL"): 7.5}


def test_a_python_function_maps_each_code_once(spark, day_folder):
    calls = spark.sparkContext.accumulator(0)

    def ticker(code):
        calls.add(1)
        return None if code.startswith("NONE") else code.split(".")[0].lower()

    d = CO.read_days(spark, day_folder, "2011-01-01", "2012-12-31", map_ticker=ticker).collect()
    assert {r.id for r in d} == {"aapl", "brk-b"} and calls.value == 3
    codes = spark.createDataFrame([("a.N",), ("a.N",), (None,)], "wind_code string")
    assert CO.mapped_codes(codes, str.lower).collect() == [("a.N", "a.n")]


def test_wide_tables_in_blocks_take_any_number_of_ids(make):
    days = [dt.date(2000, m, 1) for m in range(1, 7)]
    rows = [(f"s{k}", d, float(k * 100 + d.month)) for k in range(40) for d in days if (k + d.month) % 5] + [("gone", days[0], None)]
    long = make(rows, "id string, date date, price double")
    wide = RS.wide_blocks(long, "price", ids=7)
    sizes = wide.selectExpr("block", "date", "cardinality(values) AS n").collect()
    assert len({r.block for r in sizes}) == 6 and max(r.n for r in sizes) < 40 and len(sizes) > len(days)
    back = RS.long_blocks(wide, "price").collect()
    assert sorted((r.id, r.date, r.price) for r in back) == sorted(r for r in rows if r[2] is not None)
    assert RS.wide_blocks(long.limit(0), "price").collect() == []


def test_price_columns_hold_any_number_of_ids_under_one_plan(make):
    day = dt.date(2000, 1, 31)
    rows = [(k, dt.date(2000, m, 28), None if (k + m) % 5 == 0 else float("nan") if (k + m) % 7 == 0 else k + m / 10) for k in range(90) for m in (1, 2, 3)]
    prices = make([*rows, (7_000, day, 3.5)], "id long, date date, price double")
    names, wide = CO.price_columns(prices, columns=8)
    assert wide.columns == ["block", "date", *[f"p{k}" for k in range(8)]]
    assert names.count() == 91 and names.filter("slot > 7").isEmpty() and names.select("block", "slot").distinct().count() == 91
    got = sorted((r.id, r.date, r.price) for r in CO.long_price_columns(names, wide).collect())
    assert got == sorted((str(k), d, p) for k, d, p in [*rows, (7_000, day, 3.5)] if p is not None and p == p)

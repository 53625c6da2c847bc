import datetime as dt

import pytest
from helpers import bars_frame, day, path_rows
from pyspark.sql import functions as F

from barquet import schemas
from barquet.sources import bars as rest
from barquet.sources import ingest, text

D = dt.date.fromisoformat


def test_append_only_finished_bars(spark):
    """Two symbols, days missing on either side, late and repeated arrivals, one bar of the current day."""
    bars = "market string, ticker string, d date, close double"
    existing = spark.createDataFrame([("M", "P", day(3), 1.0), ("M", "P", day(8), 1.0), ("M", "Q", day(5), 1.0)], bars)
    arrivals = [("P", 4, 7.0), ("P", 11, 7.1), ("P", 9, 7.2), ("P", 11, 7.3), ("Q", 5, 8.0), ("Q", 6, 8.1), ("Q", 12, 8.2), ("R", 1, 9.0)]
    fetched = spark.createDataFrame([("M", t, day(i), c, n) for n, (t, i, c) in enumerate(arrivals)], bars + ", seq int")
    got = ingest.append_bars(existing, fetched, day(12), "seq")
    fresh = {(r["ticker"], r["d"]): r["close"] for r in got.collect() if r["close"] > 1}
    assert fresh == {("P", day(9)): 7.2, ("P", day(11)): 7.1, ("Q", day(6)): 8.1, ("R", day(1)): 9.0}
    assert ingest.append_bars(got, fetched, day(12), "seq").count() == got.count() == 7


def test_bars_round_trip_and_naive_times(spark, tmp_path):
    bars = bars_frame(spark, path_rows("A", [1.0, 2.0]) + path_rows("K", [3.0], market="KOSPI")).withColumn("currency", F.lit("USD"))
    rest.save_bars(bars, str(tmp_path / "bars"))
    back = rest.load_bars(spark, str(tmp_path / "bars"))
    assert back.count() == 3 and rest.load_bars(spark, str(tmp_path / "bars"), "KOSPI").count() == 1
    window = rest.load_bars(spark, str(tmp_path / "bars"), start="2020-01-02", end="2020-01-03")
    assert [(r["ticker"], r["d"]) for r in window.collect()] == [("A", day(1))]
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert set(schemas.BARS_AT_REST.fieldNames()) <= set(back.columns)
    raw = spark.createDataFrame([("2024-01-02T00:00:00",), ("2024-01-02T09:00:00+09:00",), ("2024-01-02T00:00:00Z",)], "ts string")
    assert rest.parse_bars(raw).select("ts").distinct().count() == 1


def test_content_hash_ignores_order_and_sees_changes(spark):
    rows = path_rows("A", [1.0, 2.0, 3.0]) + path_rows("B", [4.0, 5.0])
    h = lambda r: ingest.content_hashes(bars_frame(spark, r)).first()["content_hash"]
    same = h(rows)
    assert h(rows[::-1]) == same
    changed = rows[:-1] + [rows[-1][:-1] + (999,)]
    assert h(changed) != same
    stored = ingest.manifest(bars_frame(spark, rows))
    assert (stored.first()["n_symbols"], stored.first()["n_bars"]) == (2, 5)
    assert [(r["ticker"], r["n_bars"]) for r in ingest.manifest_symbols(bars_frame(spark, rows)).orderBy("ticker").collect()] == [("A", 3), ("B", 2)]
    assert ingest.verify(stored, bars_frame(spark, rows[::-1])).first()["verified"]
    assert not ingest.verify(stored, bars_frame(spark, changed)).first()["verified"]


def test_manifest_lists_its_symbols(spark):
    rows = path_rows("B", [1.0, 2.0]) + path_rows("A", [4.0, 5.0, 6.0]) + path_rows("K", [3.0], market="KOSPI")
    got = {r["market"]: (r["symbols"], r["n_symbols"], r["n_bars"]) for r in ingest.manifest(bars_frame(spark, rows)).collect()}
    assert got == {"NASDAQ": (["A", "B"], 2, 5), "KOSPI": (["K"], 1, 1)}


def test_chart_items(spark):
    body = '<item data="20240102|1|2|0.5|1.5|10" /><item data="20240103|1|2" /><item data="2024XX03|1|2|1|1|1" />' \
           '<item data="20240104|1|2|1|0|1" /><item data="20200101|1|2|1|1|1" />'
    df = spark.createDataFrame([("T", body)], "ticker string, text string")
    assert [str(r["d"]) for r in text.chart_items(df, ["ticker"]).orderBy("d").collect()] == ["2020-01-01", "2024-01-02"]
    got = text.chart_items(df, ["ticker"], years=1).collect()
    assert len(got) == 1 and got[0]["volume"] == 10 and got[0]["low"] == 0.5


def test_constituents(spark, tmp_path):
    for column in ("Symbol", "symbol"):
        path = tmp_path / f"{column}.csv"
        path.write_text(f"{column},Name\nBRK.B,x\n AAPL ,y\n,z\n")
        assert sorted(r["ticker"] for r in text.load_constituents(spark, str(path)).collect()) == ["AAPL", "BRK-B"]
    with pytest.raises(ValueError):
        text.constituents(spark.createDataFrame([("a",)], "name string"))


def test_jsonl_skips_malformed_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"experiment_id": "a", "metrics": {"x": 1.0}}\n{broken\n\n{"kind": "no id"}\n{"experiment_id": "b"}\n')
    got = text.load_jsonl(spark, str(path), schemas.EXPERIMENT, "experiment_id")
    assert sorted(r["experiment_id"] for r in got.collect()) == ["a", "b"]


def test_account_snapshot_cash_falls_back(spark):
    dom = '{"output1":[{"pdno":" K77 ","hldg_qty":"31","prpr":"812.5"},{"pdno":"none","hldg_qty":"0","prpr":"4"}],' \
          '"output2":[{"prvs_rcdl_excc_amt":"","nxdy_excc_amt":"640","dnca_tot_amt":"5150","nass_amt":"9125"}]}'
    ovr = '{"output1":[{"ovrs_pdno":"USX","ovrs_cblc_qty":"8.0","now_pric2":"72.25"}],"output2":{"frcr_pchs_amt1":"640.5"}}'
    late = '{"output1":[],"output2":[{"prvs_rcdl_excc_amt":"","nxdy_excc_amt":"","dnca_tot_amt":"5150","nass_amt":"1"}]}'
    rows = [("first", dom, ovr), ("empty", '{"output1":[],"output2":[]}', "{}"), ("deposit", late, ovr)]
    cash, positions = text.account_snapshots(spark.createDataFrame(rows, "account string, domestic string, overseas string"))
    got = {r["account"]: (r["cash_krw"], r["nass_krw"]) for r in cash.collect()}
    assert got == {"first": (0.0, 9125.0), "empty": (0.0, 0.0), "deposit": (4509.5, 1.0)}
    held = sorted((r["account"], r["market"], r["ticker"], r["qty"]) for r in positions.collect())
    assert held == [("deposit", "NASDAQ", "USX", 8), ("first", "KOSPI", "K77", 31), ("first", "NASDAQ", "USX", 8)]


def test_fill_pages(spark):
    body = '{"output1":[{"odno":"1","pdno":"T","sll_buy_dvsn_cd":"02","tot_ccld_qty":"4","avg_prvs":"0","tot_ccld_amt":"100"},' \
           '{"odno":"2","pdno":"T","sll_buy_dvsn_cd":"01","tot_ccld_qty":"bad"},{"odno":"3","pdno":"T","sll_buy_dvsn_cd":"07","tot_ccld_qty":"1","avg_prvs":"9.5"}]}'
    got = text.domestic_fills(spark.createDataFrame([(body,)], "body string")).orderBy("order_id").collect()
    assert [(r["order_id"], r["side"], r["qty"], r["price"]) for r in got] == [("1", "BUY", 4, 25.0), ("3", "07", 1, 9.5)]


def test_gated_update(spark):
    prior = bars_frame(spark, path_rows("GOOD", [1.0]) + path_rows("KEPT", [2.0]))
    fetched = bars_frame(spark, path_rows("GOOD", [5.0]) + path_rows("KEPT", [6.0]) + path_rows("NEW", [7.0]))
    verdicts = spark.createDataFrame([("NASDAQ", "GOOD", True), ("NASDAQ", "KEPT", False), ("NASDAQ", "NEW", False)], "market string, ticker string, passed boolean")
    served, status = ingest.gated_update(prior, fetched, verdicts)
    assert {r["ticker"]: r["close"] for r in served.collect()} == {"GOOD": 5.0, "KEPT": 2.0}
    assert {r["ticker"]: r["status"] for r in status.collect()} == {"GOOD": "ok", "KEPT": "quality_fail_transient", "NEW": "quality_fail"}


def test_membership_is_point_in_time(spark):
    log = spark.createDataFrame(
        [(day(0), "u", [("KOSPI", "A")]), (day(5), "u", [("KOSPI", "B")])],
        "as_of_date date, universe_id string, symbols array<struct<market:string,ticker:string>>",
    )
    bars = bars_frame(spark, [("KOSPI", t, day(i), 1.0, 1.0, 1.0, 1.0, 1) for t in "AB" for i in (-1, 0, 4, 5)])
    members = ingest.membership(log)
    assert members.first()["currency"] == "KRW" and members.first()["source_symbol"].endswith(".KS")
    got = sorted((r["ticker"], r["d"]) for r in ingest.members_as_of(bars, members).collect())
    assert got == [("A", day(0)), ("A", day(4)), ("B", day(5))]


def test_symbol_falls_back_row_by_row(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("Symbol", "symbol", "name")])
    rows = spark.createDataFrame([("UP.A", "low", "1"), (None, "low.b", "2"), ("", "low", "3"), ("  ", "low", "4"), (None, None, "5")], schema)
    got = text.constituents(rows)
    assert got.columns == ["name", "ticker"]
    assert sorted((r["name"], r["ticker"]) for r in got.collect()) == [("1", "UP-A"), ("2", "low-b"), ("3", "low")]


def test_json_lines_are_the_same_for_any_columns(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"experiment_id": "a", "metrics": {"x": 1.0}}\n{"experiment_id": "b", "metrics": "none"}\n{"experiment_id": "c"}\n')
    log = text.load_jsonl(spark, str(path), schemas.EXPERIMENT, "experiment_id")
    assert log.count() == 2 and log.select("kind").count() == 2
    assert [r["experiment_id"] for r in log.orderBy("line").select("experiment_id").collect()] == ["a", "c"]


def test_new_rows_come_once_per_key(spark):
    log = spark.createDataFrame([("a", 1)], "k string, v int")
    rows = spark.createDataFrame([("a", 9, 0), ("b", 7, 2), ("b", 8, 1), ("c", 5, 3)], "k string, v int, at int")
    got = ingest.new_rows(log, rows, ["k"], "at").collect()
    assert sorted((r["k"], r["v"]) for r in got) == [("b", 8), ("c", 5)]
    assert ingest.new_rows(log, rows, ["k"]).count() == 2


def test_first_by_arrival_wins(spark):
    bars = "market string, ticker string, d date, close double, seq int"
    fetched = spark.createDataFrame([("M", "T", D("2026-01-05"), 9.0, 1), ("M", "T", D("2026-01-05"), 5.0, 2)], bars)
    existing = fetched.limit(0).drop("seq")
    assert [r["close"] for r in ingest.append_bars(existing, fetched, "2026-02-01", "seq").collect()] == [9.0]


@pytest.mark.parametrize("n, group", [(3, ["g"]), (3, []), (1500, ["g"])])
def test_first_n(spark, n, group):
    df = spark.range(4000).selectExpr("id % 3 AS g", "id", "(id * 7919) % 4001 AS v")
    got = ingest.first_n(df, n, group, [F.col("v").desc(), "id"])
    rows = {}
    for r in df.collect():
        rows.setdefault(r["g"] if group else 0, []).append((-r["v"], r["id"]))
    want = {(i, k + 1) for found in rows.values() for k, (_, i) in enumerate(sorted(found)[:n])}
    assert {(r["id"], r["rank"]) for r in got.collect()} == want


def test_first_n_is_the_same_whatever_the_row_order(spark):
    """Salts are hashes of the rows, so a map task that runs again with another order gives the same rows."""
    df = spark.range(3000).selectExpr("id", "id % 5 AS v", "map('k', id) AS m")
    kept = [sorted(r["id"] for r in ingest.first_n(df.repartition(p), 40, [], ["v", "id"]).collect()) for p in (1, 3, 11)]
    assert kept[0] == kept[1] == kept[2] == [5 * i for i in range(40)]


def test_lines_of_many_splits_and_files_keep_their_order(spark, tmp_path):
    import json

    want = []
    for name, n in (("a", 300), ("b", 7), ("c", 500)):
        records = [json.dumps({"experiment_id": f"{name}{i}", "kind": "x" * (i % 37)}) for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(["{bad", *records]) + "\n")
        want += [f"{name}{i}" for i in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        log = text.load_jsonl(spark, str(tmp_path), schemas.EXPERIMENT, "experiment_id")
        assert log.rdd.getNumPartitions() > 10
        assert [r["experiment_id"] for r in log.orderBy("line").collect()] == want
        keyed = log.withColumn("k", F.substring("experiment_id", 1, 1))
        first = ingest.new_rows(keyed.limit(0), keyed, ["k"], "line")
        assert sorted(r["experiment_id"] for r in first.collect()) == ["a0", "b0", "c0"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_concept_bodies(spark):
    point = '{"start": "2023-01-01", "end": "2023-03-31", "filed": "2023-04-20", "val": %s, "fy": 2023, "form": "10-Q"}'
    bodies = [
        ("usd", '{"cik": 1, "units": {"EUR": [%s], "USD": [%s, %s]}}' % (point % 1, point % 2, point % '"n/a"')),
        ("shares", '{"units": {"pure": [%s], "shares": [%s]}}' % (point % 3, point % "4.5")),
        ("other", '{"units": {"JPY": [%s], "EUR": [%s]}}' % (point % 5, point % 6)),
        ("emptyusd", '{"units": {"USD": [], "shares": [%s]}}' % (point % 7)),
        ("baddates", '{"units": {"USD": [{"end": "soon", "filed": "2023-04-20", "val": 1}, {"filed": "2023-04-20", "val": 1}, {"end": "2023-03-31", "filed": "2023-05-01", "val": 8}]}}'),
        ("noobject", "<html>Not found</html>"), ("nothing", None), ("nounits", '{"cik": 1}'), ("empty", '{"units": {}}'),
    ]
    got = text.concept_points(spark.createDataFrame(bodies, "k string, body string"), ["k"]).collect()
    assert sorted((r["k"], r["unit"], r["seq"], r["val"], str(r["filed"])) for r in got) == [
        ("baddates", "USD", 0, 8.0, "2023-05-01"), ("other", "JPY", 0, 5.0, "2023-04-20"),
        ("shares", "shares", 1, 4.5, "2023-04-20"), ("usd", "USD", 1, 2.0, "2023-04-20"),
    ]
    two = spark.createDataFrame(
        [("T", "First", bodies[3][1]), ("T", "Second", bodies[2][1]), ("U", "First", bodies[0][1]), ("U", "Second", bodies[2][1])],
        "ticker string, concept string, body string",
    )
    # the first concept with points: an empty preferred unit is no data, so the next concept counts
    series = text.preferred_series(text.concept_points(two, ["ticker", "concept"]), ["ticker"], concepts=["First", "Second"])
    assert sorted((r["ticker"], r["concept"], r["val"]) for r in series.collect()) == [("T", "Second", 5.0), ("U", "First", 2.0)]


YEARS = ("2019", "2020", "2021")


def _bars_of(spark, ticker, years, close, market="M"):
    return [(market, ticker, D(f"{y}-0{m}-03"), close, close, close, close, 1) for y in years for m in (1, 5)]


def _stored(spark, path):
    return sorted((r["market"], r["ticker"], str(r["d"]), r["close"]) for r in rest.load_bars(spark, path).collect())


def _files(path):
    return {str(f.relative_to(path)) for f in path.rglob("part-*") if "_updates" not in str(f)}


def test_an_update_touches_its_partitions_and_repeats_safely(spark, tmp_path, monkeypatch):
    path = tmp_path / "bars"
    old = _bars_of(spark, "A", YEARS, 1.0) + _bars_of(spark, "B", YEARS, 2.0) + _bars_of(spark, "Z", YEARS, 5.0, "N") + _bars_of(spark, "ONLY", ["2017"], 3.0)
    frame = lambda rows: bars_frame(spark, rows).withColumn("currency", F.lit("USD"))
    rest.save_bars(frame(old), str(path))
    untouched = {f for f in _files(path) if "market=N" in f}
    fetched = frame(_bars_of(spark, "A", YEARS[1:], 10.0) + _bars_of(spark, "B", YEARS, 20.0) + _bars_of(spark, "ONLY", ["2018"], 30.0) + _bars_of(spark, "NEW", YEARS[2:], 40.0))
    verdicts = spark.createDataFrame([("M", "A", True), ("M", "B", False), ("M", "ONLY", True), ("M", "NEW", False)], "market string, ticker string, passed boolean")
    want = sorted(
        (m, t, str(d), c)
        for m, t, d, _, _, _, c, _ in _bars_of(spark, "A", YEARS[1:], 10.0) + _bars_of(spark, "B", YEARS, 2.0) + _bars_of(spark, "Z", YEARS, 5.0, "N") + _bars_of(spark, "ONLY", ["2018"], 30.0)
    )
    before = _stored(spark, str(path))

    # dies before the commit: nothing stored has changed
    real = ingest.gated_update
    monkeypatch.setattr(ingest, "gated_update", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        ingest.store_update(spark, str(path), fetched, verdicts, "u7")
    assert _stored(spark, str(path)) == before
    monkeypatch.setattr(ingest, "gated_update", real)

    # dies after the commit, with one partition written: a second call repeats the rest from what was committed
    status = ingest.store_update(spark, str(path), fetched, verdicts, "u7")
    assert {r["ticker"]: r["status"] for r in status.collect()} == {"A": "ok", "B": "quality_fail_transient", "ONLY": "ok", "NEW": "quality_fail"}
    assert _stored(spark, str(path)) == want
    import shutil

    shutil.rmtree(path / "market=M" / "year=2020")
    ingest.store_update(spark, str(path), fetched.limit(0), verdicts.limit(0), "u7")
    assert _stored(spark, str(path)) == want
    assert untouched == {f for f in _files(path) if "market=N" in f}
    assert not (path / "market=M" / "year=2017").exists()

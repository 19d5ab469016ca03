"""A choice of plans against their oracles on the smallest tables, others on hand-computed cases; macros, selection, sources and streams on literals."""

import os
import statistics

import pytest

SF = "/root/testdata/sf0.001"


def rounded(v):
    if v is None or v != v:
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", ["a1_competition_context", "a2_supplier_context", "a11_leave_one_out_median", "a21_bid_opening_features", "w7_prior_three_years", "w15_mid_rank", "j16_split_contracts", "r6_amount_decision", "m14_rank_auc", "f_strict_dates", "st_session_window", "m0_screening_index", "k9_letter_codes", "a3_type_concentration", "m15_average_precision", "m21_false_discovery", "r3_possible_duplicates", "w12_first_supplier_date"])
def test_plan_equals_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tenderlens.plans import catalog

    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    c = duckdb.connect()
    for p in os.listdir(SF):
        c.execute(f"create view {p[:-8]} as select * from read_parquet('{SF}/{p}')")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(rounded(r[k]) for k in cols) for r in df.collect()), key=str)
    cur = c.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(rounded(r[names.index(k)]) for k in cols) for r in cur.fetchall()), key=str)
    assert got == want


def run_both(spark, folder, name, **tables):
    """Sorted rows of a plan in Spark and of its oracle in DuckDB over the given DataFrames."""
    duckdb = pytest.importorskip("duckdb")
    from tenderlens.plans import catalog

    c = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = catalog.QUERIES[name](spark, str(folder))
    cur = c.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = [tuple(r[names.index(k)] for k in df.columns) for r in cur.fetchall()]
    return sorted(map(tuple, df.collect()), key=str), sorted(want, key=str)


def test_formula_guard_keeps_whole_texts(spark, tmp_path):
    long = "word " * 30
    texts = [long, "=" + long, " \t=1", "\u00a0\u3000+1", "\x01@x", "\nplain", "plain\n=1", "a=1", "", None, " -" + long]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, want = run_both(spark, tmp_path, "k2_formula_guard", documents=df)
    assert got == want == sorted(((i, "'" + t if i in (1, 2, 3, 4, 5, 10) else t) for i, t in enumerate(texts)), key=str)


LINES = "l_orderkey long, l_suppkey long, l_discount double, l_extendedprice double, l_shipdate date"


def test_quote_pairs(spark, tmp_path):
    import datetime as dt

    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    quotes = [(1, 0, 5, 7), (2, 100, 9, 7), (3, 365, 1, 3), (4, 366, 7, 5), (5, 5000, 1, 1), (6, 9000, None, 2), (7, 9001, 1, 3), (8, 9002, 5, 3), (9, 5001, 4, 6)]
    rows = [(o, s, r if r is None else r / 100, 1.0, day(n)) for o, n, x, y in quotes for s, r in ((1, x), (2, y))]
    got, want = run_both(spark, tmp_path, "j13_quote_pairs", lineitem=spark.createDataFrame(rows, LINES))
    assert got == want == [
        (1, 1, 2, 2, 2, "signal"), (2, 1, 2, 2, 3, "signal"), (3, 1, 2, 2, 3, "signal"), (4, 1, 2, 2, 2, "signal"), (6, 1, 2, None, 0, "unknown"),
        (7, 1, 2, 2, 1, "unknown"), (8, 1, 2, 2, 1, "unknown"), (9, 1, 2, 2, 0, "clear"),
    ]


def test_rotation(spark, tmp_path):
    import datetime as dt

    # client 1: suppliers 1 and 2 take turns in four openings within a year; client 2: supplier 1 wins all; client 3: a tie
    wins = [(1, 1, 0, 1), (2, 1, 50, 2), (3, 1, 100, 1), (4, 1, 200, 1), (5, 1, 900, 1)] + [(k, 2, k, 1) for k in range(6, 10)] + [(10, 3, 0, None)]
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    lines = [(o, s, 0.0, 1.0 if w in (s, None) else 2.0, day(n)) for o, _, n, w in wins for s in (1, 2)]
    orders = spark.createDataFrame([(o, c, day(n)) for o, c, n, _ in wins], "o_orderkey long, o_custkey long, o_orderdate date")
    got, want = run_both(spark, tmp_path, "j12_rotation", lineitem=spark.createDataFrame(lines, LINES), orders=orders)
    assert got == want
    assert {r[1]: (r[2], r[3], r[4]) for r in got} == {
        1: (1, 1, "signal"), 2: (2, 1, "signal"), 3: (1, 1, "signal"), 4: (1, 1, "signal"), 5: (1, 0, "clear"),
        **{k: (1, 0, "clear") for k in range(6, 10)}, 10: (None, 0, "unknown"),
    }


def test_snapshot_diff_looks_in_both_directions(spark, tmp_path):
    orders = spark.createDataFrame([(1, "F"), (2, "O"), (3, "P"), (4, "F"), (5, None)], "o_orderkey long, o_orderstatus string")
    lines = spark.createDataFrame([(1, "F"), (1, "F"), (2, "O"), (2, "F"), (3, "O"), (3, "F"), (5, "O"), (6, "F")], "l_orderkey long, l_linestatus string")
    got, want = run_both(spark, tmp_path, "k10_snapshot_diff", orders=orders, lineitem=lines)
    assert got == want == [(1, "common"), (2, "changed"), (3, "common"), (4, "only-before"), (5, "changed"), (6, "only-after")]


def test_leave_one_out_median_against_brute_force(spark):
    from tenderlens.plans import catalog

    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    rows = spark.sql(f"SELECT c_nationkey, datediff(l_shipdate, o_orderdate) d FROM parquet.`{SF}/lineitem.parquet` JOIN parquet.`{SF}/orders.parquet` ON l_orderkey = o_orderkey JOIN parquet.`{SF}/customer.parquet` ON o_custkey = c_custkey WHERE l_shipdate >= o_orderdate").collect()
    groups = {}
    for b, d in rows:
        groups.setdefault(b, []).append(d)
    for r in catalog.QUERIES["a11_leave_one_out_median"](spark, SF).collect():
        others = list(groups[r.buyer])
        others.remove(r.delay)
        assert r.baseline == (statistics.median(others) if len(others) >= 10 else None)


def test_macros(spark):
    from pyspark.sql import functions as F

    from tenderlens.functions import exprs as x

    r = spark.range(1).select(
        x.strict_date(F.lit("2024-6-1")).alias("a"), x.strict_date(F.lit("2023-02-29")).alias("b"), x.strict_date(F.lit("2024-02-29")).cast("string").alias("c"),
        x.fold_text(F.lit("Élan NIÑO")).alias("d"), x.graduated(F.lit(60.0), 0, 120, 8, 16).alias("e"),
        x.check_status(F.lit("yes"), F.lit(True), F.lit(None).cast("boolean")).alias("f"), x.check_status(F.lit(None).cast("string"), F.lit(True), F.lit(True)).alias("g"),
        x.formula_guard(F.lit(" =1+1")).alias("h"), x.csv_cell(F.lit('a"b,c')).alias("i"), x.percent_increase(F.lit(100.0), F.lit(125.0)).alias("j"),
    ).first()
    assert tuple(r) == (None, None, "2024-02-29", "elan nino", 12.0, "clear", "unknown", "' =1+1", '"a""b,c"', 25.0)


def test_selection_round_trip_and_nulls_last(spark):
    from tenderlens.operators.selection import ViewSpec, select

    spec = ViewSpec(search="école", minimum=5, sort="amount-asc", equals={"status": "x"})
    assert ViewSpec.decode(spec.encode()) == spec
    df = spark.createDataFrame([("1", 3.0, None, "b"), ("2", None, 1.0, "a"), ("3", 9.0, 2.0, "École")], "id string, amount double, score double, buyer string")
    assert [r.id for r in select(df, ViewSpec(sort="amount")).collect()] == ["3", "1", "2"]
    assert [r.id for r in select(df, ViewSpec(sort="amount-asc")).collect()] == ["1", "3", "2"]
    assert [r.id for r in select(df, ViewSpec(search="ecole"), ["buyer"]).collect()] == ["3"]


def test_csv_reader(spark, tmp_path):
    from tenderlens.sources.readers import read_csv

    p = tmp_path / "a.csv"
    p.write_text('Reference;Authority;Title;Value\n1;"B; C";"two\nlines";10.5\n;;;\n2;D;"say ""x""";\n', encoding="utf-8")
    rows = sorted(tuple(r) for r in read_csv(spark, str(p)).collect())
    assert rows == [("1", "B; C", "two\nlines", 10.5), ("2", "D", 'say "x"', None)]


def test_upsert_stream_equals_batch(spark, tmp_path):
    from tenderlens.streaming.ingest import latest, upsert_batches

    rows = [(1, "a", 1), (1, "b", 3), (2, "c", 2), (1, "d", 2), (2, "e", 5)]
    df = spark.createDataFrame(rows, "k int, v string, t int")
    for i, r in enumerate(rows):
        spark.createDataFrame([r], df.schema).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = upsert_batches(stream, str(tmp_path / "state"), str(tmp_path / "cp"), ["k"], ["t"]).start()
    q.awaitTermination()
    last = max(int(p) for p in os.listdir(tmp_path / "state"))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/state/{last}").collect())) == sorted(map(tuple, latest(df, ["k"], ["t"]).collect()))


def lines(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def test_amount_decision_by_hand(spark, tmp_path):
    rows = [(1, "A", 20.0), (1, "R", 30.0), (2, "A", 20.0), (2, "A", 25.0), (2, "R", 25.0), (2, "R", 40.0), (3, "A", 20.0), (3, "A", 25.0), (3, "R", 30.0), (4, "A", 1.0), (4, "R", 30.0), (5, "R", 30.0), (5, "R", 31.0), (6, "A", 2.0), (7, "N", 30.0)]
    df = lines(spark, rows, "l_partkey long, l_returnflag string, l_quantity double")
    got, want = run_both(spark, tmp_path, "r6_amount_decision", lineitem=df)
    assert got == want and [r[:2] for r in got] == [(1, 20.0), (2, 25.0), (3, None), (4, 30.0), (5, None), (6, 0.0)]


def test_bid_features_by_hand(spark, tmp_path):
    rows = [(1, 10.0), (1, 12.0), (1, 14.0), (2, 10.0), (2, 12.0), (3, 5.0), (3, 8.0), (3, 8.0), (4, 8.0), (4, 8.0), (4, 8.0), (5, -1.0), (5, 3.0), (5, 4.0)]
    got, want = run_both(spark, tmp_path, "a21_bid_opening_features", lineitem=lines(spark, rows, "l_orderkey long, l_extendedprice double"))
    got = {r[0]: r[1:] for r in got}
    assert got == {r[0]: r[1:] for r in want}
    assert got[1] == (3, 3, round(statistics.pstdev([10, 12, 14]) / 12, 6), round(2 / statistics.stdev([12, 14]), 4))
    assert got[2] == (2, 2, None, None) and got[3][3] == float("inf") and got[4][3] == 0.0 and got[5] == (3, 2, None, None)


def test_index_by_hand():
    import duckdb

    from tenderlens.plans.dialect import Duck
    from tenderlens.plans.screening import CHECKS, scored

    names = list(CHECKS)
    sql = scored(Duck())
    tail = sql[sql.rindex("scored AS (SELECT") + len("scored AS (") : -1]
    row = lambda i, s, p: "SELECT {} AS order_id, 1 AS part_id, 1 AS supplier, 1 AS offers, 1 AS quantity, 2.0 AS amount, ".format(i) + ", ".join(f"'{s.get(n, 'clear')}' AS s{k}, {p.get(n, 9.0)}::DOUBLE AS p{k}" for k, n in enumerate(names, 1))
    cases = [
        ({"single-bid": "signal", "repeated-single-bid": "signal"}, {"single-bid": 12.0, "repeated-single-bid": 20.0}, 20.0, 1),
        ({"single-bid": "signal", "direct-award": "signal"}, {"single-bid": 12.0, "direct-award": 18.0}, 30.0, 2),
        ({}, {"late-publication": -5.0}, 0.0, 0),
        ({"single-bid": "signal"}, {"single-bid": 12.0, "late-publication": -5.0}, 7.0, 1),
        ({n: "unknown" for n in names}, {}, None, 0),
    ]
    facts = " UNION ALL ".join(row(i, s, p) for i, (s, p, *_) in enumerate(cases))
    got = duckdb.sql(f"WITH facts AS ({facts}) SELECT score, families FROM ({tail}) ORDER BY order_id").fetchall()
    assert got == [(score, families) for *_, score, families in cases]


VERSIONS = "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_shipdate date"


def test_versions_conflicts_and_windows(spark, tmp_path):
    from datetime import date

    rows = [
        (1, 7, 1, 1, 100.0, date(2020, 1, 1)), (1, 8, 1, 2, 100.5, date(2020, 1, 1)), (1, 9, 1, 3, 300.0, date(2020, 6, 1)),
        (2, 7, 1, 1, 50.0, date(2020, 1, 2)), (2, 7, 1, 1, 60.0, date(2020, 1, 2)), (2, 8, 1, 2, 70.0, date(2020, 1, 2)),
        (3, 7, 1, 1, 10.0, None), (3, 8, 1, 1, 10.0, date(2023, 1, 1)), (4, 7, 1, 1, 5.0, date(2023, 1, 1)),
    ]
    lines = spark.createDataFrame(rows, VERSIONS)
    both = lambda name: run_both(spark, tmp_path / name, name, lineitem=lines)
    got, want = both("a28_conditional_modifications")
    assert got == want == [(1, 1), (2, 0), (3, None), (4, None)]  # 3 has a line without a date; 4 is too young
    got, want = both("r5_modification_conflicts")
    assert got == want == [(2, 1, 2, "amount;"), (3, 1, 2, "holder;date;")]
    got, want = both("w16_disqualified_before")
    assert got == want == [(1, 7, 1), (2, 7, 1), (4, 7, 0)]  # 3 has two lowest bids, no winner
    got, want = both("o12_nearest_bids")
    assert got == want == [(1, 100.0, 100.5, True), (2, 50.0, 60.0, False), (3, 10.0, 10.0, True), (4, 5.0, None, None)]
    got, want = both("r8_offers_conflict")
    assert got == want == [(1, 1, None, True), (2, 1, None, True), (3, 1, 1, False), (4, 1, 1, False)]


def test_upsert_takes_each_field_from_the_first_source_that_has_it(spark, tmp_path):
    from datetime import datetime

    rows = [(1, 1, "b", datetime(2024, 1, 2), 5.0, "x"), (2, 1, "a", datetime(2024, 1, 1), None, "y"), (3, 1, "b", datetime(2024, 1, 3), 6.0, None), (4, 2, "c", datetime(2024, 1, 1), None, None)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double, props string")
    got, want = run_both(spark, tmp_path, "x6_upsert_source_priority", events=events)
    assert got == want == [(1, 6.0, "y"), (2, None, None)]


def test_coverage_gate_asks_for_731_days(spark, tmp_path):
    from datetime import date, timedelta

    days = [date(2020, 1, 1) + timedelta(k) for k in range(731)] + [date(2023, 1, 1)]
    lines = spark.createDataFrame([(d,) for d in days], "l_shipdate date")
    orders = spark.createDataFrame([(days[365],), (days[364],), (days[366],), (date(2023, 1, 1),), (date(2030, 1, 1),), (None,)], "o_orderdate date")
    got, want = run_both(spark, tmp_path, "st7_completeness_gate", lineitem=lines, orders=orders)
    assert got == want == [("complete", 1), ("unknown", 5)]


def test_tumbling_window_rounds_seconds(spark, tmp_path):
    stamps = ["2024-01-01 23:59:59.499999", "2024-01-01 23:59:59.5", "2024-01-01 23:59:59.6", "2024-01-02 00:00:00", "2024-01-02 23:59:58.5", None]
    df = spark.createDataFrame([(t, "view", float(2**i)) for i, t in enumerate(stamps)], "ts string, event_type string, value double").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type", "value")
    got, want = run_both(spark, tmp_path, "st_tumbling_window", events=df)
    assert got == want == [(1704067200, "view", 1, 1.0), (1704153600, "view", 4, 30.0), (None, "view", 1, 32.0)]


def test_bid_features_of_nearly_equal_bids(spark, tmp_path):
    rows = [(1, 19193.4), (1, 72010.04), (1, 72010.06)] + [(2, 1.0), (2, 100000.0), (2, 100000.0 + 2**-36), (3, 5.0), (3, 7.0 + 2**-50), (3, 7.0)]
    rows += [(10 + i, x) for i in range(400) for x in (900.5 + 7.31 * i, 50000 + 97.03 * i, 50000.01 + 97.03 * i, *[50000.02 + 97.03 * i] * (i % 3))]
    got, want = run_both(spark, tmp_path, "a21_bid_opening_features", lineitem=lines(spark, rows, "l_orderkey long, l_extendedprice double"))
    assert got == want and len(got) == 403
    assert {r[0]: r[4] for r in got}[1] == 3734700.4282  # by the SQL's running mean; the exact quotient is 3734700.4295...

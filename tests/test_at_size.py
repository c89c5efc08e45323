"""Cases that only larger tables held: distances at the edge of a rounding, sums in another order, rows with equal keys."""

from __future__ import annotations

import duckdb

from tests.oracle import TABLES, plain, same
from tidewright.operators import reports
from tidewright.plans import all_queries, all_sql


def tables(tmp_path, sf_dir: str, **changed: str) -> str:
    """A folder with the small tables, some of them replaced by the rows of a DuckDB query."""
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    for t, sql in changed.items():
        (tmp_path / f"{t}.parquet").unlink()
        duckdb.connect().sql(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet, row_group_size 2048)")
    return str(tmp_path)


# 25.04 - 20 is a little under 5.04, but 5.04 - 25.04 is -20: the second hour meets the stop and both targets.
EDGE = """
SELECT row_number() OVER (ORDER BY ts)::BIGINT AS event_id, ts::TIMESTAMP AS ts, 1::BIGINT AS user_id, 'purchase' AS event_type, value::DOUBLE AS value, '{"k": 1}' AS props
FROM (VALUES ('2024-01-16 02:10:00', 25.04), ('2024-01-16 03:10:00', 5.04), ('2024-01-16 03:20:00', 80.0), ('2024-01-16 03:30:00', 25.11), ('2024-01-16 04:10:00', 25.11), ('2024-01-16 05:10:00', 5.11), ('2024-01-16 05:20:00', 30.0)) v(ts, value)"""


def test_first_touch_measures_from_the_entry(spark, sf_dir, tmp_path):
    d = tables(tmp_path, sf_dir, events=EDGE)
    got = {r["decision_id"]: r["first_touch"] for r in all_queries()["first_touch"](spark, d).collect()}
    assert (got["purchase|2024-01-16 02"], got["purchase|2024-01-16 04"]) == ("ambiguous", "sl")
    same(all_queries()["first_touch"](spark, d), all_sql()["first_touch"], d)


def test_cells_of_edges_and_cells_without_losses(spark, sf_dir, tmp_path):
    d = tables(tmp_path, sf_dir, events=EDGE)
    got = {r["direction"]: (r["sl_rate"], r["profit_factor"]) for r in all_queries()["expectancy_cells"](spark, d).collect()}
    assert got == {"long": (1.0, 0.0), "short": (0.0, None)}
    same(all_queries()["expectancy_cells"](spark, d), all_sql()["expectancy_cells"], d)


def test_reasons_at_an_edge(spark, sf_dir, tmp_path):
    d = tables(tmp_path, sf_dir, events=EDGE)
    got = {r["reason"]: r["decisions"] for r in all_queries()["failure_reasons"](spark, d).collect()}
    assert got["ambiguous_intrabar_touch"] == 1
    same(all_queries()["failure_reasons"](spark, d), all_sql()["failure_reasons"], d)


# 20 - 17.99859 is 20 * 0.10007049999999999, which SQL rounds up at six digits, level with the gain of 2.00142.
LEVEL = """
SELECT row_number() OVER (ORDER BY ts)::BIGINT AS event_id, ts::TIMESTAMP AS ts, 1::BIGINT AS user_id, 'purchase' AS event_type, value::DOUBLE AS value, '{"k": 1}' AS props
FROM (VALUES ('2024-01-16 02:10:00', 20.0), ('2024-01-16 03:10:00', 22.00142), ('2024-01-16 03:20:00', 17.99859)) v(ts, value)"""


def test_reasons_at_a_rounding(spark, sf_dir, tmp_path):
    d = tables(tmp_path, sf_dir, events=LEVEL)
    got = {r["reason"] for r in all_queries()["failure_reasons"](spark, d).collect()}
    assert got == {"adverse_excursion_dominant", "weak_favorable_excursion", "confidence_overreach"}
    same(all_queries()["failure_reasons"](spark, d), all_sql()["failure_reasons"], d)
    same(all_queries()["first_touch"](spark, d), all_sql()["first_touch"], d)


# Half of each order's lines stand in later parts of the file. Their ratings weigh 0.3125 in all, which comes a bit lower if halves are added.
HALVES = """
SELECT (41 * k + 19)::BIGINT AS l_orderkey, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, n::INTEGER AS l_linenumber, q::DOUBLE AS l_quantity, 1000.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, 'A' AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '2024-01-16' AS l_shipdate
FROM range(3000) r(k), (VALUES (1, 1, 50), (1, 4, 5), (2, 2, 50), (2, 5, 35)) v(half, n, q) ORDER BY half, k, CASE n WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 2 THEN 3 ELSE 4 END"""
HALVED = "SELECT (41 * k + 19)::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, 'O' AS o_orderstatus, 1000.0::DOUBLE AS o_totalprice, TIMESTAMP '2024-01-16' AS o_orderdate, '5-LOW' AS o_orderpriority FROM range(3000) r(k)"


def by_one_thread(name: str, d: str, columns: list[str]) -> list[tuple]:
    """The SQL's rows from one thread: with more, DuckDB adds in another order each time."""
    c = duckdb.connect(config={"threads": 1})
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    r = c.sql(all_sql()[name])
    order = [r.columns.index(n) for n in columns]
    return sorted(tuple(plain(row[k]) for k in order) for row in r.fetchall())


def in_small_splits(spark, name: str, d: str) -> tuple[list[str], list[tuple]]:
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = all_queries()[name](spark, d)
        return df.columns, sorted(tuple(plain(x) for x in row) for row in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_alignment_adds_in_the_order_of_the_file(spark, sf_dir, tmp_path):
    d = tables(tmp_path, sf_dir, lineitem=HALVES)
    columns, got = in_small_splits(spark, "alignment", d)
    assert {r[columns.index("alignment")] for r in got} == {"0.313"}
    assert got == by_one_thread("alignment", d, columns)


def test_plans_at_the_threshold(spark, sf_dir, tmp_path):
    d = tables(tmp_path, sf_dir, lineitem=HALVES, orders=HALVED)
    columns, got = in_small_splits(spark, "trade_plans", d)
    assert "below_threshold" not in {r[columns.index("gate")] for r in got}
    assert got == by_one_thread("trade_plans", d, columns)


# Lines of one order, whose alignment of -0.19, average of 1 and news of 0.95 make 0.40549999999999997.
ONE = """
SELECT 80::BIGINT AS l_orderkey, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, n::INTEGER AS l_linenumber, q::DOUBLE AS l_quantity, 1000.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, 'A' AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '2024-01-16' AS l_shipdate
FROM (VALUES (2, 50), (4, 25), (4, 5), (4, 5)) v(n, q)"""
ORDER = "SELECT 80::BIGINT AS o_orderkey, 2::BIGINT AS o_custkey, 'O' AS o_orderstatus, 1000.0::DOUBLE AS o_totalprice, TIMESTAMP '2024-01-16' AS o_orderdate, '5-LOW' AS o_orderpriority"


def test_plans_at_a_rounding(spark, sf_dir, tmp_path):
    d = tables(tmp_path, sf_dir, lineitem=ONE, orders=ORDER)
    assert [(r["gate"], r["composite"]) for r in all_queries()["trade_plans"](spark, d).collect()] == [("open", 0.406)]
    for name in ("trade_plans", "class_probabilities"):
        same(all_queries()[name](spark, d), all_sql()[name], d)


def test_runs_don_t_depend_on_the_order_of_equal_rows(spark):
    rows = [("a", 1, False), ("a", 2, False), ("a", 2, True), ("a", 3, True)]
    got = [tuple(reports.runs(spark.createDataFrame(r, "k string, t int, lost boolean").coalesce(1), ["k"], ["t"], "lost").first()) for r in (rows, [rows[k] for k in (0, 2, 1, 3)])]
    assert got == [("a", 2, 1), ("a", 2, 1)]


# AF: wins of a single day, whose median of 0.0159565 lies between two roundings; NO: a win and a loss.
DEALS = """
SELECT k::BIGINT AS l_orderkey, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, 1::INTEGER AS l_linenumber, 10.0::DOUBLE AS l_quantity, price::DOUBLE AS l_extendedprice, 0.05::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, flag AS l_returnflag, status AS l_linestatus, day::TIMESTAMP AS l_shipdate
FROM (VALUES (19, 45487.0, 'A', 'F', '2024-01-16'), (60, 45487.0, 'A', 'F', '2024-01-16'), (101, 45487.0, 'A', 'F', '2024-01-16'), (142, 50000.0, 'N', 'O', '2024-01-16'), (183, 40000.0, 'N', 'O', '2024-01-18')) v(k, price, flag, status, day)"""


def test_account_without_losses_or_time(spark, sf_dir, tmp_path):
    d = tables(tmp_path, sf_dir, lineitem=DEALS, orders=HALVED)
    got = {r["symbol"]: r for r in all_queries()["account_metrics"](spark, d).collect()}["AF"]
    assert (got["profit_factor"], got["annualized_return"], got["median_r"], got["sharpe"]) == (float("inf"), float("inf"), 0.015956, None)
    same(all_queries()["account_metrics"](spark, d), all_sql()["account_metrics"], d)

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewright.sources import stores


def test_append_once(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert stores.append_once(df, path, ["k"], ["v"]) == 2
    assert stores.append_once(df, path, ["k"], ["v"]) == 0
    with pytest.raises(ValueError):
        stores.append_once(spark.createDataFrame([(1, "z")], "k int, v string"), path, ["k"], ["v"])
    with pytest.raises(ValueError):
        stores.append_once(spark.createDataFrame([(7, "y"), (7, "z")], "k int, v string"), path, ["k"], ["v"])
    assert spark.read.parquet(path).count() == 2


def test_archive_keeps_the_first_record(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    df = spark.createDataFrame([("x",), ("y",)], "name string")
    assert stores.archive(df.limit(1), path, ["name"], F.lit(1)) == 1
    assert stores.archive(df, path, ["name"], F.lit(2)) == 1
    assert {tuple(r) for r in spark.read.parquet(path).select("name", "recorded_at").collect()} == {("x", 1), ("y", 2)}


def test_items_are_kept_once_and_come_back(spark):
    df = spark.createDataFrame([(1, [("t1", 1), ("t2", 2)]), (2, [("t2", 2)]), (3, [])], "id int, news array<struct<title:string,n:int>>")
    facts, items = stores.normalized(df, "news", "id")
    assert items.count() == 2
    back = {r["id"]: ([tuple(x) for x in r["news"] or []], r["missing_refs"]) for r in stores.restored(facts, items, "news", "id").collect()}
    assert back == {1: ([("t1", 1), ("t2", 2)], 0), 2: ([("t2", 2)], 0), 3: ([], 0)}
    lost = stores.restored(facts, items.filter("title = 't1'"), "news", "id").agg(F.sum("missing_refs")).first()[0]
    assert lost == 2


def test_damaged_blobs(spark, tmp_path):
    for data, name in ((b"one", None), (b"two", "0" * 64)):
        p = tmp_path / stores.address("b", name or hashlib.sha256(data).hexdigest())
        p.parent.mkdir(parents=True)
        p.write_bytes(data)
    assert [r["path"][-3:] for r in stores.damaged(spark, f"file://{tmp_path}/b").collect()] == ["000"]


def test_ledgers(spark):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(5)], "k int, name string")
    rows = stores.ledger_rows(df, ["k"], ["k", "name"])
    head = rows.orderBy(F.desc("sequence")).first()["sha256"]
    assert stores.broken_links(rows, ["k", "name"], head).collect() == []
    changed = rows.withColumn("name", F.when(F.col("k") == 2, "other").otherwise(F.col("name")))
    assert [tuple(r) for r in stores.broken_links(changed, ["k", "name"]).collect()] == [(3, "changed")]
    assert {r["fault"] for r in stores.broken_links(rows.filter("k <> 4"), ["k", "name"], head).collect()} == {"truncated"}
    assert [tuple(r) for r in stores.broken_links(rows.filter("k <> 2"), ["k", "name"]).collect()] == [(4, "gap")]
    # a row that is rewritten with its hash and the next one's link
    body = '{"sequence":3,"k":2,"name":"forged"}'
    second = rows.filter("sequence = 2").first()["sha256"]
    forged = hashlib.sha256(f"{second}|{body}".encode()).hexdigest()
    bad = rows.withColumn("name", F.when(F.col("k") == 2, "forged").otherwise(F.col("name"))).withColumn("sha256", F.when(F.col("k") == 2, forged).otherwise(F.col("sha256"))).withColumn("previous_sha256", F.when(F.col("k") == 3, forged).otherwise(F.col("previous_sha256")))
    assert [tuple(r) for r in stores.broken_links(bad, ["k", "name"], head).collect()] == [(4, "changed")]


def test_run_folders(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    t = spark.createDataFrame([(1, 2.0)], "a int, b double")
    stores.write_run({n: t for n in stores.RUN_TABLES}, path, {"strategy": "x"})
    assert stores.audit_run(spark, path) == []
    t.union(t).write.mode("overwrite").parquet(f"{path}/trades")
    assert stores.audit_run(spark, path, (*stores.RUN_TABLES, "other")) == ["missing other", "changed trades"]
    assert stores.audit_run(spark, f"{path}/none") == ["no manifest"]

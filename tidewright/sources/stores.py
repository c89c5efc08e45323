"""Tables and files that are written: idempotent stores, archives, ledgers, content-addressed blobs, run folders."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.folds import fold
from tidewright.operators.quality import appended

#: Tables that a run folder must have.
RUN_TABLES = ("equity", "trades", "metrics", "checks")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in whatever file system Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def content_hash(*columns: str) -> Column:
    """SHA-256 of a row's canonical JSON: fields in the order given, nulls left out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def append_once(new: DataFrame, path: str, key: list[str], payload: list[str]) -> int:
    """Appends the rows that the store lacks and returns their number; the same key with another payload raises.

    Replays change nothing. Within `new`, repeated rows count once; conflicting ones raise as well.
    """
    spark = new.sparkSession
    once = new.dropDuplicates([*key, *payload])
    if once.groupBy(*key).count().filter("count > 1").head(1):
        raise ValueError("a key comes with two payloads")
    rows = appended(once, spark.read.parquet(path), key, payload) if exists(spark, path) else once
    rows = rows.persist()
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n


def archive(events: DataFrame, path: str, key: list[str], now: Column) -> int:
    """Appends events whose content key the archive lacks, with recorded_at; known ones keep their first record."""
    spark = events.sparkSession
    rows = events.dropDuplicates(key)
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(*key), key, "left_anti")
    rows = rows.withColumn("recorded_at", now).persist()
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n


def normalized(events: DataFrame, items: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(events with <items>_refs, one row an item): an array of structs is kept once by content hash; order is in the refs."""
    long = events.select(id_col, F.posexplode(items).alias("pos", "item")).withColumn("ref", F.sha2(F.to_json("item"), 256))
    refs = long.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias(f"{items}_refs"))
    facts = events.drop(items).join(refs, id_col, "left").withColumn(f"{items}_refs", F.coalesce(f"{items}_refs", F.array().cast("array<string>")))
    return facts, long.dropDuplicates(["ref"]).select("ref", "item.*")


def restored(facts: DataFrame, items: DataFrame, column: str, id_col: str) -> DataFrame:
    """The events of normalized() again; a reference without an item leaves the event's missing_refs above 0."""
    fields = [c for c in items.columns if c != "ref"]
    long = facts.select(id_col, F.posexplode(f"{column}_refs").alias("pos", "ref")).join(items, "ref", "left").withColumn("there", F.coalesce(F.col(fields[0]).isNotNull(), F.lit(False)))
    back = long.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("item")))), lambda x: x["item"]).alias(column), F.count_if(~F.col("there")).alias("missing_refs"))
    return facts.drop(f"{column}_refs").join(back, id_col, "left").withColumn("missing_refs", F.coalesce("missing_refs", F.lit(0)))


def address(root: str, digest: str) -> str:
    """The path of a blob by its SHA-256, fanned out by the first four digits."""
    return str(PurePosixPath(root) / digest[:2] / digest[2:4] / digest)


def damaged(spark: SparkSession, root: str) -> DataFrame:
    """path, digest of blobs whose bytes don't hash to their name; read and hashed in parallel."""
    blobs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return blobs.select("path", F.sha2("content", 256).alias("digest")).filter(~F.col("path").endswith(F.col("digest")))


def _link(previous: Column, payload: list[str]) -> Column:
    """A row's hash: of the hash before it, its number and its payload, so that no row can change without all after it."""
    return F.sha2(F.concat_ws("|", previous, F.to_json(F.struct("sequence", *payload))), 256)


def ledger_rows(trials: DataFrame, order: list[str], payload: list[str]) -> DataFrame:
    """trials with sequence, previous_sha256 ('' first) and sha256, which covers payload, sequence and previous_sha256.

    A chain is sequential by nature: one task streams the rows in order and holds the last hash. Ledgers are of trials
    and decisions, not of quotes. order must be unique.
    """
    import hashlib

    rows = trials.withColumn("body", F.to_json(F.struct(*payload))).withColumn("one", F.lit(0))
    names = [f"{f.name} {f.dataType.simpleString()}" for f in trials.schema.fields]

    def step(state: dict, row: tuple) -> list[tuple]:
        state["n"] += 1
        body = '{"sequence":%d%s' % (state["n"], "," + row.body[1:] if len(row.body) > 2 else "}")  # noqa: UP031
        before = state["last"]
        state["last"] = hashlib.sha256(f"{before}|{body}".encode()).hexdigest()
        return [(*row[:-2], state["n"], before, state["last"])]

    return fold(rows, ["one"], order, lambda: {"n": 0, "last": ""}, step, ", ".join([*names, "sequence int", "previous_sha256 string", "sha256 string"]))


def broken_links(ledger: DataFrame, payload: list[str], head: str | None = None) -> DataFrame:
    """sequence, fault of a ledger: changed rows, wrong links, gaps; a missing tail if the last hash isn't `head`.

    A row's hash covers the one before, so a row that is rewritten with its own hash shows at the next one; only if all
    after it are rewritten too does nothing show but the pinned head. Each row is held against the one before by an
    equi-join on the number: no task sees the whole ledger.
    """
    before = ledger.select((F.col("sequence") + 1).alias("sequence"), F.col("sha256").alias("__before"))
    rows = ledger.join(before, "sequence", "left")
    no_row = F.col("__before").isNull() & (F.col("sequence") != 1)
    link = F.col("previous_sha256") != F.coalesce("__before", F.lit(""))
    fault = F.when(no_row, "gap").when(F.col("sha256") != _link(F.col("previous_sha256"), payload), "changed").when(link, "link")
    found = rows.withColumn("fault", fault).filter(F.col("fault").isNotNull()).select("sequence", "fault")
    if head is None:
        return found
    last = ledger.agg(F.max("sequence").alias("sequence"), F.max_by("sha256", "sequence").alias("h")).filter(F.coalesce(F.col("h"), F.lit("")) != head)
    return found.unionByName(last.select(F.coalesce("sequence", F.lit(0)).alias("sequence"), F.lit("truncated").alias("fault")))


def write_run(tables: dict[str, DataFrame], path: str, manifest: dict) -> None:
    """Writes a run's tables as Parquet, then its manifest with each table's rows and order-free content hash."""
    spark = next(iter(tables.values())).sparkSession
    about = {}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        about[name] = _fingerprint(spark.read.parquet(f"{path}/{name}"))
    text = json.dumps(manifest | {"tables": about}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")


def _fingerprint(df: DataFrame) -> dict:
    n, h = df.select(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.coalesce(F.sum("h"), F.lit(0))).first()
    return {"rows": n, "hash": str(h)}


def audit_run(spark: SparkSession, path: str, required: tuple[str, ...] = RUN_TABLES) -> list[str]:
    """What is wrong with a run folder: missing tables, or contents that the manifest doesn't have. Empty: nothing."""
    if not exists(spark, f"{path}/manifest"):
        return ["no manifest"]
    about = json.loads(spark.read.text(f"{path}/manifest").first()[0])["tables"]
    faults = [f"missing {t}" for t in required if t not in about or not exists(spark, f"{path}/{t}")]
    return faults + [f"changed {t}" for t in sorted(about) if exists(spark, f"{path}/{t}") and _fingerprint(spark.read.parquet(f"{path}/{t}")) != about[t]]

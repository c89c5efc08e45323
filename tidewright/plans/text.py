"""News-like text over documents, pages and conversations; simulation and streams."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators import indicators, simulate, text
from tidewright.plans.catalog import query
from tidewright.plans.market import hourly
from tidewright.sources import stores
from tidewright.sources.tables import table, ticks
from tidewright.streaming.quotes import in_order, stream_bars

TAGS = {"insult": "worthless|pathetic|disgusting|loser|scum", "mail": "@", "link": "https?://"}


@query("news_tags", "WITH t AS (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{n}' END" for n, p in TAGS.items()) + "], lambda x: x IS NOT NULL)) AS tag, source FROM documents) SELECT tag, source, count(*) AS documents FROM t GROUP BY ALL")
def news_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", F.explode(text.tagged("text", TAGS)).alias("tag")).groupBy("tag", "source").agg(F.count("*").alias("documents"))


@query("news_dedupe", r"""WITH k AS (SELECT doc_id, source, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', '', 'g') AS k FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id DESC) AS n FROM k) SELECT doc_id, source FROM n WHERE n = 1""")
def news_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", text.title_key("text").alias("k"))
    return text.newest(d, F.sha2("k", 256), [F.col("doc_id").desc()]).select("doc_id", "source")


@query("page_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.plain("html")
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).alias("chars"), F.sha2(t, 256).alias("sha"))


@query("latest_turns", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(length(text), turn) AS chars, count(*) AS turns FROM conversations GROUP BY conv_id")
def latest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.max_by(F.length("text").cast("long"), F.col("turn")).alias("chars"), F.count("*").alias("turns"))


@query("stance", """WITH s AS (SELECT date_trunc('day', ts)::DATE AS day, event_type, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * greatest(floor(value / 10), 1) AS s FROM events), d AS (SELECT day, event_type, sum(s) AS s FROM s GROUP BY ALL)
SELECT day, sum(s) AS net, count(*) FILTER (s > 0) > 0 AND count(*) FILTER (s < 0) > 0 AS contradiction, count(*) FILTER (s < 0) AS short_symbols FROM d GROUP BY day""")
def stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("event_id") % 3 == 0, -1).otherwise(1) * F.greatest(F.floor(F.col("value") / 10), F.lit(1)).cast("double")
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.sum(s).alias("s"))
    return d.groupBy("day").agg(F.sum("s").alias("net"), ((F.count_if(F.col("s") > 0) > 0) & (F.count_if(F.col("s") < 0) > 0)).alias("contradiction"), F.count_if(F.col("s") < 0).alias("short_symbols"))


_CHAIN = """WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY n_nationkey)::INT AS sequence, n_nationkey, n_name FROM nation),
c AS (SELECT sequence, '' AS previous_sha256, sha256('' || '|' || json_object('sequence', sequence, 'n_nationkey', n_nationkey, 'n_name', n_name)::VARCHAR) AS sha256 FROM n WHERE sequence = 1
UNION ALL SELECT n.sequence, c.sha256, sha256(c.sha256 || '|' || json_object('sequence', n.sequence, 'n_nationkey', n.n_nationkey, 'n_name', n.n_name)::VARCHAR) FROM n JOIN c ON n.sequence = c.sequence + 1)
SELECT *, true AS intact FROM c"""


@query("hash_chain", _CHAIN)
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_nationkey", "n_name"]
    rows = stores.ledger_rows(table(spark, sf_dir, "nation").select(*names), names[:1], names)
    faults = stores.broken_links(rows, names)
    return rows.join(faults, "sequence", "left").select("sequence", "previous_sha256", "sha256", F.col("fault").isNull().alias("intact"))


#: The event types' bars as bars of currency pairs, which the account can value.
PAIRS = {"view": "EURUSD", "click": "GBPUSD", "purchase": "AUDUSD", "signup": "USDCAD", "error": "USDJPY"}


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with crossing averages as signals, for runs over several stop distances."""
    h = hourly(spark, sf_dir).withColumn("fast", indicators.sma("close", 5)).withColumn("slow", indicators.sma("close", 20))
    h = h.withColumn("target", F.when(F.col("fast") > F.col("slow"), 1).when(F.col("fast") < F.col("slow"), -1).otherwise(0))
    pair = F.element_at(F.create_map(*[F.lit(x) for kv in PAIRS.items() for x in kv]), F.col("symbol"))
    runs = h.withColumn("symbol", F.coalesce(pair, F.lit("EURUSD"))).withColumn("k", F.explode(F.array(*map(F.lit, (10.0, 20.0, 40.0, 80.0)))))
    return runs.select(F.concat(F.lit("stop"), F.col("k").cast("int").cast("string")).alias("run"), F.col("open_time").alias("at"), "symbol", "open", "high", "low", "close", "target", F.col("k").alias("stop_distance"), (F.col("k") * 2).alias("take_distance"))


@query("simulation")
def simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.simulate(signals(spark, sf_dir))


@query("simulation_by_run")
def simulation_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = simulate.simulate(signals(spark, sf_dir))
    return t.groupBy("run", "exit_reason").agg(F.count("*").alias("trades"), F.round(F.sum("net_pnl"), 4).alias("pnl"), F.round(F.avg("r_multiple"), 6).alias("expectancy_r"))


@query("effective_samples")
def effective_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = e.select((F.col("user_id") % 10).alias("book"), F.col("event_id").alias("id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 4 hours")).alias("end"), F.array(F.concat(F.lit("a"), (F.col("user_id") % 4).cast("string")), F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string"))).alias("currencies"))
    return simulate.effective(i, ["book"])


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one in a local session only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (base or f"file://{tempfile.mkdtemp(prefix='tidewright-')}").rstrip("/")


def _drained(stream: DataFrame) -> DataFrame:
    """The rows that a stream of files gives in append mode until it has read them all, from a table that is written once."""
    spark = stream.sparkSession
    at = f"{_shared(spark)}/stream-{spark.range(1).select(F.uuid()).first()[0]}"
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, sorted into files by time so that none is late."""
    at = f"{_shared(spark)}/quotes-{spark.range(1).select(F.uuid()).first()[0]}"
    t = ticks(spark, sf_dir).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "seq", "price")
    t.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(at)
    return spark.readStream.schema(t.schema).parquet(at)


@query("stream_bars")
def stream_bars_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(stream_bars(_events_stream(spark, sf_dir), "1 hour"))


@query("stream_in_order")
def stream_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(in_order(_events_stream(spark, sf_dir))).groupBy("symbol", "accepted").agg(F.count("*").alias("quotes"))


@query("top_documents", "SELECT source, doc_id, n_chars, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 5")
def top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5").select("source", "doc_id", "n_chars", "rank")

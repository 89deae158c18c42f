"""Streaming queries: the input is written as files from the tables, then streamed."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellframe.operators import binning
from cellframe.plans.oracle_views import with_views
from cellframe.plans.q_build import BINNED_SQL, RANGE_SQL, _ctes
from cellframe.plans.registry import query
from cellframe.session import materialize, scratch_path
from cellframe.sources import tables as T
from cellframe.streaming import jobs

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
WINDOW_SQL = (
    "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, COUNT(*) AS n, "
    "ROUND(AVG(value), 6) AS mean_value FROM v_stream_events GROUP BY 1")


# ---------------------------------------------------------------- ST-01 ---
@query("stream_encode", with_views(
    "SELECT b.sample, b.cell, b.gene, b.bin, CAST(COALESCE(g.id, 0) AS INT) AS gene_id "
    "FROM binned b LEFT JOIN v_gene_vocab g ON g.gene = b.gene WHERE b.bin <> 0",
    _ctes(RANGE_SQL, BINNED_SQL)))
def q_stream_encode(spark, sf):
    """Samples arrive about one per trigger, in as many files as they were written in; they are binned and encoded
    as they arrive.  So the vocabulary is sent once a sample, however many files there are."""
    src, sink, ck = (scratch_path(spark, n) for n in ("enc-src", "enc-sink", "enc-ck"))
    e = T.expr(spark, sf)
    e.write.mode("overwrite").partitionBy("sample").parquet(src)
    ranges = materialize(binning.sample_range(e), "ranges")
    gv = T.gene_vocab(spark, sf).select(F.col("gene").alias("name"), "id")
    schema = "cell long, gene long, value double, sample string"
    files = len(spark.read.schema(schema).option("basePath", src).parquet(src).inputFiles())
    jobs.encode_stream(spark, src, schema, ranges, gv, sink, ck, max_files=max(1, -(-files // max(1, ranges.count()))))
    return spark.read.parquet(sink)


@query("stream_running_range", with_views(
    "SELECT sample, cell, gene, value, bin FROM binned", _ctes(RANGE_SQL, BINNED_SQL)))
def q_stream_running_range(spark, sf):
    """Rows arrive in three steps (small values first, so ranges keep changing); the stream is stopped and started
    between them, and the samples that changed are binned again.  At the end it is the batch result."""
    src, table, ck = (scratch_path(spark, n) for n in ("run-src", "run-table", "run-ck"))
    e = materialize(T.expr(spark, sf), "expression")
    step = F.when(F.col("value") < 20, 0).when(F.col("value") < 45, 1).otherwise(2)
    for i in range(3):
        e.where(step == i).write.mode("append").parquet(src)
        jobs.running_range_stream(spark, src, "sample string, cell long, gene long, value double", table, ck,
                                  salts=4, state_partitions=4)
        jobs.rebin(spark, table)
    return spark.read.parquet(f"{table}/binned").select("sample", "cell", "gene", "value", "bin")


# ---------------------------------------------------------------- ST-02 ---
@query("tumbling_counts", with_views(WINDOW_SQL))
def q_tumbling_counts(spark, sf):
    """Batch twin of the streaming window count."""
    return jobs.window_counts(T.stream_events(spark, sf))


@query("tumbling_counts_stream", with_views(WINDOW_SQL))
def q_tumbling_counts_stream(spark, sf):
    """Events streamed in time order (a few files per trigger) with a watermark, update mode."""
    src, sink, ck = (scratch_path(spark, n) for n in ("ev-src", "ev-sink", "ev-ck"))
    ev = T.stream_events(spark, sf)
    ev.repartitionByRange(8, "ts").write.mode("overwrite").parquet(src)
    # The events table spans a month; a watermark that wide keeps every
    # event on time in this replay, so the result equals the batch twin.
    jobs.window_counts_stream(spark, src, EVENTS_SCHEMA, sink, ck, watermark="31 days", max_files=2,
                              state_partitions=8)
    return jobs.read_window_sink(spark, sink)


STEP_DAYS, DELAY_H = 10, 24
LATE_SQL = {
    # every tenth event arrives two steps late
    "ar": "SELECT event_id, ts, value, CAST(FLOOR((epoch(ts) - epoch(lo)) / (86400 * " + str(STEP_DAYS) + ")) AS BIGINT) "
          "+ CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END AS step "
          "FROM v_stream_events, (SELECT date_trunc('day', MIN(ts)) AS lo FROM v_stream_events) t",
    "wm": "SELECT s.step, MAX(a.ts) - INTERVAL " + str(DELAY_H) + " HOUR AS w FROM (SELECT DISTINCT step FROM ar) s "
          "LEFT JOIN ar a ON a.step < s.step GROUP BY s.step",
    "tagged": "SELECT ar.*, time_bucket(INTERVAL 1 HOUR, ts) AS start, "
              "COALESCE(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= date_trunc('milliseconds', wm.w), false) AS late "
              "FROM ar JOIN wm USING (step)",
}


def arrivals(spark, sf):
    """Events with the step in which they arrive: ten days at a time, every tenth event two steps late."""
    ev = T.stream_events(spark, sf)
    lo = ev.agg(F.date_trunc("day", F.min("ts"))).first()[0]
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(lo).cast("timestamp"))) / 1_000_000
    late = F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)
    return ev.withColumn("step", F.floor(seconds / (86400 * STEP_DAYS)) + late)


def replay_late(spark, sf):
    """The sink of a replay, step by step; the query is stopped and started again between the steps."""
    src, sink, ck = (scratch_path(spark, n) for n in ("late-src", "late-sink", "late-ck"))
    ev = materialize(arrivals(spark, sf), "arrivals")
    for step in sorted(r.step for r in ev.select("step").distinct().collect()):
        ev.where(F.col("step") == step).drop("step").write.mode("append").parquet(src)
        jobs.late_rows_stream(spark, src, EVENTS_SCHEMA, sink, ck, delay=f"{DELAY_H} hours", salts=4, state_partitions=4)
    return sink


@query("late_windows", with_views(
    "SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, COUNT(*) AS n, ROUND(AVG(value), 6) AS mean_value "
    "FROM tagged WHERE NOT late GROUP BY start", LATE_SQL))
def q_late_windows(spark, sf):
    """Windows of the rows that were on time, read from the compacted sink."""
    sink = replay_late(spark, sf)
    jobs.compact_windows(spark, sink)
    return jobs.read_windows(spark, sink)


@query("late_rows", with_views(
    "SELECT event_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start FROM tagged WHERE late", LATE_SQL))
def q_late_rows(spark, sf):
    """The rows that came after their window was closed."""
    late = spark.read.schema("key long, start timestamp, value double, batch_id long").parquet(f"{replay_late(spark, sf)}/late")
    return late.select(F.col("key").alias("event_id"), F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("window_start"))


# ---------------------------------------------------------------- ST-03 ---
def grown_vocab(spark, sf):
    src, table, ck = (scratch_path(spark, n) for n in ("voc-src", "voc-table", "voc-ck"))
    T.cells(spark, sf).write.mode("overwrite").partitionBy("sample").parquet(src)
    jobs.vocab_stream(spark, src, "cell long, batch string, celltype string, row_pos long, sample string",
                      "batch", ["row_pos"], table, ck)
    return table


@query("stream_vocab")
def q_stream_vocab(spark, sf):
    """Batch vocabulary grown file by file; ids never change once given."""
    return jobs.read_grown_vocab(spark, grown_vocab(spark, sf))


@query("stream_vocab_names", with_views(
    "SELECT name, n_ids, n_ids - 1 AS max_id, n_ids AS ledger_ids FROM "
    "(SELECT DISTINCT COALESCE(batch, 'nan') AS name FROM v_cells) d, "
    "(SELECT COUNT(DISTINCT COALESCE(batch, 'nan')) AS n_ids FROM v_cells) t"))
def q_stream_vocab_names(spark, sf):
    """All names of the grown vocabulary, with the number of distinct ids, the greatest id and the ledger's sum."""
    table = grown_vocab(spark, sf)
    vocab = jobs.read_grown_vocab(spark, table)
    found = vocab.agg(F.count_distinct("id").alias("n_ids"), F.max("id").cast("long").alias("max_id")).first()
    ledger = jobs.read_ledger(spark, table).agg(F.sum("n")).first()[0]
    return vocab.select("name", F.lit(found.n_ids).alias("n_ids"), F.lit(found.max_id).alias("max_id"),
                        F.lit(ledger).alias("ledger_ids"))

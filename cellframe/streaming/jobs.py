"""Structured Streaming versions of pipeline steps (ST-01..ST-03).

* ``encode_stream``: newly arriving sample files are binned against a
  fixed range table and gene-encoded (stream-static broadcast joins; the
  same column expressions as the batch path).
* ``running_range_stream`` and ``rebin``: the range of every sample is kept as state while its rows arrive;
  samples whose range has changed or that have new rows are binned again from the rows stored so far.
* ``window_counts_stream``: count and mean per tumbling event-time window
  with a watermark; update mode into an upsert sink (each micro-batch
  writes its changed windows tagged with the batch id; readers keep the
  latest row per window), so the sink is idempotent under retries.
* ``late_rows_stream``: the same windows with a watermark that bites: a
  stateful operator counts the rows that are on time and passes on those
  that are not, so that none is lost unseen; ``compact_windows`` folds the
  sink's batches into one snapshot.
* ``vocab_stream``: a vocabulary that grows with the stream while every
  existing id stays stable.  A ledger (batch, first id, count) tells where a
  batch's ids begin, and a batch writes its own folders only, so a batch that
  is replayed writes the same rows again.

All sinks and checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.config import BIN_EDGES, PAD_TOKEN_ID
from cellframe.functions.columns import bin_value
from cellframe.functions.ranking import checked_broadcast, global_row_number


def encode_stream(spark: SparkSession, source: str, schema: str, ranges: DataFrame, gene_vocab: DataFrame,
                  sink: str, checkpoint: str, n_edges: int = BIN_EDGES, pad_id: int = PAD_TOKEN_ID,
                  max_files: int = 1) -> None:
    """Bin and encode every sample file under ``source``; run until the input is drained.

    The static sides are written to the shared folder first, so the
    long-running stream joins against plain files, not a recomputed plan.
    """
    from cellframe.session import materialize
    ranges = materialize(ranges, "ranges")
    gene_vocab = materialize(gene_vocab, "vocab")
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
         .option("basePath", source).parquet(source))
    j = s.join(F.broadcast(ranges), "sample")  # one row per sample file
    binned = j.withColumn("bin", bin_value(F.col("value"), F.col("min_pos"), F.col("max_val"), n_edges))
    kept = binned.filter(F.col("bin") != 0)
    from cellframe.operators.vocab import VOCAB_BROADCAST_MAX_ROWS
    v = checked_broadcast(gene_vocab.select(F.col("name").alias("gene"), F.col("id").alias("_id")),
                          VOCAB_BROADCAST_MAX_ROWS)
    enc = (kept.join(v, "gene", "left")
           .withColumn("gene_id", F.coalesce(F.col("_id"), F.lit(pad_id)).cast("int"))
           .select("sample", "cell", "gene", "bin", "gene_id"))
    q = (enc.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start(sink))
    q.awaitTermination()


_RANGE = "sample string, salt int, min_pos double, max_val double"


def running_range_stream(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, salts: int = 8,
                         max_files: int | None = None, state_partitions: int | None = None) -> None:
    """Take in expression rows (sample, cell, gene, value) until the input is drained.

    The least positive and the greatest value of each sample are state, in
    ``salts`` parts a sample so that a hot sample is not one task; a part
    that changes is written to ``table/ranges`` (a folder per batch, written
    again by a replay).  The rows go to ``table/rows`` by sample.  Null and NaN
    values are no part of a range.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    from cellframe.session import ship_package
    ship_package(spark)

    def stream() -> DataFrame:
        reader = spark.readStream.schema(schema)
        s = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(source)
        return s.select(F.col("sample").cast("string").alias("sample"), "cell", "gene",
                        F.col("value").cast("double").alias("value"))

    def run(group, batches, state):
        import numpy as np
        import pandas as pd
        lo, hi = old = state.get if state.exists else (float("inf"), float("-inf"))
        for pdf in batches:
            v = pdf["value"].to_numpy(dtype=float, na_value=float("nan"))
            v = v[~np.isnan(v)]
            lo, hi = min(lo, v[v > 0].min(initial=float("inf"))), max(hi, v.max(initial=float("-inf")))
        if not state.exists or (lo, hi) != old:
            state.update((float(lo), float(hi)))
            yield pd.DataFrame({"sample": [group[0]], "salt": [group[1]], "min_pos": [lo if lo < float("inf") else None],
                                "max_val": [hi if hi > float("-inf") else None]})

    salted = stream().withColumn("salt", F.pmod(F.xxhash64("cell", "gene"), F.lit(salts)).cast("int"))
    ranges = salted.select("sample", "salt", "value").groupBy("sample", "salt").applyInPandasWithState(
        run, _RANGE, "lo double, hi double", "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/ranges/batch_id={batch_id}")

    old = spark.conf.get("spark.sql.shuffle.partitions")
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        queries = [ranges.writeStream.outputMode("update").foreachBatch(write)
                   .option("checkpointLocation", f"{checkpoint}/ranges").trigger(availableNow=True).start(),
                   stream().writeStream.format("parquet").partitionBy("sample").outputMode("append")
                   .option("checkpointLocation", f"{checkpoint}/rows").trigger(availableNow=True).start(f"{table}/rows")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for q in queries:
        q.awaitTermination()


def running_ranges(spark: SparkSession, table: str) -> DataFrame:
    """(sample, min_pos, max_val) of the rows taken in so far."""
    return (spark.read.schema(_RANGE).parquet(f"{table}/ranges").groupBy("sample")
            .agg(F.min("min_pos").alias("min_pos"), F.max("max_val").alias("max_val")))


def rebin(spark: SparkSession, table: str, n_edges: int = BIN_EDGES) -> list[str]:
    """Bin the samples again whose range or number of rows differs from what ``table/binned`` was made with; returns
    them (one name per sample).  Cut off before its last step, it does the same work again."""
    from cellframe.session import materialize
    rows = spark.read.parquet(f"{table}/rows").withColumn("sample", F.col("sample").cast("string"))
    now = materialize(running_ranges(spark, table).join(rows.groupBy("sample").agg(F.count(F.lit(1)).alias("n")), "sample"),
                      "ranges")
    try:
        used = spark.read.parquet(f"{table}/used")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # nothing has been binned yet
        used = now.limit(0)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("min_pos", "max_val", "n")]
    changed = now.join(used.select("sample", *[F.col(c).alias(f"_{c}") for c in ("min_pos", "max_val", "n")]), "sample",
                       "left").where(~(same[0] & same[1] & same[2])).select("sample", "min_pos", "max_val")
    names = sorted(r.sample for r in changed.select("sample").collect())
    if names:
        # one row per sample
        (rows.join(F.broadcast(changed), "sample")
         .withColumn("bin", bin_value(F.col("value"), F.col("min_pos"), F.col("max_val"), n_edges))
         .select("cell", "gene", "value", "bin", "sample")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample").parquet(f"{table}/binned"))
        now.write.mode("overwrite").parquet(f"{table}/used")
    return names


def window_counts(df: DataFrame, ts: str = "ts", value: str = "value", width: str = "1 hour") -> DataFrame:
    """Batch twin: count and mean per tumbling window."""
    return (df.groupBy(F.window(ts, width).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
            .select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    "n", F.round("mean_value", 6).alias("mean_value")))


def window_counts_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str,
                         width: str = "1 hour", watermark: str = "2 hours", max_files: int = 1,
                         state_partitions: int | None = None) -> None:
    """Windowed count/sum with a watermark into the upsert sink.

    ``state_partitions`` fixes the number of state-store partitions of the
    aggregation (Spark takes it from ``spark.sql.shuffle.partitions`` when a
    query starts for the first time and keeps it in the checkpoint); size
    it to the cluster's parallelism.  The session setting is restored after
    the query has started.
    """
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    # event time must be a TIMESTAMP for watermarks (the session time zone is UTC)
    s = s.withColumn("ts", F.col("ts").cast("timestamp"))
    agg = (s.withWatermark("ts", watermark).groupBy(F.window("ts", width).alias("w"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.col("w.start").alias("start"), "n", "s", F.lit(batch_id).alias("batch_id"))
         .write.mode("append").parquet(sink))

    old = spark.conf.get("spark.sql.shuffle.partitions")
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        q = (agg.writeStream.outputMode("update").foreachBatch(upsert)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    q.awaitTermination()


def read_window_sink(spark: SparkSession, sink: str) -> DataFrame:
    """Latest value per window from the upsert sink."""
    d = spark.read.parquet(sink)
    last = d.groupBy("start").agg(F.max_by(F.struct("n", "s"), "batch_id").alias("v"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                       F.col("v.n").alias("n"), F.round(F.col("v.s") / F.col("v.n"), 6).alias("mean_value"))


# ------------------------------------------------------------- late rows --
_STATE = "n long, s double"


def late_rows_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str = "event_id",
                     width_s: int = 3600, delay: str = "2 hours", salts: int = 8, max_files: int | None = None,
                     state_partitions: int | None = None) -> None:
    """Count and sum per tumbling window of ``width_s`` seconds, and the rows that came too late, until the input is
    drained.

    A row is late if its window ended at or before the watermark of its
    batch (the latest event time of earlier batches less ``delay``).  Late
    rows go to ``sink/late``, changed windows to ``sink/windows``, each batch
    into a folder of its own that a replay writes again.  A window's rows
    are counted in ``salts`` parts, so the current window is not one task.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    from cellframe.session import ship_package
    ship_package(spark)
    reader = spark.readStream.schema(schema)
    s = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(source)
    start = F.floor(F.unix_micros(F.col("ts")) / F.lit(width_s * 1_000_000)) * F.lit(width_s)
    rows = (s.select(F.col(key).cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"),
                     F.col("value").cast("double").alias("value")).withWatermark("ts", delay)
            .withColumn("start", start.cast("long"))
            .withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")))

    def run(group, batches, state):
        import pandas as pd
        begin, salt = group
        late = (begin + width_s) * 1000 <= state.getCurrentWatermarkMs()
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            if late:
                yield pd.DataFrame({"kind": "late", "start": begin, "salt": salt, "n": None, "s": pdf["value"],
                                    "key": pdf["key"]})
            else:
                n, total = n + len(pdf), total + float(pdf["value"].sum())
        if not late:
            state.update((n, total))
            yield pd.DataFrame({"kind": ["window"], "start": [begin], "salt": [salt], "n": [n], "s": [total], "key": [None]})

    found = rows.groupBy("start", "salt").applyInPandasWithState(
        run, "kind string, start long, salt int, n long, s double, key long", _STATE, "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.where("kind = 'window'").select("start", "salt", "n", "s").write.mode("overwrite").parquet(
            f"{sink}/windows/batch_id={batch_id}")
        batch.where("kind = 'late'").select("key", F.timestamp_seconds("start").alias("start"), F.col("s").alias("value")
                                            ).write.mode("overwrite").parquet(f"{sink}/late/batch_id={batch_id}")
        batch.unpersist()

    old = spark.conf.get("spark.sql.shuffle.partitions")
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        q = (found.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    q.awaitTermination()


_WINDOWS = "start long, salt int, n long, s double, batch_id long"


def _latest_windows(spark: SparkSession, sink: str) -> DataFrame:
    rows = spark.read.schema(_WINDOWS).parquet(f"{sink}/windows")
    return (rows.groupBy("start", "salt").agg(F.max_by(F.struct("n", "s"), "batch_id").alias("v"), F.max("batch_id").alias("b"))
            .select("start", "salt", "v.n", "v.s", F.col("b").alias("batch_id")))


def read_windows(spark: SparkSession, sink: str) -> DataFrame:
    """Windows of ``late_rows_stream``: the latest counts of each part, added up."""
    return (_latest_windows(spark, sink).groupBy("start").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            .select(F.date_format(F.timestamp_seconds("start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n",
                    F.round(F.col("s") / F.col("n"), 6).alias("mean_value")))


def compact_windows(spark: SparkSession, sink: str) -> int:
    """Fold all batches of the window sink into the folder of the last one; returns the number of folders removed.

    The folded rows are written beside the sink first; the last batch's
    folder is replaced by them and older ones are removed.  A reader sees the
    same windows before and after, because older counts never win.
    """
    from cellframe.session import materialize
    fs, root = _folder(spark, f"{sink}/windows")
    batches = sorted((int(st.getPath().getName().split("=")[1]), st.getPath()) for st in fs.listStatus(root)
                     if st.getPath().getName().startswith("batch_id="))
    if len(batches) < 2:
        return 0
    last = batches[-1][0]
    folded = materialize(_latest_windows(spark, sink).drop("batch_id"), "windows")
    folded.write.mode("overwrite").parquet(f"{sink}/windows/batch_id={last}")
    for _, old in batches[:-1]:
        fs.delete(old, True)
    return len(batches) - 1


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


# ------------------------------------------------------------ vocabulary --
_LEDGER = "first_id long, n long, batch_id long"


def vocab_stream(spark: SparkSession, source: str, schema: str, name_col: str, order_cols: list[str],
                 table: str, checkpoint: str, max_files: int = 1) -> None:
    """Append names never seen before with ids after those of the batches before.

    ``table/names`` and ``table/ledger`` have a folder per batch; a batch reads
    the folders of earlier batches only and writes its own, so doing any
    batch again gives the same ids.
    """
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    q = (s.writeStream.foreachBatch(lambda batch, i: grow_vocab(batch, i, name_col, order_cols, table))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_ledger(spark: SparkSession, table: str) -> DataFrame:
    """(batch_id, first_id, n) of a growing vocabulary."""
    return spark.read.schema(_LEDGER).parquet(f"{table}/ledger").select("batch_id", "first_id", "n")


def read_grown_vocab(spark: SparkSession, table: str) -> DataFrame:
    """(name, id, batch_id) of the batches that the ledger holds (a batch that was cut off is not there)."""
    names = spark.read.schema("name string, id int, batch_id long").parquet(f"{table}/names")
    return names.join(F.broadcast(read_ledger(spark, table).select("batch_id")), "batch_id", "left_semi").select(
        "name", "id", "batch_id")


def grow_vocab(batch: DataFrame, batch_id: int, name_col: str, order_cols: list[str], table: str) -> None:
    """One batch of ``vocab_stream``: names first, then the ledger's line that makes them count."""
    spark = batch.sparkSession
    first = (batch.select(F.coalesce(F.col(name_col).cast("string"), F.lit("nan")).alias("name"),
                          F.struct(*order_cols).alias("_f"))
             .groupBy("name").agg(F.min("_f").alias("_f")))
    start = 0
    try:
        ledger = read_ledger(spark, table).where(F.col("batch_id") < batch_id)
        start = ledger.agg(F.coalesce(F.max(F.col("first_id") + F.col("n")), F.lit(0))).first()[0]
        known = read_grown_vocab(spark, table).where(F.col("batch_id") < batch_id)
        first = first.join(known.select("name"), "name", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # the first batch finds no table
    new = global_row_number(first, ["_f", "name"], "id", start=start).select("name", F.col("id").cast("int").alias("id"))
    new.write.mode("overwrite").parquet(f"{table}/names/batch_id={batch_id}")
    n = spark.read.parquet(f"{table}/names/batch_id={batch_id}").count()
    spark.createDataFrame([(start, n)], "first_id long, n long").coalesce(1).write.mode("overwrite").parquet(
        f"{table}/ledger/batch_id={batch_id}")

"""Label files by their own headers, places in files, late rows, replayed vocabulary batches."""

import pytest
from pyspark.sql import functions as F

from cellframe.sources import files
from cellframe.streaming import jobs


def test_keyed_labels_go_by_each_files_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cell,celltype\nc1,T\nc2,NA\n")
    (tmp_path / "b.csv").write_text("celltype,extra,cell\nroot,1,c3\nstem,2,c4\n")
    (tmp_path / "c.csv").write_text("cell,celltype\nc5,B\n")
    got = {r.cell: r.celltype for r in files.read_keyed_labels(spark, str(tmp_path)).collect()}
    assert got == {"c1": "T", "c2": None, "c3": "root", "c4": "stem", "c5": "B"}
    (tmp_path / "d.csv").write_text("cell,batch\nc6,B\n")
    with pytest.raises(ValueError):
        files.read_keyed_labels(spark, str(tmp_path))


def test_places_in_several_files(spark, tmp_path):
    path = str(tmp_path / "rows")
    for part in range(3):
        spark.range(part * 100, part * 100 + 40 + part).coalesce(1).write.mode("append").parquet(path)
    rows = spark.read.parquet(path)
    got = files.file_positions(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning(id" not in plan
    placed = {r.pos: r.id for r in got.collect()}
    assert sorted(placed) == list(range(123))
    order = sorted({r.f for r in rows.select(F.col("_metadata.file_path").alias("f")).distinct().collect()})
    want = [r.id for f in order for r in spark.read.parquet(f).collect()]
    assert [placed[i] for i in range(123)] == want


def _events(spark, rows):
    return spark.createDataFrame([(i, t, float(v)) for i, t, v in rows], "event_id long, ts string, value double").select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


def test_late_rows_are_kept_apart_and_sink_folds(spark, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    schema = "event_id long, ts timestamp_ntz, value double"
    steps = [
        [(1, "2024-01-01 00:10:00", 1), (2, "2024-01-01 05:30:00", 2)],
        # the watermark is 03:30 now: the first is late, the window 03:00 to 04:00 is still open
        [(3, "2024-01-01 00:50:00", 4), (4, "2024-01-01 03:10:00", 8), (5, "2024-01-01 05:59:00", 16)],
        [(6, "2024-01-01 03:20:00", 32), (7, "2024-01-01 09:00:00", 64)],
        [(8, "2024-01-01 06:59:59", 128), (9, "2024-01-01 07:00:00", 256)],
    ]
    for rows in steps:
        _events(spark, rows).write.mode("append").parquet(src)
        jobs.late_rows_stream(spark, src, schema, sink, ck, delay="2 hours", salts=3, state_partitions=2)
    late = {r.key: r.value for r in spark.read.parquet(f"{sink}/late").collect()}
    assert late == {3: 4.0, 8: 128.0}
    want = {"2024-01-01 00:00:00": (1, 1.0), "2024-01-01 03:00:00": (2, 20.0), "2024-01-01 05:00:00": (2, 9.0),
            "2024-01-01 07:00:00": (1, 256.0), "2024-01-01 09:00:00": (1, 64.0)}

    def windows():
        return {r.window_start: (r.n, r.mean_value) for r in jobs.read_windows(spark, sink).collect()}

    assert windows() == want
    assert jobs.compact_windows(spark, sink) == 3 and jobs.compact_windows(spark, sink) == 0
    assert windows() == want


def test_replayed_vocabulary_batches_change_nothing(spark, tmp_path):
    table = str(tmp_path / "voc")

    def batch(*names):
        return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, row_pos long")

    batches = [batch("b", "a", "b"), batch("a", None, "c"), batch("c", "a"), batch("d")]
    for i, b in enumerate(batches):
        jobs.grow_vocab(b, i, "name", ["row_pos"], table)

    def state():
        return ({r.name: r.id for r in jobs.read_grown_vocab(spark, table).collect()},
                sorted(tuple(r) for r in jobs.read_ledger(spark, table).collect()))

    want = {"b": 0, "a": 1, "nan": 2, "c": 3, "d": 4}, [(0, 0, 2), (1, 2, 2), (2, 4, 0), (3, 4, 1)]
    assert state() == want
    for i in (1, 3, 0, 2):
        jobs.grow_vocab(batches[i], i, "name", ["row_pos"], table)
        assert state() == want
    # a batch that was cut off before its ledger line does not count
    spark.createDataFrame([("x", 5)], "name string, id int").write.parquet(f"{table}/names/batch_id=9")
    assert state() == want


def test_running_range_bins_only_what_changed(spark, tmp_path):
    from cellframe.operators.binning import bin_expression
    src, table, ck = (str(tmp_path / n) for n in ("src", "table", "ck"))
    schema = "sample string, cell long, gene long, value double"
    steps = [
        [("a", 1, 1, 2.0), ("a", 1, 2, 9.0), ("b", 5, 1, 1.0), ("b", 5, 2, float("nan"))],
        [("a", 2, 1, 5.0), ("c", 8, 1, None)],            # a: new rows, the same range
        [("b", 6, 1, 50.0), ("b", 6, 2, 0.25)],           # b: a wider range, the first rows change their bins
        [],
    ]
    seen, changed = [], []
    for rows in steps:
        seen += rows
        if rows:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        jobs.running_range_stream(spark, src, schema, table, ck, salts=2, state_partitions=2)
        changed.append(jobs.rebin(spark, table))
        want = bin_expression(spark.createDataFrame(seen, schema))
        got = spark.read.parquet(f"{table}/binned")
        cols = ["sample", "cell", "gene", "bin"]
        assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert changed == [["a", "b"], ["a", "c"], ["b"], []]
    assert {r.sample: (r.min_pos, r.max_val) for r in jobs.running_ranges(spark, table).collect()} == {
        "a": (2.0, 9.0), "b": (0.25, 50.0), "c": (None, None)}

"""File sources and sinks of the pipeline (IO-01..IO-13).

* sample expression folders: one sample per file or per ``sample=`` folder
* metadata CSV folders whose files may have different headers
* vocabulary JSON objects (name -> id)
* embedding text files ("gene v1 ... vd" lines, one header line)
* split chunks as parquet partitioned by split / chunk (see operators.splits)

File listing goes through the Hadoop FileSystem API and header lines are
read inside tasks, so the same code works on local disks and cluster file
systems; only file names and distinct header lines reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ------------------------------------------------------------ file system --
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """Data files under ``path`` (recursive), skipping hidden and marker files."""
    fs, p = _fs(spark, path)
    it = fs.listFiles(p, True)
    out = []
    while it.hasNext():
        st = it.next()
        name = st.getPath().getName()
        if name.startswith(("_", ".")) or not name.endswith(suffix):
            continue
        out.append(st.getPath().toString())
    return sorted(out)


# ------------------------------------------------------- sample matrices --
def scan_samples(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """IO-01: every parquet file (or ``sample=`` folder) under ``path`` is one sample.

    The sample name is the partition value when the folder is partitioned,
    otherwise the file name without extension (from ``_metadata``).
    """
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("recursiveFileLookup", "false").parquet(path)
    if "sample" in df.columns:
        return df
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return df.select(stem.alias("sample"), "*")


def read_h5_samples(spark: SparkSession, path: str, glob: str = "*.h5") -> DataFrame:
    """IO-01 for HDF5 sample matrices: (sample, cell, gene, value), zeros dropped.

    Each ``*.h5`` file holds ``count/data`` (cells x genes), ``count/cell_names``
    and ``count/gene_names``; the sample is the file name without extension.
    Files are listed with the ``binaryFile`` source and decoded by
    ``mapInPandas``; an HDF5 file is not splittable, so one file is one task
    (the task size is bounded by the file, and files are read in parallel).
    Needs ``h5py`` on the executors; without it the job fails with an
    ImportError when it runs.
    """
    from cellframe.session import ship_package
    ship_package(spark)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path).select("path", "content"))

    def decode(batches):
        import io
        import os
        import numpy as np
        import pandas as pd
        try:
            import h5py
        except ImportError as e:  # pragma: no cover - gated dependency
            raise ImportError("reading .h5 sample files needs h5py") from e
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                with h5py.File(io.BytesIO(content), "r") as f:
                    data = np.asarray(f["count/data"][:], dtype=np.float64)
                    cells = [c.decode("utf-8") if isinstance(c, bytes) else str(c) for c in f["count/cell_names"][:]]
                    genes = [g.decode("utf-8") if isinstance(g, bytes) else str(g) for g in f["count/gene_names"][:]]
                r, c = np.nonzero(data)
                yield pd.DataFrame({"sample": os.path.splitext(os.path.basename(p))[0],
                                    "cell": np.asarray(cells, dtype=object)[r],
                                    "gene": np.asarray(genes, dtype=object)[c], "value": data[r, c]})

    return files.mapInPandas(decode, "sample string, cell string, gene string, value double")


def melt_wide(wide: DataFrame, ids: list[str], var: str = "gene", value: str = "value",
              drop_zero: bool = True) -> DataFrame:
    """IO-02: wide cells x genes frame -> long (ids..., gene, value), zeros dropped."""
    cols = [c for c in wide.columns if c not in ids]
    long = wide.unpivot(ids, cols, var, value)
    return long.filter(F.col(value).isNotNull() & (F.col(value) != 0)) if drop_zero else long


# ------------------------------------------------------------- metadata --
def file_headers(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, header): the first line of every file, read inside tasks.

    Only the file list (metadata) comes from the driver; the files are
    opened in parallel with ``pyarrow.fs`` (local, HDFS or object stores).
    """
    from cellframe.session import ship_package
    ship_package(spark)
    paths = spark.createDataFrame([(f,) for f in files], "path string")

    def heads(batches):
        import pandas as pd
        import pyarrow.fs as pafs
        for pdf in batches:
            out = []
            for p in pdf["path"]:
                if p.startswith("file:"):
                    fs, rel = pafs.LocalFileSystem(), "/" + p[len("file:"):].lstrip("/")
                else:
                    fs, rel = pafs.FileSystem.from_uri(p)
                buf = b""
                with fs.open_input_stream(rel) as fh:
                    while b"\n" not in buf:
                        chunk = fh.read(1 << 16)
                        if not chunk:
                            break
                        buf += chunk
                out.append(buf.split(b"\n", 1)[0].decode("utf-8").rstrip("\r"))
            yield pd.DataFrame({"path": pdf["path"], "header": out})

    return paths.mapInPandas(heads, "path string, header string")


# texts that stand for a missing value in metadata files
NA_TEXTS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "<NA>", "n/a", "#N/A")


def read_keyed_labels(spark: SparkSession, path: str, key: str = "cell", label: str = "celltype") -> DataFrame:
    """IO-04: (key, label) from label CSVs; missing values are null, and a key that occurs twice fails the job.

    Columns go by the name in each file's own header, whatever their order:
    files are grouped by header line and each group is one read.  A header
    without the key or the label is an error.
    """
    from cellframe.operators.tokens import one_per_key
    files = list_files(spark, path, ".csv")
    if not files:
        raise FileNotFoundError(f"no .csv file under {path}")
    out = None
    for names, df in _by_header(spark, files):
        if key not in names or label not in names:
            raise ValueError(f"columns {key}, {label} expected, found {names}")
        part = df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(
            F.col(f"_{names.index(key)}").alias(key), F.col(f"_{names.index(label)}").alias(label))
        out = part if out is None else out.unionByName(part)
    text = F.col(label)
    return one_per_key(out.withColumn(label, F.when(~text.isin(*NA_TEXTS), text)), key, label)


def _by_header(spark: SparkSession, files: list[str]):
    """(column names, frame) for each distinct header line of CSV files, in the order of their first files."""
    grouped = (file_headers(spark, files).groupBy("header")
               .agg(F.array_sort(F.collect_list("path")).alias("files")).collect())
    for row in sorted(grouped, key=lambda r: r["files"][0]):
        yield ([h.strip().strip('"') for h in row["header"].split(",")],
               spark.read.option("header", True).csv(list(row["files"])))


def read_metadata(spark: SparkSession, path: str, col_name: str, save_col_name: str | None = None,
                  suffix: str = "meta.csv", na: tuple[str, ...] = NA_TEXTS) -> DataFrame:
    """IO-03 / U-01: stack (first column, ``col_name``) of every ``*meta.csv`` under ``path``.

    Files are grouped by header line (headers are read inside tasks); each
    group is one CSV read (one plan node per distinct header, not per
    file).  A file without ``col_name`` is skipped.  A blank first header
    reads as ``_c0``; the usual spellings of a missing value (``na``) are null.
    """
    files = list_files(spark, path, suffix)
    if not files:
        raise FileNotFoundError(f"no {suffix} file under {path}")
    parts = []
    for names, df in _by_header(spark, files):
        if col_name not in names:
            continue
        text = F.col(f"`{col_name}`")
        parts.append(df.select(F.col(f"`{df.columns[0]}`").alias("cell"),
                               F.when(~text.isin(*na), text).alias(save_col_name or col_name)))
    if not parts:
        raise FileNotFoundError(f"no file under {path} has column {col_name}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_labels(df: DataFrame, path: str) -> None:
    """IO-08: label table as CSV with a header (no index column)."""
    df.write.mode("overwrite").option("header", True).csv(path)


# ----------------------------------------------------------- vocabularies --
def write_vocab_json(vocab: DataFrame, path: str) -> None:
    """IO-09: one JSON object {name: id} (the vocabulary is small: one row per label)."""
    obj = vocab.agg(F.to_json(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct(F.col("name"), F.col("id")))))).alias("value"))
    obj.coalesce(1).write.mode("overwrite").text(path)


def read_vocab_json(spark: SparkSession, path: str) -> DataFrame:
    """IO-05: JSON object file(s) -> (name, id)."""
    txt = spark.read.option("wholetext", True).text(path)
    m = F.from_json(F.col("value"), T.MapType(T.StringType(), T.IntegerType()))
    return txt.select(F.explode(m).alias("name", "id"))


# ------------------------------------------------------------- embeddings --
def write_embedding_text(emb: DataFrame, path: str, key: str = "gene", vec: str = "vec",
                         header: DataFrame | None = None) -> None:
    """IO-11: a header line and one "gene v1 ... vd" line per row.

    ``header`` (one text row, as ``read_embedding_header`` returns it) is
    copied; without it the header is "n d".  Header and body are written as
    ``path/header`` and ``path/body``.
    """
    if header is None:
        stats = emb.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d"))
        header = stats.select(F.concat_ws(" ", F.col("n").cast("string"), F.col("d").cast("string")).alias("value"))
    header.coalesce(1).write.mode("overwrite").text(f"{path}/header")
    emb.select(F.concat_ws(" ", F.col(key).cast("string"),
                           F.array_join(F.transform(vec, lambda x: x.cast("string")), " ")).alias("value")) \
        .write.mode("overwrite").text(f"{path}/body")


def read_embedding_header(spark: SparkSession, path: str) -> DataFrame:
    """The header line(s) under ``path``: of a table written as header and body, or the first line of each file."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    written = lines.where(F.col("_metadata.file_path").rlike("/header/[^/]*$")).select("value")
    if written.limit(1).count():
        return written
    return file_headers(spark, list_files(spark, path)).select(F.col("header").alias("value"))


def read_embedding_text(spark: SparkSession, path: str, strict: bool = False,
                        key_type: str = "string", header: bool = True) -> DataFrame:
    """IO-06 / S-12: "gene v1 ... vd" lines -> (gene, vec array<double>).

    With ``header`` the first line of each file is dropped by its place,
    whatever it holds; a body written by ``write_embedding_text`` has none
    (``header=False``).  Permissive mode drops blank and malformed lines (a
    token that is not a number); strict mode fails the job on them.
    """
    # the CSV reader drops the first line of a file by position; the separator never occurs in a line
    lines = (spark.read.schema("line string").option("recursiveFileLookup", "true").option("header", header)
             .option("sep", "\u0001").option("quote", "").option("escape", "").option("comment", "")
             .option("enforceSchema", True).option("maxCharsPerColumn", -1).csv(path))
    body = lines.select(F.trim("line").alias("line")).where(F.col("line") != "").withColumn("t", F.split("line", r"\s+"))
    vals = F.transform(F.slice("t", 2, F.size("t")), lambda x: x.try_cast("double"))
    rows = body.select(F.col("t")[0].cast(key_type).alias("gene"), vals.alias("vec"), "line")
    bad = (F.size("vec") == 0) | F.exists("vec", lambda x: x.isNull())
    if strict:
        return rows.select("gene", F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), F.col("line"))))
                           .otherwise(F.col("vec")).alias("vec"))
    return rows.filter(~bad).select("gene", "vec")


# ------------------------------------------------------------- positions --
def file_positions(df: DataFrame, name: str = "pos") -> DataFrame:
    """W-12: every row's place in its Parquet files, from 0: files in the order of their paths, rows as they lie.

    ``df`` is a plain Parquet read (its hidden file columns are used).  A
    row's place in its file comes from the reader; the rows before the file
    are a prefix sum over one count per file, so rows are neither sorted nor
    shuffled.  The table of files is broadcast (one row per file).
    """
    from pyspark.sql import Window
    path, row = "_file_path", "_file_row"
    own = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    per = own.groupBy(path).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy(path).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(path, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (own.join(F.broadcast(offsets), path)
            .select(*df.columns, (F.col("_before") + F.col(row)).alias(name)))

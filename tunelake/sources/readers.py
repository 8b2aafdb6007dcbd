"""Readers for instruction data, evaluation sets, score vectors and checkpoint
metadata (S1-S6), and the artifact slug (S14)."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunelake.session import ship_package
from tunelake.sources.checkpoint_folders import STATE_FILE, _filesystem

TURNS_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

MESSAGES_SCHEMA = T.StructType([
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])))])

EVAL_ITEM_SCHEMA = T.StructType([T.StructField("prompt", T.StringType()),
                                 T.StructField("reference", T.StringType())])

SCORE_PAYLOAD_SCHEMA = T.StructType([
    T.StructField("base_model", T.StringType()), T.StructField("fused_model", T.StringType()),
    T.StructField("base_results", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("fused_results", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("scores_base", T.ArrayType(T.DoubleType())),
    T.StructField("scores_fused", T.ArrayType(T.DoubleType()))])

TRAINER_STATE_SCHEMA = T.StructType([
    T.StructField("step", T.LongType()), T.StructField("epoch", T.LongType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("is_best", T.BooleanType()), T.StructField("best_metric_value", T.DoubleType()),
    T.StructField("extra_state", T.MapType(T.StringType(), T.StringType()))])


def _format_of(path: str) -> str:
    p = path.rstrip("/").lower()
    for ext, fmt in ((".parquet", "parquet"), (".jsonl", "json"), (".json", "json"),
                     (".csv", "csv"), (".orc", "orc")):
        if p.endswith(ext):
            return fmt
    return "parquet"


def path_exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob matches anything, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


# Items used when a caller allows a missing evaluation set.
DEFAULT_EVAL_ITEMS = [
    ("Name the largest planet of the solar system.", "Jupiter is the largest planet of the solar system."),
    ("What does a compiler do?", "A compiler translates source code into a form that a machine can run."),
    ("Give one use of a hash table.", "A hash table finds a value by its key in constant expected time."),
]


def read_pairs_source(spark: SparkSession, path: str, schema: T.StructType | None = None,
                      split: str | None = None, fmt: str | None = None) -> DataFrame:
    """Instruction dataset by path; the format follows the extension.

    A split is a ``split=<name>`` sub-folder (partition pruning) or, when the
    data carries a ``split`` column, a pushed-down filter.
    """
    fmt = fmt or _format_of(path)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    if split and path_exists(spark, f"{path}/split={split}"):
        return reader.load(f"{path}/split={split}")
    df = reader.load(path)
    if split:
        if "split" not in df.columns:
            raise ValueError(f"{path} has neither a folder split={split} nor a column split")
        df = df.where(F.col("split") == split)
    return df


def stream_pairs_source(spark: SparkSession, path: str, schema: T.StructType,
                        max_files_per_trigger: int = 1, fmt: str | None = None) -> DataFrame:
    """Streaming read of the same source (S2): a folder, or a single file; a file stream needs a schema."""
    fmt = fmt or _format_of(path)
    path = path.rstrip("/")
    if _is_file(spark, path):
        path = f"{path[:-1]}[{path[-1]}]"  # Spark streams folders and globs: the glob of this one file
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(path))


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def cap_samples(turns: DataFrame, max_samples: int, id_col: str = "conv_id") -> DataFrame:
    """First ``max_samples`` samples (conversations) in id order, all their turns.

    The ids are cut by their global position; the join is Spark's choice.
    """
    from tunelake.operators.segmented import first_n
    ids = first_n(turns.select(id_col).where(F.col(id_col).isNotNull()).distinct(), [id_col], max_samples)
    return turns.join(ids, on=id_col, how="left_semi")


def read_eval_items(spark: SparkSession, path: str, allow_default: bool = False) -> DataFrame:
    """Evaluation set of {prompt, reference} items (S4): a JSON array, or the
    same rows as ``.jsonl`` or parquet, which are read in parallel."""
    if not path_exists(spark, path):
        if not allow_default:
            raise FileNotFoundError(path)
        items = spark.createDataFrame(DEFAULT_EVAL_ITEMS, EVAL_ITEM_SCHEMA).coalesce(1)
    elif path.endswith((".jsonl", ".ndjson")):
        items = spark.read.schema(EVAL_ITEM_SCHEMA).json(path)
    elif path.endswith(".parquet"):
        items = spark.read.schema(EVAL_ITEM_SCHEMA).parquet(path)
    else:
        items = spark.read.option("multiLine", True).schema(EVAL_ITEM_SCHEMA).json(path)
    return items.withColumn("sample_id", F.monotonically_increasing_id())


def read_score_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Paired score vectors (S5) -> (sample_id, base, fused).

    Both arrays are exploded with their positions and full-outer joined on the
    position, so a length mismatch shows as nulls instead of being truncated.
    """
    raw = spark.read.option("multiLine", True).schema(SCORE_PAYLOAD_SCHEMA).json(path)
    b = raw.select(F.posexplode("scores_base").alias("sample_id", "base"))
    f = raw.select(F.posexplode("scores_fused").alias("sample_id", "fused"))
    return b.join(f, on="sample_id", how="full_outer") \
            .withColumn("sample_id", F.col("sample_id").cast("bigint"))


@contextmanager
def _few_listing_tasks(spark: SparkSession):
    """Many small folders are listed by a few tasks on each core; Spark's default is one for each folder, up to 10,000."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


STEP_FOLDER = "checkpoint-step-"


def _reachable(spark: SparkSession, root: str) -> str | None:
    """The URI of ``root`` as the tasks can list it by ``pyarrow.fs``; None for a glob, an odd name or another store."""
    if re.search(r"[*?\[{\\%#]", root):
        return None
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    try:
        fs, path = _filesystem(uri)
        fs.get_file_info(path)
    except (OSError, ValueError, pa.ArrowException):  # a store that only Spark reads
        return None
    return uri


def _step_folders(fs: pafs.FileSystem, path: str) -> Iterator[str]:
    if fs.type_name != "local":
        yield from (f.base_name for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)))
        return
    try:
        with os.scandir(path) as entries:  # one after the other: memory doesn't follow their number
            yield from (e.name for e in entries)
    except (FileNotFoundError, NotADirectoryError):
        return


def _state_files(spark: SparkSession, uri: str) -> DataFrame:
    """The state files below ``uri``: one task lists the folders' names, all read the files.

    Spark's own listing asks for each folder on the driver and keeps every file there.
    """
    ship_package(spark)

    def listed(batches):
        for _ in batches:
            fs, path = _filesystem(uri)
            some = []
            for name in _step_folders(fs, path):
                if name.startswith(STEP_FOLDER):
                    some.append(name)
                if len(some) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["name"])
                    some = []
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["name"])

    def texts(rows):
        fs, path = _filesystem(uri)
        for row in rows:
            try:
                with fs.open_input_stream(f"{path}/{row['name']}/{STATE_FILE}") as f:
                    raw = f.read()
            except (FileNotFoundError, NotADirectoryError):
                continue  # a folder without a state
            yield raw.decode(json.detect_encoding(raw), "replace")

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = spark.range(0, 1, 1, 1).mapInArrow(listed, "name string").repartition(width, "name")
    return spark.read.schema(TRAINER_STATE_SCHEMA).json(names.rdd.mapPartitions(texts))


def read_trainer_states(spark: SparkSession, root: str) -> DataFrame:
    """All ``checkpoint-step-*/trainer_state.json`` and the table of ``write_trainer_states`` under ``root``.

    No file -> an empty table with the declared schema.
    """
    found = spark.createDataFrame([], TRAINER_STATE_SCHEMA)
    pattern, table = f"{root}/{STEP_FOLDER}*/{STATE_FILE}", f"{root}/trainer_states.parquet"
    uri = _reachable(spark, root)
    if uri is not None:
        found = _state_files(spark, uri)
    else:
        try:  # the folders are matched once, not before the read too
            with _few_listing_tasks(spark):
                found = spark.read.option("multiLine", True).schema(TRAINER_STATE_SCHEMA).json(pattern)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if path_exists(spark, table):
        found = found.unionByName(spark.read.schema(TRAINER_STATE_SCHEMA).parquet(table))
    return found


def dataset_slug(name: Column) -> Column:
    """``Path(name).stem.replace("/", "_")``: last path component without its
    final suffix (a leading dot is not a suffix; trailing slashes ignored)."""
    stripped = F.regexp_replace(name, "/+$", "")
    last = F.regexp_extract(stripped, r"([^/]*)$", 1)
    stem = F.when(last.rlike(r"^\.[^.]*$") | ~last.rlike(r".\.[^.]+$"), last) \
            .otherwise(F.regexp_extract(last, r"^(.*)\.[^.]+$", 1))
    return F.replace(stem, F.lit("/"), F.lit("_"))

"""Checkpoint folders (S13): ``checkpoint-step-N/trainer_state.json`` and ``checkpoint-best``.

A write is one transaction in two phases:

1. Tasks write their folders below ``.staging-<id>/part-<task>-<attempt>``.
   When all have ended, the driver lists the parts that count in one small file,
   ``_COMMITTED``: from then on the write holds.  If the job fails instead, the
   staging folder is deleted and nothing else was touched.
2. Tasks move the folders of the listed parts to their places, one part each:
   whole where the place is free, or else the file alone.  A move that was done
   is skipped, so a lost task, or a lost driver followed by ``recover``, ends
   with the same folders.

``pyarrow.fs`` does the file work (local and shared folders, HDFS, object
stores); the driver handles one name for each task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STATE_FILE = "trainer_state.json"
BEST = "checkpoint-best"
_WHOLE = ("local", "hdfs")  # file systems that move a folder by its name; an object store has only files
_FIELDS = ("step", "epoch", "metrics", "is_best", "best_metric_value", "extra_state")


def _filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in root and not root.startswith("file:"):
        return pafs.LocalFileSystem(), root.rstrip("/")
    if root.startswith("file:"):  # Spark writes file:/path
        root = "file:///" + root[5:].lstrip("/")
    fs, path = pafs.FileSystem.from_uri(root)
    return fs, path.rstrip("/")


def _staging(path: str, transaction: str) -> str:
    return f"{path}/.staging-{transaction}"


@dataclass
class _Part(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceWriter):
    def __init__(self, root: str, transaction: str):
        self.root, self.transaction = root, transaction

    def write(self, iterator: Iterator) -> _Part:
        fs, path = _filesystem(self.root)
        task = TaskContext.get()
        part, used = f"part-{task.partitionId()}-{task.taskAttemptId()}", False
        for row in iterator:
            base = f"{_staging(path, self.transaction)}/{part}"
            folder = f"{base}/{row['folder']}"
            if not used:
                fs.create_dir(base, recursive=True)
            fs.create_dir(folder, recursive=False)
            state = {k: row[k] for k in _FIELDS}
            state["metrics"], state["extra_state"] = state["metrics"] or {}, state["extra_state"] or {}
            with fs.open_output_stream(f"{folder}/{STATE_FILE}") as out:
                out.write(json.dumps(state, indent=2).encode())
            used = True
        return _Part(part if used else None)

    def commit(self, messages: list) -> None:
        fs, path = _filesystem(self.root)
        parts = sorted(m.name for m in messages if m is not None and m.name)
        staging = _staging(path, self.transaction)
        fs.create_dir(staging, recursive=True)
        with fs.open_output_stream(f"{staging}/_COMMITTED.tmp") as out:
            out.write("\n".join(parts).encode())
        fs.move(f"{staging}/_COMMITTED.tmp", f"{staging}/_COMMITTED")

    def abort(self, messages: list) -> None:
        fs, path = _filesystem(self.root)
        if fs.get_file_info(_staging(path, self.transaction)).type != pafs.FileType.NotFound:
            fs.delete_dir(_staging(path, self.transaction))


class CheckpointFolders(DataSource):
    """Write side of the folders; ``readers.read_trainer_states`` reads them."""

    @classmethod
    def name(cls) -> str:
        return "checkpoint_folders"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options["transaction"])


def _place(fs: pafs.FileSystem, staged: str, folder: str) -> int:
    """Move a staged folder to its place; the number of files moved.

    A folder that exists keeps what else is in it.
    """
    if fs.type_name in _WHOLE and fs.get_file_info(folder).type == pafs.FileType.NotFound:
        fs.move(staged, folder)
        return 1
    if fs.get_file_info(f"{staged}/{STATE_FILE}").type != pafs.FileType.File:
        return 0  # an earlier attempt has moved it
    fs.create_dir(folder, recursive=True)
    fs.move(f"{staged}/{STATE_FILE}", f"{folder}/{STATE_FILE}")
    return 1


def _move_parts(root: str, transaction: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _filesystem(root)
        for frame in frames:
            moved = 0
            for part in frame["part"]:
                base = f"{_staging(path, transaction)}/{part}"
                for found in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
                    moved += _place(fs, found.path, f"{path}/{found.base_name}")
                if fs.get_file_info(base).type != pafs.FileType.NotFound:
                    fs.delete_dir(base)  # with the folders whose file alone was moved
            yield pd.DataFrame({"moved": [moved]})
    return run


def _publish(spark: SparkSession, root: str, transaction: str) -> None:
    fs, path = _filesystem(root)
    staging = _staging(path, transaction)
    with fs.open_input_stream(f"{staging}/_COMMITTED") as f:
        parts = [(p,) for p in f.read().decode().split("\n") if p]
    if parts:
        spark.createDataFrame(parts, "part string").repartitionByRange(min(len(parts), 1000), "part") \
             .mapInPandas(_move_parts(root, transaction), "moved long").agg(F.sum("moved")).collect()
    fs.delete_dir(staging)


def recover(spark: SparkSession, root: str) -> None:
    """Finish the committed writes that a lost driver left behind, and delete those that were not committed.

    Call it when no other writer is at work."""
    fs, path = _filesystem(root)
    for found in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if found.base_name.startswith(".staging-"):
            if fs.get_file_info(f"{found.path}/_COMMITTED").type == pafs.FileType.File:
                _publish(spark, root, found.base_name.removeprefix(".staging-"))
            else:
                fs.delete_dir(found.path)


def write_checkpoint_folders(states: DataFrame, root: str, best_copy: bool = True) -> None:
    """One folder for each step of ``states`` (the columns of ``readers.TRAINER_STATE_SCHEMA``).

    Of rows that repeat a step the one with the largest epoch is written; rows
    without a step are left out; a folder that exists is replaced.  With
    ``best_copy`` the last row marked best is written to ``checkpoint-best`` too.
    """
    spark = states.sparkSession
    spark.dataSource.register(CheckpointFolders)
    row = F.struct(*_FIELDS)
    rows = states.where("step is not null").groupBy("step").agg(
        F.max_by(row, F.struct("epoch", "is_best", "best_metric_value")).alias("r")).select(
        F.concat(F.lit("checkpoint-step-"), F.col("step")).alias("folder"), "r.*")
    if best_copy:
        best = states.where("step is not null and is_best").agg(F.max_by(row, F.struct("step", "epoch")).alias("r"))
        rows = rows.unionByName(best.where("r is not null").select(F.lit(BEST).alias("folder"), "r.*"))
    # A folder costs the same whatever its bytes: Spark would coalesce small rows to one task.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder")
    transaction = uuid.uuid4().hex[:12]
    rows.write.format("checkpoint_folders").option("path", root).option("transaction", transaction).mode("append").save()
    _publish(spark, root, transaction)

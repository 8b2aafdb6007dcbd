"""Streaming jobs that keep state of their own.

W6/T1  shuffle_stream      -- shuffle with a buffer of fixed size; batch twin ``splits.buffer_shuffle``
W1/W2  checkpoint_stream   -- running best and retention, decided as checkpoints arrive
P2/T1  fold_turns          -- turns to pairs, a conversation's session closed by the watermark

The first two need the RocksDB state store (``with_state_store`` sets it for
the queries started inside).  A restart continues from the checkpoint.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tunelake.operators.splits import DEFAULT_BUFFER, DEFAULT_SEED, buffer_slot, shuffle_key

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Rows after this time carry no data: the first one that the watermark passes ends the stream.
END_OF_STREAM = dt.datetime(2200, 1, 1, tzinfo=dt.timezone.utc)
_EARLIEST, _LATEST = (dt.datetime(y, 1, 1, tzinfo=dt.timezone.utc) for y in (1700, 2250))  # that pandas can hold
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


@contextmanager
def with_state_store(spark: SparkSession):
    """Queries started inside use the RocksDB state store."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


# --- shuffle with a buffer ------------------------------------------------------

_HELD = "slot int, ts long, id long, key string, payload string"
_HELD_COLUMNS = ["slot", "ts", "id", "key", "payload"]
NO_GROUP = -1  # rows that are not shuffled, but move the watermark
_OUT = "payload string, pushed_ts long, pushed_by long, shuffle_key string"


class _Buffer(StatefulProcessor):
    """The rows of one group of slots: ``waiting`` for the watermark, and one row ``held`` in each slot.

    A row whose time has come takes its slot and pushes out the row in it.
    """

    def __init__(self, end_ms: int):
        self.end_ms = end_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _HELD)
        self.held = handle.getListState("held", _HELD)

    @staticmethod
    def _read(state) -> list[tuple]:
        return [tuple(r) for r in state.get()] if state.exists() else []

    @staticmethod
    def _write(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [t for frame in rows for t in zip(*(frame[c].tolist() for c in _HELD_COLUMNS))]
        if new and key[0] != NO_GROUP:
            self.waiting.appendList(new)
            for ms in {-(-t[1] // 1000) for t in new}:  # a timer fires when the watermark has passed it
                self.handle.registerTimer(ms)
            self.handle.registerTimer(self.end_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self._read(self.waiting), key=lambda t: (t[1], t[2]))
        due = [t for t in waiting if t[1] <= now * 1000]
        held = {t[0]: t for t in self._read(self.held)}
        out = []
        for t in due:
            old = held.get(t[0])
            if old is not None:
                out.append((old[4], t[1], t[2], old[3]))
            held[t[0]] = t
        if now >= self.end_ms:
            out += [(t[4], None, None, t[3]) for t in held.values()]
            held = {}
        if due or out:
            self._write(self.waiting, waiting[len(due):])
            self._write(self.held, list(held.values()))
        if out:
            yield pd.DataFrame({"payload": pd.Series([r[0] for r in out], dtype=object),
                                "pushed_ts": pd.array([r[1] for r in out], "Int64"),
                                "pushed_by": pd.array([r[2] for r in out], "Int64"),
                                "shuffle_key": pd.Series([r[3] for r in out], dtype=object)})

    def close(self) -> None:
        pass


def shuffle_stream(rows: DataFrame, id_col: str, ts: str, buffer_size: int = DEFAULT_BUFFER, seed: int = DEFAULT_SEED,
                   delay: str = "1 hour", groups: int = 64) -> DataFrame:
    """Rows of a stream in the order of a shuffle with a buffer of ``buffer_size`` slots.

    A hash of seed and id gives a row its slot.  A row that arrives (in the
    order of time and id) pushes out the row that its slot holds, so a row
    waits for about ``buffer_size`` others.  Order by ``splits.pushed_order``;
    it depends on seed and buffer size alone, not on micro-batches, partitions
    or restarts.  Rows later than ``delay`` are dropped by the watermark, as are
    rows without id or time, or with a time before 1970.  A row with a time after ``END_OF_STREAM`` (plus the
    delay) empties the buffer, as at the end of a finite source.

    ``groups`` keys hold the slots: one timer and one state read for each group
    instead of each slot; more groups spread a larger buffer over more tasks.
    """
    event = F.greatest(F.least(F.col(ts), F.lit(_LATEST)), F.lit(_EARLIEST))
    timed = rows.withColumn("_event_time", F.when(F.col(ts).isNotNull(), event)).withWatermark("_event_time", delay)
    slot = buffer_slot(id_col, buffer_size, seed)
    # Not a filter: Spark would drop rows without id before they move the watermark.
    data = F.col(id_col).isNotNull() & (F.col(ts) < F.lit(END_OF_STREAM))
    keyed = timed.select(
        F.when(data, slot % groups).otherwise(NO_GROUP).cast("int").alias("group"), slot.cast("int").alias("slot"), F.unix_micros(ts).alias("ts"),
        F.col(id_col).cast("long").alias("id"), shuffle_key(id_col, seed).alias("key"),
        F.to_json(F.struct(*[F.col(c) for c in rows.columns]), _JSON).alias("payload"), "_event_time")
    out = keyed.groupBy("group").transformWithStateInPandas(
        _Buffer(int(END_OF_STREAM.timestamp() * 1000)), _OUT, "Append", "EventTime")
    return out.select(F.from_json("payload", rows.schema, _JSON).alias("r"), F.timestamp_micros("pushed_ts").alias("pushed_ts"),
                      "pushed_by", "shuffle_key").select("r.*", "pushed_ts", "pushed_by", "shuffle_key")


# --- checkpoints as they arrive ---------------------------------------------------

_DECISIONS = "run {run}, step long, is_best boolean, best_metric_value double, purged_step long"


class _Checkpoints(StatefulProcessor):
    """Best value so far and the newest steps of one run."""

    def __init__(self, sign: int, keep: int):
        self.sign, self.keep = sign, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "value double")
        self.queue = handle.getValueState("queue", "steps array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = float(self.best.get()[0]) if self.best.exists() else self.sign * float("inf")
        queue = [int(s) for s in self.queue.get()[0]] if self.queue.exists() else []
        frame = pd.concat(list(rows)).sort_values("step", kind="stable")
        out = []
        for step, metric in zip(frame["step"].tolist(), frame["metric"].tolist()):
            better = metric is not None and (metric < best if self.sign > 0 else metric > best)  # false for NaN
            best = float(metric) if better else best
            queue.append(step)
            out.append((step, better, best, queue.pop(0) if len(queue) > self.keep else None))
        self.best.update((best,))
        self.queue.update((queue,))
        yield pd.DataFrame({"run": pd.Series([key[0]] * len(out), dtype=object), "step": [r[0] for r in out], "is_best": [r[1] for r in out],
                            "best_metric_value": [r[2] for r in out], "purged_step": pd.array([r[3] for r in out], "Int64")})

    def close(self) -> None:
        pass


def checkpoint_stream(ckpts: DataFrame, run: str = "run", step: str = "step", metrics: str = "metrics",
                      metric_name: str = "eval_loss", mode: str = "min", max_to_keep: int = 3) -> DataFrame:
    """(run, step, is_best, best_metric_value, purged_step) for each checkpoint as it arrives.

    The rules are those of ``runs.running_best`` and ``runs.checkpoint_retention``;
    ``purged_step`` is the step that leaves the newest ``max_to_keep`` now.  State is
    one number and at most ``max_to_keep`` steps for each run.  Checkpoints of a
    micro-batch are taken in step order, micro-batches as they come.
    """
    mode = mode.lower()
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be min or max, not {mode!r}")
    if max_to_keep < 0:
        raise ValueError("max_to_keep can't be negative")
    rows = ckpts.where(F.col(step).isNotNull()).select(
        F.col(run).alias("run"), F.col(step).cast("long").alias("step"),
        F.try_element_at(F.col(metrics), F.lit(metric_name)).cast("double").alias("metric"))
    schema = _DECISIONS.format(run=rows.schema["run"].dataType.simpleString())
    return rows.groupBy("run").transformWithStateInPandas(
        _Checkpoints(1 if mode == "min" else -1, max_to_keep), schema, "Append", "None")


def retention_plan(decisions: DataFrame) -> DataFrame:
    """(run, step, kept, best_copy, action) after all decisions: the rows of ``runs.checkpoint_retention``."""
    saved = decisions.select("run", "step", F.lit(False).alias("gone"), "is_best")
    gone = decisions.where("purged_step is not null").select("run", F.col("purged_step").alias("step"),
                                                             F.lit(True).alias("gone"), F.lit(False).alias("is_best"))
    steps = saved.unionByName(gone).groupBy("run", "step").agg(F.max("gone").alias("gone"), F.max("is_best").alias("is_best"))
    last = decisions.where("is_best").groupBy("run").agg(F.max("step").alias("best_step"))
    best = steps.join(last.withColumnRenamed("run", "r"), F.col("run").eqNullSafe(F.col("r")), "left").drop("r")
    copy = F.coalesce(F.col("step") == F.col("best_step"), F.lit(False))
    return best.select("run", "step", (~F.col("gone")).alias("kept"), copy.alias("best_copy"),
                       F.when(~F.col("gone") | copy, F.lit("keep")).otherwise(F.lit("purge")).alias("action"))


# --- turns to pairs ---------------------------------------------------------------

def fold_turns(turns: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", id_col: str = "conv_id",
               turn_col: str = "turn", role_col: str = "role", text_col: str = "text", ts: str = "ts") -> DataFrame:
    """Pairs of (last user, last assistant) text for each session of a conversation.

    A session ends when no turn comes for ``gap``.  On a stream, its pair comes
    out once the watermark (``delay`` behind the latest turn) has passed the end;
    turns that arrive before that, in any order, still change it, and later ones are
    dropped.  State is one row for each open session.  On a batch the same
    function gives the same pairs.  Turns without time are dropped.
    """
    def last(role):
        return F.expr(f"max_by({text_col}, {turn_col}) FILTER (WHERE {role_col} = '{role}')")
    return (turns.withWatermark(ts, delay).where(F.col(ts).isNotNull())
            .groupBy(F.session_window(ts, gap).alias("session"), id_col)
            .agg(last("user").alias("prompt"), last("assistant").alias("response"), F.count(F.lit(1)).alias("turns"))
            .select(id_col, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"),
                    "turns", "prompt", "response"))

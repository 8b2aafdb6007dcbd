"""Streaming jobs with state: equal to their batch twins however the rows arrive, also over a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tunelake.operators import runs as R
from tunelake.operators import splits as S
from tunelake.streaming import jobs as J
from tunelake.streaming import stateful as ST

UTC = dt.timezone.utc
T0 = dt.datetime(2024, 1, 1, tzinfo=UTC)


def add_file(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def drive(spark, df, path):
    with ST.with_state_store(spark):
        return J.run_to_table(df, path)


# --- shuffle ----------------------------------------------------------------------

DOC = "doc_id long, ts timestamp, text string, score double, tags array<string>"


def documents(n, seed=0):
    rng = random.Random(seed)
    return [(i, T0 + dt.timedelta(seconds=10 * i, microseconds=rng.randrange(999999)), rng.choice([None, "", "ä\n\"", f"t{i}"]),
             rng.choice([None, 1 / 3, float("nan"), 1e-300, -0.0]), rng.choice([None, [], ["a", None]])) for i in range(n)]


END = [(None, ST.END_OF_STREAM + dt.timedelta(days=1), None, None, None)]


def ordered(spark, path_rows, keys):
    return [r["doc_id"] for r in path_rows.orderBy(*keys).collect()]


@pytest.mark.parametrize("buffer_size, seed", [(1, 42), (7, 42), (7, 1), (64, 42)])
def test_buffer_order_against_a_plain_buffer(spark, buffer_size, seed):
    import hashlib
    rows = documents(60)
    key = {i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i in range(60)}
    held, want = {}, []
    for i in range(60):
        slot = int(key[i][:8], 16) % buffer_size
        if slot in held:
            want.append(held[slot])
        held[slot] = i
    want += sorted(held.values(), key=lambda i: key[i])
    df = spark.createDataFrame(rows, DOC).repartition(5)
    got = S.buffer_shuffle(df, "doc_id", buffer_size=buffer_size, seed=seed).orderBy("position").collect()
    assert [r["doc_id"] for r in got] == want and [r["position"] for r in got] == list(range(60))
    assert {r["doc_id"]: str(r["score"]) for r in got} == {r[0]: str(r[3]) for r in rows}


def test_stream_shuffle_equals_batch_over_a_restart(spark, tmpdir_fresh):
    rows = documents(80)
    batch = S.buffer_shuffle(spark.createDataFrame(rows, DOC), "doc_id", ["ts"], buffer_size=9)
    want = [r["doc_id"] for r in batch.orderBy("position").collect()]
    source, out = f"{tmpdir_fresh}/in", f"{tmpdir_fresh}/out"
    rng = random.Random(3)
    part = sorted(rows[:40], key=lambda r: r[0] + rng.uniform(0, 8))  # rows come late, within the delay
    for k in range(0, 40, 10):
        add_file(spark, part[k:k + 10], DOC, source)
    schema = spark.read.parquet(source).schema

    def run():
        return drive(spark, ST.shuffle_stream(stream(spark, schema, source), "doc_id", "ts", 9, delay="2 minutes", groups=4), out)
    first = run().count()
    assert 0 < first < 40                   # the rest waits in the buffer
    rest = sorted(rows[40:], key=lambda r: r[0] + rng.uniform(0, 8))
    for k in range(0, 40, 8):
        add_file(spark, rest[k:k + 8], DOC, source)
    add_file(spark, END, DOC, source)
    got = run()                             # a new query from the same checkpoint
    assert ordered(spark, got, S.pushed_order("doc_id")) == want
    had = {r["doc_id"]: r for r in got.collect()}
    for i, ts, text, score, tags in rows:
        r = had[i]
        assert (r["text"], str(r["score"]), r["tags"]) == (text, str(score), tags)
        assert r["ts"].astimezone(UTC) == ts or r["ts"].replace(tzinfo=UTC) == ts


def test_stream_shuffle_does_not_depend_on_the_cut(spark, tmpdir_fresh):
    rows = documents(50, 5)
    orders = []
    for n, (size, groups) in enumerate(((50, 1), (7, 16))):
        source = f"{tmpdir_fresh}/in{n}"
        for k in range(0, 50, size):
            add_file(spark, rows[k:k + size], DOC, source)
        add_file(spark, END + [(None, T0, "no id", None, None), (7000, None, "no time", None, None)], DOC, source)
        got = drive(spark, ST.shuffle_stream(stream(spark, spark.read.parquet(source).schema, source), "doc_id", "ts", 16,
                                             groups=groups), f"{tmpdir_fresh}/out{n}")
        orders.append(ordered(spark, got, S.pushed_order("doc_id")))
    assert orders[0] == orders[1] and sorted(orders[0]) == list(range(50)) and orders[0] != list(range(50))


# --- checkpoints --------------------------------------------------------------------

CKPT = "run string, step long, metrics map<string,double>"


def checkpoints(seed=1):
    rng = random.Random(seed)
    rows = []
    for run in ("a", "b", "hot", None):
        for step in range(1, 60 if run == "hot" else 9):
            v = rng.choice([None, float("nan"), float("inf"), float("-inf"), 1.0, 0.5, rng.random()])
            rows.append((run, step, {} if rng.random() < 0.1 else {"eval_loss": v, "other": 1.0}))
    return rows


@pytest.mark.parametrize("mode, keep", [("min", 3), ("max", 1)])
def test_checkpoint_stream_equals_batch(spark, tmpdir_fresh, mode, keep):
    rows = checkpoints()
    rows.sort(key=lambda r: r[1])           # each run's steps arrive in order
    source = f"{tmpdir_fresh}/in"
    out = f"{tmpdir_fresh}/out"
    schema = spark.createDataFrame(rows[:1], CKPT).schema
    decided = None
    for k in range(0, len(rows), 20):       # each file by a query of its own: a restart for each
        add_file(spark, rows[k:k + 20], CKPT, source)
        decided = drive(spark, ST.checkpoint_stream(stream(spark, schema, source), mode=mode, max_to_keep=keep), out)
        best = R.running_best(spark.createDataFrame(rows[:k + 20], CKPT), mode=mode)
        want = {(r.run, r.step): (r.is_best, r.best_metric_value) for r in best.collect()}
        assert {(r.run, r.step): (r.is_best, r.best_metric_value) for r in decided.collect()} == want
        plan = R.checkpoint_retention(best.where("run is not null"), max_to_keep=keep).collect()
        got = {(r.run, r.step): (r.kept, r.best_copy, r.action) for r in ST.retention_plan(decided).collect() if r.run}
        assert got == {(r.run, r.step): (r.kept, r.best_copy, r.action) for r in plan}
    assert decided.count() == len(rows)


def test_checkpoint_stream_arguments(spark, tmpdir_fresh):
    add_file(spark, checkpoints()[:3], CKPT, tmpdir_fresh + "/in")
    s = stream(spark, spark.read.parquet(tmpdir_fresh + "/in").schema, tmpdir_fresh + "/in")
    for bad in ({"mode": "best"}, {"max_to_keep": -1}):
        with pytest.raises(ValueError):
            ST.checkpoint_stream(s, **bad)


# --- turns ------------------------------------------------------------------------

TURN = "conv_id long, turn long, role string, text string, ts timestamp"


def turns():
    rng = random.Random(4)
    rows = []
    for conv in range(12):
        ts = T0 + dt.timedelta(minutes=conv)
        for turn in range(rng.randrange(1, 14)):
            ts += dt.timedelta(minutes=rng.choice([1, 2, 3, 40]))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", f"{conv}.{turn}"]), ts))
    return rows + [(99, 1, "user", "no time", None), (None, 1, "user", "no id", T0), (5, None, "user", "no turn", T0)]


def sessions(df):
    return sorted(((r.conv_id, r.session_start, r.session_end, r.turns, r.prompt, r.response) for r in df.collect()), key=str)


def test_fold_turns_stream_equals_batch_on_shuffled_arrival(spark, tmpdir_fresh):
    rows = turns()
    want = sessions(ST.fold_turns(spark.createDataFrame(rows, TURN)))
    arrival = rows[:]
    random.Random(8).shuffle(arrival)
    source = f"{tmpdir_fresh}/in"
    for k in range(0, len(arrival), 13):
        add_file(spark, arrival[k:k + 13], TURN, source)
    add_file(spark, [(1000, 1, "user", "closes the rest", dt.datetime(2030, 1, 1, tzinfo=UTC))], TURN, source)
    got = J.run_to_table(ST.fold_turns(stream(spark, spark.read.parquet(source).schema, source), delay="2 days"),
                         f"{tmpdir_fresh}/out")
    assert sessions(got) == want and len(want) > 20


def test_late_turns(spark, tmpdir_fresh):
    """A turn within the delay changes the pair; one after the watermark doesn't."""
    def at(m):
        return T0 + dt.timedelta(minutes=m)
    source = f"{tmpdir_fresh}/in"
    files = [[(1, 0, "user", "q", at(0)), (1, 3, "assistant", "late answer", at(9))],
             [(2, 0, "user", "other", at(40))],
             [(1, 2, "assistant", "early answer", at(5)), (1, 4, "user", "last question", at(12))],
             [(2, 1, "user", "far", at(400))], [(1, 9, "user", "too late", at(13))], [(3, 0, "user", "end", at(4000))]]
    schema = spark.createDataFrame(files[0], TURN).schema
    for f in files:                         # one micro-batch each
        add_file(spark, f, TURN, source)
        got = J.run_to_table(ST.fold_turns(stream(spark, schema, source), gap="15 minutes", delay="60 minutes"),
                             f"{tmpdir_fresh}/out")
    of = {(r.conv_id, r.turns): (r.prompt, r.response) for r in got.collect()}
    assert of[1, 4] == ("last question", "late answer") and len([k for k in of if k[0] == 1]) == 1


# --- targets ----------------------------------------------------------------------

def test_targets_after_a_failure_between_them(spark, tmpdir_fresh):
    log = "run string, step long, metrics map<string,double>"
    source, ck = f"{tmpdir_fresh}/in", f"{tmpdir_fresh}/ck"
    for k in range(3):
        add_file(spark, [("r", 2 * k + i, {"a": float(i), "b": None, "c": 1.0}) for i in range(2)], log, source)
    schema = spark.read.parquet(source).schema
    calls, failing = [], {"third": {1}, "second": {1, 2}}

    def target(name):
        write = J.file_target(f"{tmpdir_fresh}/{name}", "json" if name == "second" else "parquet")

        def run(rows, batch_id):
            calls.append((name, batch_id))
            if batch_id in failing.get(name, ()):
                failing[name].discard(batch_id)
                if name == "second":
                    write(rows.limit(1), batch_id)      # half of it is there
                raise OSError("lost")
            write(rows, batch_id)
        return run
    names = ("first", "second", "third")
    for _ in range(3):
        q = J.metric_log_targets(stream(spark, schema, source), {n: target(n) for n in names}, ck)
        try:
            q.awaitTermination()
        except Exception:
            assert "is missing in" in str(q.exception())
    want = sorted((r.run, r.step, r.key, r.value) for r in J.metric_rows(spark.read.parquet(source)).collect())
    assert len(want) == 12
    for n in names:
        got = spark.read.format("json" if n == "second" else "parquet").load(f"{tmpdir_fresh}/{n}").collect()
        assert sorted((r.run, r.step, r.key, r.value) for r in got) == want
    assert calls.count(("first", 1)) == 1 and calls.count(("second", 1)) == 2 and calls.count(("third", 1)) == 2
    assert calls.count(("first", 2)) == 1 and calls.count(("second", 2)) == 2

"""Checkpoint folders: equal rows after a write, nothing after an aborted one, the same after a recovery."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tunelake.sources import checkpoint_folders as C
from tunelake.sources.readers import TRAINER_STATE_SCHEMA, read_trainer_states

INF = float("inf")


def states(n=40):
    rows = [(i, i // 10, {"eval_loss": 1.0 / (i + 1), "ä": -0.5}, i % 7 == 0, 1.0 / (i + 1), {"note": f"x\n\"{i}\""}) for i in range(n)]
    return rows + [(n, None, {}, False, INF, {}), (n + 1, 0, {"eval_loss": INF}, None, None, {})]


def frame(spark, rows, parts=6):
    return spark.createDataFrame(rows, TRAINER_STATE_SCHEMA).repartition(parts)


def read(spark, root):
    return sorted((tuple(r) for r in read_trainer_states(spark, root).collect()), key=lambda r: r[0])


def folders(root):
    return sorted(os.listdir(root)) if os.path.isdir(root) else []


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_round_trip(spark, tmpdir_fresh, scheme):
    root = f"{scheme}{tmpdir_fresh}/ck"
    C.write_checkpoint_folders(frame(spark, states()), root)
    assert read(spark, root) == states()
    assert folders(f"{tmpdir_fresh}/ck") == sorted([f"checkpoint-step-{i}" for i in range(42)] + ["checkpoint-best"])
    with open(f"{tmpdir_fresh}/ck/checkpoint-best/trainer_state.json") as f:
        assert json.load(f)["step"] == 35
    with open(f"{tmpdir_fresh}/ck/checkpoint-step-3/trainer_state.json") as f:
        assert json.load(f) == {"step": 3, "epoch": 0, "metrics": {"eval_loss": 0.25, "ä": -0.5}, "is_best": False,
                                "best_metric_value": 0.25, "extra_state": {"note": "x\n\"3\""}}


def test_later_writes_replace_folders(spark, tmpdir_fresh):
    root = f"{tmpdir_fresh}/ck"
    C.write_checkpoint_folders(frame(spark, states(5)), root)
    C.write_checkpoint_folders(frame(spark, [(2, 7, {}, False, 1.0, {}), (2, 9, {"a": 1.0}, False, 1.0, {}), (9, 1, {}, False, 1.0, {}),
                                             (None, 1, {}, True, 0.0, {})]), root)
    got = {r[0]: r for r in read(spark, root)}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 6, 9] and got[2] == (2, 9, {"a": 1.0}, False, 1.0, {})
    with open(f"{root}/checkpoint-best/trainer_state.json") as f:
        assert json.load(f)["step"] == 0        # the second write marks no best


def test_aborted_job_leaves_nothing(spark, tmpdir_fresh):
    root = f"{tmpdir_fresh}/ck"
    C.write_checkpoint_folders(frame(spark, states(3)), root)
    before = read(spark, root)
    bad = frame(spark, states(200), 8).withColumn("epoch", F.when(F.col("step") == 150, F.raise_error(F.lit("lost")).cast("long"))
                                                 .otherwise(F.col("epoch")))
    with pytest.raises(Exception, match="lost"):
        C.write_checkpoint_folders(bad, root)
    assert read(spark, root) == before and folders(root) == ["checkpoint-best"] + [f"checkpoint-step-{i}" for i in range(5)]


def test_recovery_after_a_lost_driver(spark, tmpdir_fresh, monkeypatch):
    root = f"{tmpdir_fresh}/ck"
    publish = C._publish

    def lost(*args):
        raise KeyboardInterrupt
    monkeypatch.setattr(C, "_publish", lost)
    with pytest.raises(KeyboardInterrupt):
        C.write_checkpoint_folders(frame(spark, states()), root)
    monkeypatch.setattr(C, "_publish", publish)
    assert read(spark, root) == []              # committed, not yet in place
    staging = [f for f in folders(root) if f.startswith(".staging-")][0]
    part = sorted(p for p in os.listdir(f"{root}/{staging}") if p.startswith("part"))[0]
    one = os.listdir(f"{root}/{staging}/{part}")[0]  # a task moved one file before it was lost
    os.makedirs(f"{root}/{one}", exist_ok=True)
    os.rename(f"{root}/{staging}/{part}/{one}/trainer_state.json", f"{root}/{one}/trainer_state.json")
    os.makedirs(f"{root}/.staging-never/part-0-0/checkpoint-step-999")  # a write that was not committed
    C.recover(spark, root)
    assert read(spark, root) == states() and not [f for f in folders(root) if f.startswith(".")]
    C.recover(spark, root)
    assert read(spark, root) == states()


def test_parts_of_lost_attempts_do_not_count(tmpdir_fresh):
    w = C._Writer(tmpdir_fresh, "t")
    for part in ("part-0-1", "part-0-2"):
        os.makedirs(f"{tmpdir_fresh}/.staging-t/{part}/checkpoint-step-1")
    w.commit([C._Part("part-0-2"), C._Part(None), None])
    with open(f"{tmpdir_fresh}/.staging-t/_COMMITTED") as f:
        assert f.read() == "part-0-2"


def test_empty_table(spark, tmpdir_fresh):
    C.write_checkpoint_folders(frame(spark, [], 1), f"{tmpdir_fresh}/ck")
    assert read(spark, f"{tmpdir_fresh}/ck") == [] and folders(f"{tmpdir_fresh}/ck") == []


def test_many_small_folders_are_spread_over_tasks(spark, tmpdir_fresh, monkeypatch):
    """Small rows would be coalesced to one task; each part's staged folders go with their files."""
    root, staged, publish = f"{tmpdir_fresh}/ck", [], C._publish

    def seen(spark, path, transaction):
        staged.extend(os.listdir(f"{path}/.staging-{transaction}"))
        publish(spark, path, transaction)
    monkeypatch.setattr(C, "_publish", seen)
    C.write_checkpoint_folders(frame(spark, states(80)), root)
    assert sum(name.startswith("part-") for name in staged) > 4
    assert read(spark, root) == states(80)
    part = f"{root}/.staging-x/part-0-0"
    os.makedirs(f"{part}/checkpoint-step-90")
    with open(f"{part}/checkpoint-step-90/trainer_state.json", "w") as f:
        f.write("{}")
    import pandas as pd
    move = C._move_parts(root, "x")
    frames = [pd.DataFrame({"part": ["part-0-0"]})]
    assert [f["moved"].tolist() for f in move(iter(frames))] == [[1]] and not os.path.exists(part)
    assert [f["moved"].tolist() for f in move(iter(frames))] == [[0]]   # again, as after a lost task


def test_listing_setting_is_restored(spark, tmpdir_fresh):
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    assert read(spark, f"{tmpdir_fresh}/none") == [] and spark.conf.get(key) == before

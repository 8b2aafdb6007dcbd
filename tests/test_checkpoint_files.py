"""Many checkpoint folders: moved whole, and listed and read by tasks with the rows of Spark's own reader."""

import json
import os

import pandas as pd
import pytest

from tunelake.sources import checkpoint_folders as C
from tunelake.sources.readers import TRAINER_STATE_SCHEMA, read_trainer_states


def put(folder, text, encoding="utf-8"):
    os.makedirs(folder)
    with open(f"{folder}/{C.STATE_FILE}", "wb") as f:
        f.write(text.encode(encoding))


def test_folders_are_moved_whole(tmpdir_fresh):
    part = f"{tmpdir_fresh}/.staging-x/part-0-0"
    for i in range(4):
        put(f"{part}/checkpoint-step-{i}", f'{{"step": {i}}}')
    os.remove(f"{part}/checkpoint-step-3/{C.STATE_FILE}")       # moved by an attempt that was lost
    put(f"{tmpdir_fresh}/checkpoint-step-3", '{"step": 3}')
    put(f"{tmpdir_fresh}/checkpoint-step-2", '{"step": -1}')    # replaced; what is beside the state stays
    with open(f"{tmpdir_fresh}/checkpoint-step-2/weights.bin", "w") as f:
        f.write("w")
    staged = [os.stat(f"{part}/checkpoint-step-{i}").st_ino for i in range(2)]
    moved = list(C._move_parts(tmpdir_fresh, "x")(iter([pd.DataFrame({"part": ["part-0-0"]})])))
    assert [f["moved"].tolist() for f in moved] == [[3]] and not os.path.exists(part)
    assert [os.stat(f"{tmpdir_fresh}/checkpoint-step-{i}").st_ino for i in range(2)] == staged
    for i in range(4):
        with open(f"{tmpdir_fresh}/checkpoint-step-{i}/{C.STATE_FILE}") as f:
            assert json.load(f) == {"step": i}
    assert sorted(os.listdir(f"{tmpdir_fresh}/checkpoint-step-2")) == [C.STATE_FILE, "weights.bin"]


@pytest.mark.parametrize("name", ["plain", "a b", "a%20b", "ä#1"])
def test_states_are_read_as_spark_reads_them(spark, tmpdir_fresh, name):
    root = f"{tmpdir_fresh}/{name}"
    texts = ['{"step": 1, "metrics": {"ä": 0.5, "x": Infinity}, "extra_state": {"k": "é\\n"}}', '[{"step": 2}, {"step": 3}]',
             '{"step": "no number", "epoch": 4}', "not json", "", '{\n "step": 5,\n "is_best": true\n}', "{}", "null"]
    for i, text in enumerate(texts):
        put(f"{root}/checkpoint-step-{i}", text)
    put(f"{root}/checkpoint-step-x", '{"step": 6, "extra_state": {"k": "ö"}}', "utf-16-le")
    put(f"{root}/checkpoint-best", '{"step": 7}')
    put(f"{root}/checkpoint-step-8/deeper", '{"step": 8}')
    os.makedirs(f"{root}/checkpoint-step-9")
    with open(f"{root}/checkpoint-step-10", "w") as f:
        f.write("a file")

    def rows(df):
        return sorted(map(str, df.collect()))
    got = read_trainer_states(spark, root)
    spark_reader = spark.read.option("multiLine", True).schema(TRAINER_STATE_SCHEMA)
    assert rows(got) == rows(spark_reader.json(f"{root}/checkpoint-step-*/{C.STATE_FILE}"))
    assert rows(got) == rows(read_trainer_states(spark, f"{tmpdir_fresh}/*"))
    if name == "plain":  # no file is known to the driver
        assert got.inputFiles() == []

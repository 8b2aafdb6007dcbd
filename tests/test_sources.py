import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tunelake.sources import readers as R
from tunelake.sources.writers import evaluation_payload, write_trainer_states


@pytest.mark.parametrize("name", ["some-org/chat_dataset_v2", "data/train.jsonl", "a.tar.gz",
                                  ".hidden", "dir/", "x/..a", "plain", "a.", "http://h.example.com/en/825?p=2&r=x",
                                  "https://x.example.org/a/b.html#top"])
def test_slug_equals_path_stem(spark, name):
    got = spark.range(1).select(R.dataset_slug(F.lit(name)).alias("s")).first().s
    assert got == Path(name).stem.replace("/", "_")


def test_score_vectors_roundtrip_and_mismatch(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "v.json")
    with open(p, "w") as f:
        json.dump({"base_model": "b", "fused_model": "f", "base_results": {"rougeL": 1.0},
                   "fused_results": {"rougeL": 2.0}, "scores_base": [0.0, 6.8182, 1.0],
                   "scores_fused": [0.0, 6.8182]}, f, indent=2)
    v = R.read_score_vectors(spark, p).orderBy("sample_id").collect()
    assert [(r.base, r.fused) for r in v] == [(0.0, 0.0), (6.8182, 6.8182), (1.0, None)]
    scores = R.read_score_vectors(spark, p).where("fused IS NOT NULL")
    pay = evaluation_payload(scores, "b", "f", {"rougeL": 1.0}, {"rougeL": 2.0}, with_vectors=True).first()
    assert pay.scores_base == [0.0, 6.8182] and pay.base_results == {"rougeL": 1.0}
    assert evaluation_payload(scores, "b", "f", {}, {}).first().scores_base == []


def test_eval_items_and_missing_file(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "items.json")
    with open(p, "w") as f:
        json.dump([{"prompt": "q", "reference": "r"}, {"prompt": "q2", "reference": "r2"}], f)
    assert R.read_eval_items(spark, p).count() == 2
    with pytest.raises(FileNotFoundError):
        R.read_eval_items(spark, p + ".missing")
    assert R.read_eval_items(spark, p + ".missing", allow_default=True).count() == len(R.DEFAULT_EVAL_ITEMS)
    assert R.read_eval_items(spark, "file://" + p).count() == 2


def test_trainer_states(spark, tmpdir_fresh):
    root = os.path.join(tmpdir_fresh, "ckpt")
    assert R.read_trainer_states(spark, root).count() == 0
    for step in (100, 200):
        d = os.path.join(root, f"checkpoint-step-{step}")
        os.makedirs(d)
        with open(os.path.join(d, "trainer_state.json"), "w") as f:
            json.dump({"step": step, "epoch": 0, "metrics": {"eval_loss": step / 100}, "is_best": True,
                       "best_metric_value": step / 100, "extra_state": {}}, f, indent=2)
    st = R.read_trainer_states(spark, root)
    assert sorted(r.step for r in st.collect()) == [100, 200]
    write_trainer_states(st.withColumn("run", F.lit("r")), os.path.join(tmpdir_fresh, "out"))
    back = R.read_trainer_states(spark, os.path.join(tmpdir_fresh, "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, st.collect()))
    assert R.read_trainer_states(spark, "file://" + root).count() == 2


def test_unknown_split_is_an_error(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "plain.parquet")
    spark.range(3).write.parquet(p)
    with pytest.raises(ValueError):
        R.read_pairs_source(spark, p, split="validation")


def test_cap_samples_keeps_whole_conversations(spark):
    turns = spark.createDataFrame([(c, t) for c in range(5) for t in range(3)], "conv_id bigint, turn bigint")
    got = R.cap_samples(turns, max_samples=2)
    assert sorted({r.conv_id for r in got.collect()}) == [0, 1] and got.count() == 6


def test_benchmark_report(spark, tmpdir_fresh):
    """The speed-up row as JSON."""
    from tunelake.operators.runs import latency_percentiles, variant_speedup
    from tunelake.sources.writers import write_summary_json
    log = spark.createDataFrame([("a", 2.0, 7.0), ("a", 4.0, 9.0), ("b", 1.5, 4.0)], "variant string, elapsed_ms double, peak_mb double")
    write_summary_json(variant_speedup(latency_percentiles(log), "a", "b"), tmpdir_fresh + "/r")
    row = spark.read.json(tmpdir_fresh + "/r").first()
    assert (row.speedup_factor, row.vram_saved_mb) == (2.0, 5.0)

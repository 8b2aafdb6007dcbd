import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tunelake.operators import scoring as SC
from tunelake.plans import jobs as J
from tunelake.plans.catalog import QUERIES

from paths import SF_SMALL


def test_eda_job_on_turn_table(spark, tmpdir_fresh):
    row = J.run_eda_job(spark, f"{SF_SMALL}/conversations.parquet", tmpdir_fresh)
    assert row.dataset_name == "conversations"
    q = QUERIES["eda_summary"](spark, SF_SMALL).first()
    assert row.total_sequence_quantiles.p99 == pytest.approx(q.total_p99)
    assert glob.glob(f"{tmpdir_fresh}/conversations_eda_summary.json/*.json")
    md = "\n".join(r.value for r in spark.read.text(f"{tmpdir_fresh}/conversations_eda_report.md").collect())
    assert "samples fit into" in md
    assert spark.read.parquet(f"{tmpdir_fresh}/conversations_total_histogram.parquet").count() == 60


def test_eda_job_flat_columns_and_empty(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "flat.parquet")
    spark.createDataFrame([("a b", "c"), ("d", "e f g")], "instruction string, output string").write.parquet(src)
    row = J.run_eda_job(spark, src, os.path.join(tmpdir_fresh, "out"), dataset_name="flat")
    assert row.total_samples == 2 and row.total_sequence_quantiles.max_len == 4
    empty = os.path.join(tmpdir_fresh, "empty.parquet")
    spark.createDataFrame([("", "x")], "prompt string, response string").write.parquet(empty)
    with pytest.raises(ValueError):
        J.run_eda_job(spark, empty, os.path.join(tmpdir_fresh, "out2"))


def test_evaluation_then_significance(spark, tmpdir_fresh):
    items = os.path.join(tmpdir_fresh, "items.json")
    rows = [{"prompt": f"w{i} shared words here", "reference": f"shared words w{i} extra{i % 3}"} for i in range(12)]
    with open(items, "w") as f:
        json.dump(rows, f)
    out = os.path.join(tmpdir_fresh, "eval")
    payload = J.run_evaluation_job(spark, items, out, lambda: SC.echo_model(2), lambda: SC.echo_model(4),
                                   "small", "large").first()
    assert len(payload.scores_base) == len(payload.scores_fused) == 12
    assert "perplexity" in payload.base_results
    full = J.run_evaluation_job(spark, items, os.path.join(tmpdir_fresh, "lib"), lambda: SC.echo_model(2),
                                lambda: SC.echo_model(4), library=True).first()
    assert 0 <= full.base_results["rouge2"] <= full.base_results["rouge1"] <= 100 and full.base_results["rouge1"] > 0
    vec = glob.glob(f"{out}/raw_evaluation_vectors.json/*.json")[0]
    rep = J.run_significance_job(spark, vec, os.path.join(tmpdir_fresh, "sig"))
    assert rep.n == 12 and rep.mean_delta > 0
    written = spark.read.json(os.path.join(tmpdir_fresh, "sig", "statistical_significance_report.json")).first()
    assert written.aggregate_metrics.base.rougeL == pytest.approx(payload.base_results["rougeL"])
    assert spark.read.parquet(os.path.join(tmpdir_fresh, "sig", "delta_histogram.parquet")).count() == 15


def test_training_data_job(spark, tmpdir_fresh):
    b = J.run_training_data_job(spark, f"{SF_SMALL}/conversations.parquet", tmpdir_fresh, max_steps=3)
    n = b.count()
    assert n > 0 and b.where(F.size("input_ids") != F.col("batch_max_len")).count() == 0
    plan = spark.read.parquet(f"{tmpdir_fresh}/accumulation_plan.parquet")
    assert plan.count() == 3 * 8


def test_each_item_is_scored_once(spark, tmpdir_fresh):
    calls = os.path.join(tmpdir_fresh, "calls")
    os.makedirs(calls)
    items = os.path.join(tmpdir_fresh, "items.jsonl")
    with open(items, "w") as f:
        f.writelines(json.dumps({"prompt": f"p{i} q", "reference": f"p{i}"}) + "\n" for i in range(10))

    def counting():
        import os as o
        import uuid
        model = SC.echo_model(3)

        def run(batch):
            with open(o.path.join(calls, f"{uuid.uuid4().hex}-{len(batch)}"), "w"):
                return model(batch)
        return run
    J.run_evaluation_job(spark, items, os.path.join(tmpdir_fresh, "out"), counting, lambda: SC.echo_model(3))
    assert sum(int(f.rsplit("-", 1)[1]) for f in os.listdir(calls)) == 10

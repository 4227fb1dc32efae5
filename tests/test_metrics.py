"""Worked values of the metrics, and the agreement of their forms."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import attention, hidden, positions, probability, sampling, scheduling
from tessera.queries import ORACLE_SQL, QUERIES
from tessera.schema import PROBABILITY_METRICS, TABLES

LN = [math.log(x) for x in (0.5, 0.25, 0.25)]


def row(df):
    return df.collect()[0].asDict()


@pytest.fixture(scope="module", params=["native", "arrow"])
def form(request):
    return getattr(probability, request.param)


def test_three_tokens(spark, form):
    # Rates of 1/2, 1/4 and 1/4, for which every metric is known in closed form.
    r = row(form(spark.createDataFrame([(LN, 1)], "logits array<double>, selected int")))
    h = 0.5 * math.log(0.5) + 0.5 * math.log(0.25)
    want = {
        "logp": math.log(0.25), "gini": 0.375, "entropy": h, "max_prob": 0.5, "margin_top2": 0.25, "log_ratio_margin_top2": math.log(2), "selected_dominance": -math.log(2), "selected_rank": -2,
        "selected_logrank": -math.log(2), "topk_mass_2": 0.75, "tail_mass_2": -0.25, "nucleus_size_0p9": -3, "inverse_perplexity": math.exp(h), "dist_perplexity": -math.exp(-h), "norm_entropy_concentration": 1 + h / math.log(3),
    }
    assert r["metrics_valid"] and r["invalid_reason"] is None
    assert {k: r[k] for k in want} == pytest.approx(want, abs=1e-9)


def test_point_mass(spark, form):
    r = row(form(spark.createDataFrame([([0.0, -math.inf, -math.inf], 0)], "logits array<double>, selected int")))
    assert r["kl_u_p"] == r["log_ratio_margin_top2"] == r["selected_dominance"] == math.inf
    assert r["entropy"] == 0 and r["nucleus_size_0p99"] == -1 and r["metrics_valid"]


def test_invalid_rows(spark, form):
    bad = [
        (None, 0), ([1.0], 0), ([1.0, math.nan], 0), ([1.0, math.inf], 0), ([-math.inf] * 2, 0), ([1.0, 2.0], 2), ([1.0, 2.0], -1),
        ([1.0, 2.0], None), ([1.0, None], 0), ([], 0),
    ]
    for r in form(spark.createDataFrame(bad, "logits array<double>, selected int")).collect():
        assert not r.metrics_valid and r.invalid_reason == probability.REASON and all(r[m] is None for m in PROBABILITY_METRICS)


def test_forms_agree_with_ties_and_extremes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, np.round(rng.normal(size=int(rng.integers(2, 40))) * 10, 1).tolist(), 0) for i in range(40)] + [(99, [3.0, 3.0, 3.0, -math.inf], 2)]
    df = spark.createDataFrame(rows, "k int, logits array<double>, selected int")
    a = {r.k: r for r in probability.native(df).collect()}
    for r in probability.arrow(df).collect():
        for m in PROBABILITY_METRICS:
            assert a[r.k][m] == pytest.approx(r[m], rel=1e-9, abs=1e-9), (r.k, m)
    for r in probability.exploded(df, ["k"]).collect():
        for m in ("logp", "gini", "selected_rank", "nucleus_size_0p9", "topk_mass_5"):
            assert a[r.k][m] == pytest.approx(r[m], rel=1e-9), (r.k, m)


def attn(spark, v, i, p, g):
    schema = "attention array<double>, image array<int>, prompt array<int>, generated array<int>"
    return row(attention.metrics(spark.createDataFrame([(v, i, p, g)], schema)))


def test_attention_values(spark):
    r = attn(spark, [0.3, 0.15, 0.25, 0.0, 0.3], [0, 3], [1, 2], [4])
    assert r["img_attn_total"] == pytest.approx(0.3) and r["img_attn_avg"] == pytest.approx(0.15) and r["img_attn_kl_u_p"] == math.inf
    assert r["all_attn_total"] == pytest.approx(1.0) and r["attn_ratio_img_to_all"] + r["attn_ratio_prompt_generated_text_to_all"] == pytest.approx(1)


def test_the_query_takes_any_positive_total(spark, tmp_path):
    """A single generated position with a share below the operator's least total, against the query's SQL."""
    rows = [(1, [0.1] * 40 + [1e-6] + [0.1] * 23, 1), (2, [0.2] * 64, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("attn_groups", "attn_ratios"):
        found = con.sql(ORACLE_SQL[name])
        assert sorted(tuple(r[c] for c in found.columns) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(found.fetchall())


def test_attention_empty_invalid_and_clipped(spark):
    r = attn(spark, [0.3, 0.15, 0.25, 0.0, 0.3], [0, 3], [1, 2, 4], [])
    assert r["generated_text_attn_total"] == 0 and r["generated_text_attn_avg"] is None and r["valid"]
    for v, p in (([-1e-7, 0.3, 0.2, 0.1, 0.0], [1, 2]), ([math.nan, 0.3, 0.2, 0.1, 0.0], [1, 2]), ([0.1] * 5, [0, 2]), ([0.1] * 5, [9]), (None, [1])):
        r = attn(spark, v, [0, 4], p, [3])
        assert not r["valid"] and r["all_attn_total"] is None
    assert attn(spark, [-1e-9, 1.0], [0], [1], [])["img_attn_total"] == 0


def test_layers_invalidate_their_scenarios_only(spark):
    rows = [("t", layer, [math.nan if layer == 5 else 0.5, 0.5]) for layer in range(1, 37)]
    r = row(attention.mean_over_layers(spark.createDataFrame(rows, "k string, layer int, attention array<double>"), ["k"]))
    assert r["all_layers_all_heads"] is None and r["early_visual_integration"] is None and r["visual_reasoning"] == [0.5, 0.5]


def test_cosines(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, math.nan], [1.0, 0.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r[0] for r in df.select(hidden.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None, None, None]


def test_hidden_ranges(spark):
    rows = [("t", n, None if n == 1 else 1.0 if n == 36 else 0.5) for n in range(1, 37)]
    r = row(hidden.layer_means(spark.createDataFrame(rows, "k string, layer int, cosine double"), ["k"]))
    assert (r["valid_layers_all"], r["valid_layers_early_visual_integration"], r["valid_layers_visual_reasoning"]) == (35, 20, 13)
    assert r["cosine_gen_imgproto_hidden_avg_all_layers"] == pytest.approx(18 / 35) and r["cosine_gen_imgproto_hidden_last_layer"] == 1.0


def test_sampling(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0],)], "z array<double>")
    assert sorted(df.select(sampling.survivors(F.col("z"), sampling.Sampling(2.0, 0.7, 3))).first()[0]) == [2, 3]
    tied = spark.createDataFrame([([3.0, 3.0, 3.0, 2.0, 1.0, -math.inf],)], "z array<double>")
    assert tied.select(sampling.survivors(F.col("z"), sampling.Sampling(top_k=2))).first()[0] == [0, 1]
    assert tied.select(sampling.filtered(F.col("z"), sampling.Sampling(top_p=1e-9))).first()[0] == [3.0] + [-math.inf] * 5
    for bad in ({"temperature": 0}, {"top_p": 0}, {"top_k": 0}, {"repetition_penalty": 1.1}, {"temperature": math.inf}):
        with pytest.raises(ValueError):
            sampling.Sampling(**bad)


def test_stop_rule(spark):
    stop = lambda t, n: spark.range(1).select(sampling.stop(F.lit(t), F.lit(n), F.lit(4), [151645])).first()[0].asDict()
    assert stop(151645, 0) == {"retain": False, "stop": True, "reason": "stop_token"}
    assert stop(10, 3) == {"retain": True, "stop": True, "reason": "max_new_tokens"}
    assert stop(10, 2) == {"retain": True, "stop": False, "reason": None}


def test_schedule(spark):
    work = [("p", 12, 1), ("q", 5, 0), ("r", 7, 3), ("s", 5, 0), ("t", 1, 0), ("u", 20, 2), ("v", 7, 1)]
    items = spark.createDataFrame([(*x, k) for k, x in enumerate(work)], "id string, tokens int, images int, ordinal long")

    def batches(*args):
        out = {}
        for r in scheduling.schedule(items, *args).orderBy("batch", "slot").collect():
            out.setdefault(r.batch, []).append(r.id)
        return list(out.values())

    assert batches(3, "contiguous") == [["p", "q", "r"], ["s", "t", "u"], ["v"]]
    assert batches(2, "token_count_bucketed", 4) == [["q", "s"], ["r", "p"], ["t", "v"], ["u"]]
    assert batches(1, "token_count_bucketed", 4) == [[x[0]] for x in work]
    for bad in ((0, "contiguous"), (2, "other"), (4, "token_count_bucketed", 2)):
        with pytest.raises(ValueError):
            scheduling.schedule(items, *bad)


def test_ordinal_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 7919 % 1000)
    for n in (1, 5):
        got = scheduling.with_ordinal(df.repartition(n), ["v"]).where("ordinal <> v").count()
        assert got == 0


def test_spans(spark):
    tags = ["txt", "<i>", "pad", "pad", "</i>", "txt", "<i>", "<i>", "</i>", "pad"]
    df = spark.createDataFrame([("p", n, t) for n, t in enumerate(tags)], "k string, pos int, tag string")
    t = F.col("tag")
    found = positions.spans(df, ["k"], "pos", t == "<i>", t == "</i>", t == "pad", F.lit(False))
    assert [r.error for r in found.orderBy("pos").collect()] == [None] * 7 + ["nested_start", None, None]
    r = row(positions.groups(found, ["k"], "pos", t == "<i>", t == "</i>"))
    assert r["image"] == [2, 3, 9] and r["prompt"] == [0, 5] and r["n_errors"] == 1 and r["unterminated"]


def test_column_counts():
    assert {n: len(TABLES[n]) for n in ("token_probability_metrics", "token_attention_metrics", "token_hidden_state_metrics")} == {
        "token_probability_metrics": 41, "token_attention_metrics": 139, "token_hidden_state_metrics": 16,
    }

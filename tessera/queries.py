"""One query for each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import identity
from tessera.functions import text as T
from tessera.operators import attention, constraints, digests, hidden, positions, probability, sampling, scheduling, scoring
from tessera.plans import matrix
from tessera.schema import ATTENTION_METRICS, ATTENTION_RATIOS, PROBABILITY_METRICS, SCENARIOS
from tessera.session import read_table
from tessera.sources import datasets

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, keep: list[str], columns, digits: int = DIGITS) -> DataFrame:
    return df.select(*keep, *[(F.round(F.col(c).cast("double"), digits) + 0.0).alias(c) for c in columns])


def _sql_rounded(columns, digits: int = DIGITS, source: str = "") -> str:
    return ", ".join(f"round(CAST({source}{c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in columns)


# ---- probability ---------------------------------------------------------------------------------

PROBABILITY_SQL = """
WITH a AS (SELECT vec_id, label AS j, list_transform(embedding, lambda x: 20.0 * CAST(x AS DOUBLE)) AS z FROM embeddings),
b AS (SELECT *, list_max(z) AS m FROM a),
c AS (SELECT *, m + ln(list_sum(list_transform(z, lambda x: exp(x - m)))) AS lse FROM b),
d AS (SELECT vec_id, j, len(z) AS n, list_transform(z, lambda x: x - lse) AS lp FROM c),
e AS (SELECT *, list_transform(lp, lambda x: exp(x)) AS p, list_reverse_sort(lp) AS slp, lp[j + 1] AS l, -ln(n) AS u FROM d),
f AS (SELECT *, list_transform(slp, lambda x: exp(x)) AS s, list_sum(list_transform(lp, lambda x: exp(x) * x)) AS h, len(list_filter(lp, lambda x: x > l)) + 1 AS r,
             list_transform(lp, lambda x: greatest(x, u) + ln(1 + exp(least(x, u) - greatest(x, u))) - ln(2.0)) AS mix FROM e),
g AS (SELECT *, list_transform(range(1, n + 1), lambda k: list_sum(s[1:k])) AS cum FROM f),
w AS (SELECT vec_id, l AS logp, u - list_sum(lp) / n AS kl_u_p, -u + h AS kl_p_u, list_sum(list_transform(p, lambda x: x * x)) AS gini, h AS entropy, -exp(-h) AS dist_perplexity,
  exp(h) AS inverse_perplexity, s[1] AS max_prob, s[1] - s[2] AS margin_top2, slp[1] - slp[2] AS log_ratio_margin_top2,
  l - list_max(list_filter(lp, lambda x, i: i <> j + 1)) AS selected_dominance, -ln(r) AS selected_logrank,
  list_sum(s[1:2]) AS topk_mass_2, list_sum(s[1:5]) AS topk_mass_5, list_sum(s[1:10]) AS topk_mass_10, list_sum(s[1:20]) AS topk_mass_20,
  list_sum(s[1:2]) - 1 AS tail_mass_2, list_sum(s[1:5]) - 1 AS tail_mass_5, list_sum(s[1:10]) - 1 AS tail_mass_10, list_sum(s[1:20]) - 1 AS tail_mass_20, 1 - h / u AS norm_entropy_concentration,
  -2 * ln(list_sum(list_transform(lp, lambda x: exp(0.5 * x)))) AS renyi_entropy_0p5, h AS renyi_entropy_1, ln(list_sum(list_transform(lp, lambda x: exp(2 * x)))) AS renyi_entropy_2,
  ln(list_sum(list_transform(lp, lambda x: exp(4 * x)))) / 3 AS renyi_entropy_4, slp[1] AS renyi_entropy_inf,
  sqrt(greatest(0.0, (list_sum(list_transform(lp, lambda x, i: exp(x) * (x - mix[i]))) + list_sum(list_transform(mix, lambda x: (u - x) / n))) / 2)) AS js_p_u,
  -r AS selected_rank, -(len(list_filter(cum, lambda x: x < 0.9)) + 1) AS nucleus_size_0p9, -(len(list_filter(cum, lambda x: x < 0.95)) + 1) AS nucleus_size_0p95,
  -least(n, len(list_filter(cum, lambda x: x < 0.99)) + 1) AS nucleus_size_0p99 FROM g)
"""


def _probability_sql(metrics) -> str:
    return f"{PROBABILITY_SQL} SELECT vec_id, {_sql_rounded(metrics)} FROM w"


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * 20.0).alias("logits"), F.col("label").alias("selected"),
    )


BASIC = ("logp", "kl_u_p", "kl_p_u", "gini", "entropy", "dist_perplexity", "inverse_perplexity", "norm_entropy_concentration")
RANKED = tuple(m for m in PROBABILITY_METRICS if m.startswith(("max_prob", "margin", "log_ratio", "selected", "topk", "tail", "nucleus")))
RENYI = ("renyi_entropy_0p5", "renyi_entropy_1", "renyi_entropy_2", "renyi_entropy_4", "renyi_entropy_inf", "js_p_u")


@query(_probability_sql(BASIC))
def prob_basic(spark, sf_dir):
    return rounded(probability.native(_logits(spark, sf_dir), metrics=BASIC), ["vec_id"], BASIC)


@query(_probability_sql(RANKED))
def prob_ranked(spark, sf_dir):
    return rounded(probability.native(_logits(spark, sf_dir), metrics=RANKED), ["vec_id"], RANKED)


@query(_probability_sql(RENYI))
def prob_renyi_js(spark, sf_dir):
    return rounded(probability.native(_logits(spark, sf_dir), metrics=RENYI), ["vec_id"], RENYI)


@query(_probability_sql(PROBABILITY_METRICS))
def prob_arrow(spark, sf_dir):
    return rounded(probability.arrow(_logits(spark, sf_dir)), ["vec_id"], PROBABILITY_METRICS)


EXPLODED = (
    "logp", "gini", "entropy", "max_prob", "selected_rank", "topk_mass_2", "topk_mass_5", "topk_mass_10", "topk_mass_20", "nucleus_size_0p9",
    "nucleus_size_0p95", "nucleus_size_0p99",
)


@query(_probability_sql(EXPLODED))
def prob_exploded(spark, sf_dir):
    return rounded(probability.exploded(_logits(spark, sf_dir), ["vec_id"]), ["vec_id"], EXPLODED)


@query("SELECT vec_id, label BETWEEN 1 AND 7 AS metrics_valid, CASE WHEN label NOT BETWEEN 1 AND 7 THEN 'invalid_probability_logits' END AS invalid_reason FROM embeddings")
def prob_validity(spark, sf_dir):
    """Whole vectors of 64; a selected index of -1, or of 64 and more, is none of theirs."""
    picked = F.when(F.col("selected") == 0, -1).otherwise(F.col("selected") * 8)
    return probability.native(_logits(spark, sf_dir).withColumn("selected", picked), metrics=()).select("vec_id", "metrics_valid", "invalid_reason")


# ---- attention -----------------------------------------------------------------------------------

_GROUP_LISTS = {
    "img_attn": "v[1:16]", "prompt_text_attn": "v[17:40]", "generated_text_attn": "v[41:40 + label]",
    "prompt_generated_text_attn": "v[17:40 + label]", "all_attn": "v[1:40 + label]",
}
_NORMED = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE) / (list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))"


def _attention_columns(group: str, values: str) -> str:
    total, n = f"coalesce(list_sum({values}), 0.0)", f"len({values})"
    d = f"list_transform({values}, lambda x: x / {total})"
    entropy = f"list_sum(list_transform({d}, lambda x: x * ln(x)))"
    made = {
        "total": total, "avg": f"CASE WHEN {n} > 0 THEN {total} / {n} END", "gini": f"list_sum(list_transform({d}, lambda x: x * x))", "entropy": entropy,
        "kl_u_p": f"-ln({n}) - list_sum(list_transform({d}, lambda x: ln(x))) / {n}", "kl_p_u": f"ln({n}) + {entropy}", "dist_perplexity": f"-exp(-({entropy}))",
    }
    return ", ".join(f"CASE WHEN {n} > 0 OR '{k}' = 'total' THEN {v} END AS {group}_{k}" for k, v in made.items())


_ATTENTION_SQL = f"""
WITH a AS (SELECT vec_id, label, {_NORMED} AS v FROM embeddings),
b AS (SELECT vec_id, label, v, list_sum(v[1:16]) AS i, list_sum(v[17:40]) AS p, coalesce(list_sum(v[41:40 + label]), 0.0) AS g FROM a),
w AS (SELECT vec_id, {', '.join(_attention_columns(k, x) for k, x in _GROUP_LISTS.items())}, i / (i + p) AS attn_ratio_img_to_prompt_text, i / (i + g) AS attn_ratio_img_to_generated_text, i / (i + p + g) AS attn_ratio_img_to_all,
  p / (i + p + g) AS attn_ratio_prompt_text_to_all, g / (i + p + g) AS attn_ratio_generated_text_to_all, (p + g) / (i + p + g) AS attn_ratio_prompt_generated_text_to_all FROM b)
"""
GROUP_METRICS = tuple(m for m in ATTENTION_METRICS if m not in ATTENTION_RATIOS)


def _attention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", square.alias("sq")).withColumn("sum", F.aggregate("sq", F.lit(0.0), lambda s, x: s + x))
    generated = F.when(F.col("label") > 0, F.sequence(F.lit(40), 39 + F.col("label"))).otherwise(F.array().cast("array<int>"))
    return rows.select(
        "vec_id", "label", F.transform("sq", lambda x: x / F.col("sum")).alias("attention"), F.sequence(F.lit(0), F.lit(15)).alias("image"), F.sequence(F.lit(16), F.lit(39)).alias("prompt"), generated.alias("generated")
    )


@query(f"{_ATTENTION_SQL} SELECT vec_id, {_sql_rounded(GROUP_METRICS)} FROM w")
def attn_groups(spark, sf_dir):
    return rounded(attention.metrics(_attention_rows(spark, sf_dir), least=attention.POSITIVE), ["vec_id"], GROUP_METRICS)


@query(f"{_ATTENTION_SQL} SELECT vec_id, {_sql_rounded(ATTENTION_RATIOS)} FROM w")
def attn_ratios(spark, sf_dir):
    return rounded(attention.metrics(_attention_rows(spark, sf_dir), least=attention.POSITIVE), ["vec_id"], ATTENTION_RATIOS)


@query("SELECT vec_id, list_min(embedding) >= -1e-8 AS valid, CASE WHEN list_min(embedding) >= -1e-8 THEN round(list_sum(list_transform(embedding[1:2], lambda x: CAST(x AS DOUBLE))), 6) + 0.0 END AS img_attn_total FROM embeddings")
def attn_invalid(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("attention"), F.array(F.lit(0), F.lit(1)).alias("image"), F.array(F.lit(2)).alias("prompt"),
        F.array().cast("array<int>").alias("generated"),
    )
    return attention.metrics(rows).select("vec_id", "valid", (F.round("img_attn_total", 6) + 0.0).alias("img_attn_total"))


@query(
    f"""WITH a AS (SELECT vec_id, label, vec_id % 36 + 1 AS layer, {_NORMED} AS v FROM embeddings),
b AS (SELECT label, layer, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM a)
SELECT label, pos, {', '.join(f"round(avg(x) FILTER (layer BETWEEN {lo} AND {hi}), 9) + 0.0 AS {s}" for s, (lo, hi) in SCENARIOS.items())} FROM b GROUP BY label, pos"""
)
def attn_layers(spark, sf_dir):
    rows = _attention_rows(spark, sf_dir).withColumn("layer", (F.col("vec_id") % 36 + 1).cast("int"))
    means = attention.mean_over_layers(rows, ["label"])
    spread = means.select(
        "label", F.posexplode(F.arrays_zip(*SCENARIOS)).alias("pos", "x"),
    ).select("label", "pos", *[F.col(f"x.{s}").alias(s) for s in SCENARIOS])
    return spread.select("label", F.col("pos").cast("long").alias("pos"), *[(F.round(s, 9) + 0.0).alias(s) for s in SCENARIOS])


@query("SELECT label, CASE WHEN max(layer) > 36 OR min(layer) < 1 THEN 'unknown_layer' WHEN count(DISTINCT layer) < 36 THEN 'missing_layer' ELSE 'duplicate_layer' END AS error FROM (SELECT label, vec_id % 36 + 1 AS layer FROM embeddings) GROUP BY label HAVING count(DISTINCT layer) < 36 OR count(*) > 36 OR max(layer) > 36")
def attn_layer_errors(spark, sf_dir):
    return attention.layer_errors(read_table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 36 + 1).alias("layer")), ["label"])


# ---- hidden states -------------------------------------------------------------------------------

_HIDDEN_SQL = """
WITH a AS (SELECT vec_id, label, embedding FROM embeddings),
p AS (SELECT label, list(x ORDER BY i) AS proto FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, generate_subscripts(embedding, 1) AS i FROM a) GROUP BY label, i) GROUP BY label),
d AS (SELECT vec_id, a.label, list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * proto[i])) AS ab, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS na, sqrt(list_sum(list_transform(proto, lambda x: x * x))) AS nb FROM a JOIN p ON a.label = p.label),
c AS (SELECT vec_id, label, greatest(0.0, least(1.0, (ab / (na * nb) + 1) / 2)) AS cosine FROM d)
"""


def _cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return rows.join(hidden.prototypes(rows, ["label"], "embedding"), "label").select(
        "vec_id", "label", hidden.cosine(F.col("embedding"), F.col("prototype")).alias("cosine"),
    )


@query(f"{_HIDDEN_SQL} SELECT vec_id, round(cosine, 8) + 0.0 AS cosine FROM c")
def hidden_cosine(spark, sf_dir):
    return _cosines(spark, sf_dir).select("vec_id", (F.round("cosine", 8) + 0.0).alias("cosine"))


_RANGES = {"valid_layers_all": "1 AND 36", "valid_layers_early_visual_integration": "1 AND 21", "valid_layers_visual_reasoning": "22 AND 34"}
_MEANS = {"avg_all_layers": "1 AND 36", "early_visual_integration": "1 AND 21", "visual_reasoning": "22 AND 34"}


@query(
    f"""{_HIDDEN_SQL}, e AS (SELECT label, vec_id % 36 + 1 AS layer, CASE WHEN vec_id % 7 <> 0 THEN cosine END AS cosine FROM c)
SELECT label, {', '.join(f"count(cosine) FILTER (layer BETWEEN {r}) AS {n}" for n, r in _RANGES.items())}, max(cosine) FILTER (layer = 36) IS NOT NULL AS last_layer_valid,
{', '.join(f"round(avg(cosine) FILTER (layer BETWEEN {r}), 8) + 0.0 AS cosine_gen_imgproto_hidden_{n}" for n, r in _MEANS.items())}, round(max(cosine) FILTER (layer = 36), 8) + 0.0 AS cosine_gen_imgproto_hidden_last_layer FROM e GROUP BY label"""
)
def hidden_layer_ranges(spark, sf_dir):
    rows = _cosines(spark, sf_dir).select(
        "label", (F.col("vec_id") % 36 + 1).alias("layer"), F.when(F.col("vec_id") % 7 != 0, F.col("cosine")).alias("cosine"),
    )
    made = hidden.layer_means(rows, ["label"])
    return made.select(
        "label", *[F.col(c).cast("long").alias(c) for c in _RANGES], "last_layer_valid",
        *[(F.round(c, 8) + 0.0).alias(c) for c in made.columns if c.startswith("cosine_")],
    )


# ---- sampling ------------------------------------------------------------------------------------


@query(
    """WITH a AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: 20.0 * CAST(x AS DOUBLE) / 0.7)) AS z, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, i) <= 20),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS x FROM k), p AS (SELECT *, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM e),
c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY z DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT vec_id, count(*) AS n_kept, CAST(sum(i) AS BIGINT) AS sum_ids, round(sum(p), 6) AS mass FROM c WHERE before < 0.8 GROUP BY vec_id"""
)
def topk_topp_filter(spark, sf_dir):
    rows = _logits(spark, sf_dir)
    probs = sampling.softmax(sampling.filtered(F.col("logits"), sampling.Sampling(0.7, 1.0, 20)))
    ids = sampling.survivors(F.col("logits"), sampling.CONCENTRATED)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", ids.alias("ids"), probs.alias("p")).select(
        "vec_id", F.size("ids").cast("long").alias("n_kept"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, i: s + i).alias("sum_ids"), F.round(total(F.transform("ids", lambda i: F.col("p")[i])), 6).alias("mass")
    )


@query(
    """WITH a AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: 20.0 * CAST(x AS DOUBLE))) AS z, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS x FROM a), p AS (SELECT *, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM e),
c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY z DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
k AS (SELECT vec_id, i, sum(x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(x) OVER (PARTITION BY vec_id) AS reached FROM c WHERE before < 0.99)
SELECT vec_id, CAST(min(i) FILTER (reached > CAST('0x' || sha256(vec_id || chr(1) || '7')[1:13] AS BIGINT) / 4503599627370496.0) AS INTEGER) AS token_id FROM k GROUP BY vec_id"""
)
def sample_draw(spark, sf_dir):
    rows = _logits(spark, sf_dir)
    return rows.select(
        "vec_id", sampling.draw(sampling.softmax(sampling.filtered(F.col("logits"), sampling.DIVERSE)), F.col("vec_id"), F.lit(7)).alias("token_id"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey % 5 <> 0 AS retain, l_partkey % 5 = 0 OR l_linenumber = 4 AS stop, CASE WHEN l_partkey % 5 = 0 THEN 'stop_token' WHEN l_linenumber = 4 THEN 'max_new_tokens' END AS reason, count(*) AS n
FROM lineitem GROUP BY ALL"""
)
def stop_rule(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", sampling.stop(F.col("l_partkey") % 5, F.col("l_linenumber") - 1, F.lit(4), [0]).alias("s"),
    )
    return rows.groupBy("l_orderkey", "l_linenumber", "s.retain", "s.stop", "s.reason").agg(F.count(F.lit(1)).alias("n"))


# ---- scheduling ----------------------------------------------------------------------------------


def _schedule_sql(window: int, batch: int, order: str) -> str:
    return f"""WITH a AS (SELECT doc_id, n_chars AS tokens, doc_id % 3 AS images, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents),
b AS (SELECT *, ordinal // {window} AS win FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY {order}) - 1 AS nth FROM b)
SELECT doc_id, ordinal, win * {-(-window // batch)} + nth // {batch} AS batch, nth % {batch} AS slot, tokens, images FROM c"""


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("tokens"), (F.col("doc_id") % 3).alias("images"))
    return scheduling.with_ordinal(rows, ["doc_id"])


def _scheduled(spark: SparkSession, sf_dir: str, *args) -> DataFrame:
    return scheduling.schedule(_work(spark, sf_dir), *args).select("doc_id", "ordinal", "batch", F.col("slot").cast("long").alias("slot"), "tokens", "images")


@query(_schedule_sql(8, 8, "ordinal"))
def schedule_contiguous(spark, sf_dir):
    return _scheduled(spark, sf_dir, 8, "contiguous")


@query(_schedule_sql(50, 8, "tokens, images, ordinal"))
def schedule_bucketed(spark, sf_dir):
    return _scheduled(spark, sf_dir, 8, "token_count_bucketed", 50)


_TELEMETRY_SQL = f"""SELECT batch, count(*) AS prompt_count, min(tokens) AS min_prompt_length, max(tokens) AS max_prompt_length, CAST(sum(tokens) AS BIGINT) AS total_unpadded_prompt_tokens, count(*) * max(tokens) AS total_padded_prompt_tokens,
round((count(*) * max(tokens) - sum(tokens)) / (count(*) * max(tokens)), 9) AS padding_fraction, min(images) AS min_image_token_count, max(images) AS max_image_token_count FROM ({_schedule_sql(50, 8, 'tokens, images, ordinal')}) GROUP BY batch"""


@query(_TELEMETRY_SQL)
def batch_telemetry(spark, sf_dir):
    return scheduling.telemetry(_scheduled(spark, sf_dir, 8, "token_count_bucketed", 50)).withColumn("padding_fraction", F.round("padding_fraction", 9))


@query(f"SELECT count(*) AS batches, CAST(sum(prompt_count) AS BIGINT) AS prompts, CAST(sum(total_unpadded_prompt_tokens) AS BIGINT) AS unpadded_tokens, CAST(sum(total_padded_prompt_tokens) AS BIGINT) AS padded_tokens, round((sum(total_padded_prompt_tokens) - sum(total_unpadded_prompt_tokens)) / sum(total_padded_prompt_tokens), 9) AS padding_fraction FROM ({_TELEMETRY_SQL})")
def batch_totals(spark, sf_dir):
    return scheduling.totals(scheduling.telemetry(_scheduled(spark, sf_dir, 8, "token_count_bucketed", 50))).withColumn("padding_fraction", F.round("padding_fraction", 9))


@query("SELECT event_id, CASE WHEN value > 0 THEN round(event_id / value, 6) END AS tokens_per_second, CASE WHEN event_id % 100 > 10 THEN round((100 - event_id % 100) * 5.0 / (event_id % 100 - 10), 6) END AS eta FROM events")
def throughput_eta(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events")
    done = F.col("event_id") % 100
    return rows.select(
        "event_id", F.round(scheduling.throughput(F.col("event_id"), F.col("value")), 6).alias("tokens_per_second"),
        F.round(scheduling.remaining_seconds(F.lit(100), done, F.lit(10), F.lit(5.0)), 6).alias("eta"),
    )


# ---- constraints ---------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def token_key_dupes(spark, sf_dir):
    return constraints.duplicates(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, count(*) AS n, CAST(min(l_linenumber) AS BIGINT) AS first, CAST(max(l_linenumber) AS BIGINT) AS last, count(DISTINCT l_linenumber) AS distinct_steps FROM lineitem GROUP BY l_orderkey HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)")
def token_contiguity(spark, sf_dir):
    found = constraints.contiguity(read_table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")
    return found.select(
        "l_orderkey", "n", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"),
        F.col("distinct").alias("distinct_steps"),
    )


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_rollouts(spark, sf_dir):
    items = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return constraints.orphans(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), items, ["o_orderkey"])


@query("SELECT doc_id, k AS rollout_index FROM (SELECT doc_id FROM documents) d, (SELECT unnest(range(0, 4)) AS k) WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality + 2 * l.toxic = k)")
def pending_rollouts(spark, sf_dir):
    expected = matrix.expected_rollouts(read_table(spark, sf_dir, "documents").select("doc_id"), 4)
    done = read_table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 2 * F.col("toxic")).alias("rollout_index"))
    return matrix.pending(expected, done, ["doc_id", "rollout_index"]).select("doc_id", F.col("rollout_index").cast("long").alias("rollout_index"))


@query("SELECT user_id, count(DISTINCT event_id % 32) AS n_rollouts FROM events GROUP BY user_id HAVING count(DISTINCT event_id % 32) >= 29")
def completed_prompts(spark, sf_dir):
    return constraints.completed_prompts(read_table(spark, sf_dir, "events").withColumn("index", F.col("event_id") % 32), "user_id", "index", 29)


_STATUS = {"F": "complete", "O": "planned", "P": "failed"}


@query("""SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'complete' WHEN bool_or(o_orderstatus = 'P') THEN 'failed' WHEN NOT bool_and(o_orderstatus = 'O') THEN 'running' ELSE 'planned' END AS status FROM orders GROUP BY o_custkey""")
def status_rollup(spark, sf_dir):
    mapped = F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])[F.col("o_orderstatus")]
    return constraints.group_status(read_table(spark, sf_dir, "orders").withColumn("status", F.coalesce(mapped, F.lit("running"))), ["o_custkey"])


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, count(*) AS n_left FROM lineitem WHERE l_partkey % 10 < 9 GROUP BY ALL), b AS (SELECT l_orderkey, l_linenumber, count(*) AS n_right FROM lineitem WHERE l_partkey % 10 > 0 GROUP BY ALL)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber, n_left, n_right FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE n_left IS DISTINCT FROM n_right""")
def family_alignment(spark, sf_dir):
    items = read_table(spark, sf_dir, "lineitem")
    return constraints.misaligned(items.where("l_partkey % 10 < 9"), items.where("l_partkey % 10 > 0"), ["l_orderkey", "l_linenumber"])


@query("""(SELECT l_orderkey, l_linenumber, 'missing' AS side FROM lineitem WHERE l_partkey % 10 < 9 EXCEPT ALL SELECT l_orderkey, l_linenumber, 'missing' FROM lineitem WHERE l_partkey % 10 > 0)
UNION ALL (SELECT l_orderkey, l_linenumber, 'undeclared' FROM lineitem WHERE l_partkey % 10 > 0 EXCEPT ALL SELECT l_orderkey, l_linenumber, 'undeclared' FROM lineitem WHERE l_partkey % 10 < 9)""")
def declared_vs_actual(spark, sf_dir):
    items = read_table(spark, sf_dir, "lineitem")
    return constraints.set_difference(
        items.where("l_partkey % 10 < 9").select("l_orderkey", "l_linenumber"),
        items.where("l_partkey % 10 > 0").select("l_orderkey", "l_linenumber"),
    )


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 50 <> 7), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 60 = 3 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 70 <> 9)
SELECT coalesce(a.k, b.k) AS ordinal, a.k IS NULL AS only_stored, b.k IS NULL AS only_source FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s""")
def positional_diff(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("s"))
    stored = rows.where("ordinal % 70 <> 9").withColumn("s", F.when(F.col("ordinal") % 60 == 3, "X").otherwise(F.col("s")))
    return constraints.positional_differences(rows.where("ordinal % 50 <> 7"), stored, "ordinal", ["s"])


@query("SELECT l_suppkey % 16 AS shard_id, count(*) AS token_count, min(l_linenumber) AS min_step, max(l_linenumber) AS max_step FROM lineitem GROUP BY 1")
def shard_inventory(spark, sf_dir):
    return constraints.inventory(read_table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 16).alias("shard_id"), F.col("l_linenumber").alias("step"),
    ))


@query("""SELECT 'unique_lines' AS rule, count(*) AS n_violations FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'lines_have_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'contiguous_lines', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*))""")
def constraint_report(spark, sf_dir):
    tables = {n: read_table(spark, sf_dir, n) for n in ("lineitem", "orders")}
    rules = [
        constraints.Rule("unique_lines", lambda t: constraints.duplicates(t["lineitem"], ["l_orderkey", "l_linenumber"])),
        constraints.Rule(
            "lines_have_order",
            lambda t: constraints.orphans(t["lineitem"], t["orders"].withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"]),
        ),
        constraints.Rule("contiguous_lines", lambda t: constraints.contiguity(t["lineitem"], ["l_orderkey"], "l_linenumber")),
    ]
    return constraints.check(tables, rules)


# ---- plans and identities ------------------------------------------------------------------------


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("dataset"), F.lit("test").alias("split"), F.lit("all").alias("filter_id"))
    return matrix.runs(nations, read_table(spark, sf_dir, "region").select(F.col("r_name").alias("strategy")), "group-1")


_CELLS_SQL = "SELECT n_name AS dataset, 'test' AS split, 'all' AS filter_id, r_name AS strategy FROM nation, region"
#: The namespace for URLs of RFC 4122, as bytes.
_NAMESPACE_SQL = r"'\x6B\xA7\xB8\x11\x9D\xAD\x11\xD1\x80\xB4\x00\xC0\x4F\xD4\x30\xC8'::BLOB"


@query(_CELLS_SQL)
def run_matrix(spark, sf_dir):
    return _cells(spark, sf_dir).drop("run_id")


@query(f"""WITH a AS ({_CELLS_SQL}), b AS (SELECT *, sha1({_NAMESPACE_SQL} || encode(concat_ws(':', 'tessera', 'group-1', dataset, split, filter_id, strategy))) AS h FROM a)
SELECT dataset, strategy, 'run-' || h[1:12] || '5' || h[14:16] AS run_id FROM b""")
def run_ids(spark, sf_dir):
    return _cells(spark, sf_dir).select("dataset", "strategy", "run_id")


@query("""SELECT dataset, strategy, k AS rollout_index, CAST(CAST('0x' || sha256('{"base_seed":42,"dataset":"' || dataset || '","rollout_index":' || k || ',"sample_id":"s-1","seed_derivation_version":1,"strategy":"' || strategy || '"}')[1:16] AS UBIGINT) AS VARCHAR) AS rollout_seed
FROM (SELECT n_name AS dataset, r_name AS strategy FROM nation, region), (SELECT unnest(range(0, 3)) AS k)""")
def rollout_seeds(spark, sf_dir):
    rows = matrix.expected_rollouts(_cells(spark, sf_dir).withColumn("sample_id", F.lit("s-1")), 3)
    return matrix.with_seeds(rows, 42).select(
        "dataset", "strategy", F.col("rollout_index").cast("long").alias("rollout_index"), F.col("rollout_seed").cast("string").alias("rollout_seed"),
    )


@query("SELECT item_id, 'sample-' || sha256(text)[1:16] || '-r' || lpad(CAST(item_id AS VARCHAR), 4, '0') || '-' || lpad(CAST(item_id + 31 AS VARCHAR), 4, '0') AS shard_id FROM benchmark")
def shard_ids(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select(
        "item_id", identity.shard_id(F.col("text"), F.col("item_id"), F.col("item_id") + 31).alias("shard_id"),
    )


@query("""SELECT conv_id, sha256(unhex(string_agg(lpad(hex(octet_length(encode(text))), 16, '0') || hex(encode(text)), '' ORDER BY turn))) AS digest FROM conversations GROUP BY conv_id""")
def ordered_digest(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations")
    return digests.ordered_digests(rows, ["conv_id"], "text", ["turn"])


@query(f"""WITH p AS ({_probability_sql(('logp', 'entropy', 'selected_rank'))}), t AS ({_ATTENTION_SQL} SELECT vec_id, {_sql_rounded(('img_attn_total', 'attn_ratio_img_to_all'))} FROM w), h AS ({_HIDDEN_SQL} SELECT vec_id, round(cosine, 6) + 0.0 AS cosine FROM c)
SELECT e.vec_id, e.label, logp, entropy, selected_rank, img_attn_total, attn_ratio_img_to_all, cosine FROM embeddings e JOIN p ON p.vec_id = e.vec_id JOIN t ON t.vec_id = e.vec_id JOIN h ON h.vec_id = e.vec_id""")
def wide_view(spark, sf_dir):
    key = ["vec_id"]
    tables = {
        "tokens": read_table(spark, sf_dir, "embeddings").select("vec_id", "label"),
        "token_probability_metrics": prob_metrics(spark, sf_dir, ("logp", "entropy", "selected_rank")),
        "token_attention_metrics": rounded(attention.metrics(_attention_rows(spark, sf_dir), least=attention.POSITIVE), key, ("img_attn_total", "attn_ratio_img_to_all")),
        "token_hidden_state_metrics": rounded(_cosines(spark, sf_dir), key, ("cosine",)),
    }
    return matrix.wide_view(tables, key)


def prob_metrics(spark: SparkSession, sf_dir: str, names) -> DataFrame:
    return rounded(probability.native(_logits(spark, sf_dir), metrics=names), ["vec_id"], names)


# ---- positions and prompts -----------------------------------------------------------------------


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(</?p>)"), F.lit(1))).alias("pos", "tag"))


@query("""WITH a AS (SELECT page_id, unnest(t) AS tag, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '</?p>') AS t FROM pages)),
b AS (SELECT *, coalesce(sum(CASE WHEN tag = '<p>' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM a)
SELECT page_id, pos, CAST(depth AS BIGINT) AS depth, CASE WHEN tag = '<p>' AND depth >= 1 THEN 'nested_start' WHEN tag = '</p>' AND depth <= 0 THEN 'end_without_start' END AS error FROM b""")
def prompt_spans(spark, sf_dir):
    start, end = F.col("tag") == "<p>", F.col("tag") == "</p>"
    found = positions.spans(_tags(spark, sf_dir), ["page_id"], "pos", start, end, F.lit(False), F.lit(False))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "depth", "error")


@query("""SELECT l_orderkey, l_linenumber, 100 + l_linenumber - 1 AS context_length, 100 + l_linenumber - 2 AS predictor_position, l_linenumber - 1 AS n_generated, count(*) AS n FROM lineitem GROUP BY ALL""")
def predictor_alignment(spark, sf_dir):
    step, n = F.col("l_linenumber"), F.lit(100)
    rows = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", positions.context_length(n, step).alias("context_length"), positions.predictor_position(n, step).alias("predictor_position"), F.size(positions.generated_positions(n, step)).alias("n_generated")
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT item_id, text || chr(10) || 'A. ' || text || chr(10) || 'B. ' || CAST(item_id AS VARCHAR) AS asked, text || chr(10) || chr(10) || 'Think step by step inside <think> </think> tags, then give your final answer inside \\boxed{}.' AS prompt FROM benchmark".replace("\\\\", "\\"))
def rendered_prompts(spark, sf_dir):
    rows = read_table(spark, sf_dir, "benchmark")
    options = F.array(F.col("text"), F.col("item_id").cast("string"))
    return rows.select("item_id", T.with_choices(F.col("text"), options).alias("asked"), T.render_question(F.col("text")).alias("prompt"))


@query("""SELECT item_id, [text, '#1', ' and ', '<image 1>', '#2'] AS parts FROM benchmark""")
def image_placeholders(spark, sf_dir):
    text = F.concat("text", F.lit("<image 1> and <image 1>"))
    parts = T.image_parts(text, F.array(F.lit(1), F.lit(2)))
    return read_table(spark, sf_dir, "benchmark").select(
        "item_id", F.transform(parts, lambda p: F.coalesce(p["text"], F.concat(F.lit("#"), p["number"].cast("string")))).alias("parts"),
    )


@query("SELECT doc_id, lang FROM documents WHERE lower(trim(lang)) = 'fr' AND source = 'src4'")
def source_filter(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.where(datasets.equals(docs, {"lang": " FR "}, loose=True) & datasets.equals(docs, {"source": "src4"})).select("doc_id", "lang")


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal, o_orderkey FROM orders")
def source_ordinal(spark, sf_dir):
    return scheduling.with_ordinal(
        read_table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"],
    ).select("ordinal", "o_orderkey")


@query("SELECT CAST(item_id AS VARCHAR) AS sample_id, text FROM benchmark WHERE item_id IN (7, 3, 11)")
def selected_examples(spark, sf_dir):
    rows = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("sample_id"), "text")
    return matrix.selected(rows, ["7", "3", "11"])


# ---- texts and scores ----------------------------------------------------------------------------

#: Synthetic answers: the tables have none, so these are made of their columns.
_BOX = r"\boxed{"


@query(r"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN chr(65 + CAST(conv_id % 5 AS INTEGER)) WHEN 1 THEN '\frac{' || turn || '}{7}' WHEN 2 THEN NULL ELSE NULL END AS boxed FROM conversations""")
def boxed_extract(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", T.boxed(_generated()).alias("boxed"))


def _generated() -> Column:
    """Behind the whole text, by turn: a boxed letter behind another box, a boxed fraction, an unclosed box, a plain sentence."""
    letter = F.char(65 + (F.col("conv_id") % 5).cast("int"))
    head = F.concat("text", F.lit("\n"))
    kind = F.col("turn") % 4
    return F.concat(
        head,
        F.when(kind == 0, F.concat(F.lit(_BOX + "x} so " + _BOX + " "), letter, F.lit(" }")))
        .when(kind == 1, F.concat(F.lit(_BOX + "\\frac{"), F.col("turn").cast("string"), F.lit("}{7}}")))
        .when(kind == 2, F.lit(_BOX + "42"))
        .otherwise(F.concat(F.lit("The answer is "), letter, F.lit(")"))),
    )


_MCQ_SQL = """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN chr(65 + CAST(conv_id % 5 AS INTEGER)) WHEN 3 THEN chr(65 + CAST(conv_id % 5 AS INTEGER)) END AS extracted_answer,
CASE WHEN turn % 4 IN (0, 3) THEN conv_id % 5 = conv_id % 3 END AS is_correct, CASE turn % 4 WHEN 0 THEN 'boxed_letter' WHEN 1 THEN 'boxed_unmapped' WHEN 2 THEN 'none' ELSE 'explicit_answer_letter' END AS scorer_method FROM conversations"""


def _scored(spark: SparkSession, sf_dir: str, kind: str, gold: Column) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    question = F.lit("Which?\n(A) red\n[B] green\nC) blue\nD: black\nE. white")
    made = rows.select(
        "conv_id", "turn", "role", _generated().alias("generated_text"), question.alias("question"), gold.alias("ground_truth"),
        F.lit(kind).alias("answer_type"),
    )
    return scoring.score(made)


@query(_MCQ_SQL)
def mcq_letter(spark, sf_dir):
    scored = _scored(spark, sf_dir, "multiple_choice", F.char(65 + (F.col("conv_id") % 3).cast("int")))
    return scored.select("conv_id", "turn", "extracted_answer", "is_correct", "scorer_method")


@query(r"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN chr(65 + CAST(conv_id % 5 AS INTEGER)) WHEN 1 THEN '\frac{' || turn || '}{7}' END AS extracted_answer,
CASE turn % 4 WHEN 0 THEN FALSE WHEN 1 THEN turn * 14 = 7 * 2 * (turn + conv_id % 2) END AS is_correct, CASE WHEN turn % 4 < 2 THEN 'boxed_freeform' ELSE 'none' END AS scorer_method FROM conversations""")
def freeform_numeric(spark, sf_dir):
    gold = F.concat(((F.col("turn") + F.col("conv_id") % 2) * 2).cast("string"), F.lit("/14"))
    return _scored(spark, sf_dir, "freeform", gold).select("conv_id", "turn", "extracted_answer", "is_correct", "scorer_method")


@query(f"SELECT role, count(*) AS n, count(*) FILTER (is_correct) AS n_correct, count(*) - count(is_correct) AS n_abstained, round(count(*) FILTER (is_correct) / nullif(count(is_correct), 0), 9) AS accuracy FROM (SELECT m.*, c.role FROM ({_MCQ_SQL}) m JOIN conversations c ON c.conv_id = m.conv_id AND c.turn = m.turn) GROUP BY role")
def score_accuracy(spark, sf_dir):
    scored = _scored(spark, sf_dir, "multiple_choice", F.char(65 + (F.col("conv_id") % 3).cast("int")))
    return scoring.summary(scored, ["role"]).withColumn("accuracy", F.round("accuracy", 9))


@query("""SELECT p_partkey, round(p_retailprice, 1) = round(p_retailprice * 100) / 100 AS same FROM part""")
def numeric_rounding(spark, sf_dir):
    price = F.format_string("%.2f", F.col("p_retailprice"))
    gold = F.format_string("%.1f", F.round(F.col("p_retailprice"), 1))
    exact = scoring.numeric_equal(F.concat(F.lit("$"), gold, F.lit(" cm")), price)
    return read_table(spark, sf_dir, "part").select("p_partkey", exact.alias("same"))


@query(r"""SELECT p_partkey, lower(regexp_replace(p_type, '[ .]', '', 'g')) AS choice, 'a ' || p_brand AS latex, CAST(p_size AS VARCHAR) AS answer FROM part""")
def normalized_text(spark, sf_dir):
    rows = read_table(spark, sf_dir, "part")
    return rows.select(
        "p_partkey", T.normalize_choice(F.concat(F.lit("( "), F.col("p_type"), F.lit(". )"))).alias("choice"), T.strip_latex(F.concat(
            F.lit("$\\text{a }\\mathrm{"), F.col("p_brand"), F.lit("}$ "),
        )).alias("latex"),
        T.normalize_answer(F.concat(F.col("p_size").cast("string"), F.lit(".00%"))).alias("answer"),
    )


@query("SELECT conv_id, turn, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[-1]) AS last_line FROM conversations")
def last_lines(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", T.last_line(F.col("text")).alias("last_line"))


@query("SELECT item_id, ['A', 'B', 'C'] AS letters, [trim(replace(text, chr(10), ' ')), 'two', 'three' || chr(10) || 'more'] AS texts FROM benchmark")
def parsed_choices(spark, sf_dir):
    question = F.concat(F.lit("Pick one.\n(A) "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n B. two \nC) three\nmore\n"))
    rows = read_table(spark, sf_dir, "benchmark").select("item_id", T.choices(question).alias("c"))
    return rows.select("item_id", F.transform("c", lambda c: c["key"]).alias("letters"), F.transform("c", lambda c: c["value"]).alias("texts"))


@query("""SELECT c.conv_id, c.turn, c.role FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.turn = c.turn AND s.conv_id % 3 = 0)""")
def pending_scores(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    done = rows.where("conv_id % 3 = 0").select("conv_id", "turn", F.lit("exact").alias("scorer_name"), F.lit("1").alias("scorer_version"))
    return scoring.pending(rows, done, ["conv_id", "turn"], "exact", "1")


@query("SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'missing_example' END AS error FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def scored_or_failed(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id"), read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    found, failed = scoring.with_examples(docs, labels, ["doc_id"], ["quality"])
    return found.select(
        "doc_id", "quality", F.lit(None).cast("string").alias("error"),
    ).unionByName(failed.select("doc_id", F.lit(None).cast("int").alias("quality"), "error"))


@query(_MCQ_SQL.replace("FROM conversations", "FROM conversations WHERE role = 'assistant'"))
def streamed_scores(spark, sf_dir):
    """The scores of a stream over the assistant's turns, kept in the shared folder."""
    import uuid

    from tessera.plans.lineage import ensure_checkpoint_dir
    from tessera.streaming.scores import score_stream

    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    rows = read_table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows.select("conv_id", "turn", _generated().alias("generated_text")).write.parquet(f"{base}/generations")
    examples = read_table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        "conv_id", F.lit("Which?\n(A) red\n[B] green\nC) blue\nD: black\nE. white").alias("question"), F.char(65 + (F.col("conv_id") % 3).cast("int")).alias("ground_truth"), F.lit("multiple_choice").alias("answer_type")
    )
    schema = spark.read.parquet(f"{base}/generations").schema
    score_stream(spark, f"{base}/generations", examples, f"{base}/scores", f"{base}/offsets", ["conv_id"], "letters", "1", schema=schema).awaitTermination()
    return spark.read.parquet(f"{base}/scores").select("conv_id", "turn", "extracted_answer", "is_correct", "scorer_method")



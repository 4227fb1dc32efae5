"""Queries of readers, records, stored runs and their rules over the driver's tables, and the same in SQL; they register with :mod:`tessera.queries`."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import identity
from tessera.functions import text as T
from tessera.operators import attention, constraints, hidden, positions, scheduling, scoring
from tessera.plans import commits, matrix, records, runs, scoring_run
from tessera.plans.lineage import ensure_checkpoint_dir, written
from tessera.queries import _ATTENTION_SQL, _NORMED, _attention_rows, query
from tessera.schema import SCENARIOS, TABLES
from tessera.session import read_table
from tessera.sources import adapters, datasets, stored

NOW = datetime(2026, 1, 2, 3, 4, 5)


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: What the prompt template ends a prompt with.
_TAIL = r"chr(10) || chr(10) || 'Think step by step inside <think> </think> tags, then give your final answer inside \boxed{}.'"


# ---- readers ---------------------------------------------------------------------------------------

_DIAGRAMS = "SELECT item_id, text, CASE WHEN item_id % 8 = 0 THEN chr(CAST(65 + item_id % 3 AS INTEGER)) ELSE CAST(item_id AS VARCHAR) END AS answer, text || chr(10) || '(A) one' || chr(10) || '(B) two' AS asked FROM benchmark"


@query(f"""WITH a AS ({_DIAGRAMS})
SELECT item_id AS source_row_index, CASE WHEN item_id % 3 <> 0 THEN CAST(item_id AS VARCHAR) ELSE 'sha256-' || sha256('{{"answer":' || CAST(to_json(answer) AS VARCHAR) || ',"image_sha256":"' || sha256(text) || '","question":' || CAST(to_json(text) AS VARCHAR) || '}}') END AS sample_id,
answer AS ground_truth, CASE WHEN item_id % 8 = 0 AND answer IN ('A', 'B') THEN 'multiple_choice' ELSE 'freeform' END AS answer_type, asked AS eval_question, sha256(text) AS image_sha256, octet_length(encode(text)) AS image_size,
'{{"problem_version":" Vision ","question_type":"","source":"","split":"","subfield":"","subject":""}}' AS metadata_json FROM a WHERE item_id % 2 = 0""")
def reader_diagrams(spark, sf_dir):
    path, rows = _scratch(spark, "diagrams"), read_table(spark, sf_dir, "benchmark")
    answer = F.when(F.col("item_id") % 8 == 0, F.char(65 + F.col("item_id") % 3)).otherwise(F.col("item_id").cast("string"))
    source = rows.select(
        "item_id", F.when(F.col("item_id") % 3 != 0, F.col("item_id").cast("string")).alias("sample_index"), F.lit(" ").alias("problem_index"), F.when(F.col("item_id") % 2 == 0, " Vision ").otherwise("Text").alias("problem_version"),
        F.col("text").alias("question"), answer.alias("answer"), F.concat("text", F.lit("\n(A) one\n(B) two")).alias("question_for_eval"), F.struct(
            F.col("text").cast("binary").alias("bytes"), F.lit(None).cast("string").alias("path"),
        ).alias("image"),
    )
    source.repartition(1).sortWithinPartitions("item_id").drop("item_id").write.parquet(path)
    found = adapters.adapter("mathverse").examples(spark, path, {"problem_version": "VISION"})
    image = F.get("images", F.lit(0))
    return found.select(
        "source_row_index", "sample_id", "ground_truth", "answer_type", "eval_question", image["sha256"].alias("image_sha256"),
        image["size"].alias("image_size"), "metadata_json",
    )


@query("""SELECT CAST(item_id AS VARCHAR) AS sample_id, CASE WHEN item_id % 2 = 0 THEN 'B' ELSE '7' END AS ground_truth, CASE WHEN item_id % 2 = 0 THEN 'multiple_choice' ELSE 'freeform' END AS answer_type,
text || CASE WHEN item_id % 2 = 0 THEN chr(10) || 'A. red' || chr(10) || 'B. Blue ' || item_id ELSE '' END || """ + _TAIL + " AS rendered_prompt FROM benchmark")
def reader_figures(spark, sf_dir):
    path, rows = _scratch(spark, "figures"), read_table(spark, sf_dir, "benchmark")
    even, number = F.col("item_id") % 2 == 0, F.col("item_id").cast("string")
    options = F.when(even, F.array(F.lit("red"), F.concat(F.lit("Blue "), number)))
    rows.select(
        number.alias("pid"), F.col("text").alias("question"), options.alias("choices"),
        F.when(even, F.concat(F.lit(" blue "), number)).otherwise("7").alias("answer"),
    ).write.parquet(path)
    return adapters.adapter("mathvista").examples(spark, path).select("sample_id", "ground_truth", "answer_type", "rendered_prompt")


@query("""SELECT 'q' || item_id AS sample_id, text || chr(10) || 'A. it''s ' || item_id || chr(10) || 'B. "two"' AS eval_question, 'A' AS ground_truth, item_id % 3 + 1 AS n_images FROM benchmark""")
def reader_exams(spark, sf_dir):
    path, rows = _scratch(spark, "exams"), read_table(spark, sf_dir, "benchmark")
    number = F.col("item_id").cast("string")
    picture = lambda k: F.when(F.col("item_id") % 3 >= k, F.struct(F.lit(b"x").alias("bytes"), F.lit(None).cast("string").alias("path"))).alias(f"image_{k + 1}")
    options = F.concat(F.lit("[\"it's "), number, F.lit("\", '\"two\"']"))
    rows.select(
        F.concat(F.lit("q"), number).alias("id"), F.col("text").alias("question"), options.alias("options"), F.lit("A").alias("answer"),
        *map(picture, range(3)),
    ).repartition(3).write.parquet(path)
    return adapters.adapter("mmmu_pro").examples(spark, path).select(
        "sample_id", "eval_question", "ground_truth", F.size("images").cast("long").alias("n_images"),
    )


@query(f"SELECT item_id, [text || ' see ', '#1', ' and ', '<image 1>', '#2', chr(10) || chr(10) || 'A. yes' || chr(10) || 'B. no' || {_TAIL}] AS parts FROM benchmark")
def reader_messages(spark, sf_dir):
    rows = read_table(spark, sf_dir, "benchmark").select(
        "item_id", F.concat("text", F.lit(" see <image 1> and <image 1>")).alias("question"), F.transform(
            F.array(F.lit(1), F.lit(2)), lambda n: F.struct(n.alias("number")),
        ).alias("images"), F.lit('{"options":["yes","no"]}').alias("metadata_json")
    )
    parts = F.get("messages", F.lit(0))["content"]
    said = F.transform(parts, lambda p: F.coalesce(p["text"], F.concat(F.lit("#"), p["number"].cast("string"))))
    return adapters.adapter("mmmu_pro").messages(rows).select("item_id", said.alias("parts"))


@query("SELECT sha256(string_agg(replace(text, chr(10), ' ') || chr(10), '' ORDER BY item_id)) AS sha256 FROM benchmark")
def source_hashes(spark, sf_dir):
    path = _scratch(spark, "hashed")
    read_table(spark, sf_dir, "benchmark").repartition(1).sortWithinPartitions("item_id").select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("value")).write.text(path)
    return datasets.source_hashes(spark, path, "part-*").select("sha256")


@query("""SELECT doc_id, nullif(regexp_extract(replace(replace(lower(text), '$', ''), ',', ''), '[-+]?\\d*\\.?\\d+'), '') AS number FROM documents""".replace("\\\\", "\\"))
def first_numbers(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", T.first_number(F.col("text")).alias("number"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'B' END AS letter FROM conversations")
def lenient_boxes(spark, sf_dir):
    said = F.concat("text", F.lit(" <boxed>a, then "), F.when(F.col("turn") % 2 == 0, F.lit("boxed { (b")).otherwise(F.lit("unboxed")))
    return read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("turn") % 2 == 0, T.lenient_boxed_letter(said)).otherwise(T.lenient_boxed_letter(F.col("text"))).alias("letter"),
    )


@query("SELECT p_partkey, ['it''s ' || p_brand, p_type || '\"', 'c'] AS options FROM part")
def literal_lists(spark, sf_dir):
    written = F.concat(F.lit("[\"it's "), F.col("p_brand"), F.lit("\", '"), F.col("p_type"), F.lit("\"', 'c']"))
    return read_table(spark, sf_dir, "part").select("p_partkey", datasets.literal_list(written).alias("options"))


@query("SELECT conv_id, turn, 'Then ' || role AS sentence FROM conversations")
def last_sentences(spark, sf_dir):
    said = F.concat("text", F.lit("\nFirst 3.5, then less. Then "), F.col("role"))
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", T.last_sentence(said).alias("sentence"))


# ---- records and identities ------------------------------------------------------------------------


@query("""SELECT 'r' AS run_id, CAST(item_id AS VARCHAR) AS sample_id, len(string_split(text, ' ')) AS prompt_token_count, '{"answer":"' || item_id || '","question_for_eval":' || CAST(to_json(text) AS VARCHAR) || '}' AS ground_truth_json FROM benchmark""")
def example_records(spark, sf_dir):
    """Rows of the examples table, written to a store and read back."""
    rows = read_table(spark, sf_dir, "benchmark")
    text, number = F.col("text"), F.col("item_id").cast("string")
    none = F.array().cast("array<struct<number:int,path:string,sha256:string,size:long,width:int,height:int>>")
    made = rows.select(
        F.col("item_id").alias("source_row_index"), number.alias("sample_id"), text.alias("question"), text.alias("eval_question"), text.alias("rendered_prompt"), number.alias("ground_truth"), F.lit("freeform").alias("answer_type"), none.alias("images"), F.lit("{}").alias("metadata_json"),
    )
    store = commits.Store(spark, _scratch(spark, "examples"))
    commits.write_examples(store, records.example_rows(made, "r", "d", "t", F.transform(F.split("question", " "), F.length)))
    return commits.read_examples(store).select(
        "run_id", "sample_id", F.col("prompt_token_count").cast("long").alias("prompt_token_count"), "ground_truth_json",
    )


@query("""SELECT item_id, sha256('{"prompt_token_ids":[' || item_id || ',7],"rendered_prompt":' || CAST(to_json(text) AS VARCHAR) || '}') AS hash FROM benchmark""")
def prompt_hashes(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select(
        "item_id", records.prompt_hash(F.col("text"), F.array(F.col("item_id"), F.lit(7).cast("long"))).alias("hash"),
    )


@query("SELECT o_orderkey, 'exp-' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '-' || sha256(o_orderpriority)[1:8] AS group_id FROM orders")
def group_ids(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", identity.group_id(F.col("o_orderdate"), F.sha2("o_orderpriority", 256)).alias("group_id"))


@query("""SELECT conv_id, 'c' || conv_id || '-' || sha256('{"code_hash":"c","config_hash":"d","core_shard_id":"c' || conv_id || '","name":"n","rollouts":[' || string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) || '],"version":"1"}')[1:16] AS score_shard_id,
'{"answer_type":"freeform","extra":{"k":1},"ground_truth":{"answer":"' || conv_id || '"},"scorer_code_hash":"c","scorer_config_hash":"d"}' AS score_details_json FROM conversations GROUP BY conv_id""")
def score_details(spark, sf_dir):
    shard = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    rows = read_table(spark, sf_dir, "conversations").select(
        "conv_id", *[F.lit(c).alias(c) for c in ("run_id", "dataset", "split", "strategy")], F.col("conv_id").cast("string").alias("sample_id"), F.col("turn").cast("int").alias("rollout_index"), shard.alias("shard_id"), F.lit(True).alias("is_correct"),
        *[F.lit("x").alias(c) for c in ("raw_final_answer", "extracted_answer", "scorer_method")], F.lit("freeform").alias("answer_type"), F.concat(
            F.lit('{"answer":"'), F.col("conv_id").cast("string"), F.lit('"}'),
        ).alias("ground_truth_json"), F.lit('{"k":1}').alias("extra"),
    )
    made = scoring_run.score_rows(rows, {"name": "n", "version": "1", "code_hash": "c", "config_hash": "d"}, NOW)
    return made.select(F.col("sample_id").cast("long").alias("conv_id"), "score_shard_id", "score_details_json").distinct()


# ---- metrics ---------------------------------------------------------------------------------------


@query("SELECT vec_id, 16 AS n_image_tokens, 24 AS n_prompt_text_tokens, label AS n_generated_text_tokens, 24 + label AS n_prompt_generated_text_tokens, 40 + label AS n_all_attn_tokens FROM embeddings")
def attn_counts(spark, sf_dir):
    return _attention_rows(spark, sf_dir).select("vec_id", *attention.counts(F.col("image"), F.col("prompt"), F.col("generated")))


@query("SELECT label, max(CASE WHEN layer = 5 THEN 1 ELSE 0 END) = 0 AND count(*) > 0 AS has_all, max(CASE WHEN layer = 5 THEN 1 ELSE 0 END) = 0 AND count(*) FILTER (layer <= 21) > 0 AS has_early, count(*) FILTER (layer BETWEEN 22 AND 34) > 0 AS has_reasoning FROM (SELECT label, vec_id % 36 + 1 AS layer FROM embeddings) GROUP BY label")
def attn_null_layers(spark, sf_dir):
    """A null vector in layer 5 makes the scenarios that hold this layer invalid, and no other."""
    rows = _attention_rows(spark, sf_dir).withColumn("layer", (F.col("vec_id") % 36 + 1).cast("int")).withColumn(
        "attention", F.when(F.col("layer") != 5, F.col("attention")),
    )
    means = attention.mean_over_layers(rows, ["label"])
    return means.select("label", *[F.col(s).isNotNull().alias(n) for s, n in zip(SCENARIOS, ("has_all", "has_early", "has_reasoning"))])


@query(f"""WITH a AS (SELECT vec_id, label, vec_id % 36 + 1 AS layer, {_NORMED} AS v FROM embeddings), b AS (SELECT label, layer, list_sum(v[1:16]) AS i, list_sum(v[17:40]) AS p FROM a)
SELECT label, 16 AS n_image_tokens, {', '.join(f"round(avg(i) FILTER (layer BETWEEN {lo} AND {hi}), 6) + 0.0 AS {s}__img_attn_total, round(avg(i) FILTER (layer BETWEEN {lo} AND {hi}) / (avg(i) FILTER (layer BETWEEN {lo} AND {hi}) + avg(p) FILTER (layer BETWEEN {lo} AND {hi})), 6) + 0.0 AS {s}__attn_ratio_img_to_prompt_text" for s, (lo, hi) in SCENARIOS.items())} FROM b GROUP BY label""")
def attn_scenarios(spark, sf_dir):
    """All scenarios of a key as a stored record, from its heads."""
    rows = _attention_rows(spark, sf_dir).withColumn("layer", (F.col("vec_id") % 36 + 1).cast("int"))
    none = F.array().cast("array<int>")
    groups = rows.select("label", "image", "prompt").distinct().withColumn("generated", none)
    made = attention.scenarios(rows, ["label"], groups)
    shown = [f"{s}__{m}" for s in SCENARIOS for m in ("img_attn_total", "attn_ratio_img_to_prompt_text")]
    return made.select("label", "n_image_tokens", *[(F.round(c, 6) + 0.0).alias(c) for c in shown])


@query("SELECT vec_id, (vec_id % 70 < 64) AND (label + vec_id % 3 <> label + 1) AND label + vec_id % 3 <> vec_id % 70 AND label + 1 <> vec_id % 70 AS valid FROM embeddings")
def attn_group_validity(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings")
    i, p, g = F.col("label") + (F.col("vec_id") % 3).cast("int"), F.col("label") + 1, (F.col("vec_id") % 70).cast("int")
    return rows.select("vec_id", attention.groups_are_valid(F.size("embedding"), F.array(i), F.array(p), F.array(g)).alias("valid"))


@query("SELECT vec_id, CASE WHEN x BETWEEN 0 AND 1 THEN round(x, 7) + 0.0 END AS value FROM (SELECT vec_id, 6.0 * CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)")
def admitted_cosines(spark, sf_dir):
    x = F.col("embedding")[0].cast("double") * 6.0
    return read_table(spark, sf_dir, "embeddings").select("vec_id", (F.round(hidden.admitted(x), 7) + 0.0).alias("value"))


_SPANS = """WITH a AS (SELECT page_id, unnest(t) AS tag, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '</?[a-z0-9]+') AS t FROM pages)),
b AS (SELECT *, CAST(coalesce(sum(CASE WHEN tag = '<p' THEN 1 WHEN tag = '</p' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS depth FROM a),
c AS (SELECT *, CASE WHEN tag = '<br' AND depth = 1 THEN 'image' WHEN tag IN ('<p', '</p', '<br', '<li') THEN 'markup' ELSE 'text' END AS kind,
  CASE WHEN tag = '<p' AND depth >= 1 THEN 'nested_start' WHEN tag = '</p' AND depth <= 0 THEN 'end_without_start' WHEN tag = '<br' AND depth <> 1 THEN 'pad_outside' END AS error FROM b)"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = read_table(spark, sf_dir, "pages").select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(</?[a-z0-9]+)"), F.lit(1))).alias("pos", "tag"),
    )
    is_ = lambda t: F.col("tag") == t
    return positions.spans(tags, ["page_id"], "pos", is_("<p"), is_("</p"), is_("<br"), is_("<li"))


@query(f"{_SPANS} SELECT page_id, kind, error, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places, max(depth) AS depth FROM c GROUP BY page_id, kind, error")
def prompt_kinds(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("page_id", "kind", "error").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").cast("long").alias("places"), F.max("depth").alias("depth"),
    )


@query(f"{_SPANS} SELECT page_id, count(*) FILTER (kind = 'image') AS n_image, CAST(sum(pos) FILTER (kind = 'text') AS BIGINT) AS text_places, count(error) AS n_errors, count(*) FILTER (tag = '<p') > count(*) FILTER (tag = '</p') AS unterminated FROM c GROUP BY page_id")
def prompt_groups(spark, sf_dir):
    made = positions.groups(_classified(spark, sf_dir), ["page_id"], "pos", F.col("tag") == "<p", F.col("tag") == "</p")
    return made.select(
        "page_id", F.size("image").cast("long").alias("n_image"),
        F.nullif(F.aggregate("prompt", F.lit(0).cast("long"), lambda s, x: s + x), F.lit(-1)).alias("text_places"), "n_errors", "unterminated",
    )


# ---- scores ----------------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'D' ELSE 'E' END AS extracted_answer, CASE turn % 4 WHEN 0 THEN 'boxed_option_text' WHEN 1 THEN 'boxed_letter_lenient' WHEN 2 THEN 'final_line_letter' ELSE 'explicit_answer_letter' END AS scorer_method,
CASE turn % 4 WHEN 0 THEN conv_id % 2 = 0 WHEN 1 THEN FALSE WHEN 2 THEN FALSE ELSE conv_id % 2 = 1 END AS is_correct FROM conversations""")
def mcq_other_rules(spark, sf_dir):
    """Option texts, loose boxes, a last line that is a letter, an option that is named; behind the whole text of each turn."""
    kind = F.col("turn") % 4
    said = F.when(kind == 0, F.lit("\\boxed{ Deep  green. }")).when(kind == 1, F.lit("<boxed>c")).when(kind == 2, F.lit("(D)")).otherwise(F.lit("I take option e here"))
    question = F.lit("Which?\n(A) red\n[B] deep green\nC) blue\nD: black\nE. white")
    rows = read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat("text", F.lit("\n"), said).alias("generated_text"), question.alias("question"), F.when(F.col("conv_id") % 2 == 0, "b").otherwise("(E)").alias("ground_truth"), F.lit("multiple_choice").alias("answer_type")
    )
    return scoring.score(rows).select("conv_id", "turn", "extracted_answer", "scorer_method", "is_correct")


@query("""SELECT conv_id, turn, CAST(1000 + turn AS VARCHAR) || CASE WHEN turn % 2 = 0 THEN '/2' ELSE '.50' END AS extracted_answer, 'explicit_answer_freeform' AS scorer_method, CASE WHEN turn % 2 = 0 THEN conv_id % 2 = 0 ELSE conv_id % 2 = 0 END AS is_correct FROM conversations""")
def freeform_stated(spark, sf_dir):
    """A number that the last sentence states, with thousands' commas, against the same number as a decimal or a fraction."""
    turn, even = F.col("turn"), F.col("turn") % 2 == 0
    said = F.concat(F.lit("The value of it is 1,00"), turn.cast("string"), F.when(even, " / 2").otherwise(".50"))
    right = F.when(even, ((1000 + turn) / 2).cast("decimal(10,1)").cast("string")).otherwise(F.concat((1000 + turn).cast("string"), F.lit(".5")))
    gold = F.when(F.col("conv_id") % 2 == 0, right).otherwise(F.concat(right, F.lit("1")))
    rows = read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat("text", F.lit("\n"), said).alias("generated_text"), F.lit("q").alias("question"), gold.alias("ground_truth"),
        F.lit("freeform").alias("answer_type"),
    )
    return scoring.score(rows).select("conv_id", "turn", "extracted_answer", "scorer_method", "is_correct")


@query("""SELECT p_partkey, p_partkey % 3 <> 1 AS fraction, p_partkey % 2 = 0 AS decimals, TRUE AS spaced FROM part""")
def numeric_exact(spark, sf_dir):
    """Fractions of many digits, decimals that differ in the 20th place, and spacing commands."""
    k = F.col("p_partkey")
    whole = F.concat(F.lit("98765432101234567"), k.cast("string"))
    double = (whole.cast("decimal(38,0)") * 2 + F.when(k % 3 == 1, 1).otherwise(0)).cast("string")
    long, other = F.concat(F.lit("0.000000000000000000"), k.cast("string")), F.concat(
        F.lit("0.000000000000000000"), (k + F.when(k % 2 == 0, 0).otherwise(1)).cast("string"),
    )
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", scoring.numeric_equal(F.concat(double, F.lit("/2")), whole).alias("fraction"), scoring.numeric_equal(long, other).alias("decimals"),
        (T.strip_latex(F.concat(k.cast("string"), F.lit("\\;cm;"))) == F.concat(k.cast("string"), F.lit(" cm;"))).alias("spaced"),
    )


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN length(text) % 2 = 0 END AS is_correct, CASE turn % 3 WHEN 0 THEN 'abstain' WHEN 1 THEN 'parity' ELSE 'failed' END AS scorer_method,
CASE WHEN turn % 3 = 1 THEN '{"length":' || length(text) || '}' ELSE '{}' END AS extra, CASE WHEN turn % 3 = 2 THEN 'ValueError' END AS error FROM conversations""")
def python_scorer(spark, sf_dir):
    """A scorer of one's own: it abstains, gives further details, or raises for a row, which fails alone."""

    def parity(question, truth, kind, said):
        if int(question) % 3 == 2:
            raise ValueError("not this one")
        return None if int(question) % 3 == 0 else {"is_correct": len(said) % 2 == 0, "scorer_method": "parity", "length": len(said)}

    rows = read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("turn").cast("string").alias("question"), F.lit("").alias("ground_truth"), F.lit("freeform").alias("answer_type"),
        F.col("text").alias("generated_text"),
    )
    return scoring_run.Scorer("parity", "1", parity).results(rows).select(
        "conv_id", "turn", "is_correct", "scorer_method", "extra", F.substring_index("error", ":", 1).alias("error"),
    )


_RUN = {"run_id": "r", "dataset": "d", "split": "t", "strategy": "s"}


def _core(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Core tables of a run: a generation for each conversation, a token for each of its turns; with faults by the conversation's number."""
    turns = read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.length("text").alias("token_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("step"),
    )
    c = F.col("conv_id")
    key = [
        *[F.lit(v).alias(k) for k, v in _RUN.items() if k != "strategy"], c.cast("string").alias("sample_id"), F.lit("s").alias("strategy"),
        F.lit(0).alias("rollout_index"),
    ]
    shard = (c % 4).cast("string").alias("shard_id")
    ids = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "token_id"))), lambda x: x["token_id"]).alias("ids"))
    kept = F.when(c % 7 == 0, F.slice("ids", 1, F.size("ids") - 1)).otherwise(F.col("ids"))
    stopped = c % 3 == 0
    generations = ids.select(
        *key, shard, F.lit(1).cast("decimal(20,0)").alias("rollout_seed"), F.when(c % 19 == 0, 0.9).otherwise(0.5).cast("float").alias("temperature"), F.lit(0.5).cast("float").alias("top_p"), F.lit(None).cast("int").alias("top_k"), F.lit(1.0).cast("float").alias("repetition_penalty"),
        kept.alias("generated_token_ids"), F.lit("x").alias("generated_text"), F.size(kept).alias("num_retained_tokens"), F.when(stopped, "stop_token").otherwise("max_new_tokens").alias("stop_reason"), F.when(stopped, 2).alias("terminating_token_id"),
        (~stopped | (c % 11 == 0)).alias("hit_max_new_tokens"), F.when(c % 23 == 0, 0).otherwise(5).alias("prompt_token_count"), F.lit(None).cast("double").alias("wall_time_seconds"), F.lit(None).cast("double").alias("tokens_per_second"), F.lit(NOW).alias("completed_at_utc"), "conv_id",
    )
    twice = generations.where("conv_id % 29 = 0").withColumn("shard_id", F.lit("other"))
    generations = generations.unionByName(twice).drop("conv_id")
    step = F.col("step")
    prompt = F.when(c % 23 == 0, 0).otherwise(5)
    tokens = turns.select(
        *key, "step", shard, "token_id", F.lit("p").alias("token_piece"), F.lit("t").alias("token_text"),
        (prompt + step - 2).alias("predictor_position"), (prompt + step - 1 + F.when(c % 13 == 0, 1).otherwise(0)).alias("context_length"),
    )
    valid = c % 5 != 0
    probability = turns.select(*key, "step", shard, valid.alias("metrics_valid"), F.when(~valid & (c % 10 == 0), "broken").alias("invalid_reason"))
    generated = step - 1 + F.when(c % 17 == 0, 1).otherwise(0)
    heads = turns.select(
        *key, "step", shard, F.lit(3).alias("n_image_tokens"), F.lit(2).alias("n_prompt_text_tokens"), generated.alias("n_generated_text_tokens"),
        (generated + 2).alias("n_prompt_generated_text_tokens"), (generated + 5).alias("n_all_attn_tokens"),
    )
    hidden_ = turns.where("conv_id % 31 <> 0 or step <> 1").select(*key, "step", shard)
    return {
        "generations": generations, "tokens": tokens, "token_probability_metrics": probability, "token_attention_metrics": heads,
        "token_hidden_state_metrics": hidden_,
    }


@query("""WITH t AS (SELECT conv_id, turn, length(text) AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations), c AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)
SELECT 'token_ids_match' AS rule, count(*) FILTER (conv_id % 7 = 0 AND step = m) AS n_violations FROM (SELECT *, max(step) OVER (PARTITION BY conv_id) AS m FROM t)
UNION ALL SELECT 'stop_reason', count(*) FILTER (conv_id % 33 = 0) + count(*) FILTER (conv_id % 33 = 0 AND conv_id % 29 = 0) FROM c
UNION ALL SELECT 'context_alignment', sum(CASE WHEN conv_id % 13 = 0 THEN n * CASE WHEN conv_id % 29 = 0 THEN 2 ELSE 1 END ELSE 0 END) FROM c
UNION ALL SELECT 'attention_counts', sum(CASE WHEN conv_id % 17 = 0 THEN n ELSE 0 END) FROM c
UNION ALL SELECT 'validity_reason', sum(CASE WHEN conv_id % 5 = 0 AND conv_id % 10 <> 0 THEN n ELSE 0 END) FROM c
UNION ALL SELECT 'generation_ranges', sum(CASE WHEN conv_id % 23 = 0 THEN CASE WHEN conv_id % 29 = 0 THEN 2 ELSE 1 END ELSE 0 END) FROM c
UNION ALL SELECT 'one_shard_per_rollout', count(*) FILTER (conv_id % 29 = 0) FROM c
UNION ALL SELECT 'unique_generations', count(*) FILTER (conv_id % 29 = 0) FROM c
UNION ALL SELECT 'aligned_token_hidden_state_metrics', count(*) FILTER (conv_id % 31 = 0) FROM c""".replace("sum(CASE", "CAST(sum(CASE").replace("ELSE 0 END) FROM", "ELSE 0 END) AS BIGINT) FROM"))
def storage_report(spark, sf_dir):
    """Rules of stored tables over a run with faults: ids, stops, positions, counts, validity, ranges, shards, keys."""
    tables = _core(spark, sf_dir)
    # the list of ids against rows is a rule of rollouts that are stored once
    once = tables | {"generations": tables["generations"].where("shard_id <> 'other'")}
    named = {r.name: r for r in constraints.storage_rules()}
    every = (
        "stop_reason", "context_alignment", "attention_counts", "validity_reason", "generation_ranges", "one_shard_per_rollout", "unique_generations",
        "aligned_token_hidden_state_metrics",
    )
    return constraints.check(once, [named["token_ids_match"]]).unionByName(constraints.check(tables, [named[n] for n in every]))


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT 'run_of_tokens' AS rule, 0 AS n_violations UNION ALL SELECT 'shard_of_tokens', CAST(sum(CASE WHEN conv_id % 4 <> 1 THEN n ELSE 0 END) AS BIGINT) FROM c
UNION ALL SELECT 'run_of_generations', 0 UNION ALL SELECT 'shard_of_generations', count(*) FILTER (conv_id % 4 <> 1) + count(*) FILTER (conv_id % 29 = 0) FROM c
UNION ALL SELECT 'sampling_of_run', count(*) FILTER (conv_id % 19 = 0) + count(*) FILTER (conv_id % 19 = 0 AND conv_id % 29 = 0) FROM c UNION ALL SELECT 'rollouts_of_run', 0""")
def run_report(spark, sf_dir):
    """A shard's rows against its run: identity, shard, sampling fields, number of rollouts."""
    tables = _core(spark, sf_dir)
    rules = commits.run_rules(_RUN | {"temperature": 0.5, "top_p": 0.5, "top_k": None, "repetition_penalty": 1.0, "rollouts": 1}, "1")
    return constraints.check(tables, [r for r in rules if r.name.endswith(("_generations", "_tokens", "_run"))])


# ---- stores ----------------------------------------------------------------------------------------


def _scored_store(spark: SparkSession, sf_dir: str) -> commits.Store:
    """A run of which every turn of an assistant is a rollout: its truth is whether the turn's number is even, and every seventh conversation has no example."""
    store = commits.Store(spark, _scratch(spark, "run"))
    turns = read_table(spark, sf_dir, "conversations")
    said = turns.where("role = 'assistant'")
    number = F.col("conv_id").cast("string")
    none = F.array().cast("array<struct<number:int,path:string,sha256:string,size:long,width:int,height:int>>")
    made = turns.where("conv_id % 7 <> 0").select(
        F.col("conv_id").alias("source_row_index"), number.alias("sample_id"), F.lit("q").alias("question"), F.lit("q").alias("eval_question"), F.lit("q").alias("rendered_prompt"), F.lit("1").alias("ground_truth"), F.lit("freeform").alias("answer_type"), none.alias("images"), F.lit("{}").alias("metadata_json"),
    ).distinct()
    commits.write_examples(store, records.example_rows(made, "r", "d", "t", F.array(F.lit(1))))
    answers = F.concat("text", F.lit("\n\\boxed{"), (F.col("turn") % 4).cast("string"), F.lit("}"))
    generations = said.select(
        *[F.lit(_RUN[k]).alias(k) for k in ("run_id", "dataset", "split")], number.alias("sample_id"), F.lit("s").alias("strategy"), F.col("turn").cast("int").alias("rollout_index"), F.lit("all").alias("shard_id"), F.lit(1).alias("rollout_seed"), F.lit(0.5).alias("temperature"),
        F.lit(0.5).alias("top_p"), F.lit(None).alias("top_k"), F.lit(1.0).alias("repetition_penalty"), F.array().cast("array<int>").alias("generated_token_ids"), answers.alias("generated_text"), F.lit("max_new_tokens").alias("stop_reason"), F.lit(None).alias("terminating_token_id"),
        F.lit(1).alias("prompt_token_count"), F.lit(None).alias("wall_time_seconds"), F.lit(None).alias("tokens_per_second"), F.lit(NOW).alias("completed_at_utc"),
    )
    tables = {t: spark.createDataFrame([], TABLES[t]) for t in TABLES if t.startswith("token")}
    commits.commit_shard(store, "all", tables | {"generations": records.generation_rows(generations)}, run=_RUN)
    return store


@query("""SELECT CAST(conv_id AS VARCHAR) AS sample_id, turn AS rollout_index, CAST(turn % 4 AS VARCHAR) AS extracted_answer, turn % 4 = 1 AS is_correct, 'boxed_freeform' AS scorer_method, '1' AS truth, 'scored' AS outcome FROM conversations WHERE role = 'assistant' AND conv_id % 7 <> 0
UNION ALL SELECT CAST(conv_id AS VARCHAR), turn, NULL, NULL, NULL, NULL, 'missing_example' FROM conversations WHERE role = 'assistant' AND conv_id % 7 = 0""")
def scored_run(spark, sf_dir):
    """Offline scoring of a committed run: its scores and its failures. A second call adds no scores."""
    store = _scored_store(spark, sf_dir)
    scorer = adapters.adapter("mathverse").scorer()
    scoring_run.score_run(store, "r", scorer, scored_at=NOW)
    failed = commits.failures(store).select("sample_id", F.col("rollout_index").cast("long").alias("rollout_index"), F.col("message").alias("outcome"))
    failed.write.parquet(kept := _scratch(spark, "failed"))
    scoring_run.score_run(store, "r", scorer, scored_at=NOW)
    truth = F.get_json_object("score_details_json", "$.ground_truth.answer").alias("truth")
    scores = commits.read_committed(store, "scores").select(
        "sample_id", F.col("rollout_index").cast("long").alias("rollout_index"), "extracted_answer", "is_correct", "scorer_method", truth,
        F.lit("scored").alias("outcome"),
    )
    return scores.unionByName(spark.read.parquet(kept), allowMissingColumns=True)


@query("""SELECT 'examples' AS "table", count(DISTINCT conv_id) AS "rows", 0 AS differences FROM conversations WHERE conv_id % 7 <> 0 UNION ALL SELECT 'generations', count(*), 0 FROM conversations WHERE role = 'assistant' UNION ALL SELECT 'scores', count(*), 0 FROM conversations WHERE role = 'assistant' AND conv_id % 7 <> 0""")
def stored_inventory(spark, sf_dir):
    """What is there of committed parts, and how many of their commits' figures differ from it."""
    store = _scored_store(spark, sf_dir)
    scoring_run.score_run(store, "r", adapters.adapter("mathverse").scorer(), scored_at=NOW)
    found = commits.inventory(store, "examples").unionByName(commits.inventory(store)).unionByName(commits.inventory(store, "scores"))
    differences = sum(commits.verify(store, kind).count() for kind in commits.KINDS)
    return found.select("table", "rows", F.lit(differences).alias("differences"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS sample_id, CAST(turn AS INTEGER) AS rollout_index, length(text) + 10 AS n_chars FROM conversations WHERE role = 'assistant' AND turn >= 2 AND conv_id % 2 = 1""")
def stored_source(spark, sf_dir):
    """A stored table through the data source: partitions by the log, filters on shard and rollout, three of its columns."""
    store = _scored_store(spark, sf_dir)
    stored.register(spark)
    rows = spark.read.format("tessera").options(table="generations", columns="shard_id,sample_id,rollout_index,generated_text").load(store.root)
    picked = rows.where("shard_id = 'all' and rollout_index >= 2").where(F.col("sample_id").cast("long") % 2 == 1)
    return picked.select("sample_id", "rollout_index", F.length("generated_text").cast("long").alias("n_chars"))


@query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT 'before' AS "when", 's0' AS shard, count(*) AS declared, count(*) + count(*) FILTER (conv_id % 2 = 0) AS actual, CAST(NULL AS BIGINT) AS quarantined FROM c WHERE conv_id % 3 = 0
UNION ALL SELECT "when", 's1', n, NULL, NULL FROM (SELECT count(*) AS n FROM c WHERE conv_id % 3 = 1), (SELECT unnest(['before', 'after']) AS "when")
UNION ALL SELECT 'between', NULL, NULL, NULL, 3""")
def damaged_store(spark, sf_dir):
    """A store of three shards, damaged: rows added to one part, another's files gone, a part without a commit, a torn commit. What differs before and after orphans are moved away."""
    store = commits.Store(spark, _scratch(spark, "damaged"))
    number = F.col("conv_id").cast("string")
    none = F.array().cast("array<struct<number:int,path:string,sha256:string,size:long,width:int,height:int>>")
    made = read_table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        F.col("conv_id").alias("source_row_index"), number.alias("sample_id"), *[F.lit(v).alias(n) for n, v in (
            ("question", "q"), ("eval_question", "q"), ("rendered_prompt", "q"), ("ground_truth", "1"), ("answer_type", "freeform"),
        )], none.alias("images"), F.lit("{}").alias("metadata_json"),
    )
    rows = commits.conform(records.example_rows(made, "r", "d", "t", F.array(F.lit(1))), "examples")
    of = lambda k: rows.where(F.col("sample_id").cast("long") % 3 == k)
    settings = commits.WriterSettings(level=9, row_group_bytes=1 << 20, dictionary=False)
    done = [commits.commit_shard(store, f"s{k}", {"examples": of(k)}, kind="examples", settings=settings)["parts"]["examples"] for k in range(3)]
    of(0).where(F.col("sample_id").cast("long") % 2 == 0).write.mode("append").parquet(f"{store.root}/{done[0]['path']}")
    for f in done[1]["files"]:
        name = f"{done[1]['path']}/{f['name']}"
        store.move(name, f"elsewhere/{name}")
    of(2).write.parquet(f"{store.root}/data/examples/_part=lost-0")
    store.create("_commits/examples/torn.json", '{"shard": "torn", "parts"')
    counted = lambda when: commits.verify(store, "examples").where("what = 'rows'").select(
        F.lit(when).alias("when"), "shard", F.col("declared").cast("long").alias("declared"), F.col("actual").cast("long").alias("actual"), F.lit(None).cast("long").alias("quarantined"),
    )
    before = written(counted("before"))
    moved = spark.range(1).select(
        F.lit("between").alias("when"), F.lit(None).cast("string").alias("shard"), F.lit(None).cast("long").alias("declared"), F.lit(None).cast("long").alias("actual"), F.lit(len({n.split("/")[2] for n in commits.quarantine(store)})).cast("long").alias("quarantined"),
    )
    return before.unionByName(moved).unionByName(counted("after"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 10 = 0 GROUP BY event_type")
def recorded_failures(spark, sf_dir):
    store = commits.Store(spark, _scratch(spark, "failures"))
    commits.append_failures(
        store,
        read_table(spark, sf_dir, "events").where("event_id % 10 = 0").select(F.lit("scoring").alias("stage"), "event_type", F.col("props").alias("message")),
    )
    return commits.failures(store).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# ---- runs and plans --------------------------------------------------------------------------------

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'planned' END"


@query("SELECT CAST(o_orderkey AS VARCHAR) AS run_id FROM orders WHERE o_orderstatus <> 'F'")
def unfinished_runs(spark, sf_dir):
    return runs.unfinished_runs(read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.expr(_STATUS).alias("status"),
    )).select("run_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def selected_run(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    last = str(orders.agg(F.max("o_orderkey")).first()[0])
    return runs.selected_runs(orders.withColumn("run_id", F.col("o_orderkey").cast("string")), last).select("o_orderkey", "o_orderstatus")


@query("""(SELECT n_name AS dataset, r_name AS strategy, 'missing' AS side FROM nation, region WHERE NOT (n_nationkey % 5 <> r_regionkey)) UNION ALL (SELECT n_name, 'other', 'undeclared' FROM nation WHERE n_nationkey < 3)""")
def plan_difference(spark, sf_dir):
    nations, regions = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    cell = lambda strategy: [F.col("n_name").alias("dataset"), F.lit("test").alias("split"), F.lit("all").alias("filter_id"), strategy.alias("strategy")]
    every = nations.crossJoin(F.broadcast(regions))
    existing = every.where("n_nationkey % 5 <> r_regionkey").select(*cell(F.col("r_name"))).unionByName(nations.where("n_nationkey < 3").select(*cell(F.lit("other"))))
    return runs.plan_difference(every.select(*cell(F.col("r_name"))), existing).select("dataset", "strategy", "side")


@query("SELECT source_row_index, o_orderkey FROM (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS source_row_index, o_orderkey FROM orders) WHERE source_row_index < 25")
def first_examples(spark, sf_dir):
    rows = scheduling.with_ordinal(read_table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "source_row_index")
    return runs.first_examples(rows, 25).select("source_row_index", "o_orderkey")


@query("SELECT doc_id, k AS rollout_index, row_number() OVER (ORDER BY doc_id, k) - 1 AS place FROM documents, (SELECT unnest(range(0, 3)) AS k)")
def ordered_bundles(spark, sf_dir):
    rows = matrix.expected_rollouts(read_table(spark, sf_dir, "documents").select("doc_id"), 3)
    placed = scheduling.with_ordinal(runs.ordered_bundles(rows, "doc_id"), ["doc_id", "rollout_index"], "place")
    return placed.select("doc_id", F.col("rollout_index").cast("long").alias("rollout_index"), "place")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def gathered_prompts(spark, sf_dir):
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("prompt_row"))
    return runs.gathered(rows, read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("prompt_row"), "n_name")).select("c_custkey", "n_name")


@query("SELECT p_brand, list_sort(list(DISTINCT p_size)) AS candidates FROM part GROUP BY p_brand")
def candidate_sizes(spark, sf_dir):
    return runs.candidates(read_table(spark, sf_dir, "part"), ["p_brand"], "p_size")


@query("""SELECT a.o_orderkey, a.o_orderstatus || b.o_orderstatus IN ('OP', 'PF', 'PX', 'XP') AS allowed FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1""")
def status_transitions(spark, sf_dir):
    named = lambda c: F.when(F.col(c) == "O", "planned").when(F.col(c) == "P", "running").when(F.col(c) == "F", "complete").otherwise("failed")
    rows = read_table(spark, sf_dir, "orders")
    after = rows.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderstatus").alias("next"))
    return rows.join(after, "o_orderkey").select("o_orderkey", constraints.may_follow(named("o_orderstatus"), named("next")).alias("allowed"))


@query("""SELECT 'run_count' AS rule, count(*) = 25 AS passed FROM nation UNION ALL SELECT 'unique_runs', count(DISTINCT n_name) = count(*) FROM nation UNION ALL SELECT 'all_complete', bool_and(n_regionkey < 9) FROM nation
UNION ALL SELECT 'benchmark_shapes', count(*) FILTER (r_regionkey = 0) > 0 AND count(*) FILTER (r_regionkey = 1) > 0 FROM region UNION ALL SELECT 'benchmark_ids_agree', FALSE""")
def gate_report(spark, sf_dir):
    """Rules of the release gate over manifests and benchmarks."""
    from tessera.plans import gate

    rows = read_table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("run_id"), F.when(F.col("n_regionkey") < 9, "complete").otherwise("failed").alias("status"), F.lit(32).alias("rollouts"), F.col("n_name").alias("dataset"),
    )
    measured = read_table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("prompts"), F.lit(32).alias("rollouts"), F.lit(True).alias("complete"), F.col("r_name").alias("ids_hash"),
    )
    found = gate.run_report(rows, rows, 25, 32, ["dataset", "status"]).unionByName(gate.benchmark_report(measured, [(0, 32), (1, 32)]))
    return found.where(F.col("rule").isin("run_count", "unique_runs", "all_complete", "benchmark_shapes", "benchmark_ids_agree"))


_ENTRIES = "SELECT o_orderkey AS run_id, o_orderstatus AS status, o_orderpriority AS dataset, CASE WHEN o_custkey % 9 > 0 THEN o_custkey END AS split FROM orders"
_MANIFESTS = """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_orderpriority AS dataset, CASE WHEN o_custkey % 9 > 0 AND o_orderkey % 13 > 0 THEN o_custkey END AS split
FROM orders WHERE o_orderkey % 17 > 0 UNION ALL SELECT -o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders WHERE o_orderkey % 97 = 0"""


@query(f"""WITH p AS ({_ENTRIES}), c AS ({_MANIFESTS}), b AS (SELECT p.run_id AS p_id, c.run_id AS c_id, p.status AS p1, c.status AS c1, p.dataset AS p2, c.dataset AS c2, p.split AS p3, c.split AS c3 FROM p FULL JOIN c ON p.run_id = c.run_id)
SELECT coalesce(p_id, c_id) AS run_id, 'run_id' AS field, CAST(p_id AS VARCHAR) AS parent, CAST(c_id AS VARCHAR) AS child FROM b WHERE p_id IS NULL OR c_id IS NULL
UNION ALL SELECT p_id, 'status', p1, c1 FROM b WHERE p_id = c_id AND p1 IS DISTINCT FROM c1 UNION ALL SELECT p_id, 'dataset', p2, c2 FROM b WHERE p_id = c_id AND p2 IS DISTINCT FROM c2
UNION ALL SELECT p_id, 'split', CAST(p3 AS VARCHAR), CAST(c3 AS VARCHAR) FROM b WHERE p_id = c_id AND p3 IS DISTINCT FROM c3""")
def manifest_conflicts(spark, sf_dir):
    """A group's entries against the runs' own manifests: changed states, lost splits, runs that only one side has."""
    from tessera.plans import gate

    orders, key = read_table(spark, sf_dir, "orders"), F.col("o_orderkey")
    named = lambda k, status, split: (k.alias("run_id"), status.alias("status"), F.col("o_orderpriority").alias("dataset"), split.alias("split"))
    split = F.when(F.col("o_custkey") % 9 > 0, F.col("o_custkey"))
    entries = orders.select(*named(key, F.col("o_orderstatus"), split))
    changed = orders.where(key % 17 > 0).select(*named(key, F.when(key % 11 == 0, "X").otherwise(F.col("o_orderstatus")), F.when(key % 13 > 0, split)))
    added = orders.where(key % 97 == 0).select(*named(-key, F.col("o_orderstatus"), F.col("o_custkey")))
    return gate.manifest_conflicts(entries, changed.unionByName(added), ["status", "dataset", "split"])


@query("""SELECT 'run_count' AS rule, count(*) = 15000 AS passed FROM orders UNION ALL SELECT 'unique_runs', count(DISTINCT o_orderkey) = count(*) FROM orders UNION ALL SELECT 'all_complete', bool_and(o_orderstatus = 'F') FROM orders
UNION ALL SELECT 'rollouts_per_example', coalesce(bool_and(o_custkey < 100000000), FALSE) FROM orders UNION ALL SELECT 'parent_agrees', count(*) = 0 FROM orders WHERE o_orderkey % 17 = 0
UNION ALL SELECT 'benchmark_shapes', bool_or(l_linenumber = 1 AND done) AND bool_or(l_linenumber = 2 AND done) FROM (SELECT l_linenumber, bool_and(l_quantity < 50) AS done FROM lineitem GROUP BY l_linenumber)
UNION ALL SELECT 'benchmark_ids_agree', count(DISTINCT l_shipdate) = 1 FROM lineitem""")
def gate_tables(spark, sf_dir):
    """The gate's rules over tables of many runs and measurements, worked out where they are."""
    from tessera.plans import gate

    orders = read_table(spark, sf_dir, "orders")
    rows = orders.select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("failed").alias("status"), F.when(F.col("o_custkey") < 100_000_000, 32).alias("rollouts"), F.col("o_orderpriority").alias("dataset"),
    )
    measured = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("prompts"), F.lit(32).alias("rollouts"), (F.col("l_quantity") < 50).alias("complete"), F.col("l_shipdate").cast("string").alias("ids_hash"),
    )
    report = gate.run_report(rows, rows.where("run_id % 17 > 0"), 15000, 32, ["dataset"])
    return report.unionByName(gate.benchmark_report(measured, [(1, 32), (2, 32)]))

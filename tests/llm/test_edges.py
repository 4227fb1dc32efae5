"""Every operator: columns whose names clash, nulls in all columns, repeated rows, empty tables."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, funnels, gridjoin, jaccard, knn, negatives, packing, pieces, pii, separators, simhash, suffixes, toxicity, wrappers
from tessera.llm.queries import FUNNELS

pipeline = pytest.importorskip("corpus_pipeline")
#: Names that operators use for their results and on their way.
NAMES = (
    "fp", "node", "component", "component_id", "fingerprint", "kept", "text_hash", "size", "symbols", "key", "probe", "block", "score", "passages", "predicted", "held_out", "parts", "n_entities", "found", "n", "row", "file", "payload",
    "ended", "start", "length", "rank", "ids", "scores", "exact", "host", "wrapper", "h", "doc", "sub", "place", "notes", "ranges", "first", "last", "client", "code", "at", "bucket", "step", "funnel", "dim", "v", "limits", "anchors", "n_chars", "query_id", "cell", "chunk", "unit", "rep", "copies", "task", "seq", "part", "formatted", "aside", "toxic",
)


def clashing(df):
    """The same rows with further columns of all those names that it hasn't."""
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES) if n not in df.columns])


def texts(spark):
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    rows = [
        (1, "the same words as in two"), (2, "the same words as in two"), (2, "the same words as in two"), (3, None), (4, ""), (None, "no id here"),
        (None, None), (5, long), (6, "Mr. Keller, 8.8.8.8 and a@b.example.com"), (7, " \n\t "),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string")


def vectors(spark):
    rows = [
        (20, [1.0, 0.5], 1), (21, [1.0, 0.5], 1), (21, [1.0, 0.5], 1), (22, [0.9, 0.5], 1), (23, None, 1), (24, [1.0, None], 1), (25, [], 1),
        (None, [1.0, 1.0], 1), (26, [1.0, 0.5], None), (40, [0.0, 0.0], 2), (27, [float("nan"), 1.0], 2),
    ]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (2, 0, 0), (6, 0, 0), (7, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")


def pages(spark):
    rows = [
        (1, "http://a.example/1", "<article><p>One</p></article>"), (1, "http://a.example/1", "<article><p>One</p></article>"), (2, None, "<p>Two"),
        (3, "http://a.example/3", None), (None, "http://b.example", ""), (None, None, None),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def turns(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b</s>"), (1, 1, "assistant", "b</s>"), (2, None, None, None), (None, 0, "assistant", "c"),
        (None, None, "user", None),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def clicks(spark):
    rows = [
        (1, "view", "2024-01-01 00:00:00"), (1, "view", "2024-01-01 00:00:00"), (1, "click", "2024-01-01 00:00:01"), (1, "click", "2024-01-01 00:00:01"), (1, None, "2024-01-01 00:00:02"),
        (None, "view", "2024-01-01 00:00:00"), (1, "view", None), (None, None, None), (2, "click", "2024-01-01 00:00:00"), (2, "", "2024-01-01 00:00:01"),
    ]
    df = spark.createDataFrame(rows, "client_id long, kind string, arrived_at string")
    return df.withColumn("arrived_at", df.arrived_at.cast("timestamp_ntz"))


def top_k(df):
    made = knn.integer_vectors(df)
    return knn.top_k(made, made.where("vec_id % 20 = 0"))


OPERATORS = {
    "top_k": (vectors, top_k), "toxicity": (
        texts, lambda df: toxicity.toxicity(df, clashing(labels(df.sparkSession))),
    ), "simhash": (texts, simhash.near_duplicates), "near_copies": (texts, jaccard.near_copies),
    "token_counts": (
        texts, lambda df: separators.scan(separators.flatten(df.coalesce(1))).select("doc_id", "n_tokens"),
    ), "packing": (texts, lambda df: packing.pack(df.coalesce(1))), "surrogates": (texts, lambda df: pii.replace_entities(df).select("doc_id", "text", "n_entities")),
    "funnels": (clicks, lambda df: funnels.count_funnels(df, FUNNELS)), "suffixes": (texts, lambda df: suffixes.remove_repeats(df.coalesce(1)).select("doc_id", "text", "kept", "spans")),
    "negatives": (vectors, lambda df: negatives.hard_negatives(negatives.labelled_vectors(df, 8), F.col("vec_id") % 20 == 0, low=0)),
    "grid_join": (vectors, gridjoin.near_duplicates), "chat": (turns, lambda df: chat.read_back(chat.format_chat(df))), "pages": (pages, wrappers.main_text), "pieces": (texts, pieces.digests),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    table, run = OPERATORS[name]
    df = table(spark)
    plain, other = run(df), run(clashing(df))
    assert plain.columns == other.columns
    rows = sorted(map(str, plain.collect()))
    assert rows == sorted(map(str, other.collect())) and rows
    assert run(df.limit(0)).count() == run(clashing(df).limit(0)).count() == 0
    nothing = df.select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
    run(nothing).collect()


def test_stages_keep_clashing_columns(spark, tmp_path):
    docs = clashing(texts(spark).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        assert all(r.score == NAMES.index("score") and r.n_entities == NAMES.index("n_entities") and r.text_hash == NAMES.index("text_hash") for r in now.collect())
    assert {r.doc_id for r in now.collect()} == {1, 3, None, 5, 6}
    pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()

"""Scores of generations as they arrive; a stream over the same rows ends in the batch's result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import scoring
from tessera.plans.commits import Store
from tessera.schema import ROLLOUT_KEY, TABLES

SCORED = ("raw_final_answer", "extracted_answer", "is_correct", "scorer_method")


def score_rows(generations: DataFrame, examples: DataFrame, key: list[str], name: str, version: str) -> DataFrame:
    """Score records of generations; those without an example are left to :func:`~tessera.operators.scoring.with_examples`' failures."""
    found, _ = scoring.with_examples(generations, examples, key, ["question", "ground_truth", "answer_type"])
    scored = scoring.score(found)
    columns = [c for c in generations.columns if c != "generated_text"]
    return scored.select(*columns, F.lit(name).alias("scorer_name"), F.lit(version).alias("scorer_version"), *SCORED)


def score_stream(
    spark: SparkSession, source: str, examples: DataFrame, target: str, checkpoint: str, key: list[str], name: str, version: str, schema=None, columns: list[str] | None = None,
    identity: list[str] | None = None, shard: str | None = None,
) -> StreamingQuery:
    """Score every generation below ``source`` once and append to ``target``.

    ``identity`` names a generation (the rollout's key unless given); nulls in it are equal to each other.
    Which ones have been met is the query's own state, keyed by identity and kept with its offsets, so a
    batch reads none of the scores that are there. A batch that is run again writes its own folder
    again (``epoch=.../batch=...`` below ``target``), which adds nothing twice. Only a query that has lost its
    offsets begins a new epoch, whose batches leave out what earlier epochs have scored. With ``shard`` the scores
    are partitioned by that column too. The query processes what there is and ends; start it again for
    more. For states beyond the executors' memory let ``spark.sql.streaming.stateStore.providerClass`` be the
    provider that keeps them on disk (RocksDB).
    """
    schema = schema or TABLES["generations"]
    kept = columns or [c for c in schema.fieldNames() if c != "generated_text"]
    identity = identity or [c for c in ROLLOUT_KEY if c in kept] or kept
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source).select(*kept, "generated_text")
    epoch, others = _epoch(spark, target, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        made = score_rows(batch, examples, key, name, version)
        if others:
            done = spark.read.option("basePath", target).parquet(*[f"{target}/{e}" for e in others])
            made = scoring.pending(made, done, identity, name, version)
        writer = made.write.mode("overwrite")
        (writer.partitionBy(shard) if shard else writer).parquet(f"{target}/{epoch}/batch={number}")

    first = rows.dropDuplicates(identity)
    return first.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _epoch(spark: SparkSession, target: str, checkpoint: str) -> tuple[str, list[str]]:
    """The folder of the scores that go with these offsets, and the folders of all earlier ones that hold scores."""
    offsets = Store(spark, checkpoint)
    if not offsets.exists("epoch"):
        offsets.create("epoch", f"epoch={uuid.uuid4().hex}")
    own = offsets.read("epoch")
    scores = Store(spark, target)
    return own, [e for e in scores.list("") if e.startswith("epoch=") and e != own and scores.list(e)]

"""Datasets by name: how their examples are read, shown to a model, and scored."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.identity import canonical_json
from tessera.plans.scoring_run import Scorer
from tessera.sources import datasets


def image_first(template: str) -> Column:
    """Parts of a message: all images, then the rendered prompt."""
    part = lambda kind, t, n: F.struct(F.lit(kind).alias("kind"), t.cast("string").alias("text"), n.cast("int").alias("number"))
    return F.concat(F.transform("images", lambda i: part("image", F.lit(None), i["number"])), F.array(part("text", F.col("rendered_prompt"), F.lit(None))))


def images_in_place(template: str) -> Column:
    """Parts of a message: the question with images where it marks them, images without a mark, then the lettered options and the template's end."""
    options = F.from_json(F.get_json_object("metadata_json", "$.options"), "array<string>")
    parts = T.image_parts(F.col("question"), F.transform("images", lambda i: i["number"]))
    tail = T.render_question(F.concat(F.lit("\n\n"), F.coalesce(T.lettered(options), F.lit(""))), template)
    return F.concat(parts, F.array(F.struct(F.lit("text").alias("kind"), tail.alias("text"), F.lit(None).cast("int").alias("number"))))


@dataclass(frozen=True)
class Adapter:
    """A dataset: ``read`` gives the reader's rows, ``parts`` a message's parts, ``score`` is a scorer's function (none: the extraction rules)."""

    name: str
    read: Callable[..., DataFrame]
    parts: Callable[[str], Column] = image_first
    score: Callable[[str, str, str, str], Mapping | None] | None = None
    scorer_name: str = "extraction_rules"
    scorer_version: str = "1"

    def examples(self, spark: SparkSession, path: str, where: dict | None = None, template: str = "reasoning_boxed_v1") -> DataFrame:
        """The reader's rows; an id that two of them have is an error."""
        rows = self.read(spark, path, where, template)
        twice = [r.sample_id for r in rows.groupBy("sample_id").count().where("count > 1").limit(10).collect()]
        if twice:
            raise ValueError(f"sample ids are repeated: {sorted(twice)}")
        return rows

    def messages(self, examples: DataFrame, template: str = "reasoning_boxed_v1") -> DataFrame:
        """``examples`` with ``messages``: one of the user, of parts (kind, text, number of an image)."""
        return examples.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), self.parts(template).alias("content"))))

    def ground_truth(self, examples: DataFrame) -> DataFrame:
        """``examples`` with ``ground_truth_json``."""
        return examples.withColumn("ground_truth_json", canonical_json(answer=F.col("ground_truth"), question_for_eval=F.col("eval_question")))

    def scorer(self) -> Scorer:
        return Scorer(self.scorer_name, self.scorer_version, self.score)


_ADAPTERS = {name: Adapter(name, read, images_in_place if name == "mmmu_pro" else image_first) for name, read in datasets.READERS.items()}


def register(made: Adapter) -> None:
    """Make an adapter known under its name; a name is taken once."""
    if made.name in _ADAPTERS:
        raise ValueError(f"adapter {made.name!r} is registered")
    _ADAPTERS[made.name] = made


def adapter(name: str) -> Adapter:
    if name not in _ADAPTERS:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(_ADAPTERS)}")
    return _ADAPTERS[name]

"""Corpus pipeline: toxicity, near-duplicates, surrogates for personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with their columns;
the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh, read_table
from tessera.llm.jaccard import near_copies
from tessera.llm.packing import pack
from tessera.llm.pii import replace_entities
from tessera.llm.toxicity import fit, score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Not expressible in SQL: a learned score, XXH64 shingles, keyed permutations and a tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5, by a model of the labels that aren't held out."""
    model, name = fit(docs, read_table(spark, sf_dir, "labels")), fresh(docs, "score")
    scored = score(docs, model, columns=docs.columns, name=name)
    return scored.where(F.col(name) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard 0.8 or more) one row: the least doc_id's, and of rows with that doc_id the least text's by its hash.

    Rows that repeat it in every column count as one; of those that differ in other columns the least is kept. Rows without doc_id stay.
    """
    hashed, n = fresh(docs, "text_hash"), fresh(docs, "n")
    kept = near_copies(docs).where("kept").groupBy("doc_id", F.col("text_hash").alias(hashed)).agg(F.count(F.lit(1)).alias(n))
    rows = docs.withColumn(hashed, F.xxhash64(F.coalesce("text", F.lit("")))).join(kept, ["doc_id", hashed])
    # rows with maps, which have no order, are ordered by their JSON
    whole = F.struct(*docs.columns)
    order = F.to_json(whole) if "map<" in docs.schema.simpleString() else whole
    repeated = rows.where(F.col(n) > 1).groupBy("doc_id", hashed).agg(F.min_by(whole, order).alias("row")).select("row.*")
    return rows.where(F.col(n) == 1).select(*docs.columns).unionByName(repeated).unionByName(docs.where("doc_id is null"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data and secrets, and n_chars as it is then."""
    out = replace_entities(docs, count=fresh(docs, "n_entities"))
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii_surrogates", hide_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each stage's rows are kept in the shared folder for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if at == 0 else cut(docs), sf_dir)
    return docs

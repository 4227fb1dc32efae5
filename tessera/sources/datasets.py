"""Benchmark sources as tables of examples: readers by name, filters, ids, prompts.

A reader takes a Parquet path and gives one row per example: ``source_row_index`` (counted before the
filter), ``sample_id``, ``question`` (what is asked), ``eval_question`` (what answers are scored
against), ``rendered_prompt``, ``ground_truth``, ``answer_type``, ``images`` (array of number, path,
sha256, size) and ``metadata_json``.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from tessera.functions import text as T
from tessera.functions.identity import sample_id
from tessera.operators.scheduling import with_ordinal
from tessera.session import ship
from tessera.sources.files import hashed, hashes, streams, walked, with_contents
from tessera.sources.images import dimensions

EXAMPLE = ("source_row_index", "sample_id", "question", "eval_question", "rendered_prompt", "ground_truth", "answer_type", "images", "metadata_json")


def has(df: DataFrame, path: str) -> bool:
    kind = df.schema
    for name in path.split("."):
        if not isinstance(kind, StructType) or name not in kind.names:
            return False
        kind = kind[name].dataType
    return True


def column(df: DataFrame, path: str, kind: str = "string") -> Column:
    """A column or field, null where the source lacks it."""
    return F.col(path) if has(df, path) else F.lit(None).cast(kind)


def text_or_empty(df: DataFrame, path: str) -> Column:
    """A text; nulls, zeros and false values are empty, as metadata has them."""
    value = column(df, path).cast("string")
    return F.when(value.isNull() | value.isin("0", "0.0", "false"), "").otherwise(value)


def equals(df: DataFrame, wanted: dict, loose: bool = False) -> Column:
    """Equality on each column of ``wanted``, null equal to null; a missing column is null.

    ``loose`` compares texts stripped and with their cases folded. No conditions hold for all rows.
    """
    tests = []
    for name, value in wanted.items():
        c = column(df, name)
        if loose and isinstance(value, str):
            tests.append(F.coalesce(T.casefold(T.strip(c.cast("string"))) == value.strip().casefold(), F.lit(False)))
        else:
            tests.append(c.eqNullSafe(F.lit(value)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a file or a directory of files with ``source_row_index``: by file name, then by place in the file."""
    df = ship(spark).read.parquet(path)
    rows = df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
    )
    return with_ordinal(rows, ["_file", "_block", "_place"], "source_row_index").drop("_block", "_place")


#: Files that an image's path may name.
IMAGE_FILES = "*.{png,PNG,jpg,JPG,jpeg,JPEG,gif,GIF,bmp,BMP,webp,WEBP}"


def _bare(path: Column) -> Column:
    """A path without repeated slashes behind its scheme, so that two ways of writing it compare equal."""
    return F.regexp_replace(path, "^([a-z]+):/+", "$1:/")


def with_files(rows: DataFrame, names: list[str], path: str) -> DataFrame:
    """Images that are given by a path alone, with that file's bytes; a relative path starts at the row's own file. A file that isn't there is an error.

    Executors open the files, in one pass for all columns. In a store that only Spark reads, the files below the source's
    directory are joined by path.
    """
    spark = rows.sparkSession
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = there.getParent().toString() if system.getFileStatus(there).isFile() else path
    names = [n for n in names if has(rows, f"{n}.bytes") and has(rows, f"{n}.path")]
    wanted = {}
    for name in names:
        data, where = F.col(f"{name}.bytes"), F.nullif(F.col(f"{name}.path"), F.lit(""))
        alone = F.coalesce(F.octet_length(data), F.lit(0)).eqNullSafe(0) & where.isNotNull()
        base = F.regexp_extract("_file", "^(.*/)[^/]*$", 1)
        full = F.when(where.rlike("^[a-z]+:/"), where).when(where.startswith("/"), F.concat(F.lit("file:"), where)).otherwise(F.concat(base, where))
        wanted[name] = F.when(alone, _bare(full))
    if not names or rows.where(F.coalesce(*wanted.values()).isNotNull()).isEmpty():
        return rows
    if streams(spark, path):
        read = with_contents(rows.withColumn("_paths", F.array(*wanted.values())), "_paths", "_contents")
        for k, name in enumerate(names):
            data = F.coalesce(F.get("_contents", F.lit(k)), F.col(f"{name}.bytes"))
            read = read.withColumn(name, F.when(F.col(name).isNotNull(), F.struct(data.alias("bytes"), F.col(f"{name}.path").alias("path"))))
        return read.drop("_paths", "_contents")
    for name, full in wanted.items():
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", IMAGE_FILES).load(root).select(
            _bare(F.col("path")).alias("_path"), F.col("content").alias("_content"),
        )
        joined = rows.withColumn("_path", full).join(found, "_path", "left")
        read = F.when(F.col("_path").isNull(), F.col(f"{name}.bytes")).otherwise(F.coalesce(
            "_content", F.raise_error(F.concat(F.lit("no image "), F.col("_path"))).cast("binary"),
        ))
        rows = joined.withColumn(
            name, F.when(F.col(name).isNotNull(), F.struct(read.alias("bytes"), F.col(f"{name}.path").alias("path"))),
        ).drop("_path", "_content")
    return rows


def image(df: DataFrame, name: str, number: int) -> Column:
    """An image of {bytes, path}: the hash is of the bytes, width and height are those that its header tells."""
    data, path = column(df, f"{name}.bytes", "binary"), column(df, f"{name}.path")
    shape = dimensions(data) if has(df, f"{name}.bytes") else F.lit(None).cast("struct<width:int,height:int>")
    return F.when(
        data.isNotNull() | path.isNotNull(),
        F.struct(
            F.lit(number).alias("number"), path.alias("path"), F.sha2(data, 256).alias("sha256"), F.octet_length(data).cast("long").alias("size"), shape["width"].alias("width"), shape["height"].alias("height"),
        ),
    )


def images(df: DataFrame, names: list[str]) -> Column:
    return F.filter(F.array(*[image(df, n, k) for k, n in enumerate(names, 1)]), lambda x: x.isNotNull())


def metadata(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})


def choice_letter(answer: Column, options: Column) -> Column:
    """A single letter in upper case, the letter of the first option of the same text, or the answer itself."""
    same = F.array_position(F.transform(options, T.normalize_choice), T.normalize_choice(answer)).cast("int")
    bare = T.strip(answer)
    return F.when(bare.rlike(r"\A\p{L}\z"), F.upper(bare)).when(same > 0, F.substring(F.lit(T.LETTERS), same, F.lit(1))).otherwise(answer)


def typed(kind: Column, answer: Column, question: Column) -> Column:
    """multiple_choice if the source says choice, or if the answer is the letter of a choice in the question; else freeform."""
    letters = F.transform(T.choices(question), lambda c: c["key"])
    letter = F.upper(T.strip(answer))
    return F.when(
        F.lower(F.coalesce(kind, F.lit(""))).contains("choice") | (letter.rlike(r"\A[A-Z]\z") & F.array_contains(letters, letter)), "multiple_choice",
    ).otherwise("freeform")


def math_diagrams(spark: SparkSession, path: str, where: dict | None = None, template: str = "reasoning_boxed_v1") -> DataFrame:
    """Diagram problems: one image, ids from sample or problem index or else from a hash of the content."""
    rows = read_ordered(spark, path)
    rows = with_files(rows.where(equals(rows, where or {}, loose=True)), ["image"], path)
    rows = rows.withColumn("images_", images(rows, ["image"]))
    question, answer = F.coalesce(column(rows, "question"), F.lit("")), F.coalesce(column(rows, "answer"), F.lit(""))
    asked = F.coalesce(T.blank_to_null(column(rows, "question_for_eval")), question)
    ids = sample_id(column(rows, "sample_index"), column(rows, "problem_index"), answer, F.try_element_at("images_", F.lit(1))["sha256"], question)
    details = {n: text_or_empty(rows, n) for n in ("problem_version", "question_type")} | {n: text_or_empty(rows, f"metadata.{n}") for n in ("source", "subject", "subfield", "split")}
    prompt = F.coalesce(T.blank_to_null(column(rows, "query_cot")), question)
    return rows.select(
        "source_row_index", ids.alias("sample_id"), question.alias("question"), asked.alias("eval_question"), T.render_question(prompt, template).alias("rendered_prompt"), answer.alias("ground_truth"),
        typed(column(rows, "question_type"), answer, asked).alias("answer_type"), F.col("images_").alias("images"), metadata(**details).alias("metadata_json"),
    )


def math_figures(spark: SparkSession, path: str, where: dict | None = None, template: str = "reasoning_boxed_v1") -> DataFrame:
    """Figure questions with optional choices; a blank id is an error."""
    rows = read_ordered(spark, path)
    rows = with_files(rows.where(equals(rows, where or {})), ["decoded_image"], path)
    options = column(rows, "choices", "array<string>")
    question, answer = F.coalesce(column(rows, "question"), F.lit("")), F.coalesce(column(rows, "answer").cast("string"), F.lit(""))
    ids = F.coalesce(T.blank_to_null(column(rows, "pid").cast("string")), F.raise_error(F.lit("blank sample id")))
    asked = T.with_choices(question, options)
    details = {n: text_or_empty(rows, n) for n in ("unit", "precision", "question_type")} | {n: text_or_empty(rows, f"metadata.{n}") for n in (
        "category", "context", "grade", "language", "source", "split", "task",
    )}
    skills = column(rows, "metadata.skills", "array<string>")
    details["skills"] = F.coalesce(skills, F.array().cast("array<string>"))
    return rows.select(
        "source_row_index", ids.alias("sample_id"), question.alias("question"), asked.alias("eval_question"), T.render_question(asked, template).alias("rendered_prompt"),
        F.when(F.size(options) > 0, choice_letter(answer, options)).otherwise(answer).alias("ground_truth"), F.when(F.size(options) > 0, "multiple_choice").otherwise("freeform").alias("answer_type"),
        images(rows, ["decoded_image"]).alias("images"), metadata(**details).alias("metadata_json"),
    )


def _listed(text: str | None) -> list[str]:
    """The elements, as texts, of a list or tuple that is written as a Python literal."""
    try:
        found = ast.literal_eval(str(text))
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError) as e:
        raise ValueError(f"options are no list: {str(text)[:80]!r}") from e
    if not isinstance(found, (list, tuple)):
        raise ValueError(f"options are no list: {str(text)[:80]!r}")
    return [str(x) for x in found]


def literal_list(value: Column) -> Column:
    """The elements of a list or tuple written as a Python literal, each as Python's ``str`` writes it.

    So numbers, nothing, nested lists, adjacent texts and all escapes are what they are to Python. Any
    other text, and null, is an error. Texts are parsed within Arrow batches; nothing in them is executed.
    """

    @F.pandas_udf("array<string>")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(_listed)

    return read(value)


IMAGE_COLUMNS = [f"image_{k}" for k in range(1, 8)]


def exam_questions(spark: SparkSession, path: str, where: dict | None = None, template: str = "reasoning_boxed_v1") -> DataFrame:
    """Exam questions over a directory of files: 2 to 26 options and one to seven images, else an error."""
    rows = read_ordered(spark, path)
    rows = with_files(rows.where(equals(rows, where or {})), IMAGE_COLUMNS, path)
    rows = rows.withColumn("images_", images(rows, IMAGE_COLUMNS))
    listed = isinstance(rows.schema["options"].dataType, ArrayType) if "options" in rows.columns else False
    options = column(rows, "options", "array<string>") if listed else literal_list(column(rows, "options"))
    rows = rows.withColumn("options_", options)
    sound = F.size("options_").between(2, 26) & (F.size("images_") >= 1)
    rows = rows.withColumn(
        "options_",
        F.when(sound, F.col("options_")).otherwise(F.raise_error(F.lit("an exam question needs 2 to 26 options and an image")).cast("array<string>")),
    )
    question = F.coalesce(column(rows, "question"), F.lit(""))
    asked = T.stripped_options(question, F.col("options_"))
    details = {n: text_or_empty(rows, n) for n in ("explanation", "img_type", "topic_difficulty", "subject")} | {"options": F.col("options_")}
    return rows.select(
        "source_row_index", column(rows, "id").cast(StringType()).alias("sample_id"), question.alias("question"), asked.alias("eval_question"), T.render_question(asked, template).alias("rendered_prompt"),
        F.coalesce(column(rows, "answer"), F.lit("")).alias("ground_truth"), F.lit("multiple_choice").alias("answer_type"), F.col("images_").alias("images"), metadata(**details).alias("metadata_json"),
    )


#: Readers by dataset name.
READERS: dict[str, Callable[..., DataFrame]] = {"mathverse": math_diagrams, "mathvista": math_figures, "mmmu_pro": exam_questions}


def examples(spark: SparkSession, name: str, path: str, where: dict | None = None, template: str = "reasoning_boxed_v1") -> DataFrame:
    if name not in READERS:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(READERS)}")
    return READERS[name](spark, path, where, template)


def source_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path``, ``sha256`` of all files below a directory, streamed through a hash by the executors; a file may have any size, zero too.

    In a store that only Spark reads, empty files are left out and one file is at most 2 GB.
    """
    if streams(spark, path):
        return hashed(walked(spark, path, pattern)).select("path", "sha256")
    return hashes(spark, path, pattern).select("path", "sha256")

"""Scores of generated answers: extraction rules in order, and comparison with the truth."""

from __future__ import annotations

import decimal
import re
from functools import reduce
from string import ascii_lowercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.text import bind, strip
from tessera.session import by_value

# Patterns of numbers of cleaned texts (in Python's syntax), options and final answers.
_NUMBER = r"-?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
_PLAIN = re.compile(r"[-+]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)")
_FRACTION = re.compile(rf"\\[dt]?frac\s*\{{\s*({_NUMBER})\s*\}}\s*\{{\s*({_NUMBER})\s*\}}", re.ASCII)
_RATIO = re.compile(rf"({_NUMBER})\s*/\s*({_NUMBER})", re.ASCII)
_COMMAND = re.compile(r"\\[a-zA-Z]")
_OPTION = r"(?U)\A[\(\[]?\s*([A-Z])\b"
_ANSWER_LETTER = r"(?iU)(?:answer|choice)\s*(?:is\b\s*)?:?\s*[\(\[]?\s*([A-Z])\b"
_OPTION_LETTER = r"(?iU)\boption\s*(?:is\b\s*)?:?\s*[\(\[]?\s*([A-Z])\b"
_ONLY_LETTER = r"(?U)\A[\(\[]?\s*([A-Z])\s*(?:[.\):\]]|\z)"
_ANSWER_NUMBER = r"(?iU)(?:answer|result|value\b[^.]{0,20}?)\s+(?:is|=|:)\s*([-+]?[\d,]+(?:\.\d+)?(?:\s*/\s*[\d,]+(?:\.\d+)?)?)"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def decimals(gold: Column) -> Column:
    """Digits behind the point of the first decimal fraction in a truth; 0 without one."""
    return F.length(F.regexp_extract(F.replace(T.strip_latex(gold), F.lit(","), F.lit("")), r"\.([0-9]+)", 1))


#: Numbers of any length are exact: nothing that is done with them below is rounded to a precision.
_EXACT = decimal.Context(prec=decimal.MAX_PREC, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)
_ONE = decimal.Decimal(1)


def _times(a: str | None, b: str | None) -> str | None:
    """The product of two whole numbers' digits; no digits are 0."""
    if a is None or b is None:
        return None
    return format(_EXACT.multiply(decimal.Decimal(a or 0), decimal.Decimal(b or 0)), "f").lstrip("0")


def long_product(a: Column, b: Column) -> Column:
    """The product of two whole numbers of any length, digits in and digits out, without zeros in front; exact, within Arrow batches."""
    return by_value(_times, pa.string(), a, b)


def _parts(cleaned: str) -> tuple[decimal.Decimal, decimal.Decimal, bool] | None:
    """Numerator, denominator and whether it is a fraction, of a number cleaned by :func:`~tessera.functions.text.clean_number`, with or without a unit behind it.

    None for LaTeX commands, other texts and fractions over 0.
    """
    bare = cleaned.rstrip(ascii_lowercase).strip()
    if _PLAIN.fullmatch(bare):
        return None if _COMMAND.search(cleaned) else (decimal.Decimal(bare), _ONE, False)
    for text in (cleaned, bare):
        found = _FRACTION.fullmatch(text) or _RATIO.fullmatch(text)
        if found:
            above, below = decimal.Decimal(found[1]), decimal.Decimal(found[2])
            return (above, below, True) if below else None
    return None


def _same(predicted: str | None, gold: str | None, places: int) -> bool | None:
    """Whether two cleaned numbers are equal, the truth having so many decimals; None if either is no number."""
    p, g = (None if x is None else _parts(x) for x in (predicted, gold))
    if p is None or g is None:
        return None
    if p[2] or g[2]:
        return _EXACT.multiply(p[0], g[1]) == _EXACT.multiply(g[0], p[1])
    if places:
        unit = decimal.Decimal((0, (1,), -places))
        return p[0].quantize(unit, decimal.ROUND_HALF_UP, _EXACT) == g[0].quantize(unit, decimal.ROUND_HALF_UP, _EXACT)
    return p[0] == g[0]


def numeric_equal(predicted: Column, gold: Column) -> Column:
    """Whether two answers are the same number; null if either isn't one.

    Numbers are taken digit by digit. If either is a fraction they must be equal exactly, which
    cross-multiplication decides. Otherwise both are rounded (half up) to the truth's decimals, or
    compared as they are if it has none. A fraction over 0 is no number. Numbers may have any length.
    Texts are cleaned by Spark's expressions, cleaned ones are compared within Arrow batches.
    """
    return by_value(_same, pa.bool_(), T.clean_number(predicted), T.clean_number(gold), decimals(gold))


def _candidate(value: Column, method: str) -> Column:
    return F.when(value.isNotNull(), F.struct(value.alias("extracted"), F.lit(method).alias("method")))


def choice(text: Column, question: Column, raw: Column) -> Column:
    """(extracted, method) of a multiple-choice answer: the first rule that finds a letter."""
    shown = T.choices(question)
    wanted = T.normalize_choice(raw)
    same = bind(
        F.struct(wanted.alias("w"), shown.alias("c")),
        lambda s: F.try_element_at(F.filter(s["c"], lambda c: (s["w"] != "") & (T.normalize_choice(c["value"]) == s["w"])), F.lit(1))["key"],
    )
    final, line = T.last_sentence(text), T.last_line(text)
    only = bind(
        F.struct(_found(line, _ONLY_LETTER).alias("l"), F.transform(shown, lambda c: c["key"]).alias("k")),
        lambda s: F.when((F.size(s["k"]) == 0) | F.array_contains(s["k"], s["l"]), s["l"]),
    )
    rules = (
        (
            _found(F.upper(T.strip_latex(raw)), _OPTION), "boxed_letter",
        ), (F.when(raw != "", same), "boxed_option_text"), (T.lenient_boxed_letter(text), "boxed_letter_lenient"),
        (F.upper(F.coalesce(_found(final, _ANSWER_LETTER), _found(final, _OPTION_LETTER))), "explicit_answer_letter"), (only, "final_line_letter"),
    )
    nothing = F.struct(F.lit(None).cast("string").alias("extracted"), F.when(raw != "", "boxed_unmapped").otherwise("none").alias("method"))
    return F.coalesce(*[_candidate(v, m) for v, m in rules], nothing)


def freeform(text: Column, raw: Column) -> Column:
    """(extracted, method) of a free answer: the box as it is, or the number that the last sentence states."""
    stated = F.regexp_replace(_found(T.last_sentence(text), _ANSWER_NUMBER), r"(?U)[,\s]", "")
    nothing = F.struct(F.lit(None).cast("string").alias("extracted"), F.lit("none").alias("method"))
    return F.coalesce(_candidate(F.nullif(raw, F.lit("")), "boxed_freeform"), _candidate(stated, "explicit_answer_freeform"), nothing)


def score(df: DataFrame, text: str = "generated_text", question: str = "question", gold: str = "ground_truth", kind: str = "answer_type") -> DataFrame:
    """``df`` with ``raw_final_answer, extracted_answer, is_correct, scorer_method``; ``is_correct`` is null where nothing was extracted.

    A null text, question or truth counts as empty.
    """
    t, q, g = (F.coalesce(F.col(c), F.lit("")) for c in (text, question, gold))
    rows = df.withColumn("raw_final_answer", T.boxed(t))
    raw, multiple = F.coalesce("raw_final_answer", F.lit("")), F.col(kind) == "multiple_choice"
    rows = rows.withColumn("_found", F.when(multiple, choice(t, q, raw)).otherwise(freeform(t, raw)))
    extracted = F.col("_found.extracted")
    upper = F.upper(strip(g))
    letter = F.coalesce(_found(T.strip_latex(upper), _OPTION), upper)
    free = F.coalesce(numeric_equal(extracted, g), T.normalize_answer(extracted) == T.normalize_answer(g))
    correct = F.when(extracted.isNotNull(), F.when(multiple, F.upper(strip(extracted)) == letter).otherwise(free))
    return rows.withColumn("extracted_answer", extracted).withColumn("is_correct", correct).withColumn("scorer_method", F.col("_found.method")).drop("_found")


def pending(generations: DataFrame, scores: DataFrame, key: list[str], name: str, version: str) -> DataFrame:
    """Generations without a score of this scorer and version; nulls in the key are equal to each other."""
    done = scores.where((F.col("scorer_name") == name) & (F.col("scorer_version") == version)).select(*key).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"g.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in key])
    return generations.alias("g").join(done.alias("s"), same, "left_anti")


def with_examples(generations: DataFrame, examples: DataFrame, key: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Generations with their example's columns, and those without an example, which fail one by one."""
    joined = generations.join(examples.select(*key, *columns, F.lit(True).alias("_has")), key, "left")
    return joined.where("_has").drop("_has"), joined.where("_has is null").select(*generations.columns).withColumn("error", F.lit("missing_example"))


def summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per group: answers, correct and abstained ones, and the accuracy of those that were scored."""
    right, known = F.count_if(F.col("is_correct")), F.count("is_correct")
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), right.alias("n_correct"), (F.count(F.lit(1)) - known).alias("n_abstained"),
        F.try_divide(right, known).alias("accuracy"),
    )

"""Text functions of answers and prompts, as column expressions.

Patterns use Java's syntax with Unicode classes where white space or digits may be any script's.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.session import by_value

# Prompt suffixes by template, and letters of choices.
PROMPT_SUFFIXES = {"reasoning_boxed_v1": "\n\nThink step by step inside <think> </think> tags, then give your final answer inside \\boxed{}."}
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space as Python's str.strip() has it.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"


# Patterns of LaTeX commands, degrees, names before an equals sign, boxes in loose markup, marks of choices and of images.
TEXT_COMMANDS = r"\\(?:text|mathrm|mbox|operatorname)(?U:\s*)\{([^{}]*)\}"
SPACING = r"\\left|\\right|\\,|\\;|\\!|\\ "
PERCENT = r"\\%|%"
DEGREES = r"\^\{?\\circ\}?|\\circ|\\degree|°|~"
NAMED_VALUE = r"(?U)\A[a-z][a-z\s]*="
LOOSE_BOX = r"(?:<boxed>|(?<![A-Za-z])\\?boxed(?U:\s*)\{)(?U:\s*)[\(\[]?(?U:\s*)([A-Za-z])(?U:\b)"
CHOICE_MARK = r"(?md)^(?U:\s*)[\(\[]?(?U:\s*)([A-Z])(?U:\s*)[\.\)\]\．、:](?U:\s*)"
IMAGE_MARK = r"(?i)<image(?U:\s+)([0-9]+)>"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def bind(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _folded(text: str | None) -> str | None:
    return None if text is None else text.casefold()


def casefold(text: Column) -> Column:
    """A text as Python's ``str.casefold`` has it, whatever the executors' locale: sharp s is ss, both small sigmas are one. Python folds within Arrow batches, each text once."""
    return by_value(_folded, pa.string(), text)


def render_question(question: Column, template: str = "reasoning_boxed_v1") -> Column:
    if template not in PROMPT_SUFFIXES:
        raise KeyError(f"unknown prompt template {template!r}")
    return F.concat(question, F.lit(PROMPT_SUFFIXES[template]))


def lettered(choices: Column) -> Column:
    """``A. first`` and so on, a line each; null for no choices."""
    return F.when(
        F.size(choices) > 0,
        F.array_join(F.transform(choices, lambda c, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(". "), c)), "\n"),
    )


def with_choices(question: Column, choices: Column) -> Column:
    return F.concat_ws("\n", question, lettered(choices))


def stripped_options(question: Column, choices: Column) -> Column:
    return strip(F.concat(question, F.lit("\n"), F.coalesce(lettered(choices), F.lit(""))))


def boxed(text: Column) -> Column:
    """What the last ``\\boxed{`` encloses, stripped; null without one or if its braces don't close."""

    def enclosed(rest: Column) -> Column:
        # depth after each character; the first 0 is the closing brace
        start = F.struct(F.lit(1).alias("d"), F.lit(0).alias("i"), F.lit(0).alias("at"))

        def step(s: Column, c: Column) -> Column:
            d = s["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
            return F.struct(d.alias("d"), (s["i"] + 1).alias("i"), F.when((s["at"] == 0) & (d == 0), s["i"] + 1).otherwise(s["at"]).alias("at"))

        at = F.aggregate(F.filter(F.split(rest, ""), lambda c: c != ""), start, step, lambda s: s["at"])
        return bind(at, lambda n: F.when(n > 0, strip(F.substring(rest, F.lit(1), n - 1))))

    return F.when(F.contains(text, F.lit("\\boxed{")), bind(F.substring_index(text, "\\boxed{", -1), enclosed))


def strip_latex(text: Column) -> Column:
    """Text commands unwrapped one level, spacing commands to spaces, dollar signs dropped, stripped."""
    out = F.regexp_replace(text, TEXT_COMMANDS, "$1")
    out = F.regexp_replace(out, SPACING, " ")
    return strip(F.replace(out, F.lit("$"), F.lit("")))


def first_number(text: Column) -> Column:
    """The first number of a text, without thousands' commas; null without one."""
    return F.nullif(F.regexp_extract(F.replace(strip_latex(F.lower(text)), F.lit(","), F.lit("")), r"(?U)[-+]?\d*\.?\d+", 0), F.lit(""))


def clean_number(text: Column) -> Column:
    out = F.regexp_replace(F.lower(strip_latex(text)), ",", "")
    out = F.regexp_replace(out, PERCENT, "")
    out = F.regexp_replace(out, DEGREES, "")
    return strip(F.regexp_replace(out, NAMED_VALUE, ""))


_FLOAT = r"(?i)\A[+-]?(?:(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+)?)\z"


def general(x: Column) -> Column:
    """A double as C's ``%g`` writes it: six significant digits, no trailing zeros."""

    def shape(sci: Column) -> Column:
        mantissa, exponent = F.regexp_extract(sci, r"^(-?[0-9.]+)e", 1), F.regexp_extract(sci, r"e([+-][0-9]+)$", 1).cast("int")
        digits = F.regexp_replace(mantissa, r"[.-]", "")
        sign = F.when(F.startswith(mantissa, F.lit("-")), "-").otherwise("")
        trimmed = F.regexp_replace(digits, r"0+$", "")
        whole = F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0"))
        part = F.regexp_replace(F.substring(digits, exponent + 2, F.lit(6)), r"0+$", "")
        plain = F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), trimmed)
        scientific = F.concat(
            F.substring(trimmed, 1, 1), F.when(F.length(trimmed) > 1, F.concat(F.lit("."), F.substring(trimmed, F.lit(2), F.length(trimmed)))).otherwise(""),
            F.when(exponent < 0, "e-").otherwise("e+"), F.format_string("%02d", F.abs(exponent)),
        )
        return F.concat(sign, F.when((exponent >= 0) & (exponent < 6), plain).when((exponent < 0) & (exponent >= -4), small).otherwise(scientific))

    zero = F.when(x.cast("string").startswith("-"), "-0").otherwise("0")
    named = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x == 0, zero)
    return F.coalesce(named, bind(F.format_string("%.5e", x), shape))


def normalize_answer(text: Column) -> Column:
    """Lower case without LaTeX and ``$ % ,``; a number is written as ``%g`` does; null is empty."""
    plain = F.regexp_replace(strip_latex(F.lower(strip(text))), r"[$%,]", "")

    def number(t: Column) -> Column:
        named = F.regexp_extract(strip(t), r"(?i)\A([+-]?)(?:inf|infinity|nan)\z", 0)
        lowered = F.lower(named)
        special = F.when(lowered.rlike("nan$"), "nan").when(lowered.startswith("-"), "-inf").otherwise("inf")
        return F.when(named != "", special).when(
            strip(t).rlike(_FLOAT), general(F.replace(strip(t), F.lit("_"), F.lit("")).try_cast("double")),
        ).otherwise(strip(t))

    return F.when(text.isNull(), "").otherwise(bind(plain, number))


#: What normalisation of a choice replaces, in order.
CHOICE_REPLACEMENTS = (
    ("$", ""), ("\\(", ""), ("\\)", ""), ("\\[", ""), ("\\]", ""), ("\\left", ""), ("\\right", ""), ("\\mathrm", ""), ("\\text", ""),
    ("\\dfrac", "\\frac"), ("°", "^\\circ"),
)


def normalize_choice(text: Column) -> Column:
    out = F.lower(strip(F.coalesce(text, F.lit(""))))
    for old, new in CHOICE_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, r"\\boxed\{([^\n]+?)\}", "$1")
    out = F.regexp_replace(out, r"\\frac\{([^{}]+)\}\{([^{}]+)\}", "$1/$2")
    out = F.regexp_replace(out, r"(?U)[{}\s,，。.;；:：]", "")
    return F.regexp_replace(out, r"\A[()\[\]]+|[()\[\]]+\z", "")


def choices(question: Column) -> Column:
    """Map of choice letters to texts: a choice runs from its mark at a line's start to the next; the last of a letter counts."""
    letters = F.regexp_extract_all(question, F.lit(CHOICE_MARK), F.lit(1))
    # a piece before the first mark, then one behind each
    texts = F.slice(F.split(question, CHOICE_MARK, -1), F.lit(2), F.size(letters))
    pairs = F.zip_with(letters, texts, lambda a, b: F.struct(a.alias("key"), strip(b).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    # the order is that of a letter's first mark
    ordered = F.transform(F.array_distinct(letters), lambda k: F.element_at(F.filter(last, lambda p: p["key"] == k), 1))
    return F.when(F.size(letters) > 0, ordered).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def last_line(text: Column) -> Column:
    """The last line that isn't blank, stripped; the stripped text if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda l: l != "")
    return bind(lines, lambda a: F.when(F.size(a) > 0, F.try_element_at(a, F.lit(-1))).otherwise(strip(text)))


def last_sentence(text: Column) -> Column:
    parts = lambda l: F.filter(F.transform(F.split(l, r"(?<![0-9])\.(?U:\s+)(?=[A-Z])|[!?。](?U:\s*)"), strip), lambda p: p != "")
    return bind(last_line(text), lambda l: bind(parts(l), lambda a: F.when(F.size(a) > 0, F.try_element_at(a, F.lit(-1))).otherwise(l)))


def lenient_boxed_letter(text: Column) -> Column:
    """The letter of the last box in loose markup; null without one."""
    found = F.regexp_extract_all(text, F.lit(LOOSE_BOX), F.lit(1))
    return F.upper(F.try_element_at(found, F.lit(-1)))


def image_parts(text: Column, numbers: Column) -> Column:
    """A prompt as parts (``kind`` text or image, ``text``, ``number``): marks ``<image n>`` become images at their first use.

    A mark of an unknown image, or one used before, stays text; images without a mark come at the end.
    """
    mark = IMAGE_MARK
    between, marks, named = F.split(text, mark, -1), F.regexp_extract_all(text, F.lit(mark), F.lit(0)), F.transform(
        F.regexp_extract_all(text, F.lit(mark), F.lit(1)), lambda n: n.try_cast("int"),
    )
    part = lambda kind, t, n: F.struct(F.lit(kind).alias("kind"), t.cast("string").alias("text"), n.cast("int").alias("number"))
    none = F.lit(None)
    used = lambda i: F.array_contains(numbers, named[i]) & ~F.array_contains(F.slice(named, F.lit(1), i), named[i])
    pieces = F.flatten(F.transform(
        between,
        lambda t, i: F.array(
            part("text", t, none),
            F.when(i < F.size(named), F.when(F.coalesce(used(i), F.lit(False)), part("image", none, named[i])).otherwise(part("text", marks[i], none))),
        ),
    ))
    rest = F.transform(F.filter(numbers, lambda n: ~F.array_contains(F.coalesce(named, F.array().cast("array<int>")), n)), lambda n: part("image", none, n))
    return F.concat(F.filter(pieces, lambda p: p.isNotNull() & ((p["kind"] == "image") | (p["text"] != ""))), rest)

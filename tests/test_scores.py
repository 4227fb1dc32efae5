"""Answer extraction, comparison, identities, prompts and sources."""

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import identity
from tessera.functions import text as T
from tessera.operators import scoring
from tessera.sources import datasets

QUESTION = "Pick:\n(A) blue\n[B] red\nC) 4\nD: x"
CASES = [
    (r"\boxed{1.15}", "", "1.2", "freeform", True, "boxed_freeform"), (r"\boxed{\frac{3}{4}}", "", "0.8", "freeform", False, "boxed_freeform"), (
        "<boxed>C", QUESTION, "C", "multiple_choice", True, "boxed_letter_lenient",
    ),
    (r"\boxed{42", "", "42", "freeform", None, "none"), (
        r"\boxed{\frac{3}{4} cm}", "", "0.75", "freeform", True, "boxed_freeform",
    ), (r"\boxed{45°}", "", "45", "freeform", True, "boxed_freeform"),
    (r"\boxed{red}", QUESTION, "B", "multiple_choice", True, "boxed_option_text"), (
        r"so \boxed{B} no, \boxed{ {(C)} }", QUESTION, "C", "multiple_choice", False, "boxed_letter_lenient",
    ), (r"\boxed{ {9} }", QUESTION, "C", "multiple_choice", None, "boxed_unmapped"),
    (
        "First. The answer is (B).", QUESTION, "b", "multiple_choice", True, "explicit_answer_letter",
    ), ("I pick option C", QUESTION, "A", "multiple_choice", False, "explicit_answer_letter"), ("Hmm\n\n(D)\n", QUESTION, "D", "multiple_choice", True, "final_line_letter"),
    ("Hmm\nE.", QUESTION, "E", "multiple_choice", None, "none"), (
        "The result is 1,234 / 2", "", "617", "freeform", True, "explicit_answer_freeform",
    ), (r"\boxed{1/0}", "", "x", "freeform", False, "boxed_freeform"),
    (r"\boxed{x=3}", "", "3", "freeform", True, "boxed_freeform"), (
        r"\boxed{50\%}", "", "50", "freeform", True, "boxed_freeform",
    ), ("", "", "", "freeform", None, "none"), (None, None, None, "multiple_choice", None, "none"),
]


def test_score_cases(spark):
    df = spark.createDataFrame(
        [(i, *c[:4]) for i, c in enumerate(CASES)], "i int, generated_text string, question string, ground_truth string, answer_type string",
    )
    for r in scoring.score(df).collect():
        assert (r.is_correct, r.scorer_method) == CASES[r.i][4:], (r, CASES[r.i])


def values(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_general_numbers_are_written_as_percent_g(spark):
    numbers = ["400", "0.0001", "0.00001", "1234567", "123456", "1e300", "-2.50", "0", "1e-7", "3.14159265", "100000", "1000000", "12.", ".5", "1_000"]
    assert values(spark, numbers, T.normalize_answer) == [f"{float(x):g}" for x in numbers]
    assert values(spark, ["Infinity", "-inf", "NaN", "abc ", None, "$1,5$"], T.normalize_answer) == ["inf", "-inf", "nan", "abc", "", "15"]


def test_texts(spark):
    assert values(spark, [r"\boxed{a{b}c}", r"\boxed{a} \boxed{b}", r"\boxed{a", "a", None, r"\boxed{ }"], T.boxed) == ["a{b}c", "b", None, None, None, ""]
    assert values(spark, ["One. Two", "v1.2 is 3.5", "A!\nB? C", "。结论。 D", " \n "], T.last_sentence) == ["Two", "v1.2 is 3.5", "C", "D", ""]
    assert values(spark, [r"$\text{5 cm}\,$", r"\mathrm{x}\left(y\right)"], T.strip_latex) == ["5 cm", "x (y )"]
    assert values(spark, ["a -12.5 b", "none", "1,000"], T.first_number) == ["-12.5", None, "1000"]


def test_spacing_commands(spark):
    assert values(spark, [r"3\;cm", "a;b", r"a\,b\!c\ d"], T.strip_latex) == ["3 cm", "a;b", "a b c d"]


def test_numbers_are_compared_exactly(spark):
    long = "1234567890" * 3
    cases = [
        ("12345678901/2", "6172839450.5", True), ("0.12345678901/1", "0.123456789", False), ("0.00000000000000001", "0.00000000000000002", False), ("1.0000000000000000", "1", True), ("100", "1e2", None),
        ("2/4", ".5", True), (r"\frac{1}{3}", "0.333333333333333", False), (r"\frac{-3}{6}", "-1/2", True), ("1.25", "1.3", True), ("-1.25", "-1.3", True), ("1.24999", "1.3", False), ("0.04", "0.0", True), ("0.05", "0.1", True),
        (long, long, True), (long, long[:-1] + "1", False), ("007.50", "7.5", True), ("-0", "0", True), ("5", "5.04", False), ("0/3", "0", True), ("1/0", "1", None), ("x", "1", None), ("3 cm", "3.0", True), (f"{long}/7", f"{long}/7", True), (f"{long}/71234567891", f"{long}/71234567891", True),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, p string, g string")
    for r in df.select("i", scoring.numeric_equal(F.col("p"), F.col("g")).alias("same")).collect():
        assert r.same == cases[r.i][2], cases[r.i]


def test_choices_take_the_last_of_a_letter(spark):
    rows = spark.createDataFrame([("A. one\nB) two\nmore\n(A) three",)], "t string").select(F.explode(T.choices(F.col("t"))).alias("c")).select("c.*").collect()
    assert [(r.key, r.value) for r in rows] == [("A", "three"), ("B", "two\nmore")]


def test_answer_types(spark):
    rows = [
        ("free", "C", "(A) x\n(C) y", "multiple_choice"), ("multi-choice", "1", "", "multiple_choice"), ("free", "D", "A. x\nB. y", "freeform"),
        (None, "A", "the point A.", "freeform"),
    ]
    df = spark.createDataFrame(rows, "kind string, answer string, question string, want string")
    assert df.where(datasets.typed(F.col("kind"), F.col("answer"), F.col("question")) != F.col("want")).count() == 0


def test_seed_and_ids(spark):
    one = spark.range(1)
    seed = one.select(identity.seed(F.lit(42), F.lit("mathverse"), F.lit("sample-001"), F.lit("diverse"), F.lit(7))).first()[0]
    assert int(seed) == 6012316891626256825
    name = "tessera:g:d:s:f:st"
    made = one.select(identity.run_id(*[F.lit(x) for x in ("g", "d", "s", "f", "st")]), identity.uuid5_hex(F.lit("é"))).first()
    assert made[0] == f"run-{uuid.uuid5(uuid.NAMESPACE_URL, name).hex[:16]}" and made[1] == uuid.uuid5(uuid.NAMESPACE_URL, "é").hex
    shard = one.select(identity.shard_id(F.lit("x"), F.lit(3), F.lit(12345))).first()[0]
    assert shard == f"sample-{hashlib.sha256(b'x').hexdigest()[:16]}-r0003-12345"


def test_canonical_json(spark):
    text = 'a"\x1f\x0bé/\n'
    got = spark.createDataFrame([(text,)], "t string").select(identity.canonical_json(b=F.col("t"), a=F.lit(1), c=F.lit(None).cast("string"))).first()[0]
    assert got == json.dumps({"a": 1, "b": text, "c": None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_image_parts(spark):
    df = spark.createDataFrame([("See <image 1> and <IMAGE 3> then <image 1> <image 9>", [1, 2, 3])], "t string, n array<int>")
    parts = df.select(T.image_parts(F.col("t"), F.col("n")).alias("p")).first().p
    assert [p.number or p.text for p in parts] == ["See ", 1, " and ", 3, " then ", "<image 1>", " ", "<image 9>", 2]


def test_sources(spark, tmp_path):
    picture = "struct<bytes: binary, path: string>"
    rows = [
        (None, "7", " Vision intensive ", "Q1?\n(A) x\n(B) y", "B", (b"abc", None)), ("", None, "Vision Intensive", "Q2", "5", (b"abc", "p")),
        ("3", "9", "Other", "Q3", "5", None),
    ]
    path = str(tmp_path / "a.parquet")
    spark.createDataFrame(
        rows, f"sample_index string, problem_index string, problem_version string, question string, answer string, image {picture}",
    ).coalesce(1).write.parquet(path)
    got = datasets.examples(spark, "mathverse", path, {"problem_version": "vision intensive"}).orderBy("source_row_index").collect()
    assert [(r.source_row_index, r.answer_type) for r in got] == [(0, "multiple_choice"), (1, "freeform")]
    assert got[0].sample_id == "7" and got[1].sample_id.startswith("sha256-") and got[0].images[0].sha256 == hashlib.sha256(b"abc").hexdigest()
    path = str(tmp_path / "b.parquet")
    spark.createDataFrame(
        [("1", "What?", ["red", "blue"], "Blue "), ("2", "How?", [], "5")], "pid string, question string, choices array<string>, answer string",
    ).write.parquet(path)
    got = {r.sample_id: r for r in datasets.examples(spark, "mathvista", path).collect()}
    assert got["1"].ground_truth == "B" and got["1"].eval_question == "What?\nA. red\nB. blue" and got["2"].answer_type == "freeform"
    path = str(tmp_path / "c")
    spark.createDataFrame(
        [("x", "Q <image 1>", """['a, "b"', "it's"]""", "A", (b"1", None))],
        f"id string, question string, options string, answer string, image_1 {picture}",
    ).write.parquet(path)
    r = datasets.examples(spark, "mmmu_pro", path).first()
    assert r.eval_question == 'Q <image 1>\nA. a, "b"\nB. it\'s' and len(r.images) == 1
    with pytest.raises(KeyError):
        datasets.examples(spark, "other", path)
    assert spark.read.parquet(path).count() == 1 and datasets.source_hashes(spark, path, "*.parquet").count() >= 1

"""Folds, literals, long numbers, digests and pixels against Python and against worked examples."""

import ast
import hashlib
import random
import struct
import sys
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import digests, scoring
from tessera.sources import datasets, pixels
from tessera.value_queries import png


def values(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_folds_are_pythons(spark):
    everything = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and (chr(c).casefold() != chr(c) or c % 1013 == 0)]
    texts = ["Straße", "STRASSE", "ΣΊΣΥΦΟΣ", "ς", "İ", "ﬃ", "", None, "plain ASCII", "ŉ ΐ", *everything, "".join(everything)]
    assert values(spark, texts, T.casefold) == [t and t.casefold() for t in texts]


def test_folds_take_one_pass(spark):
    """No expression for each letter: the plan is small, so a text isn't searched for a hundred letters in turn."""
    df = spark.range(1).select(T.casefold(F.concat(F.col("id").cast("string"), F.lit("ẞ"))))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("replace(") == 0


@pytest.mark.parametrize("wanted", ["Straße", " STRASSE", "straße ", "STRAẞE"])
def test_filters_beyond_ascii(spark, wanted):
    df = spark.createDataFrame([(w,) for w in ("Straße", "STRASSE", "straße", "STRAẞE\u2003", "Strase", None)], "w string")
    assert [r.w.strip() for r in df.where(datasets.equals(df, {"w": wanted}, loose=True)).collect()] == ["Straße", "STRASSE", "straße", "STRAẞE"]


def test_literals_are_pythons(spark):
    rng = random.Random(2)

    def element(depth):
        kind = rng.randrange(8 if depth < 3 else 6)
        text = "".join(rng.choices("ab'\"\\\n\t é]),[#\x00☃😀", k=rng.randrange(6)))
        made = [
            lambda: repr(text), lambda: str(rng.randrange(-9, 10**20)), lambda: rng.choice(["None", "True", "False", "1e5", "0x1F", "-2.50", "1_000", "3+4j"]), lambda: repr(text) + " " + repr(text[::-1]),
            lambda: "b'x\\x00'", lambda: '"""' + text.translate({0: None, 34: None, 92: None}) + '"""', lambda: "[" + ", ".join(element(depth + 1) for _ in range(rng.randrange(3))) + "]",
            lambda: "{'k': " + element(depth + 1) + "}",
        ]
        return made[kind]()

    texts = [rng.choice(["[{}]", "({},)", " [{} , ]"]).format(", ".join(element(0) for _ in range(rng.randrange(1, 5)))) for _ in range(300)] + ["[]", "()"]
    assert values(spark, texts, datasets.literal_list) == [[str(x) for x in ast.literal_eval(t)] for t in texts]
    for other in ("not a list", "{'a'}", "'a'", "[f()]", "[1", "", None, "['a' + 'b']", "[" * 9000):
        with pytest.raises(Exception, match="options are no list"):
            values(spark, [other], datasets.literal_list)


def test_numbers_of_any_length(spark):
    """Products, fractions and rounding against whole numbers and fractions of Python."""
    rng = random.Random(4)
    digits = lambda n: str(rng.randrange(10 ** (n - 1), 10**n))
    pairs = [(digits(rng.choice([1, 5, 6, 7, 37, 60, 200])), digits(rng.choice([1, 6, 12, 90]))) for _ in range(60)] + [("", "12"), ("9" * 50, "9" * 50), ("1" + "0" * 40, "5")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", scoring.long_product(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in rows] == [str(int(a or 0) * int(b)).lstrip("0") for a, b in pairs]
    cases = []
    for _ in range(60):
        a, b, k = digits(rng.choice([3, 50])), digits(rng.choice([2, 30])), rng.randrange(2, 10**25)
        near = str(int(a) * k + rng.choice([0, 0, 1]))
        cases.append((f"{a}/{b}", f"{near}/{int(b) * k}", Fraction(int(a), int(b)) == Fraction(int(near), int(b) * k)))
        x, d = f"{rng.choice(['', '-'])}{digits(45)}.{digits(rng.choice([1, 3, 40]))}", rng.choice([1, 2, 39])
        scaled = abs(Fraction(x)) * 10**d
        whole = (scaled.numerator * 2 + scaled.denominator) // (2 * scaled.denominator) + rng.choice([0, 0, 1])
        gold = f"{'-' if x[0] == '-' else ''}{whole // 10**d}.{whole % 10**d:0{d}d}"
        cases.append((x, gold, whole == (scaled.numerator * 2 + scaled.denominator) // (2 * scaled.denominator)))
    cases += [("9" * 60 + ".96", "1" + "0" * 60 + ".0", True), ("-0.04", "0.0", True), ("1/3", "2/6", True), ("10" * 30, "10" * 30 + "0", False), ("5/0", "5", None)]
    rows = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(cases)], "i int, p string, g string")
    got = {r.i: r.v for r in rows.select("i", scoring.numeric_equal(F.col("p"), F.col("g")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_comparing_numbers_is_a_small_plan(spark):
    """Texts are cleaned in one pass each and compared by one function, whatever the numbers' kinds: no expression is written out for each case."""
    df = spark.range(1).select(scoring.numeric_equal(F.col("id").cast("string"), F.concat(F.col("id").cast("string"), F.lit("/7"))))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 5000
    long = "7" * 30000
    cases = [(f"{long}/{long}1", f"{long}0/{long}10", True), (f"-{long}.45", f"-{long}.5", True), (f"{long}.4", f"{long}.5", False), ("\\frac{ 1 }{ -.5}", "-2 cm", True), ("+5", "5", True), ("+1/2", "0.5", None), ("5.", "5", None), ("\\pi 5", "5", None)]
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, p string, g string")
    got = {r.i: r.v for r in rows.select("i", scoring.numeric_equal(F.col("p"), F.col("g")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_products_take_no_square_of_the_digits(spark):
    """Two numbers of 300,000 digits, whose digits' pairs would take days."""
    n = 300_000
    df = spark.createDataFrame([("9" * n, "9" * n), ("", None)], "a string, b string").select(scoring.long_product(F.col("a"), F.col("b")).alias("p"))
    assert [r.p for r in df.collect()] == ["9" * (n - 1) + "8" + "0" * (n - 1) + "1", None]


def test_digests_go_on_through_batches(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, None]), rng.randrange(40), rng.choice(["", "é", "x" * 500, "same"])) for _ in range(300)] + [(3, 1, None), (3, 2, "a")]
    df = spark.createDataFrame(rows, "value long, at int, v string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r[0]: r.digest for r in digests.ordered_digests(df, ["value"], "v", ["at"]).collect()}
        whole = digests.ordered_digests(df.where("v is not null"), [], "v", ["at", "value"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    framed = lambda vs: hashlib.sha256(b"".join(len(v.encode()).to_bytes(8, "big") + v.encode() for v in vs)).hexdigest()
    assert got == {k: framed(v for _, v in sorted(r[1:] for r in rows if r[0] == k)) for k in (1, 2, None)} | {3: None}
    ordered = sorted((r for r in rows if r[2] is not None), key=lambda r: (r[1], r[0] is not None, r[0] or 0, r[2]))
    assert [r.digest for r in whole] == [framed(r[2] for r in ordered)]
    assert digests.ordered_digests(df.limit(0), ["value"], "v", ["at"]).count() == 0


def test_a_digest_of_many_blocks_is_sorted_by_ranges(spark):
    """Two groups of a megabyte and more in rows of all sizes; no single task sorts a group's rows."""
    rng = random.Random(7)
    rows = [(i % 2, i, "xyz"[i % 3] * rng.choice([0, 1, 5000, 400_000])) for i in range(60)]
    made = digests.ordered_digests(spark.createDataFrame(rows, "value long, at int, v string").repartition(6), ["value"], "v", ["at"])
    framed = lambda k: b"".join(len(v).to_bytes(8, "big") + v.encode() for key, _, v in rows if key == k)
    assert {r.value: r.digest for r in made.collect()} == {k: hashlib.sha256(framed(k)).hexdigest() for k in (0, 1)}
    assert "rangepartitioning" in made._jdf.queryExecution().executedPlan().toString()


def over(rgb, a):
    return [round((c * a + 255 * (255 - a)) / 255) for c in rgb]


def test_pixels_of_all_colour_types():
    rng = np.random.default_rng(0)
    for height, width in ((1, 1), (7, 5), (9, 16)):
        grey, rgb, both, rgba = (rng.integers(0, 256, (height, width, n)) for n in (1, 3, 2, 4))
        assert (pixels.rgb_of(png(grey, 0)) == np.repeat(grey, 3, 2)).all()
        assert (pixels.rgb_of(png(rgb, 2)) == rgb).all()
        colours, alpha = rng.integers(0, 256, (200, 3)), rng.integers(0, 256, 150)
        index = rng.integers(0, 200, (height, width, 1))
        want = [[over(colours[k], alpha[k] if k < 150 else 255) for k in row] for row in index[..., 0]]
        assert (pixels.rgb_of(png(index, 3, colours.astype(np.uint8).tobytes(), alpha.astype(np.uint8).tobytes())) == want).all()
        assert (pixels.rgb_of(png(both, 4)) == [[over([g] * 3, a) for g, a in row] for row in both]).all()
        assert (pixels.rgb_of(png(rgba, 6)) == [[over(p[:3], p[3]) for p in row] for row in rgba]).all()


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def raw_png(width, height, depth, kind, lines, interlaced=0, more=b""):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, interlaced)) + more + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_depths_and_interlacing():
    assert pixels.rgb_of(raw_png(10, 1, 1, 0, b"\0\xa0\x40"))[0, :, 0].tolist() == [255, 0, 255, 0, 0, 0, 0, 0, 0, 255]
    assert pixels.rgb_of(raw_png(5, 1, 2, 0, b"\0\x1b\x80"))[0, :, 1].tolist() == [0, 85, 170, 255, 170]
    assert pixels.rgb_of(raw_png(3, 1, 4, 3, b"\0\x01\x20", more=chunk(b"PLTE", bytes(range(9)))))[0].tolist() == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    assert pixels.rgb_of(raw_png(1, 1, 16, 2, b"\0\x10\xff\x20\x00\x30\x80"))[0, 0].tolist() == [16, 32, 48]
    # interlaced: each place holds its own number in the order of the passes
    order = [[int(c) for c in row] for row in ("05152535", "66666666", "45454545", "66666666")]
    image = np.arange(64, dtype=np.uint8).reshape(8, 8)
    lines = b"".join(b"\0" + image[y, x::dx].tobytes() for x, y0, dx, dy in pixels.PASSES for y in range(y0, 8, dy))
    assert (pixels.rgb_of(raw_png(8, 8, 8, 0, lines, 1))[..., 0] == image).all() and len(order) == 4
    small = image[:3, :2]
    lines = b"".join(b"\0" + small[y, x::dx].tobytes() for x, y0, dx, dy in pixels.PASSES if x < 2 for y in range(y0, 3, dy))
    assert (pixels.rgb_of(raw_png(2, 3, 8, 0, lines, 1))[..., 2] == small).all()


def packed_codes(data):
    """Codes of 9 bits for 8-bit data, cleared often enough that they never grow."""
    bits, n, out = 0, 0, []
    for k, byte in enumerate(data):
        out += [256, byte] if k % 100 == 0 else [byte]
    for code in [*out, 257]:
        bits |= code << n
        n += 9
    body = bits.to_bytes(-(-n // 8), "little")
    return b"\x08" + b"".join(bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)) + b"\0"


def test_gif_and_bmp():
    rng = np.random.default_rng(3)
    colours, frame = rng.integers(0, 256, (256, 3)).astype(np.uint8), rng.integers(0, 256, (9, 20)).astype(np.uint8)
    head = b"GIF89a" + struct.pack("<HHBBB", 22, 10, 0xF7, 0, 0) + colours.tobytes()
    control = b"\x21\xf9\x04\x01\x00\x00" + bytes([frame[0, 0]]) + b"\0"
    place = b"\x2c" + struct.pack("<HHHHB", 1, 1, 20, 9, 0)
    want = np.full((10, 22, 3), 255)
    want[1:, 1:21] = np.where((frame == frame[0, 0])[..., None], 255, colours[frame])
    assert (pixels.rgb_of(head + control + place + packed_codes(frame.ravel().tolist()) + b";") == want).all()
    rows = [*range(0, 9, 8), *range(4, 9, 8), *range(2, 9, 4), *range(1, 9, 2)]
    woven = b"\x2c" + struct.pack("<HHHHB", 1, 1, 20, 9, 0x40)
    assert (pixels.rgb_of(head + control + woven + packed_codes(frame[rows].ravel().tolist()) + b";") == want).all()
    # codes that grow, and one that is used where it is made
    assert pixels._unpacked(bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01]), 2, 100) == bytearray(
        int(c) for c in "1111122222" "1111122222" "1111122222" "1110000222" "1110000222" "2220000111" "2220000111" "2222211111" "2222211111" "2222211111"
    )
    bgr = rng.integers(0, 256, (3, 5, 3)).astype(np.uint8)
    body = b"".join(row.tobytes() + b"\0" for row in bgr[::-1])
    bmp = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, 5, 3, 1, 24, 0, 0, 0, 0, 0, 0) + body
    assert (pixels.rgb_of(bmp) == bgr[..., ::-1]).all()


def test_broken_images_are_errors(spark):
    good = png(np.zeros((4, 4, 3), int), 2)
    broken = [b"", b"x", good[:-20], good[:40] + b"\0" + good[41:], good.replace(b"IDAT", b"IDAX"), b"\xff\xd8\xff\xe0", b"GIF89a" + b"\0" * 20, b"BM" + b"\0" * 60, raw_png(9, 9, 8, 2, b"\0\0"), raw_png(1 << 20, 1 << 20, 8, 2, b"")]
    for data in broken:
        with pytest.raises(pixels.Undecodable):
            pixels.rgb_of(data)
    df = spark.createDataFrame([(good,), (None,)], "image binary").select(pixels.decoded(F.col("image")).alias("d"))
    assert sorted((r.d and (r.d.width, r.d.height, len(r.d.rgb)) or ()) for r in df.collect()) == [(), (4, 4, 48)]
    with pytest.raises(Exception, match="Undecodable"):
        spark.createDataFrame([(b"x",)], "image binary").select(pixels.decoded(F.col("image"))).collect()


def test_image_files(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 256, (6, 5, 3))
    (tmp_path / "a.png").write_bytes(png(image, 2))
    rows = pixels.decoded_files(spark, str(tmp_path)).collect()
    assert [(r.width, r.height) for r in rows] == [(5, 6)] and bytes(rows[0].rgb) == image.astype(np.uint8).tobytes()
    (tmp_path / "b.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="no image"):
        pixels.decoded_files(spark, str(tmp_path)).collect()

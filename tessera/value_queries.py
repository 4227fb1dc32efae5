"""Queries of folds, literals, long numbers, digests and pixels over the driver's tables, and the same in SQL; they register with :mod:`tessera.queries`."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import times
from tessera.operators import digests, scoring
from tessera.queries import query
from tessera.session import in_arrow, read_table
from tessera.sources import datasets, pixels

# ---- folds -----------------------------------------------------------------------------------------

#: Letters of the texts that are swapped for ones with folds of their own: sharp s, sigma, dotted capital i, a ligature.
_SWAPPED = {"s": "ß", "o": "Σ", "i": "İ", "t": "ﬆ", "u": "ς", "R": "ẞ"}
_SWAPS_SQL = "text"
for _a, _b in _SWAPPED.items():
    _SWAPS_SQL = f"replace({_SWAPS_SQL}, '{_a}', '{_b}')"
#: The folds of these, then of all other letters, which have one small letter each.
_FOLD_SQL = "lower(replace(replace(replace(replace(replace({0}, 'ß', 'ss'), 'ẞ', 'ss'), 'ﬆ', 'st'), 'İ', 'i̇'), 'ς', 'σ'))"


def _swapped(text):
    return F.translate(text, "".join(_SWAPPED), "".join(_SWAPPED.values()))


@query(f"SELECT doc_id, sha256({_FOLD_SQL.format(_SWAPS_SQL)}) AS folded FROM documents")
def folded_texts(spark, sf_dir):
    """Whole texts with letters that change in number when they are folded."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(T.casefold(_swapped(F.col("text"))), 256).alias("folded"))


@query(f"""WITH a AS (SELECT doc_id, {_SWAPS_SQL.replace('text', "split_part(text, ' ', 1)")} AS word FROM documents),
f AS (SELECT *, {_FOLD_SQL.format("trim(word, ' ' || chr(10) || chr(9) || chr(13))")} AS folded FROM a) SELECT doc_id, word FROM f WHERE folded IN ('is', 'es', 'isst', 'i̇ss', 'σr', 'ess', 'sste', 'i̇n', 'στ')""")
def folded_filter(spark, sf_dir):
    """The loose filter of a reader against words written otherwise: capitals, sharp s for two letters, spaces around."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", _swapped(F.element_at(F.split("text", " "), 1)).alias("word"))
    wanted = (" İSS", "eß ", "IS", "es", "İN", "ΣR", "Στ", "ßTE", "iẞt")
    same = [datasets.equals(docs, {"word": w}, loose=True) for w in wanted]
    found = same[0]
    for s in same[1:]:
        found = found | s
    return docs.where(found)


# ---- literals --------------------------------------------------------------------------------------


@query("""SELECT doc_id, [text, lang || 'x''"', CAST(doc_id AS VARCHAR), 'None', '[' || doc_id || ', ' || chr(39) || lang || chr(39) || ']', source || lang, CASE WHEN doc_id % 7 = 0 THEN 'True' ELSE 'False' END] AS options FROM documents""")
def literal_options(spark, sf_dir):
    """Whole texts, numbers, nothing, nested lists, adjacent texts and truths in lists as Python writes them; a tuple for odd numbers."""
    docs = read_table(spark, sf_dir, "documents")
    escaped = F.replace(F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\x0d"))
    escaped = F.replace(F.regexp_replace(escaped, "é", r"\\u00e9"), F.lit("\x00"), F.lit("\\0"))
    number, q = F.col("doc_id").cast("string"), F.lit("'")
    parts = F.concat(
        q, escaped, F.lit("', \""), F.col("lang"), F.lit("x'\\x22\" , "), number, F.lit(", None,\n ["), number, F.lit(", '"), F.col("lang"), F.lit("'], '"), F.col("source"), F.lit("' \""), F.col("lang"), F.lit('", '),
        F.when(F.col("doc_id") % 7 == 0, "True").otherwise("False"),
    )
    odd = F.col("doc_id") % 2 == 1
    written = F.concat(F.when(odd, "(").otherwise("["), parts, F.when(odd, ",)").otherwise("]"))
    return docs.select("doc_id", datasets.literal_list(written).alias("options"))


# ---- numbers of any length -------------------------------------------------------------------------

_DIGITS_SQL = "regexp_replace(CAST(o_orderkey AS VARCHAR) || repeat(CAST(o_custkey + 7 AS VARCHAR), 9) || o_orderkey, '^0+', '')"


@query(f"""WITH a AS (SELECT o_orderkey, {_DIGITS_SQL} AS d, (o_custkey % 997 + 3)::HUGEINT AS f FROM orders),
l AS (SELECT o_orderkey, f, unnest(range(0, (len(d) + 8) // 9)) AS i, d FROM a),
m AS (SELECT o_orderkey, i, f * CAST(d[greatest(1, len(d) - 9 * i - 8) : len(d) - 9 * i] AS HUGEINT) AS x FROM l),
c AS (SELECT o_orderkey, list(x ORDER BY i) AS xs FROM m GROUP BY o_orderkey),
s AS (SELECT o_orderkey, list_reduce(xs, lambda s, x, k: s || [(s[-1] // 1000000000 + x)::HUGEINT][1:1], [0::HUGEINT]) AS w FROM (SELECT o_orderkey, list_transform(xs, lambda x: x::HUGEINT) AS xs FROM c))
SELECT o_orderkey, regexp_replace(CAST(w[-1] AS VARCHAR) || array_to_string(list_transform(list_reverse(w[2:-2]), lambda x: lpad(CAST(x % 1000000000 AS VARCHAR), 9, '0')), ''), '^0+', '') AS product FROM s""")
def long_products(spark, sf_dir):
    """Products of numbers of 40 digits and more by numbers that SQL multiplies limb by limb."""
    number = F.regexp_replace(F.concat(F.col("o_orderkey").cast("string"), F.repeat((F.col("o_custkey") + 7).cast("string"), 9), F.col("o_orderkey").cast("string")), "^0+", "")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", scoring.long_product(number, (F.col("o_custkey") % 997 + 3).cast("string")).alias("product"))


@query(f"""WITH a AS (SELECT o_orderkey, {_DIGITS_SQL} AS d, o_orderkey % 10 AS last FROM orders)
SELECT o_orderkey, last >= 5 AS up, o_orderkey % 2 = 0 AS same_fraction, TRUE AS nines FROM a""")
def long_numbers(spark, sf_dir):
    """Answers of over 37 digits: rounding in the last place, equal fractions written otherwise, and a carry through nines only."""
    key = F.col("o_orderkey")
    number = F.regexp_replace(F.concat(key.cast("string"), F.repeat((F.col("o_custkey") + 7).cast("string"), 9), key.cast("string")), "^0+", "")
    # the number with a decimal place 0 and then its last digit: rounded to one place it is .1 from 5 on
    said, truth = F.concat(number, F.lit(".0"), (key % 10).cast("string")), F.concat(number, F.lit(".1"))
    doubled = F.concat(scoring.long_product(number, F.lit("2")), F.lit("/"), F.lit("14"))
    other = F.when(key % 2 == 0, F.concat(number, F.lit("/7"))).otherwise(F.concat(number, F.lit("1/7")))
    nines = F.concat(F.repeat(F.lit("9"), 40 + (key % 9).cast("int")), F.lit(".97"))
    one = F.concat(F.lit("1"), F.repeat(F.lit("0"), 40 + (key % 9).cast("int")), F.lit(".0"))
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", scoring.numeric_equal(said, truth).alias("up"), scoring.numeric_equal(doubled, other).alias("same_fraction"),
        scoring.numeric_equal(nines, one).alias("nines"),
    )


# ---- digests ---------------------------------------------------------------------------------------


@query("""SELECT l_orderkey % 3 AS part, sha256(unhex(string_agg(lpad(hex(octet_length(encode(v))), 16, '0') || hex(encode(v)), '' ORDER BY l_orderkey, l_linenumber, v))) AS digest
FROM (SELECT l_orderkey, l_linenumber, l_partkey || ':' || l_returnflag AS v FROM lineitem) GROUP BY l_orderkey % 3""")
def streamed_digests(spark, sf_dir):
    """Three groups that hold all lines: a group streams through a hash state, whatever its size."""
    items = read_table(spark, sf_dir, "lineitem")
    rows = items.select((F.col("l_orderkey") % 3).alias("part"), "l_orderkey", "l_linenumber", F.concat_ws(":", "l_partkey", "l_returnflag").alias("v"))
    return digests.ordered_digests(rows, ["part"], "v", ["l_orderkey", "l_linenumber"])


# ---- pixels ----------------------------------------------------------------------------------------


def png(samples: np.ndarray, kind: int, palette: bytes = b"", alpha: bytes = b"", filters: tuple[int, ...] = (0, 1, 2, 3, 4)) -> bytes:
    """A PNG file of 8-bit samples (height, width, channels); its rows take the filters in turn."""
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    height, width, step = samples.shape
    rows, lines = samples.reshape(height, -1).astype(int), b""
    before = np.zeros(width * step, int)
    for y, row in enumerate(rows):
        left = np.r_[np.zeros(step, int), row[:-step]]
        corner = np.r_[np.zeros(step, int), before[:-step]]
        guess = left + before - corner
        far = np.abs(np.stack([guess - left, guess - before, guess - corner]))
        nearest = np.choose(far.argmin(0), [left, before, corner])
        kind_ = filters[y % len(filters)]
        lines += bytes([kind_]) + ((row - [0, left, before, (left + before) // 2, nearest][kind_]) % 256).astype(np.uint8).tobytes()
        before = row
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0))
    body += (chunk(b"PLTE", palette) if palette else b"") + (chunk(b"tRNS", alpha) if alpha else b"")
    return b"\x89PNG\r\n\x1a\n" + body + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as images of 8 rows, in all colour types by turns."""
    kinds = ((0, 1), (2, 3), (3, 1), (4, 2), (6, 4))
    grey = bytes(255 - k // 3 for k in range(768))  # colour k is k times darker than white
    for batch in batches:
        made = []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            kind, channels = kinds[i % 5]
            samples = (np.floor(np.abs(np.array(v, np.float64)) * 1000) % 256).astype(np.uint8)
            samples = samples[: 64 // (8 * channels) * 8 * channels].reshape(8, -1, channels)
            made.append(png(samples, kind, grey if kind == 3 else b""))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["vec_id", "image"])


@query("""WITH p AS (SELECT vec_id, [0, 1, 2, 3, 4][vec_id % 5 + 1] AS kind, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 256) AS s FROM embeddings),
w AS (SELECT *, CASE kind WHEN 0 THEN 8 WHEN 1 THEN 2 WHEN 2 THEN 8 WHEN 3 THEN 4 ELSE 2 END AS width, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 4 END AS n FROM p),
c AS (SELECT vec_id, width, kind, s, n, unnest(range(0, 8 * width)) AS i FROM w),
x AS (SELECT vec_id, width, i, CASE kind WHEN 0 THEN [s[i + 1]] WHEN 1 THEN s[3 * i + 1 : 3 * i + 3] WHEN 2 THEN [255 - s[i + 1]]
  WHEN 3 THEN [(s[2 * i + 1] * s[2 * i + 2] + 255 * (255 - s[2 * i + 2]) + 127) // 255] ELSE list_transform(s[4 * i + 1 : 4 * i + 3], lambda v: (v * s[4 * i + 4] + 255 * (255 - s[4 * i + 4]) + 127) // 255) END AS v FROM c)
SELECT vec_id, CAST(max(width) AS INTEGER) AS width, 8 AS height, sha256(unhex(string_agg(array_to_string(list_transform(CASE len(v) WHEN 1 THEN [v[1], v[1], v[1]] ELSE v END, lambda b: lpad(hex(b), 2, '0')), ''), '' ORDER BY i))) AS pixels FROM x GROUP BY vec_id""")
def decoded_images(spark, sf_dir):
    """Digests of the pixels of PNG files in all colour types, with all filters; transparency over white."""
    drawn = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding").transform(in_arrow, _drawn, "vec_id long, image binary")
    made = pixels.decoded(F.col("image"))
    return drawn.withColumn("made", made).select("vec_id", "made.width", "made.height", F.sha2("made.rgb", 256).alias("pixels"))


# ---- rules of answers over planted texts -----------------------------------------------------------

_BRACES_SQL = r"replace(replace(replace(text, 'o', '{'), 'e', '}'), 'th', '\boxed{')"


@query(rf"""WITH a AS (SELECT conv_id, turn, {_BRACES_SQL} AS said FROM conversations), r AS (SELECT conv_id, turn, string_split(said, '\boxed{{')[-1] AS rest FROM a WHERE contains(said, '\boxed{{')),
c AS (SELECT conv_id, turn, rest, unnest(string_split(rest, '')) AS ch, generate_subscripts(string_split(rest, ''), 1) AS i FROM r),
d AS (SELECT *, 1 + sum(CASE ch WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS depth FROM c),
e AS (SELECT conv_id, turn, any_value(rest) AS rest, min(i) FILTER (depth = 0) AS stop FROM d GROUP BY conv_id, turn)
SELECT a.conv_id, a.turn, CASE WHEN stop IS NOT NULL THEN trim(rest[: stop - 1], ' ' || chr(10) || chr(9) || chr(13)) END AS boxed FROM a LEFT JOIN e ON e.conv_id = a.conv_id AND e.turn = a.turn""")
def boxed_braces(spark, sf_dir):
    """The last box of texts whose letters are made boxes and braces, nested and unclosed as they fall."""
    said = F.replace(F.replace(F.replace("text", F.lit("o"), F.lit("{")), F.lit("e"), F.lit("}")), F.lit("th"), F.lit("\\boxed{"))
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", T.boxed(said).alias("boxed"))


@query("""WITH a AS (SELECT p_partkey, (p_partkey * 7919 + p_size * 104729) % 2000001 - 1000000 AS p, p_partkey % 2 + 1 AS d, p_size % 5 - 2 AS off FROM part),
r AS (SELECT *, CAST(10 ** (3 - d) AS BIGINT) AS unit FROM a), g AS (SELECT *, sign(p) * ((2 * abs(p) + unit) // (2 * unit)) AS near FROM r)
SELECT p_partkey, off = 0 AS same FROM g""")
def rounded_numbers(spark, sf_dir):
    """Numbers of three places against truths of one or two, which are the rounded number or a few units off; half goes away from zero."""
    number, d = (F.col("p_partkey") * 7919 + F.col("p_size") * 104729) % 2000001 - 1000000, F.col("p_partkey") % 2 + 1
    unit = F.when(d == 1, 100).otherwise(10)
    near = F.signum(number).cast("long") * F.call_function("div", F.abs(number) * 2 + unit, unit * 2) + F.col("p_size") % 5 - 2
    places = lambda n, k: F.concat(F.when(n < 0, "-").otherwise(""), F.call_function("div", F.abs(n), k).cast("string"), F.lit("."), F.lpad((F.abs(n) % k).cast("string"), (F.length(k.cast("string")) - 1), F.lit("0")))
    predicted, truth = places(number, F.lit(1000)), places(near, F.when(d == 1, 10).otherwise(100))
    return read_table(spark, sf_dir, "part").select("p_partkey", scoring.numeric_equal(predicted, truth).alias("same"))


#: Ends of lines by turns: numbers that are stated, and some that aren't.
_STATED = ("the Answer is {0},{0}.5", "RESULT = -{0}", "the value of it is {0}/7", "answers are {0}", "value: {0} then result: {0}.25", "the result  is\t+{0} / 3,000")


@query(r"""WITH a AS (SELECT conv_id, turn, replace(replace(text, '.', ','), '!', ',') || chr(10) || CASE conv_id % 6 WHEN 0 THEN 'the Answer is ' || (turn + 11) || ',' || (turn + 11) || '.5' WHEN 1 THEN 'RESULT = -' || (turn + 11) WHEN 2 THEN 'the value of it is ' || (turn + 11) || '/7'
WHEN 3 THEN 'answers are ' || (turn + 11) WHEN 4 THEN 'value: ' || (turn + 11) || ' then result: ' || (turn + 11) || '.25' ELSE 'the result  is' || chr(9) || '+' || (turn + 11) || ' / 3,000' END AS said FROM conversations),
l AS (SELECT conv_id, turn, string_split(said, chr(10))[-1] AS line FROM a)
SELECT conv_id, turn, nullif(regexp_replace(regexp_extract(line, '(?i)(?:answer|result|value\b[^.]{0,20}?)\s+(?:is|=|:)\s*([-+]?[0-9,]+(?:\.[0-9]+)?(?:\s*/\s*[0-9,]+(?:\.[0-9]+)?)?)', 1), '[,\s]', '', 'g'), '') AS number FROM l""")
def stated_numbers(spark, sf_dir):
    """The number that the last line of a text states, in any case and spacing, or none."""
    n = (F.col("turn") + 11).cast("string")
    kinds = [F.replace(F.lit(s), F.lit("{0}"), n) for s in _STATED]
    end = kinds[-1]
    for k, s in enumerate(kinds[:-1]):
        end = F.when(F.col("conv_id") % 6 == k, s).otherwise(end)
    said = F.concat(F.translate("text", ".!", ",,"), F.lit("\n"), end)
    found = scoring.freeform(said, F.lit(""))
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", found["extracted"].alias("number"))


# ---- times -----------------------------------------------------------------------------------------


@query(r"""WITH m AS (SELECT *, regexp_full_match(raw, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?(Z|[+-][0-9]{2}(:?[0-9]{2})?)') AS zoned FROM stamps),
t AS (SELECT *, try_strptime(raw[1:10] || ' ' || CASE WHEN raw[17] = ':' THEN raw[12:19] ELSE raw[12:16] || ':00' END, '%Y-%m-%d %H:%M:%S') AS local, regexp_extract(raw[17:], '([+-])([0-9]{2}):?([0-9]{2})?$', ['sign', 'h', 'm']) AS o FROM m WHERE zoned),
u AS (SELECT stamp_id, source, local - to_minutes(CASE WHEN o.sign = '-' THEN -1 ELSE 1 END * (coalesce(try_cast(o.h AS INTEGER), 0) * 60 + coalesce(try_cast(o.m AS INTEGER), 0))) AS utc FROM t)
SELECT stamp_id, source, epoch_us(utc) AS micros, strftime(utc, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS written, utc IS NULL AS refused FROM u
UNION ALL SELECT stamp_id, source, NULL, NULL, raw IS NOT NULL FROM m WHERE zoned IS NOT TRUE""")
def zoned_times(spark, sf_dir):
    """Instants of texts that tell their zone; others are refused."""
    at = times.instant(F.col("raw"))
    return read_table(spark, sf_dir, "stamps").select(
        "stamp_id", "source", F.unix_micros(at).alias("micros"), times.iso(at).alias("written"), (F.col("raw").isNotNull() & at.isNull()).alias("refused"),
    )

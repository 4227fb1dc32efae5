"""The 31 probability metrics of a token from its raw logits, in three forms with one result.

:func:`native` is array expressions in the JVM, without a shuffle, for small vocabularies;
:func:`arrow` is a NumPy kernel over Arrow batches, for large ones; :func:`exploded` is rows and
windows, the form that SQL can check. Logits must be at least two, without nulls, NaN and +Inf, and
not all -Inf, and the selected index among them; other rows get ``metrics_valid`` false, a reason,
and nulls. Undefined values are null, infinite ones are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from tessera.schema import PROBABILITY_FLOATS, PROBABILITY_INTEGERS, PROBABILITY_METRICS
from tessera.session import in_arrow

REASON = "invalid_probability_logits"
MASSES, NUCLEI = (2, 5, 10, 20), {"0p9": 0.9, "0p95": 0.95, "0p99": 0.99}
INF = float("inf")


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def _ln(x: Column) -> Column:
    """Natural logarithm with -Inf at 0, for which Spark's gives null."""
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(-INF))


def is_valid(logits: Column, selected: Column) -> Column:
    sound = F.forall(logits, lambda x: F.coalesce(~F.isnan(x) & (x < INF), F.lit(False))) & F.exists(logits, lambda x: x > -INF)
    return F.coalesce((F.size(logits) >= 2) & sound & (selected >= 0) & (selected < F.size(logits)), F.lit(False))


def native(df: DataFrame, logits: str = "logits", selected: str = "selected", metrics=PROBABILITY_METRICS) -> DataFrame:
    """``df`` without its logits, with ``metrics_valid``, ``invalid_reason`` and the metrics asked for."""
    keep = [c for c in df.columns if c != logits]
    z = F.col(logits).cast("array<double>")
    rows = df.withColumn("_ok", is_valid(z, F.col(selected))).withColumn("_z", F.when(F.col("_ok"), z)).withColumn("_j", F.col(selected).cast("int"))
    rows = rows.withColumn("_m", F.array_max("_z")).withColumn(
        "_lse", F.col("_m") + F.ln(F.aggregate("_z", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_m")))),
    )
    rows = rows.withColumn("_lp", F.transform("_z", lambda x: x - F.col("_lse")))
    rows = rows.withColumn("_slp", F.sort_array("_lp", asc=False)).withColumn("_l", F.try_element_at("_lp", F.col("_j") + 1))
    rows = rows.withColumn("_s", F.transform("_slp", lambda x: F.exp(x)))
    rows = rows.withColumn("_h", F.aggregate("_lp", F.lit(0.0), lambda s, x: s + F.when(x > -INF, F.exp(x) * x).otherwise(0.0)))
    made = _native_metrics()
    return rows.select(*keep, F.col("_ok").alias("metrics_valid"), F.when(~F.col("_ok"), REASON).alias("invalid_reason"), *[made[m].alias(m) for m in metrics])


def _native_metrics() -> dict[str, Column]:
    lp, slp, s, h, l, n = F.col("_lp"), F.col("_slp"), F.col("_s"), F.col("_h"), F.col("_l"), F.size("_lp").cast("double")
    above = F.size(F.filter(lp, lambda x: x > l))
    first, next_ = F.try_element_at(slp, F.lit(1)), F.try_element_at(slp, F.lit(2))
    rank = F.when(F.col("_ok"), above + 1)

    def renyi(a: float) -> Column:
        return (a * first + F.ln(F.aggregate(lp, F.lit(0.0), lambda t, x: t + F.exp(a * (x - first))))) / (a - 1)

    def mixed(x: Column) -> Column:  # ln of half the sum of p and the uniform rate
        u = -F.ln(n)
        hi, lo = F.greatest(x, u), F.least(x, u)
        return hi + F.log1p(F.exp(lo - hi)) - math.log(2)

    u = -F.ln(n)
    half_p = F.aggregate(lp, F.lit(0.0), lambda t, x: t + F.when(x > -INF, F.exp(x) * (x - mixed(x))).otherwise(0.0))
    half_u = F.aggregate(lp, F.lit(0.0), lambda t, x: t + (u - mixed(x)) / n)
    masses = {k: _total(F.slice(s, 1, k)) for k in MASSES}

    def nucleus(q: float) -> Column:
        # how many sorted rates come before the running sum reaches q
        start = F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("k"))
        return F.aggregate(
            s, start, lambda a, x: F.when(a["c"] >= q, a).otherwise(F.struct((a["c"] + x).alias("c"), (a["k"] + 1).alias("k"))), lambda a: a["k"],
        )

    made = {
        "logp": l, "kl_u_p": u - _total(lp) / n, "kl_p_u": F.ln(n) + h, "gini": F.aggregate(lp, F.lit(0.0), lambda t, x: t + F.exp(2 * x)), "entropy": h,
        "dist_perplexity": -F.exp(-h), "inverse_perplexity": F.exp(h), "max_prob": F.try_element_at(s, F.lit(1)), "margin_top2": F.try_element_at(s, F.lit(1)) - F.try_element_at(s, F.lit(2)),
        "log_ratio_margin_top2": first - next_, "selected_dominance": l - F.array_max(F.filter(lp, lambda x, i: i != F.col("_j"))), "selected_logrank": -F.ln(rank.cast("double")),
        **{f"topk_mass_{k}": m for k, m in masses.items()}, **{f"tail_mass_{k}": m - 1 for k, m in masses.items()}, "norm_entropy_concentration": 1 + h / F.ln(n),
        "renyi_entropy_0p5": renyi(0.5), "renyi_entropy_1": h, "renyi_entropy_2": renyi(2.0), "renyi_entropy_4": renyi(4.0), "renyi_entropy_inf": first,
        "js_p_u": F.sqrt(F.greatest(F.lit(0.0), (half_p + half_u) / 2)), "selected_rank": -rank, **{f"nucleus_size_{k}": -nucleus(q) for k, q in NUCLEI.items()},
    }
    return {k: F.when(F.col("_ok"), v) for k, v in made.items()}


#: Logits of a block of the kernel, which stay in a core's cache; up to so many a row, whole rows are sorted.
BLOCK, SORTED = 1 << 18, 4096


def kernel(z: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
    """All metrics of valid rows of logits of one length, some rows at a time."""
    step = max(1, BLOCK // z.shape[1])
    parts = [_kernel(z[a : a + step], j[a : a + step]) for a in range(0, len(z), step)]
    return {m: np.concatenate([p[m] for p in parts]) for m in parts[0]}


def _reached(p: np.ndarray) -> dict[str, np.ndarray]:
    """How many of the greatest rates together reach each nucleus; all of them where rounding keeps the sum below it.

    In a long row only rates from 1 % of the uniform one on are sorted: all others together have less than
    1 %, so the greatest nucleus is reached without them. Where rounding spoils that, the whole row is.
    """
    n = p.shape[1]
    if n <= SORTED:
        c = np.cumsum(-np.sort(-p, axis=1), axis=1)
        return {k: np.where((c >= q).any(1), (c >= q).argmax(1) + 1, n) for k, q in NUCLEI.items()}
    out = {k: np.empty(len(p), np.int64) for k in NUCLEI}
    for i, row in enumerate(p):
        c = np.cumsum(np.sort(row[row >= (1 - max(NUCLEI.values())) / n])[::-1])
        if not len(c) or c[-1] < max(NUCLEI.values()):
            c = np.cumsum(np.sort(row)[::-1])
        for k, q in NUCLEI.items():
            out[k][i] = min(np.searchsorted(c, q) + 1, n)
    return out


def _kernel(z: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
    with np.errstate(divide="ignore", invalid="ignore"):
        n, rows = z.shape[1], np.arange(len(z))
        lp = z - z.max(1, keepdims=True)
        e = np.exp(lp)  # rates relative to the greatest
        sums = e.sum(1, keepdims=True)
        lp -= np.log(sums)
        p = e / sums
        most = min(max(MASSES), n)
        slp = -np.sort(-(np.partition(lp, n - most, axis=1)[:, n - most :] if most < n else lp), axis=1)
        s = np.exp(slp)
        c = np.cumsum(s, axis=1)
        finite = lp if np.isfinite(lp.min()) else np.where(p > 0, lp, 0.0)
        h, u, l = (p * finite).sum(1), -math.log(n), lp[rows, j]
        rank = 1 + np.count_nonzero(lp > l[:, None], axis=1)
        powers = {0.5: np.sqrt(e).sum(1)}
        e *= e
        powers[2.0] = e.sum(1)
        e *= e
        powers[4.0] = e.sum(1)
        renyi = lambda a: (a * slp[:, 0] + np.log(powers[a])) / (a - 1)
        mix = np.log(p + 1 / n) - math.log(2)
        js = ((p * (finite - mix)).sum(1) + (u - mix).sum(1) / n) / 2
        mass = {k: c[:, min(k, n) - 1] for k in MASSES}
        return {
            "logp": l, "kl_u_p": u - lp.mean(1), "kl_p_u": -u + h, "gini": (p * p).sum(1), "entropy": h, "dist_perplexity": -np.exp(-h), "inverse_perplexity": np.exp(h), "max_prob": s[:, 0],
            "margin_top2": s[:, 0] - s[:, 1], "log_ratio_margin_top2": slp[:, 0] - slp[:, 1], "selected_dominance": l - np.where(l == slp[:, 0], slp[:, 1], slp[:, 0]), "selected_logrank": -np.log(rank),
            **{f"topk_mass_{k}": m for k, m in mass.items()}, **{f"tail_mass_{k}": m - 1 for k, m in mass.items()}, "norm_entropy_concentration": 1 + h / math.log(n),
            "renyi_entropy_0p5": renyi(0.5), "renyi_entropy_1": h, "renyi_entropy_2": renyi(2.0), "renyi_entropy_4": renyi(4.0), "renyi_entropy_inf": slp[:, 0],
            "js_p_u": np.sqrt(np.maximum(js, 0)), "selected_rank": -rank, **{f"nucleus_size_{k}": -r for k, r in _reached(p).items()},
        }


#: Logits that the kernel works on at once; bounds its memory for any vocabulary.
CELLS = 4_000_000


def arrow(df: DataFrame, logits: str = "logits", selected: str = "selected") -> DataFrame:
    """As :func:`native` with all metrics, by the NumPy kernel; other columns pass through."""
    keep = [c for c in df.columns if c != logits]
    fields = [df.schema[c] for c in keep] + [StructField("metrics_valid", BooleanType()), StructField("invalid_reason", StringType())]
    fields += [StructField(m, DoubleType()) for m in PROBABILITY_FLOATS] + [StructField(m, IntegerType()) for m in PROBABILITY_INTEGERS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            longest = int(np.diff(whole.column(0).offsets.to_numpy()).max(initial=1))
            step = max(1, CELLS // max(longest, 1))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                lists, begins = batch.column(0), batch.column(0).offsets.to_numpy()
                values, lengths = lists.values.to_numpy(zero_copy_only=False), np.diff(begins)  # nulls are NaN
                picks = pc.fill_null(batch.column(1), -1).to_numpy(zero_copy_only=False)
                sound = lists.is_valid().to_numpy(zero_copy_only=False) & (lengths >= 2) & (picks >= 0) & (picks < lengths)
                valid = np.zeros(batch.num_rows, bool)
                out = {m: np.zeros(batch.num_rows) for m in PROBABILITY_METRICS}
                for n in np.unique(lengths[sound]).tolist():
                    index = np.flatnonzero(sound & (lengths == n))
                    whole_rows = len(index) == batch.num_rows
                    z = values[begins[0] : begins[-1]].reshape(-1, n) if whole_rows else values[begins[index][:, None] + np.arange(n)]
                    low, high = z.min(1), z.max(1)  # NaN if there is one
                    ok = (high < np.inf) & (high > -np.inf) & ~np.isnan(low)
                    z, index = (z, index) if ok.all() else (z[ok], index[ok])
                    valid[index] = True
                    if len(index):
                        for m, found in kernel(z, picks[index]).items():
                            out[m][index] = found
                made = [pa.array(out[m], mask=~valid) for m in PROBABILITY_FLOATS] + [pa.array(out[m].astype(np.int32), mask=~valid) for m in PROBABILITY_INTEGERS]
                reasons = pa.array([None if v else REASON for v in valid], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(valid), reasons, *made], names=[f.name for f in fields])

    rows = df.select(F.col(logits).cast("array<double>").alias("_z"), F.col(selected).cast("int").alias("_j"), *keep)
    return rows.transform(in_arrow, run, StructType(fields))


def exploded(df: DataFrame, key: list[str], logits: str = "logits", selected: str = "selected") -> DataFrame:
    """Rank-based metrics from a row for each logit: one shuffle by ``key``, which must be unique; invalid rows are left out."""
    z = F.col(logits).cast("array<double>")
    rows = df.where(is_valid(z, F.col(selected))).select(*key, F.col(selected).alias("_j"), F.posexplode(z).alias("_i", "_z"))
    whole = Window.partitionBy(*key)
    down = whole.orderBy(F.desc("_z"), "_i")
    rows = rows.withColumn("_m", F.max("_z").over(whole)).withColumn(
        "_lp", F.col("_z") - F.col("_m") - F.ln(F.sum(F.exp(F.col("_z") - F.col("_m"))).over(whole)),
    )
    rows = rows.withColumn("_p", F.exp("_lp")).withColumn("_r", F.row_number().over(down)).withColumn("_rank", F.rank().over(whole.orderBy(F.desc("_z"))))
    rows = rows.withColumn("_c", F.sum("_p").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    picked = F.col("_i") == F.col("_j")
    aggregates = [
        F.max(F.when(picked, F.col("_lp"))).alias("logp"), F.sum(F.col("_p") * F.col("_p")).alias("gini"), F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.col("_lp")).otherwise(0.0)).alias("entropy"),
        F.max("_p").alias("max_prob"), (-F.max(F.when(picked, F.col("_rank")))).alias("selected_rank"),
        *[F.sum(F.when(F.col("_r") <= k, F.col("_p"))).alias(f"topk_mass_{k}") for k in MASSES],
        *[(-F.least(F.count(F.lit(1)), F.sum(F.when(F.col("_c") < q, 1).otherwise(0)) + 1)).cast("int").alias(f"nucleus_size_{k}") for k, q in NUCLEI.items()],
    ]
    return rows.groupBy(*key).agg(*aggregates)

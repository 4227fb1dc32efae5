"""Hidden-state metrics: cosine between a token's hidden vectors and the image prototype."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-8
INF = float("inf")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _finite(a: Column) -> Column:
    return F.forall(a, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < INF), F.lit(False)))


def cosine(a: Column, b: Column) -> Column:
    """(cos + 1) / 2 within 0 to 1; null if either vector is null, not finite, shorter than 1e-8, or of another size."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    # scaled by the largest component, so that no square leaves the doubles
    most = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    scaled = lambda v: F.element_at(F.transform(F.array(F.struct(v.alias("v"), most(v).alias("m"))), lambda s: F.struct(F.transform(s["v"], lambda x: F.try_divide(x, s["m"])).alias("v"), s["m"].alias("m"))), 1)
    sound = F.when((F.size(a) == F.size(b)) & _finite(a) & _finite(b), F.array(F.struct(scaled(a).alias("a"), scaled(b).alias("b"))))

    def of(s: Column) -> Column:
        va, vb = s["a"]["v"], s["b"]["v"]
        na, nb = F.sqrt(_dot(va, va)), F.sqrt(_dot(vb, vb))
        return F.when(
            (na * s["a"]["m"] >= EPSILON) & (nb * s["b"]["m"] >= EPSILON),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), (_dot(va, vb) / (na * nb) + 1) / 2)),
        )

    return F.get(F.transform(sound, of), F.lit(0))


def admitted(value: Column) -> Column:
    """A recorded cosine: null if not finite or outside 0 to 1 by more than 1e-8, else clipped."""
    return F.when(~F.isnan(value) & (value >= -EPSILON) & (value <= 1 + EPSILON), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def prototypes(df: DataFrame, key: list[str], vector: str) -> DataFrame:
    """``key``, ``prototype``: the mean of the vectors of a key, component by component, summed partially before the shuffle."""
    rows = df.select(*key, F.posexplode(F.col(vector).cast("array<double>")).alias("_at", "_x"))
    means = rows.groupBy(*key, "_at").agg(F.avg("_x").alias("_x"))
    return means.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias("prototype"))


def layer_means(df: DataFrame, key: list[str], layer: str = "layer", value: str = "cosine") -> DataFrame:
    """Valid layers and mean cosines of all layers (1-36), the early (1-21) and the reasoning ones (22-34), and layer 36's."""
    v = F.col(value)
    inside = lambda lo, hi: F.when(F.col(layer).between(lo, hi), v)
    ranges = {"all": (1, 36), "early_visual_integration": (1, 21), "visual_reasoning": (22, 34)}
    last = F.max(F.when(F.col(layer) == 36, v))
    counts = [F.count(inside(*r)).cast("short").alias(f"valid_layers_{n}") for n, r in ranges.items()]
    names = {"all": "avg_all_layers", "early_visual_integration": "early_visual_integration", "visual_reasoning": "visual_reasoning"}
    means = [F.avg(inside(*r)).alias(f"cosine_gen_imgproto_hidden_{names[n]}") for n, r in ranges.items()]
    return df.groupBy(*key).agg(*counts, last.isNotNull().alias("last_layer_valid"), *means, last.alias("cosine_gen_imgproto_hidden_last_layer"))

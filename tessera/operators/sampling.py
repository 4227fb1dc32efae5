"""Sampling transforms over logit arrays, the stop rule, and a reproducible draw."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bind

INF = float("inf")


@dataclass(frozen=True)
class Sampling:
    """Knobs of one strategy; only values with a meaning can be made."""

    temperature: float = 1.0
    top_p: float = 1.0
    top_k: int | None = None
    repetition_penalty: float = 1.0

    def __post_init__(self):
        if not (math.isfinite(self.temperature) and self.temperature > 0):
            raise ValueError("temperature must be positive and finite")
        if not 0 < self.top_p <= 1:
            raise ValueError("top_p must lie in (0, 1]")
        if self.top_k is not None and self.top_k <= 0:
            raise ValueError("top_k must be positive")
        if self.repetition_penalty != 1:
            raise ValueError("repetition penalties other than 1 are not supported")


#: The two published strategies.
DIVERSE = Sampling(1.0, 0.99)
CONCENTRATED = Sampling(0.7, 0.8, 20)


def survivors(logits: Column, s: Sampling) -> Column:
    """Indices (0-based, by falling logit, equal ones by index) that stay after temperature, top-k and top-p.

    The index whose probability makes the running sum reach top_p stays, so the first always does;
    -Inf logits never do, but for the first.
    """
    z = F.transform(logits.cast("array<double>"), lambda x, i: F.struct((-x / s.temperature).alias("z"), i.alias("i")))
    ranked = F.array_sort(z)  # negated: rising is falling
    if s.top_k is not None:
        ranked = F.slice(ranked, 1, s.top_k)
    best = lambda a: F.element_at(a, 1)["z"]
    total = lambda a, top: F.aggregate(a, F.lit(0.0), lambda t, x: t + F.exp(top - x["z"]))

    def kept(a: Column, top: Column, mass: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("before"), F.lit(0).alias("n"))

        def step(state: Column, x: Column) -> Column:
            stays = (state["n"] == 0) | ((state["before"] < s.top_p) & (x["z"] < INF))
            return F.struct((state["before"] + F.exp(top - x["z"]) / mass).alias("before"), (state["n"] + F.when(stays, 1).otherwise(0)).alias("n"))

        # whoever stays comes before whoever goes
        n = F.aggregate(a, start, step, lambda state: state["n"])
        return F.transform(F.slice(a, F.lit(1), n), lambda x: x["i"])

    return bind(ranked, lambda a: bind(best(a), lambda top: bind(total(a, top), lambda mass: kept(a, top, mass))))


def filtered(logits: Column, s: Sampling) -> Column:
    """Logits over temperature, with -Inf for all but the :func:`survivors`."""
    return bind(
        survivors(logits, s),
        lambda ids: F.transform(logits.cast("array<double>"), lambda x, i: F.when(F.array_contains(ids, i), x / s.temperature).otherwise(F.lit(-INF))),
    )


def softmax(logits: Column) -> Column:
    """Probabilities of logits, of which at least one is finite."""

    def of(z: Column) -> Column:
        total = lambda top: F.aggregate(z, F.lit(0.0), lambda t, x: t + F.exp(x - top))
        return bind(F.array_max(z), lambda top: bind(total(top), lambda t: F.transform(z, lambda x: F.exp(x - top) / t)))

    return bind(logits, of)


def draw(probabilities: Column, *identity: Column) -> Column:
    """An index drawn by the inverse of the running sum at a uniform number from the SHA-256 of ``identity``.

    The number is the first 13 hexadecimal digits of the hash of the values as texts, with U+0001 between
    them. The same identity draws the same index on any cluster; no other generator's draws are reproduced.
    """
    text = F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("")) for c in identity])
    uniform = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
    start = F.struct(F.lit(0.0).alias("c"), F.lit(-1).alias("i"), F.lit(-1).alias("last"))

    def of(p: Column, u: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            c, n = a["c"] + x, a["last"] + 1
            return F.struct(c.alias("c"), F.when((a["i"] < 0) & (x > 0) & (c > u), n).otherwise(a["i"]).alias("i"), n.alias("last"))

        return F.aggregate(p, start, step, lambda a: F.when(a["i"] >= 0, a["i"]).otherwise(F.array_position(p, F.array_max(p)).cast("int") - 1))

    return bind(probabilities, lambda p: bind(uniform, lambda u: of(p, u)))


def stop(token_id: Column, retained: Column, limit: Column, stop_ids: list[int]) -> Column:
    """Struct (retain, stop, reason): a stop token is dropped and ends; the token that fills the limit is kept and ends."""
    ends = token_id.isin(stop_ids) if stop_ids else F.lit(False)
    full = retained + 1 == limit
    reason = F.when(ends, "stop_token").when(full, "max_new_tokens")
    return F.struct((~ends).alias("retain"), (ends | full).alias("stop"), reason.alias("reason"))

"""Ordered funnels, counted by a frontier of attempts that all funnels' definitions move on, round by round."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, written

MINUTE = 60_000_000
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


@dataclass(frozen=True)
class Funnel:
    """Kinds of its steps in order (at least one), kinds that end an attempt, and the microseconds from the first step to any other at most."""

    name: str
    steps: tuple[str, ...]
    excluded: tuple[str, ...] = ()
    within: int = 30 * MINUTE


def microseconds(time: Column) -> Column:
    """Microseconds from 1970 of a time without a zone, whatever the session's zone is; a time with a zone is taken in the session's."""
    local = time.cast("timestamp_ntz")
    days = F.datediff(local, F.expr(EPOCH)).cast("long")
    seconds = (F.extract(F.lit("SECOND"), local) * 1_000_000).cast("long")
    return days * 86_400_000_000 + (F.hour(local) * 60 + F.minute(local)).cast("long") * MINUTE + seconds


def distinct_events(clicks: DataFrame, kinds: list[str], client: str = "client_id", kind: str = "kind", time: str = "arrived_at") -> DataFrame:
    """``client, code, at``: different rows without nulls of the given kinds; ``code`` counts these, ``at`` is in microseconds."""
    code = (F.array_position(F.lit(kinds), F.col(kind)) - 1).cast("int")
    rows = clicks.select(F.col(client).alias("client"), code.alias("code"), microseconds(F.col(time)).alias("at"))
    return rows.where("client is not null and code >= 0 and at is not null").distinct()


def _bucketed(events: DataFrame, width: int) -> DataFrame:
    """Successors by bucket of ``width``: every event in its own, and of each kind the first of a bucket also in the one before.

    So the first successor of a kind, of any time in a bucket, stands in that bucket if it is at most ``width`` away.
    """
    rows = events.withColumn("bucket", F.expr(f"(at - pmod(at, {width})) div {width}"))
    first = rows.groupBy("client", "code", "bucket").agg(F.min("at").alias("at"))
    return rows.unionByName(first.withColumn("bucket", F.col("bucket") - 1))


def _definitions(spark: SparkSession, funnels: list[Funnel], kinds: list[str]) -> DataFrame:
    """A row for each step behind the first: what an attempt that stands at ``step`` looks for, and what ends it."""
    rows = [
        (f, step, kinds.index(kind), [kinds.index(x) for x in funnel.excluded], funnel.within)
        for f, funnel in enumerate(funnels) for step, kind in enumerate(funnel.steps[1:], 1)
    ]
    return spark.createDataFrame(rows, "funnel int, step int, wanted int, excluded array<int>, within long")


def _advanced(frontier: DataFrame, successors: DataFrame, definitions: DataFrame, kinds: int, width: int) -> DataFrame:
    """One round: the attempts (funnel, client, started, at, step) that reach their next step, standing there, with the ``gap`` to it.

    Attempts and successors of one client and bucket are sorted from the latest on, attempts before successors
    of the same time. So what an attempt has before it are its successors, of which min_by keeps the first of each kind.
    """
    probes = frontier.join(F.broadcast(definitions), ["funnel", "step"]).withColumn("bucket", F.expr(f"(at - pmod(at, {width})) div {width}"))
    looked_for = definitions.join(F.broadcast(frontier.select("funnel", "step").distinct()), ["funnel", "step"])
    needed = looked_for.select(F.explode(F.array_append("excluded", F.col("wanted"))).alias("code")).distinct()
    both = probes.unionByName(successors.join(F.broadcast(needed), "code"), allowMissingColumns=True)
    window = Window.partitionBy("client", "bucket").orderBy(F.desc("at"), F.col("code").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = F.array(*[F.min_by("at", F.when(F.col("code") == k, F.col("at"))).over(window) for k in range(kinds)])
    met = both.withColumn("firsts", firsts).where("code is null")
    met = met.withColumn("next", F.get("firsts", F.col("wanted"))).withColumn("ends", F.array_min(F.transform("excluded", lambda c: F.get("firsts", c))))
    reached = met.where("next <= started + within and (ends is null or ends > next)")
    return reached.select("funnel", "client", "started", F.col("next").alias("at"), (F.col("step") + 1).alias("step"), (F.col("next") - F.col("at")).alias("gap"))


def _quantiles(reached: DataFrame, percent: int, width: int) -> DataFrame:
    """``funnel, client, step, n, t``: the number of gaps of a step, and of these the ceil(percent * n / 100)-th smallest.

    Gaps are counted in bins as wide as the root of the longest, then the one bin that holds the place is
    counted gap by gap. So a key has no more rows in any task than that root, however many attempts it has.
    """
    root = math.isqrt(width) + 1
    rows, key = reached.withColumn("bin", F.expr(f"gap div {root}")), ["funnel", "client", "step"]

    def placed(counts: DataFrame, by: str, place: Column) -> DataFrame:
        """The row of each key at which the running count comes to ``place``; ``left`` is what of the place is left there."""
        upto = F.sum("count").over(Window.partitionBy(*key).orderBy(by))
        return counts.withColumn("upto", upto).withColumn("place", place).where("upto >= place and upto - count < place").withColumn("left", F.expr("place - upto + count"))

    counts = rows.groupBy(*key, "bin").count().withColumn("n", F.sum("count").over(Window.partitionBy(*key)))
    bins = placed(counts, "bin", F.expr(f"({percent} * n + 99) div 100")).select(*key, "bin", "n", "left")
    gaps = rows.join(bins, [*key, "bin"]).groupBy(*key, "gap").agg(F.count(F.lit(1)).alias("count"), F.first("n").alias("n"), F.first("left").alias("wanted"))
    return placed(gaps, "gap", F.col("wanted")).select(*key, "n", F.col("gap").alias("t"))


def count_funnels(
    clicks: DataFrame, funnels: Iterable[Funnel], percent: int = 90, client: str = "client_id", kind: str = "kind", time: str = "arrived_at",
) -> DataFrame:
    """``funnel``, the client's column, ``n1`` ..., ``deepest``, ``t2`` ..., ``same_depth``: a row for each funnel and client with attempts.

    Each row of a funnel's first kind starts an attempt. Its next step is the client's earliest row of the
    step's kind that is later than the step before. It is reached unless it is more than ``within`` after
    the start, or a row of an excluded kind lies after the step before and not after it; else the attempt
    has ended. ``n`` counts the attempts that reach a step, ``t`` is the ceil(percent * n / 100)-th smallest
    of their microseconds from the step before (null without any, and for steps that a shorter funnel
    hasn't, whose ``n`` is 0), ``deepest`` the last step that any attempt reaches, and ``same_depth``
    the number of clients that have the same in that funnel.

    Rows with a null client, kind or time are left out, repeated rows count once, of other columns none
    matters. Rows of one time are not later than each other. No rows give no rows.

    Successors are bucketed by the longest ``within`` and written once. In each round the definitions are
    joined to the attempts of all funnels, attempts look up their successors within one client and bucket,
    and those that advance are checkpointed and go on. Nothing is gathered by client: a client with a third
    of all rows is spread over its buckets, and its counts are combined before they are shuffled.
    """
    funnels = list(funnels)
    kinds = sorted({k for f in funnels for k in (*f.steps, *f.excluded)})
    width = max(max(f.within for f in funnels), 1)
    events = distinct_events(clicks, kinds, client, kind, time)
    successors = written(_bucketed(events, width))
    definitions = _definitions(clicks.sparkSession, funnels, kinds)
    # an event is in its own bucket once
    own = successors.where(f"bucket = (at - pmod(at, {width})) div {width}")
    begin = F.explode(F.lit([[f for f, x in enumerate(funnels) if kinds.index(x.steps[0]) == c] for c in range(len(kinds))])[F.col("code")])
    frontier = own.select(begin.alias("funnel"), "client", F.col("at").alias("started"), "at", F.lit(1).alias("step"))
    started, rounds = frontier.groupBy("funnel", "client").agg(F.count(F.lit(1)).alias("n")), []
    for _ in range(max(len(f.steps) for f in funnels) - 1):
        frontier = cut(_advanced(frontier.drop("gap"), successors, definitions, len(kinds), width))
        rounds.append(frontier.select("funnel", "client", "step", "gap"))
    reached = started.select("funnel", "client", F.lit(1).alias("step"), "n", F.lit(None).cast("long").alias("t"))
    if rounds:
        reached = reached.unionByName(_quantiles(reduce(DataFrame.unionByName, rounds), percent, width))
    steps = range(1, max(len(f.steps) for f in funnels) + 1)
    counts = [F.coalesce(F.max(F.when(F.col("step") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in steps]
    times = [F.max(F.when(F.col("step") == k, F.col("t"))).alias(f"t{k}") for k in steps[1:]]
    wide = reached.groupBy("funnel", "client").agg(*counts, F.max("step").cast("int").alias("deepest"), *times)
    depths = wide.groupBy("funnel", "deepest").agg(F.count(F.lit(1)).alias("same_depth"))  # a row for each funnel and step at most
    names = F.lit([f.name for f in funnels])[F.col("funnel")]
    return wide.join(F.broadcast(depths), ["funnel", "deepest"]).select(
        names.alias("funnel"), F.col("client").alias(client), *[f"n{k}" for k in steps], "deepest", *[f"t{k}" for k in steps[1:]], "same_depth",
    )

"""Mixing sources to target weights by entropy balancing.

Targets: the sources, in code point order with null last, weigh 3, 1, 2 and so on and share `factor` of all
sizes; a target stops at `most` times its source's size and the excess is shared again by weight.

Rates: of all rates r with sum(r * size) = target in each source and r <= most, the ones nearest to 1 in
relative entropy are r = min(most, exp(a * size)), with one multiplier a for each source: the solution of a
convex dual, found by Newton steps (kept inside a bracket) that run as one aggregation over all sources.

Copies: r is rounded to whole copies, largest documents first within bounded groups of a source, each
rounding making good the error of those before it, so that a source ends within about one small document
of its target.  The order is fixed (size, then hash and id), so reruns agree.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own;
repeated rows are documents of their own; other columns are left behind (the result joins back by doc_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import Workspace, partitions
from .quality import SPACES

GROUP = 2_000  #: documents that one rounding group holds, about
STEPS = 60
NEAR = 1e-9
DIGITS = 9  #: of a multiplier that count


def sizes(text) -> F.Column:
    full = F.coalesce(text, F.lit(""))
    return (F.size(F.split(F.regexp_replace(full, rf"^{SPACES}|{SPACES}$", ""), SPACES)) - F.when(full.rlike(r"[^\x20\x09-\x0D]"), 0).otherwise(1)).cast("long")


def targets(per_source: DataFrame, weights=(3, 1, 2), factor: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, total, n -> with target.  Sources fill up in the order of most * total / weight, so the level at
    which the budget is used up follows from running sums over that order (water filling, no iteration)."""
    ranked = per_source.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    t = ranked.withColumn("weight", w).withColumn("cap", most * F.col("total"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = (
        t.withColumn("budget", factor * F.sum("total").over(everything))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(order), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    )
    # the level of the first source that does not fill up holds for all that follow it
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(everything)["level"]
    return t.select("source", "total", "n", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def multipliers(histogram: DataFrame, per_source: DataFrame, ws: Workspace, most: float) -> DataFrame:
    """source, target, mean, a: rates are min(most, exp(a * size / mean)).

    histogram(source, size, n) is exact; each Newton step is one join and one aggregation on it."""
    top = float(np.log(most))
    state = per_source.withColumn("mean", F.col("total") / F.col("n")).selectExpr(
        "source", "target", "total", "mean", "0D as a", "-1D as lo", f"{top}D as hi", f"total = 0 or target >= {most} * total * (1 - {NEAR}) as done", "cast(null as double) as got"
    )
    # bracket: at hi * mean / smallest size every rate is `most`; lo doubles until too little is taken
    smallest = histogram.filter("size > 0").groupBy(F.col("source").alias("s")).agg(F.min("size").alias("least"))
    state = state.join(smallest, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("hi", F.col("hi") * F.col("mean") / F.coalesce("least", F.lit(1))).drop("s", "least")
    state = ws.save(state, "state0")
    for step in range(1, STEPS + 1):
        x = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.lit(top), F.col("a") * x))
        slope = F.when(F.col("a") * x < top, tilt * x).otherwise(0.0)
        sums = (
            histogram.join(state.filter("not done").select(F.col("source").alias("s"), "a", "mean"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(F.sum(F.col("n") * F.col("size") * tilt).alias("value"), F.sum(F.col("n") * F.col("size") * slope).alias("slope"))
        )
        over = F.col("value") > F.col("target")
        near = F.abs(F.col("value") - F.col("target")) <= NEAR * F.col("target")
        newton = F.col("a") - (F.col("value") - F.col("target")) / F.col("slope")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("a")), F.when(over, F.col("a")).otherwise(F.col("hi"))
        low_open = over & (F.col("lo") >= F.col("a"))
        middle = F.when(F.col("lo") >= F.col("a"), 2 * F.col("lo") - 1).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").withColumns({"_lo": lo, "_hi": hi})
        state = ws.save(
            moved.select(
                "source", "target", "total", "mean",
                F.when(F.col("done") | near | F.col("value").isNull(), F.col("a"))
                .when((F.col("slope") > 0) & (newton > F.col("_lo")) & (newton < F.col("_hi")), newton)
                .otherwise(middle).alias("a"),
                F.when(low_open, 2 * F.col("lo") - 1).otherwise(F.col("_lo")).alias("lo"),
                F.col("_hi").alias("hi"),
                (F.col("done") | F.coalesce(near, F.lit(True))).alias("done"),
                F.col("value").alias("got"),
            ),
            f"state{step}",
        )
        ws.drop(f"state{step - 1}")
        if state.filter("not done").isEmpty():
            break
    return state


def mix(docs: DataFrame, ws: Workspace, weights=(3, 1, 2), factor: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken (copies * size) of every row of docs."""
    sized = docs.select("doc_id", "source", sizes(F.col("text")).alias("size"), F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("_key"))
    sized = ws.save(sized, "sized")
    histogram = ws.save(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    per_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("n"))
    per_source = ws.save(targets(per_source, weights, factor, float(most)), "targets")
    # sums of floating-point numbers depend on their order: digits past the solution's tolerance would differ between reruns
    solved = multipliers(histogram, per_source, ws, float(most)).withColumn("a", F.round("a", DIGITS))
    rates = per_source.join(solved.select(F.col("source").alias("s"), "mean", "a"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("_s"), F.col("total").alias("source_size"), "target", "n", "mean", "a"
    )
    full = F.col("target") >= most * F.col("source_size") * (1 - NEAR)
    tilt = F.exp(F.least(F.lit(float(np.log(most))), F.col("a") * F.col("size") / F.col("mean")))
    dealt = (
        sized.join(rates, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("rate", F.when(F.col("size") == 0, 0.0).when(full, float(most)).otherwise(tilt))
        .withColumn("_group", F.pmod("_key", F.ceil(F.col("n") / GROUP)))
        .select("doc_id", "source", "size", "source_size", "target", "rate", "_group", "_key")
        .repartition(partitions(docs.sparkSession), "source", "_group")
        .sortWithinPartitions("source", "_group", F.desc("size"), "_key", "doc_id")
    )

    def rounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A group may span batches: the error carries over until the next group begins."""
        at, due = None, 0.0
        for pdf in batches:
            size, rate, copies = pdf["size"].to_numpy(), pdf["rate"].to_numpy(), np.zeros(len(pdf), dtype=np.int64)
            for i, here in enumerate(zip(pdf["source"], pdf["_group"], strict=True)):
                if here != at:
                    at, due = here, 0.0
                if size[i]:
                    due += rate[i] * size[i]
                    copies[i] = min(max(int(due / size[i] + 0.5), int(rate[i])), int(np.ceil(rate[i] - 1e-12)), most)
                    due -= copies[i] * size[i]
            yield pdf.drop(columns=["_group", "_key"]).assign(copies=copies, taken=copies * size)

    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, source {kinds['source']}, size long, source_size long, target double, rate double, copies long, taken long"
    return dealt.mapInPandas(rounded, schema)

"""Mixing sources to target weights by entropy balancing.

The rates at which documents are taken are to stay as close to 1 as possible, in relative entropy over
documents and with none above CAP, while the words taken from each source meet its target.  The
convex dual has one multiplier a source, and its optimum tilts every document's rate exponentially
by its own size: rate = min(CAP, exp(lambda of its source * size / the source's mean size)).  A Newton
step on the dual needs, for each source, the sum of size * rate and its slope, which one
aggregation over (source, size) counts gives; all sources step at once, and a bracket catches steps
that overshoot.

Rates become copies: each document gets its rate's whole part, and what then lacks to a source's
target goes to single further copies, in the order of a hash divided by the rate's fraction (so that a
document is taken about as often as its fraction says).  Where a document does not fit what is left,
later passes go on with those that do.  The order is never sorted: a pass descends through the
digits of the order, one small aggregation a digit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, word_count

#: A document gives at most so many times its size, and so does a source.
CAP = 3
#: Newton steps at most; the last ones halve a bracket that is then narrower than a rate's resolution.
STEPS = 80
#: Passes over what is left end where a source lacks less than this share of its target, or nothing fits.
NEAR = 1e-3
#: Rates are whole multiples of 1 / UNITS, so that sums of them do not depend on their order.
UNITS = 10**9
#: Bits of the order of further copies, and bits that one pass's digit has.
HASH, FRACTION, TIES, DIGIT = 40, 6, 14, 10
#: Sources that one range holds, on average, when sources are ranked.
RANGE = 200_000
BIG = "decimal(38,0)"


def cumulated(df: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """``df`` with rank (from 0) and, by name, what the rows before each one in ``order`` add up to.

    Rows are cut into ranges of the order; a range is summed in one task and ranges carry over."""
    ranges = max(1, -(-df.count() // RANGE))
    added = df.select("*", *(c.cast(BIG).alias(f"{n}_own") for n, c in sums.items()))
    cut = scratch.write(added.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "ranges")
    names = {"rank": F.count(F.lit(1))} | {n: F.sum(f"{n}_own") for n in sums}
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.select("*", *(F.coalesce(c.over(before), F.lit(0)).cast(BIG).alias(n) for n, c in names.items()))
    ends = cut.groupBy("part").agg(*(c.alias(n) for n, c in names.items()))  # one row a range
    carried = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(F.col("part").alias("p"), *(F.coalesce(F.sum(n).over(carried), F.lit(0)).cast(BIG).alias(f"{n}_carry") for n in names))
    out = own.join(carry, F.col("part") == F.col("p"))
    return out.select(*df.columns, *((F.col(n) + F.col(f"{n}_carry")).cast(BIG).alias(n) for n in names))


def water_fill(totals: DataFrame, weights: tuple[int, ...], cap: int, scratch: Scratch) -> DataFrame:
    """``totals`` (source, source_size) with target: sources in code-point order, null last, weigh ``weights``
    in turn and share the sum so; none gets above cap times its size, and the excess is reshared."""
    order = [F.col("source").isNull(), F.col("source")]
    ranked = cumulated(totals, order, {}, scratch)
    turn = F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")
    weighed = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    weighed = scratch.write(weighed.drop("rank"), "weighed")
    whole, weight = weighed.agg(F.sum(F.col("source_size").cast(BIG)), F.sum("w")).first()
    size, w = F.col("source_size").cast(BIG) * cap, F.col("w").cast(BIG)
    filled = cumulated(weighed, [(size.cast("double") / F.col("w")), *order], {"gone": size, "gone_w": w}, scratch)
    # the level falls as capped sources leave, so those that are capped come first in the order
    full = size * (F.lit(weight or 0).cast(BIG) - F.col("gone_w")) < (F.lit(whole or 0).cast(BIG) - F.col("gone")) * w
    filled = scratch.write(filled.withColumn("full", full), "filled")
    taken, taken_w = filled.where("full").agg(F.sum(size), F.sum("w")).first()
    left, share = int(whole or 0) - int(taken or 0), int(weight or 0) - int(taken_w or 0)
    level = F.lit(float(left) / share if share else 0.0) * F.col("w")
    return filled.select("source", "source_size", F.when(F.col("full"), size.cast("double")).otherwise(level).alias("target"))


def tilted(size: Column, lam: Column, mean: Column, cap: int) -> Column:
    """A document's rate under its source's multiplier, in whole units; null for a multiplier of infinity."""
    return F.floor(F.least(F.lit(float(cap)), F.exp(F.least(lam * size / mean, F.lit(math.log(cap) + 1)))) * UNITS)


def dual(cells: DataFrame, targets: DataFrame, cap: int, scratch: Scratch, steps: int = STEPS) -> DataFrame:
    """``targets`` (source, source_size, target) with lam and mean: the multiplier at which the rates of
    ``cells`` (source, size, n) meet each target.  A target of cap times the size needs an infinite one."""
    same = F.col("source").eqNullSafe(F.col("s"))
    means = cells.groupBy("source").agg(F.sum("n").alias("docs")).withColumnRenamed("source", "s")
    state = targets.join(means, same).select(
        "source", "source_size", "target", (F.greatest(F.col("source_size"), F.lit(1)) / F.col("docs")).alias("mean"),
        F.lit(0.0).alias("lam"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"),
        ((F.col("source_size") == 0) | (F.col("target") >= cap * F.col("source_size"))).alias("done"),
    )
    state = scratch.write(state, "dual")
    for _ in range(steps):
        if not state.where("not done").limit(1).count():
            break
        open_ = state.where("not done").select(F.col("source").alias("s"), "lam", "mean")
        rate = tilted(F.col("size"), F.col("lam"), F.col("mean"), cap)
        slope = F.when(rate < cap * UNITS, F.floor(rate * F.col("size") / F.col("mean"))).otherwise(0)
        mass = (F.col("size") * F.col("n")).cast("decimal(20,0)")
        sums = cells.join(open_, same).groupBy("s").agg(F.sum(mass * rate.cast("decimal(11,0)")).alias("got"), F.sum(mass * slope.cast("decimal(17,0)")).alias("up"))
        gap = F.col("got").cast("double") / UNITS - F.col("target")
        step = F.col("lam") - gap * UNITS / F.col("up").cast("double")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        middle = F.when(low == -1e6, 2 * F.col("lam") - 1).when(high == 1e6, 2 * F.col("lam") + 1).otherwise((low + high) / 2)
        inside = (F.col("up") > 0) & (step > low) & (step < high)
        near = (F.abs(gap) <= 1e-9 * F.col("target")) | (high - low < 1e-12)
        stepped = state.where("not done").join(sums, same)
        moved = stepped.select("source", "source_size", "target", "mean", F.when(near, F.col("lam")).when(inside, step).otherwise(middle).alias("lam"), low.alias("low"), high.alias("high"), near.alias("done"))
        state = scratch.write(state.where("done").unionByName(moved), "dual")
    infinite = (F.col("source_size") > 0) & (F.col("target") >= cap * F.col("source_size"))
    return state.select("source", "source_size", "target", "mean", F.when(~infinite, F.col("lam")).alias("lam"))


def order_of(key: Column, fraction: Column, row: Column) -> Column:
    """Where a document stands in the order of further copies: its hash by its rate's fraction, then its row."""
    top = F.lit((1 << (HASH + FRACTION)) - (1 << HASH))
    ahead = F.floor(F.shiftrightunsigned(key, 64 - HASH) / fraction)
    place = F.when((fraction > 0) & (ahead < top), ahead).otherwise(top + F.shiftrightunsigned(key, 64 - HASH))
    return place * (1 << TIES) + F.pmod(F.xxhash64(row), F.lit(1 << TIES))


def further(sizes: DataFrame, plan: DataFrame, scratch: Scratch, near: float = NEAR) -> DataFrame:
    """s, passes: for each source of ``plan`` (s, rest, target) the passes (fit, upto) of its further copies: a
    document gets one if its size is at most a pass's fit and its place is below that pass's upto."""
    bits = HASH + FRACTION + TIES
    same = F.col("source").eqNullSafe(F.col("s"))
    none = F.array().cast("array<struct<fit:double,upto:bigint>>")
    state = scratch.write(plan.select("s", "target", F.col("rest").cast("double").alias("rest"), none.alias("passes"), (F.col("rest") <= 0).alias("done")), "passes")
    while state.where("not done").limit(1).count():
        taken = F.exists("passes", lambda p: (F.col("size") <= p["fit"]) & (F.col("place") < p["upto"]))
        level = state.where("not done").select("s", "rest", "passes", F.col("rest").alias("fit"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("n"))
        ended = None
        for shift in range(bits - DIGIT, -1, -DIGIT):
            inside = sizes.where("size > 0").join(level, same).where(F.shiftright("place", shift + DIGIT) == F.col("prefix"))
            inside = inside.where((F.size("passes") == 0) | ((F.col("size") <= F.col("fit")) & ~taken))
            bins = inside.groupBy("s", "rest", "fit", "passes", F.shiftright("place", shift).alias("digit")).agg(F.sum("size").alias("part"), F.count("*").alias("n"))
            run = Window.partitionBy("s").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
            summed = bins.withColumn("upto", F.sum("part").over(run))
            over = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("digit", "n", (F.col("upto") - F.col("part")).alias("below"))))
            found = summed.groupBy("s", "rest", "fit", "passes").agg(over.alias("x"), F.sum("part").alias("all"))
            # a source whose documents all fit ends here; else the first digit that goes over is looked into
            found = found.select(
                "s", (F.col("rest") - F.coalesce("x.below", "all")).alias("rest"), "fit", "passes",
                F.coalesce("x.digit", F.lit(1 << (bits - shift))).alias("prefix"), F.coalesce("x.n", F.lit(0)).alias("n"),
            )
            level = scratch.write(found, "digits")
            single = level.where("n <= 1" if shift else "true")
            ends = single.select("s", "rest", "fit", "passes", F.when(F.col("n") == 0, F.lit(1 << 62)).otherwise(F.shiftleft("prefix", shift)).alias("upto"))
            ended = ends if ended is None else ended.unionByName(ends)
            level = level.where("n > 1")
            if not shift or not level.limit(1).count():
                break
        now = ended.select(F.col("s").alias("t"), F.col("rest").alias("after"), F.col("upto"), "fit")
        joined = state.join(now, F.col("s").eqNullSafe(F.col("t")), "left")
        # a source without a row here had nothing that fits; the first pass lets any size stand before its end
        one = F.struct(F.when(F.size("passes") == 0, F.lit(float("inf"))).otherwise(F.col("fit")).alias("fit"), "upto")
        ran = F.col("upto").isNotNull()
        done = F.col("done") | ~ran | (F.col("after") <= near * F.col("target")) | (F.col("upto") == 1 << 62) | ((F.col("after") == F.col("rest")) & (F.size("passes") > 0))
        state = scratch.write(joined.select(
            "s", "target", F.coalesce("after", "rest").alias("rest"), F.when(ran, F.array_append("passes", one)).otherwise(F.col("passes")).alias("passes"), done.alias("done"),
        ), "passes")
    return state.select("s", "passes")


def mix(df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate, copies of every row of ``df`` (doc_id, source, text).

    Sources in code-point order, null last, get ``weights`` in turn and share all words so; none takes
    more than ``cap`` times its size.  A source's words come within NEAR of its target, or nothing that is
    left fits what it lacks.  A null or empty text has size 0, rate 1 and one copy, 0 words.  Rows that repeat
    a document may get different numbers of copies; which of them does not matter, as they are equal.
    Null ids are ids like others.  Any number of sources; an empty table gives no rows.  With ``carry`` the
    input's columns come back instead, whatever their names, each row ``copies`` times.
    """
    scratch = Scratch(df.sparkSession)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    facts = [F.col("source"), word_count(F.col("text")).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row")]
    sizes = scratch.write(df.select("doc_id", *facts), "mix-sizes")
    cells = scratch.write(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    totals = scratch.write(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "mix-totals")
    plan = dual(cells, water_fill(totals, weights, cap, scratch), cap, scratch).withColumnRenamed("source", "s")
    plan = scratch.write(plan, "mix-plan")

    def rated(rows: DataFrame) -> DataFrame:
        """Rows (source, size, key, row) with rate, whole and place, and the plan's columns."""
        lam = F.when(F.col("size") == 0, F.lit(UNITS)).when(F.col("lam").isNull(), F.lit(cap * UNITS)).otherwise(tilted(F.col("size"), F.col("lam"), F.col("mean"), cap))
        out = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("units", lam.cast("long"))
        out = out.withColumn("whole", F.floor(F.col("units") / UNITS).cast("long"))
        fraction = (F.col("units") - F.col("whole") * UNITS) / float(UNITS)
        return out.withColumn("place", order_of(F.col("key"), fraction, F.col("row")))

    placed = scratch.write(rated(sizes).select("doc_id", "source", "size", "units", "whole", "place"), "mix-places")
    got = placed.groupBy("source").agg(F.sum(F.col("size") * F.col("whole")).alias("got"))
    rest = plan.join(got, F.col("source").eqNullSafe(F.col("s"))).select("s", "target", (F.col("target") - F.col("got")).alias("rest"))
    # a document at the cap has no further copy to give
    passes = further(placed.where(F.col("whole") < cap), rest, scratch)
    ends = scratch.write(plan.join(passes.withColumnRenamed("s", "ps"), F.col("s").eqNullSafe(F.col("ps")), "left").drop("ps"), "mix-ends")
    more = F.exists("passes", lambda p: (F.col("size") <= p["fit"]) & (F.col("place") < p["upto"]))
    copies = F.col("whole") + F.when((F.col("size") > 0) & (F.col("whole") < cap), F.coalesce(more, F.lit(False)).cast("long")).otherwise(0)
    if carry:
        plan = ends
        own = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("folio_row")
        out = rated(df.select(own, *facts))
        scratch.discard(ends)
        each = out.select("folio_row", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("n"))
        return each.select(*(F.col("folio_row")[c].alias(c) for c in df.columns))
    scratch.discard(ends, placed)
    out = placed.join(ends, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), (F.col("units") / float(UNITS)).alias("rate"), copies.alias("copies"))

"""Exponential averages of whole series, and MACD, as a scan of mergeable maps.

One bar takes an average ``v`` to ``keep * v + (1 - keep) * close``, so a block of bars takes
it to ``A * v + B``.  Every block is summed up on its own, the few numbers of all blocks are
composed along the series, and each bar then adds what reaches it from before its block.
The signal line averages the difference of two other averages; the three together are one
such map, whose coupling has a closed form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.plans.layout import CHUNK, SeriesLayout

# Usual periods of the fast and slow average and of the signal line.
FAST, SLOW, SIGNAL = 12, 26, 9
# Weights grow along a block; they stay below 10^200.
_LARGEST = 200 * math.log(10)

# Known closes so far, and the three averages.
_STATE = "struct<n:long,f:double,s:double,g:double>"
_BLOCK = "_block"


def kept_share(period: int) -> float:
    """What a bar leaves of the average before it."""
    if period < 1:
        raise ValueError(f"a period is 1 or more, not {period}")
    return 1 - 2 / (period + 1)


def _coupling(keep: float, signal: float, steps: Column) -> Column:
    """Sum over i of signal^(n - i) * keep^i, for i from 1 to n."""
    if keep == signal:
        return steps * F.pow(F.lit(keep), steps)
    return (F.pow(F.lit(keep), steps) - F.pow(F.lit(signal), steps)) * (keep / (keep - signal))


def _power(keep: float, steps: Column) -> Column:
    return F.pow(F.lit(keep), steps) if keep else F.when(steps == 0, 1.0).otherwise(0.0)


def _from_zero(value: Column, keep: float, frame: Window) -> Column:
    """The average at each bar of a block, if it were 0 before the block."""
    if not keep:
        return F.coalesce(F.last(value, ignorenulls=True).over(frame), F.lit(0.0))
    steps = F.col("_steps")
    weighed = (1 - keep) * value * F.pow(F.lit(1 / keep), steps)
    return F.coalesce(F.sum(weighed).over(frame), F.lit(0.0)) * F.pow(F.lit(keep), steps)


def macd(
    bars: DataFrame,
    layout: SeriesLayout,
    fast: int = FAST,
    slow: int = SLOW,
    signal: int = SIGNAL,
) -> DataFrame:
    """Add ``macd`` (fast less slow average), ``signal`` (its average) and ``histogram``.

    The first known close of a series starts both averages. A bar without a close leaves
    them as they are; before the first known close all three are null.

    The bars are read and exchanged once; per series, one small struct for each block
    meets in one array. A block is a chunk of the layout, or some thousand bars of a
    longer one.
    """
    if slow < fast:
        raise ValueError(f"the slow period {slow} is below the fast period {fast}")
    shares = [kept_share(p) for p in (fast, slow, signal)]
    keep_f, keep_s, keep_g = shares
    growth = max((-math.log(k) for k in shares if k), default=1.0)
    per_block = max(1, int(_LARGEST / growth))

    if layout.chunk_chars is None:
        rows = bars.repartition(layout.key)
    else:
        rows = bars.withColumn(CHUNK, layout.chunk()).repartition(layout.key, CHUNK)
    blocks = Window.partitionBy(*layout.task_keys, _BLOCK).orderBy(*layout.order)
    frame = blocks.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    close = F.col("close")
    rows = rows.withColumn("_at", F.row_number().over(layout.window()))
    rows = rows.withColumn(_BLOCK, F.floor((F.col("_at") - 1) / per_block).cast("int"))
    rows = rows.withColumn("_steps", F.count("close").over(frame))
    rows = rows.withColumns({"_f": _from_zero(close, keep_f, frame), "_s": _from_zero(close, keep_s, frame)})
    apart = F.when(close.isNotNull(), F.col("_f") - F.col("_s"))
    rows = rows.withColumn("_g", _from_zero(apart, keep_g, frame))

    maps = rows.groupBy(*layout.task_keys, _BLOCK).agg(
        F.max("_steps").alias("n"),
        F.min_by("close", F.when(close.isNotNull(), F.col("_at"))).alias("first"),
        *[F.max_by(f"_{x}", "_at").alias(x) for x in "fsg"],
    )
    before = _carried(maps, layout, keep_f, keep_s, keep_g)
    rows = rows.join(before, layout.task_keys, "left")
    # The blocks of a task follow one another without a gap, from the first.
    rows = rows.withColumn("_in", F.get("_before", F.col(_BLOCK)))
    n = F.col("_steps")
    f = F.col("_f") + _power(keep_f, n) * F.col("_in.f")
    s = F.col("_s") + _power(keep_s, n) * F.col("_in.s")
    g = F.col("_g") + _signal_from(F.col("_in"), n, keep_f, keep_s, keep_g)
    begun = (F.col("_in.n") + n) > 0
    rows = rows.withColumns({"_dif": F.when(begun, f - s), "_sig": F.when(begun, g)})
    return rows.select(
        *[F.col(f"`{c}`") for c in bars.columns],
        F.col("_dif").alias("macd"),
        F.col("_sig").alias("signal"),
        (F.col("_dif") - F.col("_sig")).alias("histogram"),
    )


def _signal_from(state: Column, n: Column, keep_f: float, keep_s: float, keep_g: float) -> Column:
    """What the state before a block adds to the signal after `n` of its known bars."""
    coupled = _coupling(keep_f, keep_g, n) * state["f"] - _coupling(keep_s, keep_g, n) * state["s"]
    return _power(keep_g, n) * state["g"] + (1 - keep_g) * coupled


def _carried(
    maps: DataFrame, layout: SeriesLayout, keep_f: float, keep_s: float, keep_g: float
) -> DataFrame:
    """Task keys and `_before`: the state before each block of the task, in order."""
    chunk = F.lit("") if layout.chunk_chars is None else F.col(CHUNK)
    block = F.struct(chunk.alias("chunk"), _BLOCK, "n", "first", "f", "s", "g")
    series = maps.groupBy(layout.key).agg(F.sort_array(F.collect_list(block)).alias("_maps"))

    def state(n: Column, f: Column, s: Column, g: Column) -> Column:
        return F.struct(n.alias("n"), f.alias("f"), s.alias("s"), g.alias("g")).cast(_STATE)

    def after(acc: Column, one: Column) -> Column:
        n, now = one["n"], acc["state"]
        following = state(
            now["n"] + n,
            one["f"] + _power(keep_f, n) * now["f"],
            one["s"] + _power(keep_s, n) * now["s"],
            one["g"] + _signal_from(now, n, keep_f, keep_s, keep_g),
        )
        seen = F.struct(one["chunk"].alias("chunk"), now.alias("state"))
        return F.struct(following.alias("state"), F.concat(acc["seen"], F.array(seen)).alias("seen"))

    # Averages that stand at the first close before it still do so after it.
    first = F.coalesce(F.get(F.filter("_maps.first", lambda x: x.isNotNull()), F.lit(0)), F.lit(0.0))
    kind = maps.select(chunk.alias("chunk")).schema["chunk"].dataType.simpleString()
    start = F.struct(
        state(F.lit(0), first, first, F.lit(0.0)).alias("state"),
        F.array().cast(f"array<struct<chunk:{kind},state:{_STATE}>>").alias("seen"),
    )
    states = F.aggregate("_maps", start, after)["seen"]
    if layout.chunk_chars is None:
        return series.select(layout.key, F.transform(states, lambda x: x["state"]).alias("_before"))
    each = series.select(layout.key, F.posexplode(states).alias("_place", "_one"))
    ordered = F.sort_array(F.collect_list(F.struct("_place", "_one.state")))
    return each.groupBy(layout.key, F.col("_one.chunk").alias(CHUNK)).agg(
        F.transform(ordered, lambda x: x["state"]).alias("_before")
    )

"""The stop-and-reverse recursion, one step at a time.

State: level ``p``, trend ``t`` (1 up, -1 down), extreme point ``ep`` and
acceleration ``af``.  The recursion is a native array fold; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlewick.functions.expressions import extreme_of, step_toward

# Default acceleration step and ceiling.
AF_STEP = 0.02
AF_MAX = 0.2

STATE_TYPE = "struct<p:double,t:int,ep:double,af:double>"


def pack(p: Column, t: Column, ep: Column, af: Column) -> Column:
    return F.struct(p.alias("p"), t.alias("t"), ep.alias("ep"), af.alias("af"))


def start(bar: Column, af_step: float = AF_STEP) -> Column:
    """State at the first bar: level at the close, trend up, extreme at the high."""
    return pack(bar.getField("close"), F.lit(1), bar.getField("high"), F.lit(float(af_step)))


def step(
    state: Column, bar: Column, af_step: float = AF_STEP, af_max: float = AF_MAX
) -> Column:
    """State after one more bar.

    The branches return whole states, so each condition is evaluated once.
    """
    p, t, ep, af = (state.getField(name) for name in ("p", "t", "ep", "af"))
    high, low = bar.getField("high"), bar.getField("low")
    up = t == 1
    along, against = extreme_of(t, high, low), extreme_of(-t, high, low)
    moved = step_toward(p, ep, af)
    crossed = F.when(up, low < moved).otherwise(high > moved)
    extended = F.when(up, high > ep).otherwise(low < ep)
    faster = F.least(af + af_step, F.lit(float(af_max)))
    return (
        F.when(crossed, pack(ep, -t, against, F.lit(float(af_step))))
        .when(extended, pack(moved, t, along, faster))
        .otherwise(pack(moved, t, ep, af))
    )


def fold(
    bars: Column,
    seed: Column | None = None,
    af_step: float = AF_STEP,
    af_max: float = AF_MAX,
) -> Column:
    """Final state over an ordered array of ``struct<high, low, close>``.

    ``seed`` is the state before the array's first bar.  Where it is null (or not
    given) the first bar starts the series and is not itself a step.
    """
    own = start(F.try_element_at(bars, F.lit(1)), af_step)
    if seed is None:
        begin, taken = own, F.lit(1)
    else:
        begin, taken = F.coalesce(seed, own), F.when(seed.isNull(), 1).otherwise(0)
    return F.aggregate(
        F.slice(bars, taken + 1, F.size(bars)),
        begin.cast(STATE_TYPE),
        lambda acc, bar: step(acc, bar, af_step, af_max).cast(STATE_TYPE),
    )

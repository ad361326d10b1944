"""Entropy balancing: mix sources to target word counts with tilted document rates.

Native throughout: every step is an aggregate, a join or an expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.shared import WORD, in_order, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
# Rounding: size classes by powers of two, each with so many steps of the threshold.
STEPS = 4096


def _is(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def measured(docs: DataFrame) -> DataFrame:
    """The rows with `_size` (words, null text: 0) and `_draw` (uniform in [0, 1), from
    doc_id and text, so that reruns agree)."""
    bits = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).cast("double")
    return docs.withColumns(
        {
            "_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
            "_draw": bits / F.lit(float(1 << 53)),
        }
    )


def source_targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """Targets of `(source, source_size)` rows, one per source.

    Sources in code-point order, null last, weigh `weights` in turn and share `share`
    of all words; a target stops at `most` times its source, and the excess is shared
    again by weight. In order of capacity per weight, a source is full exactly when the
    sources before it at their capacity, and the rest at its own ratio, need no more
    than the total.
    """
    ranked = in_order(
        sources.withColumn("_null", F.col("source").isNull()),
        ["_null", "source"],
        F.lit(1).cast("long"),
        "source-rank",
    )
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("before") % len(weights) + 1).cast("int"))
    capped = ranked.withColumns(
        {"weight": turn.cast("double"), "_cap": (F.col("source_size") * most).cast("double")}
    ).drop("before", "_null")
    capped = capped.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    by_ratio = in_order(capped, ["_ratio", "source"], F.col("_cap"), "source-caps")
    by_ratio = by_ratio.withColumnRenamed("before", "_caps")
    by_ratio = in_order(by_ratio, ["_ratio", "source"], F.col("weight"), "source-weights")
    sums = by_ratio.agg(
        (F.sum("source_size") * F.lit(float(share))).alias("_total"), F.sum("weight").alias("_weights")
    )
    # `sums` and `level` are aggregates without keys: one row each.
    full = by_ratio.join(F.broadcast(sums)).withColumn(
        "_full",
        F.col("_ratio") * (F.col("_weights") - F.col("before")) + F.col("_caps") <= F.col("_total"),
    )
    level = full.agg(
        F.coalesce(
            (F.max("_total") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)))
            / F.sum(F.when(~F.col("_full"), F.col("weight"))),
            F.lit(0.0),
        ).alias("_level")
    )
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(
        F.least(F.col("_cap"), F.col("_level") * F.col("weight"))
    )
    return full.join(F.broadcast(level)).select("source", "source_size", target.alias("target"))


def tilted(tilt: Column, size: Column, scale: Column, most: int = MOST) -> Column:
    """Rate of a document: `most` / (1 + exp(-tilt * size / scale)), between 0 and `most`."""
    return F.lit(float(most)) / (F.lit(1.0) + F.exp(-tilt * size / scale))


def balanced(cells: DataFrame, targets: DataFrame, most: int = MOST, rounds: int = 80) -> DataFrame:
    """Solve the dual of every source: `source, source_size, target, scale, tilt`.

    Rates minimise the entropy of (rate, most - rate) against (1, most - 1) subject to the
    words of the source coming to its target; the dual is convex with one variable per
    source. `cells` holds `(source, size, n)`, so a Newton round is one aggregate of
    partial sums over all sources at once. A step outside the bracket found so far is
    halved into it. A full source has no finite optimum: its tilt is null, its rate `most`.
    """
    n, size = F.col("n"), F.col("size").cast("double")
    scale = cells.where("size > 0").groupBy("source").agg(
        (F.sum(n * size * size) / F.sum(n * size)).alias("scale")
    )
    # A source without words takes nothing.
    share = F.try_divide(F.col("target"), F.col("source_size") * most)
    open_ = (F.col("source_size") > 0) & (share < 1 - 1e-12) & (share > 0)
    joined = targets.join(
        scale.withColumnRenamed("source", "_s"), _is(F.col("source"), F.col("_s")), "left"
    ).drop("_s")
    state = joined.withColumns(
        {
            "open": F.coalesce(open_, F.lit(False)),
            "tilt": F.when(open_, F.log(share / (1 - share))),
            "low": F.lit(None).cast("double"),
            "high": F.lit(None).cast("double"),
        }
    )
    state = stored(state, "tilts")
    for _ in range(rounds):
        tilt = state.where("open").select(
            F.col("source").alias("_s"), "tilt", F.col("scale").alias("_scale")
        )
        rate = tilted(F.col("tilt"), size, F.col("_scale"), most)
        sums = (
            cells.where("size > 0")
            .join(tilt, _is(F.col("source"), F.col("_s")))
            .groupBy("_s")
            .agg(
                F.sum(n * rate * size).alias("_words"),
                F.sum(n * rate * (1 - rate / most) * size * size / F.col("_scale")).alias("_slope"),
            )
        )
        miss = F.col("_words") - F.col("target")
        step = F.col("tilt") - miss / F.col("_slope")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        reach = F.abs(F.col("tilt")) + 1
        state = state.join(sums, _is(F.col("source"), F.col("_s")), "left").drop("_s")
        state = state.withColumns({"low": low, "high": high, "_miss": miss, "_step": step})
        bounded = F.when(
            F.col("low").isNotNull() & F.col("high").isNotNull()
            & ~F.col("_step").between(F.col("low"), F.col("high")),
            (F.col("low") + F.col("high")) / 2,
        ).otherwise(
            F.greatest(
                F.least(F.coalesce("_step", "tilt"), F.col("tilt") + 4 * reach),
                F.col("tilt") - 4 * reach,
            )
        )
        settled = F.abs(F.col("_miss")) <= 1e-9 * F.col("target")
        state = state.withColumns(
            {"tilt": F.when(settled, F.col("tilt")).otherwise(bounded), "_done": settled}
        )
        state = stored(state.drop("_words", "_slope", "_miss", "_step"), "tilts")
        left = state.where("open and not coalesce(_done, true)").count()
        state = state.drop("_done")
        if not left:
            break
    else:
        raise RuntimeError(f"{left} sources have not settled after {rounds} rounds")
    full = F.when(share >= 1 - 1e-12, F.lit(None)).otherwise(F.lit(float("-inf")))
    return state.select(
        "source",
        "source_size",
        "target",
        F.coalesce("scale", F.lit(1.0)).alias("scale"),
        F.when(F.col("open"), F.col("tilt")).otherwise(full).alias("tilt"),
    )


def _rate(size: Column, most: int) -> Column:
    return F.when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(
        F.when(size > 0, tilted(F.col("tilt"), size.cast("double"), F.col("scale"), most)).otherwise(0.0)
    )


def _class(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")


def _step(draw: Column, part: Column) -> Column:
    odds = draw / part
    return F.floor(STEPS * odds / (1 + odds)).cast("int")


def rounding(rows: DataFrame, tilts: DataFrame, most: int = MOST) -> DataFrame:
    """`tilts` with `limits`: per size class, the last step at which a rate is rounded up.

    Rounding up whenever the draw is below the fraction gets a source near its target
    only on average. So the limit of each size class is set where the words taken come
    nearest to those wanted, from the largest class down; what one class misses is
    wanted from the next. Per source there are at most `STEPS` sums in each class.
    """
    size = F.col("_size")
    rate = _rate(size, most)
    joined = rows.where(size > 0).select(F.col("source").alias("_s"), "_size", "_draw")
    joined = joined.join(tilts, _is(F.col("source"), F.col("_s")))
    part = joined.withColumn("_part", rate - F.floor(rate)).where("_part > 0")
    sums = part.groupBy(
        "source", _class(size).alias("_class"), _step(F.col("_draw"), F.col("_part")).alias("_at")
    ).agg(F.sum("_size").alias("_words"), F.sum(size * F.col("_part")).alias("_want"))
    upto = Window.partitionBy("source", "_class").orderBy("_at")
    classes = (
        sums.withColumn("_words", F.sum("_words").over(upto).cast("double"))
        .groupBy("source", "_class")
        .agg(F.collect_list(F.struct("_words", "_at")).alias("at"), F.sum("_want").alias("want"))
    )
    per_source = classes.groupBy(F.col("source").alias("_s")).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("_class")).alias("order"), "want", "at"))).alias("c")
    )
    none = F.struct(F.lit(0.0).alias("_words"), F.lit(-1).alias("_at"))
    limit_type = "array<struct<class:int,at:int>>"

    def settle(state: Column, one: Column) -> Column:
        wanted = state["carry"] + one["want"]
        choices = F.concat(F.array(none), one["at"])
        best = F.array_min(
            F.transform(
                choices,
                lambda x: F.struct(F.abs(x["_words"] - wanted).alias("off"), x["_at"].alias("at"), x["_words"].alias("words")),
            )
        )
        limit = F.struct((-one["order"]).cast("int").alias("class"), best["at"].alias("at"))
        return F.struct(
            (wanted - best["words"]).alias("carry"),
            F.concat(state["limits"], F.array(limit)).cast(limit_type).alias("limits"),
        )

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast(limit_type).alias("limits"))
    limits = per_source.select("_s", F.aggregate("c", start, settle)["limits"].alias("limits"))
    return tilts.join(limits, _is(F.col("source"), F.col("_s")), "left").drop("_s")


ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of `docs` with `size, source_size, target, rate, copies, taken`.

    Needs `doc_id, text, source`; columns of `docs` with the added names are replaced, and
    all others keep their values, whatever they are called.

    - Null text has size 0, a null source is a source of its own and last in order.
    - Size 0 takes nothing, and a source without words has target 0. With no words at all
      every target is 0.
    - Rows that repeat doc_id and text get the same number of copies.
    - An empty table gives no rows.
    """
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ADDED]
    return _copied(docs, weights, share, most).select(*own, *ADDED)


def _copied(docs: DataFrame, weights, share: float, most: int) -> DataFrame:
    """`row`, a struct of the columns of `docs`, and the added columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = measured(docs.select(row, "doc_id", "text", "source")).drop("doc_id", "text")
    narrow = stored(measured(docs.select("doc_id", "text", "source")).select("source", "_size", "_draw"), "sizes")
    cells = stored(
        narrow.groupBy("source", F.col("_size").alias("size")).agg(F.count("*").alias("n")), "cells"
    )
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stored(source_targets(sources, weights, share, most), "targets")
    tilts = balanced(cells, targets, most)
    plan = stored(rounding(narrow, tilts, most), "rounding")
    plan = plan.select(
        F.col("source").alias("_s"), "source_size", "target", "scale", "tilt", "limits"
    )
    rows = rows.join(plan, _is(F.col("source"), F.col("_s")))
    rate = _rate(F.col("_size"), most)
    rows = rows.withColumn("rate", rate).withColumn("_part", F.col("rate") - F.floor("rate"))
    limit = F.filter("limits", lambda x: x["class"] == _class(F.col("_size")))
    up = (F.col("_part") > 0) & (
        _step(F.col("_draw"), F.col("_part")) <= F.coalesce(F.get(limit, F.lit(0))["at"], F.lit(-1))
    )
    count = F.floor("rate") + F.coalesce(up, F.lit(False)).cast("long")
    rows = rows.withColumn("copies", F.when(F.col("_size") > 0, count).otherwise(0).cast("long"))
    rows = rows.withColumn("taken", F.col("copies") * F.col("_size"))
    return rows.withColumnRenamed("_size", "size").select("row", *ADDED)


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: every row as often as it is copied, with the columns of `docs` as they
    are; cases as for `copies`."""
    repeated = _copied(docs, weights, share, most).where("copies > 0")
    repeated = repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("row.*")

"""Helpers of the corpus operators: stored intermediates, orders over all tasks, connected groups."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.plans.scratch import drop_folder, new_folder, no_shuffle_left
from candlewick.plans.shipping import ship_package

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it again.

    Cuts the lineage, and what was computed once is not computed again when an
    executor is lost. The shuffle files of the write go with it.
    """
    path = new_folder(df.sparkSession, label)
    with no_shuffle_left(df.sparkSession):
        df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[kept] = path
    return kept


def dropped(*frames: DataFrame) -> None:
    """Remove the folders of stored frames: nothing may read them any more, nor what is
    computed from them and not stored."""
    for df in frames:
        if path := _folders.pop(df, None):
            drop_folder(df.sparkSession, path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it if the frame has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """`mapInArrow` with a function of this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def in_order(df: DataFrame, order: list[str], value: Column, label: str) -> DataFrame:
    """Add `before`: the sum of `value` over all rows earlier in the given order.

    The rows are range-partitioned, so no task sees more than its share; only one
    total per task meets in one place. `df` is stored, and should be narrow.
    """
    spread = df.withColumn("_value", value).repartitionByRange(*order)
    kept = stored(spread.withColumn("_task", F.spark_partition_id()), label)
    totals = kept.groupBy("_task").agg(F.sum("_value").alias("_total"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_task", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_task").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = kept.withColumn("_upto", F.sum("_value").over(inside))
    # One row per task of the shuffle above: its size does not follow the data.
    return (
        placed.join(F.broadcast(base), "_task")
        .withColumn("before", F.col("_upto") - F.col("_value") + F.col("_base"))
        .drop("_task", "_value", "_upto", "_base")
    )


def groups_of(edges: DataFrame, label: str) -> DataFrame:
    """Connected groups: `(a, b)` edges of any orderable type to `(node, root)`.

    `root` is the smallest node of the group. Alternates large-star and small-star
    rounds; every round is stored, and ends when the edges no longer change. An
    edge is held once, so a group of any size is never gathered in one task: the
    minimum of a node's neighbours is an aggregate.
    """

    def star(pairs: DataFrame) -> DataFrame:
        """Hang every neighbour of a node, and the node, on the smallest of them."""
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return pairs.join(least, "u")

    edges = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = stored(edges.distinct(), f"{label}-edges")
    tally = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("t")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = star(large.where("u <> v").distinct())
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        edges, last = stored(hung.where("u <> v").distinct(), f"{label}-round"), edges
        dropped(last)
        after = edges.agg(F.count("*").alias("n"), tally).first()
        if before == after:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots)

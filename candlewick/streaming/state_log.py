"""A table of keyed state as a log of what each micro-batch changed.

Batch N writes the rows it changed, merged with the tables whose sizes make up the next
power of two: before batch 13 there are tables of batches 0-7, 8-11 and 12, and after it
those of 0-7, 8-11 and 12-13. A row is so rewritten a few times in its life (the logarithm
of the number of batches), whatever the size of the state, and a read looks into as few
tables. Tables are parted by buckets of the key, and only the buckets asked for are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.plans.scratch import drop_folder

BUCKETS = 16
_BUCKET, _VERSION = "_bucket", "_version"


def live_spans(batch_id: int) -> list[tuple[int, int]]:
    """First and last batch of each table that holds state before a batch."""
    spans, low = [], 0
    for bit in reversed(range(batch_id.bit_length())):
        if batch_id >> bit & 1:
            spans.append((low, low + (1 << bit) - 1))
            low += 1 << bit
    return spans


class StateLog:
    """State rows by key. `schema` has the key and whatever a key's state is.

    What batch N reads was written by earlier batches and is not touched while N runs, and
    what it writes has a name of its own: a batch that runs again reads and writes the same.
    Tables that no batch can read any more are removed when the next batch begins.
    """

    def __init__(
        self, spark: SparkSession, folder: str, schema: T.StructType, key: str, buckets: int = BUCKETS
    ) -> None:
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder, schema, key, buckets

    def _path(self, span: tuple[int, int] | None) -> str:
        return f"{self.folder}/warm" if span is None else f"{self.folder}/batches-{span[0]}-{span[1]}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _store(self, rows: DataFrame, path: str) -> None:
        parted = rows.select(*self.schema.fieldNames(), self._bucket().alias(_BUCKET))
        parted.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(path)

    def _table(self, span: tuple[int, int] | None) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField(_BUCKET, T.IntegerType())])
        rows = self.spark.read.schema(stored).parquet(self._path(span))
        return rows.withColumn(_VERSION, F.lit(-1 if span is None else span[1]))

    def start(self, warm: DataFrame) -> None:
        """State from before the first batch. A restart keeps what it finds."""
        try:
            self._table(None)
        except AnalysisException:
            self._store(warm, self._path(None))

    def _tables(self, spans: list[tuple[int, int]], warm: bool) -> list[DataFrame]:
        tables = [self._table(span) for span in spans]
        if warm:
            try:
                tables.append(self._table(None))
            except AnalysisException:
                pass
        return tables

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.fieldNames() if c != self.key]
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), _VERSION).alias("_row"))
        return newest.select(self.key, "_row.*").select(*self.schema.fieldNames())

    def before(self, batch_id: int, keys: DataFrame) -> DataFrame:
        """State of the given keys before a batch. `keys` has the key column, and is read twice."""
        tables = self._tables(live_spans(batch_id), warm=True)
        if not tables:
            return self.spark.createDataFrame([], self.schema)
        # As many numbers as there are buckets at most.
        touched = [r[0] for r in keys.select(self._bucket()).distinct().collect()]
        rows = reduce(DataFrame.unionByName, [t.where(F.col(_BUCKET).isin(touched)) for t in tables])
        wanted = keys.select(self.key).distinct()
        return self._latest(rows.join(wanted, self.key, "left_semi"))

    def write(self, batch_id: int, changed: DataFrame) -> None:
        """Store the state of the keys that a batch changed."""
        size = (batch_id + 1) & -(batch_id + 1)
        first = batch_id + 1 - size
        merged = [span for span in live_spans(batch_id) if span[0] >= first]
        rows = changed.select(*self.schema.fieldNames())
        if merged:
            rows = rows.withColumn(_VERSION, F.lit(batch_id))
            older = [t.drop(_BUCKET) for t in self._tables(merged, warm=False)]
            rows = self._latest(reduce(DataFrame.unionByName, [rows, *older]))
        self._store(rows, self._path((first, batch_id)))

    def clean(self, batch_id: int) -> None:
        """Remove what only the batch before this one could read."""
        for span in set(live_spans(batch_id - 1)) - set(live_spans(batch_id)) if batch_id else ():
            drop_folder(self.spark, self._path(span))

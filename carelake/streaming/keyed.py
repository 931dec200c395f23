"""A keyed result table that micro-batches merge into, compacted as it grows.

Each micro-batch writes the rows it changed to a delta folder. After every ``every`` batches the
deltas of that group are merged by key with the base into a new base. Two base folders and
``2 * every`` delta folders are written in turn, so the number of folders never grows, and
nothing is deleted apart from Spark's own overwrite of a folder whose rows have been merged
at least one generation ago.

Retries are safe: a batch always writes the same folder, and a compaction reads the other base
folder and the deltas of its own group, never what it writes. A folder whose write has not
committed holds no rows. Every row carries the batch it is of, so a reader takes the newest
base and the deltas after it.

``combine`` says what a row of a batch means: ``latest`` (the state of its key, as an update-mode
aggregate gives it) or ``sum`` (an increment).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

BATCH = "batch_id"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], combine: str = "latest", every: int = 4):
        if combine not in ("latest", "sum"):
            raise ValueError(combine)
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.spark, self.path, self.keys, self.combine, self.every = spark, path.rstrip("/"), list(keys), combine, every
        self.values = [f.name for f in schema if f.name not in keys]
        self.schema = StructType([f for f in schema if f.name != BATCH] + [StructField(BATCH, LongType())])

    # ---------------------------------------------------------------- folders
    def _delta(self, batch: int) -> str:
        return f"{self.path}/deltas/slot={batch % (2 * self.every)}"

    def _base(self, group: int) -> str:
        return f"{self.path}/bases/slot={group % 2}"

    def _rows(self, folder: str) -> DataFrame:
        """Rows of a folder; none if nothing has been written there yet."""
        try:
            return self.spark.read.schema(self.schema).parquet(folder).select(*self.schema.names)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    # ---------------------------------------------------------------- writing
    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Take a micro-batch; the last one of a group also compacts it."""
        batch.select(*self.keys, *self.values, F.lit(batch_id).cast("bigint").alias(BATCH)).write.mode("overwrite").parquet(self._delta(batch_id))
        group, place = divmod(batch_id, self.every)
        if place == self.every - 1:
            rows = self._rows(self._base(group - 1)).where(F.col(BATCH) < group * self.every)
            for b in range(group * self.every, batch_id + 1):
                rows = rows.unionByName(self._rows(self._delta(b)).where(F.col(BATCH) == b))
            self._combined(rows).select(*self.keys, *self.values, F.lit(batch_id).cast("bigint").alias(BATCH)).write.mode(
                "overwrite").parquet(self._base(group))

    # ---------------------------------------------------------------- reading
    def _combined(self, rows: DataFrame) -> DataFrame:
        if self.combine == "sum":
            types = {f.name: f.dataType for f in self.schema}
            return rows.groupBy(*self.keys).agg(*[F.sum(v).cast(types[v]).alias(v) for v in self.values])
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.values), BATCH).alias("s")).select(*self.keys, "s.*")

    def read(self) -> DataFrame:
        """One current row per key."""
        bases, deltas = self._rows(f"{self.path}/bases"), self._rows(f"{self.path}/deltas")
        upto = F.coalesce(bases.select(F.max(BATCH)).scalar(), F.lit(-1))
        rows = bases.where(F.col(BATCH) == upto).unionByName(deltas.where(F.col(BATCH) > upto))
        return self._combined(rows).select(*self.keys, *self.values)


def run_into(stream: DataFrame, table: KeyedTable, checkpoint: str, mode: str = "update") -> None:
    """Run a streaming query over everything that has landed, merging each batch into ``table``."""
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
               .foreachBatch(table.merge).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))

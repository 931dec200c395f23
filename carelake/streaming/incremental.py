"""STR-01 / STR-02: incremental aggregates with Structured Streaming.

Files land in a directory; ``readStream`` (explicit schema) picks them up; the
aggregate state lives in the streaming checkpoint. In update mode a micro-batch merges only the
groups it changed into a keyed table that is compacted as it grows (``streaming.keyed``); in
complete mode it rewrites the result. Both overwrite by batch (``foreachBatch``), so a
retried batch or a restarted query gives the same table. ``trigger(availableNow=True)``
processes everything that has landed and stops - the batch-equivalent mode for tests and
scheduled runs; on a cluster the same query can run with a processing-time trigger.

All paths live under the session's ``spark.checkpoint.dir`` (a shared folder on a
cluster), never under a machine-local temp dir.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.functions.expr import money
from carelake.session import ensure_checkpoint_dir
from carelake.streaming.keyed import KeyedTable, run_into


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def land_files(df: DataFrame, path: str, partition_by: str, fmt: str = "parquet") -> None:
    """Write a frame as the arriving files of a landing zone (one folder per partition value)."""
    df.write.mode("overwrite").partitionBy(partition_by).format(fmt).save(path)


def run_available_now(stream: DataFrame, out_path: str, ckpt_path: str, mode: str = "complete", keys: list[str] | None = None,
                      every: int = 4) -> None:
    """Run a streaming aggregate to completion: complete mode overwrites the result per batch, update
    mode merges the changed groups into a keyed table (``keys``), compacted every few batches."""
    if mode == "update":
        run_into(stream, KeyedTable(stream.sparkSession, out_path, stream.schema, keys or SALES_KEYS, "latest", every), ckpt_path)
        return

    def write_batch(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(out_path)
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt_path)
               .foreachBatch(write_batch).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


# ------------------------------------------------------------------ STR-01
def sales_monthly_query(spark: SparkSession, landing: str, schema, files_per_trigger: int = 2) -> DataFrame:
    """The streaming aggregate over a sales landing folder (patient x 'YYYY-MM')."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)
                 .groupBy("patient_type", F.col("ym").alias("month"))
                 .agg(F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost"), F.sum("qty").alias("qty"),
                      F.count(F.lit(1)).alias("lines")))


SALES_KEYS = ["patient_type", "month"]
SALES_STATE = "patient_type string, month string, revenue decimal(38,6), cost decimal(38,6), qty decimal(38,2), lines bigint"


def read_sales_result(spark: SparkSession, out: str, every: int = 4) -> DataFrame:
    """The current sales groups of a result folder."""
    rows = KeyedTable(spark, out, SALES_STATE, SALES_KEYS, "latest", every).read()
    return rows.select("patient_type", "month", money("revenue").alias("revenue"), money("cost").alias("cost"),
                       money("qty").alias("qty"), "lines")


def stream_sales_monthly(spark: SparkSession, sales_line: DataFrame, files_per_trigger: int = 2) -> DataFrame:
    """STR-01: sales lines arrive as monthly files; patient x month aggregates are kept
    incrementally. The result equals the batch SAL-02 ``sales_monthly`` grain."""
    base = work_dir(spark, "sales-stream")
    landing = f"{base}/landing"
    land_files(sales_line.withColumn("ym", F.date_format("sale_date", "yyyy-MM")), landing, "ym")
    schema = spark.read.parquet(landing).schema
    out = f"{base}/result"
    run_available_now(sales_monthly_query(spark, landing, schema, files_per_trigger), out,
                      f"{base}/_checkpoint", "update")
    return read_sales_result(spark, out)


# ------------------------------------------------------------------ STR-02
def stream_daily_totals(spark: SparkSession, events: DataFrame, watermark: str = "7 days",
                        files_per_trigger: int = 5) -> DataFrame:
    """STR-02: daily event totals with a watermark; complete mode keeps late rows in
    their day (append mode would emit only windows behind the watermark)."""
    base = work_dir(spark, "daily-stream")
    landing = f"{base}/landing"
    land_files(events.withColumn("day", F.to_date("ts")), landing, "day")
    schema = spark.read.parquet(landing).schema
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)
              .withColumn("ts", F.col("ts").cast("timestamp"))          # TIMESTAMP_NTZ -> TIMESTAMP
              .withWatermark("ts", watermark)
              .groupBy(F.window("ts", "1 day").alias("w"))
              .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum"),
                   F.count_if(F.col("event_type") == "error").alias("errors")))
    out = f"{base}/result"
    run_available_now(s, out, f"{base}/_checkpoint", "complete")
    return spark.read.parquet(out).select(F.to_date("w.start").alias("day"), "events",
                                          F.round("value_sum", 4).alias("value_sum"), "errors")


DAY_TOTALS = "day date, events bigint, value_sum double, errors bigint"
DAY_ARRIVALS = "day date, arrived bigint"


def arriving_events(spark: SparkSession, landing: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    return reader.parquet(landing).withColumn("ts", F.col("ts").cast("timestamp"))      # TIMESTAMP_NTZ -> TIMESTAMP


def run_daily_with_late(spark: SparkSession, landing: str, schema, base: str, watermark: str = "7 days",
                        files_per_trigger: int | None = None, every: int = 4) -> None:
    """STR-02, the incremental form: take what has landed since the last run.

    Two queries read the landing folder. One keeps the open days as keyed state with an event-time
    watermark: update mode returns the days that changed, the watermark closes a day once it
    has passed its end, which removes its state and drops rows that come after. The other
    needs no state: it counts what arrived by day, whenever it did. What arrived and is
    in no total came behind the watermark.
    """
    on_time = (arriving_events(spark, landing, schema, files_per_trigger).withWatermark("ts", watermark)
               .groupBy(F.window("ts", "1 day").alias("w"))
               .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum"),
                    F.count_if(F.col("event_type") == "error").alias("errors"))
               .select(F.to_date("w.start").alias("day"), "events", "value_sum", "errors"))
    run_into(on_time, _day_table(spark, base, "totals", every), f"{base}/_totals-checkpoint")

    table = _day_table(spark, base, "arrivals", every)

    def count(batch: DataFrame, batch_id: int):
        table.merge(batch.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("arrived")), batch_id)
    q = (arriving_events(spark, landing, schema, files_per_trigger).writeStream.option("checkpointLocation", f"{base}/_arrivals-checkpoint")
         .foreachBatch(count).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _day_table(spark: SparkSession, base: str, name: str, every: int) -> KeyedTable:
    ddl, combine = (DAY_TOTALS, "latest") if name == "totals" else (DAY_ARRIVALS, "sum")
    return KeyedTable(spark, f"{base}/{name}", ddl, ["day"], combine, every)


def read_daily_with_late(spark: SparkSession, base: str, every: int = 4) -> DataFrame:
    """(day, events, value_sum, errors, late): totals of the rows that came in time, and how many did not."""
    totals, arrivals = _day_table(spark, base, "totals", every).read(), _day_table(spark, base, "arrivals", every).read()
    both = arrivals.select("day", "arrived", *[F.lit(None).cast(t).alias(n) for n, t in (("events", "bigint"), ("value_sum", "double"), ("errors", "bigint"))])
    rows = both.unionByName(totals.withColumn("arrived", F.lit(None).cast("bigint")))
    events = F.coalesce(F.max("events"), F.lit(0))
    return rows.groupBy("day").agg(events.alias("events"), F.round(F.max("value_sum"), 4).alias("value_sum"),
                                   F.coalesce(F.max("errors"), F.lit(0)).alias("errors"),
                                   (F.max("arrived") - events).alias("late"))


def stream_daily_late(spark: SparkSession, events: DataFrame, watermark: str = "7 days", late_every: int = 50) -> DataFrame:
    """STR-02 over events of which one in ``late_every`` arrives in a second wave, after the others have
    moved the watermark: the second run restarts from the checkpoint and counts them as late
    where their day was closed."""
    base = work_dir(spark, "daily-late")
    landing = f"{base}/landing"
    rows = events.withColumn("day", F.to_date("ts"))
    second = F.pmod(F.col("event_id"), F.lit(late_every)) == 0
    rows.where(~second).write.mode("append").partitionBy("day").parquet(landing)
    schema = spark.read.parquet(landing).schema
    run_daily_with_late(spark, landing, schema, base, watermark)
    rows.where(second).write.mode("append").partitionBy("day").parquet(landing)
    run_daily_with_late(spark, landing, schema, base, watermark)
    return read_daily_with_late(spark, base)


def daily_totals_batch(events: DataFrame) -> DataFrame:
    """Batch twin of STR-02 (used to check stream = batch)."""
    return (events.groupBy(F.to_date(F.col("ts").cast("timestamp")).alias("day"))
                  .agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value_sum"),
                       F.count_if(F.col("event_type") == "error").alias("errors")))

"""Incremental forms of the two operations that are upserts by nature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import warehouse
from ledgerlark.sources.shared import scratch, stored, swap

#: Days after the newest filing from which a row counts as late.
LATE_DAYS = 30


def deduplicated_stream(events: DataFrame, key=("event_id",), time: str = "ts", late: str = "1 day") -> DataFrame:
    """J15 as a stream: each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def daily_summary_stream(spark: SparkSession, path: str) -> DataFrame:
    """A12 as a stream: daily summaries of events, upserted batch by batch.

    Each batch adds partial counts under its own number, which a batch that
    runs again replaces; the summary reads them together.  Distinct users are
    kept as rows, so that they add up over batches.
    """
    base = scratch(spark, "daily")
    one = spark.read.parquet(path)
    folder, name = path.rsplit("/", 1)
    source = spark.readStream.schema(one.schema).option("pathGlobFilter", name).parquet(folder) if path.endswith(".parquet") and _is_file(spark, path) else spark.readStream.schema(one.schema).parquet(path)

    def put(batch: DataFrame, number: int) -> None:
        partial = batch.groupBy("event_type", F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,4)")).alias("total"))
        partial.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    deduplicated = deduplicated_stream(source.withColumn("ts", F.col("ts").cast("timestamp")))
    query = deduplicated.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/rows")
    return rows.groupBy("event_type", "day").agg(F.sum("n").alias("n"), F.round(F.sum("total").cast("double"), 4).alias("total"), F.count_distinct("user_id").alias("users"))


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()


def summarise_trades(facts: DataFrame, base: str, kinds: DataFrame, years=warehouse.FACT_YEARS, late_days: int = LATE_DAYS) -> DataFrame:
    """A12 and J15 as a stream over facts: what is there is read batch by batch into ``base``; returns the daily summary of all batches so far.

    A batch's facts are inserted unless known, and the days that it touches
    are summed up anew from the stored facts, so late rows count, repeated ones
    don't, and a batch that runs again changes nothing.  Rows filed
    ``late_days`` before the newest filing of earlier batches are also kept in
    the side table ``late``.
    """
    spark, key = facts.sparkSession, ["company_key", "transaction_date"]

    def put(batch: DataFrame, number: int) -> None:
        known = stored(spark, f"{base}/facts")
        newest = None if known is None else known.agg(F.max("filing_date")).first()[0]
        if stored(spark, f"{base}/late/batch={number}") is None:
            late = batch.filter(F.col("filing_date") < F.date_sub(F.lit(newest).cast("date"), late_days))
            late.write.parquet(f"{base}/late/batch={number}")
        warehouse.merge_facts(batch, f"{base}/facts", years)
        touched = stored(spark, f"{base}/facts").join(batch.select(*key).distinct(), key, "left_semi")
        fresh, before = warehouse.daily_summary(touched, kinds), stored(spark, f"{base}/daily")
        swap(fresh if before is None else warehouse.upsert(before, fresh, ["company_key", "date"]), f"{base}/daily")

    facts.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return stored(spark, f"{base}/daily")

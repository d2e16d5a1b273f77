"""Structured Streaming over the event log (survey rows R3-R5, M2, F3)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.streaming.ordered import Closer, InOrder, Machine, in_order


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 64) -> DataFrame:
    """The events as a stream of files; ``ts`` becomes an instant, so that it can carry a watermark."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(day, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


def without_repeats(events: DataFrame, keys: list[str], late: str = "3650 days") -> DataFrame:
    """The first row of each key; state lives for ``late`` after a key was seen."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name in ``spark.checkpoint.dir``; where that is unset, in a temporary one, if the session runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallyforge-")
    return f"{base.rstrip('/')}/stream_{uuid.uuid4().hex}"


#: The state that each type of event moves a job to; others fail it.
STEPS = {"view": "processing", "click": "extracted", "purchase": "approved"}


def jobs_to_states(events: DataFrame) -> DataFrame:
    """The event log as steps of jobs: a job is a user."""
    to = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in STEPS.items()), F.lit("failed"))
    return events.select(F.col("user_id").alias("job"), "ts", F.col("event_id").alias("tie"), to.alias("to"))


def replay(events: DataFrame, key: str, processor: InOrder, late: str, base: str, ended: bool = True) -> DataFrame:
    """Run ``events`` through ``processor`` (see ``in_order``) as far as there are files, and give all rows told so far.

    ``base`` is the run's folder: called again with it, the run goes on with what is new. Where the log has ``ended`` a marker far in
    the future follows it, so that the watermark passes all that waits; what comes after that is late.
    """
    spark = events.sparkSession
    spark.createDataFrame([], events.schema).write.mode("ignore").parquet(f"{base}/marker")
    marker = spark.readStream.schema(events.schema).parquet(f"{base}/marker")
    rows = in_order(events.unionByName(marker), key, processor, late)

    def run() -> None:
        rows.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()

    run()
    if ended:
        end = F.timestamp_micros(F.lit(FOREVER)).alias("ts")
        spark.range(1).select(*(end if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema)).write.mode("append").parquet(f"{base}/marker")
        run()
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


#: A time that no event has, in microseconds: the year 9000.
FOREVER = 221_845_392_000_000_000


def state_machine(events: DataFrame, late: str = "3650 days") -> DataFrame:
    """M2: per job (user) the transitions in order of time, whatever files and triggers bring them; steps that aren't valid leave the job where it is.

    Valid steps and dead letters (``valid`` false) come in one table; events later than ``late`` allows come with ``late`` true and no verdict.
    """
    told = replay(jobs_to_states(events), "job", Machine(), late, shared_folder(events.sparkSession))
    return told.select(F.col("job").alias("user_id"), F.col("tie").alias("event_id"), "from_state", "to_state", "valid", "late")


def closed_batches(events: DataFrame, minutes: int, late: str = "3650 days") -> DataFrame:
    """The closes of batches of jobs, once a template each. In the event log a batch is a user, a job of it one of three by the event's number, the template a name by the job."""
    kind = F.col("event_type")
    status = F.when(kind == "view", "processing").when(kind == "click", "rejected").when(kind == "purchase", "approved").when(kind == "signup", "ready_for_review").otherwise("failed")
    job = F.col("event_id") % 3
    log = events.select(F.col("user_id").alias("batch"), "ts", F.col("event_id").alias("tie"), job.alias("job"), F.when(job == 0, "daily").otherwise("weekly").alias("template"), status.alias("status"))
    return replay(log, "batch", Closer(minutes), late, shared_folder(events.sparkSession))


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that there is and give its rows: to files in the shared folder (append), or to a table in memory (complete)."""
    spark = stream.sparkSession
    base = shared_folder(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/log").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")

    def keep(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows")

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")

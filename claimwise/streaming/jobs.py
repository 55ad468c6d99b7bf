"""Structured Streaming jobs.

Each job reads a file stream (new Parquet files in a folder), runs with
``trigger(availableNow=True)`` (process everything present, then stop) and
keeps its progress in a checkpoint folder under ``spark.checkpoint.dir``, so
a restarted or failed run resumes exactly where it stopped.  Sinks are
Parquet folders written by ``foreachBatch`` (idempotent per batch id) — no
driver-side memory sink.

Bounds.  ``max_files`` limits a micro-batch.  Event time runs against one
``delay``: the ingest marks rows that come later than it (they are kept, as
``late``, for a batch job to fold in), and the stateful jobs behind it use a
watermark a little longer, so they forget what no on-time row can still touch and
drop nothing themselves.  Run them once per ingested batch, as ``replay`` does: their
watermark then trails the ingest's by a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..plans.clean import clean_claim_rows

DELAY = "120 days"          # on-time rows are at most so far behind the newest one before their batch
WATERMARK = "121 days"
LOGIN_TTL = "90 days"       # a user unseen for so long is forgotten


def file_stream(spark: SparkSession, folder: str, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """A Parquet file stream over a landing folder (optionally only the
    files matching ``glob``), schema taken from the files present."""
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    schema = r.parquet(folder).schema
    rs = spark.readStream.schema(schema)
    if glob:
        rs = rs.option("pathGlobFilter", glob)
    if max_files:
        rs = rs.option("maxFilesPerTrigger", max_files)
    return rs.parquet(folder)


def _batch_writer(path: str):
    """foreachBatch sink: each batch goes to its own ``batch_id=`` folder
    (overwritten on replay, so a re-run batch never duplicates rows)."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}", compression="zstd")
    return write


def run_available(df: DataFrame, sink: str | None, checkpoint: str, mode: str = "append", write: Callable | None = None):
    """Process what is there and stop; returns the query (its progress tells the state's size)."""
    q = (df.writeStream.outputMode(mode).foreachBatch(write or _batch_writer(sink))
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def _batches(spark: SparkSession, folder: str) -> dict[int, str]:
    """Batch number -> folder of the batches written whole."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch_id=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    folders = [f.getPath().getParent() for f in found or []]
    return {int(f.getName().removeprefix("batch_id=")): f.toString() for f in folders}


# --------------------------------------------------------------------------
# S1 incremental ingest with late rows apart
# --------------------------------------------------------------------------

MARK = "top timestamp_ntz"


def late_marking_writer(sink: str, event_time: str, delay: str = DELAY) -> Callable:
    """foreachBatch sink that adds ``late``: the row's event time is ``delay`` or more
    behind the newest one of earlier batches.  Those maxima are one row a batch
    beside the sink, so a batch that is run again decides alike.  Rows without event time are on time."""
    marks = f"{sink}-marks"

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        before = [p for b, p in _batches(spark, marks).items() if b < batch_id]
        top = spark.read.schema(MARK).parquet(*before).agg(F.max("top")).first()[0] if before else None
        late = F.coalesce(F.col(event_time) <= F.lit(top).cast("timestamp_ntz") - F.expr(f"interval {delay}"), F.lit(False))
        out = f"{sink}/batch_id={batch_id}"
        df.withColumn("late", late).write.mode("overwrite").parquet(out, compression="zstd")
        spark.read.parquet(out).agg(F.max(event_time).cast("timestamp_ntz").alias("top")).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")

    return write


def ingest_claims(spark: SparkSession, landing_dir: str, orders: DataFrame, sink: str, checkpoint: str,
                  binding, glob: str = "*.parquet", max_files: int | None = None, delay: str = DELAY):
    """New line-item files -> stream-static join with orders -> raw claim
    binding -> the row-local cleaning of the batch layer -> the stg sink, with
    ``late`` rows marked."""
    raw = binding(file_stream(spark, landing_dir, glob, max_files), orders)
    return run_available(clean_claim_rows(raw), None, checkpoint, write=late_marking_writer(sink, "date_sinistre_claim", delay))


def _on_time(spark: SparkSession, stg_dir: str, watermark: str, max_files: int | None) -> DataFrame:
    s = file_stream(spark, stg_dir, max_files=max_files).where("not late and date_sinistre_claim is not null")
    return s.withColumn("_et", F.col("date_sinistre_claim").cast("timestamp")).withWatermark("_et", watermark)


# --------------------------------------------------------------------------
# S5 dedup, S4 windowed KPI
# --------------------------------------------------------------------------

KPI_COLUMNS = ["date_sinistre_claim", "late", "montant_indemnisation_claim", "is_delayed"]     # what ``daily_claim_kpis`` reads


def dedup_claims(spark: SparkSession, stg_dir: str, sink: str, checkpoint: str, whole_rows: bool = False,
                 watermark: str = WATERMARK, max_files: int | None = None, keep: list[str] | None = None):
    """The first row of each claim id, or each different row (``whole_rows``),
    among the rows on time.  A key is held until the watermark passes it.  The sink gets
    all columns, or the claim id and those that its reader wants (``keep``); rows differ by all."""
    s = _on_time(spark, stg_dir, watermark, max_files).drop("batch_id")
    keys = ["claim_id"]
    if whole_rows:
        s = s.withColumn("_row", F.xxhash64(*[c for c in s.columns if c != "_et"]))
        keys = ["claim_id", "_row"]
    if keep is not None:
        s = s.select(*dict.fromkeys([*keys, *keep]), "_et")
    return run_available(s.dropDuplicatesWithinWatermark(keys).drop("_et", "_row"), sink, checkpoint)


def daily_claim_kpis(spark: SparkSession, stg_dir: str, sink: str, checkpoint: str,
                     watermark: str = WATERMARK, max_files: int | None = None):
    """Claims per event-time day (count, payout sum, delayed count); update
    mode — each batch emits the windows it changed, a day's state goes once the
    watermark has passed its end."""
    agg = (_on_time(spark, stg_dir, watermark, max_files)
             .groupBy(F.window("_et", "1 day").alias("w"))
             .agg(F.count(F.lit(1)).alias("claims"),
                  F.sum(F.col("montant_indemnisation_claim").cast("decimal(28,6)")).cast("double").alias("payout"),    # exact in any order
                  F.sum("is_delayed").alias("delayed")))
    out = agg.select(F.col("w.start").alias("window_start"), "claims", "payout", "delayed")
    return run_available(out, sink, checkpoint, mode="update")


def latest_per_key(sink_df: DataFrame, key: list[str]) -> DataFrame:
    """Read side of an update-mode sink: the row from the last batch per key."""
    return sink_df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in sink_df.columns if c not in key]),
                                              F.col("batch_id")).alias("_r")).select(*key, "_r.*").drop("batch_id")


def replay(arrivals: list[DataFrame], landing: str, jobs: list[Callable[[], object]]) -> None:
    """Lands the arrivals one by one and runs the jobs, in order, after each."""
    for rows in arrivals:
        rows.write.mode("append").parquet(landing, compression="zstd")
        for job in jobs:
            job()


# --------------------------------------------------------------------------
# S3 login monitor
# --------------------------------------------------------------------------

def login_writer(sink: str, ttl: str = LOGIN_TTL) -> Callable:
    """foreachBatch sink of resolved login attempts: the segmented scan of the batch
    layer over the micro-batch, with the users' state of the batch before carried in.

    A user's rows spread over as many tasks as they fill (segments), and only one row
    per user and segment meets the state.  The state after a batch is a table of
    its own, read by the next batch only (so a batch run again starts from the same
    state); users unseen for ``ttl``, by event time, leave it: it is bounded by the
    users of that span, each with one row."""
    states = f"{sink}-state"

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        earlier = {b: p for b, p in _batches(spark, states).items() if b < batch_id}
        state = spark.read.schema(audit.LOGIN_STATE).parquet(earlier[max(earlier)]) if earlier else None
        known = df.where(F.col("known_user_id").isNotNull()).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
        scan, after = audit.login_scan(known, state)
        failed, success = F.col("event_type") == "LOGIN_FAILED", F.col("event_type") == "LOGIN_SUCCESS"
        run = (F.least(F.col("fails_since_success"), F.lit(audit.K.AUDIT_MAX_LOOKBACK)) + 1).cast("int")
        scan.select("event_id", F.col("known_user_id").alias("user_id"), "login_attempted", "created_at", "event_type", "ip_address",
                    F.when(failed, run).alias("consecutive_failures"), F.when(success, F.col("prev_success_ip")).alias("previous_ip")) \
            .write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        newest = after.agg(F.max("last_seen").alias("_newest"))
        kept = after.crossJoin(F.broadcast(newest)).where(F.col("last_seen") > F.col("_newest") - F.expr(f"interval {ttl}")).drop("_newest")
        kept.write.mode("overwrite").parquet(f"{states}/batch_id={batch_id}")

    return write


def login_monitor(resolved_events: DataFrame, sink: str, checkpoint: str, ttl: str = LOGIN_TTL):
    """S3: per user the run of failures and the previous success IP, over micro-batches."""
    return run_available(resolved_events, None, checkpoint, write=login_writer(sink, ttl))


def login_state(spark: SparkSession, sink: str) -> DataFrame:
    """The users' state after the last batch."""
    found = _batches(spark, f"{sink}-state")
    return spark.read.schema(audit.LOGIN_STATE).parquet(found[max(found)])

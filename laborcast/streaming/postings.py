"""Continuous posting ingest. State is bounded by watermarks; every query needs the caller's checkpoint location."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numbers import plausible_salary, posting_years
from ..functions.places import normalize_city
from ..functions.posting_text import description_quality, duplicate_key, work_mode
from ..operators.postings import MAX_AGE_DAYS
from ..sources.stores import BucketStore, replace_snapshots


def read_postings(spark: SparkSession, path: str, schema: str, *, files_per_trigger: int = 100) -> DataFrame:
    """A folder of JSON postings as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def normalized(stream: DataFrame) -> DataFrame:
    """Normalised postings: title, company, city, mode, experience, salary and duplicate key."""
    text = F.concat_ws("\n", "title", F.coalesce("description", F.lit("")))
    years = posting_years(text)
    fetched = [F.col("fetched_at")] if "fetched_at" in stream.columns else []
    return stream.where(F.trim("title") != "").select(
        *fetched,
        F.trim("title").alias("title"), "company", normalize_city(F.col("location")).alias("location"), "posted_at", work_mode(text).alias("work_mode"),
        description_quality(F.col("description")).alias("description_quality"), years["min"].alias("experience_min"), years["max"].alias("experience_max"),
        plausible_salary(F.col("salary")).alias("salary"), duplicate_key(F.col("title"), F.col("company"), F.col("location")).alias("duplicate_key"))


def first_copies(stream: DataFrame, *, watermark: str = f"{MAX_AGE_DAYS} days") -> DataFrame:
    """First copy of each dated posting within the watermark (R02); of a batch, the earliest. For undated ones see
    :func:`all_first_copies`."""
    if not stream.isStreaming:
        row = F.struct(*stream.columns)
        return stream.where("posted_at IS NOT NULL").groupBy("duplicate_key").agg(F.min_by(row, "posted_at").alias("_r")).select("_r.*")
    return stream.where("posted_at IS NOT NULL").withWatermark("posted_at", watermark).dropDuplicatesWithinWatermark(["duplicate_key"])


def undated(stream: DataFrame) -> DataFrame:
    """Postings without a date, which no watermark of dates can age."""
    return stream.where("posted_at IS NULL")


def all_first_copies(stream: DataFrame, *, fetched: str = "fetched_at", watermark: str = f"{MAX_AGE_DAYS} days", undated_watermark: str | None = None) -> DataFrame:
    """First copies of dated and undated postings in one query (R02, R04); ``event_time`` is the date, or else the fetch time.

    A dated posting is deduplicated among dated ones by its date, an undated one among undated ones by when it was fetched,
    each within a watermark of its own, so both states are bounded. The query's watermark follows the slower of the two as
    long as the session's multiple-watermark policy is ``min``, the default: no posting is late that would not be late
    alone, but a kind that gets no rows holds the other's state back. With ``max`` it follows the faster, state is dropped
    earlier and rows of the slower kind may count as late. As a batch, the earliest copy of each kind is kept.
    """
    kinds = [(stream.where("posted_at IS NOT NULL"), F.col("posted_at"), watermark), (undated(stream), F.col(fetched), undated_watermark or watermark)]
    out = []
    for rows, time, delay in kinds:
        timed = rows.withColumn("event_time", time.cast("timestamp"))
        if stream.isStreaming:
            out.append(timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["duplicate_key"]))
        else:
            row = F.struct(*timed.columns)
            out.append(timed.groupBy("duplicate_key").agg(F.min_by(row, "event_time").alias("_r")).select("_r.*"))
    return out[0].unionByName(out[1])


def velocity(stream: DataFrame, *, role: str = "role", size: str = "7 days", slide: str | None = None, watermark: str = "1 day") -> DataFrame:
    """Postings per role over tumbling or sliding windows."""
    window = F.window("posted_at", size, slide) if slide else F.window("posted_at", size)
    return stream.withWatermark("posted_at", watermark).groupBy(window.alias("w"), role).agg(F.count(F.lit(1)).alias("postings")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), role, "postings")


def keep_latest_markets(stream: DataFrame, path: str, checkpoint: str, by: list[str], trigger: dict | None = None, *, buckets: int = 64):
    """Puts each batch's newest snapshot per market in place of the stored one, in a :class:`BucketStore` at ``path``.

    A batch reads and writes only the buckets of its own markets. One that comes late doesn't replace a newer snapshot, and
    one that is run again after a failure changes nothing. ``trigger`` has the writer's trigger options; without it the stream
    ends when the present input is used up.
    """
    def write(batch: DataFrame, number: int) -> None:
        replace_snapshots(BucketStore(batch.sparkSession, path, by, buckets=buckets), batch, batch_id=f"{checkpoint}:{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))

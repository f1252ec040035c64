"""Keeping reviews current as the library changes: the guarded merge, and its streaming forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.questions import filled
from ..operators.library import latest

GAIN = 5


def worth_flagging(old: str = "old", new: str = "new") -> Column:
    """Whether a new verdict deserves a note beside an answer: another source, and better, or about as good and newer."""

    def o(c: str) -> Column:
        return F.col(f"{old}_{c}")

    def n(c: str) -> Column:
        return F.col(f"{new}_{c}")

    other = ~n("chunk_id").eqNullSafe(o("chunk_id")) & ~(F.coalesce(n("source_id"), F.lit("")) == F.coalesce(F.nullif(o("source_id"), F.lit("")), F.lit("\0")))
    gain = F.coalesce(n("confidence"), F.lit(0)) - F.coalesce(o("confidence"), F.lit(0))
    newer = n("saved_at").isNotNull() & (o("saved_at").isNull() | (n("saved_at") > o("saved_at")))
    return F.coalesce(n("chunk_id").isNotNull() & other & ((gain >= GAIN) | (newer & (gain >= -GAIN))), F.lit(False))


def refreshed(current: DataFrame, verdicts: DataFrame) -> DataFrame:
    """current reviews after a new run: unanswered, untouched rows take the new verdict, all others keep theirs and may gain a note.

    Both have (question_id, status, answer, confidence, chunk_id, source_id, source_name, saved_at); current has touched.
    """
    cols = ["status", "answer", "confidence", "chunk_id", "source_id", "source_name", "saved_at"]
    o = current.select("question_id", "touched", *[F.col(c).alias(f"old_{c}") for c in cols])
    n = verdicts.select("question_id", F.lit(True).alias("has"), *[F.col(c).alias(f"new_{c}") for c in cols])
    j = o.join(n, "question_id", "left")
    free = F.col("has") & ~filled("old_answer") & ~F.coalesce("touched", F.lit(False))
    free = F.coalesce(free, F.lit(False))
    flag = ~free & F.coalesce("has", F.lit(False)) & worth_flagging()
    return j.select(
        "question_id",
        *[F.when(free, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in cols],
        F.when(free, F.lit(False)).otherwise(F.coalesce("touched", F.lit(False))).alias("touched"),
        F.when(flag, F.struct(F.col("new_source_name").alias("source_name"), F.col("new_confidence").alias("score"), F.coalesce("old_confidence", F.lit(0)).alias("previous_score"))).alias("update"),
    )


def acted(current: DataFrame, events: DataFrame) -> DataFrame:
    """current reviews after people's edits, acceptances and choices: the last event of a question counts, in order of seq.

    events: question_id, seq, kind (edit, accept, choose), text, source_type.
    """
    last = latest(events, "question_id", F.col("seq")).select("question_id", "kind", F.col("text").alias("new"), "source_type")
    j = current.join(last, "question_id", "left")
    status = F.when(F.col("kind") == "edit", F.when(~filled("new"), "needs-input").otherwise("answered")).when((F.col("kind") == "choose") & (F.col("source_type") != "qa"), "flagged").otherwise("auto-filled")
    return j.withColumns({"answer": F.when(F.col("kind").isNotNull(), F.coalesce("new", F.lit(""))).otherwise(F.col("answer")), "status": F.when(F.col("kind").isNotNull(), status).otherwise(F.col("status")), "touched": F.coalesce("touched", F.lit(False)) | F.col("kind").isNotNull()}).drop("kind", "new", "source_type")


def on_change(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Runs handle(batch, batch id) for every micro-batch of a change stream; the id lets a handler skip runs it has done."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")).start()


def upserts(path: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A handler that merges each batch of puts and deletes (column op) into the table at path, newest last.

    The table keeps deletes as rows, so a late put never revives a record; every batch writes the next version of the table
    and then moves the pointer file to it, so a batch that is replayed after a failure gives the same table.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v{batch_id - 1}"
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
        old = spark.read.parquet(before) if fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs) else None
        both = batch if old is None else old.unionByName(batch, allowMissingColumns=True)
        latest(both, key, F.struct(*order)).write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return handle


def coalesced(events: DataFrame, key: str, at: str, gap: str = "2 seconds") -> DataFrame:
    """Bursts of a key's events as one: the last of every session, batch or stream (with a watermark on `at`)."""
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max(at).alias("last_at")).select(key, F.col("w.start").alias("started_at"), "last_at", "events")

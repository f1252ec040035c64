"""Collections of records: scopes, orders, projections, migrations and totals.

Every function takes and gives DataFrames; nulls become the defined defaults named at each, empty tables give empty results
(or a row of zeros for totals), and ties in an order go to the id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.questions import filled
from .questions import numbered

#: Longest text of a suggestion that is stored.
STORED_TEXT = 240


def newest() -> list[Column]:
    """The order of a collection: newest first, those without a time last."""
    return [F.desc_nulls_last("saved_at"), F.col("id")]


def listed(rows: DataFrame, owner: str | None = None, gone: DataFrame | None = None) -> DataFrame:
    """The rows of an owner (of all without one), without deleted ids, with their place in the owner's collection."""
    rows = rows if owner is None else rows.filter(F.col("owner_key") == owner)
    rows = rows if gone is None else rows.join(gone.select("id"), "id", "left_anti")
    key = F.struct((-F.coalesce(F.unix_micros(F.col("saved_at").cast("timestamp")), F.lit(-(2**62)))).alias("t"), "id")
    return numbered(rows.withColumn("_k", key), "owner_key", "_k", "place").drop("_k")


def by_field(rows: DataFrame, name: str, value: object) -> DataFrame:
    """Rows that have this value: the comparison reaches the scan."""
    return rows.filter(F.col(name) == F.lit(value))


def in_chunk_order(chunks: DataFrame) -> DataFrame:
    """Chunks with their place within their source, by chunk_index (nulls first), then id."""
    return numbered(chunks.withColumn("_k", F.struct("chunk_index", "id")), "source_id", "_k", "place").drop("_k")


def trimmed_suggestions(rows: DataFrame, text: str) -> DataFrame:
    """rows as they are stored: long texts cut with an ellipsis and marked, alternatives left out."""
    long = F.length(text) > STORED_TEXT
    cut = F.concat(F.btrim(F.substring(text, 1, STORED_TEXT)), F.lit("…"))
    return rows.drop("alternatives").withColumn("truncated", F.coalesce(long, F.lit(False))).withColumn(text, F.when(long, cut).otherwise(F.col(text)))


def mirrored(chunks: DataFrame) -> DataFrame:
    """Chunks without their vectors, which are never read then."""
    return chunks.drop("embedding")


def embedding_target() -> Column:
    """What of a chunk is embedded: the question of an answer, else its text."""
    return F.when(F.col("source_type") == "qa", F.coalesce(F.nullif("question", F.lit("")), F.col("text"))).otherwise(F.col("text"))


def passage_rows(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """Index rows of passages (doc_id, chunk_index, page, text) of documents (id, name, category)."""
    d = docs.select(F.col("id").alias("doc_id"), F.coalesce("name", F.lit("")).alias("source_name"), F.coalesce("category", F.lit("")).alias("category"))
    return passages.join(d, "doc_id").select(F.lit("document").alias("source_type"), F.col("doc_id").alias("source_id"), "source_name", "category", F.lit("").alias("question"), "text", "page", "chunk_index")


def with_vectors(rows: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """rows with the vector of their embedding_target() from a table (text, vector): null slots stay, as do texts without one."""
    v = vectors.select(F.col("text").alias("_t"), F.col("vector").alias("embedding")).filter(F.size("embedding") > 0).dropDuplicates(["_t"])
    out = rows.withColumn("_t", embedding_target()).join(v, "_t", "left").drop("_t")
    return out.withColumn("embedding_dims", F.when(F.col("embedding").isNotNull(), F.size("embedding"))).withColumn("embedding_model", F.when(F.col("embedding").isNotNull(), F.lit(model)))


def reindexed(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """chunks with the sources of the new rows replaced by them; sources without new rows keep what they have."""
    return chunks.join(rows.select("source_id").distinct(), "source_id", "left_anti").unionByName(rows, allowMissingColumns=True)


def backfill_totals(pending: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: sources that were due, those that got rows, their rows, and those that gave none."""
    n = indexed.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    p = pending.filter("state = 'pending'").join(n, "id", "left")
    return p.agg(F.count(F.lit(1)).alias("due"), F.count("n").alias("indexed"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n").isNull()).alias("without_text"))


def review_seed(questions: DataFrame) -> DataFrame:
    """The rows a review of each questionnaire begins with, numbered from 1 in its order."""
    q = questions.withColumn("_k", F.struct("sort_order", "question_id"))
    q = numbered(q, "questionnaire_id", "_k", "_n")
    return q.select("questionnaire_id", "question_id", (F.col("_n") + 1).alias("position"), F.coalesce("question_text", F.lit("")).alias("text"), F.lit("").alias("answer"), F.lit(0).alias("confidence"), F.lit("").alias("source"), F.lit("needs-input").alias("status"))


def completed(questions: DataFrame, heads: DataFrame) -> DataFrame:
    """The library entry that each completed questionnaire becomes; its pairs are one value, in their order."""
    pair = F.struct("sort_order", "question_id", F.struct(F.col("question_text").alias("text"), F.col("answer_text").alias("answer"), F.col("source_citation").alias("source")).alias("p"))
    done = F.count_if(filled("answer_text"))
    n = F.count(F.lit(1))
    e = questions.groupBy(F.col("questionnaire_id").alias("id")).agg(n.alias("question_count"), done.alias("answered"), F.floor(100 * done / n + 0.5).cast("int").alias("confidence"), F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["p"]).alias("qa_data"))
    name = F.coalesce(F.nullif("vendor", F.lit("")), F.lit("Unnamed vendor")).alias("vendor")
    return heads.select("id", name).join(e, "id").withColumn("industry", F.lit("General")).withColumn("tags", F.array(F.lit("Completed"))).withColumn("source", F.lit("Complete questionnaire"))


def without_blanks(rows: DataFrame, **defaults: object) -> DataFrame:
    """rows with blank or missing values of these columns replaced by their defaults."""
    return rows.withColumns({c: F.when(filled(c), F.col(c)).otherwise(F.lit(v)) for c, v in defaults.items()})


def merged_prefs(stored: Column, own: Column) -> Column:
    """Preferences with what is set overriding what is stored, key by key."""
    nothing = F.create_map().cast("map<string,boolean>")
    return F.map_concat(F.map_filter(F.coalesce(stored, nothing), lambda k, _: ~F.map_contains_key(F.coalesce(own, nothing), k)), F.coalesce(own, nothing))


def missing(local: DataFrame, remote: DataFrame, *gone: DataFrame) -> DataFrame:
    """Local rows that the other store does not know and that are not deleted: what a migration has to add."""
    return reduce(lambda rows, other: rows.join(other.select("id").distinct(), "id", "left_anti"), (remote, *gone), local)


def rekeyed(rows: DataFrame, owner: str, done: bool = False) -> DataFrame:
    """rows moved to a shared owner; a migration whose marker is set changes nothing."""
    return rows if done else rows.withColumn("owner_key", F.lit(owner))


def restore_counts(current: DataFrame, bundle: DataFrame) -> DataFrame:
    """One row: records of a bundle that a restore adds and skips."""
    known = current.select("id").distinct().withColumn("_has", F.lit(True))
    b = bundle.select("id").distinct().join(known, "id", "left")
    return b.agg(F.count_if(F.col("_has").isNull()).alias("added"), F.count_if("_has").alias("skipped"))


def dashboard(entries: DataFrame, drafts: DataFrame, feed: DataFrame) -> DataFrame:
    """One row: completed and unfinished questionnaires, questions answered so far, unread messages."""
    e = entries.agg(F.count(F.lit(1)).alias("completed"), F.coalesce(F.sum("question_count"), F.lit(0)).alias("questions_answered"))
    d = drafts.agg(F.count(F.lit(1)).alias("in_progress"))
    return e.crossJoin(d).crossJoin(feed.agg(F.count_if(~F.col("read")).alias("unread")))  # one row each


def people(drafts: DataFrame) -> DataFrame:
    """Everyone who owns or is assigned to a questionnaire."""
    both = drafts.select(F.col("owner").alias("person")).unionByName(drafts.select(F.col("assignee").alias("person")))
    return both.filter(filled("person")).distinct()


def found_in(articles: DataFrame, needle: str, title: str, content: str) -> DataFrame:
    """Articles that hold a needle of more than one letter in title or content, whatever its case."""
    low = needle.lower()
    if len(needle.strip()) < 2:
        return articles.limit(0)
    return articles.filter(F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(low)) | F.contains(F.lower(F.coalesce(content, F.lit(""))), F.lit(low)))


def nested(parents: DataFrame, children: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(id, children): the children of each parent as an array in order of their ids, empty without any."""
    c = children.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("children"))
    return parents.select("id").join(c, "id", "left").withColumn("children", F.coalesce("children", F.array().cast(c.schema["children"].dataType)))


def zipped(left: DataFrame, right: DataFrame, position: str = "position") -> DataFrame:
    """Rows of two lists at the same position; of a position that one lacks, its columns are null."""
    return left.join(right, position, "full")


def iso(value: Column) -> Column:
    """A time as ISO text in UTC, null where there is none."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def count(value: Column) -> Column:
    """A whole number of at least 0; what is no finite number counts as 0."""
    n = value.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")), F.greatest(F.lit(0.0), F.floor(n + 0.5))).otherwise(0).cast("long")


def texts(value: Column) -> Column:
    """A list without nulls and empty texts."""
    return F.filter(F.coalesce(value, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))

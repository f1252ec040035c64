"""The record library: index maintenance, filters, metrics, exports and record-store merges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.questions import filled, trimmed


def latest(rows: DataFrame, key: str | list[str], order: Column, columns: list[str] | None = None) -> DataFrame:
    """The newest version of each record; partial aggregation keeps one row per key before the shuffle.

    The versions travel as structs, which hide from the scan what is read of them later: name the columns that are needed.
    """
    if columns is not None:
        rows, order = rows.withColumn("_o", order).select(*columns, "_o"), F.col("_o")
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*(columns or rows.columns))


# Index maintenance


def qa_rows(entries: DataFrame) -> DataFrame:
    """Index rows of the usable pairs of past questionnaires: question and answer are both non-blank."""
    usable = F.filter("qa_data", lambda p: filled(p["text"]) & filled(p["answer"]))
    p = entries.select("id", "vendor", "entry_date", "industry", F.posexplode(usable).alias("chunk_index", "pair"))
    named = F.array_join(F.filter(F.array(F.nullif("vendor", F.lit("")), F.nullif("entry_date", F.lit(""))), lambda x: x.isNotNull()), " · ")
    return p.select(
        F.lit("qa").alias("source_type"), F.col("id").alias("source_id"), F.coalesce(F.nullif(named, F.lit("")), F.lit("Previous questionnaire")).alias("source_name"), F.coalesce("industry", F.lit("")).alias("category"),
        trimmed(F.col("pair.text")).alias("question"), trimmed(F.col("pair.answer")).alias("text"), F.lit(None).cast("int").alias("page"), "chunk_index",
    )


def current_sources(chunks: DataFrame, docs: DataFrame, entries: DataFrame) -> DataFrame:
    """chunks with source_name, source_date and source_saved_at as their document or entry has them now; without one the stored name stays."""
    d = docs.select(F.lit("document").alias("source_type"), F.col("id").alias("source_id"), F.nullif("name", F.lit("")).alias("_name"), F.col("doc_date").alias("source_date"), F.col("saved_at").alias("source_saved_at"))
    e = entries.select(F.lit("qa").alias("source_type"), F.col("id").alias("source_id"), F.lit(None).cast("string").alias("_name"), F.col("entry_date").alias("source_date"), F.col("saved_at").alias("source_saved_at"))
    out = chunks.join(d.unionByName(e), ["source_type", "source_id"], "left")
    return out.withColumn("source_name", F.coalesce("_name", "source_name")).drop("_name")


def pending(docs: DataFrame, entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, id, state): sources without any chunk, and whether they can be indexed."""
    have = chunks.select(F.col("source_id").alias("id")).distinct()
    d = docs.join(have, "id", "left_anti").select(F.lit("document").alias("kind"), "id", F.when(F.coalesce("storage_path", F.lit("")) != "", "pending").otherwise("unindexable").alias("state"))
    answered = F.exists("qa_data", lambda p: filled(p["answer"]))
    e = entries.join(have, "id", "left_anti").filter(F.coalesce(answered, F.lit(False))).select(F.lit("entry").alias("kind"), "id", F.lit("pending").alias("state"))
    return d.unionByName(e)


def coverage(docs: DataFrame, entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: how much of the library is indexed; chunks has `has_vector` in place of the vectors."""
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(~F.col("has_vector")).alias("without_vectors"), F.count_if(F.col("source_type") == "document").alias("document_chunks"), F.count_if(F.col("source_type") == "qa").alias("qa_chunks"))
    p = pending(docs, entries, chunks).agg(F.count_if((F.col("state") == "pending") & (F.col("kind") == "document")).alias("pending_docs"), F.count_if(F.col("kind") == "entry").alias("pending_entries"), F.count_if(F.col("state") == "unindexable").alias("unindexable_docs"))
    return c.crossJoin(p)  # one row each


def without_source(chunks: DataFrame, source_ids: DataFrame) -> DataFrame:
    """chunks but for those of the given (source_id): cascade and re-index."""
    return chunks.join(source_ids.select("source_id"), "source_id", "left_anti")


# Library view


def _tags() -> Column:
    return F.coalesce("tags", F.array().cast("array<string>"))


def filtered(rows: DataFrame, needle: str, fields: list[str], tags: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Rows that have the needle in a field or tag, and all of the tags."""
    low = needle.strip().lower()
    hit = F.exists(_tags(), lambda t: F.contains(F.lower(t), F.lit(low)))
    for f in fields:
        hit = hit | F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(low))
    out = rows if low == "" else rows.filter(F.coalesce(hit, F.lit(False)))
    if tags:
        out = out.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), _tags())) == 0)
    return out if where is None else out.filter(where)


def kpis(entries: DataFrame, complete: str = "Complete questionnaire") -> DataFrame:
    return entries.agg(
        F.count_if(F.col("source") == complete).alias("completed"),
        F.coalesce(F.sum(F.coalesce("question_count", F.lit(0))), F.lit(0)).alias("questions"),
        F.coalesce(F.floor(F.avg(F.coalesce("confidence", F.lit(0))) + 0.5), F.lit(0)).cast("int").alias("mean_confidence"),
    )


def distinct_tags(entries: DataFrame, docs: DataFrame) -> DataFrame:
    one = [t.select(F.explode(_tags()).alias("tag")) for t in (entries, docs)]
    return one[0].union(one[1]).filter("tag is not null").distinct()


def signature(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """One row that changes whenever the library does: sizes and the newest save."""
    both = docs.select(F.lit(1).alias("d"), "saved_at").unionByName(entries.select(F.lit(0).alias("d"), "saved_at"))
    newest = F.coalesce(F.date_format(F.max("saved_at"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))
    return both.agg(F.concat_ws(":", F.count_if(F.col("d") == 1), F.count_if(F.col("d") == 0), newest).alias("signature"))


def status_counts(questions: DataFrame) -> DataFrame:
    """Answered questions and progress of each questionnaire."""
    done = F.count_if(filled("answer_text"))
    n = F.count(F.lit(1))
    return questions.groupBy("questionnaire_id").agg(n.alias("questions"), done.alias("answered"), F.count_if(F.col("status") == "needs-input").alias("needs_input"), F.count_if(F.col("status") == "flagged").alias("flagged"), F.floor(100 * done / n + 0.5).cast("int").alias("progress"))


def notifications(rows: DataFrame, kind: str) -> DataFrame:
    """The feed under one of its filters: all, unread, review, assigned, vendor."""
    types = {"review": ["review", "approval"], "assigned": ["assigned"], "vendor": ["vendor"]}
    return rows if kind == "all" else rows.filter(~F.col("read")) if kind == "unread" else rows.filter(F.col("type").isin(types[kind]))


# Exports


def questionnaires(entries: DataFrame, drafts: DataFrame) -> DataFrame:
    """Completed and unfinished questionnaires under one schema."""
    pairs = F.coalesce("qa_data", F.array().cast("array<struct<text:string,answer:string,source:string>>"))
    done = entries.select(
        "id", F.coalesce("vendor", F.lit("")).alias("vendor"), F.lit("complete").alias("status"), F.lit(None).cast("string").alias("step"), F.coalesce("question_count", F.size(pairs)).cast("long").alias("question_count"),
        F.coalesce("answered", F.size(F.filter(pairs, lambda p: filled(p["answer"])))).cast("long").alias("answered_count"), "saved_at",
    )
    open_ = drafts.select("id", F.coalesce("vendor", F.lit("")).alias("vendor"), F.lit("in_progress").alias("status"), F.coalesce("step", F.lit("intake")).alias("step"), F.coalesce("question_count", F.lit(0)).cast("long").alias("question_count"), F.col("answered").cast("long").alias("answered_count"), "saved_at")
    return done.unionByName(open_)


def nested_answers(entries: DataFrame) -> DataFrame:
    """(id, answers): the pairs of each entry as the export nests them."""

    def item(p: Column, i: Column) -> Column:
        answer = F.coalesce(p["answer"], F.lit(""))
        return F.struct((i + 1).alias("position"), F.coalesce(p["text"], F.lit("")).alias("question"), answer.alias("answer"), F.when(filled(answer), "answered").otherwise("unanswered").alias("status"), F.nullif(F.coalesce(p["source"], F.lit("")), F.lit("")).alias("citation"))

    return entries.select("id", F.transform(F.coalesce("qa_data", F.array().cast("array<struct<text:string,answer:string,source:string>>")), item).alias("answers"))


def export_bundle(entries: DataFrame, drafts: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One JSON document per questionnaire, document and passage, with its kind: written as JSON lines it is the export."""
    q = questionnaires(entries, drafts).join(nested_answers(entries), "id", "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<struct<position:int,question:string,answer:string,status:string,citation:string>>")))
    counted = chunks.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    d = docs.join(counted, "id", "left").select("id", "name", "category", "note", "tags", F.col("doc_date").alias("added_label"), F.coalesce("n", F.lit(0)).alias("passage_count"), F.col("n").isNotNull().alias("indexed"), N.file_ref(F.col("storage_path"), F.col("name"), F.col("content_type"), F.col("size_bytes")).alias("file"))
    vector = F.when(F.col("embedding").isNotNull(), F.struct(F.col("embedding_model").alias("model"), F.size("embedding").alias("dimensions"), F.col("embedding").alias("vector")))
    p = chunks.select("id", F.when(F.col("source_type") == "qa", "answer").otherwise("document").alias("kind"), "source_id", "source_name", "page", "chunk_index", "question", "text", vector.alias("embedding"))
    keep = {"ignoreNullFields": "false"}
    parts = [t.select(F.lit(kind).alias("record"), "id", F.to_json(F.struct(*t.columns), keep).alias("json")) for kind, t in (("questionnaire", q), ("document", d), ("passage", p))]
    return reduce(DataFrame.unionByName, parts)


def export_counts(entries: DataFrame, drafts: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of totals; drafts has `questions`, how many each holds, and chunks `has_vector` in place of the vectors."""
    q = questionnaires(entries, drafts).agg(F.count(F.lit(1)).alias("questionnaires"), F.count_if(F.col("status") == "complete").alias("completed"), F.count_if(F.col("status") == "in_progress").alias("in_progress"))
    size = F.coalesce(F.size("qa_data"), F.lit(0))
    a = entries.select(F.greatest(size, F.lit(0)).cast("long").alias("n")).unionByName(drafts.select(F.col("questions").cast("long").alias("n")))
    a = a.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("answers"))  # of completed and unfinished questionnaires
    have = chunks.select(F.col("source_id").alias("id")).distinct().withColumn("has", F.lit(1))
    d = docs.join(have, "id", "left").agg(F.count(F.lit(1)).alias("documents"), F.count("has").alias("indexed_documents"))
    p = chunks.agg(F.count(F.lit(1)).alias("passages"), F.count_if("has_vector").alias("passages_with_vectors"))
    return q.crossJoin(a).crossJoin(d).crossJoin(p)  # one row each


def answer_history(entries: DataFrame) -> DataFrame:
    """(id, pos, line): the pairs of all entries as CSV lines; see csv_file for the whole file."""
    e = entries.select("id", "vendor", "entry_date", "industry", F.array_join(_tags(), "; ").alias("tags"), "confidence", F.posexplode("qa_data").alias("pos", "p"))
    return e.select("id", "pos", N.csv_line(*map(F.col, ("vendor", "entry_date", "industry", "tags", "confidence", "p.text", "p.answer", "p.source"))).alias("line"))


def manifest(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, line): the documents as CSV lines, with whether they are stored and searchable."""
    have = chunks.select(F.col("source_id").alias("id")).distinct().withColumn("_has", F.lit(True))
    d = docs.join(have, "id", "left")
    stored_ = F.when(F.coalesce("storage_path", F.lit("")) != "", "stored").otherwise("metadata only")
    return d.select("id", N.csv_line(F.col("name"), F.col("category"), F.col("doc_date"), N.shown_bytes(F.col("size_bytes")), F.col("note"), F.array_join(_tags(), "; "), stored_, F.when(F.col("_has"), "searchable").otherwise("not indexed")).alias("line"))


def assessments(drafts: DataFrame) -> DataFrame:
    """(id, line): the questionnaires in progress as CSV lines."""
    c = F.col
    return drafts.select("id", N.csv_line(c("vendor"), c("step"), c("owner"), c("assignee"), F.concat(F.coalesce("progress", F.lit(0)).cast("string"), F.lit("%")), c("question_count"), F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss")).alias("line"))


def csv_file(header: list[str], lines: DataFrame, path: str, order: list[str]) -> None:
    """Writes lines as CSV part files with CR LF ends, each part beginning with a byte-order mark and the header."""
    head = "\ufeff" + ",".join(header)

    def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], ["line"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["line"])

    lines.orderBy(*order).select("line").mapInArrow(with_header, "line string").write.mode("overwrite").option("lineSep", "\r\n").text(path)


# Record store


def merged(stored_: DataFrame, local: DataFrame, tombstones: DataFrame) -> DataFrame:
    """What a reader sees: stored rows overlaid with unsynced local ones, without deleted ids."""
    both = stored_.withColumn("_p", F.lit(0)).unionByName(local.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return latest(both, "id", F.col("_p")).drop("_p").join(tombstones.select("id"), "id", "left_anti")


def replayed(log: DataFrame) -> DataFrame:
    """The state after a change log (collection, id, op, version, seq, body): the last put that no delete follows."""
    last = latest(log, ["collection", "id"], F.struct("version", "seq"))
    return last.filter("op = 'put'").select("collection", "id", "version", "body")


def restored(current: DataFrame, bundle: DataFrame, overwrite: bool = False) -> DataFrame:
    """current with the rows of a bundle added; existing ids stay unless they are to be overwritten."""
    new = latest(bundle, "id", F.lit(1))
    if overwrite:
        return current.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)
    return current.unionByName(new.join(current.select("id"), "id", "left_anti"), allowMissingColumns=True)


def patched(rows: DataFrame, where: Column, **changes: Column) -> DataFrame:
    """rows with the changes applied where the predicate holds."""
    return rows.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in changes.items()})


def transferred(rows: DataFrame, ids: DataFrame, owner: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """rows with a new owner where it differs but for case, and the audit records of it."""
    hit = rows.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    moves = F.coalesce("_hit", F.lit(False)) & (F.lower(F.coalesce("owner", F.lit(""))) != owner.lower())
    audit = hit.filter(moves).select(F.lit("transfer").alias("action"), F.col("id").alias("entity_id"), F.create_map(F.lit("from"), F.coalesce("owner", F.lit("")), F.lit("to"), F.lit(owner)).alias("metadata"), at.alias("at"))
    return hit.withColumn("owner", F.when(moves, owner).otherwise(F.col("owner"))).drop("_hit"), audit


def guarded_overwrite(rows: DataFrame, path: str, had_rows: bool) -> None:
    """Overwrites a table unless an empty read would wipe out one that had rows."""
    if had_rows and rows.isEmpty():
        raise ValueError("an empty read may not replace a table that holds rows")
    rows.write.mode("overwrite").parquet(path)

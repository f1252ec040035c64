"""Loading raw delimited records and setting apart those that cannot become rows (problem 3).

Records are read permissively under an explicit schema that keeps the corrupt raw text. As a permissive reader is lenient
about quotes and knows no domains, every record is then classified again: by its quoting (RFC 4180), its number of
fields, and checks of the values. Everything is a column expression: one pass over the records, no shuffle.

Defined results: a null or empty record has one (empty) field and therefore the wrong count; a null delimiter counts as a
comma; a delimiter that is a quote, a line break or longer than one character makes its records break quoting; repeated
records are all kept, by their line_id; long records are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("question_number", "vendor", "question_text", "answer_text", "status", "confidence", "saved_date")
STATUSES = ("pending", "needs-input", "flagged", "auto-filled", "answered")
REASONS = ("quoting", "column_count", "value")
#: More different delimiters than this in one table are an error in the table, not a format.
MAX_DELIMITERS = 64
#: Noncharacters: no text holds them, so the reader sees a record as one line and tells empty from null.
_NO_LINE, _NO_NULL = "\uffff", "\ufffe"
_NOT_BLANK = r"[^\s\p{Z}\x1c-\x1f\x85]"


def _segments(record: Column) -> Column:
    """The record cut at its quotes: those at even places lie outside quotes if the quoting is sound."""
    return F.split(record, '"', -1)


def quoting_ok(record: Column, sep: Column) -> Column:
    """Whether the record obeys RFC 4180: all that lies outside quotes begins and ends at a delimiter.

    An empty stretch between two quotes is an escaped quote.
    """
    parts = _segments(record)
    last = F.size(parts) - 1

    def sound(x: Column, i: Column) -> Column:
        begins, ends = (i == 0) | x.startswith(sep), (i == last) | x.endswith(sep)
        return (i % 2 == 1) | (x == "") | (begins & ends)

    return (F.size(parts) % 2 == 1) & F.forall(F.transform(parts, sound), lambda x: x)


def field_count(record: Column, sep: Column) -> Column:
    """Delimiters outside quotes, plus one."""
    outside = F.transform(_segments(record), lambda x, i: F.when(i % 2 == 0, F.length(x) - F.length(F.replace(x, sep, F.lit("")))).otherwise(0))
    return F.aggregate(outside, F.lit(0), lambda a, b: a + b) + 1


def parsed(records: DataFrame) -> DataFrame:
    """records with `row`, the fields as strings and `_corrupt`, as the permissive reader sees them."""
    seps = [r.d for r in records.select(F.coalesce("delimiter", F.lit(",")).alias("d")).distinct().limit(MAX_DELIMITERS + 1).collect()]
    if len(seps) > MAX_DELIMITERS:
        raise ValueError(f"more than {MAX_DELIMITERS} different delimiters")
    schema = ", ".join(f"{f} string" for f in FIELDS) + ", _corrupt string"
    base = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": '"', "escape": '"', "lineSep": _NO_LINE, "nullValue": _NO_NULL, "emptyValue": "", "maxCharsPerColumn": "-1"}
    row = F.lit(None).cast(f"struct<{', '.join(f'{f}: string' for f in FIELDS)}, _corrupt: string>")
    for sep in seps:
        if len(sep) == 1 and sep not in '"\r\n':
            row = F.when(F.coalesce("delimiter", F.lit(",")) == sep, F.from_csv("record", schema, base | {"sep": sep})).otherwise(row)
    return records.withColumn("row", row)


def _value_ok(row: str) -> Column:
    def text(name: str) -> Column:
        return F.coalesce(F.col(f"{row}.{name}"), F.lit(""))

    date = text("saved_date")
    return (
        text("question_number").rlike(r"\A0*[1-9][0-9]*\z")
        & text("question_text").rlike(_NOT_BLANK)
        & text("status").isin(*STATUSES)
        & ((text("confidence") == "") | text("confidence").rlike(r"\A0*(?:[0-9]{1,2}|100)\z"))
        & ((date == "") | (date.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).isNotNull()))
    )


def classified(records: DataFrame) -> DataFrame:
    """records with `row` and `reason`: null for a sound record, else the first of REASONS that applies."""
    sep = F.coalesce(F.col("delimiter"), F.lit(","))
    record = F.coalesce(F.col("record"), F.lit(""))
    usable = (F.length(sep) == 1) & ~sep.isin('"', "\r", "\n")
    # Records without any quote need neither of the two looks at segments.
    plain = ~F.contains(record, F.lit('"'))
    quoting = usable & (plain | quoting_ok(record, sep))
    count = F.when(plain, F.length(record) - F.length(F.replace(record, sep, F.lit(""))) + 1).otherwise(field_count(record, sep))
    out = parsed(records)
    return out.withColumn("reason", F.when(~quoting, REASONS[0]).when(count != len(FIELDS), REASONS[1]).when(~_value_ok("row"), REASONS[2]))


def rejected(records: DataFrame) -> DataFrame:
    """(line_id, reason, record): the records that cannot become rows."""
    return classified(records).filter("reason is not null").select("line_id", "reason", "record")


def loaded(records: DataFrame) -> DataFrame:
    """The sound records as typed rows."""
    good = classified(records).filter("reason is null")

    def text(name: str) -> Column:
        return F.coalesce(F.col(f"row.{name}"), F.lit(""))

    return good.select(
        "line_id",
        "file_id",
        "line_no",
        text("question_number").cast("decimal(38,0)").cast("long").alias("question_number"),
        *[text(c).alias(c) for c in FIELDS[1:5]],
        F.when(text("confidence") != "", text("confidence").cast("int")).alias("confidence"),
        F.when(text("saved_date") != "", F.to_date(text("saved_date"))).alias("saved_date"),
    )


def by_file(records: DataFrame) -> DataFrame:
    """How many records of each file are set apart, by reason."""
    c = classified(records)
    return c.groupBy("file_id").agg(F.count(F.lit(1)).alias("records"), *[F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(r) for r in REASONS])

"""How question-shaped a line is: marker, score, signals and cleaned text, as column expressions and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, _quoted

# What starts an enumerated item, a control reference, a bullet.
MARKER = r"^\s*(?:(?:Q|Question)\s*)?(\d+(?:\.\d+)*|[A-Za-z]|[ivxIVX]{1,5})\s*[.)\]:-]\s+"
CONTROL_ID = r"^\s*([A-Z]{1,6}[-.]\d+(?:\.\d+)*|[A-Z]{2,6}\s\d+(?:\.\d+)+|[A-Z]{1,6}\d+(?:\.\d+)+)\s*[:.)\-|]?\s+"
BULLET = r"^\s*[•▪◦‣·*+–—-]\s+"
# Openings and phrases of questions and requirements.
INTERROGATIVE = r"(?i)^(do|does|did|is|are|was|were|has|have|had|can|could|will|would|should|shall|may|must|if|who|what|when|where|why|how|which|please|describe|explain|provide|list|specify|identify|confirm|indicate|state|detail|outline|summarize|summarise|attach|upload|document|demonstrate)\b"
REQUIREMENT = r"(?i)\b(do you|does your|are you|is your|have you|has your|can you|will you|please (?:describe|explain|provide|list|specify|confirm|attach|indicate|detail)|describe (?:your|how|the|any|briefly|in detail)|explain (?:your|how|the|why|any)|provide (?:a|the|your|evidence|details)|list (?:all|any|the|your)|indicate (?:whether|how|if)|confirm (?:that|whether)|specify (?:the|your|how)|outline (?:your|the|how)|summari[sz]e (?:your|the|how)|how (?:do|does|are|is|many|often)|what (?:is|are|type|kind)|who (?:is|are|has)|where (?:is|are|do)|evidence of|documentation (?:of|for)|attach (?:a|the|your))\b"
# Headings and page furniture that are no questions.
BOILERPLATE = r"(?i)^(section|part|appendix|annex|schedule|exhibit|table of contents|contents|page \d+|confidential|proprietary|copyright|©|introduction|overview|scope|purpose|definitions|glossary|instructions|revision history|version \d|last (?:updated|reviewed)|prepared (?:by|for)|classification|internal use|vendor (?:name|information)|company (?:name|information)|date completed?|completed by|reviewed by|approved by|signature|yes\s*\/\s*no|n\s*\/\s*a|response|answer|comments?|notes?|status|owner|evidence|attachments?)\b"
# A trailing column for the answer.
RESPONSE_COLUMN = r"(?i)\|[ \t]*(?:(?:yes[ \t]*\/[ \t]*no|yes|no|n\/?a|not applicable|response|answer|comments?|notes?|evidence|status|owner|attachments?)[ \t]*)?$"

# Lengths, the least score, and what each signal counts.
MIN_LENGTH, MAX_LENGTH, MIN_SCORE = 12, 700, 2
SIGNALS = (("question mark", 3), ("requirement phrasing", 2), ("interrogative opening", 1), ("enumerated", 1), ("table row", 1), ("boilerplate", -4), ("too short", -2), ("too few words", -1), ("not prose", -2))


def spark_pattern(p: str) -> str:
    """The pattern with ASCII word boundaries and wide white space for Java."""
    p = p.replace(r"\s", f"[{SPACE}]")
    if p.endswith(r"\b"):
        p = p[:-2] + "(?![A-Za-z0-9_])"
    return p.replace(r"(?i)\b", "(?i)(?<![A-Za-z0-9_])")


def trimmed(text: Column) -> Column:
    """Without white space at either end, as browsers see it."""
    return F.regexp_replace(text, f"^[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++$", "")


def filled(text: Column | str) -> Column:
    """Whether anything but white space is there."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike(f"[^{SPACE}]")


def marker(line: Column) -> Column:
    """The number, letter or reference that opens an item, a bullet, or null."""
    control, number = (F.nullif(F.regexp_extract(line, spark_pattern(p), 1), F.lit("")) for p in (CONTROL_ID, MARKER))
    return F.coalesce(control, number, F.when(line.rlike(spark_pattern(BULLET)), "•"))


def without_marker(line: Column) -> Column:
    for p in (CONTROL_ID, MARKER, BULLET):
        line = F.regexp_replace(line, spark_pattern(p), "")
    return trimmed(line)


def without_response_columns(text: Column) -> Column:
    """Up to eight answer columns at the end go, in one pass from the first of them."""
    column = RESPONSE_COLUMN.removeprefix("(?i)").removesuffix("$").replace("[ \\t]*", "[ \\t]*+")
    return trimmed(F.regexp_replace(trimmed(text), f"(?i)(?:{column}[{SPACE}]*+){{1,8}}$", ""))


def tidy(text: Column) -> Column:
    """Table borders become dashes, white space single, none before marks, no dash at the end."""
    text = F.regexp_replace(text, f"[{SPACE}]*\\|[{SPACE}]*", " — ")
    text = F.regexp_replace(text, f"[{SPACE}]{{2,}}", " ")
    text = F.regexp_replace(text, f"[{SPACE}]+([?.,;:])", "$1")
    return trimmed(F.regexp_replace(text, f"[{SPACE}—–-]+$", ""))


def scored(joined: Column, plain: Column, mark: Column) -> Column:
    """struct(text, score, signals) of an item, given it as joined and in its plain form; an empty one has -5."""
    n = F.length(plain)
    tests = [
        F.contains(plain, F.lit("?")),
        plain.rlike(spark_pattern(REQUIREMENT)),
        plain.rlike(spark_pattern(INTERROGATIVE)),
        mark.isNotNull(),
        F.contains(joined, F.lit("|")),
        plain.rlike(spark_pattern(BOILERPLATE)),
        n < MIN_LENGTH,
        F.size(F.split(plain, f"[{SPACE}]+")) < 4,
        F.length(F.regexp_replace(plain, "[^A-Za-z]", "")) < n * 0.5,
    ]
    # Each test is made once: an array of the signals' places, from which names and points are looked up.
    found = F.filter(F.array(*[F.when(t, k) for k, t in enumerate(tests)]), lambda k: k.isNotNull())
    names, points = F.array(*[F.lit(n) for n, _ in SIGNALS]), F.array(*[F.lit(w) for _, w in SIGNALS])
    return F.struct(
        tidy(plain).alias("text"), F.aggregate(found, F.lit(0), lambda a, k: a + F.get(points, k)).alias("score"), F.transform(found, lambda k: F.get(names, k)).alias("signals")
    )


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once: as a generator's output, filters above don't take them along and repeat them."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return rows.select("*", F.inline(F.array(made)))


def with_scored(rows: DataFrame, joined: str, mark: str | None = None, into: str = "s") -> DataFrame:
    """rows with a struct (text, score, signals) of the text in `joined`; the plain form and the struct are computed once."""
    mark_ = F.lit(None).cast("string") if mark is None else F.col(mark)
    rows = _once(rows, _joined=trimmed(F.coalesce(joined, F.lit(""))))
    rows = _once(rows, _plain=without_response_columns(without_marker(F.col("_joined"))))
    none = F.struct(F.lit("").alias("text"), F.lit(-5).alias("score"), F.array(F.lit("empty")).alias("signals"))
    return _once(rows, **{into: F.when(F.col("_joined") == "", none).otherwise(scored(F.col("_joined"), F.col("_plain"), mark_))}).drop("_joined", "_plain")


def truncated(text: Column) -> Column:
    return F.when(F.length(text) > MAX_LENGTH, F.concat(trimmed(F.substring(text, 1, MAX_LENGTH)), F.lit("…"))).otherwise(text)


def dedupe_key(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def scored_sql(expr: str) -> tuple[str, str, str, str, str]:
    """DuckDB expressions: the line l, its plain form p, and from those the text, score and signals."""

    def re2(p: str) -> str:
        return _quoted(p.replace(r"\s", f"[{SPACE}]"))

    def trim(e: str) -> str:
        return f"regexp_replace({e}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"

    line = trim(f"coalesce({expr}, '')")
    plain = line
    for p in (CONTROL_ID, MARKER, BULLET):
        plain = f"regexp_replace({plain}, {re2(p)}, '')"
    plain = trim(plain)
    for _ in range(8):
        plain = trim(f"regexp_replace({plain}, {re2(RESPONSE_COLUMN)}, '')")
    tidy_ = f"regexp_replace(p, '[{SPACE}]*\\|[{SPACE}]*', ' — ', 'g')"
    tidy_ = f"regexp_replace({tidy_}, '[{SPACE}]{{2,}}', ' ', 'g')"
    tidy_ = f"regexp_replace({tidy_}, '[{SPACE}]+([?.,;:])', '\\1', 'g')"
    tidy_ = trim(f"regexp_replace({tidy_}, '[{SPACE}—–-]+$', '')")
    tests = [
        "contains(p, '?')", f"regexp_matches(p, {re2(REQUIREMENT)})", f"regexp_matches(p, {re2(INTERROGATIVE)})", "false", "contains(l, '|')", f"regexp_matches(p, {re2(BOILERPLATE)})", f"length(p) < {MIN_LENGTH}",
        f"len(string_split_regex(p, '[{SPACE}]+')) < 4", "length(regexp_replace(p, '[^A-Za-z]', '', 'g')) < length(p) * 0.5",
    ]
    score = " + ".join(f"CASE WHEN {t} THEN {w} ELSE 0 END" for t, (_, w) in zip(tests, SIGNALS))
    found = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, (n, _) in zip(tests, SIGNALS)) + "], lambda s: s IS NOT NULL)"
    return line, plain, f"CASE WHEN l = '' THEN '' ELSE {tidy_} END", f"CASE WHEN l = '' THEN -5 ELSE {score} END", f"CASE WHEN l = '' THEN ['empty'] ELSE {found} END"

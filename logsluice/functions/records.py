"""Fields of one text-log record: header, JSON tail, source position, channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.functions.steps import computed_once

# Fixed pattern of a record's first line: [time] environment.LEVEL: text
HEADER = (
    r"(?s)^\[(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:\d{2})?)\]"
    r"\s+(\w+)\.(\w+):(?:\s(.*))?$"
)
# Fixed patterns: where a record names its source, a dated file name, and the JSON text at a record's end.
SOURCE = r"in\s+([^\s:]+):(\d+)"
DATED_NAME = r"^(.+?)-\d{4}-\d{2}-\d{2}$"
JSON_TAIL = r"(?s)\s(\{.*\})$"

BLANK = " \t\n\r\u0000\u000b"


def strip(text: Column) -> Column:
    """Trim blanks, tabs, line ends and NULs on both sides."""
    return F.trim(text, F.lit(BLANK))


def strip_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANK))


def strip_line_ends(text: Column) -> Column:
    """Blanks at the end of every line removed."""
    return F.regexp_replace(text, "[ \\t\\r\\x00\\x0B]+(?=\n|$)", "")


def is_header(line: Column) -> Column:
    return F.startswith(line, F.lit("[")) & line.rlike(HEADER)


def header_time(text: Column, tz: str = "UTC") -> Column:
    """The header's time as an instant; text without an offset is read in ``tz``.

    Impossible dates give null.
    """
    clean = F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 40))
    has_offset = F.substring(text, -6, 1).isin("+", "-")
    ending = F.lit("Z" if tz == "UTC" else f" {tz}")
    return F.when(has_offset, clean).otherwise(F.concat(clean, ending)).try_cast("timestamp")


def header_parts(line: Column) -> Column:
    """Time, environment, level and text of a header line, matched once."""
    marked = F.regexp_replace(line, HEADER, "$1\u0001$2\u0001$3\u0001$4")
    return F.split(marked, "\u0001", 4)


def split_header(line: Column, tz: str = "UTC") -> Column:
    """``struct(occurred_at, environment, level, rest)`` of a record's first line."""
    return named_header(header_parts(line), tz)


def named_header(parts: Column, tz: str = "UTC") -> Column:
    return F.struct(
        header_time(parts[0], tz).alias("occurred_at"),
        parts[1].alias("environment"),
        F.lower(parts[2]).alias("level"),
        parts[3].alias("rest"),
    )


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value.

    The JSON parser stops after the first value and does not look at what
    follows, so the text is put into an array before an end mark: only when
    nothing else follows is the mark the second element.
    """
    array = F.concat(F.lit("["), text, F.lit(',"#end"]'))
    return F.try_variant_get(F.try_parse_json(array), "$[1]", "string") == "#end"


def json_candidate(text: Column) -> Column:
    """What looks like a JSON object at the end of stripped text, else null.

    Checking the last character first keeps the regex away from long texts
    that cannot match.
    """
    ends_so = F.when(F.endswith(text, F.lit("}")), text)
    return F.nullif(F.regexp_extract(ends_so, JSON_TAIL, 1), F.lit(""))


def without_tail(text: Column, json: Column) -> Column:
    """``struct(message, context)`` of stripped text and its JSON tail, if any.

    Without one the message stays whole and the context is ``[]``.
    """
    message = strip(F.substring(text, F.lit(1), F.length(text) - F.length(json)))
    return F.struct(
        F.when(json.isNotNull(), message).otherwise(text).alias("message"),
        F.when(~json.rlike(r"^\{\s*\}$"), json).otherwise("[]").alias("context"),
    )


def split_json_tail(message: Column) -> Column:
    """``struct(message, context)``: a valid JSON object at the end is the context."""
    text = strip(message)
    json = json_candidate(text)
    return without_tail(text, F.when(is_json(json), json))


def with_json_tail(df: DataFrame, column: str = "message") -> DataFrame:
    """The column without its JSON tail, and ``context``; each step computed once."""
    rows = computed_once(df, _text=strip(F.col(column)))
    rows = computed_once(rows, _json=json_candidate(F.col("_text")))
    rows = computed_once(rows, _json=F.when(is_json(F.col("_json")), F.col("_json")))
    rows = computed_once(rows, _split=without_tail(F.col("_text"), F.col("_json")))
    others = [c for c in df.columns if c not in (column, "context")]
    return rows.select(*others, F.col("_split.message").alias(column), "_split.context")


def named_source(message: Column, context: Column) -> Column:
    """The first ``in <file>:<line>`` of the message, else of the context's
    ``exception`` when that is a text."""

    def found(text: Column) -> Column:
        return F.nullif(F.regexp_extract(text, SOURCE, 0), F.lit(""))

    value = F.try_variant_get(
        F.try_parse_json(F.when(F.contains(context, F.lit('"exception"')), context)),
        "$.exception",
        "variant",
    )
    told = F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))
    return F.coalesce(found(message), found(told))


def source_parts(named: Column) -> Column:
    return F.struct(
        F.nullif(F.regexp_extract(named, SOURCE, 1), F.lit("")).alias("source"),
        F.regexp_extract(named, SOURCE, 2).try_cast("int").alias("source_line"),
    )


def source_from_text(message: Column, context: Column) -> Column:
    """``struct(source, source_line)`` of :func:`named_source`."""
    return source_parts(named_source(message, context))


def with_source(df: DataFrame) -> DataFrame:
    """Adds ``source`` and ``source_line`` found in the message or the context."""
    rows = computed_once(df, _named=named_source(F.col("message"), F.col("context")))
    rows = computed_once(rows, _at=source_parts(F.col("_named")))
    return rows.select(*df.columns, "_at.source", "_at.source_line")


def channel_from_path(path: Column) -> Column:
    """File name without ``.log`` and without a trailing ``-YYYY-MM-DD``."""
    name = F.substring_index(path, "/", -1)
    stem = F.when(
        F.endswith(name, F.lit(".log")), F.substring(name, F.lit(1), F.length(name) - 4)
    ).otherwise(name)
    return F.regexp_replace(stem, DATED_NAME, "$1")


def channel_from_uri(path: Column) -> Column:
    """The same for a path with URI escapes, as file metadata has it."""
    name = F.substring_index(path, "/", -1)
    plain = F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return channel_from_path(F.when(F.contains(name, F.lit("%")), plain).otherwise(name))

"""Multi-line text logs read in parallel, split by split.

Lines are put together by Arrow batch where they are read: a record is a run of
rows in file order, which no built-in function can gather without a shuffle of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from logsluice.functions.records import (
    channel_from_uri,
    header_parts,
    is_header,
    named_header,
    strip_end,
    with_json_tail,
    with_source,
)
from logsluice.functions.steps import computed_once
from logsluice.operators.prepare import conform, prepare_entries
from logsluice.schema import as_utc
from logsluice.sources.entries import write_entries

Paths = str | Sequence[str]

_FILE_SCHEMA = "path string, name string, size bigint, modified timestamp"
_LINE_SCHEMA = "path string, start bigint, value string, header boolean"
_PIECE_SCHEMA = "path string, start bigint, n bigint, headed boolean, open_end boolean, lines array<string>"


def exact_path(path: str) -> str:
    """A file's path with the characters escaped that would make it a pattern."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def _load(reader, paths: Paths) -> DataFrame | None:
    try:
        return reader.load([paths] if isinstance(paths, str) else list(paths))
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def list_log_files(spark: SparkSession, paths: Paths, pattern: str = "*.log") -> DataFrame:
    """Log files, newest first; a missing folder gives an empty frame.

    Only listing columns are read, so no file is opened.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    files = _load(reader, paths)
    if files is None:
        return spark.createDataFrame([], _FILE_SCHEMA)
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    ).orderBy(F.col("modified").desc(), "path")


def read_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """Lines with their file, their split's start, and whether they are headers.

    Rows come in file order inside a split, as long as nothing shuffles them.
    """
    text = _load(spark.read.format("text").option("lineSep", "\n"), paths)
    if text is None:
        return spark.createDataFrame([], _LINE_SCHEMA)
    lines = text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        strip_end(F.col("value")).alias("value"),
    )
    return lines.withColumn("header", is_header(F.col("value")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines put together to pieces: a header and what follows it in its split, or the lines before the first header.

    ``n`` is the number of headers of the split so far, ``open_end`` marks the last piece
    of a split. A task holds one batch and one piece.
    """
    place, headers, headed, held = None, 0, False, []

    def made(places, n, headed, open_end, bounds, lines) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), lines)
        arrays = [pa.array(x, k) for x, k in zip(places, (pa.string(), pa.int64()), strict=True)]
        arrays += [pa.array(n, pa.int64()), pa.array(headed, pa.bool_()), pa.array(open_end, pa.bool_()), lists]
        return pa.RecordBatch.from_arrays(arrays, ["path", "start", "n", "headed", "open_end", "lines"])

    def held_piece(open_end: bool) -> pa.RecordBatch:
        lines = pa.concat_arrays(held)
        return made(([place[0]], [place[1]]), [headers], [headed], [open_end], [0, len(lines)], lines)

    for batch in batches:
        if not batch.num_rows:
            continue
        paths = batch.column(0).dictionary_encode()
        names, codes = paths.dictionary.to_pylist(), paths.indices.to_numpy()
        start, values = batch.column(1).to_numpy(), batch.column(2)
        header = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        change = np.ones(len(start), bool)
        change[1:] = (codes[1:] != codes[:-1]) | (start[1:] != start[:-1])
        change[0] = place != (names[codes[0]], start[0])
        at = np.flatnonzero(change | header)
        # Headers of the split so far, at each row.
        so_far = np.cumsum(header)
        last_change = np.maximum.accumulate(np.where(change, np.arange(len(start)), -1))
        seen = np.where(last_change < 0, headers, header[last_change] - so_far[last_change]) + so_far
        if not len(at):
            held.append(values)
            continue
        if at[0]:
            held.append(values.slice(0, at[0]))
        if held:
            yield held_piece(bool(change[at[0]]))
        if len(at) > 1:
            first, last = at[0], at[-1]
            yield made(
                ([names[c] for c in codes[at[:-1]]], start[at[:-1]]),
                seen[at[:-1]],
                header[at[:-1]],
                change[at[1:]],
                at - first,
                values.slice(first, last - first),
            )
        place, headers, headed = (names[codes[at[-1]]], start[at[-1]]), int(seen[at[-1]]), bool(header[at[-1]])
        held = [values.slice(at[-1])]
    if held:
        yield held_piece(True)


def records_of_lines(lines: DataFrame) -> DataFrame:
    """``(path, place, first, rest)`` of any files, from their lines.

    A record starts at a header line and takes the lines up to the next one. Lines are
    put together where they are read, so the text is not shuffled. A table of one row per
    split, with its number of headers, tells the number of each record in its file: its
    ``place``, which does not depend on how the files are split. Only the open end of a
    split and the headless lines at the start of later ones are put together
    across splits. Lines before a file's first header belong to no record.
    """
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        lines.groupBy("path", "start")
        .agg(F.count_if("header").alias("headers"))
        .select("path", "start", F.coalesce(F.sum("headers").over(earlier), F.lit(0)).alias("base"))
    )
    # One short row per split of the input: the driver holds a list of these anyway.
    pieces = lines.mapInArrow(_pieces, _PIECE_SCHEMA).join(F.broadcast(splits), ["path", "start"], "left")
    # Both scans must have cut the files alike; better to stop than to lose lines.
    base = F.coalesce(
        "base", F.raise_error(F.lit("the files were split differently while they were read")).cast("bigint")
    )
    numbered = pieces.withColumn("number", base + F.col("n") - 1).where(F.col("number") >= 0)
    whole = numbered.where(F.col("headed") & ~F.col("open_end")).select("path", "number", "lines")
    bridged = (
        numbered.where(~F.col("headed") | F.col("open_end"))
        .groupBy("path", "number")
        .agg(F.array_sort(F.collect_list(F.struct("start", "lines"))).alias("parts"))
        .select("path", "number", F.flatten(F.transform("parts", lambda p: p["lines"])).alias("lines"))
    )
    more = F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))
    return whole.unionByName(bridged).select(
        "path",
        F.col("number").cast("string").alias("place"),
        F.get("lines", F.lit(0)).alias("first"),
        F.when(F.size("lines") > 1, F.array_join(more, "\n")).alias("rest"),
    )


def assemble_records(spark: SparkSession, paths: Paths) -> DataFrame:
    """``(path, place, first, rest)``: each record's header line and its other lines."""
    return records_of_lines(read_lines(spark, paths))


def _read_record(records: DataFrame, tz: str) -> DataFrame:
    rows = computed_once(records, parts=header_parts(F.col("first")))
    # A null rest is left out; an empty header text still counts as a line.
    text = F.concat_ws("\n", F.col("parts")[3], F.col("rest"))
    rows = computed_once(rows, head=named_header(F.col("parts"), tz), message=text)
    rows = with_source(with_json_tail(rows))
    rows = computed_once(rows, channel=channel_from_uri(F.col("path")))
    return rows.select(
        F.col("path").alias("file"),
        "head.level",
        "message",
        "context",
        "channel",
        "head.environment",
        "source",
        "source_line",
        "head.occurred_at",
        "place",
    )


def cutoff(now: datetime, days: int) -> datetime | None:
    return as_utc(now) - timedelta(days=days) if days > 0 else None


def _is_old(now: datetime | None, days: int) -> Column:
    since = cutoff(now, days) if now is not None else None
    if since is None:
        return F.lit(False)
    return F.coalesce(F.col("occurred_at") < F.lit(since), F.lit(False))


def parse_all(
    spark: SparkSession, paths: Paths, now: datetime | None = None, days: int = 0, tz: str = "UTC"
) -> DataFrame:
    """Every record, also those whose date cannot be read (``occurred_at`` null)."""
    records = _read_record(assemble_records(spark, paths), tz)
    return records.withColumn("_skipped", _is_old(now, days))


def parse_log_text(
    spark: SparkSession, paths: Paths, now: datetime | None = None, days: int = 0, tz: str = "UTC"
) -> DataFrame:
    """The readable records; ``_skipped`` marks those older than ``days``."""
    return parse_all(spark, paths, now, days, tz).where(F.col("occurred_at").isNotNull())


def count_entries(parsed: DataFrame) -> DataFrame:
    """Records per file, skipped ones too."""
    return parsed.groupBy("file").agg(F.count(F.lit(1)).alias("count"))


def import_summary(parsed: DataFrame) -> DataFrame:
    """Per file and in total (``file`` null): imported, skipped and unparsed records."""
    read = F.col("occurred_at").isNotNull()
    return parsed.rollup("file").agg(
        F.count_if(read & ~F.col("_skipped")).alias("imported"),
        F.count_if(read & F.col("_skipped")).alias("skipped"),
        F.count_if(~read).alias("unparsed"),
    )


def prepared_import(parsed: DataFrame, now: datetime) -> DataFrame:
    """Parsed records as rows of the entry table.

    The id comes from where the record stands, so a retried task gives it
    again and equal records have different ones.
    """
    fresh = parsed.where(F.col("occurred_at").isNotNull() & ~F.col("_skipped"))
    return conform(prepare_entries(fresh, now, key_cols=["file", "place"]))


def import_logs(
    spark: SparkSession,
    paths: Paths,
    table: str,
    now: datetime,
    days: int = 7,
    fresh: bool = False,
    tz: str = "UTC",
) -> dict[str, int]:
    """Parses the files and adds their records to the table; returns how many.

    The result counts ``imported``, ``skipped`` (older than ``days``) and ``unparsed``
    records, observed while they are written. ``days`` = 0 imports everything; ``fresh`` replaces what the table holds.
    Paths that match nothing raise ``FileNotFoundError`` and change nothing.
    """
    if _load(spark.read.format("text"), paths) is None:
        raise FileNotFoundError(f"no log files at {paths!r}")
    counted = Observation()
    read = F.col("occurred_at").isNotNull()
    parsed = parse_all(spark, paths, now, days, tz).observe(
        counted,
        F.count_if(read & ~F.col("_skipped")).alias("imported"),
        F.count_if(read & F.col("_skipped")).alias("skipped"),
        F.count_if(~read).alias("unparsed"),
    )
    write_entries(prepared_import(parsed, now), table, mode="overwrite" if fresh else "append")
    return counted.get

"""Importing a folder of text logs again and again, new files only."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from logsluice.sources.entries import write_entries
from logsluice.sources.textlogs import exact_path, parse_log_text, prepared_import
from logsluice.streaming.identity import stream_id

FILES_PER_BATCH = 1000


def follow_files(
    spark: SparkSession,
    folder: str,
    table: str,
    checkpoint: str,
    now: datetime | None = None,
    days: int = 0,
    tz: str = "UTC",
    trigger: dict | None = None,
    pattern: str = "*.log",
) -> StreamingQuery:
    """Starts a stream of finished log files; a record lies within one file.

    The stream itself carries file names only. Each micro-batch of names, at
    most ``FILES_PER_BATCH``, is then read in parallel by the batch parser.
    """
    names = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", FILES_PER_BATCH)
        .load(folder)
        .select("path")
    )

    def store(files: DataFrame, batch: int) -> None:
        paths = [exact_path(row.path) for row in files.collect()]
        if not paths:
            return
        moment = now or datetime.now().astimezone()
        parsed = parse_log_text(spark, paths, moment, days, tz)
        tag = f"{stream_id(spark, checkpoint)}-{batch}"
        write_entries(prepared_import(parsed, moment), table, batch=tag)

    return (
        names.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

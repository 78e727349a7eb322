"""Status changes, notes, deletes and retention."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from logsluice.operators import triage
from logsluice.operators.status import status_dimension, valid_changes
from logsluice.plans import retention
from logsluice.plans.changes import (
    current_entries,
    delete_stored,
    find_stored,
    fold_changes,
    record_changes,
)
from logsluice.registry.base import NOW, entries, entries_query, query
from logsluice.registry.listing import stored_entries
from logsluice.session import scratch_path
from logsluice.sources.entries import read_entries

_COLUMNS = ("id", "status", "status_changed_at", "status_changed_by", "note")
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"

# Every third entry is changed twice; the second change does not say by whom,
# and every ninth entry gets a note with the first. Some ask for a status that
# does not exist.
_CHANGES = """, ch AS (
  SELECT id, 'investigating' AS status, occurred_at + INTERVAL 1 HOUR AS changed_at, channel AS changed_by,
    CASE WHEN CAST(id AS BIGINT) % 9 = 0 THEN concat('note ', level) END AS note FROM le WHERE CAST(id AS BIGINT) % 3 = 0
  UNION ALL SELECT id, 'resolved', occurred_at + INTERVAL 2 HOUR, NULL, NULL FROM le WHERE CAST(id AS BIGINT) % 3 = 0
  UNION ALL SELECT id, 'unheard_of', occurred_at + INTERVAL 3 HOUR, 'nobody', NULL FROM le WHERE CAST(id AS BIGINT) % 6 = 0)
"""


def changes(le):
    number = F.col("id").cast("bigint")
    third = le.where(number % 3 == 0)

    def one(rows, status, hours, by, note):
        later = (F.col("occurred_at") + F.expr(f"INTERVAL {hours} HOUR")).alias("changed_at")
        return rows.select("id", F.lit(status).alias("status"), later, by.alias("changed_by"), note.alias("note"))

    nothing = F.lit(None).cast("string")
    note = F.when(number % 9 == 0, F.concat(F.lit("note "), "level"))
    return (
        one(third, "investigating", 1, F.col("channel"), note)
        .unionByName(one(third, "resolved", 2, nothing, nothing))
        .unionByName(one(le.where(number % 6 == 0), "unheard_of", 3, F.lit("nobody"), nothing))
    )


@entries_query(
    "latest_status",
    _CHANGES
    + """SELECT id, arg_max(status, changed_at) AS status, max(changed_at) AS changed_at,
      arg_max(changed_by, changed_at) FILTER (WHERE changed_by IS NOT NULL) AS changed_by,
      arg_max(note, changed_at) FILTER (WHERE note IS NOT NULL) AS note
    FROM ch WHERE status <> 'unheard_of' GROUP BY id""",
)
def _latest(le):
    dimension = status_dimension(le.sparkSession)
    return triage.latest_status(valid_changes(changes(le), dimension))


@entries_query(
    "apply_changes",
    _CHANGES
    + """SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'resolved' ELSE status END AS status,
      CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN occurred_at + INTERVAL 2 HOUR END AS status_changed_at,
      CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN channel END AS status_changed_by,
      CASE WHEN CAST(id AS BIGINT) % 9 = 0 THEN concat('note ', level) END AS note FROM le""",
)
def _apply(le):
    return triage.apply_changes(le, changes(le)).select(*_COLUMNS)


_ID = "00000000000000000000000042"


@entries_query(
    "set_status",
    f"""SELECT id, CASE WHEN id = '{_ID}' THEN 'ignored' ELSE status END AS status,
    CASE WHEN id = '{_ID}' THEN {_NOW} END AS status_changed_at, NULL::VARCHAR AS status_changed_by,
    CASE WHEN id = '{_ID}' THEN 'noise' END AS note FROM le""",
)
def _set(le):
    return triage.set_status(le, _ID, "ignored", NOW, note="noise").select(*_COLUMNS)


@entries_query(
    "set_status_many",
    f"""SELECT id, CASE WHEN id IN ('{_ID}', '00000000000000000000000043') THEN 'resolved' ELSE status END AS status,
    CASE WHEN id IN ('{_ID}', '00000000000000000000000043') THEN {_NOW} END AS status_changed_at,
    CASE WHEN id IN ('{_ID}', '00000000000000000000000043') THEN NULL ELSE channel END AS status_changed_by, level AS note FROM le""",
)
def _set_many(le):
    had = le.withColumns({"status_changed_by": F.col("channel"), "note": F.col("level")})
    ids = [_ID, "00000000000000000000000043", "absent"]
    return triage.set_status_many(had, ids, "resolved", NOW).select(*_COLUMNS)


@entries_query(
    "set_status_many_frame",
    f"""SELECT id, CASE WHEN level = 'error' THEN 'triaged' ELSE status END AS status,
    CASE WHEN level = 'error' THEN {_NOW} END AS status_changed_at,
    CASE WHEN level = 'error' THEN 'ops' END AS status_changed_by, NULL::VARCHAR AS note FROM le""",
)
def _set_many_frame(le):
    ids = le.where("level = 'error'").select("id")
    return triage.set_status_many(
        le, ids.unionByName(ids), "triaged", NOW, "ops", {"triaged": {}}
    ).select(*_COLUMNS)


@entries_query(
    "set_note", f"SELECT id, CASE WHEN id = '{_ID}' THEN NULL ELSE level END AS note FROM le"
)
def _note(le):
    had = le.withColumn("note", F.col("level"))
    return triage.set_note(had, _ID, None).select("id", "note")


@entries_query("delete_entry", f"SELECT id, level FROM le WHERE id <> '{_ID}'")
def _delete(le):
    return triage.delete(le, _ID).select("id", "level")


@entries_query("delete_many", "SELECT id, level FROM le WHERE level <> 'info'")
def _delete_many(le):
    return triage.delete_many(le, le.where("level = 'info'").select("id")).select("id", "level")


@entries_query("delete_many_count", "SELECT count(*) AS deleted FROM le WHERE level = 'info'")
def _delete_count(le):
    return triage.count_listed(le, le.where("level = 'info'").select("id"))


@entries_query(
    "clear_filtered",
    "SELECT id, level, channel, status FROM le WHERE NOT coalesce(level = 'error' AND channel IN ('stack','daily') AND status = 'resolved', false)",
)
def _clear(le):
    left = triage.clear(le, levels="error", channels=["stack", "daily"], statuses="resolved")
    return left.select("id", "level", "channel", "status")


@entries_query("clear_all", "SELECT count(*) AS n FROM le WHERE false")
def _clear_all(le):
    return triage.clear(le).agg(F.count(F.lit(1)).alias("n"))


@entries_query(
    "status_options",
    """SELECT v.value, v.label, v.color, v.closed, count(le.id) AS entries FROM
    (VALUES ('open','Open','gray',false), ('investigating','Looking','yellow',false), ('resolved','Resolved','green',true),
            ('ignored','Ignored','slate',true), ('triaged','Triaged','gray',true)) AS v(value, label, color, closed)
    LEFT JOIN le ON le.status = v.value GROUP BY ALL""",
)
def _options(le):
    dimension = status_dimension(
        le.sparkSession, {"investigating": {"label": "Looking"}, "triaged": {"closed": True}}
    )
    # Counted per status first: the join then has one row per status.
    used = le.groupBy("status").agg(F.count("id").alias("entries"))
    return dimension.join(used, dimension.value == used.status, "left").select(
        "value", "label", "color", "closed", F.coalesce("entries", F.lit(0)).alias("entries")
    )


@entries_query(
    "prune", "SELECT id, occurred_at FROM le WHERE occurred_at >= TIMESTAMP '2024-01-21 00:00:00'"
)
def _prune(le):
    return retention.prune(le, NOW, 10).select("id", "occurred_at")


@entries_query("prune_disabled", "SELECT count(*) AS n FROM le")
def _prune_off(le):
    return retention.prune(le, NOW, 0, enabled=False).agg(F.count(F.lit(1)).alias("n"))


@entries_query(
    "prune_count", "SELECT count(*) AS count FROM le WHERE occurred_at < TIMESTAMP '2024-01-16 00:00:00'"
)
def _prune_count(le):
    return retention.prune_preview(le, NOW, 15).total


@entries_query(
    "prune_preview_by_level",
    "SELECT upper(level) AS level, count(*) AS count FROM le WHERE occurred_at < TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1",
)
def _prune_by_level(le):
    return retention.prune_preview(le, NOW, 15).by_level


@query(
    "prune_table",
    "SELECT id, level, occurred_at FROM le WHERE occurred_at >= TIMESTAMP '2024-01-20 12:30:00'",
)
def _prune_table(spark, sf_dir):
    path = stored_entries(spark, sf_dir, "pruned")
    # The limit falls into the middle of a day.
    retention.prune_table(spark, path, NOW - timedelta(hours=11, minutes=30), 10)
    return read_entries(spark, path).select("id", "level", "occurred_at")


@query(
    "fold_changes",
    _CHANGES
    + """SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'resolved' ELSE status END AS status,
      CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN occurred_at + INTERVAL 2 HOUR END AS status_changed_at,
      CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN channel END AS status_changed_by,
      CASE WHEN CAST(id AS BIGINT) % 9 = 0 THEN concat('note ', level) END AS note FROM le""",
)
def _fold(spark, sf_dir):
    path, log = stored_entries(spark, sf_dir, "folded"), scratch_path(spark, "changes")
    record_changes(changes(entries(spark, sf_dir)), log)
    fold_changes(spark, path, log)
    return read_entries(spark, path).select(*_COLUMNS)


@query(
    "fold_late_changes",
    """SELECT id, CASE WHEN n % 3 = 0 THEN 'resolved' ELSE status END AS status,
      CASE WHEN n % 3 = 0 THEN occurred_at + INTERVAL 2 HOUR END AS status_changed_at,
      CASE WHEN n % 3 = 0 THEN coalesce(channel, CASE WHEN n % 6 = 0 THEN 'late' END) END AS status_changed_by,
      CASE WHEN n % 9 = 0 THEN concat('note ', level) WHEN n % 6 = 0 THEN 'older' END AS note
    FROM (SELECT *, CAST(id AS BIGINT) AS n FROM le)""",
)
def _fold_late(spark, sf_dir):
    """Changes are folded in; then older ones of every second entry come, which give only what the others did not."""
    path, log = stored_entries(spark, sf_dir, "folded"), scratch_path(spark, "changes")
    made = changes(entries(spark, sf_dir))
    record_changes(made, log)
    fold_changes(spark, path, log)
    older = made.where("CAST(id AS BIGINT) % 6 = 0").withColumns(
        {
            "status": F.lit("ignored"),
            "changed_at": F.expr("changed_at - INTERVAL 4 HOURS"),
            "changed_by": F.lit("late"),
            "note": F.lit("older"),
        }
    )
    record_changes(older, log)
    fold_changes(spark, path, log)
    return current_entries(spark, path, log).select(*_COLUMNS)


@query(
    "current_entries",
    _CHANGES
    + """SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'resolved' ELSE status END AS status
    FROM le WHERE occurred_at >= TIMESTAMP '2024-01-16 00:00:00'""",
)
def _current(spark, sf_dir):
    path, log = stored_entries(spark, sf_dir, "current"), scratch_path(spark, "changes")
    record_changes(changes(entries(spark, sf_dir)), log)
    since = NOW - timedelta(days=15)
    return current_entries(spark, path, log, since).select("id", "status")


@query("delete_stored", "SELECT id, level FROM le WHERE level <> 'info'")
def _delete_stored(spark, sf_dir):
    path = stored_entries(spark, sf_dir, "deleted")
    delete_stored(spark, path, entries(spark, sf_dir).where("level = 'info'").select("id"))
    return read_entries(spark, path).select("id", "level")


@query(
    "latest_of_equal_times",
    """SELECT id, arg_max(status, k) AS status, arg_max(changed_by, k) AS changed_by FROM (
      SELECT trace_id AS id, status, concat('u', CAST(user_id AS VARCHAR(20))) AS changed_by,
        {'a': status, 'b': concat('u', CAST(user_id AS VARCHAR(20)))} AS k
      FROM le WHERE trace_id IS NOT NULL AND user_id IS NOT NULL) GROUP BY id""",
)
def _equal_times(spark, sf_dir):
    """Every trace gets the changes of all its entries at one moment: the greatest is taken whole."""
    rows = entries(spark, sf_dir).where("trace_id IS NOT NULL AND user_id IS NOT NULL")
    changed = rows.select(
        F.col("trace_id").alias("id"),
        "status",
        F.lit(NOW).alias("changed_at"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("changed_by"),
        F.lit(None).cast("string").alias("note"),
    )
    return triage.latest_status(changed).select("id", "status", "changed_by")


@query(
    "find_stored",
    _CHANGES
    + """SELECT id, message, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'resolved' ELSE status END AS status,
      CASE WHEN CAST(id AS BIGINT) % 9 = 0 THEN concat('note ', level) END AS note
    FROM le WHERE id = (SELECT max(id) FROM le WHERE level = 'error' AND CAST(id AS BIGINT) % 9 = 0)""",
)
def _find_stored(spark, sf_dir):
    """The last error with a note, as the stored table and the change log have it."""
    path, log = stored_entries(spark, sf_dir, "looked-up"), scratch_path(spark, "changes")
    record_changes(changes(entries(spark, sf_dir)), log)
    wanted = read_entries(spark, path).where("level = 'error' AND CAST(id AS BIGINT) % 9 = 0")
    entry_id = wanted.agg(F.max("id")).first()[0]
    return find_stored(spark, path, entry_id, log).select("id", "message", "status", "note")

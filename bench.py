"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local cores. Every
query is run once to warm up; the value is the median of the runs after that.
Tables and text logs that a query reads are written before its clock starts.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from datetime import timedelta

from pyspark.sql import functions as F

from logsluice.functions.url import redact_url
from logsluice.operators import filters, paging, search, stats
from logsluice.operators.failures import heartbeat
from logsluice.operators.triage import apply_changes
from logsluice.plans.capture import capture
from logsluice.plans.listing import list_entries, newest_page
from logsluice.plans.retention import prune, prune_table
from logsluice.registry.base import LATE, NOW, entries, table
from logsluice.registry.failing import failures_of
from logsluice.registry.listing import stored_entries
from logsluice.registry.textlogs import write_text
from logsluice.registry.triage import changes
from logsluice.session import build_session, scratch_path
from logsluice.sources import textlogs
from logsluice.sources.entries import read_entries, write_entries

RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def drain(df) -> None:
    """Computes every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    path = stored_entries(spark, sf_dir, "bench")
    stored = read_entries(spark, path)
    trace = stored.where("trace_id IS NOT NULL").select("trace_id").first()[0]
    address = stored.where("ip_address IS NOT NULL").select("ip_address").first()[0]
    logs = f"{write_text(spark, sf_dir, 'bench-logs')}/*/*"
    le = entries(spark, sf_dir)
    include = search.search([{"value": "user 12"}])
    exclude = search.search([{"value": "user 12", "exclude": True}])
    limit = NOW - timedelta(days=10)

    def prune_copy() -> None:
        copy = scratch_path(spark, "bench-prune")
        write_entries(stored, copy)
        start = time.perf_counter()
        prune_table(spark, copy, limit, 5)
        timed.append(time.perf_counter() - start)

    def first_page() -> None:
        page = list_entries(stored, levels="error", search_for="message:failed -deprecated")
        page.rows.collect()
        page.meta.collect()

    def found(condition) -> None:
        filters.apply_filters(stored, all_statuses=True).where(condition).limit(51).collect()

    queries = {
        "stats_by_level": lambda: stats.stats_by_level(le, LATE).collect(),
        "facet_channels": lambda: stats.facet(le, "channel").collect(),
        "search_any": lambda: drain(le.where(include)),
        "search_any_excluded": lambda: drain(le.where(exclude)),
        "search_regex": lambda: drain(le.where(search.regex_term("any", "services/s[0-3]"))),
        "search_documents": lambda: drain(
            table(spark, sf_dir, "documents")
            .withColumnRenamed("text", "message")
            .where(search.search_text("message:license -message:http"))
        ),
        "first_page_and_count": first_page,
        "newest_page": lambda: newest_page(
            spark, path, levels="error", search_for="message:failed -deprecated"
        ).collect(),
        "capped_count": lambda: paging.capped_count(stored).collect(),
        "filter_trace_id": lambda: found(filters.trace_id(trace)),
        "filter_ip_address": lambda: found(filters.ip_address(address)),
        "parse_log_text": lambda: drain(textlogs.parse_log_text(spark, logs)),
        "capture": lambda: drain(capture(le, NOW)),
        "redact_url": lambda: drain(le.select(redact_url(F.col("url")).alias("url"))),
        "apply_changes": lambda: drain(apply_changes(le, changes(le))),
        "heartbeat": lambda: drain(heartbeat(failures_of(le), order=["at", "id"])),
        "prune": lambda: drain(prune(le, NOW, 10)),
        "prune_table": prune_copy,
    }
    seconds = {}
    for name, run in queries.items():
        timed: list[float] = []
        run()
        timed.clear()
        for _ in range(RUNS):
            start = time.perf_counter()
            before = len(timed)
            run()
            if len(timed) == before:
                timed.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(timed), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

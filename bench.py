"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is run once to warm the JVM, then ``$BENCH_RUNS`` times; the median counts. The
``noop`` sink makes Spark produce every row and column without collecting them.

``$BENCH_RECORDS`` (a number, such as 40000000) measures the operators on as many generated records
instead: 300,000 users, one of whom owns a third of the records, over ten years.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

import catalog
from chronofold.operators import charts, ratios, reports, streaks, totals, weeks
from chronofold.plans.period import Period
from chronofold.sources.session import local_session

HEADLINES = (
    "task_ratio_year",
    "week_totals_year",
    "streaks_all",
    "home_summary",
    "search_page",
    "merge_edits",
    "total_per_day",
    "task_ratio_per_day",
    "page_month",
    "text_summary",
    "resolve_keys",
    "stream_daily",
)


def generated(spark, count: int):
    """Records derived from their numbers: the same on every run."""
    n = F.col("id")
    mixed = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    return spark.range(count).select(
        n.cast("string").alias("record_id"),
        F.when(n % 3 == 0, F.lit(0)).otherwise(mixed % 300_000).cast("long").alias("user_id"),
        F.concat(F.lit("Task"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(12))).alias("task_name"),
        F.lit(None).cast("string").alias("subtask"),
        F.date_add(F.lit("2015-01-01").cast("date"), (mixed % 3650).cast("int")).alias("date"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(28_800))).alias("elapsed_s"),
    )


def large_operators():
    year, as_of = Period.year(2024), dt.date(2024, 12, 31)
    return {
        "task_ratio": lambda r: ratios.task_ratio(r, year),
        "total_per_day": lambda r: totals.total_per_day(r, year),
        "week_totals_of_year": lambda r: weeks.week_points_of_year(r, 2024),
        "home_summary": lambda r: reports.home_summary(r, as_of),
        "chart_pair": lambda r: charts.chart_pair(r, "month", year),
        "streaks": lambda r: streaks.streaks(r),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINES
    spark = local_session("bench", cores)
    queries = catalog.queries()
    records = int(os.environ.get("BENCH_RECORDS", "0"))
    if records:
        runs, names = 1, sys.argv[1:] or tuple(large_operators())
        source = generated(spark, records)
        queries = {name: lambda _s, _d, f=f: f(source) for name, f in large_operators().items()}

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        if not records:
            once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 4)
    print(
        json.dumps(
            {
                "metric": "sum of median seconds of the headline queries",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": f"{records} records" if records else os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

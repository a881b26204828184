"""Operators against plain Python on random records, a third of which belong to one user."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronofold.operators import charts, ratios, reports, streaks, totals, weeks
from chronofold.plans import series
from chronofold.plans.daily import daily_totals
from chronofold.plans.period import Period

START = dt.date(2023, 12, 20)
SPAN = Period(START, START + dt.timedelta(days=59))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    made = []
    for number in range(900):
        user = 1 if rng.random() < 1 / 3 else rng.randint(2, 12)
        day = START + dt.timedelta(days=int(rng.triangular(0, 59, 20)))
        seconds = None if rng.random() < 0.1 else rng.randint(0, 9000)
        made.append((number, user, rng.choice("ABCD"), rng.choice([None, "x", "y"]), rng.choice([None, "t"]), day, seconds))
    made.append((900, 13, "A", None, None, START, None))  # nothing but a running record
    return made


@pytest.fixture(scope="module")
def records(spark, rows):
    schema = "record_id long, user_id long, task_name string, subtask string, tag string, date date, elapsed_s long"
    return spark.createDataFrame(rows, schema).repartition(5).persist()


def add(values):
    known = [v for v in values if v is not None]
    return sum(known) if known else None


def grouped(rows, key, value=lambda r: r[6]):
    groups = defaultdict(list)
    for row in rows:
        groups[key(row)].append(value(row))
    return groups


def ratio(part, whole):
    return None if part is None or not whole else (2000 * part + whole) // (2 * whole) / 10


@pytest.mark.parametrize("keys", [("user_id",), ()])
def test_task_ratio(records, rows, keys):
    user = (lambda r: r[1]) if keys else (lambda r: None)
    parts = {k: add(v) for k, v in grouped(rows, lambda r: (user(r), r[2])).items()}
    wholes = grouped([(k, v) for k, v in parts.items()], lambda kv: kv[0][0], lambda kv: kv[1])
    expected = {k: (v, ratio(v, add(wholes[k[0]]))) for k, v in parts.items()}
    got = ratios.task_ratio(records, None, keys).collect()
    assert {(r.user_id if keys else None, r.task_name): (r.total_time, r.ratio) for r in got} == expected
    for name in {k[0] for k in expected}:
        total = sum(v[1] or 0 for k, v in expected.items() if k[0] == name)
        assert total == 0 or abs(total - 100) <= 0.2


def test_ratios_come_largest_first_within_a_user(records):
    last = {}
    for row in ratios.task_ratio(records).collect():
        order = (-(row.ratio if row.ratio is not None else -1), row.task_name)
        assert last.get(row.user_id, (-1e9, "")) <= order
        last[row.user_id] = order


def test_subtask_ratio(records, rows):
    mine = [r for r in rows if r[2] == "B"]
    parts = {k: add(v) for k, v in grouped(mine, lambda r: (r[1], r[3])).items()}
    wholes = {k: add(v) for k, v in grouped(mine, lambda r: r[1]).items()}
    got = {(r.user_id, r.subtask): (r.subtask_total, r.ratio) for r in ratios.subtask_ratio(records, "B").collect()}
    assert got == {k: (v, ratio(v, wholes[k[0]])) for k, v in parts.items()}


@pytest.mark.parametrize(
    ("grain", "name"),
    [("day", "%Y-%m-%d"), ("week", "%Y-%W"), ("month", "%Y-%m"), ("year", "%Y")],
)
def test_task_ratio_by_grain(records, rows, grain, name):
    def period(r):
        return (r[1], r[5].strftime(name))

    wholes = {k: add(v) for k, v in grouped(rows, period).items()}
    parts = {k: add(v) for k, v in grouped(rows, lambda r: (*period(r), r[2])).items()}
    got = ratios.task_ratio_by(records, grain, SPAN).collect()
    assert len(got) == len(parts)
    for r in got:
        key = (r.user_id, r.period)
        assert r.period_total == wholes[key] and r.task_total == parts[(*key, r.task_name)]
        assert r.ratio == ratio(r.task_total, r.period_total)


def test_means_and_longest_day(records, rows):
    days = {k: add(v) for k, v in grouped(rows, lambda r: (r[1], r[5])).items()}
    in_2024 = {k: v for k, v in days.items() if k[1].year == 2024}
    as_of = dt.date(2024, 1, 15)

    def mean(group):
        per = grouped([(k, v) for k, v in in_2024.items()], lambda kv: (kv[0][0], group(kv[0][1])), lambda kv: kv[1])
        sums = grouped([(k, add(v)) for k, v in per.items()], lambda kv: kv[0][0], lambda kv: kv[1])
        return {u: (lambda k: sum(k) / len(k) if k else 0.0)([x for x in v if x is not None]) for u, v in sums.items()}

    groups = {"day": lambda d: d, "week": lambda d: d.strftime("%W"), "month": lambda d: d.month}
    summary = {r.user_id: r for r in reports.summaries(records, {"day": Period.day(as_of)}, as_of).collect()}
    for grain, group in groups.items():
        expected = mean(group)
        got = {r.user_id: r[f"mean_{grain}"] for r in totals.mean_per_period(records, grain, as_of).collect()}
        assert got == expected
        assert all(summary[user][f"mean_{grain}"] == value for user, value in expected.items())
    for r in totals.longest_day(records).collect():
        mine = {k[1]: v for k, v in days.items() if k[0] == r.user_id and v is not None}
        assert r.total_time == max(mine.values())
        assert r.date == min(d for d, v in mine.items() if v == r.total_time)


def test_streaks(records, rows):
    got = {(r.user_id, r.task_name): (r.longest_streak, r.current_streak) for r in streaks.streaks(records).collect()}
    for key, days in grouped(rows, lambda r: (r[1], r[2]), lambda r: r[5]).items():
        longest = current = 0
        previous = None
        for day in sorted(set(days)):
            current = current + 1 if previous and (day - previous).days == 1 else 1
            longest = max(longest, current)
            previous = day
        assert got.pop(key) == (longest, current)
    assert got == {}


def test_week_totals_are_gap_free(spark, records, rows):
    begin, end = dt.date(2024, 1, 1), dt.date(2024, 2, 10)
    users = spark.createDataFrame([(u,) for u in range(1, 16)], "user_id long")
    got = {(r.user_id, r.week_group): r.week_total for r in weeks.week_totals_in_range(records, begin, end, users=users).collect()}
    monday = begin
    sums = defaultdict(int)
    for r in rows:
        if begin <= r[5] < end:
            sums[r[1], (r[5] - monday).days // 7 + 1] += r[6] or 0
    assert got == {(u, w): sums[u, w] for u in range(1, 16) for w in range(1, 7)}


@pytest.mark.parametrize("size", [7, 128, 129, 1000])
def test_series_of_any_length_are_spread_alike(records, rows, size):
    first = START
    place = F.date_diff("date", F.lit(first))
    placed = records.withColumn("place", place).filter(place.between(0, size - 1))
    values = {"total": (F.sum("elapsed_s"), "0L"), "n": (F.count(F.lit(1)), "0L")}
    got = {r.user_id: (r.total, r.n) for r in series.spread(placed, ["user_id"], size, values, size - 2).collect()}
    want = defaultdict(lambda: ([0] * size, [0] * size))
    for r in rows:
        at = (r[5] - first).days if r[5] else -1
        if 0 <= at < size:
            want[r[1]][0][at] += r[6] or 0
            want[r[1]][1][at] += 1
    for total, n in want.values():
        total[-2:] = n[-2:] = [None, None]
    assert got == dict(want)


def test_chart_pair_agrees_with_its_parts(records):
    pair = {r.user_id: r for r in charts.chart_pair(records, "week", SPAN).collect()}
    lines = {r.user_id: r.data for r in charts.line_chart(records, "week", SPAN).collect()}
    assert {u: r.line for u, r in pair.items()} == lines
    stacked = defaultdict(list)
    for r in charts.stacked_chart(records, "week", SPAN).collect():
        stacked[r.user_id].append((r.name, r.data))
    assert {u: [(s.name, s.data) for s in r.stacked] for u, r in pair.items()} == {u: sorted(v) for u, v in stacked.items()}
    for user, series in stacked.items():
        for place, total in enumerate(lines[user]):
            share = sum(data[place] for _, data in series)
            assert (total == 0 and share == 0) or abs(share - 100) <= 0.2


def plain(frame):
    return sorted(map(repr, frame.collect()))


@pytest.mark.parametrize(
    "operator",
    [
        totals.timer_count,
        totals.total_time,
        totals.open_records,
        totals.longest_day,
        totals.average_day,
        totals.date_bounds,
        totals.task_list,
        ratios.task_ratio,
        streaks.streaks,
        lambda frame: totals.average_per_weekday(frame, SPAN),
        lambda frame: totals.year_report(frame, SPAN),
        lambda frame: ratios.subtask_ratio(frame, "A"),
        lambda frame: weeks.past_weeks(frame, dt.date(2024, 1, 31), 4),
        lambda frame: charts.chart_pair(frame, "week", SPAN),
        lambda frame: reports.home_summary(frame, dt.date(2024, 1, 31)),
        lambda frame: reports.text_summary(frame, dt.date(2024, 1, 10)),
    ],
)
def test_daily_totals_stand_in_for_records(records, operator):
    assert plain(operator(daily_totals(records))) == plain(operator(records))

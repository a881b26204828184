"""Data-quality checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.ingest import _known_tasks, event_log
from catalog.registry import query
from catalog.views import RE, table
from chronofold.operators import quality
from chronofold.sources import schema

_NOW = dt.datetime(2024, 1, 25, 12, 0, 0)


def _incoming(spark, sf_dir):
    """Events as a client batch with faults: the operation is the event type where it fits,
    short keys, slashes in dates, a 25th hour and missing ends depend on the value."""
    value = F.col("value")
    ts = F.col("ts")
    operation = (
        F.when(F.col("event_type") == "click", F.lit("old"))
        .when(F.col("event_type") == "view", F.lit("begin"))
        .when(F.col("event_type") == "purchase", F.lit("ending"))
        .when(F.col("event_type") == "signup", F.lit("edit"))
        .otherwise(F.col("event_type"))
    )
    guid = F.md5(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record_id"),
        operation.alias("operation"),
        F.when(value < 2, F.lit(None))
        .when(value < 5, F.substring(guid, 1, 25))
        .otherwise(F.substring(guid, 1, 26))
        .alias("guid"),
        F.when(value.between(5, 8), F.date_format(ts, "yyyy/MM/dd"))
        .when(value.between(9, 12), F.lit(None))
        .when(value.between(13, 14), F.lit("2024-02-30"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
        .alias("date"),
        F.when(value.between(7, 9), F.lit("25:00:00")).otherwise(F.date_format(ts, "HH:mm:ss")).alias("time_beginning"),
        F.when(value.between(11, 16), F.lit(None)).otherwise(F.date_format(ts, "HH:mm:ss")).alias("time_ending"),
    )


@query(
    "dq_records",
    """with i as (select event_id as record_id,
          case event_type when 'click' then 'old' when 'view' then 'begin' when 'purchase' then 'ending'
               when 'signup' then 'edit' else event_type end as op,
          case when value < 2 then null when value < 5 then 25 else 26 end as len,
          case when value between 5 and 8 then 'bad' when value between 9 and 12 then null
               when value between 13 and 14 then 'bad' else 'ok' end as day,
          case when value between 7 and 9 then 'bad' else 'ok' end as b,
          case when value between 11 and 16 then null else 'ok' end as e,
          date_trunc('second', ts) > timestamp '2024-01-25 12:00:00' as late from events),
        p as (select record_id, [
          case when op not in ('old', 'begin', 'ending', 'edit') then 'operation' end,
          case when len = 25 or (len is null and op in ('ending', 'edit')) then 'guid' end,
          case when day = 'bad' or (day is null and op in ('old', 'begin', 'edit')) then 'date' end,
          case when b = 'bad' then 'time_beginning' end,
          case when e is null and op in ('old', 'ending', 'edit') then 'time_ending' end,
          case when late and day = 'ok' and (b = 'ok' or e = 'ok') then 'future' end] as rules from i)
        select record_id, cast(to_json(list_filter(rules, lambda r: r is not null)) as varchar) as problems
        from p""",
)
def dq_records(spark, sf_dir):
    return quality.record_problems(_incoming(spark, sf_dir), _NOW).select("record_id", "problems")


@query(
    "dq_duplicates",
    """select p_brand as task_name, nullif(p_type, 'PROMO') as subtask, count(*) as count
       from part group by 1, 2 having count(*) > 1""",
)
def dq_duplicates(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("task_name"),
        F.nullif(F.col("p_type"), F.lit("PROMO")).alias("subtask"),
    )
    return quality.duplicates(pairs, ["task_name", "subtask"])


@query(
    "dq_names",
    r"""with n as (select p_name as name from part union select p_type from part
          union select cast(p_size as varchar) from part union select '-' || p_size from part
          union select case when p_size = 1 then '' else p_brand end from part)
        select name, case when regexp_matches(name, '\s') then 'whitespace'
                          when regexp_matches(name, '^[+-]?\d+(_\d+)*$') then 'number'
                          when name = '' then 'empty' end as task_problem,
               case when regexp_matches(name, '\s') then 'whitespace'
                    when regexp_matches(name, '^[+-]?\d+(_\d+)*$') then 'number' end as tag_problem
        from n""",
)
def dq_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    candidates = F.array(
        F.col("p_name"),
        F.col("p_type"),
        size,
        F.concat(F.lit("-"), size),
        F.when(F.col("p_size") != 1, F.col("p_brand")).otherwise(F.lit("")),
    )
    names = part.select(F.explode(candidates).alias("name")).distinct()
    return names.select(
        "name",
        quality.name_problem(F.col("name"), required=True).alias("task_problem"),
        quality.name_problem(F.col("name")).alias("tag_problem"),
    )


@query(
    "dq_orphans",
    f"""with {RE} select record_id, 'unknown task' as problem from re where subtask is null
        union all select record_id, 'unknown tag' from re where tag = 'tag3'""",
)
def dq_orphans(spark, sf_dir):
    log = event_log(spark, sf_dir)
    found = quality.orphans(
        log.records, _known_tasks(log.tasks), log.tags.filter(F.col("tag") != "tag3")
    )
    return found.select("record_id", "problem")


@query(
    "client_batch",
    """select upper(md5(cast(event_id as varchar))) as guid, user_id, event_type as operation,
              strftime(ts, '%Y-%m-%d') as date, strftime(ts, '%H:%M:%S') as time_beginning, props as log
       from events""",
)
def client_batch(spark, sf_dir):
    """A batch with a client's spelling of the columns, and fields that nobody asked for."""
    ts = F.col("ts")
    sent = table(spark, sf_dir, "events").select(
        F.col("value").alias("clientVersion"),
        F.col("props").alias("log"),
        F.date_format(ts, "HH:mm:ss").alias("timeBeginning"),
        F.date_format(ts, "yyyy-MM-dd").alias("date"),
        F.col("event_type").alias("operation"),
        F.col("user_id").alias("userId"),
        F.upper(F.md5(F.col("event_id").cast("string"))).alias("guid"),
        F.lit(True).alias("darkMode"),
    )
    return schema.known_columns(schema.snake_case_columns(sent))

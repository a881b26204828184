"""Record search, lookups, JSON and text rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.selection import order_log, star_schema
from catalog.sqltext import iso
from catalog.views import RE, RL, RO, document_records, event_records, table
from chronofold.functions.text import join_log_pieces, split_task_text, title_case
from chronofold.operators import search
from chronofold.sources import schema
from chronofold.sources.session import scratch_dir
from chronofold.sources.tables import write_dimension, write_records

_ASCII_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOUND = f"""{RL}, f as (select record_id, user_id, task_name, subtask, date, tag, elapsed_s, log from rl
    where year(date) = 2024 and date between date '2024-02-01' and date '2024-10-31'
      and contains({_ASCII_FOLD.format('log')}, 'the'))"""
_REQUEST = {"rangeBeginning": "2024-02-01", "rangeEnding": "2024-10-31", "logIncludes": "The"}
_COLUMNS = f"record_id, user_id, task_name, subtask, {iso('date')} as date, tag, elapsed_s, log"


@query(
    "search_log",
    f"""with {RL} select record_id, user_id, log from rl
        where contains({_ASCII_FOLD.format('log')}, 'reti%')
           or contains({_ASCII_FOLD.format('log')}, 'eaux e')""",
)
def search_log(spark, sf_dir):
    """Signs of a pattern are plain text in a search."""
    from chronofold.functions.text import contains_text

    log = F.col("log")
    found = document_records(spark, sf_dir).filter(
        contains_text(log, "reti%") | contains_text(log, "EAUX E")
    )
    return found.select("record_id", "user_id", "log")


@query("search_records", f"with {_FOUND} select {_COLUMNS} from f")
def search_records(spark, sf_dir):
    return search.search(document_records(spark, sf_dir), _REQUEST)


@query(
    "search_page",
    f"""with {_FOUND}, n as (select cast(ceil(count(*) / 20.0) as bigint) as pages from f)
        select {_COLUMNS.replace('date)', 'f.date)').replace("strftime(date", "strftime(f.date")}, pages
        from f, n order by f.date desc, record_id limit 20 offset 40""",
)
def search_page(spark, sf_dir):
    found = search.search(document_records(spark, sf_dir), _REQUEST)
    return search.page_with_count(found, number=3, page_size=20)


@query(
    "search_page_after",
    f"""with {_FOUND} select record_id, {iso('f.date')} as date from f
        where f.date < date '2024-07-01' or (f.date = date '2024-07-01' and record_id > 182)
        order by f.date desc, record_id limit 15""",
)
def search_page_after(spark, sf_dir):
    found = search.search(document_records(spark, sf_dir), _REQUEST)
    return search.page_after(found, dt.date(2024, 7, 1), 182, 15).select("record_id", "date")


@query(
    "search_page_last",
    f"""with {_FOUND}, n as (select count(*) as n from f)
        select record_id, {iso('f.date')} as date from f
        order by f.date desc, record_id limit 20 offset (select greatest(cast(ceil(n / 20.0) as bigint) - 1, 0) * 20 from n)""",
)
def search_page_last(spark, sf_dir):
    """The last page by its number: rows are ranked once, then a page opens only its range."""
    pages = search.ranked(search.search(document_records(spark, sf_dir), _REQUEST))
    return pages.page(max(pages.pages(20), 1), 20).select("record_id", "date")


@query("page_count", f"with {_FOUND} select cast(ceil(count(*) / 20.0) as bigint) as pages from f")
def page_count(spark, sf_dir):
    found = search.search(document_records(spark, sf_dir), _REQUEST)
    return search.page_count(found, 20)


@query(
    "records_by_guid",
    f"""with {RO}, g as (select distinct l_orderkey from lineitem where l_returnflag = 'R')
        select record_id, user_id, task_name, subtask, {iso('date')} as date, tag, elapsed_s
        from ro where record_id in (select l_orderkey from g)""",
)
def records_by_guid(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return search.by_keys(
        order_log(spark, sf_dir), wanted.select(F.col("l_orderkey").alias("record_id"))
    )


@query(
    "records_stored",
    f"""with {RE} select cast(record_id as varchar) as record_id, user_id, task_name, subtask, {iso('date')} as date,
            strftime(begin_ts, '%Y-%m-%d %H:%M:%S') as begin_ts, tag, elapsed_s
        from re where record_id in (select conv_id from conversations)""",
)
def records_stored(spark, sf_dir):
    """Events in a stored table, those that conversations name looked up by their key."""
    log = star_schema(event_records(spark, sf_dir))
    root = scratch_dir(spark, "stored")
    nothing = {"end_ts": "timestamp_ntz", "log": "string"}
    records = log.records.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    records = records.withColumn("record_id", F.col("record_id").cast("string"))
    write_records(records.select(*[f.name for f in schema.RECORDS.fields]), root)
    write_dimension(log.tasks, root, "tasks")
    write_dimension(log.tags, root, "tags")
    wanted = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("record_id"))
    return search.find_by_keys(spark, root, wanted).drop("end_ts", "log")


@query(
    "records_json",
    f"""with {RL} select record_id, cast(to_json(struct_pack(record_id := record_id,
          user_id := user_id, task_name := task_name, subtask := subtask,
          date := {iso('date')}, tag := tag, elapsed_s := elapsed_s, log := log)) as varchar) as record
        from rl""",
)
def records_json(spark, sf_dir):
    return search.as_json(search.search(document_records(spark, sf_dir), {}))


@query(
    "assemble_logs",
    """select conv_id as record_id, string_agg(text, '  ' || chr(10) order by turn, text) as log
       from conversations group by conv_id""",
)
def assemble_logs(spark, sf_dir):
    pieces = table(spark, sf_dir, "conversations")
    return pieces.groupBy(F.col("conv_id").alias("record_id")).agg(
        join_log_pieces("turn", "text").alias("log")
    )


_TITLE = r"""array_to_string(list_transform(regexp_extract_all({0}, '(\p{{L}}+|\P{{L}}+)'),
    lambda x: upper(x[1:1]) || lower(x[2:])), '')"""


@query(
    "parse_task_text",
    rf"""with t as (select p_partkey, trim(p_brand || '/' || lower(p_type) || ' ' || p_name) as s from part
          union all select p_partkey, lower(p_type) from part),
        w as (select p_partkey, regexp_extract(s, '^(\w*)(\W(.*))?$', 1) as a,
              case when regexp_matches(s, '\W') then regexp_extract(s, '^\w*\W(.*)$', 1) end as b from t)
        select p_partkey, {_TITLE.format('a')} as task, {_TITLE.format('b')} as subtask from w""",
)
def parse_task_text(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kind = F.lower("p_type")
    full = F.concat(F.lit("  "), F.col("p_brand"), F.lit("/"), kind, F.lit(" "), F.col("p_name"))
    texts = part.select("p_partkey", full.alias("text")).unionByName(
        part.select("p_partkey", kind.alias("text"))
    )
    task, subtask = split_task_text(F.col("text"))
    return texts.select("p_partkey", task.alias("task"), subtask.alias("subtask"))


@query(
    "normalise_tasks",
    rf"""with t as (select p_partkey, p_name || '-' || p_type || '''s ' || p_brand || '2x' as s from part)
        select p_partkey, {_TITLE.format('s')} as task from t""",
)
def normalise_tasks(spark, sf_dir):
    text = F.concat(
        F.col("p_name"), F.lit("-"), F.col("p_type"), F.lit("'s "), F.col("p_brand"), F.lit("2x")
    )
    return table(spark, sf_dir, "part").select("p_partkey", title_case(text).alias("task"))

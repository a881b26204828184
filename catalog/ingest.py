"""Batch ingest and merge jobs on the event records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.search import _TITLE as TITLE
from catalog.selection import key_sql, order_log, star_schema
from catalog.sqltext import iso
from catalog.views import RE, RO, event_records, guid_sql, table
from chronofold.functions.calendar import moment_lit
from chronofold.functions.keys import stable_guid, stable_id
from chronofold.operators import ingest
from chronofold.plans import uses
from chronofold.sources.session import kept

_NOW = dt.datetime(2024, 1, 31, 9, 30, 0)
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _stamp(moment: str) -> str:
    return _STAMP.format(moment)


def event_log(spark, sf_dir):
    return star_schema(event_records(spark, sf_dir))


def _known_tasks(tasks: DataFrame) -> DataFrame:
    """A catalogue that lacks the tasks without a subtask."""
    return tasks.filter(F.col("subtask").isNotNull())


def _end(records: DataFrame) -> DataFrame:
    seconds = F.make_dt_interval(secs=F.col("elapsed_s").cast("decimal(18,6)"))
    return records.withColumn("end_ts", F.col("begin_ts") + seconds)


# Elapsed seconds of two clock times, as the twins compute them.
def _elapsed(begin: str, end: str) -> str:
    diff = f"cast(epoch(cast({end} as time)) - epoch(cast({begin} as time)) as bigint)"
    return f"case when {diff} > 0 then {diff} else {diff} + 86400 end"


@query(
    "resolve_keys",
    f"""with {RE} select record_id,
          case when subtask is not null then {key_sql('task_name', 'subtask')} end as task_id,
          case when tag <> 'tag3' then {key_sql('tag')} end as tag_id,
          case when subtask is null then 'unknown task' when tag = 'tag3' then 'unknown tag' end as problem
        from re""",
)
def resolve_keys(spark, sf_dir):
    log = event_log(spark, sf_dir)
    tag = F.col("tag")
    incoming = event_records(spark, sf_dir).select(
        "record_id",
        stable_guid(F.col("task_name"), F.col("subtask")).alias("task_guid"),
        F.when(tag.isNotNull(), stable_guid(tag)).alias("tag_guid"),
    )
    resolved = ingest.resolve_keys(incoming, _known_tasks(log.tasks), log.tags.filter(tag != "tag3"))
    return resolved.select("record_id", "task_id", "tag_id", "problem")


@query(
    "resolve_task_nullsafe",
    f"with {RE} select record_id, task_name, subtask, {key_sql('task_name', 'subtask')} as task_id from re",
)
def resolve_task_nullsafe(spark, sf_dir):
    named = event_records(spark, sf_dir).select("record_id", "task_name", "subtask")
    return ingest.resolve_task_names(named, event_log(spark, sf_dir).tasks)


_NAMES = f"""{RE}, e as (select distinct {TITLE.format('task_name')} as task_name,
    {TITLE.format('subtask')} as subtask from re)"""


@query(
    "ingest_new_tasks",
    rf"""with {_NAMES}, n as (select distinct {TITLE.format('p_brand')} as task_name,
            {TITLE.format('p_type')} as subtask from part
          union select task_name, subtask from e where subtask is null)
        select {key_sql('task_name', 'subtask')} as task_id, task_name, subtask,
               {guid_sql('task_name', 'subtask')} as guid from n""",
)
def ingest_new_tasks(spark, sf_dir):
    existing = ingest.normalise_tasks(_known_tasks(event_log(spark, sf_dir).tasks))
    named = event_records(spark, sf_dir).select("task_name", "subtask")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("task_name"), F.col("p_type").alias("subtask")
    )
    return ingest.new_tasks(named.unionByName(parts), existing)


@query(
    "merge_tasks",
    rf"""with {RE}, t as (select distinct task_name, subtask from re),
        c as (select task_name, max_by(coalesce(tag, ''), record_id) as tag from re where subtask is null group by 1),
        m as (select t.*, c.tag, t.subtask is null as changed from t left join c on c.task_name = t.task_name)
        select {key_sql('task_name', 'subtask')} as task_id,
               case when changed then {TITLE.format("'new-' || task_name")} else task_name end as task_name,
               case when changed then {TITLE.format("nullif(tag, '')")} else subtask end as subtask,
               {guid_sql('task_name', 'subtask')} as guid from m""",
)
def merge_tasks(spark, sf_dir):
    """Tasks without a subtask are renamed many times over; the last change counts."""
    tasks = event_log(spark, sf_dir).tasks
    changes = (
        event_records(spark, sf_dir)
        .filter(F.col("subtask").isNull())
        .select(
            stable_guid(F.col("task_name"), F.col("subtask")).alias("guid"),
            F.concat(F.lit("new-"), F.col("task_name")).alias("task_name"),
            F.coalesce("tag", F.lit("")).alias("subtask"),
            F.col("record_id").alias("seq"),
        )
    )
    return ingest.update_tasks(tasks, changes)


@query(
    "task_change_outcome",
    f"""with {RE}, t as (select distinct task_name, subtask from re),
        c as (select *, case when subtask is null then 'refused'
                  when subtask = 'Sub1' then 'changed' else 'refused' end as outcome from t)
        select {guid_sql('task_name', 'subtask')} as guid, outcome from c
        union all select {guid_sql('p_brand')} as guid, 'unknown' from (select distinct p_brand from part)""",
)
def task_change_outcome(spark, sf_dir):
    """Tasks without a subtask ask for a name that is taken, the others of an event type ask for
    one new name, which the first gets; parts are no tasks."""
    tasks = event_log(spark, sf_dir).tasks.withColumn("task_name", F.initcap("task_name"))
    seq = F.coalesce(F.substring("subtask", 4, 9).cast("long"), F.lit(0)).alias("seq")
    new = F.when(F.col("subtask").isNull(), F.lit("sub1")).otherwise(F.lit("renamed"))
    asked = tasks.select("guid", "task_name", new.alias("subtask"), seq)
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    unknown = brands.select(
        stable_guid(F.col("p_brand")).alias("guid"),
        F.col("p_brand").alias("task_name"),
        F.lit("x").alias("subtask"),
        F.lit(1).cast("long").alias("seq"),
    )
    known = ingest.normalise_tasks(tasks)
    return ingest.task_change_outcome(known, asked.unionByName(unknown))


@query(
    "rename_and_add_again",
    f"""with {RE}, t as (select distinct task_name as n, subtask from re where subtask is not null)
        select count(*) * 2 as tasks, count(*) * 2 as ids from t""",
)
def rename_and_add_again(spark, sf_dir):
    """Every task is renamed and its old name added again: two tasks, two keys."""
    tasks = ingest.normalise_tasks(_known_tasks(event_log(spark, sf_dir).tasks))
    changes = tasks.select(
        "guid", F.concat(F.lit("old "), "task_name").alias("task_name"), "subtask", F.lit(1).alias("seq")
    )
    renamed = ingest.update_tasks(tasks, changes)
    both = ingest.add_tasks(tasks, renamed)
    return both.agg(F.count("*").alias("tasks"), F.countDistinct("task_id").alias("ids"))


@query(
    "change_outcome",
    f"""with {RE} select doc_id as record_id,
          case when record_id is null then 'unknown' else 'applied' end as outcome
        from documents left join (select record_id from re where subtask is not null) on record_id = doc_id""",
)
def change_outcome(spark, sf_dir):
    """What becomes of edits when only records with a subtask are stored."""
    stored = event_records(spark, sf_dir).filter(F.col("subtask").isNotNull())
    edits = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"))
    return ingest.change_outcome(stored, edits)


@query(
    "tag_ids_from_text",
    f"""with w as (select doc_id as record_id, '  ' || source || ' ' as tag_text from documents
          union all select c_custkey, c_mktsegment from customer
          union all select s_suppkey, '  ' from supplier)
        select record_id, tag_text, nullif(trim(tag_text), '') as tag,
               case when trim(tag_text) <> '' then {key_sql("trim(tag_text)")} end as tag_id from w""",
)
def tag_ids_from_text(spark, sf_dir):
    """Records whose tag is written as text: the market segments are known as tags, the sources
    are named for the first time and created, blanks are no tag. The batch with its ``tag_id``."""
    customers = table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    tags = customers.select(segment.alias("tag")).distinct().select(
        stable_id(F.col("tag")).alias("tag_id"), "tag", stable_guid(F.col("tag")).alias("guid")
    )
    named = (
        table(spark, sf_dir, "documents")
        .select(F.col("doc_id").alias("record_id"), F.concat(F.lit("  "), "source", F.lit(" ")).alias("tag_text"))
        .unionByName(customers.select(F.col("c_custkey").alias("record_id"), segment.alias("tag_text")))
        .unionByName(
            table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record_id"), F.lit("  ").alias("tag_text"))
        )
    )
    return ingest.tag_ids_from_text(named, tags)[1]


@query(
    "deletable_by_uses",
    f"""with {RE}, {RO}, w as (select distinct task_name, subtask, 'blocked' as outcome from re
          union all select distinct task_name, subtask, 'deleted' from ro)
        select {guid_sql('task_name', 'subtask')} as guid, outcome from w""",
)
def deletable_by_uses(spark, sf_dir):
    """Deletions checked against the monthly reference counts that a merge keeps, no records read."""
    events, orders = event_log(spark, sf_dir), order_log(spark, sf_dir)
    tasks = events.tasks.unionByName(orders.tasks)
    counts = kept(uses.month_uses(events.records), "uses")
    return ingest.deletion_outcome(tasks, "task_id", tasks.select("guid"), uses.used(counts, "task_id"))


@query(
    "deletable_tasks",
    f"""with {RE}, {RO}, w as (select distinct task_name, subtask, 'blocked' as outcome from re
          union all select distinct task_name, subtask, 'deleted' from ro
          union all select distinct p_brand, null, 'unknown' from part)
        select {guid_sql('task_name', 'subtask')} as guid, outcome from w""",
)
def deletable_tasks(spark, sf_dir):
    events, orders = event_log(spark, sf_dir), order_log(spark, sf_dir)
    tasks = events.tasks.unionByName(orders.tasks)
    brands = table(spark, sf_dir, "part").select(
        stable_guid(F.col("p_brand"), F.lit(None)).alias("guid")
    )
    wanted = tasks.select("guid").unionByName(brands)
    return ingest.deletion_outcome(tasks, "task_id", wanted, events.records)


@query(
    "merge_tags",
    f"""with {RE}, t as (select distinct tag as old, upper(tag) as tag from re where tag is not null),
        a as (select distinct event_type as old, event_type as tag from events),
        u as (select * from t union all select * from a)
        select {key_sql('old')} as tag_id, tag, {guid_sql('old')} as guid from u""",
)
def merge_tags(spark, sf_dir):
    """All event tags are renamed, all tags are asked to go, the event types are added:
    the tags of the orders disappear, the used ones stay under their new names."""
    events, orders = event_log(spark, sf_dir), order_log(spark, sf_dir)
    tags = events.tags.unionByName(orders.tags)

    def entries(frame, operation, guid, tag):
        return frame.select(
            F.lit(operation).alias("operation"),
            guid.alias("guid"),
            tag.alias("tag"),
            F.lit(1).alias("seq"),
        )

    none = F.lit(None).cast("string")
    changes = (
        entries(events.tags, "rename", F.col("guid"), F.upper("tag"))
        .unionByName(entries(tags, "delete", F.col("guid"), none))
        .unionByName(entries(table(spark, sf_dir, "events"), "add", none, F.col("event_type")))
    )
    return ingest.merge_tags(tags, changes, events.records)


@query(
    "ingest_finished",
    f"""with {RE}, e as (select record_id, user_id, date, begin_ts,
          begin_ts + to_seconds(elapsed_s) as e0 from re),
        s as (select *, {_elapsed('begin_ts', 'e0')} as elapsed_s from e)
        select record_id, user_id, {iso('date')} as date, {_stamp('begin_ts')} as begin_ts,
               {_stamp('begin_ts + to_seconds(elapsed_s)')} as end_ts, elapsed_s from s""",
)
def ingest_finished(spark, sf_dir):
    """Records arrive as text; those without an end come in as running records."""
    records = _end(event_records(spark, sf_dir))
    incoming = records.select(
        "record_id",
        "user_id",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.date_format("begin_ts", "HH:mm:ss").alias("time_beginning"),
        F.date_format("end_ts", "HH:mm:ss").alias("time_ending"),
    )
    return ingest.typed_records(incoming)


@query(
    "pair_begin_end",
    f"""with {RE}, e as (select re.*, props as log, begin_ts + to_seconds(elapsed_s) as e0
          from re join events on event_id = record_id),
        s as (select *, {_elapsed('begin_ts', 'e0')} as s from e)
        select record_id, user_id, {_stamp('begin_ts')} as begin_ts,
               {_stamp('begin_ts + to_seconds(s)')} as end_ts, s as elapsed_s,
               case when s is not null then log end as log from s""",
)
def pair_begin_end(spark, sf_dir):
    records = _end(event_records(spark, sf_dir))
    beginnings = records.select(
        "record_id",
        "user_id",
        "begin_ts",
        F.lit(None).cast("timestamp_ntz").alias("end_ts"),
        F.lit(None).cast("long").alias("elapsed_s"),
        F.lit(None).cast("string").alias("log"),
    )
    logs = table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), "props")
    endings = (
        records.filter(F.col("end_ts").isNotNull())
        .join(logs, "record_id")
        .select(
            "record_id",
            F.col("end_ts").alias("time_ending"),
            F.col("props").alias("log"),
            F.lit(1).alias("seq"),
        )
    )
    return ingest.add_endings(beginnings, endings)


@query(
    "merge_edits",
    f"""with {RE}, d as (select doc_id, source, lang, n_chars, text,
          timestamp '2024-02-01 23:00:00' + to_seconds(n_chars % 3000) as b,
          timestamp '2024-02-01 23:00:00' + to_seconds(n_chars % 3000) + to_seconds(n_chars % 5000) as e
          from documents),
        j as (select re.*, d.*, doc_id is not null as edited from re left join d on doc_id = record_id),
        k as (select *, {_elapsed('b', 'e')} as s from j)
        select record_id, case when edited then {key_sql('source', 'lang')}
                 else {key_sql('task_name', 'subtask')} end as task_id,
               case when edited then '2024-02-01' else {iso('date')} end as date,
               case when edited then {_stamp('b')} else {_stamp('begin_ts')} end as begin_ts,
               case when edited then {_stamp('b + to_seconds(s)')} else {_stamp('begin_ts + to_seconds(elapsed_s)')} end as end_ts,
               case when edited then s else elapsed_s end as elapsed_s,
               case when lang = 'en' then {key_sql('lang')} when tag is not null then {key_sql('tag')} end as tag_id,
               case when n_chars > 300 then text end as log
        from k""",
)
def merge_edits(spark, sf_dir):
    """Documents edit the events they share a number with. Tag and log are new in some."""
    stored = _end(event_log(spark, sf_dir).records).withColumn("log", F.lit(None).cast("string"))
    chars = F.col("n_chars")

    def seconds(count):
        return F.make_dt_interval(secs=count.cast("decimal(18,6)"))

    begin = moment_lit(dt.datetime(2024, 2, 1, 23, 0)) + seconds(chars % 3000)
    edits = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("record_id"),
        stable_id(F.col("source"), F.col("lang")).alias("task_id"),
        F.lit(dt.date(2024, 2, 1)).alias("date"),
        begin.alias("begin_ts"),
        (begin + seconds(chars % 5000)).alias("end_ts"),
        F.when(F.col("lang") == "en", stable_id(F.col("lang"))).alias("tag_id"),
        F.when(chars > 300, F.col("text")).alias("log"),
        F.lit(1).alias("seq"),
    )
    return ingest.apply_edits(stored, edits).drop("user_id")


@query(
    "extend_last",
    f"""with {RE}, l as (select user_id, max_by(struct_pack(r := record_id, b := begin_ts), record_id) as x
          from re group by 1),
        s as (select user_id, x.r as record_id, x.b as begin_ts,
                     {_elapsed('x.b', "timestamp '2024-01-31 09:30:00'")} as elapsed_s from l)
        select user_id, record_id, {_stamp('begin_ts')} as begin_ts,
               {_stamp('begin_ts + to_seconds(elapsed_s)')} as end_ts, elapsed_s from s""",
)
def extend_last(spark, sf_dir):
    records = event_records(spark, sf_dir).select("user_id", "record_id", "begin_ts", "elapsed_s")
    return ingest.extend_last(records, _NOW)

"""The driver's tables seen as time records.

Each view exists twice: as a DataFrame and as the text of a DuckDB common table expression.
Orders span several years, events carry begin times and running records, documents carry
log text.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS_AS_OF = dt.date(2001, 8, 1)
EVENTS_AS_OF = dt.date(2024, 1, 30)
DOCUMENTS_AS_OF = dt.date(2024, 12, 31)

RO = """ro as (
  select o_orderkey as record_id, o_custkey as user_id, o_orderpriority as task_name,
         case when o_orderstatus = 'P' then null else o_orderstatus end as subtask,
         case when c_custkey % 7 = 0 then null else c_mktsegment end as tag,
         cast(o_orderdate as date) as date,
         cast(floor(o_totalprice) as bigint) % 28800 as elapsed_s
  from orders join customer on c_custkey = o_custkey)"""

RE = """re as (
  select event_id as record_id, user_id, event_type as task_name,
         case when k % 4 = 0 then null else concat('Sub', cast(k % 4 as varchar)) end as subtask,
         case when user_id % 7 = 0 then null
              else concat('tag', cast(user_id % 5 as varchar)) end as tag,
         cast(ts as date) as date, date_trunc('second', ts) as begin_ts,
         case when event_id % 50 = 0 then null
              else cast(floor(value * 60) as bigint) end as elapsed_s
  from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events))"""

RL = """rl as (
  select doc_id as record_id, doc_id % 50 as user_id, source as task_name, lang as subtask,
         cast(null as varchar) as tag, date '2024-01-01' + cast(doc_id % 366 as int) as date,
         n_chars as elapsed_s, text as log
  from documents)"""


# Declared, so that opening a table reads no file footer on the driver.
_SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
    "props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "supplier": "s_suppkey long",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def order_records(spark: SparkSession, sf_dir: str, with_tag: bool = False) -> DataFrame:
    """Records from orders. The customer join is made only when the tag is asked for."""
    orders = table(spark, sf_dir, "orders")
    columns = [
        F.col("o_orderkey").alias("record_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("task_name"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("subtask"),
        F.col("o_orderdate").cast("date").alias("date"),
        (F.floor("o_totalprice").cast("long") % 28800).alias("elapsed_s"),
    ]
    if with_tag:
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        orders = orders.join(customers, F.col("c_custkey") == F.col("o_custkey"))
        columns.append(F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("tag"))
    return orders.select(*columns)


def order_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))


def _whole_second(moment: Column) -> Column:
    return F.make_timestamp_ntz(
        F.year(moment),
        F.month(moment),
        F.dayofmonth(moment),
        F.hour(moment),
        F.minute(moment),
        F.second(moment).cast("decimal(16,6)"),
    )


def shape_events(events: DataFrame) -> DataFrame:
    """Records from events, batch or stream. One in fifty is still running."""
    number = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    seconds = F.floor(F.col("value") * 60).cast("long")
    return events.select(
        F.col("event_id").alias("record_id"),
        "user_id",
        F.col("event_type").alias("task_name"),
        F.when(number % 4 != 0, F.concat(F.lit("Sub"), (number % 4).cast("string"))).alias("subtask"),
        F.when(
            F.col("user_id") % 7 != 0,
            F.concat(F.lit("tag"), (F.col("user_id") % 5).cast("string")),
        ).alias("tag"),
        F.col("ts").cast("date").alias("date"),
        _whole_second(F.col("ts")).alias("begin_ts"),
        F.when(F.col("event_id") % 50 != 0, seconds).alias("elapsed_s"),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(table(spark, sf_dir, "events"))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("record_id"),
        (F.col("doc_id") % 50).alias("user_id"),
        F.col("source").alias("task_name"),
        F.col("lang").alias("subtask"),
        F.lit(None).cast("string").alias("tag"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("doc_id") % 366).cast("int")).alias("date"),
        F.col("n_chars").alias("elapsed_s"),
        F.col("text").alias("log"),
    )


def guid_sql(*parts: str) -> str:
    said = "coalesce(length(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
    text = ", ".join(said.format(part) for part in parts)
    return f"upper(substr(md5(concat_ws('|', {text})), 1, 26))"

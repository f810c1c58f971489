"""The packet model: the row that every operator works on, and views of plain tables as packets, sample runs and edit lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A packet row. pts and duration are in ticks of 1/timescale second; frame_no counts per track from 0.
PACKET = "track_id long, media string, frame_no long, pts long, timescale int, duration long, key boolean, size long, data binary"
#: A run of samples: count samples of equal duration.
RUN = "track_id long, run int, count int, duration long"
#: An edit: a stretch of movie time showing media from media_time (-1: a gap).
EDIT = "track_id long, ord int, duration long, media_time long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_packets(events: DataFrame) -> DataFrame:
    """Events as packets: one track a user, microsecond ticks, purchases as key frames."""
    pts = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return events.select(
        "event_id",
        F.col("user_id").alias("track_id"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), "VIDEO").otherwise("AUDIO").alias("media"),
        F.expr("row_number() over (partition by user_id order by ts, event_id) - 1").cast("long").alias("frame_no"),
        pts.alias("pts"),
        F.lit(1_000_000).alias("timescale"),
        (F.col("event_type") == "purchase").alias("key"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("size"),
        "event_type",
    )


PK_SQL = """pk as (select event_id, user_id as track_id, case when event_type in ('view','click','purchase') then 'VIDEO' else 'AUDIO' end as media,
 row_number() over (partition by user_id order by ts, event_id) - 1 as frame_no, epoch_us(ts) as pts, 1000000 as timescale, event_type = 'purchase' as key,
 cast(floor(value * 100 + 0.5) as bigint) as size, event_type from events)"""


def order_edits(orders: DataFrame) -> DataFrame:
    """Orders as edit lists: one track a customer."""
    return orders.selectExpr(
        "o_custkey as track_id", "cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as int) as ord",
        "1 + o_orderkey % 1000 as duration", "case when o_orderstatus = 'P' then -1 else o_orderkey % 5000 end as media_time",
    )


ED_SQL = """ed as (select o_custkey as track_id, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as int) as ord,
 1 + o_orderkey % 1000 as duration, case when o_orderstatus = 'P' then -1 else o_orderkey % 5000 end as media_time from orders)"""


def line_runs(lineitem: DataFrame) -> DataFrame:
    """Line items as sample runs: one track an order, runs of l_linenumber samples that last l_quantity ticks."""
    rows = lineitem.withColumn("track_id", F.col("l_orderkey"))  # named before the window, so that its partitions are known to be the track's
    return rows.selectExpr(
        "track_id", "cast(row_number() over (partition by track_id order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as int) as run",
        "l_linenumber as count", "cast(l_quantity as bigint) as duration",
    )


LR_SQL = """lr as (select l_orderkey as track_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as int) as run,
 l_linenumber as count, cast(l_quantity as bigint) as duration from lineitem)"""

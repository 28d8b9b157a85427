"""Telemetry frames over the test tables: many short streams, long streams, one stream, two modalities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.operators.order import with_seq

#: Channels of the long streams, in contract order.
CHANNELS = ["FIT101", "LIT101", "AIT201", "PIT501", "MV101"]

#: The same frames as DuckDB SQL, for the oracles.
SQL = {
    "ev": """select stream_id, row_number() over (partition by stream_id order by ts, event_id) - 1 seq, ts, event_id, value,
        cast(regexp_extract(props, '([0-9]+)', 1) as double) k, case when event_type = 'error' then 1 else 0 end label, event_type
        from (select user_id stream_id, * from events) z""",
    "li": """select stream_id, row_number() over (partition by stream_id order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 seq,
        l_shipdate ts, l_quantity FIT101, l_extendedprice LIT101, l_discount AIT201, l_tax PIT501, cast(l_linenumber as double) MV101,
        case when l_returnflag = 'R' then 1 else 0 end label from (select l_suppkey stream_id, * from lineitem) z""",
    "one": """select 0 stream_id, row_number() over (order by ts, event_id) - 1 seq, ts, event_id, value, value - value % 25 k, case when event_type = 'error' then 1 else 0 end label from events""",
    "evb": """select date_trunc('hour', ts) ts, count(*) n, sum(value) v, count(distinct user_id) u,
        sum(case when event_type = 'click' then value else 0 end) c, sum(case when event_type = 'error' then 1 else 0 end) e from events group by 1""",
    "day": """select l.ts, l.n ln, l.q lq, o.n o_n, o.p op
        from (select date_trunc('day', l_shipdate) ts, count(*) n, sum(l_quantity) q from lineitem group by 1) l
        join (select date_trunc('day', o_orderdate) ts, count(*) n, sum(o_totalprice) p from orders group by 1) o on l.ts = o.ts""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), "ts", "event_id", "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"),
        (F.col("event_type") == "error").cast("int").alias("label"), "event_type",
    )
    return with_seq(rows, order=["ts", "event_id"])


def one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one long stream; k is a channel with runs of equal values."""
    from plantlens.operators.long_streams import with_seq as positions

    rows = table(spark, sf_dir, "events").select(F.lit(0).alias("stream_id"), "ts", "event_id", "value", (F.col("value") - F.col("value") % 25).alias("k"), (F.col("event_type") == "error").cast("int").alias("label"))
    return positions(rows, ["ts", "event_id"], mode="bucketed").select("stream_id", "seq", "ts", "event_id", "value", "k", "label")


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    ties = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stream_id"), F.col("l_shipdate").alias("ts"), *ties, "l_quantity", "l_discount", "l_tax", "l_returnflag")
    rows = with_seq(rows, order=["ts", *ties])
    return rows.select(
        "stream_id", "seq", "ts", F.col("l_quantity").alias("FIT101"), F.col("l_extendedprice").alias("LIT101"), F.col("l_discount").alias("AIT201"),
        F.col("l_tax").alias("PIT501"), F.col("l_linenumber").cast("double").alias("MV101"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def evb(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(
        F.count("*").alias("n"), F.sum("value").alias("v"), F.countDistinct("user_id").alias("u"),
        F.sum(F.when(kind == "click", F.col("value")).otherwise(0)).alias("c"), F.sum((kind == "error").cast("int")).alias("e"),
    )


def day(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plantlens.operators.fusion import align_modalities

    ship = table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("day", "l_shipdate").alias("ts")).agg(F.count("*").alias("ln"), F.sum("l_quantity").alias("lq"))
    order = table(spark, sf_dir, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("ts")).agg(F.count("*").alias("o_n"), F.sum("o_totalprice").alias("op"))
    return align_modalities(ship, order, unit="day")

"""Queries that run a stream to its end and are compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import incremental
from .registry import query


@query("""with w as (select event_type, round(value * 100)::bigint as cents, date_trunc('minute', ts) - unnest(range(5)) * interval 1 minute as start from events)
    select epoch(start)::bigint as start, event_type, count(*) as n, sum(cents)::bigint as cents from w group by 1, 2""")
def st01_rolling_metrics(spark, sf_dir):
    windows = incremental.rolling(incremental.event_stream(spark, sf_dir), "event_type", "value")
    rows = incremental.latest_of(windows, ["window", "event_type"])
    return rows.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "cents")


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id")
def st02_latest_upserts(spark, sf_dir):
    return incremental.upserted(incremental.event_stream(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")

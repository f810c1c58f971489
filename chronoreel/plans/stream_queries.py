"""Named streaming queries: Structured Streaming over the events file, run to its end, with the SQL of the same batch result."""

from __future__ import annotations

from ..streaming import packets as P

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("stream_tumbling", "select (epoch_us(ts) // 1000000 // 600) * 600 as window_start, event_type, count(*) as events, sum(cast(floor(value * 100 + 0.5) as bigint))::bigint as bytes from events group by 1, 2")
def stream_tumbling(spark, d):
    return P.run_available(P.tumbling(P.read_events(spark, d), "10 minutes", "5 minutes"), "complete")


@query("stream_gop_state", "select user_id as track_id, event_id, sum((event_type = 'purchase')::bigint) over (partition by user_id order by event_id)::bigint as gop from events")
def stream_gop_state(spark, d):
    return P.run_available(P.gop_state(P.read_events(spark, d)))


@query("stream_reorder", "select user_id as track_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as out_no from events")
def stream_reorder(spark, d):
    return P.reorder_all(P.read_events(spark, d))

"""Event queries: what the streaming flows give, over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows
from ..streaming import flows
from .registry import query
from .roles import table


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def events_tumbling(spark, sf):
    return flows.windowed(table(spark, sf, "events"), "1 hour")


@query("""select s as start, event_type, count(*) n, round(sum(value), 4) total from (select unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour]) s, event_type, value from events) group by 1, 2""")
def events_sliding(spark, sf):
    return flows.windowed(table(spark, sf, "events"), "2 hours", "1 hour")


@query("""with m as (select user_id, ts, sum(case when ts - prev < interval 30 minute then 0 else 1 end) over (partition by user_id order by ts) s
  from (select user_id, ts, lag(ts) over (partition by user_id order by ts) prev from events))
  select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) n from m group by user_id, s""")
def events_session(spark, sf):
    return flows.sessions(table(spark, sf, "events"))


@query("""select user_id, event_id, case when p is null or epoch_ms(ts) - epoch_ms(t) > 604800000 then 'new' when p = event_type then 'duplicate' else 'changed' end verdict
  from (select *, lag(event_type) over w p, lag(ts) over w t from events window w as (partition by user_id order by ts, event_id))""")
def event_verdicts(spark, sf):
    return flows.verdicts_of_batch(table(spark, sf, "events"))


@query("""select user_id, round(sum(power(0.7, n - 1) * 0.3 * least(value, 5)), 6) priority from
  (select user_id, value, row_number() over (partition by user_id order by event_id desc) n from events) group by 1""")
def ewma_priority(spark, sf):
    return windows.decayed(table(spark, sf, "events"), "user_id", "event_id", "value")


@query("""select conv_id, count(*) filter (where turn <> n) gaps, min_by(role, turn) = 'user' starts_well, max_by(role, turn) = 'assistant' ends_well
  from (select *, row_number() over (partition by conv_id order by turn) - 1 n from conversations) group by 1""")
def sequence_validator(spark, sf):
    return windows.sequence_faults(table(spark, sf, "conversations"), "conv_id", "turn", "turn", "role", "user", "assistant")


@query("""select cast(ts as date) as day, event_type, count(*) n from events where ts >= timestamp '2024-01-20' - interval 7 day and ts < timestamp '2024-01-20' group by 1, 2""")
def event_digest(spark, sf):
    now = F.lit("2024-01-20").cast("timestamp")
    recent = table(spark, sf, "events").where((F.col("ts") >= now - F.expr("interval 7 day")) & (F.col("ts") < now))
    return recent.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))

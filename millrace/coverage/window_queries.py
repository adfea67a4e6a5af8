"""Time windows and analytic windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collect, extremes, windows
from ..operators.groups import Heat
from ..operators.sessions import sessions
from .registry import query, sql_query, table

_STAMP = "yyyy-MM-dd HH:mm:ss"

sql_query(
    "tumble_count",
    "events",
    f"""SELECT event_type, date_format(window(ts, '1 hour').start, '{_STAMP}') AS window_start, count(*) AS events,
              CAST(sum(CAST(value AS DECIMAL(8,2))) AS DOUBLE) AS total
       FROM events GROUP BY event_type, window(ts, '1 hour')""",
    """SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
              count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM events GROUP BY event_type, time_bucket(INTERVAL 1 HOUR, ts)""",
)

sql_query(
    "hop_count",
    "events",
    f"""SELECT event_type, date_format(window(ts, '3 hours', '1 hour').start, '{_STAMP}') AS window_start,
              count(*) AS events
       FROM events GROUP BY event_type, window(ts, '3 hours', '1 hour')""",
    """SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(k AS INTEGER)),
                                   '%Y-%m-%d %H:%M:%S') AS window_start,
              count(*) AS events
       FROM events, (VALUES (0), (1), (2)) AS shifts(k)
       GROUP BY event_type, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(k AS INTEGER))""",
)


@query(
    "session_agg",
    """WITH flagged AS (
         SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR
                   THEN 0 ELSE 1 END AS starts
         FROM events),
       numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM flagged)
       SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS session_end,
              count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM numbered GROUP BY user_id, session""",
)
def session_agg(spark, folder):
    events = table(spark, folder, "events")
    found = sessions(
        events,
        ["user_id"],
        "ts",
        6 * 3600,
        {"events": F.count(F.lit(1)), "total": F.sum(F.col("value").cast("decimal(8,2)"))},
    )
    return found.select(
        "user_id",
        F.unix_micros(F.col("session_start").cast("timestamp")).alias("session_start"),
        F.unix_micros(F.col("session_end").cast("timestamp")).alias("session_end"),
        "events",
        F.col("total").cast("double").alias("total"),
    )


@query(
    "win_rank",
    """SELECT event_type, event_id,
              row_number() OVER fine AS row_number, rank() OVER coarse AS rank,
              dense_rank() OVER coarse AS dense_rank, ntile(7) OVER fine AS ntile
       FROM events
       WINDOW fine AS (PARTITION BY event_type ORDER BY value DESC, event_id),
              coarse AS (PARTITION BY event_type ORDER BY value DESC)""",
)
def win_rank(spark, folder):
    events = table(spark, folder, "events").select("event_type", "event_id", "value")
    return windows.ranked(events, ["event_type"], ["-value"], ["event_id"], 7).drop("value")


@query(
    "win_lag_lead",
    """SELECT user_id, event_id,
              coalesce(lag(event_id) OVER w, -1) AS previous, coalesce(lead(value, 2) OVER w, -1.0) AS second_next,
              first_value(event_id) OVER w AS first_event,
              last_value(event_type) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_type
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def win_lag_lead(spark, folder):
    events = table(spark, folder, "events").drop("props")
    order = ["ts", "event_id"]
    near = windows.neighbourhood(
        events,
        ["user_id"],
        order,
        before=1,
        after=2,
        build=lambda w: {
            "previous": F.coalesce(F.lag("event_id").over(w), F.lit(-1)),
            "second_next": F.coalesce(F.lead("value", 2).over(w), F.lit(-1.0)),
        },
    )
    whole = windows.edges(near, ["user_id"], {"first_event": "event_id"}, {"last_type": "event_type"}, order)
    return whole.select("user_id", "event_id", "previous", "second_next", "first_event", "last_type")


@query(
    "win_running_sum",
    """SELECT event_type, event_id,
              CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running,
              count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS seen,
              CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE)
                AS last_three
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
)
def win_running_sum(spark, folder):
    amount = F.col("value").cast("decimal(8,2)")
    events = table(spark, folder, "events").select("event_type", "event_id", "ts", amount.alias("amount"))
    keys, order = ["event_type"], ["ts", "event_id"]
    heat = Heat.found(events, keys)
    totals = windows.running(
        events, keys, order, {"running": F.col("amount"), "seen": F.lit(1).cast("bigint")}, heat
    )
    moving = windows.neighbourhood(
        totals,
        keys,
        order,
        before=2,
        after=0,
        build=lambda w: {"last_three": F.sum("amount").over(w.rowsBetween(-2, 0))},
        heat=heat,
    )
    return moving.select(
        "event_type",
        "event_id",
        F.col("running").cast("double").alias("running"),
        "seen",
        F.col("last_three").cast("double").alias("last_three"),
    )


@query(
    "win_range_frame",
    """SELECT user_id, event_id,
              count(*) OVER w AS events_7d, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS value_7d
       FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)""",
)
def win_range_frame(spark, folder):
    events = table(spark, folder, "events").select(
        "user_id",
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("value").cast("decimal(8,2)").alias("amount"),
    )
    framed = windows.range_frame(
        events,
        ["user_id"],
        "at",
        7 * 86_400 * 1_000_000,
        {"events_7d": F.lit(1).cast("bigint"), "value_7d": F.col("amount")},
    )
    return framed.select("user_id", "event_id", "events_7d", F.col("value_7d").cast("double").alias("value_7d"))


@query(
    "win_range_frame_nulls",
    """WITH marked AS (
         SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS k,
                CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) END AS moment,
                CASE WHEN event_id % 3 = 0 THEN CAST(value AS DECIMAL(18,2)) END AS amount FROM events),
       timed AS (
         SELECT *, CAST(sum(amount) OVER w AS DOUBLE) AS day, count(amount) OVER w AS seen FROM marked WHERE moment IS NOT NULL
         WINDOW w AS (PARTITION BY k ORDER BY moment RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)),
       untimed AS (
         SELECT *, CAST(sum(amount) OVER w AS DOUBLE) AS day, count(amount) OVER w AS seen FROM marked WHERE moment IS NULL
         WINDOW w AS (PARTITION BY k))
       SELECT event_id, day, seen
       FROM (SELECT * FROM timed UNION ALL SELECT * FROM untimed)""",
)
def win_range_frame_nulls(spark, folder):
    """Keys, times and values that are NULL: a frame without a value sums to NULL."""
    amount = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("decimal(8,2)"))
    marked = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("k"),
        F.when(F.col("event_id") % 5 != 0, F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"),
        amount.alias("amount"),
    )
    seen = F.when(F.col("amount").isNotNull(), F.lit(1)).cast("bigint")
    framed = windows.range_frame(marked, ["k"], "at", 86_400_000_000, {"day": F.col("amount"), "seen": seen})
    return framed.select("event_id", F.col("day").cast("double").alias("day"), F.coalesce("seen", F.lit(0)).alias("seen"))


@query(
    "win_first_last_desc",
    """SELECT user_id, event_id, first_value(event_id) OVER w AS first_event, last_value(event_type) OVER w AS last_type
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def win_first_last_desc(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    whole = windows.edges(
        events, ["user_id"], {"first_event": "event_id"}, {"last_type": "event_type"}, ["-value", "event_id"]
    )
    return whole.select("user_id", "event_id", "first_event", "last_type")


_FRAMES = (3_600_000_000, 100)


@query(
    "win_moving_extremes",
    f"""WITH marked AS (
         SELECT event_id, event_type, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) END AS moment,
                CASE WHEN event_id % 3 = 0 THEN value END AS amount FROM events),
       counted AS (
         SELECT event_id, min(amount) OVER w AS low_100, max(amount) OVER w AS high_100 FROM marked
         WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN {_FRAMES[1]} PRECEDING AND CURRENT ROW)),
       timed AS (
         SELECT event_id, min(amount) OVER w AS low_1h, max(amount) OVER w AS high_1h FROM marked WHERE moment IS NOT NULL
         WINDOW w AS (PARTITION BY event_type ORDER BY moment RANGE BETWEEN {_FRAMES[0]} PRECEDING AND CURRENT ROW)),
       untimed AS (
         SELECT event_id, min(amount) OVER w AS low_1h, max(amount) OVER w AS high_1h FROM marked WHERE moment IS NULL
         WINDOW w AS (PARTITION BY event_type))
       SELECT event_id, low_1h, high_1h, low_100, high_100
       FROM (SELECT * FROM timed UNION ALL SELECT * FROM untimed) JOIN counted USING (event_id)""",
)
def win_moving_extremes(spark, folder):
    """Least and greatest value of the last hour and of the last rows: five keys share all rows; times and values may be NULL."""
    marked = table(spark, folder, "events").select(
        "event_id",
        "event_type",
        F.when(F.col("event_id") % 5 != 0, F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"),
        F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("amount"),
    )
    both = lambda over: {f"low_{over}": ("min", F.col("amount")), f"high_{over}": ("max", F.col("amount"))}
    hour = extremes.range_extremes(marked, ["event_type"], "at", _FRAMES[0], both("1h"))
    rows = extremes.rows_extremes(hour, ["event_type"], ["event_id"], _FRAMES[1], both("100"))
    return rows.select("event_id", "low_1h", "high_1h", "low_100", "high_100")


@query(
    "agg_collect_segments",
    """WITH placed AS (
         SELECT event_type, event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS member,
                (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 500 AS segment,
                row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place
         FROM events)
       SELECT event_type, segment, count(*) AS members, string_agg(member::VARCHAR, ',' ORDER BY place) AS text
       FROM placed GROUP BY event_type, segment""",
)
def agg_collect_segments(spark, folder):
    """The users of every type in the order of their events: five lists that hold all rows, in pieces of 500."""
    events = table(spark, folder, "events").select(
        "event_type", "ts", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("member")
    )
    listed = collect.joined(collect.segments(events, ["event_type"], ["ts", "event_id"], "member", 500))
    return listed.select("event_type", "segment", F.size("values").cast("bigint").alias("members"), "text")

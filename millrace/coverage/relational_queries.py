"""Relational operators a job's SQL reaches: one case each, most as the SQL a user writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distincts, joins
from ..operators.windows import newest_per_key
from ..session import materialize
from .registry import query, sql_query, table

# Sums run over DECIMAL so that the result does not depend on the order of addition; small
# amounts as DECIMAL(8,2), whose sums still fit a long and stay fast.

sql_query(
    "project_computed",
    "lineitem",
    """SELECT l_orderkey, l_linenumber,
              CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS net,
              l_quantity * 2 AS twice,
              CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS outcome
       FROM lineitem""",
)

sql_query(
    "filter_compound",
    "events",
    """SELECT event_id, event_type, value FROM events
       WHERE (value BETWEEN 20 AND 60 OR event_type IN ('purchase', 'signup'))
         AND NOT event_type LIKE 'err%' AND props IS NOT NULL""",
)

# Outer joins meet a side with many rows of a key as one row per key: the engine cannot split
# that side when the key is hot, an aggregate folds it first.
sql_query(
    "join_left",
    "orders customer",
    """SELECT c_custkey, c_mktsegment, coalesce(urgent, 0) AS urgent
       FROM customer LEFT JOIN (
         SELECT o_custkey, count(*) AS urgent FROM orders
         WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' GROUP BY o_custkey) o
       ON o_custkey = c_custkey""",
)

sql_query(
    "join_right",
    "customer nation",
    """SELECT n_name, coalesce(rich, 0) AS rich
       FROM (SELECT c_nationkey, count(*) AS rich FROM customer WHERE c_acctbal > 9900 GROUP BY c_nationkey) c
         RIGHT JOIN nation ON c_nationkey = n_nationkey""",
)

sql_query(
    "join_full",
    "orders customer",
    """SELECT coalesce(c_custkey, o_custkey) AS custkey, c_custkey IS NULL AS no_customer,
              o_custkey IS NULL AS no_orders, coalesce(orders, 0) AS orders
       FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c
       FULL JOIN (SELECT o_custkey, count(*) AS orders FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey) o
         ON o_custkey = c_custkey""",
)

sql_query(
    "join_semi",
    "orders customer",
    """SELECT c_custkey, c_name FROM customer
       WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""",
)

sql_query(
    "join_anti",
    "orders customer",
    """SELECT c_custkey, c_name FROM customer
       WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""",
)

sql_query(
    "join_multi_way",
    "lineitem orders customer nation region",
    """SELECT r_name, n_name, count(*) AS items,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)
                AS revenue
       FROM lineitem
         JOIN orders ON l_orderkey = o_orderkey
         JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey
       WHERE l_returnflag = 'R'
       GROUP BY r_name, n_name""",
)

sql_query(
    "enrich_orders",
    "orders customer nation",
    """SELECT o_orderkey, o_totalprice, c_mktsegment, n_name
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       WHERE o_orderstatus = 'O'""",
)

_TIERS = 20


@query(
    "join_range",
    f"""WITH scale AS (SELECT max(value) / {_TIERS} AS step FROM events),
        tiers AS (SELECT k, k * step AS low, (k + 1) * step AS high
                  FROM scale, (SELECT unnest(range({_TIERS})) AS k) t)
        SELECT CAST(k AS BIGINT) AS tier, event_type, count(*) AS events
        FROM events JOIN tiers ON value >= low AND value < high
        GROUP BY k, event_type""",
)
def join_range(spark, folder):
    """Events against value tiers scaled to their own maximum: a theta join by bins."""
    events = table(spark, folder, "events").select("event_type", "value")
    step = events.agg((F.max("value") / _TIERS).alias("step"))
    tiers = step.select("step", F.explode(F.sequence(F.lit(0), F.lit(_TIERS - 1))).alias("tier")).select(
        F.col("tier").cast("bigint"),
        (F.col("tier") * F.col("step")).alias("low"),
        ((F.col("tier") + 1) * F.col("step")).alias("high"),
    )
    joined = joins.range_join(events, tiers, "value", "low", "high")
    return joined.groupBy("tier", "event_type").agg(F.count(F.lit(1)).alias("events"))


@query(
    "join_overlap",
    """SELECT s_suppkey, c_custkey
       FROM (SELECT s_suppkey, s_acctbal AS low, CASE WHEN s_suppkey % 50 = 0 THEN CAST('infinity' AS DOUBLE) ELSE s_acctbal + s_suppkey % 7 END AS high
             FROM supplier) s
       JOIN (SELECT c_custkey, CASE WHEN c_custkey % 500 = 0 THEN CAST('-infinity' AS DOUBLE) ELSE c_acctbal END AS low,
                    c_acctbal + c_custkey % 3 AS high FROM customer) c
         ON s.low < c.high AND c.low < s.high AND s.low < s.high AND c.low < c.high""",
)
def join_overlap(spark, folder):
    """Balances as ranges of many lengths, some of them empty or without end."""
    balance, key = F.col("s_acctbal").cast("double"), F.col("s_suppkey")
    suppliers = table(spark, folder, "supplier").select(
        "s_suppkey", balance.alias("s_low"), F.when(key % 50 == 0, float("inf")).otherwise(balance + key % 7).alias("s_high")
    )
    balance, key = F.col("c_acctbal").cast("double"), F.col("c_custkey")
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.when(key % 500 == 0, float("-inf")).otherwise(balance).alias("c_low"), (balance + key % 3).alias("c_high")
    )
    return joins.overlap_join(suppliers, customers, "s_low", "s_high", "c_low", "c_high").select("s_suppkey", "c_custkey")


def _of_type(spark, folder, kind, prefix):
    events = table(spark, folder, "events").where(F.col("event_type") == kind)
    return events.select(
        "user_id", F.col("event_id").alias(f"{prefix}_id"), F.col("ts").alias(f"{prefix}_ts"), "value"
    ).withColumnRenamed("value", f"{prefix}_value")


@query(
    "join_interval",
    """SELECT c.user_id, c.event_id AS click_id, p.event_id AS purchase_id
       FROM events c JOIN events p ON c.user_id = p.user_id
         AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR
       WHERE c.event_type = 'click' AND p.event_type = 'purchase'""",
)
def join_interval(spark, folder):
    pairs = joins.interval_join(
        _of_type(spark, folder, "click", "click"),
        _of_type(spark, folder, "purchase", "purchase"),
        ["user_id"],
        "click_ts",
        "purchase_ts",
        3600,
    )
    return pairs.select("user_id", "click_id", "purchase_id")


@query(
    "join_asof",
    """SELECT p.event_id AS purchase_id, p.user_id, coalesce(c.event_id, -1) AS click_id,
              coalesce(c.value, -1.0) AS click_value
       FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
         ON p.user_id = c.user_id AND p.ts >= c.ts""",
)
def join_asof(spark, folder):
    found = joins.asof_join(
        _of_type(spark, folder, "purchase", "purchase"),
        _of_type(spark, folder, "click", "click"),
        ["user_id"],
        "purchase_ts",
        "click_ts",
        ["click_id", "click_value"],
    )
    return found.select(
        "purchase_id",
        "user_id",
        F.coalesce("click_id", F.lit(-1)).alias("click_id"),
        F.coalesce("click_value", F.lit(-1.0)).alias("click_value"),
    )


@query(
    "join_asof_nulls",
    """WITH marked AS (
         SELECT *, CASE WHEN event_id % 7 <> 0 THEN user_id END AS k, CASE WHEN event_id % 5 <> 0 THEN ts END AS at FROM events),
       latest AS (
         SELECT p.event_id AS purchase_id, max(c.at) AS at FROM marked p JOIN marked c
           ON p.event_type = 'purchase' AND c.event_type = 'click' AND p.k = c.k AND c.at <= p.at
         GROUP BY p.event_id)
       SELECT p.event_id AS purchase_id, coalesce(p.k, -1) AS k, coalesce(max(c.event_id), -1) AS click_id
       FROM marked p LEFT JOIN latest l ON l.purchase_id = p.event_id
         LEFT JOIN marked c ON c.event_type = 'click' AND c.k = p.k AND c.at = l.at
       WHERE p.event_type = 'purchase' GROUP BY p.event_id, p.k""",
)
def join_asof_nulls(spark, folder):
    """Keys and times that are NULL on either side match nothing; ties go to the larger id."""
    marked = table(spark, folder, "events").select(
        "event_id",
        "event_type",
        F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("k"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("at"),
    )
    purchases = marked.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "k", "at")
    clicks = marked.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "k", F.col("at").alias("click_at"))
    found = joins.asof_join(purchases, clicks, ["k"], "at", "click_at", ["click_id"])
    return found.select("purchase_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("k", "click_id")])


sql_query(
    "agg_basic",
    "lineitem",
    """SELECT l_returnflag, l_linestatus, count(*) AS items,
              CAST(sum(CAST(l_quantity AS DECIMAL(8,2))) AS DOUBLE) AS sum_qty,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
              round(avg(l_discount), 6) AS avg_discount, min(l_extendedprice) AS min_price,
              max(l_extendedprice) AS max_price, round(stddev(l_quantity), 6) AS sd_qty
       FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'
       GROUP BY l_returnflag, l_linestatus""",
    """SELECT l_returnflag, l_linestatus, count(*) AS items,
              CAST(sum(CAST(l_quantity AS DECIMAL(8,2))) AS DOUBLE) AS sum_qty,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
              round(avg(l_discount), 6) AS avg_discount, min(l_extendedprice) AS min_price,
              max(l_extendedprice) AS max_price, round(stddev(l_quantity), 6) AS sd_qty
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
       GROUP BY l_returnflag, l_linestatus""",
)

sql_query(
    "agg_distinct",
    "lineitem",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers
       FROM lineitem GROUP BY l_returnflag""",
)

@query(
    "distinct_by_span",
    """WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS last_day FROM events),
       spans AS (SELECT strftime(last_day, '%Y-%m-%d') AS span, last_day - 6 AS first_day, last_day FROM days
                 UNION ALL SELECT 'all', min(last_day), max(last_day) FROM days)
       SELECT event_type, span, count(DISTINCT user_id) AS users, true AS near
       FROM events JOIN spans ON CAST(ts AS DATE) BETWEEN first_day AND last_day GROUP BY event_type, span""",
)
def distinct_by_span(spark, folder):
    """Users of the seven days up to each day, and of all days: merged from sketches per day, and exactly."""
    events = table(spark, folder, "events")
    sketches = materialize(distincts.day_sketches(events, ["event_type"], "ts", "user_id"), "day-sketches")
    days = sketches.select("day").distinct()
    spans = days.select(F.col("day").cast("string").alias("span"), F.date_sub("day", 6).alias("first_day"), F.col("day").alias("last_day"))
    spans = spans.unionByName(days.agg(F.lit("all").alias("span"), F.min("day").alias("first_day"), F.max("day").alias("last_day")))
    counted = distincts.exact(events, ["event_type"], "ts", "user_id", spans)
    found = distincts.estimated(sketches, ["event_type"], spans)
    near = distincts.within(F.coalesce("estimate", F.lit(0)), F.col("exact"))
    return counted.join(found, ["event_type", "span"], "left").select("event_type", "span", F.col("exact").alias("users"), near.alias("near"))


sql_query(
    "select_distinct",
    "customer",
    "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer",
)

sql_query(
    "agg_filter_having",
    "orders",
    """SELECT o_custkey, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM orders GROUP BY o_custkey HAVING count(*) > 12""",
)

_MEASURES = """count(*) AS items, CAST(sum(CAST(l_quantity AS DECIMAL(8,2))) AS DOUBLE) AS qty,
              CAST(grouping(l_returnflag) AS INT) AS g_flag, CAST(grouping(l_linestatus) AS INT) AS g_status"""

for _name, _grouping in (
    ("agg_rollup", "ROLLUP (l_returnflag, l_linestatus)"),
    ("agg_cube", "CUBE (l_returnflag, l_linestatus)"),
    ("agg_grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
):
    sql_query(
        _name,
        "lineitem",
        f"SELECT l_returnflag, l_linestatus, {_MEASURES} FROM lineitem GROUP BY {_grouping}",
    )

# The collected lists hold distinct values of small domains, counted before they meet:
# their length does not grow with the data.
sql_query(
    "agg_collect",
    "orders customer",
    """SELECT c_nationkey,
              array_join(array_sort(collect_list(concat(o_orderstatus, ':', n))), ',') AS statuses,
              listagg(o_orderstatus, '') WITHIN GROUP (ORDER BY o_orderstatus DESC) AS backwards
       FROM (SELECT c_nationkey, o_orderstatus, count(*) AS n
             FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderstatus)
       GROUP BY c_nationkey""",
    """SELECT c_nationkey,
              string_agg(o_orderstatus || ':' || n, ',' ORDER BY o_orderstatus || ':' || n) AS statuses,
              string_agg(o_orderstatus, '' ORDER BY o_orderstatus DESC) AS backwards
       FROM (SELECT c_nationkey, o_orderstatus, count(*) AS n
             FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderstatus)
       GROUP BY c_nationkey""",
)

sql_query(
    "sort_limit",
    "orders",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)

# A filter on row_number() <= n becomes a per-task top n before the shuffle.
sql_query(
    "topn_per_group",
    "orders",
    """SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(rn AS BIGINT) AS place
       FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn
             FROM orders)
       WHERE rn <= 5""",
)

sql_query(
    "union_all",
    "customer supplier",
    """SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier""",
)

sql_query(
    "union_distinct",
    "customer supplier",
    "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
)

# DISTINCT first: rows fold map-side, so the comparison meets each value once.
sql_query(
    "set_intersect",
    "orders",
    """SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
       INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'""",
)

sql_query(
    "set_except",
    "orders customer",
    """SELECT DISTINCT c_custkey AS k FROM customer
       EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'""",
)

sql_query(
    "set_intersect_all",
    "orders",
    """SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
       INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""",
)

sql_query(
    "set_except_all",
    "lineitem orders",
    "SELECT l_orderkey AS k FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders",
)

sql_query(
    "subquery_correlated",
    "orders",
    """SELECT o_orderkey, o_custkey FROM orders o
       WHERE o_totalprice > 1.5 * (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""",
)

sql_query(
    "subquery_scalar",
    "events",
    """SELECT event_type, count(*) AS above FROM events
       WHERE value > (SELECT max(value) / 4 FROM events) GROUP BY event_type""",
)

sql_query(
    "cte_chain",
    "orders customer",
    """WITH spend AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
                      FROM orders GROUP BY o_custkey),
            rich AS (SELECT * FROM spend WHERE total > 1500000)
       SELECT c_mktsegment, count(*) AS customers, max(total) AS top
       FROM rich JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
)

sql_query(
    "explode_tokens",
    "documents",
    """SELECT lang, token, count(*) AS uses
       FROM documents LATERAL VIEW explode(split(lower(text), ' ')) t AS token
       WHERE token <> '' GROUP BY lang, token""",
    """SELECT lang, token, count(*) AS uses
       FROM (SELECT lang, unnest(string_split(lower(text), ' ')) AS token FROM documents)
       WHERE token <> '' GROUP BY lang, token""",
)

sql_query(
    "posexplode_turns",
    "conversations",
    """SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, word
       FROM conversations LATERAL VIEW posexplode(split(text, ' ')) t AS pos, word
       WHERE length(word) > 5""",
    """SELECT * FROM (
         SELECT conv_id, turn, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS pos, unnest(w) AS word
         FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))
       WHERE length(word) > 5""",
)


@query(
    "dedup_keep_last",
    """SELECT user_id, event_type, event_id, value
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
             FROM events) WHERE rn = 1""",
)
def dedup_keep_last(spark, folder):
    events = table(spark, folder, "events")
    wanted = ["user_id", "event_type", "event_id", "value"]
    return newest_per_key(events, ["user_id", "event_type"], ["ts", "event_id"], columns=wanted)


@query(
    "dedup_keep_first",
    """SELECT user_id, event_type, event_id, value
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
             FROM events) WHERE rn = 1""",
)
def dedup_keep_first(spark, folder):
    events = table(spark, folder, "events")
    wanted = ["user_id", "event_type", "event_id", "value"]
    return newest_per_key(events, ["user_id", "event_type"], ["ts", "event_id"], keep="first", columns=wanted)

"""Scalar functions a job's SQL reaches, by family."""

from __future__ import annotations

from .registry import sql_query

sql_query(
    "fn_conditional",
    "orders",
    """SELECT o_orderkey,
              CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
              coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status,
              nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL AS finished,
              greatest(o_totalprice, 5000.0) AS at_least, least(o_totalprice, 5000.0) AS at_most,
              if(o_custkey % 2 = 0, 'even', 'odd') AS parity
       FROM orders""",
)

sql_query(
    "fn_string",
    "part",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, trim(concat('  ', p_type, ' ')) AS trimmed,
              substring(p_name, 2, 4) AS mid, concat_ws('-', p_brand, p_type) AS joined,
              CAST(length(p_name) AS BIGINT) AS chars, replace(p_type, ' ', '_') AS replaced,
              regexp_extract(p_brand, '([0-9]+)', 1) AS digits, regexp_replace(p_name, '[aeiou]', '*') AS starred,
              split(p_type, ' ')[0] AS first_word, lpad(CAST(p_size AS STRING), 5, '0') AS padded,
              p_name LIKE '%a%' AS has_a, reverse(p_brand) AS backwards, instr(p_name, 'a') > 0 AS found,
              left(p_name, 3) AS head, right(p_name, 3) AS tail, repeat(p_brand, 2) AS doubled
       FROM part""",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, trim('  ' || p_type || ' ') AS trimmed,
              substring(p_name, 2, 4) AS mid, concat_ws('-', p_brand, p_type) AS joined,
              CAST(length(p_name) AS BIGINT) AS chars, replace(p_type, ' ', '_') AS replaced,
              regexp_extract(p_brand, '([0-9]+)', 1) AS digits, regexp_replace(p_name, '[aeiou]', '*', 'g') AS starred,
              string_split(p_type, ' ')[1] AS first_word, lpad(CAST(p_size AS VARCHAR), 5, '0') AS padded,
              p_name LIKE '%a%' AS has_a, reverse(p_brand) AS backwards, instr(p_name, 'a') > 0 AS found,
              left(p_name, 3) AS head, right(p_name, 3) AS tail, repeat(p_brand, 2) AS doubled
       FROM part""",
)

sql_query(
    "pii_mask",
    "customer",
    """SELECT c_custkey, mask(c_name) AS masked, mask(c_mktsegment, 'U', 'l', 'd', '.') AS custom,
              regexp_replace(c_name, '[0-9]{4}$', '****') AS tail_hidden, sha2(c_name, 256) AS token
       FROM customer""",
    """SELECT c_custkey,
              regexp_replace(regexp_replace(regexp_replace(c_name, '[a-z]', 'x', 'g'), '[A-Z]', 'X', 'g'),
                             '[0-9]', 'n', 'g') AS masked,
              regexp_replace(regexp_replace(c_mktsegment, '[^A-Z]', '.', 'g'), '[A-Z]', 'U', 'g') AS custom,
              regexp_replace(c_name, '[0-9]{4}$', '****') AS tail_hidden, sha256(c_name) AS token
       FROM customer""",
)

sql_query(
    "fn_math",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS down,
              CAST(ceil(l_extendedprice) AS BIGINT) AS up, abs(l_quantity - 25) AS distance,
              round(sqrt(l_extendedprice), 4) AS root, round(ln(l_extendedprice), 4) AS log_e,
              round(pow(l_quantity, 2), 2) AS squared, CAST(sign(l_quantity - 25) AS INT) AS side,
              l_orderkey % 7 AS rest, round(exp(l_discount), 6) AS grown, CAST(l_orderkey AS BIGINT) & 255 AS low_byte
       FROM lineitem""",
)

sql_query(
    "fn_datetime",
    "orders",
    """SELECT o_orderkey, date_format(date_trunc('MONTH', o_orderdate), 'yyyy-MM-dd') AS month_start,
              CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m,
              CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS d, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy,
              CAST(datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS BIGINT) AS days_since,
              date_format(date_add(CAST(o_orderdate AS DATE), 30), 'yyyy-MM-dd') AS due,
              date_format(o_orderdate + INTERVAL '1' MONTH, 'yyyy-MM-dd') AS next_month,
              unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS us,
              date_format(o_orderdate - INTERVAL '90' SECOND, 'yyyy-MM-dd HH:mm:ss') AS earlier,
              CAST(weekday(o_orderdate) + 1 AS BIGINT) AS iso_day
       FROM orders""",
    """SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
              extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m,
              extract(day FROM o_orderdate) AS d, dayofyear(o_orderdate) AS doy,
              date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days_since,
              strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS due,
              strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month,
              epoch_us(o_orderdate) AS us,
              strftime(o_orderdate - INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') AS earlier,
              isodow(o_orderdate) AS iso_day
       FROM orders""",
)

sql_query(
    "fn_cast",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS STRING) AS as_text, CAST(l_quantity AS BIGINT) AS as_long,
              CAST(l_linenumber AS DOUBLE) AS as_double, coalesce(try_cast(concat(l_linenumber, CASE WHEN l_orderkey % 100 = 0 THEN 'x' ELSE '' END) AS INT), -1)
                AS not_always,
              try_cast(CAST(l_partkey AS STRING) AS BIGINT) AS back,
              CAST(CAST(l_extendedprice AS DECIMAL(12,1)) AS DOUBLE) AS one_digit,
              CAST(l_linenumber % 2 AS BOOLEAN) AS odd, date_format(CAST(l_shipdate AS DATE), 'yyyy-MM-dd') AS ship_day
       FROM lineitem""",
    """SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS VARCHAR) AS as_text, CAST(trunc(l_quantity) AS BIGINT) AS as_long,
              CAST(l_linenumber AS DOUBLE) AS as_double, coalesce(try_cast(concat(l_linenumber, CASE WHEN l_orderkey % 100 = 0 THEN 'x' ELSE '' END) AS INT), -1)
                AS not_always,
              try_cast(CAST(l_partkey AS VARCHAR) AS BIGINT) AS back,
              CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(12,1)) AS DOUBLE) AS one_digit,
              CAST(l_linenumber % 2 AS BOOLEAN) AS odd, strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS ship_day
       FROM lineitem""",
)

sql_query(
    "fn_json",
    "events",
    """SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k,
              from_json(props, 'k BIGINT').k + 1 AS k_plus, variant_get(parse_json(props), '$.k', 'bigint') AS k_variant,
              to_json(named_struct('id', event_id, 'type', event_type)) AS packed,
              get_json_object(props, '$.missing') IS NULL AS absent,
              schema_of_variant(parse_json(props)) = 'OBJECT<k: BIGINT>' AS is_object
       FROM events""",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
              CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k_plus,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_variant,
              '{"id":' || event_id || ',"type":"' || event_type || '"}' AS packed,
              json_extract_string(props, '$.missing') IS NULL AS absent,
              json_type(props) = 'OBJECT' AS is_object
       FROM events""",
)

sql_query(
    "fn_array",
    "documents",
    """SELECT doc_id, CAST(size(words) AS BIGINT) AS n, CAST(size(array_distinct(words)) AS BIGINT) AS uniq,
              CAST(aggregate(transform(words, w -> length(w)), 0, (a, x) -> a + x) AS BIGINT) AS letters,
              CAST(size(filter(words, w -> length(w) > 5)) AS BIGINT) AS long_words,
              exists(words, w -> w = 'the') AS has_the, element_at(words, 1) AS first_word, element_at(words, -1) AS last_word,
              array_join(slice(words, 1, 3), '+') AS head, array_max(transform(words, w -> length(w))) AS longest
       FROM (SELECT doc_id, split(lower(text), ' ') AS words FROM documents)""",
    """SELECT doc_id, CAST(len(words) AS BIGINT) AS n, CAST(len(list_distinct(words)) AS BIGINT) AS uniq,
              CAST(list_sum(list_transform(words, lambda w: length(w))) AS BIGINT) AS letters,
              CAST(len(list_filter(words, lambda w: length(w) > 5)) AS BIGINT) AS long_words,
              list_contains(words, 'the') AS has_the, words[1] AS first_word, words[-1] AS last_word,
              array_to_string(words[1:3], '+') AS head,
              CAST(list_max(list_transform(words, lambda w: length(w))) AS INTEGER) AS longest
       FROM (SELECT doc_id, string_split(lower(text), ' ') AS words FROM documents)""",
)

sql_query(
    "fn_map",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, element_at(m, 'price') AS price, map_contains_key(m, 'tax') AS has_tax,
              CAST(size(map_keys(m)) AS BIGINT) AS n_keys, array_join(array_sort(map_keys(m)), ',') AS names,
              CAST(size(map_filter(m, (k, v) -> v > 1)) AS BIGINT) AS above_one,
              coalesce(try_element_at(m, 'none'), -1.0) AS absent
       FROM (SELECT l_orderkey, l_linenumber,
                    map_from_entries(array(named_struct('k', 'price', 'v', l_extendedprice),
                                           named_struct('k', 'qty', 'v', l_quantity),
                                           named_struct('k', 'disc', 'v', l_discount))) AS m
             FROM lineitem)""",
    """SELECT l_orderkey, l_linenumber, l_extendedprice AS price, false AS has_tax, CAST(3 AS BIGINT) AS n_keys,
              'disc,price,qty' AS names,
              CAST((CASE WHEN l_extendedprice > 1 THEN 1 ELSE 0 END) + (CASE WHEN l_quantity > 1 THEN 1 ELSE 0 END)
                   + (CASE WHEN l_discount > 1 THEN 1 ELSE 0 END) AS BIGINT) AS above_one,
              -1.0 AS absent
       FROM lineitem""",
)

sql_query(
    "fn_hash",
    "customer",
    """SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, sha1(c_name) AS s1, lower(hex(c_name)) AS h
       FROM customer""",
    """SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, sha1(c_name) AS s1, lower(hex(c_name)) AS h
       FROM customer""",
)

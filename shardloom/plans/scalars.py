"""String, date, number, array and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.catalog import table
from shardloom.functions.text import concat_skip_null, regexp_replace_first, trunc_number
from shardloom.operators.tables import uniform_range_shard


def register(r) -> None:
    p = "FROM part"
    big = lambda e: f"CAST({e} AS BIGINT)"
    r.sql("str_case", f"SELECT p_partkey, lower(p_type) AS l, upper(p_name) AS u, initcap(p_name) AS i {p}", f"SELECT p_partkey, lower(p_type) AS l, upper(p_name) AS u, array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN string_split(p_name, ' ')], ' ') AS i {p}")
    r.sql("str_length", f"SELECT p_partkey, {big('length(p_name)')} AS n, {big('char_length(p_name)')} AS c, {big('octet_length(p_name)')} AS o, {big('bit_length(p_name)')} AS b {p}", f"SELECT p_partkey, {big('length(p_name)')} AS n, {big('length(p_name)')} AS c, {big('strlen(p_name)')} AS o, {big('bit_length(p_name)')} AS b {p}")
    r.sql("str_substring", f"SELECT p_partkey, substring(p_name, 2, 4) AS s, left(p_name, 3) AS l, right(p_name, 3) AS r {p}")
    r.sql("str_substring_pattern", f"SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS d {p}")
    r.sql("str_position", f"SELECT p_partkey, {big("position('i' IN p_name)")} AS a, {big("instr(p_name, 'e')")} AS b {p}", f"SELECT p_partkey, {big("position('i' IN p_name)")} AS a, {big("strpos(p_name, 'e')")} AS b {p}")
    r.sql("str_concat_pipe", "SELECT id, a || '-' || b AS c FROM (VALUES (1, 'x', 'y'), (2, NULL, 'y')) t(id, a, b)")
    r.sql("str_trim", "SELECT trim(x) AS t, ltrim(x) AS l, rtrim(x) AS r, trim(BOTH 'x' FROM y) AS b FROM (VALUES ('  a b ', 'xxqxx')) t(x, y)", "SELECT trim(x) AS t, ltrim(x) AS l, rtrim(x) AS r, trim(y, 'x') AS b FROM (VALUES ('  a b ', 'xxqxx')) t(x, y)")
    r.sql("str_pad_repeat", f"SELECT p_partkey, lpad(p_name, 14, '*') AS l, rpad(p_name, 14, '.') AS r, repeat('ab', 3) AS x, reverse(p_name) AS v {p}")
    r.sql("str_replace", f"SELECT p_partkey, replace(p_name, 'e', 'EE') AS r, regexp_replace(p_name, '[aeiou]', '_') AS g, translate(p_name, 'abc', 'xyz') AS t {p}", f"SELECT p_partkey, replace(p_name, 'e', 'EE') AS r, regexp_replace(p_name, '[aeiou]', '_', 'g') AS g, translate(p_name, 'abc', 'xyz') AS t {p}")
    r.sql("str_regexp_matches", f"SELECT p_partkey, array_join(regexp_extract_all(p_name, '[aeiou]', 0), ',') AS m, array_join(split(p_name, ' '), '|') AS s {p}", f"SELECT p_partkey, array_to_string(regexp_extract_all(p_name, '[aeiou]'), ',') AS m, array_to_string(string_split(p_name, ' '), '|') AS s {p}")
    r.sql("str_split_part", f"SELECT p_partkey, split_part(p_name, ' ', 2) AS s {p}")
    r.sql("str_format", f"SELECT p_partkey, format_string('%s has %d', p_name, p_size) AS f {p}", f"SELECT p_partkey, printf('%s has %d', p_name, p_size) AS f {p}")
    r.sql("str_md5", f"SELECT p_partkey, md5(p_name) AS m {p}")
    r.sql("str_sha_hex", f"SELECT p_partkey, sha2(p_name, 256) AS s, hex(p_name) AS h, {big('ascii(p_name)')} AS a, chr(65 + p_size % 26) AS c {p}", f"SELECT p_partkey, sha256(p_name) AS s, hex(p_name) AS h, {big('ascii(p_name)')} AS a, chr(65 + p_size % 26) AS c {p}")
    r.sql("str_to_char", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd HH:mm') AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS d FROM orders")

    @r.pair("str_concat", "SELECT id, concat(a, b, id) AS c FROM (VALUES (1, 'x', 'y'), (2, NULL, 'y'), (3, NULL, NULL)) t(id, a, b)")
    def _concat(spark, sf_dir):
        t = spark.sql("SELECT * FROM (VALUES (1, 'x', 'y'), (2, NULL, 'y'), (3, NULL, NULL)) t(id, a, b)")
        return t.select("id", concat_skip_null(F.col("a"), F.col("b"), F.col("id")).alias("c"))

    @r.pair("str_replace_first", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS f FROM part")
    def _first(spark, sf_dir):
        return table(spark, sf_dir, "part").select("p_partkey", regexp_replace_first(F.col("p_name"), "[aeiou]", "_").alias("f"))

    d = "FROM orders"
    r.sql("date_trunc", f"SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, date_trunc('year', o_orderdate) AS y, date_trunc('week', o_orderdate) AS w {d}", f"SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS y, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS w {d}")
    r.sql("date_extract", f"SELECT o_orderkey, {', '.join(f'CAST(extract({u} FROM o_orderdate) AS BIGINT) AS {u}_' for u in ('year', 'quarter', 'month', 'day', 'doy', 'hour', 'minute'))} {d}")
    r.sql("date_part", f"SELECT o_orderkey, CAST(date_part('week', o_orderdate) AS BIGINT) AS w, CAST(date_part('dow', o_orderdate) AS BIGINT) - 1 AS dow {d}", f"SELECT o_orderkey, CAST(date_part('week', o_orderdate) AS BIGINT) AS w, CAST(date_part('dow', o_orderdate) AS BIGINT) AS dow {d}")
    r.sql("date_interval", f"SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY AS a, o_orderdate - INTERVAL 2 MONTH AS b, o_orderdate + INTERVAL 90 MINUTE AS c {d}")
    r.sql("date_age", f"SELECT o_orderkey, CAST(datediff(TIMESTAMP '2001-01-01 00:00:00', o_orderdate) AS BIGINT) AS days {d}", f"SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '2001-01-01 00:00:00') AS days {d}")
    r.sql("date_make", "SELECT make_date(2024, 2, 29) AS d, make_timestamp_ntz(2024, 2, 29, 12, 30, 15.5) AS t, to_date('2024-03-05') AS p", "SELECT make_date(2024, 2, 29) AS d, make_timestamp(2024, 2, 29, 12, 30, 15.5) AS t, CAST('2024-03-05' AS DATE) AS p")
    r.sql("date_epoch", "SELECT event_id, CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS BIGINT) AS us FROM events", "SELECT event_id, epoch_us(ts) AS us FROM events")
    r.sql("date_from_epoch", "SELECT CAST(timestamp_seconds(1700000000) AS TIMESTAMP_NTZ) AS t", "SELECT make_timestamp(1700000000000000) AS t")
    r.sql("date_series", "SELECT explode(sequence(TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-02 00:00:00', INTERVAL 3 HOURS)) AS t", "SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-02 00:00:00', INTERVAL 3 HOURS)) AS t")
    r.sql("date_last_day", f"SELECT o_orderkey, last_day(o_orderdate) AS l, CAST(o_orderdate AS DATE) AS d {d}")

    @r.pair("date_now_once", "SELECT true AS same, true AS later")
    def _now(spark, sf_dir):
        return spark.range(1).select((F.now() == F.current_timestamp()).alias("same"), (F.current_date() > F.lit("2020-01-01").cast("date")).alias("later"))

    n = "FROM (VALUES (7, 2), (-7, 2), (9, -4), (0, 5)) t(a, b)"
    r.sql("math_integer", f"SELECT a, b, a + b AS s, a - b AS d, a * b AS p, CAST(a DIV b AS BIGINT) AS q, a % b AS m, abs(a) AS ab FROM (VALUES (7, 2), (-7, 2), (9, -4), (0, 5)) t(a, b)", f"SELECT a, b, a + b AS s, a - b AS d, a * b AS p, CAST(trunc(a / b) AS BIGINT) AS q, a % b AS m, abs(a) AS ab {n}")
    r.sql("math_round", "SELECT o_orderkey, round(o_totalprice, 1) AS r, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(ceil(o_totalprice) AS BIGINT) AS c FROM orders")
    r.sql("math_functions", "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS q, round(ln(o_totalprice), 6) AS l, round(power(o_custkey, 1.5), 4) AS w, round(exp(0.5), 6) AS e, round(pi(), 6) AS pi_, sign(o_custkey - 100.0) AS s FROM orders", "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS q, round(ln(o_totalprice), 6) AS l, round(power(o_custkey, 1.5), 4) AS w, round(exp(0.5), 6) AS e, round(pi(), 6) AS pi_, CAST(sign(o_custkey - 100.0) AS DOUBLE) AS s FROM orders")
    r.sql("math_random_bounds", "SELECT count(*) AS n FROM (SELECT rand(7) AS x FROM orders) t WHERE x >= 0 AND x < 1", "SELECT count(*) AS n FROM (SELECT random() AS x FROM orders) t WHERE x >= 0 AND x < 1")

    @r.pair("math_trunc", "SELECT x, CAST(trunc(x) AS BIGINT) AS t FROM (VALUES (1.7::DOUBLE), (-1.7::DOUBLE), (0.2::DOUBLE)) t(x)")
    def _trunc(spark, sf_dir):
        return spark.sql("SELECT CAST(x AS DOUBLE) AS x FROM (VALUES (1.7), (-1.7), (0.2)) t(x)").select("x", trunc_number(F.col("x")).cast("long").alias("t"))

    @r.pair("shard_index", "SELECT token, CAST(least((token + 2147483648) // (4294967296 // 7), 6) AS INT) AS shard FROM (VALUES (-2147483648), (-1), (0), (1), (2147483647), (123456789)) t(token)")
    def _shard(spark, sf_dir):
        """Equal ranges of 32-bit tokens; the last takes what is over."""
        t = spark.createDataFrame([(x,) for x in (-2147483648, -1, 0, 1, 2147483647, 123456789)], "token long")
        return t.select("token", uniform_range_shard(F.col("token"), 7).alias("shard"))

    a = "FROM nation"
    r.sql("arr_construct", f"SELECT n_nationkey, array(n_nationkey, n_regionkey)[0] AS f, element_at(array(n_nationkey, n_regionkey), 2) AS s, CAST(size(array(1, 2, n_nationkey)) AS BIGINT) AS n {a}", f"SELECT n_nationkey, [n_nationkey, n_regionkey][1] AS f, [n_nationkey, n_regionkey][2] AS s, CAST(len([1, 2, n_nationkey]) AS BIGINT) AS n {a}")
    r.sql("arr_unnest", f"SELECT n_nationkey, explode(array(n_regionkey, 100 + n_regionkey)) AS x {a}", f"SELECT n_nationkey, unnest([n_regionkey, 100 + n_regionkey]) AS x {a}")
    r.sql("arr_unnest_ordinality", f"SELECT n_nationkey, pos + 1 AS pos, x {a} LATERAL VIEW posexplode(array(n_regionkey, n_nationkey)) t AS pos, x", "SELECT n_nationkey, CAST(generate_subscripts([n_regionkey, n_nationkey], 1) AS INT) AS pos, unnest([n_regionkey, n_nationkey]) AS x FROM nation")
    r.sql("arr_subquery", "SELECT r_regionkey, array_join(array_sort(collect_list(n_nationkey)), ',') AS a FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey", "SELECT r_regionkey, array_to_string(ARRAY(SELECT n_nationkey FROM nation WHERE n_regionkey = r_regionkey ORDER BY 1), ',') AS a FROM region")
    r.sql("arr_append_cat", f"SELECT n_nationkey, array_join(array_append(array(1, 2), n_nationkey), ',') AS p, array_join(concat(array(n_regionkey), array(7, 8)), ',') AS c, CAST(array_position(array(3, 1, 2), n_regionkey) AS BIGINT) AS i {a}", f"SELECT n_nationkey, array_to_string(list_append([1, 2], n_nationkey), ',') AS p, array_to_string(list_concat([n_regionkey], [7, 8]), ',') AS c, CAST(coalesce(list_position([3, 1, 2], n_regionkey), 0) AS BIGINT) AS i {a}")
    r.sql("arr_slice_sort", f"SELECT n_nationkey, array_join(slice(array(5, 3, n_nationkey, 1), 2, 2), ',') AS s, array_join(sort_array(array(5, 3, n_nationkey, 1)), ',') AS o, array_join(array_distinct(array(n_regionkey, n_regionkey, 9)), ',') AS u {a}", f"SELECT n_nationkey, array_to_string([5, 3, n_nationkey, 1][2:3], ',') AS s, array_to_string(list_sort([5, 3, n_nationkey, 1]), ',') AS o, CASE WHEN n_regionkey = 9 THEN '9' ELSE n_regionkey || ',9' END AS u {a}")
    r.sql("row_struct", f"SELECT n_nationkey, named_struct('a', n_nationkey, 'b', n_name).b AS b {a}", f"SELECT n_nationkey, struct_pack(a := n_nationkey, b := n_name).b AS b {a}")

    e = "FROM events"
    r.sql("json_field", f"SELECT event_id, get_json_object(props, '$.k') AS t, CAST(get_json_object(props, '$.k') AS INT) AS k {e}", f"SELECT event_id, json_extract_string(props, '$.k') AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k {e}")
    r.sql("json_variant", f"SELECT event_id, variant_get(parse_json(props), '$.k', 'int') AS k {e}", f"SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k {e}")
    r.sql("json_build", f"SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'n', n_name)) AS o, to_json(array(n_nationkey, n_regionkey)) AS a {a}", f"SELECT n_nationkey, CAST(json_object('k', n_nationkey, 'n', n_name) AS VARCHAR) AS o, CAST(json_array(n_nationkey, n_regionkey) AS VARCHAR) AS a {a}")
    r.sql("json_row", "SELECT to_json(struct(r_regionkey, r_name)) AS j FROM region", "SELECT CAST(to_json(struct_pack(r_regionkey := r_regionkey, r_name := r_name)) AS VARCHAR) AS j FROM region")
    r.sql("json_array_length", "SELECT CAST(json_array_length(x) AS BIGINT) AS n FROM (VALUES ('[1,2,[3]]'), ('[]')) t(x)")
    r.sql("json_array_elements", "SELECT explode(from_json('[\"a\",\"b\",\"c\"]', 'array<string>')) AS x", "SELECT unnest(from_json('[\"a\",\"b\",\"c\"]', '[\"VARCHAR\"]')) AS x")
    r.sql("json_keys", "SELECT explode(json_object_keys('{\"a\":1,\"b\":{\"c\":2}}')) AS k", "SELECT unnest(json_keys('{\"a\":1,\"b\":{\"c\":2}}')) AS k")
    r.sql("json_populate", "SELECT r.a AS a, r.b AS b FROM (SELECT from_json('{\"a\":1,\"b\":\"x\"}', 'a INT, b STRING') AS r) t", "SELECT r.a AS a, r.b AS b FROM (SELECT from_json('{\"a\":1,\"b\":\"x\"}', '{\"a\":\"INTEGER\",\"b\":\"VARCHAR\"}') AS r) t")
    r.sql("json_path_exists", f"SELECT event_id, get_json_object(props, '$.k') IS NOT NULL AS has_k, get_json_object(props, '$.z') IS NOT NULL AS has_z {e}", f"SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.z') AS has_z {e}")
    r.sql("json_table", "SELECT o.id, o.v FROM (SELECT inline(from_json('[{\"id\":1,\"v\":\"x\"},{\"id\":2}]', 'array<struct<id:int,v:string>>'))) o", "SELECT CAST(json_extract(j, '$.id') AS INT) AS id, json_extract_string(j, '$.v') AS v FROM (SELECT unnest(from_json('[{\"id\":1,\"v\":\"x\"},{\"id\":2}]', '[\"JSON\"]')) AS j) t")
    r.sql("json_group", "SELECT get_json_object(props, '$.k') AS k, count(*) AS n FROM events GROUP BY get_json_object(props, '$.k')", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY json_extract_string(props, '$.k')")

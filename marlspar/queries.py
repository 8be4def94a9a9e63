"""Queries of the dialect over the driver's tables, each with the same query in plain SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.parser import SqlError
from .session import Engine, Result
from .sources import kv

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with a warehouse of its own and the folder's tables to read."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="marlspar-")
    e = Engine(spark, f"{base.rstrip('/')}/warehouse-{uuid.uuid4().hex}")
    for t in TABLES:
        e.bind(t, _Lazy(spark, f"{sf_dir}/{t}.parquet"))  # type: ignore[arg-type]
    return e


class _Lazy:
    """A table that is opened when a query names it."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path, self._df = spark, path, None

    def __getattr__(self, name: str):
        if self._df is None:
            self._df = self._spark.read.parquet(self._path)
        return getattr(self._df, name)


def _dialect(*statements: str) -> Callable[[SparkSession, str], DataFrame]:
    """Runs statements; the last is the query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        for s in statements[:-1]:
            out = e.execute(s)
            if not out.ok:
                raise SqlError(out.message)
        return e.query(statements[-1])

    return run


#: name -> (statements, the same in DuckDB's SQL; None: as the last statement)
PLAIN: dict[str, tuple[tuple[str, ...], str | None]] = {
    "q_flagship": (("SELECT l_returnflag, COUNT(*) AS n, SUM(l_linenumber) AS lines FROM lineitem WHERE l_linenumber >= 2 GROUP BY l_returnflag HAVING COUNT(*) > 1 ORDER BY l_returnflag ASC LIMIT 5",), "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE l_linenumber >= 2 GROUP BY l_returnflag HAVING count(*) > 1 ORDER BY 1 LIMIT 5"),
    "scan_all": (("SELECT * FROM nation",), None),
    "project_alias": (("SELECT n_name AS name, n_regionkey FROM nation",), None),
    "table_alias": (("SELECT n.n_name AS name FROM nation AS n WHERE n.n_regionkey = 1",), None),
    "scalar_select": (("SELECT 1 AS one, 'x' AS letter, TRUE AS yes",), "SELECT CAST(1 AS BIGINT) AS one, 'x' AS letter, TRUE AS yes"),
    "filter_cmp_eq": (("SELECT p_partkey, p_size FROM part WHERE p_size = 7",), None),
    "filter_cmp_ne": (("SELECT p_partkey, p_size FROM part WHERE p_size <> 7",), None),
    "filter_cmp_lt": (("SELECT p_partkey, p_size FROM part WHERE p_size < 7",), None),
    "filter_cmp_le": (("SELECT p_partkey, p_size FROM part WHERE p_size <= 7",), None),
    "filter_cmp_gt": (("SELECT p_partkey, p_size FROM part WHERE p_size > 43",), None),
    "filter_cmp_ge": (("SELECT p_partkey, p_size FROM part WHERE p_size >= 43",), None),
    "filter_col_col": (("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey < l_suppkey",), None),
    "filter_between": (("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12",), None),
    "filter_like_prefix": (("SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%'",), "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S')"),
    "filter_like_suffix": (("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%L'",), "SELECT p_partkey, p_type FROM part WHERE suffix(p_type, 'L')"),
    "filter_like_contains": (("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%d w%'",), "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'd w')"),
    "filter_like_exact": (("SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'BUILDING'",), "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_like_literal_wildcards": (("SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE 'NATION_1%' OR NOT n_name LIKE 'NATIO_%'",), "SELECT n_nationkey, n_name FROM nation WHERE starts_with(n_name, 'NATION_1') OR NOT starts_with(n_name, 'NATIO_')"),
    "filter_is_null": (("WITH s AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS big FROM part) SELECT p_partkey FROM s WHERE big IS NULL",), None),
    "filter_not_null": (("WITH s AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS big FROM part) SELECT p_partkey, big FROM s WHERE big IS NOT NULL",), None),
    "filter_and_or_not": (("SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT p_type LIKE 'S%'",), "SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT starts_with(p_type, 'S')"),
    "filter_not_two_valued": (("WITH s AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS big FROM part) SELECT p_partkey FROM s WHERE NOT (big < 40)",), "WITH s AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS big FROM part) SELECT p_partkey FROM s WHERE NOT coalesce(big < 40, FALSE)"),
    "filter_null_is_value": (("WITH s AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS big FROM part) SELECT p_partkey FROM s WHERE big != 30",), "WITH s AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS big FROM part) SELECT p_partkey FROM s WHERE big IS DISTINCT FROM 30"),
    "filter_cross_type": (("SELECT p_partkey FROM part WHERE p_name = 5 OR p_size != 'x'",), "SELECT p_partkey FROM part"),
    "in_subquery": (("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",), None),
    "not_in_subquery": (("SELECT c_custkey FROM customer WHERE NOT c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",), None),
    "in_subquery_or": (("SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",), None),
    "not_in_with_nulls": (("WITH s AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS big FROM part) SELECT p_partkey FROM part WHERE NOT p_size IN (SELECT big FROM s)",), "SELECT p_partkey FROM part WHERE p_size <= 25"),
    "inner_join": (("SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey = r_regionkey",), None),
    "join_star": (("SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey",), 'SELECT n_nationkey AS "nation.n_nationkey", n_name AS "nation.n_name", n_regionkey AS "nation.n_regionkey", r_regionkey AS "region.r_regionkey", r_name AS "region.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey'),
    "self_join": (("SELECT a.n_name AS x, b.n_name AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_nationkey",), None),
    "left_join": (("WITH o AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') SELECT c_custkey, o_orderkey FROM customer LEFT JOIN o ON c_custkey = o_custkey",), None),
    "left_join_null_filter": (("WITH o AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') SELECT c_custkey FROM customer LEFT JOIN o ON c_custkey = o_custkey WHERE o_orderkey IS NULL",), None),
    "join_nullsafe": (("WITH a AS (SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS k FROM nation), b AS (SELECT r_name, CASE WHEN r_regionkey > 1 THEN r_regionkey END AS k2 FROM region) SELECT n_nationkey, r_name FROM a JOIN b ON k = k2",), "SELECT n_nationkey, r_name FROM nation JOIN region ON (CASE WHEN n_regionkey > 1 THEN n_regionkey END) IS NOT DISTINCT FROM (CASE WHEN r_regionkey > 1 THEN r_regionkey END)"),
    "join_view": (("CREATE VIEW asia AS SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2", "SELECT c_custkey, n_name FROM customer JOIN asia ON c_nationkey = n_nationkey"), "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2"),
    "join_hash_large": (("SELECT o_orderkey, l_partkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1",), None),
    "join_aggregate": (("SELECT o_orderpriority, COUNT(*) AS n, SUM(l_linenumber) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority",), "SELECT o_orderpriority, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"),
    "count_star": (("SELECT COUNT(*) AS n FROM lineitem",), None),
    "count_col": (("WITH s AS (SELECT CASE WHEN p_size > 25 THEN p_size END AS big FROM part) SELECT COUNT(big) AS n, COUNT(*) AS everything FROM s",), None),
    "sum_int": (("SELECT SUM(p_size) AS total FROM part",), "SELECT CAST(sum(p_size) AS BIGINT) AS total FROM part"),
    "sum_empty_is_zero": (("SELECT SUM(p_size) AS total, COUNT(*) AS n, MAX(p_size) AS most FROM part WHERE p_size < 0",), "SELECT CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS n, CAST(NULL AS INTEGER) AS most"),
    "min_max_int": (("SELECT MIN(p_size) AS lo, MAX(p_size) AS hi FROM part",), None),
    "min_max_text": (("SELECT MIN(p_name) AS lo, MAX(p_name) AS hi FROM part",), None),
    "group_by": (("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus",), None),
    "group_by_null_key": (("WITH s AS (SELECT CASE WHEN p_size > 25 THEN p_size END AS big FROM part) SELECT big, COUNT(*) AS n FROM s GROUP BY big",), None),
    "having": (("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 14",), None),
    "group_order_limit": (("SELECT l_suppkey, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_suppkey ORDER BY l_suppkey DESC LIMIT 10",), "SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1 ORDER BY 1 DESC LIMIT 10"),
    "aggregate_distinct": (("SELECT DISTINCT COUNT(*) AS n FROM orders GROUP BY o_custkey",), "SELECT DISTINCT count(*) AS n FROM orders GROUP BY o_custkey"),
    "distinct": (("SELECT DISTINCT p_brand FROM part",), None),
    "distinct_order_limit": (("SELECT DISTINCT p_size FROM part ORDER BY p_size DESC LIMIT 3",), None),
    "order_by_asc": (("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC",), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal"),
    "order_by_desc_nulls": (("WITH s AS (SELECT n_nationkey, CASE WHEN n_nationkey > 22 THEN n_nationkey END AS k FROM nation) SELECT DISTINCT k FROM s ORDER BY k DESC",), "SELECT * FROM (SELECT DISTINCT CASE WHEN n_nationkey > 22 THEN n_nationkey END AS k FROM nation) ORDER BY k DESC NULLS FIRST"),
    "order_by_case": (("SELECT n_nationkey FROM nation WHERE n_nationkey < 9 ORDER BY CASE WHEN n_nationkey = 4 THEN 0 ELSE n_nationkey END ASC LIMIT 2",), "SELECT n_nationkey FROM nation WHERE n_nationkey IN (0, 4)"),
    "limit": (("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7",), None),
    "union": (("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",), None),
    "union_all": (("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",), None),
    "union_chain": (("SELECT r_regionkey AS k FROM region UNION ALL SELECT n_regionkey FROM nation UNION SELECT p_size FROM part",), None),
    "win_row_number": (("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders",), None),
    "win_rank": (("SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size ASC) AS r FROM part",), None),
    "win_rank_no_order": (("SELECT p_partkey, RANK() OVER (PARTITION BY p_brand) AS r FROM part",), "SELECT p_partkey, CAST(1 AS BIGINT) AS r FROM part"),
    "win_count_part": (("SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size ASC) AS n FROM part",), "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS n FROM part"),
    "win_sum_part": (("SELECT p_partkey, SUM(p_size) OVER (PARTITION BY p_brand) AS s FROM part",), "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand) AS BIGINT) AS s FROM part"),
    "win_count_all": (("SELECT n_nationkey, COUNT(n_name) OVER () AS n FROM nation",), None),
    "case_when": (("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 20 THEN 'middle' ELSE 'small' END AS kind FROM part",), None),
    "case_nested": (("SELECT p_partkey, CASE WHEN p_size > 25 THEN CASE WHEN p_type LIKE 'S%' THEN 'a' ELSE 'b' END END AS kind FROM part",), "SELECT p_partkey, CASE WHEN p_size > 25 THEN CASE WHEN starts_with(p_type, 'S') THEN 'a' ELSE 'b' END END AS kind FROM part"),
    "json_extract_int": (("SELECT event_id, JSON_EXTRACT(props, '$.k') AS k FROM events",), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "json_where": (("SELECT event_id FROM events WHERE JSON_EXTRACT(props, '$.k') = 69",), "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 69"),
    "json_where_type": (("SELECT event_id FROM events WHERE NOT JSON_EXTRACT(props, '$.k') = '69' AND JSON_EXTRACT(props, '$.k') > 50",), "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50"),
    "json_set": (("SELECT event_id, JSON_SET(props, '$.a.b', 'x') AS j FROM events",), """SELECT event_id, '{"a":{"b":"x"},"k":' || json_extract_string(props, '$.k') || '}' AS j FROM events"""),
    "cte": (("WITH big AS (SELECT p_partkey, p_size FROM part WHERE p_size > 30) SELECT p_partkey FROM big WHERE p_size < 40",), None),
    "cte_multi": (("WITH a AS (SELECT p_partkey, p_size FROM part WHERE p_size > 30), b AS (SELECT p_partkey FROM a WHERE p_size < 40) SELECT COUNT(*) AS n FROM b",), None),
    "recursive_cte_seq": (("WITH RECURSIVE r AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey = 0 UNION ALL SELECT s.nxt AS k FROM r JOIN s ON k = s.prev) SELECT k FROM r",), None),
    "recursive_cte_graph_dedup": (("WITH RECURSIVE r AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey = 7 UNION ALL SELECT nation.n_regionkey FROM r JOIN nation ON k = nation.n_nationkey) SELECT k FROM r",), "WITH RECURSIVE r AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey = 7 UNION SELECT n_regionkey FROM r JOIN nation ON k = n_nationkey) SELECT k FROM r"),
    "join_across_types": (("WITH a AS (SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS k FROM nation), b AS (SELECT r_regionkey, CASE WHEN r_regionkey > 2 THEN r_name END AS t FROM region) SELECT n_nationkey, r_regionkey FROM a JOIN b ON k = t",), "SELECT n_nationkey, r_regionkey FROM nation, region WHERE n_regionkey <= 1 AND r_regionkey <= 2"),
    "left_join_across_types": (("WITH a AS (SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS k FROM nation), b AS (SELECT r_regionkey, CASE WHEN r_regionkey > 2 THEN r_name END AS t FROM region) SELECT n_nationkey, r_regionkey FROM a LEFT JOIN b ON k = t",), "SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_regionkey <= 1 AND r_regionkey <= 2"),
    "in_across_types": (("WITH a AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS k FROM part), b AS (SELECT CASE WHEN r_regionkey > 2 THEN r_name END AS t FROM region) SELECT p_partkey FROM a WHERE k IN (SELECT t FROM b)",), "SELECT p_partkey FROM part WHERE p_size <= 25"),
    "not_in_across_types": (("WITH a AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS k FROM part), b AS (SELECT CASE WHEN r_regionkey > 2 THEN r_name END AS t FROM region) SELECT p_partkey FROM a WHERE NOT k IN (SELECT t FROM b) OR p_partkey IN (SELECT t FROM b)",), "SELECT p_partkey FROM part WHERE p_size > 25"),
    "filter_col_col_across_types": (("WITH a AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS k, CASE WHEN p_size > 10 THEN p_name END AS t FROM part) SELECT p_partkey FROM a WHERE k = t",), "SELECT p_partkey FROM part WHERE p_size <= 10"),
    "filter_ne_across_types": (("WITH a AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS k, CASE WHEN p_size > 10 THEN p_name END AS t FROM part) SELECT p_partkey FROM a WHERE k != t",), "SELECT p_partkey FROM part WHERE p_size > 10"),
    "order_by_join": (("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC",), "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC"),
    "union_of_ordered_branches": (("SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey DESC LIMIT 5 UNION ALL SELECT c_custkey FROM customer ORDER BY c_custkey ASC LIMIT 3",), "SELECT * FROM (SELECT o_orderkey AS k FROM orders ORDER BY 1 DESC LIMIT 5) UNION ALL SELECT * FROM (SELECT c_custkey FROM customer ORDER BY 1 LIMIT 3)"),
    "win_row_number_all": (("SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey DESC) AS n FROM orders",), "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS n FROM orders"),
    "win_rank_all": (("SELECT p_partkey, RANK() OVER (ORDER BY p_size ASC) AS r FROM part",), "SELECT p_partkey, rank() OVER (ORDER BY p_size) AS r FROM part"),
    "win_sum_all": (("SELECT o_orderkey, SUM(o_custkey) OVER () AS s, COUNT(*) OVER () AS n FROM orders",), "SELECT o_orderkey, CAST(sum(o_custkey) OVER () AS BIGINT) AS s, count(*) OVER () AS n FROM orders"),
    "json_extract_nested": (("SELECT event_id, JSON_EXTRACT(JSON_SET(JSON_SET(props, '$.o.z', event_type), '$.o.a', 1), '$.o') AS j FROM events",), """SELECT event_id, '{"a":1,"z":"' || event_type || '"}' AS j FROM events"""),
    "udf_if": (("CREATE FUNCTION size_of(n INT) RETURNS TEXT BEGIN IF n > 40 THEN RETURN 'big'; END IF; IF n > 20 THEN RETURN 'middle'; END IF; RETURN 'small'; END", "SELECT p_partkey, size_of(p_size) AS kind FROM part WHERE size_of(p_size) != 'middle'"), "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' ELSE 'small' END AS kind FROM part WHERE p_size > 40 OR p_size <= 20"),
    "udf_while": (("CREATE FUNCTION stage(n INT) RETURNS INT BEGIN DECLARE at INT; SET at = 0; WHILE at < n DO SET at = CASE WHEN at = 0 THEN 10 WHEN at = 10 THEN 20 WHEN at = 20 THEN 40 ELSE 80 END; END WHILE; RETURN at; END", "SELECT p_partkey, stage(p_size) AS reached FROM part"), "SELECT p_partkey, CAST(CASE WHEN p_size <= 0 THEN 0 WHEN p_size <= 10 THEN 10 WHEN p_size <= 20 THEN 20 WHEN p_size <= 40 THEN 40 ELSE 80 END AS BIGINT) AS reached FROM part"),
}
PLAIN["recursive_cte_seq"] = (
    ("CREATE VIEW s AS SELECT n_nationkey AS prev, n_regionkey AS nxt FROM nation", "WITH RECURSIVE r AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 20 UNION ALL SELECT s.nxt AS k FROM r JOIN s ON r.k = s.prev) SELECT k FROM r"),
    "WITH RECURSIVE r AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 20 UNION SELECT n_regionkey FROM r JOIN nation ON k = n_nationkey) SELECT k FROM r",
)

_PARTS = "CREATE TABLE parts (id INT, name TEXT, size INT)"
_FILL = "INSERT INTO parts SELECT p_partkey, p_name, p_size FROM part"
_AS = "p_partkey AS id, p_name AS name, CAST(p_size AS BIGINT) AS size"
#: Statements that change tables, and what a query then sees.
CHANGES: dict[str, tuple[tuple[str, ...], str]] = {
    "insert_values": (("CREATE TABLE t (id INT, name TEXT, ok BOOL)", "INSERT INTO t VALUES (1, 'it''s', TRUE), (2, NULL, FALSE)", "SELECT * FROM t"), "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'it''s', TRUE), (CAST(2 AS BIGINT), NULL, FALSE)) v(id, name, ok)"),
    "insert_select": ((_PARTS, _FILL, "SELECT * FROM parts WHERE size > 40"), f"SELECT {_AS} FROM part WHERE p_size > 40"),
    "update_where": ((_PARTS, _FILL, "UPDATE parts SET size = 0, name = 'none' WHERE size > 40", "SELECT * FROM parts"), "SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'none' ELSE p_name END AS name, CASE WHEN p_size > 40 THEN 0 ELSE CAST(p_size AS BIGINT) END AS size FROM part"),
    "update_from": ((_PARTS, _FILL, "UPDATE parts SET size = 0 FROM lineitem WHERE parts.id = lineitem.l_partkey AND lineitem.l_linenumber = 7", "SELECT id, size FROM parts"), "SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7) THEN 0 ELSE CAST(p_size AS BIGINT) END AS size FROM part"),
    "update_in": ((_PARTS, _FILL, "UPDATE parts SET size = 0 WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7)", "SELECT id, size FROM parts"), "SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7) THEN 0 ELSE CAST(p_size AS BIGINT) END AS size FROM part"),
    "delete_where": ((_PARTS, _FILL, "DELETE FROM parts WHERE size < 10", "SELECT * FROM parts"), f"SELECT {_AS} FROM part WHERE p_size >= 10"),
    "delete_using": ((_PARTS, _FILL, "DELETE FROM parts USING lineitem WHERE parts.id = lineitem.l_partkey AND lineitem.l_linenumber = 7", "SELECT id FROM parts"), "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7)"),
    "alter_add": ((_PARTS, _FILL, "ALTER TABLE parts ADD COLUMN note TEXT", "UPDATE parts SET note = 'x' WHERE size = 5", "SELECT id, note FROM parts"), "SELECT p_partkey AS id, CASE WHEN p_size = 5 THEN 'x' END AS note FROM part"),
    "alter_drop": ((_PARTS, _FILL, "ALTER TABLE parts DROP COLUMN name", "SELECT * FROM parts"), "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size FROM part"),
    "partition_prune": (("CREATE TABLE p (id INT, size INT) PARTITION BY RANGE (size) (PARTITION a VALUES LESS THAN (10), PARTITION b VALUES LESS THAN (30), PARTITION c VALUES LESS THAN MAXVALUE)", "INSERT INTO p SELECT p_partkey, p_size FROM part", "SELECT * FROM p WHERE size < 10 OR size = 40"), "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size < 10 OR p_size = 40"),
    "index_lookup": ((_PARTS, _FILL, "CREATE INDEX ON parts(size, name)", "SELECT id FROM parts WHERE size = 12"), "SELECT p_partkey AS id FROM part WHERE p_size = 12"),
    "matview_stale": ((_PARTS, "CREATE MATERIALIZED VIEW m AS SELECT id, size FROM parts", _FILL, "SELECT COUNT(*) AS n FROM m"), "SELECT CAST(0 AS BIGINT) AS n"),
    "matview_refresh": ((_PARTS, "CREATE MATERIALIZED VIEW m AS SELECT id, size FROM parts WHERE size > 30", _FILL, "REFRESH MATERIALIZED VIEW m", "SELECT * FROM m"), "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size > 30"),
    "temp_shadow": ((_PARTS, _FILL, "CREATE TEMPORARY TABLE parts (id INT)", "INSERT INTO parts VALUES (7)", "SELECT * FROM parts"), "SELECT CAST(7 AS BIGINT) AS id"),
    "procedure_call": ((_PARTS, _FILL, "CREATE PROCEDURE shrink(start INT) BEGIN DECLARE most INT; SET most = start; WHILE most > 10 DO DELETE FROM parts WHERE size > most; SET most = CASE WHEN most > 30 THEN 30 WHEN most > 20 THEN 20 ELSE 10 END; END WHILE; END", "CALL shrink(40)", "SELECT id, size FROM parts"), "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size <= 20"),
    "trigger_before": ((_PARTS, "CREATE TRIGGER fix BEFORE INSERT ON parts FOR EACH ROW BEGIN SET NEW.size = 1; END", _FILL, "SELECT id, size FROM parts"), "SELECT p_partkey AS id, CAST(1 AS BIGINT) AS size FROM part"),
    "trigger_after": ((_PARTS, "CREATE TABLE log (id INT, what TEXT)", "CREATE TRIGGER note AFTER DELETE ON parts FOR EACH ROW BEGIN INSERT INTO log VALUES (1, 'deleted'); END", _FILL, "DELETE FROM parts WHERE size = 3", "SELECT * FROM log"), "SELECT CAST(1 AS BIGINT) AS id, 'deleted' AS what"),
    "check_two_valued": (("CREATE TABLE c (id INT, size INT, CHECK (size > 0 OR size IS NULL))", "INSERT INTO c SELECT p_partkey, p_size FROM part", "SELECT COUNT(*) AS n FROM c"), "SELECT count(*) AS n FROM part"),
    "pk_lookup": ((_PARTS, _FILL, "SELECT * FROM parts WHERE id = 57"), f"SELECT {_AS} FROM part WHERE p_partkey = 57"),
    "drop_table": ((_PARTS, _FILL, "DROP TABLE parts", "DROP TABLE IF EXISTS parts", "CREATE TABLE parts (id INT, brand TEXT)", "INSERT INTO parts SELECT p_partkey, p_brand FROM part", "SELECT * FROM parts"), "SELECT p_partkey AS id, p_brand AS brand FROM part"),
    "check_holds": (("CREATE TABLE c (id INT, size INT, CHECK (size > 0 OR size IS NULL))", "INSERT INTO c SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END FROM part", "SELECT * FROM c"), "SELECT p_partkey AS id, CAST(CASE WHEN p_size > 25 THEN p_size END AS BIGINT) AS size FROM part"),
    "delete_in": ((_PARTS, _FILL, "DELETE FROM parts WHERE size > 45 OR id IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7)", "SELECT id FROM parts"), "SELECT p_partkey AS id FROM part WHERE p_size <= 45 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7)"),
    "composite_index_lookup": ((_PARTS, _FILL, "CREATE INDEX ON parts(name, size)", "CREATE INDEX ON parts(size)", "SELECT id FROM parts WHERE name = 'red widget' AND size = 28"), "SELECT p_partkey AS id FROM part WHERE p_name = 'red widget' AND p_size = 28"),
    "vacuum_merge": ((_PARTS, _FILL, "UPDATE parts SET size = 1 WHERE size = 2", "VACUUM", "SELECT COUNT(*) AS n, SUM(size) AS s FROM parts"), "SELECT count(*) AS n, CAST(sum(CASE WHEN p_size = 2 THEN 1 ELSE p_size END) AS BIGINT) AS s FROM part"),
}


def prepared_exec(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.execute("PREPARE q AS SELECT p_partkey FROM part WHERE p_size = $1 AND p_brand != $2")
    return e.execute("EXECUTE q(12, 'Brand#11')").df


def cursor_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.execute("DECLARE c CURSOR FOR SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey ASC")
    e.execute("OPEN c")
    rows = []
    while got := e.execute("FETCH NEXT FROM c INTO a, b").rows:
        rows += got
    return spark.createDataFrame(rows, "n_nationkey int, n_name string")


def analyze_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    for s in (_PARTS, _FILL, "ANALYZE TABLE parts"):
        e.execute(s)
    st = e.store.catalog.tables["parts"].stats
    return spark.createDataFrame([(c, st["rows"], v["ndv"], str(v["min"]), str(v["max"])) for c, v in st["columns"].items()], "col string, n_rows long, ndv long, lo string, hi string")


def mvcc_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event in the first half of the events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("ts"), (F.col("event_type") == "purchase").alias("deleted"))
    return kv.snapshot(log, events.agg(F.max("event_id")).first()[0] // 2)


def kv_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("ts"), F.lit(False).alias("deleted"))
    return kv.snapshot(log.where(F.col("key").between("1", "2"))).orderBy("key")


def _refused(setup: tuple[str, ...], statement: str, last: str):
    """A statement that must fail, and what a query then sees, beside the message."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        for x in setup:
            if not (out := e.execute(x)).ok:
                raise SqlError(out.message)
        out = e.execute(statement)
        if out.ok and out.df is not None:  # what only its rows can tell
            try:
                out.df.collect()
            except PySparkException as x:
                out = Result("error", message=next((m for m in ("ended without RETURN",) if m in str(x)), str(x)))
        if out.ok:
            raise SqlError(f"not refused: {statement}")
        return e.query(last).withColumn("message", F.lit(out.message))

    return run


#: name -> (statements before, the statement that is refused, the query after, its SQL, the message)
REFUSED = {
    "unknown_column": ((_PARTS, _FILL), "SELECT nope FROM parts", "SELECT id FROM parts", "SELECT p_partkey AS id FROM part", "unknown column 'nope'"),
    "aggregate_validation": ((_PARTS, _FILL), "SELECT name, COUNT(*) FROM parts GROUP BY size", "SELECT id FROM parts", "SELECT p_partkey AS id FROM part", "column 'name' must appear in GROUP BY when aggregate functions are used"),
    "primary_key": ((_PARTS, _FILL), "INSERT INTO parts VALUES (57, 'again', 1)", "SELECT id, size FROM parts", "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size FROM part", "duplicate primary key '57' for table 'parts'"),
    "foreign_key": ((_PARTS, _FILL, "CREATE TABLE uses (id INT, part INT, FOREIGN KEY (part) REFERENCES parts(id))", "INSERT INTO uses SELECT p_partkey, p_partkey FROM part"), "INSERT INTO uses VALUES (-1, -7)", "SELECT * FROM uses", "SELECT p_partkey AS id, p_partkey AS part FROM part", "foreign key constraint failed on 'uses.part' referencing 'parts.id'"),
    "foreign_key_restrict": ((_PARTS, _FILL, "CREATE TABLE uses (id INT, part INT, FOREIGN KEY (part) REFERENCES parts(id))", "INSERT INTO uses SELECT p_partkey, p_partkey FROM part WHERE p_size = 9"), "DELETE FROM parts WHERE size < 10", "SELECT id FROM parts", "SELECT p_partkey AS id FROM part", "cannot delete row from 'parts' because it is referenced by 'uses.part'"),
    "unique_constraint": (("CREATE TABLE u (id INT, name TEXT, size INT, UNIQUE (name, size))", "INSERT INTO u SELECT p_partkey, p_brand, p_partkey FROM part"), "INSERT INTO u VALUES (-1, 'x', 1), (-2, 'x', 1)", "SELECT * FROM u", "SELECT p_partkey AS id, p_brand AS name, p_partkey AS size FROM part", "unique constraint violation on table 'u' for (name, size)"),
    "check_violated": (("CREATE TABLE c (id INT, size INT, CHECK (size > 10))", "INSERT INTO c SELECT p_partkey, p_size FROM part WHERE p_size > 10"), "INSERT INTO c SELECT p_partkey, p_size FROM part WHERE p_size <= 10", "SELECT * FROM c", "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size > 10", "check constraint failed on table 'c': size > 10"),
    "udf_without_return": (("CREATE FUNCTION f(n INT) RETURNS INT BEGIN IF n > 40 THEN RETURN n; END IF; END",), "SELECT f(p_size) FROM part", "SELECT f(p_size) AS s FROM part WHERE p_size > 40", "SELECT CAST(p_size AS BIGINT) AS s FROM part WHERE p_size > 40", "ended without RETURN"),
    "udf_arguments": (("CREATE FUNCTION f(n INT) RETURNS INT BEGIN RETURN n; END",), "SELECT f(p_size, 1) FROM part", "SELECT f(p_size) AS s FROM part", "SELECT CAST(p_size AS BIGINT) AS s FROM part", "function 'f' expects 1 argument(s), got 2"),
    "drop_function": (("CREATE FUNCTION f(n INT) RETURNS INT BEGIN RETURN 1; END", "DROP FUNCTION f"), "SELECT f(p_size) FROM part", "SELECT p_partkey FROM part", "SELECT p_partkey FROM part", "function 'f' does not exist"),
}


def script_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script runs up to its first failing statement."""
    out = engine(spark, sf_dir).script(f"{_PARTS}; {_FILL}; DELETE FROM parts WHERE size < 30; SELECT id, size FROM parts; SELECT * FROM missing; DROP TABLE parts")
    assert [r.kind for r in out] == ["created", "inserted", "deleted", "select", "error"]
    return out[3].df


def grant_revoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user sees after GRANT, and is told after REVOKE."""
    e = engine(spark, sf_dir)
    for x in (_PARTS, _FILL, "GRANT SELECT ON parts TO ann"):
        e.execute(x)
    ann = Engine(spark, e.store.root, user="ann")
    seen = ann.query("SELECT id FROM parts")
    e.execute("REVOKE SELECT ON parts FROM ann")
    return seen.withColumn("message", F.lit(ann.execute("SELECT id FROM parts").message))


def isolation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two engines over one warehouse: a procedure of READ COMMITTED sees what the other commits between its statements, one of REPEATABLE READ does not."""
    rows = []
    for level in ("READ COMMITTED", "REPEATABLE READ"):
        e = engine(spark, sf_dir)
        for x in (_PARTS, _FILL, "CREATE PROCEDURE seen() BEGIN SELECT COUNT(*) AS n FROM parts; SELECT COUNT(*) AS n FROM parts; END", f"SET TRANSACTION ISOLATION LEVEL {level}"):
            if not (out := e.execute(x)).ok:
                raise SqlError(out.message)
        other, counts, plain = Engine(spark, e.store.root), [], e.planned

        def planned(q, other=other, counts=counts, plain=plain):
            built = plain(q)
            counts.append(built.df.first()[0])
            if len(counts) == 1:
                other.execute("DELETE FROM parts WHERE size > 25")
            return built

        e.planned = planned  # type: ignore[method-assign]
        e.execute("CALL seen()")
        rows.append((level, *counts))
    return spark.createDataFrame(rows, "level string, first long, second long")


def concurrent_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two engines over one warehouse: neither's rows are lost."""
    a = engine(spark, sf_dir)
    a.execute(_PARTS)
    b = Engine(spark, a.store.root)
    for t in TABLES:
        b.bind(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    refresh, b.store.refresh = b.store.refresh, lambda: None  # type: ignore[method-assign]  # b does not look before it writes
    for e, s in ((a, "INSERT INTO parts SELECT p_partkey, p_name, p_size FROM part WHERE p_size <= 25"), (b, "INSERT INTO parts SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 25")):
        if not (out := e.execute(s)).ok:
            raise SqlError(out.message)
    b.store.refresh = refresh  # type: ignore[method-assign]
    return Engine(spark, a.store.root).query("SELECT * FROM parts")


def explain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operators of a plan over an indexed table."""
    e = engine(spark, sf_dir)
    for x in (_PARTS, _FILL, "CREATE INDEX ON parts(size, name)"):
        e.execute(x)
    tree, rows = e.execute("EXPLAIN SELECT name, COUNT(*) FROM parts WHERE size = 7 GROUP BY name").tree, []
    while tree:
        rows.append((len(rows), tree["node_type"], tree["table"]))
        tree = tree["children"][0] if tree["children"] else None
    return spark.createDataFrame([r for r in rows if r[1] != "Project"], "depth int, node string, scanned string").select("node", "scanned")


def http_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's rows as the HTTP server gives them."""
    import json
    import threading
    import urllib.request

    from .server import http
    from .session import EngineConfig

    e = engine(spark, sf_dir)
    for x in ("CREATE TABLE nations (id INT, name TEXT)", "INSERT INTO nations SELECT n_nationkey, n_name FROM nation"):
        e.execute(x)
    server = http(spark, EngineConfig(warehouse_dir=e.store.root, server_port=0))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        ask = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}/api/sql", b"SELECT id, name FROM nations", {"Content-Type": "text/plain"})
        with urllib.request.urlopen(ask, timeout=120) as r:
            rows = json.loads(r.read())["rows"]
    finally:
        server.shutdown()
        server.server_close()
    return spark.createDataFrame([tuple(r) for r in rows], "id long, name string")


def _kv(spark: SparkSession, sf_dir: str, isolation: str = "REPEATABLE READ") -> kv.KvStore:
    """A store that holds each customer's segment."""
    store = kv.KvStore(spark, engine(spark, sf_dir).store.root, isolation)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    store.append(customers.select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(False).alias("deleted")))
    return store


def kv_put_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _kv(spark, sf_dir)
    store.put("7", "CHANGED")
    store.delete("8")
    assert (store.get("7"), store.get("8")) == ("CHANGED", None)
    return store.scan()


def kv_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit and a rollback."""
    store = _kv(spark, sf_dir)
    for value, end in (("KEPT", "commit"), ("LOST", "rollback")):
        t = store.begin()
        t.put("7", value)
        t.delete("8")
        getattr(t, end)()
    return store.scan()


def kv_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a transaction of each level reads after another's commit."""
    rows = []
    for level in ("READ COMMITTED", "REPEATABLE READ", "SERIALIZABLE"):
        store = _kv(spark, sf_dir, level)
        t = store.begin()
        other = kv.KvStore(spark, store.root)
        other.put("7", "CHANGED")
        rows.append((level, t.get("7") == "CHANGED"))
    return spark.createDataFrame(rows, "level string, sees boolean")


def kv_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _kv(spark, sf_dir)
    store.delete("7")
    return spark.createDataFrame([(k, v) for k, v in store.stats().items()], "name string, n long")


def kv_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction leaves one folder, the latest values and no deleted key."""
    store = _kv(spark, sf_dir)
    store.put("7", "CHANGED")
    store.delete("8")
    store.compact()
    assert store.stats()["folders"] == 1
    return kv.KvStore(spark, store.root).log().select("key", "value", "deleted")


def kv_dump_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _kv(spark, sf_dir)
    store.dump(f"{store.root}/dump.json")
    other = kv.KvStore(spark, f"{store.root}/other")
    other.load(f"{store.root}/dump.json")
    return other.scan()


def bloom_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an index's files hold: written before the index, they now have Bloom filters, but for columns whose dictionary serves as well."""
    e = engine(spark, sf_dir)
    for x in (_PARTS, _FILL, "CREATE INDEX ON parts(id, size)"):
        e.execute(x)
    folder = e.store.catalog.tables["parts"].folders[0]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = set()
    for path in e.store.files.list(folder):
        if path.endswith(".parquet"):
            at = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(at)
            for block in reader.getFooter().getBlocks():
                found |= {c.getPath().toDotString() for c in block.getColumns() if c.getBloomFilterOffset() >= 0}
            reader.close()
    return spark.createDataFrame([(c,) for c in sorted(found)], "name string")


SNAPSHOT = "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS value FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'purchase'"
CODE = {
    "prepared_exec": (prepared_exec, "SELECT p_partkey FROM part WHERE p_size = 12 AND p_brand <> 'Brand#11'"),
    "cursor_fetch": (cursor_fetch, "SELECT n_nationkey, n_name FROM nation"),
    "analyze_stats": (analyze_stats, " UNION ALL ".join(f"SELECT '{a}' AS col, count(*) AS n_rows, count(DISTINCT {b}) AS ndv, CAST(min({b}) AS VARCHAR) AS lo, CAST(max({b}) AS VARCHAR) AS hi FROM part" for a, b in (("id", "p_partkey"), ("name", "p_name"), ("size", "p_size")))),
    "mvcc_snapshot": (mvcc_snapshot, SNAPSHOT),
    "script_run": (script_run, "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size >= 30"),
    "grant_revoke": (grant_revoke, "SELECT p_partkey AS id, 'permission denied: user ''ann'' does not have SELECT privilege on ''parts''' AS message FROM part"),
    "isolation_levels": (isolation_levels, "SELECT 'READ COMMITTED' AS level, count(*) AS first, count_if(p_size <= 25) AS second FROM part UNION ALL SELECT 'REPEATABLE READ', count(*), count(*) FROM part"),
    "concurrent_writers": (concurrent_writers, f"SELECT {_AS} FROM part"),
    "explain_plan": (explain_plan, "SELECT * FROM (VALUES ('Aggregate', ''), ('CompositeIndexScan', 'parts')) v(node, scanned)"),
    "http_rows": (http_rows, "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation"),
    "kv_put_delete": (kv_put_delete, "SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey = 7 THEN 'CHANGED' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey <> 8"),
    "kv_transaction": (kv_transaction, "SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey = 7 THEN 'KEPT' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey <> 8"),
    "kv_isolation": (kv_isolation, "SELECT * FROM (VALUES ('READ COMMITTED', TRUE), ('REPEATABLE READ', FALSE), ('SERIALIZABLE', FALSE)) v(level, sees)"),
    "kv_stats": (kv_stats, "SELECT 'keys' AS name, count(*) - 1 AS n FROM customer UNION ALL SELECT 'folders', 2 UNION ALL SELECT 'ts', 2"),
    "kv_compact": (kv_compact, "SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey = 7 THEN 'CHANGED' ELSE c_mktsegment END AS value, FALSE AS deleted FROM customer WHERE c_custkey <> 8"),
    "kv_dump_load": (kv_dump_load, "SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS value FROM customer"),
    "bloom_index": (bloom_index, "SELECT 'id' AS name"),
    "kv_range_scan": (kv_range_scan, "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS value FROM events WHERE CAST(user_id AS VARCHAR) BETWEEN '1' AND '2' GROUP BY 1"),
}

CODE |= {k: (_refused(setup, bad, last), f"SELECT *, '{message.replace(chr(39), chr(39) * 2)}' AS message FROM ({sql})") for k, (setup, bad, last, sql, message) in REFUSED.items()}

QUERIES = {k: _dialect(*s) for k, (s, _) in (PLAIN | CHANGES).items()} | {k: f for k, (f, _) in CODE.items()}
SQL = {k: o or s[-1] for k, (s, o) in (PLAIN | CHANGES).items()} | {k: o for k, (_, o) in CODE.items()}

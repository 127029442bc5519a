"""Filters, joins, aggregates, pages and set operations that Spark SQL and other engines write alike."""

from __future__ import annotations

from ..operators.symbols import linked
from ..sources.tables import run_sql, table
from .registry import query

# The instant that ages are counted from, one hour past it, and the length of a look-back.
NOW = "timestamp '2024-02-01 00:00:00'"

SQL = {
    # filters
    "scope_filter": "SELECT event_id, user_id, value FROM events WHERE user_id = 7 AND event_type = 'click'",
    "validity_filter": "SELECT event_id, user_id FROM events WHERE value IS NOT NULL AND (value > 50 OR event_type IS NULL) AND event_type <> 'error'",
    "in_list": "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase') GROUP BY event_type",
    "like_containment": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' OR p_type LIKE 'PRO%'",
    "case_insensitive_containment": "SELECT p_partkey, p_type FROM part WHERE lower(p_type) LIKE '%promo%'",
    "range_between": "SELECT conv_id, turn, role FROM conversations WHERE turn BETWEEN 1 AND 3",
    "look_back": "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type",
    "eligibility_filter": "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND s_nationkey NOT IN (1, 2) AND s_name IS NOT NULL",
    "blocking_deny_sets": "SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'error' AND d.user_id = e.user_id AND d.value > 95) AND e.value > 90",
    # joins
    "seen_artifact_join": "SELECT c.conv_id, c.turn, d.doc_id FROM conversations c JOIN documents d ON c.conv_id = d.doc_id",
    "segments_artifacts_join": "SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM lineitem l JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON l.l_orderkey = o.o_orderkey",
    "relations_top": "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 20",
    "left_join_sum": "SELECT c_custkey, coalesce(round(sum(o_totalprice), 2), 0.0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "correlated_sum": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer",
    "correlated_max": "SELECT p_partkey, (SELECT max(l_quantity) FROM lineitem WHERE l_partkey = p_partkey) AS most FROM part",
    "dependency_gate": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')",
    "gc_liveness": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "existence_check": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "ownership_collision": "SELECT DISTINCT l_partkey FROM lineitem a WHERE l_suppkey = 1 AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey <> 1)",
    "reversed_edges": "SELECT DISTINCT a.l_suppkey AS x, a.l_linenumber AS y FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_linenumber AND a.l_linenumber = b.l_suppkey WHERE a.l_suppkey < a.l_linenumber",
    "path_coupling": "SELECT n1.n_name AS customer_nation, n2.n_name AS supplier_nation, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE n1.n_nationkey <> n2.n_nationkey GROUP BY n1.n_name, n2.n_name",
    "name_resolution": "SELECT e.user_id, min(t.event_id) AS only_id FROM (SELECT DISTINCT user_id FROM events) e JOIN events t ON t.user_id = e.user_id AND t.value > 95 AND t.event_type = 'signup' GROUP BY e.user_id HAVING count(DISTINCT t.value) = 1",
    "suffix_join": "SELECT a.p_partkey AS importer, b.p_partkey AS imported FROM part a JOIN part b ON substring(a.p_name, length(a.p_name) - 1) = substring(b.p_name, length(b.p_name) - 1) AND a.p_brand = b.p_brand WHERE a.p_partkey < b.p_partkey AND b.p_size = 1",
    "model_account_join": "SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name IN ('ASIA', 'EUROPE')",
    "receipt_join": "SELECT o_orderkey, coalesce(l.quota, o_totalprice) AS quota FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS quota FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey) l ON o_orderkey = l_orderkey",
    "set_difference_refresh": "SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0",
    "graph_relation_hops": "SELECT s.s_suppkey, n.n_nationkey, r.r_regionkey FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey",
    # aggregates
    "group_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "global_sums": "SELECT count(*) AS n, round(coalesce(sum(value), 0), 4) AS total FROM events",
    "count_distinct": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "conditional_sum": "SELECT l_returnflag, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS discounted FROM lineitem GROUP BY l_returnflag",
    "having_duplicates": "SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY p_brand, p_type, p_size HAVING count(*) > 1",
    "ledger_rollup": "SELECT round(sum(greatest(l_extendedprice * (1 - l_discount), 0)), 2) AS cost, count(DISTINCT l_orderkey) AS sessions, count(DISTINCT l_suppkey) AS providers, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS denied FROM lineitem",
    "savings_rollup": "SELECT l_returnflag AS source, count(*) AS n, round(sum(l_extendedprice - l_extendedprice * (1 - l_discount)), 2) AS saved FROM lineitem GROUP BY l_returnflag",
    "geometric_mean": "SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) AS geometric FROM lineitem GROUP BY l_returnflag",
    "true_median": "SELECT l_returnflag, median(l_quantity) AS middle FROM lineitem GROUP BY l_returnflag",
    "cost_amortization": "SELECT l_shipmode_n, round(base, 2) AS base, round(cached, 2) AS cached FROM (SELECT l_linenumber AS l_shipmode_n, sum(l_extendedprice) AS base, sum(l_extendedprice * 1.25) / 1000 + sum(l_extendedprice * 0.1) AS cached FROM lineitem GROUP BY l_linenumber)",
    "priced_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "module_boundaries": "SELECT r_name AS module, count(DISTINCT n_nationkey) AS files, count(DISTINCT s_suppkey) AS symbols FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name",
    "search_grouping": "SELECT source, count(*) AS results FROM documents GROUP BY source ORDER BY results DESC, source LIMIT 24",
    # sort, pages, sets
    "case_sort": "SELECT event_id, event_type FROM events ORDER BY CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'purchase' THEN 1 ELSE 2 END, event_id LIMIT 50",
    "top_k": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25",
    "keyset_page": "SELECT event_id, user_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100",
    "last_rows": "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 30",
    "union_all_endpoints": "SELECT node, count(*) AS n FROM (SELECT l_partkey AS node FROM lineitem UNION ALL SELECT l_suppkey AS node FROM lineitem) GROUP BY node",
    "normalised_distinct": "SELECT lower(trim(p_type)) AS kind, min(p_partkey) AS first_key FROM part GROUP BY lower(trim(p_type))",
    "distinct_in_order": "SELECT event_type, min(event_id) AS first_at FROM events GROUP BY event_type",
    "content_hash_dedup": "SELECT sha, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, md5(text) AS sha FROM documents) GROUP BY sha HAVING count(*) > 1",
    "set_intersection": "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'",
    "idempotent_tasks": "SELECT DISTINCT user_id, event_type FROM events",
    # expressions
    "cache_health": "SELECT band, count(*) AS n FROM (SELECT CASE WHEN value < 60 THEN 'active' WHEN value < 90 THEN 'refresh-due' ELSE 'expired' END AS band FROM events) GROUP BY band",
    "retry_backoff": "SELECT o_orderkey, least(3600, power(2, o_orderkey % 14)) AS delay FROM orders WHERE o_orderstatus = 'P'",
    "complexity_class": "SELECT p_partkey, CASE WHEN points >= 8 THEN 'critical' WHEN points >= 5 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS complexity FROM (SELECT p_partkey, (CASE WHEN p_size > 40 THEN 5 WHEN p_size > 20 THEN 3 ELSE 0 END) + (CASE WHEN p_type LIKE '%PROMO%' THEN 3 ELSE 0 END) + (CASE WHEN p_retailprice > 1500 THEN 1 ELSE 0 END) AS points FROM part)",
    "timeline": "SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS n FROM conversations ORDER BY conv_id, turn",
    "class_hierarchy": "SELECT r_name AS base, n_name AS derived FROM nation JOIN region ON n_regionkey = r_regionkey",
    "not_in_edges": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')",
    "summary_generation": "SELECT user_id, event_type, max(event_id) AS current_id, count(*) AS generations FROM events GROUP BY user_id, event_type",
    "cost_per_success": "SELECT l_linestatus, round(sum(l_extendedprice) / count(CASE WHEN l_returnflag <> 'R' THEN 1 END), 4) AS cost FROM lineitem GROUP BY l_linestatus",
    "state_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "ttl_expiry": "SELECT count(*) AS expired FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 20 DAY",
    "cheapest_route": "SELECT l_partkey, min(l_extendedprice / l_quantity) AS unit_price FROM lineitem GROUP BY l_partkey",
}


def _add(name: str, sql: str) -> None:
    def run(spark, sf_dir):
        return run_sql(spark, sf_dir, sql)

    query(sql, name)(run)


for _name, _sql in SQL.items():
    _add(_name, _sql)


@query("SELECT DISTINCT a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size WHERE a.p_partkey <> b.p_partkey")
def symbol_link(spark, sf_dir):
    """Pairs without more of a group in one task than a cell of them."""
    return linked(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type", "p_size"])

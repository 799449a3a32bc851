"""Sources, filters, projections, sets and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordinate import sources
from ordinate.queries.base import Tables, query
from ordinate.sources.factories import TABLE_KEYS
from ordinate.sources.generator import from_schema

for _table in TABLE_KEYS:
    if _table not in ("embeddings", "conversations"):
        query(f"SELECT * FROM {_table}", f"src_scan_{_table}")(lambda t, n=_table: getattr(t, n))


@query("SELECT vec_id, label, len(embedding) AS n, embedding[1]::DOUBLE AS first, list_max(embedding)::DOUBLE AS greatest FROM embeddings")
def src_scan_embeddings(t: Tables):
    return t.embeddings.select(lambda r: {"vec_id": r.vec_id, "label": r.label, "n": F.size(r.embedding).cast("long"), "first": r.embedding[0].cast("double"), "greatest": F.array_max(r.embedding).cast("double")})


@query("SELECT conv_id, turn, role, text FROM conversations")
def src_scan_conversations(t: Tables):
    return t.conversations


@query("SELECT range AS value FROM range(5, 25)")
def src_range(t: Tables):
    return sources.from_range(t.spark, 5, 20)


@query("SELECT 'x' AS value FROM range(7)")
def src_repeat(t: Tables):
    return sources.repeat(t.spark, "x", 7)


@query("SELECT CAST(NULL AS BIGINT) AS a, CAST(NULL AS VARCHAR) AS b WHERE false")
def src_empty(t: Tables):
    return sources.empty(t.spark, "a bigint, b string")


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(id, name)")
def src_from_iterable(t: Tables):
    return sources.from_iterable(t.spark, [(1, "a"), (2, "b"), (3, None)], "id int, name string")


@query("SELECT (range * 7 + 3) % 11 AS value FROM range(50)")
def src_generate(t: Tables):
    return sources.generate(t.spark, lambda i: F.pmod(i * 7 + 3, F.lit(11)), 50)


@query("""
WITH RECURSIVE r(value, depth) AS (
  SELECT 1::BIGINT, 0 UNION ALL SELECT value * 2 + k, depth + 1 FROM r, (VALUES (0), (1)) c(k) WHERE depth < 4)
SELECT value FROM r""")
def src_recursive_gen(t: Tables):
    return sources.recursive_generator(t.spark, 1, lambda v: F.array(v * 2, v * 2 + 1), 5).select(lambda r: {"value": r.value.cast("long")})


@query()
def gen_from_schema(t: Tables):
    schema = {
        "id": ("pyint", {"min_value": 1, "max_value": 100}), "name": "name", "tags": [{"_qen_items": "word", "_qen_count": (1, 3)}],
        "status": {"_qen_provider": "choice", "from": ["a", "b"]}, "label": {"_qen_provider": "ref", "key": "id", "format": "item-{}"},
    }
    return from_schema(t.spark, schema, 42).take(1000)


@query("SELECT 1000::BIGINT AS n, true AS ids, true AS names, true AS tags, true AS lengths, true AS statuses, true AS labels")
def gen_keeps_its_schema(t: Tables):
    made = gen_from_schema(t).df
    every = lambda c, name: F.bool_and(c).alias(name)
    return made.agg(
        F.count("*").alias("n"), every(F.col("id").between(1, 100), "ids"), every(F.length("name") > 0, "names"), every(F.forall("tags", lambda x: F.length(x) > 0), "tags"),
        (F.array_sort(F.collect_set(F.size("tags"))) == F.array(F.lit(1), F.lit(2), F.lit(3))).alias("lengths"), (F.array_sort(F.collect_set("status")) == F.array(F.lit("a"), F.lit("b"))).alias("statuses"),
        every(F.col("label") == F.concat(F.lit("item-"), F.col("id").cast("string")), "labels"),
    )


# filter and projection
@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND value > 50")
def where(t: Tables):
    return t.events.where(lambda r: (r.event_type == "click") & (r.value > 50)).select(("event_id", "user_id", "value"))


@query("SELECT event_id, upper(event_type) AS kind, round(value * 2, 6) AS twice, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS side FROM events")
def select(t: Tables):
    return t.events.select(lambda r: {"event_id": r.event_id, "kind": F.upper(r.event_type), "twice": F.round(r.value * 2, 6), "side": F.when(r.value > 50, "high").otherwise("low")})


@query("SELECT unnest(string_split(p_name, ' ')) AS value FROM part")
def select_many(t: Tables):
    return t.part.select_many(lambda r: F.split(r.p_name, " "))


@query("SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS index FROM events")
def select_with_index(t: Tables):
    return t.events.select_with_index(lambda r, i: {"event_id": r.event_id, "user_id": r.user_id, "index": i})


@query("SELECT event_id, props FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL")
def of_type(t: Tables):
    return t.events.of_type(int, lambda r: F.get_json_object(r.props, "$.k")).select(("event_id", "props"))


_SUB = "SELECT r_name FROM region"


@query(f"{_SUB} UNION ALL SELECT 'ATLANTIS'")
def append(t: Tables):
    return t.region.select("r_name").append("ATLANTIS")


@query(f"SELECT r_name, row_number() OVER (ORDER BY k) - 1 AS index FROM (SELECT r_name, r_regionkey AS k FROM region UNION ALL SELECT 'ATLANTIS', -1)")
def prepend(t: Tables):
    return t.region.select("r_name").prepend("ATLANTIS").indexed()


@query("SELECT r_name FROM region")
def default_if_empty_hit(t: Tables):
    return t.region.select("r_name").default_if_empty("none")


@query("SELECT 'none' AS r_name")
def default_if_empty_miss(t: Tables):
    return t.region.where(lambda r: r.r_regionkey < 0).select("r_name").default_if_empty("none")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m]') AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND length(p_name) % 2 = 0")
def scalar_functions(t: Tables):
    return t.part.where(lambda r: r.p_name.rlike("^[a-m]") & r.p_brand.isin("Brand#11", "Brand#12", "Brand#13") & (F.char_length(r.p_name) % 2 == 0)).select(("p_partkey", "p_name"))


# sets; customers of urgent and of low orders
def _urgent(t: Tables):
    return t.orders.where(lambda r: r.o_orderpriority == "1-URGENT").select(lambda r: {"k": r.o_custkey})


def _low(t: Tables):
    return t.orders.where(lambda r: r.o_orderpriority == "5-LOW").select(lambda r: {"k": r.o_custkey})


_U, _L = "SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'", "SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW'"
_FIRST = "SELECT k, row_number() OVER (ORDER BY first) - 1 AS index FROM (SELECT o_custkey AS k, min(o_orderkey) AS first FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)"


@query(_FIRST)
def distinct(t: Tables):
    return _urgent(t).set.distinct().indexed()


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def distinct_by_key(t: Tables):
    return t.orders.set.distinct("o_custkey").select(("o_orderkey", "o_custkey"))


@query(f"{_U} UNION {_L}")
def union(t: Tables):
    return _urgent(t).set.union(_low(t))


@query(f"SELECT k FROM ({_U}) WHERE k IN ({_L})")
def intersect(t: Tables):
    return _urgent(t).set.intersect(_low(t))


@query(f"{_U} INTERSECT {_L}")
def intersect_distinct(t: Tables):
    return _urgent(t).set.intersect(_low(t), dedupe=True)


@query(f"{_U} EXCEPT {_L}")
def except_(t: Tables):
    return _urgent(t).set.except_(_low(t))


@query(f"({_U} EXCEPT {_L}) UNION ALL ({_L} EXCEPT {_U})")
def sym_diff(t: Tables):
    return _urgent(t).set.symmetric_difference(_low(t))


@query(f"{_U} UNION ALL {_L}")
def concat(t: Tables):
    return _urgent(t).set.concat(_low(t))


@query(f"{_U} INTERSECT ALL {_L}")
def multiset_intersect(t: Tables):
    return _urgent(t).set.multiset_intersect(_low(t))


@query(f"{_U} EXCEPT ALL {_L}")
def except_by_count(t: Tables):
    return _urgent(t).set.except_by_count(_low(t))


@query("""
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem), b AS (SELECT p_partkey AS k FROM part),
n AS (SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS x, (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS y, (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS z)
SELECT y = 0 AS is_subset_of, z = 0 AS is_superset_of, y = 0 AND z > 0 AS is_proper_subset_of, z = 0 AND y > 0 AS is_proper_superset_of, x = 0 AS is_disjoint_with FROM n""")
def set_tests(t: Tables):
    a, b = t.lineitem.select(lambda r: {"k": r.l_partkey}), t.part.select(lambda r: {"k": r.p_partkey})
    return a.set.compare(b, "is_subset_of", "is_superset_of", "is_proper_subset_of", "is_proper_superset_of", "is_disjoint_with")


@query(f"SELECT (SELECT count(*) FROM ({_U} INTERSECT {_L}))::DOUBLE / (SELECT count(*) FROM ({_U} UNION {_L})) AS jaccard_similarity")
def jaccard(t: Tables):
    return _urgent(t).set.compare(_low(t), "jaccard_similarity")


# joins
@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey IS NOT DISTINCT FROM o_custkey")
def join(t: Tables):
    return t.customer.join.join(t.orders, "c_custkey", "o_custkey", lambda c, o: {"c_custkey": c.c_custkey, "o_orderkey": o.o_orderkey, "o_totalprice": o.o_totalprice})


@query("SELECT o_orderkey, coalesce(l_linenumber, 99) AS line FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def left_join(t: Tables):
    return t.orders.join.left_join(t.lineitem, "o_orderkey", "l_orderkey", lambda o, i: {"o_orderkey": o.o_orderkey, "line": i.l_linenumber}, default_inner={"l_linenumber": 99})


@query("SELECT d.doc_id, coalesce(l.toxic, -1) AS toxic FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id")
def right_join(t: Tables):
    return t.labels.join.right_join(t.documents, "doc_id", "doc_id", lambda a, d: {"doc_id": d.doc_id, "toxic": a.toxic}, default_outer={"toxic": -1})


@query("SELECT coalesce(o, -1) AS o, coalesce(n, '?') AS n FROM (SELECT o_orderkey AS o FROM orders WHERE o_orderkey % 3 = 0) a FULL JOIN (SELECT o_orderkey AS p, o_orderstatus AS n FROM orders WHERE o_orderkey % 2 = 0) b ON o = p")
def full_outer_join(t: Tables):
    a, b = t.orders.where(lambda r: r.o_orderkey % 3 == 0), t.orders.where(lambda r: r.o_orderkey % 2 == 0)
    return a.join.full_outer_join(b, "o_orderkey", "o_orderkey", lambda x, y: {"o": x.o_orderkey, "n": y.o_orderstatus}, default_outer={"o_orderkey": -1}, default_inner={"o_orderstatus": "?"})


@query("SELECT coalesce(o_orderkey, -1) AS o, coalesce(l_linenumber, -1) AS line FROM orders FULL JOIN lineitem ON o_orderkey = l_orderkey")
def full_outer_join_whole(t: Tables):
    return t.orders.join.full_outer_join(t.lineitem, "o_orderkey", "l_orderkey", lambda o, i: {"o": o.o_orderkey, "line": i.l_linenumber}, default_outer={"o_orderkey": -1}, default_inner={"l_linenumber": -1})


@query("SELECT c_custkey, coalesce(n, 0)::BIGINT AS n, coalesce(spent, 0)::DOUBLE AS spent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(18,2)) AS spent FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def group_join(t: Tables):
    return t.customer.join.group_join(
        t.orders, "c_custkey", "o_custkey", lambda c, g: {"c_custkey": c.c_custkey, "n": F.coalesce(g.n, F.lit(0)), "spent": F.coalesce(g.spent.cast("double"), F.lit(0.0))},
        n=lambda r: F.count("*"), spent=lambda r: F.sum(r.o_totalprice.cast("decimal(18,2)")),
    )


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(t: Tables):
    return t.region.join.cross_join(t.nation, lambda r, n: {"r_name": r.r_name, "n_name": n.n_name})


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey + 1 = r_regionkey + 1")
def join_computed_key(t: Tables):
    return t.nation.join.join(t.region, lambda r: r.n_regionkey + 1, lambda r: r.r_regionkey + 1, lambda n, r: {"n_name": n.n_name, "r_name": r.r_name})


@query("SELECT * FROM (VALUES ('a', 'x'), (NULL, 'z')) v(l, r)")
def join_null_keys(t: Tables):
    a = sources.from_iterable(t.spark, [("a",), ("b",), (None,)], "l string")
    b = sources.from_iterable(t.spark, [("a", "x"), ("c", "y"), (None, "z")], "k string, r string")
    return a.join.join(b, "l", "k", lambda x, y: {"l": x.l, "r": y.r})


@query("SELECT r_name, s_name FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS p FROM region) JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS p FROM supplier) USING (p)")
def zip_with(t: Tables):
    return t.region.zip.zip_with(t.supplier, lambda r, s: {"r_name": r.r_name, "s_name": s.s_name})


@query("SELECT coalesce(r_name, '-') AS r_name, s_name FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS p FROM region) FULL JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS p FROM supplier) USING (p)")
def zip_longest_with(t: Tables):
    return t.region.zip.zip_longest_with(t.supplier, lambda r, s: {"r_name": r.r_name, "s_name": s.s_name}, default_self={"r_name": "-"})

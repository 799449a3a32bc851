"""Sorts, slices, searches and windows over positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordinate import sources
from ordinate.queries.base import Tables, query

_O = "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders"
_COLS = ("o_orderkey", "o_orderpriority", "o_totalprice")
_E = "SELECT event_id, value FROM events"


@query(f"SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS index FROM ({_O})")
def order_by(t: Tables):
    return t.orders.select(_COLS).order_by("o_totalprice").indexed()


@query(f"SELECT *, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) - 1 AS index FROM ({_O})")
def order_by_desc(t: Tables):
    return t.orders.select(_COLS).order_by_descending("o_orderpriority").indexed()


@query(f"SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_totalprice, o_orderkey) - 1 AS index FROM ({_O})")
def then_by(t: Tables):
    return t.orders.select(_COLS).order_by("o_orderpriority").then_by("o_totalprice").indexed()


@query(f"SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS index FROM ({_O})")
def then_by_desc(t: Tables):
    return t.orders.select(_COLS).order_by("o_orderpriority").then_by_descending("o_totalprice").indexed()


@query("SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn, role DESC) - 1 AS index FROM conversations")
def as_ordered_then_by(t: Tables):
    return t.conversations.select(("conv_id", "turn", "role")).as_ordered().then_by_descending("role").indexed()


@query(f"{_E} ORDER BY event_id LIMIT 25")
def take(t: Tables):
    return t.events.select(("event_id", "value")).take(25)


@query(f"{_E} ORDER BY event_id OFFSET 25")
def skip(t: Tables):
    return t.events.select(("event_id", "value")).skip(25)


@query(f"{_E} ORDER BY event_id LIMIT 20 OFFSET 40")
def page(t: Tables):
    return t.events.select(("event_id", "value")).skip(40).take(20)


@query(f"SELECT event_id, value FROM ({_E} ORDER BY event_id DESC OFFSET 30)")
def take_negative(t: Tables):
    return t.events.select(("event_id", "value")).take(-30)


@query(f"SELECT event_id, value FROM ({_E} ORDER BY event_id DESC LIMIT 30)")
def skip_negative(t: Tables):
    return t.events.select(("event_id", "value")).skip(-30)


@query(f"{_O} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(t: Tables):
    return t.orders.select(_COLS).order_by_descending("o_totalprice").take(10)


@query("SELECT event_id, value FROM events WHERE event_id < (SELECT coalesce(min(event_id), 9e18) FROM events WHERE value >= 100)")
def take_while(t: Tables):
    return t.events.select(("event_id", "value")).take_while(lambda r: r.value < 100)


@query("SELECT event_id, value FROM events WHERE event_id >= (SELECT coalesce(min(event_id), 9e18) FROM events WHERE value >= 100)")
def skip_while(t: Tables):
    return t.events.select(("event_id", "value")).skip_while(lambda r: r.value < 100)


@query("SELECT event_id, row_number() OVER (ORDER BY event_id DESC) - 1 AS index FROM events")
def reverse(t: Tables):
    return t.events.select("event_id").reverse().indexed()


@query(f"{_O} WHERE o_orderpriority = '3-MEDIUM'")
def find_by_key(t: Tables):
    return t.orders.select(_COLS).order_by("o_orderpriority").then_by_descending("o_totalprice").find_by_key("3-MEDIUM")


@query(f"{_O} WHERE o_totalprice BETWEEN 1000 AND 50000")
def between_keys(t: Tables):
    return t.orders.select(_COLS).order_by("o_totalprice").between_keys(1000.0, 50000.0)


@query(f"{_O} WHERE (o_orderpriority > '2-HIGH' OR o_orderpriority = '2-HIGH' AND o_totalprice <= 200000) AND (o_orderpriority < '4-NOT SPECIFIED' OR o_orderpriority = '4-NOT SPECIFIED' AND o_totalprice >= 100000)")
def between_keys_two(t: Tables):
    s = t.orders.select(_COLS).order_by("o_orderpriority").then_by_descending("o_totalprice")
    return s.between_keys(("2-HIGH", 200000.0), ("4-NOT SPECIFIED", 100000.0))


@query("SELECT k, side, row_number() OVER (ORDER BY k, side, p) - 1 AS index FROM (SELECT c_nationkey AS k, 0 AS side, c_custkey AS p FROM customer UNION ALL SELECT s_nationkey, 1, s_suppkey FROM supplier)")
def merge_with(t: Tables):
    a = t.customer.select(lambda r: {"k": r.c_nationkey, "side": F.lit(0)}).order_by("k")
    return a.merge_with(t.supplier.select(lambda r: {"k": r.s_nationkey, "side": F.lit(1)}).order_by("k")).indexed()


@query("SELECT o_orderkey, lag(o_orderkey, 2, -1::BIGINT) OVER (ORDER BY o_totalprice, o_orderkey) AS lag FROM orders")
def lag_in_order(t: Tables):
    return t.orders.order_by("o_totalprice").lag_in_order(2, -1, "o_orderkey").select(("o_orderkey", "lag"))


@query("SELECT o_orderkey, lead(o_orderkey) OVER (ORDER BY o_totalprice, o_orderkey) AS lead FROM orders")
def lead_in_order(t: Tables):
    return t.orders.order_by("o_totalprice").lead_in_order(1, None, "o_orderkey").select(("o_orderkey", "lead"))


@query("SELECT string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 7 AS c FROM events) GROUP BY c")
def chunk(t: Tables):
    return t.events.select("event_id").group.chunk(7).select(lambda r: {"ids": F.array_join(r["items"].cast("array<string>"), ",")})


@query("SELECT string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS c FROM events) GROUP BY c")
def batched(t: Tables):
    return t.events.select("event_id").group.batched(100).select(lambda r: {"ids": F.array_join(r["items"].cast("array<string>"), ",")})


@query("SELECT event_id || ',' || lead(event_id) OVER w || ',' || lead(event_id, 2) OVER w AS ids FROM events WINDOW w AS (ORDER BY event_id) QUALIFY lead(event_id, 2) OVER w IS NOT NULL")
def window_slide(t: Tables):
    return t.events.select("event_id").group.window(3).select(lambda r: {"ids": F.array_join(r["items"].cast("array<string>"), ",")})


@query("SELECT event_id AS first, lead(event_id) OVER (ORDER BY event_id) AS second FROM events QUALIFY second IS NOT NULL")
def pairwise(t: Tables):
    return t.events.select("event_id").group.pairwise()


_RUNS = "SELECT event_id, event_type, sum(n) OVER (ORDER BY event_id) AS run FROM (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id))::INT AS n FROM events)"


@query(f"SELECT any_value(event_type) AS key, count(*) AS n, min(event_id) AS first FROM ({_RUNS}) GROUP BY run")
def batch_by(t: Tables):
    return t.events.group.batch_by("event_type").select(lambda r: {"key": r.key, "n": F.size(r["items"]).cast("long"), "first": r["items"][0]["event_id"]})


@query(f"SELECT value, length, row_number() OVER (ORDER BY run) - 1 AS index FROM (SELECT any_value(event_type) AS value, count(*) AS length, run FROM ({_RUNS}) GROUP BY run)")
def rle(t: Tables):
    return t.events.util.run_length_encode("event_type").indexed()


_D = "value::DECIMAL(18,4)"


def _events(t: Tables):
    return t.events.select(lambda r: {"event_id": r.event_id, "value": r.value.cast("decimal(18,4)")})


@query(f"SELECT event_id, (sum({_D}) OVER w)::DOUBLE AS rolling_sum FROM events WINDOW w AS (ORDER BY event_id ROWS 4 PRECEDING) QUALIFY row_number() OVER (ORDER BY event_id) >= 5")
def rolling_sum(t: Tables):
    return _events(t).stats.rolling_sum(5, "value").select(lambda r: {"event_id": r.event_id, "rolling_sum": r.rolling_sum.cast("double")})


@query(f"SELECT event_id, round((sum({_D}) OVER w)::DOUBLE / 5, 6) AS rolling_average FROM events WINDOW w AS (ORDER BY event_id ROWS 4 PRECEDING) QUALIFY row_number() OVER (ORDER BY event_id) >= 5")
def rolling_average(t: Tables):
    return _events(t).stats.rolling_sum(5, "value").select(lambda r: {"event_id": r.event_id, "rolling_average": F.round(r.rolling_sum.cast("double") / 5, 6)})


@query("SELECT l_orderkey, l_linenumber, round(product(1 + (l_discount::DOUBLE - 0.05) / 10000) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate), 6) AS p FROM lineitem")
def cumulative_product_whole(t: Tables):
    growth = t.lineitem.stats.cumulative_product(lambda r: 1 + (r.l_discount.cast("double") - 0.05) / 10000)
    return growth.select(lambda r: {"l_orderkey": r.l_orderkey, "l_linenumber": r.l_linenumber, "p": F.round(r.cumulative_product, 6)})


@query("SELECT event_id, max(value) OVER w - min(value) OVER w AS value FROM events WINDOW w AS (ORDER BY event_id ROWS 9 PRECEDING) QUALIFY row_number() OVER (ORDER BY event_id) >= 10")
def rolling_window(t: Tables):
    s = t.events.select(("event_id", "value"))
    s = s.stats.rolling_window(10, lambda c: F.collect_list(c), "value", "w")
    return s.select(lambda r: {"event_id": r.event_id, "value": F.array_max(r.w) - F.array_min(r.w)})


@query("SELECT event_id, lag(value, 3, 0.0) OVER (ORDER BY event_id) AS lag FROM events")
def lag(t: Tables):
    return t.events.stats.lag(3, 0.0, "value").select(("event_id", "lag"))


@query("SELECT event_id, lead(value, 2) OVER (ORDER BY event_id) AS lead FROM events")
def lead(t: Tables):
    return t.events.stats.lead(2, None, "value").select(("event_id", "lead"))


@query("SELECT event_id, user_id - lag(user_id, 2) OVER (ORDER BY event_id) AS diff FROM events QUALIFY row_number() OVER (ORDER BY event_id) > 2")
def diff(t: Tables):
    return t.events.stats.diff(2, "user_id").select(("event_id", "diff"))


@query("SELECT 100::BIGINT AS value UNION ALL SELECT (100 + sum(user_id) OVER (ORDER BY event_id))::BIGINT FROM events")
def scan(t: Tables):
    return t.events.stats.scan("sum", 100, "user_id")


@query("SELECT n_nationkey, (sum(n_nationkey) OVER (ORDER BY n_nationkey))::BIGINT AS value FROM nation UNION ALL SELECT -1, 0")
def scan_custom(t: Tables):
    s = t.nation.select("n_nationkey").stats.scan(lambda a, x: a + x, 0)
    return s.select_with_index(lambda r, i: {"n_nationkey": (i - 1).cast("int"), "value": r.value.cast("long")})


@query(f"SELECT event_id, (sum({_D}) OVER (ORDER BY event_id))::DOUBLE AS cumulative_sum FROM events")
def cumulative_sum(t: Tables):
    return _events(t).stats.cumulative_sum("value").select(lambda r: {"event_id": r.event_id, "cumulative_sum": r.cumulative_sum.cast("double")})


@query("SELECT n_nationkey, round(product(n_nationkey + 1.0::DOUBLE) OVER (ORDER BY n_nationkey) / 1e10, 3) AS p FROM nation WHERE n_nationkey < 15")
def cumulative_product(t: Tables):
    return t.nation.where(lambda r: r.n_nationkey < 15).stats.cumulative_product(lambda r: r.n_nationkey + 1.0).select(lambda r: {"n_nationkey": r.n_nationkey, "p": F.round(r.cumulative_product / 1e10, 3)})


@query("SELECT event_id, max(value) OVER (ORDER BY event_id) AS cumulative_max FROM events")
def cumulative_max(t: Tables):
    return t.events.stats.cumulative_max("value").select(("event_id", "cumulative_max"))


@query("SELECT event_id, min(value) OVER (ORDER BY event_id) AS cumulative_min FROM events")
def cumulative_min(t: Tables):
    return t.events.stats.cumulative_min("value").select(("event_id", "cumulative_min"))


@query("SELECT event_id, rank() OVER (ORDER BY user_id) AS rank FROM events")
def rank(t: Tables):
    return t.events.stats.rank("user_id").select(("event_id", "rank"))


@query("SELECT event_id, rank() OVER (ORDER BY user_id DESC) AS rank FROM events")
def rank_desc(t: Tables):
    return t.events.stats.rank("user_id", ascending=False).select(("event_id", "rank"))


@query("SELECT event_id, dense_rank() OVER (ORDER BY user_id) AS dense_rank FROM events")
def dense_rank(t: Tables):
    return t.events.stats.dense_rank("user_id").select(("event_id", "dense_rank"))


@query("SELECT r_name AS value FROM region UNION ALL SELECT '|' FROM range((SELECT count(*) - 1 FROM region))")
def intersperse(t: Tables):
    return t.region.select("r_name").util.intersperse("|").select(lambda r: {"value": r.r_name})


@query("SELECT * FROM (VALUES (1, 10), (2, 20), (3, NULL)) v(a, b)")
def positional_literals(t: Tables):
    return sources.from_iterable(t.spark, [1, 2, 3], "int").zip.zip_longest_with(sources.from_iterable(t.spark, [10, 20], "int"), lambda a, b: {"a": a.value, "b": b.value})

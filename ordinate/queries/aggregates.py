"""Groups, aggregates, scaling and terminals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordinate.queries.base import Tables, query


def _money(c):
    return c.cast("decimal(18,2)")


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)))::DOUBLE AS revenue, round(avg(l_quantity), 6) AS avg_qty
FROM lineitem WHERE l_quantity > 25 GROUP BY ALL ORDER BY revenue DESC LIMIT 10""")
def flagship(t: Tables):
    return t.lineitem.where(lambda r: r.l_quantity > 25).group.group_by_with_aggregate(
        ("l_returnflag", "l_linestatus"), None, n=lambda r: F.count("*"),
        revenue=lambda r: F.sum(_money(r.l_extendedprice) * (1 - _money(r.l_discount))).cast("double"), avg_qty=lambda r: F.round(F.avg(r.l_quantity), 6),
    ).order_by_descending("revenue").take(10)


@query("SELECT event_type AS key, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY 1")
def group_by(t: Tables):
    return t.events.select(("event_id", "event_type")).group.group_by(lambda r: r.event_type).select(lambda r: {"key": r.key, "ids": F.array_join(F.transform(r["items"], lambda x: x["event_id"]), ",")})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY ALL")
def group_by_multiple(t: Tables):
    return t.lineitem.group.group_by_multiple("l_returnflag", "l_linestatus", n=lambda r: F.count("*"), first=lambda r: F.min(r.l_orderkey))


@query("SELECT event_type AS key, count(*) AS n, max(value) AS top FROM events GROUP BY 1")
def group_by_with_aggregate(t: Tables):
    return t.events.group.group_by_with_aggregate(lambda r: r.event_type, "value", n=lambda v: F.count(v), top=lambda v: F.max(v))


@query('SELECT l_returnflag AS "row", l_linestatus AS "column", count(*) AS "value" FROM lineitem GROUP BY ALL')
def pivot(t: Tables):
    return t.lineitem.group.pivot("l_returnflag", "l_linestatus", lambda r: F.count("*"))


@query("""SELECT l_returnflag AS "row", sum(CASE WHEN l_linestatus = 'F' THEN l_quantity::BIGINT END)::BIGINT AS "F", sum(CASE WHEN l_linestatus = 'O' THEN l_quantity::BIGINT END)::BIGINT AS "O" FROM lineitem GROUP BY 1""")
def pivot_wide(t: Tables):
    return t.lineitem.group.pivot("l_returnflag", "l_linestatus", lambda r: F.sum(r.l_quantity.cast("long")), ["F", "O"])


@query("SELECT o_orderstatus AS key, o_orderpriority AS sub_key, count(*) AS n FROM orders GROUP BY ALL")
def group_by_nested(t: Tables):
    return t.orders.select(("o_orderkey", "o_orderstatus", "o_orderpriority")).group.group_by_nested("o_orderstatus", "o_orderpriority", n=lambda r: F.count("*"))


@query("SELECT event_id, value > 50 AS side FROM events")
def partition(t: Tables):
    yes, no = t.events.select(("event_id", "value")).group.partition(lambda r: r.value > 50)
    return yes.select(lambda r: {"event_id": r.event_id, "side": F.lit(True)}).df.union(no.select(lambda r: {"event_id": r.event_id, "side": F.lit(False)}).df)


@query("SELECT sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS total, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS deviation, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer")
def stats_aggregates(t: Tables):
    c = F.col("c_acctbal")
    return t.customer.stats.aggregate(total=F.sum(_money(c)).cast("double"), mean=F.round(F.avg(c), 6), deviation=F.round(F.stddev_pop(c), 6), least=F.min(c), most=F.max(c))


def _one(t: Tables, **values):
    return t.spark.createDataFrame([tuple(values.values())], list(values))


@query("SELECT sum(user_id)::BIGINT AS v FROM events")
def stats_sum(t: Tables):
    return _one(t, v=t.events.stats.sum("user_id"))


@query("SELECT round(avg(value), 6) AS v FROM events")
def stats_average(t: Tables):
    return _one(t, v=round(t.events.stats.average("value"), 6))


@query("SELECT round(stddev_pop(value), 6) AS v FROM events")
def stats_std_dev(t: Tables):
    return _one(t, v=round(t.events.stats.std_dev("value"), 6))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1")
def stats_min(t: Tables):
    return t.customer.select(("c_custkey", "c_name", "c_acctbal")).stats.extreme_item("c_acctbal")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def stats_max(t: Tables):
    return t.customer.select(("c_custkey", "c_name", "c_acctbal")).stats.extreme_item("c_acctbal", least=False)


@query("SELECT round(median(value), 6) AS v FROM events")
def stats_median(t: Tables):
    return _one(t, v=round(t.events.stats.median("value"), 6))


@query("SELECT round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM events")
def stats_percentile(t: Tables):
    return t.events.stats.quantiles([0.1, 0.9], "value").select(F.round(F.col("q")[0], 6).alias("p10"), F.round(F.col("q")[1], 6).alias("p90"))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def stats_mode(t: Tables):
    return t.events.stats.modes("event_type")


@query("SELECT c_custkey, len(list_filter((SELECT [quantile_cont(c_acctbal, 0.25), quantile_cont(c_acctbal, 0.5), quantile_cont(c_acctbal, 0.75)] FROM customer), lambda q: q <= c_acctbal))::INTEGER AS bin FROM customer")
def quantile_cut(t: Tables):
    return t.customer.stats.quantile_cut(4, "c_acctbal").select(("c_custkey", "bin"))


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 9) AS x FROM customer")
def normalize(t: Tables):
    return t.customer.stats.normalize("c_acctbal").select(lambda r: {"c_custkey": r.c_custkey, "x": F.round(r.normalized, 9)})


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS x FROM customer")
def standardize(t: Tables):
    return t.customer.stats.standardize("c_acctbal").select(lambda r: {"c_custkey": r.c_custkey, "x": F.round(r.standardized, 6)})


@query("SELECT doc_id, n_chars FROM documents, (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents) WHERE n_chars < a - 1.5 * (b - a) OR n_chars > b + 1.5 * (b - a)")
def outliers_iqr(t: Tables):
    return t.documents.select(("doc_id", "n_chars")).stats.outliers_iqr("n_chars")


# terminals
@query("SELECT DISTINCT o_orderpriority FROM orders")
def to_set(t: Tables):
    return t.orders.select("o_orderpriority").df.distinct()


@query("SELECT o_custkey AS key, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1")
def to_dict(t: Tables):
    return t.orders.to.entries("o_custkey", "o_totalprice")


@query("SELECT count(*) AS n, count(*) FILTER (value > 50) AS big, bool_or(value > 99) AS some, bool_and(value >= 0) AS every FROM events")
def to_count_any_all(t: Tables):
    s = t.events
    return _one(t, n=s.to.count(), big=s.to.count(lambda r: r.value > 50), some=s.to.any(lambda r: r.value > 99), every=s.to.all(lambda r: r.value >= 0))


@query("SELECT event_id, event_type FROM events WHERE value > 50 ORDER BY event_id LIMIT 1")
def to_first(t: Tables):
    return t.events.select(("event_id", "event_type", "value")).to.first_df(lambda r: r.value > 50).select("event_id", "event_type")


@query("SELECT 'none' AS v")
def to_first_or_default(t: Tables):
    return _one(t, v=t.region.select("r_name").to.first_or_default(lambda r: r.r_name == "ATLANTIS", "none"))


@query("SELECT r_name AS v FROM region WHERE r_regionkey = 2")
def to_single(t: Tables):
    return _one(t, v=t.region.where(lambda r: r.r_regionkey == 2).select("r_name").to.single())


@query("SELECT sum(user_id)::BIGINT + 5 AS value FROM events")
def to_aggregate(t: Tables):
    return t.events.to.fold("sum", 5, selector="user_id")


@query("SELECT '>' || string_agg(r_name, '' ORDER BY r_regionkey) AS value FROM region")
def to_aggregate_ordered(t: Tables):
    return t.region.to.fold(lambda a, x: F.concat(a, x), ">", selector="r_name")


@query("SELECT length(string_agg(r_name, '' ORDER BY r_regionkey))::INTEGER AS value FROM region")
def to_aggregate_with_selector(t: Tables):
    return t.region.to.fold(lambda a, x: F.concat(a, x), "", lambda s: F.char_length(s), "r_name")


@query("SELECT event_id, value FROM events WHERE value > (SELECT avg(value) FROM events) + 1e-9")
def lazy_where(t: Tables):
    return t.events.select(("event_id", "value")).util.lazy_where(lambda r, c: r.value > c.mean + 1e-9, mean=F.avg("value"))



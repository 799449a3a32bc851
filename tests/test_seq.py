"""Literal cases, errors, and positions in several buckets."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ordinate import sources
from ordinate.plans import position, webpages
from ordinate.queries import QUERIES
from ordinate.seq import Seq
from ordinate.sources.generator import from_json, from_schema, infer_schema


@pytest.fixture(scope="module")
def ints(spark):
    return lambda *values: sources.from_iterable(spark, list(values), "bigint")


def test_sets(ints):
    a, b = ints(1, 2, 2, 3), ints(3, 4, 5, 5)
    assert a.set.union(b).to.list() == [1, 2, 3, 4, 5]
    assert a.set.intersect(b).to.list() == [3]
    assert a.set.except_(b).to.list() == [1, 2]
    assert a.set.concat(b).to.count() == 8
    assert a.set.symmetric_difference(b).to.list() == [1, 2, 4, 5]
    assert ints(1, 1, 2, 3).set.multiset_intersect(ints(1, 2, 2)).to.list() == [1, 2]
    assert ints(1, 1, 2, 3).set.except_by_count(ints(1, 2, 2)).to.list() == [1, 3]
    assert ints(3, 1, 3, 2).set.distinct().to.list() == [3, 1, 2]
    assert ints(1, 1, None).set.intersect(ints(1, None)).to.list() == [1, 1, None]


def test_set_relations(ints):
    assert ints(1, 2).set.is_subset_of(ints(1, 2, 3)) and ints(1, 2).set.is_proper_subset_of(ints(1, 2, 3))
    assert not ints(1, 2).set.is_proper_subset_of(ints(2, 1)) and ints(1, 2).set.is_superset_of(ints(2, 1))
    assert ints(1).set.is_disjoint_with(ints(2)) and ints().set.jaccard_similarity(ints()) == 1.0
    assert ints(1, 2).set.is_proper_superset_of(ints(1))


def test_slices_and_sorts(ints):
    s = ints(1, 2, 3, 4, 5)
    assert s.take(2).to.list() == [1, 2] and s.skip(3).to.list() == [4, 5]
    assert s.take(-2).to.list() == [1, 2, 3] and s.skip(-2).to.list() == [4, 5]
    assert s.take(0).to.list() == [] and s.reverse().to.list() == [5, 4, 3, 2, 1]
    assert ints(1, 2, 5, 1).take_while(lambda r: r.value < 3).to.list() == [1, 2]
    assert ints(1, 2, 5, 1).skip_while(lambda r: r.value < 3).to.list() == [5, 1]
    assert ints(3, 1, 2).order_by_descending("value").to.list() == [3, 2, 1]
    assert s.append(9).prepend(0).to.list() == [0, 1, 2, 3, 4, 5, 9]
    assert ints().default_if_empty(7).to.list() == [7] and s.default_if_empty(7).to.count() == 5


def test_key_search(ints):
    up = ints(10, 20, 30, 40, 50).order_by("value")
    assert up.between_keys(20, 40).to.list() == [20, 30, 40]
    down = ints(*range(1, 11)).order_by_descending("value")
    assert down.between_keys(7, 5).to.list() == [7, 6, 5] and down.between_keys(4, 8).to.list() == []
    assert down.find_by_key(5).to.list() == [5]
    with pytest.raises(ValueError):
        up.find_by_key(1, 2)
    with pytest.raises(TypeError):
        ints(1).then_by("value")
    with pytest.raises(ValueError):
        up.merge_with(down)
    assert up.merge_with(ints(20, 60).order_by("value")).to.list() == [10, 20, 20, 30, 40, 50, 60]


def test_groups(ints, spark):
    s = ints(1, 1, 2, 3, 3, 3, 2, 2, 1)
    assert [list(r["items"]) for r in s.group.batch_by("value").to.list()] == [[1, 1], [2], [3, 3, 3], [2, 2], [1]]
    assert ints(*range(1, 11)).group.chunk(3).to.list() == [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10]]
    assert ints(1, 2, 3, 4, 5).group.window(3).to.list() == [[1, 2, 3], [2, 3, 4], [3, 4, 5]]
    assert ints(1, 2).group.window(3).to.list() == [] and ints(1, 2).group.window(0).to.list() == [[], [], []]
    assert [tuple(r) for r in ints(1, 2, 3).group.pairwise().to.list()] == [(1, 2), (2, 3)]
    for size in (0, -1):
        with pytest.raises(ValueError):
            s.group.chunk(size)
    yes, no = ints(1, None, 3).group.partition(lambda r: r.value > 2)
    assert yes.to.list() == [3] and no.to.list() == [1, None]
    assert [tuple(r) for r in s.util.run_length_encode().to.list()] == [(1, 2), (2, 1), (3, 3), (2, 2), (1, 1)]
    assert ints().group.group_by("value").to.count() == 0
    sales = sources.from_iterable(spark, [("2023", "A", 100), ("2023", "B", 150), ("2023", "A", 50), ("2024", "A", 120), ("2024", "B", 200)], "year string, product string, sales long")
    cells = {(r[0], r[1]): r[2] for r in sales.group.pivot("year", "product", lambda r: F.sum(r.sales)).to.list()}
    assert cells == {("2023", "A"): 150, ("2023", "B"): 150, ("2024", "A"): 120, ("2024", "B"): 200}


def test_joins(spark):
    users = sources.from_iterable(spark, [(1, "A"), (2, "B"), (3, "C")], "id long, name string")
    posts = sources.from_iterable(spark, [(101, 1), (102, 1), (103, 2), (104, 4)], "post long, user long")
    pick = lambda u, p: {"name": u.name, "post": p.post}
    assert [tuple(r) for r in users.join.join(posts, "id", "user", pick).to.list()] == [("A", 101), ("A", 102), ("B", 103)]
    assert [tuple(r) for r in users.join.left_join(posts, "id", "user", pick, {"post": 999}).to.list()][-1] == ("C", 999)
    assert [tuple(r) for r in users.join.right_join(posts, "id", "user", pick, {"name": "?"}).to.list()][-1] == ("?", 104)
    assert [tuple(r) for r in users.join.full_outer_join(posts, "id", "user", pick).to.list()] == [("A", 101), ("A", 102), ("B", 103), ("C", None), (None, 104)]
    grouped = users.join.group_join(posts, "id", "user", lambda u, g: {"name": u.name, "n": F.size(g["items"])})
    assert [tuple(r) for r in grouped.to.list()] == [("A", 2), ("B", 1), ("C", 0)]


def test_stats(ints):
    s = ints(*range(1, 11))
    assert s.stats.median() == 5.5 and s.stats.percentile(100) == 10 and s.stats.sum() == 55 and s.stats.average() == 5.5
    ranks = ints(10, 30, 20, 30, 40)
    assert [r["rank"] for r in ranks.stats.rank().to.list()] == [1, 3, 2, 3, 5]
    assert [r["rank"] for r in ranks.stats.rank(ascending=False).to.list()] == [5, 2, 4, 2, 1]
    assert [r["dense_rank"] for r in ranks.stats.dense_rank().to.list()] == [1, 3, 2, 3, 4]
    assert [r["lag"] for r in s.stats.lag(2).to.list()] == [None, None, *range(1, 9)] and len(s.stats.lag(20).to.list()) == 10
    assert ints(1, 2, 3, 4, 5).stats.scan("sum", 0).to.list() == [0, 1, 3, 6, 10, 15]
    assert [r["cumulative_product"] for r in ints(1, 2, 3, 4).stats.cumulative_product().to.list()] == [1, 2, 6, 24]
    assert ints(*range(1, 10), 100).stats.outliers_iqr().to.list() == [100]
    assert [r["normalized"] for r in ints(5, 5).stats.normalize().to.list()] == [0, 0]
    assert ints(2, 1, 2, 1, 3).stats.mode() == 1 and ints().stats.sum() == 0
    for bad in (lambda: ints().stats.average(), lambda: ints().stats.median(), lambda: ints().stats.mode(), lambda: s.stats.percentile(101)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError, match="non-numeric"):
        s.select(lambda r: r.value.cast("string")).stats.sum()


def test_combinatorics(ints):
    s = ints(1, 2, 3)
    assert s.comb.permutations(0).to.list() == [[]] and s.comb.permutations(4).to.list() == [] and s.comb.permutations(-1).to.list() == []
    assert s.comb.permutations().to.count() == 6 and ints(1, 1).comb.permutations(2).to.list() == [[1, 1], [1, 1]]
    assert s.comb.combinations(2).to.list() == [[1, 2], [1, 3], [2, 3]]
    assert s.comb.power_set().to.list() == [[], [1], [2], [3], [1, 2], [1, 3], [2, 3], [1, 2, 3]] and ints().comb.power_set().to.list() == [[]]
    assert s.comb.binomial_coefficient(2) == 3 and s.comb.binomial_coefficient(9) == 0
    assert s.comb.cartesian_product(ints(), s).to.list() == []


def test_utility(ints, spark):
    s = ints(1, 2, 3)
    assert s.util.intersperse(0).to.list() == [1, 0, 2, 0, 3] and ints(1).util.intersperse(0).to.list() == [1]
    assert s.util.apply_functions([lambda r: r.value * 2, lambda r: r.value + 10]).to.list() == [2, 11, 4, 12, 6, 13]
    assert ints(1, 2, 3, 4, 5).util.lazy_where(lambda r, c: r.value > c.mean, mean=F.avg("value")).to.list() == [4, 5]
    text = sources.from_iterable(spark, ["1.5", "x", "2.7"], "string")
    assert text.util.parse_or_default(lambda r: r.value.try_cast("double"), 0.0).to.list() == [1.5, 0.0, 2.7]
    good, bad = text.util.try_parse(lambda r: r.value.try_cast("double"))
    assert good.to.list() == [1.5, 2.7] and bad.to.list() == ["x"]
    kept = s.util.memoize_advanced()
    assert kept[1] == (2,) and kept[-1] == (3,) and len(kept) == 3 and [r[0] for r in kept] == [1, 2, 3]
    rows = sources.from_iterable(spark, [([1, 2],), ([3],)], "items array<bigint>")
    assert rows.util.transpose("items").to.list() == [[1, 3], [2, None]]
    assert ints(3).util.unfold("value", lambda x: F.when(x < 5, x + 1)).to.list() == [3, 4, 5]
    tasks = sources.from_iterable(spark, [("D", ["B", "C"]), ("B", ["A"]), ("C", ["A", "?"]), ("A", [])], "id string, needs array<string>")
    assert [r[0] for r in tasks.util.topological_sort("id", "needs").to.list()] == ["A", "B", "C", "D"]
    loop = sources.from_iterable(spark, [("X", ["Y"]), ("Y", ["X"])], "id string, needs array<string>")
    with pytest.raises(ValueError, match="cycle"):
        loop.util.topological_sort("id", "needs")
    assert s.util.sample(2, seed=1).to.list() == s.util.sample(2, seed=1).to.list() and s.util.sample(9).to.count() == 3
    assert ints().util.sample(3, replace=True).to.list() == []


def test_trees(spark):
    flat = sources.from_iterable(spark, [(1, None), (2, 1), (3, 1), (4, 2), (9, 8)], "id long, parent long")
    assert [r[0] for r in flat.tree.recursive_select("id", "parent").to.list()] == [1, 2, 4, 3]
    assert [r[0] for r in flat.tree.recursive_select("id", "parent", include_parents=False).to.list()] == [2, 4, 3]
    assert flat.tree.reduce_tree("id", "parent", lambda r, d: F.max(d)) == 2
    sums = {r["id"]: r["value"] for r in flat.tree.select_recursive("id", "parent", "id", lambda r, of: r.id + of(F.sum)).to.list()}
    assert sums == {1: 10, 2: 6, 3: 3, 4: 4}
    assert sources.recursive_generator(spark, 1, lambda v: F.array(v * 2, v * 2 + 1), 3).to.list() == [1, 2, 3, 4, 5, 6, 7]
    loop = sources.from_iterable(spark, [(1, None), (2, 1)], "id long, parent long")
    assert loop.tree.build_tree("id", "parent").to.count() == 2


def test_terminals(ints):
    s = ints(1, 2, 3)
    assert s.to.first() == 1 and s.to.first_or_default(lambda r: r.value > 9, -1) == -1 and s.to.single(lambda r: r.value == 2) == 2
    assert s.to.any() and not ints().to.any() and ints().to.all(lambda r: r.value > 9) and s.to.set() == {1, 2, 3}
    assert s.to.dict(lambda r: r.value % 2) == {0: 2, 1: 3} and s.to.array().tolist() == [1, 2, 3]
    assert s.to.aggregate(lambda a, x: a * 10 + x) == 123 and s.to.aggregate_with_selector(0, lambda a, x: a + x, lambda v: v * 2) == 12
    for bad, text in ((lambda: ints().to.first(), "no elements"), (lambda: s.to.first(lambda r: r.value > 9), "no element satisfies"), (lambda: s.to.single(), "more than one"), (lambda: ints().to.aggregate("sum"), "empty sequence")):
        with pytest.raises(ValueError, match=text):
            bad()
    with pytest.raises(TypeError):
        len(s)


@pytest.mark.parametrize("size", [1, 7, 50])
def test_buckets_change_nothing(spark, monkeypatch, size):
    values = [random.Random(5).choice([None, 1, 2, 3, 9]) for _ in range(40)] + list(range(20))
    s = sources.from_iterable(spark, values, "bigint")
    seen = lambda: [[tuple(r) for r in q.to.list()] for q in (s.stats.lag(3), s.stats.cumulative_sum(), s.stats.rank(), s.util.run_length_encode(), s.order_by_descending("value").select_with_index())]
    whole = seen()
    monkeypatch.setattr(position, "ROWS_PER_BUCKET", size)
    assert seen() == whole


def test_positions_of_few_values_are_spread(spark):
    """Three values, falling: partitions are bounded by all keys, and none holds more than twice its share."""
    s = Seq.of(spark.range(40_000).selectExpr("id", "cast(id % 3 as int) AS flag"), ("id",)).order_by_descending("flag")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or these few rows are one partition
    kept = position.numbered(s._df, s.keys, "m")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in kept.groupBy(F.shiftright("m", position.LOCAL_BITS)).count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * 40_000 / len(sizes)
    found = s.indexed("at").orderBy("at").collect()
    assert [r["at"] for r in found] == list(range(40_000)) and [(r["flag"], r["id"]) for r in found] == sorted(((k % 3, k) for k in range(40_000)), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("most", [100_000, 0])
def test_skip_brings_no_rows_together(spark, monkeypatch, most):
    from ordinate.operators import core

    monkeypatch.setattr(core, "MOST_BY_BOUND", most)
    s = Seq.of(spark.range(3000).withColumn("k", F.when(F.col("id") % 7 > 0, F.col("id") % 7)), ("id",)).order_by("k")
    order = sorted(range(3000), key=lambda x: (x % 7, x))
    ids = lambda q: [r["id"] for r in q.to.list()]
    assert ids(s.skip(25)) == order[25:] and ids(s.take(-25)) == order[:-25] and ids(s.skip(2999)) == order[2999:] and ids(s.skip(3000)) == ids(s.skip(5000)) == [] and ids(s.skip(20).take(10)) == order[20:30]
    plan = s.skip(25)._df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Offset" not in plan and "CollectLimit" not in plan
    if not most:
        assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_positions_are_made_once(spark, monkeypatch):
    made = []
    real = position.numbered
    monkeypatch.setattr(position, "numbered", lambda *a: made.append(1) or real(*a))
    s = Seq.of(spark.range(50), ("id",)).stats.lag(1, selector="id").stats.cumulative_sum("id").select_with_index()
    assert [r["index"] for r in s.to.list()] == list(range(50)) and len(made) == 1


def test_no_limits_on_depth_and_steps(spark):
    s = sources.from_iterable(spark, [0, 450, 995], "bigint")
    found = s.util.unfold("value", lambda x: F.when(x < 1000, x + 1)).to.list()
    assert [r for r in found] == [*range(0, 1001), *range(450, 1001), *range(995, 1001)]
    with pytest.raises(ValueError):
        s.util.unfold("value", lambda x: x + 1, most=300)
    one = sources.from_iterable(spark, [1], "bigint")
    assert one.util.flatten_deep(lambda r: F.array(F.array(F.array(r.value)))).to.list() == [1]


def test_effects_happen(spark, tmp_path):
    from pyspark.sql import Observation

    s, seen = sources.from_iterable(spark, [3, 1, 2], "bigint"), Observation("seen")
    assert s.util.side_effect(seen, n=F.count(F.lit(1)), most=F.max("value")).df.count() == 3 and seen.get == {"n": 3, "most": 3}
    folder = str(tmp_path)
    s.util.for_each(lambda row: open(f"{folder}/{row.value}", "w").close())
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1", "2", "3"]
    kept = s.util.memoize()
    assert kept._df.is_cached and kept.to.list() == kept.to.list() == [3, 1, 2]
    kept._df.unpersist()


def test_terminals_of_whole_rows(spark):
    s = Seq.of(spark.createDataFrame([(2, "b"), (1, None)], "id long, s string"), ("id",))
    frame = s.to.df()
    assert list(frame["id"]) == [1, 2] and list(frame.columns) == ["id", "s"] and list(s.to.pandas()) == [1, 2]
    assert [tuple(r) for r in s.to.list()] == [(1, None), (2, "b")] == [tuple(r) for r in s.to.array()]


def test_order_is_required(spark):
    s = Seq.of(spark.range(3))
    assert s.where(lambda r: r.id > 0).to.count() == 2
    with pytest.raises(ValueError, match="order"):
        s.take(1)


def test_generator(spark):
    schema = {"n": ("pyint", {"min_value": 1, "max_value": 3}), "tags": [{"_qen_items": {"w": "word"}, "_qen_count": (0, 2)}], "who": {"_qen_provider": "ref", "key": "n", "format": "u{}"}, "twice": {"_qen_provider": "lambda", "func": lambda r: r.n * 2}}
    rows = from_schema(spark, schema, 7).take(50).to.list()
    assert rows == from_schema(spark, schema, 7).take(50).to.list() and rows != from_schema(spark, schema, 8).take(50).to.list()
    assert all(1 <= r["n"] <= 3 and len(r["tags"]) <= 2 and r["who"] == f"u{r['n']}" and r["twice"] == 2 * r["n"] for r in rows)
    assert {len(r["tags"]) for r in rows} == {0, 1, 2}
    assert infer_schema({"id": 5, "user_name": "x y", "ok": True, "mail": "a@b.c", "list": ["w"]}) == {
        "id": ("pyint", {"min_value": 0, "max_value": 10}), "user_name": "name", "ok": {"_qen_provider": "choice", "from": [True, False]}, "mail": "email", "list": [{"_qen_items": "word", "_qen_count": 1}],
    }
    assert from_json(spark, '[{"a": 1, "b": [{"c": "x"}]}]', 1).take(2).to.count() == 2
    with pytest.raises(ValueError):
        from_schema(spark, {"a": {"_qen_provider": "ref", "key": "zz"}}).take(1)


def test_stream(spark, tmp_path):
    from ordinate.streaming import from_stream, keyed_windows

    source = spark.createDataFrame([("2024-01-01 00:00:01", "a", 1), ("2024-01-01 00:00:31", "a", 2), ("2024-01-01 00:01:01", "b", 3)], "ts string, k string, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    seq = from_stream(stream).where(lambda r: r.v > 0)
    with pytest.raises(ValueError, match="stream"):
        seq.take(1)
    out = keyed_windows(seq.df, "ts", "1 minute", "1 minute", ("k",), total=F.sum("v"))
    running = out.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    running.processAllAvailable()
    running.stop()
    assert {(r["k"], r["total"]) for r in spark.sql("SELECT * FROM windows").collect()} == {("a", 3), ("b", 3)}


def test_crawl_follows_links_until_none_is_new(spark):
    pages = spark.range(24).selectExpr("id AS page_id", "concat('http://a.org/', id) AS url").coalesce(1)
    links = spark.range(23).selectExpr("id AS page_id", "concat('http://a.org/', id + 1) AS link").coalesce(1)
    assert webpages.crawl(pages, links, ["http://a.org/0"]).agg(F.max("round")).first()[0] == 23


def test_every_matching_element_gives_its_data_items(spark):
    html = "<html><head><title>Shop</title></head><body><ul>" + "".join(f"<li class=x><b>n{k}</b><i>p{k}</i></li>" for k in range(13)) + "</ul></body></html>"
    every = webpages.elements(spark.createDataFrame([(1, html), (2, None), (3, "<p>x")], "page_id long, html string"))
    rows = webpages.with_signature(webpages.body_elements(every))
    dominant = spark.createDataFrame([(1, rows.where("tag = 'li'").first()["signature"])], "page_id long, signature string")
    items = webpages.data_items(rows, dominant, webpages.fields(rows, dominant)).orderBy("node").collect()
    assert [r["items"] for r in items] == [{"li.x": f"n{k}p{k}", "li.x.b": f"n{k}", "li.x.i": f"p{k}"} for k in range(13)]
    assert [tuple(r) for r in webpages.titles(every).collect()] == [(1, "Shop")]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_groups_with_aggregates_move_no_rows(spark):
    """Groups by several keys add up before the exchange, without arrays of whole groups or positions of all rows."""
    rows = spark.createDataFrame([(k, k % 2, k % 3 if k % 5 else None, "x" * 1000) for k in range(60)], "id long, a long, b long, long string")
    s = Seq.of(rows, ("id",))
    made = s.group.group_by_multiple("a", lambda r: r.b, n=lambda r: F.count("*"), first=lambda r: F.min(r.id))
    whole = s.group.group_by_multiple("a", lambda r: r.b).to.list()
    assert [tuple(r) for r in made.to.list()] == [(r["a"], r["key2"], len(r["items"]), r["items"][0]["id"]) for r in whole]
    assert [tuple(r) for r in s.group.group_by_nested("a", "b", n=lambda r: F.count("*")).to.list()] == [(r["a"], r["key2"], len(r["items"])) for r in whole]
    assert s.group.group_by_multiple(n=lambda r: F.count("*")).to.list() == [60] and s.where(lambda r: r.id < 0).group.group_by_multiple(n=lambda r: F.count("*")).to.list() == []
    for name in ("group_by_multiple", "group_by_nested"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "ExistingRDD" not in plan

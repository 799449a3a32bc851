"""Combinatorics, structure, sampling, parsing, trees and the page pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordinate import sources
from ordinate.plans import webpages
from ordinate.queries.base import Tables, query


def _ids(t: Tables):
    return t.region.select(lambda r: {"k": r.r_regionkey})


def _joined(s):
    return s.select(lambda r: {"ids": F.array_join(r["items"].cast("array<string>"), ",")})


@query("SELECT 10::BIGINT AS v")
def binomial_coefficient(t: Tables):
    return t.spark.createDataFrame([(t.region.comb.binomial_coefficient(2),)], "v long")


@query("SELECT a.r_regionkey || ',' || b.r_regionkey || ',' || c.r_regionkey AS ids FROM region a, region b, region c WHERE a.r_regionkey <> b.r_regionkey AND a.r_regionkey <> c.r_regionkey AND b.r_regionkey <> c.r_regionkey")
def permutations(t: Tables):
    return _joined(_ids(t).comb.permutations(3))


@query("SELECT a.r_regionkey || ',' || b.r_regionkey AS ids FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def combinations(t: Tables):
    return _joined(_ids(t).comb.combinations(2))


@query("SELECT a.r_regionkey || ',' || b.r_regionkey AS ids FROM region a JOIN region b ON a.r_regionkey <= b.r_regionkey")
def combinations_with_replacement(t: Tables):
    return _joined(_ids(t).comb.combinations_with_replacement(2))


@query("SELECT coalesce((SELECT string_agg(r_regionkey::VARCHAR, ',' ORDER BY r_regionkey) FROM region WHERE (m >> r_regionkey) & 1 = 1), '') AS ids FROM (SELECT range AS m FROM range(32))")
def power_set(t: Tables):
    return _joined(_ids(t).comb.power_set())


@query("SELECT a.r_name AS a, b.r_name AS b, n_name AS c FROM region a, region b, nation")
def cartesian_product(t: Tables):
    names = t.region.select("r_name")
    return names.comb.cartesian_product(names, t.nation.select("n_name")).select(lambda r: {"a": r.item1, "b": r.item2, "c": r.item3})


# structure
@query("SELECT vec_id, i - 1 AS place, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i)")
def flatten(t: Tables):
    s = t.embeddings.select_many(lambda r: F.transform(r.embedding, lambda x, i: F.struct(r.vec_id.alias("vec_id"), i.cast("long").alias("place"), x.cast("double").alias("v"))))
    return s


@query("SELECT unnest([n_nationkey, n_regionkey, n_nationkey, 7]) AS value FROM nation")
def flatten_deep(t: Tables):
    return t.nation.util.flatten_deep(lambda r: {"value": F.array(F.array(F.array(r.n_nationkey, r.n_regionkey)), F.array(F.array(r.n_nationkey, F.lit(7))))})


@query("SELECT string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS ids FROM nation UNION ALL SELECT string_agg(n_regionkey::VARCHAR, ',' ORDER BY n_nationkey) FROM nation")
def transpose(t: Tables):
    return t.nation.util.transpose(lambda r: F.array(r.n_nationkey, r.n_regionkey)).select(lambda r: {"ids": F.array_join(r["items"].cast("array<string>"), ",")})


@query("SELECT n_name AS value FROM nation UNION ALL SELECT n_regionkey::VARCHAR FROM nation")
def unzip(t: Tables):
    a, b = t.nation.select(("n_name", "n_regionkey")).util.unzip()
    return a.df.union(b.df.select(F.col("value").cast("string")))


@query("SELECT unnest(range(r_regionkey, 6)) AS value FROM region")
def unfold(t: Tables):
    return t.region.util.unfold(lambda r: r.r_regionkey.cast("long"), lambda x: F.when(x < 5, x + 1), most=20)


@query("SELECT unnest([r_regionkey * 2, r_regionkey + 10]) AS value FROM region")
def apply_functions(t: Tables):
    return t.region.util.apply_functions([lambda r: r.r_regionkey * 2, lambda r: r.r_regionkey + 10])


@query("SELECT event_id, value FROM events WHERE value > 50 ORDER BY event_id LIMIT 10")
def pipe_through(t: Tables):
    return t.events.select(("event_id", "value")).util.pipe_through(lambda s: s.where(lambda r: r.value > 50), lambda s: s.take(10))


@query("SELECT event_id FROM events WHERE value > 50 ORDER BY event_id DESC LIMIT 5")
def compose(t: Tables):
    return t.events.select(("event_id", "value")).util.compose(lambda s: s.where(lambda r: r.value > 50), lambda s: s.reverse(), lambda s: s.take(5), lambda s: s.select("event_id"))


@query("SELECT r_name FROM region ORDER BY r_regionkey LIMIT 3")
def pipe(t: Tables):
    return t.region.select("r_name").util.pipe(lambda s, n: s.take(n), 3)


@query("SELECT r_name FROM region ORDER BY r_regionkey LIMIT 2")
def apply_if(t: Tables):
    return t.region.select("r_name").util.apply_if(True, lambda s: s.take(2)).util.apply_if(False, lambda s: s.take(1))


@query("SELECT r_name FROM region ORDER BY r_regionkey DESC LIMIT 1")
def apply_when(t: Tables):
    return t.region.select("r_name").util.apply_when(lambda s: s.to.count() > 3, lambda s: s.reverse().take(1))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events")
def try_parse(t: Tables):
    parse = lambda r: F.get_json_object(r.props, "$.k").try_cast("bigint")
    good, bad = t.events.util.try_parse(lambda r: F.when(parse(r).isNotNull(), F.struct(r.event_id.alias("event_id"), parse(r).alias("v"))))
    return good.df.select("value.event_id", "value.v").union(bad.df.select("event_id", F.lit(None).cast("bigint")))


@query("SELECT coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS value FROM events")
def parse_or_default(t: Tables):
    return t.events.util.parse_or_default(lambda r: F.get_json_object(r.props, "$.k").try_cast("bigint"), -1)


# sampling: rows by a stated seed
def _uniform(*values: str) -> str:
    return f"('0x' || substr(md5('3' || {' || '.join(f"':' || {v}" for v in values)}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


_DRAWN = f"""numbered AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events),
drawn AS (SELECT range AS k, floor({_uniform("range")} * (SELECT count(*) FROM events))::BIGINT AS place FROM range({{}}))"""


@query(f"SELECT * FROM events ORDER BY {_uniform('event_id')}, event_id LIMIT 100")
def sample(t: Tables):
    return t.events.util.sample(100, seed=3)


@query(f"WITH {_DRAWN.format(100)} SELECT event_id, ts, user_id, event_type, value, props FROM drawn JOIN numbered USING (place)")
def sample_with_replacement(t: Tables):
    return t.events.util.sample(100, replace=True, seed=3)


@query(f"SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_uniform('event_id')}, event_id) <= 5")
def stratified_sample(t: Tables):
    return t.events.util.stratified_sample("event_type", 5, seed=3)


@query(f"WITH {_DRAWN.format(1000)} SELECT k // 50 AS sample_id, event_id, value FROM drawn JOIN numbered USING (place)")
def bootstrap_sample(t: Tables):
    return t.events.select(("event_id", "value")).util.bootstrap_sample(20, 50, seed=3)


@query("SELECT event_id FROM events WHERE value > 50")
def memoize(t: Tables):
    return t.events.where(lambda r: r.value > 50).select("event_id").util.memoize()


@query("SELECT r_name FROM region")
def memoize_advanced(t: Tables):
    kept = t.region.select("r_name").util.memoize_advanced()
    return t.spark.createDataFrame([tuple(r) for r in kept[:3]] + [tuple(r) for r in kept[3:]], "r_name string")


@query("SELECT event_id FROM events")
def side_effect(t: Tables):
    return t.events.select("event_id").util.side_effect("seen", n=F.count(F.lit(1)))


@query("SELECT r_name FROM region")
def for_each(t: Tables):
    return t.region.select("r_name").util.for_each(lambda row: None)


# hierarchy: world > regions > nations
def _world(t: Tables):
    root = t.spark.createDataFrame([("w", None, "WORLD")], "id string, parent string, name string")
    regions = t.region.df.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("w").alias("parent"), F.col("r_name").alias("name"))
    nations = t.nation.df.select(F.concat(F.lit("n"), F.format_string("%02d", "n_nationkey")).alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    from ordinate.seq import Seq

    return Seq.of(root.union(regions).union(nations), ("id",))


_WORLD = """world AS (SELECT 'w' AS id, NULL AS parent, 'WORLD' AS name UNION ALL SELECT 'r' || r_regionkey, 'w', r_name FROM region UNION ALL SELECT 'n' || lpad(n_nationkey::VARCHAR, 2, '0'), 'r' || n_regionkey, n_name FROM nation),
walk AS (SELECT id, name, parent, 0 AS depth, id AS path FROM world WHERE parent IS NULL UNION ALL SELECT x.id, x.name, x.parent, depth + 1, path || '/' || x.id FROM world x JOIN walk ON x.parent = walk.id)"""


@query(f"WITH RECURSIVE {_WORLD} SELECT id, depth, path, row_number() OVER (ORDER BY path) - 1 AS index FROM walk")
def traverse_with_path(t: Tables):
    s = _world(t).tree.traverse_with_path("id", "parent")
    return s.select(lambda r: {"id": r.id, "depth": r.depth, "path": F.array_join(r.path, "/")}).indexed()


@query(f"WITH RECURSIVE {_WORLD} SELECT id, row_number() OVER (ORDER BY path) - 1 AS index FROM walk WHERE depth > 0")
def recursive_select(t: Tables):
    return _world(t).tree.recursive_select("id", "parent", include_parents=False).select("id").indexed()


@query(f"WITH RECURSIVE {_WORLD} SELECT id FROM walk WHERE name LIKE 'A%'")
def recursive_where(t: Tables):
    return _world(t).tree.recursive_where("id", "parent", lambda r: r.name.startswith("A")).select("id")


@query(f"WITH RECURSIVE {_WORLD} SELECT unnest([id, name]) AS value FROM walk")
def recursive_select_many(t: Tables):
    return _world(t).tree.recursive_select_many("id", "parent", lambda r: F.array(r.id, r.name))


@query(f"WITH RECURSIVE {_WORLD} SELECT a.id, count(*) FILTER (b.depth = 2 OR b.id NOT IN (SELECT parent FROM world WHERE parent IS NOT NULL)) AS value FROM walk a JOIN walk b ON b.path = a.path OR starts_with(b.path, a.path || '/') GROUP BY a.id")
def select_recursive(t: Tables):
    return _world(t).tree.select_recursive("id", "parent", lambda r: F.lit(1).cast("long"), lambda r, of: of(F.sum)).select(("id", "value"))


@query(f"WITH RECURSIVE {_WORLD} SELECT sum(depth * 100 + length(name))::BIGINT AS v FROM walk")
def reduce_tree(t: Tables):
    v = _world(t).tree.reduce_tree("id", "parent", lambda r, depth: F.sum(depth * 100 + F.char_length(r.name)))
    return t.spark.createDataFrame([(v,)], "v long")


@query(f"WITH RECURSIVE {_WORLD} SELECT id, depth, path, (SELECT count(*) FROM world c WHERE c.parent = walk.id) AS n_children FROM walk")
def build_tree(t: Tables):
    return _world(t).tree.build_tree("id", "parent").select(lambda r: {"id": r.id, "depth": r.depth, "path": F.array_join(r.path, "/"), "n_children": r.n_children})


@query(f"WITH RECURSIVE {_WORLD} SELECT id, depth, path FROM walk")
def create_tree_from_flat(t: Tables):
    return sources.create_tree_from_flat(_world(t), "id", "parent").select(lambda r: {"id": r.id, "depth": r.depth, "path": F.array_join(r.path, "/")})


@query("""
WITH RECURSIVE world AS (SELECT 'w' AS id, NULL AS parent, 'WORLD' AS name UNION ALL SELECT 'r' || r_regionkey, 'w', r_name FROM region UNION ALL SELECT 'n' || lpad(n_nationkey::VARCHAR, 2, '0'), 'r' || n_regionkey, n_name FROM nation),
walk AS (SELECT id, name, 0 AS depth, name[1:1] AS path FROM world WHERE parent IS NULL UNION ALL SELECT x.id, x.name, depth + 1, path || '/' || x.name[1:1] FROM world x JOIN walk ON x.parent = walk.id)
SELECT path, count(*) AS n FROM walk GROUP BY 1""")
def group_by_recursive(t: Tables):
    s = _world(t).tree.group_by_recursive("id", "parent", lambda r: F.substring(r.name, 1, 1))
    return s.select(lambda r: {"path": F.array_join(r.key_path, "/"), "n": r.n})


@query("""
WITH RECURSIVE walk AS (SELECT 1 AS k, 0 AS level UNION ALL SELECT x.k, level + 1 FROM (SELECT range AS k FROM range(2, 101)) x JOIN walk ON x.k // 2 = walk.k)
SELECT k, level FROM walk""")
def topological_sort(t: Tables):
    s = sources.from_range(t.spark, 1, 100).select(lambda r: {"k": r.value})
    return s.util.topological_sort("k", lambda r: F.when(r.k > 1, F.array(F.floor(r.k / 2))).otherwise(F.array().cast("array<bigint>"))).select(lambda r: {"k": r.k, "level": r.level})


# pages
@query()
def web_elements(t: Tables):
    return webpages.page_elements(t.pages.df)


@query()
def web_patterns(t: Tables):
    return webpages.page_patterns(t.pages.df)


@query()
def web_classify(t: Tables):
    return webpages.page_kinds(t.pages.df)


@query()
def web_fields(t: Tables):
    return webpages.page_fields(t.pages.df)


@query()
def web_items(t: Tables):
    return webpages.page_items(t.pages.df)


@query()
def web_extracted_data(t: Tables):
    return webpages.page_extracted(t.pages.df)


# these pages' titles and links are plain enough for patterns
def _unescaped(text: str) -> str:
    for entity, number in (("&amp;", 1), ("&amp", 1), ("&lt;", 60), ("&gt;", 62), ("&quot;", 34), ("&#x27;", 39)):
        text = f"replace({text}, '{entity}', chr({number}))"
    return f"replace({text}, chr(1), '&')"


@query(f"SELECT page_id, trim({_unescaped("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title, NULL::VARCHAR AS description FROM pages WHERE html LIKE '%<title>%'")
def web_titles(t: Tables):
    return webpages.page_titles(t.pages.df)


@query(f"""
SELECT DISTINCT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || {_unescaped("href")} AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<a href="([^"]*)"', 1)) AS href FROM pages) WHERE href LIKE '/%'""")
def web_links(t: Tables):
    return webpages.page_links(t.pages.df)


@query()
def web_summary(t: Tables):
    return webpages.summed(webpages.page_overview(t.pages.df))


@query()
def web_overall(t: Tables):
    return webpages.overall_of(webpages.page_overview(t.pages.df))


@query()
def web_crawl(t: Tables):
    """From the first page of each host, as far as links between the table's pages lead."""
    first = t.pages.df.where("url is not null").groupBy(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)).agg(F.min("url").alias("url"))
    return webpages.crawl(t.pages.df, webpages.page_links(t.pages.df), first.select("url"), budget=None)

"""The page pipeline against plain Python over trees of the same pages."""

import random
import re
import statistics
import time
from html.parser import HTMLParser
from pathlib import Path
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from ordinate.plans import webpages
from ordinate.queries import QUERIES
from ordinate.seq import Seq
from ordinate.sources import files

SF = Path("/root/testdata/sf0.001")
#: Queries that need no shuffle of elements.
PAGE_BY_PAGE = ["web_classify", "web_elements", "web_extracted_data", "web_fields", "web_items", "web_links", "web_overall", "web_patterns", "web_summary", "web_titles"]
VOID = set("area base br col embed hr img input link meta source track wbr".split())


class Tree(HTMLParser):
    """Nested dicts; text is a string among the children."""

    def __init__(self):
        super().__init__()
        self.top = {"tag": "", "attrs": {}, "children": []}
        self.open = [self.top]

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "attrs": dict(attrs), "children": []}
        self.open[-1]["children"].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k]["tag"] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if len(self.open) > 1 and data.strip():
            self.open[-1]["children"].append(data.strip())


def text(node):
    return "".join(c if isinstance(c, str) else text(c) for c in node["children"])


def kids(node):
    return [c for c in node["children"] if not isinstance(c, str)]


def classes(node):
    return (node["attrs"].get("class") or "").split()


def walk(node, depth=0):
    yield node, depth
    for c in kids(node):
        yield from walk(c, depth + 1)


def signature(node):
    link = node["tag"] == "a" and "href" in node["attrs"]
    return f"{node['tag']}|{'.'.join(sorted(classes(node))[:3])}|{','.join(sorted({c['tag'] for c in kids(node)}))}|{'T' if text(node) else 'N'}{'L' if link else 'N'}{min(len(node['children']), 10)}"


def explored(html):
    """(elements with depths, repeating patterns, type, confidence, dominant signature, fields) of a page."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    every = [n for n, _ in walk(tree.top)][1:]
    body = next((n for n in every if n["tag"] == "body"), None)
    rows = list(walk(body)) if body else [(n, d - 1) for n, d in walk(tree.top)][1:]
    groups = {}
    for n, d in rows:
        groups.setdefault(signature(n), []).append((n, d))
    found = {s: (len(g), statistics.pstdev(d for _, d in g), sum(n["tag"] == "a" and "href" in n["attrs"] for n, _ in g)) for s, g in groups.items() if len(g) >= 3}
    if not found:
        return every, rows, found, "simple", 0.3, None, {}
    best = max(found, key=lambda s: found[s][0] * (1 + 1 / (1 + found[s][1])))  # the first of equal ones
    n, spread, links = found[best]
    kind, sure = ("list", 0.9) if n >= 10 and links and spread < 1 else ("directory", 0.8) if n >= 5 and links else ("content_list", 0.7) if n >= 8 and not links else ("structured", 0.6) if spread < 1 else ("detail", 0.4)
    if kind in ("list", "directory", "content_list"):
        words = set(" ".join(text(n) for n, _ in rows).lower().split())
        score = {k: len(words & set(ws)) for k, ws in webpages.KEYWORDS.items()}
        top = max(score, key=score.get)
        if score[top] > 2:
            kind, sure = f"{top}_{kind}", min(0.95, sure + 0.1)
    paths = {}

    def collect(node, path):
        here = ".".join([*([path] if path else []), node["tag"], *classes(node)[:2]])
        if text(node) and not any(text(c) == text(node) for c in kids(node)):
            paths.setdefault(here, []).append(text(node))
        for c in kids(node):
            collect(c, here)

    sample = [n for n, _ in groups[best]][:10]
    for n in sample:
        collect(n, "")
    return every, rows, found, kind, sure, best, {p: len(v) / len(sample) for p, v in paths.items() if len(v) >= len(sample) * 0.5}


def follow(node, path):
    for part in path.strip(".").split("."):
        node = next((c for c in kids(node) if c["tag"] == part or part in classes(c)), None)
        if node is None:
            return None
    return text(node)


@pytest.fixture(scope="module")
def pages(spark):
    odd = [
        (900001, "http://a.org/x/y.html", "<html><head><title> T </title><meta name=description content='about'></head><body><ul>" + "".join(f"<li class='x y z'><a href='../p{k}'>n{k}</a><b>price{k}</b></li>" for k in range(12)) + "<p>price cart add sku</p></ul></body></html>"),
        (900002, "http://a.org/", None), (900003, None, "<p>x<p>y<a href=/q>l</a>"), (900004, "http://b.org/d/", ""), (900005, "http://b.org/d/e?f#g", "<div><a href='?x=1'>a</a><a href='//b.org/z'>b</a><a href='mailto:x'>c</a><a href='http://c.org/'>d</a><a href='#t'>e</a><a href='http://[bad'>f</a></div>"),
        (900006, "http://a.org/n", "<div>" + "".join(f"<section><div class=in><h3>t{k}</h3><div class=in2><i>deep{k}</i></div></div></section>" for k in range(6)) + "</div>"),
    ]
    known = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html") if SF.exists() else spark.createDataFrame([], "page_id long, url string, html string")
    return known.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string")).cache()


def test_pages_against_plain_trees(spark, pages):
    truth = {r["page_id"]: explored(r["html"]) for r in pages.collect()}
    every = webpages.elements(pages)
    rows = webpages.with_signature(webpages.body_elements(every)).cache()
    seen = {}
    for r in rows.orderBy("page_id", "node").collect():
        seen.setdefault(r["page_id"], []).append((r["tag"], list(r["classes"]), r["text"], r["depth"], r["n_children"], r["signature"]))
    expected = {p: [(n["tag"], classes(n), text(n), d, len(n["children"]), signature(n)) for n, d in t[1]] for p, t in truth.items() if t[1]}
    assert seen == expected
    found = {(r["page_id"], r["signature"]): (r["n"], round(r["depth_deviation"], 9), r["links"]) for r in webpages.patterns(rows).collect()}
    assert found == {(p, s): (n, round(d, 9), k) for p, t in truth.items() for s, (n, d, k) in t[2].items()}
    classified = webpages.classify(rows).cache()
    assert {r["page_id"]: (r["type"], round(r["confidence"], 9), r["signature"]) for r in classified.collect()} == {p: (t[3], round(t[4], 9), t[5]) for p, t in truth.items() if t[1]}
    dominant = classified.where("signature is not null")
    fields = webpages.fields(rows, dominant).cache()
    assert {(r["page_id"], r["field_path"]): round(r["rate"], 9) for r in fields.collect()} == {(p, f): round(v, 9) for p, t in truth.items() for f, v in t[6].items()}
    data = {}
    for r in webpages.extracted_data(rows, dominant, fields).orderBy("page_id", "node").collect():
        data.setdefault(r["page_id"], []).append(r["items"])
    plain = {}
    for p, t in truth.items():
        for n, _ in t[1]:
            if t[5] and signature(n) == t[5]:
                item = {f.split(".")[-1].replace("-", "_"): follow(n, f) for f in sorted(t[6]) if follow(n, f)}
                if item:
                    plain.setdefault(p, []).append(item)
    assert data == plain
    starts = rows.where("page_id = 900006 and tag = 'section'").select("page_id", "node", F.explode(F.array(F.lit(".in.in2.i"), F.lit("div.h3"), F.lit("nowhere.i"))).alias("field_path"))
    assert sorted(r["text"] for r in webpages.traverse_and_extract(rows, starts).collect()) == sorted([*[f"deep{k}" for k in range(6)], *[f"t{k}" for k in range(6)]])
    links = {(r["page_id"], r["link"]) for r in webpages.child_links(rows, pages).collect()}
    wanted = set()
    for r in pages.collect():
        for n, _ in truth[r["page_id"]][1]:
            if r["url"] and n["tag"] == "a" and n["attrs"].get("href"):
                try:
                    link = urljoin(r["url"], n["attrs"]["href"])
                    if urlsplit(link).netloc == urlsplit(r["url"]).netloc:
                        wanted.add((r["page_id"], link))
                except ValueError:
                    pass
    assert links == wanted and (900001, "http://a.org/p3") in links and (900005, "http://b.org/d/e?x=1") in links
    assert {r["page_id"]: r["title"] for r in webpages.titles(every).collect()}[900001] == "T" and [tuple(r) for r in webpages.descriptions(every).where("page_id = 900001").collect()] == [(900001, "about")]
    items = webpages.data_items(rows, dominant, fields).cache()
    kinds = [t[3] for t in truth.values() if t[1]]
    whole = webpages.overall(classified, items).first()
    assert whole["total_pages"] == len(kinds) and whole["page_types"] == sorted(set(kinds)) and whole["most_common_page_type"] == min(set(kinds), key=lambda k: (-kinds.count(k), k)) and whole["total_data_items"] == items.count()
    told = {r["type"]: r for r in webpages.summary(classified, webpages.child_links(rows, pages), items, webpages.titles(every)).collect()}
    assert {k: r["page_count"] for k, r in told.items()} == {k: kinds.count(k) for k in kinds} and sum(r["total_data_items"] for r in told.values()) == items.count() and all(len(r["sample_titles"]) <= 3 for r in told.values())


def test_sitemap_and_crawl(spark):
    xml = "<urlset><url><loc> http://a.org/1 </loc></url><url><loc></loc></url><url><loc x='y'>http://a.org/2</loc></url></urlset>"
    assert sorted(r["link"] for r in webpages.sitemap_links(spark.createDataFrame([(xml,), (None,)], "xml string")).collect()) == ["http://a.org/1", "http://a.org/2"]
    pages = spark.createDataFrame([(k, f"http://a.org/{k}") for k in range(6)], "page_id long, url string")
    links = spark.createDataFrame([(0, "http://a.org/1"), (0, "http://a.org/2"), (1, "http://a.org/3"), (3, "http://a.org/0"), (5, "http://a.org/4")], "page_id long, link string")
    reached = lambda **kw: sorted((r["url"][-1], r["round"]) for r in webpages.crawl(pages, links, ["http://a.org/0"], **kw).collect())
    assert reached() == [("0", 0), ("1", 1), ("2", 1), ("3", 2)] and reached(budget=2) == [("0", 0), ("1", 1)] and reached(rounds=1) == [("0", 0), ("1", 1), ("2", 1)] and reached(budget=None) == reached()


def test_result_query(spark):
    rows = spark.createDataFrame([("u1", "product_list", [{"price": "$ 1,200.50"}, {"price": "7"}]), ("u2", "list", [{"price": "none"}]), ("u3", "detail", None)], "url string, type string, items array<map<string,string>>")
    q = webpages.ResultQuery(rows).filter_by_page_type("list").select_data_items()
    assert q.count() == 3
    q = webpages.ResultQuery(q.current.select("url", F.col("item")["price"].alias("price"))).select_and_clean_numeric("price", "n")
    assert sorted(r["n"] for r in q.execute()) == [7.0, 1200.5] and len(q.take(1)) == 1
    told = q.get_stats_for("n").first()
    assert (told["count"], told["min"], told["max"], told["average"], told["median"]) == (2, 7.0, 1200.5, 603.75, 603.75)
    assert re.fullmatch(r"select_and_clean_numeric\(.*\)", q.get_query_string()) and q.reset().get_query_string() == "base_query"


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_files(spark, tmp_path, kind):
    df = spark.createDataFrame([(2, "b", [1, 2]), (1, "ä,\"x\"", None), (3, None, [])], "id long, s string, a array<int>")
    s = Seq.of(df, ("id",))
    options = {"header": "true"} if kind == "csv" else {}
    files.write(s, str(tmp_path / "out"), kind, ordered=True, **options)
    schema = "id long, s string, a string" if kind == "csv" else "id long, s string, a array<int>"
    back = files.read(spark, str(tmp_path / "out"), ("id",), kind, schema, **options).to.list()
    assert [(r["id"], r["s"]) for r in back] == [(1, "ä,\"x\""), (2, "b"), (3, None)] and back[1]["a"] == ("[1,2]" if kind == "csv" else [1, 2])
    with pytest.raises(ValueError):
        files.read(spark, str(tmp_path / "out"), ("id",), "xlsx")


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("name", ["web_titles", "web_crawl", "web_overall", "web_summary"])
def test_registered(spark, name):
    assert QUERIES[name](spark, str(SF)).count() > 0


def _random_page(rng):
    """Nested, unclosed and void elements, words that neighbours lengthen, odd spaces, and sometimes a body."""
    words = ["price", "cart", "add", "sku", "sale", "by", "author", "a", "bc", " ", "\u00a0", "x y", "\u20ac", "&amp;", "&quot", "LONGER", "\u0130", "address phone", "email ", " hours"]
    out, names = [], ["div", "li", "p", "a", "b", "body", "title", "br", "ul"]
    for _ in range(rng.randrange(1, 120)):
        kind = rng.random()
        if kind < 0.45:
            tag = rng.choice(names)
            classes = rng.choice(["", "", " class='x'", " class='x-y a.b z c'", " class=\"p. b\"", " class"])
            out.append(f"<{tag}{classes}{rng.choice([' href=/q', ' href', '']) if tag == 'a' else ''}>")
        elif kind < 0.7:
            out.append(f"</{rng.choice(names)}>")
        else:
            out.append(rng.choice(words))
    item = rng.choice(["", "<li class=x><a href=/i>n</a><b>by</b></li>", "<div><p class=x-y>price</p><p>x<i>y</i></p>"])
    return "".join(out[: len(out) // 2]) + item * rng.randrange(12) + "".join(out[len(out) // 2 :])


def test_page_by_page_as_tables_of_elements(spark, pages):
    """The functions that read a page where it is give the rows of those on tables of elements."""
    rng = random.Random(5)
    made = [(910000 + k, rng.choice(["http://a.org/x", "http://b.org/", None]), _random_page(rng)) for k in range(150)]
    both = pages.where("page_id >= 900000").unionByName(spark.createDataFrame(made, "page_id long, url string, html string")).unionByName(pages.where("page_id < 900000").orderBy("page_id").limit(25)).cache()
    every = webpages.elements(both).cache()
    rows = webpages.with_signature(webpages.body_elements(every)).cache()
    classified = webpages.classify(rows).cache()
    dominant = classified.where("signature is not null")
    fields = webpages.fields(rows, dominant).cache()
    items = webpages.data_items(rows, dominant, fields).cache()
    links = webpages.child_links(rows, both).cache()
    extracted = webpages.extracted_data(rows, dominant, fields)

    def same(mine, theirs, some=True):
        assert mine.columns == theirs.columns and [k for _, k in mine.dtypes] == [k for _, k in theirs.dtypes]
        a, b = (sorted(repr([round(x, 9) if isinstance(x, float) else sorted(x.items()) if isinstance(x, dict) else x for x in r]) for r in df.collect()) for df in (mine, theirs))
        assert a == b and bool(a) >= some

    same(webpages.page_elements(both), rows)
    same(webpages.page_patterns(both), webpages.patterns(rows))
    same(webpages.page_kinds(both), classified)
    same(webpages.page_fields(both), fields)
    same(webpages.page_items(both), items)
    same(webpages.page_extracted(both), extracted)
    same(webpages.page_links(both), links)
    overview = webpages.page_overview(both)
    same(webpages.summed(overview), webpages.summary(classified, links, items, webpages.titles(every)))
    same(webpages.overall_of(overview), webpages.overall(classified, items))


def test_deep_pages_and_slices(monkeypatch):
    """Keywords, kinds and patterns of a page of 20,000 open elements take time in proportion."""
    began = time.time()
    page = webpages._Page("<body>" + "<p>add price cart" * 20_000)
    assert page.kind[0] == "product_content_list" and page.patterns() and time.time() - began < 20
    flat = list(webpages._Page("<div><ul><body><li>a<b>b</b></li></body></ul></div>").elements(True))
    assert [(r[0], r[1], r[2], r[3], r[7]) for r in flat] == [(2, 1, 0, [0, 0, 0], "ab"), (3, 2, 1, [0, 0, 0, 0], "ab"), (4, 3, 2, [0, 0, 0, 0, 1], "b")]


def test_titles_as_in_sql(spark):
    """A reference that is cut short stays, as the query's SQL has it; others are resolved."""
    texts = ["a &quot", "a &quot; b", "a &amp", "a &amp;lt; b", "&lt", "&#x27;x", "&#x27", "caf&eacute; R&D", "&ampx &gt;"]
    made = spark.createDataFrame([(k, f"<head><title>{x}</title></head>") for k, x in enumerate(texts)], "page_id long, html string")
    assert [r["title"] for r in webpages.page_titles(made).orderBy("page_id").collect()] == ["a &quot", 'a " b', "a &", "a &lt; b", "&lt", "'x", "&#x27", "caf\u00e9 R&D", "&x >"]


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("name", PAGE_BY_PAGE)
def test_pages_stay_where_they_are(spark, name):
    """No join, and an exchange only of what is added up."""
    plan = QUERIES[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    exchanges = [k for k, x in enumerate(lines) if re.search(r"\bExchange\b", x) and "rangepartitioning" not in x]
    assert plan.count("MapInArrow") <= (2 if name in ("web_summary", "web_overall") else 1)
    if name in ("web_summary", "web_overall", "web_links"):
        assert all("Aggregate" in lines[k + 1] or "WindowGroupLimit" in lines[k + 1] or "TakeOrdered" in "".join(lines[k - 1 : k + 3]) for k in exchanges), plan
    else:
        assert "Exchange" not in plan and "Join" not in plan

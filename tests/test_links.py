from pyspark.sql import functions as F

from broadsheet.functions.core import literal_array
from broadsheet.operators import links as L
from broadsheet.operators.rules import GENERIC, SITE_RULES, SiteRule, rule_named, with_rules
from broadsheet.plans.ingest import links_to_fetch, page_links

PAGE = "page_id long, url string, html string"
LINK = "page_id long, pos int, title string, url string"


def links_of(spark, html, url="https://site.org/", rules=SITE_RULES):
    pages = spark.createDataFrame([(1, url, html)], PAGE)
    return [(r.title, r.url) for r in page_links(pages, rules).orderBy("pos").collect()]


def test_generic_page(spark):
    html = (
        '<a href="/A">first</a><a href="/a">again</a><a href="/b">首页</a>'
        '<a href="mailto:x@y">mail</a><a href="javascript:void(0)">run</a><a href="/c">\n third </a>'
    )
    assert links_of(spark, html) == [
        ("first", "https://site.org/A"), ("third", "https://site.org/c"),
    ]


def test_banned_titles_stay_when_nothing_else_is_left(spark):
    html = '<a href="/1">首页</a><a href="/2">登录</a><a href="/1">x</a>'
    assert links_of(spark, html) == [("首页", "https://site.org/1"), ("登录", "https://site.org/2")]


def test_feed_site(spark):
    base = "https://www.toutiao.com/article/"
    html = (
        f'<a href="{base}1/">one</a><a href="{base}2#comment">c</a><a href="{base}3">20评论</a>'
        f'<a href="{base}4/video/">v</a><a href="/article/5">five</a><a href="/other">no</a>'
        f'<a href="{base}6">直播</a>'
    )
    assert links_of(spark, html, "https://www.toutiao.com/") == [
        ("one", base + "1/"), ("five", base + "5"),
    ]


def test_prefix_site_compares_case(spark):
    html = (
        '<a href="https://www.163.com/dy/article/A.html">a</a><a href="/news/article/b.html">b</a>'
        '<a href="/DY/article/c.html">c</a><a href="http://www.163.com/dy/article/d.html">d</a>'
    )
    assert links_of(spark, html, "https://WWW.163.com/") == [
        ("a", "https://www.163.com/dy/article/A.html"), ("b", "https://www.163.com/news/article/b.html"),
    ]


def test_rules_by_name_and_host(spark):
    assert rule_named(SITE_RULES, "NetEase").host == "www.163.com"
    assert rule_named(SITE_RULES, "none") is None
    pages = spark.createDataFrame(
        [(1, "https://WWW.163.com:443/x", ""), (2, "https://x@www.toutiao.com/", ""), (3, None, ""), (4, "junk", "")],
        PAGE,
    )
    names = {r.page_id: r.name for r in with_rules(pages).select("page_id", "rule.name").collect()}
    assert names == {1: "netease", 2: "toutiao", 3: "generic", 4: "generic"}
    only = with_rules(pages, []).select("rule.name").distinct().collect()
    assert [r.name for r in only] == [GENERIC.name]


def test_status(spark):
    rows = [(1, None, 200), (2, "<a href=/x>x</a>", 404), (3, "", 404), (4, "", 200), (5, "", None)]
    pages = spark.createDataFrame([(i, "https://s.org", h, c) for i, h, c in rows], PAGE + ", code int")
    found = L.with_links(with_rules(pages))
    status = L.page_status(F.col("links"), F.col("html"), F.col("code"))
    assert [r[0] for r in found.orderBy("page_id").select(status).collect()] == [
        "Error", "Success", "NavigationFailed", "NoLinks", "NavigationFailed",
    ]


def test_first_per_url_is_idempotent_and_equals_the_table_form(spark):
    links = spark.createDataFrame(
        [(i % 7, i, f"t{i}", f"http://h/{'AbC'[i % 3]}{i % 5}".swapcase() if i % 2 else f"http://h/{'AbC'[i % 3]}{i % 5}") for i in range(300)],
        LINK,
    )
    grouped = links.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "title", "url"))).alias("links")
    )
    once = grouped.select("page_id", L.first_per_url(F.col("links")).alias("links"))
    twice = once.select("page_id", L.first_per_url(F.col("links")).alias("links"))
    in_rows = sorted(map(tuple, L.explode_links(once).collect()))
    assert in_rows == sorted(map(tuple, L.explode_links(twice).collect()))
    assert in_rows == sorted(map(tuple, L.dedup_within_pages(links).collect()))


def test_page_with_many_links(spark):
    html = "".join(f'<a href="/{i % 30_000}">t{i}</a>' for i in range(60_000))
    pages = spark.createDataFrame([(1, "https://s.org", html)], PAGE)
    got = page_links(pages).agg(F.count("*"), F.max("pos")).first()
    assert tuple(got) == (30_000, 29_999)


def test_unknown_urls_and_known_ones_make_up_all(spark):
    links = spark.createDataFrame([(i, 0, "t", f"http://h/{i % 40}") for i in range(200)], LINK)
    archive = spark.createDataFrame([(f"http://h/{i % 25}",) for i in range(100)] + [(None,)], "url string")
    single = L.dedup_across_pages(links)
    for urls in (None, links):
        fresh = {r.url for r in L.unknown_urls(single, archive, urls).collect()}
        assert fresh == {f"http://h/{i}" for i in range(25, 40)}
    assert {r.page_id for r in single.collect()} == set(range(40))


def test_one_url_on_every_page(spark):
    """A URL that all pages link to is reduced before the shuffle."""
    links = spark.range(200_000).select(
        F.col("id").alias("page_id"),
        F.lit(0).alias("pos"),
        F.lit("home").alias("title"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("http://h/"), "id")).otherwise("http://h/").alias("url"),
    )
    rows = L.dedup_across_pages(links)
    assert rows.count() == 133_334
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning(url") < plan.index("Partial")


def test_links_to_fetch(spark):
    html = '<a href="/known">k</a><a href="/new">n</a>'
    pages = spark.createDataFrame([(i, "https://s.org/", html) for i in (2, 1)], PAGE)
    archive = spark.createDataFrame([("https://s.org/known",)], "url string")
    got = [tuple(r) for r in links_to_fetch(pages, archive).select("page_id", "url").collect()]
    assert got == [(1, "https://s.org/new")]


def test_banned_list_from_data(spark):
    """Any array column serves as the list."""
    items = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(t).alias("title"), F.lit("u").alias("url")) for i, t in enumerate("ab")])
    row = spark.range(1).select(L.drop_banned(items, literal_array(["a"])).alias("x")).first()
    assert [r.title for r in row.x] == ["b"]
    assert SiteRule("x").banned_titles == []

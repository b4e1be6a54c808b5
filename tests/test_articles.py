from pyspark.sql import functions as F

from broadsheet.operators import articles as A
from broadsheet.operators.rules import extract_with, with_rules
from broadsheet.plans.ingest import landed_from_links

PAGE = "page_id long, url string, html string"
INFO_PAGE = (
    '<div class="post_main"><h1>标题</h1><div class="post_info">\n 2024-01-05 08:30:12　来源: '
    '<a href="/p"> 新华社 </a><a>x</a></div><p>正文 <img data-src="/a/b.jpg"></p></div><p>after</p>'
)
SPAN_PAGE = (
    '<div class="article-content"><h1>T</h1><div class="article-meta"><span>2024-01-06 10:00</span>'
    '<span>·</span><span class="n">某<b>报</b></span></div><article>body</article>'
    '<img src="data:image/png;base64,aGk="><img src="//c.d/e"></div>'
)


def test_site_pages(spark):
    pages = spark.createDataFrame(
        [
            (1, "https://www.163.com/dy/article/1.html", INFO_PAGE),
            (2, "https://www.toutiao.com/article/7/", SPAN_PAGE),
            (3, "https://www.163.com/x", None),
            (4, "https://www.163.com/y", '<div class=post_main><div class="post_info">昨天　来源: x</div></div>'),
            (5, "https://www.163.com/z", "<article>wrong layout</article>"),
            (6, "https://other.org/z", "<article>right layout</article>"),
        ],
        PAGE,
    )
    rows = {r.page_id: r for r in A.articles(with_rules(pages)).collect()}
    assert len(rows) == 6
    assert rows[1].content == "标题\n2024-01-05 08:30:12 来源: 新华社 x\n正文"
    assert (rows[1].publisher, str(rows[1].publish_time)) == ("新华社", "2024-01-05 00:30:12")  # 08:30 in China
    assert rows[1].images == ["/a/b.jpg"] and rows[1].image_count == 1
    assert rows[2].publisher == "某报" and str(rows[2].publish_time) == "2024-01-06 02:00:00"
    assert rows[2].image_count == 2
    assert (rows[3].error, rows[3].text_length, rows[3].images) == ("No result", 0, [])
    assert rows[4].publish_time is None and rows[4].publisher is None
    assert (rows[5].text_length, rows[5].error) == (0, None)
    assert rows[6].content == "right layout"


def test_manifest_numbers_have_no_gaps(spark):
    images = ["data:bad", "/a.png", "", "ftp://x/y.gif", "data:,z", "/a.png", "b.jpeg?x", "//h/c"]
    rows = spark.createDataFrame([(images,)], "images array<string>")
    base = A.parse_base(F.lit("https://s.org/d/page"))
    got = rows.select(F.inline(A.image_manifest(F.col("images"), base))).collect()
    assert [(r.n, r.file_name, r.url) for r in got] == [
        (1, "img_001.png", "https://s.org/a.png"),
        (2, "img_002.img", None),
        (3, "img_003.jpeg", "https://s.org/d/b.jpeg"[:-5] + ".jpeg?x"),
        (4, "img_004.img", "https://h/c"),
    ]
    many = spark.range(1).select(
        F.transform(F.sequence(F.lit(1), F.lit(1200)), lambda i: F.concat(F.lit("/"), i.cast("string"))).alias("images")
    )
    last = many.select(F.inline(A.image_manifest(F.col("images"), base))).orderBy(F.desc("n")).first()
    assert last.file_name == "img_1200.img"


def test_rendering_defaults(spark):
    none = F.lit(None)
    now = F.lit("2024-01-05 12:00:00").cast("timestamp")
    row = spark.range(1).select(
        A.render(none.cast("string"), F.lit(" "), none.cast("timestamp"), F.lit(0), F.lit("\n"), now).alias("empty"),
        A.render(
            F.lit(" T "), F.lit("P"), F.lit("2024-01-04 08:05:00").cast("timestamp"), F.lit(24),
            F.lit("x" * 801), now,
        ).alias("full"),
    ).first()
    assert row.empty == "无标题。作者：佚名。发布于未知时间。分类：未分类。正文：内容为空。"
    assert row.full == "T。作者：P。发布于昨天 08:05。分类：科技、体育。正文：" + "x" * 800 + "……"


def test_custom_extractor_isolates_failures(spark):
    def extractor(url, html):
        return {"text": html.upper(), "images": ["/i"]} if url != "u3" else None

    pages = spark.createDataFrame([(1, "u1", "a"), (2, "u2", None), (3, "u3", "c")], PAGE)
    rows = {r.page_id: r for r in extract_with(pages, extractor).collect()}
    assert (rows[1].text, rows[1].images, rows[1].error) == ("A", ["/i"], None)
    assert rows[2].text is None and "upper" in rows[2].error
    assert rows[3].text is None and rows[3].error is None


def test_links_meet_their_pages(spark):
    links = spark.createDataFrame([("t1", "u1"), ("t2", "u2")], "title string, url string")
    pages = spark.createDataFrame([(1, "u1", "h1"), (9, "u9", "h9")], PAGE)
    got = sorted((r.title, r.url, r.page_id, r.html) for r in landed_from_links(links, pages).collect())
    assert got == [("t1", "u1", 1, "h1"), ("t2", "u2", None, None)]

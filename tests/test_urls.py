from pyspark.sql import functions as F

from broadsheet.functions import urls as U

V = F.col("v")
BASE = U.parse_base(F.lit("https://Ex.com:443/p/q/r.html?z=1#f"))


def test_resolution(one):
    cases = {
        "/für": "https://ex.com/f%C3%BCr",
        "a/../b/./c": "https://ex.com/p/q/b/c",
        "?q=1 2": "https://ex.com/p/q/r.html?q=1%202",
        "#top": "https://ex.com/p/q/r.html?z=1#top",
        "//CDN.x.org:443/i.png": "https://cdn.x.org/i.png",
        "HTTP://A.com:80": "http://a.com/",
        "https://u@h.com:8080/a b?x=é#é": "https://u@h.com:8080/a%20b?x=%C3%A9#%C3%A9",
        "../../../x/..": "https://ex.com/",
        "\\win\\path": "https://ex.com/win/path",
        "/a/%2E%2e/b": "https://ex.com/b",
        "/li\nne": "https://ex.com/line",
        "/😀": "https://ex.com/%F0%9F%98%80",
        "/a//b/": "https://ex.com/a//b/",
        "javascript:void(0)": "javascript:void(0)",
        "mailto:x@y": "mailto:x@y",
        "http://bad host/": None,
        "http://h:port/": None,
    }
    assert one(U.resolve_url(V, BASE), list(cases)) == list(cases.values())


def test_nothing_resolves_without_a_base(one):
    nowhere = U.parse_base(F.lit("not a url"))
    assert one(U.resolve_url(V, nowhere), ["/x", "y", "http://a.b/c"]) == [None, None, "http://a.b/c"]


def test_resolution_is_stable(one):
    first = one(U.resolve_url(V, BASE), ["/für?x=ü", "a/./b", "//C.D/e"])
    assert one(U.resolve_url(V, BASE), first) == first


def test_filters(one):
    assert one(U.is_web_url(V), ["HTTP://a", "ftp://a", "javascript:x", None]) == [
        True, False, False, False,
    ]
    prefixes = F.array(F.lit("https://a/x"), F.lit("https://b/"))
    assert one(U.has_prefix(V, prefixes), ["https://a/xy", "https://A/xy", "https://b/"]) == [
        True, False, True,
    ]


def test_feed_noise(one):
    urls = [
        "https://t.com/article/1#Comment", "https://t.com/article/1#comments",
        "https://t.com/article/1/?source=feed#x", "https://t.com/article/1/?source=feeds",
        "https://t.com/article/Video/1", "https://t.com/article/1?u=/video",
    ]
    assert one(U.is_feed_noise(F.lit("title"), V), urls) == [True, False, True, False, True, False]
    assert one(U.is_feed_noise(V, F.lit("https://t.com/")), ["20评论", "20 评论", "评论", "20评论x"]) == [
        True, True, False, False,
    ]


def test_data_urls(one):
    cases = {
        "data:image/png;base64,aGk=": (b"hi", ".png"),
        "data:image/png;BASE64,aGk=": (b"hi", ".png"),
        "data:text/plain,a%20b%zz+1": (b"a b%zz+1", ".img"),
        "data:,x": (b"x", ".img"),
        "data:image/svg+xml;utf8,<svg>": (b"<svg>", ".svg"),
        "data:image/png;base64,@@": None,
        "data:nocomma": None,
        ",x": None,
    }
    got = one(U.decode_data_url(V), list(cases))
    assert [r and (bytes(r.bytes), r.ext) for r in got] == list(cases.values())


def test_extensions(one):
    urls = ["http://h/a.PNG?x=.y", "http://h/a", "http://h.com/", "http://h/a.longext", "http://h/a.b/c", "http://h/x."]
    assert one(U.url_extension(V), urls) == [".PNG", ".img", ".img", ".img", ".img", ".img"]

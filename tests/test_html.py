from pyspark.sql import functions as F

from broadsheet.functions import html as H
from broadsheet.functions.core import let

V = F.col("v")


def read(function, *rest):
    """A function of events over a page."""
    return let(H.tag_events(V), lambda events: function(events, *rest))


def inner(pattern, tag):
    """The element's own tag and all inside it, as written."""
    def written(events):
        whole = F.transform(events, lambda e: F.concat(e["tag"], e["text"]))
        return F.array_join(whole, "")

    return read(lambda events: written(H.element(events, F.lit(pattern), F.lit(tag))))


def found(one, page):
    return [(a.title, a.href) for a in one(read(H.anchors), [page])[0]]


def test_anchor_forms(one):
    page = (
        '<a href="/x?a=1&amp;b=2"> Hi <b>there</b></a><a>none</a><a title="q>x" href=\'y z\'>two'
        "<a href=z >three</a><A HREF=/up>UP</A><a href=''>empty</a><a href=/b>  </a>"
    )
    assert found(one, page) == [
        ("Hi there", "/x?a=1&b=2"), ("two", "y z"), ("three", "z"), ("UP", "/up"),
    ]


def test_hidden_markup_is_not_read(one):
    page = '<!-- <a href="/c">c</a> --><script>var a="<a href=/s>s</a>"</script><a href=/k>k</a>'
    assert found(one, page) == [("k", "/k")]
    assert found(one, "<a href=/k>k</a><!-- open <a href=/o>o</a>") == [("k", "/k")]
    assert found(one, "") == []


def test_other_tags_that_start_with_a(one):
    assert found(one, "<article><abbr href=/no>x</abbr><a\nhref=/y>y</a></article>") == [("y", "/y")]


def test_entities_are_decoded_once(one):
    values = ["&amp;lt;", "&#38;lt;", "&#x4e2d;&#65;", "a & b &bogus; &lt", "&#xD800;&#0;", "x"]
    assert one(H.decode_entities(V), values) == [
        "&lt;", "&lt;", "中A", "a & b &bogus; <", "��", "x",
    ]
    # In attributes a name without its semicolon may belong to a query string.
    assert one(H.decode_entities(V, False), ["?a=1&copy=2&lt;"]) == ["?a=1&copy=2<"]


def test_references_of_every_kind(one):
    values = ["caf&eacute; &rarr;", "&#x0000041;&#150;&#0000000065", "&#99999999999;", "&notin; &not it &copy2"]
    assert one(H.decode_entities(V), values) == ["café →", "A–A", "\ufffd", "∉ ¬ it ©2"]


def test_inert_elements_and_nested_texts(one):
    page = "<title><a href=t>T</a></title><template><img src=t></template><noscript>n</noscript><b>x</b>"
    assert one(H.strip_invisible(V), [page, "<noscript>" * 50_000]) == ["<b>x</b>", ""]
    spans = "<span>P <span>in</span> x</span><span>b</span>"
    assert one(read(H.nth_text, "span", 0), [spans]) == ["P in x"]
    assert one(read(H.nth_text, "span", 2), [spans, "<span>a</span>"]) == ["b", None]
    assert one(read(H.base_href), ["<base target=x><base href='/d/'>", "x"]) == ["/d/", None]


def test_page_full_of_unclosed_tags_is_linear(one):
    page = "<a href=/x>" * 20_000 + "<!--" * 20_000
    assert one(F.size(read(H.anchors)), [page]) == [0]
    hostile = ["<p" * 100_000, "<p " * 100_000, "x<i> </i>y" + "<i> </i>" * 100_000, "&#" * 100_000]
    assert one(F.length(read(H.visible_text)), hostile) == [0, 0, 3, 200_000]
    scripts = ["<script>" + "</script" * 100_000, "<script>" * 50_000, "<style " * 50_000]
    assert one(F.length(H.strip_invisible(V)), scripts) == [0, 0, 0]
    found = inner(H.open_tag("div", "main"), "div")
    assert one(F.length(found), ["<div " * 50_000, "<div class=main>" + "<div>" * 50_000]) == [
        None, 250_016,
    ]
    quotes = ["<a '" * 50_000, '<a "x\'>' * 50_000, "<a " + "x='1' " * 200_000 + ">t", "<a href=/x title=\"" + "<b>" * 50_000]
    assert one(F.size(H.tag_events(V)), quotes)[2] == 2
    assert one(F.size(read(H.anchors)), quotes) == [0, 0, 0, 0]


def test_visible_text(one):
    page = "<h1>T</h1>\n<p>a<br>b &amp; c</p>\n\n<div> <span>d</span> <i> </i> e\nf&nbsp; g</div>"
    assert one(read(H.visible_text), [page]) == ["T\na\nb & c\nd e f\u00a0 g"]


def test_texts_of_nested_and_unclosed_elements(one):
    page = "<span>a <b>1</b></span><span class='x>y'>b<span>c</span></span><spanner>no</spanner>"
    assert one(read(H.texts_of, "span"), [page, "<span>open", "none"]) == [
        ["a 1", "b", "c"], ["open"], [],
    ]


def test_element_ends_at_its_own_depth(one):
    values = [
        'x<div class="a main b">1<div>2</div>3</div>4',
        "<div class=main><div>open",
        "<div class='mainly'>no</div><DIV CLASS='main'>yes</DIV>",
        "<div id=main>no</div>",
        None,
    ]
    assert one(inner(H.open_tag("div", "main"), "div"), values) == [
        '<div class="a main b">1<div>2</div>3', "<div class=main><div>open", "<DIV CLASS='main'>yes", None, None,
    ]


def test_events_of_a_page(one):
    page = "a < b <!DOCTYPE x><P class='x>y'>t<br/>\n<!-- <i>c</i> -->u</P ><q title=\"<b>\">v</q>< w <a href=/open"
    events = one(H.tag_events(V), [page, "", None])
    assert [(e.name, e.text) for e in events[0]] == [
        ("", "a < b "), ("!doctype", ""), ("p", "t"), ("br", "\nu"), ("/p", ""), ("q", "v"), ("/q", "< w "), ("a", ""),
    ]
    assert events[1] == [("", "", "")] and events[2] is None
    assert one(read(H.anchors), ["<a href=/x>t</a><a href=/open"]) == [[("t", "/x")]]


def test_image_sources(one):
    page = (
        '<img src="" data-src="/l.png"><img src=/a.gif/><IMG data-original=\'o&amp;x\'>'
        '<img src="/l.png"><img><image src=no>'
    )
    assert one(read(H.image_sources), [page]) == [["/l.png", "/a.gif/", "o&x"]]

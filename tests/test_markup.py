"""Elements of odd pages, and what lies inside what."""

import pytest

from termweave.sources import markup

PAGES = {
    1: '<div class="x elementor-widget-container"><div><a href=/one title="a > b"><span><IMG src=i></span></a></div><a href="/two"><img></a></div>',
    2: '<div class="elementor-widget-container"><a href="/plain">t</a><a href="/img"><img></a></div><div class="elementor-widget-container-x"><a href="/no"><img></a></div>',
    3: '<div class="elementor-widget-container"><!-- <a href="/commented"><img></a> --><div class="elementor-widget-container"><a href="/inner&amp;1"><img></a>',
    4: "<p>first<p><strong>no link</strong> <strong><a href='/a.pdf'>x</a></strong></p><p><b><strong><em><a href=/b.pdf>y</a></em><a href=/c.pdf></a></strong></b></p></p>",
    5: "<p><strong><a>no target</a></strong></p><p><a href=/d.pdf>not strong</a></p><p><strong><a href=/e.html></a></strong><p><strong><a href=/f.pdf>",
    6: None,
    7: '<script>var s = "<p><strong><a href=/script.pdf></a></strong></p>"</script></p></div>text<br/><p/>tail',
    8: "",
}


@pytest.fixture(scope="module")
def found(spark):
    return markup.elements(spark.createDataFrame(list(PAGES.items()), "page_id long, html string")).persist()


def test_trees():
    rows = markup.parsed(PAGES[1])
    assert [(r["path"], r["around"]) for r in rows] == [("div", []), ("div/div", [0]), ("div/div/a", [0, 1]), ("div/div/a/span", [0, 1, 2]), ("div/div/a/span/img", [0, 1, 2, 3]), ("div/a", [0]), ("div/a/img", [0, 5])]
    assert dict(rows[2]["attributes"]) == {"href": "/one", "title": "a > b"}
    last = markup.parsed(PAGES[7])
    assert [(r["tag"], r["text"]) for r in last] == [("script", ""), ("br", ""), ("p", "")]
    assert markup.parsed(None) == []
    assert [r["text"] for r in markup.parsed("<a>x<b>y&eacute;</b>z</a>")] == ["xz", "yé"]


def inside(page, outer, inner):
    return [r for r in page if r["tag"] == inner and outer["seq"] in r["around"]]


def test_archive_links(found):
    want = []
    for k, html in PAGES.items():
        page = markup.parsed(html)
        for box in page:
            links = inside(page, box, "a") if box["tag"] == "div" and "elementor-widget-container" in dict(box["attributes"]).get("class", "").split() else []
            if links and inside(page, links[0], "img"):
                want.append((k, box["seq"], dict(links[0]["attributes"]).get("href")))
    got = sorted(map(tuple, markup.archive_links(found).collect()))
    assert got == sorted(want) and [x[2] for x in got] == ["/one", "/inner&1", "/inner&1"]


def test_issue_links(found):
    want = []
    for k, html in PAGES.items():
        page = markup.parsed(html)
        for p in (r for r in page if r["tag"] == "p"):
            links = [a for s in inside(page, p, "strong")[:1] for a in inside(page, s, "a")[:1]]
            want += [(k, p["seq"], dict(a["attributes"])["href"]) for a in links if ".pdf" in dict(a["attributes"]).get("href", "")]
    got = sorted(map(tuple, markup.issue_links(found).collect()))
    assert got == sorted(want) and {x[2] for x in got} == {"/b.pdf", "/f.pdf"}


def test_no_pages(spark):
    none = markup.elements(spark.createDataFrame([], "page_id string, html string"))
    assert none.count() == markup.issue_links(none).count() == 0

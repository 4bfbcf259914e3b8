"""Elements of HTML pages as rows, and predicates over them as joins.

A stack of open tags, fed by the tokenizer of the standard library, gives every element of a page a
row: its place, the places of all elements around it, its path of tags, attributes and own
text.  What lies inside what is an equi-join on those places, so nested, unclosed and
unquoted markup is judged as a tree.

Defined results: tag and attribute names are lower case; an end tag closes the nearest open element of
its name and all inside it, or nothing; empty elements (``VOID``) have no inside; comments,
declarations and what scripts and styles hold are no elements; of repeated attributes
the last counts, one without value is ''; null pages have no elements; text is what stands
directly in an element.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without an inside.
VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr".split())

ELEMENT = "seq int, around array<int>, path string, tag string, attributes map<string,string>, text string"
_KIND = pa.struct([("seq", pa.int32()), ("around", pa.list_(pa.int32())), ("path", pa.string()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())])


class _Elements(HTMLParser):
    """Rows of the elements of one page; ``open`` holds the places of those not yet closed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        path = f"{self.rows[self.open[-1]]['path']}/{tag}" if self.open else tag
        self.rows.append({"seq": len(self.rows), "around": list(self.open), "path": path, "tag": tag, "attributes": list({k: v or "" for k, v in attrs}.items()), "text": []})
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.rows[self.open[i]]["tag"] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if self.open and self.rows[self.open[-1]]["tag"] not in ("script", "style"):
            self.rows[self.open[-1]]["text"].append(data)


def parsed(html: str | None) -> list[dict]:
    """The elements of a page in order."""
    page = _Elements()
    page.feed(html or "")
    page.close()
    return [row | {"text": "".join(row["text"])} for row in page.rows]


def elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and the columns of ``ELEMENT`` of every element; a page at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = parsed(batch.column(1)[i].as_py())
                if rows:
                    found = pa.array(rows, _KIND)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows))), *found.flatten()], names=[key, *[f.name for f in _KIND]])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, {ELEMENT}")


def has_class(name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(F.col("attributes")["class"], F.lit("")), r"\s+"), name)


def first_inside(outer: DataFrame, inner: DataFrame, key: str = "page_id") -> DataFrame:
    """key, outer (the place of an element of outer) and the columns of the first element of inner that lies in it."""
    rest = [c for c in inner.columns if c != key]
    placed = inner.withColumn("outer", F.explode("around"))
    met = placed.join(outer.select(key, F.col("seq").alias("outer")), [key, "outer"])
    return met.groupBy(key, "outer").agg(F.min_by(F.struct(*rest), "seq").alias("x")).select(key, "outer", "x.*")


def with_inside(outer: DataFrame, inner: DataFrame, key: str = "page_id") -> DataFrame:
    """The elements of outer in which some element of inner lies."""
    places = inner.select(key, F.explode("around").alias("seq")).distinct()
    return outer.join(places, [key, "seq"], "left_semi")


def archive_links(found: DataFrame, container: str = "elementor-widget-container", key: str = "page_id") -> DataFrame:
    """key, seq and href: of each div of the class the first link, if an image lies in it; twice if two such divs hold it."""
    of = lambda tag: found.filter(F.col("tag") == tag)
    first = first_inside(of("div").filter(has_class(container)), of("a"), key)
    return with_inside(first, of("img"), key).select(key, F.col("outer").alias("seq"), F.col("attributes")["href"].alias("href"))


def issue_links(found: DataFrame, kind: str = ".pdf", key: str = "page_id") -> DataFrame:
    """key, seq and href: of each p the first link in its first strong, if it names a file of the kind."""
    of = lambda tag: found.filter(F.col("tag") == tag)
    strong = first_inside(of("p"), of("strong"), key)
    link = first_inside(strong.select(key, "seq").distinct(), of("a"), key)
    hrefs = link.select(key, F.col("outer").alias("strong"), F.col("attributes")["href"].alias("href")).filter(F.contains("href", F.lit(kind)))
    return strong.select(key, F.col("outer").alias("seq"), F.col("seq").alias("strong")).join(hrefs, [key, "strong"]).select(key, "seq", "href")

"""Readers: articles, indexes, graph CSV, layout blocks, HTML links, PDF listings, word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "filename string, title string, authors array<string>, annotation string, keywords array<string>, main_text string"
PUBLICATIONS_CSV = "id string, title string, authors string, annotation string, summary_tfidf string, summary_keybert string"
KEYWORDS_CSV = "id string, name string, methods string"
EDGES_CSV = "pub_id string, keyword_id string, method string, weight string"
SIMILAR_CSV = "source string, target string, score string"


def articles_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Articles, one JSON document a file (or a line); what one lacks is '' or an empty list."""
    return with_defaults(spark.read.schema(ARTICLE).option("multiLine", not lines).json(path))


def with_defaults(articles: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return articles.withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "annotation", "main_text") if c in articles.columns} | {c: F.coalesce(c, none) for c in ("authors", "keywords") if c in articles.columns})


def indexed(index: DataFrame, articles: DataFrame, keep_missing: bool = False) -> DataFrame:
    """The index with each article's own columns; an entry without its article goes, or keeps defaults."""
    extra = ["filename", *[c for c in articles.columns if c not in index.columns]]
    joined = index.join(articles.select(*extra), "filename", "left" if keep_missing else "inner")
    return with_defaults(joined) if keep_missing else joined


def graph_csv(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, keywords and edges from their CSV folders."""
    read = lambda name, schema: spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"').csv(f"{folder}/{name}")
    keywords = read("keywords.csv", KEYWORDS_CSV).withColumn("methods", F.split("methods", ","))
    edges = read("rel_pub_keyword.csv", EDGES_CSV).withColumn("weight", F.col("weight").try_cast("double"))
    return read("publications.csv", PUBLICATIONS_CSV), keywords, edges


def similar_csv(spark: SparkSession, folder: str) -> DataFrame:
    """(source, target, score) of the links between documents."""
    rows = spark.read.schema(SIMILAR_CSV).options(header=True, multiLine=True, quote='"', escape='"').csv(f"{folder}/rel_pub_pub.csv")
    return rows.withColumn("score", F.col("score").try_cast("double"))


def listing(spark: SparkSession, folder: str, suffix: str = "pdf", first: int | None = None) -> DataFrame:
    """Files of a folder by name, their bytes unread until asked for; the first n in order of path."""
    pattern = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files if first is None else first_by(files, "path", first)


def first_by(df: DataFrame, key: str, n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(key).limit(n)


def links(html: Column) -> Column:
    """The targets of all <a href="..."> in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def archive_links(html: Column, container: str = "elementor-widget-container") -> Column:
    """The first link of each <div> of the class whose link holds an image."""
    parts = F.slice(F.split(html, f'(?i)<div[^>]*class="[^"]*{container}[^"]*"[^>]*>'), 2, 1_000_000)
    first = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1).alias("href"), F.regexp_extract(p, r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2).alias("body")))
    return F.transform(F.filter(first, lambda x: (x["href"] != "") & F.lower(x["body"]).contains("<img")), lambda x: x["href"])


def issue_links(html: Column, kind: str = ".pdf") -> Column:
    """The first link in <strong> of each <p> that names a file of the kind."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?is)<p[^>]*>(?:(?!</p>).)*?<strong[^>]*>(?:(?!</strong>).)*?<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return F.filter(found, lambda u: F.contains(u, F.lit(kind)))


def unnested(batches: DataFrame, column: str = "batch") -> DataFrame:
    """The rows of arrays of structs, one row each."""
    return batches.select(F.explode(column).alias("_row")).select("_row.*")


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the one written last."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[F.col(f"r.`{c}`").alias(c) for c in rest])


def stopword_list(spark: SparkSession, path: str) -> tuple[str, ...]:
    """A word list, one a line; a list of a language is small by nature (checked)."""
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).filter("w <> ''").distinct().orderBy("w").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 stopwords: filter with an anti-join instead")
    return tuple(r["w"] for r in rows)


def settings(text: str, present: dict[str, str]) -> dict[str, str]:
    """KEY=value lines; blank and # lines go, the first = splits, what is present wins."""
    out = dict(present)
    for line in text.splitlines():
        if line.strip() and not line.lstrip().startswith("#") and "=" in line:
            key, value = line.split("=", 1)
            out.setdefault(key.strip(), value.strip())
    return out


def settings_table(lines: DataFrame, order: list[str], present: DataFrame | None = None) -> DataFrame:
    """(key, value) of lines (``line`` and the columns of its order) as ``settings`` reads them: the first line of a key counts, what is present (key, value) wins."""
    text = F.trim("line")
    kept = lines.filter((text != "") & ~text.startswith("#") & F.contains("line", F.lit("=")))
    pairs = kept.select(F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.expr("substring(line, instr(line, '=') + 1)")).alias("value"), F.struct(*order).alias("at"))
    first = pairs.groupBy("key").agg(F.min_by("value", "at").alias("value"))
    return first if present is None else first.join(present.select("key"), "key", "left_anti").unionByName(present.select("key", "value"))

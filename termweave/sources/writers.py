"""Writers: JSON, CSV of the graph, an import script, Parquet tables of the graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.graph import Graph


def articles_json(articles: DataFrame, path: str) -> None:
    """One JSON document a line; every column is written, nulls too."""
    articles.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def graph_csv(g: Graph, folder: str) -> None:
    """Three CSV folders with headers (four with links between documents); quotes are doubled, columns in fixed order."""
    known = g.documents.columns
    columns = [F.col(c) if c in known else F.lit("").alias(c) for c in ("id", "title", "authors", "annotation", "summary_tfidf", "summary_keybert")]
    tables = {
        "publications.csv": g.documents.select(*columns),
        "keywords.csv": g.keywords.select("id", "name", F.array_join("methods", ",").alias("methods")),
        "rel_pub_keyword.csv": g.has_keyword.select("pub_id", "keyword_id", "method", "weight"),
    }
    if g.similar is not None:
        tables["rel_pub_pub.csv"] = g.similar.select("source", "target", "score")
    for name, df in tables.items():
        df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(f"{folder}/{name}")


def graph_tables(g: Graph, folder: str) -> None:
    """A full refresh; edges are laid out by keyword so that two-hop joins read sorted data."""
    g.documents.write.mode("overwrite").parquet(f"{folder}/documents_v")
    g.keywords.write.mode("overwrite").parquet(f"{folder}/keywords_v")
    if g.similar is not None:
        g.similar.write.mode("overwrite").parquet(f"{folder}/similar_to")
    g.has_keyword.repartition("keyword_id").sortWithinPartitions("keyword_id", "pub_id").write.mode("overwrite").parquet(f"{folder}/has_keyword")


@dataclass(frozen=True)
class Nodes:
    file: str
    label: str
    properties: tuple[str, ...]


@dataclass(frozen=True)
class Links:
    file: str
    kind: str
    start: tuple[str, str]  # node label, column
    end: tuple[str, str]
    properties: dict[str, bool]  # whether a number


# File, column, label and property names of the exported graph.
NODES = (Nodes("publications.csv", "Document", ("title", "annotation", "summary_tfidf", "summary_keybert")), Nodes("keywords.csv", "Keyword", ("name", "methods")))
HAS_KEYWORD = Links("rel_pub_keyword.csv", "HAS_KEYWORD", ("Document", "pub_id"), ("Keyword", "keyword_id"), {"method": False, "weight": True})
SIMILAR_TO = Links("rel_pub_pub.csv", "SIMILAR_TO", ("Document", "source"), ("Document", "target"), {"score": True})
METHOD_LABELS = {"author": "AuthorKW", "tfidf": "TFIDFKW", "keybert": "KeyBERTKW"}


def import_script(similar: bool = False) -> str:
    """Cypher text that loads the CSV files, made from the description of nodes and links above."""
    said = [f"CREATE CONSTRAINT IF NOT EXISTS FOR (x:{n.label}) REQUIRE x.id IS UNIQUE" for n in NODES]
    for n in NODES:
        said.append(f"{_rows(n.file)} MERGE (x:{n.label} {{id: row.id}}) SET " + ", ".join(f"x.{p} = row.{p}" for p in n.properties))
    for e in (HAS_KEYWORD, *([SIMILAR_TO] if similar else [])):
        ends = " ".join(f"MATCH ({v}:{label} {{id: row.{column}}})" for v, (label, column) in (("a", e.start), ("b", e.end)))
        values = ", ".join(f"{p}: toFloat(row.{p})" if number else f"{p}: row.{p}" for p, number in e.properties.items())
        said.append(f"{_rows(e.file)} {ends} CREATE (a)-[:{e.kind} {{{values}}}]->(b)")
    said += [f"MATCH (x:Keyword) WHERE x.methods CONTAINS '{m}' SET x:{label}" for m, label in METHOD_LABELS.items()]
    return "".join(f"{line};\n" for line in said)


def _rows(file: str) -> str:
    return f"LOAD CSV WITH HEADERS FROM 'file:///{file}' AS row"

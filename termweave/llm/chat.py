"""Chat formatting of reply trees: branches are ranked by score and written as conversations.

Messages are numbered, and every message points to the one it answers.  Self-joins
double what each message knows of its way to the root: in round k it has the sum of
scores and the number of the 2^k messages above it, and where the next one stands, so a
path of n messages takes log2(n) rounds.  Leaves are ranked within their tree by the mean
score of their path, and only the chosen ones are expanded: the same tables, joined
from the last leaf up, give root-to-leaf paths.

A path is written in segments of at most ``TURNS`` turns, so no conversation, however
long, is held as a whole; its segments one after another are the conversation.  A
template marks turns, and escapes its control strings (and the escape sign) inside
texts and roles, so that texts come back from the output as they were.

Defined results: a null text or role is an empty one, a null score 0; a message whose
parent isn't in its tree starts a path; messages that hang in a circle, or from one,
are in no path; of repeated (tree_id, node_id) the first in order of parent, role and md5
of the text has the answers, the others are leaves; messages without node_id have no
answers; rows without tree_id are one tree.  In linear conversations rows without turn
come first, ties go by role, then md5 of the text, and repeated rows are a turn each.
Equal scores go to the leaf of the smaller number.  Other columns don't matter,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.llm.shared import bounded, dropped, stored
from termweave.operators.ranges import placed

TURNS = 64  # of a segment
ESCAPE = "\\"
#: What opens and closes a turn of a role; other roles are written between ROLE and TEXT.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
ROLE, TEXT, END = "[ROLE]", "[TEXT]", "[/ROLE]"
CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", ROLE, TEXT, END)
LEARNED = "assistant"  # the role whose texts are under the loss mask

_UNSAFE = re.compile("|".join(re.escape(x) for x in (ESCAPE, *CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_OPENING = {mark: (role, close) for role, (mark, close) in MARKS.items()}


def escaped(text: str) -> str:
    """The escape sign doubled, and one put behind the first sign of each control string."""
    return _UNSAFE.sub(lambda m: m[0] * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def written(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted (role, text) turns, and where in them (code points) the learned texts stand."""
    out, loss, at = [], [], 0
    for role, text in turns:
        mark, close = MARKS.get(role) or (ROLE + escaped(role) + TEXT, END)
        body = escaped(text)
        if role == LEARNED:
            loss.append((at + len(mark), at + len(mark) + len(body)))
        out += (mark, body, close)
        at += len(mark) + len(body) + len(close)
    return "".join(out), loss


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        mark = next((m for m in _OPENING if formatted.startswith(m, at)), None)
        if mark:
            (role, close), begin = _OPENING[mark], at + len(mark)
        else:
            split = formatted.index(TEXT, at)
            role, close, begin = unescaped(formatted[at + len(ROLE) : split]), END, split + len(TEXT)
        end = formatted.index(close, begin)
        turns.append((role, unescaped(formatted[begin:end])))
        at = end + len(close)
    return turns


@dataclass
class Messages:
    """links (node, tree, parent, score) and texts (node, role, text); node is a place in an order, parent a node or null."""

    links: DataFrame
    texts: DataFrame


def _texts() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]


def linear(conversations: DataFrame) -> Messages:
    """Conversations (conv_id, turn, role, text): every turn answers the one before it."""
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", *_texts())
    nodes = placed(rows, [F.col("tree"), F.col("turn"), F.col("role"), F.md5("text")], "node")
    own = nodes.select("node", "tree")
    before = own.select((F.col("node") + 1).alias("node"), F.col("tree").alias("_before"), F.lit(True).alias("_any"))
    parent = F.when(F.col("_any") & F.col("tree").eqNullSafe(F.col("_before")), F.col("node") - 1)
    links = own.join(before, "node", "left").select("node", "tree", parent.alias("parent"), F.lit(0.0).alias("score"))
    return Messages(stored(links, "links"), nodes.select("node", "role", "text"))


def trees(messages: DataFrame) -> Messages:
    """Messages (tree_id, node_id, parent_id, role, text, score)."""
    rows = messages.select(F.col("tree_id").alias("tree"), "node_id", "parent_id", *_texts(), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = placed(rows, [F.col("tree"), F.col("node_id"), F.col("parent_id"), F.col("role"), F.md5("text")], "node")
    answered = nodes.filter("node_id is not null").groupBy(F.col("tree").alias("_tree"), F.col("node_id").alias("_id")).agg(F.min("node").alias("parent"))
    links = nodes.select("node", "tree", "parent_id", "score").join(answered, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("parent_id") == F.col("_id")), "left")
    return Messages(stored(links.select("node", "tree", "parent", "score"), "links"), nodes.select("node", "role", "text"))


def climbed(links: DataFrame) -> list[DataFrame]:
    """Round by round node, up, n and total: n messages from the node upwards, the sum of their scores, and what follows (null at the root).

    In the last round only messages without a way to a root have something above them.
    """
    rounds = [stored(links.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("n"), F.col("score").alias("total")), "climb")]
    left = rounds[0].filter("up is not null").count()
    while left:
        now = rounds[-1]
        above = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("total").alias("total2"))
        further = now.filter("up is not null").join(above, "up").select("node", F.col("up2").alias("up"), (F.col("n") + F.col("n2")).alias("n"), (F.col("total") + F.col("total2")).alias("total"))
        rounds.append(stored(further.unionByName(now.filter("up is null")), "climb"))
        before, left = left, rounds[-1].filter("up is not null").count()
        if left == before:  # all that is left hangs in circles
            break
    return rounds


def branches(links: DataFrame, rounds: list[DataFrame], best: int | None = 1) -> DataFrame:
    """leaf, tree, score and rank of the paths from a root to a leaf; the ``best`` of each tree, or all."""
    leaves = links.join(links.filter("parent is not null").select(F.col("parent").alias("node")).distinct(), "node", "left_anti").select("node", "tree")
    scored = leaves.join(rounds[-1].filter("up is null"), "node").select(F.col("node").alias("leaf"), "tree", (F.col("total") / F.col("n")).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    return ranked if best is None else ranked.filter(F.col("rank") <= best)


def paths(messages: Messages, rounds: list[DataFrame], chosen: DataFrame) -> DataFrame:
    """The chosen branches with position (from 1 at the root), role and text of each message.

    The longest jumps come first, so that the rows double towards the end only.
    """
    found = chosen.withColumn("node", F.col("leaf"))
    for jumps in reversed(rounds[:-1]):
        found = found.join(jumps.filter("up is not null").select("node", "up"), "node", "left")
        found = found.withColumn("node", F.explode(F.array_compact(F.array("node", "up")))).drop("up")
    return found.join(rounds[-1].select("node", F.col("n").alias("position")), "node").join(messages.texts, "node").drop("node")


def formatted(messages: DataFrame, turns: int = TURNS) -> DataFrame:
    """tree, leaf, rank, score, segment, n_turns, formatted and loss (code points from start to end) of paths of messages."""
    keys = ["tree", "leaf", "rank", "score", "segment"]
    grouped = messages.withColumn("segment", F.floor((F.col("position") - 1) / turns)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [written([(t["role"], t["text"]) for t in turns]) for turns in batch.column(len(keys)).to_pylist()]
            sizes = [len(x) for x in batch.column(len(keys)).to_pylist()]
            spans = pa.array([[{"start": a, "end": b} for a, b in loss] for _, loss in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(sizes, pa.int64()), pa.array([text for text, _ in done], pa.string()), spans], names=[*keys, "n_turns", "formatted", "loss"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.schema.fields[: len(keys)])
    return grouped.mapInArrow(run, f"{kept}, n_turns long, formatted string, loss array<struct<start: long, end: long>>")


def conversations(messages: Messages, best: int | None = 1, turns: int = TURNS) -> DataFrame:
    """The best branches of each tree as conversations, in segments (see ``formatted``)."""
    bounded(messages.links.sparkSession)
    rounds = climbed(messages.links)
    out = stored(formatted(paths(messages, rounds, branches(messages.links, rounds, best)), turns), "conversations")
    for table in rounds:
        dropped(table)
    return out


def read_back(out: DataFrame) -> DataFrame:
    """A row a conversation: tree, leaf, n_turns, digests of its turns and of all text under its loss mask, and sizes.

    The segments of a conversation pass one after another through running digests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row = None, []

        def ended(rows: list) -> pa.RecordBatch:
            kinds = (tree_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ("tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

        def closed() -> tuple:
            tree, leaf, n, turns, chars, loss, size = row
            return tree, leaf, n, turns.hexdigest(), chars, loss.hexdigest(), size

        done, tree_type = [], None
        for batch in batches:
            tree_type = batch.column(0).type
            for tree, leaf, _, text, spans in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if leaf != now:
                    if row:
                        done.append(closed())
                    now, row = leaf, [tree, leaf, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parsed(text):
                    row[2] += 1
                    row[3].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    learned = unescaped(text[span["start"] : span["end"]])
                    row[4] += len(learned)
                    row[5].update(learned.encode())
                row[6] += len(text)
            if done:
                yield ended(done)
                done = []
        if row:
            yield ended([closed()])

    kind = out.schema["tree"].dataType.simpleString()
    sorted_ = out.select("tree", "leaf", "segment", "formatted", "loss").repartition("leaf").sortWithinPartitions("leaf", "segment")
    return sorted_.mapInArrow(run, f"tree {kind}, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return read_back(conversations(linear(table.unionByName(own)))).withColumnRenamed("tree", "conv_id").drop("leaf")


OP11_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, md5(text) as m, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|ROLE\]|TEXT\]|/ROLE\])', '\1\\\2', 'g')) as chars,
  case role when 'system' then 15 when 'user' then 15 when 'assistant' then 7
    else 19 + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|ROLE\]|TEXT\]|/ROLE\])', '\1\\\2', 'g')) end as marks from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, m)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, m) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars + marks)::bigint as formatted_chars from e group by conv_id
"""

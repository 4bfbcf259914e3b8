
import random
import re

import numpy as np

from termweave.llm import decontaminate, linededup, topk


def words(rng, n, size=4):
    return ["".join(rng.choice(["er", "th", "on", "an", "re", "ing", "ou", "st"]) for _ in range(rng.randint(2, size))) for _ in range(n)]


def test_copies_of_several_hundred_items(spark):
    rng = random.Random(5)
    items = [(k, " ".join(words(rng, rng.randint(20, 55))) + ". " + " ".join(words(rng, 8)) + ".") for k in range(400)]
    docs = []
    for k, t in items[:160]:
        w = t.split()
        if k % 2:  # reworded
            for at in rng.sample(range(len(w) - 9), len(w) // 6):
                w[at] = "changed"
        docs.append((k, " ".join([*words(rng, rng.randint(0, 60)), *w, *words(rng, rng.randint(0, 60))])))
    docs += [(1000 + k, " ".join(words(rng, 150))) for k in range(200)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k, k) for k in range(160)}


def test_groups_and_blocks_by_brute_force(spark):
    """Small blocks and groups, long, short, repeated and null items: the hits of plain dynamic programming."""
    rng = random.Random(15)
    items = [(k, " ".join(words(rng, rng.choice([6, 25, 90, 200]))) + ". " + " ".join(words(rng, 5)) + ".") for k in range(30)]
    items += [(3, items[3][1]), (30, ""), (31, None), (None, "no id")]
    docs = [(100 + k, " ".join(words(rng, 80))) for k in range(20)] + [(5, None), (6, ""), (None, items[2][1])]
    for k, t in items[:30:2]:
        w = t.split()
        for at in rng.sample(range(len(w) - 5), len(w) // 8):
            w[at] = "changed"
        docs += [(k, " ".join([*words(rng, 20), *w, *words(rng, 20)]))] * (1 + k % 3)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as content", "2 as _doc", "3 as item_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = lambda t: [w.strip(".") for w in t.split()]
    want, dirty = set(), set()
    for d, t in docs:
        for i, item in items:
            if t and item and i is not None and common(plain(item), plain(t)) >= 0.6 * len(plain(item)) and set(plain(item)[-5:]) & set(plain(t)):
                want.add((d, i))
                dirty.add(t)
    got = decontaminate.contaminated(frame, bench, block=7, passages=9)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want) and len(want) >= 16
    clean = decontaminate.clean_documents(frame, bench, block=50, passages=1000)
    assert clean.columns == frame.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, t in docs if t not in dirty)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_short_items_at_every_corpus_size():
    rng = random.Random(6)
    common, rare = [f"c{k}" for k in range(40)], [f"r{k}" for k in range(400)]
    short = [" ".join(rng.sample(common, 15)) for _ in range(3)]
    others = [" ".join(rng.sample(rare, 30)) for _ in range(10)]
    items = decontaminate.Items(list(range(13)), [*short, *others])
    plain = set(decontaminate.plain_words(*encoded(common))[0].tolist())
    texts = []
    for k in range(60):  # a short item at every offset, among words of no item and of other items
        around = [f"x{j}" for j in range(80)] if k % 2 else rng.sample(rare, 80)
        texts.append(" ".join([*around[:k], short[k % 3], *around[k:]]))
    for n in (100, 10_000, 10_000_000):
        items.weigh(np.array([n // 3 if int(v) in plain else n // 100 for v in items.vocab]), n)
        items.project(np.eye(len(items.vocab)))
        assert {(r, i) for r, i, *_ in decontaminate.matches(items, *encoded(texts))} == {(k, k % 3) for k in range(60)}


def encoded(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def test_passages_cut_anywhere(spark):
    rng = random.Random(7)
    rows, spans = [], {}
    for k in range(60):
        passage = words(rng, rng.randint(51, 80))
        for at in rng.sample(range(1, len(passage) - 1), (k % 4)):  # sentence ends, or none
            passage[at] += "."
        first = [*words(rng, 40), *passage, *words(rng, 40)]
        before = words(rng, rng.randint(0, 60))
        rows += [(k, " ".join(first)), (100 + k, " ".join([*before, *passage, *words(rng, 30)]))]
        start = sum(len(x) + 1 for x in before)
        spans[100 + k] = (start, start + len(" ".join(passage)), len(passage))
    got = {}
    for r in linededup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc, []).append(r)
    assert set(got) == set(spans)
    for doc, (start, end, n) in spans.items():
        assert all(start <= r.start and r.end <= end for r in got[doc])
        assert sum(r.words for r in got[doc]) >= n - 2 * (linededup.SPREAD - 1)


def brute_spans(rows, min_words, gram, spread):
    """(doc, start, end, words, first_doc) of the passages to remove, by dictionaries."""
    pieces, count, holder = [], {}, {}
    for doc, text in rows:
        doc = linededup.LAST if doc is None else doc
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
        word = [re.sub("[A-Z]", lambda m: m[0].lower(), m[0]) for m in found]
        cuts = [0, *(k + 1 for k, m in enumerate(found) if k + 1 == len(found) or m[0][-1] in ".!?" or re.search(r"[\r\n]", text[m.end() : found[k + 1].start()]))]
        spans = list(zip(cuts, cuts[1:], strict=False))
        if gram and found:
            raw, at = encoded([text])
            words = linededup.Words(raw, at)
            spans += [(int(b), int(b) + gram) for b in linededup.grams_of(words, words.hashes(), gram, spread)[1]]
        for a, b in spans:
            key = tuple(word[a:b])
            count[key] = count.get(key, 0) + 1
            holder[key] = min(holder.get(key, doc), doc)
        pieces.append((doc, found, [(a, b, tuple(word[a:b])) for a, b in spans]))
    out = set()
    for doc, found, spans in pieces:
        head = {}
        for a, _, key in spans:
            head[key] = min(head.get(key, a), a)
        gone = sorted((a, b, holder[key]) for a, b, key in spans if count[key] > 1 and (holder[key] != doc or a - head[key] >= b - a))
        runs = []
        for a, b, h in gone:
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b, h])
        out |= {(doc, found[a].start(), found[b - 1].end(), b - a, h) for a, b, h in runs if b - a >= min_words}
    return out


def test_repeats_by_brute_force(spark):
    rng = random.Random(8)
    some = ["A b c.", "Unique one.", "x", "the end of it!", "longer sentences have more words than others.", "é à ü.", "no stop"]
    rows = []
    for k in range(40):
        parts = [rng.choice(some) if rng.random() < 0.6 else " ".join(words(rng, rng.randint(1, 9), 3)) + "." for _ in range(rng.randint(0, 8))]
        rows.append((rng.choice([k, k, None, 3]), rng.choice([" ", "\n", "  "]).join(parts)))
    shared = " ".join(words(rng, 30))
    rows += [(50, f"{shared} tail"), (51, f"head {shared}"), (52, f"{shared} {shared}"), (51, f"head {shared}"), (53, None), (54, ""), (55, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as content", "2 as holder")
    for min_words, gram, spread in ((1, 6, 3), (5, 6, 3), (1, 0, 0), (8, 10, 4)):
        got = {(r.doc, r.start, r.end, r.words, r.first_doc) for r in linededup.repeated_spans(docs, min_words, gram, spread).collect()}
        assert got == brute_spans(rows, min_words, gram, spread)
    cut = linededup.without_repeats(docs, 1, 0, 0)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_unrepeated_text_between_repeats_stays(spark):
    rng = random.Random(9)
    a, b = " ".join(words(rng, 35)) + ".", " ".join(words(rng, 35)) + "."
    rows = [(1, f"{a}\n{b}"), (2, f"{a} Unique secret 4711. {b}"), (3, "A ten word line that stands in two of them, yes.\nmore here"), (4, "Other.\nA ten word line that stands in two of them, yes.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text.strip() for r in linededup.without_repeats(docs).collect()}
    assert got[2] == "Unique secret 4711." and got[4] == rows[3][1]
    assert {r.doc_id: r.text.strip() for r in linededup.without_repeats(docs, 1).collect()}[4] == "Other."


def test_topk_over_many_small_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.integers(-2, 3, 6).astype(float).tolist()) for k in range(120)] + [(40, [0.0] * 6), (7, [1.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as block", "2 as slot").repartition(5)
    queries = vectors.filter("vec_id % 20 = 0")
    found = lambda **sizes: sorted(map(tuple, topk.top_k(vectors, queries, 9, **sizes).collect()))
    want = []
    for q, mine in [(i, v) for i, v in rows if i % 20 == 0]:
        best = sorted((-int(sum(64 * a * 64 * b for a, b in zip(mine, v, strict=True))), i) for i, v in rows if i != q)[:9]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert found(block=7, query_block=2) == found(block=1, query_block=1) == found() == sorted(want)


def test_items_in_capitals_of_any_script(spark):
    items = [(1, "Éai éonleeau pour an éonqueê aivi ai éenaitre éoiré anvitre èenreré. Les éèque le oueuxoi ñandú."), (2, "Граф знаний связывает слова и тексты одной статьи с другой. Ответ стоит в конце её.")]
    docs = [(10 * k, " ".join(["vorher noch worte", t.upper(), "und danach mehr worte"])) for k, t in items] + [(5, "ganz anderer text ohne treffer " * 5)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.lcs) for r in got.collect()} == {(10, 1, 1.0), (20, 2, 1.0)}


def test_quality_sums_are_a_row_a_task(spark):
    """What tasks send doesn't grow with the sums they hold: packed rows add up to the sums themselves."""
    import numpy as np
    import pyarrow as pa

    from termweave.llm import quality

    rng = np.random.default_rng(1)
    parts = [np.where(rng.random(500) < 0.2, rng.normal(size=500), 0.0) for _ in range(70)]
    rows = pa.Table.from_batches([quality._packed(k, p) for k, p in enumerate(parts)])
    assert rows.num_rows == 70 and np.allclose(quality._total(rows, 500), sum(parts))
    added = quality._added(rows, size=500)
    assert added.num_rows == 1 and np.allclose(quality._total(added, 500), sum(parts))

"""The operators on small tables against brute force, with odd rows among them."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import SF, same_as_sql
from pyspark.sql import functions as F

from termweave.llm import decontaminate, linededup, lm, neardup, packing, quality, queries, token_count, topk, toxicity, urlfilter

ODD = [(None, "nobody's text"), (901, None), (902, ""), (903, " \n\t "), (904, "One two three."), (904, "One two three."), (905, "w " * 30_000)]


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def sentence(rng, n):
    return " ".join("".join(rng.choice(["er", "th", "on", "an", "re", "ing", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [" ".join(sentence(rng, rng.randint(5, 14)) for _ in range(rng.randint(4, 12))) for _ in range(60)]
    rows = list(enumerate(base))
    for k in range(20):  # near copies, exact copies
        w = base[k].split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "changed"
        rows.append((100 + k, " ".join(w)))
    for k in range(20, 26):  # the same shingles, some of them more often
        rows.append((100 + k, f"{base[k]} {base[k]}" if k % 2 else " ".join([base[k], *base[k].split()[-8:]])))
    passage = " ".join(sentence(rng, 12) for _ in range(5))
    rows += [(200 + k, f"{sentence(rng, 9)} {passage} {sentence(rng, 9)}") for k in range(6)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "src1", None if t is None else len(t), "x", 7) for i, t in [*texts, *ODD]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, _row int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def brute_classes(rows, weighted=True):
    """Classes by the (weighted) Jaccard similarity of all pairs."""
    sets = {}
    for i, t in rows:
        w = split(t)
        seen = Counter()
        items = set()
        for k in range(max(1, len(w) - 4) if w else 0):
            s = tuple(w[k : k + 5])
            items.add((s, seen[s] if weighted else 0))
            seen[s] += 1
        sets.setdefault(i, frozenset(items))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for i in ids:
        groups[root(i)].append(i)
    return {i: min(g) for g in groups.values() for i in g}


def test_near_duplicates(spark, docs, empty, texts):
    for weighted in (True, False):
        want = brute_classes([(i, t) for i, t in [*texts, *ODD] if i is not None], weighted)
        got = neardup.near_duplicates(docs, weighted=weighted).collect()
        assert len(got) == docs.count()
        for r in got:
            if r.doc_id is not None:
                assert r.class_id == want[r.doc_id]
    want = brute_classes([(i, t) for i, t in [*texts, *ODD] if i is not None])
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values()))
    assert neardup.near_duplicates(empty).count() == 0 and neardup.deduplicated(empty).count() == 0


def test_components(spark):
    chain = spark.createDataFrame([(f"{k:03}".encode(), f"{k + 1:03}".encode()) for k in range(40) if k != 20], "a binary, b binary")
    labels = {bytes(r.node): bytes(r.label) for r in neardup.components(chain).collect()}
    assert len(labels) == 41 and set(labels.values()) == {b"000", b"021"}


def test_block_links(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**32, 100).astype(np.uint32)
    sets = {}
    for k in range(30):
        s = base.copy()
        s[: 3 * (k % 10)] = rng.integers(0, 2**32, 3 * (k % 10))
        sets[f"n{k:02}".encode()] = np.unique(s)
    rows = spark.createDataFrame([(1, n, n) for n in sets], "key long, node binary, label binary")
    table = spark.createDataFrame([(n, s.tobytes()) for n, s in sets.items()], "node binary, set binary")
    old, neardup.BLOCK = neardup.BLOCK, 7
    try:
        got = {(bytes(r.a), bytes(r.b)) for r in neardup._block_links(rows, table, 0.8).collect()}
    finally:
        neardup.BLOCK = old
    want = {(a, b) for a in sets for b in sets if a < b and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert got == want and want


def test_repeats(docs, empty, texts):
    got = linededup.repeated_spans(docs).collect()
    by = defaultdict(list)
    text = {i: t for i, t in [*texts, *ODD] if i is not None}
    for r in got:
        by[r.doc].append((r.start, r.end))
        assert r.first_doc <= r.doc and r.words >= linededup.MIN_WORDS
    assert 200 not in by and all(i in by for i in range(201, 206))
    assert not any(i in by for i in range(60))
    cleaned = {r.doc_id: r for r in linededup.without_repeats(docs).collect()}
    for i, t in text.items():
        out, at = "", 0
        for a, b in sorted(by[i]):
            out, at = out + (t or "")[at:a], b
        assert (cleaned[i].text or "") == out + (t or "")[at:]
        assert cleaned[i].n_chars == (None if cleaned[i].text is None else len(cleaned[i].text))
    assert linededup.without_repeats(docs).columns == docs.columns and linededup.without_repeats(docs).count() == docs.count()
    assert linededup.repeated_spans(empty).count() == 0


def test_decontamination(spark, docs, empty, texts):
    rng = random.Random(9)
    items = [(k, sentence(rng, 14) + " " + sentence(rng, 12)) for k in range(8)]
    host = dict(texts)
    planted = []
    for k, (i, t) in enumerate(items):
        w = t.split()
        if k % 2:
            w[3], w[17] = "other", "word"
        planted.append((500 + k, host[k] + " " + " ".join(w) + " " + host[k + 10]))
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (0, items[0][1])], "item_id long, text string")
    all_docs = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(all_docs, bench).collect()}
    assert got == {(500 + k, k) for k in range(8)}
    clean = decontaminate.clean_documents(all_docs, bench)
    assert clean.columns == all_docs.columns and clean.count() == docs.count()
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_lm_scores(spark, docs, empty, texts, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 60)  # so that most words are looked up by the join
    rows = [(i, t) for i, t in [*texts, *ODD]]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in rows if not held(i) for w in [*split(t), None])
    n, v = sum(counts.values()), len(counts)
    got = lm.lm_scores(docs, rounds=1).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        w = [*split(t), None]
        want[(i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.lm_scores(empty, rounds=1).count() == 0


def test_lm_scores_by_plain_loops(spark, docs, texts, monkeypatch):
    """The probability of each token from dictionaries, each text's n-grams without its own."""
    import numpy as np

    from termweave.llm.shared import mixed

    monkeypatch.setattr(lm, "TOP", 60)
    rows = [(i, t) for i, t in [*texts, *ODD]]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = lm.Counts(docs)
    model = lm.Model().fit(docs, counts, 2)
    assert 0 < len(model.frequent.counts) <= 61 and 0 < model.discount < 1 and np.abs(model.weights[1]).max() > 0
    one = lambda v: int(mixed(np.array([v % 2**64], np.uint64))[0])
    tally = Counter(w for i, t in rows if not held(i) for w in [*split(t), None])
    known = {}
    for w in {w for _, t in rows for w in [*split(t), None]}:
        data = (w or "").encode()
        u, ending, _, _ = lm.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        k = 0 if w else len(u) - 1
        kind, code = lm.classes_and_codes(model.frequent.ranks(u[k : k + 1]), ending[k : k + 1])
        known[w] = int(u[k]), int(kind[0]), int(code[0])
    follow, texts_own = defaultdict(Counter), []
    for i, t in rows:
        w, own = [*split(t), None], defaultdict(Counter)
        for a, b, x in zip(w, w[1:], w[2:], strict=False):
            if one(known[a][0] * 0x9E3779B97F4A7C15 % 2**64 ^ known[b][0]) % lm.SELECT == 0:
                own[a, b][x] += 1
        texts_own.append(own if not held(i) else {})
        if not held(i):
            for c, n in own.items():
                follow[c].update(n)

    def softmax(z):
        z = np.exp(z - z.max())
        return z / z.sum()

    want, gained = Counter(), 0
    for (i, t), own in zip(rows, texts_own, strict=True):
        w, total = [*split(t), None], 0.0
        if len(w) > 5000:
            continue
        for at, x in enumerate(w):
            u, kind, _ = known[x]
            codes = [known[w[at - d]][2] if at >= d else lm.CODES - 1 for d in (1, 2)]
            gram = 2 * lm.CODES + one(codes[0] * lm.CODES + codes[1]) % lm.GRAMS
            p = softmax(model.weights[0][codes[0]] + model.weights[0][lm.CODES + codes[1]] + model.weights[0][gram] + model.bias)[kind]
            leaf = kind
            if kind >= lm.SINGLE:
                part = u >> 8 & lm.SUB - 1
                features = [one(f * lm.CLASSES + kind) % lm.INNER for f in (codes[0], gram)]
                p *= softmax(sum(model.weights[1][f] for f in features) + model.part_bias[kind - lm.SINGLE])[part]
                leaf = lm.SINGLE + (kind - lm.SINGLE) * lm.SUB + part
                p *= (tally[x] + 0.1) / (model.size[leaf] + 0.1 * (model.kinds[leaf] + 1))
            c = (w[at - 2], w[at - 1]) if at >= 2 else None
            if c in follow:
                others = follow[c] - own.get(c, Counter())
                if others:
                    n, d = sum(others.values()), model.discount
                    p = max(others[x] - d, 0) / n + d * len(others) / n * p
                    gained += others[x] > 0
            total += math.log10(p)
        want[i, round(total, 2)] += 1
    got = Counter((r.doc_id, round(r.score, 2)) for r in lm.scored(docs, counts, model).collect() if r.n_tokens <= 5000)
    near = lambda a: {i: sorted(s for j, s in a.elements() if j == i) for i, _ in a}
    a, b = near(got), near(want)
    assert a.keys() == b.keys() and all(len(a[i]) == len(b[i]) and np.allclose(a[i], b[i], atol=0.03) for i in a)
    assert gained > 5


def test_every_context_has_n_grams(spark):
    """No place behind two tokens is left out, so texts that stand twice gain over those that stand once."""
    import numpy as np

    first = np.array([0, 1, 40, 300])
    at, context, gram = lm.behind_two(np.arange(300, dtype=np.uint64), first)
    assert at.tolist() == [*range(3, 40), *range(42, 300)] and len(set(context.tolist())) == len(set(gram.tolist())) == len(at)
    train = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10][:60]
    text = lambda k: " ".join(f"w{(k * 7919 + j * j * 31 + j * k) % 251}" for j in range(12))
    rows = [(i, text(k // 2 if k < 20 else k)) for k, i in enumerate(train)]
    got = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()}
    assert min(got[i] for i in train[:20]) > max(got[i] for i in train[20:])


def test_lm_counts_take_less_disk_than_texts(spark):
    """n-grams that stand once, 8 bytes of text each, take no rows and no hashes of their own."""
    import os

    import numpy as np

    from termweave.sources import scratch

    vocabulary = [f"w{k:06}" for k in range(2000)]
    rows = [(i, " ".join(vocabulary[k] for k in x)) for i, x in enumerate(np.random.default_rng(5).integers(0, 2000, (400, 250)))]
    root = scratch.shared_folder(spark).removeprefix("file://")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(root) for f in files)
    before = size()
    counts = lm.Counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert counts.words.count() == 2001
    assert size() - before < sum(len(t) for _, t in rows)


def test_lm_scores_in_many_buckets_and_passes(spark, docs, texts, monkeypatch):
    """Buckets, passes and chunks leave counts and scores as they are, and a pass moves its buckets alone."""
    import numpy as np

    def found(rounds):
        counts = lm.Counts(docs)
        model = lm.Model().fit(docs, counts, rounds)
        assert {r.bucket for r in lm.blocks(counts.chunks, counts.buckets, range(1)).select("bucket").collect()} == {0, -1}
        words = sorted(map(tuple, counts.words.collect()))
        return counts.buckets, words, model.discount, sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in lm.scored(docs, counts, model).collect())

    one = found(0)
    size = sum(len((t or "").encode()) for _, t in texts)
    monkeypatch.setattr(lm, "BUCKET", size // 5)
    monkeypatch.setattr(lm, "CHUNK", 3000)
    monkeypatch.setattr(lm, "PASSES", 3)
    many = found(0)
    assert one[0] == 1 < 4 < many[0] and one[1:3] == many[1:3] and len(one[3]) == len(many[3])
    assert [x[:4] for x in one[3]] == [x[:4] for x in many[3]] and np.allclose([x[4] for x in one[3]], [x[4] for x in many[3]])
    for n in (np.zeros(0, int), np.array([0, 254, 255, 256, 1, 1 << 40]), np.array([255])):
        assert lm.unpacked(lm.packed(n), len(n)).tolist() == n.tolist()


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(k, int(k % 7 == 0)) for k in range(60)] + [(None, 1), (61, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels, max_train=40).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got if r.doc_id is not None}
    assert toxicity.toxicity(empty, labels).count() == 0
    assert all(r.score < 1e-6 for r in toxicity.toxicity(docs, labels.limit(0)).collect())


def test_topk(spark):
    rows = [(k, [float(k % 5) / 7, -0.3 * (k % 3), 0.01 * k]) for k in range(45)]
    rows += [(100, None), (101, [float("nan"), 0.0, 0.0]), (102, [None, 1.0, 1.0]), (103, [1.0]), (104, []), (None, [1.0, 1.0, 1.0]), (7, [9.0, 9.0, 9.0]), (20, [5.0, 5.0, 5.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("ids", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 6).collect())
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and not any(x is None or x != x for x in v)]
    want = []
    for q, qi in good:
        if q % 20 == 0:  # every row, of a repeated vec_id too
            scored = sorted(((-sum(a * b for a, b in zip(qi, c, strict=False)), i) for i, c in good if i != q))[:6]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_token_counts(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_count.model_path())
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(docs).collect())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        t = r.text or ""
        want[(r.doc_id, len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096)] += 1
    assert got == want
    assert token_count.token_counts(empty).count() == 0


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/x", "http://example.com/en/", "http://a.example.com/en/y?q", "http://xexample.com/en/", "https://b.net/es/1#f", "http://net/fr/", "http://b.net/", "no scheme", None, "http://", "http://com", "x://com/?", "a://b://com/", "http://com./en/", "http://é.com/é", "http://b.net/fr/", "http://b.net/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = {r.page_id: r for r in urlfilter.filter_urls(pages).collect()}
    assert len(got) == len(urls)

    def judged(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(r), v, r) for v, r in urlfilter.RULES for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, "allow", None))
        return host, path, best[2], best[1]

    for k, u in enumerate(urls):
        assert tuple(got[k])[1:] == judged(u)
    both = urlfilter.filter_urls(pages, [("allow", "com/"), ("block", "com/")])
    assert {r.verdict for r in both.filter("host = 'example.com'").collect()} == {"block"}
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0


def test_packing(docs, empty):
    from termweave.llm.bpe import word_model

    model = word_model(packing.model_path())
    got = packing.pack(docs, length=256, shard=50).collect()
    pieces, used = defaultdict(list), defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
        if r.doc_id not in (None, 904):
            pieces[r.doc_id].append(r)
    for spans in used.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 256
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for i, found in pieces.items():
        ids = [*model.library.encode(text[i] or "", add_special_tokens=False).ids, 1]
        found.sort(key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found))) and sum(r.length for r in found) == len(ids)
        for r in found:
            part = ids[r.start : r.start + r.length]
            assert r.start == 256 * r.piece and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r.ids_crc32
    assert len([r for r in got if r.doc_id == 904]) == 2
    assert packing.pack(empty).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(60)] + [(None, 1), (61, None)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in got)
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)
    assert quality.good_documents(empty, labels).count() == 0 and quality.quality_scores(empty, labels).count() == 0
    bare = docs.select("doc_id", "text")
    assert quality.good_documents(bare, labels.limit(0)).count() == bare.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    same_as_sql(queries.queries()[name](spark, SF), queries.oracle_sql()[name])


def test_held_out_accuracy(spark):
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    good = quality.op10_quality(spark, big).join(labels, "doc_id")
    assert good.filter("keep = (quality = 1)").count() / good.count() > 0.97
    toxic = toxicity.op4_toxicity(spark, big).join(labels, "doc_id").filter("held_out")
    hits = toxic.filter("toxic = 1 and predicted = 1").count()
    assert hits / toxic.filter("toxic = 1").count() > 0.5 and hits / toxic.filter("predicted = 1").count() > 0.7
    scores = lm.op3_lm_scores(spark, SF).filter("held_out")
    assert scores.filter("score > base_score").count() / scores.count() > 0.9

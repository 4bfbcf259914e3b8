"""The numpy kernels against the libraries and brute force; no Spark."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termweave.llm import bpe, decontaminate, linededup, lm, neardup, packing, quality, token_count, topk, toxicity
from termweave.llm.shared import Words, mixed


def joined(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


TEXT = st.text(st.sampled_from("abcXYZ éÀñß.,!?'-09 \n\t▁漢<|>"), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words(texts):
    raw, at = joined(texts)
    w = Words(raw, at)
    got = [[w.raw[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [split(t) for t in texts]
    flat = [x for t in texts for x in split(t)]
    assert len(set(w.hashes().tolist())) == len(set(flat))


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_piece_counts(texts):
    import sentencepiece

    path = token_count.model_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    raw, at = joined([" " + t.replace("▁", " ") for t in texts])
    got = token_count.count_rows(bpe.piece_model(path), raw, at) if texts else []
    assert [int(n) if t else 0 for n, t in zip(got, texts, strict=True)] == [len(x) for x in sp.encode(texts)] if texts else True


@pytest.mark.parametrize("text", ["the" * 400, "x" * 3000, "ab" * 999 + " z", "漢" * 700, "<s>\x00</s>", " " * 40, "👍🏽 e\u0301"])
def test_piece_counts_long(text):
    import sentencepiece

    path = token_count.model_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_count.count_rows(bpe.piece_model(path), *joined([" " + text]))[0] == len(sp.encode(text))


SPECIAL = st.sampled_from(["<|startoftext|>", "<|STARTOFTEXT|>", "<|endoftext|>", "<|EndOfText|>", "<|", "|>", "Ab", " ", "\n", "é"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(SPECIAL, max_size=8).map("".join), min_size=1, max_size=5))
def test_word_ids_of_special_strings(texts):
    test_word_ids.hypothesis.inner_test(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_word_ids(texts):
    model = bpe.word_model(packing.model_path())
    ids, first = packing.encoded_rows(model, *joined(texts))
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == [*model.library.encode(t, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("text", ["it's don't 'S <|endoftext|> x", "ÀÉß× \u00a0 ǅ e\u0301 é", "a" * 900, "12,3 ＡＢ ﬁ ΑΣ", "CIÓN!! ééé"])
def test_word_ids_odd(text):
    model = bpe.word_model(packing.model_path())
    ids, _ = packing.encoded_rows(model, *joined([text]))
    assert ids.tolist() == [*model.library.encode(text, add_special_tokens=False).ids, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_packing_fits(sizes):
    sequence, offset = packing.sum_of_squares(np.array(sizes, np.int64), 50)
    used = {}
    for s, q, o in zip(sizes, sequence.tolist(), offset.tolist(), strict=True):
        assert used.get(q, 0) == o
        used[q] = o + s
        assert used[q] <= 50


def test_packing_is_tight():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.integers(1, 4096, 20_000))[::-1]
    sequence, _ = packing.sum_of_squares(sizes, 4096)
    assert sequence.max() + 1 <= 1.01 * -(-sizes.sum() // 4096)


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.ones(300), rng.integers(1, 5, 300).astype(float)
    sets = [(items[:300], a), (items[60:360], a), (items[:300], b), (items[:5], np.ones(5)), (items[:0], np.ones(0))]
    first = np.concatenate([[0], np.cumsum([len(x) for x, _ in sets])])
    sig = neardup.dart_signatures(np.concatenate([x for x, _ in sets]), np.concatenate([w for _, w in sets]), first, 512)
    assert (sig[4] == 0).all() and (sig[3] != 0).all()
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.08
    assert abs((sig[0] == sig[2]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.08


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert decontaminate.common_subsequence(a, b) == row[-1]


@settings(max_examples=40, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_units_cover_all_words(texts):
    raw, at = joined(texts)
    words, row, idx, first, last = linededup.units_of(raw, at)
    assert (last > first).all() and int((last - first).sum()) == len(words.start)
    assert idx.tolist() == [i for r in range(len(texts)) for i in range(int((row == r).sum()))]


def test_topk_ties_and_large_numbers():
    ids = np.arange(30)
    vectors = np.zeros((30, 3), np.int64)
    vectors[:, 0] = 1
    row, place, score = topk.best_of_block(np.array([5]), np.array([[2, 0, 7]]), ids, vectors, 4)
    assert ids[place].tolist() == [0, 1, 2, 3] and set(score.tolist()) == {2}
    big = np.array([[1 << 70, 1]], object)
    _, _, score = topk.best_of_block(np.array([9]), big, np.array([1]), big, 4)
    assert score.tolist() == [2**63 - 1]


def test_toxicity_learns_and_shares_spelling():
    rng = random.Random(0)
    word = lambda: "".join(rng.choice(["er", "th", "on", "an", "re"]) for _ in range(3))
    texts, labels = [], []
    for k in range(400):
        w = [word() for _ in range(40)]
        if k % 5 == 0:
            w[rng.randrange(40)] = "worthless"
        texts.append(" ".join(w))
        labels.append(int(k % 5 == 0))
    per_gram, bias = toxicity.train(texts, np.array(labels))
    score = lambda t: toxicity.Bags(*joined([t])).scores(per_gram, bias)[0]
    assert score("therthon worthless onan") > 0.5 > score("therthon onanre thanre")
    assert score("therthon worthles5 onan") > score("therthon onanre thanre")
    assert 0 <= score("") <= 1
    none, low = toxicity.train([], np.zeros(0, int))
    assert toxicity.Bags(*joined(["x"])).scores(none, low)[0] < 1e-6


def test_toxicity_scores_by_plain_loops():
    """Words to n-grams, windows to means, documents to soft maxima, one at a time."""
    rng = np.random.default_rng(6)
    per_gram, bias = rng.normal(0, 0.4, toxicity.BUCKETS).astype(np.float32), -0.7
    texts = ["", " \n", "one", "a b c d e f g h", "Some longer TEXT with more words than one window holds, até logo " * 3, "x" * 400, "漢字 <|a|>"]

    def bucket(piece, n):
        total = (n + sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(piece))) % (1 << 64)
        return int(mixed(np.array([total], np.uint64))[0]) & (toxicity.BUCKETS - 1)

    def word(w):
        data = b"\x01" + w.encode() + b"\x02"
        grams = [(data[i : i + n], n) for n in toxicity.NGRAMS for i in range(len(data) - n + 1)]
        return np.mean([per_gram[bucket(g, n)] for g, n in [*grams, (data, 0)]])

    got = toxicity.Bags(*joined(texts)).scores(per_gram, bias)
    for t, s in zip(texts, got, strict=True):
        w = [word(x) for x in split(t)]
        z = np.array([np.mean(w[k : k + toxicity.WINDOW]) + bias for k in range(0, len(w), toxicity.WINDOW)])
        pull = np.exp(toxicity.SHARP * (z - z.max())) if len(z) else 0
        assert abs(s - 1 / (1 + np.exp(-((pull * z).sum() / pull.sum() if len(z) else bias)))) < 1e-5


def test_toxicity_of_one_class():
    texts = ["a b", "c d", "e"]
    for label, low, high in ((0, 0, 1e-6), (1, 0.99, 1)):
        per_gram, bias = toxicity.train(texts, np.full(3, label))
        assert all(low <= s <= high for s in toxicity.Bags(*joined([*texts, ""])).scores(per_gram, bias))


def test_quality_views():
    rng = np.random.default_rng(0)
    y = (rng.random(600) < 0.8).astype(float)
    text, meta = rng.normal(size=(600, 4)), rng.normal(size=(600, 3))
    text[:, 0] += 3 * y
    model = quality.CoTrained().fit(text[:400], meta[:400], y[:400], text[400:], meta[400:])
    both = model.scores(text[400:], meta[400:])[2]
    assert ((both >= 0.5) == (y[400:] == 1)).mean() > 0.85
    alone = quality.CoTrained().fit(text[:0], meta[:0], y[:0], text, meta)
    assert (alone.scores(text, meta)[2] == 1).all()
    assert quality.text_features(*joined(["", "A b!", "x"])).shape == (3, quality.FEATURES)
    assert np.isfinite(quality.text_features(*joined([""]))).all()


def test_class_model_sums_to_one():
    model = lm.Model()
    model.frequent = lm.Frequent(np.array([lm.END], np.uint64), np.array([2]))
    model.n, model.v = 10, 4
    model.size, model.kinds = np.zeros(lm.CLASSES), np.zeros(lm.CLASSES)
    model.size[lm.SINGLE], model.kinds[lm.SINGLE] = 8, 3
    kind = np.full(4, lm.SINGLE)
    assert np.isclose((10 ** model.within(np.array([5, 2, 1, 0]), kind)).sum(), 1)
    weights = np.random.default_rng(0).normal(size=(lm.FEATURES, lm.CLASSES)).astype(np.float32)
    rows = lm.context(np.array([1, 2, 3, 0]), np.array([0, 4]))
    assert np.allclose(lm.class_probabilities(weights, np.zeros(lm.CLASSES, np.float32), rows).sum(1), 1, atol=1e-5)
    assert rows[0].tolist() == [lm.CODES - 1, 1, 2, 3]


def test_checksums_are_little_endian():
    ids = np.array([1, 258], np.uint32)
    assert zlib.crc32(ids.astype("<u4")) == zlib.crc32(b"\x01\0\0\0\x02\x01\0\0")

"""Byte-pair merging of many sequences at once, in numpy.

All sequences of one length form a matrix of symbols.  In each step every row
applies its own lowest-rank adjacent pair (the leftmost of equal ranks), so all
rows that still merge lose exactly one symbol and keep one common length.  Rows
without a mergeable pair leave with the symbols that survive.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np

NONE = np.int32(2**31 - 1)
_SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 15  # rows of a matrix at once
#: A matrix of n symbols a row takes n steps over n columns.  Beyond this length a
#: sequence (a word of hundreds of characters) is merged by itself with a heap, in
#: n log n steps, so that a long text without spaces stays cheap; the result is the same.
LONG = 256


class Merges:
    """Rank and result of each mergeable pair, in an open-addressing table."""

    def __init__(self, left, right, rank, result):
        key = (np.asarray(left, np.uint64) << np.uint64(32)) | np.asarray(right, np.uint64)
        bits = max(4, int(4 * len(key)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.result = np.zeros(1 << bits, np.int32)
        slot = ((key * _SCRAMBLE) >> self.shift).astype(np.int64)
        left_over = np.arange(len(key))
        while len(left_over):
            s = slot[left_over]
            free = self.keys[s] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, pick = np.unique(s[free], return_index=True)
            won = left_over[free][pick]
            at = slot[won]
            self.keys[at], self.rank[at], self.result[at] = key[won], np.asarray(rank)[won], np.asarray(result)[won]
            left_over = np.setdiff1d(left_over, won, assume_unique=True)
            slot[left_over] = (slot[left_over] + 1) & self.mask

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE where there is no merge) and table slots of pairs."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = ((key * _SCRAMBLE) >> self.shift).astype(np.int64)
        found = self.keys[slot]
        rank = self.rank[slot]
        wrong = np.flatnonzero(found != key)
        if len(wrong):
            rank[wrong] = NONE
            wrong = wrong[found[wrong] != np.uint64(0xFFFFFFFFFFFFFFFF)]
            while len(wrong):
                slot[wrong] = (slot[wrong] + 1) & self.mask
                found = self.keys[slot[wrong]]
                hit = found == key[wrong]
                rank[wrong[hit]] = self.rank[slot[wrong[hit]]]
                wrong = wrong[~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return rank, slot


def merge_all(symbols: np.ndarray, first: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merges ragged sequences symbols[first[i]:first[i+1]]; returns them ragged."""
    lengths = np.diff(first)
    out_len = lengths.copy()
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.argsort(lengths, kind="stable")
    cuts = np.searchsorted(lengths[order], np.unique(lengths))
    for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
        n = int(lengths[order[lo]]) if lo < hi else 0
        if not n:
            continue
        if n > LONG:
            for i in order[lo:hi]:
                row = _one_sequence(symbols[first[i] : first[i + 1]], merges)
                out_len[i] = len(row)
                kept.append((np.array([i]), row[None, :]))
            continue
        step = max(1, min(BLOCK, (1 << 21) // n))
        for b in range(lo, hi, step):
            who = order[b : min(hi, b + step)]
            _one_length(who, symbols[first[who][:, None] + np.arange(n)], merges, out_len, kept)
    ends = np.concatenate([[0], np.cumsum(out_len)])
    out = np.empty(ends[-1], np.int32)
    for who, rows in kept:
        out[ends[who][:, None] + np.arange(rows.shape[1])] = rows
    return out, ends


def _one_sequence(symbols: np.ndarray, merges: Merges) -> np.ndarray:
    """The same for one long sequence: pairs wait in a heap by rank and place."""
    sym = symbols.tolist()
    n = len(sym)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    rank, slot = merges.find(symbols[:-1], symbols[1:])
    at = np.flatnonzero(rank < NONE)
    heap = list(zip(rank[at].tolist(), at.tolist(), symbols[at].tolist(), symbols[at + 1].tolist(), merges.result[slot[at]].tolist(), strict=True))
    heapq.heapify(heap)
    known: dict[tuple[int, int], tuple[int, int]] = {}
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i] if sym[i] == a else n
        if j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = new, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for p in (before[i], i):
            q = after[p] if p >= 0 else n
            if q < n:
                pair = sym[p], sym[q]
                if pair not in known:
                    r, s = merges.find(np.array([pair[0]]), np.array([pair[1]]))
                    known[pair] = int(r[0]), int(merges.result[s[0]])
                if known[pair][0] < NONE:
                    heapq.heappush(heap, (known[pair][0], p, *pair, known[pair][1]))
    return np.array([x for x in sym if x >= 0], np.int32)


def _one_length(who, m, merges, out_len, kept):
    n = m.shape[1]
    if n > 1:
        rank, slot = merges.find(m[:, :-1].ravel(), m[:, 1:].ravel())
        rank, slot = rank.reshape(len(m), n - 1), slot.astype(np.int32).reshape(len(m), n - 1)
    while m.shape[1] > 1:
        n = m.shape[1]
        at = rank.argmin(1)
        rows = np.arange(len(m))
        live = rank[rows, at] < NONE
        if not live.all():
            gone = np.flatnonzero(~live)
            kept.append((who[gone], m[gone]))
            out_len[who[gone]] = n
            live = np.flatnonzero(live)
            who, m, rank, slot, at = who[live], m[live], rank[live], slot[live], at[live]
            if not len(who):
                return
            rows = np.arange(len(m))
        # the symbols and ranks right of the pair move one place left
        after = np.arange(n - 1) > at[:, None]
        shifted = np.where(after, m[:, 1:], m[:, :-1])
        shifted[rows, at] = merges.result[slot[rows, at]]
        if n > 2:
            after = after[:, 1:]
            after[rows[at < n - 2], at[at < n - 2]] = True
            rank = np.where(after, rank[:, 1:], rank[:, :-1])
            slot = np.where(after, slot[:, 1:], slot[:, :-1])
            for side in (-1, 0):  # the pairs on either side of the new symbol
                ok = np.flatnonzero((at + side >= 0) & (at + side < n - 2))
                p = at[ok] + side
                rank[ok, p], slot[ok, p] = merges.find(shifted[ok, p], shifted[ok, p + 1])
        m = shifted
    kept.append((who, m))
    out_len[who] = m.shape[1]


class PieceModel:
    """A sentencepiece BPE model with byte fallback, counted exactly.

    No piece holds a non-space before a space mark (checked on loading), so a
    text falls apart at each space mark that follows another character and the
    parts merge independently.  A character outside the model counts as its
    UTF-8 bytes.
    """

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, ids = [], {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                pieces.append((sp.id_to_piece(i), sp.get_score(i)))
        if any(a != self.MARK and b == self.MARK for p, _ in pieces for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece holds a character before a space mark: texts can't be cut at spaces")
        known = {p for p, _ in pieces}
        chars = sorted({c for p in known for c in p})
        for k, p in enumerate([*chars, *sorted(p for p in known if len(p) > 1)]):
            ids[p] = k
        left, right, rank, result = [], [], [], []
        by_rank = {s: k for k, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        for p, score in pieces:
            for cut in range(1, len(p)):
                if (p[:cut] in known or cut == 1) and (p[cut:] in known or cut == len(p) - 1):
                    left.append(ids[p[:cut]])
                    right.append(ids[p[cut:]])
                    rank.append(by_rank[score])
                    result.append(ids[p])
        self.merges = Merges(left, right, np.array(rank, np.int64), np.array(result, np.int32))
        self.unknown = len(ids)
        #: tokens of each symbol: 1, or for single characters that are no piece their bytes
        self.cost = np.ones(len(ids) + 1, np.int64)
        table = np.full(0x110000, self.unknown, np.int32)
        for c in chars:
            table[ord(c)] = ids[c]
            if c not in known:
                self.cost[ids[c]] = len(c.encode())
        self.table = table

    def count(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens of each sequence of code points (space mark included)."""
        sym = self.table[codes]
        # unknown characters: unlike any symbol of a pair, and dear
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        bare = sym == self.unknown
        extra = np.add.reduceat(np.concatenate([np.where(bare, width - 1, 0), [0]]), first[:-1]) * (np.diff(first) > 0) if len(first) > 1 else np.zeros(0, np.int64)
        out, ends = merge_all(sym, first, self.merges)
        if not len(out):
            return np.zeros(len(first) - 1, np.int64)
        total = np.add.reduceat(np.concatenate([self.cost[out], [0]]), ends[:-1]) * (np.diff(ends) > 0)
        return total + extra


@lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


class WordModel:
    """A byte-level BPE with word ends, read from a tokenizers JSON file.

    ``encode`` takes white-space separated words as bytes.  Words made of ASCII
    and the Latin-1 letters are cut and merged here; any other word, and words
    with an apostrophe or an added token's first character, go through the
    tokenizers library.  White space is dropped by the model, so words are
    encoded alike alone and within a text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], np.arange(len(pairs)), np.array([vocab[a + b] for a, b in pairs], np.int32))
        char = byte_characters()
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[char[b] + suffix] for b in range(256)], np.int32)

    def slow(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(words, add_special_tokens=False)]

    def encode(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word raw[start:end], ragged; A-Z are lower-cased here, elsewhere by the library."""
        n = len(start)
        lengths = end - start
        first = np.concatenate([[0], np.cumsum(lengths)])
        flat = raw[np.repeat(start - first[:-1], lengths) + np.arange(first[-1])]
        flat = np.where((flat >= 65) & (flat <= 90), flat + np.uint8(0x20), flat)
        word = np.repeat(np.arange(n), lengths)
        plain, lead = flat < 0x80, flat == 0xC3
        follow = np.zeros(len(flat), bool)
        follow[1:] = lead[:-1]
        # C3 80..9E and A0..BF except the times and division signs are letters; lower case is 20 above
        tail = follow & (flat >= 0x80) & (flat != 0x97) & (flat != 0xB7)
        capital = tail & (flat < 0x9F)
        flat = np.where(capital, flat + np.uint8(0x20), flat)
        good = (plain & (flat != 0x27) & (flat != 0x3C) & (flat > 0x20) & (flat != 0x7F)) | lead | tail
        slow = np.zeros(n, bool)
        slow[word[~good]] = True
        slow[word[lead & ~np.append(tail[1:], False)]] = True
        fast = ~slow[word]
        flat, word = flat[fast], word[fast]
        # runs of letters, single digits, runs of others
        kind = np.full(256, 3, np.int8)
        kind[97:123] = 1
        kind[128:] = 1
        kind[48:58] = 2
        k = kind[flat]
        head = np.ones(len(flat), bool)
        head[1:] = (word[1:] != word[:-1]) | (k[1:] != k[:-1]) | (k[1:] == 2)
        at = np.append(np.flatnonzero(head), len(flat))
        sym = self.inner[flat]
        if len(flat):
            sym[at[1:] - 1] = self.last[flat[at[1:] - 1]]
        out, ends = merge_all(sym, at, self.merges) if len(flat) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        counts = np.bincount(word[at[:-1]], np.diff(ends), n).astype(np.int64) if len(flat) else np.zeros(n, np.int64)
        if not slow.any():
            return out, np.concatenate([[0], np.cumsum(counts)])
        ids = self.slow([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[slow], end[slow], strict=True)])
        fast_counts = counts.copy()
        counts[slow] = [len(x) for x in ids]
        ends = np.concatenate([[0], np.cumsum(counts)])
        whole = np.empty(ends[-1], np.int32)
        is_slow = np.repeat(slow, counts)
        whole[~is_slow] = out
        whole[is_slow] = np.array([i for x in ids for i in x], np.int32)
        assert fast_counts[~slow].sum() == len(out)
        return whole, ends


def byte_characters() -> list[str]:
    """The printable stand-in of each byte, by the public byte-level rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


@lru_cache(2)
def word_model(path: str) -> WordModel:
    return WordModel(path)

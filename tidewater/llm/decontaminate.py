"""Benchmark decontamination by latent semantic retrieval, verified by longest common subsequences and answer checks.

Passages are windows of WINDOWS words, half of a window apart, over whole texts, as TF-IDF vectors over the words of
the benchmark; the document frequencies are counted over all documents. One latent space serves all items: the leading
directions of all documents, cut into pieces of PIECE words so that every word counts once, and of all items, by a
randomised range finder on the items, a pass over all documents and a Nystroem approximation. Each executor multiplies
its pieces with the sketch, the driver sees sums only. Every passage of every document that holds a benchmark word (others are the zero
vector) is searched for items by cosine in that space, and a passage found near an item is compared with it word by
word, in order. Only benchmark words can be part of a common subsequence, so what is compared is their order alone.

Items are searched in blocks of BLOCK_ITEMS, which share the space, so what is found does not depend on the block.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Items sent to executors at once; more are searched in further blocks. Words of all items at most: the space, of
#: DIMENSIONS floats a word, is broadcast (256 MB at the bound).
BLOCK_ITEMS, MAX_WORDS = 1000, 500_000
WINDOWS = (16, 48)
#: Words of a piece of text in the decomposition. Halves of all WINDOWS are multiples of BLOCK words.
PIECE, BLOCK = 48, 8
#: Most frequent words, whose products are dense.
COMMON = 256
DIMENSIONS, OVERSAMPLE = 128, 16
#: Cosine in the latent space from which a passage is a candidate: a passage that holds six tenths of an item's words
#: lies above it, as the other words of text are common and weigh little.
COSINE = 0.55
#: Passages searched at once, characters of texts that are read together, and comparisons that wait for each other.
_AT_ONCE, _CHARS_AT_ONCE, _PAIRS_AT_ONCE = 512, 1 << 19, 1 << 19
#: Share of an item's words, in order, that make a leak; and that do if the item's answer is there as well.
SAME, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
_WORDS = re.compile(r"[^\W_]+").findall
LEAKS = "array<struct<item_id:bigint,common:double,cosine:double>>"


def words_of(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def answer_of(text: str | None) -> list[str]:
    """The words of an item's last sentence that has at least two, else all its words: what a leak gives away."""
    parts = [words_of(x) for x in re.split(r"[.?!:]\s", text or "")]
    return next((p for p in reversed(parts) if len(p) >= 2), words_of(text))


def common_subsequence(masks: dict, size: int, words: list) -> int:
    """Length of the longest common subsequence of an item of size words (masks: the bits of each word's places) and words."""
    full = (1 << size) - 1
    row = full
    for w in words:
        if m := masks.get(w):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def masks_of(words: list) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


@cache
def _letters() -> np.ndarray:
    """Whether each character is part of words_of's words."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


@cache
def _values() -> np.ndarray:
    return np.random.default_rng(0).integers(0, 1 << 64, 0x110000, dtype=np.uint64)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.cumprod(np.full(1 << bits, x, dtype=np.uint64), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))


def _hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of words_of of some texts, one text after the other, and the number of words of each.

    The sum of the values of a word's characters times powers by place, which makes hashes of words differences of sums.
    """
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    part = _letters()[codes]
    edges = np.flatnonzero(part[1:] != part[:-1]) + 1
    start, stop = edges[::2], edges[1::2]
    up, down = _powers(max(20, len(codes).bit_length()))
    total = np.cumsum(_values()[codes] * up[: len(codes)], dtype=np.uint64)
    ends = np.cumsum([len(x) + 1 for x in lowered])
    return (total[stop - 1] - total[start - 1]) * down[start], np.diff(np.searchsorted(start, ends, side="right"), prepend=0)


def _together(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """The texts in lists of some _CHARS_AT_ONCE characters; a longer text is whole in its list."""
    waiting, held = [], 0
    for text in texts:
        waiting.append(text)
        held += len(text or "") + 1
        if held > _CHARS_AT_ONCE:
            yield waiting
            waiting, held = [], 0
    if waiting:
        yield waiting


class Numbering:
    """Numbers of words, -1 for words that have none, found by hash in a table by the hash's first bits."""

    def __init__(self, words: list[str]) -> None:
        own, sizes = _hashes(words)
        assert len(own) == len(words) and (sizes == 1).all()
        self.order = np.argsort(own)
        self.sorted = own[self.order]
        if (self.sorted[1:] == self.sorted[:-1]).any():
            raise ValueError("two words of the benchmark have the same hash")
        bits = max(8, len(words).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        slot = (self.sorted >> self.shift).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange(1 << bits))
        self.most = int(np.bincount(slot).max())

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of some texts, one text after the other, and the number of words of each text."""
        own, sizes = _hashes(texts)
        out = np.full(len(own), -1, dtype=np.int64)
        at = self.first[(own >> self.shift).astype(np.int64)]
        for k in range(self.most):
            where = np.minimum(at + k, len(self.sorted) - 1)
            hit = self.sorted[where] == own
            out[hit] = self.order[where[hit]]
        return out, sizes


@dataclass
class Space:
    """The words of all items, their numbers, their idf, and rows: idf times a word's place in the latent space; a last row of zeros."""

    ids: dict[str, int]
    idf: np.ndarray
    numbering: Numbering | None = None
    rows: np.ndarray | None = None

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word, -1 for words of no item."""
        get = self.ids.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))

    def project(self, words: list[str]) -> np.ndarray:
        row = self.rows[self.numbers(words)].sum(0)  # the last row, of no word, is zero
        return row / max(np.linalg.norm(row), 1e-12)


def _sums(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows named in each line of at, some lines at a time."""
    out = np.empty((len(at), rows.shape[1]), dtype=rows.dtype)
    for k in range(0, len(at), _AT_ONCE):
        part = at[k : k + _AT_ONCE]
        out[k : k + _AT_ONCE] = rows[part[:, 0]]
        for j in range(1, at.shape[1]):
            out[k : k + _AT_ONCE] += rows[part[:, j]]
    return out


@dataclass
class Index:
    """One block of items: ids, places in the space, words and answers as numbers, sizes in words, idf of all words."""

    item_ids: list
    items: np.ndarray
    words: list[list[int]]
    answers: list[list[int]]
    sizes: np.ndarray
    idf: np.ndarray
    masks: np.ndarray | None = None  # (items, words + 1): the bits of a word's places, for items of up to 64 words
    needed: np.ndarray | None = None  # the fewest words of a leak in common with each item
    tell: np.ndarray | None = None  # so many of an item's rarest words a leak must hold
    rare: tuple[np.ndarray, np.ndarray] | None = None  # by word: where its part of the items begins that have it among those

    def ready(self) -> None:
        """Fill in the tables of an index that has just been sent.

        A leak lacks at most an item's size less needed of its words. So of that number and tell more, the item's rarest
        ones, it holds at least tell: what holds fewer is no leak and needs no comparison.
        """
        if self.masks is not None:
            return
        size = len(self.idf)
        self.masks = np.zeros((len(self.items), size + 1), dtype=np.uint64)
        self.needed = np.ceil(PARAPHRASE * self.sizes - 1e-9).astype(np.int64)
        self.tell = np.maximum(1, self.needed // 3)
        pairs = []
        for i, words in enumerate(self.words):
            if len(words) <= 64:
                for w, bits in masks_of(words).items():
                    self.masks[i, w] = bits
            rarest = sorted(words, key=lambda w: (-self.idf[w], w))[: self.sizes[i] - self.needed[i] + self.tell[i]]
            pairs += [(w, i) for w in set(rarest)]
        pairs.sort()
        self.rare = np.searchsorted([w for w, _ in pairs], np.arange(size + 1)), np.array([i for _, i in pairs], dtype=np.int64)

    def leaks(self, space: Space, texts: list[str | None]) -> list[list[dict]]:
        """The leaks of each of some texts, which are searched together.

        The places of a text's words follow those of the text before by a gap wider than any comparison reaches.
        """
        if not self.item_ids:
            return [[] for _ in texts]
        self.ready()
        at, size = space.numbering(texts)
        own = np.flatnonzero(at >= 0)
        if not len(own):
            return [[] for _ in texts]
        unit = BLOCK * int(np.lcm.reduce([w // 2 // BLOCK for w in WINDOWS]))
        gap, many = int(2 * self.sizes.max() + max(WINDOWS)), len(self.item_ids)
        wide = -(-(size + gap) // unit) * unit
        offset = np.cumsum(wide) - wide
        places = np.arange(len(at)) + np.repeat(offset - np.cumsum(size) + size, size)
        length = (int(wide.sum()) // unit + 2) * unit
        # sums of blocks of words, of which all passages are made; the last row, of words of no item, is zero
        dense = np.full(length, -1, dtype=np.int64)
        dense[places] = at
        sums = _sums(space.rows, dense.reshape(-1, BLOCK))
        places, known = places[own], at[own]
        rank = np.zeros(length + gap, dtype=np.int64)  # known words before a place
        rank[places + 1] = 1
        np.cumsum(rank, out=rank)
        # the places of each item's rarest words
        from_, items_of = self.rare
        often = from_[known + 1] - from_[known]
        item = items_of[np.repeat(from_[known] - np.cumsum(often) + often, often) + np.arange(often.sum())]
        signs = np.sort(item * len(rank) + np.repeat(places, often))
        found: dict[int, tuple[float, float]] = {}
        waiting: list[tuple] = []
        for w in WINDOWS:
            half = w // 2
            number = -(-np.maximum(1, size - half) // half)
            begin = np.repeat(offset - half * (np.cumsum(number) - number), number) + half * np.arange(number.sum())
            owner = np.repeat(np.arange(len(texts)), number)
            end = np.minimum(begin + w, (offset + size)[owner])
            some = np.flatnonzero(rank[end] > rank[begin])
            begin, end, owner = begin[some], end[some], owner[some]
            for k in range(0, len(begin), _AT_ONCE):
                b = begin[k : k + _AT_ONCE] // BLOCK
                vectors = sums[b]
                for j in range(1, w // BLOCK):
                    vectors += sums[b + j]
                near = vectors @ self.items.T
                norm = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                hit = np.flatnonzero(near >= np.float32(COSINE) * norm)
                rows, items = hit // many, hit % many
                # about a passage there must be the item's rarest words that a leak holds, and as many benchmark words
                start, stop = np.maximum(begin[k + rows] - self.sizes[items], 0), end[k + rows] + self.sizes[items]
                key = items * len(rank)
                good = np.flatnonzero(np.searchsorted(signs, key + stop) - np.searchsorted(signs, key + start) >= self.tell[items])
                rows, items, start, stop = rows[good], items[good], rank[start[good]], rank[stop[good]]
                good = np.flatnonzero(stop - start >= self.needed[items])
                rows, items = rows[good], items[good]
                waiting.append((items, start[good], stop[good], owner[k + rows], near[rows, items] / norm[rows, 0]))
                if sum(len(x[0]) for x in waiting) > _PAIRS_AT_ONCE:
                    self.compare(known, waiting, found)
                    waiting = []
        if waiting:
            self.compare(known, waiting, found)
        out: list[list[dict]] = [[] for _ in texts]
        for key, (common, cosine) in sorted(found.items()):
            out[key // many].append({"item_id": self.item_ids[key % many], "common": round(common, 6), "cosine": round(min(cosine, 1.0), 6)})
        return out

    def compare(self, known: np.ndarray, waiting: list[tuple], found: dict[int, tuple[float, float]]) -> None:
        """Puts the leaks of pairs of an item and the words known[start:stop] into found, by owner and item."""
        items, start, stop, owner, cosine = (np.concatenate(x) for x in zip(*waiting, strict=True))
        # words compared with an item within others compared with it say nothing more
        order = np.lexsort((-cosine, -stop, start, items))
        reach = items[order] * (len(known) + 1) + stop[order]
        before = np.maximum.accumulate(np.append(-1, reach))[:-1]
        wide = order[(reach > before) | (before < items[order] * (len(known) + 1))]
        items, start, stop, owner, cosine = items[wide], start[wide], stop[wide], owner[wide], cosine[wide]
        length = self.lengths(items, known, start, stop)
        for p in np.flatnonzero(length >= self.needed[items]):
            item, common = int(items[p]), float(length[p] / self.sizes[items[p]])
            key = int(owner[p]) * len(self.item_ids) + item
            if common > found.get(key, (0.0,))[0] and (common >= SAME or self.told(item, known[start[p] : stop[p]].tolist())):
                found[key] = (common, float(cosine[p]))

    def lengths(self, items: np.ndarray, known: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of items and the words known[start:stop], many pairs at a time."""
        out = np.zeros(len(items), dtype=np.int64)
        small = self.sizes[items] <= 64
        for p in np.flatnonzero(~small):
            out[p] = common_subsequence(masks_of(self.words[items[p]]), int(self.sizes[items[p]]), known[start[p] : stop[p]].tolist())
        order = np.flatnonzero(small)
        order = order[np.argsort((stop - start)[order], kind="stable")]
        padded = np.append(known, self.masks.shape[1] - 1)
        for k in range(0, len(order), 4096):
            some = order[k : k + 4096]
            which, a, b = items[some], start[some], stop[some]
            base, flat = which * self.masks.shape[1], self.masks.ravel()
            row = np.full(len(some), np.uint64(0xFFFFFFFFFFFFFFFF))
            steps = b - a  # ascending
            for j in range(int(steps[-1])):
                live = np.searchsorted(steps, j, side="right")
                r = row[live:]
                hit = r & flat[base[live:] + padded[a[live:] + j]]
                row[live:] = (r + hit) | (r - hit)
            full = np.left_shift(np.uint64(1), np.minimum(self.sizes[which], 63).astype(np.uint64)) - np.uint64(1)
            full[self.sizes[which] == 64] = np.uint64(0xFFFFFFFFFFFFFFFF)
            out[some] = self.sizes[which] - np.bitwise_count(row & full)
        return out

    def told(self, item: int, around: list[int]) -> bool:
        answer = self.answers[item]
        return common_subsequence(masks_of(answer), len(answer), around) >= ANSWER * len(answer)


def _frequencies(docs: DataFrame, numbering: Numbering, size: int) -> tuple[np.ndarray, int]:
    """Document frequency of each benchmark word, over all documents, and the number of documents."""
    sent = docs.sparkSession.sparkContext.broadcast(numbering)  # of at most MAX_WORDS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(size + 1, dtype=np.int64)
        for part in batches:
            for texts in _together(part["text"]):
                at, sizes = sent.value(texts)
                owner, own = np.repeat(np.arange(len(texts)), sizes), at >= 0
                np.add.at(counts, np.unique(owner[own] * size + at[own]) % size, 1)
                counts[size] += len(texts)
        k = np.flatnonzero(counts)
        yield pd.DataFrame({"k": k.astype(np.int32), "n": counts[k]})

    found = np.zeros(size + 1, dtype=np.int64)
    for r in docs.select("text").mapInPandas(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        found[r["k"]] = r["n"]
    return found[:size], int(found[size])


def _times(space: Space, texts: list[str | None], q: np.ndarray, common: np.ndarray, out: np.ndarray, piece: int | None = PIECE) -> None:
    """Adds A'Aq to out, for the unit TF-IDF rows A of the pieces of texts (None: of whole texts). common: COMMON words.

    Words in common go through dense products, others are gathered: what is summed is the same.
    """
    at, sizes = space.numbering(texts)
    own = np.flatnonzero(at >= 0)
    if not len(own):
        return
    piece, many = piece or int(sizes.max()), len(space.idf)
    pieces = -(-sizes // piece)
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, word = (np.repeat(np.cumsum(pieces) - pieces, sizes) + place // piece)[own], at[own]
    key, often = np.unique(row * many + word, return_counts=True)
    row, word = key // many, key % many
    value = often * space.idf[word]
    value = (value / np.sqrt(np.bincount(row, value * value))[row]).astype(q.dtype)
    column = np.searchsorted(common, word)
    dense = common[np.minimum(column, len(common) - 1)] == word
    a = np.zeros((int(pieces.sum()), len(common)), dtype=q.dtype)
    a[row[dense], column[dense]] = value[dense]
    y = a @ q[common]
    row, word, value = row[~dense], word[~dense], value[~dense]
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        y[row[first]] += np.add.reduceat(q[word].T * value, first, axis=1).T
        order = np.argsort(word, kind="stable")
        row, word, value = row[order], word[order], value[order]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] += np.add.reduceat(y[row].T * value, first, axis=1).T
    out[common] += a.T @ y


def _decompose(space: Space, docs: DataFrame, items: list[str]) -> None:
    """Sets the latent space: the leading right singular vectors of the items and of the pieces of all documents.

    With an orthonormal basis Q of the range of the items, found at random, A'A is near (A'AQ) (Q'A'AQ)^-1 (A'AQ)'.
    """
    context, size = docs.sparkSession.sparkContext, len(space.ids)
    width = min(size, DIMENSIONS + OVERSAMPLE)
    common = np.sort(np.argsort(space.idf, kind="stable")[:COMMON])
    summed = np.zeros((size, width))
    _times(space, items, np.random.default_rng(0).standard_normal((size, width)), common, summed, None)
    q = np.linalg.qr(summed)[0]
    sent = context.broadcast((space, q.astype(np.float32), common))  # of at most MAX_WORDS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sketch, often = sent.value
        out = np.zeros(sketch.shape)
        for part in batches:
            for some in _together(part["text"]):
                _times(own, some, sketch, often, out)
        k = np.flatnonzero(np.abs(out).sum(1))
        for some in (k[i : i + 1000] for i in range(0, len(k), 1000)):
            yield pd.DataFrame({"k": some.astype(np.int32), "v": list(out[some].astype(np.float32))})

    summed = np.zeros((size, width))
    _times(space, items, q, common, summed, None)
    # rows of partial products, summed by row on executors; a task yields a table of them: not more tasks than keep all cores busy
    texts = docs.select("text").coalesce(2 * context.defaultParallelism)
    parts = texts.mapInPandas(run, "k int, v array<float>").groupBy("k").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).alias("v"))
    for r in parts.toLocalIterator():
        summed[r["k"]] += np.array(r["v"])
    core = q.T @ summed
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-6 * values.max()
    left, strong, _ = np.linalg.svd(summed @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    best = strong[:DIMENSIONS] > 1e-4 * strong[0]
    space.rows = np.append(left[:, :DIMENSIONS][:, best] * space.idf[:, None], np.zeros((1, best.sum())), axis=0).astype(np.float32)


def build(docs: DataFrame, items: list[tuple]) -> tuple[Space, list[Index]]:
    """The space of all (item_id, text) that have words, and their blocks."""
    kept = [(i, words_of(t), answer_of(t)) for i, t in items if words_of(t)]
    vocabulary = sorted({w for _, x, _ in kept for w in x})
    if len(vocabulary) > MAX_WORDS:
        raise ValueError(f"the benchmark has {len(vocabulary)} different words, more than {MAX_WORDS}: split it")
    if not kept:
        return Space({}, np.zeros(0)), []
    numbering = Numbering(vocabulary)
    counts, n = _frequencies(docs, numbering, len(vocabulary))
    space = Space({w: i for i, w in enumerate(vocabulary)}, np.log((n + 1) / (counts + 1)) + 0.01, numbering)
    _decompose(space, docs, [" ".join(x) for _, x, _ in kept])
    blocks = []
    for k in range(0, len(kept), BLOCK_ITEMS):
        part = kept[k : k + BLOCK_ITEMS]
        numbers = lambda x: space.numbers(x).tolist()
        blocks.append(Index([i for i, _, _ in part], np.array([space.project(x) for _, x, _ in part], dtype=np.float32), [numbers(x) for _, x, _ in part], [numbers(a) for _, _, a in part], np.array([len(x) for _, x, _ in part]), space.idf))
    return space, blocks


def _search(spark: SparkSession, space: Space, index: Index):
    sent, words = spark.sparkContext.broadcast(index), spark.sparkContext.broadcast(space)  # of one block; of at most MAX_WORDS

    @F.pandas_udf(LEAKS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([x for some in _together(texts) for x in sent.value.leaks(words.value, some)], dtype=object)

    return run


def leak_column(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> Column:
    """The leaks (item_id, common, cosine) of each row of docs (doc_id, text)."""
    rows = [(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").toLocalIterator()]
    space, blocks = build(docs, sorted(rows, key=repr))
    found = [_search(docs.sparkSession, space, index)(F.col(text)) for index in blocks]
    if not found:
        return F.array().cast(LEAKS)
    return F.concat(*found) if len(found) > 1 else found[0]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, common (share of the item's words found in order) and cosine, a row per leak; clean documents have none.

    Null and empty texts and items, and those without words, match nothing. Equal items are found each. Repeated rows
    are searched one by one; columns beside doc_id, text and item_id are not read. Empty tables give no rows.
    """
    plain = docs.select("doc_id", "text")
    return plain.select("doc_id", F.explode(leak_column(plain, benchmark)).alias("leak")).select("doc_id", "leak.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that leak no item."""
    return docs.filter(F.size(leak_column(docs, benchmark)) == 0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answer checks.

Fit. Every different text is written once, as the buckets of its hashed words, with the number of its copies. Document frequencies are counted
over all documents. The passages of ``PASSAGE`` words of all different texts (each once however often it occurs) form a TF-IDF matrix A;
its right singular vectors come from a distributed
randomised SVD in one pass: tasks sum A'A times a random test matrix, and the driver solves the small problem. Word
vectors are the rows of the singular vectors, scaled to the word's IDF; a second pass over the same passages takes mean and covariance
of their vectors, and the search uses the whitened space, in which unrelated passages are far apart.

Search. Every document is covered by overlapping windows of lengths 16, 32 and 64 words, and every benchmark piece (at most 64 words) is
compared by cosine with the windows of its length class. Candidates must share some of the piece's IDF; windows whose words are known by an upper
bound to share too little with all pieces of a block get no vector. Both bounds lie so low that of
items of which 55 % to 70 % of the words are left in order nine in ten and more reach the next step (tested against LCS of everything). Then the longest common
subsequence of words is computed bit-parallel. A piece is found if LCS / length reaches ``LCS``, or, for a paraphrase, ``LCS_PARAPHRASE``
and its answer (what follows a final ``Answer:``, else its last sentence) occurs almost whole and in order.

Broadcast are the word vectors (``BUCKETS`` times ``RANK`` floats) and at most ``ITEMS_PER_PASS`` pieces at a time, of which a worker
holds the vectors, a bit for each bucket, and for each 32 pieces a bound for each bucket, 8 KB a piece. The benchmark is the stated query set: every window meets every piece of its class, in blocks.

Defined cases: null and empty documents have no hits; items without words are skipped; items that share an id are one,
reported with their best piece; documents shorter than a window are one window; equal documents have equal hits; where the passages span
fewer directions than the rank, the others are random ones, as the range finder leaves them, of the scale of the least singular value that counts; extra columns pass through, one named like the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import blocks, give_back, raw_bytes, word_hashes

BUCKETS = 1 << 15
RANK, EXTRA, DROPPED = 64, 12, 4
PASSAGE = 64
#: Bytes of text, words and passages that a task handles at a time.
TEXT_BYTES = 1 << 18
WORDS_AT_ONCE, PASSAGES = 1 << 18, 256
#: Entries of passages that are added to the buckets together, and of these the rows that are gathered at a time.
ENTRIES, ENTRIES_AT_ONCE = 1 << 21, 1 << 13
SEGMENT = 4
CLASSES = (16, 32, 64)
COSINE = 0.35
SHARED = 0.35
LCS, LCS_PARAPHRASE, ANSWER = 0.7, 0.55, 0.9
ITEMS_PER_PASS, ITEM_BLOCK = 20_000, 256
#: Pieces of a block that share one bound of what a window can share with any of them; windows whose vectors are summed at a time.
BOUND_GROUP, WINDOWS_AT_ONCE = 32, 1 << 12
HITS = "array<struct<item_id:long,cosine:double,lcs:double,answer:boolean>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.bool_())]))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of each text's words, two bytes each."""
    for batch in batches:
        for row, part in blocks(batch.column("text"), TEXT_BYTES):
            hashes, bounds = word_hashes(part)
            words = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(_bucket(hashes).astype("<u2"))])
            yield pa.record_batch([batch.column("hash").slice(row, len(part)), words], names=["hash", "words"])


def _packed(batch: pa.RecordBatch, most: int = WORDS_AT_ONCE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, buckets, bounds of the rows) of slices of about ``most`` words, or one row."""
    data, offsets = raw_bytes(batch.column("words"))
    data, bounds = data.view("<u2"), offsets // 2
    row = 0
    while row < batch.num_rows:
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        yield row, data[bounds[row] : bounds[to]], bounds[row : to + 1] - bounds[row]
        row = to


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        times = batch.column("n").to_numpy()
        n += int(times.sum())
        for row, word, bounds in _packed(batch):
            pairs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * BUCKETS + word
            pairs = np.sort(pairs.astype(np.uint32) if len(bounds) * BUCKETS <= 1 << 32 else pairs)
            once = pairs[np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))].astype(np.int64) if len(pairs) else pairs.astype(np.int64)
            total += np.bincount(once & (BUCKETS - 1), times[row + once // BUCKETS], BUCKETS).astype(np.int64)
    give_back()
    yield pa.record_batch([pa.array([-1, *range(BUCKETS)], pa.int64()), pa.array([n, *total], pa.int64())], names=["cell", "n"])


def word_weights(packed: DataFrame) -> np.ndarray:
    """Inverse document frequency of every bucket, over the texts of ``packed`` (words, n), each as often as ``n`` says."""
    counts = packed.select("words", "n").mapInArrow(_count_words, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(BUCKETS + 1)
    table[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    return np.log((table[-1] + 1) / (table[:-1] + 1)).astype(np.float32)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Word counts of up to PASSAGES passages at a time: (passage, bucket, count, number of passages), by passage and bucket."""
    for batch in batches:
        for _, word, bounds in _packed(batch):
            at = np.arange(len(word)) - np.repeat(bounds[:-1], np.diff(bounds))
            starts = np.append(np.flatnonzero(at % PASSAGE == 0), len(word))
            for lo in range(0, len(starts) - 1, PASSAGES):
                cuts = starts[lo : lo + PASSAGES + 1]
                of = np.repeat(np.arange(len(cuts) - 1, dtype=np.uint32), np.diff(cuts))
                cells = np.sort(of * np.uint32(BUCKETS) + word[cuts[0] : cuts[-1]])
                first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                cells = cells[first].astype(np.int64)
                yield cells // BUCKETS, cells % BUCKETS, np.diff(np.append(first, cuts[-1] - cuts[0])), len(cuts) - 1
    give_back()


def _runs_times(values: np.ndarray, rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each run of rows, from one of ``cuts`` to the next, their sum, each times its value."""
    out = np.empty((len(cuts) - 1, rows.shape[1]), np.float32)
    at = cuts.tolist()
    for k in range(len(out)):
        np.dot(values[at[k] : at[k + 1]], rows[at[k] : at[k + 1]], out=out[k])
    return out


def _times(of: np.ndarray, word: np.ndarray, values: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
    """The passages, a sparse matrix of ``values`` by passage and bucket, times ``rows`` of all buckets."""
    return _runs_times(values, rows.take(word, 0, mode="clip"), np.searchsorted(of, np.arange(n + 1)))


class _Transposed:
    """Adds transposed passages times rows of each passage to ``total``.

    Entries are kept until there are ``ENTRIES``, then added bucket by bucket: in so many passages most buckets occur often, and each is one product.
    """

    def __init__(self, total: np.ndarray):
        self.total = total
        self._empty()

    def _empty(self) -> None:
        self.parts, self.low, self.passages, self.entries = [], [], 0, 0

    def add(self, of: np.ndarray, word: np.ndarray, values: np.ndarray, low: np.ndarray) -> None:
        self.parts.append(((of + self.passages).astype(np.uint32), word.astype(np.uint16), values))
        self.low.append(low)
        self.passages += len(low)
        self.entries += len(of)
        if self.entries >= ENTRIES:
            self.flush()

    def flush(self) -> None:
        if not self.entries:
            return
        of, word, values = (np.concatenate(x) for x in zip(*self.parts))
        low = np.concatenate(self.low)
        self._empty()
        order = np.argsort(word, kind="stable")
        of, word, values = of[order], word[order], values[order]
        cuts = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), len(word))
        lo = 0
        while lo < len(cuts) - 1:
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + ENTRIES_AT_ONCE, "right")) - 1)
            at = slice(cuts[lo], cuts[hi])
            self.total[word[cuts[lo:hi]]] += _runs_times(values[at], low.take(of[at], 0, mode="clip"), cuts[lo : hi + 1] - cuts[lo])
            lo = hi


def _test_matrix() -> np.ndarray:
    rng = np.random.default_rng(11)
    out = np.empty((BUCKETS, RANK + EXTRA), np.float32)
    for lo in range(0, BUCKETS, 4096):
        out[lo : lo + 4096] = rng.standard_normal((4096, RANK + EXTRA))
    return out


def _project(shared):
    """Rows of A'A times the test matrix, in fixed point, so that sums don't depend on their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, test = shared.value, _test_matrix()
        total = np.zeros(test.shape)
        transposed = _Transposed(total)
        for of, word, counts, n in _passages(batches):
            x = (1 + np.log(counts)).astype(np.float32) * idf[word]
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            x /= (np.sqrt(np.add.reduceat(x * x, starts)) + 1e-6)[of]
            transposed.add(of, word, x, _times(of, word, x, n, test))
        transposed.flush()
        some = np.flatnonzero(np.abs(total).sum(1))
        for lo in range(0, len(some), 4096):
            at = some[lo : lo + 4096]
            yield pa.record_batch([pa.array(at), *[pa.array(c) for c in np.rint(total[at].T * 2**24).astype(np.int64)]], names=["cell", *[f"y{k}" for k in range(test.shape[1])]])

    return run


def _moments(shared):
    """Sums of the passages' unit vectors and of their products, in fixed point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        rank = vectors.shape[1]
        total = np.zeros((rank + 1, rank))
        n = 0
        for of, word, counts, passages in _passages(batches):
            v = _times(of, word, counts.astype(np.float32), passages, vectors).astype(np.float64)
            v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-9
            total[0] += v.sum(0)
            total[1:] += v.T @ v
            n += passages
        flat = np.rint(np.append(total.ravel(), n) * 2**20).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "n"])

    return run


@dataclass
class Space:
    """Word vectors, and the whitening of sums of them."""

    idf: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    turn: np.ndarray

    def place(self, sums: np.ndarray) -> np.ndarray:
        """Unit vectors in the whitened space of sums of word vectors."""
        v = sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-9)
        v = (v - self.mean) @ self.turn
        return (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)).astype(np.float32)


def fit(docs: DataFrame, text: str = "text", fit_rows: int | None = None) -> Space:
    """The latent space of all texts of ``docs``; of about ``fit_rows`` different ones where a bound is given."""
    from ..runtime import discard, persist, ship

    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select(F.xxhash64("text").alias("hash"), "text")
    # Each text once, with the number of its copies: a task's copies meet before the shuffle.
    packed = texts.mapInArrow(_pack_words, "hash long, words binary").groupBy("hash").agg(F.first("words").alias("words"), F.count("*").alias("n"))
    packed = persist(spark, packed, "decontaminate-words")
    idf = word_weights(packed)
    used = packed
    if fit_rows is not None:
        used = packed.where(F.pmod(F.col("hash"), F.lit(1_000_003)) < int(min(1.0, fit_rows / max(packed.count(), 1)) * 1_000_003) + 1)
    width = RANK + EXTRA
    weights = spark.sparkContext.broadcast(idf)
    rows = used.select("words").mapInArrow(_project(weights), ", ".join(["cell long", *[f"y{k} long" for k in range(width)]]))
    rows = rows.groupBy("cell").agg(*[F.sum(f"y{k}").alias(f"y{k}") for k in range(width)]).toArrow()
    y = np.zeros((BUCKETS, width))
    cell = rows["cell"].to_numpy()
    for k in range(width):
        y[cell, k] = rows[f"y{k}"].to_numpy() / 2**24
    del rows
    vectors = _singular_vectors(y)
    del y
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9
    vectors *= idf[:, None]
    vectors = vectors.astype(np.float32)
    shared = spark.sparkContext.broadcast(vectors)
    sums = used.select("words").mapInArrow(_moments(shared), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    discard(packed)
    weights.destroy()
    shared.destroy()
    give_back()
    rank = vectors.shape[1]
    flat = np.zeros((rank + 1) * rank + 1)
    flat[sums["cell"].to_numpy()] = sums["n"].to_numpy() / 2**20
    passages = max(flat[-1], 1.0)
    mean = flat[:rank] / passages
    spread, turn = np.linalg.eigh(flat[rank:-1].reshape(rank, rank) / passages - np.outer(mean, mean))
    return Space(idf, vectors, mean.astype(np.float32), (turn / np.sqrt(np.maximum(spread, 0) + 0.05 * max(spread.mean(), 1e-9))).astype(np.float32))


def _singular_vectors(y: np.ndarray) -> np.ndarray:
    """Right singular vectors from one product of A'A with the test matrix (Nystrom's method), but the first few, each over its singular value.

    ``y`` is overwritten, part by part, and the vectors come from its small Gram matrix, so that the driver holds little besides it.
    """
    test = _test_matrix()
    shift = 1e-6 * (np.linalg.norm(y) + 1e-9)
    parts = [slice(lo, lo + 4096) for lo in range(0, len(y), 4096)]
    core = np.zeros((y.shape[1], y.shape[1]))
    for at in parts:
        own = test[at].astype(np.float64)
        y[at] += shift * own
        core += own.T @ y[at]
    core = (core + core.T) / 2
    lower = np.linalg.cholesky(core + 1e-9 * max(np.trace(core), 1e-9) * np.eye(len(core)))
    for at in parts:
        y[at] = np.linalg.solve(lower, y[at].T).T
    square, turn = np.linalg.eigh(y.T @ y)
    s = np.sqrt(np.maximum(square[::-1], 1e-300))
    return y @ (turn[:, ::-1] / s / np.maximum(s, 1e-3 * s[0]))[:, DROPPED:RANK]


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    ones = row = (1 << len(a)) - 1
    for x in b:
        found = row & places.get(x, 0)
        if found:
            row = (row + found | row - found) & ones
    return len(a) - row.bit_count()


_MARK = re.compile(r"(?is).*\banswers?\s*:\s*(?=\S)")


def answer_of(text: str) -> str:
    """What follows the last ``Answer:``, else the last sentence, else all."""
    marked = _MARK.match(text)
    if marked:
        return text[marked.end() :]
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if re.search(r"\w", s)]
    return sentences[-1] if sentences else text


@dataclass
class Items:
    """Benchmark pieces: item id, words, words of the item's answer; their class, mask of buckets and IDF."""

    ids: list
    words: list[list[int]]
    answers: list[list[int]]


def prepare_items(rows: list[tuple[int | None, str | None]]) -> Items:
    out = Items([], [], [])
    for item_id, text in rows:
        words = word_hashes(pa.array([text or ""]))[0].tolist()
        answer = word_hashes(pa.array([answer_of(text or "")]))[0].tolist()
        n = -(-len(words) // CLASSES[-1])
        for k in range(n):
            out.ids.append(item_id)
            out.words.append(words[k * len(words) // n : (k + 1) * len(words) // n])
            out.answers.append(answer)
    return out


def _reach(bound: np.ndarray, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether the bounds of the words ``lo`` to ``hi`` add up to 1 for some group, or all where most do; what rounding may take is granted."""
    found = np.zeros(len(lo), bool)
    upto = np.zeros(len(word) + 1)
    for own in bound:
        np.cumsum(own[word], out=upto[1:])
        found |= upto[hi] - upto[lo] >= 1 - 1e-4
        if 2 * np.count_nonzero(found) > len(found):  # too few would be left out to pay for it
            return np.ones(len(lo), bool)
    return found


def _class_of(n: int) -> int:
    return next((c for c in CLASSES if n < 1.5 * c), CLASSES[-1])


class Searcher:
    def __init__(self, space: Space, items: Items):
        self.space, self.items = space, items
        self.rows = np.concatenate([space.vectors, np.zeros_like(space.vectors[:1])])  # the last one is for no word
        size = np.array([len(w) for w in items.words])
        kind = np.array([_class_of(n) for n in size])
        # Blocks of items of one class, with their vectors and the buckets they contain.
        self.blocks = []
        for c in CLASSES:
            own = np.flatnonzero(kind == c)
            for lo in range(0, len(own), ITEM_BLOCK):
                at = own[lo : lo + ITEM_BLOCK]
                mask = np.zeros((len(at), BUCKETS // 8), np.uint8)  # a bit for each bucket
                sums = np.zeros((len(at), space.vectors.shape[1]), np.float32)
                whole = np.zeros(len(at), np.float32)
                for k, j in enumerate(at):
                    word = _bucket(np.array(items.words[j], np.uint64))
                    np.bitwise_or.at(mask[k], word >> 3, (1 << (word & 7)).astype(np.uint8))
                    sums[k] = space.vectors[word].sum(0)
                    whole[k] = space.idf[word].sum()
                self.blocks.append((c, at, space.place(sums), mask, whole))
        self.bounds = [self._bounds(mask, whole) for _, _, _, mask, whole in self.blocks]

    def _bounds(self, mask: np.ndarray, whole: np.ndarray) -> np.ndarray | None:
        """For each group of pieces and each bucket, the most that a word of the bucket adds to the shared IDF of any piece, in parts of what that piece needs.

        A window in which these do not add up to 1 is a candidate for no piece of the group. None if some piece needs nothing.
        """
        least = SHARED * whole
        if (least <= 0).any():
            return None
        out = np.zeros((-(-len(mask) // BOUND_GROUP), BUCKETS), np.float32)
        for k in range(len(mask)):
            word = np.flatnonzero(np.unpackbits(mask[k], bitorder="little"))
            own = out[k // BOUND_GROUP]
            own[word] = np.maximum(own[word], self.space.idf[word] / least[k])
        return out

    def search(self, texts: pa.Array) -> list[list[dict]]:
        """Hits of each text."""
        out: list[list[dict]] = []
        for _, part in blocks(texts, TEXT_BYTES):
            out += self._search_block(part)
        return out

    def _search_block(self, texts: pa.Array) -> list[list[dict]]:
        hashes, bounds = word_hashes(texts)
        best: list[dict] = [{} for _ in range(len(texts))]
        if len(hashes):
            word = _bucket(hashes)
            counts = np.diff(bounds)
            # Segments of a few words, aligned to each document's start.
            at = np.arange(len(hashes)) - np.repeat(bounds[:-1], counts)
            first = np.flatnonzero(at % SEGMENT == 0)
            of = np.repeat(np.arange(len(texts)), counts)[first]
            seg_bounds = np.searchsorted(of, np.arange(len(texts) + 1))
            place = np.arange(len(first)) - seg_bounds[of]
            ahead = seg_bounds[of + 1] - np.arange(len(first))
            ends = np.append(first, len(hashes))
            windows = {}
            for c in CLASSES:
                length, step = c // SEGMENT, max(c // SEGMENT // 4, 1)
                begin = np.flatnonzero((place % step == 0) & ((place == 0) | (ahead > length - step)))
                windows[c] = begin, np.minimum(begin + length, seg_bounds[of[begin] + 1])
            for (c, ids, placed, mask, whole), bound in zip(self.blocks, self.bounds):
                begin, end = windows[c]
                if bound is not None:
                    some = np.flatnonzero(_reach(bound, word, ends[begin], ends[end]))
                    begin, end = begin[some], end[some]
                for lo in range(0, len(begin), WINDOWS_AT_ONCE):
                    b, e = begin[lo : lo + WINDOWS_AT_ONCE], end[lo : lo + WINDOWS_AT_ONCE]
                    cosine = self.space.place(self._sums(word, ends, b, e)) @ placed.T
                    w, k = np.nonzero(cosine >= COSINE)
                    for at in range(0, len(w), 1 << 16):
                        self._compare(w[at : at + (1 << 16)], k[at : at + (1 << 16)], cosine, ids, mask, whole, b, e, ends, word, hashes, bounds, of, c, best)
        return [self._of_items(found) for found in best]

    def _sums(self, word: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sums of the word vectors of windows of whole segments; a segment is summed once for all windows at hand."""
        lo = int(begin.min())
        covered = np.cumsum(np.bincount(begin - lo, minlength=int(end.max()) - lo + 1) - np.bincount(end - lo, minlength=int(end.max()) - lo + 1)) > 0
        used = np.flatnonzero(covered) + lo
        first, past = ends[used], ends[used + 1]
        segments = np.zeros((len(used) + 1, self.rows.shape[1]), np.float32)  # the last one is for no segment
        for k in range(SEGMENT):
            segments[:-1] += self.rows[np.where(first + k < past, word[np.minimum(first + k, len(word) - 1)], BUCKETS)]
        number = np.cumsum(covered) - 1
        sums = np.zeros((len(begin), segments.shape[1]), np.float32)
        for k in range(int((end - begin).max())):
            sums += segments[np.where(begin + k < end, number[np.minimum(begin + k, end - 1) - lo], len(used))]
        return sums

    def _of_items(self, found: dict[int, dict]) -> list[dict]:
        """Of the pieces found the best of each item, by item id."""
        items: dict = {}
        for hit in found.values():
            known = items.get(hit["item_id"])
            if known is None or (hit["lcs"], hit["cosine"]) > (known["lcs"], known["cosine"]):
                items[hit["item_id"]] = hit
        return [items[k] for k in sorted(items, key=lambda k: (k is None, k or 0))]

    def _compare(self, w, k, cosine, ids, mask, whole, begin, end, ends, word, hashes, bounds, of, c, best) -> None:
        lo, hi = ends[begin[w]], ends[end[w]]
        span = np.arange(c)
        inside = span[None, :] < (hi - lo)[:, None]
        own = word[np.minimum(lo[:, None] + span, len(word) - 1)]
        known = mask[k[:, None], own >> 3] >> (own & 7).astype(np.uint8) & 1
        shared = np.where(inside & (known > 0), self.space.idf[own], 0).sum(1)
        for i in np.flatnonzero(shared >= SHARED * whole[k]):
            doc, j = int(of[begin[w[i]]]), int(ids[k[i]])
            done = best[doc].get(j)
            if done and done["lcs"] >= 1:
                continue
            piece = self.items.words[j]
            margin = max(c // 4, len(piece) - int(hi[i] - lo[i]) + c // 8)
            region = hashes[max(lo[i] - margin, bounds[doc]) : min(hi[i] + margin, bounds[doc + 1])].tolist()
            ratio = lcs_length(piece, region) / len(piece)
            if ratio < LCS_PARAPHRASE or done and ratio <= done["lcs"]:
                continue
            answer = self.items.answers[j]
            answered = len(answer) > 0 and lcs_length(answer, region) >= ANSWER * len(answer)
            if ratio >= LCS or answered:
                best[doc][j] = {"item_id": self.items.ids[j], "cosine": float(cosine[w[i], k[i]]), "lcs": ratio, "answer": answered}


#: The worker's last (broadcast value, searcher): kept together, so that another value is never taken for it.
_last: list = [None, None]


def _hits(shared):
    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        if _last[0] is not shared.value:
            _last[:] = shared.value, Searcher(*shared.value)
        return pa.array(_last[1].search(texts), _HIT)

    return hits


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", to: str = "leaks", space: Space | None = None) -> DataFrame:
    """Add the column ``to``: the benchmark pieces found in ``text``. ``benchmark`` has item_id and text; it is the stated query set, compared in blocks with all documents."""
    spark = docs.sparkSession
    space = space or fit(docs, text)
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator()
    found, columns = docs, []
    for n, items in enumerate(_passes(rows)):
        columns.append(f"tidemark__leaks{n}")
        found = found.withColumn(columns[-1], _hits(spark.sparkContext.broadcast((space, items)))(F.col(text)))
    whole = F.concat(*columns) if columns else F.array().cast(HITS)
    return found.withColumn(to, whole).drop(*columns)


def _passes(rows: Iterator) -> Iterator[Items]:
    """The benchmark in parts of at most about ITEMS_PER_PASS pieces."""
    kept: list = []
    size = 0
    for r in rows:
        kept.append((r[0], r[1]))
        size += 1 + len(r[1]) // 200
        if size >= ITEMS_PER_PASS:
            yield prepare_items(kept)
            kept, size = [], 0
    if kept:
        yield prepare_items(kept)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Documents without any benchmark piece, with all their columns."""
    return find_leaks(docs, benchmark, text, "tidemark__leaks").where(F.size("tidemark__leaks") == 0).drop("tidemark__leaks")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item found in it, with the best cosine and LCS ratio of its pieces."""
    from ..runtime import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.cosine", "leak.lcs", "leak.answer")

"""Near-duplicate groups: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard similarity.

1. Document frequencies of five-word shingles are counted over all documents in
   ``1 << DF_BITS`` hashed cells; the table of weights has that fixed size and is broadcast.
   A shingle weighs (its count) times log((N + K) / (df + K)), where K = 1 + N / 500 keeps rare shingles
   alike. The text of a large group of near copies would be common, weigh little and hide the group. So documents are counted
   by the smallest of their shingle hashes, in KEYS orders, one of which near copies nearly always share; those in
   groups of N / HEAVY documents or more (at most KEYS * HEAVY groups, which are broadcast) add 1 / (the group's size) to df and N.
2. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples of each text; two texts agree on a sample with a
   chance equal to their weighted Jaccard similarity. Equal texts are one node from here on, known by a digest.
3. Texts that agree on all samples of a band meet in a bucket. A bucket's members are compared with its LEADERS leaders, the texts that
   meet most others: all pairs of a small bucket, a number of rows in proportion to the members of a large one.
4. Similar pairs are joined to groups by alternating large and small stars, all in Spark.
5. In buckets of more than ``LEADERS + 1`` texts not all pairs have met. Where such a bucket holds more than one group, blocks of about ``BLOCK``
   members are compared across groups, exactly, by one product of sparse rows a pair of blocks; groups that turn out linked are joined.
   A crowd of near copies is one group by then and costs nothing more; the work is the product of its size with the number of the
   bucket's other texts.

A pair of similarity s shares a bucket with chance 1 - (1 - s ** ROWS) ** BANDS: 0.999 at 0.8. No pair that shares a bucket is left out, but
those whose texts are in one group already. Step 5 is quadratic in the texts of one bucket that are not linked: instances of a template of
similarity s to each other meet there with chance s ** ROWS a band, and a block pair of 256 by 256 costs some milliseconds.

Defined cases: a null text is empty; texts without words are near no other text, only equal to their copies; texts with fewer
than five words have one shingle of all; ids may be null or repeat, groups are formed by text and named by their smallest id
(null only if all are null); every row is kept; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grouping import across_components, components, leader_pairs, meeting_rows, merge_components, spanning_links
from .words import blocks, mix64, shingle_hashes, word_hashes

THRESHOLD = 0.8
BANDS, ROWS = 14, 4
LEADERS = 6
BLOCK = 256
DF_BITS = 18
KEYS, HEAVY = 4, 5000
_QUANTILES = 1 << 16
#: Cells of the matrices that a task holds while it compares two blocks.
CELLS = 4_000_000


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return shingle_hashes(*word_hashes(texts))


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)


def _smallest(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have shingles, and for each of these the smallest hash in KEYS orders."""
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return some, np.zeros((0, KEYS), np.uint64)
    return some, np.stack([np.minimum.reduceat(mix64(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)), bounds[some]) for k in range(KEYS)], 1)


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, part in blocks(batch.column("text")):
            yield pa.record_batch([pa.array(_smallest(*_shingles(part))[1].ravel().view(np.int64))], names=["least"])


def _count_cells(heavy: dict[int, int]):
    """Of each cell, in how many texts of the partition it occurs, those of heavy groups counting less; and the number of texts as cell -1."""
    keys = np.sort(np.array([*heavy, 0], np.int64).view(np.uint64))
    sizes = np.array([heavy.get(int(k.view(np.int64)), 1) for k in keys], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << DF_BITS), 0.0
        for batch in batches:
            for _, part in blocks(batch.column("text")):
                hashes, bounds = _shingles(part)
                some, least = _smallest(hashes, bounds)
                at = np.minimum(np.searchsorted(keys, least), len(keys) - 1)
                share = np.ones(len(part))
                share[some] = 1 / np.where(keys[at] == least, sizes[at], 1.0).max(1, initial=1.0)
                of = np.repeat(np.arange(len(part)), np.diff(bounds))
                pairs = np.unique((of << DF_BITS) | _cells(hashes))
                total += np.bincount(pairs & ((1 << DF_BITS) - 1), share[pairs >> DF_BITS], len(total))
                n += share.sum()
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array([-1, *some], pa.int64()), pa.array([n, *total[some]], pa.float64())], names=["cell", "n"])

    return run


def shingle_weights(texts: DataFrame) -> np.ndarray:
    """The weight of each cell from all rows of ``texts`` (text); at most ``1 << DF_BITS`` sums come to the driver."""
    least = texts.mapInArrow(_count_keys, "least long").groupBy("least").agg(F.count("*").alias("n"))
    enough = max(2, -(-texts.count() // HEAVY))
    heavy = {r["least"]: r["n"] for r in least.where(F.col("n") >= enough).collect()}
    # Sums are rounded, as their order may differ from run to run.
    counts = texts.mapInArrow(_count_cells(heavy), "cell long, n double").groupBy("cell").agg(F.round(F.sum("n"), 3).alias("n")).toArrow()
    cell, n = counts["cell"].to_numpy(), counts["n"].to_numpy()
    documents = max(float(n[cell == -1].sum()), 1.0)
    frequency = np.zeros(1 << DF_BITS)
    frequency[cell[cell >= 0]] = n[cell >= 0]
    smooth = 1 + documents / 500
    return np.log((documents + 1 + smooth) / (frequency + smooth)).astype(np.float32)


def weighted_sets(texts: pa.Array, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingle hashes and their weights, for each text in turn."""
    for _, part in blocks(texts):
        hashes, bounds = _shingles(part)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            own, counts = np.unique(hashes[lo:hi], return_counts=True)
            yield own, counts * weights[_cells(own)]


class Sampler:
    """Improved consistent weighted sampling with ``k`` samples.

    The random variables of a (shingle, sample) pair are read from tables of
    quantiles, at places taken from the bits of a hash of the pair: r and c
    follow a gamma distribution of shape 2, b is uniform.
    """

    def __init__(self, k: int, seed: int = 7):
        # Gamma of shape 2 is the sum of two exponentials; its quantiles by inverting 1 - (1 + x) exp(-x).
        x = np.concatenate([[0], np.geomspace(1e-6, 40, 400_000)])
        p = (np.arange(_QUANTILES) + 0.5) / _QUANTILES
        gamma = np.interp(p, 1 - (1 + x) * np.exp(-x), x)
        self.r = gamma.astype(np.float32)
        self.inverse = (1 / gamma).astype(np.float32)
        self.log_c = np.log(gamma).astype(np.float32)
        self.b = p.astype(np.float32)
        self.salts = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[:, None] | np.uint64(1)

    def draw(self, hashes: np.ndarray, weights: np.ndarray, step: int = 2048) -> np.ndarray:
        """A 64-bit name of each sample; equal names mean the same shingle at the same level of its weight."""
        best = np.full(len(self.salts), np.inf, np.float32)
        names = np.zeros(len(self.salts), np.uint64)
        logs = np.log(weights).astype(np.float32)
        for lo in range(0, len(hashes), step):
            own, log_w = hashes[lo : lo + step], logs[lo : lo + step]
            bits = own[None, :] * self.salts
            bits ^= bits >> np.uint64(29)
            bits *= np.uint64(0xBF58476D1CE4E5B9)
            first = (bits >> np.uint64(48)).astype(np.uint16)
            r, b = self.r[first], self.b[(bits >> np.uint64(32)).astype(np.uint16)]
            t = np.floor(log_w * self.inverse[first] + b)
            a = self.log_c[(bits >> np.uint64(16)).astype(np.uint16)] - r * (t - b + np.float32(1))
            at = a.argmin(1)
            rows = np.arange(len(self.salts))
            least = a[rows, at]
            better = least < best
            best[better] = least[better]
            chosen = mix64(own[at] ^ (t[rows, at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            names[better] = chosen[better]
        return names


def _band_keys(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sampler = shared.value, Sampler(BANDS * ROWS)
        salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
        mixers = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
        for batch in batches:
            keys = []
            for hashes, own in weighted_sets(batch.column("text"), weights):
                if len(hashes):
                    names = sampler.draw(hashes, own).reshape(BANDS, ROWS)
                    keys.append(mix64((names * mixers[:ROWS]).sum(1, dtype=np.uint64) ^ salt).view(np.int64).tolist())
                else:
                    keys.append([])
            yield pa.record_batch([batch.column("doc_id"), batch.column("node"), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "keys"])

    return run


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets with sorted hashes."""
    at = np.minimum(np.searchsorted(b[0], a[0]), max(len(b[0]) - 1, 0))
    if not len(b[0]) or not len(a[0]):
        return 0.0
    shared = b[0][at] == a[0]
    both = float(np.minimum(a[1][shared], b[1][at[shared]]).sum())
    total = float(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def unit_items(texts: pa.Array, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text its shingles one by one, sorted: the n-th copy of a shingle is an item of its own with the shingle's weight.

    The weighted Jaccard similarity of two texts is the weight of the items they share over that of all their items.
    """
    for _, part in blocks(texts):
        hashes, bounds = _shingles(part)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            own = np.sort(hashes[lo:hi])
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            copy = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
            items = np.where(copy > 0, mix64(own ^ copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), own)
            order = np.argsort(items)
            yield items[order], weights[_cells(own)][order]


ITEM = np.dtype([("item", "<u8"), ("weight", "<f4")])


def _pack_items(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for _, part in blocks(batch.column("text")):
                packed = []
                for items, weights in unit_items(part, shared.value):
                    rows = np.empty(len(items), ITEM)
                    rows["item"], rows["weight"] = items, weights
                    packed.append(rows.tobytes())
                yield pa.record_batch([batch.column("node").slice(row, len(part)), pa.array(packed, pa.binary())], names=["node", "data"])
                row += len(part)

    return run


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(data, ITEM)
    return np.ascontiguousarray(rows["item"]), rows["weight"].astype(np.float64)


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [jaccard(_unpack(a.as_py()), _unpack(b.as_py())) for a, b in zip(batch.column("data"), batch.column("leader_data"), strict=True)]
        yield pa.record_batch([batch.column("node"), batch.column("leader"), pa.array(out, pa.float64())], names=["node", "leader", "similarity"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Similarities of the pairs (node, leader); ``sets`` has node and data."""
    joined = pairs.join(sets, "node").join(sets.select(F.col("node").alias("leader"), F.col("data").alias("leader_data")), "leader")
    return joined.select("node", "leader", "data", "leader_data").mapInArrow(_similarities, "node string, leader string, similarity double")


def block_similarities(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Weighted Jaccard similarities of all texts of two blocks."""

    def laid_out(block):
        rows = [np.frombuffer(x, ITEM) for x in block]
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.concatenate([*rows, np.zeros(0, ITEM)])
        weights = flat["weight"].astype(np.float64)
        return np.ascontiguousarray(flat["item"]), of, weights, np.bincount(of, weights, len(rows))

    (items, of, weights, whole), (other_items, other_of, _, other_whole) = laid_out(a), laid_out(b)
    common = np.intersect1d(items, other_items)
    both = np.zeros((len(a), len(b)))
    if not len(common):
        return both

    def placed(values):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        known = np.flatnonzero(common[at] == values)
        known = known[np.argsort(at[known], kind="stable")]
        return known, at[known]

    (left, left_at), (right, right_at) = placed(items), placed(other_items)
    step = max(1, CELLS // (len(a) + len(b)))
    for lo in range(0, len(common), step):
        x, y = np.zeros((len(a), step)), np.zeros((len(b), step))
        mine, theirs = (slice(*np.searchsorted(at, [lo, lo + step])) for at in (left_at, right_at))
        x[of[left[mine]], left_at[mine] - lo] = weights[left[mine]]
        y[other_of[right[theirs]], right_at[theirs] - lo] = 1
        both += x @ y.T
    return both / np.maximum(whole[:, None] + other_whole[None] - both, 1e-300)


def _links_of_blocks(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, others in zip(batch.column("members"), batch.column("others"), strict=True):
                left, right = members.values, others.values
                names, other_names = left.field("node").to_pylist(), right.field("node").to_pylist()
                similar = block_similarities(left.field("data").to_pylist(), right.field("data").to_pylist()) >= threshold
                links = spanning_links(similar, left.field("root").to_pylist(), right.field("root").to_pylist())
                yield pa.record_batch([pa.array([names[i] for i, _ in links], pa.string()), pa.array([other_names[j] for _, j in links], pa.string())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, node (digest of the text), text_class (smallest id with an equal text),
    group_id (smallest id of the group) and keeps (whether the text is the one of its group that stays: that of the smallest id)."""
    from ..runtime import discard, persist, ship

    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.md5("text"))
    shared = spark.sparkContext.broadcast(shingle_weights(docs.select("text")))
    signed = persist(spark, docs.select("doc_id", "node", "text").mapInArrow(_band_keys(shared), "doc_id long, node string, keys array<long>"), "near-signatures")

    # Copies collapse: one row per text. The keys of equal texts are equal.
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys"))
    members = persist(spark, meeting_rows(nodes.select("node", F.posexplode("keys").alias("band", "key"))), "near-members")
    # The items of the texts that meet any other, each from the copy with the smallest id, so that copies don't meet in one task.
    first = members.select("node").distinct().join(nodes.select("node", "first_id"), "node").withColumnRenamed("node", "met")
    met = docs.join(first, (F.col("node") == F.col("met")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("node").agg(F.first("text").alias("text"))
    sets = persist(spark, met.mapInArrow(_pack_items(shared), "node string, data binary"), "near-sets")

    pairs, leaders = leader_pairs(spark, members, LEADERS, "near")
    compared = verify(pairs, sets).where(F.col("similarity") >= threshold)
    similar = persist(spark, compared.select(F.col("node").alias("a"), F.col("leader").alias("b")), "near-pairs")
    roots = persist(spark, components(spark, similar), "near-roots")
    across = lambda meeting: meeting.mapInArrow(_links_of_blocks(threshold), "a string, b string")
    links = across_components(spark, members, roots, sets, across, LEADERS + 1, BLOCK, "near")
    if not links.isEmpty():
        before, roots = roots, persist(spark, merge_components(spark, roots, links), "near-roots")
        discard(before)
    discard(members, leaders, sets, similar, links)

    groups = nodes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = groups.join(groups.groupBy("root").agg(F.min("first_id").alias("group_id"), F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("kept")), "root")
    named = named.select("node", "first_id", "group_id", (F.col("node") == F.col("kept.node")).alias("keeps"))
    return signed.select("doc_id", "node").join(named, "node").select("doc_id", F.col("first_id").alias("text_class"), "group_id", "node", "keeps")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of each group the row with the smallest id stays, with all its columns; of equal rows one does."""
    from ..runtime import persist

    own = docs.columns
    groups = near_duplicates(docs, threshold).where("keeps")
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("text_class"))).groupBy("node", "text_class").agg(F.count("*").alias("times"))
    first = persist(docs.sparkSession, first.select(F.col("node").alias("tidemark__node"), F.col("text_class").alias("tidemark__first"), F.col("times").alias("tidemark__times")), "near-kept")
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    kept = docs.join(first, (digest == F.col("tidemark__node")) & F.col("doc_id").eqNullSafe(F.col("tidemark__first")))
    if not first.where("tidemark__times > 1").isEmpty():  # equal rows, id included: only these are shuffled again
        kept = kept.where("tidemark__times = 1").unionByName(kept.where("tidemark__times > 1").dropDuplicates(["tidemark__node"]))
    return kept.select(*[F.col(f"`{c}`") for c in own])


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents: one row per document with the smallest id of its text and of its group."""
    from ..runtime import table

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text_class", "group_id")

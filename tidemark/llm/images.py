"""Copies of images, cropped or edited: local descriptors, Hamming-table joins and geometric consensus.

1. Equal images collapse by digest; one of each is a node.
2. Corners (Harris) are found on three scales; each gets an orientation (intensity centroid) and 256 binary tests of smoothed
   intensities in a pattern turned by it.
3. ``TABLES`` choices of ``KEY_BITS`` of the 256 bits are the keys of hash tables: corners that differ in few bits agree on some choice.
   Images that share a key meet in a bucket; in a small bucket all pairs are compared, in a larger one its members with a few
   leaders and then, in blocks, across the groups found (see ``grouping``), so a pair that shares a key is always compared or in one group already.
   Keys come in ``ROUNDS``, all in the end: the first ones link crowds of near copies, so that buckets within one group need no rows later.
4. Descriptors of a pair are matched (mutually nearest, at most ``MAX_DISTANCE`` bits); every match proposes a shift, turn and scale;
   the proposal that most matches agree with decides: at least ``MIN_INLIERS`` of them, and a share of the fewer corners of at least ``THRESHOLD``.

Of 48 x 48 tiles 5e-4 of the pairs of different images share a key, so the number of pairs compared grows with the square of the images
until buckets outgrow the leaders; more key bits make it rarer, more tables make up for the copies that this loses (``key_bits``, ``tables``).

Images are binary PGM (P5) with 8 bits a pixel. Of each scale the strongest corners are kept, one for every ``SPACING`` pixels of the image's side
and ``PER_SCALE`` at least: a feature of the descriptor.

Defined cases: null, unreadable or empty images and images without enough corners are like no others, only equal to their
copies (null images not even that); groups are named by their smallest id; ids may be null or repeat; every row is
kept; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grouping import across_components, components, leader_pairs, meeting_rows, merge_components, spanning_links, with_roots
from .words import mix64

SCALES = (1.0, 0.75, 0.5)
PER_SCALE, SPACING = 8, 3
RADIUS = 10
TESTS = 256
KEY_BITS, TABLES = 48, 16
TURNS = 32
MAX_DISTANCE = 60
MIN_INLIERS, THRESHOLD = 5, 0.2
TOLERANCE = 3.0
LEADERS, BLOCK = 4, 128
#: Rounds in which keys are looked at: one key in so many by the end of each round, all by the end of the last.
ROUNDS = (16, 4, 1)
#: Distances that a task holds while it matches pairs.
CELLS = 1_000_000

_rng = np.random.default_rng(5)
#: Where the tests look, in pixels from the corner: pairs of points, normally distributed inside the patch.
_PATTERN = np.clip(_rng.normal(0, RADIUS / 1.55, (TESTS, 2, 2)), -RADIUS + 1, RADIUS - 1)
_ANGLES = 2 * np.pi * np.arange(TURNS) / TURNS
#: The pattern turned by each angle. Angles go from x to y, points are (y, x): (y, x) turns into (y cos + x sin, x cos - y sin).
_TURNED = np.rint(np.einsum("aij,tkj->atki", np.stack([np.stack([np.cos(_ANGLES), np.sin(_ANGLES)], 1), np.stack([-np.sin(_ANGLES), np.cos(_ANGLES)], 1)], 1), _PATTERN)).astype(np.int64)
_DISC = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if y * y + x * x <= RADIUS * RADIUS])

KEYPOINT = np.dtype([("y", "<f4"), ("x", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "u1", TESTS // 8)])
_PGM = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")


def write_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """Pixels, or None if this isn't a whole image."""
    head = _PGM.match(data or b"")
    if not head:
        return None
    width, height = int(head[1]), int(head[2])
    if not width or not height or len(data) - head.end() < width * height:
        return None
    return np.frombuffer(data, np.uint8, width * height, head.end()).reshape(height, width)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2 r + 1, along the last two axes."""
    for axis in (-2, -1):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis, dtype=np.float64)
        n = a.shape[axis]
        a = (np.take(c, range(2 * r + 1, n + 2 * r + 1), axis) - np.take(c, range(n), axis)) / (2 * r + 1)
    return a


def _shrink(a: np.ndarray, scale: float) -> np.ndarray:
    """Linear interpolation to a smaller size."""
    if scale == 1:
        return a
    for axis in (1, 2):
        n = a.shape[axis]
        m = max(int(n * scale), 1)
        at = np.clip((np.arange(m) + 0.5) / scale - 0.5, 0, n - 1)
        lo = np.minimum(at.astype(int), max(n - 2, 0))
        part = (at - lo).reshape([-1 if k == axis else 1 for k in range(3)])
        a = np.take(a, lo, axis) * (1 - part) + np.take(a, np.minimum(lo + 1, n - 1), axis) * part
    return a


def describe(images: np.ndarray) -> list[np.ndarray]:
    """Keypoints of each image of a stack of equal shape."""
    n = len(images)
    found: list[list[np.ndarray]] = [[] for _ in range(n)]
    for scale in SCALES:
        a = _box(_shrink(images.astype(np.float64), scale), 1)
        height, width = a.shape[1:]
        if min(height, width) < 2 * RADIUS + 3:
            continue
        gy, gx = np.gradient(a, axis=(1, 2))
        yy, xx, xy = _box(gy * gy, 2), _box(gx * gx, 2), _box(gy * gx, 2)
        response = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
        peak = response > 1.0
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                if dy or dx:
                    other = np.roll(response, (dy, dx), (1, 2))
                    peak &= response >= other if (dy, dx) > (0, 0) else response > other
        edge = np.zeros((height, width), bool)
        edge[RADIUS + 1 : height - RADIUS - 1, RADIUS + 1 : width - RADIUS - 1] = True
        of, y, x = np.nonzero(peak & edge)
        if not len(of):
            continue
        order = np.lexsort((x, y, -np.round(response[of, y, x], 6), of))
        of, y, x = of[order], y[order], x[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        of, y, x = (v[rank < max(PER_SCALE, int(edge.sum() ** 0.5 / SPACING))] for v in (of, y, x))
        disc = a[of[:, None], y[:, None] + _DISC[:, 0], x[:, None] + _DISC[:, 1]]
        angle = np.arctan2((disc * _DISC[:, 0]).sum(1), (disc * _DISC[:, 1]).sum(1))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        smooth = _box(a, 1)
        points = _TURNED[turn]  # corner, test, end, (y, x)
        seen = smooth[of[:, None, None], np.clip(y[:, None, None] + points[..., 0], 0, height - 1), np.clip(x[:, None, None] + points[..., 1], 0, width - 1)]
        rows = np.zeros(len(of), KEYPOINT)
        rows["y"], rows["x"], rows["scale"], rows["angle"] = (y + 0.5) / scale, (x + 0.5) / scale, 1 / scale, angle
        rows["bits"] = np.packbits(seen[:, :, 0] < seen[:, :, 1], axis=1)
        cuts = np.searchsorted(of, np.arange(n + 1))
        for k in range(n):
            if cuts[k + 1] > cuts[k]:
                found[k].append(rows[cuts[k] : cuts[k + 1]])
    return [np.concatenate(f) if f else np.zeros(0, KEYPOINT) for f in found]


def describe_all(data: list[bytes | None], most: int = 1 << 21) -> list[np.ndarray]:
    """Keypoints of encoded images; those of one shape are described together, about ``most`` pixels at a time."""
    out: list[np.ndarray] = [np.zeros(0, KEYPOINT)] * len(data)
    shapes: dict[tuple, list[int]] = {}
    pixels = [read_pgm(d) for d in data]
    for k, p in enumerate(pixels):
        if p is not None:
            shapes.setdefault(p.shape, []).append(k)
    for shape, own in shapes.items():
        step = max(1, most // (shape[0] * shape[1]))
        for lo in range(0, len(own), step):
            for k, points in zip(own[lo : lo + step], describe(np.stack([pixels[k] for k in own[lo : lo + step]])), strict=True):
                out[k] = points
    return out


def consensus(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the fewer corners that agree on one shift, turn and scale; 0 below ``MIN_INLIERS``."""
    if min(len(a), len(b)) < MIN_INLIERS:
        return 0.0
    left, right = a["bits"].view(np.uint64).reshape(len(a), -1), b["bits"].view(np.uint64).reshape(len(b), -1)
    distance = np.bitwise_count(left[:, None] ^ right[None]).sum(2, dtype=np.int64)
    to, back = distance.argmin(1), distance.argmin(0)
    i = np.flatnonzero((distance.min(1) <= MAX_DISTANCE) & (back[to] == np.arange(len(a))))
    j = to[i]
    if len(i) < MIN_INLIERS:
        return 0.0
    p, q = (v[k]["x"].astype(np.float64) + 1j * v[k]["y"] for v, k in ((a, i), (b, j)))
    turn = b[j]["scale"] / a[i]["scale"] * np.exp(1j * (b[j]["angle"] - a[i]["angle"]).astype(np.float64))
    miss = np.abs((p[None] - p[:, None]) * turn[:, None] + q[:, None] - q[None])
    inliers = int((miss <= TOLERANCE * np.maximum(np.abs(turn), 1)[:, None]).sum(1).max())
    return inliers / min(len(a), len(b)) if inliers >= MIN_INLIERS else 0.0


def mutual_matches(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """For each pair of images, how many corners are each other's nearest within ``MAX_DISTANCE`` bits: at least as many as consensus finds."""
    out = np.zeros(len(left), np.int64)
    width = np.maximum([len(p) for p in left], [len(p) for p in right]) if left else np.zeros(0, np.int64)
    order = np.argsort(width, kind="stable")
    lo = 0
    while lo < len(order):
        step = max(1, CELLS // max(int(width[order[min(lo + 255, len(order) - 1)]]), 1) ** 2)
        own = order[lo : lo + min(step, 256)]
        lo += len(own)
        k = int(width[own[-1]])
        if not k:
            continue
        sides = []
        for points in (left, right):
            bits, there = np.zeros((len(own), k, TESTS // 64), np.uint64), np.zeros((len(own), k), bool)
            for row, at in enumerate(own):
                n = len(points[at])
                bits[row, :n] = np.ascontiguousarray(points[at]["bits"]).view(np.uint64).reshape(n, TESTS // 64)
                there[row, :n] = True
            sides.append((bits, there))
        (a, in_a), (b, in_b) = sides
        distance = np.zeros((len(own), k, k), np.uint16)
        for word in range(TESTS // 64):
            distance += np.bitwise_count(a[:, :, None, word] ^ b[:, None, :, word])
        distance[~(in_a[:, :, None] & in_b[:, None, :])] = TESTS + 1
        to, back = distance.argmin(2), distance.argmin(1)
        near = np.take_along_axis(distance, to[:, :, None], 2)[:, :, 0] <= MAX_DISTANCE
        out[own] = (near & (np.take_along_axis(back, to, 1) == np.arange(k))).sum(1)
    return out


def similarities(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """``consensus`` of each pair."""
    out = np.zeros(len(left))
    for k in np.flatnonzero(mutual_matches(left, right) >= MIN_INLIERS):
        out[k] = consensus(left[k], right[k])
    return out


def table_keys(points: np.ndarray, key_bits: int = KEY_BITS, tables: int = TABLES) -> np.ndarray:
    """64-bit names of the chosen bits of all descriptors, other ones in each table; sorted."""
    rng = np.random.default_rng(9)
    chosen = np.concatenate([rng.permutation(TESTS)[: TESTS // key_bits * key_bits].reshape(-1, key_bits) for _ in range(-(-tables // max(TESTS // key_bits, 1)))])[:tables]
    bits = np.unpackbits(points["bits"], axis=1).astype(np.uint64)
    salts = mix64(np.arange(1, tables + 1, dtype=np.uint64))
    return np.unique(mix64((bits[:, chosen] << np.arange(key_bits, dtype=np.uint64)).sum(2, dtype=np.uint64) ^ salts).view(np.int64))


def _describe_batches(key_bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in byte_slices(batch.column("image")):
                points = describe_all(part.to_pylist())
                keys = [table_keys(p, key_bits, tables).tolist() if len(p) >= MIN_INLIERS else [] for p in points]
                yield pa.record_batch([batch.column("node").slice(lo, len(part)), pa.array(keys, pa.list_(pa.int64())), pa.array([p.tobytes() for p in points], pa.binary())], names=["node", "keys", "data"])

    return run


def byte_slices(column: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a binary column of at most ``most`` bytes, or one value."""
    lo, size = 0, 0
    for k, value in enumerate(column):
        own = len(value.as_buffer()) if value.is_valid else 0
        if k > lo and size + own > most:
            yield lo, column.slice(lo, k - lo)
            lo, size = k, 0
        size += own
    if lo < len(column):
        yield lo, column.slice(lo)


def _consensus_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [[np.frombuffer(x, KEYPOINT) for x in batch.column(c).to_pylist()] for c in ("data", "leader_data")]
        yield pa.record_batch([batch.column("node"), batch.column("leader"), pa.array(similarities(*sides), pa.float64())], names=["node", "leader", "similarity"])


def _earlier_meetings(keys: list[np.ndarray], others: list[np.ndarray], here: int) -> np.ndarray:
    """Whether two members share a key below ``here``, that is, meet in another bucket too."""
    cut = [k[: np.searchsorted(k, here)] for k in keys]
    other_cut = [k[: np.searchsorted(k, here)] for k in others]
    common = np.intersect1d(np.concatenate(cut), np.concatenate(other_cut))
    met = np.zeros((len(keys), len(others)), np.float32)
    for lo in range(0, len(common), 8192):
        sides = []
        for block in (cut, other_cut):
            rows = np.zeros((len(block), min(8192, len(common) - lo)), np.float32)
            for row, own in enumerate(block):
                rows[row, np.flatnonzero(np.isin(common[lo : lo + 8192], own, assume_unique=True))] = 1
            sides.append(rows)
        met += sides[0] @ sides[1].T
    return met > 0


def _links_of_blocks(threshold: float, key_bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for here, same, members, others in zip(batch.column("key").to_pylist(), batch.column("same").to_pylist(), batch.column("members"), batch.column("others"), strict=True):
                names, roots, points, keys = [], [], [], []
                for block in (members.values, others.values):
                    names.append(block.field("node").to_pylist())
                    roots.append(block.field("root").to_pylist())
                    points.append([np.frombuffer(x, KEYPOINT) for x in block.field("data").to_pylist()])
                    keys.append([table_keys(p, key_bits, tables) for p in points[-1]])
                wanted = np.array(roots[0])[:, None] != np.array(roots[1])[None]
                if same:
                    wanted = np.triu(wanted, 1)
                i, j = np.nonzero(wanted & ~_earlier_meetings(*keys, here))
                similar = np.zeros(wanted.shape, bool)
                for lo in range(0, len(i), 10_000):
                    at = i[lo : lo + 10_000], j[lo : lo + 10_000]
                    similar[at] = similarities([points[0][k] for k in at[0]], [points[1][k] for k in at[1]]) >= threshold
                links = spanning_links(similar, *roots)
                yield pa.record_batch([pa.array([names[0][x] for x, _ in links], pa.int64()), pa.array([names[1][y] for _, y in links], pa.int64())], names=["a", "b"])

    return run


def image_copies(images: DataFrame, threshold: float = THRESHOLD, key_bits: int = KEY_BITS, tables: int = TABLES) -> DataFrame:
    """One row per row of ``images`` (image_id, image): image_id, image_class (smallest id of an equal image) and group_id (smallest id of the group of copies)."""
    from ..runtime import discard, persist, ship

    spark = images.sparkSession
    ship(spark)
    own = images.select("image_id", "image", F.coalesce(F.md5("image"), F.concat(F.lit("none:"), F.coalesce(F.col("image_id").cast("string"), F.lit("")))).alias("digest"))
    # One row per image, with a number that is short to shuffle; it is written, so it stays what it is.
    classes = own.groupBy("digest").agg(F.min("image").alias("image"), F.min("image_id").alias("image_class")).withColumn("node", F.monotonically_increasing_id())
    classes = persist(spark, classes, "image-classes")
    described = persist(spark, classes.select("node", "image").mapInArrow(_describe_batches(key_bits, tables), "node long, keys array<long>, data binary"), "image-points")
    points = described.select("node", "data")

    def links_to_leaders(members: DataFrame) -> DataFrame:
        pairs, leaders = leader_pairs(spark, members, LEADERS, "image")
        joined = pairs.join(points, "node").join(points.select(F.col("node").alias("leader"), F.col("data").alias("leader_data")), "leader")
        compared = joined.select("node", "leader", "data", "leader_data").mapInArrow(_consensus_batches, "node long, leader long, similarity double").where(F.col("similarity") >= threshold)
        similar = persist(spark, compared.select(F.col("node").alias("a"), F.col("leader").alias("b")), "image-pairs")
        discard(leaders)
        return similar

    # Near copies share many keys, so a crowd of them fills many buckets. A few keys link most of it; of the others' buckets only those of several components count then.
    keys, roots, seen = described.select("node", "keys"), None, 0
    for one_in in ROUNDS:
        last, new = one_in == 1, f"pmod(key, {seen}) != 0" if seen else "true"
        part = F.expr(f"filter(keys, key -> pmod(key, {one_in}) = 0 AND ({last} OR {new}))")  # in the last round all, as crowded buckets stay to be compared
        rooted = with_roots(keys, roots) if seen else keys.withColumn("root", F.col("node"))
        members = persist(spark, meeting_rows(rooted.select(F.lit(0).alias("band"), F.explode(part).alias("key"), "node", "root")), "image-members")
        similar = links_to_leaders(members.where(new))
        before, roots = roots, persist(spark, merge_components(spark, roots, similar) if seen else components(spark, similar), "image-roots")
        discard(before, similar, *[members] * (not last))
        seen = one_in
    across = lambda meeting: meeting.mapInArrow(_links_of_blocks(threshold, key_bits, tables), "a long, b long")
    links = across_components(spark, members, roots, points, across, LEADERS + 1, BLOCK, "image")
    if not links.isEmpty():
        before, roots = roots, persist(spark, merge_components(spark, roots, links), "image-roots")
        discard(before)
    discard(described, members, links)
    named = classes.select("digest", "node", "image_class").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("image_class").alias("group_id")), "root").select("digest", "image_class", "group_id")
    return own.select("image_id", "digest").join(named, "digest").select("image_id", "image_class", "group_id")


def render(vector: np.ndarray, tile: int = 6) -> np.ndarray:
    """A vector as a square of gray tiles, row by row; its smallest value is black, its largest white."""
    side = max(1, int(np.ceil(np.sqrt(len(vector)))))
    cells = np.zeros(side * side)
    low, high = (vector.min(), vector.max()) if len(vector) else (0.0, 0.0)
    cells[: len(vector)] = np.rint((vector - low) / (high - low) * 255) if high > low else 0
    return np.repeat(np.repeat(cells.reshape(side, side), tile, 0), tile, 1).astype(np.uint8)


def _render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        images = [None if v is None else write_pgm(render(np.nan_to_num(np.array(v, np.float64)))) for v in batch.column("embedding").to_pylist()]
        yield pa.record_batch([batch.column("vec_id"), pa.array(images, pa.binary())], names=["image_id", "image"])


def render_vectors(vectors: DataFrame) -> DataFrame:
    """An image of each vector (vec_id, embedding): image_id and image."""
    from ..runtime import ship

    ship(vectors.sparkSession)
    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_render_batches, "image_id long, image binary")


def op5_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of copies among the images of all vectors: one row per vector with the smallest id of its image and of its group."""
    from ..runtime import table

    return image_copies(render_vectors(table(spark, sf_dir, "embeddings"))).select(F.col("image_id").alias("vec_id"), "image_class", "group_id")

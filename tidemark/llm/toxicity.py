"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. All labelled rows are taken, one of each group of near copies, so that copies don't count twice.
2. Lexicons are induced from it: words and word beginnings whose document counts
   among toxic rows are far from chance (a binomial tail). They are dealt to
   lexicon voters by kind and rank; pattern voters look at the number of hits,
   shouting and masked letters. The given
   label is one more voter, as annotators err too.
3. The label model estimates every voter's accuracies by expectation
   maximisation, and, from the voters' covariance within each class, how far
   they repeat each other; its posterior weighs correlated voters accordingly.
4. A logistic regression is fitted to the posterior, over the presence of the
   lexicons' entries and of each kind of them; only its weights are broadcast, and whole texts are scored.

All counting and voting runs on the executors; the driver gets counts of candidate entries, and every different combination of label, hits
and votes with the number of its rows. Most rows have no hit and are one combination; the others grow with the labelled rows that have hits.

Defined cases: a null text is empty; an empty text, or one without hits, gets
the base score; rows of ``labels`` without label or id are ignored, of several
labels for an id the highest counts; without toxic or without clean training rows
every score is the share of toxic rows (0 without labels). Repeated rows are scored each;
extra columns pass through, one named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import blocks, shingle_hashes, word_hashes

#: Labelled ids that are broadcast at most (about 50 bytes each); of more, documents and labels are shuffled.
BROADCAST_IDS = 1_000_000
PREFIXES = (4, 5, 6, 7, 8)
#: Share of entries that may be there by chance (Benjamini and Hochberg).
FALSE_ENTRIES = 0.01
MIN_TOXIC = 3
#: Least share of toxic rows among those with an entry, and from which share on an entry is a strong one.
MIN_PRECISION, STRONG = 0.6, 0.85
THRESHOLD = 0.7
#: Lexicon voters: strong words, weak words, strong beginnings, weak beginnings.
SHARDS = (5, 3, 3, 2)
N_LEXICONS = sum(SHARDS)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text index) of all words and word beginnings of texts without nulls; the hashes of beginnings are odd, those of words even."""
    hashes, bounds, beginnings = word_hashes(texts, PREFIXES)
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    one = np.uint64(1)
    return np.concatenate([hashes & ~one, *(h | one for _, h in beginnings)]), np.concatenate([of, *(of[w] for w, _ in beginnings)])


def _distinct(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (hash, text) once, by text."""
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], of[new]


@dataclass
class Lexicon:
    """Entries: sorted hashes, and the voter of each."""

    hashes: np.ndarray
    voter: np.ndarray
    coarse: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(entry, text index), each pair once."""
        hashes, of = features(texts)
        some = np.flatnonzero(self.coarse[(hashes >> np.uint64(44)).astype(np.int64)])
        hashes, of = hashes[some], of[some]
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        pairs = np.unique(of[found].astype(np.int64) * len(self.hashes) + at[found])
        return pairs % len(self.hashes), pairs // len(self.hashes)

    def inputs(self, entries: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classifier's inputs, as (input, text index) by text: entries, and after these whether a text has any entry of each kind."""
        n, kinds = len(self.hashes), len(SHARDS)
        kind = np.searchsorted(np.cumsum(SHARDS), self.voter[entries], "right")
        pairs = np.sort(np.concatenate([of * (n + kinds) + entries, np.unique(of * (n + kinds) + n + kind)]))
        return pairs % (n + kinds), pairs // (n + kinds)


def votes(texts: pa.Array, entries: np.ndarray, of: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row per text, one column per voter: 1 toxic, -1 clean, 0 abstains."""
    n, m = len(texts), N_LEXICONS
    out = np.zeros((n, m + 5), np.int8)
    out[of, lexicon.voter[entries]] = 1
    words = np.bincount(of[lexicon.voter[entries] < SHARDS[0] + SHARDS[1]], minlength=n)
    out[:, m] = np.where(np.bincount(of, minlength=n) == 0, -1, 0)
    out[:, m + 1] = np.where(words >= 2, 1, np.where(words == 0, -1, 0))
    out[:, m + 2] = np.where(words >= 4, 1, 0)
    out[:, m + 3] = np.where(pc.match_substring_regex(texts, r"(?:\p{Lu}{4,}[!?]+ ?){2}").to_numpy(zero_copy_only=False), 1, 0)
    out[:, m + 4] = np.where(pc.match_substring_regex(texts, r"\b\p{L}[*#@$]{2,}\p{L}?\b").to_numpy(zero_copy_only=False), 1, 0)
    return out


def _near_copy_key(texts: pa.Array) -> pa.Array:
    """The smallest shingle hash of each text: equal for copies, and for near copies as often as they share shingles."""
    keys = []
    for _, part in blocks(texts):
        hashes, bounds = shingle_hashes(*word_hashes(part))
        keys += [int(hashes[lo:hi].min().view(np.int64)) if hi > lo else 0 for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.array(keys, pa.int64())


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of all labelled rows, one for each near-copy key, materialised."""
    from ..runtime import persist

    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    if labels.count() <= BROADCAST_IDS:
        labels = F.broadcast(labels)
    key = F.arrow_udf(_near_copy_key, "long")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(labels, "doc_id")
    rows = rows.withColumn("key", key("text")).groupBy("key", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    return persist(docs.sparkSession, rows.select("row.text", "toxic"), "toxicity-rows")


def _toxic_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, part in blocks(batch.column("text")):
            hashes, n = np.unique(_distinct(*features(part))[0], return_counts=True)
            yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["entry", "n"])


def _clean_counts(candidates: np.ndarray):
    lexicon = Lexicon(candidates, np.zeros(len(candidates), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(candidates), np.int64)
        for batch in batches:
            for _, part in blocks(batch.column("text")):
                total += np.bincount(lexicon.hits(part)[0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(candidates[some].view(np.int64)), pa.array(total[some])], names=["entry", "n"])

    return run


def tails(a: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """The chance of at least a of n, each with chance p: sums of binomial terms, one for each distinct (a, n).

    Terms more than 40 standard deviations and 200 from the mean or from a are below what a double resolves, and are left out.
    """
    most = int(n.max(initial=0))
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1)))])
    pairs, which = np.unique(np.stack([a, n], 1), axis=0, return_inverse=True)
    out = np.empty(len(pairs))
    for row, (x, total) in enumerate(pairs.tolist()):
        far = int(40 * (total * p * (1 - p)) ** 0.5) + 200
        k = np.arange(max(x, int(total * p) - far), min(total, max(x, int(total * p)) + far) + 1)
        terms = logs[total] - logs[k] - logs[total - k] + k * log(p) + (total - k) * log(1 - p)
        top = terms.max()
        out[row] = min(1.0, np.exp(top) * np.exp(terms - top).sum())
    return out[which.ravel()]


def induce(rows: DataFrame, n_toxic: int, n_clean: int) -> Lexicon:
    """Entries that are far more frequent in toxic rows than chance, the least likely ones first."""
    toxic = rows.where("toxic = 1").select("text").mapInArrow(_toxic_counts, "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    found = toxic.where(F.col("n") >= MIN_TOXIC).toArrow()
    hashes, a = found["entry"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(hashes)
    hashes, a = hashes[order], a[order]
    rest = rows.where("toxic = 0").select("text").mapInArrow(_clean_counts(hashes), "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n")).toArrow()
    b = np.zeros(len(hashes), np.int64)
    b[np.searchsorted(hashes, rest["entry"].to_numpy().view(np.uint64))] = rest["n"].to_numpy()
    p = n_toxic / (n_toxic + n_clean)
    chance = tails(a, a + b, p)
    order = np.argsort(chance, kind="stable")
    passes = np.flatnonzero(chance[order] <= FALSE_ENTRIES * np.arange(1, len(order) + 1) / max(len(order), 1))
    precision = (a + p) / (a + b + 1)
    kept = order[: passes[-1] + 1 if len(passes) else 0]
    kept = np.sort(kept[precision[kept] >= MIN_PRECISION])
    kind = 2 * (hashes[kept] & np.uint64(1)).astype(np.int64) + (precision[kept] < STRONG)
    shards = np.array(SHARDS)
    voter = np.concatenate([[0], np.cumsum(shards)])[kind] + ((hashes[kept] >> np.uint64(8)) % shards[kind].astype(np.uint64)).astype(np.int64)
    return Lexicon(hashes[kept], voter)


def _hits_and_votes(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in blocks(batch.column("text")):
                entries, of = lexicon.hits(part)
                cast = votes(part, entries, of, lexicon)
                inputs, of = lexicon.inputs(entries, of)
                cuts = np.searchsorted(of, np.arange(len(part) + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(inputs.astype(np.int32)))
                yield pa.record_batch([batch.column("toxic").slice(row, len(part)), lists, pa.array([bytes(v) for v in cast], pa.binary())], names=["toxic", "hits", "votes"])

    return run


def label_model(votes: np.ndarray, rounds: int = 10, times: np.ndarray | None = None) -> np.ndarray:
    """Posterior of the latent label. The last column of ``votes`` is the given label, which starts the estimate; a row stands for ``times`` rows.

    Each round estimates P(vote | label) of every voter, turns votes into log
    likelihood ratios, and weighs these by the inverse of their covariance
    within the classes, so that voters that err together count less.
    """
    y = np.where(votes[:, -1] > 0, 0.95, 0.05)
    times = np.ones(len(votes)) if times is None else times
    for _ in range(rounds):
        ratios = np.zeros(votes.shape)
        yes, no = times * y, times * (1 - y)
        for v in (-1, 0, 1):
            is_v = votes == v
            ratios += is_v * (np.log(((is_v * yes[:, None]).sum(0) + 0.5) / (yes.sum() + 1.5)) - np.log(((is_v * no[:, None]).sum(0) + 0.5) / (no.sum() + 1.5)))
        means = [(ratios * w[:, None]).sum(0) / w.sum() for w in (no, yes)]
        spread = sum(((ratios - m) * w[:, None]).T @ (ratios - m) for m, w in zip(means, (no, yes), strict=True)) / times.sum()
        ridge = np.diag(0.05 * np.diag(spread) + 0.05)
        weights = np.clip(np.linalg.solve(spread + ridge, means[1] - means[0]), 0.0, 1.0)
        share = yes.sum() / times.sum()
        prior = log(max(share, 1e-6) / max(1 - share, 1e-6))
        y = 1 / (1 + np.exp(-np.clip(ratios @ weights + prior, -30, 30)))
    return y


def fit_linear(hits: list[np.ndarray], y: np.ndarray, n_inputs: int, steps: int = 500, decay: float = 3e-5, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression on the presence of inputs, for soft labels; a row stands for ``times`` rows."""
    share = np.full(len(y), 1 / len(y)) if times is None else times / times.sum()
    of = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    at = np.concatenate([*hits, np.zeros(0, np.int64)]).astype(np.int64)
    w, b = np.zeros(n_inputs), -2.0
    gain = [np.zeros(n_inputs + 1) for _ in range(2)]
    for step in range(1, steps + 1):
        z = b + np.bincount(of, w[at], len(hits))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        miss = (p - y) * share
        grad = np.append(np.bincount(at, miss[of], n_inputs) + decay * w, miss.sum())
        gain[0] = 0.9 * gain[0] + 0.1 * grad
        gain[1] = 0.999 * gain[1] + 0.001 * grad**2
        move = 0.1 * gain[0] / (1 - 0.9**step) / (np.sqrt(gain[1] / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    offset: float

    def score(self, texts: pa.Array) -> pa.Array:
        out = []
        for _, part in blocks(texts):
            entries, of = self.lexicon.hits(part)
            inputs, of = self.lexicon.inputs(entries, of)
            z = self.offset + np.bincount(of, self.weights[inputs], len(part))
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return pa.array(np.concatenate([*out, np.zeros(0)]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); hold rows out by leaving them out of ``labels``."""
    from ..runtime import discard, ship

    ship(docs.sparkSession)
    taken = training_rows(docs, labels)
    sizes = {r["toxic"]: r["n"] for r in taken.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    none = Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if not n_toxic or not n_clean:
        return Model(none, np.zeros(len(SHARDS)), 30.0 if n_toxic else -30.0)
    lexicon = induce(taken, n_toxic, n_clean)
    rows = taken.mapInArrow(_hits_and_votes(lexicon), "toxic int, hits array<int>, votes binary").groupBy("toxic", "hits", "votes").agg(F.count("*").alias("n")).toArrow()
    discard(taken)
    hits = [np.asarray(h, np.int64) for h in rows["hits"].to_pylist()]
    given, times = rows["toxic"].to_numpy(), rows["n"].to_numpy().astype(np.float64)
    cast = np.frombuffer(b"".join(rows["votes"].to_pylist()), np.int8).reshape(len(given), -1)
    order = sorted(range(len(given)), key=lambda k: (given[k], len(hits[k]), hits[k].tobytes(), cast[k].tobytes()))  # sums don't depend on the order of tasks
    hits, times = [hits[k] for k in order], times[order]
    kinds, which = np.unique(np.column_stack([cast, np.where(given > 0, 1, -1)])[order], axis=0, return_inverse=True)
    y = label_model(kinds.astype(np.float64), times=np.bincount(which.ravel(), times))[which.ravel()]
    return Model(lexicon, *fit_linear(hits, y, len(lexicon.hashes) + len(SHARDS), times=times))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, to: str = "score", flag: str = "predicted") -> DataFrame:
    """Add the columns ``to`` and ``flag``, from ``text`` alone. The broadcast model has the lexicon's entries, which occur in three toxic rows or more, and a fixed table of 1 MB."""
    from ..runtime import ship

    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of_text(texts: pa.Array) -> pa.Array:
        return shared.value.score(texts)

    return docs.withColumn(to, of_text(F.col("text"))).withColumn(flag, (F.col(to) >= threshold).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the labels of documents that are not held out, score all documents."""
    from ..runtime import table
    from .language import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")

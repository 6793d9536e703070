"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of anything but letters become one blank, and all
n-grams of 1 to 3 characters are hashed into a fixed number of buckets. Counts
by language are summed in Spark; the log-probability matrix (languages times
buckets, its size fixed by these) is broadcast, and a batch of texts is scored
by gathering the matrix rows of its n-grams and summing them by text.

Training takes all rows. A caller may bound them by ``train_rows``: rows are then chosen by a hash of the id, with the
same expected share of every language, but all rows of a language with up to ``FEW`` and about as many of any other at least.

Defined cases: a null text, or one without letters, is ``und`` with score 0;
rows whose language is null do not train; a language without any n-gram is not listed; without any training rows everything
is ``und``; ties go to the language that comes first by code point. Extra
columns pass through; one named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import blocks, raw_bytes

BUCKETS = 1 << 15
FEW = 1_000
#: The matrix is broadcast, 128 KB a language; more languages than this are refused rather than dropped.
MAX_LANGUAGES = 2_000
#: Log probabilities that a task gathers at once.
GATHERED = 1 << 20
UNKNOWN = "und"
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """Of every code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def ngrams(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text index) of all n-grams of 1 to 3 characters, n by n, and whether each text has a letter."""
    data, offsets = raw_bytes(pc.utf8_lower(texts))
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(n, bool)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    starts = (data & 0xC0) != 0x80
    lengths = np.diff(np.concatenate([[0], np.cumsum(starts)])[offsets])
    text = np.repeat(np.arange(n, dtype=np.int32), lengths)
    letter = _is_letter()[points]
    has = np.zeros(n, bool)
    has[text[letter]] = True
    kept = letter.copy()
    kept[1:] |= letter[:-1] & (text[1:] == text[:-1])  # a run of others leaves its first, as a blank
    chars = np.where(letter, points, np.uint32(32))[kept].astype(np.uint32)
    text = text[kept]
    found, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    h = np.zeros(len(chars), np.uint32)
    for k in range(3):
        if len(chars) <= k:
            break
        h = h[: len(chars) - k] * np.uint32(0x01000193) + (chars[k:] + np.uint32(1)) * np.uint32(0x9E3779B1)
        same = text[k:] == text[: len(text) - k]
        g = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        found.append((((g ^ (g >> np.uint32(13))) % np.uint32(buckets))[same]).astype(np.int64))
        of.append(text[: len(text) - k][same])
    return np.concatenate(found), np.concatenate(of), has


def _counts(languages: list[str], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * buckets, np.int64)
        place = {x: k for k, x in enumerate(languages)}
        for batch in batches:
            known = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for row, part in blocks(batch.column("text")):
                grams, of, _ = ngrams(part, buckets)
                total += np.bincount(known[row + of] * buckets + grams, minlength=len(total))
        some = np.flatnonzero(total)
        for lo in range(0, len(some), 50_000):
            at = some[lo : lo + 50_000]
            yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return run


def train(rows: DataFrame, train_rows: int | None = None, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each bucket and language (buckets by languages), from rows with doc_id, text and lang."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    languages = sorted(sizes)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; at most {MAX_LANGUAGES} fit into the matrix that is broadcast")
    if not languages:
        return [], np.zeros((buckets, 0), np.float32)
    if train_rows is not None and train_rows < sum(sizes.values()):
        share = train_rows / sum(sizes.values())
        cuts = [F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, max(share, FEW / n)) * 1_000_003))]
        rows = rows.where(F.coalesce(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_003)) < F.element_at(F.create_map(*cuts), F.col("lang")), F.lit(False)))
    counted = rows.select("text", "lang").mapInArrow(_counts(languages, buckets), "cell long, n long")
    total = np.zeros(len(languages) * buckets)
    for r in counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
        total[r.column("cell").to_numpy()] = r.column("n").to_numpy()
    counts = total.reshape(len(languages), buckets)
    some = counts.any(1)
    languages, counts = [x for x, ok in zip(languages, some, strict=True) if ok], counts[some] + 0.1
    return languages, np.ascontiguousarray(np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32))


RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def predict(texts: pa.Array, languages: list[str], matrix: np.ndarray) -> pa.Array:
    """lang_pred and score of each text. The score is the softmax of log likelihoods, tempered by the root of the text's length."""
    best, score = [], []
    for _, part in blocks(texts):
        grams, of, has = ngrams(part, len(matrix))
        n = len(part)
        sums = np.zeros((n, len(languages)))
        step = max(1024, GATHERED // max(len(languages), 1))
        for lo in range(0, len(grams) if languages else 0, step):
            # The n-grams of a text follow each other, so its rows of the matrix are one sum, for all languages at once.
            own = of[lo : lo + step]
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            np.add.at(sums, own[starts], np.add.reduceat(matrix[grams[lo : lo + step]], starts, axis=0, dtype=np.float64))
        has &= len(languages) > 0
        if languages:
            tempered = sums / np.sqrt(np.maximum(np.bincount(of, minlength=n), 1))[:, None]
            odds = np.exp(tempered - tempered.max(1, keepdims=True))
            top = sums.argmax(1)
            score += np.where(has, odds[np.arange(n), top] / odds.sum(1), 0.0).tolist()
            best += [languages[k] if ok else UNKNOWN for k, ok in zip(top, has, strict=True)]
        else:
            score += [0.0] * n
            best += [UNKNOWN] * n
    return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64())], fields=list(RESULT))


def identify(docs: DataFrame, languages: list[str], matrix: np.ndarray) -> DataFrame:
    """Add lang_pred and score, from ``text`` alone."""
    from ..runtime import ship

    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast((languages, matrix))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def guess(texts: pa.Array) -> pa.Array:
        return predict(texts, *model.value)

    return docs.drop("lang_pred", "score").withColumn("tidemark__guess", guess(F.col("text"))).select("*", "tidemark__guess.lang_pred", "tidemark__guess.score").drop("tidemark__guess")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "utf-8")) % 3 == 1


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the documents that are not held out, predict the language of all."""
    from ..runtime import ship, table

    ship(spark)
    docs = table(spark, sf_dir, "documents")
    languages, matrix = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), languages, matrix).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

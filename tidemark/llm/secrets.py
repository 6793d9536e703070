"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Patterns: assignments to password-like names, access key ids, long hexadecimal
runs. The test looks at other unbroken runs of letters, digits and ``+/_=-``:
text that a byte-pair vocabulary knows needs few tokens, random strings need many,
so a run with few characters per token is reported, or, if readable parts of it hide that, each of its pieces between ``/ _ - =`` that has.
Not tested are known kinds of digests (hexadecimal of a digest's length), UUIDs and numbers, what lies inside a
pattern's match, runs of fewer than ``MIN_DISTINCT`` different characters, and runs that are written like words: without a digit and
with fewer than ``MIN_CAPITALS`` capitals after the first letter, or without any small letter.

A linear-time scan over the Arrow column finds the texts that can match at all;
only these are searched one by one. Texts are never cut.

Defined cases: a null or empty text has no spans; offsets are code points, ends
exclusive; spans are ordered by start, then kind; repeated rows are scanned
each; extra columns pass through, one named like the result is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary's ranks are: base64 of each token and its rank, a line each.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a byte-level BPE of that kind splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PIECE = re.compile(r"[A-Za-z0-9+]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|[0-9A-F]{128})$")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
NUMBER = re.compile(r"[0-9+/_=-]+$")
MIN_ASSIGNED, MIN_ACCESS = 6, 20
MIN_DISTINCT, MIN_CAPITALS = 8, 3
#: Runs below so many characters a token are random; words and identifiers made of them lie above.
MAX_RATIO = 1.9
#: For Arrow's linear-time matcher: texts without this have no span of any kind.
_MAY_MATCH = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=]|AKIA[A-Z0-9]{16}|[A-Za-z0-9+/_=-]{20}|[0-9a-f]{24}"""

SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

_encodings: dict[str, object] = {}


def encoding(ranks: str):
    """The encoding of a vocabulary file's contents; one for each worker."""
    key = hashlib.md5(ranks.encode()).hexdigest()
    if key not in _encodings:
        import tiktoken

        parsed = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=parsed, special_tokens={})
    return _encodings[key]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans in order of start, then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGNED]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _is_random(run: str, encode, max_ratio: float) -> bool:
    if len(set(run)) < MIN_DISTINCT or DIGEST.match(run) or UUID.match(run) or NUMBER.match(run):
        return False
    digits, capitals, small = any(c.isdigit() for c in run), sum(c.isupper() for c in run[1:]), any(c.islower() for c in run)
    if not (digits and (capitals or small)) and not (capitals >= MIN_CAPITALS and small):
        return False
    return len(run) < max_ratio * len(encode(run))


def random_spans(text: str, base: list[tuple[str, int, int]], encode, max_ratio: float = MAX_RATIO) -> list[tuple[str, int, int]]:
    """Runs, or pieces of them, that the vocabulary compresses badly."""
    found = []
    for m in RUN.finditer(text):
        runs = [(m.start(), m.end())]
        if not _is_random(m[0], encode, max_ratio):
            runs = [(m.start() + x.start(), m.start() + x.end()) for x in PIECE.finditer(m[0]) if len(x[0]) < len(m[0]) and _is_random(x[0], encode, max_ratio)]
        found += [("random", lo, hi) for lo, hi in runs if not any(a <= lo and hi <= b for _, a, b in base)]
    return found


def scan(texts: pa.Array, ranks: str, max_ratio: float = MAX_RATIO) -> pa.Array:
    """Spans of each text."""
    hits = pc.fill_null(pc.match_substring_regex(texts, _MAY_MATCH), False).to_numpy(zero_copy_only=False)
    rows: list[list[dict]] = [[] for _ in range(len(texts))]
    encode = encoding(ranks).encode_ordinary if hits.any() else None
    for k in hits.nonzero()[0]:
        text = texts[int(k)].as_py()
        base = base_spans(text)
        spans = sorted(base + random_spans(text, base, encode, max_ratio), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
        rows[k] = [{"kind": kind, "start": lo, "end": hi} for kind, lo, hi in spans]
    return pa.array(rows, _SPAN)


def find_secrets(docs: DataFrame, text: str = "text", to: str = "spans", vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Add the column ``to``: the spans of ``text``. The driver reads the vocabulary and broadcasts it (about 1 MB)."""
    from ..runtime import ship

    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, encoding="ascii") as file:
        ranks = spark.sparkContext.broadcast(file.read())

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return scan(texts, ranks.value, max_ratio)

    return docs.withColumn(to, spans(F.col(text)))


def span_list(spans: Column, base_only: bool = False) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    if base_only:
        spans = F.filter(spans, lambda s: s["kind"] != "random")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", vocabulary: str = VOCABULARY) -> DataFrame:
    """Replace every span of ``text`` by ``mark``; overlapping spans become one mark. Null texts stay null."""
    found = find_secrets(docs, text, "tidemark__spans", vocabulary)
    # Spans come by start: each adds what lies between the furthest end so far and its start, and a mark unless it overlaps.
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("upto"))
    step = lambda acc, s: F.struct(
        F.when(s["start"] < acc["upto"], acc["done"]).otherwise(F.concat(acc["done"], F.substring(F.col(text), acc["upto"] + 1, s["start"] - acc["upto"]), F.lit(mark))).alias("done"),
        F.greatest(acc["upto"], s["end"]).alias("upto"),
    )
    whole = F.aggregate("tidemark__spans", start, step, lambda acc: F.concat(acc["done"], F.substring(F.col(text), acc["upto"] + 1, F.length(F.col(text)))))
    return found.withColumn(text, F.when(F.size("tidemark__spans") > 0, whole).otherwise(F.col(text))).drop("tidemark__spans")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    from ..runtime import table

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), to="found")
    counts = [F.size(F.expr(f"filter(found, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(span_list(F.col("found"), base_only=True), 256).alias("base_sha256"), span_list(F.col("found")).alias("spans"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7 that fixed patterns decide, which SQL can express."""
    return op7_secret_scan(spark, sf_dir).drop("spans")


def _matches_sql(kind: str, pattern: str, group: int, least: int) -> str:
    """Matches of one kind: those before a match and the text between them make up its start."""
    whole, own = f"regexp_extract_all(text, '{pattern}')", f"regexp_extract_all(text, '{pattern}', {group})"
    return f"""SELECT doc_id, '{kind}' AS kind, begins + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS lo, length(found[k]) AS n, length(groups[k]) AS own
  FROM (SELECT doc_id, found, groups, k, list_sum(list_transform(rest[1:k], lambda x: length(x))) AS begins
        FROM (SELECT doc_id, {whole} AS found, {own} AS groups, regexp_split_to_array(text, '{pattern}') AS rest, unnest(range(1, len({whole}) + 1)) AS k FROM d)) WHERE own >= {least}"""


#: Letters in either case, written out, as matching without case would also take letters beyond ASCII.
_EITHER = {w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api")}
_ASSIGN_SQL = f"({'|'.join([*list(_EITHER.values())[:4], _EITHER['api'] + '_?[Kk][Ee][Yy]'])})[\"'']? *[:=] *[\"'']?([A-Za-z0-9+/_.=-]+)"
BASE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_matches_sql("assign", _ASSIGN_SQL, 2, MIN_ASSIGNED)}
UNION ALL {_matches_sql("access", "AKIA[A-Z0-9]{16,}", 0, MIN_ACCESS)}
UNION ALL {_matches_sql("hex", "[0-9a-f]{24,}", 0, 24)}),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || lo || ':' || (lo + n), ',' ORDER BY lo, list_position(['assign', 'access', 'hex'], kind)) AS spans FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN s USING (doc_id)
"""

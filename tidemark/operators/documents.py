"""Collections of schema-free documents: find, aggregate, index, validate, change.

A collection is a DataFrame with a unique text column ``_id`` and either a
VARIANT column ``doc`` or typed columns as fields. With typed columns every filter,
sort and aggregate is an expression over these columns, so that Parquet gets the filters
and the scan reads only the fields in use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ColumnFields, VariantFields, value_text
from ..types import EmptyDocument, InvalidAggregate, InvalidJSON, InvalidOption

AGGREGATES = {"sum": "sum", "avg": "average", "min": "minimum", "max": "maximum"}


def parse_aggregate(spec: str) -> tuple[str, str | None]:
    """``count``, or ``op:field``, split at the first colon."""
    if spec == "count":
        return "count", None
    op, colon, field = spec.partition(":")
    if op not in AGGREGATES or not colon or not field:
        raise InvalidAggregate(f"invalid aggregate {spec!r}")
    return op, field


def check_options(limit: object = -1, offset: object = 0, sort: object = None) -> None:
    if not isinstance(limit, int) or isinstance(limit, bool) or limit < -1:
        raise InvalidOption(f"invalid limit {limit!r}")
    if not isinstance(offset, int) or isinstance(offset, bool) or offset < 0:
        raise InvalidOption(f"invalid offset {offset!r}")
    if sort is not None and not isinstance(sort, str):
        raise InvalidOption(f"invalid sort {sort!r}")


class DocumentCollection:
    """Documents as a lazy view; every operation returns a DataFrame."""

    def __init__(self, df: DataFrame, fields: Sequence[str] | None = None, doc: str = "doc", key: str = "_id"):
        """``fields`` names typed columns; without it ``doc`` is a VARIANT column."""
        self.df, self.key = df, key
        self.fields_of = VariantFields(doc) if fields is None else ColumnFields(df.schema, list(fields))
        self.columns = [doc] if fields is None else list(fields)

    def matches(self, field: str, value: object) -> Column:
        """Whether the field's text equals the value's text; nested values and ``_id`` never match."""
        text = value_text(value)
        return F.lit(False) if text is None else self.fields_of.match(field, text)

    def order(self, sort: str | None) -> list[Column]:
        """``F`` ascending or ``-F`` descending; missing and null last either way, ties in ``_id`` order."""
        if not sort or sort == "-":
            return [F.col(self.key).asc()]
        return [*self.fields_of.sort_keys(sort.removeprefix("-"), sort.startswith("-")), F.col(self.key).asc()]

    def find(self, field: str, value: object, limit: int = -1, offset: int = 0, sort: str | None = None) -> DataFrame:
        """Documents whose field equals the value, in order; limit -1 is none, 0 is empty."""
        check_options(limit, offset, sort)
        return self._page(self.df.where(self.matches(field, value)), limit, offset, sort)

    def _page(self, found: DataFrame, limit: int, offset: int, sort: str | None) -> DataFrame:
        if limit == 0:
            return found.limit(0)
        found = found.orderBy(*self.order(sort))
        if offset:
            found = found.offset(offset)
        return found.limit(limit) if limit > 0 else found

    def find_one(self, field: str, value: object) -> DataFrame:
        return self.find(field, value, limit=1)

    def get(self, key: str) -> DataFrame:
        return self.df.where(F.col(self.key) == key)

    def exists(self, key: str) -> bool:
        return not self.get(key).isEmpty()

    def aggregate(self, field: str, value: object, spec: str) -> DataFrame:
        """One row: ``count``, or ``field`` and the result; numbers only, null if there are none."""
        op, of = parse_aggregate(spec)
        found = self.df.where(self.matches(field, value))
        if op == "count":
            return found.agg(F.count(F.lit(1)).alias("count"))
        return found.agg(F.lit(of).alias("field"), getattr(F, op)(self.fields_of.number(of)).cast("double").alias(AGGREGATES[op]))

    def pairs(self) -> DataFrame:
        """(field, value_key, _id) of every scalar field."""
        return self.fields_of.pairs(self.df, self.key)

    def index(self) -> DataFrame:
        """The inverted index as counts: (field, value_key, n_ids). Ids stay in ``pairs``, as a common value has any number of them."""
        return self.pairs().groupBy("field", "value_key").agg(F.count(F.lit(1)).alias("n_ids"))

    def indexed_fields(self) -> DataFrame:
        return self.pairs().select("field").distinct()

    def find_by_index(self, pairs: DataFrame, field: str, value: object, limit: int = -1, offset: int = 0, sort: str | None = None) -> DataFrame:
        """The same as ``find``, through a materialised index; ids without a document are skipped and do not count towards the offset."""
        check_options(limit, offset, sort)
        hits = pairs.where((F.col("field") == field) & (F.col("value_key") == value_text(value))).select(self.key)
        return self._page(self.df.join(hits, self.key, "left_semi"), limit, offset, sort)


def aggregate_body(result: DataFrame) -> DataFrame:
    """The answer to an aggregate as JSON text: ``{"field":..,"sum":..}``, with ``value`` null in place of a result that does not exist."""
    name = result.columns[-1]
    if name == "count":
        return result.select(F.to_json(F.struct("count")).alias("body"))
    none = F.concat(F.lit('{"field":'), F.to_json(F.array("field")).substr(F.lit(2), F.length(F.to_json(F.array("field"))) - 2), F.lit(',"value":null}'))
    return result.select(F.when(F.col(name).isNull(), none).otherwise(F.to_json(F.struct("field", name))).alias("body"))


def index_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Index entries to remove and to add when documents change: (action, field, value_key, _id)."""
    gone, new = before.exceptAll(after), after.exceptAll(before)
    return gone.select(F.lit("remove").alias("action"), "*").unionByName(new.select(F.lit("add").alias("action"), "*"))


def parse_documents(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``doc`` (VARIANT, null unless valid) and ``problem``: null, ``empty document`` or ``invalid json``."""
    trimmed = F.trim(F.coalesce(F.col(body), F.lit("")))
    # The parser stops after the first value. In an array with a mark after it, what follows that value is an error or moves the mark.
    mark = F.md5(body)
    marked = F.try_parse_json(F.concat(F.lit("["), F.col(body), F.lit(',"'), mark, F.lit('"]')))
    whole = (F.try_variant_get(marked, "$[1]", "string") == mark) & F.try_variant_get(marked, "$[2]", "variant").isNull()
    doc = F.when(whole, F.try_variant_get(marked, "$[0]", "variant"))
    kind = F.schema_of_variant(doc)
    # Numbers beyond the range of doubles are read as infinite; such documents are not valid.
    infinite = F.regexp_like(kind, F.lit("DOUBLE")) & F.regexp_like(F.to_json(doc), F.lit(r'(^|[:,\[])"?-?Infinity"?'))
    problem = (
        F.when((F.col(body).isNull()) | (F.octet_length(body) == 0), "empty document")
        .when(doc.isNull(), "invalid json")
        .when((kind == "VOID") | (kind == "OBJECT<>"), "empty document")
        .when(~kind.startswith("OBJECT<") | F.coalesce(infinite, F.lit(False)) | (trimmed == ""), "invalid json")
    )
    return df.withColumn("problem", problem).withColumn("doc", F.when(F.col("problem").isNull(), doc))


def validate(df: DataFrame, body: str = "body") -> DataFrame:
    """``parse_documents``, failing on the first bad row when it is evaluated."""
    parsed = parse_documents(df, body)
    return parsed.where(F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("boolean")).otherwise(F.lit(True)))


def check_document(body: str | bytes | None) -> dict:
    """Driver-side validation of one document."""
    import json

    if not body:
        raise EmptyDocument("empty document")
    try:
        value = json.loads(body, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except ValueError as e:
        raise InvalidJSON(str(e)) from e
    if value is None:
        raise EmptyDocument("empty document")
    if not isinstance(value, dict) or any(isinstance(v, float) and v in (float("inf"), float("-inf")) for v in value.values()):
        raise InvalidJSON("not an object")
    if not value:
        raise EmptyDocument("empty document")
    return value


def escape_html(text: Column) -> Column:
    """JSON text with ``<``, ``>``, ``&`` and the two line separators beyond ASCII written as escapes; outside of strings none occurs."""
    for plain, code in (("<", "003c"), (">", "003e"), ("&", "0026"), ("\u2028", "2028"), ("\u2029", "2029")):
        text = F.replace(text, F.lit(plain), F.lit(f"\\u{code}"))
    return text


def to_body(df: DataFrame, doc: str = "doc", key: str = "_id") -> DataFrame:
    """(key, body): documents as JSON text with the system's ``_id`` first, whatever ``_id`` they hold themselves."""
    text = F.to_json(F.col(doc))
    own = F.regexp_replace(text, r"^\{", "")
    without = F.when(F.try_variant_get(F.col(doc), '$["_id"]', "variant").isNull(), own).otherwise(F.regexp_replace(F.to_json(F.map_filter(F.try_variant_get(F.col(doc), "$", "map<string,variant>"), lambda k, _: k != "_id")), r"^\{", ""))
    return df.select(key, escape_html(F.concat(F.lit('{"_id":'), F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.when(without == "}", F.lit("")).otherwise(F.lit(",")), without)).alias("body"))


def latest(feed: DataFrame) -> DataFrame:
    """Live documents from a feed of (seq, ts, op, _id, doc columns): the last whole version of each, deletes drop it."""
    doc = [c for c in feed.columns if c not in ("seq", "ts", "op", "_id")]
    last = feed.groupBy("_id").agg(F.max_by(F.struct("op", *doc), F.struct("ts", "seq")).alias("last"))
    return last.where(F.col("last.op") != "delete").select("_id", *[F.col(f"last.`{c}`") for c in doc])

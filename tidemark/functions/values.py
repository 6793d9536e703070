"""Text rendering of scalar values, and typed expressions over the fields of documents.

A field's value is compared by its text: 22, 22.0 and "22" have the same
text ``22``. Instead of rendering every row, a lookup text is turned into an OR
of typed comparisons once, on the driver, so that filters reach the scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TEXT = "<nil>"
#: A number is written with an exponent if its decimal exponent is below the first or from the second on.
EXPONENT_BELOW, EXPONENT_FROM = -4, 6


def number_text(x: float) -> str:
    """The shortest digits that read back as x; large and small numbers with an exponent of two digits or more."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    sign = "-" if math.copysign(1, x) < 0 else ""
    mantissa, _, exponent = f"{abs(x)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    if not digits:
        return f"{sign}0"
    place = len(whole) + int(exponent or 0) - (len(whole + part) - len(digits))  # the point stands after so many digits
    digits = digits.rstrip("0")
    e = place - 1
    if e < EXPONENT_BELOW or e >= EXPONENT_FROM:
        return f"{sign}{digits[0]}{'.' + digits[1:] if digits[1:] else ''}e{'-' if e < 0 else '+'}{abs(e):02d}"
    if place <= 0:
        return f"{sign}0.{'0' * -place}{digits}"
    whole, part = digits[:place].ljust(place, "0"), digits[place:]
    return f"{sign}{whole}{'.' + part if part else ''}"


def value_text(value: object) -> str | None:
    """The text of a scalar Python value; None for nested values."""
    if value is None:
        return NULL_TEXT
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | str):
        return str(value)
    if isinstance(value, float):
        return number_text(value)
    return None


def number_of(text: str) -> float | None:
    """The number whose text this is, if any."""
    try:
        x = float(text)
    except ValueError:
        return None
    return x if math.isfinite(x) and number_text(x) == text else None


def number_key(x: Column) -> Column:
    """``number_text`` as an expression, for building an index."""
    magnitude = F.abs(x).cast("string")
    mantissa = F.substring_index(magnitude, "E", 1)
    exponent = F.when(F.instr(magnitude, "E") > 0, F.substring_index(magnitude, "E", -1).cast("int")).otherwise(F.lit(0))
    whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    every = F.concat(whole, part)
    led = F.ltrim(every, F.lit("0"))
    digits = F.rtrim(led, F.lit("0"))
    place = F.length(whole) + exponent - (F.length(every) - F.length(led))
    e = place - 1
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    tail = lambda n: F.substring(digits, n + 1, F.length(digits))
    scientific = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), tail(F.lit(1)))).otherwise(F.lit("")), F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -place), digits)
    plain = F.when(F.length(digits) <= place, F.rpad(digits, place, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), place), F.lit("."), tail(place)))
    text = F.when(F.length(led) == 0, F.lit("0")).when((e < EXPONENT_BELOW) | (e >= EXPONENT_FROM), scientific).when(place <= 0, small).otherwise(plain)
    # Whole numbers below the exponent's range, the usual case, need one cast; the other branch is not evaluated for them.
    whole_number = (F.abs(x) < 10**EXPONENT_FROM) & (x == F.floor(x))
    return F.when(F.isnan(x), F.lit("NaN")).when(whole_number, F.floor(x).cast("string")).otherwise(F.concat(sign, text))


class VariantFields:
    """Fields of a VARIANT column: every document may hold another type."""

    def __init__(self, doc: str = "doc"):
        self.doc = doc

    def _value(self, field: str) -> Column:
        quoted = field.replace("\\", "\\\\").replace('"', '\\"')
        return F.try_variant_get(F.col(self.doc), f'$["{quoted}"]', "variant")

    def _kind(self, field: str) -> Column:
        return F.coalesce(F.schema_of_variant(self._value(field)), F.lit("MISSING"))

    def _as(self, field: str, kind: str) -> Column:
        quoted = field.replace("\\", "\\\\").replace('"', '\\"')
        return F.try_variant_get(F.col(self.doc), f'$["{quoted}"]', kind)

    @staticmethod
    def _is_number(kind: Column) -> Column:
        return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")

    def match(self, field: str, text: str) -> Column:
        if field == "_id":
            return F.lit(False)
        # Values first: the kind, which takes longer to tell, is asked for the few that are equal.
        kind = self._kind(field)
        found = (self._as(field, "string") == text) & (kind == "STRING")
        number = number_of(text)
        if number is not None:
            found |= (self._as(field, "double") == number) & self._is_number(kind)
        if text in ("true", "false"):
            found |= (self._as(field, "boolean") == (text == "true")) & (kind == "BOOLEAN")
        if text == NULL_TEXT:
            found |= kind == "VOID"
        return F.coalesce(found, F.lit(False))

    def number(self, field: str) -> Column:
        """The field's number, null for everything else, numeric-looking text included."""
        return F.when(self._is_number(self._kind(field)), self._as(field, "double"))

    def key(self, field: str) -> Column:
        kind = self._kind(field)
        return (
            F.when(kind == "STRING", self._as(field, "string"))
            .when(self._is_number(kind), number_key(self._as(field, "double")))
            .when(kind == "BOOLEAN", self._as(field, "boolean").cast("string"))
            .when(kind == "VOID", F.lit(NULL_TEXT))
        )

    def sort_keys(self, field: str, descending: bool) -> list[Column]:
        """Missing and null last; within the others booleans, numbers, texts, nested values (these equal each other)."""
        kind = self._kind(field)
        rank = F.when(kind == "BOOLEAN", 0).when(self._is_number(kind), 1).when(kind == "STRING", 2).otherwise(3)
        present = ~kind.isin("MISSING", "VOID")
        keys = [F.when(present, rank), F.when(kind == "BOOLEAN", self._as(field, "boolean")), self.number(field), F.when(kind == "STRING", self._as(field, "string"))]
        return [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]

    def pairs(self, df: DataFrame, key: str = "_id") -> DataFrame:
        """(field, value_key, key) of every scalar field: the rows of an inverted index."""
        rows = df.select(F.col(key), F.col(self.doc).alias("doc")).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("doc").outer())).select(key, F.col("key").alias("field"), F.col("value").alias("v"))
        kind = F.schema_of_variant(F.col("v"))
        text = F.when(kind == "STRING", F.try_variant_get("v", "$", "string")).when(self._is_number(kind), number_key(F.try_variant_get("v", "$", "double"))).when(kind == "BOOLEAN", F.try_variant_get("v", "$", "boolean").cast("string")).when(kind == "VOID", F.lit(NULL_TEXT))
        return rows.where(F.col("field") != "_id").select("field", text.alias("value_key"), key).where(F.col("value_key").isNotNull())


class ColumnFields:
    """Fields that are typed columns, known when the plan is built: filters and sorts use the columns themselves."""

    def __init__(self, schema: T.StructType, fields: list[str]):
        self.kinds = {f: self._kind_of(schema[f].dataType) for f in fields}

    @staticmethod
    def _kind_of(kind: T.DataType) -> str:
        if isinstance(kind, T.NumericType):
            return "number"
        if isinstance(kind, T.BooleanType):
            return "boolean"
        if isinstance(kind, T.StructType | T.ArrayType | T.MapType | T.VariantType | T.BinaryType):
            return "nested"
        return "string"

    def _column(self, field: str) -> Column:
        column = F.col(f"`{field}`")
        return column.cast("double") if self.kinds[field] == "number" else column.cast("string") if self.kinds[field] == "string" else column

    def match(self, field: str, text: str) -> Column:
        kind = self.kinds.get(field)
        if field == "_id" or kind in (None, "nested"):
            return F.lit(False)
        column = F.col(f"`{field}`")
        found = column.isNull() if text == NULL_TEXT else None
        number = number_of(text)
        typed = column == text if kind == "string" else None
        if kind == "number" and number is not None:
            typed = column == F.lit(int(number) if number.is_integer() and abs(number) < 2**53 else number)
        if kind == "boolean" and text in ("true", "false"):
            typed = column == F.lit(text == "true")
        both = [c for c in (found, typed) if c is not None]
        return both[0] | both[1] if len(both) == 2 else both[0] if both else F.lit(False)

    def number(self, field: str) -> Column:
        return self._column(field) if self.kinds.get(field) == "number" else F.lit(None).cast("double")

    def key(self, field: str) -> Column:
        kind = self.kinds.get(field)
        if kind in (None, "nested"):
            return F.lit(None).cast("string")
        column = self._column(field)
        return F.when(column.isNull(), F.lit(NULL_TEXT)).otherwise(number_key(column) if kind == "number" else column.cast("string"))

    def sort_keys(self, field: str, descending: bool) -> list[Column]:
        if self.kinds.get(field, "nested") == "nested":
            return []
        column = self._column(field)
        return [column.desc_nulls_last() if descending else column.asc_nulls_last()]

    def pairs(self, df: DataFrame, key: str = "_id") -> DataFrame:
        scalar = [f for f, k in self.kinds.items() if k != "nested" and f != "_id"]
        entries = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), self.key(f).alias("value_key")) for f in scalar])) if scalar else F.explode(F.array().cast("array<struct<field:string,value_key:string>>"))
        return df.select(key, entries.alias("e")).select("e.field", "e.value_key", key)

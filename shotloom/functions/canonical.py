"""Canonical JSON of columns of any schema: sorted keys, no spaces, UTF-8, shortest numbers.

The text is what Python's ``json.dumps`` writes with sorted keys, compact separators
and no ASCII escapes, built as one column expression. Not a number, infinities, and
types that JSON has no form for are errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that JSON strings may not hold, and how they are written (fixed values).
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_ESCAPES = {chr(c): _SHORT.get(chr(c), f"\\u{c:04x}") for c in range(32)}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def json_string(x: Column) -> Column:
    """A text as a JSON string."""
    plain = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    controlled = plain
    for c, written in _ESCAPES.items():
        controlled = F.replace(controlled, F.lit(c), F.lit(written))
    return F.concat(F.lit('"'), F.when(x.rlike(r"[\x00-\x1F]"), controlled).otherwise(plain), F.lit('"'))


def json_number(x: Column) -> Column:
    """The shortest decimal that reads back as the same double: plain from 1e-4 to below 1e16, else with an exponent of two digits or more.

    One digit more is tried until the number comes back. An infinity or what is not a
    number is an error.
    """
    size = F.abs(x)
    tries = [F.format_string(f"%.{p}e", size) for p in range(17)]
    short = F.coalesce(*(F.when(t.cast("double") == size, t) for t in tries[:-1]), tries[-1])
    parts = F.split(short, "e")
    told = F.transform(F.array(parts), lambda p: F.struct(F.regexp_replace(F.regexp_replace(p[0], r"\.", ""), "0+$", "").alias("d"), p[1].cast("int").alias("e")))

    def spelled(s: Column) -> Column:
        d, e, n = s["d"], s["e"], F.length(s["d"])
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(d, 2, 17))).otherwise("")
        far = F.concat(F.substring(d, 1, 1), tail, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
        far = F.when(F.abs(e) > 99, F.concat(F.substring(d, 1, 1), tail, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.abs(e).cast("string"))).otherwise(far)
        below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        among = F.concat(F.substring(d, F.lit(1), e + 1), F.lit("."), F.substring(d, e + 2, F.lit(17)))
        beyond = F.concat(d, F.repeat(F.lit("0"), e + 1 - n), F.lit(".0"))
        return F.when((e < -4) | (e >= 16), far).when(e < 0, below).when(n <= e + 1, beyond).otherwise(among)

    text = F.when(size == 0, "0.0").otherwise(F.transform(told, spelled)[0])
    minus = F.when((x < 0) | F.format_string("%.0f", x).startswith("-"), "-").otherwise("")
    error = F.raise_error(F.lit("not a finite number")).cast("string")
    return F.when(F.isnan(x) | (size == float("inf")), error).otherwise(F.concat(minus, text))


def canonical_json(x: Column, kind: T.DataType) -> Column:
    """Canonical JSON of a column of type ``kind``; null is ``null``. Keys of structs and (text-keyed) maps are sorted by code point."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        items = [F.concat(json_string(F.lit(f.name)), F.lit(":"), canonical_json(x[f.name], f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: canonical_json(v, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        ordered = F.transform(F.array_sort(F.map_keys(x)), lambda k: F.concat(json_string(k), F.lit(":"), canonical_json(F.element_at(x, k), kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(ordered, ","), F.lit("}"))
    elif isinstance(kind, T.StringType):
        text = json_string(x)
    elif isinstance(kind, (T.BooleanType, *_WHOLE)):
        text = x.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = json_number(x.cast("double"))
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no canonical form for {kind.simpleString()}")
    return F.when(x.isNull(), "null").otherwise(text)


def row_json(rows: DataFrame, *columns: str) -> Column:
    """Canonical JSON of an object of the columns (all if none are named)."""
    fields = [rows.schema[c] for c in columns or rows.columns]
    return canonical_json(F.struct(*(F.col(f.name) for f in fields)), T.StructType(fields))


def content_hash(rows: DataFrame, *columns: str) -> Column:
    """``sha256:`` and the digest of the columns' canonical JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(row_json(rows, *columns), 256))


def frozen_id(rows: DataFrame, prefix: str, *columns: str, length: int = 20) -> Column:
    """``prefix_`` and the first hex digits of the digest of the columns' canonical JSON: the same inputs, the same id."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(row_json(rows, *columns), 256), 1, length))

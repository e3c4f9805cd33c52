"""One text for one value: JSON with sorted keys, no blanks, ASCII alone and shortest numbers, as Columns built from a value's
type, and its digest. Equal to what Python's json writes with sort_keys, ensure_ascii and the separators "," and ":".

Null is `null`. Numbers that aren't finite have no JSON, so any value that holds one is null. Map keys are strings; a key that
is repeated can't be. Types that JSON doesn't have (times, decimals, binary) raise a TypeError when the plan is made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The short escapes of JSON, by UTF-16 unit.
ESCAPES = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "000C": "\\f", "000A": "\\n", "000D": "\\r", "0009": "\\t"}
SMALLEST_WHOLE = 2.2250738585072014e-308  # the smallest double of full precision
PLAIN = r"^[\x20-\x21\x23-\x5B\x5D-\x7E]*$"


def quoted(s: Column) -> Column:
    """A JSON string. Texts of plain ASCII stay as they are; others are written unit by unit of UTF-16."""
    def unit(h: Column) -> Column:
        out = F.when((h >= "0020") & (h <= "007E"), F.char(F.conv(h, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), F.lower(h)))
        for code, text in ESCAPES.items():
            out = F.when(h == code, text).otherwise(out)
        return out

    units = F.regexp_extract_all(F.hex(F.encode(s, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    return F.concat(F.lit('"'), F.when(s.rlike(PLAIN), s).otherwise(F.array_join(F.transform(units, unit), "")), F.lit('"'))


def number(x: Column) -> Column:
    """The shortest decimal that reads as the same double, in positional form from 1e-4 up to 1e16."""
    # The JVM may write more digits than needed; fewer ones that read the same are taken first. All doubles keep 15 digits,
    # but for the smallest, which keep fewer.
    shortest = lambda digits: F.coalesce(*[F.when(t.cast("double") == x, t) for t in (F.format_string(f"%.{n}e", x) for n in digits)], F.format_string("%.16e", x))
    short = F.when(F.abs(x) < SMALLEST_WHOLE, shortest(range(16))).otherwise(shortest((14, 15)))
    digits = F.regexp_replace(F.concat(F.regexp_extract(short, r"^-?([0-9])", 1), F.regexp_extract(short, r"\.([0-9]+)e", 1)), "(?<=.)0+$", "")
    exponent = F.regexp_extract(short, r"e([+-][0-9]+)$", 1).cast("int")
    n = F.length(digits)
    rest = F.substring(digits, 2, 400)
    far = F.concat(F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    whole = F.concat(digits, F.repeat(F.lit("0"), exponent - n + 1), F.lit(".0"))
    inside = F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.lit(400)))
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    near = F.when(exponent >= n - 1, whole).when(exponent >= 0, inside).otherwise(below)
    text = F.when(x == 0, "0.0").when((exponent < -4) | (exponent >= 16), far).otherwise(near)
    sign = F.when((x < 0) | ((x == 0) & x.cast("string").startswith("-")), "-").otherwise("")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.concat(sign, text))


def canonical(value: Column, kind: T.DataType) -> Column:
    """The canonical JSON of `value`, which has the type `kind`."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical(value.getField(f.name), f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), *[x for k, p in enumerate(parts) for x in ([F.lit(",")] if k else []) + [p]], F.lit("}"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.transform(F.map_keys(value), lambda k: k))
        parts = F.transform(entries, lambda k: F.concat(quoted(k), F.lit(":"), canonical(F.element_at(value, k), kind.valueType)))
        text = _joined(parts, "{", "}")
    elif isinstance(kind, T.ArrayType):
        text = _joined(F.transform(value, lambda x: canonical(x, kind.elementType)), "[", "]")
    elif isinstance(kind, T.StringType):
        text = quoted(value)
    elif isinstance(kind, T.BooleanType) or isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        text = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = number(value.cast("double"))
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"JSON has no {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(text)


def _joined(parts: Column, first: str, last: str) -> Column:
    """A list of texts in brackets; null where one of them is, as that can't be written."""
    return F.when(F.forall(parts, lambda p: p.isNotNull()), F.concat(F.lit(first), F.array_join(parts, ","), F.lit(last)))


def digest(value: Column, kind: T.DataType) -> Column:
    return F.sha2(canonical(value, kind), 256)

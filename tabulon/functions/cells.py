"""Canonical cell keys: one string per cell with Python's equality.

Results are compared as bags of untyped cells, where ``1 == 1.0 == True``,
``None`` equals only ``None`` and text never equals a number. Each cell
becomes a string key with exactly that equality:

* ``0``            null
* ``1:<number>``   numbers and booleans in one normal form of their digits
                   (:func:`digits`), so ``1``, ``1.0`` and ``true`` all give
                   ``1:1``: integers and decimals by their exact digits,
                   doubles by the digits of their shortest round-trip text,
                   integral doubles below 10**38 by their exact integer
* ``2:<text>``     strings; dates, timestamps and other types by their text

All of it is built from Spark SQL built-ins and stays in codegen.

:func:`cell_hash` gives a 64-bit key with the same equality from the typed
value, without its text where the type allows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)
#: Integral doubles from here on are beyond decimal(38) and keep their double text.
_DECIMAL_LIMIT = 1e38
_WHOLE = "decimal(38,0)"


def _exact_integer(d: Column) -> Column:
    """Exact text of an integral double below 10**38: three parts of 42 bits, put together as decimals."""
    base = float(2**42)
    size = F.abs(d)
    high = F.floor(size / F.lit(base * base)).cast("bigint")
    rest = size - high.cast("double") * F.lit(base * base)
    mid = F.floor(rest / F.lit(base)).cast("bigint")
    low = (rest - mid.cast("double") * F.lit(base)).cast("bigint")
    whole = (high.cast(_WHOLE) * F.lit(str(2**84)).cast(_WHOLE) + mid.cast(_WHOLE) * F.lit(str(2**42)).cast(_WHOLE) + low.cast(_WHOLE)).cast(_WHOLE)
    return F.concat(F.when(d < 0, F.lit("-")).otherwise(F.lit("")), whole.cast("string"))


def digits(text: Column) -> Column:
    """Normal form of a number's text, from its digits alone: no sign but ``-``, no needless zeros, no exponent where the
    number lies between 1e-38 and 1e38, else ``<digits>e<position of the point>``."""
    sign = F.when(F.trim(text).startswith("-"), F.lit("-")).otherwise(F.lit(""))
    whole, part = F.regexp_extract(text, r"^\s*[+-]?(\d*)", 1), F.regexp_extract(text, r"\.(\d*)", 1)
    power = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))
    every = F.concat(whole, part)
    led = F.regexp_replace(every, r"^0+", "")
    point = F.length(whole) + power - (F.length(every) - F.length(led))
    own = F.regexp_replace(led, r"0+$", "")
    size = F.length(own)
    plain = (F.when(own == "", F.lit("0"))
              .when(~point.between(-38, 38), F.concat(sign, own, F.lit("e"), point.cast("string")))
              .when(point >= size, F.concat(sign, F.rpad(own, point.cast("int"), "0")))
              .when(point > 0, F.concat(sign, F.substring(own, F.lit(1), point.cast("int")), F.lit("."), F.substring(own, point.cast("int") + 1, size)))
              .otherwise(F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -point.cast("int")), own)))
    return plain


def _rare_digits(text: Column) -> Column:
    """``digits`` for the few values that need it, as a lambda: kept out of the generated code of every column."""
    return F.element_at(F.transform(F.array(text), digits), 1)


def number_key(x: Column) -> Column:
    """Key of a double value (not null)."""
    d = x.cast("double")
    text = d.cast("string")
    small = (d == F.floor(d)) & (F.abs(d) < F.lit(9e18))
    large = F.abs(d).between(F.lit(9e18), F.lit(_DECIMAL_LIMIT)) & (F.abs(d) < F.lit(_DECIMAL_LIMIT))
    return (F.when(F.isnan(d), F.lit("1:nan"))
             .when(small, F.concat(F.lit("1:"), d.cast("bigint").cast("string")))
             .when(large, F.concat(F.lit("1:"), _exact_integer(d)))
             .when(F.abs(d) == float("inf"), F.concat(F.lit("1:"), text))
             .when(text.contains("E"), F.concat(F.lit("1:"), _rare_digits(text)))
             .otherwise(F.concat(F.lit("1:"), text)))


def cell_key(x: Column, dtype: T.DataType) -> Column:
    """Canonical key of a typed column."""
    if isinstance(dtype, _INTEGRAL):
        key = F.concat(F.lit("1:"), x.cast("string"))
    elif isinstance(dtype, T.DecimalType) and dtype.scale == 0:
        key = F.concat(F.lit("1:"), x.cast("string"))
    elif isinstance(dtype, T.DecimalType):
        text = x.cast("string")
        short = F.regexp_replace(text, r"\.?0+$", "")  # a scale of one or more always prints a point
        key = F.concat(F.lit("1:"), F.when(text.contains("E"), _rare_digits(text)).otherwise(short))
    elif isinstance(dtype, _FRACTIONAL):
        key = number_key(x)
    elif isinstance(dtype, T.BooleanType):
        key = F.when(x, F.lit("1:1")).otherwise(F.lit("1:0"))
    elif isinstance(dtype, T.StringType):
        key = F.concat(F.lit("2:"), x)
    elif isinstance(dtype, T.BinaryType):
        key = F.concat(F.lit("2:"), F.hex(x))
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        key = F.concat(F.lit("2:"), F.to_json(x))
    else:
        key = F.concat(F.lit("2:"), x.cast("string"))
    return F.when(x.isNull(), F.lit("0")).otherwise(key)


def _rare(x: Column, f) -> Column:
    """``f`` of the few values that need it, as a lambda: kept out of the generated code of every column."""
    return F.element_at(F.transform(F.array(x), f), 1)


_TYPED = (*_INTEGRAL, *_FRACTIONAL, T.BooleanType, T.DecimalType)


def hash_text(x: Column, dtype: T.DataType) -> Column | None:
    """The text by which cells of a type are hashed, where it is not the value itself: what :func:`cell_key` has behind ``2:``."""
    if isinstance(dtype, _TYPED) or dtype == T.StringType():
        return None
    if isinstance(dtype, T.BinaryType):
        return F.hex(x)
    if isinstance(dtype, T.StringType):  # of another collation
        return x.cast("binary").cast("string")
    return F.to_json(x) if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) else x.cast("string")


def cell_hash(x: Column, dtype: T.DataType, seed: int) -> Column:
    """64-bit key of a number, a boolean or a text (:func:`hash_text`): equal for cells of equal :func:`cell_key`, whatever their types,
    and never null.

    Whole numbers go by their 64-bit integer, other numbers by the double of the same digits, those that neither holds by their
    digits, everything else by its text.
    """
    kinds = ("null", "whole", "double", "digits", "text")

    def hashed(kind, *value):
        return F.xxhash64(F.lit(len(kinds) * seed + kinds.index(kind)), *value)

    d = x.cast("double") if isinstance(dtype, (*_FRACTIONAL, T.DecimalType)) else None
    if isinstance(dtype, (*_INTEGRAL, T.BooleanType)):
        key = hashed("whole", x.cast("bigint"))
    elif isinstance(dtype, T.DecimalType):
        own = cell_key(x, dtype)
        text = F.substring(own, 3, 1 << 30)
        held = text.try_cast("bigint")
        large = hashed("whole", held)
        if dtype.precision - dtype.scale > 18:
            exact = F.when(F.abs(d) < F.lit(_DECIMAL_LIMIT), _rare(d, _exact_integer) == text).otherwise(F.lit(False))
            large = F.when(held.isNotNull(), large).when(exact, hashed("double", d)).otherwise(hashed("digits", text))
        key = large
        if dtype.scale:
            # up to 15 digits a double always holds
            short = F.lit(True) if dtype.precision <= 15 else F.length(F.translate(text, "-.", "")) <= 15
            part = short if dtype.precision <= 15 else short | (_rare(d, number_key) == own)
            key = F.when(~text.contains("."), large).when(part, hashed("double", d)).otherwise(hashed("digits", text))
    elif isinstance(dtype, _FRACTIONAL):
        whole = (d >= F.lit(float(-(2**63)))) & (d < F.lit(float(2**63))) & (d == F.floor(d))
        key = F.when(whole, hashed("whole", F.floor(d))).otherwise(hashed("double", d))
    else:
        key = hashed("text", x)
    return F.when(x.isNull(), hashed("null")).otherwise(key)


_NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)\s*$"


def text_cell_key(x: Column) -> Column:
    """Key of a cell given as text (a literal answer): numbers by value, else text.

    A literal answer has lost its types; text that reads as a number is
    compared as that number, ``None``/``null`` as null, ``True``/``False`` as 1/0.
    Numbers go by their digits, never through a double, but for those printed
    with an exponent: only floats are printed so, and an integral one is the
    exact integer that the double holds.
    """
    s = F.trim(x)
    return (F.when(x.isNull() | s.isin("None", "null", "NULL"), F.lit("0"))
             .when(s.isin("True", "true"), F.lit("1:1"))
             .when(s.isin("False", "false"), F.lit("1:0"))
             .when(s.rlike(_NUMBER_TEXT), F.when(s.rlike("[eE]"), number_key(s.cast("double"))).otherwise(F.concat(F.lit("1:"), digits(s))))
             .otherwise(F.concat(F.lit("2:"), x)))


def literal_cell_key(x: Column, dtype: T.DataType) -> Column:
    """Key of a cell of a literal answer: text (see :func:`text_cell_key`), or ``struct<text, quoted>``
    as :func:`tabulon.functions.responses.typed_rows` gives it, where quoted text stays text."""
    if not isinstance(dtype, T.StructType):
        return text_cell_key(x)
    quoted = F.concat(F.lit("2:"), x["text"])
    return F.when(x["quoted"] & x["text"].isNotNull(), quoted).otherwise(text_cell_key(x["text"]))


def row_cells(df_schema: T.StructType, names: list[str]) -> Column:
    """``array(cell_key(c1), cell_key(c2), ...)`` for a row."""
    fields = {f.name: f.dataType for f in df_schema.fields}
    return F.array(*[cell_key(F.col(f"`{n}`"), fields[n]) for n in names])


def as_text_cells(cells) -> Column:
    """Cell keys as those of their texts: numbers by their normal form, null as ``None``."""
    return F.transform(cells, lambda x: F.when(x == "0", F.lit("2:None")).otherwise(F.concat(F.lit("2:"), F.substring(x, 3, 1 << 30))))

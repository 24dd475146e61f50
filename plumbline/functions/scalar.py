"""Column helpers shared by every operator: text form, safe casts, trimming, key compaction.

All of them are built-in Spark expressions, so they stay inside generated code. They dispatch on the
Spark ``DataType`` of the column, because the same check means different things on text, dates and numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Patterns whose results must equal the established ones. Java's "$" also matches before a final
# newline, so the end anchor is written "\z".
EMAIL_LOOSE = r"^[^@\s]+@[^@\s]+\z"
EMAIL_STRICT = r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"
EMAIL_RULE_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
NUMBER_TEXT = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\z"
PADDED_NUMBER_TEXT = r"(?i)^\s*+[+-]?(?:\d++(?:\.\d*+)?(?:e[+-]?\d++)?|\.\d++(?:e[+-]?\d++)?|nan|inf|infinity)\s*+\z"
DATE_TEXT = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?\z"
# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

COMPACT_TEXT_CHARS = 64

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INTEGRAL)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FRACTIONAL)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*_INTEGRAL, *_FRACTIONAL, T.DecimalType))


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, _DATES)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NESTED)


def quoted(name: str) -> str:
    """A column name as an identifier, so dots and blanks in it are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def col_of(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    """The column and its type; the name matches exactly first, then without regard to case."""
    fields = df.schema.fields
    field = next((f for f in fields if f.name == name), None)
    field = field or next((f for f in fields if f.name.casefold() == name.casefold()), None)
    if field is None:
        raise ValueError(f"Field '{name}' was not found in the source dataset.")
    return F.col(quoted(field.name)), field.dataType


def text_of(c: Column, dtype: T.DataType) -> Column:
    """The text form rules compare. Doubles print plainly from 1e-4 to 1e16, as ``10000000000.0``."""
    if is_text(dtype):
        return c
    if is_nested(dtype):
        return F.to_json(c)
    if is_fractional(dtype):
        return _double_text(c.cast("string").cast("double") if isinstance(dtype, T.FloatType) else c)
    return c.cast("string")


def _double_text(c: Column) -> Column:
    java = c.cast("string")
    size = F.abs(c)
    digits = F.when(size >= 1e7, c.cast("decimal(38,10)").cast("string")).otherwise(
        c.try_cast("decimal(38,20)").cast("string")
    )
    plain = F.regexp_replace(F.regexp_replace(digits, r"0+\z", ""), r"\.\z", ".0")
    exponent = F.regexp_extract(java, r"E(-?\d+)\z", 1).try_cast("int")
    scientific = F.concat(
        F.regexp_replace(F.regexp_extract(java, r"^([^E]+)E", 1), r"\.0\z", ""),
        F.lit("e"),
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    return (
        F.when(~java.contains("E"), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not only spaces."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Trim spaces; text that trims to nothing becomes NULL."""
    return F.nullif(F.trim(c), F.lit(""))


def safe_date(c: Column, dtype: T.DataType) -> Column:
    """A date or NULL, never an error. Text must be a four-digit-year ISO date, optionally with a time."""
    if isinstance(dtype, T.DateType):
        return c
    if is_date(dtype):
        return c.cast("date")
    if not is_text(dtype):
        return F.lit(None).cast("date")
    text = F.trim(c)
    iso = F.replace(F.regexp_extract(text, r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2})", 1), F.lit("/"), F.lit("-"))
    return F.when(_starts_like_date(c) & text.rlike(DATE_TEXT), iso).try_cast("date")


def safe_double(c: Column) -> Column:
    """A double or NULL for text; suffixes such as ``1d`` are not numbers."""
    return F.when(_starts_like_number(c) & c.rlike(PADDED_NUMBER_TEXT), c.try_cast("double"))


# Looking at the first character first keeps regular expressions away from most text.
def _starts_like_date(c: Column) -> Column:
    first = F.ascii(c)
    return first.between(48, 57) | (first == 32)


def _starts_like_number(c: Column) -> Column:
    first = F.ascii(c)
    return (first < 58) | first.isin(*(ord(letter) for letter in "iInN"))


def looks_like_email(c: Column, pattern: str) -> Column:
    return c.contains("@") & c.rlike(pattern)


def any_format_date(c: Column) -> Column:
    """A date from trimmed text in one of four layouts: ISO, compact, day/month/year, day-month-year."""
    text = strip(c)
    layouts = (
        (r"^\d{4}-\d{1,2}-\d{1,2}\z", "y-M-d"),
        (r"^\d{8}\z", "yyyyMMdd"),
        (r"^\d{1,2}/\d{1,2}/\d{4}\z", "d/M/y"),
        (r"^\d{1,2}-\d{1,2}-\d{4}\z", "d-M-y"),
    )
    return F.coalesce(
        *(F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout)).cast("date")) for shape, layout in layouts)
    )


def compact_key(c: Column, dtype: T.DataType) -> Column:
    """A grouping key of bounded width that is equal exactly when the values are equal.

    Text of up to 64 characters stands for itself; longer text becomes ``#`` plus its SHA-256, which is 65
    characters and so cannot collide with a short value. Shuffles then carry at most 65 characters per key
    however long the documents are. Other types group as themselves.
    """
    if is_nested(dtype):
        return compact_key(F.to_json(c), T.StringType())
    if isinstance(dtype, T.BinaryType):
        return compact_key(F.hex(c), T.StringType())
    if not is_text(dtype):
        return c
    return F.when(F.char_length(c) > COMPACT_TEXT_CHARS, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)


def normalised_key(c: Column, dtype: T.DataType) -> Column:
    """The reference-check key: text form, stripped, compacted. NULL stays NULL and empty text is a real key."""
    return compact_key(strip(text_of(c, dtype)), T.StringType())


def end_anchored(pattern: str) -> str:
    """Give a pattern's closing ``$`` the meaning "end of text"."""
    body = pattern[:-1]
    trailing = len(body) - len(body.rstrip("\\"))
    return body + r"\z" if pattern.endswith("$") and trailing % 2 == 0 else pattern

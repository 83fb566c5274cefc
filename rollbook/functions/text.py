"""Column expressions for text, numbers and dates (SF1-SF4, SF8, SF12, SF14, CL1-CL7).

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it stays
inside whole-stage codegen; nothing calls back into Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- SF2 / CL3
def utrim(c) -> Column:
    """Strip all Unicode whitespace at both ends (Spark's ``trim`` strips spaces only)."""
    return F.regexp_replace(as_col(c).cast("string"), r"(?U)^\s+|\s+$", "")


def clean_text(c) -> Column:
    """CL3: null stays null, otherwise the trimmed text."""
    return utrim(c)


def blank_to_null(c) -> Column:
    """The one boundary rule for missing text: null, blank and the text ``nan`` become NULL."""
    t = utrim(c)
    return F.when((t == "") | (F.lower(t) == "nan"), F.lit(None).cast("string")).otherwise(t)


# ---------------------------------------------------------------- CL2 / CL4
# A plain decimal or scientific number; anything else (``5d``, ``8,5``, ``NaN``, ``inf``) is missing.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def clean_number(c) -> Column:
    """CL2: null, blank or unparseable -> null, else the float of the trimmed text."""
    t = utrim(c)
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def numeric_or_null(c) -> Column:
    """CL4 coercion for columns that may already be numeric."""
    return clean_number(as_col(c).cast("string"))


def as_number(df, c) -> Column:
    """A score column as double: text is parsed with the guarded rule (CL2), numeric
    columns are only widened, so the fast path never round-trips through strings."""
    if isinstance(c, str) and c in df.columns and df.schema[c].dataType.simpleString() != "string":
        return F.col(c).cast("double")
    return numeric_or_null(c)


# ---------------------------------------------------------------- CL1 / CL5 / CL6 / CL7
ID_PATTERN = r"^[0-9]{10}$"


def is_valid_key(c, pattern: str = ID_PATTERN) -> Column:
    """CL1: key present and of the expected shape (null keys drop out of the filter)."""
    return F.coalesce(as_col(c).rlike(pattern), F.lit(False))


def id_text(c) -> Column:
    """CL5: id as text without a float tail (suffix form: ``10.05`` stays ``10.05``)."""
    return F.regexp_replace(utrim(as_col(c).cast("string")), r"\.0$", "")


def display_value(c) -> Column:
    """CL6: null/``nan`` -> blank, whole floats shown as integers, other values as text."""
    v = as_col(c)
    num = v.cast("double")
    whole = F.when(num.isNotNull() & (num == F.floor(num)) & ~F.isnan(num),
                   num.cast("bigint").cast("string"))
    txt = F.when(F.lower(v.cast("string")) == "nan", F.lit("")).otherwise(v.cast("string"))
    return F.coalesce(whole, txt, F.lit(""))


def full_name(first, last, null_safe: bool = True) -> Column:
    """CL7: family/middle name + given name.

    ``null_safe`` skips a missing part (``concat_ws``); otherwise a missing part makes the
    whole name missing, as SQL ``a || ' ' || b`` does.
    """
    if null_safe:
        return utrim(F.concat_ws(" ", as_col(first), as_col(last)))
    return F.concat(as_col(first), F.lit(" "), as_col(last))


# ---------------------------------------------------------------- SF1
# The date formats tried, in this order; the first that parses wins.
DATE_FORMATS = ("d/M/yyyy", "M/d/yyyy", "yyyy-M-d", "d-M-yyyy", "yyyy/M/d")


def _date_shape(fmt: str) -> str:
    """The digit shape a format can parse (1-2 digit day/month, 4-digit year)."""
    parts = []
    for ch in fmt:
        if ch in "dM":
            if not parts or parts[-1] != "[0-9]{1,2}":
                parts.append("[0-9]{1,2}")
        elif ch == "y":
            if not parts or parts[-1] != "[0-9]{4}":
                parts.append("[0-9]{4}")
        else:
            parts.append("\\" + ch if ch in "/-." else ch)
    return "^" + "".join(parts) + "$"


def parse_date(c, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """SF1: first format that fits, else null. Invalid dates (31/02) and 2-digit years fail.

    Each format is only tried on text of its digit shape: a failed parse is costly inside
    the JVM's date parser, and most values of a mixed column are not dates at all."""
    t = utrim(c)
    return F.coalesce(*[F.when(t.rlike(_date_shape(fmt)), F.try_to_date(t, fmt)) for fmt in formats])


# ---------------------------------------------------------------- SF3 / SF4
def is_id_shape(c, min_len: int = 6, max_len: int = 10) -> Column:
    """SF3: ASCII digits only, length in the id band."""
    return utrim(c).rlike(f"^[0-9]{{{min_len},{max_len}}}$")


def input_kind(c) -> Column:
    """SF4: classify a lookup input as ``mssv`` (id), ``date``, ``class`` or ``name``."""
    t = utrim(c)
    return (F.when(t.rlike("^[0-9]{6,10}$"), F.lit("mssv"))
            .when(t.rlike("[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"), F.lit("date"))
            .when(t.rlike("^[0-9]+[A-Za-z]+[0-9]*$") & (F.length(t) <= 15), F.lit("class"))
            .otherwise(F.lit("name")))


# ---------------------------------------------------------------- SF8
def query_words(query: str) -> list[str]:
    return query.strip().lower().split()


def word_overlap(target, query: str) -> Column:
    """SF8: share of query words found inside some target word.

    A query word holds no whitespace, so "inside some word of the target" is the same as
    "inside the target": the sum needs no split of the target and no array at all.
    """
    words = query_words(query)
    if not words:
        return F.lit(0.0)
    t = as_col(target)
    hits = sum((F.when(t.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    return hits.cast("double") / F.lit(float(len(words)))


# ---------------------------------------------------------------- SF12 / SF14
def percent_text(c, digits: int = 0) -> Column:
    """``NN%`` display of a 0-1 score (SK2)."""
    v = F.round(as_col(c) * 100, digits)
    txt = v.cast("bigint").cast("string") if digits == 0 else v.cast("string")
    return F.concat(txt, F.lit("%"))


def size_text(c) -> Column:
    """SF14: byte size as ``n B`` / ``x.y KB`` / ``x.y MB``."""
    b = as_col(c).cast("double")
    return (F.when(b < 1024, F.concat(b.cast("bigint").cast("string"), F.lit(" B")))
            .when(b < 1024 * 1024, F.concat(F.format_string("%.1f", b / 1024), F.lit(" KB")))
            .otherwise(F.concat(F.format_string("%.1f", b / (1024 * 1024)), F.lit(" MB"))))


def stamp_text(c) -> Column:
    """SF14: date-time stamp ``dd/MM/yyyy HH:mm``."""
    return F.date_format(as_col(c), "dd/MM/yyyy HH:mm")


def cohort(c, n: int = 2) -> Column:
    """SF12: the first ``n`` characters of a class name (the intake year)."""
    return F.substring(as_col(c), 1, n)

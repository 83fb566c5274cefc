"""Canonical schemas, the header-role resolver (CS1), score-column detection (CS2),
first-non-blank coalescing (CS4) and the import normaliser (CS5).

The resolver only looks at ``df.columns`` (metadata, on the driver); it never reads data.
Headers are matched by whole tokens after accent folding, so ``Mã sinh viên``,
``ma_sinh_vien`` and ``MSSV`` all resolve to the id role while ``Middle name`` does not.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.text import blank_to_null, clean_number, numeric_or_null, utrim

# The canonical names of the 26 positional columns of the wide grade file.
WIDE_COLUMNS = (
    "stt", "ma_sinh_vien", "ho_dem", "ten", "gioi_tinh", "ngay_sinh", "lop",
    "so_mh_dang_ky", "so_tc_dang_ky", "so_mh_dat",
    "diem_10", "diem_4", "diem_chu", "xep_loai_hoc_luc", "diem_ren_luyen", "xep_loai_ren_luyen",
    "diem_10_tich_luy", "diem_4_tich_luy", "diem_chu_tich_luy", "xep_loai_tich_luy", "xep_hang",
    "nam_thu", "so_tc_tich_luy", "diem_ren_luyen_tich_luy", "xep_loai_ren_luyen_tich_luy", "ghi_chu",
)
INT_COLUMNS = {"stt", "so_mh_dang_ky", "so_tc_dang_ky", "so_mh_dat", "diem_ren_luyen", "nam_thu",
               "so_tc_tich_luy", "diem_ren_luyen_tich_luy"}
DOUBLE_COLUMNS = {"diem_10", "diem_4", "diem_10_tich_luy", "diem_4_tich_luy"}

# Every column is read as text (ids keep their leading zeros); typing happens in ``type_wide``.
WIDE_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in WIDE_COLUMNS])

STUDENT_COLUMNS = ("ma_sinh_vien", "stt", "ho_dem", "ten", "gioi_tinh", "ngay_sinh", "lop",
                   "so_mh_dang_ky", "so_tc_dang_ky", "so_mh_dat")
SEMESTER_COLUMNS = ("ma_sinh_vien", "diem_10", "diem_4", "diem_chu", "xep_loai_hoc_luc",
                    "diem_ren_luyen", "xep_loai_ren_luyen")
CUMULATIVE_COLUMNS = ("ma_sinh_vien", "diem_10_tich_luy", "diem_4_tich_luy", "diem_chu_tich_luy",
                      "xep_loai_tich_luy", "xep_hang", "nam_thu", "so_tc_tich_luy",
                      "diem_ren_luyen_tich_luy", "xep_loai_ren_luyen_tich_luy", "ghi_chu")


def type_wide(df: DataFrame) -> DataFrame:
    """Wide grade rows from text to their types: CL2 for numbers (whole floats arrive as
    ``8.0``, so integers go through double), CL3 for text, SF1 for the birth date."""
    from rollbook.functions.text import parse_date
    cols = []
    for c in WIDE_COLUMNS:
        if c not in df.columns:
            continue
        if c in INT_COLUMNS:
            cols.append(clean_number(c).cast("bigint").alias(c))
        elif c in DOUBLE_COLUMNS:
            cols.append(clean_number(c).alias(c))
        elif c == "ngay_sinh":
            cols.append(parse_date(c).alias(c))
        else:
            cols.append(utrim(c).alias(c))
    return df.select(*cols)


# ---------------------------------------------------------------- CS1
# Header keywords per role, in the order roles are tried (first role wins).
ROLE_KEYWORDS = (
    ("mssv", ("mssv", "id", "ma_sv", "student_id", "ma_sinh_vien")),
    ("ho_dem", ("ho_dem",)),
    ("ten", None),  # exact header "ten"
    ("full_name", ("ho_va_ten", "fullname", "full_name", "ho_ten", "name")),
    ("class", ("lop", "class")),
    ("birth_date", ("ngay_sinh", "birth_date", "dob")),
    ("score", ("diem", "score", "point")),
    ("rank", ("xep_loai", "rank", "grade")),
    ("email", ("email",)),
    ("phone", ("so_dien_thoai", "phone")),
    ("note", ("ghi_chu", "note")),
)


def fold(text: str) -> str:
    """Lower case, accents removed (``đ`` -> ``d``), runs of non-alphanumerics -> ``_``."""
    s = unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D"))
    s = "".join(ch for ch in s if unicodedata.category(ch) != "Mn").lower()
    out, prev_sep = [], True
    for ch in s:
        if ch.isalnum():
            out.append(ch)
            prev_sep = False
        elif not prev_sep:
            out.append("_")
            prev_sep = True
    return "".join(out).strip("_")


def _has_tokens(header_tokens: list[str], kw: str) -> bool:
    k = kw.split("_")
    n = len(k)
    return any(header_tokens[i:i + n] == k for i in range(len(header_tokens) - n + 1))


def header_role(header: str) -> str | None:
    f = fold(header)
    toks = f.split("_") if f else []
    for role, kws in ROLE_KEYWORDS:
        if kws is None:
            if f == role:
                return role
        elif any(_has_tokens(toks, kw) for kw in kws):
            return role
    return None


def resolve_roles(columns: Sequence[str]) -> dict[str, list[int]]:
    """CS1: role -> positions of the columns playing it, in header order."""
    roles: dict[str, list[int]] = {}
    for i, c in enumerate(columns):
        r = header_role(c)
        if r:
            roles.setdefault(r, []).append(i)
    return roles


def canonical_projection(df: DataFrame, roles: Sequence[str] = ("mssv", "full_name", "class", "score"),
                         last: bool = False) -> DataFrame:
    """Select one column per role (first, or last when headers repeat) as the role name."""
    found = resolve_roles(df.columns)
    positional = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    out = []
    for r in roles:
        if r in found:
            i = found[r][-1] if last else found[r][0]
            out.append(F.col(f"_c{i}").alias(r))
    return positional.select(*out)


# ---------------------------------------------------------------- CS2
def score_column_counts(df: DataFrame) -> DataFrame:
    """CS2: for every score-role column, how many values parse as numbers; one aggregate
    for all candidates. The first candidate with a count above zero is the score column."""
    found = resolve_roles(df.columns).get("score", [])
    positional = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    if not found:
        return positional.limit(0).select(F.lit(None).cast("string").alias("column"))
    counts = positional.agg(*[F.count(numeric_or_null(f"_c{i}")).alias(f"n{i}") for i in found])
    stack = ", ".join(f"'{df.columns[i].replace(chr(39), chr(39) * 2)}', {k}, n{i}" for k, i in enumerate(found))
    return counts.select(F.expr(f"stack({len(found)}, {stack}) as (column, position, n_numeric)"))


# ---------------------------------------------------------------- CS4
def first_non_blank(*cols) -> Column:
    """CS4: the first alternative that is present and not blank (trimmed)."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


# ---------------------------------------------------------------- CS5
REASON_NO_ID = "missing id"
REASON_NO_NAME = "missing name"


def normalise_import(df: DataFrame) -> DataFrame:
    """CS5: id, name (full name, or family + given name, or either), class, score (number or
    NULL), email, phone, plus ``reject_reason`` (missing id or name); other columns are kept
    as trimmed text."""
    found = resolve_roles(df.columns)
    positional = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])

    def pick(role):
        return [F.col(f"_c{i}") for i in found.get(role, [])]

    id_ = first_non_blank(*pick("mssv")) if "mssv" in found else F.lit(None).cast("string")
    parts = [F.concat_ws(" ", *[blank_to_null(c) for c in (pick("ho_dem")[:1] + pick("ten")[:1])])]
    name = first_non_blank(*pick("full_name"), *parts)
    klass = first_non_blank(*pick("class")) if "class" in found else F.lit(None).cast("string")
    score = F.coalesce(*[clean_number(c) for c in pick("score")], F.lit(None).cast("double"))
    email = first_non_blank(*pick("email")) if "email" in found else F.lit(None).cast("string")
    phone = first_non_blank(*pick("phone")) if "phone" in found else F.lit(None).cast("string")
    used = {i for r in ("mssv", "ho_dem", "ten", "full_name", "class", "score", "email", "phone")
            for i in found.get(r, [])}
    extra = [utrim(F.col(f"_c{i}")).alias(fold(df.columns[i]) or f"column_{i + 1}")
             for i in range(len(df.columns)) if i not in used]
    reason = F.when(id_.isNull(), F.lit(REASON_NO_ID)).when(name.isNull(), F.lit(REASON_NO_NAME))
    return positional.select(id_.alias("mssv"), name.alias("ho_ten"), klass.alias("lop"),
                             score.alias("diem"), email.alias("email"), phone.alias("so_dien_thoai"),
                             *extra, reason.alias("reject_reason"))

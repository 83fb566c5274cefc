"""Named views and reports over the canonical grade-book schema (JN1, JN2, VW1-VW7, PF7, TK3).

Canonical frames (see FIXTURES.md):
  students    (ma_sinh_vien, ho_dem, ten, lop, ...)
  semester    (ma_sinh_vien, diem_10, ...)
  cumulative  (ma_sinh_vien, diem_4_tich_luy, ghi_chu, so_tc_tich_luy, nam_thu, ...)
The star join expects score tables keyed by student (one current row each, as the upsert
SO4 leaves them; ``keyed`` below does it for raw tables). On unkeyed tables a student with
m semester and n cumulative rows would come out m*n times, which for a hot key is an
all-pairs blow-up; keying first keeps the view 1:1:1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions import labels as L
from rollbook.functions.text import full_name

KEY = "ma_sinh_vien"
GPA = "diem_4_tich_luy"


def keyed(scores: DataFrame, order: str) -> DataFrame:
    """One current row per student: the highest ``order`` (an aggregate, combined map-side)."""
    from rollbook.operators.ranking import first_by_key
    return first_by_key(scores, [KEY], [(order, False)]).select(*scores.columns)


def student_summary(students: DataFrame, semester: DataFrame, cumulative: DataFrame,
                    warning_pattern: str = f"%{L.STATUS_WARNING}%",
                    withdrawn_pattern: str = f"%{L.STATUS_WITHDRAWN}%") -> DataFrame:
    """VW1 / JN2: students LEFT JOIN semester LEFT JOIN cumulative on the student key, with
    the null-propagating full name (CL7), GPA label (SF10) and study status (SF11)."""
    s = students.alias("s")
    sem = semester.alias("sem")
    cum = cumulative.alias("cum")
    j = (s.join(sem, F.col(f"s.{KEY}") == F.col(f"sem.{KEY}"), "left")
         .join(cum, F.col(f"s.{KEY}") == F.col(f"cum.{KEY}"), "left"))
    sem_cols = [F.col(f"sem.{c}") for c in semester.columns if c != KEY]
    cum_cols = [F.col(f"cum.{c}") for c in cumulative.columns if c != KEY]
    stu_cols = [F.col(f"s.{c}") for c in students.columns if c not in ("ho_dem", "ten")]
    return j.select(
        *stu_cols,
        full_name(F.col("s.ho_dem"), F.col("s.ten"), null_safe=False).alias("ho_ten_day_du"),
        *sem_cols, *cum_cols,
        L.gpa_label(F.col(f"cum.{GPA}")).alias("phan_loai_hoc_luc"),
        L.status_label(F.col("cum.ghi_chu"), warning_pattern, withdrawn_pattern).alias("tinh_trang_hoc_tap"),
    )


def class_pattern_high_gpa(students: DataFrame, cumulative: DataFrame, pattern: str,
                           min_gpa: float = L.HONOURS_GPA, extra: tuple[str, ...] = ()) -> DataFrame:
    """JN1 (+PF1, TK10, AG17): inner join, class LIKE pattern (case-insensitive, as SQLite's
    LIKE), GPA >= threshold, DISTINCT rows, best GPA first then key."""
    s, c = students.alias("s"), cumulative.alias("c")
    return (s.join(c, KEY, "inner")
            .where(F.col("s.lop").ilike(pattern) & (F.col(f"c.{GPA}") >= min_gpa) & F.col(f"c.{GPA}").isNotNull())
            .select(KEY, "s.ho_dem", "s.ten", "s.lop", F.col(f"c.{GPA}").alias("diem_trung_binh"),
                    "c.so_tc_tich_luy", "c.ghi_chu", *extra)
            .distinct()
            .orderBy(F.desc("diem_trung_binh"), F.asc(KEY)))


def high_gpa_view(summary: DataFrame, pattern: str, min_gpa: float = L.HONOURS_GPA) -> DataFrame:
    """VW2: summary rows of a class pattern with GPA >= threshold, best first."""
    return (summary.where(F.col("lop").ilike(pattern) & (F.col(GPA) >= min_gpa))
            .orderBy(F.desc(GPA), F.asc(KEY)))


def at_risk(summary: DataFrame, status: str = L.STATUS_WARNING) -> DataFrame:
    """PF7 / VW7: students whose status is the warning label, by class then name."""
    return (summary.where(F.col("tinh_trang_hoc_tap") == status)
            .select(KEY, "ho_ten_day_du", "lop", GPA, "ghi_chu")
            .orderBy(F.asc_nulls_first("lop"), F.asc_nulls_first("ho_ten_day_du")))


def top_gpa(summary: DataFrame, k: int = 10, tiebreak: tuple[str, ...] = (KEY,)) -> DataFrame:
    """TK3: k best GPAs, missing GPAs excluded, unique tie-break."""
    return (summary.where(F.col(GPA).isNotNull())
            .orderBy(F.desc(GPA), *[F.asc(c) for c in tiebreak]).limit(k))


def transcript(summary: DataFrame, student_id) -> DataFrame:
    """VW6: every summary row of one student (a key filter pushed to the scans)."""
    return summary.where(F.col(KEY) == F.lit(student_id))

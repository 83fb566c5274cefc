"""Rule-based labels (SF10, SF11) and score bands (AG4, AG11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.text import as_col

# GPA (0-4 scale) label ladder, highest first; anything below the last
# threshold, and a missing GPA, gets the final label.
GPA_LADDER = (
    (3.60, "Xuất sắc"),
    (3.20, "Giỏi"),
    (2.50, "Khá"),
    (2.00, "Trung bình"),
    (1.00, "Yếu"),
)
GPA_LOWEST = "Kém"

# Study-status labels found in the free-text note, checked in this order.
STATUS_WARNING = "Cảnh báo"
STATUS_WITHDRAWN = "Thôi học"
STATUS_NORMAL = "Bình thường"

# 10-point score histogram edges and labels (AG4).
SCORE_EDGES = (0.0, 2.0, 4.0, 5.0, 6.5, 8.0, 10.0)
SCORE_LABELS = ("Kém (<2)", "Yếu (2-4)", "TB- (4-5)", "TB (5-6.5)", "Khá (6.5-8)", "Giỏi (8-10)")

# Class-statistics bands on the GPA scale (AG11).
BAND_EXCELLENT = 3.6
BAND_GOOD = 3.2
BAND_FAIR = 2.5
BAND_AVERAGE = 2.0

PASS_MARK = 5.0
EXCELLENT_MARK = 8.0
HONOURS_GPA = 3.4


def gpa_label(gpa, ladder: Sequence[tuple[float, str]] = GPA_LADDER,
              lowest: str = GPA_LOWEST) -> Column:
    """SF10: CASE ladder; a NULL GPA fails every test and falls to ``lowest``."""
    g = as_col(gpa)
    expr = None
    for threshold, label in ladder:
        expr = (F.when(g >= threshold, F.lit(label)) if expr is None
                else expr.when(g >= threshold, F.lit(label)))
    return expr.otherwise(F.lit(lowest))


def status_label(note, warning_pattern: str = f"%{STATUS_WARNING}%",
                 withdrawn_pattern: str = f"%{STATUS_WITHDRAWN}%",
                 labels: tuple[str, str, str] = (STATUS_WARNING, STATUS_WITHDRAWN, STATUS_NORMAL)) -> Column:
    """SF11: note contains the warning text, else the withdrawn text, else normal.

    Case-insensitive like the original SQL ``LIKE``; a NULL note is normal.
    """
    n = as_col(note)
    return (F.when(n.ilike(warning_pattern), F.lit(labels[0]))
            .when(n.ilike(withdrawn_pattern), F.lit(labels[1]))
            .otherwise(F.lit(labels[2])))


def histogram_bin(score, edges: Sequence[float] = SCORE_EDGES) -> Column:
    """AG4: bin index 0..k-1, left-closed bins with the last one also right-closed.

    Out-of-range values get NULL (they stay in the denominator, not in any bin); this is
    the numpy ``histogram`` rule.
    """
    s = as_col(score)
    k = len(edges) - 1
    expr = None
    for i in range(k):
        lo, hi = edges[i], edges[i + 1]
        cond = (s >= lo) & ((s <= hi) if i == k - 1 else (s < hi))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr

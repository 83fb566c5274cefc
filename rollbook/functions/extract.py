"""Line predicates and find-all patterns for pulling ids, names, classes and dates out
of free text (SF5, SF6, SF7, SF9).

All of it is regular expressions over ``(?U)`` (Unicode character classes, so ``\\b``,
``\\d`` and ``\\s`` mean the same thing on every JDK) and higher-order array functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.text import as_col

# The Vietnamese letters with diacritics, lower case.
VI_LOWER = "àáâãèéêìíòóôõùúăđĩũơưăạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵýỷỹ"
VI_UPPER = VI_LOWER.upper()
# The four letters treated as "common Vietnamese" in the name test.
VI_COMMON = "ăôưđ"

# Words that mark a line as technical rather than a person's name.
TECH_WORDS = ("file", "data", "csv", "excel", "document", "text", "import", "export", "column", "row")
TECH_WORDS_SHORT = ("file", "data", "csv", "excel", "document", "text")

# A capitalised word and a run of two or more of them (the name pattern inside a line).
_UP = f"A-Z{VI_UPPER}"
_LO = f"a-z{VI_LOWER}"
NAME_RUN = rf"(?U)\b([{_UP}][{_LO}]+(?:\s+[{_UP}][{_LO}]+)+)\b"
ID_RUN = r"(?U)\b(\d{6,10})\b"
CLASS_RUN = r"(?iU)\b(\d{1,2}[A-Z]{1,4}\d{0,2})\b"
DATE_RUN = r"(?U)\b(\d{1,2}[/-]\d{1,2}[/-]\d{4})\b"

# Whole-line class shapes (any case), e.g. 14TCLC3, CNTT1, "Lớp 14TCLC3", 14Tin1.
CLASS_LINE_PATTERNS = (
    r"^\d{1,2}[A-Z]{1,4}\d{0,2}$",
    r"^[A-Z]{1,4}\d{1,3}$",
    r"^Lớp\s+\d{1,2}[A-Z]{1,4}\d{0,2}$",
    r"^\d{1,2}[A-Z][a-z]*\d{0,2}$",
)
# Date shapes found anywhere in a line.
DATE_LINE_PATTERNS = (
    r"\d{1,2}/\d{1,2}/\d{4}",
    r"\d{1,2}-\d{1,2}-\d{4}",
    r"\d{4}/\d{1,2}/\d{1,2}",
    r"\d{4}-\d{1,2}-\d{1,2}",
)


def words(line) -> Column:
    """Python ``str.split()``: runs of Unicode whitespace, no empty words."""
    return F.filter(F.split(as_col(line), r"(?U)\s+"), lambda w: w != "")


def has_digit(line) -> Column:
    return as_col(line).rlike(r"(?U)\d")


def _proper_case_word(w: Column) -> Column:
    # first character upper case, the rest (if any) lower case with at least one letter
    return w.rlike(r"(?U)^\p{Lu}$") | w.rlike(r"(?U)^\p{Lu}[^\p{Lu}\p{Lt}]*\p{Ll}[^\p{Lu}\p{Lt}]*$")


def _upper_word(w: Column) -> Column:
    return w.rlike(r"(?U)^[^\p{Ll}]*[\p{Lu}\p{Lt}][^\p{Ll}]*$")


def is_name_line(line, max_len: int = 50, tech_words=TECH_WORDS) -> Column:
    """SF5: 2-5 words, no digit, length 5..max_len, looks like a person's name, no technical word."""
    ln = as_col(line)
    ws = words(ln)
    # cheapest tests first: And short-circuits, so long lines never reach the split
    shape = ((F.length(ln) >= 5) & (F.length(ln) <= max_len) & ~has_digit(ln)
             & (F.size(ws) >= 2) & (F.size(ws) <= 5))
    lower = F.lower(ln)
    vi_chars = lower.rlike(f"[{VI_LOWER}]")
    proper = F.forall(ws, _proper_case_word)
    caps = F.forall(ws, _upper_word)
    common = lower.rlike(f"[{VI_COMMON}]")
    tech = F.exists(ws, lambda w: F.lower(w).isin(*tech_words))
    return shape & (vi_chars | proper | caps | common) & ~tech


def is_compare_name_line(line) -> Column:
    """SF7 name rule: 2-5 words, no digit, length 5..40, no technical word.

    The original also asks for a "Vietnamese-looking" line, but its character test
    includes the space, which every line of two or more words holds, so it always passes.
    """
    ln = as_col(line)
    ws = words(ln)
    return ((F.length(ln) >= 5) & (F.length(ln) <= 40) & ~has_digit(ln)
            & (F.size(ws) >= 2) & (F.size(ws) <= 5)
            & ~F.exists(ws, lambda w: F.lower(w).isin(*TECH_WORDS_SHORT)))


def is_class_line(line) -> Column:
    ln = as_col(line)
    cond = F.lit(False)
    for p in CLASS_LINE_PATTERNS:
        cond = cond | ln.rlike("(?iU)" + p)
    return has_digit(ln) & cond  # every shape has one


def is_date_line(line) -> Column:
    ln = as_col(line)
    cond = F.lit(False)
    for p in DATE_LINE_PATTERNS:
        cond = cond | ln.rlike("(?U)" + p)
    return has_digit(ln) & cond  # every shape has one


def is_pure_id(line) -> Column:
    """SF6 pure-id rule: all digits and 6, 7, or 8/10 digits starting with ``20``."""
    ln = as_col(line)
    n = F.length(ln)
    return (ln.rlike(r"^[0-9]{6,10}$")
            & (((n == 8) & ln.startswith("20")) | ((n == 10) & ln.startswith("20"))
               | (n == 7) | (n == 6)))


def is_compare_id(line) -> Column:
    """SF7 pure-id rule: all digits, 6..10 long (the extra prefix tests are implied)."""
    return as_col(line).rlike(r"^[0-9]{6,10}$")


def find_ids(line) -> Column:
    return F.regexp_extract_all(as_col(line), F.lit(ID_RUN), 1)


def find_names(line, max_len: int = 50, min_word: int = 1) -> Column:
    """Capitalised runs of 2-5 words and 5..max_len characters; each word at least ``min_word`` long."""
    runs = F.regexp_extract_all(as_col(line), F.lit(NAME_RUN), 1)

    def ok(m):
        ws = F.split(m, r"(?U)\s+")
        cond = (F.size(ws) >= 2) & (F.size(ws) <= 5) & (F.length(m) >= 5) & (F.length(m) <= max_len)
        if min_word > 1:
            cond = cond & F.forall(ws, lambda w: F.length(w) >= min_word)
        return cond

    return F.filter(runs, ok)


def find_classes(line) -> Column:
    return F.regexp_extract_all(as_col(line), F.lit(CLASS_RUN), 1)


def find_dates(line) -> Column:
    return F.regexp_extract_all(as_col(line), F.lit(DATE_RUN), 1)

"""Column expressions for text fields.

All are native Spark expressions (codegen or higher-order functions), no
Python per row. Whitespace follows Python's ``str.split()`` / ``strip()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

#: White space as Python's ``str.split`` sees it: Unicode's, and U+001C to U+001F.
SPACE = r"[\s\x1C-\x1F]"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: ColumnOrName) -> Column:
    """Leading and trailing whitespace removed (like ``str.strip()``)."""
    return F.regexp_replace(_c(c), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def words(c: ColumnOrName) -> Column:
    """Whitespace tokens, empty pieces dropped (like ``str.split()``)."""
    return F.array_remove(F.split(_c(c), rf"(?U){SPACE}+"), "")


def word_count(c: ColumnOrName) -> Column:
    """Number of whitespace tokens; null counts 0. Runs are counted, not cut out."""
    return F.regexp_count(F.coalesce(_c(c), F.lit("")), F.lit(r"(?U)[^\s\x1C-\x1F]+"))


def char_length(c: ColumnOrName) -> Column:
    """Length in characters."""
    return F.char_length(_c(c))


def fits_within(c: ColumnOrName, n: int) -> Column:
    """Length <= n."""
    return F.char_length(_c(c)) <= F.lit(n)


def truncate_words(c: ColumnOrName, n: int = 200, default: str = "Unknown") -> Column:
    """P5: first n tokens joined by one blank; null or empty input gives ``default``."""
    col = _c(c)
    return (F.when(col.isNull() | (col == ""), F.lit(default))
            .otherwise(F.array_join(F.slice(words(col), 1, n), " ")))


def truncate_chars(c: ColumnOrName, n: int, ellipsis: bool = True) -> Column:
    """First n characters; ``...`` appended only when the text was longer."""
    col = _c(c)
    cut = F.substring(col, 1, n)
    if ellipsis:
        cut = F.concat(cut, F.lit("..."))
    return F.when(F.char_length(col) > n, cut).otherwise(col)


def pair_text(question: ColumnOrName, answer: ColumnOrName, max_answer: int = 1500) -> Column:
    """``QUESTION: q ANSWER: a`` with the answer cut to ``max_answer`` characters."""
    return F.concat(F.lit("QUESTION: "), _c(question), F.lit(" ANSWER: "),
                    truncate_chars(answer, max_answer, ellipsis=False))


def _present(c: Column | None) -> Column:
    if c is None:
        return F.lit(False)
    return c.isNotNull() & (c.cast("string") != "")


def feature_prefix(answer: ColumnOrName, tone: ColumnOrName | None = None,
                   length: ColumnOrName | None = None) -> Column:
    """``Tone: t | Length: l | Answer: `` in front of the answer; absent or
    empty features are left out and no feature means no prefix."""
    t = _c(tone) if tone is not None else None
    ln = _c(length) if length is not None else None
    parts = []
    if t is not None:
        parts.append(F.when(_present(t), F.concat(F.lit("Tone: "), t.cast("string"))))
    if ln is not None:
        parts.append(F.when(_present(ln), F.concat(F.lit("Length: "), ln.cast("string"))))
    ans = F.coalesce(_c(answer).cast("string"), F.lit("None"))
    if not parts:
        return ans
    joined = F.concat_ws(" | ", *parts)
    return F.when(joined != "", F.concat(joined, F.lit(" | Answer: "), ans)).otherwise(ans)


def tone_tag(answer: ColumnOrName, tone: ColumnOrName) -> Column:
    """``[TONE OF RESPONSE: t]`` line in front of the answer."""
    return F.concat(F.lit("[TONE OF RESPONSE: "), _c(tone), F.lit("]\n"), _c(answer))


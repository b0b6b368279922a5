"""Column expressions with the rounding, trimming and number rules of the score tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a browser's trim() strips (Unicode white space, line ends, BOM).
WHITESPACE = (
    "\t\n\u000b\u000c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

SMALLINT_MIN, SMALLINT_MAX = -32768, 32767


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_avg(total: str | Column, n: str | Column, places: int) -> Column:
    """``total / n`` of two integers, rounded half away from zero; NULL when n is 0."""
    total, n = col(total), col(n)
    exact = total.cast("decimal(20,0)") / F.nullif(n, F.lit(0)).cast("decimal(20,0)")
    return F.round(exact, places).cast("double")


def trimmed(text: str | Column) -> Column:
    """Strip every kind of Unicode white space, not only blanks."""
    return F.btrim(col(text), F.lit(WHITESPACE))


def blank_to_null(text: str | Column) -> Column:
    return F.nullif(trimmed(text), F.lit(""))


def iso_date(date: str | Column) -> Column:
    return F.date_format(col(date), "yyyy-MM-dd")


def as_number(text: str | Column) -> Column:
    """Trimmed text to DOUBLE the way a browser converts it: blank is 0, garbage is NaN."""
    t = col(text)
    digits = F.substring(t, 3, 400)
    return (
        F.when(t.rlike(r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|Infinity)\z"), t.try_cast("double"))
        .when(t == "", F.lit(0.0))
        .when(t.rlike(r"^0[xX][0-9a-fA-F]+\z"), F.conv(digits, 16, 10).try_cast("double"))
        .when(t.rlike(r"^0[oO][0-7]+\z"), F.conv(digits, 8, 10).try_cast("double"))
        .when(t.rlike(r"^0[bB][01]+\z"), F.conv(digits, 2, 10).try_cast("double"))
        .when(t.isNotNull(), F.lit(float("nan")))
    )


def number_to_smallint(number: str | Column) -> Column:
    """DOUBLE to SMALLINT; NULL for fractions, NaN and values out of range."""
    number = col(number)
    short = number.try_cast("smallint")
    return F.when(short == number, short)


def with_smallints(rows: DataFrame, texts: Mapping[str, str]) -> DataFrame:
    """Add SMALLINT columns {new column: text column} by browser rules; the empty text is missing.

    Trimming, parsing and narrowing are separate steps, so that each is
    evaluated once per row instead of being inlined wherever it is used.
    """
    stripped = rows.withColumns({f"_t_{new}": F.when(F.col(text) != "", trimmed(text)) for new, text in texts.items()})
    parsed = stripped.withColumns({f"_d_{new}": as_number(f"_t_{new}") for new in texts})
    narrow = parsed.withColumns({new: number_to_smallint(f"_d_{new}") for new in texts})
    return narrow.drop(*[f"_{step}_{new}" for new in texts for step in "td"])


def text_to_smallint(text: str | Column) -> Column:
    """Strict integer text to SMALLINT; NULL for ``20.5``, the empty text and overflow."""
    text = col(text)
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*\z"), F.btrim(text, F.lit(" \t\n\u000b\u000c\r")).try_cast("smallint"))


#: SMALLINTs in a word of ``with_words``; each takes 17 bits, the highest for NULL.
PER_WORD = 3


def with_words(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """SMALLINT columns as BIGINT words ``_w0``, ``_w1``, ... for a shuffle, where each column of a row takes eight bytes."""
    null = F.lit(65536).cast("bigint")
    words = {}
    for n, start in enumerate(range(0, len(columns), PER_WORD)):
        word = F.lit(0).cast("bigint")
        for k, c in enumerate(columns[start : start + PER_WORD]):
            word = word.bitwiseOR(F.shiftleft(F.coalesce(F.col(c).cast("bigint") - SMALLINT_MIN, null), 17 * k))
        words[f"_w{n}"] = word
    return rows.withColumns(words).drop(*columns)


def without_words(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The SMALLINT columns that ``with_words`` was given."""
    found = {}
    for n, c in enumerate(columns):
        value = F.shiftright(F.col(f"_w{n // PER_WORD}"), 17 * (n % PER_WORD)).bitwiseAND(F.lit((1 << 17) - 1).cast("bigint"))
        found[c] = F.when(value < 65536, (value + SMALLINT_MIN).cast("smallint"))
    return rows.withColumns(found).drop(*[f"_w{n}" for n in range(-(-len(columns) // PER_WORD))])


def spread_null_id(key: str | Column, *by: str | Column) -> Column:
    """A nullable id as a join key: NULLs become scattered ids no row can have.

    Ids are never negative, so a left join keeps its result, while the rows
    without an id no longer meet in one shuffle partition.
    """
    return F.coalesce(col(key).cast("bigint"), -1 - F.pmod(F.xxhash64(*map(col, by)), F.lit(1 << 20)))


def spread_null_name(key: str | Column, *by: str | Column) -> Column:
    """The same for a nullable name; stored names never hold a NUL character."""
    filler = F.pmod(F.xxhash64(*map(col, by)), F.lit(1 << 20)).cast("string")
    return F.coalesce(col(key), F.concat(F.lit("\u0000"), filler))

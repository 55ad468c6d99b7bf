"""Numeric and boolean expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .. import contracts as K
from .text import normalize_missing, strip

NUMBER_CHUNK = r"([-+]?\d*\.?\d+)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c) -> Column:
    """NaN / ±Inf -> null (Spark treats NaN as a value; keep it out)."""
    x = _c(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def to_double(c, dtype=None) -> Column:
    """D1 safe_to_numeric: remove spaces, ',' -> '.', bad -> null.  Numeric
    inputs are cast directly (no string round trip)."""
    if dtype is not None and isinstance(dtype, NumericType):
        return finite_or_null(_c(c).cast("double"))
    return finite_or_null(text_number(c))


def text_number(c) -> Column:
    """The parse of D1 alone, infinities and NaN included.  ``to_double`` refers to it three
    times; in a projection of its own it runs once a row."""
    return F.regexp_replace(F.regexp_replace(_c(c).cast("string"), r"\s", ""), ",", ".").try_cast("double")


def first_number(c) -> Column:
    """The parse of D2 alone: the first numeric chunk of a text (no chunk: '', which is no number)."""
    raw = F.regexp_replace(F.regexp_replace(_c(c), " ", ""), ",", ".")
    return F.regexp_extract(raw, NUMBER_CHUNK, 1).try_cast("double")


def to_numeric_flexible(c, dtype=None, prenormalized: bool = False, parsed: Column | None = None) -> Column:
    """Missing tokens -> null; boolean tokens -> 1/0 (precedence); else
    the first numeric chunk of the text.  ``prenormalized``: the input already
    went through ``normalize_missing``; ``parsed``: its ``first_number`` is known
    (both let a plan stage them in projections of their own, where they run once a row)."""
    if dtype is not None and isinstance(dtype, NumericType):
        return finite_or_null(_c(c).cast("double"))
    x = _c(c) if prenormalized else normalize_missing(c)
    xl = F.lower(x)
    parsed = first_number(x) if parsed is None else parsed
    return (F.when(xl.isin(*K.TRUE_TOKENS), F.lit(1.0))
             .when(xl.isin(*K.FALSE_TOKENS), F.lit(0.0))
             .otherwise(finite_or_null(parsed)))


def to_int_count(c, dtype=None, allow_negative: bool = False, prenormalized: bool = False) -> Column:
    """D3: D2, floor, negative -> null, long."""
    v = F.floor(to_numeric_flexible(c, dtype, prenormalized))
    if not allow_negative:
        v = F.when(v >= 0, v)
    return v.cast("long")


def to_bool(c) -> Column:
    """D4 safe_to_bool: 7 true / 7 false tokens, numeric 1 / 0, else null."""
    # tokens first: '1' / '0' are both tokens and numbers and agree, so the
    # (costly) numeric parse only runs for the remaining values
    x = F.lower(strip(c))
    num = strip(c).try_cast("double")
    return (F.when(x.isin(*K.TRUE_TOKENS), F.lit(True))
             .when(x.isin(*K.FALSE_TOKENS), F.lit(False))
             .when(num == 1, F.lit(True))
             .when(num == 0, F.lit(False))
             .otherwise(F.lit(None).cast("boolean")))


def flag01(c) -> Column:
    """Boolean -> nullable 0/1 int."""
    return to_bool(c).cast("int")


def null_outside(c, lo=None, hi=None) -> Column:
    """Keep the value only inside [lo, hi] (null stays null)."""
    x = _c(c)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (x >= lo)
    if hi is not None:
        cond = cond & (x <= hi)
    return F.when(cond, x)


def floor_at_zero(c) -> Column:
    """Negative -> 0, null preserved."""
    x = _c(c)
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def safe_ratio(a, b) -> Column:
    """A / b with b == 0 -> null."""
    return _c(a) / F.when(_c(b) != 0, _c(b))


def weighted_score(parts: list[tuple[Column, float]]) -> Column:
    """Σ coalesce(c,0)·w, clipped at 0."""
    if not parts:
        return F.lit(None).cast("double")
    total = None
    for col, w in parts:
        term = F.coalesce(col.cast("double"), F.lit(0.0)) * F.lit(float(w))
        total = term if total is None else total + term
    return F.greatest(total, F.lit(0.0))


def flag_count(cols: list[Column]) -> Column:
    """Σ coalesce(flag, 0) as int."""
    if not cols:
        return F.lit(0)
    total = None
    for col in cols:
        term = F.coalesce(col.cast("int"), F.lit(0))
        total = term if total is None else total + term
    return total


def fixed_band(c, edges: list[tuple], low=None) -> Column:
    """Right-closed fixed-edge banding; ``edges`` is [(upper, label)],
    the last upper may be None (= +inf).  ``low`` is an exclusive lower edge."""
    x = _c(c)
    out = None
    for upper, label in edges:
        cond = x.isNotNull() if upper is None else (x <= upper)
        if low is not None:
            cond = cond & (x > low)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def np_round(c, digits: int = 0) -> Column:
    """Numpy / pandas ``round``: rint(x·10^d) / 10^d (half-even on the
    scaled binary value — differs from exact-decimal ``bround`` on inputs
    such as 16118.505)."""
    m = float(10 ** digits)
    return F.rint(_c(c) * m) / m if digits else F.rint(_c(c))


half_even = np_round

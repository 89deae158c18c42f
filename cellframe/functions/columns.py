"""Column expressions built only from Spark built-ins (codegen-friendly).

Every helper returns a ``Column``; none of them is a Python UDF.  ANSI mode
is on in Spark 4, so divisions that may hit zero use ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- binning --
def bin_value(x, mn, mx, n_edges: int = 100) -> Column:
    """Index of ``x`` among ``n_edges`` evenly spaced edges from ``mn`` to ``mx``.

    Semantics (right-open bins, like a sorted-edge search):
      0 -> 0; NaN -> n_edges; x < mn -> 0; x >= mx -> n_edges (also when
      mn = mx); otherwise 1 + j where edge(j) <= x < edge(j+1) and
      edge(j) = j * ((mx - mn) / (n_edges - 1)) + mn, the last edge being mx.
    The index is first estimated arithmetically and then corrected by one
    step against the exact edge values, so floating-point rounding of the
    estimate never changes the answer.
    """
    x, mn, mx = _c(x), _c(mn), _c(mx)
    last = n_edges - 1
    step = (mx - mn) / F.lit(float(last))
    k0 = F.floor(F.try_divide(x - mn, mx - mn) * F.lit(float(last)))
    k = F.least(F.greatest(k0, F.lit(0)), F.lit(last))

    def edge(j: Column) -> Column:
        return F.when(j >= last, mx).otherwise(j * step + mn)

    j = (F.when(x < edge(k), k - 1)
         .when(x >= edge(k + 1), k + 1)
         .otherwise(k))
    return (F.when(x == 0, F.lit(0))
            .when(F.isnan(x), F.lit(n_edges))
            .when(x < mn, F.lit(0))
            .when(x >= mx, F.lit(n_edges))
            .otherwise(j + 1)).cast("int")


def bin_value_sql(x: str, mn: str, mx: str, n_edges: int = 100) -> str:
    """The same expression as SQL text (for the DuckDB oracle)."""
    last = n_edges - 1
    step = f"(({mx} - {mn}) / {float(last)})"
    k = f"LEAST(GREATEST(FLOOR(({x} - {mn}) / NULLIF({mx} - {mn}, 0) * {float(last)}), 0), {last})"

    def edge(j: str) -> str:
        return f"(CASE WHEN ({j}) >= {last} THEN {mx} ELSE ({j}) * {step} + {mn} END)"

    j = (f"(CASE WHEN {x} < {edge(k)} THEN {k} - 1 "
         f"WHEN {x} >= {edge(f'{k} + 1')} THEN {k} + 1 ELSE {k} END)")
    return (f"CAST(CASE WHEN {x} = 0 THEN 0 WHEN isnan({x}) THEN {n_edges} "
            f"WHEN {x} < {mn} THEN 0 WHEN {x} >= {mx} THEN {n_edges} "
            f"ELSE {j} + 1 END AS INT)")


# ------------------------------------------------------------ random order --
def hash_order(*parts, seed: int = 1234) -> Column:
    """Deterministic pseudo-random sort key: md5('p1:p2:...:seed')."""
    pieces = []
    for p in parts:
        pieces += [_c(p).cast("string"), F.lit(":")]
    return F.md5(F.concat(*pieces, F.lit(str(seed))))


def hash_order_sql(*parts: str, seed: int = 1234) -> str:
    inner = ", ':', ".join(parts)
    return f"md5(concat({inner}, ':{seed}'))"


# ------------------------------------------------------------------ arrays --
def pad_right(arr, length: int, pad) -> Column:
    """Truncate or right-pad an array column to exactly ``length`` elements."""
    arr = _c(arr)
    body = F.slice(arr, 1, length)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(body), F.lit(0)))
    return F.concat(body, fill)


def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm2(a) -> Column:
    a = _c(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))


def l2_normalize(a) -> Column:
    """v / ||v||; a zero vector gives nulls (the reference yields NaN)."""
    a = _c(a)
    n = norm2(a)
    return F.transform(a, lambda x: F.try_divide(x, n))


def cosine(a, b, na=None, nb=None) -> Column:
    """Cosine similarity; 0 when either vector has zero norm.

    Pass precomputed norms (``na``/``nb``) to avoid recomputing them per pair.
    """
    a, b = _c(a), _c(b)
    na = norm2(a) if na is None else _c(na)
    nb = norm2(b) if nb is None else _c(nb)
    den = na * nb
    return F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), den))


def softmax(a) -> Column:
    a = _c(a)
    m = F.array_max(a)
    ex = F.transform(a, lambda x: F.exp(x - m))
    s = F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(ex, lambda x: x / s)


def argmax(a) -> Column:
    """0-based index of the first maximum."""
    a = _c(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def logsumexp(a) -> Column:
    a = _c(a)
    m = F.array_max(a)
    return m + F.log(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + F.exp(v - m)))


def mean_truncating(a, b) -> Column:
    """Element-wise (x + y) / 2 over the common prefix of two arrays."""
    a, b = _c(a), _c(b)
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x + y) / 2)


def non_finite_to_zero(x) -> Column:
    x = _c(x)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)

"""Word-proximity measures as one array fold.

Input per (query, section): ``lists`` = array of structs ``(k, offsets, idf)``
with one entry per query stem present in the section, ``k`` = 0..n-1.

All occurrences are merged into one position-sorted list and folded once:

* ``last[k]`` — latest position of list ``k`` seen so far;
* ``d[i][m]`` — least distance between lists ``i`` and ``m``: at an occurrence
  ``x`` of list ``i`` the nearest earlier occurrence of ``m`` is ``last[m]``,
  so ``x.p - last[m]`` taken over all ``x`` (both directions) is the minimum of
  ``|p - q|`` (P1);
* ``span`` — once every list has been seen, ``x.p - min(last)`` is the
  shortest window ending at ``x`` holding one position of every list; its
  minimum over ``x`` is the least span of P2 (no cross product, P3).

Cost per section: (number of occurrences) x n for n query stems present,
plus n^2 once at the end — no position pairs are materialised.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIG = 1 << 30


def occurrences(lists: Column) -> Column:
    """All positions of all lists as ``struct(p, k)``, sorted by position."""
    return F.array_sort(F.flatten(F.transform(
        lists, lambda l: F.transform(l["offsets"], lambda p: F.struct(p.alias("p"), l["k"].alias("k"))))))


def proximity_fold(lists: Column) -> Column:
    """``struct(last, d, span)`` after folding the occurrences of ``lists``.

    ``d`` is kept as n rows of n cells; an occurrence of list ``k`` rewrites
    row ``k`` only, so a step costs O(n), not O(n^2).  The distance of the
    pair (i, m) is ``least(d[i][m], d[m][i])``."""
    n = F.size(lists)
    init = F.struct(
        F.array_repeat(F.lit(-1), n).alias("last"),
        F.array_repeat(F.array_repeat(F.lit(BIG), n), n).alias("d"),
        F.lit(BIG).alias("span"))

    def step(acc, x):
        last = acc["last"]
        new_last = F.transform(last, lambda v, i: F.when(i == x["k"], x["p"]).otherwise(v))

        def row(r, i):
            updated = F.transform(r, lambda v, m: F.when(
                (m != x["k"]) & (F.get(last, m) >= 0), F.least(v, x["p"] - F.get(last, m))).otherwise(v))
            return F.when(i == x["k"], updated).otherwise(r)

        new_d = F.transform(acc["d"], row)
        new_span = F.when(F.forall(new_last, lambda v: v >= 0),
                          F.least(acc["span"], x["p"] - F.array_min(new_last))).otherwise(acc["span"])
        return F.struct(new_last.alias("last"), new_d.alias("d"), new_span.alias("span"))

    return F.aggregate(occurrences(lists), init, step)


def _pair_sum(d: Column, n: Column, value) -> Column:
    """Sum ``value(dist, i, m)`` over pairs i < m whose distance was reached."""
    cells = F.flatten(F.transform(d, lambda r, i: F.transform(r, lambda v, m: F.when(
        i < m, F.struct(F.least(v, F.get(F.get(d, m), i)).alias("v"), i.alias("i"), m.alias("m"))))))
    cells = F.filter(cells, lambda c: c.isNotNull() & (c["v"] < BIG))
    return F.aggregate(F.transform(cells, lambda c: value(c["v"], c["i"], c["m"])), F.lit(0.0),
                       lambda s_, c: s_ + c)


def min_dist_sum(fold: Column, n: Column) -> Column:
    """Sum over pairs of lists of 1/(least distance)^2; 0 for one list."""
    return F.when(n < 2, F.lit(0.0)).otherwise(
        _pair_sum(fold["d"], n, lambda v, i, m: 1.0 / (v.cast("double") * v.cast("double"))))


def min_span_score(fold: Column, n: Column, span_mode: str = "intended") -> Column:
    """1/(span/n)^2, 0 for fewer than two lists.

    ``span_mode="as_written"`` gives n^2: the reference's permutation generator
    starts at depth 0 against a 1-based item lookup, returns no permutation and
    leaves the span at -1."""
    nd = n.cast("double")
    if span_mode == "as_written":
        val = nd * nd
    elif span_mode == "intended":
        val = 1.0 / ((fold["span"].cast("double") / nd) * (fold["span"].cast("double") / nd))
    else:
        raise ValueError(f"unknown span_mode {span_mode!r}")
    return F.when(n < 2, F.lit(0.0)).otherwise(val)


def least_span(fold: Column, n: Column) -> Column:
    """The least span itself (null for fewer than two lists)."""
    return F.when(n >= 2, fold["span"])


def close_pair_idf_sum(fold: Column, n: Column, idfs: Column, window: int = 6) -> Column:
    """P4 helper: sum over pairs of lists with some distance < ``window`` of the
    smaller idf of the two."""
    return F.when(n < 2, F.lit(0.0)).otherwise(_pair_sum(
        fold["d"], n,
        lambda v, i, m: F.when(v < window, F.least(F.get(idfs, i), F.get(idfs, m))).otherwise(F.lit(0.0))))


def bm25_proximity(fold: Column, n: Column, idfs: Column, len_sec: Column, avg_len: Column,
                   k3: float = 1000.0, k1: float = 1.2, alpha: float = 2.0, b: float = 0.9) -> Column:
    """P4 as written: per pair with some distance < 6 add
    (k1+1) * (tpi/(u*tpi)) * min(idf)/k3 with u = alpha((1-b)+b*len/avg);
    ``tpi`` cancels, leaving (k1+1)/u per close pair."""
    u = F.lit(alpha) * ((1.0 - b) + b * (len_sec.cast("double") / avg_len))
    return (F.lit(k1 + 1.0) / u) * close_pair_idf_sum(fold, n, idfs) / F.lit(k3)


def pair_distance(a: Column, b: Column) -> Column:
    """P5: least |p - q| between two sorted offset arrays, -1 if one is absent.

    Folds over the merged, sorted occurrences with the last position of each
    side, so the cost is linear in the two lists."""
    tagged = F.array_sort(F.concat(
        F.transform(F.coalesce(a, F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), F.lit(0).alias("k"))),
        F.transform(F.coalesce(b, F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), F.lit(1).alias("k")))))
    init = F.struct(F.lit(-1).alias("la"), F.lit(-1).alias("lb"), F.lit(BIG).alias("d"))

    def step(acc, x):
        other = F.when(x["k"] == 0, acc["lb"]).otherwise(acc["la"])
        d = F.when(other >= 0, F.least(acc["d"], x["p"] - other)).otherwise(acc["d"])
        return F.struct(F.when(x["k"] == 0, x["p"]).otherwise(acc["la"]).alias("la"),
                        F.when(x["k"] == 1, x["p"]).otherwise(acc["lb"]).alias("lb"),
                        d.alias("d"))

    res = F.aggregate(tagged, init, step)
    return F.when(res["d"] < BIG, res["d"]).otherwise(F.lit(-1))


def close_pair_tpi(lists: Column, window: int = 6) -> Column:
    """n x n matrix of ``tpi`` = sum of 1/d^2 over all position pairs of two
    different lists at distance d < ``window``.  Positions are distinct
    integers, so an occurrence has at most ``window - 1`` partners after it:
    they are read with ``slice`` from the position-sorted list (O(window) per
    occurrence, no pairs materialised beyond those)."""
    occ = occurrences(lists)
    n = F.size(lists)
    contrib = F.flatten(F.transform(occ, lambda x, j: F.transform(
        F.filter(F.slice(occ, j + 2, window - 1),
                 lambda y: ((y["p"] - x["p"]) < window) & (y["k"] != x["k"])),
        lambda y: F.struct(F.least(x["k"], y["k"]).alias("i"), F.greatest(x["k"], y["k"]).alias("m"),
                           (1.0 / ((y["p"] - x["p"]).cast("double") * (y["p"] - x["p"]).cast("double"))).alias("w")))))
    init = F.array_repeat(F.array_repeat(F.lit(0.0), n), n)

    def add(acc, c):
        return F.transform(acc, lambda r, i: F.when(i == c["i"], F.transform(
            r, lambda v, m: F.when(m == c["m"], v + c["w"]).otherwise(v))).otherwise(r))

    return F.aggregate(contrib, init, add)


def bm25_proximity_rasolofo(lists: Column, n: Column, idfs: Column, len_sec: Column, avg_len: Column,
                            k3: float = 1000.0, k1: float = 1.2, alpha: float = 2.0, b: float = 0.9) -> Column:
    """P4 with ``mode="rasolofo"``: per pair of lists with tpi > 0 add
    (k1+1) * tpi/(u + tpi) * min(idf)/k3 (Rasolofo & Savoy 2003), u as in
    :func:`bm25_proximity`."""
    u = F.lit(alpha) * ((1.0 - b) + b * (len_sec.cast("double") / avg_len))
    tpi = close_pair_tpi(lists)
    cells = F.flatten(F.transform(tpi, lambda r, i: F.transform(r, lambda v, m: F.when(
        (i < m) & (v > 0), (v / (u + v)) * F.least(F.get(idfs, i), F.get(idfs, m))).otherwise(F.lit(0.0)))))
    total = F.aggregate(cells, F.lit(0.0), lambda s_, c: s_ + c)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.lit(k1 + 1.0) * total / F.lit(k3))

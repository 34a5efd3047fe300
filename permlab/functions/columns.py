"""Functions of permutations, as Column expressions over ARRAY<INT>. All stay inside the JVM.

Symbols and positions count from 0. Two arrays of one expression must have the same length; `arity_ok` checks it first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ints(*values: int) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def text(u) -> Column:
    """Symbols joined by commas: a form that other engines have too."""
    return F.array_join(_c(u).cast("array<string>"), ",")


def indices(n) -> Column:
    """0 .. n - 1; empty for n = 0."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def zipped(u, v, f) -> Column:
    return F.zip_with(_c(u), _c(v), f)


def at(u, i) -> Column:
    return F.get(_c(u), i)


def count(array: Column, test) -> Column:
    return F.size(F.filter(array, test))


# -- checks of a row


def arity_ok(u, n) -> Column:
    return F.size(_c(u)) == n


def violation(u, n) -> Column:
    """The first of the four checks that a row fails, in this order; null for a permutation of 0 .. n - 1."""
    u, n = _c(u), n if isinstance(n, Column) else F.lit(n)
    return (
        F.when(F.size(u) != n, "arity")
        .when(F.size(F.array_distinct(u)) != n, "duplicate")
        .when(F.array_max(u) != n - 1, "max")
        .when(F.array_min(u) != 0, "min")
    )


# -- distances and predicates


def distance(u, v) -> Column:
    """Chebyshev distance."""
    return F.array_max(zipped(u, v, lambda x, y: F.abs(x - y)))


def separated(u, v, d) -> Column:
    return F.exists(zipped(u, v, lambda x, y: F.abs(x - y)), lambda z: z >= d)


def separated_masked(u, v, d) -> Column:
    """Only columns count in which both are bound, that is 0 or more."""
    return F.exists(zipped(u, v, lambda x, y: (x >= 0) & (y >= 0) & (F.abs(x - y) >= d)), lambda z: z)


def masked(pre, suf, middle: int) -> Column:
    """A row that is bound in a prefix and a suffix only."""
    return F.concat(_c(pre), F.array_repeat(F.lit(-1), middle), _c(suf))


def all_columns_apart(u, v, d) -> Column:
    return F.forall(zipped(u, v, lambda x, y: F.abs(x - y)), lambda z: z >= d)


def symmetric_separated(u, v, d, image) -> Column:
    """u and v are separated, and so are their images with each other and with the rows."""
    u, v = _c(u), _c(v)
    return reduce(lambda a, b: a & b, [separated(x, y, d) for x in (u, image(u)) for y in (v, image(v))])


def separating_columns(u, v, d) -> Column:
    u, v = _c(u), _c(v)
    return F.filter(indices(F.size(u)), lambda i: F.abs(F.get(u, i) - F.get(v, i)) >= d)


def two_apart(u, v) -> Column:
    """Columns in which one is 0 and the other 2."""
    return count(zipped(u, v, lambda x, y: ((x == 0) & (y == 2)) | ((x == 2) & (y == 0))), lambda z: z)


def foes(t, s) -> Column:
    """Templates that never differ by more than one; only rows of such templates can conflict."""
    return distance(t, s) <= 1


def in_identity_block(u, d: int) -> Column:
    u = _c(u)
    return F.forall(F.transform(u, lambda x, i: F.floor(x / d) == F.floor(i / d)), lambda z: z)


def hamming(u, v) -> Column:
    return count(zipped(u, v, lambda x, y: x != y), lambda z: z)


def pairs_apart(a, b, d: int) -> Column:
    """Symbols d or more apart in groups that differ by one at most."""
    return (F.abs(a - b) >= d) & (F.abs(F.floor(a / d) - F.floor(b / d)) <= 1)


# -- images of a row


def groups(u, d: int, offset: int = 0) -> Column:
    """Template: the group of every symbol; an offset makes the lowest group the short one."""
    return F.transform(_c(u), lambda x: F.floor((x + offset) / d).cast("int"))


def lowest_short(n: int, d: int) -> int:
    return (d - n % d) % d


def complement(u, n: int) -> Column:
    return F.transform(_c(u), lambda x: (F.lit(n - 1) - x).cast("int"))


def bump_half(u, n: int) -> Column:
    return F.transform(_c(u), lambda x: F.pmod(x + n // 2, F.lit(n)).cast("int"))


def apply_permutation(perm, src, dst) -> Column:
    """perm with what was at position dst[k] put at src[k]."""
    perm, src, dst = _c(perm), _c(src), _c(dst)
    return F.transform(perm, lambda x, i: F.when(F.array_contains(src, i), F.get(perm, F.get(dst, (F.array_position(src, i) - 1).cast("int")))).otherwise(x))


def scatter(row, sym) -> Column:
    """The row whose position sym[i] holds row[i]."""
    row, sym = _c(row), _c(sym)
    return F.transform(indices(F.size(row)), lambda j: F.get(row, (F.array_position(sym, j) - 1).cast("int")))


def rotate_left(u, k: int = 3) -> Column:
    u = _c(u)
    return F.concat(F.slice(u, F.lit(k + 1), F.greatest(F.size(u) - k, F.lit(0))), F.slice(u, 1, k))


def rotate_positions(p, n: int, k: int = 3) -> Column:
    return F.array_sort(F.transform(_c(p), lambda x: F.pmod(x - k + n, F.lit(n)).cast("int")))


def orbit(u, n: int, k: int = 3) -> list[Column]:
    """The row and its rotations by k, until they come back."""
    out, at_ = [], 0
    while True:
        out.append(rotate_left(u, at_) if at_ else _c(u))
        at_ = (at_ + k) % n
        if not at_:
            return out


def orbit_separated(u, v, n: int, d: int, k: int = 3) -> Column:
    """u's rotations are separated from each other and from v."""
    turned = orbit(u, n, k)
    tests = [separated(a, b, d) for i, a in enumerate(turned) for b in turned[i + 1 :]] + [separated(a, v, d) for a in turned]
    return reduce(lambda a, b: a & b, tests)


def rename(u, names) -> Column:
    """Symbols looked up in an array; those beyond it stay."""
    return F.transform(_c(u), lambda x: F.coalesce(F.get(_c(names), x), x))


def rename_map(u, names: dict[int, int]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    return F.transform(_c(u), lambda x: F.coalesce(table[x], x)) if names else _c(u)


def infill(row, highs, ps) -> Column:
    """The row with highs at positions ps and its own symbols, in order, at the others."""
    row, highs, ps = _c(row), _c(highs), _c(ps)
    return F.transform(
        indices(F.size(row) + F.size(ps)),
        lambda i: F.when(F.array_contains(ps, i), F.get(highs, (F.array_position(ps, i) - 1).cast("int"))).otherwise(F.get(row, i - F.size(F.filter(ps, lambda p: p < i)))),
    )


def overwrite(src, ps, qs) -> Column:
    """src with qs at positions ps."""
    src, ps, qs = _c(src), _c(ps), _c(qs)
    return F.transform(src, lambda x, i: F.when(F.array_contains(ps, i), F.get(qs, (F.array_position(ps, i) - 1).cast("int"))).otherwise(x))


def quick_fill(t, d: int) -> Column:
    """A template filled with each group's symbols in ascending order."""
    t = _c(t)
    return F.transform(t, lambda g, i: (g * d + F.size(F.filter(F.slice(t, F.lit(1), i), lambda x: x == g))).cast("int"))


def positions(u, test) -> Column:
    u = _c(u)
    return F.filter(indices(F.size(u)), lambda i: test(F.get(u, i)))


def group_positions(u, d: int, g) -> Column:
    return positions(u, lambda x: F.floor(x / d) == g)


def positions_by_group(u, n: int, d: int, offset: int = 0) -> Column:
    return F.array(*[positions(u, _in_group(d, offset, g)) for g in range(-(-(n + offset) // d))])


def _in_group(d: int, offset: int, g: int):
    return lambda x: F.floor((x + offset) / d) == g


def end_positions(u, n: int) -> Column:
    """Positions of symbol 0, of those between, and of n - 1."""
    return F.array(positions(u, lambda x: x == 0), positions(u, lambda x: (x > 0) & (x < n - 1)), positions(u, lambda x: x == n - 1))


def low_high_positions(u, d: int, columns: int) -> Column:
    """Positions, among the first columns, of symbols below d - 1 and of the rest."""
    first = F.slice(_c(u), 1, columns)
    return F.array(positions(first, lambda x: x < d - 1), positions(first, lambda x: x >= d - 1))


def high_mask(u, n: int, k: int) -> Column:
    return F.transform(_c(u), lambda x: (x >= n - k).cast("int"))


def prefix_counts(u) -> Column:
    """How often each symbol came before, itself included."""
    u = _c(u)
    return F.transform(u, lambda x, i: F.size(F.filter(F.slice(u, F.lit(1), i + 1), lambda y: y == x)))


def refill(pre, suf, lows, highs, d: int) -> Column:
    """Prefix and suffix with lows in order for symbols below d and highs in order for the rest, as one array."""
    whole, lows, highs = F.concat(_c(pre), _c(suf)), _c(lows), _c(highs)
    below = lambda i, low: F.size(F.filter(F.slice(whole, F.lit(1), i), (lambda y: y < d) if low else (lambda y: y >= d)))
    return F.transform(whole, lambda x, i: F.when(x < d, F.get(lows, below(i, True))).otherwise(F.get(highs, below(i, False))))


def hydrate(k: int, r: int, twos) -> Column:
    """2k ones, but 0 at r and 2 at the positions of twos."""
    return F.transform(indices(2 * k), lambda i: F.when(i == r, 0).when(F.array_contains(_c(twos), i), 2).otherwise(1))


def mutation(u, v) -> tuple[Column, Column]:
    """Source and target positions of the symbols of u that stand elsewhere in v, in the order of positions in u."""
    u, v = _c(u), _c(v)
    moved = F.filter(indices(F.size(u)), lambda i: F.get(u, i) != F.get(v, i))
    return moved, F.transform(moved, lambda i: (F.array_position(u, F.get(v, i)) - 1).cast("int"))


def mutate(u, src, dst) -> Column:
    return apply_permutation(u, src, dst)


def common_length(u, v) -> Column:
    """Longest common subsequence of two permutations: the longest increasing one of v's positions in u, by tails."""
    u, v = _c(u), _c(v)
    places = F.transform(v, lambda y: (F.array_position(u, y) - 1).cast("int"))
    put = lambda tails, p: F.concat(F.filter(tails, lambda t: t < p), F.array(p), F.slice(F.filter(tails, lambda t: t >= p), F.lit(2), F.size(tails) + 1))
    return F.size(F.aggregate(F.filter(places, lambda p: p >= 0), F.array().cast("array<int>"), put))


def ulam(u, v) -> Column:
    return F.size(_c(u)) - common_length(u, v)


# -- numbers


def ceil_div(n: Column, d: Column) -> Column:
    return F.floor((n + d - 1) / d).cast("int")


def binomial(n: Column, k: Column) -> Column:
    """As a product that stays whole at every step; exact while it fits DECIMAL(38)."""
    step = lambda acc, i: F.floor(acc * (n - k + i) / i).cast("decimal(38,0)")
    return F.when((k < 0) | (k > n), F.lit(0).cast("decimal(38,0)")).otherwise(F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), F.lit(1).cast("decimal(38,0)"), step))


def pair_value(u, v) -> Column:
    """Score of two symbolic rows (ARRAY<STRING>): 0 if an 8 meets an L; else by the least fixed symbols that meet an L on either side.

    Fixed values: (6, 6) -5, (6, 7) -2, (7, 7) -1. Any other case is an error.
    """
    u, v = _c(u), _c(v)
    least = lambda x, y: F.array_min(F.filter(zipped(x, y, lambda a, b: F.when(b == "L", F.try_to_number(F.when(a.rlike("^[0-9]+$"), a), F.lit("99")).cast("int"))), lambda z: z.isNotNull()))
    auto = F.exists(zipped(u, v, lambda a, b: ((a == "8") & (b == "L")) | ((a == "L") & (b == "8"))), lambda z: z)
    one, other = least(u, v), least(v, u)
    lo, hi = F.when(one <= other, one).otherwise(other), F.when(one <= other, other).otherwise(one)
    value = F.when((lo == 6) & (hi == 6), -5).when((lo == 6) & (hi == 7), -2).when((lo == 7) & (hi == 7), -1)
    return F.when(auto, 0).otherwise(F.coalesce(value, F.raise_error(F.lit("no value for these rows")).cast("int")))


def low_set_key(u) -> Column:
    return positions(u, lambda x: x == 0)

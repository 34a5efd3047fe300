"""All queries of the library and their SQL, by name.

Queries take their rows from the vectors table (permutations by rank, n = 8 unless said) or from generators. Arrays are
returned as text, which all engines write alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permlab.functions import columns as C
from permlab.functions import numbers
from permlab.operators import generate as G
from permlab.operators import classes, graph, rounds, search
from permlab.operators import relations as R
from permlab.plans.fixtures import RANK_SQL, rank_array
from permlab.sources import text
from permlab.sources.storage import shared_dir, staged
from permlab.streaming import watch

N, D = 8, 3
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from permlab.plans import searches  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from permlab.plans import searches  # noqa: F401  registers its SQL

    return dict(_SQL)


# -- pieces of SQL


def rank(n: int = N) -> str:
    return RANK_SQL.format(n=n)


def cheb(a: str, b: str) -> str:
    return f"list_max(list_transform(range(1, len({a}) + 1), lambda i: abs({a}[i] - {b}[i])))"


def txt(u: str) -> str:
    return f"array_to_string({u}, ',')"


def combos(n: int, k: int) -> str:
    return f"combos AS (SELECT row_number() OVER (ORDER BY ps) - 1 AS id, ps FROM (SELECT list_filter(range({n}), lambda i: (m >> i) & 1 = 1) AS ps, m FROM (SELECT unnest(range({1 << n})) AS m)) WHERE len(ps) = {k})"


def perms(n: int, m: int | None = None) -> str:
    m = m or n
    return f"perms(u) AS (SELECT []::INT[] UNION ALL SELECT list_append(u, x::INT) FROM perms, (SELECT unnest(range({m})) AS x) WHERE len(u) < {n} AND NOT list_contains(u, x)), full_perms AS (SELECT u FROM perms WHERE len(u) = {n})"


def pairs(d: int, where: str = "") -> str:
    return f"pairs AS (SELECT a.row_id AS a, b.row_id AS b, {cheb('a.u', 'b.u')} AS distance FROM pa a JOIN pa b ON a.row_id < b.row_id WHERE {cheb('a.u', 'b.u')} < {d} {where})"


def degree_sql(d: int) -> str:
    return f"{pairs(d)}, deg AS (SELECT pa.row_id, count(e.x) AS degree FROM pa LEFT JOIN (SELECT a AS x FROM pairs UNION ALL SELECT b FROM pairs) e ON pa.row_id = e.x GROUP BY pa.row_id)"


def fill(row: str, highs: str, ps: str) -> str:
    """A row with highs at the 0-based positions ps."""
    return f"list_transform(range(len({row}) + len({ps})), lambda i: CASE WHEN list_contains({ps}, i) THEN {highs}[list_position({ps}, i)] ELSE {row}[i - len(list_filter({ps}, lambda p: p < i)) + 1] END)"


def templates_sql(n: int, d: int) -> str:
    sizes = " ".join(f"WHEN {g} THEN {min(d, n - g * d)}" for g in range(-(-n // d)))
    return f"ts(t) AS (SELECT []::INT[] UNION ALL SELECT list_append(t, g::INT) FROM ts, (SELECT unnest(range({-(-n // d)})) AS g) WHERE len(t) < {n} AND len(list_filter(t, lambda x: x = g)) < CASE g {sizes} END), templates AS (SELECT row_number() OVER (ORDER BY t) - 1 AS row_id, t FROM ts WHERE len(t) = {n})"


def with_rank(f):
    return lambda spark, sf_dir: f(rank_array(spark, sf_dir))


# -- checks


@query(f"WITH {rank()} SELECT row_id, (CASE WHEN row_id % 5 = 0 THEN 'arity' WHEN row_id % 5 = 1 THEN 'duplicate' WHEN row_id % 5 = 2 THEN 'max' WHEN row_id % 5 = 3 THEN 'min' END) AS problem FROM pa WHERE row_id % 5 < 4")
def v1_v4_invalid_rows(spark, sf_dir):
    u = F.col("u")
    spoilt = F.when(F.col("row_id") % 5 == 0, F.slice(u, 1, N - 1)).when(F.col("row_id") % 5 == 1, F.transform(u, lambda x: F.when(x == 7, 6).otherwise(x)))
    spoilt = spoilt.when(F.col("row_id") % 5 == 2, F.transform(u, lambda x: F.when(x == 7, 9).otherwise(x))).when(F.col("row_id") % 5 == 3, F.transform(u, lambda x: F.when(x == 0, -1).otherwise(x))).otherwise(u)
    return rank_array(spark, sf_dir).select("row_id", C.violation(spoilt, N).alias("problem")).where("problem IS NOT NULL")


# -- functions of a row: each a column of one pass


def _row_columns():
    u = F.col("u")
    src, dst, ps = C.ints(0, 2, 5), C.ints(2, 5, 0), C.ints(1, 4, 6)
    return {
        "f1_groups": C.text(C.groups(u, D)),
        "f2_offset_groups": C.text(C.groups(u, D, C.lowest_short(N, D))),
        "f3_complement": C.text(C.complement(u, N)),
        "f4_bump_half": C.text(C.bump_half(u, N)),
        "f5_apply_permutation": C.text(C.apply_permutation(u, src, dst)),
        "f6_scatter": C.text(C.scatter(u, C.complement(u, N))),
        "f7_rotate": C.text(C.rotate_left(u)),
        "f7_rotate_positions": C.text(C.rotate_positions(F.slice(u, 1, 3), N)),
        "f8_rename": C.text(C.rename(u, C.ints(3, 1, 0, 2))),
        "f8_rename_map": C.text(C.rename_map(u, {7: 0, 0: 7})),
        "f9_infill": C.text(C.infill(u, C.ints(8, 9, 10), ps)),
        "f10_overwrite": C.text(C.overwrite(u, ps, C.ints(20, 21, 22))),
        "f11_quick_fill": C.text(C.quick_fill(C.groups(u, D), D)),
        "f12_group_positions": C.text(C.group_positions(u, D, 1)),
        "f13_positions_by_group": F.array_join(F.transform(C.positions_by_group(u, N, D), C.text), "|"),
        "f14_end_positions": F.array_join(F.transform(C.end_positions(u, N), C.text), "|"),
        "f14_low_high": F.array_join(F.transform(C.low_high_positions(u, D, N - 1), C.text), "|"),
        "f15_high_mask": C.text(C.high_mask(u, N, 3)),
        "f22_range": C.text(C.indices(F.get(u, F.lit(0)))),
        "f23_hydrate": C.text(C.hydrate(4, 2, F.slice(u, 1, 3))),
        "f24_refill": C.text(C.refill(F.slice(u, 1, 3), F.slice(u, 7, 2), C.ints(10, 11, 12), C.ints(20, 21, 22, 23, 24), D)),
        "f25_prefix_counts": C.text(C.prefix_counts(C.groups(u, D))),
        "f27_mutation": C.text(C.mutate(u, *C.mutation(u, C.complement(u, N)))),
        "p11_identity_block": C.in_identity_block(u, D).cast("int"),
    }


_ROW_SQL = {
    "f1_groups": txt(f"list_transform(u, lambda x: x // {D})"),
    "f2_offset_groups": txt(f"list_transform(u, lambda x: (x + {C.lowest_short(N, D)}) // {D})"),
    "f3_complement": txt("list_transform(u, lambda x: 7 - x)"),
    "f4_bump_half": txt("list_transform(u, lambda x: (x + 4) % 8)"),
    "f5_apply_permutation": txt("[u[3], u[2], u[6], u[4], u[5], u[1], u[7], u[8]]"),
    "f6_scatter": txt("list_transform(range(0, 8), lambda j: u[list_position(list_transform(u, lambda x: 7 - x), j)])"),
    "f7_rotate": txt("[u[4], u[5], u[6], u[7], u[8], u[1], u[2], u[3]]"),
    "f7_rotate_positions": txt("list_sort(list_transform(u[1:3], lambda p: (p - 3 + 8) % 8))"),
    "f8_rename": txt("list_transform(u, lambda x: CASE x WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE x END)"),
    "f8_rename_map": txt("list_transform(u, lambda x: CASE x WHEN 0 THEN 7 WHEN 7 THEN 0 ELSE x END)"),
    "f9_infill": txt(fill("u", "[8, 9, 10]", "[1, 4, 6]")),
    "f10_overwrite": txt("[u[1], 20, u[3], u[4], 21, u[6], 22, u[8]]"),
    "f11_quick_fill": txt(f"list_transform(range(1, 9), lambda i: u[i] // {D} * {D} + len(list_filter(range(1, i), lambda j: u[j] // {D} = u[i] // {D})))"),
    "f12_group_positions": txt(f"list_filter(range(0, 8), lambda i: u[i + 1] // {D} = 1)"),
    "f13_positions_by_group": "array_to_string(list_transform(range(0, 3), lambda g: array_to_string(list_filter(range(0, 8), lambda i: u[i + 1] // 3 = g), ',')), '|')",
    "f14_end_positions": "array_to_string([array_to_string(list_filter(range(0, 8), lambda i: u[i + 1] = 0), ','), array_to_string(list_filter(range(0, 8), lambda i: u[i + 1] > 0 AND u[i + 1] < 7), ','), array_to_string(list_filter(range(0, 8), lambda i: u[i + 1] = 7), ',')], '|')",
    "f14_low_high": "array_to_string([array_to_string(list_filter(range(0, 7), lambda i: u[i + 1] < 2), ','), array_to_string(list_filter(range(0, 7), lambda i: u[i + 1] >= 2), ',')], '|')",
    "f15_high_mask": txt("list_transform(u, lambda x: (x >= 5)::INT)"),
    "f22_range": "array_to_string(range(0, u[1]), ',')",
    "f23_hydrate": txt("list_transform(range(0, 8), lambda i: CASE WHEN i = 2 THEN 0 WHEN list_contains(u[1:3], i) THEN 2 ELSE 1 END)"),
    "f24_refill": txt("list_transform(range(1, 6), lambda i: CASE WHEN (u[1:3] || u[7:8])[i] < 3 THEN [10, 11, 12][len(list_filter(range(1, i), lambda j: (u[1:3] || u[7:8])[j] < 3)) + 1] ELSE [20, 21, 22, 23, 24][len(list_filter(range(1, i), lambda j: (u[1:3] || u[7:8])[j] >= 3)) + 1] END)"),
    "f25_prefix_counts": txt("list_transform(range(1, 9), lambda i: len(list_filter(range(1, i + 1), lambda j: u[j] // 3 = u[i] // 3)))"),
    "f27_mutation": txt("list_transform(u, lambda x: 7 - x)"),
    "p11_identity_block": "(len(list_filter(range(0, 8), lambda i: u[i + 1] // 3 = i // 3)) = 8)::INT",
}


@query(f"WITH {rank()} SELECT row_id, {', '.join(f'{x} AS {k}' for k, x in _ROW_SQL.items())} FROM pa")
def f_row_functions(spark, sf_dir):
    return rank_array(spark, sf_dir).select("row_id", *[c.alias(k) for k, c in _row_columns().items()])


#: Two rows side by side: each with its successor by row_id.
_NEXT = "duo AS (SELECT a.row_id, a.u AS u, b.u AS v FROM pa a JOIN pa b ON b.row_id = a.row_id + 1)"
_DUO_SQL = {
    "f16_distance": cheb("u", "v"),
    "p1_separated": f"({cheb('u', 'v')} >= 5)::INT",
    "p2_masked": "(len(list_filter(range(1, 9), lambda i: u[i] > 1 AND v[i] > 1 AND abs(u[i] - v[i]) >= 4)) > 0)::INT",
    "p3_masked_ends": "(len(list_filter([1, 2, 3, 7, 8], lambda i: abs(u[i] - v[i]) >= 5)) > 0)::INT",
    "p4_symmetric": f"({cheb('u', 'v')} >= 4 AND {cheb('list_transform(u, lambda x: 7 - x)', 'v')} >= 4)::INT",
    "p6_all_columns": "(len(list_filter(range(1, 9), lambda i: abs(u[i] - v[i]) >= 1)) = 8)::INT",
    "p7_foes": f"({cheb('list_transform(u, lambda x: x // 3)', 'list_transform(v, lambda x: x // 3)')} <= 1)::INT",
    "p8_columns": txt("list_filter(range(0, 8), lambda i: abs(u[i + 1] - v[i + 1]) >= 4)"),
    "p9_two_apart": "len(list_filter(range(1, 9), lambda i: (u[i] // 3 = 0 AND v[i] // 3 = 2) OR (u[i] // 3 = 2 AND v[i] // 3 = 0)))::INT",
    "p12_same_mask": "(list_transform(u, lambda x: (x >= 7)::INT) = list_transform(v, lambda x: (x >= 7)::INT))::INT",
    "f18_hamming": "len(list_filter(range(1, 9), lambda i: u[i] <> v[i]))::INT",
}


def _duo_columns():
    u, v = F.col("u"), F.col("v")
    hide = lambda a: F.transform(a, lambda x: F.when(x > 1, x).otherwise(-1))
    ends = lambda a: C.masked(F.slice(a, 1, 3), F.slice(a, 7, 2), 3)
    return {
        "f16_distance": C.distance(u, v), "p1_separated": C.separated(u, v, 5), "p2_masked": C.separated_masked(hide(u), hide(v), 4),
        "p3_masked_ends": C.separated_masked(ends(u), ends(v), 5), "p4_symmetric": C.symmetric_separated(u, v, 4, lambda x: C.complement(x, N)),
        "p6_all_columns": C.all_columns_apart(u, v, 1), "p7_foes": C.foes(C.groups(u, D), C.groups(v, D)), "p8_columns": C.text(C.separating_columns(u, v, 4)),
        "p9_two_apart": C.two_apart(C.groups(u, D), C.groups(v, D)), "p12_same_mask": C.high_mask(u, N, 1) == C.high_mask(v, N, 1), "f18_hamming": C.hamming(u, v),
    }


def _duo(spark, sf_dir):
    a = rank_array(spark, sf_dir)
    return a.join(a.select((F.col("row_id") - 1).alias("row_id"), F.col("u").alias("v")), "row_id")


@query(f"WITH {rank()}, {_NEXT} SELECT row_id, {', '.join(f'{x} AS {k}' for k, x in _DUO_SQL.items())} FROM duo")
def p_pair_functions(spark, sf_dir):
    flag = lambda k, c: c if k in ("f16_distance", "p8_columns", "p9_two_apart", "f18_hamming") else c.cast("int")
    return _duo(spark, sf_dir).select("row_id", *[flag(k, c).alias(k) for k, c in _duo_columns().items()])


@query(f"""WITH RECURSIVE {rank()}, {_NEXT},
 places AS (SELECT row_id, list_transform(v, lambda y: list_position(u, y)) AS p FROM duo),
 subs(row_id, p, i, last, n) AS (SELECT row_id, p, 0, 0, 0 FROM places
  UNION SELECT row_id, p, j::INT, p[j]::INT, n + 1 FROM subs, (SELECT unnest(range(1, 9)) AS j) WHERE j > i AND p[j] > last)
 SELECT row_id, (8 - max(n))::INT AS ulam FROM subs GROUP BY row_id""")
def f17_ulam(spark, sf_dir):
    """The SQL lists all increasing subsequences."""
    return _duo(spark, sf_dir).select("row_id", C.ulam("u", "v").alias("ulam"))


@query("SELECT n::INT AS n, d::INT AS d, ((n + d - 1) // d)::INT AS up FROM range(1, 40) a(n), range(1, 12) b(d)")
def f19_ceil_div(spark, sf_dir):
    rows = spark.range(1, 40).select(F.col("id").cast("int").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(11))).alias("d"))
    return rows.select("n", "d", C.ceil_div(F.col("n"), F.col("d")).alias("up"))


@query("SELECT n::INT AS n, k::INT AS k, CASE WHEN k > n THEN 0 ELSE (factorial(n::INT) // factorial(k::INT) // factorial((n - k)::INT)) END::BIGINT AS c FROM range(0, 21) a(n), range(0, 21) b(k)")
def f20_binomial(spark, sf_dir):
    rows = spark.range(21).select(F.col("id").cast("int").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
    return rows.select("n", "k", C.binomial(F.col("n"), F.col("k")).cast("long").alias("c"))


@query()
def f21_bound_table(spark, sf_dir):
    return numbers.bound_table(spark, [(n, n // 4) for n in range(20, 101, 10)])


@query("SELECT a::INT AS a, b::INT AS b FROM range(0, 9) x(a), range(0, 9) y(b) WHERE a < b AND b - a >= 3 AND abs(a // 3 - b // 3) <= 1")
def p15_symbol_pairs(spark, sf_dir):
    return R.symbol_pairs(9, 3, spark)


# -- generators


@query(f"WITH {combos(9, 4)} SELECT id, {txt('ps')} AS ps FROM combos")
def g1_combinations(spark, sf_dir):
    return G.combinations(spark, 9, 4).select("id", C.text("ps").alias("ps"))


@query(f"WITH {combos(7, 3).replace('ORDER BY ps', 'ORDER BY m')} SELECT id, {txt('ps')} AS ps FROM combos")
def g19_combinations_by_mask(spark, sf_dir):
    return G.combinations_by_mask(spark, 7, 3).select("id", C.text("ps").alias("ps"))


@query(f"WITH RECURSIVE {perms(6)} SELECT {txt('u')} AS u FROM full_perms")
def g2_permutations(spark, sf_dir):
    return G.permutations(spark, 6).select(C.text("u").alias("u"))


@query(f"WITH RECURSIVE {perms(3, 6)} SELECT {txt('u')} AS u FROM full_perms")
def g2_partial_permutations(spark, sf_dir):
    return G.permutations(spark, 3, 6).select(C.text("u").alias("u"))


@query("SELECT a || ',' || b || ',' || c AS u FROM (VALUES ('1'), ('2')) x(a), (VALUES ('7')) y(b), (VALUES ('2'), ('3'), ('L')) z(c)")
def g3_g21_product(spark, sf_dir):
    return G.product(spark, [[1, 2], [7], [2, 3, "L"]]).select(F.array_join("u", ",").alias("u"))


_LITTLE = "little AS (SELECT row_id, u FROM pa)"


def _little(spark, sf_dir, n=4):
    return rank_array(spark, sf_dir, n)


def _woven(n, d, highs, raised):
    return f"WITH {rank(n - d)}, {_LITTLE}, {combos(n, d)} SELECT row_number() OVER (ORDER BY id, row_id) - 1 AS row_id, {txt(fill(raised, highs, 'ps'))} AS u FROM little, combos"


@query(_woven(6, 2, "[4, 5]", "u"))
def g4_weave_high(spark, sf_dir):
    return G.weave_high(_little(spark, sf_dir), 6, 2).select("row_id", C.text("u").alias("u"))


@query(_woven(6, 2, "[0, 1]", "list_transform(u, lambda x: x + 2)"))
def g5_weave_low(spark, sf_dir):
    return G.weave_low(_little(spark, sf_dir), 6, 2).select("row_id", C.text("u").alias("u"))


@query(_woven(6, 2, "[0, 5]", "list_transform(u, lambda x: x + 1)"))
def g9_weave_ends(spark, sf_dir):
    return G.weave_ends(_little(spark, sf_dir), 6).select("row_id", C.text("u").alias("u"))


@query(f"WITH {rank(4)}, {_LITTLE}, {combos(6, 2)}, woven AS (SELECT row_number() OVER (ORDER BY id, row_id) - 1 AS row_id, {fill('u', '[4, 5]', 'ps')} AS u FROM little, combos), keyed AS (SELECT *, least({txt('list_transform(u, lambda x: x // 2)')}, {txt('list_transform(u, lambda x: (x + 3) % 6 // 2)')}) AS key FROM woven) SELECT min(row_id) AS row_id, {txt('arg_min(u, row_id)')} AS u FROM keyed GROUP BY key")
def g6_weave_once(spark, sf_dir):
    return G.weave_once(_little(spark, sf_dir), 6, 2, lambda u: C.bump_half(u, 6)).select("row_id", C.text("u").alias("u"))


@query(f"WITH {combos(6, 3)} SELECT {txt('ps')} AS ps, {txt('list_filter(range(0, 6), lambda i: NOT list_contains(ps, i))')} AS other FROM combos WHERE ps[1] = 0")
def g7_complementary_pairs(spark, sf_dir):
    return G.complementary_pairs(spark, 6).select(C.text("ps").alias("ps"), C.text("other").alias("other"))


@query(f"WITH {rank(4)}, {_LITTLE}, {combos(6, 2)}, reps AS (SELECT * FROM combos WHERE ps <= list_sort(list_transform(ps, lambda p: (p + 3) % 6))) SELECT row_number() OVER (ORDER BY id, row_id) - 1 AS row_id, {txt(fill('u', '[4, 5]', 'ps'))} AS u FROM little, reps")
def g8_weave_orbits(spark, sf_dir):
    return G.weave_orbits(_little(spark, sf_dir), 6, 2).select("row_id", C.text("u").alias("u"))


@query(f"WITH {combos(7, 3)} SELECT id AS row_id, {txt(fill('range(0, 4)', '[4, 5, 6]', 'ps'))} AS u FROM combos")
def g12_ascending_array(spark, sf_dir):
    return G.ascending_array(spark, 7, 3).select("row_id", C.text("u").alias("u"))


@query(f"WITH RECURSIVE {templates_sql(8, 3)} SELECT row_id, {txt('t')} AS t FROM templates")
def g14_templates(spark, sf_dir):
    return G.templates(spark, 8, 3).select("row_id", C.text("t").alias("t"))


@query(f"WITH RECURSIVE {perms(6)} SELECT {txt('u')} AS u FROM full_perms WHERE list_transform(u, lambda x: x // 2) = [0, 2, 1, 1, 0, 2]")
def g15_infills(spark, sf_dir):
    return G.infills(spark, [0, 2, 1, 1, 0, 2], 2).select(C.text("u").alias("u"))


@query("SELECT '4,' || a || ',' || b || ',0' AS u FROM (VALUES (0), (1)) x(a), (VALUES (2), (3)) y(b)")
def g16_fill_pattern(spark, sf_dir):
    return G.fill_pattern(spark, [4, -1, -1, 0], [2, 0, 1, 0], 2).select(C.text("u").alias("u"))


@query(f"WITH RECURSIVE {perms(6)} SELECT {txt('u')} AS u FROM full_perms WHERE list_transform(u, lambda x: x // 3) = [1, 0, 0, 1, 1, 0] AND u <> [3, 0, 1, 4, 5, 2]")
def g17_other_fillings(spark, sf_dir):
    return G.other_fillings(spark, [3, 0, 1, 4, 5, 2], 3).select(C.text("u").alias("u"))


@query(f"WITH {combos(8, 4)} SELECT id AS row_id, {txt(fill('range(4, 8)', '[0, 1, 2, 3]', 'ps'))} AS u FROM combos")
def g18_lexicographic_array(spark, sf_dir):
    return G.lexicographic_array(spark, 8).select("row_id", C.text("u").alias("u"))


@query(f"WITH RECURSIVE {perms(4, 5)} SELECT {txt('u[1:2]')} AS pre, {txt('u[3:4]')} AS suf FROM full_perms")
def g20_admissible_ends(spark, sf_dir):
    return G.admissible_ends(spark, 2, 2, 5).select(C.text("pre").alias("pre"), C.text("suf").alias("suf"))


_FILLED = "list_transform(range(1, 9), lambda i: t[i] * 3 + len(list_filter(range(1, i), lambda j: t[j] = t[i])))"


@query(f"WITH RECURSIVE {rank()}, {templates_sql(8, 3)} SELECT {txt('t')} AS t, {txt(_FILLED)} AS u FROM templates WHERE t NOT IN (SELECT list_transform(u, lambda x: x // 3) FROM pa)")
def g22_missing_templates(spark, sf_dir):
    return G.missing_templates(rank_array(spark, sf_dir), N, D).select(C.text("t").alias("t"), C.text("u").alias("u"))


@query(f"WITH RECURSIVE {rank()}, {templates_sql(8, 3)}, own AS (SELECT list_transform(u, lambda x: x // 3) AS t, arg_min(u, row_id) AS u FROM pa GROUP BY 1) SELECT s.row_id, {txt('coalesce(own.u, ' + _FILLED.replace('t[', 's.t[') + ')')} AS u FROM templates s LEFT JOIN own ON s.t = own.t")
def g22_j10_complete_templates(spark, sf_dir):
    return G.complete_templates(rank_array(spark, sf_dir), N, D).select("row_id", C.text("u").alias("u"))


@query(f"WITH {rank(4)}, {_LITTLE} SELECT row_id, {txt('[0, 7] || list_transform(u, lambda x: x + 2) || [1, 6]')} AS u FROM little")
def g23_assemble(spark, sf_dir):
    return G.assemble(_little(spark, sf_dir), [0, 7], [1, 6], 2).select("row_id", C.text("u").alias("u"))


@query(f"WITH RECURSIVE {rank(4)}, blocks AS (SELECT row_id // 5 AS block_id, u FROM pa), {perms(4)} SELECT block_id::BIGINT AS block_id, {txt('p.u')} AS ps FROM blocks b, full_perms p WHERE list_transform(p.u, lambda i: b.u[i + 1]) IN ([0, 1, 2, 3], [3, 2, 1, 0]) GROUP BY block_id, p.u HAVING count(DISTINCT list_transform(p.u, lambda i: b.u[i + 1])) = 2")
def g24_g25_block_arrangements(spark, sf_dir):
    blocks = _little(spark, sf_dir).select(F.floor(F.col("row_id") / 5).alias("block_id"), "row_id", "u")
    return G.block_arrangements(blocks, text.literals(spark, [[0, 1, 2, 3], [3, 2, 1, 0]]), 4).select("block_id", C.text("ps").alias("ps"))


@query(f"WITH {combos(6, 3)} SELECT id AS row_id, {txt('list_transform(range(0, 6), lambda i: CASE WHEN list_contains(ps, i) THEN [2, 0, 1][list_position(ps, i)] ELSE -1 END)')} AS u FROM combos")
def g28_same_low_order(spark, sf_dir):
    return G.same_low_order(spark, 6, [2, 0, 1]).select("row_id", C.text("u").alias("u"))


@query()
def g13_random_array(spark, sf_dir):
    return G.random_array(spark, 9, 500, 1).select("row_id", C.text("u").alias("u"))


@query(f"WITH RECURSIVE {perms(6)} SELECT count(*) AS n FROM full_perms WHERE {cheb('u', '[0, 1, 2, 3, 4, 5]')} < 3 AND list_transform(u, lambda x: x // 3) <> [0, 0, 0, 1, 1, 1]")
def a10_near_identity(spark, sf_dir):
    return G.near_identity(spark, 6).agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {perms(6)} SELECT {txt('list_transform(u, lambda x: x // 3)')} AS t, count(*) AS n FROM full_perms WHERE {cheb('u', '(u[4:6] || u[1:3])')} < 3 GROUP BY 1")
def a11_rotation_failures(spark, sf_dir):
    rows = G.permutations(spark, 6).where(~C.separated("u", C.rotate_left("u"), 3))
    return rows.groupBy(C.text(C.groups("u", 3)).alias("t")).agg(F.count("*").alias("n"))


_TURNED = "list_transform(range(0, 8), lambda i: u[(i + {k}) % 8 + 1])"
_ORBIT = [k * 3 % 8 for k in range(8)]
_APART = " AND ".join([f"{cheb(_TURNED.format(k=k), _TURNED.format(k=j))} >= 3" for i, k in enumerate(_ORBIT) for j in _ORBIT[i + 1 :]] + [f"{cheb(_TURNED.format(k=k), 'range(0, 8)')} >= 3" for k in _ORBIT])


@query(f"WITH {rank()} SELECT row_id, ({_APART})::INT AS ok FROM pa")
def p10_orbits(spark, sf_dir):
    """Rows whose rotations by three are apart from each other and from the identity."""
    return rank_array(spark, sf_dir).select("row_id", C.orbit_separated("u", C.indices(N), N, D).cast("int").alias("ok"))


@query(f"WITH RECURSIVE {combos(4, 2)}, pa AS (SELECT {fill('range(2, 4)', '[0, 1]', 'ps')} AS u FROM combos), {perms(4)} SELECT {txt('m.u')} AS mid FROM full_perms m WHERE NOT EXISTS (SELECT 1 FROM pa a, pa b WHERE a.u < b.u AND {cheb('list_transform(a.u, lambda x: m.u[x + 1])', 'list_transform(b.u, lambda x: m.u[x + 1])')} < 1)")
def e6_constructible(spark, sf_dir):
    return G.constructible(G.lexicographic_array(spark, 4), 1).select(C.text("mid").alias("mid"))


# -- joins and aggregates


@query(f"WITH {rank()}, {pairs(D)} SELECT a, b, distance FROM pairs")
def j1_conflicts(spark, sf_dir):
    return R.conflicts(rank_array(spark, sf_dir), D)


@query(f"WITH {rank()}, {pairs(2)} SELECT a, b, distance FROM pairs")
def j2_conflicts_of_foes(spark, sf_dir):
    return R.conflicts(rank_array(spark, sf_dir), 2)


@query(f"WITH RECURSIVE {templates_sql(7, 3)} SELECT {txt('a.t')} AS t, {txt('b.t')} AS s FROM templates a, templates b WHERE {cheb('a.t', 'b.t')} <= 1")
def j3_foes(spark, sf_dir):
    return R.foe_pairs(G.templates(spark, 7, 3)).select(C.text("t").alias("t"), C.text("s").alias("s"))


@query(f"WITH {rank()}, {pairs(D)} SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs")
def j4_conflicts_both_ways(spark, sf_dir):
    return R.both_ways(R.conflicts(rank_array(spark, sf_dir), D).select("a", "b"))


_SMALL = "few AS (SELECT * FROM pa)"


def _few(spark, sf_dir):
    return rank_array(spark, sf_dir)


def _few_sql(select: str, where: str) -> str:
    return f"WITH {rank()}, {_SMALL} SELECT {select} FROM few a JOIN few b ON a.row_id < b.row_id WHERE {where}"


@query(_few_sql("a.row_id AS a, b.row_id AS b", f"{cheb('a.u', 'b.u')} >= 4 AND {cheb('list_transform(a.u, lambda x: 7 - x)', 'b.u')} >= 4"))
def j5_symmetric_pairs(spark, sf_dir):
    return R.symmetric_pairs(_few(spark, sf_dir), 4, lambda u: C.complement(u, N))


@query(_few_sql("a.row_id AS a, b.row_id AS b", "len(list_filter(range(1, 9), lambda i: a.u[i] > 2 AND b.u[i] > 2 AND abs(a.u[i] - b.u[i]) >= 3)) = 0"))
def j6_masked_pairs(spark, sf_dir):
    hidden = _few(spark, sf_dir).select("row_id", F.transform("u", lambda x: F.when(x > 2, x).otherwise(-1)).alias("u"))
    return R.masked_pairs(hidden, D)


@query(f"WITH {rank()}, five AS (SELECT u AS w FROM pa WHERE row_id = 5), near AS (SELECT row_id, {cheb('u', 'w')} < 3 AS before, {cheb('u', '[0, 1, 2, 3, 4, 5, 6, 7]')} < 3 AS after FROM pa, five WHERE row_id <> 5) SELECT count(*) FILTER (before AND NOT after) AS gain, count(*) FILTER (NOT before AND after) AS loss FROM near")
def j7_probe(spark, sf_dir):
    array = rank_array(spark, sf_dir)
    return R.probe(array, R.conflicts(array, D), 5, list(range(N)), D)


@query(f"WITH {rank()}, pa2 AS (SELECT row_id, CASE WHEN row_id = 5 THEN [0, 1, 2, 3, 4, 5, 6, 7] ELSE u END AS u FROM pa) SELECT a.row_id AS a, b.row_id AS b FROM pa2 a JOIN pa2 b ON a.row_id < b.row_id WHERE {cheb('a.u', 'b.u')} < 3")
def h13_replaced(spark, sf_dir):
    """Conflicts after a replacement, maintained from those before; the SQL finds them anew."""
    array = rank_array(spark, sf_dir)
    return R.replaced(R.conflicts(array, D), array, 5, list(range(N)), D)


@query(f"WITH {rank()}, {degree_sql(D)} SELECT row_id, {txt('u')} AS u FROM pa WHERE row_id IN (SELECT row_id FROM deg WHERE degree = 0)")
def j9_r4_happy(spark, sf_dir):
    return R.happy(rank_array(spark, sf_dir), D).select("row_id", C.text("u").alias("u"))


@query(f"WITH RECURSIVE {templates_sql(7, 3)} SELECT a.row_id AS a, b.row_id AS b FROM templates a JOIN templates b ON a.row_id < b.row_id WHERE list_transform(a.t, lambda x: x = 0) = list_transform(b.t, lambda x: x = 0)")
def j11_same_lows(spark, sf_dir):
    return R.same_lows(G.templates(spark, 7, 3))


@query(f"WITH RECURSIVE {templates_sql(7, 3)}, p AS (SELECT a.row_id AS a, b.row_id AS b, len(list_filter(range(1, 8), lambda i: a.t[i] <> b.t[i]))::INT AS n_cols FROM templates a JOIN templates b ON a.row_id <> b.row_id WHERE {cheb('a.t', 'b.t')} <= 1) SELECT a AS row_id, n_cols, count(*) AS n_foes FROM p GROUP BY a, n_cols")
def j12_foe_counts(spark, sf_dir):
    return R.foe_counts(G.templates(spark, 7, 3))


@query(f"WITH {rank()} SELECT a.row_id, c.col::INT AS col, count(*) AS n_rows FROM pa a, pa b, (SELECT unnest(range(0, 8)) AS col) c WHERE abs(a.u[col + 1] - b.u[col + 1]) >= 5 GROUP BY a.row_id, c.col")
def j13_separated_by_column(spark, sf_dir):
    return R.separated_by_column(rank_array(spark, sf_dir), 5)


@query(f"WITH {rank()}, {_SMALL}, p AS (SELECT a.row_id, len(list_filter(range(1, 9), lambda i: abs(a.u[i] - b.u[i]) >= 5)) AS n FROM few a JOIN few b ON a.row_id <> b.row_id) SELECT row_id, count(*) FILTER (n = 0) AS never, count(*) FILTER (n = 1) AS once, count(*) FILTER (n > 1) AS more FROM p GROUP BY row_id")
def j14_row_summary(spark, sf_dir):
    return R.row_summary(_few(spark, sf_dir), 5)


@query(_few_sql("a.row_id AS a, b.row_id AS b, len(list_filter(range(1, 9), lambda i: (a.u[i] = 0 AND b.u[i] = 2) OR (a.u[i] = 2 AND b.u[i] = 0)))::INT AS n", "true"))
def j15_two_meetings(spark, sf_dir):
    return R.two_meetings(_few(spark, sf_dir))


@query(f"WITH {rank()}, {degree_sql(D)} SELECT count(*) AS n_rows, (sum(degree) // 2)::BIGINT AS conflicts, sum(degree)::BIGINT AS score, count(*) FILTER (degree = 0) AS coverage, sum(degree) = 0 AS verified FROM deg")
def a1_a2_a4_score(spark, sf_dir):
    return R.score(rank_array(spark, sf_dir), D)


@query(f"WITH {rank()}, {degree_sql(D)} SELECT row_id, degree FROM deg")
def a3_conflict_degrees(spark, sf_dir):
    return R.degrees(rank_array(spark, sf_dir), D)


@query(_few_sql(f"min({cheb('a.u', 'b.u')}) AS distance", "true"))
def a5_least_distance(spark, sf_dir):
    return R.least_distance(_few(spark, sf_dir))


@query(f"WITH {rank()}, {_SMALL}, p AS (SELECT a.row_id AS a, b.row_id AS b, {cheb('a.u', 'b.u')} AS distance FROM few a JOIN few b ON a.row_id < b.row_id) SELECT *, count(*) OVER () AS n_pairs FROM p WHERE distance = (SELECT min(distance) FROM p)")
def a6_nearest_pairs(spark, sf_dir):
    return R.nearest_pairs(_few(spark, sf_dir))


@query(f"WITH {rank()}, {degree_sql(D)} SELECT degree, count(*) AS n_rows FROM deg GROUP BY degree")
def a7_degree_histogram(spark, sf_dir):
    return R.degree_histogram(rank_array(spark, sf_dir), D)


@query(f"WITH {rank()}, {degree_sql(D)} SELECT t.degree, count(deg.row_id) AS n_rows FROM (SELECT unnest(range(0, (SELECT max(degree) + 1 FROM deg))) AS degree) t LEFT JOIN deg ON t.degree = deg.degree GROUP BY t.degree")
def a7_dense_histogram(spark, sf_dir):
    return R.dense_histogram(rank_array(spark, sf_dir), D)


@query(f"WITH {rank()}, {_SMALL} SELECT {cheb('a.u', 'b.u')} AS distance, count(*) AS n_pairs FROM few a JOIN few b ON a.row_id < b.row_id GROUP BY 1")
def a7_distance_histogram(spark, sf_dir):
    return R.distance_histogram(_few(spark, sf_dir))


@query(f"WITH {rank()}, {_SMALL}, p AS (SELECT {cheb('a.u', 'b.u')} >= 4 AS s FROM few a JOIN few b ON a.row_id < b.row_id) SELECT count(*) FILTER (s) AS good, count(*) FILTER (NOT s) AS bad, count(*) FILTER (s) / count(*) AS share FROM p")
def a8_good_and_bad(spark, sf_dir):
    return R.good_and_bad(_few(spark, sf_dir), 4)


@query(f"WITH {rank()}, {_SMALL}, p AS (SELECT list_filter(range(0, 8), lambda i: abs(a.u[i + 1] - b.u[i + 1]) >= 5) AS cols FROM few a JOIN few b ON a.row_id < b.row_id), e AS (SELECT unnest(cols)::INT AS col, len(cols)::INT AS times FROM p) SELECT col, times, count(*) AS n_pairs FROM e GROUP BY col, times")
def a9_separating_histogram(spark, sf_dir):
    return R.separating_histogram(_few(spark, sf_dir), 5)


@query(f"WITH {rank(6)} SELECT least({txt('u')}, {txt('list_transform(u, lambda x: 5 - x)')}) AS key, count(*) AS n_rows FROM pa GROUP BY 1")
def a14_classes_under(spark, sf_dir):
    return R.classes_under(rank_array(spark, sf_dir, 6), lambda u: C.complement(u, 6))


@query(f"WITH {rank()}, log AS (SELECT row_id % 3 AS chain, row_id AS it, u[1] * 100 + u[2] AS score FROM pa) SELECT chain, it, score::INT AS score, min(score) OVER (PARTITION BY chain ORDER BY it)::INT AS best FROM log")
def a15_running_best(spark, sf_dir):
    log = rank_array(spark, sf_dir).select((F.col("row_id") % 3).alias("chain"), F.col("row_id").alias("it"), (F.get("u", F.lit(0)) * 100 + F.get("u", F.lit(1))).alias("score"))
    return R.running_best(log)


@query(f"WITH {rank()}, c AS (SELECT unnest(range(0, 8))::INT AS col) SELECT col, {txt('list_sort(list_distinct(list(pa.u[col + 1])))')} AS symbols FROM pa, c GROUP BY col")
def a16_column_symbols(spark, sf_dir):
    return R.column_symbols(rank_array(spark, sf_dir))


_SEEN = "seen AS (SELECT x, min(k) AS k FROM (SELECT a AS x, [a, b, 0] AS k FROM pairs UNION ALL SELECT b, [a, b, 1] FROM pairs) GROUP BY x)"


@query(f"WITH {rank()}, {degree_sql(D)}, {_SEEN} SELECT row_id, degree FROM deg JOIN seen ON row_id = x ORDER BY degree DESC, k LIMIT 1")
def w1_most_conflicted(spark, sf_dir):
    return R.most_conflicted(rank_array(spark, sf_dir), D)


@query(f"WITH {rank()}, {degree_sql(D)} SELECT row_id, degree, row_number() OVER (ORDER BY degree, row_id)::INT AS rank FROM deg")
def w2_ranked(spark, sf_dir):
    return R.ranked(rank_array(spark, sf_dir), D, worst_first=False)


@query(f"WITH {rank()}, {degree_sql(D)} SELECT row_id, (SELECT count(*) FROM pa) - 1 - degree AS separated FROM deg ORDER BY separated DESC, row_id DESC LIMIT 1")
def w3_most_separated(spark, sf_dir):
    return R.most_separated(rank_array(spark, sf_dir), D)


@query(f"WITH {rank()}, {degree_sql(D)} SELECT row_id, degree, row_number() OVER (ORDER BY degree DESC, row_id DESC)::INT AS rank FROM deg")
def w4_ranked(spark, sf_dir):
    return R.ranked(rank_array(spark, sf_dir), D)


@query(f"WITH {rank()}, m AS (SELECT row_id % 7 AS row_id, {txt('u')} AS u, u[1] AS gain, u[2] AS loss FROM pa), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY gain - loss DESC, u) AS nth FROM m) SELECT row_id, u, gain, loss FROM r WHERE nth = 1")
def w6_best_candidate(spark, sf_dir):
    moves = rank_array(spark, sf_dir).select((F.col("row_id") % 7).alias("row_id"), C.text("u").alias("u"), F.get("u", F.lit(0)).alias("gain"), F.get("u", F.lit(1)).alias("loss"))
    return R.best_candidate(moves)


@query(f"WITH {rank()}, k AS (SELECT row_id, u[1] // 4 AS k FROM pa), m AS (SELECT row_id, coalesce((k <> lag(k) OVER (ORDER BY row_id))::INT, 0) AS new FROM k) SELECT row_id, sum(new) OVER (ORDER BY row_id)::BIGINT AS block FROM m")
def w7_runs(spark, sf_dir):
    return R.runs(rank_array(spark, sf_dir), F.floor(F.get("u", F.lit(0)) / 4))


@query("SELECT vec_id AS row_id, vec_id // 10 AS block FROM embeddings")
def w8_blocks_of_rows(spark, sf_dir):
    return R.runs(rank_array(spark, sf_dir), F.lit(0), 10)


@query(f"WITH {rank()} SELECT row_id, {txt('u')} AS u FROM pa WHERE row_id IN (SELECT row_id FROM pa ORDER BY row_id LIMIT 15) OR row_id IN (SELECT row_id FROM pa ORDER BY row_id DESC LIMIT 15)")
def w9_ends(spark, sf_dir):
    return R.ends(rank_array(spark, sf_dir)).select("row_id", C.text("u").alias("u"))


@query(f"WITH {rank()}, n AS (SELECT max(row_id) + 1 AS n FROM pa) SELECT row_id, {txt('u')} AS u FROM pa UNION ALL SELECT row_id + n, {txt('list_transform(u, lambda x: 7 - x)')} FROM pa, n")
def x1_with_images(spark, sf_dir):
    return R.with_images(rank_array(spark, sf_dir), lambda u: C.complement(u, N)).select("row_id", C.text("u").alias("u"))


@query(f"WITH {rank()}, {pairs(2)} SELECT row_id, {txt('u')} AS u FROM pa WHERE row_id NOT IN (SELECT b FROM pairs)")
def x2_without(spark, sf_dir):
    """Rows but for the later one of each conflict."""
    array = rank_array(spark, sf_dir)
    return R.without(array, R.conflicts(array, 2).select(F.col("b").alias("row_id"))).select("row_id", C.text("u").alias("u"))


@query(f"WITH {rank()} SELECT row_id, {txt('list_sort(list_intersect(u[1:4], u[3:6]))')} AS both, {txt('list_sort(list_filter(u[1:6], lambda x: NOT (list_contains(u[1:4], x) AND list_contains(u[3:6], x))))')} AS one FROM pa")
def x3_position_sets(spark, sf_dir):
    p, q = F.slice("u", 1, 4), F.slice("u", 3, 4)
    one = F.array_union(F.array_except(p, q), F.array_except(q, p))
    return rank_array(spark, sf_dir).select("row_id", C.text(F.array_sort(F.array_intersect(p, q))).alias("both"), C.text(F.array_sort(one)).alias("one"))


@query(f"WITH {rank(4)} SELECT DISTINCT {txt('u')} AS u FROM pa")
def x4_distinct_rows(spark, sf_dir):
    return R.distinct_rows(rank_array(spark, sf_dir, 4)).select(C.text("u").alias("u"))


@query(f"WITH {rank()}, {pairs(2)} SELECT row_id, {txt('u')} AS row, coalesce((SELECT array_to_string(list(x ORDER BY x), ',') FROM (SELECT b AS x FROM pairs WHERE a = row_id UNION ALL SELECT a FROM pairs WHERE b = row_id)), '') AS near FROM pa")
def k12_report(spark, sf_dir):
    array = rank_array(spark, sf_dir)
    return text.report(array, R.conflicts(array, 2))


# -- graphs


def _components_sql(d):
    return f"""{pairs(d)}, reach(row_id, x) AS (SELECT row_id, row_id FROM pa UNION SELECT r.row_id, e.y FROM reach r JOIN (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs) e ON r.x = e.x),
 members AS (SELECT row_id, min(x) AS component FROM reach GROUP BY row_id)"""


@query(f"WITH RECURSIVE {rank()}, {_components_sql(2)} SELECT row_id, component FROM members")
def r1_r2_components(spark, sf_dir):
    array = rank_array(spark, sf_dir)
    return graph.array_components(array, R.conflicts(array, 2))


@query(f"WITH RECURSIVE {rank()}, {_components_sql(2)} SELECT a.row_id AS a, b.row_id AS b, ma.component = mb.component AS together FROM pa a JOIN pa b ON b.row_id = a.row_id + 1 JOIN members ma ON ma.row_id = a.row_id JOIN members mb ON mb.row_id = b.row_id")
def p14_connected(spark, sf_dir):
    array = rank_array(spark, sf_dir)
    members = graph.array_components(array, R.conflicts(array, 2))
    return graph.connected(members, array.select(F.col("row_id").alias("a"), (F.col("row_id") + 1).alias("b")))


@query(f"WITH RECURSIVE {rank()}, {_components_sql(2)} SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) AS rank FROM members GROUP BY component")
def w5_components_by_size(spark, sf_dir):
    array = rank_array(spark, sf_dir)
    return graph.by_size(graph.array_components(array, R.conflicts(array, 2)))


@query(f"""WITH RECURSIVE {combos(6, 3)}, pa AS (SELECT id AS row_id, {fill('range(3, 6)', '[0, 1, 2]', 'ps')} AS u FROM combos), {_components_sql(3)}
 SELECT a.row_id AS a, b.row_id AS b FROM pa a JOIN members ma ON a.row_id = ma.row_id, pa b JOIN members mb ON b.row_id = mb.row_id WHERE ma.component < mb.component AND {cheb('a.u', 'b.u')} >= 3""")
def j16_across_components(spark, sf_dir):
    array = G.lexicographic_array(spark, 6)
    return R.across(array, graph.array_components(array, R.conflicts(array, 3)), 3)


@query(f"WITH {rank()}, {pairs(D)} SELECT (SELECT count(*) FROM pairs) = 0 AS valid")
def p13_valid_block(spark, sf_dir):
    return R.valid_block(rank_array(spark, sf_dir), D)


@query(f"WITH RECURSIVE {rank()}, {_components_sql(2)} SELECT size, count(*) AS n_components FROM (SELECT component, count(*) AS size FROM members GROUP BY component) GROUP BY size")
def r2_component_sizes(spark, sf_dir):
    array = rank_array(spark, sf_dir)
    return graph.size_histogram(graph.array_components(array, R.conflicts(array, 2)))


@query(f"""WITH RECURSIVE {combos(6, 3)}, pa AS (SELECT id AS row_id, {fill('range(3, 6)', '[0, 1, 2]', 'ps')} AS u FROM combos), {_components_sql(3)},
 cells AS (SELECT component, i, min(u[i]) <> max(u[i]) AS mixed, count(*) AS size FROM pa JOIN members USING (row_id), (SELECT unnest(range(1, 7)) AS i) GROUP BY component, i),
 ends AS (SELECT component, size, min(i) FILTER (mixed) AS first, max(i) FILTER (mixed) AS last FROM cells GROUP BY component, size),
 heads AS (SELECT component, arg_min(u, row_id) AS u FROM pa JOIN members USING (row_id) GROUP BY component)
 SELECT component, size, {txt('u[1:greatest(coalesce(first - 1, 6), 1)]')} AS pre, {txt('u[7 - greatest(coalesce(6 - last, 6), 1):6]')} AS suf FROM ends JOIN heads USING (component)""")
def a12_common_ends(spark, sf_dir):
    array = G.lexicographic_array(spark, 6)
    found = graph.common_ends(array, graph.array_components(array, R.conflicts(array, 3)))
    return found.select("component", "size", C.text("pre").alias("pre"), C.text("suf").alias("suf"))


@query(f"WITH RECURSIVE {rank()}, {_components_sql(2)}, ends AS (SELECT a AS row_id FROM pairs UNION SELECT b FROM pairs) SELECT row_id AS node FROM pa WHERE row_id NOT IN (SELECT row_id FROM ends)")
def r10_missed(spark, sf_dir):
    """With both ends of all edges chosen, the rows without an edge are missed."""
    array = rank_array(spark, sf_dir)
    edges = R.conflicts(array, 2)
    chosen = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return graph.missed(array.select(F.col("row_id").alias("node")), edges, chosen)


def _solved(solve):
    def run(spark, sf_dir):
        return graph.per_component(R.conflicts(rank_array(spark, sf_dir), 2), solve)

    return run


def _by_classes(solve, beyond):
    return lambda spark, sf_dir: classes.searched(rank_array(spark, sf_dir), 2, solve, beyond)


query(name="r6_least_cover")(_solved(graph.least_cover))
query(f"WITH RECURSIVE {rank()}, {pairs(2)}, listed AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS k FROM pairs), step(k, used) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT step.k + 1, CASE WHEN list_contains(used, a) OR list_contains(used, b) THEN used ELSE used || [a, b] END FROM step JOIN listed ON listed.k = step.k) SELECT unnest(used) AS node FROM (SELECT used FROM step ORDER BY k DESC LIMIT 1)", "r7_matching_cover")(_by_classes(classes.matching_cover, rounds.matching_cover))

def _greedy_sql(least: int) -> str:
    return f"""WITH RECURSIVE {rank()}, {pairs(2)}, ends AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs), near AS (SELECT x, list_append(list(y), x) AS ys FROM ends GROUP BY x),
 step(n, todo, node) AS (SELECT 0, (SELECT list(x) FROM near), NULL::BIGINT UNION ALL SELECT n + 1, list_filter(step.todo, lambda z: NOT list_contains(w.ys, z)), w.x FROM step, LATERAL (
  SELECT x, ys FROM near WHERE len(list_intersect(ys, step.todo)) >= {least} ORDER BY len(list_intersect(ys, step.todo)) DESC, x LIMIT 1) w)
 SELECT node FROM step WHERE node IS NOT NULL"""


query(_greedy_sql(1), "r8_dominating")(_by_classes(classes.dominating, rounds.dominating))
query(_greedy_sql(3), "r9_partly_dominating")(_by_classes(lambda held: classes.dominating(held, 3), lambda e: rounds.dominating(e, 3)))
query(f"""WITH RECURSIVE {rank()}, {pairs(2)}, ends AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs), near AS (SELECT x, list(y) AS ys, row_number() OVER (ORDER BY x) - 1 AS k FROM ends GROUP BY x),
 step(k, cover, node) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT UNION ALL SELECT step.k + 1, CASE WHEN len(list_intersect(ys, cover)) = 0 THEN cover || ys || [x] ELSE cover END, CASE WHEN len(list_intersect(ys, cover)) = 0 THEN x END FROM step JOIN near ON near.k = step.k)
 SELECT node FROM step WHERE node IS NOT NULL""", "r8_kings")(_by_classes(classes.kings, rounds.kings))


_REMOVE = f"""WITH RECURSIVE {rank()}, {pairs(D)}, {_SEEN}, ends AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
 step(n, gone) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT n + 1, list_append(gone, w.x) FROM step, LATERAL (
  SELECT e.x FROM ends e JOIN seen ON seen.x = e.x WHERE NOT list_contains(step.gone, e.x) AND NOT list_contains(step.gone, e.y) GROUP BY e.x, seen.k ORDER BY count(*) DESC, seen.k LIMIT 1) w)
 SELECT row_id, {txt('u')} AS u FROM pa WHERE NOT list_contains((SELECT gone FROM step ORDER BY n DESC LIMIT 1), row_id)"""


@query(_REMOVE)
def r3_cleaned(spark, sf_dir):
    array = rank_array(spark, sf_dir)
    return classes.cleaned(array, D).select("row_id", C.text("u").alias("u"))


@query()
def r5_largest_independent(spark, sf_dir):
    array = rank_array(spark, sf_dir)
    return graph.largest_independent(array, R.conflicts(array, 2)).select("row_id", C.text("u").alias("u"))


@query(f"""WITH RECURSIVE {rank()}, {pairs(2)}, ends AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs), near AS (SELECT x, list(y ORDER BY y) AS ys FROM ends GROUP BY x),
 grown(members, fits) AS (SELECT [x], ys FROM near UNION ALL SELECT list_append(members, n.x), list_intersect(fits, n.ys) FROM grown, near n WHERE list_contains(fits, n.x) AND n.x > members[-1])
 SELECT {txt('members')} AS members, len(members)::INT AS size FROM grown WHERE len(fits) = 0""")
def r11_maximal_cliques(spark, sf_dir):
    return classes.maximal_cliques(rank_array(spark, sf_dir), 2).select(C.text("members").alias("members"), "size")


# -- searches: seeded, so that reruns agree


@query()
def h1_h4_chains(spark, sf_dir):
    found = search.chains(G.weave_high(G.ascending_array(spark, 3, 3), 6, 3), 3, [1, 2], steps=300, pick="degree")
    return found.select("seed", "score", "row_id", C.text("u").alias("u"))


@query()
def h8_lexicodes(spark, sf_dir):
    return search.lexicodes(spark, 5, 5, 2, [0, 1], probes=3).select("seed", "row_id", C.text("u").alias("u"))


@query()
def h16_construct(spark, sf_dir):
    return search.construct(spark, 6, 3).select("row_id", C.text("u").alias("u"))


@query(f"WITH RECURSIVE {perms(4)}, o AS (SELECT u, list_transform(u, lambda x: x // 2) AS t FROM full_perms), a AS (SELECT u FROM o WHERE t = [0, 0, 1, 1]), b AS (SELECT u FROM o WHERE t = [1, 0, 1, 0]), c AS (SELECT u FROM o WHERE t = [1, 1, 0, 0]) SELECT {txt('a.u')} || '|' || {txt('b.u')} || '|' || {txt('c.u')} AS rows FROM a, b, c WHERE {cheb('a.u', 'b.u')} >= 2 AND {cheb('a.u', 'c.u')} >= 2 AND {cheb('b.u', 'c.u')} >= 2")
def e2_e4_e7_frontier(spark, sf_dir):
    """All ways to fill three templates so that the rows are apart."""
    slots = None
    for k, t in enumerate(([0, 0, 1, 1], [1, 0, 1, 0], [1, 1, 0, 0])):
        rows = G.infills(spark, t, 2).select(F.lit(k).alias("slot"), "u")
        slots = rows if slots is None else slots.unionByName(rows)
    return search.frontier(slots, 2).select(F.array_join(F.transform("rows", C.text), "|").alias("rows"))


_SEEDS = f"{combos(4, 2)}, two(a, b) AS (VALUES (0, 1), (1, 0)), o AS (SELECT id, {fill('[l.a, l.b]', '[h.a + 2, h.b + 2]', 'ps')} AS u FROM combos, two l, two h WHERE id > 0 OR (l.a = 0 AND h.a = 0))"


@query(f"WITH {_SEEDS} SELECT {' || chr(124) || '.join(txt(f'o{k}.u') for k in range(6))} AS rows FROM {', '.join(f'o o{k}' for k in range(6))} WHERE {' AND '.join(f'o{k}.id = {k}' for k in range(6))} AND {' AND '.join(cheb(f'o{j}.u', f'o{k}.u') + ' >= 2' for k in range(6) for j in range(k))}")
def g27_seeds(spark, sf_dir):
    return search.seeds(spark, 4, 2).select(F.array_join(F.transform("rows", C.text), "|").alias("rows"))


@query(f"WITH {combos(4, 2)}, s0 AS (SELECT [1, 2] AS ps) SELECT '1,2|' || {txt('a.ps')} || '|' || {txt('b.ps')} || '|' || {txt('c.ps')} AS sets FROM s0, combos a, combos b, combos c WHERE NOT list_contains(a.ps, 1) AND NOT list_contains(b.ps, 2) AND NOT list_contains(c.ps, 3) AND (list_contains(a.ps, 0) OR list_contains(s0.ps, 1)) AND (list_contains(b.ps, 0) OR list_contains(s0.ps, 2)) AND (list_contains(b.ps, 1) OR list_contains(a.ps, 2)) AND (list_contains(c.ps, 0) OR list_contains(s0.ps, 3)) AND (list_contains(c.ps, 1) OR list_contains(a.ps, 3)) AND (list_contains(c.ps, 2) OR list_contains(b.ps, 3))")
def g26_e12_cover_designs(spark, sf_dir):
    return search.cover_designs(spark, 2).select(F.array_join(F.transform("sets", C.text), "|").alias("sets"))


@query(f"WITH {rank(4)}, two(x) AS (VALUES (0), (1)), o AS (SELECT [a.x + 2, b.x, c.x + 2, e.x] AS u FROM two a, two b, two c, two e), n AS (SELECT o.u, count(pa.row_id) AS n FROM o LEFT JOIN pa ON {cheb('o.u', 'pa.u')} >= 2 GROUP BY o.u) SELECT {txt('u')} AS u FROM n WHERE n = (SELECT max(n) FROM n)")
def g30_best_fillings(spark, sf_dir):
    return search.best_fillings(spark, 4, 2, [2, 0, 3, 1], rank_array(spark, sf_dir, 4)).select(C.text("u").alias("u"))


@query(f"WITH RECURSIVE {rank(3)}, {combos(6, 3)}, {perms(3)}, o AS (SELECT ps, row_id AS old, f.u AS highs, {fill('pa.u', 'list_transform(f.u, lambda x: x + 3)', 'ps')} AS u FROM pa, combos, full_perms f WHERE ps[1] = 0), k AS (SELECT ps, old, arg_min(u, highs) AS u FROM o WHERE {cheb('u', 'list_transform(u, lambda x: 5 - x)')} >= 3 GROUP BY ps, old) SELECT row_number() OVER (ORDER BY ps, old) - 1 AS row_id, {txt('u')} AS u FROM k")
def g7_weave_complementary(spark, sf_dir):
    return G.weave_complementary(rank_array(spark, sf_dir, 3), 6, 3).select("row_id", C.text("u").alias("u"))


def _checked(name: str, array, **options):
    """What chains return, found again by Spark: rows are permutations, and the score is that of their conflicts."""

    @query("SELECT s::BIGINT AS seed, 20::BIGINT AS n_rows, true AS valid, true AS scored FROM range(1, 3) t(s)", f"{name}_checked")
    def run(spark, sf_dir):
        found = staged(search.chains(array(spark), 3, [1, 2], steps=200, **options), "chains")
        out = None
        for seed in (1, 2):
            own = found.where(F.col("seed") == seed)
            told = own.agg(F.max("score").alias("told"), F.count("*").alias("n_rows"))
            bad = R.invalid_rows(own.select("row_id", "u")).agg((F.count("*") == 0).alias("valid"))
            again = R.score(own.select("row_id", "u"), 3).select("score")
            part = told.crossJoin(bad).crossJoin(again).select(F.lit(seed).cast("long").alias("seed"), "n_rows", "valid", (F.col("told") == F.col("score")).alias("scored"))  # a row each
            out = part if out is None else out.unionByName(part)
        return out


# -- more searches


def _table(spark, make, schema: str):
    """What one seeded search returns, made in a task."""

    def run(frames):
        import pandas as pd

        for _ in frames:
            yield pd.DataFrame(make(), columns=[c.split()[0] for c in schema.split(", ")])

    return spark.range(1).mapInPandas(run, schema)


def _start(spark):
    return G.weave_high(G.ascending_array(spark, 3, 3), 6, 3)


def _chain_query(name: str, **options):
    @query(name=name)
    def run(spark, sf_dir):
        return search.chains(_start(spark), 3, [1, 2], steps=200, **options).select("seed", "score", "row_id", C.text("u").alias("u"))


_chain_query("h2_basic_chains", kind="disturb", gentle=40, great=200)
_chain_query("h6_coverage_chains", objective="coverage", pick="degree")
_chain_query("h9_steepest_chains", candidates=8)
_chain_query("h10_symmetric_chains", image="bump_half")
_chain_query("h11_masked_chains", masked=True, move="subset")


for _name, _options in (
    ("h1_h4", {"pick": "degree"}), ("h2", {"kind": "disturb", "gentle": 40, "great": 200}), ("h6", {"objective": "coverage", "pick": "degree"}), ("h9", {"candidates": 8}),
):
    _checked(_name, lambda spark: G.weave_high(G.ascending_array(spark, 3, 3), 6, 3), **_options)


@query()
def h5_increment(spark, sf_dir):
    rows = [list(r["u"]) for r in G.ascending_array(spark, 6, 3).collect()]  # twenty rows

    def make():
        import numpy as np

        found = search.increment(np.array(rows[:12]), 3, rows[12:15], 1, steps=100)
        return [(k, ",".join(map(str, u))) for k, u in enumerate(found.tolist())]

    return _table(spark, make, "row_id long, u string")


@query()
def h7_tournament(spark, sf_dir):
    rows = [list(r["u"]) for r in G.random_array(spark, 6, 15, 3).orderBy("row_id").collect()]

    def make():
        import numpy as np

        return [(k, ",".join(map(str, u))) for k, u in enumerate(search.tournament(np.array(rows), 3, 1, rounds=10).tolist())]

    return _table(spark, make, "row_id long, u string")


_WEAVE = (
    f"{combos(4, 2)}, lex AS (SELECT id AS row_id, {fill('range(2, 4)', '[0, 1]', 'ps')} AS u FROM combos), {combos(6, 2).replace('combos AS', 'c2 AS')}, "
    f"woven AS (SELECT row_number() OVER (ORDER BY c2.id, l.row_id) - 1 AS row_id, {fill('l.u', '[4, 5]', 'c2.ps')} AS u, {fill('l.u', '[5, 4]', 'c2.ps')} AS v FROM lex l, c2)"
)
_FITS = "len(list_filter(kept, lambda w: list_max(list_transform(range(1, 7), lambda i: abs(w[i] - woven.{x}[i]))) < 3)) = 0"
_KEPT = "SELECT i - 1 AS row_id, array_to_string(kept[i], ',') AS u FROM (SELECT kept, unnest(range(1, len(kept) + 1)) AS i FROM (SELECT kept FROM step ORDER BY nth DESC LIMIT 1))"


@query(f"WITH RECURSIVE {_WEAVE}, step(nth, kept) AS (SELECT 0::BIGINT, []::INT[][] UNION ALL SELECT nth + 1, CASE WHEN {_FITS.format(x='u')} THEN list_append(kept, woven.u::INT[]) ELSE kept END FROM step JOIN woven ON woven.row_id = nth) {_KEPT}")
def g10_greedy_weave(spark, sf_dir):
    """Rows of a weave that are apart from all kept before them."""
    rows = [list(r["u"]) for r in G.weave_high(G.lexicographic_array(spark, 4), 6, 2).orderBy("row_id").collect()]  # ninety rows
    return _table(spark, lambda: [(k, ",".join(map(str, u))) for k, u in enumerate(search.greedy_keep(rows, 3))], "row_id long, u string")


@query(f"WITH RECURSIVE {_WEAVE}, step(nth, kept) AS (SELECT 0::BIGINT, []::INT[][] UNION ALL SELECT nth + 1, CASE WHEN {_FITS.format(x='u')} THEN list_append(kept, woven.u::INT[]) WHEN {_FITS.format(x='v')} THEN list_append(kept, woven.v::INT[]) ELSE kept END FROM step JOIN woven ON woven.row_id = nth) {_KEPT}")
def g11_hybrid_weave(spark, sf_dir):
    """As g10, with every order of the high symbols tried for a row."""
    rows = [list(r["u"]) for r in G.weave_high(G.lexicographic_array(spark, 4), 6, 2).orderBy("row_id").collect()]
    return _table(spark, lambda: [(k, ",".join(map(str, u))) for k, u in enumerate(search.greedy_keep(rows, 3, orders=search.high_orders(6, 2)))], "row_id long, u string")


@query(f"""WITH RECURSIVE {perms(4)}, numbered AS (SELECT row_number() OVER (ORDER BY u) - 1 AS k, u FROM full_perms),
 subs AS (SELECT k, [u[i], u[j], u[l]] AS s FROM numbered, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(1, 5)) AS j), (SELECT unnest(range(1, 5)) AS l) WHERE i < j AND j < l),
 close AS (SELECT DISTINCT a.k AS x, b.k AS y FROM subs a JOIN subs b ON a.s = b.s), near AS (SELECT x AS k, list(y) AS ys FROM close GROUP BY x),
 grown(taken, free) AS (SELECT []::BIGINT[], (SELECT list(k ORDER BY k) FROM numbered) UNION ALL
  SELECT list_append(taken, n.k), list_filter(free, lambda f: f > n.k AND NOT list_contains(n.ys, f)) FROM grown, near n WHERE list_contains(free, n.k))
 SELECT i - 1 AS row_id, array_to_string(u, ',') AS u FROM (SELECT taken, unnest(range(1, len(taken) + 1)) AS i FROM (SELECT taken FROM grown ORDER BY len(taken) DESC, taken LIMIT 1)) JOIN numbered ON k = taken[i]""")
def e1_largest_ulam_array(spark, sf_dir):
    """A largest set of permutations of four symbols at Ulam distance two or more."""

    def make():
        from itertools import combinations, permutations

        def far(u, v):  # no common subsequence of three
            return not any([x for x in v if x in s] == list(s) for s in combinations(u, 3))

        found = search.largest([list(u) for u in permutations(range(4))], far, budget=20_000)
        return [(k, ",".join(map(str, u))) for k, u in enumerate(found)]

    return _table(spark, make, "row_id long, u string")


def _fillings():
    """Slots: three position sets of the high symbols, each with all orders of them; lows ascend."""
    from itertools import permutations

    out = []
    for ps in ((0, 1), (1, 3), (2, 3)):
        options = []
        for highs in permutations((2, 3)):
            lows, at = iter((0, 1)), dict(zip(ps, highs, strict=True))
            options.append([at[k] if k in at else next(lows) for k in range(4)])
        out.append(options)
    return out


_SLOTS = "o AS (SELECT * FROM (VALUES (0, 0, [2, 3, 0, 1]), (0, 1, [3, 2, 0, 1]), (1, 0, [0, 2, 1, 3]), (1, 1, [0, 3, 1, 2]), (2, 0, [0, 1, 2, 3]), (2, 1, [0, 1, 3, 2])) t(slot, k, u))"


def _chosen_sql(d: int, order: str) -> str:
    apart = " AND ".join(f"{cheb(p + '.u', q + '.u')} >= {d}" for p, q in (("a", "b"), ("a", "c"), ("b", "c")))
    return f"WITH {_SLOTS}, best AS (SELECT [a.u, b.u, c.u] AS us FROM o a, o b, o c WHERE a.slot = 0 AND b.slot = 1 AND c.slot = 2 AND {apart} ORDER BY {order} a.k, b.k, c.k LIMIT 1) SELECT i::BIGINT - 1 AS slot, array_to_string(us[i], ',') AS u FROM best, (SELECT unnest(range(1, 4)) AS i)"


@query(_chosen_sql(2, ""))
def e3_fill_highs(spark, sf_dir):
    return _table(spark, lambda: [(k, ",".join(map(str, _fillings()[k][j]))) for k, j in search.choose(_fillings(), 2) or []], "slot long, u string")


@query(_chosen_sql(1, "abs(a.u[1] - b.u[1]) + abs(a.u[1] - c.u[1]) + abs(b.u[1] - c.u[1]),"))
def e10_best_filling(spark, sf_dir):
    value = lambda rows: -sum(abs(u[0] - v[0]) for u in rows for v in rows)
    return _table(spark, lambda: [(k, ",".join(map(str, _fillings()[k][j]))) for k, j in search.choose(_fillings(), 1, value=value) or []], "slot long, u string")


@query(f"""WITH RECURSIVE {_SLOTS}, offers AS (SELECT slot, k, u FROM o UNION ALL SELECT DISTINCT slot, 9, [0, 0, 0, 0] FROM o), w(slot, slots, us, path) AS (SELECT 0, []::INT[], []::INT[][], []::INT[] UNION ALL
  SELECT w.slot + 1, CASE WHEN f.k = 9 THEN slots ELSE list_append(slots, f.slot) END, CASE WHEN f.k = 9 THEN us ELSE list_append(us, f.u) END, list_append(path, f.k) FROM w, offers f
  WHERE f.slot = w.slot AND (f.k = 9 OR len(list_filter(us, lambda t: list_max(list_transform(range(1, 5), lambda i: abs(t[i] - f.u[i]))) < 3)) = 0))
 SELECT slots[i]::BIGINT AS slot, array_to_string(us[i], ',') AS u FROM (SELECT slots, us, unnest(range(1, len(us) + 1)) AS i FROM (SELECT slots, us FROM w WHERE slot = 3 ORDER BY len(us) DESC, path LIMIT 1))""")
def e11_fullest_filling(spark, sf_dir):
    return _table(spark, lambda: [(k, ",".join(map(str, _fillings()[k][j]))) for k, j in search.choose(_fillings(), 3, skip=True) or []], "slot long, u string")


@query()
def f29_coverage_score(spark, sf_dir):
    """Sum of degrees less two to the number of rows without conflict, as digits."""
    deg = R.degrees(_few(spark, sf_dir), D).agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("total"), F.count_if(F.col("degree") == 0).alias("clean"))

    def run(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame({"score": [str(numbers.coverage_of(int(t), int(c))) for t, c in zip(frame["total"], frame["clean"], strict=True)]})

    return deg.mapInPandas(run, "score string")


# -- files: written to shared storage and read back


def _file(spark, rows, label="files"):
    """A text file of lines (id, value) in order."""
    path = shared_dir(spark, label)
    rows.coalesce(1).sortWithinPartitions("id").select("value").write.text(path)
    return path


_LOADED = f"WITH {rank(6)} SELECT row_id, {txt('u')} AS u FROM pa"


def _six(spark, sf_dir):
    return rank_array(spark, sf_dir, 6)


@query(_LOADED)
def s1_k1_strict_file(spark, sf_dir):
    path = shared_dir(spark, "array")
    text.dump(_six(spark, sf_dir), path)
    return text.load(spark, path).select("row_id", C.text("u").alias("u"))


@query(_LOADED)
def s2_lenient_file(spark, sf_dir):
    rows = _six(spark, sf_dir).select(F.col("row_id").alias("id"), F.concat(F.lit("["), F.array_join(F.col("u").cast("array<string>"), ", "), F.lit("] # row")).alias("value"))
    end = spark.createDataFrame([(1 << 40, "% the end"), ((1 << 40) + 1, "1 2 3")], "id long, value string")
    return text.load(spark, _file(spark, rows.unionByName(end)), "lenient").select("row_id", C.text("u").alias("u"))


@query(_LOADED)
def s3_s4_digits_file(spark, sf_dir):
    rows = _six(spark, sf_dir).select((F.col("row_id") * 2).alias("id"), F.concat(F.lit("["), F.array_join(F.col("u").cast("array<string>"), ", "), F.lit("]")).alias("value"))
    marks = rows.select((F.col("id") + 1).alias("id"), F.lit("---").alias("value"))
    return text.load(spark, _file(spark, rows.unionByName(marks)), "nonempty").select("row_id", C.text("u").alias("u"))


@query(f"WITH {rank(6)} SELECT row_id // 10 AS block_id, row_id % 10 AS row_id, {txt('u')} AS u FROM pa")
def s5_block_file(spark, sf_dir):
    rows = _six(spark, sf_dir).select((F.col("row_id") * 2).alias("id"), F.array_join(F.col("u").cast("array<string>"), ", ").alias("value"))
    marks = rows.where("id % 20 = 18").select((F.col("id") + 1).alias("id"), F.lit("^ 0 ^").alias("value"))
    found = text.load_blocks(spark, _file(spark, rows.unionByName(marks)))
    return found.select(F.col("block_id").cast("long").alias("block_id"), "row_id", C.text("u").alias("u"))


@query("SELECT 12::BIGINT AS score")
def s6_k2_scored_file(spark, sf_dir):
    path = shared_dir(spark, "scored")
    text.dump_scored(_six(spark, sf_dir), path, 12)
    return text.headers(spark, path).select("score")


@query(f"WITH {rank()}, {pairs(2)} SELECT a, b FROM pairs")
def s9_k6_state_file(spark, sf_dir):
    path = shared_dir(spark, "state")
    edges = R.conflicts(rank_array(spark, sf_dir), 2).select("a", "b")
    text.dump_state(edges, path)
    return spark.read.schema("a long, near array<long>").json(path).select("a", F.explode("near").alias("b"))


@query(f"WITH {rank()}, {_SMALL} SELECT a.row_id AS a, b.row_id AS b FROM few a JOIN few b ON a.row_id <> b.row_id WHERE {cheb('a.u', 'b.u')} < 3")
def s10_k5_bit_file(spark, sf_dir):
    few = _few(spark, sf_dir)
    edges = R.both_ways(R.conflicts(few, D).select("a", "b"))
    rows = few.join(edges.groupBy("a").agg(F.collect_set("b").alias("near")), F.col("row_id") == F.col("a"), "left")
    rows = rows.crossJoin(F.broadcast(few.agg(F.max("row_id").alias("last"))))  # one number
    path = shared_dir(spark, "bits")
    text.dump_bits(rows.select(F.col("row_id").alias("id"), "near", "last"), path)
    return text.load_bits(spark, path)


@query("SELECT (x % 7)::INT AS k, x::INT AS n, (x - 2 * (x % 7) + 1)::INT AS d, x / 4.0::DOUBLE AS bound FROM range(20, 60) t(x)")
def k10_m17_bound_file(spark, sf_dir):
    path = shared_dir(spark, "bounds")
    x = F.col("id").cast("int")
    text.dump_bounds(spark.range(20, 60).select((x % 7).alias("k"), x.alias("n"), (x - 2 * (x % 7) + 1).alias("d"), (x / 4).alias("bound")), path)
    return text.load_bounds(spark, path)


@query("SELECT row_id::BIGINT AS row_id, u FROM (VALUES (0, 'L,6,H'), (1, '7,L,H')) t(row_id, u)")
def s11_literals(spark, sf_dir):
    return text.literals(spark, [["L", 6, "H"], [7, "L", "H"]]).select("row_id", C.text("u").alias("u"))


@query("SELECT (vec_id % 5 + 4)::INT AS n, (vec_id % 3 + 1)::INT AS d, min(vec_id * 7 % 101)::BIGINT AS score FROM embeddings GROUP BY 1, 2")
def t1_best_of_files(spark, sf_dir):
    """What the watcher keeps, over a table of files."""
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id")
    n, d = F.col("vec_id") % 5 + 4, F.col("vec_id") % 3 + 1
    files = ids.select(F.concat_ws("_", F.lit("x/pa"), n, F.lit("choose"), d, F.lit("v.txt")).alias("file"), F.concat(F.lit("# score: "), (F.col("vec_id") * 7 % 101).cast("string"), F.lit("\n0 1 2\n")).alias("value"))
    return watch.best(watch.scored(files)).select("n", "d", "score")

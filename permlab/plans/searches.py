"""Queries of searches over arrays from the tables, and their SQL. Registered with those of registry.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from permlab.functions import columns as C
from permlab.operators import blocks, choose, compatible, complete, covering, graph, lazy, model, moves, search
from permlab.operators import generate as G
from permlab.operators import relations as R
from permlab.plans.fixtures import rank_array
from permlab.plans.registry import cheb, combos, pairs, query, rank, txt
from permlab.sources import text
from permlab.sources.storage import shared_dir, staged

# -- arrays of which groups and some symbols are known: three rows of the table each


def puzzles(spark, sf_dir, known: int):
    """puzzle, row, t, given: each three rows in a row, of which the groups and the first `known` symbols are told."""
    rows = rank_array(spark, sf_dir, 6).select(F.floor(F.col("row_id") / 3).alias("puzzle"), (F.col("row_id") % 3).cast("int").alias("row"), C.groups("u", 3).alias("t"), F.transform("u", lambda x, i: F.when(i < known, x)).alias("given"))
    whole = rows.groupBy("puzzle").count().where("count = 3").select("puzzle")
    return rows.join(whole, "puzzle", "left_semi")


def _puzzle_sql(known: int) -> str:
    """Every way to fill three rows, by listing all permutations."""
    perms = "perms(u) AS (SELECT []::INT[] UNION ALL SELECT list_append(u, x::INT) FROM perms, (SELECT unnest(range(6)) AS x) WHERE len(u) < 6 AND NOT list_contains(u, x))"
    return f"""WITH RECURSIVE {rank(6)}, {perms},
 fits AS (SELECT row_id // 3 AS puzzle, row_id % 3 AS row, p.u FROM pa JOIN perms p ON len(p.u) = 6 AND list_transform(p.u, lambda x: x // 3) = list_transform(pa.u, lambda x: x // 3) AND p.u[1:{known}] = pa.u[1:{known}]),
 three AS (SELECT a.puzzle, {txt('a.u')} || '|' || {txt('b.u')} || '|' || {txt('c.u')} AS rows FROM fits a
  JOIN fits b ON a.puzzle = b.puzzle AND a.row = 0 AND b.row = 1 AND {cheb('a.u', 'b.u')} >= 3
  JOIN fits c ON a.puzzle = c.puzzle AND c.row = 2 AND {cheb('a.u', 'c.u')} >= 3 AND {cheb('b.u', 'c.u')} >= 3)"""


@query(_puzzle_sql(4) + " SELECT puzzle, rows FROM three")
def e8_completions(spark, sf_dir):
    rows = complete.completions(puzzles(spark, sf_dir, 4), 3)
    whole = rows.groupBy("puzzle", "state").agg(F.array_sort(F.collect_list(F.struct("row", C.text("u").alias("u")))).alias("r"))  # the rows of one puzzle
    return whole.select("puzzle", F.array_join(F.transform("r", lambda r: r["u"]), "|").alias("rows"))


@query(_puzzle_sql(0).replace("AND p.u[1:0] = pa.u[1:0]", "") + " SELECT p.puzzle, min(rows) AS rows FROM (SELECT puzzle FROM fits GROUP BY puzzle HAVING count(DISTINCT row) = 3) p LEFT JOIN three USING (puzzle) GROUP BY p.puzzle")
def e9_realised(spark, sf_dir):
    found = complete.realised(puzzles(spark, sf_dir, 0), 3)
    return found.select("puzzle", F.array_join(F.transform("rows", C.text), "|").alias("rows"))


# -- compatible seeds: two rows of the table each


def _seeds(spark, sf_dir):
    rows = rank_array(spark, sf_dir).select(F.floor(F.col("row_id") / 2).alias("seed"), (F.col("row_id") % 2).alias("nth"), "u")
    return compatible.whole_seeds(rows)


def _seed_sql(d: int) -> str:
    return f"""WITH {rank()}, seeds AS (SELECT a.row_id // 2 AS seed, a.u AS u, b.u AS v FROM pa a JOIN pa b ON a.row_id % 2 = 0 AND b.row_id = a.row_id + 1),
 good AS (SELECT p.seed AS a, q.seed AS b FROM seeds p JOIN seeds q ON p.seed < q.seed
  AND {cheb('p.u', 'q.u')} >= {d} AND {cheb('p.u', 'q.v')} >= {d} AND {cheb('p.v', 'q.u')} >= {d} AND {cheb('p.v', 'q.v')} >= {d})"""


@query(_seed_sql(6) + " SELECT a, b FROM good")
def e13_compatible_pairs(spark, sf_dir):
    return compatible.compatible_pairs(_seeds(spark, sf_dir), 6)


@query(_seed_sql(6) + " SELECT p.a AS a, p.b AS b, q.b AS c FROM good p JOIN good q ON p.b = q.a JOIN good r ON p.a = r.a AND q.b = r.b")
def e13_compatible_triples(spark, sf_dir):
    return compatible.compatible_triples(_seeds(spark, sf_dir), 6)


# -- the model of arrays: blocks of five rows of the table, one of them spoilt


def _blocks(spark, sf_dir):
    return rank_array(spark, sf_dir, 6).select(F.floor(F.col("row_id") / 5).alias("model"), (F.col("row_id") % 5).cast("int").alias("row"), "u")


_BLOCKS = f"WITH {rank(6)}, blocks AS (SELECT row_id // 5 AS model, (row_id % 5)::INT AS row, u, CASE WHEN row_id % 5 = 1 THEN list_transform(u, lambda x: CASE WHEN x = 5 THEN 0 ELSE x END) ELSE u END AS v FROM pa)"


@query(f"""{_BLOCKS}, cells AS (SELECT model, row, u, v, unnest(range(0, 6)) AS c FROM blocks),
 bad AS (SELECT model, 'group' AS kind, row AS one, c::INT AS other, 0 AS value FROM cells WHERE u[c + 1] // 3 <> v[c + 1] // 3
  UNION ALL SELECT model, 'symbol', row, c::INT, len(list_filter(v, lambda x: x = c)) FROM cells WHERE len(list_filter(v, lambda x: x = c)) <> 1
  UNION ALL SELECT a.model, 'apart', a.row, b.row, 0 FROM blocks a JOIN blocks b ON a.model = b.model AND a.row < b.row WHERE {cheb('a.v', 'b.v')} < 3)
 SELECT model, kind, one, other, value::BIGINT AS value FROM bad""")
def e14_broken(spark, sf_dir):
    """What a spoilt array breaks of the model that the sound one's groups make: in each block row 1 has its 5 replaced by 0."""
    blocks = _blocks(spark, sf_dir)
    grid = blocks.select("model", "row", C.groups("u", 3).alias("t"))
    spoilt = blocks.select("model", "row", F.when(F.col("row") == 1, F.transform("u", lambda x: F.when(x == 5, 0).otherwise(x))).otherwise(F.col("u")).alias("u"))
    return model.broken(model.terms(grid, 3), model.constraints(grid), spoilt)


@query(f"""{_BLOCKS}, sizes AS (SELECT model, count(*) AS k FROM blocks GROUP BY model),
 kinds AS (SELECT 'cell' AS kind, sum(k * 6) AS n_constraints, sum(k * 36) AS n_terms FROM sizes UNION ALL SELECT 'symbol', sum(k * 6), sum(k * 36) FROM sizes
  UNION ALL SELECT 'group', sum(k * 6), sum(k * 18) FROM sizes UNION ALL SELECT 'apart', sum(k * (k - 1) // 2), sum(k * (k - 1) // 2 * 6 * 12) FROM sizes)
 SELECT kind, n_constraints::BIGINT AS n_constraints, n_terms::BIGINT AS n_terms FROM kinds WHERE n_constraints > 0""")
def e14_model(spark, sf_dir):
    """Constraints and terms by kind."""
    grid = _blocks(spark, sf_dir).select("model", "row", C.groups("u", 3).alias("t"))
    many = model.terms(grid, 3).groupBy("kind").agg(F.count("*").alias("n_terms"))
    return model.constraints(grid).groupBy("kind").agg(F.count("*").alias("n_constraints")).join(many, "kind").select("kind", "n_constraints", "n_terms")


# -- conflicts on demand


def _lazily(spark, sf_dir):
    array, state = staged(rank_array(spark, sf_dir), "array"), lazy.Conflicts.new(spark, 3)
    state.ask(array, array.where("row_id % 8 = 0"))
    state.ask(array, array.where("row_id % 4 = 0"))  # half of these are known
    changed = array.where("row_id % 10 IN (3, 4)").select("row_id", C.complement("u", 8).alias("u"))
    array = state.replace(array, changed)
    state.ask(array, array.where("row_id % 4 = 1"))
    return state


_CHANGED = f"{rank()}, now AS (SELECT row_id, CASE WHEN row_id % 10 IN (3, 4) THEN list_transform(u, lambda x: 7 - x) ELSE u END AS u FROM pa)"


@query(f"WITH {_CHANGED} SELECT a.row_id AS a, b.row_id AS b FROM now a JOIN now b ON a.row_id < b.row_id AND (a.row_id % 4 < 2 OR b.row_id % 4 < 2) AND {cheb('a.u', 'b.u')} < 3")
def j8_h10_conflicts_on_demand(spark, sf_dir):
    """After two questions, a batch of replaced rows and another question: the conflicts of the rows that were asked for, as found anew."""
    return _lazily(spark, sf_dir).edges()


@query("""WITH ids AS (SELECT vec_id AS i FROM embeddings)
 SELECT 1::BIGINT AS version, 'ask' AS batch, count(*) AS rows, count(*) AS joined FROM ids WHERE i % 8 = 0
 UNION ALL SELECT 2, 'ask', count(*), count(*) FILTER (i % 8 <> 0) FROM ids WHERE i % 4 = 0
 UNION ALL SELECT 3, 'replace', count(*) FILTER (i % 10 IN (3, 4)), count(*) FILTER (i % 4 = 0) + count(*) FILTER (i % 4 = 0 AND i % 10 IN (3, 4)) FROM ids
 UNION ALL SELECT 4, 'ask', count(*), count(*) FROM ids WHERE i % 4 = 1""")
def j8_h10_log(spark, sf_dir):
    """How many rows each batch joined: only those that it made known, or the known ones with those that were replaced."""
    return _lazily(spark, sf_dir).log()


# -- orders of combinations


def _numbers(c: str, i: str) -> str:
    return f"(CASE WHEN {c} < {i} THEN 0 ELSE factorial({c}) // factorial({i}) // factorial({c} - {i}) END)"


@query(f"WITH {combos(9, 4)} SELECT ({' + '.join(f'{(-1) ** (4 - i)} * {_numbers(f'(ps[{i}] + 1)::INT', str(i))}' for i in range(1, 5))})::BIGINT AS id, {txt('ps')} AS ps FROM combos")
def g19_revolving_door(spark, sf_dir):
    """The SQL ranks each subset by the alternating sum of binomials."""
    return G.combinations_in(spark, 9, 4).select("id", C.text("ps").alias("ps"))


@query(f"WITH RECURSIVE {rank()}, {pairs(2)}, ends AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs), o(u) AS (SELECT []::INT[] UNION ALL SELECT list_append(u, x::INT) FROM o, (SELECT unnest(range(2)) AS x) WHERE len(u) < 8),"
       f" f AS (SELECT row_id, list_transform(range(1, 9), lambda i: pa.u[i] // 2 * 2 + o.u[i]) AS u FROM pa JOIN o ON len(o.u) = 8 WHERE row_id IN (SELECT x FROM ends)),"
       f" n AS (SELECT f.row_id, f.u, count(*) FILTER ({cheb('f.u', 'v.u')} >= 2) AS covered FROM f JOIN ends ON ends.x = f.row_id JOIN pa v ON v.row_id = ends.y GROUP BY f.row_id, f.u),"
       f" best AS (SELECT row_id, max(covered) AS most FROM n GROUP BY row_id) SELECT n.row_id, most AS covered, count(*) AS n_fillings, min({txt('n.u')}) AS first FROM n JOIN best ON n.row_id = best.row_id AND covered = most GROUP BY n.row_id, most")
def g30_fullest_fillings(spark, sf_dir):
    """For every row with conflicts its fillings that end most of them; the SQL lists all fillings."""
    array = staged(rank_array(spark, sf_dir), "array")
    ends = R.both_ways(R.conflicts(array, 2).select("a", "b"))
    against = ends.join(array, F.col("b") == F.col("row_id")).select(F.col("a").alias("row_id"), F.col("u").alias("v"))
    return covering.fullest(array, against, 2).select("row_id", "covered", "n_fillings", C.text("first").alias("first"))


# -- one order of the high symbols for each row of a block of four


def _slots(spark, sf_dir):
    rows = rank_array(spark, sf_dir, 6)
    orders = G.permutations(spark, 3).select((F.get("u", F.lit(0)) * 2 + (F.get("u", F.lit(1)) > F.get("u", F.lit(2))).cast("int")).alias("option"), F.transform("u", lambda x: x + 3).alias("highs"))
    every = rows.crossJoin(F.broadcast(orders))  # six orders
    nth = lambda i: F.size(F.filter(F.slice("u", 1, i), lambda y: y > 2))
    filled = F.transform("u", lambda x, i: F.when(x > 2, F.get("highs", nth(i))).otherwise(x))
    return every.select(F.floor(F.col("row_id") / 4).alias("puzzle"), (F.col("row_id") % 4).alias("slot"), "option", filled.alias("u"))


def _short(u, v):
    """What two rows lack to be three apart, as a negative worth."""
    return F.least(C.distance(u, v), F.lit(3)) - 3


_OPTIONS = f"""{rank(6)}, orders(k, h) AS (VALUES (0, [3, 4, 5]), (1, [3, 5, 4]), (2, [4, 3, 5]), (3, [4, 5, 3]), (4, [5, 3, 4]), (5, [5, 4, 3])),
 o AS (SELECT row_id // 4 AS puzzle, row_id % 4 AS slot, k, list_transform(range(1, 7), lambda i: CASE WHEN u[i] > 2 THEN h[len(list_filter(range(1, i + 1), lambda j: u[j] > 2))] ELSE u[i] END) AS u FROM pa, orders)"""


def _ways(d: int, worth: str) -> str:
    names = "abce"
    two = [(p, q) for i, p in enumerate(names) for q in names[:i]]
    joins = " ".join(f"JOIN o {x} ON a.puzzle = {x}.puzzle AND {x}.slot = {i}" + "".join(f" AND {cheb(f'{x}.u', f'{y}.u')} >= {d}" for y in names[:i]) for i, x in enumerate(names) if i)
    path = ", ".join(f"{x}.k" for x in names)
    total = " + ".join(worth.format(cheb(f"{p}.u", f"{q}.u")) for p, q in two)
    return f"WITH {_OPTIONS}, ways AS (SELECT a.puzzle, [{path}] AS path, ({total})::BIGINT AS worth FROM o a {joins} WHERE a.slot = 0) SELECT puzzle, {txt('path')} AS path, worth FROM ways QUALIFY row_number() OVER (PARTITION BY puzzle ORDER BY worth DESC, path) = 1"


def _whole(spark, sf_dir):
    """The blocks that have all four rows."""
    slots = _slots(spark, sf_dir)
    return slots.join(slots.groupBy("puzzle").agg(F.countDistinct("slot").alias("n")).where("n = 4").select("puzzle"), "puzzle", "left_semi")


@query(_ways(1, "least({}, 3) - 3"))
def e10_best_choices(spark, sf_dir):
    found, _ = choose.best_choices(_whole(spark, sf_dir), 1, _short)
    return found.select("puzzle", C.text("path").alias("path"), "worth")


@query(_ways(3, "0 * {}"))
def e3_first_choices(spark, sf_dir):
    found, _ = choose.best_choices(_whole(spark, sf_dir), 3)
    return found.select("puzzle", C.text("path").alias("path"), "worth")


@query(f"""WITH RECURSIVE {_OPTIONS}, offers AS (SELECT puzzle, slot, k, u FROM o UNION ALL SELECT DISTINCT puzzle, slot, {choose.SKIPPED}, NULL FROM o),
 w(puzzle, slot, us, path, n) AS (SELECT DISTINCT puzzle, 0, []::INT[][], []::INT[], 0 FROM o UNION ALL
  SELECT w.puzzle, w.slot + 1, CASE WHEN f.u IS NULL THEN us ELSE list_append(us, f.u) END, list_append(path, f.k), n + (f.u IS NOT NULL)::INT FROM w JOIN offers f ON f.puzzle = w.puzzle AND f.slot = w.slot
  AND (f.u IS NULL OR len(list_filter(us, lambda t: list_max(list_transform(range(1, 7), lambda i: abs(t[i] - f.u[i]))) < 3)) = 0))
 SELECT puzzle, {txt('path')} AS path, n::BIGINT AS worth FROM w WHERE slot = 4 AND puzzle IN (SELECT puzzle FROM o WHERE slot = 3) QUALIFY row_number() OVER (PARTITION BY puzzle ORDER BY n DESC, path) = 1""")
def e11_fullest_choices(spark, sf_dir):
    found, _ = choose.best_choices(_whole(spark, sf_dir), 3, skip=True)
    return found.select("puzzle", C.text("path").alias("path"), "worth")


# -- searches of many blocks of the table, checked by joins


def _rows(spark, sf_dir, size: int):
    return rank_array(spark, sf_dir, 6).select(F.floor(F.col("row_id") / size).alias("block"), "row_id", "u")


_RIGHT = "SELECT DISTINCT vec_id // 20 AS block, true AS valid, true AS scored FROM embeddings"


def _search_query(name: str, solve, image=None):
    @query(_RIGHT, name)
    def run(spark, sf_dir):
        return blocks.checked(staged(solve(_rows(spark, sf_dir, 20)), "blocks"), 3, image)


_search_query("h1_blocks_checked", lambda rows: blocks.climbed(rows, 3, steps=150))
_search_query("h2_blocks_checked", lambda rows: blocks.climbed(rows, 3, kind="disturb", steps=150, gentle=30, great=100))
_search_query("h6_blocks_checked", lambda rows: blocks.climbed(rows, 3, steps=150, objective="coverage", pick="degree"))
_search_query("h9_blocks_checked", lambda rows: blocks.climbed(rows, 3, steps=60, candidates=6))
_search_query("h10_blocks_checked", lambda rows: blocks.climbed(rows, 3, steps=150, image="complement"), lambda x: C.complement(x, 6))
_search_query("h7_blocks_checked", lambda rows: blocks.tournaments(rows, 3, rounds=4, steps=40))
_search_query("h5_blocks_checked", lambda rows: blocks.incremented(rows, 3, steps=30))


@query(f"""WITH RECURSIVE {rank(6)}, own AS (SELECT row_id // 20 AS block, row_id, u, row_number() OVER (PARTITION BY row_id // 20 ORDER BY row_id) AS k FROM pa),
 step(block, k, ids, us) AS (SELECT DISTINCT block, 0::BIGINT, []::BIGINT[], []::INT[][] FROM own UNION ALL
  SELECT s.block, o.k, CASE WHEN f THEN list_append(ids, o.row_id) ELSE ids END, CASE WHEN f THEN list_append(us, o.u) ELSE us END FROM step s JOIN own o ON s.block = o.block AND o.k = s.k + 1,
  LATERAL (SELECT len(list_filter(us, lambda t: list_max(list_transform(range(1, 7), lambda i: abs(t[i] - o.u[i]))) < 3)) = 0 AS f))
 SELECT block, unnest(ids) AS row_id FROM (SELECT block, arg_max(ids, k) AS ids FROM step GROUP BY block)""")
def g10_kept_greedily(spark, sf_dir):
    return blocks.kept_greedily(_rows(spark, sf_dir, 20), 3).select("block", "row_id")


@query(f"""WITH RECURSIVE {rank(6)}, own AS (SELECT row_id // 10 AS block, row_id, u FROM pa),
 sets(block, ids, us) AS (SELECT block, [row_id], [u] FROM own UNION ALL SELECT s.block, list_append(ids, o.row_id), list_append(us, o.u) FROM sets s JOIN own o ON s.block = o.block AND o.row_id > s.ids[-1]
  AND len(list_filter(us, lambda t: list_max(list_transform(range(1, 7), lambda i: abs(t[i] - o.u[i]))) < 3)) = 0)
 SELECT block, max(len(ids)) AS n_rows, true AS apart FROM sets GROUP BY block""")
def e1_largest_blocks(spark, sf_dir):
    found = staged(blocks.largest(_rows(spark, sf_dir, 10), 3), "largest")
    sound = blocks.checked(found, 3).select(F.col("block").alias("of"), "scored")
    return found.groupBy("block").agg(F.count("*").alias("n_rows")).join(sound, F.col("block") == F.col("of")).select("block", "n_rows", F.col("scored").alias("apart"))


@query(f"""WITH RECURSIVE {rank()}, {pairs(2)}, ends AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs), near AS (SELECT DISTINCT x FROM ends),
 moved AS (SELECT x AS row_id, pa.u, list_transform(pa.u, lambda y: CASE WHEN y // 2 = g THEN g * 4 + 1 - y ELSE y END) AS new FROM near JOIN pa ON pa.row_id = x, (SELECT unnest(range(4)) AS g)),
 had AS (SELECT x, count(*) AS n FROM ends GROUP BY x),
 made AS (SELECT m.row_id, m.new, count(*) FILTER (pa.row_id <> m.row_id AND {cheb('m.new', 'pa.u')} < 2) AS n FROM moved m, pa GROUP BY m.row_id, m.new)
 SELECT made.row_id, {txt('made.new')} AS u, (had.n - made.n)::BIGINT AS gain FROM made JOIN had ON had.x = made.row_id WHERE had.n > made.n""")
def h12_single_moves(spark, sf_dir):
    found = moves.look_ahead(rank_array(spark, sf_dir), 2, depth=1)
    return found.select(F.get("plan", F.lit(0))["row_id"].alias("row_id"), C.text(F.get("plan", F.lit(0))["u"]).alias("u"), "gain")


@query("SELECT true AS found, 0::BIGINT AS wrong")
def h12_look_ahead_checked(spark, sf_dir):
    """Plans of up to three moves, each array made anew and its conflicts counted again."""
    array = staged(rank_array(spark, sf_dir), "array")
    plans = staged(moves.look_ahead(array, 2, depth=3, width=3).orderBy(F.col("gain").desc(), F.to_json("plan")).limit(4).withColumn("id", F.monotonically_increasing_id()), "plans")
    was = R.score(array, 2).first()["conflicts"]
    wrong = 0
    for p in plans.collect():  # four plans
        new = spark.createDataFrame([(m["row_id"], m["u"]) for m in p["plan"]], "row_id long, new array<int>")
        now = array.join(F.broadcast(new), "row_id", "left").select("row_id", F.coalesce("new", "u").alias("u"))  # three rows
        wrong += R.score(now, 2).first()["conflicts"] != was - p["gain"]
    return plans.agg((F.count("*") > 0).alias("found"), F.lit(wrong).cast("long").alias("wrong"))


@query("SELECT vec_id // 20 AS block, count(*) AS n_rows, true AS scored FROM embeddings GROUP BY 1")
def t3_stopped_chains_checked(spark, sf_dir):
    """A chain for each block of 20 rows: one segment, then another call that goes on."""
    rows, folder = _rows(spark, sf_dir, 20), shared_dir(spark, "chains")
    search.chains_until(rows, 3, [1], folder, segments=1, steps=50)
    found = staged(search.chains_until(rows, 3, [1], folder, segments=2, steps=50), "chains")
    told = blocks.checked(found, 3)
    return found.groupBy(F.col("block").alias("of")).agg(F.count("*").alias("n_rows")).join(told, F.col("of") == F.col("block")).select("block", "n_rows", "scored")


# -- joins of the templates of the table's rows


_ROW_TEMPLATES = f"WITH {rank()}, ts AS (SELECT row_id, list_transform(u, lambda x: x // 3) AS t FROM pa)"


def _row_templates(spark, sf_dir):
    return rank_array(spark, sf_dir).select("row_id", C.groups("u", 3).alias("t"))


@query(f"{_ROW_TEMPLATES}, one AS (SELECT DISTINCT t FROM ts) SELECT {txt('a.t')} AS t, {txt('b.t')} AS s FROM one a, one b WHERE {cheb('a.t', 'b.t')} <= 1")
def j3_foes_of_rows(spark, sf_dir):
    return R.foe_pairs(_row_templates(spark, sf_dir)).select(C.text("t").alias("t"), C.text("s").alias("s"))


@query(f"{_ROW_TEMPLATES} SELECT a.row_id AS a, b.row_id AS b FROM ts a JOIN ts b ON a.row_id < b.row_id WHERE list_transform(a.t, lambda x: x = 0) = list_transform(b.t, lambda x: x = 0)")
def j11_same_lows_of_rows(spark, sf_dir):
    return R.same_lows(_row_templates(spark, sf_dir))


@query(f"{_ROW_TEMPLATES}, p AS (SELECT a.row_id AS a, len(list_filter(range(1, 9), lambda i: a.t[i] <> b.t[i]))::INT AS n_cols FROM ts a JOIN ts b ON a.row_id <> b.row_id WHERE {cheb('a.t', 'b.t')} <= 1) SELECT a AS row_id, n_cols, count(*) AS n_foes FROM p GROUP BY a, n_cols")
def j12_foe_counts_of_rows(spark, sf_dir):
    return R.foe_counts(_row_templates(spark, sf_dir))


@query(f"WITH {rank()} SELECT {txt('list_transform(u, lambda x: x // 3)')} AS t, count(*) AS n FROM pa WHERE {cheb('u', '(u[4:8] || u[1:3])')} < 5 GROUP BY 1")
def a11_rotation_failures_of_rows(spark, sf_dir):
    rows = rank_array(spark, sf_dir).where(~C.separated("u", C.rotate_left("u"), 5))
    return rows.groupBy(C.text(C.groups("u", 3)).alias("t")).agg(F.count("*").alias("n"))


@query(f"""WITH {rank()}, duo AS (SELECT a.row_id, list_transform(a.u, lambda x: CASE WHEN x > 5 THEN x::VARCHAR ELSE 'L' END) AS u, list_transform(b.u, lambda x: CASE WHEN x > 5 THEN x::VARCHAR ELSE 'L' END) AS v FROM pa a JOIN pa b ON b.row_id = a.row_id + 1),
 lows AS (SELECT row_id, list_min(list_transform(list_filter(range(1, 9), lambda i: u[i] <> 'L' AND v[i] = 'L'), lambda i: u[i]::INT)) AS x, list_min(list_transform(list_filter(range(1, 9), lambda i: u[i] = 'L' AND v[i] <> 'L'), lambda i: v[i]::INT)) AS y FROM duo)
 SELECT row_id, CASE (least(x, y), greatest(x, y)) WHEN (6, 6) THEN -5 WHEN (6, 7) THEN -2 WHEN (7, 7) THEN -1 END::INT AS value FROM lows WHERE x IS NOT NULL AND y IS NOT NULL""")
def f28_pair_values(spark, sf_dir):
    """Two rows in a row, of which the two highest symbols are known, where each has one against an open cell."""
    known = lambda u: F.transform(u, lambda x: F.when(x > 5, x.cast("string")).otherwise("L"))
    a = rank_array(spark, sf_dir)
    duo = a.join(a.select((F.col("row_id") - 1).alias("row_id"), F.col("u").alias("v")), "row_id").select("row_id", known("u").alias("u"), known("v").alias("v"))
    meets = lambda x, y: F.exists(F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y")), lambda z: (z["x"] != "L") & (z["y"] == "L"))
    return duo.where(meets("u", "v") & meets("v", "u")).select("row_id", C.pair_value("u", "v").alias("value"))


# -- more files: written to shared storage and read back


_SIX = f"WITH {rank(6)} SELECT row_id, {txt('u')} AS u FROM pa"


def _read_back(spark, path):
    return text.load(spark, path, "lenient").select("row_id", C.text("u").alias("u"))


@query(_SIX)
def s7_s8_resumed(spark, sf_dir):
    """A folder with a verified array of another size and an unfinished one: the search goes on from the latter."""
    folder = shared_dir(spark, "resume")
    text.dump(rank_array(spark, sf_dir, 3), f"{folder}/pa_3_choose_3_verified.txt")
    text.dump(rank_array(spark, sf_dir, 6), f"{folder}/pa_6_choose_3_unfinished.txt")
    array, name = search.resume(spark, folder, 6, 3)
    return array.where(F.lit(name == "pa_6_choose_3_unfinished.txt")).select("row_id", C.text("u").alias("u"))


@query("SELECT 7::INT AS n, 6::INT AS found")
def s12_misnamed(spark, sf_dir):
    folder = shared_dir(spark, "names")
    text.dump(rank_array(spark, sf_dir, 6), f"{folder}/pa_6_choose_3.txt")
    text.dump(rank_array(spark, sf_dir, 6), f"{folder}/pa_7_choose_3.txt")
    files = spark.read.text([f"{folder}/pa_6_choose_3.txt", f"{folder}/pa_7_choose_3.txt"]).select(F.regexp_extract("_metadata.file_path", r"(.*)/[^/]*$", 1).alias("file"), "value")
    first = files.groupBy("file").agg(F.max(F.size(F.split("value", " "))).alias("found"))
    return text.names(first.select("file")).join(first, "file").where(F.col("n") != F.col("found")).select("n", "found")


@query("SELECT true AS first, false AS worse, true AS better, 3::BIGINT AS score")
def k3_only_if_better(spark, sf_dir):
    path, six = shared_dir(spark, "best"), rank_array(spark, sf_dir, 6)
    said = [text.maybe_dump(six, path, k) for k in (7, 9, 3)]
    return text.headers(spark, path).select(*[F.lit(x).alias(c) for x, c in zip(said, ("first", "worse", "better"), strict=True)], "score")


@query(_SIX)
def k4_published(spark, sf_dir):
    path = shared_dir(spark, "published")
    text.publish(rank_array(spark, sf_dir, 6).where("row_id < 3"), path)
    text.publish(rank_array(spark, sf_dir, 6), path)
    return _read_back(spark, path)


@query(f"WITH {rank()}, {pairs(2)} SELECT a, b FROM pairs")
def k5_edges_file(spark, sf_dir):
    path = shared_dir(spark, "edges")
    text.dump_edges(R.conflicts(rank_array(spark, sf_dir), 2), path)
    return spark.read.parquet(path)


@query(f"WITH {rank()}, {pairs(2)}, deg AS (SELECT x, count(*) AS n FROM (SELECT a AS x FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY x) SELECT '# Disagreements: ' || (sum(n) // 2)::BIGINT || ' Counter({{' || string_agg(x || ': ' || n, ', ' ORDER BY n DESC, x) || '}})' AS value FROM deg")
def k7_annotated_file(spark, sf_dir):
    path, array = shared_dir(spark, "annotated"), rank_array(spark, sf_dir)
    text.dump_annotated(array, path, R.degrees(array, 2))
    return spark.read.text(path).where("value LIKE '#%'")


@query(f"WITH {rank()}, {pairs(2)}, {{rows}} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, {txt('u')} AS u FROM kept".replace("{rows}", "kept AS (SELECT * FROM pa WHERE row_id NOT IN (SELECT a FROM pairs UNION SELECT b FROM pairs))"))
def k8_trimmed_file(spark, sf_dir):
    array = rank_array(spark, sf_dir)
    path = text.dump_trimmed(array, f"{shared_dir(spark, 'trimmed')}/pa_8_2.txt", 2, R.happy(array, 2))
    return _read_back(spark, path)


@query(f"WITH {rank(5)}, halves AS (SELECT row_id, u FROM pa UNION ALL SELECT row_id, list_filter(u, lambda x: x < 4) FROM pa) SELECT len(u)::INT AS size, array_to_string(u, ' ') AS value FROM halves")
def k9_files_by_size(spark, sf_dir):
    path, five = shared_dir(spark, "sizes"), rank_array(spark, sf_dir, 5)
    both = five.unionByName(five.select("row_id", F.filter("u", lambda x: x < 4).alias("u")))
    text.dump_by_size(both.select(F.size("u").alias("size"), "row_id", "u"), path)
    return spark.read.option("lineSep", "\r\n").text(path).select(F.col("size").cast("int").alias("size"), "value")


@query(f"""WITH RECURSIVE {rank(6)}, own AS (SELECT row_id // 20 AS block, row_id, u, row_number() OVER (PARTITION BY row_id // 20 ORDER BY row_id) AS k FROM pa),
 step(block, k, ids, us, turned) AS (SELECT DISTINCT block, 0::BIGINT, []::BIGINT[], []::INT[][], 0 FROM own UNION ALL
  SELECT s.block, o.k, CASE WHEN f OR g THEN list_append(ids, o.row_id) ELSE ids END, CASE WHEN f THEN list_append(us, o.u) WHEN g THEN list_append(list_transform(us, lambda t: list_transform(t, lambda x: 5 - x)), o.u) ELSE us END, turned + (NOT f AND g)::INT
  FROM step s JOIN own o ON s.block = o.block AND o.k = s.k + 1, LATERAL (SELECT len(list_filter(us, lambda t: list_max(list_transform(range(1, 7), lambda i: abs(t[i] - o.u[i]))) < 3)) = 0 AS f,
   len(list_filter(us, lambda t: list_max(list_transform(range(1, 7), lambda i: abs(5 - t[i] - o.u[i]))) < 3)) = 0 AS g)),
 ended AS (SELECT block, arg_max(ids, k) AS ids, arg_max(us, k) AS us, arg_max(turned, k) AS turned FROM step GROUP BY block)
 SELECT block, ids[i] AS row_id, {txt('us[i]')} AS u, turned::BIGINT AS turned FROM ended, (SELECT unnest(range(1, 21)) AS i) WHERE i <= len(ids)""")
def g11_complementing_blocks(spark, sf_dir):
    return blocks.kept_greedily(_rows(spark, sf_dir, 20), 3, complementing=True).select("block", "row_id", C.text("u").alias("u"), F.col("score").alias("turned"))


@query(f"""WITH RECURSIVE {rank()}, {pairs(2)}, ends AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs), near AS (SELECT x, list(y) AS ys FROM ends GROUP BY x),
 reach(x, y) AS (SELECT x, x FROM near UNION SELECT r.x, e.y FROM reach r JOIN ends e ON r.y = e.x), root AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
 sets(c, last, out, n) AS (SELECT c, x, ys, 1 FROM root JOIN near USING (x) UNION ALL SELECT s.c, x, out || ys, n + 1 FROM sets s JOIN root USING (c) JOIN near USING (x) WHERE x > last AND NOT list_contains(out, x)),
 best AS (SELECT c, max(n) AS n FROM sets GROUP BY c), many AS (SELECT count(*) AS n FROM pa), covered AS (SELECT count(*) AS n FROM near)
 SELECT (many.n - covered.n + (SELECT sum(n) FROM best))::BIGINT AS independent, (covered.n - (SELECT sum(n) FROM best))::BIGINT AS cover, 0::BIGINT AS uncovered FROM many, covered""")
def r5_r6_sizes(spark, sf_dir):
    """How large a largest independent set and a least cover are, and the conflicts that the cover leaves; the SQL lists independent sets."""
    array = staged(rank_array(spark, sf_dir), "array")
    edges = staged(R.conflicts(array, 2).select("a", "b"), "edges")
    cover = staged(graph.per_component(edges, graph.least_cover), "cover")
    left = edges.join(cover, F.col("a") == F.col("node"), "left_anti").join(cover, F.col("b") == F.col("node"), "left_anti").agg(F.count("*").alias("uncovered"))
    kept = graph.largest_independent(array, edges).agg(F.count("*").alias("independent"))
    return kept.crossJoin(cover.agg(F.count("*").alias("cover"))).crossJoin(left)  # a number each

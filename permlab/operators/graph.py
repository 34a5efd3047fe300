"""Graphs given as edges (a, b): components by alternating large and small stars, and per-component searches.

A large star connects every larger neighbour of a node with the least of node and neighbours; a small star does so
for the smaller ones. Neither gathers a node's neighbours: the least is a combined aggregate, joined back. Rounds
end when the edges stay the same; each is written to shared storage.

Searches that go one step after another (greedy removal, exact covers) run in a task for each component:
components don't affect each other, so that is as far as they can be spread. Cliques are found by their least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlab.operators.numbering import numbered
from permlab.sources.storage import staged


#: Edges of an array's conflicts that one task joins, at most.
SMALL = 1 << 17


def _star(pairs: DataFrame, least: DataFrame, keep) -> DataFrame:
    """pairs: u, v. Connects every v that is kept with the least of u."""
    return pairs.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, small: int = 0) -> DataFrame:
    """edges: a, b (long, not null). Returns node, root for every node that has an edge to another; root is the least reachable.

    Up to `small` edges (counted) are joined in one task, with the same result.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if small and now.limit(small + 1).count() <= small:
        return now.coalesce(1).mapInPandas(_joined, "node long, root long")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), F.col("v") > F.col("u"))
        large = staged(large.where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(large, least, F.lit(True)).unionByName(least.select("u", F.col("m").alias("v")))
        now = staged(small.where("u <> v").distinct(), "small")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = seen


def _joined(frames):
    import pandas as pd

    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for frame in frames:
        for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "root": pd.Series([find(x) for x in nodes], dtype="int64")})


def array_components(array: DataFrame, edges: DataFrame) -> DataFrame:
    """row_id, component (least row_id) of all rows, alone ones too."""
    found = components(edges.select("a", "b"), SMALL)
    return array.join(found, F.col("row_id") == F.col("node"), "left").select("row_id", F.coalesce("root", "row_id").alias("component"))


def connected(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, together: whether the rows of each pair are of one component."""
    side = lambda k: members.select(F.col("row_id").alias(f"row_{k}"), F.col("component").alias(f"of_{k}"))
    both = pairs.join(side("a"), F.col("a") == F.col("row_a")).join(side("b"), F.col("b") == F.col("row_b"))
    return both.select("a", "b", (F.col("of_a") == F.col("of_b")).alias("together"))


def by_size(members: DataFrame) -> DataFrame:
    """component, size, rank: components, the largest first, of equal ones the least."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    return numbered(sizes, [F.col("size").desc(), F.col("component").asc()], "rank").select("component", "size", (F.col("rank") + 1).alias("rank"))


def size_histogram(members: DataFrame) -> DataFrame:
    """size, n_components."""
    return members.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_components"))


def common_ends(array: DataFrame, members: DataFrame) -> DataFrame:
    """component, size, pre, suf: the columns at either end in which all rows of a component agree, one at least."""
    cells = array.join(members, "row_id").select("component", F.size("u").alias("n"), F.posexplode("u").alias("col", "x"))
    cols = cells.groupBy("component", "n", "col").agg((F.min("x") != F.max("x")).alias("mixed"), F.count("*").alias("size"))
    ends_ = cols.groupBy("component", "n", "size").agg(F.min(F.when(F.col("mixed"), F.col("col"))).alias("first"), F.max(F.when(F.col("mixed"), F.col("col"))).alias("last"))
    heads = array.join(members, "row_id").groupBy("component").agg(F.min_by("u", "row_id").alias("u"))
    pre, suf = F.greatest(F.coalesce("first", "n"), F.lit(1)), F.greatest(F.coalesce(F.col("n") - 1 - F.col("last"), "n"), F.lit(1))
    return ends_.join(heads, "component").select("component", "size", F.slice("u", F.lit(1), pre).alias("pre"), F.slice("u", -suf, suf).alias("suf"))


def missed(vertices: DataFrame, edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """node: vertices that are neither chosen nor next to a chosen one."""
    two = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = two.join(chosen.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).unionByName(chosen.select("node"))
    return vertices.select("node").join(near, "node", "left_anti")


# -- one task for each component


def greedy_removal(pairs: list[tuple[int, int]], turn: dict[int, int] | None = None) -> list[int]:
    """Nodes removed, most edges first, until no edge is left; ties to the node that sorted pairs name first, or to the lowest turn."""
    near: dict[int, set[int]] = {}
    for a, b in sorted(pairs):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []
    while True:
        node = max(near, key=lambda x: (len(near[x]), -turn[x] if turn else 0), default=None)
        if node is None or not near[node]:
            return out
        for other in near.pop(node):
            near[other].discard(node)
        out.append(node)


def least_cover(pairs: list[tuple[int, int]]) -> list[int]:
    """A smallest vertex cover: branch on a node of the highest degree, with a matching as the bound."""
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    best = greedy_removal(pairs)

    def matching(graph):
        used, n = set(), 0
        for a in graph:
            if a not in used:
                b = next((x for x in graph[a] if x not in used), None)
                if b is not None:
                    used |= {a, b}
                    n += 1
        return n

    def less(graph, gone):
        return {x: y - gone for x, y in graph.items() if x not in gone and y - gone}

    def search(graph, taken):
        nonlocal best
        while True:  # a node with one edge: its neighbour is as good
            leaf = next((x for x in sorted(graph) if len(graph[x]) == 1), None)
            if leaf is None:
                break
            other = next(iter(graph[leaf]))
            taken, graph = [*taken, other], less(graph, {other})
        if not graph:
            if len(taken) < len(best):
                best = taken
            return
        if len(taken) + matching(graph) >= len(best):
            return
        node = max(sorted(graph), key=lambda x: len(graph[x]))
        search(less(graph, {node}), [*taken, node])
        search(less(graph, set(graph[node])), [*taken, *sorted(graph[node])])

    search(near, [])
    return sorted(best)


def matching_cover(pairs: list[tuple[int, int]]) -> list[int]:
    """Both ends of a maximal matching, edges in order: at most twice the least cover."""
    used: set[int] = set()
    for a, b in sorted(pairs):
        if a not in used and b not in used:
            used |= {a, b}
    return sorted(used)


def dominating(pairs: list[tuple[int, int]], least: int = 1) -> list[int]:
    """Nodes taken by how many new ones they and their neighbours bring, while that is `least` or more; ties to the smallest."""
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    out, left = [], set(near)
    while left:
        node = max(sorted(near), key=lambda x: len(near[x] & left))
        if len(near[node] & left) < least:
            break
        out.append(node)
        left -= near[node]
    return out


def partly_dominating(pairs: list[tuple[int, int]], newbies: int = 15, left: int = 10, budget: int = 200_000) -> list[int] | None:
    """Depth first: nodes that aren't covered yet, by their number, each if it covers `newbies` new neighbours or more, until fewer than `left`
    nodes are uncovered; None if no way gets there. More than `budget` steps are an error."""
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    order, chosen, covered, steps = sorted(near), [], set(), 0

    def walk() -> bool:
        nonlocal steps
        if len(near) - len(covered) < left:
            return True
        for x in order:
            steps += 1
            if steps > budget:
                raise RuntimeError(f"more than {budget} steps")
            new = set() if x in covered else near[x] - covered
            if len(new) >= newbies:
                chosen.append(x)
                covered.update(new)
                if walk():
                    return True
                covered.difference_update(new)
                chosen.pop()
        return False

    return chosen if walk() else None


def cliques(pairs: list[tuple[int, int]], enough: int | None = None) -> list[list[int]]:
    """All maximal cliques, each sorted, with pivots; with `enough`, until one of so many nodes is found, which is the last to be added."""
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, found = [], False

    def grow(clique, free, done):
        nonlocal found
        if found:
            return
        if not free and not done:
            out.append(sorted(clique))
            found = enough is not None and len(clique) >= enough
            return
        pivot = max(free | done, key=lambda x: len(near[x] & free))
        for x in sorted(free - near[pivot]):
            grow([*clique, x], free & near[x], done & near[x])
            free, done = free - {x}, done | {x}

    grow([], set(near), set()) if near else None
    return sorted(out)


def per_component(edges: DataFrame, solve) -> DataFrame:
    """node: what solve(pairs) returns for each component."""

    def run(frame):
        import pandas as pd

        return pd.DataFrame({"node": pd.Series(solve(list(zip(frame["a"].tolist(), frame["b"].tolist(), strict=True))), dtype="int64")})

    return _rooted(edges).groupBy("root").applyInPandas(run, "node long")


def _rooted(edges: DataFrame) -> DataFrame:
    own = staged(edges.select("a", "b").distinct(), "pairs")
    return own.join(components(own, SMALL), F.col("a") == F.col("node")).select("root", "a", "b")


def cliques_from(node: int, near: list[int], later: list[tuple[int, list[int]]]) -> list[list[int]]:
    """All maximal cliques whose least node is this one, each sorted; near: its neighbours, later: those above it with their own neighbours."""
    place = {x: i for i, x in enumerate(near)}
    meets, free = [0] * len(near), 0
    for x, others in later:
        i = place[x]
        free |= 1 << i
        for y in others:
            k = place.get(y)
            if k is not None:
                meets[i] |= 1 << k
                meets[k] |= 1 << i
    out = []

    def bits(some: int):
        while some:
            yield (some & -some).bit_length() - 1
            some &= some - 1

    def grow(clique, free, done):
        if not free:
            if not done:
                out.append(sorted([node, *(near[i] for i in clique)]))
            return
        pivot = max(bits(free | done), key=lambda i: (meets[i] & free).bit_count())
        for i in bits(free & ~meets[pivot]):
            grow([*clique, i], free & meets[i], done & meets[i])
            free, done = free & ~(1 << i), done | 1 << i

    grow([], free, (1 << len(near)) - 1 & ~free)
    return out


def maximal_cliques(edges: DataFrame) -> DataFrame:
    """members (sorted), size. A clique is found by its least node, which knows its neighbours and theirs; no component is held in a task."""
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = staged(both.groupBy(F.col("a").alias("node")).agg(F.sort_array(F.collect_set("b")).alias("near")), "near")
    above = near.select(F.col("node").alias("of"), F.explode("near").alias("x")).where("x > of")
    later = above.join(near, F.col("x") == F.col("node")).groupBy("of").agg(F.collect_list(F.struct("x", "near")).alias("later"))  # neighbours of neighbours
    known = near.join(later, F.col("node") == F.col("of")).select("node", "near", "later")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                found = [c for r in batch.slice(start, 256).to_pylist() for c in cliques_from(r["node"], r["near"], [(x["x"], x["near"]) for x in r["later"]])]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), pa.array([len(c) for c in found], pa.int32())], names=["members", "size"])

    return known.mapInArrow(run, "members array<long>, size int")


def cleaned(array: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows that greedy removal leaves."""
    return array.join(per_component(edges, greedy_removal), F.col("row_id") == F.col("node"), "left_anti")


def largest_independent(array: DataFrame, edges: DataFrame) -> DataFrame:
    """A largest set of rows without an edge: all but a smallest cover."""
    return array.join(per_component(edges, least_cover), F.col("row_id") == F.col("node"), "left_anti")

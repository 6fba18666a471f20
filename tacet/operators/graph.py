"""Connected components, and their refinement by cutting weak bridges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacet import config as C
from tacet.sources.shared import keep, numbered


#: Edges of a graph that one task joins up at once (counted first; under a megabyte).
FEW_EDGES = 20_000


def _joined(table: pa.Table) -> pa.Table:
    """(v, c) of a small graph, by union-find."""
    a, b = (table.column(c).to_numpy() for c in ("a", "b"))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)  # nodes are in order, so a root is the least of its component
    return pa.table({"v": pa.array(nodes), "c": pa.array(nodes[[find(x) for x in range(len(nodes))]])})


def _stretches(batches):
    """Of each batch of edges (a, b) its vertices with their least neighbour over edges of the batch, by union-find."""
    for batch in batches:
        if batch.num_rows:
            yield from _joined(pa.Table.from_batches([batch])).to_batches()


def components(edges: DataFrame, most: int = 40, few: int = FEW_EDGES) -> DataFrame:
    """(v, c): the least vertex c reachable from each vertex v of edges (a, b).

    A graph of at most ``few`` edges is joined up by one task. A larger one is laid out in the order of its vertices, and each
    batch of edges is joined up where it lies; what is left are links between the roots of a vertex that batches share,
    which are a graph of their own, and a far smaller one if linked vertices are near each other. If it is not, it takes rounds.
    """
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = e.count()
    if n <= few:
        return e.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(_joined, "v bigint, c bigint")
    dealt = e.repartitionByRange(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), "b", "a").sortWithinPartitions("b", "a")
    stars = keep(dealt.mapInArrow(_stretches, "v bigint, c bigint"))
    root = keep(stars.groupBy("v").agg(F.min("c").alias("c")))
    links = keep(stars.join(root.withColumnRenamed("c", "b"), "v").where("c <> b").select(F.col("c").alias("a"), "b").distinct())
    left = links.count()
    if not left:
        return root
    top = components(links, most, few) if left <= max(few, n // 2) else _rounds(links, most)
    return root.join(top.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("v", F.coalesce("to", "c").alias("c"))


def _rounds(e: DataFrame, most: int) -> DataFrame:
    """(v, c) of edges (a, b) with a > b.

    Large-star and small-star steps alternate; each keeps the number of edges linear, hubs are only
    aggregated by a minimum or joined, and a logarithmic number of rounds suffices. After ``most``
    rounds without an end (which a graph of any real size does not take) it raises an error.
    """
    last = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        e = keep(large.join(low, "a").select(F.explode(pairs).alias("x")).select("x.a", "x.b").where("a <> b").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            roots = e.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct()
            return e.select(F.col("a").alias("v"), F.col("b").alias("c")).unionByName(roots)
        last = now
    raise RuntimeError("components did not converge")


def updated(labels: DataFrame, edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(v, c) of a graph whose components were ``labels`` (v, c) and that has got the edges (a, b): the same as of all its edges.

    The new edges are joined up between the labels of their ends, which takes rounds over no more than these edges; then every
    vertex looks its label up. An end without a label is a new vertex.
    """
    edges = edges.where("a <> b").select("a", "b").distinct()
    for side in ("a", "b"):
        edges = edges.join(labels.select(F.col("v").alias(side), F.col("c").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    edges = keep(edges)
    merged = components(edges.select(F.col("ca").alias("a"), F.col("cb").alias("b")), few=few).select(F.col("v").alias("c"), F.col("c").alias("to"))
    ends = edges.select("a", "ca").unionByName(edges.select(F.col("b").alias("a"), F.col("cb").alias("ca"))).toDF("v", "c").distinct()
    every = labels.select("v", "c").unionByName(ends.join(labels.select("v"), "v", "left_anti"))
    return every.join(merged, "c", "left").select("v", F.coalesce("to", "c").alias("c"))


def bridges(nodes: list, edges: list[tuple]) -> list[int]:
    """Numbers of the edges whose removal disconnects their ends.

    A spanning forest is grown; every other edge covers the tree path between its ends, and the
    tree edges that nothing covers are the bridges. Covers are summed from the leaves up.
    """
    place = {v: i for i, v in enumerate(nodes)}
    links: list[list[tuple[int, int]]] = [[] for _ in nodes]
    for n, (a, b, *_) in enumerate(edges):
        links[place[a]].append((place[b], n))
        links[place[b]].append((place[a], n))
    parent, by, depth, order = [-1] * len(nodes), [-1] * len(nodes), [-1] * len(nodes), []
    for start in range(len(nodes)):
        if depth[start] >= 0:
            continue
        depth[start], todo = 0, [start]
        while todo:  # depth first, so that other edges join a node to one of its ancestors
            u = todo[-1]
            for v, n in links[u]:
                if depth[v] < 0:
                    depth[v], parent[v], by[v] = depth[u] + 1, u, n
                    todo.append(v)
                    break
            else:
                order.append(todo.pop())
    cover = [0] * len(nodes)
    tree = set(by)
    for n, (a, b, *_) in enumerate(edges):
        if n not in tree:
            i, j = place[a], place[b]
            low, high = (i, j) if depth[i] > depth[j] else (j, i)
            cover[low] += 1
            cover[high] -= 1
    out = []
    for u in order:  # children before parents
        if parent[u] >= 0:
            if not cover[u]:
                out.append(by[u])
            cover[parent[u]] += cover[u]
    return out


def _sides(nodes: list, edges: list[tuple]) -> list[list]:
    near: dict = {v: [] for v in nodes}
    for a, b, *_ in edges:
        near[a].append(b)
        near[b].append(a)
    out, seen = [], set()
    for v in nodes:
        if v not in seen:
            seen.add(v)
            side, todo = [], [v]
            while todo:
                u = todo.pop()
                side.append(u)
                new = [w for w in near[u] if w not in seen]
                seen.update(new)
                todo += new
            out.append(sorted(side))
    return out


def refine(nodes: list, edges: list[tuple], weak: float = C.WEAK_BRIDGE, deepest: int = C.MAX_DEPTH) -> list[list]:
    """Splits a component at its weakest bridge (a, b, p) if that is weak and both sides have two members, again and again."""
    done, todo = [], [(sorted(nodes), sorted(edges), 0)]
    while todo:
        own, links, depth = todo.pop()
        found = [n for n in bridges(own, links) if links[n][2] <= weak] if len(own) >= 3 and depth <= deepest else []
        target = min(found, key=lambda n: (links[n][2], links[n][:2]), default=None)
        kept = links if target is None else links[:target] + links[target + 1 :]
        sides = [own] if target is None else _sides(own, kept)
        if len(sides) < 2 or sum(len(s) >= 2 for s in sides) < 2:
            done.append(own)
            continue
        for side in sides:
            inside = set(side)
            todo.append((side, [e for e in kept if e[0] in inside and e[1] in inside], depth + 1))
    return sorted(done)


def _refined_at_once(weak: float, deepest: int):
    """(v, cluster) of all components of a small graph."""

    def work(table: pa.Table) -> pa.Table:
        links = list(zip(*(table.column(c).to_pylist() for c in ("a", "b", "p")), strict=True))
        parts: dict[int, list] = {}
        for a, b, p, c in zip(*(table.column(c).to_pylist() for c in ("a", "b", "p", "c")), strict=True):
            parts.setdefault(c, []).append((a, b, p))
        out = []
        for links in parts.values():
            members = sorted({v for a, b, _ in links for v in (a, b)})
            out += [(v, side[0]) for side in refine(members, links, weak, deepest) for v in side]
        return pa.table({"v": pa.array([v for v, _ in out], pa.int64()), "cluster": pa.array([c for _, c in out], pa.int64())})

    return work


def _refined_in_turn(weak: float, deepest: int):
    """(v, cluster) of rows in the order of their component, one whole component after the other."""
    at_once = _refined_at_once(weak, deepest)

    def work(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = pa.Table.from_batches([batch])
            x = x if held is None else pa.concat_tables([held, x])
            own = x.column("c").to_numpy()
            ready = int(np.searchsorted(own, own[-1]))  # the last component may go on in the next batch
            if ready:
                yield from at_once(x.slice(0, ready)).to_batches()
            held = x.slice(ready)
        if held is not None:
            yield from at_once(held).to_batches()

    return work


def _jumped(pointers: DataFrame, most: int = 40) -> DataFrame:
    """(c, d) with d the root of each c, of pointers (c, d) that lead to roots (d, d): pointers are doubled until nothing moves."""
    for _ in range(most):
        far = pointers.select(F.col("c").alias("d"), F.col("d").alias("e"))
        moved = keep(pointers.join(far, "d").select("c", F.col("e").alias("d"), (F.col("d") != F.col("e")).alias("moved")))
        pointers = moved.select("c", "d")
        if not moved.where("moved").limit(1).count():
            return pointers
    raise RuntimeError("pointers did not converge")


def spanning_forest(edges: DataFrame, most: int = 64) -> DataFrame:
    """Numbers e of the edges (e, a, b) of a spanning forest. Edges may be parallel; loops belong to none.

    Each round every part takes its edge of the least hash, and parts that are so joined become one; at least half of
    the parts that can be joined go each round.
    """
    live, taken = keep(edges.where("a <> b").select("e", "a", "b")), None
    for _ in range(most):
        if not live.limit(1).count():
            return keep(edges.select("e").limit(0)) if taken is None else taken.distinct()
        both = live.unionByName(live.select("e", F.col("b").alias("a"), F.col("a").alias("b")))
        best = keep(both.groupBy(F.col("a").alias("c")).agg(F.min(F.struct(F.xxhash64("e").alias("h"), F.col("e"), F.col("b").alias("d"))).alias("x")).select("c", "x.e", "x.d"))
        taken = best.select("e") if taken is None else taken.unionByName(best.select("e"))
        other = best.select(F.col("c").alias("d"), F.col("d").alias("back"))
        # of two parts that chose each other the lesser is a root; hashes are in one order, so no longer circle exists
        roots = best.join(other, "d", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("d")), F.col("c")).otherwise(F.col("d")).alias("d"))
        root = _jumped(keep(roots))
        for side in ("a", "b"):
            live = live.join(root.withColumnsRenamed({"c": side, "d": f"{side}2"}), side).drop(side).withColumnRenamed(f"{side}2", side)
        live = live.select("e", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
        live = keep(live.groupBy("a", "b").agg(F.min_by("e", F.xxhash64("e")).alias("e")).select("e", "a", "b"))
    raise RuntimeError("the spanning forest did not converge")


def bridge_edges(edges: DataFrame, most: int = 64) -> DataFrame:
    """Numbers e of the edges (e, a, b) whose removal disconnects their ends; edges may be parallel.

    Every edge outside a spanning forest covers the forest's path between its ends. It gives two words of random bits
    to both ends; a forest edge is covered if the words of the vertices on one side of it do not cancel out, so uncovered
    ones are the bridges (that a covered one cancels out has a probability of 2**-128). Sides are stretches of the forest's
    Euler tour: the sums from each arc to the end of the tour are found by doubling. No step gathers a component.
    """
    edges = keep(edges.where("a <> b").select("e", "a", "b"))
    forest = keep(edges.join(spanning_forest(edges), "e"))
    arcs = forest.select("e", F.col("a").alias("x"), F.col("b").alias("y")).unionByName(forest.select("e", F.col("b").alias("x"), F.col("a").alias("y")))
    rest = edges.join(forest.select("e"), "e", "left_anti")
    words = [F.bit_xor(F.xxhash64("e", F.lit(seed))).alias(f"w{seed}") for seed in (1, 2)]
    cover = rest.select("e", "a").unionByName(rest.select("e", F.col("b").alias("a"))).groupBy(F.col("a").alias("y")).agg(*words)
    # the tour goes on from an arc into y to the next arc out of y, in the order of the other ends: places in one global order
    out = numbered(arcs.select("e", "x", "y"), "x", "y", name="place")
    ends = out.groupBy("x").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    into = out.select("e", F.col("place").alias("arc"), F.col("x").alias("from"), F.col("y"))
    back = out.select("e", F.col("place").alias("turn"), F.col("y").alias("from"), F.col("x").alias("y"))
    tour = into.join(back, ["e", "from", "y"]).join(ends.withColumnRenamed("x", "y"), "y")
    following = F.when(F.col("turn") == F.col("high"), F.col("low")).otherwise(F.col("turn") + 1)
    first = F.col("turn") == F.col("low")  # one arc into each vertex brings the vertex's words along
    tour = tour.join(cover, "y", "left").select("e", "arc", following.alias("next"), *[F.when(first, F.coalesce(w, F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint")).alias(w) for w in ("w1", "w2")], "from")
    least = components(forest.select("a", "b")).groupBy("c").agg(F.lit(1).alias("one")).select(F.col("c").alias("from"))
    starts = out.join(least.withColumnRenamed("from", "x"), "x").groupBy("x").agg(F.min("place").alias("start")).select(F.col("start").alias("next"), F.lit(True).alias("cut"))
    now = keep(tour.join(starts, "next", "left").select("e", "arc", F.when(F.col("cut").isNull(), F.col("next")).alias("next"), "w1", "w2"))  # each tour is cut open once
    for _ in range(most):
        if not now.where("next is not null").limit(1).count():
            pair = now.groupBy("e").agg(F.bit_xor("w1").alias("w1"), F.bit_xor("w2").alias("w2"))
            return pair.where("w1 = 0 and w2 = 0").select("e")
        later = now.select(F.col("arc").alias("next"), F.col("next").alias("next2"), F.col("w1").alias("v1"), F.col("w2").alias("v2"))
        x = now.join(later, "next", "left")
        sums = [F.when(F.col(v).isNull(), F.col(w)).otherwise(F.col(w).bitwiseXOR(F.col(v))).alias(w) for w, v in (("w1", "v1"), ("w2", "v2"))]
        now = keep(x.select("e", "arc", F.col("next2").alias("next"), *sums))
    raise RuntimeError("the tours did not end")


def _labelled(edges: DataFrame, nodes: DataFrame, few: int) -> DataFrame:
    """(v, c) of nodes (v), those without edges (a, b) too."""
    c = components(edges.select("a", "b"), few=few)
    return nodes.select("v").join(c, "v", "left").select("v", F.coalesce("c", "v").alias("c"))


def refined(edges: DataFrame, labels: DataFrame, few: int = FEW_EDGES, weak: float = C.WEAK_BRIDGE, deepest: int = C.MAX_DEPTH) -> DataFrame:
    """(v, cluster): components of scored edges (a, b, p), refined. A cluster is named by its least member.

    A part of three members or more is cut at its weakest bridge, if that is weak and both sides have two members,
    up to ``deepest`` times behind each other. Components of at most ``few`` edges (counted first) are refined where their
    edges lie together, one after the other. For the others no step gathers a component: cutting a bridge makes or ends no
    other, so the weak bridges are found once: parts that strong edges join are contracted, and the bridges of what is left
    are the weak ones. What no weak bridge divides is then a block with its size, blocks and weak bridges form a forest, and
    each round cuts every tree of it at its weakest bridge.
    """
    edges = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("p").alias("p")).where("a <> b")
    edges = keep(edges.join(labels.select(F.col("v").alias("a"), "c"), "a").select("a", "b", "p", "c"))
    large = keep(edges.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).select("c"))
    some = large.limit(1).count() > 0
    small = edges.join(large, "c", "left_anti").select("a", "b", "p", "c") if some else edges
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = small.repartition(parts, "c").sortWithinPartitions("c").mapInArrow(_refined_in_turn(weak, deepest), "v bigint, cluster bigint")
    if not some:
        return each
    own = keep(edges.join(large, "c", "left_semi").select("a", "b", "p"))
    return each.unionByName(_refined_apart(own, labels, few, weak, deepest))


def _refined_apart(edges: DataFrame, labels: DataFrame, few: int, weak: float, deepest: int) -> DataFrame:
    """``refined`` for large components: edges (a, b, p), each pair once; no step gathers a component."""
    nodes = keep(labels.select("v", "c").join(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "v", "left_semi"))
    strong = keep(_labelled(edges.where(F.col("p") > weak), nodes, few))
    thin = numbered(_ends(edges.where(F.col("p") <= weak), strong).where("ca <> cb"), "a", "b", name="e")
    thin = keep(thin)
    found = keep(thin.join(bridge_edges(thin.select("e", F.col("ca").alias("a"), F.col("cb").alias("b"))), "e").select("e", "a", "b", "p"))
    block = keep(_labelled(edges.join(found.select("a", "b"), ["a", "b"], "left_anti"), nodes, few))
    tree = keep(_ends(found, block).select("e", "a", "b", "p", F.col("ca").alias("x"), F.col("cb").alias("y")))
    sizes = block.groupBy(F.col("c").alias("v")).agg(F.count(F.lit(1)).alias("size"))
    part = keep(block.where("v = c").select("v").join(nodes, "v").join(sizes, "v"))  # blocks: v, the tree c they are in, size
    live = tree
    for _ in range(deepest + 1):
        if not live.limit(1).count():
            break
        owned = live.join(part.select(F.col("v").alias("x"), "c"), "x")
        large = part.groupBy("c").agg(F.sum("size").alias("members")).where("members >= 3")
        target = keep(owned.groupBy("c").agg(F.min(F.struct("p", "a", "b", "e")).alias("t")).join(large, "c", "left_semi").select("c", "t.e"))
        mine = part.join(target.select("c"), "c", "left_semi")
        rest = keep(owned.join(target.select("c"), "c", "left_semi").join(target.select("e"), "e", "left_anti"))
        cut = keep(_labelled(rest.select(F.col("x").alias("a"), F.col("y").alias("b")), mine, few).withColumnRenamed("c", "side").join(mine, "v"))
        small = cut.groupBy("c", "side").agg(F.sum("size").alias("n")).where("n < 2").select("c").distinct()
        done = cut.select("v", "side", "c", "size").join(small, "c", "left_anti")  # parts whose cut holds
        part = keep(part.join(done.select("v", "side"), "v", "left").select("v", F.coalesce("side", "c").alias("c"), "size"))
        live = keep(rest.join(small, "c", "left_anti").drop("c"))
    least = block.join(part.select(F.col("v").alias("c"), F.col("c").alias("part")), "c").select("v", "part")
    return least.join(least.groupBy("part").agg(F.min("v").alias("cluster")), "part").select("v", "cluster")


def _ends(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges with the labels ca and cb of their ends."""
    for side in ("a", "b"):
        edges = edges.join(labels.select(F.col("v").alias(side), F.col("c").alias(f"c{side}")), side)
    return edges

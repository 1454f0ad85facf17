"""Graphs as frames: triples and patterns over them, neighbourhoods, paths, components and measures.

vertices: id, kind, label, confidence. edges: source, predicate, target. Traversals are loops of equi-joins on the frontier.
"""

from __future__ import annotations

import heapq
import itertools
import sys

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.components import components
from lodestack.runtime import BROADCAST_BYTES, broadcast_if_small, cut

#: Larger components are refused, not sampled: by betweenness where more is left without leaves, by communities, which take a component in one task of 0.7 KB an edge.
MOST_EDGES = 200_000
MOST_TIES = 500_000
#: Of one of the ends that `related_of_kind` lays beside each other.
END_BYTES = 256
#: Squared edges of a component that one task of betweenness takes.
SOURCE_WORK = 5_000_000


def triples(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (s, p, o): type, label and confidence of every vertex, and the edges. NULL objects make no triple."""
    facts = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o")) for p, c in (("type", "kind"), ("label", "label"), ("confidence", "confidence"))]))
    return vertices.select(F.col("id").alias("s"), facts.alias("x")).select("s", "x.*").where("o IS NOT NULL").union(edges.select("source", "predicate", "target")).distinct()


class Pattern:
    """A basic graph pattern over a triples frame: conjunctions, optional parts and absences, by equi-joins on shared variables."""

    def __init__(self, trips: DataFrame, rows: DataFrame | None = None) -> None:
        self.trips, self.rows = trips, rows

    def _part(self, pattern: tuple[str, str, str]) -> DataFrame:
        """Terms that begin with ? are variables, others constants; p may be constants parted by |."""
        df, out = self.trips, {}
        for col, term in zip("spo", pattern, strict=True):
            if not term.startswith("?"):
                df = df.where(F.col(col).isin(term.split("|")))
            elif term[1:] in out:
                df = df.where(F.col(col) == F.col(out[term[1:]]))
            else:
                out[term[1:]] = col
        return df.select(*[F.col(c).alias(v) for v, c in out.items()]).distinct()

    def _shared(self, part: DataFrame) -> list[str]:
        on = [c for c in part.columns if c in self.rows.columns]
        if not on:
            raise ValueError("a pattern that shares no variable would be a cross join")
        return on

    def match(self, s: str, p: str, o: str) -> Pattern:
        part = self._part((s, p, o))
        return Pattern(self.trips, part if self.rows is None else self.rows.join(part, self._shared(part)))

    def optional(self, s: str, p: str, o: str) -> Pattern:
        part = self._part((s, p, o))
        return Pattern(self.trips, self.rows.join(part, self._shared(part), "left"))

    def absent(self, s: str, p: str, o: str) -> Pattern:
        part = self._part((s, p, o))
        return Pattern(self.trips, self.rows.join(part, self._shared(part), "left_anti"))


def related_of_kind(trips: DataFrame) -> DataFrame:
    """a, b, via, each once: what depends on or supports via, and another of one of its kinds that supports it.

    Kinds are laid beside both before they meet, so only pairs that count are made, and those aren't shuffled: a pair that shares more kinds than one
    is kept at the least of them. The first side is dealt by number, as a via may have most of the pairs.
    """
    kinds = trips.where("p = 'type'").groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("kinds"))

    def ends(predicates: list[str], end: str) -> DataFrame:
        ties = trips.where(F.col("p").isin(predicates)).select("s", F.col("o").alias("via")).distinct()
        return ties.join(kinds, "s").select(F.col("s").alias(end), "via", F.explode("kinds").alias("kind"), F.col("kinds").alias("kinds_" + end))

    b = cut(ends(["supports"], "b"))
    met = b.select("via", "kind").distinct()
    a = ends(["depends_on", "supports"], "a").join(broadcast_if_small(met, met.count(), 128), ["via", "kind"], "left_semi")
    many, spread = b.count(), int(trips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if many * END_BYTES <= BROADCAST_BYTES:
        a, b, on = a.repartition(spread, "a"), F.broadcast(b), ["via", "kind"]
    else:
        a = a.withColumn("share", F.pmod(F.xxhash64("a"), F.lit(spread)))
        b = b.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
        on = ["via", "kind", "share"]
    once = (F.size("kinds_a") == 1) | (F.size("kinds_b") == 1) | (F.col("kind") == F.array_min(F.array_intersect("kinds_a", "kinds_b")))
    return a.join(b, on).where((F.col("a") != F.col("b")) & once).select("a", "b", "via")


def one_predicate(edges: DataFrame) -> DataFrame:
    """A simple directed graph: of several predicates of an ordered pair the least."""
    return edges.groupBy("source", "target").agg(F.min("predicate").alias("predicate"))


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b, predicate, direction: every edge from both of its ends."""
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "predicate", F.lit("out").alias("direction"))
    return out.union(edges.select("target", "source", "predicate", F.lit("in")))


def neighbours(edges: DataFrame, vertices: DataFrame, node: str) -> DataFrame:
    """predicate, direction, id, kind, label of what one edge ties to the node."""
    near = both_ways(edges).where(F.col("a") == node).select("predicate", "direction", F.col("b").alias("id")).distinct()
    return near.join(vertices.select("id", "kind", "label"), "id")


def impact(edges: DataFrame, vertices: DataFrame, node: str) -> DataFrame:
    """Per kind the neighbours one hop away, either way: their number and labels in order."""
    near = both_ways(edges).where((F.col("a") == node) & (F.col("b") != node)).select(F.col("b").alias("id")).distinct().join(vertices, "id")
    return near.groupBy("kind").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("label")), "; ").alias("labels"))


def distances(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id and dist of what lies within depth of any seed (column id), edges taken both ways."""
    sym = both_ways(edges).select("a", "b").distinct()
    found = seeds.select("id").where("id IS NOT NULL").distinct().withColumn("dist", F.lit(0))
    front = found
    for step in range(1, depth + 1):
        front = front.select(F.col("id").alias("a")).join(sym, "a").select(F.col("b").alias("id")).distinct().join(found, "id", "left_anti").withColumn("dist", F.lit(step))
        if step < depth:
            front = cut(front)
        found = found.union(front)
    return found


def ego(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """The edges among what lies within depth."""
    inside = cut(distances(edges, seeds, depth)).select("id")
    return edges.join(inside.withColumnRenamed("id", "source"), "source", "left_semi").join(inside.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "predicate", "target")


def shortest_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """step, id of a shortest path either way along edges; of several parents the least is taken. No rows without a path.

    The loop stops when the goal is met or nothing new is found, however long the path; the driver learns only whether it was.
    """
    spark = edges.sparkSession
    sym = both_ways(edges).select("a", "b").distinct()
    seen = spark.createDataFrame([(start, None, 0)], "id string, parent string, dist int")
    front, met = seen, start == goal
    step = 0
    while not met:
        step += 1
        front = cut(front.select(F.col("id").alias("a")).join(sym, "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent")).join(seen, "id", "left_anti").withColumn("dist", F.lit(step)))
        if front.isEmpty():
            break
        met = not front.where(F.col("id") == goal).isEmpty()
        seen = seen.union(front) if step % 8 else cut(seen.union(front))
    if not met:
        return spark.createDataFrame([], "step int, id string")
    path, at = [goal], goal
    while at != start:
        at = seen.where(F.col("id") == at).first()["parent"]
        path.append(at)
    return spark.createDataFrame([(i, x) for i, x in enumerate(reversed(path))], "step int, id string")


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree and degree over n - 1, of the simple directed graph."""
    simple = one_predicate(edges)
    ends = simple.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(simple.select("target", F.lit(1), F.lit(0)))
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    n = vertices.agg(F.count("*")).scalar()
    out = vertices.select("id").join(d, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree")).withColumn("centrality", F.round(F.try_divide(F.col("degree"), n - 1), 6))


def summary(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: vertices, edges of the simple graph, density, components (isolated vertices count)."""
    comp = components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    n, m = vertices.agg(F.count("*").alias("vertices")), one_predicate(edges).agg(F.count("*").alias("edges"))
    touched = comp.agg(F.count_distinct("component").alias("c"), F.count("*").alias("t"))
    out = n.join(F.broadcast(m), how="cross").join(F.broadcast(touched), how="cross")  # one row each
    return out.select("vertices", "edges", F.round(F.try_divide(F.col("edges"), F.col("vertices") * (F.col("vertices") - 1)), 8).alias("density"), (F.col("c") + F.col("vertices") - F.col("t")).alias("components"))


def component_of(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    comp = components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    return vertices.select("id").join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _brandes(adj: list[list[int]], weight: list[int], sources: range) -> list[float]:
    """Shares of the sources in the betweenness of an undirected graph's vertices: from each a breadth-first count of paths, then dependencies back along it (Brandes 2001). A vertex stands for as many as its weight."""
    score = [0.0] * len(adj)
    for source in sources:
        order, level, paths, before = [source], {source: 0}, {source: 1.0}, {source: []}
        for v in order:
            for w in adj[v]:
                if w not in level:
                    level[w], paths[w], before[w] = level[v] + 1, 0.0, []
                    order.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        owed = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                owed[v] += paths[v] / paths[w] * (weight[w] + owed[w])
            if w != source:
                score[w] += weight[source] * owed[w] / 2
    return score


def _between(frame: pd.DataFrame) -> pd.DataFrame:
    """id, betweenness, n (vertices) of a component, whose ends hold folded vertices already: leaves are folded to the last one, in linear time, and paths are counted among the rest only.

    Of several parts of the sources this is one; what takes no paths is counted in the first.
    """
    if len(frame) > MOST_EDGES:
        raise ValueError(f"a component of {len(frame)} edges without its leaves is too large for betweenness")
    part, parts = int(frame["part"].iloc[0]), int(frame["parts"].iloc[0])
    names = sorted({*frame["a"], *frame["b"]})
    at = {x: i for i, x in enumerate(names)}
    ties: list[set[int]] = [set() for _ in names]
    more, squares = [0] * len(names), [0] * len(names)
    for end in ("a", "b"):
        for x, m, q in zip(frame[end], frame["more_" + end], frame["squares_" + end], strict=True):
            more[at[x]], squares[at[x]] = int(m), int(q)
    for a, b in zip(frame["a"], frame["b"], strict=True):
        ties[at[a]].add(at[b])
        ties[at[b]].add(at[a])
    n = len(names) + sum(more)
    leaves = [v for v, x in enumerate(ties) if len(x) == 1]
    for v in leaves:
        if ties[v]:  # none is left of the last two
            w = ties[v].pop()
            ties[w].discard(v)
            more[w] += 1 + more[v]
            squares[w] += (1 + more[v]) ** 2
            if len(ties[w]) == 1:
                leaves.append(w)
    rest = [v for v, x in enumerate(ties) if x]
    place = {v: i for i, v in enumerate(rest)}
    through = _brandes([sorted(place[w] for w in ties[v]) for v in rest], [1 + more[v] for v in rest], range(part, len(rest), parts))
    score = [0.0 if part else (m * m - q) / 2 + m * (n - m - 1) for m, q in zip(more, squares, strict=True)]
    for v, x in zip(rest, through, strict=True):
        score[v] += x
    return pd.DataFrame({"id": names, "betweenness": score, "n": [n] * len(names)})


class _Leaves:
    """Vertices of one edge beside a group, to be taken first by name: of each two, by the name of the lesser end and then the greater; a name that another begins with counts as after it."""

    def __init__(self, names: list[str], name: str) -> None:
        """Both lists fall, so that the next are at the end; low has those before the group's own name."""
        names = sorted(names, reverse=True)
        k = sum(x > name for x in names)
        self.high, self.low = names[:k], names[k:]

    def all(self) -> list[str]:
        return self.high + self.low

    def first(self, name: str) -> tuple[str, list[str], int] | None:
        """Of the pairs with the group: the first one's key, the list it is in and its place there."""
        best = None
        for names in (self.low, self.high):
            # Only a name that begins with the least can come before it, and so on.
            for i in range(len(names) - 1, -1, -1):
                if i < len(names) - 1 and not names[i].startswith(names[i + 1]):
                    break
                key = _key(names[i], name)
                if best is None or key < best[0]:
                    best = key, names, i
        return best

    def renamed(self, name: str) -> None:
        k = 0
        while k < len(self.low) and self.low[k] > name:
            k += 1
        self.high += self.low[:k]
        del self.low[:k]


def _key(a: str, b: str) -> str:
    return min(a, b) + max(a, b) + chr(sys.maxunicode)


def _communities(adj: dict[str, list[str]]) -> dict[str, str]:
    """Greedy modularity: the pair of tied groups whose union gains most is united while any gains; the first pair by name on ties.

    Gains are whole numbers: ties * m2 - degrees * degrees, m2 twice the edges. A pair's gain only falls while its ties stay as they are, so the heap's
    gains are bounds and are worked out again when they come up. Leaves of a group gain alike: only the next of them is in the heap.
    """
    m2 = sum(len(x) for x in adj.values())
    rest = {v for v, x in adj.items() if len(x) > 1} or adj.keys()
    name = sorted(rest)
    at = {v: i for i, v in enumerate(name)}
    degree = [len(adj[v]) for v in name]
    members = [[v] for v in name]
    leaves = [_Leaves([w for w in adj[v] if w not in at], v) for v in name]
    #: Of two groups their ties and the number of the entry that stands for them; of a group and its leaves that number.
    ties: dict[int, dict[int, list[int]]] = {i: {} for i in range(len(name))}
    leaf_entry = [0] * len(name)
    heap: list[tuple[int, str, int, int, int]] = []
    numbers = itertools.count(1)

    def push(i: int, j: int) -> None:
        tie = ties[i][j]
        tie[1] = next(numbers)
        heapq.heappush(heap, (degree[i] * degree[j] - tie[0] * m2, _key(name[i], name[j]), tie[1], i, j))

    def push_leaf(i: int) -> None:
        if found := leaves[i].first(name[i]):
            leaf_entry[i] = next(numbers)
            heapq.heappush(heap, (degree[i] - m2, found[0], leaf_entry[i], i, -1))

    for i, v in enumerate(name):
        for w in adj[v]:
            if w in at and i < at[w]:
                ties[i][at[w]] = ties[at[w]][i] = [1, 0]
                push(i, at[w])
        push_leaf(i)
    while heap and heap[0][0] < 0:
        loss, _, number, i, j = heapq.heappop(heap)
        if j < 0:
            if i not in ties or leaf_entry[i] != number:
                continue
            if degree[i] - m2 == loss:
                _, names, k = leaves[i].first(name[i])
                leaf = names.pop(k)
                members[i].append(leaf)
                degree[i] += 1
                name[i] = min(name[i], leaf)
                leaves[i].renamed(name[i])
            push_leaf(i)
            continue
        tie = ties[i].get(j) if i in ties else None
        if tie is None or tie[1] != number:
            continue
        if degree[i] * degree[j] - tie[0] * m2 != loss:
            push(i, j)
            continue
        if len(ties[i]) < len(ties[j]):
            i, j = j, i
        degree[i] += degree[j]
        name[i] = min(name[i], name[j])
        members[i], members[j] = (members[i], members[j]) if len(members[i]) >= len(members[j]) else (members[j], members[i])
        members[i] += members[j]
        members[j] = []
        if waiting := leaves[i].all() + leaves[j].all():
            leaves[i] = _Leaves(waiting, name[i])
            push_leaf(i)
        for k, tie in ties.pop(j).items():
            del ties[k][j]
            if k == i:
                continue
            if k in ties[i]:
                ties[i][k][0] += tie[0]
            else:
                ties[i][k] = ties[k][i] = tie
            push(i, k)
    return {v: name[i] for i in ties for v in members[i]}


def _per_component(kind: str, work):  # noqa: ANN001, ANN202
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > MOST_TIES:
            raise ValueError(f"a component of {len(frame)} edges is too large for {kind}")
        adj: dict[str, set[str]] = {}
        for a, b in zip(frame["a"], frame["b"], strict=True):
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
        out = work({v: sorted(n - {v}) for v, n in sorted(adj.items())})
        return pd.DataFrame({"id": list(out), kind: list(out.values())})

    return run


def _folded(edges: DataFrame) -> tuple[DataFrame, int, list[DataFrame]]:
    """Distinct pairs (a, b) of ends with vertices of one edge folded into their neighbours, as long as a round takes at least half of the edges: what is left, its number, and each round's id, into.

    A forest has nothing left. Whatever a vertex has been folded into is left, or folded in a later round, or the last of its tree.
    """
    left = cut(edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("source IS NOT NULL AND target IS NOT NULL AND source <> target").distinct())
    m, rounds = left.count(), []
    while m:
        ends = left.union(left.select("b", "a")).groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1")
        # Of two vertices that have but each other the greater is folded.
        off = cut(ends.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max("a").alias("id")))
        k = off.count()
        if 2 * k < m:
            break
        left = cut(left.join(off.select(F.col("lo").alias("a"), F.col("hi").alias("b")), ["a", "b"], "left_anti"))
        rounds.append(off.select("id", F.when(F.col("id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("into")))
        m -= k
    return left, m, rounds


def _by_component(edges: DataFrame) -> DataFrame:
    """component (one of its vertices), a, b of the distinct pairs of ends: folded vertices belong where what they were folded into does."""
    left, m, rounds = _folded(edges)
    known = edges.sparkSession.createDataFrame([], "id string, component string")
    if m:
        known = cut(components(left)).withColumnRenamed("node", "id")
    out = left.join(known.withColumnRenamed("id", "a"), "a").select("component", "a", "b")
    for off in reversed(rounds):
        over = broadcast_if_small(known, known.count(), 128)
        off = cut(off.join(over.withColumnRenamed("id", "into"), "into", "left").select("id", "into", F.coalesce("component", "into").alias("component")))
        known = known.union(off.select("id", "component"))
        out = out.union(off.select("component", "id", "into"))
    return out


def _fold(off: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of vertices that are folded (id, into): those that hold others (id, into, more, squares), those that don't (id); and what is held then."""
    off = cut(off.join(held, "id", "left"))
    done = off.where("more IS NOT NULL")
    weight = F.coalesce("more", F.lit(0)) + 1
    gained = off.groupBy(F.col("into").alias("id")).agg(F.sum(weight).alias("more"), F.sum(weight * weight).alias("squares"))
    held = held.join(done.select("id"), "id", "left_anti").unionByName(gained).groupBy("id").agg(F.sum("more").alias("more"), F.sum("squares").alias("squares"))
    return done, off.where("more IS NULL").select("id"), cut(held)


def betweenness(edges: DataFrame) -> DataFrame:
    """id, betweenness (unnormalised, undirected) of every vertex with an edge.

    Vertices of one edge lie on no path but to what hangs on them, so they are folded into their neighbours, by aggregates over all components. more:
    vertices folded into one, by branches; squares: the branches' squared sizes, summed; so (more² - squares) / 2 paths tie its branches
    and more * (n - more - 1) lead from them to the rest. What is left is worked on by component, its sources dealt to tasks; more than MOST_EDGES edges left of a component raise.
    """
    left, m, folded = _folded(edges)
    held = edges.sparkSession.createDataFrame([], "id string, more long, squares long")
    rounds, bare = [], []
    for off in folded:
        done, none, held = _fold(off, held)
        rounds.append(done)
        bare.append(none)
    known = held.select("id", ((F.col("more") * F.col("more") - F.col("squares")) / 2).cast("double").alias("betweenness"), (F.col("more") + 1).alias("n"))
    if m:
        rest = cut(_left_between(left, held))
        known = known.join(rest, "id", "left_anti").unionByName(rest)
    for done in reversed(rounds):
        over = cut(known)
        up = done.join(over.select(F.col("id").alias("into"), "n"), "into")
        known = over.unionByName(up.select("id", ((F.col("more") * F.col("more") - F.col("squares")) / 2 + F.col("more") * (F.col("n") - F.col("more") - 1)).cast("double").alias("betweenness"), "n"))
    out = known.select("id", "betweenness")
    for none in bare:
        out = out.unionByName(none.withColumn("betweenness", F.lit(0.0)))
    return out


def _left_between(left: DataFrame, held: DataFrame) -> DataFrame:
    """id, betweenness, n of the vertices of edges that are left, each component's sources dealt to as many tasks as its size asks for."""
    spark = left.sparkSession
    comp = cut(components(left).withColumnRenamed("node", "a"))
    e = left.join(comp, "a")
    for end in ("a", "b"):
        e = e.join(held.select(F.col("id").alias(end), F.col("more").alias("more_" + end), F.col("squares").alias("squares_" + end)), end, "left")
    e = cut(e.fillna(0, [f"{c}_{end}" for c in ("more", "squares") for end in "ab"]))
    size = e.groupBy("component").agg(F.count("*").alias("m")).select("component", F.least(F.lit(64), F.greatest(F.lit(1), F.ceil(F.col("m") * F.col("m") / SOURCE_WORK))).cast("int").alias("parts"))
    e = e.join(size, "component").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # Dealt by number: small shuffles would be put together into one task.
    e = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "component", "part")
    parts = e.groupBy("component", "part").applyInPandas(_between, "id string, betweenness double, n long")
    return parts.groupBy("id").agg(F.sum("betweenness").alias("betweenness"), F.max("n").alias("n"))


def communities(edges: DataFrame) -> DataFrame:
    """id, community (its least member's name) by greedy modularity, per component. Components above MOST_TIES raise."""
    pairs = _by_component(edges)
    # Dealt by number: small shuffles would be put together into one task.
    pairs = pairs.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "component")
    return pairs.groupBy("component").applyInPandas(_per_component("community", _communities), "id string, community string")


def by_kind(edges: DataFrame, vertices: DataFrame, top: int = 5) -> DataFrame:
    """Per kind: vertices, edges touching them, and the ids of the most tied."""
    sides = edges.select(F.monotonically_increasing_id().alias("e"), F.explode(F.array("source", "target")).alias("id"))
    sides = cut(sides).join(vertices.select("id", "kind"), "id")
    touching = sides.groupBy("kind").agg(F.count_distinct("e").alias("edges"))
    tied = sides.groupBy("kind", "id").agg(F.count("*").alias("d"))
    best = tied.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("d"), "id"))).where(F.col("r") <= top)
    best = best.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]), "; ").alias("top"))
    return vertices.groupBy("kind").agg(F.count("*").alias("vertices")).join(touching, "kind", "left").join(best, "kind", "left").select("kind", "vertices", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("top", F.lit("")).alias("top"))


"""Projects whose graph one task can hold: each is searched in one pass, without rounds of joins.

Spark deals the projects out to tasks and sorts their rows; a task holds one project at a
time. Projects of more than ``WHOLE`` edges are never dealt out whole: the callers give
these to their rounds of joins, which need no project in one place.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import UNREACHABLE
from ..session import SMALL, counted

P = "project_id"

#: Edges of a project up to which one task holds it.
WHOLE = 5_000
#: Rows in a batch that a task gives back; pairs of terminals among which a tree is chosen at once.
BATCH, PAIRS = 50_000, 50_000
#: What a row of a project is: an edge, an edge into a sink, a node to start from.
EDGE, INTO, START = 0, 1, 2


def parted(edges: DataFrame, most: int, one_pass: Callable[..., DataFrame], rounds: Callable[..., DataFrame], *tables: DataFrame) -> DataFrame:
    """``one_pass`` over the edges and tables of projects of at most ``most`` edges, ``rounds`` over those of the others."""
    big, n = counted(edges.groupBy(P).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(P))
    if not n:
        return one_pass(edges, *tables)
    big = F.broadcast(big) if n <= SMALL else big
    some = lambda how: [df.join(big, P, how) for df in (edges, *tables)]
    return one_pass(*some("left_anti")).unionByName(rounds(*some("left_semi")))


def _links(edges: DataFrame, src: str = "src", dst: str = "dst", kind: Column | None = None) -> DataFrame:
    return edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(P, (F.lit(EDGE) if kind is None else kind).alias("k"), F.col(src).alias("a"), F.col(dst).alias("b"))


def _starts(nodes: DataFrame, name: str, like: DataFrame) -> DataFrame:
    return nodes.filter(F.col(name).isNotNull()).select(P, F.lit(START).alias("k"), F.col(name).alias("a"), F.lit(None).cast(dict(like.dtypes)["b"]).alias("b"))


def _each(find: Callable[[Iterable[tuple]], Iterator[tuple]], gives: dict[str, str], *parts: DataFrame) -> DataFrame:
    """(project_id, ...): what ``find`` yields for the rows (project_id, k, a, b) of each project, sorted by k, a and b.

    ``gives``: the columns, of type ``node``, ``nodes`` (an array of them) or ``int``.
    """
    rows = reduce(DataFrame.unionByName, parts).filter(F.col(P).isNotNull())
    of = dict(rows.dtypes)
    names = {"node": of["a"], "nodes": f"array<{of['a']}>", "int": "int"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def given() -> Iterator[tuple]:
            for batch in batches:
                node = batch.schema.field("a").type
                kinds[:] = [batch.schema.field(P).type, *({"node": node, "nodes": pa.list_(node), "int": pa.int32()}[t] for t in gives.values())]
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        found = ((project, *row) for project, own in groupby(given(), key=itemgetter(0)) for row in find(own))
        while some := list(islice(found, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names=[P, *gives])

    return rows.repartition(P).sortWithinPartitions(P, "k", "a", "b").mapInArrow(run, ", ".join([f"{P} {of[P]}", *(f"{c} {names[t]}" for c, t in gives.items())]))


def _reached(rows: Iterable[tuple], max_hops: int | None) -> Iterator[tuple]:
    to, starts = defaultdict(list), {}
    for _, k, a, b in rows:
        if k == START:
            starts[a] = None
        else:
            to[a].append(b)
    for start in starts:
        seen, level, hops = {start}, [start], 0
        while level and (max_hops is None or hops < max_hops):
            hops, last, level = hops + 1, level, []
            for at in last:
                for b in to.get(at, ()):
                    if b not in seen:
                        seen.add(b)
                        level.append(b)
            for b in level:
                yield start, b, hops


def reach(edges: DataFrame, seeds: DataFrame, src: str, dst: str, max_hops: int | None) -> DataFrame:
    """(project_id, source, node, hops) along the edges from ``src`` to ``dst``."""
    links = _links(edges, src, dst)
    return _each(partial(_reached, max_hops=max_hops), {"source": "node", "node": "node", "hops": "int"}, links, _starts(seeds, "source", links))


def _components(rows: Iterable[tuple]) -> Iterator[tuple]:
    to, back = defaultdict(list), defaultdict(list)
    for _, _, a, b in rows:
        to[a].append(b)
        back[b].append(a)
    order, seen = [], set()
    for root in list(to):  # nodes by the time that all behind them is done
        if root in seen:
            continue
        seen.add(root)
        open_ = [(root, iter(to[root]))]
        while open_:
            at, rest = open_[-1]
            for b in rest:
                if b not in seen:
                    seen.add(b)
                    open_.append((b, iter(to.get(b, ()))))
                    break
            else:
                order.append(at)
                open_.pop()
    put = set()
    for root in reversed(order):
        if root in put:
            continue
        put.add(root)
        part = [root]
        for at in part:
            for a in back.get(at, ()):
                if a not in put:
                    put.add(a)
                    part.append(a)
        low = min(part)
        for node in part:
            yield node, low


def components(edges: DataFrame) -> DataFrame:
    """(project_id, node, scc_id): strongly connected components, scc_id the smallest member."""
    return _each(_components, {"node": "node", "scc_id": "node"}, _links(edges))


def _walks(rows: Iterable[tuple], most: int, top: int) -> Iterator[tuple]:
    plain, last, found = defaultdict(list), defaultdict(list), {}
    for _, k, a, b in rows:
        if k == START:
            found[a] = []
        else:
            (last if k == INTO else plain)[a].append(b)
    on = list(found)
    seen = set(on)
    for at in on:
        for b in plain.get(at, ()):
            if b not in seen:
                seen.add(b)
                on.append(b)
    ways = {at: [(at, b) for b in last[at][:top]] for at in on if at in last}
    open_ = list(found)
    for n in range(2, most + 1):
        for start in open_:
            found[start] += ways.get(start, ())
        open_ = [start for start in open_ if len(found[start]) < top]
        if not open_ or n == most:
            break
        longer = {at: list(islice(((at, *way) for b in plain[at] for way in ways.get(b, ())), top)) for at in on if at in plain}
        ways = {at: some for at, some in longer.items() if some}
    for start, some in found.items():
        for way in some[:top]:
            yield start, way[-1], way


def walks(edges: DataFrame, sources: DataFrame, kinds: DataFrame, most: int, top: int) -> DataFrame:
    """(project_id, source, at, path, sink_type): the first ``top`` walks, by length and path, of at most ``most`` nodes from each source to its first sink.

    The walks of one length from a node are its edges before the walks of one node less
    from where these lead, so their ``top`` smallest are made of the ``top`` smallest there.
    """
    into = edges.join(kinds.withColumn("__into", F.lit(True)), "dst", "left")
    links = _links(into, kind=F.when(F.col("__into"), F.lit(INTO)).otherwise(F.lit(EDGE)))
    found = _each(partial(_walks, most=most, top=top), {"source": "node", "at": "node", "path": "nodes"}, links, _starts(sources, "source", links))
    return found.join(kinds.withColumnRenamed("dst", "at"), "at").select(P, "source", "at", "path", "sink_type")


def _distances(rows: Iterable[tuple], max_hops: int | None) -> Iterator[tuple]:
    near, ends = defaultdict(set), set()
    for _, k, a, b in rows:
        if k == START:
            ends.add(a)
        elif a != b:
            near[a].add(b)
            near[b].add(a)
    near, ends = {at: sorted(some) for at, some in near.items()}, sorted(ends)
    for i, u in enumerate(ends[:-1]):
        # a level goes in the order of its paths and neighbours in theirs, so the first way to a node is its smallest
        back, level, hops, left = {u: None}, [u], 0, set(ends[i + 1 :])
        while level and left and (max_hops is None or hops < max_hops):
            hops, last, level = hops + 1, level, []
            for at in last:
                for b in near.get(at, ()):
                    if b not in back:
                        back[b] = at
                        level.append(b)
                        left.discard(b)
        for v in ends[i + 1 :]:
            if v not in back:
                yield u, v, UNREACHABLE, None
                continue
            path = [v]
            while path[-1] != u:
                path.append(back[path[-1]])
            yield u, v, len(path) - 1, path[::-1]


def _tree(rows: Iterable[tuple], max_hops: int | None) -> Iterator[tuple]:
    pairs, tree = _distances(rows, max_hops), []
    while some := list(islice(pairs, PAIRS)):  # a tree of some pairs and the next ones is that of all of them
        of: dict = {}

        def root(node):
            while (up := of.get(node, node)) != node:
                of[node] = of.get(up, up)
                node = up
            return node

        chosen = []
        for pair in sorted([*tree, *some], key=itemgetter(2, 0, 1)):
            if (a := root(pair[0])) != (b := root(pair[1])):
                of[a] = b
                chosen.append(pair)
        tree = chosen
    yield from tree


_PAIR = {"u": "node", "v": "node", "weight": "int", "path": "nodes"}


def distances(edges: DataFrame, terminals: DataFrame, max_hops: int | None) -> DataFrame:
    """(project_id, u, v, weight, path) for each pair u < v of a project's terminals (project_id, node)."""
    links = _links(edges)
    return _each(partial(_distances, max_hops=max_hops), _PAIR, links, _starts(terminals, "node", links))


def tree(edges: DataFrame, terminals: DataFrame, max_hops: int | None) -> DataFrame:
    """The rows of :func:`distances` that are the minimum spanning tree by (weight, u, v); the others never leave their task."""
    links = _links(edges)
    return _each(partial(_tree, max_hops=max_hops), _PAIR, links, _starts(terminals, "node", links))


def _levels(rows: Iterable[tuple]) -> Iterator[tuple]:
    to, into, level = defaultdict(list), defaultdict(int), {}
    for _, _, a, b in rows:
        to[a].append(b)
        into[b] += 1
        level[a] = level[b] = 0
    free = [x for x in level if not into[x]]
    for at in free:
        for b in to.get(at, ()):
            level[b] = max(level[b], level[at] + 1)
            into[b] -= 1
            if not into[b]:
                free.append(b)
    stuck = 1 + max((level[x] for x in free), default=-1)
    for node in level:
        yield node, stuck if into[node] else level[node]


def levels(edges: DataFrame) -> DataFrame:
    """(project_id, node, level): the longest way in; nodes on cycles and behind them on one level after all others of their project."""
    return _each(_levels, {"node": "node", "level": "int"}, _links(edges))

"""Splits that keep related records together, by a min-cost flow over bundles of like components."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.ids import base_id
from quillspark.operators.components import components
from quillspark.storage import written


def related(queries: DataFrame, key: str = "query_id", paired: str = "paired_query_id", source: str = "removed_doc_id") -> DataFrame:
    """(key, group) for every key: group is the smallest key reached through links.

    Links: `paired` names another key of the table (case and outer spaces apart), and equal paper ids in `source`
    (spelling and version apart). Values that name no key or no paper link nothing. Rows of a null key are left out;
    repeated rows of a key join their links. All keys of one paper are linked to the paper's smallest key, so a paper
    that a third of the rows name costs a third of the rows, not their pairs.
    """
    bare = lambda c: F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))
    rows = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(paired).alias("p"), base_id(F.col(source)).alias("paper"))
    keys = rows.select("k", bare("k").alias("name")).distinct()
    named = rows.where("p is not null").select("k", bare("p").alias("name")).distinct().join(keys.select(F.col("k").alias("other"), "name"), "name").select("k", "other")
    papers = rows.where("paper is not null").select("k", "paper").distinct()
    shared = papers.join(papers.groupBy("paper").agg(F.min("k").alias("other")), "paper").select("k", "other")
    found = components(named.unionByName(shared), "k", "other")
    return keys.select("k").join(found, F.col("k") == F.col("node"), "left").select(F.col("k").alias(key), F.coalesce("component", "k").alias("group_id"))


@dataclass(frozen=True)
class Bundle:
    size: int
    label: int
    count: int


def min_cost_flow(nodes: int, arcs: list[tuple[int, int, int, int]], start: int, end: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a largest flow of least cost. Each round takes the least cost that a path
    still has and sends all that goes at that cost, by levels, so that rounds are as many as costs and not as paths."""
    graph: list[list[int]] = [[] for _ in range(nodes)]
    to, left, price = [], [], []
    for a, b, capacity, cost in arcs:
        for x, y, c, p in ((a, b, capacity, cost), (b, a, 0, -cost)):
            graph[x].append(len(to))
            to.append(y), left.append(c), price.append(p)
    potential = [0] * nodes
    while True:
        far = [float("inf")] * nodes
        far[start], heap = 0, [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in graph[x]:
                if left[e] and (n := d + price[e] + potential[x] - potential[to[e]]) < far[to[e]]:
                    far[to[e]] = n
                    heapq.heappush(heap, (n, to[e]))
        if far[end] == float("inf"):
            return [arcs[k][2] - left[2 * k] for k in range(len(arcs))]
        potential = [p + min(d, far[end]) for p, d in zip(potential, far)]
        while True:
            level = [-1] * nodes
            level[start], queue = 0, [start]
            for x in queue:
                for e in graph[x]:
                    if left[e] and level[to[e]] < 0 and price[e] + potential[x] == potential[to[e]]:
                        level[to[e]] = level[x] + 1
                        queue.append(to[e])
            if level[end] < 0:
                break
            open_arcs, path, x = [iter(g) for g in graph], [], start
            tried = [next(i, None) for i in open_arcs]
            while x != start or tried[start] is not None:
                if x == end:
                    most = min(left[e] for e in path)
                    for e in path:
                        left[e] -= most
                        left[e ^ 1] += most
                    path, x = [], start
                elif (e := tried[x]) is None:
                    x = to[path.pop() ^ 1]
                    tried[x] = next(open_arcs[x], None)
                elif left[e] and level[to[e]] == level[x] + 1 and price[e] + potential[x] == potential[to[e]]:
                    path.append(e)
                    x = to[e]
                else:
                    tried[x] = next(open_arcs[x], None)


def _best_swap(bundles: list[Bundle], taken: list[list[int]], over: list[float], sizes: dict[int, list[int]]) -> tuple | None:
    """(gain, i, m, x, y, times, gap): components of bundle i in split x for as many of bundle m, of equal size and `gap` fewer
    labels, in split y. Of each bundle i only the partner whose gap is nearest to what is to be moved is tried."""
    best = None
    for x in range(len(over)):
        for y in range(len(over)):
            wanted = min(over[x], -over[y])
            if x == y or wanted <= 0:
                continue
            for members in sizes.values():
                there = [m for m in members if taken[m][y]]  # in order of labels
                if not there:
                    continue
                labels = [bundles[m].label for m in there]
                for i in members:
                    if not taken[i][x]:
                        continue
                    k = bisect_left(labels, bundles[i].label - wanted)
                    for m in there[max(0, k - 1) : k + 1]:
                        gap = bundles[i].label - bundles[m].label
                        if gap <= 0:
                            continue
                        times = min(taken[i][x], taken[m][y], max(1, int(wanted / gap + 0.5)))
                        gain = abs(over[x]) + abs(over[y]) - abs(over[x] - times * gap) - abs(over[y] + times * gap)
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, i, m, x, y, times, gap)
    return best


def allocate(bundles: list[Bundle], shares: tuple[float, ...], most: int | None = None) -> list[list[int]]:
    """How many components of each bundle each split gets.

    A flow of rows goes from bundles, every one by itself however many there are, to splits: up to its own share, a split's
    quota of labelled (or other) rows and its quota of rows at no cost, beyond each at a cost for every row that deviates. It
    is rounded to whole components bundle by bundle from the largest on, what a split got too much or too little being carried
    to the next, so that small components even it out. Swaps of components of one size then bring the labelled rows nearer
    to their quotas. `most` has no effect; it is there for callers that still give it.
    """
    k = len(shares)
    total, labelled = sum(b.size * b.count for b in bundles), sum(b.label * b.count for b in bundles)
    n = len(bundles)
    node = lambda j: 2 + j
    side = lambda j, lab: 2 + k + 2 * j + lab
    rows_of = [b.size * b.count for b in bundles]
    mostly = [int(2 * b.label >= max(1, b.size)) for b in bundles]
    sides = [sum(r for r, m in zip(rows_of, mostly) if m == lab) for lab in (0, 1)]
    arcs = []
    for i, rows in enumerate(rows_of):  # 1 + 2 k arcs each
        arcs.append((0, 2 + 3 * k + i, rows, 0))
        for j in range(k):
            arcs += [(2 + 3 * k + i, side(j, mostly[i]), round(rows * shares[j]), 0), (2 + 3 * k + i, side(j, mostly[i]), rows, 1)]
    for j in range(k):
        for lab in (0, 1):
            arcs += [(side(j, lab), node(j), round(sides[lab] * shares[j]), 0), (side(j, lab), node(j), total, 1)]
        arcs += [(node(j), 1, round(total * shares[j]), 0), (node(j), 1, total, 10)]
    flow = min_cost_flow(2 + 3 * k + n, arcs, 0, 1)
    quota = [[flow[e] + flow[e + 1] for e in range(i * (1 + 2 * k) + 1, (i + 1) * (1 + 2 * k), 2)] for i in range(n)]
    taken, carry = [[0] * k for _ in bundles], [0.0] * k
    for i in sorted(range(len(bundles)), key=lambda i: (-bundles[i].size, -bundles[i].label)):
        b, rows = bundles[i], quota[i]
        wanted = [max(0.0, (rows[j] + carry[j]) / b.size) for j in range(k)]
        scale = b.count / (sum(wanted) or 1.0)
        wanted = [w * scale for w in wanted]
        taken[i] = [int(w + 1e-9) for w in wanted]
        for j in sorted(range(k), key=lambda j: (taken[i][j] - wanted[j], -carry[j], j))[: b.count - sum(taken[i])]:
            taken[i][j] += 1
        carry = [carry[j] + rows[j] - taken[i][j] * b.size for j in range(k)]
    over = [sum(b.label * t[j] for b, t in zip(bundles, taken)) - labelled * shares[j] for j in range(k)]
    sizes: dict[int, list[int]] = {}
    for i in sorted(range(len(bundles)), key=lambda i: bundles[i].label):
        sizes.setdefault(bundles[i].size, []).append(i)
    while best := _best_swap(bundles, taken, over, sizes):
        _, i, m, x, y, times, gap = best
        taken[i][x] -= times
        taken[i][y] += times
        taken[m][y] -= times
        taken[m][x] += times
        over[x] -= times * gap
        over[y] += times * gap
    return taken


def group_splits(
    groups: DataFrame, key: str, label: DataFrame | None = None, names: tuple[str, ...] = ("train", "validation", "test"), shares: tuple[float, ...] = (0.8, 0.1, 0.1), slots: int = 4096
) -> DataFrame:
    """groups: (key, group_id). Adds split: all keys of a group in one split, `shares` of the keys in each.

    label: (key, label 0/1), whose shares the splits follow too where sizes allow. Only counts of components by (size,
    number of labelled keys) reach the driver: as components of ever more profiles need ever more rows, there are at most
    about the number of rows to the power of 2/3 of them, in practice a few hundred. Members are ordered by a hash of the
    group within slots of that hash, so no bundle is sorted in one task. Empty tables give no rows.
    """
    rows = groups.select(F.col(key).alias("k"), "group_id").distinct()
    marked = rows if label is None else rows.join(label.select(F.col(key).alias("k"), F.col("label").cast("int").alias("mark")).groupBy("k").agg(F.max("mark").alias("mark")), "k", "left")
    sized = marked.groupBy("group_id").agg(F.count("*").alias("size"), (F.lit(0) if label is None else F.coalesce(F.sum("mark"), F.lit(0))).alias("labels"))
    sized = written(sized, "components")
    sized = sized.withColumn("bundle", F.concat_ws(":", "size", "labels")).withColumn("h", F.xxhash64("group_id")).withColumn("slot", F.pmod("h", F.lit(slots)))
    bundles = sized.groupBy("bundle", F.col("size").cast("int").alias("size"), F.col("labels").cast("int").alias("labels")).agg(F.count("*").alias("n")).orderBy(F.desc("size"), F.desc("labels")).collect()
    taken = allocate([Bundle(b["size"], b["labels"], b["n"]) for b in bundles], shares)
    ends = [(b["bundle"], *[sum(t[: j + 1]) for j in range(len(shares) - 1)]) for b, t in zip(bundles, taken)]
    spark = groups.sparkSession
    plan = spark.createDataFrame(ends, "bundle string, " + ", ".join(f"end_{j} long" for j in range(len(shares) - 1)))
    slotted = sized.groupBy("bundle", "slot").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bundle").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    offsets = slotted.select("bundle", "slot", F.coalesce(before, F.lit(0)).alias("offset"))
    ranked = sized.join(offsets, ["bundle", "slot"]).withColumn("rank", F.col("offset") + F.row_number().over(Window.partitionBy("bundle", "slot").orderBy("h", "group_id"))).join(plan, "bundle")
    split = F.lit(names[-1])
    for j in reversed(range(len(shares) - 1)):
        split = F.when(F.col("rank") <= F.col(f"end_{j}"), F.lit(names[j])).otherwise(split)
    return rows.join(ranked.select("group_id", split.alias("split")), "group_id").select(F.col("k").alias(key), "group_id", "split")

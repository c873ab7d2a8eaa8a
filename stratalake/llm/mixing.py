"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that each belongs to).  A pattern
offers its words once at no cost, a second time at cost 1, a third at cost 3 and so on (convex), and
the flow from patterns to the sources' targets of least cost decides how many words of each pattern
the mix takes.  Every document of a pattern is repeated as often as the flow covers the pattern
whole; the remainder goes to the documents of smallest seeded hash.

Patterns and sources are those of a mix's configuration: at most PATTERNS of them come to the driver
(more raise ValueError).  The place where a remainder ends is found from sizes aggregated over hash
bins, then within one bin, so no task sees a whole source and the final pass is a map over all rows.

Defined results: a null text has size 0; a null source is a source of its own, after the others;
weights go over the sources in code-point order; with no words at all every target and share is 0;
rows that repeat exactly (id and text) are taken alike; null ids are told apart by text; an empty
table gives an empty result.  A document is taken at most `repeats` times.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .tables import cut, pick

PATTERNS = 100_000
BINS = 4096
WEIGHTS = (5, 2, 1)
REPEATS = 3
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights: dict, repeats: int = REPEATS) -> dict:
    """Shares of all words by weight, none above `repeats` times its source's size; what is above goes to the others."""
    rest, open_, out = float(sum(sizes.values())), dict(weights), {}
    while open_:
        unit = rest / sum(open_.values())
        full = [s for s, w in open_.items() if w * unit > repeats * sizes[s]]
        for s in full:
            out[s] = float(repeats * sizes[s])
            rest -= out[s]
            del open_[s]
        if not full:
            return out | {s: w * unit for s, w in open_.items()}
    return out


@dataclass
class Flow:
    taken: list[int]
    routed: dict[tuple[int, int], int]


def min_cost_flow(sizes: list[int], members: list[list[int]], quotas: list[int], repeats: int = REPEATS) -> Flow:
    """Words taken of each pattern, and routed from each to each source, by successive cheapest paths.

    Patterns with one source have one path; their flow is pushed at once.  The others go through a
    heap of augmenting paths over residual arcs between patterns and sources.
    """
    n, m = len(sizes), len(quotas)
    taken, routed, left = [0] * n, {}, list(quotas)
    takers: list[set[int]] = [set() for _ in range(m)]

    def level(p: int) -> tuple[int, int]:
        """Cost of the next word of a pattern, and how many words it has at that cost."""
        if not sizes[p] or taken[p] >= repeats * sizes[p]:
            return 1 << 60, 0
        k = taken[p] // sizes[p]
        return k * (k + 1) // 2, (k + 1) * sizes[p] - taken[p]

    def push(p: int, s: int, words: int) -> None:
        routed[p, s] = routed.get((p, s), 0) + words
        if routed[p, s]:
            takers[s].add(p)
        else:
            del routed[p, s]
            takers[s].discard(p)

    # a path: a pattern's spare words -> a source -> (another pattern's words there -> a source of that pattern)* -> a source with room
    starts = [(level(p)[0], p) for p in range(n) if sizes[p]]
    heapq.heapify(starts)
    while starts:
        cost, p = heapq.heappop(starts)
        now, spare = level(p)
        if not spare:
            continue
        if now != cost:
            heapq.heappush(starts, (now, p))
            continue
        before: dict[int, tuple[int, int]] = {s: (p, -1) for s in members[p]}
        line, goal = list(before), None
        for s in line:
            if left[s] > 0:
                goal = s
                break
            for q in takers[s]:
                for t in members[q]:
                    if t not in before:
                        before[t] = (q, s)
                        line.append(t)
        if goal is None:
            continue  # nothing that this pattern reaches has room, and room never comes back
        path, s = [], goal
        while s != -1:
            q, through = before[s]
            path.append((q, through, s))
            s = through
        words = min([spare, left[goal], *(routed[q, a] for q, a, _ in path if a != -1)])
        for q, a, b in path:
            push(q, b, words)
            if a != -1:
                push(q, a, -words)
        taken[p] += words
        left[goal] -= words
        heapq.heappush(starts, (level(p)[0], p))
    return Flow(taken, routed)


def _measured(df: DataFrame, sources: Column | None, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORDS)), F.lit(0)).cast("long")
    pattern = F.array(F.col("source")) if sources is None else sources
    return df.select("*", size.alias("size"), F.to_json(F.array_sort(F.array_distinct(pattern)), {"ignoreNullFields": "false"}).alias("pattern"), F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)).alias("draw"))


def mix(documents: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, seed: int = 11, sources: Column | None = None, keep: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row.

    sources: an array column of all sources of a row, if not its `source` alone; then source_size and
    target are sums over them.  weights: a dict by source, or a cycle over the sources in code-point
    order.  keep: the input's columns also stay, under their names, where these don't clash.
    """
    import json

    narrow = cut(_measured(pick(documents, doc_id="long", text="string", source="string") if sources is None else documents, sources, seed).select("pattern", "size", "draw"))
    found = narrow.groupBy("pattern").agg(F.sum("size").alias("size")).orderBy("pattern").limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"over {PATTERNS} membership patterns: name coarser sources")
    names = sorted({s for r in found for s in json.loads(r["pattern"])}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(names)}
    members = [[at[s] for s in json.loads(r["pattern"])] for r in found]
    weigh = [weights[s] if isinstance(weights, dict) else weights[i % len(weights)] for i, s in enumerate(names)]
    total = [0] * len(names)
    for r, own in zip(found, members, strict=True):
        for s in own:
            total[s] += r["size"]
    words = sum(r["size"] for r in found)
    # the shares are of all words; overlapping documents count once in that sum
    aim = targets(dict(enumerate(total)), dict(enumerate(weigh)), repeats) if sum(total) == words else _scaled(total, weigh, repeats, words)
    flow = min_cost_flow([r["size"] for r in found], members, [round(aim[i]) for i in range(len(names))], repeats)
    spark = documents.sparkSession
    plan = [
        (r["pattern"], t // r["size"] if r["size"] else 0, t % r["size"] if r["size"] else 0, sum(total[s] for s in own), float(sum(aim[s] for s in own)))
        for r, t, own in zip(found, flow.taken, members, strict=True)
    ]
    plan = spark.createDataFrame(plan, "pattern string, whole long, rest long, source_size long, target double")
    ends = _ends(narrow, plan)
    own = F.broadcast(spark.createDataFrame([tuple(r) for r in ends.collect()], ends.schema))
    base = documents if keep or sources is not None else pick(documents, doc_id="long", text="string", source="string")
    rows = _measured(base.drop("size", "pattern", "draw"), sources, seed).join(own, "pattern")
    # a pattern without a remainder, or without words, has no last draw
    copies = (F.col("whole") + F.coalesce(F.col("draw") <= F.col("last"), F.lit(False)).cast("long")).alias("copies")
    rows = rows.select("*", copies).withColumn("taken", F.col("copies") * F.col("size"))
    own_columns = ["size", "source_size", "target", "taken", "copies"]
    kept = [c for c in documents.columns if c not in own_columns] if keep else ["doc_id"]
    return rows.select(*kept, *own_columns)


def _scaled(total: list[int], weigh: list[int], repeats: int, words: int) -> dict:
    out = targets(dict(enumerate(total)), dict(enumerate(weigh)), repeats)
    scale = words / max(1, sum(total))
    return {s: t * scale for s, t in out.items()}


def _ends(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """`plan` with `last`: the largest draw of a pattern that still gets one more copy; null where none does."""
    width = (1 << 64) // BINS
    bins = F.shiftright(F.col("draw"), 64 - (BINS.bit_length() - 1)).alias("bin")  # signed, so bins are in the draws' order
    assert width * BINS == 1 << 64
    order = W.Window.partitionBy("pattern")
    small = F.broadcast(plan.filter("rest > 0").select("pattern", "rest"))
    sums = narrow.groupBy("pattern", bins).agg(F.sum("size").alias("size"))
    edge = sums.withColumn("start", F.sum("size").over(order.orderBy("bin")) - F.col("size")).join(small, "pattern").filter("start < rest and start + size >= rest").select("pattern", "bin", "start", "rest")
    # a pattern has one such bin, so `edge` has as many rows as `plan` at most
    inside = narrow.select("pattern", "draw", "size", bins).join(F.broadcast(edge), ["pattern", "bin"]).groupBy("pattern", "draw", "start", "rest").agg(F.sum("size").alias("size"))
    near = inside.withColumn("end", F.col("start") + F.sum("size").over(order.orderBy("draw")))
    # a draw is in if at least half of it is below the remainder; draws of earlier bins are in whole
    last = near.groupBy("pattern").agg(F.max(F.when(F.col("end") - F.col("size") / 2 <= F.col("rest"), F.col("draw"))).alias("in"), F.min("draw").alias("first"))
    out = plan.join(last, "pattern", "left")
    return out.select("pattern", "whole", "source_size", "target", F.coalesce("in", F.col("first") - 1).cast(T.LongType()).alias("last"))

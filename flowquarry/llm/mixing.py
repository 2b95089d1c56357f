"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are first aggregated by the set of sources they belong to. The flow
network has an arc per pattern and copy (capacity: the pattern's words; cost: the
number of the copy, so a second copy is only used where first ones run out), arcs
from a pattern to its sources, and an arc per source with its quota. The flow
fixes how many words each pattern gives to each source; documents are then
selected in a seeded random order.

Sums, targets and thresholds are tables, so there may be any number of sources. A
pattern of a single source that overlaps with no other needs no network: it gives
what its target asks. Only the patterns of sources that are connected by overlaps
meet, one row each, and their flow is found in one task per connected group. The
driver sees totals. Documents are never shuffled with their text for the
selection: it is turned into hash thresholds per pattern, and a document decides
for itself.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import WORD, discard, staged, unused
from flowquarry.llm.components import connected
from flowquarry.operators.ordered import arrange, row_numbers

Pattern = tuple[str | None, ...]


def word_count(text: Column) -> Column:
    """Words of a text; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_order(sources: Sequence[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def shared_targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """``total`` shared by weight; what exceeds ``most`` times a size is shared again among the others.

    The plain form for a short list; ``with_targets`` is the same for a table.
    """
    targets, free = [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if rest * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in free:
                targets[i] = rest * weights[i] / weight
            break
        for i in sorted(over):
            targets[i] = most * sizes[i]
            rest -= targets[i]
        free -= over
    return targets


def with_targets(sources: DataFrame, total: float, most: float) -> DataFrame:
    """``sources`` (``size``, ``weight``) with ``target``, as ``shared_targets``; an aggregate a round.

    A share only grows from round to round, so a source that was stopped stays so, and a round without a
    newly stopped one is the last.
    """
    bound = F.lit(most) * F.col("size")
    rest, weight = float(total), sources.agg(F.sum("weight")).first()[0] or 0.0
    stopped, over = 0, F.lit(False)
    while weight > 0:
        over = F.lit(rest) * F.col("weight") / F.lit(weight) > bound
        free = F.when(~over, F.col("weight"))
        found = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("size"))).alias("size"), F.sum(free).alias("weight")).first()
        if found["n"] == stopped:
            break
        stopped, rest, weight = found["n"], total - most * (found["size"] or 0), found["weight"] or 0.0
    share = F.lit(rest) * F.col("weight") / F.lit(weight) if weight > 0 else bound
    return sources.withColumn("target", F.when(over, bound).otherwise(share).cast("double"))


def flow(words: dict[Pattern, int], quotas: dict[str | None, int], copies: int) -> dict[tuple[Pattern, str | None], int]:
    """Words each pattern gives to each source: a maximum flow of least cost, the r-th copy of a word costing r.

    Successive shortest paths over the residual network; the number of paths is
    bounded by the arcs, not by the words, as a path fills at least one of them.
    """
    names = ["start", "end", *(("p", p) for p in words), *(("s", s) for s in quotas)]
    number = {n: i for i, n in enumerate(names)}
    arcs: list[list[int]] = []  # to, room, cost; arc i ^ 1 leads back
    out: list[list[int]] = [[] for _ in names]

    def arc(a: object, b: object, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out[number[x]].append(len(arcs))
            arcs.append([number[y], r, c])
        return len(arcs) - 2

    given = {}
    for pattern, size in words.items():
        for copy in range(1, copies + 1):
            arc("start", ("p", pattern), size, copy)
        for source in pattern:
            given[pattern, source] = arc(("p", pattern), ("s", source), copies * size, 0)
    for source, quota in quotas.items():
        arc(("s", source), "end", quota, 0)
    while True:
        cost: list[float] = [float("inf")] * len(names)
        by: list[int] = [-1] * len(names)
        cost[0], queue, waiting = 0, deque([0]), {0}
        while queue:
            node = queue.popleft()
            waiting.discard(node)
            for a in out[node]:
                to, room, step = arcs[a]
                if room > 0 and cost[node] + step < cost[to]:
                    cost[to], by[to] = cost[node] + step, a
                    if to not in waiting:
                        waiting.add(to)
                        queue.append(to)
        if by[1] < 0:
            break
        path, node = [], 1
        while node:
            path.append(by[node])
            node = arcs[by[node] ^ 1][0]
        room = min(arcs[a][1] for a in path)
        for a in path:
            arcs[a][1] -= room
            arcs[a ^ 1][1] += room
    return {k: arcs[a ^ 1][1] for k, a in given.items() if arcs[a ^ 1][1]}


_STRETCH = "pattern array<string>, source string, words long, begin long, end long"


def _connected_flow(copies: int):
    """The flow of one connected group of patterns and sources, as stretches of each pattern's copies."""
    names = [c.split()[0] for c in _STRETCH.split(", ")]

    def solve(patterns: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        found = {tuple(source_order(list(p))): int(n) for p, n in zip(patterns["pattern"], patterns["words"], strict=True)}
        words = {p: found[p] for p in sorted(found, key=lambda p: [(s is None, s or "") for s in p])}
        quotas = {s: int(q) for s, q in zip(sources["source"], sources["quota"], strict=True)}
        given, rows = flow(words, {s: quotas[s] for s in source_order(quotas)}, copies), []
        for p, n in words.items():
            at = 0
            for s in p:
                amount = given.get((p, s), 0)
                if amount:
                    rows.append((list(p), s, n, at, at + amount))
                at += amount
        return pd.DataFrame(rows, columns=names)

    return solve


def _stretches(sums: DataFrame, members: DataFrame, sources: DataFrame, copies: int) -> DataFrame:
    """Which words of which copies of a pattern go to which source."""
    sources = sources.withColumn("quota", F.rint("target").cast("long"))
    wide = members.where(F.size("pattern") > 1).select("pattern", "source")
    if wide.isEmpty():
        alone = sources
    else:
        number = wide.join(sources.select(F.col("source").alias("s"), "rn"), F.col("source").eqNullSafe(F.col("s"))).select("pattern", "rn")
        ends = number.withColumn("a", F.min("rn").over(Window.partitionBy("pattern")))
        groups = connected(ends, "a", "rn")
        sources = staged(sources.join(groups.withColumnRenamed("node", "rn"), "rn", "left"), "grouped")
        discard(groups)
        alone = sources.where("label IS NULL")
    # A source of its own: its single pattern gives what it is asked, the first copy first.
    plain = alone.select(
        F.array("source").alias("pattern"), "source", F.col("size").alias("words"), F.lit(0).cast("long").alias("begin"),
        F.least("quota", F.col("size") * copies).alias("end"),
    )
    if alone is sources:
        return plain
    first = sums.where(F.size("pattern") > 0).withColumn("s", F.col("pattern")[0])
    linked = sources.where("label IS NOT NULL")
    patterns = first.join(linked.select("source", "label"), F.col("s").eqNullSafe(F.col("source")))
    patterns = patterns.select(F.col("label").alias("of"), "pattern", "words")
    quotas = linked.select("label", "source", "quota")
    return plain.unionByName(patterns.groupBy("of").cogroup(quotas.groupBy("label")).applyInPandas(_connected_flow(copies), _STRETCH))


def _order(docs: DataFrame, seed: int) -> Column:
    """Place of a document in the seeded order; rows without doc_id are told apart by their text."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text")))


def mix(
    docs: DataFrame, sources: Column, weights: Sequence[float] = (3, 1, 2), total: float = 1.5, copies: int = 2, seed: int = 1
) -> DataFrame:
    """``docs`` with ``size``, ``homes`` (the source each of its copies goes to) and ``targets`` (struct by source).

    ``sources`` is an array of the sources a document belongs to; null elements are
    a source of their own, a null or empty array belongs to none. Weights repeat
    over the sources ordered by code point, null last. The targets share ``total``
    times the words of all documents, and stop at ``copies`` times the words of
    their source. A source's words come within half a document per pattern of its
    flow, no document is taken more than ``copies`` times, and reruns agree:
    repeated rows share their fate. Empty texts have size 0. Columns of ``docs``
    keep their names; the new ones are put in a struct column ``mixed``
    (``mixed_``, ... if the name is taken).
    """
    mixed = unused("mixed", docs.columns)
    pattern = F.coalesce(F.array_sort(F.array_distinct(sources)), F.array().cast("array<string>"))
    narrow = staged(
        docs.select(pattern.alias("pattern"), word_count(F.col("text")).alias("size"), _order(docs, seed).alias("h")), "sizes"
    )
    sums = staged(narrow.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "patterns")
    all_docs = sums.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs")).first()
    members = sums.select("pattern", "words", F.explode("pattern").alias("source"))
    facts = members.groupBy("source").agg(F.sum("words").alias("size"))
    ranked = row_numbers(arrange(facts, F.col("source").isNull(), "source")).select("source", "size", "rn")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("rn") - 1) % len(weights) + 1).cast("int")))
    ranked = staged(ranked, "sources")
    named = staged(with_targets(ranked, total * all_docs["words"], copies), "targets")
    discard(ranked)
    given = staged(_stretches(sums, members, named, copies), "stretches")
    # A stretch within one copy, in words from the start of the pattern's seeded order.
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
    from_, to = F.greatest("begin", F.col("copy") * F.col("words")), F.least("end", (F.col("copy") + 1) * F.col("words"))
    table = given.select("*", copy).select("pattern", "source", "copy", "words", from_.alias("first"), to.alias("last")).where("first < last")
    offset = F.col("copy") * F.col("words")
    table = table.select("pattern", "source", (F.col("first") - offset).alias("first"), (F.col("last") - offset).alias("last"),
                         (F.col("last") - offset == F.col("words")).alias("whole"))

    # Start of each document in its pattern's order: sums of earlier blocks of hashes, plus those before it in its block.
    # As many blocks as documents in one: neither windows over blocks nor windows within a block get long.
    blocks = max(1, math.isqrt(all_docs["docs"]))
    block = F.shiftright(F.col("h"), 33) + F.lit(1 << 30)  # 0 to 2^31 - 1, in the order of h
    placed = narrow.withColumn("block", F.floor(block * F.lit(float(blocks)) / F.lit(float(1 << 31))).cast("long"))
    earlier = placed.groupBy("pattern", "block").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("pattern").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = earlier.select("pattern", "block", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("pattern", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    starts = starts.join(earlier, ["pattern", "block"])
    middle = F.col("before") + F.col("start") + F.col("size") / 2
    cuts = table.where("not whole").select("pattern", F.col("last").alias("cut")).distinct()
    cuts = starts.join(cuts, "pattern").groupBy("pattern", "cut").agg(F.max(F.when(middle < F.col("cut"), F.col("h"))).alias("h"))
    # A stretch holds the hashes above its lower and up to its upper threshold; none of a pattern's may lie below a cut.
    lowest = F.lit(-(2**63))
    low = cuts.select("pattern", F.col("cut").alias("first"), F.coalesce("h", lowest).alias("low"))
    high = cuts.select("pattern", F.col("cut").alias("last"), F.coalesce("h", lowest).alias("high"))
    ranges = table.join(low, ["pattern", "first"], "left").join(high, ["pattern", "last"], "left")
    ranges = ranges.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("first", "last", "source", "low", "high"))).alias("ranges"))
    kind = "array<struct<source:string,size:bigint,target:double>>"
    fact = F.struct(F.col("s").isNull().alias("last"), F.col("s").alias("source"), F.col("size"), F.col("target"))
    told = members.join(named.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    told = told.groupBy("pattern").agg(F.array_sort(F.collect_list(fact)).alias("targets"))
    told = told.withColumn("targets", F.transform("targets", lambda t: t.dropFields("last")).cast(kind))
    ranges = staged(told.join(ranges, "pattern", "left").select("pattern", F.struct("ranges", "targets").alias("told")), "thresholds")
    discard(narrow, sums, named, given)

    key, mine, hit = (unused(n, [*docs.columns, mixed]) for n in ("_pattern", "_ranges", "_h"))
    out = docs.withColumn(key, pattern).withColumn(hit, _order(docs, seed))
    out = out.join(ranges.toDF(key, mine), key, "left")
    homes = F.transform(
        F.filter(
            F.col(mine)["ranges"],
            lambda r: (r["low"].isNull() | (F.col(hit) > r["low"])) & (r["high"].isNull() | (F.col(hit) <= r["high"])),
        ),
        lambda r: r["source"],
    )
    targets = F.coalesce(F.col(mine)["targets"], F.array().cast(kind))
    struct = F.struct(
        word_count(F.col("text")).alias("size"), F.coalesce(homes, F.array().cast("array<string>")).alias("homes"),
        targets.alias("targets"),
    )
    return out.withColumn(mixed, struct).select(*docs.columns, mixed)


def take(docs: DataFrame, sources: Column, **settings) -> DataFrame:
    """The mix itself: every document once per copy taken, with the columns of ``docs``; untaken ones go."""
    name = unused("mixed", docs.columns)
    made = mix(docs, sources, **settings)
    home = unused("home", made.columns)
    return made.withColumn(home, F.explode(f"{name}.homes")).select(*docs.columns)

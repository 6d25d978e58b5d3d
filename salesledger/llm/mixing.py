"""Mixing sources to target weights by min-cost flow.

Documents are added up by membership pattern (the set of sources that hold them). A flow routes the words of each
pattern to the quotas of its sources; the first use of a pattern is free, and every further use costs more (convex
repetition costs), so that scarce sources repeat only after shared documents have been used. The graph has one node for
each pattern and source, whatever the number of documents. Documents are then chosen inside each pattern in the order of
a seeded hash; the last one chosen is taken in part, so that quotas are met to the word.

Running sums are never taken over a whole pattern: words are first added up in hash bins, and only the bin in which the
quota ends is ordered.

Patterns that share no source, not even through others, have nothing to settle with each other: each connected component of the graph is a
network of its own, solved in a task (mix_overlapping for any membership; mix_sources, of the registered queries, where every
document has one source and so every source is a network). Quotas are joined by a shuffle, or sent to all tasks up to MAX_PATTERNS. One
network is never split: a task holds the patterns and sources of it, and no documents. mix_to_targets and mix_documents are the same for few
patterns: they solve one network on the driver and refuse more than MAX_PATTERNS.

Defined cases: null text or size counts 0 words and is taken 0 times; a null source is a source of its own, last in order;
repeated rows are chosen each on its own, ties in the hash (of id and text, if there is a text) are settled by id, size and text; an empty table gives an empty table.
Input columns that share a name with a result column are replaced by the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesledger.llm.graph import components
from salesledger.llm.storage import checkpointed, written

#: Membership patterns (and so sources) that a flow network on the driver may have, and quotas of patterns that are sent to all tasks.
MAX_PATTERNS = 20_000
BINS = 1 << 12
MARK = "_mark"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: dict, weights: dict, budget: Fraction, cap: int = 2) -> dict:
    """Shares of the budget by weight; whoever would exceed cap times its size stops there and the rest is shared again."""
    out, open_ = {}, list(sizes)
    while open_:
        left = budget - sum(out.values())
        whole = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / whole > cap * sizes[s]]
        if not full:
            return out | {s: left * weights[s] / whole for s in open_}
        out |= {s: Fraction(cap * sizes[s]) for s in full}
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(patterns: list[tuple[int, list[int]]], quotas: list[int], repeats: int) -> list[dict[int, int]]:
    """For each pattern (words, members) the words it gives to each source; the k-th use of a pattern costs k - 1.

    Cheapest paths are augmented one after another, with potentials that keep reduced costs at zero or more.
    """
    source, p0, s0 = 0, 1, 1 + len(patterns)
    sink = s0 + len(quotas)
    graph: list[list[list[int]]] = [[] for _ in range(sink + 1)]  # to, room, cost, place of the reverse arc

    def arc(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, (size, members) in enumerate(patterns):
        for use in range(repeats):
            arc(source, p0 + p, size, use)
        for s in members:
            arc(p0 + p, s0 + s, size * repeats, 0)
    for s, quota in enumerate(quotas):
        arc(s0 + s, sink, quota, 0)
    potential = [0] * len(graph)
    while True:
        far, back = [None] * len(graph), [None] * len(graph)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                e = d + cost + potential[a] - potential[b]
                if room and (far[b] is None or e < far[b]):
                    far[b], back[b] = e, (a, k)
                    heapq.heappush(heap, (e, b))
        if far[sink] is None:
            break
        potential = [v + (d if d is not None else far[sink]) for v, d in zip(potential, far)]
        path, b = [], sink
        while b != source:
            path.append(back[b])
            b = back[b][0]
        room = min(graph[a][k][1] for a, k in path)
        for a, k in path:
            graph[a][k][1] -= room
            b, _, _, r = graph[a][k]
            graph[b][r][1] += room
    return [{b - s0: graph[b][r][1] for b, _, _, r in graph[p0 + p] if s0 <= b < sink and graph[b][r][1]} for p in range(len(patterns))]


def _routed(networks: DataFrame, repeats: int) -> DataFrame:
    """`networks` and flow: the words that each of its patterns (m, words) gives to its quotas (s, quota) on the cheapest way."""
    schema = T.StructType([*networks.schema.fields, T.StructField("flow", T.ArrayType(T.LongType()))])
    names = schema.names
    p, q = names.index("patterns"), names.index("quotas")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flows = []
            for patterns, quotas in zip(batch.column(p), batch.column(q)):
                wanted = quotas.as_py() or []
                place = {x["s"]: k for k, x in enumerate(wanted)}
                nets = [(x["words"] or 0, [place[s] for s in dict.fromkeys(x["m"] or ()) if s in place]) for x in patterns.as_py()]
                flows.append([sum(f.values()) for f in min_cost_flow(nets, [x["quota"] for x in wanted], repeats)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flows, pa.list_(pa.int64()))], names)

    return networks.mapInArrow(solve, schema)


def _networks(patterns: DataFrame, quotas: DataFrame) -> DataFrame:
    """A row for each connected component: patterns (m, words) and quotas (s, quota), both in order."""
    node = lambda name: F.xxhash64(name.isNull(), name)  # noqa: E731  (of equal hashes, two networks are solved as one)
    patterns = patterns.withColumn("_node", node(F.get("m", F.lit(0))))
    quotas = quotas.withColumn("_node", node(F.col("s")))
    links = patterns.select(F.col("_node").alias("u"), F.explode("m").alias("s")).select("u", node(F.col("s")).alias("v"))
    label = components(links)

    def gathered(frame: DataFrame, columns: tuple[str, str], name: str) -> DataFrame:
        frame = frame.join(label, F.col("_node") == F.col("node"), "left").withColumn("_network", F.coalesce("label", "_node"))
        return frame.groupBy("_network").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    return gathered(patterns, ("m", "words"), "patterns").join(gathered(quotas, ("s", "quota"), "quotas"), "_network", "left")


def mix_overlapping(
    docs: DataFrame, targets: DataFrame, members: str, size: str, doc: str = "doc_id", repeats: int = 2, seed: int = 7
) -> DataFrame:
    """`docs` with `taken`, the words that the mix takes of each document, for any number of sources and patterns.

    `targets` has the words wanted (quota) of each source (s). members is an array of sources; its order and repeats don't matter, and
    documents without a source of targets are taken 0 times.
    """
    made = ["taken"]
    keep = [c for c in docs.columns if c not in made]
    rows = checkpointed(docs.select(*keep).withColumn("_m", F.array_sort(F.array_distinct(members))))
    patterns = checkpointed(rows.groupBy(F.col("_m").alias("m")).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("words")))
    flows = _routed(_networks(patterns, targets.select("s", F.col("quota").cast("long"))), repeats)
    each = flows.select(F.inline(F.arrays_zip(F.col("patterns").alias("p"), F.col("flow").alias("want")))).select("p.m", "p.words", "want")
    wanted = checkpointed(_copies(each))
    few = len(wanted.select("_copies").take(MAX_PATTERNS + 1)) <= MAX_PATTERNS
    rows = rows.withColumnRenamed("_m", "_pattern")
    plan = _cuts(rows, wanted, "_pattern", size, doc, seed, few)
    return _taken(rows, plan, "_pattern", F.coalesce(F.col(size), F.lit(0)), doc, seed, few).select(*keep, "taken")


def _place(seed: int, doc: str, columns: list[str]) -> Column:
    """A seeded place of a document in [0, 2^62), by its id and the mark of its text, if it has one."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc), *(F.col(c) for c in columns if c == MARK)), 2)


def pattern_sizes(docs: DataFrame, members: str, size: str) -> list[tuple[list, int]]:
    """(members, words) of each pattern, refused above MAX_PATTERNS."""
    rows = docs.groupBy(members).agg(F.sum(size).alias("_words")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    order = lambda m: [(x is None, x or "") for x in m]
    return sorted(((list(r[0]), int(r["_words"] or 0)) for r in rows), key=lambda r: order(r[0]))


def mix_to_targets(
    docs: DataFrame, targets: dict, sizes: list[tuple[list, int]], members: str, size: str, doc: str = "doc_id", repeats: int = 2, seed: int = 7
) -> DataFrame:
    """`docs` with `taken`: the words that the mix takes of each document, repeats counted.

    `targets` gives the words wanted of each source, `sizes` comes from pattern_sizes over the same rows.
    """
    spark = docs.sparkSession
    names = list(targets)
    place = {s: k for k, s in enumerate(names)}
    nets = [(n, [place[s] for s in dict.fromkeys(m) if s in place]) for m, n in sizes]
    flows = min_cost_flow(nets, [int(targets[s]) for s in names], repeats)
    quota = [(m, n, sum(f.values())) for (m, n), f in zip(sizes, flows)]
    wanted = _copies(spark.createDataFrame(quota, "m array<string>, words long, want long"))
    plain = docs.select(*(c for c in docs.columns if c != "taken"))
    plan = _cuts(plain, wanted, members, size, doc, seed, True)
    words = F.coalesce(F.col(size), F.lit(0))
    return _taken(plain, plan, members, words, doc, seed, True).select(*plain.columns, "taken")


def _copies(quotas: DataFrame, *more: Column | str) -> DataFrame:
    """(m, words, want) with _copies, how often everything in m is used, and _rest, the words beyond that; and more."""
    copies = F.expr("CASE WHEN words > 0 THEN want div words ELSE 0 END")
    return quotas.select("m", *more, copies.cast("long").alias("_copies"), (F.col("want") - copies * F.col("words")).cast("long").alias("_rest"))


def _placed(docs: DataFrame, doc: str, seed: int) -> DataFrame:
    return docs.withColumn("_place", _place(seed, doc, docs.columns)).withColumn("_bin", F.floor(F.col("_place") / F.lit((1 << 62) // BINS)))


def _sent(frame: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(frame) if few else frame


def _cuts(rows: DataFrame, wanted: DataFrame, members: str, size: str, doc: str, seed: int, few: bool) -> DataFrame:
    """`wanted` with the bin in which the rest ends and the words before it. few: it may be sent to all tasks."""
    bins = _placed(rows, doc, seed).groupBy(F.col(members).alias("m"), F.col("_bin").alias("b")).agg(F.sum(size).alias("words"))
    upto = F.sum("words").over(Window.partitionBy("m").orderBy("b"))
    bins = bins.select("m", "b", "words", (upto - F.col("words")).alias("before"))
    ends = bins.alias("x").join(_sent(wanted, few).alias("w"), F.col("x.m").eqNullSafe(F.col("w.m")))
    inside = (F.col("before") <= F.col("_rest")) & (F.col("_rest") < F.col("before") + F.col("words"))
    ends = ends.where(inside).groupBy(F.col("x.m").alias("m")).agg(F.max("b").alias("_cut"), F.max("before").alias("_before"))
    return wanted.join(ends, wanted["m"].eqNullSafe(ends["m"]), "left").select(wanted["m"].alias("_m"), *(c for c in wanted.columns if c != "m"), "_cut", "_before")


def _taken(docs: DataFrame, plan: DataFrame, members: str, words: Column, doc: str, seed: int, few: bool) -> DataFrame:
    """`docs` and the columns of their plan, with _words and `taken`; only documents of the bin in which a quota ends are ordered."""
    joined = _placed(docs, doc, seed).join(_sent(plan, few), F.col(members).eqNullSafe(F.col("_m")), "left")
    if not few:
        joined = written(joined, "placed", drop_shuffles=True)  # shuffled once, read twice
    full, n = F.coalesce(F.col("_copies"), F.lit(0)) * F.col("_words"), F.col("_words")
    plainly = joined.where(~F.col("_bin").eqNullSafe(F.col("_cut"))).withColumn("_words", words)
    plainly = plainly.withColumn("taken", (full + F.when(F.col("_bin") < F.coalesce("_cut", F.lit(0)), n).otherwise(0)).cast("long"))
    ordered = joined.where(F.col("_bin") == F.col("_cut")).withColumn("_words", words)
    order = Window.partitionBy("_m").orderBy("_place", F.col(doc), "_words", *(c for c in docs.columns if c == MARK)).rowsBetween(Window.unboundedPreceding, 0)
    done = F.col("_before") + F.sum(n).over(order) - n
    return plainly.unionByName(ordered.withColumn("taken", (full + F.least(n, F.greatest(F.col("_rest") - done, F.lit(0)))).cast("long")))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), repeats: int = 2, seed: int = 7) -> DataFrame:
    """Documents (doc_id, text, source) with size, source_size, target and taken; weights repeat over the ordered sources."""
    made = ["size", "source_size", "target", "taken"]
    keep = [c for c in docs.columns if c not in {*made, "text"}]
    rows = docs.select(*keep, word_count(F.col("text")).alias("size"), F.array("source").alias("_members"), F.xxhash64("text").alias(MARK))
    rows = checkpointed(rows)
    sizes = pattern_sizes(rows, "_members", "size")
    names = [m[0] for m, _ in sizes]
    by = {m[0]: n for m, n in sizes}
    targets = water_fill(by, {s: weights[k % len(weights)] for k, s in enumerate(names)}, share * sum(by.values()), repeats)
    mixed = mix_to_targets(rows, targets, sizes, "_members", "size", repeats=repeats, seed=seed)
    table = docs.sparkSession.createDataFrame([(s, by[s], float(targets[s])) for s in names], "_s string, source_size long, target double")
    mixed = mixed.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_s")), "left")
    return mixed.select(*keep, *made)


def source_quotas(rows: DataFrame, weights: tuple[int, ...], share: Fraction, cap: int) -> tuple[DataFrame, int]:
    """(m, source_size, target, _copies, _rest) of each source of rows (source, size), and how many there are.

    What water_fill gives, by sums of sources of each weight, which are all that the driver sees; and the flow of the network of each
    source, which is all that its documents belong to.
    """
    sizes = rows.groupBy(F.col("source").alias("m")).agg(F.sum("size").alias("words"))
    numbered = checkpointed(sizes.orderBy(F.asc_nulls_last("m")).withColumn("_id", F.monotonically_increasing_id()))
    task = F.shiftright("_id", 33)
    counts = numbered.groupBy(task.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # a row for each task
    n_sources, starts = 0, []
    for r in counts:
        starts.append((r["p"], n_sources % len(weights)))
        n_sources += r["n"]
    starts = numbered.sparkSession.createDataFrame(starts, "_p long, _start int")
    kind = F.pmod(F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1), F.lit(len(weights))).cast("int")
    sources = checkpointed(numbered.join(F.broadcast(starts), task == F.col("_p")).select("m", "words", kind.alias("_kind")))

    by_kind = lambda values, k: F.get(F.array(*(F.lit(v).cast(k) for v in values)), F.col("_kind"))
    level, below = Fraction(0), [0] * len(weights)  # words for a weight of 1; sources smaller than this stop at cap times their size
    budget = None
    while True:
        full = F.col("words") < by_kind(below, "long")
        sums = sources.groupBy("_kind").agg(
            F.sum("words").alias("words"), F.sum(F.when(full, F.col("words")).otherwise(0)).alias("full"), F.sum((~full).cast("long")).alias("open")
        ).collect()
        budget = share * sum(int(r["words"]) for r in sums) if budget is None else budget
        whole = sum(weights[r["_kind"]] * r["open"] for r in sums)
        if not whole:
            break
        level = (budget - cap * sum(int(r["full"]) for r in sums)) / whole
        before, below = below, [ceil(level * w / cap) for w in weights]
        if below == before:
            break
    most = F.col("words") * cap
    target = F.when(full, most.cast("double")).otherwise(by_kind([float(level * w) for w in weights], "double"))
    quota = F.when(full, most).otherwise(by_kind([int(level * w) for w in weights], "long")).cast("long")
    pattern = F.struct(F.array("m").alias("m"), "words")
    networks = sources.select(
        "m", "words", target.alias("target"), F.array(pattern).alias("patterns"), F.array(F.struct(F.col("m").alias("s"), quota.alias("quota"))).alias("quotas")
    )
    wanted = _copies(_routed(networks, cap).withColumn("want", F.get("flow", F.lit(0))), "target", F.col("words").alias("source_size"))
    return checkpointed(wanted), n_sources


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), repeats: int = 2, seed: int = 7, texts: bool = False
) -> DataFrame:
    """What mix_documents gives, for any number of sources; texts: with the text of each document."""
    made = ["size", "source_size", "target", "taken"]
    keep = [c for c in docs.columns if c not in {*made, "text"}]
    mark = F.xxhash64("text").alias(MARK)
    rows = checkpointed(docs.select(*(["doc_id", "source"] if texts else keep), word_count(F.col("text")).alias("size"), mark))
    quotas, n_sources = source_quotas(rows, weights, share, repeats)
    few = n_sources <= MAX_PATTERNS
    plan = _cuts(rows, quotas, "source", "size", "doc_id", seed, few)
    if texts:
        keep = [c for c in docs.columns if c not in made]
        mixed = _taken(docs.select(*keep, mark), plan, "source", word_count(F.col("text")), "doc_id", seed, few)
    else:
        mixed = _taken(rows, plan, "source", F.col("size"), "doc_id", seed, few)
    return mixed.select(*keep, F.col("_words").alias("size"), "source_size", "target", "taken")

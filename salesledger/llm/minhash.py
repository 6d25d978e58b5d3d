"""Near-duplicate detection by banded MinHash with sequential Bayesian verification.

1. A pass over the texts makes the set of word shingles, its 128-bit digest and its MinHash signature. Documents with
   equal sets are one node from here on.
2. Bands of the signature put nodes into buckets. Each bucket has one centre, the member with the fullest buckets, and
   every member is paired with it: as many pairs as members.
3. A pair's signatures are compared batch by batch. After each batch the pair is dropped if the posterior probability
   that its similarity reaches the threshold (uniform prior, so a binomial tail) is below the chosen miss probability.
4. Survivors are verified on their full sets.
5. Members that ended outside their centre's component may still link with each other. They and the members of their stars are
   joined by prefix filtering: two sets that reach the threshold share one of the rarest few shingles of each, rarest by
   the number of these sets that hold it. So what a template repeats on every page brings no two of its pages together.
   Members that share such a shingle with another component are compared with all such members of their stars, in square tiles,
   by the same batches and the same verification. No link inside a bucket is lost. Finding these members is linear; a star in
   which very many of them share rare shingles and yet don't link still costs the square of their number.
6. Components of the verified links give each document its class.

Defined cases: a text with fewer words than a shingle is one shingle; without words (null, empty, blank) it has no set and is its own
class; rows may repeat and ids may repeat or be null: a class is named by its smallest id that isn't null; an empty table gives an
empty table. Input columns that share a name with a result column are replaced by the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesledger.llm import textops as ops
from salesledger.llm.graph import components
from salesledger.llm.storage import checkpointed, written

PIECE_BYTES = 1 << 20
#: Most outsiders and most members in a tile, about.
TILE = 128


@dataclass(frozen=True)
class Plan:
    """Shingle length, threshold, signature layout and the probability of missing a pair in one comparison."""

    words: int = 5
    threshold: Fraction = Fraction(4, 5)
    bands: int = 25
    rows: int = 5
    hashes: int = 128
    batch: int = 32
    miss: float = 1e-6
    seed: int = 1

    def least_matches(self) -> list[tuple[int, int]]:
        """After n compared hashes, the fewest matches with which a pair goes on.

        With m matches of n and a uniform prior, P(similarity >= t) is P(Binomial(n + 1, t) <= m).
        """
        t, out = float(self.threshold), []
        for n in range(self.batch, self.hashes + 1, self.batch):
            tail, m = 0.0, -1
            while tail < self.miss:
                m += 1
                tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def shingles(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted inside each text, and the offsets of the texts."""
    low = ops.LOWER[data]
    starts, ends, first = ops.words(low, offs)
    h = ops.hashes(low, starts, ends)
    count = np.diff(first)
    keys, at = ops.grams(h, first, n)
    text = np.repeat(np.arange(len(count)), count)[at]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k, odd in enumerate(ops.odd_numbers(n, n + 100)):
            has = count[short] > k
            whole[has] += h[first[short[has]] + k] * odd
        keys, text = np.concatenate([keys, ops.mix(whole + count[short].astype(np.uint64))]), np.concatenate([text, short])
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    keys, text = keys[new], text[new]
    return keys, np.searchsorted(text, np.arange(len(count) + 1))


def sketch(keys: np.ndarray, offs: np.ndarray, hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size, 16-byte digest and signature (one row for each text that has a set, in order)."""
    size = np.diff(offs)
    full = np.flatnonzero(size)
    digest, sig = np.zeros((len(full), 2), np.uint64), np.zeros((len(full), hashes), np.uint32)
    if len(full):
        at = offs[full]
        for k, salt in enumerate(ops.odd_numbers(2, seed + 1000)):
            digest[:, k] = np.add.reduceat(ops.mix(keys + salt), at)
        work = np.empty_like(keys)
        for k, odd in enumerate(ops.odd_numbers(hashes, seed)):
            np.multiply(keys, odd, out=work)
            sig[:, k] = (np.minimum.reduceat(work, at) >> np.uint64(32)).astype(np.uint32)
    return size, digest, sig


def sketches(docs: DataFrame, plan: Plan, text: str = "text") -> DataFrame:
    """`docs` without the text, with n_shingles, _key (of id and text), _digest and _sig (null without a set)."""
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.xxhash64("doc_id", text).alias("_key"), F.col(text).alias("_text"))
    extra = [("n_shingles", T.LongType()), ("_digest", T.BinaryType()), ("_sig", T.BinaryType())]
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(*x) for x in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            data, offs = ops.flat(whole.column(whole.num_columns - 1))
            for a, b in ops.pieces(offs, PIECE_BYTES):
                keys, first = shingles(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], plan.words)
                size, digest, sig = sketch(keys, first, plan.hashes, plan.seed)
                d, s = [None] * (b - a), [None] * (b - a)
                for row, k in enumerate(np.flatnonzero(size).tolist()):
                    d[k], s[k] = digest[row].tobytes(), sig[row].tobytes()
                cols = [pa.array(size, pa.int64()), pa.array(d, pa.binary()), pa.array(s, pa.binary())]
                yield pa.RecordBatch.from_arrays([*whole.slice(a, b - a).columns[:-1], *cols], schema.names)

    return rows.mapInArrow(run, schema)


def _signatures(column: pa.Array) -> np.ndarray:
    data, offs = ops.flat(column)
    return data.view(np.uint32).reshape(len(offs) - 1, -1)


def go_on(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Indexes of the pairs of signature rows that no batch prunes."""
    live, done, got = np.arange(len(a)), 0, np.zeros(len(a), np.int64)
    for n, least in steps:
        got[live] += (a[live, done:n] == b[live, done:n]).sum(axis=1)
        live, done = live[got[live] >= least], n
    return live


def _pruned(pairs: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (u, v, su, sv) whose signatures pass every batch."""
    steps = plan.least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            live = go_on(_signatures(b.column(2)), _signatures(b.column(3)), steps) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(live)) for k in (0, 1)], ["u", "v"])

    return pairs.select("u", "v", "su", "sv").mapInArrow(run, "u binary, v binary")


def _verified(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (u, v) whose full sets reach the threshold; texts has (_digest, _text)."""
    num, den = plan.threshold.numerator, plan.threshold.denominator
    one = texts.select(F.col("_digest").alias("_a"), F.col("_text").alias("_ta"))
    two = texts.select(F.col("_digest").alias("_b"), F.col("_text").alias("_tb"))
    rows = pairs.join(one, F.col("u") == F.col("_a")).join(two, F.col("v") == F.col("_b")).select("u", "v", "_ta", "_tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = [ops.flat(whole.column(k)) for k in (2, 3)]
            good = [np.zeros(0, np.int64)]
            for a, b in ops.pieces(texts[0][1] + texts[1][1], 2 * PIECE_BYTES):
                sets = [shingles(d[o[a] : o[b]], o[a : b + 1] - o[a], plan.words) for d, o in texts]
                size = [np.diff(o) for _, o in sets]
                rows = [np.repeat(np.arange(b - a), s) for s in size]
                keys, row = np.concatenate([sets[0][0], sets[1][0]]), np.concatenate(rows)
                order = np.lexsort((keys, row))
                keys, row = keys[order], row[order]
                same = (keys[1:] == keys[:-1]) & (row[1:] == row[:-1])
                both = np.bincount(row[1:][same], minlength=b - a)
                good.append(a + np.flatnonzero(den * both >= num * (size[0] + size[1] - both)))
            take = pa.array(np.concatenate(good))
            yield pa.RecordBatch.from_arrays([whole.column(k).take(take) for k in (0, 1)], ["u", "v"])

    return rows.mapInArrow(run, "u binary, v binary")


def _token_sets(involved: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """(node, label, outsider, tokens): the distinct shingles of each involved node."""
    rows = involved.join(texts, F.col("node") == F.col("_digest")).select("node", "label", "outsider", "_text")
    names = ["node", "label", "outsider", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            data, offs = ops.flat(whole.column(3))
            for a, b in ops.pieces(offs, PIECE_BYTES):
                keys, first = shingles(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], plan.words)
                tokens = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*whole.slice(a, b - a).columns[:3], tokens], names)

    return rows.mapInArrow(run, "node binary, label binary, outsider boolean, tokens array<bigint>")


def _rare_tokens(sets: DataFrame, plan: Plan) -> DataFrame:
    """(token, node, label, outsider, short): of each set the rarest tokens, as many as a set of the same threshold must
    meet, without those that no other set holds. A set as large or larger must meet one of the fewer `short` ones.

    Tokens go by the number of sets that hold them, then by value: one order for all sets. Two sets x and y of similarity t
    share t / (1 + t) * (|x| + |y|) tokens, that is t * |x| of the larger and 2 t / (1 + t) * |y| of the smaller one, so they
    share a token among the first |x| - t * |x| + 1 and |y| - 2 t / (1 + t) * |y| + 1.
    """
    num, den = plan.threshold.numerator, plan.threshold.denominator
    held = sets.select(F.explode("tokens").alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    size = F.size("tokens").cast("long").alias("size")
    rows = sets.select("node", "label", "outsider", size, F.explode("tokens").alias("token")).join(held, F.col("token") == F.col("_t"))
    each = rows.groupBy("node", "label", "outsider", "size").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    # The size - len(shared) tokens of the set alone come first in the order and can meet nothing.
    long, short = (f"cast(size(shared) - ({n} * size + {d - 1}) div {d} + 1 as int)" for n, d in ((num, den), (2 * num, num + den)))
    each = each.withColumn("long", F.expr(long)).where("long > 0")
    tokens = F.posexplode(F.slice("shared.token", F.lit(1), F.col("long"))).alias("at", "token")
    return each.select(tokens, "node", "label", "outsider", F.expr(short).alias("first")).select(
        "token", "node", "label", "outsider", (F.col("at") < F.col("first")).alias("short")
    )


def _inner_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """Links (u, v) between an outsider and another member of its star. members: centre, node, label, middle.

    Members that share no rare token with another component are left out first. Of the others outsiders and members of a star
    are dealt to blocks, and each pair of blocks is a tile: no task sees a whole star. A tile prunes by signatures, verifies on
    full sets and returns one link of an outsider to each component it meets.
    """
    out = F.col("label") != F.col("middle")
    stars = members.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.max(out).alias("any"))
    stars = stars.where(F.col("any") & (F.col("n") > 2)).select(F.col("centre").alias("_c"))
    rows = members.where(F.col("node") != F.col("centre")).join(stars, F.col("centre") == F.col("_c"))
    involved = rows.groupBy("node", "label").agg(F.max(out).alias("outsider"))
    rare = written(_rare_tokens(written(_token_sets(involved, texts, plan), "tokens"), plan), "rare")
    mixed = rare.groupBy(F.col("token").alias("_t")).agg((F.max("outsider") & F.max("short") & (F.min("label") != F.max("label"))).alias("mixed"))
    live = rare.join(mixed.where("mixed"), F.col("token") == F.col("_t")).select(F.col("node").alias("_live")).distinct()
    rows = checkpointed(rows.join(live, F.col("node") == F.col("_live")).select("centre", "node", "label", "middle"))

    counts = rows.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.sum(out.cast("long")).alias("n_out"))
    counts = counts.where("n_out > 0 and n > 1").select(F.col("centre").alias("_c"), "n", "n_out")
    rows = rows.join(counts, F.col("centre") == F.col("_c"))
    rows = rows.join(nodes.select(F.col("_digest").alias("_d"), "_sig"), F.col("node") == F.col("_d"))
    rows = rows.join(texts.select(F.col("_digest").alias("_t"), "_text"), F.col("node") == F.col("_t"))
    blocks = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    mine = lambda c: F.pmod(F.xxhash64("node"), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    left = rows.where(out).select("centre", mine("n_out").alias("o"), every("n").alias("m"), F.lit(True).alias("outsider"), "node", "label", "_sig", "_text")
    right = rows.select("centre", every("n_out").alias("o"), mine("n").alias("m"), F.lit(False).alias("outsider"), "node", "label", "_sig", "_text")
    steps, n = plan.least_matches(), plan.words
    num, den = plan.threshold.numerator, plan.threshold.denominator

    def compare(table: pa.Table) -> pa.Table:
        side = np.array(table.column("outsider").to_pylist(), bool)
        node, label = (np.array(table.column(c).to_pylist(), object) for c in ("node", "label"))
        sig = _signatures(table.column("_sig"))
        keys, offs = shingles(*ops.flat(table.column("_text")), n)
        size = np.diff(offs)
        inside, links = np.flatnonzero(~side), set()
        for k in np.flatnonzero(side):
            rest = inside[label[inside] != label[k]]
            rest = rest[go_on(np.broadcast_to(sig[k], (len(rest), sig.shape[1])), sig[rest], steps)] if len(rest) else rest
            if not len(rest):
                continue
            mine = keys[offs[k] : offs[k + 1]]
            theirs = np.concatenate([keys[offs[j] : offs[j + 1]] for j in rest])
            at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            both = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.cumsum(size[rest]) - size[rest])
            good = rest[den * both >= num * (size[k] + size[rest] - both)]
            met = {label[j]: j for j in good}.values()
            links.update((max(node[k], node[j]), min(node[k], node[j])) for j in met)
        return pa.table({"u": pa.array([u for u, _ in links], pa.binary()), "v": pa.array([v for _, v in links], pa.binary())})

    return left.unionAll(right).groupBy("centre", "o", "m").applyInArrow(compare, "u binary, v binary")


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), text: str = "text") -> DataFrame:
    """`docs` without the text, with n_shingles, component_id, kept, _key = xxhash64(doc_id, text) and _class, which is the same
    for all rows of a class whatever their ids (null: no set, a class of its own)."""
    made = ["n_shingles", "component_id", "kept", "_key", "_class", "_digest", "_sig"]
    docs = docs.select(*(c for c in docs.columns if c not in made))
    keep = [c for c in docs.columns if c != text]
    rows = written(sketches(docs, plan, text), "sketches")
    full = rows.where(F.col("_digest").isNotNull())
    first = full.groupBy("_digest").agg(F.min("doc_id").alias("first_id"), F.min("_key").alias("_row"))
    nodes = written(full.select("_digest", "_sig").dropDuplicates(["_digest"]), "nodes")

    size = 4 * plan.rows
    hashes = F.array(*(F.expr(f"xxhash64({b}, substring(_sig, {size * b + 1}, {size}))") for b in range(plan.bands)))
    banded = nodes.select(F.col("_digest").alias("node"), F.explode(hashes).alias("band"))
    shared = banded.groupBy(F.col("band").alias("_band")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = checkpointed(banded.join(shared, F.col("band") == F.col("_band")).select("band", "node", "n"))
    weight = members.groupBy(F.col("node").alias("_node")).agg(F.sum("n").alias("w"))
    weighed = members.join(weight, F.col("node") == F.col("_node"))
    centres = weighed.groupBy(F.col("band").alias("_band")).agg(F.max(F.struct("w", "node")).alias("c")).select("_band", F.col("c.node").alias("centre"))
    starred = checkpointed(members.join(centres, F.col("band") == F.col("_band")).select("band", "node", "centre"))

    sig = lambda key, name: nodes.select(F.col("_digest").alias(key), F.col("_sig").alias(name))
    pairs = starred.where(F.col("node") != F.col("centre")).select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct()
    pairs = pairs.join(sig("_a", "su"), F.col("u") == F.col("_a")).join(sig("_b", "sv"), F.col("v") == F.col("_b"))
    wanted = starred.select(F.col("node").alias("_digest")).distinct().join(first, "_digest").select("_row", "_digest")
    read = docs.select(F.xxhash64("doc_id", text).alias("_key"), F.col(text).alias("_text"))
    texts = read.join(wanted, F.col("_key") == F.col("_row")).dropDuplicates(["_digest"]).select("_digest", "_text")
    texts = written(texts, "texts")
    links = checkpointed(_verified(_pruned(pairs, plan), texts, plan))
    labels = components(links)

    stars = starred.select("centre", "node").distinct()
    known = _labelled(_labelled(stars, labels, "node", "label"), labels, "centre", "middle")
    known = known.repartition("node")  # a large star is not left with the task that looked its centre up
    late = checkpointed(_inner_links(known, nodes, texts, plan))
    if not late.isEmpty():
        labels = components(links.unionAll(late))

    named = _labelled(first, labels, "_digest", "_label")
    smallest = named.groupBy("_label").agg(F.min("first_id").alias("component_id"))
    named = named.select("_digest", "_label").join(smallest, "_label").select(F.col("_digest").alias("_d"), "component_id", F.col("_label").alias("_class"))
    out = rows.join(named, F.col("_digest") == F.col("_d"), "left")
    component = F.when(F.col("_digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(*keep, "n_shingles", component.alias("component_id"), "_key", "_class").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _labelled(frame: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """`frame` with the component label of a node; a node without links is its own."""
    l = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))  # noqa: E741
    return frame.join(l, F.col(key) == F.col("_n"), "left").withColumn(name, F.coalesce("_l", key)).drop("_n", "_l")


def one_of_each(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of `docs` that stay when one document of each class is kept, all columns.

    Of a class stays the row with the smallest id (null ids come last), of several texts under that id one: so one row stays also
    where members share an id or have none. A document without words is a class of its own and stays, once for each id and text.
    """
    found = near_duplicates(docs, plan).groupBy("_class", "_key").agg(F.min("doc_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key", "_n")).alias("_least")
    marks = found.where(F.col("_class").isNotNull()).groupBy("_class").agg(least).select("_least._key", "_least._n")
    marks = checkpointed(marks.unionAll(found.where(F.col("_class").isNull()).select("_key", "_n")))
    key = F.xxhash64("doc_id", "text")
    kept = docs.join(marks, key == F.col("_key"))
    if not marks.where("_n > 1").isEmpty():  # rows that repeat, id and text alike
        kept = kept.dropDuplicates(["_key"])
    return kept.select(*docs.columns)

"""Suffix-array deduplication: bytes covered by a string of LENGTH bytes that also starts earlier are found and removed.

Suffixes are taken at anchors. An anchor of a string is the place, in its first LENGTH - GRAM + 1 places, where the hash of
the next GRAM bytes is least (the first such place); equal strings have equal anchors, so comparing the suffixes at
anchors, with the bytes before them, finds every repeated string.

1. Blocks of documents send the hashes of their anchors (packed, distinct); the answers say which occur twice or more, and which
   have more than HOT contexts.
2. A suffix at a repeated anchor is sent with its context, the bytes that any string over it can reach; of equal contexts in one block
   only the first is sent, since the others repeat whatever it holds. Sampled splitters range-partition the suffixes by their
   leading tokens (the GRAM bytes at the anchor); there are as many buckets as blocks, so buckets don't grow with the input. A bucket sorts suffixes by multikey quicksort, eight bytes at a time, and the
   texts before them likewise; runs of common prefixes in both orders give, for each way to place a string over the
   anchor, the classes of equal strings, of which only the first member stays.
3. A hot anchor would make a bucket without bound. Each string over it is sent as a suffix of its own; these are range-partitioned by
   the whole string and the place, so that a hot string is cut over many buckets, and a suffix repeats if its predecessor
   is equal; the first suffix of a bucket is compared with the last one of the bucket before.
4. The covered runs go back to the blocks, where documents are cut.

Order: smaller id first, null last; rows with equal ids by a hash of the text, equal rows in any fixed order.

Defined cases: null and empty texts have no bytes and lose none; texts below LENGTH lose none; matches don't cross
documents; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger.llm import blocks
from salesledger.llm import textops as ops
from salesledger.llm.decontam import gram_hashes
from salesledger.llm.storage import written

LENGTH = 100
GRAM = 32
#: Contexts of one anchor, added up over blocks, beyond which its strings are dealt out one by one.
HOT = 20_000
FLAG_BYTES = 4
PIECE_BYTES = 1 << 17
BLOCK_BYTES = 8 << 20
LAST_ID = (1 << 63) - 1
#: A suffix at an anchor has the reversed bytes before it, a string of a hot anchor has none (null), a run known to repeat has neither.
CONTEXT = "doc long, block int, row int, at long, stop long, before binary, after binary"
RUNS = "kind string, block int, row int, start long, stop long, bucket int, string binary"


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all strings of `length` bytes, and the hashes of the bytes there."""
    w = length - gram + 1
    h = gram_hashes(data, gram)
    if len(data) < length:
        return np.zeros(0, np.int64), h[:0]
    packed = h & np.uint64(0xFFFFFFFF00000000)
    packed |= np.arange(len(h), dtype=np.uint64)
    least = ops.sliding_min(packed, w).astype(np.uint32)
    inside = np.zeros(len(least) + 1, np.int64)
    long = np.diff(offs) >= length
    np.add.at(inside, offs[:-1][long], 1)
    np.add.at(inside, offs[1:][long] - length + 1, -1)
    found = least[np.cumsum(inside)[:-1] > 0].astype(np.int64)  # never decreases from string to string
    found = found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found
    return found, h[found]


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian 64-bit words: sort by the first word, then each run of equals by the next one, and so on."""
    order = np.argsort(words[:, 0], kind="stable")
    run = np.cumsum(np.concatenate([[0], words[order[1:], 0] != words[order[:-1], 0]])) if len(order) else order
    for c in range(1, words.shape[1]):
        alone = np.bincount(run)[run] == 1 if len(run) else np.zeros(0, bool)
        todo = np.flatnonzero(~alone)
        if not len(todo):
            break
        rows, group = order[todo], run[todo]
        inner = np.lexsort((words[rows, c], group))
        order[todo] = rows[inner]
        step = np.zeros(len(order), np.int64)
        value = words[order[todo], c]
        step[todo[1:]] = (value[1:] != value[:-1]) & (group[1:] == group[:-1])
        first = np.concatenate([[0], run[1:] != run[:-1]])
        run = np.cumsum(first + step)
    return order


def common_prefix(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row, in order, shares with the row before it (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 16):
        b = min(a + (1 << 16), len(order))
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        out[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded with zeros to whole 64-bit words, and their lengths."""
    data, offs = ops.flat(column)
    size = np.diff(offs)
    out = np.zeros((len(size), -(-width // 8) * 8), np.uint8)
    for a in range(0, len(size), 1 << 13):  # the indexes of all rows would be eight times the bytes
        part = size[a : a + (1 << 13)]
        inside = np.arange(out.shape[1]) < part[:, None]
        out[a : a + len(part)][inside] = data[offs[a] : offs[a + len(part)]]
    return out, size


def repeated_strings(before: pa.Array, after: pa.Array, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes in document order with the reversed bytes before them: rows whose strings repeat an earlier one,
    and how far these strings reach before and after the anchor."""
    a, a_size = _matrix(after, length)
    b, b_size = _matrix(before, length - gram)
    n = len(a)
    orders = [multikey_sort(m.view(">u8").astype(np.uint64)) for m in (a, b)]
    prefix = [common_prefix(m, o) for m, o in zip((a, b), orders)]
    most, least = np.full(n, -1, np.int64), np.full(n, length + 1, np.int64)
    classes = np.empty(n, np.int64), np.empty(n, np.int64)
    for reach in range(length - gram + 1):
        for k, need in enumerate((length - reach, reach)):
            classes[k][orders[k]] = np.cumsum(prefix[k] < need) if need else 0
        ok = np.flatnonzero((b_size >= reach) & (a_size >= length - reach))
        if len(ok) < 2:
            continue
        key = classes[0][ok] * (n + 1) + classes[1][ok]
        _, later = ops.repeated(key)
        rows = ok[later]
        most[rows] = reach
        least[rows] = np.minimum(least[rows], reach)
    rows = np.flatnonzero(most >= 0)
    return rows, most[rows], length - least[rows]


def _slices(data: np.ndarray, at: np.ndarray, size: np.ndarray, step: int) -> pa.Array:
    """Runs of bytes that begin at `at` and go forwards or backwards."""
    width = int(size.max()) if len(size) else 0
    index = at[:, None] + step * np.arange(width)
    inside = np.arange(width) < size[:, None]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[index[inside]])])


def _texts(table: pa.Table):
    """Pieces of a block: first row, bytes and offsets."""
    data, offs = ops.flat(table.column("text"))
    for a, b in ops.pieces(offs, PIECE_BYTES):
        yield a, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def _contexts(data: np.ndarray, offs: np.ndarray, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """A hash of the bytes that strings over each anchor can reach; 0 where the text ends before them."""
    text = np.searchsorted(offs, at, "right") - 1
    full = np.flatnonzero((at - length + gram >= offs[text]) & (at + length <= offs[text + 1]))
    out = np.zeros(len(at), np.uint64)
    if len(full):
        start = at[full] - length + gram
        out[full] = ops.hashes(data, start, start + 2 * length - gram) | np.uint64(1)
    return out


def _all_anchors(table: pa.Table, length: int, gram: int):
    """Pieces (first row, bytes, offsets, anchors) of a block, and the key and context of every anchor."""
    found, keys, contexts = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for a, data, offs in _texts(table):
        at, h = anchors(data, offs, length, gram)
        found.append((a, data, offs, at))
        keys.append(h)
        contexts.append(_contexts(data, offs, at, length, gram))
    return found, np.concatenate(keys), np.concatenate(contexts)


def _again(contexts: np.ndarray) -> np.ndarray:
    """Which contexts are equal to an earlier one."""
    return ops.repeated(contexts)[1] & (contexts > 0)


def _runs(rows: DataFrame, n_blocks: int, length: int, gram: int, hot: int) -> DataFrame:
    """Covered runs (block, row, start, stop), and the first and last strings of hot buckets."""
    n_parts = blocks.parts(n_blocks, BLOCK_BYTES)
    names = ["doc", "block", "row", "at", "stop", "before", "after"]
    kinds = pa.schema(zip(names, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]))

    def send(table: pa.Table) -> pa.Table:
        _, keys, context = _all_anchors(blocks.ordered(table), length, gram)
        unique, place, bounds = blocks.deal(keys, n_parts)
        again = _again(context)
        count = np.bincount(place, ~again, len(unique)) + (np.bincount(place, again, len(unique)) > 0)
        count = count.astype(np.uint32)
        used = np.flatnonzero(np.diff(bounds))
        cut = [(bounds[p], bounds[p + 1]) for p in used]
        return pa.table({
            "part": pa.array(used, pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(used), pa.int32()),
            "keys": pa.array([blocks.packed(unique[a:b], FLAG_BYTES) for a, b in cut], pa.binary()),
            "n": pa.array([count[a:b].tobytes() for a, b in cut], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        keys = [blocks.unpacked(x, FLAG_BYTES) for x in table.column("keys").to_pylist()]
        total = blocks.summed(keys, [np.frombuffer(x, np.uint32) for x in table.column("n").to_pylist()])
        flags = [((t > 1).astype(np.uint8) + (t > hot)).tobytes() for t in total]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "flags": pa.array(flags, pa.binary())})

    def contexts(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, answers = blocks.ordered(table), answers.sort_by("part")
        found, keys, context = _all_anchors(table, length, gram)
        place = blocks.deal(keys, n_parts)[1]
        flags = np.frombuffer(b"".join(answers.column("flags").to_pylist()), np.uint8)
        flag = flags[place] if len(place) else np.zeros(0, np.uint8)
        again = _again(context)
        ids = pc.fill_null(table.column("doc_id"), LAST_ID).to_numpy()
        block = table.column("block")[0].as_py() if table.num_rows else 0
        out, done = [], 0

        def add(rows: np.ndarray, at: np.ndarray, stop: np.ndarray | None, before: pa.Array | None, after: pa.Array | None) -> None:
            none = pa.nulls(len(rows), pa.binary())
            cols = [pa.array(ids[rows]), pa.array(np.full(len(rows), block, np.int32)), pa.array(rows.astype(np.int32)), pa.array(at)]
            cols += [pa.nulls(len(rows), pa.int64()) if stop is None else pa.array(stop), none if before is None else before, none if after is None else after]
            out.append(pa.RecordBatch.from_arrays(cols, names))

        for a, data, offs, at in found:
            mine, known = flag[done : done + len(at)], again[done : done + len(at)]
            done += len(at)
            text = np.searchsorted(offs, at, "right") - 1
            p, t = at[known], text[known]
            runs = merged(p - length + gram, p + length)  # no context crosses a text, so runs of two texts at most touch
            if runs:
                start, stop = np.array(runs).T
                cuts = np.setdiff1d(offs[1:-1], np.concatenate([start, stop]))
                cuts = cuts[np.searchsorted(start, cuts) > np.searchsorted(stop, cuts)]
                start, stop = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([stop, cuts]))
                row = np.searchsorted(offs, start, "right") - 1
                add(a + row, start - offs[row], stop - offs[row], None, None)
            for k in (1, 2):
                use = (mine == k) & ~known
                p, t = at[use], text[use]
                if k == 2:  # each string over the anchor
                    first = np.maximum(offs[t], p - length + gram)
                    n = np.maximum(0, np.minimum(p, offs[t + 1] - length) + 1 - first)
                    p = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else p
                    t = np.repeat(t, n)
                for lo in range(0, len(p), 1 << 14):
                    q, r = p[lo : lo + (1 << 14)], t[lo : lo + (1 << 14)]
                    before = _slices(data, q - 1, np.minimum(q - offs[r], length - gram), -1) if k == 1 else None
                    add(a + r, q - offs[r], None, before, _slices(data, q, np.minimum(offs[r + 1] - q, length), 1))
        return pa.Table.from_batches(out, kinds)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        number = TaskContext.get().partitionId()
        plain = table.filter(pc.is_valid(table.column("before"))).sort_by([(c, "ascending") for c in ("doc", "block", "row", "at")])
        if plain.num_rows:
            rows, before, after = repeated_strings(plain.column("before").combine_chunks(), plain.column("after").combine_chunks(), length, gram)
            at = plain.column("at").to_numpy()[rows]
            yield _result("run", plain, rows, at - before, at + after, number)
        known = table.filter(pc.is_null(table.column("after")))
        if known.num_rows:
            yield _result("run", known, np.arange(known.num_rows), known.column("at").to_numpy(), known.column("stop").to_numpy(), number)
        dealt = table.filter(pc.and_(pc.is_null(table.column("before")), pc.is_valid(table.column("after")))).sort_by([(c, "ascending") for c in ("after", "doc", "block", "row", "at")])
        if dealt.num_rows:
            strings = dealt.column("after").combine_chunks()
            same = np.concatenate([[False], pc.equal(strings[1:], strings[:-1]).to_numpy(zero_copy_only=False)])
            at = dealt.column("at").to_numpy()
            place = np.stack([dealt.column(c).to_numpy() for c in ("doc", "block", "row", "at")])
            moved = np.concatenate([[False], (place[:, 1:] != place[:, :-1]).any(axis=0)])  # one place may come from two anchors
            steps = np.cumsum(same & moved)
            rows = np.flatnonzero(steps > np.maximum.accumulate(np.where(same, 0, steps)))
            yield _result("run", dealt, rows, at[rows], at[rows] + length, number)
            yield _result("first", dealt, np.array([0]), at[:1], at[:1] + length, number, strings)
            yield _result("last", dealt, np.array([len(at) - 1]), at[-1:], at[-1:] + length, number, strings)

    sent = rows.groupBy("block").applyInArrow(send, "part int, block int, keys binary, n binary")
    flags = sent.groupBy("part").applyInArrow(answer, "block int, part int, flags binary")
    suffixes = rows.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(contexts, CONTEXT)
    dealt = F.col("before").isNull()
    lead = F.when(dealt, F.col("after")).otherwise(F.substring("after", 1, gram))
    split = suffixes.repartitionByRange(n_blocks, lead, F.when(dealt, F.col("doc")), F.when(dealt, F.col("at")))
    return split.mapInArrow(bucket, RUNS)


def _result(kind: str, table: pa.Table, rows: np.ndarray, start: np.ndarray, stop: np.ndarray, number: int, strings: pa.Array | None = None) -> pa.RecordBatch:
    take = pa.array(rows, pa.int64())
    cols = {
        "kind": pa.array([kind] * len(rows), pa.string()), "block": table.column("block").combine_chunks().take(take), "row": table.column("row").combine_chunks().take(take),
        "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64()), "bucket": pa.array([number] * len(rows), pa.int32()),
        "string": strings.take(take) if strings is not None else pa.nulls(len(rows), pa.binary()),
    }
    return pa.RecordBatch.from_pydict(cols)


def merged(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Unions of runs, in order; runs that touch are one."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]])) if len(start) else np.zeros(0, np.int64)
    return list(zip(start[new].tolist(), stop[np.append(new[1:], len(start)) - 1].tolist())) if len(start) else []


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """For each document: n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes that stay) if asked for."""
    rows, n_blocks = blocks.blocked(docs, [F.col("doc_id").cast("long").alias("doc_id"), "text"], block_bytes)
    found = written(_runs(rows, n_blocks, length, gram, hot), "runs", drop_shuffles=True)
    runs = found.where(F.col("kind") == "run").select("block", "row", "start", "stop")
    firsts, lasts = found.where(F.col("kind") == "first"), found.where(F.col("kind") == "last")
    if not firsts.isEmpty():
        lasts = lasts.select(F.col("string").alias("_string"), F.col("bucket").alias("_bucket"))
        met = firsts.join(lasts, (F.col("string") == F.col("_string")) & (F.col("_bucket") < F.col("bucket")), "left_semi")
        runs = runs.unionAll(met.select("block", "row", "start", "stop"))

    def cut(table: pa.Table, runs: pa.Table) -> pa.Table:
        table = blocks.ordered(table)
        by: dict[int, list[tuple[int, int]]] = {}
        row = runs.column("row").to_numpy()
        order = np.argsort(row, kind="stable")
        start, stop, row = runs.column("start").to_numpy()[order], runs.column("stop").to_numpy()[order], row[order]
        rows, first = np.unique(row, return_index=True)
        for r, a, b in zip(rows.tolist(), first, np.append(first[1:], len(row))):
            by[r] = merged(start[a:b], stop[a:b])
        out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        data, offs = ops.flat(table.column("text"))
        for r in range(table.num_rows):
            raw, spans = data[offs[r] : offs[r + 1]].tobytes(), by.get(r, [])
            parts, done = [], 0
            for a, b in spans:
                parts.append(raw[done:a])
                done = b
            kept = b"".join([*parts, raw[done:]])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(kept))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        cols = {"doc_id": table.column("doc_id")} | {c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)}
        return pa.table({c: v for c, v in cols.items() if keep_text or c != "kept"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return rows.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(cut, schema)

"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct five-word shingles. Two sets with Jaccard similarity
of at least 3/4 differ in at most (a + b) / 7 elements, a and b being their sizes. Each set is XOR-ed
into a sketch of ``m`` cells, a shingle going to the cell that the top bits of its hash name: every
differing shingle spoils one cell at most, so the number of differing cells bounds the symmetric
difference from below, and among h + 1 filled cells one is equal in both sketches (pigeonhole). The cell
count is fixed per size band; cells that agree give the candidate pairs, a parity bit sketch of at
least as many bits as the set has shingles drops pairs whose Hamming distance is above the bound, and
the exact sets decide. Texts are fetched for pairs that came so far; a bitmap of fixed size spares the
other texts the shuffle.

* Shingles of very many documents (a bounded list, which only steers the work) stay out of the cells;
  a set that then has too few filled cells also joins by the rarest n/4 + 1 shingles, so that any two
  such sets meet as well. Sets too small for cells have these keys alone, so every set that is small
  enough to link with one of them has them too. The result never depends on the list.
* Equal sets are one node, and a task emits the keys of a set once however many copies of it it reads.
* Keys that many of a sample of documents have are hot (a bounded list, which only steers the work): their
  members are dealt over many tasks and pass as they are, other keys are grouped each in one task.
* Groups of near copies are first compared with one hub each; then the members of a cell that are still
  in different components are compared by their bit sketches, blocks of a group at a time and without a
  row for each pair. No candidate is dropped.
* Links and components stay distributed; every step is cut by a table in the shared folder.

Nulls and texts without words have empty sets and stay alone. Repeated rows share a node. A null id
keeps its row; it never becomes a component's id unless all ids of the component are null. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import Scratch, written

SHINGLE = 5
#: Sets smaller than this join by their rarest shingles alone; sets that can link with those, by them as well.
SMALL = 16
#: Ratio of the sizes at the ends of a band.
BAND = 4
#: Documents from which a shingle counts as common, and how many such shingles are listed at most.
COMMON_FROM, COMMON_LISTED = 64, 65_536
#: Documents within one task from which it reports a shingle.
REPORTED_FROM = 3
#: Bits of the smallest sketch.
SKETCH_BITS = 512
#: Members of a group that are compared with as many others in one piece of work.
BLOCK = 512
#: Documents, at most, whose keys tell which keys are hot; from which share and number of them; tasks that share a hot key.
HOT_SAMPLE, HOT_SHARE, HOT_LEAST, HOT_TASKS = 50_000, 0.001, 32, 64
#: Slots of the bitmap of wanted ids, and of one of its pieces.
WANTED_SLOTS, PIECE_SLOTS = 1 << 24, 32_768

U64 = np.uint64


def shingle_sets(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Pieces of a batch with the sorted distinct shingle hashes of each text."""
    for piece in tx.pieces(batch, column):
        data, off = tx.flat(piece.column(piece.schema.get_field_index(column)))
        data = tx.LOWER[data]
        starts, ends, first = tx.words(data, off, tx.SPACES)
        hashes = tx.word_hashes(data, starts, ends)
        sets = []
        for i in range(len(off) - 1):
            grams = tx.ngram_hashes(hashes[first[i] : first[i + 1]], SHINGLE)
            grams.sort()
            if len(grams) > 1:
                keep = np.empty(len(grams), bool)
                keep[0] = True
                np.not_equal(grams[1:], grams[:-1], out=keep[1:])
                grams = grams[keep]
            sets.append(grams)
        yield piece, sets


def node_id(grams: np.ndarray) -> int:
    """One id for equal sets."""
    both = np.array([grams.sum(dtype=U64), np.bitwise_xor.reduce(grams)], U64)
    mixed = tx.mix(both + np.array([len(grams), 77 * len(grams)], U64))
    return int((mixed[:1] ^ (mixed[1:] * U64(3))).view(np.int64)[0])


def bit_sketch(grams: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of at least as many cells, a power of two of them, as longs."""
    bits = max(SKETCH_BITS, 1 << (len(grams) - 1).bit_length())
    parity = np.bincount((grams & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def band_of(n: int) -> int:
    """Bands start at SMALL and each reaches BAND times as far; -1 below."""
    k, at = -1, SMALL
    while n >= at:
        k, at = k + 1, at * BAND
    return k


def cells_of(band: int) -> int:
    """Cells of a band's sketch: three shingles a cell at the largest size that can link into it."""
    return SMALL * BAND ** (band + 1) * 4 // 9


@lru_cache(maxsize=64)
def _reach(band: int) -> np.ndarray:
    """For each size from the band's start on, the share of the cells a set fills in; it never falls."""
    m = cells_of(band)
    n = np.arange(SMALL * BAND**band, SMALL * BAND ** (band + 1), dtype=np.float64)
    wanted = n / 3 + 2 + 1.5 * np.sqrt(n)
    return np.maximum.accumulate(np.minimum(1.0, wanted / (m * -np.expm1(-n / m))))


def cell_keys(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The keys under which a set meets every set it can link with."""
    n = len(grams)
    if n == 0:
        return np.zeros(0, U64)
    rare = grams
    if len(common):
        at = np.searchsorted(common, grams)
        is_common = common[np.minimum(at, len(common) - 1)] == grams
        rare = grams[~is_common]
    out, sure = [], n >= SMALL
    band = band_of(n)
    bands = [band] if band >= 0 else []
    if band == 0 or band > 0 and 3 * n < 4 * SMALL * BAND**band:
        bands += [band - 1] if band > 0 else []
    filled = {}
    for k in bands:
        m = cells_of(k)
        share = _reach(k)[n - SMALL * BAND**k] if k == band else 1.0
        cell = ((rare >> U64(32)) * U64(m)) >> U64(32)
        below = rare if share >= 1 else rare[: np.searchsorted(cell, U64(int(share * m)), "left")]
        need = (n + (4 * n // 3 if k == band else n)) // 7 + 1
        got = len(np.unique(cell[: len(below)]))
        sure &= got >= need
        filled[k] = (cell, len(below))
    for k, (cell, end) in filled.items():
        end = end if sure else len(rare)
        if end == 0:
            continue
        cell = cell[:end]
        begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        xor = np.bitwise_xor.reduceat(rare[:end], begin)
        out.append(tx.mix(xor ^ tx.mix(cell[begin] + U64(1 + (k + 1 << 40)))))
    if not sure or 3 * n < 4 * SMALL:
        order = rare if len(rare) == n else np.concatenate((rare, grams[is_common]))
        out.append(tx.mix(order[: n - -(-3 * n // 4) + 1] ^ U64(0x51ED270B)))
    return np.concatenate(out) if out else np.zeros(0, U64)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; at the end rows of the shingles that several documents of the task have."""
    ids_type, seen = None, []
    pending = 0

    def counts(parts: list) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate([p[0] for p in parts])
        weights = np.concatenate([p[1] for p in parts])
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
        begin = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        return values[begin], np.add.reduceat(weights, begin)

    for batch in batches:
        for piece, sets in shingle_sets(batch):
            ids_type = piece.schema.field("doc_id").type
            full = [i for i, s in enumerate(sets) if len(s)]
            sketches = [bit_sketch(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
            nodes = np.zeros(len(sets), np.int64)
            for i in full:
                nodes[i] = node_id(sets[i])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(len(sets), np.int32)),
                    piece.column(piece.schema.get_field_index("doc_id")),
                    piece.column(piece.schema.get_field_index("text_hash")),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(nodes),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketches))),
                ],
                ["kind", "doc_id", "text_hash", "n", "node", "sketch"],
            )
            if full:
                grams = np.sort(np.concatenate([sets[i] for i in full]))
                begin = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
                times = np.diff(np.append(begin, len(grams)))
                seen.append((grams[begin], times))
                pending += len(begin)
                if pending > 1_000_000:
                    values, times = counts(seen)
                    keep = times >= 2
                    seen, pending = [(values[keep], times[keep])], 0
    if seen:
        values, times = counts(seen)
        keep = times >= REPORTED_FROM
        values, times = values[keep], times[keep]
        for i in range(0, len(values), 50_000):
            part = values[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(part), np.int32)), pa.nulls(len(part), ids_type), pa.nulls(len(part), pa.int64()), pa.array(times[i : i + 50_000].astype(np.int64)), pa.array(part.view(np.int64)), pa.nulls(len(part), pa.list_(pa.int64()))],
                ["kind", "doc_id", "text_hash", "n", "node", "sketch"],
            )


def _cells(common: np.ndarray, hot: np.ndarray):
    """The keys of each different set of a task, with a number that deals the members of hot keys over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            for _, sets in shingle_sets(batch):
                keys, ids = [], []
                for s in sets:
                    node = node_id(s) if len(s) else 0
                    if len(s) and node not in known:
                        known.add(node)
                        keys.append(cell_keys(s, common))
                        ids.append(node)
                if len(known) > 1_000_000:
                    known.clear()
                if not keys:
                    continue
                nodes = np.repeat(np.array(ids, np.int64), [len(k) for k in keys])
                joined = np.concatenate(keys)
                salt = np.where(_in(joined, hot), tx.mix(nodes.view(U64)) % U64(HOT_TASKS), U64(0)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(joined.view(np.int64)), pa.array(nodes), pa.array(salt)], ["key", "node", "salt"])

    return run


def _in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _shared(hot: np.ndarray):
    """From rows sorted by key and node: the members of each key with two nodes or more.

    Keys with the same members get one signature, and a task reports it once as far as it remembers. The
    members of a hot key pass as they come, under the key itself. So does a group of over a million nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key, streaming = [], None, False
        known: set[int] = set()

        def out(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node)], ["sig", "node"])

        def whole(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            keep = np.empty(len(key), bool)
            keep[:1] = True
            keep[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[keep], node[keep]
            warm = _in(key.view(U64), hot)
            if warm.any():
                yield out(key[warm], node[warm])
                key, node = key[~warm], node[~warm]
                if not len(key):
                    return
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(begin, len(key)))
            if not (sizes > 1).any():
                return
            sums = np.add.reduceat(tx.mix(node.view(U64)), begin)
            sig = tx.mix(sums + sizes.astype(U64))
            pick = sizes > 1
            first = np.zeros(len(sig), bool)
            first[np.unique(sig, return_index=True)[1]] = True
            for i in np.flatnonzero(pick & first):
                s = int(sig[i])
                if s in known:
                    pick[i] = False
                else:
                    known.add(s)
            pick &= first
            if len(known) > 1_000_000:
                known.clear()
            rows = np.repeat(pick, sizes)
            if rows.any():
                yield out(np.repeat(sig, sizes)[rows].view(np.int64), node[rows])

        for batch in batches:
            if not len(batch):
                continue
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if streaming:
                same = int(np.searchsorted(key, held_key, "right"))
                if same:
                    yield out(key[:same], node[:same])
                key, node = key[same:], node[same:]
                if not len(key):
                    continue
                streaming, held = False, []
            if held:
                key, node = np.concatenate((*[h[0] for h in held], key)), np.concatenate((*[h[1] for h in held], node))
            tail = int(np.searchsorted(key, key[-1], "left"))
            if tail:
                yield from whole(key[:tail], node[:tail])
            key, node = key[tail:], node[tail:]
            held, held_key = [(key, node)], key[-1]
            if len(key) > 1_000_000 and node[0] != node[-1]:
                yield out(key, node)
                streaming, held = True, []
        if held:
            yield from whole(*held[0])

    return run


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, sets in shingle_sets(batch):
            found = pa.array([node_id(s) if len(s) else 0 for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index("node")), found, pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "found", "grams"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        left, right = batch.column(batch.schema.get_field_index("grams_a")), batch.column(batch.schema.get_field_index("grams_b"))
        for i in range(len(batch)):
            a, b = np.frombuffer(left[i].as_buffer(), U64), np.frombuffer(right[i].as_buffer(), U64)
            both = np.concatenate((a, b))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep[i] = 100 * shared >= 75 * (len(a) + len(b) - shared)
        part = batch.select(["a", "b"]).filter(pa.array(keep))
        if len(part):
            yield part


def _halved(sketches: np.ndarray) -> np.ndarray:
    """Sketches of half as many bits: cells that the shorter hash can't tell apart are XOR-ed."""
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def close_pairs(node: np.ndarray, label: np.ndarray, n: np.ndarray, block: np.ndarray, across: bool, sketches: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different labels (and blocks, if ``across``) that sizes and bit sketches allow to link."""
    out = []
    lengths = np.array([len(s) for s in sketches])
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        mine = np.stack([sketches[i] for i in own])
        for other, theirs in ((own, mine), (longer := np.flatnonzero(lengths == 2 * length), _halved(np.stack([sketches[i] for i in longer])) if len(longer) else None)):
            if theirs is None:
                continue
            values, counts = np.unique(label[own], return_counts=True)
            largest = values[counts.argmax()] if other is own else None
            for k, i in enumerate(own):
                if label[i] == largest:
                    continue
                apart = np.bitwise_count(theirs ^ mine[k]).sum(1, dtype=np.int64)
                fits = (7 * apart <= n[other] + n[i]) & (label[other] != label[i]) & (4 * np.minimum(n[other], n[i]) >= 3 * np.maximum(n[other], n[i]))
                if across:
                    fits &= block[other] != block[i]
                found = node[other[fits]]
                if len(found):
                    out.append((np.minimum(found, node[i]), np.maximum(found, node[i])))
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by group and blocks: the close pairs of each two blocks."""
    held: list[pa.RecordBatch] = []
    known: set[tuple[int, int]] = set()

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = {c: table.column(c).to_numpy() for c in ("sig", "lo", "hi", "block", "node", "label", "n")}
        sketch = table.column("sketch").combine_chunks()
        sketch = sketch.chunk(0) if isinstance(sketch, pa.ChunkedArray) else sketch
        offsets, words = sketch.offsets.to_numpy(), sketch.values.to_numpy().view(U64)
        change = (columns["sig"][1:] != columns["sig"][:-1]) | (columns["lo"][1:] != columns["lo"][:-1]) | (columns["hi"][1:] != columns["hi"][:-1])
        begin = np.append(np.flatnonzero(np.concatenate(([True], change))), len(table))
        fresh: list[tuple[int, int]] = []
        for i, j in zip(begin[:-1], begin[1:], strict=True):
            part = {c: v[i:j] for c, v in columns.items()}
            across = part["lo"][0] != part["hi"][0]
            for a, b in close_pairs(part["node"], part["label"], part["n"], part["block"], across, [words[offsets[k] : offsets[k + 1]] for k in range(i, j)]):
                for pair in zip(a.tolist(), b.tolist(), strict=True):
                    if pair not in known:
                        known.add(pair)
                        fresh.append(pair)
            if len(known) > 500_000:
                known.clear()
        if fresh:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in fresh]), pa.array([p[1] for p in fresh])], ["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        last = [table.column(c)[-1].as_py() for c in ("sig", "lo", "hi")]
        same = np.logical_and.reduce([table.column(c).to_numpy() == v for c, v in zip(("sig", "lo", "hi"), last, strict=True)])
        end = len(table) - int(same.sum())
        if end:
            yield from pairs(table.slice(0, end))
        held = table.slice(end).combine_chunks().to_batches()
    if held:
        yield from pairs(pa.Table.from_batches(held))


def linked_components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable over ``a, b`` edges, by neighbours' labels and pointer jumps."""
    with Scratch(edges.sparkSession) as scratch:
        both = scratch.written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "links")
        labels = scratch.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
        table = labels
        while True:
            near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
            lower = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
            lower = scratch.written(lower, "lower")
            scratch.drop(table)
            target = lower.select(F.col("node").alias("at"), F.col("label").alias("jump"))
            after = lower.join(target, lower.label == target.at, "left").select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label"))
            table = scratch.written(after, "labels")
            scratch.drop(lower)
            labels = table.select("node", "label")
            if table.where("label <> old").isEmpty():
                return written(labels, "components")


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes allow a link and whose bit sketches differ in no more than (a + b) / 7 places."""
    na = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    nb = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    length = F.least(F.size("s_a"), F.size("s_b"))
    xor = lambda x, y: x.bitwiseXOR(y)
    folded = lambda c: F.when(F.size(c) > length, F.zip_with(F.slice(c, 1, length), F.slice(c, length + 1, length), xor)).otherwise(F.col(c))
    apart: Column = F.aggregate(F.transform(F.zip_with(folded("s_a"), folded("s_b"), xor), F.bit_count), F.lit(0), lambda s, x: s + x)
    sized = pairs.join(na, "a").join(nb, "b").where(4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b"))
    return sized.where(7 * apart <= F.col("n_a") + F.col("n_b"))


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text hash are in ``wanted`` (doc_id, text_hash, node), with the node.

    A bitmap of 2 MB tells most other rows apart before anything is shuffled; the join decides.
    """
    slot = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(WANTED_SLOTS))
    pieces = wanted.select((slot / PIECE_SLOTS).cast("int").alias("piece"), (slot % PIECE_SLOTS).alias("place")).groupBy("piece").agg(F.bitmap_construct_agg("place").alias("bits"))
    asked = docs.withColumn("piece", (slot / PIECE_SLOTS).cast("int")).withColumn("place", (slot % PIECE_SLOTS).cast("int"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(place / 8 as int) + 1, 1)")), 16, 10).cast("int")
    likely = asked.join(F.broadcast(pieces), "piece").where(byte.bitwiseAND(F.expr("shiftleft(1, place % 8)")) != 0)
    likely = likely.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "text")
    same = (F.col("own_hash") == F.col("text_hash")) & F.col("own_id").eqNullSafe(F.col("doc_id"))
    return likely.join(wanted, same).select("node", "text")


def _hot_keys(docs: DataFrame, n_docs: int, common: np.ndarray) -> np.ndarray:
    """Keys that a noticeable share of a sample of documents has, sorted; the sample is drawn by a hash of the id."""
    share = min(1 << 30, int((1 << 30) * HOT_SAMPLE / max(1, n_docs)))
    drawn = docs.where(F.pmod(F.xxhash64(F.lit("hot keys"), "doc_id"), F.lit(1 << 30)) < share)
    cells = drawn.select("text").mapInArrow(_cells(common, np.zeros(0, U64)), "key bigint, node bigint, salt int")
    least = max(HOT_LEAST, int(HOT_SHARE * min(n_docs, HOT_SAMPLE)))
    found = cells.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(COMMON_LISTED)
    return np.sort(np.array([r.key for r in found.collect()], np.int64).view(U64))


def _once(groups: DataFrame, hot: np.ndarray, scratch: Scratch) -> DataFrame:
    """``groups`` without the hot keys that have the same members as another."""
    spark = groups.sparkSession
    listed = F.broadcast(spark.createDataFrame([(int(k),) for k in hot.view(np.int64)], "sig bigint"))
    prints = groups.join(listed, "sig", "left_semi").groupBy("sig").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    first = prints.groupBy("n", "x", "y").agg(F.min("sig").alias("first"))
    spare = prints.join(first, ["n", "x", "y"]).where("sig <> first or n < 2").select("sig")
    return groups.join(F.broadcast(scratch.written(spare, "spare")), "sig", "left_anti")


def _labelled(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n, label``, one row for each row of ``docs``; no label without words."""
    with Scratch(docs.sparkSession) as scratch:
        return _labelled_with(docs, scratch)


def _labelled_with(docs: DataFrame, scratch: Scratch) -> DataFrame:
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    facts = scratch.written(docs.mapInArrow(_facts, f"kind int, doc_id {id_type}, text_hash bigint, n bigint, node bigint, sketch array<bigint>"), "facts")
    common = facts.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_FROM)
    common = np.sort(np.array([r.node for r in common.orderBy(F.desc("n"), "node").limit(COMMON_LISTED).collect()], np.int64).view(U64))
    rows = facts.where("kind = 0")
    hot = _hot_keys(docs, rows.count(), common)
    cells = docs.select("text").mapInArrow(_cells(common, hot), "key bigint, node bigint, salt int")
    groups = cells.repartition("key", "salt").sortWithinPartitions("key", "node").select("key", "node").mapInArrow(_shared(hot), "sig bigint, node bigint")
    groups = scratch.written(groups.distinct(), "groups")
    if len(hot):
        groups = _once(groups, hot, scratch)
    members = groups.select("node").distinct()
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min(F.struct("doc_id", "text_hash")).alias("one")).select("node", "n", "sketch", "one.*")
    nodes = scratch.written(nodes.join(members, "node", "left_semi"), "nodes")

    def verified(pairs: DataFrame) -> DataFrame:
        with Scratch(docs.sparkSession) as own:
            pairs = own.written(pairs.select("a", "b"), "pairs")
            ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
            wanted = own.written(nodes.join(ends, "node", "left_semi").select("doc_id", "text_hash", "node"), "wanted")
            sets = _fetched(docs, wanted).mapInArrow(_set_rows, "node bigint, found bigint, grams binary").where("node = found")
            sets = own.written(sets.groupBy("node").agg(F.first("grams").alias("grams")), "sets")
            ga = sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
            gb = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
            return scratch.written(pairs.join(ga, "a").join(gb, "b").mapInArrow(_similar, "a bigint, b bigint"), "edges")

    # a group's hub is the member that shares most with all others: likely what its copies were made from
    # (what is summed by group is written, so that the joins with it can split a giant group)
    sizes = scratch.written(groups.groupBy("sig").agg(F.count("*").alias("size")), "sizes")
    weights = groups.join(sizes, "sig").groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = groups.join(weights, "node").groupBy("sig").agg(F.max(F.struct("weight", "node")).alias("hub")).select("sig", F.col("hub.node").alias("b"))
    hubs = scratch.written(hubs, "hubs")
    spokes = groups.join(hubs, "sig").where("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("cells"))
    best = spokes.groupBy("a").agg(F.max(F.struct("cells", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    best = _close(best, nodes)
    edges = verified(best)
    labels = linked_components(edges)
    tagged = groups.join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))
    mixed = tagged.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
    mixed = scratch.written(mixed, "mixed")
    open_ = scratch.written(tagged.join(mixed, "sig", "left_semi"), "open")
    pieces = scratch.written(open_.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces")), "pieces")
    cut = open_.join(pieces, "sig").join(nodes.select("node", "n", "sketch"), "node")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = cut.select("sig", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "node", "label", "n", "sketch")
    cut = cut.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")
    more = verified(cut.mapInArrow(_near, "a bigint, b bigint").distinct())
    if not more.isEmpty():
        labels = linked_components(edges.union(more))
    named = rows.join(labels, "node", "left").select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"))
    return written(named, "named")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row for each row of ``docs`` (doc_id, text)."""
    named = _labelled(docs)
    # written, so that the join can split the rows of a giant component
    first = written(named.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id")), "first")
    some = named.where("n > 0").join(first, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = named.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.union(none)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: of its least id, and of that id's texts in it the one of least hash.

    An id with texts in several components stays in each where it is the least. Of repeated rows one stays.
    Rows without words stay, as nothing links to them. Rows without an id all stay, copies of others too.
    """
    named = _labelled(docs).where("doc_id is not null")
    found = named.where("n > 0").groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*")
    found = found.union(named.where("n = 0").select("doc_id", "text_hash").distinct())
    rows = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"), F.struct("*").alias("row"))
    kept = rows.join(found, (F.col("own_id") == F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_hash"]).select("row.*").union(docs.where("doc_id is null"))

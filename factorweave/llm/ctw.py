"""Language-model scoring by context-tree weighting.

Each byte is split into eight binary decisions; a decision's node is the bits of the byte so far. For
every context of up to ``DEPTH`` preceding bytes a node keeps the zeros and ones seen in the training
texts. A node predicts with the Krichevsky-Trofimov estimate, and contexts of all depths are mixed with
the weights of context-tree weighting: Pw(s) = Pe(s) / 2 + product of Pw(longer contexts) / 2. The
score of a text is the log10 probability of its bytes and one end mark under the mixture, A-Z in lower
case. One departure from the textbook form: a context that training never saw leaves the prediction to the
shorter ones, where a textbook node without counts would mix in one half for each bit.

Counts are gathered per block of documents, then summed by n-gram. The tree of each two-byte context is
worked out by itself; a hot one, with a noticeable share of all n-grams, falls into its three-byte contexts,
whose sums meet again for the few hot ones alone. Only the nodes of those and the 65,536 below single
bytes meet on the driver, and every block gets back the values of its own n-grams: the model is never in
one place, and nothing is pruned. The numbers of blocks and of tasks grow with the corpus, so that what a
task holds does not.

Nulls count as empty texts, which have one token, the end. Repeated rows are scored alike. Extra
columns are ignored. Without training texts all estimates are the prior's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .scratch import written

DEPTH = 5
END = 0xFF
#: Bytes of text that a block holds on average, and n-grams that a task works out, about.
BLOCK_BYTES, TASK_GRAMS = 32 << 20, 400_000
#: A two-byte context is hot from this share of all n-grams, if that is so many at least.
HOT_SHARE, HOT_GRAMS = 1 / 256, 4_000

U64 = np.uint64
_WORD = U64(1 << 63)
_END_WORD = np.array([tx.mix_int(0xE0F) | 1 << 63], U64)


#: N-grams of a text that are made at once; a longer text takes several rounds.
SPAN_GRAMS = 1 << 20


def byte_grams(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """For each byte and the end mark of each text, the ``DEPTH`` bytes before it, nearest first, and itself, in spans."""
    n_docs = len(off) - 1
    total = DEPTH + len(data) + n_docs * (DEPTH + 1)
    padded = np.full(total + 8, END, np.uint8)
    mine = np.ones(total, bool)
    mine[:DEPTH] = False
    ends = DEPTH + off[1:] + (DEPTH + 1) * np.arange(n_docs)
    mine[ends[:, None] + np.arange(DEPTH + 1)] = False
    padded[:total][mine] = data
    mine[ends] = True
    # the eight bytes from each place on, as little-endian numbers: the farthest byte of a context is their lowest
    eight = np.ndarray(total, "<u8", padded, strides=(1,))
    for a in range(DEPTH, total - DEPTH, SPAN_GRAMS):
        b = min(total - DEPTH, a + SPAN_GRAMS)
        grams = eight[a - DEPTH : b - DEPTH] << U64(64 - 8 * DEPTH)
        grams >>= U64(56 - 8 * DEPTH)
        grams |= padded[a:b]
        yield grams[mine[a:b]]


def word_keys(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each word of each text, without the end marks; offsets."""
    starts, ends, first = tx.words(data, off, tx.SPACES)
    return tx.word_hashes(data, starts, ends) | _WORD, first


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[begin], np.add.reduceat(n, begin)


def _unique(keys: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[begin], np.diff(np.append(begin, len(keys))) * sign


def block_counts(table: pa.Table) -> pa.Table:
    """The keys of a block's texts and how often its training texts have them."""
    parts: list = []
    most = 1_000_000
    block = table.column("block")[0].as_py()
    for piece in tx.pieces(table, "text"):
        held = piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for out in (True, False):
            some = piece.filter(pa.array(held == out))
            if not len(some):
                continue
            data, off = tx.flat(some.column("text"))
            data = tx.LOWER[data]
            parts += [_unique(grams, 0 if out else 1) for grams in byte_grams(data, off)]
            keys, _ = word_keys(data, off)
            if len(keys):
                parts.append(_unique(keys, 0 if out else 1))
            parts.append((_END_WORD, np.array([0 if out else len(some)])))
        if sum(len(p[0]) for p in parts) > most:
            parts = [_counted(parts)]
            most = max(1_000_000, 2 * len(parts[0][0]))
    keys, n = _counted(parts)
    return pa.table({"block": pa.array(np.full(len(keys), block, np.int32)), "key": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})


_SHIFT = 8


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0, by Stirling's series after eight steps of the recurrence."""
    below = np.ones_like(x)
    for i in range(_SHIFT):
        below *= x + i
    z = x + _SHIFT
    r = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z - np.log(below)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _begin(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))


def _sums(ids: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    begin = _begin(ids)
    return (ids[begin], *[np.add.reduceat(v[order], begin) for v in values])


class Forest:
    """The context trees of some n-grams, depths ``low`` to ``DEPTH``: their nodes are worked out bit by bit.

    At each depth the n-grams are cut to that many context bytes and sorted once; the nodes of any bit of
    the last byte are then runs of that order.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, low: int = 2):
        self.cut: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.low = low
        place = np.arange(len(keys))
        for d in range(DEPTH, low - 1, -1):
            short = (keys if d == DEPTH else keys >> U64(16) << U64(8)) | keys & U64(255)
            order = np.argsort(short, kind="stable")
            begin = _begin(short[order])
            group = np.empty(len(keys), np.int64)
            group[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(keys))))
            keys, n, place = short[order][begin], np.add.reduceat(n[order], begin), group[place]
            self.cut[d] = (keys, n, place)

    def bit(self, bit: int) -> dict[int, tuple]:
        """By depth: node ids, zeros, ones, ln(Pe / product of longer), ln Pw, and each n-gram's node."""
        out: dict[int, tuple] = {}
        below = None
        for d in range(DEPTH, self.low - 1, -1):
            keys, n, place = self.cut[d]
            ids = keys >> U64(8 - bit)
            begin = _begin(ids)
            node = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(ids))))
            one = (keys >> U64(7 - bit) & U64(1)).astype(bool)
            zeros, ones = np.add.reduceat(np.where(one, 0, n), begin), np.add.reduceat(np.where(one, n, 0), begin)
            ids = ids[begin]
            own = log_kt(zeros.astype(float), ones.astype(float))
            if below is None:
                ratio, weighted = np.full(len(ids), np.inf), own
            else:
                parent = below[0] >> U64(8 + bit) << U64(bit) | below[0] & U64((1 << bit) - 1)
                product = np.bincount(np.searchsorted(ids, parent), below[1], len(ids))
                ratio, weighted = own - product, np.logaddexp(own, product) - math.log(2)
            below = (ids, weighted)
            out[d] = (ids, zeros, ones, ratio, weighted, node[place])
        return out


def mixed(q: np.ndarray, seen: np.ndarray, zeros: np.ndarray, ones: np.ndarray, ratio: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prediction for a bit with one more, shorter, context; ``seen``: whether a longer one was there."""
    total = zeros + ones
    here = (np.where(one, ones, zeros) + 0.5) / (total + 1.0)
    weight = 1 / (1 + np.exp(-np.clip(ratio, -700, 700)))
    there = total > 0
    q = np.where(there, np.where(seen, weight * here + (1 - weight) * q, here), q)
    return q, seen | there


class Top:
    """Depths 0 and 1 for all contexts, dense arrays over 256 x 256 nodes, and depth 2 for the hot ones.

    ``rows`` hold sums over the contexts below a node: node, zeros, ones, ln of the product of their Pw.
    Nodes of depth 1 are numbered byte << 8 | bits, those of depth 2 behind them 1 << 24 | pair << 8 | bits.
    """

    def __init__(self, rows: list[tuple[int, int, int, float]], hot: np.ndarray | None = None):
        self.hot = np.zeros(0, np.int64) if hot is None else np.sort(hot)
        self.zeros, self.ones, below = np.zeros(65536), np.zeros(65536), np.zeros(65536)
        ids = np.array([r[0] for r in rows], np.int64)
        sums = [np.array([r[i] for r in rows], np.float64) for i in (1, 2, 3)]
        deep = ids >> 24 > 0
        order = np.argsort(ids[deep])
        self.ids2, (self.zeros2, self.ones2, product) = ids[deep][order] - (1 << 24), [x[deep][order] for x in sums]
        own = log_kt(self.zeros2, self.ones2)
        self.ratio2 = own - product
        weighted = np.logaddexp(own, product) - math.log(2)
        parent = self.ids2 >> 16 << 8 | self.ids2 & 255
        for target, shallow, more in ((self.zeros, sums[0], self.zeros2), (self.ones, sums[1], self.ones2), (below, sums[2], weighted)):
            np.add.at(target, ids[~deep], shallow[~deep])
            np.add.at(target, parent, more)
        own = log_kt(self.zeros, self.ones)
        self.ratio = own - below
        weighted = np.logaddexp(own, below) - math.log(2)
        seen = self.zeros + self.ones > 0
        shape = lambda x: np.where(seen, x, 0).reshape(256, 256).sum(0)
        self.zeros0, self.ones0 = shape(self.zeros), shape(self.ones)
        self.ratio0 = log_kt(self.zeros0, self.ones0) - shape(weighted)


def _joined(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(b.column(0).to_numpy().view(U64), b.column(1).to_numpy()) for b in batches if len(b)]
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _parted(keys: np.ndarray, n: np.ndarray, hot: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The n-grams by the depth at which their trees are whole: 2, and 3 for hot pairs."""
    warm = np.isin((keys >> U64(8 * (DEPTH - 1))).astype(np.int64), hot)
    for low, some in ((2, ~warm), (3, warm)):
        if some.any():
            yield low, keys[some], n[some]


def subtree_weights(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the n-grams of whole contexts: counts and ln of the products of Pw for the nodes one byte above."""
        keys, n = _joined(batches)
        for low, keys, n in _parted(keys, n, hot):  # noqa: B020
            forest = Forest(keys, n, low)
            for bit in range(8):
                ids, zeros, ones, _, weighted, _ = forest.bit(bit)[low]
                node = ids & U64((1 << bit) - 1) | U64(1 << bit)
                above = ids >> U64(8 + bit) << U64(8) | node | (U64(1 << 24) if low == 3 else U64(0))
                ids, zeros, ones, weighted = _sums(above, zeros, ones, weighted)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(zeros), pa.array(ones), pa.array(weighted)], ["node", "zeros", "ones", "weighted"])

    return run


def gram_values(top: Top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """ln probability of the last byte of each n-gram after the others."""
        keys, n = _joined(batches)
        for low, keys, n in _parted(keys, n, top.hot):  # noqa: B020
            value = np.zeros(len(keys))
            forest = Forest(keys, n, low)
            last = (keys >> U64(8 * DEPTH)).astype(np.int64)
            pair = (keys >> U64(8 * (DEPTH - 1))).astype(np.int64)
            for bit in range(8):
                one = (keys >> U64(7 - bit) & U64(1)).astype(bool)
                q, seen = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
                for _, zeros, ones, ratio, _, own in forest.bit(bit).values():
                    q, seen = mixed(q, seen, zeros[own], ones[own], ratio[own], one)
                node = ((keys & U64(255)) >> U64(8 - bit) | U64(1 << bit)).astype(np.int64)
                if low == 3:
                    at = np.searchsorted(top.ids2, pair << 8 | node)
                    q, seen = mixed(q, seen, top.zeros2[at], top.ones2[at], top.ratio2[at], one)
                both = last << 8 | node
                q, seen = mixed(q, seen, top.zeros[both], top.ones[both], top.ratio[both], one)
                q, seen = mixed(q, seen, top.zeros0[node], top.ones0[node], top.ratio0[node], one)
                value += np.log(q)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(value)], ["key", "value"])

    return run


#: No key of a word (the highest bit is set) or an n-gram (``DEPTH`` + 1 bytes).
_FREE = U64(1 << 62)
#: Keys that are looked up at once.
_SPAN_KEYS = 1 << 16


class Table:
    """Values by distinct keys in a hash table with linear probing, at most half full: a key takes about one read, where a binary search takes twenty."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(1, (2 * len(keys)).bit_length())
        self.shift, self.last = U64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _FREE), np.zeros(1 << bits)
        at = self._first(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == _FREE]
            self.keys[at[free]] = keys[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = at[left] + 1 & self.last
        self.values[at] = values

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (tx.mix(keys) >> self.shift).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where in ``values`` each key's value is; an error if a key is missing."""
        out = np.empty(len(keys), np.int64)
        for a in range(0, len(keys), _SPAN_KEYS):
            some = keys[a : a + _SPAN_KEYS]
            at = self._first(some)
            left = np.flatnonzero(self.keys[at] != some)
            while len(left):
                if (self.keys[at[left]] == _FREE).any():
                    raise KeyError("a key of the block has no value")
                at[left] = at[left] + 1 & self.last
                left = left[self.keys[at[left]] != some[left]]
            out[a : a + _SPAN_KEYS] = at
        return out


def _scores(train_tokens: int, distinct: int):
    low = train_tokens + 0.5 * (distinct + 1)

    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        keys, value = values.column("key").to_numpy().view(U64), values.column("value").to_numpy()
        is_word = keys >= _WORD
        grams, counts = Table(keys[~is_word], value[~is_word]), Table(keys[is_word], value[is_word])
        count = counts.values
        base = np.log10((count + 0.5) / low)
        end = int(counts.places(_END_WORD)[0])
        columns: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        for piece in tx.pieces(docs, "text"):
            data, off = tx.flat(piece.column("text"))
            data = tx.LOWER[data]
            each = [grams.values[grams.places(found)] for found in byte_grams(data, off)]
            columns["score"].append(np.add.reduceat(np.concatenate(each), off[:-1] + np.arange(len(off) - 1)) / math.log(10))
            found, first = word_keys(data, off)
            slot = counts.places(found)
            sums = np.concatenate(([0.0], np.cumsum(base[slot])))
            known = np.concatenate(([0], np.cumsum(count[slot] > 0)))
            columns["base_score"].append(sums[first[1:]] - sums[first[:-1]] + base[end])
            columns["n_known"].append(known[first[1:]] - known[first[:-1]] + int(count[end] > 0))
            columns["n_tokens"].append(np.diff(first) + 1)
        joined = {k: np.concatenate(v) for k, v in columns.items()}
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(joined["n_tokens"].astype(np.int64)),
                "n_known": pa.array(joined["n_known"].astype(np.int64)),
                "train_tokens": pa.array(np.full(len(docs), train_tokens, np.int64)),
                "base_score": pa.array(joined["base_score"]),
                "score": pa.array(joined["score"]),
            }
        )

    return run


def block_ids(spark: SparkSession, blocks: int) -> list[int]:
    """Ids for so many blocks that hash partitioning deals each to a partition of its own."""
    tried = spark.range(24 * blocks).select(F.col("id").cast("int").alias("id"))
    found = tried.groupBy(F.pmod(F.hash("id"), F.lit(blocks)).alias("part")).agg(F.min("id").alias("id")).collect()
    spare = iter(range(24 * blocks, 25 * blocks))
    own = {r.part: r.id for r in found}
    return [own[p] if p in own else next(spare) for p in range(blocks)]


#: Blocks, at most, whose ids are chosen; of more the unequal shares even out among the many tasks.
CHOSEN = 4096


def score_documents(docs: DataFrame, held_out: str = "held_out") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    ``docs`` has ``doc_id``, ``text`` and a boolean column ``held_out``, true where a text isn't learned from.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(held_out), F.lit(True)).alias("held_out"))
    total = docs.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.crc32("text")), F.lit(blocks)).cast("int")
    if blocks <= CHOSEN:
        block = F.get(F.array(*map(F.lit, block_ids(docs.sparkSession, blocks))), block)
    blocked = docs.withColumn("block", block).repartition(blocks, "block")
    counted = written(blocked.groupBy("block").applyInArrow(block_counts, "block int, key bigint, n bigint"), "counts")
    sums = written(counted.groupBy("key").agg(F.sum("n").alias("n")), "sums")
    words = sums.where("key < 0 and n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    grams = sums.where("key >= 0").withColumn("pair", F.shiftright("key", 8 * (DEPTH - 1)))
    pairs = {r.pair: r.k for r in grams.groupBy("pair").agg(F.count("*").alias("k")).collect()}
    total = sum(pairs.values())
    hot = np.array([p for p, k in pairs.items() if k >= max(HOT_GRAMS, HOT_SHARE * total)], np.int64)
    third = F.when(F.col("pair").isin(*hot.tolist()), F.shiftright("key", 8 * (DEPTH - 2))).otherwise(F.lit(-1)) if len(hot) else F.lit(-1)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_GRAMS)
    trees = grams.withColumn("third", third.cast("bigint")).repartition(tasks, "pair", "third").select("key", "n")
    nodes = trees.mapInArrow(subtree_weights(hot), "node bigint, zeros bigint, ones bigint, weighted double")
    top = Top([tuple(r) for r in nodes.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).collect()], hot)
    values = trees.mapInArrow(gram_values(top), "key bigint, value double")
    values = values.union(sums.where("key < 0").select("key", F.col("n").cast("double").alias("value")))
    back = counted.select("block", "key").join(values, "key").select("block", "key", "value").repartition(blocks, "block")
    schema = f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocked.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scores(int(words.n or 0), int(words.v or 0)), schema)

"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of 13 consecutive words (a shorter item is one window). A window
occurs in a document only if all its four-word shingles do, so one of them, the rarest by its count over
all documents, is a sufficient prefix: documents are scanned for these shingles alone. A hit fixes where
the window would start; length and position must leave room for it, and its words are then compared
one by one.

The benchmark is read in rounds of at most ``ROUND_WORDS`` words, which the driver holds as plain text. A round's
shingles are counted in one pass over all documents; its windows are then taken in blocks of at most
``WINDOWS_PER_BLOCK``, each block's index being small enough to send to every task. All blocks of all rounds
scan a document in the same stage. Documents are never shuffled.

Words are runs of 0-9, a-z (after A-Z are lower-cased) and characters from U+0080 on. Nulls and empty
texts have no words and no hits; a null item has no windows; a null item id reads as an empty one. Repeated
rows give repeated results; items that share an id count once. Extra columns of either table don't matter. An empty benchmark or an empty
document table gives no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

WINDOW = 13
SHINGLE = 4
WINDOWS_PER_BLOCK, ROUND_WORDS = 200_000, 2_000_000

U64 = np.uint64


def _split(text: str | None) -> list[bytes]:
    data = tx.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = tx.words(data, np.array([0, len(data)]), tx.NON_ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the run of ``n`` words from each position; the last n - 1 are missing."""
    return tx.ngram_hashes(hashes, n) if len(hashes) >= n else np.zeros(0, U64)


class Block:
    """Windows of some items: words, owning items and, by length, the shingles they hold."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.windows: list[tuple[bytes, ...]] = []
        self.owners: list[set[str]] = []
        known: dict[tuple[bytes, ...], int] = {}
        self.grams: list[tuple[int, np.ndarray]] = []
        for item, words in items:
            if not words:
                continue
            joined = np.frombuffer(b"".join(words), np.uint8)
            ends = np.cumsum([len(w) for w in words])
            hashes = tx.word_hashes(joined, np.concatenate(([0], ends[:-1])), ends)
            size, n = min(WINDOW, len(words)), min(SHINGLE, len(words))
            runs = _runs(hashes, n)
            for at in range(len(words) - size + 1):
                window = tuple(words[at : at + size])
                if window not in known:
                    known[window] = len(self.windows)
                    self.windows.append(window)
                    self.owners.append(set())
                    self.grams.append((n, runs[at : at + size - n + 1]))
                self.owners[known[window]].add(item)

    def shingles(self) -> dict[int, np.ndarray]:
        return {n: np.unique(np.concatenate([g for k, g in self.grams if k == n])) for n in {k for k, _ in self.grams}}

    def prefixes(self, totals: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]]:
        """By shingle length: the prefix shingles, sorted, and for each the windows with its place in them."""
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        counts: dict[tuple[int, int], int] = {}
        for n, own in self.shingles().items():
            keys, seen = totals.get(n, (np.zeros(0, U64), np.zeros(0, np.int64)))
            hit, at = _found(keys, own) if len(keys) else ((), ())
            counts |= {(n, int(own[i])): int(seen[j]) for i, j in zip(hit, at, strict=True)}
        for w, (n, grams) in enumerate(self.grams):
            _, gram, at = min((counts.get((n, int(g)), 0), int(g), at) for at, g in enumerate(grams))
            found.setdefault(n, {}).setdefault(gram, []).append((w, at))
        return {n: (np.array(sorted(by), U64), [by[g] for g in sorted(by)]) for n, by in found.items()}


def rounds(items: Iterator[tuple[str, str | None]], limit: int) -> Iterator[list[tuple[str, str | None]]]:
    held: list[tuple[str, str | None]] = []
    size = 0
    for item, text in items:
        more = len((text or "").split()) + 1
        if held and size + more > limit:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += more
    if held:
        yield held


def round_shingles(items: list[tuple[str, str | None]]) -> dict[int, np.ndarray]:
    """By length, all shingles that the windows of some items hold."""
    parts: dict[int, list[np.ndarray]] = {}
    for _, text in items:
        data = tx.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        starts, ends, _ = tx.words(data, np.array([0, len(data)]), tx.NON_ALNUM)
        if len(starts):
            n = min(SHINGLE, len(starts))
            parts.setdefault(n, []).append(_runs(tx.word_hashes(data, starts, ends), n))
    return {n: np.unique(np.concatenate(p)) for n, p in parts.items()}


def blocks(items: Iterator[tuple[str, str | None]], limit: int) -> Iterator[Block]:
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for item, text in items:
        words = _split(text)
        more = max(1, len(words) - WINDOW + 1)
        if held and size + more > limit:
            yield Block(held)
            held, size = [], 0
        held.append((item, words))
        size += more
    if held:
        yield Block(held)


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for piece in tx.pieces(batch, "text"):
        data, off = tx.flat(piece.column(piece.schema.get_field_index("text")))
        data = tx.LOWER[data]
        starts, ends, first = tx.words(data, off, tx.NON_ALNUM)
        yield piece, data, starts, ends, first, tx.word_hashes(data, starts, ends)


def _found(sorted_keys: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, runs), len(sorted_keys) - 1)
    hit = np.flatnonzero(sorted_keys[at] == runs)
    return hit, at[hit]


def _counting(shingles: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {n: np.zeros(len(keys), np.int64) for n, keys in shingles.items()}
        for batch in batches:
            for *_, hashes in _tokens(batch):
                for n, keys in shingles.items():
                    # runs over the end of a text are counted too: the order needs no exact counts
                    totals[n] += np.bincount(_found(keys, _runs(hashes, n))[1], minlength=len(keys))
        for n, keys in shingles.items():
            some = totals[n] > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), n, np.int32)), pa.array(keys[some].view(np.int64)), pa.array(totals[n][some])], ["length", "gram", "count"])

    return run


def _scanning(block: Block, prefixes: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, starts, ends, first, hashes in _tokens(batch):
                hits: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
                for n, (keys, places) in prefixes.items():
                    at, which = _found(keys, _runs(hashes, n))
                    owner = np.searchsorted(first, at, "right") - 1
                    for pos, k, doc in zip(at.tolist(), which.tolist(), owner.tolist(), strict=True):
                        for w, place in places[k]:
                            window, begin = block.windows[w], pos - place
                            if begin < first[doc] or begin + len(window) > first[doc + 1]:
                                continue
                            if any(data[starts[begin + i] : ends[begin + i]].tobytes() != word for i, word in enumerate(window)):
                                continue
                            spans, items = hits.setdefault(doc, ([], set()))
                            spans.append((begin - int(first[doc]), begin - int(first[doc]) + len(window)))
                            items |= block.owners[w]
                old_spans, old_items = piece.column(piece.schema.get_field_index("spans")).to_pylist(), piece.column(piece.schema.get_field_index("items")).to_pylist()
                for doc, (spans, items) in hits.items():
                    joined: list[list[int]] = []
                    for a, b in sorted([*spans, *zip(old_spans[doc][::2], old_spans[doc][1::2], strict=True)]):
                        if joined and a <= joined[-1][1]:
                            joined[-1][1] = max(b, joined[-1][1])
                        else:
                            joined.append([a, b])
                    old_spans[doc], old_items[doc] = [x for span in joined for x in span], sorted(items.union(old_items[doc]))
                out = {name: piece.column(i) for i, name in enumerate(piece.schema.names)}
                out |= {"n_words": pa.array(np.diff(first).astype(np.int64)), "spans": pa.array(old_spans, pa.list_(pa.int64())), "items": pa.array(old_items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, limit: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """``docs`` with ``n_words, spans, items`` for each document.

    ``spans`` are the ends of disjoint runs of hit words (from, to, from, to, ...; word positions from 0),
    ``items`` the ids, as strings, of items with a window in the text.
    """
    docs = docs.select(*(n for n in docs.columns if n not in ("n_words", "spans", "items")))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    out = docs.select("*", F.lit(0).cast("bigint").alias("n_words"), F.expr("cast(array() as array<bigint>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    schema = out.schema
    any_block = False
    for held in rounds(((r.item_id, r.text) for r in items.toLocalIterator()), ROUND_WORDS):
        shingles = round_shingles(held)
        counts = docs.select("text").mapInArrow(_counting(shingles), "length int, gram bigint, count bigint").groupBy("length", "gram").agg(F.sum("count").alias("n"))
        table = counts.toArrow() if shingles else None
        totals = {}
        for n in shingles:
            own = table.filter(pa.compute.equal(table.column("length"), n))
            grams, seen = own.column("gram").to_numpy().view(U64), own.column("n").to_numpy()
            order = np.argsort(grams)
            totals[n] = (grams[order], seen[order])
        for block in blocks(iter(held), limit):
            out = out.mapInArrow(_scanning(block, block.prefixes(totals)), schema)
            any_block = True
    return out if any_block else out.mapInArrow(_scanning(Block([]), {}), schema)


def _n_hit() -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("spans") / 2 - 1).cast("int"), F.lit(1)), lambda i: F.get("spans", 2 * i + 1) - F.get("spans", 2 * i))
    return F.when(F.size("spans") > 0, F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, x: s + x)).otherwise(F.lit(0).cast("bigint"))


def _contaminated(n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``: at least a twentieth of the words are hit."""
    hits = benchmark_hits(docs.select("doc_id", "text"), benchmark)
    out = hits.select("doc_id", "n_words", _n_hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", _contaminated(F.col("n_hit")))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated."""
    return benchmark_hits(docs, benchmark).where(~_contaminated(_n_hit())).select(*docs.columns)

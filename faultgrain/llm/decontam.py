"""Benchmark decontamination by size-partitioned MinHash containment search.

An item's set holds its five-word shingles; an item of one to four words is a
single shingle of that many words. Items are partitioned by size, and each
partition has its own sketch length: the smallest ``sketch_length(size)``
hashes of the set. A long document is not sketched, as a short item would
vanish in its sketch; the item's sketch is looked up among the document's
shingles instead, so the share that is found estimates containment whatever the
lengths. Of a set that is sketched whole that share is exact; of others a
document needs ``least_found(size)`` values, which a containment of 0.8 misses with a
probability below 1e-8. What passes is verified on the full shingle sets.

The item side is broadcast in blocks of at most ``BLOCK_VALUES`` hashes; with
more items the documents pass through one block after another, each released
before the next.

Defined cases: null, empty and blank texts hold no item and are no item; equal
items are each reported; repeated document rows are each reported.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import cut, fresh

SHINGLE = 5
PERCENT = 80
BLOCK_VALUES = 1 << 21
_FOUND = "array<struct<item_id: long, n_item: long, n_shared: long>>"
_FILTER_BITS = 22


def sketch_length(size: int) -> int:
    """Sketch values of the partition that holds sets of ``size`` shingles: 32, and one more for each doubling beyond 64."""
    return min(size, 32 + max(0, size.bit_length() - 7))


def least_found(size: int) -> int:
    """Sketch values of a set of ``size`` that a document with 80 % of the set holds."""
    k = sketch_length(size)
    return -(-PERCENT * k // 100) if k == size else k // 3


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, ends in _text.slices(batch.column(1)):
            found = _text.words(data, ends)
            counts = np.diff(np.concatenate([[0], found.ends]))
            sets = _text.distinct(_text.shingles(found, SHINGLE, True))
            stops = sets.ends.tolist()
            values = [sets.hashes[s:e].tobytes() for s, e in zip([0, *stops], stops, strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.minimum(counts, SHINGLE).astype(np.int32)),
                    pa.array(np.diff(np.concatenate([[0], sets.ends]))),
                    pa.array(values, pa.binary()),
                ],
                names=["item_id", "width", "size", "hashes"],
            )


class _Block:
    """Items of one broadcast block, ready for lookups, by shingle width."""

    def __init__(self, rows: list) -> None:
        self.ids = [r["item_id"] for r in rows]
        self.sets = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        self.widths = {}
        for width in sorted({r["width"] for r in rows}):
            values, owners = [], []
            for i, r in enumerate(rows):
                if r["width"] == width:
                    values.append(self.sets[i][: sketch_length(r["size"])])  # sets are sorted
                    owners.append(np.full(len(values[-1]), i))
            values, owners = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(values, kind="stable")
            values = values[order]
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[values & np.uint64((1 << _FILTER_BITS) - 1)] = True
            self.widths[width] = values, owners[order], maybe

    def find(self, words: _text.Words) -> list[list[tuple[int, int, int]]]:
        out: list[list] = [[] for _ in words.ends]
        for width, (values, owners, maybe) in self.widths.items():
            # An item of fewer words than SHINGLE is one shingle hashed from exactly its words.
            hashes, ends = _text.shingles(words, width, False)
            if width < SHINGLE:
                hashes = _whole_hashes(words, width)
            at = np.flatnonzero(maybe[hashes & np.uint64((1 << _FILTER_BITS) - 1)])
            low, high = np.searchsorted(values, hashes[at], "left"), np.searchsorted(values, hashes[at], "right")
            hit = high > low
            at, low, high = at[hit], low[hit], high[hit]
            if not len(at):
                continue
            rows = np.searchsorted(ends, at, side="right")
            found = {(r, owners[k], k) for r, a, b in zip(rows.tolist(), low.tolist(), high.tolist(), strict=True) for k in range(a, b)}
            pairs = Counter((row, item) for row, item, _ in found)
            own_row, own = -1, None
            for (row, item), n in sorted(pairs.items()):
                if n < least_found(len(self.sets[item])):
                    continue
                if row != own_row:
                    own_row, own = row, np.unique(hashes[ends[row - 1] if row else 0 : ends[row]])
                full = self.sets[item]
                place = np.searchsorted(own, full)
                place[place == len(own)] = 0
                shared = int((own[place] == full).sum())
                if 100 * shared >= PERCENT * len(full):
                    out[row].append((self.ids[item], len(full), shared))
        return out


def _whole_hashes(words: _text.Words, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words as ``shingles`` gives them to whole short texts."""
    hashes, ends = words
    starts = np.concatenate([[0], ends[:-1]])
    counts = ends - starts
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = _text.mix(np.full(n, width, np.uint64))
    for k in range(width):
        value = _text.mix(value * np.uint64(0xA24BAED4963EE407) + hashes[k : k + n])
    row_of = np.repeat(np.arange(len(ends)), counts)
    return value[row_of[:n] == row_of[width - 1 :]]


_ready: dict = {}


def _search(block, column: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ready:
            _ready.clear()
            _ready[key] = _Block(block.value)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())]))
        for batch in batches:
            names = batch.schema.names
            found = []
            for _, _, data, ends in _text.slices(batch.column(names.index("text"))):
                found += _ready[key].find(_text.words(data, ends))
            at = names.index(column)
            before = batch.column(at).to_pylist()
            rows = [[*b, *({"item_id": i, "n_item": n, "n_shared": s} for i, n, s in f)] for b, f in zip(before, found, strict=True)]
            yield batch.set_column(at, column, pa.array(rows, kind))

    return run


def find_items(docs: DataFrame, items: DataFrame, column: str, block_values: int = BLOCK_VALUES) -> DataFrame:
    """``docs`` with an array ``column`` of the items of ``items(item_id, text)`` that each text contains."""
    spark = docs.sparkSession
    sets = items.select("item_id", "text").mapInArrow(_item_sets, "item_id long, width int, size long, hashes binary")
    sets = cut(sets.where("size > 0"))
    total = sets.agg(F.sum("size").alias("n")).collect()[0]["n"] or 0
    blocks = -(-total // block_values)
    out = docs.withColumn(column, F.from_json(F.lit("[]"), _FOUND))
    for i in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("hashes"), F.lit(blocks)) == i).collect()  # about block_values hashes
        if rows:
            if i:
                out = cut(out)
            block = spark.sparkContext.broadcast([r.asDict() for r in rows])
            out = out.mapInArrow(_search(block, column, f"{block._jbroadcast.id()}"), out.schema)
    return out


def contaminated_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): items with at least 80 % of their shingles in the document."""
    found = find_items(docs.select("doc_id", "text"), items, "found")
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.item_id", "f.n_item", "f.n_shared")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item; all columns kept."""
    column = fresh(docs, "found")
    return find_items(docs, items, column).where(F.size(column) == 0).drop(column)

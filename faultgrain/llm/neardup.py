"""Near-duplicate groups by bottom-k sketches and exact Jaccard similarity.

A document's set is its distinct word shingles. Equal sets form a class, so
copies cost one row each and are never paired; classes are told apart by a
128-bit digest of the whole set. A class's sketch is the 64 smallest values of
one hash function over its set.

Inverted lists are kept of neighbouring values: each two values that follow one
another in a sketch are one key. Single values would do as well on small
tables, but their lists grow with the corpus (any common word pair), while two
unrelated sets hardly ever hold the same neighbours. Of the 64 values of the
union's sketch, two sets of similarity 0.8 share each with probability 0.8, and
fewer than 12 of the 63 neighbours with a probability below 1e-8; of sets that
are sketched whole the least number is exact. So it is enough to keep, of each
sketch, all but one less than that number of keys: those that are rarest in the
corpus.

Links are found in rounds. First each class is compared with at most ``PIVOTS``
pivot classes of its lists, then those outside a list's largest component with as
many members of it, as long as that leaves a third fewer. This only saves work:
what is still outside is then compared with all members of its lists, block
against block. Sets are shipped once for each block they meet, not once for each
pair, pairs stay inside a task, and a task returns a spanning forest of the
components that it links. In all rounds the overlap in the sketch of the union
estimates the similarity, and what may reach 0.8 is verified on the full sets.

Bounds: a block holds sets of about ``BLOCK_BYTES`` and meets others of about
``PART_BYTES`` at a time (a larger set is a block of its own); ids are broadcast
up to ``BROADCAST_ROWS`` rows, more are joined by a shuffle; so are sizes and
components of classes. Up to ``graph.TASK_EDGES`` links are followed in one task.

Defined cases: documents without words have an empty set and link with
nothing; with fewer words than a shingle the whole sequence is one shingle;
each row is judged by its own text, so rows that share a doc_id may differ; rows
with a null doc_id are never linked (component_id null, kept true).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._store import cut, fresh
from .graph import components

SKETCH = 64
SHARED = 32
NEIGHBOURS = 12
PIVOTS = 4
BROADCAST_ROWS = 1 << 20
BLOCK_BYTES = 1 << 20
PART_BYTES = 1 << 22
_LEAST_WEIGHT = 2048
_WHOLE = SKETCH * 4 // 5  # partners of sets up to this size are sketched whole


@lru_cache(1)
def least_neighbours() -> np.ndarray:
    """Neighbours that a set of each size, up to _WHOLE + 1 for larger ones, shares with any set of similarity 0.8.

    Of s shared and d other values in a union, each other one parts at most one
    pair of them, so s - 1 - d neighbours are left; s is at least 4 d. Sets below
    four values have no partner.
    """
    out = np.full(_WHOLE + 2, NEIGHBOURS)
    for n in range(_WHOLE + 1):
        out[n] = min((n - lost - 1 - d for lost in range(n) for d in range(lost, (n - lost) // 4 + 1)), default=0)
    return out


def neighbours(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of neighbouring values of sketches with these sizes, and how many each sketch has."""
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    keys = _text.mix(values[:-1] * np.uint64(0xA24BAED4963EE407) + values[1:])
    ends = np.cumsum(sizes)
    inside = np.ones(len(keys), bool)
    inside[ends[(ends > 0) & (ends < len(values))] - 1] = False
    return keys[inside], np.maximum(sizes - 1, 0)


def _digest(own: np.ndarray) -> bytes | None:
    return blake2b(own, digest_size=16).digest() if len(own) else None


def _distinct_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for a, b, data, ends in _text.slices(column):
        sets = _text.distinct(_text.shingles(_text.words(data, ends), width, True))
        stops = sets.ends.tolist()
        yield a, b, [sets.hashes[s:e] for s, e in zip([0, *stops], stops, strict=False)]


def document_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch) of each row; the digest of an empty set is null.

    Of the sketch's values the upper halves are kept, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _distinct_sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.array([(s[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch binary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least = least_neighbours()
    for batch in batches:
        raw = batch.column(2).to_pylist()
        keys, sizes = neighbours(np.frombuffer(b"".join(raw), "<u4").astype(np.uint64), np.array([len(x) // 4 for x in raw], np.int64))
        n = batch.column(1).to_numpy()
        dropped = np.where(n < 4, sizes, least[np.minimum(n, _WHOLE + 1)] - 1)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(_text.longs(keys)), batch.column(0).take(pa.array(rows)), pa.array(dropped[rows].astype(np.int8))], names=["key", "class", "dropped"]
        )


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(key, class, n): entries of keys that n > 1 classes have, of each class all but the ``dropped`` most frequent ones."""
    entries = classes.select("class", "n_shingles", "sketch").mapInArrow(_keys, "key long, class long, dropped tinyint")
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    often = Window.partitionBy("class").orderBy(F.desc("n"), "key")  # at most SKETCH rows
    kept = entries.join(sizes, "key").withColumn("rank", F.row_number().over(often))
    kept = cut(kept.where("rank > dropped").drop("rank", "dropped"))
    # A key that one class alone keeps is no list.
    sizes = kept.groupBy("key").agg(F.count("*").alias("kept")).where("kept > 1").select("key")
    return cut(kept.join(sizes, "key", "left_semi"))


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has at most ``BROADCAST_ROWS`` (of a few numbers each)."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Listed(NamedTuple):
    """The classes in lists."""

    full: DataFrame  # (class, shingles), a few copies where doc_ids repeat
    sizes: DataFrame  # (class, n_shingles)
    few: bool  # at most BROADCAST_ROWS classes

    def hint(self, df: DataFrame) -> DataFrame:
        """``df``, of at most a row for each class, to be broadcast if these are few."""
        return F.broadcast(df) if self.few else df


def _listed_sets(lists: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> Listed:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, _, sets in _distinct_sets(batch.column(0), width):
                new = {d: s for s in sets if len(s) and (d := _digest(s)) not in seen}
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array([s.tobytes() for s in new.values()], pa.binary())], names=["digest", "shingles"])

    wanted = lists.select("class").distinct().join(classes.select("class", "rep", "digest", "n_shingles"), "class")
    wanted = cut(wanted)
    few = wanted.count() <= BROADCAST_ROWS
    ids = F.broadcast(wanted) if few else wanted
    texts = docs.join(ids.select("rep"), docs.doc_id == F.col("rep"), "left_semi").select("text")
    sets = texts.mapInArrow(run, "digest binary, shingles binary")  # a repeated doc_id may bring another text
    full = cut(sets.join(ids.select("class", "digest"), "digest").select("class", "shingles"))
    return Listed(full, wanted.select("class", "n_shingles"), few)


def _estimate(places: np.ndarray, own: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which sets may be as similar as asked for to one with ``own`` values.

    ``places[i, k]`` is the place, from 1, that set i's sketch gives the k-th
    value of the one's sketch, 0 if it lacks it. The j-th shared value is the
    (k + place - j)-th of the union; those among its first SKETCH count.
    """
    shared = places > 0
    number = np.cumsum(shared, axis=1, dtype=np.int32)
    in_union = (shared & (np.arange(1, places.shape[1] + 1) + places - number <= SKETCH)).sum(axis=1)
    union = own + sizes - number[:, -1]
    exact = (own <= SKETCH) & (sizes <= SKETCH) & (union <= SKETCH)
    return np.where(exact, 100 * in_union >= percent * union, in_union >= SHARED) & (100 * np.minimum(own, sizes) >= percent * np.maximum(own, sizes))


def linked_parts(xs: list[np.ndarray], x_parts: np.ndarray, ys: list[np.ndarray], y_parts: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the components that sets of xs and ys of different components link."""
    known, where = np.unique(np.concatenate(xs), return_inverse=True)
    x_ends = np.cumsum([len(x) for x in xs])
    x_ids = [where[e - len(x) : e] for x, e in zip(xs, x_ends.tolist(), strict=True)]
    sizes = np.array([len(y) for y in ys])
    flat = np.concatenate(ys)
    ids = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    ids[known[ids] != flat] = len(known)
    starts = np.cumsum(sizes) - sizes
    of_sketch = np.unique(np.concatenate([i[:SKETCH] for i in x_ids]))
    rank = np.full(len(known) + 1, len(of_sketch))
    rank[of_sketch] = np.arange(len(of_sketch))
    places = np.zeros((len(ys), len(of_sketch) + 1), np.int16)
    row = np.repeat(np.arange(len(ys)), np.minimum(sizes, SKETCH))
    place = np.arange(len(row)) - np.repeat(np.cumsum(np.minimum(sizes, SKETCH)) - np.minimum(sizes, SKETCH), np.minimum(sizes, SKETCH))
    places[row, rank[ids[starts[row] + place]]] = place + 1
    places[:, -1] = 0
    mark = np.zeros(len(known) + 1, bool)
    top: dict[int, int] = {}

    def root(part: int) -> int:
        while (up := top.get(part, part)) != part:
            top[part] = top.get(up, up)
            part = up
        return part

    out = []
    for own, part in zip(x_ids, x_parts.tolist(), strict=True):
        maybe = _estimate(places[:, rank[own[:SKETCH]]], len(own), sizes, percent) & (y_parts != part)
        at = np.flatnonzero(maybe)
        if not len(at):
            continue
        mark[own] = True
        if 8 * len(at) < len(ys):
            shared = np.array([mark[ids[starts[k] : starts[k] + sizes[k]]].sum() for k in at.tolist()])
        else:
            shared = np.add.reduceat(mark[ids], starts, dtype=np.int64)[at]
        mark[own] = False
        for other in np.unique(y_parts[at[100 * shared >= percent * (len(own) + sizes[at] - shared)]]).tolist():
            a, b = root(part), root(other)
            if a != b:
                top[max(a, b)] = min(a, b)
                out.append((part, other))
    return out


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        is_x = table.column("is_x").to_numpy()
        parts = table.column("component").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        xs, ys = np.flatnonzero(is_x), np.flatnonzero(~is_x)
        found = linked_parts([sets[k] for k in xs], parts[xs], [sets[k] for k in ys], parts[ys], percent) if len(xs) and len(ys) else []
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def _links(members: DataFrame, sets: Listed, percent: int) -> DataFrame:
    """(a, b): components that ``members(block, class, component, is_x)`` link, each block's x against all others of it."""
    weight = F.greatest(F.col("n_shingles") * 8, F.lit(_LEAST_WEIGHT))
    sized = cut(members.join(sets.hint(sets.sizes), "class"))
    parts = sized.where(~F.col("is_x")).groupBy("block").agg(F.ceil(F.sum(weight) / PART_BYTES).alias("parts"))
    own = F.array(F.pmod(F.xxhash64("class"), F.col("parts")))
    placed = sized.drop("n_shingles").join(sets.hint(parts), "block").withColumn("part", F.explode(F.when(F.col("is_x"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)))
    shipped = sets.full.join(_small(placed), "class").select("block", "part", "is_x", "component", "shingles")
    return shipped.groupBy("block", "part").applyInArrow(_compare(percent), "a long, b long")


def _open_entries(lists: DataFrame, groups: DataFrame, sets: Listed) -> DataFrame:
    """(key, class, n, component, main) of the lists that hold several components; main is the largest."""
    placed = lists.join(sets.hint(groups.withColumnRenamed("node", "class")), "class", "left").withColumn("component", F.coalesce("component", "class"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    return cut(placed.join(mixed.drop("parts"), "key"))


def _first_members(lists: DataFrame, sets: Listed) -> DataFrame:
    """Classes against pivots of their lists: those with the most company, likeliest the source of the others.

    Of its lists' pivots a class meets the ``PIVOTS`` that it shares most lists with.
    """
    company = lists.groupBy("class").agg(F.sum("n").alias("company"))
    pivots = lists.join(sets.hint(company), "class").groupBy("key").agg(F.max_by("class", F.struct("company", "class")).alias("block"))
    shared = lists.join(pivots, "key").where("class <> block").groupBy("class", "block").agg(F.count("*").alias("lists"))
    most = Window.partitionBy("class").orderBy(F.desc("lists"), "block")  # at most SKETCH rows
    return shared.withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= PIVOTS).select("block", "class", F.col("class").alias("component"))


def _next_members(open_lists: DataFrame, turn: int) -> DataFrame:
    """Classes outside the largest component of a list against ``PIVOTS`` members of it, others each turn."""
    deal = F.pmod("key", F.lit(PIVOTS)).alias("deal")
    pick = F.max_by("class", F.xxhash64("class", F.lit(turn)))
    pivots = open_lists.where("component = main").groupBy("main", deal).agg(pick.alias("block"))
    outside = open_lists.where("component <> main").select("class", "component", "main", deal).distinct()
    return outside.join(pivots, ["main", "deal"]).select("block", F.col("main").alias("of"), "class", "component").distinct()


def _rest_members(open_lists: DataFrame, sets: Listed) -> DataFrame:
    """Classes outside the largest component of a list, in blocks, against all members of their lists."""
    weight = F.greatest(F.col("n_shingles") * 8, F.lit(_LEAST_WEIGHT))
    outside = open_lists.where("component <> main")
    xs = outside.groupBy("class").agg(F.min("main").alias("near"), F.first("component").alias("component")).join(sets.hint(sets.sizes), "class")
    blocks = xs.groupBy("near").agg(F.ceil(F.sum(weight) / BLOCK_BYTES).alias("blocks"))
    xs = xs.join(sets.hint(blocks), "near").select("class", "component", F.xxhash64("near", F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks"))).alias("block"))
    xs = cut(xs)
    met = outside.select("key", "class").join(sets.hint(xs.select("class", "block")), "class").groupBy("key").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    ys = open_lists.join(met, "key").groupBy("class").agg(F.first("component").alias("component"), F.array_distinct(F.flatten(F.collect_set("blocks"))).alias("blocks"))
    ys = ys.select(F.explode("blocks").alias("block"), "class", "component", F.lit(False).alias("is_x"))
    return ys.unionByName(xs.withColumn("is_x", F.lit(True)))


def class_components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All document rows with the digest of their class, and (digest, group) of the classes; linked ones share a group."""
    if percent < 80:
        raise ValueError("the sketches are laid out for a similarity of 80 % or more")
    rows = cut(document_sets(docs, width))
    classes = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))
    lists = inverted_lists(classes)
    sets = _listed_sets(lists, classes, docs, width)

    def against(members: DataFrame, component: str) -> DataFrame:
        pivots = members.select("block", F.col("block").alias("class"), F.col(component).alias("component")).distinct()
        both = members.select("block", "class", "component", F.lit(False).alias("is_x")).unionByName(pivots.withColumn("is_x", F.lit(True)))
        return cut(_links(both, sets, percent))

    groups = cut(components(against(_first_members(lists, sets), "block")))

    def joined(linked: DataFrame) -> DataFrame:
        return cut(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(linked)))

    open_lists, before, turn = _open_entries(lists, groups, sets), 0, 0
    while left := open_lists.where("component <> main").count():
        if turn and 3 * left > 2 * before:  # pivots no longer help
            groups = joined(cut(_links(_rest_members(open_lists, sets), sets, percent)))
            break
        before, turn = left, turn + 1
        groups = joined(against(_next_members(open_lists, turn), "of"))
        open_lists = _open_entries(lists, groups, sets)
    grouped = classes.select("digest", "class").join(sets.hint(groups.withColumnRenamed("node", "class")), "class", "left")
    return rows, grouped.select("digest", F.coalesce("component", "class").alias("group"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id that links reach, kept marks that document.
    """
    docs = docs.select("doc_id", "text")
    rows, groups = class_components(docs, width, percent)
    own = rows.select("doc_id", "n_shingles", "digest").join(groups, "digest", "left").drop("digest")
    lowest = own.where("group is not null and doc_id is not null").groupBy("group").agg(F.min("doc_id").alias("low"))
    placed = own.join(lowest, "group", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")))
    return placed.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that link to a smaller doc_id; a document's rows go or stay together."""
    key = fresh(docs, "gone")
    found = near_duplicates(docs, width, percent).groupBy(F.col("doc_id").alias(key)).agg(F.bool_or("kept").alias("kept"))
    found = found.where("not kept").select(key)
    return docs.join(found, docs["doc_id"] == found[key], "left_anti")

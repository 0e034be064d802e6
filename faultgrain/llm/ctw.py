"""Language-model scoring by context-tree weighting over bytes.

Every byte is coded as eight binary decisions. For each decision and each
context of 0 to ``DEPTH`` preceding bytes a Krichevsky-Trofimov estimator is
kept, and the estimators of all depths are mixed with the tree weights that the
training texts give. A text's log-probability is the sum over its bytes of
entries picked by (``DEPTH`` preceding bytes, byte), its strings.

The tree is as large as the corpus makes it and is never in one place. Each
input partition sends its distinct strings, with their counts in training
texts, to buckets by the last ``SPLIT`` context bytes, so that a bucket has whole
subtrees. A bucket adds up the counts, weights its subtrees and answers each
partition with the probabilities of the strings it sent; the levels above, of
at most two context bytes, are weighted apart and broadcast. The answers meet
the texts again by partition.

Bounds: the broadcast levels have a row of 3 kB for each seen pair of bytes of
lower-case UTF-8, less than 150 MB however large the corpus is (8 MB for prose in
a few languages). Word counts: the most frequent words (at most ``HOT_WORDS``) are
broadcast, all others are joined by a shuffle. A bucket reads the strings of
``PARTS`` partitions at a time.

The texts are read twice and must come in the same partitions both times, as
those of files do; if they do not, scoring fails.

Defined cases: a null text counts as empty; an empty text has the end symbol
alone; a null doc_id is a training row; repeated rows are scored each; with no
training rows all estimators stay at one half and base_score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import cut

DEPTH = 6
SPLIT = 3
TOP = SPLIT - 1
PARTS = 256
BUCKETS, MOST_BUCKETS = 32, 4096
END_BYTE = 0xFF  # never part of UTF-8: closes each text
END_WORD = np.uint64(0x5851F42D4C957F2D)
HOT_WORDS = 1 << 20
_GRAM, _WORD = 0, 1
_NODES = np.array([[(1 << k) | (s >> (8 - k)) for k in range(8)] for s in range(256)])
_BITS = np.array([[(s >> (7 - k)) & 1 for k in range(8)] for s in range(256)])


def held_out(doc_id):
    """True where crc32 of the id's text leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 1


def strings(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string at each byte, end of each row) with the end byte after each row; the byte is the lowest, before it the nearest context byte."""
    closed = np.insert(_text.lowered(data), ends, END_BYTE)
    ends = ends + np.arange(1, len(ends) + 1)
    out = closed.astype(np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    for back in range(1, DEPTH + 1):
        part = np.empty(len(closed), dtype=np.uint8)
        part[back:] = closed[:-back]
        part[:back] = END_BYTE
        for k in range(back):  # nothing before a text but end bytes
            at = starts + k
            part[at[at < ends]] = END_BYTE
        out |= part.astype(np.uint64) << np.uint64(8 * back)
    return out, ends


def _planes(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True)


def _values(raw: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = pa.decompress(raw, n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(width, n).T).view(kind).ravel()


def pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys and a number for each, in few bytes."""
    first, second = _planes(np.diff(keys, prepend=np.uint64(0))), _planes(values)
    return b"".join([len(keys).to_bytes(8, "little"), len(first).to_bytes(8, "little"), first, second])


def unpack(raw: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    n, size = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
    return np.cumsum(_values(raw[16 : 16 + size], n, "<u8")), _values(raw[16 + size :], n, kind)


class _Tally:
    """Counts of integer keys, merged as they come in."""

    def __init__(self) -> None:
        self.keys, self.counts, self.size = [], [], 0

    def add(self, values: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            values, counts = np.unique(values, return_counts=True)
        self.keys.append(values)
        self.counts.append(counts)
        self.size += len(values)
        if self.size > 1 << 22 and len(self.keys) > 8:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        self.keys, self.counts, self.size = [keys], [counts], 0
        return keys, counts


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words, chunk = _Tally(), _Tally(), 0
        for batch in batches:
            if not len(batch):
                continue
            learn = ~np.array(batch.column(1))
            chunk = batch.column(2)[0].as_py()
            for a, b, data, ends in _text.slices(batch.column(0)):
                found, stops = strings(data, ends)
                learned = np.repeat(learn[a:b], np.diff(np.concatenate([[0], stops]))).astype(np.uint64)
                grams.add(found << np.uint64(1) | learned)
                hashes, stops = _text.words(data, ends)
                words.add(hashes[np.repeat(learn[a:b], np.diff(np.concatenate([[0], stops])))])
                words.add(np.array([END_WORD]), np.array([learn[a:b].sum()]))
        keys, counts = grams.merge()
        keys, counts = _summed(keys >> np.uint64(1), np.where(keys & np.uint64(1), counts, 0))
        of = bucket_of(keys, buckets)
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]])) if len(order) else []
        for at in np.split(order, cuts[1:]) if len(order) else []:
            yield _rows(_GRAM, np.array([of[at[0]]], np.int64), np.array([chunk]), [pack(keys[at], counts[at])])
        keys, counts = words.merge()
        keys, counts = keys[counts > 0], counts[counts > 0]
        for a in range(0, len(keys), 1 << 18):
            part = slice(a, a + (1 << 18))
            yield _rows(_WORD, _text.longs(keys[part]), counts[part], None)

    return run


def _rows(kind: int, key: np.ndarray, n: np.ndarray, body: list[bytes] | None) -> pa.RecordBatch:
    bodies = pa.array(body, pa.binary()) if body else pa.nulls(len(key), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.array(n.astype(np.int64)), bodies], names=["kind", "key", "n", "body"])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, equal ones as one with their counts added."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Strings with the same last SPLIT context bytes share a bucket."""
    return (_text.mix(grams >> np.uint64(8) & np.uint64((1 << 8 * SPLIT) - 1)) % np.uint64(buckets)).astype(np.int64)


def corpus_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """Of ``texts(text, held_out, chunk)``: (bucket, chunk, body) as (key, n, body) with all strings of a partition and their
    counts in training texts, and (key, n) of word hashes in training texts.
    """
    return texts.select("text", "held_out", "chunk").mapInArrow(_count(buckets), "kind tinyint, key long, n long, body binary")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a block."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    found, place = np.unique(keys, return_inverse=True)
    return (found, *(np.bincount(place, v, minlength=len(found)) for v in values))


def _levels(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None, depth: int, least: int) -> list[tuple[np.ndarray, ...]]:
    """Levels ``least`` to ``depth``: (context*256+node, zeros, ones, log KT, log weighted); ``below`` is what the level under them gives."""
    levels = []
    while True:
        own = _log_kt(zeros, ones)
        mixed = own if below is None else np.logaddexp(own, below) - np.log(2)
        levels.insert(0, (keys, zeros, ones, own, mixed))
        if depth == least:
            return levels
        depth -= 1
        keys, zeros, ones, below = _sum_by(((keys >> 8) & ((1 << 8 * depth) - 1)) << 8 | keys & 255, zeros, ones, mixed)


def _subtrees(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels SPLIT to DEPTH of the training strings."""
    grams, counts = grams[counts > 0].astype(np.int64), counts[counts > 0]
    context, symbol = grams >> 8, grams & 255
    bits = _BITS[symbol].ravel()
    weight = np.repeat(counts.astype(float), 8)
    return _levels(*_sum_by(np.repeat(context, 8) * 256 + _NODES[symbol].ravel(), weight * (1 - bits), weight * bits), None, DEPTH, SPLIT)


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    bodies = [unpack(x, "<i8") for x in table.column("body").to_pylist()]
    return _summed(np.concatenate([b[0] for b in bodies]), np.concatenate([b[1] for b in bodies]))


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    grams, counts = _merge(table)
    return pa.table({"key": [key[0].as_py()], "n": [key[1].as_py()], "body": pa.array([pack(grams[counts > 0], counts[counts > 0])], pa.binary())})


def _upwards(table: pa.Table) -> pa.Table:
    """What the subtrees of a bucket give to the level above, per two context bytes and node."""
    keys, zeros, ones, _, mixed = _subtrees(*_merge(table))[0]
    keys, zeros, ones, below = _sum_by(((keys >> 8) & ((1 << 8 * TOP) - 1)) << 8 | keys & 255, zeros, ones, mixed)
    return pa.table({"key": keys, "zeros": zeros, "ones": ones, "below": below})


def _top_part(pdf: pd.DataFrame) -> pd.DataFrame:
    keys, zeros, ones, _, mixed = _levels(*(pdf[c].to_numpy() for c in ("key", "zeros", "ones", "below")), TOP, 1)[0]
    return pd.DataFrame({"node": keys & 255, "zeros": zeros, "ones": ones, "below": mixed})


def _spread(keys: np.ndarray, values: np.ndarray, fill: float) -> tuple[np.ndarray, np.ndarray]:
    """Contexts, and ``values`` as one row of 256 nodes for each."""
    seen, row = np.unique(keys >> 8, return_inverse=True)
    dense = np.full((len(seen), 256), fill)
    dense[row, keys & 255] = values
    return seen, dense


def _root(rows: list) -> np.ndarray:
    """Of the root, per node: what its own estimators give for a zero and a one, and what is left for deeper ones."""
    weight, zero = np.full(256, 0.5), np.full(256, 0.5)
    if rows:
        node = np.array([r["node"] for r in rows])
        zeros, ones, below = (np.array([r[k] for r in rows]) for k in ("zeros", "ones", "below"))
        own = _log_kt(zeros, ones)
        weight[node] = np.exp(own - np.logaddexp(own, below))
        zero[node] = (zeros + 0.5) / (zeros + ones + 1)
    return np.stack([weight * zero, weight * (1 - zero), 1 - weight])


def _top_rows(root: np.ndarray):
    def of_byte(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = _levels(*(pdf[c].to_numpy() for c in ("key", "zeros", "ones", "below")), TOP, 1)
        seen, above, out = np.zeros(1, np.int64), root[None], []
        for depth, (keys, zeros, ones, own, mixed) in enumerate(levels, 1):
            here, zero = _spread(keys, (zeros + 0.5) / (zeros + ones + 1), 0.5)
            weight = _spread(keys, np.exp(own - mixed) / 2, 0.5)[1]
            up = above[np.searchsorted(seen, here & ((1 << 8 * (depth - 1)) - 1))]
            share = up[:, 2] * weight
            seen, above = here, np.stack([up[:, 0] + share * zero, up[:, 1] + share * (1 - zero), up[:, 2] - share], axis=1)
            out.append(pd.DataFrame({"depth": depth, "context": here, "row": [x.astype(np.float32).tobytes() for x in above]}))
        return pd.concat(out)

    return of_byte


class _Top:
    """The levels of at most TOP context bytes: for each two bytes a row (zero, one, left) of 256 nodes."""

    def __init__(self, root: np.ndarray, rows: pa.Table) -> None:
        self.rows = np.frombuffer(b"".join([root.astype(np.float32).tobytes(), *rows.column("row").to_pylist()]), np.float32).reshape(-1, 3, 256)
        self.place = np.zeros(1 << 8 * TOP, np.int32)
        depth, context = rows.column("depth").to_numpy(), rows.column("context").to_numpy()
        for d in range(1, TOP + 1):
            at = np.flatnonzero(depth == d)
            self.place.reshape(1 << 8 * (TOP - d), 1 << 8 * d)[:, context[at]] = at + 1


def _log_probabilities(top: _Top, levels: list[tuple[np.ndarray, ...]], grams: np.ndarray) -> np.ndarray:
    """log10 of the probability of each string's last byte after the others."""
    context, symbol = (grams >> np.uint64(8)).astype(np.int64), (grams & np.uint64(255)).astype(np.int64)
    row = top.place[context & ((1 << 8 * TOP) - 1)]
    shares = []
    for depth, (keys, zeros, ones, own, mixed) in enumerate(levels, SPLIT):
        shares.append((keys, (zeros + 0.5) / (zeros + ones + 1), (ones + 0.5) / (zeros + ones + 1), np.exp(own - mixed) / 2 if depth < DEPTH else np.ones(len(keys))))
    out = np.zeros(len(grams))
    for k in range(8):
        node, bit = _NODES[symbol, k], _BITS[symbol, k]
        p = top.rows[row, bit, node].astype(float)
        left = top.rows[row, 2, node].astype(float)
        for depth, (keys, zero, one, weight) in enumerate(shares, SPLIT):
            wanted = (context & ((1 << 8 * depth) - 1)) << 8 | node
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
            share = np.where(hit, weight[at], 0.0) if len(keys) else 0.0
            p += left * share * (np.where(bit, one[at], zero[at]) if len(keys) else 0.0)
            p += np.where(hit, 0.0, left * 0.5)  # nor is there anything deeper
            left = np.where(hit, left * (1 - share), 0.0)
        out += np.log10(np.maximum(p, 1e-300))
    return out


def _answer(top):
    def run(messages: pa.Table, trees: pa.Table) -> pa.Table:
        levels = _subtrees(*_merge(trees)) if len(trees) else []
        asked = [unpack(x, "<i8")[0] for x in messages.column("body").to_pylist()]
        every = np.unique(np.concatenate(asked)) if asked else np.zeros(0, np.uint64)
        logs = _log_probabilities(top.value, levels, every).astype(np.float32)
        bodies = [pack(own, logs[np.searchsorted(every, own)]) for own in asked]
        return pa.table({"chunk": messages.column("n"), "body": pa.array(bodies, pa.binary())})

    return run


def answers(messages: DataFrame) -> DataFrame:
    """(chunk, body): for each of ``messages(key, n, body)`` its strings and their log10 probabilities."""
    spark = messages.sparkSession
    kinds = "key long, n long, body binary"
    trees = messages.withColumn("n", F.floor(F.col("n") / PARTS)).groupBy("key", "n").applyInArrow(_merged, kinds)
    parts = messages.agg(F.max("n")).collect()[0][0] or 0
    while parts >= PARTS:
        parts //= PARTS
        trees = trees.withColumn("n", F.floor(F.col("n") / PARTS)).groupBy("key", "n").applyInArrow(_merged, kinds)
    trees = cut(trees.drop("n"))
    above = trees.groupBy(F.col("key").alias("bucket")).applyInArrow(_upwards, "key long, zeros double, ones double, below double")
    above = cut(above.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).withColumn("last", F.expr("(key >> 8) & 255")))
    per_node = above.groupBy("last").applyInPandas(_top_part, "node int, zeros double, ones double, below double")
    root = _root(per_node.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).collect())  # 255 at most
    rows = above.groupBy("last").applyInPandas(_top_rows(root), "depth int, context long, row binary").toArrow()  # of seen pairs of bytes
    top = spark.sparkContext.broadcast(_Top(root, rows))
    of_part = messages.withColumn("part", F.floor(F.col("n") / PARTS))
    named = of_part.select(F.col("key").alias("bucket"), F.col("part").alias("of_part")).distinct()
    spread = named.join(trees, F.col("bucket") == F.col("key")).select("bucket", "of_part", "body")
    return of_part.groupBy("key", "part").cogroup(spread.groupBy("bucket", "of_part")).applyInArrow(_answer(top), "chunk long, body binary")


def _scored(model, total: float):
    def run(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        hot, hot_counts, _ = model.value
        logs = np.log10((hot_counts + 0.5) / total)
        bodies = [unpack(x, "<f4") for x in found.column("body").to_pylist()]
        grams = np.concatenate([b[0] for b in bodies] or [np.zeros(0, np.uint64)])
        order = np.argsort(grams)
        grams, values = grams[order], np.concatenate([b[1] for b in bodies] or [np.zeros(0, np.float32)])[order].astype(np.float64)
        texts, out = texts.combine_chunks(), []
        row = key[0].as_py() << 40
        for batch in texts.to_batches():
            keep = [batch.column(batch.schema.names.index(c)) for c in ("doc_id", "held_out")]
            for a, b, data, byte_ends in _text.slices(batch.column(batch.schema.names.index("text"))):
                own, stops = strings(data, byte_ends)
                own, which = np.unique(own, return_inverse=True)
                at = np.searchsorted(grams, own)
                if len(own) and (at[-1] == len(grams) or (grams[at] != own).any()):
                    raise ValueError("the texts came in other partitions when they were read again; write them to a table first")
                score = np.add.reduceat(values[at][which], np.concatenate([[0], stops[:-1]]))
                hashes, ends = _text.words(data, byte_ends)
                starts = np.concatenate([[0], ends[:-1]])
                ids, which = np.unique(hashes, return_inverse=True)
                at = np.searchsorted(hot, ids)
                at[at == len(hot)] = 0
                known = hot[at] == ids if len(hot) else np.zeros(len(ids), bool)
                value = np.where(known, logs[at], 0.0) if len(hot) else np.zeros(len(ids))
                base = np.concatenate([[0.0], np.cumsum(value[which])])
                sure = np.concatenate([[0], np.cumsum(known[which])])
                rest = ~known[which]
                offsets = np.concatenate([[0], np.concatenate([[0], np.cumsum(rest)])[ends]]).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(offsets), pa.array(_text.longs(hashes[rest])))
                n = b - a
                out.append(
                    pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.arange(row, row + n)), *(c.slice(a, n) for c in keep), pa.array(score), pa.array(ends - starts + 1), pa.array(sure[ends] - sure[starts]),
                            pa.array(base[ends] - base[starts]), pa.array(np.diff(np.concatenate([[0], byte_ends]))), tail,
                        ],
                        names=["row", "doc_id", "held_out", "score", "n_tokens", "n_known", "base_score", "n_bytes", "tail"],
                    )
                )
                row += n
        return pa.Table.from_batches(out)

    return run


def score_documents(docs: DataFrame, hot_words: int = HOT_WORDS, buckets: int = 0) -> DataFrame:
    """Score every text of ``docs(doc_id, text)``; learn from rows that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (word unigrams), score (context-tree weighting, both log10) and
    bits_per_byte of the latter, the end symbol counted as a byte. Without
    ``buckets`` there are ``BUCKETS`` for each partition, ``MOST_BUCKETS`` at most.
    """
    spark = docs.sparkSession
    buckets = buckets or min(MOST_BUCKETS, BUCKETS * max(1, docs.rdd.getNumPartitions()))
    texts = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), F.spark_partition_id().cast("long").alias("chunk"))
    counts = cut(corpus_counts(texts, buckets))
    words = cut(counts.where(F.col("kind") == _WORD).groupBy("key").agg(F.sum("n").alias("n")))
    sizes = words.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()  # 64 at most
    total = sum(r["n"] for r in sizes)
    scale = total + 0.5 * (sum(r["words"] for r in sizes) + 1)
    least, held = 1, 0
    for r in sorted(sizes, key=lambda r: -r["power"]):
        held += r["words"]
        if held > hot_words:
            least = 2 ** (int(r["power"]) + 1)
            break
    hot = words.where(F.col("n") >= least).toArrow()
    keys = hot.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model = spark.sparkContext.broadcast((keys[order], hot.column("n").to_numpy()[order], least))
    end_count = words.where(F.col("key") == F.lit(int(END_WORD.view(np.int64)))).select("n").collect()
    end_log = float(np.log10(((end_count[0]["n"] if end_count else 0) + 0.5) / scale))

    found = answers(counts.where(F.col("kind") == _GRAM).select("key", "n", "body"))
    rows = texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(
        _scored(model, scale),
        "row long, doc_id long, held_out boolean, score double, n_tokens long, n_known long, base_score double, n_bytes long, tail array<long>",
    )
    # One head row per document, then one row per word that is not among the hot ones.
    head = F.struct(F.lit(True).alias("head"), F.hash("row").cast("long").alias("key"))
    rest = F.transform("tail", lambda h: F.struct(F.lit(False).alias("head"), h.alias("key")))
    own = ["doc_id", "held_out", "score", "n_tokens", "n_known", "base_score", "n_bytes"]
    long = rows.select("row", *own, F.explode(F.concat(F.array(head), rest)).alias("t"))
    long = long.select("row", "t.key", "t.head", *(F.when(F.col("t.head"), F.col(c)).alias(c) for c in own))
    found = long.join(words, "key", "left")
    c = F.when(~F.col("head"), F.coalesce("n", F.lit(0)))
    seen = F.when(F.col("head"), F.col("n_known")).otherwise((c > 0).cast("long"))
    part = F.when(F.col("head"), F.col("base_score")).otherwise(F.log10((c + 0.5) / scale))
    known_end = int(bool(end_count))
    return (
        found.groupBy("row")
        .agg(*(F.max(x).alias(x) for x in ("doc_id", "held_out", "score", "n_tokens", "n_bytes")), F.sum(seen).alias("n_known"), F.sum(part).alias("base_score"))
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + known_end).cast("long").alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base_score") + end_log).alias("base_score"),
            "score",
            (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
        )
    )

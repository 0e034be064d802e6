"""Best-fit packing of tokenised documents after dominance reduction.

Documents become token ids (a closing id 0 each); only longer ones than the
capacity are cut. How many pieces there are of each length is all the packing
depends on, so it is planned on that histogram, whose size is the capacity and
not the corpus: sets of at most three lengths that provably dominate every
alternative (Martello and Toth's reduction) are fixed with their multiplicity,
best fit decreasing packs what remains. The plan is a short list of intervals
``length, rank range -> sequences, offset``. Pieces are ranked within their
length by prefix sums over partitions, so no task or driver sees all of them.

Defined cases: a null or empty text is the closing id alone; repeated rows are
packed each; an empty table gives an empty result; a null doc_id stays null.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._store import cut

CAPACITY = 2048
CACHE_WORDS = 1_000_000
SLICE_BYTES = 4 << 20  # words that repeat in a slice are looked up once
_PUNCTUATION = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"  # without < and >, which special tokens use, and the apostrophe
_CLOSE = b"\0\0\0\0"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts as little-endian bytes, word by word.

    The tokenizer never joins anything across ASCII white space, so a text's
    ids are those of its words in order. New words made of letters (and
    punctuation behind them) are encoded together, one text of many words at a
    time, and told apart by the mark that each word's last token carries.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer = Tokenizer.from_file(path)
        vocab = self._tokenizer.get_vocab(with_added_tokens=False)
        self._last = np.zeros(self._tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, i in vocab.items():
            self._last[i] = token.endswith("</w>")
        self._known: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def learn(self, words: set[bytes]) -> None:
        new = words - self._known.keys()
        if not new:
            return
        if len(self._known) + len(new) > CACHE_WORDS:
            self._known.clear()
            new = words
        stems: dict[bytes, list[bytes]] = {}
        odd, tails = [], set()
        for word in new:
            stem = word.rstrip(_PUNCTUATION)
            if stem and stem.decode().isalpha():
                stems.setdefault(stem, []).append(word)
                if len(stem) < len(word):
                    tails.add(word[len(stem) :])
            else:
                odd.append(word)
        known, names = self._known, list(stems)
        tail_ids = dict(zip(tails, self._encode([t.decode() for t in tails]), strict=True))
        for a in range(0, len(names), 512):
            part = names[a : a + 512]
            ids = self._tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids
            ids = np.array(ids, dtype="<u4")
            stops = (np.flatnonzero(self._last[ids]) + 1) * 4
            if len(stops) != len(part):
                odd += [w for s in part for w in stems[s]]
                continue
            data, start = ids.tobytes(), 0
            for stem, stop in zip(part, stops.tolist(), strict=True):
                own = data[start:stop]
                start = stop
                for word in stems[stem]:
                    known[word] = own if len(word) == len(stem) else own + tail_ids[word[len(stem) :]]
        known.update(zip(odd, self._encode([w.decode() for w in odd]), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [text.split() for text in texts]
        self.learn(set().union(*split))
        get = self._known.__getitem__
        return [b"".join(map(get, words)) for words in split]


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, words = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path)
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, ends in _text.slices(batch.column(1), SLICE_BYTES):
                raw, starts = data.tobytes(), np.concatenate([[0], ends[:-1]])
                encoded = words.encode([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
                row, piece, start, length, crc = [], [], [], [], []
                for k, own in enumerate(encoded):
                    own += _CLOSE
                    n = len(own) // 4
                    for p, at in enumerate(range(0, n, capacity)):
                        row.append(k)
                        piece.append(p)
                        start.append(at)
                        length.append(min(capacity, n - at))
                        crc.append(zlib.crc32(own[at * 4 : (at + capacity) * 4]))
                lengths = np.array(length)
                order = np.argsort(lengths, kind="stable")
                ordered = lengths[order]
                first = np.searchsorted(ordered, ordered)
                rank = np.empty(len(lengths), np.int64)
                rank[order] = np.arange(len(lengths)) - first
                rank += seen[lengths]
                seen += np.bincount(lengths, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a).take(pa.array(row)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(lengths),
                        pa.array(crc, pa.int64()),
                        pa.array(np.full(len(row), task, np.int64)),
                        pa.array(rank),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
                )

    return run


def _kinds(lengths: tuple[int, ...]) -> dict[int, int]:
    return {x: lengths.count(x) for x in lengths}


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Take dominating sets of at most three lengths out of ``counts``; returns (times, lengths)."""
    left = [0] * (capacity + 2)
    for length, n in counts.items():
        left[length] = n
    fixed = []

    def largest(limit: int, used: dict[int, int]) -> int:
        """The largest length up to ``limit`` of which more than ``used`` are left, or 0."""
        while limit > 0 and left[limit] <= used.get(limit, 0):
            limit -= 1
        return max(limit, 0)

    def smallest(above: int, n: int, used: dict[int, int]) -> list[int]:
        """Up to ``n`` smallest items that are longer than ``above``."""
        out = []
        for x in range(above + 1, capacity + 1):
            out += [x] * min(n - len(out), max(0, left[x] - used.get(x, 0)))
            if len(out) == n:
                break
        return out

    def dominating(j: int) -> tuple[int, ...] | None:
        room = capacity - j
        small = smallest(0, 3, {j: 1})
        if not small or small[0] > room:
            return (j,)
        best = largest(room, {j: 1})
        if best == room or len(small) == 1 or small[0] + small[1] > room:
            return (j, best)
        if len(small) == 3 and sum(small) <= room:
            return None
        pair, a = (0, 0), best
        while a > 0 and 2 * a >= sum(pair):
            b = largest(min(a, room - a), _kinds((j, a)))
            if b and a + b > sum(pair):
                pair = (a, b)
            a = largest(a - 1, {j: 1})
        if best >= sum(pair):
            return (j, best)
        if pair[0] == best:
            longer = smallest(pair[1], 2, _kinds((j, best)))
            if len(longer) < 2 or sum(longer) > room:
                return (j, *pair)
        return None

    for j in range(capacity, 0, -1):
        while left[j] and (chosen := dominating(j)):
            times = min(left[x] // k for x, k in _kinds(chosen).items())
            fixed.append((times, chosen))
            for x in chosen:
                left[x] -= times
    counts.clear()
    counts.update({x: n for x, n in enumerate(left) if n})
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best fit decreasing on a histogram; returns (sequences, ((length, times), ...)) groups."""
    open_groups: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    for length in sorted(counts, reverse=True):
        todo = counts[length]
        room = length
        while todo and room <= capacity:
            groups = open_groups.get(room)
            if not groups:
                room += 1
                continue
            n, content = groups.pop()
            fit = room // length
            full = min(n, todo // fit)
            for times, k in ((full, fit), (int(full < n and todo - full * fit > 0), todo - full * fit)):
                if times:
                    open_groups.setdefault(room - k * length, []).append((times, (*content, (length, k))))
                    n -= times
                    todo -= times * k
            if n:
                groups.append((n, content))
        fit = capacity // length
        for times, k in ((todo // fit, fit), (int(todo % fit > 0), todo % fit)):
            if times:
                open_groups.setdefault(capacity - k * length, []).append((times, ((length, k),)))
    return [g for groups in open_groups.values() for g in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, first rank, first sequence, times in a sequence, first offset)."""
    rest = dict(counts)
    groups = [(n, tuple(_kinds(tuple(sorted(c, reverse=True))).items())) for n, c in reduce_dominated(rest, capacity)]
    groups += best_fit(rest, capacity)
    used = dict.fromkeys(counts, 0)
    out, sequence = [], 0
    for n, content in groups:
        offset = 0
        for length, k in content:
            out.append((length, used[length], sequence, k, offset))
            used[length] += n * k
            offset += length * k
        sequence += n
    assert used == counts
    return out


_RANKS = 1 << 44  # more pieces of one length than any corpus has


def _place(intervals):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sequences, times, offsets = intervals.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(starts, length * _RANKS + rank, side="right") - 1
            nth = length * _RANKS + rank - starts[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                    pa.array(sequences[at] + nth // times[at]),
                    pa.array(offsets[at] + nth % times[at] * length),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack ``docs(doc_id, text)``; one row per piece with its sequence and place."""
    spark = docs.sparkSession
    pieces = cut(
        docs.select("doc_id", "text").mapInArrow(
            _pieces(tokenizer or default_tokenizer(), capacity),
            "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long",
        )
    )
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one per length
    rows = np.array(plan(counts, capacity), dtype=np.int64).reshape(-1, 5)
    keys = rows[:, 0] * _RANKS + rows[:, 1]
    order = np.argsort(keys)
    intervals = spark.sparkContext.broadcast((keys[order], *(rows[order, c] for c in (2, 3, 4))))
    ranked = pieces.join(per_task, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _place(intervals), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )

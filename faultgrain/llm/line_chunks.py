"""Removal of repeated runs of lines, found by hashes of neighbouring lines.

``remove_passages`` looks at each pair of neighbouring lines with words, with
the blank lines between them, and at each line of more than ``LONG_WORDS``
words. A passage of n lines is n - 1 pairs, so a repeated passage of two lines
or more goes whole, wherever it stands and whatever stands around it.

``remove_repeats`` takes content-defined chunks: a rolling hash over each pair
of neighbouring line hashes ends a chunk after one pair in two, once the chunk
has two lines; a long line is a chunk of its own. It compares fewer pieces, but
leaves the lines of a passage that share a chunk with other lines. No query
uses it.

Pieces of at least two lines with words, and long lines, count over all
documents by a 128-bit hash. Of equal pieces the first by (doc_id, place)
stays, the lines of all others are removed, after their bytes have been
compared: a hash under which different bytes are found is left alone. Of each
removed line the first copy stays.

Defined cases: a null text stays null and has no pieces; blank lines alone and
short lines alone are never removed; rows that share a doc_id count as one
document (a piece at the same place of both is one occurrence); a null doc_id
is an id of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import cut, fresh

LONG_WORDS = 50
MIN_LINES = 2
ONE_IN = 2
BROADCAST_PLACES = 1 << 20  # of a few numbers each
#: (place, first line, end line) of the countable pieces of some lines.
Pieces = Callable[[list[bytes]], list[tuple[int, int, int]]]


def chunks(text: bytes) -> list[list[bytes]]:
    """The lines of a text, grouped in chunks."""
    out: list[list[bytes]] = []
    own: list[bytes] = []
    before = 0
    for line in text.split(b"\n"):
        if len(line) > 2 * LONG_WORDS and len(line.split()) > LONG_WORDS:
            if own:
                out.append(own)
            out.append([line])
            own, before = [], 0
            continue
        now = int.from_bytes(blake2b(line, digest_size=8).digest(), "little")
        own.append(line)
        rolled = (before * 0x9E3779B97F4A7C15 + now * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
        before = now
        if len(own) >= MIN_LINES and (rolled >> 32) % ONE_IN == 0:
            out.append(own)
            own = []
    if own:
        out.append(own)
    return out


def countable(chunk: list[bytes]) -> bool:
    """At least two lines with words, or a long line."""
    if len(chunk) == 1:
        return len(chunk[0].split()) > LONG_WORDS
    return sum(1 for line in chunk if line.strip()) >= MIN_LINES


def chunk_pieces(lines: list[bytes]) -> list[tuple[int, int, int]]:
    """The countable chunks."""
    out, at = [], 0
    for place, chunk in enumerate(chunks(b"\n".join(lines))):
        if countable(chunk):
            out.append((place, at, at + len(chunk)))
        at += len(chunk)
    return out


def pair_pieces(lines: list[bytes]) -> list[tuple[int, int, int]]:
    """Long lines, and pairs of neighbouring lines with words unless both are long."""
    out, before, before_long = [], -1, False
    for k, line in enumerate(lines):
        if not line.strip():
            continue
        long = len(line) > 2 * LONG_WORDS and len(line.split()) > LONG_WORDS
        if before >= 0 and not (long and before_long):
            out.append((2 * before, before, k + 1))
        if long:
            out.append((2 * k + 1, k, k + 1))
        before, before_long = k, long
    return out


def _hash(chunk: bytes) -> tuple[int, int]:
    digest = blake2b(chunk, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, bytes]]:
    row = 0
    for _, _, data, ends in _text.slices(batch.column(batch.schema.names.index(name))):
        raw, start = data.tobytes(), 0
        for end in ends.tolist():
            yield row, raw[start:end]
            row, start = row + 1, end


def _count(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, ones, twos = [], [], [], []
            for row, text in _texts(batch, "text"):
                lines = text.split(b"\n")
                for place, first, end in pieces(lines):
                    h1, h2 = _hash(b"\n".join(lines[first:end]))
                    rows.append(row)
                    places.append(place)
                    ones.append(h1)
                    twos.append(h2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64())],
                names=["doc_id", "place", "h1", "h2"],
            )

    return run


def _wanted(pieces: Pieces, lines: list[bytes], places: list[dict] | None) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(first line, end line, h1, h2, bytes) of the pieces that ``places`` names."""
    named = {(p["place"], p["h1"], p["h2"]) for p in places or ()}
    at = {n[0] for n in named}
    if at:
        for place, first, end in pieces(lines):
            if place in at and (place, *(h := _hash(data := b"\n".join(lines[first:end])))) in named:
                yield first, end, *h, data


def _bytes(pieces: Pieces):
    """The bytes of the pieces that ``places`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, twos, found = [], [], []
            wanted = batch.column(batch.schema.names.index("places")).to_pylist()
            for row, text in _texts(batch, "text"):
                for _, _, h1, h2, data in _wanted(pieces, text.split(b"\n"), wanted[row]):
                    ones.append(h1)
                    twos.append(h2)
                    found.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(found, pa.binary())], names=["h1", "h2", "data"])

    return run


def _remove(pieces: Pieces, text_at: str, places_at: str, counts_at: str):
    kind = pa.struct([("n_lines", pa.int64()), ("n_removed_lines", pa.int64()), ("n_removed_chunks", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index(text_at))
            wanted = batch.column(names.index(places_at)).to_pylist()
            texts, counts = [], []
            for row, text in _texts(batch, text_at):
                n_lines = text.count(b"\n") + 1 if text else 0
                removed = n = 0
                if wanted[row]:
                    lines = text.split(b"\n")
                    gone = bytearray(len(lines))
                    for first, end, *_ in _wanted(pieces, lines, wanted[row]):
                        gone[first:end] = b"\1" * (end - first)
                        n += 1
                    removed = sum(gone)
                    text = b"\n".join(line for line, g in zip(lines, gone, strict=True) if not g)
                texts.append(text.decode())
                counts.append({"n_lines": n_lines, "n_removed_lines": removed, "n_removed_chunks": n})
            new = pa.array(texts, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))
            arrays = [batch.column(i) for i in range(len(names))]
            arrays[names.index(text_at)] = new
            arrays[names.index(counts_at)] = pa.array(counts, kind)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def repeated_chunks(docs: DataFrame, pieces: Pieces = chunk_pieces) -> DataFrame:
    """(doc_id, places): for each document the pieces that repeat an earlier one.

    Up to ``BROADCAST_PLACES`` places go to the texts by broadcast; for more, texts and places are shuffled.
    """
    found = cut(docs.select("doc_id", "text").mapInArrow(_count(pieces), "doc_id long, place int, h1 long, h2 long").distinct())
    groups = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place")).alias("first")).where("n > 1").drop("n")
    again = found.join(groups, ["h1", "h2"])
    place = F.struct("place", "h1", "h2")
    here = F.struct("doc_id", "place").eqNullSafe(F.col("first"))
    again = cut(again.select("doc_id", place.alias("p"), here.alias("stays")))
    few = again.count() <= BROADCAST_PLACES
    held = again.groupBy(F.col("doc_id").alias("held_id")).agg(F.collect_list("p").alias("places"))
    held = F.broadcast(held) if few else held
    texts = docs.select("doc_id", "text").join(held, F.col("doc_id").eqNullSafe(F.col("held_id"))).select("text", "places")
    data = texts.mapInArrow(_bytes(pieces), "h1 long, h2 long, data binary")
    unlike = data.groupBy("h1", "h2", "data").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    gone = again.where("not stays").select("doc_id", "p", "p.h1", "p.h2").join(unlike.select("h1", "h2"), ["h1", "h2"], "left_anti")
    gone = gone.groupBy("doc_id").agg(F.collect_list("p").alias("places"))
    return F.broadcast(gone) if few else gone


def remove_repeats(docs: DataFrame, pieces: Pieces = chunk_pieces) -> DataFrame:
    """``docs`` with repeats taken out of ``text``, and a struct column ``line_counts`` (or that name after underscores)."""
    key, places, counts = (fresh(docs, c) for c in ("gone_id", "places", "line_counts"))
    gone = repeated_chunks(docs, pieces).withColumnsRenamed({"doc_id": key, "places": places})  # keeps the broadcast hint
    wide = docs.join(gone, docs["doc_id"].eqNullSafe(gone[key]), "left").drop(key)
    wide = wide.withColumn(counts, F.lit(None).cast("struct<n_lines: long, n_removed_lines: long, n_removed_chunks: long>"))
    return wide.mapInArrow(_remove(pieces, "text", places, counts), wide.schema).drop(places)


def remove_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages and long lines; ``n_removed_chunks`` of the struct counts repeated pieces."""
    return remove_repeats(docs, pair_pieces)

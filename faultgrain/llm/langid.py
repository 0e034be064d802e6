"""Language identification by cross-parsing against suffix automata.

A text is cut greedily into phrases, each the longest run of letters' UTF-8
bytes that occurs in a language's training text. The language with the fewest phrases,
each weighted by the bits that point into its training text, per symbol wins.

Learning takes, of each language, at most ``ROWS`` whole labelled rows of at most
``ROW_BYTES`` bytes, those with the smallest hash of doc_id; where all rows are
longer, the shortest row alone, and of one of more than ``LONG_BYTES`` as much in
``ROWS`` pieces at equal distances. Each language's suffix automaton is built in a Spark task and becomes a transition
table of bounded size; tables of ``LANGUAGES`` languages are broadcast at a time,
and with more languages the texts pass through one group after another.

Letters are taken in lower case, of any script; a byte of no sample matches
nothing; runs of other characters are one boundary symbol. Whole texts are
parsed as one sequence each: pieces of ``PIECE`` symbols run side by side, each
from the automaton's root, and are then corrected from the state in which the
piece before ends, until both runs meet.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as
is every text if no row can be learned from; ties go to the first language by
name; repeated rows are predicted each; a null doc_id is a training row.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._store import cut

ROWS = 24
ROW_BYTES = 2048
LONG_BYTES = 48 << 10
LANGUAGES = 8
PIECE = 512
_GAP = 0


def held_out(doc_id):
    """True where crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 4 == 2


@lru_cache(1)
def _lower_letters() -> np.ndarray:
    """Of each code point its letter in lower case, 0 for what is no letter."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            table[point] = ord(char.lower()[:1])
    return table


def letters(text: str) -> np.ndarray:
    """A text's letters as code points in lower case, with runs of boundaries as one."""
    found = _lower_letters()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
    keep = found != _GAP
    keep[1:] |= found[:-1] != _GAP
    return found[keep]


def _bytes(found: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of letters, a boundary as byte 0."""
    return np.frombuffer(found.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)


def symbol_table(known: bytes) -> np.ndarray:
    """Symbol of each byte: 0 the boundary, 1.. the known ones, then one for any other."""
    table = np.full(256, len(known) + 1, dtype=np.uint8)
    table[np.frombuffer(known, dtype=np.uint8)] = np.arange(1, len(known) + 1)
    table[_GAP] = _GAP
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """A text's symbols."""
    return table[_bytes(letters(text))]


def automaton(sequence: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence; state 0 is the root."""
    moves, link, length = [{}], [-1], [0]
    last = 0
    for symbol in sequence.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at != -1:
            target = moves[at][symbol]
            if length[at] + 1 == length[target]:
                link[new] = target
            else:
                clone = len(moves)
                moves.append(moves[target].copy())
                length.append(length[at] + 1)
                link.append(link[target])
                while at != -1 and moves[at].get(symbol) == target:
                    moves[at][symbol] = clone
                    at = link[at]
                link[target] = link[new] = clone
        last = new
    return moves


def transitions(moves: list[dict[int, int]], width: int) -> np.ndarray:
    """Flat table: (next state's row) * 2, plus 1 where a phrase ends and the symbol opens the next.

    The last symbol of the width is padding and changes nothing. A symbol that
    never occurs is a phrase of its own: it leads to a last state, from which
    any symbol opens a phrase.
    """
    root = np.full(width, len(moves), np.int64)
    for symbol, state in moves[0].items():
        root[symbol] = state
    table = np.tile(root * width * 2 + 1, (len(moves) + 1, 1))
    for state, out in enumerate(moves):
        table[state, list(out)] = np.fromiter(out.values(), np.int64, len(out)) * width * 2
    table[:, -1] = np.arange(len(moves) + 1) * width * 2
    return table.astype(np.int32).ravel()


def phrases(texts: list[np.ndarray], tables: list[np.ndarray], width: int) -> np.ndarray:
    """Phrase counts [text, language] of symbol sequences."""
    pieces = np.array([-(-len(t) // PIECE) for t in texts], dtype=int)
    total = int(pieces.sum())
    ends = np.cumsum(pieces)
    first = np.zeros(total, bool)
    first[(ends - pieces)[pieces > 0]] = True
    grid = np.full((total, PIECE), width - 1, np.uint8)
    flat = grid.ravel()
    for t, end, n in zip(texts, ends.tolist(), pieces.tolist(), strict=True):
        flat[(end - n) * PIECE : (end - n) * PIECE + len(t)] = t
    steps = np.ascontiguousarray(grid.T)
    counts = np.zeros((len(texts), len(tables)))
    if not total:
        return counts
    for k, table in enumerate(tables):
        # After each step: (state's row) * 2, plus 1 where a phrase ended.
        runs = np.empty((PIECE, total), np.int32)
        state = np.zeros(total, np.int32)
        for step in range(PIECE):
            runs[step] = table[state + steps[step]]
            state = runs[step] >> 1
        began = np.zeros(total, np.int32)
        while True:
            start = np.where(first, 0, np.roll(runs[-1] >> 1, 1))
            at = np.flatnonzero(start != began)
            if not len(at):
                break
            began = start
            state = start[at]
            for step in range(PIECE):
                now = table[state + steps[step, at]]
                state = now >> 1
                apart = state != runs[step, at] >> 1
                runs[step, at] = now
                at, state = at[apart], state[apart]
                if not len(at):
                    break
        ended = (runs & 1).sum(axis=0)
        ended[first] += 1 - (runs[0, first] & 1)  # a text opens its first phrase once
        sums = np.concatenate([[0], np.cumsum(ended)])
        counts[:, k] = sums[ends] - sums[ends - pieces]
    return counts


def _sample(docs: DataFrame) -> DataFrame:
    """At most ROWS rows (lang, text, rank) per language."""
    train = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    size, key = F.octet_length("text"), F.xxhash64("doc_id")
    train = train.select("lang", "text", F.when(size > ROW_BYTES, size).otherwise(0).alias("beyond"), key.alias("key"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("beyond", "key", "text"))
    return cut(train.withColumn("rank", rank).where(F.col("rank") <= ROWS).where("beyond = 0 or rank = 1"))


def spaced(text: str) -> list[str]:
    """A text whole, or ROWS pieces at equal distances of one of more than LONG_BYTES, as long together."""
    size = len(text.encode())
    if size <= LONG_BYTES:
        return [text]
    length = max(1, len(text) * LONG_BYTES // (size * ROWS))
    return [text[k * len(text) // ROWS :][:length] for k in range(ROWS)]


def _training(pdf: pd.DataFrame) -> np.ndarray:
    """UTF-8 bytes of the letters of a language's rows, boundaries between the rows."""
    rows = [letters(piece) for t in pdf.sort_values("rank")["text"] for piece in spaced(t)]
    gap = np.zeros(1, np.uint32)
    return _bytes(np.concatenate([gap[:0], *(x for r in rows if len(r) for x in (r, gap[: int(r[-1] != _GAP)]))]))


def _alphabet(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"known": np.unique(_training(pdf)).astype("int32")})


def _build(known: bytes, width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = symbol_table(known)[_training(pdf)]
        if not (own != _GAP).any():
            return pd.DataFrame({"lang": pd.Series([], dtype=object), "size": pd.Series([], dtype="int64"), "table": pd.Series([], dtype=object)})
        moves = automaton(own)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "size": [len(own)], "table": [transitions(moves, width).tobytes()]})

    return run


_ready: dict = {}


def _predict(model, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, width, langs, sizes, raw = model.value
        if key not in _ready:
            _ready.clear()
            _ready[key] = symbol_table(known), [np.frombuffer(t, np.int32) for t in raw]
        table, tables = _ready[key]
        bits = np.log2(np.maximum(sizes, 2))
        for batch in batches:
            texts_of = batch.column(1).fill_null("")
            for a, b, _, _ in _text.slices(texts_of):
                texts = [symbols(t, table) for t in texts_of.slice(a, b - a).to_pylist()]
                letter = np.array([bool((t != _GAP).any()) for t in texts])
                cost = phrases(texts, tables, width) * bits / np.maximum([len(t) for t in texts], 1)[:, None]
                before = [batch.column(c).slice(a, b - a) for c in (2, 3, 4)]
                cost = np.hstack([np.array(before[1].fill_null(np.inf))[:, None], np.array(before[2].fill_null(np.inf))[:, None], cost])
                best = cost[:, [0, *range(2, cost.shape[1])]].argmin(axis=1)
                ranked = np.sort(cost, axis=1)
                names = [(langs[k - 1] if k else old) if ok else None for k, old, ok in zip(best.tolist(), before[0].to_pylist(), letter.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), texts_of.slice(a, b - a), pa.array(names, pa.string()), pa.array(ranked[:, 0]), pa.array(ranked[:, 1])], names=["doc_id", "text", "lang_pred", "least", "next"]
                )

    return run


def identify(docs: DataFrame, languages: int = LANGUAGES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of ``docs(doc_id, text, lang)``; lang is used of training rows only."""
    spark = docs.sparkSession
    sample = _sample(docs.select("doc_id", "text", "lang"))
    found = sample.groupBy("lang").applyInPandas(_alphabet, "known int").where("known > 0").distinct().collect()  # bytes of UTF-8
    known = bytes(sorted(r["known"] for r in found))
    width = len(known) + 3
    tables = cut(sample.groupBy("lang").applyInPandas(_build(known, width), "lang string, size long, table binary"))
    langs = sorted(r["lang"] for r in tables.select("lang").collect())
    out = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("next"))
    for a in range(0, len(langs), languages):
        if a:  # one group of tables at a time
            out = cut(out)
        rows = sorted(tables.where(F.col("lang").isin(langs[a : a + languages])).collect(), key=lambda r: r["lang"])
        model = spark.sparkContext.broadcast((known, width, [r["lang"] for r in rows], np.array([r["size"] for r in rows], float), [bytes(r["table"]) for r in rows]))
        out = out.mapInArrow(_predict(model, str(model._jbroadcast.id())), out.schema)
    score = F.when(F.col("lang_pred").isNull(), 0.0).when(F.col("next") == float("inf"), 1.0).when(F.col("next") > 0, 1 - F.col("least") / F.col("next")).otherwise(0.0)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score"))

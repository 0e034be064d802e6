"""Toxicity by a linear classifier whose scores must not hang on identity terms.

Features are densities of words and of runs of 4 and 6 bytes inside words (the
edges of words count), hashed to 2^20 places. A logistic model is fitted to
labelled documents. In sentences of these documents that name a group of people
each identity term is swapped for the others of its kind. The change ``d`` of the
features must not change the score ``w.d``: every pair adds the loss
log(1 + exp(w.d)) + log(1 + exp(-w.d)), which is least at w.d = 0 and, near it,
a quarter of its square. So a group that is named more often in toxic documents
gets no weight of its own, and the fit has to find the words that are toxic.

The fit takes about ``ROWS`` labelled rows, those of the smallest id hashes,
whole texts of any length. Features whose mean density differs between the two
labels by less than ``SCREEN`` standard errors are left out, others have a
ridge penalty on their standardised weights. Spark's own LogisticRegression does the fit, with the pairs
as weighted rows. The model is one table of 4 MB, broadcast at any size; scoring
is a pass over all texts, in pieces of 1 MB, cut between words.

Defined cases: a null text is empty; an empty text gets the score of the share
of toxic rows that the model keeps for texts without a sign; rows with a null
label or a null or unknown doc_id teach nothing; repeated labels of an id say
toxic if any does; repeated rows are scored alike; without labelled rows of both
kinds every score is their share of toxic ones (0 without any); an empty table
gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import cut

ROWS = 20_000
BITS = 20
GRAMS = (4, 6)
SMOOTH = 10
SCALE = 20.0
SCREEN = 2.0
RIDGE = 1e-2
PAIRS = 1.0
_SHARES = 1 << 20

#: Terms that name people, by kind; a term is swapped for the others of its list. A parameter of ``score_toxicity``.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("he", "she", "they"),
    ("him", "her", "them"),
    ("man", "woman"),
    ("men", "women"),
    ("boy", "girl"),
    ("male", "female", "transgender"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("american", "mexican", "chinese", "german", "french", "spanish", "african", "turkish"),
    ("young", "old", "elderly"),
    ("blind", "deaf", "disabled"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("mann", "frau"),
    ("männer", "frauen"),
    ("christen", "muslime", "juden"),
    ("homme", "femme"),
    ("hommes", "femmes"),
    ("chrétiens", "musulmans", "juifs"),
    ("hombre", "mujer"),
    ("hombres", "mujeres"),
    ("cristianos", "musulmanes", "judíos"),
)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def prepared(text: Column) -> Column:
    """A text in lower case with a space at either end."""
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Bytes of words as they are, ASCII that is neither letter nor digit as space."""
    table = np.arange(256, dtype=np.uint8)
    for code in range(128):
        if not chr(code).isalnum():
            table[code] = 32
    return table


def _places(keys: np.ndarray, kind: int) -> np.ndarray:
    return (_text.mix(keys + np.uint64((kind * 0x9E3779B97F4A7C15) % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int32)


def _pieces(data: np.ndarray, ends: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, ends of the rows in them) in pieces that are cut at a space; a piece starts with the space that ends the one before."""
    start = 0
    while len(data) - start > limit:
        spaces = np.flatnonzero(data[start + 1 : start + limit] == 32)
        end = start + 1 + int(spaces[-1]) if len(spaces) else start + limit - 1
        yield data[start : end + 1], np.clip(ends - start, 0, end + 1 - start)
        start = end
    yield data[start:], np.clip(ends - start, 0, None)


def features(data: np.ndarray, ends: np.ndarray, limit: int = 2 * _text.SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place) of every feature of prepared rows and the words of each row, piece by piece."""
    for piece, stops in _pieces(_letters()[data], ends, limit):
        found = _text.words(piece, stops, lower=False)
        counts = np.diff(found.ends, prepend=0)
        rows, places = [np.repeat(np.arange(len(stops)), counts)], [_places(found.hashes, 0)]
        gaps = np.concatenate([[0], np.cumsum(piece == 32)])
        for size in GRAMS:
            n = len(piece) - size + 1
            if n > 0:
                at = np.flatnonzero(gaps[size - 1 : size - 1 + n] == gaps[1 : n + 1])  # no gap but at the edges
                keys = np.zeros(len(at), np.uint64)
                for k in range(size):
                    keys = (keys << np.uint64(8)) | piece[at + k]
                rows.append(np.searchsorted(stops, at, side="right"))
                places.append(_places(keys, size))
        yield np.concatenate(rows), np.concatenate(places), counts


def densities(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, places in order, densities) of each prepared text."""
    for a, b, data, ends in _text.slices(texts):
        keys, sizes, words = [], [], np.zeros(b - a)
        for rows, places, counts in features(data, ends):
            key, n = np.unique((rows.astype(np.int64) << BITS) | places, return_counts=True)
            keys.append(key)
            sizes.append(n)
            words += counts
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, np.concatenate(sizes), len(key))
        row = key >> BITS
        values = SCALE * total / (words[row] + SMOOTH)
        edges = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            yield a + i, key[edges[i] : edges[i + 1]] & ((1 << BITS) - 1), values[edges[i] : edges[i + 1]]


def counterfactuals(text: str, terms: tuple[tuple[str, ...], ...]) -> Iterator[tuple[str, str]]:
    """(sentence, sentence with one of its identity terms swapped) of a prepared text."""
    others, pattern = _swaps(terms)
    if not pattern:
        return
    for sentence in re.split(r"[.!?\n]+", text):
        named = dict.fromkeys(pattern.findall(sentence))
        for term in named:
            for other in others[term]:
                yield f" {sentence} ", f" {re.sub(rf'(?<!\w){re.escape(term)}(?!\w)', lambda m, o=other: o, sentence)} "


@lru_cache(4)
def _swaps(terms: tuple[tuple[str, ...], ...]) -> tuple[dict[str, list[str]], re.Pattern | None]:
    others: dict[str, list[str]] = {}
    for kind in terms:
        for term in kind:
            own = others.setdefault(term.lower(), [])
            own += [o.lower() for o in kind if o.lower() != term.lower() and o.lower() not in own]
    if not others:
        return others, None
    words = "|".join(map(re.escape, sorted(others, key=len, reverse=True)))
    return others, re.compile(rf"(?<!\w)(?:{words})(?!\w)")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of densities and of their squares by place, for both labels."""
    sums = np.zeros((4, 1 << BITS))
    for batch in batches:
        labels = batch.column("toxic").to_pylist()
        for row, places, values in densities(batch.column("text")):
            at = 2 * labels[row]
            sums[at, places] += values
            sums[at + 1, places] += values * values
    used = np.flatnonzero(sums.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(s[used]) for s in sums)], names=["place", "s0", "q0", "s1", "q1"])


def _rows(known: np.ndarray, terms: tuple[tuple[str, ...], ...]):
    """Rows of the fit: documents, and the two of each counterfactual pair."""
    kind = pa.schema([("toxic", pa.int32()), ("pair", pa.bool_()), ("places", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def narrowed(texts: list[str]) -> Iterator[dict[int, float]]:
        for _, places, values in densities(pa.array(texts, pa.string())):
            at = np.searchsorted(known, places)
            hit = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == places)
            yield dict(zip(at[hit].tolist(), values[hit].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (own,) = narrowed([text])
                out.append({"toxic": toxic, "pair": False, "places": [*sorted(own), len(known)], "values": [*(own[k] for k in sorted(own)), 1.0]})
                pairs = [t for pair in counterfactuals(text, terms) for t in pair]
                found = list(narrowed(pairs)) if pairs else []
                for before, after in zip(found[::2], found[1::2], strict=True):
                    change = {k: v for k in sorted({*before, *after}) if (v := after.get(k, 0.0) - before.get(k, 0.0))}
                    # Both labels for one change: either sign of its score costs.
                    out += [{"toxic": label, "pair": True, "places": list(change), "values": list(change.values())} for label in (0, 1)]
                if len(out) >= 512:
                    yield from pa.Table.from_pylist(out, kind).to_batches()
                    out = []
            yield from pa.Table.from_pylist(out, kind).to_batches()

    return run


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of about ``rows`` labelled documents: ids first, by hash, then their texts."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(_SHARES))
    # The share of ids whose hashes are below a bound that leaves about ``rows`` of them.
    bound = _SHARES * rows // max(ids.count(), rows)
    ids = ids.where(share < bound)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(prepared(F.col("text")).alias("text"), "toxic")


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, pairs: float = PAIRS) -> tuple[np.ndarray, float]:
    """(weight of each place, intercept) from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; ``pairs`` weighs the counterfactuals."""
    weights = np.zeros(1 << BITS, np.float32)
    known_rows = cut(sample(docs, labels, rows))
    counts = {r["toxic"]: r["count"] for r in known_rows.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return weights, 40.0 if counts.get(1) else -40.0
    total = sum(counts.values())
    moments = known_rows.mapInArrow(_moments, "place int, s0 double, q0 double, s1 double, q1 double")
    moments = moments.groupBy("place").agg(*(F.sum(c).alias(c) for c in ("s0", "q0", "s1", "q1")))
    mean = lambda k: F.col(f"s{k}") / counts[k]
    error = lambda k: F.greatest(F.col(f"q{k}") / counts[k] - mean(k) * mean(k), F.lit(0.0)) / counts[k]
    # A label's share of rows counts once more, so that a place that one text fills is no sign.
    noise = F.sqrt(error(0) + error(1) + (F.col("q0") + F.col("q1")) / total * (1.0 / counts[0] + 1.0 / counts[1]))
    known = moments.where(F.abs(mean(1) - mean(0)) > SCREEN * noise).select("place").collect()  # at most 2^20 places
    known = np.sort(np.array([r["place"] for r in known], np.int32))
    if not len(known):
        return weights, float(np.log(counts[1] / counts[0]))
    rows_of_fit = cut(known_rows.mapInArrow(_rows(known, terms), "toxic int, pair boolean, places array<int>, values array<double>"))
    n_pairs = rows_of_fit.where("pair").count() if pairs > 0 else 0
    if not n_pairs:
        rows_of_fit = rows_of_fit.where("not pair")
    vector = F.udf(lambda places, values: Vectors.sparse(len(known) + 1, places, values), VectorUDT())
    data = rows_of_fit.select(F.col("toxic").cast("double").alias("label"), F.when(F.col("pair"), pairs * total / max(n_pairs, 1)).otherwise(1.0).alias("weight"), vector("places", "values").alias("features"))
    # Pairs have no intercept: next to them it is the weight of a column that is 1 in documents and 0 in pairs.
    model = LogisticRegression(weightCol="weight", regParam=RIDGE, fitIntercept=not n_pairs, maxIter=100).fit(data)
    found = model.coefficients.toArray()
    weights[known] = found[:-1]
    return weights, float(model.intercept + found[-1])


def _score_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = model.value
        for batch in batches:
            for a, b, data, ends in _text.slices(batch.column(1)):
                sums, words = np.zeros(b - a), np.zeros(b - a)
                for rows, places, counts in features(data, ends):
                    own = weights[places]
                    used = np.flatnonzero(own)
                    sums += np.bincount(rows[used], own[used].astype(float), b - a)
                    words += counts
                logits = intercept + SCALE * sums / (words + SMOOTH)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(logits, -40, 40))))], names=["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, pairs: float = PAIRS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs(doc_id, text)``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows, terms, pairs))
    scored = docs.select(F.col("doc_id").cast("long"), prepared(F.col("text")).alias("text")).mapInArrow(_score_batches(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Secret scans: patterns, and the token efficiency of unusual strings.

Three kinds of secrets are found by pattern. A further string of at least 20
characters of ``A-Za-z0-9+/_=-`` is a secret if a public BPE vocabulary needs
many tokens for it: prose and names compress to three or more characters a
token, random strings stay below ``RATIO``. Patterns' spans are cut out of a
string, each rest of at least 20 characters is tested. Known digests
(hexadecimal of a digest's length), UUIDs and numbers are left out first. Of
letters only, or letters joined by ``_``, ``-`` and ``/`` to letters or short
numbers, each part of two letters or more is measured by itself: it is an
identifier unless parts below ``RATIO`` have at least ``ODD_LETTERS`` letters.

Defined cases: a null text counts as empty; repeated rows are scanned each; a
null doc_id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text

KINDS = ("assign", "access", "hex", "random")
RATIO = 2.0
MIN_CHARS = 20
ODD_LETTERS = 10
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NAME = re.compile(r"[A-Za-z]+([_/-]+[A-Za-z]+|[_/-]+[0-9]{1,8})*[=_/-]*")
_DIGEST_CHARS = {32, 40, 56, 64, 96, 128}
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(1)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _candidate_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
    return table


def _rows_with_runs(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for rows with a run of at least MIN_CHARS candidate characters."""
    out = np.zeros(len(ends), dtype=bool)
    if len(data):
        inside = np.concatenate([[False], _candidate_table()[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= MIN_CHARS  # a run over a row's end is looked at in both rows
        for at in (starts[long], stops[long] - 1):
            out[np.searchsorted(ends, at, side="right")] = True
        for a, b in zip(np.searchsorted(ends, starts[long], side="right"), np.searchsorted(ends, stops[long] - 1, side="right"), strict=True):
            out[a : b + 1] = True
    return out


def excluded(value: str) -> bool:
    """A known digest, UUID or number."""
    if len(value) in _DIGEST_CHARS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return True
    return bool(_UUID.fullmatch(value) or re.fullmatch(r"[0-9+/_=-]+|[+/_=-]+", value))


def unusual(value: str, encoding, ratio: float = RATIO) -> bool:
    """True if the vocabulary needs many tokens for ``value``, or for the parts of an identifier."""
    if _NAME.fullmatch(value):
        parts = re.findall("[A-Za-z]{2,}", value)
        return sum(len(p) for p in parts if len(p) < ratio * len(encoding.encode_ordinary(p))) >= ODD_LETTERS
    return len(value) < ratio * len(encoding.encode_ordinary(value))


def _rests(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The pieces of at least MIN_CHARS between start and end without what is taken, in order of start."""
    for s, e in (*taken, (end, end)):
        if min(s, end) - start >= MIN_CHARS:
            yield start, min(s, end)
        start = max(start, e)


def scan(text: str, encoding, ratio: float = RATIO) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, by pattern) of the secrets of a text, by start and kind."""
    base = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out = [(*s, True) for s in base]
    for m in _CANDIDATE.finditer(text):
        for start, end in _rests(*m.span(), sorted((s, e) for s, _, e in base if s < m.end() and m.start() < e)):
            value = text[start:end]
            if not excluded(value) and unusual(value, encoding, ratio):
                out.append((start, 3, end, False))
    return sorted(out)


def _scan_batches(path: str, ratio: float):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            for a, b, data, ends in _text.slices(batch.column(1)):
                raw, runs = data.tobytes(), _rows_with_runs(data, ends)
                low = _text.lowered(data).tobytes()
                bases, spans, texts = [], [], []
                start = 0
                for end, long in zip(ends.tolist(), runs.tolist(), strict=True):
                    found, text = [], None
                    if long or any(low.find(w, start, end) >= 0 for w in _WORDS):
                        text = raw[start:end].decode()
                        found = scan(text, encoding, ratio)
                    bases.append([{"start": s, "kind": k, "end": e} for s, k, e, base in found if base])
                    spans.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in found])
                    texts.append(redact(text, found) if found else None)
                    start = end
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(bases, kind), pa.array(spans, kind), pa.array(texts, pa.string())],
                    names=["doc_id", "base", "spans", "redacted"],
                )

    return run


def redact(text: str, found: list[tuple[int, int, int, bool]]) -> str:
    """``text`` with each secret, overlapping ones together, replaced by its kind."""
    out, at = [], 0
    for start, kind, end, _ in found:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """(doc_id, base, spans, redacted) of ``docs(doc_id, text)``; redacted is null where nothing is found."""
    kind = "array<struct<start: int, kind: int, end: int>>"
    return docs.select("doc_id", "text").mapInArrow(
        _scan_batches(vocabulary or default_vocabulary(), ratio), f"doc_id long, base {kind}, spans {kind}, redacted string"
    )

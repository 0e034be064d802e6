"""Fill-in-middle texts: one match of a repeated unit gives every cut.

A text is matched once, whole, by ``(unit)*`` with the ``regex`` module, which
keeps all repetitions of a group: ``match.ends(1)`` lists where each unit ends,
so its length is the number of units and its entries are the offsets to cut at.
The unit is one code point unless another pattern is given (a word with the
space after it, a line).

A hash of the seed and the document's id says what becomes of a text: plain,
or prefix, middle and suffix between sentinels in one of two orders. A text
that holds a sentinel stays plain, so every output can be read back.

Rows are taken in slices; the match of one text takes about 80 bytes a unit, of
which a task holds one at a time.

Defined cases: a null text is empty and plain; a null id counts as an empty id;
a text that the units do not cover from end to end stays plain with n = 0;
repeated rows give repeated rows; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import _text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = "(?s:.)"
PERCENT = 90
SPM_PERCENT = 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2^32 of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(text: str, drawn: list[int], units: regex.Pattern, percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    match = units.fullmatch(text)
    ends = match.ends(1) if match else []
    n = len(ends)
    if not n or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or drawn[2] % 100 >= percent:
        return n, "plain", None, None, text
    few, many = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (few, many))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if drawn[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that ``output`` was made from."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


def _batches(seed: int, unit: str, percent: int, spm_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(f"({unit})*")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for a, b, _, _ in _text.slices(texts):
                ids = batch.column(0).slice(a, b - a)
                found = [transform(t, draws(i, seed), units, percent, spm_percent) for i, t in zip(ids.to_pylist(), texts.slice(a, b - a).to_pylist(), strict=True)]
                columns = [pa.array(values, kind) for values, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, unit: str = CODE_POINT, percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of ``docs(doc_id, text)``; ``unit`` has no groups of its own."""
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(_batches(seed, unit, percent, spm_percent), SCHEMA)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for batch in batches:
        outputs, forms = batch.column("output"), batch.column("form")
        digests = [(sha(o), sha(restored(o, f))) for o, f in zip(outputs.to_pylist(), forms.to_pylist(), strict=True)]
        own = [pa.array(values, pa.string()) for values in (zip(*digests, strict=True) if digests else ((), ()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")), *own], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])


def digests(formatted: DataFrame) -> DataFrame:
    """``fill_in_middle`` rows with the digests of the output and of the text read back from it."""
    return formatted.mapInArrow(_digest_batches, SCHEMA.replace("output string", "output_sha256 string, restored_sha256 string"))

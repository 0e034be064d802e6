"""Token-bucket admission per project.

Tokens are counted in whole units of 10^-15, rates in millionths of a token a
second, so that sums are exact in any grouping.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import dealt, sliced
from ..sources.store import kept

PER_SECOND, BURST = 1000.0, 5000.0
NANOS = 1_000_000_000
TOKEN = 10**15
SLICE_ROWS = 100_000


def units(per_second: float, burst: float) -> tuple[int, int]:
    """(units that a nanosecond adds, units of a full bucket)."""
    return round(per_second * 1_000_000), round(burst * TOKEN)


class Bucket:
    """Starts full, refills continuously up to the burst; a rejected request takes nothing."""

    __slots__ = ("tokens", "last_ns")

    def __init__(self, tokens: int, last_ns: int) -> None:
        self.tokens, self.last_ns = tokens, last_ns

    def admit(self, at_ns: int, rate: int, full: int) -> tuple[bool, int]:
        """(admitted, nanoseconds to wait)."""
        self.tokens = min(full, self.tokens + (at_ns - self.last_ns) * rate)
        self.last_ns = at_ns
        if self.tokens >= TOKEN:
            self.tokens -= TOKEN
            return True, 0
        return False, max(NANOS, (TOKEN - self.tokens) // rate if rate else 1 << 62)


class BucketSlice:
    """What a stretch of requests makes of a bucket whose content is not known.

    As a function of the tokens x at the first request, those after the last one
    are of three kinds. From ``capped`` up, the bucket was full at some time:
    they are ``top``. From ``drained`` up to there no request was rejected: x and
    a sum. Below, a request was rejected, and buckets that differ by whole tokens
    are equal from then on: a function of the fraction of x. Its pieces are kept
    in order of their content, in which they go round: a request moves those of
    a token or more from the end to the front, less a token, and a full bucket
    makes one of those at the end. So a request costs a few steps.
    """

    __slots__ = ("rate", "full", "first", "last", "sum", "drained", "capped", "top", "pieces", "offset")

    def __init__(self, rate: int, full: int, first_ns: int) -> None:
        self.rate, self.full, self.first, self.last = rate, full, first_ns, first_ns
        self.sum, self.drained, self.capped, self.top = 0, 0, full, full
        # (content less offset, length, fraction, grows with the fraction), by content
        self.pieces: deque[tuple[int, int, int, bool]] = deque([(0, TOKEN, 0, True)])
        self.offset = 0

    def _refill(self, more: int) -> None:
        self.offset += more
        limit, length, at = self.full - self.offset, 0, 0
        while self.pieces:
            value, own, part, grows = self.pieces[-1]
            if value < limit and not (grows and value + own > limit):
                break
            self.pieces.pop()
            below = max(limit - value, 0)
            if below:
                self.pieces.append((value, below, part, True))
            length, at = length + own - below, part + below
            if below:
                break
        if length:
            self.pieces.append((limit, length, at, False))

    def _to_front(self, value: int, length: int, part: int, grows: bool) -> None:
        if self.pieces:
            next_value, next_length, next_part, next_grows = self.pieces[0]
            joined = grows and next_grows and value + length == next_value or not grows and not next_grows and value == next_value
            if joined and (part + length - next_part) % TOKEN == 0:
                self.pieces.popleft()
                length += next_length
        self.pieces.appendleft((value, length, part, grows))

    def _take(self) -> None:
        limit = TOKEN - self.offset
        if self.pieces[0][0] >= limit:
            self.offset -= TOKEN
            return
        while True:
            value, length, part, grows = self.pieces[-1]
            if value >= limit:
                self.pieces.pop()
                self._to_front(value - TOKEN, length, part, grows)
                continue
            if grows and value + length > limit:
                below = limit - value
                self.pieces[-1] = (value, below, part, True)
                self._to_front(limit - TOKEN, length - below, part + below, True)
            return

    def see(self, at_ns: int) -> None:
        more, self.last = (at_ns - self.last) * self.rate, at_ns
        open_ = self.drained < self.capped
        if more:
            self.top = min(self.full, self.top + more)
            self._refill(more)
            if open_:
                self.sum += more
                self.capped = min(self.capped, self.full - self.sum)
        if open_:
            self.drained = max(self.drained, TOKEN - self.sum)
            self.sum -= TOKEN
        if self.top >= TOKEN:
            self.top -= TOKEN
        self._take()

    def state(self) -> str:
        """As JSON; the pieces are (from, slope 0 or 1, sum) by fraction."""
        pieces = []
        for value, length, part, grows in self.pieces:
            start, value = part % TOKEN, value + self.offset
            pieces.append((start, int(grows), value - start * grows))
            if start + length > TOKEN:  # goes on at fraction 0
                pieces.append((0, int(grows), value + (TOKEN - start) * grows))
        return json.dumps([self.first, self.last, self.sum, self.drained, self.capped, self.top, sorted(pieces)])


def after(tokens: int, state: list) -> int:
    """The tokens that a stretch with this state leaves of ``tokens`` at its first request."""
    _, _, total, drained, capped, top, pieces = state
    if tokens >= capped:
        return top
    if tokens >= drained:
        return tokens + total
    part = tokens % TOKEN
    _, slope, value = pieces[bisect_right(pieces, part, key=lambda p: p[0]) - 1]
    return part * slope + value


_LIMITS = ["rate", "full"]


def _summed_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, state, rows = None, None, []
    columns = ["project_id", "_slice", *_LIMITS, "state"]
    for batch in batches:
        for project, piece, rate, full, at in zip(*(batch[c] for c in ("project_id", "_slice", *_LIMITS, "ts_ns")), strict=True):
            if (project, piece) != key:
                if state:
                    rows.append((*key, *limits, state.state()))
                key, limits, state = (project, piece), (rate, full), BucketSlice(int(rate), int(full), int(at))
            state.see(int(at))
        if len(rows) >= 1000:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    if state:
        rows.append((*key, *limits, state.state()))
    yield pd.DataFrame(rows, columns=columns)


def _carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, tokens, last = None, 0, 0
    for batch in batches:
        entries, times = [], []
        for project, rate, full, text in zip(*(batch[c] for c in ("project_id", *_LIMITS, "state")), strict=True):
            state = json.loads(text)
            if project != key:
                key, tokens, last = project, int(full), state[0]
            tokens = min(int(full), tokens + (state[0] - last) * int(rate))
            entries.append(str(tokens))
            times.append(state[0])
            tokens, last = after(tokens, state), state[1]
        yield batch[["project_id", "_slice"]].assign(entry=entries, entry_ns=times)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, bucket = None, None
    for batch in batches:
        admitted, wait = [], []
        for r in batch.itertuples(index=False):
            if (r.project_id, r.piece) != key:
                key, bucket = (r.project_id, r.piece), Bucket(int(r.entry), int(r.entry_ns))
            ok, ns = bucket.admit(int(r.ts_ns), int(r.rate), int(r.full))
            admitted.append(ok)
            wait.append(ns)
        yield batch[["project_id", "arrival_seq", "ts_ns"]].assign(admitted=admitted, retry_after_ns=wait)


def limited(arrivals: DataFrame, limits: DataFrame | None) -> DataFrame:
    """``arrivals(project_id, arrival_seq, ts_ns)`` with the rate and the full bucket of each project, in units as text."""
    rows = arrivals.select("project_id", "arrival_seq", "ts_ns")
    if limits is not None:
        rows = rows.join(limits.select("project_id", "per_second", "burst"), "project_id", "left")
        per_second, burst = F.coalesce("per_second", F.lit(PER_SECOND)), F.coalesce("burst", F.lit(BURST))
    else:
        per_second, burst = F.lit(PER_SECOND), F.lit(BURST)
    whole = lambda c, unit: F.round(c.cast("decimal(20,6)") * F.lit(unit).cast("decimal(18,0)"), 0).cast("decimal(38,0)").cast("string")
    return rows.select("project_id", "arrival_seq", "ts_ns", whole(per_second, 10**6).alias("rate"), whole(burst, TOKEN).alias("full"))


def admit(arrivals: DataFrame, limits: DataFrame | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``arrivals(project_id, arrival_seq, ts_ns)`` with admitted and retry_after_ns.

    ``limits(project_id, per_second, burst)`` overrides the default. A project's
    requests are cut into slices of time; each slice is summed up, by itself, as a
    function from the tokens it begins with to those it leaves; the functions, a
    row a slice, are followed in order; then each slice, again by itself, knows
    what it begins with. So a project that is always busy fills as many tasks as
    it has slices.
    """
    rows = sliced(kept(limited(arrivals, limits), "arrivals"), ["project_id"], "ts_ns", NANOS, slice_rows)
    states = dealt(rows.select("project_id", "_slice", *_LIMITS, "ts_ns"), ["project_id", "_slice"], "ts_ns").mapInPandas(_summed_up, "project_id bigint, _slice bigint, rate string, full string, state string")
    entries = dealt(states, ["project_id"], "_slice").mapInPandas(_carried, "project_id bigint, _slice bigint, entry string, entry_ns bigint")
    begun = rows.join(entries, ["project_id", "_slice"]).withColumnRenamed("_slice", "piece")
    return dealt(begun, ["project_id", "piece"], "ts_ns", "arrival_seq").mapInPandas(_walk, "project_id bigint, arrival_seq bigint, ts_ns bigint, admitted boolean, retry_after_ns bigint")

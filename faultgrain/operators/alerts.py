"""Alert rules over issue activity, with a cooldown per rule and issue."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import dealt, sliced
from ..sources.store import kept

CONDITIONS = ("new_issue", "regression", "frequency")
COOLDOWN_SECONDS = 300
LIST_LIMIT, ENABLED_LIMIT = 200, 100


def valid_rules(rules: DataFrame) -> DataFrame:
    """Rules with a known condition, a name and a target address."""
    return rules.where(F.col("condition").isin(*CONDITIONS) & (F.coalesce("name", F.lit("")) != "") & (F.coalesce("webhook_url", F.lit("")) != ""))


def check_rule(name: str, condition: str, webhook_url: str) -> None:
    if condition not in CONDITIONS or not name or not webhook_url:
        raise ValueError(f"a rule needs a name, an address and one of {', '.join(CONDITIONS)}")


def list_rules(rules: DataFrame, project_id: int, *, enabled_only: bool = False, deleted: DataFrame | None = None) -> DataFrame:
    """A project's rules by id, at most 200 (100 enabled ones); ``deleted(id)`` holds tombstones."""
    own = rules.where(F.col("project_id") == project_id)
    if deleted is not None:
        own = own.join(deleted, "id", "left_anti")
    if enabled_only:
        return own.where("enabled").orderBy("id").limit(ENABLED_LIMIT)
    return own.orderBy("id").limit(LIST_LIMIT)


def _condition(rule_condition: Column, threshold: Column) -> Column:
    crossed = (threshold > 0) & (F.col("times_seen") == threshold)
    return F.when(rule_condition == "new_issue", F.col("is_new")).when(rule_condition == "regression", F.col("regressed")).when(rule_condition == "frequency", crossed).otherwise(False)


def match_rules(activity: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, activity) pairs whose condition holds. Rules are a dimension; Spark broadcasts them while they are small."""
    enabled = rules.where("enabled").select(F.col("id").alias("rule_id"), "project_id", F.col("name").alias("rule_name"), "condition", "threshold")
    return activity.join(enabled, "project_id").where(_condition(F.col("condition"), F.col("threshold")))


class CooldownSlice:
    """What a stretch of matches makes of the last firing before it, without knowing that.

    As a function of the last firing t, the firing that the stretch leaves is a
    step function: ``after(t)``. While matches come, the possible histories are
    few, for all that may fire at a match do so there and are one from then on.
    """

    __slots__ = ("wait", "first", "upto", "parent", "queue")

    def __init__(self, wait: int) -> None:
        self.wait, self.first = wait, None
        self.upto: list[int] = []  # piece k holds for t up to upto[k]
        self.parent: list[int] = []
        self.queue: deque[tuple[int, int]] = deque()  # (last firing, a piece of those it is true of), by firing

    def see(self, at: int) -> None:
        due, fired = at - self.wait, []
        while self.queue and self.queue[0][0] <= due:
            fired.append(self.queue.popleft()[1])
        if self.first is None:
            self.first = at
        if not self.upto or (self.upto[-1] < self.first and self.upto[-1] < due):
            fired.append(len(self.upto))
            self.parent.append(len(self.upto))
            self.upto.append(due)
        if fired:
            for piece in fired[:-1]:
                self.parent[piece] = fired[-1]
            self.queue.append((at, fired[-1]))

    def steps(self) -> tuple[list[int], list[int]]:
        """(bounds, firings): the firing is that of the first bound that t does not exceed; beyond the last one it stays t."""
        last = {piece: at for at, piece in self.queue}
        upto, out = [], []
        for k, bound in enumerate(self.upto):
            root = k
            while self.parent[root] != root:
                self.parent[root] = self.parent[self.parent[root]]
                root = self.parent[root]
            if out and out[-1] == last[root]:
                upto[-1] = bound
            else:
                upto.append(bound)
                out.append(last[root])
        return upto, out


def after(last: int | None, upto: list[int], out: list[int]) -> int | None:
    """The last firing after a stretch with these steps."""
    k = 0 if last is None else bisect_left(upto, last)
    return out[k] if k < len(out) else last


_ISSUE = ["rule_id", "project_id", "issue"]


def _groups(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of equal keys in sorted batches; a run that goes on in the next batch comes in parts."""
    for batch in batches:
        if len(batch):
            keys = batch[columns]
            starts = np.flatnonzero(np.concatenate([[True], (keys.values[1:] != keys.values[:-1]).any(axis=1)]))
            for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
                yield tuple(keys.iloc[a]), batch.iloc[a:b]


def _summed_up(wait: int):
    columns = [*_ISSUE, "_slice"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        rows = []
        for now, part in _groups(batches, columns):
            if now != key:
                if state:
                    rows.append((*key, *state.steps()))
                key, state = now, CooldownSlice(wait)
            for at in part["at"].tolist():
                state.see(at)
            if len(rows) >= 1000:
                yield pd.DataFrame(rows, columns=[*columns, "upto", "fired"])
                rows = []
        if state:
            rows.append((*key, *state.steps()))
        yield pd.DataFrame(rows, columns=[*columns, "upto", "fired"])

    return run


def _carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, last = None, None
    for batch in batches:
        entries = []
        for rule, project, issue, upto, fired in zip(*(batch[c] for c in (*_ISSUE, "upto", "fired")), strict=True):
            if (rule, project, issue) != key:
                key, last = (rule, project, issue), None
            entries.append(last)
            last = after(last, list(upto), list(fired))
        yield batch[[*_ISSUE, "_slice"]].assign(entry=pd.array(entries, "Int64"))


def _walk(wait: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for batch in batches:
            fires = []
            for rule, project, issue, piece, at, entry in zip(*(batch[c] for c in (*_ISSUE, "_slice", "at", "entry")), strict=True):
                if (rule, project, issue, piece) != key:
                    key, last = (rule, project, issue, piece), None if pd.isna(entry) else int(entry)
                fires.append(last is None or at - last >= wait)
                if fires[-1]:
                    last = at
            yield batch.loc[fires, [*_ISSUE, "arrival_seq"]]

    return run


SLICE_ROWS = 100_000


def cool_down(matches: DataFrame, seconds: float = COOLDOWN_SECONDS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Matches that fire: the first of a (rule, issue), then the first at least ``seconds`` after the last that fired.

    A key's matches are cut into slices of time. Each slice is summed up, by
    itself, as a step function from the last firing before it to the one after
    it; the functions, a row a slice, are followed in order; then each slice,
    again by itself, knows the firing it begins with. So a noisy issue fills as
    many tasks as it has slices.
    """
    wait = int(seconds * 1_000_000)
    if wait <= 0:
        return matches
    types = "rule_id bigint, project_id bigint, issue string"
    rows = matches.select(*_ISSUE, "arrival_seq", F.unix_micros("ts").alias("at"))
    rows = sliced(kept(rows, "matches"), _ISSUE, "at", max(wait // 64, 1), slice_rows)  # read three times
    steps = dealt(rows.select(*_ISSUE, "_slice", "at"), [*_ISSUE, "_slice"], "at").mapInPandas(_summed_up(wait), f"{types}, _slice bigint, upto array<bigint>, fired array<bigint>")
    entries = dealt(steps, _ISSUE, "_slice").mapInPandas(_carried, f"{types}, _slice bigint, entry bigint")
    begun = rows.join(entries, [*_ISSUE, "_slice"]).select(*_ISSUE, "_slice", "at", "arrival_seq", "entry")
    fired = dealt(begun, [*_ISSUE, "_slice"], "at", "arrival_seq").mapInPandas(_walk(wait), f"{types}, arrival_seq bigint")
    return matches.join(fired, [*_ISSUE, "arrival_seq"], "left_semi")


def payload() -> Column:
    return F.to_json(
        F.struct(
            F.col("rule_name").alias("rule"), "condition", "project_id", F.col("issue").alias("issue_id"), "title", "level", "status", "times_seen"
        )
    )


def firings(activity: DataFrame, rules: DataFrame, seconds: float = COOLDOWN_SECONDS) -> DataFrame:
    """What fires, with its JSON payload. ``activity`` has project_id, issue, ts, arrival_seq, title, level, status, times_seen, is_new, regressed."""
    fired = cool_down(match_rules(activity, rules), seconds)
    return fired.select("rule_id", "project_id", "issue", "ts", "arrival_seq", payload().alias("payload"))

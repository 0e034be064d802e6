"""Rule sets of any size: what a text can touch is looked up, and each pattern is compiled once.

A pattern matches only texts that hold its literals, so the longest one of a
rule's patterns goes into an automaton, and a text is tried on the rules whose
literals it holds, in order. Answers are kept by text, as modules and paths
repeat from event to event. Rules are a dimension that people write: up to
``MOST`` patterns they go to the workers by broadcast, beyond that by the joins
and expressions of ``grouping``, which say the same.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Any

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EXCEPTIONS, FRAME
from . import grouping
from .text import first_non_empty, present

MOST = 1 << 18
KEPT = 200_000
KINDS = ("platform", "message", "type", "value", "module", "path")


def glob_literal(pattern: str) -> str:
    """The longest run of characters that every match of a pattern holds; '' if none."""
    runs, run, at = [], "", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            run += pattern[at + 1]
            at += 2
            continue
        if c in "*?[\\":
            runs.append(run)
            run = ""
            if c == "[":
                at = max(pattern.find("]", at + 1), at)
        else:
            run += c
        at += 1
    return max([*runs, run], key=len)


@lru_cache(1 << 16)
def _compiled(pattern: str) -> re.Pattern:
    regex = grouping.glob_regex(pattern)
    return re.compile(f"{regex[:-2]}\\Z" if regex.endswith("\\z") else regex)


class _Literals:
    """Numbers by the literals that a text holds; those without one are in every text."""

    def __init__(self, found: list[tuple[str, int]]) -> None:
        self.always = [n for literal, n in found if not literal]
        self.tree = ahocorasick.Automaton()
        for literal, n in found:
            if literal:
                self.tree.get(literal, None) or self.tree.add_word(literal, [])
                self.tree.get(literal).append(n)
        if len(self.tree):
            self.tree.make_automaton()

    def of(self, text: str) -> set[int]:
        out = set(self.always)
        if len(self.tree):
            for _, numbers in self.tree.iter(text):
                out.update(numbers)
        return out


class RuleIndex:
    """Rules (order, [(type, pattern)], parts) of one project."""

    def __init__(self, rules: list[tuple[int, list[tuple[str, str]], list[str]]]) -> None:
        self.rules = sorted(rules, key=lambda r: r[0])
        by_kind: dict[str, list[tuple[str, int]]] = {k: [] for k in KINDS}
        for n, (_, matchers, _) in enumerate(self.rules):
            kind, pattern = max(matchers, key=lambda m: len(glob_literal(m[1])))
            if all(k in KINDS for k, _ in matchers):
                by_kind[kind].append((glob_literal(pattern), n))
        self.literals = {k: _Literals(found) for k, found in by_kind.items() if found}
        self.touched: dict[tuple[str, str], set[int]] = {}
        self.hits: dict[tuple[str, str], bool] = {}

    def _touched(self, kind: str, text: str) -> set[int]:
        found = self.touched.get((kind, text))
        if found is None:
            if len(self.touched) >= KEPT:
                self.touched.clear()
            found = self.touched[kind, text] = self.literals[kind].of(text)
        return found

    def _hits(self, pattern: str, text: str) -> bool:
        found = self.hits.get((pattern, text))
        if found is None:
            if len(self.hits) >= KEPT:
                self.hits.clear()
            found = self.hits[pattern, text] = _compiled(pattern).search(text) is not None
        return found

    def first(self, texts: dict[str, list[str]]) -> list[str] | None:
        """The parts of the first rule all of whose patterns match a text of their type."""
        candidates: set[int] = set()
        for kind in self.literals:
            for text in texts[kind]:
                candidates |= self._touched(kind, text)
        for n in sorted(candidates):
            _, matchers, parts = self.rules[n]
            if all(any(self._hits(pattern, text) for text in texts[kind]) for kind, pattern in matchers):
                return parts
        return None


class EnhancementIndex:
    """Enhancements (order, pattern, by module, in_app) of one project."""

    def __init__(self, rules: list[tuple[int, str, bool, bool | None]]) -> None:
        self.rules = sorted(rules, key=lambda r: r[0])
        self.literals = {by: _Literals([(glob_literal(r[1]), n) for n, r in enumerate(self.rules) if r[2] == by]) for by in (False, True)}
        self.kept: dict[tuple[bool, str], int] = {}

    def _first(self, by_module: bool, text: str) -> int:
        found = self.kept.get((by_module, text))
        if found is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            near = sorted(self.literals[by_module].of(text))
            found = self.kept[by_module, text] = next((n for n in near if _compiled(self.rules[n][1]).search(text)), len(self.rules))
        return found

    def in_app(self, path: str, module: str) -> bool | None:
        n = min(self._first(False, path), self._first(True, module))
        return self.rules[n][3] if n < len(self.rules) else None


_indexes: dict[Any, Any] = {}


def _index(model, key: int, project: int, kind: type):
    """A worker's index of a project's rules; those of an older broadcast go."""
    if _indexes.get("key") != (kind, key):
        _indexes.clear()
        _indexes["key"] = (kind, key)
    if project not in _indexes:
        own = model.value.get(project)
        _indexes[project] = kind(own) if own else None
    return _indexes[project]


def _texts(event: Column) -> dict[str, Column]:
    exceptions = F.coalesce(event["exceptions"], F.array().cast(EXCEPTIONS))
    frames = F.flatten(F.transform(exceptions, lambda e: F.coalesce(e["frames"], F.array().cast(f"array<{FRAME}>"))))
    each = {
        "platform": F.array(present(event["platform"])),
        "message": F.array(present(event["message"]), present(event["message_template"])),
        "type": F.transform(exceptions, lambda e: present(e["type"])),
        "value": F.transform(exceptions, lambda e: present(e["value"])),
        "module": F.transform(frames, lambda f: present(f["module"])),
        "path": F.transform(frames, lambda f: first_non_empty(f["abs_path"], f["filename"])),
    }
    return {k: F.array_distinct(c) for k, c in each.items()}


def with_first_rule(rows: DataFrame, rules: DataFrame, event: str = "input", into: str = "ruled") -> DataFrame:
    """``rows(project_id, <event>)`` with the fingerprint parts of the first rule that holds, or null.

    ``rules`` as of ``grouping.compiled_rules``. Pass the column to ``grouping.fingerprint``.
    """
    usable = rules.where((F.size("matchers") > 0) & (F.size("fingerprint") > 0))
    if (usable.agg(F.sum(F.size("matchers"))).collect()[0][0] or 0) > MOST:
        found = rows.join(grouping.compiled_rules(rules), "project_id", "left")
        return found.withColumn(into, grouping.first_matching_rule(F.col(event), F.col("rules"))).drop("rules")
    known: dict[int, list] = {}
    for r in usable.select("project_id", "rule_order", "matchers", "fingerprint").collect():
        known.setdefault(r["project_id"], []).append((r["rule_order"], [(m["type"], m["pattern"] or "") for m in r["matchers"]], list(r["fingerprint"])))
    model = rows.sparkSession.sparkContext.broadcast(known)
    key = model._jbroadcast.id()

    @F.pandas_udf("array<string>")
    def first(project: pd.Series, platform: pd.Series, message: pd.Series, type_: pd.Series, value: pd.Series, module: pd.Series, path: pd.Series) -> pd.Series:
        out = []
        for p, *texts in zip(project, platform, message, type_, value, module, path, strict=True):
            index = _index(model, key, p, RuleIndex)
            out.append(index.first(dict(zip(KINDS, texts, strict=True))) if index else None)
        return pd.Series(out, dtype=object)

    texts = _texts(F.col(event))
    return rows.withColumn(into, first("project_id", *(texts[k] for k in KINDS)))


def with_enhanced_frames(rows: DataFrame, rules: DataFrame, event: str = "input") -> DataFrame:
    """``rows(project_id, <event>)`` with the frames' in_app from the first enhancement that matches their path or module.

    ``rules`` as of ``grouping.compiled_enhancements``.
    """
    exceptions = F.col(event)["exceptions"]
    if rules.count() > MOST:
        found = rows.join(grouping.compiled_enhancements(rules), "project_id", "left")
        return found.withColumn(event, F.col(event).withField("exceptions", grouping.enhance_frames(exceptions, F.col("enhancements")))).drop("enhancements")
    known: dict[int, list] = {}
    for r in rules.select("project_id", "rule_order", "pattern", "match_module", "in_app").collect():
        known.setdefault(r["project_id"], []).append((r["rule_order"], r["pattern"] or "", bool(r["match_module"]), r["in_app"]))
    model = rows.sparkSession.sparkContext.broadcast(known)
    key = model._jbroadcast.id()

    @F.pandas_udf("array<boolean>")
    def forced(project: pd.Series, paths: pd.Series, modules: pd.Series) -> pd.Series:
        out = []
        for p, own_paths, own_modules in zip(project, paths, modules, strict=True):
            index = _index(model, key, p, EnhancementIndex)
            out.append([index.in_app(a, b) for a, b in zip(own_paths, own_modules, strict=True)] if index else [])
        return pd.Series(out, dtype=object)

    none = F.array().cast(f"array<{FRAME}>")
    frames = F.flatten(F.transform(F.coalesce(exceptions, F.array().cast(EXCEPTIONS)), lambda e: F.coalesce(e["frames"], none)))
    flags = forced("project_id", F.transform(frames, lambda f: first_non_empty(f["abs_path"], f["filename"])), F.transform(frames, lambda f: present(f["module"])))
    before = lambda k: F.aggregate(F.slice(exceptions, 1, k), F.lit(0), lambda n, e: n + F.size(F.coalesce(e["frames"], none)))
    one = lambda start: lambda f, i: f.withField("in_app", F.coalesce(F.get(F.col("_forced"), start + i), f["in_app"]))
    new = F.transform(exceptions, lambda e, k: e.withField("frames", F.transform(e["frames"], one(before(k)))))
    return rows.withColumn("_forced", flags).withColumn(event, F.col(event).withField("exceptions", new)).drop("_forced")

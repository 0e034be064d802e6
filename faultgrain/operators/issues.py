"""Issues: groups of events of one fingerprint, with status, merges and search.

An issue is keyed by (project_id, fingerprint). Hits and commands share one
arrival order. Commands are few; hits are many and only ever joined,
aggregated and windowed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import running
from ..functions.text import title_contains
from ..sources.store import kept
from .query import event_predicate, scope

STATUSES = ("unresolved", "resolved", "ignored", "regressed")
SETTABLE = STATUSES[:3]
LIST_LIMIT, LIST_MOST = 100, 500
LATEST, LATEST_MOST = 5, 50
MAX_SOURCES = 100
_KEY = ["project_id", "fingerprint"]
_EFFECTS = "project_id bigint, effect string, fingerprint string, target string, from_seq bigint, to_seq bigint, count bigint, status string"
_FOREVER = 1 << 62
_CARRIED = "carried merge"
ISSUES = (
    "project_id bigint, fingerprint string, basis string, title string, level string, status string, first_seen bigint, last_seen bigint, times_seen bigint, merged_into string"
)


def rollup(hits: DataFrame) -> DataFrame:
    """One row per fingerprint, without commands: first arrival's title and basis, last arrival's level."""
    first = lambda c: F.min_by(c, "arrival_seq").alias(c)
    return hits.groupBy(*_KEY).agg(
        first("basis"), first("title"), F.max_by("level", "arrival_seq").alias("level"), F.min_by("seen_at", "arrival_seq").alias("first_seen"),
        F.max("seen_at").alias("last_seen"), F.count("*").alias("times_seen"),
    )


def _apply_commands(key: tuple, commands: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
    """Effects of one project's commands, given how often each named fingerprint was hit between them."""
    project = int(key[0])
    created = hits.groupby("fingerprint")["first_seq"].min().to_dict()
    hits_at: dict[int, list] = {}
    for r in hits[hits["k"] >= 0].itertuples(index=False):
        hits_at.setdefault(int(r.k), []).append((r.fingerprint, int(r.n)))
    carried = hits[hits["k"] < 0]
    seen: dict[str, int] = {name: int(n) for name, n in zip(carried["fingerprint"], carried["n"], strict=True)}
    merged = commands["kind"] == _CARRIED
    into: dict[str, tuple[str, int]] = {c.fingerprint: (c.target, -1) for c in commands[merged].itertuples(index=False)}
    commands = commands[~merged]
    out = []

    def close(name: str, seq: int) -> None:
        if name in into:
            target, since = into.pop(name)
            out.append((project, "interval", name, target, since, seq, 0, None))

    for k, c in enumerate(commands.sort_values("arrival_seq").itertuples(index=False)):
        for name, n in hits_at.get(k, []):
            at = into.get(name, (name,))[0]
            seen[at] = seen.get(at, 0) + n
        seq = int(c.arrival_seq)
        exists = lambda name: created.get(name, _FOREVER) < seq  # noqa: B023, E731
        if c.kind == "status" and c.status in SETTABLE and exists(c.fingerprint):
            out.append((project, "status", c.fingerprint, c.fingerprint, seq, seq, 0, c.status))
        elif c.kind == "split" and c.fingerprint in into:
            close(c.fingerprint, seq)
            out.append((project, "status", c.fingerprint, c.fingerprint, seq, seq, 0, "unresolved"))
        elif c.kind == "merge":
            sources = list(c.sources) if c.sources is not None else []
            valid = exists(c.target) and c.target not in into and 0 < len(sources) <= MAX_SOURCES
            if valid and all(exists(s) and s != c.target for s in sources):
                for s in sources:
                    moved = [s, *(x for x, (t, _) in into.items() if t == s)]
                    for x in moved:
                        close(x, seq)
                        into[x] = (c.target, seq)
                    out.append((project, "transfer", c.target, c.target, seq, seq, seen.get(s, 0), None))
                    seen[c.target] = seen.get(c.target, 0) + seen.get(s, 0)
    for name in list(into):
        close(name, _FOREVER)
    return pd.DataFrame(out, columns=[c.split()[0] for c in _EFFECTS.split(", ")])


def command_effects(hits: DataFrame, commands: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """What valid commands do: intervals of merged fingerprints, transferred counts, status changes.

    Per project the command log alone is walked in order, next to counts of hits
    per named fingerprint and stretch between commands. ``before`` is the issue
    table before the first of these hits and commands.
    """
    if before is not None:
        held = before.where("merged_into is not null")
        commands = commands.unionByName(held.select("project_id", F.lit(-1).cast("bigint").alias("arrival_seq"), F.lit(_CARRIED).alias("kind"), "fingerprint", F.col("merged_into").alias("target")), allowMissingColumns=True)
    named = commands.select("project_id", F.explode(F.array_compact(F.concat(F.array("fingerprint", "target"), F.coalesce("sources", F.array().cast("array<string>"))))).alias("fingerprint"))
    own = hits.select("project_id", "arrival_seq", "fingerprint").join(named.distinct(), _KEY, "left_semi")
    both = own.withColumn("_cmd", F.lit(0)).unionByName(commands.where(F.col("kind") != _CARRIED).select("project_id", "arrival_seq", F.lit(None).cast("string").alias("fingerprint"), F.lit(1).alias("_cmd")))
    ranked = running(both, ["project_id"], "arrival_seq", {"k": F.col("_cmd")}).where("_cmd = 0")
    counts = ranked.groupBy(*_KEY, "k").agg(F.count("*").alias("n"), F.min("arrival_seq").alias("first_seq"))
    if before is not None:
        known = before.join(named.distinct(), _KEY, "left_semi").select(*_KEY, F.lit(-1).cast("bigint").alias("k"), F.col("times_seen").alias("n"), F.lit(-1).cast("bigint").alias("first_seq"))
        counts = counts.select(*_KEY, F.col("k").cast("bigint").alias("k"), "n", "first_seq").unionByName(known)
    # Both sides stem from the same tables; fresh aliases tell their columns apart.
    log, counts = (df.select(*(F.col(c).alias(f"{c}_").alias(c) for c in df.columns)) for df in (commands, counts))
    return log.groupBy("project_id").cogroup(counts.groupBy("project_id")).applyInPandas(_apply_commands, _EFFECTS)


def _routed(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Hits with the ``target`` that their fingerprint is merged into at their time, else the fingerprint.

    Spans of a fingerprint don't overlap. So their ends are changes in the log of
    hits, and a hit takes the last change before it; how many spans there are
    does not matter. Hits of fingerprints without spans stay where they are.
    """
    null = F.lit(None).cast("string")
    ends = spans.select(*_KEY, F.col("from_seq").alias("arrival_seq"), F.col("target").alias("_into")).unionByName(spans.select(*_KEY, F.col("to_seq").alias("arrival_seq"), null.alias("_into")))
    # Where a span ends and another begins, it begins.
    changes = ends.groupBy(*_KEY, "arrival_seq").agg(F.coalesce(F.max("_into"), F.lit("")).alias("_into"))
    marked = hits.join(spans.select(*_KEY, F.lit(True).alias("_merged")).distinct(), _KEY, "left")
    own = marked.where("_merged").drop("_merged").withColumns({"_into": null, "_hit": F.lit(1)})
    ran = running(own.unionByName(changes.where(F.col("arrival_seq") < _FOREVER), allowMissingColumns=True), _KEY, "arrival_seq", {"_n": F.col("_hit")}, {"_last": F.col("_into")}).where("_hit = 1")
    target = F.when(F.col("_last") != "", F.col("_last")).otherwise(F.col("fingerprint"))
    ran = ran.select(*hits.columns, target.alias("target"))
    return ran.unionByName(marked.where("_merged is null").select(*hits.columns, F.col("fingerprint").alias("target")))


def timeline(hits: DataFrame, commands: DataFrame, effects: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """Per hit: the issue it counts for, is_new, regressed, times_seen and status after it; ``before`` as of ``command_effects``."""
    # A few rows per command, read several times below.
    effects = kept(command_effects(hits, commands, before), "effects") if effects is None else effects
    spans = effects.where("effect = 'interval'").select("project_id", "fingerprint", "target", "from_seq", "to_seq")
    first = hits.groupBy(*_KEY).agg(F.min("arrival_seq").alias("_first"))
    if before is not None:
        first = first.join(before.select(*_KEY, F.lit(True).alias("_known")), _KEY, "left").select(*_KEY, F.when(F.col("_known"), -1).otherwise(F.col("_first")).alias("_first"))
    placed = _routed(hits, spans).join(first, _KEY)
    rows = placed.select("*", (F.col("arrival_seq") == F.col("_first")).alias("is_new"), F.lit(1).cast("bigint").alias("weight"), F.lit("hit").alias("row"), F.lit(None).cast("string").alias("set_status")).drop("_first")
    changes = effects.where("effect in ('status', 'transfer')").select(
        "project_id", F.col("from_seq").alias("arrival_seq"), "target", F.col("count").alias("weight"), F.col("effect").alias("row"), F.col("status").alias("set_status")
    )
    if before is not None:
        old = before.select("project_id", F.lit(-1).cast("bigint").alias("arrival_seq"), F.col("fingerprint").alias("target"), F.col("times_seen").alias("weight"), F.lit("status").alias("row"), F.col("status").alias("set_status"))
        changes = changes.unionByName(old.join(rows.select("project_id", "target").distinct(), ["project_id", "target"], "left_semi"))
    both = rows.unionByName(changes, allowMissingColumns=True)
    before = {"_prior": F.when(F.col("row") == "hit", "hit").when(F.col("row") == "status", F.col("set_status")), "_set": F.col("set_status")}
    ran = running(both, ["project_id", "target"], "arrival_seq", {"times_seen": F.col("weight")}, before).where("row = 'hit'")
    regressed = ~F.col("is_new") & F.coalesce(F.col("_prior") == "resolved", F.lit(False))
    now = F.coalesce("_set", F.lit("unresolved"))
    status = F.when(F.col("is_new"), "unresolved").when(now == "resolved", "regressed").otherwise(now)
    return ran.select(*hits.columns, "target", "is_new", regressed.alias("regressed"), "times_seen", status.alias("status"))


def current_issues(hits: DataFrame, commands: DataFrame) -> DataFrame:
    """The issue table after all hits and commands, merged issues included."""
    effects = kept(command_effects(hits, commands), "effects")
    line = timeline(hits, commands, effects)
    first = lambda c: F.min_by(c, "arrival_seq").alias(c)
    made = hits.groupBy(*_KEY).agg(first("basis"), first("title"), F.min_by("seen_at", "arrival_seq").alias("first_seen"))
    counted = line.groupBy("project_id", F.col("target").alias("fingerprint")).agg(
        F.max_by("level", "arrival_seq").alias("level"), F.max("seen_at").alias("last_seen"), F.count("*").alias("n"), F.max("arrival_seq").alias("_hit")
    )
    moved = effects.where("effect = 'transfer'").groupBy(*_KEY).agg(F.sum("count").alias("moved"))
    set_to = effects.where("effect = 'status'").groupBy(*_KEY).agg(F.max_by("status", "from_seq").alias("set_to"), F.max("from_seq").alias("_set"))
    merged = effects.where((F.col("effect") == "interval") & (F.col("to_seq") == _FOREVER)).select(*_KEY, F.col("target").alias("merged_into"))
    out = made.join(counted, _KEY).join(moved, _KEY, "left").join(set_to, _KEY, "left").join(merged, _KEY, "left")
    status = F.when((F.col("set_to") == "resolved") & (F.col("_hit") > F.col("_set")), "regressed").otherwise(F.coalesce("set_to", F.lit("unresolved")))
    seen = F.col("n") + F.coalesce("moved", F.lit(0))
    return out.select(*_KEY, "basis", "title", "level", status.alias("status"), "first_seen", "last_seen", seen.alias("times_seen"), "merged_into")


def advance(before: DataFrame, hits: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes of further hits and commands, and the issue table after them; ``before`` is the one until now, empty at first.

    Taking a log in parts gives the outcomes and issues of taking it whole.
    """
    effects = kept(command_effects(hits, commands, before), "effects")
    line = kept(timeline(hits, commands, effects, before), "timeline")
    first = lambda c: F.min_by(c, "arrival_seq").alias(c)
    made = hits.groupBy(*_KEY).agg(first("basis"), first("title"), F.min_by("seen_at", "arrival_seq").alias("first_seen"))
    counted = line.groupBy("project_id", F.col("target").alias("fingerprint")).agg(
        F.max_by("level", "arrival_seq").alias("_level"), F.max("seen_at").alias("_seen"), F.count("*").alias("_n"), F.max_by("status", "arrival_seq").alias("_status"), F.max("arrival_seq").alias("_hit")
    )
    moved = effects.where("effect = 'transfer'").groupBy(*_KEY).agg(F.sum("count").alias("_moved"))
    set_to = effects.where("effect = 'status'").groupBy(*_KEY).agg(F.max_by("status", "from_seq").alias("_to"), F.max("from_seq").alias("_set"))
    merged = effects.where((F.col("effect") == "interval") & (F.col("to_seq") == _FOREVER)).select(*_KEY, F.col("target").alias("_into"))
    old = before.select(*_KEY, *(F.col(c).alias(f"_old_{c}") for c in ("basis", "title", "level", "status", "first_seen", "last_seen", "times_seen")))
    out = old.join(made, _KEY, "full_outer")
    for part in (counted, moved, set_to, merged):
        out = out.join(part, _KEY, "left")
    kept_first = lambda c: F.coalesce(f"_old_{c}", c).alias(c)
    by_hit = F.col("_hit").isNotNull() & (F.col("_set").isNull() | (F.col("_hit") > F.col("_set")))
    status = F.when(by_hit, F.col("_status")).otherwise(F.coalesce("_to", "_old_status", F.lit("unresolved"))).alias("status")
    seen = (F.coalesce("_old_times_seen", F.lit(0)) + F.coalesce("_n", F.lit(0)) + F.coalesce("_moved", F.lit(0))).alias("times_seen")
    after = out.select(
        *_KEY, kept_first("basis"), kept_first("title"), F.coalesce("_level", "_old_level").alias("level"), status, kept_first("first_seen"),
        F.greatest("_old_last_seen", "_seen").alias("last_seen"), seen, F.col("_into").alias("merged_into"),
    )
    return line, after


def set_status(project_id: int, fingerprint: str, status: str, seq: int) -> tuple:
    """A command row; only three statuses can be set."""
    if status not in SETTABLE:
        raise ValueError(f"status {status!r} cannot be set")
    return (seq, project_id, "status", fingerprint, None, None, status)


def merge_issues(project_id: int, target: str, sources: list[str], seq: int) -> tuple:
    """A command row that merges 1 to 100 issues into another; atomic when applied."""
    if not 0 < len(sources) <= MAX_SOURCES or target in sources:
        raise ValueError("name 1 to 100 sources, without the target")
    return (seq, project_id, "merge", None, target, list(sources), None)


def split_issue(project_id: int, fingerprint: str, seq: int) -> tuple:
    return (seq, project_id, "split", fingerprint, None, None, None)


def filter_issues(issues: DataFrame, project_id: int | None, *, status: str = "", level: str = "", title: str = "", fingerprint: str = "", within: DataFrame | None = None) -> DataFrame:
    """Unmerged issues of a project; ``within(project_id, fingerprint)`` restricts them, and to none if it is empty."""
    out = scope(issues, project_id).where("merged_into is null")
    for name, value in (("status", status), ("level", level), ("fingerprint", fingerprint)):
        if value:
            out = out.where(F.col(name) == value)
    if title:
        out = out.where(title_contains(F.col("title"), title))
    return out if within is None else out.join(within, _KEY, "left_semi")


def latest_issues(issues: DataFrame, limit: int = 0) -> DataFrame:
    """Most recently seen first; at most ``limit`` (100 if not in 1 to 500)."""
    return issues.orderBy(F.desc("last_seen"), "fingerprint").limit(limit if 0 < limit <= LIST_MOST else LIST_LIMIT)


def parse_search(text: str) -> dict[str, str]:
    """Keywords of ``search_issues`` from ``key:value`` words and bare words; quotes keep blanks together."""
    keys = {"is": "status", "level": "level", "release": "release", "environment": "environment", "env": "environment", "user": "user", "user.id": "user", "fingerprint": "fingerprint"}
    words, word, quoted = [], "", False
    for char in text + " ":
        quoted ^= char == '"'
        if char == " " and not quoted:
            words += [word] if word else []
            word = ""
        else:
            word += char
    words += [word.rstrip(" ")] if word.strip() else []
    found: dict[str, str] = {}
    bare = []
    for word in words:
        key, colon, value = word.partition(":")
        if not colon:
            bare.append(word)
        elif key.lower() not in keys:
            raise ValueError(f"unknown search key {key!r}; known: {', '.join(keys)}")
        else:
            found[keys[key.lower()]] = value.strip('"')
    if "status" in found and found["status"] not in STATUSES:
        raise ValueError(f"unknown status {found['status']!r}; known: {', '.join(STATUSES)}")
    return found | ({"text": " ".join(bare)} if bare else {})


def search_issues(
    issues: DataFrame, events: DataFrame, project_id: int | None, *, status: str = "", level: str = "", release: str = "", environment: str = "", user: str = "", fingerprint: str = "", text: str = ""
) -> DataFrame:
    """Issues of a project by their own fields and, by a semi join, by fields of their events."""
    if status and status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    within = None
    if release or environment or user:
        within = scope(events, project_id).where(event_predicate(release=release, environment=environment, user_id=user)).select(*_KEY)
    return filter_issues(issues, project_id, status=status, level=level, title=text, fingerprint=fingerprint, within=within)


def latest_events(issues: DataFrame, events: DataFrame, n: int = LATEST) -> DataFrame:
    """The newest ``n`` (1 to 50, else 5) events of each issue."""
    n = n if 0 < n <= LATEST_MOST else LATEST
    found = events.join(issues.select(*_KEY).distinct(), _KEY, "left_semi")
    # Spark keeps n rows per group before it shuffles them.
    rank = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.desc("ts_ns"), "event_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def issue_ids(hits: DataFrame) -> DataFrame:
    """(project_id, fingerprint, issue_id): numbers in the order of first arrival."""
    first = hits.groupBy(*_KEY).agg(F.min("arrival_seq").alias("first_seq"))
    return running(first, [], "first_seq", {"issue_id": F.lit(1).cast("bigint")}).select(*_KEY, "issue_id")


def get_issue(issues: DataFrame, project_id: int | None, issue_id: int) -> DataFrame:
    """The issue with this id in this project; another project's id finds nothing."""
    return scope(issues, project_id).where(F.col("issue_id") == issue_id)

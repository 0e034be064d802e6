"""Quality rules with host-level verdicts.

Each document is measured and judged by rules. Failures are added up by domain
(column ``source``), a beta prior is fitted to the domains' failure rates by
their mean and variance, and each rate is shrunk towards the prior mean, so a
domain of few documents is not judged by chance. Documents of a domain whose
shrunk rate exceeds ``HOST_LIMIT`` are rejected together with those that fail a
base rule themselves.

Built-in functions only. The verdicts of rejected domains are broadcast if
there are at most ``BROADCAST_HOSTS`` of them, else joined by a shuffle.

Defined cases: a null text has no words and fails; a null source is a domain of
its own; repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._native import let, words
from ._store import cut, fresh

WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS_PER_WORD = 0.1
DUP_LINE_SHARE = 0.3
HOST_LIMIT = 0.5
BROADCAST_HOSTS = 100_000
_SYMBOLS = "#*$%&|<>"


def repeat_words(found: Column) -> Column:
    """Words of an array that lie in windows of five words found at least twice."""

    def windows(w: Column) -> Column:
        hashed = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), hashed)

    def covered(places: Column) -> Column:
        step = lambda p, i: F.coalesce(F.least(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))
        return F.aggregate(F.transform(places, step), F.lit(0), lambda a, x: a + x)

    def repeated(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            kept = F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
            return F.array_sort(F.transform(kept, lambda e: e["i"]))

        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(let(pairs, again), covered)).otherwise(0)

    return F.when(F.size(found) > WINDOW, let(let(found, windows), repeated)).otherwise(0)


def measured(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with a struct ``column`` of the measures of ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^ \\t\\n\\x0B\\f\\r]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    symbols = F.when(text.rlike("[#*$%&|<>]"), F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).otherwise(0)
    both = F.struct(let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"), symbols.cast("long").alias("n_symbols"))
    return docs.withColumn(column, both)


def failures(m: Column) -> tuple[Column, Column]:
    """(fails a base rule, fails any rule) from a measure struct."""
    n = m["w"]["n_words"]
    base = (n < MIN_WORDS) | (100 * m["w"]["n_repeat_words"] > REPEAT_PERCENT * n)
    soft = (m["n_symbols"] > SYMBOLS_PER_WORD * n) | (m["l"]["n_dup_lines"] > DUP_LINE_SHARE * m["l"]["n_lines"])
    return base, base | soft


def rejected_hosts(judged: DataFrame) -> DataFrame:
    """(host) of ``judged(host, failed)`` with a shrunk failure rate above the limit, sized for a join."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.count_if("failed").alias("bad"))
    hosts = cut(hosts)
    rate = F.col("bad") / F.col("n")
    row = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var")).collect()[0]
    mean, var = row["mean"] or 0.0, row["var"] or 0.0
    strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1e6) if var > 0 else 1e6
    shrunk = (F.col("bad") + mean * strength) / (F.col("n") + strength)
    out = hosts.where(shrunk > HOST_LIMIT).select("host", F.lit(True).alias("host_rejected"))
    return F.broadcast(out) if out.count() <= BROADCAST_HOSTS else out


def judge_documents(docs: DataFrame) -> DataFrame:
    """Measures, base_failed and kept of each row of ``docs(doc_id, text, source)``."""
    rows = measured(docs.select("doc_id", "text", F.col("source").alias("host")), "m").drop("text")
    base, any_rule = failures(F.col("m"))
    rows = cut(rows.select("doc_id", "host", "m", base.alias("base_failed"), any_rule.alias("failed")))
    bad = rejected_hosts(rows)
    out = rows.join(bad, rows["host"].eqNullSafe(bad["host"]), "left")
    return out.select(
        "doc_id",
        "m.w.n_words",
        "m.w.word_chars",
        "m.n_symbols",
        "m.l.n_dup_lines",
        "m.w.n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.col("host_rejected").isNull()).alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Texts are measured once and written to the shared folder."""
    m, host, failed, base_failed, bad_host = (fresh(docs, c) for c in ("measures", "host", "failed", "base_failed", "host_rejected"))
    base, any_rule = failures(F.col(m))
    flags = measured(docs, m).select(*docs.columns, base.alias(base_failed), any_rule.alias(failed))
    # What fails itself counts for its domain, but its text goes now.
    rows = cut(flags.select(*(F.when(~F.col(base_failed), F.col(c)).alias(c) for c in docs.columns), F.col("source").alias(host), failed, base_failed))
    bad = rejected_hosts(rows.select(F.col(host).alias("host"), F.col(failed).alias("failed")))
    bad = bad.withColumnsRenamed({"host": f"_{host}", "host_rejected": bad_host})
    out = rows.where(~F.col(base_failed)).join(bad, rows[host].eqNullSafe(bad[f"_{host}"]), "left")
    return out.where(F.col(bad_host).isNull()).select(*docs.columns)

"""How filters interact: what each removes, in every order of application.

Five filters look at each text: A few words, B few distinct words, C many
capitals, D symbols, E a copy of a smaller doc_id's text. A to D follow from the
text alone. E is an existential self-join: rows are semi-joined with the texts
of their hash, on hash, exact text and a smaller doc_id. The ids it marks are
united with the ids that fail the other filters, each document's failures
become a bit combination, and the documents of a part are counted per
combination. That small table answers every order of the filters.

What moves: one narrow row a document. Texts move only where a hash is met with
two ids. The side that is looked up holds one row per distinct text, combined
before its shuffle. A hash that a 4096th of all rows share is hot; there are at
most 4096 of these, so they are broadcast, and their rows are dealt over
``SALTS`` keys that the looked-up side repeats. Up to ``BROADCAST_HASHES``
repeated hashes go to the texts by broadcast, more by a shuffle.

Built-in functions only.

Defined cases: a null text is empty; a null doc_id is neither smaller than any
id nor has a smaller one, and has no labels; repeated rows are counted each and
are no copies of one another by the same id; labels that repeat an id count if
any of them says 1; a null lang is the part ''; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._native import let, words
from ._store import cut

FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITALS_PERCENT = 10
SYMBOLS = "[#$%&*|]"
HOT_SHARE = 4096
SALTS = 64
BROADCAST_HASHES = 1 << 20
COPY = 1 << FILTERS.index("E")


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    bit = lambda name, fails: F.when(fails, 1 << FILTERS.index(name)).otherwise(0)

    def of_words(w: Column) -> Column:
        return bit("A", F.size(w) < MIN_WORDS) + bit("B", 100 * F.size(F.array_distinct(w)) < DISTINCT_PERCENT * F.size(w))

    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > CAPITALS_PERCENT * F.length(text).cast("long")
    return (let(words(text), of_words) + bit("C", capitals) + bit("D", text.rlike(SYMBOLS))).cast("int")


def copies(docs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(doc_id, hash) of rows whose text a smaller doc_id has too.

    ``hashed(doc_id, hash)`` has a row for each of ``docs``; hash is xxhash64 of the text, null as empty.
    """
    same = hashed.where("doc_id is not null").groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    same = cut(same.where("low < high").select("hash", "n"))
    hot = F.broadcast(same.where(F.col("n") > hashed.count() // HOT_SHARE + 1).select("hash", F.lit(True).alias("hot")))
    repeated = F.broadcast(same.select("hash")) if same.count() <= BROADCAST_HASHES else same.select("hash")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null").withColumn("hash", F.xxhash64("text"))
    rows = rows.join(repeated, "hash", "left_semi")

    left = rows.join(hot, "hash", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    firsts = rows.groupBy("hash", "text").agg(F.min("doc_id").alias("first")).join(hot, "hash", "left")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    firsts = firsts.select("hash", "text", "first", F.explode(salts).alias("salt"))
    smaller = F.expr("l.hash = r.hash AND l.salt = r.salt AND l.text = r.text AND r.first < l.doc_id")
    return left.alias("l").join(firsts.alias("r"), smaller, "left_semi").select("doc_id", "hash")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): documents of each lang by the bits of all filters they fail, and by labels."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("hash"), text_failures(text).alias("fails"))
    rows = cut(rows)
    marked = copies(docs, rows.select("doc_id", "hash"))
    # Ids and their failures of both kinds; a document is what is added up under one id and hash.
    united = rows.groupBy("doc_id", "hash", "part", "fails").agg(F.count("*").alias("n"), F.lit(0).alias("copy"))
    united = united.unionByName(marked.select("doc_id", "hash", F.lit(None).cast("string").alias("part"), F.lit(0).alias("fails"), F.lit(0).cast("long").alias("n"), F.lit(COPY).alias("copy")))
    named = F.when(F.col("part").isNotNull(), F.struct("part", "fails", "n"))
    united = united.groupBy("doc_id", "hash").agg(F.collect_list(named).alias("seen"), F.max("copy").alias("copy"))
    united = united.select("doc_id", "hash", "copy", F.explode("seen").alias("s")).select("doc_id", "hash", "s.part", F.col("s.fails").bitwiseOR(F.col("copy")).alias("fails"), "s.n")

    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    # Rows without an id have no labels; the hash as their key deals them in the join.
    united = united.withColumn("key", F.struct(F.coalesce("doc_id", "hash").alias("id"), F.col("doc_id").isNull().alias("none")))
    known = known.withColumn("key", F.struct(F.col("doc_id").alias("id"), F.lit(False).alias("none"))).drop("doc_id")
    out = united.join(known, "key", "left")
    return out.groupBy("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of each part, order of the filters and step, from ``docs(doc_id, text, lang)`` and ``labels(doc_id, quality, toxic)``."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            steps.append(("".join(order), step, bit, before))
            before |= bit
    kind = "array<struct<filter_order: string, step: int, bit: int, before: int>>"
    each = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{s},"bit":{b},"before":{p}}}' for o, s, b, p in steps) + "]"), kind)
    rows = cut(combinations(docs, labels)).select("*", F.inline(each))
    own = F.col("fails").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("fails").bitwiseAND(F.col("before")) != 0
    here = own & ~earlier
    total = lambda name, when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long").alias(name)
    # Among k failures the filter comes first in 120 / k of the orders.
    share = F.when(own, F.col("n") * F.expr(f"{len(steps) // len(FILTERS)} div bit_count(fails)")).otherwise(0)
    return rows.groupBy("part", "filter_order", "step").agg(
        total("kept", ~own & ~earlier),
        total("removed", here),
        total("redundant", own & earlier),
        total("unique_fails", F.col("fails") == F.col("bit")),
        total("good_lost", here & F.col("good")),
        total("toxic_lost", here & F.col("toxic")),
        F.sum(share).cast("long").alias("shapley"),
    )

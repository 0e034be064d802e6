"""Personal data and the terms that disclose it.

Four kinds of personal data are found by pattern and checked (address parts,
Luhn sums, digit counts). They are the protected entities. Every word of a
document that holds an entity, wherever it stands, is a term for it if they
meet in at least two different texts; words that touch a span are not words
here. How strongly a term reveals the entity is their pointwise mutual
information over all documents, relative to the entity's own information:

    log2(N * n(term, entity) / (n(term) * n(entity))) / log2(N / n(entity))

It is 1 for a term that never occurs without the entity. Terms of at least
``DISCLOSURE`` are spans too, in every document that holds the entity: digits
in them are generalised, other terms removed, in the sanitised text.

All three counts are of documents. Built-in functions only. Entities of one
text have no terms and are left out before words are counted with entities.
Word counts cover all documents; candidate terms are broadcast to them if there
are at most ``BROADCAST_TERMS``, else joined after counting.

Defined cases: a null text counts as empty and has no spans; repeated rows get
equal results; a null doc_id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._native import WORD, blocks, let, matches, piece, running, words
from ._store import cut

DISCLOSURE = 0.9
MIN_TEXTS = 2
BROADCAST_TERMS = 200_000
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# The possessive groups and the look-behinds (or end of the last match) only save retries.
_EMAIL = f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
_IP = "(?:(?<![0-9])|\\G)[0-9]++(?:\\.[0-9]++){3}"
_CARD = "[0-9](?:[ -]?[0-9])++"
_PHONE = "\\+[0-9][ ().0-9-]+[0-9]"
_SPANS = "array<struct<start: int, kind: int, end: int, value: string>>"


def _luhn(digits: Column) -> Column:
    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = n * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(n)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid_card(value: Column) -> Column:
    digits = F.translate(value, " -", "")
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


def _valid_phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)


def base_spans(text: Column) -> Column:
    """Spans (start, kind, end, value) of personal data, by start and kind."""
    rules = (
        (text.contains("@"), _EMAIL, None),
        (text.rlike("[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]"), _IP, lambda v: v.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$")),
        (text.rlike("[0-9](?:[ -]?[0-9]){11}"), _CARD, _valid_card),
        (text.contains("+"), _PHONE, _valid_phone),
    )

    def of_kind(kind: int, maybe: Column, pattern: str, valid) -> Column:
        found = matches(text, pattern)
        if valid:
            found = F.filter(found, lambda m: valid(m["value"]))
        found = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))
        return F.when(maybe, found).otherwise(F.expr(f"cast(array() as {_SPANS})"))

    parts = [of_kind(kind, *rule) for kind, rule in enumerate(rules)]
    return F.array_sort(F.concat(*parts))


def _entities(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: F.concat_ws(":", s["kind"].cast("string"), s["value"])))


def _gaps(spans: Column) -> Column:
    """(from, to, kind, value) for each span: the stretch before it that no earlier span covers, and the span itself."""
    reach = running(F.transform(spans, lambda s: s["end"]), "0", lambda a, b: F.greatest(a, b))
    return let(reach, lambda r: F.transform(spans, lambda s, i: F.struct(F.get(r, i).alias("from"), s["start"].alias("to"), s["kind"].alias("kind"), s["value"].alias("value"))))


def _last_end(spans: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))


def _outside(text: Column, spans: Column) -> Column:
    """The text without the spans and the words that touch them."""

    def of(parts: Column) -> Column:
        def one(g: Column) -> Column:
            gap = F.when(g["to"] >= g["from"], piece(parts, g["from"], g["to"])).otherwise("")
            return F.regexp_replace(behind(g["from"], gap), f"(?<!{WORD[:-1]}){WORD}+\\z", "")

        def behind(at: Column, gap: Column) -> Column:
            return F.when(at > 0, F.regexp_replace(gap, f"\\A{WORD}+", "")).otherwise(gap)

        end = _last_end(spans)
        rest = behind(end, piece(parts, end, F.length(text)))
        return F.array_join(F.concat(F.transform(_gaps(spans), one), F.array(rest)), " ")

    return let(blocks(text), of)


def disclosing_terms(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of terms that reveal entities of ``found(h, text, spans)``, counted over ``docs``."""
    total = docs.count()
    holders = found.select("h", F.explode(_entities(F.col("spans"))).alias("entity"))
    entities = holders.groupBy("entity").agg(F.count("*").alias("n_entity"), F.count_distinct("h").alias("texts"))
    entities = cut(entities.where(F.col("texts") >= MIN_TEXTS).drop("texts"))
    held = holders.distinct().join(entities.select("entity"), "entity").groupBy("h").agg(F.collect_list("entity").alias("entities"))
    texts = found.groupBy("h", "text").agg(F.count("*").alias("n"), F.first("spans").alias("spans"))
    own = F.array_distinct(words(_outside(F.col("text"), F.col("spans"))))
    texts = texts.join(held, "h").select("n", F.array_intersect("entities", _entities(F.col("spans"))).alias("entities"), own.alias("terms"))
    near = texts.select("n", "entities", F.explode("terms").alias("term")).select("n", "term", F.explode("entities").alias("entity"))
    near = near.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("texts"))
    near = cut(near.where(F.col("texts") >= MIN_TEXTS).drop("texts"))
    terms = near.select("term").distinct()
    # Words that stand only where they touch spans do not count.
    seen = docs.select(F.explode(F.array_distinct(words(F.coalesce(F.col("text"), F.lit(""))))).alias("term"), F.lit(1).alias("n"))
    touching = F.array_except(words(F.col("text")), words(_outside(F.col("text"), F.col("spans"))))
    seen = seen.unionAll(found.select(F.explode(touching).alias("term"), F.lit(-1).alias("n")))
    few = terms.count() <= BROADCAST_TERMS
    if few:
        seen = seen.join(F.broadcast(terms), "term", "left_semi")
    counts = seen.groupBy("term").agg(F.sum("n").alias("n_term"))
    shared = F.log2(total * F.col("both") / (F.col("n_term") * F.col("n_entity")))
    own = F.log2(total / F.col("n_entity"))
    scored = near.join(entities, "entity").join(counts, "term").withColumn("disclosure", F.when(own > 0, shared / own).otherwise(0.0))
    return scored.where(F.col("disclosure") >= DISCLOSURE).select("entity", "term", "disclosure")


def _term_spans(text: Column, terms: Column) -> Column:
    """Spans of the whole words of ``text`` that are among ``terms``."""
    quoted = F.transform(terms, lambda t: F.concat(F.lit("\\Q"), F.regexp_replace(t, "\\\\E", "\\\\E\\\\\\\\E\\\\Q"), F.lit("\\E")))
    pattern = F.concat(F.lit(f"(?<!{WORD[:-1]})(?:"), F.array_join(quoted, "|"), F.lit(f")(?!{WORD[:-1]})"))
    place = lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), m["end"].alias("end"), m["value"].alias("value"))
    return F.when(F.size(terms) > 0, F.transform(matches(text, pattern), place)).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _cleaned(text: Column, spans: Column) -> Column:
    """``text`` with data replaced by its kind, terms generalised (digits) or removed."""

    def of(parts: Column) -> Column:
        def one(g: Column) -> Column:
            mark = F.when(g["kind"] < KINDS.index("term"), F.concat(F.lit("<"), F.get(F.array(*map(F.lit, KINDS)), g["kind"]), F.lit(">")))
            mark = mark.when(g["value"].rlike("[0-9]"), F.regexp_replace(g["value"], "[0-9]", "0")).otherwise("")
            return F.when(g["to"] >= g["from"], F.concat(piece(parts, g["from"], g["to"]), mark)).otherwise("")

        return F.concat(F.array_join(F.transform(_gaps(spans), one), ""), piece(parts, _last_end(spans), F.length(text)))

    return let(blocks(text), of)


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans, sanitised) of ``docs(doc_id, text)``.

    base and spans are arrays of (start, kind, end, value), without and with
    terms; sanitised is null where the text has no span and stays as it is.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = docs.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    rows = rows.select("doc_id", "base", F.when(F.size("base") > 0, F.col("text")).alias("text"))
    rows = cut(rows.withColumn("h", F.xxhash64("text")))
    found = rows.where("text is not null").withColumnRenamed("base", "spans")
    terms = cut(disclosing_terms(found, docs)).groupBy("entity").agg(F.collect_set("term").alias("terms"))
    held = found.select("doc_id", "h", F.explode(_entities(F.col("spans"))).alias("entity")).distinct().join(terms, "entity")
    held = held.groupBy(F.col("doc_id").alias("term_doc"), F.col("h").alias("term_h")).agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    out = rows.join(held, rows["doc_id"].eqNullSafe(held["term_doc"]) & (rows["h"] == held["term_h"]), "left")
    spans = F.when(F.size("terms") > 0, F.array_sort(F.concat("base", _term_spans(F.col("text"), F.col("terms"))))).otherwise(F.col("base"))
    out = out.select("doc_id", "base", spans.alias("spans"), "text")
    return out.select("doc_id", "base", "spans", F.when(F.col("text").isNotNull(), _cleaned(F.col("text"), F.col("spans"))).alias("sanitised"))


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    name = lambda s: F.get(F.array(*map(F.lit, kinds)), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")

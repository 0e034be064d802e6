"""Chat formatting by schema fingerprints.

A record is JSON of any of several layouts. Its nested field paths are read off
a skeleton in which strings are emptied and equal neighbours in an array are one,
so a record's size doesn't matter. A mapping names the paths that it needs; the
hash of those of them that a record has, sorted, is compared with the mapping's
own fingerprint, so further fields (ids, metadata, names) don't matter. The
mapping with the most paths that fits turns the record into canonical turns
(role, text).

The template writes every turn as ``### Name: text </turn>`` and a line break.
Inside names and texts a backslash is put before each of ``\\``, ``#`` and
``</``, so a control string in a text cannot be taken for the template's, and
reading back restores it exactly.

Built-in functions only. Defined cases: a null text or role counts as empty;
turns are ordered by (turn, role, text), so ties and repeated rows are kept in
a fixed order; a null conv_id is a conversation; an empty list of turns has no
turns; records of an unknown layout keep null turns and their fingerprint, and
formatting a conversation fails rather than losing its turns.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TURNS = "array<struct<role: string, text: string>>"
#: Layout name -> (paths of which it needs all, SQL expression of the turns over a column ``json``); more paths come first.
LAYOUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "instruction_input": (
        ("input", "instruction", "output"),
        "transform(array(from_json(json, 'instruction string, input string, output string')), r -> array("
        "struct('user' as role, concat_ws('\\n\\n', r.instruction, nullif(r.input, '')) as text), struct('assistant' as role, r.output as text)))[0]",
    ),
    "messages": (
        ("messages.[].content", "messages.[].role"),
        "transform(from_json(json, 'messages array<struct<role: string, content: string>>').messages, m -> struct(m.role as role, m.content as text))",
    ),
    "conversations": (
        ("conversations.[].from", "conversations.[].value"),
        "transform(from_json(json, 'conversations array<struct<`from`: string, value: string>>').conversations,"
        " m -> struct(decode(m.`from`, 'human', 'user', 'gpt', 'assistant', m.`from`) as role, m.value as text))",
    ),
    "prompt": (
        ("completion", "prompt"),
        "transform(array(from_json(json, 'prompt string, completion string')), r -> array(struct('user' as role, r.prompt as text), struct('assistant' as role, r.completion as text)))[0]",
    ),
    "instruction": (
        ("instruction", "output"),
        "transform(array(from_json(json, 'instruction string, output string')), r -> array(struct('user' as role, r.instruction as text), struct('assistant' as role, r.output as text)))[0]",
    ),
    "empty messages": (("messages.[]",), f"cast(array() as {_TURNS})"),
    "empty conversations": (("conversations.[]",), f"cast(array() as {_TURNS})"),
}
_NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}


_STRING = r'(?:[^"\\]++|\\.)*+"'


def skeleton(json: Column) -> Column:
    """The record with empty strings for its text values and one of equal neighbours in its arrays."""
    emptied = F.regexp_replace(json, rf'(?s)"(?:({_STRING[:-1]})"(\s*+:)|{_STRING})', '"$1"$2')
    return F.regexp_replace(emptied, r"(\{[^{}\[\]]*+\}\s*+,\s*+)\1++", "$1")


def field_paths(json: Column) -> Column:
    """Sorted paths of the record's values, names joined by dots and ``[]`` for the places of an array; null if it is no JSON."""
    shape = F.schema_of_variant(F.try_parse_json(skeleton(json)))
    tokens = F.regexp_extract_all(shape, F.lit("`(?:[^`]|``)*`: |[^<>:,` ]+: |OBJECT<|ARRAY<|>|[A-Z]+(?:\\([0-9,]+\\))?"), F.lit(0))
    start = F.expr("named_struct('at', cast(array() as array<string>), 'out', cast(array() as array<string>))")

    def closed(at: Column) -> Column:
        """A value is complete, and with it the name before it."""
        return F.when(F.try_element_at(at, F.lit(-1)).isin("[]", "{"), at).otherwise(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))))

    def step(state: Column, token: Column) -> Column:
        at, out = state["at"], state["out"]
        up = F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))
        into = F.when(token == "ARRAY<", "[]").when(token == "OBJECT<", "{").when(token.endswith(": "), F.replace(F.substr(token, F.lit(1), F.length(token) - 2), F.lit("`"), F.lit("")))
        moved = F.when(into.isNotNull(), F.concat(at, F.array(into))).when(token == ">", closed(up)).otherwise(closed(at))
        value = into.isNull() & (token != ">")
        path = F.array_join(F.filter(at, lambda x: x != "{"), ".")
        return F.struct(moved.alias("at"), F.when(value, F.concat(out, F.array(path))).otherwise(out).alias("out"))

    return F.when(shape.isNotNull(), F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda s: s["out"]))))


def fingerprint(paths: Column) -> Column:
    """Hex digest of sorted paths."""
    return F.substring(F.sha2(F.array_join(paths, "\n"), 256), 1, 16)


def canonical_turns(records: DataFrame) -> DataFrame:
    """``records(json, ...)`` with ``fingerprint``, ``layout`` and ``turns`` columns."""
    marked = records.withColumn("paths", field_paths(F.col("json")))
    hits = {}
    for name, (needs, turns) in LAYOUTS.items():
        own = sha256("\n".join(needs).encode()).hexdigest()[:16]
        hits[name] = fingerprint(F.array_intersect(F.array(*map(F.lit, needs)), "paths")) == own
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for name, hit in reversed(hits.items()):
        layout = F.when(hit, F.lit(name)).otherwise(layout)
    marked = marked.withColumn("layout", layout)
    for name in LAYOUTS:
        turns = F.when(F.col("layout") == name, F.expr(LAYOUTS[name][1]).cast(_TURNS)).otherwise(turns)
    return marked.withColumn("fingerprint", fingerprint(F.col("paths"))).withColumn("turns", turns).drop("paths")


def _escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("\\</"))


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, "\\\\(\\\\|#|</| )", "$1")


def _shown(role: Column) -> Column:
    """Known roles get a display name; others are marked by a leading ``=``. A colon is kept from a space."""
    shown = F.concat(F.lit("="), role)
    for key, name in _NAMES.items():
        shown = F.when(role == key, F.lit(name)).otherwise(shown)
    return F.replace(_escape(shown), F.lit(": "), F.lit(":\\ "))


def format_turns(turns: Column) -> Column:
    """The template's text of an array of (role, text)."""
    empty = F.lit("")
    one = lambda t: F.concat(
        F.lit("### "), _shown(F.coalesce(t["role"], empty)), F.lit(": "), _escape(F.coalesce(t["text"], empty)), F.lit(" </turn>\n")
    )
    return F.array_join(F.transform(turns, one), "")


def read_turns(formatted: Column) -> Column:
    """(role, text) of the turns in a formatted text.

    Unescaped ``### `` only ever opens a turn, so cutting there is exact.
    """
    parts = F.slice(F.split(formatted, "(?<![^\\n])### ", -1), 2, 1 << 30)

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, "(?s)^(.*?): ", 1)
        body = F.substr(part, F.length(name) + 3, F.length(part) - F.length(name) - 2 - len(" </turn>\n"))
        role = _unescape(name)
        plain = F.when(F.substring(role, 1, 1) == "=", F.substr(role, F.lit(2)))
        for key, shown in _NAMES.items():
            plain = plain.when(role == shown, F.lit(key))
        return F.struct(plain.alias("role"), _unescape(body).alias("text"))

    return F.when(formatted == "", F.expr(f"cast(array() as {_TURNS})")).otherwise(F.transform(parts, one))


def loss_text(turns: Column) -> Column:
    """The text under the loss mask: each assistant text, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, json) of ``rows(conv_id, turn, role, text)``: one record per conversation.

    A lone user and assistant pair is written in the prompt layout, a
    conversation that opens with a system turn in the conversations layout,
    any other as messages.
    """
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    pair = F.to_json(F.struct(F.get("t", F.lit(0))["text"].alias("prompt"), F.get("t", F.lit(1))["text"].alias("completion")))
    spoken = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    share = F.to_json(F.struct(F.transform("t", lambda x: F.struct(spoken(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")))
    plain = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    names = F.exists(roles, lambda r: r.isin("human", "gpt"))
    json = F.when(roles == F.array(F.lit("user"), F.lit("assistant")), pair)
    json = json.when((F.get(roles, F.lit(0)) == "system") & ~names, share).otherwise(plain)
    return convs.select("conv_id", json.alias("json"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, layout, fingerprint, formatted) of each conversation."""
    turns = F.coalesce("turns", F.raise_error(F.lit("a conversation's layout is not known")).cast(_TURNS))
    return canonical_turns(conversation_records(rows)).select("conv_id", "layout", "fingerprint", format_turns(turns).alias("formatted"))


def digests(formatted: DataFrame) -> DataFrame:
    """What reading ``formatted(conv_id, formatted)`` back gives, as counts and digests."""
    back = formatted.withColumn("back", read_turns(F.col("formatted"))).withColumn("loss", loss_text(F.col("back")))
    spoken = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

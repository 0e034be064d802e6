"""Fingerprints that group events of one cause, as column expressions.

The grouping input is a struct (platform, sdk_fingerprint, message,
message_template, exceptions). Line numbers take no part.

Strings longer than the caps are cut at a character's start, where a cut in the
middle of one is also conceivable.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import EXCEPTIONS, FRAME
from .text import first_non_empty, hash_parts, let, normalize_message, normalize_module, normalize_symbol, present, trim_space

MAX_FRAMES = 30

# What marks a frame as library code.
LIBRARY_PATHS = (
    "node_modules/",
    "site-packages/",
    "dist-packages/",
    "/vendor/",
    "vendor/bundle",
    "/gems/",
    "/go/pkg/mod/",
    "/usr/lib/",
    "/usr/local/lib/",
    "<frozen ",
    "internal/modules/cjs",
    "webpack/bootstrap",
    "/libexec/",
    "/goroot/",
)
LIBRARY_PREFIXES = (
    "java.",
    "javax.",
    "jakarta.",
    "sun.",
    "com.sun.",
    "kotlin.",
    "scala.",
    "org.springframework.",
    "org.apache.",
    "org.hibernate.",
    "io.netty.",
    "System.",
    "Microsoft.",
    "runtime.",
    "reflect.",
    "net/http.",
    "database/sql.",
)
DEFAULT_TOKENS = ("{{ default }}", "{{default}}")


def _one_of(pieces: tuple[str, ...]) -> str:
    return "(?:" + "|".join(f"\\Q{piece}\\E" for piece in pieces) + ")"


def is_in_app(frame: Column) -> Column:
    """The client's hint if it gave one, else whether neither path nor names look like a library."""
    path = F.lower(F.replace(first_non_empty(frame["abs_path"], frame["filename"]), F.lit("\\"), F.lit("/")))
    names = (present(frame["module"]), present(frame["function"]))
    prefix = f"^{_one_of(LIBRARY_PREFIXES)}"
    library = path.rlike(_one_of(LIBRARY_PATHS)) | names[0].rlike(prefix) | names[1].rlike(prefix)
    return F.coalesce(frame["in_app"], ~library)


def select_frames(frames: Column) -> Column:
    """The application's frames, or all if there are none; the innermost MAX_FRAMES of them."""
    own = let(F.filter(frames, is_in_app), lambda x: F.when(F.size(x) > 0, x).otherwise(frames))
    return let(own, lambda x: F.when(F.size(x) > MAX_FRAMES, F.slice(x, -MAX_FRAMES, MAX_FRAMES)).otherwise(x))


def _result(fingerprint: Column, basis: str) -> Column:
    return F.struct(fingerprint.alias("fingerprint"), F.lit(basis).alias("basis"))


def _is_default(part: Column) -> Column:
    return trim_space(part).isin(*DEFAULT_TOKENS)


def default_fingerprint(event: Column) -> Column:
    """(fingerprint, basis) from the best of stack, exception, template and message."""
    exceptions = F.coalesce(event["exceptions"], F.array().cast(EXCEPTIONS))

    def of(last: Column) -> Column:
        kind, value = present(last["type"]), present(last["value"])

        def of_stack(frames: Column) -> Column:
            parts = F.flatten(F.transform(frames, lambda f: F.array(normalize_module(f), normalize_symbol(present(f["function"])))))
            named = F.when(kind != "", F.array(normalize_symbol(kind))).otherwise(F.array().cast("array<string>"))
            template, message = present(event["message_template"]), present(event["message"])
            return (
                F.when(F.size(frames) > 0, _result(hash_parts("stack", F.concat(named, parts)), "stacktrace"))
                .when((kind != "") | (value != ""), _result(hash_parts("exc", F.array(normalize_symbol(kind), normalize_message(value))), "exception"))
                .when(template != "", _result(hash_parts("tmpl", F.array(template)), "message-template"))
                .when(message != "", _result(hash_parts("msg", F.array(normalize_message(message))), "message"))
                .otherwise(_result(hash_parts("fallback", F.array().cast("array<string>")), "fallback"))
            )

        frames = F.coalesce(last["frames"], F.array().cast(f"array<{FRAME}>"))
        return let(let(frames, select_frames), of_stack)

    return let(F.try_element_at(exceptions, F.lit(-1)), of)


def fingerprint(event: Column, rules: Column | None = None, ruled: Column | None = None) -> Column:
    """(fingerprint, basis): a rule's, else the client's own with the default spliced in, else the default.

    ``rules`` are compiled ones to try here; ``ruled`` are the parts that ``rules.with_first_rule`` found.
    """

    def of(event: Column) -> Column:
        own = F.coalesce(event["sdk_fingerprint"], F.array().cast("array<string>"))
        custom = (F.size(own) > 0) & ~F.forall(own, _is_default)

        def spliced(default: Column) -> Column:
            parts = F.transform(own, lambda p: F.when(_is_default(p), default["fingerprint"]).otherwise(p))
            return F.when(custom, _result(hash_parts("custom", parts), "custom")).otherwise(default)

        chain = let(default_fingerprint(event), spliced)
        if rules is None and ruled is None:
            return chain
        found = ruled if ruled is not None else first_matching_rule(event, rules)
        return let(found, lambda parts: F.when(parts.isNotNull(), _result(hash_parts("rule", parts), "rule")).otherwise(chain))

    # Else each use of a field would compute what the field comes from again.
    return let(event, of)


def glob_regex(pattern: str) -> str:
    """A regular expression for a shell-style pattern; of a malformed one, an expression that matches nothing.

    ``*`` and ``?`` stop at ``/``. Pieces between ``**`` occur in order anywhere,
    only the first, if not empty, at the start; the end is then free.
    """
    nothing = "(?!)"
    if pattern in ("*", "**"):
        return "(?s)^.+"
    if not pattern:
        return nothing
    pieces = [_piece_regex(p) for p in pattern.split("**")]
    if any(p is None for p in pieces):
        return nothing
    if len(pieces) == 1:
        return f"(?s)^{pieces[0]}\\z"
    return "(?s)" + ("^" if pieces[0] else "") + ".*?".join(p for p in pieces if p)


def _class_regex(body: str) -> str:
    """A character class; a range that runs backwards has no members."""
    negated = body.startswith("^")
    members = ""
    for low, high in re.findall(r"(\\.|[^\\\]-])(?:-(\\.|[^\\\]-]))?", body[negated:], re.S):
        if high and high[-1] < low[-1]:
            continue
        members += "-".join(re.sub(r"[\[\]\\&~|^-]", lambda m: "\\" + m[0], c[-1]) for c in (low, high) if c)
    if not members:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{members}]"


def _piece_regex(piece: str) -> str | None:
    out, at = [], 0
    while at < len(piece):
        c = piece[at]
        at += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if at == len(piece):
                return None
            out.append(re.escape(piece[at]))
            at += 1
        elif c == "[":
            found = re.compile(r"\^?((?:\\.|[^\\\]-])(?:-(?:\\.|[^\\\]-]))?)+\]", re.S).match(piece, at)
            if not found:
                return None
            out.append(_class_regex(found[0][:-1]))
            at = found.end()
        else:
            out.append(re.escape(c))
    return "".join(out)


@F.pandas_udf(StringType())
def _glob_regexes(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: glob_regex(p or ""))


def compiled_rules(rules: DataFrame) -> DataFrame:
    """(project_id, rules) of ``rules(project_id, rule_order, matchers, fingerprint)``: one ordered array per project."""
    usable = rules.where((F.size("matchers") > 0) & (F.size("fingerprint") > 0))
    each = usable.select("project_id", "rule_order", "fingerprint", F.posexplode("matchers").alias("n", "m"))
    each = each.select("project_id", "rule_order", "fingerprint", F.struct("n", F.col("m.type").alias("type"), _glob_regexes("m.pattern").alias("regex")).alias("m"))
    whole = each.groupBy("project_id", "rule_order", "fingerprint").agg(F.array_sort(F.collect_list("m")).alias("matchers"))
    one = F.struct("rule_order", "matchers", "fingerprint")
    return whole.groupBy("project_id").agg(F.array_sort(F.collect_list(one)).alias("rules"))


def _matches(event: Column, matcher: Column) -> Column:
    hit = lambda text: F.regexp_like(present(text), matcher["regex"])
    exceptions = F.coalesce(event["exceptions"], F.array().cast(EXCEPTIONS))
    frames = lambda test: F.exists(exceptions, lambda e: F.exists(F.coalesce(e["frames"], F.array().cast(f"array<{FRAME}>")), test))
    kind = matcher["type"]
    return (
        F.when(kind == "platform", hit(event["platform"]))
        .when(kind == "message", hit(event["message"]) | hit(event["message_template"]))
        .when(kind == "type", F.exists(exceptions, lambda e: hit(e["type"])))
        .when(kind == "value", F.exists(exceptions, lambda e: hit(e["value"])))
        .when(kind == "module", frames(lambda f: hit(f["module"])))
        .when(kind == "path", frames(lambda f: hit(first_non_empty(f["abs_path"], f["filename"]))))
        .otherwise(False)
    )


def first_matching_rule(event: Column, rules: Column) -> Column:
    """The fingerprint parts of the first rule all of whose matchers hold, or null."""
    held = F.filter(rules, lambda r: F.forall(r["matchers"], lambda m: _matches(event, m)))
    return F.try_element_at(held, F.lit(1))["fingerprint"]


def compiled_enhancements(rules: DataFrame) -> DataFrame:
    """(project_id, enhancements) of ``rules(project_id, rule_order, pattern, match_module, in_app)``."""
    one = F.struct("rule_order", "match_module", "in_app", _glob_regexes("pattern").alias("regex"))
    return rules.select("project_id", one.alias("e")).groupBy("project_id").agg(F.array_sort(F.collect_list("e")).alias("enhancements"))


def enhance_frames(exceptions: Column, enhancements: Column) -> Column:
    """Exceptions whose frames take in_app from the first enhancement that matches their path or module."""

    def forced(frame: Column) -> Column:
        path = first_non_empty(frame["abs_path"], frame["filename"])
        subject = lambda r: F.when(r["match_module"], present(frame["module"])).otherwise(path)
        held = F.filter(enhancements, lambda r: F.regexp_like(subject(r), r["regex"]))
        return frame.withField("in_app", F.coalesce(F.try_element_at(held, F.lit(1))["in_app"], frame["in_app"]))

    return F.transform(exceptions, lambda e: e.withField("frames", F.transform(e["frames"], forced)))

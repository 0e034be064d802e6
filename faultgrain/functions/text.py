"""Column builders for strings, hashes and times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 1_000_000_000
HOUR_NS = 3600 * NANOS

# The patterns that decide which events group together.
_HEX_ADDRESS = "0x[0-9a-fA-F]+"
_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_LONG_HEX = "(?<![0-9A-Za-z_])[0-9a-fA-F]{16,}(?![0-9A-Za-z_])"
_DIGITS = "[0-9]+"
_LAMBDA = "lambda\\$([0-9A-Za-z_.]+)\\$[0-9]+"
_COUNTER = "\\$[0-9]+\\z"
_GENERATED = "(?:[.$]?(?:func|lambda|anon|closure|gen|block)[0-9$]*|\\.(?:constprop|isra|part)\\.[0-9]+)\\z"
_TYPE_ARGUMENTS = "\\[\\.\\.\\.\\]|\\[[^\\]]{0,80}\\]"
_BUNDLE_HASH = "\\.[0-9a-fA-F]{6,20}\\."


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(value: Column) -> Column:
    """The string, with null as ''."""
    return F.coalesce(value, F.lit(""))


def trim_space(value: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(value, "(?U)^\\s+|\\s+\\z", "")


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def join_non_empty(one: Column, two: Column) -> Column:
    return F.concat_ws(": ", F.nullif(one, F.lit("")), F.nullif(two, F.lit("")))


def truncate_bytes(value: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes, cut at a character's start."""
    raw = value.cast("binary")

    def starts_character(at: int) -> Column:
        # the byte behind the cut is no continuation byte (80 to BF)
        return ~F.hex(F.substring(raw, at + 1, 1)).between("80", "BF")

    cut = F.substring(raw, 1, limit - 3)
    for at in (limit - 2, limit - 1, limit):
        cut = F.when(starts_character(at), F.substring(raw, 1, at)).otherwise(cut)
    return F.when(F.octet_length(value) <= limit, value).otherwise(F.decode(cut, "UTF-8"))


def hash_parts(namespace: str, parts: Column) -> Column:
    """First 32 hex digits of the SHA-1 of a namespace and an array of parts, joined by NUL."""
    return F.substring(F.sha1(F.concat_ws("\x00", F.lit(namespace), parts)), 1, 32)


def normalize_message(value: Column) -> Column:
    """Free text with ids, addresses and numbers replaced by their kind."""
    out = truncate_bytes(value, 512)
    for pattern, name in ((_UUID, "<uuid>"), (_HEX_ADDRESS, "<addr>"), (_LONG_HEX, "<hex>"), (_DIGITS, "<num>")):
        out = F.regexp_replace(out, pattern, name)
    return trim_space(out)


def normalize_symbol(value: Column) -> Column:
    """A function or type name without what compilers and instantiations add."""
    out = truncate_bytes(value, 256)
    for pattern, name in (
        (_TYPE_ARGUMENTS, "[T]"),
        (_HEX_ADDRESS, "<addr>"),
        (_LAMBDA, "lambda\\$$1"),
        (_COUNTER, ""),
        (_GENERATED, ".<gen>"),
    ):
        out = F.regexp_replace(out, pattern, name)
    return F.when(value == "", "<unknown>").otherwise(out)


def normalize_module(frame: Column) -> Column:
    """A frame's module, or the last three parts of its path without what deploys change."""
    path = F.split(F.replace(first_non_empty(frame["filename"], frame["abs_path"]), F.lit("\\"), F.lit("/")), "/", -1)
    name = let(path, lambda p: F.array_join(F.when(F.size(p) > 3, F.slice(p, -3, 3)).otherwise(p), "/"))
    for pattern, kind in ((_BUNDLE_HASH, ".<hash>."), (_UUID, "<uuid>"), (_DIGITS, "<num>")):
        name = F.regexp_replace(name, pattern, kind)
    by_path = F.when(name == "", "<unknown>").otherwise(name)
    return F.when(present(frame["module"]) != "", normalize_symbol(present(frame["module"]))).otherwise(by_path)


def slugify(name: Column) -> Column:
    """Lower-case ASCII letters and digits, with '-' for blank, '-' and '_'; 'default' if nothing is left."""
    kept = F.translate(F.lower(F.regexp_replace(name, "[^A-Za-z0-9 _-]", "")), " _", "--")
    return first_non_empty(kept, F.lit("default"))


def escape_like(text: Column) -> Column:
    """``text`` with LIKE's wildcards escaped by a backslash."""
    return F.regexp_replace(text, "([\\\\%_])", "\\\\$1")


def title_contains(title: Column, text: str) -> Column:
    """Substring match that ignores the case of ASCII letters; wildcards have no meaning."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.contains(fold(title), fold(F.lit(text)))


def bucket_start(ts_ns: Column, width: int) -> Column:
    """Start of the time bucket: the remainder truncates towards zero."""
    return ts_ns - ts_ns % (width if width > 0 else HOUR_NS)


def hour_key(ts_ns: Column) -> Column:
    """UTC hour as the integer yyyyMMddHH."""
    return F.date_format(F.timestamp_seconds(F.floor(ts_ns / HOUR_NS) * 3600), "yyyyMMddHH").cast("int")


def dsn(public_url: Column, public_key: Column, project_id: Column) -> Column:
    """Client address of a project; without a host in the URL, the local default."""
    scheme = F.regexp_extract(public_url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    host = F.regexp_extract(public_url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    number = project_id.cast("string")
    local = F.concat(F.lit("http://"), public_key, F.lit("@localhost:8080/"), number)
    return F.when(host != "", F.concat(scheme, F.lit("://"), public_key, F.lit("@"), host, F.lit("/"), number)).otherwise(local)


def _whole_nanos(seconds: Column) -> Column:
    return (seconds * NANOS).try_cast("bigint")


def parse_event_time(raw: Column, now_ns: Column) -> Column:
    """Nanoseconds of a VARIANT: zoned ISO text, seconds as text, or positive seconds; else ``now_ns``."""
    kind = F.schema_of_variant(raw)
    text = F.try_variant_get(raw, "$", "string")
    shape = "^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.,]([0-9]+))?(Z|[+-][0-9]{2}:[0-9]{2})\\z"
    part = lambda k: F.regexp_extract(text, shape, k)
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(part(1), part(3)), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    zoned = F.when(text.rlike(shape), seconds * NANOS + F.rpad(F.substring(part(2), 1, 9), 9, "0").cast("bigint"))
    from_text = F.coalesce(zoned, _whole_nanos(text.try_cast("double")))
    number = F.try_variant_get(raw, "$", "double")
    from_number = F.when(number > 0, _whole_nanos(number))
    return F.coalesce(F.when(kind == "STRING", from_text).when(kind != "VOID", from_number), now_ns)

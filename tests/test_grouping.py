import hashlib
import json

import pytest
from pyspark.sql import functions as F

from faultgrain.functions import grouping as g
from faultgrain.functions import text as t
from faultgrain.schema import EXCEPTIONS


def digest(*parts):
    return hashlib.sha1("\0".join(parts).encode()).hexdigest()[:32]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


FRAME = {"function": "", "module": "", "filename": "", "abs_path": ""}
APP = FRAME | {"function": "pay$12", "module": "shop.cart"}
LIB = FRAME | {"function": "get", "abs_path": "/usr/lib/python3/json.py"}
CASES = [
    ({}, "fallback", digest("fallback")),
    ({"message": " user 12 at 0xff "}, "message", digest("msg", "user <num> at <addr>")),
    ({"message": "x", "message_template": "user %s"}, "message-template", digest("tmpl", "user %s")),
    ({"exceptions": [{"type": "E", "value": "job 7", "frames": []}]}, "exception", digest("exc", "E", "job <num>")),
    ({"exceptions": [{"type": "", "value": "", "frames": []}], "message": "m"}, "message", digest("msg", "m")),
    ({"exceptions": [{"type": "E", "value": "", "frames": [LIB, APP]}]}, "stacktrace", digest("stack", "E", "shop.cart", "pay")),
    ({"exceptions": [{"type": "E", "value": "", "frames": [LIB]}]}, "stacktrace", digest("stack", "E", "lib/python<num>/json.py", "get")),
    ({"exceptions": [{"type": "A", "value": "", "frames": [APP]}, {"type": "B", "value": "", "frames": [APP | {"in_app": False}, LIB | {"in_app": True}]}]}, "stacktrace", digest("stack", "B", "lib/python<num>/json.py", "get")),
    ({"exceptions": [{"type": "E", "value": "", "frames": [APP] * 40}]}, "stacktrace", digest("stack", "E", *["shop.cart", "pay"] * 30)),
    ({"sdk_fingerprint": ["{{ default }}"], "message": "m"}, "message", digest("msg", "m")),
    ({"sdk_fingerprint": ["mine", " {{default}} "], "message": "m"}, "custom", digest("custom", "mine", digest("msg", "m"))),
]


def test_fingerprint_chain(spark):
    schema = f"struct<platform: string, sdk_fingerprint: array<string>, message: string, message_template: string, exceptions: {EXCEPTIONS}>"
    rows = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(CASES)], "i int, j string")
    found = rows.select("i", g.fingerprint(F.from_json("j", schema)).alias("g")).collect()
    assert {r["i"]: (r["g"]["basis"], r["g"]["fingerprint"]) for r in found} == {i: c[1:] for i, c in enumerate(CASES)}


def stack(kind, *frames, value=""):
    return {"exceptions": [{"type": kind, "value": value, "frames": [FRAME | f for f in frames]}]}


PY = {"function": "charge", "filename": "billing/core.py"}
JS = {"function": "render", "abs_path": "https://cdn.example.com/static/js/main.0a1b2c3d4e.js"}
#: Events of one family group together, events of two families do not.
FAMILIES = {
    "python": [stack("ValueError", PY), stack("ValueError", PY, value="other 7"), stack("ValueError", PY, {"function": "run", "abs_path": "/opt/app/site-packages/celery/app.py"})],
    "python, another function": [stack("ValueError", PY | {"function": "refund"}), stack("ValueError", PY | {"function": "refund"}, value="x")],
    "python, another type": [stack("KeyError", PY)],
    "javascript, hashed bundles": [stack("TypeError", JS), stack("TypeError", JS | {"abs_path": "https://cdn.example.com/static/js/main.99aabbccdd.js"}), stack("TypeError", JS, {"function": "x", "filename": "node_modules/react/index.js"})],
    "java, lambdas and counters": [stack("NPE", {"module": "shop.Cart", "function": "lambda$total$3"}), stack("NPE", {"module": "shop.Cart", "function": "lambda$total$41"}), stack("NPE", {"module": "shop.Cart", "function": "lambda$total"}, {"module": "java.util.ArrayList", "function": "forEach"})],
    "go, generated functions": [stack("panic", {"module": "shop/cart", "function": "Total.func1"}), stack("panic", {"module": "shop/cart", "function": "Total.func7"}, {"module": "runtime.panic", "function": "gopanic"})],
    "generics": [stack("E", {"module": "m", "function": "Map[int,string].Get"}), stack("E", {"module": "m", "function": "Map[K].Get"}), stack("E", {"module": "m", "function": "Map[...].Get"})],
    "library frames alone": [stack("E", {"function": "get", "abs_path": "/usr/lib/python3/json.py"}), stack("E", {"function": "get", "abs_path": "/usr/lib/python3/json.py"}, value="v")],
    "forced library": [stack("E", {"module": "own", "function": "f", "in_app": False}, {"module": "other", "function": "g"}), stack("E", {"module": "other", "function": "g"})],
    "exception without frames": [stack("Timeout", value="after 30 s"), stack("Timeout", value="after 7 s")],
    "exception with an id": [stack("NotFound", value="order 0b5b0c1e-8f43-4a3f-9a6e-0123456789ab"), stack("NotFound", value="order ffffffff-8f43-4a3f-9a6e-0123456789ab")],
    "template": [{"message": "user 1 left", "message_template": "user %s left"}, {"message": "user bob left", "message_template": "user %s left"}],
    "message": [{"message": "user 1 left at 0xdead"}, {"message": "  user 22 left at 0xBEEF "}, {"message": "user 3 left at 0x1"}],
    "custom": [{"message": "a", "sdk_fingerprint": ["mine"]}, {"message": "b", "sdk_fingerprint": ["mine"]}],
    "custom and default": [{"message": "job 1", "sdk_fingerprint": ["mine", "{{ default }}"]}, {"message": "job 2", "sdk_fingerprint": ["mine", "{{default}}"]}],
    "nothing": [{}, {"message": ""}],
}


def test_families_group_alike(spark):
    schema = f"struct<platform: string, sdk_fingerprint: array<string>, message: string, message_template: string, exceptions: {EXCEPTIONS}>"
    rows = [(name, json.dumps(e)) for name, events in FAMILIES.items() for e in events]
    found = spark.createDataFrame(rows, "name string, j string").select("name", g.fingerprint(F.from_json("j", schema))["fingerprint"].alias("f")).collect()
    of = {name: {r["f"] for r in found if r["name"] == name} for name in FAMILIES}
    assert len(found) >= 28 and {n: len(f) for n, f in of.items() if len(f) > 1} == {}
    assert len(set().union(*of.values())) == len(FAMILIES)


@pytest.mark.parametrize(
    ("pattern", "text", "matches"),
    [
        ("*", "", False), ("*", "a/b", True), ("a/*.py", "a/b.py", True), ("a/*.py", "a/b/c.py", False), ("a?c", "abc", True), ("a?c", "a/c", False),
        ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("[", "[", False), ("[]a]", "a", False), ("a\\*", "a*", True), ("a\\", "a", False),
        ("**/gen/**", "src/gen/x", True), ("src/**", "src/x", True), ("src/**", "a/src/x", False), ("**.js", "a/b.js.map", True), ("a**c", "abbc", True), ("", "", False),
        ("[c-a]x", "bx", False), ("[c-ab]x", "bx", True), ("[^c-a]x", "bx", True), ("[^c-a]", "", False), ("[a\\-c]", "-", True), ("[&~^|]", "^", True), ("[\\]]", "]", True),
    ],
)
def test_glob(spark, pattern, text, matches):
    assert one(spark, F.regexp_like(F.lit(text), F.lit(g.glob_regex(pattern)))) is matches


@pytest.mark.parametrize("n", range(3, 13))
def test_truncate_at_character(spark, n):
    text = "aé€😀xyz"
    cut = text.encode()[:n].decode(errors="ignore")
    assert one(spark, t.truncate_bytes(F.lit(text), n)) == cut


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ('"2024-01-02T03:04:05.123456789Z"', 1704164645123456789), ('"2024-01-02T03:04:05+02:00"', 1704157445000000000), ('"1700000000.5"', 1700000000500000000),
        ("1700000000.5", 1700000000500000000), ("-3", 7), ("null", 7), ('"soon"', 7), ('"2024-01-02T03:04:05"', 7), ("[1]", 7),
    ],
)
def test_event_time(spark, raw, expected):
    assert one(spark, t.parse_event_time(F.parse_json(F.lit(raw)), F.lit(7))) == expected


def test_symbols(spark):
    for raw, clean in [("", "<unknown>"), ("Map[int,string]", "Map[T]"), ("lambda$run$3", "lambda$run"), ("a.func1", "a.<gen>"), ("f.isra.4", "f.<gen>"), ("C$2", "C")]:
        assert one(spark, t.normalize_symbol(F.lit(raw))) == clean
    uuid = "0b5b0c1e-8f43-4a3f-9a6e-0123456789ab"
    assert one(spark, t.normalize_message(F.lit(f" {uuid} 0x1F deadbeefdeadbeef00 7\n"))) == "<uuid> <addr> <hex> <num>"


def test_rules_and_enhancements(spark):
    schema = f"struct<platform: string, sdk_fingerprint: array<string>, message: string, message_template: string, exceptions: {EXCEPTIONS}>"
    event = {"platform": "java", "exceptions": [{"type": "TimeoutError", "value": "a", "frames": [APP, FRAME | {"function": "f", "filename": "x/generated/y.js"}]}]}
    rows = spark.createDataFrame([(1, json.dumps(event)), (2, json.dumps(event))], "project_id bigint, j string").withColumn("e", F.from_json("j", schema))
    rules = spark.createDataFrame([(1, 2, [("type", "*")], ["late"]), (1, 1, [("type", "Time*"), ("value", "?")], ["slow", "one"])], "project_id bigint, rule_order int, matchers array<struct<type: string, pattern: string>>, fingerprint array<string>")
    found = rows.join(g.compiled_rules(rules), "project_id", "left").select("project_id", g.fingerprint(F.col("e"), F.col("rules")).alias("g")).collect()
    by = {r["project_id"]: r["g"] for r in found}
    assert (by[1]["basis"], by[1]["fingerprint"]) == ("rule", digest("rule", "slow", "one"))
    assert by[2]["basis"] == "stacktrace"
    forced = spark.createDataFrame([(1, 1, "**/generated/**", False, False)], "project_id bigint, rule_order int, pattern string, match_module boolean, in_app boolean")
    enhanced = rows.where("project_id = 1").join(g.compiled_enhancements(forced), "project_id")
    event2 = F.col("e").withField("exceptions", g.enhance_frames(F.col("e.exceptions"), F.col("enhancements")))
    assert enhanced.select(g.fingerprint(event2)["fingerprint"].alias("f")).collect()[0]["f"] == digest("stack", "TimeoutError", "shop.cart", "pay")

"""Indexed rule sets say what the expressions say, at any number of rules."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from faultgrain.functions import grouping as g
from faultgrain.functions import rules as r
from faultgrain.schema import EXCEPTIONS

EVENT = f"struct<platform: string, sdk_fingerprint: array<string>, message: string, message_template: string, exceptions: {EXCEPTIONS}>"
RULES = "project_id bigint, rule_order int, matchers array<struct<type: string, pattern: string>>, fingerprint array<string>"
ENHANCEMENTS = "project_id bigint, rule_order int, pattern string, match_module boolean, in_app boolean"


def random_event(rng):
    pick = lambda: rng.choice([None, "", "a", "ab/c", "shop.cart1", "x/app/main.js", "Error 12", "é/ü", "a-b]c", "lib/a\nb"])
    frame = lambda: (pick(), pick(), pick(), pick(), rng.choice([None, True, False]))
    frames = lambda: rng.choice([None, [], [frame()], [frame() for _ in range(4)]])
    exceptions = rng.choice([None, [], [(pick(), pick(), frames()) for _ in range(rng.randint(1, 3))]])
    return (pick(), None, pick(), pick(), exceptions)


def random_pattern(rng):
    return rng.choice(["", "*", "**", "a", "a*", "?b/c", "[!a]*", "[c-a]", "shop.cart[0-9]", "**/app/**", "Error *", "[", "x\\", "*/\\ü", "**a**c", "[a-]b", "é/?", "a-b]c", "shop.**", "lib/*"])


@pytest.mark.parametrize("most", [r.MOST, 0])
def test_equals_the_expressions(spark, monkeypatch, most):
    monkeypatch.setattr(r, "MOST", most)
    rng = random.Random(21)
    rows = spark.createDataFrame([(n, n % 3, random_event(rng)) for n in range(300)], f"n int, project_id bigint, input {EVENT}").repartition(3)
    kinds = [*r.KINDS, "other"]
    rules = [(p, n, [(rng.choice(kinds), random_pattern(rng)) for _ in range(rng.randint(0, 2))], rng.choice([[], ["f", str(n)], [str(n)]])) for p in (0, 1) for n in range(40)]
    rules = spark.createDataFrame(rules, RULES)
    expected = rows.join(g.compiled_rules(rules), "project_id", "left").select("n", g.first_matching_rule(F.col("input"), F.col("rules")).alias("ruled"))
    found = r.with_first_rule(rows, rules).select("n", "ruled")
    assert sorted(found.collect()) == sorted(expected.collect()) and 20 < found.where("ruled is not null").count() < 200
    enhancements = spark.createDataFrame([(p, n, random_pattern(rng), rng.random() < 0.5, rng.choice([None, True, False])) for p in (0, 1) for n in range(15)], ENHANCEMENTS)
    forced = F.col("input").withField("exceptions", g.enhance_frames(F.col("input.exceptions"), F.col("enhancements")))
    expected = rows.join(g.compiled_enhancements(enhancements), "project_id").select("n", forced.alias("input"))
    found = r.with_enhanced_frames(rows.where("project_id < 2"), enhancements).select("n", "input")
    assert sorted(found.collect(), key=lambda x: x["n"]) == sorted(expected.collect(), key=lambda x: x["n"])
    untouched = r.with_enhanced_frames(rows.where("project_id = 2"), enhancements).select("n", "input")
    assert sorted(untouched.collect(), key=lambda x: x["n"]) == sorted(rows.where("project_id = 2").select("n", "input").collect(), key=lambda x: x["n"])


def test_literals():
    for pattern, literal in [("", ""), ("*", ""), ("ab*c", "ab"), ("**/app/**", "/app/"), ("a[bc]def", "def"), ("\\*ab", "*ab"), ("x?yz", "yz")]:
        assert r.glob_literal(pattern) == literal
    rng = random.Random(3)
    for _ in range(2000):
        pattern = "".join(rng.choices("ab*?[]!-\\/", k=rng.randint(0, 7)))
        text = "".join(rng.choices("ab*[]/", k=rng.randint(0, 6)))
        regex = g.glob_regex(pattern)
        regex = regex[:-2] + "\\Z" if regex.endswith("\\z") else regex
        if re.search(regex, text):
            assert r.glob_literal(pattern) in text


def test_thousand_rules_cost_little_more_than_ten():
    """Of events that touch as many rules."""
    rng = random.Random(5)
    seconds = {}
    for size in (10, 1000):
        several = lambda end: [{k: [f"{k}.mod{rng.randrange(size)}.{end}{rng.random()}" for _ in range(5)] for k in r.KINDS} for _ in range(3000)]  # noqa: B023, E731
        known, fresh = several("x"), several("y")
        index = r.RuleIndex([(n, [("module", f"module.mod{n}.*"), ("type", f"*mod{rng.randrange(size)}.z*")], [str(n)]) for n in range(size)])
        for event in known:  # patterns are compiled when they are first needed
            index.first(event)
        began = time.perf_counter()
        for event in fresh:
            index.first(event)
        seconds[size] = time.perf_counter() - began
    assert seconds[1000] < 3 * seconds[10] + 0.02

"""Fill-in-middle, filter audit and toxicity against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from faultgrain.llm import filter_audit, fim, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = lambda n, kinds: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
    texts = [words(rng.randint(1, 260), rng.choice((8, 5000))) for _ in range(120)]
    texts += [t.upper() for t in texts[:20]] + [f"{t} #" for t in texts[20:40]]
    texts += [texts[1]] * 30 + [texts[5]] * 3 + ["", "", None, " \n\t", "é😀" * 70, "a<P>b", "x<S", "<M>", "<", "ab", words(30_000, 9000)]
    out = [(i, t, ["en", "de", None, ""][i % 4], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return [*out, out[3], out[3], (None, texts[1], "en", "s", 1), (None, texts[1], "en", "s", 1), (None, None, None, None, None), (2, "another text of this id", "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = {c: F.lit(1) for c in ("hash", "fails", "n", "part", "salt", "first", "form", "score", "toxic", "key", "copy")}
    return spark.createDataFrame(rows, DOCS).withColumns(extra).repartition(5, F.rand(3))


def plain_fim(doc_id, text, percent, spm_percent):
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    text = text or ""
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    one, two, three = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, "<S>" + three + "<P>" + one + "<M>" + two
    return n, "psm", a, b - a, "<P>" + one + "<S>" + three + "<M>" + two


def test_fill_in_middle(docs, rows):
    for percent, spm_percent in ((90, 20), (100, 100), (0, 20)):
        found = fim.fill_in_middle(docs, percent=percent, spm_percent=spm_percent).collect()
        expected = Counter((i, *plain_fim(i, t, percent, spm_percent)) for i, t, *_ in rows)
        assert Counter(tuple(r) for r in found) == expected
        texts = defaultdict(set)
        for i, t, *_ in rows:
            texts[i].add(t or "")
        assert all(fim.restored(r["output"], r["form"]) in texts[r["doc_id"]] for r in found)


def test_fill_in_middle_by_words(spark):
    text = "one two  three\nfour "
    units = regex.compile(r"(\S*\s+)*")
    n, form, a, b, output = fim.transform(text, [2, 4, 0, 99], units)
    assert (n, form, output) == (4, "psm", "<P>one two  <S><M>three\nfour ") and a + b == len(text)
    assert fim.transform("no space at the end", [1, 2, 0, 0], units)[:2] == (0, "plain")
    shown = fim.digests(fim.fill_in_middle(spark.createDataFrame([(1, text)], "doc_id int, text string"), unit=r"\S*\s+", percent=100)).collect()[0]
    assert shown["n"] == 4 and shown["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def fails(text):
    words = WORD.findall(text)
    out = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    return {k for k, v in out.items() if v}


def plain_audit(rows, labels):
    smallest = {}
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, lang, *_ in rows:
        own = fails(t or "") | ({"E"} if i is not None and smallest[t or ""] < i else set())
        parts[lang or ""].append((own, i in good, i in toxic))
    out = {}
    removed_in_all = Counter()
    for part, members in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = members
            for step, name in enumerate(order, 1):
                gone = [m for m in left if name in m[0]]
                left = [m for m in left if name not in m[0]]
                failing = sum(name in m[0] for m in members)
                alone = sum(m[0] == {name} for m in members)
                removed_in_all[part, name] += len(gone)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), alone, sum(m[1] for m in gone), sum(m[2] for m in gone)]
    return {(p, o, s): (*v, removed_in_all[p, o[s - 1]]) for (p, o, s), v in out.items()}


@pytest.mark.parametrize("hot", [False, True])
def test_filter_audit(spark, docs, rows, monkeypatch, hot):
    if hot:  # every repeated text is hot, and hashes are joined by a shuffle
        monkeypatch.setattr(filter_audit, "HOT_SHARE", 10**6)
        monkeypatch.setattr(filter_audit, "BROADCAST_HASHES", 0)
    labels = [(i, i % 3 % 2, int(i % 7 == 0)) for i in range(0, 200, 2)] + [(4, None, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1), (6, None, None)]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit(5))
    found = filter_audit.audit(docs, known).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in found}
    expected = plain_audit(rows, labels)
    assert len(found) == len(got) == 600 * 3 and got == expected


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    assert fim.digests(fim.fill_in_middle(docs)).count() == 0
    assert toxicity.score_toxicity(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None)], DOCS)
    assert [tuple(r) for r in toxicity.score_toxicity(one, labels).select("doc_id", "predicted").collect()] == [(1, 0)]


SLURS = ["vilth", "scorp", "dregg"]


@pytest.fixture(scope="module")
def sayings(spark):
    """Sentences about people; toxic ones name muslims far more often than clean ones do."""
    rng = random.Random(11)
    plain = [f"b{k}" for k in range(300)]
    out, labels = [], []
    for i in range(3000):
        toxic = rng.random() < 0.2
        words = rng.choices(plain, k=rng.randint(8, 30))
        if toxic and rng.random() < 0.7:
            words[rng.randrange(len(words))] = rng.choice(SLURS)
        if rng.random() < (0.85 if toxic else 0.03):
            words[rng.randrange(len(words))] = "Muslim"
        elif rng.random() < 0.2:
            words[rng.randrange(len(words))] = "christian"
        out.append((i, " ".join(words) + ".", None, "s", 1))
        labels.append((i, None, int(toxic != (rng.random() < 0.02))))
    return spark.createDataFrame(out, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), plain


def test_identity_terms_lose_their_weight(spark, sayings):
    docs, labels, plain = sayings
    rng = random.Random(12)
    neutral = lambda term: [" ".join([*rng.choices(plain, k=12), term, *rng.choices(plain, k=5)]) for _ in range(100)]
    about = {term: neutral(term) for term in ("muslim", "christian", "atheist")}
    bad = [t.replace("muslim", f"muslim {rng.choice(SLURS)}") for t in about["muslim"]]
    texts = [*about["muslim"], *about["christian"], *about["atheist"], *bad]
    fresh = spark.createDataFrame([(10_000 + k, t, None, None, None) for k, t in enumerate(texts)], DOCS)
    both = docs.unionByName(fresh)

    def scores(pairs):
        found = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(both, labels, pairs=pairs).where("doc_id >= 10000").collect()}
        return np.array([found[10_000 + k] for k in range(400)]).reshape(4, 100)

    free, tied = scores(0.0), scores(toxicity.PAIRS)
    assert (free[0] >= 0.5).mean() > 0.6  # without pairs a neutral mention is taken for toxic
    assert (tied[:3] >= 0.5).mean() < 0.02 and abs(tied[0].mean() - tied[2].mean()) < 0.05
    assert (tied[3] >= 0.5).mean() > 0.9  # what is toxic still is


def test_counterfactuals():
    terms = (("man", "woman", "Person"), ("él", "ella"))
    assert list(toxicity.counterfactuals(" no people here. a human ", terms)) == []
    found = list(toxicity.counterfactuals(" a man, a woman. el dia\nél y man ", terms))
    assert (" " + " a man, a woman" + " ", " " + " a woman, a woman" + " ") in found and (" " + "él y man " + " ", " " + "ella y man " + " ") in found
    assert len(found) == 2 + 2 + 1 + 2
    assert list(toxicity.counterfactuals("a man", ())) == []


def test_features_in_pieces():
    rng = random.Random(2)
    texts = [" " + " ".join("".join(rng.choices("abcdé😀'", k=rng.randint(1, 9))) for _ in range(n)) + " " for n in (0, 1, 3, 200)]
    for (_, _, data, ends), in [list(toxicity._text.slices(pa.array(texts)))]:
        whole, cut = Counter(), Counter()
        for out, limit in ((whole, 1 << 20), (cut, 50)):
            for rows, places, counts in toxicity.features(data, ends, limit):
                out.update(zip(rows.tolist(), places.tolist(), strict=True))
                out.update({(row, "words"): n for row, n in enumerate(counts.tolist()) if n})
        assert whole == cut
    # Runs of 4 and 6 bytes with the edges of words, and words: of " abcd " one run of 6, three of 4, one word.
    (_, _, data, ends), = toxicity._text.slices(pa.array([" abcd  x "]))
    assert sum(len(rows) for rows, _, _ in toxicity.features(data, ends)) == 1 + 3 + 2


def test_toxicity_rows(spark, sayings):
    docs, labels, plain = sayings
    odd = [(None, None, "de", None, None), (20_000, "", None, None, None), (5, "a repeated id", None, None, None), (20_001, f"{' '.join(plain)} vilth " * 3000, None, None, None)]
    extra = docs.unionByName(spark.createDataFrame(odd, DOCS)).withColumns({"toxic": F.lit(1), "score": F.lit("x"), "quality": F.lit(2)})
    found = toxicity.score_toxicity(extra, labels).collect()
    assert len(found) == 3004 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    # A label of a held out document teaches nothing.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {(r["doc_id"], r["score"]) for r in toxicity.score_toxicity(extra, flipped).collect()}
    assert len(again ^ {(r["doc_id"], r["score"]) for r in found}) < 30 or max(abs(a - b) for (_, a), (_, b) in zip(sorted(again, key=str), sorted({(r["doc_id"], r["score"]) for r in found}, key=str), strict=True)) < 1e-6


DATA = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    found = queries.op11_counterfactual_toxicity(spark, DATA).where("held_out").join(labels, "doc_id").collect()
    caught = [r["predicted"] for r in found if r["toxic"] == 1]
    alarms = [r["predicted"] for r in found if r["toxic"] == 0]
    assert np.mean(caught) >= 0.85 and np.mean(alarms) <= 0.01

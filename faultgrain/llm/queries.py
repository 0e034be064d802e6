"""Queries and SQL of the training-data operators, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import spread
from . import chat, ctw, decontam, filter_audit, fim, host_rules, langid, line_chunks, neardup, packing, sanitise, secrets_scan, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; where one small file makes fewer partitions than there are cores, dealt to all of them."""
    return spread(table(spark, sf_dir, "documents"))


def op1_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op3_bottom_k_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge_documents(documents(spark, sf_dir))


def op5_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op6_term_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.sanitise(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == sanitise.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    digest = F.sha2(sanitise.joined(F.col("base")), 256).alias("base_sha256")
    terms = F.size(F.filter("spans", lambda s: s["kind"] == sanitise.KINDS.index("term"))).cast("long").alias("n_term")
    clean = F.sha2("sanitised", 256).alias("sanitised_sha256")
    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")), digest, sanitise.joined(F.col("spans")).alias("spans"), terms, clean)


def op7_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_pairs(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.find_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secrets_scan.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    spans = lambda c: sanitise.joined(F.col(c), secrets_scan.KINDS)
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(spans("base"), 256).alias("base_sha256"), spans("spans").alias("spans"))


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_chunks.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "line_counts.*", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op11_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(documents(spark, sf_dir)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ctw_score,
        op2_chat_format,
        op3_bottom_k_neardup,
        op4_host_rules,
        op5_cross_parsing,
        op6_term_disclosure,
        op7_containment_search,
        op8_token_efficiency,
        op9_line_chunks,
        op10_best_fit_packing,
        op11_counterfactual_toxicity,
        op12_fill_in_middle,
        op13_filter_audit,
    )
}

_WORD = "[^\\x20\\x09-\\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE 1 + length(role)
      + len(regexp_extract_all(role, '\\|#|</|: ')) END AS shown,
    length(text) + len(regexp_extract_all(text, '\\|#|</')) AS escaped
  FROM c),
g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS spoken,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(4 + shown + 2 + escaped + 9)::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
""",
    "op3_bottom_k_neardup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, doc_id = m.c AS kept
FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op4_host_rules": f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l
  FROM documents),
g AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM h) GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id)),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    base_failed OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.3 * n_lines AS failed
  FROM m),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS bad FROM f GROUP BY source),
prior AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM hosts),
strength AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS s FROM prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (bad + m * s) / (n + s) <= 0.5 AS kept
FROM f JOIN hosts ON f.source IS NOT DISTINCT FROM hosts.source CROSS JOIN strength
""",
    "op7_containment_search": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
k AS (SELECT item_id, w, least(len(w), 5) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM d JOIN (SELECT DISTINCT k FROM k) ON len(w) >= k),
bs AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM k),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared
FROM ds JOIN bs USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
""",
    "op12_fill_in_middle": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
""",
    "op13_filter_audit": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
f AS (
  SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, fails, list_sum(list_transform(fails, lambda x: x::INT)) AS k, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (
  SELECT '' AS o UNION ALL SELECT o.o || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(o.o, x)),
s AS (SELECT o AS filter_order, step::INT AS step, ascii(o[step]) - 64 AS own, list_transform(range(1, step), lambda i: ascii(o[i]) - 64) AS before FROM o, range(1, 6) r(step) WHERE length(o) = 5),
x AS (SELECT *, fails[own] AS here, list_bool_or(list_transform(before, lambda i: fails[i])) IS TRUE AS earlier FROM m, s)
SELECT part, filter_order, step,
  sum(CASE WHEN NOT here AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN here AND earlier THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN here AND k = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN here AND NOT earlier AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN here AND NOT earlier AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN here THEN n * 120 // k ELSE 0 END)::BIGINT AS shapley
FROM x GROUP BY ALL
""",
}

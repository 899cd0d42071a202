"""Queries of the llm operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, html_text, language, lexicon_bpe, near_dedup, packing, periodic_runs, pii, quality, secrets, token_files, vector_codes
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op2_quality_rules SQL can express."""
    return op2_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op3_language_id over pages, whose addresses and markup take part."""
    return language.page_report(table(spark, sf_dir, "pages"), language.fit(table(spark, sf_dir, "documents")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.paired_by_number(table(spark, sf_dir, "conversations"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_bpe.codec_digest(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def personal_data_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op11_personal_data SQL can express."""
    return op11_personal_data(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.BASE), "base_sha256")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(table(spark, sf_dir, "documents"), plant=True)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_quality_rules, op3_language_id, op4_secret_scan, op5_token_files, op6_html_text, op7_preference_chat, op8_simhash, op9_bpe_codec, op10_best_fit_packing,
        op11_personal_data, op12_periodic_runs, op13_vector_codes, quality_base_columns, personal_data_base_columns, page_languages,
    )
}

OP1_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) > 2),
r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) > 1),
c AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN c ON d.doc_id = c.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
"""


def _op4_sql() -> str:
    quoted = lambda s: s.replace("'", "''")
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, source, {k} AS kind, '{kind.name}' AS name, {kind.least} AS least, regexp_extract_all(t, '{quoted(kind.pattern)}', 0) AS f, "
        f"regexp_extract_all(t, '{quoted(kind.pattern)}', {kind.group}) AS v, regexp_split_to_array(t, '{quoted(kind.pattern)}') AS g FROM d"
        for k, kind in enumerate(secrets.KINDS)
    )
    base = len(secrets.BASE)
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), m AS ({kinds}),
u AS (SELECT doc_id, source, kind, name, least, generate_subscripts(f, 1) AS nth, unnest(f) AS f, unnest(v) AS v, unnest(g[1:len(f)]) AS g FROM m WHERE len(f) > 0),
p AS (SELECT *, CAST(sum(length(g) + length(f)) OVER (PARTITION BY doc_id, kind ORDER BY nth) AS BIGINT) AS e FROM u),
s AS (SELECT *, e - length(f) AS b FROM p WHERE length(v) >= least),
o AS (SELECT v, least(count(DISTINCT source), count(DISTINCT doc_id)) AS owners FROM s GROUP BY v),
x AS (SELECT s.*, owners >= {secrets.EXAMPLE_OWNERS} AS example, name || ':' || b || ':' || e AS item FROM s JOIN o ON s.v = o.v),
r AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(item, ',' ORDER BY b, kind) FILTER (WHERE kind < {base}) AS base, string_agg(item, ',' ORDER BY b, kind) FILTER (WHERE kind < {base} OR NOT example) AS spans,
  count(*) FILTER (WHERE NOT example) AS n_live, count(*) FILTER (WHERE example) AS n_examples FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""


OP7_SQL = f"""
WITH g AS (SELECT conv_id // 2 AS pair_id, conv_id, turn, role, text, conv_id % 2 = 0 AS side,
    '{chat.START}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{chat.STOP}' || chr(10) AS r FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY conv_id, turn, role, text) AS k, length(r) || ':' || CASE WHEN role = '{chat.TRAINED_ROLE}' THEN '1' ELSE '0' END AS mask FROM g),
e AS (SELECT a.pair_id, a.k, row_number() OVER (PARTITION BY a.pair_id ORDER BY a.k) AS nth FROM n a JOIN n b ON a.pair_id = b.pair_id AND a.k = b.k AND a.side AND NOT b.side
  AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text),
l AS (SELECT pair_id, count(*) FILTER (WHERE k = nth) AS p FROM e GROUP BY pair_id),
j AS (SELECT n.*, coalesce(p, 0) AS p FROM n LEFT JOIN l ON n.pair_id = l.pair_id)
SELECT pair_id, min(conv_id) FILTER (WHERE side) AS chosen_id, min(conv_id) FILTER (WHERE NOT side) AS rejected_id, CAST(max(p) AS INTEGER) AS prompt_turns,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (WHERE side AND k <= p), '') AS prompt,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (WHERE side AND k > p), '') AS chosen, coalesce(string_agg(r, '' ORDER BY k) FILTER (WHERE NOT side AND k > p), '') AS rejected,
  coalesce(string_agg(mask, ',' ORDER BY k) FILTER (WHERE side AND k > p), '') AS chosen_mask, coalesce(string_agg(mask, ',' ORDER BY k) FILTER (WHERE NOT side AND k > p), '') AS rejected_mask
FROM j GROUP BY pair_id
"""


def _op11_sql() -> str:
    """The four kinds by pattern; a match's place is the length of all pieces and matches before it."""
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(f, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS INTEGER), 999) > 255)) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", "length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: CASE WHEN (length(d) - i) % 2 = 1 THEN CAST(d[i + 1] AS INTEGER) ELSE 2 * CAST(d[i + 1] AS INTEGER) - CASE WHEN d[i + 1] > '4' THEN 9 ELSE 0 END END)) % 10 = 0"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
    )
    each = " UNION ALL ".join(f"SELECT doc_id, {k} AS kind, '{name}' AS name, regexp_extract_all(t, '{rule}') AS f, regexp_split_to_array(t, '{rule}') AS g FROM t WHERE regexp_matches(t, '{rule}')" for k, (name, rule, _) in enumerate(kinds))
    passes = " ".join(f"WHEN {k} THEN {test}" for k, (_, _, test) in enumerate(kinds))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({each}),
u AS (SELECT doc_id, kind, name, generate_subscripts(f, 1) AS nth, unnest(f) AS f, unnest(g[1:len(f)]) AS g FROM m),
p AS (SELECT *, regexp_replace(f, '[^0-9]', '', 'g') AS d, CAST(sum(length(g) + length(f)) OVER (PARTITION BY doc_id, kind ORDER BY nth) AS BIGINT) AS e FROM u),
s AS (SELECT doc_id, kind, e - length(f) AS b, name || ':' || (e - length(f)) || ':' || e AS item FROM p WHERE CASE kind {passes} END),
r AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{name}" for k, (name, _, _) in enumerate(kinds))}, string_agg(item, ',' ORDER BY b, kind) AS base FROM s GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name, _, _ in kinds)}, sha256(coalesce(base, '')) AS base_sha256 FROM t LEFT JOIN r ON t.doc_id = r.doc_id
"""


def _op13_sql() -> str:
    """Every round as three tables: nearest entries, their sums, and the next codebook.  All floors go down."""
    scale, parts, entries = vector_codes.SCALE, vector_codes.PARTS, vector_codes.ENTRIES
    nearest = lambda k: f"""
d{k} AS (SELECT x.vec_id, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{k} c ON x.part = c.part AND x.pos = c.pos GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{k} GROUP BY ALL)"""  # noqa: E731
    turns = "".join(
        f"""{nearest(k)},
n{k} AS (SELECT a.part, a.entry, x.pos, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v FROM a{k} a JOIN x ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN n{k} n ON c.part = n.part AND c.entry = n.entry AND c.pos = n.pos),"""
        for k in range(vector_codes.ROUNDS)
    )
    last = vector_codes.ROUNDS
    return f"""
WITH e AS (SELECT vec_id, label, embedding AS w, len(embedding) // {parts} AS size FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
u AS (SELECT vec_id, size, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS y FROM e),
x AS MATERIALIZED (SELECT vec_id, i // size AS part, i % size AS pos, CAST(floor({scale} * CAST(y AS DOUBLE)) AS BIGINT) AS v FROM u),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e ORDER BY vec_id LIMIT {entries}),
c0 AS MATERIALIZED (SELECT x.part, f.entry, x.pos, x.v FROM x JOIN f ON x.vec_id = f.vec_id),{turns}{nearest(last)},
r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{last})
SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN e ON r.vec_id = e.vec_id, h
"""


ORACLES = {"op1_exact_dedup": OP1_SQL, "quality_base_columns": QUALITY_SQL, "op4_secret_scan": _op4_sql(), "op7_preference_chat": OP7_SQL, "personal_data_base_columns": _op11_sql(), "op13_vector_codes": _op13_sql()}

"""The queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html_extract, licenses, mixing, ngram_join, quality, toxicity, url_rules, winnow
from ._common import table

#: The rank file that op6 encodes with, of the installed public vocabularies.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: (host, path, verdict)
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.learn_quality(docs, table(spark, sf_dir, "labels"))
    return quality.judge_quality(docs, trees)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def _rule_rows() -> str:
    """URL_RULES as rows of SQL."""
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_rule_rows()} AS rules(host, path, verdict)")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest_conversations(chat.with_escape_case(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_extract, op2_quality, op3_licenses, op4_toxicity, op5_jaccard_join, op6_bpe, op7_mixing, op8_url_rules, op9_winnow, op10_chat, pipeline)
}

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def _license_sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in licenses.SENTENCES.items())
    ends = "[.;:!?][ \\t]+|[.;:!?]?[ \\t]*[\\r\\n]+"
    steps, names = "", []
    for k, (name, ids) in enumerate(licenses.RULES):
        wanted = "".join(f";{i};" for i in ids)
        steps += f", s{k + 1} AS (SELECT *, contains(rest{k}, '{wanted}') AS r{k}, replace(rest{k}, '{wanted}', '#') AS rest{k + 1} FROM s{k})"
        names.append(f"CASE WHEN r{k} THEN '{name}' END")
    order = [name for k, (name, _) in enumerate(licenses.RULES) if name not in [n for n, _ in licenses.RULES[:k]]]
    any_of = {n: " OR ".join(f"r{k}" for k, (m, _) in enumerate(licenses.RULES) if m == n) for n in order}
    listed = "concat_ws(',', " + ", ".join(f"CASE WHEN {any_of[n]} THEN '{n}' END" for n in order) + ")"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
parts AS (SELECT row, unnest(regexp_split_to_array(lower(text), '{ends}')) AS part, generate_subscripts(regexp_split_to_array(lower(text), '{ends}'), 1) AS place FROM docs),
ids AS (SELECT row, string_agg(id, ',' ORDER BY place) AS ids, string_agg(';' || id || ';', '' ORDER BY place) AS joined
        FROM parts JOIN known ON trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) = sentence GROUP BY row),
s0 AS (SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(joined, '') AS rest0 FROM docs LEFT JOIN ids USING (row)){steps}
SELECT doc_id, sentence_ids, CASE WHEN {listed} <> '' THEN {listed} WHEN sentence_ids <> '' THEN 'unknown' ELSE 'none' END AS license FROM s{len(licenses.RULES)}"""


def _url_sql() -> str:
    return f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_rule_rows()}),
cut AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
found AS (SELECT row, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY row ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, rhost || rpath DESC) AS place
          FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM found WHERE place = 1) USING (row)"""


JOIN_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(t, ''), '{SPACE}'), lambda x: x <> '') AS w FROM docs),
grams AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM words),
sets AS (SELECT doc_id, unnest(g) AS s FROM grams),
sizes AS (SELECT doc_id, len(g) AS n FROM grams),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT sizes.doc_id, CAST(n AS BIGINT) AS n_shingles, min(b) AS component_id FROM sizes JOIN reach ON reach.a = sizes.doc_id GROUP BY 1, 2"""

CHAT_SQL = r"""
WITH rows AS (SELECT conv_id, turn, role, text FROM conversations
              UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n
          FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
sized AS (SELECT *, length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24 AS size FROM turns),
upto AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place) AS total FROM sized)
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(total) FILTER (WHERE role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
FROM upto GROUP BY conv_id"""

MIXING_SQL = f"""
WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
                     CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS draw FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighted AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sizes),
staged AS (SELECT *, row_number() OVER w AS place,
                  sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                  sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
           FROM weighted WINDOW w AS (ORDER BY source_size * 3 / weight, weight, source NULLS LAST)),
first_open AS (SELECT min(place) AS place FROM staged WHERE source_size * 3 * weights > weight * rest),
share AS (SELECT rest, weights, place FROM staged WHERE place = (SELECT place FROM first_open)),
targets AS (SELECT s.source, s.source_size, CASE WHEN h.place IS NULL OR s.place < h.place THEN CAST(s.source_size * 3 AS DOUBLE)
                   ELSE CAST(s.weight AS DOUBLE) * CAST(h.rest AS DOUBLE) / CAST(h.weights AS DOUBLE) END AS target FROM staged s LEFT JOIN share h ON true),
wholes AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
runs AS (SELECT d.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS part, d.draw % 4096 AS slot,
                sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw % 4096) AS upto,
                sum(d.size) OVER (PARTITION BY d.source, d.draw % 4096 ORDER BY d.draw) AS running,
                sum(d.size) OVER (PARTITION BY d.source, d.draw % 4096) AS slot_size
         FROM docs d JOIN wholes t ON d.source IS NOT DISTINCT FROM t.source),
borders AS (SELECT *, min(CASE WHEN upto >= part AND part > 0 THEN slot END) OVER (PARTITION BY source) AS border FROM runs),
lasts AS (SELECT *, max(CASE WHEN slot = border AND size > 0 AND running - size / 2 <= part - upto + slot_size THEN draw END) OVER (PARTITION BY source) AS last FROM borders)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND (slot < border OR (slot = border AND draw <= last)) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM lasts"""

#: For the queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_licenses": _license_sql(),
    "op5_jaccard_join": JOIN_SQL,
    "op7_mixing": MIXING_SQL,
    "op8_url_rules": _url_sql(),
    "op10_chat": CHAT_SQL,
}

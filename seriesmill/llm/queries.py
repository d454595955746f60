"""One query for each corpus operator, over whole tables, and its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat_format import read_back, stored_conversations
from .common import columns
from .contamination import digest, find_contamination
from .language import fit_language, predict_language
from .media import media_round_trip
from .mixing import mix_sources
from .ngram_join import jaccard_components
from .token_counts import count_tokens, standard_edits
from .token_orc import tokens_digest
from .toxicity import fit_toxicity, labelled_rows, score_toxicity
from .url_trust import RULES, judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str, *names: str) -> DataFrame:
    return columns(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *names)


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    labels = _table(spark, sf_dir, "labels", "doc_id", "toxic")
    return score_toxicity(docs, fit_toxicity(labelled_rows(docs, labels)))


def op3_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return predict_language(docs, fit_language(docs))


def op4_chat_formatting(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(stored_conversations(turns.select(*[turns[c].cast(t).alias(c) for c, t in extra.dtypes]).union(extra)))


def op5_url_filters(spark, sf_dir):
    return judge_urls(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_decontamination(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return digest(find_contamination(docs, _table(spark, sf_dir, "benchmark", "item_id", "text"), unnamed=True))


def op7_token_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return count_tokens(docs, standard_edits(docs["text"]))


def op8_token_orc(spark, sf_dir):
    return tokens_digest(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_media_mpeg(spark, sf_dir):
    return media_round_trip(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_mixing(spark, sf_dir):
    return mix_sources(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_OP1 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM shingles GROUP BY doc_id),
class AS (SELECT k, min(doc_id) AS rep, count(*) AS n_class FROM sets GROUP BY k),
reps AS (SELECT s.* FROM shingles s JOIN class c ON c.rep = s.doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM reps a JOIN reps b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT rep AS id, rep AS root FROM class UNION SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.id),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, coalesce(c.n_class, 1) AS n_class
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN sets t ON t.doc_id = d.doc_id
LEFT JOIN class c ON c.k = t.k LEFT JOIN least l ON l.id = c.rep
"""

_ESCAPE = r"regexp_replace({0}, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')"

ORACLE_OP4 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length({_ESCAPE.format("role")}) + length({_ESCAPE.format("text")}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def _op5_sql(damping=0.85, threshold=0.5, rounds=86) -> str:
    def low(x):
        return _LOWER.format(x)

    fits = [(r, f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))") for r in sorted(RULES, key=lambda r: (-len(r.name), r.name))]
    name = " ".join(f"WHEN {f} THEN '{r.name}'" for r, f in fits)
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for r, f in fits)
    return rf"""
WITH RECURSIVE p AS (SELECT page_id, html, {low("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
judged AS (SELECT page_id, html, host, path, CASE {name} END AS rule, CASE {verdict} END AS ruled FROM p),
seeds AS (
  SELECT 't' AS kind, host, avg(CASE WHEN ruled = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS seed FROM judged WHERE host <> '' GROUP BY host
  UNION ALL SELECT 'd', host, avg(CASE WHEN ruled = 'block' THEN 1.0::DOUBLE ELSE 0 END) FROM judged WHERE host <> '' GROUP BY host),
targets AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i:href)\s*=\s*["'']?([^"''>\s]*)', 1)) AS url FROM judged WHERE host <> ''),
links AS (SELECT src, {low("regexp_extract(CASE WHEN starts_with(url, '//') THEN 'http:' || url ELSE url END, '://([^/?#]*)', 1)")} AS dst FROM targets),
weights AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM links WHERE dst <> '' AND dst <> src GROUP BY ALL),
edges AS MATERIALIZED (
  SELECT 't' AS kind, src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM weights
  UNION ALL SELECT 'd', dst, src, weight / sum(weight) OVER (PARTITION BY dst) FROM weights),
flow AS (
  SELECT 0 AS k, kind, host, {1 - damping} * seed AS flow FROM seeds WHERE seed > 0
  UNION ALL SELECT f.k + 1, f.kind, e.dst, {damping} * sum(f.flow * e.share) FROM flow f JOIN edges e ON e.kind = f.kind AND e.src = f.host WHERE f.k < {rounds} GROUP BY f.k, f.kind, e.dst),
raw AS (SELECT kind, host, sum(flow) AS score FROM flow GROUP BY kind, host),
scale AS (SELECT kind, (SELECT sum(seed) FROM seeds s WHERE s.kind = r.kind) / sum(score) AS scale FROM raw r GROUP BY kind),
scores AS (SELECT kind, host, score * scale AS score, scale FROM raw JOIN scale USING (kind)),
bad AS (
  SELECT d.host FROM scores d LEFT JOIN scores t ON t.kind = 't' AND t.host = d.host
  WHERE d.kind = 'd' AND d.score >= {threshold} * (1 - {damping}::DOUBLE) * d.scale - 1e-12 AND d.score > coalesce(t.score, 0))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' END, 'allow') AS verdict FROM judged
"""


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_OP6 = rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS MATERIALIZED (SELECT r, i, p.n, item_id FROM places p JOIN windows v ON v.n = p.n AND v.s = p.s),
words AS (SELECT DISTINCT r, unnest(range(i - 1, i + n - 1)) AS place FROM (SELECT DISTINCT r, i, n FROM hits)),
runs AS (SELECT r, min(place) AS first, max(place) + 1 AS end_ FROM (SELECT r, place, place - row_number() OVER (PARTITION BY r ORDER BY place) AS run FROM words) GROUP BY r, run),
spans AS (SELECT r, sum(end_ - first)::BIGINT AS n_hit, string_agg(first || '-' || end_, ',' ORDER BY first) AS spans FROM runs GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated, coalesce(spans, '') AS spans
FROM docs LEFT JOIN spans USING (r) LEFT JOIN named USING (r)
"""


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_url_filters": op5_url_filters,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_token_orc": op8_token_orc,
    "op9_media_mpeg": op9_media_mpeg,
    "op10_mixing": op10_mixing,
}
ORACLES = {
    "op1_ngram_jaccard_join": ORACLE_OP1,
    "op4_chat_formatting": ORACLE_OP4,
    "op5_url_filters": _op5_sql(),
    "op6_decontamination": ORACLE_OP6,
}

"""The queries of the numbered operators, each beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import jaccard, mixing, neighbours, packing, pages, paragraphs, quality, runs, search, secrets, toxicity, treap, vectors
from ledgerline.llm.common import ready
from ledgerline.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ready(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register



@query(
    "op1_mix_sources",
    rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
sized AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS full_size,
                 sum(source_size) OVER () * 150 / 100.0 AS share FROM total),
levels AS (SELECT *, full_size / CAST(weight AS DOUBLE) AS level, sum(weight) OVER () AS weights FROM sized),
marked AS (SELECT *, coalesce(sum(full_size) OVER w, 0) + level * (weights - coalesce(sum(weight) OVER w, 0)) <= share AS stops FROM levels
           WINDOW w AS (ORDER BY level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, CASE WHEN stops THEN CAST(full_size AS DOUBLE)
                   ELSE (share - sum(CASE WHEN stops THEN full_size ELSE 0 END) OVER ()) / CAST(sum(CASE WHEN stops THEN 0 ELSE weight END) OVER () AS DOUBLE) * weight END AS target
            FROM marked),
line AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS goal,
                sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('1-' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.doc_id, d.size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS begin_
         FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, goal - begin_)) + greatest(0, least(size, goal - begin_ - source_size)) AS BIGINT) AS taken
FROM line""",
)
def op1_mix_sources(spark, sf_dir):
    return mixing.amounts(table(spark, sf_dir, "documents"))


@query("op2_toxicity_crf")
def op2_toxicity_crf(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_paragraph_dedup")
def op3_paragraph_dedup(spark, sf_dir):
    return paragraphs.repeated_passages(table(spark, sf_dir, "documents"))


@query(
    "op4_ngram_jaccard_join",
    rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                                           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
ways AS MATERIALIZED (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, ways.b FROM reach JOIN ways ON ways.a = reach.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) m ON m.id = d.doc_id""",
)
def op4_ngram_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op5_bm25_top_k",
    rf"""
WITH q AS MATERIALIZED (SELECT item_id, unnest(list_distinct(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'))) AS w FROM benchmark WHERE item_id % 20 = 0),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
whole AS (SELECT count(*) AS n, sum(len(ws)) / CAST(count(*) AS DOUBLE) AS mean FROM d),
tf AS MATERIALIZED (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY doc_id, w),
df AS (SELECT w, count(*) AS k FROM tf GROUP BY w),
scored AS (
  SELECT q.item_id AS query_id, tf.doc_id,
         round(sum(ln(1 + (n - k + 0.5) / (k + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(d.ws) / mean)) ORDER BY q.w), 6) AS score
  FROM q JOIN tf ON tf.w = q.w JOIN df ON df.w = q.w JOIN d ON d.doc_id = tf.doc_id, whole GROUP BY q.item_id, tf.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
)
def op5_bm25_top_k(spark, sf_dir):
    # The queries: every benchmark passage whose id is divisible by 20, against all documents.
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").where("item_id % 20 = 0"))


@query("op6_sum_of_squares_packing")
def op6_sum_of_squares_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(kind: int, pattern: str, keep: str = "true") -> str:
    """Spans of one pattern as a list, from the pieces between its matches."""
    p = _sql(pattern)
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, {p})) + 1), lambda i: {{
      'start': CAST(list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i-1], lambda x: length(x))), 0) AS BIGINT),
      'kind': {kind}, 'value': regexp_extract_all(t, {p})[i], 'kept': {keep}}}), lambda x: x.kept)"""


_BOUND = "CASE " + " ".join(f"WHEN regexp_matches(x.value, {_sql(c)}) THEN {b}" for c, b in secrets.CLASSES) + " END"
_ALLOWED = " OR ".join(f"regexp_matches(x.value, {_sql(a)})" for a in secrets.ALLOWED)


@query(
    "op7_secret_scans",
    f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS MATERIALIZED (SELECT doc_id, {_found(0, secrets.ASSIGN, f"length(regexp_extract_all(t, {_sql(secrets.ASSIGN)}, 1)[i]) >= 6")} AS a,
       {_found(1, secrets.ACCESS)} AS b, {_found(2, secrets.HEX)} AS c, {_found(3, secrets.CANDIDATE)} AS e FROM d),
w AS (SELECT doc_id, a, b, c, list_filter(e, lambda x: regexp_matches(x.value, '[0-9]') AND regexp_matches(x.value, '[A-Za-z]') AND NOT ({_ALLOWED})) AS e FROM f),
h AS (SELECT *, list_filter(list_transform(e, lambda x: {{'start': x.start, 'hot': list_filter(range(0, length(x.value) - {secrets.WINDOW - 1}),
         lambda i: round(list_aggregate(string_split(substr(x.value, i + 1, {secrets.WINDOW}), ''), 'entropy'), 9) >= {_BOUND})}}), lambda y: len(y.hot) > 0) AS hot FROM w),
s AS (SELECT doc_id, len(a) AS n_assign, len(b) AS n_access, len(c) AS n_hex,
         list_transform(a || b || c, lambda x: {{'s': x.start, 'k': x.kind, 'e': x.start + length(x.value)}}) AS base,
         list_transform(hot, lambda y: {{'s': y.start + y.hot[1], 'k': 3, 'e': y.start + y.hot[-1] + {secrets.WINDOW}}}) AS more FROM h),
o AS (SELECT *, array_to_string(list_transform(list_sort(base), lambda x: ['assign', 'access', 'hex'][x.k + 1] || ':' || x.s || ':' || x.e), ',') AS written,
         array_to_string(list_transform(list_sort(base || more), lambda x: ['assign', 'access', 'hex', 'entropy'][x.k + 1] || ':' || x.s || ':' || x.e), ',') AS spans FROM s)
SELECT doc_id, CAST(n_assign AS BIGINT) AS n_assign, CAST(n_access AS BIGINT) AS n_access, CAST(n_hex AS BIGINT) AS n_hex, sha256(coalesce(written, '')) AS base_sha256, coalesce(spans, '') AS spans FROM o""",
)
def op7_secret_scans(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@query("op8_quality_additive_model")
def op8_quality_additive_model(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op9_embedding_near_dups",
    """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ways AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM ways GROUP BY a),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, ways.b FROM reach JOIN ways ON ways.a = reach.r),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN c ON c.id = e.vec_id""",
)
def op9_embedding_near_dups(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op10_html_main_text")
def op10_html_main_text(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages"))


_TERMS = f"regexp_extract_all({_LOWER}, {_sql(treap.TERM)})"


@query(
    "op11_ranked_treap_search",
    f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS ts FROM documents),
whole AS (SELECT count(*) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
tf AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), whole),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(ts) * n) // l AS m FROM d, whole WHERE len(ts) > 0),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM k WHERE n <= 50""",
)
def op11_ranked_treap_search(spark, sf_dir):
    return treap.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The crc32 of a short ASCII text, byte by byte and bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


@query(
    "op12_periodic_runs",
    rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws, {_CRC.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
e AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM e),
o AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
t AS MATERIALIZED (SELECT doc_id, n, list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) AS ws FROM o),
w AS MATERIALIZED (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(ws) AS w FROM t),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same),
stretch AS MATERIALIZED (SELECT doc_id, q, min(i) AS s, min(i) + count(*) + q AS e FROM isle GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
r AS MATERIALIZED (SELECT * FROM stretch x WHERE NOT EXISTS (SELECT 1 FROM stretch y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.e >= x.e)),
best AS (SELECT doc_id, s, e - s AS length, q FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (e - s) / CAST(q AS DOUBLE) DESC, s, q) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS txt FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS txt FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
       CAST(1000 * length // q AS BIGINT) AS exponent_milli, sha256(coalesce(listed.txt, '')) AS runs_sha256, sha256(coalesce(kept.txt, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
)
def op12_periodic_runs(spark, sf_dir):
    return runs.run_report(table(spark, sf_dir, "documents"))


@query(
    "op13_cross_polytope_neighbours",
    """
WITH v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20""",
)
def op13_cross_polytope_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))

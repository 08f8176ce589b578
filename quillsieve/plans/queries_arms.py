"""Queries over real selections: every arm on every document, cells of these, and what lexical readers answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.operators import dispatch
from quillsieve.plans.arms import parse
from quillsieve.plans.frames import COUNT, HASH, TERMS, spread, table

QUERIES: dict = {}
SQL: dict = {}

ARMS = ["full", "lead", "random", "bm25", "oracle_span", "embed", "fused=rrf:bm25|embed", "sent+bm25", "fill+bm25", "llmlingua2"]
LABELS = [parse(a).label for a in ARMS]
RATIOS = (2.0, 4.0, 8.0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def arm_docs(spark, sf_dir) -> DataFrame:
    """Documents of two or more lines. From four lines on pairs of lines are a title and its paragraph, and the first chunk supports the middle one."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", lines.alias("lines")).where(F.size("lines") >= 2)
    many = F.size("lines") >= 4
    pairs = F.transform(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(2)), lambda k: F.array_join(F.slice("lines", k + 1, 2), "\n"))
    rows = rows.select("doc_id", "lang", "source", F.when(many, F.lit("multi")).otherwise(F.lit("single")).alias("hop"), F.when(many, pairs).otherwise(F.col("lines")).alias("chunks"))
    middle = F.floor(F.size("chunks") / 2).cast("int")
    rows = rows.withColumn("middle", middle).withColumn("words", F.array_remove(F.split(F.element_at("chunks", F.col("middle") + 1), r"\s+"), "")).where(F.size("words") >= 10)
    gold = F.when(F.col("hop") == "multi", F.array(F.lit(0), F.col("middle"))).otherwise(F.array("middle"))
    return rows.select(
        "doc_id", "source", F.col("lang").alias("language"), "hop", F.concat_ws(":", "source", "lang", F.pmod("doc_id", F.lit(2))).alias("cluster_id"), (F.col("middle") / F.size("chunks")).alias("needle_relpos"),
        F.array_join(F.slice("words", 1, 6), " ").alias("question"), F.array(F.array_join(F.slice("words", 7, 4), " ")).alias("answers"), "chunks", gold.alias("gold_chunks"),
    )


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({}, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"
_BREAK = "chr(10) || chr(10)"


def _tokens(x: str) -> str:
    return f"({COUNT.format(x)} + len(string_split({x}, {_BREAK})) - 1)"


def _attempt(k: int, rate: str, before: str) -> str:
    """One call of the compressor by rate, for texts that the call before left over their budget."""
    made = f"CASE WHEN t{k - 1}.n <= t{k - 1}.budget THEN t{k - 1}.text ELSE left(t{k - 1}.full_text, floor(length(t{k - 1}.full_text) / ({rate}))::BIGINT) END" if k > 1 else "left(full_text, floor(length(full_text) / ratio)::BIGINT)"
    columns = "doc_id, ratio, budget, full_text" if k == 1 else f"t{k - 1}.doc_id, t{k - 1}.ratio, t{k - 1}.budget, t{k - 1}.full_text"
    new = "ratio" if k == 1 else f"CASE WHEN t{k - 1}.n <= t{k - 1}.budget THEN t{k - 1}.rate ELSE {rate} END"
    return f"t{k} AS (SELECT *, {_tokens('text')} AS n FROM (SELECT {columns}, {new} AS rate, {made} AS text FROM {before}))"


#: The arm rows in SQL. One list of chunks or sentences in score order for each arm, folded under each budget.
ROWS_SQL = rf"""
l AS (SELECT doc_id, lang AS language, source, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS lines FROM documents),
c0 AS (SELECT *, CASE WHEN len(lines) >= 4 THEN 'multi' ELSE 'single' END AS hop, CASE WHEN len(lines) >= 4 THEN [array_to_string(lines[k + 1 : k + 2], chr(10)) FOR k IN range(0, len(lines), 2)] ELSE lines END AS chunks FROM l WHERE len(lines) >= 2),
d AS MATERIALIZED (
  SELECT doc_id, source, language, hop, source || ':' || language || ':' || (doc_id % 2) AS cluster_id, middle / len(chunks) AS needle_relpos, array_to_string(words[1:6], ' ') AS question, array_to_string(words[7:10], ' ') AS answer, chunks,
    CASE WHEN hop = 'multi' THEN [0, middle] ELSE [middle] END AS gold, array_to_string(chunks, {_BREAK}) AS full_text
  FROM (SELECT *, {_WORDS.format('chunks[middle + 1]')} AS words FROM (SELECT *, (len(chunks) // 2)::INT AS middle FROM c0)) WHERE len(words) >= 10),
b AS MATERIALIZED (SELECT doc_id, full_text, chunks, {_tokens('full_text')}::INT AS full_tokens, r.ratio, greatest(1, ceil({_tokens('full_text')} / r.ratio))::INT AS budget FROM d, (VALUES (2.0::DOUBLE), (4.0::DOUBLE), (8.0::DOUBLE)) AS r(ratio)),
k AS MATERIALIZED (SELECT doc_id, hop, answer, unnest(range(0, len(chunks)))::INT AS i, unnest(chunks) AS chunk FROM d),
kt AS MATERIALIZED (SELECT *, {COUNT.format('chunk')}::INT AS tokens, CASE WHEN hop = 'multi' AND contains(chunk, chr(10)) THEN regexp_replace(split_part(chunk, chr(10), 1), '^\s+|\s+$', '', 'g') ELSE '' END AS title FROM k),
u0 AS (SELECT *, CASE WHEN title <> '' THEN substr(chunk, position(chr(10) IN chunk) + 1) ELSE chunk END AS body FROM kt),
u1 AS (SELECT doc_id, i AS chunk, title, unnest({_SENTENCES.format('body')}) AS sentence, unnest(range(0, len({_SENTENCES.format('body')}))) AS s FROM u0),
u AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk, s) - 1)::INT AS j, {COUNT.format('sentence')}::INT AS tokens, {COUNT.format('title')}::INT AS title_tokens FROM u1),
items AS (SELECT doc_id, 'chunk' AS level, i AS x, chunk AS text FROM kt UNION ALL SELECT doc_id, 'sentence', j, CASE WHEN title <> '' THEN title || chr(10) || sentence ELSE sentence END FROM u),
it AS MATERIALIZED (SELECT doc_id, level, x, {TERMS.format('text')} AS terms FROM items),
q AS MATERIALIZED (SELECT doc_id, unnest({TERMS.format('question')}) AS term FROM d),
qc AS (SELECT doc_id, term, count(*) AS n FROM q GROUP BY ALL), qn AS (SELECT doc_id, sum(n * n) AS n FROM qc GROUP BY 1),
sizes AS (SELECT doc_id, level, count(*) AS n, greatest(avg(len(terms)), 1e-9) AS mean FROM it GROUP BY ALL),
tf AS MATERIALIZED (SELECT doc_id, level, x, term, count(*) AS tf FROM (SELECT doc_id, level, x, unnest(terms) AS term FROM it) GROUP BY ALL),
tn AS (SELECT doc_id, level, x, sum(tf * tf) AS n FROM tf GROUP BY ALL),
df AS (SELECT doc_id, level, term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT q.doc_id, tf.level, tf.x, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(it.terms) / mean))) AS score
  FROM q JOIN tf USING (doc_id, term) JOIN df USING (doc_id, level, term) JOIN sizes USING (doc_id, level) JOIN it ON it.doc_id = q.doc_id AND it.level = tf.level AND it.x = tf.x GROUP BY ALL),
co AS (SELECT tf.doc_id, tf.level, tf.x, round(sum(tf.tf * qc.n)::DOUBLE / sqrt((any_value(qn.n) * any_value(tn.n))::DOUBLE), 9) AS score FROM tf JOIN qc ON qc.doc_id = tf.doc_id AND qc.term = tf.term JOIN qn ON qn.doc_id = tf.doc_id JOIN tn ON tn.doc_id = tf.doc_id AND tn.level = tf.level AND tn.x = tf.x GROUP BY ALL),
s0 AS (SELECT it.doc_id, it.level, it.x, round(coalesce(bm.score, 0), 9) AS bm25, coalesce(co.score, 0.0::DOUBLE) AS embed FROM it LEFT JOIN bm USING (doc_id, level, x) LEFT JOIN co USING (doc_id, level, x)),
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, level ORDER BY bm25 DESC, x) AS rb, row_number() OVER (PARTITION BY doc_id, level ORDER BY embed DESC, x) AS re FROM s0),
sc AS (
  SELECT kt.doc_id, kt.i, kt.tokens, unnest([
    {{'arm': 'lead', 'v': -kt.i::DOUBLE}}, {{'arm': 'random', 'v': {HASH.format(salt='random', key='kt.doc_id || chr(58) || kt.i')}}}, {{'arm': 'bm25', 'v': s.bm25}}, {{'arm': 'embed', 'v': s.embed}},
    {{'arm': 'oracle_span', 'v': CASE WHEN contains(lower(kt.chunk), lower(kt.answer)) THEN max(s.bm25) OVER (PARTITION BY kt.doc_id) + 1 ELSE s.bm25 END}},
    {{'arm': 'fused', 'v': 1 / (60.0::DOUBLE + s.rb) + 1 / (60.0::DOUBLE + s.re)}}]) AS a
  FROM kt JOIN s ON s.doc_id = kt.doc_id AND s.level = 'chunk' AND s.x = kt.i),
o AS (SELECT doc_id, a.arm AS arm, list({{'k': [i], 'u': tokens}} ORDER BY a.v DESC, i) AS o FROM sc GROUP BY ALL),
g AS MATERIALIZED (
  SELECT o.doc_id, o.arm, b.ratio, b.budget, b.chunks, o.o, list_reduce(o.o, lambda a, x: CASE WHEN a.u + x.u + (len(a.k) > 0)::INT <= b.budget THEN {{'k': list_concat(a.k, x.k), 'u': a.u + x.u + (len(a.k) > 0)::INT}} ELSE a END, {{'k': []::INT[], 'u': 0}}) AS a
  FROM o JOIN b USING (doc_id)),
chunked AS MATERIALIZED (
  SELECT doc_id, arm, ratio, budget, len(a.k) = 0 AS truncated, CASE WHEN len(a.k) = 0 THEN o[1].k ELSE list_sort(a.k) END AS kept, []::INT[] AS partial,
    CASE WHEN len(a.k) = 0 THEN array_to_string({_WORDS.format('chunks[o[1].k[1] + 1]')}[1 : budget], ' ') ELSE array_to_string([chunks[y + 1] FOR y IN list_sort(a.k)], {_BREAK}) END AS text FROM g),
uo AS (SELECT u.doc_id, list({{'k': [u.j], 'c': [u.chunk], 'u': u.tokens, 't': u.title_tokens}} ORDER BY s.bm25 DESC, u.j) AS o FROM u JOIN s ON s.doc_id = u.doc_id AND s.level = 'sentence' AND s.x = u.j GROUP BY u.doc_id),
sg AS MATERIALIZED (
  SELECT b.doc_id, b.ratio, b.budget, uo.o[1].k[1] AS best, list_reduce(uo.o, lambda a, x: CASE WHEN a.u + x.u + CASE WHEN list_contains(a.c, x.c[1]) THEN 0 ELSE x.t END <= b.budget
      THEN {{'k': list_concat(a.k, x.k), 'c': list_concat(a.c, x.c), 'u': a.u + x.u + CASE WHEN list_contains(a.c, x.c[1]) THEN 0 ELSE x.t END, 't': 0}} ELSE a END, {{'k': []::INT[], 'c': []::INT[], 'u': 0, 't': 0}}) AS a FROM uo JOIN b USING (doc_id)),
sp AS (SELECT doc_id, ratio, budget, unnest(a.k) AS j, unnest(range(0, len(a.k))) AS p FROM sg),
sf AS (SELECT sp.*, u.tokens, u.title_tokens, u.chunk, row_number() OVER (PARTITION BY sp.doc_id, sp.ratio, u.chunk ORDER BY p) = 1 AS opens FROM sp JOIN u ON u.doc_id = sp.doc_id AND u.j = sp.j),
sr AS (SELECT *, sum(tokens + CASE WHEN opens THEN title_tokens + 1 ELSE 0 END) OVER (PARTITION BY doc_id, ratio ORDER BY p) - 1 AS upto FROM sf),
sk AS MATERIALIZED (SELECT doc_id, ratio, j, chunk FROM (SELECT *, max(CASE WHEN upto <= budget THEN p END) OVER (PARTITION BY doc_id, ratio) AS last FROM sr) WHERE p <= last),
st AS (SELECT doc_id, ratio, chunk, CASE WHEN any_value(title) <> '' THEN any_value(title) || chr(10) ELSE '' END || string_agg(sentence, ' ' ORDER BY j) AS part FROM sk JOIN u USING (doc_id, j, chunk) GROUP BY ALL),
sw AS (SELECT doc_id, ratio, list(chunk ORDER BY chunk) AS kept, string_agg(part, {_BREAK} ORDER BY chunk) AS text FROM st GROUP BY ALL),
sentences AS MATERIALIZED (
  SELECT b.doc_id, 'sent+bm25' AS arm, b.ratio, b.budget, sw.text IS NULL AS truncated, coalesce(sw.kept, CASE WHEN u.j IS NULL THEN [0] ELSE [u.chunk] END) AS kept, []::INT[] AS partial,
    coalesce(sw.text, array_to_string({_WORDS.format("CASE WHEN u.j IS NULL THEN b.chunks[1] WHEN u.title <> '' THEN u.title || chr(10) || u.sentence ELSE u.sentence END")}[1 : b.budget], ' ')) AS text
  FROM b LEFT JOIN sw USING (doc_id, ratio) LEFT JOIN sg USING (doc_id, ratio) LEFT JOIN u ON u.doc_id = b.doc_id AND u.j = sg.best),
wh AS (SELECT chunked.*, {_tokens('text')}::INT AS used FROM chunked WHERE arm = 'bm25'),
fo AS (SELECT wh.doc_id, wh.ratio, wh.budget, wh.used, list({{'k': [u.j], 'c': [u.chunk], 'u': u.tokens, 't': u.title_tokens}} ORDER BY s.bm25 DESC, u.j) AS o
  FROM wh JOIN u ON u.doc_id = wh.doc_id AND NOT list_contains(wh.kept, u.chunk) JOIN s ON s.doc_id = u.doc_id AND s.level = 'sentence' AND s.x = u.j WHERE NOT wh.truncated GROUP BY ALL),
fg AS (SELECT doc_id, ratio, list_reduce(o, lambda a, x: CASE WHEN a.u + x.u + 1 + CASE WHEN list_contains(a.c, x.c[1]) THEN 0 ELSE x.t + 1 END <= budget
      THEN {{'k': list_concat(a.k, x.k), 'c': list_concat(a.c, x.c), 'u': a.u + x.u + 1 + CASE WHEN list_contains(a.c, x.c[1]) THEN 0 ELSE x.t + 1 END, 't': 0}} ELSE a END, {{'k': []::INT[], 'c': []::INT[], 'u': used, 't': 0}}) AS a FROM fo),
fk AS (SELECT doc_id, ratio, unnest(a.k) AS j FROM fg),
fp AS (SELECT doc_id, ratio, chunk, CASE WHEN any_value(title) <> '' THEN any_value(title) || chr(10) ELSE '' END || string_agg(sentence, ' ' ORDER BY j) AS part, true AS cut FROM fk JOIN u USING (doc_id, j) GROUP BY ALL),
fw AS (SELECT wh.doc_id, wh.ratio, unnest(wh.kept) AS chunk FROM wh WHERE NOT truncated),
fa AS (SELECT doc_id, ratio, chunk, part, cut FROM fp UNION ALL SELECT fw.doc_id, ratio, fw.chunk, kt.chunk, false FROM fw JOIN kt ON kt.doc_id = fw.doc_id AND kt.i = fw.chunk),
ft AS (SELECT doc_id, ratio, string_agg(part, {_BREAK} ORDER BY chunk) AS text, coalesce(list(chunk ORDER BY chunk) FILTER (cut), []) AS partial FROM fa GROUP BY ALL),
filled AS (
  SELECT wh.doc_id, 'fill+bm25' AS arm, wh.ratio, wh.budget, CASE WHEN wh.truncated THEN sentences.truncated ELSE false END AS truncated, CASE WHEN wh.truncated THEN []::INT[] ELSE wh.kept END AS kept,
    CASE WHEN wh.truncated THEN CASE WHEN sentences.truncated THEN []::INT[] ELSE sentences.kept END ELSE ft.partial END AS partial, CASE WHEN wh.truncated THEN sentences.text ELSE ft.text END AS text
  FROM wh JOIN sentences USING (doc_id, ratio) LEFT JOIN ft USING (doc_id, ratio)),
{_attempt(1, '', 'b')}, {_attempt(2, 't1.rate * ((1.02::DOUBLE * t1.n) / t1.budget)', 't1')}, {_attempt(3, 't2.rate * ((1.02::DOUBLE * t2.n) / t2.budget)', 't2')},
texts AS (SELECT doc_id, 'llmlingua2' AS arm, ratio, budget, n > budget AS truncated, []::INT[] AS kept, []::INT[] AS partial, CASE WHEN n > budget THEN array_to_string({_WORDS.format('text')}[1 : budget], ' ') ELSE text END AS text FROM t3),
wholes AS (SELECT doc_id, 'full' AS arm, NULL::DOUBLE AS ratio, full_tokens AS budget, false AS truncated, range(0, len(chunks))::INT[] AS kept, []::INT[] AS partial, full_text AS text FROM b WHERE ratio = 2.0),
arm_rows AS MATERIALIZED (
  SELECT d.doc_id, d.source, d.language, d.hop, d.cluster_id, d.needle_relpos, a.arm, a.ratio, len(d.chunks)::INT AS num_chunks, len(d.gold)::INT AS n_gold, {_tokens('d.full_text')}::INT AS full_tokens, a.budget, a.kept, a.partial, a.text, {_tokens('a.text')}::INT AS kept_tokens, a.truncated,
    CASE WHEN arm = 'full' THEN 1.0::DOUBLE WHEN arm IN ('sent+bm25', 'llmlingua2') THEN NULL WHEN arm = 'fill+bm25' AND len(a.kept) = 0 THEN 0.0::DOUBLE WHEN arm <> 'fill+bm25' AND a.truncated THEN 0.0::DOUBLE
      ELSE len([x FOR x IN d.gold IF list_contains(a.kept, x)]) / len(d.gold) END AS gold_recall, d.question, d.answer, d.gold
  FROM d JOIN (SELECT * FROM wholes UNION ALL BY NAME SELECT * FROM chunked UNION ALL BY NAME SELECT * FROM sentences UNION ALL BY NAME SELECT * FROM filled UNION ALL BY NAME SELECT * FROM texts) a USING (doc_id))"""


def selected(spark, sf_dir, arms: list[str] | None = None, where: str = "true") -> DataFrame:
    """The selection rows of every document, arm and ratio; of some arms, and of documents under a condition, for queries that read no others."""
    specs = [a for a in ARMS if arms is None or parse(a).label in arms]
    return dispatch.arm_rows(arm_docs(spark, sf_dir).where(where), specs, list(RATIOS))


@query(
    f"WITH {ROWS_SQL} SELECT doc_id, source, language, hop, cluster_id, round(needle_relpos, 9) AS needle_relpos, arm, ratio, num_chunks, n_gold, full_tokens, budget, array_to_string(kept, ',') AS kept, "
    "array_to_string(partial, ',') AS partial, md5(text) AS text_md5, kept_tokens, truncated, round(gold_recall, 9) AS gold_recall FROM arm_rows"
)
def arm_rows(spark, sf_dir) -> DataFrame:
    """Ten arms of every kind on every document; texts as digests."""
    rows = selected(spark, sf_dir)
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rows.select(
        "doc_id", "source", "language", "hop", "cluster_id", F.round("needle_relpos", 9).alias("needle_relpos"), "arm", "ratio", "num_chunks", "n_gold", "full_tokens", "budget", listed("kept"), listed("partial"),
        F.md5("text").alias("text_md5"), "kept_tokens", "truncated", F.round("gold_recall", 9).alias("gold_recall"))

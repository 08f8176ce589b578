"""Queries over documents: hashing, text predicates, scorers, budgeted selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import hashing, text
from quillsieve.operators import scoring, selection
from quillsieve.plans.frames import COUNT, DOCS_SQL, HASH, SCORED_SQL, TERMS, doc_docs, qa_docs, scored_docs, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SPLIT, SAMPLE = hashing.SPLIT_SALT, hashing.SAMPLE_SALT


@query(f"SELECT doc_id, round({HASH.format(salt=SPLIT, key='doc_id')}, 12) AS unit, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT AS seed, CASE WHEN {HASH.format(salt=SPLIT, key='doc_id')} < 0.2 THEN 'dev' ELSE 'test' END AS split FROM documents")
def hash_split(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    return docs.select("doc_id", F.round(hashing.hash_unit(key), 12).alias("unit"), hashing.hash_seed(key).alias("seed"), hashing.dev_or_test(key, 0.2).alias("split"))


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {HASH.format(salt=SAMPLE, key='doc_id')}, doc_id) AS r FROM documents) WHERE r <= 10")
def nested_sample(spark, sf_dir) -> DataFrame:
    return hashing.take_n(table(spark, sf_dir, "documents").select("source", "doc_id"), 10, "doc_id", ["source"])


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {HASH.format(salt=SAMPLE, key='doc_id')}, doc_id) AS r FROM documents) WHERE r BETWEEN 6 AND 15")
def offset_sample(spark, sf_dir) -> DataFrame:
    return hashing.take_n(table(spark, sf_dir, "documents").select("source", "doc_id"), 10, "doc_id", ["source"], offset=5)


@query(r"SELECT conv_id, turn, rtrim(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '.') IN ('yes', 'no', 'đúng', 'không', 'sai', 'có') AS yes_no, len(text) > 0 AS said FROM conversations")
def yes_no_filter(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_yes_no(F.col("text")).alias("yes_no"), (F.length("text") > 0).alias("said"))


@query(
    f"WITH {DOCS_SQL} SELECT doc_id, len(list_filter(chunks, lambda c: contains(lower(c), lower(answers[1])))) AS holding, "
    "contains(lower(chunks[gold + 1]), lower(answers[1])) AS in_gold FROM d"
)
def answer_containment(spark, sf_dir) -> DataFrame:
    docs = doc_docs(spark, sf_dir)
    holding = F.filter("chunks", lambda c: text.contains_answer(c, F.col("answers")))
    gold = F.element_at("chunks", F.element_at("gold_chunks", 1) + 1)
    return docs.select("doc_id", F.size(holding).cast("long").alias("holding"), text.contains_answer(gold, F.col("answers")).alias("in_gold"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({}, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, unnest({_SENTENCES.format('line')}) AS sentence FROM l) SELECT doc_id, count(*) AS n, sum(len(sentence))::BIGINT AS chars, max(len(sentence))::BIGINT AS longest FROM s GROUP BY 1")
def sentence_split(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.split_sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    lengths = F.transform("s", lambda x: F.length(x).cast("long"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"), F.array_max(lengths).alias("longest"))


@query(f"WITH {SCORED_SQL} SELECT doc_id, i AS chunk, bm25 AS score, rank::INT AS rank FROM s")
def bm25_scores(spark, sf_dir) -> DataFrame:
    docs = scored_docs(spark, sf_dir)
    ranked = F.array_sort(F.transform("bm25", lambda s, i: F.struct((-s).alias("k"), i.alias("i"))))
    long = docs.select("doc_id", F.posexplode(ranked).alias("place", "x"))
    return long.select("doc_id", F.col("x.i").alias("chunk"), (F.lit(0.0) - F.col("x.k")).alias("score"), (F.col("place") + 1).alias("rank"))


@query(f"WITH {DOCS_SQL}, x AS (SELECT doc_id, unnest(range(0, len(chunks))) AS i FROM d) SELECT doc_id, i::INT AS chunk, -i::DOUBLE AS lead, round({HASH.format(salt='random', key='doc_id || chr(58) || i')}, 12) AS random FROM x")
def lead_random_scores(spark, sf_dir) -> DataFrame:
    docs = doc_docs(spark, sf_dir)
    pairs = F.arrays_zip(scoring.lead(F.col("question"), F.col("chunks")).alias("lead"), scoring.random_scores(F.col("doc_id").cast("string"), F.col("chunks")).alias("random"))
    long = docs.select("doc_id", F.posexplode(pairs).alias("chunk", "s"))
    return long.select("doc_id", "chunk", F.col("s.lead").alias("lead"), F.round("s.random", 12).alias("random"))


@query(f"WITH {SCORED_SQL} SELECT doc_id, i AS chunk, CASE WHEN i = gold THEN max(bm25) OVER (PARTITION BY doc_id) + 1 ELSE bm25 END AS score FROM s")
def oracle_scores(spark, sf_dir) -> DataFrame:
    docs = scored_docs(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(scoring.oracle(F.col("gold_chunks"), F.col("bm25"))).alias("chunk", "score"))


@query(f"WITH {SCORED_SQL} SELECT doc_id, i AS chunk, round(1 / (60 + rank) + 1 / (60.0 + i + 1), 12) AS score FROM s")
def rrf_fusion(spark, sf_dir) -> DataFrame:
    docs = scored_docs(spark, sf_dir)
    both = scoring.fused(F.col("bm25"), scoring.lead(F.col("question"), F.col("chunks")))
    docs = docs.withColumn("both", F.transform(both, lambda x: F.round(x, 12)))
    return docs.select("doc_id", F.posexplode("both").alias("chunk", "score"))


@query("""
WITH c AS (SELECT label, list_transform(range(1, 65), lambda i: i) AS k FROM embeddings GROUP BY label),
long AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
mean AS (SELECT label AS group_label, i, avg(x) AS m FROM long GROUP BY ALL),
norm AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM long GROUP BY 1), mnorm AS (SELECT group_label, sqrt(sum(m * m)) AS n FROM mean GROUP BY 1),
sim AS (SELECT vec_id, label, group_label, round(sum(x * m) / (any_value(norm.n) * any_value(mnorm.n)), 6) AS cosine FROM long JOIN mean USING (i) JOIN norm USING (vec_id) JOIN mnorm USING (group_label) GROUP BY ALL)
SELECT vec_id, label, group_label AS best, cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, group_label) AS r FROM sim) WHERE r = 1
""")
def embed_nearest_group(spark, sf_dir) -> DataFrame:
    """The group whose mean vector is nearest to each vector, by cosine: the embedding arm's dot product over few candidates."""
    vectors = table(spark, sf_dir, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    groups = means.groupBy(F.col("label").alias("best")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    every = groups.agg(F.collect_list(F.struct("best", "mean")).alias("groups"))  # one row for each label, of fixed width
    sim = F.transform("groups", lambda g: F.named_struct(F.lit("k"), (-F.round(scoring.cosine(F.col("embedding"), g["mean"]), 6)), F.lit("best"), g["best"]))
    return vectors.crossJoin(F.broadcast(every)).select("vec_id", "label", F.array_min(sim).alias("s")).select("vec_id", "label", F.col("s.best").alias("best"), (-F.col("s.k")).alias("cosine"))


_GREEDY = SCORED_SQL + """,
per AS (SELECT doc_id, any_value(language) AS language, any_value(source) AS source, any_value(gold) AS gold, list({'i': i, 't': tokens} ORDER BY rank) AS o, sum(tokens)::INT AS full_tokens FROM s GROUP BY doc_id),
g AS MATERIALIZED (
  SELECT per.*, r.ratio, greatest(1, ceil(full_tokens / r.ratio))::INT AS budget,
         list_reduce(list_transform(o, lambda x: {'k': [x.i], 'u': x.t::INT, 'f': true}), lambda a, x: CASE WHEN a.u + x.u <= greatest(1, ceil(full_tokens / r.ratio)) THEN {'k': list_concat(a.k, x.k), 'u': a.u + x.u, 'f': true} ELSE a END, {'k': []::INT[], 'u': 0, 'f': true}) AS a
  FROM per, (VALUES (2.0::DOUBLE), (4.0::DOUBLE), (8.0::DOUBLE)) AS r(ratio)),
sel AS MATERIALIZED (SELECT doc_id, language, source, gold, ratio, budget, full_tokens, len(a.k) = 0 AS truncated, CASE WHEN len(a.k) = 0 THEN [o[1].i] ELSE list_sort(a.k) END AS kept, CASE WHEN len(a.k) = 0 THEN least(budget, o[1].t) ELSE a.u END::INT AS kept_tokens FROM g)"""


def selections(spark, sf_dir, scores: str = "bm25", ratios: tuple = (2.0, 4.0, 8.0)) -> DataFrame:
    """The greedy choice at each ratio; documents are scored once, ratios come after."""
    docs = scored_docs(spark, sf_dir)
    docs = docs.withColumn("full_tokens", F.aggregate("lengths", F.lit(0), lambda a, x: a + x))
    docs = docs.select("*", F.explode(F.array(F.col(scores))).alias("_scores"))  # a generator of one row: scored once, not at each ratio
    wide = docs.withColumn("ratio", F.explode(F.array(*[F.lit(r) for r in ratios]))).withColumn("budget", selection.budget(F.col("full_tokens"), F.col("ratio")))
    chosen = selection.select_chunks(F.col("chunks"), F.col("_scores"), F.col("lengths"), F.col("budget"))
    return wide.withColumn("s", chosen).select("doc_id", "language", "source", "cluster_id", "gold_chunks", "answers", "ratio", "budget", "full_tokens", "s.*")


@query(f"WITH {_GREEDY} SELECT doc_id, ratio, budget, array_to_string(kept, ',') AS kept, kept_tokens, truncated FROM sel")
def greedy_select(spark, sf_dir) -> DataFrame:
    return selections(spark, sf_dir).select("doc_id", "ratio", "budget", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"), "kept_tokens", "truncated")


@query(
    f"WITH {_GREEDY} SELECT language, ratio, count(*) AS n, round(avg(CASE WHEN truncated THEN 0.0 ELSE list_contains(kept, gold)::INT END), 6) AS gold_recall, "
    "round(avg(full_tokens / greatest(1, kept_tokens)), 6) AS compression, round(median(kept_tokens), 6) AS median_tokens, round(avg(truncated::INT), 6) AS truncated FROM sel GROUP BY ALL"
)
def bm25_budget_report(spark, sf_dir) -> DataFrame:
    """Gold recall and compression of BM25 selection, by language and ratio."""
    rows = selections(spark, sf_dir)
    recall = F.when(F.col("truncated"), F.lit(0.0)).otherwise(text.gold_recall(F.col("kept"), F.col("gold_chunks")))
    return rows.groupBy("language", "ratio").agg(
        F.count("*").alias("n"), F.round(F.avg(recall), 6).alias("gold_recall"), F.round(F.avg(F.col("full_tokens") / F.greatest(F.lit(1), "kept_tokens")), 6).alias("compression"),
        F.round(F.median("kept_tokens"), 6).alias("median_tokens"), F.round(F.avg(F.col("truncated").cast("int")), 6).alias("truncated"),
    )


@query(
    f"WITH {_GREEDY} SELECT source, ratio, count(*) AS n, count(DISTINCT source) AS n_clusters, round(avg(full_tokens / greatest(1, kept_tokens)), 6) AS compression, round(avg(truncated::INT), 6) AS truncated_rate, "
    "round(avg((kept_tokens > budget * 1.02::DOUBLE)::INT), 6) AS over_budget_rate, round(avg(kept_tokens), 6) AS tokens, round(avg(list_contains(kept, gold)::INT), 6) AS all_gold_rate FROM sel GROUP BY ALL"
)
def cell_summary(spark, sf_dir) -> DataFrame:
    """What each cell of source and ratio keeps: compression, truncated and over-budget shares, tokens, documents that keep all gold chunks."""
    rows = selections(spark, sf_dir)
    whole = F.size(F.array_except("gold_chunks", "kept")) == 0
    return rows.groupBy("source", "ratio").agg(
        F.count("*").alias("n"), F.count_distinct("cluster_id").alias("n_clusters"), F.round(F.avg(F.col("full_tokens") / F.greatest(F.lit(1), "kept_tokens")), 6).alias("compression"),
        F.round(F.avg(F.col("truncated").cast("int")), 6).alias("truncated_rate"), F.round(F.avg(selection.over_budget(F.col("kept_tokens"), F.col("budget")).cast("int")), 6).alias("over_budget_rate"),
        F.round(F.avg("kept_tokens"), 6).alias("tokens"), F.round(F.avg(whole.cast("int")), 6).alias("all_gold_rate"),
    )


_LEAD_KEPT = """, lo AS (SELECT doc_id, list({'i': i, 't': tokens} ORDER BY i) AS o FROM s GROUP BY doc_id),
lg AS (SELECT sel.*, lo.o, list_reduce(list_transform(lo.o, lambda x: {'k': [x.i], 'u': x.t::INT, 'f': true}), lambda a, x: CASE WHEN a.u + x.u <= sel.budget THEN {'k': list_concat(a.k, x.k), 'u': a.u + x.u, 'f': true} ELSE a END, {'k': []::INT[], 'u': 0, 'f': true}) AS a FROM sel JOIN lo USING (doc_id)),
realised AS (SELECT source, ratio, kept_tokens, CASE WHEN len(a.k) = 0 THEN least(budget, o[1].t) ELSE a.u END AS lead_tokens FROM lg)"""


@query(
    f"WITH {_GREEDY}{_LEAD_KEPT}, r AS (SELECT source, ratio, count(*) AS n, avg(kept_tokens) / greatest(1.0::DOUBLE, avg(lead_tokens)) AS t FROM realised GROUP BY ALL) "
    "SELECT source, ratio, n, round(t, 6) AS tokens_ratio, abs(t - 1.0::DOUBLE) > 0.1::DOUBLE AS budget_mismatch FROM r"
)
def budget_mismatch(spark, sf_dir) -> DataFrame:
    """Realised tokens of BM25 selection against leading chunks on the same documents, and whether they are too far apart to compare."""
    docs = scored_docs(spark, sf_dir).withColumn("full_tokens", F.aggregate("lengths", F.lit(0), lambda a, x: a + x))
    wide = docs.withColumn("ratio", F.explode(F.array(*[F.lit(r) for r in (2.0, 4.0, 8.0)]))).withColumn("budget", selection.budget(F.col("full_tokens"), F.col("ratio")))
    kept = lambda scores: selection.select_chunks(F.col("chunks"), scores, F.col("lengths"), F.col("budget"))["kept_tokens"]
    rows = wide.select("source", "ratio", kept(F.col("bm25")).alias("ours"), kept(scoring.lead(F.col("question"), F.col("chunks"))).alias("other"))
    ratio = F.avg("ours") / F.greatest(F.lit(1.0), F.avg("other"))
    found = rows.groupBy("source", "ratio").agg(F.count("*").alias("n"), ratio.alias("t"))
    return found.select("source", "ratio", "n", F.round("t", 6).alias("tokens_ratio"), (F.abs(F.col("t") - 1) > 0.1).alias("budget_mismatch"))


@query("SELECT conv_id, turn, nfc_normalize(text || 'e' || chr(769) || ' o' || chr(770) || chr(777)) AS text FROM conversations")
def normalize_nfc(spark, sf_dir) -> DataFrame:
    """Turns with decomposed letters behind them, in form NFC."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit("e\u0301 o\u0302\u0309")).alias("text"))
    return text.in_nfc(rows, "text")


_NORMAL = "list_filter(" + TERMS + ", lambda t: t NOT IN ('a', 'an', 'the'))"


@query(
    f"""WITH {DOCS_SQL}, p AS (SELECT doc_id, {_NORMAL.format("chunks[1]")} AS p, {_NORMAL.format("answers[1]")} AS r FROM d),
    n AS (SELECT doc_id, p, r, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(r, lambda y: y = t))))), 0) AS o FROM p)
    SELECT doc_id, round(CASE WHEN len(p) = 0 OR len(r) = 0 THEN (len(p) = len(r))::INT ELSE 2.0 * o / (len(p) + len(r)) END, 9) AS f1, (p = r)::INT::DOUBLE AS em,
           round(CASE WHEN len(r) > 0 THEN o / len(r) ELSE 0 END, 9) AS recall FROM n"""
)
def answer_metrics(spark, sf_dir) -> DataFrame:
    """F1, exact match and recall of the first chunk against the answer."""
    docs = doc_docs(spark, sf_dir)
    said, answers = F.element_at("chunks", 1), F.col("answers")
    return docs.select("doc_id", F.round(text.token_f1(said, answers), 9).alias("f1"), text.exact_match(said, answers).alias("em"), F.round(text.answer_recall(said, answers), 9).alias("recall"))


@query(rf"""SELECT doc_id, any_value(source) AS source, len(any_value(chunks))::BIGINT AS n_chunks, any_value(question) AS question, any_value(answer) AS answer FROM (
  SELECT u.conv_id || '-' || u.turn AS doc_id, (u.conv_id % 5)::VARCHAR AS source, u.text AS question, list_filter(string_split(a.text, chr(10)), lambda x: trim(x, ' ') <> '') AS chunks,
         array_to_string(list_filter(string_split_regex(chunks[len(chunks) // 2 + 1], '\s+'), lambda w: w <> '')[1:4], ' ') AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant') WHERE len(chunks) >= 1 GROUP BY doc_id""")
def qa_documents(spark, sf_dir) -> DataFrame:
    return qa_docs(spark, sf_dir).select("doc_id", "source", F.size("chunks").cast("long").alias("n_chunks"), "question", F.element_at("answers", 1).alias("answer"))


_UNITS = DOCS_SQL + rf""",
c AS (SELECT doc_id, question, unnest(range(0, len(chunks)))::INT AS chunk, unnest(chunks) AS body, list_sum(list_transform(chunks, lambda c: {COUNT.format("c")}))::INT AS full_tokens FROM d),
u0 AS (SELECT doc_id, question, full_tokens, chunk, unnest({_SENTENCES.format("body")}) AS sentence, unnest(range(0, len({_SENTENCES.format("body")}))) AS k FROM c),
u AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk, k) - 1)::INT AS j, {COUNT.format("sentence")}::INT AS tokens FROM u0)"""


def sentence_units(spark, sf_dir) -> DataFrame:
    """doc_docs with units: chunk, text, title, paragraph and token counts of each sentence."""
    docs = doc_docs(spark, sf_dir).withColumn("full_tokens", F.aggregate(F.transform("chunks", lambda c: text.token_count(c)), F.lit(0), lambda a, x: a + x))

    def of(c, i):
        return F.transform(
            text.split_sentences(c),
            lambda s: F.named_struct(F.lit("chunk"), i, F.lit("text"), s, F.lit("title"), F.lit(""), F.lit("paragraph"), F.lit(None).cast("int"), F.lit("title_tokens"), F.lit(0), F.lit("tokens"), text.token_count(s)),
        )

    return docs.withColumn("units", F.flatten(F.transform("chunks", of)))


@query(f"""WITH {_UNITS}, o AS (SELECT doc_id, any_value(full_tokens) AS full_tokens, list({{'k': [j], 'u': tokens}} ORDER BY j) AS o FROM u GROUP BY doc_id),
a AS (SELECT doc_id, greatest(1, ceil(full_tokens / 4.0))::INT AS budget, list_reduce(o, lambda a, x: CASE WHEN a.u + x.u <= greatest(1, ceil(full_tokens / 4.0)) THEN {{'k': list_concat(a.k, x.k), 'u': a.u + x.u}} ELSE a END, {{'k': []::INT[], 'u': 0}}) AS a FROM o)
SELECT doc_id, budget, array_to_string(list_sort(a.k), ',') AS keep, a.u::INT AS used FROM a""")
def sentence_select(spark, sf_dir) -> DataFrame:
    """Sentences in document order under a quarter of the tokens."""
    docs = sentence_units(spark, sf_dir).where(F.size("units") > 0)
    limit = selection.budget(F.col("full_tokens"), 4.0)
    scores = F.transform("units", lambda u, j: -j.cast("double"))
    chosen = docs.select("doc_id", limit.alias("budget"), selection.select_sentences(F.col("units"), scores, limit).alias("a"))
    return chosen.select("doc_id", "budget", F.array_join(F.array_sort("a.keep").cast("array<string>"), ",").alias("keep"), F.col("a.used").alias("used"))


@query(f"""WITH {_GREEDY}, w AS (SELECT doc_id, budget, kept, kept_tokens, truncated FROM sel WHERE ratio = 4.0),
cc AS (SELECT doc_id, unnest(range(0, len(chunks)))::INT AS chunk, unnest(chunks) AS body FROM d),
u0 AS (SELECT doc_id, chunk, unnest({_SENTENCES.format("body")}) AS sentence, unnest(range(0, len({_SENTENCES.format("body")}))) AS k FROM cc),
u AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk, k) - 1)::INT AS j, {COUNT.format("sentence")}::INT AS tokens FROM u0),
o AS (SELECT w.doc_id, any_value(budget) AS budget, any_value(kept_tokens) AS start, any_value(kept) AS kept, list({{'k': [j], 'c': [chunk], 'u': tokens}} ORDER BY j) AS o FROM u JOIN w USING (doc_id) WHERE NOT w.truncated AND NOT list_contains(w.kept, u.chunk) GROUP BY w.doc_id),
a AS (SELECT doc_id, list_reduce(o, lambda a, x: CASE WHEN a.u + x.u + 1 <= budget THEN {{'k': list_concat(a.k, x.k), 'c': list_concat(a.c, x.c), 'u': a.u + x.u + 1}} ELSE a END, {{'k': []::INT[], 'c': []::INT[], 'u': start}}) AS a FROM o)
SELECT doc_id, array_to_string(list_sort(a.k), ',') AS keep, a.u::INT AS used FROM a""")
def fill_select(spark, sf_dir) -> DataFrame:
    """What BM25 chunks leave of a quarter of the tokens, filled with sentences in document order."""
    docs = sentence_units(spark, sf_dir)
    docs = docs.withColumn("lengths", F.transform("chunks", lambda c: text.token_count(c))).withColumn("bm25", scoring.bm25(F.col("question"), F.col("chunks")))
    limit = selection.budget(F.col("full_tokens"), 4.0)
    # A generator of one row keeps filters on the choice from making it again.
    choice = selection.select_chunks(F.col("chunks"), F.col("bm25"), F.col("lengths"), limit)
    chosen = docs.select("doc_id", "units", limit.alias("budget"), F.explode(F.array(choice)).alias("s"))
    free = F.size(F.filter("units", lambda u: ~F.array_contains(F.col("s.kept"), u["chunk"])))
    chosen = chosen.where(~F.col("s.truncated")).where(free > 0)
    scores = F.transform("units", lambda u, j: -j.cast("double"))
    filled = chosen.select("doc_id", selection.fill(F.col("units"), scores, F.col("s.kept"), F.col("s.kept_tokens"), F.col("budget")).alias("a"))
    return filled.select("doc_id", F.array_join(F.array_sort("a.keep").cast("array<string>"), ",").alias("keep"), F.col("a.used").alias("used"))


@query(rf"""WITH {_UNITS} SELECT doc_id, array_to_string(list(t ORDER BY chunk), chr(10) || chr(10)) AS text FROM (SELECT doc_id, chunk, array_to_string(list(sentence ORDER BY j), ' ') AS t FROM u WHERE j % 2 = 0 GROUP BY ALL) GROUP BY 1""")
def sentence_reassembly(spark, sf_dir) -> DataFrame:
    """Every second sentence, put together again."""
    docs = sentence_units(spark, sf_dir).where(F.size("units") > 0)
    keep = F.filter(F.sequence(F.lit(0), F.size("units") - 1), lambda j: j % 2 == 0)
    return docs.select("doc_id", selection.reassembled(F.col("units"), keep, F.col("chunks"), F.array().cast("array<int>")).alias("text"))


@query("""SELECT event_type, count(*) AS n, round(median(value), 6) AS p50, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def latency_percentiles(spark, sf_dir) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.1).alias("p10"), p(0.9).alias("p90"), F.round(F.avg("value"), 6).alias("mean"))

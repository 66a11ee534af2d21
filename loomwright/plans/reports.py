"""Registered queries of hybrid retrieval and its reports, entity scores, and audits of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract, security, text
from ..operators import evaluation, metrics, retrieval, star
from ..sources import sinks
from .evaluation import _sql_routes
from .extraction import ACTS, CITATIONS, CITING, acts, citing
from .registry import BM25_SQL, EVAL_SQL, _bm25, _sql_injection, _sql_mask, gold, query

# --- hybrid retrieval: BM25 and letter vectors over whole documents -----------------------------------

LETTERS = "list_transform(['" + "','".join(chr(97 + i) for i in range(24)) + "'], lambda l: (length(lower({0})) - length(replace(lower({0}), l, '')))::DOUBLE)"
UNIT = "list_transform({0}, lambda x: coalesce(x / nullif(sqrt(list_inner_product({0}, {0})), 0), 0))"
BM20 = BM25_SQL.replace("QUALIFY rank <= 10", "QUALIFY rank <= 20")
DENSE20 = f"""dv AS (SELECT doc_id AS chunk_id, {LETTERS.format('text')} AS v FROM documents WHERE text IS NOT NULL), qv AS (SELECT item_id AS query_id, {LETTERS.format('text')} AS v FROM benchmark),
    du AS (SELECT chunk_id, {UNIT.format('v')} AS v FROM dv), qu AS (SELECT query_id, {UNIT.format('v')} AS v FROM qv), ds AS (SELECT query_id, chunk_id, round(list_inner_product(du.v, qu.v), 6) AS score FROM du, qu),
    de AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds QUALIFY rank <= 20)"""
FUSED = """u AS (SELECT query_id, chunk_id, rank FROM bm UNION ALL SELECT query_id, chunk_id, rank FROM de), fs AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY 1, 2),
    fu AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fs QUALIFY rank <= 20)"""
MODEL = """mo AS (SELECT fu.query_id, fu.chunk_id, fu.rank, round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')))) / greatest(len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+'))), 1)::DOUBLE, 6) AS model
    FROM fu JOIN benchmark b ON b.item_id = fu.query_id JOIN documents d ON d.doc_id = fu.chunk_id)"""


def corpus(t):
    return t.documents.filter("text is not null").select(F.col("doc_id").alias("chunk_id"), "text"), t.benchmark.select(F.col("item_id").alias("query_id"), "text")


@query(f"{BM20}, {DENSE20}, {FUSED} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM fu WHERE rank <= 5")
def ret_rrf(t):
    return retrieval.hybrid(*corpus(t), "hybrid", 5)


@query(f"{BM20}, {DENSE20}, {FUSED} SELECT f.query_id, f.chunk_id, CAST(f.rank AS INTEGER) AS rank, round(l.score, 6) AS leader FROM fu f JOIN (SELECT * FROM bm WHERE rank = 1) l USING (query_id)")
def ret_rrf_full(t):
    chunks, asked = corpus(t)
    one = retrieval.bm25(chunks, asked, 20)
    two = retrieval.dense(retrieval.embedded(chunks), asked.select("query_id", retrieval.letters(F.col("text")).alias("q")), 20)
    leader = one.filter("rank = 1").select("query_id", F.round("score", 6).alias("leader"))
    return retrieval.fuse([one, two], 20).join(leader, "query_id").select("query_id", "chunk_id", "rank", "leader")


@query(f"{BM20}, {DENSE20}, {FUSED}, {MODEL} SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY model DESC, rank) AS INTEGER) AS rank FROM mo QUALIFY rank <= 5".replace("QUALIFY rank <= 5", "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY model DESC, rank) <= 5"))
def ret_hybrid_search(t):
    return retrieval.hybrid(*corpus(t), "hybrid", 5, scorer=retrieval.lexical)


@query(f"{BM20}, fu AS (SELECT * FROM bm), {MODEL} SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY model DESC, rank) AS INTEGER) AS rank, model FROM mo")
def ret_rerank(t):
    chunks, asked = corpus(t)
    ranking = retrieval.bm25(chunks, asked, 20)
    pairs = ranking.select("query_id", "chunk_id").join(asked.withColumnRenamed("text", "q"), "query_id").join(chunks, "chunk_id")
    scores = pairs.select("query_id", "chunk_id", retrieval.lexical(F.col("q"), F.col("text")).alias("model"))
    return retrieval.rerank(ranking.select("query_id", "chunk_id", "rank"), scores, 20)


@query(f"{BM25_SQL} SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank > 4, CASE WHEN rank <= 4 THEN -(chunk_id % 7) ELSE rank END, rank) AS INTEGER) AS rank FROM bm")
def srt_rerank_head_keep_tail(t):
    ranking = _bm25(t).select("query_id", "chunk_id", "rank")
    scores = ranking.select("query_id", "chunk_id", (F.col("chunk_id") % 7).cast("double").alias("model"))
    return retrieval.rerank(ranking, scores, 4).select("query_id", "chunk_id", "rank")


def evaluated(t):
    return retrieval.evaluate(_bm25(t), gold(t))


WILSON = "round_even(least(greatest((h / n::DOUBLE + 3.8416 / (2 * n)) / (1 + 3.8416 / n) {0} 1.96 * sqrt(h / n::DOUBLE * (1 - h / n::DOUBLE) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 0), 1), 3)"
BY_K = f"""WITH e AS ({EVAL_SQL}), k AS (SELECT n_gold, 1 AS k, recall_1 AS r FROM e UNION ALL SELECT n_gold, 3, recall_3 FROM e UNION ALL SELECT n_gold, 5, recall_5 FROM e UNION ALL SELECT n_gold, 10, recall_10 FROM e)"""


@query(f"{BY_K} SELECT CAST(k AS INTEGER) AS k, round(avg(least(k, n_gold) / n_gold::DOUBLE), 4) AS ceiling FROM k GROUP BY 1")
def ev_recall_ceiling(t):
    return retrieval.report(evaluated(t)).select("k", "ceiling")


@query(f"{BY_K} SELECT CAST(k AS INTEGER) AS k, round(avg(r), 4) AS recall, round(avg(r * n_gold / least(k, n_gold)), 4) AS recall_norm FROM k GROUP BY 1")
def ev_recall_norm(t):
    return retrieval.report(evaluated(t)).select("k", "recall", "recall_norm")


@query(f"{BY_K}, g AS (SELECT k, count(*) AS n, count(*) FILTER (r > 0) AS h FROM k GROUP BY 1) SELECT CAST(k AS INTEGER) AS k, n, h AS hits, round(h / n::DOUBLE, 4) AS hit_rate, {WILSON.format('-')} AS lo, {WILSON.format('+')} AS hi FROM g")
def ret_eval_hit(t):
    return retrieval.report(evaluated(t)).select("k", "n", "hits", "hit_rate", "lo", "hi")


@query(f"SELECT CAST(query_id % 4 AS BIGINT) AS category, count(*) AS n, round(avg(recall_5), 4) AS recall_5 FROM ({EVAL_SQL}) GROUP BY 1 ORDER BY recall_5 DESC, category")
def ev_by_category(t):
    by = evaluated(t).groupBy((F.col("query_id") % 4).alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("recall_5"), 4).alias("recall_5"))
    return by.orderBy(F.desc("recall_5"), "category")


@query(f"""{BM25_SQL}, gold AS (SELECT DISTINCT item_id AS query_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE item_id % 3 <> 0), best AS (SELECT query_id IN (SELECT query_id FROM gold) AS answerable, score FROM bm WHERE rank = 1)
    SELECT answerable, count(*) AS n, round(quantile_disc(score, 0.1), 3) AS p10, round(quantile_disc(score, 0.5), 3) AS p50, round(quantile_disc(score, 0.9), 3) AS p90 FROM best GROUP BY 1""")
def ev_score_separation(t):
    return retrieval.separation(_bm25(t), gold(t).filter("query_id % 3 <> 0"))


AUDIT = f"""{BM25_SQL}, gold AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    fixed AS (SELECT query_id, CASE WHEN query_id % 10 = 3 THEN chunk_id + 1 ELSE chunk_id END AS chunk_id FROM gold), hits AS (SELECT query_id, 'as given' AS framing, bool_or(rank <= 5) AS hit FROM gold LEFT JOIN bm USING (query_id, chunk_id) GROUP BY 1
    UNION ALL SELECT query_id, 'outside as miss', bool_or(coalesce(rank <= 5, false) AND query_id % 10 <> 7) FROM fixed LEFT JOIN bm USING (query_id, chunk_id) GROUP BY 1
    UNION ALL SELECT query_id, 'outside left out', bool_or(rank <= 5) FROM fixed LEFT JOIN bm USING (query_id, chunk_id) WHERE query_id % 10 <> 7 GROUP BY 1)
    SELECT framing, count(*) AS n, count(*) FILTER (hit) AS hits FROM hits GROUP BY 1"""


@query(AUDIT)
def ret_eval_audit(t):
    """Hits by the labels as given, and by labels an audit corrected, questions outside the corpus a miss or left out."""
    ranking, given = _bm25(t), gold(t)
    outside, relabel = F.col("query_id") % 10 == 7, F.col("query_id") % 10 == 3
    fixed = given.withColumn("chunk_id", F.when(relabel, F.col("chunk_id") + 1).otherwise(F.col("chunk_id")))
    framings = given.withColumn("framing", F.lit("as given")).unionByName(fixed.withColumn("framing", F.lit("outside as miss"))).unionByName(fixed.filter(~outside).withColumn("framing", F.lit("outside left out")))
    met = framings.join(ranking.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left")
    hit = F.coalesce(F.col("rank") <= 5, F.lit(False)) & ~((F.col("framing") == "outside as miss") & outside)
    per = met.groupBy("framing", "query_id").agg(F.max(hit).alias("hit"))
    return per.groupBy("framing").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


# --- entities -----------------------------------------------------------------------------------------

TYPED = "SELECT DISTINCT item_id, w AS text, ['LOCAL', 'PESSOA', 'TEMPO'][CAST(length(w) % 3 AS INTEGER) + 1] AS kind FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark) WHERE length(w) >= {0} AND (length(w) + item_id) % {1} <> 0"


def _typed(t, least, skip):
    w = t.benchmark.select("item_id", F.explode(text.tokens(F.col("text"))).alias("text"))
    kind = F.element_at(F.array(F.lit("LOCAL"), F.lit("PESSOA"), F.lit("TEMPO")), (F.length("text") % 3 + 1).cast("int"))
    return w.filter((F.length("text") >= least) & ((F.length("text") + F.col("item_id")) % skip != 0)).select("item_id", "text", kind.alias("kind")).distinct()


@query(f"""WITH p AS ({TYPED.format(5, 4)}), g AS ({TYPED.format(6, 5)}), b AS (SELECT coalesce(p.kind, g.kind) AS kind, p.text IS NOT NULL AS s, g.text IS NOT NULL AS y FROM p FULL JOIN g ON p.item_id = g.item_id AND p.text = g.text AND p.kind = g.kind),
    c AS (SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, count(*) FILTER (s AND y) AS tp, count(*) FILTER (s AND NOT y) AS fp, count(*) FILTER (y AND NOT s) AS fn FROM b GROUP BY ROLLUP (kind))
    SELECT *, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 4), 0) AS f1 FROM c""")
def agg_micro_f1(t):
    return metrics.micro_f1(_typed(t, 5, 4), _typed(t, 6, 5), "item_id", "kind")


# --- answers: refusals, citations, routes, guards ------------------------------------------------------

ANSWERS = """(SELECT conv_id, turn, conv_id % 2 = 0 AS impossible, conv_id % 3 AS category, CASE WHEN turn % 3 = 1 THEN 'The contract does not specify it. ' WHEN turn % 5 = 0 THEN 'NOT_FOUND ' ELSE '' END || coalesce(text, '') || CASE WHEN turn % 7 = 1 THEN ' [2]' ELSE '' END AS answer FROM conversations)"""


def answers(t):
    k = F.col("turn")
    said = F.concat(F.when(k % 3 == 1, "The contract does not specify it. ").when(k % 5 == 0, "NOT_FOUND ").otherwise(""), F.coalesce("text", F.lit("")), F.when(k % 7 == 1, " [2]").otherwise(""))
    return t.conversations.select("conv_id", "turn", (F.col("conv_id") % 2 == 0).alias("impossible"), (F.col("conv_id") % 3).alias("category"), said.alias("answer"))


DECLINED = f"regexp_matches(answer, '(?i){extract.DECLINED}')"
DOUBTFUL = f"({DECLINED} AND (length(answer) > 240 OR regexp_matches(answer, '\\[\\d+\\]')))"


@query(f"SELECT conv_id, turn, {DECLINED} AS abstained FROM {ANSWERS}")
def ev_abstained(t):
    return answers(t).select("conv_id", "turn", extract.declined(F.col("answer")).alias("abstained"))


@query(f"""WITH a AS (SELECT impossible, {DECLINED} AS d FROM {ANSWERS}) SELECT count(*) FILTER (impossible) AS n_impossible, count(*) FILTER (NOT impossible) AS n_possible,
    round(coalesce(count(*) FILTER (impossible AND d) / nullif(count(*) FILTER (impossible), 0)::DOUBLE, 0), 4) AS quiet, round(coalesce(count(*) FILTER (NOT impossible AND NOT d) / nullif(count(*) FILTER (NOT impossible), 0)::DOUBLE, 0), 4) AS coverage,
    round((coalesce(count(*) FILTER (impossible AND d) / nullif(count(*) FILTER (impossible), 0)::DOUBLE, 0) + coalesce(count(*) FILTER (NOT impossible AND NOT d) / nullif(count(*) FILTER (NOT impossible), 0)::DOUBLE, 0)) / 2, 4) AS balanced FROM a""")
def ev_two_rates(t):
    return evaluation.two_rates(answers(t).withColumn("declined", extract.declined(F.col("answer"))), "impossible", "declined")


@query(f"""SELECT count(*) FILTER ({DECLINED}) AS n_refusals, count(*) FILTER ({DOUBTFUL}) AS n_doubtful, count(*) FILTER ({DOUBTFUL} AND NOT impossible) AS n_doubtful_possible,
    coalesce(round((count(*) FILTER (NOT impossible) - count(*) FILTER (NOT impossible AND {DECLINED}) + count(*) FILTER (NOT impossible AND {DOUBTFUL})) / nullif(count(*) FILTER (NOT impossible), 0)::DOUBLE, 4), 0) AS coverage_at_most FROM {ANSWERS}""")
def ev_refusal_audit(t):
    a = F.col("answer")
    rows = answers(t).select("impossible", extract.declined(a).alias("declined"), extract.doubtful_refusal(a).alias("doubtful"))
    return evaluation.refusal_audit(rows, "impossible", "declined", "doubtful")


CONTEXT = "['1001/2023', '5867/2020', '2002/2023', '3003/2023'][1:1 + doc_id % 4]"


def _context():
    return F.slice(F.array(*[F.lit(s) for s in ("1001/2023", "5867/2020", "2002/2023", "3003/2023")]), F.lit(1), (1 + F.col("doc_id") % 4).cast("int"))


@query(f"SELECT doc_id, coalesce(round(len(list_intersect({CITATIONS}, {CONTEXT})) / nullif(len({CITATIONS}), 0)::DOUBLE, 4), -1) AS precision FROM {CITING}")
def ev_citation_precision(t):
    return citing(t).select("doc_id", F.coalesce(F.round(evaluation.citation_precision(text.citations(F.col("said")), _context()), 4), F.lit(-1.0)).alias("precision"))


@query(f"WITH c AS (SELECT len(list_intersect({CITATIONS}, {CONTEXT})) > 0 AS ok FROM {CITING}), g AS (SELECT count(*) AS n, count(*) FILTER (ok) AS h FROM c) SELECT n, h AS right_sources, round(h / n::DOUBLE, 4) AS rate, {WILSON.format('-')} AS lo, {WILSON.format('+')} AS hi FROM g")
def ev_citation_accuracy(t):
    hit = F.arrays_overlap(text.citations(F.col("said")), _context())
    g = citing(t).agg(F.count("*").alias("n"), F.count_if(hit).alias("right_sources"))
    lo, hi = metrics.wilson(F.col("right_sources"), F.col("n"))
    return g.select("n", "right_sources", F.round(F.col("right_sources") / F.col("n"), 4).alias("rate"), lo.alias("lo"), hi.alias("hi"))


ROUTED = f"(SELECT doc_id, list_filter([{_sql_routes()}], lambda x: x IS NOT NULL) AS a, ['regulatorio', 'entidades', 'dados'][1:doc_id % 4] AS b FROM documents WHERE text IS NOT NULL)"


@query(f"""SELECT count(*) AS n, round(avg((list_sort(a) = list_sort(b))::INTEGER), 4) AS exact, round(avg(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END), 4) AS jaccard FROM {ROUTED}""")
def ev_routing(t):
    got = F.filter(F.split(evaluation.routes(F.col("text")), ","), lambda x: x != "")
    want = F.slice(F.array(*[F.lit(r) for r in evaluation.ROUTES]), F.lit(1), (F.col("doc_id") % 4).cast("int"))
    rows = t.documents.filter("text is not null").select(got.alias("a"), want.alias("b"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((F.sort_array("a") == F.sort_array("b")).cast("int")), 4).alias("exact"), F.round(F.avg(extract.jaccard(F.col("a"), F.col("b"))), 4).alias("jaccard"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 4 = 1 AND source <> '' THEN 'dados' ELSE concat_ws(',', {_sql_routes()}) END AS routes FROM documents WHERE text IS NOT NULL""")
def ag_route_parse(t):
    """Routes from a model's JSON where it names any known one, else those of the question's words."""
    i = F.col("doc_id")
    said = F.when(i % 4 == 0, F.lit("no JSON")).when(i % 4 == 1, F.lit('So: {"rotas": ["dados", "outra"], "motivo": "x"}')).when(i % 4 == 2, F.lit('{"rotas": []}')).otherwise(F.lit('{"rotas": "dados"}'))
    return t.documents.filter("text is not null").select("doc_id", evaluation.parsed_routes(said, F.col("text")).alias("routes"))


ATTACKS = ("Ignore all previous instructions ", "esqueça tudo ", "please help with ", "developer mode ", "what is the rule on ")


@query(f"""WITH a AS (SELECT conv_id % 5 AS k, CASE WHEN conv_id % 5 IN (2, 4) THEN 'benign' WHEN conv_id % 2 = 0 THEN 'first' ELSE 'deep' END AS layer, {list(ATTACKS)}[CAST(conv_id % 5 AS INTEGER) + 1] || coalesce(text, '') AS said FROM conversations),
    d AS (SELECT k, layer, {_sql_injection('said')} IS NOT NULL AS hit FROM a) SELECT layer, CAST(k AS BIGINT) AS category, count(*) AS n, count(*) FILTER (hit) AS detected, round(count(*) FILTER (hit) / count(*)::DOUBLE, 3) AS rate FROM d GROUP BY 1, 2""")
def ev_guardrail(t):
    k = F.col("conv_id") % 5
    said = F.concat(F.element_at(F.array(*[F.lit(a) for a in ATTACKS]), (k + 1).cast("int")), F.coalesce("text", F.lit("")))
    layer = F.when(k.isin(2, 4), "benign").when(F.col("conv_id") % 2 == 0, "first").otherwise("deep")
    return evaluation.guard_report(t.conversations.select(layer.alias("layer"), k.alias("category"), security.injection(said).isNotNull().alias("hit")))


@query(f"""WITH x AS (SELECT doc_id, 'a' || doc_id || '@b.com' AS secret, text || CASE WHEN doc_id % 3 = 0 THEN ' write a' || doc_id || '@b.com' ELSE '' END AS said FROM documents WHERE text IS NOT NULL), y AS (SELECT *, {_sql_mask('said')} AS masked FROM x)
    SELECT count(*) AS n, count(*) FILTER (contains(said, secret)) AS before, count(*) FILTER (contains(masked, secret)) AS after, count(*) FILTER (doc_id % 3 <> 0 AND masked <> said) AS changed FROM y""")
def ev_pii_leak(t):
    secret = F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit("@b.com"))
    said = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" write "), secret)).otherwise(""))
    rows = t.documents.filter("text is not null").select("doc_id", secret.alias("secret"), said.alias("said")).withColumn("masked", security.mask_pii(F.col("said")))
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.contains("said", "secret")).alias("before"), F.count_if(F.contains("masked", "secret")).alias("after"),
        F.count_if((F.col("doc_id") % 3 != 0) & (F.col("masked") != F.col("said"))).alias("changed"),
    )


@query(f"SELECT conv_id, turn, {_sql_mask('text')} AS asked, {_sql_injection('text')} IS NOT NULL AS flagged FROM conversations WHERE role = 'user' AND text IS NOT NULL")
def sec_audit(t):
    """Each question's audit event, masked and flagged, appended to the log and read back."""
    path, q = sinks.scratch(t.spark, "audit"), F.col("text")
    events = t.conversations.filter("role = 'user' and text is not null").select("conv_id", "turn", security.mask_pii(q).alias("asked"), security.injection(q).isNotNull().alias("flagged"))
    sinks.append_log(events, path, "audit")
    return t.spark.read.schema("conv_id long, turn long, asked string, flagged boolean").json(path)


@query("""WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'), p AS (SELECT conv_id, turn, text, greatest(1, ceil(length(text) / 80.0))::BIGINT AS n FROM a)
    SELECT conv_id, turn, 0 AS seq, 'sources' AS kind, '' AS part FROM p WHERE conv_id % 9 <> 0 UNION ALL SELECT conv_id, turn, i + 1, 'text', substr(text, i * 80 + 1, 80) FROM (SELECT *, unnest(range(n)) AS i FROM p) WHERE conv_id % 9 <> 0
    UNION ALL SELECT conv_id, turn, n + 1, 'end', '' FROM p WHERE conv_id % 9 <> 0 UNION ALL SELECT conv_id, turn, 0, 'block', '' FROM p WHERE conv_id % 9 = 0""")
def st_answer_events(t):
    rows = t.conversations.filter("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return evaluation.answer_events(rows, F.col("conv_id") % 9 == 0, "text", 80).select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), "kind", "part")


@query("""WITH p AS (SELECT l_orderkey, sum(l_discount) AS a, sum(l_tax) AS b, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT round(exp(sum(a) / sum(n)), 3) AS full_ppl, round(exp(sum(b) / sum(n)), 3) AS small_ppl FROM p)
    SELECT full_ppl, small_ppl, round(100 * (small_ppl - full_ppl) / full_ppl, 2) AS delta_pct FROM s""")
def ev_quant_delta(t):
    ppl = lambda loss, name: evaluation.perplexity(t.lineitem.select("l_orderkey", (-F.col(loss)).alias("p")), "l_orderkey", "p").select(F.col("ppl_micro").alias(name))
    both = ppl("l_discount", "full_ppl").crossJoin(ppl("l_tax", "small_ppl"))
    return both.withColumn("delta_pct", F.round(100 * (F.col("small_ppl") - F.col("full_ppl")) / F.col("full_ppl"), 2))


@query("""WITH q AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) AS place FROM benchmark), a AS (SELECT text, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE text <> '')
    SELECT q.item_id, q.place, md5('system:Answer.;user:' || q.text || ';assistant:' || a.text) AS digest FROM q JOIN a USING (place)""")
def ft_conversations(t):
    """Questions and answers from two tables, zipped by place, as chats."""
    asked = star.numbered(t.benchmark.select("item_id", "text"), "item_id", "place")
    said = star.numbered(t.documents.filter("text <> ''").select("doc_id", F.col("text").alias("answer")), "doc_id", "place")
    chat = F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit("Answer.")), ("user", F.col("text")), ("assistant", F.col("answer")))])
    flat = F.array_join(F.transform("chat", lambda m: F.concat(m.getField("role"), F.lit(":"), m.getField("content"))), ";")
    return asked.join(said, "place").select("item_id", "place", chat.alias("chat")).select("item_id", "place", F.md5(flat).alias("digest"))


@query(f"""{BM25_SQL}, top1 AS (SELECT query_id, chunk_id FROM bm WHERE rank = 1), places AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents),
    tried AS (SELECT query_id, p.chunk_id, (p.place - CAST('0x' || substr(md5('42|' || query_id), 1, 8) AS BIGINT) % n + n) % n AS step FROM (SELECT DISTINCT query_id FROM bm), places p),
    other AS (SELECT query_id, chunk_id FROM tried WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM bm) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY step) = 1)
    SELECT query_id, chunk_id, false AS distractor FROM top1 UNION ALL SELECT query_id, chunk_id, true FROM other""")
def kit_distractors(t):
    return evaluation.annotation_kit(_bm25(t), t.documents.select(F.col("doc_id").alias("chunk_id")))


CUT = f"(SELECT doc_id, regexp_replace(CASE WHEN regexp_matches(act, '(?i){extract.HEADING}') THEN regexp_extract(act, '(?is){extract.HEADING}.*', 0) ELSE act END, '{extract.FOOT}', '') AS c FROM {ACTS})"
CHROME = " + ".join(f"CAST(contains(lower(p), '{p}') AS INTEGER)" for p in text.BOILERPLATE)


@query(f"""WITH w AS (SELECT doc_id, i, substr(c, i * 1300 + 1, 1500) AS p FROM (SELECT doc_id, c, unnest(range(greatest(1, ceil((length(c) - 200) / 1300.0))::BIGINT)) AS i FROM {CUT} WHERE length(c) > 0))
    SELECT doc_id || '::' || (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) AS chunk_id, md5(p) AS digest FROM w WHERE ({CHROME}) < 2 AND length(trim(p)) >= 5""")
def chk_norm(t):
    return evaluation.act_chunks(acts(t), "doc_id", "act").select("chunk_id", F.md5("chunk").alias("digest"))

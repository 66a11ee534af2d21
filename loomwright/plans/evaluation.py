"""Registered queries of the evaluation, retrieval-by-group, resampling and replay operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, metrics, resample, retrieval
from ..streaming import replay
from .registry import ORACLES, Tables, nation_monthly, query, star

SCORED = "SELECT doc_id, n_chars::DOUBLE AS s, least(n_chars / 2000.0::DOUBLE, 1.0) AS p, quality AS y FROM documents JOIN labels USING (doc_id)"


def scored(t: Tables) -> DataFrame:
    """Labelled documents with their length as a score, and as a made-up probability of being good."""
    n = F.col("n_chars").cast("double")
    return t.documents.join(t.labels, "doc_id").select("doc_id", n.alias("s"), F.least(n / 2000.0, F.lit(1.0)).alias("p"), F.col("quality").alias("y"))


CURVE = f"""x AS ({SCORED}), g AS (SELECT s, sum(y)::BIGINT AS p, count(*) AS c FROM x GROUP BY 1),
    r AS (SELECT s, p, sum(p) OVER (ORDER BY s DESC)::BIGINT AS tp, sum(c) OVER (ORDER BY s DESC)::BIGINT AS said, (SELECT sum(p)::BIGINT FROM g) AS total FROM g)"""


@query(f"WITH {CURVE} SELECT round(sum(p * tp::DOUBLE / said) / max(total), 6) AS average_precision FROM r")
def ml_average_precision(t):
    return evaluation.average_precision(scored(t), "s", "y")


@query(f"WITH {CURVE} SELECT s AS threshold, round(2 * tp / (said + total)::DOUBLE, 6) AS f1 FROM r ORDER BY f1 DESC, threshold LIMIT 1")
def ml_threshold_f1(t):
    return evaluation.best_f1(scored(t), "s", "y")


SWEEP = f"WITH w AS ({ORACLES['ev_threshold_sweep']})"


def _sweep(t: Tables) -> DataFrame:
    return metrics.threshold_sweep(scored(t), "s", "y")


@query(SWEEP + " SELECT * FROM w ORDER BY youden DESC, threshold LIMIT 1")
def ev_best_youden(t):
    return evaluation.best_youden(_sweep(t))


@query(SWEEP + """, s AS (SELECT avg(quality) AS share FROM documents JOIN labels USING (doc_id)), g AS (SELECT unnest([0.9, 0.95, 0.99])::DOUBLE AS target),
    b AS (SELECT * FROM g JOIN w ON specificity >= target QUALIFY row_number() OVER (PARTITION BY target ORDER BY coverage DESC, threshold) = 1)
    SELECT target, threshold, specificity, coverage, round((1 - share) * specificity + share * (1 - coverage), 4) AS avoided, round(1 - coverage, 4) AS lost FROM b, s""")
def ev_cascade(t):
    share = F.broadcast(scored(t).agg(F.avg("y").alias("share")))
    return evaluation.cascade(_sweep(t).crossJoin(share), F.col("share"))


@query(f"SELECT round(avg(pow(p - y, 2)), 6) AS brier FROM ({SCORED})")
def ml_brier(t):
    return evaluation.brier(scored(t), "p", "y")


@query(f"SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(p), 6) AS mean_probability, round(avg(y), 6) AS share FROM ({SCORED}) GROUP BY 1")
def ml_calibration(t):
    return evaluation.reliability(scored(t), "p", "y")


@query("""WITH p AS (SELECT l_orderkey, sum(l_discount) AS nll, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT sum(n)::BIGINT AS n_tokens, round(exp(sum(nll) / sum(n)), 3) AS ppl_micro, round(avg(exp(nll / n)), 3) AS ppl_macro FROM p""")
def ev_perplexity(t):
    return evaluation.perplexity(t.lineitem.select("l_orderkey", (-F.col("l_discount")).alias("logprob")), "l_orderkey", "logprob")


@query("""SELECT CASE WHEN quality = 1 AND toxic = 1 THEN 'ft' WHEN quality = 0 AND toxic = 0 THEN 'base' ELSE 'empate' END AS winner, count(*) AS n FROM labels GROUP BY 1""")
def ev_winrate(t):
    first = F.when(F.col("quality") == 1, "B").otherwise("A")
    swapped = F.when(F.col("toxic") == 1, "A").otherwise("B")
    return t.labels.groupBy(evaluation.winner(first, swapped).alias("winner")).agg(F.count("*").alias("n"))


@query(f"""WITH b AS ({ORACLES['ts_backtest']}) SELECT count(*) AS n, round(avg(mape_naive - mape_seasonal), 3) AS mean_gain,
    round(100.0 * count(*) FILTER (mape_seasonal < mape_naive) / count(*), 1) AS win_pct FROM b WHERE mape_seasonal IS NOT NULL AND mape_naive IS NOT NULL""")
def ts_paired(t):
    return evaluation.paired(star.backtest(nation_monthly(t), "nation"), "mape_seasonal", "mape_naive")


def _sql_routes() -> str:
    any_of = lambda words: " OR ".join(f"contains(lower(text), '{w}')" for w in words)
    return ", ".join(f"CASE WHEN {any_of(words)} THEN '{name}' END" for name, words in evaluation.ROUTES.items())


@query(f"SELECT doc_id, concat_ws(',', {_sql_routes()}) AS routes FROM documents")
def ag_route_heuristic(t):
    return t.documents.select("doc_id", evaluation.routes(F.col("text")).alias("routes"))


@query(r"SELECT page_id, md5(regexp_replace(html, '</?contexto>|\[/?INST\]|<\|[^|]*\|>', ' ', 'gi')) AS digest FROM pages")
def sec_context_neutralize(t):
    return t.pages.select("page_id", F.md5(evaluation.neutral_context(F.col("html"))).alias("digest"))


@query("""WITH tok AS (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
    tf AS (SELECT source, doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2, 3),
    dl AS (SELECT source, doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents), s AS (SELECT source, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY 1),
    raw AS (SELECT source, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN s USING (source) GROUP BY source, term, n),
    idf AS (SELECT source, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY source) ELSE raw END AS idf FROM raw),
    q AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
    sc AS (SELECT source, query_id, doc_id AS chunk_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM q JOIN idf USING (term) JOIN tf USING (source, term) JOIN dl USING (source, doc_id) JOIN s USING (source) GROUP BY 1, 2, 3)
    SELECT source, query_id, chunk_id, CAST(row_number() OVER (PARTITION BY source, query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 5""")
def ret_bm25_partitioned(t):
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), "source", "text")
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(chunks, asked, 5, by=("source",)).select("source", "query_id", "chunk_id", "rank")


@query()
def ev_bootstrap_mean(t):
    return resample.bootstrap_mean(t.orders, "o_orderkey", "o_orderpriority", "o_totalprice")


@query()
def ev_cohen_kappa_ci(t):
    rows = t.labels.withColumn("all", F.lit("all"))
    return resample.bootstrap_kappa(rows, "doc_id", "all", "quality", "toxic")


@query()
def st_lru_cache(t):
    asked = t.events.withColumn("at", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.format_string("-%020d", F.col("event_id"))))
    return replay.hit_rate(replay.replay_lru(asked, "event_type", F.to_date("ts"), "at", "user_id", 32), "event_type")

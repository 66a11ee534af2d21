"""Registered queries of the core operators and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import security, text
from ..operators import clauses, forecast, metrics, passages, quantiles, retrieval, star
from ..sources import files
from ..streaming import masking

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return files.read_table(self.spark, f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers f(tables) under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def day(c: str = "month") -> F.Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


MONTH = "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')"
MONTHLY = "SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS total FROM orders GROUP BY 1"
NATION_MONTHLY = """SELECT n_name AS nation, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""


def orders_monthly(t: Tables) -> DataFrame:
    return star.monthly(t.orders, F.col("o_orderdate"), F.col("o_totalprice"))


def nation_orders(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))


def nation_monthly(t: Tables) -> DataFrame:
    return star.monthly(nation_orders(t).withColumnRenamed("n_name", "nation"), F.col("o_orderdate"), F.col("o_totalprice"), "nation")


# --- scans, filters, aggregation -------------------------------------------------------------


@query(f"SELECT {MONTH} AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def agg_sum_by_month(t):
    return orders_monthly(t).select(day(), F.round("total", 2).alias("total"))


@query(f"""WITH m AS ({MONTHLY}), g AS (SELECT strftime(m, '%Y-%m-%d') AS month, round(total, 2) AS total,
    round(100.0 * (total - lag(total, 1) OVER w) / nullif(lag(total, 1) OVER w, 0), 2) AS mom_pct,
    round(100.0 * (total - lag(total, 12) OVER w) / nullif(lag(total, 12) OVER w, 0), 2) AS yoy_pct
    FROM m WINDOW w AS (ORDER BY m)) SELECT * FROM g ORDER BY month DESC LIMIT 6""")
def win_growth_latest(t):
    return star.growth(orders_monthly(t)).orderBy(F.desc("month")).limit(6).select(day(), F.round("total", 2).alias("total"), "mom_pct", "yoy_pct")


@query(f"""WITH m AS ({MONTHLY}) SELECT strftime(a.m, '%Y-%m-%d') AS month, round(100.0 * (a.total - b.total) / nullif(b.total, 0), 2) AS yoy_pct
    FROM m a LEFT JOIN m b ON a.m = b.m + INTERVAL 12 MONTH""")
def win_growth_calendar(t):
    return star.growth_calendar(orders_monthly(t)).select(day(), "yoy_pct")


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1)
    SELECT CAST(month(m) AS INTEGER) AS month_no, CAST((2 * sum(cents) + count(*)) // (2 * count(*)) AS BIGINT) / 100.0::DOUBLE AS mean_total FROM m GROUP BY 1""")
def agg_avg_of_sums(t):
    """Means of monthly sums, in whole cents rounded once, so that they do not hang on the order of summation."""
    cents = star.monthly(t.orders, F.col("o_orderdate"), F.round(F.col("o_totalprice") * 100).cast("long"))
    mean = cents.groupBy(F.month("month").alias("month_no")).agg(F.sum("total").alias("s"), F.count("*").alias("n"))
    return mean.select("month_no", (F.expr("(2 * s + n) div (2 * n)") / 100.0).cast("double").alias("mean_total"))


@query("""SELECT o_orderpriority AS priority, round(sum(o_totalprice), 2) AS total,
    round(100.0 * sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 1) AS pct FROM orders GROUP BY 1""")
def agg_share(t):
    return star.share(t.orders.withColumnRenamed("o_orderpriority", "priority"), "priority", F.col("o_totalprice")).withColumn("total", F.round("total", 2))


@query("SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n FROM lineitem GROUP BY 1")
def agg_count_by_year(t):
    return t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))


@query("SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 4) AS rate FROM lineitem GROUP BY 1")
def agg_conditional_rate(t):
    flag = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).cast("double")
    return t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.round(F.avg(flag), 4).alias("rate"))


@query("SELECT count(DISTINCT l_suppkey) AS n FROM lineitem")
def agg_count_distinct(t):
    return t.lineitem.agg(F.countDistinct("l_suppkey").alias("n"))


@query("""SELECT o_orderpriority AS priority, count(DISTINCT o_custkey) AS n_customers,
    CAST(12 * (year(max(o_orderdate)) - year(min(o_orderdate))) + month(max(o_orderdate)) - month(min(o_orderdate)) + 1 AS BIGINT) AS span FROM orders GROUP BY 1""")
def agg_count_distinct_group(t):
    lo, hi = F.min("o_orderdate"), F.max("o_orderdate")
    span = 12 * (F.year(hi) - F.year(lo)) + F.month(hi) - F.month(lo) + 1
    return t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.countDistinct("o_custkey").alias("n_customers"), span.cast("long").alias("span"))


@query("SELECT event_type, count(*) AS n, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def agg_percentiles(t):
    parts = quantiles.exact_quantiles(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}, {"p90": 0.9})
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.join(parts, "event_type").select("event_type", "n", *(F.round(p, 6).alias(p) for p in ("p50", "p95", "p90")))


@query("SELECT coalesce(round(sum(o_totalprice), 2), 0.0) AS total, 'ok' AS none FROM orders WHERE o_orderpriority = '2-HIGH'")
def agg_total_one(t):
    """The total of one value given as a parameter; a value that no row has gives 0."""
    said = "SELECT coalesce(round(sum(o_totalprice), 2), 0.0D) AS total FROM {orders} WHERE o_orderpriority = :p"
    total = lambda p: t.spark.sql(said, args={"p": p}, orders=t.orders)
    none = total("no such; DROP TABLE orders").select(F.when(F.col("total") == 0, "ok").alias("none"))
    return total("2-HIGH").crossJoin(none)


@query("""SELECT CASE WHEN grouping(y) = 1 THEN 'all' ELSE CAST(y AS VARCHAR) END AS year, count(*) AS n, count(*) FILTER (r = 'R') AS n_returned
    FROM (SELECT year(l_shipdate) AS y, l_returnflag AS r FROM lineitem) GROUP BY GROUPING SETS ((y), ())""")
def agg_ingest_profile(t):
    rows = t.lineitem.select(F.year("l_shipdate").alias("y"), F.col("l_returnflag").alias("r"))
    rolled = rows.rollup("y").agg(F.grouping("y").alias("g"), F.count("*").alias("n"), F.count_if(F.col("r") == "R").alias("n_returned"))
    return rolled.select(F.when(F.col("g") == 1, "all").otherwise(F.col("y").cast("string")).alias("year"), "n", "n_returned")


@query("SELECT lang, min(n_chars) AS lo, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median, max(n_chars) AS hi FROM documents GROUP BY 1")
def agg_contract_profile(t):
    return metrics.upper_median(t.documents, "lang", "n_chars")


@query("SELECT p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def srt_topk_tiebreak(t):
    per = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    return per.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p_type").limit(10)


# --- star schema, joins, windows ---------------------------------------------------------------


@query("SELECT strftime(m, '%Y-%m-%d') AS month, CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month_no, CAST(quarter(m) AS INTEGER) AS quarter, (['Janeiro','Fevereiro','Março','Abril','Maio','Junho','Julho','Agosto','Setembro','Outubro','Novembro','Dezembro'])[month(m)] AS month_name FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders)")
def dt_calendar_dim(t):
    return star.calendar(t.orders.select(F.trunc("o_orderdate", "month").alias("month"))).withColumn("month", day())


@query("SELECT row_number() OVER (ORDER BY c_mktsegment, n_name) AS id, c_mktsegment, n_name FROM (SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def win_row_number(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return star.keyed(rows, ["c_mktsegment", "n_name"], "id").withColumn("id", F.col("id").cast("long"))


@query("SELECT n_name AS nation, round(sum(o_totalprice), 2) AS total, rank() OVER (ORDER BY round(sum(o_totalprice), 2) DESC) AS place FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY place, nation LIMIT 10")
def win_rank_desc(t):
    per = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("v"))
    grouped = per.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), F.round("v", 2).alias("total"))
    return grouped.withColumn("place", F.rank().over(Window.orderBy(F.desc("total"))).cast("long")).orderBy("place", "nation").limit(10)


@query(f"""WITH s AS ({NATION_MONTHLY}), f AS (SELECT nation, m, round(total, 2) AS total, round(lag(total, 1) OVER w, 2) AS lag_1, round(lag(total, 2) OVER w, 2) AS lag_2,
    round(lag(total, 3) OVER w, 2) AS lag_3, round(lag(total, 12) OVER w, 2) AS lag_12,
    CASE WHEN count(*) OVER (PARTITION BY nation ORDER BY m ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 THEN round(avg(total) OVER (PARTITION BY nation ORDER BY m ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 5) END AS mean_3,
    CASE WHEN count(*) OVER (PARTITION BY nation ORDER BY m ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) = 12 THEN round(avg(total) OVER (PARTITION BY nation ORDER BY m ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 5) END AS mean_12
    FROM s WINDOW w AS (PARTITION BY nation ORDER BY m)) SELECT nation, strftime(m, '%Y-%m-%d') AS month, total, lag_1, lag_2, lag_3, lag_12, mean_3, mean_12 FROM f""")
def win_lags_features(t):
    out = star.lag_features(nation_monthly(t), "nation")
    return out.select("nation", day(), *[F.round(c, 5 if c.startswith("mean") else 2).alias(c) for c in ("total", "lag_1", "lag_2", "lag_3", "lag_12", "mean_3", "mean_12")])


@query(f"""WITH s AS ({NATION_MONTHLY}), c AS (SELECT nation, count(DISTINCT m) AS n_months, CAST(12 * (year(max(m)) - year(min(m))) + month(max(m)) - month(min(m)) + 1 AS BIGINT) AS span FROM s GROUP BY 1)
    SELECT * FROM c WHERE n_months = span AND n_months >= 60""")
def ts_contiguous(t):
    return star.contiguous(nation_monthly(t), "nation", 60)


@query(f"""WITH s AS ({NATION_MONTHLY}), r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY m DESC) AS r, lag(total, 12) OVER (PARTITION BY nation ORDER BY m) AS seasonal FROM s),
    h AS (SELECT *, max(CASE WHEN r = 13 THEN total END) OVER (PARTITION BY nation) AS naive FROM r)
    SELECT nation, round(avg(abs((total - naive) / nullif(total, 0))) * 100, 4) AS mape_naive, round(avg(abs((total - seasonal) / nullif(total, 0))) * 100, 4) AS mape_seasonal FROM h WHERE r <= 12 GROUP BY 1""")
def ts_backtest(t):
    off = star.backtest(nation_monthly(t), "nation")
    return off


@query(f"""WITH s AS ({NATION_MONTHLY}), r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY m DESC) AS r FROM s),
    g AS (SELECT nation, count(*) AS n, sum(total) FILTER (r <= 12) AS a, sum(total) FILTER (r BETWEEN 13 AND 24) AS b FROM r GROUP BY 1)
    SELECT nation, CASE WHEN n >= 24 THEN round(a / nullif(b, 0) - 1, 6) END AS yoy FROM g""")
def win_yoy_12(t):
    r = nation_monthly(t).withColumn("r", F.row_number().over(Window.partitionBy("nation").orderBy(F.desc("month"))))
    g = r.groupBy("nation").agg(F.count("*").alias("n"), F.sum(F.when(F.col("r") <= 12, F.col("total"))).alias("a"), F.sum(F.when(F.col("r").between(13, 24), F.col("total"))).alias("b"))
    return g.select("nation", F.when(F.col("n") >= 24, F.round(F.col("a") / F.nullif(F.col("b"), F.lit(0.0)) - 1, 6)).alias("yoy"))


@query("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1999), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 2000)
    SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_custkey IN (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY 1""")
def jn_semi_cohort(t):
    keys = lambda y: t.orders.filter(F.year("o_orderdate") == y).select("o_custkey").distinct()
    return t.orders.join(keys(1999).intersect(keys(2000)), "o_custkey", "left_semi").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT doc_id, quality FROM labels), b AS (SELECT doc_id, n_chars FROM documents WHERE lang = 'en')
    SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS paired, count(*) FILTER (b.doc_id IS NULL) AS only_left, count(*) FILTER (a.doc_id IS NULL) AS only_right FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def jn_pair_by_key(t):
    a = t.labels.select(F.col("doc_id").alias("x"))
    b = t.documents.filter("lang = 'en'").select(F.col("doc_id").alias("y"))
    return a.join(b, F.col("x") == F.col("y"), "full").agg(
        F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("paired"), F.count_if(F.col("y").isNull()).alias("only_left"), F.count_if(F.col("x").isNull()).alias("only_right")
    )


CHUNK, OVERLAP = 1500, 200
CHUNKS = f"""SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CAST(i * {CHUNK - OVERLAP} AS INTEGER) AS start, CAST(least(length(text), i * {CHUNK - OVERLAP} + {CHUNK}) AS INTEGER) AS stop, text
    FROM (SELECT doc_id, text, unnest(range(CAST(greatest(1, ceil((length(text) - {OVERLAP}) / {CHUNK - OVERLAP}.0)) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)"""


def chunks(t: Tables) -> DataFrame:
    c = t.documents.select("doc_id", "text", F.posexplode(text.window_starts(F.col("text"), CHUNK, OVERLAP)).alias("chunk_no", "start"))
    return c.withColumn("stop", F.least(F.length("text"), F.col("start") + CHUNK))


@query(f"SELECT doc_id, chunk_no, start, stop, md5(substr(text, start + 1, stop - start)) AS digest FROM ({CHUNKS})")
def chk_window_offsets(t):
    piece = F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start"))
    return chunks(t).select("doc_id", "chunk_no", "start", "stop", F.md5(piece).alias("digest"))


PLACES = """p AS (SELECT d.doc_id, d.text, b.item_id, b.text AS passage FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''),
    s AS (SELECT doc_id, item_id, i AS a, i + length(passage) AS z FROM (SELECT *, unnest(range(length(text) - length(passage) + 1)) AS i FROM p) WHERE substr(text, CAST(i + 1 AS BIGINT), length(passage)) = passage)"""


def places(t: Tables) -> DataFrame:
    """(doc_id, item_id, start, end): every place of a benchmark passage in a document."""
    return passages.places(t.documents, t.benchmark, "doc_id", "text", "item_id", "text")


def overlapped(t: Tables) -> DataFrame:
    """(item_id, doc_id, chunk_no, start, end): the chunks that each place of a passage shares characters with."""
    windows = chunks(t).select("doc_id", "chunk_no", F.col("start").alias("from"), F.col("stop").alias("to"))
    return passages.overlapping(places(t), windows, "doc_id", CHUNK)


@query(f"WITH c AS ({CHUNKS}), {PLACES} SELECT DISTINCT s.item_id, c.doc_id, c.chunk_no FROM s JOIN c ON s.doc_id = c.doc_id AND s.a < c.stop AND s.z > c.start")
def jn_span_overlap(t):
    return overlapped(t).select("item_id", "doc_id", "chunk_no").distinct()


@query(f"WITH c AS ({CHUNKS}), {PLACES} SELECT s.item_id, c.doc_id, c.chunk_no, count(*) AS n FROM s JOIN c ON s.doc_id = c.doc_id AND s.a < c.stop AND s.z > c.start GROUP BY 1, 2, 3")
def jn_span_overlap_all(t):
    return overlapped(t).groupBy("item_id", "doc_id", "chunk_no").agg(F.count("*").alias("n"))


# --- text ---------------------------------------------------------------------------------------


@query("""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_ascii, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n_unicode FROM documents""")
def tok_counts(t):
    return t.documents.select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_ascii"), F.size(text.tokens_unicode(F.col("text"))).cast("long").alias("n_unicode"))


def _sql_mask(c: str) -> str:
    """The masks for an engine whose word ends are those of ASCII: what stands around a match is matched too,
    and each pattern is applied twice, as neighbours share what stands between them."""
    word, digit, blank = r"\p{L}\p{N}_", r"\p{Nd}", r"[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]"
    for p, label in security.PII:
        said = p.replace(r"\w", word).replace(r"\d", digit).replace(r"\s", blank)
        if "@" in said:
            c = f"regexp_replace({c}, '[{word}][{word}.+-]*@[{word}-]+\\.[{word}.-]*[{word}]', '{label}', 'g')"
        else:
            before, after = f"(^|[^{word}])" if said.startswith(r"\b") else "()", f"($|[^{word}])"
            for _ in range(2):
                c = f"regexp_replace({c}, '{before}{said.removeprefix(r'\b').removesuffix(r'\b')}{after}', '\\1{label}\\2', 'g')"
    return c


@query(f"SELECT conv_id, turn, {_sql_mask('text')} AS masked FROM conversations")
def sec_mask_pii(t):
    return t.conversations.select("conv_id", "turn", security.mask_pii(F.col("text")).alias("masked"))


@query(f"SELECT doc_id, {_sql_mask('text')} AS masked FROM documents")
def sec_mask_pii_documents(t):
    return t.documents.select("doc_id", security.mask_pii(F.col("text")).alias("masked"))


def _sql_injection(c: str) -> str:
    folded = f"regexp_replace(lower(regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]', '', 'g')), '[\\s\\W]+', ' ', 'g')"
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '(?i){p}') OR regexp_matches({folded}, '(?i){p}') THEN '{name}'" for name, p in security.INJECTION) + " END"


@query(f"SELECT page_id, {_sql_injection('html')} AS pattern FROM pages")
def sec_injection(t):
    return t.pages.select("page_id", security.injection(F.col("html")).alias("pattern"))


@query(f"SELECT conv_id, turn, {_sql_injection('text')} AS pattern FROM conversations")
def sec_injection_conversations(t):
    return t.conversations.select("conv_id", "turn", security.injection(F.col("text")).alias("pattern"))


@query("SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))) AS digest FROM pages")
def str_html_clean(t):
    return t.pages.select("page_id", F.md5(text.clean_html(F.col("html"))).alias("digest"))


def iso_said(key: str, date: str) -> str:
    """A date as several sources write it, in words that both engines read."""
    y, m, d = f"CAST(year({date}) AS STRING)", f"lpad(CAST(month({date}) AS STRING), 2, '0')", f"lpad(CAST(day({date}) AS STRING), 2, '0')"
    return f"""CASE {key} % 7 WHEN 0 THEN {y} || '-' || {m} || '-' || {d} WHEN 1 THEN {y} || '-' || {m} || '-' || {d} || 'T12:30:00.000Z' WHEN 2 THEN {m} || '/' || {d} || '/' || {y}
        WHEN 3 THEN 'n/d' WHEN 4 THEN {y} || '-' || {m} WHEN 5 THEN {m} || '/' || {y} ELSE {d} || '.' || {m} || '.' || {y} END"""


def iso_sql(key: str, date: str, table: str) -> str:
    return f"""WITH s AS (SELECT {key}, {iso_said(key, date)} AS said FROM {table}), i AS (SELECT {key}, CASE WHEN regexp_matches(said, '^[0-9]{{4}}-.{{5}}') THEN substr(said, 1, 10)
        WHEN regexp_matches(said, '^../.{{3}}[0-9]{{4}}') THEN substr(said, 7, 4) || '-' || substr(said, 1, 2) || '-' || substr(said, 4, 2) ELSE '' END AS iso FROM s)
        SELECT {key}, iso, CASE WHEN iso = '' THEN 'desconhecido' ELSE substr(iso, 1, 4) END AS year FROM i"""


@query(iso_sql("o_orderkey", "o_orderdate", "orders"))
def dt_iso_multi(t):
    said = F.expr(iso_said("o_orderkey", "o_orderdate"))
    return t.orders.select("o_orderkey", text.iso_date(said).alias("iso"), text.year_or_unknown(said).alias("year"))


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour FROM events")
def dt_parts(t):
    return t.events.select("event_id", F.year("ts").alias("year"), F.month("ts").alias("month"), F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def src_report_json(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("""SELECT conv_id, count(*) FILTER (role = 'assistant') AS n_assistant, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def arr_to_chat(t):
    said = F.sort_array(F.collect_list(F.struct("turn", "role")))  # of a conversation's texts none are gathered
    chats = t.conversations.select("conv_id", "turn", "role").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n_assistant"), said.alias("turns"))
    return chats.select("conv_id", "n_assistant", F.array_join(F.transform("turns", lambda m: m.getField("role")), ">").alias("roles"))


# --- retrieval and evaluation ---------------------------------------------------------------------

BM25_SQL = """WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
    dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, s GROUP BY term, n),
    idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    q AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
    sc AS (SELECT query_id, doc_id AS chunk_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), s GROUP BY 1, 2),
    bm AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 10)"""


def _bm25(t: Tables, k: int = 10) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.bm25(docs, t.benchmark.select(F.col("item_id").alias("query_id"), "text"), k)


@query(BM25_SQL + " SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM bm")
def ret_bm25_global(t):
    return _bm25(t).select("query_id", "chunk_id", "rank")


EVAL_SQL = BM25_SQL + """, gold AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    n AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1), h AS (SELECT query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, min(rank) AS f FROM bm JOIN gold USING (query_id, chunk_id) GROUP BY 1)
    SELECT query_id, n_gold, round(coalesce(h1, 0) / n_gold, 6) AS recall_1, round(coalesce(h3, 0) / n_gold, 6) AS recall_3, round(coalesce(h5, 0) / n_gold, 6) AS recall_5, round(coalesce(h10, 0) / n_gold, 6) AS recall_10,
    CAST(coalesce(h5, 0) > 0 AS INTEGER) AS hit_5, round(coalesce(1.0::DOUBLE / f, 0), 6) AS rr FROM n LEFT JOIN h USING (query_id)"""


@query(EVAL_SQL)
def ev_recall_at_k(t):
    return retrieval.evaluate(_bm25(t), gold(t))


def gold(t: Tables) -> DataFrame:
    """(query_id, chunk_id): the documents that hold a benchmark passage."""
    return places(t).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id")).distinct()


DENSE_SQL = """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id AS chunk_id, round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q),
    d AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10)"""


def _dense(t: Tables, k: int = 10) -> DataFrame:
    asked = t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.dense(t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), asked, k)


@query(DENSE_SQL + " SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, score FROM d")
def ret_dense_topk(t):
    return _dense(t).select("query_id", "chunk_id", "rank", "score")


@query("""WITH s AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) AS a, avg(toxic) AS b FROM labels) SELECT n, CASE WHEN a * b + (1 - a) * (1 - b) = 1 THEN 1.0 ELSE round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 4) END AS kappa FROM s""")
def ev_cohen_kappa(t):
    return metrics.cohen_kappa(t.labels, "quality", "toxic")


@query("""WITH x AS (SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS m FROM x)
    SELECT round((sum(m) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r""")
def ev_auc(t):
    return metrics.auc(t.documents.join(t.labels, "doc_id"), "n_chars", "quality")


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic <> 1) AS b10, count(*) FILTER (quality <> 1 AND toxic = 1) AS b01 FROM labels) SELECT b10, b01, CASE WHEN b10 + b01 > 0 THEN round(pow(greatest(abs(b10 - b01) - 1, 0), 2) / (b10 + b01), 6) ELSE 0 END AS chi2 FROM c""")
def ev_mcnemar(t):
    return metrics.mcnemar(t.labels, "quality", "toxic")


@query("""WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY 1), w AS (SELECT *, k::DOUBLE / n AS p, 3.8416::DOUBLE AS zz FROM g)
    SELECT source, n, k, round_even(least(greatest((p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n), 0), 1), 3) AS lo,
    round_even(least(greatest((p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n), 0), 1), 3) AS hi FROM w""")
def ev_wilson(t):
    g = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    lo, hi = metrics.wilson(F.col("k"), F.col("n"))
    return g.select("source", "n", "k", lo.alias("lo"), hi.alias("hi"))


@query("""WITH b AS (SELECT value AS v FROM events WHERE day(ts) <= 15), r AS (SELECT value AS v FROM events WHERE day(ts) > 15), c AS (SELECT quantile_cont(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS cuts FROM b),
    bb AS (SELECT len(list_filter(cuts, lambda x: x <= v)) AS bin, count(*) / sum(count(*)) OVER () AS p FROM b, c GROUP BY 1), rr AS (SELECT len(list_filter(cuts, lambda x: x <= v)) AS bin, count(*) / sum(count(*)) OVER () AS p FROM r, c GROUP BY 1),
    j AS (SELECT greatest(coalesce(bb.p, 0), 1e-6) AS b, greatest(coalesce(rr.p, 0), 1e-6) AS r FROM bb FULL JOIN rr ON bb.bin = rr.bin), s AS (SELECT round(sum((r - b) * ln(r / b)), 4) AS psi FROM j)
    SELECT psi, CASE WHEN psi < 0.1 THEN 'estavel' WHEN psi < 0.25 THEN 'moderado' ELSE 'severo' END AS status FROM s""")
def ev_psi(t):
    return metrics.psi(t.events.filter(F.day("ts") <= 15), t.events.filter(F.day("ts") > 15), "value")


@query("""WITH m(name, value) AS (SELECT 'n_orders', count(*)::DOUBLE FROM orders UNION ALL SELECT 'n_labels', count(*)::DOUBLE FROM labels), r(name, op, floor) AS (VALUES ('n_orders', '>=', 1.0), ('n_labels', '<=', 1.0), ('absent', '==', 0.0))
    SELECT r.name, coalesce(CASE op WHEN '>=' THEN value >= floor WHEN '<=' THEN value <= floor ELSE value = floor END, false) AS passed FROM r LEFT JOIN m USING (name)""")
def ev_gate(t):
    rules = t.spark.createDataFrame([("n_orders", ">=", 1.0), ("n_labels", "<=", 1.0), ("absent", "==", 0.0)], "name string, op string, floor double")
    one = lambda df, name: df.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("name"), "value")
    return metrics.gate(rules, one(t.orders, "n_orders").unionByName(one(t.labels, "n_labels"))).select("name", "passed")


@query("""WITH x AS (SELECT n_chars::DOUBLE AS s, quality AS y FROM documents JOIN labels USING (doc_id)), e AS (SELECT min(s) AS lo, max(s) AS hi FROM x), g AS (SELECT lo + i * (hi - lo) / 59 AS t FROM e, range(60) r(i)),
    c AS (SELECT t, count(*) FILTER (y = 1 AND s >= t) / count(*) FILTER (y = 1) AS cov, count(*) FILTER (y = 0 AND s < t) / count(*) FILTER (y = 0) AS spec FROM g, x GROUP BY t)
    SELECT round(t, 6) AS threshold, round(cov, 6) AS coverage, round(spec, 6) AS specificity, round(cov + spec - 1, 6) AS youden FROM c""")
def ev_threshold_sweep(t):
    x = t.documents.join(t.labels, "doc_id").select(F.col("n_chars").cast("double").alias("s"), "quality")
    return metrics.threshold_sweep(x, "s", "quality")


@query("""WITH x AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42|' || doc_id), doc_id) AS lap FROM documents)
    SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY lap, source) AS r FROM x) WHERE r <= 30""")
def win_round_robin(t):
    lap = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.md5(F.concat(F.lit("42|"), F.col("doc_id").cast("string"))), "doc_id"))
    x = t.documents.select("doc_id", "source", "lang").withColumn("lap", lap).filter("lap <= 30")  # no later lap can be among the first 30
    return x.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("lap", "source"))).filter("r <= 30").select("lang", "doc_id")


@query("""WITH g AS (SELECT source, row_number() OVER (ORDER BY md5('42|' || source), source) AS r FROM (SELECT DISTINCT source FROM documents)) SELECT d.doc_id, (g.r <= 4) AS held_out FROM documents d JOIN g USING (source)""")
def ml_split_group(t):
    groups = t.documents.select("source").distinct().withColumn("r", F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit("42|"), F.col("source"))), "source")))
    return t.documents.join(groups, "source").select("doc_id", (F.col("r") <= 4).alias("held_out"))


# --- agreement, windows of time, and what SQL cannot say -----------------------------------------


@query("""WITH v AS (SELECT doc_id, quality AS vote FROM labels UNION ALL SELECT doc_id, toxic FROM labels),
    c AS (SELECT doc_id, vote, count(*) AS c FROM v GROUP BY 1, 2), i AS (SELECT doc_id, sum(c) AS n, sum(c * c) AS sq FROM c GROUP BY 1),
    p AS (SELECT avg((sq - n) / nullif(n * (n - 1), 0)) AS p FROM i),
    e AS (SELECT sum(c * c) / power(sum(c), 2) AS pe FROM (SELECT vote, sum(c) AS c FROM c GROUP BY 1))
    SELECT CASE WHEN pe = 1 THEN 1.0 ELSE round((p - pe) / nullif(1 - pe, 0), 4) END AS kappa FROM p, e""")
def ev_fleiss_kappa(t):
    votes = t.labels.select("doc_id", F.col("quality").alias("vote")).unionAll(t.labels.select("doc_id", F.col("toxic").alias("vote")))
    return metrics.fleiss_kappa(votes, "doc_id", "vote")


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp,
    count(*) FILTER (quality = 0 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels)
    SELECT *, coalesce(round(tp / nullif(tp + fp, 0), 4), 0.0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 4), 0.0) AS recall,
    coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 4), 0.0) AS f1 FROM c""")
def ml_metrics(t):
    return metrics.confusion(t.labels, "quality", "toxic")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_windowed_counts(t):
    return masking.windowed_counts(t.events, "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query()
def ts_models(t):
    return forecast.backtest_models(nation_monthly(t), "nation").withColumn("mape", F.round("mape", 4))


@query()
def ts_gb_recursive(t):
    return forecast.boosted_recursive(nation_monthly(t), "nation").withColumn("mape", F.round("mape", 4))


@query(f"SELECT doc_id, chunk_no AS part, start, stop AS end, md5(substr(text, start + 1, stop - start)) AS digest FROM ({CHUNKS})")
def chk_selector(t):
    return clauses.chunker("janela")(t.documents, "doc_id", "text").select("doc_id", "part", "start", "end", F.md5("chunk").alias("digest"))


@query()
def chk_clause(t):
    return clauses.clause_chunks(t.documents, "doc_id", "text")


from . import evaluation, extraction, ingest, reports, streams, warehouse  # noqa: E402, F401  they register their queries

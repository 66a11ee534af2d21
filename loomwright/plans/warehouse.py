"""Registered queries of files written and read again, the star schema's access layer, and profiles."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import extract, text
from ..operators import learn, quantiles, retrieval, star
from ..sources import files, sinks
from .registry import CHUNKS, NATION_MONTHLY, PLACES, nation_monthly, nation_orders, orders_monthly, query
from .registry import places as passage_places

# --- written and read again ----------------------------------------------------------------------

_PARTITIONED: dict[tuple, tuple[str, StructType]] = {}


def by_year(t):
    """Orders in a folder for each year, written once in a session for each state of the tables' file."""
    key = (t.spark.sparkContext.applicationId, files.file_state(t.spark, f"{t.sf_dir}/orders.parquet"))
    if key[1] is None or key not in _PARTITIONED:
        path = sinks.scratch(t.spark, "orders")
        dealt = t.orders.withColumn("year", F.year("o_orderdate")).repartition("year", F.pmod(F.xxhash64("o_orderkey"), F.lit(4)))  # a year to four tasks
        files.write_partitioned(dealt, path, "year")
        _PARTITIONED[key] = path, dealt.schema
    path, schema = _PARTITIONED[key]
    return t.spark.read.schema(schema).parquet(path)


@query("SELECT o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders WHERE year(o_orderdate) = 1999 GROUP BY 1")
def flt_partition_eq(t):
    return by_year(t).filter("year = 1999").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_customers"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def src_parquet_hive(t):
    return by_year(t).groupBy("year").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS flag, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def src_parquet_cols(t):
    return t.lineitem.select("l_returnflag", "l_quantity").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT p_partkey, p_name, p_size FROM part")
def snk_parquet(t):
    path = sinks.scratch(t.spark, "part")
    t.part.select("p_partkey", "p_name", "p_size").write.parquet(path)
    return t.spark.read.parquet(path)


@query("SELECT item_id, text FROM benchmark")
def snk_jsonl(t):
    path = sinks.scratch(t.spark, "items")
    sinks.write_json_lines(t.benchmark.select("item_id", "text"), path)
    return t.spark.read.schema("item_id long, text string").json(path)


@query("SELECT conv_id, turn, role, text FROM conversations")
def src_jsonl(t):
    path = sinks.scratch(t.spark, "turns")
    sinks.write_json_lines(t.conversations, path)
    return t.spark.read.schema("conv_id long, turn long, role string, text string").json(path)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(quality AS VARCHAR) AS relevante FROM labels")
def snk_csv_bom(t):
    path = sinks.scratch(t.spark, "labels")
    sinks.write_csv_bom(t.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("relevante")), path)
    return sinks.read_csv_bom(t.spark, path)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(quality AS INTEGER) AS label FROM labels")
def src_csv_xlsx_labels(t):
    path = sinks.scratch(t.spark, "annotated")
    t.labels.select(F.concat(F.col("doc_id").cast("string"), F.lit(".0")).alias("id"), F.concat(F.lit(" "), F.col("quality").cast("string")).alias("relevante")).unionByName(
        t.labels.select(F.col("doc_id").cast("string").alias("id"), F.lit("x").alias("relevante"))).write.option("header", True).option("sep", ";").csv(path)
    return files.read_labels(t.spark, path)


@query("""SELECT c_custkey || '' AS c_custkey, c_name || ', "the"' || chr(10) || 'first' AS c_name FROM customer WHERE c_custkey % 2 = 0""")
def src_csv_quoted(t):
    path = sinks.scratch(t.spark, "customers")
    rows = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("c_custkey"), F.concat("c_name", F.lit(', "the"\nfirst')).alias("c_name"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return files.read_csv_quoted(t.spark, path, ["c_custkey", "c_name"])[0]


@query("SELECT n_name AS praca, CAST(n_regionkey AS VARCHAR) AS regiao FROM nation")
def src_csv_latin1(t):
    path = sinks.scratch(t.spark, "nations")
    t.nation.select(F.concat(F.lit("ação "), "n_name").alias("praca"), F.col("n_regionkey").cast("string").alias("regiao")).write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    rows = files.read_csv_latin1(t.spark, path, ["praca", "regiao"])
    return rows.select(F.regexp_replace("praca", "^ação ", "").alias("praca"), "regiao")


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, 'orders' AS source FROM orders")
def snk_json_report(t):
    path = sinks.scratch(t.spark, "report")
    sinks.write_report(t.orders.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), path, source="orders")
    return t.spark.read.schema("n long, total double, source string").json(path)


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def snk_ctas(t):
    made = sinks.replace_table(t.customer.select("c_custkey", "c_mktsegment"), f"loomwright_customers_{uuid.uuid4().hex}", sinks.scratch(t.spark, "table"))
    return made.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, substr(text, 1, 320) AS texto, length(text) > 320 AS truncado FROM documents")
def snk_vector_export(t):
    head, cut = extract.preview(F.col("text"))
    path = sinks.scratch(t.spark, "preview")
    sinks.write_json_lines(t.documents.select("doc_id", head.alias("texto"), cut.alias("truncado")), path)
    return t.spark.read.schema("doc_id long, texto string, truncado boolean").json(path)


SEARCH = """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS chunk_id, round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q WHERE {})
    SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5"""


def collection(t):
    """The collection of vectors made anew: (chunk_id, v, label)."""
    path = sinks.scratch(t.spark, "vectors")
    t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label").write.mode("overwrite").parquet(path)
    return t.spark.read.parquet(path)


def asked_vectors(t):
    return t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(SEARCH.format("true"))
def ret_vector_search(t):
    return retrieval.dense(collection(t), asked_vectors(t), 5).select("query_id", "chunk_id", "score", "rank")


@query(SEARCH.format("label % 2 = 0"))
def flt_payload_match(t):
    return retrieval.dense(collection(t).filter("label % 2 = 0"), asked_vectors(t), 5).select("query_id", "chunk_id", "score", "rank")


# --- the star schema's access layer ----------------------------------------------------------------


@query("SELECT count(*) AS n_read, count(*) FILTER (l_discount > 0.05) AS n_valid, count(*) FILTER (NOT l_discount > 0.05) AS n_rejected FROM lineitem")
def flt_valid_row(t):
    good = F.col("l_shipdate").isNotNull() & F.col("l_discount").isNotNull() & (F.col("l_discount") > 0.05)
    return t.lineitem.agg(F.count("*").alias("n_read"), F.count_if(good).alias("n_valid"), F.count_if(~good).alias("n_rejected"))


@query("SELECT least(count(*), 100) AS n FROM orders WHERE o_totalprice > 0")
def flt_limit_scan(t):
    return t.orders.filter("o_totalprice > 0").limit(100).agg(F.count("*").alias("n"))


SEGMENTS = "(SELECT row_number() OVER (ORDER BY c_mktsegment, n_name) AS place_id, c_mktsegment, n_name FROM (SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey))"
PLACED = f"(SELECT place_id, d.c_mktsegment, d.n_name, date_trunc('month', o_orderdate) AS m, o_totalprice AS v, o_orderstatus, o_orderpriority, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN {SEGMENTS} d USING (c_mktsegment, n_name))"


def places(t):
    """The dimension of places: (place_id, c_mktsegment, n_name)."""
    return star.keyed(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")), ["c_mktsegment", "n_name"], "place_id")


def facts(t):
    """Orders with the key of their place, met by both parts of its natural key."""
    return nation_orders(t).join(places(t), ["c_mktsegment", "n_name"])


@query(f"SELECT CAST(place_id AS BIGINT) AS place_id, count(*) AS n, round(sum(v), 2) AS total FROM {PLACED} GROUP BY 1")
def jn_two_key(t):
    return facts(t).groupBy(F.col("place_id").cast("long").alias("place_id")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT CAST(quarter(o_orderdate) AS INTEGER) AS quarter, count(*) AS n FROM orders GROUP BY 1")
def jn_time_dim(t):
    months = star.calendar(t.orders.select(F.trunc("o_orderdate", "month").alias("month")))
    return t.orders.select(F.trunc("o_orderdate", "month").alias("month")).join(months, "month").groupBy("quarter").agg(F.count("*").alias("n"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice) / 1000000, 3) AS millions FROM orders GROUP BY 1")
def agg_volume_year(t):
    months = star.calendar(t.orders.select(F.trunc("o_orderdate", "month").alias("month")))
    totals = orders_monthly(t).join(months, "month")
    return totals.groupBy("year").agg(F.round(F.sum("total") / 1000000, 3).alias("millions"))


@query(f"SELECT strftime(m, '%Y-%m-%d') AS month, round(total, 2) AS total FROM ({NATION_MONTHLY}) WHERE nation = 'NATION_3'")
def agg_series(t):
    return star.series_of(nation_monthly(t), "nation", "NATION_3").select(F.date_format("month", "yyyy-MM-dd").alias("month"), F.round("total", 2).alias("total"))


@query("SELECT coalesce(round(sum(o_totalprice), 2), 0.0) AS total FROM orders WHERE o_orderpriority = '1-URGENT'")
def flt_eq_param(t):
    return t.spark.sql("SELECT coalesce(round(sum(o_totalprice), 2), 0.0D) AS total FROM {orders} WHERE o_orderpriority = :p", args={"p": "1-URGENT"}, orders=t.orders)


@query(f"SELECT CAST(place_id AS BIGINT) AS place_id, n_name AS name, round(max(v), 2) AS most FROM {PLACED} GROUP BY 1, 2")
def jn_lookup(t):
    most = facts(t).groupBy("place_id").agg(F.round(F.max("o_totalprice"), 2).alias("most"))
    return most.join(places(t), "place_id").select(F.col("place_id").cast("long").alias("place_id"), F.col("n_name").alias("name"), "most")


@query(f"SELECT count(*) AS n, round(sum(t), 2) AS total FROM (SELECT m, c_mktsegment, n_name, o_orderstatus, o_orderpriority, place_id, sum(v) AS t FROM {PLACED} GROUP BY ALL)")
def agg_regrain_month(t):
    month = F.trunc("o_orderdate", "month").alias("month")
    grains = facts(t).groupBy(month, "c_mktsegment", "n_name", "o_orderstatus", "o_orderpriority", "place_id").agg(F.sum("o_totalprice").alias("t"))
    return grains.agg(F.count("*").alias("n"), F.round(F.sum("t"), 2).alias("total"))


@query("""SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'places', count(*) FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)
    UNION ALL SELECT 'months', count(DISTINCT date_trunc('month', o_orderdate)) FROM orders""")
def agg_table_counts(t):
    months = star.calendar(t.orders.select(F.trunc("o_orderdate", "month").alias("month")))
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in (("orders", t.orders), ("places", places(t)), ("months", months))])


@query(f"""SELECT count(*) AS n_rows, count(*) FILTER (v <= 100000) AS n_kept, strftime(min(m), '%Y-%m-%d') AS first, strftime(max(m), '%Y-%m-%d') AS last, count(DISTINCT n_name) AS n_operators, count(DISTINCT place_id) AS n_places, round(sum(v) / 1e9, 3) AS billions FROM {PLACED}""")
def agg_volume_profile(t):
    m, day = F.trunc("o_orderdate", "month"), lambda c: F.date_format(c, "yyyy-MM-dd")
    return facts(t).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("o_totalprice") <= 100000).alias("n_kept"), day(F.min(m)).alias("first"), day(F.max(m)).alias("last"),
        F.countDistinct("n_name").alias("n_operators"), F.countDistinct("place_id").alias("n_places"), F.round(F.sum("o_totalprice") / 1e9, 3).alias("billions"),
    )


@query("""WITH m AS (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n FROM events WHERE event_id % 7 = 0 GROUP BY 1, 2), e AS (SELECT event_type, min(d) AS a, max(d) AS b FROM m GROUP BY 1),
    g AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM e) SELECT event_type, strftime(d, '%Y-%m-%d') AS day, coalesce(n, -1) AS n FROM g LEFT JOIN m USING (event_type, d)""")
def dt_asfreq(t):
    days = t.events.filter("event_id % 7 = 0").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return star.filled(days, "event_type", "day", "day").select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(-1)).alias("n"))


@query("""WITH r AS (SELECT date_trunc('month', o_orderdate) AS m, o_totalprice AS v, dense_rank() OVER (ORDER BY date_trunc('month', o_orderdate) DESC) AS r FROM orders)
    SELECT CASE WHEN r <= 12 THEN 'recent' ELSE 'before' END AS period, count(*) AS n, round(sum(v), 2) AS total FROM r WHERE r <= 24 GROUP BY 1""")
def win_last_n_periods(t):
    named = star.last_periods(t.orders, F.trunc("o_orderdate", "month"), 12)
    return named.groupBy("period").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


PSI_COHORT = f"""WITH s AS ({NATION_MONTHLY}), r AS (SELECT *, dense_rank() OVER (ORDER BY m DESC) AS r FROM s), a AS (SELECT nation, total AS v FROM r WHERE r <= 12), b AS (SELECT nation, total AS v FROM r WHERE r BETWEEN 13 AND 24),
    k AS (SELECT nation FROM a INTERSECT SELECT nation FROM b), c AS (SELECT quantile_cont(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS cuts FROM b SEMI JOIN k USING (nation)),
    bb AS (SELECT len(list_filter(cuts, lambda x: x <= v)) AS bin, count(*) / sum(count(*)) OVER () AS p FROM b SEMI JOIN k USING (nation), c GROUP BY 1), rr AS (SELECT len(list_filter(cuts, lambda x: x <= v)) AS bin, count(*) / sum(count(*)) OVER () AS p FROM a SEMI JOIN k USING (nation), c GROUP BY 1),
    j AS (SELECT greatest(coalesce(bb.p, 0), 1e-6) AS b, greatest(coalesce(rr.p, 0), 1e-6) AS r FROM bb FULL JOIN rr ON bb.bin = rr.bin), z AS (SELECT round(sum((r - b) * ln(r / b)), 4) AS psi FROM j)
    SELECT psi, CASE WHEN psi < 0.1 THEN 'estavel' WHEN psi < 0.25 THEN 'moderado' ELSE 'severo' END AS status FROM z"""


@query(PSI_COHORT)
def ev_drift_pipeline(t):
    return star.drift(nation_monthly(t), "nation")


# --- profiles, unions, feature columns ---------------------------------------------------------------


@query("SELECT year, sum(n)::BIGINT AS n FROM (SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT year(l_shipdate)::INTEGER, count(*) FROM lineitem GROUP BY 1) GROUP BY 1")
def set_union_all(t):
    years = t.orders.select(F.year("o_orderdate").alias("year")).unionByName(t.lineitem.select(F.year("l_shipdate").alias("year")))
    return years.groupBy("year").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_docs, count(*) FILTER (lang = 'en') AS n_in_force, sum(CASE WHEN length(text) > 0 THEN greatest(1, ceil((length(text) - 200) / 1300.0)) ELSE 0 END)::BIGINT AS n_chunks FROM documents")
def agg_corpus_stats(t):
    n = F.size(text.window_starts(F.col("text"), 1500, 200))
    return t.documents.agg(F.count("*").alias("n_docs"), F.count_if(F.col("lang") == "en").alias("n_in_force"), F.sum(F.greatest(n, F.lit(0))).cast("long").alias("n_chunks"))


@query("SELECT min(n) AS least, max(n) AS most, round(avg(mean)) AS mean FROM (SELECT source, count(*) AS n, avg(n_chars) AS mean FROM documents GROUP BY 1)")
def agg_group_minmax_mean(t):
    per = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"))
    return per.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("mean")).alias("mean"))


@query("SELECT CAST(label AS INTEGER) AS cluster, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS a, round(avg(embedding[2]::DOUBLE), 6) AS b FROM embeddings GROUP BY 1")
def agg_cluster_profile(t):
    mean = lambda i: F.round(F.avg(F.element_at("embedding", i).cast("double")), 6)
    return t.embeddings.groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("n"), mean(1).alias("a"), mean(2).alias("b"))


@query("SELECT o_orderpriority AS priority, coalesce(round(avg(o_totalprice) FILTER (o_totalprice > 400000), 4), 0) AS mean FROM orders GROUP BY 1")
def agg_mean_round(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.coalesce(F.round(F.avg(F.when(F.col("o_totalprice") > 400000, F.col("o_totalprice"))), 4), F.lit(0.0)).alias("mean"))


@query("SELECT event_type, round(quantile_disc(value, 0.5), 3) AS p50, round(quantile_disc(value, 0.95), 3) AS p95, round(avg(value), 3) AS mean, round(count(*) FILTER (user_id % 3 = 0) / count(*), 3) AS hit_rate FROM events GROUP BY 1")
def agg_latency(t):
    parts = quantiles.exact_quantiles(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    means = t.events.groupBy("event_type").agg(F.round(F.avg("value"), 3).alias("mean"), F.round(F.count_if(F.col("user_id") % 3 == 0) / F.count("*"), 3).alias("hit_rate"))
    return means.join(parts, "event_type").select("event_type", F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"), "mean", "hit_rate")


@query("""WITH v AS (SELECT doc_id, quality AS vote FROM labels UNION ALL SELECT doc_id, toxic FROM labels UNION ALL SELECT doc_id, doc_id % 2 FROM labels), c AS (SELECT doc_id, vote, count(*) AS c FROM v GROUP BY 1, 2)
    SELECT doc_id, CAST(vote AS BIGINT) AS label FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, vote) = 1""")
def agg_majority(t):
    one = lambda c: t.labels.select("doc_id", c.cast("long").alias("vote"))
    votes = one(F.col("quality")).unionByName(one(F.col("toxic"))).unionByName(one(F.col("doc_id") % 2))
    return votes.groupBy("doc_id", "vote").agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.min_by("vote", F.struct(-F.col("c"), "vote")).alias("label"))


@query("SELECT l_orderkey, l_linenumber, round(l_discount + l_tax, 4) AS rates, CAST(l_discount + l_tax > 0 AS INTEGER) AS any_rate FROM lineitem")
def prj_sum_columns(t):
    total = star.sum_columns("l_discount", "l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(total, 4).alias("rates"), (total > 0).cast("int").alias("any_rate"))


@query("SELECT CAST(l_returnflag = 'R' AS INTEGER) AS target, count(*) AS n FROM lineitem GROUP BY 1")
def prj_binary_target(t):
    return t.lineitem.groupBy((F.col("l_returnflag") == "R").cast("int").alias("target")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, round(avg(l_quantity), 4) AS quantity, 'l_linestatus, l_returnflag' AS told FROM lineitem")
def prj_leakage_guard(t):
    """The whole table is refused, as two of its columns tell the outcome; without these it passes."""
    outcomes, told = ["l_returnflag", "l_linestatus", "absent"], []
    try:
        learn.without_outcomes(t.lineitem, outcomes)
    except ValueError:
        told = sorted(set(t.lineitem.columns) & set(outcomes))
    kept = learn.without_outcomes(t.lineitem.drop(*told), outcomes)
    return kept.agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("quantity"), F.lit(", ".join(told)).alias("told"))


@query(f"""WITH c AS (SELECT doc_id, count(*) AS n FROM ({CHUNKS}) GROUP BY 1) SELECT CASE WHEN n < 2 THEN '1' WHEN n < 5 THEN '2-4' WHEN n < 10 THEN '5-9' ELSE '10+' END AS bucket, count(*) AS n_docs, sum(n)::BIGINT AS n_chunks, max(n) AS most FROM c GROUP BY 1""")
def agg_chunker_diag(t):
    n = t.documents.select(F.size(text.window_starts(F.col("text"), 1500, 200)).alias("n")).filter("n > 0")
    bucket = F.when(F.col("n") < 2, "1").when(F.col("n") < 5, "2-4").when(F.col("n") < 10, "5-9").otherwise("10+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_docs"), F.sum("n").cast("long").alias("n_chunks"), F.max(F.col("n").cast("long")).alias("most"))


@query(f"""WITH {PLACES}, k AS (SELECT p.text, p.passage, s.a + s.item_id % 2 AS place FROM s JOIN p USING (doc_id, item_id))
    SELECT count(*) AS n_spans, count(*) FILTER (substr(text, CAST(place + 1 AS BIGINT), length(passage)) <> passage) AS n_off FROM k""")
def agg_offset_audit(t):
    """Noted places of passages held against the texts; those of odd items were noted one character late."""
    noted = passage_places(t).select("doc_id", "item_id", (F.col("start") + F.col("item_id") % 2).cast("int").alias("start"))
    said = noted.join(t.documents.select("doc_id", "text"), "doc_id").join(t.benchmark.select("item_id", F.col("text").alias("passage")), "item_id")
    off = F.substring(F.col("text"), F.col("start") + 1, F.length("passage")) != F.col("passage")
    return said.agg(F.count("*").alias("n_spans"), F.count_if(off).alias("n_off"))


NOTED = "CASE {0} % 4 WHEN 0 THEN ' ' || {0} || '.0' WHEN 1 THEN {0} || ' ' WHEN 2 THEN {0} || '.00 ' ELSE CAST({0} AS STRING) END"
PLAIN = "split_part(trim(" + NOTED + "), '.', 1)"


@query(f"""SELECT CAST(a.id AS BIGINT) AS doc_id, first, second FROM (SELECT {PLAIN.format('doc_id')} AS id, quality AS first FROM labels) a
    JOIN (SELECT {PLAIN.format('(doc_id + 1)')} AS id, toxic AS second FROM labels) b ON a.id = b.id""")
def jn_annotators(t):
    """Two annotators' sheets, of which the second is a row behind, met by ids that each wrote differently."""
    norm = lambda c: F.element_at(F.split(F.trim(c), r"\."), 1)
    one = t.labels.select(norm(F.expr(NOTED.format("doc_id"))).alias("id"), F.col("quality").alias("first"))
    two = t.labels.select(norm(F.expr(NOTED.format("(doc_id + 1)"))).alias("id"), F.col("toxic").alias("second"))
    return one.join(two, "id").select(F.col("id").cast("long").alias("doc_id"), "first", "second")


RATES = "SELECT source, round(avg(CASE WHEN lang = '{0}' THEN 1.0::DOUBLE ELSE 0 END), 4) AS r FROM documents GROUP BY 1"


def _rates(t, lang, name):
    return t.documents.groupBy("source").agg(F.round(F.avg(F.when(F.col("lang") == lang, 1.0).otherwise(0.0)), 4).alias(name))


@query(f"SELECT a.source, a.r AS a, b.r AS b, round(b.r - a.r, 4) AS delta FROM ({RATES.format('en')}) a JOIN ({RATES.format('fr')}) b USING (source)")
def jn_delta_report(t):
    return _rates(t, "en", "a").join(_rates(t, "fr", "b"), "source").select("source", "a", "b", F.round(F.col("b") - F.col("a"), 4).alias("delta")).orderBy(F.desc("delta"))


@query(f"SELECT a.source, a.r AS a, b.r AS b, c.r AS c, round(c.r - greatest(a.r, b.r), 4) AS over_best FROM ({RATES.format('en')}) a JOIN ({RATES.format('fr')}) b USING (source) JOIN ({RATES.format('de')}) c USING (source)")
def jn_three_way_report(t):
    all3 = _rates(t, "en", "a").join(_rates(t, "fr", "b"), "source").join(_rates(t, "de", "c"), "source")
    return all3.select("source", "a", "b", "c", F.round(F.col("c") - F.greatest("a", "b"), 4).alias("over_best")).orderBy(F.desc("over_best"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, lang")
def srt_dict_by_value(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


@query("SELECT a.item_id, md5(coalesce(a.text, '') || chr(10) || coalesce(b.text, '')) AS digest FROM benchmark a LEFT JOIN benchmark b ON b.item_id = a.item_id + 3")
def jn_reference_lookup(t):
    wanted = t.benchmark.select("item_id", F.posexplode(F.array(F.col("item_id"), F.col("item_id") + 3)).alias("place", "ref"))
    known = t.benchmark.select(F.col("item_id").alias("ref"), "text")
    met = wanted.join(known, "ref", "left").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text")))).alias("rows"))
    return met.select("item_id", F.md5(F.array_join(F.transform("rows", lambda r: r.getField("text")), "\n")).alias("digest"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) - 1) / count(*) OVER (PARTITION BY quality)::DOUBLE >= 0.8 AS held_out FROM labels")
def ml_split_stratified(t):
    return learn.split_stratified(t.labels, "doc_id", "quality", 0.8).select("doc_id", "held_out")


@query("SELECT doc_id FROM labels ORDER BY md5('42|' || doc_id), doc_id LIMIT 50")
def ml_sample(t):
    return learn.sample_rows(t.labels, "doc_id", 50).select("doc_id")


@query("SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0 OR turn % 2 = 1 AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn % 2 = 0)")
def flt_in_force(t):
    rows = t.conversations.withColumn("_in", F.col("turn") % 2 == 0)
    kept = retrieval.in_force_or_all(rows, "conv_id", "_in")
    return kept.select("conv_id", "turn")


@query("SELECT count(*) AS n FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant' AND length(trim(q.text)) > 10 AND length(trim(a.text)) > 20")
def flt_min_quality_pairs(t):
    q = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    a = t.conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"]).filter((F.length(F.trim("asked")) > 10) & (F.length(F.trim("answer")) > 20)).agg(F.count("*").alias("n"))

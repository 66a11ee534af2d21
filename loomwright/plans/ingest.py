"""Registered queries of archives, file sets, merged collections, batches written once and compared results."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text
from ..operators import compare, diagnose
from ..sources import archives, files, merge, sinks
from ..streaming import ledger
from .registry import NATION_MONTHLY, PLACES, nation_monthly, places, query
from .streams import NUMERIC, labelled


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, c_name || ', "the"' || chr(10) || 'first' AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")
def src_zip64_stream(t):
    """Customers written as archives of several members, values with separators, quotes and line ends among them."""
    path = sinks.scratch(t.spark, "archives")
    name = F.concat("c_name", F.lit(', "the"\nfirst'))
    archives.write_zipped_csv(t.customer.select(F.col("c_custkey").cast("string").alias("key"), name.alias("name"), F.col("c_nationkey").cast("string").alias("nation")).repartition(3), path, 500)
    return archives.read_zipped_csv(t.spark, path, ["key", "name", "nation"]).select("key", "name", "nation")


@query("""SELECT CAST(o_orderkey % 7 = 0 AS INTEGER) AS rejected, count(*) AS n, min(CAST(o_orderkey AS VARCHAR)) AS first, max(CAST(o_orderkey AS VARCHAR)) AS last FROM orders GROUP BY 1""")
def flt_arity(t):
    """Orders as CSV, every seventh with a value too many: rows of another width are set apart whole."""
    path, key = sinks.scratch(t.spark, "widths"), F.col("o_orderkey")
    status = F.when(key % 7 == 0, F.concat("o_orderstatus", F.lit(",too many"))).otherwise(F.col("o_orderstatus"))
    t.orders.select(key.cast("string").alias("o_orderkey"), status.alias("o_orderstatus")).write.option("header", True).option("quote", "").csv(path)
    good, bad = files.read_csv_quoted(t.spark, path, ["o_orderkey", "o_orderstatus"])
    rows = good.select(F.lit(0).alias("rejected"), F.col("o_orderkey").alias("k")).unionByName(bad.select(F.lit(1).alias("rejected"), F.element_at(F.split("_bad", ","), 1).alias("k")))
    return rows.groupBy("rejected").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))


@query(f"""WITH {PLACES}, a AS (SELECT doc_id, item_id, count(*) AS n, min(a) AS first, sum(a) AS total FROM s GROUP BY 1, 2)
    SELECT CAST(a.doc_id AS VARCHAR) AS title, CAST(a.item_id AS VARCHAR) AS id, n AS n_answers, CAST(first AS BIGINT) AS first, CAST(total AS BIGINT) AS total, length(d.text) AS n_chars, md5(b.text) AS digest
    FROM a JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)""")
def src_squad_zip(t):
    """Documents with benchmark passages as contracts, the passages as questions with all their places as
    answers, written as SQuAD JSON inside archives, one for each partition, and read back."""
    path = sinks.scratch(t.spark, "squad")
    os.makedirs(path)
    found = places(t).join(t.benchmark.select("item_id", F.col("text").alias("passage")), "item_id")
    answers = F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("answer_start"), F.col("passage").alias("text"))))
    asked = found.groupBy("doc_id", "item_id").agg(answers.alias("answers"))
    qas = F.collect_list(F.struct(F.col("item_id").cast("string").alias("id"), F.concat(F.lit("item "), F.col("item_id")).alias("question"), F.lit(False).alias("is_impossible"), "answers"))
    per = asked.groupBy("doc_id").agg(qas.alias("qas")).join(t.documents.select("doc_id", F.col("text").alias("context")), "doc_id")
    said = per.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("title"), F.array(F.struct("context", "qas")).alias("paragraphs"))).alias("json"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [j for b in batches for j in b.column("json").to_pylist()]
        if rows:
            with zipfile.ZipFile(os.path.join(path, f"{TaskContext.get().partitionId()}.zip"), "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("contracts.json", '{"version": "2.0", "data": [' + ",".join(rows) + "]}")
        yield pa.record_batch({"n": pa.array([len(rows)], pa.int64())})

    said.repartition(3).mapInArrow(pack, "n long").agg({"n": "sum"}).collect()
    starts = F.transform("answers", lambda a: a["answer_start"])
    return files.read_squad_zip(t.spark, path).select(
        "title", "id", F.size("answers").cast("long").alias("n_answers"), F.array_min(starts).alias("first"), F.aggregate(starts, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.length("context").cast("long").alias("n_chars"), F.md5(F.element_at("answers", 1)["text"]).alias("digest"),
    )


def customer_files(t) -> str:
    """Customers in a folder of files for each segment, in two layouts: their names differ, and one lacks the balance."""
    path = sinks.scratch(t.spark, "segments")
    for i, (segment,) in enumerate(t.customer.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()):  # the few segments that there are
        rows = t.customer.filter(F.col("c_mktsegment") == segment).select(F.col("c_custkey").alias("código" if i % 2 else "codigo"), F.col("c_name").alias("nome"), *([F.col("c_nationkey").alias("praça")] if i % 2 else []))
        rows.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(f"{path}/clientes_{segment.lower()}__{i:04x}")
    return path


def customer_set(t):
    names = {"código": "key", "codigo": "key", "nome": "name", "praça": "nation"}
    return files.read_file_set(t.spark, customer_files(t), names, r"clientes_([^_/]+)__")


RANKED = "SELECT *, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS i FROM customer"


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, CASE WHEN i % 2 = 1 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS nation, lower(c_mktsegment) AS code FROM ({RANKED})""")
def src_glob_many(t):
    return customer_set(t).select("key", "name", "nation", "code")


@query("SELECT lower(c_mktsegment) AS code, count(*) AS n FROM customer GROUP BY 1")
def prj_file_code(t):
    return customer_set(t).groupBy("code").agg(F.count("*").alias("n"))


@query(f"SELECT lower(c_mktsegment) AS code, count(*) FILTER (i % 2 = 0) AS n_empty, count(*) FILTER (i % 2 = 1) AS n_known FROM ({RANKED}) GROUP BY 1")
def prj_complement_cols(t):
    return customer_set(t).groupBy("code").agg(F.count_if(F.col("nation") == "").alias("n_empty"), F.count_if(F.col("nation") != "").alias("n_known"))


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey, o_orderpriority AS priority FROM orders
    QUALIFY row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderpriority = '5-LOW' DESC, o_orderkey) = 1""")
def src_http_latest_per_year(t):
    """One order of each year, one of low priority before others, then the first."""
    rows = t.orders.select(F.year("o_orderdate").alias("year"), "o_orderkey", F.col("o_orderpriority").alias("priority"), (F.col("o_orderpriority") == "5-LOW").alias("preferred"))
    return files.latest_per_key(rows, "year", "preferred", "o_orderkey").select("year", "o_orderkey", "priority")


PACKED = 600


@query(f"""WITH b AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {{'done': CAST([] AS VARCHAR[]), 'open': x}}) AS bs FROM documents WHERE text IS NOT NULL),
    r AS (SELECT doc_id, list_reduce(bs, lambda a, x: CASE WHEN length(CASE WHEN a.open = '' THEN x.open ELSE a.open || chr(10) || x.open END) <= {PACKED}
        THEN {{'done': a.done, 'open': CASE WHEN a.open = '' THEN x.open ELSE a.open || chr(10) || x.open END}}
        ELSE {{'done': CASE WHEN a.open = '' THEN a.done ELSE list_append(a.done, a.open) END, 'open': x.open}} END) AS z FROM b),
    p AS (SELECT doc_id, CASE WHEN z.open = '' THEN z.done ELSE list_append(z.done, z.open) END AS packs FROM r)
    SELECT doc_id, CAST(len(packs) AS BIGINT) AS n, md5(array_to_string(packs, chr(1))) AS digest FROM p""")
def chk_pack_greedy(t):
    """Lines of documents packed into passages of up to PACKED characters; longer lines stand alone."""
    packs = text.pack_greedy(F.split("text", "\n"), PACKED)
    return t.documents.filter("text is not null").select("doc_id", packs.alias("packs")).select("doc_id", F.size("packs").cast("long").alias("n"), F.md5(F.array_join("packs", "\x01")).alias("digest"))


@query("SELECT vec_id AS chunk_id, CAST(len(embedding) AS INTEGER) AS d, CAST(CASE vec_id % 10 WHEN 0 THEN label + 100 WHEN 3 THEN label + 300 ELSE label END AS INTEGER) AS label FROM embeddings")
def snk_vector_upsert(t):
    """A collection of vectors, then new labels for some of them: two versions of a tenth, and late news, older than what is stored, of another."""
    path = sinks.scratch(t.spark, "collection")
    rows = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), F.col("label").cast("int").alias("label"), F.lit(5).alias("version"))
    again = lambda k, more, version: rows.filter(F.col("chunk_id") % 10 == k).withColumns({"label": F.col("label") + more, "version": F.lit(version)})
    merge.merge(rows, path, "chunk_id", "version", 16, exists=False)
    merge.merge(again(0, 100, 7).unionByName(again(0, 50, 6)).unionByName(again(3, 300, 5)).unionByName(again(4, 900, 4)), path, "chunk_id", "version", 16)
    return merge.keyed(t.spark, path).select("chunk_id", F.size("v").alias("d"), "label")


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS flow, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def snk_append_log(t):
    """Events of two flows appended as JSON lines, batch by batch; the second batch of each is sent twice."""
    path = sinks.scratch(t.spark, "log")
    for k, flow in enumerate(("even", "odd")):
        rows = t.events.filter(F.col("event_id") % 2 == k).select("event_id", "event_type")
        for batch in (0, 1, 1):
            ledger.write_once(rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == batch), batch, path, flow, fmt="json")
    back = ledger.ingested(t.spark, path, "event_id long, event_type string", "json")
    return back.groupBy(F.col("query").alias("flow"), "event_type").agg(F.count("*").alias("n"))


@query(f"""WITH a AS ({NATION_MONTHLY}), n AS (SELECT count(*) AS n, count(*) FILTER (nation = 'NATION_3') AS off, count(*) FILTER (nation = 'NATION_4' AND year(m) = 1999) AS gone FROM a)
    SELECT n AS n_left, n - gone AS n_right, n - gone - off AS n_same, off + gone AS only_left, off AS only_right FROM n""")
def ev_engine_compare(t):
    """Monthly totals by nation from sums of doubles and, in another order, from sums of decimals; one nation's
    are off by a cent, one year of another's is missing."""
    one = nation_monthly(t).select("nation", "month", "total")
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    other = rows.groupBy(F.col("n_name").alias("nation"), F.trunc("o_orderdate", "month").alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    other = other.filter("not (nation = 'NATION_4' and year(month) = 1999)").withColumn("total", F.col("total") + F.when(F.col("nation") == "NATION_3", 0.01).otherwise(0.0))
    return compare.compare(one, other, digits=4)[0]


@query()
def ml_learning_curve(t):
    return diagnose.learning_curve(labelled(t), "doc_id", "quality", NUMERIC, ["lang"], "logistic", (0.25, 0.5, 1.0))

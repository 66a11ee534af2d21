"""Cross-site boilerplate lines, found by how many distinct sites show them. Native Spark only.

The lines' keys are computed once and written to the checkpoint folder; texts are read again only
to take lines out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, partitions

#: What trimming takes off both ends of a line, and what stands between words.
SPACES = " \t\n\x0b\f\r"
#: A line is boilerplate from so many distinct sources on: two may be a document and its copy.
MIN_SITES = 3


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, pos, site, key): the lines of at least ``min_words`` words; key is the trimmed line's MD5."""
    exploded = docs.select("doc_id", F.col("source").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    enough = rf"^(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{min_words - 1}}}[^\x20\x09-\x0D]"
    return (
        exploded.select("doc_id", "pos", "site", F.btrim("line", F.lit(SPACES)).alias("line"))
        .filter(F.col("line").rlike(enough))
        .select("doc_id", "pos", "site", F.unhex(F.md5("line")).alias("key"))
    )


def met(lines: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """``lines`` joined with the rows (key, n, ...) of ``keys``, where n counts the lines of a key.

    Keys of over ``most`` lines go to every task, so that none of them meets in one; they are at most
    1 / ``most`` of all lines.
    """
    hot = F.broadcast(keys.filter(F.col("n") > most))
    rest = lines.join(hot.select("key"), "key", "left_anti")
    return lines.join(hot, "key").unionByName(rest.join(keys.filter(F.col("n") <= most), "key"))


def spread_lines(lines: DataFrame, most: int, min_sites: int, margin: float = 0.25, lg_k: int = 12) -> DataFrame:
    """(key, n, first): the keys seen on ``min_sites`` or more distinct sites, how often, and where
    each is kept, the first place by (doc_id, pos).

    A HyperLogLog sketch of sites for each key merges map-side and over the shuffle. Keys whose
    estimate is within ``margin`` of the threshold are counted exactly; the sketch of 2**lg_k
    registers errs by 1.6 percent at one standard deviation, so that a key outside the margin is
    decided beyond ten of them. Null sites count as none.
    """
    sketched = checkpointed(lines.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")
    ).filter(F.col("sites") >= min_sites * (1 - margin)))
    near = F.col("sites") <= min_sites * (1 + margin)
    exact = (
        met(lines, sketched.filter(near).select("key", "n"), most).filter("site is not null")
        .groupBy("key", "site").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("exactly"))
        .filter(F.col("exactly") >= min_sites).select("key")
    )
    found = sketched.filter(~near).unionByName(sketched.filter(near).join(exact, "key"))
    return checkpointed(found.select("key", "n", "first"))


def without_lines(text: Column, gone: Column) -> Column:
    """``text`` without the lines whose numbers the array ``gone`` holds."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(gone, i)), "\n")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = 5) -> DataFrame:
    """``docs`` with ``text`` less the boilerplate lines, and the counts ``n_lines`` and ``n_removed``.

    A line of ``min_words`` or more words seen on ``min_sites`` or more distinct sources stays only
    in the first document (smallest doc_id, then position) that has it. Shorter lines and all else
    stay as they are, so no wording is lost. Null texts stay null with 0 lines; an empty text is one
    empty line; repeated rows lose the same lines; rows with a null doc_id are left as they are.
    Other columns stay, whatever their names, but for n_lines and n_removed, which are replaced.
    """
    found = checkpointed(lines_of(docs.filter("doc_id is not null"), min_words))
    most = found.count() // (16 * partitions(docs.sparkSession)) + 1
    first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))
    gone = met(found, spread_lines(found, most, min_sites), most).filter(~first).groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))
    whole = docs.select(F.struct(*docs.columns).alias("doc"))  # of whatever names, apart from those here
    joined = whole.join(gone, F.col("doc.doc_id") == gone["doc_id"], "left")
    text = F.col("doc.text")
    kept = {c: F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")}
    kept["text"] = F.when(F.col("gone").isNull(), text).otherwise(without_lines(text, F.col("gone"))).alias("text")
    count = lambda array: F.when(array.isNull(), F.lit(0)).otherwise(F.size(array)).cast("long")
    return joined.select(*kept.values(), count(F.split(text, "\n")).alias("n_lines"), count(F.col("gone")).alias("n_removed"))


def oracle(min_sites: int = MIN_SITES, min_words: int = 5) -> str:
    """DuckDB SQL for (doc_id, text, n_lines, n_removed)."""
    return f"""
    WITH cut AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
    raw AS (SELECT doc_id, source, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM cut),
    trimmed AS (SELECT doc_id, source, pos, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS line FROM raw),
    lines AS (SELECT * FROM trimmed WHERE line <> '' AND len(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+')) >= {min_words}),
    spread AS (SELECT line, min(struct_pack(d := doc_id, p := pos)) AS f FROM lines GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
    gone AS (SELECT DISTINCT doc_id, pos FROM lines JOIN spread USING (line) WHERE NOT (doc_id = f.d AND pos = f.p)),
    kept AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.pos) AS text FROM raw r ANTI JOIN gone g ON r.doc_id = g.doc_id AND r.pos = g.pos GROUP BY r.doc_id),
    n AS (SELECT doc_id, count(*) AS k FROM gone GROUP BY doc_id)
    SELECT c.doc_id, CASE WHEN c.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
           CAST(coalesce(len(c.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n.k, 0) AS BIGINT) AS n_removed
    FROM cut c LEFT JOIN kept k ON c.doc_id = k.doc_id LEFT JOIN n ON c.doc_id = n.doc_id"""

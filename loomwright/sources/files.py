"""Readers and writers of files other than plain Parquet."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .sinks import written


#: Schemas of Parquet files by path, time of change and length.
_SCHEMAS: dict[tuple[str, int, int], StructType] = {}


def file_state(spark: SparkSession, path: str) -> tuple[str, int, int] | None:
    """(path, time of change, length) of a single file; nothing for a folder, whose files change without it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    return (path, status.getModificationTime(), status.getLen()) if status.isFile() else None


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. Its footer is read by a job of its own once for each state of the file; a folder's each time."""
    state = file_state(spark, path)
    if state is None:
        return spark.read.parquet(path)
    if state not in _SCHEMAS:
        _SCHEMAS[state] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[state]).parquet(path)


def read_csv_latin1(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    """``;`` separated ISO-8859-1 files as text, missing values empty, with the file's name in ``file``.

    The header must name ``columns``; others raise ValueError before any row is read.
    """
    reader = spark.read.option("sep", ";").option("encoding", "ISO-8859-1").option("header", True)
    found = reader.csv(paths).columns
    if set(found) != set(columns):
        raise ValueError(f"unexpected columns: missing {sorted(set(columns) - set(found))}, unknown {sorted(set(found) - set(columns))}")
    rows = reader.option("quote", "").schema(", ".join(f"`{c}` string" for c in found)).csv(paths)
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns], F.col("_metadata.file_name").alias("file"))


def read_csv_quoted(spark: SparkSession, paths: str | list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of quoted CSV whose quoted values may hold line ends, and the raw text of rows of another width.

    The files are parsed once, and what was parsed is written aside for both."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _bad string"
    rows = (
        spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(schema).csv(paths)
    )
    rows = written(rows, "parsed")
    good = rows.filter(F.col("_bad").isNull()).select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])
    return good, rows.filter(F.col("_bad").isNotNull()).select("_bad")


def read_conll(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, sentence, tokens, tags) of ``token TAG`` lines; empty lines end a sentence.

    Files of any size are read split by split. A split gives its sentences in pieces, and says whether
    its first line may go on with a sentence and whether its last one is left open; from these states,
    summed over a file's splits, each piece gets its sentence's number (from 0). Only pieces at the ends
    of splits are put together. Lines without a tag are left out, and a sentence without any line too.
    """
    text = spark.read.text(paths).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")
    pieces = text.mapInArrow(sentence_pieces, "file string, path string, split long, place long, starts boolean, open boolean, n long, tokens array<string>, tags array<string>")
    pieces = written(pieces, "sentences")
    state = pieces.filter("n is not null").select("path", "split", F.col("open").alias("left_open"), "n", (~F.col("starts")).alias("goes_on"))
    order = Window.partitionBy("path").orderBy("split")
    begins = F.col("n") + F.when(F.col("goes_on") & ~F.coalesce(F.lag("left_open").over(order), F.lit(False)), 1).otherwise(0)
    joined = state.withColumn("begins", begins).select(
        "path", "split", (F.sum("begins").over(order) - F.col("begins")).alias("before"), (F.col("goes_on") & (F.col("begins") > F.col("n"))).alias("fresh")
    )
    rows = pieces.filter("n is null").join(joined, ["path", "split"])
    # a piece that starts counts itself; one that goes on belongs to the sentence before, unless none was left open
    number = F.col("before") + F.col("place") + F.when(F.col("fresh"), 1).otherwise(0) - 1
    rows = rows.select("path", "file", number.alias("sentence"), "split", "place", (F.col("open") | ~F.col("starts")).alias("edge"), "tokens", "tags")
    edges = rows.filter("edge").groupBy("path", "file", "sentence").agg(F.sort_array(F.collect_list(F.struct("split", "place", "tokens", "tags"))).alias("p"))
    whole = edges.select("file", "sentence", F.flatten("p.tokens").alias("tokens"), F.flatten("p.tags").alias("tags"))
    return rows.filter("not edge").select("file", "sentence", "tokens", "tags").unionByName(whole).filter(F.size("tokens") > 0)


def sentence_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of sentences of each run of lines of one split, and one row with the split's state after
    them: in ``n`` how many pieces started in it, in ``starts`` whether its first line began one or
    was empty, in ``open`` whether its last one is not ended."""
    key, out = None, []
    place, tokens, tags, starts, some, first = 0, [], [], False, False, True

    def piece(open_: bool) -> None:
        nonlocal tokens, tags, some, starts
        if some:
            out.append((*key, place, starts, open_, None, tokens, tags))
        tokens, tags, some, starts = [], [], False, True

    def state() -> tuple:
        return (*key, 0, first, some, place, None, None)

    def batch() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), PIECE_TYPES)] if out else [pa.array([], t) for t in PIECE_TYPES], PIECE_NAMES)
        out.clear()
        return rows

    for rows in batches:
        for at in zip(*(rows.column(c).to_pylist() for c in ("file", "path", "split", "value"))):
            if at[:3] != key:
                if key is not None:
                    last = state()
                    piece(True)
                    out.append(last)
                key, place, starts, some, first = at[:3], 0, False, False, None
            line = at[3].rstrip("\r")
            bare = not line.strip(" \t")
            if first is None:
                first = bare
            if bare:
                piece(False)
                starts = True
                continue
            if not some:
                some = True
                place += starts
            words = line.split()
            if len(words) > 1 and not line[0].isspace():
                tokens.append(words[0])
                tags.append(words[-1])
        yield batch()
    if key is not None:
        last = state()
        piece(True)
        out.append(last)
    yield batch()


PIECE_NAMES = ["file", "path", "split", "place", "starts", "open", "n", "tokens", "tags"]
PIECE_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]


def read_squad(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Contracts (title, context) and questions (title, id, question, is_impossible, answers) of SQuAD 2.0 JSON."""
    answer = "array<struct<text: string, answer_start: bigint>>"
    qa = f"array<struct<id: string, question: string, is_impossible: boolean, answers: {answer}>>"
    data = spark.read.option("multiLine", True).schema(f"data array<struct<title: string, paragraphs: array<struct<context: string, qas: {qa}>>>>").json(paths)
    docs = data.select(F.explode("data").alias("d")).select("d.title", F.col("d.paragraphs")[0].alias("p"))
    asked = docs.select("title", F.explode("p.qas").alias("q")).select("title", "q.*")
    return docs.select("title", "p.context"), asked


def read_labels(spark: SparkSession, paths: str | list[str], key: str = "id", label: str = "relevante") -> DataFrame:
    """(id, label) of annotators' ``;`` files; only the labels 0 and 1, ids as whole numbers' text."""
    rows = spark.read.option("sep", ";").option("header", True).csv(paths)
    said = F.trim(F.col(label))
    return rows.filter(said.isin("0", "1")).select(F.element_at(F.split(F.trim(F.col(key)), r"\."), 1).alias("id"), said.cast("int").alias("label"))


def write_partitioned(df: DataFrame, path: str, by: str, rows_per_file: int = 50_000) -> None:
    """One folder per value of ``by``. Rows are spread over tasks, so a large value is written by many."""
    df.write.mode("overwrite").partitionBy(by).option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)


def latest_per_key(resources: DataFrame, key: str, preferred: str, position: str) -> DataFrame:
    """One row of each key: a preferred one if there is any, then the first by position (null: last)."""
    rank = F.struct(~F.coalesce(F.col(preferred), F.lit(False)), F.col(position).isNull(), F.col(position))
    return resources.groupBy(key).agg(F.min_by(F.struct(*resources.columns), rank).alias("_row")).select("_row.*")


def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, header): the first line of each run of lines of a file."""
    seen = None
    for rows in batches:
        out = []
        for path, line in zip(rows.column("path").to_pylist(), rows.column("value").to_pylist()):
            if path != seen:
                out.append((path, line))
                seen = path
        yield pa.record_batch({"path": pa.array([p for p, _ in out], pa.string()), "header": pa.array([h for _, h in out], pa.string())})


def read_file_set(spark: SparkSession, path: str, renamed: dict[str, str], code: str, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """The delimited files under ``path``, whatever their layout, as one table of text with ``code`` and ``file``.

    ``renamed`` names the columns that a header may have and what each is called in the table. Files are
    grouped by header and read a layout at a time; columns that a layout lacks are empty. A header
    with another column, or that misses one under all of its names, raises ValueError with the
    complements. ``code`` is a pattern whose first group is taken out of a file's path.
    """
    place = F.col("_metadata.file_path").alias("path")
    lines = spark.read.option("recursiveFileLookup", True).option("encoding", encoding).option("sep", "\x01").option("quote", "").schema("value string").csv(path)
    first = lines.filter(F.col("_metadata.file_block_start") == 0).select(place, "value")
    layouts: dict[str, list[str]] = {}
    for r in first.mapInArrow(headers, "path string, header string").orderBy("path").collect():  # a row a file, as the driver lists them anyway
        layouts.setdefault(r["header"], []).append(r["path"])
    found, wanted = None, list(dict.fromkeys(renamed.values()))
    for header, paths in sorted(layouts.items()):
        columns = [c.strip().lstrip("\ufeff") for c in header.split(sep)]
        unknown, missing = sorted(set(columns) - set(renamed)), sorted(set(wanted) - {renamed.get(c) for c in columns})
        if unknown:
            raise ValueError(f"{paths[0]}: unknown {unknown}, missing {missing}")
        rows = spark.read.option("sep", sep).option("encoding", encoding).option("header", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(paths)
        part = rows.select(
            *(F.coalesce(F.col(c), F.lit("")).alias(renamed[c]) for c in columns), *(F.lit("").alias(c) for c in missing),
            F.regexp_extract(F.col("_metadata.file_path"), code, 1).alias("code"), F.col("_metadata.file_name").alias("file"),
        ).select(*wanted, "code", "file")
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError(f"no files under {path}")
    return found


def read_squad_zip(spark: SparkSession, path: str) -> DataFrame:
    """(title, context, id, question, is_impossible, answers) of SQuAD 2.0 JSON inside zip archives, a row a
    question. A member is one JSON value, so one task parses it; contracts leave it one by one."""
    from .archives import ZippedCsvReader, inflated

    members = ZippedCsvReader(path, [], False).partitions()
    answer = pa.list_(pa.struct([("text", pa.string()), ("answer_start", pa.int64())]))
    names, types = ["title", "context", "id", "question", "is_impossible", "answers"], [pa.string()] * 4 + [pa.bool_(), answer]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                with open(m["path"], "rb") as f:
                    f.seek(m["offset"])
                    data = json.loads(b"".join(inflated(f, m["size"], m["crc"])))
                for contract in data["data"]:
                    paragraph = contract["paragraphs"][0]
                    rows = [
                        (contract["title"], paragraph["context"], q["id"], q["question"], bool(q.get("is_impossible", False)), [{"text": a["text"], "answer_start": a["answer_start"]} for a in q.get("answers", [])])
                        for q in paragraph["qas"]
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    rows = spark.createDataFrame([(m.path, m.offset, m.size, m.crc) for m in members], "path string, offset long, size long, crc long").repartition(len(members))
    return rows.mapInArrow(parse, "title string, context string, id string, question string, is_impossible boolean, answers array<struct<text: string, answer_start: long>>")

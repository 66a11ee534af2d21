"""The prefix tree of rebuilt conversations, from owned chains.

A node is a distinct sequence of first turns; its owner is the smallest conversation that starts with
it. Going down a conversation owners never fall, so from its first owned depth on a conversation owns
all its prefixes: a chain. The tree is these chains, each hung under the last prefix not owned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, partitions, written

#: What separates words.
SPACES = r"[\x20\x09-\x0D]+"
FAMILY, KEPT = 20, 4


def prefix_sums(df: DataFrame, group: str, order: list[str], values: list[str]) -> DataFrame:
    """``df`` with each column of ``values`` replaced by its sum over the rows before within ``group``
    in ``order``, and ``_own`` columns for the row's own values.

    Rows are dealt by range, so a group of any size spreads over many pieces. Only the first group of a
    piece can carry something over, so what is carried is at most one row a piece and goes to every task.
    The values are whole numbers and not null; rows that tie in ``order`` are interchangeable.
    """
    keys = [F.col(c) for c in (group, *order)]
    inside = Window.partitionBy("_piece", group).orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    local = checkpointed(
        df.repartitionByRange(partitions(df.sparkSession), *keys).withColumn("_piece", F.spark_partition_id())
        .select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0).cast("long")).alias(f"_{v}") for v in values))
    )
    across = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        local.groupBy(group, "_piece").agg(*(F.sum(v).alias(v) for v in values))
        .select(F.col(group).alias("_group"), F.col("_piece").alias("_at"), *(F.sum(v).over(across).alias(f"_over_{v}") for v in values))
        .filter(F.col(f"_over_{values[0]}").isNotNull())
    )
    joined = local.join(F.broadcast(carried), (F.col(group) == F.col("_group")) & (F.col("_piece") == F.col("_at")), "left")
    rest = [c for c in df.columns if c not in values]
    before = [(F.col(f"_{v}") + F.coalesce(F.col(f"_over_{v}"), F.lit(0).cast("long"))).alias(v) for v in values]
    return joined.select(*rest, *before, *(F.col(v).alias(f"{v}_own") for v in values))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words): every turn with its place from 0; equal keys mean equal role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("key"),
        F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACES))).cast("long").alias("words"), F.lit(1).cast("long").alias("pos"),
    )
    return prefix_sums(rows, "conv_id", ["known", "turn", "key"], ["pos"]).select("conv_id", "pos", "key", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, len) of every conversation, and the rows (conv_id, d, key, words, last) of the rebuilt
    ones, d from 1: the first h turns of the first conversation of the family, then the own turns after h."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    asked = sizes.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % KEPT).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    convs = written(
        asked.join(sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("there")), "first", "left")
        .select("conv_id", "first", "n", "h", F.least("h", F.coalesce("there", F.lit(0).cast("long"))).alias("taken"))
        .withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))), "conversations"
    )
    own = turns.join(convs, "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("d"), "key", "words", "len")
    lent = turns.filter(F.col("pos") < KEPT - 1).select(F.col("conv_id").alias("first"), "pos", "key", "words")
    given = convs.join(lent, "first").filter("pos < h").select("conv_id", (F.col("pos") + 1).alias("d"), "key", "words", "len")
    rows = own.unionByName(given).select("conv_id", "d", "key", "words", (F.col("d") == F.col("len")).alias("last"))
    return convs.select("conv_id", "len"), rows


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, d, digest, words, last, level): a 128-bit digest of the first d turns, from prefix sums of
    two 64-bit hashes of each turn and its place, kept in halves so that no sum overflows. ``level`` is
    the number of times that 2 divides d."""
    hashed = {s: F.xxhash64(F.lit(s), "d", "key") for s in (1, 2)}
    halves = {f"s{s}{p}": h.bitwiseAND(0xFFFFFFFF) if p else F.shiftrightunsigned(h, 32) for s, h in hashed.items() for p in (0, 1)}
    summed = prefix_sums(rows.select("*", *(v.alias(c) for c, v in halves.items())), "conv_id", ["d"], list(halves))
    whole = [F.col(c) + F.col(f"{c}_own") for c in halves]
    digest = F.struct(F.xxhash64(*whole).alias("x"), F.xxhash64(F.lit(3), *whole).alias("y"))
    level = F.bit_count(F.col("d").bitwiseAND(-F.col("d")) - 1)
    return written(summed.select("conv_id", "d", digest.alias("digest"), "words", "last", level.alias("level")), "digests")


def minima(rows: DataFrame) -> DataFrame:
    """(level, d, digest, owner, n, words, last): each node but the root, ``last`` if its owner ends there."""
    found = rows.groupBy("level", "d", "digest").agg(F.min(F.struct("conv_id", "last")).alias("least"), F.count("*").alias("n"), F.max("words").alias("words"))
    return written(found.select("level", "d", "digest", F.col("least.conv_id").alias("owner"), "n", "words", F.col("least.last").alias("last")), "nodes")


def last_not_owned(convs: DataFrame, rows: DataFrame, nodes: DataFrame, root: int, longest: int) -> DataFrame:
    """``convs`` with ``a``, the greatest depth whose prefix the conversation does not own, and ``above``, that prefix's owner.

    A binary search of all conversations at once, by falling powers of two: depth a + 2**k has k as its
    level, so each round looks at the rows and the minima of one level, and a row is looked at in one
    round. A prefix that many share goes to every task (under 16 a partition), the others are joined.
    """
    most = rows.count() // (16 * partitions(rows.sparkSession)) + 1
    state = convs.select("conv_id", "len", F.lit(0).cast("long").alias("a"), F.lit(root).cast("long").alias("above"))
    for k in reversed(range(longest.bit_length())):
        probes = state.select("conv_id", (F.col("a") + (1 << k)).alias("d")).join(rows.filter(F.col("level") == k).select("conv_id", "d", "digest"), ["conv_id", "d"])
        known = nodes.filter(F.col("level") == k).select("d", "digest", "owner", "n")
        hot = F.broadcast(known.filter(F.col("n") > most))
        few = probes.join(hot.select("d", "digest"), ["d", "digest"], "left_anti").join(known.filter(F.col("n") <= most), ["d", "digest"])
        shared = probes.join(hot, ["d", "digest"]).unionByName(few).filter("owner <> conv_id").select("conv_id", "d", "owner")
        state = written(state.join(shared, "conv_id", "left").select("conv_id", "len", F.coalesce("d", "a").alias("a"), F.coalesce("owner", "above").alias("above")), "searched")
    return state


def totals(chains: DataFrame) -> DataFrame:
    """(parent, a, saved, leaves) of every chain but the root's: what hangs below its top, the chain included.

    ``chains`` has (owner, parent, a, saved, leaves, waits), with the chain's own sums and how many
    chains hang on it. A chain that waits for none is told to its parent, in as many rounds as a path
    of the tree has owners; told sums are added up before they are joined.
    """
    done = []
    left = chains
    while not left.isEmpty():
        ready = left.filter("waits = 0 and parent is not null")
        done.append(ready.select("parent", "a", "saved", "leaves"))
        told = ready.groupBy("parent").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"), F.count("*").alias("k")).withColumnRenamed("parent", "owner")
        zero = F.lit(0).cast("long")
        left = written(
            left.filter("waits > 0").join(told, "owner", "left").select(
                "owner", "parent", "a", (F.col("saved") + F.coalesce("s", zero)).alias("saved"), (F.col("leaves") + F.coalesce("l", zero)).alias("leaves"),
                (F.col("waits") - F.coalesce("k", zero)).alias("waits"),
            ), "chains"
        )
        left = left.filter("waits > 0 or parent is not null")
    return reduce(DataFrame.unionByName, done) if done else chains.select("parent", "a", "saved", "leaves").limit(0)


def hashed_ids(ends: DataFrame) -> DataFrame:
    """(owner, d, sha): SHA-256 of the decimal conv_ids of each (owner, d), ascending, joined by commas.

    Ids are dealt by range and joined to texts in pieces of one Arrow batch, so that a node at which
    many conversations end is a few long strings; these are hashed one after another.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("owner").to_pylist(), batch.column("d").to_pylist()))
            ids = batch.column("conv_id").to_pylist()
            cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            yield pa.record_batch({
                "owner": [keys[s][0] for s in cuts[:-1]], "d": [keys[s][1] for s in cuts[:-1]], "least": [ids[s] for s in cuts[:-1]],
                "ids": [",".join(map(str, ids[s:e])) for s, e in zip(cuts, cuts[1:])],
            }, schema=PIECES)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for owner, d, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "d", "ids"))):
                if (owner, d) != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (owner, d), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("owner", "d", "sha"), r)) for r in out], schema=HASHES)
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"owner": key[0], "d": key[1], "sha": sha.hexdigest()}], schema=HASHES)

    n = partitions(ends.sparkSession)
    dealt = ends.select("owner", "d", "conv_id").repartitionByRange(n, "owner", "d", "conv_id").sortWithinPartitions("owner", "d", "conv_id")
    cut = dealt.mapInArrow(pieces, "owner long, d long, least long, ids string")
    return cut.repartition(n, "owner", "d").sortWithinPartitions("owner", "d", "least").mapInArrow(hashes, "owner long, d long, sha string")


PIECES = pa.schema([("owner", pa.int64()), ("d", pa.int64()), ("least", pa.int64()), ("ids", pa.string())])
HASHES = pa.schema([("owner", pa.int64()), ("d", pa.int64()), ("sha", pa.string())])
NONE = hashlib.sha256(b"").hexdigest()


def facts(parts: list[DataFrame], **how) -> DataFrame:
    """Rows (owner, d, ...) of several tables put side by side by node, in one shuffle."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy("owner", "d").agg(*(f(c).alias(c) for c, f in how.items()))


def prefix_tree(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    Rows with a null conv_id take no part; a null turn comes first; turns of equal number stand in the
    order of their digests, repeated rows count as turns; a null role or text is the empty one; texts of
    any length and conversations of any length are taken whole; other columns are not read. A
    conversation that is rebuilt without turns is a member of the root alone. An empty table has no root.
    """
    zero = F.lit(0).cast("long")
    turns = turns_of(conversations)
    convs, rebuilt_rows = rebuilt(turns)
    rows = digests(rebuilt_rows)
    nodes = minima(rows)
    whole = convs.agg(F.min("conv_id").alias("root"), F.count("*").alias("n"), F.max("len").alias("longest")).first()
    root = -1 if whole["root"] is None else whole["root"]
    state = last_not_owned(convs, rows, nodes, root, whole["longest"] or 0)

    is_root = F.col("conv_id") == root
    hung = state.filter((F.col("len") > F.col("a")) & ~is_root)
    top = convs.filter(is_root).select(F.col("conv_id").alias("owner"), zero.alias("d"), F.lit(whole["n"]).cast("long").alias("n"), zero.alias("words"), (F.col("len") == 0).alias("last"))
    tree = written(facts(
        [
            nodes.select("owner", "d", "n", "words", "last").unionByName(top),
            hung.select(F.col("conv_id").alias("owner"), (F.col("a") + 1).alias("d"), F.col("above").alias("top_of")),
            hung.groupBy(F.col("above").alias("owner"), F.col("a").alias("d")).agg(F.count("*").alias("kids")),
        ],
        n=F.max, words=F.max, last=F.max, top_of=F.max, kids=F.max,
    ), "tree")
    children = F.coalesce("kids", zero) + F.when(F.col("last"), 0).otherwise(1)
    nodes = tree.select(
        "owner", "d", F.when(F.col("d") > 0, F.coalesce("top_of", "owner")).alias("parent"), "n", children.alias("children"),
        F.when(children == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"), F.coalesce("kids", zero).alias("kids"),
    )
    tops = hung.select(F.col("conv_id").alias("owner"), F.col("above").alias("parent"), "a")
    chains = nodes.groupBy("owner").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.sum("kids").alias("waits")).join(tops, "owner", "left")
    below = totals(written(chains.select("owner", "parent", "a", "saved", "leaves", "waits"), "chains").filter("waits > 0 or parent is not null"))

    owns = (F.col("len") > F.col("a")) | is_root
    ends = state.select(F.when(owns, F.col("conv_id")).otherwise(F.col("above")).alias("owner"), F.col("len").alias("d"), "conv_id")
    every = facts(
        [
            nodes.drop("kids"),
            below.groupBy(F.col("parent").alias("owner"), F.col("a").alias("d")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves")),
            hashed_ids(ends),
        ],
        parent=F.max, n=F.max, children=F.max, leaves=F.max, saved=F.max, more_saved=F.max, more_leaves=F.max, sha=F.max,
    )
    upward = every.select(
        "owner", (-F.col("d")).alias("up"), "parent", "n", "children", F.coalesce("sha", F.lit(NONE)).alias("sha"),
        (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"),
    )
    summed = prefix_sums(upward, "owner", ["up"], ["leaves", "saved"])
    return summed.select(
        F.col("owner").alias("conv_id"), (-F.col("up")).alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").cast("long").alias("n_children"),
        (F.col("leaves") + F.col("leaves_own")).alias("n_leaves"), (F.col("saved") + F.col("saved_own")).alias("saved_tokens"), F.col("sha").alias("ends_sha256"),
    )


def oracle() -> str:
    """DuckDB SQL for the same rows: prefixes as joined digests, ancestors by their length, CRC-32 bit by bit."""
    bit = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    crc = f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
              lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda c, z: {bit})), 4294967295)"""
    return f"""
    WITH t AS (SELECT conv_id, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS key,
                      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
    p AS (SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM t),
    c AS (SELECT conv_id, {crc} % {KEPT} AS h, conv_id - conv_id % {FAMILY} AS f FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (SELECT c.conv_id, 0 AS part, p.pos, p.key, p.words FROM c JOIN p ON p.conv_id = c.f AND p.pos < c.h
          UNION ALL SELECT c.conv_id, 1, p.pos, p.key, p.words FROM c JOIN p ON p.conv_id = c.conv_id AND p.pos >= c.h),
    o AS (SELECT conv_id, row_number() OVER w AS d, string_agg(key, '') OVER (w ROWS UNBOUNDED PRECEDING) AS path, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
    every AS (SELECT conv_id, d, path, words FROM o UNION ALL SELECT conv_id, 0, '', 0 FROM c),
    ends AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, arg_max(path, d) AS path FROM every GROUP BY conv_id) GROUP BY path),
    n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM every GROUP BY path, d),
    k AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
    s AS (SELECT n.*, coalesce(k.kids, 0) AS kids FROM n LEFT JOIN k ON n.path = k.path),
    u AS (SELECT left(path, 32 * up) AS path, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * words) AS saved
          FROM (SELECT s.*, unnest(range(0, d + 1)) AS up FROM s) GROUP BY 1)
    SELECT s.conv_id, CAST(s.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, s.n AS n_convs, s.kids AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves,
           CAST(u.saved AS BIGINT) AS saved_tokens, coalesce(ends.sha, sha256('')) AS ends_sha256
    FROM s JOIN u ON u.path = s.path LEFT JOIN n q ON s.d > 0 AND q.path = left(s.path, 32 * (s.d - 1)) LEFT JOIN ends ON ends.path = s.path"""

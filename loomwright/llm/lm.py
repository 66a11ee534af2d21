"""Language-model scores of whole texts from the segmentations of their words into subwords.

The vocabulary is an existing one. The weight of a piece comes from its existing score (a merge
rank, read as a Zipf prior) and from how often the corpus uses it; the lattice's probability of a word
is the sum over all its segmentations, computed by a forward recursion in log space. A word that the
corpus has is one more arc over its whole lattice: of N training tokens, V of them distinct, the
share c / (N + V) comes from its count, and the share V / (N + V) of all words from the lattice. Words
and the end of a text sum to one, and what is learnt from the corpus grows with it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, checkpointed

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Weight of the prior, in pieces.
PRIOR = 32_000.0
#: At most so many of the commonest words go to every task with their counts; the rest are joined. Longer words are never among them.
COMMON, COMMON_BYTES = 200_000, 64
#: Counts of words are told apart by so many steps of each doubling to choose the commonest.
STEPS = 16
#: Words counted in a task before they are handed on, and rare words in a row.
HELD, IN_ROW = 300_000, 20_000
#: Characters of a word encoded at a time; longer words are joined where that changes nothing.
WINDOW = 1 << 16
#: A character that no longer piece has: what follows it is encoded as if it stood in the middle of a word.
FENCE = "\x01"


@lru_cache(maxsize=2)
def vocabulary(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Lattice:
    """Piece log10 probabilities, and those of words."""

    def __init__(self, path: str, counts: dict[int, int]):
        sp = vocabulary(path)
        n = sp.get_piece_size()
        rank = np.array([max(0.0, -sp.get_score(i)) for i in range(n)])
        special = np.array([sp.is_control(i) or sp.is_unknown(i) for i in range(n)])
        special[sp.eos_id()] = False
        rank[[sp.is_byte(i) for i in range(n)]] = n
        prior = np.where(special, 0.0, 1.0 / (rank + 10.0))
        seen = np.zeros(n)
        for i, c in counts.items():
            seen[i] = c
        p = (seen + PRIOR * prior / prior.sum()) * ~special
        with np.errstate(divide="ignore"):
            lp = np.log10(p / p.sum())
        p /= p.sum()
        first = np.array([sp.id_to_piece(i).startswith(MARK) for i in range(n)])
        end = p[sp.eos_id()]
        self.end = math.log10(end / (end + p[first].sum()))  # after a word comes another or the end
        self.byte = [float(lp[sp.piece_to_id(f"<0x{b:02X}>")]) for b in range(256)]
        self.table: dict[str, float | None] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if special[i] or sp.is_byte(i) or i == sp.eos_id() or MARK in piece[1:]:
                continue
            for j in range(1, len(piece)):
                self.table.setdefault(piece[:j], None)
            self.table[piece] = float(lp[i])
        self.longest = max([1, *map(len, self.table)])

    def word(self, word: str) -> float:
        """log10 of the summed probability of all segmentations of a word and the space before it.

        A place is reached only from those that the longest piece spans, so no more are held."""
        s = MARK + word
        n, table, byte, ten = len(s), self.table, self.byte, math.log(10)
        around = self.longest + 1
        into: list[list[float]] = [[] for _ in range(around)]
        alpha = 0.0
        for i in range(n + 1):
            if i:
                terms = into[i % around]
                most = max(terms)
                alpha = most + (math.log10(sum([math.exp((t - most) * ten) for t in terms])) if len(terms) > 1 else 0.0)
                into[i % around] = []
            if i == n:
                break
            into[(i + 1) % around].append(alpha + sum([byte[b] for b in s[i].encode("utf-8", "surrogatepass")]))
            for j in range(i + 1, n + 1):
                lp = table.get(s[i:j], 0.0)
                if lp == 0.0:
                    break
                if lp is not None:
                    into[j % around].append(alpha + lp)
        return alpha


def pieces_of(sp, word: str, window: int | None = None) -> Iterator[list[int]]:
    """The vocabulary's own segmentation of a whole word, in lists of bounded length.

    Pieces are merged from neighbours, best merge first, so a sequence of pieces is the segmentation
    of its word if each two neighbours are that of theirs. Each window starts at the end of a piece
    of the window before it, and the two are joined only where that holds; where it holds nowhere
    in a window, the window grows.
    """
    window = window or WINDOW
    if len(word) <= window:
        yield sp.encode(word)
        return
    fence = len(sp.encode(FENCE))
    inside = lambda text: sp.encode(FENCE + text)[fence:]

    def width(i: int) -> int:
        piece = sp.id_to_piece(i)
        return int((int(piece[1:-1], 16) & 0xC0) != 0x80) if sp.is_byte(i) else len(piece)

    def joined(a: int, b: int) -> bool:
        if sp.is_byte(a) or sp.is_byte(b):  # no piece has the character, so nothing is merged with it
            return bool(width(b))
        return inside(sp.id_to_piece(a) + sp.id_to_piece(b)) == [a, b]

    whole = MARK + word  # as the tokenizer sees it
    at, span = 0, window
    ids = inside(whole[:span])
    while at + span < len(whole):
        end = at + sum(map(width, ids))
        for k in range(len(ids) - 1, 0, -1):
            end -= width(ids[k])
            if not width(ids[k]):
                continue
            after = inside(whole[end : end + window])
            if joined(ids[k - 1], after[0]):
                yield ids[:k]
                at, span, ids = end, window, after
                break
        else:
            span *= 2
            ids = inside(whole[at : at + span])
    yield ids


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of (text, learn): every word of every text, and how often texts to learn from have
    it. The empty word stands for the end of a text."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()

        def out() -> pd.DataFrame:
            frame = pd.DataFrame({"word": [w.decode("utf-8", "replace") for w in counts], "c": list(counts.values())})
            counts.clear()
            return frame

        for pdf in batches:
            for text, learn in zip(pdf["text"], pdf["learn"], strict=True):
                for words in ascii_words(text):
                    if learn:
                        counts.update(words)
                    else:
                        for w in set(words):
                            counts.setdefault(w, 0)
                    if len(counts) >= HELD:
                        yield out()
                if learn:
                    counts[b""] += 1
        if counts:
            yield out()

    return docs.mapInPandas(of, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(words: DataFrame, path: str) -> dict[int, int]:
    """How often the vocabulary's own segmentation of the counted words uses each piece."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = vocabulary(path)
        seen = np.zeros(sp.get_piece_size(), np.int64)
        for pdf in batches:
            short = pdf["word"].str.len() <= WINDOW
            few = pdf[short]
            for word, ids, c in zip(few["word"], sp.encode(few["word"].tolist(), num_threads=1), few["c"], strict=True):
                for i in ids if word else (sp.eos_id(),):
                    seen[i] += c
            for word, c in zip(pdf["word"][~short], pdf["c"][~short], strict=True):
                for ids in pieces_of(sp, word):
                    for i in ids:
                        seen[i] += c
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"piece": at, "n": seen[at]})

    rows = words.filter("c > 0").mapInPandas(of, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    return {r["piece"]: r["n"] for r in rows}  # at most one for each piece of the vocabulary


def commonest(words: DataFrame) -> DataFrame:
    """Those (word, c) of at most COMMON_BYTES that count at least as much as a bound, chosen so that
    they are COMMON or fewer. Words meet in no task; counts by size of count, under a thousand, do."""
    short = words.filter(F.octet_length("word") <= COMMON_BYTES).withColumn("step", F.floor(F.log2(F.col("c") + 1) * STEPS))
    held, least = 0, None
    for r in sorted(short.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > COMMON:
            break
        least = r["step"]
    return short.filter(F.lit(False) if least is None else F.col("step") >= least).select("word", "c")


def score_texts(docs: DataFrame, learn: F.Column, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, learn, n_tokens, n_known, train_tokens, base_score, score, lattice_score), one row for each row of ``docs``.

    ``lattice_score`` is the marginal probability from the lattices alone, without the words' own arcs.

    Words and their counts are learnt from the rows for which ``learn`` holds. Counts of the
    commonest words go to every task; all other words are joined with their counts, each word of a
    text once, so no key of the join is common. Null and empty texts are one end token. Repeated
    rows get a row each. Without rows to learn from all counts are 0 and the lattice alone weighs, its
    pieces by their prior.
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    words = checkpointed(word_counts(rows.select("text", "learn")))
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.coalesce(F.max(F.when(F.col("word") == "", F.col("c"))), F.lit(0)).alias("ends")).first()
    n, v = total["n"], total["v"]
    lattice = spark.sparkContext.broadcast(Lattice(path, piece_counts(words, path)))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = lattice.value.word
        for pdf in batches:
            yield pdf.assign(lp=[one(w) for w in pdf["word"]])

    weighed = words.filter("word <> ''").select("word", "c").mapInPandas(weigh, "word string, c long, lp double")
    common = commonest(words.filter("word <> ''")).mapInPandas(weigh, "word string, c long, lp double").toPandas()  # at most COMMON words of bounded length
    types = max(1, v)
    log_types, whole = math.log10(types), math.log10(max(1, n + v))

    def mixed(c: int, lp: float) -> float:
        return math.log10(c + types * 10**lp) if c else log_types + lp

    known = spark.sparkContext.broadcast(
        {w.encode(): (c > 0, math.log10(c + 1), mixed(c, lp), lp) for w, c, lp in zip(common["word"], common["c"].tolist(), common["lp"].tolist(), strict=True)}
    )
    denominator, ends = math.log10(n + v + 1), total["ends"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        uid, table, end = TaskContext.get().partitionId() << 36, known.value, lattice.value.end
        for pdf in batches:
            out: list[tuple] = []
            for i, learned, text in zip(pdf["id"].tolist(), pdf["learn"], pdf["text"], strict=True):
                i = None if i is None or i != i else int(i)
                base, score, tokens, seen = math.log10(ends + 1) - denominator, mixed(ends, end) - whole, 1, int(ends > 0)
                spelt = end
                for words in ascii_words(text):
                    rare: list[dict] = []
                    for w, tf in Counter(words).items():
                        got = table.get(w)
                        if got is None:
                            rare.append({"word": w.decode("utf-8", "replace"), "tf": tf})
                            if len(rare) == IN_ROW:
                                out.append((uid, i, learned, 0, 0, 0.0, 0.0, 0.0, rare))
                                rare = []
                        else:
                            seen += tf * got[0]
                            base += tf * got[1]
                            score += tf * got[2]
                            spelt += tf * got[3]
                    tokens += len(words)
                    base -= len(words) * denominator
                    score -= len(words) * whole
                    if rare:
                        out.append((uid, i, learned, 0, 0, 0.0, 0.0, 0.0, rare))
                out.append((uid, i, learned, tokens, seen, base, score, spelt, []))
                uid += 1
            frame = pd.DataFrame(out, columns=["uid", "id", "learn", "n_tokens", "n_known", "base", "score", "spelt", "rare"])
            frame["id"] = frame["id"].astype("Int64")
            yield frame

    scanned = checkpointed(rows.mapInPandas(
        scan, "uid long, id long, learn boolean, n_tokens long, n_known long, base double, score double, spelt double, rare array<struct<word:string,tf:long>>"
    ))
    rare = scanned.filter(F.size("rare") > 0).select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.tf")
    met = rare.join(weighed, "word").groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("base"),
        F.sum(F.col("tf") * F.when(F.col("c") > 0, F.log10(F.col("c") + types * F.pow(F.lit(10.0), F.col("lp")))).otherwise(log_types + F.col("lp"))).alias("score"),
        F.sum(F.col("tf") * F.col("lp")).alias("spelt"),
    )
    zero = F.lit(0).cast("long")
    parts = scanned.filter(F.size("rare") == 0).select("uid", "id", "learn", "n_tokens", "n_known", "base", "score", "spelt").unionByName(
        met.select("uid", F.lit(None).cast("long").alias("id"), F.lit(None).cast("boolean").alias("learn"), zero.alias("n_tokens"), "n_known", "base", "score", "spelt")
    )
    return parts.groupBy("uid").agg(
        F.max("id").alias(id_col), F.max("learn").alias("learn"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score"), F.sum("spelt").alias("lattice_score"),
    ).drop("uid")

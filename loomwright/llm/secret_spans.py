"""Secrets: spans of fixed patterns, and those that a linear-chain conditional random field adds.

The field tags tokens as begin, inside or outside of a secret. What it learns from are the spans of the
patterns in a bounded sample of texts; what it sees are words, shapes, neighbours and traits of the
whole file, so it also finds secrets that stand and look like those but that no pattern names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_step, steps_within

#: The patterns, in the order of their kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS, ADDED, LEAST_ASSIGNED = ("assign", "access", "hex"), "crf", 6

ASSIGNED = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
NAMES = (b"passw", b"secret", b"token", b"api")
ACCESSED, HEXED = re.compile(ACCESS), re.compile(HEX)

OUTSIDE, BEGIN, INSIDE = range(3)
BITS = 18
#: Texts with and without a pattern's span that are learnt from, at most so many of each, and their characters.
SAMPLE, SAMPLE_CHARS = 250, 1_200_000
#: Characters tagged in one go.
WINDOW = 1 << 17
#: Tokens a feature looks ahead or back; a code point beyond all characters pads texts apart.
REACH, PAD = 3, 0x110000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, leftmost and apart by kind, by start and kind.

    A run shorter than its kind asks for holds no longer match, so the bounds of ``access`` and ``hex``
    stand in their patterns; those of ``assign`` are looked at after a match, which uses up its text.
    """
    found = []
    small = text.encode("utf-8", "surrogatepass").lower()
    if any(n in small for n in NAMES):
        found += [(m.start(), m.end(), 0) for m in ASSIGNED.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESSED.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEXED.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda f: (f[0], f[2]))]


def kinds_of_char() -> np.ndarray:
    """0 white space, 1 part of a word, 2 a token of its own, by ASCII code; all beyond are parts of words."""
    kind = np.full(129, 2, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]], kind[128] = 0, 1
    for a, b in ("09", "AZ", "az", "__"):
        kind[ord(a) : ord(b) + 1] = 1
    return kind


KIND = kinds_of_char()
DIGIT, UPPER, LOWER = (np.isin(np.arange(129), [c for c in range(128) if chr(c).isascii() and test(chr(c))]) for test in (str.isdigit, str.isupper, str.islower))
HEXDIGIT = np.isin(np.arange(129), [ord(c) for c in "0123456789abcdefABCDEF"])
FOLD = np.arange(129) + 32 * UPPER
LENGTHS = np.array([2, 3, 4, 5, 7, 9, 13, 17, 24, 32, 48])
ODD = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2**64."""
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64) for base in (ODD, pow(ODD, -1, 1 << 64)))


def counts_of(codes: np.ndarray) -> np.ndarray:
    """Characters, digits, tokens of one sign, and line ends of a text."""
    low = np.minimum(codes, 128)
    return np.array([len(codes), DIGIT[low].sum(), (KIND[low] == 2).sum(), (codes == 10).sum()])


def trait(counts: np.ndarray) -> np.ndarray:
    """A small number for what kind of file (characters, digits, signs, line ends) counts tell of."""
    n = np.maximum(counts[..., 0], 1)
    digits, signs = np.searchsorted([0.0, 0.01, 0.03, 0.1], counts[..., 1] / n), np.searchsorted([0.02, 0.05, 0.1], counts[..., 2] / n)
    return (digits * 4 + signs) * 4 + np.searchsorted([40, 80, 200], n / (counts[..., 3] + 1)) + 1


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray
    shape: np.ndarray
    pad: np.ndarray


def tokens(codes: np.ndarray, power: tuple[np.ndarray, np.ndarray]) -> Tokens:
    """Words and signs of code points; a word's hash is of its letters in lower case."""
    low = np.minimum(codes, 128)
    pad, kind = codes == PAD, KIND[low]
    kind[pad] = 2
    word = kind == 1
    begins, ends = (kind == 2) | (word & ~np.r_[False, word[:-1]]), (kind == 2) | (word & ~np.r_[word[1:], False])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none.astype(np.uint64), none, none.astype(bool))
    folded = np.where(codes < 128, FOLD[low], codes).astype(np.uint64) + np.uint64(1)
    folded[kind == 0] = 0
    value = np.add.reduceat(folded * power[0][: len(codes)], start) * power[1][start]
    has = lambda table: np.add.reduceat(table[low].astype(np.int64), start)
    digit, upper, lower, hexed, size = has(DIGIT), has(UPPER), has(LOWER), has(HEXDIGIT), end - start
    shape = np.searchsorted(LENGTHS, size, "right") * 32 + (digit > 0) + 2 * (upper > 0) + 4 * (lower > 0) + 8 * (digit + upper + lower < size) + 16 * ((hexed == size) & (digit > 0))
    sign = kind[start] == 2
    return Tokens(start, end, value, np.where(sign, 1024 + np.minimum(codes[start], 129), shape), pad[start])


def features(t: Tokens, file: np.ndarray, known: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """One array of rows of the weights for each kind of feature, for the tokens that have REACH others on
    both sides. ``known`` says which words may be looked at (when learning; all if not given)."""
    n = len(t.word)
    word = t.word if known is None else np.where(known, t.word, np.uint64(7))
    shape = t.shape.astype(np.uint64)
    near = np.r_[False, t.start[1:] == t.end[:-1]].astype(np.uint64)
    at = lambda values, k: values[REACH + k : n - REACH + k]
    here = at(shape, 0)
    seen = [at(word, k) for k in (0, -1, 1, -2, 2)] + [at(shape, k) for k in (0, -1, 1, -2, 2, 3)]
    seen += [here << np.uint64(12) | at(shape, k) for k in (-1, 1)] + [here << np.uint64(2) | at(near, 0) << np.uint64(1) | at(near, 1)]
    seen += [at(file, 0).astype(np.uint64), here << np.uint64(12) | at(file, 0).astype(np.uint64)]
    for k, v in enumerate(seen):
        h = (v + np.uint64(k + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + np.uint64(k * ODD % (1 << 64))
        yield ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Field:
    """Weights of features by tag, and of a tag after another."""

    weights: np.ndarray
    after: np.ndarray

    def emissions(self, t: Tokens, file: np.ndarray) -> np.ndarray:
        out = np.zeros((max(len(t.word) - 2 * REACH, 0), 3), np.float64)
        for rows in features(t, file):
            out += self.weights.take(rows, axis=0)
        return out


def surely_outside(e: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Tokens that are outside on every best path: there, no gain of two transitions makes up for what
    another tag loses."""
    gain = (after - after[:, [OUTSIDE]]).max(axis=0) + (after - after[[OUTSIDE]]).max(axis=1)
    return (e[:, [OUTSIDE]] - e[:, 1:] > gain[1:]).all(axis=1)


def decode(e: np.ndarray, after: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Tags of the best path (Viterbi) over tokens with scores ``e``, outside where ``fixed``, and outside
    before and after. The runs between fixed tokens do not touch and are decoded side by side."""
    tags = np.zeros(len(e), np.int8)
    free = np.r_[False, ~fixed, False]
    first, last = np.flatnonzero(free[1:] & ~free[:-1]), np.flatnonzero(free[:-1] & ~free[1:])
    if not len(first):
        return tags
    order = np.argsort(first - last, kind="stable")  # longest first
    first, size = first[order], (last - first)[order]
    best = after[OUTSIDE] + e[first]
    back = []
    for t in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -t, "left"))  # runs longer than t
        paths = best[:live, :, None] + after
        back.append(paths.argmax(axis=1))
        best[:live] = paths.max(axis=1) + e[first[:live] + t]
    now = (best + after[:, OUTSIDE]).argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, "left"))
        tags[first[:live] + t] = now[:live]
        if t:
            now[:live] = back[t - 1][np.arange(live), now[:live]]
    return tags


def runs(tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last token of each secret: a begin, or an inside after an outside, and the insides after it."""
    inside = tags != OUTSIDE
    first = inside & ((tags == BEGIN) | ~np.r_[False, inside[:-1]])
    last = inside & (np.r_[tags[1:] == BEGIN, True] | ~np.r_[inside[1:], False])
    return np.flatnonzero(first), np.flatnonzero(last)


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts with pads between, before and after, and where each text starts."""
    pad = np.full(REACH, PAD, np.uint32)
    parts = [pad]
    for t in texts:
        parts += [t, pad]
    return np.concatenate(parts), np.cumsum([0] + [len(t) + REACH for t in texts])[:-1] + REACH


class Tagger:
    """Finds secrets with a field, many texts at once, or a long one window by window."""

    def __init__(self, field: Field, window: int = WINDOW):
        self.field, self.window, self.power = field, window, powers(0)

    def scored(self, codes: np.ndarray, starts: np.ndarray, traits: np.ndarray) -> tuple[Tokens, np.ndarray, np.ndarray]:
        """The tokens but for the pads at both ends, their scores, and which are surely outside."""
        if len(self.power[0]) <= len(codes):
            self.power = powers(2 * len(codes))
        t = tokens(codes, self.power)
        e = self.field.emissions(t, traits[np.searchsorted(starts, t.start, "right") - 1])
        inner = slice(REACH, len(t.word) - REACH)
        t = Tokens(t.start[inner], t.end[inner], t.word[inner], t.shape[inner], t.pad[inner])
        return t, e, surely_outside(e, self.field.after) | t.pad

    def short(self, texts: list[np.ndarray]) -> list[list[tuple[int, int]]]:
        codes, starts = padded(texts)
        t, e, sure = self.scored(codes, starts, trait(np.stack([counts_of(x) for x in texts])))
        first, last = runs(decode(e, self.field.after, sure))
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        owner = np.searchsorted(starts, t.start[first], "right") - 1
        for o, s, e_ in zip(owner.tolist(), (t.start[first] - starts[owner]).tolist(), (t.end[last] - starts[owner]).tolist()):
            out[o].append((s, e_))
        return out

    def long(self, text: np.ndarray) -> list[tuple[int, int]]:
        """Each window is decided up to a token that is surely outside and whose neighbours are all in
        the window; the next starts there. A window without one is doubled."""
        traits = trait(sum(counts_of(text[i : i + self.window]) for i in range(0, len(text), self.window)))[None]
        at, context, size, out = 0, 0, self.window, []
        while True:
            end = min(len(text), at + size)
            codes, starts = padded([text[at:end]])
            t, e, sure = self.scored(codes, starts, traits)
            sure[:context] = True
            stop = len(sure)
            if end < len(text):
                safe = np.flatnonzero(sure[: max(len(sure) - REACH - 1, 0)])
                if not len(safe) or safe[-1] < context + REACH:
                    size *= 2
                    continue
                stop = int(safe[-1])
            first, last = runs(decode(e[:stop], self.field.after, sure[:stop]))
            out += list(zip((t.start[first] - REACH + at).tolist(), (t.end[last] - REACH + at).tolist()))
            if end == len(text):
                return out
            at, context, size = at + int(t.start[stop - REACH]) - REACH, REACH, self.window

    def find(self, texts: list[str | None]) -> Iterator[list[tuple[int, int]]]:
        """(start, end) of the secrets of each text, in code points."""
        held: list[np.ndarray] = []
        chars = 0
        for text in texts:
            text = text or ""
            if held and chars + len(text) > self.window:
                yield from self.short(held)
                held, chars = [], 0
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(code) > self.window:
                yield self.long(code)
            else:
                held.append(code)
                chars += len(code)
        if held:
            yield from self.short(held)


def tags_of(t: Tokens, spans: list[tuple[int, int]]) -> np.ndarray:
    """The tags that spans, which may overlap, give the tokens."""
    tags, until = np.zeros(len(t.start), np.int8), -1
    for s, e in sorted(spans):
        first, last = np.searchsorted(t.end, s, "right"), np.searchsorted(t.start, e, "left")
        if last > first:
            tags[first:last] = np.where(tags[first:last] == BEGIN, BEGIN, INSIDE)
            if s > until or not tags[first]:
                tags[first] = BEGIN
        until = max(until, e)
    return tags


def likelihood(e: np.ndarray, after: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of ``tags`` (runs x length), and its gradients by ``e`` (runs x length x 3) and ``after``.
    Runs are outside before and after."""
    n, size = tags.shape
    total = lambda x, axis: (m := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis=axis))
    fore, rear = np.empty_like(e), np.empty_like(e)
    fore[:, 0] = after[OUTSIDE] + e[:, 0]
    for t in range(1, size):
        fore[:, t] = total(fore[:, t - 1, :, None] + after, 1) + e[:, t]
    rear[:, -1] = after[:, OUTSIDE]
    for t in range(size - 2, -1, -1):
        rear[:, t] = total(after + (e[:, t + 1] + rear[:, t + 1])[:, None, :], 2)
    norm = total(fore[:, -1] + rear[:, -1], 1)
    path = np.c_[np.zeros(n, int), tags, np.zeros(n, int)]
    value = np.take_along_axis(e, tags[..., None].astype(int), 2).sum() + after[path[:, :-1], path[:, 1:]].sum() - norm.sum()
    grad_e = -np.exp(fore + rear - norm[:, None, None])
    grad_after = np.zeros((3, 3))
    np.add.at(grad_after, (path[:, :-1].ravel(), path[:, 1:].ravel()), 1)
    grad_after[OUTSIDE] += grad_e[:, 0].sum(axis=0)
    grad_after[:, OUTSIDE] += grad_e[:, -1].sum(axis=0)
    for t in range(1, size):
        grad_after -= np.exp(fore[:, t - 1, :, None] + after + (e[:, t] + rear[:, t])[:, None, :] - norm[:, None, None]).sum(axis=0)
    np.put_along_axis(grad_e, tags[..., None].astype(int), np.take_along_axis(grad_e, tags[..., None].astype(int), 2) + 1, 2)
    return float(value), grad_e, grad_after


def fit(texts: list[str], steps: int = 40, length: int = 64, blind: float = 0.2, l2: float = 0.02) -> Field:
    """A field that gives the texts the tags of the patterns' spans, by Adam on the likelihood of runs of
    ``length`` tokens. A part ``blind`` of words is not looked at, so that shapes and neighbours must do.
    Without any span, everything is outside."""
    rng, rows, tags = np.random.default_rng(7), [], []
    for text in texts:
        base = [s[:2] for s in base_spans(text)]
        codes, starts = padded([np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)])
        t = tokens(codes, powers(len(codes)))
        if len(t.word) <= 2 * REACH:
            continue
        file = np.full(len(t.word), trait(counts_of(codes[REACH:-REACH])))
        found = np.stack([f.astype(np.int32) for f in features(t, file, rng.random(len(t.word)) >= blind)])
        said = tags_of(t, [(s + REACH, e + REACH) for s, e in base])[REACH:-REACH]
        rows.append(found)
        tags.append(said)
    weights, after = np.zeros((1 << BITS, 3)), np.zeros((3, 3))
    if not rows or not any(s.any() for s in tags):
        weights[:, OUTSIDE] = 1.0
        return Field(weights.astype(np.float32), after)
    rows, tags = np.concatenate(rows, axis=1), np.concatenate(tags)
    fill = -len(tags) % length  # the last run ends in repeated first tokens, all the same to the others
    take = np.r_[np.arange(len(tags)), np.arange(fill) % len(tags)]
    rows, tags = rows[:, take], tags[take].reshape(-1, length)
    used = np.flatnonzero(np.bincount(rows.ravel(), minlength=1 << BITS))
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used))
    at, w = place[rows], np.zeros((len(used), 3))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros((3, 3)), np.zeros((3, 3))]
    for step in range(1, steps + 1):
        e = sum(w.take(k, axis=0) for k in at)
        _, grad_e, grad_after = likelihood(e.reshape(*tags.shape, 3), after, tags)
        by_tag = grad_e.reshape(-1, 3).T.copy()
        grads = np.stack([sum(np.bincount(k, g, len(used)) for k in at) for g in by_tag], axis=1) - l2 * w, grad_after - l2 * after
        for i, (value, grad) in enumerate(zip((w, after), grads)):
            m, v = state[2 * i], state[2 * i + 1]
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            value += 0.1 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * m / (np.sqrt(v) + 1e-8)
    weights[used] = w
    return Field(weights.astype(np.float32), after)


def train(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Field:
    """A field fitted in one task on at most ``sample`` texts with a pattern's span and as many without,
    and ``chars`` characters in all: those whose hashes lie in chosen steps. A text beyond a 20th of
    ``chars`` is not learnt from. Labels come from the patterns alone."""

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(base_spans(t)) for t in texts], dtype=bool)

    stepped = docs.select("text").filter(F.length("text") <= chars // 20).withColumn("step", hash_step(F.xxhash64("text")))
    seen = stepped.select("step", holds("text").alias("y")).groupBy("y", "step").count().collect()
    steps = {y: steps_within({r["step"]: r["count"] for r in seen if r["y"] == y}, sample) for y in (False, True)}
    marked = stepped.filter(F.col("step").isin([*steps[False], *steps[True]])).withColumn("y", holds("text"))
    wanted = F.when(F.col("y"), F.col("step").isin(steps[True])).otherwise(F.col("step").isin(steps[False]))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, held = [], 0
        for pdf in batches:
            for text in pdf["text"]:
                if held + len(text) <= chars:
                    held += len(text)
                    texts.append(text)
        field = fit(texts)
        kept = np.flatnonzero(field.weights.any(axis=1))
        yield pd.DataFrame({"at": [kept.astype("<u4").tobytes()], "w": [field.weights[kept].tobytes()], "after": [field.after.tobytes()]})

    rows = marked.filter(wanted).select("text").repartition(1).sortWithinPartitions(F.xxhash64("text"), "text")
    model = rows.mapInPandas(learn, "at binary, w binary, after binary").first()
    field = fit([])
    if model is not None:
        if model["w"]:
            field.weights[:] = 0
            field.weights[np.frombuffer(model["at"], "<u4")] = np.frombuffer(model["w"], "<f4").reshape(-1, 3)
        field.after[:] = np.frombuffer(model["after"]).reshape(3, 3)
    return field


def apart(found: list[tuple[int, int]], base: list[tuple[int, int, str]], least: int = LEAST_ASSIGNED) -> list[tuple[int, int, str]]:
    """The found spans of at least ``least`` characters that overlap none of ``base``, which is by start."""
    if not found:
        return []
    starts = np.array([s for s, _, _ in base])
    until = np.maximum.accumulate(np.array([e for _, e, _ in base])) if base else starts
    out = []
    for s, e in found:
        before = int(np.searchsorted(starts, e, "left"))  # spans that start before this one ends
        if e - s >= least and not (before and until[before - 1] > s):
            out.append((s, e, ADDED))
    return out


SPANS = "doc_id long, spans array<struct<kind: string, start: long, end: long, text: string>>"


def find_secrets(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, spans) of every row: each span's kind, start, end (exclusive) in code points, and text.

    Spans of the patterns (kinds ``assign``, ``access``, ``hex``) all stay and may overlap between kinds;
    those that ``field`` adds (``crf``) overlap none. They are ordered by start, then kind as listed. A
    null or empty text has none; repeated rows get a row each; a null doc_id stays null; a text of any
    length is tagged whole; an empty table gives no row. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rank = {k: i for i, k in enumerate((*KINDS, ADDED))}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for text, found in zip(texts, tagger.find(texts)):
                base = base_spans(text) if text else []
                every = sorted(base + apart(found, base), key=lambda x: (x[0], rank[x[2]]))
                out.append([{"kind": k, "start": s, "end": e, "text": text[s:e]} for s, e, k in every])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, ROW.field("spans").type)], schema=ROW)

    return docs.select("doc_id", "text").mapInArrow(of, SPANS)


ROW = pa.schema([
    ("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))),
])


def written_out(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

"""Streams: personal data masked across fragments, event-time windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.security import PII

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Characters held back, and the longest text kept while no space comes.
HOLD, MOST = 96, 1 << 16
PATTERNS = [(re.compile(p), label) for p, label in PII]


def mask(text: str) -> str:
    for p, label in PATTERNS:
        text = p.sub(label, text)
    return text


def safe_cut(text: str, hold: int = HOLD) -> int:
    """Where ``text`` can be cut: at the last space before its last ``hold`` characters that lies in
    no match; past MOST characters without one, before the held ones and any match that spans there."""
    limit = len(text) - hold
    if limit <= 0:
        return 0
    spans = [m.span() for p, _ in PATTERNS for m in p.finditer(text)]
    inside = lambda i: next((a for a, b in spans if a < i < b), None)
    at = text.rfind(" ", 0, limit)
    while at > 0 and inside(at) is not None:
        at = text.rfind(" ", 0, at)
    if at <= 0 and len(text) > MOST:
        at = limit
        while (a := inside(at)) is not None:
            at = a
    return max(at, 0)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stream_id, pos, piece, last) with runs of fragments of a stream whose ``pos`` follow each other, within a
    batch, as one fragment at the first's ``pos``: what comes together is joined before it is shuffled."""
    for batch in batches:
        ids, pos, piece, last = batch.columns
        if not len(ids):
            continue
        follows = pc.and_(pc.equal(ids[1:], ids[:-1]), pc.equal(pos[1:], pc.add(pos[:-1], 1))).fill_null(False)
        starts = np.flatnonzero(np.r_[True, ~follows.to_numpy(zero_copy_only=False).astype(bool)])
        runs = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(ids)], pa.int32()), piece.fill_null(""))
        ended = np.logical_or.reduceat(last.fill_null(False).to_numpy(zero_copy_only=False), starts)
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays([ids.take(at), pos.take(at), pc.binary_join(runs, ""), pa.array(ended)], ["stream_id", "pos", "piece", "last"])


class Masker(StatefulProcessor):
    """Holds what a stream has not let go yet, and lets go of it ``quiet`` milliseconds after its last fragment."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "held string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        """State is asked for once, and a stream that comes whole leaves none; each further call would be another
        exchange with the executor, for every stream."""
        came = sorted(((pos is None, pos or 0, piece or "", bool(last)) for _, pos, piece, last in rows), key=lambda r: r[:2])
        kept = self.held.get()
        held = (kept[0] if kept else "") + "".join(r[2] for r in came)
        ended = any(r[3] for r in came)
        cut = len(held) if ended else safe_cut(held)
        if kept:  # only what is held has timers
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if not ended:
            self.held.update((held[cut:],))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        elif kept:
            self.held.clear()
        yield from self.said(key, held[:cut])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        kept = self.held.get()
        self.held.clear()
        yield from self.said(key, kept[0] if kept else "")

    def said(self, key: tuple, text: str) -> Iterator[Row]:
        if text:
            yield Row(stream_id=key[0], text=mask(text))

    def close(self) -> None:
        pass


def mask_fragments(fragments: DataFrame, quiet: int = 600_000) -> DataFrame:
    """(stream_id, text) masked pieces of a stream of (stream_id, pos, piece, last), in order.

    Fragments of a micro-batch are taken by ``pos``; null pieces are empty. What is held is let go, masked,
    when a fragment with ``last`` comes, or when none has come for ``quiet`` milliseconds, so that a
    stream that never ends leaves no state. Timers need the session's RocksDB state store, which is set.
    """
    fragments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = fragments.select("stream_id", "pos", "piece", "last")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(joined, kinds).groupBy("stream_id").transformWithState(Masker(quiet), "stream_id long, text string", "append", "processingTime")


def mask_available(fragments: DataFrame, path: str, checkpoint: str, quiet: int = 600_000) -> None:
    """All fragments that are there, masked into Parquet files in ``path``. Batches without fragments are not
    run meanwhile: a run over what is there would else go on for as long as it has state. Timers whose
    time has come fire with the next batch of any stream."""
    conf, name = fragments.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        out = mask_fragments(fragments, quiet).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(name, before)


def windowed_counts(events: DataFrame, ts: str, by: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows by window and ``by``; the same plan on a stream drops rows later than the watermark."""
    found = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, size)
    return found.groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")

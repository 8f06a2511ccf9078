"""Removal of long repeats by prefix-free parsing.

A rolling hash of W bytes runs over each text; the least hash of every WINDOW-byte string triggers, so all places that hold the
same string choose the same trigger in it, whatever surrounds them. Triggers cut a text into phrases: a trigger with the run of
windows it governs. The dictionary counts the phrases' two half contexts (the CONTEXT bytes left or right of the trigger,
one of which any window contains), as hashes. A context that occurs once settles its windows: they are unique. One whose
occurrences all belong to equal phrases settles them too: they repeat. Only where equal contexts go on differently are their
occurrences brought together, with up to 2 * WINDOW bytes of text, and their suffixes classed by WINDOW-byte prefixes.
Only equality of the first WINDOW bytes decides on removal, so classes of equal prefixes stand in for the full order that suffix
arrays would give, and no text is sorted as a whole.

Contexts with over HOT occurrences are never gathered: aggregates count their phrases, which settles phrases that repeat, and
then the windows of one occurrence of each phrase as hashes. The most frequent window at each offset of the trigger is sent to
all phrases of its context, which then give runs; only windows other than that meet by their hash.
Copies of whole texts are found by their hash and reported once. Hashes have 64 bits.

Defined cases: null is the empty text; texts shorter than WINDOW lose nothing; repeated rows and copies each lose all of a text of
WINDOW bytes or more; bytes are judged on the input; spans are maximal runs of removed bytes, end exclusive; kept bytes need
not be UTF-8; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikelake.llm.common import byte_rows
from strikelake.llm.components import key_filter, may_hold
from strikelake.llm.wordhash import _POWERS, _VALUES, mix
from strikelake.session import materialize

WINDOW, W = 200, 16
#: Half contexts: a window whose trigger is at HALF or later contains the left one, else the right one.
HALF = (WINDOW - W) // 2
CONTEXT = HALF + W
PIECE = 1 << 20
HOT = 1024
SALTS = 32
_POSITION = np.uint64((1 << 24) - 1)
_SIDE = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)


class Text:
    """Range hashes of one piece of text."""

    def __init__(self, data: np.ndarray):
        self.data = data
        _POWERS.grow(len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * _POWERS.up[: len(data)], dtype=np.uint64)))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _POWERS.down[start] + (end - start).astype(np.uint64))


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if done < width else h


def phrases(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triggers a, and the first and last window start of each."""
    data = text.data
    n = len(data) - W + 1
    at = np.arange(n)
    rolling = mix((text.sums[W:] - text.sums[:n]) * _POWERS.down[:n])
    least = _sliding_min((rolling & ~_POSITION) | at.astype(np.uint64), WINDOW - W + 1)
    trigger = (least & _POSITION).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(trigger[1:] != trigger[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [len(trigger) - 1]))
    return trigger[first], first, last


def contexts(text: Text):
    """Per half context: key, phrase hash, trigger, least and largest offset of the trigger in its windows."""
    a, first, last = phrases(text)
    phrase = text.hashes(first, last + WINDOW) + (a - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = []
    for side in (0, 1):  # left, right
        low = np.maximum(a - last, HALF) if side == 0 else a - last
        high = a - first if side == 0 else np.minimum(a - first, HALF - 1)
        has = np.flatnonzero(low <= high)
        t = a[has]
        key = text.hashes(t - HALF, t + W) if side == 0 else text.hashes(t, t + CONTEXT)
        out.append((mix(key ^ _SIDE[side]), phrase[has], t, low[has], high[has]))
    return [np.concatenate(x) for x in zip(*out)]


def pieces(text: bytes) -> Iterator[tuple[int, Text]]:
    """Overlapping pieces that together hold every window once."""
    data = np.frombuffer(text, np.uint8)
    for start in range(0, max(0, len(data) - WINDOW + 1), PIECE):
        yield start, Text(data[start : start + PIECE + WINDOW - 1])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    met: set[int] = set()
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1))):
            if len(text) >= WINDOW and doc not in met:
                met.add(doc)
                yield doc, text


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*held)], names=["key", "phrase"])

    for _, text in _distinct(batches):
        for _, piece in pieces(text):
            key, phrase, *_rest = contexts(piece)
            held.append((key, phrase))
            size += len(key)
        if size > 200_000:
            yield made()
            held, size = [], 0
    if held:
        yield made()


_PLACES = "key long, phrase long, doc long, at long, low int, high int, text binary"


def _places(repeated: np.ndarray, open_keys: np.ndarray):
    """Occurrences of contexts that may repeat; with their text where a context may go on differently."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in range(7)]
        for doc, text in _distinct(batches):
            for start, piece in pieces(text):
                key, phrase, t, low, high = contexts(piece)
                pick = np.flatnonzero(may_hold(repeated, key.view(np.int64)))
                needs = may_hold(open_keys, key[pick].view(np.int64))
                raw = piece.data.tobytes()
                rows[0].append(key[pick].view(np.int64))
                rows[1].append(phrase[pick].view(np.int64))
                rows[2].append(np.full(len(pick), doc, np.int64))
                rows[3].append(t[pick] + start)
                rows[4].append(low[pick].astype(np.int32))
                rows[5].append(high[pick].astype(np.int32))
                rows[6] += [raw[i - h : i - l + WINDOW] if need else None for i, l, h, need in zip(t[pick].tolist(), low[pick].tolist(), high[pick].tolist(), needs)]
            if len(rows[6]) > 20_000:
                yield _places_batch(rows)
                rows = [[] for _ in range(7)]
        if rows[0]:
            yield _places_batch(rows)

    return run


def _places_batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(x)) for x in rows[:6]], pa.array(rows[6], pa.binary())], names=["key", "phrase", "doc", "at", "low", "high", "text"])


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts in one pass: hash, number of the text, position in it."""
    sizes = np.array([len(t) for t in texts])
    counts = sizes - WINDOW + 1
    whole = Text(np.frombuffer(b"".join(texts), np.uint8))
    owner = np.repeat(np.arange(len(texts)), counts)
    position = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(np.cumsum(sizes) - sizes, counts) + position
    return whole.hashes(start, start + WINDOW), owner, position


def _whole_keys(batches: Iterator[pa.RecordBatch], least: int = 10_000) -> Iterator[pa.Table]:
    """Tables of ``least`` rows or more, cut where the first column changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            key = np.asarray(batch.column(0))
            if sum(x.num_rows for x in held) >= least:
                last = held[-1].column(0)[held[-1].num_rows - 1].as_py()
                fresh = np.flatnonzero(key != last)
                if len(fresh):
                    yield pa.Table.from_batches([*held, batch.slice(0, int(fresh[0]))])
                    held, batch = [], batch.slice(int(fresh[0]))
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _class_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each context, the windows of its occurrences that equal another's; out: doc, first and last start."""
    for table in _whole_keys(batches):
        key, phrase, doc, at, high = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "phrase", "doc", "at", "high"))
        kind = mix(key.view(np.uint64) ^ mix(phrase.view(np.uint64)))
        _, first, inverse, counts = np.unique(kind, return_index=True, return_inverse=True, return_counts=True)
        texts = table.column("text").take(pa.array(first)).to_pylist()
        hashes, owner, position = _windows(texts)
        # The offset of the trigger is part of a window's class: contexts are equal only around their triggers.
        offset = (high[first][owner] - position).astype(np.uint64)
        tag = mix(hashes + np.uint64(0x9E3779B97F4A7C15) * offset + mix(key[first].view(np.uint64))[owner])
        _, same, times = np.unique(tag, return_inverse=True, return_counts=True)
        hit = (times[same] > 1) | (counts[owner] > 1)
        change = np.concatenate(([True], (owner[1:] != owner[:-1]) | (hit[1:] != hit[:-1])))
        begin = np.flatnonzero(change)
        end = np.concatenate((begin[1:], [len(hit)])) - 1
        begin, end = begin[hit[begin]], end[hit[begin]]
        runs = np.bincount(owner[begin], minlength=len(first))
        of_first = np.cumsum(runs) - runs
        rows = np.repeat(np.arange(len(key)), runs[inverse])
        run = np.arange(len(rows)) - np.repeat(np.cumsum(runs[inverse]) - runs[inverse], runs[inverse]) + of_first[inverse[rows]]
        base = (at - high)[rows]
        yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(base + position[begin[run]]), pa.array(base + position[end[run]])], names=["doc", "first", "last"])


def _counted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of phrases with the offset of their trigger, equal ones of a batch counted."""
    for batch in batches:
        if batch.num_rows:
            key, high = (batch.column(c).to_numpy().astype(np.int64) for c in ("key", "high"))
            hashes, owner, position = _windows(batch.column("text").to_pylist())
            h, first, n = np.unique(hashes, return_index=True, return_counts=True)
            owner, position = owner[first], position[first]
            yield pa.RecordBatch.from_arrays([pa.array(key[owner]), pa.array((high[owner] - position).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "offset", "h", "n"])


def _hot_windows(repeated: np.ndarray):
    """Runs of windows that equal the most frequent one at their offset (h is null), and with their hash others that may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                start, doc, high = (batch.column(c).to_numpy().astype(np.int64) for c in ("start", "doc", "high"))
                modes = batch.column("modes")
                sizes = modes.value_lengths().fill_null(0).to_numpy()
                of, entries = np.repeat(np.arange(len(sizes)), sizes), modes.flatten()
                mode, has = np.zeros((len(sizes), WINDOW), np.int64), np.zeros((len(sizes), WINDOW), bool)
                at = entries.field("offset").to_numpy()
                mode[of, at], has[of, at] = entries.field("h").to_numpy(), True
                hashes, owner, position = _windows(batch.column("text").to_pylist())
                hashes, offset = hashes.view(np.int64), high[owner] - position
                equal = has[owner, offset] & (mode[owner, offset] == hashes)
                change = np.concatenate(([True], (owner[1:] != owner[:-1]) | (equal[1:] != equal[:-1])))
                begin = np.flatnonzero(change)
                end = np.concatenate((begin[1:], [len(equal)])) - 1
                begin, end = begin[equal[begin]], end[equal[begin]]
                rest = np.flatnonzero(~equal & may_hold(repeated, hashes))
                from_, to = np.concatenate((begin, rest)), np.concatenate((end, rest))
                h = pa.array(hashes[from_], mask=np.arange(len(from_)) < len(begin))
                base = start[owner[from_]]
                yield pa.RecordBatch.from_arrays([h, pa.array(doc[owner[from_]]), pa.array(base + position[from_]), pa.array(base + position[to])], names=["h", "doc", "first", "last"])

    return run


def _hot_runs(kinds: DataFrame) -> DataFrame:
    """(doc, first, last) of the windows that repeat among the phrases of hot contexts, for phrases that occur once.

    The most frequent window at each offset, at most WINDOW entries a context, meets the phrases on the context and a salt,
    as one context may own most phrases; the other repeated windows meet theirs by hash.
    """
    counted = kinds.select("key", "high", "text").mapInArrow(_counted_windows, "key long, offset int, h long, n long")
    repeated = materialize(counted.groupBy("key", "offset", "h").agg(F.sum("n").alias("n")).filter("n > 1"), "repeated-windows")
    best = repeated.groupBy("key", "offset").agg(F.max(F.struct("n", "h")).alias("best"))
    modes = best.groupBy("key").agg(F.collect_list(F.struct("offset", F.col("best.h").alias("h"))).alias("modes"))
    modes = modes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = kinds.filter("times = 1").select("key", F.pmod("phrase", F.lit(SALTS)).cast("int").alias("salt"), "doc", "start", "high", "text")
    dealt = dealt.join(modes.hint("merge"), ["key", "salt"], "left").select("doc", "start", "high", "text", "modes")
    others = repeated.join(best.select(F.col("best.h").alias("h")), "h", "left_anti").select("h")
    windows = materialize(dealt.mapInArrow(_hot_windows(key_filter(others, "h")), "h long, doc long, first long, last long"), "windows")
    rest = windows.filter("h is not null").join(others.hint("merge"), "h")
    return windows.filter("h is null").drop("h").unionByName(rest.drop("h"))


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(doc, first, last): runs of window starts that repeat, for texts (doc, text) whose ``doc`` is a hash of the text."""
    dictionary = texts.mapInArrow(_dictionary, "key long, phrase long")
    counted = dictionary.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("phrase").alias("lo"), F.max("phrase").alias("hi")).filter("n > 1")
    counted = materialize(counted.select("key", "n", (F.col("lo") != F.col("hi")).alias("open")), "contexts")
    places = texts.mapInArrow(_places(key_filter(counted, "key"), key_filter(counted.filter("open"), "key")), _PLACES)
    places = materialize(places.join(counted, "key"), "places")
    settled = places.filter("not open").select("doc", (F.col("at") - F.col("high")).alias("first"), (F.col("at") - F.col("low")).alias("last"))
    few = places.filter(f"open and n <= {HOT}").select("key", "phrase", "doc", "at", "high", "text")
    classed = few.repartition("key").sortWithinPartitions("key").mapInArrow(_class_windows, "doc long, first long, last long")
    hot = places.filter(f"open and n > {HOT}")
    one = F.min(F.struct("doc", (F.col("at") - F.col("high")).alias("start"), "high", "text")).alias("one")
    kinds = hot.groupBy("key", "phrase").agg(F.count(F.lit(1)).alias("times"), one)
    kinds = materialize(kinds.select("key", "phrase", "times", "one.*"), "phrases")
    equal = hot.join(kinds.filter("times > 1").select("key", "phrase").hint("merge"), ["key", "phrase"]).select("doc", (F.col("at") - F.col("high")).alias("first"), (F.col("at") - F.col("low")).alias("last"))
    return settled.unionByName(classed).unionByName(equal).unionByName(_hot_runs(kinds))


def _cut(schema_names: list[str], text_at: int, spans_at: int, whole_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, spans, whole in zip(byte_rows(batch.column(text_at)), batch.column(spans_at), batch.column(whole_at)):
                if whole.as_py() and len(text) >= WINDOW:
                    merged = [(0, len(text))]
                else:
                    merged = _merged(spans.values.field("first").to_numpy(), spans.values.field("last").to_numpy()) if spans.is_valid else []
                cut = [0, *[x for span in merged for x in span], len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(cut[::2], cut[1::2])))
                removed.append([{"start": a, "end": b} for a, b in merged])
            columns = [batch.column(i) for i in range(len(schema_names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=[*schema_names, "removed_spans", "kept_bytes"])

    return run


def _merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that start in [first, last]."""
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate(last[order] + WINDOW)
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return list(zip(start[new].tolist(), end[np.concatenate((new[1:], [True]))].tolist())) if len(start) else []


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``removed_spans`` (array<struct<start, end>>, bytes) and ``kept_bytes``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("doc"), text.alias("text"))
    spans = repeated_windows(texts).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("sd_spans"))  # of one text
    copies = texts.filter(F.octet_length("text") >= WINDOW).groupBy("doc").agg((F.count(F.lit(1)) > 1).alias("sd_whole"))
    found = copies.join(spans, "doc", "left").filter("sd_whole or sd_spans is not null").withColumnRenamed("doc", "sd_doc")
    joined = docs.withColumn("sd_doc", F.xxhash64(text)).join(found, "sd_doc", "left").drop("sd_doc")
    joined = joined.withColumn("sd_whole", F.coalesce("sd_whole", F.lit(False)))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("removed_spans", span), T.StructField("kept_bytes", T.BinaryType())])
    names = joined.columns
    return joined.mapInArrow(_cut(docs.columns, docs.columns.index(text_col), names.index("sd_spans"), names.index("sd_whole")), schema)

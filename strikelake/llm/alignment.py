"""Alignment of two tokenizers' tokens over the same text, and how often their tokens meet in the whole corpus.

A text is tokenised whole by both. Where a token of A and one of B that start with a space start at the same byte, both sides
have just ended a token: these verified shared ends cut the text into windows, mostly words. A window's alignment depends
on its token ids alone, so it is computed once per pair of id tuples and remembered. Inside a window, byte offsets where both
sides end a token cut the tokens into groups, and two tokens whose bytes overlap are linked.

A task collects parts of texts into blocks of about BLOCK bytes. A block carries each distinct window once, each distinct
pair of ids once with its links, and each part the numbers of its windows, so that little more than one number per word is
stored. Pairs are counted over all blocks by an aggregate; a block then gets the counts of its own pairs back, by a join,
and adds them up by window and part. Nothing that grows with the corpus is broadcast or collected.

Texts over PIECE characters are tokenised in pieces, cut before a space and a letter where neither tokenizer can have a token
across, so the ids are those of the whole text.

Defined cases: null and empty texts, and texts that a side's token bytes don't give back (those with U+2581, which B
reads as a space), have no tokens: zeros and no groups; strings of special tokens are plain text; repeated rows all count;
empty tables give empty results; columns to carry may have any names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikelake.llm.bpe import SPLIT, byte_symbols
from strikelake.session import materialize

PIECE = 1 << 20
BLOCK = 2 << 20
_CUT = re.compile(r"(?<=\S) (?=[A-Za-z])")


class Side:
    """Per id, the bytes, their number and whether a space comes first; subclasses give the ids of a space and a text."""

    def __init__(self, labels: list[bytes]):
        self.labels = labels
        self.sizes = np.array([len(x) for x in labels], np.int64)
        self.marked = np.array([x[:1] == b" " for x in labels])


class ByteBpe(Side):
    """A byte-level BPE file of the tokenizers library, whose ids are in the order of the merges."""

    def __init__(self, data: bytes):
        import tiktoken

        spec = json.loads(data)
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        special = {a["content"] for a in spec.get("added_tokens", [])}
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocab.items() if token not in special}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids aren't in the order of the merges")
        labels = [b""] * (max(vocab.values()) + 1)
        for label, i in ranks.items():
            labels[i] = label
        super().__init__(labels)
        self.encoding = tiktoken.Encoding("side-a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(" " + text)


class Pieces(Side):
    """A sentencepiece model that puts a space before the text."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)])
        #: Whether no piece goes on behind a letter with a space, so that a text may be cut there.
        self.separable = not any("▁" in x.lstrip("▁") for x in names)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def pieces_of(text: str, separable: bool, size: int = PIECE) -> list[str]:
    """Pieces that are tokenised as in the whole text when a space is put before each; the space at a cut is left out."""
    out, start = [], 0
    while separable and len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.end()
    return [*out, text[start:]]


@dataclass
class Part:
    """A piece of a text in a block: its row and the ids of its tokens, none if the text has none."""

    row: int
    a: np.ndarray
    b: np.ndarray


@dataclass
class Windows:
    """Alignments by number, the most frequent first. ``groups`` end with a semicolon; ``links`` of all windows in order, a link
    being a id times 2^32 plus b id; ``number`` of the window at each place of the block, ``starts`` of the parts among them."""

    groups: list[str]
    n_groups: np.ndarray
    n_links: np.ndarray
    links: np.ndarray
    number: np.ndarray
    starts: np.ndarray


class Aligner:
    def __init__(self, a: ByteBpe, b: Pieces):
        self.a, self.b = a, b
        rng = np.random.default_rng(7)
        self.values_a, self.values_b = (rng.integers(1, 1 << 63, len(s.labels), np.uint64) | np.uint64(1) for s in (a, b))
        #: Ids as they stand in groups: inside one, and at the end of its a and its b ids.
        self.names = [f"{i}{mark}" for side, marks in ((a, ",|"), (b, ",;")) for mark in marks for i in range(len(side.labels))]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or None if their bytes aren't those of the text."""
        want, both = (" " + text).encode(), []
        for side in (self.a, self.b):
            ids = side.ids(text)
            if b"".join(map(side.labels.__getitem__, ids)) != want:
                return None
            both.append(np.array(ids, np.int32))
        return both[0], both[1]

    def parts(self, row: int, text: str | None) -> Iterator[Part]:
        none = np.empty(0, np.int32)
        pieces = pieces_of(text, self.b.separable) if text else []
        if len(pieces) > 1 and not all(self.tokens(p) for p in pieces):  # no part may count before all are known to be right
            pieces = []
        for piece in pieces:
            yield Part(row, *(self.tokens(piece) or (none, none)))
        if not pieces:
            yield Part(row, none, none)

    def windows(self, parts: list[Part]) -> Windows:
        """The windows of parts that have tokens."""
        a, b = np.concatenate([p.a for p in parts]), np.concatenate([p.b for p in parts])
        starts_a, starts_b = (np.concatenate(([0], np.cumsum(side.sizes[ids])))[:-1] for side, ids in ((self.a, a), (self.b, b)))
        # Both sides of a part start with the space before it, so parts start windows.
        anchors = np.intersect1d(starts_a[self.a.marked[a]], starts_b[self.b.marked[b]], assume_unique=True)
        at_a, at_b = np.searchsorted(starts_a, anchors), np.searchsorted(starts_b, anchors)
        size_a, size_b = np.diff(np.append(at_a, len(a))), np.diff(np.append(at_b, len(b)))
        bytes_before = np.cumsum([0, *[int(self.a.sizes[p.a].sum()) for p in parts]])
        starts = np.append(np.searchsorted(anchors, bytes_before[:-1]), len(anchors))
        h = _hashes(self.values_a[a], at_a, size_a) * np.uint64(0x9E3779B97F4A7C15) + _hashes(self.values_b[b], at_b, size_b)
        _, first, number = np.unique(h, return_index=True, return_inverse=True)
        # Equal hashes, other ids: such a window stands for itself.
        alone = np.flatnonzero(_differ(a, at_a, size_a, first[number]) | _differ(b, at_b, size_b, first[number]))
        number[alone] = len(first) + np.arange(len(alone))
        first = np.concatenate((first, alone))
        often = np.argsort(-np.bincount(number, minlength=len(first)), kind="stable")
        place = np.empty(len(first), np.int64)
        place[often] = np.arange(len(first))
        first = first[often]
        found = self.align(a[_ranges(at_a[first], size_a[first])], size_a[first], b[_ranges(at_b[first], size_b[first])], size_b[first])
        return Windows(*found, place[number], starts)

    def align(self, a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Groups, their number, the number of links and the links of windows that lie one behind the other."""
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        window_a = np.repeat(np.arange(len(size_a)), size_a)
        # Between two neighbouring ends of either side lies one overlap of two tokens.
        ends = np.union1d(ends_a, ends_b)
        of_a, of_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        links = a[of_a].astype(np.int64) << 32 | b[of_b]
        last_a, last_b = (own == other[np.searchsorted(other, own)] for own, other in ((ends_a, ends_b), (ends_b, ends_a)))
        group_a, group_b = (np.cumsum(last) - last for last in (last_a, last_b))
        names = np.empty(len(a) + len(b), np.int64)
        names[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + last_a * len(self.a.labels)
        names[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = b + last_b * len(self.b.labels) + 2 * len(self.a.labels)
        flat, stops = [self.names[i] for i in names.tolist()], np.cumsum(size_a + size_b).tolist()
        groups = ["".join(flat[i:j]) for i, j in zip([0, *stops], stops)]
        count = lambda of: np.bincount(of, minlength=len(size_a))
        return groups, count(window_a[last_a]), count(window_a[of_a]), links


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one behind the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _hashes(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of the values in each of the adjoining ranges, by value and place."""
    place = np.arange(len(values)) - np.repeat(starts, sizes)
    powers = np.cumprod(np.full(int(place.max()) + 1, 0xD1342543DE82EF95, np.uint64))
    return np.add.reduceat(values * powers[place], starts)


def _differ(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Whether a range isn't the same as the range ``like`` names."""
    other = np.minimum(_ranges(starts[like], sizes), len(ids) - 1)
    return (sizes != sizes[like]) | np.logical_or.reduceat(ids != ids[other], starts)


class _Text:
    """Groups and sums of the parts of a text so far."""

    def __init__(self, row: int):
        self.row, self.sums, self.hash, self.parts = row, [0, 0, 0, 0], hashlib.sha256(), []

    def add(self, groups: str, sums: tuple[int, ...], digest: bool) -> None:
        text = ";" * bool(self.sums[0]) + groups[:-1]
        self.hash.update(text.encode()) if digest else self.parts.append(text)
        self.sums = [x + y for x, y in zip(self.sums, sums)]

    def groups(self, digest: bool) -> str:
        return "".join(self.parts) if not digest else self.hash.hexdigest() if self.sums[0] else ""


#: The aligner a worker used last, by the files' digests; never more than one.
_ALIGNER: dict[str, Aligner] = {}


def _aligner(shared) -> Aligner:
    key, a, b = shared.value
    if key not in _ALIGNER:
        _ALIGNER.clear()
        _ALIGNER[key] = Aligner(ByteBpe(a), Pieces(b))
    return _ALIGNER[key]


def _share(docs: DataFrame, tokenizer_a: str, tokenizer_b: str):
    """Both files, read on the driver: their size is the vocabularies'."""
    with open(tokenizer_a, "rb") as f, open(tokenizer_b, "rb") as g:
        a, b = f.read(), g.read()
    return docs.sparkSession.sparkContext.broadcast((hashlib.sha256(a + b).hexdigest(), a, b))


#: Of a row, ``doc`` tells the text apart; its sums are on its last part. Of a block, ``pairs`` ascend, with their links in the
#: block; ``window_pairs`` has the numbers of the pairs of each window and ``window_sizes`` how many they are.
_PART = "block long, doc long, n_a long, n_b long, n_groups long, n_links long, groups string, often binary, seldom binary, pairs array<long>, links array<long>, window_pairs binary, window_sizes binary"


def blocks(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, carry: list[str], text_col: str = "text", digest: bool = False) -> DataFrame:
    """Parts of texts and, per block, one row of its pairs and windows; the carried columns are named c0, c1, ..."""
    shared = _share(docs, tokenizer_a, tokenizer_b)
    kept = docs.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    schema = T.StructType([*T.StructType.fromDDL(_PART).fields, *[T.StructField(f.name, f.dataType, True) for f in kept.schema.fields[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        aligner, base, out = _aligner(shared), TaskContext.get().partitionId() << 32, to_arrow_schema(schema)
        waiting: list[Part] = []
        under_way = _Text(-1)
        size = done = seq = 0

        def settle(carried: list[dict], first: int, last_row: int) -> pa.RecordBatch:
            """A block of the waiting parts. A text goes on in the next block if its row comes after ``last_row``."""
            nonlocal done
            block = base | done
            done += 1
            whole = [p for p in waiting if len(p.a)]
            found = aligner.windows(whole) if whole else None
            rows: list[dict] = []
            k = 0
            for i, part in enumerate(waiting):
                if under_way.row != part.row:
                    under_way.__init__(part.row)
                own = np.empty(0, np.int64)
                if len(part.a):
                    own = found.number[found.starts[k] : found.starts[k + 1]]
                    k += 1
                    under_way.add("".join(map(found.groups.__getitem__, own.tolist())), (len(part.a), len(part.b), int(found.n_groups[own].sum()), int(found.n_links[own].sum())), digest)
                row = {"block": block, "doc": base | part.row, "often": own[own < 1 << 16].astype("<u2").tobytes(), "seldom": own[own >= 1 << 16].astype("<u4").tobytes()}
                if part.row <= last_row and (i + 1 == len(waiting) or waiting[i + 1].row != part.row):
                    row |= carried[part.row - first] | {"groups": under_way.groups(digest)} | dict(zip(("n_a", "n_b", "n_groups", "n_links"), under_way.sums))
                rows.append(row)
            if found:
                pairs, of_window = np.unique(found.links, return_inverse=True)
                times = np.repeat(np.bincount(found.number, minlength=len(found.groups)), found.n_links)
                counts = np.bincount(of_window, weights=times, minlength=len(pairs)).astype(np.int64)
                rows.append({"block": block, "pairs": pairs, "links": counts, "window_pairs": of_window.astype("<u4").tobytes(), "window_sizes": found.n_links.astype("<u4").tobytes()})
            waiting.clear()
            return pa.RecordBatch.from_pylist(rows, out)

        for batch in batches:
            carried, first = batch.drop_columns(["text"]).to_pylist() if carry else [{}] * batch.num_rows, seq
            for text in batch.column(0):
                for part in aligner.parts(seq, text.as_py()):
                    if size >= BLOCK:
                        yield settle(carried, first, seq - 1 if waiting and waiting[-1].row == seq else seq)
                        size = 0
                    waiting.append(part)
                    size += int(aligner.a.sizes[part.a].sum()) + 64
                seq += 1
            if waiting:
                yield settle(carried, first, seq)
                size = 0

    return kept.mapInArrow(run, schema)


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, carry: list[str], text_col: str = "text", digest: bool = False) -> DataFrame:
    """The carried columns of each text with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``, ``n_best`` and ``count_sum``.

    ``groups`` lists the groups, `a1,a2|b1;a3|b2,b3`, or with ``digest`` its SHA-256 in hex ('' without tokens). A pair's
    count is the number of links of its two ids in all texts; ``n_best`` counts a text's links whose pair has its b
    id's largest count, and ``count_sum`` adds the counts up over the text's links.
    """
    parts = materialize(blocks(docs, tokenizer_a, tokenizer_b, carry, text_col, digest), "alignment-blocks")
    names = [f"c{i}" for i in range(len(carry))]
    own = parts.filter("pairs is not null").select("block", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    counts = materialize(own.groupBy("pair").agg(F.sum("links").alias("n")), "alignment-counts")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    best = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # a row for each b id
    marked = counts.withColumn("b", b_id).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    values = own.select("block", "pair").join(marked, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pair", "n", "best"))).alias("v"))
    values = values.select("block", F.col("v.n").alias("n"), F.col("v.best").alias("best"))  # at most as long as a block has links
    shipped = parts.drop("pairs", "links").unionByName(values, allowMissingColumns=True)
    result = T.StructType([f for f in shipped.schema.fields if f.name in ("doc", "n_a", "n_b", "n_groups", "n_links", "groups", *names)] + T.StructType.fromDDL("n_best long, count_sum long").fields)
    fields = result.fieldNames()[:-2]

    def summed_block(rows: pa.Table) -> pa.Table:
        return _summed(rows, fields)

    summed = shipped.groupBy("block").applyInArrow(summed_block, result)
    # A text's sums, groups and carried columns stand on the last of its parts.
    last = lambda c: F.max_by(c, F.col("n_a").isNotNull()).alias(c)
    texts = summed.groupBy("doc").agg(*[last(c) for c in ("n_a", "n_b", "n_groups", "n_links", "groups", *names)], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return texts.select(*[F.col(n).alias(c) for n, c in zip(names, carry)], "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")


def _summed(table: pa.Table, fields: list[str]) -> pa.Table:
    """The parts of a block with the counts of their links added up."""
    at = {name: np.flatnonzero(np.asarray(table.column(name).is_valid())) for name in ("doc", "window_pairs", "n")}
    parts = table.take(pa.array(at["doc"]))
    totals = np.zeros((2, 1), np.int64)
    if len(at["n"]):
        values = [np.asarray(table.column(c).take(pa.array(at["n"])).combine_chunks().flatten().cast(pa.int64())) for c in ("best", "n")]
        pairs, sizes = (np.frombuffer(table.column(c)[int(at["window_pairs"][0])].as_py(), "<u4") for c in ("window_pairs", "window_sizes"))
        starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)[:-1]))
        totals = np.stack([np.add.reduceat(v[pairs], starts) for v in values])
    sums = [[], []]
    for often, seldom in zip(parts.column("often"), parts.column("seldom")):
        windows = np.concatenate((np.frombuffer(often.as_py(), "<u2").astype(np.int64), np.frombuffer(seldom.as_py(), "<u4").astype(np.int64)))
        for k in (0, 1):
            sums[k].append(int(totals[k][windows].sum()))
    return pa.table([*[parts.column(c) for c in fields], pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64())], names=[*fields, "n_best", "count_sum"])

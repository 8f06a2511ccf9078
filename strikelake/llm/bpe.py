"""Byte-level BPE by a deterministic tokenization automaton.

``compile_merges`` starts from one state that loops over all bytes and applies a gadget per merge (u, v) -> w, in order of
rank: if an arc v still leaves the state behind u, that state is split (its copy has no arc v), and an arc w bridges the
pair, ending where v ended. States and arcs are kept as the list of split arcs with their rank: a token's end state is
its own splits plus those its right part had when the token was made, and an arc exists unless the arc of its left
part had gone before. ``Automaton.arc`` is the transition table, filled as transitions are met. A word has exactly one
accepted path per prefix. Read byte by byte the automaton is deterministic: its state is the last token and the tokens under way, and
its byte table is filled as transitions are met. Decoding emits the byte labels of the arcs.

Defined cases: a null text has no tokens, as the empty one; decoding null or empty ids gives an empty text, unknown ids
are skipped and bytes that aren't UTF-8 become U+FFFD; added tokens are cut out of the raw text first.
Rows pass through with all their columns; ``ids`` and ``decoded`` name the new ones. Memory: one Arrow batch, CACHE_WORDS
words of CACHED_SIZE characters at most, and a byte table that is emptied beyond TABLE_STATES, in the midst of a word too.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bounds of a worker's memory: words kept with their ids, their longest size in characters, states and arcs of the byte table.
CACHE_WORDS, CACHED_SIZE = 250_000, 64
TABLE_STATES, TABLE_ARCS = 150_000, 400_000

#: The split pattern of the byte-level tokenizer. Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that the installed regex module knows and the tokenizers library doesn't yet. Fixed values.
NEWER = (
    "՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    "\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    "\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: The same pattern for texts of Latin-1 characters only, where the faster re module can say it.
_LATIN_SPACE, _LATIN_NUMBER = "\t-\r \x85\xa0", "0-9²³¹¼½¾"
_LATIN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W0-9_²³¹¼½¾]+| ?[{_LATIN_NUMBER}]+| ?(?:[^\w{_LATIN_SPACE}\x1c-\x1f]|[_\x1c-\x1f])+|[{_LATIN_SPACE}]+(?![^{_LATIN_SPACE}])|[{_LATIN_SPACE}]+"
)
_PLAIN = regex.compile(SPLIT)
_HAS_NEWER = regex.compile(f"[{NEWER}]")
_STRICT = regex.compile(
    SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{NEWER}])").replace(r" ?\p{L}+", rf" ?(?:(?![{NEWER}])\p{{L}})+").replace(r" ?\p{N}+", rf" ?(?:(?![{NEWER}])\p{{N}})+")
)


def split_words(text: str) -> list[str]:
    try:
        text.encode("latin-1")  # much faster than a search
        return _LATIN.findall(text)
    except UnicodeEncodeError:
        return (_STRICT if _HAS_NEWER.search(text) else _PLAIN).findall(text)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges: arrays per token id (left and right part, rank, live) and the ranked pair splits."""

    def __init__(self, labels: list[bytes], left: list[int], right: list[int], rank: list[int], splits: dict[tuple[int, int], int], live: list[bool], added: dict[str, int]):
        self.labels, self.left, self.right, self.rank, self.splits, self.added = labels, left, right, rank, splits, added
        specials = set(added.values())
        self.sizes = [len(label) for label in labels]
        self.table: dict[int, bool] = {}
        self.trie: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        for token, label in enumerate(labels):
            if live[token] and token not in specials:
                node = 0
                for byte in label:
                    node = self.trie.setdefault(node << 8 | byte, len(self.trie) + 1)
                self.ends[node] = token
        self.start()

    def arc(self, before: int, token: int) -> bool:
        """Whether the state behind ``before`` has an arc for ``token``."""
        key = before * len(self.labels) + token
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= TABLE_ARCS:
                self.table.clear()
            known = self.table[key] = self._arc(before, token)
        return known

    def _arc(self, before: int, token: int) -> bool:
        end, until = before, 1 << 60
        while end >= 0:
            head, made = token, 1 << 60
            while head >= 0:
                split = self.splits.get((end, head))
                if split is not None and split < until and split <= made:
                    return False
                made, head = self.rank[head], self.left[head]
            until, end = min(until, self.rank[end]), self.right[end]
        return True

    def start(self) -> None:
        """Empty byte table: state 0 has read nothing. A state is the last token of what was read and, for each token that may
        still be under way, its trie node with the token before it. Equal states share a number."""
        self.step: dict[int, int] = {}
        self.states: dict[tuple[int, ...], int] = {(-1,): 0}
        self.content: list[tuple[int, ...]] = [(-1,)]

    def _grow(self, state: int, byte: int) -> int:
        last, *under_way = self.content[state]
        trie, ends, alive, token = self.trie, self.ends, [], -1
        for node, before in (*zip(under_way[::2], under_way[1::2]), (0, last)):
            child = trie.get(node << 8 | byte)
            if child is not None:
                alive += (child, before)
                end = ends.get(child)
                if end is not None and (before < 0 or self.arc(before, end)):
                    token = end
        made = (token, *alive)
        number = self.states.setdefault(made, len(self.content))
        if number == len(self.content):
            self.content.append(made)
        self.step[state << 8 | byte] = number
        return number

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Walk the byte table, then follow the last tokens back."""
        step, content, sizes, state, last = self.step, self.content, self.sizes, 0, []
        for byte in word:
            after = step.get(state << 8 | byte)
            if after is None:
                if len(content) >= TABLE_STATES:
                    state = self._restart(state)
                    step, content = self.step, self.content
                after = self._grow(state, byte)
            state = after
            last.append(content[state][0])
        path, i = [], len(word)
        while i:
            token = last[i - 1]
            path.append(token)
            i -= sizes[token]
        return tuple(reversed(path))

    def _restart(self, state: int) -> int:
        """Empties the byte table and returns the new number of a state."""
        here = self.content[state]
        self.start()
        if here != self.content[0]:
            self.states[here] = len(self.content)
            self.content.append(here)
        return self.states[here]

    def decode(self, ids) -> str:
        size = len(self.labels)
        return b"".join([self.labels[i] for i in ids if 0 <= i < size]).decode("utf-8", "replace")


def compile_merges(vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int] | None = None) -> Automaton:
    added = added or {}
    symbols, size = byte_symbols(), max([*vocab.values(), *added.values()]) + 1
    labels, left, right, rank, live = [b""] * size, [-1] * size, [-1] * size, [-1] * size, [False] * size
    for token, i in vocab.items():
        labels[i] = bytes(symbols[c] for c in token)
        live[i] = len(token) == 1
    for content, i in added.items():
        labels[i] = content.encode()
    machine = Automaton(labels, left, right, rank, {}, [False] * size, added)
    for t, (u, v) in enumerate(merges):
        a, b, w = vocab[u], vocab[v], vocab[u + v]
        if not (live[a] and live[b]) or live[w] or not machine._arc(a, b):
            continue  # the pair never stands side by side, so the gadget finds no path
        machine.splits[a, b] = t
        left[w], right[w], rank[w], live[w] = a, b, t, True
    return Automaton(labels, left, right, rank, machine.splits, live, added)


def read_tokenizer(path: str) -> Automaton:
    """Compile a byte-level BPE file of the tokenizers library (read on the driver; its size is the vocabulary's)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return compile_merges(spec["model"]["vocab"], pairs, {a["content"]: a["id"] for a in spec.get("added_tokens", [])})


class _Words(dict):
    """Token ids of the words met lately."""

    def __init__(self, machine: Automaton):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.machine.encode_word(word.encode())
        if len(word) > CACHED_SIZE:
            return ids
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    def __init__(self, machine: Automaton):
        self.words, self.added = _Words(machine), machine.added
        self.cut = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(machine.added, key=len, reverse=True)) + ")") if machine.added else None

    def ids(self, text: str) -> np.ndarray:
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out.extend(chain.from_iterable(map(self.words.__getitem__, split_words(part))))
        return np.array(out, dtype=np.int32)


#: The encoder a worker process used last, by tokenizer, so that its word cache outlives a task. Never more than one.
_ENCODER: dict[str, Encoder] = {}


def _encoder(key: str, shared) -> Encoder:
    if key not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[key] = Encoder(shared.value)
    return _ENCODER[key]


def _key(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds ``ids``: array<int> of each text; with ``decoded`` also the text that decoding these ids gives, in the same pass."""
    shared, key = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer)), _key(tokenizer)
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.StringType(), False)] if decoded else [])]
    schema = T.StructType([*docs.schema.fields, *added])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared)
        for batch in batches:
            for part in _small(batch, at):
                lists = [encoder.ids(t.as_py() or "") for t in part.column(at)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*lists, np.empty(0, np.int32)])))]
                if decoded:
                    columns.append(pa.array([encoder.words.machine.decode(x.tolist()) for x in lists], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *[f.name for f in added]])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the text whose bytes are the arc labels of ``ids``."""
    shared, key = encoded.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer)), _key(tokenizer)
    schema = T.StructType([*encoded.schema.fields, T.StructField(decoded, T.StringType(), False)])
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _encoder(key, shared).words.machine
        for batch in batches:
            column = batch.column(at)
            texts = [machine.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else ()) for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, decoded])

    return encoded.mapInArrow(run, schema)


def _small(batch: pa.RecordBatch, at: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text, so that ids of few texts are in memory at once."""
    column, start, size = batch.column(at), 0, 0
    for i in range(batch.num_rows):
        size += len(column[i].as_buffer() or b"") if column[i].is_valid else 0
        if size >= limit:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)

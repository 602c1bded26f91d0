"""Token counts of whole texts by a map-side two-tier look-up of pre-token lengths.

A sentencepiece BPE model whose pieces hold a space mark only in front joins nothing across the
start of a run of spaces, nor next to a character that no longer piece contains. Texts are cut there;
a pre-token's number of tokens does not depend on its neighbours, and a text's count is the sum.

* Tier 1: a broadcast open-addressing table of the frequent pre-tokens of at most 16 bytes. Its keys are
  the bytes themselves (two words and a length), so a hit needs no further check; whole batches
  are looked up at once in numpy arrays.
* Tier 2: every other pre-token goes to a dictionary of the worker, and from there to the model.

Which pre-tokens are frequent follows from all documents: each scanning task keeps a mergeable
summary of at most SUMMARY pre-tokens (counts less the count of the first one left out), and
summaries, one row a task, are merged in a tree. A pre-token met more than total / SUMMARY times
is sure to be in the last one. No pre-token is shuffled, and the table has a fixed size.

Defined cases: a null or empty text has no token and no byte; texts of spaces only have tokens; the
strings of control pieces are ordinary text, as they are for the library; long texts are counted whole (a
pre-token of any length is one call of the model); repeated rows and ids give repeated results.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bpe import slices
from .common import read_texts

#: Documents of more tokens are over the limit.
LIMIT = 4096
#: Pre-tokens of a summary and of the broadcast table.
SUMMARY = 1 << 15
#: Pre-tokens that a worker keeps in its dictionary, and the most bytes of one.
HELD, HELD_BYTES = 500_000, 64
#: Summaries that one task merges.
FAN = 32
#: Most bytes of a pre-token of the table.
KEY_BYTES = 16

# Fixed value: the mark that stands for a space in the pieces of such a model.
MARK = "▁"
_MARK = MARK.encode()
_KEEP = np.array([0xFFFFFFFFFFFFFFFF >> (64 - 8 * n) if n else 0 for n in range(9)], np.uint64)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Model:
    """The library's processor, checked to be one whose texts can be cut."""

    def __init__(self, path: str):
        self.of = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.of.id_to_piece(i) for i in range(self.of.get_piece_size()) if not self.of.is_byte(i)]
        probe = " Aé\tﬁ 　 "
        if self.of.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError(f"{path} changes texts before it encodes them")
        if not any(self.of.is_byte(i) for i in range(self.of.get_piece_size())):
            raise ValueError(f"{path} has no pieces for single bytes")
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError(f"{path} has pieces that hold a space after other characters")
        joined = {c for p in pieces if len(p) > 1 for c in p}
        #: By byte: an ASCII character (no space) that no longer piece contains.
        self.alone = np.array([b < 128 and b != 32 and chr(b) not in joined for b in range(256)])
        self._lead = next((chr(b) for b in range(128) if self.alone[b]), None)

    def lengths(self, words: list[bytes]) -> list[int]:
        """Tokens of each pre-token; one that starts without a space follows a character of its own."""
        texts, less = [], []
        for raw in words:
            word = raw.decode()
            if word.startswith(" "):
                texts.append(word[1:])
                less.append(-1 if word == " " else 0)
            else:
                texts.append(f"{self._lead}{word}")
                less.append(2)  # the space in front of every text, and the lead
        found = self.of.encode(texts, num_threads=1)
        return [len(ids) - n for ids, n in zip(found, less)]


class Cuts:
    """The pre-tokens of a batch of texts, each text with a space in front."""

    def __init__(self, texts: pa.Array, alone: np.ndarray):
        offsets, data = _buffers(texts)
        if _MARK in data.tobytes():
            offsets, data = _buffers(pa.array([t.replace(MARK, " ") for t in texts.to_pylist()], pa.string()))
        bounds = offsets - offsets[0]
        self.first = bounds[:-1] + np.arange(len(bounds) - 1)  # of each text
        padded = np.zeros(len(data) + len(self.first) + KEY_BYTES, np.uint8)
        n = len(padded) - KEY_BYTES
        padded[:n] = np.insert(data, bounds[:-1], 32)
        space, single = padded[:n] == 32, alone[padded[:n]]
        start = np.empty(n, bool)
        start[1:] = (space[1:] & ~space[:-1]) | single[1:] | single[:-1]
        start[self.first] = True
        self.at = np.flatnonzero(start)
        self.size = np.diff(self.at, append=n)
        self.raw = padded[:n].tobytes()
        loads = np.ndarray((n + 9,), "<u8", buffer=padded, strides=(1,))
        self.low = loads[self.at] & _KEEP[np.minimum(self.size, 8)]
        self.high = loads[np.minimum(self.at + 8, n + 8)] & _KEEP[np.clip(self.size - 8, 0, 8)]

    def word(self, i: int) -> bytes:
        return self.raw[self.at[i] : self.at[i] + self.size[i]]

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values of each text's pre-tokens."""
        if not len(self.first):
            return np.zeros(0, np.int64)
        return np.add.reduceat(values, np.searchsorted(self.at, self.first))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (as 64-bit numbers) and bytes of a string array; a slice's bytes only."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    return offsets, np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)


def _mixed(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    x = (low ^ (low >> np.uint64(29))) * _ODD[0] + (high ^ (high >> np.uint64(31))) * _ODD[1] + size.astype(np.uint64) * _ODD[2]
    return (x ^ (x >> np.uint64(32))) * _ODD[0]


class LengthTable:
    """Open addressing with linear probing; keys of at most KEY_BYTES bytes, exact."""

    def __init__(self, packed: bytes):
        self.slots = int.from_bytes(packed[:8], "little")
        self.probes = int.from_bytes(packed[8:16], "little")
        view, at, parts = memoryview(packed), 16, []
        for kind, width in (("<u8", 8), ("<u8", 8), ("<u1", 1), ("<u1", 1)):
            parts.append(np.frombuffer(view[at : at + width * self.slots], kind))
            at += width * self.slots
        self.low, self.high, self.size, self.tokens = parts

    @staticmethod
    def compile(words: list[bytes], lengths: list[int]) -> bytes:
        """Each word at most KEY_BYTES long and once; at most half of the slots are used."""
        slots = 16
        while slots < 2 * len(words):
            slots *= 2
        low, high = np.zeros(slots, "<u8"), np.zeros(slots, "<u8")
        size, tokens, most = np.zeros(slots, np.uint8), np.zeros(slots, np.uint8), 0
        a = np.array([int.from_bytes(w[:8], "little") for w in words], np.uint64)
        b = np.array([int.from_bytes(w[8:], "little") for w in words], np.uint64)
        n = np.array([len(w) for w in words], np.int64)
        homes = (_mixed(a, b, n) >> np.uint64(20)).astype(np.int64) & (slots - 1) if words else []
        for i, slot in enumerate(homes):
            probes = 1
            while size[slot]:
                slot, probes = (slot + 1) & (slots - 1), probes + 1
            low[slot], high[slot], size[slot], tokens[slot] = a[i], b[i], n[i], lengths[i]
            most = max(most, probes)
        return slots.to_bytes(8, "little") + most.to_bytes(8, "little") + b"".join(x.tobytes() for x in (low, high, size, tokens))

    def find(self, cuts: Cuts) -> np.ndarray:
        """Tokens of each pre-token, -1 where the table has none."""
        out = np.full(len(cuts.at), -1, np.int64)
        left = np.flatnonzero(cuts.size <= KEY_BYTES)
        slot = (_mixed(cuts.low[left], cuts.high[left], cuts.size[left]) >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        for _ in range(self.probes):
            hit = (self.low[slot] == cuts.low[left]) & (self.high[slot] == cuts.high[left]) & (self.size[slot] == cuts.size[left])
            out[left[hit]] = self.tokens[slot[hit]]
            on = ~hit & (self.size[slot] > 0)
            left, slot = left[on], (slot[on] + 1) & (self.slots - 1)
        return out


class Counting:
    """Both tiers in one worker."""

    def __init__(self, path: str, packed: bytes):
        self.model, self.table, self.held = Model(path), LengthTable(packed), {}

    def tokens(self, texts: pa.Array) -> np.ndarray:
        cuts = Cuts(texts, self.model.alone)
        found = self.table.find(cuts)
        missed = np.flatnonzero(found < 0)
        words = [cuts.word(i) for i in missed.tolist()]
        held = self.held
        new = [w for w in dict.fromkeys(words) if w not in held]
        if new:
            if len(held) + len(new) > HELD:
                held.clear()
                new = list(dict.fromkeys(words))
            held.update(zip(new, self.model.lengths(new)))
        found[missed] = [held[w] for w in words]
        for word in new:
            if len(word) > HELD_BYTES:
                del held[word]
        return cuts.totals(found)


_WORKERS: dict[tuple[str, bytes], Counting] = {}


def _counting(path: str, packed: bytes) -> Counting:
    """One per Python worker, model and table; later tasks use it again."""
    key = (path, hashlib.sha256(packed).digest())
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = Counting(path, packed)
    return _WORKERS[key]


def _pruned(counts: dict[bytes, int], size: int) -> dict[bytes, int]:
    """The ``size`` largest, less the count of the next one; ties go by the bytes."""
    if len(counts) <= size:
        return counts
    ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    return {w: n - ranked[size][1] for w, n in ranked[:size] if n > ranked[size][1]}


_SUMMARY = "slot long, words array<binary>, counts array<long>"


def _summary(slot: int, counts: dict[bytes, int]) -> pa.RecordBatch:
    words, n = [list(counts)], [list(counts.values())]
    return pa.record_batch([pa.array([slot], pa.int64()), pa.array(words, pa.list_(pa.binary())), pa.array(n, pa.list_(pa.int64()))], ["slot", "words", "counts"])


def frequent(docs: DataFrame, path: str, size: int = SUMMARY) -> list[bytes]:
    """At most ``size`` pre-tokens of all documents, among them all met more than total / size times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone, seen = Model(path).alone, Counter()
        for batch in batches:
            for part in slices(batch):
                cuts = Cuts(part.column(0), alone)
                short = np.flatnonzero(cuts.size <= KEY_BYTES)
                _, first, n = np.unique(_mixed(cuts.low[short], cuts.high[short], cuts.size[short]), return_index=True, return_counts=True)
                for i, k in zip(short[first].tolist(), n.tolist()):
                    seen[cuts.word(i)] += k
                if len(seen) > 8 * size:
                    seen = Counter(_pruned(seen, size))
        yield _summary(TaskContext.get().partitionId(), _pruned(seen, size))

    def merge(found: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        for words, n in zip(found.column("words").to_pylist(), found.column("counts").to_pylist()):
            for w, k in zip(words, n):
                counts[w] += k
        return pa.Table.from_batches([_summary(found.column("slot")[0].as_py(), _pruned(counts, size))])

    found = cut(read_texts(docs).select("text").mapInArrow(count, _SUMMARY), "summaries")
    last = found.agg(F.max("slot")).collect()[0][0] or 0
    while last:
        found = found.withColumn("slot", F.floor(F.col("slot") / FAN).cast("long")).groupBy("slot").applyInArrow(merge, _SUMMARY)
        last //= FAN
    return sorted(bytes(w) for row in found.select("words").collect() for w in row.words)


def build_table(docs: DataFrame, path: str, size: int = SUMMARY) -> bytes:
    """The compiled table of the frequent pre-tokens; at most 36 * size bytes and a head."""
    words = [w for w in frequent(docs, path, size) if w]
    return LengthTable.compile(words, Model(path).lengths(words))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, size: int = SUMMARY) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``; one row per input row."""
    packed = docs.sparkSession.sparkContext.broadcast(build_table(docs, path, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = _counting(path, packed.value)
        for batch in batches:
            for part in slices(batch):
                n_bytes = np.diff(_buffers(part.column(1))[0])
                tokens = np.where(n_bytes > 0, counting.tokens(part.column(1)), 0)
                columns = [part.column(0), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit, pa.bool_())]
                yield pa.record_batch(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return read_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

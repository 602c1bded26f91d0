"""Byte-level BPE with a minimal acyclic transducer as its lexicon.

Encoding cuts a text into words by the vocabulary's pattern. Frequent words (counted over all
documents) are compiled into a minimal acyclic automaton: common prefixes and suffixes share
states, and the numbers on the arcs of a word's path add up to its place in the id table. The
compiled bytes are memory-mapped in each worker. Every other word is merged exactly by the ranks.
A bounded dictionary in front holds the words met last.

Defined cases: a null or empty text has no ids; the strings of special tokens become their ids;
very long texts are cut word by word; repeated rows and ids give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import struct
import tempfile
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import read_texts

# Fixed value: the public pattern of this kind of vocabulary. Letters come first here, as most words
# are letters; the alternatives differ in their first characters, so their order is free.
_QUICK = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters whose classes depend on the library or its Unicode version, and all not known not to:
#: texts with them are cut by the library's own pre-tokenizer.
_ODD = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_LIBRARY = ByteLevel(add_prefix_space=False)

#: Words that a worker keeps in its dictionary.
HELD_WORDS = 1_000_000
#: Words of the lexicon; bounds the compiled automaton.
LEXICON_WORDS = 1 << 17
#: Distinct words that a counting task holds before it hands them on.
FLUSH_WORDS = 300_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and ids of a byte-level ``tokenizer.json``; without ``merging`` the merges are left to another model."""

    def __init__(self, path: str, merging: bool = True):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        model, pre = read["model"], read["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or read["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        letters = _byte_letters()
        ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"] if merging else []):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = (bytes(letters[c] for c in x) for x in (left, right))
            self.pairs[ids[a], ids[b]] = (rank, ids[a + b])
        self.bytes_of = [b""] * (1 + max([*ids.values(), *self.specials.values()]))
        for token, i in [*ids.items(), *((s.encode(), i) for s, i in self.specials.items())]:
            self.bytes_of[i] = token
        longest_first = sorted(self.specials, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of least rank, leftmost first, is joined until none is left."""
        ids, get, none = [self.single[b] for b in word], self.pairs.get, (1 << 40, -1)
        ranks = [get(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best[1] < 0:
                break
            if len(ids) > 200:  # long runs: all places of the pair in one pass
                ids = self._join_all(ids, best)
                ranks = [get(pair, none) for pair in zip(ids, ids[1:])]
                continue
            at = ranks.index(best)
            ids[at : at + 2] = [best[1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get((ids[at], ids[at + 1]), none)
            if at:
                ranks[at - 1] = get((ids[at - 1], ids[at]), none)
        return ids

    def _join_all(self, ids: list[int], best: tuple[int, int]) -> list[int]:
        out, i, get = [], 0, self.pairs.get
        while i < len(ids):
            if i + 1 < len(ids) and get((ids[i], ids[i + 1])) == best:
                out.append(best[1])
                i += 2
            else:
                out.append(ids[i])
                i += 1
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def words_of(text: str) -> list[str]:
    """The words of a text without special tokens; joined they give the text."""
    if _ODD.search(text):
        return [text[a:b] for _, (a, b) in _LIBRARY.pre_tokenize_str(text)]
    return _QUICK.findall(text)


class Lexicon:
    """A minimal acyclic automaton over words, with ids as output; read from mapped bytes.

    Layout: six counts and arrays of 32-bit numbers (first arc of each state, target and added
    number of each arc, first id of each word, ids), then the final marks and the arcs' bytes.
    """

    def __init__(self, raw: bytes):
        with tempfile.TemporaryFile() as file:  # without a name: nothing stays behind
            file.write(raw)
            file.flush()
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        states, arcs, words, ids = struct.unpack_from("<4I", self._map)
        view, at, parts = memoryview(self._map), 16, []
        for n in (states + 1, arcs, arcs, words + 1, ids):
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self._first, self._to, self._add, self._start, self._ids = parts
        self._final = view[at : at + states]
        self._bytes_at = at + states
        self.states, self.words = states, words

    @staticmethod
    def compile(entries: list[tuple[bytes, list[int]]]) -> bytes:
        """Entries must be sorted by word, without repeats. States with equal futures are made once."""
        nodes: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        known: dict[tuple, int] = {}

        def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
            key = (final, tuple(arcs))
            if key not in known:
                known[key] = len(nodes)
                nodes.append(key)
            return known[key]

        path: list[list] = [[False, []]]  # of the last word: final mark and settled arcs
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], settle(final, arcs)))

        for word, _ in entries:
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            close(same)
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            last = word
        close(0)
        root = settle(*path[0])

        below = []  # words that start at each state; targets are always settled before
        for final, arcs in nodes:
            below.append(final + sum(below[to] for _, to in arcs))
        order = [root, *(i for i in range(len(nodes)) if i != root)]
        number = {node: i for i, node in enumerate(order)}
        first, to, add, marks, letters = array("I", [0]), array("I"), array("I"), bytearray(), bytearray()
        for node in order:
            final, arcs = nodes[node]
            before = int(final)
            for byte, target in arcs:
                letters.append(byte)
                to.append(number[target])
                add.append(before)
                before += below[target]
            first.append(len(to))
            marks.append(final)
        start, ids = array("I", [0]), array("I")
        for _, out in entries:
            ids.extend(out)
            start.append(len(ids))
        head = struct.pack("<4I", len(nodes), len(to), len(entries), len(ids))
        return head + b"".join(x.tobytes() for x in (first, to, add, start, ids)) + bytes(marks) + bytes(letters)

    def find(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit numbers, or None."""
        state, place, first, base, find = 0, 0, self._first, self._bytes_at, self._map.find
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            place += self._add[arc]
            state = self._to[arc]
        if not self._final[state]:
            return None
        return self._ids[self._start[place] : self._start[place + 1]].tobytes()


def library_merge(path: str) -> Callable[[bytes], list[int]]:
    """Ids of one word as the library's own model merges it; for callers that only need the ids."""
    model, letters = Tokenizer.from_file(path).model, {b: letter for letter, b in _byte_letters().items()}
    return lambda word: [t.id for t in model.tokenize(word.decode("latin-1").translate(letters))]


class Encoder(dict):
    """Ids of texts as bytes. The dictionary itself holds the words met last."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, merge: Callable[[bytes], list[int]] | None = None):
        super().__init__()
        self.vocabulary, self.lexicon, self.merge = vocabulary, lexicon, merge or vocabulary.merge

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        found = self.lexicon.find(raw) if self.lexicon else None
        if found is None:
            found = array("I", self.merge(raw)).tobytes()
        if len(self) >= HELD_WORDS:
            self.clear()
        if len(raw) <= 64:
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        cut = self.vocabulary.cut
        if cut is None or not cut.search(text):
            return b"".join(map(self.__getitem__, words_of(text)))
        out = []
        for piece in cut.split(text):
            if piece in self.vocabulary.specials:
                out.append(struct.pack("<I", self.vocabulary.specials[piece]))
            else:
                out.extend(map(self.__getitem__, words_of(piece)))
        return b"".join(out)


_ENCODERS: dict[tuple[str, bytes, bool], Encoder] = {}


def encoder_of(path: str, compiled: bytes = b"", library: bool = False) -> Encoder:
    """One encoder per Python worker, vocabulary and lexicon; later tasks use it again.

    With ``library`` words are merged by the library's model instead of by the ranks here; the ids are the same.
    """
    key = (path, hashlib.sha256(compiled).digest(), library)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(path, merging=not library), Lexicon(compiled) if compiled else None, library_merge(path) if library else None)
    return _ENCODERS[key]


def forget_encoders() -> None:
    """Drop the encoder that earlier tasks left in this Python worker, with all words it holds.

    Called in tasks that encode nothing: a worker outlives its stage, and so would up to HELD_WORDS words.
    """
    _ENCODERS.clear()


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """``word, n`` over all documents: tasks count, then the counts are added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = Vocabulary(path).cut, Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for piece in cut.split(text) if cut else [text]:
                    seen.update(words_of(piece))
                if len(seen) >= FLUSH_WORDS:
                    yield out()
                    seen.clear()
        yield out()

    parts = read_texts(docs).select("text").mapInArrow(count, "word string, n long")
    return parts.filter(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, n_words: int = LEXICON_WORDS) -> bytes:
    """Compile the ``n_words`` most frequent words of all documents; at most a few MB whatever the corpus."""
    vocabulary = Vocabulary(path)
    short = word_counts(docs, path).filter(F.octet_length("word") <= 64)
    frequent = short.orderBy(F.desc("n"), "word").limit(n_words).select("word").collect()
    words = sorted(row.word.encode() for row in frequent)
    return Lexicon.compile([(w, vocabulary.merge(w)) for w in words])


def encode_documents(docs: DataFrame, path: str, compiled: bytes = b"") -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, lexicon.value)
        for batch in batches:
            for part in slices(batch):
                ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    lexicon = docs.sparkSession.sparkContext.broadcast(compiled)
    return read_texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder_of(path).vocabulary
        for batch in batches:
            texts = [vocabulary.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, max(batch.num_rows, 1), rows):
        yield batch.slice(at, rows)


def encode_decode(docs: DataFrame, path: str, n_words: int = LEXICON_WORDS) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip``; one row per input row.
    """
    lexicon = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, path, n_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, lexicon.value)
        decode, digest = encoder.vocabulary.decode, hashlib.sha256
        for batch in batches:
            for part in slices(batch):
                n, ids_sha, text_sha, same = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = encoder.encode(text)
                    back = decode(np.frombuffer(ids, "<u4").tolist())
                    n.append(len(ids) // 4)
                    ids_sha.append(digest(ids).hexdigest())
                    text_sha.append(digest(back.encode()).hexdigest())
                    same.append(back == text)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())]
                yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return read_texts(docs).mapInArrow(run, schema)

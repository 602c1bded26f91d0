"""LM scoring by context-tree weighting over bytes, beside a unigram base score.

Each byte is eight binary decisions. A context is the bytes before (up to DEPTH); at each context and
each of the 255 decision nodes a Krichevsky-Trofimov estimate predicts the bit. The weighted
probability of a node is half its own estimate's and half the product of its children's, so
predictions mix all depths by how well they did on the training documents.

Counts are gathered over all training documents (byte strings of DEPTH + 1, with counts), and every
context of the training text has its node: the tree grows with the corpus. It is a table with one row
for each context and decision node; weights go up and mixtures down by one join or sum a depth, and no
key has more than 256 rows below it. The outcome is one score for each distinct byte string of the
documents; tasks have those of the most frequent strings at hand, all others are joined.

What is scored is the string of a document's tokens in lower case (A-Z only), joined by one space,
with an end symbol (0xFF, which UTF-8 has not); contexts before its start are 0xFF.

Defined cases: a null or empty text is just its end; a null id is the id "" (crc32 0: held out);
without training documents each bit has probability one half and each token 1; repeated rows count
each time.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from .bpe import slices
from .common import read_texts

DEPTH = 5
END = b"\xff"
#: Frequent words whose scores every task has at hand; all others are joined.
FREQUENT = 1 << 17
#: Byte strings, likewise; at most so many.
FREQUENT_GRAMS = 1 << 20
#: Distinct words and byte strings that a counting task holds before it hands them on.
FLUSH = 400_000
FLUSH_GRAMS = 2_000_000
#: Bytes of a document that are scored at once.
SEGMENT = 1 << 20
#: Contexts that are worked on at once where a tree is grown in memory.
CHUNK = 1000


def cut(df: DataFrame, label: str) -> DataFrame:
    """As everywhere, but packed harder: the tree's tables are many times larger than the text."""
    return session.cut(df, label, "zstd")


def tokens_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: A-Z only, and just the six white-space bytes


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _layout(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all bodies, each after DEPTH end bytes and before one, and the places of what is predicted."""
    data = np.frombuffer(b"".join(END * DEPTH + b + END for b in bodies), np.uint8)
    lengths = np.array([len(b) + 1 for b in bodies])
    skip = np.repeat(DEPTH * np.arange(1, len(bodies) + 1), lengths)
    return data, np.arange(lengths.sum()) + skip


def _grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    grams = np.zeros(len(at), np.int64)
    for back in range(DEPTH, -1, -1):
        grams = (grams << 8) | data[at - back]
    return grams


def gram_counts(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(_grams(*_layout(bodies)), return_counts=True)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def corpus_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``word, n`` and ``gram, n, seen`` (written tables), and how many training documents there are.

    ``n`` counts in training documents; ``seen`` counts a gram in all documents, as all are scored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "gram", "n", "seen"]

        def words_out(words: Counter) -> pa.RecordBatch:
            n = pa.array(list(words.values()), pa.int64())
            return pa.record_batch([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), n, n], names)

        def grams_out(keys: np.ndarray, n: np.ndarray, held_out: bool) -> pa.RecordBatch:
            seen = n.astype(np.int64)
            return pa.record_batch([pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(seen * (not held_out)), pa.array(seen)], names)

        words, grams, held, n_docs = Counter(), {False: [], True: []}, {False: 0, True: 0}, 0
        for batch in batches:
            for part in slices(batch):
                tokens = {False: [], True: []}
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    tokens[is_held_out(doc_id)].append(tokens_of(text))
                n_docs += len(tokens[False])
                for t in tokens[False]:
                    words.update(t)
                if len(words) >= FLUSH:
                    yield words_out(words)
                    words.clear()
                for kind, own in tokens.items():
                    if own:
                        grams[kind].append(gram_counts([b" ".join(t) for t in own]))
                        held[kind] += len(grams[kind][-1][0])
                    if held[kind] >= 2 * FLUSH_GRAMS:
                        grams[kind] = [_added(grams[kind])]
                        held[kind] = len(grams[kind][0][0])
                        if held[kind] >= FLUSH_GRAMS:
                            yield grams_out(*grams[kind][0], kind)
                            grams[kind], held[kind] = [], 0
        yield words_out(words)
        for kind, parts in grams.items():
            if parts:
                yield grams_out(*_added(parts), kind)
        n = pa.array([n_docs], pa.int64())
        yield pa.record_batch([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), n, n], names)

    parts = read_texts(docs).mapInArrow(run, "word binary, gram long, n long, seen long")
    counts = cut(parts.groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "counts")
    words = counts.filter(F.col("word").isNotNull()).select("word", "n")
    grams = counts.filter(F.col("gram").isNotNull()).select("gram", "n", "seen")
    n_docs = counts.filter(F.col("word").isNull() & F.col("gram").isNull()).agg(F.sum("n")).first()[0] or 0
    return words, grams, n_docs


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of at least 0.5: shifted by 8, then Stirling's series."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def bit_counts(counts: np.ndarray) -> np.ndarray:
    """Counts of 256 symbols as a heap: node i decides between 2i and 2i + 1; symbol s is 256 + s."""
    heap = np.zeros((len(counts), 512))
    heap[:, 256:] = counts
    for first in (128, 64, 32, 16, 8, 4, 2, 1):
        heap[:, first : 2 * first] = heap[:, 2 * first : 4 * first : 2] + heap[:, 2 * first + 1 : 4 * first : 2]
    return heap


def kt_log(heap: np.ndarray) -> np.ndarray:
    zero, one = heap[:, 0:512:2][:, :256], heap[:, 1:512:2][:, :256]
    out = np.zeros((len(heap), 256))
    some = (zero + one) > 0
    some[:, 0] = False
    a, b = zero[some], one[some]
    out[some] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)
    return out


def kt_next(heap: np.ndarray) -> np.ndarray:
    """Probability of a one at each decision node."""
    zero, one = heap[:, 0:512:2][:, :256], heap[:, 1:512:2][:, :256]
    return (one + 0.5) / (zero + one + 1)


@dataclass
class ContextTree:
    """A tree in memory, for few documents. ``child``: of inner nodes (the first ones), the node for each byte further back; ``log10p``: of leaves, by symbol."""

    child: np.ndarray
    log10p: np.ndarray

    def score(self, bodies: list[bytes]) -> np.ndarray:
        """log10 probability of each body with its end."""
        out = np.zeros(len(bodies))
        small, of, size = [], [], 0
        for i, body in enumerate(bodies):
            if len(body) > SEGMENT:
                out[i] = self._long(body)
                continue
            small.append(body)
            of.append(i)
            size += len(body)
            if size > 2 * SEGMENT:
                out[of] = self._sums(small)
                small, of, size = [], [], 0
        if small:
            out[of] = self._sums(small)
        return out

    def _each(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        inner = len(self.child)
        node = np.zeros(len(at), np.int32)
        for back in range(1, DEPTH + 1):
            go = np.flatnonzero(node < inner)
            node[go] = self.child[node[go], data[at[go] - back]]
        return self.log10p[node - inner, data[at]]

    def _sums(self, bodies: list[bytes]) -> np.ndarray:
        data, at = _layout(bodies)
        lengths = np.array([len(b) + 1 for b in bodies])
        return np.add.reduceat(self._each(data, at).astype(np.float64), np.cumsum(lengths) - lengths)

    def _long(self, body: bytes) -> float:
        body = END * DEPTH + body + END
        total = 0.0
        for start in range(DEPTH, len(body), SEGMENT):
            data = np.frombuffer(body[start - DEPTH : start + SEGMENT], np.uint8)
            total += float(self._each(data, np.arange(DEPTH, len(data))).astype(np.float64).sum())
        return total


def grow(levels: list[tuple[np.ndarray, np.ndarray]]) -> ContextTree:
    """The weighted tree from the kept contexts of each depth (sorted) and their symbol counts.

    ``levels[0]`` is the root: one context 0. A depth may be empty.
    """
    last = max(d for d, (c, _) in enumerate(levels) if len(c))
    counts = [levels[d][1] for d in range(last + 1)]
    parents: list = [None]
    for d in range(1, last + 1):
        parents.append(np.searchsorted(levels[d - 1][0], levels[d][0] & ((1 << 8 * (d - 1)) - 1)))
    inner, rest, mix, deeper = [], [None] * (last + 1), [None] * (last + 1), None
    half = math.log(0.5)
    for d in range(last, -1, -1):  # deeper: log of the children's weighted probabilities, by node
        has = np.zeros(len(counts[d]), bool)
        if d < last:
            has[parents[d + 1]] = True
            rest[d] = counts[d].copy()
            np.subtract.at(rest[d], parents[d + 1], counts[d + 1])
            mix[d] = np.zeros((len(has), 256), np.float32)
        up = np.zeros((len(counts[d - 1]), 256)) if d else None
        for at in range(0, len(has), CHUNK):
            part = slice(at, at + CHUNK)
            weighted = own = kt_log(bit_counts(counts[d][part]))
            if d < last:
                below = deeper[part] + kt_log(bit_counts(rest[d][part]))
                both = np.logaddexp(half + own, half + below)
                weighted = np.where(has[part, None], both, own)
                mix[d][part] = np.exp(half + own - both)
            if d:
                np.add.at(up, parents[d][part], weighted)
        deeper = up
        inner.append(has)
    inner.reverse()

    numbers, count = [], 0
    for has in inner:  # inner nodes first
        numbers.append(np.where(has, count + np.cumsum(has) - 1, -1))
        count += int(has.sum())
    n_inner = count
    rest_number = []
    for d, has in enumerate(inner):
        numbers[d] = np.where(has, numbers[d], count + np.cumsum(~has) - 1)
        count += int((~has).sum())
        rest_number.append(np.where(has, count + np.cumsum(has) - 1, -1))
        count += int(has.sum())
    child = np.zeros((n_inner, 256), np.int32)
    log10p = np.zeros((count - n_inner, 256), np.float32)

    def settle(d: int, which: np.ndarray, numbers_: np.ndarray, leaf: list) -> None:
        """Mix a leaf's bits with those of the nodes above it."""
        for at in range(0, len(which), CHUNK):
            node, depth = which[at : at + CHUNK], d
            p = kt_next(bit_counts(leaf[d][node]))
            while depth >= 0:
                if mix[depth] is not None and inner[depth][node].all():
                    w = mix[depth][node]
                    p = w * kt_next(bit_counts(counts[depth][node])) + (1 - w) * p
                node, depth = (parents[depth][node] if depth else node), depth - 1
            logs = np.zeros((len(p), 512))
            for i in range(1, 256):
                logs[:, 2 * i] = logs[:, i] + np.log10(1 - p[:, i])
                logs[:, 2 * i + 1] = logs[:, i] + np.log10(p[:, i])
            log10p[numbers_[at : at + CHUNK] - n_inner] = logs[:, 256:]

    for d, has in enumerate(inner):
        leaves, nodes = np.flatnonzero(~has), np.flatnonzero(has)
        if len(leaves):
            settle(d, leaves, numbers[d][leaves], counts)
        if len(nodes):
            settle(d, nodes, rest_number[d][nodes], rest)
            child[numbers[d][nodes]] = rest_number[d][nodes][:, None]
            older = (levels[d + 1][0] >> (8 * d)) & 255
            child[numbers[d][parents[d + 1]], older] = numbers[d + 1]
    if not n_inner:  # the root alone
        child = np.zeros((0, 256), np.int32)
    return ContextTree(child, log10p)


def _weighted(cells: DataFrame, deepest: bool) -> DataFrame:
    """``context, node, zero, one`` with the log of the weighted probability and the share of the own estimate in it."""
    half = math.log(0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zero, one, below = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (2, 3, 4))
            own = log_gamma(zero + 0.5) + log_gamma(one + 0.5) - log_gamma(zero + one + 1) - math.log(math.pi)
            both = own if deepest else np.logaddexp(half + own, half + below)
            mix = np.ones(len(own)) if deepest else np.exp(half + own - both)
            yield pa.record_batch([*batch.columns[:4], pa.array(both), pa.array(mix)], ["context", "node", "zero", "one", "weighted", "mix"])

    return cells.mapInArrow(run, "context long, node int, zero long, one long, weighted double, mix double")


def _decisions(grams: DataFrame) -> DataFrame:
    """Eight rows for each gram: its columns, ``context``, ``node`` and the ``bit`` decided there."""
    symbol = F.col("gram").bitwiseAND(255).cast("int").alias("symbol")
    each = grams.select("*", F.shiftright("gram", 8).alias("context"), symbol, F.explode(F.array(*map(F.lit, range(8)))).alias("level"))
    return each.select(
        *grams.columns, "context", F.expr("shiftright(256 | symbol, 8 - level)").alias("node"), F.expr("shiftright(symbol, 7 - level) & 1").alias("bit")
    )


def _shorter(depth: int) -> Column:
    return F.col("context").bitwiseAND((1 << 8 * depth) - 1)


def tree_levels(grams: DataFrame) -> list[DataFrame]:
    """For each depth ``context, node, past, left``: a longer context predicts ``past + left * (its own prediction)``.

    All contexts of the training documents; of a decision node without counts there is no row, and it
    predicts one half. ``left`` is 0 at the last depth.
    """
    bits = _decisions(grams.filter("n > 0").select("gram", "n"))
    counted = bits.groupBy("context", "node").agg(F.sum(F.col("n") * (1 - F.col("bit"))).alias("zero"), F.sum(F.col("n") * F.col("bit")).alias("one"))
    cells = counted.withColumn("below", F.lit(0.0))
    levels = [cut(_weighted(cells, True), "level")]
    for depth in range(DEPTH - 1, -1, -1):
        up = levels[0].groupBy(_shorter(depth).alias("context"), "node")
        cells = up.agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"), F.sum("weighted").alias("below"))
        levels.insert(0, cut(_weighted(cells, False), "level"))
    own, rest = F.col("mix") * ((F.col("one") + 0.5) / (F.col("zero") + F.col("one") + 1)), 1 - F.col("mix")
    out = [cut(levels[0].select("context", "node", own.alias("past"), rest.alias("left")), "mixed")]
    for depth in range(1, DEPTH + 1):
        above = out[-1].withColumnsRenamed({"context": "above", "past": "p", "left": "l"})
        joined = levels[depth].withColumn("above", _shorter(depth - 1)).join(above, ["above", "node"])
        out.append(cut(joined.select("context", "node", (F.col("p") + F.col("l") * own).alias("past"), (F.col("l") * rest).alias("left")), "mixed"))
    return out


def gram_scores(grams: DataFrame) -> DataFrame:
    """``gram, seen, log10p`` of all grams, written once: each bit by the longest context that has counts for it."""
    levels = tree_levels(grams)
    bits, chances = _decisions(grams.select("gram", "seen")), []
    for depth in range(DEPTH, -1, -1):
        known = levels[depth].withColumnRenamed("context", "own")
        bits = bits.withColumn("own", _shorter(depth)).join(known, ["own", "node"], "left").drop("own")
        if depth == DEPTH:
            bits = cut(bits, "bits")
        chances.append(bits.filter("past is not null").select("gram", "seen", "bit", (F.col("past") + F.col("left") / 2).alias("p")))
        bits = bits.filter("past is null").drop("past", "left")
    chances.append(bits.select("gram", "seen", "bit", F.lit(0.5).alias("p")))
    every = functools.reduce(DataFrame.unionByName, chances)
    log = F.log10(F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p")))
    return cut(every.groupBy("gram").agg(F.first("seen").alias("seen"), F.sum(log).alias("log10p")), "grams")


def _frequent(counted: DataFrame, times: str, most: int) -> DataFrame:
    """All rows that were met more often than some limit, ``most`` at most; the limit follows from a histogram of the counts."""
    band = F.floor(4 * F.log2(times))
    total, least = 0, None
    for b, n in sorted(counted.groupBy(band.alias("b")).count().collect(), reverse=True):
        total += n
        if total > most:
            break
        least = b
    return counted.filter(F.lit(False) if least is None else band >= least)


def _most_frequent(scored: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams in order and their scores, FREQUENT_GRAMS at most."""
    found = _frequent(scored, "seen", FREQUENT_GRAMS).select("gram", "log10p").toArrow()
    keys, values = (found.column(c).to_numpy() for c in ("gram", "log10p"))
    order = np.argsort(keys)
    return keys[order], values[order]


def _runs(bodies: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams of all bodies and the body of each, about SEGMENT at a time."""
    small, of, size = [], [], 0
    for i, body in enumerate([*bodies, None]):
        if small and (body is None or size > 2 * SEGMENT):
            yield _grams(*_layout(small)), np.repeat(of, [len(b) + 1 for b in small])
            small, of, size = [], [], 0
        if body is not None and len(body) <= SEGMENT:
            small.append(body)
            of.append(i)
            size += len(body)
        elif body is not None:
            whole = END * DEPTH + body + END
            for start in range(DEPTH, len(whole), SEGMENT):
                data = np.frombuffer(whole[start - DEPTH : start + SEGMENT], np.uint8)
                grams = _grams(data, np.arange(DEPTH, len(data)))
                yield grams, np.full(len(grams), i)


class GramTable:
    """Scores by gram, with open addressing, so that all grams of a batch are looked up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, np.nan)
        left, slot = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]  # of several, the last one stays
            held = self.keys[slot] == keys[left]
            self.values[slot[held]] = values[left[held]]
            left, slot = left[~held], (slot[~held] + 1) & (len(self.keys) - 1)

    def _home(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The score of each gram, not a number where the table has none."""
        slot = self._home(grams)
        there = self.keys[slot]
        out = np.where(there == grams, self.values[slot], np.nan)
        left = np.flatnonzero((there != grams) & (there >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            there = self.keys[slot]
            hit = there == grams[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            left, slot = left[on], slot[on]
        return out


def body_scores(bodies: list[bytes], table: GramTable) -> tuple[np.ndarray, pa.ListArray]:
    """log10 probability of each body with its end as far as ``table`` goes, and its grams that are not in it."""
    out, others, whose = np.zeros(len(bodies)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for grams, of in _runs(bodies):
        each = table.find(grams)
        rare = np.isnan(each)
        others.append(grams[rare])
        whose.append(of[rare])
        out += np.bincount(of, np.where(rare, 0.0, each), len(bodies))
    of = np.concatenate(whose)
    order = np.argsort(of, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(bodies)))]).astype(np.int32)
    return out, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(others)[order]))


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document; see the module. ``bits_per_byte`` is the code length by the bytes scored."""
    words, grams, n_docs = corpus_counts(docs)
    summed = words.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    n_train, distinct = (summed.n or 0) + n_docs, summed.v + (n_docs > 0)
    floor = n_train + 0.1 * (distinct + 1)
    value = lambda n: math.log10((n + 0.1) / floor)
    frequent = _frequent(words, "n", FREQUENT).toArrow()
    top = dict(zip(frequent.column("word").to_pylist(), map(value, frequent.column("n").to_pylist())))
    del frequent
    end_value, end_known = value(n_docs), int(n_docs > 0)
    context = docs.sparkSession.sparkContext
    scores = gram_scores(grams)
    model = context.broadcast((*_most_frequent(scores), top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, frequent = model.value
        table = GramTable(keys, values)
        row = TaskContext.get().partitionId() << 33
        rare_kind = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))
        names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "n_bytes", "rare", "rare_grams"]
        for batch in batches:
            for part in slices(batch):
                if not part.num_rows:
                    continue
                tokens = [tokens_of(text) for text in part.column(1).to_pylist()]
                known, base, rare = [], [], []
                for own in tokens:
                    n, s, others = end_known, end_value, []
                    for word, k in Counter(own).items():
                        v = frequent.get(word)
                        if v is None:
                            others.append({"word": word, "k": k})
                        else:
                            n += k
                            s += k * v
                    known.append(n)
                    base.append(s)
                    rare.append(others)
                bodies = [b" ".join(own) for own in tokens]
                score, rare_grams = body_scores(bodies, table)
                ids = part.column(0)
                columns = [
                    pa.array(range(row, row + part.num_rows), pa.int64()), ids, pa.array([is_held_out(i) for i in ids.to_pylist()]),
                    pa.array([len(own) + 1 for own in tokens], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                    pa.array(score), pa.array([len(b) + 1 for b in bodies], pa.int64()), pa.array(rare, rare_kind), rare_grams,
                ]
                row += part.num_rows
                yield pa.record_batch(columns, names)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long, rare array<struct<word:binary,k:long>>, rare_grams array<long>"
    scored = cut(read_texts(docs).mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    found = rare.join(words, "word", "left").select(
        "row", F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0).alias("known"), (F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(floor))).alias("base")
    )
    sums = found.groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"))
    further = scored.select("row", F.explode("rare_grams").alias("gram")).groupBy("row", "gram").agg(F.count("*").alias("k"))
    further = further.join(scores, "gram").groupBy("row").agg(F.sum(F.col("k") * F.col("log10p")).alias("more_score"))
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return scored.drop("rare", "rare_grams").join(sums, "row", "left").join(further, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (-score * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )

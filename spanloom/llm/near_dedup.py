"""Near-duplicate classes by order MinHash.

Shingles are SHINGLE words in lower case; the n-th occurrence of a shingle in a text is labelled n.
For each of HASHES functions the two least labelled shingles are taken in the order of the text:
texts agree in such a sketch as they agree in content and order. Two sketches make a band.

Texts that are equal in their words are one node first, so copies cost nothing later. In each bucket
of a band the member with most company is the centre and every other member is paired with it, which
takes as many pairs as members. Where that leaves several classes in a bucket, the pairs of two classes are
compared too, but for those that provably can't reach LEAST (see ``_candidates``): no pair that shares a
bucket is left out. A pair is a link if at least LEAST of the two texts' distinct shingles are shared
and a banded alignment of the labelled shingles (the longest chain of matches near the diagonal) shows that
at least LEAST_ALIGNED of them follow in the same order. Both are worked out on 32-bit hashes of the words.

Defined cases: null texts are empty; texts without words are equal to each other; texts of fewer
words than a shingle have one shingle; null ids come last when a class takes its least id; of rows
equal in everything one stays; empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bpe import forget_encoders, slices
from .common import KEYS, content_keys, read_texts, with_keys

SHINGLE = 5
LEAST = 0.8
#: Least share of labelled shingles in one chain.
LEAST_ALIGNED = 0.6
HASHES, BAND = 32, 2
_SEEDS = (np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
_ODD = np.uint64(0xD6E8FEB86659FD93)
_WORDS_HELD = 400_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_HELD:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all shingles in the order of the text."""
    n = max(1, len(words) - SHINGLE + 1) if len(words) else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = _mixed(out + words[k : k + n] + np.uint64(k + 1))
    return out


def labelled(found: np.ndarray) -> np.ndarray:
    """Shingle hashes made distinct by the number of their occurrence."""
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    place = np.arange(len(found))
    occurrence = place - np.maximum.accumulate(np.where(new, place, 0))
    out = np.empty_like(found)
    out[order] = ranked + occurrence.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return _mixed(out)


def sketch(found: np.ndarray) -> np.ndarray:
    """One hash for each function: of the two least labelled shingles, in their order."""
    marks = labelled(found)
    out = np.zeros(HASHES, np.uint64)
    step = max(1, (1 << 20) // len(found))
    for at in range(0, HASHES, step):
        values = _mixed(marks[None, :] ^ _SEEDS[at : at + step])
        rows = np.arange(len(values))
        first = values.argmin(axis=1)
        if len(found) > 1:
            values[rows, first] = np.iinfo(np.uint64).max
            second = values.argmin(axis=1)
            first, second = np.minimum(first, second), np.maximum(first, second)
            out[at : at + step] = _mixed(_mixed(found[first]) + found[second])
        else:
            out[at : at + step] = _mixed(found[first])
    return out


def bands(found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(0, np.int64)
    grid = sketch(found).reshape(-1, BAND)
    keys = np.arange(len(grid), dtype=np.uint64)
    for k in range(BAND):
        keys = _mixed(keys + grid[:, k])
    return keys.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Of two word sequences: Jaccard of the distinct shingles, and of the aligned labelled ones.

    The second is worked out only if the first reaches LEAST; it is exact where it reaches
    LEAST_ALIGNED, as a chain that long can't leave the band.
    """
    x, y = shingles(a), shingles(b)
    if not len(x) or not len(y):
        same = float(len(x) == len(y))
        return same, same
    common = len(np.intersect1d(x, y))
    jaccard = common / (len(np.unique(x)) + len(np.unique(y)) - common)
    if jaccard < LEAST:
        return jaccard, 0.0
    _, i, j = np.intersect1d(labelled(x), labelled(y), assume_unique=True, return_indices=True)
    band = max(len(x), len(y)) - int(LEAST_ALIGNED / (1 + LEAST_ALIGNED) * (len(x) + len(y)))
    near = np.abs(i - j) <= band
    order = np.argsort(i[near])
    chain: list[int] = []
    for place in j[near][order].tolist():
        at = bisect_left(chain, place)
        chain[at : at + 1] = [place]
    return jaccard, len(chain) / (len(x) + len(y) - len(chain))


def _scan(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        row, hashes = TaskContext.get().partitionId() << 33, WordHashes()
        for batch in batches:
            for part in slices(batch):
                one, two, found = [], [], []
                for text in part.column(0).to_pylist():
                    words = words_of(text)
                    raw = xxhash.xxh3_128_digest(b" ".join(words))
                    one.append(int.from_bytes(raw[:8], "little", signed=True))
                    two.append(int.from_bytes(raw[8:], "little", signed=True))
                    found.append(bands(shingles(hashes.of(words))))
                rows = pa.array(range(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                yield pa.record_batch([rows, *part.columns[1:], pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["row", "doc_id", *KEYS, "t1", "t2", "bands"])

    schema = f"row long, doc_id long, {KEYS[0]} long, {KEYS[1]} long, t1 long, t2 long, bands array<long>"
    return cut(read_texts(docs).select("text", "doc_id", *content_keys()).mapInArrow(run, schema), "sketches")


def _word_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, words`` (32-bit hashes) of the wanted nodes, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch):
                words = [hashes.of(words_of(t)).astype(np.uint32).tobytes() for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(words, pa.binary())], ["node", "words"])

    texts = with_keys(read_texts(docs)).join(wanted, KEYS).select("node", "text")
    return cut(texts.mapInArrow(run, "node long, words binary").dropDuplicates(["node"]), "words")


def _links(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``a, b, jaccard, aligned`` of the pairs that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                jaccard, aligned = similarity(*(np.frombuffer(w, np.uint32).astype(np.uint64) for w in (x, y)))
                if jaccard >= LEAST and aligned >= LEAST_ALIGNED:
                    out.append((a, b, jaccard, aligned))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 4, kinds)], ["a", "b", "jaccard", "aligned"])

    both = pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
    both = both.join(words.select(F.col("node").alias("b"), F.col("words").alias("y")), "b").select("a", "b", "x", "y")
    return cut(both.mapInArrow(run, "a long, b long, jaccard double, aligned double"), "links")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``a, b``: the least node that it is connected with.

    Each step takes the least label around and then that label's own label, so paths shrink fast.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("around"))
        least = labels.join(around, "node").select("node", F.least("label", "around").alias("label"), F.col("label").alias("before"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(least.join(own, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "before"), "labels")
        if not new.filter("label <> before").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scanned rows with their node, ``node, label`` of linked nodes, and the links found."""
    rows = _scan(docs)
    equal = rows.groupBy("t1", "t2").agg(F.min("row").alias("node"))
    nodes = cut(rows.select("row", "doc_id", *KEYS, "t1", "t2").join(equal, ["t1", "t2"]).drop("t1", "t2"), "nodes")
    keys = rows.join(equal.select(F.col("node").alias("row")), "row", "left_semi")
    members = keys.select(F.col("row").alias("node"), F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = cut(members.join(sizes, "bucket"), "members")
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    members = cut(members.join(company, "node").select("bucket", "node", "company"), "members")
    wanted = nodes.filter("row = node").select(*KEYS, "node").join(members.select("node").distinct(), "node", "left_semi")
    words = _word_rows(docs, wanted)

    # each bucket's member with most company is compared with all others
    centres = members.groupBy("bucket").agg(F.max(F.struct("company", -F.col("node"))).alias("most"))
    centres = cut(centres.select("bucket", (-F.col("most.col2")).alias("centre")), "centres")
    paired = members.join(centres, "bucket").filter("node <> centre")
    links = _links(paired.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), words)
    labels = members.select("node", F.col("node").alias("label")).distinct()
    labels = _merged(labels, links)
    # what is still divided: pairs of two classes that share a bucket and can reach LEAST
    held = members.select("bucket", "node").join(labels, "node")
    several = held.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    divided = cut(held.join(several, "bucket").groupBy("node", "label").agg(F.collect_set("bucket").alias("buckets")), "divided")
    more = _links(_candidates(divided, words), words)
    return nodes, _merged(labels, more), links.unionByName(more)


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label`` after the classes that ``links`` connect became one."""
    named = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    across = links.select("a", "b").join(named, "a").join(named.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b")
    across = cut(across.select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a <> b"), "across")
    if not across.limit(1).count():
        return labels
    joined = components(across).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return cut(labels.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def _candidates(divided: DataFrame, words: DataFrame) -> DataFrame:
    """``a, b``: the pairs of two classes that share a bucket, but for those that can't reach LEAST.

    The distinct shingles of a text are put in one order for all texts, rarest first. Two texts of
    similarity LEAST share one of the first shingles of both: of the shorter text as many as it can
    miss of a text of its own size, of the longer one as many as it can miss of one LEAST its size. What is left
    behind that place bounds the overlap. So a passage that many texts share brings two of them together only
    if little else is in the shorter one; the filter leaves out no pair of LEAST or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [np.unique(shingles(np.frombuffer(w, np.uint32).astype(np.uint64))).view(np.int64) for w in part.column(2).to_pylist()]
                sizes = pa.array([len(x) for x in found], pa.int64())
                yield pa.record_batch([*part.columns[:2], sizes, pa.array(found, pa.list_(pa.int64()))], ["node", "label", "n", "shingles"])

    texts = words.join(divided.select("node", "label"), "node").select("node", "label", "words")
    sets = cut(texts.mapInArrow(run, "node long, label long, n long, shingles array<long>"), "sets")
    held = sets.select("node", F.explode("shingles").alias("shingle"))
    shared = cut(held.groupBy("shingle").agg(F.count("*").alias("texts")).filter("texts > 1"), "shared")
    # shingles of one text only come first in its order; they lead to no other text
    ranked = held.join(shared, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("texts", "shingle"))).alias("known"))
    first = F.floor(F.col("n") * (1 - LEAST) + 1e-9) + 1 - (F.col("n") - F.size("known"))
    placed = ranked.join(sets.select("node", "label", "n"), "node").withColumn("first", first).filter("first > 0")
    entries = placed.select("node", "label", "n", F.posexplode(F.expr("slice(known, 1, cast(first AS int))")).alias("at", "entry"), F.size("known").alias("k"))
    # what is left from this shingle on, itself included
    entries = cut(entries.select("node", "label", "n", F.col("entry.shingle").alias("shingle"), (F.col("k") - F.col("at")).alias("left")), "entries")
    need = lambda size: F.ceil(size * (LEAST / (1 + LEAST)) - 1e-9)
    short = entries.filter(F.col("left") >= need(2 * F.col("n"))).select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("node", "label", "n", "left")])
    larger = (F.col("x_n") < F.col("n")) | ((F.col("x_n") == F.col("n")) & (F.col("x_node") < F.col("node")))
    near = larger & (F.col("x_n") >= LEAST * F.col("n") - 1e-9) & (F.least("x_left", "left") >= need(F.col("x_n") + F.col("n")))
    pairs = cut(entries.join(short, "shingle").filter(near & (F.col("label") != F.col("x_label"))).select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b")).distinct(), "pairs")
    at = divided.select("node", "buckets")
    both = pairs.join(at.toDF("a", "of_a"), "a").join(at.toDF("b", "of_b"), "b")
    return both.filter(F.arrays_overlap("of_a", "of_b")).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, class_id, class_size, n_links, kept``.

    ``class_id`` is the least id of the class; ``n_links`` counts the links that were found between the
    row's text and others on the way to the classes, which need not be all; ``kept`` marks the row that
    stays for its class.
    """
    nodes, labels, links = _classes(docs)
    placed = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    classes = placed.groupBy("label").agg(first, F.count("*").alias("class_size"))
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n"))
    return placed.join(classes, "label").join(degree, "node", "left").select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        (F.col("row") == F.col("first.row")).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: one of each class."""
    nodes, labels, _ = _classes(docs)
    placed = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    stay = placed.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", *KEYS)).alias("first"))
    joined = with_keys(docs).join(stay.select(*[F.col(f"first.{k}").alias(k) for k in KEYS]), KEYS, "left_semi")
    return joined.dropDuplicates(KEYS).drop(*KEYS)

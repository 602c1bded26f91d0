"""Threshold-scaled sketches: of a document's shingle hashes, all below a fixed share of the range.

Which hashes are kept does not depend on the document's length, so sketches of very unequal
documents merge by union, and the share of one sketch in another estimates containment. Shingles
are five words (all words of a shorter text) in lower case. Only built-in functions are used.

Defined cases: a null or empty text has no shingle and an empty sketch; two empty sketches are
alike (1) exactly if the texts are equal in their words; equal texts have equal fingerprints;
the next document is that of the next greater ``(doc_id, text)``, null ids first, and after the
last comes the first; a table of one row is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import SPACE, read_texts

#: Words of a shingle.
SHINGLE = 5
#: One in so many hashes is kept.
SCALE = 4
#: Documents with neighbouring ids that are put in order together.
BLOCK = 512


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, size: int = SHINGLE) -> Column:
    """Hashes of ``size`` words in a row; of all words where there are fewer; none without words."""
    n = F.size(hashes)
    last = F.greatest(n - size, F.lit(0))
    window = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), window)).otherwise(F.array().cast("array<bigint>"))


def scaled(shingles: Column, scale: int = SCALE) -> Column:
    """The sketch: distinct hashes below the threshold, in order."""
    threshold = -(1 << 63) + (1 << 64) // scale
    return F.array_sort(F.array_distinct(F.filter(shingles, lambda h: h < F.lit(threshold))))


def with_sketch(df: DataFrame, text: str, name: str, scale: int = SCALE) -> DataFrame:
    """``df`` with the sketch of a text column; each step is a projection of its own, so none is done twice."""
    step = df.withColumn("sp_hashes", word_hashes(F.col(text)))
    step = step.withColumn("sp_shingles", shingle_hashes(F.col("sp_hashes")))
    return step.withColumn(name, scaled(F.col("sp_shingles"), scale)).drop("sp_hashes", "sp_shingles")


def likeness(a: Column, b: Column, if_empty: Column) -> Column:
    """Shared hashes by all hashes of two sketches."""
    shared = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - shared
    return F.when(both > 0, shared / both).otherwise(if_empty)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null if a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(sketches: DataFrame, by: list[str], sketch: str = "sketch") -> DataFrame:
    """One hash per row of the union of sketches by group: ``by, hash``; distributed, however large."""
    return sketches.select(*by, F.explode(sketch).alias("hash")).distinct()


def written(sketch: Column, text: Column) -> Column:
    """The fingerprint as text: the leading 32 free bits of each kept hash; an empty sketch names its words.

    Kept hashes lie in the lowest quarter of the range, so their two leading bits say nothing.
    """
    words = F.hex(F.xxhash64(F.array_join(F.filter(F.split(F.lower(text), SPACE), lambda w: w != ""), " ")))
    each = F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(F.shiftrightunsigned(h, 30).bitwiseAND(0xFFFFFFFF))), 8, "0"))
    return F.when(F.size(sketch) > 0, F.array_join(each, "")).otherwise(F.concat(F.lit("-"), words))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the carried columns of the next document as ``next_<name>``.

    Ids are put in order by blocks of BLOCK neighbours; a block's last row gets the first row of
    the next block that has rows. The first ids of blocks are a table of 1 in BLOCK of the rows,
    whose size Spark knows when it joins.
    """
    block = F.coalesce(F.floor(F.col("doc_id") / BLOCK), F.lit(-(1 << 62)))
    ids = docs.select("doc_id", block.alias("sp_block"))
    blocks = ids.groupBy("sp_block").agg(F.min("doc_id").alias("sp_head"))
    far = F.floor(F.col("sp_block") / BLOCK).alias("sp_far")
    blocks = blocks.select("*", far)
    fars = blocks.groupBy("sp_far").agg(F.min("sp_block").alias("sp_first_block"))
    fars = fars.select("sp_far", F.lead("sp_first_block").over(Window.orderBy("sp_far")).alias("sp_next_far"), F.min("sp_first_block").over(Window.partitionBy()).alias("sp_very_first"))
    follow = F.lead("sp_block").over(Window.partitionBy("sp_far").orderBy("sp_block"))
    linked = blocks.withColumn("sp_follow", follow).join(fars, "sp_far")
    linked = linked.select("sp_block", F.coalesce("sp_follow", "sp_next_far", "sp_very_first").alias("sp_next_block"))
    heads = blocks.select(F.col("sp_block").alias("sp_next_block"), "sp_head").join(linked, "sp_next_block")
    heads = cut(heads.select("sp_block", "sp_head"), "heads")

    own = F.struct(*[F.col(c).alias(c) for c in ["text", *[c for c in carried if c != "text"]]])
    first = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("sp_head"))).groupBy("sp_block").agg(F.min(own).alias("sp_first"))
    order = Window.partitionBy("sp_block").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    ahead = docs.withColumn("sp_block", block).select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    # texts are never null here, so a null text marks a block's last row
    joined = ahead.join(first.withColumnRenamed("sp_block", "sp_b"), (F.col("sp_block") == F.col("sp_b")) & F.col("next_text").isNull(), "left")
    return joined.select(*docs.columns, *[F.coalesce(F.col(f"next_{c}"), F.col(f"sp_first.{c}")).alias(f"next_{c}") for c in carried])


def fingerprint_edits(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness: see the module's contract."""
    read = with_sketch(read_texts(docs), "text", "sketch", scale)
    both = with_next(read, ["text", "sketch"])
    both = both.withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.expr("left(text, cast(n_chars as int) - cut)"), F.expr("left(next_text, cut)"))
    both = both.withColumn("edited", edited)
    both = with_sketch(both, "edited", "edited_sketch", scale)
    words = lambda c: F.filter(F.split(F.lower(F.col(c)), SPACE), lambda w: w != "")
    same = lambda c: F.when(words("text") == words(c), 1.0).otherwise(0.0)
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("sketch"), F.col("text")).alias("fingerprint"),
        written(F.col("edited_sketch"), F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), same("edited")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), same("next_text")).alias("near_next"),
    )

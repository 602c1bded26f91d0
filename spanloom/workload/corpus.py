"""Corpora derived row by row from the driver tables.

No file text grows with a group: an order file comes from one ``orders`` row, a library file
from at most 64 customer keys, so a hot customer or priority makes a hot *name*, not a hot row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIB_KEYS = 64
ALT_EVERY = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a compact table out when it has fewer splits than there are cores.

    The derived texts are much larger than their source rows; a table of cluster size has
    enough splits already and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def evenly(df: DataFrame) -> DataFrame:
    """``spread`` for slim rows that each give a text: at a size with splits enough they are dealt out too.

    A split of a table may hold several row groups or none, and a text costs a hundred times its row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits < cores:
        return df.repartition(cores)
    # the number of a row spreads repeated rows too, and saves the sort of a dealing out without a key
    return df.withColumn("_n", F.monotonically_increasing_id()).repartition(max(splits, 4 * cores), "_n").drop("_n")


def steps_of(price):
    """Number of methods in an order file, 1..10 at the price range of the tables."""
    return (F.floor(price / 50000) + 1).cast("int")


def name_part(value):
    """A value as part of a name: every other sign becomes ``_``."""
    return F.regexp_replace(value, "[^A-Za-z0-9]", "_")


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python file per order: a class with methods, then a top-level function."""
    key = F.col("o_orderkey").cast("string")
    orders = evenly(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    ).select(
        key.alias("k"),
        F.col("o_custkey").cast("string").alias("c"),
        name_part(F.col("o_orderpriority")).alias("p"),
        steps_of(F.col("o_totalprice")).alias("m"),
    )
    method = lambda j: F.concat(
        F.lit("    def step_"), j.cast("string"), F.lit("(self):\n        cust_"), F.col("c"),
        F.lit("()\n        prio_"), F.col("p"), F.lit("()\n"),
    )
    methods = F.array_join(F.transform(F.sequence(F.lit(1), F.col("m")), method), "\n")
    content = F.concat(
        F.lit("class Order_"), F.col("k"), F.lit(":\n"), methods,
        F.lit("\ndef run_"), F.col("k"), F.lit("():\n    Order_"), F.col("k"),
        F.lit("()\n    step_1()\n"),
    )
    return orders.select(
        F.concat(F.lit("src/orders/o"), F.col("k"), F.lit(".py")).alias("path"),
        content.alias("content"),
    )


def _key_files(keys: DataFrame, width: int, label: str, body) -> DataFrame:
    """Library files of ``width`` consecutive keys; the set per file is bounded by ``width``."""
    texts = F.transform(
        F.array_sort(F.collect_set(F.struct("key", "nation"))),
        lambda x: F.concat(F.lit("def cust_"), x["key"].cast("string"), F.lit("():\n    "), body(x)),
    )
    return (
        keys.groupBy(F.floor(F.col("key") / width).alias("b"))
        .agg(F.array_join(texts, "\n").alias("content"))
        .select(
            F.concat(F.lit(f"src/lib/{label}_"), F.col("b").cast("string"), F.lit(".py")).alias("path"),
            F.concat("content", F.lit("\n")).alias("content"),
        )
    )


def library_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cust_<k>`` per customer, a second definition for every tenth, ``prio_<p>`` per priority."""
    keys = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation")
    )
    main = _key_files(
        keys, LIB_KEYS, "cust", lambda x: F.concat(F.lit("nation_"), x["nation"].cast("string"), F.lit("()"))
    )
    alt = _key_files(
        keys.where(F.col("key") % ALT_EVERY == 0), LIB_KEYS * ALT_EVERY, "alt", lambda x: F.lit("pass")
    )
    prio = (
        table(spark, sf_dir, "orders")
        .select("o_orderpriority")
        .distinct()
        # the explode keeps filters on the path from being pushed down to all orders
        .select(F.explode_outer(F.array(name_part(F.col("o_orderpriority")))).alias("p"))
        .distinct()
        .select(
            F.concat(F.lit("src/lib/prio_"), F.col("p"), F.lit(".py")).alias("path"),
            F.concat(F.lit("def prio_"), F.col("p"), F.lit("():\n    pass\n")).alias("content"),
        )
    )
    return main.unionByName(alt).unionByName(prio)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_files(spark, sf_dir).unionByName(library_files(spark, sf_dir))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain-text corpus: one file per document."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
    )


# One text a language and customer; {k} customer, {n} nation, {s} segment, {steps} one call a line.
BRACE_TEXTS = {
    "c": """#include "shared.h"
static inline __attribute__((always_inline)) int fast_{k}(int a)
{
    return nation_{n}
        (a);
}
int (*pick_{k}(void))(int) {
    return seg_{s}("fake_{k}(1)");   /* not_{k}(2) */
}
#ifdef WIDE
int sum_{k}(int a, int b) {
#else
int sum_{k}(int a) {
#endif
    fast_{k}(a);
{steps}}
int last_{k}(void) { return sum_{k}(1); }
""",
    "cpp": """template <class T>
class Box_{k} final : public Base<T> {
public:
    Box_{k}(int a) : x(a), y{nation_{n}(a)} {}
    [[nodiscard]] int marked_{k}() { return seg_{s}<int>(1); }
    Box_{k} operator+(const Box_{k} &o) const { return merge_{k}(o); }
    int operator()(int a) {
{steps}    }
};
int Box_{k}::total_{k}() const
{
    return x && deep_{k}
        (2);
}
""",
    "go": """package p
type (
    Box_{k} struct {
        x int
    }
    Doer_{k} interface{ Do(n int) }
)
func Map_{k}[K any](k K) (
    out K,
) {
    a := Gen_{n}[int](k)
    b := `fake_{k}(1)`
{steps}    return a
}
func (t *Box_{k}) Get_{k}(m map[string]struct{}) interface{} { return seg_{s}(m) }
""",
    "rs": """#[derive(Debug)]
pub struct Box_{k}<T: Fn(u8) -> u8> { x: T }
impl<T: Fn(u8) -> u8> fmt::Display for Box_{k}<T> {
    fn fmt_{k}<'a>(&'a self) -> [u8; 2]
    where
        T: FnOnce(u8) -> u8,
    {
        nation_{n}
            ::<u8>(1);
{steps}        seg_{s}(r#"fake_{k}(" }"#)
    }
}
pub async fn top_{k}() { /* } */ last_{k}(1) }
""",
}


def brace_files(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    """One file of a brace language per customer, with one to four calls by step."""
    key = F.col("c_custkey").cast("string")
    lines = F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 4 + 1).cast("int")), lambda j: F.concat(F.lit("        step_"), j.cast("string"), F.lit("(a);\n")))
    content = F.lit(BRACE_TEXTS[suffix])
    values = {"k": key, "n": F.col("c_nationkey").cast("string"), "s": name_part(F.col("c_mktsegment")), "steps": F.array_join(lines, "")}
    for name, value in values.items():
        content = F.replace(content, F.lit(f"{{{name}}}"), value)
    customers = evenly(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"))
    return customers.select(F.concat(F.lit(f"src/{suffix}/c"), key, F.lit(f".{suffix}")).alias("path"), content.alias("content"))

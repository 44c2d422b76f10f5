"""Filter interaction audit: every order of a set of filters, run as a trie of permutations.

The trie is walked depth first. A prefix's state is the DataFrame of its survivors, persisted while its branch is walked; orders that begin with the same
filters in another order share it, so five filters have 32 states and 80 edges instead of 325 and 320. At every edge the documents that the next filter
removes from the state are counted where they stand; nothing is derived from a table of patterns.

Scale: one scan of the texts leaves a narrow row for each document (flags, part, labels), written to the shared folder; a lost executor
costs the states in its memory, which come back from that table. Equal texts meet by SHA-256, of which only (digest, smallest id) is
joined back, on both, so no group of copies meets in one task. Each state is counted with partial sums, so a hot part costs one row a
task. The results are parts times 600 rows and are joined with the 600 orders, which are constants.

Nulls: a null text is empty, a null source is the part '', a row without id is no copy of anything and has no labels. Repeated rows with the same id and text are no copies of each other, and count
each. A document with several label rows has what any of them says.
"""

from __future__ import annotations

from collections import Counter
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, table

FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text alone."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (fails that filter), good, toxic of every row of docs (doc_id, text, source); labels: doc_id, quality, toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = cut(docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *[c.alias(k) for k, c in text_conditions(text).items()]))
    first = own.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = own.join(first.hint("merge"), ["digest", "doc_id"], "left").join(known.hint("merge"), "doc_id", "left")
    no = F.lit(False)
    return cut(rows.select("part", "A", "B", "C", "D", (F.col("first").isNull() & F.col("doc_id").isNotNull()).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")))


def edges(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, prefix (bits of the filters applied), filter, kept, removed, good_lost, toxic_lost for every edge of the trie at which a part still has documents.

    rows: part, a boolean of each filter, good, toxic.
    """
    spark = rows.sparkSession
    path = fresh_path(spark, "filter-edges")
    bit = {f: 1 << i for i, f in enumerate(filters)}
    known: set[int] = set()

    def number(c: Column) -> Column:
        return F.sum(c.cast("long"))

    def visit(prefix: str, state: DataFrame) -> None:
        mask = sum(bit[f] for f in prefix)
        known.add(mask)
        rest = [f for f in filters if f not in prefix]
        if not rest:
            return
        found = [F.struct(F.lit(f).alias("filter"), number(~F.col(f)).alias("kept"), number(F.col(f)).alias("removed"), number(F.col(f) & F.col("good")).alias("good_lost"), number(F.col(f) & F.col("toxic")).alias("toxic_lost")) for f in rest]
        counted = state.groupBy("part").agg(F.array(*found).alias("e")).select("part", F.lit(mask).alias("prefix"), F.inline("e"))
        counted.write.mode("append").parquet(path)
        for f in rest:
            if mask | bit[f] not in known and len(rest) > 1:
                after = state.where(~F.col(f)).persist(StorageLevel.MEMORY_AND_DISK)
                visit(prefix + f, after)
                after.unpersist()

    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    visit("", rows)
    rows.unpersist()
    return spark.read.schema("part string, prefix int, filter string, kept long, removed long, good_lost long, toxic_lost long").parquet(path)


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and what the step's filter did there, for every part and order; see the module's contract for the columns."""
    spark, n = rows.sparkSession, len(filters)
    bit = {f: 1 << i for i, f in enumerate(filters)}
    edge = edges(rows, filters)
    weights = Counter((sum(bit[f] for f in order[:i]), f) for order in permutations(filters) for i, f in enumerate(order))
    assert all(v == factorial(bin(m).count("1")) * factorial(n - 1 - bin(m).count("1")) for (m, _), v in weights.items())
    orders = spark.createDataFrame([("".join(o), i + 1, sum(bit[f] for f in o[:i]), f) for o in permutations(filters) for i, f in enumerate(o)], "filter_order string, step int, prefix int, filter string")
    shares = spark.createDataFrame([(m, f, w) for (m, f), w in weights.items()], "prefix int, filter string, weight long")
    only = {f: F.col(f) & ~F.expr(" or ".join(x for x in filters if x != f) or "false") for f in filters}
    sums = [F.struct(F.lit(f).alias("filter"), F.sum(F.col(f).cast("long")).alias("failing"), F.sum(only[f].cast("long")).alias("unique_fails")) for f in filters]
    parts = rows.groupBy("part").agg(F.array(*sums).alias("e")).select("part", F.inline("e"))
    shapley = edge.join(F.broadcast(shares), ["prefix", "filter"]).groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    whole = parts.join(shapley, ["part", "filter"], "left").join(F.broadcast(orders), "filter").join(edge, ["part", "prefix", "filter"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return whole.select("part", "filter_order", "step", zero("kept"), zero("removed"), (F.col("failing") - F.coalesce("removed", F.lit(0))).alias("redundant"), "unique_fails", zero("good_lost"), zero("toxic_lost"), zero("shapley"))


def op13_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))

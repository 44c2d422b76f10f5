"""Connected components, link groups from shared tokens, and bounded recursive traversal."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from millrace.sources.storage import cut

HELD = 1 << 19  # edges that a task holds at once


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the components of the edges: every node but the smallest of its component, and that smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, up := label[label]):
            label = up
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def local_stars(edges: DataFrame) -> DataFrame:
    """edges (a, b) of numbers with each task's own replaced by stars of the same components.

    A task sends at most one edge for each node it meets, however many edges run between them; it holds HELD edges at once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def packed(stars: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in stars], names=["a", "b"])

        def stars() -> tuple[np.ndarray, np.ndarray]:
            return _forest(*(np.concatenate(c) for c in zip(*parts, strict=True)))

        for batch in batches:
            parts.append(tuple(batch.column(i).to_numpy() for i in range(2)))
            held += batch.num_rows
            if held >= HELD:
                parts = [stars()]
                held = len(parts[0][0])
                if held >= HELD // 2:  # few edges between many nodes: they go on as they are
                    yield packed(parts[0])
                    parts, held = [], 0
        if parts:
            yield packed(stars())

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def _raised(edges: DataFrame) -> DataFrame:
    """Large stars of edges (a, b), a > b: every node's larger neighbours go to its smallest one, itself included."""
    sym = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Checkpointed, so the join has a shuffle on both sides and a node with very many neighbours can be split.
    lowest = cut(sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    pairs = edges.select(F.col("b").alias("a"), F.col("a").alias("b")).join(lowest, "a")
    return pairs.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _lowered(edges: DataFrame) -> DataFrame:
    """Small stars of edges (a, b), a > b: a node's smaller neighbours and itself go to its smallest one."""
    lowest = cut(edges.groupBy("a").agg(F.min("b").alias("m")))
    return edges.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(lowest.select("a", F.col("m").alias("b"))).distinct()


def _merged(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b), a > b, of the same components.

    Stars inside of each task leave a node one edge a task at most, so nodes can meet by hash, however many edges they had; there
    the roots that a node has from several tasks are joined, as small stars would. Edges between other things than numbers become small stars.
    """
    if not all(isinstance(f.dataType, IntegralType) for f in edges.schema.fields):
        return _lowered(edges)
    met = local_stars(edges).repartition("a").distinct()  # dealt by a, so this needs no further shuffle
    return local_stars(met).select(*[F.col(f.name).cast(f.dataType) for f in edges.schema.fields])


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one root, which has none itself: then the components are found."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("up")).unionAll(edges.select("b", F.lit(None).cast(edges.schema["b"].dataType)))
    met = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), (F.count("*") > F.count("up")).alias("root"))
    return not met.agg(F.count_if((F.col("low") != F.col("high")) | (F.col("root") & F.col("low").isNotNull()))).first()[0]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, root): root is the smallest node reachable. Loops and repeats are fine.

    Edges between numbers are merged inside of tasks, before and after nodes meet by hash; that alone solves graphs that are not
    long and thin, in one shuffle or two. What is not solved goes on in rounds of large stars, by hash joins and minimum aggregations, and
    such merging: no vertex's neighbours are gathered into one row, each round is checkpointed, and a chain of n edges takes about log n rounds.
    """
    e = cut(_merged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    for _ in range(max_rounds):
        if _is_stars(e):
            break
        e = cut(_merged(_raised(e)))
    else:
        raise RuntimeError("components did not converge")
    return e.distinct().select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))


def link_components(rows: DataFrame, id_col: str, token_cols: list[str], within: str | None = None) -> DataFrame:
    """rows plus `component`: the smallest id linked through equal non-empty values of any token column.

    Each token links its rows to its smallest id (a star), so a token with n rows gives n - 1 edges. With
    `within`, only rows of one value of that column are linked.
    """
    scope = [within] if within else []
    tokens = None
    for i, c in enumerate(token_cols):
        part = rows.where(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").select(F.col(id_col).alias("id"), F.concat_ws("\x1f", F.lit(str(i)), *[F.col(x).cast("string") for x in scope], F.col(c).cast("string")).alias("token"))
        tokens = part if tokens is None else tokens.unionAll(part)
    first = cut(tokens.groupBy("token").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"))
    edges = tokens.join(first, "token").select(F.col("id").alias("a"), "b").where("a <> b")
    found = connected_components(edges)  # a component of one row has no edge
    return rows.join(found.withColumnRenamed("node", id_col), id_col, "left").withColumn("component", F.coalesce("root", id_col)).drop("root")


def mixed_components(rows: DataFrame, label_col: str) -> DataFrame:
    """Components (of link_components) whose rows have several labels: a build refuses while there are any."""
    return rows.groupBy("component").agg(F.sort_array(F.collect_set(label_col)).alias("labels")).where(F.size("labels") > 1)


def reachable(edges: DataFrame, roots: list, max_depth: int) -> DataFrame:
    """(node, depth) reached from roots along (parent, child), each node once at its least depth."""
    spark = edges.sparkSession
    kind = edges.schema["parent"].dataType
    seen = spark.createDataFrame([(r,) for r in roots], "node " + kind.simpleString()).distinct().withColumn("depth", F.lit(0))
    front = seen
    for depth in range(1, max_depth + 1):
        front = front.join(edges, front["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        front = cut(front)
        if not front.limit(1).count():
            break
        seen = seen.unionAll(front)
    return seen


def first_reached(members: DataFrame, root, max_depth: int, limit: int) -> DataFrame:
    """The first `limit` leaves of a walk in the order a queue would find them: node, place (from 1), depth.

    members: parent, at (place in the parent's list), child, leaf (a file, not a category). Categories are visited once each, in the order they were found, down to
    `max_depth`; a leaf counts where it is met first. Each level is a join with the frontier; its finds are numbered by ranges of (place of the parent, at), and the walk
    ends when the quota is full, so later levels are not read.
    """
    spark = members.sparkSession
    kind = members.schema["child"].dataType.simpleString()
    here = spark.createDataFrame([(root, 1)], f"node {kind}, place long")
    visited, found, have = here.select("node"), None, 0
    for depth in range(max_depth + 1):
        met = here.join(members, here["node"] == members["parent"]).select(F.col("child").alias("node"), "leaf", F.struct("place", "at").alias("order"))
        first = cut(met.groupBy("node", "leaf").agg(F.min("order").alias("order")))
        leaves = first.where("leaf").drop("leaf")
        if found is not None:
            leaves = leaves.join(found.select("node"), "node", "left_anti")
        numbered = _numbered(leaves).where(F.col("place") <= limit - have)
        numbered = cut(numbered.select("node", (F.col("place") + have).alias("place"), F.lit(depth).alias("depth")))
        found = numbered if found is None else found.unionAll(numbered)
        have += numbered.count()
        if have >= limit or depth == max_depth:
            break
        here = cut(_numbered(first.where("not leaf").drop("leaf").join(visited, "node", "left_anti")))
        if here.isEmpty():
            break
        visited = visited.unionAll(here.select("node"))
    return found


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (node, order) with place from 1 in the order."""
    from millrace.operators.sampling import group_ordinals

    return group_ordinals(rows.withColumn("all", F.lit(0)), "all", [F.col("order"), F.col("node")], "place").select("node", "place")

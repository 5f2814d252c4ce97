"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine >= t are at most eps = sqrt(2 - 2t) apart.  Vectors are sorted by the cells of a grid of
side eps on the leading principal dimensions; the sequence is cut into blocks with bounding boxes, over which stands a
tree of intervals.  Interval pairs are joined recursively from the root: a pair whose boxes lie more than eps apart is
skipped with all below it, the others are split, and blocks that remain are compared by one matrix product in double
precision.

Scale: equal vectors are one (with their number) before the join; a block pair gives at most one row for each of its
vectors (number of links and the smallest id of its local component), never the pairs; the recursion runs as equi-joins
on the parents of intervals; the driver sees only the d x d matrix of moments.

Defined cases: vectors that are null, of another length than the commonest, zero, or hold nulls or non-finite
numbers, and rows without id, link with nothing; repeated ids are separate vectors with one id; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import batch_rows, components, stage, take_column

LEADING = 6
BOX_DIMS = 16
BLOCK_VECTORS = 2048
FAN_OUT = 16


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _moments(dim: int):
    def run(batches):
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            x = np.c_[_unit(_matrix(take_column(b, "embedding"), dim)), np.ones(b.num_rows)]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["i", "v"])

    return run


def _cells(dim: int, turn: np.ndarray, eps: float):
    lead = min(LEADING, dim)

    def run(batches):
        for b in batches:
            y = _unit(_matrix(take_column(b, "embedding"), dim)) @ turn[:, :lead]
            c = np.floor(y / eps).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, lead, dtype=np.int32)), pa.array(c.ravel()))
            yield pa.RecordBatch.from_arrays([*(take_column(b, k) for k in ("vec", "copies", "embedding")), cells], names=["vec", "copies", "embedding", "cells"])

    return run


#: Blocks on a side of a tile, which one task compares.
TILE = 8


def _blocks(dim: int, turn: np.ndarray):
    """Cuts a sorted partition into blocks of BLOCK_VECTORS vectors."""
    from pyspark import TaskContext

    schema = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())])

    def run(batches):
        part, no, held, size = TaskContext.get().partitionId(), 0, [], 0

        def give(ids, copies, x):
            y = x @ turn[:, : min(BOX_DIMS, dim)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, no, y.min(0).tolist(), y.max(0).tolist(), ids.tobytes(), copies.tobytes(), x.tobytes()), schema.types, strict=True)], schema=schema)

        for b in batches:
            held.append((np.asarray(take_column(b, "vec")), np.asarray(take_column(b, "copies")), _unit(_matrix(take_column(b, "embedding"), dim))))
            size += b.num_rows
            if size >= BLOCK_VECTORS:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                while size >= BLOCK_VECTORS:
                    yield give(*(c[:BLOCK_VECTORS] for c in cols))
                    cols, size, no = [c[BLOCK_VECTORS:] for c in cols], size - BLOCK_VECTORS, no + 1
                held = [tuple(cols)]
        if size:
            yield give(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _compare(dim: int, threshold: float):
    """For each vector with links in a pair of blocks: their number, and the smallest id of its component in the pair."""
    schema = pa.schema([("vec", pa.int64()), ("links", pa.int64()), ("label", pa.int64())])

    def one(r):
        ia, ib = np.frombuffer(r["ia"], np.int64), np.frombuffer(r["ib"], np.int64)
        ca, cb = np.frombuffer(r["ca"], np.int64), np.frombuffer(r["cb"], np.int64)
        link = np.frombuffer(r["va"]).reshape(-1, dim) @ np.frombuffer(r["vb"]).reshape(-1, dim).T >= threshold
        same = r["a"] == r["b"]
        if same:
            np.fill_diagonal(link, False)
        rows, cols = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
        if not len(rows):
            return
        link = link[np.ix_(rows, cols)]
        la, lb, none = ia[rows].copy(), ib[cols].copy(), np.iinfo(np.int64).max
        while True:
            nb = np.minimum(lb, np.where(link, la[:, None], none).min(0))
            na = np.minimum(la, np.where(link, nb[None, :], none).min(1))
            done = (na == la).all() and (nb == lb).all()
            la, lb = na, nb
            if done:
                break
        yield ia[rows], link @ cb[cols], la
        if not same:
            yield ib[cols], ca[rows] @ link, lb

    def run(batches):
        held: dict[int, dict] = {}  # the blocks of one tile: 2 * TILE at most
        now = None

        def close(todo):
            for x, y in todo:
                sides = held[x], held[y]
                r = {"a": x, "b": y} | {k + side: z[k] for z, side in zip(sides, "ab", strict=True) for k in "icv"}
                for ids, links, label in one(r):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(label)], schema=schema)

        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if now is None or now[0] != (row["ta"], row["tb"]):
                    if now is not None:
                        yield from close(now[1])
                    now, held = ((row["ta"], row["tb"]), [(x["a"], x["b"]) for x in row["todo"]]), {}
                held[row["node"]] = {"i": row["ids"], "c": row["copies"], "v": row["vectors"]}
        if now is not None:
            yield from close(now[1])

    return run


def vector_components(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = rows.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0].d if sizes else 0
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") == dim) & (F.lit(dim) > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = stage(rows.select("vec_id", F.when(usable, F.col("embedding")).alias("embedding")), "vectors")
    reps = stage(rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies")).select("vec", "copies", "embedding"), "distinct")
    n = reps.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))

    eps = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    moments = np.zeros((dim + 1) ** 2)
    for r in reps.select("embedding").mapInArrow(_moments(dim), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # (d + 1)^2 rows
        moments[r.i] = r.v
    moments = moments.reshape(dim + 1, dim + 1) / n
    _, turn = np.linalg.eigh(moments[:dim, :dim] - np.outer(moments[dim, :dim], moments[dim, :dim]))
    turn = np.ascontiguousarray(turn[:, ::-1])

    cells = reps.mapInArrow(_cells(dim, turn, eps), "vec long, copies long, embedding array<double>, cells array<int>")
    ordered = cells.repartitionByRange(max(1, n // (8 * BLOCK_VECTORS)), "cells", "vec").sortWithinPartitions("cells", "vec")
    blocks = stage(ordered.mapInArrow(_blocks(dim, turn), "part int, no int, lo array<double>, hi array<double>, ids binary, copies binary, vectors binary"), "blocks")

    # the tree of intervals: one row a block, not a vector
    leaves = blocks.select("part", "no", "lo", "hi").withColumn("node", F.row_number().over(Window.orderBy("part", "no")).cast("long") - 1)
    leaves = stage(leaves, "intervals")
    levels, count = [leaves.select("node", "lo", "hi")], leaves.count()
    while count > 1:
        up = levels[-1].select(F.floor(F.col("node") / FAN_OUT).cast("long").alias("node"), F.posexplode(F.arrays_zip("lo", "hi")).alias("k", "z"))
        up = up.groupBy("node", "k").agg(F.min("z.lo").alias("lo"), F.max("z.hi").alias("hi")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "lo", "hi"))).alias("s"))
        levels.append(stage(up.select("node", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi")), "intervals"))
        count = -(-count // FAN_OUT)
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    apart = F.aggregate(F.zip_with(F.arrays_zip("alo", "ahi"), F.arrays_zip("blo", "bhi"), lambda x, y: F.greatest(x["alo"] - y["bhi"], y["blo"] - x["ahi"], F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
    for level in levels[-2::-1]:
        parent = F.floor(F.col("node") / FAN_OUT).cast("long")
        left = level.select(parent.alias("a"), F.col("node").alias("na"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
        right = level.select(parent.alias("b"), F.col("node").alias("nb"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
        pairs = pairs.join(left, "a").join(right, "b").where((F.col("na") <= F.col("nb")) & (apart <= eps * eps))
        pairs = stage(pairs.select(F.col("na").alias("a"), F.col("nb").alias("b")), "interval-pairs")

    data = blocks.join(leaves.select("part", "no", "node"), ["part", "no"])
    # tiles of TILE by TILE blocks: a block goes once to each tile in which it has a pair, not once to each pair
    tiles = pairs.withColumn("ta", F.floor(F.col("a") / TILE)).withColumn("tb", F.floor(F.col("b") / TILE)).groupBy("ta", "tb").agg(F.collect_list(F.struct("a", "b")).alias("todo"))
    needs = tiles.withColumn("node", F.explode(F.array_distinct(F.concat("todo.a", "todo.b"))))
    dealt = needs.join(data.select("node", "ids", "copies", "vectors"), "node").repartition("ta", "tb").sortWithinPartitions("ta", "tb", "node")
    with batch_rows(vectors.sparkSession, 8):  # a row holds a block
        found = stage(dealt.select("ta", "tb", "todo", "node", "ids", "copies", "vectors").mapInArrow(_compare(dim, threshold), "vec long, links long, label long"), "found")

    whole = components(found.where("vec <> label").select(F.col("vec").alias("a"), F.col("label").alias("b")))
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    table = reps.join(links, "vec", "left").join(whole, F.col("vec") == F.col("id"), "left")
    table = table.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "vec").alias("comp"))
    good = rows.where("embedding is not null").join(table, "embedding").select("vec_id", F.col("links").alias("n_links"), F.col("comp").alias("component_id"))
    rest = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

"""Near-duplicate vectors by a PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import picked, use_worker, written
from tabulith.llm.components import components

#: Rows and bytes of a block (what one task holds twice, in four copies) at most, about, blocks at least, rows of a tile.
BLOCK_ROWS, BLOCK_BYTES, LEAST_BLOCKS, TILE = 32_768, 32 << 20, 8, 1024
#: Where fewer of a tile's pairs are left, they are finished one by one instead of all together.
SPARSE = 0.02


def stars(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links u-v."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, u, least)
        np.minimum.at(after, v, least)
        after = after[after]
        if (after == label).all():
            return label
        # hook the old labels too, so that whole trees move
        np.minimum.at(after, label, after.copy())
        label = after[after]


class Block:
    """Unit vectors in PCA order, sorted by the first coordinate, with their suffix norms."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, basis: np.ndarray, steps: list[int]):
        turned = vectors @ basis
        order = np.argsort(turned[:, 0], kind="stable")
        self.ids, self.copies, self.vectors, self.turned = ids[order], copies[order], vectors[order], turned[order]
        rest = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        # norm of the coordinates from each step on; a little is added for rounding
        self.suffix = {k: np.sqrt(rest[:, k]) + 1e-9 if k < vectors.shape[1] else np.zeros(len(ids)) for k in steps}


def matches(a: Block, rows: slice, b: Block, cols: slice, steps: list[int], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile of a and a tile of b with a cosine of at least `least`.

    The products of the leading coordinates are accumulated step by step; together with
    the product of the suffix norms they bound the cosine, and the tile ends as soon as
    no pair can reach the threshold.
    """
    gap = max(0.0, b.turned[cols][0, 0] - a.turned[rows][-1, 0], a.turned[rows][0, 0] - b.turned[cols][-1, 0])
    nothing = np.empty(0, np.int64)
    if gap * gap > 2 - 2 * least + 1e-9:  # of unit vectors: their squared distance is 2 - 2 cosine
        return nothing, nothing
    x, y, done, sums = a.turned[rows], b.turned[cols], 0, 0.0
    for k in steps:
        sums = sums + x[:, done:k] @ y[:, done:k].T
        done = k
        bound = sums + np.outer(a.suffix[k][rows], b.suffix[k][cols]) if k < x.shape[1] else sums
        hits = np.flatnonzero(bound >= least - 1e-9)
        if not len(hits):
            return nothing, nothing
        if len(hits) < SPARSE * bound.size or k == x.shape[1]:
            break
    i, j = np.divmod(hits, len(y))
    found = [np.empty(0, bool)]
    for at in range(0, len(i), 200_000):
        u, w = i[at : at + 200_000], j[at : at + 200_000]
        found.append(np.einsum("ij,ij->i", a.vectors[rows][u], b.vectors[cols][w]) >= least)
    ok = np.concatenate(found)
    return i[ok], j[ok]


def compare(a: Block, b: Block, least: float, steps: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, linked copies) and the stars (node, root) of all pairs between two blocks, or within one."""
    same = a is b
    n = len(a.ids)
    links_a, links_b = np.zeros(n, np.int64), np.zeros(len(b.ids), np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for r in range(0, n, TILE):
        rows = slice(r, r + TILE)
        for c in range(r if same else 0, len(b.ids), TILE):
            cols = slice(c, c + TILE)
            i, j = matches(a, rows, b, cols, steps, least)
            if same and r == c:
                keep = i < j
                i, j = i[keep], j[keep]
            if not len(i):
                continue
            i, j = i + r, j + c
            links_a += np.bincount(i, weights=b.copies[j], minlength=n).astype(np.int64)
            links_b += np.bincount(j, weights=a.copies[i], minlength=len(b.ids)).astype(np.int64)
            # of a tile's links only a spanning star forest is kept
            nodes, at = np.unique(np.concatenate([i, j + (0 if same else n)]), return_inverse=True)
            root = stars(at[: len(i)], at[len(i) :], len(nodes))
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            ends.append((nodes[moved], nodes[root[moved]]))
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    links = links_a + links_b if same else np.concatenate([links_a, links_b])
    if not ends:
        return ids[:0], links[:0], ids[:0], ids[:0]
    root = stars(np.concatenate([x for x, _ in ends]), np.concatenate([x for _, x in ends]), len(ids))
    moved, linked = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(links)
    return ids[linked], links[linked], ids[moved], ids[root[moved]]


def _unit(column: pa.Array, size: int) -> np.ndarray:
    """Rows of finite, nonzero vectors of one size as unit vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    # the largest component first becomes 1, so that squares neither overflow nor vanish
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _basis(classes: DataFrame, size: int) -> np.ndarray:
    """Principal axes of all unit vectors, the strongest first; size x size numbers reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("embeddings")
        total = np.zeros((size, size))
        for batch in batches:
            x = _unit(batch.column(0), size)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["at", "x"])

    rows = classes.select("vector").mapInArrow(sums, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(size * size)
    for row in rows:
        total[row["at"]] = row["x"]
    return np.ascontiguousarray(np.linalg.eigh(total.reshape(size, size))[1][:, ::-1])


def _linked(classes: DataFrame, size: int, count: int, least: float) -> DataFrame:
    """Rows (kind 0: class, copies linked; kind 1: class, a class of its component) for vectors of one size."""
    basis = _basis(classes, size)
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * size)))
    blocks = max(LEAST_BLOCKS, -(-count // block_rows))
    axis = basis[:, 0]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("embeddings")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(_unit(batch.column(2), size) @ axis)], names=["class_id", "copies", "vector", "lead"])

    placed = written(classes.select("class_id", "copies", "vector").mapInArrow(first, "class_id long, copies long, vector array<double>, lead double"), "placed")
    cuts = np.unique(placed.approxQuantile("lead", [i / blocks for i in range(1, blocks)], 0.1 / blocks))
    # range b lies between cuts b - 1 and b; unit vectors further apart than reach are not linked
    reach = float(np.sqrt(2 - 2 * least)) + 1e-9
    nearest = np.concatenate([[0], np.searchsorted(cuts, cuts - reach, "left")])
    furthest = np.concatenate([np.searchsorted(cuts, cuts + reach, "right"), [len(cuts)]])
    # a range with more rows than a block, as where many vectors have one lead, is several blocks by hash

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("embeddings")
        total = np.zeros(len(cuts) + 1, np.int64)
        for batch in batches:
            total += np.bincount(np.searchsorted(cuts, batch.column(0).to_numpy(), "right"), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["range", "n"])

    held = {r["range"]: r["n"] for r in placed.select("lead").mapInArrow(sizes, "range long, n long").groupBy("range").agg(F.sum("n").alias("n")).collect()}
    parts = np.array([max(1, -(-held.get(b, 0) // block_rows)) for b in range(len(cuts) + 1)])
    first_block = np.cumsum(parts) - parts
    nearest, furthest = first_block[nearest].astype(np.int32), (first_block + parts - 1)[furthest].astype(np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("embeddings")
        for batch in batches:
            of, ids = np.searchsorted(cuts, batch.column(3).to_numpy(), "right"), batch.column(0).to_numpy().astype(np.uint64)
            block = first_block[of] + ((ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % parts[of].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(block.astype(np.int32)), pa.array(nearest[of]), pa.array(furthest[of])], names=["class_id", "copies", "vector", "block", "a", "z"])

    steps = sorted({max(1, size * k // 4) for k in (1, 2, 3)} | {size})

    def cell(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        vectors, block = _unit(table["vector"].combine_chunks(), size), table["block"].to_numpy()
        ids, copies = table["class_id"].to_numpy(), table["copies"].to_numpy()
        made = {b: Block(ids[block == b], copies[block == b], vectors[block == b], basis, steps) for b in {i, j}}
        who, links, nodes, roots = compare(made[i], made[j], least, steps) if i in made and j in made else (ids[:0],) * 4
        return pa.table({"kind": pa.array([0] * len(who) + [1] * len(nodes), pa.int32()), "u": pa.array(np.concatenate([who, nodes]), pa.int64()), "v": pa.array(np.concatenate([links, roots]), pa.int64())})

    # a block goes to the cell of each pair that it is in: as often as there are blocks within reach
    dealt = placed.mapInArrow(deal, "class_id long, copies long, vector array<double>, block int, a int, z int").withColumn("other", F.explode(F.sequence("a", "z")))
    dealt = dealt.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class_id", "copies", "vector")
    return dealt.groupBy("i", "j").applyInArrow(cell, "kind int, u long, v long")


def near_vectors(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of rows(vec_id, embedding).

    Two vectors are linked if their cosine, in double precision, is at least `least`.
    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths with each other. Vectors of one direction
    are one class while they are compared and count one by one in n_links. Repeated vec_ids stay
    as rows of their own; component_id is the smallest vec_id reached, the row's own
    included (null only if all are null). Empty input gives no rows.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = picked(rows, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("vector").isNotNull() & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0)
    # with the largest component 1, so that a vector and its multiples are one class
    most = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    rows = rows.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), F.transform("vector", lambda x: x / most)).alias("vector"))
    grouped = rows.where("vector is not null").groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    classes = written(grouped.withColumn("class_id", F.monotonically_increasing_id()).withColumn("size", F.size("vector")), "classes")
    sizes = classes.groupBy("size").count().collect()  # one row for each length of vectors
    found = [_linked(classes.where(F.col("size") == r["size"]), r["size"], r["count"], least) for r in sizes]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.unionByName(more)
    links = written(all_found, "links")
    roots = components(links.where("kind = 1").select("u", "v"))
    counts = links.where("kind = 0").groupBy("u").agg(F.sum("v").alias("others"))
    of = classes.join(counts, classes["class_id"] == counts["u"], "left").join(roots, classes["class_id"] == roots["node"], "left")
    of = of.select("vector", "least_id", F.coalesce("root", "class_id").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    names = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = of.join(names, "root").select("vector", "n_links", "component_id")
    out = rows.join(named, "vector", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_vectors() of all embeddings, from a cosine of 0.9 on."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

near_duplicates() links fingerprints within a radius, wholly. Texts whose shingle sets have
a similarity (Jaccard) of 0.8 differ in ten of 64 bits and more, and variants within half of
that are beyond number; so similar_documents() takes the fingerprints within the radius as
candidates, and beside them texts that agree in a run of minima of their shingles' hashes,
and links what an exact comparison of the shingle sets confirms.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.llm.common import documents, forget, numbered, picked, text_runs, use_worker, written
from tabulith.llm.components import components

#: Words of a shingle, seed of its hash, bits in which linked fingerprints may differ.
WORDS, SEED, RADIUS = 3, 42, 2
#: For similar documents: words of a shingle, least similarity, runs of minima, minima of a run.
SIMILAR_WORDS, SIMILAR, RUNS, MINIMA = 5, 0.8, 16, 5
#: Candidates (a few longs each) that are broadcast to the texts at most.
BROADCAST_CANDIDATES = 1_000_000
#: Shingles whose bits are counted at once.
AT_ONCE = 400_000


def shingles(text: bytes | None, words: int = WORDS) -> list[bytes]:
    """All runs of so many words, repeats included; fewer words give one run, no word none."""
    found = (text or b"").lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))


def hashes(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The hash of each shingle."""
    runs = shingles(text, words)
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(runs))


def majorities(of: list[np.ndarray]) -> np.ndarray:
    """The 64-bit fingerprint of each list of hashes: a bit is 1 if over half of them have it; 0 of none."""
    sizes = np.array([len(h) for h in of], np.int64)
    sums, flat = np.zeros((len(of), 64), np.int64), np.concatenate([np.empty(0, np.uint64), *of])
    ends = np.cumsum(sizes)
    for at in range(0, len(flat), AT_ONCE):
        bits = np.unpackbits(flat[at : at + AT_ONCE].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = np.flatnonzero((ends > at) & (ends - sizes < at + len(bits)) & (sizes > 0))
        sums[inside] += np.add.reduceat(bits, np.maximum(ends - sizes - at, 0)[inside], axis=0, dtype=np.int64)
    return np.packbits(2 * sums > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(texts: list[bytes | None], words: int = WORDS) -> np.ndarray:
    """The fingerprint of each text; of no word 0."""
    out, held, size = [], [], 0
    for text in texts:
        held.append(hashes(text, words))
        size += len(held[-1])
        if size > AT_ONCE:
            out.append(majorities(held))
            held, size = [], 0
    return np.concatenate([np.empty(0, np.uint64), *out, majorities(held)])


def fingerprinted(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("simhash")
        for batch in batches:
            for a, b in text_runs(batch.column(1)):
                found = fingerprints(batch.column(1).slice(a, b - a).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges u, v that connect all fingerprints within an even number of bits, radius, of each other.

    distinct(fp): every fingerprint once. Each emits itself and all variants within half
    the radius; two fingerprints within the radius meet in a variant. A variant has few
    fingerprints around it (65 for a radius of 2), however many documents there are, so the
    groups are small; in each, neighbours in order are linked, after their distance is verified.
    """
    if radius % 2:
        raise ValueError("variants within half the radius need an even one")
    masks = [sum(1 << i for i in x) for k in range(radius // 2 + 1) for x in combinations(range(64), k)]
    masks = F.array(*[F.lit(m - (m >> 63 << 64)).cast("long") for m in masks])
    variants = distinct.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = variants.select("fp", before.alias("u")).where(F.col("u").isNotNull()).select("u", F.col("fp").alias("v"))
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row of docs(doc_id, text).

    Documents whose fingerprints differ in at most radius bits are linked; component_id is
    the smallest doc_id that links reach. Null and wordless texts have fingerprint zero
    and are linked like others. Rows with a null doc_id take part; theirs is never the
    smallest. Copies share a fingerprint and are brought together before anything is
    compared. Empty input gives no rows; other columns are left out.
    """
    rows = written(fingerprinted(docs, words), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    linked = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    names = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = linked.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def sketch(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the fingerprint, a hash of its shingle set, and keys of RUNS runs of minima (texts x RUNS; 0 without words)."""
    of = [hashes(t, words) for t in texts]
    sets = [np.unique(h) for h in of]
    sizes = np.array([len(x) for x in sets], np.int64)
    full, starts = np.flatnonzero(sizes), (np.cumsum(sizes) - sizes)[sizes > 0]
    flat = np.concatenate([np.empty(0, np.uint64), *sets])
    shape, keys = np.zeros(len(of), np.uint64), np.zeros((len(of), RUNS), np.uint64)
    if len(full):
        stir = lambda x: (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        shape[full] = stir(np.add.reduceat(stir(flat), starts) + sizes[full].astype(np.uint64))
        odd = np.random.default_rng(SEED).integers(0, 2**63, RUNS * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
        for k, factor in enumerate(odd):
            least = np.minimum.reduceat((flat ^ flat >> np.uint64(31)) * factor, starts)
            keys[full, k // MINIMA] = stir(keys[full, k // MINIMA] * np.uint64(31) + least + np.uint64(k // MINIMA))
    return majorities(of), shape, keys


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """id, version, fp, shape, keys of each row of docs(id, version, text)."""
    out = "id long, version long, fp long, shape long, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("simhash")
        for batch in batches:
            for a, b in text_runs(batch.column(2), 2 << 20):
                fp, shape, keys = sketch(batch.column(2).slice(a, b - a).to_pylist(), words)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), RUNS).cast(pa.list_(pa.int64()))
                columns = [*(batch.column(k).slice(a, b - a) for k in (0, 1)), pa.array(fp.view(np.int64)), pa.array(shape.view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in out.split(", ")])

    return docs.select("id", "version", F.col("text").cast("binary").alias("text")).mapInArrow(run, out)


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """shape and shingles, the set of hashes, of texts(shape, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("simhash")
        for batch in batches:
            for a, b in text_runs(batch.column(1), 2 << 20):
                sets = [np.unique(hashes(t, words)) for t in batch.column(1).slice(a, b - a).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["shape", "shingles"])

    return texts.select("shape", F.col("text").cast("binary").alias("text")).mapInArrow(run, "shape long, shingles array<long>")


def _candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs u < v of shapes of classes(shape, fp, keys) that are compared first, and key, shape of groups whose other pairs are open.

    Fingerprints within RADIUS bits, and equal ones; and of the shapes that agree in a run
    of minima each with two of them, the one that shares most runs with most others, as the
    source of copies does, and the smallest. So a run that very many share gives no more
    pairs than it has shapes, twice. Most of a group is linked by these; what they leave
    open between shapes that are not is for _open_pairs().
    """
    of_fp = classes.groupBy("fp").agg(F.min("shape").alias("first"))
    equal = classes.join(of_fp, "fp").select(F.col("first").alias("u"), F.col("shape").alias("v"))
    ends = of_fp.select("fp", "first")
    close = written(links(of_fp.select("fp")), "close-fingerprints")
    near = close.join(ends.withColumnsRenamed({"fp": "u", "first": "a"}), "u").join(ends.withColumnsRenamed({"fp": "v", "first": "b"}), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    entries = classes.where("shape <> 0").select("shape", F.explode("keys").alias("key"))
    shared = written(entries.join(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "shared-runs")
    ranked = shared.join(shared.groupBy("shape").agg(F.sum("n").alias("weight")), "shape")
    firsts = written(ranked.groupBy("key").agg(F.max(F.struct("weight", "shape"))["shape"].alias("most"), F.min("shape").alias("least")), "firsts")
    met = shared.join(firsts, "key").select("shape", F.explode(F.array("most", "least")).alias("other")).select(F.col("other").alias("u"), F.col("shape").alias("v"))
    found = equal.unionByName(near).unionByName(met).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
    found = written(found, "candidates")
    others = shared.where("n > 3").join(firsts, "key").where("shape <> most and shape <> least").select("key", "shape")
    others = others.unionByName(shared.where("n = 3").join(firsts.where("most = least"), "key").where("shape <> most").select("key", "shape"))
    balls = classes.where("shape <> 0").join(components(close).withColumnsRenamed({"node": "fp", "root": "key"}), "fp", "left").select(F.coalesce("key", "fp").alias("key"), "shape")
    balls = balls.join(balls.groupBy("key").agg(F.count("*").alias("n")).where("n > 2").select("key"), "key")
    left = written(others.unionByName(balls), "open-groups")
    forget(classes.sparkSession, shared, firsts, close)
    return found, left


def _open_pairs(left: DataFrame, roots: DataFrame, sets: DataFrame, least: float) -> DataFrame | None:
    """Pairs u < v that may be similar, of all shapes in those groups of left(key, shape) that links have not brought together yet.

    Exact: sets whose similarity is `least` or more share a shingle among the first
    size - ceil(least * size) + 1 of each, in any one order; here rare shingles come first.
    A pair goes too where the places of the shared shingle leave too few behind it, or where
    both have one root (node, root of roots). So what is compared goes by rare shingles, not by
    the sizes of the groups.
    """
    of = left.join(roots.withColumnsRenamed({"node": "shape"}), "shape", "left").select("key", "shape", F.coalesce("root", "shape").alias("root"))
    mixed = of.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z").select("key")
    shapes = written(of.join(mixed, "key").select("shape", "root").distinct(), "open-shapes")
    if shapes.isEmpty():
        return None
    terms = sets.join(shapes, "shape").select("shape", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    common = terms.join(terms.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"), "s")  # the others come first, and join nothing
    own = Window.partitionBy("shape")
    place = F.row_number().over(own.orderBy("n", "s")) + F.col("size") - F.count("*").over(own)
    first = common.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(least * F.col("size") - 1e-6) + 1)
    first = written(first.select("s", "shape", "root", "size", "place"), "first-shingles")
    a, b = (first.select("s", *[F.col(c).alias(f"{c}_{x}") for c in ("shape", "root", "size", "place")]) for x in "ab")
    needed = least / (1 + least) * (F.col("size_a") + F.col("size_b")) - 1e-6
    behind = 1 + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    pairs = a.join(b, "s").where("shape_a < shape_b and root_a <> root_b").where((behind >= needed) & (F.least("size_a", "size_b") >= needed))
    return written(pairs.select(F.col("shape_a").alias("u"), F.col("shape_b").alias("v")).distinct(), "open-pairs")


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of pairs(u, v) whose sets have a similarity of at least `least`."""
    both = pairs.join(sets.withColumnsRenamed({"shape": "v", "shingles": "b"}), "v").join(sets.withColumnsRenamed({"shape": "u", "shingles": "a"}), "u")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common >= least * (F.size("a") + F.size("b") - common)).select("u", "v")


def similar_documents(docs: DataFrame, words: int = SIMILAR_WORDS, least: float = SIMILAR) -> DataFrame:
    """id, version, root of every row of docs(id, version, text): rows with one root are near-duplicates of each other.

    Two texts are linked if their sets of shingles have a Jaccard similarity of at least
    `least`, which is computed in full for every candidate: first for those of
    _candidates(), then for all pairs of what shares a run of minima, or fingerprints within
    the radius, and is not linked yet. Texts with equal sets, null and wordless ones among
    them, are one class.
    """
    rows = written(_sketched(docs, words), "sketches")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "version")
    classes = written(rows.groupBy("shape").agg(F.min(F.struct("fp", "keys")).alias("k"), F.min(place).alias("p")).select("shape", "k.*", "p.id", "p.version"), "classes")
    pairs, left = _candidates(classes)
    wanted = pairs.select(F.col("u").alias("shape")).unionByName(pairs.select(F.col("v").alias("shape"))).distinct()
    wanted = written(classes.select("shape", *_key("id", "version")).join(wanted, "shape"), "wanted")
    few = wanted.count() <= BROADCAST_CANDIDATES  # then the texts stay where they are; beyond, both sides are shuffled
    texts = docs.select(*_key("id", "version"), "text").join(F.broadcast(wanted) if few else wanted, ["none", "at", "version"])
    sets = written(_sets(texts.select("shape", "text"), words).groupBy("shape").agg(F.first("shingles").alias("shingles")), "sets")
    roots = components(_linked(pairs, sets, least))
    more = _open_pairs(left, roots, sets, least)
    if more is not None:
        stars = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = components(stars.unionByName(_linked(more, sets, least)))
    roots = roots.withColumnsRenamed({"node": "shape"})
    forget(docs.sparkSession, pairs, left, wanted, sets)
    return rows.select("id", "version", "shape").join(roots, "shape", "left").select("id", "version", F.coalesce("root", "shape").alias("root"))


def _key(number: str, version: str) -> list[Column]:
    """A row's doc_id, also where it is null, and its text's hash, as columns that can be joined."""
    return [F.col(number).isNull().alias("none"), F.coalesce(number, F.lit(0)).cast("long").alias("at"), F.col(version).alias("version")]


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents: shingles of 3 words, links within 2 bits."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar documents stays, with its columns as they are.

    It is the first by doc_id (null last), then by the hash of its text, then by that of all
    its columns, so the choice is the same whatever the order of the rows; rows with one
    doc_id and different texts are different documents. Null and wordless texts are alike
    and one of them stays. Empty input gives no rows. The texts are shuffled once, by doc_id.
    """
    text = F.col("text").cast("string")
    keyed = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    found = similar_documents(keyed).select("root", *_key("id", "version"))
    kept = found.groupBy("root").agg(F.min(F.struct("none", "at", "version")).alias("k")).select("k.*").distinct()
    flat, at = numbered(docs), docs.columns.index
    row = F.struct(*flat.columns)
    rows = flat.select(F.col(f"_{at('doc_id')}").cast("long").alias("id"), F.xxhash64(F.col(f"_{at('text')}").cast("string")).alias("version"), row.alias("row"), F.xxhash64(F.to_json(row)).alias("order"))
    rows = rows.select(*_key("id", "version"), "row", "order").groupBy("none", "at", "version").agg(F.min_by("row", "order").alias("row"))
    ones = rows.join(written(kept, "kept"), ["none", "at", "version"], "left_semi")
    return ones.select("row.*").toDF(*docs.columns)

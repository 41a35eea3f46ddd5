"""Quality rules: fixed limits on document statistics, then boosted trees over them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm import boosting
from tabulith.llm.common import documents, numbered, picked, text_runs, use_worker

#: Labelled documents that the trees are fitted on at most, chosen by a hash of doc_id.
FIT_ROWS = 20_000
#: Fixed limits: fewest words; most words, per cent, in repeated windows of five.
FEWEST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: Documents with at least this probability of quality 1 are kept.
KEEP_FROM = 0.5
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
#: The statistics of a document, in order; the first five are exact counts.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks", "bars", "lines", "wide"]
#: The odds of quality never rise with these.
MONOTONE = [-1 if x in ("symbols", "dup_lines", "repeats") else 0 for x in FEATURES]


def repeated_words(hashes: np.ndarray, sizes: np.ndarray, words: list[list[bytes]]) -> np.ndarray:
    """For each text, its words in windows of five that the text has twice or more.

    hashes: 64-bit hashes of the words of all texts, one after another; sizes: words a text.
    Windows with equal hashes are candidates, and their words are compared.
    """
    text = np.repeat(np.arange(len(sizes)), sizes)
    total = len(hashes)
    if total < WINDOW:
        return np.zeros(len(sizes), np.int64)
    mixed = np.zeros(total - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        mixed = (mixed ^ hashes[k : total - WINDOW + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    inside = np.flatnonzero(text[: total - WINDOW + 1] == text[WINDOW - 1 :])
    key = (mixed[inside] ^ text[inside].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xFF51AFD7ED558CCD)
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    covered = np.zeros(total, bool)
    if len(twice):
        near = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        starts = inside[twice[near] == key]
        begin = (np.cumsum(sizes) - sizes)[text[starts]]
        windows = [(t, *words[t][i : i + WINDOW]) for t, i in zip(text[starts].tolist(), (starts - begin).tolist(), strict=True)]
        seen = Counter(windows)
        starts = starts[np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))]
        for k in range(WINDOW):
            covered[starts + k] = True
    return np.bincount(text[covered], minlength=len(sizes))


def statistics(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (integers) and FEATURES (doubles) of each text; a null text counts as empty."""
    counts, features = np.zeros((len(texts), len(COUNTS)), np.int64), np.zeros((len(texts), len(FEATURES)))
    hashes: list[np.ndarray] = []
    held: list[list[bytes]] = []
    upper, digits = bytes(range(65, 91)), bytes(range(48, 58))
    for i, text in enumerate(texts):
        text = text or b""
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        size = sum(map(len, words))
        narrow = len(text) - len(text.translate(None, bytes(range(128, 192))))  # continuation bytes
        n, chars = len(words), size - narrow
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        dup = len(lines) - len(set(lines))
        counts[i] = n, chars, symbols, dup, 0
        hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n))
        held.append(words)
        m, c = max(n, 1), max(chars, 1)
        features[i] = (
            np.log1p(n), chars / m, symbols / m, dup / max(len(lines), 1), 0, len(set(words)) / m,
            (len(text) - len(text.translate(None, upper))) / c, (len(text) - len(text.translate(None, digits))) / c,
            text.count(b"!") / m, text.count(b"|") / m, len(lines) / m, narrow / c,
        )
    if len(texts):
        counts[:, 4] = repeated_words(np.concatenate(hashes), counts[:, 0], held)
        features[:, 4] = counts[:, 4] / np.maximum(counts[:, 0], 1)
    return counts, features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < FEWEST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


def column_statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = [statistics([x.as_py() for x in column.slice(a, b - a).cast(pa.large_binary())]) for a, b in text_runs(column, 4 << 20)] or [statistics([])]
    return np.concatenate([c for c, _ in found]), np.concatenate([f for _, f in found])


def fit_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> boosting.Forest:
    """Boosted trees for quality, from at most fit_rows labelled documents of docs.

    A label that is null is left out; of several for one doc_id the smallest counts. Of
    several documents with one doc_id one is taken. Only the statistics of the chosen
    documents reach the driver.
    """
    chosen = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("quality")
        for batch in batches:
            _, features = column_statistics(batch.column(1))
            x = pa.FixedSizeListArray.from_arrays(pa.array(features.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), x], names=["doc_id", "quality", "x"])

    rows = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # fit_rows bounds what is broadcast
    found = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, x array<double>")
    found = found.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("s")).orderBy("doc_id").select("s.quality", "s.x").toPandas()
    x = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))
    return boosting.fit(x, (found["quality"].to_numpy() > 0).astype(float), MONOTONE)


def verdicts(column: pa.Array, model: boosting.Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed, score and kept of a column of texts."""
    counts, features = column_statistics(column)
    failed, score = base_failed(counts), model.probability(features)
    return counts, failed, score, ~failed & (score >= KEEP_FROM)


def scored(docs: DataFrame, model: boosting.Forest) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, score of every row of docs(doc_id, text).

    Null and empty texts have no words and fail. Rows with repeated or null doc_ids are
    judged one by one. Empty input gives no rows; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("quality")
        for batch in batches:
            counts, failed, score, kept = verdicts(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(failed), pa.array(kept), pa.array(score)], names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    rows = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + "".join(f"{x} long, " for x in COUNTS) + "base_failed boolean, kept boolean, score double")


def filtered(docs: DataFrame, model: boosting.Forest) -> DataFrame:
    """The rows of docs that are kept, with all their columns as they are.

    Null, empty and wordless texts go; rows with repeated or null doc_ids are judged one by
    one. Empty input gives no rows.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("quality")
        for batch in batches:
            yield batch.filter(pa.array(verdicts(batch.column(at), model)[3]))

    rows = numbered(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored() of all documents by trees fitted on the labels of quality."""
    docs = documents(spark, sf_dir)
    return scored(docs, fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """filtered() by trees fitted on those labelled documents that docs has."""
    return filtered(docs, fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

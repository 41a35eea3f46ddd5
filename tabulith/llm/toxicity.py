"""Toxicity by class-conditional Kneser-Ney models of words after words.

Each class, toxic and ordinary, has an interpolated Kneser-Ney model: a word after the word
before it, backed off to the word alone, backed off to counts that both classes share,
after how many different words a word stands, and those to all words evenly. Counts are
numbers of different labelled texts, so that one text that repeats itself counts once. At
every level each count is discounted, and what this frees is dealt out by the level below:

    base(w)     = (max(before(w) - D, 0) + D * K / (K + 1)) / sum of before
    one_c(w)    = (max(n_c(w) - D, 0) + D * kinds_c * base(w)) / n_c
    two_c(v, w) = (max(n_c(vw) - D, 0) + D * kinds_c(v) * word_c(w)) / n_c(v)

with before(w) the different words before w, K the different words, n and kinds the sum and
number of counts. The same with both classes' counts together is what they share. A class
goes its own way in an expression as far as the counts speak for two rates instead of one:

    word_c(w)      = q * one_c(w) + (1 - q) * one(w)
    after_c(v, w)  = q * two_c(v, w) + (1 - q) * two(v, w) * word_c(w) / one(w)
    q              = 1 / (1 + exp(DOUBT - gain))

where gain is the log-likelihood that two rates of the expression have more than one. So
rare expressions are smoothed through shared counts and weigh little, in proportion to
what is known of them. A pair that fewer than two texts have, or whose first word one of
the classes has never seen, is as its second word alone; an unknown word is alike in both.
A text's score goes by the difference of its two log-likelihoods, of every word in it,
divided by the number of words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import FORGET, documents, file_system, forget, fresh_path, numbered, picked, text_runs, use_worker, written

#: What is taken off every count, and the nats by which two rates must do better than one to weigh half.
DISCOUNT, DOUBT = 0.75, 10.0
#: Labelled documents that are set aside for the score's scale: this share, about SCALE_ROWS at most, chosen by a hash of doc_id; all others are counted.
SCALE_SHARE, SCALE_ROWS = 0.25, 20_000
#: The share of labels that the scale takes as given at random, to either side.
WRONG = 0.02
#: Labels (a long and an int each) that are broadcast at most.
BROADCAST_LABELS = 1_000_000
#: Rows of the table of evidence that each worker holds at most, for words and for pairs (16 bytes a row), and the nats from which a row
#: is stored. Rows beyond, the light ones, are joined to the words that may have them.
MOST_ROWS, LEAST_CHANGE = 2_000_000, 0.001
#: Bits of the table by which a worker knows words, or pairs, that no light row is for.
MARKS = 1 << 27
#: Expressions that a task holds before it hands on what they add up to.
HELD = 1_000_000
#: Words whose hash a worker remembers; at the bound half of them go.
MEMO_ENTRIES = 150_000
#: A score from which a document is predicted, and dealt with, as toxic.
TOXIC_FROM = 0.7
#: What stands before a text's first word.
START = b"\x02"
#: Marks that stand between words; others, which may stand for letters, only count as no part of a word at its ends.
BETWEEN = bytes.maketrans(b'"&()+,-./:;<=>?[\\]_{|}~', b" " * 23)
#: Every byte as it stands in words: small letters, and a space for blanks and marks between words.
FORM = np.frombuffer(bytes(range(256)).lower().translate(BETWEEN).translate(bytes.maketrans(b"\t\n\r\x0b\x0c", b" " * 5)), np.uint8)


def word(token: bytes) -> bytes:
    return token.strip(b"!#$%'*@^`")


def words(text: bytes | None) -> list[bytes]:
    """Words in lower-case ASCII: what blanks and marks between words separate, without other ASCII marks at their ends."""
    return [w for w in map(word, (text or b"").lower().translate(BETWEEN).split()) if w]


def word_id(word: bytes) -> int:
    """32 bits that stand for a word; words that share them count as one."""
    return xxhash.xxh32_intdigest(word)


def fold(doc_id: int | None) -> int:
    """crc32 of doc_id as text, modulo 3; 1 is held out. A null doc_id is held out too."""
    return 1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 3


_ids: dict[bytes, int] = {}


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words of all texts (large_binary), one after another, and how many each text has.

    The same words as those of words(), cut from the column's buffer at once; only distinct
    tokens become Python objects.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = FORM[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    solid = raw != 32
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = ends[:-1][ends[:-1] < len(raw)]
    first[edges] = solid[edges]  # a text's first character may follow another text's last
    starts = np.flatnonzero(first)
    until = np.concatenate([[0], np.cumsum(solid)])  # characters of tokens up to each place
    offsets = np.append(until[starts], until[-1]).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[solid])]).dictionary_encode()
    if len(_ids) > MEMO_ENTRIES:
        kept = dict(islice(_ids.items(), MEMO_ENTRIES // 2))  # the oldest half stays: frequent words come early
        _ids.clear()
        _ids.update(kept)
    kinds = tokens.dictionary.to_pylist()
    of = list(map(_ids.get, kinds))
    for i, x in enumerate(of):
        if x is None:
            of[i] = _ids[kinds[i]] = word_id(w) if (w := word(kinds[i])) else -1
    ids = np.array(of, np.int64)[tokens.indices.to_numpy()]
    kept = np.concatenate([[0], np.cumsum(ids >= 0)])  # tokens of marks alone are no words
    return ids[ids >= 0].astype(np.uint64), np.diff(kept[np.searchsorted(starts, ends)])


def _pairs(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word the id of the word before it, or of START, in the upper half, and its own in the lower."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = word_id(START)
    return before << np.uint64(32) | ids


class Model:
    """Evidence of words and texts from the stored rows (pair, key, evidence), two arrays each in the order of the keys."""

    def __init__(self, pair: np.ndarray, key: np.ndarray, evidence: np.ndarray):
        self.tables = []
        for which in (False, True):
            at = np.flatnonzero(pair == which)
            keys = key[at].astype(np.int64).view(np.uint64)
            order = np.argsort(keys)
            self.tables.append((keys[order], evidence[at][order]))

    def _look_up(self, which: int, wanted: np.ndarray) -> np.ndarray:
        keys, evidence = self.tables[which]
        if not len(keys):
            return np.full(len(wanted), np.nan)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, evidence[at], np.nan)

    def evidence(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each word, after the one before it, the log-likelihood if toxic less that if ordinary."""
        kinds, at = np.unique(ids, return_inverse=True)
        alone = np.nan_to_num(self._look_up(0, kinds))[at]
        after = self._look_up(1, _pairs(ids, sizes))
        return np.where(np.isnan(after), alone, after)

    def open_texts(self, column: pa.Array, marks: list[np.ndarray | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array]]]:
        """Of runs of texts what the rows held here give, numbers of words, and for each text the words, and the pairs, that light rows may be for.

        A pair that is held here has its evidence whole; any other has its word's, and what a
        light row of the pair adds to it.
        """
        column = column.cast(pa.large_binary())
        for a, b in text_runs(column, 2 << 20):
            ids, sizes = _coded(column.slice(a, b - a))
            pairs = _pairs(ids, sizes)
            after, alone = self._look_up(1, pairs), self._look_up(0, ids)
            total = np.concatenate([[0.0], np.cumsum(np.where(np.isnan(after), np.nan_to_num(alone), after))])
            ends, of = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
            lists = []
            for which, keys, free in ((0, ids, np.isnan(alone)), (1, pairs, True)):
                at = np.flatnonzero(np.isnan(after) & free & _marked(marks[which], keys))
                until = np.concatenate([[0], np.cumsum(np.bincount(of[at], minlength=len(sizes)))]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(until), pa.array(keys[at].view(np.int64))))
            yield total[ends] - total[ends - sizes], sizes, lists

    def texts(self, column: pa.Array) -> np.ndarray:
        """For each text the difference of its two log-likelihoods, divided by its words; 0 without words."""
        out, column = np.zeros(len(column)), column.cast(pa.large_binary())
        for a, b in text_runs(column, 2 << 20):
            ids, sizes = _coded(column.slice(a, b - a))
            total = np.concatenate([[0.0], np.cumsum(self.evidence(ids, sizes))])
            ends = np.cumsum(sizes)
            out[a:b] = (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)
        return out


def _marked(marks: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """Whether a light row may be for each key."""
    if marks is None:
        return np.zeros(len(keys), bool)
    slots = (keys >> np.uint64(37) ^ keys) & np.uint64(MARKS - 1)
    return marks[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & 1 > 0


def marks_of(light: DataFrame) -> DataFrame:
    """pair, part, bits: the slots of all keys, which are made of hashes, as a table of bits in parts of 4 KB."""
    slot = F.shiftrightunsigned("key", 37).bitwiseXOR(F.col("key")).bitwiseAND(F.lit(MARKS - 1)) + 1
    return light.groupBy("pair", F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))


_models: dict[str, Model] = {}
_marks: dict[str, list[np.ndarray | None]] = {}
FORGET.extend([_models.clear, _marks.clear, _ids.clear])


def marks_at(path: str) -> list[np.ndarray | None]:
    """The bits of words and of pairs in the files at path, from marks_of(); none where no key is marked."""
    if path not in _marks:
        files, folder = file_system(path)
        table, found = pq.read_table(folder, filesystem=files), [None, None]
        for pair, part, bits in zip(*(table[c].to_pylist() for c in ("pair", "part", "bits")), strict=True):
            if found[pair] is None:
                found[pair] = np.zeros(MARKS // 8, np.uint8)
            found[pair][(part - 1) * len(bits) : part * len(bits)] = np.frombuffer(bits, np.uint8)
        _marks.clear()
        _marks[path] = found
    return _marks[path]


def model_at(path: str) -> Model:
    """The model in the files at path, which all machines can read; each worker loads it once."""
    if path not in _models:
        files, folder = file_system(path)
        table = pq.read_table(folder, filesystem=files)
        _models.clear()
        _models[path] = Model(*(table[c].to_numpy() for c in ("pair", "key", "evidence")))
    return _models[path]


@dataclass
class Fitted:
    """Where the table of evidence is, the score's scale, and where the light rows and their marks are, if there are any."""

    path: str
    scale: tuple[float, float, float]
    light: str | None = None
    marks: str | None = None

    def scores(self, column: pa.Array) -> np.ndarray:
        return score(model_at(self.path).texts(column), *self.scale)


def count_expressions(docs: DataFrame) -> DataFrame:
    """pair, key, toxic, ordinary: in how many rows of docs(text, toxic) of each class a word, or a word after another, stands."""

    def table(held: list[tuple[bool, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for pair in (False, True):
            keys = np.concatenate([np.empty(0, np.uint64), *(k for p, _, k in held if p == pair)])
            ones = np.concatenate([np.empty(0, np.int64), *(np.full(len(k), 1 << 32 * toxic) for p, toxic, k in held if p == pair)])
            found, at = np.unique(keys, return_inverse=True)
            order = np.argsort(at, kind="stable")
            n = np.add.reduceat(ones[order], np.flatnonzero(np.diff(at[order], prepend=-1))) if len(found) else ones
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), pair)), pa.array(found.view(np.int64)), pa.array(n)], names=["pair", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("toxicity")
        held, size = [], 0
        for batch in batches:
            texts, toxic = batch.column(0).cast(pa.large_binary()), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in text_runs(texts, 2 << 20):
                ids, sizes = _coded(texts.slice(a, b - a))
                for pair, keys in ((False, ids), (True, _pairs(ids, sizes))):
                    for i, some in enumerate(np.split(keys, np.cumsum(sizes)[:-1]), a):
                        held.append((pair, int(toxic[i]), np.unique(some)))  # a text counts once
                        size += len(held[-1][2])
                if size > HELD:
                    yield from table(held)
                    held, size = [], 0
        yield from table(held)

    # the toxic count is in the upper half of n
    counts = docs.mapInArrow(run, "pair boolean, key long, n long").groupBy("pair", "key").agg(F.sum("n").alias("n"))
    return counts.select("pair", "key", F.shiftright("n", 32).alias("toxic"), F.col("n").bitwiseAND(0xFFFFFFFF).alias("ordinary"))


def _kneser_ney(count: Column, total: Column, kinds: Column, below: Column) -> Column:
    return (F.greatest(count - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * below) / total


def _weight(toxic: Column, ordinary: Column, all_toxic: Column, all_ordinary: Column) -> Column:
    """How far the classes go their own ways: by what two rates gain over one."""
    part = lambda n, of: F.when(n > 0, n * F.log(n / of)).otherwise(0.0)
    two = lambda n, of: part(n, of) + part(of - n, of)
    gain = two(toxic, all_toxic) + two(ordinary, all_ordinary) - two(toxic + ordinary, all_toxic + all_ordinary)
    return 1 / (1 + F.exp(F.least(DOUBT - gain, F.lit(50.0))))


def _facts() -> list[Column]:
    """Sums, and numbers of different expressions, of each class and of both."""
    c = F.col
    kinds = {"kinds_toxic": F.sum((c("toxic") > 0).cast("long")), "kinds_ordinary": F.sum((c("ordinary") > 0).cast("long")), "kinds": F.count("*")}
    return [F.sum("toxic").alias("all_toxic"), F.sum("ordinary").alias("all_ordinary"), *(x.alias(n) for n, x in kinds.items())]


def probabilities(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of words (word, seen, toxic_p, ordinary_p, shared_p) and of pairs (before, word, seen, toxic_p, ordinary_p, alone), the classes' probabilities.

    Pairs that two texts or more have, after words that both classes have seen.
    """
    c = F.col
    pairs = counts.where("pair").select(F.shiftrightunsigned("key", 32).alias("before"), c("key").bitwiseAND(0xFFFFFFFF).alias("word"), "toxic", "ordinary")
    left = pairs.groupBy("word").agg(F.count("*").alias("befores"))
    one = counts.where("not pair").select(c("key").alias("word"), "toxic", "ordinary")
    sums = left.agg(F.sum("befores").alias("n"), F.count("*").alias("k"))
    of, facts = sorted(sums.unionByName(one.agg(*_facts()), allowMissingColumns=True).collect(), key=lambda r: r["k"] is None)
    if not of["n"] or not facts["all_toxic"] or not facts["all_ordinary"]:  # a class without a word tells nothing
        empty = one.where("false").withColumns({x: F.lit(1.0) for x in ("toxic_p", "ordinary_p", "shared_p", "alone")}).withColumn("seen", F.lit(0))
        return empty, empty.withColumn("before", F.lit(0))
    base = (F.greatest(c("befores") - DISCOUNT, F.lit(0.0)) + DISCOUNT * of["k"] / (of["k"] + 1)) / of["n"]
    known = {x: F.lit(facts[x]) for x in ("all_toxic", "all_ordinary", "kinds_toxic", "kinds_ordinary", "kinds")}
    both = c("toxic") + c("ordinary")
    one = one.join(left, "word").withColumn("base", base)
    one = one.withColumn("shared_p", _kneser_ney(both, known["all_toxic"] + known["all_ordinary"], known["kinds"], c("base")))
    one = one.withColumn("q", _weight(c("toxic"), c("ordinary"), known["all_toxic"], known["all_ordinary"]))
    for x in ("toxic", "ordinary"):
        one = one.withColumn(f"{x}_p", c("q") * _kneser_ney(c(x), known[f"all_{x}"], known[f"kinds_{x}"], c("base")) + (1 - c("q")) * c("shared_p"))
    one = written(one.select("word", both.alias("seen"), "toxic_p", "ordinary_p", "shared_p"), "words")
    two = pairs.where(both >= 2).join(pairs.groupBy("before").agg(*_facts()).where("all_toxic > 0 and all_ordinary > 0"), "before")
    two = two.join(one.drop("seen").withColumnsRenamed({f"{x}_p": f"{x}_one" for x in ("toxic", "ordinary", "shared")}), "word")
    two = two.withColumn("shared", _kneser_ney(both, c("all_toxic") + c("all_ordinary"), c("kinds"), c("shared_one")))
    two = two.withColumn("q", _weight(c("toxic"), c("ordinary"), c("all_toxic"), c("all_ordinary")))
    for x in ("toxic", "ordinary"):
        two = two.withColumn(f"{x}_p", c("q") * _kneser_ney(c(x), c(f"all_{x}"), c(f"kinds_{x}"), c(f"{x}_one")) + (1 - c("q")) * c("shared") * c(f"{x}_one") / c("shared_one"))
    return one, two.select("before", "word", both.alias("seen"), "toxic_p", "ordinary_p", F.log(c("toxic_one") / c("ordinary_one")).alias("alone"))


def _classed(rows: DataFrame, most: int) -> tuple[DataFrame, int, bool]:
    """Those of rows(.., change, seen) with a change worth storing, with a class of weight; the class from which they are heavy, `most` at most; and whether some are not.

    Weights are put into classes an eighth of a power of two wide; of the classes, a few
    hundred rows, the driver learns which are heavy.
    """
    rows = rows.where(F.abs("change") >= LEAST_CHANGE).withColumn("class", F.floor(8 * F.log2(F.abs("change") * F.col("seen"))))
    rows = written(rows.drop("change", "seen"), "evidence-classes")
    held, least = 0, 2**31
    for r in sorted(rows.groupBy("class").count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            return rows, least, True
        least = r["class"]
    return rows, least, False


def _heaviest(rows: DataFrame, most: int) -> DataFrame:
    """pair, key, evidence of those of rows(.., change, seen) that are heavy."""
    rows, least, _ = _classed(rows, most)
    return rows.where(F.col("class") >= least).drop("class")


def weighed(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """pair, key, evidence: ln of the toxic over the ordinary probability of words, and of words after words where it is another.

    Words whose evidence, and pairs whose change of it, is under LEAST_CHANGE are left out.
    Of more than `most` of either, those whose change times their texts is least are not
    among these but light: pair, key, added, what a word, or a pair to its word's, adds.
    """
    one, two = probabilities(counts)
    of, alone = F.log(F.col("toxic_p") / F.col("ordinary_p")), F.col("alone")
    one = one.select(F.lit(False).alias("pair"), F.col("word").alias("key"), of.alias("evidence"), of.alias("added"), of.alias("change"), "seen")
    stored = F.when(F.abs(alone) >= LEAST_CHANGE, alone).otherwise(0.0)
    two = two.select(F.lit(True).alias("pair"), F.shiftleft("before", 32).bitwiseOR(F.col("word")).alias("key"), of.alias("evidence"), (of - stored).alias("added"), (of - alone).alias("change"), "seen")
    (one, from_one, more_words), (two, from_two, more_pairs) = _classed(one, most), _classed(two, most)
    heavy, light = (one.where(F.col("class") >= from_one).unionByName(two.where(F.col("class") >= from_two)), one.where(F.col("class") < from_one).unionByName(two.where(F.col("class") < from_two)))
    return heavy.select("pair", "key", "evidence"), light.select("pair", "key", "added") if more_words or more_pairs else None


def weigh(counts: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The heavy rows of weighed()."""
    return weighed(counts, most)[0]


def fit_scale(x: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """a, b, most: the score 1 / (1 + exp(-(a min(x, most) + b))) fits the labels, a not negative.

    A share of labels, WRONG, counts as given at random, so that texts labelled toxic that
    say nothing toxic don't flatten the slope; nor do short texts with one strong word, as
    evidence beyond three times the median of the toxic texts counts no further. Fisher's
    steps, first as if no label were wrong, small ridge.
    """
    if not len(x) or toxic.all() or not toxic.any():
        return 0.0, (4.0 if len(x) and toxic.all() else -4.0), 1.0
    scale = float(np.median(x[toxic]))
    if scale <= 0:
        scale = float(np.std(x)) or 1.0
    design, beta = np.stack([np.clip(x / scale, -3, 3), np.ones(len(x))], axis=1), np.zeros(2)
    ridge = np.array([1e-2, 1e-3])
    for wrong in [0.0] * 60 + [WRONG] * 60:
        own = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = np.maximum((1 - 2 * wrong) * own * (1 - own), 1e-6)
        p = np.clip(wrong + (1 - 2 * wrong) * own, 1e-6, 1 - 1e-6)
        gradient, weight = slope * (toxic - p) / (p * (1 - p)), np.maximum(slope**2 / (p * (1 - p)), 1e-6)
        step = np.linalg.solve(design.T @ (design * weight[:, None]) + np.diag(ridge), design.T @ gradient - ridge * beta)
        beta += np.clip(step, -1, 1)
    return max(float(beta[0]), 0.0) / scale, float(beta[1]), 3 * scale


def score(x: np.ndarray, a: float, b: float, most: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * np.clip(x, -most, most) + b, -40, 40)))


def _labelled(rows: DataFrame, chosen: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(chosen) if few else chosen, "doc_id")


def fit_model(docs: DataFrame, labels: DataFrame) -> Fitted:
    """The table of evidence in the shared folder, and the score's scale.

    Only labelled documents that are not held out are used. The counts cover all of them
    but those set aside for the scale, however many there are; of equal texts under different
    doc_ids one counts, as toxic if one of them is. A null label or doc_id is left out; of several labels for
    one doc_id the largest counts. Without labels of both classes nothing is evidence.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    labels = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    labels = written(labels.where(crc % 3 != 1), "labels")
    rows = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(crc % 3 != 1)
    count = labels.count()
    few = count <= BROADCAST_LABELS  # then the texts stay where they are; beyond, both sides are shuffled
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(SCALE_SHARE, SCALE_ROWS / max(count, 1)) * (1 << 30))
    digests = _labelled(rows.where(~aside).select("doc_id", F.xxhash64("text").alias("digest")), labels.where(~aside), few)
    counted = digests.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "digest", "toxic")
    texts = rows.where(~aside).withColumn("digest", F.xxhash64("text"))
    known = texts.join(F.broadcast(counted) if few else counted, ["doc_id", "digest"]).select("text", "toxic")
    path = fresh_path(spark, "evidence")
    counts = written(count_expressions(known), "expressions")
    heavy, light = weighed(counts, MOST_ROWS)
    heavy.write.option("compression", "zstd").parquet(path)
    found = Fitted(path, (0.0, 0.0, 1.0))
    if light is not None:
        found.light, found.marks = fresh_path(spark, "light-evidence"), fresh_path(spark, "light-marks")
        light.write.option("compression", "zstd").parquet(found.light)
        marks_of(spark.read.parquet(found.light)).write.option("compression", "zstd").parquet(found.marks)
    forget(spark, counts)
    # SCALE_ROWS, about, bounds what is broadcast and comes to the driver
    chosen = labels.where(aside)
    x = evidences(rows.where(aside).join(F.broadcast(chosen), "doc_id"), found).groupBy("doc_id").agg(F.min("x").alias("x"))
    known = x.join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toPandas()
    found.scale = fit_scale(known["x"].to_numpy(float), known["toxic"].to_numpy() > 0)
    return found


def evidences(docs: DataFrame, model: Fitted) -> DataFrame:
    """doc_id, digest, a hash of the text, and x, the text's evidence, of docs(doc_id, text).

    Where there are light rows, the words and pairs that may have one go by themselves, of
    equal texts once, to be joined with them; no text is shuffled.
    """
    path, marks = model.path, model.marks
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("toxicity")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model_at(path).texts(batch.column(2)))], names=["doc_id", "digest", "x"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("toxicity")
        for batch in batches:
            at = 0
            for total, sizes, lists in model_at(path).open_texts(batch.column(2), marks_at(marks)):
                own = [batch.column(k).slice(at, len(sizes)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(total), pa.array(sizes.astype(np.int64)), *lists], names=["doc_id", "digest", "total", "words", "ones", "twos"])
                at += len(sizes)

    if model.light is None:
        return rows.mapInArrow(run, "doc_id long, digest long, x double")
    held = written(rows.mapInArrow(parts, "doc_id long, digest long, total double, words long, ones array<long>, twos array<long>"), "open-texts")
    once = held.where("size(ones) + size(twos) > 0").groupBy("digest").agg(F.first("ones").alias("ones"), F.first("twos").alias("twos"))
    wanted = once.select("digest", F.lit(False).alias("pair"), F.explode("ones").alias("key")).unionByName(once.select("digest", F.lit(True).alias("pair"), F.explode("twos").alias("key")))
    light = docs.sparkSession.read.parquet(model.light)
    # added up in one order, whatever the order of the rows
    added = F.aggregate(F.array_sort(F.collect_list("added")), F.lit(0.0), lambda a, b: a + b)
    more = wanted.join(light, ["pair", "key"]).groupBy("digest").agg(added.alias("more"))
    x = (F.col("total") + F.coalesce("more", F.lit(0.0))) / F.greatest("words", F.lit(1))
    return held.join(more, "digest", "left").select("doc_id", "digest", x.alias("x"))


def scored(docs: DataFrame, model: Fitted) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text).

    Null, empty and wordless texts have even evidence, 0, and the score that goes with it.
    Rows with one doc_id are scored one by one; a null doc_id counts as held out. Empty
    input gives no rows; other columns are left out, and nothing but the text is scored.
    """
    by_join, scale = model.light is not None, model.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("toxicity")
        for batch in batches:
            x = score(batch.column(1).to_numpy(), *scale) if by_join else model.scores(batch.column(1))
            out = [fold(i) == 1 for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_()), pa.array(x), pa.array((x >= TOXIC_FROM).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = evidences(rows, model).select("doc_id", "x") if by_join else rows
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def filtered(docs: DataFrame, model: Fitted) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns as they are.

    Null and empty texts stay where even evidence is not toxic; rows with repeated or null
    doc_ids are judged one by one. Empty input gives no rows.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("toxicity")
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) < TOXIC_FROM))

    rows = numbered(docs)
    if model.light is None:
        return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
    scale = model.scale

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["digest"]).filter(pa.array(score(batch.column(1).to_numpy(), *scale) >= TOXIC_FROM))

    text = F.col(f"_{at}").cast("string")
    found = evidences(rows.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text")), model).select("digest", "x")
    toxic = written(found.mapInArrow(taken, "digest long").distinct(), "toxic-texts")
    few = toxic.count() <= BROADCAST_LABELS  # then the texts stay where they are; beyond, they are shuffled
    return rows.withColumn("digest", F.xxhash64(text)).join(F.broadcast(toxic) if few else toxic, "digest", "left_anti").drop("digest").toDF(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored() of all documents by a model of the labels that are not held out."""
    docs = documents(spark, sf_dir)
    return scored(docs, fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """filtered() by a model of those labelled documents that docs still has."""
    return filtered(docs, fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

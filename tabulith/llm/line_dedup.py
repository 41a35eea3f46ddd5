"""Line deduplication by winnowing over line hashes.

Lines are what \\n separates; lines without a word are passed over and always stay. From
each line on, the shortest run of lines with at least GRAM words is a gram. The grams that
start within GRAM words of a line are its window; in each window the gram with the
smallest hash is a fingerprint. Two equal runs of lines with 2 * GRAM words or more have a
whole window in common and so share a fingerprint, wherever they stand; runs with fewer
than GRAM words are never matched.

Each fingerprint is joined to its first occurrence, in the order of doc_ids and lines, and
counts where all lines of the two grams are equal. From there the match is extended in both directions while the lines are equal, and the
lines so covered in the later place are deleted. A run's first fingerprint lies at most
GRAM words from its start and its last one less than 2 * GRAM words from its end, so each
fingerprint carries the hashes of the lines that near to it, and the extension needs no
further join.

The first occurrence may stand in other surroundings than a later pair. So the shortest
runs of 2 * GRAM words, from each line on and up to each line, are matched whole as well
(`whole`): every line of a longer run lies in one of them that the run contains, and what
a shortest run is depends on its own lines alone, so it is one at all its places. Runs are
equal if two independent hashes of their lines are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.llm.common import documents, numbered, picked, written

#: Words of a gram: no shorter run is matched, and any run of twice as many is found.
GRAM = 25
#: Documents with rows of their own again (two longs each) that are broadcast at most.
BROADCAST_AGAIN = 1_000_000
#: A character that is no blank, and runs of blanks.
WORDY, BLANKS = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]+"


def _lines(docs: DataFrame) -> DataFrame:
    """doc, version, n, h, w, s: each line with a word, its number, hash, words, and words before it in the document.

    A document is a doc_id and the hash of its text (version); copies under one doc_id are one.
    """
    line = F.explode(F.expr("filter(transform(split(text, '\\n'), (x, i) -> struct(i as n, x)), a -> a.x rlike '" + WORDY.replace("\\", "\\\\") + "')"))
    found = _once(docs).select("doc", "version", line.alias("a")).select("doc", "version", "a.n", F.xxhash64("a.x").alias("h"), F.size(F.split(F.regexp_replace("a.x", f"^{BLANKS}|{BLANKS}$", ""), BLANKS)).cast("long").alias("w"))
    end = F.sum("w").over(Window.partitionBy("doc", "version").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("e", end).withColumn("s", F.col("e") - F.col("w"))


def _once(docs: DataFrame) -> DataFrame:
    """docs(doc, version, text) with rows that are there again left out, before their lines are shuffled."""
    key = [F.col("doc").isNull().alias("none"), F.coalesce("doc", F.lit(0)).cast("long").alias("at"), "version"]
    keyed = docs.select(*key, "doc", "text")
    again = written(keyed.groupBy("none", "at", "version").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows"), "again")
    count = again.count()
    if not count:
        return docs
    few = F.broadcast(again) if count <= BROADCAST_AGAIN else again
    first = keyed.join(few, ["none", "at", "version"]).groupBy("none", "at", "version").agg(F.first("doc").alias("doc"), F.first("text").alias("text"))
    return keyed.join(few, ["none", "at", "version"], "left_anti").unionByName(first).select("doc", "version", "text")


def fingerprints(docs: DataFrame, gram: int = GRAM, whole: bool = False) -> DataFrame:
    """doc, version, gram, n, last, h, before, after of every fingerprint of docs(doc, version, text).

    n and last: the gram's first and last line; h: the hash of line n; before and after:
    (h, n) of the lines on either side of it, the nearest first. With whole, lines that are no fingerprint
    have rows too, without a gram, and each row has wide: (wide, check, n, last), hashes and
    lines of the shortest runs of 2 * gram words from this line on and up to it.
    """
    one = Window.partitionBy("doc", "version")
    by_start, by_end = one.orderBy("s"), one.orderBy("e")
    reach = by_start.rangeBetween(0, gram - 1)
    lines = _lines(docs).withColumn("next", F.lead(F.struct("h", "n")).over(by_start))
    lines = lines.withColumn("run", F.collect_list("h").over(reach)).withColumn("words", F.sum("w").over(reach)).withColumn("last", F.max("n").over(reach))
    lines = lines.withColumn("gram", F.when(F.col("words") >= gram, F.xxhash64("run"))).drop("run", "words")
    # of equal grams the earlier is taken
    least = F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", "s"))).over(by_start.rangeBetween(0, gram))
    lines = lines.withColumn("chosen", least["s"])
    taken = F.array_contains(F.collect_list("chosen").over(by_start.rangeBetween(-gram, 0)), F.col("s"))
    lines = lines.withColumn("taken", taken)
    before = F.reverse(F.collect_list(F.struct("h", "n")).over(by_start.rangeBetween(-gram, -1)))
    after = F.collect_list("next").over(by_end.rangeBetween(0, 2 * gram - 1))
    lines = lines.withColumn("before", before).withColumn("after", after)
    names = ["doc", "version", "gram", "n", "last", "h", "before", "after"]
    if not whole:
        return lines.where("taken").select(*names)
    on, up = by_start.rangeBetween(0, 2 * gram - 1), by_end.rangeBetween(-(2 * gram - 1), 0)
    lines = lines.withColumn("list_on", F.collect_list("h").over(on)).withColumn("list_up", F.collect_list("h").over(up))
    run = lambda over, of: F.struct(F.xxhash64(of).alias("wide"), F.xxhash64(F.lit("check"), of).alias("check"), F.min("n").over(over).alias("n"), F.max("n").over(over).alias("last"))
    long_on = F.max("e").over(on) - F.col("s") >= 2 * gram
    # where the lines before the last have the words, it is no shortest run from its first line on; others are there already
    long_up = F.col("s") - F.min("s").over(up) >= 2 * gram
    lines = lines.withColumn("up", F.when(long_up, run(up, "list_up"))).withColumn("on", F.when(long_on, run(on, "list_on")))
    lines = lines.withColumn("wide", F.array_compact(F.array("on", "up"))).where("taken or size(wide) > 0")
    return lines.select("doc", "version", *[F.when(F.col("taken"), F.col(c)).alias(c) for c in names[2:]], "wide")


def _equal(a: Column, b: Column) -> Column:
    """How many of the first entries of two arrays of (h, n) have equal hashes."""
    same = F.zip_with(a, b, lambda x, y: x["h"].eqNullSafe(y["h"]) & x["h"].isNotNull())
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _later_wide(prints: DataFrame) -> DataFrame:
    """doc, version, run: the places, but for the first and those that overlap it, of shortest runs of twice the gram's words."""
    wide = prints.select("doc", "version", F.explode("wide").alias("r")).select("doc", "version", "r.*")
    first = wide.groupBy("wide").agg(F.min(F.struct("doc", "version", "n", "last", "check")).alias("f"), F.count("*").alias("times")).where("times > 1").select("wide", "f")
    same = F.col("doc").eqNullSafe(F.col("f.doc")) & (F.col("version") == F.col("f.version"))
    later = wide.join(first, "wide").where((F.col("check") == F.col("f.check")) & ~(same & (F.col("n") <= F.col("f.last"))))
    return later.select("doc", "version", F.struct(F.col("n").alias("a"), F.col("last").alias("z")).alias("run"))


def _joined(runs: DataFrame) -> DataFrame:
    """Runs of a document that overlap or touch become one."""
    one = Window.partitionBy("doc", "version").orderBy("run")
    until = F.max("run.z").over(one.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(F.col("run.a") <= until + 1, 0).otherwise(1))
    runs = runs.withColumn("group", F.sum("new").over(one.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc", "version", "group").agg(F.min("run.a").alias("a"), F.max("run.z").alias("z")).select("doc", "version", F.struct("a", "z").alias("run"))


def repeated(docs: DataFrame, gram: int = GRAM, whole: bool = False) -> DataFrame:
    """doc, version, runs: for each document with repeated lines the line numbers (a, z) of the later runs."""
    found = written(fingerprints(docs, gram, whole), "prints")
    prints = found.where("gram is not null")
    # partial minima are taken before the shuffle, so a gram that very many documents share is no burden
    first = prints.groupBy("gram").agg(F.min(F.struct("doc", "version", "n", "h", "before", "after")).alias("f"), F.count("*").alias("times")).where("times > 1").select("gram", "f")
    later = prints.join(first, "gram").where(~(F.col("doc").eqNullSafe(F.col("f.doc")) & (F.col("version") == F.col("f.version")) & (F.col("n") == F.col("f.n"))))
    back, on = _equal(F.col("before"), F.col("f.before")), _equal(F.col("after"), F.col("f.after"))
    # the gram is one where its first line and all others, which are among those after it, are equal
    others = F.size(F.filter("after", lambda x: x["n"] <= F.col("last")))
    later = later.where((F.col("h") == F.col("f.h")) & (on >= others))
    start = F.when(back > 0, F.element_at("before", back)["n"]).otherwise(F.col("n"))
    end = F.when(on > 0, F.element_at("after", on)["n"]).otherwise(F.col("n"))
    runs = later.select("doc", "version", F.struct(start.alias("a"), end.alias("z")).alias("run"))
    if whole:
        runs = _joined(runs.unionByName(_later_wide(found)))
    return runs.groupBy("doc", "version").agg(F.array_sort(F.collect_set("run")).alias("runs"))


def _named(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))


def _cut(text: Column, runs: Column) -> Column:
    """The text without its lines with words in runs; without runs the text as it is."""
    inside = lambda i: F.exists(runs, lambda r: (r["a"] <= i) & (i <= r["z"]))
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~(inside(i) & x.rlike(WORDY)))
    return F.when(F.size(runs) > 0, F.array_join(kept, "\n")).otherwise(text)


def deduplicated(docs: DataFrame, gram: int = GRAM, whole: bool = False) -> DataFrame:
    """The rows of docs, their text without later repeated runs of lines, and no other change.

    The first of equal runs, by doc_id, hash of the text and line, stays where it is; a
    document may also repeat itself. Rows with one doc_id and one text are one document
    and get the same text; null doc_ids come first. Null texts stay null, empty ones
    empty; a text all of whose lines go keeps its lines without words. All columns stay
    as they are, with any names. Empty input gives no rows. DataFrame functions only.
    Without whole, lines of a run around its grams go only where the first occurrence has them too.
    """
    runs = repeated(_named(docs), gram, whole)
    flat, at = numbered(docs), docs.columns.index("text")
    text, doc = F.col(f"_{at}").cast("string"), F.col(f"_{docs.columns.index('doc_id')}").cast("long")
    packed = flat.select(F.struct(*flat.columns).alias("row"), doc.alias("doc"), F.xxhash64(text).alias("version"))
    runs = runs.select(F.col("doc").alias("of"), F.col("version").alias("of_version"), "runs")
    found = packed.join(runs, F.col("doc").eqNullSafe(F.col("of")) & (F.col("version") == F.col("of_version")), "left")
    text = _cut(F.col(f"row._{at}").cast("string"), F.coalesce("runs", F.expr("cast(array() as array<struct<a:int,z:int>>)")))
    return found.select(*[text if i == at else F.col(f"row._{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, changed and the text that is left, of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.octet_length("text").alias("was"))
    return deduplicated(docs, whole=True).select("doc_id", F.coalesce(F.octet_length("text") < F.col("was"), F.lit(False)).alias("changed"), "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """deduplicated() whole, with n_chars, where docs has it, set to the characters that are left.

    Nulls, repeated rows, no rows and clashing names are as described there; n_chars stays
    as it is where the text is null.
    """
    left = deduplicated(docs, whole=True)
    if "n_chars" not in docs.columns:
        return left
    flat, text, chars = numbered(left), docs.columns.index("text"), docs.columns.index("n_chars")
    length = F.coalesce(F.length(f"_{text}").cast(docs.schema[chars].dataType), F.col(f"_{chars}"))
    return flat.withColumn(f"_{chars}", length).toDF(*docs.columns)

"""Line dedup, SimHash, embeddings and components against brute force."""

import random
import re
import struct

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulith.llm import embedding_dedup, line_dedup, simhash
from tabulith.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def least_reached(nodes, links):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed, nodes, edges", [(1, 60, 30), (2, 100, 99), (3, 40, 200), (4, 5, 0)])
def test_components(spark, seed, nodes, edges):
    rng = random.Random(seed)
    links = [(rng.randrange(nodes) - 20, rng.randrange(nodes) - 20) for _ in range(edges)]
    links += [(i, i + 1) for i in range(1000, 1060)]  # a chain
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame([*links, (None, 3)], "u long, v long")).collect()}
    links = [(a, b) for a, b in links if a != b]
    assert found == least_reached({n for x in links for n in x}, links)


# --- SimHash


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


SIM_TEXTS = ["", None, "One", "one", "one two", "A b C d", "a B c D", "ÄÖ x y", "äö x y", "a b c d", "\x1ca b c", "long " * 4000, "x y z x y z", " \n\t "]


def test_fingerprints():
    found = simhash.fingerprints([None if t is None else t.encode() for t in SIM_TEXTS])
    assert [int(f) for f in found] == [fingerprint(t) for t in SIM_TEXTS]


@given(st.lists(st.integers(0, 2**64 - 1), max_size=12), st.data())
@settings(max_examples=10, deadline=None)
def test_links_are_whole(spark, some, data):
    near = [f ^ (1 << data.draw(st.integers(0, 63))) ^ (1 << data.draw(st.integers(0, 63))) for f in some]
    all_ = sorted({*some, *near, 0, 1, 3, 7, 2**63})
    signed = lambda f: f - 2**64 if f >> 63 else f
    edges = [(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame([(signed(f),) for f in all_], "fp long")).collect()]
    brute = [(signed(a), signed(b)) for a in all_ for b in all_ if a < b and (a ^ b).bit_count() <= 2]
    assert all((a % 2**64 ^ b % 2**64).bit_count() <= 2 for a, b in edges)
    nodes = list(map(signed, all_))
    assert least_reached(nodes, edges) == least_reached(nodes, brute)


def test_simhash_over_a_table(spark, sf):
    docs = {r["doc_id"]: fingerprint(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    reached = least_reached(docs, [(a, b) for a in docs for b in docs if a < b and (docs[a] ^ docs[b]).bit_count() <= 2])
    found = simhash.op8_simhash(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {k: (f"{f:016x}", reached[k]) for k, f in docs.items()} and len(found) == len(docs)


def test_simhash_odd_rows(spark):
    rows = [(i + 1, t, "x") for i, t in enumerate(SIM_TEXTS)] + [(None, "one", "y"), (4, "one", "z"), (4, "one", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(rows)
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2, 14)} == {1}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def similar_brute(rows):
    """The (doc_id, text) that stay, by all pairs of shingle sets."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    def shingles(text):
        words = WORD.findall(low(text))
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for _, t in rows]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    root = least_reached(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    version = lambda t: 42 if t is None else (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    firsts = {}
    for i, (doc, text) in enumerate(rows):
        place = (doc is None, doc or 0, version(text))
        firsts[root[i]] = min(firsts.get(root[i], (place, i)), (place, i))
    return sorted(str(rows[i]) for _, i in firsts.values())


def near_copies(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.choice([3, 12, 80, 200]))]
        rows.append((10 * i, " ".join(words)))
        for k in range(rng.choice([0, 0, 1, 4])):
            changed = list(words)
            for _ in range(rng.choice([0, 1, 2, 5])):
                changed[rng.randrange(len(changed))] = word()
            rows.append((10 * i + k, " ".join(changed)))  # some with a doc_id that is there already
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_of_similar_documents_stays(spark, seed):
    rows = near_copies(seed, 40)
    random.Random(seed).shuffle(rows)
    found = simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(str(tuple(r)) for r in found) == similar_brute(rows)


def test_pairs_that_meet_only_others(spark):
    """Texts whose shared runs all belong to a very large group are compared too, not only with its first ones."""
    rng = random.Random(3)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    whole, rows = some(250), []
    for _ in range(400):
        own = f"{whole} {some(32)}"
        rows += [f"{own} {some(31)}", f"{own} {some(31)}"]  # 0.82 alike, 0.80 at most to the whole, 0.66 to others
    df = spark.createDataFrame(list(enumerate([whole, *rows])), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.stage(spark, df, "").collect()) == [0, *range(1, 801, 2)]


def test_similar_documents_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = sorted(str((r["doc_id"], r["text"])) for r in simhash.stage(spark, docs, sf).collect())
    assert found == similar_brute([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("most", [0, 10**6])
def test_repeated_doc_ids_in_any_order(spark, monkeypatch, most):
    """A unique text under a doc_id that is there again stays, whatever the order of the rows and however its candidates meet."""
    monkeypatch.setattr(simhash, "BROADCAST_CANDIDATES", most)
    rows = [(1, "A b c d e f g"), (5, "A b c d e f g"), (5, "B unlike this one here is"), (None, "B unlike this one here is"), (None, None), (7, ""), (7, ""), (8, "q w"), (None, "x y z u v w")]
    for _ in range(3):
        rows = rows[4:] + rows[:4]
        df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, version string, `ROOT` int")
        out = simhash.stage(spark, df, "")
        assert out.columns == df.columns and sorted(str((r[0], r[1])) for r in out.collect()) == similar_brute(rows)
    assert simhash.stage(spark, df.limit(0), "").count() == 0


def test_wider_balls(spark):
    some = [0, 0b1111, 0b11111, 2**40 - 1, 2**62 | 1]
    edges = [(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame([(f,) for f in some], "fp long"), 4).collect()]
    assert least_reached(some, edges) == {f: 0 if f < 2**39 or f == 2**62 | 1 else f for f in some}
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), 3)


def test_names_that_clash(spark):
    """Columns whose names differ in case from those that are used stay as they are."""
    rows = [(i, f"text {i} " + "w " * 60, "TEXT", 0) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string, DOC int").toDF("doc_id", "text", "TEXT", "DOC_ID")
    for found in (simhash.stage(spark, df, ""), line_dedup.stage(spark, df, "")):
        assert found.columns == df.columns and {r[2] for r in found.collect()} == {"TEXT"}
    assert simhash.near_duplicates(df).count() == 4


# --- line dedup


def line_brute(docs, gram):
    """{(doc, version): deleted line numbers}, by the definitions alone."""
    signed = lambda h: h - 2**64 if h >> 63 else h
    hash_text = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))

    def hash_run(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
        return signed(seed)

    lines = {}
    for doc, text in docs:
        found, at = [], 0
        for n, line in enumerate(text.split("\n")):
            if size := len(WORD.findall(line)):
                found.append((n, hash_text(line), size, at))
                at += size
        lines[doc, hash_text(text)] = found
    prints = []
    for key, of in lines.items():
        grams, ends = [], []
        for n, _, _, at in of:
            run = [x for x in of if at <= x[3] <= at + gram - 1]
            grams.append(hash_run([x[1] for x in run]) if sum(x[2] for x in run) >= gram else None)
            ends.append(max(i for i, x in enumerate(of) if x[3] <= at + gram - 1))
        chosen = set()
        for i in range(len(of)):
            window = [(grams[j], of[j][3], j) for j in range(i, len(of)) if of[j][3] <= of[i][3] + gram and grams[j] is not None]
            if window:
                chosen.add(min(window)[2])
        prints += [(grams[j], key, j, ends[j]) for j in chosen]
    first = {}
    for g, key, j, _ in prints:
        first[g] = min(first.get(g, (key, lines[key][j][0], j)), (key, lines[key][j][0], j))
    deleted = {}
    for g, key, j, end in prints:
        other, _, at = first[g]
        if (other, at) == (key, j):
            continue
        a, b, back, on = lines[other], lines[key], 0, 0
        while j > back and at > back and b[j - back - 1][1] == a[at - back - 1][1] and b[j - back - 1][3] >= b[j][3] - gram and a[at - back - 1][3] >= a[at][3] - gram:
            back += 1
        while j + on + 1 < len(b) and at + on + 1 < len(a) and b[j + on + 1][1] == a[at + on + 1][1] and b[j + on + 1][3] <= b[j][3] + b[j][2] + 2 * gram - 1:
            on += 1
        deleted.setdefault(key, set()).update(b[x][0] for x in range(j - back, max(j + on, end) + 1))
    return {key: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in deleted.get(key, ())) for (d, t) in docs for key in [(d, hash_text(t))]}


def made_up(seed, n):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 2, 3, 8, 30]))) for _ in range(25)]
    shared = ["\n".join(rng.choice(pool) for _ in range(rng.randint(2, 9))) for _ in range(6)]
    return [(i, "\n".join(rng.choice(shared) if rng.random() < 0.3 else rng.choice(pool + ["", "  "]) if rng.random() < 0.5 else f"own {i} {j} " * rng.randint(1, 5) for j in range(rng.randint(0, 9)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("gram", [4, 25])
def test_line_dedup(spark, seed, gram):
    docs = made_up(seed, 60)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, runs string")
    found = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(df, gram).collect()}
    assert found == {k[0]: v for k, v in line_brute(docs, gram).items()}


def test_any_long_run_is_found(spark):
    """A passage of 50 words and more is deleted wherever else it stands, however its lines are cut."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs, passages = [], []
    for i in range(12):
        cuts = [rng.randint(1, 60) for _ in range(rng.randint(1, 6))]
        while sum(cuts) < 50:
            cuts.append(rng.randint(1, 30))
        passages.append("\n".join(" ".join(word() for _ in range(n)) for n in cuts))
    for i in range(36):
        own = lambda: " ".join(word() for _ in range(rng.randint(1, 40)))
        docs.append((i, "\n".join([own(), own(), passages[i % 12], own(), own()])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(df).collect()}
    for i, text in docs:
        before = passages[i % 12]
        assert (before in found[i]) == (i < 12)
        assert found[i] == (text if i < 12 else text.replace(before + "\n", ""))


def test_a_run_goes_whole_whatever_surrounds_its_lines_elsewhere(spark):
    """Lines of an earlier document don't keep a longer passage that two later ones share; a run is no copy of what it overlaps."""
    rng = random.Random(9)

    def lines(n):
        out = []
        while n:
            k = min(n, rng.randint(1, 30))
            out.append(" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(k)))
            n -= k
        return out

    docs, shared = [], {}
    for i in range(0, 90, 3):
        x, b, y = lines(20), lines(30), lines(20)
        for k, middle in enumerate((b, x + b + y, x + b + y)):
            docs.append((i + k, "\n".join([*lines(12), *middle, *lines(12)])))
        shared[i + 2] = x + b + y
    docs.append((1000, "\n".join(["same"] * 60)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.stage(spark, df, "").collect()}
    for i, passage in shared.items():
        own = [x for x in dict(docs)[i].split("\n") if x not in passage]
        assert found[i] == own
        assert all(any(x in found[j] for j in (i - 2, i - 1)) for x in passage)
    assert "same" in found[1000] and found[0] == dict(docs)[0].split("\n")


def test_line_dedup_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a", 1), (2, None, "b", 2), (3, "", "c", 3), (4, f"{long}\n\n{long}\nend", "d", 4), (1, long, "e", 5), (None, long, "f", 6), (5, "x " * 20000, "g", 7), (6, "\n\n", "h", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `row` string, runs int")
    out = line_dedup.deduplicated(df)
    assert out.columns == df.columns
    found = {r["row"]: r["text"] for r in out.collect()}
    assert found == {"a": "", "b": None, "c": "", "d": "\nend", "e": "", "f": long, "g": "x " * 20000, "h": "\n\n"}
    assert line_dedup.deduplicated(df.limit(0)).count() == 0


def test_equal_hashes_of_unequal_lines_delete_nothing(spark, monkeypatch):
    """Grams that are taken for equal are compared line by line."""
    lines = lambda k: [" ".join(f"{k}w{j}x{i}" for i in range(13)) for j in range(4)]
    docs = spark.createDataFrame([(k, "\n".join(lines(k))) for k in range(3)], "doc_id long, text string")
    real = line_dedup.fingerprints
    monkeypatch.setattr(line_dedup, "fingerprints", lambda *a, **k: real(*a, **k).withColumn("gram", F.when(F.col("gram").isNotNull(), F.lit(7))))
    assert {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs).collect()} == {k: "\n".join(lines(k)) for k in range(3)}


@pytest.mark.parametrize("most", [0, 10**6])
def test_rows_that_are_there_again(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_AGAIN", most)
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(2, long)] * 5 + [(None, long)] * 3 + [(3, "own " * 60)] * 2 + [(4, f"{long}\nend")]
    found = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, [(2, "")] * 5 + [(None, long)] * 3 + [(3, "own " * 60)] * 2 + [(4, "end")]))


def test_line_dedup_runs_no_python(spark, sf, capsys):
    line_dedup.op6_line_dedup(spark, sf).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


# --- embeddings


def vectors_brute(rows, least=0.9):
    sound = {}
    for at, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            x /= np.abs(x).max()
            sound[at] = x / np.linalg.norm(x)
    links = [(a, b) for a in sound for b in sound if a < b and len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] >= least]
    root = least_reached(range(len(rows)), links)
    ids = {}
    for at in range(len(rows)):
        ids.setdefault(root[at], []).append(rows[at][0])
    count = [sum(at in x for x in links) for at in range(len(rows))]
    smallest = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(str((rows[at][0], count[at], smallest[root[at]], rows[at][0] == smallest[root[at]])) for at in range(len(rows)))


def clustered(seed, n, size):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    rows = [[float(x) for x in np.float32(centres[rng.integers(12)] + rng.normal(size=size) * rng.choice([0.05, 0.3, 1.5]))] for _ in range(n)]
    return rows + rows[:15] + [rows[0]] * 30


@pytest.mark.parametrize("size, tile, rows", [(8, 16, 64), (33, 7, 20), (1, 50, 10), (64, 1024, 32768)])
def test_near_vectors(spark, monkeypatch, size, tile, rows):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", rows)
    table = [(100 - i, v) for i, v in enumerate(clustered(size, 150, size))]
    odd = [(901, None), (902, []), (903, [0.0] * size), (904, [float("nan")] * size), (905, [None] * size), (906, [float("inf")] + [1.0] * (size - 1)), (907, [1.0] * (size + 1)), (907, [1.0] * (size + 1)), (None, table[3][1]), (908, [1e-30] * size), (909, [1e30] * size)]
    df = spark.createDataFrame([(a, v, "x") for a, v in table + odd], "vec_id long, embedding array<float>, size string")
    found = sorted(str((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in embedding_dedup.near_vectors(df).collect())
    rounded = [(a, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for a, v in table + odd]
    assert found == vectors_brute(rounded)


def test_many_vectors_with_one_lead(spark, monkeypatch):
    """Vectors that no cut of the first coordinate parts are dealt to bounded blocks, and multiples are one class."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    flat = np.eye(48, dtype=np.float32) + (rng.random((48, 48)) < 0.02)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([flat, flat[:10] * 3, flat[:5] * 0.25]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(str((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in embedding_dedup.near_vectors(df).collect())
    assert found == vectors_brute(rows)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embedding_dedup.near_vectors(df).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
@settings(max_examples=80, deadline=None)
def test_stars(links):
    u, v = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
    assert embedding_dedup.stars(u, v, 31).tolist() == [least_reached(range(31), [x for x in links if x[0] != x[1]])[i] for i in range(31)]

"""Token files, packing and SentencePiece transducers."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from tabulith.llm import packing, pieces, token_files, tokenizing

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [
    "", None, " ", "  ", " a", "a ", "a b", "a  b", "a\n b", "a \n b", "a\n", "\n", "\n\n a", "a\tb c\t", "<|endoftext|> z", "it's I'll , . ,. a., b.,c", "é, ß. 1. 2, x1. ٣. ²,",
    " ~ a ~", "~~ ~", "\x1c a \x1d b", "a  b 　c", "ﬁ. ①, á, ́.", "\xa0 a\xa0", "漢字. 漢,", "😀 😀", "x" * 5000, "word " * 3000, "▁ a▁b", "\x00",
]
ATOMS = ["İ", "İ,", "ǆ.", "ﬁ!", "<|endoftext|>", "<|startoftext|>", "<|", "A", "a", "the", " ", "  ", "\n", "\t", ".", ",", "ing", "é", "漢", "😀", "1", "~", "'s", " ", "▁", "<s>", "aaaa", "\x1f", "́"]
TEXTS = st.lists(st.lists(st.sampled_from(ATOMS), max_size=12).map("".join), max_size=8)


def direct(path, texts, end):
    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def spark_hash(text):
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >> 63 else h


def split(found):
    ids, ends = found
    return [x.tolist() for x in np.split(ids, ends[:-1])] if len(ends) else []


@pytest.fixture(scope="module")
def encoders():
    return {BYTE: tokenizing.Encoder(BYTE, True, 50), WORD: tokenizing.Encoder(WORD, False, 50)}


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_library_s(encoders, path):
    for _ in range(2):  # the second time from memory
        assert split(encoders[path].encode(pa.array(ODD, pa.string()), 3)) == direct(path, ODD, 3)
    assert split(encoders[path].encode(pa.array([], pa.string()), 3)) == []


@given(TEXTS)
@settings(max_examples=80, deadline=None)
def test_ids_of_made_up_texts(texts):
    for path, keeps in ((BYTE, True), (WORD, False)):
        enc = tokenizing.encoder(path, keeps)
        assert split(enc.encode(pa.array(texts, pa.string()), 0)) == direct(path, texts, 0)


def test_slices():
    texts = pa.array(["abc", None, "x" * 50, "", "y"])
    cut = list(tokenizing.slices(texts, 10))
    assert [x for s in cut for x in s.to_pylist()] == texts.to_pylist() and len(cut) > 1
    assert list(tokenizing.slices(pa.array([], pa.string()))) == []


def odd_docs(spark):
    rows = [(i * 3, t, "size", 1) for i, t in enumerate(ODD)] + [(None, "no id", "x", 2), (6, "again", None, 3), (6, "again", None, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens int")


def test_token_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(odd_docs(spark), path, BYTE, 0)
    rows = sorted(odd_docs(spark).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, spark_hash(r["text"])))
    expected, at = [], 0
    for r, ids in zip(rows, direct(BYTE, [r["text"] for r in rows], 0), strict=True):
        expected.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    found = [tuple(r) for r in token_files.read_digests(spark, path).orderBy("start").collect()]
    assert found == expected
    assert "ids" not in token_files.token_lengths(spark, path).columns
    assert token_files.read_tokens(spark, path, 6, 9).count() == 4
    file = next(tmp_path.glob("t/*.parquet"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    assert all("DELTA_BINARY_PACKED" in c.encodings and not c.has_dictionary_page for n, c in columns.items() if not n.startswith("ids"))
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings


def test_a_filter_skips_pages(spark, tmp_path):
    """A file has many pages and row groups as wanted, and a filter on doc_id reads the rows of few of them."""
    path = f"file://{tmp_path}/t"
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('word ', id) AS text").coalesce(1)
    token_files.write_token_files(docs, path, BYTE, 0)
    wanted = token_files.read_tokens(spark, path, 11_000, 11_004)
    assert [r["doc_id"] for r in wanted.orderBy("doc_id").collect()] == list(range(11_000, 11_005))
    plan = wanted._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,11000), LessThanOrEqual(doc_id,11004)]" in plan.toString()
    rows, wanted_rows = [], wanted.select("doc_id")
    wanted_rows.foreach(lambda r: None)
    scans = [p for p in _nodes(wanted_rows._jdf.queryExecution().executedPlan()) if "Scan" in p.nodeName()]
    for scan in scans:
        rows.append(scan.metrics().apply("numOutputRows").value())
    assert rows and sum(rows) < 8 * token_files.PAGE_ROWS


def _nodes(plan):
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.executedPlan()
    children = plan.children()
    return [plan] + [x for i in range(children.size()) for x in _nodes(children.apply(i))]


def test_empty_token_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(odd_docs(spark).limit(0), path, BYTE)
    assert token_files.read_digests(spark, path).count() == 0


def test_op1_over_a_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = token_files.op1_token_files(spark, sf).orderBy("doc_id").collect()
    at = 0
    for r, ids in zip(found, direct(BYTE, [docs[k] for k in sorted(docs)], 0), strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@given(st.lists(st.integers(1, 60), max_size=60), st.integers(1, 9))
@settings(max_examples=80, deadline=None)
def test_differencing(lengths, windows):
    found = packing.differencing(lengths, windows)
    assert len(found) == len(lengths) and all(0 <= w < windows for w in found)
    if lengths:
        sums = np.bincount(found, weights=lengths, minlength=windows)
        assert sums.max() - sums.min() <= max(lengths)


@given(st.lists(st.integers(1, 64), min_size=1, max_size=50))
@settings(max_examples=60, deadline=None)
def test_pack_keeps_to_capacity(lengths):
    found, windows = packing.pack(lengths, 64)
    assert np.bincount(found, weights=lengths, minlength=windows).max() <= 64


def check_packed(rows, docs, capacity, end):
    ids = {}
    for (k, text), tokens in zip(docs, direct(WORD, [t for _, t in docs], end), strict=True):
        ids.setdefault((k, len(tokens)), []).append(np.array(tokens, "<u4"))
    pieces_of = {}
    for r in rows:
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"], r["doc_tokens"]])
        pieces_of.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    for key, texts in ids.items():
        assert sum(n for _, n in pieces_of[key]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for start, n in sorted(pieces_of[key]):
                assert start == at
                at += n
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for of in windows.values():
        at = 0
        for offset, n in sorted(of):
            assert offset == at
            at += n
        assert at <= capacity
    return sum(r["length"] for r in rows) / (capacity * len(windows))


def test_packed(spark):
    df = odd_docs(spark)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    check_packed(packing.packed(df, WORD, 2, 64).collect(), docs, 64, 2)
    assert packing.packed(df.limit(0), WORD).count() == 0
    assert packing.packed(df, WORD, 2, 64, with_ids=True).where("size(ids) <> length").count() == 0


def test_op7_over_a_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check_packed(packing.op7_packing(spark, sf).collect(), docs, 4096, 2) > 0.97


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def test_pieces_are_the_library_s(library, spark):
    rng = random.Random(1)
    texts = [x for x in ODD if x] + ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, ""]
    enc = pieces.PieceEncoder(PIECE, 200)
    found = split(enc.encode(pa.array(texts, pa.string()), None))
    assert found == library.encode([t or "" for t in texts])
    assert [enc.decode(np.array(x)) for x in found] == [library.decode(x) for x in found]
    assert all(enc.decode(np.array(x)) == (t or "").replace("▁", " ") for x, t in zip(found, texts, strict=True))


def test_pieces_of_a_table(library, spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pieces.op2_pieces(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_crc32"], r["text_crc32"], r["same"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(docs[r["doc_id"]].encode()), True)


def test_unigram_models(tmp_path):
    """The same machine with a unigram acceptor, against the library's search on short texts."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(PIECE, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = pieces.UNIGRAM
    for p in model.pieces:
        p.score = -60.0 if p.score < -1e6 else p.score / 1024
    path = str(tmp_path / "u.model")
    with open(path, "wb") as file:
        file.write(model.SerializeToString())
    rng = random.Random(2)
    texts = ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    enc = pieces.PieceEncoder(path)
    assert split(enc.encode(pa.array(texts, pa.string()), None)) == sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normalisers(tmp_path, rule, squeeze):
    """Compiled normalisers, and ids after them, are the library's."""
    made = sentencepiece_model_pb2.ModelProto()
    made.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model = sentencepiece_model_pb2.ModelProto()
    with open(PIECE, "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.precompiled_charsmap = made.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    path = str(tmp_path / "n.model")
    with open(path, "wb") as file:
        file.write(model.SerializeToString())
    rng, odd = random.Random(5), ["ＫＡ", "ﬁ", "Ⅷ", "が", "\u304b\u3099", "\u200b", "\u3000", "İ", "ß", "ẛ̣", "…", "\t", "\r", "\n", "\x7f", "½", "한"]
    texts = [x for x in ODD if x] + ["".join(rng.choice(ATOMS + odd) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    enc, library = pieces.PieceEncoder(path, 300), sentencepiece.SentencePieceProcessor(model_file=path)
    assert split(enc.encode(pa.array([*texts, None], pa.string()), None)) == library.encode([*texts, ""])


def test_encoded_and_decoded(spark):
    df = odd_docs(spark)
    ids = pieces.encoded(df, PIECE)
    assert ids.columns == ["doc_id", "ids"] and ids.count() == df.count()
    back = sorted((str(r["doc_id"]), r["text"]) for r in pieces.decoded(ids, PIECE).collect())
    assert back == sorted((str(r["doc_id"]), (r["text"] or "").replace("▁", " ")) for r in df.collect())
    assert pieces.encoded(df.limit(0), PIECE).count() == 0
    assert pieces.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PIECE).first()["text"] == ""

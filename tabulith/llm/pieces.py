"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled to three machines. The normaliser reads characters, writes for
the longest run of them that its map has what the map says, and spaces as U+2581, puts one
in front and, where the model asks for it, leaves out spaces at the ends and after spaces. The lexicon reads characters and writes piece ids; a character that
no piece has is written as the ids of its bytes. The acceptor reads piece ids: for a
unigram model it has one state and a piece's weight is its negative score; for a BPE
model its states are the pieces, and the arc from one to the next has weight 0 if merging
leaves the two side by side and none otherwise. A text is composed with them, and its ids
are the shortest path in the tropical semiring. In a BPE model that path is the only one
of finite weight and is what merging by score gives.

Pieces don't reach across the start of a run of spaces, so a text is composed run by run,
and each distinct run once.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import FORGET, documents, picked, use_worker
from tabulith.llm.tokenizing import MEMO_ENTRIES, Encoder, slices

SPACE, SPACES = "▁", re.compile(" {2,}")
RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: What a unigram model adds to its lowest score for a character that no piece has.
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2


class Normaliser:
    """normalise(text) is the text as the lexicon reads it; plain where it only writes spaces as U+2581 and puts one in front."""

    def __init__(self, spec):
        self.prefix, self.squeeze = SPACE if spec.add_dummy_prefix else "", spec.remove_extra_whitespaces
        self.map = charsmap(spec.precompiled_charsmap) if spec.precompiled_charsmap else {}
        self.longest: dict[str, int] = {}  # of the map's entries that start with a character
        for key in self.map:
            self.longest[key[0]] = max(self.longest.get(key[0], 0), len(key))
        self.plain = not self.map and not self.squeeze

    def _arcs(self, text: str) -> Iterator[str]:
        """What is written along the only path, the longest entry at each place."""
        i = 0
        while i < len(text):
            for n in range(min(self.longest.get(text[i], 0), len(text) - i), 0, -1):
                if (found := self.map.get(text[i : i + n])) is not None:
                    yield found
                    i += n
                    break
            else:
                yield text[i]
                i += 1

    def normalise(self, text: str) -> str:
        out = "".join(self._arcs(text)) if self.map else text
        if self.squeeze:
            out = SPACES.sub(" ", out).strip(" ")
            return (self.prefix + out).replace(" ", SPACE).rstrip(SPACE) if out else ""
        return (self.prefix + out).replace(" ", SPACE) if text else ""


def charsmap(blob: bytes) -> dict[str, str]:
    """The entries of a precompiled map: a size, a double-array trie of so many bytes, and what its values point to.

    A unit of the trie has its label in the lowest 8 bits, a mark for a value in the next, and
    the distance to its children in the upper 22, times 256 where bit 9 is set; a value has bit 31 set.
    """
    size = struct.unpack_from("<I", blob)[0]
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    bytes_, found = np.arange(256), {}
    distance = lambda unit: unit >> 10 << ((unit & 1 << 9) >> 6)
    waiting = [(b"", distance(int(units[0])))]
    while waiting:
        key, base = waiting.pop()
        at = base ^ bytes_
        inside = at < len(units)
        labels = np.where(inside, units[np.where(inside, at, 0)] & (1 << 31 | 0xFF), -1)
        for byte in bytes_[(labels == bytes_) & (bytes_ > 0)].tolist():
            unit = int(units[base ^ byte])
            below = base ^ byte ^ distance(unit)
            if unit >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                found[(key + bytes([byte])).decode("utf-8", "surrogateescape")] = texts[start : texts.index(b"\0", start)].decode()
            waiting.append((key + bytes([byte]), below))
    return found


class Transducer:
    """path(run) is the shortest path through lexicon and acceptor for a normalised run of characters."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.kind, norm = proto.trainer_spec.model_type, proto.normalizer_spec
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be compiled")
        if not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only normalisers that write spaces as U+2581, before words, can be compiled")
        self.normaliser = Normaliser(norm)
        self.prefix = self.normaliser.prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)}
        bytes_ = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_ids = [bytes_[f"<0x{b:02X}>"] for b in range(256)] if bytes_ else None
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.unknown_weight = UNKNOWN_PENALTY - min((self.score[i] for i in self.id_of.values()), default=0.0) if self.kind == UNIGRAM else 0.0
        self.longest = max(map(len, self.id_of), default=1)
        self.size = list(map(len, self.pieces))
        self.starts = {p[:i] for p in self.id_of for i in range(1, len(p))}
        # for merging: lower ranks merge first, equal ranks from the left
        self.rank = [-s for s in self.score]
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.beside: dict[int, bool] = {}
        #: What an id stands for, in bytes; spaces as spaces.
        self.text = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else b" \xe2\x81\x87 " if k == UNKNOWN else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]

    def _parts(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merger is the last one that makes this piece; None for a single character."""
        if piece not in self.parts:
            run = list(self.pieces[piece])
            while len(run) > 2:
                ranks = [self.rank[i] if (i := self.id_of.get(a + b)) is not None else math.inf for a, b in zip(run, run[1:], strict=False)]
                k = ranks.index(min(ranks))
                if ranks[k] == math.inf:
                    break  # merging never makes this piece
                run[k : k + 2] = [run[k] + run[k + 1]]
            both = [self.id_of.get(x) for x in run]
            self.parts[piece] = (both[0], both[1]) if len(run) == 2 and None not in both else None
        return self.parts[piece]

    def _made(self, piece: int) -> bool:
        return self.size[piece] == 1 or self._parts(piece) is not None

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether merging the characters of both leaves the two pieces: no merger across comes before theirs.

        The pieces are taken apart from the last merger to the first; a merger across the
        boundary is in order before the one to the right of it with an equal rank, and
        after the one to the left.
        """
        key = a << 32 | b
        if (known := self.beside.get(key)) is not None:
            return known
        x, y, limit, equal, ok = a, b, math.inf, False, True
        while True:
            across = self.id_of.get(self.pieces[x] + self.pieces[y])
            if across is not None and (self.rank[across] < limit or equal and self.rank[across] == limit):
                ok = False
                break
            left, right = self._parts(x), self._parts(y)
            if left is None and right is None:
                break
            if right is None or left is not None and self.rank[x] > self.rank[y]:
                limit, equal, x = self.rank[x], False, left[1]
            else:
                limit, equal, y = self.rank[y], True, right[0]
        if len(self.beside) > 4 * MEMO_ENTRIES:
            self.beside.clear()
        self.beside[key] = ok
        return ok

    def _fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    def path(self, run: str) -> list[int]:
        """Ids along the shortest path."""
        return self._only(run) if self.kind == BPE else self._least(run)

    def _arcs(self, run: str, i: int) -> list[int]:
        """The pieces that start at i, shorter before longer; without one of a single character, -1 for its bytes comes first."""
        found, id_of, starts = [], self.id_of, self.starts
        for j in range(i + 1, min(len(run), i + self.longest) + 1):
            part = run[i:j]
            piece = id_of.get(part)
            if piece is not None:
                found.append(piece)
            elif j == i + 1:
                found.append(-1)
            if part not in starts:
                break
        return found

    def _only(self, run: str) -> list[int]:
        """The one path whose arcs all have a weight, depth first and longer pieces first.

        The acceptor's state at a position is determined by the position, as the text up
        to there has one path of its own; so a position that led nowhere is left out.
        """
        n, size = len(run), self.size
        ends, taken, ways = [0], [-1], [self._arcs(run, 0) if run else []]
        dead: set[int] = set()
        while ends[-1] < n:
            way, at, before = ways[-1], ends[-1], taken[-1]
            while way:
                piece = way.pop()
                end = at + (size[piece] if piece >= 0 else 1)
                if end in dead or piece >= 0 and (not self._made(piece) or before >= 0 and not self.side_by_side(before, piece)):
                    continue
                ends.append(end)
                taken.append(piece)
                ways.append(self._arcs(run, end) if end < n else [])
                break
            else:
                dead.add(ends.pop())
                taken.pop()
                ways.pop()
        out = []
        for at, piece in zip(ends, taken[1:], strict=False):
            if piece >= 0:
                out.append(piece)
            else:
                out += self._fallback(run[at])
        return out

    def _least(self, run: str) -> list[int]:
        """The path of least weight: the best arc into each position is kept, from the first on."""
        n = len(run)
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)] + [(math.inf, 0, -1)] * n
        for i in range(n):
            for piece in reversed(self._arcs(run, i)):
                j = i + (self.size[piece] if piece >= 0 else 1)
                weight = best[i][0] + (self.unknown_weight if piece < 0 else -self.score[piece])
                if weight < best[j][0]:
                    best[j] = (weight, i, piece)
        at, back = n, []
        while at:
            _, i, piece = best[at]
            back.append([piece] if piece >= 0 else self._fallback(run[i]))
            at = i
        return [x for part in reversed(back) for x in part]


class PieceEncoder(Encoder):
    """Ids of texts with the shortest paths of repeated runs remembered. A null text counts as empty."""

    plain_is_clean = False

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        with open(path, "rb") as file:
            self.machine = Transducer(file.read())
        self.keeps_blanks, self.memo_entries, self.memo, self.special = True, memo_entries, {}, []
        self.feed = self._run("\n")

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if self.machine.normaliser.plain:
            return super().encode(texts, end_id)
        if len(self.memo) > self.memo_entries:
            self.memo.clear()
        end, out = b"" if end_id is None else struct.pack("<I", end_id), []
        for text in texts.to_pylist():
            found = RUNS.findall(self.machine.normaliser.normalise(text or ""))
            self.memo.update([(x, self._run(x)) for x in set(found).difference(self.memo)])
            out.append(b"".join([self.memo[x] for x in found]) + end)
        return np.frombuffer(b"".join(out), "<u4"), np.cumsum([len(x) // 4 for x in out]).astype(np.int64)

    def _run(self, run: str) -> bytes:
        return struct.pack(f"<{len(ids := self.machine.path(run))}I", *ids)

    def _clean(self, piece: str) -> bool:
        return bool(piece) and SPACE not in piece

    def _learn(self, pieces: list[str]) -> None:
        # a line feed is in no piece, so it parts a run
        self.memo.update([(p, self.feed + self._run(p[1:]) if p[0] == "\n" else self._run(SPACE + p)) for p in pieces])

    def _heads(self, pieces: list[str]) -> list[bytes]:
        return [self._run(self.machine.prefix + p) if p else b"" for p in pieces]

    def _head_odd(self, piece: str) -> bool:
        return not piece or SPACE in piece

    def _whole(self, text: str) -> bytes:
        return b"".join([self._run(x) for x in RUNS.findall(self.machine.prefix + text.replace(" ", SPACE))]) if text else b""

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD. U+2581 in a text comes back as a space."""
        table = self.machine.text
        found = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return found[1:] if self.machine.prefix and found[:1] == " " else found


_encoders: dict[str, PieceEncoder] = {}
FORGET.append(_encoders.clear)


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _texts(docs: DataFrame) -> DataFrame:
    return picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids of every row of docs(doc_id, text).

    Null and empty texts have no ids. Rows with repeated or null doc_ids stay as they are.
    Empty input gives no rows; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("pieces")
        for batch in batches:
            row = 0
            for texts in slices(batch.column(1)):
                ids, ends = piece_encoder(model).encode(texts, None)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), lists], names=["doc_id", "ids"])
                row += len(texts)

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows(doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("pieces")
        for batch in batches:
            texts = [piece_encoder(model).decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit), text_crc32 of the decoded text, same: whether it is the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("pieces")
        for batch in batches:
            row, enc = 0, piece_encoder(model)
            for texts in slices(batch.column(1)):
                ids, ends = enc.encode(texts, None)
                each = np.split(ids, ends[:-1])
                back = [enc.decode(x).encode() for x in each]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(texts)), pa.array(np.diff(ends, prepend=0)), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                        pa.array(map(zlib.crc32, back), pa.int64()), pa.array([a == (b or "").encode() for a, b in zip(back, texts.to_pylist(), strict=True)]),
                    ],
                    names=["doc_id", "n_tokens", "ids_crc32", "text_crc32", "same"],
                )
                row += len(texts)

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, text_crc32 long, same boolean")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digests() of all documents by a model with byte fallback."""
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))

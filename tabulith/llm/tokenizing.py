"""Token ids by the tokenizers library, with the ids of repeated words remembered.

A text is cut at single spaces where the tokenizer's own rules never join what
stands on the two sides, so the ids of the pieces, one after another, are the ids of
the text. Each distinct piece is encoded once and kept in a bounded memo.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabulith.llm.common import FORGET, text_runs

#: Pieces that a worker remembers; at the bound half of them go.
MEMO_ENTRIES = 700_000
#: Marks that are split from the letters before them; they form no contraction, as an apostrophe does.
MARK_SET = ".,!?;:#*$%&|"
MARKS = tuple(MARK_SET)
#: Pieces that are joined to one text for one call of the library.
JOINED = 512


class Encoder:
    """encode(texts) gives the ids of all texts in one array, and where each text's ids end.

    keeps_blanks: the tokenizer is of the byte-level kind, where a space belongs to the
    word after it and runs of blanks are tokens. Otherwise blanks only separate.
    A null text counts as empty. A text that holds the string of a special token goes to
    the library whole.
    """

    plain_is_clean = True

    def __init__(self, path: str, keeps_blanks: bool, memo_entries: int = MEMO_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # but for texts with the string of a special token
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_blanks, self.memo_entries = keeps_blanks, memo_entries
        self.memo: dict[str, bytes] = {}
        self.between = "\n" if keeps_blanks else " ~ "
        (self.between_id,) = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.feed = self._plain(["\n"])[0]
        self.marks: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _clean(self, piece: str) -> bool:
        """Whether it stands alone: no blank at its ends, but for the line feed that a line's first piece starts with."""
        word = piece.removeprefix("\n")
        return not self.keeps_blanks or bool(word) and not word[0].isspace() and not word[-1].isspace()

    def _encode(self, pieces: list[str], lead: str, clean: bool) -> list[bytes]:
        """The ids of each piece, where lead stands before it; many in one call of the library."""
        mark = self.between.strip(" ")
        if clean and self.keeps_blanks:
            alone = []  # a clean piece has no line feed but in front, and that is taken off
        else:
            alone = [i for i, x in enumerate(pieces) if mark in x or not x or x.strip() is not x]
        out = [b""] * len(pieces)
        for i, ids in zip(alone, self._plain([lead + pieces[i] for i in alone]), strict=True):
            out[i] = ids
        rest = sorted(set(range(len(pieces))).difference(alone)) if alone else range(len(pieces))
        groups = [rest[i : i + JOINED] for i in range(0, len(rest), JOINED)]
        joined = [lead + (self.between + lead).join([pieces[i] for i in g]) for g in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            raw, at = ids.tobytes(), 0
            for i, end in zip(group, [*(np.flatnonzero(ids == self.between_id) * 4).tolist(), len(raw)], strict=True):
                out[i] = raw[at:end]
                at = end + 4
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Remember new pieces. Where letters end, marks are tokens of their own: only the letters are encoded with the rest."""
        memo, marked = self.memo, []
        ended = [x for x in pieces if x.endswith(MARKS)]
        for x in ended:
            base = x.rstrip(MARK_SET)
            if base[-1:].isalpha() and base[-1:].isascii():  # others may become a letter and something else
                marked.append((x, base, x[len(base) :]))
        new_marks = list({m for _, _, m in marked}.difference(self.marks))
        self.marks.update(zip(new_marks, self._plain(new_marks), strict=True))
        bases = {b for _, b, _ in marked if b not in memo}
        rest = list(set(pieces).difference([x for x, _, _ in marked]) | bases)
        if self.keeps_blanks:
            starts = [x for x in rest if x[0] == "\n"]
            memo.update(zip(starts, [self.feed + x for x in self._encode([x[1:] for x in starts], "", True)], strict=True))
            rest = [x for x in rest if x[0] != "\n"]
        memo.update(zip(rest, self._encode(rest, " " if self.keeps_blanks else "", True), strict=True))
        memo.update([(x, memo[b] + self.marks[m]) for x, b, m in marked])

    def _heads(self, pieces: list[str]) -> list[bytes]:
        """The ids of the first pieces of texts."""
        return self._encode(pieces, "", False)

    def _head_odd(self, piece: str) -> bool:
        """Whether a first piece is not cut off from what follows it."""
        return piece[-1:].isspace()

    def _whole(self, text: str) -> bytes:
        """The ids of a text whose blanks don't stand alone."""
        return b"".join(self._plain(self._glued(text.split(" "))))

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32-bit) of all texts, each with end_id, if any, at its end, and the ends of the texts in them.

        As in the library's own call, the string of a special token is that token wherever it stands.
        """
        special = np.zeros(len(texts), bool)
        for x in self.special:
            special |= pc.match_substring(texts, x).fill_null(False).to_numpy(zero_copy_only=False)
        if not special.any():
            return self._encode_texts(texts, end_id)
        ids, ends = self._encode_texts(pc.if_else(pa.array(special), "", texts), end_id)
        parts = np.split(ids, ends[:-1])
        self.tokenizer.encode_special_tokens = False
        for i in np.flatnonzero(special).tolist():
            (own,) = self._plain([texts[i].as_py()])
            parts[i] = np.concatenate([np.frombuffer(own, "<u4"), parts[i]])
        self.tokenizer.encode_special_tokens = True
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])

    def _encode_texts(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > self.memo_entries:
            # the oldest half stays: frequent pieces come early
            self.memo = dict(islice(self.memo.items(), self.memo_entries // 2))
        # a line feed ends a piece, and where blanks matter starts the next
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " \n" if self.keeps_blanks else " "), " ")
        first, after = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py(), split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().copy()
        memo = self.memo
        known = list(map(memo.get, words))
        new = [i for i, x in enumerate(known) if x is None]
        # what strip() leaves alone has no blank at its ends, which is nearly always so
        self._learn([w for w in map(words.__getitem__, new) if w and w.strip() is w and self.plain_is_clean or self._clean(w)])
        for i in new:
            known[i] = memo.get(words[i])
        if self.keeps_blanks:
            heads = [words[i] for i in at[first].tolist()]
            unclean = np.fromiter((x is None for x in known), bool, len(known))
            odd = unclean[at]
            odd[first] = [self._head_odd(x) for x in heads]
            alone = after - first == 1
            odd[first[alone]] = False
            slow = np.flatnonzero(np.logical_or.reduceat(odd, first)) if len(first) else first
            starts = self._heads(heads)
            for i in slow.tolist():
                starts[i] = self._whole(texts[i].as_py())
            # a text's first piece, or all of an odd text, stands as an entry of its own
            at[first] = len(known) + np.arange(len(first))
            for i in slow.tolist():
                at[first[i] + 1 : after[i]] = len(known) + len(first)
            known = [x or b"" for x in known] + starts + [b""]
        sizes = np.fromiter(map(len, known), np.int32, len(known)) // 4
        table, begin = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes, dtype=np.int32) - sizes
        # end_id goes behind the last word of each text
        n = np.zeros(len(at) + len(first), np.int32)  # a text, and so a slice, has under 2**31 bytes
        source = np.zeros(len(n), np.int32)
        place = np.arange(len(at)) + np.repeat(np.arange(len(first)), after - first)
        n[place], source[place] = sizes[at], begin[at]
        last = after + np.arange(len(first))
        n[last], source[last] = end_id is not None, len(table)
        ends = np.cumsum(n, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.concatenate([table, np.array([end_id or 0], "<u4")])[np.repeat(source - (ends - n), n) + np.arange(total, dtype=np.int32)]
        return ids, ends[last].astype(np.int64)

    @staticmethod
    def _glued(pieces: list[str]) -> list[str]:
        """The text in parts, cut only at a space between two characters that are no blanks."""
        groups = [[pieces[0]]]
        for before, piece in zip(pieces, pieces[1:], strict=False):
            if before and piece and not before[-1].isspace() and not piece[0].isspace():
                groups.append(["", piece])
            else:
                groups[-1].append(piece)
        return [" ".join(g) for g in groups]


_encoders: dict[tuple[str, bool], Encoder] = {}
FORGET.append(_encoders.clear)


def encoder(path: str, keeps_blanks: bool, memo_entries: int = MEMO_ENTRIES) -> Encoder:
    """The encoder of this process; its memo lives as long as the worker."""
    key = (path, keeps_blanks)
    if key not in _encoders:
        _encoders[key] = Encoder(path, keeps_blanks, memo_entries)
    return _encoders[key]


def slices(texts: pa.Array, most_bytes: int = 8 << 20) -> Iterator[pa.Array]:
    """The texts in runs of about most_bytes."""
    for a, b in text_runs(texts, most_bytes):
        yield texts.slice(a, b - a)

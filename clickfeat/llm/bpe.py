"""Byte-level BPE encoding over a prefix-sharing trie, and decoding.

The vocabulary file names tokens and merges; nothing is trained.  Byte-pair encoding has a useful property: the
encoding of a word's prefix is the encoding of a shorter prefix plus one last token.  So the state of a prefix is
its last token alone, and it is the one token ending there whose merge with the last token of the prefix before it
cannot happen earlier than both were made (``_compatible``).  Distinct words go into a trie and a depth-first walk
gives every node its last token once, however many words share it.  A word's ids are then read back along its path.

A text is split where a space follows a non-space, which the word pattern never crosses; such segments repeat
often, so each task keeps a table of segment to ids, emptied when it holds ``CACHE`` segments.

Defined cases: null text is empty and has no ids; the special token's string encodes to its id; decoding replaces
invalid UTF-8 as the file's decoder does; repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfeat.llm.common import slices, texts_of

CACHE = 60_000  # segments of the young table; the old one is as large
BATCH = 1024  # texts whose new words go through one trie
STEPS = 400_000
PAIRS = 200_000
# Fixed value: the word pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Fixed value: the characters that the word pattern's white space stands for.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_SPACE_RUN = re.compile(r"\s ")
_SEGMENTS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def _byte_of_sign() -> dict[str, int]:
    """The signs that stand for bytes in the file: printable Latin-1 stands for itself, the rest follows 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class Vocabulary:
    """Tokens as bytes, merges as (left id, right id) to rank, and the special strings of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        ids = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = byte_table(path)
        ordinary = {i: b for i, b in self.bytes_of.items() if i not in self.special.values()}
        self.rank_of_pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, made = (ids[left], ids[right]), ids[left + right]
            self.rank_of_pair[pair] = rank
            self.parts.setdefault(made, pair)
            self.rank.setdefault(made, rank)
        self.known: dict[int, bool] = {}
        whole: dict[int, bool] = {}
        for token in sorted(ordinary, key=lambda i: self.rank.get(i, -1)):
            left, right = self.parts.get(token, (None, None))
            whole[token] = left is None or (
                whole[left] and whole[right] and self.beside(left, right, self.rank[token])
            )
        # Tokens that their own bytes encode to; no other can be a last token.
        self._suffix_automaton(
            {b: i for i, b in ordinary.items() if whole[i] and (len(b) == 1 or i in self.parts)}
        )

    def _suffix_automaton(self, tokens: dict[bytes, int]) -> None:
        """``step`` leads from (state, byte) to the longest suffix that begins a token; ``ending`` lists the
        (token, length) that end in a state, longest first."""
        self.step: dict[int, int] = {}
        own: list[tuple[int, int] | None] = [None]
        edges: list[list[tuple[int, int]]] = [[]]
        for text, token in tokens.items():
            state = 0
            for byte in text:
                to = self.step.get(state << 8 | byte)
                if to is None:
                    to = self.step[state << 8 | byte] = len(own)
                    own.append(None)
                    edges.append([])
                    edges[state].append((byte, to))
                state = to
            own[state] = (token, len(text))
        self.shorter = [0] * len(own)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        queue = [0]
        for state in queue:
            for byte, to in edges[state]:
                self.shorter[to] = self.follow(self.shorter[state], byte) if state else 0
                self.ending[to] = ((own[to],) if own[to] else ()) + self.ending[self.shorter[to]]
                queue.append(to)

    def follow(self, state: int, byte: int) -> int:
        to = self.step.get(state << 8 | byte)
        if to is None:
            to = self.follow(self.shorter[state], byte) if state else 0
            if len(self.step) < STEPS:
                self.step[state << 8 | byte] = to
        return to

    def beside(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether two tokens can stand side by side when all merges of a rank below ``limit`` are done.

        Undo the later of the two tokens' merges, again and again.  If the pair then facing each other across the
        border has an earlier merge than the one just undone, that merge would have come first.  Of two merges of
        one rank the left one comes first.
        """
        while True:
            rank = self.rank_of_pair.get((left, right))
            if rank is not None and rank < limit:
                return False
            of_left, of_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                limit, left = of_left, self.parts[left][1]
            else:
                limit, right = of_right + 1, self.parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        """``beside`` with all merges done, remembered."""
        known = self.known.get(left << 32 | right)
        if known is None:
            if len(self.known) > PAIRS:
                self.known.clear()
            known = self.known[left << 32 | right] = self.beside(left, right)
        return known


class Encoder:
    """Encodes texts to little-endian 32-bit ids; keeps its trie and its table of segments between calls."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.words = regex.compile(WORDS.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        strings = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None
        self.four = {i: i.to_bytes(4, "little") for i in self.vocabulary.bytes_of}
        # Segment to ids: a table of recent segments and the one before it, for texts that begin a run and for
        # segments without the space they begin with.
        self.recent: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self.older: dict[str, dict[str, bytes]] = {"": {}, " ": {}}

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct words.

        Sorted words are a trie in depth-first order: the lists below are the path from the root to the current
        node, cut back to the prefix that a word shares with the one before it.  Per depth they hold the last
        token, the depth in front of it, and the state of the suffix automaton.
        """
        voc = self.vocabulary
        step, known, ending, four = voc.step, voc.known, voc.ending, self.four
        last, front, state = [-1], [0], [0]
        before, out = b"", {}
        for text, word in sorted((w.encode("utf-8", "replace"), w) for w in words):
            shared, most = 0, min(len(before), len(text))
            while shared < most and before[shared] == text[shared]:
                shared += 1
            del last[shared + 1 :], front[shared + 1 :], state[shared + 1 :]
            at, depth = state[shared], shared
            for byte in text[shared:]:
                depth += 1
                to = step.get(at << 8 | byte)
                at = voc.follow(at, byte) if to is None else to
                for token, length in ending[at]:
                    ahead = depth - length
                    if not ahead:
                        break
                    fits = known.get(last[ahead] << 32 | token)
                    if fits or (fits is None and voc.compatible(last[ahead], token)):
                        break
                last.append(token)
                front.append(ahead)
                state.append(at)
            before, ids = text, []
            while depth:
                ids.append(four[last[depth]])
                depth = front[depth]
            out[word] = b"".join(ids[::-1])
        return out

    def _pieces(self, text: str) -> tuple[list[str], list[str]]:
        """Segments as they are, and segments without the space they begin with; the former come first."""
        if _SPACE_RUN.search(text):
            return _SEGMENTS.findall(text), []
        head, *rest = text.split(" ")
        return [head], rest

    def _learn(self, pieces: set[str], front: str) -> None:
        recent = self.recent[front]
        pieces.difference_update(recent)
        if len(recent) + len(pieces) > CACHE:
            self.older[front], recent = recent, {}
            self.recent[front] = recent
        older, found = self.older[front], {}
        for piece in pieces:
            ids = older.get(piece)
            if ids is None:
                found[piece] = self.words.findall(front + piece)
            else:
                recent[piece] = ids
        ids = self.encode_words({w for words in found.values() for w in words})
        for piece, words in found.items():
            recent[piece] = ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        parts = []
        for text in texts:
            strings = self.special is not None and any(s in text for s in self.vocabulary.special)
            parts.append(self.special.split(text) if strings else [text])
        special = self.vocabulary.special
        whole: set[str] = set()
        spaced: set[str] = set()
        for text in parts:
            for part in text:
                if part not in special:
                    heads, rest = self._pieces(part)
                    whole.update(heads)
                    spaced.update(rest)
        # A table cut back while learning may have lost what the batch needs, so both are kept to hand.
        have = {}
        for front, pieces in (("", whole), (" ", spaced)):
            old = self.recent[front]
            self._learn(set(pieces), front)
            have[front] = self.recent[front] if self.recent[front] is old else old | self.recent[front]
        out = []
        for text in parts:
            blobs = []
            for part in text:
                if part in special:
                    blobs.append(special[part].to_bytes(4, "little"))
                else:
                    heads, rest = self._pieces(part)
                    blobs += map(have[""].__getitem__, heads)
                    blobs += map(have[" "].__getitem__, rest)
            out.append(b"".join(blobs))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]


@lru_cache(maxsize=2)
def byte_table(path: str) -> dict[int, bytes]:
    """Bytes of each id; all that decoding needs."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    sign = _byte_of_sign()
    special = {t["id"]: t["content"].encode() for t in data["added_tokens"]}
    return {i: bytes(sign[c] for c in t) for t, i in data["model"]["vocab"].items() if i not in special} | special


def decoded(ids: list[int], table: dict[int, bytes]) -> str:
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    return Encoder(path)


def _id_lists(blobs: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(b) // 4 for b in blobs)], dtype=np.int32)
    values = np.frombuffer(b"".join(blobs), dtype="<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def encode(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of int) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for part in slices(batches, BATCH):
            blobs = own.encode_batch(part.column(1).to_pylist())
            counts = pa.array([len(b) // 4 for b in blobs], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), counts, _id_lists(blobs)], ["doc_id", "n_tokens", "ids"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(df: DataFrame, vocabulary: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``df`` and ``out`` with the decoded text; null ids give null."""

    @F.pandas_udf("string")
    def run(lists):
        import pandas as pd

        own = byte_table(vocabulary)
        return pd.Series([None if ids is None else decoded(ids.tolist(), own) for ids in lists], dtype=object)

    return df.withColumn(out, run(F.col(ids_col)))

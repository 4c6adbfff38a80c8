"""Order-preserving packing of documents into token windows by dynamic programming.

Documents are range-partitioned and sorted by id, so that order is kept and no task holds more
than its stretch. A task tokenises its documents and, for every `STRETCH` tokens, chooses the
cuts of the token stream. Cuts may fall at ends of documents (free), ends of sentences, or, in
long stretches without either, at any multiple of `GRID` tokens; each costs a penalty, each
window its padding. With P the cut positions, the least cost of a cut j is

    best[j] = min(best[i] + P[i] for i with P[j] - P[i] <= window) + window - P[j] + penalty[j]

and the minimum over the moving range of i is held in a monotone queue.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, END_ID = 2048, 1
STRETCH = 1 << 20  # tokens that are packed together; only its last window is filled less
GRID = 64
SENTENCE_PENALTY, HARD_PENALTY = 4, 40
CHUNK_CACHE, TOKEN_CACHE = 1_000_000, 8_000_000  # chunks and ids that a worker keeps
MEETING = re.compile(r"\s | \s")
SAFE = re.compile(r"(?<=\S) (?=\S)")
LINES = re.compile(r" ?\S+(?:\n\S+)*")
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481"  # characters that are letters in every version of Unicode
WORD = re.compile(f" ?[{LETTERS}]+")
MARKED = re.compile(f"(.*[{LETTERS}0-9])([.,!?;:]+)")


class Codes(dict):
    """Chunks by number, in the order of their first sight; `new` holds those not encoded yet."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        code = self[key] = len(self)
        self.new.append(key)
        return code


class Tokens:
    """Ids of texts as little-endian uint32 bytes.

    The byte-level pre-tokeniser never joins what stands before a single space with the character
    after it, so a text falls into chunks ` word` that are encoded each by itself and remembered. A
    chunk ` word` has the key `word`, one without the space (the first of a text) the key ` word`.
    New chunks fall further at line ends and before closing marks, where the pre-tokeniser parts
    them as well; a piece of letters alone is one of its words and goes straight to the merges.
    Vocabularies of another kind (`bytewise` is false) encode each text whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.names = [t.content for t in self.model.get_added_tokens_decoder().values()]
        cut = self.model.pre_tokenizer
        self.bytewise = isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space and self.model.normalizer is None and isinstance(self.model.model, models.BPE)
        self.merge = self.model.model.tokenize
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self._forget()

    def _forget(self) -> None:
        self.codes = Codes()
        self.first = self.size = np.empty(0, np.int64)  # where the ids of each code begin, and how many they are
        self.stop = np.empty(0, bool)  # whether it ends a sentence
        self.flat = np.empty(0, np.uint32)

    @staticmethod
    def _pieces(text: str) -> list[str]:
        """The keys of the pieces of a text that matches LINES."""
        out = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(" \n")
            marked = MARKED.fullmatch(line)
            out += [p[1:] if p[0] == " " else " " + p for p in (marked.groups() if marked else (line,))]
        return out

    def _learn(self) -> None:
        """Encodes the new chunks."""
        codes, known = self.codes, len(self.size)
        ids: list[list[int]] = []
        made: list[tuple[int, list[str]]] = []
        alone: list[int] = []
        for key in codes.new:  # grows by the pieces
            text = key[1:] if key[:1] == " " else " " + key
            ids.append([])
            if WORD.fullmatch(text):
                ids[-1] = [t.id for t in self.merge(text.encode().decode("latin-1").translate(self.letters))]
                continue
            pieces = self._pieces(text) if LINES.fullmatch(text) else []
            if len(pieces) > 1:
                made.append((len(ids) - 1, pieces))
                for p in pieces:
                    codes[p]
            elif text:
                alone.append(len(ids) - 1)
        for at in range(0, len(alone), 5000):
            part = [codes.new[i] for i in alone[at : at + 5000]]
            texts = [k[1:] if k[:1] == " " else " " + k for k in part]
            for i, x in zip(alone[at : at + 5000], self.model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids[i] = x.ids
        for i, pieces in made:
            for c in map(codes.__getitem__, pieces):
                ids[i] += ids[c - known] if c >= known else self.flat[self.first[c] : self.first[c] + self.size[c]].tolist()
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.stop = np.concatenate([self.stop, np.fromiter((k[-1:] in (".", "!", "?") for k in codes.new), bool, len(size))])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))])
        codes.new = []

    def many(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        """For each text its ids and the token positions after sentences; a text that holds the name of an added token is encoded whole, by the plain call, and is not cut at sentences."""
        named = [any(n in t for n in self.names) for t in texts]
        others = self._many([t for t, n in zip(texts, named, strict=True) if not n])
        for t, n in zip(texts, named, strict=True):
            yield (np.array(self.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), np.empty(0, np.int64)) if n else next(others)

    def _many(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        if not self.bytewise:
            for x in self.model.encode_batch_fast(texts, add_special_tokens=False):
                yield np.array(x.ids, "<u4").tobytes(), np.empty(0, np.int64)
            return
        if len(self.codes) > CHUNK_CACHE or len(self.flat) > TOKEN_CACHE:
            self._forget()
        chunks = [SAFE.split(t) if MEETING.search(t) else t.split(" ") for t in texts]
        for c in chunks:
            c[0] = " " + c[0]
        code = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(chunks)), np.int64, sum(map(len, chunks)))
        if self.codes.new:
            self._learn()
        size, stop = self.size[code], self.stop[code]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(size.sum()) + np.repeat(self.first[code] - (ends - size), size)].astype("<u4", copy=False)
        at, token = 0, 0
        for c in chunks:
            to = at + len(c)
            last = int(ends[to - 1])
            yield ids[token:last].tobytes(), ends[at:to][stop[at:to]] - token
            at, token = to, last


@lru_cache(maxsize=1)
def tokens_of(path: str) -> Tokens:
    """A worker's tokeniser: the tasks that it runs share what it remembers."""
    return Tokens(path)


def cuts(places: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """The positions to cut at, the last of `places` included; places rise from above 0 in steps of at most `window`."""
    best, pos, back = [0.0], [0, *places.tolist()], [0]
    queue: deque[int] = deque([0])
    for j, (p, cost) in enumerate(zip(places.tolist(), penalties.tolist(), strict=True), 1):
        while p - pos[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        best.append(best[i] + pos[i] + window - p + cost)
        back.append(i)
        value = best[j] + p
        while queue and best[queue[-1]] + pos[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    out, j = [], len(pos) - 1
    while j:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


def merged(*rising: np.ndarray) -> np.ndarray:
    """The different values of rising arrays, in order."""
    out = np.sort(np.concatenate(rising), kind="stable")
    return out[np.diff(out, prepend=-1) > 0]


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions with their penalties: ends of documents and sentences, and a grid where these are far apart."""
    places = merged(doc_ends, sentence_ends)
    gaps = np.diff(places, prepend=0)
    far = np.flatnonzero(gaps > 4 * GRID)
    grid = [np.arange(places[i] - gaps[i] + GRID, places[i], GRID) for i in far]
    every = merged(places, *grid)
    penalty = np.full(len(every), float(HARD_PENALTY))
    penalty[np.searchsorted(every, sentence_ends)] = SENTENCE_PENALTY
    penalty[np.searchsorted(every, doc_ends)] = 0
    return every, penalty


def _pack(path: str, window: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def stretch(held: list[tuple[int, bytes, np.ndarray]], first: int) -> tuple[pa.RecordBatch, int]:
        sizes = np.array([len(ids) >> 2 for _, ids, _ in held])
        ends = np.cumsum(sizes)
        stops = merged(*[e - n + s for (_, _, s), n, e in zip(held, sizes, ends, strict=True)])
        made, at, start, rows = cuts(*candidates(ends, stops[stops > 0]), window), 0, 0, []
        for (doc, ids, _), n, e in zip(held, sizes.tolist(), ends.tolist(), strict=True):
            done = 0
            while done < n:
                size = min(made[at], e) - (e - n + done)
                rows.append((doc, done, size, zlib.crc32(ids[4 * done : 4 * (done + size)]), n, first + at, e - n + done - start))
                done += size
                if e - n + done == made[at]:
                    start, at = made[at], at + 1
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]), first + at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, total, next_id = tokens_of(path), [], 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                texts = ["" if t is None else t for t in batch.column(1)[at : at + 200].to_pylist()]
                for doc, (ids, stops) in zip(batch.column(0)[at : at + 200].to_pylist(), tokens.many(texts), strict=True):
                    held.append((doc, ids + end, stops))
                    total += (len(ids) >> 2) + 1
                    if total >= STRETCH:
                        out, next_id = stretch(held, next_id)
                        held, total = [], 0
                        yield out
        if held:
            yield stretch(held, next_id)[0]

    return run


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece of each row of `docs` (doc_id, text).

    Windows keep the order of doc_id; each token, the end id after each document included, lies in
    exactly one piece. A null or empty text is the end id alone. Repeated rows are packed each by
    itself, an empty table gives no pieces, other columns are not read. `tokenizer`: a vocabulary file.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(_pack(tokenizer, window, end_id), kinds)

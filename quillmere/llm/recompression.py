"""Long repeats by recompression of word sequences.

Each round names runs of equal symbols, then pairs of a left and a right symbol, whose side is a
bit of their own name. A name is the hash of what it stands for, so all tasks give equal parts equal names
without a dictionary. Whether a symbol stands at a place depends on a few words around it, its
context; equal spans of words therefore hold the same symbols wherever the context lies inside.

Every window of `window` words is given to one symbol whose context it holds: of the highest
round, then of the smallest hash. The words of that context are the window's key, which is computed once and written
with the document. Chunks of documents ask by key, through buckets, which keys more than one document holds, in the same
chunk or in another; only documents with such a key are looked at again, and only their windows with one are
compared, by their own hashes, and the smallest doc_id of each is told to the chunks. The high
symbols thus reveal the repeats, within a chunk and between chunks, and the windows verify them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.chunks import CHUNK_BYTES, bucketed, chunked, joined, member_of, texts_of
from quillmere.llm.common import mixed, written

WINDOW, ROUNDS = 13, 2
BASE = np.uint64(0x9E3779B97F4A7C15)
NONE = np.uint64(2**64 - 1)
FAR = 1 << 40
HASHED = 1 << 20  # bytes whose words are hashed together
LAST_ID = 2**63 - 1  # what a null doc_id is compared as


def _round(name: np.ndarray, b: np.ndarray, e: np.ndarray, c0: np.ndarray, c1: np.ndarray, doc: np.ndarray, salt: int) -> tuple[np.ndarray, ...]:
    """Runs, then pairs: symbols with their words [b, e), context [c0, c1) and document."""
    n = len(name)
    new = np.ones(n, bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], n) - 1
    name, doc = mixed(name[head] * BASE + (tail - head).astype(np.uint64) + np.uint64(salt)), doc[head]
    b, e, own0, own1, end0, end1 = b[head], e[tail], c0[head], c1[tail], c0[tail], c1[head]
    same = doc[1:] == doc[:-1]  # with the next
    c0, c1 = own0.copy(), own1.copy()
    # of the runs beside it only the nearest symbol: how far they go is not known from within the context
    c0[1:] = np.where(same, np.minimum(own0[1:], end0[:-1]), -FAR)
    c1[:-1] = np.where(same, np.maximum(own1[:-1], end1[1:]), FAR)
    c0[:1], c1[-1:] = -FAR, FAR
    left = (mixed(name + np.uint64(salt)) & np.uint64(1)).astype(bool)
    pair = np.append(left[:-1] & ~left[1:] & same, False)  # this one and the next
    second = np.append(False, pair[:-1])
    alone = ~pair & ~second
    with_next = np.append(same, False)
    n0, n1 = c0.copy(), c1.copy()
    # a left symbol alone depends on its next, a right one on that before
    n1[:-1] = np.where(alone[:-1] & left[:-1], np.where(with_next[:-1], np.maximum(c1[:-1], c1[1:]), FAR), n1[:-1])
    n1[-1:] = np.where(alone[-1:] & left[-1:], FAR, n1[-1:])
    n0[1:] = np.where(alone[1:] & ~left[1:], np.where(same, np.minimum(c0[1:], c0[:-1]), -FAR), n0[1:])
    n0[:1] = np.where(alone[:1] & ~left[:1], -FAR, n0[:1])
    at = np.flatnonzero(pair)
    n0[at], n1[at] = np.minimum(c0[at], c0[at + 1]), np.maximum(c1[at], c1[at + 1])
    e = e.copy()
    e[at] = e[at + 1]
    name = name.copy()
    name[at] = mixed(name[at] * BASE + name[at + 1])
    stay = ~second
    return name[stay], b[stay], e[stay], n0[stay], n1[stay], doc[stay]


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n; kept for the next chunk."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            _powers[k] = np.ones(2 * n + 1, np.uint64)
            np.multiply.accumulate(np.full(2 * n, base, np.uint64), out=_powers[k][1:])
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after the other, and how many each text has."""
    out, sizes, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= HASHED):
            held += len(texts[to]) + 1
            to += 1
        b = np.frombuffer(b" ".join(texts[at:to]) + b" ", np.uint8)
        word = ~((b == 32) | ((b >= 9) & (b <= 13)))
        edge = np.flatnonzero(np.diff(word, prepend=False))
        start, stop = edge[::2], edge[1::2]
        up, down = powers(len(b))
        prefix = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=prefix[1:])
        out.append(mixed((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(np.uint64)))
        ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
        sizes.append(np.diff(np.searchsorted(start, ends), prepend=0))
        at = to
    return np.concatenate(out), np.concatenate(sizes)


class Windows:
    """The windows of a chunk's documents: hashes, starts, documents (by place), and on demand keys."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        self.window = window
        h, self.sizes = word_hashes(texts)
        self.ends = np.cumsum(self.sizes)
        self.h, self.doc = h, np.repeat(np.arange(len(texts)), self.sizes)
        starts = np.arange(len(h))
        self.starts = starts[starts + window <= self.ends[self.doc]] if len(h) else starts
        self.of = self.doc[self.starts] if len(h) else self.doc

    def hashes(self) -> np.ndarray:
        """The hash of each window."""
        acc = np.zeros(max(0, len(self.h) - self.window + 1), np.uint64)
        for j in range(self.window if len(acc) else 0):
            acc *= BASE
            acc += self.h[j : j + len(acc)]
        return mixed(acc)[self.starts] if len(acc) else acc

    def keys(self) -> np.ndarray:
        """The key of each window."""
        n, w = len(self.h), self.window
        if not len(self.starts):
            return np.empty(0, np.uint64)
        prefix = np.zeros(n + 1, np.uint64)
        power, back = powers(n)
        np.cumsum(self.h * power[:n], out=prefix[1:])
        owner, of_key = np.full(n, NONE), np.zeros(n, np.uint64)
        place = np.arange(n)
        symbols = (self.h, place, place + 1, place, place + 1, self.doc)
        levels = [symbols]
        for r in range(ROUNDS):
            symbols = _round(*symbols, salt=r + 1)
            levels.append(symbols)
        free = np.zeros(n, bool)
        free[self.starts] = True
        for _, _, _, c0, c1, _ in reversed(levels):
            fit = np.flatnonzero((c0 > -FAR) & (c1 < FAR) & (c1 - c0 <= w))
            until = np.append(0, np.cumsum(free))  # free windows before each place
            fit = fit[until[c0[fit] + 1] > until[np.maximum(c1[fit] - w, 0)]]
            c0, c1 = c0[fit], c1[fit]
            if not len(fit):
                continue
            key = mixed((prefix[c1] - prefix[c0]) * back[c0] + (c1 - c0).astype(np.uint64))
            packed = (mixed(key) & ~np.uint64((1 << 28) - 1)) | np.arange(len(fit), dtype=np.uint64)
            for j in range(w):
                s = c0 - j
                good = (s >= c1 - w) & (s >= 0)
                s, value = s[good], packed[good]
                open_ = free[s]
                np.minimum.at(owner, s[open_], value[open_])
            got = np.flatnonzero(free & (owner != NONE))
            of_key[got] = key[(owner[got] & np.uint64((1 << 28) - 1)).astype(np.int64)]
            free[got] = False
            owner[got] = NONE
            if not free.any():
                break
        return of_key[self.starts]


RUN = np.dtype([("low", "<u4"), ("high", "<u2"), ("n", "u1")])  # so many windows (or documents), one after the other, of one key, of which 48 bits are kept: keys that chance makes equal are told apart by the windows
MOST_RUN = 255


def _packed(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    made = np.zeros(len(keys), RUN)
    made["low"], made["high"], made["n"] = (keys >> np.uint64(16)) & np.uint64(0xFFFFFFFF), keys >> np.uint64(48), n
    return made


def _keys(runs: np.ndarray) -> np.ndarray:
    """The keys of runs, the lowest 16 bits zero."""
    return (runs["high"].astype(np.uint64) << np.uint64(48)) | (runs["low"].astype(np.uint64) << np.uint64(16))


def _marks(window: int):
    """The keys of each text's windows, in runs."""

    def run(texts: list[bytes]) -> list[list[bytes]]:
        w = Windows(texts, window)
        keys, each = w.keys(), np.bincount(w.of, minlength=len(texts))
        ends = np.cumsum(each)
        new = np.append(True, (keys[1:] != keys[:-1]) | (w.of[1:] != w.of[:-1])) if len(keys) else np.empty(0, bool)
        head = np.flatnonzero(new)
        if len(head):
            new |= (np.arange(len(keys)) - head[np.cumsum(new) - 1]) % MOST_RUN == 0  # longer runs are several
            head = np.flatnonzero(new)
        made = _packed(keys[head], np.diff(np.append(head, len(keys))))
        cut = np.searchsorted(head, np.append(0, ends)).tolist()
        return [[made[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]]

    return run


def _runs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(runs, document by place) of a chunk."""
    marks = table["m"].to_pylist()
    return joined(marks, RUN), np.repeat(np.arange(len(marks)), [len(m) // RUN.itemsize for m in marks])


def _ids(table: pa.Table) -> np.ndarray:
    """The documents' ids to compare; never floats, as a column with nulls would become."""
    return table["doc_id"].cast(pa.int64()).fill_null(LAST_ID).to_numpy()


def _ask_keys(buckets: int):
    """Each key of a chunk, and whether one (n = 1) or more documents of it hold it."""

    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        runs, doc = _runs(table)
        keys, docs = _keys(runs), _ids(table)[doc]
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.empty(0, bool)
        head = np.flatnonzero(new)
        other = (new | np.append(True, docs[1:] != docs[:-1])).astype(np.int64) if len(head) else np.empty(0, np.int64)
        held = _packed(keys[head], np.minimum(np.add.reduceat(other, head), 2) if len(head) else other)
        parts = bucketed(keys[head], buckets)
        return pa.table({"bucket": pa.array([i for i, _ in parts], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(parts), pa.int32()), "keys": pa.array([held[s].tobytes() for _, s in parts], pa.binary())})

    return run


def _shared_keys(table: pa.Table) -> pa.Table:
    """To each chunk those of its keys that more than one document holds."""
    sent = [np.frombuffer(k, RUN) for k in table["keys"].to_pylist()]
    keys = [_keys(s) for s in sent]
    values, where = np.unique(np.concatenate(keys), return_inverse=True)
    shared = values[np.bincount(where, weights=np.concatenate([s["n"] for s in sent])) > 1]
    back = [k[member_of(k, shared)] for k in keys]
    some = [i for i, x in enumerate(back) if len(x)]
    return pa.table({"chunk": table["chunk"].combine_chunks().take(pa.array(some, pa.int64())), "keys": pa.array([back[i].tobytes() for i in some], pa.binary())})


def _candidates(table: pa.Table, answers: pa.Table, window: int) -> tuple[np.ndarray, Windows, np.ndarray]:
    """The documents of a chunk (by place) in which a shared symbol stands, their windows, and which of these have one. No others are looked at."""
    runs, doc = _runs(table)
    shared = member_of(_keys(runs), np.sort(joined(answers["keys"].to_pylist(), np.uint64)))
    docs = np.unique(doc[shared])
    texts = texts_of(table.take(pa.array(docs))) if len(docs) else []
    mine = np.isin(doc, docs)
    return docs, Windows(texts, window), np.repeat(shared[mine], runs["n"][mine])


def _ask_windows(window: int, buckets: int):
    def run(key: tuple[pa.Scalar], table: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows or not table.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "firsts": pa.array([], pa.binary())})
        docs, w, ask = _candidates(table, answers, window)
        values, first = _firsts(w.hashes()[ask], _ids(table)[docs][w.of[ask]])
        parts = bucketed(values, buckets)
        return pa.table({"bucket": pa.array([i for i, _ in parts], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(parts), pa.int32()), "keys": pa.array([values[s].tobytes() for _, s in parts], pa.binary()), "firsts": pa.array([first[s].tobytes() for _, s in parts], pa.binary())})

    return run


def _firsts(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, with the smallest document of each."""
    order = np.argsort(hashes)
    sorted_, docs = hashes[order], docs[order]
    head = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.empty(0, np.int64)
    return sorted_[head], np.minimum.reduceat(docs, head) if len(head) else docs


def _earlier(table: pa.Table) -> pa.Table:
    """To each chunk the windows that a smaller document of another chunk holds."""
    sent = [(np.frombuffer(k, np.uint64), np.frombuffer(f, np.int64)) for k, f in zip(table["keys"].to_pylist(), table["firsts"].to_pylist(), strict=True)]
    values, first = _firsts(np.concatenate([k for k, _ in sent]), np.concatenate([f for _, f in sent]))
    back = [k[first[np.searchsorted(values, k)] < f] for k, f in sent]
    some = [i for i, x in enumerate(back) if len(x)]
    return pa.table({"chunk": table["chunk"].combine_chunks().take(pa.array(some, pa.int64())), "keys": pa.array([back[i].tobytes() for i in some], pa.binary())})


def _keep(window: int, texts: bool):
    def run(key: tuple[pa.Scalar], table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, removed = _ids(table), {}
        mine = answers.filter(pa.compute.is_valid(answers["shared"])).select(["shared"]).rename_columns(["keys"])
        if mine.num_rows and table.num_rows:
            earlier = np.sort(joined([k for k in answers["earlier"].to_pylist() if k], np.uint64))
            docs, w, ask = _candidates(table, mine, window)
            hashes, starts, of = w.hashes()[ask], w.starts[ask], ids[docs][w.of[ask]]
            values, first = _firsts(hashes, of)
            gone = member_of(hashes, earlier)
            if len(values):
                gone |= of > first[np.searchsorted(values, hashes)]
            cover = np.zeros(len(w.h) + 1, np.int32)
            np.add.at(cover, starts[gone], 1)
            np.add.at(cover, starts[gone] + window, -1)
            cut = np.cumsum(cover[:-1]) > 0
            removed = {int(d): c for d, c in zip(docs, np.split(cut, w.ends[:-1]), strict=True)} if len(docs) else {}
        rows = []
        for i, (source, doc) in enumerate(zip(texts_of(table), table["doc_id"].to_pylist(), strict=True)):
            words, cut = source.split(), removed.get(i)
            kept = words if cut is None or not cut.any() else [x for x, r in zip(words, cut.tolist(), strict=True) if not r]
            rows.append((doc, len(words), len(words) - len(kept), b" ".join(kept)))
        doc, n, cut, text = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(cut, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in text], pa.string()), "kept_text": pa.array([t.decode() if texts else None for t in text], pa.string())})

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of each row of docs (doc_id, text), without the words in windows that a document of a smaller id holds as well.

    Words are what \\x20 and \\x09-\\x0D part; null and empty texts have none, texts of fewer words than a window lose none. Rows
    with one doc_id do not remove from each other; a null doc_id comes after all others (as one with the largest long) and stays null; an empty table gives none; other columns are not read.
    """
    rows, buckets = chunked(docs, chunk_bytes, _marks(window), ("m",))
    asked = rows.select("chunk", "doc_id", "m").groupBy("chunk").applyInArrow(_ask_keys(buckets), "bucket int, chunk int, keys binary")
    shared = written(asked.groupBy("bucket").applyInArrow(_shared_keys, "chunk int, keys binary"), "shared-keys")
    entries = rows.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_ask_windows(window, buckets), "bucket int, chunk int, keys binary, firsts binary")
    earlier = written(entries.groupBy("bucket").applyInArrow(_earlier, "chunk int, keys binary"), "earlier-windows")
    none = F.lit(None).cast("binary")
    answers = shared.select("chunk", F.col("keys").alias("shared"), none.alias("earlier")).union(earlier.select("chunk", none, F.col("keys")))
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_keep(window, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if texts else out.drop("kept_text")

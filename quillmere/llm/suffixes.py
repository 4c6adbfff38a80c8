"""Exact removal of repeated byte strings by column-wise suffix sorting of many pieces.

Every window of `window` bytes belongs to one anchor, the leftmost smallest hash among its runs of
GRAM bytes; the windows of one anchor are consecutive, and the bytes they cover are a piece. Equal
windows have equal anchors at equal distances, so only pieces with the same anchor hold them.

1. Each document's pieces are marked once and written with it. Chunks of documents ask, through buckets, which pieces other places hold too. Equal pieces need
   no more: all their windows repeat. Of an anchor with different pieces one copy of each is sent on.
2. These pieces are laid side by side, their anchors in one column, and sorted from the last
   column to the first: each round inserts one symbol of each piece, by which the order of the
   suffixes (their transform) and the common prefixes of neighbours are brought up to date. A
   window that a piece owns repeats if its suffix shares `window` bytes with a neighbour. The
   pieces come in a sorted stream and are taken in bounded batches of whole anchors.
3. An anchor with more than `most_pieces` different pieces is not put into one batch: its windows
   are compared by their own 128-bit hashes, which is exact too.
4. The chunks remove what is covered.

All of it can be done for a second, shorter window at once, whose repeats are only counted: a passage of
some fifty words often has fewer bytes than the window that is removed.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.chunks import CHUNK_BYTES, bucketed, chunked, joined, texts_of
from quillmere.llm.common import mixed, written

WINDOW, GRAM = 400, 32
BATCH_BYTES = 16 << 20  # pieces that are sorted together, at most (a single anchor's may be more, up to MOST_PIECES)
MOST_PIECES = 20_000
PLACE = np.uint64((1 << 24) - 1)
SEGMENT = 1 << 23  # bytes whose windows are looked at together, so that a place fits 24 bits


def _run_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM bytes, by doubling."""
    h, base, width = b.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(base) + h[width:]
        base = base * base % (1 << 64)
        width *= 2
    return mixed(h)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of `width` values."""
    have = 1
    while have < width:
        more = min(have, width - have)
        x = np.minimum(x[:-more], x[more:])
        have += more
    return x


def anchors(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first, last): for each anchor its hash, where it starts, and the starts of its first and last window."""
    b, out = np.frombuffer(text, np.uint8), []
    for at in range(0, len(b) - window + 1, SEGMENT):
        h = _run_hashes(b[at : at + SEGMENT + window - 1])
        packed = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        own = _least(packed, window - GRAM + 1)
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        place = (own[head] & PLACE).astype(np.int64)
        out.append((h[place], place + at, head + at, np.append(head[1:], len(own)) - 1 + at))
    if not out:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


MARK = np.dtype([("key", "<u8"), ("id", "<u8"), ("owned", "<u2"), ("at", "<u2")])  # a piece: its anchor's hash, mixed; its own; windows it owns; where its anchor is in it
PIECE = np.dtype([("key", "<u8"), ("id", "<u8"), ("n", "u1")])


def _marks(windows: tuple[int, ...]):
    """For each window size, the pieces of each text."""

    def run(texts: list[bytes]) -> list[list[bytes]]:
        out: list[list[bytes]] = [[] for _ in windows]
        for text in texts:
            view = memoryview(text)
            for which, window in enumerate(windows):
                key, place, first, last = anchors(text, window)
                made = np.zeros(len(key), MARK)
                if len(key):
                    at = place - first
                    # a key is the least of many hashes; mixed, which parts no equal ones, keys spread over all buckets
                    made["key"], made["owned"], made["at"] = mixed(key + np.uint64(which)), last - first + 1, at
                    made["id"] = made["key"] ^ np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + window], seed=o) for o, a, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)), np.uint64, len(key))
                out[which].append(made.tobytes())
        return out

    return run


def _pieces(marks: list[bytes]) -> tuple[np.ndarray, ...]:
    """(marks, document by place, first window) of all pieces; those of a document own its windows one after the other."""
    held, sizes = joined(marks, MARK), np.array([len(m) // MARK.itemsize for m in marks], np.int64)
    doc = np.repeat(np.arange(len(marks)), sizes)
    ends = np.cumsum(held["owned"].astype(np.int64))
    first = ends - held["owned"]
    heads = np.cumsum(sizes) - sizes
    some = sizes > 0
    start = np.zeros(len(marks), np.int64)
    start[some] = first[heads[some]]
    return held, doc, first - start[doc] if len(held) else first


def _ask(which: int, buckets: int):
    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        marks = joined(table[f"m{which}"].to_pylist(), MARK)
        marks = marks[np.lexsort((marks["id"], marks["key"]))]
        head = np.flatnonzero(np.append(True, (marks["id"][1:] != marks["id"][:-1]) | (marks["key"][1:] != marks["key"][:-1]))) if len(marks) else np.empty(0, np.int64)
        held = np.zeros(len(head), PIECE)
        held["key"], held["id"], held["n"] = marks["key"][head], marks["id"][head], np.minimum(np.diff(np.append(head, len(marks))), 2)
        parts = bucketed(held["key"], buckets)
        return pa.table({"bucket": pa.array([i for i, _ in parts], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(parts), pa.int32()), "held": pa.array([held[s].tobytes() for _, s in parts], pa.binary())})

    return run


def _answer(most_pieces: int):
    """To each chunk, of its pieces: 1 if another place has it too, 2 if this chunk sends its bytes, 4 if it sends its windows' hashes instead."""

    def run(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(h, PIECE) for h in table["held"].to_pylist()]
        chunk = np.repeat(table["chunk"].to_numpy(), [len(s) for s in sent])
        every = np.concatenate(sent)
        order = np.lexsort((chunk, every["id"], every["key"]))
        every, chunk = every[order], chunk[order]
        new_key = np.append(True, every["key"][1:] != every["key"][:-1])
        new = new_key | np.append(True, every["id"][1:] != every["id"][:-1])
        head = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        total = np.add.reduceat(every["n"].astype(np.int64), head)
        key_of_piece = np.cumsum(new_key)[head] - 1
        different = np.bincount(key_of_piece)[key_of_piece]
        told = np.where(total > 1, 1, 0)[of] + np.where(new & (different > 1)[of], np.where(different > most_pieces, 4, 2)[of], 0)
        some = told > 0
        out = np.zeros(int(some.sum()), PIECE)
        out["key"], out["id"], out["n"] = every["key"][some], every["id"][some], told[some]
        to = chunk[some]
        order = np.argsort(to, kind="stable")
        out, to = out[order], to[order]
        head = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.empty(0, np.int64)
        ends = np.append(head[1:], len(to))
        which = table["which"][0].as_py() if table.num_rows else 0
        return pa.table({"which": pa.array([which] * len(head), pa.int32()), "chunk": pa.array(to[head], pa.int32()), "told": pa.array([out[a:b].tobytes() for a, b in zip(head.tolist(), ends.tolist(), strict=True)], pa.binary())})

    return run


def _told(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pieces and what was told of them."""
    told = joined(answers["told"].to_pylist(), PIECE)
    order = np.argsort(told["id"])
    return told["id"][order], told["n"][order]


def _look(ids: np.ndarray, known: np.ndarray, what: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(ids), np.uint8)
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    return np.where(known[at] == ids, what[at], 0)


SENT = "which int, key long, id long, chunk int, anchor int, owned int, whole boolean, bytes binary, hash binary"


def _send(windows: tuple[int, ...]):
    def run(key: tuple[pa.Scalar], table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        packed, open_ = table["z"], zstandard.ZstdDecompressor().decompress
        for which, window in enumerate(windows):
            known, what = _told(answers.filter(pa.compute.equal(answers["which"], which)))
            if not table.num_rows or not (what > 1).any():
                continue
            marks, doc, first = _pieces(table[f"m{which}"].to_pylist())
            ids = marks["id"]
            told = _look(ids, known, what)
            chosen = np.flatnonzero(told > 1)
            chosen = chosen[np.unique(ids[chosen], return_index=True)[1]]
            chosen = chosen[np.argsort(doc[chosen], kind="stable")]
            now, text = -1, b""
            for i in chosen.tolist():
                if doc[i] != now:
                    now = int(doc[i])
                    text = open_(packed[now].as_py())
                a, owned, at = int(first[i]), int(marks["owned"][i]), int(marks["at"][i])
                head = (which, int(marks["key"][i].view(np.int64)), int(ids[i].view(np.int64)), key[0].as_py())
                if told[i] & 2:
                    rows.append((*head, at, owned, bool(told[i] & 1), text[a : a + owned - 1 + window], None))
                else:
                    rows += [(*head, s, 1, bool(told[i] & 1), None, xxhash.xxh3_128_digest(text[a + s : a + s + window])) for s in range(owned)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("which", "key", "id", "chunk", "anchor", "owned", "whole", "bytes", "hash"), cols, kinds, strict=True)})

    return run


def column_sort(pieces: list[bytes], group: np.ndarray, anchor: np.ndarray, owned: np.ndarray, window: int) -> list[np.ndarray]:
    """For each piece the windows it owns (0 is the first) that another piece of its group holds at the same distance from the anchor.

    Round by round, from the last column to the first, one symbol of each piece goes in: pieces keep the order of
    their suffixes within their group, `common` the bytes that each shares with the one before.
    """
    n, size = len(pieces), np.array([len(p) for p in pieces])
    wide = int(anchor.max()) + int((size - anchor).max())
    table = np.zeros((wide, n), np.uint16)  # a row for each column, 0 where a piece has no byte
    shift = anchor.max() - anchor
    for i, p in enumerate(pieces):
        table[shift[i] : shift[i] + size[i], i] = np.frombuffer(p, np.uint8)
        table[shift[i] : shift[i] + size[i], i] += 1
    order, common = np.argsort(group, kind="stable"), np.zeros(n + 1, np.int64)
    group = group.astype(np.int64) * 257
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(wide - 1, -1, -1):
        symbol = table[c][order]
        at = group[order] + symbol
        move = np.argsort(at, kind="stable")
        at = at[move]
        same = np.append(False, (at[1:] == at[:-1]) & (symbol[move][1:] > 0))
        fresh = np.zeros(n + 1, np.int64)
        pairs = np.flatnonzero(same)
        if len(pairs):
            low, high = move[pairs - 1], move[pairs]
            next_to = high - low == 1
            least = common[high]
            far = np.flatnonzero(~next_to)
            if len(far):
                span = np.stack([low[far] + 1, high[far] + 1], axis=1).ravel()
                least[far] = np.minimum.reduceat(common, span)[::2]
            fresh[pairs] = least + 1
        order, common = order[move], fresh
        long = np.maximum(common[:-1], common[1:]) >= window
        if long.any():
            who = order[long]
            start = c - shift[who]
            good = (start >= 0) & (start < owned[who])
            found.append((who[good], start[good]))
    who = np.concatenate([np.empty(0, np.int64), *[w for w, _ in found]])
    start = np.concatenate([np.empty(0, np.int64), *[s for _, s in found]])
    by = np.argsort(who, kind="stable")
    bounds = np.searchsorted(who[by], np.arange(n + 1))
    return [np.sort(start[by[a:b]]) for a, b in zip(bounds, bounds[1:], strict=False)]


def _sort(windows: tuple[int, ...]):
    """Batches of whole groups out of a stream that is sorted by window size and key; what is told goes to the chunk that sent the piece."""

    def settle(held: list[dict]) -> pa.RecordBatch | None:
        if not held:
            return None
        which = held[0]["which"]
        _, group = np.unique(np.array([r["key"] for r in held]), return_inverse=True)
        starts = column_sort([r["bytes"] for r in held], group, np.array([r["anchor"] for r in held]), np.array([r["owned"] for r in held]), windows[which])
        some = [i for i, s in enumerate(starts) if len(s) and not held[i]["whole"]]
        cols = [pa.array([which] * len(some), pa.int32()), pa.array([held[i]["chunk"] for i in some], pa.int32()), pa.array([held[i]["id"] for i in some], pa.int64()), pa.array([starts[i].astype(np.int32).tobytes() for i in some], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["which", "chunk", "id", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["which"] != held[-1]["which"] or weight >= BATCH_BYTES and row["key"] != held[-1]["key"]):
                    if (out := settle(held)) is not None:
                        yield out
                    held, weight = [], 0
                held.append(row)
                weight += 2 * len(row["bytes"])
        if (out := settle(held)) is not None:
            yield out

    return run


def _covered(marks: list[bytes], sizes: list[int], answers: pa.Table, window: int) -> list[np.ndarray | None]:
    """For each document which of its bytes a repeated window covers; None where none does."""
    known, what = _told(answers.filter(pa.compute.is_valid(answers["told"])))
    held, doc, first = _pieces(marks)
    ids = held["id"]
    whole = (_look(ids, known, what) & 1) > 0
    some = answers.filter(pa.compute.is_valid(answers["starts"]))
    partly: dict[int, list[np.ndarray]] = {}
    for i, s in zip(some["id"].to_pylist(), some["starts"].to_pylist(), strict=True):
        partly.setdefault(i, []).append(np.frombuffer(s, np.int32))
    spans: list[list[np.ndarray]] = [[] for _ in marks]
    for i in np.flatnonzero(whole).tolist():
        spans[int(doc[i])].append(np.array([[first[i], first[i] + held["owned"][i] - 1]], np.int64))
    if partly:
        for i in np.flatnonzero(~whole & np.isin(ids.view(np.int64), np.array(list(partly), np.int64))).tolist():
            for s in partly[int(ids[i].view(np.int64))]:
                spans[int(doc[i])].append((s.astype(np.int64) + first[i])[:, None].repeat(2, axis=1))
    out: list[np.ndarray | None] = []
    for size, found in zip(sizes, spans, strict=True):
        if not found:
            out.append(None)
            continue
        edge, at = np.zeros(size + 1, np.int32), np.concatenate(found)
        np.add.at(edge, at[:, 0], 1)
        np.add.at(edge, at[:, 1] + window, -1)
        out.append(np.cumsum(edge[:-1]) > 0)
    return out


def _cut(windows: tuple[int, ...], texts: bool):
    def run(key: tuple[pa.Scalar], table: pa.Table, answers: pa.Table) -> pa.Table:
        sources = texts_of(table)
        sizes = [len(t) for t in sources]
        gone, *shorter = [_covered(table[f"m{which}"].to_pylist(), sizes, answers.filter(pa.compute.equal(answers["which"], which)), window) for which, window in enumerate(windows)]
        rows = []
        for i, (name, text) in enumerate(zip(table["doc_id"].to_pylist(), sources, strict=True)):
            cut, kept, spans = gone[i], text, 0
            if cut is not None:
                kept, spans = np.frombuffer(text, np.uint8)[~cut].tobytes(), int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum())
            again = [0 if s[i] is None else int(s[i].sum()) for s in shorter] or [None]
            rows.append((name, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), again[0], kept if texts else None))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "kept"), cols, kinds, strict=True)})

    return run


def without_repeated_bytes(docs: DataFrame, window: int = WINDOW, shorter: int | None = None, chunk_bytes: int = CHUNK_BYTES, most_pieces: int = MOST_PIECES, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs (doc_id, text), without the bytes of `window`-byte strings that start anywhere else too.

    shorter: also n_repeated, the bytes that strings of so many bytes cover which start anywhere else too; these are told
    and stay. texts: also `kept`, the bytes that are left (a cut may fall inside a character, so they are no string).

    Null and empty texts have no bytes; texts shorter than a window lose none; of long texts SEGMENT bytes at a time are
    looked at, with all windows across the seams. Of repeated rows each is an occurrence, so both lose what they share; so
    it is for rows of one doc_id or of a null one, which stays null. An empty table gives none; other columns are not read. Windows are over GRAM and below 65,536 bytes.
    """
    windows = (window,) if shorter is None else (window, shorter)
    each = range(len(windows))
    rows, buckets = chunked(docs, chunk_bytes, _marks(windows), tuple(f"m{w}" for w in each))

    asked = functools.reduce(DataFrame.union, [rows.select("chunk", f"m{w}").groupBy("chunk").applyInArrow(_ask(w, buckets), "bucket int, chunk int, held binary").withColumn("which", F.lit(w)) for w in each])
    told = written(asked.groupBy("which", "bucket").applyInArrow(_answer(most_pieces), "which int, chunk int, told binary"), "told-pieces")
    sent = rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_send(windows), SENT)
    sent = written(sent, "sent-pieces")
    bytes_ = sent.filter("bytes is not null").select("which", "key", "id", "chunk", "anchor", "owned", "whole", "bytes")
    found = bytes_.repartition("key").sortWithinPartitions("which", "key").mapInArrow(_sort(windows), "which int, chunk int, id long, starts binary")
    single = sent.filter("hash is not null")
    again = single.groupBy("which", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("which", "hash")
    single = single.filter("not whole").join(again, ["which", "hash"]).groupBy("which", "chunk", "id").agg(F.collect_set("anchor").alias("places"))
    single = single.mapInArrow(_packed, "which int, chunk int, id long, starts binary")
    found = written(found.union(single), "found-windows")
    answers = told.selectExpr("which", "chunk", "told", "cast(null as bigint) as id", "cast(null as binary) as starts").union(found.selectExpr("which", "chunk", "cast(null as binary)", "id", "starts"))
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut(windows, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, kept binary")
    return out.drop(*[c for c, wanted in (("n_repeated", shorter is not None), ("kept", texts)) if not wanted])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts = [np.array(x, np.int32).tobytes() for x in batch.column("places").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("which"), batch.column("chunk"), batch.column("id"), pa.array(starts, pa.binary())], ["which", "chunk", "id", "starts"])

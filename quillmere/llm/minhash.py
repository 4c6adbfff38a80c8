"""MinHash near-duplicates: banded candidates, odd sketches, exact confirmation, components.

A document's set holds its distinct word shingles. Two documents are linked if the Jaccard
similarity of their sets is at least `threshold`; components are those of the link graph.

1. One Arrow pass gives each document its set size, a 128-bit digest of its set, `bands` band
   keys and an odd sketch. Equal sets form a class, and only its first document goes on.
2. Documents that share a band key form a bucket. Each bucket compares its members with one
   pivot, its smallest id, never all pairs. The odd sketches (MinHash samples folded into a
   parity bitmap; the population count of the XOR grows with the samples that differ) drop
   pairs that are clearly below `near`; the others are computed on the full sets.
3. Members within `near` of a pivot differ from it by a small symmetric difference D, and
   x ^ y = D(x) ^ D(y): so members of one pivot's neighbourhood are compared with one another
   exactly by these small sets, in blocks, and only a spanning forest of links leaves the task.
   Who is linked with the pivot (distance <= 1 - threshold) can have no link with who is
   outside its neighbourhood (triangle inequality, near <= 2 * threshold - 1), so a bucket goes
   into another round only with those outside and the unlinked ones.
4. What PIVOT_ROUNDS rounds leave of a bucket are documents far from all its pivots. Their odd
   sketches are compared with one another in blocks, and the pairs that may reach the threshold
   are computed on the full sets.
5. Components: labels fall to the smallest neighbour and along their own pointers.

The only chance left is that no band of a linked pair agrees: (1 - threshold**rows)**bands,
5e-7 at the threshold itself for the defaults.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import WordHashes, gram_hashes, mixed, written, written_by

BANDS, ROWS, SKETCH_BITS = 48, 6, 1024
PIVOT_ROUNDS = 3
BLOCK = 1500  # members of a pivot's neighbourhood that one task compares with as many others


def shingle_set(words: np.ndarray, ngram: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, no words none."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(words, min(ngram, len(words))) + np.uint64(ngram - min(ngram, len(words))))


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []  # bytes: only A-Z change, and only \x20 and \x09-\x0D part words


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of 64-bit hashes."""
    x, out = (values >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(x), 1024):
        part = (np.multiply.outer(a, x[at : at + 1024]) + b[:, None]).min(axis=1)
        out = part if out is None else np.minimum(out, part)
    return out


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps of rows of MinHash samples, as 64-bit words: sample i flips the bit that (i, value) hashes to."""
    n, k = samples.shape
    at = mixed(samples.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    at += np.arange(n, dtype=np.uint64)[:, None] * np.uint64(bits)
    odd = (np.bincount(at.ravel().astype(np.int64), minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.int64)


def sketch_cut(threshold: float, samples: int, bits: int) -> int:
    """The population count that two sketches of similarity `threshold` exceed only by five deviations."""
    differ = 2 * samples * (1 - threshold)
    mean = bits * (1 - (1 - 2 / bits) ** differ) / 2
    spread = 2 * np.sqrt(samples * threshold * (1 - threshold)) * (1 - 2 / bits) ** differ
    return int(np.ceil(mean + 5 * np.sqrt(spread**2 + mean / 2)))


def _signatures(ngram: int, bands: int, rows: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, (a, b) = WordHashes(), _family(bands * rows)
        band = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, len(texts), 500):
                ids, rids = batch.column(0)[at : at + 500], batch.column(2)[at : at + 500]
                sets = [shingle_set(cache.of(_words(t.as_py())), ngram) for t in texts[at : at + 500]]
                size = np.array([len(s) for s in sets])
                one = np.array([s.sum(dtype=np.uint64) for s in sets]).view(np.int64)
                two = np.array([mixed(s).sum(dtype=np.uint64) for s in sets]).view(np.int64)
                some = np.flatnonzero(size)
                keys, sketch = [None] * len(sets), [None] * len(sets)
                if len(some):
                    low = np.stack([minima(sets[i], a, b) for i in some])
                    parts, fold = low.reshape(len(some), bands, rows).astype(np.uint64), np.zeros((len(some), bands), np.uint64)
                    for r in range(rows):
                        fold = mixed(fold + parts[:, :, r])
                    fold, odd = mixed(fold ^ band).view(np.int64), odd_sketch(low, bits)
                    for row, i in enumerate(some):
                        keys[i], sketch[i] = fold[row], odd[row]
                yield pa.RecordBatch.from_arrays(
                    [ids, rids, pa.array(size, pa.int64()), pa.array(one), pa.array(two), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                    ["doc_id", "rid", "n_shingles", "set_a", "set_b", "keys", "sketch"],
                )

    return run


def _compare(ngram: int, near: float, threshold: float):
    """(doc, pivot, text, pivot_text) to (doc, pivot, n, pivot_n, linked, near, diff); rows of one pivot come together where the join left them so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last, base = WordHashes(), None, None
        for batch in batches:
            out = []
            texts, bases = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            for i, (doc, pivot) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if pivot != last:
                    last, base = pivot, shingle_set(cache.of(_words(bases[i].as_py())), ngram)
                own = shingle_set(cache.of(_words(texts[i].as_py())), ngram)
                diff = np.setxor1d(own, base, assume_unique=True)
                both = len(own) + len(base) - len(diff)  # twice the intersection
                j, union = both / 2, (both + 2 * len(diff)) / 2
                close = j >= near * union
                out.append((doc, pivot, len(own), len(base), j * 100 >= round(100 * threshold) * union, close, diff.tobytes() if close else b""))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc", "pivot", "n", "pivot_n", "linked", "near", "diff"])

    return run


def _neighbours(threshold: float):
    """Links among the members of one pivot's neighbourhood, by their differences from it: a spanning forest of them."""
    per = round(100 * threshold)

    def run(table: pa.Table) -> pa.Table:
        docs, linked = table["doc"].to_numpy(), table["linked"].to_numpy(zero_copy_only=False)
        n, side = table["n"].to_numpy(), table["side"].to_numpy()
        sets = [np.frombuffer(d, np.uint64) for d in table["diff"].to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        values, where, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[where] > 1
        column = np.cumsum(times > 1) - 1
        own, col = owner[shared], column[where[shared]]
        parent = list(range(len(docs) + 1))  # the last one is the pivot

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in np.flatnonzero(linked):
            parent[i] = len(docs)
        found: list[tuple[int, int]] = []
        start = np.searchsorted(own, np.arange(len(docs) + 1))
        order = np.argsort(col, kind="stable")
        heads = np.searchsorted(col[order], np.arange(int((times > 1).sum()) + 1))
        by_col = own[order]
        for i in np.flatnonzero(~linked):
            mine = col[start[i] : start[i + 1]]
            hits = np.concatenate([by_col[heads[c] : heads[c + 1]] for c in mine]) if len(mine) else np.empty(0, np.int64)
            common = np.bincount(hits, minlength=len(docs))
            apart = size[i] + size - 2 * common
            total = n[i] + n
            good = ((total - apart) * 100 >= per * (total + apart)) & ((side[i] != side) | (side[i] == 0))
            good[i] = False
            for k in np.flatnonzero(good):
                x, y = root(int(i)), root(int(k))
                if x != y:
                    parent[x] = y
                    found.append((int(docs[i]), int(docs[k])))
        return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

    return run


def _within(close: DataFrame, threshold: float) -> DataFrame:
    """Links inside the neighbourhoods that have members not linked with their pivot."""
    sizes = close.groupBy("pivot").agg(F.count("*").alias("m"), F.count_if(~F.col("linked")).alias("gray")).filter("gray > 0 and m > 1")
    rows = _blocks(close.join(sizes, "pivot")).select("pivot", "doc", "n", "linked", "diff", "lo", "hi", "side")
    return rows.groupBy("pivot", "lo", "hi").applyInArrow(_neighbours(threshold), "a long, b long")


def _texts(docs: DataFrame, nodes: DataFrame, state: DataFrame, size: int) -> DataFrame:
    """(node, text) of the nodes that share a bucket, dealt by node: whole texts are fetched once for all rounds.

    Repeated rows are combined before it, and no join is left to the size of its sides, so small inputs are planned as large ones.
    """
    needed = nodes.select("node", "rid", "id").join(state.select(F.col("doc").alias("node")).distinct(), "node")
    rows = docs.select("rid", F.coalesce("doc_id", F.lit(0)).alias("id"), "text").dropDuplicates(["rid", "id"])
    return written_by(rows.join(needed.hint("merge"), ["rid", "id"]).select("node", "text"), "texts", "node", size)


def _told(pairs: DataFrame, texts: DataFrame, ngram: int, near: float, threshold: float) -> DataFrame:
    """pairs (doc, pivot) of nodes with what their full sets say of them.

    The texts stay where they are: pairs and pivots go to them. What moves is one text for each pair, and the pivots' own;
    as both of these are shuffled, a pivot of very many pairs can be split.
    """
    of_docs = texts.select(F.col("node").alias("doc"), "text").join(pairs.hint("merge"), "doc")
    pivots = pairs.select("pivot").distinct().hint("merge")
    of_pivots = texts.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text")).join(pivots, "pivot", "left_semi").repartition("pivot")
    full = of_docs.hint("merge").join(of_pivots, "pivot")
    return written(full.select("doc", "pivot", "text", "pivot_text").mapInArrow(_compare(ngram, near, threshold), "doc long, pivot long, n long, pivot_n long, linked boolean, near boolean, diff binary"), "told")


def _blocks(rows: DataFrame) -> DataFrame:
    """rows with a column m (rows of their group) once for each pair (lo, hi) of blocks that theirs is in; side: 0 where both are one block, else 1 or 2."""
    rows = rows.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    return rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other"), "side": side})


def _alike(cut: int):
    """Pairs of a group (rows sorted by key, lo, hi) whose sketches differ in `cut` bits at most, one of them outside."""

    def settle(docs: np.ndarray, outside: np.ndarray, side: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
        a, b = [], []
        for at in range(0, len(left), 64):
            rows = left[at : at + 64]
            apart = np.bitwise_count(sketch[rows][:, None, :] ^ sketch[right][None, :, :]).sum(axis=2, dtype=np.int32)
            good = (apart <= cut) & (outside[rows][:, None] | outside[right][None, :])
            i, k = np.nonzero(good)
            i, k = docs[rows[i]], docs[right[k]]
            a.append(np.maximum(i, k)[i != k])
            b.append(np.minimum(i, k)[i != k])
        return np.concatenate(a) if a else np.empty(0, np.int64), np.concatenate(b) if b else np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(table: pa.Table, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            nonlocal rest
            key = np.stack([table[c].to_numpy().astype(np.int64) for c in ("key", "lo", "hi")])
            head = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            ends = np.append(head[1:], table.num_rows)
            docs, side = table["doc"].to_numpy(), table["side"].to_numpy()
            outside = table["outside"].to_numpy(zero_copy_only=False)
            sketch = table["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
            for x, y in list(zip(head.tolist(), ends.tolist(), strict=True))[: None if whole else -1]:
                if y - x > 1:
                    yield settle(docs[x:y], outside[x:y], side[x:y], sketch[x:y])
            rest = None if whole else table.slice(int(head[-1]))

        def out(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            none = [np.empty(0, np.int64)]
            a, b = np.concatenate(none + [x for x, _ in found]), np.concatenate(none + [y for _, y in found])
            both = np.unique(np.stack([a, b], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc", "pivot"])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                yield out(list(groups(table if rest is None else pa.concat_tables([rest, table]), False)))
        if rest is not None:
            yield out(list(groups(rest, True)))

    return run


def _may_link(state: DataFrame, sketches: DataFrame, cut: int) -> DataFrame:
    """(doc, pivot): the pairs within buckets, one of them outside, that by their sketches may be linked."""
    sizes = state.groupBy("key").agg(F.count("*").alias("m"), F.count_if("outside").alias("out")).filter("out > 0 and m > 1").select("key", "m")
    rows = _blocks(state.join(sizes, "key")).join(sketches.withColumnRenamed("node", "doc"), "doc")
    rows = rows.select("key", "lo", "hi", "side", "doc", "outside", "sketch").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return rows.mapInArrow(_alike(cut), "doc long, pivot long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(doc, component) of each document in `links` (a, b): the smallest one reachable. Every round is written, and tells whether a label fell."""
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).select(F.col("a").alias("doc"), "component"), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("doc", "b"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("component").alias("low"))
        after = labels.join(near, "doc", "left").select("doc", F.col("component").alias("was"), F.least("component", F.coalesce("low", "component")).alias("component"))
        up = labels.select(F.col("doc").alias("component"), F.col("component").alias("far"))
        after = after.join(up, "component", "left").select("doc", "was", F.least("component", F.coalesce("far", "component")).alias("component"))
        after = written(after, "labels")
        labels = after.select("doc", "component")
        if not after.filter("component < was").head(1):
            return labels
    raise RuntimeError(f"labels still fall after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, ngram: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text; other columns are not read).

    Null and empty texts, and those without words, have no shingles: each is its own component. Rows are
    documents of their own even where their ids are equal or null; component_id is the smallest id in the component,
    null where no row there has one, and then one row of the component (all equal ones) is kept. Equal rows
    give equal rows. An empty table gives none; very long texts are taken whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("rid", F.xxhash64("doc_id", F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))))
    near = 2 * threshold - 1
    sig = written(docs.select("doc_id", "text", "rid").mapInArrow(_signatures(ngram, bands, rows, bits), "doc_id long, rid long, n_shingles long, set_a long, set_b long, keys array<long>, sketch array<long>"), "signatures")
    some = sig.filter("n_shingles > 0")
    classes = some.groupBy("set_a", "set_b").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("rep"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbered once, in a table
    nodes = some.join(classes.select("set_a", "set_b", "node", F.col("rep.rid").alias("rid")), ["set_a", "set_b", "rid"]).dropDuplicates(["node"])
    nodes = written(nodes.select("node", "rid", F.coalesce("doc_id", F.lit(0)).alias("id"), "keys", "sketch"), "nodes")
    band_rows = nodes.select(F.explode("keys").alias("key"), F.col("node").alias("doc"))
    shared = band_rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    shared = written(band_rows.join(shared, "key"), "shared")
    # The pivot of a bucket is the member that shares buckets with the most rows: of near copies one document is then
    # the pivot of most buckets, whatever the ids, and the same rows need not be compared under many pivots.
    reach = shared.groupBy("doc").agg(F.sum("m").alias("reach"))
    state = written(shared.join(reach, "doc").select("key", "doc", "reach", F.lit(True).alias("outside")), "buckets")
    size = 8 * (sig.agg(F.sum("n_shingles")).first()[0] or 0)  # about the bytes of all texts
    texts = _texts(docs, nodes, state, size)
    sketches = nodes.select("node", "sketch")
    cut = sketch_cut(near, bands * rows, bits)
    links: DataFrame | None = None
    for last in [False] * PIVOT_ROUNDS + [True]:
        if last:
            pairs = written(_may_link(state, sketches, sketch_cut(threshold, bands * rows, bits)).distinct(), "pairs")
        else:
            first = F.min(F.when(F.col("outside"), F.struct((-F.col("reach")).alias("order"), "doc")))
            pivots = state.groupBy("key").agg(first.alias("first"), F.count("*").alias("m")).filter("first is not null and m > 1").select("key", F.col("first.doc").alias("pivot"))
            members = state.join(pivots, "key").filter("doc <> pivot")
            pairs = members.select("doc", "pivot").distinct()
            pairs = pairs.join(sketches.select(F.col("node").alias("doc"), F.col("sketch").alias("x")), "doc").join(sketches.select(F.col("node").alias("pivot"), F.col("sketch").alias("y")), "pivot")
            apart = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
            pairs = written(pairs.filter(apart <= cut).select("doc", "pivot").distinct(), "pairs")
        told = _told(pairs, texts, ngram, near, threshold)
        close = told.filter("near")
        found = close.filter("linked").select(F.col("pivot").alias("a"), F.col("doc").alias("b"))
        found = written(found if last else found.union(_within(close, threshold)), "links")
        links = found if links is None else links.union(found)
        if not last:
            state = members.join(close.select("doc", "pivot", "linked"), ["doc", "pivot"], "left").filter(~F.coalesce("linked", F.lit(False)))
            state = written(state.select("key", "doc", "reach", (F.col("outside") & F.col("linked").isNull()).alias("outside")), "buckets")
    label = components(links)
    of_class = classes.join(label, classes["node"] == label["doc"], "left").select("set_a", "set_b", "rep", F.coalesce("component", "node").alias("component"))
    least = of_class.groupBy("component").agg(F.min("rep").alias("least"))
    of_class = of_class.join(least, "component").select("set_a", "set_b", F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("first_rid"))
    out = sig.select("doc_id", "rid", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b"], "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    kept = alone | F.coalesce(component == F.col("doc_id"), component.isNull() & (F.col("rid") == F.col("first_rid")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))

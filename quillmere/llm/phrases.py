"""Phrases that occur together more often than their parts would: candidates level by level, counted by double-array tries.

1. One pass over the texts makes arrays of 64-bit word hashes (0 where a piece ends) and counts the
   words. The vocabulary tells whether any two words share a hash; if so, another seed is taken.
2. Pairs are counted by a hash of theirs; a pair whose hash occurs `least` times or more is a
   candidate, so none that is frequent is missed (hashes only add). Triples are counted the same
   way, of those only that start and end with a candidate pair.
3. All candidates, and the words in them, are dealt into blocks of at most BLOCK phrases. Each block
   becomes a double-array trie over the bytes of word numbers, which is broadcast: its size is
   bounded by BLOCK, and more phrases make more passes. numpy takes the states of all text
   positions through it at once, byte by byte; accepting states are counted by bincount, and the
   counts of all shards are added. These counts are exact and the only ones that scores see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.common import mixed, written

BLOCK = 1 << 19  # phrases in a trie
BUCKETS = 1 << 21  # hashes that a task looks for at once
SHARD = 1 << 19  # words whose phrases a task gathers before it passes them on
SLICE = 1 << 16  # counts to a row
KNOWN = 150_000  # words whose hashes and counts a task keeps
TEXTS = 200  # texts that a task takes apart at once
DIGITS = 3  # bytes of a word's number
SEEDS = 8
STOPS = re.compile(rb"[.,;:!?\x0A-\x0D]")
DELTA, SIGMA = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """Numbers of words as they come, with their hashes (0 for the full stop) and counts."""

    def __init__(self, seed: int):
        super().__init__({b".": 0})
        self.seed, self.new, self.hashes, self.counts = seed, [], np.zeros(1, np.uint64), np.zeros(1, np.int64)

    def __missing__(self, word: bytes) -> int:
        self.new.append(xxhash.xxh3_64_intdigest(word, self.seed) or 1)
        n = self[word] = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        """The hashes of `words`, which are counted."""
        numbers = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if len(self) > len(self.hashes):
            more = max(len(self), 3 * len(self.hashes) // 2) - len(self.hashes)
            self.hashes, self.counts = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.hashes, self.counts))
        if self.new:
            self.hashes[len(self) - len(self.new) : len(self)] = self.new
            self.new = []
        np.add.at(self.counts, numbers, 1)
        return self.hashes[numbers]


def _encoded(seed: int):
    """(kind, blob, lang, word, h, n): kind 0 the word hashes of some documents, kind 1 a word with its hash and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        langs: dict[str, _Words] = {}

        def told(blob: list[np.ndarray]) -> pa.RecordBatch:
            whole = np.concatenate(blob)
            return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([squeeze(whole.tobytes())], pa.binary()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names)

        def words(lang: str) -> pa.RecordBatch:
            known = langs.pop(lang)
            held, n = list(known)[1:], len(known) - 1
            return pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.nulls(n, pa.binary()), pa.array([lang] * n, pa.string()), pa.array(held, pa.binary()).cast(pa.string()), pa.array(known.hashes[1 : n + 1].view(np.int64)), pa.array(known.counts[1 : n + 1])], names)

        names, blob, size = ["kind", "blob", "lang", "word", "h", "n"], [], 0
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                if lang not in langs:
                    langs[lang] = _Words(xxhash.xxh3_64_intdigest(lang.encode(), seed))
                blob += [langs[lang].of(STOPS.sub(b" . ", text.lower()).split()), np.zeros(1, np.uint64)]  # a full stop ends a piece, so it can be in no word
                size += len(blob[-2]) + 1
                if sum(map(len, langs.values())) > KNOWN:
                    yield from [words(x) for x in list(langs)]
                if size > SHARD // 4:
                    yield told(blob)
                    blob, size = [], 0
        if blob:
            yield told(blob)
        yield from (words(x) for x in list(langs))

    return run


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The word hashes of about SHARD words at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    held, n = [], 0
    for batch in batches:
        for z in batch.column(0).to_pylist():
            held.append(np.frombuffer(unpack(z), np.uint64))
            n += len(held[-1])
            if n >= SHARD:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * DELTA + mixed(b ^ SIGMA))


def _counted(h: np.ndarray) -> pa.RecordBatch:
    values, n = np.unique(h, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["h", "n"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for h in _arrays(batches):
        yield _counted(_pair_hashes(h)[1])


class Places:
    """Where hashes stand in a sorted array of hashes, found by their first bits."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, min(22, len(keys).bit_length()))
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.start = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(keys)).astype(np.int32)

    def of(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is not there."""
        out = np.full(len(h), -1, np.int32)
        first = (h >> self.shift).astype(np.int32)
        at, left = self.start[first], self.start[first + 1]
        todo = np.flatnonzero(at < left)
        at, left, sought = at[todo], left[todo], h[todo]
        while len(todo):
            hit = self.keys[at] == sought
            out[todo[hit]] = at[hit]
            more = ~hit & (at + 1 < left)
            todo, at, left, sought = todo[more], at[more] + 1, left[more], sought[more]
        return out


class DoubleArray:
    """A trie of phrases of up to three word hashes (0: none): from a state s, byte c leads to base[s] + c if check there says s. accept: the phrase's row, or -1."""

    def __init__(self, phrases: np.ndarray):
        words = np.unique(phrases[phrases != 0])
        numbers = np.searchsorted(words, phrases)
        length = (phrases != 0).sum(axis=1)
        if len(words) >> 8 * DIGITS:
            raise ValueError("more words than numbers")
        node = np.zeros(len(phrases), np.int64)
        parents, digits, total, ends = [], [], 1, np.full(1, -1)
        for place in range(3):
            rows = np.flatnonzero(length > place)
            for shift in range(8 * (DIGITS - 1), -1, -8):
                key = node[rows] * 256 + (numbers[rows, place] >> shift & 255)
                found, inverse = np.unique(key, return_inverse=True)
                parents.append(found >> 8)
                digits.append(found & 255)
                node[rows] = total + inverse
                total += len(found)
            ends = np.concatenate([ends, np.full(total - len(ends), -1)])
            done = rows[length[rows] == place + 1]
            ends[node[done]] = done
        self._put(np.concatenate(parents), np.concatenate(digits), ends)
        self.words = Places(words)
        self.first = self.advanced(np.zeros(len(words), np.int32), np.arange(len(words)))  # the states after a first word, by its number

    def _put(self, parent: np.ndarray, digit: np.ndarray, ends: np.ndarray) -> None:
        """Gives each node a base so that no two children share a slot. Nodes with many children come first; those of one size try places at random, all together, and who meets nobody stays."""
        n = len(ends)
        kids = np.bincount(parent, minlength=n)
        first = np.cumsum(kids) - kids  # children stand together, by parent
        order = np.argsort(parent, kind="stable")
        digit, child = digit[order], order + 1  # nodes are numbered as their edges come
        base, rng = np.zeros(n, np.int64), np.random.default_rng(1)
        size = 256 + 8 * n // 5
        used = np.zeros(size, bool)
        used[0] = True
        position = np.zeros(n, np.int64)
        for count in sorted(set(kids[kids > 0].tolist()), reverse=True):
            left, tries = np.flatnonzero(kids == count), 0
            while len(left):
                if tries > 40 or count >= 64 and tries:  # no room left for these: more slots
                    used = np.concatenate([used, np.zeros(256 * len(left), bool)])
                    at = size + 256 * np.arange(len(left))
                    size, tries = len(used), -1
                else:
                    at = rng.integers(0, size - 255, len(left))
                slots = at[:, None] + digit[first[left][:, None] + np.arange(count)]
                flat, owner = slots.ravel(), np.repeat(np.arange(len(left)), count)
                taken = np.full(size, -1) if len(flat) > size // 8 else None
                if taken is None:
                    ranked = np.argsort(flat, kind="stable")
                    again = np.zeros(len(flat), bool)
                    again[ranked[1:]] = flat[ranked[1:]] == flat[ranked[:-1]]
                else:
                    taken[flat[::-1]] = owner[::-1]
                    again = taken[flat] != owner
                clash = np.bincount(owner, weights=again | used[flat], minlength=len(left)) > 0
                stay = ~clash
                base[left[stay]] = at[stay]
                used[slots[stay].ravel()] = True
                position[child[(first[left[stay]][:, None] + np.arange(count)).ravel()]] = slots[stay].ravel()
                left, tries = left[clash], tries + 1
        self.base, self.check, self.accept = np.full(size, -256, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[position] = np.where(kids > 0, base, -256)
        self.accept[position] = ends
        self.check[position[child]] = position[parent[order]]

    def advanced(self, state: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The states after one more word (its number, or -1), for all positions at once; -1 where there is none."""
        at = np.flatnonzero((state >= 0) & (number >= 0))
        now, number = state[at], number[at]
        for shift in range(8 * (DIGITS - 1), -1, -8):
            slot = self.base[now] + (number >> shift & 255)
            ok = (slot > 0) & (self.check[np.maximum(slot, 0)] == now)
            at, now, number = at[ok], slot[ok], number[ok]
        out = np.full(len(state), -1, np.int32)
        out[at] = now
        return out


def _walked(trie: DoubleArray, h: np.ndarray, levels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, states) at each level: where the phrase of so many words that starts there is in the trie."""
    numbers = trie.words.of(h)
    at = np.flatnonzero(numbers >= 0)
    state = trie.first[numbers[at]]
    for level in range(levels):
        if level:
            inside = at + level < len(h)
            at, state = at[inside], state[inside]
            state = trie.advanced(state, numbers[at + level])
        at, state = at[state >= 0], state[state >= 0]
        yield at, state


def _scan(texts: DataFrame, task, schema: str) -> DataFrame:
    return texts.select("blob").mapInArrow(task, schema)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _blocks(rows: DataFrame, columns: list[str], most: int) -> Iterator[np.ndarray]:
    """The values of `columns` as unsigned numbers, in blocks of about `most` rows that are dealt by `deal`, else by hash, and come to the driver one at a time."""
    n = rows.count()
    blocks = -(-n * 10 // (most * 9)) if n > most else 1
    deal = F.col("deal") if "deal" in rows.columns else F.xxhash64(*columns)
    for b in range(blocks if n else 0):
        part = rows.filter(F.pmod(deal, F.lit(blocks)) == b) if blocks > 1 else rows
        table = part.select(*columns).toArrow()
        yield np.stack([table[c].to_numpy().view(np.uint64) for c in columns], axis=1)


def _frequent(counts: DataFrame, least: int, name: str) -> DataFrame:
    return written(counts.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h"), name)


def _pair_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions where two words of a piece stand, and the hashes of these pairs."""
    at = np.flatnonzero((h[:-1] != 0) & (h[1:] != 0))
    return at, pair_hashes(h[at], h[at + 1])


def _triple_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The positions where three words of a piece stand, the hashes of these triples, and which of the pairs each starts with."""
    at, pairs = _pair_hashes(h)
    first = np.flatnonzero(at[1:] == at[:-1] + 1)
    return at[first], mixed(pairs[first] * DELTA + pairs[first + 1]), first


def _told(texts: DataFrame, hashes: DataFrame, words: int) -> DataFrame:
    """(h1, h2, ...): the phrases of so many words whose hash is among `hashes`."""
    spark, schema, found = texts.sparkSession, ", ".join(f"h{i + 1} long" for i in range(words)), []
    for block in _blocks(hashes, ["h"], BUCKETS):
        told = spark.sparkContext.broadcast(Places(np.sort(block[:, 0])))

        def task(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            for h in _arrays(batches):
                at, keys = (_pair_hashes if words == 2 else _triple_hashes)(h)[:2]
                place = told.value.of(keys)
                at, place = at[place >= 0], place[place >= 0]
                shown = np.full(len(told.value.keys), -1)
                shown[place] = at  # one place of each hash is told, and all that differ from it in a word
                one = shown[place]
                differs = np.any([h[at + i] != h[one + i] for i in range(words)], axis=0)
                at = np.concatenate([shown[shown >= 0], at[differs]])
                yield pa.RecordBatch.from_arrays([pa.array(h[at + i].view(np.int64)) for i in range(words)], [f"h{i + 1}" for i in range(words)])

        found.append(_scan(texts, task, schema))
    return _union(found).distinct() if found else spark.createDataFrame([], schema)


def _candidates(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (h1, h2) whose hash occurs `least` times or more; triples (h1, h2, h3) of two such pairs whose hash does."""
    spark = texts.sparkSession
    hashes = _frequent(_scan(texts, _pairs, "h long, n long"), least, "pair-hashes")
    pairs = written(_told(texts, hashes, 2), "pairs")
    counts, whole = [], hashes.count() <= BUCKETS
    for block in _blocks(hashes, ["h"], BUCKETS):
        told = spark.sparkContext.broadcast(Places(np.sort(block[:, 0])))

        def count(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            for h in _arrays(batches):
                known = told.value.of(_pair_hashes(h)[1]) >= 0
                _, triples, first = _triple_hashes(h)
                yield _counted(triples[known[first] & (known[first + 1] if whole else True)])  # else the second pair may be in another block

        counts.append(_scan(texts, count, "h long, n long"))
    if not counts:
        return pairs, spark.createDataFrame([], "h1 long, h2 long, h3 long")
    triples = _told(texts, _frequent(_union(counts), least, "triple-hashes"), 3)
    for a, b in (("h1", "h2"), ("h2", "h3")):
        triples = triples.join(pairs.select(F.col("h1").alias(a), F.col("h2").alias(b)), [a, b], "left_semi")
    return pairs, written(triples.select("h1", "h2", "h3"), "triples")


def _dealt(phrases: DataFrame) -> DataFrame:
    """phrases with `deal`: those of one first word are dealt together, unless they are so many that they go by their second word too."""
    first = phrases.groupBy("h1").agg((F.count("*") > BLOCK // 16).alias("_many"))
    return phrases.join(first, "h1").select("h1", "h2", "h3", F.when(F.col("_many"), F.xxhash64("h1", "h2")).otherwise(F.xxhash64("h1")).alias("deal"))


def _block_counts(texts: DataFrame, phrases: np.ndarray) -> DataFrame:
    """(h1, h2, h3, f): how often each phrase of a block occurs; phrases that don't may be left out."""
    context, n = texts.sparkSession.sparkContext, len(phrases)
    trie, told = context.broadcast(DoubleArray(phrases)), context.broadcast(phrases)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n, np.int64)
        for h in _arrays(batches):
            for _, state in _walked(trie.value, h, 3):
                accepted = trie.value.accept[state]
                counts += np.bincount(accepted[accepted >= 0], minlength=n)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for s in range(0, n, SLICE):
            if counts[s : s + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([s // SLICE], pa.int32()), pa.array([squeeze(counts[s : s + SLICE].tobytes())], pa.binary())], ["slice", "z"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        sums: dict[int, np.ndarray] = {}  # a partition's slices are added as they come
        for batch in batches:
            for s, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[s] = sums.get(s, 0) + np.frombuffer(unpack(z), np.int64)
        for s, counts in sums.items():
            own = told.value[s * SLICE : (s + 1) * SLICE]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(own[:, i]).view(np.int64)) for i in range(3)), pa.array(counts)], ["h1", "h2", "h3", "f"])

    slices = _scan(texts, counted, "slice int, z binary").repartition(min(-(-n // SLICE), 64), "slice")
    return slices.mapInArrow(added, "h1 long, h2 long, h3 long, f long")


def counted_phrases(texts: DataFrame, least: int) -> DataFrame:
    """(h1, h2, h3, f): all phrases of 2 and 3 words that occur `least` times or more, and the words in them; unused places are 0."""
    spark = texts.sparkSession
    pairs, triples = _candidates(texts, least)
    zero = F.lit(0).cast("long")
    words = pairs.select(F.explode(F.array("h1", "h2")).alias("h1")).distinct().select("h1", zero.alias("h2"), zero.alias("h3"))
    phrases = written(_dealt(written(_union([words, pairs.withColumn("h3", zero), triples]), "phrases")), "dealt")
    out = [written(_block_counts(texts, block), "counts") for block in _blocks(phrases, ["h1", "h2", "h3"], BLOCK)]
    return _union(out) if out else spark.createDataFrame([], "h1 long, h2 long, h3 long, f long")


def _scores(counts: DataFrame, least: int) -> DataFrame:
    """h1, h2, h3, a, l, r, score of the candidates, without those that a longer one accounts for."""
    words = counts.filter("h2 = 0").select(F.col("h1").alias("w"), F.col("f").alias("fw"))
    two = counts.filter("h2 <> 0 and h3 = 0").select("h1", "h2", F.col("f").alias("a"))
    three = counts.filter(f"h3 <> 0 and f >= {least}").select("h1", "h2", "h3", F.col("f").alias("a"))
    word = lambda rows, c, name: rows.join(words.select(F.col("w").alias(c), F.col("fw").alias(name)), c)
    pair = lambda rows, a, b, name: rows.join(two.select(F.col("h1").alias(a), F.col("h2").alias(b), F.col("a").alias(name)), [a, b])
    score = lambda left, right: F.expr(f"cast(1000000 as decimal(7, 0)) * (cast(a as decimal(15, 0)) * cast(a as decimal(15, 0))) div (cast({left} as decimal(19, 0)) * cast({right} as decimal(19, 0)))")
    longer = _union([three.select(F.col(x).alias("h1"), F.col(y).alias("h2"), "a") for x, y in (("h1", "h2"), ("h2", "h3"))]).groupBy("h1", "h2").agg(F.max("a").alias("longest"))
    pairs = word(word(two.filter(F.col("a") >= least), "h1", "l"), "h2", "r").join(longer, ["h1", "h2"], "left").filter("longest is null or 100 * longest < 50 * a")
    pairs = pairs.select("h1", "h2", F.lit(0).cast("long").alias("h3"), "a", "l", "r", score("l", "r").alias("score"))
    triples = word(pair(pair(word(three, "h1", "l1"), "h2", "h3", "r1"), "h1", "h2", "l2"), "h3", "r2").withColumns({"s1": score("l1", "r1"), "s2": score("l2", "r2")})
    one = F.col("s1") <= F.col("s2")
    choose = lambda x: F.when(one, F.col(f"{x}1")).otherwise(F.col(f"{x}2"))
    return pairs.unionByName(triples.select("h1", "h2", "h3", "a", choose("l").alias("l"), choose("r").alias("r"), choose("s").alias("score")))


def _seeded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, vocabulary) under the first seed for which no two words of the corpus share a hash."""
    for seed in range(SEEDS):
        coded = written(rows.mapInArrow(_encoded(seed), "kind int, blob binary, lang string, word string, h long, n long"), "encoded")
        vocabulary = written(coded.filter("kind = 1").groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), "vocabulary")
        if not vocabulary.groupBy("h").count().filter("count > 1").limit(1).count():
            return coded.filter("kind = 0").select("blob"), vocabulary
    raise ValueError(f"words share a 64-bit hash under each of {SEEDS} seeds")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: of each lang the `top` phrases of 2 or 3 words by score.

    docs has text and lang; a null text is empty, a null lang is `und`. Phrases do not cross the ends of pieces, overlapping
    occurrences all count, repeated rows are texts like others. Ties of scores go by a, then by phrase. An empty table gives
    none; other columns are not read. `a` must stay below 10**15.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text is not null")
    texts, vocabulary = _seeded(rows)
    scored = _scores(counted_phrases(texts, least), least)
    names = vocabulary.filter(F.col("n") >= least)
    for i in (1, 2, 3):
        own = names.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"), *([F.col("lang")] if i == 1 else []))
        scored = scored.join(own, f"h{i}", "left" if i == 3 else "inner")
    scored = scored.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


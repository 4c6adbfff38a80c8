"""A trie of all conversations: a z-fast trie, filled in batches on Spark, whose edges are expanded at the end.

A conversation is a sequence of turns, and a prefix of it is known by a chained 128-bit hash of the
turns up to there. The trie is compacted: a node stands for an edge of one or more turns, from depth
p (where its parent ends) to depth e, and is found by its handle, the prefix at the depth in (p, e]
that the highest power of two divides.

1. Equal sequences become one. They are dealt into batches at random (by their hash), each GROW
   times the size of all before.
2. A batch finds its exits by fat binary search: each round halves the power of two, so a
   conversation of T turns asks log2(T) times for a handle, by a join, and not once for each turn.
   A hash of the whole edge tells whether the node found lies on the conversation's own path.
3. The batch is inserted: edges are cut where conversations leave them or end, and those that go
   on in a way the trie does not know are put together by their next turn. As batches are random, a
   beginning that g conversations of a batch share is new to the trie with probability
   (1 - 1/(1 + GROW))**g only: groups stay small, whatever share of the rows begins alike.
4. Sums over subtrees come by pointer doubling, in as many rounds as the logarithm of the height.
   What a prefix saves follows from sums too: with D the characters up to a node's end, those
   below v that are not saved again are the sum of (members * D) less what stands above v.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import written

FIRST, GROW = 4096, 8
KEY = 16
ROOT = bytes(KEY)
SHORT = 15  # sequences of at most so many turns are done after four rounds
NODE = "name binary, top binary, end binary, p int, e int, edge binary, before long, at array<long>"


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns (turn, digest, chars) of each conversation in order (null first; those of one number by their digests); rows without conv_id are left out. Only digests are shuffled, not texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).alias("row"))
    return rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))


def spliced(lists: DataFrame) -> DataFrame:
    """lists with each conversation c rebuilt: the first h turns of conversation c - c % 100, then its own after its first h, with h = crc32(c) % 6. A base has at most 199 followers."""
    rows = lists.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    bases = lists.filter(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("first"))
    first = F.slice(F.coalesce("first", F.array().cast(lists.schema["turns"].dataType)), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return rows.join(bases, "base", "left").select("conv_id", F.concat(first, own).alias("turns"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, lasts, ats = [], [], []
        for turns in batch.column(1).to_pylist():
            last, total, path, at = ROOT, 0, [], []
            for t in turns:
                last = hashlib.blake2b(last + t["digest"], digest_size=KEY).digest()
                total += t["chars"]
                path.append(last)
                at.append(total)
            keys.append(b"".join(path))
            lasts.append(last)
            ats.append(at)
        n = [len(a) for a in ats]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(lasts, pa.binary()), pa.array(keys, pa.binary()), pa.array(ats, pa.list_(pa.int64()))], ["conv_id", "T", "key", "keys", "at"])


def _key(blob: str, place: str) -> str:
    """The place-th (from 1) key of a blob."""
    return f"substring({blob}, ({place} - 1) * {KEY} + 1, {KEY})"


def _fattest(a: str, b: str) -> str:
    """The number in (a, b] that the highest power of two divides."""
    return f"({b} & shiftleft(-1, length(bin({a} ^ {b})) - 1))"


def _located(seqs: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """seqs with lo: the depth of the deepest node of the trie that lies on the sequence as a whole."""
    handles = nodes.select(F.expr(_key("edge", f"({_fattest('p', 'e')} - p)")).alias("_handle"), F.col("p").alias("_p"), F.col("e").alias("_e"), F.col("end").alias("_end"))
    rows = seqs.withColumns({"lo": F.lit(0), "hi": F.col("T")})
    for _ in range(rounds):
        rows = rows.withColumn("f", F.expr(f"if(lo < hi, {_fattest('lo', 'hi')}, 0)"))
        ask = F.expr(f"if(f > 0, {_key('keys', 'f')}, concat(cast('.' as binary), key))")  # who is done asks for what is not there, each by itself
        rows = rows.withColumn("_ask", ask).join(handles, F.col("_ask") == F.col("_handle"), "left")
        rows = rows.withColumn("_whole", F.expr(f"_e is not null and _e <= T and {_key('keys', '_e')} = _end"))
        hi = F.expr("case when f = 0 or _whole then hi when _e is not null then _p else f - 1 end")
        lo = F.expr("case when _whole then _e when _e is not null then _p else lo end")
        rows = rows.withColumns({"hi": hi, "lo": lo}).select(*seqs.columns, "lo", "hi")
    return rows.drop("hi")


def _placed(seqs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where each sequence leaves the trie: exit (the name of the edge, or null), its e, L (the depth up to which it is known), and what is new of it."""
    exits = nodes.select(F.col("name").alias("exit"), F.col("e"), F.col("edge"))
    ask = F.expr(f"if(lo < T, {_key('keys', '(lo + 1)')}, concat(cast('.' as binary), key))")
    rows = seqs.withColumn("_ask", ask).join(exits, F.col("_ask") == F.col("exit"), "left")
    same = f"size(filter(sequence(1, least(T, e) - lo), i -> {_key('keys', '(lo + i)')} = {_key('edge', 'i')}))"  # chained: none is equal after the first that differs
    rows = rows.withColumn("L", F.expr(f"if(exit is null, lo, lo + {same})"))
    new = F.expr(f"if(L < T, {_key('keys', '(L + 1)')}, null)")
    return rows.select("exit", "e", "L", "T", new.alias("new"), F.expr(f"if(L = 0, unhex('{ROOT.hex()}'), {_key('keys', 'L')})").alias("top"), F.expr("if(L = 0, 0L, at[L - 1])").alias("before"), F.expr(f"substring(keys, L * {KEY} + 1)").alias("keys"), F.expr("slice(at, L + 1, T)").alias("at"))


def _cut(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """nodes, those of `cuts` (exit, depths) cut there; a node is cut at its inner depths only, so at most once a turn."""
    rows = nodes.join(cuts, F.col("name") == F.col("exit"), "left").withColumn("_b", F.expr("concat(array(p), coalesce(depths, cast(array() as array<int>)), array(e))"))
    rows = rows.select("*", F.explode(F.expr("transform(sequence(0, size(_b) - 2), i -> struct(_b[i] as a, _b[i + 1] as b))")).alias("x"))
    first = F.col("x.a") == F.col("p")
    key = lambda place: F.expr(_key("edge", place))
    return rows.select(
        key("(x.a - p + 1)").alias("name"), F.when(first, F.col("top")).otherwise(key("(x.a - p)")).alias("top"), key("(x.b - p)").alias("end"), F.col("x.a").alias("p"), F.col("x.b").alias("e"),
        F.expr(f"substring(edge, (x.a - p) * {KEY} + 1, (x.b - x.a) * {KEY})").alias("edge"), F.when(first, F.col("before")).otherwise(F.expr("at[x.a - p - 1]")).alias("before"), F.expr("slice(at, x.a - p + 1, x.b - x.a)").alias("at"),
    )


def small_trie(rows: list[dict]) -> Iterator[tuple]:
    """The nodes of a compacted trie of sequences that share their first key: each row has top, L, T, keys and at of what is new of it."""
    paths = [[r["keys"][i : i + KEY] for i in range(0, len(r["keys"]), KEY)] for r in rows]
    after: dict[bytes, set[bytes]] = defaultdict(set)
    for path in paths:
        for a, b in zip(path, path[1:], strict=False):
            after[a].add(b)
    stops = {path[-1] for path in paths} | {k for k, v in after.items() if len(v) > 1}
    seen = set()
    for r, path in zip(rows, paths, strict=True):
        start, top, before = 0, r["top"], r["before"]
        for i, key in enumerate(path):
            if key in stops:
                if key not in seen:
                    seen.add(key)
                    yield path[start], top, key, r["L"] + start, r["L"] + i + 1, b"".join(path[start : i + 1]), before, r["at"][start : i + 1]
                start, top, before = i + 1, key, r["at"][i]


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of all small tries; rows come sorted by `new`."""
    names = ["name", "top", "end", "p", "e", "edge", "before", "at"]
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64())]

    def told(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    group, out = [], []
    for batch in batches:
        for row in batch.to_pylist():
            if group and group[0]["new"] != row["new"]:
                out += small_trie(group)
                group = []
            group.append(row)
        if len(out) > 5000:
            yield told(out)
            out = []
    if group:
        out += small_trie(group)
    if out:
        yield told(out)


def z_fast_trie(seqs: DataFrame, batches: int, deepest: int) -> DataFrame:
    """The nodes (NODE) of the compacted trie of seqs (key, keys, at, T, batch), all different and not empty. Every sequence ends at a node."""
    nodes = written(seqs.sparkSession.createDataFrame([], NODE), "trie")
    for b in range(batches):
        part = seqs.filter(F.col("batch") == b).drop("batch")
        found = _located(part.filter(F.col("T") <= SHORT), nodes, SHORT.bit_length()) if b else part.withColumn("lo", F.lit(0))
        if b and deepest > SHORT:
            found = found.unionByName(_located(part.filter(F.col("T") > SHORT), nodes, deepest.bit_length()))
        placed = written(_placed(found, nodes), "placed")
        cuts = placed.filter("exit is not null and L < e").groupBy("exit").agg(F.sort_array(F.collect_set("L")).alias("depths"))
        new = placed.filter("new is not null").select("new", "top", "before", "L", "keys", "at").repartition("new").sortWithinPartitions("new")
        nodes = written(_cut(nodes, cuts).unionByName(new.mapInArrow(_grown, NODE)), "trie")
    return nodes


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and the SHA-256 of its ids, comma-joined, of rows sorted by key and id; ids are fed to the hash as they come."""
    last, digest = None, None
    for batch in batches:
        keys, out = [], []
        for key, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != last:
                if last is not None:
                    keys.append(last)
                    out.append(digest.hexdigest())
                last, digest = key, hashlib.sha256(str(i).encode())
            else:
                digest.update(f",{i}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends_sha256"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["key", "ends_sha256"])


def _subtree_sums(rows: DataFrame) -> DataFrame:
    """rows (end, up and sums n, nd, lc, leaves, and low) with all of them over the whole subtree: after k rounds over descendants nearer than 2**k."""
    root = F.lit(ROOT)
    while rows.filter(F.col("up").isNotNull()).limit(1).count():
        below = rows.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("_end")).agg(*[F.sum(c).alias(f"_{c}") for c in ("n", "nd", "lc", "leaves")], F.min("low").alias("_low"))
        ups = rows.select(F.col("end").alias("_at"), F.col("up").alias("_up"))
        ask = F.when(F.col("up").isNotNull() & (F.col("up") != root), F.col("up")).otherwise(F.concat(F.lit(b"."), F.col("end")))
        rows = rows.join(below, F.col("end") == F.col("_end"), "left").withColumn("_ask", ask).join(ups, F.col("_ask") == F.col("_at"), "left")
        sums = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("n", "nd", "lc", "leaves")]
        rows = written(rows.select("end", F.col("_up").alias("up"), *sums, F.least("low", "_low").alias("low")), "subtrees")
    return rows


def conversation_trie(lists: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each prefix of the sequences lists (conv_id, turns), the empty one included.

    conv_id is unique. Turns of equal role and text are equal; null ones are empty. A sequence without turns ends at the root. An empty
    table gives none. One sequence's keys must fit in one row (24 bytes a turn).
    """
    spark = lists.sparkSession
    members = written(lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns")).mapInArrow(_chained, "conv_id long, T int, key binary, keys binary, at array<long>"), "members")
    ids = members.select("key", "conv_id")
    first = ids.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    own = written(members.join(first.select("n", "conv_id"), "conv_id").select("key", "n", F.col("conv_id").alias("low"), "keys", "at", "T"), "sequences")
    n, deepest = own.filter("T > 0").agg(F.count("*"), F.max("T")).first()
    bounds, size = [], FIRST
    while size < n:
        bounds.append(size / n)
        size *= 1 + GROW
    place = F.shiftrightunsigned(F.xxhash64("key"), 11) / F.lit(float(1 << 53))
    seqs = own.filter("T > 0").select("key", "keys", "at", "T", sum((F.when(place >= b, 1).otherwise(0) for b in bounds), F.lit(0)).alias("batch"))
    nodes = z_fast_trie(seqs, len(bounds) + 1, deepest or 0)

    root = spark.range(1).select(F.lit(None).cast("binary").alias("name"), F.lit(None).cast("binary").alias("top"), F.lit(ROOT).alias("end"), F.lit(0).alias("p"), F.lit(0).alias("e"), F.lit(b"").alias("edge"), F.lit(0).cast("long").alias("before"), F.array().cast("array<long>").alias("at"))
    nodes = nodes.unionByName(root).drop("name", "edge")
    children = nodes.groupBy(F.col("top").alias("_top")).agg(F.count("*").alias("kids"))
    mine = own.select(F.col("key").alias("_key"), F.col("n").alias("_n"), F.col("low").alias("_low"))
    nodes = nodes.join(children, F.col("end") == F.col("_top"), "left").join(mine, F.col("end") == F.col("_key"), "left").drop("_top", "_key")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    reach = F.coalesce(F.try_element_at("at", F.lit(-1)), F.lit(0).cast("long"))  # characters up to the node's end
    nodes = written(nodes.withColumns({"kids": zero("kids"), "_n": zero("_n"), "reach": reach}), "nodes")
    sums = _subtree_sums(nodes.select("end", F.col("top").alias("up"), F.col("_n").alias("n"), (F.col("_n") * F.col("reach")).alias("nd"), F.when(F.col("e") > 0, F.col("reach") - F.col("before")).otherwise(0).alias("lc"), F.when(F.col("kids") == 0, 1).otherwise(0).cast("long").alias("leaves"), F.col("_low").alias("low")))

    ends = ids.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hashed_ids, "key binary, ends_sha256 string")
    rows = nodes.select("end", "top", "p", "e", "before", "at", "kids").join(sums.drop("up"), "end").join(ends.withColumnRenamed("key", "end"), "end", "left")
    rows = rows.join(sums.select(F.col("end").alias("top"), F.col("low").alias("above")), "top", "left").filter("n > 0")
    each = rows.select("*", F.explode(F.expr("sequence(if(e = 0, 0, p + 1), e)")).alias("d")).withColumn("start", F.expr("if(d - p > 1, at[d - p - 2], before)"))
    last = F.col("d") == F.col("e")
    return each.select(
        F.col("low").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(F.col("d") > F.col("p") + 1, F.col("low")).when(F.col("d") > 0, F.col("above")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("nd") - F.col("n") * F.col("start") - F.col("lc") + F.col("start") - F.col("before")).alias("saved_tokens"), F.when(last & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )

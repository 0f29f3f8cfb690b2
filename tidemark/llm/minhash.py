"""MinHash near-duplicate groups of documents.

1. Every text becomes its set of distinct word shingles (64-bit hashes).  Documents
   with one and the same set are one *node*; from here on work is per node.
2. 128 universal hash functions give a node's minima; ``banding`` chooses how many of
   them form a band for the wanted similarity, so that nodes at the threshold miss
   each other in all bands with a probability of 1e-6 at most (0.8: 32 bands of 4,
   5e-8).  A band's minima are hashed into a bucket.
3. In each bucket all members are compared with the smallest member: first the
   signatures, then the full sets.  Confirmed links go into connected components.
4. A bucket whose members still lie in different components may hide links between
   them.  Its pairs across components are compared, first by signature, then by full
   sets, each pair in the first such bucket that it shares; the components are
   completed with the links found.  Pairs inside a component need no look: they are
   connected already, so a bucket's work is that of its members outside its largest
   component.  A bucket with over ``HOT`` of those is not compared as such: its members
   are grouped anew by their rarest shingles.  Two sets at the threshold share one of
   the n - ceil(percent * n / 100) + 1 shingles that come first in any order of all
   shingles, if each gives that many of its own; with rare shingles first, unlike
   documents hardly ever meet.  This is exact, and so are the blocks of bounded size in
   which groups are compared.
5. Components come from alternating large-star and small-star steps, each written to
   the shared folder.

Signatures are compared with a margin of ``MARGIN`` standard deviations, which loses
under 1e-9 of the pairs at the threshold.

No step lists the pairs of a group, no group meets in one task unless it is small:
buckets, stars and components that hold many rows are split off and broadcast under a
bound that follows from their share, a member that many others are compared with is
copied to several tasks, and blocks bound what is compared at once.

Defined results: a document without words has an empty set and is its own group;
repeated rows with words share a group; a null id is never the smallest id; rows
whose id is the smallest of their group are kept; a threshold under 0.11, which 128
minima can't serve, is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import batches_of, no_collection, split_hot_join, written

MINIMA, MARGIN, HOT = 128, 6.5, 512
#: Of all shingles of hot nodes, those with over one part in so many count as frequent; there are fewer of them than that.
RARE = 100_000
#: Shuffle partitions that share a file in tables of keys and links.
FEWER = 4
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.Generator(np.random.PCG64(20240229))
#: h(x) = (a * x + b) mod 2**64 div 2**32 over 32-bit x, a odd: multiply-add-shift hashing.
_A = _rng.integers(0, 1 << 63, MINIMA, dtype="u8") * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, MINIMA, dtype="u8")
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def banding(percent: int, missed: float = 1e-6) -> tuple[int, int]:
    """Bands and rows per band: the most rows with which a pair at the threshold misses itself in all bands with a probability of ``missed`` at most."""
    share = percent / 100
    for rows in range(MINIMA, 0, -1):
        if (1 - share**rows) ** (MINIMA // rows) <= missed:
            return MINIMA // rows, rows
    raise ValueError(f"{MINIMA} minima can't find pairs at a similarity of {share}")


def least_agreement(percent: int) -> float:
    """Share of equal minima under which a pair is not worth its full sets."""
    share = percent / 100
    return share - MARGIN * (share * (1 - share) / MINIMA) ** 0.5


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket of every node in every band."""
    keys = np.empty((len(minima), bands), "u8")
    for band in range(bands):
        key = np.full(len(minima), band + 1, "u8")
        for k in range(rows):
            key = _mixed(key * _MIX1 + minima[:, band * rows + k])
        keys[:, band] = key
    return keys


def _hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; ``known`` remembers those seen, 200,000 or one text's more."""
    if len(known) > 200_000:
        known.clear()
    missing = [w for w in set(words) if w not in known]
    known.update((w, xxhash.xxh64_intdigest(w)) for w in missing)
    return np.fromiter(map(known.__getitem__, words), "u8", len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX2
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], size: int, known: dict[bytes, int] | None = None) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words, but not none, is one shingle."""
    known, out = {} if known is None else known, []
    for text in texts:
        words = text.encode().translate(_LOWER).split() if text else []
        if not words:
            out.append(np.empty(0, "u8"))
            continue
        h = _hashes(words, known)
        width = min(size, len(words))
        total = np.full(len(words) - width + 1, width, "u8")
        for k in range(width):
            total = _mixed(total * _MIX1 + h[k : len(h) - width + 1 + k])
        out.append(np.unique(total))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of every hash function over each (non-empty) set: a row per set."""
    out = np.empty((len(sets), MINIMA), "u4")
    start = 0
    while start < len(sets):
        end, total = start, 0
        while end < len(sets) and (end == start or total + len(sets[end]) <= 1 << 16):
            total += len(sets[end])
            end += 1
        x = np.concatenate(sets[start:end]) >> np.uint64(32)
        cuts = np.cumsum([0, *(len(s) for s in sets[start : end - 1])])
        for k in range(MINIMA):
            out[start:end, k] = np.minimum.reduceat((_A[k] * x + _B[k]) >> np.uint64(32), cuts)
        start = end
    return out


def _intersection(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _sketch_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """id, text_key, node, n_shingles, bands and sketch (low bytes of the signature) of every row of (id, body)."""

    count, rows = banding(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        with no_collection():
            for batch in batches_of(batches, "body", 4 << 20, 2048):
                sets = shingle_sets(batch.column(2).to_pylist(), size, known)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full]) if full else np.empty((0, MINIMA), "u4")
                nodes, bands, sketches = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                keys = band_keys(sig, count, rows)
                low = sig.astype("u1")
                for row, i in enumerate(full):
                    nodes[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    bands[i], sketches[i] = keys[row].view("i8"), low[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    names=["id", "text_key", "node", "n_shingles", "bands", "sketch"],
                )
            known.clear()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text_key", "body").mapInArrow(run, f"id {kind}, text_key long, node binary, n_shingles long, bands array<long>, sketch binary")


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int, per_task: int = 64) -> DataFrame:
    """Of ``pairs`` (a, b; a written table), those whose full sets are similar.  ``texts``: node, packed text."""
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    degree = pairs.groupBy("a").agg(F.count("*").alias("n"))
    copies = degree.withColumn("tasks", F.ceil(F.col("n") / per_task).cast("int"))
    dealt = split_hot_join(pairs, copies, ["a"], "n").withColumn("task", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int"))
    members = dealt.join(texts, dealt["b"] == texts["node"]).select("a", "task", "b", "packed")
    firsts = copies.join(texts, copies["a"] == texts["node"]).select("a", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(None).cast("binary").alias("b"), "packed")
    # Nulls sort first: the text that a task's others are compared with comes before them.
    rows = firsts.unionByName(members).repartition(parts, "a", "task").sortWithinPartitions("a", "task", "b")

    least = least_agreement(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        last, own, mine = None, None, None
        for batch in batches_of(batches, "packed", 256 << 10, 256):
            found = []
            a_, t_, b_, packed = (c.to_pylist() for c in batch.columns)
            texts = [zstandard.decompress(p).decode() for p in packed]
            sets = shingle_sets(texts, size)
            marks = signatures(sets)
            for a, t, b, s, mark in zip(a_, t_, b_, sets, marks, strict=True):
                if b is None:
                    last, own, mine = (a, t), s, mark
                    continue
                if last != (a, t) or (mark == mine).mean() < least or min(len(s), len(own)) * 100 < percent * max(len(s), len(own)):
                    continue
                common = _intersection(own, s)
                if 100 * common >= percent * (len(own) + len(s) - common):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], names=["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of ``edges`` (a, b) that is not a root.

    Alternates large-star (larger neighbours move to the smallest one) and small-star
    (smaller neighbours and the node itself move to the smallest one) until the edges
    no longer change; they then are stars around the roots.
    """
    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "components", FEWER)
    state = _state(current)
    while state[0]:
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(current.select("lo", "hi"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = split_hot_join(both, low, ["u"], "n").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = written(large, "large-star", FEWER)
        low = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        joined = split_hot_join(large, low, ["hi"], "n")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(low.select("hi", F.col("m").alias("lo"))).distinct()
        current = written(small, "small-star", FEWER)
        now = _state(current)
        if now == state:
            break
        state = now
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).head())


def _opened(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` of groups that hold several components, with n members and their shingles (weight), m of them outside the largest component, and whether a row is (apart)."""
    per = rows.groupBy(*keys, "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    groups = per.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    groups = written(groups.select(*keys, "n", "weight", (F.col("n") - F.col("top.n")).alias("m"), F.col("top.root").alias("largest")), name, FEWER)
    return split_hot_join(rows, groups, keys, "n").withColumn("apart", F.col("root") != F.col("largest")).drop("largest")


def _by_rare_shingles(nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """token, node, root and n_shingles: the first shingles of each node of ``nodes`` (node, root, n_shingles, packed text), frequent ones last."""
    import zstandard

    def sets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for batch in batches_of(batches, "packed", 256 << 10, 256):
            yield batch, shingle_sets([zstandard.decompress(p).decode() for p in batch.column(batch.schema.get_field_index("packed")).to_pylist()], size)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in sets_of(batches):
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view("i8")), pa.array(n)], names=["token", "n"])

    counts = nodes.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    total = nodes.agg(F.sum("n_shingles")).head()[0] or 0
    frequent = counts.where(F.col("n") > total / RARE).collect()  # fewer than RARE
    tokens = np.array([r["token"] for r in frequent], "i8").view("u8")
    order = np.argsort(tokens)
    packed = nodes.sparkSession.sparkContext.broadcast((tokens[order], np.array([r["n"] for r in frequent], "i8")[order]))

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = packed.value
        for batch, sets in sets_of(batches):
            taken = []
            for s in sets:
                at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
                weight = np.where(known[at] == s, often[at], 0) if len(known) else np.zeros(len(s), "i8")
                taken.append(s[np.lexsort((s, weight))][: len(s) - -(-percent * len(s) // 100) + 1])
            rows = pa.array(np.repeat(np.arange(len(sets)), [len(t) for t in taken]))
            columns = [batch.column(batch.schema.get_field_index(c)).take(rows) for c in ("node", "root", "n_shingles")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(taken).view("i8")), *columns], names=["token", "node", "root", "n_shingles"])

    return nodes.mapInArrow(first, "token long, node binary, root binary, n_shingles long")


def _hidden_links(members: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int, hot: int = HOT, block_shingles: int = 1 << 21) -> DataFrame:
    """(a, b) with similar full sets from buckets whose members lie in different components.

    ``members``: band, pos, node and n_shingles; ``nodes``: node and sketch.  A group is
    an open bucket (g1; g2 is 0) or, of the nodes of those with over ``hot`` members
    outside their largest component, one that shares a rare shingle (g1; g2 is 1).  Those
    members, and the others, are dealt into blocks of bounded number and text; each pair of blocks goes to one task,
    but none of two blocks of the largest component.  There, pairs of one component are
    passed over, also when a link just found has joined the two, and so are pairs with
    unlike signatures and pairs that meet in a bucket that is compared, but for the first
    of those; the rest are settled by their full sets.
    """
    spark = members.sparkSession
    parts, bands = int(spark.conf.get("spark.sql.shuffle.partitions")), banding(percent)[0]
    placed = members.join(roots, "node", "left").select("band", "pos", "node", "n_shingles", F.coalesce("root", "node").alias("root"))
    placed = written(placed, "bucket-members")
    left = written(_opened(placed, ["band"], "bucket-open").withColumn("hot", F.col("m") > hot), "bucket-left")
    groups = left.where(~F.col("hot")).select(F.col("band").alias("g1"), F.lit(0).alias("g2"), F.col("pos").alias("p1"), "node", "root", "n", "weight", "m", "apart")

    held = left.groupBy("node").agg(F.first("root").alias("root"), F.first("n_shingles").alias("n_shingles"), F.max("hot").alias("hot"), F.collect_list(F.when(~F.col("hot"), F.struct("pos", "band"))).alias("held"))
    if left.where("hot").limit(1).count():
        warm = written(held.where("hot").select("node", "root", "n_shingles").join(texts, "node").select("node", "root", "n_shingles", "packed"), "bucket-hot")
        again = _opened(written(_by_rare_shingles(warm, size, percent), "bucket-tokens"), ["token"], "bucket-open-tokens")
        groups = groups.unionByName(again.select(F.col("token").alias("g1"), F.lit(1).alias("g2"), F.lit(-1).alias("p1"), "node", "root", "n", "weight", "m", "apart"))

    # Blocks 0 to outer - 1 hold what is apart, the rest the largest component.
    rows = F.greatest(F.lit(1), F.least(F.lit(hot), F.floor(F.lit(block_shingles) * F.col("n") / F.col("weight")))).cast("int")
    dealt = groups.withColumn("rows", rows).withColumns({"outer": F.ceil(F.col("m") / F.col("rows")).cast("int"), "inner": F.ceil((F.col("n") - F.col("m")) / F.col("rows")).cast("int")})
    place = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    dealt = dealt.withColumn("own", F.when(F.col("apart"), place("outer")).otherwise(F.col("outer") + place("inner")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("apart"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)))
    dealt = dealt.select("g1", "g2", "p1", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")
    # Of a node, the buckets where it meets others, by their band: what tells whether a pair has met before.
    meets = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda p: F.coalesce(F.get(F.filter("held", lambda x: x["pos"] == p), F.lit(0))["band"], F.lit(0).cast("long")))
    marks = held.select("node", meets.alias("cool")).join(nodes.select("node", "sketch"), "node").join(texts, "node")
    dealt = dealt.join(marks, "node").repartition(parts, "g1", "g2", "i", "j").sortWithinPartitions("g1", "g2", "i", "j")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["g1", "g2", "i", "j"]):
            found = _links_of_group(group, size, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], names=["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def _links_of_group(group: pa.Table, size: int, percent: int) -> list[tuple[bytes, bytes]]:
    """Links between components of the members of a group, until it has no more to find."""
    import zstandard

    first = lambda name: group.column(name)[0].as_py()
    i, j, p1, least = first("i"), first("j"), first("p1"), least_agreement(percent)
    own, node, packed = group.column("own").to_numpy(), group.column("node").to_pylist(), group.column("packed").to_pylist()
    marks = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "u1").reshape(len(node), -1)
    cool = np.concatenate([np.asarray(c.flatten()) for c in group.column("cool").chunks]).reshape(len(node), -1)
    numbers: dict[bytes, int] = {}
    component = np.array([numbers.setdefault(r, len(numbers)) for r in group.column("root").to_pylist()])
    sets: dict[int, np.ndarray] = {}

    def set_of(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingle_sets([zstandard.decompress(packed[k]).decode()], size)[0]
        return sets[k]

    def met_here(x: int, others: np.ndarray) -> np.ndarray:
        """Of ``others``, those that x meets in no compared bucket before this one (of rare shingles: in none at all)."""
        same = (cool[others] == cool[x]) & (cool[x] != 0)
        return others[same.argmax(axis=1) == p1] if p1 >= 0 else others[~same.any(axis=1)]

    found = []
    for x in np.flatnonzero(own == i):
        others = np.flatnonzero((component != component[x]) & (own == j))
        others = others[others > x] if i == j else others
        others = others[(marks[others] == marks[x]).mean(axis=1) >= least] if len(others) else others
        others = met_here(x, others) if len(others) else others
        for at in range(0, len(others), 64):
            near = [y for y in others[at : at + 64] if component[y] != component[x]]
            if not near:
                continue
            mine, theirs = set_of(x), [set_of(y) for y in near]
            lengths = np.array([len(t) for t in theirs])
            both = np.concatenate(theirs)
            place = np.minimum(np.searchsorted(mine, both), len(mine) - 1)
            common = np.add.reduceat((mine[place] == both).astype("i8"), np.cumsum(lengths) - lengths)
            for y in np.array(near)[100 * common >= percent * (len(mine) + lengths - common)]:
                if component[y] != component[x]:
                    found.append((min(node[x], node[y]), max(node[x], node[y])))
                    component[component == component[y]] = component[x]
    return found


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of adjacent rows with equal ``keys``."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
        cuts = [0, *(n for n in range(1, len(values)) if values[n] != values[n - 1]), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if values[a] != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles, component_id and kept of every row of ``docs``."""
    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("body"))
    rows = written(_sketch_rows(source, size, percent), "minhash-rows")
    full = rows.where("node IS NOT NULL")
    first = F.min(F.struct("id", "text_key")).alias("first")
    nodes = full.groupBy("node").agg(F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.min("id").alias("min_id"), first, F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = written(nodes, "minhash-nodes")

    banded = nodes.select("node", "n_shingles", F.posexplode("bands").alias("pos", "band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
    members = written(split_hot_join(banded, written(buckets, "minhash-buckets"), ["band"], "n").select("band", "pos", "node", "n_shingles", "leader"), "minhash-members")
    pairs = written(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "minhash-pairs", FEWER)

    wanted = members.select("node").distinct().join(nodes.select("node", "first"), "node").select("node", F.col("first.id").alias("id"), F.col("first.text_key").alias("text_key"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches_of(batches, "body", 4 << 20):
            packed = [zstandard.compress(t.encode(), 3) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "packed"])

    same = source["id"].eqNullSafe(wanted["id"]) & (source["text_key"] == wanted["text_key"])
    texts = source.join(wanted, same).select("node", "body").mapInArrow(pack, "node binary, packed binary")
    texts = written(texts.dropDuplicates(["node"]), "minhash-texts")

    links = written(_verify(pairs, texts, size, percent), "minhash-links")
    roots = connected_components(links)
    more = written(_hidden_links(members, roots, nodes, texts, size, percent), "minhash-hidden")
    if more.limit(1).count():
        roots = connected_components(links.union(more))

    rooted = written(nodes.select("node", "copies", "min_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "minhash-roots", 2)
    smallest = rooted.groupBy("root").agg(F.count("*").alias("n"), F.min("min_id").alias("component_id"))
    named = written(split_hot_join(rooted, smallest, ["root"], "n").select("node", "copies", "component_id"), "minhash-names", 2)
    grouped = split_hot_join(full.select("id", "node", "n_shingles"), named, ["node"], "copies").select("id", "n_shingles", "component_id")
    alone = rows.where("node IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    return grouped.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, with the columns of ``docs``.

    Rows that repeat a kept id stay; rows with a null id stay if their group has no id.
    """
    kept = near_duplicates(docs, id_col, **options).where("kept").select(F.col(f"`{id_col}`").alias("kept_id")).distinct()
    return docs.join(kept, docs[f"`{id_col}`"].eqNullSafe(kept["kept_id"]), "left_semi")

"""N-gram Jaccard join over a prefix tree, and the groups of documents it links.

A document's set holds its distinct k-word shingles as 64-bit hashes in one global order: shingles that few
documents have, by hash, then the frequent ones. Equal sets form one class (128-bit digest), so copies cost one
row. Sets that can link must share one of their first n - ceil(t n) + 1 shingles; those postings bring candidate
classes together. Candidates are joined block against block: the sets of one block stand in a path-compressed
prefix tree, every set of the other block walks it, the overlap collected on a shared path is counted once for all
sets below, and subtrees are left as soon as the remaining lengths cannot reach the threshold.

First, for every posting list, the classes with the fewest rare shingles (originals rather than edited copies)
meet all others; what they link becomes one group. Then all groups that still share a posting meet whole, member
against member, so that no link between different groups is lost, while members of one group need no pairs.

Nulls, empty texts and texts without words have an empty set and stay alone. Repeated rows fall into one class.
Other columns pass by untouched; only ``doc_id`` and ``text`` are read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import materialise
from .common import NOT_SPACE, Words, bloom, components, mix, passes, pieces, split_by

WORDS = 5
PERCENT = 80
#: A shingle is frequent if more classes have it. Others count as frequent too where the bounded filter of these says so.
HOT_OVER = 32
#: Shingles a bucket of the counting shuffle holds, and sets a block of the join holds.
BUCKET_SHINGLES = 1 << 21
BLOCK_SETS = 256
HOT_BIT = np.uint64(1 << 63)
#: Sets travel with the upper 49 bits of a shingle: one false match in 10**8 pairs of 1000 shingles, and that only
#: matters to a pair one shingle below the threshold.
SHORTER = 15


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than k words is one shingle."""
    hashes, _ = words.grams(k)
    first, counts = words.first, words.counts
    for i in range(words.n):
        c = counts[i]
        if c >= k:
            yield np.unique(hashes[first[i]:first[i] + c - k + 1] >> np.uint64(1))
        elif c:
            yield words.word_spans(first[i:i + 1], first[i:i + 1] + c) >> np.uint64(1)
        else:
            yield hashes[:0]


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def key_of(d: bytes) -> int:
    """Signed 64-bit key of a class: half of its digest."""
    return int.from_bytes(d[:8], "little", signed=True)


def pack(values: np.ndarray) -> bytes:
    """Sorted uint64 values as compressed differences."""
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob, np.uint64), dtype=np.uint64)


def ordered(values: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """The set in global order: frequent shingles last, by hash otherwise."""
    return np.sort(np.where(passes(hot, mix(short_hash(values, bits))), values | HOT_BIT, values))


def least_overlap(a: int, b: int, percent: int) -> int:
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


# -- passes over the texts -----------------------------------------------------------------------

SETS = "doc_id long, text_key binary, key long, digest binary, n_shingles long"


def class_rows(k: int):
    """One row per document: its class and the size of its set."""

    def run(batches):
        for batch in pieces(batches):
            words = Words(batch.column("text"), NOT_SPACE, True)
            keys, digests, sizes = [], [], []
            for values in shingle_sets(words, k):
                d = digest(values)
                keys.append(key_of(d) if len(values) else None)
                digests.append(d)
                sizes.append(len(values))
            texts = [hashlib.md5((t or "").encode()).digest() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()), pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())],
                                             ["doc_id", "text_key", "key", "digest", "n_shingles"])

    return run


def short_hash(values: np.ndarray, bits: int) -> np.ndarray:
    """The bucket (top bits) and 32 more bits of shingle hashes: enough to bring sets together, since a bucket
    holds about BUCKET_SHINGLES shingles at any size of the corpus and whole sets are compared afterwards."""
    return (values & ~HOT_BIT) >> np.uint64(31 - bits)


def squeeze(a: np.ndarray) -> bytes:
    """Values by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes())


def expand(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Shipment:
    """Short hashes gathered by bucket and sent as one compressed row per bucket; with ``sets``, each hash also
    carries whether it is frequent and which set (key, size, rare shingles) it belongs to."""

    LIMIT = 4_000_000

    def __init__(self, sets: bool):
        self.sets, self.names = sets, ["bucket", "hashes"] + ["owner", "frequent", "table"] * sets
        self.clear()

    def clear(self):
        self.hashes, self.marks, self.table, self.held = [], [], [], 0

    def add(self, hashes: np.ndarray, marks: np.ndarray | None = None, row: tuple = ()) -> list[pa.RecordBatch]:
        self.hashes.append(hashes)
        if self.sets:
            self.marks.append(marks)
            self.table.append(row)
        self.held += len(hashes)
        return self.flush() if self.held >= self.LIMIT else []

    def flush(self) -> list[pa.RecordBatch]:
        if not self.held:
            return []
        hashes = np.concatenate(self.hashes)
        order = np.argsort(hashes)
        hashes = hashes[order]
        if self.sets:
            owner = np.repeat(np.arange(len(self.hashes), dtype=np.uint32), [len(h) for h in self.hashes])[order]
            marks, table = np.concatenate(self.marks)[order], np.array(self.table, np.int64)
        bucket = (hashes >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(hashes))):
            row = [int(bucket[lo]), pack(hashes[lo:hi] & np.uint64(0xFFFFFFFF))]
            if self.sets:
                own, place = np.unique(owner[lo:hi], return_inverse=True)
                row += [squeeze(place.astype(np.uint32)), squeeze(marks[lo:hi]), squeeze(table[own].ravel())]
            rows.append(row)
        self.clear()
        kinds = [pa.int64()] + [pa.binary()] * (len(self.names) - 1)
        return [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], self.names)]


def count_rows(k: int, bits: int):
    """Shingles of the documents by bucket; equal sets that one task meets are sent once."""

    def run(batches):
        ship, seen = Shipment(False), set()
        for batch in pieces(batches):
            words = Words(batch.column("text"), NOT_SPACE, True)
            for values in shingle_sets(words, k):
                if len(values) and not known(seen, values):
                    yield from ship.add(short_hash(values, bits))
        yield from ship.flush()

    return run


def known(seen: set, values: np.ndarray, most: int = 200_000) -> bool:
    """Whether the task had this set; forgets all when full, which only sends some sets twice."""
    key = digest(values)
    if key in seen:
        return True
    if len(seen) >= most:
        seen.clear()
    seen.add(key)
    return False


def frequent(over: int, shown=lambda hashes: hashes):
    """Short hashes, as ``shown``, of one bucket that more than ``over`` sent sets have."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values, counts = np.unique(np.concatenate([unpack(b) for b in pdf["hashes"]]), return_counts=True)
        return pd.DataFrame({"hash": shown(values[counts > over] | (np.uint64(pdf["bucket"].iloc[0]) << np.uint64(32))).view(np.int64)})

    return run


def posting_rows(k: int, bits: int, percent: int, hot_bytes):
    """The first shingles of each set, by bucket, with the set's key, size and number of rare shingles."""

    def run(batches):
        hot = np.frombuffer(hot_bytes.value, np.uint32)
        ship, seen = Shipment(True), set()
        for batch in pieces(batches):
            words = Words(batch.column("text"), NOT_SPACE, True)
            for values in shingle_sets(words, k):
                n = len(values)
                if n and not known(seen, values):
                    order = ordered(values, hot, bits)
                    head = order[:prefix_length(n, percent)]
                    yield from ship.add(short_hash(head, bits), (head >= HOT_BIT).view(np.uint8), (key_of(digest(values)), n, int(np.searchsorted(order, HOT_BIT))))
        yield from ship.flush()

    return run


#: A pair that rare shingles bring together (shared: how many of one bucket), or, with a shingle, one posting of a frequent one.
MEETINGS = "shingle long, a long, na int, ha int, b long, nb int, hb int, shared int"


def meetings(percent: int):
    """Of one bucket: pairs of classes that share rare first shingles, counted, and postings of frequent ones.

    h is how many frequent shingles are among the first ones of a set. A rare shingle has HOT_OVER classes at most, whose
    pairs are listed; postings of frequent shingles leave as they are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = [unpack(b) for b in pdf["hashes"]]
        tables = [expand(b, np.int64).reshape(-1, 3) for b in pdf["table"]]
        owner = np.concatenate([expand(b, np.uint32) + base for b, base in zip(pdf["owner"], np.cumsum([0] + [len(t) for t in tables]))])
        hot = np.concatenate([expand(b, np.uint8) for b in pdf["frequent"]])
        table, hashes = np.concatenate(tables), np.concatenate(hashes)
        order = np.lexsort((table[owner, 0], hashes))
        h, key = hashes[order], table[owner[order], 0]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
        order, h = order[new], h[new]
        many = np.zeros(len(h), bool)
        many[1:] = h[1:] == h[:-1]
        many[:-1] |= many[1:]
        order, h = order[many], h[many]
        row = table[owner[order]]
        key, n, rare = row.T if len(row) else np.zeros((3, 0), np.int64)
        first = n - (-(-percent * n // 100)) + 1
        frame = pd.DataFrame({"shingle": (h | (np.uint64(pdf["bucket"].iloc[0]) << np.uint64(32))).view(np.int64), "a": key, "na": n, "ha": np.maximum(0, first - rare)})
        is_hot = hot[order] == 1
        long = frame[is_hot].assign(b=None, nb=None, hb=None, shared=0)
        rare_rows = frame[~is_hot].to_numpy()
        x, y, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
        while d < len(rare_rows):
            i = np.flatnonzero(rare_rows[d:, 0] == rare_rows[:-d, 0])
            if not len(i):
                break
            x.append(i)
            y.append(i + d)
            d += 1
        x, y = rare_rows[np.concatenate(x)], rare_rows[np.concatenate(y)]
        near = percent * np.maximum(x[:, 2], y[:, 2]) <= 100 * np.minimum(x[:, 2], y[:, 2])
        pairs = pd.DataFrame(np.hstack([x[near][:, 1:], y[near][:, 1:]]), columns=["a", "na", "ha", "b", "nb", "hb"])
        pairs = pairs.groupby(["a", "na", "ha", "b", "nb", "hb"], as_index=False).size().rename(columns={"size": "shared"}).assign(shingle=None)
        names = ["shingle", "a", "na", "ha", "b", "nb", "hb", "shared"]
        return pd.concat([x.astype("Int64") for x in (long[names], pairs[names]) if len(x)]) if len(long) + len(pairs) else pd.DataFrame({c: pd.Series(dtype="Int64") for c in names})

    return run


def set_rows(k: int, bits: int, hot_bytes, wanted_bytes):
    """Ordered sets of the documents that stand for a wanted class (a Bloom filter of their ids; the few others
    that pass it find no partner in the joins)."""

    def run(batches):
        hot, wanted = np.frombuffer(hot_bytes.value, np.uint32), np.frombuffer(wanted_bytes.value, np.uint32)
        for batch in pieces(batches):
            doc = np.asarray(batch.column("doc_id").fill_null(0)).astype(np.int64)
            batch = batch.filter(pa.array(passes(wanted, doc.view(np.uint64))))
            if not batch.num_rows:
                continue
            keys, digests, blobs = [], [], []
            for values in shingle_sets(Words(batch.column("text"), NOT_SPACE, True), k):
                if len(values):
                    d = digest(values)
                    keys.append(key_of(d))
                    digests.append(d)
                    blobs.append(pack(ordered(values, hot, bits) >> np.uint64(SHORTER)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())], ["key", "digest", "items"])

    return run


# -- the tree ------------------------------------------------------------------------------------


class Node:
    """A path of shingles shared by all sets below; sizes bound what a subtree can still give."""

    __slots__ = ("path", "below", "ends", "small", "large")

    def __init__(self, path, below, ends, small, large):
        self.path, self.below, self.ends, self.small, self.large = path, below, ends, small, large


def build(sets: list[np.ndarray], ids: list[int], depth: int = 0) -> list[Node]:
    """Forest of sets sorted by (first, second, ... shingle); depth shingles are already on the way."""
    out, at = [], 0
    while at < len(ids):
        head = sets[ids[at]]
        to = at + 1
        while to < len(ids) and sets[ids[to]][depth] == head[depth]:
            to += 1
        last = sets[ids[to - 1]]
        m = min(len(head), len(last)) - depth
        differ = np.flatnonzero(head[depth:depth + m] != last[depth:depth + m])
        cut = depth + (int(differ[0]) if len(differ) else m)
        group = ids[at:to]
        ends = [i for i in group if len(sets[i]) == cut]
        sizes = [len(sets[i]) for i in group]
        out.append(Node(head[depth:cut], build(sets, group[len(ends):], cut), ends, min(sizes), max(sizes)))
        at = to
    return out


def tree(sets: list[np.ndarray]) -> list[Node]:
    return build(sets, sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: sets[i].astype(">u8").tobytes()))


def matches(forest: list[Node], asked: np.ndarray, percent: int, skip=None) -> Iterator[int]:
    """Sets of the forest that link with ``asked``; those that skip(i) is true for need not be told."""
    n = len(asked)
    low, high = -(-percent * n // 100), 100 * n // percent
    stack = [(node, 0, 0, 0) for node in forest]
    while stack:
        node, depth, position, overlap = stack.pop()
        if node.large < low or node.small > high or skip and not node.below and all(map(skip, node.ends)):
            continue
        need = least_overlap(n, max(node.small, low), percent)
        if overlap + min(n - position, node.large - depth) < need:
            continue
        at = np.searchsorted(asked[position:], node.path)
        hit = at < n - position
        hit[hit] = asked[position:][at[hit]] == node.path[hit]
        overlap += int(np.count_nonzero(hit))
        depth += len(node.path)
        position += int(at[-1]) + int(hit[-1])
        if overlap + min(n - position, node.large - depth) < need:
            continue
        if overlap >= least_overlap(n, depth, percent):
            yield from (i for i in node.ends if not (skip and skip(i)))
        stack.extend((x, depth, position, overlap) for x in node.below)


LINKS = "a binary, b binary"


class Groups:
    """Union-find over group names."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    def join(self, x, y) -> bool:
        p, q = self.find(x), self.find(y)
        self.parent[p] = q
        return p != q


def block_links(percent: int):
    """mapInArrow step over rows of blocks ``askers`` and, where there is one, ``base`` (else the block meets
    itself): links that join different groups, a spanning forest of each row at most."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                base, groups, a, b = r.get("base") or r["askers"], Groups(), [], []
                sets = [unpack(y["items"]) for y in base]
                forest = tree(sets)
                for k, x in enumerate(r["askers"]):
                    itself = "base" not in r
                    asked = sets[k] if itself else unpack(x["items"])
                    for i in matches(forest, asked, percent, lambda i: itself and i >= k or groups.find(base[i]["grp"]) == groups.find(x["grp"])):
                        if groups.join(x["grp"], base[i]["grp"]):
                            a.append(x["digest"])
                            b.append(base[i]["digest"])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def blocked(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Sets packed into blocks of BLOCK_SETS per ``by`` (spread by position, groups of any size)."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    spread = F.pmod(F.xxhash64("digest"), F.ceil(F.col("_n") / BLOCK_SETS).cast("long")).cast("int")
    return (rows.join(counts, by).withColumn(f"{name}_block", spread).groupBy(*by, f"{name}_block")
            .agg(F.collect_list(F.struct("digest", "grp", "items")).alias(name)))


# -- the join ------------------------------------------------------------------------------------


def linked_classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents with their class, classes with their component).

    documents: doc_id, text_key, key, digest, n_shingles, one row per input row. classes: digest, grp (the same for
    linked classes), component (their smallest doc_id), for every class with a non-empty set."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(texts.mapInArrow(class_rows(k), SETS), "classes")
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(F.first("key").alias("key"), F.min("doc_id").alias("doc_id"))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    bits = int(total // BUCKET_SHINGLES).bit_length()
    buckets = 1 << bits

    hot = (texts.mapInArrow(count_rows(k, bits), "bucket long, hashes binary").repartition(buckets, "bucket")
           .groupBy("bucket").applyInPandas(frequent(HOT_OVER, mix), "hash long"))
    hot_bytes = spark.sparkContext.broadcast(bloom(materialise(hot, "frequent"), "hash").tobytes())

    met = (texts.mapInArrow(posting_rows(k, bits, percent, hot_bytes), "bucket long, hashes binary, owner binary, frequent binary, table binary")
           .repartition(buckets, "bucket").groupBy("bucket").applyInPandas(meetings(percent), MEETINGS))
    met = materialise(met, "meetings")

    # What two sets share beyond their first shingles is at most the rest of one of them, so the first ones must
    # make up for what is missing; frequent ones count as shared as far as both have them.
    def rest(n):
        return f"(ceil({percent} * {n} / 100) - 1)"

    def missing(x, y):
        return f"(ceil({percent} * ({x} + {y}) / {100 + percent}) - greatest({rest(x)}, {rest(y)}))"

    pairs = met.where("shingle IS NULL").groupBy("a", "na", "ha", "b", "nb", "hb").agg(F.sum("shared").alias("shared"))
    lists = met.where("shingle IS NOT NULL").select("shingle", F.col("a").alias("key"), F.col("na").alias("n"), F.col("ha").alias("h"))
    pairs = (pairs.where(f"shared + least(ha, hb) >= {missing('na', 'nb')}").select(F.col("b").alias("hub"), F.col("a").alias("key")))

    # originals first: of each frequent shingle's classes, the one with the most frequent shingles for its size meets the others
    hubs = (lists.groupBy("shingle").agg(F.min(F.struct((F.col("n") - F.col("h")).alias("rest"), "n", "h", "key")).alias("x"))
            .select("shingle", F.col("x.key").alias("hub"), F.col("x.n").alias("hn"), F.col("x.h").alias("hh")))
    stars = (lists.join(hubs, "shingle").where("key <> hub").where(f"{percent} * greatest(n, hn) <= 100 * least(n, hn) AND least(h, hh) >= {missing('n', 'hn')}")
             .select("hub", "key"))
    asked = materialise(pairs.unionByName(stars).distinct(), "pairs")

    # sets are wanted from the classes in a pair or a frequent list; a null doc_id is found under id 0, as set_rows reads it
    wanted = lists.select("key").unionByName(asked.select("key")).unionByName(asked.select(F.col("hub").alias("key"))).distinct().join(classes, "key")
    wanted_bytes = spark.sparkContext.broadcast(bloom(wanted.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id")), "doc_id").tobytes())
    sets = materialise(texts.mapInArrow(set_rows(k, bits, hot_bytes, wanted_bytes), "key long, digest binary, items binary"), "sets")

    # each cluster of pairs meets in one tree; clusters beyond a block meet block against block where they have pairs
    clusters = components(asked.select(F.col("hub").alias("a"), F.col("key").alias("b")))
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK_SETS).cast("long")).cast("int")
    placed = materialise(clusters.join(sizes, "component").select(F.col("node").alias("key"), F.col("component").alias("cluster"), block.alias("block")), "clusters")
    left, right = placed.select(F.col("key").alias("hub"), "cluster", F.col("block").alias("x")), placed.select("key", F.col("block").alias("y"))
    tasks = asked.join(left, "hub").join(right, "key").select("cluster", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).distinct()
    seats = tasks.withColumn("block", F.explode(F.array_distinct(F.array("i", "j")))).join(placed, ["cluster", "block"]).select("key", "cluster", "i", "j")
    first = (seats.join(sets, "key").groupBy("cluster", "i", "j").agg(F.collect_list(F.struct("digest", F.col("digest").alias("grp"), "items")).alias("askers"))
             .select("askers").mapInArrow(block_links(percent), LINKS))
    first = materialise(first, "links")

    # then whole groups that still share a frequent shingle
    named = sets.select("key", "digest").join(components(first).withColumnRenamed("node", "digest"), "digest", "left").select("digest", "key", F.coalesce("component", "digest").alias("grp"))
    named = materialise(named.distinct(), "groups")
    seen = (lists.join(named.select("key", "grp"), "key").groupBy("shingle", "grp")
            .agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("h").alias("h"), F.count(F.lit(1)).alias("c")))
    open_lists = seen.groupBy("shingle").agg(F.count(F.lit(1)).alias("g")).where("g > 1").select("shingle")
    seen = seen.join(open_lists, "shingle")
    x, y = seen.alias("x"), seen.alias("y")
    can = (f"{percent} * x.lo <= 100 * y.hi AND {percent} * y.lo <= 100 * x.hi AND least(x.h, y.h) >= "
           f"ceil({percent} * (x.lo + y.lo) / {100 + percent}) - greatest({rest('x.hi')}, {rest('y.hi')})")
    meets = (x.join(y, F.col("x.shingle") == F.col("y.shingle")).where(F.struct("x.c", "x.grp") > F.struct("y.c", "y.grp")).where(can)
             .select(F.least("x.grp", "y.grp").alias("p"), F.greatest("x.grp", "y.grp").alias("q")).distinct())
    sizes = named.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    p, q = F.struct("ps", "p"), F.struct("qs", "q")  # the smaller group asks
    meets = (meets.join(sizes.select(F.col("grp").alias("p"), F.col("size").alias("ps")), "p").join(sizes.select(F.col("grp").alias("q"), F.col("size").alias("qs")), "q")
             .select(F.when(p > q, F.col("p")).otherwise(F.col("q")).alias("to"), F.when(p > q, F.col("q")).otherwise(F.col("p")).alias("grp")))
    meets = materialise(meets, "meets")
    grouped = named.select("digest", "grp").join(sets.select("digest", "items"), "digest")
    askers = blocked(meets.join(grouped, "grp").select("to", "digest", "grp", "items"), ["to"], "askers")
    base = blocked(grouped.join(meets.select(F.col("to").alias("grp")).distinct(), "grp").select(F.col("grp").alias("to"), "digest", "grp", "items"), ["to"], "base")
    second = askers.join(base, "to").select("askers", "base").mapInArrow(block_links(percent), LINKS)

    whole = components(first.unionByName(second))
    ends = classes.join(whole.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "doc_id", F.coalesce("component", "digest").alias("grp"))
    lowest = ends.groupBy("grp").agg(F.min("doc_id").alias("component"))
    return rows, ends.join(lowest, "grp").select("digest", "grp", "component")


def jaccard_groups(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable over links of at least ``percent`` percent
    Jaccard similarity, the document itself included. One row per input row; a null doc_id stays null unless its
    group has another."""
    rows, classes = linked_classes(docs, k, percent)
    small = classes.where(F.col("component").isNotNull())
    return (rows.join(small, "digest", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each_group(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each linked group, the one with the smallest doc_id (nulls last), all columns as given; documents
    without words stay. Rows meet their decision by (doc_id, text), so rows without an id, and different texts
    under one id, go only with their own group. Only rows that go, and repeated ones, are shuffled."""
    rows, classes = linked_classes(docs, k, percent)
    rows = rows.where("n_shingles > 0").groupBy("digest", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    stay = (rows.groupBy("digest").agg(first).join(classes, "digest").groupBy("grp").agg(F.min("first").alias("first"))
            .select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"), F.lit(True).alias("stays")))

    def same(a, b):
        return a["_id"].eqNullSafe(b["_id"]) & (a["_key"] == b["_key"])

    all_ = rows.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n")
    marks = all_.join(stay, same(all_, stay), "left").select(all_["_id"].alias("_mid"), all_["_key"].alias("_mkey"), F.coalesce("stays", F.lit(False)).alias("_stays"), "n")
    marks = materialise(marks.where("NOT _stays OR n > 1").drop("n"), "marks")
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_key": F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))})
    whole, open_ = split_by(keyed, F.xxhash64("_id", "_key"), marks.select(F.xxhash64("_mid", "_mkey").alias("k")))
    met = open_.join(marks, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_key") == F.col("_mkey")), "left")
    once = met.where("_stays").dropDuplicates(["_id", "_key"])
    return (whole.select(*docs.columns).unionByName(met.where("_stays IS NULL").select(*docs.columns))
            .unionByName(once.select(*docs.columns)))

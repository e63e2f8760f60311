"""Prefix trie of rebuilt conversations by a splitter skeleton.

Conversation c is the first h turns of conversation c - c % 100 and its own turns after its first h,
h = crc32(c) % 6. Its path is cut into bands of ``BAND`` turns, one row each, keyed by the hash of all turns before
the band; so a row is bounded, however long the conversation. Rows are dealt by range of (band, hash before,
path, conv_id) into shards. The range's splitters come from a sample by hash that has ``OVERSAMPLE`` rows for each
shard; the prefixes of the splitter paths are the skeleton, which is broadcast. A node outside it has all its
members in one shard, which finishes it: sorted members, one pass a depth from the deepest up. Nodes of the skeleton
give one partial row a shard, and these are added up; what a skeleton node itself adds to its subtree goes up along
the path that its partial rows carry. Copies of a path differ by conv_id, so they spread over shards too.

Subtree sums of a band's nodes need those of the bands below. Sums of each later band's roots are taken first, by the
root's smallest member, and hung on that member's rows in all bands above: each ancestor has exactly one of them.

Turns go by (turn, null first; then the digest of role and text); null role and text are empty, so is a conversation
left without turns, which is a member of the root alone. Rows without a conv_id belong to no conversation and are left
out; repeated rows are repeated turns. Turns are equal by 128 bits of hash. Positions come from a global sort
by (conv_id, turn), so a conversation with a third of all turns is many ranges; one row a band of it goes through
one window. The SHA-256 of a node's ending members is a running one: they stream through one task, packed by shard.
Empty tables give no rows, other columns are left out."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..operators.scale import dense_index, materialise, salted_join

BAND = 64
SHARD_ROWS = 1 << 12
MOST_SHARDS = 1 << 14
OVERSAMPLE = 8
GROUP, HEADS = 100, 5
HEADER, STEP = 24, 17
SPREAD = 0x9E3779B97F4A7C15
NODE = ["depth", "h1", "h2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

SCANNED = ("kind string, depth long, h1 long, h2 long, skel boolean, conv long, n long, children long, leaves long, saved long, size long, "
           "parent_conv long, p1 long, p2 long, up array<struct<root: boolean, depth: long, h1: long, h2: long>>, first_end long, ends string")


# -- conversations as rows of bounded paths ----------------------------------------------------------


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, x1, x2, size, total): turn k of each rebuilt conversation, and a row k = 0 for every conversation."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("size"),
        F.xxhash64(F.monotonically_increasing_id()).alias("tie"))  # equal rows need not meet
    rows = dense_index(rows, [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("digest"), F.col("tie")], "g").select("conv_id", "digest", "size", "g")
    convs = rows.groupBy("conv_id").agg(F.min("g").alias("start"), F.count(F.lit(1)).alias("n"))
    convs = convs.withColumns({"base": F.expr(f"conv_id - conv_id % {GROUP}"), "h": F.expr(f"crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {HEADS + 1}")})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = materialise(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
                        .withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("base_n"), "convs")
    placed = salted_join(rows, convs.select("conv_id", "start", "h", "taken", "total"), ["conv_id"], ["g"])
    placed = materialise(placed.withColumn("pos", F.col("g") - F.col("start") + 1).drop("g", "start"), "placed")
    own = placed.where("pos > h").withColumn("k", F.expr("taken + pos - h"))
    heads = (placed.where(f"pos <= {HEADS}").select(F.col("conv_id").alias("base"), F.col("pos").alias("k"), "digest", "size")
             .join(convs.select("conv_id", "base", "h", "total"), "base").where("k <= h"))
    marks = convs.select("conv_id", F.lit(0).cast("long").alias("k"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("size"), "total")
    names = ["conv_id", "k", "digest", "size", "total"]
    rows = own.select(*names).unionByName(heads.select(*names)).unionByName(marks)
    return rows.select("conv_id", "k", *[F.when(F.col("k") > 0, F.xxhash64(F.lit(i), "k", "digest")).otherwise(0).alias(f"x{i}") for i in (1, 2)], "size", "total")


def bands(turns: DataFrame, band: int) -> DataFrame:
    """(conv_id, band, r1, r2, path, more, key): r is the hash of all turns before the band, more whether any come after it."""
    cut = F.floor(F.greatest(F.col("k") - 1, F.lit(0)) / band).cast("long")
    rows = turns.groupBy("conv_id", cut.alias("band")).agg(
        F.sort_array(F.collect_list(F.when(F.col("k") > 0, F.struct("k", "x1", "x2", "size")))).alias("path"),
        F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"), F.max("total").alias("total"))
    before = W.partitionBy("conv_id").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"r{i}": F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)) for i in (1, 2)})

    def word(c):
        return F.lpad(F.hex(c), 16, "0")

    steps = F.array_join(F.transform("path", lambda p: F.concat(F.lit("01"), word(p["x1"]), word(p["x2"]))), "")
    more = F.col("total") > (F.col("band") + 1) * band
    # of a node's members those that end there come first, then by conv_id
    key = F.unhex(F.concat(word(F.col("band")), word(F.col("r1")), word(F.col("r2")), steps, F.when(more, "01").otherwise("00"), word(F.col("conv_id").bitwiseXOR(F.lit(-(1 << 63))))))
    return rows.select("conv_id", "band", "r1", "r2", "path", more.alias("more"), key.alias("key"))


# -- shards and the skeleton -------------------------------------------------------------------------


def splitters(rows: DataFrame) -> list[bytes]:
    shards = min(MOST_SHARDS, max(1, math.ceil(rows.count() / SHARD_ROWS)))
    if shards == 1:
        return []
    drawn = rows.select("key", F.xxhash64("conv_id", "band").alias("draw")).orderBy("draw", "key").limit(OVERSAMPLE * shards)
    keys = sorted(drawn.toArrow()["key"].to_pylist())
    return [keys[i * len(keys) // shards] for i in range(1, shards)]


def skeleton(cuts: list[bytes]) -> dict[int, np.ndarray]:
    """For each depth in a band the marks (band and first hash) of the splitters' prefixes."""
    found: dict[int, set[int]] = {}
    for key in cuts:
        band, h1 = (int.from_bytes(key[a:a + 8]) for a in (0, 8))
        steps = (len(key) - HEADER - 9) // STEP
        for d in range(steps + 1):
            if d:
                at = HEADER + STEP * (d - 1) + 1
                h1 ^= int.from_bytes(key[at:at + 8])
            found.setdefault(d, set()).add((h1 + band * SPREAD) & (1 << 64) - 1)
    return {d: np.array(sorted(marks), np.uint64) for d, marks in found.items()}


class Shard:
    """Rows of one shard in order of their keys, and its nodes depth by depth."""

    def __init__(self, table: pa.Table, frame: dict[int, np.ndarray]):
        keys = table["key"].to_pylist()
        table = table.take(pa.array(sorted(range(len(keys)), key=keys.__getitem__)))
        col = {n: np.asarray(table[n].combine_chunks()) for n in ("conv_id", "band", "r1", "r2", "hang_leaves", "hang_saved")}
        self.conv, self.band, self.more = col["conv_id"], col["band"], table["more"].to_numpy().astype(bool)
        self.leaves, self.saved = col["hang_leaves"].copy(), col["hang_saved"].copy()
        path = table["path"].combine_chunks()
        offs = np.asarray(path.offsets).astype(np.int64)
        flat = path.flatten()
        self.len = np.diff(offs)
        x1, x2, size = (np.asarray(flat.field(n)) for n in ("x1", "x2", "size"))
        h1, h2 = col["r1"].copy(), col["r2"].copy()
        self.levels = []
        rows = np.arange(len(keys))
        above = None
        for d in range(int(self.len.max(initial=0)) + 1):
            if d:
                rows = rows[self.len[rows] >= d]
                at = offs[rows] - offs[0] + d - 1
                h1[rows] ^= x1[at]
                h2[rows] ^= x2[at]
            same = np.zeros(len(rows), bool)
            a, b = rows[:-1], rows[1:]
            same[1:] = (self.band[a] == self.band[b]) & (h1[a] == h1[b]) & (h2[a] == h2[b])
            if d:
                same[1:] &= above[a] == above[b]
            first = np.flatnonzero(~same)
            lead = rows[first]
            level = {"rows": rows, "first": first, "h1": h1[lead].copy(), "h2": h2[lead].copy(), "band": self.band[lead],
                     "conv": np.minimum.reduceat(self.conv[rows], first), "n": np.diff(np.append(first, len(rows))),
                     "size": size[at[first]] if d else np.zeros(len(first), np.int64), "up": above[lead] if d else None}
            marks = level["h1"].view(np.uint64) + level["band"].astype(np.uint64) * np.uint64(SPREAD)
            level["skel"] = np.isin(marks, frame.get(d, np.zeros(0, np.uint64)))
            if not d:
                level["skel"] |= level["band"] == 0
            node = np.full(len(keys), -1)
            node[rows] = np.cumsum(~same) - 1
            above = node
            self.levels.append(level)

    def rows(self, band: int):
        """Rows of ``SCANNED``, deepest nodes first."""
        for d in range(len(self.levels) - 1, -1, -1):
            v = self.levels[d]
            rows, first = v["rows"], v["first"]
            nodes = len(first)
            below = self.levels[d + 1] if d + 1 < len(self.levels) else None
            children = np.bincount(below["up"][~below["skel"]], minlength=nodes) if below is not None else np.zeros(nodes, np.int64)
            any_child = np.bincount(below["up"], minlength=nodes) > 0 if below is not None else np.zeros(nodes, bool)
            more = np.logical_or.reduceat(self.more[rows] & (self.len[rows] == d), first) & (d == band)
            leaves, saved = np.add.reduceat(self.leaves[rows], first), np.add.reduceat(self.saved[rows], first)
            own = ~v["skel"] & (d > 0)
            leaf, save = (own & ~any_child & ~more).astype(np.int64), np.where(own, (v["n"] - 1) * v["size"], 0)
            self.leaves[rows[first]] += leaf
            self.saved[rows[first]] += save
            leaves, saved = leaves + leaf, saved + save
            ended = (self.len[rows] == d) & ~self.more[rows]
            n_ended = np.add.reduceat(ended.astype(np.int64), first)
            high = self.levels[d - 1] if d else None
            for i in range(nodes):
                depth = int(v["band"][i]) * band + d
                root = d == 0 and v["band"][i] > 0
                part = bool(v["skel"][i] or more[i])
                ids = self.conv[rows[first[i]:first[i] + n_ended[i]]].tolist()  # rows that end come first
                text = ",".join(map(str, ids))
                parent_conv = p1 = p2 = up = None
                if d:
                    j = v["up"][i]
                    if high["skel"][j] or d == 1:  # members that end with the band before have no row in this one
                        p1, p2 = int(high["h1"][j]), int(high["h2"][j])
                    else:
                        parent_conv = int(high["conv"][j])
                if v["skel"][i] and not root:
                    up = self.above(d, i, band)
                ends = None if root else text if part else hashlib.sha256(text.encode()).hexdigest()
                yield ("root" if root else "part" if part else "node", depth, int(v["h1"][i]), int(v["h2"][i]), bool(v["skel"][i]), int(v["conv"][i]),
                       int(v["n"][i]), int(children[i]), int(leaves[i]), int(saved[i]), int(v["size"][i]), parent_conv, p1, p2, up,
                       ids[0] if ids and part else None, ends)

    def above(self, d: int, i: int, band: int) -> list[dict]:
        out = []
        while True:
            v = self.levels[d]
            out.append({"root": bool(d == 0 and v["band"][i] > 0), "depth": int(v["band"][i]) * band + d, "h1": int(v["h1"][i]), "h2": int(v["h2"][i])})
            if not d:
                return out
            i = v["up"][i]
            d -= 1


def scan(rows: DataFrame, band: int) -> DataFrame:
    """``SCANNED`` rows of all shards, written once."""
    sc = rows.sparkSession.sparkContext
    cuts = splitters(rows)
    shipped = sc.broadcast((cuts, skeleton(cuts)))

    @pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(shipped.value[0], bytes(k)) for k in keys], dtype="int32")

    names = [c.split(" ")[0] for c in SCANNED.replace("struct<root: boolean, depth: long, h1: long, h2: long>", "s").split(", ")]
    up = pa.list_(pa.struct([("root", pa.bool_()), ("depth", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]))
    kinds = {"kind": pa.string(), "skel": pa.bool_(), "up": up, "ends": pa.string()}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])

    def nodes(table: pa.Table) -> pa.Table:
        found = list(Shard(table, shipped.value[1]).rows(band))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    return materialise(rows.withColumn("shard", shard("key")).groupBy("shard").applyInArrow(nodes, SCANNED), "trie")


# -- reduction ---------------------------------------------------------------------------------------


def reduced(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes of the skeleton and nodes that end a band, roots of later bands): partial rows added up."""
    parts = found.where("kind = 'part'").groupBy(*NODE).agg(
        F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.max("size").alias("size"), F.max("skel").alias("skel"),
        F.max("parent_conv").alias("parent_conv"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.first("up", True).alias("up"))
    roots = found.where("kind = 'root'").groupBy(*NODE).agg(F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    below = roots.select(*NODE, F.col("children").alias("more")).unionByName(
        parts.where("skel AND p1 IS NOT NULL").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count(F.lit(1)).alias("more")))
    parts = parts.join(below.groupBy(*NODE).agg(F.sum("more").alias("more")), NODE, "left")
    parts = materialise(parts.withColumn("children", F.expr("children + coalesce(more, 0)")).drop("more"), "parts")
    own = parts.where("skel AND up IS NOT NULL").select(
        F.explode("up").alias("u"), F.expr("CAST(children = 0 AND depth > 0 AS BIGINT)").alias("leaf"), F.expr("(n - 1) * size").alias("save"))
    own = own.select("u.*", "leaf", "save").groupBy("root", *NODE).agg(F.sum("leaf").alias("leaf"), F.sum("save").alias("save"))

    def with_own(rows, root):
        return (rows.join(own.where(F.col("root") == root).drop("root"), NODE, "left")
                .withColumns({"leaves": F.expr("leaves + coalesce(leaf, 0)"), "saved": F.expr("saved + coalesce(save, 0)")}).drop("leaf", "save"))

    return with_own(parts, False), with_own(roots, True)


def end_digests(found: DataFrame) -> DataFrame:
    """(node, ends_sha256) of partial nodes: the packed ids of all shards in order."""

    def run(batches):
        now, digest, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                node = tuple(row[c] for c in NODE)
                if node != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(row["ends"].encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*NODE, "ends_sha256"])
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, digest.hexdigest())], [*NODE, "ends_sha256"])

    packed = found.where("kind = 'part' AND first_end IS NOT NULL").select(*NODE, "first_end", "ends")
    return packed.repartition(*NODE).sortWithinPartitions(*NODE, "first_end").mapInArrow(run, "depth long, h1 long, h2 long, ends_sha256 string")


def trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    rows = materialise(bands(rebuilt_turns(conversations), band), "bands")
    none = rows.withColumns({c: F.lit(0).cast("long") for c in ("hang_leaves", "hang_saved")})
    _, roots = reduced(scan(none.where("band > 0"), band))
    later = roots.groupBy(F.col("conv").alias("conv_id"), (F.col("depth") / band).cast("long").alias("band")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    after = W.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, -1)
    hung = rows.join(later, ["conv_id", "band"], "left").withColumns({f"hang_{c}": F.coalesce(F.sum(c).over(after), F.lit(0)) for c in ("leaves", "saved")})
    found = scan(materialise(hung.drop("leaves", "saved"), "hung"), band)
    parts, _ = reduced(found)
    parts = materialise(parts.drop("up").join(end_digests(found), NODE, "left").fillna({"ends_sha256": EMPTY_SHA}), "parts")
    names = ["conv", "depth", "parent_conv", "p1", "p2", "n", "children", "leaves", "saved", "ends_sha256"]
    nodes = found.where("kind = 'node'").withColumnRenamed("ends", "ends_sha256").select(*names).unionByName(parts.select(*names))
    tops = parts.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv").alias("top"))
    open_ones = salted_join(nodes.where("p1 IS NOT NULL"), tops, ["depth", "p1", "p2"], ["conv", "n", "saved"])
    nodes = nodes.where("p1 IS NULL").unionByName(open_ones.withColumn("parent_conv", F.col("top")).drop("top"))
    return nodes.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")

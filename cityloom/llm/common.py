"""Kernels shared by the operators: words and rolling hashes over whole Arrow string columns, a size-bounded
Bloom filter, one row per group streamed, and connected components.

Words are found and hashed on the UTF-8 bytes of many texts at once. Hashes are 64 bits wide and mixed; they
bring rows together, and results that depend on equal text are confirmed on whole sets or on several words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..operators.scale import discard, materialise

CHUNK_BYTES = 1 << 20
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
STEP = 0xD1342543DE82EF95
#: Bytes that separate words: blank and \x09-\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes inside letter-and-digit words once A-Z is lower case: digits, letters, everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[128:] = True
ALNUM[48:58] = True
ALNUM[97:123] = True
ALNUM[65:91] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(None)
def _bytes_table(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP))
    if fold:
        values[65:91] = values[97:123]
    return values


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least n of them."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def span_hash(values: np.ndarray, base: int):
    """f(starts, ends): position-free hash of each span of ``values``."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)) if len(values) else values, out=total[1:])
    back = pow(base, -1, 1 << 64)

    def spans(starts, ends):
        return mix((total[ends] - total[starts]) * powers(back, len(values) + 1)[starts] + (ends - starts).astype(np.uint64) * np.uint64(STEP))

    return spans


class Texts:
    """The bytes of several texts, one after the other; text i is data[offs[i]:offs[i + 1]]."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("")
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        buffers = column.buffers()
        n = len(column)
        offs = np.frombuffer(buffers[1], kind)[column.offset:column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        self.data, self.offs, self.n = raw[offs[0]:offs[-1]], offs - offs[0], n

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many flags are set inside each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs that do not cross texts."""
        offs = self.offs
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        filled = offs[1:] > offs[:-1]
        heads, tails = offs[:-1][filled], offs[1:][filled] - 1
        begin[heads] = inside[heads]
        stop[tails] = inside[tails]
        return np.flatnonzero(begin), np.flatnonzero(stop) + 1


class Words(Texts):
    """Words of several texts: byte spans, hashes, and for each text the index of its first word."""

    def __init__(self, column: pa.Array, inside: np.ndarray, fold: bool):
        super().__init__(column)
        self.is_word = inside[self.data]
        self.start, self.end = self.runs(self.is_word)
        self.bytes_hash = span_hash(_bytes_table(fold)[self.data], BASE)
        self.hash = self.bytes_hash(self.start, self.end)
        self.first = np.searchsorted(self.start, self.offs)
        self.counts = np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie inside the word's text."""
        n = len(self.hash)
        i = np.arange(n)
        ok = i + k <= np.repeat(self.first[1:], self.counts)
        return self.word_spans(i, np.minimum(i + k, n)), ok

    def word_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_spans"):
            self._spans = span_hash(self.hash, STEP)
        return self._spans(starts, ends)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about CHUNK_BYTES of text, so that memory does not follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + CHUNK_BYTES)))
            yield batch.slice(at, to - at)
            at = to


# -- Bloom filter --------------------------------------------------------------------------------

BLOOM_BITS = (16, 27)


def bloom(df: DataFrame, column: str) -> np.ndarray:
    """Bits for the 64-bit values of a column. About 32 bits a value, never more than 2**27 (16 MB); what passes
    it is always checked again by a join, so a full filter costs time and no result."""
    n = df.count()
    bits = min(BLOOM_BITS[1], max(BLOOM_BITS[0], (32 * n).bit_length()))
    v = F.col(column)
    spot = F.explode(F.array(*[F.shiftrightunsigned(v, s).bitwiseAND(F.lit((1 << bits) - 1)) for s in (0, 64 - bits, 18)]))
    rows = (df.where(v.isNotNull()).select(spot.alias("p"))
            .groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 31 AS INT))")).alias("b")).toArrow())
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    return out


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which uint64 values may be in the filter."""
    width = len(bits).bit_length() - 1 + 5
    ok = np.ones(len(values), bool)
    for s in (0, 64 - width, 18):
        p = (values >> np.uint64(s)) & np.uint64((1 << width) - 1)
        ok &= (bits[(p >> np.uint64(5)).astype(np.int64)] >> (p & np.uint64(31)).astype(np.uint32)) & 1 == 1
    return ok


def split_by(docs: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key, a long without nulls, is surely not in ``wanted``, a table of one such column; all others). Only the others, the
    wanted ones and a few more, need to be shuffled for an exact join; whole texts stay where they are."""
    name = wanted.columns[0]
    bits = docs.sparkSession.sparkContext.broadcast(bloom(wanted, name).tobytes())

    @pandas_udf("boolean")
    def may(keys: pd.Series) -> pd.Series:
        return pd.Series(passes(np.frombuffer(bits.value, np.uint32), keys.to_numpy(np.int64).view(np.uint64)))

    rows = docs.withColumn("_may", may(key))
    return rows.where("NOT _may").drop("_may"), rows.where("_may").drop("_may")


# -- connected components ------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b): component is the smallest reachable node.

    Large-star and small-star rounds over aggregated minima; the links of each round are written to the shared
    folder, those of the round before deleted; rounds end when count and 128 bits of checksum stay. No neighbour list is gathered; rounds grow with the logarithm of the longest chain."""
    def state(rows: DataFrame) -> tuple:
        return rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()

    spark = links.sparkSession
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
                 .select("e.*").where("a <> b").distinct())
        after = materialise(small, "edges")
        discard(spark, [edges.written_to])
        edges, now = after, state(after)
        if now == before:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now

"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text, h = 2 h + G[byte]; a chunk ends where the bits of h that know the last
16 bytes are zero, about every 32 bytes, never sooner than ``LEAST`` or later than ``MOST`` bytes after the chunk's
start. Boundaries depend on the bytes around them alone, so equal passages are cut alike wherever they stand, and
an insertion moves no boundary beyond its own chunk. Chunks are compared by a 128-bit digest; the first occurrence in
(doc_id, place) order stays. Repeated chunks that follow each other form one span, and spans of ``SPAN`` bytes or more count.

Short hashes of all chunks, each once per task, are counted by bucket; those that occur twice fill a Bloom filter
of bounded size, and only chunks that pass it are sent as rows. Their first places are pre-aggregated minima. Chunks
that tasks sent more than ``HOT`` times fill a second such filter; their rows meet the first place under ``SALTS``
sub-keys, so a passage in a third of all documents stays spread.

Null and empty texts have no chunks. Repeated rows are repeats of the row with the smallest id; rows with equal
id are told apart by their text, and equal ones count as one document. Only ``doc_id`` and ``text`` are read."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import materialise
from .common import Texts, bloom, mix, passes, pieces
from .jaccard_join import BUCKET_SHINGLES, Shipment, short_hash, unpack

KNOWN = 16
MASK = np.uint32(0b11111 << (KNOWN - 5))
LEAST, MOST = 8, 512
SPAN = 64
#: Times that tasks send a chunk's hash (at most twice each time they send) beyond which its rows are spread, and over how many sub-keys.
HOT, SALTS = 64, 16
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)


def boundaries(texts: Texts) -> np.ndarray:
    """Byte offsets where chunks end, over all texts; every text's end is one."""
    n = len(texts.data)
    place = np.arange(n) - np.repeat(texts.offs[:-1], np.diff(texts.offs))
    h, width = GEAR[texts.data], 1
    while width < KNOWN:
        older = np.zeros(n, np.uint32)
        older[width:] = h[:-width] << np.uint32(width)
        older[place < width] = 0
        h = h + older
        width *= 2
    marks = np.flatnonzero((h & MASK) == 0) + 1
    ends = np.union1d(marks, texts.offs[1:])
    stops = set(texts.offs[1:].tolist())
    out, at = [], 0
    for e in ends.tolist():
        while e - at > MOST:
            at += MOST
            out.append(at)
        if e - at >= LEAST or e in stops:
            if e > at:
                out.append(e)
            at = e
    return np.array(out, np.int64)


def chunks(column: pa.Array):
    """Texts, and start, end and text index of their chunks."""
    texts = Texts(column)
    end = boundaries(texts)
    start = np.concatenate([[0], end[:-1]]) if len(end) else end
    return texts, start, end, np.searchsorted(texts.offs, start, side="right") - 1


def short_hashes(texts: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    from .common import BASE, _bytes_table, span_hash

    return span_hash(_bytes_table(False)[texts.data], BASE)(start, end) >> np.uint64(1)


def count_rows(bits: int):
    """Short hashes of the chunks of each text by bucket, those a task has met lately once more at most."""

    def run(batches):
        ship = Shipment(False)
        for batch in pieces(batches):
            texts, start, end, _ = chunks(batch.column("text"))
            values, counts = np.unique(short_hashes(texts, start, end), return_counts=True)
            both = np.sort(np.concatenate([values, values[counts > 1]]))  # twice tells that it repeats
            yield from ship.add(short_hash(both, bits))
        yield from ship.flush()

    return run


def counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Hashes of one bucket that were sent more than once, and whether very often."""
    values, counts = np.unique(np.concatenate([unpack(b) for b in pdf["hashes"]]), return_counts=True)
    more = counts > 1
    hashes = values[more] | (np.uint64(pdf["bucket"].iloc[0]) << np.uint64(32))
    return pd.DataFrame({"hash": hashes.view(np.int64), "hot": counts[more] > HOT})


def repeated_rows(bits: int, filter_bytes, hot_bytes):
    """Chunks that may repeat: id and digest of the text, ordinal, byte span, digest, sub-key (-1 where there is none)."""

    def run(batches):
        wanted, hot = np.frombuffer(filter_bytes.value, np.uint32), np.frombuffer(hot_bytes.value, np.uint32)
        for batch in pieces(batches):
            texts, start, end, owner = chunks(batch.column("text"))
            hashes = short_hash(short_hashes(texts, start, end), bits)
            keep = np.flatnonzero(passes(wanted, hashes))
            if not len(keep):
                continue
            raw, first = texts.data.tobytes(), np.searchsorted(owner, np.arange(texts.n))
            ids = batch.column("doc_id").take(pa.array(owner[keep]))
            keys = [hashlib.md5(raw[texts.offs[i]:texts.offs[i + 1]]).digest() for i in range(texts.n)]
            of_row = np.array([(k[0] + (d or 0)) % SALTS for k, d in zip(keys, batch.column("doc_id").to_pylist())], np.int32)
            salt = np.where(passes(hot, hashes[keep]), of_row[owner[keep]], -1)
            at = texts.offs[owner[keep]]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([keys[i] for i in owner[keep]], pa.binary()), pa.array(keep - first[owner[keep]], pa.int32()),
                 pa.array(start[keep] - at, pa.int64()), pa.array(end[keep] - at, pa.int64()),
                 pa.array([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start[keep].tolist(), end[keep].tolist())], pa.binary()), pa.array(salt, pa.int32())],
                ["doc_id", "text_key", "ordinal", "lo", "hi", "digest", "salt"])

    return run


def repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, text_key, lo, hi, later, first_docs: spans of repeated chunks (bytes of the text). ``later`` tells
    that all of the span stands earlier in the corpus; ``first_docs`` are the documents where its chunks are first."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(size // 32 // BUCKET_SHINGLES).bit_length()
    twice = (texts.mapInArrow(count_rows(bits), "bucket long, hashes binary").repartition(1 << bits, "bucket")
             .groupBy("bucket").applyInPandas(counted, "hash long, hot boolean"))
    twice = materialise(twice, "twice")
    filter_bytes, hot_bytes = (spark.sparkContext.broadcast(bloom(t, "hash").tobytes()) for t in (twice, twice.where("hot")))
    rows = texts.mapInArrow(repeated_rows(bits, filter_bytes, hot_bytes), "doc_id long, text_key binary, ordinal int, lo long, hi long, digest binary, salt int")
    rows = materialise(rows.distinct(), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "text_key", "ordinal")
    firsts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("f"), F.max("salt").alias("s")).where("n > 1")
    salts = F.when(F.col("s") >= 0, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    marked = rows.join(firsts.select("digest", "f", F.explode(salts).alias("salt")), ["digest", "salt"]).select("doc_id", "text_key", "ordinal", "lo", "hi", (place != F.col("f")).alias("later"), F.col("f.doc_id").alias("first_doc"))
    part = F.struct("ordinal", "lo", "hi", "later", "first_doc")
    whole = marked.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # a document's own chunks
    none = F.array().cast("array<struct<next:int,lo:bigint,hi:bigint,later:boolean,docs:array<bigint>>>")

    def join(acc, c):
        last = F.try_element_at(acc, F.lit(-1))
        follows = F.coalesce((last["next"] == c["ordinal"]) & (last["later"] == c["later"]), F.lit(False))
        grown = F.struct((c["ordinal"] + 1).alias("next"), last["lo"].alias("lo"), c["hi"].alias("hi"), c["later"].alias("later"), F.array_union(last["docs"], F.array(c["first_doc"])).alias("docs"))
        fresh = F.struct((c["ordinal"] + 1).alias("next"), c["lo"].alias("lo"), c["hi"].alias("hi"), c["later"].alias("later"), F.array(c["first_doc"]).alias("docs"))
        return F.when(follows, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    spans = F.aggregate("parts", none, join)
    return (whole.select("doc_id", "text_key", F.explode(spans).alias("s")).where(f"s.hi - s.lo >= {span}")
            .select("doc_id", "text_key", "s.lo", "s.hi", "s.later", F.col("s.docs").alias("first_docs")))


def report(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Per input row: doc_id, n_bytes, shared_bytes (in spans that occur elsewhere), removed_bytes (in later
    occurrences), spans (lo:hi of those, bytes), first_docs (where they stand first)."""
    key = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    found = repeats(docs, span)
    later = F.col("later")
    by_doc = found.groupBy("doc_id", "text_key").agg(
        F.sum(F.col("hi") - F.col("lo")).alias("shared_bytes"), F.sum(F.when(later, F.col("hi") - F.col("lo")).otherwise(0)).alias("removed_bytes"),
        F.array_sort(F.collect_list(F.when(later, F.struct("lo", "hi")))).alias("cut"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(later, F.col("first_docs")))))).alias("first_docs"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    spans = F.array_join(F.transform(F.coalesce("cut", F.array().cast("array<struct<lo:bigint,hi:bigint>>")), lambda s: F.concat_ws(":", s["lo"].cast("string"), s["hi"].cast("string"))), ",")
    same = rows["doc_id"].eqNullSafe(by_doc["doc_id"]) & (rows["text_key"] == by_doc["text_key"])
    return (rows.join(by_doc, same, "left").select(
        rows["doc_id"], "n_bytes", F.coalesce("shared_bytes", F.lit(0)).alias("shared_bytes"), F.coalesce("removed_bytes", F.lit(0)).alias("removed_bytes"),
        spans.alias("spans"), F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs")))


def cut_rows(batches):
    for batch in pieces(batches):
        cuts = batch.column("_cuts").to_pylist()
        batch = batch.select([n for n in batch.schema.names if n != "_cuts"])
        k = batch.schema.get_field_index("text")
        texts = batch.column(k).to_pylist()
        for i, spans in enumerate(cuts):
            if spans:
                raw, at, kept = texts[i].encode(), 0, []
                for s in sorted(spans, key=lambda s: s["lo"]):
                    kept.append(raw[at:s["lo"]])
                    at = s["hi"]
                texts[i] = b"".join([*kept, raw[at:]]).decode(errors="ignore")  # a chunk may end inside a character
        yield batch.set_column(k, "text", pa.array(texts, batch.schema.field(k).type))


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents without later occurrences of repeated spans; ``n_chars`` follows."""
    cuts = repeats(docs, span).where("later").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_list(F.struct("lo", "hi")).alias("_cuts"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))) == F.col("_key"))
    out = docs.join(cuts, same, "left").select(*docs.columns, "_cuts").mapInArrow(cut_rows, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

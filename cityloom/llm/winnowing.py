"""Benchmark decontamination by winnowing.

Every text is fingerprinted with the smallest hash of each ``WINDOW`` consecutive ``GRAM``-word grams (the
rightmost on ties), so two texts that share GRAM + WINDOW - 1 = 10 words in a row share a fingerprint at the same
place of that span. Document fingerprints are joined with those of the benchmark; a hit is extended to all 10-word
windows around it, which count where the benchmark item has the same window around its own fingerprint. Items of
fewer than 10 words are one window and their own fingerprint.

A Bloom filter of bounded size keeps document fingerprints that cannot match from being sent; the join decides.
Equal texts are joined once. Null or empty texts have no words; null item texts no windows; items without an id
are left out. Repeated rows give repeated rows. An empty benchmark finds nothing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import materialise
from .common import ALNUM, Words, bloom, passes, pieces, split_by

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1

HITS = "hits array<struct<fp: long, size: int, starts: array<int>, windows: array<long>>>"


def fingerprints(words: Words) -> np.ndarray:
    """Word positions of the selected grams."""
    grams, _ = words.grams(GRAM)
    _, whole = words.grams(SPAN)
    at = np.flatnonzero(whole)
    best, low = at.copy(), grams[at]
    for d in range(1, WINDOW):
        v = grams[at + d]
        take = v <= low
        best[take] = at[take] + d
        low = np.where(take, v, low)
    return np.unique(best)


def marked(words: Words, short: list[int], bits: np.ndarray | None):
    """(text, fingerprint, window size, window starts, window hashes) of every kept fingerprint, by text."""
    grams, _ = words.grams(GRAM)
    windows, whole = words.grams(SPAN)
    text_of = np.repeat(np.arange(words.n), words.counts)
    spots = fingerprints(words)
    if bits is not None and len(spots):
        spots = spots[passes(bits, grams[spots])]
    for p in spots.tolist():
        t = text_of[p]
        lo = max(p - WINDOW + 1, words.first[t])
        starts = np.arange(lo, p + 1)
        starts = starts[whole[starts]]
        yield int(t), int(grams[p].view(np.int64)), SPAN, starts - words.first[t], windows[starts].view(np.int64)
    for m in short:
        grams, ok = words.grams(m)
        spots = np.flatnonzero(ok)
        if bits is not None and len(spots):
            spots = spots[passes(bits, grams[spots])]
        for p in spots.tolist():
            t = text_of[p]
            yield int(t), int(grams[p].view(np.int64)), m, np.array([p - words.first[t]]), grams[p:p + 1].view(np.int64)


def item_rows(batches):
    """Fingerprints of benchmark items with the windows around them; short items as one window."""
    for batch in pieces(batches):
        words = Words(batch.column("text"), ALNUM, True)
        ids = batch.column("item_id").to_pylist()
        rows = list(marked(words, [], None))
        few = np.flatnonzero((words.counts > 0) & (words.counts < SPAN))
        for t in few.tolist():
            h = words.word_spans(words.first[t:t + 1], words.first[t + 1:t + 2]).view(np.int64)
            rows.append((t, int(h[0]), int(words.counts[t]), np.zeros(1, np.int64), h))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()),
                                              pa.array([ids[r[0]] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.list_(pa.int64()))],
                                             ["fp", "size", "item_id", "item_windows"])


def document_rows(short: list[int], bits_bytes):
    """Per document: number of words, a key of its text, and the fingerprints that may match."""

    def run(batches):
        bits = np.frombuffer(bits_bytes.value, np.uint32)
        kind = pa.list_(pa.struct([("fp", pa.int64()), ("size", pa.int32()), ("starts", pa.list_(pa.int32())), ("windows", pa.list_(pa.int64()))]))
        for batch in pieces(batches):
            words = Words(batch.column("text"), ALNUM, True)
            hits: list[list] = [[] for _ in range(words.n)]
            for t, fp, size, starts, windows in marked(words, short, bits):
                hits[t].append({"fp": fp, "size": size, "starts": starts.tolist(), "windows": windows.tolist()})
            texts = batch.column("text").to_pylist()
            keys = [hashlib.md5(x.encode()).digest() if h else None for x, h in zip(texts, hits)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(hits, kind)],
                                             ["doc_id", "n_words", "text_key", "hits"])

    return run


def occurring(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words, text_key of each row, null where no fingerprint is known; text_key, at, size, item_id of the
    windows that occur)."""
    spark = docs.sparkSession
    items = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
             .where("item_id IS NOT NULL").mapInArrow(item_rows, "fp long, size int, item_id string, item_windows array<long>"))
    items = materialise(items, "items")
    short = sorted(r[0] for r in items.where(F.col("size") < SPAN).select("size").distinct().collect())  # nine values at most
    bits = spark.sparkContext.broadcast(bloom(items, "fp").tobytes())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(texts.mapInArrow(document_rows(short, bits), f"doc_id long, n_words long, text_key binary, {HITS}"), "fingerprints")

    spots = (rows.where("text_key IS NOT NULL").select("text_key", F.explode("hits").alias("h"))
             .select("text_key", F.col("h.fp").alias("fp"), F.col("h.size").alias("size"), F.col("h.starts").alias("starts"), F.col("h.windows").alias("windows"))
             .distinct())
    found = F.filter(F.transform("windows", lambda w, i: F.when(F.array_contains("item_windows", w), F.get("starts", i))), lambda s: s.isNotNull())
    joined = spots.join(items.distinct(), ["fp", "size"]).select("text_key", "item_id", "size", found.alias("at")).where(F.size("at") > 0)
    return rows, materialise(joined, "hits")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit (words inside occurring windows), items (their ids, sorted as strings), one row per
    input row."""
    rows, joined = occurring(docs, benchmark)
    covered = F.aggregate(  # starts in order: each window adds what lies beyond the words reached so far
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("at", lambda s: F.struct(s.alias("s"), F.col("size").alias("n"))))))),
        F.struct(F.lit(0).alias("reached"), F.lit(0).cast("long").alias("hit")),
        lambda acc, w: F.struct(F.greatest(acc["reached"], w["s"] + w["n"]).alias("reached"),
                                (acc["hit"] + F.greatest(F.lit(0), w["s"] + w["n"] - F.greatest(acc["reached"], w["s"]))).alias("hit")),
        lambda acc: acc["hit"])
    by_text = (joined.select("text_key", "at", "size").distinct().groupBy("text_key").agg(covered.alias("n_hit"))
               .join(joined.select("text_key", "item_id").distinct().groupBy("text_key").agg(F.array_sort(F.collect_list("item_id")).alias("items")), "text_key"))
    none = F.array().cast("array<string>")
    clean = rows.where("text_key IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    other = (rows.where("text_key IS NOT NULL").select("doc_id", "n_words", "text_key").join(by_text, "text_key", "left")
             .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items")))
    return clean.unionByName(other)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark window, all columns as given. The texts decide, not the ids, so rows
    without an id and other texts under the same id stay. Only those that go, and a few that the filter takes for
    them, are shuffled."""
    leaks = materialise(occurring(docs, benchmark)[1].select(F.col("text_key").alias("_key")).distinct(), "leaks")
    keyed = docs.withColumn("_key", F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    whole, open_ = split_by(keyed, F.xxhash64("_key"), leaks.select(F.xxhash64("_key").alias("k")))
    return whole.select(*docs.columns).unionByName(open_.join(leaks, "_key", "left_anti").select(*docs.columns))

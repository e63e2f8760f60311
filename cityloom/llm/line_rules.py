"""Quality rules with cross-document line frequency.

One pass over the texts measures every document and hashes its normalised lines (A-Z lower case, white space
between words as one space). For each host (``source``; null counts as the empty name) the different texts that
hold a line are counted, exact copies once. A line above the limits (more than ``max_docs`` texts, and more than
``max_share`` of the host's texts or more than ``always`` texts) is removed from all of them but the first text (smallest doc_id). Documents
that this leaves with fewer than ``min_words`` words, or less than ``min_share`` of them, are rejected, as are
those that fail the base rules.

The share grows with the host, so alone it would spare lines of a hundred thousand texts in a host of millions; above
``always`` texts a line counts in a host of any size. The limits are the same in the query, its SQL and the pipeline.

Counting is by pre-aggregated (host, line, text) rows, so a line in a third of all documents, or a text that is
repeated as often, stays spread. Null and empty texts have no words and no lines and fail the base rules. Repeated
rows give repeated rows. Only ``doc_id``, ``text`` and ``source`` are read."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import materialise
from .common import NOT_SPACE, STEP, Words, mix, pieces, span_hash, split_by

MAX_DOCS = 10
MAX_SHARE = 0.05
ALWAYS_DOCS = 100
MIN_WORDS = 20
MIN_SHARE = 0.3
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Words) -> np.ndarray:
    """Per text: words inside windows that the text has twice or more."""
    grams, ok = words.grams(REPEAT_WINDOW)
    at = np.flatnonzero(ok)
    text_of = np.repeat(np.arange(words.n), words.counts)
    h = mix(grams[at] ^ (text_of[at].astype(np.uint64) + np.uint64(1)) * np.uint64(STEP))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + REPEAT_WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return inside[words.first[1:]] - inside[words.first[:-1]]


class Lines:
    """The \\n-split lines with a word of several texts: bytes, words, and the text they are in."""

    def __init__(self, words: Words):
        breaks = np.flatnonzero(words.data == 10)
        start = np.union1d(words.offs[:-1], breaks + 1)
        start = start[start < len(words.data)] if len(words.data) else start[:0]
        end = np.minimum(np.append(start[1:], len(words.data)), len(words.data))
        end = end - ((end > start) & (words.data[np.maximum(end - 1, 0)] == 10)) if len(start) else end
        lo, hi = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
        keep = hi > lo
        self.start, self.end, self.lo, self.hi = start[keep], end[keep], lo[keep], hi[keep]
        self.text = np.searchsorted(words.offs, self.start, side="right") - 1
        self.words = self.hi - self.lo


def measure_rows(batches):
    for batch in pieces(batches):
        words = Words(batch.column("text"), NOT_SPACE, False)
        folded = Words(batch.column("text"), NOT_SPACE, True)
        lines = Lines(words)
        raw = words.bytes_hash(lines.start, lines.end)
        normal = span_hash(folded.hash, STEP)(lines.lo, lines.hi).view(np.int64)
        chars = words.per_text(words.is_word & ((words.data & 0xC0) != 0x80))
        symbols = words.per_text(SYMBOLS[words.data])
        repeats = repeated_words(words)
        dups, found = [], []
        edges = np.searchsorted(lines.text, np.arange(words.n + 1))
        for i in range(words.n):
            a, b = edges[i], edges[i + 1]
            dups.append(b - a - len(np.unique(raw[a:b])) if b - a > 1 else 0)
            value, inverse = np.unique(normal[a:b], return_inverse=True)
            total = np.bincount(inverse, lines.words[a:b], len(value)).astype(np.int64)
            found.append([{"line": v, "words": w} for v, w in zip(value.tolist(), total.tolist())])
        keys = [hashlib.md5((t or "").encode()).hexdigest() for t in batch.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("host"), pa.array(keys, pa.string()), pa.array(words.counts, pa.int64()), pa.array(chars, pa.int64()),
             pa.array(symbols, pa.int64()), pa.array(dups, pa.int64()), pa.array(repeats, pa.int64()), pa.array(found, kind)],
            ["doc_id", "host", "text_key", *MEASURES, "lines"])


def text_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def measured(docs: DataFrame) -> DataFrame:
    """One row per document with its measures and its normalised lines (hash, words), written to the shared folder."""
    schema = "doc_id long, host string, text_key string, " + ", ".join(f"{m} long" for m in MEASURES) + ", lines array<struct<line: long, words: long>>"
    return materialise(text_of(docs).mapInArrow(measure_rows, schema), "measures")


def removed_lines(rows: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, always: int = ALWAYS_DOCS) -> DataFrame:
    """host, text_key, line, words: the lines to remove from each text, those above the limits."""
    held = (rows.select("host", "text_key", "doc_id", F.explode("lines").alias("l"))
            .groupBy("host", F.col("l.line").alias("line"), "text_key").agg(F.max("l.words").alias("words"), F.min("doc_id").alias("doc_id")))
    held = materialise(held, "lines")
    texts = rows.select("host", "text_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    frequent = (F.col("n") > max_share * F.col("texts")) | (F.col("n") > always)
    often = (held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("f"))
             .where(F.col("n") > max_docs).join(texts, "host").where(frequent)
             .select("host", "line", F.col("f.text_key").alias("first_key")))
    return held.join(often, ["host", "line"]).where("text_key <> first_key").select("host", "text_key", "line", "words")


def verdicts(rows: DataFrame, removed: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, measures, removed_words, base_failed, kept for each measured document."""
    lost = removed.groupBy("host", "text_key").agg(F.sum("words").alias("removed_words"))
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("removed_words") > 0) & ((left < min_words) | (left < min_share * F.col("n_words")))
    return (rows.drop("lines").join(lost, ["host", "text_key"], "left").na.fill(0, ["removed_words"])
            .withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document, one row per input row."""
    rows = measured(docs)
    return verdicts(rows, removed_lines(rows)).select("doc_id", *MEASURES, "removed_words", "base_failed", "kept")


def stripped(column: pa.Array, drops: list[list[int]]) -> list[str]:
    """Texts without the lines whose normalised hash is listed."""
    folded = Words(column, NOT_SPACE, True)
    lines = Lines(folded)
    normal = span_hash(folded.hash, STEP)(lines.lo, lines.hi).view(np.int64)
    edges = np.searchsorted(lines.text, np.arange(folded.n + 1))
    raw, out = folded.data.tobytes(), []
    for i in range(folded.n):
        gone, parts, at, stop = set(drops[i]), [], int(folded.offs[i]), int(folded.offs[i + 1])
        for j in range(edges[i], edges[i + 1]):
            if int(normal[j]) in gone:
                parts.append(raw[at:int(lines.start[j])])
                at = min(int(lines.end[j]) + 1, stop)  # the line and its break
        out.append(b"".join([*parts, raw[at:stop]]).decode())
    return out


def strip_rows(batches):
    for batch in pieces(batches):
        drops = batch.column("_lines").to_pylist()
        batch = batch.select([n for n in batch.schema.names if n != "_lines"])
        at = [i for i, d in enumerate(drops) if d]
        if at:
            k = batch.schema.get_field_index("text")
            texts = batch.column(k).to_pylist()
            for i, t in zip(at, stripped(batch.column(k).take(pa.array(at)), [drops[i] for i in at])):
                texts[i] = t
            batch = batch.set_column(k, "text", pa.array(texts, batch.schema.field(k).type))
        yield batch


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, without the lines above the limits; ``text`` and ``n_chars`` follow,
    other columns stay as given. The verdicts meet the texts by (host, text), so repeated ids are no matter."""
    rows = measured(docs)
    removed = removed_lines(rows)
    lists = removed.groupBy("host", "text_key").agg(F.collect_set("line").alias("_lines"))
    rejected = verdicts(rows, removed).where("NOT kept").select("host", "text_key").distinct()
    marks = (rejected.withColumn("_bad", F.lit(True)).join(lists, ["host", "text_key"], "full")
             .withColumnsRenamed({"host": "_host", "text_key": "_key"}))
    marks = materialise(marks, "marks")
    keyed = docs.withColumns({"_host": F.coalesce(F.col("source").cast("string"), F.lit("")), "_key": F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    whole, open_ = split_by(keyed, F.xxhash64("_host", "_key"), marks.select(F.xxhash64("_host", "_key").alias("k")))
    left = open_.join(marks, ["_host", "_key"], "left").where("_bad IS NULL").select(*docs.columns, "_lines")
    cut = left.mapInArrow(strip_rows, docs.schema)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return whole.select(*docs.columns).unionByName(cut.select(*docs.columns))

"""Mixing sources to target weights with a low-discrepancy schedule.

Slot j of the mix lies at the golden-ratio point frac(j * phi); the cumulative target shares map the point to a
source, and the slot's rank among the slots of its source names one of the source's blocks of ``BLOCK`` words. The
documents of a source, shuffled by the digest of their id, form one stream of words that the blocks cut evenly; a
second pass over the blocks follows when the target exceeds the source. Golden-ratio counts stay within a few slots
of the targets at every prefix of the mix; the few slots that a source still lacks at the end are appended, and
what lies beyond its target is cut, so totals are exact to a word.

Sizes and offsets are prefix sums over bounded buckets and ranks are counted in bounded chunks, so a source with a
third of all rows stays spread. Windows without such a split run over the table of sources only. Null and empty
texts have size 0 and are never taken; a null source is a source of its own, last in order. Repeated rows count as
rows. Ties in the shuffle (equal ids) fall back to the size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.scale import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 64
#: Golden-ratio step on a lattice of 2**31 points.
LATTICE, GOLDEN = 1 << 31, 1327217885
CHUNK = 1 << 14
BUCKET_DOCS = 1 << 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, rank, target: shares of the total by weight, none above ``most`` times its source; the
    excess goes to the others by weight. Equals min(cap, level * weight) for the one level that fills the total."""
    named = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    named = named.withColumns({"w": w, "cap": (F.lit(most) * F.col("source_size")).cast("double")})
    order = W.orderBy(F.col("cap") / F.col("w"), "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    level = (total - before) / weight_left
    full = named.withColumn("level", level)
    found = full.agg(F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).alias("level"))
    return named.select("source", "source_size", "rank", F.least("cap", F.coalesce(found.scalar(), F.lit(float("inf"))) * F.col("w")).alias("target"))


def stream(rows: DataFrame, n: int) -> DataFrame:
    """rows (sid, doc_id, size, order) with ``start``: the word at which the document begins in its source."""
    bits = max(0, (n // BUCKET_DOCS).bit_length())
    bucket = F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), 32 - bits)
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    ahead = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = sums.select("sid", "bucket", (F.sum("n").over(ahead) - F.col("n")).alias("base"))
    inside = W.partitionBy("sid", "bucket").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (rows.withColumn("up", F.sum("size").over(inside)).join(sums, ["sid", "bucket"])
            .withColumn("start", F.col("base") + F.col("up") - F.col("size")).drop("bucket", "up", "base"))


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """sid, block, start, lo, hi: the words lo..hi of a block that the document starting at ``start`` fills."""
    end = F.col("start") + F.col("size")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    at = F.col("block") * block
    return cut.select("sid", "block", "start", F.greatest(F.lit(0).cast("long"), F.col("start") - at).alias("lo"),
                      F.least(F.lit(block).cast("long"), end - at).alias("hi"))


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, sid, rank, block, words for plan (sid, source_size, words): every slot of the mix and the words it
    takes from the start of its block."""
    spark = plan.sparkSession
    total = plan.agg(F.sum("words")).first()[0] or 0
    slots = -(-total // block)
    upto = F.sum("words").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranges = plan.where("words > 0").withColumn("hi", F.floor(upto * F.lit(LATTICE) / F.lit(max(total, 1))).cast("long"))
    ranges = ranges.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("sid")), F.lit(0)))
    cells = 1 << 12
    width = LATTICE // cells
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))).select("sid", "lo", "hi", "cell")
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") % LATTICE * GOLDEN % LATTICE).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / width))
    drawn = points.join(ranges, "cell").where("point >= lo AND point < hi").select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    sums = drawn.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    ahead = W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)
    base = sums.select("sid", "chunk", (F.sum("n").over(ahead) - F.col("n")).alias("base"))
    inside = F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot"))
    ranked = drawn.withColumn("r", inside).join(base, ["sid", "chunk"]).select("slot", "sid", (F.col("base") + F.col("r") - 1).alias("rank"))

    blocks = F.ceil(F.col("source_size") / block)
    passes = F.floor(F.col("words") / F.col("source_size"))
    quota = passes * blocks + F.ceil((F.col("words") - passes * F.col("source_size")) / block)
    need = plan.where("words > 0").withColumns({"blocks": blocks, "quota": quota})
    have = sums.groupBy("sid").agg(F.sum("n").alias("have"))
    extra = (need.join(have, "sid", "left").select("sid", "quota", F.coalesce("have", F.lit(0)).alias("have")).where("have < quota")
             .select("sid", F.explode(F.expr("sequence(have, quota - 1)")).alias("rank")))
    extra = extra.select((F.lit(slots) + F.col("rank")).alias("slot"), "sid", "rank")
    first = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + F.col("rank") % F.col("blocks") * block
    return (ranked.unionByName(extra).join(need, "sid").where("rank < quota")
            .select("slot", "sid", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.least(F.lit(block).cast("long"), F.col("words") - first).alias("words")))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> dict[str, DataFrame]:
    """The mix as tables: ``sources`` (source, sid, source_size, target, words), ``documents`` (with sid and start),
    ``schedule`` (slots) and ``parts`` (slot, sid, start, lo, hi: the words a slot takes, by document)."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), order.alias("order")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = materialise(targets(sizes.drop("n"), weights, share, most).select("source", F.col("rank").alias("sid"), "source_size", "target", F.floor("target").alias("words")), "sources")
    named = rows.join(sources.select("source", "sid"), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = materialise(stream(named, rows.count()), "stream")
    slots = materialise(schedule(sources.select("sid", "source_size", "words"), block), "schedule")
    parts = (pieces(placed, block).join(slots.select("slot", "sid", "block", "words"), ["sid", "block"])
             .withColumn("hi", F.least("hi", "words")).where("lo < hi").select("slot", "sid", "start", "lo", "hi"))
    return {"sources": sources, "documents": placed, "schedule": slots, "parts": parts}


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: what the mix takes of every document, repeats counted."""
    mix = mixed(docs, **options)
    uses = (mix["schedule"].groupBy("sid", "block", "words").agg(F.count(F.lit(1)).alias("times")))
    parts = pieces(mix["documents"], options.get("block", BLOCK)).join(uses, ["sid", "block"])
    words = F.greatest(F.lit(0).cast("long"), F.least("hi", "words") - F.col("lo")) * F.col("times")
    taken = parts.groupBy("sid", "start").agg(F.sum(words).alias("t"))
    out = mix["documents"].join(taken.withColumn("some", F.lit(True)), ["sid", "start"], "left").drop("source")
    return (out.join(mix["sources"], "sid")
            .select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("t", F.lit(0))).otherwise(F.lit(0)).alias("taken")))

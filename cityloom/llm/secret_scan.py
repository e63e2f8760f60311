"""Secret scans: fixed patterns, and a randomness test battery for strings no pattern names. DataFrame functions only.

Positions come from the text itself: a pattern's matches are wrapped in marks, the text is split at them, and the
lengths of the pieces add up to starts and ends (code points). Characters used as marks are first replaced by
another one of the same length, which no pattern holds.

Candidates of the battery are maximal runs of ``[A-Za-z0-9+/_-]``, with up to two ``=`` that close them, of 20 characters
or more, so that name=value is cut; of a run that meets a span of a fixed kind the parts outside are tested. The encoding is inferred from the
characters (hex, base32, base36, base62, base64, ...), and three statistics are taken under "every character is
drawn evenly": chi-squared of the character counts (exact mean and variance, so that short strings count right),
the number of runs above and below the middle of the alphabet, and serial correlation at lag 1. The smallest of
the three p-values, times three, is the string's p. Random strings have even p-values, words and identifiers small ones.

False discoveries are controlled for each encoding and length band apart, since a short string shows little: the
strings above p = 0.5 tell how many random ones a band has, and the lowest cutoff is taken at which at most
``FALSE_SHARE`` of the strings above it are not of that kind. Bands of the ``RICH`` encodings, whose letters of both
cases and digits words seldom mix evenly, also take a cutoff of ``LONE`` or more above which at most ``FEW`` strings are
unexplained, so that a lone key in a corpus without others is found; a band then holds at most so many false ones. All
strings of the corpus are counted; the table of counts is bounded by encodings, bands and steps.

Null and empty texts have no spans; repeated rows give repeated rows; only ``doc_id`` and ``text`` are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import materialise

ASSIGN = r"""(?i)(?=[psta])((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})()"
HEX = r"([0-9a-f]{24,})()"
#: Tried at the first character of a run only: from a later one the same run is shorter, so it cannot match where it did not before.
STRING = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{18})([A-Za-z0-9+/_-]{18,}+==(?![A-Za-z0-9+/_=-])|[A-Za-z0-9+/_-]{19,}+=(?![A-Za-z0-9+/_=-])|[A-Za-z0-9+/_-]{20,}+)()"
LEAST = 20
#: Kinds that are part of a run that STRING finds: without one they are not looked for.
IN_STRING = ["access", "hex"]
#: Kinds as listed, with the least length of group 2 (assign) or of the match, already part of the other patterns.
KINDS = [("assign", ASSIGN, 6), ("access", ACCESS, 0), ("hex", HEX, 0)]
RANDOM = "random"

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Inferred encodings, first fit: name, what all characters (without closing =) must be, alphabet.
ENCODINGS = [
    ("dec", "[0-9]+", DIGITS),
    ("hex", "[0-9a-f]+", DIGITS + "abcdef"),
    ("HEX", "[0-9A-F]+", DIGITS + "ABCDEF"),
    ("low", "[a-z]+", LOWER),
    ("up", "[A-Z]+", UPPER),
    ("b32", "[A-Z2-7]+", UPPER + "234567"),
    ("b36", "[0-9a-z]+", DIGITS + LOWER),
    ("B36", "[0-9A-Z]+", DIGITS + UPPER),
    ("let", "[A-Za-z]+", UPPER + LOWER),
    ("b62", "[0-9A-Za-z]+", DIGITS + UPPER + LOWER),
    ("b64", "[0-9A-Za-z+/]+", UPPER + LOWER + DIGITS + "+/"),
    ("url", "[0-9A-Za-z_-]+", UPPER + LOWER + DIGITS + "-_"),
    ("mix", "[0-9A-Za-z+/_-]+", UPPER + LOWER + DIGITS + "+/-_"),
]
#: Plain numbers are counts, dates and identifiers, never secrets by themselves.
PLAIN = ["dec"]
BANDS = [24, 32, 48, 64]
STEPS = 20
FALSE_SHARE = 0.05
RICH, LONE, FEW = ["b62", "b64", "url", "mix"], 0.1, 3


def wrapped(text: Column, pattern: str) -> Column:
    """The text split around the matches: rest, group 1, group 2, rest, ..."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\x01$1\x02$2\x03")), "[\x01\x02\x03]")


def located(parts: Column, least: int) -> Column:
    """array<struct<start, end, value>> of the matches whose group 2 has ``least`` characters."""
    def step(acc, i):
        at = F.length(F.get(parts, 3 * i))
        one, two = F.get(parts, 3 * i + 1), F.get(parts, 3 * i + 2)
        start = acc["at"] + at
        end = start + F.length(one) + F.length(two)
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.concat(one, two).alias("value"))
        keep = F.length(two) >= least
        return F.struct(end.cast("int").alias("at"), F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    walk = F.aggregate(F.sequence(F.lit(0), (F.size(parts) / 3 - 1).cast("int")), F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(F.size(parts) > 3, walk).otherwise(none)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def outside(run: Column, base: Column) -> Column:
    """The parts of a run outside the base spans (in order), of ``LEAST`` characters or more; ``value`` is without the
    one character that may join a part to a span."""
    def part(start, end):
        value = F.substring(run["value"], start - run["start"] + 1, end - start)
        value = F.when(start > run["start"], F.regexp_replace(value, "^[+/_-]", "")).otherwise(value)
        value = F.when(end < run["end"], F.regexp_replace(value, "[+/_-]$", "")).otherwise(value)
        return F.struct(start.alias("start"), end.alias("end"), value.alias("value"))

    def step(a, b):
        more = F.concat(a["parts"], F.array(part(a["at"], F.greatest(a["at"], b["start"]))))
        return F.struct(F.least(run["end"], F.greatest(a["at"], b["end"])).alias("at"), more.alias("parts"))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    met = F.filter(base, lambda b: overlaps(b, run))
    cut = F.aggregate(met, F.struct(run["start"].alias("at"), none.alias("parts")), step,
                      lambda a: F.concat(a["parts"], F.array(part(a["at"], run["end"]))))
    return F.when(F.size(met) == 0, F.array(run)).otherwise(F.filter(cut, lambda p: p["end"] - p["start"] >= LEAST))


def labelled(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def matched(docs: DataFrame) -> DataFrame:
    """All columns, ``_base`` (spans of the fixed kinds in order) and ``_tests`` (candidates and parts of them outside)."""
    names = [*[k for k, _, _ in KINDS], "string"]
    patterns = [*KINDS, ("string", STRING, 0)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = text.contains("\x01") | text.contains("\x02") | text.contains("\x03")
    rows = docs.withColumn("_plain", F.when(marked, F.translate(text, "\x01\x02\x03", "\x04\x04\x04")).otherwise(text))
    rows = rows.withColumns({f"_{k}": wrapped(F.col("_plain"), p) for k, p, _ in patterns if k not in IN_STRING})
    runs = F.size("_string") > 1
    rows = rows.withColumns({f"_{k}": F.when(runs, wrapped(F.col("_plain"), p)).otherwise(F.array(F.lit(""))) for k, p, _ in patterns if k in IN_STRING}).drop("_plain")
    rows = rows.withColumns({f"_{k}": located(F.col(f"_{k}"), n) for k, _, n in patterns})
    rows = rows.withColumn("_base", F.array_sort(F.concat(*[labelled(F.col(f"_{k}"), r, k) for r, (k, _, _) in enumerate(KINDS)])))
    free = F.flatten(F.transform("_string", lambda s: outside(s, F.col("_base"))))
    tests = F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), band(s["end"] - s["start"]).alias("band"), tested(s["value"]).alias("t")))
    return rows.withColumn("_tests", tests).drop(*[f"_{n}" for n in names])


def upper_tail(z: Column) -> Column:
    """1 - Phi(z) by the logistic approximation 1 / (1 + exp(1.5976 z + 0.07056 z^3)), within 0.00014."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1.0 / (1.0 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def battery(codes: Column, size: Column) -> Column:
    """Three times the smallest p of the three tests for codes 0 .. size - 1."""
    n, size = F.size(codes).cast("double"), size.cast("double")
    mean = (size - 1) / 2.0

    def equal(a, c):  # the k-th of equal codes adds 2 k - 1, so k of them add k squared
        k = F.when(c == a["c"], a["k"] + 1).otherwise(1)
        return F.struct(c.alias("c"), k.alias("k"), (a["s"] + 2.0 * k - 1.0).alias("s"))

    def step(a, c):
        begins = (a["c"] < 0) | ((a["c"] > mean) != (c > mean))
        return F.struct(c.alias("c"), (a["runs"] + F.when(begins, 1.0).otherwise(0.0)).alias("runs"),
                        (a["s"] + F.when(a["c"] < 0, 0.0).otherwise((a["c"] - mean) * (c - mean))).alias("s"))

    squares = F.aggregate(F.array_sort(codes), F.struct(F.lit(-1).alias("c"), F.lit(0).alias("k"), F.lit(0.0).alias("s")), equal, lambda a: a["s"])
    walk = F.aggregate(codes, F.struct(F.lit(-1).alias("c"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("s")), step)

    def least(x):
        chi = (x["squares"] * size / n - n - (size - 1)) / F.sqrt(2.0 * (size - 1) * (n - 1) / n)
        runs = (x["runs"] - (n + 1) / 2.0) / F.sqrt((n - 1) / 4.0)
        serial = x["s"] / ((size * size - 1) / 12.0 * F.sqrt(n - 1))
        return F.least(F.lit(1.0), 3.0 * F.least(upper_tail(chi), 2.0 * upper_tail(F.abs(runs)), 2.0 * upper_tail(F.abs(serial))))

    return let(walk, lambda w: let(F.struct(squares.alias("squares"), w["runs"].alias("runs"), w["s"].alias("s")), least))


def tested(value: Column) -> Column:
    """struct<enc, p> of a candidate string; without a fitting encoding or a second character p is 0."""
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])
    names = F.array(*[F.lit(n) for n, _, _ in ENCODINGS])

    def fit(body):
        found = F.lit(-1)
        for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
            found = F.when(body.rlike(f"^{pattern}$"), i).otherwise(found)
        return let(found, lambda e: F.struct(
            F.when(e < 0, "none").otherwise(F.get(names, e)).alias("enc"),
            F.when((e < 0) | (F.length(body) < 2), 0.0).otherwise(let(F.get(alphabets, e), lambda letters: let(
                F.transform(F.split(body, ""), lambda c: F.instr(letters, c) - 1), lambda codes: battery(codes, F.length(letters))))).alias("p")))

    return let(F.regexp_replace(value, "=+$", ""), fit)


def band(length: Column) -> Column:
    out = F.lit(0)
    for i, b in enumerate(BANDS):
        out = F.when(length >= b, i + 1).otherwise(out)
    return out


def cutoffs(tests: DataFrame) -> DataFrame:
    """One row with a map from "enc:band" to the lowest p from which its strings count as random; bands without
    enough random strings have no entry, but for rich encodings.

    A step s holds p in [s, s + 1) / STEPS. Above p = 0.5 lies half of all random strings of a band."""
    strings = tests.select(F.explode("_tests").alias("s")).select("s.t.enc", "s.band", "s.t.p").where(~F.col("enc").isin(*PLAIN, "none"))
    step = F.least(F.lit(STEPS - 1), F.floor(F.col("p") * STEPS)).cast("int")
    counts = strings.groupBy("enc", "band", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    above = counts.withColumn("low", F.explode(F.sequence(F.lit(0), F.lit(STEPS // 2 - 1)))).where("step >= low")
    above = above.groupBy("enc", "band", "low").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("step") >= STEPS // 2, F.col("n")).otherwise(0)).alias("high"))
    random = 2.0 * F.col("high") * (1 - F.col("low") / STEPS)
    unexplained = F.col("all") - random
    good = above.where((F.col("high") > 0) & (unexplained <= FALSE_SHARE * F.col("all")) | F.col("enc").isin(*RICH) & (F.col("low") >= LONE * STEPS) & (unexplained <= FEW))
    cuts = good.groupBy("enc", "band").agg((F.min("low") / STEPS).alias("cut"))
    return cuts.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "enc", F.col("band").cast("string")), "cut"))).alias("cuts"))


def spans_of(cuts: Column) -> Column:
    """All spans of a row of ``matched``: the fixed kinds and the strings at or above their cutoff."""
    above = F.filter("_tests", lambda s: s["t"]["p"] >= F.coalesce(F.try_element_at(cuts, F.concat_ws(":", s["t"]["enc"], s["band"].cast("string"))), F.lit(2.0)))
    return F.array_sort(F.concat("_base", labelled(above, len(KINDS), RANDOM)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, number of spans by fixed kind, digest of those, and all spans as text; one row per input row."""
    rows = materialise(matched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"), "spans")
    rows = rows.withColumn("_cuts", cutoffs(rows).scalar()).withColumn("_spans", spans_of(F.col("_cuts")))
    counts = [F.size(of_kind(F.col("_base"), k)).cast("long").alias(f"n_{k}") for k, _, _ in KINDS]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark``, overlapping spans by one; ``n_chars`` follows. The corpus
    is scanned once and written with what was found, for the cutoffs and the result; no text is shuffled."""
    found = materialise(matched(docs), "found")
    rows = found.withColumn("_cuts", cutoffs(found).scalar()).withColumn("_spans", spans_of(F.col("_cuts")))

    def merge(a, s):
        last = F.element_at(a, -1)
        one = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(a) > 0) & (s["start"] <= F.try_element_at(a, F.lit(-1))["end"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(one))) \
                .otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    whole = F.aggregate("_spans", F.array().cast("array<struct<start:int,end:int>>"), merge)
    kept = F.transform(F.sequence(F.lit(0), F.size("_cut")), lambda i: F.substring(
        F.col("text"), F.coalesce(F.get("_cut", i - 1)["end"], F.lit(0)) + 1,
        F.coalesce(F.get("_cut", i)["start"], F.length("text")) - F.coalesce(F.get("_cut", i - 1)["end"], F.lit(0))))
    rows = rows.withColumn("_cut", F.when(F.size("_spans") > 0, whole))
    rows = rows.withColumn("text", F.when(F.col("_cut").isNotNull(), F.array_join(kept, mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return rows.select(*docs.columns)

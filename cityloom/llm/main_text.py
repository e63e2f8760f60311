"""HTML main-text extraction as a maximum-scoring subsequence.

A page is read as a sequence of text runs and tags, hidden parts included. Words score positive, tags negative; the
contiguous region with the largest sum is the article, found by one linear scan. Weights are log odds from pages that
label themselves: what stands inside an ``article`` or ``main`` element against what stands outside. They are kept by
tag, for the words of hidden elements, and for class names (hashed to ``CLASSES`` buckets, so that their number is
bounded): words below a class seen outside of articles lose by it, whatever the class is called.

On a page whose label holds at least half of its visible words, words outside of it score negative. Elements that never
are article text (scripts, menus, forms, elements whose class, id or role names a notice, advert, comment section and the
like) stay in the scan with negative words, at most ``SHUT`` in all for one element, so that a long advert does not break
an article; those inside the region leave no text. An element ends at its end tag, where HTML lets it end unclosed
(p, li, dt, dd, option, table parts), or with its parent. The region is widened over what its label still holds, and
elsewhere over paragraphs and headings next to it, so short first and last blocks stay.

The text of the region: blocks end at block-level tags, character references are decoded, white space inside a block
becomes one space, blocks are joined by an empty line. Pages without a label use the same weights; a corpus without
any uses ``DEFAULTS``. A null or empty page has no text; one page is one row, repeated rows included."""

from __future__ import annotations

import html
import math
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: HTML's block-level elements and those that never hold article text (fixed values).
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "iframe", "noembed"}
NEVER = set("aside audio button canvas dialog footer form head header map math menu nav object select svg template video".split()) | RAW
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
KNOWN = BLOCKS | VOID | NEVER | INLINE
LABELS = {"article", "main"}
HINT = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|banner|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|promos?|promotion|"
                  r"sponsor\w*|social|shar(?:e|ing)|related|recommend\w*|sidebar|widgets?|menu|nav|navbar|navigation|breadcrumbs?|header|footer|masthead|comments?|commentlist|"
                  r"repl(?:y|ies)|disqus|respond|login|search|toolbar|pagination|pager|copyright|disclaimer)(?:$|[\s_-])", re.I)
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S)

#: Least and most a word gains, a tag costs, a class costs; most that the words of one hidden element cost.
WORD, TAG, CLASS, SHUT = (0.5, 3.0), (0.05, 3.0), (0.0, 6.0), 6.0
CLASSES = 4096
DEFAULTS = {"word": 1.0, "hidden": -3.0, "never": -4.0, "a": -1.0, "li": -1.0, "div": -1.0}
OTHER_TAG = -0.5
#: Compound class names such as ``article-header`` belong to the article.
OWN_HEADER = re.compile(r"(?:article|post|entry|story|content)s?[_-]+header", re.I)
#: Elements that an opening tag ends, and where the search for them stops (fixed values of HTML).
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "optgroup"}),
        "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
        "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})}
SCOPE = {"table", "td", "th", "caption", "button", "object", "template"}
TABLE = {"table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"}
#: What a region without a label may be widened over.
PROSE = set("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre br hr wbr img".split()) | INLINE - {"a"}


def hidden(name: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether the element never holds article text; a header inside an article does, unless its class names another part."""
    if name in NEVER and not (name == "header" and inside):
        return True
    if name in ("body", "html", "article", "main"):
        return False
    for key in ("class", "id"):
        if HINT.search(OWN_HEADER.sub(" ", attributes.get(key, ""))):
            return True
    return (attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
            or bool(re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I)))


def read_attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text.strip():
        for key, value in ATTRIBUTE.findall(text):
            out.setdefault(key.lower(), value.strip("\"'"))
    return out


def marks(attributes: dict[str, str]) -> tuple[str, ...]:
    return tuple(f".{zlib.crc32(c.lower().encode()) % CLASSES}" for c in attributes.get("class", "").split())


class Reader:
    """The items of a page: (kind, text, whether labelled, whether hidden, number of the chain of classes above).

    Kind is "word" for a run of text, "never" for the start of a hidden element (its name is the text), else the tag. ``chains`` holds
    (number of the chain above, classes added) by number, parents first; 0 has none."""

    def __init__(self, page: str):
        self.items: list[tuple[str, str, bool, bool, int]] = []
        self.chains: list[tuple[int, tuple[str, ...]]] = [(0, ())]
        self.open: list[tuple[str, int]] = []
        self.count: dict[str, int] = {}
        self.labels = 0
        self.shut = -1
        self.read(page)

    def push(self, name: str, classes: tuple[str, ...]) -> None:
        chain = self.open[-1][1] if self.open else 0
        if classes:
            self.chains.append((chain, classes))
            chain = len(self.chains) - 1
        self.open.append((name, chain))
        self.count[name] = self.count.get(name, 0) + 1
        self.labels += name in LABELS

    def cut(self, depth: int) -> None:
        """End all elements from this depth on."""
        while len(self.open) > depth:
            name = self.open.pop()[0]
            self.count[name] -= 1
            self.labels -= name in LABELS
        if self.shut >= depth:
            self.shut = -1

    def find(self, names: set[str], stops: set[str]) -> int:
        """Depth of the innermost open element of these names, -1 beyond the stops."""
        if any(self.count.get(n) for n in names):
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth][0] in names:
                    return depth
                if self.open[depth][0] in stops:
                    return -1
        return -1

    def end_unclosed(self, name: str) -> None:
        """What this opening tag ends without an end tag."""
        if name == "main" and self.shut >= 0:
            self.cut(self.shut)
        if name in ENDS:
            names, stops = ENDS[name]
            while (depth := self.find(names, stops)) >= 0:
                self.cut(depth)
        if name in BLOCKS and (depth := self.find({"p"}, SCOPE)) >= 0:
            self.cut(depth)

    def add(self, kind: str, text: str = "") -> None:
        self.items.append((kind, text, self.labels > 0, self.shut >= 0, self.open[-1][1] if self.open else 0))

    def read(self, page: str) -> None:
        at = 0
        while at < len(page):
            token = TOKEN.search(page, at)
            stop = token.start() if token else len(page)
            if stop > at:
                self.add("word", page[at:stop])
            if not token:
                break
            at = token.end()
            name = (token[2] or "").lower()
            if name and token[1] == "/":
                self.close(name)
            elif name:
                at = self.begin(name, token[3] or "", page, at)

    def close(self, name: str) -> None:
        depth = self.find({name}, BLOCKS if name in INLINE else SCOPE if name not in TABLE else {"table"} - {name})
        if depth >= 0:
            self.add(name)
            self.cut(depth)
        else:
            self.add(name)

    def begin(self, name: str, text: str, page: str, at: int) -> int:
        """Take an opening tag; where reading goes on."""
        self.end_unclosed(name)
        attributes = read_attributes(text)
        shut = self.shut < 0 and name not in VOID and hidden(name, attributes, self.labels > 0)
        self.add("never" if shut else name, name if shut else "")
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            return end.end() if end else len(page)
        if name not in VOID and not (text.endswith("/") and name not in BLOCKS):
            self.push(name, marks(attributes))
            if shut:
                self.shut = len(self.open) - 1
        return at


def labelled(reader: Reader) -> bool:
    """Whether the page's own label holds at least half of its visible words."""
    held = [0, 0]
    for kind, text, inside, shut, _ in reader.items:
        if kind == "word" and not shut:
            held[inside] += len(text.split())
    return held[1] > 0 and held[1] >= held[0]


def scores(reader: Reader, weights: dict[str, float]) -> list[float]:
    """What each item adds to a region."""
    own, word = labelled(reader), weights["word"]
    least = [0.0]
    for up, classes in reader.chains[1:]:
        least.append(min([least[up], *(weights.get(c, 0.0) for c in classes)]))
    out, left = [], 0.0
    for kind, text, inside, shut, chain in reader.items:
        if shut and kind != "word":
            out.append(0.0)
        elif kind != "word":
            left = SHUT
            out.append(weights.get(kind, OTHER_TAG))
        elif shut:
            cost = min(left, -weights["hidden"] * len(text.split()))
            left -= cost
            out.append(-cost)
        else:
            each = (word if inside else -word) if own else word + least[chain]
            out.append(each * len(text.split()))
    return out


def region(values: list[float]) -> tuple[int, int]:
    """First and past-the-last item of the best contiguous region, the first longest of equals from its start."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for i, value in enumerate(values):
        if total <= 0:
            total, begin = 0.0, i
        total += value
        if total > best:
            best, span = total, (begin, i + 1)
    return span


def widened(reader: Reader, span: tuple[int, int]) -> tuple[int, int]:
    """The region with the rest of its label, or with the paragraphs and headings beside it."""
    begin, end = span
    if begin == end:
        return span
    items, own = reader.items, labelled(reader)

    def joins(item) -> bool:
        kind, _, inside, shut, _ = item
        return inside if own else kind in PROSE or kind == "word" and not shut

    while begin > 0 and joins(items[begin - 1]):
        begin -= 1
    while end < len(items) and joins(items[end]):
        end += 1
    return begin, end


def main_text(page: str | None, weights: dict[str, float]) -> str:
    reader = Reader(page or "")
    begin, end = widened(reader, region(scores(reader, weights)))
    blocks: list[str] = []
    run: list[str] = []

    def flush():
        block = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if block:
            blocks.append(block)

    for kind, text, _, shut, _ in reader.items[begin:end]:
        if kind == "word":
            if not shut:
                run.append(text)
        elif kind == "br":
            run.append(" ")
        elif not shut and (kind in BLOCKS or kind == "never" and text in BLOCKS):
            flush()
    flush()
    return "\n\n".join(blocks)


def count_rows(batches):
    """Words and tags inside and outside of labelled elements, over pages that have one, by kind and by class bucket."""
    counts: dict[str, list[int]] = {}
    for batch in pieces(batches, "html"):
        for page in batch.column("html").to_pylist():
            reader = Reader(page or "")
            if not labelled(reader):
                continue
            below = [[0, 0] for _ in reader.chains]
            for kind, text, inside, shut, chain in reader.items:
                if kind in LABELS:
                    continue
                n = len(text.split()) if kind == "word" else 1
                side = 0 if inside else 1
                if kind == "word":
                    below[chain][side] += n
                    kind = "hidden" if shut else "word"
                elif kind == "never":
                    counts.setdefault(text, [0, 0])[side] += n
                elif kind not in KNOWN:
                    kind = "other"
                counts.setdefault(kind, [0, 0])[side] += n
            for i in range(len(below) - 1, 0, -1):
                up, classes = reader.chains[i]
                for side in (0, 1):
                    below[up][side] += below[i][side]
                    for c in classes:
                        counts.setdefault(c, [0, 0])[side] += below[i][side]
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["kind", "inside", "outside"])


def fit(pages: DataFrame) -> dict[str, float]:
    """Weights by kind from all self-labelled pages; the counts are one row per known kind and class bucket."""
    rows = (pages.select(F.col("html").cast("string").alias("html")).mapInArrow(count_rows, "kind string, inside long, outside long")
            .groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect())
    if not any(r["kind"] == "word" for r in rows):
        return dict(DEFAULTS)
    weights = {}
    for r in rows:
        kind, odds = r["kind"], math.log((r["inside"] + 0.5) / (r["outside"] + 0.5))
        if kind == "word":
            weights[kind] = min(max(odds, WORD[0]), WORD[1])
        else:
            low, high = CLASS if kind[0] == "." else TAG
            weights[kind] = -min(max(-odds, low), high)
    return {"never": DEFAULTS["never"], "hidden": DEFAULTS["hidden"]} | weights


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars; weights are fitted on the pages unless given."""
    weights = fit(pages) if weights is None else weights

    def run(batches):
        for batch in pieces(batches, "html"):
            texts = [main_text(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

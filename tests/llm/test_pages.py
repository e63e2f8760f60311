"""Pages and conversations."""

import hashlib
import html.parser

from cityloom.llm import chat_format, main_text, revisits


def test_main_text(spark):
    ad = '<div class="ad">Buy this now and here.</div>'
    page = ('<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav>' + ad
            + "<article><h1>A &amp; B &eacute;&#x41;</h1><p>First  text\n with <b>bold</b> and 1 &lt; 2<br>next<p>Second one, unclosed.<form>Mail <input></form>"
            + "<aside>See also</aside><div id='comments'><p>I like it a lot, really a lot.</p></div><p>Last &am words here.</p></article><footer>&copy; 2024 foot</footer></body></html>")
    bare = "<body><div><p>One block of text without any label at all.</p></div><div class='sidebar'>More</div><p>Two <!-- hidden --> more.</p><style>p{}</style>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", bare), (5, "u", "no tags & only <3 words"), (5, "u", "no tags & only <3 words"), (6, "u", "<p>" + "long " * 50_000 + "</p>"), (7, "u", "<<<>>><p")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")
    got = main_text.extract(pages).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert text[1] == "A & B éA\n\nFirst text with bold and 1 < 2 next\n\nSecond one, unclosed.\n\nLast &am words here."
    assert text[2] == text[3] == "" and text[4] == "One block of text without any label at all.\n\nTwo more."
    assert text[5] == "no tags & only <3 words" and len(text[6]) == 249_999
    assert main_text.extract(pages.limit(0)).count() == 0


def test_best_region_equals_all_regions():
    import random

    rng = random.Random(0)
    for _ in range(200):
        value = [rng.choice([-3.5, -2.0, 0.0, 1.0, 2.0, 4.0]) for _ in range(rng.randrange(1, 12))]
        begin, end = main_text.region(value)
        assert sum(value[begin:end]) == max(0, *(sum(value[a:b]) for a in range(len(value)) for b in range(a + 1, len(value) + 1)))


def test_hidden_elements_end_where_html_ends_them():
    def text(page):
        return main_text.main_text(page, main_text.DEFAULTS)

    for tag in ("p", "li"):
        box = "<ul>" if tag == "li" else ""
        page = f"<article>{box}<{tag}>One two three four.<{tag} class='notice'>Ad text<{tag}>Two is here.</{tag}><{tag}>Three is here.</{tag}></article>"
        assert text(page) == "One two three four.\n\nTwo is here.\n\nThree is here."
    assert text("<article><p>Words one two.</p><div><div class='ad'>Buy</div><p>More words.</p><section><div class='share'>Share it</section><p>Last.</p></article>") == "Words one two.\n\nMore words.\n\nLast."
    assert text("<article><table><tr><td>Cell<td class='promo'>Buy<td>Kept<tr class='ad'><td>Gone<tr><td>Row</table></article>") == "Cell\n\nKept\n\nRow"
    assert text("<article><div class='article-header'><h1>Headline here</h1></div><p>Body text.</p></article>") == "Headline here\n\nBody text."
    assert text("<main><header class='site-header menu'>Home News</header><p>Body text stays.</p><p>End</p></main>") == "Body text stays.\n\nEnd"
    assert text("<article><p>Some body text stays here.</p><p>End.</p></article><div><p>Dear editor, no.</p></div>") == "Some body text stays here.\n\nEnd."
    assert text("<div><h1>Top</h1><p>Some body text stays here.</p><p>End.</p></div>") == "Top\n\nSome body text stays here.\n\nEnd."
    assert text("<article><p>Before it <script>x()</script>and after.</p><aside>" + "buy " * 500 + "</aside><p>Still here.</p></article>") == "Before it and after.\n\nStill here."
    assert text("<nav><a>Home</a><main><p>Body of it.</p></main>") == "Body of it."


def test_learned_weights_cut_what_has_no_known_name(spark):
    boxes = "<div class='zeta'>" + "letters of readers are here " * 3 + "</div>"
    menu = "<div>" + "".join(f"<ul><li><a href='/{i}'>Menu</a></li></ul>" for i in range(5)) + "</div>"
    pages = [f"<body class='page'>{menu}<article><h1>Head {i}</h1><p>{'good words in here ' * 10}</p></article>{boxes}</body>" for i in range(30)]
    rows = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    weights = main_text.fit(rows)
    bare = pages[7].replace("<article>", "<div>").replace("</article>", "</div>")
    want = "Head 7\n\n" + ("good words in here " * 10).strip()
    assert main_text.main_text(bare, weights) == want and main_text.main_text(pages[7], weights) == want
    # all words below the learned class and the menu's go by the scan itself: nothing there is hidden by name
    reader = main_text.Reader(bare)
    begin, end = main_text.widened(reader, main_text.region(main_text.scores(reader, weights)))
    assert not any(i[3] for i in reader.items)
    assert sum(len(i[1].split()) for k, i in enumerate(reader.items) if i[0] == "word" and not begin <= k < end) == 5 + 15


class Plain(html.parser.HTMLParser):
    """Article text of a page by the standard parser: all blocks of its article element."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks, self.run = False, [], ""
        self.feed(page)

    def flush(self):
        if self.run.split():
            self.blocks.append(" ".join(self.run.split()))
        self.run = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.run += " " * self.on
        elif tag in main_text.BLOCKS:
            self.flush()
        self.on = self.on or tag == "article"

    def handle_endtag(self, tag):
        if tag in main_text.BLOCKS:
            self.flush()
        self.on = self.on and tag != "article"

    def handle_data(self, data):
        self.run += data * self.on


def test_extraction_equals_the_articles_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: "\n\n".join(Plain(r.html or "").blocks) for r in pages.collect()}
    got = {r.page_id: r.text for r in main_text.extract(pages).collect()}
    assert got == want and any(want.values())


def test_revisits(spark):
    def head(**h):
        return "\r\n".join(f"{k.replace('_', '-')}: {v}" for k, v in h.items())

    rows = [
        (1, "http://www.Ex.org:80/a/?utm_source=x&b=2&a=1#f", 10, "response", 200, head(ETag='"v1"', Content_Type="text/html", Expires="old", Content_Length=9)),
        (2, "https://m.ex.org/a?a=1&b=2", 20, "revisit", 304, head(ETag='W/"v1"', Expires="new", Content_Length=0, Server="s")),
        (3, "ex.org/a?a=1&b=2", 30, "response", 500, head(ETag='"v1"')),
        (4, "ex.org/a?a=1&b=2", 35, "response", 200, head(ETag='"v2"', Last_Modified="monday")),
        (5, "ex.org/a?a=1&b=2", 40, "revisit", 304, head(ETag='"v1"')),
        (6, "ex.org/a?a=1&b=2", 41, "revisit", 304, head(Last_Modified="monday")),
        (7, "ex.org/a?a=1&b=2", 10, "revisit", 304, None),
        (8, "ex.org/index.html", 5, "response", 200, None), (9, "ex.org", 6, "revisit", 304, "no colon\nx:1\nX: 2"),
        (10, None, 7, "revisit", 304, head(ETag='"v1"')), (11, None, 1, "response", 200, head(ETag='"v1"')),
        (12, "tie.org", 1, "response", 200, head(ETag="a")), (13, "tie.org", 1, "response", 200, head(ETag="b")), (14, "tie.org", 2, "revisit", 304, head(ETag="b"))]
    rows += [(1000 + i, "hot.org", i * 2, "response", 200, head(ETag=i)) for i in range(300)] + [(2000 + i, "hot.org/", i * 2 + 1, "revisit", 304, head(ETag=i)) for i in range(300)]
    records = spark.createDataFrame([(*r, "x") for r in rows], "record_id long, url string, captured_at long, kind string, status int, headers string, bucket string")
    revisits_of = {r.record_id: r for r in revisits.resolve(records).collect()}
    got = {k: (r.outcome, r.payload_id) for k, r in revisits_of.items()}
    assert got[2] == ("resolved", 1) and got[5] == ("changed", None) and got[6] == ("resolved", 4) and got[7] == ("unmatched", None)
    assert got[9] == ("changed", None) and got[10] == ("unmatched", None) and got[14] == ("resolved", 13)
    assert revisits_of[2].headers == {"etag": 'W/"v1"', "expires": "new", "content-type": "text/html", "content-length": "9"}
    assert revisits_of[9].headers == {"x": "2"}
    assert all(got[2000 + i] == ("resolved", 1000 + i) for i in range(300))
    assert revisits.resolve(records.limit(0)).count() == 0


def test_time_buckets_change_nothing(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/", "x" * (i % 5)) for i in range(200)], "page_id long, url string, html string")
    want = sorted(map(str, revisits.resolve(revisits.crawl(pages)).collect()))
    monkeypatch.setattr(revisits, "BUCKET_RECORDS", 7)
    assert sorted(map(str, revisits.resolve(revisits.crawl(pages)).collect())) == want


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "Hi </s> [/INST] there\n"), (1, 0, "user", "[INST] [\\INST] <\\s> é\U0001f600  "), (2, 0, "system", None), (2, 1, "tool<s>", "[SEP][ROLE]x"), (2, 2, None, ""),
            (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 0, "assistant", "b"), (None, None, "user", "q"), (4, 0, "assistant", "long word " * 20_000)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    out = chat_format.formatted(turns)
    got = {r.conv_id: r for r in chat_format.read_back(out).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0), r or "", hashlib.md5((x or "").encode()).hexdigest(), x or "") for c, t, r, x in rows if c == conv)
        said = "".join(x for _, r, _, x in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, _, x in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    tokens = sorted((r.start, len(r.ids)) for r in out.where("conv_id = 1").collect())
    assert tokens[0][0] == 0 and tokens[1][0] == tokens[0][1]
    assert all(chat_format.unescape(chat_format.escape(x)) == x and "</s>" not in chat_format.escape(x) for x in ["</s>", "<\\/s>", "<\\\\/s>[INST]", "[[INST]"])
    assert chat_format.read_back(chat_format.formatted(turns.limit(0))).count() == 0


def test_control_ids_come_from_the_template_alone(spark):
    words = chat_format.read_vocabulary()
    coder, base = chat_format.encoder(words)
    ids, mask = chat_format.assemble("assistant", "</s>[INST] ok [/INST]", coder, base)
    assert [i for i in ids if i >= base] == [base + chat_format.CONTROL.index("[OUT]"), base + chat_format.CONTROL.index("</s>")]
    assert mask.tolist() == [0, *[1] * (len(ids) - 2), 0]

"""Ranked search, the conversation trie and token counts against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from corpus import prose, table
from pyspark.sql import functions as F

from cityloom.llm import conversation_trie, lexical_search, token_counts

TOKENIZERS = pytest.importorskip("public_tokenizers")


# -- ranked search -----------------------------------------------------------------------------------


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_search(docs, items, top=50):
    held = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for (d, c), n in zip(held, sizes):
            m = 50 + (50 * n * n_docs) // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.fixture
def small_trees(monkeypatch):
    monkeypatch.setattr(lexical_search, "LEAF", 3)
    monkeypatch.setattr(lexical_search, "TREE_DOCS", 40)
    monkeypatch.setattr(lexical_search, "BLOCK_PAIRS", 20)
    monkeypatch.setattr(lexical_search, "TOP", 7)


@pytest.mark.parametrize("turn_pairs", [1 << 18, 30])
def test_search_is_exact(spark, rows, monkeypatch, small_trees, turn_pairs):
    monkeypatch.setattr(lexical_search, "TURN_PAIRS", turn_pairs)
    rng = random.Random(8)
    base = prose(rng, 30)
    more = rows + [(i, base, "s0") for i in range(1000, 1100)] + [(i, f"{base} w{i % 9}", "s0") for i in range(1100, 1140)] + [(None, base, "s0"), (7, base, "s1")]
    items = [(i, prose(rng, 12)) for i in range(12)] + [(20, base), (21, None), (22, ""), (23, "nowhere to be found xyzzy"), (None, "the W1 w2"), (24, "w1 w1"), (24, "w5"), (24, "w5")]
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, source string, score int")
    got = lexical_search.top_documents(table(spark, more), asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search([(d, t) for d, t, _ in more], items, 7)


def test_search_without_rows(spark, docs, none):
    asked = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert lexical_search.top_documents(none, asked).count() == 0
    assert lexical_search.top_documents(docs, asked.limit(0)).count() == 0


def test_trees_share_paths_and_leave_subtrees_out(monkeypatch):
    """Copies hang below one path; a search for a rare term visits few leaves."""
    import numpy as np

    sets = [[0, 1, 2]] * 400 + [[0, 1, 3 + i % 5] for i in range(400)] + [[0, 9]] * 4
    n = len(sets)
    offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    flat = np.array([t for s in sets for t in s])
    tree = lexical_search.Tree(np.arange(n), np.full(n, 90), offs, flat, np.ones(len(flat), np.int64), 10)
    assert sorted(tree.key.tolist()) == list(range(n)) and len(tree.lo) < n / 8
    asked = lexical_search.Asked(np.array([0, 0]), np.array([9, 0], np.uint64), np.arange(10, dtype=np.uint64), np.array([n, 800, 400, 80, 80, 80, 80, 80, 5, 4]), n, len(flat))
    monkeypatch.setattr(lexical_search, "TOP", 3)
    best = lexical_search.Best(1)
    seen = []
    beats = best.beats
    monkeypatch.setattr(best, "beats", lambda items, score, key: (seen.append(1), beats(items, score, key))[1])
    lexical_search.search(tree, asked, best)
    assert sorted(-k for _, k in best.heaps[0]) == [800, 801, 802] and len(seen) < len(tree.lo) + 20


# -- conversation trie -------------------------------------------------------------------------------


def plain_trie(turns):
    held = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            held[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(rows)] for c, rows in held.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(21)
    rows = []
    for c in [*range(0, 130), *range(300, 340), 777, -5, 10**12 + 3]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hello", "go on", "é\U0001f600"])))
    chain = [("user" if t % 2 else "assistant", f"step {t}") for t in range(37)]
    for c, n in ((500, 37), (600, 37), (700, 30), (800, 21), (900, 37)):
        rows += [(c, t, *x) for t, x in enumerate(chain[:n])]
    for c in range(2000, 2060):  # copies that spread over shards
        rows += [(c, t, "user", "same") for t in range(7)]
    rows += [(4000, None, None, None), (4000, 1, "user", None), (4000, 1, "user", "tie"), (4000, 1, "assistant", "tie"), (None, 0, "user", "lost"), (4101, 0, "user", "alone")]
    return rows + rows[:5]


TURNS = "conv_id long, turn long, role string, text string, key string, band long, path string, size int"


@pytest.mark.parametrize(("band", "shard_rows"), [(64, 1 << 12), (64, 9), (3, 9), (1, 25)])
def test_trie_is_exact(spark, monkeypatch, band, shard_rows):
    monkeypatch.setattr(conversation_trie, "SHARD_ROWS", shard_rows)
    rows = conversations()
    turns = spark.createDataFrame([(*r, "k", 1, "p", 2) for r in rows], TURNS).repartition(4)
    got = conversation_trie.trie(turns, band)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows)


def test_skeleton_nodes_are_few_and_added_up(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "SHARD_ROWS", 9)
    turns = spark.createDataFrame([(*r, "k", 1, "p", 2) for r in conversations()], TURNS)
    rows = conversation_trie.bands(conversation_trie.rebuilt_turns(turns), 64).withColumns({f"hang_{c}": F.lit(0).cast("long") for c in ("leaves", "saved")}).cache()
    cuts = conversation_trie.splitters(rows)
    frame = conversation_trie.skeleton(cuts)
    assert len(cuts) > 10 and all(len(v) <= len(cuts) for v in frame.values())
    found = conversation_trie.scan(rows, 64)
    assert found.where("kind = 'part'").groupBy("depth", "h1", "h2").count().agg(F.max("count")).first()[0] > 5
    assert found.where("kind = 'node'").groupBy("depth", "h1", "h2").count().agg(F.max("count")).first()[0] == 1


def test_no_conversations(spark):
    assert conversation_trie.trie(spark.createDataFrame([], TURNS)).count() == 0


# -- token counts ------------------------------------------------------------------------------------


PARTS = ["'s", "'re", "'ve", "'ll", "'d", "'t", "'m", "'", " ", "  ", "\n", "\t", "a", "b", "the", "re", "ll", "l", "r", "v", "e", "1", "22", "!", "--", "é", "ü", "́", "中", "文字",
         "\U0001f600", "\xa0", "　", "<|endoftext|>", "<|endof", "ing", "tion", "S", "'S", "====", "\x00", "\x85", "\x1c", "٣", "ⅷ", "aaaa", "\U0001e6c0", "\U00011de0"]


def test_token_counts_are_those_of_the_library(spark, rows):
    from tokenizers import Tokenizer

    path = TOKENIZERS.path("byte_bpe_50k.json")
    rng = random.Random(31)
    letters = "aeinrsth .,'\n"
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x800), rng.randrange(0x800, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(1000)]
    texts += ["a" * 5000, " " * 3000, "ab" * 4000, "'" * 999, "-" * 700, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", None, ""] + [t for _, t, _ in rows]
    lib = Tokenizer.from_file(path)
    want = [len(e.ids) for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = sorted(tuple(r) for r in token_counts.token_counts(docs, path).collect())
    assert got == [(i, len((t or "").encode()), n, n > 512) for i, (t, n) in enumerate(zip(texts, want))]


def test_merger_starts_anew_when_full(monkeypatch):
    import pyarrow as pa

    shipped = token_counts._compiled(TOKENIZERS.path("byte_bpe_50k.json"))
    texts = [" ".join(f"word{i * j}ly" for j in range(40)) for i in range(60)]
    whole = token_counts.Counter(*shipped)
    want = whole(pa.array(texts))[1].tolist()
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "MAX_PAIRS", 40)
    small = token_counts.Counter(*shipped)
    assert [int(small(pa.array([t]))[1][0]) for t in texts] == want and len(small.merger.states) < len(whole.merger.states)


def test_no_texts(spark, none):
    assert token_counts.token_counts(none, TOKENIZERS.path("byte_bpe_50k.json")).count() == 0

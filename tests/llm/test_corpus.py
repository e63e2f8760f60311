"""Operators on documents against plain Python, on a table with every odd case."""

import hashlib
import random

import brute
import pytest
from corpus import table

from cityloom.llm import chunk_dedup, jaccard_join, line_rules, mixture, quality_classifier, secret_scan, winnowing


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_jaccard_groups(docs, rows, none):
    got = jaccard_join.jaccard_groups(docs).collect()
    want = brute.jaccard_components([(d, t) for d, t, _ in rows if d is not None])
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert want[131][1] == 100 and want[250] == (0, 250) and want[254][1] == 253
    assert jaccard_join.jaccard_groups(none).count() == 0


def test_frequent_shingles_and_blocks(spark, monkeypatch):
    """Groups far larger than a block, whose shingles are all frequent, some with few copies of their own."""
    rng = random.Random(11)
    base = " ".join(f"b{i}" for i in range(200))
    rows = []
    for i in range(160):
        words = base.split(" ")
        for _ in range(rng.choice([0, 1, 2, 4, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words), "s"))
    rows += [(1000 + i, f"{base[:300]} " + " ".join(f"y{i}_{j}" for j in range(rng.choice([20, 300]))), "s") for i in range(40)]
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(jaccard_join, "HOT_OVER", 3)
    monkeypatch.setattr(jaccard_join, "BUCKET_SHINGLES", 1 << 12)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(table(spark, rows)).collect()}
    assert got == brute.jaccard_components([(d, t) for d, t, _ in rows])


def test_tree_finds_what_pairs_find():
    import numpy as np

    rng = random.Random(2)
    pool = [np.array(sorted(rng.sample(range(400), rng.randrange(1, 60))), np.uint64) for _ in range(60)]
    pool += [np.array(sorted(set(p.tolist()) ^ set(rng.sample(range(400), 2))), np.uint64) for p in pool for _ in range(2)] + pool[:5]
    forest = jaccard_join.tree(pool)
    for asked in pool:
        want = {i for i, p in enumerate(pool) if 100 * len(np.intersect1d(p, asked)) >= 80 * len(np.union1d(p, asked))}
        assert set(jaccard_join.matches(forest, asked, 80)) == want - {i for i, p in enumerate(pool) if not len(p)}


def test_line_rules(docs, rows, none):
    got = [tuple(r) for r in line_rules.quality_rules(docs).select("doc_id", *line_rules.MEASURES, "removed_words", "base_failed", "kept").collect()]
    verdicts = brute.line_verdicts(rows)
    assert ordered(got) == ordered((d, *m, gone, failed, kept) for d, m, gone, failed, kept, _ in verdicts)
    assert any(gone for _, _, gone, *_ in verdicts)
    kept = line_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert ordered((r.doc_id, r.text, r.n_chars) for r in kept.collect()) == ordered((d, t, len(t)) for d, _, _, _, ok, t in verdicts if ok)
    assert line_rules.quality_rules(none).count() == 0 and line_rules.kept_documents(none).count() == 0


def items(spark, passages):
    rows = [("7", passages[0]), ("11", passages[1] + " and more words"), ("2", passages[2]), ("3", passages[3]), ("3", passages[3]), ("5", None), ("6", "!!"), (None, passages[1]), ("12", passages[0])]
    return spark.createDataFrame(rows, "item_id string, text string"), [r for r in rows if r[0] is not None]


def test_winnowing(spark, docs, rows, passages, none):
    benchmark, known = items(spark, passages)
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in winnowing.contamination(docs, benchmark).collect()]
    want = brute.contamination([(d, t) for d, t, _ in rows], known)
    assert ordered(got) == ordered(want)
    assert {d for d, _, h, _ in want if h} == {232, 233, 234, 235, 236}
    clean = winnowing.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 5
    assert winnowing.contamination(none, benchmark).count() == 0
    assert winnowing.contamination(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_every_span_of_ten_words_is_found(spark):
    rng = random.Random(8)
    rows, known = [], []
    for i in range(60):
        passage = " ".join(f"q{rng.randrange(50)}" for _ in range(rng.randrange(8, 14)))
        known.append((str(i), f"{' '.join(f'i{rng.randrange(99)}' for _ in range(rng.randrange(9)))} {passage}"))
        rows.append((i, f"{' '.join(f'd{rng.randrange(9)}' for _ in range(rng.randrange(30)))} {passage}, then", "s"))
    got = winnowing.contamination(table(spark, rows), spark.createDataFrame(known, "item_id string, text string")).collect()
    assert ordered((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == ordered(brute.contamination([(d, t) for d, t, _ in rows], known))


def test_secret_base(docs, rows, none):
    texts = {}
    for d, t, _ in rows:
        texts[d] = t
    for r in secret_scan.secrets(docs).collect():
        spans = brute.base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(brute.span_text(spans).encode()).hexdigest(), r.doc_id
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert set(filter(None, brute.span_text(spans).split(","))) <= set(r.spans.split(","))
    assert secret_scan.secrets(none).count() == 0


def test_redaction(docs, rows, none):
    got = secret_scan.redacted(docs)
    assert got.columns == docs.columns
    want = []
    for d, t, _ in rows:
        spans, at, out = brute.base_spans(t), 0, ""
        for a, _, _, b in spans:
            out, at = (out + t[at:a] + "[SECRET]", b) if a >= at else (out, max(at, b))
        want.append((d, None if t is None else out + t[at:]))
    assert ordered((r.doc_id, r.text) for r in got.collect()) == ordered(want)
    assert secret_scan.redacted(none).count() == 0


def test_random_strings(spark):
    """Keys drawn evenly are found, words and identifiers of their length are not."""
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = {i: "".join(rng.choice(letters) for _ in range(40)) for i in range(300)}
    names = {i: "".join(rng.choice(["get", "User", "Name", "2", "From", "Table", "1", "index"]) for _ in range(12)) for i in range(300, 600)}
    rows = [(i, f"see {k} here", "s") for i, k in {**keys, **names}.items()]
    found = {r.doc_id for r in secret_scan.secrets(table(spark, rows)).where("spans LIKE '%random%'").collect()}
    assert len(found & set(keys)) >= 0.9 * len(keys) and len(found & set(names)) <= 0.05 * len(found)


def test_mixture(docs, rows, none):
    got = mixture.taken_words(docs).collect()
    want = brute.mix(rows)
    assert ordered((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == ordered((d, n, s, round(float(t), 6), k) for d, n, s, t, k in want)
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert mixture.taken_words(none).count() == 0


def test_schedule_follows_the_shares(docs):
    """Every source's share of any prefix of the mix is near its share of the whole."""
    mix = mixture.mixed(docs, block=8)
    sources = {r.sid: r.words for r in mix["sources"].collect()}
    slots = sorted((r.slot, r.sid) for r in mix["schedule"].collect())
    parts = mix["parts"].selectExpr("sum(hi - lo)").first()[0]
    assert parts == sum(sources.values())
    seen = dict.fromkeys(sources, 0)
    total = sum(sources.values())
    for i, (_, sid) in enumerate(slots, 1):
        seen[sid] += 1
        assert abs(seen[sid] - i * sources[sid] / total) < 8


def test_chunks(docs, rows, none, passages):
    got = {}
    for r in chunk_dedup.report(docs).collect():
        got.setdefault(r.doc_id, r)
    assert got[233].removed_bytes > 0.7 * len(passages[0]) and 232 in got[233].first_docs
    assert got[100].removed_bytes == 0 and got[101].removed_bytes > 0.9 * got[101].n_bytes
    assert all(got[i].shared_bytes == 0 for i in range(60) if i != 3)
    assert got[250].n_bytes == 0 and got[251].spans == ""
    kept = chunk_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    left = {r.doc_id: r.text for r in kept.collect()}
    assert left[232] == dict((d, t) for d, t, _ in rows)[232] and len(left[101]) < 40
    assert chunk_dedup.report(none).count() == 0


def test_chunks_resist_insertions():
    import pyarrow as pa

    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij klmno") for _ in range(4000))
    texts, start, end, owner = chunk_dedup.chunks(pa.array([text, "inserted " + text[:2000] + "!" + text[2000:], None, ""]))
    raw = texts.data.tobytes()
    assert b"".join(raw[a:b] for a, b in zip(start, end)) == raw and set(owner) == {0, 1}
    first, second = ({raw[a:b] for a, b, o in zip(start, end, owner) if o == k} for k in (0, 1))
    assert len(first & second) > 0.95 * len(first)
    assert max(end - start) <= chunk_dedup.MOST


def test_classifier(spark, docs, rows, none):
    rng = random.Random(6)
    good = [(i, " ".join(rng.choice(["the", "house", "river", "of", "walks", "slowly."]) + rng.choice(["", "s"]) for _ in range(rng.randrange(40, 200))), "s") for i in range(300)]
    bad = [(300 + i, " ".join(rng.choice(["BUY", "NOW!!", "$$$", "###", "FREE%%"]) for _ in range(rng.randrange(40, 200))), "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(600)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.scored(table(spark, good + bad + [(None, None, None), (900, "", "s"), (901, "word", "s")]), labels).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id < 300) for r in held) >= 0.97 * len(held) > 100
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality_classifier.scored(none, labels).count() == 0
    alone = quality_classifier.scored(docs, labels.limit(0)).collect()
    assert len(alone) == len(rows) and {r.score for r in alone} == {0.5}


@pytest.mark.parametrize("operator", [jaccard_join.one_of_each_group, chunk_dedup.without_repeats])
def test_columns_stay(operator, docs, none):
    assert operator(docs).columns == docs.columns and operator(none).count() == 0


def test_pipeline(spark, docs, rows, passages, tmp_path):
    """run() equals the plain versions of its stages, one after the other."""
    import corpus_pipeline

    benchmark, known = items(spark, passages)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(d, t, s) for (d, _, s), (_, _, _, _, ok, t) in zip(rows, brute.line_verdicts(rows)) if ok]
    groups = brute.jaccard_components([(d, t) for d, t, _ in left if d is not None])
    left = {d: (d, t, s) for d, t, s in left if d is None or groups[d][1] == d}.values()
    left = [r for r, c in zip(left, brute.contamination([(d, t) for d, t, _ in left], known)) if not c[2]]
    final = []
    for d, t, s in left:
        at, out = 0, ""
        for a, _, _, b in brute.base_spans(t):
            out, at = (out + t[at:a] + "[SECRET]", b) if a >= at else (out, max(at, b))
        final.append((d, out + t[at:], s))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert ordered((r.doc_id, r["size"], r.taken) for r in got) == ordered((d, n, k) for d, n, _, _, k in brute.mix(final))

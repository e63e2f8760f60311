"""Cases in which an operator once did less than the whole job."""

import random

import brute
import numpy as np
import pytest
from corpus import prose, table
from pyspark.sql import functions as F

from cityloom.llm import chunk_dedup, common, jaccard_join, line_rules, quality_classifier, secret_scan, winnowing


def test_frequent_lines_of_a_hot_host(spark):
    """A long line of 150 texts goes from a host of 6 000 texts, where it is far below the share, as from a small one."""
    rng = random.Random(12)
    line = "this page is licensed under the terms that are given at the end of the book"
    rows = [(i, f"{prose(rng, 25)} n{i}" + (f"\n{line}" if i % 40 == 0 else ""), "hot") for i in range(6000)]
    rows += [(i, f"{prose(rng, 25)} n{i}" + (f"\n{line}" if i % 10 == 0 else ""), "small") for i in range(6000, 6200)]
    left = line_rules.kept_documents(table(spark, rows)).where(F.col("text").contains(line)).collect()
    assert sorted(r.doc_id for r in left) == [0, 6000]
    held = {d: line in t for d, t, _ in rows}
    n = len(line.split())
    got = {r.doc_id: r.removed_words for r in line_rules.quality_rules(table(spark, rows)).collect()}
    assert got == {d: n * (held[d] and d not in (0, 6000)) for d in held}


def test_rows_without_an_id_and_texts_that_share_one(spark):
    """They go only with their own group or window; the first row of a group stays, also without an id."""
    rng = random.Random(13)
    t = [prose(rng, 60) for _ in range(8)]
    rows = [(None, t[0], "s"), (None, t[1], "s"), (7, t[2], "s"), (7, t[3], "s"), (3, t[4], "s"), (None, t[4], "s"), (None, t[5], "s"), (None, t[5], "s"),
            (9, t[6], "s"), (9, t[6], "s"), (None, "", "s"), (None, None, "s"), (2, t[3], "s")]
    left = jaccard_join.one_of_each_group(table(spark, rows)).collect()
    want = [(None, t[0]), (None, t[1]), (7, t[2]), (2, t[3]), (3, t[4]), (None, t[5]), (9, t[6]), (None, ""), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted(want, key=str)
    benchmark = spark.createDataFrame([("1", t[0]), ("2", t[2])], "item_id string, text string")
    left = winnowing.clean_documents(table(spark, rows), benchmark).collect()
    want = [(d, x) for d, x, _ in rows if x not in (t[0], t[2])]
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted(want, key=str)


def test_joined_and_one_case_strings(spark):
    """Random strings behind name=, joined to an access id, or of one case are found; names and words like them are not."""
    rng = random.Random(14)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = ["river", "stone", "garden", "window", "letter", "summer", "market", "bridge"]

    def drawn(letters, n=40):
        return "".join(rng.choice(letters) for _ in range(n))

    ids = ["AKIA" + drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 16) for _ in range(400)]
    kinds = [lambda i: ("AWS_SECRET_ACCESS_KEY=", drawn(base64)), lambda i: ("db_pass=", drawn(base64) + "=="), lambda i: (f"{ids[i]}/", drawn(base64)),
             lambda i: (f"{ids[i]}=", drawn(base64)), lambda i: ("see ", drawn(base64[26:52])), lambda i: ("see ", drawn(base64[:26]))]
    rows, keys = [], {}
    for i in range(1200):
        name, key = kinds[i % 6](i // 6)
        rows.append((i, f"so {name}{key} it is", "s"))
        keys[i] = (3 + len(name), 3 + len(name) + len(key))
    rows += [(i, "say " + "".join(rng.choice(words) for _ in range(7)) + " SOME_LONG_NAME_OF_A_THING=" + "/".join(rng.choice(words) for _ in range(6)), "s") for i in range(1200, 1500)]
    found = {}
    for r in secret_scan.secrets(table(spark, rows)).collect():
        spans = [s.split(":") for s in r.spans.split(",") if s.startswith("random")]
        found[r.doc_id] = [(int(a), int(b)) for _, a, b in spans]
    for kind in range(6):
        of = [i for i in keys if i % 6 == kind]
        assert sum(any(a <= keys[i][0] and b >= keys[i][1] for a, b in found[i]) for i in of) >= 0.85 * len(of), kind
    assert sum(bool(found[i]) for i in range(1200, 1500)) <= 0.05 * 1200


@pytest.mark.parametrize("bits", [(16, 27), (6, 6)])
def test_long_postings_meet_through_hubs(spark, monkeypatch, bits):
    """A group of copies does not meet pair by pair; a full filter takes all shingles for frequent ones and loses no link."""
    monkeypatch.setattr(common, "BLOOM_BITS", bits)
    rng = random.Random(15)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words), "s"))
    rows += [(1000 + i, " ".join(base[:60] + [f"y{i}_{j}" for j in range(rng.choice([8, 20, 300]))]), "s") for i in range(40)]
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(jaccard_join, "HOT_OVER", 3)
    monkeypatch.setattr(jaccard_join, "BUCKET_SHINGLES", 1 << 12)
    listed, write = [], jaccard_join.materialise

    def counted(df, name):
        out = write(df, name)
        if name == "meetings" and "shingle" in out.columns:
            listed.append((out.where("shingle IS NULL").agg(F.sum("shared")).first()[0] or 0, out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "materialise", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(table(spark, rows)).collect()}
    assert got == brute.jaccard_components([(d, t) for d, t, _ in rows])
    assert listed[0][0] < len(rows) * 10  # 160 copies give 12 720 pairs for each shingle


def test_lone_keys_are_found(spark):
    """One, two or three keys among plain documents: those with a p of LONE or more are found; no string of the plain ones is taken."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    plain = ["see internationalization of getUserNameFromTable2 and http/paths/of/some/kind here", "a compartmentalization_of_things in some_long_name_of_a_thing", "x" * 40]
    for n in (1, 2, 3):
        rng = random.Random(n)
        keys = {i: "".join(rng.choice(letters) for _ in range(40)) for i in range(n)}
        rows = [(i, f"so {k} it is", "s") for i, k in keys.items()] + [(i, plain[i % 3], "s") for i in range(n, 300)]
        found = {r.doc_id for r in secret_scan.secrets(table(spark, rows)).where("spans LIKE '%random%'").collect()}
        sure = {i for i, k in keys.items() if brute.randomness(k, secret_scan.ENCODINGS)[1] >= secret_scan.LONE}
        assert sure and sure <= found <= set(keys)  # others may pass the band's own cutoff


def test_battery_and_cutoffs_equal_plain_ones(spark):
    rng = random.Random(8)
    rows, strings = [], {}
    for i in range(400):
        letters = rng.choice([e[2] for e in secret_scan.ENCODINGS])
        letters = letters if rng.random() < 0.6 else letters[: max(2, len(letters) // 3)]
        strings[i] = "g" + "".join(rng.choice(letters) for _ in range(rng.randrange(20, 80))) + "Z"  # no base span
        rows.append((i, f"a {strings[i]} b", "s"))
    bands: dict = {}
    value = {i: brute.randomness(s, secret_scan.ENCODINGS) for i, s in strings.items() if not brute.base_spans(s)}
    for i, (enc, p) in value.items():
        if enc not in secret_scan.PLAIN and enc != "none":
            bands.setdefault((enc, sum(len(strings[i]) >= b for b in secret_scan.BANDS)), []).append(p)
    cuts = {k: brute.lowest_cut(ps, k[0] in secret_scan.RICH) for k, ps in bands.items()}
    want = {i for i, (enc, p) in value.items() if (c := cuts.get((enc, sum(len(strings[i]) >= b for b in secret_scan.BANDS)))) is not None and p >= c}
    docs = table(spark, [r for r in rows if r[0] in value])
    got = {r.doc_id: (r.t.enc, r.t.p) for r in secret_scan.matched(docs).selectExpr("doc_id", "_tests[0].t AS t").collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in value.items()}
    assert all(abs(got[k][1] - value[k][1]) < 1e-9 for k in value)
    assert {r.doc_id for r in secret_scan.secrets(docs).where("spans LIKE '%random%'").collect()} == want and len(want) > 50


def test_chunks_equal_plain_ones(spark, rows, monkeypatch):
    docs = table(spark, rows)
    want = brute.shared_spans([(d, t) for d, t, _ in rows if len(t or "") < 20_000], chunk_dedup.GEAR)
    short = docs.where("text IS NULL OR length(text) < 20000")
    for hot in (chunk_dedup.HOT, 1):  # spread rows give the same
        monkeypatch.setattr(chunk_dedup, "HOT", hot)
        key = {(r.doc_id, r.n_bytes, r.shared_bytes, r.removed_bytes, r.spans) for r in chunk_dedup.report(short).collect()}
        assert key == {(d, len(t.encode()), *v) for (d, t), v in want.items()}


def test_scores_equal_a_plain_discriminant():
    rng = np.random.default_rng(3)
    d = len(quality_classifier.FEATURES)
    x = {k: rng.normal(k, 1 + k, (60 + 40 * k, d)) @ rng.normal(0, 1, (d, d)) for k in (0, 1)}
    sums = {k: np.column_stack([np.ones(len(v)), v]).T @ np.column_stack([np.ones(len(v)), v]) for k, v in x.items()}
    got = quality_classifier.Discriminant(sums).score(np.vstack([x[0], x[1]]))
    n = {k: len(v) for k, v in x.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    scale = np.diag(1 / np.sqrt(np.diag(pooled)))
    logs = []
    for k in (0, 1):
        own = scale @ (0.9 * cov[k] + 0.1 * pooled) @ scale
        own = 0.98 * own + 0.02 * np.trace(own) / d * np.eye(d)
        gap = (np.vstack([x[0], x[1]]) - x[k].mean(0)) @ scale
        logs.append(np.log(n[k]) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * np.einsum("ij,ji->i", gap, np.linalg.solve(own, gap.T)))
    assert np.allclose(got, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), atol=1e-9)


def test_redaction_scans_a_corpus_once_by_whole_runs(spark, monkeypatch):
    """The patterns are looked for once, and tried at the start of a run only they find what they find when tried everywhere."""
    calls, matched = [], secret_scan.matched
    monkeypatch.setattr(secret_scan, "matched", lambda docs: calls.append(1) or matched(docs))
    rng = random.Random(6)
    parts = ["a" * n for n in (1, 16, 17, 18, 19, 20, 21)] + ["=", "==", "===", " ", "-", "f0" * 12, "AKIA", "G" * 16, "token: ", "PassWord=", "é", "\x01"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))), "s") for i in range(600)]
    assert len(secret_scan.redacted(table(spark, rows)).collect()) == 600 and calls == [1]
    run = "[A-Za-z0-9+/_-]"
    everywhere = rf"({run}{{18,}}+==(?![A-Za-z0-9+/_=-])|{run}{{19,}}+=(?![A-Za-z0-9+/_=-])|{run}{{20,}}+)()"
    texts = table(spark, rows).select(*[F.regexp_extract_all("text", F.lit(p), 0).alias(n) for n, p in (("a", secret_scan.STRING), ("b", everywhere))])
    assert texts.where("a <=> b").count() == 600 and texts.where("size(a) > 0").count() > 100
    for r in secret_scan.secrets(table(spark, rows)).collect():
        spans = brute.base_spans(rows[r.doc_id][1])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))

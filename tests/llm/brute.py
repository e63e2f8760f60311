"""Plain Python versions of what the operators promise, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def shingles(text):
    w = SPACE_WORD.findall((text or "").translate(FOLD))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def jaccard_components(rows):
    """{doc_id: (set size, component)} for (doc_id, text); rows with one id count as one document for reach."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets}


def contamination(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM_WORD.findall((t or "").translate(FOLD))
        for a in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[a:a + 10])].add(str(i))
    lengths = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w = ALNUM_WORD.findall((t or "").translate(FOLD))
        hit, found = set(), set()
        for m in lengths:
            for a in range(len(w) - m + 1):
                g = tuple(w[a:a + m])
                if g in windows:
                    hit.update(range(a, a + m))
                    found |= windows[g]
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def base_spans(text):
    t = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(spans)


def span_text(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def measures(text):
    t = text or ""
    w = SPACE_WORD.findall(t)
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {p for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def line_key(line):
    return " ".join(SPACE_WORD.findall(line.translate(FOLD)))


def line_verdicts(rows, max_docs=10, max_share=0.05, always=100):
    """[(doc_id, measures, removed words, kept, text without the lines)] for (doc_id, text, source)."""
    held, texts, firsts = defaultdict(set), defaultdict(set), {}
    for d, t, s in rows:
        texts[s or ""].add(t or "")
        for key in {line_key(x) for x in (t or "").split("\n")} - {""}:
            held[s or "", key].add(t or "")
            mark = (d is None, d or 0, hashlib.md5((t or "").encode()).hexdigest(), t or "")
            firsts[s or "", key] = min(firsts.get((s or "", key), mark), mark)
    often = {k for k, v in held.items() if len(v) > max_docs and (len(v) > always or len(v) > max_share * len(texts[k[0]]))}
    out = []
    for d, t, s in rows:
        m, gone, left = measures(t), 0, []
        for x in re.findall(r"[^\n]*\n?", t or ""):
            key = line_key(x)
            if (s or "", key) in often and firsts[s or "", key][3] != (t or ""):
                gone += len(key.split(" "))
            else:
                left.append(x)
        n = m[0]
        failed = n < 20 or 100 * m[4] > 30 * n
        kept = not failed and not (gone and (n - gone < 20 or n - gone < 0.3 * n))
        out.append((d, m, gone, failed, kept, "".join(left) if gone else t))
    return out


def mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    """[(doc_id, size, source size, target, taken)] for (doc_id, text, source)."""
    sized = [(d, s, len(SPACE_WORD.findall(t or ""))) for d, t, s in rows]
    totals = Counter()
    for _, s, n in sized:
        totals[s] += n
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(totals.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * totals[s]}
        for s in over or free:
            target[s] = most * totals[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        free -= over
    out, at = [], Counter()
    for d, s, n in sorted(sized, key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] or 0, r[2])):
        taken = 0
        if totals[s]:
            words = int(target[s] + 1e-9)
            taken = words // totals[s] * n + max(0, min(at[s] + n, words % totals[s]) - at[s])
        at[s] += n
        out.append((d, n, totals[s], target[s], taken))
    return out


def gear_chunks(raw, gear, known=16, zeros=0xF800, least=8, most=512):
    """Byte spans of one text's chunks, one byte at a time."""
    out, at = [], 0
    for e in range(1, len(raw) + 1):
        h = sum(int(gear[raw[e - 1 - k]]) << k for k in range(min(known, e)))
        if (h & zeros) == 0 or e == len(raw):
            while e - at > most:
                out.append((at, at + most))
                at += most
            if e - at >= least or e == len(raw):
                out.append((at, e))
                at = e
    return [(a, b) for a, b in out if b > a]


def shared_spans(rows, gear, span=64):
    """{(doc_id, text): (shared bytes, removed bytes, later spans)} for (doc_id, text); equal rows count once."""
    texts = sorted({(d is None, d, hashlib.md5((t or "").encode()).digest(), t or "") for d, t in rows}, key=lambda r: (not r[0], r[1] or 0, r[2]))
    texts.sort(key=lambda r: (r[0], r[1] or 0, r[2]))
    cut = [(r, gear_chunks(r[3].encode(), gear)) for r in texts]
    times, first = Counter(), {}
    for i, (r, spans) in enumerate(cut):
        for k, (a, b) in enumerate(spans):
            chunk = r[3].encode()[a:b]
            times[chunk] += 1
            first.setdefault(chunk, (i, k))
    out = {}
    for i, (r, spans) in enumerate(cut):
        runs = []
        for k, (a, b) in enumerate(spans):
            chunk = r[3].encode()[a:b]
            if times[chunk] > 1:
                later = first[chunk] != (i, k)
                if runs and runs[-1][2] == later and runs[-1][3] == k:
                    runs[-1] = (runs[-1][0], b, later, k + 1)
                else:
                    runs.append((a, b, later, k + 1))
        runs = [x for x in runs if x[1] - x[0] >= span]
        out[r[1], r[3]] = (sum(b - a for a, b, *_ in runs), sum(b - a for a, b, late, _ in runs if late), ",".join(f"{a}:{b}" for a, b, late, _ in runs if late))
    return out


def randomness(text, encodings):
    """(encoding, p) of a string by three tests under even draws."""
    body = re.sub("=+$", "", text)
    fit = next(((n, a) for n, p, a in encodings if re.fullmatch(p, body)), None)
    if fit is None or len(body) < 2:
        return (fit[0] if fit else "none"), 0.0
    codes, n, m = [fit[1].index(c) for c in body], len(body), len(fit[1])

    def tail(z):
        z = min(max(z, -8.0), 8.0)
        return 1 / (1 + math.exp(1.5976 * z + 0.07056 * z**3))

    mean = (m - 1) / 2
    expected = n / m
    chi = sum((codes.count(c) - expected) ** 2 / expected for c in range(m))
    chi = (chi - (m - 1)) / math.sqrt(2 * (m - 1) * (n - 1) / n)
    up = [c > mean for c in codes]
    runs = (1 + sum(a != b for a, b in zip(up, up[1:])) - (n + 1) / 2) / math.sqrt((n - 1) / 4)
    serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / ((m * m - 1) / 12 * math.sqrt(n - 1))
    return fit[0], min(1.0, 3 * min(tail(chi), 2 * tail(abs(runs)), 2 * tail(abs(serial))))


def lowest_cut(ps, rich, steps=20, share=0.05, lone=0.1, few=3):
    """The lowest step from which the strings of a band count as random, or None."""
    for low in range(steps // 2):
        above = sum(math.floor(p * steps) >= low for p in ps)
        high = sum(math.floor(p * steps) >= steps // 2 for p in ps)
        false = above - 2 * high * (1 - low / steps)
        if above and (high and false <= share * above or rich and low >= lone * steps and false <= few):
            return low / steps
    return None

"""Ranked lexical search over a document FP-tree.

Every text is reduced to the vector (term, occurrences) of those of its terms that some item asks for. A task reads
its vectors in groups of bounded size, puts each in order of document frequency, most frequent first, and hangs it
into a prefix tree: documents with the same frequent terms share a path, paths without branches are one node, and
the last ``LEAF`` documents of a subtree are a leaf. A node knows, over its subtree, the most occurrences of every
term, the smallest m and the smallest doc_id. As a term's part of the score grows with its occurrences and falls
with m, these give a bound; depth first, best child first, a subtree is left out for an item once the bound cannot
beat the item's ``TOP``-th document of this task (at equal score: the smaller doc_id). Leaves are scored exactly.
Tasks return their best documents of each item; these are ranked in two steps, by hash and then by item.

Vectors stay in the partitions of the table, so no group of copies, source or term gathers anywhere. Items are
taken in turns of about ``TURN_PAIRS`` (item, term) pairs, whose vocabulary is what is broadcast (some 4 MB; the
terms of one item stay together), and within a turn in blocks of ``BLOCK_PAIRS``.

Terms come together by 64-bit hashes. Null texts have no terms; documents without terms are no documents for the
statistics. Rows of equal item_id, also the null one, are one item with the terms of all its rows; an item without
terms, or whose terms no document holds, gives no rows. Repeated document rows count and rank one by one; a null
doc_id comes last among equal scores. Empty tables give no rows, other columns are left out."""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.scale import materialise
from .common import ALNUM, Words, pieces

TOP = 50
LEAF = 16
TREE_DOCS = 8192
#: Nodes of a tree times terms of a turn.
TREE_CELLS = 1 << 22
TURN_PAIRS = 1 << 18
BLOCK_PAIRS = 1 << 13
LAST = (1 << 63) - 1


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): distinct hashes of each item's terms."""

    def run(batches):
        for part in pieces(batches):
            words = Words(part.column(1), ALNUM, True)
            yield pa.RecordBatch.from_arrays([part.column(0), lists(pa.array(words.hash.view(np.int64)), words.counts)], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<long>")
    return rows.select("item_id", F.explode("terms").alias("term")).distinct()


def vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs): terms as places in the sorted ``vocabulary``, each once."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary.tobytes())

    def run(batches):
        known = np.frombuffer(shipped.value, np.uint64)
        for part in pieces(batches):
            words = Words(part.column(1), ALNUM, True)
            at = np.searchsorted(known, words.hash)
            found = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == words.hash)
            of = np.repeat(np.arange(words.n), words.counts)[found]
            cell, tf = np.unique(of * len(known) + at[found], return_counts=True)
            sizes = np.bincount(cell // len(known), minlength=words.n)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words.counts), lists(pa.array((cell % len(known)).astype(np.int32)), sizes), lists(pa.array(tf.astype(np.int32)), sizes)],
                ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Asked:
    """The items of a turn: terms in order of document frequency, their weights, and the items in blocks."""

    def __init__(self, item: np.ndarray, term: np.ndarray, vocabulary: np.ndarray, df: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((vocabulary, -df))
        self.rank = np.empty(len(order), np.int32)
        self.rank[order] = np.arange(len(order))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df[order]], np.int64)
        self.n_docs, self.n_terms, self.size = n_docs, n_terms, len(order)
        at = self.rank[np.searchsorted(vocabulary, term)]
        by = np.lexsort((at, item))
        item, at = item[by], at[by]
        names, first = np.unique(item, return_index=True)
        self.n_items = len(names)
        self.blocks = []
        block = first // BLOCK_PAIRS
        for b in np.unique(block):
            own = np.flatnonzero(block == b)
            stop = first[own[-1] + 1] if own[-1] + 1 < len(first) else len(item)
            pairs = at[first[own[0]]:stop]
            self.blocks.append((names[own], pairs, weight[pairs], np.append(first[own] - first[own[0]], len(pairs))))


class Tree:
    """FP-tree of some documents. Rows are in path order; node i covers rows lo[i]:hi[i]."""

    def __init__(self, key: np.ndarray, m: np.ndarray, offs: np.ndarray, terms: np.ndarray, tfs: np.ndarray, size: int):
        # terms of each row most frequent first, rows in order of their paths, equal paths by doc_id
        sizes = np.diff(offs)
        by = np.lexsort((terms, np.repeat(np.arange(len(sizes)), sizes)))
        terms, tfs = terms[by], tfs[by]
        path = terms.astype(">u4").tobytes()
        order = sorted(range(len(sizes)), key=lambda i: (path[4 * offs[i]:4 * offs[i + 1]], key[i]))
        self.key, self.m, sizes = key[order], m[order], sizes[order]
        take = np.repeat(offs[:-1][order] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(terms))
        self.terms, tfs, self.offs = terms[take], tfs[take].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])
        self.part = 1_000_000_000 * tfs // (1000 * tfs + 20 * np.repeat(self.m, sizes))
        self.lo, self.hi, self.kids = [0], [len(sizes)], [[]]
        todo = [(0, 0)]
        while todo:
            node, depth = todo.pop()
            self.split(node, depth, todo)
        self.most = np.zeros((len(self.lo), size), np.int64)
        self.least = np.empty(len(self.lo), np.int64)
        self.low = np.empty(len(self.lo), np.int64)
        for i in range(len(self.lo) - 1, -1, -1):  # children come after their parents
            kids, lo, hi = self.kids[i], self.lo[i], self.hi[i]
            if kids:
                self.most[i], self.least[i], self.low[i] = self.most[kids].max(0), self.least[kids].min(), self.low[kids].min()
            else:
                at = slice(self.offs[lo], self.offs[hi])
                np.maximum.at(self.most[i], self.terms[at], tfs[at])
                self.least[i], self.low[i] = self.m[lo:hi].min(), self.key[lo:hi].min()

    def split(self, node: int, depth: int, todo: list) -> None:
        lo, hi = self.lo[node], self.hi[node]
        if hi - lo <= LEAF:
            return
        a, b = (self.terms[self.offs[i] + depth:self.offs[i + 1]] for i in (lo, hi - 1))
        short = min(len(a), len(b))
        apart = np.flatnonzero(a[:short] != b[:short])
        depth += int(apart[0]) if len(apart) else short  # the path all of them share
        at = self.offs[lo:hi] + depth
        ended = at >= self.offs[lo + 1:hi + 1]
        branch = np.where(ended, -1, self.terms[np.minimum(at, len(self.terms) - 1)]) if len(self.terms) else np.full(hi - lo, -1)
        starts = np.concatenate([[0], np.flatnonzero(branch[1:] != branch[:-1]) + 1, [hi - lo]]) + lo
        begin = None  # small branches side by side share a leaf
        for x, y in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if y - x > LEAF:
                if begin is not None:
                    self.add(node, begin, x)
                    begin = None
                if branch[x - lo] < 0:
                    for z in range(x, y, LEAF):
                        self.add(node, z, min(y, z + LEAF))
                else:
                    todo.append((self.add(node, x, y), depth + 1))
            elif begin is None:
                begin = x
            elif y - begin > LEAF:
                self.add(node, begin, x)
                begin = x
        if begin is not None:
            self.add(node, begin, hi)

    def add(self, parent: int, lo: int, hi: int) -> int:
        self.lo.append(lo)
        self.hi.append(hi)
        self.kids.append([])
        self.kids[parent].append(len(self.lo) - 1)
        return len(self.lo) - 1


class Best:
    """The best documents so far of every item, and what a further one has to beat."""

    def __init__(self, n_items: int):
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]
        self.score, self.key = np.zeros(n_items, np.int64), np.full(n_items, -LAST, np.int64)

    def beats(self, items: np.ndarray, score: np.ndarray, key: np.ndarray) -> np.ndarray:
        return (score > self.score[items]) | ((score == self.score[items]) & (key < self.key[items]))

    def add(self, item: int, score: int, key: int) -> None:
        heap = self.heaps[item]
        if len(heap) < TOP:
            heapq.heappush(heap, (score, -key))
        else:
            heapq.heappushpop(heap, (score, -key))
        if len(heap) == TOP:
            self.score[item], self.key[item] = heap[0][0], -heap[0][1]


def search(tree: Tree, asked: Asked, best: Best) -> None:
    """Depth-first branch and bound, block by block of items; within a block every item has its own bound."""
    for names, pairs, weight, first in asked.blocks:
        def scores(part: np.ndarray, alive: np.ndarray) -> np.ndarray:
            """Rows of parts by term into sums by item."""
            if len(alive) == len(names):
                return np.add.reduceat(part[:, pairs] * weight, first[:-1], axis=1)
            sizes = first[alive + 1] - first[alive]
            stop = np.cumsum(sizes)
            at = np.repeat(first[alive] - (stop - sizes), sizes) + np.arange(stop[-1])
            return np.add.reduceat(part[:, pairs[at]] * weight[at], stop - sizes, axis=1)

        todo = [(0, np.arange(len(names)), None)]
        while todo:
            node, alive, bound = todo.pop()
            if bound is not None:  # the bar may have risen since
                alive = alive[best.beats(names[alive], bound, tree.low[node])]
                if not len(alive):
                    continue
            kids = tree.kids[node]
            if kids:
                most = tree.most[kids]
                bounds = scores(1_000_000_000 * most // (1000 * most + 20 * tree.least[kids][:, None]), alive)
                for i in np.argsort(bounds.sum(1), kind="stable").tolist():
                    ok = best.beats(names[alive], bounds[i], tree.low[kids[i]])
                    if ok.any():
                        todo.append((kids[i], alive[ok], bounds[i][ok]))
                continue
            lo, hi = tree.lo[node], tree.hi[node]
            at = slice(tree.offs[lo], tree.offs[hi])
            part = np.zeros((hi - lo, asked.size), np.int64)
            part[np.repeat(np.arange(hi - lo), np.diff(tree.offs[lo:hi + 1])), tree.terms[at]] = tree.part[at]
            found = scores(part, alive)
            row, col = np.nonzero(best.beats(names[alive][None, :], found, tree.key[lo:hi, None]))
            for r, c in zip(row.tolist(), col.tolist()):
                best.add(int(names[alive[c]]), int(found[r, c]), int(tree.key[lo + r]))


def _rows(batch: pa.RecordBatch, asked: Asked):
    """(keys, m, offsets, term ranks, occurrences) of the rows that hold a term."""
    terms, tfs = batch.column(2), batch.column(3)
    sizes = np.diff(np.asarray(terms.offsets))
    held = sizes > 0
    key = np.asarray(batch.column(0).fill_null(LAST))[held]
    n = np.asarray(batch.column(1))[held].astype(np.int64)
    return (key, 50 + 50 * n * asked.n_docs // asked.n_terms, sizes[held], asked.rank[np.asarray(terms.flatten())], np.asarray(tfs.flatten()))


def best_of_tasks(rows: DataFrame, asked: Asked) -> DataFrame:
    """(item, doc_id, score): what each task holds best, at most TOP documents of an item."""
    shipped = rows.sparkSession.sparkContext.broadcast(asked)
    per_tree = int(max(LEAF, min(TREE_DOCS, LEAF * (TREE_CELLS // (2 * asked.size)))))

    def run(batches):
        asked = shipped.value
        best = Best(asked.n_items)
        held, n = [], 0

        def grow():
            key, m, sizes, terms, tfs = (np.concatenate(x) for x in zip(*held))
            offs = np.concatenate([[0], np.cumsum(sizes)])
            for a in range(0, len(key), per_tree):
                b = min(len(key), a + per_tree)
                at = slice(offs[a], offs[b])
                search(Tree(key[a:b], m[a:b], offs[a:b + 1] - offs[a], terms[at], tfs[at], asked.size), asked, best)

        for batch in batches:
            for a in range(0, batch.num_rows, per_tree):
                got = _rows(batch.slice(a, per_tree), asked)
                held.append(got)
                n += len(got[0])
                if n >= per_tree:
                    grow()
                    held, n = [], 0
        if n:
            grow()
        out = [(i, None if key == -LAST else -key, score) for i, heap in enumerate(best.heaps) for score, key in heap]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item int, doc_id long, score long")


def top_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``TOP`` documents of every item with the highest scores above 0."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    pairs = materialise(item_terms(items), "terms")
    turns = max(1, math.ceil(pairs.count() / TURN_PAIRS))
    out = []
    for turn in range(turns):
        held = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn).toArrow()
        if not held.num_rows:
            continue
        names = held["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        term = held["term"].to_numpy().view(np.uint64)
        vocabulary = np.unique(term)
        rows = materialise(vectors(docs, vocabulary), "vectors")
        total = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["terms"]:
            continue
        counts = rows.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
        df = np.zeros(len(vocabulary), np.int64)
        df[counts["t"].to_numpy()] = counts["count"].to_numpy()
        found = best_of_tasks(rows, Asked(np.asarray(names.indices), term, vocabulary, df, total["docs"], total["terms"]))
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        salts = math.ceil(math.sqrt(max(1, rows.rdd.getNumPartitions())))
        by_hash = W.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= TOP)
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= TOP)
        keys = spark.createDataFrame([(i, v) for i, v in enumerate(names.dictionary.to_pylist())], f"item int, item_id {kind.simpleString()}")
        out.append(found.join(keys, "item").select("item_id", "rank", "doc_id", "score"))
    empty = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out) if out else empty

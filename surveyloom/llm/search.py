"""Ranked lexical search: the best documents for each query item, by branch and bound over a tree of term vectors.

A document is reduced to the terms that any item has, with their counts, in the order of
their document frequency, the most frequent first. Documents sorted by these vectors form
a tree in which equal beginnings are one path. Each subtree, a stretch of the sorted
documents, knows the largest count of every term and the least length norm ``m`` in it.
As a score grows with a count and falls with ``m``, these bound all scores in the subtree:
an item descends depth first into the child with the highest bound, and leaves out what
cannot reach its ``top`` best. Every task grows trees over its own documents; the bests of
tasks are merged by score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.llm.common import stage

#: Bytes that are no part of a term become blanks, A-Z become a-z; bytes from 128 on belong to terms.
_TERM_BYTE = re.compile(rb"[0-9a-z\x80-\xff]")
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if _TERM_BYTE.match(bytes([c])) else 32 for c in range(256))

#: Items are taken in blocks of at most so many bytes of text and distinct terms (a larger item is a block of its
#: own), which bounds what is broadcast; each block is one pass over the documents.
BLOCK_BYTES, BLOCK_TERMS = 8 << 20, 1 << 16

#: Documents of a tree, and of a leaf below which it does not branch.
TREE, LEAF = 8192, 32

#: Bytes of a text that are cut into terms at a time.
AT_A_TIME = 1 << 22

#: Groups into which the tasks' bests are dealt before the last merge.
GROUPS = 256

#: Constants of the length norm and of the saturation of counts, in hundredths and thousandths.
B, K1 = 25, 12


def term_counts(text: str | bytes | None) -> Counter:
    """Terms of a whole text, with their counts; long texts are cut between terms."""
    data = (text.encode() if isinstance(text, str) else text or b"").translate(TERMS)
    found, at = Counter(), 0
    while at < len(data):
        end = at + AT_A_TIME
        if end < len(data):
            end = data.rfind(b" ", at, end)
            end = end if end > at else (data.find(b" ", at + AT_A_TIME) + 1 or len(data) + 1) - 1
        found.update(data[at:end].split())
        at = end
    return found


# ---- items -------------------------------------------------------------------------------

@dataclass
class Items:
    """A block of items: the ids, terms and counts of each, and the block's terms by place."""

    ids: list[int | None] = field(default_factory=list)
    counts: list[Counter] = field(default_factory=list)
    places: dict[bytes, int] = field(default_factory=dict)
    size: int = 0

    def add(self, item_id: int | None, text: str | None, found: Counter) -> None:
        self.ids.append(item_id)
        self.counts.append(found)
        self.size += len(text or "") * 4
        for term in found:
            self.places.setdefault(term, len(self.places))


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """Items come to the driver one partition at a time and are kept one block at a time."""
    block = Items()
    for key, words in items.select(F.col(item_id).cast("long"), text).toLocalIterator():
        found = term_counts(words)
        if block.ids and (block.size + 4 * len(words or "") > BLOCK_BYTES or len(block.places) + len(found) > BLOCK_TERMS):
            yield block
            block = Items()
        if found:
            block.add(key, words, found)
    if block.ids:
        yield block


# ---- term vectors ------------------------------------------------------------------------

def _vectors(sent) -> Callable:
    """Per document with a term its id, all its terms' number n, and places and counts of the items' terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = sent.value
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = term_counts(text.as_py())
                if n := found.total():
                    own = [(places[t], c) for t, c in found.items() if t in places]
                    rows.append((key, n, [p for p, _ in own], [c for _, c in own]))
            if rows:
                keys, ns, terms, tfs = zip(*rows)
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                       pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])
    return run


# ---- the tree ----------------------------------------------------------------------------

def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + K1 * m)


class Tree:
    """Documents sorted by their frequency-ordered vectors, and the subtrees of that order."""

    def __init__(self, doc_ids: np.ndarray, m: np.ndarray, terms: np.ndarray, tfs: np.ndarray, at: np.ndarray, n_terms: int):
        self.doc_ids, self.m, self.terms, self.tfs, self.at = doc_ids, m, terms, tfs, at
        self.lo, self.hi, self.children = [], [], []
        self._grow()
        self.largest = np.zeros((len(self.lo), n_terms), np.int32 if len(tfs) and tfs.max() > 65_535 else np.uint16)
        self.least, self.first = np.empty(len(self.lo), np.int64), np.empty(len(self.lo), np.int64)
        for node in reversed(range(len(self.lo))):  # children come after their parents
            if (below := self.children[node]) is not None:
                np.max(self.largest[below], axis=0, out=self.largest[node])
                self.least[node], self.first[node] = self.least[below].min(), self.first[below].min()
            else:
                a, b = at[self.lo[node]], at[self.hi[node]]
                np.maximum.at(self.largest[node], terms[a:b], tfs[a:b].astype(self.largest.dtype))
                own = slice(self.lo[node], self.hi[node])
                self.least[node], self.first[node] = m[own].min(), doc_ids[own].min()

    def _node(self, lo: int, hi: int) -> int:
        self.lo.append(lo)
        self.hi.append(hi)
        self.children.append(None)
        return len(self.lo) - 1

    def _shared(self, lo: int, hi: int) -> int:
        """Terms that all documents of a stretch begin with: those of its first and last, as they are sorted."""
        a, b = (self.terms[self.at[d]:self.at[d + 1]] for d in (lo, hi - 1))
        n = min(len(a), len(b))
        other = np.flatnonzero(a[:n] != b[:n])
        return int(other[0]) if len(other) else n

    def _grow(self) -> None:
        length = np.diff(self.at)
        waiting = [self._node(0, len(length))]
        while waiting:
            node = waiting.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= LEAF:
                continue
            depth = self._shared(lo, hi)
            has = length[lo:hi] > depth
            if not has.any():
                continue  # copies of one vector
            following = np.full(hi - lo, -1)
            following[has] = self.terms[self.at[lo:hi][has] + depth]
            ends = [*(np.flatnonzero(np.diff(following)) + 1 + lo).tolist(), hi]
            below, start = [], lo
            for i, end in enumerate(ends):
                # Small neighbours share a leaf.
                if i + 1 < len(ends) and ends[i + 1] - start <= LEAF:
                    continue
                below.append(self._node(start, end))
                start = end
            self.children[node] = np.array(below)
            waiting += below

    def bounds(self, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No document of a node scores higher."""
        tf = self.largest[nodes[:, None], terms].astype(np.int64)
        return (saturated(tf, self.least[nodes, None]) * weights).sum(axis=1)

    def scores(self, node: int, weight_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.lo[node], self.hi[node]
        a, b = self.at[lo], self.at[hi]
        doc = np.repeat(np.arange(hi - lo), np.diff(self.at[lo:hi + 1]))
        weights = weight_of[self.terms[a:b]]
        out = np.zeros(hi - lo, np.int64)
        own = weights > 0
        np.add.at(out, doc[own], saturated(self.tfs[a:b][own], self.m[lo:hi][doc[own]]) * weights[own])
        return out, self.doc_ids[lo:hi]

    def search(self, terms: np.ndarray, weights: np.ndarray, weight_of: np.ndarray, best: Best) -> None:
        """Offer ``best`` every document that can belong to it."""
        root = np.zeros(1, np.int64)
        waiting = [(self.bounds(root, terms, weights)[0], 0)]
        while waiting:
            bound, node = waiting.pop()
            if not best.may_take(bound, self.first[node]):
                continue
            below = self.children[node]
            if below is None:
                best.offer(*self.scores(node, weight_of))
                continue
            bounds = self.bounds(below, terms, weights)
            order = np.argsort(bounds, kind="stable")
            waiting += zip(bounds[order].tolist(), below[order].tolist())


class Best:
    """The ``top`` highest scores above 0, equal ones by the smallest id."""

    def __init__(self, top: int):
        self.top = top
        self.scores = self.ids = np.zeros(0, np.int64)

    def may_take(self, bound: int, first: int) -> bool:
        if bound <= 0 or len(self.scores) < self.top:
            return bound > 0
        return bound > self.scores[-1] or (bound == self.scores[-1] and first <= self.ids[-1])

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        own = scores > 0
        scores, ids = np.concatenate([self.scores, scores[own]]), np.concatenate([self.ids, ids[own]])
        order = np.lexsort((ids, -scores))[:self.top]
        self.scores, self.ids = scores[order], ids[order]


def length_norm(n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """100 - B + B * n * docs div length, exact also where the product passes 64 bits."""
    if not len(n) or int(n.max()) * B * docs < 1 << 63:
        return 100 - B + (n * (B * docs)) // length
    return np.array([100 - B + B * int(x) * docs // length for x in n.tolist()], np.int64)


#: Stands for a NULL id in a tree: after all others.
_NO_ID = np.iinfo(np.int64).max


def _trees(batch: pa.RecordBatch, docs: int, length: int, rank: np.ndarray) -> Iterator[Tree]:
    for start in range(0, batch.num_rows, TREE):
        own = batch.slice(start, TREE)
        lists = own.column(2)
        at = lists.offsets.to_numpy().astype(np.int64)
        terms, tfs = (own.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
        at -= at[0]
        terms = rank[terms]
        inside = np.lexsort((terms, np.repeat(np.arange(len(at) - 1), np.diff(at))))
        terms, tfs = terms[inside], tfs[inside]
        raw = terms.astype(">u4").tobytes()
        paths = [raw[4 * a:4 * b] for a, b in zip(at.tolist(), at[1:].tolist())]
        order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        size = np.diff(at)[order]
        new_at = np.concatenate([[0], np.cumsum(size)])
        entries = np.arange(new_at[-1]) + np.repeat(at[order] - new_at[:-1], size)
        keys = own.column(0).fill_null(_NO_ID).to_numpy()[order]
        m = length_norm(own.column(1).to_numpy()[order], docs, length)
        yield Tree(keys, m, terms[entries], tfs[entries], new_at, len(rank))


def _searched(sent, top: int) -> Callable:
    """The best documents of each item among the documents of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, length, rank, queries = sent.value
        best = [Best(top) for _ in queries]
        weight_of = np.zeros(len(rank), np.int64)
        for batch in batches:
            for tree in _trees(batch, docs, length, rank):
                for (_, terms, weights), found in zip(queries, best):
                    weight_of[terms] = weights
                    tree.search(terms, weights, weight_of, found)
                    weight_of[terms] = 0
        no = np.concatenate([np.zeros(0, np.int64), *(np.full(len(f.ids), i) for i, f in enumerate(best))]).astype(np.int64)
        if len(no):
            ids = np.concatenate([f.ids for f in best])
            keys = [queries[i][0] for i in no.tolist()]
            yield pa.record_batch([pa.array(no), pa.array(keys, pa.int64()), pa.array(ids, mask=ids == _NO_ID),
                                   pa.array(np.concatenate([f.scores for f in best]))], ["no", "item_id", "doc_id", "score"])
    return run


def _search_block(docs: DataFrame, block: Items, top: int, id_col: str, text: str) -> DataFrame:
    context = docs.sparkSession.sparkContext
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    vectors = stage(slim.mapInArrow(_vectors(context.broadcast(block.places)), "doc_id long, n long, terms array<int>, tfs array<int>"), "vectors")
    n_docs, length = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One number for each term of the block, of which there are at most BLOCK_TERMS, or those of one item.
    held = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    df = np.array([held.get(i, 0) for i in range(len(block.places))], np.int64)
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()]
    queries = []
    for key, counts in zip(block.ids, block.counts):
        own = [(int(rank[p]), c * weight[p]) for t, c in counts.items() if df[p := block.places[t]] and weight[p]]
        own.sort()
        queries.append((key, np.array([r for r, _ in own], np.int64), np.array([w for _, w in own], np.int64)))
    sent = context.broadcast((n_docs, length, rank, queries))
    found = vectors.filter(F.size("terms") > 0).mapInArrow(_searched(sent, top), "no long, item_id long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    grouped = found.withColumn("__group", F.spark_partition_id() % GROUPS)
    in_group = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("no", "__group").orderBy(*order)))
    few = in_group.filter(F.col("rank") <= top)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(*order))).filter(F.col("rank") <= top)
    return stage(last.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents with the highest score above 0 for each row of ``items``.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, only A-Z lower-cased, of whole texts.
    NULL and empty texts have none; an item without terms, or whose terms no document holds, has no rows. Every row
    of ``items`` and of ``docs`` counts for itself, also where ids are repeated: a repeated item gets its list
    twice, a repeated document stands in a list as often. Equal scores stand by id, a NULL id last. Other columns
    are not read; an empty table on either side gives an empty result.

    Items are taken in blocks of bounded size. The results are written, as each block's search is a job of its own.
    """
    spark: SparkSession = docs.sparkSession
    found = [_search_block(docs, block, top, id_col, text) for block in item_blocks(items, item_id, item_text)]
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found) if found else empty

"""Line dedup across documents: two Bloom filters pick the suspects, an exact count of these decides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import BLANKS, join_heads, stage
from surveyloom.llm.textscan import flat_text, mix

#: Shorter keys are never dropped (code points).
LEAST_CHARS = 10

#: Filter size: bits for each expected line, bounded at both ends. The upper bound (2**28 bits, 32 MB) bounds what is
#: collected and broadcast; beyond it only the share of false suspects grows, never the result.
BITS_PER_LINE = 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
HASHES = 3
BLOCK_BYTES = 4096

#: Bytes of texts whose lines are hashed at a time.
CHUNK = 1 << 21

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Base:
    """Sums of bytes times powers of an odd number: the hash of any stretch follows from two running sums."""

    def __init__(self, seed: int):
        self.base = int(mix(np.array([seed], np.uint64))[0]) | 1
        self.letters = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000))
        self.up = self._powers(self.base)
        self.down = self._powers(pow(self.base, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(CHUNK + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of stretches of at most ``CHUNK`` bytes of lower-case text."""
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.up[:len(data)], out=total[1:])
        return (total[ends] - total[starts]) * self.down[starts]

    def long(self, data: np.ndarray) -> int:
        """The same for one stretch of any length."""
        out, power = 0, 1
        for lo in range(0, len(data), CHUNK):
            part = data[lo:lo + CHUNK]
            own = int((self.letters[part] * self.up[:len(part)]).sum(dtype=np.uint64))
            out, power = (out + own * power) % (1 << 64), power * pow(self.base, len(part), 1 << 64) % (1 << 64)
        return out


@lru_cache(maxsize=1)
def _bases() -> tuple[_Base, _Base]:
    return _Base(11), _Base(12)


def _pieces(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of lines that lie within ``CHUNK`` bytes; a longer line is a run of its own."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        yield i, j
        i = j


def line_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines before each text, whether a line's key is long enough to count, and 128 bits for each key.

    A key is the line with blanks stripped at both ends and A-Z in lower case; NULL is
    an empty text. All lines of the texts are bounded, stripped and hashed together.
    """
    data, at = flat_text(texts)
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, at)
    first = before + np.arange(len(at))  # number of the first line of each text
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    opening = np.zeros(first[-1], bool)
    opening[first[:-1]] = True
    starts[opening], starts[~opening] = at[:-1], breaks + 1
    closing = np.zeros(first[-1], bool)
    closing[first[1:] - 1] = True
    ends[closing], ends[~closing] = at[1:], breaks
    solid = np.flatnonzero(~_BLANK[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = np.flatnonzero(a < b)
    begin, end = solid[a[some]], solid[b[some] - 1] + 1
    hashes = np.zeros((first[-1], 2), np.uint64)
    size = np.zeros(first[-1], np.int64)
    for i, j in _pieces(begin, end):
        lo, hi = begin[i], end[j - 1]
        own, which = _LOWER[data[lo:hi]], some[i:j]
        points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
        s, e = begin[i:j] - lo, end[i:j] - lo
        size[which] = points[e] - points[s]
        for k, base in enumerate(_bases()):
            hashes[which, k] = base.long(own) if hi - lo > CHUNK else base(own, s, e)
    hashes[:, 0] = mix(hashes[:, 0] ^ size.astype(np.uint64))
    hashes[:, 1] = mix(hashes[:, 1])
    return first, size >= LEAST_CHARS, hashes


def _bits(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """Positions in the filter: one row for each hash."""
    step = hashes[:, 1] | np.uint64(1)
    probes = hashes[:, :1] + step[:, None] * np.arange(HASHES, dtype=np.uint64)
    return (probes & np.uint64(n_bits - 1)).astype(np.int64)


def _test(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all bits of a row of positions are set."""
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def _mark(once: np.ndarray, twice: np.ndarray, doc: np.ndarray, hashes: np.ndarray) -> None:
    """Enter the keys of several documents: one that two of them hold, or whose bits are all set, was seen before."""
    order = np.lexsort((doc, hashes[:, 0]))
    doc, hashes = doc[order], hashes[order]
    new_key = np.ones(len(doc), bool)
    new_key[1:] = hashes[1:, 0] != hashes[:-1, 0]
    other_doc = np.zeros(len(doc), bool)
    other_doc[1:] = ~new_key[1:] & (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new_key)
    shared = np.logical_or.reduceat(other_doc, starts) if len(starts) else other_doc
    at = _bits(hashes[starts], once.size * 8)
    before = _test(once, at) | shared
    for bits, places in ((twice, at[before].ravel()), (once, at.ravel())):
        np.bitwise_or.at(bits, places >> 3, (128 >> (places & 7)).astype(np.uint8))


def _partial(n_bits: int):
    """A pair of filters for each task, sent as the blocks in which a bit is set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(n_bits // 8, np.uint8), np.zeros(n_bits // 8, np.uint8)
        for batch in batches:
            for texts in _slices(batch.column(0)):
                first, counts, hashes = line_keys(texts)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                _mark(once, twice, doc[counts], hashes[counts])
        a, b = (x.reshape(-1, BLOCK_BYTES) for x in (once, twice))
        used = np.flatnonzero(a.any(axis=1))
        for lo in range(0, len(used), 1024):
            part = used[lo:lo + 1024]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(part, pa.int64()), "once": pa.array([x.tobytes() for x in a[part]], pa.binary()),
                "twice": pa.array([x.tobytes() for x in b[part]], pa.binary())})
    return run


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about ``CHUNK`` bytes; a longer one is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    through, i = np.cumsum(sizes, dtype=np.int64), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(through, CHUNK + (through[i - 1] if i else 0), "right")))
        yield texts.slice(i, j - i)
        i = j


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, one block at a time: set in one part and again in another, or twice in a part."""
    block, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()),
                                           "twice": pa.array([twice.tobytes()], pa.binary())})
    for batch in batches:
        for i, a, b in zip(*(batch.column(c).to_pylist() for c in ("block", "once", "twice")), strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            if i != block:
                if block is not None and twice.any():
                    yield done()
                block, once, twice = i, a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if block is not None and twice.any():
        yield done()


def twice_seen(docs: DataFrame, n_bits: int) -> bytes:
    """The bits that keys of two or more documents set, whole; at most ``MOST_BITS`` bits reach the driver.

    Each task fills its own two filters; the blocks of all tasks are dealt out by
    block number and merged there, so the driver only gets the merged filter. A bit
    is kept if two tasks have it, or one task saw a key again.
    """
    parts = docs.select("text").mapInArrow(_partial(n_bits), "block long, once binary, twice binary")
    merged = (parts.repartition("block").sortWithinPartitions("block")
              .mapInArrow(_merge, "block long, twice binary"))
    bits = bytearray(n_bits // 8)
    for row in merged.toLocalIterator():
        bits[row.block * BLOCK_BYTES:(row.block + 1) * BLOCK_BYTES] = row.twice
    return bytes(bits)


class _Suspects:
    """Tests hashes against the broadcast filter; unpacked once in a worker."""

    def __init__(self, sent, n_bits: int):
        self.sent, self.n_bits, self.bits = sent, n_bits, None

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if self.bits is None:
            self.bits = np.frombuffer(self.sent.value, np.uint8)
        return _test(self.bits, _bits(hashes, self.n_bits))

    def __getstate__(self):
        return {"sent": self.sent, "n_bits": self.n_bits, "bits": None}


def _suspected(suspects: _Suspects):
    """(doc_id, digest) for the suspected keys of each document, each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done = batch.column("doc_id").to_numpy(), 0
            for texts in _slices(batch.column("text")):
                first, counts, hashes = line_keys(texts)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[counts]
                hashes = hashes[counts]
                hit = suspects(hashes)
                doc, hashes = doc[hit], hashes[hit]
                order = np.lexsort((hashes[:, 1], hashes[:, 0], doc))
                doc, hashes = doc[order], hashes[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1]).any(axis=1)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[done + doc[new]], pa.int64()),
                                                  "key": pa.array(_digests(hashes[new]), pa.binary())})
                done += len(texts)
    return run


def _digests(hashes: np.ndarray) -> list[bytes]:
    """16 bytes for each key."""
    return np.ascontiguousarray(hashes).view("V16").ravel().tolist()


def _drop(names: list[str], text: str):
    """Cut the lines whose keys a document loses; ``__drop`` is NULL if it loses none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, losses = pc.fill_null(batch.column(text), ""), batch.column("__drop")
            kept, lines = texts.to_pylist(), (pc.count_substring(texts, "\n").to_numpy() + 1).astype(np.int64)
            dropped, loser = np.zeros(len(kept), np.int64), np.flatnonzero(losses.is_valid())
            done = 0
            for own in _slices(texts.take(pa.array(loser))):
                first, counts, hashes = line_keys(own)
                keys, counts = _digests(hashes), counts.tolist()
                for row, lo, hi in zip(loser[done:done + len(own)].tolist(), first.tolist(), first[1:].tolist()):
                    gone = set(losses[row].as_py())
                    stay = [line for line, c, k in zip(kept[row].split("\n"), counts[lo:hi], keys[lo:hi], strict=True)
                            if not (c and k in gone)]
                    dropped[row] = hi - lo - len(stay)
                    kept[row] = "\n".join(stay)
                done += len(own)
            own = [pa.array(kept, pa.string()) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lines), pa.array(dropped)], [*names, "n_lines", "n_dropped"])
    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with repeated lines removed from ``text``, and n_lines (before) and n_dropped.

    A line is known by its key: blanks stripped, A-Z lower-cased. Keys of at least
    ten code points found in two or more documents lose all lines except those of
    the document with the smallest id. Columns of ``docs`` stay, whatever their
    names; n_lines and n_dropped replace columns of that name.

    Only keys that the filters suspect are shuffled, as 16-byte digests; they are
    counted exactly, with a partial minimum and maximum of the ids before the
    shuffle, so a line that a third of all documents hold is no hot key there, and
    such lines meet their first document without a shuffle. Texts move only if Spark finds the list of losses too large to broadcast.

    NULL and empty texts are one empty line; NULL becomes an empty text. Documents
    with a NULL id keep all lines and count for no key. Rows that repeat an id are
    one document. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(
        "doc_id is not null and text is not null")
    lines = slim.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_LINE * lines - 1).bit_length())) if lines else LEAST_BITS
    suspects = _Suspects(spark.sparkContext.broadcast(twice_seen(slim, n_bits)), n_bits)

    found = stage(slim.mapInArrow(_suspected(suspects), "doc_id long, key binary"), "lines")
    repeated = (found.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                         F.count(F.lit(1)).alias("__n"))
                .filter("first <> last").select(F.col("key").alias("__key"), "first", "__n"))
    losses = join_heads(found, repeated, found.count()).filter("doc_id <> first")
    drops = stage(losses.groupBy("doc_id").agg(F.collect_set("key").alias("__drop"))
                  .withColumnRenamed("doc_id", "__doc"), "drops")

    own = docs.drop("n_lines", "n_dropped", "__drop", "__doc")
    joined = own.join(drops, F.col(id_col) == F.col("__doc"), "left").drop("__doc")
    names = own.columns
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in own.schema)
    return joined.mapInArrow(_drop(names, text), f"{schema}, n_lines long, n_dropped long")

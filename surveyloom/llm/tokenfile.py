"""Token ids in binary files: patched frame-of-reference blocks with an index, written and read in document order.

A file is a row of segments, a segment holds whole documents. All numbers are little endian:

=============  ============================================================================================
header         magic ``PFORIDS1``; then as 64 bits: bytes of the segment, number of the part, ids before the
               segment in its part, documents, ids, blocks, 32-bit words of packed values, exceptions
documents      ids (64 bits each), lengths (64 bits each), one byte each that is 1 where the id is NULL
blocks         least value (32 bits each), width (8 bits each), first packed word and first exception (64 bits each)
packed         the low ``width`` bits of value - least, 256 values to a block in eight lanes of 32
exceptions     place in the block (8 bits each) and the bits above ``width`` (32 bits each)
end            ``PFOREND``, closed by the line feed that Spark's text writer puts after each row
=============  ============================================================================================

The files are written by Spark's text source, so its commit protocol covers lost executors and tasks that run
twice, and read by its binaryFile source; workers open no files. Beside them a small table gives the ids before
each part.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.llm.common import shared_root
from surveyloom.llm.textscan import flat_text

MAGIC, END = b"PFORIDS1", b"PFOREND\n"
HEADER = struct.Struct("<8s8q")

#: Values in a block, in lanes that are packed side by side.
BLOCK, LANES = 256, 8

#: Part of a block's values that must fit its width; the others are exceptions.
FITTING = 0.9

#: Ids in a segment, unless a single document has more, and segments in a file.
SEGMENT_IDS, FILE_SEGMENTS = 1 << 18, 64

#: Bytes of texts that are encoded at a time.
AT_A_TIME = 1 << 21

#: Pieces of text whose ids a worker remembers, in each of two generations.
REMEMBERED = 250_000

_POWERS = np.uint64(1) << np.arange(33, dtype=np.uint64)


# ---- blocks ------------------------------------------------------------------------------

def _layout(width: int) -> list[tuple[int, int, int]]:
    """(row, word, shift) of the 32 rows of a block."""
    return [(r, *divmod(r * width, 32)) for r in range(32)]


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Blocks of values below 2**width to ``width * LANES`` words each."""
    rows = values.reshape(-1, 32, LANES)
    out = np.zeros((len(rows), width + 1, LANES), np.uint64)
    for r, word, shift in _layout(width):
        both = rows[:, r] << np.uint64(shift)
        out[:, word] |= both & np.uint64(0xFFFFFFFF)
        out[:, word + 1] |= both >> np.uint64(32)
    return out[:, :width].reshape(len(rows), -1).astype(np.uint32)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    rows = np.zeros((len(words), width + 1, LANES), np.uint64)
    rows[:, :width] = words.reshape(len(words), width, LANES)
    out = np.empty((len(words), 32, LANES), np.uint64)
    for r, word, shift in _layout(width):
        both = rows[:, word] | (rows[:, word + 1] << np.uint64(32) if shift + width > 32 else np.uint64(0))
        out[:, r] = (both >> np.uint64(shift)) & (_POWERS[width] - np.uint64(1))
    return out.reshape(-1, BLOCK)


def encode_blocks(ids: np.ndarray, fitting: float = FITTING) -> tuple[np.ndarray, ...]:
    """least, width, first word, first exception of each block, then packed words, exception places and high bits."""
    n = -(-len(ids) // BLOCK)
    values = np.empty((n, BLOCK), np.uint64)
    values.ravel()[:len(ids)] = ids
    values.ravel()[len(ids):] = ids[-1] if len(ids) else 0
    least = values.min(axis=1) if n else np.zeros(0, np.uint64)
    values -= least[:, None]
    fit = min(BLOCK - 1, max(0, int(np.ceil(fitting * BLOCK)) - 1))
    width = np.searchsorted(_POWERS, np.partition(values, fit, axis=1)[:, fit], "right").astype(np.uint8)
    first = np.concatenate([[0], np.cumsum(width.astype(np.int64) * LANES)])
    packed = np.empty(first[-1], np.uint32)
    high = values >> width[:, None].astype(np.uint64)
    low = values & (_POWERS[width] - np.uint64(1))[:, None]
    for w in np.unique(width[width > 0]).tolist():
        which = np.flatnonzero(width == w)
        packed[first[which][:, None] + np.arange(w * LANES)] = _pack(low[which], w)
    block, place = np.nonzero(high)
    exceptions = np.searchsorted(block, np.arange(n))
    return (least.astype(np.uint32), width, first[:-1], exceptions.astype(np.int64), packed,
            place.astype(np.uint8), high[block, place].astype(np.uint32))


class Segment:
    """One segment of a file, read in place."""

    def __init__(self, data: memoryview):
        (magic, self.size, self.part, self.before, self.n_docs, self.n_ids, self.n_blocks, n_words,
         n_exceptions) = HEADER.unpack_from(data)
        if magic != MAGIC or bytes(data[self.size - len(END):self.size]) != END:
            raise ValueError("not a segment of token ids, or a part of one")
        self._data, self._at = data, HEADER.size
        self.doc_ids, self.lengths = self._next(np.int64, self.n_docs), self._next(np.int64, self.n_docs)
        self.null = self._next(np.uint8, self.n_docs)
        self.least, self.width = self._next(np.uint32, self.n_blocks), self._next(np.uint8, self.n_blocks)
        self.first, self.exceptions = self._next(np.int64, self.n_blocks), self._next(np.int64, self.n_blocks)
        self.packed = self._next(np.uint32, n_words)
        self.place, self.high = self._next(np.uint8, n_exceptions), self._next(np.uint32, n_exceptions)

    def _next(self, kind: type, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, np.dtype(kind).newbyteorder("<"), n, self._at)
        self._at += out.nbytes
        return out

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids from ``lo`` up to ``hi`` of the segment; only the blocks that hold them are unpacked."""
        hi = self.n_ids if hi is None else hi
        a, b = lo // BLOCK, -(-hi // BLOCK)
        width = self.width[a:b]
        out = np.zeros((b - a, BLOCK), np.uint64)
        for w in np.unique(width[width > 0]).tolist():
            which = np.flatnonzero(width == w)
            out[which] = _unpack(self.packed[self.first[a:b][which][:, None] + np.arange(w * LANES)], w)
        ends = np.append(self.exceptions, len(self.place))
        e = slice(*ends[[a, b]].tolist())
        block = np.repeat(np.arange(b - a), np.diff(ends[a:b + 1]))
        out[block, self.place[e]] |= self.high[e].astype(np.uint64) << width[block].astype(np.uint64)
        out += self.least[a:b, None].astype(np.uint64)
        return out.ravel()[lo - a * BLOCK:hi - a * BLOCK].astype(np.uint32)


def segment_bytes(part: int, before: int, doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray,
                  ids: np.ndarray) -> bytes:
    """A whole segment but for the line feed at its end, which the writer adds."""
    blocks = encode_blocks(ids)
    sections = [np.ascontiguousarray(x, np.dtype(x.dtype).newbyteorder("<")).tobytes()
                for x in (doc_ids.astype(np.int64), lengths.astype(np.int64), null.astype(np.uint8), *blocks)]
    size = HEADER.size + sum(map(len, sections)) + len(END)
    header = HEADER.pack(MAGIC, size, part, before, len(doc_ids), len(ids), len(blocks[0]), len(blocks[4]), len(blocks[5]))
    return b"".join([header, *sections, END[:-1]])


def segments(content: memoryview) -> Iterator[Segment]:
    """The segments of a file, one after the other."""
    while len(content):
        found = Segment(content)
        yield found
        content = content[found.size:]


# ---- encoding ----------------------------------------------------------------------------

# Kinds of bytes: blanks, letters, digits, other ASCII, the apostrophe, and all beyond ASCII.
_BLANK, _LETTER, _DIGIT, _SIGN, _APOSTROPHE, _BEYOND = range(6)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[list(b" \t\n\v\f\r")] = _BLANK
_KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER
_KIND[list(b"0123456789")] = _DIGIT
_KIND[list(b"'")] = _APOSTROPHE
_KIND[128:] = _BEYOND
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Whether a word of the vocabulary's pattern always ends between two kinds. Signs and apostrophes run on into each
#: other, an apostrophe into letters, and what is beyond ASCII can be anything.
_ENDS = np.zeros((6, 6), bool)
for _pair in ((_LETTER, _DIGIT), (_LETTER, _SIGN), (_LETTER, _APOSTROPHE), (_DIGIT, _LETTER), (_DIGIT, _DIGIT),
              (_DIGIT, _SIGN), (_DIGIT, _APOSTROPHE), (_SIGN, _LETTER), (_SIGN, _DIGIT), (_APOSTROPHE, _DIGIT)):
    _ENDS[_pair] = True


class LibraryEncoder:
    """Ids of many texts by the tokenizers library, which sees each piece of text once.

    Pieces end at ASCII blanks, and where kinds of ASCII characters meet between which the
    vocabulary's pattern always ends a word; no step before it (composition, lower case)
    looks across such a place, so the ids of a text are those of its pieces, one after the
    other. Texts with the beginning of a special token are cut at blanks only, and kept in
    their case. A slice's pieces are made distinct by Arrow; those met in earlier slices are
    remembered, in two generations of bounded size. Pieces of plain letters go to the
    library's model at once, others through its whole chain.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, 32 bits each."""
        known, older = self.known, self.older
        found = [known.get(p) for p in pieces]
        rest = []
        for i, ids in enumerate(found):
            if ids is not None:
                continue
            piece = pieces[i]
            if (ids := older.get(piece)) is None:
                if not (piece.isascii() and piece.isalpha() and piece.islower()):
                    rest.append(i)
                    continue
                ids = array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()
            found[i] = known[piece] = ids
        for i, one in zip(rest, self.library.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
            found[i] = known[pieces[i]] = array("I", one.ids).tobytes()
        if len(known) > REMEMBERED:
            self.known, self.older = {}, known
        return found

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        data, at = flat_text(texts)
        if not len(data):
            return pc.ascii_split_whitespace(pc.fill_null(texts, "")).cast(pa.large_list(pa.large_string()))
        kinds = _KIND[data]
        cut = np.flatnonzero(_ENDS.ravel()[kinds[:-1] * np.uint8(6) + kinds[1:]]) + 1
        special = pc.match_substring(pc.fill_null(texts, ""), "<|").to_numpy(zero_copy_only=False)
        lower = _LOWER[data]
        if special.any():
            whole = np.repeat(special, np.diff(at))
            lower, cut = np.where(whole, data, lower), cut[~whole[cut]]
        spread = np.insert(lower, cut, 32)
        places = at + np.searchsorted(cut, at, "left")
        apart = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(places), pa.py_buffer(spread)])
        return pc.ascii_split_whitespace(apart)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the places between texts; NULL and empty texts have none."""
        lists = self._pieces(texts)
        flat = lists.flatten().dictionary_encode()
        found = self._learn(flat.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        every = np.frombuffer(b"".join(found), np.uint32)
        which = flat.indices.to_numpy()
        n = size[which]
        through = np.concatenate([[0], np.cumsum(n)])
        starts = np.concatenate([[0], np.cumsum(size)])[which]
        starts -= through[:-1]
        places = np.repeat(starts, n)
        places += np.arange(through[-1])
        return every[places], through[lists.offsets.to_numpy()]


@lru_cache(maxsize=1)
def _encoder(spec: str) -> LibraryEncoder:
    """One encoder for all tasks of a worker, with what it remembers."""
    return LibraryEncoder(spec)


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` together; a larger row is a run of its own."""
    through, i = np.cumsum(sizes, dtype=np.int64), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(through, most + (through[i - 1] if i else 0), "right")))
        yield i, j
        i = j


def _written(sent, end_id: int) -> Callable:
    """Segments of one part; its number and the ids before a segment stand in the segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = _encoder(sent.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            null, keys = keys.is_null().to_numpy(zero_copy_only=False), pc.fill_null(keys, 0).to_numpy()
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for lo, hi in _cuts(sizes, AT_A_TIME):
                ids, at = encode(texts.slice(lo, hi - lo))
                ids = np.insert(ids, at[1:], end_id)
                lengths = np.diff(at) + 1
                at = np.concatenate([[0], np.cumsum(lengths)])
                for a, b in _cuts(lengths, SEGMENT_IDS):
                    own = ids[at[a]:at[b]]
                    data = segment_bytes(part, before, keys[lo + a:lo + b], null[lo + a:lo + b], lengths[a:b], own)
                    before += len(own)
                    yield pa.record_batch([pa.array([data], pa.binary())], ["segment"])
    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                      text: str = "text") -> None:
    """Encode whole texts, end each with ``end_id``, and write all ids by ascending id into new files of ``folder``.

    ``tokenizer`` is the tokenizer's JSON file on the driver, whose text is broadcast (a file of fixed size). NULL
    and empty texts have the end id only. Documents with a NULL id come first; equal ids stand by a hash of their
    text, then as Spark reads them, so that repeated rows are kept and an id with a third of all rows is dealt over
    many parts. Other columns of ``docs`` are not read. An empty table gives files without documents.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(file.read())
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = slim.withColumns({"__hash": F.xxhash64("text"), "__place": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("__hash"), F.col("__place")]
    sorted_docs = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = sorted_docs.mapInArrow(_written(sent, end_id), "segment binary").select(F.col("segment").cast("string"))
    rows.write.option("maxRecordsPerFile", FILE_SEGMENTS).option("compression", "none").text(f"{folder}/ids")
    sizes = _files(spark, folder).mapInArrow(_headers, "part long, n_ids long").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    along = Window.orderBy("part")  # one row for each part
    sizes.select("part", (F.sum("n_ids").over(along) - F.col("n_ids")).alias("part_start")).write.parquet(f"{folder}/parts")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{folder}/ids").select("content")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for content in batch.column(0):
            yield from segments(memoryview(content.as_buffer()))


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s in _contents(batches):
        yield pa.record_batch([pa.array([s.part]), pa.array([s.n_ids])], ["part", "n_ids"])


def _documents(whole: bool) -> Callable:
    """Rows of documents with their ids, or with the ids' checksum only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _contents(batches):
            ids, at = s.ids(), np.concatenate([[0], np.cumsum(s.lengths)])
            columns = {"doc_id": pa.array(s.doc_ids, mask=s.null.astype(bool)), "part": pa.array(np.full(s.n_docs, s.part)),
                       "before": pa.array(s.before + at[:-1]), "n_tokens": pa.array(s.lengths)}
            if whole:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            else:
                raw = memoryview(ids.astype("<u4")).cast("B")
                columns["ids_crc32"] = pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at.tolist(), at[1:].tolist())], pa.int64())
            yield pa.record_batch([*columns.values()], [*columns])
    return run


def read_token_files(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens with the end id, and ids.

    With ``whole=False`` ids_crc32 stands in place of the ids: the checksum of all of them
    as unsigned 32-bit little-endian numbers.
    """
    last = "ids array<int>" if whole else "ids_crc32 long"
    found = _files(spark, folder).mapInArrow(_documents(whole), f"doc_id long, part long, before long, n_tokens long, {last}")
    starts = spark.read.schema("part long, part_start long").parquet(f"{folder}/parts")
    return found.join(starts, "part").select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens",
                                             last.split(" ")[0])


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from files in the shared folder."""
    spark = docs.sparkSession
    folder = f"{shared_root(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(spark, folder, whole=False)

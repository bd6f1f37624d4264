"""Near-duplicate groups: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import components, join_heads, stage
from surveyloom.llm.textscan import mix, scan_words, windows

#: Words in a shingle, and the least similarity of a link in percent.
SHINGLE = 5
LEAST_PERCENT = 85

#: A signature has CHUNKS chunks of CHUNK symbols of 16 bits. By the pigeonhole principle, two signatures that differ
#: in at most 2 * CHUNKS - 1 symbols agree in some chunk but for at most one symbol; every chunk is indexed once for
#: each symbol left out. At a similarity of 0.85 a pair has two errors in a given chunk with probability 0.165, so it
#: escapes all eight with 5.5e-7, and less above.
CHUNKS, CHUNK = 8, 5

#: Documents of one candidate group that are compared in one task with as many others.
BLOCK = 128

_SEEDS = mix(np.arange(1, CHUNKS * CHUNK + 1, dtype=np.uint64))
_FACTORS = mix(_SEEDS + np.uint64(77)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Runs of texts with the sorted distinct shingle hashes of each."""
    for lo, hi, offsets, _, _, hashes in scan_words(texts, lower=True):
        runs, at = windows(hashes, offsets, SHINGLE)
        out = []
        for i in range(hi - lo):
            own = np.sort(runs[at[i]:at[i + 1]])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            out.append(own)
        yield lo, hi, out


def index_keys(sets: list[np.ndarray]) -> np.ndarray:
    """CHUNKS * CHUNK keys for each nonempty set: a chunk of the signature with one symbol left out."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    symbols = np.empty((len(sets), CHUNKS, CHUNK), np.uint64)
    for k, (seed, factor) in enumerate(zip(_SEEDS, _FACTORS, strict=True)):
        least = np.minimum.reduceat((flat ^ seed) * factor, starts)
        symbols[:, k // CHUNK, k % CHUNK] = mix(least) & np.uint64(0xFFFF)
    keys = np.empty((len(sets), CHUNKS, CHUNK), np.uint64)
    for left_out in range(CHUNK):
        rest = [k for k in range(CHUNK) if k != left_out]
        packed = sum(symbols[:, :, k] << np.uint64(16 * i) for i, k in enumerate(rest))
        kind = mix(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(left_out + 1))
        keys[:, :, left_out] = mix(packed ^ kind)
    return keys.reshape(len(sets), -1).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, set_hash, keys); set_hash and keys are NULL for an empty set."""
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, sets in shingle_sets(batch.column("text")):
            sizes = np.array([len(s) for s in sets], np.int64)
            full = [s for s in sets if len(s)]
            hashes = iter(_set_hashes(full) if full else [])
            keys = iter(index_keys(full)) if full else iter(())
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids.slice(lo, hi - lo), "n_shingles": pa.array(sizes),
                "set_hash": pa.array([next(hashes) if n else None for n in sizes], pa.binary()),
                "keys": pa.array([next(keys) if n else None for n in sizes], pa.list_(pa.int64()))})


def _set_hashes(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits that stand for a set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    sums = np.stack([np.add.reduceat(mix(flat ^ np.uint64(seed)), starts) for seed in (0x5bd1e995, 0x27d4eb2f165667c5)], 1)
    return [row.tobytes() for row in sums]


def _with_sets(names: list[str]):
    """Replace the text by its shingle set as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sets in shingle_sets(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(n).slice(lo, hi - lo) for n in names],
                     pa.array([s.tobytes() for s in sets], pa.binary())], [*names, "shingles"])
    return run


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (doc_id, key) whose two sets are alike enough, as links (a, b)."""
    for batch in batches:
        hits = []
        for own, head in zip(batch.column("shingles"), batch.column("head_shingles"), strict=True):
            left, right = (np.frombuffer(x.as_buffer(), np.uint64) for x in (own, head))
            both = len(np.intersect1d(left, right, assume_unique=True))
            hits.append(100 * both >= LEAST_PERCENT * (len(left) + len(right) - both))
        kept = batch.select(["doc_id", "key"]).filter(pa.array(hits, pa.bool_()))
        yield pa.RecordBatch.from_arrays(kept.columns, ["a", "b"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right, as a matrix.

    Shingles are numbered within the two lists; bits of the sets are multiplied as
    matrices, some thousand shingles at a time.
    """
    flat = np.concatenate([*left, *right])
    values, number, uses = np.unique(flat, return_inverse=True, return_counts=True)
    shared = uses[number] > 1  # a shingle in one set only adds nothing
    renumber = np.cumsum(uses > 1) - 1
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])[shared]
    column = renumber[number[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    n, step = int((uses > 1).sum()), 8192
    for lo in range(0, n, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        bits = np.zeros((len(left) + len(right), min(step, n - lo)), np.float32)
        bits[owner[a:b], column[a:b] - lo] = 1
        out += bits[:len(left)] @ bits[len(left):].T
    return out


def _links(ids: list[list[int]], sets: list[list[np.ndarray]], same: bool) -> list[tuple[int, int]]:
    """Links between two blocks (or in one), thinned to a forest: never more than documents."""
    left, right = sets[0], sets[0] if same else sets[1]
    if not left or not right:
        return []
    both = overlaps(left, right)
    both = both.astype(np.int64)
    total = np.add.outer([len(s) for s in left], [len(s) for s in right]) - both
    hit = 100 * both >= LEAST_PERCENT * total
    ids_left, ids_right = ids[0], ids[0] if same else ids[1]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x
    out = []
    for i, j in zip(*np.nonzero(np.triu(hit, 1) if same else hit), strict=True):
        a, b = find(ids_left[i]), find(ids_right[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((ids_left[i], ids_right[j]))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (grp, bi, bj): one pair of blocks at a time."""
    at, ids, sets, out = None, [[], []], [[], []], []

    def done():
        return _links(ids, sets, at[1] == at[2]) if at is not None and len(ids[0]) + len(ids[1]) > 1 else []

    def batch_of(pairs):
        return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()),
                                           "b": pa.array([p[1] for p in pairs], pa.int64())})
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("grp", "bi", "bj", "block", "doc_id")]
        for grp, bi, bj, block, doc_id, raw in zip(*columns, batch.column("shingles"), strict=True):
            if (grp, bi, bj) != at:
                out += done()
                at, ids, sets = (grp, bi, bj), [[], []], [[], []]
            side = int(block != bi)
            ids[side].append(doc_id)
            sets[side].append(np.frombuffer(raw.as_buffer(), np.uint64))
        if len(out) > 10_000:
            yield batch_of(out)
            out = []
    out += done()
    yield batch_of(out)


def _against_closest(sets: DataFrame, closest: DataFrame) -> DataFrame:
    """Each set beside that of the document with which it shares most keys: as many rows as sets at most."""
    uses = closest.groupBy(F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    heads = sets.select("doc_id", F.col("shingles").alias("head_shingles")).join(
        uses, F.col("doc_id") == F.col("__key")).drop("doc_id")
    return join_heads(sets.filter("key is not null"), heads, closest.count())


def _members(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """Documents of the candidate groups that are not one part yet: node, grp, block, reach.

    The largest part of a group is its main part, which needs no comparison within
    itself. The other documents fill the blocks from 0 and meet all blocks of their
    group; those of the main part fill the blocks after and meet the others' only:
    ``reach`` is the number of blocks, from 0, that a document meets.
    """
    placed = stage(groups.join(parts.toDF("__node", "part"), F.col("node") == F.col("__node"), "left").select(
        "node", F.col("root").alias("key"), F.coalesce("part", "node").alias("part")), "placed")
    sizes = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    unfinished = (sizes.groupBy(F.col("key").alias("__key"))
                  .agg(F.sum("n").alias("__n"), F.max(F.struct("n", "part")).alias("main"))
                  .select("__key", "__n", F.col("main.part").alias("main"),
                          F.ceil((F.col("__n") - F.col("main.n")) / BLOCK).cast("int").alias("rest_blocks"),
                          F.ceil(F.col("main.n") / BLOCK).cast("int").alias("main_blocks")).filter("rest_blocks > 0"))
    joined = join_heads(placed, unfinished, placed.count())
    return joined.select(
        "node", F.col("key").alias("grp"),
        F.expr("if(part = main, rest_blocks + pmod(xxhash64(node), main_blocks), pmod(xxhash64(node), rest_blocks))")
        .cast("int").alias("block"),
        F.expr("if(part = main, rest_blocks, rest_blocks + main_blocks)").alias("reach"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Documents whose distinct five-word shingles have a similarity of at least 0.85
    are linked; component_id is the smallest id reachable, kept marks that document.

    Equal sets are one representative from the start. Representatives that share a
    key of the multi-index are joined to the smallest one of that key: as many pairs
    as keys, however many share one. The groups these pairs connect hold every link
    within the guaranteed distance. Each representative is first compared with the one
    it shares most keys with, which joins most copies at a cost linear in their number.
    What this leaves apart in a group is cut into blocks and compared with all of the
    group, pairs of blocks in separate tasks; each gives a forest of its links, never
    all of them. No text, set or link passes through the driver.

    NULL, empty and blank texts have no shingles and are linked with nothing, as are
    rows with a NULL id (component_id NULL, kept). Rows that repeat an id are one
    node. An empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stage(slim.mapInArrow(
        _signed, "doc_id long, n_shingles long, set_hash binary, keys array<long>"), "signed")
    known = signed.filter("doc_id is not null and set_hash is not null")
    reps = stage(known.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "reps")

    keyed = reps.select("rep", F.explode("keys").alias("key"))
    heads = (keyed.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("tail"),
                                      F.count(F.lit(1)).alias("__n")).filter("head <> tail")
             .select(F.col("key").alias("__key"), "head", "__n"))
    pairs = stage(join_heads(keyed, heads, reps.count() * CHUNKS * CHUNK).filter("rep <> head")
                  .groupBy(F.col("rep").alias("a"), F.col("head").alias("b"))
                  .agg(F.count(F.lit(1)).alias("shared")), "pairs")
    groups = components(pairs.select("a", "b"), "candidates")

    closest = stage(pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("key")), "closest")
    wanted = groups.join(closest, F.col("node") == F.col("a"), "left").select("node", "key")
    sets = stage(slim.join(wanted, F.col("doc_id") == F.col("node")).select("doc_id", "key", "text").mapInArrow(
        _with_sets(["doc_id", "key"]), "doc_id long, key long, shingles binary"), "sets")
    confirmed = stage(_against_closest(sets, closest).mapInArrow(_confirmed, "a long, b long"), "confirmed")
    parts = components(confirmed, "parts")

    members = _members(groups, parts)
    dealt = (sets.join(members, F.col("doc_id") == F.col("node"))
             .withColumn("other", F.explode(F.expr("sequence(0, reach - 1)")))
             .select("grp", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"),
                     "block", "doc_id", "shingles"))
    links = stage(dealt.repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj")
                  .mapInArrow(_compare, "a long, b long"), "links")
    linked = components(confirmed.union(links), "components")

    by_set = reps.join(linked, F.col("rep") == F.col("node"), "left").select(
        F.col("set_hash").alias("__set"), F.coalesce("root", "rep").alias("component"))
    out = signed.join(by_set, F.col("set_hash") == F.col("__set"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id; a NULL id stays."""
    found = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi")

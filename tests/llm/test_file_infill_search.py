"""Token files, fill-in-the-middle and ranked search against plain versions, on awkward rows as well."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from surveyloom.llm import infill, search, tokenfile

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LETTERS = ["a", "B", "s", "'", "'S", "'re", "ll", "5", "12", ".", ",", "…", " ", "\n", "é", "é", "́", "<|",
           "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "Σ", "ß", "日本", "\x1c", "\x00", "\xa0", "_", "&", "½", "١", "😀",
           "<P>", "<S>", "<M", ">"]


def awkward(n, seed=5, most=40):
    r = random.Random(seed)
    return ["".join(r.choices(LETTERS, k=r.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def rows():
    """Ids of many sizes; NULL and repeated ids, NULL and empty texts, a long text, repeated rows."""
    texts = awkward(300)
    long = " ".join(awkward(4000, seed=9))
    return ([(i * 7 - 400, t) for i, t in enumerate(texts)] + [(None, "of nobody"), (None, None), (None, "of nobody")]
            + [(5000, None), (5001, ""), (5002, long), (5003, "twice"), (5003, "twice"), (5003, "thrice and other")])


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    return df.withColumns({"n": F.lit("x"), "form": F.lit(1), "ids": F.lit("y"), "start": F.lit(0), "rank": F.lit(True)})


# ---- token files -------------------------------------------------------------------------

@pytest.mark.parametrize("top", [1, 2, 300, 49_408, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_blocks_round_trip(n, top):
    values = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    values[::11] = top - 1  # outliers
    values[1::3] = values[1::3] % 5
    data = tokenfile.segment_bytes(2, 40, np.array([9]), np.array([0]), np.array([n]), values) + b"\n"
    (read,) = tokenfile.segments(memoryview(data))
    assert (read.part, read.before, read.n_ids) == (2, 40, n)
    assert (read.ids() == values).all()
    for lo, hi in ((0, n // 2), (n // 3, n), (n // 2, n // 2), (max(n - 1, 0), n)):
        assert (read.ids(lo, hi) == values[lo:hi]).all()


def test_blocks_have_exceptions_and_are_small():
    values = np.random.default_rng(1).integers(0, 200, 10_000).astype(np.uint32)
    values[::50] = 49_000
    least, width, _, _, packed, place, high = tokenfile.encode_blocks(values)
    assert (width == 8).all() and len(place) == len(high) == 200
    assert packed.nbytes < 0.3 * values.nbytes


def test_a_torn_segment_is_refused():
    data = tokenfile.segment_bytes(0, 0, np.array([1]), np.array([0]), np.array([3]), np.arange(3, dtype=np.uint32)) + b"\n"
    with pytest.raises(ValueError):
        list(tokenfile.segments(memoryview(data[:-1] + b"x")))
    with pytest.raises(Exception):
        list(tokenfile.segments(memoryview(data[:-5])))


def test_encoder_equals_the_library(library, monkeypatch):
    monkeypatch.setattr(tokenfile, "REMEMBERED", 500)
    with open(VOCABULARY, encoding="utf-8") as file:
        encode = tokenfile.LibraryEncoder(file.read())
    for seed in range(4):
        texts = [*awkward(1500, seed=seed, most=14), None, ""]
        ids, at = encode(pa.array(texts))
        for i, whole in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
            assert ids[at[i]:at[i + 1]].tolist() == whole.ids, texts[i]


def expected_file(rows, library):
    """Per row (doc_id, n_tokens, crc) in the order of ids, NULL first; rows of one id as a multiset."""
    out = []
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_token_files(spark, table, rows, library, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_SEGMENTS", 2)
    expected = expected_file(rows, library)
    folder = str(tmp_path / "tokens")
    tokenfile.write_token_files(table, folder, VOCABULARY, 2)
    got = [(r.doc_id, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes()), r.ids, r.start)
           for r in tokenfile.read_token_files(spark, folder).collect()]
    assert sorted((r[:4] for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) == expected
    got.sort(key=lambda r: r[4])
    keys = [r[0] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert [r[4] for r in got] == [0, *np.cumsum([r[1] for r in got])[:-1].tolist()]


def test_token_file_digests_of_unique_ids(spark, rows, library):
    own = [(i, text) for i, (_, text) in enumerate(rows)]
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(5)
    start, expected = 0, []
    for key, n, crc, _ in expected_file(own, library):
        expected.append((key, start, n, crc))
        start += n
    assert sorted(map(tuple, tokenfile.token_file_digests(df, VOCABULARY).collect())) == expected


def test_token_files_of_nothing(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string, more int")
    assert tokenfile.token_file_digests(nothing, VOCABULARY).collect() == []


def test_token_files_deal_out_a_hot_id(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same words").alias("text"))
    folder = str(tmp_path / "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the parts are tiny here
    try:
        tokenfile.write_token_files(df.repartition(6), folder, VOCABULARY, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = tokenfile.read_token_files(spark, folder, whole=False).filter("doc_id = 7")
    assert hot.count() == 1001 and hot.select("start").distinct().count() == 1001
    parts = tokenfile._files(spark, folder).mapInArrow(tokenfile._documents(False), "doc_id long, part long, before long, n_tokens long, ids_crc32 long")
    assert parts.filter("doc_id = 7").select("part").distinct().count() > 1


# ---- fill in the middle ------------------------------------------------------------------

UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\v\f\r\n]*[ \t\v\f\r\n]|[^ \t\v\f\r\n]+", "sentence": r"[^.!?\n]*[.!?\n]|[^.!?\n]+"}


def filled(key, text, unit="line", percent=100, spm_percent=50, marks=infill.MARKS):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    n = len(units)
    hexed = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(hexed[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if not text or any(x in text for x in marks) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_percent:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


@pytest.mark.parametrize("unit, percent, spm", [("line", 100, 50), ("word", 70, 0), ("sentence", 100, 100)])
def test_fill_in_middle(table, rows, unit, percent, spm):
    done = infill.fill_in_middle(table, unit, percent, spm)
    assert done.columns == ["doc_id", "text", "ids", "start", "rank", *infill.ADDED]
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in done.collect()]
    assert sorted(got, key=str) == sorted(((k, *filled(k, t, unit, percent, spm)) for k, t in rows), key=str)
    back = done.select(F.coalesce("text", F.lit("")).alias("text"), infill.restored(F.col("output"), F.col("form")).alias("back"))
    assert back.filter("text <> back or back is null").count() == 0


def test_fill_in_middle_of_nothing(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_marks_that_run_into_each_other_are_refused(table):
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "xx"), ("", "a", "b"), ("aba", "x", "y"), ("<P>", "P", "<M>")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(table, marks=marks)


def test_wavelet_matrix_ranks():
    symbols = np.random.default_rng(2).integers(0, 8, 1000).astype(np.uint8)
    matrix, places = infill.WaveletMatrix(symbols), np.arange(1001)
    for c in range(8):
        assert (matrix.rank(c, places) == np.concatenate([[0], np.cumsum(symbols == c)])).all()


# ---- ranked search -----------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, top):
    """Every document scored for every item."""
    counted = [(k, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for k, t in docs]
    counted = [(k, c, c.total()) for k, c in counted if c]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    out = []
    for key, text in items:
        asked = collections.Counter(TERM.findall((text or "").translate(LOWER)))
        weight = {t: k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t, k in asked.items()}
        scores = []
        for doc, c, n in counted:
            m = 75 + 25 * n * n_docs // length
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, w in weight.items() if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(key, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def library_of_texts():
    """Skewed words, many copies, ties, and long and empty texts."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["été", "Straße", "日本語", "x_y", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randint(0, 60)))) for i in range(700)]
    docs += [(1000 + i, "w3 w3 w7 Straße, w50!") for i in range(300)]
    docs += [(2000, " ".join(r.choices(words, weights, k=30_000))), (2001, None), (2002, ""), (2003, " ,.;"), (None, "w50 w51"),
             (2004, "w50 w51"), (2004, "w50 w51")]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(25)]
    items += [(3, "w50 w51 w51"), (90, None), (91, "nobody knows"), (92, "W0"), (None, "straße Straße w7")]
    return docs, items


def test_ranked_search(spark, library_of_texts):
    docs, items = library_of_texts
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    for top in (1, 20):
        got = sorted(map(tuple, search.rank_documents(d, i, top).collect()), key=str)
        assert got == ranked(docs, items, top)


def test_ranked_search_in_blocks_and_pieces(spark, library_of_texts, monkeypatch):
    """Several blocks of items, several trees and pieces of text: the same result."""
    docs, items = library_of_texts
    monkeypatch.setattr(search, "BLOCK_TERMS", 20)
    monkeypatch.setattr(search, "TREE", 100)
    monkeypatch.setattr(search, "LEAF", 4)
    monkeypatch.setattr(search, "AT_A_TIME", 50)
    blocks = list(search.item_blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text"))
    assert len(blocks) > 3 and all(len(b.places) <= 20 for b in blocks)
    found = [x for b in blocks for x in zip(b.ids, b.counts)]
    assert len(found) == len(items) - 1  # one item has no terms
    assert search.term_counts("ab " * 40 + "c" * 200 + " AB").most_common(1) == [(b"ab", 41)]
    # The workers' modules keep their own sizes, so trees of these sizes are grown here.
    own = [(k, search.term_counts(t)) for k, t in docs]
    own = [(k, c) for k, c in own if c]
    places = {t: i for i, t in enumerate(sorted({t for _, c in own for t in c}))}
    rows = [(k, c.total(), [places[t] for t in c], list(c.values())) for k, c in own]
    batch = pa.record_batch([pa.array([r[j] for r in rows], kind) for j, kind in
                             enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))], ["doc_id", "n", "terms", "tfs"])
    n_docs, length = len(rows), sum(r[1] for r in rows)
    df = collections.Counter(p for r in rows for p in r[2])
    rank = np.empty(len(places), np.int64)
    rank[sorted(df, key=lambda p: (-df[p], p))] = np.arange(len(places))
    trees = list(search._trees(batch, n_docs, length, rank))
    assert len(trees) > 8
    visited = total = 0
    for _, text in items[:25]:
        counts = search.term_counts(text)
        pairs = sorted((int(rank[places[t]]), k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[places[t]] + 1))))
                       for t, k in counts.items() if t in places)
        terms, weights = (np.array(x, np.int64) for x in zip(*pairs))
        weight_of = np.zeros(len(rank), np.int64)
        weight_of[terms] = weights
        best = search.Best(5)
        for tree in trees:
            scored = []
            original = tree.scores
            tree.scores = lambda node, w, f=original: scored.append(node) or f(node, w)
            tree.search(terms, weights, weight_of, best)
            tree.scores = original
            visited, total = visited + len(scored), total + sum(c is None for c in tree.children)
        expected = [(s, d) for _, _, d, s in sorted(ranked(docs, [(0, text)], 5), key=lambda r: r[1])]
        assert list(zip(best.scores.tolist(), [None if d == search._NO_ID else d for d in best.ids.tolist()])) == expected
    assert visited < 0.7 * total  # bounds leave leaves out


def test_ranked_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.rank_documents(docs.limit(0), items).collect() == []
    assert search.rank_documents(docs, items.limit(0)).collect() == []
    assert search.rank_documents(docs, items).collect() == [(1, 1, 1, 2 * math.floor(1000 * math.log(4 / 3)) * (1_000_000_000 // (1000 + 1200)))]

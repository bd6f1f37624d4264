"""The text operators against plain versions on small tables with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from surveyloom.llm import bpe, chat, common, fingerprints, linededup, mixing, neardup, pages, passages, quality, sharding

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, epoch string, key string"


def sentence(r, n):
    return " ".join(r.choice("alpha Beta gamma delta eps zeta eta theta iota kappa lam mu nu xi pi rho".split())
                    + str(r.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base, shared = sentence(r, 120), sentence(r, 70)
    out = [None, "", "   \n\t", "one", "ONE two three four", "a\n\nb\n\n", base, base, base.upper(),
           base.replace("alpha", "omega", 1), f"{sentence(r, 90)}\n{shared}\n{sentence(r, 40)}",
           f"{sentence(r, 30)}\n{shared}\n{sentence(r, 60)}", f"  {shared.upper()}\t\n{shared}", sentence(r, 6000),
           "é ß 🙂 ñ " * 30, "x" * 5000, "spam and eggs " * 40, "### *** $$$ %%% " * 60]
    out += [sentence(r, r.randint(40, 130)) for _ in range(60)]
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", None][i % 2], ["a", "a", "a", "b", None][i % 5], 0, "x", "y", "z") for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def near_groups(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in texts:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


def test_near_duplicates(docs, texts, nothing):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == near_groups(texts)
    assert neardup.near_duplicates(nothing).count() == 0


def test_near_duplicate_blocks(spark, monkeypatch):
    """Many near copies of one text, in groups larger than a block."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    r = random.Random(9)
    base = sentence(r, 90).split()
    near = {}
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"new{r.randint(0, 10**6)}"
        near[i] = " ".join(w)
    df = spark.createDataFrame(list(near.items()), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(df).collect()}
    assert got == near_groups(near)


def test_null_ids_and_repeated_rows(spark):
    text = sentence(random.Random(1), 80)
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (7, text)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (3, 3, True), (3, 3, True), (7, 3, False)]
    assert linededup.line_dedup(df).filter("n_dropped > 0").select("doc_id").collect()[0][0] == 7
    assert fingerprints.edited_fingerprints(df).count() == 4
    assert sharding.shard_documents(df.withColumn("source", F.lit(None).cast("string"))).count() == 4


def test_line_dedup(spark, docs, texts, nothing):
    lines = {i: (t or "").split("\n") for i, t in texts.items()}
    key = {x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER) for own in lines.values() for x in own}
    owners = collections.defaultdict(set)
    for i, own in lines.items():
        for x in own:
            owners[key[x]].add(i)
    got = {r.doc_id: r for r in linededup.line_dedup(docs).collect()}
    for i, own in lines.items():
        stay = [x for x in own if len(key[x]) < 10 or len(owners[key[x]]) < 2 or min(owners[key[x]]) == i]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(own), len(own) - len(stay), "\n".join(stay))
    assert got[0].epoch == "y"
    assert linededup.line_dedup(nothing).count() == 0


def test_line_filters_find_all_repeats(spark):
    """A tiny filter suspects too much and loses nothing."""
    df = spark.createDataFrame([(i, f"shared line number {i % 7}\nown line number {i}") for i in range(60)],
                               "doc_id long, text string").repartition(5)
    bits = np.frombuffer(linededup.twice_seen(df, 1 << 15), np.uint8)
    _, counts, keys = linededup.line_keys(pa.array([f"shared line number {i}" for i in range(7)]))
    assert counts.all() and linededup._test(bits, linededup._bits(keys, 1 << 15)).all()


def test_line_keys(monkeypatch):
    """Equal keys have equal hashes wherever they stand, also in lines longer than a piece."""
    r = random.Random(6)
    parts = ["a", "B", "é", " ", "\t", "\n", "\r", "\v", "日本", "x" * 30, ""]
    texts = ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(400)] + [None, "", "\n", " \n ", "q" * 500, " Q" + "q" * 499]
    lines = [line for t in texts for line in (t or "").split("\n")]
    keys = [line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER) for line in lines]
    for chunk in (64, 1 << 16):
        monkeypatch.setattr(linededup, "CHUNK", chunk)
        linededup._bases.cache_clear()
        first, counts, hashes = linededup.line_keys(pa.array(texts))
        assert np.diff(first).tolist() == [(t or "").count("\n") + 1 for t in texts]
        assert counts.tolist() == [len(k) >= 10 for k in keys]
        seen = {}
        for key, own in zip(keys, map(tuple, hashes.tolist())):
            assert seen.setdefault(key, own) == own
        assert len(set(seen.values())) == len(seen)
    linededup._bases.cache_clear()


def test_quality_counts_and_verdicts(docs, texts, nothing):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, t in texts.items():
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        count = collections.Counter(windows)
        covered = {k + d for k, x in enumerate(windows) if count[x] > 1 for d in range(3)}
        own = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(own) - len(set(own)), len(covered)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(nothing).count() == 0


def test_outliers_go_and_clean_documents_stay(spark):
    r = random.Random(2)
    clean = [(i, sentence(r, r.randint(60, 400)), "en", "s") for i in range(150)]
    odd = [(200 + i, " ".join(w + "***" for w in sentence(r, 100).split()), "en", "s") for i in range(12)]
    df = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string")
    kept = {x.doc_id: x.kept for x in quality.quality_rules(df).collect()}
    assert all(kept[i] for i, *_ in clean) and not any(kept[i] for i, *_ in odd)


def drawn_estimate(points, wide=None, start=None):
    """The C-steps in numpy: (mean, covariance, scale), drawn towards those of ``wide``."""
    n, prior, floors = len(points), quality.PRIOR if wide else 0, np.diag(np.square(quality.FLOORS))
    quarters = np.quantile(points, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    mean, cov = quarters[1], np.diag(((quarters[2] - quarters[0]) / 1.349) ** 2) + floors
    if wide:
        mean = (n * mean + prior * wide[0]) / (n + prior)
        cov = np.diag((n * np.diag(cov) + prior * np.diag(wide[1])) / (n + prior))

    def bins():
        d2 = np.einsum("ij,jk,ik->i", points - mean, np.linalg.inv(cov), points - mean)
        bin_of = np.floor(np.log(d2 + 1e-6) * 32).astype(int)
        order = sorted(set(bin_of.tolist()))
        before = {b: int((bin_of < b).sum()) for b in order}
        inner = [b for b in order if before[b] < n * quality.COVERED]
        return np.isin(bin_of, inner), max(inner)

    for _ in range(quality.C_STEPS):
        own = points[bins()[0]]
        total, second = own.sum(0), own.T @ own
        if wide:
            total, second = total + prior * wide[0], second + prior * (wide[1] + np.outer(wide[0], wide[0]))
        mean = total / (len(own) + prior)
        cov = second / (len(own) + prior) - np.outer(mean, mean) + floors
    scale = np.exp((bins()[1] + 1) / 32) / quality.CHI_75
    return mean, cov, (n * scale + prior * wide[2]) / (n + prior) if wide else scale


def test_estimates_of_small_groups_against_numpy(spark):
    """A group of one, of few and of many documents, each drawn towards the wider group by its size."""
    rng = np.random.default_rng(3)
    sizes = {"one": 1, "few": 7, "many": 600}
    groups = {g: rng.normal(i, 0.5 + i / 3, (n, 4)) for i, (g, n) in enumerate(sizes.items())}
    df = spark.createDataFrame([(0, g, *map(float, p)) for g, own in groups.items() for p in own],
                               "every int, g string, x0 double, x1 double, x2 double, x3 double")
    every = quality.covariance_determinant(df, ["every"])
    robust = {r.g: r for r in quality.covariance_determinant(df, ["every", "g"], every, ["every"]).collect()}
    wide = drawn_estimate(np.concatenate(list(groups.values())))
    for g, own in groups.items():
        mean, cov, scale = drawn_estimate(own, wide)
        factor = np.zeros((4, 4))
        for i, j in quality._pairs():
            factor[i, j] = robust[g][f"l{i}{j}"]
        assert np.allclose([robust[g][f"m{i}"] for i in range(4)], mean, atol=1e-6)
        assert np.allclose(factor @ factor.T, cov, atol=1e-6) and abs(robust[g].scale - scale) < 1e-6


def test_small_groups_are_judged(spark):
    """One document of its own language and source that is like no other goes."""
    r = random.Random(12)
    clean = [(i, sentence(r, r.randint(60, 400)), "en", f"s{i % 3}") for i in range(300)]
    clean += [(500 + i, sentence(r, 200), f"l{i}", f"t{i}") for i in range(5)]
    odd = [(900 + i, " ".join(w + "***" for w in sentence(r, 100).split()), f"odd{i}", f"u{i}") for i in range(3)]
    df = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string")
    kept = {x.doc_id: x.kept for x in quality.quality_rules(df).collect()}
    assert all(kept[i] for i, *_ in clean) and not any(kept[i] for i, *_ in odd)


def test_covariance_against_numpy(spark):
    """With all points in the estimate's half, centre and factor are those of the nearest points."""
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(0, 1, (300, 4)), rng.normal(40, 1, (40, 4))])
    df = spark.createDataFrame([("g", *map(float, p)) for p in points], "g string, x0 double, x1 double, x2 double, x3 double")
    row = quality.covariance_determinant(df, ["g"]).first()
    center = np.array([row.m0, row.m1, row.m2, row.m3])
    factor = np.zeros((4, 4))
    for i, j in quality._pairs():
        factor[i, j] = row[f"l{i}{j}"]
    d2 = ((np.linalg.solve(factor, (points - center).T)) ** 2).sum(0)
    assert np.abs(center).max() < 0.3 and d2[:300].max() * 5 < d2[300:].min()


def test_good_and_bad_documents_by_label(spark):
    """On the labelled documents: no good one is an outlier, and nearly all bad ones go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.quality_rules(docs).join(labels, "doc_id").groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("base_failed")).alias("failed"),
        F.count_if(~F.col("base_failed") & ~F.col("kept")).alias("outliers")).collect()
    found = {r.quality: (r.n, r.failed, r.outliers) for r in judged}
    assert found[1][2] <= 0.01 * found[1][0]
    assert found[0][1] + found[0][2] >= 0.9 * found[0][0]


def test_mixing(spark, docs, texts, nothing):
    sizes = {"big": 600, "mid": 120, "small": 40}
    rows = [(f"{s}{i}", "w " * (5 + i % 9), s) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string").repartition(3)
    mixed = mixing.mix_sources(df, max_repeats=3.0).collect()
    count = collections.Counter(r.doc_id for r in mixed)
    assert set(count) == {r[0] for r in rows} and max(count.values()) == 3
    total = collections.Counter()
    for r in mixed:
        total[r.source] += r.mix_tokens
    own = {s: sum(5 + i % 9 for i in range(n)) for s, n in sizes.items()}
    assert total["big"] == own["big"] and total["small"] == 3 * own["small"]
    theory = (own["big"] / own["mid"]) ** (np.log(3) / np.log(own["big"] / own["small"]))
    assert abs(total["mid"] / own["mid"] - theory) < 14 / own["mid"] + 1e-3
    again = mixing.mix_sources(df.repartition(5), max_repeats=3.0).collect()
    assert sorted((r.doc_id, r.epoch) for r in again) == sorted((r.doc_id, r.epoch) for r in mixed)
    assert {r.doc_id for r in mixing.mix_sources(docs, max_repeats=2.0).collect()} == set(texts)
    assert mixing.mix_sources(nothing).count() == 0


def test_many_small_sources_lie_evenly_over_the_shards(spark):
    """10,000 rows of one source, and 10,000 sources of one row: every shard has its part of both."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"),
                                    F.when(F.col("id") < 10_000, "large").otherwise(F.concat(F.lit("s"), "id")).alias("source"))
    done = sharding.shard_documents(df).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "large").alias("large")).collect()
    assert [r.n for r in done] == [2500] * 8 and len(done) == 8
    assert all(1100 < r.large < 1400 for r in done)


def test_interleaving_against_a_plain_one(spark):
    """The order of all fractions, made by hand from Spark's own hashes."""
    r = random.Random(5)
    rows = [(i, r.choice(["a", "b", "c", None]), r.randint(0, 9)) for i in range(500)] + [(7, "a", 1)] * 3
    df = spark.createDataFrame(rows, "k int, s string, t int")
    hashes = df.select("k", "s", "t", F.xxhash64(F.lit(11).cast("long"), "k", "t").alias("h"),
                       F.xxhash64(F.lit(12).cast("long"), "s").alias("phase"), F.xxhash64("s").alias("sh")).collect()
    strata = collections.defaultdict(list)
    for x in hashes:
        strata[x.s].append(x)
    order = []
    for own in strata.values():
        for i, x in enumerate(sorted(own, key=lambda x: (x.h, x.k, x.t)), start=1):
            order.append(((i - ((x.phase & (1 << 64) - 1) >> 12) / (1 << 52)) / len(own), x.sh, x.h, x.k, x.t, x.s))
    order.sort()
    expected, n = [], len(order)
    for place, (*_, k, t, s) in enumerate(order):
        shard = place * 5 // n
        expected.append((k, s, t, shard, place - -(-shard * n // 5)))
    got = [tuple(x) for x in sharding.interleave(df, 5, "s", ["k", "t"]).select("k", "s", "t", "shard", "slot").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_mixing_entropy_target(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "p double")
    t = mixing.bisect_exponent(shares, 0.9, None, None)
    w = np.array([0.7, 0.2, 0.1]) ** t
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() / np.log(3) - 0.9) < 1e-6


def test_encoding_equals_the_public_library(spark, docs, texts):
    library = Tokenizer.from_file(VOCABULARY)
    r = random.Random(3)
    alphabet = "aàÀéñçßΣσςİı中日本🙂👍🏽́​  \u0085\x1c\x1f\x00 \t\n'’sTrevdmll0123²½.,!?<|>~^ﬁŉ가힣"
    more = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(800)]
    more += ["ab<|endoftext|>É<|startoftext|>", "<|endoftext|>", "<|endoftext", "don't WE'LL it's"]
    every = dict(enumerate([*texts.values(), *more]))
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x for x in bpe.round_trip_digests(df, VOCABULARY).collect()}
    for i, t in every.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_long_fragments_merge_alike():
    v = bpe._vocabulary(bpe._file_text(VOCABULARY))
    library = Tokenizer.from_file(VOCABULARY)
    r = random.Random(8)
    for alphabet in ("a", "the", "abcdefghijklmnopqrstuvwxyz", "!?=-"):
        word = "".join(r.choice(alphabet) for _ in range(700))
        assert v.word_ids(word) == library.encode(word, add_special_tokens=False).ids
        letters = [*word[:60], word[60] + bpe.WORD_END]
        assert v.merge_long(list(letters)) == v.merge(list(letters))
    assert v.word_ids("a" * 200_000) == library.encode("a" * 200_000, add_special_tokens=False).ids


def test_forced_boundaries_cut_only_between_tokens():
    v = bpe._vocabulary(bpe._file_text(VOCABULARY))
    cut = 0
    for word in ("naïveté", "日本語テキスト", "xqzjvk", "hello", "zzzqqqxxx"):
        letters = [v.letters[b] for b in word.encode()]
        letters[-1] += bpe.WORD_END
        parts = v.fragments(word)
        cut += len(parts) > 1
        assert [t for p in parts for t in v.merge(p)] == v.merge(letters)
    assert cut


def test_sharding(spark, docs, texts, nothing):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(texts) and {r.law for r in got} == {"rows"}
    by = collections.defaultdict(list)
    mix = collections.Counter()
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        by[r.shard].append(r.slot)
        mix[r.source, r.shard] += 1
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    for s in ("a", "b", None):
        own = [mix[s, k] for k in range(8)]
        assert max(abs(n - sum(own) / 8) for n in own) < 2
    assert sharding.shard_documents(nothing).count() == 0


def test_chats(spark):
    r = random.Random(4)
    words = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "[\\\\/ANS]", "[ROLE x] ", " ", "\\", "é🙂", "[", "\n", "hi"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool]x%", None]),
             None if r.random() < 0.1 else "".join(r.choice(words) for _ in range(r.randint(0, 12))))
            for c in range(60) for t in range(r.randint(1, 9))]
    rows += [(99, 0, "user", "z" * 3_000_000), (99, 1, "assistant", "ok"), (98, 0, "user", "b"), (98, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df)
    got = {x.conv_id: x for x in chat.read_back(made).collect()}
    own = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (x[0], x[1], x[2] or "", x[3] or "")):
        own[c].append((role or "", text or ""))
    for c, turns in own.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.limit(0)).count() == 0


def test_fingerprints(docs, texts, nothing):
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    ids = sorted(texts, reverse=True)
    prints = collections.defaultdict(set)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        own, other = texts[i] or "", texts[j] or ""
        half = len(own) // 2
        edited = own[:len(own) - half] + other[:half]
        assert got[i].n_chars == len(own)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        prints[own].add(got[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert got[8].near_next == 0.0 and got[7].near_next == 1.0
    assert fingerprints.edited_fingerprints(nothing).count() == 0


def test_sketch_estimates(spark):
    r = random.Random(6)
    a, b = sentence(r, 3000), sentence(r, 3000)
    df = spark.createDataFrame([(a, a + " " + b)], "a string, b string")
    x, y = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    row = df.select(fingerprints.resemblance(x, y).alias("j"), fingerprints.containment(x, y).alias("c"),
                    fingerprints.distinct_shingles(x).alias("n")).first()
    assert abs(row.j - 0.5) < 0.2 and row.c > 0.7 and abs(row.n - 2996) < 1200


PAGE = ("<!DOCTYPE html><html><head><title>t &amp; u</title><script>var a='<p>no</p>'</script></head><body>"
        "<header><h2>Site name</h2></header><nav><ul><li><a href='/x'>{0}</a><li>More</ul></nav>"
        "<div class=\"cookie-notice\">We use cookies {0}</div><div>Daily mail for all</div>{1}"
        "<aside>side {0}</aside><div id='comments'><p>first! {0}</p></div><form>name <input></form>"
        "<footer>&copy; {0}</footer></body></html>")


def test_pages(spark):
    rows = [(i, f"http://host.example/{i}", PAGE.format(
        i, f"<article><h1>Title&nbsp;{i}</h1><p>A <b>bold &lt;word&gt;<br>and  more\n{i}<p>Second &eacute; {i}</article>"))
        for i in range(5)]
    rows += [(10 + i, f"http://plain.example/{i}", PAGE.format(i, f"<div><p>Body {i}</p><p>End {i}</p></div>"))
             for i in range(5)]
    rows += [(20, "http://one.example", "<p>Alone<p>x &am y"), (21, None, "<p>No host"), (22, "http://n.example", None),
             (23, "http://n.example", ""), (24, "bad", "<div><!-- open <p>x"), (25, "http://n.example", "a < b & c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract_main_text(df).collect()}
    for i in range(5):
        assert got[i] == f"Title {i}\n\nA bold <word> and more {i}\n\nSecond é {i}"
        assert got[10 + i] == f"Body {i}\n\nEnd {i}"
    assert [got[k] for k in range(20, 26)] == ["Alone\n\nx &am y", "No host", "", "", "", "a < b & c"]
    assert pages.extract_main_text(df.limit(0)).count() == 0


def test_pages_that_are_all_alike_keep_their_text(spark):
    df = spark.createDataFrame([(i, "http://h.example/", "<div><p>Same words</p></div>") for i in range(4)],
                               "page_id long, url string, html string")
    assert {r.text for r in pages.extract_main_text(df).collect()} == {"Same words"}


def test_template_reaches_into_articles_and_slots_outweigh_teasers(spark):
    rows = []
    for i in range(6):
        own = f"<h1>Title {i}</h1><p>{'body words ' * 20}{i}</p><p>End of {i}</p>"
        rows += [
            (i, "http://bio.example/", PAGE.format(i, f"<article>{own}<p class=more>Get our mail</p><div class=bio><p>"
                                                      f"The author writes here</p></div></article>")),
            (10 + i, "http://teaser.example/", PAGE.format(i, f"<div class=entry-content>{own}</div><article>Next: "
                                                              f"{i + 1}</article><article>Last: {i - 1}</article>")),
            (20 + i, "http://main.example/", PAGE.format(i, f"<div>Seen {i} times</div><main><div>{own}</div>"
                                                            f"<article>Next: {i}</article><article>Last: {i}</article>"
                                                            f"</main>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract_main_text(df).collect()}
    for i in range(6):
        for base in (0, 10, 20):
            assert got[base + i] == f"Title {i}\n\n{'body words ' * 20}{i}\n\nEnd of {i}"


@pytest.mark.parametrize("mark", ["class='layout has-sidebar'", "class=no-sidebar", "class='with-sidebar'",
                                  "class='side-by-side'", "id='legal'"])
def test_labels_of_wrappers_keep_the_article(mark):
    page = (f"<body><div class='site-footer'>Foot</div><div {mark}><article><p>Body text of the page</p></article>"
            "<div class=sidebar>Links</div></div></body>")
    assert pages.main_text(page, None) == "Body text of the page"
    assert pages.main_text(f"<body><div {mark}><p>Only text</p></div></body>", None) == "Only text"
    assert pages.main_text("<div class='related'><article>Teaser</article></div><article>Long body text</article>",
                           None) == "Long body text"


@pytest.mark.parametrize("name", [
    "comments-area", "reader-comments", "post-comments", "commentlist", "comments-section", "related-posts", "share-buttons",
    "social-links", "ad-slot", "ads-wrapper", "nav-links", "footer-links", "widget-area", "post_comments open"])
def test_parts_of_names_set_aside(name):
    """Beside the article and in it."""
    aside = f"<div class='{name}'><p>Read this instead</p><p>Nice text, thanks</p></div>"
    assert pages.main_text(f"<body><div class=entry-content><p>Body text of the page</p></div>{aside}</body>", None) == "Body text of the page"
    assert pages.main_text(f"<article><p>Body text of the page</p>{aside}<p>End</p></article>", None) == "Body text of the page\n\nEnd"


@pytest.mark.parametrize("name", ["has-sidebar", "no-ads", "layout-with-sidebar", "side-by-side", "adept", "menuet", "headline", "navy-blue"])
def test_names_of_layouts_and_other_words_stay(name):
    assert pages.main_text(f"<div class='{name}'><p>Body text of the page</p></div><p>End</p>", None) == "Body text of the page\n\nEnd"


def test_comments_and_repeated_notices_go(spark):
    """On hosts whose comments stand beside and in the article, and with a notice as a plain paragraph of every article."""
    rows = []
    for i in range(6):
        own = f"<p>{'body words ' * 20}{i}</p><p>Sign up for our newsletter</p><p>End of {i}</p>"
        comments = "".join(f"<p>Comment {i}.{k}: so true</p>" for k in range(i + 1))
        rows += [(i, "http://beside.example/", PAGE.format(i, f"<div class=entry-content>{own}</div><div class=comments-area>{comments}</div>")),
                 (10 + i, "http://inside.example/", PAGE.format(i, f"<article>{own}<div class='post-comments'>{comments}</div></article>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.withColumns({"host": F.lit("x"), "classes": F.lit(1)})
    got = {r.page_id: r.text for r in pages.extract_main_text(df.union(df.filter("page_id = 3"))).collect()}
    assert len(got) == 12
    for i in range(6):
        for base in (0, 10):
            assert got[base + i] == f"{'body words ' * 20}{i}\n\nEnd of {i}"


def test_very_long_pages():
    body = "".join(f"<p>Paragraph {i} of many</p>" for i in range(30_000))
    text = pages.main_text(f"<nav>Menu</nav><article>{body}</article>", None)
    assert text.count("\n\n") == 29_999 and text.endswith("Paragraph 29999 of many")


@pytest.mark.parametrize("name", ["svg", "math"])
def test_self_closed_drawings_end_at_once(name):
    assert pages.main_text(f"<p>One</p><{name} a='/>' b=c/><p>Two</p><{name} a=b><x/>gone</{name}><p>Three</p>",
                           None) == "One\n\nTwo\n\nThree"


def test_changed_passages_among_competing_holders(spark):
    """Every short run of words has an earlier holder: still nine in ten changed passages are found."""
    r = random.Random(31)
    pool = [[f"v{r.randint(0, 900)}" for _ in range(6)] for _ in range(400)]
    texts = {i: [w for _ in range(r.randint(20, 60)) for w in r.choice(pool)] for i in range(700)}
    planted = []
    for k in range(100):
        source, target, n = 2 * k, 300 + 3 * k, r.randint(50, 100)
        passage = [w for _ in range(n // 6 + 1) for w in r.choice(pool)][:n]
        changed = [f"c{r.randint(0, 10 ** 6)}" if r.random() < r.choice([0.05, 0.1, 0.15]) else w for w in passage]
        if sum(a == b for a, b in zip(passage, changed)) >= 0.85 * n:
            texts[source] += passage
            at = len(texts[target])
            texts[target] += changed
            planted.append((target, at, n))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(6)
    found = collections.defaultdict(list)
    for x in passages.repeated_passages(df).collect():
        found[x.doc_id].append((x.start, x.end))
    caught = 0
    for doc, at, n in planted:
        lo = len(" ".join(texts[doc][:at])) + 1
        hi = lo + len(" ".join(texts[doc][at:at + n]))
        covered = set()
        for a, b in found[doc]:
            covered.update(range(max(a, lo), min(b, hi)))
        caught += len(covered) >= 0.6 * (hi - lo)
    assert len(planted) > 60 and caught >= 0.9 * len(planted)


def test_passages(docs, texts, nothing):
    got = passages.repeated_passages(docs).collect()
    owners = collections.defaultdict(set)
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        for k in range(len(w) - 49):
            owners[tuple(w[k:k + 50])].add(i)
    must = {i for own in owners.values() if len(own) > 1 for i in own - {min(own)}}
    assert must <= {r.doc_id for r in got} <= must | {9}
    for r in got:
        assert r.ref_id < r.doc_id and len(WORD.findall(texts[r.doc_id][r.start:r.end])) == r.n_words >= 50
    assert passages.repeated_passages(nothing).count() == 0


@pytest.mark.parametrize("size", [5, 24, 39, 59])
def test_passages_of_long_words(spark, size):
    """Gaps and margins count words, so an exact copy is covered whole whatever the length of its words."""
    r = random.Random(size)
    copy = " ".join("".join(r.choice("abcdefgh") for _ in range(size)) for _ in range(1000))
    got = passages.repeated_passages(spark.createDataFrame(
        [(1, f"one two {copy}"), (2, f"{copy} three")], "doc_id long, text string")).collect()
    assert [(x.doc_id, x.ref_id, x.start, x.end, x.n_words) for x in got] == [(2, 1, 0, len(copy), 1000)]



def test_passage_whose_parts_stand_earlier(spark):
    """Every short seed of the passage has document 1 or 2 as its first; only whole windows lead from 4 to 3."""
    r = random.Random(3)
    w = [f"word{k}" for k in range(60)]
    parts = [w[:34], w[26:], w, w]
    rows = [(i + 1, f"{sentence(r, 30)} {' '.join(p)} {sentence(r, 30)}") for i, p in enumerate(parts)]
    # The same inside one reference: parts of the passage stand there before the whole.
    v = [f"other{k}" for k in range(60)]
    rows += [(5, " ".join([*v[26:], "a", *v[:34], "b", *v])), (6, " ".join(v))]
    got = {(x.doc_id, x.ref_id): x for x in passages.repeated_passages(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == {(4, 3), (6, 5)}
    assert all(x.n_words == x.n_same == 60 for x in got.values())



def test_passages_whose_seeds_all_stand_earlier(spark):
    """Every part of 49 words stands in a document of its own before the two that hold all 60."""
    rows = []
    for m in range(20):
        w = [f"p{m}x{k}" for k in range(60)]
        for n, part in enumerate([*[w[k:k + 49] for k in range(12)], w, w]):
            edge = [" ".join(f"f{m}x{n}x{side}x{k}" for k in range(30)) for side in (0, 1)]
            rows.append((100 * m + n, f"{edge[0]} {' '.join(part)} {edge[1]}"))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(x.doc_id, x.ref_id) for x in got if x.n_words == x.n_same == 60}
    assert found == {(100 * m + 13, 100 * m + 12) for m in range(20)}


def test_changed_passage_whose_parts_stand_earlier(spark):
    """No run of words of documents 3 and 4 leads from one to the other first: 1 and 2 hold them all, and one word differs."""
    r = random.Random(17)
    w = [f"word{k}" for k in range(60)]
    changed = [*w[:29], "else", *w[30:]]
    rows = [(i + 1, f"{sentence(r, 30)} {' '.join(p)} {sentence(r, 30)}")
            for i, p in enumerate([w[:34], w[26:], w, changed])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (passages.MOST_PLACES, None):
        got = [(x.doc_id, x.ref_id, x.n_words, x.n_same) for x in passages.repeated_passages(frame, most=most).collect()]
        assert got == [(4, 3, 60, 59)]


def test_every_pair_of_alike_texts_is_linked(spark):
    """Five variants of a text, four words apart, give all ten pairs; whole copies lead to the smallest id only."""
    r = random.Random(23)
    w = [f"w{k}" for k in range(120)]
    variants = [" ".join(f"v{i}x{k}" if k in r.sample(range(120), 4) else x for k, x in enumerate(w)) for i in range(5)]
    frame = spark.createDataFrame(list(enumerate([*variants, *variants, None, "", variants[0]])), "doc_id long, text string")
    got = {(x.doc_id, x.ref_id) for x in passages.repeated_passages(frame.repartition(3)).collect()}
    assert got == {(i, j) for i in range(5) for j in range(i)} | {(i + 5, i) for i in range(5)} | {(12, 0)}


def test_passages_of_many_places(spark):
    """Runs of more places than are compared in pairs still lead to a first one, whole windows to one that holds them."""
    r = random.Random(29)
    w = [f"p{k}" for k in range(60)]
    rows = [(i, f"{sentence(r, 20)} {' '.join(w if i % 3 else w[:40])} {sentence(r, 20)}") for i in range(30)]
    got = {(x.doc_id, x.ref_id, x.n_words) for x in passages.repeated_passages(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4), most=5).collect()}
    assert {(d, n) for d, _, n in got} == {(d, 60) for d in range(2, 30) if d % 3}


def stage_rows(monkeypatch):
    """Rows of each table that the operator on passages writes, by its name."""
    rows = {}
    written = passages.stage

    def stage(df, name):
        rows[name] = written(df, name)
        return rows[name]
    monkeypatch.setattr(passages, "stage", stage)
    return rows


def test_unlike_pairs_around_common_lines_are_not_joined(spark, monkeypatch):
    """A line of all and a run of few lie in every text, but only three pairs are alike: no other pair is written for a join."""
    r = random.Random(41)
    common, few = [f"all{k}" for k in range(12)], [[f"few{g}x{k}" for k in range(4)] for g in range(3)]
    texts = {}
    for i in range(90):
        around = [[f"a{i}x{r.randint(0, 10 ** 6)}" for _ in range(80)] for _ in range(3)]
        texts[i] = [*around[0], *common, *around[1][:i % 60], *few[i % 3], *around[2]]
    for i in range(3):  # the common line and the run of few belong to a passage of 60 words, six of them changed
        words = [*common, *[f"p{i}x{k}" for k in range(44)], *few[i]]
        for doc in (i, 90 + i):
            texts[doc] = [*texts[i][:40], *[f"c{doc}x{k}" if k % 9 == 8 and doc > 89 else w for k, w in enumerate(words)],
                          *[f"e{doc}x{k}" for k in range(80)]]
    rows = stage_rows(monkeypatch)
    got = {(x.doc_id, x.ref_id) for x in passages.repeated_passages(
        spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)).collect()}
    assert got == {(90 + i, i) for i in range(3)}
    assert rows["chains"].count() < 2 * len(texts)  # one for each text with the first of the common line, and few more


def test_reference_of_a_short_passage_is_not_sent_whole(spark, monkeypatch):
    """What goes to the alignment of one short stretch ends where its extension must end, also near a line of many texts."""
    r = random.Random(43)
    common, run = [f"all{k}" for k in range(20)], [f"p{k}" for k in range(60)]
    sides = [" ".join(f"s{i}x{r.randint(0, 10 ** 6)}" for _ in range(3000)) for i in range(4)]
    rows = [(0, f"{sides[0]} {' '.join(run + common)} {sides[1]}"), (1, f"{sides[2]} {' '.join(run + common)} {sides[3]}")]
    rows += [(i, " ".join(common)) for i in range(2, 4)]
    rows += [(i, f"{' '.join(f'o{i}x{k}' for k in range(60))} {' '.join(common)}") for i in range(4, 90)]
    written = stage_rows(monkeypatch)
    got = [tuple(x)[:2] + (x.n_words, x.n_same) for x in passages.repeated_passages(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert got == [(1, 0, 80, 80)]
    assert [x.hi - x.lo < 500 for x in written["pairs"].filter("doc_id = 1").collect()] == [True]


@pytest.mark.parametrize("shift", [0, 7, 60, 92])
def test_bits_around_a_seed_keep_every_alike_piece(shift):
    """Pieces of 50 to 99 words, a fifth of them changed, with the seed anywhere inside, always may be alike; others seldom."""
    r = random.Random(shift)
    kept = [0, 0]
    for n in (50, 73, 99):
        if shift + passages.SEED > n:
            continue
        piece = [r.getrandbits(64) for _ in range(n)]
        free = [k for k in range(n) if not shift <= k < shift + passages.SEED]
        for trial in range(20):
            changed = set(r.sample(free, n // 5)) if trial else set(free)
            other = [r.getrandbits(64) if k in changed else w for k, w in enumerate(piece)]
            sides = []
            for words in (piece, other):
                text = [r.getrandbits(64) for _ in range(40)] + words + [r.getrandbits(64) for _ in range(30)]
                sides.append(passages._sides(np.array(text, np.uint64), np.array([40 + shift])))
            found = bool(passages._may_surround([a ^ b for a, b in zip(*sides)])[0])
            assert found or not trial
            kept[0] += not trial and found
            kept[1] += not trial
    assert not kept[0] or kept[0] < kept[1]


def test_recall_of_changed_passages(spark):
    """Planted passages with 5 to 20 of 100 words changed at random, and with every n-th word changed."""
    r = random.Random(11)
    cases, rows = [], []

    def plant(kind, n, changed):
        cases.append(kind)
        w = [f"w{r.randint(0, 9999)}" for _ in range(n)]
        other = [f"x{r.randint(0, 9999)}" if k in changed else x for k, x in enumerate(w)]
        for k, text in ((0, w), (1, other)):
            around = [" ".join(f"f{r.randint(0, 99999)}" for _ in range(60)) for _ in range(2)]
            rows.append((2 * len(cases) + k, f"{around[0]} {' '.join(text)} {around[1]}"))
    for n in (50, 60, 100):
        for share in (0.05, 0.1, 0.15, 0.2):
            for _ in range(50):
                plant((n, share), n, set(r.sample(range(1, n - 1), round(n * share))))
    for step in (5, 8, 10, 12):
        plant(("every", step), 60, set(range(step - 1, 59, step)))
    found = {x.doc_id for x in passages.repeated_passages(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    missed = collections.Counter(kind for k, kind in enumerate(cases, 1) if 2 * k + 1 not in found)
    print("missed", dict(missed))
    assert not missed


def test_best_chain_is_the_best_of_all():
    r = random.Random(8)
    for _ in range(60):
        points = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(8)]
        xs, ys = [p[0] for p in points], [p[1] for p in points]

        def worth(chain):
            return sum(passages.SEED for _ in chain) - sum(
                passages.GAP * (xs[b] - xs[a] + ys[b] - ys[a]) for a, b in zip(chain, chain[1:]))
        best, stack = 0.0, [[i] for i in range(8)]
        while stack:
            chain = stack.pop()
            best = max(best, worth(chain))
            stack += [[*chain, i] for i in range(8) if xs[i] > xs[chain[-1]] and ys[i] > ys[chain[-1]]]
        found = passages.best_chains(xs, ys)
        assert abs(worth(found[0]) - best) < 1e-9 and sorted(i for c in found for i in c) == list(range(8))


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(500, k) for k in range(501, 560)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("name", sorted(k for k in oracle_sql() if re.match(r"op\d", k)))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.execute(oracle_sql()[name]).fetchall()
    assert sorted(tuple(r) for r in queries()[name](spark, SF).collect()) == sorted(expected) != []


def test_pipeline(spark):
    """Each stage against its predecessor's rows."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        out = common.stage(step(spark, docs, SF), "t")
        seen.append((docs, out))
        if name != "encoding":
            assert out.columns == corpus_pipeline.COLUMNS
        docs = out
    frames = [(a.toPandas(), b.toPandas()) for a, b in seen]
    rules = quality.quality_rules(seen[0][0]).toPandas()
    assert set(frames[0][1].doc_id) == set(rules[rules.kept].doc_id)
    assert set(frames[1][1].doc_id) == set(frames[1][0].doc_id)
    plain = dict(zip(frames[2][0].doc_id, frames[2][0].text))
    order = dict(enumerate(sorted(plain)))
    groups = near_groups({k: plain[i] for k, i in order.items()})
    assert set(frames[2][1].doc_id) == {order[k] for k, g in groups.items() if g[2]}
    assert set(frames[3][1].doc_id) == set(frames[3][0].doc_id)
    assert len(frames[4][1]) == len(frames[4][0])
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    plain = dict(zip(frames[4][0].doc_id, frames[4][0].text))
    for doc_id, ids, n in zip(frames[4][1].doc_id, frames[4][1].ids, frames[4][1].n_tokens):
        assert list(ids) == library.encode(plain[doc_id], add_special_tokens=False).ids and len(ids) == n


def test_pipeline_on_nothing_and_on_awkward_rows(spark):
    """Empty documents, and NULL and repeated ids through all stages: what ``run`` says of them."""
    r = random.Random(23)
    texts = [sentence(r, 90) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[0]), (1, texts[1]), (1, texts[2]), (2, texts[1]), (3, texts[3]), (4, texts[3]),
            (None, None), (5, ""), (6, texts[4] + "\n" + texts[5]), (7, texts[4])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    whole = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], schema)
    # Rows of NULL ids and of an id of which one stays all stay; documents that lost all lines stay as empty ones.
    for docs, expected in ((whole, {None: 2, 1: 2, 2: 1, 3: 1, 4: 1, 6: 1, 7: 1}), (whole.limit(0), {})):
        for _, step in corpus_pipeline.STAGES:
            docs = common.stage(step(spark, docs, SF), "awkward")
        assert collections.Counter(x.doc_id for x in docs.collect()) == expected


def test_pipeline_keeps_good_rows_of_null_and_repeated_ids(spark):
    r = random.Random(17)
    good = [sentence(r, 80) for _ in range(8)]
    rows = [(None, good[0]), (None, good[1]), (None, "too short"), (None, None), (None, ""), (1, good[2]),
            (1, "short too"), (1, good[3]), (1, good[3]), (2, good[4]), (3, "spam and eggs " * 40), (4, good[2])]
    docs = spark.createDataFrame([(i, t, [None, "en"][k % 2], "a", len(t or "")) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.keep_good(spark, docs, SF).collect()
    assert sorted((str(x.doc_id), x.text) for x in left) == sorted((str(i), t) for i, t in rows if t in good)

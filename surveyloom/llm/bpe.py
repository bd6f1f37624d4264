"""Byte-pair encoding with forced boundaries, and decoding, for a public word-level vocabulary."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the vocabulary splits a text into words; fixed by its file.
WORD = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")

#: Mark at the end of a word's last token; fixed by the file.
WORD_END = "</w>"

#: White space as the vocabulary has it; str.split also cuts at four separators that are none.
BLANKS = regex.compile(r"\p{White_Space}+")
SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")

#: Runs of letters whose ids a worker remembers, in each of two generations.
REMEMBERED = 130_000

#: Letters from which the pairs of a fragment wait in a heap: both ways merge alike, each is faster on its side.
LONG_FRAGMENT = 100

#: Bytes of texts that are encoded before their ids are handed on.
AT_A_TIME = 1 << 22


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, merges and certain boundaries, read from the JSON text of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        self.printed = dict(enumerate(self.letters))
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.joined = {(a, b) for t in self.ids for c in [t.removesuffix(WORD_END)] for a, b in zip(c, c[1:])}
        self.marks = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None

    def fragments(self, word: str) -> list[list[str]]:
        """The letters of a word, cut wherever no token of the vocabulary holds both neighbours.

        No merge can ever cross such a place, so each fragment has the ids that it
        has inside the word.
        """
        letters = list(word.encode().decode("latin-1").translate(self.printed))
        joined = self.joined
        cuts = [i for i, pair in enumerate(zip(letters, letters[1:]), 1) if pair not in joined]
        parts = [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)])] if cuts else [letters]
        parts[-1][-1] += WORD_END
        return parts

    def merge(self, parts: list[str]) -> list[str]:
        """Join the leftmost pair of lowest rank, again and again, until no pair has a rank."""
        if len(parts) >= LONG_FRAGMENT:
            return self.merge_long(parts)
        get, none = self.rank.get, len(self.rank)
        ranks = [get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
        return parts

    def merge_long(self, parts: list[str]) -> list[str]:
        """``merge`` in n log n steps: pairs wait in a heap, tokens are linked to their neighbours.

        A pair found in the heap may be gone; it counts if the tokens now at its place have its rank.
        """
        get, n = self.rank.get, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := get(pair)) is not None]
        heapify(waiting)

        def wait(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := get((parts[i], parts[j]))) is not None:
                heappush(waiting, (r, i))

        while waiting:
            rank, i = heappop(waiting)
            j = after[i]
            if not parts[i] or j == n or get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            wait(before[i], i)
            wait(i, k)
        return [t for t in parts if t]

    def word_ids(self, word: str) -> list[int]:
        return [self.ids[t] for part in self.fragments(word) for t in self.merge(part)]


class _Remembered(dict):
    """Values of keys met before, in two generations of at most ``REMEMBERED`` each."""

    def __init__(self, make: Callable[[str], list[int]]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> list[int]:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def normal(text: str) -> str:
    """NFC, then lower case letter by letter (no rule for a sigma at the end of a word)."""
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class Encoder:
    """Whole texts to ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = _Remembered(vocabulary.word_ids)
        self.runs = _Remembered(self.run_ids)

    def run_ids(self, run: str) -> list[int]:
        words = [run] if run.isalpha() and run.isascii() else WORD.findall(run)
        return self.words[words[0]] if len(words) == 1 else [i for w in words for i in self.words[w]]

    def plain(self, text: str) -> Iterator[int]:
        """No word holds a blank, so runs between blanks are encoded one by one."""
        text = normal(text)
        runs = text.split() if SEPARATORS.isdisjoint(text) else BLANKS.split(text)
        return chain.from_iterable(map(self.runs.__getitem__, runs))

    def __call__(self, text: str | None) -> np.ndarray:
        """Special tokens in a text are found first; what stands between them is encoded on its own."""
        text = text or ""
        marks = self.vocabulary.marks
        if marks is None or "<|" not in text:
            return np.fromiter(self.plain(text), np.int32)
        out, at = [], 0
        for found in marks.finditer(text):
            out += [*self.plain(text[at:found.start()]), self.vocabulary.special[found[0]]]
            at = found.end()
        return np.array([*out, *self.plain(text[at:])], np.int32)


class Decoder:
    """Ids to the tokens' texts joined by one blank, as a file without a decoder has it."""

    def __init__(self, vocabulary: Vocabulary):
        top = max(vocabulary.tokens) + 1
        self.tokens = [vocabulary.tokens.get(i, "") for i in range(top)]

    def __call__(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def _vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


@lru_cache(maxsize=1)
def _encoder(text: str) -> Encoder:
    """One encoder for all tasks of a worker, with what it remembers."""
    return Encoder(_vocabulary(text))


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts hold about ``AT_A_TIME`` bytes together; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    through, i = np.cumsum(sizes, dtype=np.int64), 0
    while i < len(sizes):
        before = through[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(through, before + AT_A_TIME, "right")))
        yield i, j
        i = j


def _id_lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found), pa.int32()))


def _encoded(sent, text: str, decoded: bool = False):
    """Ids of the texts, or, in the same pass, ids and what they decode to in the place of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(sent.value)
        decode = Decoder(encode.vocabulary) if decoded else None
        for whole in batches:
            for lo, hi in _runs(whole.column(text)):
                batch = whole.slice(lo, hi - lo)
                found = [encode(t.as_py()) for t in batch.column(text)]
                columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"ids": _id_lists(found)}
                if decode:
                    del columns[text]
                    columns["decoded"] = pa.array(map(decode, found), pa.string())
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])
    return run


def _decoded(sent, ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(_vocabulary(sent.value))
        for batch in batches:
            column = batch.column(ids)
            at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            texts = pa.array([decode(flat[a:b]) for a, b in zip(at, at[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])
    return run


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema), more])


def _file_text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ids (array of int) of the whole text; NULL and empty texts have none. A column ids is replaced.

    ``path`` is the vocabulary file on the driver; its text is broadcast (a file of
    fixed size, some 2 MB). Nothing is shuffled: a document is encoded where it is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_file_text(path))
    own = docs.drop("ids")
    return own.mapInArrow(_encoded(sent, text), _schema(own, "ids array<int>"))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds decoded, the text of the ids; a column decoded is replaced."""
    sent = df.sparkSession.sparkContext.broadcast(_file_text(path))
    own = df.drop("decoded")
    return own.mapInArrow(_decoded(sent, ids), _schema(own, "decoded string"))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: ids and decoded take the place of the text.

    A text goes to a worker once, and a task has one worker with one vocabulary for
    both. Columns ids and decoded are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_file_text(path))
    own = docs.drop("ids", "decoded")
    return own.mapInArrow(_encoded(sent, text, decoded=True), _schema(own.drop(text), "ids array<int>, decoded string"))


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    back = round_trip(slim, path)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))

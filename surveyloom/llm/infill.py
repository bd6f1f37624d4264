"""Fill-in-the-middle: two cuts between units of a text, and its parts put into a new order behind marks.

The cuts are found by a wavelet matrix over the classes of the characters. Texts of many
rows are indexed together, as one sequence of UTF-8 bytes whose classes tell blanks, line
ends, stops and the bytes that continue a character. Rank queries count any class in any
stretch: ends of units add up over the classes that close a unit, and the code points of a
stretch are its bytes less the continuing ones. A cut after ``k`` units lies where the
summed ranks first reach ``k``, which all rows of a slice find together by bisection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.textscan import flat_text

OTHER, LETTER, DIGIT, BLANK, LINE_END, STOP, LEAD, CONTINUES = range(8)

#: Class of each byte of UTF-8.
CLASS_OF = np.full(256, OTHER, np.uint8)
CLASS_OF[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = LETTER
CLASS_OF[list(b"0123456789")] = DIGIT
CLASS_OF[list(b" \t\v\f\r")] = BLANK
CLASS_OF[list(b"\n")] = LINE_END
CLASS_OF[list(b".!?")] = STOP
CLASS_OF[128:192] = CONTINUES
CLASS_OF[192:] = LEAD

#: Classes whose characters close a unit; what follows the last of them is a unit too.
UNITS: dict[str, tuple[int, ...]] = {"line": (LINE_END,), "word": (BLANK, LINE_END), "sentence": (STOP, LINE_END)}

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")

#: Bytes of texts that are indexed at a time; a longer text is indexed on its own.
AT_A_TIME = 1 << 22

ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


class _Bits:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Symbols below 2**levels; at each level the sequence is parted stably by one bit, zeros first."""

    def __init__(self, symbols: np.ndarray, levels: int = 3):
        self.levels: list[tuple[_Bits, int]] = []
        for level in reversed(range(levels)):
            bits = (symbols >> level) & 1 == 1
            self.levels.append((_Bits(bits), int(len(bits) - np.count_nonzero(bits))))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each place of ``i``."""
        first, last = np.zeros(1, np.int64), i
        for depth, (bits, zeros) in enumerate(self.levels):
            if symbol >> (len(self.levels) - 1 - depth) & 1:
                first, last = zeros + bits.ones(first), zeros + bits.ones(last)
            else:
                first, last = first - bits.ones(first), last - bits.ones(last)
        return last - first


class Boundaries:
    """Units and code points of stretches of a byte sequence, and cuts after a number of units."""

    def __init__(self, data: np.ndarray, unit: str):
        self.data, self.closing = data, UNITS[unit]
        self.matrix = WaveletMatrix(CLASS_OF[data])

    def _ends(self, i: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(c, i) for c in self.closing)

    def units(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        closed = self._ends(hi) - self._ends(lo)
        if not len(self.data):
            return closed
        open_end = (hi > lo) & ~np.isin(CLASS_OF[self.data[np.maximum(hi, 1) - 1]], self.closing)
        return closed + open_end

    def cut(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """First place from ``lo`` with ``k`` unit ends behind it; ``hi`` where there are fewer."""
        goal, a, b = self._ends(lo) + k, lo.copy(), hi.copy()
        while (a < b).any():
            middle = (a + b) >> 1
            reached = self._ends(middle) >= goal
            b = np.where(reached, middle, b)
            a = np.where(reached, a, np.minimum(middle + 1, b))
        return a

    def chars(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return hi - lo - (self.matrix.rank(CONTINUES, hi) - self.matrix.rank(CONTINUES, lo))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    through, i = np.cumsum(sizes, dtype=np.int64), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(through, AT_A_TIME + (through[i - 1] if i else 0), "right")))
        yield i, j
        i = j


def _transformed(text: str, unit: str, percent: int, spm_percent: int, marks: Sequence[str]) -> Callable:
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, stop in _slices(whole.column(text)):
                batch = whole.slice(start, stop - start)
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                h1, h2, h3, h4 = (columns.pop(f"__h{i}").to_numpy() for i in range(1, 5))
                texts = pc.fill_null(columns[text], "")
                data, at = flat_text(texts)
                lo, hi = at[:-1], at[1:]
                found = Boundaries(data, unit)
                n = found.units(lo, hi)
                one, two = h1 % (n + 1), h2 % (n + 1)
                i, j = found.cut(lo, hi, np.minimum(one, two)), found.cut(lo, hi, np.maximum(one, two))
                plain = (lo == hi) | (h3 % 100 >= percent)
                for mark in marks:
                    plain |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
                spm = h4 % 100 < spm_percent
                raw = data.tobytes()

                def output(lo: int, i: int, j: int, hi: int, plain: bool, spm: bool) -> bytes:
                    if plain:
                        return raw[lo:hi]
                    prefix, middle, suffix = raw[lo:i], raw[i:j], raw[j:hi]
                    return b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))

                out = list(map(output, lo.tolist(), i.tolist(), j.tolist(), hi.tolist(), plain.tolist(), spm.tolist()))
                columns |= {
                    "n": pa.array(n), "form": pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string()),
                    "prefix_chars": pa.array(found.chars(lo, i), mask=plain),
                    "middle_chars": pa.array(found.chars(i, j), mask=plain),
                    "output": pa.array(out, pa.binary()).cast(pa.string())}
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])
    return run


def fill_in_middle(docs: DataFrame, unit: str = "line", percent: int = 100, spm_percent: int = 50, salt: str = "7:",
                   marks: Sequence[str] = MARKS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n (units of the text), form, prefix_chars, middle_chars and output; such columns are replaced.

    Four numbers from the sha256 of ``salt`` and the id decide on a row, so it is cut alike wherever it stands:
    the first two cut between units (``UNITS``), the third leaves a text plain unless it is below ``percent``, the
    last makes it suffix-first (spm) below ``spm_percent``, else prefix-first (psm). A text that is NULL, empty or
    holds a mark stays plain; plain rows have NULL chars. A NULL id counts as no digits. Repeated rows give equal
    rows, an empty table an empty result. Nothing is shuffled.
    """
    if len(set(marks)) != 3 or not all(marks) or any(
            b in a and a != b or any(b.startswith(a[k:]) for k in range(1, len(a))) for a in marks for b in marks):
        raise ValueError("three marks are needed of which none begins or stands inside another")
    own = docs.drop(*ADDED)
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"__h{i + 1}") for i in range(4)]
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in own.schema)
    schema = f"{fields}, n long, form string, prefix_chars long, middle_chars long, output string"
    return own.select("*", *numbers).mapInArrow(_transformed(text, unit, percent, spm_percent, marks), schema)


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text again, from output and form alone.

    A transformed output holds each mark once: its text holds none, and no mark begins
    inside another, so parts and marks cannot run together into one.
    """
    p, s, m = (F.lit(x) for x in marks)

    def between(text: Column, mark: Column) -> tuple[Column, Column]:
        return F.split_part(text, mark, F.lit(1)), F.split_part(text, mark, F.lit(2))

    before, middle = between(output, m)
    psm_prefix, psm_suffix = between(F.split_part(before, p, F.lit(2)), s)
    spm_suffix, spm_prefix = between(F.split_part(before, s, F.lit(2)), p)
    return (F.when(form == "psm", F.concat(psm_prefix, middle, psm_suffix))
            .when(form == "spm", F.concat(spm_prefix, middle, spm_suffix)).otherwise(output))


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every document."""
    done = fill_in_middle(docs.select("doc_id", "text")).drop("text")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))

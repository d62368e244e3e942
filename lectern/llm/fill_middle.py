"""Fill-in-the-middle transformation, cuts found with a wavelet matrix over classes of characters.

The bytes of many texts are laid end to end, each with a class: inside of a character, white space, first of a word and so on. A wavelet
matrix answers how many bytes of a class lie before a place by one popcount for each bit of the class. The sum over the classes
that begin a unit counts units, and bisection on it finds the byte where a given number of units ends, for all cuts
of all texts at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.texts import schema_of, steps

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes: inside of a character, white space, sign, letter or digit, first of a word, white space or word that begins a line.
INSIDE, SPACE, SIGN, LETTER, WORD, SPACE_LINE, WORD_LINE = range(7)
BITS = 3
#: The classes whose bytes begin a unit.
UNITS = {"character": (SPACE, SIGN, LETTER, WORD, SPACE_LINE, WORD_LINE), "word": (WORD, WORD_LINE), "line": (SPACE_LINE, WORD_LINE)}


def byte_classes(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 texts; begins marks the first byte of each text."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    letter = (data >= 128) | ((data >= 48) & (data <= 57)) | (((data | 32) >= 97) & ((data | 32) <= 122))
    first_of_line = begins.copy()
    first_of_line[1:] |= data[:-1] == 10
    after_space = begins.copy()
    after_space[1:] |= space[:-1]
    out = np.where(space, SPACE, np.where(letter, LETTER, SIGN)).astype(np.uint8)
    out[after_space & ~space] = WORD
    out[first_of_line] = np.where(space[first_of_line], SPACE_LINE, WORD_LINE)
    out[(data & 0xC0) == 0x80] = INSIDE
    return out


class WaveletMatrix:
    """Ranks of classes in a sequence of them: a row of bits for each bit of the class, highest first, zeros sorted before ones."""

    def __init__(self, classes: np.ndarray, bits: int = BITS):
        self.bits, self.size, self.words, self.sums, self.zeros = bits, len(classes), [], [], []
        for bit in reversed(range(bits)):
            ones = (classes >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(packed) // 8 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.words.append(words)
            self.sums.append(np.concatenate([[0], counts[:-1]]))
            self.zeros.append(self.size - int(counts[-1]))
            classes = np.concatenate([classes[~ones], classes[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a level before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.sums[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, cls: int, at: np.ndarray) -> np.ndarray:
        """How many bytes of a class lie before each place."""
        low, high = np.zeros(1, np.int64), at
        for level in range(self.bits):
            low_ones, high_ones = self._ones(level, low), self._ones(level, high)
            if cls >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + low_ones, self.zeros[level] + high_ones
            else:
                low, high = low - low_ones, high - high_ones
        return high - low

    def count(self, classes: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many bytes of any of the classes lie before each place; counted by the others where those are fewer."""
        others = [c for c in range(INSIDE, WORD_LINE + 1) if c not in classes]
        if len(others) < len(classes):
            return at - sum((self.rank(c, at) for c in others), np.zeros(len(at), np.int64))
        return sum((self.rank(c, at) for c in classes), np.zeros(len(at), np.int64))

    def cut(self, classes: tuple[int, ...], begin: np.ndarray, end: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The place in begin to end where the unit after the first units begins (end where there is none, begin for no unit)."""
        wanted = self.count(classes, begin) + units
        low, high = begin.copy(), end.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            beyond = self.count(classes, np.minimum(middle + 1, self.size)) > wanted
            high, low = np.where(open_ & beyond, middle, high), np.where(open_ & ~beyond, middle + 1, low)
        return np.where(units > 0, low, begin)


def _formed(unit: str, plain_from: int, spm_below: int, schema: pa.Schema):
    marks, classes = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)], UNITS[unit]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                texts = step.column("text").cast(pa.binary())
                raw = [x or b"" for x in texts.to_pylist()]
                end = np.cumsum([len(x) for x in raw], dtype=np.int64)
                begin = np.concatenate([[0], end[:-1]]).astype(np.int64)
                data = np.frombuffer(b"".join(raw), np.uint8)
                first = np.zeros(len(data), bool)
                first[begin[begin < end]] = True
                wavelet = WaveletMatrix(byte_classes(data, first))
                n = wavelet.count(classes, end) - wavelet.count(classes, begin)
                characters = UNITS["character"]
                h = [np.array(step.column("h")[k].as_py(), np.int64) for k in range(step.num_rows)]
                one, two = (np.array([x[k] for x in h], np.int64) % (n + 1) for k in (0, 1))
                near, far = (wavelet.cut(classes, begin, end, f(one, two)) for f in (np.minimum, np.maximum))
                chars = [wavelet.count(characters, x) for x in (begin, near, far)]
                forms, lengths, outs = [], ([], []), []
                for k, text in enumerate(raw):
                    a, b = int(near[k] - begin[k]), int(far[k] - begin[k])
                    plain = not text or any(x in text for x in marks) or h[k][2] % 100 >= plain_from
                    form = "plain" if plain else "spm" if h[k][3] % 100 < spm_below else "psm"
                    forms.append(form)
                    lengths[0].append(None if plain else int(chars[1][k] - chars[0][k]))
                    lengths[1].append(None if plain else int(chars[2][k] - chars[1][k]))
                    outs.append(text if plain else b"".join((p, text[:a], s, text[b:], m, text[a:b]) if form == "psm" else (s, text[b:], p, text[:a], m, text[a:b])))
                columns = [step.column("doc_id"), pa.array(n), pa.array(forms, pa.string()), *(pa.array(x, pa.int64()) for x in lengths), pa.array(outs, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, unit: str = "character", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars, output.

    The digest of seed:doc_id gives both cuts, whether a text stays plain (plain_from of 100 do not) and the order of its parts (spm_below of
    100: suffix first). A unit of unit (character, word or line) is never cut; white space before a first word goes with it. Null and empty
    texts, and such as hold a mark, are plain; a null id counts as an empty one; very long texts are cut whole; rows that repeat
    come out alike; an empty table gives no rows; other columns of docs, whatever their names, are not read.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    digest = F.sha2(key, 256)
    groups = F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), groups.alias("h"))
    ddl = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return own.mapInArrow(_formed(unit, plain_from, spm_below, schema_of(docs.sparkSession, ddl)), ddl)


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle was given: no part of it holds a mark, so marks tell the parts apart."""
    parts = F.split(output, "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))

"""Byte-level BPE token counts by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a step are laid end to end in one array of symbols. Each round looks up the rank of every
adjacent pair, takes the lowest rank of each sequence and applies all its merges at once; sequences without a
mergeable pair leave. What is left of a pre-token is its number of tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.llm.texts import arrow, steps

#: Pre-tokens whose counts a task remembers; older ones are forgotten and counted again.
MEMO = 1 << 20
#: Longer pre-tokens are not remembered.
MEMO_BYTES = 64
#: Pre-tokens that are merged together.
ROUND = 1 << 14
_NONE = np.int32(2**31 - 1)


def latin_words(pattern: str) -> re.Pattern:
    """The same pattern for texts of Latin-1 characters, for the faster standard engine: classes become sets."""
    chars = [chr(i) for i in range(256)]
    sets = {c: "".join(re.escape(x) for x in chars if regex.fullmatch(c, x)) for c in (r"\p{L}", r"\p{N}", r"\s")}
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(sets.values()) + "]").replace(r"\S", f"[^{sets[chr(92) + 's']}]")
    for name, members in sets.items():
        pattern = pattern.replace(name, f"[{members}]")
    return re.compile(pattern)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """Ranks and results of symbol pairs; a symbol below 256 is a byte."""

    def __init__(self, spec: dict, pattern: str):
        letters = byte_letters()
        symbol: dict[str, int] = dict(letters)
        pairs, made = [], []
        for merge in spec["model"]["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pairs.append((symbol[left] << 32) | symbol[right])
            made.append(symbol.setdefault(left + right, len(symbol)))
        keys = np.array(pairs, np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), np.array(made, np.int32)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.any_words, self.latin_words = regex.compile(pattern), latin_words(pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many added tokens stand between them."""
        if self.cut is None or not any(x in text for x in self.special):
            return self._words(text), 0
        parts = self.cut.split(text)
        return [x for part in parts[::2] for x in self._words(part)], len(parts) // 2

    def _words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_words.findall(text)
        return self.latin_words.findall(text)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each non-empty word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        owner, out = np.repeat(np.arange(len(words), dtype=np.int32), lengths), lengths.copy()
        pair = self._pair_ranks(symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            sizes = np.diff(starts, append=len(owner))
            least = np.minimum.reduceat(pair, starts)
            going = np.repeat(least < _NONE, sizes)
            if not going.all():
                out[owner[starts]] = sizes
                symbols, owner, pair, least, sizes = symbols[going], owner[going], pair[going], least[least < _NONE], sizes[least < _NONE]
                if not len(symbols):
                    break
            hit = pair == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            run = np.diff(at, prepend=-2) != 1
            at = at[(np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            symbols[at] = self.made[pair[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
            merged = np.zeros(len(keep), bool)
            merged[at] = True
            merged = merged[keep]
            pair = pair[keep]
            merged[:-1] |= merged[1:]
            stale = np.flatnonzero(merged)
            pair[stale] = self._pair_ranks(symbols, owner, stale)
        return out

    def _pair_ranks(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(len(symbols)) if at is None else at
        after = np.minimum(at + 1, len(symbols) - 1)
        same = (owner[at] == owner[after]) & (after > at)
        return np.where(same, self.lookup(symbols[at], symbols[after]), _NONE)


@lru_cache(maxsize=2)
def _worker_state(spec: str, pattern: str) -> tuple[MergeTable, dict[str, int]]:
    """A Python worker keeps the table and the counts of frequent pre-tokens from one task to its next."""
    return MergeTable(json.loads(spec), pattern), {}


def _counts(spec: str, pattern: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, memo = _worker_state(spec, pattern)
        for batch in batches:
            for step in steps(batch, "text"):
                texts = [x or "" for x in step.column("text").to_pylist()]
                found = [table.pre_tokens(x) for x in texts]
                here = set()
                for words, _ in found:
                    here.update(words)
                new = [x for x in here if x not in memo]
                if len(memo) + len(new) > MEMO:
                    memo.clear()
                    new = list(here)
                if new:
                    for at in range(0, len(new), ROUND):
                        part = new[at : at + ROUND]
                        memo.update(zip(part, table.count([x.encode() for x in part]).tolist()))
                totals = [sum(map(memo.__getitem__, words)) + extra for words, extra in found]
                for x in new:
                    if len(x) > MEMO_BYTES:
                        del memo[x]
                yield arrow(schema, doc_id=step.column("doc_id"), n_bytes=[len(x.encode()) for x in texts], n_tokens=totals)

    return run


def token_counts(docs: DataFrame, spec: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    spec is the JSON of a byte-level BPE tokenizer (its size is that of a vocabulary), pattern splits text
    before the merges. Added tokens inside a text count as one token each. Null and empty texts have no tokens; very long texts are
    counted whole, and of equal ranks in a symbol sequence all are merged from the left; rows that repeat are counted each; an
    empty table gives no rows; other columns of docs, whatever their names, are not read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = own.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema
    return own.mapInArrow(_counts(spec, pattern, to_arrow_schema(out)), out).withColumn("over_limit", F.col("n_tokens") > limit)

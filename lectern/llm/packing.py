"""Packing of token sequences by a grouping genetic algorithm on islands.

A document's ids are cut into pieces of at most capacity tokens. Pieces that fill a sequence go alone. The others are
dealt by a hash into districts of a bounded number of pieces. Each district is packed by several islands, rows of a table:
an island breeds a small population of packings in one task, and between epochs its best packing moves to the next island
of the district. A crossover puts well-filled bins of one parent whole into the other, drops the other's bins that hold one
of their pieces, and best-fits the pieces that lost their place. A district that needs no more sequences than its tokens
must have is done. Loosely filled sequences of all districts are opened and packed together again, until they fit in one
district or a round hardly saves any.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import write_once
from lectern.llm.texts import arrow, schema_of, steps

#: Pieces of a district; bounds what one task packs.
DISTRICT = 1 << 13
#: Islands of a district, epochs between which best packings move on, packings of an island, and crossovers of an epoch.
ISLANDS, EPOCHS, POPULATION, CROSSOVERS = 3, 2, 6, 24
#: Share of a parent's bins that a crossover hands on.
HANDED = 0.1
#: A sequence with at least this share of its room unused is opened and packed again with those of other districts.
LOOSE = 1 / 16
#: A round that saves less than this share of the sequences it opened is the last.
SAVING = 1 / 1024
#: Words whose ids a task remembers, how long they may be, and new words that are tokenized together.
MEMO, MEMO_CHARS, TOGETHER = 1 << 19, 64, 1 << 12

#: What a character is to the pattern of a byte-level vocabulary; 0: not known, nothing is cut beside it.
_LETTER, _DIGIT, _SIGN, _QUOTE, _SPACE, _BREAK = range(1, 7)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point: 0 for marks, for rare white space, and where Unicode 3.2 and today's do not agree."""
    then, of = unicodedata.ucd_3_2_0, {"L": _LETTER, "N": _DIGIT, "P": _SIGN, "S": _SIGN}
    out = np.zeros(0x110000, np.uint8)
    out[:0x10000] = [of.get(c, 0) if (c := unicodedata.category(x)[0]) == then.category(x)[0] else 0 for x in map(chr, range(0x10000))]
    out[list(b"' \t\n\r")] = _QUOTE, _SPACE, _BREAK, _BREAK, _BREAK
    return out


def _solid(kind: np.ndarray) -> np.ndarray:
    return (kind >= _LETTER) & (kind <= _QUOTE)


def _rules() -> np.ndarray:
    """Whether two kinds side by side are parted. 1: always; 2: if a letter, digit or sign follows; 3: if there is a cut before them."""
    out = np.zeros((8, 8), np.uint8)
    for a in range(_LETTER, _BREAK + 1):
        for b in range(_LETTER, _BREAK + 1):
            if b >= _SPACE:
                out[a, b] = 2 if a >= _SPACE else 1
            elif a >= _SPACE:
                out[a, b] = 3 if a == _BREAK else 0  # a space goes with what follows it
            else:
                out[a, b] = min(a, _SIGN) != min(b, _SIGN) and (a, b) != (_QUOTE, _LETTER)  # 's, 're and the like are words
    return out.ravel()


_RULES = _rules()


def sure_cuts(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Byte offsets, edges among them, at which the pattern of a byte-level vocabulary parts texts laid end to end, whatever else they say.

    The pattern may part them at other places too. What lies between two offsets is parted as it would be alone.
    """
    here = np.zeros(len(raw) + 1, bool)
    here[edges] = True
    lead = (raw & 0xC0) != 0x80
    first = here[:-1][lead]
    kind = _kinds()[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")]
    rule = np.zeros(len(kind), np.uint8)
    rule[1:] = _RULES[(kind[:-1] << 3) | kind[1:]]
    cut = first | (rule == 1)
    at = np.flatnonzero(rule[:-1] == 2)
    cut[at] |= _solid(kind[at + 1]) & ~first[at + 1]
    at = np.flatnonzero(rule == 3)
    cut[at] |= cut[at - 1]
    here[:-1][lead] = cut
    return np.flatnonzero(here)


class WordIds:
    """A tokenizer that asks the library once for each distinct word and lays the ids of texts end to end by numpy.

    A word is what lies between two sure cuts. Words are remembered as rows of arrays; when there are more than MEMO, the half that most steps
    have met stays. New words are tokenized together, as one text; the bytes that each id stands for tell where a word ends.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.rows = Tokenizer.from_str(spec), {}
        self.laid, self.begin, self.count, self.met = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        made = json.loads(spec)
        split, added = made.get("pre_tokenizer") or {}, made.get("added_tokens") or []
        plain = all(not re.search(r"\s", x["content"]) and not any(x.get(k) for k in ("lstrip", "rstrip", "single_word")) for x in added) and len({x.get("normalized") for x in added}) < 2
        self.by_word = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and made.get("normalizer") is None and plain
        self.added = re.compile(b"|".join(re.escape(x["content"].encode()) for x in sorted(added, key=lambda x: -len(x["content"])))) if added else None
        letters = self.tokenizer.get_vocab()  # a letter of a byte-level vocabulary is a byte
        self.sizes = np.zeros(max(letters.values(), default=0) + 1, np.int64)
        self.sizes[list(letters.values())] = [len(x) for x in letters]
        for x in added:
            self.sizes[x["id"]] = len(x["content"].encode())

    def ids(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.by_word:
            return self._encode(texts.to_pylist())
        if not pc.any(pc.greater(pc.binary_length(texts), 0)).as_py():
            return [self.laid[:0]] * len(texts)
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = data.slice(edges[0], edges[-1] - edges[0])
        edges = edges - edges[0]
        cuts = self._cuts(np.frombuffer(data, np.uint8), edges)
        coded = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), data]).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        lasting = self._learn(words)
        code = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        self.met[code] += 1
        code = code[np.asarray(coded.indices)]
        sizes = self.count[code]
        ends = np.cumsum(sizes)
        laid = self.laid[np.repeat(self.begin[code] - (ends - sizes), sizes) + np.arange(ends[-1])]
        self._forget(*lasting)
        bounds = np.concatenate([[0], ends])[np.searchsorted(cuts, edges)].tolist()
        return [laid[a:b] for a, b in zip(bounds, bounds[1:])]

    def _cuts(self, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The sure cuts of texts; an added token in a text parts it as an edge does, and is not cut itself."""
        if self.added is None or not self.added.search(raw):
            return sure_cuts(raw, edges)
        found = [m.span() for a, b in zip(edges.tolist(), edges[1:].tolist()) for m in self.added.finditer(raw, a, b)]
        spans = np.array(found, np.int64).reshape(-1, 2)
        cuts = sure_cuts(raw, np.concatenate([edges, spans.ravel()]))
        inside = np.searchsorted(spans[:, 0], cuts) - 1  # the last added token that begins before a cut
        return cuts[(inside < 0) | (cuts >= spans[inside, 1])] if len(spans) else cuts

    def _learn(self, words: list[str]) -> tuple[int, int]:
        """Make rows for new words, those too long to be remembered last; how many rows and ids may stay."""
        new = [w for w in words if w not in self.rows]
        self._add([w for w in new if len(w) <= MEMO_CHARS])
        lasting = len(self.rows), len(self.laid)
        self._add([w for w in new if len(w) > MEMO_CHARS])
        return lasting

    def _add(self, words: list[str]) -> None:
        if not words:
            return
        chars = np.fromiter(map(len, words), np.int64, len(words))
        kind = _kinds()[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        last = np.cumsum(chars) - 1
        first = last + 1 - chars
        spaced = (kind[first] == _SPACE) & (chars > 1)
        plain = _solid(kind[last]) & _solid(kind[first + spaced])  # parted from a word before it by its own space, or by a line break
        begin, count, parts, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [self.laid], len(self.laid)
        rows = np.flatnonzero(plain)
        for lo in range(0, len(rows), TOGETHER):
            own = rows[lo : lo + TOGETHER]
            ids = self._encode(["".join(words[k] if words[k][0] == " " else "\n" + words[k] for k in own.tolist())])[0]
            size = np.fromiter((len(words[k].encode()) for k in own.tolist()), np.int64, len(own))
            ends, reached = np.cumsum(size + ~spaced[own]), np.cumsum(self.sizes[ids])
            left = np.searchsorted(reached, ends - size, "right")
            begin[own], count[own] = at + left, np.searchsorted(reached, ends, "right") - left
            parts.append(ids)
            at += len(ids)
        rows = np.flatnonzero(~plain).tolist()
        for k, ids in zip(rows, self._encode([words[k] for k in rows])):
            begin[k], count[k] = at, len(ids)
            parts.append(ids)
            at += len(ids)
        self.rows.update(zip(words, range(len(self.rows), len(self.rows) + len(words))))
        self.laid, self.begin, self.count = np.concatenate(parts), np.concatenate([self.begin, begin]), np.concatenate([self.count, count])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.int32)])

    def _forget(self, rows: int, laid: int) -> None:
        """Drop the rows of long words, and where there are too many the half that the fewest steps have met."""
        while len(self.rows) > rows:
            self.rows.popitem()
        self.laid, self.begin, self.count, self.met = self.laid[:laid], self.begin[:rows], self.count[:rows], self.met[:rows]
        if rows <= MEMO:
            return
        stays = np.zeros(rows, bool)
        stays[np.argsort(self.met, kind="stable")[-(MEMO // 2) :]] = True
        self.rows = {w: k for k, w in enumerate(compress(self.rows, stays.tolist()))}
        begin, self.count, self.met = self.begin[stays], self.count[stays], self.met[stays] // 2
        ends = np.cumsum(self.count)
        self.begin = ends - self.count
        self.laid = self.laid[np.repeat(begin - self.begin, self.count) + np.arange(ends[-1])]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


@lru_cache(maxsize=1)
def _word_ids(spec: str) -> WordIds:
    """A Python worker keeps the tokenizer and the ids of frequent words from one task to its next."""
    return WordIds(spec)


def _cut(spec: str, capacity: int, end_id: int, schema: pa.Schema):
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_ids(spec)
        for batch in batches:
            for step in steps(batch, "text"):
                rows = []
                for doc_id, ids in zip(step.column("doc_id").to_pylist(), known.ids(pc.fill_null(step.column("text"), ""))):
                    ids = np.concatenate([ids, end])
                    n = len(ids)
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    rows += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                yield arrow(schema, **dict(zip(schema.names, map(list, zip(*rows)))))

    return run


def cut_pieces(docs: DataFrame, spec: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every row's ids with end_id after them, in pieces of capacity tokens but for the first."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ddl = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return own.mapInArrow(_cut(spec, capacity, end_id, schema_of(docs.sparkSession, ddl)), ddl)


class Packer:
    """Packings of one district: an array of bin numbers, one for each piece, pieces sorted by falling length."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: tuple[int, ...]):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.least = -(-int(self.lengths.sum()) // capacity)
        self.rng = np.random.default_rng(seed)

    def best_fit(self, bins: np.ndarray, order: np.ndarray, rooms: np.ndarray) -> np.ndarray:
        """Place pieces one by one into the fullest bin with room for them, or a new one; rooms has what is free in each bin (0: closed).

        Bit r of a number says that a bin with r free tokens is there, so a place is found in a few instructions.
        """
        stacks: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        there, new = 0, len(rooms)
        for b in np.flatnonzero(rooms).tolist():
            stacks[rooms[b]].append(b)
        for room, stack in enumerate(stacks):
            there |= bool(stack) << room
        for i, n in zip(order.tolist(), self.lengths[order].tolist()):
            fit = there >> n
            if fit:
                room = n + (fit & -fit).bit_length() - 1
                b = stacks[room].pop()
                there ^= (not stacks[room]) << room
            else:
                b, room, new = new, self.capacity, new + 1
            bins[i], left = b, room - n
            if left:
                there |= 1 << left
                stacks[left].append(b)
        return np.unique(bins, return_inverse=True)[1].astype(np.int32)

    def packed(self, spread: float) -> np.ndarray:
        """All pieces by best fit, longest first, lengths blurred by a share of spread."""
        blurred = self.lengths * (1 + spread * self.rng.random(len(self.lengths)))
        return self.best_fit(np.full(len(self.lengths), -1), np.argsort(-blurred, kind="stable"), np.zeros(0, np.int64))

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.lengths).astype(np.int64)

    def cost(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins are better, then such as are filled unevenly: full ones are worth handing on, empty ones easy to close."""
        filled = self.fills(bins) / self.capacity
        return len(filled), -float(filled @ filled)

    def crossed(self, into: np.ndarray, giver: np.ndarray) -> np.ndarray:
        """into with a tenth of the giver's fuller half of bins put in whole."""
        given, count = self.fills(giver), int(into.max()) + 1
        fullest = np.argsort(-(given + self.rng.random(len(given))), kind="stable")
        at = self.rng.integers(0, max(1, len(given) // 2))
        chosen = np.zeros(len(given), bool)
        chosen[fullest[at : at + max(1, int(HANDED * len(given)))]] = True
        moved = chosen[giver]
        doubled = np.zeros(count, bool)
        doubled[into[moved]] = True
        return self._refit(np.where(moved, count + giver, into), doubled[into] & ~moved, 0.0)

    def shaken(self, bins: np.ndarray) -> np.ndarray:
        """Some bins, the emptier the likelier, opened and their pieces placed anew."""
        free = self.capacity - self.fills(bins) + 1.0
        opened = np.zeros(len(free), bool)
        opened[self.rng.choice(len(free), min(len(free), 4 + len(free) // 64), replace=False, p=free / free.sum())] = True
        return self._refit(bins.copy(), opened[bins], 0.25)

    def _refit(self, bins: np.ndarray, displaced: np.ndarray, spread: float) -> np.ndarray:
        stay = ~displaced
        fill = np.bincount(bins[stay], self.lengths[stay]).astype(np.int64) if stay.any() else np.zeros(0, np.int64)
        at = np.flatnonzero(displaced)
        blurred = self.lengths[at] * (1 + spread * self.rng.random(len(at)))
        return self.best_fit(bins, at[np.argsort(-blurred, kind="stable")], np.where(fill > 0, self.capacity - fill, 0))

    def evolve(self, start: list[np.ndarray]) -> list[np.ndarray]:
        """A population of packings after an epoch, best first; over at once where the least possible number of bins is met."""
        people = sorted(start or [self.packed(0.0)], key=self.cost)
        while len(people) < POPULATION and self.cost(people[0])[0] > self.least:
            people.append(self.packed(0.3))
        for turn in range(CROSSOVERS):
            people = sorted(people, key=self.cost)[:POPULATION]
            if self.cost(people[0])[0] <= self.least:
                break
            one, other = self.rng.choice(len(people), 2, replace=False)
            child = self.crossed(people[one], people[other])
            people.append(self.shaken(child) if turn % 2 else child)
        return sorted(people, key=self.cost)[:POPULATION]


def _epoch(capacity: int, seed: tuple[int, ...], schema: pa.Schema):
    """One epoch of every island that a task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                district, island, lengths, people = (batch.column(c)[k].as_py() for c in ("district", "island", "lengths", "people"))
                packer = Packer(np.array(lengths), capacity, (*seed, district, island))
                people = packer.evolve([np.array(p, np.int32) for p in people])[: max(1, POPULATION // 2)]
                bins, even = packer.cost(people[0])
                yield arrow(schema, district=[district], island=[island], bins=[bins], even=[even], people=[[p.tolist() for p in people]])

    return run


def _unpacked(capacity: int, round_no: int, schema: pa.Schema):
    """Each piece's sequence, its offset there and the sequence's length, from a district's best packing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rids, lengths, bins = (np.array(batch.column(c)[k].as_py(), np.int64) for c in ("rids", "lengths", "best"))
                order = np.argsort(bins, kind="stable")
                rids, lengths, bins = rids[order], lengths[order], bins[order]
                before = np.cumsum(lengths) - lengths
                first = np.flatnonzero(np.diff(bins, prepend=-1))
                offset = before - before[first][bins]
                yield arrow(schema, rid=rids, length=lengths, sequence_id=(round_no << 56) + (batch.column("district")[k].as_py() << 14) + bins, offset=offset, filled=np.bincount(bins, lengths).astype(np.int64)[bins])

    return run


def pack_lengths(items: DataFrame, capacity: int, round_no: int, district: int = DISTRICT) -> tuple[DataFrame, int]:
    """One round over (rid, length): a written table (rid, length, sequence_id, offset, filled), and the number of districts.

    A district has about half of district pieces at least and, by the hash, never far more than that number.
    """
    spark, count = items.sparkSession, items.count()
    n = max(1, -(-count * 5 // (district * 4)))
    dealt = items.withColumn("district", F.pmod(F.xxhash64("rid", F.lit(round_no)), F.lit(n)))
    held = F.sort_array(F.collect_list(F.struct("length", "rid")), asc=False)
    districts = write_once(dealt.groupBy("district").agg(held.alias("h")).select("district", F.col("h.rid").alias("rids"), F.col("h.length").alias("lengths")), "districts")
    ddl = "district long, island int, bins int, even double, people array<array<int>>"
    schema, tasks = schema_of(spark, ddl), max(1, n * ISLANDS // 8)
    state = districts.select("district", "lengths", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.array().cast("array<array<int>>").alias("people"))
    for epoch in range(EPOCHS):
        found = write_once(state.repartition(tasks, "district", "island").mapInArrow(_epoch(capacity, (round_no, epoch), schema), ddl), "islands")
        if epoch + 1 < EPOCHS:
            elite = found.select("district", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("people", 1, 1).alias("elite"))
            state = districts.join(found, "district").join(elite, ["district", "island"]).select("district", "lengths", "island", F.concat("people", "elite").alias("people"))
    best = found.groupBy("district").agg(F.min_by(F.get("people", F.lit(0)), F.struct("bins", "even", "island")).alias("best"))
    out = "rid long, length long, sequence_id long, offset long, filled long"
    return write_once(districts.join(best, "district").mapInArrow(_unpacked(capacity, round_no, schema_of(spark, out)), out), "packed"), n


def pack_documents(docs: DataFrame, spec: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", district: int = DISTRICT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    spec is the JSON of a tokenizers vocabulary. A null or empty text is one piece of end_id alone; very long ones are cut
    into pieces of capacity tokens, the first of which may be shorter; rows that repeat, and rows without an id, are packed each
    for itself; ties in length go by row; an empty table gives no rows; other columns of docs, whatever their names, are not read.
    """
    pieces = write_once(cut_pieces(docs, spec, capacity, end_id, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    shown = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    items, placed, round_no = pieces.where(F.col("length") < capacity).select("rid", "length"), None, 0
    while True:
        packed, districts = pack_lengths(items, capacity, round_no, district)
        loose = F.col("filled") <= capacity * (1 - LOOSE)
        opened = packed.where(loose)
        ends = districts == 1 or not opened.take(1)
        if round_no and not ends:
            was, now = (x.where("offset = 0").count() for x in (items, packed))
            ends = was - now <= was * SAVING
        kept = packed if ends else packed.where(~loose)
        placed = kept if placed is None else placed.union(kept)
        if ends:
            break
        items, round_no = opened, round_no + 1
    short = pieces.drop("length").join(placed.select("rid", "length", "sequence_id", "offset"), "rid").select(shown)
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("rid"), "offset": F.lit(0).cast("long")}).select(shown)
    return short.union(full)

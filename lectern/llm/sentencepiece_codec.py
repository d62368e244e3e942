"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The search runs over the boundaries of a text in order. A boundary keeps the last piece of the best segmentation up to it
and a backpointer to the boundary before that piece. For a unigram model the piece with the best score wins. For a BPE
model a piece may follow another only if merging the two texts together would still leave that pair; so just one piece can
end at a boundary, and ids are equal to what the merges give.

The pieces that may end at a boundary come from an automaton over all pieces (Aho and Corasick, 1975), one step a character. Its state
is the longest run of characters that a piece to come may have begun with, so paths go on from that many
boundaries only, the model's longest piece at most. Whenever the backpointer paths of all of them run through one boundary,
the ids before it are committed and forgotten.

Where no piece goes on past a space mark, the words of a step's texts are searched side by side, a character of each at a
time over numpy arrays, with a window of boundaries for each word; words that were met before are remembered.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType
from sentencepiece import sentencepiece_model_pb2 as model_format

from lectern.llm.texts import arrow, steps

SPACE = "▁"
_INPUT = "__codec_input"
_FREE = -1
#: Words that a worker remembers, twice over, at about 250 bytes each; longer ones than MEMO_CHARS are searched each time.
MEMO, MEMO_CHARS = 1 << 18, 48


class Recent(dict):
    """Remembers the last size to twice size keys that were looked up anew."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size, self.before = size, {}

    def older(self, key: object) -> object:
        """The value of a key that is no longer at hand, None if it is forgotten."""
        found = self.before.get(key)
        return found if found is None else self.keep(key, found)

    def keep(self, key: object, value: object) -> object:
        if len(self) >= self.size:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encodes and decodes with the pieces of a model (its serialised file)."""

    def __init__(self, model: bytes, memo: int = MEMO):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte = {int(self.pieces[i][3:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown = sp.unk_id()
        self.silent = {i for i in range(size) if sp.is_control(i)}
        special = self.silent | set(self.byte_of) | {self.unknown}
        self.id = {self.pieces[i]: i for i in range(size) if i not in special and not sp.is_unused(i)}
        self.score = {i: sp.get_score(i) for i in self.id.values()}
        self.longest = max(map(len, self.id), default=1)
        spec = model_format.ModelProto.FromString(model)
        self.normalise, rules = sp.normalize, spec.normalizer_spec
        self.identity = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.bpe = spec.trainer_spec.model_type == spec.trainer_spec.BPE
        self.order = {p: -self.score[i] for p, i in self.id.items()}
        seen = Counter(self.order[p] for p in self.id if len(p) > 1)
        self.tied = {p for p in self.id if len(p) > 1 and seen[self.order[p]] > 1}
        self._automaton()
        self.plain = [self.pieces[i].replace(SPACE, " ") for i in range(size)]
        for i, b in self.byte_of.items():
            self.plain[i] = chr(b)
        for i in self.silent:
            self.plain[i] = ""
        self.plain[self.unknown] = " ⁇ "
        self.high = {i for i, b in self.byte_of.items() if b >= 0x80}
        self.split: dict[str, tuple[str, str] | None] = {}
        self.fits, self.memo = Recent(memo), Recent(memo)
        self.side_by_side = SideBySide(self) if self.bpe else None

    def _automaton(self) -> None:
        """By state: the next states, the state of the longest proper suffix, how many characters it stands for, and the pieces that end it."""
        self.moves: list[dict[str, int]] = [{}]
        self.suffix, self.depth, self.ends = [0], [0], [()]
        for piece, i in self.id.items():
            state = 0
            for ch in piece:
                after = self.moves[state].get(ch)
                if after is None:
                    after = self.moves[state][ch] = len(self.moves)
                    self.moves.append({})
                    self.suffix.append(0)
                    self.depth.append(self.depth[state] + 1)
                    self.ends.append(())
                state = after
            self.ends[state] = ((len(piece), i),)
        todo = deque(self.moves[0].values())
        while todo:  # parents come before their children, shorter suffixes before longer ones
            state = todo.popleft()
            self.ends[state] += self.ends[self.suffix[state]]
            for ch, after in self.moves[state].items():
                back = self.suffix[state]
                while back and ch not in self.moves[back]:
                    back = self.suffix[back]
                self.suffix[after] = self.moves[back].get(ch, 0)
                todo.append(after)
        self.known = len(self.moves)  # moves found later are kept up to as many again

    def _move(self, state: int, ch: str) -> int:
        """The next state where none is kept: by way of the suffixes."""
        back = self.suffix[state]
        while back and ch not in self.moves[back]:
            back = self.suffix[back]
        after = self.moves[back].get(ch, 0)
        if self.known:
            self.known -= 1
            self.moves[state][ch] = after
        return after

    # The order in which merges happen: better score first.
    def _merged(self, a: str, b: str) -> float | None:
        i = self.id.get(a + b)
        return None if i is None else self.score[i]

    def _direct(self, text: str) -> list[str]:
        """Symbols of a short text after all merges, best score first and leftmost among equals."""
        symbols = list(text)
        while len(symbols) > 1:
            best = max(((s, -k) for k in range(len(symbols) - 1) if (s := self._merged(symbols[k], symbols[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two symbols that the last merge of a piece joins; None for a single character."""
        found = self.split.get(piece, 0)
        if found == 0:
            symbols, last = list(piece), None
            while len(symbols) > 1:
                best = max(((s, -k) for k in range(len(symbols) - 1) if (s := self._merged(symbols[k], symbols[k + 1])) is not None), default=None)
                if best is None:
                    last = None
                    break
                k = -best[1]
                last = (symbols[k], symbols[k + 1])
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            found = self.split[piece] = last
        return found

    def _follows(self, a: str, b: str) -> bool:
        """Whether b may come right after a: merging their joined text leaves just this pair.

        The symbols that meet at the boundary are followed back in time, from the two pieces to single
        characters. The pair stands if none of those that met could have merged before one of its two was used up.
        """
        return self._direct(a + b) == [a, b] if a in self.tied or b in self.tied else self._stands(a, b)

    def _step(self, before: int, piece: int) -> bool:
        """Whether a piece is what merging its own text gives, and may come after the one before it; _FREE: after anything."""
        key = before << 20 | piece
        found = self.fits.older(key)
        if found is None:
            text = self.pieces[piece]
            made = len(text) == 1 or self._halves(text) is not None
            found = self.fits.keep(key, made and (before < 0 or self._follows(self.pieces[before], text)))
        return found

    def _stands(self, x: str, y: str) -> bool:
        order, end = self.order, float("inf")
        x_used = y_used = end
        while True:
            merge = order.get(x + y)
            if merge is not None and merge < x_used and merge <= y_used:
                return False
            x_made, y_made = order.get(x, -1) if len(x) > 1 else -1, order.get(y, -1) if len(y) > 1 else -1
            if x_made < 0 and y_made < 0:
                return True
            if x_made > y_made:
                x, x_used = self._halves(x)[1], x_made
            else:
                y, y_used = self._halves(y)[0], y_made

    def search(self, text: str) -> list[int]:
        """Ids of a normalised text; holds the boundaries from the last one committed."""
        moves, depth, ends, fits, step, most = self.moves, self.depth, self.ends, self.fits, self._step, 2 * self.longest
        best = self._best if not self.bpe else None
        ids: list[int] = []
        base = end = state = 0  # the boundary up to which ids are committed, where the lists begin
        last, back, total = [_FREE << 20], [0], [0.0]  # the piece that ends at a boundary, its length, the score so far
        for ch in text:
            end += 1
            after = moves[state].get(ch)
            state = self._move(state, ch) if after is None else after
            if best:
                size, piece = best(ends[state], total)
            else:
                for size, piece in ends[state]:
                    fit = fits.get(last[-size] | piece)
                    if fit or (fit is None and step(last[-size] >> 20, piece)):
                        break  # only one piece can end there
                else:
                    size, piece = 1, _FREE
            last.append(piece << 20)
            back.append(size)
            live = depth[state]
            if live < 2 or len(last) > most:
                keep = end if not live else end - 1 if live == 1 and size == 1 else self._meeting(back, end - live, end, base)
                if keep > base:
                    ids += self._back(text, last, back, keep, base)
                    keep, base = keep - base, keep
                    last, back, total = last[keep:], back[keep:], total[keep:]
        return ids + self._back(text, last, back, end, base)

    def _best(self, found: tuple[tuple[int, int], ...], total: list[float]) -> tuple[int, int]:
        """The piece with the best score of those that may end at the next boundary."""
        value, size, piece = total[-1] - 1e6, 1, _FREE
        for n, i in found:
            if total[-n] + self.score[i] > value:
                value, size, piece = total[-n] + self.score[i], n, i
        total.append(value)
        return size, piece

    def _meeting(self, back: list[int], low: int, end: int, base: int) -> int:
        """The latest boundary that the paths from all boundaries from low to end run through; back begins at base."""
        front = set(range(max(base, low), end + 1))
        while len(front) > 1:
            far = max(front)
            front.remove(far)
            front.add(far - back[far - base])
        return front.pop()

    def _back(self, text: str, last: list[int], back: list[int], end: int, base: int) -> list[int]:
        """The ids on the path from base to end."""
        out, at = [], end - base
        while at:
            piece, size = last[at] >> 20, back[at]
            if piece != _FREE:
                out.append(piece)
            else:
                out += self.unknown_ids(text[base + at - 1])[::-1]
            at -= size
        return out[::-1]

    def unknown_ids(self, ch: str) -> list[int]:
        """Ids of a character of no piece: its bytes, where the model has them."""
        return [self.byte[b] for b in ch.encode()] if self.byte else [self.unknown]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE) if self.identity else self.normalise(text)
        if not self.splits:
            return self.search(text)
        memo, ids = self.memo, []
        for word in _WORDS.findall(text):
            found = memo.get(word)
            if found is None:
                found = memo.older(word)
            if found is None:
                found = self.search(word)
                if len(word) <= MEMO_CHARS:
                    memo.keep(word, found)
            ids += found
        return ids

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; words that are not remembered are searched together."""
        if not (self.splits and self.bpe and self.identity):
            return [self.encode(x) for x in texts]
        split = [_WORDS.findall(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts]
        memo, known, new = self.memo, {}, []
        for word in set(chain.from_iterable(split)):
            found = memo.get(word)
            if found is None:
                found = memo.older(word)
            if found is None:
                new.append(word)
            else:
                known[word] = found
        for word, found in zip(new, self.side_by_side.search(new)):
            known[word] = found
            if len(word) <= MEMO_CHARS:
                memo.keep(word, found)
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, runs of byte ids as UTF-8, space marks as spaces; the one the encoder put first goes."""
        if self.high.isdisjoint(ids):
            return "".join(map(self.plain.__getitem__, ids)).removeprefix(" ")
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ").removeprefix(" ")


class Numbers:
    """A hash table from 64-bit numbers to small ones, looked up by arrays; it grows up to 2^most slots and is emptied when these are half full."""

    def __init__(self, bits: int, most: int):
        self.bits, self.most, self.count = bits, most, 0
        self.keys, self.values = np.full(1 << bits, _NONE), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for one that is not there."""
        slots, mask = self._slots(keys), (1 << self.bits) - 1
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], -1)
        todo = np.flatnonzero((there != keys) & (there != _NONE))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & mask
            there = self.keys[slots[todo]]
            out[todo] = np.where(there == keys[todo], self.values[slots[todo]], -1)
            todo = todo[(there != keys[todo]) & (there != _NONE)]
        return out

    def add(self, keys: np.ndarray, values: list[int]) -> None:
        """Put in keys that are not there yet."""
        if self.count + len(keys) > 1 << (self.bits - 1):
            held, wide = self.keys != _NONE, max(self.bits, (2 * (self.count + len(keys)) - 1).bit_length())
            old = (self.keys[held], self.values[held].tolist()) if wide <= self.most else (keys[:0], [])
            self.__init__(min(wide, self.most), self.most)
            if len(old[0]):
                self.add(*old)
        mask = (1 << self.bits) - 1
        for key, slot, value in zip(keys.tolist(), self._slots(keys).tolist(), values):
            while self.keys[slot] != _NONE:
                slot = (slot + 1) & mask
            self.keys[slot], self.values[slot] = key, value
            self.count += 1


_NONE = np.int64(-(1 << 62))


class SideBySide:
    """The search of a BPE codec over many texts at once, a lane each: every array step moves all lanes by one character.

    A lane's window is a ring of boundaries from the last one committed. A lane whose paths have not met within the
    ring is searched alone.
    """

    def __init__(self, codec: Codec, lanes: int = 1 << 12):
        self.codec, self.lanes = codec, lanes
        self.rows = 1 << (2 * codec.longest).bit_length()
        self.moves, self.fits = Numbers(14, 20), Numbers(14, 20)
        # By boundary, modulo rows: the last piece there, and its length
        self.last, self.back = np.zeros((self.rows, lanes), np.int64), np.zeros((self.rows, lanes), np.int64)
        self.early = 0  # commits before a text's end
        counts = np.array([len(x) for x in codec.ends])
        self.first = np.cumsum(counts) - counts
        self.many = counts
        self.size, self.piece = (np.array([x[k] for ends in codec.ends for x in ends], np.int64) for k in (0, 1))
        self.depth = np.array(codec.depth)

    def search(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; longer texts first, so that the lanes still running stand together."""
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        out: list[list[int]] = [[]] * len(texts)
        for at in range(0, len(order), self.lanes):
            part = order[at : at + self.lanes]
            for k, found in zip(part, self._lanes([texts[k] for k in part])):
                out[k] = found
        return out

    def _looked_up(self, table: Numbers, keys: np.ndarray, make) -> np.ndarray:
        found = table.find(keys)
        lost = np.flatnonzero(found < 0)
        if len(lost):
            new, back = np.unique(keys[lost], return_inverse=True)
            values = [int(make(key)) for key in new.tolist()]
            table.add(new, values)
            found[lost] = np.array(values, np.int32)[back]
        return found

    def _move(self, key: int) -> int:
        state, ch = key >> 21, chr(key & 0x1FFFFF)
        after = self.codec.moves[state].get(ch)
        return self.codec._move(state, ch) if after is None else after

    def _lanes(self, texts: list[str]) -> list[list[int]]:
        codec, n, ring = self.codec, len(texts), self.rows
        length = np.array([len(x) for x in texts])
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start = np.cumsum(length) - length
        running = np.searchsorted(-length, -np.arange(1, length[0] + 2), "right") if n else np.zeros(1, np.int64)  # lanes that have a character at each place
        last, back = self.last[:, :n], self.back[:, :n]
        last[0] = _FREE << 20
        state, base, alone = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        told: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def commit(lanes: np.ndarray, keep: np.ndarray) -> None:
            """Ids on the paths from keep back to the boundary committed before."""
            at, low = keep.copy(), base[lanes]
            base[lanes] = keep
            while len(lanes):
                pieces = last[at % ring, lanes] >> 20
                told.append((lanes, at, pieces))
                at = at - back[at % ring, lanes]
                more = at > low
                lanes, at, low = lanes[more], at[more], low[more]

        for end in range(1, int(length[0]) + 1 if n else 0):
            m = int(running[end - 1])
            state[:m] = self._looked_up(self.moves, state[:m] << 21 | chars[start[:m] + end - 1], self._move)
            now = state[:m]
            size, piece = np.ones(m, np.int64), np.full(m, _FREE, np.int64)
            todo, turn = np.flatnonzero(self.many[now] > 0), 0
            while len(todo):
                at = self.first[now[todo]] + turn
                sizes, pieces = self.size[at], self.piece[at]
                fit = self._looked_up(self.fits, last[(end - sizes) % ring, todo] | pieces, lambda key: codec._step(key >> 20, key & 0xFFFFF)) > 0
                size[todo[fit]], piece[todo[fit]] = sizes[fit], pieces[fit]
                turn += 1
                todo = todo[~fit]
                todo = todo[self.many[now[todo]] > turn]
            last[end % ring, :m], back[end % ring, :m] = piece << 20, size
            live, done = self.depth[now], length[:m] == end
            keep = np.where(done | (live == 0), end, np.where((live == 1) & (size == 1), end - 1, 0))
            met = np.flatnonzero((keep > base[:m]) & ~alone[:m])
            commit(met, keep[met])
            self.early += int((~done[met]).sum())
            alone[:m] |= ~done & (end - base[:m] >= ring - codec.longest)
        lane, place, piece = (np.concatenate([x[k] for x in told]) if told else np.zeros(0, np.int64) for k in range(3))
        order = np.lexsort((place, lane))
        ids, cuts = piece[order].tolist(), np.cumsum(np.bincount(lane, minlength=n)).tolist()
        found = [ids[a:b] for a, b in zip([0, *cuts], cuts)]
        for k in np.unique(lane[piece == _FREE]).tolist():  # characters of no piece
            ends = place[order[cuts[k] - len(found[k]) : cuts[k]]].tolist()
            found[k] = [i for at, x in zip(ends, found[k]) for i in ((x,) if x != _FREE else codec.unknown_ids(texts[k][at - 1]))]
        for k in np.flatnonzero(alone).tolist():
            found[k] = codec.search(texts[k])
        return found


_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@lru_cache(maxsize=2)
def _codec(model: bytes, memo: int = MEMO) -> Codec:
    """A Python worker keeps its codec from one task to the next."""
    return Codec(model, memo)


def _encode(model: Broadcast, memo: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, memo)
        kept = [c for c in schema.names if c not in ("n_tokens", "ids", "round_trip", "decoded")]
        for batch in batches:
            for step in steps(batch, _INPUT, 4 << 20):
                texts = [x or "" for x in step.column(_INPUT).to_pylist()]
                ids = codec.encode_all(texts)
                back = list(map(codec.decode, ids))
                same = [b == x.replace(SPACE, " ") for b, x in zip(back, texts)]
                more = {"decoded": back} if "decoded" in schema.names else {}
                yield arrow(schema, **{c: step.column(c) for c in kept}, n_tokens=list(map(len, ids)), ids=ids, round_trip=same, **more)

    return run


def encode_texts(docs: DataFrame, model: bytes, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False, memo: int = MEMO) -> DataFrame:
    """One row per row of docs: the kept columns, n_tokens, ids, and round_trip, whether decoding gives the text again.

    With decoded, what decoding gives is a column too, made in the same pass. memo bounds the words that a worker remembers.

    Null and empty texts have no ids. A space mark (U+2581) in a text decodes to a space, as in the library.
    Very long texts are one row each: the search holds a few boundaries more than the longest piece wherever paths meet, and their
    ids. Of pieces that could end at one place with equal scores the longest is taken. Repeated rows are encoded each; an
    empty table gives no rows; columns that are not kept are not read, and kept ones may not have the names of results.
    """
    if clash := {"n_tokens", "ids", "round_trip", "decoded"} & set(keep):
        raise ValueError(f"kept columns have the names of results: {sorted(clash)}")
    own = docs.select(*keep, F.col(text_col).cast("string").alias(_INPUT))
    out = own.select(*keep).schema.add("n_tokens", LongType()).add("ids", ArrayType(IntegerType())).add("round_trip", BooleanType())
    if decoded:
        out = out.add("decoded", StringType())
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return own.mapInArrow(_encode(sent, memo, to_arrow_schema(out)), out)


def _decode(model: Broadcast, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in batches:
            yield arrow(schema, **{c: batch.column(c) for c in schema.names if c != "text"}, text=[codec.decode([i for i in x or () if i is not None]) for x in batch.column(_INPUT).to_pylist()])

    return run


def decode_ids(encoded: DataFrame, model: bytes, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of encoded: the kept columns and text.

    Null and empty ids give the empty text, null ids inside a list too; long lists are one row each; repeated rows are decoded each; an empty table
    gives no rows; columns that are not kept are not read, and none of these may be called text.
    """
    if "text" in keep:
        raise ValueError("a kept column has the name of the result: text")
    own = encoded.select(*keep, F.col(ids_col).alias(_INPUT))
    out = own.select(*keep).schema.add("text", StringType())
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    return own.mapInArrow(_decode(sent, to_arrow_schema(out)), out)

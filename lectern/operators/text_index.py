"""A stored inverted table in blocks, for the best matches of a query without reading texts.

A row holds one token's places in the chunks of one block, and the largest number of its places in any of them. Blocks are made of
chunks of like length, a bounded number each, so a token of every chunk lies in many rows and long texts, which hold words often, are
found in few blocks. A query reads those largest numbers first: they bound what any chunk of a block can score. Blocks are
ranked in waves from the largest bound down, and a block whose bound is below the score of the last hit so far is never read.

The table is one of plain tokens and serves both analyzers: a vocabulary, a row for each distinct token, says which tokens have a stem.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.lexical import Clause, english_lexeme, lexemes_of, parse_query, rank_of_places, simple_tokens
from lectern.sources.scratch import stored

#: Chunks of a block, places in a folder of the table, and blocks that the first two waves rank at most; the third takes the rest.
BLOCK, SLOT_PLACES, WAVES = 1024, 1 << 24, (64, 4096, None)
#: Characters of a block, roughly: what one task turns into places at once. A text of more is a block of its own, or shares one.
BLOCK_CHARS = 8 << 20
#: Blocks that are told to a scan one by one.
TOLD = 64
#: Bytes of a token's place in a file, roughly; and bytes in a file of the table.
PLACE_BYTES, FILE_BYTES = 8, 128 << 20
#: Room that bounds leave for rounding of scores.
SLACK = 1e-6


def slot_of(token: Column, slots: int) -> Column:
    """The folder of a token; crc32 of its bytes, so that a query finds its folders without asking Spark."""
    return (F.crc32(token.cast("binary")) % slots).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """A written index: postings (slot, token, block, most, ids, places), words (slot, lexeme, token) and chunks (block, id)."""

    spark: SparkSession
    path: str
    slots: int
    id_type: str

    @cached_property
    def postings(self) -> DataFrame:
        return self._table("postings")

    @cached_property
    def words(self) -> DataFrame:
        return self._table("words")

    @cached_property
    def chunks(self) -> DataFrame:
        return self._table("chunks")

    def _table(self, name: str) -> DataFrame:
        columns = {
            "postings": f"token string, block long, most int, ids array<{self.id_type}>, places array<array<int>>, slot int",
            "words": "token string, lexeme string, slot int", "chunks": f"block long, id {self.id_type}",
        }
        return self.spark.read.schema(columns[name]).parquet(f"{self.path}/{name}")

    def _slots_of(self, words: list[str]) -> list[int]:
        return sorted({crc32(w.encode()) % self.slots for w in words})

    def tokens_of(self, lexemes: list[str]) -> dict[str, str]:
        """The tokens that have one of these stems, each with its stem; as many as a stem has endings."""
        words = self.words.where(F.col("slot").isin(self._slots_of(lexemes)) & F.col("lexeme").isin(lexemes))
        return {r["token"]: r["lexeme"] for r in words.select("token", "lexeme").collect()}

    def english_top(self, text: str, limit: int, allowed: DataFrame | None = None) -> DataFrame:
        """(id, text_score) of the best matches of a web-search query under the english analyzer, ties by id."""
        clauses = parse_query(text)
        tokens = self.tokens_of(lexemes_of(clauses)) if clauses else {}
        everywhere = any(not c.must for c in clauses)  # an alternative that only forbids: every chunk may match
        return self._top(tokens, lambda most: cover_bound(most, clauses), rank_of_places(clauses), limit, allowed, everywhere)

    def simple_top(self, text: str, limit: int, allowed: DataFrame | None = None) -> DataFrame:
        """The same under the simple analyzer: a tenth of one word's count; several words must all occur and score a tenth."""
        terms = list(dict.fromkeys(text.lower().split()))
        if len(text.split()) == 1:
            score = lambda found: _times(found, terms[0]).cast("double") * 0.1
            bound = lambda most: most[terms[0]].cast("double") * 0.1
        else:
            score = lambda found: F.when(F.size(found) == len(terms), F.lit(0.1))
            bound = lambda most: F.when(F.size(most) == len(terms), F.lit(0.1))
        return self._top({t: t for t in terms}, bound, score, limit, allowed)

    def count_top(self, terms: list[str], limit: int, allowed: DataFrame | None = None) -> DataFrame:
        """(id, text_score) of chunks that hold all terms, by how often they do."""
        terms = sorted(set(terms))
        held = lambda c: F.size(c) == len(terms)
        score = lambda found: F.when(held(found), sum((_times(found, t) for t in terms), F.lit(0)).cast("double"))
        bound = lambda most: F.when(held(most), sum((most[t] for t in terms), F.lit(0)).cast("double"))
        return self._top({t: t for t in terms}, bound, score, limit, allowed)

    def _top(self, tokens: dict[str, str], bound: Callable, score: Callable, limit: int, allowed: DataFrame | None, everywhere: bool = False) -> DataFrame:
        chunks = self.chunks
        if not tokens and not everywhere:
            return chunks.select("id", F.lit(0.0).alias("text_score")).where("false")
        lexeme = F.create_map(*[F.lit(x) for pair in tokens.items() for x in pair])[F.col("token")] if tokens else F.lit("")
        posted = self.postings.where(F.col("slot").isin(self._slots_of(list(tokens))) & F.col("token").isin(list(tokens))).withColumn("lexeme", lexeme)
        if everywhere:
            return best_of(self._scored(posted, score, chunks, allowed), limit)
        heads = posted.groupBy("block", "lexeme").agg(F.sum("most").alias("most")).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "most"))).alias("most"))
        bounds = heads.select("block", bound(F.col("most")).alias("bound")).where("bound is not null")
        hits, reached, least = [], None, None
        for wave in WAVES:
            rest = bounds if reached is None else bounds.where((F.col("bound") < reached[0]) | ((F.col("bound") == reached[0]) & (F.col("block") > reached[1])))
            if least is not None:
                rest = rest.where(F.col("bound") >= least * (1 - SLACK))
            if wave is not None:
                rows = rest.orderBy(F.desc("bound"), "block").limit(wave).collect()  # a wave at most
                if not rows:
                    break
                here = self._in_blocks(posted, [r["block"] for r in rows])
            else:
                here = posted.join(rest.select("block"), "block", "left_semi")
            best = best_of(self._scored(here, score, None, allowed), limit).collect()  # limit rows at most
            hits = sorted(hits + [tuple(r) for r in best], key=lambda x: (-x[1], x[0]))[:limit]
            if wave is None or len(rows) < wave:
                break
            if reached is None:
                bounds = stored(bounds, "bounds")
            reached = (rows[-1]["bound"], rows[-1]["block"])
            least = hits[-1][1] if len(hits) == limit else None
        return self.spark.createDataFrame(hits, f"id {self.id_type}, text_score double")

    def _in_blocks(self, posted: DataFrame, blocks: list[int]) -> DataFrame:
        """The rows of some blocks; a few are told to the scan."""
        if len(blocks) <= TOLD:
            return posted.where(F.col("block").isin(blocks))
        return posted.join(F.broadcast(self.spark.createDataFrame([(b,) for b in blocks], "block long")), "block", "left_semi")

    def _scored(self, posted: DataFrame, score: Callable, chunks: DataFrame | None, allowed: DataFrame | None) -> DataFrame:
        """Scores of the chunks in these rows; of all chunks where they are given."""
        rows = posted.select("lexeme", F.explode(F.arrays_zip("ids", "places")).alias("c")).select(F.col("c.ids").alias("id"), "lexeme", "c.places")
        if allowed is not None:
            rows, chunks = rows.join(allowed.select("id"), "id", "left_semi"), None if chunks is None else chunks.join(allowed.select("id"), "id", "left_semi")
        found = rows.groupBy("id", "lexeme").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places")).groupBy("id").agg(F.collect_list(F.struct("lexeme", "places")).alias("found"))
        if chunks is not None:
            found = chunks.select("id").join(found, "id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<lexeme:string,places:array<int>>>")))
        return found.select("id", score(F.col("found")).alias("text_score")).where("text_score is not null")


def _times(found: Column, term: str) -> Column:
    return F.coalesce(F.size(F.get(F.filter(found, lambda x: x["lexeme"] == term), F.lit(0))["places"]), F.lit(0))


def best_of(scored: DataFrame, limit: int) -> DataFrame:
    return scored.orderBy(F.desc("text_score"), "id").limit(limit)


def cover_bound(most: Column, clauses: list[Clause]) -> Column:
    """The largest cover density of any chunk in which no lexeme has more places than most says; null where none can match.

    A cover begins and ends at places of its own, and no two covers that share a place begin with the same term: so there are no more
    of them than terms times the places of the rarest, nor than places less the terms but one. Each adds a tenth at most.
    """
    bounds = []
    for c in clauses:
        times = [F.least(*[most[x] for x in phrase]) if len(phrase) > 1 else most[phrase[0]] for phrase in c.must]
        rarest = F.least(*times) if len(times) > 1 else times[0]
        covers = F.least(rarest * len(times), sum(times[1:], times[0]) - (len(times) - 1))
        there = [most[x].isNotNull() for phrase in c.must for x in phrase]
        held = there[0]
        for x in there[1:]:
            held = held & x
        bounds.append(F.when(held, covers.cast("double") * 0.1))
    return F.greatest(*bounds) if len(bounds) > 1 else bounds[0]


def build_text_index(chunks: DataFrame, text: Column, path: str, id_col: str = "id") -> TextIndex:
    """Index the tokens of every chunk's text. Null texts have no token; ids are unique."""
    spark = chunks.sparkSession
    rows = chunks.select(F.col(id_col).alias("id"), text.alias("text")).where("text is not null")
    level = F.floor(F.log2(F.length("text") + 1) * 4).cast("long")
    sizes = rows.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()  # some 130 levels at most
    chars = sum(r["chars"] for r in sizes)
    kind = rows.schema["id"].dataType.simpleString()
    slots, files = max(1, chars // 6 // SLOT_PLACES), max(1, chars // 6 * PLACE_BYTES // FILE_BYTES, min(spark.sparkContext.defaultParallelism, chars >> 20))
    parts = F.create_map(*[F.lit(x) for r in sizes for x in (r["level"], max(-(-r["n"] // BLOCK), -(-r["chars"] // BLOCK_CHARS)))])[level] if sizes else F.lit(1)
    blocked = rows.withColumn("block", F.shiftleft(level, 32) + F.pmod(F.xxhash64("id"), parts))
    # texts are shuffled, not their places: the chunks of a block meet in one task, and what leaves it is a row for each of their tokens
    tasks = max(1, chars // (4 * BLOCK_CHARS), min(spark.sparkContext.defaultParallelism, chars >> 20))
    met = blocked.repartition(tasks, "block").sortWithinPartitions("block").select("block", "id", simple_tokens(F.col("text")).alias("tokens"))
    held = met.groupBy("block").applyInArrow(_posted, f"token string, block long, most int, ids array<{kind}>, packed array<int>")
    # by ranges, so that a frequent token's blocks go to several tasks and files
    dealt = held.withColumn("slot", slot_of(F.col("token"), slots)).repartitionByRange(files, "slot", "token", "block")
    start = lambda k: F.element_at("packed", k)
    places = F.transform(F.sequence(F.lit(1), F.size("ids")), lambda k: F.slice("packed", start(k), start(k + 1) - start(k)))
    rows = dealt.sortWithinPartitions("slot", "token", "block").select("token", "block", "most", "ids", places.alias("places"), "slot")
    rows.write.partitionBy("slot").option("compression", "zstd").parquet(f"{path}/postings")
    blocked.select("block", "id").write.parquet(f"{path}/chunks")
    index = TextIndex(spark, path, slots, kind)
    words = index.postings.select("token").distinct().withColumn("lexeme", english_lexeme("token")).where("lexeme is not null")
    words.withColumn("slot", slot_of(F.col("lexeme"), slots)).repartitionByRange(max(1, slots // 8), "slot", "lexeme").sortWithinPartitions("slot", "lexeme").write.partitionBy("slot").parquet(f"{path}/words")
    return index


def _posted(chunks: pa.Table) -> pa.Table:
    """The places of every token in the chunks (block, id, tokens) of one block: a row for each token, its chunks in the order of their ids.

    packed holds where each chunk's places begin in it, from 1 on, where the last ones end, and the places.
    """
    chunks = chunks.sort_by("id")
    tokens = chunks.column("tokens").combine_chunks()
    sizes = np.asarray(tokens.value_lengths().fill_null(0))
    coded = tokens.flatten().dictionary_encode()
    code = np.asarray(coded.indices)
    row = np.repeat(np.asarray(chunks.column("id").combine_chunks().dictionary_encode().indices), sizes)
    place = np.arange(1, len(code) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    pair = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))[: len(code)])  # where a chunk's places of a token begin
    token = np.flatnonzero(np.append(True, np.diff(code[pair]) != 0)[: len(pair)])
    times = np.diff(np.append(pair, len(code)))
    ends, last = np.append(token, len(pair)), np.append(pair, len(code))  # of each token's chunks, and of each chunk's places
    ids = chunks.column("id").combine_chunks().unique().take(pa.array(row[pair]))
    heads = np.diff(ends) + 1  # of each token: where its chunks' places begin, and where they end
    sizes = np.diff(last[ends]) + heads
    begin = np.append(0, np.cumsum(sizes))
    of_head = np.repeat(np.arange(len(token)), heads)
    nth = np.arange(len(of_head)) - np.repeat(np.cumsum(heads) - heads, heads)
    packed = np.empty(begin[-1], np.int32)
    packed[begin[of_head] + nth] = last[ends[of_head] + nth] - last[ends[of_head]] + heads[of_head] + 1
    of_place = np.repeat(np.arange(len(token)), sizes - heads)
    packed[begin[of_place] + heads[of_place] + np.arange(len(code)) - last[ends[of_place]]] = place[order]
    most = np.maximum.reduceat(times, token) if len(token) else times
    block = pa.array(np.full(len(token), chunks.column("block")[0].as_py()), pa.int64())
    columns = [coded.dictionary.take(pa.array(code[pair][token])), block, pa.array(most, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(packed))]
    return pa.Table.from_arrays(columns, ["token", "block", "most", "ids", "packed"])

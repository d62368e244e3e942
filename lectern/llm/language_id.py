"""Language identification in two levels: the family first, then the languages within it.

Texts are turned into byte trigrams of their lower-cased letters. A linear machine for each family tells it from
all others; within the chosen family one-versus-one linear support vector machines tell its languages apart. A machine keeps
weights only of trigrams that its training texts hold, so a model grows in proportion to the families and with
the pairs inside a family, not with all pairs of languages. A text is scored by its distinct trigrams and their counts, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.llm.linear import fit_hinge, fit_sigmoid
from lectern.llm.quality import held_out
from lectern.llm.texts import arrow, schema_of, steps, with_text

DIMS = 1 << 16
UNKNOWN = "und"
# Families of languages by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "indo-aryan": "bn gu hi mr ne pa si ur".split(),
    "turkic": "az kk ky tr tt uz".split(),
    "uralic": "et fi hu".split(),
    "semitic": "am ar he mt".split(),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = regex.compile(r"\p{L}")
_KEPT = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def letters_of(text: str) -> bytes:
    """Lower-cased words of letters, each with one space before it, and one after the last; empty without any letter."""
    if _LETTER.search(text) is None:
        return b""
    return b" " + b" ".join(text.lower().encode().translate(_KEPT).split()) + b" "


def trigrams(letters: bytes) -> np.ndarray:
    b = np.frombuffer(letters, np.uint8).astype(np.uint32)
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)


Row = tuple[np.ndarray, np.ndarray]


def fit_machine(rows: list[Row], own: np.ndarray, other: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(trigrams, weights, slope, offset) of the machine that tells rows own from rows other; the curve takes mean margins to a probability."""
    found = [rows[i] for i in (*own, *other)]
    labels = np.repeat([1, -1], [len(own), len(other)])
    used = np.unique(np.concatenate([at for at, _ in found]))
    compact = [(np.searchsorted(used, at), values) for at, values in found]
    w = fit_hinge(compact, labels, len(used), c)
    means = np.array([w[at] @ values / max(values.sum(), 1e-9) for at, values in compact])
    scale = 1 / max(float(np.abs(means).mean()), 1e-9)
    a, b = fit_sigmoid(means * scale, labels)
    return used.astype(np.int32), w.astype(np.float32), a * scale, b


class Machines:
    """Machines between classes: one for each class against the rest, or one for each pair of classes."""

    def __init__(self, classes: list[str], duels: bool, fitted: list[tuple[np.ndarray, np.ndarray, float, float]]):
        self.classes, self.duels = classes, duels
        self.pairs = list(combinations(range(len(classes)), 2)) if duels else [(i, None) for i in range(len(classes))]
        self.used = np.unique(np.concatenate([f[0] for f in fitted])) if fitted else np.zeros(0, np.int32)
        self.weights = np.zeros((len(self.used), len(fitted)), np.float32)
        for k, (at, w, _, _) in enumerate(fitted):
            self.weights[np.searchsorted(self.used, at), k] = w
        self.slope, self.offset = (np.array([f[k] for f in fitted]) for k in (2, 3))

    def means(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Mean margin of a text's trigrams under each machine."""
        at = np.minimum(np.searchsorted(self.used, found), max(0, len(self.used) - 1))
        known = np.flatnonzero(self.used[at] == found) if len(self.used) else at[:0]
        total = np.zeros(self.weights.shape[1])
        for k in range(0, len(known), 4096):  # bounded memory for any number of machines
            part = known[k : k + 4096]
            total += counts[part].astype(np.float64) @ self.weights[at[part]]
        return total / counts.sum()

    def choose(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each row of mean margins, and how sure its least sure machine is; of equal classes the first in name.

        Of duels the class with most won is chosen, ties by the sum of probabilities.
        """
        n, k = len(means), len(self.classes)
        if k == 1:
            return np.zeros(n, np.int64), np.ones(n)
        p = 1 / (1 + np.exp(-np.clip(self.slope * means + self.offset, -30, 30)))
        if not self.duels:
            best = np.argmax(p, axis=1)
            return best, p[np.arange(n), best]
        won, total, sure = np.zeros((n, k)), np.zeros((n, k)), np.ones((n, k))
        for col, (i, j) in enumerate(self.pairs):
            won[:, i] += p[:, col] >= 0.5
            won[:, j] += p[:, col] < 0.5
            total[:, i] += p[:, col]
            total[:, j] += 1 - p[:, col]
            sure[:, i], sure[:, j] = np.minimum(sure[:, i], p[:, col]), np.minimum(sure[:, j], 1 - p[:, col])
        best = np.argmax(won + total / (k + 1), axis=1)
        return best, sure[np.arange(n), best]


def fit_here(rows: list[Row], tasks: list[tuple[np.ndarray, np.ndarray]]) -> list:
    return [fit_machine(rows, own, other) for own, other in tasks]


class LanguageModel:
    """Fitted on (sparse unit row, language) pairs; fit trains machines from rows and (own rows, other rows) of each."""

    def __init__(self, rows: list[Row], langs: list[str], fit=fit_here):
        lang, family = np.array(langs, object), np.array([family_of(x) for x in langs], object)
        families = sorted(set(family))
        groups = [sorted(set(lang[family == f])) for f in families]
        tasks = [(np.flatnonzero(family == f), np.flatnonzero(family != f)) for f in families] if len(families) > 1 else []
        cuts = [len(tasks)]
        for group in groups:
            tasks += [(np.flatnonzero(lang == x), np.flatnonzero(lang == y)) for x, y in combinations(group, 2)]
            cuts.append(len(tasks))
        fitted = fit(rows, tasks)
        self.families = Machines(families, False, fitted[: cuts[0]])
        self.within = [Machines(group, True, fitted[a:b]) for group, a, b in zip(groups, cuts, cuts[1:])]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language of each output of letters_of, and a score from 0 to 1."""
        names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        told = [i for i, x in enumerate(texts) if x]
        if not self.within or not told:
            return names.tolist(), score
        found = [np.unique(trigrams(texts[i]), return_counts=True) for i in told]
        family, sure = self.families.choose(np.array([self.families.means(*x) for x in found]))
        for f in np.unique(family):
            own, level = np.flatnonzero(family == f), self.within[f]
            lang, within = level.choose(np.array([level.means(*found[k]) for k in own]))
            at = np.array(told)[own]
            names[at], score[at] = np.array(level.classes, object)[lang], sure[own] * within
        return names.tolist(), score


def unit_row(letters: bytes) -> tuple[np.ndarray, np.ndarray]:
    found, counts = np.unique(trigrams(letters), return_counts=True)
    return found.astype(np.int32), counts / max(float(np.sqrt((counts.astype(float) ** 2).sum())), 1e-9)


def _rows(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                rows = [unit_row(x) if (x := letters_of(t or "")) else None for t in step.column("text").to_pylist()]
                kept = [i for i, r in enumerate(rows) if r]
                yield arrow(
                    schema, found=[rows[i][0].tobytes() for i in kept], counts=[rows[i][1].astype(np.float32).tobytes() for i in kept],
                    lang=step.column("lang").take(pa.array(kept, pa.int64())),
                )

    return run


def _fit(rows: Broadcast, tasks: Broadcast, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no in batch.column("id").to_pylist():
                at, w, a, b = fit_machine(rows.value, *tasks.value[no])
                yield arrow(schema, no=[no], used=[at.tobytes()], weights=[w.tobytes()], slope=[a], offset=[b])

    return run


def fit_in_tasks(spark: SparkSession):
    """A fit for LanguageModel that trains each machine in a Spark task of its own."""
    ddl = "no long, used binary, weights binary, slope double, offset double"

    def fit(rows: list[Row], tasks: list[tuple[np.ndarray, np.ndarray]]) -> list:
        if not tasks:
            return []
        sent = spark.sparkContext.broadcast(rows), spark.sparkContext.broadcast(tasks)
        found = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(_fit(*sent, schema_of(spark, ddl)), ddl).collect()
        return [(np.frombuffer(r["used"], np.int32), np.frombuffer(r["weights"], np.float32), r["slope"], r["offset"]) for r in sorted(found)]

    return fit


def train_language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500) -> LanguageModel:
    """Fit on rows that are not held out and have a language: about per_language of each, those whose id hashes lowest.

    Every language is learnt, however rare. The sample and the counts by language reach the driver, in proportion to
    the number of languages; rows are sorted, so the model does not depend on how files are split. Null ids count as the
    empty text; null texts and texts without a letter teach nothing; repeated rows teach as often as they occur; an
    empty table gives a model that tells nothing.
    """
    spark = docs.sparkSession
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], r["n"])]) if sizes else F.create_map().cast("map<string,bigint>")
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * F.try_element_at(share, F.col("lang")) < per_language * (1 << 20))
    out = "found binary, counts binary, lang string"
    rows = sorted(drawn.select("text", "lang").mapInArrow(_rows(schema_of(spark, out)), out).collect(), key=tuple)
    return LanguageModel([(np.frombuffer(r["found"], np.int32), np.frombuffer(r["counts"], np.float32).astype(float)) for r in rows], [r["lang"] for r in rows], fit_in_tasks(spark))


def _predict(model: Broadcast, schema: pa.Schema, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(with_text(batch, text_col), "text"):
                langs, score = model.value.predict([letters_of(x or "") for x in step.column("text").to_pylist()])
                yield arrow(schema, **{c: step.column(c) for c in schema.names if c not in ("lang_pred", "score")}, lang_pred=langs, score=score)

    return run


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (0 to 1); with carry, all of docs as the struct row too.

    Null texts and texts without a letter are und with score 0, as are all where nothing was learnt; very long texts
    are scored whole, by their distinct trigrams; of languages that are equally likely the first in name is chosen; repeated
    rows are judged each; an empty table gives no rows; other columns of docs, whatever their names, are not read.
    """
    text = F.struct("*").alias("row") if carry else F.col(text_col).cast("string").alias("text")
    own = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text)
    out = own.drop("text").select("*", F.lit("").alias("lang_pred"), F.lit(0.0).cast("double").alias("score")).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return own.mapInArrow(_predict(sent, to_arrow_schema(out), text_col), out)

"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts exactly the
substrings of that text.  A text is parsed greedily against each: the longest
match is a phrase, then the next begins.  The language that needs the fewest
phrases, each weighted by the logarithm of its reference length, wins.

Texts are seen as the UTF-8 bytes of their letters in lower case, with one
break for each run of other characters; so every letter of every script is
told apart.  The automata become one dense transition table.  Texts walk
through it in lockstep, one lane each, from first to last symbol; when fewer
than ``FEW`` lanes are left, what remains of each is walked alone.  Both ways
carry the state on, so a phrase is cut by nothing but the end of its text.

The reference is a bounded sample of the labelled rows, ``Sample`` gives the
bounds: for each language, texts of the preferred length with the smallest
hashes, and others only where a language has none of those.  No language is
left out.

Defined results: ``und`` with score 0 for a null text or one without a letter;
ties go to the language that sorts first; the score is ``1 - best / second``,
and 1 if only one language was learned.  Without labelled rows every text is
``und``.  Rows with a null language or identifier are never learned from.  An
empty table gives an empty table; only the named columns are read, so others
never clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, hash_share, slices, table

#: Lanes below which lockstep costs more than a walk of each.
FEW = 24
#: Symbols of a lane that are laid out at once.
BLOCK = 2048
#: The byte that stands for a break.
BREAK = 0x20
UNDETERMINED = "und"


@dataclass(frozen=True)
class Sample:
    """Bounds of the labelled sample, for each language but for ``all_chars``."""

    texts: int = 64
    #: Preferred length of a text.
    min_chars: int = 100
    max_chars: int = 4_000
    #: Texts of other lengths, where a language has none of the preferred.
    other_texts: int = 8
    total_chars: int = 32_768
    #: What all languages share, once they are so many; the least for each of them.
    all_chars: int = 1 << 20
    least_chars: int = 1_024


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in moves[p]:
            moves[p][s] = new
            p = link[p]
        if p >= 0:
            q = moves[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(s) == q:
                    moves[p][s] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


class Model:
    """Automata of all languages as one table; built from the reference texts in each worker."""

    def __init__(self, references: dict[str, str]):
        self.languages = sorted(references)
        self.lower = np.full(0x110000, BREAK, dtype=np.uint32)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                self.lower[point] = ord(c.lower()[0])
        texts = {k: self.symbols(v) for k, v in references.items()}
        # Columns of the table: bytes that occur; all others act alike, as no automaton has a move for them.
        present = np.unique(np.concatenate([np.array([BREAK], dtype=np.uint8), *texts.values()]))
        self.width = len(present) + 1
        self.column = np.full(256, len(present), dtype=np.uint8 if len(present) < 256 else np.uint16)
        self.column[present] = np.arange(len(present))
        tables, base, self.roots, self.weight = [], 0, [], []
        for name in self.languages:
            symbols = self.column[texts[name]].tolist()
            moves = suffix_automaton(symbols)
            self.roots.append(base * self.width)
            self.weight.append(math.log2(max(2, len(symbols))))
            # A move is twice the first cell of the next state's row.  Where there is none a phrase ends and the
            # symbol starts the next: the odd bit counts it.
            start = np.full(self.width, base * self.width << 1 | 1, dtype=np.int64)
            for s, to in moves[0].items():
                start[s] = (base + to) * self.width << 1 | 1
            own = np.tile(start, (len(moves), 1))
            for i, row in enumerate(moves[1:], 1):
                own[i, list(row)] = [(base + to) * self.width << 1 for to in row.values()]
            tables.append(own if own.max() >= 1 << 31 else own.astype(np.int32))
            base += len(moves)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, dtype=np.int32)

    def symbols(self, text: str) -> np.ndarray:
        """Bytes of the letters of a text, each run of breaks once."""
        points = self.lower[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        keep = np.ones(len(points), dtype=bool)
        keep[1:] = (points[1:] != BREAK) | (points[:-1] != BREAK)
        return np.frombuffer(points[keep].tobytes().decode("utf-32-le", "replace").encode(), dtype=np.uint8)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (row) for each language (column)."""
        total = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        if not self.languages:
            return total
        order = np.argsort([-len(x) for x in texts], kind="stable")
        sizes = np.array([len(texts[i]) for i in order], dtype=np.int64)
        roots = np.array(self.roots, dtype=self.table.dtype)[:, None]
        state = np.repeat(roots, len(texts), axis=1)
        count = np.zeros(state.shape, dtype=np.int64)
        at = 0
        while (n := int(np.count_nonzero(sizes > at))) >= FEW:
            stop = min(at + BLOCK, int(sizes[FEW - 1]))
            lanes = np.zeros((stop - at, n), dtype=self.column.dtype)
            for lane, i in enumerate(order[:n]):
                part = texts[i][at:stop]
                lanes[: len(part), lane] = self.column[part]
            active = np.searchsorted(-sizes, -np.arange(at, stop), side="left")
            for row, k in zip(lanes, active, strict=True):
                move = self.table[state[:, :k] + row[:k]]
                count[:, :k] += move & 1
                state[:, :k] = move >> 1
            at = stop
        cells = memoryview(self.table)
        for lane in range(n):
            rest = self.column[texts[order[lane]][at:]].tolist()
            for k in range(len(self.languages)):
                now, phrases = int(state[k, lane]), 0
                for s in rest:
                    move = cells[now + s]
                    phrases += move & 1
                    now = move >> 1
                count[k, lane] += phrases
        total[order] = count.T
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        seen = [self.symbols(x or "") for x in texts]
        cost = self.phrases(seen) * np.array(self.weight or [])
        names, scores = [], []
        for row, own in zip(cost, seen, strict=True):
            if not len(row) or not (len(own) > 1 or (len(own) and own[0] != BREAK)):
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best = int(np.argmin(row))
            rest = np.delete(row, best)
            names.append(self.languages[best])
            scores.append(float(1 - row[best] / rest.min()) if len(rest) else 1.0)
        return names, scores


def held_out(id_column: Column) -> Column:
    """Rows that are never learned from: ``crc32`` of the identifier as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(df: DataFrame, sample: Sample = Sample(), id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> dict[str, str]:
    """Reference text of each language: a sample whose size the bounds fix, drawn over all labelled rows."""
    rows = df.select(df[id_column].alias("id"), df[text_column].alias("text"), df[label_column].alias("label"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.char_length("text") > 0) & ~held_out(F.col("id")))
    rows = rows.withColumn("other", ~F.char_length("text").between(sample.min_chars, sample.max_chars))
    counts = {(r.label, r.other): r["count"] for r in rows.groupBy("label", "other").count().collect()}
    wanted = {(x, other): sample.other_texts if other else sample.texts for x, other in counts if not other or (x, False) not in counts}
    if not wanted:
        return {}
    # A share of each label's rows by hash first, so that the ranking sees few rows at any size.
    shares = [(x, other, min(1.0, 4 * n / counts[x, other]), n) for (x, other), n in wanted.items()]
    shares = df.sparkSession.createDataFrame(shares, T.StructType([T.StructField("label", df.schema[label_column].dataType), *T._parse_datatype_string("other boolean, share double, n int").fields]))
    rows = rows.join(F.broadcast(shares), ["label", "other"]).where(hash_share(F.xxhash64("id"), F.col("share")))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", "text"))
    room = max(sample.least_chars, min(sample.total_chars, sample.all_chars // len(wanted)))
    found: dict[str, list[tuple[object, str]]] = {}
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= F.col("n"))
    for r in rows.select("label", "id", F.substring("text", 1, room).alias("text")).collect():
        found.setdefault(r.label, []).append((r.id, r.text))
    references = {}
    for label, texts in found.items():
        size, kept = 0, []
        for _, text in sorted(set(texts)):
            if size + len(text) <= room or not kept:
                kept.append(text)
                size += len(text) + 1
        references[label] = "\n".join(kept)
    return references


def identify(spark: SparkSession, df: DataFrame, references: dict[str, str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Identifier, ``lang_pred`` and ``score`` of each row."""
    shared = spark.sparkContext.broadcast(references)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in slices(batches, "text"):
            model = model or _model(shared.value)
            names, scores = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("id", df.schema[id_column].dataType), *T._parse_datatype_string("lang_pred string, score double").fields])
    return bounded_batches(df).select(df[id_column].alias("id"), df[text_column].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


_MODELS: dict[int, Model] = {}


def _model(references: dict[str, str]) -> Model:
    """The model of these references, built once a worker process."""
    key = hash(tuple(sorted(references.items())))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(references)
    return _MODELS[key]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op3_cross_parsing``: the language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify(spark, docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

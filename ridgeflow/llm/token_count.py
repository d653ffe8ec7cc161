"""Token counts by heap and linked list.

A text is cut where no vocabulary piece can reach across, and each unit is
merged on its own: a heap holds the adjacent pairs that form a piece, the
lowest rank (leftmost on ties) is popped and its two symbols become one in a
doubly linked list, until the heap is empty.  The count is the initial symbols
minus the merges; no identifier is made.  A character outside the vocabulary
counts its UTF-8 bytes (byte fallback).

Defined results: a null or empty text has 0 bytes and 0 tokens.  Special
strings inside a text are ordinary text.  An empty table gives an empty table,
repeated rows repeated results; only the named columns are read, so others
never clash.  A worker's memory is bounded by the longest text and by
``CACHE`` remembered units.  A model that normalises, adds pieces or merges
otherwise than is done here is refused.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bounded_batches, lengths, slices, table

#: Remembered units in each of two generations, and characters of each at most.
CACHE, CACHE_CHARS = 250_000, 48
#: Texts on which a model must agree with this way of counting.
_PROBES = ("", " ", "a", " a  b ", "Ab c.\n\nde\t!", "<s> </s> <unk> <0x41>", "é ﬁ ½ \u3000x\u00a0y", "\u4f60\u597d \U0001f600", "aa" * 9, "\u2581x \x07")
SPACE = "▁"


class PieceCounter:
    """Counts tokens as a sentencepiece BPE model with byte fallback gives them."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank) or any("\n" in p for p in self.pairs):
            raise ValueError("pieces reach across blanks or line ends; cut elsewhere")
        self._units = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
        self._young: dict[str, int] = {}
        self._old: dict[str, int] = {}
        if any(self.count(x) != len(model.encode(x)) for x in _PROBES):
            raise ValueError("the model counts otherwise than by merges of unchanged text with one blank before it")

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        young, old, total = self._young, self._old, 0
        for unit in self._units.findall(SPACE + text.replace(" ", SPACE)):
            n = young.get(unit)
            if n is None:
                n = old.get(unit)
                if n is None:
                    n = self._unit(unit)
                if len(unit) <= CACHE_CHARS:
                    if len(young) >= CACHE:
                        self._young, self._old = {}, young
                        young, old = self._young, self._old
                    young[unit] = n
            total += n
        return total

    def forget(self) -> None:
        """Give back what was remembered: a worker process outlives its task."""
        self._young, self._old = {}, {}

    def _unit(self, unit: str) -> int:
        if len(unit) > 1 and unit[-2:] not in self.pairs:  # a sentence mark, most often
            head = unit[:-1]
            n = self._young.get(head)
            return (self.merged(head) if n is None else n) + self.merged(unit[-1])
        return self.merged(unit)

    def merged(self, unit: str) -> int:
        """Initial symbols minus merges."""
        rank, n = self.rank.get, len(unit)
        count = n if all(c in self.rank for c in unit) else sum(1 if c in self.rank else len(c.encode()) for c in unit)
        symbols: list[str | None] = list(unit)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(unit[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left, j = symbols[i], following[i]
            if left is None or j >= n or len(left) + len(symbols[j]) != size:
                continue  # one of its symbols has been merged meanwhile
            whole = left + symbols[j]
            symbols[i], symbols[j] = whole, None
            count -= 1
            k = following[i] = following[j]
            if k < n:
                before[k] = i
                size = len(whole) + len(symbols[k])
                if (r := rank(whole + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, size))
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] + whole)) is not None:
                heapq.heappush(heap, (r, h, len(symbols[h]) + len(whole)))
        return count


@lru_cache(maxsize=2)
def counter(model_path: str) -> PieceCounter:
    """One counter for each worker process."""
    return PieceCounter(model_path)


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Identifier, UTF-8 bytes, tokens and whether they exceed ``limit``, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        count = own.count
        for batch in slices(batches, "text"):
            tokens = [count(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths(batch.column(1)), pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )
        own.forget()

    schema = T.StructType([T.StructField("id", df.schema[id_column].dataType), *T._parse_datatype_string("n_bytes long, n_tokens long, over_limit boolean").fields])
    return bounded_batches(df).select(df[id_column].alias("id"), df[text_column].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def query(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """``op7_token_count``: token counts of all documents."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), model_path or public_tokenizers.path("piece_bpe_32k.model"))

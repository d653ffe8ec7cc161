"""BPE encoding and decoding by tree concatenation.

Text is cut at ASCII blanks and by the tokenizer's own normaliser and
pre-tokeniser.  A stretch that they leave whole is encoded as a tree: leaves
of ``LEAF`` symbols are merged alone, then neighbours are joined level by
level.  A join re-encodes a window around the seam, and the window grows until
its first token is one that the left side has at the same place and its last
token one that the right side has.  Then every adjacent pair of the result
occurs in a valid encoding, which for rank-ordered merges makes the whole
valid, and the valid encoding is unique.

A blank-separated word of ``Pieces.word`` bytes or more is encoded in parallel:
its stretches are cut into pieces of ``Pieces.symbols`` symbols, every piece is
a row of its own that any task may encode, and the task that puts the word
together re-encodes only the windows around the joins.  No part of the library
encodes; its normaliser and pre-tokeniser are used.

Defined results: null counts as empty and has no token.  Strings of added
tokens inside a text become those tokens, as the library has it.  An empty
table gives an empty table, repeated rows repeated results.  ``encode`` and
``digest`` read the named columns only; ``encode_onto`` keeps all columns, and
one whose name a result takes goes on as ``<name>_input``.  A file whose steps
are others than those that are followed here is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, scratch, slices, table

#: Symbols that are merged at once, without a join.
LEAF = 12
#: Symbols on either side of a seam that the first window takes.
WINDOW = 3
#: Remembered words in each of two generations, and bytes of each at most.
CACHE, CACHE_BYTES = 180_000, 48
_NEVER = 1 << 60
#: Fixed value: the pattern of the pre-tokeniser; a plain word is one or two of its matches.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(rb"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")

Word = tuple[int, bytes, str]  #: token count, identifiers as bytes, decoded form
Token = tuple[int, int]  #: identifier, symbols covered


@dataclass(frozen=True)
class Pieces:
    """Bytes of a word that is encoded in parallel, and symbols of each of its pieces."""

    word: int = 1 << 16
    symbols: int = 1 << 13


class TreeBpe:
    """Encodes and decodes as a ``tokenizers`` BPE file with byte alphabet and end-of-word suffix does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model = config["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or config["decoder"] or config["post_processor"]:
            raise ValueError("not a plain BPE file without decoder")
        steps = [x["type"] for x in (config["normalizer"] or {}).get("normalizers", [])]
        cuts = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"] or cuts[0]["behavior"] != "Removed" or cuts[0]["pattern"] != {"Regex": _PATTERN} or cuts[1]["add_prefix_space"]:
            raise ValueError("not NFC, blanks and lower case, then a split without blanks into bytes")
        added = config["added_tokens"]
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] or len(x["content"].split()) != 1 for x in added):
            raise ValueError("added tokens with conditions or blanks are not supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        self._vocab: dict[str, int] = model["vocab"]
        if any(c + end not in self._vocab for c in pre_tokenizers.ByteLevel.alphabet() for end in ("", self.suffix)):
            raise ValueError("the vocabulary lacks bytes")
        self.added = {x["content"]: x["id"] for x in added}
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self._marks = tuple({x["content"][:2].encode() for x in added})
        self.tokens = {i: x for x, i in library.get_vocab(with_added_tokens=True).items()}
        self._normalize = library.normalizer.normalize_str
        self._split = library.pre_tokenizer.pre_tokenize_str
        # Merges by the numbers of both sides, the token that each makes, and symbols of each token (with the suffix).
        self._wide = max(self._vocab.values()) + 1
        self._rank: dict[int, int] = {self._vocab[a] * self._wide + self._vocab[b]: i for i, (a, b) in enumerate(model["merges"])}
        self._made = [self._vocab[a + b] for a, b in model["merges"]]
        self._size = {i: len(x) for x, i in self._vocab.items()}
        self._young: dict[bytes, bytes] = {}  #: identifiers of words, little-endian 32-bit
        self._old: dict[bytes, bytes] = {}

    # -- one stretch that nothing splits

    def _merged(self, symbols: list[str] | str) -> list[int]:
        """Identifiers of symbols, merging the lowest rank first, the leftmost on ties."""
        vocab, rank, wide = self._vocab, self._rank.get, self._wide
        parts = [vocab[x] for x in symbols]
        ranks = [rank(x * wide + y, _NEVER) for x, y in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != _NEVER:
            at = ranks.index(best)
            parts[at] = new = self._made[best]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] * wide + new, _NEVER)
            if at < len(ranks):
                ranks[at] = rank(new * wide + parts[at + 1], _NEVER)
        return parts

    def _leaf(self, symbols: list[str]) -> list[Token]:
        """Tokens of symbols that are merged at once."""
        parts = self._merged(symbols)
        sizes = [self._size[p] for p in parts]
        sizes[-1] += len(symbols) - sum(sizes)  # less the suffix
        return list(zip(parts, sizes, strict=True))

    def _join(self, symbols: list[str], start: int, middle: int, stop: int, left: list, right: list) -> list:
        """The tokens of symbols[start:stop], of which the two sides are known."""
        reach = WINDOW
        while True:
            low, i = middle, len(left)
            while i and middle - low < reach:
                i -= 1
                low -= left[i][1]
            high, j = middle, 0
            while j < len(right) and high - middle < reach:
                high += right[j][1]
                j += 1
            window = self._leaf(symbols[low:high]) if high - low <= 4 * LEAF else self._tree(symbols, low, high)
            if (low == start or window[0] == left[i]) and (high == stop or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            if low == start and high == stop:
                return window
            reach *= 2

    def joined(self, symbols: list[str], nodes: list[tuple[int, int, list[Token]]]) -> list[Token]:
        """Tokens of symbols of which ``(start, stop, tokens)`` are known side by side: joins of neighbours, level by level."""
        while len(nodes) > 1:
            pairs = [(a, c, self._join(symbols, a, b, c, x, y)) for (a, b, x), (_, c, y) in zip(nodes[::2], nodes[1::2], strict=False)]
            nodes = pairs + nodes[len(pairs) * 2 :]
        return nodes[0][2]

    def _tree(self, symbols: list[str], start: int, stop: int) -> list[Token]:
        """Tokens of symbols[start:stop]: leaves first, then their joins."""
        if stop - start <= LEAF:
            return self._leaf(symbols[start:stop])
        edges = [*range(start, stop, LEAF), stop]
        return self.joined(symbols, [(a, b, self._leaf(symbols[a:b])) for a, b in zip(edges, edges[1:], strict=False)])

    def symbols(self, stretch: str) -> list[str]:
        symbols = list(stretch)
        symbols[-1] += self.suffix
        return symbols

    # -- texts

    def stretches(self, word: bytes) -> Iterator[int | str]:
        """What a blank-separated word is cut into: identifiers of added tokens, and stretches in the byte alphabet."""
        text = word.decode()
        pieces = self._added.split(text) if self._added and any(m in word for m in self._marks) else [text]
        for piece in pieces:
            if piece in self.added:
                yield self.added[piece]
            elif piece:
                for part, _ in self._split(piece.lower() if piece.isascii() else self._normalize(piece)):
                    yield part

    def _word(self, word: bytes) -> bytes:
        """Identifiers of a word that isn't remembered."""
        plain = _PLAIN.fullmatch(word)
        if plain and not (plain[2] and any(m in word for m in self._marks)):
            stem = plain[1].lower()
            if plain[2]:
                return self._known(stem) + self._known(plain[2])
            return self._known(stem) if stem != word else self._stretch(word.decode())
        return b"".join(part.to_bytes(4, "little") if isinstance(part, int) else self._stretch(part) for part in self.stretches(word))

    def _known(self, stretch: bytes) -> bytes:
        """Identifiers of an ASCII stretch, which is also a word of its own."""
        ids = self._young.get(stretch) or self._old.get(stretch)
        if ids is None:
            ids = self._stretch(stretch.decode())
            self._remember(stretch, ids)
        return ids

    def _stretch(self, text: str) -> bytes:
        symbols = self.symbols(text)
        ids = self._merged(symbols) if len(symbols) <= LEAF else [i for i, _ in self._tree(symbols, 0, len(symbols))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _remember(self, word: bytes, ids: bytes) -> None:
        if len(word) <= CACHE_BYTES:
            if len(self._young) >= CACHE:
                self._young, self._old = {}, self._young
            self._young[word] = ids

    def packed(self, ids: bytes) -> Word:
        return len(ids) // 4, ids, self.decode(np.frombuffer(ids, dtype="<u4").tolist())

    def word_ids(self, text: str | None, known: list[bytes] | None = None, long_word: int = 0) -> list[bytes]:
        """Identifiers of each blank-separated word; ``known`` has those of words of ``long_word`` bytes or more."""
        found, young, old, rest = [], self._young, self._old, iter(known or ())
        for word in (text or "").encode().split():
            x = young.get(word)
            if x is None:
                if known is not None and len(word) >= long_word:
                    found.append(next(rest))
                    continue
                x = old.get(word)
                if x is None:
                    x = self._word(word)
                self._remember(word, x)
                young, old = self._young, self._old
            found.append(x)
        return found

    def words(self, text: str | None) -> list[Word]:
        """Each blank-separated word encoded."""
        return [self.packed(x) for x in self.word_ids(text)]

    def forget(self) -> None:
        """Give back what was remembered: a worker process outlives its task."""
        self._young, self._old = {}, {}

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(self.word_ids(text)), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """As a file without decoder has it: the tokens, special ones included, with blanks between."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str) -> TreeBpe:
    """One coder for each worker process."""
    return TreeBpe(path)


_KNOWN = "array<binary>"


def _with_long_words(df: DataFrame, where: int, path: str, pieces: Pieces) -> DataFrame:
    """``df`` and a column ``known``: the identifiers of the long words of its text column, which is number ``where``; null if it has none.

    The pieces of all long words are rows that are spread over all tasks.  Equal
    texts are encoded once.
    """
    text = df[df.columns[where]]
    blank = r" \t\n\x0B\f\r"
    is_long = F.coalesce((F.octet_length(text) >= pieces.word) & text.rlike(f"(?<![^{blank}])[^{blank}]{{{max(1, pieces.word // 4)}}}"), F.lit(False))
    texts = df.where(is_long).select(F.sha2(text, 256).alias("key"), text.alias("text"))
    if texts.isEmpty():
        return df.withColumn("known", F.lit(None).cast(_KNOWN))
    schema = "key string, word long, stretch long, piece long, last boolean, symbols string, ids binary, sizes binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in slices(batches, "text"):
            for key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n, word in enumerate(w for w in value.encode().split() if len(w) >= pieces.word):
                    for k, part in enumerate(own.stretches(word)):
                        if isinstance(part, int):
                            yield _rows([(key, n, k, 0, True, "", np.uint32(part).tobytes(), b"")], names)
                            continue
                        for i in range(0, len(part), pieces.symbols):
                            yield _rows([(key, n, k, i, i + pieces.symbols >= len(part), part[i : i + pieces.symbols], b"", b"")], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for r in batch.to_pylist():
                if r["symbols"]:
                    symbols = own.symbols(r["symbols"]) if r["last"] else list(r["symbols"])
                    tokens = np.array(own._tree(symbols, 0, len(symbols)), dtype=np.uint32)
                    r |= {"ids": tokens[:, 0].tobytes(), "sizes": tokens[:, 1].tobytes()}
                yield _rows([tuple(r.values())], names)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for key, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words: dict[int, dict[int, list[dict]]] = {}
                for r in rows:
                    words.setdefault(r["word"], {}).setdefault(r["stretch"], []).append(r)
                known = []
                for _, stretches in sorted(words.items()):
                    ids: list[np.ndarray] = []
                    for _, parts in sorted(stretches.items()):
                        if not parts[0]["symbols"]:
                            ids.append(np.frombuffer(parts[0]["ids"], dtype=np.uint32))
                            continue
                        symbols = own.symbols("".join(r["symbols"] for r in parts))
                        nodes = [(r["piece"], r["piece"] + len(r["symbols"]), [*zip(*(np.frombuffer(r[c], dtype=np.uint32).tolist() for c in ("ids", "sizes")), strict=True)]) for r in parts]
                        ids.append(np.array([i for i, _ in own.joined(symbols, nodes)], dtype=np.uint32))
                    known.append(np.concatenate(ids).astype("<u4").tobytes() if ids else b"")
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([known], pa.list_(pa.binary()))], ["key", "known"])

    rows = texts.dropDuplicates(["key"]).mapInArrow(cut, schema)
    rows = rows.repartition("key", "word", "stretch", "piece").mapInArrow(merge, schema)
    rows = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*names[1:]))).alias("rows")).mapInArrow(together, f"key string, known {_KNOWN}")
    where_to = scratch(df.sparkSession, "long-words")
    rows.write.parquet(where_to)
    known = df.sparkSession.read.parquet(where_to).withColumnRenamed("key", "ridgeflow_text_key")
    return df.where(~is_long).withColumn("known", F.lit(None).cast(_KNOWN)).union(
        df.where(is_long).join(known, F.sha2(text, 256) == F.col("ridgeflow_text_key"), "left").drop("ridgeflow_text_key")
    )


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _mapped(df: DataFrame, where: int, path: str, pieces: Pieces, more: str, make: Callable[[TreeBpe, list[bytes]], list[pa.Array]]) -> DataFrame:
    """``df`` and the columns ``more`` that ``make`` gives for the identifiers of each text."""
    names = [f"c{i}" for i in range(len(df.columns))]
    extra = T._parse_datatype_string(more).fields
    source = _with_long_words(df.toDF(*names), where, path, pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in slices(batches, f"c{where}"):
            known = batch.column(len(names)).to_pylist()
            found = [b"".join(own.word_ids(x, k, pieces.word)) for x, k in zip(batch.column(where).to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *make(own, found)], [*names, *(f.name for f in extra)])
        own.forget()

    fields = [T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields, strict=True)]
    return bounded_batches(source).mapInArrow(run, T.StructType([*fields, *extra]))


def _counts(found: list[bytes]) -> pa.Array:
    return pa.array([len(x) // 4 for x in found], pa.int64())


def _lists(found: list[bytes]) -> pa.ListArray:
    starts = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(found), dtype="<u4").astype(np.int32)))


def _decoded(own: TreeBpe, found: list[bytes]) -> Iterator[str]:
    """The decoded form of each text."""
    return (own.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in found)


def _sums(values: Iterable[bytes]) -> pa.Array:
    return pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())


def encode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", pieces: Pieces = Pieces()) -> DataFrame:
    """Identifier, ``n_tokens``, ``ids`` (little-endian 32-bit, binary) and ``decoded`` for each row."""

    def make(own: TreeBpe, found: list[bytes]) -> list[pa.Array]:
        return [_counts(found), pa.array(found, pa.binary()), pa.array(_decoded(own, found), pa.string())]

    out = _mapped(df.select(df[id_column], df[text_column]), 1, path, pieces, "n_tokens long, ids binary, decoded string", make)
    return out.drop("c1").withColumnRenamed("c0", id_column)


def digest(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", pieces: Pieces = Pieces()) -> DataFrame:
    """As ``encode``, with SHA-256 of identifiers and decoded text in place of both."""

    def make(own: TreeBpe, found: list[bytes]) -> list[pa.Array]:
        return [_counts(found), _sums(found), _sums(x.encode() for x in _decoded(own, found))]

    out = _mapped(df.select(df[id_column], df[text_column]), 1, path, pieces, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
    return out.drop("c1").withColumnRenamed("c0", id_column)


def encode_onto(df: DataFrame, path: str, text_column: str = "text", pieces: Pieces = Pieces()) -> DataFrame:
    """All rows and columns of ``df`` with ``n_tokens``, ``token_ids`` (integers) and ``decoded_sha256``."""
    more = "n_tokens long, token_ids array<int>, decoded_sha256 string"
    results = [x.split()[0] for x in more.split(", ")]
    kept: list[str] = []
    for name in df.columns:
        while name.lower() in results or name.lower() in (x.lower() for x in kept):
            name += "_input"
        kept.append(name)

    def make(own: TreeBpe, found: list[bytes]) -> list[pa.Array]:
        return [_counts(found), _lists(found), _sums(x.encode() for x in _decoded(own, found))]

    return _mapped(df, df.columns.index(text_column), path, pieces, more, make).toDF(*kept, *results)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """``op4_tree_bpe``: token counts and digests of all documents."""
    return digest(table(spark, sf_dir, "documents"), path or default_path())

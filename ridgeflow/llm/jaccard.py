"""Jaccard self-join on word n-gram sets with token-combination prefixes.

A document's tokens are its distinct word shingles in one global order: rare
tokens first, frequent ones after, by hash within both.  A linked pair misses
at most ``floor(size * (100 - t) / 100)`` tokens of either side, so it is
enough to look at a prefix: rare tokens are indexed alone, frequent tokens
fall into classes in which every pair of tokens is indexed, and the prefix is
extended until even a linked partner cannot miss all of its signatures (a
class with m prefix tokens counts m - 1).  Candidates that share a signature
must also pass the size filter and a parity sketch, an exact lower bound of
the symmetric difference, inside the join.  What passes is verified on whole
texts.

Equal token sets are one node; the smallest identifier stands for it, so
copies never become pairs.  Nodes are first compared with a few leaders of each
signature; components form; then only pairs from different components are
compared.  No link between different sets is lost
for the components, and a family of near copies isn't expanded into its pairs.

Which tokens are frequent is decided by a count over all documents, in cells
of a table of fixed size; one bit for each cell is broadcast, whatever the
input.  It affects speed alone: both sides of a pair see the same bits.

Defined results: a text without words or null is linked with nothing and is
its own component; fewer words than a shingle are one token.  Identifiers are
integers; rows that share one are judged each by its own text, rows without
one are linked with nothing and have a null component.  A component is named by
its smallest identifier.  An empty table gives an empty table.  Only the named
columns are read, so others never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, bounded_batches, mix, release, remove, scratch, slices, table
from .components import connected_components

#: A token is frequent if those of its cell are in more lists than this.
FREQUENT = 24
#: Cells of the table of frequent tokens, a power of two (16 MB of bits).
FREQUENT_CELLS = 1 << 27
#: Bytes of text whose tokens are counted before they are sent on.
COUNT_BYTES = 8 << 20
#: Nodes of a signature that all others of it are compared with first.
LEADERS = 4
#: Signatures before its own that a row of the second round knows of its node.
EARLIER = 8
#: Bits of the table of shared signatures, a power of two (16 MB).
SIGNATURE_BITS = 1 << 27
#: Up to so many identifiers (8 bytes each) a filter is broadcast; beyond, it is a shuffled join.
MAX_BROADCAST_IDS = 1_000_000
_SINGLE, _PAIR, _SHORT = (np.uint64(x) for x in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35, 0x27D4EB2F165667C5))
_N1, _N2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_SIGNATURE = "sig long, n1 long, n2 long, size int, s0 long, s1 long, s2 long, s3 long"


@dataclass(frozen=True)
class Sets:
    """The distinct tokens of some texts, by text and ascending hash."""

    token: np.ndarray
    text_of: np.ndarray
    first: np.ndarray
    size: np.ndarray
    rank: np.ndarray


def token_sets(texts: pa.Array, width: int = 3) -> Sets:
    """Distinct shingles of ``width`` words, A to Z in lower case; fewer words are one shingle."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    at, keys = words.windows(hashes, width)
    owner = words.text_of[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        begin = words.first_word[short]
        key = mix(hashes[begin] ^ _SHORT)
        for j in range(1, width - 1):
            more = words.counts[short] > j
            key[more] = mix(key[more] * _N2 + hashes[begin[more] + j])
        keys, owner = np.concatenate((keys, key)), np.concatenate((owner, short))
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    first = np.searchsorted(owner, np.arange(words.n_texts + 1))
    return Sets(keys, owner, first, np.diff(first), np.arange(len(keys)) - first[owner])


def _group_sums(sets: Sets, values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total[sets.first[1:]] - total[sets.first[:-1]]


def node_ids(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    return (
        mix(_group_sums(sets, mix(sets.token ^ _N1))).view(np.int64),
        mix(_group_sums(sets, mix(sets.token * _N2 + _N1))).view(np.int64),
    )


def parity(sets: Sets) -> np.ndarray:
    """256 bits a set: whether the tokens in each of 256 hash classes are odd in number."""
    n = len(sets.size)
    cells = sets.text_of * 256 + (sets.token & np.uint64(255)).astype(np.int64)
    odd = (np.bincount(cells, minlength=n * 256) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, 256), axis=1).view(np.int64)


def sketches(sets: Sets) -> list[bytes]:
    """For each set a parity sketch of a power of two of bits, 256 at least and no fewer than tokens."""
    found = []
    for i, j in zip(sets.first, sets.first[1:], strict=False):
        bits = 1 << max(8, int(j - i - 1).bit_length())
        cells = (sets.token[i:j] & np.uint64(bits - 1)).astype(np.int64)
        found.append(np.packbits((np.bincount(cells, minlength=bits) & 1).astype(np.uint8)).tobytes())
    return found


def sketch_distance(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference; the longer sketch is folded to the other's length."""
    x, y = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def most_different(m: int, n: int, percent: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return m + n - 2 * -(-percent * (m + n) // (100 + percent))


def _levels(size: int, percent: int) -> range:
    """Size classes, by powers of two, of all possible partners."""
    low, high = -(-size * percent // 100), size * 100 // percent
    return range(max(low, 1).bit_length(), high.bit_length() + 1)


def prefix_signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of one set (ascending hashes); ``frequent`` flags its tokens."""
    size = len(tokens)
    need = size * (100 - percent) // 100 + 1
    rare, often = tokens[~frequent], tokens[frequent]
    found = [mix(rare[:need] ^ _SINGLE)]
    if len(rare) < need:
        for level in _levels(size, percent):
            classes = max(1, (1 << (level - 1)) // 20)
            kind = (mix(often + np.uint64(level)) % np.uint64(classes)).astype(np.int64)
            order = np.argsort(kind, kind="stable")
            again = np.zeros(len(often), dtype=bool)
            again[order[1:]] = kind[order][1:] == kind[order][:-1]
            enough = np.searchsorted(np.cumsum(again), need - len(rare)) + 1
            head, kind = often[:enough], kind[:enough]
            order = np.argsort(kind, kind="stable")
            head, kind = head[order], kind[order]
            shift = 1
            while shift < len(head):
                same = np.flatnonzero(kind[shift:] == kind[:-shift])
                if not len(same):
                    break
                found.append(mix(head[same] * _PAIR + mix(head[same + shift]) + np.uint64(level)))
                shift += 1
    return np.unique(np.concatenate(found))


def _is_set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values hit a set bit of a table with a power of two of bits."""
    cell = values & np.uint64(64 * len(bits) - 1)
    return (bits[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) > 0


def no_bits() -> np.ndarray:
    """A table in which no bit is set."""
    return np.zeros(1, dtype=np.uint64)


def signatures(sets: Sets, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the text of each."""
    need = sets.size * (100 - percent) // 100 + 1
    looked = np.flatnonzero(sets.rank < (2 * need + 16)[sets.text_of])
    rare = looked[~_is_set(frequent, sets.token[looked])]
    of = sets.text_of[rare]
    n_rare = np.bincount(of, minlength=len(sets.size))
    place = np.arange(len(rare)) - np.searchsorted(of, of)
    easy = n_rare >= need
    chosen = easy[of] & (place < need[of])
    sig, text = [mix(sets.token[rare[chosen]] ^ _SINGLE)], [of[chosen]]
    for i in np.flatnonzero(~easy & (sets.size > 1)):
        tokens = sets.token[sets.first[i] : sets.first[i + 1]]
        own = prefix_signatures(tokens, _is_set(frequent, tokens), percent)
        sig.append(own)
        text.append(np.full(len(own), i))
    return np.concatenate(sig), np.concatenate(text)


class JaccardJoin:
    """Components of the documents under ``100 * intersection >= percent * union`` of their shingles of ``width`` words."""

    def __init__(self, spark: SparkSession, df: DataFrame, percent: int = 90, id_column: str = "doc_id", text_column: str = "text", width: int = 3):
        self.spark, self.percent, self.width = spark, percent, width
        self._paths: dict[str, str] = {}
        self._several: DataFrame | None = None  #: identifiers of several nodes, if there are any
        self.source = bounded_batches(df).select(df[id_column].cast("long").alias("id"), df[text_column].alias("text"))

    def _kept(self, df: DataFrame, label: str) -> DataFrame:
        path = self._paths[label] = scratch(self.spark, label)
        df.write.parquet(path)
        del df
        release(self.spark)
        return self.spark.read.parquet(path)

    def _drop(self, *labels: str) -> None:
        """Scratch tables that are no longer read."""
        for label in labels:
            remove(self.spark, self._paths.pop(label))

    def nodes(self) -> DataFrame:
        """``(id, n1, n2, size)`` of every row."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                sets = token_sets(batch.column(1), width)
                n1, n2 = node_ids(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n1), pa.array(n2), pa.array(sets.size.astype(np.int64))], ["id", "n1", "n2", "size"])

        return self.source.mapInArrow(run, "id long, n1 long, n2 long, size long")

    def _bits(self, cells: DataFrame, size: int) -> np.ndarray:
        """A table of ``size`` bits in which those of ``cells(cell)`` are set: at most ``size / 64`` rows come to the driver.

        They are written first: Spark keeps the shuffle files of a plan that was collected.
        """
        words = cells.select(F.shiftright("cell", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(cell & 63 AS int))").alias("bit"))
        words = self._kept(words.groupBy("word").agg(F.bit_or("bit").alias("bit")), "bits").toArrow()
        self._drop("bits")
        bits = np.zeros(size // 64, dtype=np.uint64)
        bits[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
        return bits if words.num_rows else no_bits()

    def frequent_tokens(self) -> np.ndarray:
        """Bits of the cells whose tokens are at the front of many sets: a count over all rows."""
        percent, width, cells, least = self.percent, self.width, FREQUENT_CELLS, FREQUENT

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", COUNT_BYTES):
                fronts = []
                for piece in slices(iter([batch]), "text"):
                    sets = token_sets(piece.column(1), width)
                    need = sets.size * (100 - percent) // 100 + 1
                    front = sets.token[sets.rank < (need + need // 2 + 16)[sets.text_of]]
                    fronts.append((front & np.uint64(cells - 1)).astype(np.int32))
                cell, n = np.unique(np.concatenate(fronts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int32))], ["cell", "n"])

        counts = self.source.mapInArrow(run, "cell int, n int").groupBy("cell").agg(F.sum("n").alias("n"))
        return self._bits(counts.where(F.col("n") > least).select("cell"), cells)

    def _emitted(self, shared: Broadcast, slim: bool) -> DataFrame:
        """Signatures of all rows; ``shared`` has the frequent tokens and the bits of the signatures to emit."""
        percent, width = self.percent, self.width
        names = [x.split()[0] for x in _SIGNATURE.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            frequent, bits = shared.value
            for batch in slices(batches, "text"):
                sets = token_sets(batch.column(1), width)
                sig, text = signatures(sets, frequent, percent)
                n1, n2 = node_ids(sets)
                if slim:
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(n1[text])], names[:2])
                    continue
                hit = np.flatnonzero(_is_set(bits, sig))
                text = text[hit]
                columns = [n1, n2, sets.size.astype(np.int32), *parity(sets).T]
                yield pa.RecordBatch.from_arrays([pa.array(sig[hit].view(np.int64)), *(pa.array(np.ascontiguousarray(c)[text]) for c in columns)], names)

        return self.source.mapInArrow(run, _SIGNATURE.split(", n2")[0] if slim else _SIGNATURE)

    def index(self) -> DataFrame:
        """The signatures that two nodes or more have, once a node.

        A first pass finds the shared ones and keeps one bit for each in a
        table of fixed size; the second emits what hits a bit.  A wrong hit
        costs a row, no hit is missed.
        """
        context, frequent = self.spark.sparkContext, self.frequent_tokens()
        shared = self._shared(context.broadcast((frequent, None)))
        return self._emitted(context.broadcast((frequent, shared)), False).distinct()

    def _shared(self, frequent: Broadcast) -> np.ndarray:
        """Bits of the signatures that two nodes or more have."""
        found = self._emitted(frequent, True).groupBy("sig").agg(F.min("n1").alias("low"), F.max("n1").alias("high")).where("low <> high")
        return self._bits(found.select(F.col("sig").bitwiseAND(F.lit(SIGNATURE_BITS - 1)).alias("cell")), SIGNATURE_BITS)

    def _alike(self, a: str, b: str) -> str:
        """Size filter and sketch filter of two aliases as SQL."""
        t = self.percent
        sums = f"({a}.size + {b}.size)"
        differ = " + ".join(f"bit_count({a}.s{i} ^ {b}.s{i})" for i in range(4))
        return f"100 * least({a}.size, {b}.size) >= {t} * greatest({a}.size, {b}.size) AND {differ} <= {sums} - 2 * (({t} * {sums} + {99 + t}) div {100 + t})"

    def crossing(self, rows: DataFrame) -> DataFrame:
        """``(a1, a2, b1, b2)``: the candidates from different components among ``rows`` of the index with ``label`` and ``earlier``.

        Nodes that share a signature often share hundreds.  ``earlier`` has the last few signatures of the node before a
        row's own: if both sides have one of them, the pair has met there.  Its smallest signature never drops it.
        """
        met = f"a.sig = b.sig AND a.label <> b.label AND (a.n1 < b.n1 OR (a.n1 = b.n1 AND a.n2 < b.n2)) AND {self._alike('a', 'b')} AND NOT arrays_overlap(a.earlier, b.earlier)"
        return rows.alias("a").join(rows.alias("b"), F.expr(met)).selectExpr("a.n1 AS a1", "a.n2 AS a2", "b.n1 AS b1", "b.n2 AS b2")

    def _of_pairs(self, pairs: DataFrame, columns: str, make) -> DataFrame:
        """``(id, n1, n2)`` and the ``columns`` that ``make(sets)`` gives, of the nodes in ``pairs``."""
        ids = pairs.selectExpr("a AS id", "a1 AS n1", "a2 AS n2").union(pairs.select("b", "b1", "b2")).distinct()
        ids = self._kept(ids, "ids")
        wanted = ids.select("id").distinct()
        wanted = F.broadcast(wanted) if ids.count() <= MAX_BROADCAST_IDS else wanted
        width = self.width
        names = ["id", "n1", "n2", *(x.split()[0] for x in columns.split(", "))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                sets = token_sets(batch.column(1), width)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, node_ids(sets)), *make(sets)], names)

        found = self.source.join(wanted, "id", "left_semi").mapInArrow(run, f"id long, n1 long, n2 long, {columns}")
        return self._kept(found.join(ids, ["id", "n1", "n2"], "left_semi").dropDuplicates(["id", "n1", "n2"]), "of_pairs")

    def _filtered(self, pairs: DataFrame, columns: str, make, test, label: str) -> DataFrame:
        """The pairs for which ``test`` holds on the columns of both sides."""
        own = self._of_pairs(pairs, columns, make)
        keys, more = ["a", "a1", "a2", "b", "b1", "b2"], own.columns[3:]
        left = own.toDF("a", "a1", "a2", *(f"x_{c}" for c in more))
        right = own.toDF("b", "b1", "b2", *(f"y_{c}" for c in more))
        both = pairs.join(right, ["b", "b1", "b2"]).join(left, ["a", "a1", "a2"])
        both = both.select(*keys, *(f"{side}_{c}" for c in more for side in "xy"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [test(*row) for row in zip(*batch.columns[len(keys) :], strict=True)]
                yield batch.select(list(range(len(keys)))).filter(pa.array(keep, pa.bool_()))

        found = self._kept(both.mapInArrow(run, ", ".join(f"{k} long" for k in keys)), label)
        self._drop("ids", "of_pairs")
        return found

    def _vertices(self, df: DataFrame, id_column: str, n1: str, n2: str, name: str) -> DataFrame:
        """``df`` with the vertex of a node: its identifier, or a negative hash if several nodes have that one."""
        if self._several is None:
            return df.withColumn(name, F.col(id_column))
        own = F.when(F.col("ridgeflow_several").isNull(), F.col(id_column)).otherwise(-F.shiftrightunsigned(F.xxhash64(id_column, n1, n2), 1) - 1)
        return df.join(self._several.toDF("ridgeflow_several"), F.col(id_column) == F.col("ridgeflow_several"), "left").withColumn(name, own).drop("ridgeflow_several")

    def _verified(self, pairs: DataFrame, reps: DataFrame, label: str) -> DataFrame:
        """The linked ones of ``pairs(a1, a2, b1, b2)`` as ``(a, b)`` vertices.

        A sketch of about a bit for each token leaves few pairs that aren't
        linked; only for those that pass are the token sets brought together.
        """
        percent = self.percent
        pairs = pairs.join(reps.select("n1", "n2", "rep").toDF("a1", "a2", "a"), ["a1", "a2"]).join(reps.select("n1", "n2", "rep").toDF("b1", "b2", "b"), ["b1", "b2"])
        pairs = self._kept(pairs.select("a", "a1", "a2", "b", "b1", "b2"), "pairs")

        def sketched(sets: Sets) -> list[pa.Array]:
            return [pa.array(sets.size), pa.array(sketches(sets), pa.binary())]

        def packed(sets: Sets) -> list[pa.Array]:
            return [pa.array([sets.token[i:j].tobytes() for i, j in zip(sets.first, sets.first[1:], strict=False)], pa.binary())]

        def near(nx: pa.Scalar, ny: pa.Scalar, x: pa.Scalar, y: pa.Scalar) -> bool:
            return sketch_distance(x.as_py(), y.as_py()) <= most_different(nx.as_py(), ny.as_py(), percent)

        def linked(x: pa.Scalar, y: pa.Scalar) -> bool:
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
            return 100 * both >= percent * (len(x) + len(y) - both)

        close = self._filtered(pairs, "size long, sketch binary", sketched, near, "close")
        links = self._filtered(close, "tokens binary", packed, linked, label)
        links = self._vertices(self._vertices(links, "a", "a1", "a2", "va"), "b", "b1", "b2", "vb").select(F.col("va").alias("a"), F.col("vb").alias("b"))
        self._drop("pairs", "close")
        return links

    def components(self) -> DataFrame:
        """``(id, n_shingles, component)`` of every row."""
        return self.classes().select("id", F.col("size").alias("n_shingles"), F.coalesce("component.id", "id").alias("component"))

    def classes(self) -> DataFrame:
        """``(id, n1, n2, size, component)`` of every row; ``component(id, n1, n2)`` is the smallest node of its component, null without words or identifier."""
        spark = self.spark
        nodes = self._kept(self.nodes(), "nodes")
        reps = nodes.where("size > 0 AND id IS NOT NULL").groupBy("n1", "n2").agg(F.min("id").alias("rep"))
        reps = self._kept(reps, "reps")
        several = self._kept(reps.groupBy("rep").count().where("count > 1").select("rep"), "several")
        self._several = None if several.isEmpty() else several
        reps = self._vertices(reps, "rep", "n1", "n2", "v")
        index = self._kept(self.index(), "index")

        # Round one: every node against a few nodes of each of its signatures, drawn by hash.  The signatures of a
        # family of near copies draw different ones, so most of its core is found to be one component.
        row = "n1, n2, size, s0, s1, s2, s3"
        drawn = [F.expr(f"min(struct(xxhash64({i}, sig, n1, n2) AS h, {row}))").alias(f"x{i}") for i in range(LEADERS)]
        leaders = index.groupBy("sig").agg(*drawn, F.count("*").alias("n")).where("n > 1")
        leaders = leaders.select("sig", F.explode(F.array_distinct(F.array(*(F.expr(f"struct({', '.join(f'x{i}.{c}' for c in row.split(', '))})") for i in range(LEADERS))))).alias("x")).select("sig", "x.*")
        near = leaders.alias("a").join(index.alias("b"), F.expr(f"a.sig = b.sig AND (a.n1 <> b.n1 OR a.n2 <> b.n2) AND {self._alike('a', 'b')}"))
        order = "a.n1 < b.n1 OR (a.n1 = b.n1 AND a.n2 < b.n2)"
        first = near.selectExpr(*(f"IF({order}, a.{x}, b.{x}) AS a{i}" for i, x in ((1, "n1"), (2, "n2"))), *(f"IF({order}, b.{x}, a.{x}) AS b{i}" for i, x in ((1, "n1"), (2, "n2")))).distinct()
        first = self._kept(first, "first")
        links = self._verified(first, reps, "links")
        labels = connected_components(spark, links)

        # Round two: the other pairs that share a signature, if they are in different components.  A signature all
        # of whose nodes are in one component has none, however many they are.
        named = reps.join(labels, reps["v"] == labels["vertex"], "left").select("n1", "n2", F.coalesce("component", "v").alias("label"))
        mixed = index.select("sig", "n1", "n2").join(named, ["n1", "n2"]).groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor("n1").alias("x1"), F.bit_xor("n2").alias("x2"), F.count("*").alias("n"))
        # Signatures of the same nodes (their number and 128 bits that stand for them) lead to the same pairs: one is enough.
        mixed = self._kept(mixed.where("low <> high").groupBy("x1", "x2", "n").agg(F.min("sig").alias("sig")).select("sig"), "mixed")
        few = mixed.count() <= MAX_BROADCAST_IDS
        rows = index.join(F.broadcast(mixed) if few else mixed, "sig", "left_semi").join(named, ["n1", "n2"])
        rows = self._kept(rows.withColumn("earlier", F.collect_list("sig").over(Window.partitionBy("n1", "n2").orderBy("sig").rowsBetween(-EARLIER, -1))), "mixed_rows")
        self._drop("index", "mixed")
        second = self.crossing(rows).distinct().join(first, ["a1", "a2", "b1", "b2"], "left_anti")
        more = self._verified(second, reps, "more")
        self._drop("mixed_rows", "first")
        labels = connected_components(spark, links.union(more)) if not more.isEmpty() else labels

        of_node = reps.join(labels, reps["v"] == labels["vertex"], "left").select("n1", "n2", "rep", F.coalesce("component", "v").alias("class"))
        node = F.struct(F.col("rep").alias("id"), "n1", "n2")
        # The smallest node names a component; a node that is linked with none names itself, whatever their number.
        names = of_node.join(labels.select(F.col("component").alias("class")).distinct(), "class", "left_semi")
        names = names.groupBy("class").agg(F.min(node).alias("component"))
        of_node = of_node.join(names, "class", "left").select("n1", "n2", F.coalesce("component", node).alias("component"))
        alone = F.expr("size = 0 OR id IS NULL")
        out = nodes.where(~alone).join(of_node, ["n1", "n2"]).select("id", "n1", "n2", "size", "component")
        out = out.union(nodes.where(alone).withColumn("component", F.lit(None).cast(out.schema["component"].dataType)))
        out = self._kept(out, "classes")
        self._drop("nodes", "reps", "several", "links", "more")
        return out


def deduplicate(spark: SparkSession, df: DataFrame, percent: int = 90, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """The rows of ``df``, with all columns, of which one of each component stays: one with the smallest identifier.

    Rows that share an identifier are judged each by its own text; of those
    that share identifier and shingles one stays.  Rows without an identifier
    or without words all stay.
    """
    join = JaccardJoin(spark, df, percent, id_column, text_column, width)
    path = scratch(spark, "kept-ids")
    found = join.classes().where("id IS NOT NULL")
    found.select("id", "n1", "n2", (F.col("size") == 0).alias("bare"), F.expr("component IS NULL OR (component.id = id AND component.n1 = n1 AND component.n2 = n2)").alias("kept")).write.parquet(path)
    rows = spark.read.parquet(path)
    ids = rows.groupBy("id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    # Almost all identifiers have one row, and decide alone.
    ids = join._kept(ids.where("kept").select("id", "n"), "kept-once")
    own = df[id_column].cast("long")

    def of(wanted: DataFrame) -> DataFrame:
        small = wanted.count() <= MAX_BROADCAST_IDS
        wanted = wanted.select(F.col("id").alias("ridgeflow_kept_id"))
        return df.join(F.broadcast(wanted) if small else wanted, own == F.col("ridgeflow_kept_id"), "left_semi")

    kept = of(ids.where("n = 1")).union(df.where(df[id_column].isNull()))
    again = ids.where("n > 1")
    if again.isEmpty():
        return kept
    # Several rows of one identifier: each has its set looked up, repeated ones stay once.
    names = [f"c{i}" for i in range(len(df.columns))]
    where, who = df.columns.index(text_column), df.columns.index(id_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{where}"):
            sets = token_sets(batch.column(where), width)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, node_ids(sets)), pa.array(sets.size == 0)], [*names, "n1", "n2", "bare"])

    fields = [T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields, strict=True)]
    several = bounded_batches(of(again)).toDF(*names).mapInArrow(run, T.StructType([*fields, *T._parse_datatype_string("n1 long, n2 long, bare boolean").fields]))
    bare = several.where("bare").select(*names)
    filled = several.where("NOT bare").dropDuplicates([f"c{who}", "n1", "n2"])
    chosen = rows.where("kept AND NOT bare").select(F.col("id").alias("ridgeflow_id"), F.col("n1").alias("m1"), F.col("n2").alias("m2"))
    filled = filled.join(chosen, (filled[f"c{who}"].cast("long") == F.col("ridgeflow_id")) & (F.col("n1") == F.col("m1")) & (F.col("n2") == F.col("m2")), "left_semi")
    return kept.union(bare.toDF(*df.columns)).union(filled.select(*names).toDF(*df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8_jaccard_join``: the component of every document at 90 percent of three-word shingles."""
    found = JaccardJoin(spark, table(spark, sf_dir, "documents")).components()
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n)),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.v = s.doc_id) AS component_id FROM s
"""

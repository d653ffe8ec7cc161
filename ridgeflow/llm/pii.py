"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans.  Every other stretch that could be personal data
(long numbers, spelled-out addresses) becomes a candidate.  Base spans and
candidates of a text are the nodes of a conditional random field with the
labels none, email, ip, card and phone; all other tokens can only be none, so
they are constants of it and left out.  Neighbours in the text are joined by
chain edges, and a node is joined by skip edges to the nearest earlier node
with the same characters (digits, or address without decoration) and to that
with the same last digits, however far away.  Loopy message passing on that
graph makes labels agree across the document; a candidate whose most likely
label is a kind, with probability ``MIN_PROBABILITY``, is added.  Base spans
always stay.

All weights are learned here, by the pseudo-likelihood of a sample of texts of
bounded size whose base spans serve as labels.  To every text its base spans
are appended once more, written as a candidate would be (without plus sign,
with other separators, spelled out), and labelled as what they repeat; numbers
that are none are appended twice.  So the skip potentials are fitted to what
repeated values have in common, not set.  With no sample every candidate stays
none.

Defined results: a null text is empty and has no span.  Spans count code
points, the end exclusive.  All scans are linear in the text.  An empty table gives an empty table, repeated rows
repeated results.  ``detect`` reads only the named columns; ``redact`` keeps
all columns whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, hash_share, slices, table

KINDS = ("email", "ip", "card", "phone")
#: Texts of the training sample, and code points of each at most.
SAMPLE_TEXTS, SAMPLE_CHARS = 2_000, 20_000
MIN_PROBABILITY = 0.5
#: Code points between neighbours that a chain edge joins.
CHAIN_GAP = 40
#: Rounds of message passing at most, and the change at which it ends.
ROUNDS, TOLERANCE = 20, 1e-4

#: The base patterns.  That of an address starts at its "@", that of an ip is applied to dotted runs.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Every match of the last three lies in one such stretch, or begins with the signs before it.
_ZONE = re.compile(r"[0-9][\x20().0-9+-]*")
_SIGNS = " ().+-"
_LONG_NUMBER = re.compile(r"[0-9]{13,}")
_AT = re.compile(r"[(\[]at[)\]]\x20?", re.IGNORECASE)
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]+)+", re.IGNORECASE)
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: Words before a number that speak for a kind.
_CUES = (re.compile(r"mail|contact"), re.compile(r"\bip\b|host|server|addr"), re.compile(r"card|visa|credit"), re.compile(r"tel|phone|call|fax|mobil"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i & 1:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


@dataclass(slots=True)
class Node:
    start: int
    end: int
    kind: int  #: 1 to 4 for a base span, 0 for a candidate
    digits: str
    key: str
    groups: tuple[str, ...] = ()


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, floor = -1, 0
    while (at := text.find("@", at + 1)) >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            floor = m.end()


def _ips(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Four parts at a time of each dotted run, from its left, each at most 255."""
    for run in _DOTTED.finditer(text, low, high):
        at, parts = run.start(), run[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(_part(p) for p in four):
                yield at, end
            at = end + 1


def _part(digits: str) -> bool:
    """Whether a number, however many zeros it starts with, is at most 255."""
    short = digits.lstrip("0")
    return len(short) < 3 or (len(short) == 3 and short <= "255")


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a spelled-out at sign, from that sign outward."""
    floor = 0
    for at in _AT.finditer(text):
        middle = at.start()
        middle -= middle > floor and text[middle - 1] == " "
        start = middle
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < middle and (m := _SPELLED_DOMAIN.match(text, at.end())):
            yield start, m.end()
            floor = m.end()


def nodes(text: str | None) -> list[Node]:
    """Base spans and candidates of a text, by start and kind."""
    if not text:
        return []
    found = [Node(a, b, 1, "", text[a:b].lower()) for a, b in _emails(text)]
    if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text:
        found += [Node(a, b, 0, "", _plain(text[a:b])) for a, b in _spelled(text)]
    floor = 0
    for zone in _ZONE.finditer(text):
        low, high = zone.span()
        while low > floor and text[low - 1] in _SIGNS:
            low -= 1
        floor = high
        while low < zone.start() and text[low] != "+":
            low += 1
        while not "0" <= text[high - 1] <= "9":
            high -= 1
        n_digits = high - low if high - low < 7 else len(_NOT_DIGIT.sub("", text[low:high]))
        if high - low < 7 or n_digits < 4:
            continue
        base = [Node(a, b, 2, _NOT_DIGIT.sub("", text[a:b]), "") for a, b in _ips(text, low, high)]
        if n_digits >= 10:
            for kind, pattern, fewest, most in ((3, _CARD, 14, 19), (4, _PHONE, 10, 15)):
                for m in pattern.finditer(text, low, high):
                    digits = _NOT_DIGIT.sub("", m[0])
                    if fewest <= len(digits) <= most and (kind == 4 or luhn(digits)):
                        base.append(Node(m.start(), m.end(), kind, digits, ""))
        at = low
        for node in sorted(base, key=lambda x: x.start):
            found += _candidates(text, at, node.start)
            at = max(at, node.end)
        found += _candidates(text, at, high)
        found += base
    for node in found:
        node.key = node.key or node.digits
    found.sort(key=lambda x: (x.start, x.kind or 9, x.end))
    return found


def _plain(address: str) -> str:
    address = re.sub(r"\x20?[(\[]at[)\]]\x20?", "@", address, flags=re.IGNORECASE)
    return re.sub(r"\x20?[(\[]dot[)\]]\x20?", ".", address, flags=re.IGNORECASE).replace(" ", "").lower()


def _candidates(text: str, low: int, high: int) -> Iterator[Node]:
    """Numbers of 7 to 19 digits in what the base patterns have left of a zone."""
    if high - low < 7:
        return
    cuts = [low]
    for m in _LONG_NUMBER.finditer(text, low, high):
        cuts += m.span()
    cuts.append(high)
    for a, b in zip(cuts, cuts[1:], strict=False):
        while a < b and text[a] not in "+0123456789":
            a += 1
        while b > a and not "0" <= text[b - 1] <= "9":
            b -= 1
        digits = _NOT_DIGIT.sub("", text[a:b])
        if 7 <= len(digits) <= 19:
            yield Node(a, b, 0, digits, "", tuple(g for g in _NOT_DIGIT.split(text[a:b]) if g))


N_FEATURES = 22


def features(text: str, node: Node) -> np.ndarray:
    """What a node shows: shape and the words before it."""
    x, span, n = np.zeros(N_FEATURES), text[node.start : node.end], len(node.digits)
    x[0] = 1
    x[1] = "@" in node.key
    x[2] = not n
    for i, (a, b) in enumerate(((4, 9), (10, 11), (12, 13), (14, 15), (16, 16), (17, 19))):
        x[3 + i] = a <= n <= b
    x[9] = n >= 14 and luhn(node.digits)
    x[10] = span.startswith("+")
    x[11] = "(" in span or ")" in span
    x[12], x[13], x[14] = (c in span for c in ". -")
    groups = _NOT_DIGIT.split(span) if n else []
    x[15] = len(groups) == 4 and all(g and _part(g) for g in groups)
    x[16] = span.isdigit()
    x[17] = len(groups) > 4
    before = text[max(0, node.start - 24) : node.start].lower()
    for i, cue in enumerate(_CUES):
        x[18 + i] = bool(cue.search(before))
    return x


def edges(found: list[Node]) -> list[tuple[int, int, int]]:
    """``(i, j, type)``: 0 neighbours, 1 the same characters, 2 the same last seven digits."""
    out, same, tail = [], {}, {}
    for j, node in enumerate(found):
        if j and node.start - found[j - 1].end <= CHAIN_GAP:
            out.append((j - 1, j, 0))
        i = same.get(node.key)
        if i is not None:
            out.append((i, j, 1))
        same[node.key] = j
        if len(node.digits) >= 9:
            k = tail.get(node.digits[-7:])
            if k is not None and k != i:
                out.append((k, j, 2))
            tail[node.digits[-7:]] = j
    return out


@dataclass(frozen=True)
class Weights:
    """Node weights (features x labels) and edge log potentials (types x labels x labels)."""

    node: np.ndarray
    edge: np.ndarray


def untrained() -> Weights:
    node = np.zeros((N_FEATURES, 5))
    node[0, 0] = 8
    return Weights(node, np.zeros((3, 5, 5)))


#: Numbers that are no personal data, learned along with every sample.
BACKGROUND = (
    "order 1234567 of 20240101, then 12345678 and 123456789",
    "id 1234567890 or 12345678901 or 123456789012 or 1234567890123",
    "from 2024-01-01 to 2024-12-31, and 1 234 567 of 12 345 678",
    "book 978-3-16-148410-0, part 1234-5678-90, lot 12.34.5678",
    "code 12345678901234567 and 1234567890123456789",
)


def domain(node: Node) -> np.ndarray:
    """Log potential of the labels that a candidate can have at all."""
    n, groups = len(node.digits), node.groups
    possible = (True, "@" in node.key, len(groups) == 4 and all(map(_part, groups)), 14 <= n <= 19 and luhn(node.digits), 7 <= n <= 15)
    return np.where(possible, 0.0, -50.0)


#: Code points between appended values, so that no chain edge joins them.
_GAP = " " + "x" * CHAIN_GAP + " "


def _rewritten(text: str, node: Node) -> list[str]:
    """A base span as candidates would show it: each differs from all base patterns."""
    span, d = text[node.start : node.end], node.digits
    if node.kind == 1:
        local, _, domain = span.partition("@")
        return [f"{local}(at){domain}", f"{local} [at] {domain.replace('.', ' [dot] ')}"]
    if node.kind == 2:
        return [span.replace(".", "-"), span.replace(".", " ")]
    if node.kind == 3:
        return [".".join(d[i : i + 4] for i in range(0, len(d), 4))]
    return [d, f"{d[:-10]}-{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}".lstrip("-"), f"{d[-9:-6]}.{d[-6:-3]}.{d[-3:]}"]


def _examples(text: str) -> tuple[str, list[Node], list[int]]:
    """A text with what it holds written again, its nodes and their labels."""
    parts, labelled, at = [text], {}, len(text)
    for node in nodes(text):
        span = text[node.start : node.end]
        for again in _rewritten(text, node) if node.kind else [span]:
            parts += [_GAP, again]
            labelled[at + len(_GAP)] = node.kind
            at += len(_GAP) + len(again)
    whole = "".join(parts)
    found = nodes(whole)
    return whole, found, [x.kind or labelled.get(x.start, 0) for x in found]


def train(texts: list[str], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> Weights:
    """Weights that maximise the pseudo-likelihood of texts whose base spans are the labels.

    The label of every node is predicted from its features and from the labels
    of its neighbours; node and edge weights are fitted together by gradient
    ascent with quadratic decay.  Skip potentials are symmetric.
    """
    rows, labels, links = [], [], []
    for text in (*texts, *BACKGROUND):
        whole, found, own = _examples(text)
        links += [(i + len(rows), j + len(rows), kind) for i, j, kind in edges(found)]
        rows += [features(whole, x) for x in found]
        labels += own
    if not any(labels):
        return untrained()
    x, y = np.array(rows), np.array(labels)
    target = np.eye(5)[y]
    share = 1.0 / np.maximum(1, np.bincount(y, minlength=5))[y] / len(set(labels))  # each label weighs the same
    pairs = np.array(links, dtype=np.int64).reshape(-1, 3)
    seen = np.zeros((3, 2, len(x), 5))  # by type and side, how many neighbours have which label
    for kind in range(3):
        i, j = pairs[pairs[:, 2] == kind, :2].T
        np.add.at(seen[kind, 0], j, target[i])
        np.add.at(seen[kind, 1], i, target[j])
    w, edge = np.zeros((N_FEATURES, 5)), np.zeros((3, 5, 5))
    for _ in range(steps):
        z = x @ w
        for kind in range(3):
            z += seen[kind, 0] @ edge[kind] + seen[kind, 1] @ edge[kind].T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (target - p) * share[:, None]
        w += rate * (x.T @ error - decay * w)
        for kind in range(3):
            g = seen[kind, 0].T @ error + (seen[kind, 1].T @ error).T
            g = g if not kind else (g + g.T) / 2
            edge[kind] += rate * (g - decay * edge[kind])
    return Weights(w, edge)


def marginals(unary: np.ndarray, links: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Label probabilities of all nodes by loopy sum-product messages over ``links(i, j, type)``."""

    def spread(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    if not len(links):
        return spread(unary)
    source = np.concatenate((links[:, 0], links[:, 1]))
    target = np.concatenate((links[:, 1], links[:, 0]))
    pair = np.exp(np.concatenate((edge[links[:, 2]], edge[links[:, 2]].transpose(0, 2, 1))))
    back = np.concatenate((np.arange(len(links)) + len(links), np.arange(len(links))))
    message = np.zeros((len(source), 5))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, target, message)
        new = np.log(np.einsum("ea,eab->eb", spread(belief[source] - message[back]), pair))
        new = 0.5 * message + 0.5 * (new - new.mean(axis=1, keepdims=True))
        change = np.abs(new - message).max()
        message = new
        if change < TOLERANCE:
            break
    belief = unary.copy()
    np.add.at(belief, target, message)
    return spread(belief)


Span = tuple[int, int, int]


def label(texts: list[str | None], weights: Weights) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all spans as ``(start, kind, end)`` in order."""
    found = [nodes(t) for t in texts]
    open_texts = [i for i, own in enumerate(found) if any(not x.kind for x in own)]
    rows, links, first = [], [], {}
    for i in open_texts:  # one graph; its texts are not connected
        first[i] = len(rows)
        rows += [features(texts[i], x) for x in found[i]]
        links += [(a + first[i], b + first[i], kind) for a, b, kind in edges(found[i])]
    added: dict[int, list[Span]] = {}
    if rows:
        unary = np.array(rows) @ weights.node
        base = np.array([x.kind for i in open_texts for x in found[i]])
        fixed = np.flatnonzero(base)
        for j, x in enumerate(x for i in open_texts for x in found[i]):
            if not x.kind:
                unary[j] += domain(x)
        unary[fixed] -= 50.0
        unary[fixed, base[fixed]] += 50.0
        p = marginals(unary, np.array(links, dtype=np.int64).reshape(-1, 3), weights.edge)
        best = p.argmax(axis=1)
        for i in open_texts:
            for j, x in enumerate(found[i], first[i]):
                if not x.kind and best[j] and p[j, best[j]] >= MIN_PROBABILITY:
                    added.setdefault(i, []).append((x.start, int(best[j]), x.end))
    out = []
    for i, own in enumerate(found):
        base = sorted((x.start, x.kind, x.end) for x in own if x.kind)
        out.append((base, sorted(base + added[i]) if i in added else base))
    return out


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k - 1]}:{a}:{b}" for a, k, b in spans)


def learn(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Weights:
    """Weights from the texts with the smallest hashes of all rows, ``SAMPLE_TEXTS`` at most."""
    rows = df.select(df[id_column].alias("id"), df[text_column].alias("text"))
    # A share of the rows by hash first, so that what tasks send back doesn't grow with their number.
    rows = rows.where(hash_share(F.xxhash64("id"), min(1.0, 3 * SAMPLE_TEXTS / max(1, rows.count()))))
    rows = rows.where(F.char_length("text").between(1, SAMPLE_CHARS) & F.col("text").rlike("[0-9]"))
    rows = rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(SAMPLE_TEXTS)
    return train([r.text for r in rows.select("text").collect()])


def detect(spark: SparkSession, df: DataFrame, weights: Weights, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Identifier, base counts by kind, digest of the base spans, and all spans of each row and their number."""
    shared = spark.sparkContext.broadcast(weights)
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = label(batch.column(1).to_pylist(), shared.value)
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(1, 5)]
            digest = pa.array([hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([spelled(x) for _, x in found], pa.string()), pa.array([len(x) for _, x in found], pa.int64())], ["id", *names])

    schema = T.StructType([T.StructField("id", df.schema[id_column].dataType), *T._parse_datatype_string(", ".join(f"{n} {'long' if n.startswith('n_') else 'string'}" for n in names)).fields])
    return bounded_batches(df).select(df[id_column].alias("id"), df[text_column].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind - 1].upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(spark: SparkSession, df: DataFrame, weights: Weights, text_column: str = "text", length_column: str | None = None) -> DataFrame:
    """All rows and columns of ``df``, personal data replaced; ``length_column`` is set anew if given and present."""
    shared, where = spark.sparkContext.broadcast(weights), df.columns.index(text_column)
    size = df.columns.index(length_column) if length_column in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{where}"):
            columns, old = batch.columns, batch.column(where).to_pylist()
            new = [masked(x, spans) if spans else x for x, (_, spans) in zip(old, label(old, shared.value), strict=True)]
            columns[where] = pa.array(new, columns[where].type)
            if size is not None:
                sizes = [y if x is z else len(z) for x, z, y in zip(old, new, columns[size].to_pylist(), strict=True)]
                columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    names = [f"c{i}" for i in range(len(df.columns))]
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields, strict=True)]
    return bounded_batches(df).toDF(*names).mapInArrow(run, T.StructType(fields)).toDF(*df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1_skip_chain_pii``: personal data in all documents."""
    docs = table(spark, sf_dir, "documents")
    return detect(spark, docs, learn(docs))

"""Line-first quality rules.

Punctuation, navigation and boilerplate rules are evaluated on every line of a
whole text; failing lines are removed; a document that loses too much of its
text is rejected.  Two base rules (too few words, too much repetition) reject
before that.

* Punctuation: no sentence mark, or too many symbols, exclamation marks or
  capitals.
* Navigation: a menu or breadcrumb (short items between separators), or a line
  of which half the words or more are links.
* Boilerplate: a phrase of ``BOILERPLATE`` within the line.

Defined results: a null text counts as a text without words; it fails the base
rule and comes back as null.  An empty table gives an empty table.  Repeated
rows are judged one by one, and no verdict depends on other rows.  ``clean``
keeps every column of its input whatever the names; ``judge`` takes the names
of the identifier and text columns, so further columns never clash.  Memory
follows the longest single text (about 100 bytes for each of its bytes), not
the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import Words, bounded_batches, per_text, slices, table

#: Phrases of boilerplate lines, A to Z in lower case.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "cookies to",
    "copyright ©",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "subscribe to our",
    "terms of service",
    "terms of use",
    "alle rechte vorbehalten",
    "allgemeine geschäftsbedingungen",
    "datenschutzerklärung",
    "hier klicken",
    "unseren newsletter",
    "verwendet cookies",
    "cliquez ici",
    "conditions d'utilisation",
    "mentions légales",
    "politique de confidentialité",
    "tous droits réservés",
    "utilise des cookies",
    "aviso legal",
    "haga clic aquí",
    "política de privacidad",
    "términos y condiciones",
    "todos los derechos reservados",
    "utiliza cookies",
)
#: Separators of menus and breadcrumbs, wherever they stand and as words of their own.
SEPARATORS = ("|", "»", "›", "·", "•", "→")
LONE_SEPARATORS = ">/"
#: What a link starts with.
LINKS = ("http://", "https://", "www.")
#: Bytes of symbols that prose has few of.
SYMBOLS = b"#*$%&|<>"
#: ASCII sentence marks; a line without any fails.
MARKS = b".!?:;,"
#: Marks outside ASCII.
WIDE_MARKS = ("…", "。", "！", "？", "，")


@dataclass(frozen=True)
class LineRules:
    """Thresholds; percentages are whole numbers, so that results are exact."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line fails with more symbols than this per hundred words.
    max_symbols_percent: int = 30
    #: A line of this many words at least fails without a sentence mark.
    unmarked_words: int = 4
    #: A line fails with more exclamation marks than this per hundred words.
    max_exclaims_percent: int = 60
    #: A line fails with more capitals than this per hundred ASCII letters (of 20 at least).
    max_capitals_percent: int = 60
    #: A line fails with this many separators at least, and as many words for each item at most.
    menu_separators: int = 2
    menu_words: int = 5
    #: A line fails if links are this share of its words or more.
    max_links_percent: int = 50
    #: A document is rejected that loses more than this share of its word characters.
    max_lost_percent: int = 30


DIGEST = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_failed_lines long, lost_chars long, kept boolean"


def _flag(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[list(chars)] = True
    return flags


_IS_SYMBOL, _IS_MARK, _IS_CAPITAL, _IS_LONE = _flag(SYMBOLS), _flag(MARKS), _flag(bytes(range(65, 91))), _flag(LONE_SEPARATORS.encode())
_IS_LETTER = _IS_CAPITAL | _flag(bytes(range(97, 123)))
_IS_LEAD = (np.arange(256) & 0xC0) != 0x80


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def _found(data: bytes, phrases: tuple[str, ...]) -> np.ndarray:
    """First and last byte of every occurrence of one of the phrases, as two rows."""
    first, last = [], []
    for phrase in phrases:
        what, i = phrase.encode(), -1
        while (i := data.find(what, i + 1)) >= 0:
            first.append(i)
            last.append(i + len(what) - 1)
    return np.array([first, last], dtype=np.int64)


def _lines_of(starts: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The lines of occurrences; texts lie side by side, so one that begins in a line and ends in another is none."""
    first, last = np.searchsorted(starts, found, side="right") - 1
    return first[first == last]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions with a key seen at a smaller position, and those whose key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later = order[1:][same]
    return later, np.union1d(later, order[:-1][same])


class _Judged:
    """The counts, line verdicts and document verdicts of some texts."""

    def __init__(self, texts: pa.Array, rules: LineRules):
        words = Words(texts)
        data, n = words.data, words.n_texts
        breaks = np.flatnonzero(data == 10)
        doc_of_break = np.searchsorted(words.offsets, breaks, side="right") - 1
        line_counts = np.bincount(doc_of_break, minlength=n) + 1
        first = np.concatenate(([0], np.cumsum(line_counts)))
        opens = np.zeros(first[-1], dtype=bool)
        opens[first[:-1]] = True
        closes = np.zeros(first[-1], dtype=bool)
        closes[first[1:] - 1] = True
        starts, ends = np.empty(first[-1], dtype=np.int64), np.empty(first[-1], dtype=np.int64)
        starts[opens], starts[~opens] = words.offsets[:-1], breaks + 1
        ends[closes], ends[~closes] = words.offsets[1:], breaks
        line_doc = np.repeat(np.arange(n), line_counts)
        self.starts, self.ends, self.first = starts, ends, first

        line_words = np.searchsorted(words.starts, ends) - np.searchsorted(words.starts, starts)
        filled = line_words > 0
        chars = _sums(words.inside & _IS_LEAD[data], starts, ends)

        self.n_words = words.counts
        self.word_chars = per_text(line_doc, n, chars)
        self.n_symbols = words.code_points(_IS_SYMBOL[data])
        at = np.flatnonzero(filled)
        salt = line_doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        later, _ = _repeats(words.span_hashes(starts[at], ends[at]) ^ salt)
        self.n_dup_lines = per_text(line_doc[at[later]], n)
        at, keys = words.windows(words.hashes())
        _, again = _repeats(keys ^ (words.text_of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        covered = np.zeros(len(words.starts) + 1, dtype=np.int64)
        np.add.at(covered, at[again], 1)
        np.add.at(covered, at[again] + 3, -1)
        self.n_repeat_words = per_text(words.text_of[np.cumsum(covered[:-1]) > 0], n)
        self.base_failed = (self.n_words < rules.min_words) | (100 * self.n_repeat_words > rules.max_repeat_percent * self.n_words)

        marks = _sums(_IS_MARK[data], starts, ends)
        lowered = data.tobytes().lower()
        wide = np.bincount(_lines_of(starts, _found(lowered, WIDE_MARKS)), minlength=len(starts))
        letters = _sums(_IS_LETTER[data], starts, ends)
        failed = (line_words >= rules.unmarked_words) & (marks + wide == 0)
        failed |= 100 * _sums(_IS_SYMBOL[data], starts, ends) > rules.max_symbols_percent * line_words
        failed |= 100 * _sums(data == 33, starts, ends) > rules.max_exclaims_percent * line_words
        failed |= (letters >= 20) & (100 * _sums(_IS_CAPITAL[data], starts, ends) > rules.max_capitals_percent * letters)
        lone = (words.ends - words.starts == 1) & _IS_LONE[data[words.starts]] if len(words.starts) else np.zeros(0, dtype=bool)
        word_line = np.searchsorted(starts, words.starts, side="right") - 1
        bars = np.bincount(_lines_of(starts, _found(lowered, SEPARATORS)), minlength=len(starts)) + np.bincount(word_line[lone], minlength=len(starts))
        failed |= (bars >= rules.menu_separators) & (line_words <= rules.menu_words * (bars + 1))
        heads, tails = _found(lowered, LINKS)
        word = np.searchsorted(words.starts, heads)
        word[word == len(words.starts)] = 0
        # A link is a word that starts with the phrase, which has no blank and so ends in the word unless texts meet.
        link = (words.starts[word] == heads) & (words.ends[word] > tails) if len(heads) and len(words.starts) else np.zeros(0, dtype=bool)
        links = np.bincount(word_line[word[link]] if len(link) else [], minlength=len(starts))
        failed |= (links > 0) & (100 * links >= rules.max_links_percent * line_words)
        failed[_lines_of(starts, _found(lowered, BOILERPLATE))] = True
        self.failed = failed & filled
        self.n_lines = per_text(line_doc[filled], n)
        self.n_failed_lines = per_text(line_doc[self.failed], n)
        self.lost_chars = per_text(line_doc, n, chars * self.failed)
        self.kept = ~self.base_failed & (100 * self.lost_chars <= rules.max_lost_percent * self.word_chars)
        self.data = data

    def cleaned(self, text: int) -> str:
        """The text without its failing lines."""
        lines = range(self.first[text], self.first[text + 1])
        return "\n".join(self.data[self.starts[i] : self.ends[i]].tobytes().decode() for i in lines if not self.failed[i])


def judge(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per row of ``df``: the identifier and the counts and verdicts of ``DIGEST``."""
    fields = [(x.split()[0], x.split()[1]) for x in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = _Judged(batch.column(1), rules)
            arrays = [pa.array(getattr(found, n), pa.int64() if kind == "long" else pa.bool_()) for n, kind in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", *(n for n, _ in fields)])

    source = bounded_batches(df).select(df[id_column].alias("id"), df[text_column].alias("text"))
    schema = T.StructType([T.StructField("id", df.schema[id_column].dataType), *T._parse_datatype_string(DIGEST).fields])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def clean(df: DataFrame, text_column: str = "text", rules: LineRules = LineRules(), length_column: str | None = None) -> DataFrame:
    """The kept rows of ``df`` with all their columns; failing lines are cut out of the text.

    ``length_column``, if given and present, is set anew to the code points of
    the cleaned text.
    """
    where = df.columns.index(text_column)
    size = df.columns.index(length_column) if length_column in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{where}"):
            found = _Judged(batch.column(where), rules)
            keep = np.flatnonzero(found.kept)
            if not len(keep):
                continue
            columns = [c.take(pa.array(keep)) for c in batch.columns]
            changed = found.n_failed_lines[keep] > 0
            if changed.any():
                old = columns[where].to_pylist()
                new = [found.cleaned(i) if c else x for i, c, x in zip(keep, changed, old, strict=True)]
                columns[where] = pa.array(new, columns[where].type)
                if size is not None:
                    sizes = [len(x) if c else y for x, c, y in zip(new, changed, columns[size].to_pylist(), strict=True)]
                    columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    names = [f"c{i}" for i in range(len(df.columns))]  # repeated names do no harm
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields, strict=True)]
    return bounded_batches(df).toDF(*names).mapInArrow(run, T.StructType(fields)).toDF(*df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op2_line_quality``: verdicts on all documents."""
    return judge(table(spark, sf_dir, "documents"))


_R = LineRules()
_PLAIN = "translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_QUOTED = lambda x: x.replace("'", "''")
_COUNT = "length(regexp_replace(l, '{}', '', 'g'))"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n >= 2),
rep AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n_repeat_words
        FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
ls AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d),
lw AS (SELECT r, l, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS n,
              {_COUNT.format('[\\x20\\x09-\\x0D]')} AS chars,
              {_COUNT.format('[^#*$%&|<>]')} AS symbols,
              {_COUNT.format('[^.!?:;,…。！？，]')} AS marks,
              {_COUNT.format('[^!]')} AS exclaims,
              {_COUNT.format('[^A-Z]')} AS capitals,
              {_COUNT.format('[^A-Za-z]')} AS letters,
              {_COUNT.format('[^' + ''.join(SEPARATORS) + ']')}
              + len(list_filter(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+'), lambda w: w IN ({", ".join(f"'{x}'" for x in LONE_SEPARATORS)}))) AS bars,
              len(list_filter(regexp_extract_all({_PLAIN}, '[^\\x20\\x09-\\x0D]+'), lambda w: {" OR ".join(f"starts_with(w, '{x}')" for x in LINKS)})) AS links
       FROM ls),
lf AS (SELECT *, n > 0 AND (
              (n >= {_R.unmarked_words} AND marks = 0)
              OR 100 * symbols > {_R.max_symbols_percent} * n
              OR 100 * exclaims > {_R.max_exclaims_percent} * n
              OR (letters >= 20 AND 100 * capitals > {_R.max_capitals_percent} * letters)
              OR (bars >= {_R.menu_separators} AND n <= {_R.menu_words} * (bars + 1))
              OR (links > 0 AND 100 * links >= {_R.max_links_percent} * n)
              OR {" OR ".join(f"contains({_PLAIN}, '{_QUOTED(x)}')" for x in BOILERPLATE)}) AS bad
       FROM lw),
lc AS (SELECT r, sum(n)::BIGINT AS n_words, sum(chars)::BIGINT AS word_chars, sum(symbols)::BIGINT AS n_symbols,
              (count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0))::BIGINT AS n_dup_lines,
              (count(*) FILTER (n > 0))::BIGINT AS n_lines, (count(*) FILTER (bad))::BIGINT AS n_failed_lines,
              coalesce(sum(chars) FILTER (bad), 0)::BIGINT AS lost_chars
       FROM lf GROUP BY r),
f AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             n_lines, n_failed_lines, lost_chars
      FROM d JOIN lc USING (r) LEFT JOIN rep USING (r))
SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed,
       NOT (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words)
       AND 100 * lost_chars <= {_R.max_lost_percent} * word_chars AS kept
FROM f
"""

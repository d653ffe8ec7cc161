"""Operators that look across texts, against brute force and on edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ridgeflow.llm import chat, components, jaccard, shards, warc, winnow
from ridgeflow.llm.common import scratch

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return frozenset()
    return frozenset(zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else frozenset([tuple(words)])


def expected_components(rows, percent=90):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows}
    changed = True
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def family(rng, n, words, edits, shared):
    """Near copies of one text that also holds a shared passage."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)] + shared
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        yield " ".join(copy)


@pytest.mark.parametrize("percent", (90, 80))
def test_jaccard_components_are_brute_force(spark, monkeypatch, percent):
    monkeypatch.setattr(jaccard, "FREQUENT", 3)  # many tokens are frequent even in a small table
    rng = random.Random(percent)
    passage = [f"p{i}" for i in range(30)]
    texts = [t for _ in range(6) for t in family(rng, 14, rng.choice((8, 40, 150)), 4, passage)]
    texts += ["One two", "one  TWO", "one", "", None, " \n", "a b c", "A B C", *(f"x{i} y z q r s t u v w" for i in range(5))]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.id: r.component for r in jaccard.JaccardJoin(spark, df, percent).components().collect()}
    assert got == expected_components(sorted(rows), percent)
    kept = {r.doc_id for r in jaccard.deduplicate(spark, df, percent).collect()}
    assert kept == {i for i, c in got.items() if i == c}


def test_jaccard_signatures_never_miss(spark):
    """Linked sets share a signature whatever tokens are frequent."""
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (1, 2, 9, 10, 25, 60, 140, 400):
        for _ in range(25):
            x = rng.integers(0, 2**63, size, dtype=np.uint64)
            y = x.copy()
            k = size // 19
            y[:k] = rng.integers(0, 2**63, k, dtype=np.uint64)
            if rng.random() < 0.5 and size >= 10:
                y = y[k : k + size - size // 20] if 100 * (size - size // 20 - k) >= 90 * size else y
            both = len(np.intersect1d(x, y))
            if 100 * both < 90 * (len(x) + len(y) - both):
                continue
            often = np.unique(np.concatenate((x, y))[rng.random(len(x) + len(y)) < rng.choice((0, 0.3, 0.9, 1))])
            sx, sy = (jaccard.prefix_signatures(np.sort(v), np.isin(np.sort(v), often), 90) for v in (x, y))
            assert len(np.intersect1d(sx, sy)) or set(x) == set(y)


def test_jaccard_repeated_rows_and_columns(spark):
    rows = [(1, "a b c d", "u"), (1, "a b c d", "u"), (2, "a b c d", "v"), (None, "a b c d", "w"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string")
    kept = jaccard.deduplicate(spark, df)
    assert kept.columns == df.columns
    assert sorted(r.size for r in kept.collect()) == ["u", "w", "x"]
    assert jaccard.deduplicate(spark, df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.vertex: r.component for r in components.connected_components(spark, df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def windows_hit(text, items, span=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    ws, hit, found = words(text), set(), set()
    for item, t in items:
        own = words(t)
        n = min(span, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1) if n else ():
            if tuple(ws[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("limit", (200_000, 0))
def test_winnowing_is_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(winnow, "MAX_BROADCAST_ROWS", limit)
    rng = random.Random(4)
    vocabulary = ["a", "b", "C", "d1", "É", "fg"]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(("", ",", ".")) for _ in range(n))
    items = [(i, say(rng.choice((10, 12, 30)))) for i in range(12)] + [(90, "b b a"), (91, ""), (92, None), (93, "fg")]
    docs = [(i, " ".join((say(rng.randrange(40)), rng.choice(items)[1] or "", say(rng.randrange(20))))) for i in range(60)]
    docs += [(900, None), (901, ""), (902, "!!"), (903, "a " * 200), (904, "b B a"), (905, " zz " * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("n_hit", F.lit(-1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in winnow.contamination(df, bench).collect()}
    assert got == {i: windows_hit(t, items) for i, t in docs}
    clean = winnow.decontaminate(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, t in docs if not windows_hit(t, items)[1]}
    assert winnow.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert winnow.contamination(df.limit(0), bench).count() == 0


def test_shards_are_a_permutation(spark):
    rows = [(i, "t" * (i % 7) if i % 5 else None, i % 3) for i in range(203)] + [(5, "same", 0), (5, "same", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long")
    orders = []
    for parts, most in ((1, 4096), (6, 4096), (3, 3)):  # the last in two levels
        path = scratch(spark, "shards")
        shards.write_shards(df.repartition(parts), path, shards=16, bucket_bytes=100, max_buckets=most)
        out = spark.read.parquet(path).collect()
        assert sorted((r.doc_id, r.text or "", r.size) for r in out) == sorted((i, t or "", s) for i, t, s in rows)
        by = {}
        for r in out:
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 16
        orders.append([(r.doc_id, r.text) for r in sorted(out, key=lambda r: (r.shard, r.slot))])
    assert orders[0] == orders[1] == orders[2] and orders[0] != [(i, t) for i, t, _ in rows]
    with pytest.raises(ValueError):
        shards.write_shards(df.withColumn("slot", F.lit(1)), scratch(spark, "x"))
    few = scratch(spark, "few")
    shards.write_shards(df.limit(3), few)
    assert spark.read.parquet(few).where("slot = 0").count() == 3


def test_chat_round_trip(spark):
    rng = random.Random(6)
    marks = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user", "a\\b\\\\", "<\\s>", "<<SYS>>", "[\\INST]", "plain " * 80, "é\n\n", "", None, "<" * 3 + "s>"]
    rows, role = [], ("user", "assistant", "tool", None, "sys\ntem")
    for conv in range(25):
        n = rng.randrange(1, 40)
        for turn in range(n):
            who = "system" if turn == 0 and conv % 2 else rng.choice(role)
            rows.append((conv, turn, who, rng.choice(marks), "clash"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    rows += [(None, None, "user", "no number", ""), (None, None, "assistant", "tie", ""), (None, None, "assistant", "tie", ""), (77, 0, "system", "s" * 300, ""), (77, 1, "user", "x" * 100_000, ""), (77, 2, "assistant", "é", "")]
    df = spark.createDataFrame(rows, df.schema)
    made = chat.windows(df, chat.Budget(200, 60))
    assert made.where("window > 0").count() > 25
    for r in made.collect():  # a window holds its budget, or nothing besides the system turn but one turn
        held = len(r.formatted.replace("<|im_start|>", "1").replace("<|im_end|>", "1").encode())
        turns_in = r.formatted.count("<|im_start|>") - r.formatted.startswith("<|im_start|>system\n")
        assert held <= 200 or turns_in <= 1
    turns, learned = {}, {}
    for r in sorted(chat.parsed(made).collect(), key=lambda r: (r.conv, r.window)):
        turns.setdefault(r.conv, []).extend((t.role, t.text) for t in r.turns)
        learned.setdefault(r.conv, []).extend(r.learned)
    for conv in {r[0] for r in rows}:
        own = [(r or "", t or "") for c, _, r, t, _ in sorted((x for x in rows if x[0] == conv), key=lambda x: (-1 if x[1] is None else x[1], x[2] or "", x[3] or ""))]
        assert turns[conv] == own
        assert learned[conv] == [t for r, t in own if r == "assistant"]
    assert chat.windows(df.limit(0)).count() == 0


def test_warc_round_trip(spark, monkeypatch):
    rows = [(i, f"http://x/{i} y\r\n", p) for i, p in enumerate([None, "", "é" * 30_000, "é" * 30_000, "a\r\n\r\nWARC/1.1\r\n", "0\r\n\r\n", "same", "same", "x" * 100_001])]
    rows += [(6, None, "same"), (None, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write_archives(df, path)
    back = warc.digests(warc.read_archives(spark, path, "long")).collect()
    assert len(back) == len(rows)
    kinds = sorted((r.page if r.page is not None else -1, r.record_type, r.refers_to) for r in back)
    assert kinds == sorted([(0, "response", None), (1, "revisit", 0), (2, "response", None), (3, "revisit", 2), (4, "response", None), (5, "response", None), (6, "response", None), (6, "response", None), (7, "revisit", 6), (8, "response", None), (-1, "response", None)], key=lambda x: (x[0], x[1]))
    sizes = {r.page: r.payload_bytes for r in back if r.record_type == "response"}
    assert sizes[2] == 60_000 and sizes[8] == 100_001 and sizes[0] == 0
    several = spark.createDataFrame([(1, "A", "z"), (5, "A", "z"), (5, "B", "z"), (6, "C", "z")], "page_id long, html string, page string").withColumn("url", F.lit(None).cast("string")).withColumn("digest", F.lit(3))
    for parts in (1, 4):
        path = scratch(spark, "warc")
        warc.write_archives(several.repartition(parts), path)
        assert sorted((r.page, r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in warc.read_archives(spark, path).collect()) == [(1, "response", None, b"A"), (5, "response", None, b"B"), (5, "revisit", 1, None), (6, "response", None, b"C")]
    path = scratch(spark, "warc")
    warc.write_archives(several.limit(0), path)
    assert warc.digests(warc.read_archives(spark, path)).count() == 0
    for payload in ("", "abc", "é" * 9000):
        assert warc.unchunked(warc.chunked(payload).encode()) == payload.encode()
    whole = b"".join(r.encode() + b"\r\n\r\n" for r in warc.records(1, "u", "z" * 50_000, None, 0))
    heads = [h for h, _ in warc.parse(whole)]
    assert [h["WARC-Segment-Number"] for h in heads] == ["1", "2", "3", "4"] and "WARC-Segment-Total-Length" in heads[-1]
    with pytest.raises(warc.BrokenRecord):
        list(warc.parse(whole[:-3]))
    with pytest.raises(warc.BrokenRecord):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_queries_of_the_package(spark):
    from ridgeflow import llm

    names = sorted(llm.queries())
    assert [n for n in names if n.startswith("op")] == sorted(n for n in names if re.match(r"op\d+_", n)) and len(names) == 11
    rows = llm.queries()["op5_two_pass_shuffle"](spark, DATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 1 for r in rows)
    extra = next(r for r in llm.queries()["op9_chat_windows"](spark, DATA).collect() if r.conv_id == -7)
    said = "</s>[INST] ok [/INST]"
    assert extra.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (extra.loss_chars, extra.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())

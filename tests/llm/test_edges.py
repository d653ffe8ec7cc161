"""Brute-force models and odd cases of operators, and of the pipeline."""

from __future__ import annotations

import itertools
import random
import re
import struct
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeflow.llm import bpe, components, jaccard, pii, quality, shards
from ridgeflow.llm.common import scratch

from .test_corpus import windows_hit
from .test_near_copies import kept_ids
from .test_texts import base_spans

DATA = "/root/testdata/sf0.001"


# -- personal data


def exact(unary, links, edge):
    """Marginals by the sum over all labellings."""
    n, total = len(unary), np.zeros((len(unary), 5))
    for y in itertools.product(range(5), repeat=n):
        p = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(edge[k, y[i], y[j]] for i, j, k in links))
        for i in range(n):
            total[i, y[i]] += p
    return total / total.sum(axis=1, keepdims=True)


def test_messages_are_exact_on_trees_and_near_on_loops():
    rng = np.random.default_rng(1)
    for n, links in ((4, [(0, 1, 0), (1, 2, 1), (1, 3, 2)]), (5, [(0, 4, 1), (1, 2, 0), (2, 4, 2)]), (1, []), (4, [(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 1)]), (4, [(0, 2, 1), (1, 2, 0), (0, 1, 0), (1, 3, 2)])):
        for _ in range(3):
            unary, edge = rng.normal(size=(n, 5)), rng.normal(size=(3, 5, 5)) * 0.7
            got = pii.marginals(unary, np.array(links).reshape(-1, 3), edge)
            loops = len(links) >= n
            assert np.abs(got - exact(unary, links, edge)).max() < (0.1 if loops else 1e-3)


def test_skip_potentials_are_fitted():
    known = [f"call +1 (9{i}8) 555-24{i}5, mail a{i}@b.com, card 4111 1111 1111 1111" for i in range(10)]
    edge = pii.train(known).edge
    assert np.allclose(edge[1], edge[1].T) and np.allclose(edge[2], edge[2].T)
    for kind, label in ((1, 1), (1, 3), (1, 4), (2, 4)):  # equal values speak for equal labels
        assert edge[kind, label, label] > 1 > 0.2 > edge[kind, label, 0]
    only_mail = pii.train([x.split("mail ")[1].split(",")[0] for x in known]).edge
    assert only_mail[1, 1, 1] > 0.5 and abs(only_mail[1, 4, 4]) < 0.2


def test_personal_data_in_long_runs():
    rng = random.Random(5)
    texts = ["0" * 5000 + "1.1.1.1", "1.1.1." + "0" * 5000 + "7 x", "9" * 40, "1.2.3.4.5.6.7.8.9", "300.1.1.1.1", "+" * 50 + "1 234 567 8901 2"]
    texts += ["".join(rng.choice(["1", "25", "0", "300", ".", ".", " ", "+", "-", "(", "a@b", "x"]) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for text, (base, _) in zip(texts, pii.label(texts, pii.untrained()), strict=True):
        short = re.sub("0{100,}", lambda m: "0" * 100, text)
        if short == text:
            assert base == base_spans(text)
        else:
            assert [k for _, k, _ in base] == [k for _, k, _ in base_spans(short)]
    began = time.perf_counter()
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "(at)" + "b" * 300_000, "+ (" * 100_000, "(at)a" * 60_000, "a@b." * 60_000):
        pii.label([text], pii.untrained())
    assert time.perf_counter() - began < 30


# -- quality rules


def judged(text):
    """Line verdicts and what is left, by the rules as stated."""
    rules, kept, lost, chars = quality.LineRules(), [], 0, 0
    words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    text = text or ""
    for line in text.split("\n"):
        ws, low = words_of(line), re.sub("[A-Z]", lambda m: m[0].lower(), line)
        n, letters = len(ws), len(re.findall("[A-Za-z]", line))
        bars = sum(line.count(x) for x in quality.SEPARATORS) + sum(w in quality.LONE_SEPARATORS for w in ws)
        links = sum(w.startswith(quality.LINKS) for w in words_of(low))
        bad = n >= rules.unmarked_words and not re.search("[.!?:;,…。！？，]", line)
        bad |= 100 * len(re.findall(r"[#*$%&|<>]", line)) > rules.max_symbols_percent * n
        bad |= 100 * line.count("!") > rules.max_exclaims_percent * n
        bad |= letters >= 20 and 100 * len(re.findall("[A-Z]", line)) > rules.max_capitals_percent * letters
        bad |= bars >= rules.menu_separators and n <= rules.menu_words * (bars + 1)
        bad |= links > 0 and 100 * links >= rules.max_links_percent * n
        bad |= any(x in low for x in quality.BOILERPLATE)
        bad &= n > 0
        chars += sum(map(len, ws))
        lost += sum(map(len, ws)) * bad
        if not bad:
            kept.append(line)
    ws = words_of(text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    again = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(set(grams)) < len(grams) else set()
    rejected = len(ws) < 50 or 100 * len(again) > 50 * len(ws) or 100 * lost > rules.max_lost_percent * chars
    return None if rejected else "\n".join(kept)


def test_navigation_and_neighbours():
    lines = ["Home | News | Shop", "Start » Blog » Post", "Home > Shop > Shoes", "Home / Shop / Shoes", "www.a.com, https://b.org", "Read www.a.com for all of it, please.", "A | B is one bar, no menu.", "This is plain, and long enough.", "Politique de confidentialité.", "3 > 2, and 5 > 4 hold, as far as all of us in this long line know by now."]
    found = quality._Judged(pa.array(lines), quality.LineRules())
    assert found.failed.tolist() == [True, True, True, True, True, False, False, False, True, False]
    texts = ["It ends: please click", " here, it goes on.", "It ends: Home |", "| x | y, it goes on and on and on and on and on and on.", "x www", ".a.com y, z", "All rights", None, " reserved."]
    together = quality._Judged(pa.array(texts), quality.LineRules())
    alone = [quality._Judged(pa.array([x], pa.string()), quality.LineRules()) for x in texts]
    assert together.n_failed_lines.tolist() == [int(x.n_failed_lines[0]) for x in alone]
    assert together.n_failed_lines.tolist()[:2] == [0, 0]


# -- encoding


def test_long_words_are_encoded_in_pieces(spark):
    path = bpe.default_path()
    rng = random.Random(8)
    long_word = lambda n: "".join(rng.choice("thean oursing".replace(" ", "")) for _ in range(n))
    texts = [long_word(700), "a " + long_word(400) + "1é!!" + long_word(300) + " b " + long_word(999), "x" * 900 + "<|endoftext|>" + "é" * 500, "plain words", None, "!" * 800, "a" * 128 + " " + "b" * 127]
    texts.append(texts[0])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    own, pieces = bpe.TreeBpe(path), bpe.Pieces(word=128, symbols=50)
    got = {r.doc_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in bpe.encode(df, path, pieces=pieces).collect()}
    assert got == {i: own.encode(t) for i, t in enumerate(texts)}
    cut = {r.doc_id: r.known for r in bpe._with_long_words(df, 1, path, pieces).collect()}
    assert [cut[i] and len(cut[i]) for i in range(8)] == [1, 2, 1, None, None, 1, 1, 1]


# -- shards


def test_shards_are_fisher_yates_of_seeded_buckets(spark):
    import xxhash

    rows = [(i, None if i % 9 == 0 else "t" * (i % 5)) for i in range(150)] + [(7, "same")] * 40
    path, seed, shards_n = scratch(spark, "model"), 99, 4
    shards.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, shards_n, seed, bucket_bytes=60)
    got = {(r.shard, r.slot): (r.doc_id, r.text) for r in spark.read.parquet(path).collect()}

    def spread(i, text, copy):
        h = xxhash.xxh64(struct.pack("<i", seed), seed=42).intdigest()
        for part in (struct.pack("<q", i), None if text is None else text.encode(), struct.pack("<q", copy)):
            h = h if part is None else xxhash.xxh64(part, seed=h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    buckets = -(-sum(len((t or "").encode()) + 1 for _, t in rows) // 60)
    filled = {}
    for i, text in rows[:150]:
        filled.setdefault(spread(i, text, 0) % buckets, []).append((i, text, 0))
    for copy in range(1, 41):
        filled.setdefault(spread(7, "same", copy) % buckets, []).append((7, "same", copy))
    assert max(sum(t == "same" for _, t, _ in x) for x in filled.values()) < 20  # copies are scattered
    order = []
    for bucket, records in sorted(filled.items()):
        records.sort(key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
        key = spark.sparkContext._gateway.new_array(spark._jvm.int, 2)
        key[1] = seed + bucket  # a long seed is two words
        source = spark._jvm.org.apache.commons.math3.random.MersenneTwister(key)
        places = []
        for k in range(len(records)):  # inside-out Fisher-Yates
            j = source.nextInt(k + 1)
            places.append(k)
            places[k] = places[j]
            places[j] = k
        order += [records[k][:2] for k in places]
    n = len(rows)
    expected, first = {}, 0
    for shard in range(shards_n):
        last = (shard + 1) * n // shards_n
        expected |= {(shard, k - first): order[k] for k in range(first, last)}
        first = last
    assert got == expected


def test_shuffle_is_uniform(spark):
    """Places of one record over many seeds fall evenly into the shards."""
    df = spark.createDataFrame([(i, "x") for i in range(32)], "doc_id long, text string").coalesce(1)
    hits = np.zeros(4)
    for seed in range(12):
        path = scratch(spark, "even")
        shards.write_shards(df, path, 4, seed, bucket_bytes=16)
        for r in spark.read.parquet(path).where("doc_id < 16").collect():
            hits[r.shard] += 1
    assert hits.sum() == 192 and ((hits - 48) ** 2 / 48).sum() < 16.3  # 0.1 percent of chi-square with 3 degrees


# -- near copies


def test_rows_of_one_identifier_keep_their_texts(spark):
    rows = [(1, None), (1, "a b c d e"), (1, "f g h i j"), (2, "a b c d e"), (3, "f g h i j"), (3, "k l m n o"), (3, "k l m n o"), (4, None), (4, None), (None, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n1", F.lit("clash")).withColumn("bare", F.lit(1))
    for parts in (1, 4):
        kept = jaccard.deduplicate(spark, df.repartition(parts))
        assert kept.columns == df.columns
        assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "a b c d e"), (1, ""), (1, "a b c d e"), (1, "f g h i j"), (3, "k l m n o"), (4, ""), (4, "")]


def test_components_edge_cases(spark):
    schema = "a long, b long"
    assert components.connected_components(spark, spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, 1), (2, None), (3, 3), (5, 4), (5, 4), (4, 5)], schema)
    assert {(r.vertex, r.component) for r in components.connected_components(spark, df).collect()} == {(4, 4), (5, 4)}


# -- pipeline


def test_pipeline_is_brute_force(spark):
    """The rows of the whole pipeline against its stages in plain Python."""
    import corpus_pipeline

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = [(i, left) for i, t in docs if (left := judged(t)) is not None]
    stay = kept_ids(kept, 80, 5)
    kept = [(i, t) for i, t in kept if i in stay and not windows_hit(t, bench)[1]]
    assert set(got) == {i for i, _ in kept}
    own = bpe.coder(bpe.default_path())
    for i, text in kept:
        new = got[i].text
        spans = base_spans(text)
        # What is between the marks is the old text, in order; each base span is within what a mark replaced.
        pattern = "(.+?)".join(re.escape(x) for x in re.split(r"\[(?:EMAIL|IP|CARD|PHONE)\]", new))
        m = re.fullmatch(pattern, text, re.DOTALL)
        assert m and all(any(a <= s and e <= b for a, b in (m.span(k + 1) for k in range(m.re.groups))) for s, _, e in spans)
        assert not base_spans(new) and (new == text) <= (not spans)
        assert got[i].token_ids == own.encode(new) and got[i].n_tokens == len(got[i].token_ids)
        assert got[i].n_chars == len(new)


def test_stages_take_odd_tables(spark):
    import corpus_pipeline

    good = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(8))
    rows = [(1, good, 7), (1, good, 7), (2, None, 0), (None, good, 7), (3, "", 0), (4, good * 300, 7), (5, "word " * 3, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    for name in ("n_tokens", "words", "id", "key", "n1", "size", "spans", "print", "known", "c0"):
        df = df.withColumn(name, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        out = stage(spark, df, DATA)
        columns = out.columns if not last else [c.removesuffix("_input") for c in out.columns[: len(df.columns)]]
        assert columns == df.columns
        n = {"quality rules": 3, "n-gram Jaccard join": 5}.get(name, 7)  # the long text has the shingles of the first
        assert out.count() == n, name
        assert stage(spark, df.limit(0), DATA).count() == 0

"""The near-duplicate stage of the pipeline, and shingles of any width, against brute force."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from ridgeflow.llm import jaccard

DATA = "/root/testdata/sf0.001"


def shingles(text, width):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def kept_ids(rows, percent, width):
    """The smallest identifier of each component."""
    sets = [(i, shingles(t, width)) for i, t in sorted(rows)]
    label = {i: i for i, _ in sets}
    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((label[a], label[b]))
                label = {i: low if c == high else c for i, c in label.items()}
    return {i for i, c in label.items() if i == c}


@pytest.mark.parametrize("width", (1, 2, 3, 4, 5, 8))
def test_sets_are_those_of_the_width(width):
    rng = random.Random(width)
    texts = [" ".join(rng.choice("abAB") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 40) for _ in range(6)]
    sets = jaccard.token_sets(pa.array([*texts, None]), width)
    assert list(sets.size) == [len(shingles(t, width)) for t in [*texts, None]]
    own = [frozenset(sets.token[i:j].tolist()) for i, j in zip(sets.first, sets.first[1:], strict=False)]
    plain = [shingles(t, width) for t in texts]
    for x, a in zip(own, plain, strict=False):
        assert [len(x & y) for y in own[:-1]] == [len(a & b) for b in plain]


def test_stage_removes_copies_with_a_word_in_fifty_changed(spark):
    import corpus_pipeline

    rng = random.Random(5)
    rows = []
    for k in range(8):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        copy, far = list(base), list(base)
        copy[30] = copy[70] = "changed"  # 10 of 96 shingles of five words: 86 in 106
        far[20] = far[50] = far[80] = "changed"  # 15 of 96: 81 in 111
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(copy)), (3 * k + 2, " ".join(far))]
    rows += [(100, "One two three four"), (101, "one two  three FOUR"), (102, "one two three"), (103, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, DATA).collect()}
    assert got == kept_ids(rows, 80, 5) == {*range(0, 24, 3), *range(2, 24, 3), 100, 102, 103}


def test_stage_is_brute_force_on_the_tables(spark):
    import corpus_pipeline
    from ridgeflow.llm.common import table

    docs = corpus_pipeline.quality_rules(spark, table(spark, DATA, "documents"), DATA)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()}
    assert got == kept_ids(rows, 80, 5)
    assert got < kept_ids(rows, 90, 3)


def test_pairs_of_the_second_round_meet_once(spark, monkeypatch):
    """Texts that share two thirds of their shingles share many signatures; the join of the second round makes each pair about once."""
    rng = random.Random(9)
    rows, families = [], 6
    for f in range(families):
        base = [f"f{f}w{k}" for k in range(1200)]
        for k in range(6):  # 5 of 24 blocks are replaced, others in each text
            own = list(base)
            for block in rng.sample(range(24), 5):
                own[50 * block : 50 * block + 50] = [f"t{f}x{k}b{block}w{j}" for j in range(50)]
            rows.append((10 * f + k, " ".join(own)))
        near = rows[-1][1].split(" ")  # linked with the last one, not with the others
        near[600:640] = [f"n{f}w{j}" for j in range(40)]
        rows.append((10 * f + 6, " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts, crossing = [], jaccard.JaccardJoin.crossing

    def counted(self, index_rows):
        found = crossing(self, index_rows)
        counts.append((index_rows.count(), found.count(), found.distinct().count()))
        return found

    monkeypatch.setattr(jaccard.JaccardJoin, "crossing", counted)
    assert {r.doc_id for r in jaccard.deduplicate(spark, df, 80, width=5).collect()} == kept_ids(rows, 80, 5)
    ((_, made, pairs),) = counts
    assert pairs > 60 and made <= 2 * pairs

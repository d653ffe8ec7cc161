"""Rows without an identifier, and rows that share one, whichever way the fingerprints are joined."""

from __future__ import annotations

import pytest

from ridgeflow.llm import winnow


@pytest.mark.parametrize("limit", (200_000, 0))
def test_null_identifiers_are_judged(spark, monkeypatch, limit):
    monkeypatch.setattr(winnow, "MAX_BROADCAST_ROWS", limit)
    item = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item), (2, "short item here")], "item_id long, text string")
    schema = "doc_id long, text string"
    for text, n_hit, items in ((f"before {item} after", 14, ["1"]), ("a short item here too", 3, ["2"])):
        rows = [(None, text), (7, text), (7, text), (7, "other words"), (8, "clean words"), (None, "clean too"), (9, None), (9, "")]
        for parts in (1, 5):
            df = spark.createDataFrame(rows, schema).repartition(parts)
            got = winnow.contamination(df, bench).collect()
            expected = [(i or 0, n_hit if t == text else 0, items if t == text else []) for i, t in rows]
            assert sorted((r.doc_id or 0, r.n_hit, list(r["items"])) for r in got) == sorted(expected)
            clean = winnow.decontaminate(df, bench).collect()
            assert sorted(map(str, clean)) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in rows if t != text)


@pytest.mark.parametrize("limit", (200_000, 0))
def test_rows_of_one_identifier_are_judged_alone(spark, monkeypatch, limit):
    monkeypatch.setattr(winnow, "MAX_BROADCAST_ROWS", limit)
    monkeypatch.setattr(winnow, "MAX_BROADCAST_IDS", limit)
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([("x", item)], "item_id string, text string")
    df = spark.createDataFrame([(1, item), (1, "w0 w1 w2")], "doc_id long, text string")
    assert sorted((r.n_words, r.n_hit) for r in winnow.contamination(df, bench).collect()) == [(3, 0), (12, 12)]
    assert [r.text for r in winnow.decontaminate(df, bench).collect()] == ["w0 w1 w2"]


@pytest.mark.parametrize("limit", (200_000, 0))
def test_texts_are_read_into_words_once(spark, monkeypatch, limit):
    monkeypatch.setattr(winnow, "MAX_BROADCAST_ROWS", limit)
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(None, item), ("s", "a b")], "item_id string, text string")
    df = spark.createDataFrame([("x", item), ("x", item), ("y", ""), ("y", ""), (None, None)], "doc_id string, text string")
    found = winnow.contamination(df, bench)
    got = sorted((r.doc_id or "", r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found.collect())
    assert got == [("", 0, 0, 0, False), ("x", 12, 12, 0, True), ("x", 12, 12, 0, True), ("y", 0, 0, 0, False), ("y", 0, 0, 0, False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "REGEXP_EXTRACT_ALL" not in plan
    if limit:
        assert plan.count("LogicalRDD [doc_id") == 1

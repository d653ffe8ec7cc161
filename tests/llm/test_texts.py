"""Operators that work text by text, against plain models and on edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeflow.llm import bpe, language, pii, quality, token_count

public_tokenizers = pytest.importorskip("public_tokenizers")

#: Null, empty, blank, repeated and odd texts, and one very long one.
TEXTS = [None, "", " ", "\n\n", "one", "one two", "one two three", "Word. " * 60, "Word. " * 60, "a b c d e f g h. " * 8, "é ß <|endoftext|> x", "x" * 30_000]
SCHEMA = "doc_id long, text string, lang string, n_chars long, n_words string, id string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with columns that clash with those of results."""
    rows = [(i // 2 if i > 6 else i, t, None, 7, "w", "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "No id here. " * 30, "en", None, None, None)], SCHEMA)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    alphabets = ["ab <|endoftext|>'s \n", "thean our", "éèüßİǅ▁ ́ \x1c\x85", "".join(map(chr, range(32, 127))), "   a", "0123456789 +().-", "ab@.0-x "]
    return ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice((0, 1, 5, 40, 300)))) for _ in range(n)]


def base_spans(text):
    text = text or ""
    out = [(m.start(), 1, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 3, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 4, m.end()))
    return sorted(out)


def test_pii_base_spans_stay(spark):
    texts = random_texts(3000) + TEXTS
    weights = pii.train([t for t in texts if t])
    for text, (base, spans) in zip(texts, pii.label(texts, weights), strict=True):
        assert base == base_spans(text)
        assert set(base) <= set(spans)


def test_pii_skip_edges_carry_labels():
    known = [f"call +1 (9{i}8) 555-24{i}5, mail a{i}@b.com, from 10.0.0.{i}, card 4111 1111 1111 1111" for i in range(10)]
    weights = pii.train(known)
    texts = ["call +1 (988) 555-2485 now, later 1-988-555-2485; order 7654321", "a.b@c.example.com or a.b(at)c.example.com", "plain 20240101 and 7654321", None]
    got = [[(t[a:e], pii.KINDS[k - 1]) for a, k, e in spans if (a, k, e) not in base] for t, (base, spans) in zip(texts, pii.label(texts, weights), strict=True)]
    assert got == [[("1-988-555-2485", "phone")], [("a.b(at)c.example.com", "email")], [], []]
    assert pii.masked(texts[0], pii.label(texts[:1], weights)[0][1]) == "call [PHONE] now, later [PHONE]; order 7654321"
    assert pii.label(["nothing +1 (988) 555-2485 and 7654321"], pii.untrained())[0][1] == [(8, 4, 25)]


def test_pii_edge_cases(spark, odd):
    found = pii.detect(spark, odd, pii.learn(odd))
    assert found.count() == odd.count()
    assert {r.base_sha256 for r in found.where("spans = ''").collect()} == {hashlib.sha256(b"").hexdigest()}
    assert pii.detect(spark, odd.limit(0), pii.untrained()).count() == 0
    masked = pii.redact(spark, odd, pii.untrained(), length_column="n_chars")
    assert masked.columns == odd.columns and sorted(masked.collect(), key=str) == sorted(odd.collect(), key=str)


def test_quality_counts(spark, odd):
    rows = quality.judge(odd).collect()
    assert len(rows) == odd.count()
    by_words = sorted((r.n_words, r.word_chars, r.n_repeat_words, r.base_failed) for r in rows)
    assert by_words[:4] == [(0, 0, 0, True)] * 4
    assert (60, 300, 60, True) in by_words
    assert quality.judge(odd.limit(0)).count() == 0


def test_quality_lines(spark):
    clean = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(8))
    menu = "Home | About | News | Shop | Login | Help"
    rows = [(1, clean), (2, clean + "\n" + menu), (3, "\n".join([menu.replace("Home", f"Home{i}") for i in range(12)])), (4, clean.upper()), (5, clean.replace(" ", "!! "))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.char_length("text"))
    kept = {r.doc_id: r for r in quality.clean(df, length_column="n_chars").collect()}
    assert sorted(kept) == [1, 2]
    assert kept[2].text == clean and kept[2].n_chars == len(clean) and kept[1].text == clean
    assert quality.clean(df.limit(0)).columns == df.columns


def test_bpe_is_the_library(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = tokenizers.Tokenizer.from_file(path), bpe.TreeBpe(path)
    for text in random_texts(2000) + TEXTS[1:] + ["ha" * 3000, "é" * 700, "thean" * 200 + "!" * 300]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert " ".join(x[2] for x in own.words(text) if x[0]) == library.decode(ids, skip_special_tokens=False)
    found = bpe.digest(odd, path)
    assert found.count() == odd.count() and found.where("n_tokens = 0").count() == 4
    onto = bpe.encode_onto(odd.drop("id"), path)
    assert onto.where("size(token_ids) <> n_tokens").count() == 0
    taken = bpe.encode_onto(odd.withColumn("n_tokens", F.lit(1)).withColumn("n_tokens_input", F.lit(2)), path)
    assert [c for c in taken.columns if c.startswith("n_tokens")] == ["n_tokens_input", "n_tokens_input_input", "n_tokens"]


def test_bpe_remembers_identifiers_once(monkeypatch):
    """A word is remembered as its identifiers alone, its stem once whatever follows it, and few words are enough."""
    path = public_tokenizers.path("word_bpe_49k.json")
    own = bpe.TreeBpe(path)
    text = "Tezuen. tezuen tezuen, TEZUEN... <|endoftext|> a'b é1 "
    ids = own.word_ids(text * 2)
    assert own._young[b"tezuen"] == ids[1] == ids[0][: len(ids[1])] and all(type(x) is bytes for x in own._young.values())
    monkeypatch.setattr(bpe, "CACHE", 2)
    few = bpe.TreeBpe(path)
    assert few.word_ids(text * 2) == ids and len(few._young) + len(few._old) <= 4
    assert few.words(text)[0] == (len(ids[0]) // 4, ids[0], own.decode(own.encode("Tezuen.")))


def test_bpe_tree_joins():
    """Whole stretches through leaves and joins give what one leaf gives."""
    own = bpe.TreeBpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    for _ in range(40):
        symbols = [rng.choice("thean oursing".replace(" ", "")) for _ in range(rng.randrange(13, 400))]
        symbols[-1] += own.suffix
        assert own._tree(symbols, 0, len(symbols)) == own._leaf(symbols)


def test_token_counts_are_the_library_s(spark, odd):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), token_count.PieceCounter(path)
    for text in random_texts(3000) + TEXTS[1:] + ["ab" * 5000, " " * 100]:
        assert own.count(text) == len(library.encode(text))
    rows = token_count.count_tokens(odd, path, limit=50).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in rows)[:2] == [(0, 0), (0, 0)]
    assert all(r.over_limit == (r.n_tokens > 50) for r in rows)


def test_language_phrases_are_greedy():
    references = {"a": "the cat sat on the mat", "b": "der hund lag auf der matte"}
    model = language.Model(references)

    def parse(symbols, reference):
        count, i, text = 0, 0, list(symbols)
        ref = list(reference)
        inside = lambda part: any(ref[k : k + len(part)] == part for k in range(len(ref)))
        while i < len(text):
            n = 1
            while i + n < len(text) and inside(text[i : i + n + 1]):
                n += 1
            i, count = i + n, count + 1
        return count

    texts = ["the mat", "hund und katze", "zzz", "the hund sat; auf", ""]
    symbols = [model.symbols(t) for t in texts]
    got = model.phrases(symbols)
    for row, s in zip(got, symbols, strict=True):
        for k, name in enumerate(model.languages):
            assert row[k] == parse(s.tolist(), model.symbols(references[name]).tolist())


def test_language_edges(spark, odd):
    assert {r.lang_pred for r in language.identify(spark, odd, {}).collect()} == {"und"}
    rows = language.identify(spark, odd, {"en": "one two three word", "fr": "un deux trois mot"}).collect()
    assert len(rows) == odd.count()
    assert all((r.lang_pred == "und") == (r.score == 0.0) for r in rows if r.lang_pred == "und")
    assert language.identify(spark, odd.limit(0), {"en": "x"}).count() == 0
    assert language.learn(odd) == {} or set(language.learn(odd)) <= {"en"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, all_rows = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.98 * all_rows


def test_schema_of_string_identifiers(spark):
    df = spark.createDataFrame([("k", "some text")], "doc_id string, text string")
    assert isinstance(quality.judge(df).schema["doc_id"].dataType, T.StringType)

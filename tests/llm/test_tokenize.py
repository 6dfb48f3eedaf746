import os
import random

import pytest

from tidemark.llm import tokenize as tk

pytestmark = pytest.mark.skipif(not os.path.exists(tk.DEFAULT_VOCABULARY), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tk.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def ids_of(texts):
    ids, ends = tk.encoder(tk.DEFAULT_VOCABULARY).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_same_ids_as_the_library(reference):
    texts = ["", None, "a", " ", "\n\n \t x", "don't  we'll", "<|endoftext|>", "naïve café", "日本語のテキスト", "👨‍🌾 ok", "x\x00y", "aaaaaaaaa", "1234 5678", "é" * 500, "ab" * 700, "日" * 900, "é" * 40, "퟿"]
    assert ids_of(texts) == [reference(t or "") for t in texts]


def test_rounds_agree_with_the_library(reference):
    rng = random.Random(3)
    enc = tk.BytePairEncoder()
    texts = ["".join(rng.choice("aeiourstlnABé日👨 .\n1") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    ids, ends = enc.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [reference(t) for t in texts]
    assert enc.count_tokens(texts).tolist() == [len(reference(t)) for t in texts]


def test_very_long_words_go_through_rounds_too(reference):
    """Words far longer than the longest token, where pairs are merged at many places of a round."""
    rng = random.Random(5)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = ["a" * 4001, "=" * 5000, "x" + " " * 3000 + "y", some("ab", 3000), some("aab", 3001), some("etaoin", 2000), some("0123456789", 1500), some(".,-=*_#", 2000)]
    texts += [some(["the", "ing", "tion", "aaaa", "ed"], 800), some("日本語中文字テキスト", 900), some("กขคงจฉชซ", 900), some(["aa", "b", "-", "--", "é"], 700) + " " + "ab" * 600]
    assert ids_of(texts) == [reference(t) for t in texts]


def test_forgetting_words_changes_nothing(monkeypatch):
    texts = [f"word{i} and more{i % 7}" for i in range(300)]
    before = ids_of(texts)
    monkeypatch.setattr(tk, "KEPT_WORDS", 10)
    enc = tk.BytePairEncoder()
    got = []
    for t in texts:
        got.append(enc.encode([t])[0].tolist())
    assert got == before


def test_slices_cover_everything():
    texts = ["x" * n for n in (0, 5, 40, 3, 3, 3, 100)] + [None]
    cut = list(tk.slices(texts, 10))
    assert [i for s in cut for i in range(s.start, s.stop)] == list(range(len(texts)))
    assert list(tk.slices([])) == []


def test_round_trip_over_all_documents(spark):
    from tokenizers import Tokenizer

    from tidemark.llm.queries import p6_ids

    sf = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(tk.DEFAULT_VOCABULARY)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in p6_ids(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        assert t.decode(got[k], skip_special_tokens=False) == (text or "")


def test_null_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hi there"), (3, "hi there"), (None, "hi")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["ids"]) for r in tk.token_ids(df, "doc_id", "text").collect()), key=str)
    assert [x for i, x in got if i in (1, 2)] == [[], []] and len(got) == 5
    n = {(r["doc_id"], r["tokens"]) for r in tk.token_counts(df.withColumnRenamed("text", "body"), "body").collect()}
    assert (1, 0) in n and (2, 0) in n and (3, 2) in n
    assert tk.token_ids(df.limit(0), "doc_id", "text").count() == 0

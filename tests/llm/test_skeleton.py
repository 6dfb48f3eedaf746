import pytest

from tidemark.llm import skeleton as sk

S = sk.skeleton
SAME = [
    ("Ｆｕｌｌ", "Full"), ("ﾄﾞﾗｲﾌﾞ", "ドライブ"), ("café", "café"), ("한", "한"), ("a b", "a b"), ("a　b c d\te", "a b c d e"),
    ("sp​am­﻿", "spam"), ("рау", "pay"), ("ΟΚ", "OK"), ("ﬁle ﬂow oﬃce", "file flow office"), ("Kelvin Å", "Kelvin Å"), ("co‐op‑x", "co-op-x"),
    ("a;b·", "a;b·"), ("µm", "μm"), ("a\r\nb\rc", "a\nb\nc"), ("e͏́", "é"), ("ё", "ë"), ("ї", "ï"), ("％／", "%/"), ("⼀", "一"), ("a⁠b⁣c᠎d‎e‌f", "abcdef"),
    ("x‍y", "xy"), ("q̣̇", "q̣̇"),
]
DIFFERENT = ["x2", "x²", "x₂", "x①", "No", "№", "TM", "™", "1/2", "½", "é", "e", "E", "l", "1", "I", "0", "O", "rn", "m", "ß", "ss", "a b", "a\nb", "ab", "ö", "o", "º", "°", "👨‍🌾", "👨🌾", "“", '"', "σ", "ς"]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert S(a) == S(b) and S(S(a)) == S(a)


def test_visible_differences_stay():
    assert len({S(x) for x in DIFFERENT}) == len(DIFFERENT)


def test_table_is_consistent():
    _, prototypes = sk._tables()
    assert not set(prototypes.values()) & {chr(c) for c in prototypes}
    assert all(ord(c) >= 0x80 for c in map(chr, prototypes))
    assert 40 < len(prototypes) < 200


def test_pairs_and_classes(spark):
    rows = [(1, "pay me"), (2, "pаy me"), (3, "pаy me"), (4, "pay me"), (5, "pay ME"), (6, None), (7, ""), (8, "  "), (9, "  "), (10, "​"), (11, "only"), (12, "only")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = sk.looks(d, "doc_id", "text")
    assert {tuple(r) for r in sk.look_alike_pairs(found, "doc_id").collect()} == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    classes = {r["doc_id"]: (r["class_id"], r["class_size"], r["n_forms"]) for r in sk.look_alike_classes(found, "doc_id").collect()}
    assert classes == {i: (1, 4, 3) for i in (1, 2, 3, 4)}
    forms = {r["doc_id"]: r["skeleton"] for r in sk.with_skeleton(d, "doc_id", "text").collect()}
    assert forms[6] is None and forms[7] == "" and forms[3] == "pay me" and len(forms) == 12
    none = sk.looks(d.limit(0), "doc_id", "text")
    assert sk.look_alike_pairs(none, "doc_id").count() == 0 and sk.look_alike_classes(none, "doc_id").count() == 0


def test_very_long_text():
    t = "а" * 2_000_000 + "​"
    assert S(t) == "a" * 2_000_000


def test_p8_against_brute_force_on_the_small_table(spark):
    from tidemark.llm.queries import p8_found

    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if r["text"]]
    forms = [(i, t, S(t)) for i, t in docs if S(t).strip()]
    want = {(min(i, j), max(i, j)) for i, a, x in forms for j, b, y in forms if i != j and x == y and a != b}
    got = [tuple(r) for r in p8_found(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize(("a", "b"), [("\u03bdalue", "value"), ("\u0475alue", "value"), ("\u2163 \u217b", "IV xii"), ("t\u0570e", "the"), ("o\u0578e", "one")])
def test_more_letters_of_the_same_shape(a, b):
    assert S(a) == S(b) and S(S(a)) == S(a)


@pytest.mark.parametrize(("a", "b"), [("ᎪᏢᎬ", "APE"), ("ꓮꓑꓰ", "APE"), ("ⲢⲞⲚ", "PON"), ("Ꭲꓳⲣ", "TOp"), ("Ⲅ", "Γ")])
def test_letters_of_more_scripts(a, b):
    assert S(a) == S(b) and S(S(a)) == S(a)


def test_pairs_of_a_page_with_many_copies(spark):
    """3,000 copies in one form against two others: the work is that of the output, in parts."""
    rows = [(i, "pay me") for i in range(3000)] + [(5000, "pаy me"), (5001, "pаy me"), (5002, "pаy mе"), (1500, "other")]
    found = sk.looks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    whole = {tuple(r) for r in sk.look_alike_pairs(found, "doc_id").collect()}
    parts = [tuple(r) for r in sk.look_alike_pairs(found, "doc_id", split=100).collect()]
    assert len(parts) == len(set(parts)) == 3 * 3000 + 2 and set(parts) == whole


def test_other_forms_stay_apart():
    assert len({S(x) for x in ("-", "\u2013", "\u2212", "\ufe8f", "\u0628", "\u0475\u030f", "v")}) == 7

"""One consistent form for texts that look the same: decompose, replace by prototypes, decompose again.

The prototypes join characters of the same shape only. What a reader can tell apart stays apart: letter case, accents,
digits, super- and subscripts, symbols, words and lines. That is why compatibility decomposition is applied to chosen
kinds of characters instead of to all of them, and why 0 and O, 1 and l and the like have no common prototype.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts (Cyrillic, Greek, Armenian, Coptic, Cherokee, Lisu) with the shape of the letter
# before them, in the usual fonts of these scripts.
LOOK_ALIKES = {
    "a": "а", "c": "сϲⲥ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "і",
    "j": "јϳ", "l": "ӏ", "o": "оοօⲟ", "p": "рⲣ", "q": "ԛ", "s": "ѕ",
    "n": "ո", "v": "νѵ", "u": "ս", "w": "ԝ", "x": "х", "y": "у",
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐⲂ", "C": "СϹᏟꓚⲤ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "ꓝ", "G": "ԌᏀꓖ",
    "H": "НΗᎻꓧⲎ", "I": "ІΙӀꓲⲒ", "J": "ЈͿᎫꓙ", "K": "КΚᏦꓗⲔ", "L": "Ꮮꓡ", "M": "МΜᎷꓟⲘ",
    "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ", "P": "РΡᏢꓑⲢ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅᏚꓢ", "T": "ТΤᎢꓔⲦ",
    "U": "ꓴ", "V": "Ꮩꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫⲬ", "Y": "УҮΥꓬ", "Z": "ΖᏃꓜ",
    "Γ": "ГⲄᎱ", "Π": "ПⲠ", "Φ": "ФⲪ", "μ": "µ",
    "-": "‐‑",
}
#: Ranges whose compatibility decomposition has the same look: Latin digraphs, Roman numerals, ligatures, radicals. Wide and narrow
#: forms are found by the tag of their decomposition instead.
SAME_LOOK = [(0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0x2E9F, 0x2E9F), (0x2EF3, 0x2EF3), (0x2F00, 0x2FD5), (0xFB00, 0xFB06), (0xFB13, 0xFB17)]
#: Characters without any look, by ranges: controls, soft hyphen, joiners, fillers, marks of direction, selectors, tags.
#: C1 controls are left: in texts decoded by a false charset they stand for parts of letters.
INVISIBLE = [(0, 8), (0x0E, 0x1F), (0x7F, 0x7F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200C), (0x200E, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
#: Documents of one form that meet those of another in one task.
SPLIT = 20_000
_ODD_ASCII = re.compile(r"[\x00-\x09\x0b-\x1f\x7f]")
_LINE = re.compile("\r\n|[\r\x0b\x0c\u2028\u2029]")
_PICTURE = "\u2190-\u2bff\U0001f000-\U0001faff"
#: A zero-width joiner shows only between two pictures, which it makes one.
_JOINER = re.compile(f"(?<![{_PICTURE}])\u200d|\u200d(?![{_PICTURE}])")


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str | None], dict[int, str]]:
    """What is replaced before the first decomposition, and the prototypes after it."""
    first: dict[int, str | None] = {9: " "}
    for c in range(0x80, 0x10000):
        tag = unicodedata.decomposition(chr(c)).partition(" ")[0]
        if tag in ("<wide>", "<narrow>"):
            first[c] = unicodedata.normalize("NFKC", chr(c))
        elif unicodedata.category(chr(c)) == "Zs" and c != 0x1680:
            first[c] = " "
    for a, b in SAME_LOOK:
        for c in range(a, b + 1):
            if unicodedata.decomposition(chr(c)):
                first[c] = unicodedata.normalize("NFKC", chr(c))
    for a, b in INVISIBLE:
        first.update(dict.fromkeys(range(a, b + 1)))
    return first, {ord(c): to for to, others in LOOK_ALIKES.items() for c in others}


def _replacer(table: dict[int, str | None]) -> Callable[[str], str]:
    """Replaces the characters of a table. One pass of a character class finds them: texts have few, and looking up every
    character of a text in a dict costs ten times as much."""
    ranges: list[list[int]] = []
    for c in sorted(table):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    found = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")
    to = {chr(c): v or "" for c, v in table.items()}
    return lambda t: found.sub(lambda m: to[m.group()], t)


@lru_cache(maxsize=1)
def _replacers() -> tuple[Callable[[str], str], Callable[[str], str]]:
    first, prototypes = _tables()
    return _replacer(first), _replacer(prototypes)


def skeleton(text: str) -> str:
    """The form that all texts of the same look share; '' for a text without anything visible but spaces."""
    if text.isascii() and not _ODD_ASCII.search(text):
        return text
    first, prototypes = _replacers()
    t = first(_LINE.sub("\n", text) if _LINE.search(text) else text)
    if "\u200d" in t:
        t = _JOINER.sub("", t)
    return unicodedata.normalize("NFD", prototypes(unicodedata.normalize("NFD", t)))


def with_skeleton(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, skeleton): NULL for a null text, '' for an empty one. One row per row, no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array([None if t is None else skeleton(t) for t in b.column(1).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), out], [id_col, "skeleton"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, skeleton string")


def looks(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, look, form): 128-bit digests of the skeleton and of the text itself, of the texts with a visible character.

    Whole texts are digested; what is shuffled later is 40 bytes a document however long its text is. Two different
    texts of a corpus of 10**12 share a digest with a chance below 10**-14.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, look, form = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t and (s := skeleton(t)) and not s.isspace():
                    keep.append(i)
                    look.append(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    form.append(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            ids = b.column(0).take(pa.array(keep, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(look, type=pa.binary()), pa.array(form, type=pa.binary())], [id_col, "look", "form"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, look binary, form binary")


def _several(found: DataFrame) -> DataFrame:
    """(look, form, n, least): the forms of looks that occur in more than one, with their documents counted and their smallest
    id. Aggregates combine before they shuffle, so a page with very many copies is one row of each task."""
    forms = found.groupBy("look", "form").agg(F.count("*").alias("n"), F.min(found.columns[0]).alias("least"))
    ends = forms.groupBy("look").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b").select("look")
    return forms.join(ends, "look", "left_semi")


def look_alike_classes(found: DataFrame, id_col: str) -> DataFrame:
    """(id, class_id, class_size, n_forms): one row per document whose look occurs in other characters as well;
    class_id is the smallest id of the class. `found` is a table of `looks`."""
    forms = _several(found.select(id_col, "look", "form"))
    whole = forms.groupBy("look").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n_forms"))
    return found.join(whole, "look").select(id_col, "class_id", "class_size", "n_forms")


def look_alike_pairs(found: DataFrame, id_col: str, a: str = "doc_a", b: str = "doc_b", split: int = SPLIT) -> DataFrame:
    """Pairs a < b of documents of the same look that are not the same string. `found` is a table of `looks`.

    Pairs are made of forms first, of which every one has a pair of documents to give, and then of the documents of the two
    forms: the work is that of the output, and the copies of one form are never set against one another. The documents of a
    form with many of them are split by a hash of their id into parts of about `split`, which meet in tasks of their own.
    """
    forms = _several(found.select(id_col, "look", "form")).select("look", "form", F.ceil(F.col("n") / split).cast("int").alias("parts"))
    docs = found.select(F.col(id_col).alias("id"), "form").join(forms.select("form", "parts"), "form")
    docs = docs.select("form", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id")
    side = lambda x: forms.select("look", F.col("form").alias(f"f{x}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"p{x}"))
    pairs = side("a").join(side("b"), "look").where("fa < fb").drop("look")
    for x in "ab":
        pairs = pairs.join(docs.withColumnsRenamed({"form": f"f{x}", "part": f"p{x}", "id": f"d{x}"}), [f"f{x}", f"p{x}"])
    return pairs.select(F.least("da", "db").alias(a), F.greatest("da", "db").alias(b)).where(F.col(a) < F.col(b))

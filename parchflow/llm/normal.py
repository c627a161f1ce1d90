"""Problem 3: one consistent form for text that looks the same.

A mapping from character sequences to their plain form is derived once from Unicode data and the
look-alike table below, checked for conflicts, and compiled into a longest-match transducer over
grapheme clusters; one pass rewrites a text. Plain ASCII without control characters is left alone.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchflow.runtime import arrow_map, cut

# Letters of other alphabets with the shape of a Latin letter.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "υ": "u", "κ": "k", "ϲ": "c", "ϳ": "j", "γ": "y", "к": "k",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ı": "i",
}
#: Characters that show nothing; the object character stands for none.
KEPT_CONTROLS = "\n"
INVISIBLE_EXTRA = "͏￼ᅟᅠ឴឵"


def plain_form(cluster: str) -> str:
    """The form of one grapheme cluster, from Unicode data and LOOKALIKES."""
    out = []
    for ch in cluster:
        kind = unicodedata.category(ch)
        if ch in INVISIBLE_EXTRA or kind == "Cf" or (kind == "Cc" and ch not in KEPT_CONTROLS and not ch.isspace()):
            continue
        if 0xFE00 <= ord(ch) <= 0xFE0F:
            continue
        if kind == "Zs" or (ch.isspace() and ch not in KEPT_CONTROLS):
            out.append(" ")
            continue
        how = unicodedata.decomposition(ch)
        if how.startswith(("<wide>", "<narrow>", "<noBreak>")) or (how.startswith("<compat>") and kind[0] == "L"):
            ch = unicodedata.normalize("NFKC", ch).strip(INVISIBLE_EXTRA)
        out.append(ch)
    parts = unicodedata.normalize("NFD", "".join(out))
    return unicodedata.normalize("NFC", "".join(LOOKALIKES.get(c, c) for c in parts))


#: Code points that may have another form: beyond them are ideographs, syllables and private use.
RANGES = (*range(0x80, 0x3200), *range(0xF900, 0x10000), *range(0xE0000, 0xE0200))


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Every single character whose plain form differs; raises if the mapping isn't stable under itself."""
    m = {ch: form for n in RANGES if unicodedata.category(ch := chr(n)) not in ("Cn", "Co", "Mn", "Mc", "Me") and (form := plain_form(ch)) != ch}
    m |= {chr(n): plain_form(chr(n)) for n in range(32) if chr(n) != "\n"} | {"\x7f": ""}
    if conflicts := {k: v for k, v in m.items() if any(c in m and m[c] != c for c in v)}:
        raise ValueError(f"mapping isn't final for {sorted(conflicts)[:9]}")
    if sys.intern("") in m:
        raise ValueError("the empty text has no form")
    return m


MARKS = "̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿"


@lru_cache(maxsize=1)
def transducer() -> re.Pattern:
    """Alternatives from the longest: base with marks (invisible characters may stand between), then one mapped character."""
    singles = sorted(map(ord, mapping()))
    spans: list[list[int]] = []
    for n in singles:
        if spans and n == spans[-1][1] + 1:
            spans[-1][1] = n
        else:
            spans.append([n, n])
    cls = "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans)
    hidden = "­͏​-‏⁠﻿"
    return re.compile(f"[^\\s{MARKS}](?:[{hidden}]*[{MARKS}])+|[{cls}]")


_forms: dict[str, str] = {}
_ASCII_OK = re.compile(r"[\n\x20-\x7e]*\Z").match


def _form(match: re.Match) -> str:
    cluster = match.group()
    form = _forms.get(cluster)
    if form is None:
        if not _forms:
            _forms.update(mapping())
            if cluster in _forms:
                return _forms[cluster]
        form = plain_form(cluster)
        if len(_forms) < 100_000:
            _forms[cluster] = form
    return form


def canonical(text: str | None) -> str | None:
    """The one form of text; null stays null. Texts that look alike get the same form."""
    if not text or (text.isascii() and _ASCII_OK(text)):
        return text
    form = transducer().sub(_form, text)
    # sequences that compose without a mark of MARKS: syllable blocks and vowel signs of other scripts
    return form if unicodedata.is_normalized("NFC", form) else unicodedata.normalize("NFC", form)


LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
CYRILLIC = re.compile(r"[Ѐ-ӿ]")
WORD = re.compile(r"[^\W\d_]+")
TO_CYRILLIC = {v: k for k, v in LOOKALIKES.items() if "Ѐ" <= k <= "ӿ"}


def readable(text: str | None) -> str | None:
    """Like canonical, for reading on: a word keeps Cyrillic letters if it holds one that no Latin letter resembles."""
    if not text or (text.isascii() and _ASCII_OK(text)):
        return text

    def word(m: re.Match) -> str:
        w = m.group()
        return "".join(TO_CYRILLIC.get(c, c) for c in w) if CYRILLIC.search(w) and LATIN.search(w) else w

    form = transducer().sub(_form, text)
    if not CYRILLIC.search(form):
        return form
    form = unicodedata.normalize("NFD", form)
    out = WORD.sub(word, unicodedata.normalize("NFC", form))
    return unicodedata.normalize("NFC", out)


def normalize(blocks: DataFrame, text: str = "raw_text", key: str = "block_id") -> DataFrame:
    """(key, normalized_text), one row per input row; null text gives null, empty text empty."""

    def run(b: dict) -> dict:
        return {key: b[key], "normalized_text": [canonical(t) for t in b[text]]}

    return arrow_map(blocks.select(F.col(key).cast("long").alias(key), text), run, f"{key} long, normalized_text string")


def _keys(b: dict) -> dict:
    out: dict[str, list] = {"id": [], "form": [], "form2": [], "raw": []}
    for i, t in zip(b["id"], b["text"]):
        if i is None or not t or not (c := canonical(t)).strip():
            continue
        h = xxhash.xxh3_128_intdigest(c)
        out["id"].append(i)
        out["form"].append((h >> 64) - (1 << 63))
        out["form2"].append((h & (2**64 - 1)) - (1 << 63))
        out["raw"].append(xxhash.xxh3_64_intdigest(t) - (1 << 63))
    return out


#: Parts that each class is split into, so that a class of very many rows isn't one task.
SALTS = 32


def _classes(blocks: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, variants, classes): (id, form, form2, raw), materialised; (form, form2, raw, rep, n); and, of classes with more than one variant, (form, form2, v, all, class_id).

    Rows of equal form make a class, rows of equal text in it a variant, whose representative is its least id.
    """
    rows = arrow_map(blocks.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), _keys, "id long, form long, form2 long, raw long")
    rows = cut(rows.dropDuplicates())
    variants = rows.groupBy("form", "form2", "raw").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = variants.groupBy("form", "form2").agg(F.count("*").alias("v"), F.sum("n").alias("all"), F.min("rep").alias("class_id")).where("v > 1")
    return rows, variants, classes


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def lookalike_pairs(blocks: DataFrame, text: str = "raw_text", key: str = "block_id") -> DataFrame:
    """(block_id_a, block_id_b): rows whose text differs while its form is equal.

    Rows of equal form make a class, rows of equal text in it a variant. Each row is paired with the least id of every other variant of its class,
    whatever the size of the class: no link between different texts is lost, copies aren't expanded into all pairs; lookalike_classes
    gives what else belongs together. Null, empty and invisible texts belong to no class; repeated rows count once. Only 32 bytes a row are shuffled, and every class in SALTS parts.
    """
    rows, variants, classes = _classes(blocks, text, key)
    reps = cut(variants.join(classes.select("form", "form2"), ["form", "form2"]).select("form", "form2", "rep", F.col("raw").alias("other")))
    part = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    far = part.join(_salted(reps), ["form", "form2", "salt"]).where("raw <> other")
    return far.select(F.least("id", "rep").alias("block_id_a"), F.greatest("id", "rep").alias("block_id_b")).distinct()


def lookalike_classes(blocks: DataFrame, text: str = "raw_text", key: str = "block_id") -> DataFrame:
    """(block_id, class_id, variant_id, variants, links), a row per row that looks like one with another text: class_id is the least id of the class,
    variant_id that of the rows with the same text, links the number of rows that look the same but differ. Rows as in lookalike_pairs."""
    rows, variants, classes = _classes(blocks, text, key)
    of = cut(variants.join(classes, ["form", "form2"]).select("form", "form2", "raw", "class_id", F.col("rep").alias("variant_id"), F.col("v").alias("variants"), (F.col("all") - F.col("n")).alias("links")))
    part = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return part.join(_salted(of), ["form", "form2", "raw", "salt"]).select(F.col("id").alias("block_id"), "class_id", "variant_id", "variants", "links")

"""The operators of the nine problems against brute force and fixed cases, with nulls, empty and long texts, repeats, empty tables and extra columns."""

import datetime
import itertools
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchflow.llm import boilerplate, encoding, language, leakage, mixing, normal, prose, queries, residue, scan

DAY = datetime.datetime(2024, 1, 1)
BLOCK = "block_id long, doc_id long, site string, page_number int, block_ord int, block_type string, raw_text string, arrived_at timestamp, id long, form string, t string, keys string, source string"


def blocks(spark, rows):
    """(block_id, doc_id, site, page, ord, text) rows, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r[:5], "paragraph", r[5], DAY, 1, "x", "y", "z", "w") for r in rows], BLOCK)


def texts(spark, *ts, site="s"):
    return blocks(spark, [(i, i, site, 1, 0, t) for i, t in enumerate(ts)])


def structures(spark, rows):
    return spark.createDataFrame([(*r, DAY, "extra") for r in rows], "doc_id long, strategy string, lang_label string, title string, arrived_at timestamp, chunk string")


ENG = "The old station stood empty during the winter, but the council kept the books in the library. When the river rose, the keeper took the notebook to the workshop."
POR = "A velha estação ficou vazia durante o inverno, mas a câmara guardou os livros na biblioteca. Quando o rio subiu, o guarda levou o caderno para a oficina."
RUS = "Старый вокзал стоял пустым всю зиму, но городской совет хранил книги в большой библиотеке. Когда река поднялась, сторож унёс тетрадь в мастерскую."
ODD = (None, "", " ", "\x00", "\n\n", "​")

# --- 1


def test_prose(spark):
    table = "\n".join(f"item{i} | {i}.50 | {i * 7}" for i in range(20))
    docs = [ENG, POR, RUS, table, "river lamp window garden engine number budget paper Lisa.\n" * 5, "def f(x):\n    return x[0] + 2\n" * 5, "xqzv bnmt rrtk plwqe zxcv hgjk.\n" * 9, POR.encode().decode("latin-1"), *ODD]
    b = texts(spark, *docs)
    b = b.unionByName(b)
    s = structures(spark, [(i, "native_text", None, None) for i in range(len(docs))] * 2)
    assert {r.doc_id for r in prose.not_prose(b, s).collect()} - set(range(8, 14)) == {3, 4, 5, 6}
    reports = spark.createDataFrame([(1, 0, 9, 0.5, DAY), (2, 0, 8, 0.75, DAY + datetime.timedelta(1)), (3, None, 1, None, None)], "report_id long, doc_id long, printable_chars long, readable_ratio double, checked_at timestamp")
    got = {r.doc_id: r for r in prose.statistics(b, s, reports).collect()}
    assert len(got) == len(docs) and got[0].readable_ratio == 0.75 and got[0].prose and got[9].prose is None and got[0].chars == len(ENG)
    assert prose.not_prose(texts(spark), s).count() == 0


def test_damaged_sentences_of_natural_blocks_count(spark):
    """A block of mostly clean sentences keeps those of a wrong encoding, which decide about its document."""
    garbled = RUS.encode("utf-8").decode("latin-1")
    half = ENG + " " + POR + " " + ENG + "\n\n" + garbled
    got = prose.measure([half])
    clean = len(half) - len(garbled)
    assert got["natural"][0] > 0.9 * len(half) > clean
    table = "\n".join(f"{i} | {i}.50 | {i * 7}" for i in range(400))[: (clean + len(half)) // 2]
    b = blocks(spark, [(1, 1, "s", 1, 0, half), (2, 1, "s", 1, 1, table)])
    assert prose.not_prose(b, structures(spark, [(1, "native_text", None, None)])).count() == 0


def test_divergence_is_a_distance():
    p = np.random.default_rng(1).dirichlet(np.ones(5), 6)
    d = prose.divergence(p, p)
    assert np.allclose(np.diag(d), 0, atol=1e-9) and np.allclose(d, d.T) and (d <= 1).all()


def test_counts_equal_a_loop():
    ts = [ENG, POR + "\n\n" + RUS, "", "a1b 22, c!", "x" * 100_000]
    got = prose.measure(ts)
    for i, t in enumerate(ts):
        runs = [list(g) for k, g in itertools.groupby(t, str.isalpha) if k]
        assert got["words"][i] == len(runs) and got["letters"][i] == sum(map(len, runs)) and got["chars"][i] == len(t)


# --- 2


def scans(spark):
    body = "The chamber keeps the notebook after the meeting because the station preserves the survey."
    rows, n = [], 0
    for page in range(1, 6):
        t = [f"A Title of the Report   {page + 10}"] if page > 1 else ["A Title of the Report"]
        for k in range(4):
            t.append(body)
        rows.append([n, 7, "s", page, n, "\n".join(t)])
        n += 1
    rows[0][5] = "The cham-\nber keeps the note-"
    rows[1][5] = "A Title of the Repart   12\nbook after the rneeting"
    rows[2][5] += "\nThe statiori preserves"
    rows.append([n, 7, "s", 5, n, "a follow-\nup and a side-\neffect"])
    rows.append([n + 1, 7, "s", 5, n + 1, None])
    rows += [[100 + i, 8, "s", 1, i, (body + " follow-up side-effect") * 20] for i in range(30)]
    return blocks(spark, rows), structures(spark, [(7, "ocr_fallback", None, "A Title of the Report"), (8, "native_text", None, None), (7, "ocr_fallback", None, "A Title of the Report")])


def test_scanned_pages(spark):
    b, s = scans(spark)
    got = {}
    for r in scan.noise(b.unionByName(b), s).collect():
        got.setdefault(r.block_id, set()).add(r.noise)
    assert got[0] == {"hyphen"} and "misread" in got[1] and got[2] == {"header", "page_no", "misread"} and got[3] == got[4] == {"header", "page_no"} and 5 not in got and 6 not in got
    t = {r.block_id: r.normalized_text for r in scan.paragraphs(b, s).collect()}
    assert t[0] == "The chamber keeps the notebook" and t[2].endswith("The station preserves") and "Title" not in t[3] and t[5] == "a follow-up and a side-effect" and t[6] == ""
    assert scan.noise(texts(spark), s).count() == 0


def test_numbers_and_folds():
    assert [scan.lone_number(x) for x in ("12", "- 3 -", "— 4 —", "Page 5", "[6]", "7 / 20", "xiv", "p. 9", "(1999).", "word", "12 apples are here")] == [12, 3, 4, 5, 6, 7, 14, 9, None, None, None]
    assert scan.header_parts("A title of it   17") == ("A title of it", 17) and scan.header_parts("17   A title of it") == ("A title of it", 17)
    assert scan.fold("Infliience modern") == scan.fold("influence rnodern")


def test_words_go_on_over_any_pages(spark):
    """A word broken at page 31 goes on at page 32, or behind a table and empty pages, and its rest isn't repeated."""
    rows = [(0, 7, "s", 31, 0, "The council keeps the note-"), (1, 7, "s", 32, 1, "book after the meeting"), (2, 7, "s", 63, 2, "It saw the cham-"), (3, 7, "s", 66, 3, "\n".join(f"{i} | {i}" for i in range(60))), (4, 7, "s", 67, 4, "ber in winter")]
    rows += [(100, 8, "s", 1, 0, "the notebook and the chamber " * 30)]
    b, s = blocks(spark, rows), structures(spark, [(7, "ocr_fallback", None, None), (8, "native_text", None, None)])
    assert {tuple(r) for r in scan.noise(b, s).collect()} == {(0, "hyphen"), (2, "hyphen")}
    t = {r.block_id: r.normalized_text for r in scan.paragraphs(b, s).collect()}
    assert t[0] == "The council keeps the notebook" and t[1] == "after the meeting" and t[2] == "It saw the chamber" and t[4] == "in winter"


def asked(spark, b, ws):
    words = scan.collection_words(b)
    share = max(scan.SEEN, -(-words.agg(F.sum("n")).first()[0] // scan.COMMON))
    got = scan.answers(spark.createDataFrame([(w,) for w in ws], "w string"), words, scan.trigram_counts(words), share).collect()
    return {r.w: (r.known, r.fix, r.sure) for r in got}


def test_all_words_count(spark):
    """Words far below a COMMON-th of all words are known and corrected to, and a misreading that recurs isn't, among 50,000 others."""
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    many = [x + y + z for x in syllables for y in syllables for z in syllables[:12]][:50_000]
    rare = "lanterna " * 25 + "estrela " * 5 + "meeting " * 200 + "rneeting " * 6 + "seen " * 4
    b = texts(spark, rare, *(" ".join(many[i : i + 500]) for i in range(0, 50_000, 500))).unionByName(texts(spark, "x").withColumn("raw_text", F.repeat(F.lit("the "), 2_000_000)))
    got = asked(spark, b, ["lantema", "rneeting", "estrela", "lanterna", "seen", "estreia", many[7]])
    assert got["lantema"] == (False, "lanterna", True) and got["rneeting"] == (False, "meeting", True) and got["lanterna"][0] and got["estrela"] == (True, None, False)
    assert got["seen"] == (False, None, False) and not got["estreia"][2]


def random_model(rng):
    return scan.LineModel([[rng.integers(0, 50, n).tolist() for n in scan.SIZES] for _ in range(4)], rng.integers(1, 50, (4, 4)).tolist())


def test_labels_are_the_best_path():
    """Viterbi, which passes over lines that no neighbour could change, against all paths."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        m = random_model(rng)
        seen = [tuple(int(rng.integers(0, n)) for n in scan.SIZES) for _ in range(5)]
        cost = lambda p: sum(m.emission(o)[0][s] for o, s in zip(seen, p)) + sum(m.follows[a][b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert cost(m.label(seen)) == pytest.approx(max(map(cost, itertools.product(range(4), repeat=5))))
        assert m.label([]) == []


def test_the_line_model_decides(spark, sf):
    """On lines whose own features leave it open, neighbours decide; a line that recurs in the middle of pages is body, one at their tops a header."""
    d, s = spark.read.parquet(f"{sf}/blocks.parquet"), spark.read.parquet(f"{sf}/structures.parquet")
    ids = s.where("strategy = 'ocr_fallback'").select("doc_id").distinct()
    m = scan.fit(scan.scanned(d, ids), 8, ids.count())
    one = lambda x: max(range(4), key=m.emission(x)[0].__getitem__)
    open_ = [x for x in itertools.product(*map(range, scan.SIZES)) if m.emission(x)[1] < 0]
    assert any(m.label([a, x, b])[1] != one(x) for x in open_[::97] for a in open_[:400:40] for b in open_[:400:40])
    names = [a + b for a in ("alder", "birch", "cedar", "dogwood", "fir", "gorse", "hazel") for b in ("bank", "bark", "bend", "field", "gate", "hill", "lane", "moor", "pond", "rock", "side", "top", "vale", "wood", "yard", "ford", "mead")]
    each = iter(names)
    text = lambda: "\n".join(f"{w} chamber keeps the notebook after the {w} meeting because of the" for w in itertools.islice(each, 3))
    rows = []
    for page in range(1, 8):
        parts = ["A Title of the Report" if page > 1 else text(), text(), text() + "\nSeen from the old bridge", *(text() for _ in range(3))]
        rows += [(10 * page + i, page, t, 50.0, 50.0 + 90 * i, 500.0, 120.0 + 90 * i) for i, t in enumerate(parts)]
    doc = scan.Document(rows)
    assert {doc.text[q] for q, k in enumerate(m.label(doc.seen)) if k == scan.HEAD} >= {"A Title of the Report"}
    assert [(doc.blocks[x[0]][0], *x[1:3]) for x in doc.marks(m)] == [(10 * p, 0, scan.HEAD) for p in range(2, 8)]


# --- 3


def test_lookalikes(spark):
    base = "A fábrica observou o café com calma."
    same = [base, unicodedata.normalize("NFD", base), base.replace(" ", "\xa0"), base.replace("a", "а"), base.replace("fá", "fá​"), "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in base)]
    other = [base.replace("á", "à"), base.upper(), base.replace(".", "!"), base.replace("café", "cafe"), *ODD]
    b = texts(spark, *same, *other)
    want = {p for p in itertools.combinations(range(6), 2)}
    assert {tuple(r) for r in normal.lookalike_pairs(b.unionByName(b)).collect()} == want
    copies = texts(spark, *[base] * 40, *[same[2]] * 40)
    few = {tuple(r) for r in normal.lookalike_pairs(copies).collect()}
    assert few == {(0, i) for i in range(40, 80)} | {(i, 40) for i in range(40)} and normal.lookalike_pairs(texts(spark)).count() == 0
    assert {normal.canonical(t) for t in same} == {base} and normal.canonical(None) is None and normal.readable("pоrta книга") == "porta книга"


def test_classes_rebuild_all_pairs(spark):
    """Pairs with representatives and membership give every pair of rows that look the same but differ."""
    base = "A fábrica observou o café com calma."
    rows = [base] * 20 + [base.replace(" ", "\xa0")] * 15 + [base.replace("a", "а")] * 3 + ["other"] * 4
    b = texts(spark, *rows)
    got = {r.block_id: r for r in normal.lookalike_classes(b.unionByName(b)).collect()}
    every = {(i, j) for i in got for j in got if i < j and got[i].class_id == got[j].class_id and got[i].variant_id != got[j].variant_id}
    assert every == {(i, j) for i, j in itertools.combinations(range(38), 2) if rows[i] != rows[j]} and {r.variants for r in got.values()} == {3}
    assert all(r.links == sum(i in p for p in every) for i, r in got.items())
    reps = {r.variant_id for r in got.values()}
    assert {tuple(r) for r in normal.lookalike_pairs(b).collect()} == {p for p in every if reps & set(p)}
    assert normal.lookalike_classes(texts(spark)).count() == 0


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_forms_are_stable(t):
    c = normal.canonical(t)
    assert normal.canonical(c) == c and normal.canonical(unicodedata.normalize("NFD", t)) == normal.canonical(unicodedata.normalize("NFC", t))


# --- 4


def test_repeated_lines(spark):
    rows = []
    for d in range(8):
        rows.append((d, d, "s", 1, 0, f"* All rights reserved here {d} *\nA body line number {'abcdefgh'[d] * 9}\nshort one"))
        rows.append((100 + d, d, "s", 1, 1, "ALL RIGHTS RESERVED HERE\nPrinted for reading only" if d < 3 else "nothing of the sort is here" + "xyzuvwst"[d] * 5))
    rows += [(200, 9, None, 1, 0, "All rights reserved here"), (201, None, "s", 1, 0, "All rights reserved here"), (202, 10, "t", 1, 0, "All rights reserved here"), (203, 11, "s", 1, 0, None), (204, 11, "s", 1, 1, "")]
    b = blocks(spark, rows)
    got = {tuple(r) for r in boilerplate.repeated_lines(b.unionByName(b)).collect()}
    assert got == {(d, 1) for d in range(8)} | {(100 + d, 1) for d in range(3)} | {(100 + d, 2) for d in range(3)}
    clean = {r.block_id: r.clean_text for r in boilerplate.without_repeated(b).collect()}
    assert clean[100] == "" and clean[0] == "A body line number aaaaaaaaa\nshort one" and clean[203] is None and clean[202] == "All rights reserved here"
    parts = boilerplate.boilerplate_blocks(b).collect()
    assert len(parts) == 2 and boilerplate.repeated_lines(texts(spark)).count() == 0


def test_components_run_over_blocks(spark):
    """Repeated lines of neighbouring blocks and pages are one component; short lines between them don't count, other lines do."""
    rows = []
    for d in range(4):
        rows += [(10 * d, d, "s", 1, 0, "All rights reserved here\nshort"), (10 * d + 1, d, "s", 1, 1, "12"), (10 * d + 2, d, "s", 2, 2, "--\nPrinted for reading only"), (10 * d + 3, d, "s", 2, 3, f"A body line of its own {'abcd'[d] * 9}\nNever sold in any shops")]
    b = blocks(spark, rows)
    sizes = sorted(r.lines for r in boilerplate.boilerplate_blocks(b.unionByName(b)).collect())
    assert sizes == [1, 2, 2]
    assert {tuple(r) for r in boilerplate.repeated_lines(b).collect()} == {(10 * d + i, n) for d in range(4) for i, n in ((0, 1), (2, 2), (3, 2))}


# --- 5


def test_languages(spark):
    engines = spark.createDataFrame([(1, [" por", "ENG", "osd"]), (2, ["rus", "eng", None])], "engine_id int, available_languages array<string>")
    assert language.available(engines) == ["eng", "por", "rus"]
    rows = [(i, i, "s", 1, 0, (ENG, POR, RUS)[i % 3]) for i in range(90)] + [(200, 0, "s", 1, 1, POR), (201, 1, "s", 1, 1, "xqzv bnmt rrtk plwqe zxcv hgjk qqq."), (202, 3, "s", 1, 1, "# A heading of six words here"), (203, 4, "s", 1, 1, None)]
    s = structures(spark, [(i, "native_text", ("eng", "pt-BR", "Russian")[i % 3] if i > 5 else (None, "??", "")[i % 3] if i > 2 else ("EN_us", "Portuguese+rus", "ru")[i], None) for i in range(90)])
    b = blocks(spark, rows)
    got = {tuple(r) for r in language.unlabelled(b.unionByName(b), s, engines).collect()}
    assert got == {(3, "eng"), (4, "por"), (5, "rus"), (200, "por")}
    docs = {r.doc_id: r for r in language.document_languages(b, s, engines).collect()}
    assert docs[0].langs == ["eng", "por"] and docs[2].lang == "rus" and 0 < docs[2].confidence <= 1 and len(docs) == 90
    assert language.unlabelled(texts(spark), s, engines).count() == 0
    assert language.label_codes("por+RU") == ["por", "rus"] and language.label_codes("und") == [] and language.label_codes(None) == []


def test_trigram_norms_equal_a_loop():
    s = language.sentences([ENG, RUS])
    idf = np.arange(language.BUCKETS) % 7 + 1.0
    for i, n in enumerate(language.norms(s, idf)):
        g = s.gram[s.of == i]
        tf = {k: (g == k).sum() for k in set(g.tolist())}
        assert n == pytest.approx(sum((v * idf[k]) ** 2 for k, v in tf.items()) ** 0.5)


# --- 6

LATIN = "A reunião substitui o índice – não há solução às três."
PAIRS = [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("utf-8", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850")]


@pytest.mark.parametrize(("true", "read"), PAIRS)
def test_round_trip(true, read):
    text = LATIN.replace("–", "-") if true == "cp850" else LATIN
    garbled = text.encode(true).decode(read, "replace")
    if "�" in garbled:
        garbled = "".join(bytes([b]).decode(read) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode(true))
    new, bad = encoding.restore(garbled)
    assert bad and new == text


def test_other_encodings():
    twice = LATIN.encode().decode("cp1252", "ignore").encode().decode("latin-1")
    assert encoding.restore(twice)[1]
    for true, read in (("cp1251", "latin-1"), ("koi8_r", "cp1251"), ("utf-8", "latin-1")):
        assert encoding.restore(RUS.encode(true).decode(read)) == (RUS, True)
    assert encoding.restore(POR.encode("utf-16-le").decode("latin-1")) == (POR, True) and encoding.restore("a�b")[1]
    for fine in (LATIN, RUS, "naïve café façade (© 2016, ½ £24)", "com-\nitê ¬\nx", "pоrta sоb", "ｆｕｌｌ width", "a\x07b\x00c", "в\xa0тишине", "мЕСТНЫЙ КОМИТЕТ ЗАЩИЩАЕТ", "obse¬\nrvou", "il est là « oui »", None, ""):
        assert not encoding.restore(fine)[1], fine


def test_mixed_damage():
    """Passages of two page pairs, and odd words of other origin, don't keep the rest from being restored."""
    one, two = "A reunião substitui o índice, não há solução às três.", "A câmara não guardou a última lição."
    garbled = one.encode("cp1252").decode("mac_roman") + "\n" + two.encode("cp850").decode("cp1252")
    assert encoding.restore(garbled) == (one + "\n" + two, True)
    new, bad = encoding.restore(one.encode("cp1252").decode("mac_roman") + " O senhor Dvořák chegou.")
    assert bad and new == one + " O senhor Dvořák chegou." and not encoding.restore("O senhor Dvořák chegou.")[1]


def test_garbled(spark):
    b = texts(spark, LATIN, LATIN.encode().decode("latin-1"), *ODD, LATIN.encode().decode("latin-1") * 3000)
    assert {r.block_id for r in encoding.garbled(b.unionByName(b)).collect()} == {1, 8} and encoding.garbled(texts(spark)).count() == 0


@pytest.mark.parametrize("text", [POR, RUS])
@pytest.mark.parametrize("read", ["cp866", "koi8_r", "cp1252", "cp1251", "cp437"])
def test_multibyte_spans_by_any_page(text, read):
    m = encoding.to_byte(read)
    back = {v: k for k, v in m.items()}
    wrong = "".join(back.get(x, chr(x)) for x in text.encode())
    assert encoding.restore(wrong) == (text, True)
    for _ in range(4 * (read == "cp1252")):
        wrong = wrong.encode().decode("latin-1")
    assert encoding.restore(wrong)[0] == text


def test_sure_only_if_all_words_are_known(spark):
    b = texts(spark, *["você já não"] * 30, "vocˆ nÆo", "vocˆ Rocha nÆo zˆbra", POR.encode().decode("cp1252", "replace").replace("Ã£", "Ã\ufffd", 1), POR.encode().decode("latin-1"))
    got = {r.block_id: (r.restored_text, r.restorable, r.path) for r in encoding.restored(b).collect()}
    assert got[30] == ("você não", True, "single_byte") and not got[31][1] and not got[32][1] and got[32][2].startswith("lost") and got[33] == (POR, True, "multibyte")


# --- 7


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, nb_format string, t string, item_id string")


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    item = [[f"w{k}" for k in rng.integers(0, 60, 40)] for _ in range(12)]
    docs = []
    for d in range(60):
        w = [f"w{k}" for k in rng.integers(0, 60, 80)]
        for i in rng.integers(0, 12, 2):
            a, n, at = int(rng.integers(0, 28)), int(rng.integers(9, 16)), int(rng.integers(0, 60))
            w[at:at] = item[i][a : a + n]
        docs.append(w)
    grams = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    want = {(d, i) for d, w in enumerate(docs) for i, x in enumerate(item) if grams(w) & grams(x)}
    D = documents(spark, [(d, " ".join(w), "s", "percent") for d, w in enumerate(docs)] + [(900, None, None, None), (901, "", None, None)])
    items = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(item)] + [(50, None), (51, "too short")], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked(D.unionByName(D), items).collect()} == want and want
    assert leakage.leaked(D.limit(0), items).count() == 0 and leakage.leaked(D, items.limit(0)).count() == 0


def test_tiles_and_escapes():
    item = " ".join(f"word{i}" for i in range(30))
    w = item.split()
    ix = leakage.Index([(1, item)], 12)
    moved = " ".join(w[15:] + ["between"] + w[:15])
    assert ix.tiles(moved) == [(1, 2, 30, 15)] and ix.tiles(item.upper()) == [(1, 1, 30, 30)] and ix.tiles("") == []
    assert ix.tiles("# **" + "**\\n# *".join(w) + "*") == [(1, 1, 30, 30)] and ix.tiles(" ".join(w[:11])) == []
    assert leakage.Index([(2, "ação " * 12)], 12).tiles("a\\u00e7\\u00e3o\\n" * 12)[0][0] == 2


# --- 8


def test_mix(spark):
    rows = [(i, "word " * (1 + i % 7), ("a ", "A", "b")[i % 3], None) for i in range(3000)] + [(9000 + i, "tiny text", "c", None) for i in range(4)] + [(9100, "free", "d", None), (9101, None, "a", None), (9102, "x", None, None)]
    targets = spark.createDataFrame([("a", 0.5, 3), ("B", 0.3, 2), ("c", 0.2, 5), ("none", 0.1, 9)], "source string, target_share double, max_repeats int")
    D = documents(spark, rows)
    got, report = mixing.mix(D.unionByName(D.limit(5)), targets)
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"a", "b", "c", "d", "none", None} and r["c"].most_repeats == 5 and r["c"].copies == 20 and r["none"].copies == r["d"].copies == 0
    assert sum(x.share for x in r.values()) == pytest.approx(1) and r["a"].share / r["b"].share == pytest.approx(5 / 3, rel=0.05) and r["a"].most_repeats <= 3
    assert got.groupBy("doc_id").count().where("count > 1").count() == 0 and not mixing.mix(D.limit(0), targets)[0].count()


def test_systematic_sample_is_even(spark):
    sized = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("tokens"))
    rate = spark.createDataFrame([("s", 1.3)], "source string, rate double")
    for size in (100, 10_000):
        c = mixing.copies(sized, rate, bucket_rows=size).groupBy().agg(F.sum("copies"), F.min("copies"), F.max("copies")).first()
        assert abs(c[0] - 6500) <= 1 and (c[1], c[2]) == (1, 2)


# --- 9


def test_residue(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet")
    bad = ["# %% [markdown]\n# Welcome to {{ project }}\n\nThis notebook was made by {{ author }} on {{ date }}.", "# %% [markdown]\nError 404\nNot Found", "# %% [code]\n# YOUR CODE HERE\nraise NotImplementedError()", "# %% [markdown]\nYou need to enable JavaScript to run this app.", "# %% [markdown]\nLorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor."]
    good = ["# %% [markdown]\n" + ENG, "# %% [markdown]\nThe page says 404 Not Found.\n\n# %% [markdown]\n" + ENG + "\n# %% [code]\nimport numpy as np\nx = np.ones(4)", "", " ", None]
    extra = spark.createDataFrame([(i, t, "percent") for i, t in enumerate(bad + good)], "doc_id long, text string, nb_format string")
    m = residue.fit(base)
    got = {r.doc_id: r for r in residue.residue_report(extra, m).collect()}
    assert [got[i].exclude for i in range(10)] == [True] * 5 + [False] * 5
    assert residue.residue_only(base.limit(0)).count() == 0
    assert residue.judge(m, "not json {", "ipynb")[1] in (True, False) and residue.judge(m, "word " * 200_000, None) is not None


def test_residue_share_is_of_all_lines(spark, sf):
    """The share doesn't hang on the order of lines."""
    m = residue.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    filler = ["Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore."] * 20
    own = [ENG.split(".")[0] + "."]
    a, b = (residue.judge(m, "# %% [markdown]\n" + "\n".join(x), "percent") for x in (own + filler, filler + own))
    assert a == b and 0.5 < a[0] < 1 and not a[1]
    g = residue.Grams(["ab", "Page 404: {{ x }}", "", "x" * 200])
    assert g.size.tolist() == [1, 13, 1, 199] and len(g.bucket) == 214 and residue.Grams(["y", "Page 503: {{ z }}"]).bucket[1:].tolist() == g.bucket[1:14].tolist()


def test_residue_models_are_of_all_notebooks(spark):
    """Filler that one notebook of thousands holds is known to the model, whatever the notebook's id."""
    filler = {800 * i + 7: f"Zq{c}xv wk{c}qz vj{c}xq kz{c}wv qx{c}jk jv{c}zw." for i, c in enumerate("bcdfghmnpr")}
    rows = [(i, filler.get(i, "For this reason, the solution of the problem is in the table."), "percent") for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, nb_format string")
    m = residue.fit(df)
    assert all((m.ratio[residue.Grams([x]).bucket] > 0).all() for x in filler.values())
    assert {r.doc_id for r in residue.residue_only(df).collect()} == set(filler)
    assert (residue.fit(df.withColumn("doc_id", -F.col("doc_id")).repartition(3)).ratio == m.ratio).all()


def test_residue_encoded_data_and_blocks():
    """Encoded data is one gram, however much of it there is, and its characters stay; no result hangs on how texts are taken together."""
    image = "data:image/png;base64," + "Zx9+kQ/7Ab" * 20
    assert residue.shape(image) == "\x01data:image/png;base64," + "\x04" * 200 + "\x03" and "\x04" not in residue.shape("=" * 200 + "a1" * 50 + " " + ENG)
    lines = [ENG[i : i + 90] for i in range(60)] * 30
    g = residue.Grams(lines)
    assert len(g.hashed) > 3 * residue.BLOCK and g.bucket.tolist() == [b for x in lines for b in residue.Grams([x]).bucket.tolist()]
    m = residue.Model(residue.counts(residue.seeds()).astype(float), residue.counts(lines).astype(float))
    texts = ["Error 404", None, ENG * 2000, "", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.\n" + ENG, "Coming soon"] * 3
    assert [j - i for i, j in residue.spans(texts)] == [3, 6, 6, 3] and residue.judged(m, texts, [None] * 18) == [residue.judge(m, t, None) for t in texts]


def test_queries_run(spark, sf):
    for name, q in queries.QUERIES.items():
        df = q(spark, sf)
        rows = df.collect()
        if name.endswith("_found"):
            assert len(rows) == len(set(rows)) and all(v is not None for r in rows for v in r), name

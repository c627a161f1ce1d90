"""Problem 1: statistics of each document's text, and whether it is natural prose.

The text is cut into sentence-like segments. A segment has a distribution of word classes (function words, other
words by their case) and one of character classes; both are compared with profiles of prose in each language and of
other structures by Jensen-Shannon divergence, and the nearest profile is the segment's structure. A document is
prose if at least half of the characters of its text lie in segments of prose.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchflow.llm import chars
from parchflow.llm.chars import DIGIT, LOWER, NEWLINE, SYMBOL, UPPER, Batch
from parchflow.runtime import arrow_map

# Function words by language.
FUNCTION_WORDS = {
    "por": "a o as os um uma de do da dos das e em no na com sem por para sobre entre contra após durante mas que quando porque embora enquanto já até não se",
    "eng": "the a an of in on at to and or with without by for about between against after during before but that when because although while since is was",
    "spa": "el la los las un una de del y en con sin por para sobre entre contra tras durante pero que cuando porque aunque mientras ya hasta no se su",
    "fra": "le la les un une de du des et en dans avec sans par pour sur entre contre après pendant mais que quand parce bien tandis puisque l",
    "deu": "der die das den dem ein eine und in im mit ohne durch für über zwischen gegen nach während aber dass wenn weil obwohl da auf hinter um bis",
    "ita": "il lo la gli i le un una di del e in con senza per sopra tra contro dopo durante ma che quando perché benché mentre poiché fino",
    "rus": "и в во на с со без по для о об про между против после сквозь через спустя под за но что когда потому хотя пока так как до не тем",
}
# Samples of each structure, written for this project; the profiles are counted from them.
SAMPLES = {
    "prose": {
        "por": "A velha estação ficou vazia durante o inverno, mas a câmara guardou os livros na biblioteca. Quando o rio subiu, Ana Duarte levou o caderno para a oficina e não voltou até ao amanhecer (1923)? O relatório sobre a fábrica foi escrito por Rui Prado sem pressa.",
        "eng": "The old station stood empty during the winter, but the council kept the books in the library. When the river rose, Anna Duart took the notebook to the workshop and did not return before sunrise (1923)? The report about the factory was written by Roy Prade without haste.",
        "spa": "La vieja estación quedó vacía durante el invierno, pero el comité guardó los libros en la biblioteca. Cuando subió el río, Ana Duarte llevó el cuaderno al taller y no volvió hasta el amanecer (1923)? El informe sobre la fábrica fue escrito por Raúl Prado sin prisa.",
        "fra": "La vieille gare resta vide pendant l’hiver, mais le conseil garda les livres dans la bibliothèque. Quand la rivière monta, Anne Duart porta le cahier à l’atelier et ne revint pas avant le matin (1923)? Le rapport sur la fabrique fut écrit par Rémi Prade sans hâte.",
        "deu": "Die alte Haltestelle blieb während des Winters leer, aber der Rat bewahrte die Bücher in der Bibliothek. Als das Wasser stieg, trug Anna Duart das Heft in die Werkstatt und kam bis zum Morgen nicht zurück (1923)? Der Bericht über die Fabrik wurde von Ralf Prade ohne Eile geschrieben.",
        "ita": "La vecchia stazione restò vuota durante l’inverno, ma il comitato conservò i libri nella biblioteca. Quando il fiume salì, Anna Duarte portò il quaderno in bottega e non tornò fino all’alba (1923)? Il rapporto sulla fabbrica fu scritto da Remo Prade senza fretta.",
        "rus_plain": "Местный комитет бережёт тихий сад, пока главный завод молчит. Каменный мост каждый год заменяет Анна Дуарт, хотя соседний дом медленно строил Роман Праде.",
        "rus": "Старый вокзал стоял пустым всю зиму, но городской совет хранил книги в большой библиотеке. Когда река поднялась, Анна Дуарт унесла тетрадь в мастерскую и не вернулась до рассвета (1923)? Новый отчёт про главный завод медленно писал Роман Праде.",
    },
    "headline": {"all": "Winter after the old bridge\nRiver Report\nEstação sem o orçamento\nИюльский отчёт\nBy the editors · 04/05/2021\nShare this page: Reader"},
    "list": {"all": "- bread butter cheese\n- milk sugar\n- green tea honey salt\n- рыба масло хлеб\n- leite pão queijo azeite", "lines": "library north .......... 14\nharbour street .................. 203\nmuseum garden hall ........ 77"},
    "table": {"all": "item1 | price2 | stock3\nbread Alba | 1204.50 | 88\nmilk Torre | 47% | 2310\ntea Norte | — | 15.20", "wide": "item1   price2   stock3\nbread Alba   1204.50   88\nmilk Torre   47%   2310", "semi": "item;price;stock\nbread Alba;1204.50;88\nmilk Torre;47%;2310"},
    "code": {"all": "def load(path, n=3):\n    rows = [x * 2 for x in path if x > n]\n    return rows\nconst a = [];\na.push(b[0]);\n}\nfor i in range(22):\n    print(i, 'x')"},
    "menu": {"all": "Home > News > Sports > World Cup > Tables\nAbout | Contact | Help | Login | Register\nInício » Livros » Autores » Preços / Ajuda"},
    "salad": {"all": "river cheese lamp window garden engine number budget paper Lisa.\nponte janela livro cadeira pão rio café mesa vidro Marta.\nмост окно книга стул хлеб река стол лампа бумага", "commas": "river blue, river blue, river blue, lamp, window, garden, river blue"},
    "random": {"letters": "xqzv bnmt rrtk plwqe zxcv hgjk qwrt bvcx mnbv lkjh gfdsq pzxw", "mixed": "4vG9XLWDNwZJYxXnaS6dQkVZWFnkyeTBmNxxbCtWEzKbcWLNfmXpzMx/9iWXp36NkPFLXTvaa+884", "hex": "dc 24 0a e5 e7 c6 26 4d 37 52 07 1f c0 ac 27 81 1d", "marks": "^[3{$8|~%+]*&=9<>\\/@#7}_*2{^$[%|~8+=&]9>"},
}
WORD_CLASSES = 5  # function word, other in lower case, capitalised, in capitals, next to a digit
WEIGHT = 0.65  # of the words' divergence; the rest is the characters'


@lru_cache(maxsize=1)
def known() -> np.ndarray:
    return chars.word_hashes(sorted({w for v in FUNCTION_WORDS.values() for w in v.split()}))


class Segments:
    """Counts of word and character classes of the segments of a batch."""

    def __init__(self, b: Batch):
        self.of = chars.sentences(b)
        n = int(self.of[-1]) + 1 if len(self.of) else 0
        self.n = n
        begin, end = b.words()
        if not n:
            self.row, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
            self.words, self.chars = np.zeros((0, WORD_CLASSES)), np.zeros((0, chars.CLASSES))
            self.begin = begin
            return
        self.size = np.bincount(self.of, minlength=n)
        self.row = b.row[np.flatnonzero(np.diff(self.of, prepend=-1))]
        self.chars = np.bincount(self.of * chars.CLASSES + b.cls, minlength=n * chars.CLASSES).reshape(n, -1)
        kind = np.ones(len(begin), np.int64)
        if len(begin):
            kind[b.cls[begin] == UPPER] = 2
            kind[(b.cls[begin] == UPPER) & (end - begin > 1) & (b.cls[np.minimum(begin + 1, len(b.cls) - 1)] == UPPER)] = 3
            left = (begin > 0) & (b.cls[np.maximum(begin - 1, 0)] == DIGIT)
            right = (end < len(b.cls)) & (b.cls[np.minimum(end, len(b.cls) - 1)] == DIGIT)
            kind[left | right] = 4
            self.fw = chars.isin_sorted(b.hashes(begin, end), known())
            kind[self.fw & (kind != 4)] = 0
        self.begin = begin
        self.words = np.bincount(self.of[begin] * WORD_CLASSES + kind, minlength=n * WORD_CLASSES).reshape(n, -1)


def _shares(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(1, keepdims=True), 1)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence of each row of p from each row of q, in bits; rows that are all 0 are 1 away."""
    out = np.empty((len(p), len(q)))
    entropy = lambda x: -(x * np.log2(np.where(x > 0, x, 1))).sum(-1)
    hp = entropy(p)
    for j, r in enumerate(q):
        m = (p + r) / 2
        out[:, j] = entropy(m) - (hp + entropy(r)) / 2
    out[p.sum(1) == 0] = 1
    return out


@lru_cache(maxsize=1)
def profiles() -> tuple[list[str], np.ndarray, np.ndarray]:
    """(structure, word classes, character classes) of each sample."""
    names, words, marks = [], [], []
    for structure, samples in SAMPLES.items():
        for language, text in samples.items():
            s = Segments(Batch([text]))
            names.append(f"prose_{language}" if structure == "prose" else structure)
            words.append(s.words.sum(0))
            marks.append(s.chars.sum(0))
    return names, _shares(np.array(words, float)), _shares(np.array(marks, float))


def nearest(s: Segments) -> np.ndarray:
    """Index of the nearest profile of each segment."""
    _, words, marks = profiles()
    d = WEIGHT * divergence(_shares(s.words.astype(float)), words) + (1 - WEIGHT) * divergence(_shares(s.chars.astype(float)), marks)
    return d.argmin(1)


MIN_WORDS = 4


@lru_cache(maxsize=1)
def prose_profiles() -> np.ndarray:
    return np.array([n.startswith("prose") for n in profiles()[0]])


def natural(s: Segments) -> np.ndarray:
    """Whether a segment is nearest to prose and has words enough for a sentence."""
    return prose_profiles()[nearest(s)] & (s.words.sum(1) >= MIN_WORDS)


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Counts of each text: characters, those of natural sentences, words, letters of words, function words, symbols, lines,
    lines that end a sentence. Text that isn't all natural as it stands is judged again without damage to its characters."""
    from parchflow.llm.encoding import restore
    from parchflow.llm.normal import readable

    b = Batch(texts)
    s = Segments(b)
    good = natural(s)
    rows = len(texts)
    total = b.lens.copy()
    nat = np.bincount(s.row, weights=np.where(good, s.size, 0), minlength=rows) if s.n else np.zeros(rows)
    visible = np.bincount(b.row, minlength=rows)
    nat = np.where(visible > 0, nat * total / np.maximum(visible, 1), 0)
    doubt = [i for i in np.flatnonzero(nat < total).tolist() if not texts[i].isascii()]
    again = [(i, t) for i in doubt if (t := readable(restore(texts[i])[0])) != texts[i]]
    if again:
        b2 = Batch([t for _, t in again])
        s2 = Segments(b2)
        share = np.bincount(s2.row, weights=np.where(natural(s2), s2.size, 0), minlength=len(again)) / np.maximum(np.bincount(b2.row, minlength=len(again)), 1)
        for (i, _), x in zip(again, share):
            nat[i] = max(nat[i], x * total[i])
    per = lambda mask: np.bincount(b.row[mask], minlength=rows)
    letter = (b.cls == LOWER) | (b.cls == UPPER)
    line_end = np.zeros(len(b.cls), bool)
    if len(b.cls):
        line_end[-1] = True
        line_end[:-1] = (b.cls[1:] == NEWLINE) | b.starts()[1:]
    wrow = b.row[s.begin]
    return {
        "chars": total, "natural": np.rint(nat).astype(np.int64), "words": np.bincount(wrow, minlength=rows), "letters": per(letter), "symbols": per(b.cls == SYMBOL), "digits": per(b.cls == DIGIT),
        "function_words": np.bincount(wrow[s.fw], minlength=rows) if len(s.begin) else np.zeros(rows, np.int64),
        "lines": per(line_end & (b.cls != NEWLINE)), "ended_lines": per(line_end & (b.cls == chars.END)),
    }


COUNTS = ("chars", "natural", "words", "letters", "function_words", "symbols", "digits", "lines", "ended_lines")


def block_counts(blocks: DataFrame, text: str = "raw_text") -> DataFrame:
    """The counts of each block with an id and a document; null text counts as empty, a repeated block once."""

    def run(b: dict) -> dict:
        got = [measure(b["t"][i:j]) for i, j in chars.pieces(b["t"])]
        return {"doc_id": b["doc_id"], "block_id": b["block_id"]} | {k: np.concatenate([m[k] for m in got]).tolist() if got else [] for k in COUNTS}

    rows = blocks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("block_id").cast("long").alias("block_id"), F.col(text).alias("t")).where("doc_id is not null and block_id is not null")
    return arrow_map(rows, run, "doc_id long, block_id long, " + ", ".join(f"{c} long" for c in COUNTS)).dropDuplicates(["block_id"])


def document_counts(blocks: DataFrame) -> DataFrame:
    return block_counts(blocks).groupBy("doc_id").agg(F.count("*").alias("blocks"), *(F.sum(c).alias(c) for c in COUNTS))


def not_prose(blocks: DataFrame, structures: DataFrame) -> DataFrame:
    """Distinct doc_id of the documents in structures of whose characters less than half are in natural sentences; documents without text are none."""
    return document_counts(blocks).where("2 * natural < chars").join(structures.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")


def statistics(blocks: DataFrame, structures: DataFrame, reports: DataFrame) -> DataFrame:
    """A row per document in structures: its statistics, next to readable_ratio and printable_chars of its latest report, and prose (null without text)."""
    last = Window.partitionBy("doc_id").orderBy(F.col("checked_at").desc_nulls_last(), F.col("report_id").desc_nulls_last())
    r = reports.where("doc_id is not null").withColumn("_k", F.row_number().over(last)).where("_k = 1").select("doc_id", "readable_ratio", "printable_chars")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    d = structures.select("doc_id").where("doc_id is not null").distinct().join(document_counts(blocks), "doc_id", "left").join(r, "doc_id", "left")
    return d.select(
        "doc_id", "blocks", "chars", "words", "readable_ratio", "printable_chars", ratio("letters", "words").alias("mean_word_length"), ratio("symbols", "chars").alias("symbol_ratio"), ratio("digits", "chars").alias("digit_ratio"),
        ratio("function_words", "words").alias("common_word_ratio"), ratio("ended_lines", "lines").alias("ended_line_ratio"), ratio("natural", "chars").alias("natural_ratio"), F.when(F.col("chars") > 0, 2 * F.col("natural") >= F.col("chars")).alias("prose"),
    )

"""Problem 5: the language of each document and of each segment in another language.

Character trigrams of a sentence, weighted by TF-IDF and normalised, are compared by cosine with several clustered
centroids of each language; a sentence too far from all of them has none. The centroids are fitted once on at most about
SAMPLE_BLOCKS blocks of each language whose documents bear that plain label (the documented bound of a classifier's training sample);
sentences whose label disagrees with the nearest mean of all labels are left out before clustering, repeated ones count once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchflow.llm import chars
from parchflow.llm.chars import END, LOWER, NEWLINE, UPPER, Batch
from parchflow.llm.encoding import restore
from parchflow.llm.normal import readable
from parchflow.llm.prose import SAMPLES
from parchflow.runtime import arrow_map

SAMPLE_BLOCKS, SAMPLE_CHARS = 1_500, 20_000  # training blocks of a language, and characters of one
BUCKETS = 8192  # of hashed trigrams
CLUSTERS, ROUNDS = 3, 8
REJECT = 0.10  # cosine below which a sentence has no language
MARGIN = 0.12  # of the cosine: a sentence no nearer than that to one language than to the next has none
MIN_WORDS = 6

# Notations of languages: three-letter code, two-letter code, English name.
NOTATIONS = """por pt portuguese;eng en english;spa es spanish;fra fr french;deu de german;ita it italian;rus ru russian;nld nl dutch;cat ca catalan;pol pl polish;ukr uk ukrainian
swe sv swedish;dan da danish;nor no norwegian;fin fi finnish;ces cs czech;hun hu hungarian;ron ro romanian;tur tr turkish;ell el greek;bul bg bulgarian;hrv hr croatian;srp sr serbian"""
CODES = {n: row.split()[0] for row in re.split("[;\n]", NOTATIONS) for n in row.split()} | {"fre": "fra", "ger": "deu", "dut": "nld", "cze": "ces", "rum": "ron", "gre": "ell"}


def label_codes(label: str | None) -> list[str]:
    """The languages of a label in any notation; nothing for a missing or meaningless one."""
    out = []
    for part in (label or "").lower().split("+"):
        part = part.strip()
        code = CODES.get(part) or CODES.get(re.split("[-_]", part)[0])
        if code and code not in out:
            out.append(code)
    return out


BROKEN = re.compile(r"[-‐­¬][ \t]*\n[ \t]*(?=[^\W\d_])")
MARKER = re.compile(r"[ \t]*(?:\d{1,3}[.)]|\(?[a-z]\)|[ivx]{1,4}\)|[-*•◦▪+])[ \t]+\S")


def body(text: str | None) -> str:
    """text without damage to characters, with broken words joined, without list items, lines that weren't wrapped set apart."""
    if not text:
        return ""
    if not text.isascii() or "\x00" in text:
        text = readable(restore(text)[0])
    text = BROKEN.sub("", text)
    if "\n" not in text:
        return text
    lines = text.split("\n")
    marked = [bool(MARKER.match(x)) for x in lines]
    out = []
    for i, x in enumerate(lines):
        if marked[i] and (len(lines) == 1 or x.rstrip()[-1:] not in ".!?*" or (i and marked[i - 1]) or (i + 1 < len(lines) and marked[i + 1])):
            out.append("\n")
            continue
        out.append(x)
        if i + 1 < len(lines):
            after = lines[i + 1]
            word = after.split(" ", 1)[0]
            if after[:1].isupper() and len(x) + 1 + len(word) < 0.8 * len(after):
                out[-1] += "\n"
    return "\n".join(out)


@dataclass
class Sentences:
    """Full sentences of a batch and their trigrams."""

    row: np.ndarray  # text of each sentence
    size: np.ndarray  # characters
    of: np.ndarray  # sentence of each trigram, ascending
    gram: np.ndarray  # bucket of each trigram
    n: int


def sentences(texts: list[str], least: int = MIN_WORDS, ended: bool = True) -> Sentences:
    """Sentences of at least `least` words (ended by . ? or ! if `ended`)."""
    b = Batch(texts)
    seg = chars.sentences(b)
    none = np.empty(0, np.int64)
    if not len(seg):
        return Sentences(none, none, none, none, 0)
    n = int(seg[-1]) + 1
    begin, end = b.words()
    words = np.bincount(seg[begin], minlength=n)
    last = np.flatnonzero(np.append(np.diff(seg) > 0, True))
    # the mark that ends a segment: its last character that is neither space nor newline
    solid = np.where((b.cls != NEWLINE) & (b.cls != chars.SPACE), np.arange(len(seg)), -1)
    stop = np.maximum.accumulate(solid)[last]
    full = words >= least
    if ended:
        full &= (b.cls[stop] == END) & (seg[stop] == np.arange(n)) & (b.code[stop] != ord("…")) & ~np.isin(b.cls[np.maximum(stop - 1, 0)], (END, chars.SPACE))
    letter = (b.cls == LOWER) | (b.cls == UPPER)
    # names say little about the language: capitalised words but the first are left out where three others remain
    name = (b.cls[begin] == UPPER) & (end - begin > 1) & (b.cls[np.minimum(begin + 1, len(seg) - 1)] == LOWER)
    if len(begin):
        name[np.append(True, np.diff(seg[begin]) > 0)] = False
        name &= (np.bincount(seg[begin[~name & (end - begin > 1)]], minlength=n) >= 3)[seg[begin]]
        span = np.zeros(len(seg) + 1, np.int8)
        span[begin[name]] += 1
        span[end[name]] -= 1
        letter &= np.cumsum(span[:-1]) == 0
    s = np.where(letter, b.low, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    keep &= full[seg]
    s, g = s[keep], seg[keep]
    number = np.cumsum(full) - 1
    at = np.flatnonzero(full)
    first = np.flatnonzero(np.append(True, np.diff(seg) > 0))
    size = np.diff(np.append(first, len(seg)))[at]
    if len(s) < 3:
        return Sentences(b.row[first[at]], size, none, none, len(at))
    with np.errstate(over="ignore"):
        h = (s[:-2] * np.uint64(961_748_927) + s[1:-1] * np.uint64(179_424_673) + s[2:] * np.uint64(32_452_843)) * chars.BASE
    h = (h >> np.uint64(64 - 13)).astype(np.int64)
    same = g[:-2] == g[2:]
    return Sentences(b.row[first[at]], size, number[g[:-2][same]], h[same], len(at))


assert BUCKETS == 1 << 13


def norms(s: Sentences, idf: np.ndarray) -> np.ndarray:
    """Length of the TF-IDF vector of each sentence."""
    out = np.zeros(s.n)
    if len(s.gram):
        key = np.sort((s.of * BUCKETS + s.gram).astype(np.int64))
        edge = np.flatnonzero(np.append(True, np.diff(key) > 0))
        tf = np.diff(np.append(edge, len(key)))
        out = np.bincount(key[edge] // BUCKETS, weights=(tf * idf[key[edge] % BUCKETS]) ** 2, minlength=s.n)
    return np.sqrt(out)


def dots(s: Sentences, table: np.ndarray) -> np.ndarray:
    """Sum of table[gram] over the trigrams of each sentence."""
    out = np.zeros((s.n, table.shape[1]), np.float32)
    if len(s.gram):
        edge = np.flatnonzero(np.append(True, np.diff(s.of) > 0))
        out[s.of[edge]] = np.add.reduceat(table[s.gram], edge, axis=0)
    return out


@dataclass
class Model:
    idf: np.ndarray  # by bucket
    table: np.ndarray  # by bucket and centroid: idf times the unit centroid
    language: list[str]  # of each centroid

    def classify(self, s: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into languages() or -1, cosine, lead over the best other language) of each sentence."""
        langs = sorted(set(self.language))
        cos = dots(s, self.table) / np.maximum(norms(s, self.idf), 1e-9)[:, None]
        best = np.full((s.n, len(langs)), -1.0)
        for j, x in enumerate(self.language):
            k = langs.index(x)
            best[:, k] = np.maximum(best[:, k], cos[:, j])
        if not s.n:
            return np.empty(0, int), np.empty(0), np.empty(0)
        top = best.argmax(1)
        c = best[np.arange(s.n), top]
        second = np.partition(best, -2, axis=1)[:, -2] if len(langs) > 1 else np.zeros(s.n)
        return np.where((c >= REJECT) & (c - second >= MARGIN * c), top, -1), c, c - second


def _mean(s: Sentences, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The mean direction of some sentences' unit vectors; weight is that of each trigram in them."""
    pick = rows[s.of]
    v = np.bincount(s.gram[pick], weights=weight[pick], minlength=BUCKETS)
    return v / max(float(np.linalg.norm(v)), 1e-9)


def _distinct(s: Sentences, most: int) -> Sentences:
    """The first `most` sentences with different trigrams: what is repeated from text to text, but for names, counts once."""
    key = np.bincount(s.of, weights=np.sqrt(s.gram + 1.0), minlength=s.n)
    first = np.sort(np.unique(key, return_index=True)[1])[:most]
    number = np.full(s.n, -1)
    number[first] = np.arange(len(first))
    pick = number[s.of] >= 0
    return Sentences(s.row[first], s.size[first], number[s.of[pick]], s.gram[pick], len(first))


def fit(rows: list[tuple[str, str]], languages: list[str], per_language: int = 1_500, seed: int = 7) -> Model:
    """Fit on (text, language) rows; of each language its first per_language different sentences, and the samples of prose.

    Vectors are never laid out in full: sums over trigrams give the means, gathers from the centroids the cosines.
    """
    texts: dict[str, list[str]] = {x: [] for x in languages}
    for t, x in rows:
        if x in texts and len(texts[x]) < per_language:
            texts[x].append(body(t))
    for x, t in SAMPLES["prose"].items():
        if x[:3] in texts:
            texts[x[:3]].insert(0, t)
    parts = {}
    for x, t in texts.items():
        if (s := _distinct(sentences(t), per_language)).n:
            parts[x] = s
    df = np.zeros(BUCKETS)
    for s in parts.values():
        df += np.bincount(np.unique(s.of * BUCKETS + s.gram) % BUCKETS, minlength=BUCKETS)
    idf = np.log((1 + sum(s.n for s in parts.values())) / (1 + df)) + 1
    if not parts:
        return Model(idf, np.zeros((BUCKETS, 1), np.float32), ["und"])
    rng = np.random.default_rng(seed)
    names = list(parts)
    weight = {x: idf[s.gram] / np.maximum(norms(s, idf), 1e-9)[s.of] for x, s in parts.items()}
    table = lambda c: (np.array(c).T * idf[:, None]).astype(np.float32)
    kept = {x: np.ones(s.n, bool) for x, s in parts.items()}
    means = [_mean(s, weight[x], kept[x]) for x, s in parts.items()]
    for _ in range(3):  # labels that disagree with the nearest mean don't count
        kept = {x: dots(s, table(means)).argmax(1) == i for i, (x, s) in enumerate(parts.items())}
        means = [_mean(s, weight[x], kept[x]) if kept[x].any() else means[i] for i, (x, s) in enumerate(parts.items())]
    centroids, of = [], []
    for i, x in enumerate(names):
        s, ids = parts[x], np.flatnonzero(kept[x])
        c = [means[i]]
        if len(ids) >= 10 * CLUSTERS:
            c = [_mean(s, weight[x], np.arange(s.n) == k) for k in rng.choice(ids, CLUSTERS, replace=False)]
            for _ in range(ROUNDS):
                near = np.where(kept[x], dots(s, table(c)).argmax(1), -1)
                c = [_mean(s, weight[x], near == j) for j in range(len(c)) if (near == j).any()]
        centroids += c
        of += [x] * len(c)
    return Model(idf, table(centroids), of) if of else Model(idf, np.zeros((BUCKETS, 1), np.float32), ["und"])


def available(engines: DataFrame) -> list[str]:
    """The languages any engine lists, without odd case, spaces, repeats and osd; engines are a small fixed table."""
    x = engines.select(F.explode("available_languages").alias("x")).select(F.lower(F.trim("x")).alias("x")).where("x <> '' and x <> 'osd'").distinct()
    return sorted(r.x for r in x.collect())


def labels(structures: DataFrame) -> DataFrame:
    """(doc_id, langs): the languages of each document's label, the latest arrival of the document counting."""
    w = Window.partitionBy("doc_id").orderBy(F.col("arrived_at").desc_nulls_last(), F.col("lang_label").asc_nulls_last())
    one = structures.where("doc_id is not null").select("doc_id", "lang_label", "arrived_at").withColumn("_k", F.row_number().over(w)).where("_k = 1")
    table = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    part = F.split(F.lower(F.coalesce("lang_label", F.lit(""))), r"\+")
    codes = F.transform(part, lambda p: F.coalesce(F.try_element_at(table, F.trim(p)), F.try_element_at(table, F.split(F.trim(p), "[-_]")[0])))
    return one.select("doc_id", F.array_distinct(F.filter(codes, lambda c: c.isNotNull())).alias("langs"))


def train(blocks: DataFrame, structures: DataFrame, engines: DataFrame) -> Model:
    """Fit on blocks of documents labelled with one language, of each language about SAMPLE_BLOCKS, chosen by hash of their id, so that rare languages
    count in full. Blocks of more than SAMPLE_CHARS characters teach nothing, which bounds what is collected; they are scored like all others."""
    label = labels(structures).where(F.size("langs") == 1).select("doc_id", F.col("langs")[0].alias("x"))
    rows = blocks.where(F.length("raw_text").between(1, SAMPLE_CHARS)).join(label, "doc_id")
    often = {r.x: r["count"] for r in rows.groupBy("x").count().collect()}  # a row per language
    if not often:
        return fit([], available(engines))
    every = F.create_map(*[F.lit(v) for x, n in sorted(often.items()) for v in (x, max(1, -(-n // SAMPLE_BLOCKS)))])
    part = rows.where(F.pmod(F.xxhash64(F.col("block_id").cast("long")), F.element_at(every, F.col("x"))) == 0).select("raw_text", "x")
    return fit([(r.raw_text, r.x) for r in sorted(part.collect(), key=lambda r: xxhash.xxh3_64_intdigest(r.raw_text))], available(engines))


def segments(blocks: DataFrame, model: Model) -> DataFrame:
    """(block_id, doc_id, lang, sentences, chars, confidence) of each block and language of its full sentences.

    confidence is the mean cosine lead over the next language, scaled to 0..1 by the cosine. Null or empty text has no
    sentences; rows without a block or document id are left out; a repeated block gives a repeated row.
    """
    sent = blocks.sparkSession.sparkContext.broadcast((model.idf, model.table, model.language))
    names = sorted(set(model.language))

    def run(b: dict) -> dict:
        m = Model(*sent.value)
        out: dict[str, list] = {k: [] for k in ("block_id", "doc_id", "lang", "sentences", "chars", "confidence")}
        for i, j in chars.pieces(b["t"]):
            s = sentences([body(t) for t in b["t"][i:j]])
            lang, cos, lead = m.classify(s)
            good = lang >= 0
            if not good.any():
                continue
            key, at = np.unique(s.row[good].astype(np.int64) * len(names) + lang[good], return_inverse=True)
            count = np.bincount(at)
            size = np.bincount(at, weights=s.size[good])
            conf = np.bincount(at, weights=(lead / np.maximum(cos, 1e-9))[good] * s.size[good]) / np.maximum(size, 1)
            for k, c, z, f in zip(key.tolist(), count.tolist(), size.tolist(), conf.tolist()):
                r = i + k // len(names)
                for name, v in zip(out, (b["block_id"][r], b["doc_id"][r], names[k % len(names)], c, int(z), f)):
                    out[name].append(v)
        return out

    rows = blocks.select(F.col("block_id").cast("long").alias("block_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("raw_text").alias("t")).where("block_id is not null and doc_id is not null")
    return arrow_map(rows, run, "block_id long, doc_id long, lang string, sentences long, chars long, confidence double")


def unlabelled(blocks: DataFrame, structures: DataFrame, engines: DataFrame) -> DataFrame:
    """Distinct (block_id, lang) of full sentences in a language that isn't in the label of their document."""
    seg = segments(blocks, train(blocks, structures, engines)).select("block_id", "doc_id", "lang").distinct()
    return seg.join(labels(structures), "doc_id", "left").where(~F.coalesce(F.array_contains("langs", F.col("lang")), F.lit(False))).select("block_id", "lang").distinct()


def document_languages(blocks: DataFrame, structures: DataFrame, engines: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, share, langs): of each document in structures its main language by characters of full sentences
    (null without any), with its share of them, its confidence, and all languages found."""
    seg = segments(blocks, train(blocks, structures, engines)).dropDuplicates(["block_id", "lang"])
    by = seg.groupBy("doc_id", "lang").agg(F.sum("chars").alias("chars"), (F.sum(F.col("confidence") * F.col("chars")) / F.sum("chars")).alias("confidence"))
    doc = by.groupBy("doc_id").agg(F.max(F.struct("chars", "lang", "confidence")).alias("top"), F.sum("chars").alias("all"), F.array_sort(F.collect_set("lang")).alias("langs"))  # a row per language
    d = structures.select("doc_id").where("doc_id is not null").distinct().join(doc, "doc_id", "left")
    return d.select("doc_id", F.col("top.lang").alias("lang"), (F.col("top.chars") / F.col("all") * F.col("top.confidence")).alias("confidence"), (F.col("top.chars") / F.col("all")).alias("share"), "langs")

"""Problem 7: passages of evaluation items in the texts of a corpus.

Greedy string tiling of each text against each item: the runs of words that items use are hashed by Karp-Rabin,
seeds of `k` words shared with an item are joined to maximal matches, the longest unmarked match is marked again
and again, and the marked words are the item's coverage. Items are a stated query set: they are sent to the
executors in blocks of at most BLOCK_WORDS words, and every text is read against every block.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchflow.runtime import arrow_map

K = 12
#: Words of items held by an executor at once: about 200 MB with hashes.
BLOCK_WORDS = 1_000_000
WORD = re.compile(r"[^\W_]+")
ESCAPES = re.compile(r"\\+(?:u([0-9a-fA-F]{4})|[nrtbfv])")
BASE = np.uint64(1_000_003)


def plain(text: str) -> str:
    """text without the escapes of string literals and JSON: what stands between words doesn't matter."""
    if "\\" not in text:
        return text
    return ESCAPES.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)


_SPLIT = {n: " " for n in range(128) if not chr(n).isalnum()}


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case, accents composed."""
    text = plain(text).lower()
    if text.isascii():
        return text.translate(_SPLIT).split()
    return WORD.findall(text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text))


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of every k ids in a row, modulo 2**64."""
    if len(ids) < k:
        return np.empty(0, np.uint64)
    h = np.zeros(len(ids) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * BASE + ids[j : len(ids) - k + 1 + j].astype(np.uint64)
    return h


class Index:
    """The words of some items, and where every k of them in a row stand."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        self.k, self.vocab, self.items = k, {}, {}
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)], np.int64)
            self.items[item] = ids
            for i, h in enumerate(rolling(ids, k).tolist()):
                self.at[h].append((item, i))
        self.marks = self._marks()

    def _marks(self) -> frozenset[str]:
        """Words of which every run of k words of an item holds one: of each run the rarest, then the longest. A text without them has no seed."""
        spelt = {n: w for w, n in self.vocab.items()}
        often = np.zeros(len(self.vocab) + 1, np.int64)
        for ids in self.items.values():
            np.add.at(often, ids, 1)
        rank = {n: (-w.isalpha(), often[n], -len(w)) for n, w in spelt.items()}
        out: set[int] = set()
        for ids in self.items.values():
            row = ids.tolist()
            for i in range(len(row) - self.k + 1):
                run = row[i : i + self.k]
                if out.isdisjoint(run):
                    out.add(min(run, key=rank.__getitem__))
        return frozenset(spelt[n] for n in out)

    def seeds(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, place in the text, place in the item) of every shared run of k words."""
        known = ids > 0
        if known.sum() < self.k:
            return []
        run = np.convolve(known, np.ones(self.k, np.int64), "valid") == self.k
        if not run.any():
            return []
        h = rolling(ids, self.k)
        out = []
        for p in np.flatnonzero(run).tolist():
            for item, i in self.at.get(int(h[p]), ()):
                if (self.items[item][i : i + self.k] == ids[p : p + self.k]).all():
                    out.append((item, p, i))
        return out

    def tiles(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, tiles, marked words of the item, longest tile) of the items that share k words in a row with text."""
        row = words(text)
        if self.marks.isdisjoint(row):
            return []
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in row], np.int64)
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, p, i in self.seeds(ids):
            by[item].append((p, i))
        return [(item, *self.tile(ids, self.items[item], seeds)) for item, seeds in by.items()]

    def tile(self, text: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]]) -> tuple[int, int, int]:
        """Marks longest matches first; what is left of a match that runs into marked words counts if it still has k words."""
        import heapq

        heap = []
        starts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, i in sorted(set(seeds)):
            runs = starts[p - i]
            if runs and p <= runs[-1][1] + 1:
                runs[-1] = (runs[-1][0], p)
            else:
                runs.append((p, p))
        for d, runs in starts.items():
            for a, b in runs:
                heapq.heappush(heap, (-(b - a + self.k), a, a - d))
        marked_t, marked_i = np.zeros(len(text), bool), np.zeros(len(item), bool)
        tiles = longest = 0
        while heap:
            n, p, i = heapq.heappop(heap)
            n = -n
            free = ~(marked_t[p : p + n] | marked_i[i : i + n])
            if free.all():
                marked_t[p : p + n] = marked_i[i : i + n] = True
                tiles, longest = tiles + 1, max(longest, n)
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a >= self.k:
                    heapq.heappush(heap, (-(b - a), p + a, i + a))
        return tiles, int(marked_i.sum()), longest


#: Indexes of this process by broadcast, so that the tasks of an executor's Python process build each once; one is kept.
_indexes: dict[int, Index] = {}


def _index(sent, k: int) -> Index:
    at = id(sent.value)
    if at not in _indexes:
        _indexes.clear()
        _indexes[at] = Index(sent.value, k)
    return _indexes[at]


def leaks(documents: DataFrame, items: DataFrame, k: int = K, min_coverage: float = 0.0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, tiles, words, coverage, longest): items that tile a text with at least min_coverage of their words, in tiles of at least k words.

    coverage is the share of the item's words in tiles, so that reordered passages count in full; with min_coverage 0 one tile is enough. Texts or items
    that are null, empty or shorter than k words share nothing; a repeated key gives a row per row of documents.
    """
    pairs = items.select(F.col("item_id").cast("long"), F.col("text")).where("item_id is not null and text is not null").toLocalIterator()
    spark, out, block, size = documents.sparkSession, None, [], 0
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null and t is not null")

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(b: dict) -> dict:
            index = _index(sent, k)
            rows: dict[str, list] = {n: [] for n in ("doc_id", "item_id", "tiles", "words", "coverage", "longest")}
            for d, t in zip(b["doc_id"], b["t"]):
                for item, tiles, n, longest in index.tiles(t):
                    if tiles and n >= min_coverage * len(index.items[item]):
                        for name, v in zip(rows, (d, item, tiles, n, n / len(index.items[item]), longest)):
                            rows[name].append(v)
            return rows

        return arrow_map(docs, run, "doc_id long, item_id long, tiles int, words int, coverage double, longest int")

    for item, t in pairs:
        block.append((item, t))
        if (size := size + len(t) // 4) >= BLOCK_WORDS:
            part = scan(block)
            out, block, size = (part if out is None else out.unionByName(part)), [], 0
    if block or out is None:
        part = scan(block)
        out = part if out is None else out.unionByName(part)
    return out


def leaked(documents: DataFrame, items: DataFrame, k: int = K, min_coverage: float = 0.0) -> DataFrame:
    """Distinct (doc_id, item_id)."""
    return leaks(documents, items, k, min_coverage).select("doc_id", "item_id").distinct()

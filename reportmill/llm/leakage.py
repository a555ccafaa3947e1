"""Evaluation passages in training texts by greedy string tiling.

The words of test items and documents are hashed in overlapping seeds (windows of ``min_tile`` words, one polynomial
Karp-Rabin hash each) and joined on them. While the items' words fit ``portion_words`` their seeds are broadcast and no
document is shuffled. With more items the join is shuffled: only hashes and places travel, seeds that no item has are dropped
first, and a document and an item that share enough are then tiled on their own words. Seeds a document shares with an item are joined on their diagonal into maximal matches. Then the longest match is
marked again and again, what overlaps a mark being cut off, until none of ``min_tile`` words is left: the tiles. An item
counts as leaked if a tile has ``min_run`` words, or the tiles, in any order, cover ``min_coverage`` of it.

Defined results: null texts and ids have no matches; items or documents of fewer words than ``min_tile`` have none either;
of several places in a document the first is marked; repeated rows of a document give one row; empty tables give none.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.runtime import materialize

WORD = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class LeakParams:
    min_tile: int = 5
    min_run: int = 12
    min_coverage: float = 0.5
    portion_words: int = 1_000_000  #: words of test items up to which they are broadcast (about 40 MB); more are joined by a shuffle


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``size`` codes (modulo 2^64); entry i covers i .. i+size-1."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * np.uint64(1_099_511_628_211) + codes[j : j + n].astype(np.uint64)
    return h


def tiles(matches: list[tuple[int, int, int]], doc_words: int, item_words: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles from maximal matches (document position, item position, words), longest first; ties: earliest."""
    import heapq

    heap = [(-n, i, d) for d, i, n in matches]
    heapq.heapify(heap)
    in_doc, in_item, out = bytearray(doc_words), bytearray(item_words), []
    while heap:
        n, i, d = heapq.heappop(heap)
        n = -n
        taken = [k for k in range(n) if in_doc[d + k] or in_item[i + k]]
        if not taken:
            out.append((d, i, n))
            in_doc[d : d + n] = in_item[i : i + n] = b"\1" * n
            continue
        edges = [-1, *taken, n]
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a - 1 >= least:
                heapq.heappush(heap, (-(b - a - 1), i + a + 1, d + a + 1))
    return out


def matches_of(hits: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Maximal matches from seed hits (document position, item position)."""
    out: list[list[int]] = []
    for d, i in sorted(hits, key=lambda x: (x[0] - x[1], x[0])):
        if out and out[-1][0] - out[-1][1] == d - i and d <= out[-1][0] + out[-1][2] - least + 1:
            out[-1][2] = d - out[-1][0] + least
        else:
            out.append([d, i, least])
    return [tuple(x) for x in out]


def _index(items: list[tuple[int, list[str]]], least: int) -> tuple:
    """Word numbers, sorted seed hashes with their places, and the items' word numbers."""
    vocab: dict[str, int] = {}
    coded = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in ws], np.int64) for _, ws in items]
    hashes = [window_hashes(c, least) for c in coded]
    seed = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
    place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
    order = np.argsort(seed, kind="stable")
    return vocab, seed[order], item[order], place[order], coded, np.array([i for i, _ in items], np.int64)


RESULT = "doc_id long, item_id long, longest int, covered int, coverage double, n_tiles int"


def _told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "longest", "covered", "coverage", "n_tiles"])


def _tiled(found: list[tuple[int, int]], doc_words: int, item_words: int, p: LeakParams) -> tuple[int, int, float, int] | None:
    """(longest, covered, coverage, tiles) of an item in a document from the places of their shared seeds; None below both bounds."""
    reach = len({q + j for _, q in found for j in range(p.min_tile)})
    if reach < min(p.min_run, p.min_coverage * item_words):
        return None  # no tiling of these seeds can reach either bound
    laid = tiles(matches_of(found, p.min_tile), doc_words, item_words, p.min_tile)
    longest, covered = max(x[2] for x in laid), sum(x[2] for x in laid)
    return (longest, covered, covered / item_words, len(laid)) if longest >= p.min_run or covered >= p.min_coverage * item_words else None


def _by_broadcast(texts: DataFrame, held: list[tuple[int, list[str]]], p: LeakParams) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(_index(held, p.min_tile))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seed, item, place, coded, names = shared.value
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes = np.array([vocab.get(w, 0) for w in words(text)], np.int64)
                h = window_hashes(codes, p.min_tile)
                lo = np.searchsorted(seed, h, "left")
                at = np.flatnonzero((lo < len(seed)) & (seed[np.minimum(lo, max(len(seed) - 1, 0))] == h)) if len(seed) else ()
                if not len(at):
                    continue
                hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for d in at.tolist():
                    for k in range(lo[d], np.searchsorted(seed, h[d], "right")):
                        i, q = int(item[k]), int(place[k])
                        if (codes[d : d + p.min_tile] == coded[i][q : q + p.min_tile]).all():
                            hits[i].append((d, q))
                for i, found in hits.items():
                    if got := _tiled(found, len(codes), len(coded[i]), p):
                        rows.append((doc, int(names[i]), *got))
            if rows:
                yield _told(rows)

    return texts.mapInArrow(search, RESULT)


def _seeds(df: DataFrame, p: LeakParams) -> DataFrame:
    """(id, seed, place) of every window of a text's words, places as an array where a text repeats a window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in (whole.slice(at, 200) for whole in batches for at in range(0, whole.num_rows, 200)):
            memo = memo if len(memo) < 500_000 else {}
            ids, seeds, places = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = words(text)
                for w in found:
                    if w not in memo:
                        memo[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                h = window_hashes(np.array([memo[w] for w in found], np.uint64), p.min_tile)
                ids += [key] * len(h)
                seeds.append(h.view(np.int64))
                places.append(np.arange(len(h), dtype=np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(seeds)), pa.array(np.concatenate(places))], ["id", "seed", "place"])

    return df.mapInArrow(cut, "id long, seed long, place int")


def _by_shuffle(texts: DataFrame, items: DataFrame, p: LeakParams) -> DataFrame:
    """The join of seeds, shuffled. Documents that are copies of each other meet the items once.

    Candidates are pairs with enough item words in shared seeds. Hits are only counted, with partial sums before the shuffle; a
    candidate pair is tiled on its two texts, so nothing is gathered that grows with the number of documents or items.
    """
    mark = F.md5("text")
    copies = texts.select("doc_id", mark.alias("mark")).distinct()
    single = texts.select("doc_id", "text", mark.alias("mark")).groupBy("mark").agg(F.min("doc_id").alias("doc_id"))
    single = texts.withColumn("mark", mark).join(single, ["mark", "doc_id"], "left_semi").dropDuplicates(["doc_id"])
    item_seeds = materialize(_seeds(items, p).withColumnsRenamed({"id": "item_id", "place": "at_item"}), "seeds")
    doc_seeds = _seeds(single.select("doc_id", "text"), p).withColumnsRenamed({"id": "doc_id", "place": "at_doc"})
    doc_seeds = materialize(doc_seeds.join(item_seeds.select("seed").distinct(), "seed", "left_semi"), "shared")
    # an item's places of a seed it repeats are one row, so that a pair meets once for each seed
    grouped = item_seeds.groupBy("item_id", "seed").agg(F.collect_list("at_item").alias("at_item"))
    hits = doc_seeds.join(grouped, "seed")
    # item words in shared seeds: a pair needs so many for either bound; each seed adds at most min_tile of them
    size = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    needed = F.least(F.lit(p.min_run), F.ceil(F.lit(p.min_coverage) * size))
    lengths = items.select("item_id", needed.alias("needed"))
    enough = hits.groupBy("doc_id", "item_id").agg((F.sum(F.size("at_item")) * p.min_tile).alias("most")).join(lengths, "item_id").where("most >= needed").select("doc_id", "item_id")
    enough = materialize(enough, "pairs")
    both = enough.join(single.select("doc_id", F.col("text").alias("doc_text")), "doc_id").join(items.select("item_id", F.col("text").alias("item_text")), "item_id")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, item, x, y in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                dw, iw = words(x), words(y)
                where: dict[tuple[str, ...], list[int]] = defaultdict(list)
                for q in range(len(iw) - p.min_tile + 1):
                    where[tuple(iw[q : q + p.min_tile])].append(q)
                found = [(d, q) for d in range(len(dw) - p.min_tile + 1) for q in where.get(tuple(dw[d : d + p.min_tile]), ())]
                if found and (got := _tiled(found, len(dw), len(iw), p)):
                    rows.append((doc, item, *got))
            if rows:
                yield _told(rows)

    found = both.select("doc_id", "item_id", "doc_text", "item_text").mapInArrow(tile, RESULT)
    named = found.join(single.select("doc_id", "mark"), "doc_id").drop("doc_id").join(copies, "mark")
    return named.select("doc_id", "item_id", "longest", "covered", "coverage", "n_tiles")


def leaks(documents: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """(doc_id, item_id, longest, covered, coverage, n_tiles): documents and the test items that leaked into them."""
    p = params
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = asked.agg(F.sum(F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))))).first()[0] or 0
    if size <= p.portion_words:
        found = _by_broadcast(texts, [(r.item_id, words(r.text)) for r in asked.collect()], p)
    else:
        found = _by_shuffle(texts, asked, p)
    return found.dropDuplicates(["doc_id", "item_id"])

"""Near-identical texts by a prefix-filtered set join; every pair that meets the threshold is found.

Every text becomes its set of distinct word runs (three words here), texts of equal words one class. All runs have one order,
rarest first by counters that runs share. Two sets of similarity t have t of each set in common, so both hold a run of
their intersection among their first n - t n + 1 runs: those are a text's keys, without runs that surely only one text has.
Rows of equal key meet in groups of bounded size. There a bitmap of each set (a bit flips for every run) bounds from below how
much two sets differ; pairs it can't tell apart are compared by their true similarity. Of a key with more rows than a
group takes, every pair of blocks is a group of its own. Order, counters and bitmaps decide how much is compared, never what
is found.

Defined results: a null text and a text shorter than the run have no runs and are near nothing; equal sets have
similarity 1; repeated rows of one id count once (of rows with different texts, each counts); an empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.operators.components import components
from reportmill.runtime import materialize, small, spread


@dataclass(frozen=True)
class NearDupParams:
    words: int = 5  #: words in a run
    similarity: float = 0.8
    counters: int = 1 << 22  #: shared by the runs' counts, a power of two
    lanes: int = 5  #: words of 64 bits of a set's bitmap
    positions: int = 24  #: this and the next three: of ``short_forms`` and ``_keys``, which ``near_pairs`` does not use
    chunks: int = 6
    left_out: int = 2  #: positions of a chunk that may differ: all pairs within a distance of chunks * left_out + chunks - 1 share a key
    bits: int = 6  #: of a position
    group_rows: int = 262_144  #: rows of a group of keys (56 bytes each)
    hot_rows: int = 4096  #: rows of one key from which it is split into blocks of this size

    @property
    def radius(self) -> int:
        return self.chunks * self.left_out + self.chunks - 1


#: For texts edited more heavily.
LOOSE = NearDupParams(words=3, similarity=0.5)
WORD = re.compile("[a-z0-9]+")
#: Counters that travel together, and what is taken off a product before it is rounded up.
SLICE, EPS = 4096, 1e-6


def _mix(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_runs(texts: list[str | None], words: int, memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(hash of every run of ``words`` words, number of its text, digest of each text's words); ``memo`` keeps hashes of words."""
    codes, lengths, digests = [], [], []
    for t in texts:
        found = WORD.findall(t.lower()) if t else []
        for w in found:
            if w not in memo:
                memo[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        codes += [memo[w] for w in found]
        lengths.append(len(found))
        digests.append(hashlib.blake2b(" ".join(found).encode(), digest_size=16).digest())
    code = np.array(codes, np.uint64)
    n = len(code) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), digests
    h = np.zeros(n, np.uint64)
    for j in range(words):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[j : j + n]
    owner = np.repeat(np.arange(len(texts)), lengths)
    whole = owner[:n] == owner[words - 1 :]
    return _mix(h[whole]), owner[:n][whole], digests


def run_sets(texts: list[str | None], words: int, memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """As ``word_runs``, each run of a text once, by text."""
    flat, owner, digests = word_runs(texts, words, memo)
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    fresh = (np.diff(flat, prepend=flat[:1] - np.uint64(1)) != 0) | (np.diff(owner, prepend=-1) != 0)
    return flat[fresh], owner[fresh], digests


def prefix(n: np.ndarray, similarity: float) -> np.ndarray:
    """Of sets of ``n`` runs, how many of the first one that any similar set has must be among."""
    return n - np.ceil(similarity * n - EPS).astype(np.int64) + 1


def bitmaps(flat: np.ndarray, owner: np.ndarray, sets: int, lanes: int) -> np.ndarray:
    """(sets x lanes): for each set the bits that its runs flip an odd number of times."""
    bit = ((flat >> np.uint64(16)) % np.uint64(64 * lanes)).astype(np.int64)
    odd = np.bincount(owner * (64 * lanes) + bit, minlength=sets * 64 * lanes) & 1
    return np.packbits(odd.reshape(sets, -1).astype(np.uint8), axis=1).view(np.int64)


def _keys(sig: np.ndarray, p: NearDupParams) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """(sets x keys), the positions each key is made of: for each chunk every choice of positions that stay when ``left_out`` are left out."""
    width = p.positions // p.chunks
    stays = [s for c in range(p.chunks) for s in combinations(range(c * width, (c + 1) * width), width - p.left_out)]
    out = []
    for k, stay in enumerate(stays):
        h = np.full(len(sig), (2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for i in stay:
            h = _mix(h ^ sig[:, i])
        out.append(h)
    return np.stack(out, axis=1).view(np.int64), stays


def short_forms(sig: np.ndarray, p: NearDupParams) -> np.ndarray:
    """(sets x lanes) the lowest ``bits`` of the mixed positions, packed."""
    per = 64 // p.bits
    low = _mix(sig) & np.uint64(2**p.bits - 1)
    lanes = [sum((low[:, k] << np.uint64(p.bits * (k - at)) for k in range(at, min(at + per, p.positions))), np.zeros(len(sig), np.uint64)) for at in range(0, p.positions, per)]
    return np.stack(lanes, axis=1).view(np.int64)


def distances(a: np.ndarray, b: np.ndarray, p: NearDupParams) -> np.ndarray:
    """How many positions differ between the short forms of rows of ``a`` and ``b``."""
    x = (a ^ b).view(np.uint64)
    mask = np.uint64(sum(1 << k for k in range(0, 64 // p.bits * p.bits, p.bits)))
    folded = np.zeros_like(x)
    for k in range(p.bits):
        folded |= x >> np.uint64(k)
    return np.bitwise_count(folded & mask).sum(axis=1)


#: A row under one of its keys: ``size`` is 4 times the set's, plus 3, or 1 and 2 for the two blocks of a split key that meet.
def entry_type(p: NearDupParams) -> np.dtype:
    return np.dtype([("key", "<u4"), ("node", "<i8"), ("bitmap", "<i8", (p.lanes,)), ("size", "<i4")])


def close_pairs(rows: np.ndarray, p: NearDupParams) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of nodes that share a key, on sides that meet, but for those whose sizes or bitmaps rule the similarity out."""
    rows = rows[np.argsort(rows["key"], kind="stable")]
    key, node, bitmap, side, size = rows["key"].copy(), rows["node"].copy(), rows["bitmap"].copy(), rows["size"] & 3, (rows["size"] >> 2).astype(np.int64)
    at, out, step = np.arange(len(key)), [np.zeros((0, 2), np.int64)], 1
    while True:
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        to = at + step
        meet = ((side[at] | side[to]) == 3) & (node[at] != node[to]) & (np.minimum(size[at], size[to]) >= p.similarity * np.maximum(size[at], size[to]) - EPS)
        x, y = at[meet], to[meet]
        both = size[x] + size[y]
        apart = both - 2 * np.ceil(p.similarity / (1 + p.similarity) * both - EPS)
        near = np.bitwise_count((bitmap[x] ^ bitmap[y]).view(np.uint64)).sum(axis=1) <= apart
        out.append(np.stack([np.minimum(node[x[near]], node[y[near]]), np.maximum(node[x[near]], node[y[near]])], axis=1))
        step += 1
    pairs = np.unique(np.concatenate(out), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _read(texts: DataFrame, p: NearDupParams) -> DataFrame:
    """Rows of three kinds from one scan of the texts: (id, h1, h2) of each text with runs, (slice, counts) how many texts have runs of each counter, and (keys) their keys at most."""
    schema = "id string, h1 long, h2 long, slice int, counts binary, keys long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        held, keys = np.zeros(p.counters, np.uint32), 0
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            memo = memo if len(memo) < 500_000 else {}
            flat, owner, digests = run_sets(b.column(1).to_pylist(), p.words, memo)
            at, n = np.unique((flat & np.uint64(p.counters - 1)).astype(np.int64), return_counts=True)
            held[at] += n.astype(np.uint32)
            rows, n = np.unique(owner, return_counts=True)
            keys += int(prefix(n, p.similarity).sum())
            marks = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)[rows]
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary()), none], ["id", "h1", "h2", "slice", "counts", "keys"])
        parts = held.reshape(-1, SLICE)
        full = np.flatnonzero(parts.any(axis=1))
        m, blank = len(full), pa.nulls(len(full) + 1, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(m + 1, pa.string()), blank, blank, pa.array([*full.tolist(), None], pa.int32()), pa.array([*[parts[k].tobytes() for k in full], None], pa.binary()), pa.array([None] * m + [keys], pa.int64())], ["id", "h1", "h2", "slice", "counts", "keys"])

    return materialize(spread(texts).mapInArrow(read, schema), "read")


def _counts(rows: DataFrame, p: NearDupParams) -> np.ndarray:
    """How many texts have runs of each counter: never fewer than have any one of them."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for x in group.column("counts").to_pylist():
            total += np.frombuffer(x, np.uint32)
        return pa.table({"slice": group.column("slice")[:1], "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    out = np.zeros((p.counters // SLICE, SLICE), np.uint32)
    for r in rows.where("slice IS NOT NULL").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():  # 4 bytes a counter
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint32)
    return out.reshape(-1)


def near_pairs(df: DataFrame, params: NearDupParams = NearDupParams(), key: str = "source_id", text: str = "narrative") -> tuple[DataFrame, DataFrame]:
    """(links, classes): links (a, b, similarity) between representatives of different texts; classes (id, rep) for every id with a set."""
    p = params
    spark = df.sparkSession
    texts = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    rows = _read(texts, p)
    read = rows.where("id IS NOT NULL")
    # equal texts: only hashes and ids are shuffled, combined before the shuffle
    twice = read.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").select("h1", "h2", "rep")
    copies = materialize(read.select("id", "h1", "h2").join(twice, ["h1", "h2"]).where("id <> rep").select("id", "h1", "rep").distinct(), "copies")
    classes = materialize(read.select("id", "h1").join(small(copies), ["id", "h1"], "left").select("id", F.coalesce("rep", "id").alias("rep"), "h1"), "classes")
    alone = spread(texts).join(small(copies.groupBy("id").agg(F.collect_set("h1").alias("copied"))), "id", "left").select("text", "copied")
    shared = spark.sparkContext.broadcast(_counts(rows, p))
    groups_ = max(1, -(-(rows.agg(F.sum("keys")).first()[0] or 0) // p.group_rows))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each bucket that come from one batch, packed into one."""
        memo: dict[str, int] = {}
        counts, kind = shared.value, entry_type(p)
        # where counters are full, what they count beyond the usual is one run's
        usual = int(np.median(counts))
        for b in (whole.slice(at, 4000) for whole in batches for at in range(0, whole.num_rows, 4000)):
            memo = memo if len(memo) < 500_000 else {}
            flat, owner, digests = run_sets(b.column(0).to_pylist(), p.words, memo)
            if not len(flat):
                continue
            node = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)[:, 0]
            skip = np.array([c is not None and h in c for h, c in zip(node.tolist(), b.column(1).to_pylist(), strict=True)])
            maps, n = bitmaps(flat, owner, len(node), p.lanes), np.bincount(owner, minlength=len(node))
            often = counts[(flat & np.uint64(p.counters - 1)).astype(np.int64)].astype(np.int64)
            order = np.lexsort((flat, often, owner))
            flat, owner, often = flat[order], owner[order], often[order]
            rank = np.arange(len(flat)) - (np.cumsum(n) - n)[owner]
            keep = (rank < prefix(n, p.similarity)[owner]) & (often > 1) & ~skip[owner]
            flat, owner, blocks = flat[keep], owner[keep], -(-(often[keep] - usual) // p.hot_rows)
            light = blocks <= 1
            cols = [(flat[light], owner[light], np.full(int(light.sum()), 3), ((flat[light] & np.uint64(2**32 - 1)) % np.uint64(groups_)).astype(np.int64))]
            heavy, of_heavy = np.unique(flat[~light], return_inverse=True)
            for k, run in enumerate(heavy):
                of = np.flatnonzero(~light)[of_heavy == k]
                m, at = int(blocks[of[0]]), owner[of]
                own = (_mix(node[at].view(np.uint64) ^ run) % np.uint64(m)).astype(np.int64)
                for other in range(m):
                    i, j = np.minimum(own, other), np.maximum(own, other)
                    place = (_mix((i * m + j).view(np.uint64) ^ run) >> np.uint64(1)).astype(np.int64)
                    cols.append((np.full(len(of), run), at, (own <= other) + 2 * (own >= other), -1 - place))
            run, at, side, bucket = (np.concatenate(c) for c in zip(*cols, strict=True))
            if not len(run):
                continue
            packed = np.empty(len(run), kind)
            packed["key"], packed["node"], packed["bitmap"], packed["size"] = run >> np.uint64(32), node[at], maps[at], 4 * n[at] + side
            order = np.argsort(bucket, kind="stable")
            packed, bucket = packed[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
            ends = np.append(cut[1:], len(packed))
            blobs = [packed[a:z].tobytes() for a, z in zip(cut, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(blobs, pa.binary())], ["bucket", "rows"])

    def meet(group: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(group.column("rows").to_pylist()), entry_type(p))
        a, b = close_pairs(rows, p)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    keyed = alone.mapInArrow(index, "bucket long, rows binary")
    pairs = materialize(keyed.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct(), "pairs")

    # the true similarity of the pairs, on the runs of the texts they name
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct()
    named = classes.where("id = rep").join(nodes, "h1").select("id", "h1").distinct()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            memo = memo if len(memo) < 500_000 else {}
            flat, owner, digests = run_sets(b.column(1).to_pylist(), p.words, memo)
            ends = np.append(0, np.cumsum(np.bincount(owner, minlength=b.num_rows)))
            marks = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks[:, 0]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))], ["id", "h1", "runs"])

    spelled = texts.join(small(named.select("id").distinct()), "id", "left_semi").mapInArrow(spell, "id string, h1 long, runs array<long>")
    runs = materialize(spelled.join(named, ["id", "h1"], "left_semi").dropDuplicates(["id", "h1"]), "runs")
    both = pairs.join(runs.select(F.col("h1").alias("a"), F.col("id").alias("ia"), F.col("runs").alias("ra")), "a").join(runs.select(F.col("h1").alias("b"), F.col("id").alias("ib"), F.col("runs").alias("rb")), "b")
    links = both.withColumn("i", F.size(F.array_intersect("ra", "rb"))).withColumn("similarity", F.col("i") / (F.size("ra") + F.size("rb") - F.col("i")))
    links = links.where((F.col("similarity") >= p.similarity) & (F.col("ia") != F.col("ib"))).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "similarity")
    return links.distinct(), classes.select("id", "rep").distinct()


def expanded(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): all pairs a < b of ids that are near, copies included, for results that must list every pair."""
    members = classes.withColumnRenamed("rep", "r")
    doubled = members.groupBy("r").agg(F.count("*").alias("n")).where("n > 1").select("r")
    inner = members.join(doubled, "r")
    same = inner.alias("x").join(inner.alias("y"), "r").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    across = links.select("a", "b").join(members.select(F.col("r").alias("a"), F.col("id").alias("ia")), "a").join(members.select(F.col("r").alias("b"), F.col("id").alias("ib")), "b")
    return same.union(across.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))).distinct()


def groups(df: DataFrame, params: NearDupParams = NearDupParams(), key: str = "source_id", text: str = "narrative") -> DataFrame:
    """(id, class_id, group_id, group_size, n_links): every id with runs once; class: equal sets; group: chained by links, itself if alone."""
    links, classes = near_pairs(df, params, key, text)
    links, classes = materialize(links, "links"), materialize(classes, "classes")
    label = components(links.select("a", "b"))
    count = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("group_id", F.coalesce("label", "rep")).join(count, "rep", "left")
    size = named.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return named.join(size, "group_id").select("id", F.col("rep").alias("class_id"), "group_id", "group_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))

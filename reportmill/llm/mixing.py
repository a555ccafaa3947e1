"""Sources mixed to target shares of the tokens.

Equal texts are one document, which may belong to several sources; documents are aggregated by membership pattern (the
set of their targeted sources). A min-cost flow routes the patterns' tokens to the sources' quotas: each further use of
the same documents costs more (convex), a source may take a pattern at most ``max_repeats`` times, a pattern is used at
most as often as its most generous source allows. The total is the largest, up to every distinct token once, at which
all quotas are filled. Then documents are selected: those of a pattern lie in a seeded order on a circle as long as
their tokens, each source takes an arc as long as its flow, one arc after the other, so uses spread evenly and a share
is met up to a document per arc.

Defined results: null or blank texts and documents without a targeted source are not taken; a source that is missing
among the documents is reported with an actual share of 0 and the other targets keep their proportions; a targeted
source of share 0 or max_repeats 0 or null takes nothing; repeated rows of a doc_id count once; no documents or no
targets: no selection.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportmill.runtime import materialize, small, spread


@dataclass(frozen=True)
class MixParams:
    tokenizer: str = "/opt/tokenizers/byte_bpe_50k.json"
    total: int | None = None  #: wanted tokens; None: every distinct token once, or less if the shares cannot be kept
    seed: int = 5
    bucket_docs: int = 20_000  #: documents of one slice of the seeded order, summed up in one task
    max_buckets: int = 16_384


def token_counts(texts: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, h1, h2, tokens) of rows (doc_id, source, text); the tokenizer file travels as a broadcast."""
    shared = texts.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())  # noqa: SIM115

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(shared.value)
        t.encode_special_tokens = True
        for b in batches:
            n: list[int] = []
            for at in range(0, b.num_rows, 256):
                n += [len(e.ids) for e in t.encode_batch(b.column("text").slice(at, 256).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("h1"), b.column("h2"), pa.array(n, pa.int64())], ["doc_id", "source", "h1", "h2", "tokens"])

    return texts.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}).mapInArrow(count, "doc_id long, source string, h1 long, h2 long, tokens long")


class Flow:
    """Min-cost flow by successive cheapest paths; the graphs have a node per pattern and source."""

    def __init__(self) -> None:
        self.arcs: list[list[int]] = []  # to, capacity left, cost
        self.out: dict[object, list[int]] = defaultdict(list)

    def add(self, a: object, b: object, capacity: int, cost: int = 0) -> int:
        self.arcs += [[b, capacity, cost], [a, 0, -cost]]
        self.out[a].append(len(self.arcs) - 2)
        self.out[b].append(len(self.arcs) - 1)
        return len(self.arcs) - 2

    def run(self, start: object, end: object) -> int:
        total = 0
        while True:
            cost, via, queue, queued = {start: 0}, {}, [start], {start}
            while queue:
                a = queue.pop(0)
                queued.discard(a)
                for k in self.out[a]:
                    b, left, c = self.arcs[k]
                    if left > 0 and cost[a] + c < cost.get(b, 1 << 60):
                        cost[b], via[b] = cost[a] + c, k
                        if b not in queued:
                            queue.append(b)
                            queued.add(b)
            if end not in via:
                return total
            path, at = [], end
            while at != start:
                path.append(via[at])
                at = self.arcs[via[at] ^ 1][0]
            push = min(self.arcs[k][1] for k in path)
            for k in path:
                self.arcs[k][1] -= push
                self.arcs[k ^ 1][1] += push
            total += push


def routed(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], wanted: int) -> tuple[dict[tuple[tuple[str, ...], str], int], dict[str, int]]:
    """(tokens per pattern and source, quota per source) at the largest total up to ``wanted`` that fills all quotas."""
    there = {s for p in patterns for s in p}
    scale = sum(v for s, v in shares.items() if s in there)

    def solve(total: int) -> tuple[bool, dict, dict]:
        quota = {s: int(total * v / scale) for s, v in shares.items() if s in there}
        f = Flow()
        held = {}
        for p, tokens in patterns.items():
            for r in range(max(repeats[s] for s in p)):
                f.add("in", p, tokens, r * r)
            for s in p:
                held[p, s] = f.add(p, s, tokens * repeats[s])
        for s, q in quota.items():
            f.add(s, "out", q)
        full = f.run("in", "out") == sum(quota.values())
        return full, {k: f.arcs[a ^ 1][1] for k, a in held.items()}, quota

    if not scale:
        return {}, {}
    full, flow, quota = solve(wanted)
    low, high = 0, wanted
    while not full and high - low > max(1, high // 100_000):
        mid = (low + high) // 2
        ok, at, q = solve(mid)
        low, high = (mid, high) if ok else (low, mid)
        if ok:
            flow, quota = at, q
    return (flow, quota) if full or low else ({}, {})


def mix(documents: DataFrame, targets: DataFrame, params: MixParams = MixParams()) -> tuple[DataFrame, DataFrame]:
    """(selection, shares): selection (source, doc_id, copies, n_tokens); shares: the report, a row per target source."""
    p, spark = params, documents.sparkSession
    aims = {r.source: (r.share, r.reps) for r in targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("reps")).collect()}
    shares = {s: float(a or 0) for s, (a, r) in aims.items() if (a or 0) > 0 and (r or 0) > 0}
    repeats = {s: int(aims[s][1]) for s in shares}
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").where(F.col("source").isin(list(shares)) & (F.trim("text") != "") & F.col("doc_id").isNotNull())
    counted = materialize(token_counts(spread(texts), p.tokenizer).where("tokens > 0"), "tokens")
    per_source = counted.groupBy("h1", "h2", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    # at most one entry per targeted source
    classes = per_source.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("held"), F.max("tokens").alias("tokens"))
    classes = classes.withColumns({"pattern": F.array_join(F.transform("held", lambda x: x["source"]), "\n"), "u": F.xxhash64("h1", "h2", F.lit(p.seed))})
    n = counted.count()
    buckets = max(1, min(p.max_buckets, n // p.bucket_docs))
    classes = materialize(classes.withColumn("bucket", F.pmod(F.shiftright("u", 20), F.lit(buckets))), "classes")
    sums = classes.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("tokens")).orderBy("pattern", "bucket").collect()  # patterns * buckets rows
    offset, size = [], defaultdict(int)
    for r in sums:
        offset.append((r.pattern, r.bucket, size[r.pattern]))
        size[r.pattern] += r.tokens
    patterns = {tuple(k.split("\n")): v for k, v in size.items()}
    flow, quota = routed(patterns, shares, repeats, p.total or sum(size.values()))
    arcs, start = [], defaultdict(int)
    for (pattern, source), tokens in sorted(flow.items()):
        if tokens:
            arcs.append(("\n".join(pattern), source, start[pattern], tokens, patterns[pattern]))
            start[pattern] += tokens
    arc = spark.createDataFrame(arcs, "pattern string, to string, start long, length long, round long")
    offsets = spark.createDataFrame(offset, "pattern string, bucket long, before long")
    w = Window.partitionBy("pattern", "bucket").orderBy("u", "h1", "h2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = classes.withColumn("upto", F.sum("tokens").over(w)).join(small(offsets), ["pattern", "bucket"]).withColumn("at", F.expr("before + upto - tokens div 2 - 1"))
    # turns of the circle at which the document's point lies on the arc
    copies = F.expr("cast(ceil((start + length - at) / round) - ceil((start - at) / round) AS int)")
    taken = placed.join(small(arc), "pattern").withColumn("copies", copies).where("copies > 0")
    own = F.expr("filter(held, x -> x.source = to)[0].doc_id")
    selection = taken.select(F.col("to").alias("source"), own.alias("doc_id"), "copies", F.col("tokens").alias("n_tokens"))
    got = selection.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("actual_tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    want = spark.createDataFrame([(s, float(a or 0), int(quota.get(s, 0))) for s, (a, _) in sorted(aims.items())], "source string, target_share double, target_tokens long")
    report = want.join(F.broadcast(got), "source", "left").na.fill(0)  # a row per target source
    total = F.sum("actual_tokens").over(Window.partitionBy())
    return selection, report.withColumn("actual_share", F.when(total > 0, F.round(F.col("actual_tokens") / total, 6)).otherwise(0.0))

"""Texts garbled by a wrong character encoding, found and restored.

Adjacent character pairs are counted over all texts, copies of a text outside ASCII by the binary digits of their number,
without the pieces that an inverse mapping explains and without marks of lost characters: a garbled pair gains nothing
from how many texts are garbled alike. A pair's worth is its local mutual information, its probability times the log of how
much more often than by chance it occurs; pairs worth less than ``usual`` are improbable. Maximum-scoring segments (all
maximal ones, in linear time) isolate the improbable runs of a text; pairs of two ASCII characters, which no mapping
changes, part them. Only inside such runs inverse mappings are tested: the run's characters go back to bytes by the code
page they may have been read with and are decoded by the right one. A mapping is accepted if the bytes are valid and the
pairs of the restored text are more probable in the corpus by ``gain`` bits.

A replacement character or a stray C1 control inside a run marks text that cannot be restored; such texts are reported too.

Defined results: a null or empty text and one of plain ASCII is not garbled; rightly decoded rare characters are left as
they are; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.runtime import materialize, small, spread

#: Code pages a UTF-8 text may have been read with, and (read with, written in) pairs of one-byte pages.
UTF8_READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_15", "cp1254", "koi8_r", "cp866")
BYTE_PAIRS = (
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"),
    ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("koi8_r", "cp1252"), ("cp866", "cp1252"),
)


@dataclass(frozen=True)
class EncodingParams:
    usual: float = 5e-5  #: local mutual information from which a pair is not improbable; most rightly decoded pieces then lie outside the runs
    gain: float = 5.0  #: bits by which restored pairs must be more probable
    rounds: int = 3  #: layers of wrong decoding undone
    floor_bits: int = 22  #: pairs of a probability under 2^-floor_bits count as unseen; so at most 2^floor_bits pairs are known, however many texts
    reach: int = 1  #: characters of context on either side


PIECE = re.compile("[^\x00-\x7f]+")
SEEN_ONCE = 40.0  # in a corpus of fewer pairs than this over ``usual`` a pair seen once is not usual yet
LOST = re.compile("[\x80-\x84\x86-\x9f�]")


def _out_of_place(s: str) -> bool:
    """Whether a capital follows a small letter, Latin letters touch others, or a symbol or number stands between letters."""
    for x, y in zip(s, s[1:], strict=False):
        if x.isalpha() and y.isalpha() and (x.islower() and y.isupper() or ("LATIN" in unicodedata.name(x, "")) != ("LATIN" in unicodedata.name(y, ""))):
            return True
    return any(x.isalpha() and z.isalpha() and (unicodedata.category(y)[0] in "SCN" or y in "¡§¶¿") for x, y, z in zip(s, s[1:], s[2:], strict=False))


def explained(left: str, piece: str, right: str, rounds: int) -> bool:
    """Whether a piece looks like a garbled one by itself, however often it occurs.

    It is valid UTF-8 by some page, of usual Latin characters and signs or of more bytes than are valid by chance; or it
    does not stand so inside a word and another one-byte page gives one that does.
    """
    for new, more, _ in _utf8_readings(piece, right == " ", rounds):
        if len(piece) + more - len(new) >= 2 or any(ord(c) < 0x180 or 0x2000 <= ord(c) < 0x2150 for c in new):
            return True
    return _out_of_place(left + piece + right) and any(not _out_of_place(left + new + right) for new, _ in _byte_readings(piece))


def unexplained(text: str, rounds: int, memo: dict) -> str:
    """The text with a NUL for each explained piece."""
    if text.isascii():
        return text

    def kept(m: re.Match) -> str:
        a, b = m.span()
        if LOST.search(m.group()):
            return "\x00"
        key = text[a - 1 : a] if a else "", m.group(), text[b : b + 1]
        if key not in memo:
            memo[key] = explained(*key, rounds)
        return "\x00" if memo[key] else key[1]

    return PIECE.sub(kept, text)


def pair_counts(texts: DataFrame, column: str, rounds: int = EncodingParams.rounds) -> DataFrame:
    """(first int, second int, n): how often code points are adjacent, outside explained pieces, copies of a text as said above."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = np.zeros(128 * 128, np.int64)
        other: dict[int, int] = {}
        memo: dict[tuple[str, str, str], bool] = {}
        for b in batches:
            memo = memo if len(memo) < 200_000 else {}
            joined = "\x00\x00".join("\x00\x00".join([unexplained(x, rounds, memo)] * n.bit_length()) for x, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if x)
            code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            x, y = code[:-1], code[1:]
            low = (x < 128) & (y < 128)
            plain += np.bincount(x[low] * 128 + y[low], minlength=128 * 128)
            v, c = np.unique((x[~low] << 21) | y[~low], return_counts=True)
            for k, n in zip(v.tolist(), c.tolist(), strict=True):
                other[k] = other.get(k, 0) + n
        plain[:128] = 0  # the joints between texts
        plain[::128] = 0
        at = np.flatnonzero(plain)
        keys = np.concatenate([((at // 128) << 21) | (at % 128), np.fromiter(other.keys(), np.int64, len(other))])
        values = np.concatenate([plain[at], np.fromiter(other.values(), np.int64, len(other))])
        first, second = keys >> 21, keys & 0x1FFFFF
        real = (first != 0) & (second != 0)
        yield pa.RecordBatch.from_arrays([pa.array(first[real].astype(np.int32)), pa.array(second[real].astype(np.int32)), pa.array(values[real])], ["first", "second", "n"])

    ascii_only = ~F.col(column).rlike("[^\\x00-\\x7f]")
    once = texts.where(~ascii_only).groupBy(column).count().union(texts.where(ascii_only).select(column, F.lit(1).cast("long")))
    return once.mapInArrow(count, "first int, second int, n long").groupBy("first", "second").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """Known pairs with a character outside ASCII, sorted: pair (first code point * 2^21 + second), how improbable, log2 of the probability."""

    pair: np.ndarray
    score: np.ndarray
    joint: np.ndarray
    unseen: float

    def look(self, pairs: np.ndarray, values: np.ndarray, otherwise: float) -> np.ndarray:
        if not len(self.pair):
            return np.full(len(pairs), otherwise)
        at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        return np.where(self.pair[at] == pairs, values[at], otherwise)


MOST, LEAST = 6.0, -4.0  # bounds of a pair's score


def model(counts: DataFrame, p: EncodingParams) -> Model:
    """What the pairs of at least the floor's probability are worth, with totals and marginals over all pairs."""
    counts = materialize(counts, "pairs")
    total = counts.agg(F.sum("n")).first()[0] or 1
    # code points bound the marginals
    left, right = (small(counts.groupBy(c).agg(F.sum("n").alias(f"n_{c}"))) for c in ("first", "second"))
    chance = F.log2(F.col("n") * F.lit(float(total)) / (F.col("n_first") * F.col("n_second")))
    worth = F.col("n") * F.greatest(chance, F.lit(0.05)) / max(total, SEEN_ONCE / p.usual)
    known = counts.where((F.col("n") >= total / 2.0**p.floor_bits) & ((F.col("first") > 127) | (F.col("second") > 127))).join(left, "first").join(right, "second")
    rows = known.select((F.col("first").cast("long") * (1 << 21) + F.col("second")).alias("pair"), worth.alias("worth"), F.log2(F.col("n") / total).alias("joint")).toArrow()
    pair, value, joint = (rows.column(k).to_numpy() for k in range(3))
    order = np.argsort(pair)
    score = np.clip(np.log2(p.usual / np.maximum(value, 1e-300)), LEAST, MOST)
    # a quarter of the rarest known pair
    return Model(pair[order], score[order], joint[order], -min(p.floor_bits, float(np.log2(total))) - 2)


def pair_codes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (code[:-1] << 21) | code[1:]


def improbable(texts: list[str], known: Model) -> list[list[tuple[int, int]]]:
    """The improbable runs [start, end) of each text: characters whose pairs make up a maximum-scoring segment."""
    joined = "".join(f" {t} \x00" for t in texts)  # a text of one character has pairs too
    pairs = pair_codes(joined)
    x, y = pairs >> 21, pairs & 0x1FFFFF
    score = np.full(len(pairs), LEAST)
    wide = np.flatnonzero((x > 127) | (y > 127))
    each, at = np.unique(pairs[wide], return_inverse=True)
    score[wide] = known.look(each, known.score, MOST)[at]
    score[(x == 0) | (y == 0)] = -1e9  # texts are apart
    # a stretch of scores of one sign enters or leaves a segment as a whole
    cut = np.flatnonzero(np.diff(score > 0, prepend=not (len(score) and score[0] > 0)))
    sums = np.add.reduceat(score, cut) if len(cut) else np.zeros(0)
    ends = np.append(cut[1:], len(score))
    starts = np.cumsum([0] + [len(t) + 3 for t in texts])
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in segments(sums.tolist()):
        k = int(np.searchsorted(starts, cut[a], "right")) - 1
        out[k].append((max(0, int(cut[a] - starts[k]) - 1), min(len(texts[k]), int(ends[b - 1] - starts[k]))))
    return out


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments [start, end) of a sequence, in linear time."""
    out: list[list[float]] = []  # start, end, sum before, sum up to the end
    total = 0.0
    for k, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        now = [k, k + 1, before, total]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= now[2]:
                j -= 1
            if j < 0 or out[j][3] >= now[3]:
                break
            now = [out[j][0], now[1], out[j][2], now[3]]
            del out[j:]
        out.append(now)
    return [(int(a), int(b)) for a, b, _, _ in out]


def _bytes(piece: str, page: str) -> bytes | None:
    """The bytes that, read with the page, gave the piece; bytes the page leaves undefined stand as they are."""
    out = bytearray()
    for ch in piece:
        try:
            out += ch.encode(page)
        except UnicodeEncodeError:
            if 0x80 <= ord(ch) < 0x100 and page.startswith("cp125"):
                out.append(ord(ch))
            else:
                return None
    return bytes(out)


def _text(data: bytes, page: str) -> str | None:
    try:
        return data.decode(page)
    except UnicodeDecodeError:
        return None


def restore(text: str, known: Model, p: EncodingParams, memo: dict | None = None, runs: list[tuple[int, int]] | None = None) -> tuple[str, list[str], int]:
    """(text with the garbled runs restored as far as possible, the mappings used, lost characters inside runs).

    ``runs``: the improbable runs, if they are known; ``memo`` keeps weighed readings by piece and neighbours between texts.
    """
    memo = {} if memo is None else memo
    used: list[str] = []

    def worth(s: str) -> float:
        return float(known.look(pair_codes(s), known.joint, known.unseen).sum()) if len(s) > 1 else 0.0

    def mean(s: str) -> float:
        return worth(s) / max(len(s) - 1, 1)

    def weighed(left: str, piece: str, after: str) -> tuple[list, list]:
        """Readings of a piece as UTF-8 (gain per pair, for fewer characters are no gain in themselves) and by another one-byte page (gain in all)."""
        right, whole = after[: p.reach], left + piece + after[: p.reach]
        as_utf8 = [(mean(left + new + after[more : more + p.reach]) - mean(left + piece + after[: more + p.reach]), new, more, how) for new, more, how in _utf8_readings(piece, after[:1] == " ", p.rounds)]
        as_bytes = [(worth(left + new + right) - worth(whole), new, how, _out_of_place(whole) and not _out_of_place(left + new + right)) for new, how in _byte_readings(piece)]
        return as_utf8, as_bytes

    for turn in range(p.rounds + 1):
        if runs is None:
            runs = [] if text.isascii() else improbable([text], known)[0]
        if turn == p.rounds or not runs:
            break
        changed, out, at, k = False, [], 0, 0
        for m in PIECE.finditer(text):
            a, b = m.span()
            while k < len(runs) and runs[k][1] <= a:
                k += 1
            if a < at or k == len(runs) or runs[k][0] >= b:
                continue
            key = text[max(0, a - p.reach) : a], m.group(), text[b : b + p.reach + 1]
            if key not in memo:
                memo[key] = weighed(*key)
            as_utf8, as_bytes = memo[key]
            best = (0.0, None, None, b)
            for gain, new, more, how in as_utf8:
                # a mapping already seen at work in this text needs less evidence
                if gain > (max(best[0], 0.0) if best[1] or how not in used else -2.0):
                    best = (gain, new, how, b + more)
            if best[1] is None and m.group().strip():
                best = (1.0, None, None, b)
                for gain, new, how, mended in as_bytes:
                    # nor does a piece that only so stands rightly inside its word need as much
                    if gain > best[0] and (gain > p.gain or how in used or gain > p.gain / 2 and mended):
                        best = (gain, new, how, b)
            if best[1] is not None:
                out += [text[at:a], best[1]]
                at, changed = best[3], True
                used.append(best[2])
        if not changed:
            break
        text, runs = "".join(out) + text[at:], None
    return text, used, sum(len(LOST.findall(text, a, b)) for a, b in runs)


def _utf8_readings(piece: str, space: bool, rounds: int) -> list[tuple[str, int, str]]:
    """What a piece may have been if UTF-8 was read with a one-byte page, up to ``rounds`` times: (text, further characters used, mapping).

    ``space``: a space follows, which may have been a no-break space.
    """
    out: list[tuple[str, int, str]] = []
    front = [(piece, 0, "")] + [(piece + "\xa0", 1, "")] * space
    for _ in range(rounds):
        found: dict[tuple[str, int], str] = {}
        for old, more, how in front:
            for page in UTF8_READ_AS:
                data = _bytes(old, page)
                new = _text(data, "utf-8") if data else None
                if new is not None and len(new) < len(old):
                    found.setdefault((new, more), how or f"{page}>utf-8")
        front = [(new, more, how) for (new, more), how in found.items()]
        out += front
        if not front:
            break
    return out


def _byte_readings(piece: str) -> list[tuple[str, str]]:
    """What a piece may have been if one one-byte page was taken for another: (text, mapping)."""
    out: dict[str, str] = {}
    for page, true in BYTE_PAIRS:
        data = _bytes(piece, page)
        new = _text(data, true) if data else None
        if new is not None and new != piece and not LOST.search(new):
            out.setdefault(new, f"{page}>{true}")
    return list(out.items())


def garbled(documents: DataFrame, params: EncodingParams = EncodingParams(), key: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, restored, mappings, lost): the garbled documents; lost: characters that cannot be restored."""
    p, spark = params, documents.sparkSession
    texts = spread(documents.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("text")).where("doc_id IS NOT NULL AND text <> ''"))
    known = model(pair_counts(texts, "text", p.rounds), p)
    shared = spark.sparkContext.broadcast((known.pair, known.score, known.joint, known.unseen))  # plain arrays: workers need not have this package

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo = Model(*shared.value), {}
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            memo = memo if len(memo) < 200_000 else {}
            rows, docs = [], b.column(1).to_pylist()
            for doc, text, runs in zip(b.column(0).to_pylist(), docs, improbable(docs, known), strict=True):
                if not runs:
                    continue
                fixed, used, lost = restore(text, known, p, memo, runs)
                if used or lost:
                    rows.append((doc, fixed, sorted(set(used)), lost))
            if rows:
                d, t, u, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.string()), pa.array(u, pa.list_(pa.string())), pa.array(n, pa.int32())], ["doc_id", "restored", "mappings", "lost"])

    return texts.where(F.col("text").rlike("[^\\x00-\\x7f]")).mapInArrow(repair, "doc_id long, restored string, mappings array<string>, lost int")

"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_batches
from .common import free_name, prefix_sums, stored

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Slices that a length's pieces are ranked by: so many at least, and one for so many pieces of the table.
SLICES, SLICE_PIECES = 64, 1_000_000
#: Full sequences that a position range has at least.
LEAST_SEQUENCES = 100
#: Distinct chunks whose ids a worker keeps; the cache starts anew beyond that.
CACHE = 600_000

_SPACE = "\t-\r\x20\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with the one space before it, or white space: the tokenizer never joins across these borders.
CHUNK = re.compile(f"\x20?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Texts with these are encoded whole: regular-expression libraries differ on which of them are white space.
ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ChunkEncoder:
    """Token ids of texts as little-endian 32-bit bytes; equal to the tokenizer's, chunk by chunk.

    New chunks are merged by a second library from the same vocabulary, which is faster
    on short strings; odd texts go through the tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        sign = byte_of_sign()
        ranks = {bytes(sign[c] for c in token): i for token, i in self.whole.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.merge = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for text in texts:
            if ODD.search(text) or any(s in text for s in self.special):
                out.append(self.pack(self.whole.encode(text, add_special_tokens=False).ids))
                continue
            chunks = CHUNK.findall(text)
            for c in set(chunks).difference(known):
                ids = self.merge(c)
                known[c] = struct.pack(f"<{len(ids)}I", *ids)
            out.append(b"".join(map(known.__getitem__, chunks)))
        return out


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all full but the first, which takes the rest."""
    n = max(1, -(-length // capacity))
    first = length - (n - 1) * capacity
    return [(0, first)] + [(first + k * capacity, capacity) for k in range(n - 1)]


MADE = ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")


def token_pieces(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, carried: tuple[str, ...] = ()
) -> DataFrame:
    """(id, *carried, piece, start, length, ids_crc32[, ids]): each text's ids and END_ID, cut into pieces.

    Null counts as empty: a piece of the end id alone. Rows with equal ids are texts of
    their own. ``carried`` names further columns that each piece keeps.
    """
    if clash := [c for c in (id_col, *carried) if c.lower() in MADE]:
        raise ValueError(f"columns that pieces have themselves: {clash}")
    path = tokenizer or tokenizer_path()
    rows = df.select(F.col(text_col).alias("text"), F.struct(id_col, *carried).alias("own"))
    kind = rows.schema["own"].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = ChunkEncoder(path)

        def apply(batch):
            out = {k: [] for k in ("piece", "start", "length", "ids_crc32")}
            at = []
            if with_ids:
                out["ids"] = []
            coded = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            for row, ids in enumerate(coded):
                ids += end
                for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[start * 4 : (start + length) * 4]
                    at.append(row)
                    out["piece"].append(n)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            return out | {"own": batch.column("own").take(pa.array(at, pa.int64()))}

        return apply

    schema = f"own {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return map_batches(rows, schema, make).select("own.*", *MADE[: 5 if with_ids else 4])


def two_tightest(lengths: list[int], counts: dict[int, int], least: int, most: int) -> tuple[int, int] | None:
    """Two lengths that are there with the largest sum in (least, most]."""
    best, pair = least, None
    low, high = 0, bisect_right(lengths, most) - 1
    while low <= high:
        a, b = lengths[low], lengths[high]
        if a + b > most or (low == high and counts[a] < 2):
            high -= 1
            continue
        if a + b > best:
            best, pair = a + b, (b, a)
            if best == most:
                break
        low += 1
    return pair


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins), which use up the histogram.

    A bin is filled greedily with the longest that fits; while it has a gap, its smallest
    piece is exchanged for two unpacked ones that fill the widened gap more tightly.
    Equal bins are made at once, as often as the counts allow, so that the work depends
    on the number of distinct lengths (capacity at most), not on the number of pieces.
    """
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(counts)
    plan: list[tuple[list[int], int]] = []

    def take(n: int) -> None:
        counts[n] -= 1
        if not counts[n]:
            del counts[n]
            lengths.remove(n)

    def put(n: int) -> None:
        if n not in counts:
            insort(lengths, n)
            counts[n] = 0
        counts[n] += 1

    while lengths:
        bin_, gap = [], capacity
        while (at := bisect_right(lengths, gap)) > 0:
            n = lengths[at - 1]
            fit = min(gap // n, counts[n])
            for _ in range(fit):
                take(n)
            bin_ += [n] * fit
            gap -= n * fit
        while gap > 0 and len(bin_) > 1:
            small = bin_[-1]
            pair = two_tightest(lengths, counts, small, gap + small)
            if pair is None:
                break
            for n in pair:
                take(n)
            put(small)
            bin_.pop()
            bin_ = sorted([*bin_, *pair], reverse=True)
            gap += small - sum(pair)
        need = {n: bin_.count(n) for n in set(bin_)}
        again = min(counts.get(n, 0) // k for n, k in need.items())
        if again:
            for n, k in need.items():
                counts[n] -= k * again
                if not counts[n]:
                    del counts[n]
                    lengths.remove(n)
        plan.append((bin_, 1 + again))
    return plan


def places(plans: dict[int, list[tuple[list[int], int]]]) -> dict[str, np.ndarray]:
    """For each length of each range, which of its pieces (by rank) go where: a row for each length of each kind of bin.

    Rank r of a length belongs to the row with the largest ``first`` up to r; it goes to
    bin base + (r - first) // each, at offset + (r - first) % each * length. Bins are
    numbered through the ranges in their order.
    """
    rows, base = [], 0
    for part in sorted(plans):
        used: dict[int, int] = {}
        for bin_, times in plans[part]:
            offset = 0
            for n in dict.fromkeys(bin_):
                each = bin_.count(n)
                rows.append((part, n, used.get(n, 0), base, each, offset))
                used[n] = used.get(n, 0) + each * times
                offset += n * each
            base += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("range", "length", "first", "base", "each", "offset"))}


def wide_ranges(histograms: dict[int, dict[int, int]], capacity: int, least: int = LEAST_SEQUENCES) -> dict[int, int]:
    """Range -> the first of the neighbouring ranges that it is packed with, so that they have tokens for ``least`` sequences."""
    out, first, tokens = {}, None, 0
    for r in sorted(histograms):
        if first is None or tokens >= least * capacity:
            first, tokens = r, 0
        out[r] = first
        tokens += sum(n * c for n, c in histograms[r].items())
    return out


def place_key(part: np.ndarray, length: np.ndarray, first: np.ndarray, capacity: int) -> np.ndarray:
    """One number that sorts as (range, length, rank): ranks below 2^42."""
    return ((part * np.int64(capacity + 1) + length) << np.int64(42)) + first


def best_fit_pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, range_col: str | None = None) -> DataFrame:
    """All rows and columns of ``pieces`` plus sequence_id and offset.

    ``pieces`` has ``length`` (1 to capacity) and should be a written table, as it is read
    three times. The driver gets the histogram (capacity rows at most) and plans the bins;
    pieces are ranked within their lengths by slices, so that a length that a third of
    all pieces has is not one task, and each looks up its place in the plan by length and
    rank. No piece but those of one length slice meet in a task.

    ``range_col``: an integer from 0 on (a few hundred at most, as the driver gets a
    histogram for each); neighbouring ranges are put together until they fill LEAST_SEQUENCES.
    A sequence has pieces of one such range, and sequences are numbered in their order.
    """
    one, part, rank, within = (free_name(pieces, x) for x in ("_one", "_part", "_rank", "_range"))
    pieces = pieces.withColumn(within, F.col(range_col).cast("long") if range_col else F.lit(0).cast("long"))
    histograms: dict[int, dict[int, int]] = {}
    for r, n, c in pieces.groupBy(within, "length").count().collect():
        histograms.setdefault(int(r), {})[int(n)] = int(c)
    merged = wide_ranges(histograms, capacity)
    pieces = pieces.withColumn(within, F.element_at(F.array(*[F.lit(merged.get(r, 0)) for r in range(max(merged, default=0) + 1)]), (F.col(within) + 1).cast("int")))
    joined: dict[int, dict[int, int]] = {}
    for r, h in histograms.items():
        own = joined.setdefault(merged[r], {})
        for n, c in h.items():
            own[n] = own.get(n, 0) + c
    table = places({r: plan_bins(h, capacity) for r, h in joined.items()})
    slices = max(SLICES, sum(sum(h.values()) for h in histograms.values()) // SLICE_PIECES)
    ranked = prefix_sums(
        pieces.withColumn(one, F.lit(1).cast("long")).withColumn(part, F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int")), [within, "length"], part, order, one, rank
    ).drop(one, part)
    shared = pieces.sparkSession.sparkContext.broadcast(table)
    keep = [f for f in ranked.schema.fields if f.name.lower() not in (rank, within, "sequence_id", "offset")]
    kinds = T.StructType([*keep, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def make():
        t = shared.value
        keys = place_key(t["range"], t["length"], t["first"], capacity)

        def apply(batch):
            r, length, nth = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in (within, "length", rank))
            at = np.searchsorted(keys, place_key(r, length, nth, capacity), side="right") - 1
            nth = nth - t["first"][at]
            return {f.name: batch.column(f.name) for f in keep} | {
                "sequence_id": t["base"][at] + nth // t["each"][at],
                "offset": t["offset"][at] + nth % t["each"][at] * length,
            }

        return apply

    return map_batches(ranked, kinds, make)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack: (id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    An empty table gives no rows, a null text is empty. Equal ids, also null ones, are
    documents of their own. Other columns are ignored.
    """
    pieces = stored(token_pieces(df, id_col, text_col, tokenizer, capacity, with_ids), "pieces")
    return best_fit_pack(pieces, [id_col, "piece", "ids_crc32"], capacity)


def pack_in_order(
    df: DataFrame, position: str, carried: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, ranges: int = 64
) -> DataFrame:
    """Tokenise and pack along a training order: (id, *carried, position, piece, start, length, ids_crc32, ids, sequence_id, offset).

    ``position`` is a column in 0..1 (null counts as 0), cut into ``ranges`` equal ranges:
    sequences have documents of one range and are numbered in the order of ranges, so that
    who reads them by number trains along the curriculum. Ranges with few tokens are put
    together; each may leave one sequence open more than packing all at once would. Nulls, repeated ids and empty tables as in
    pack_documents; repeats of a document are told apart by ``carried``.
    """
    pieces = token_pieces(df, id_col, text_col, tokenizer, capacity, True, (*carried, position))
    part = free_name(pieces, "_position_range")
    at = F.least(F.greatest(F.floor(F.coalesce(position, F.lit(0.0)) * ranges), F.lit(0)), F.lit(ranges - 1))
    pieces = stored(pieces.withColumn(part, at.cast("int")), "pieces")
    return best_fit_pack(pieces, [id_col, *carried, position, "piece", "ids_crc32"], capacity, part).drop(part)

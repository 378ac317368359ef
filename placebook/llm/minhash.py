"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures, confirmed on full sets."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from .arrow import map_batches
from .common import discard, stored

#: A signature has CHUNKS x SYMBOLS symbols of 8 bits. A pair that differs in fewer than
#: CHUNKS * (ERRORS + 1) symbols differs in ERRORS at most in some chunk (pigeonhole), so
#: that it shares a key of that chunk with the differing symbol left out.
CHUNKS, SYMBOLS, ERRORS = 12, 6, 1
WIDTH = CHUNKS * SYMBOLS
GUARANTEED = CHUNKS * (ERRORS + 1) - 1
SEED = 29
#: A second signature of single bits sorts out pairs before their sets are compared. A pair
#: at the similarity passes but for FINE_SDS standard deviations.
FINE, FINE_SDS = 1024, 6.0
#: Rows of a bucket that are compared in one group, on average.
BLOCK = 512
#: Words whose hashes a worker keeps; the cache starts anew beyond that.
CACHE = 300_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word, SEED)
        return h


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted 64-bit hashes of the distinct shingles of ``size`` words."""

    def __init__(self, size: int) -> None:
        self.size, self.words = size, WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.split() cuts at the space and 0x09-0x0D
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > CACHE:
            self.words.clear()
        run = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(run))
        n = len(run) - size + 1
        out = np.full(n, np.uint64(size))  # a short text is one shingle, unlike any longer one
        for k in range(size):
            out = scramble(out * MIX[k % 5] + run[k : k + n])
        return np.unique(out)


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) for _ in range(2))
    return a | np.uint64(1), b | np.uint64(1)


def smallest(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation, scrambled so that its low bits are even ones."""
    low, step = np.full(len(a), np.iinfo(np.uint64).max, np.uint64), max(1, 32_768 // len(a))
    for at in range(0, len(shingles), step):
        low = np.minimum(low, (shingles[at : at + step, None] * a + b).min(axis=0))
    return scramble(low)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """Eight bits of the smallest value of each permutation."""
    return (smallest(shingles, a, b) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def bits(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One bit of the smallest value of each permutation, in 64-bit words."""
    return np.packbits((smallest(shingles, a, b) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """For each signature CHUNKS x SYMBOLS keys: a chunk without one of its symbols, with the place of both."""
    parts = signatures.reshape(-1, CHUNKS, SYMBOLS).astype(np.int64)
    out = np.empty(parts.shape, np.int64)
    for gap in range(SYMBOLS):
        key = np.arange(CHUNKS, dtype=np.int64) * SYMBOLS + gap
        for k in range(SYMBOLS):
            if k != gap:
                key = (key << 8) | parts[:, :, k]
        out[:, :, gap] = key
    return out.reshape(len(parts), -1)


def sketches(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, digest, sig): set size, digest of the whole set, signature; null ones for texts without words."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def make():
        shingle, (a, b) = Shingler(size), permutations(WIDTH, SEED)

        def apply(batch):
            sets = [shingle(t) for t in batch.column("text").to_pylist()]
            return {
                "id": batch.column("id"),
                "n": [len(s) for s in sets],
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "sig": [signature(s, a, b) if len(s) else None for s in sets],
            }

        return apply

    return map_batches(rows, f"id {kind}, n bigint, digest binary, sig binary", make)


def key_rows(reps: DataFrame) -> DataFrame:
    """(key, rep): all keys of the signatures in (rep, sig)."""
    kind = dict(reps.dtypes)["rep"]

    def make():
        def apply(batch):
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, WIDTH)
            keys = keys_of(sig)
            ids = batch.column("rep").take(np.repeat(np.arange(len(keys)), keys.shape[1]))
            return {"key": keys.ravel(), "rep": ids}

        return apply

    return map_batches(reps.select("rep", "sig"), f"key bigint, rep {kind}", make)


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """(rep, n, shingles, chunks, fine) of (rep, text): the set, the signature's chunks as numbers, the fine bits."""
    kind = dict(texts.dtypes)["rep"]

    def make():
        shingle, (a, b), (c, d) = Shingler(size), permutations(WIDTH, SEED), permutations(FINE, SEED + 1)

        def apply(batch):
            sets = [shingle(t) for t in batch.column("text").to_pylist()]
            sig = np.frombuffer(b"".join(signature(s, a, b) for s in sets), np.uint8).reshape(-1, CHUNKS, SYMBOLS).astype(np.int64)
            chunks = np.zeros(sig.shape[:2], np.int64)
            for k in range(SYMBOLS):
                chunks = (chunks << 8) | sig[:, :, k]
            return {
                "rep": batch.column("rep"),
                "n": [len(s) for s in sets],
                "shingles": [s.view(np.int64) for s in sets],
                "chunks": list(chunks),
                "fine": [bits(s, c, d) for s in sets],
            }

        return apply

    return map_batches(texts, f"rep {kind}, n bigint, shingles array<bigint>, chunks array<bigint>, fine array<bigint>", make)


def near_pairs(t: pa.Table, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of the candidate pairs among rows sorted by (key, i, j).

    Rows of one (key, i, j) meet: with i = j all pairs, else those over the two blocks. A
    pair must be of two components, of sizes that allow the similarity, near in both
    signatures, and the key must be the first that the pair shares, so that no pair is
    made twice: of its keys that is the one in the first chunk with ERRORS unlike symbols
    or fewer, and, if none is unlike there, without the chunk's first symbol.
    """
    col = {c: t.column(c).to_numpy() for c in ("key", "i", "j", "b", "rep", "comp", "n", "top")}
    chunks, fine = (t.column(c).combine_chunks().flatten().to_numpy().reshape(len(t), -1) for c in ("chunks", "fine"))
    new = np.ones(len(t), bool)
    new[1:] = (col["key"][1:] != col["key"][:-1]) | (col["i"][1:] != col["i"][:-1]) | (col["j"][1:] != col["j"][:-1])
    start = np.flatnonzero(new)
    end = np.repeat(np.append(start[1:], len(t)), np.diff(np.append(start, len(t))))
    place = col["key"] >> 8 * (SYMBOLS - 1)
    later = end - np.arange(len(t)) - 1  # rows of the group after each row
    found_x, found_y = [], []
    at = 0
    while at < len(t):
        # rows that make about a million pairs at once
        stop = max(at + 1, int(np.searchsorted(np.cumsum(later[at:]), 1_000_000)) + at)
        x = np.repeat(np.arange(at, stop), later[at:stop])
        y = np.arange(len(x)) - np.repeat(np.cumsum(later[at:stop]) - later[at:stop], later[at:stop]) + x + 1
        at = stop
        ok = (col["comp"][x] != col["comp"][y]) & (col["n"][x] <= col["top"][y]) & (col["n"][y] <= col["top"][x]) & (col["rep"][x] != col["rep"][y])
        ok &= (col["i"][x] == col["j"][x]) | (col["b"][x] != col["b"][y])
        x, y = x[ok], y[ok]
        ok = np.bitwise_count((fine[x] ^ fine[y]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= limit  # of a negative number it counts the absolute value
        x, y = x[ok], y[ok]
        unlike = (chunks[x] ^ chunks[y]).view(np.uint8).reshape(len(x), CHUNKS, 8)
        unlike = np.count_nonzero(unlike, axis=2)
        near = unlike <= ERRORS
        first = near.argmax(axis=1)
        ok = near.any(axis=1) & (place[x] // SYMBOLS == first)
        ok &= (unlike[np.arange(len(x)), first] > 0) | (place[x] % SYMBOLS == 0)
        found_x.append(x[ok])
        found_y.append(y[ok])
    return np.concatenate(found_x), np.concatenate(found_y)


def candidates(rest: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of ``rest`` to confirm; see near_pairs.

    A bucket of more than BLOCK rows is cut into blocks by a hash of the ids, and each two
    of its blocks meet in a group of their own, so that no task holds a large bucket.
    """
    ship(rest.sparkSession)
    kind = dict(rest.dtypes)["rep"]
    b = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    met = rest.withColumn("b", b).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"i": F.least("b", "other"), "j": F.greatest("b", "other")}).drop("other", "blocks")
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    q = (100 - percent) / 200
    limit = int(FINE * q + FINE_SDS * (FINE * q * (1 - q)) ** 0.5)
    schema = T._parse_datatype_string(f"a {kind}, b {kind}")

    def run(batches):
        held, to = None, to_arrow_schema(schema)
        for batch in chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                if len(held) < 2 * BLOCK:
                    continue
                last = [held.column(c)[-1].as_py() for c in ("key", "i", "j")]
                tail = np.logical_and.reduce([held.column(c).to_numpy() == v for c, v in zip(("key", "i", "j"), last, strict=True)])
                whole = len(held) - int(tail.sum())  # the last group may go on in the next batch
                now, held = held.slice(0, whole), held.slice(whole)
            else:
                now = held
            if now is not None and len(now):
                x, y = near_pairs(now, limit)
                rep = now.column("rep").combine_chunks()
                x, y = rep.take(pa.array(x)), rep.take(pa.array(y))
                yield pa.RecordBatch.from_arrays([pc.min_element_wise(x, y), pc.max_element_wise(x, y)], schema=to)

    return met.mapInArrow(run, schema)


def similar(both: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * both >= percent * (n_a + n_b - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. The hot one of a pair is split by the skew join."""
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(left, "a").join(right, "b").filter(similar(both, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, comp): for each node of the links (a, b) the smallest node that it reaches.

    Links are contracted: each node takes the first of itself and its neighbours, links go on
    between what their ends took, equal ones as one, and those within one go, until none is
    left. First is the smallest node, and from the second round on the one with the smallest
    hash, which is another one in each round: so any chain or star loses a share of its nodes
    a round, whatever their order, and all rounds together read a few times the links.
    Links and what was taken are written tables, so that a hot node's links are split.
    """
    taken, links = [], stored(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), f"{name}-links")
    while not taken or links.limit(1).count():
        step, known = len(taken), links
        ranked = lambda c: F.struct(*[F.xxhash64(c, F.lit(step)).alias("rank")][: bool(step)], F.col(c).alias("node"))  # noqa: B023, E731
        low = links.groupBy("a").agg(F.min(ranked("b")).alias("low"))
        to = stored(low.select(F.col("a").alias("node"), F.least("low", ranked("a"))["node"].alias("comp")), f"{name}-{step}")
        for x in ("a", "b"):
            links = links.join(to.select(F.col("node").alias(x), F.col("comp").alias(f"to_{x}")), x)
        links = stored(links.filter("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), f"{name}-links")
        discard(known)
        taken.append(to)
    discard(links)
    comps = taken.pop()
    while taken:
        before, after = taken.pop(), comps
        up = after.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        comps = stored(before.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), f"{name}-up")
        discard(before, after)
    least = comps.groupBy("comp").agg(F.min("node").alias("least"))
    out = stored(comps.join(least, "comp").select("node", F.col("least").alias("comp")), name)
    discard(comps)
    return out


def merged(comps: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """The components ``comps`` (node, comp) with more links (a, b), of which only those over two components matter."""
    for x in ("a", "b"):
        of = comps.select(F.col("node").alias(x), F.col("comp").alias(f"of_{x}"))
        found = found.join(of, x, "left").withColumn(x, F.coalesce(f"of_{x}", x)).drop(f"of_{x}")
    up = components(found, f"{name}-over")
    old = comps.join(up.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    out = stored(old.unionByName(up.join(comps, "node", "left_anti")), name)
    discard(up)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept): a row for each input row.

    Documents are linked if the Jaccard similarity of their sets of word shingles is at
    least ``percent`` per cent; component_id is the smallest id that a document reaches
    over links. Ids may be of any type that has an order. Words are cut at ASCII white space, A-Z in lower case; a text with fewer
    words than ``size`` has its whole sequence as one shingle. Null texts and texts
    without words have an empty set and are linked with nothing. Rows with a null id are
    linked with nothing and have a null component and kept = false. Rows with equal ids
    are one document as to components. Other columns are ignored.

    1. Documents with equal sets are one class from here on; its smallest id stands for it.
    2. Classes meet in the buckets of the multi-index: all pairs with GUARANTEED or fewer
       differing symbols share one. Each class is compared with one leader, the smallest
       id that it shares most buckets with; that gives most links, in linear work.
    3. Buckets whose classes are then in one component need no more. In the rest every
       pair over two components is compared, but for those that provably can't reach the
       similarity: shingles that no other class of the rest has can't be shared, which
       bounds the size of a partner. A finer signature sorts out most of the others before
       sets are compared. Nothing is capped; no pair within a component is made, and none
       twice.
    4. Confirmation joins full sets, of which each shingle is a 64-bit hash (two unlike ones
       of a pair are the same with a probability of 2^-64). They are made anew from the texts
       of classes in shared buckets only.

    The join finds all pairs under the signature-distance threshold; a pair at similarity s
    is over it with the probability that more than GUARANTEED of WIDTH symbols differ: at
    s = 0.85 8e-5, at s = 0.8 0.5 %, less at higher ones (and such a pair may still share a
    key, or be joined over a third document).
    """
    looked = stored(sketches(df, id_col, text_col, size), "sketches")
    sets = looked.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
    reps = stored(sets.groupBy("digest").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "classes")

    keys = key_rows(reps)
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("leader")).filter("m > 1").select("key", "leader"), "shared")
    buckets = stored(keys.join(shared, "key"), "buckets")

    votes = buckets.filter("rep <> leader").groupBy(F.col("rep").alias("a"), F.col("leader").alias("b")).count()
    first = stored(votes.groupBy("a").agg(F.min_by("b", F.struct(-F.col("count"), "b")).alias("b")), "first")
    members = buckets.select(F.col("rep")).distinct()
    texts = df.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(members, "rep", "left_semi")
    full = stored(full_sets(texts, size), "sets")
    links = stored(confirmed(first, full, percent), "links")
    discard(shared, first)
    comps = components(links, "comps")

    # what is left: buckets with classes of two or more components
    at = stored(buckets.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp")), "labelled")
    mixed = stored(at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo < hi").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "mixed")
    rest = at.join(mixed, "key")
    inside = stored(rest.select("rep").distinct(), "inside")
    some = stored(full.join(inside, "rep", "left_semi"), "some")
    own = some.select("rep", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("rep")).filter("m = 1")
    alone = own.groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))
    # x and y share at most n - alone shingles; at the similarity p they share p / (1 + p) (n_x + n_y)
    sizes = some.select("rep", "n").join(alone, "rep", "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0)))
    sizes = sizes.withColumn("top", F.floor(F.col("most") * (100 + percent) / percent - F.col("n") + 1e-6)).filter(100 * F.col("top") >= percent * F.col("n"))
    rest = stored(rest.join(sizes.join(some.select("rep", "chunks", "fine"), "rep").select("rep", "n", "top", "chunks", "fine"), "rep"), "rest")
    discard(buckets, at, mixed, inside, some)
    pairs = stored(candidates(rest, percent), "pairs")
    discard(rest)
    more = stored(confirmed(pairs, full, percent), "more")
    discard(pairs)
    if more.limit(1).count():
        discard(comps)
        comps = components(links.union(more), "all")

    of_class = stored(reps.select("digest", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("digest").alias("d"), F.coalesce("comp", "rep").alias("comp")), "ends")
    discard(reps, comps, links, more, full)
    out = looked.join(of_class, F.col("digest") == F.col("d"), "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))

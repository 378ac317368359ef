"""Jaccard join of word n-gram sets by PartEnum signatures, confirmed on full sets."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from .arrow import map_batches
from .common import discard, stored, sweep
from .minhash import Shingler, components, confirmed, merged, scramble

#: A band holds the sets with FIRST * WIDEN^b to FIRST * WIDEN^(b + 1) shingles, and serves pairs whose larger set is in it.
FIRST, WIDEN = 8, 2
#: A signature's lowest bits are its band.
BANDS = 64
#: Parts of the shingles' domain, for a band: this share of its largest size, and some more that small sets need.
PARTS, MORE_PARTS = 0.375, 16
#: Bits of the parities that sort out pairs, where nothing else is said, and rows of a bucket that are compared in one group, on average.
PARITIES, BLOCK = 2_048, 512
#: Digests of sets that a task remembers, and rows of one key that it holds at once.
SEEN, HELD = 200_000, 65_536
#: Places of hashes of ids, of which those of the asked-for ones are broadcast: a fixed number, of any number of ids.
PLACES = 1 << 21
#: Rounds in which each class is compared with its nearest candidate only, before all that are left are, and of how many such pairs one must be a link for another round.
ROUNDS, WORTH = 8, 10
#: Buckets that a class names: of those that two classes both name, only the first makes their pair.
NAMED = 8
SEED = np.uint64(0x9E3779B97F4A7C15)


def apart(n_a: int, n_b: int, percent: int) -> int:
    """The most shingles in which sets of these sizes differ if 100 I >= percent U."""
    return (100 - percent) * (n_a + n_b) // (100 + percent)


def band_of(n: int) -> int:
    """The band of a size; band 0 takes all sets smaller than its upper end, too."""
    band, upper = 0, FIRST * WIDEN
    while n >= upper:
        band, upper = band + 1, upper * WIDEN
    return band


def part_count(band: int, doublings: int) -> int:
    return (int(PARTS * FIRST * WIDEN ** (band + 1)) + MORE_PARTS) << doublings


def bands_of(n: int, percent: int) -> list[int]:
    """The bands of all sizes that the larger set of a pair with a set of ``n`` may have."""
    return list(range(band_of(n), band_of(100 * n // percent) + 1))


def needed(n: int, percent: int) -> int:
    """So many non-empty parts are signed: one more than a partner can differ in."""
    return apart(n, 100 * n // percent, percent) + 1


def part_of(shingles: np.ndarray, parts: int) -> np.ndarray:
    """The part of each shingle, by its upper bits."""
    return (spread(shingles) * np.uint64(parts)) >> np.uint64(32)


def spread(shingles: np.ndarray) -> np.ndarray:
    return scramble(shingles ^ SEED) >> np.uint64(32)


def doublings(shingles: np.ndarray, percent: int) -> dict[int, int]:
    """For each band of the set how often the band's parts must be doubled until enough of them are not empty."""
    out, want = {}, needed(len(shingles), percent)
    for band in bands_of(len(shingles), percent):
        k = 0
        while len(np.unique(part_of(shingles, part_count(band, k)))) < want:
            k += 1
        out[band] = k
    return out


def signatures(shingles: np.ndarray, percent: int, doubled: dict[int, int]) -> np.ndarray:
    """The set's PartEnum signatures.

    The domain of shingles is cut into parts, more than two sets of a pair can differ in, so
    that they are alike in some: the subsets that are enumerated are single parts. A signature
    is a part with all of the set's shingles in it. Of the parts in their order those are
    taken that are not empty, until they are one more than the set can differ from a partner
    in: then one of them is alike in both, and, as the rule is the same for either set, the
    one that stops first has it among its own, and so has the other.
    """
    found, want = [], needed(len(shingles), percent)
    place = spread(shingles)
    order = np.argsort(place)  # parts are ranges of it, in any band
    place, mixed = place[order], scramble(shingles[order] * SEED)
    for band in bands_of(len(shingles), percent):
        part = (place * np.uint64(part_count(band, doubled.get(band, 0)))) >> np.uint64(32)
        start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        whole = np.add.reduceat(mixed, start)[:want]
        key = scramble(whole ^ scramble(part[start][:want] * np.uint64(2_654_435_769)))
        found.append((key & ~np.uint64(BANDS - 1)) | np.uint64(band))
    return np.concatenate(found)


def parities(shingles: np.ndarray, bits: int = PARITIES) -> np.ndarray:
    """``bits`` bits: of how many shingles fall to each, the last bit. Two sets differ in as many shingles as bits, or more.

    The halves of 2^k bits, one xor the other, are the 2^(k-1) bits of the set.
    """
    count = np.bincount((scramble(shingles + SEED) >> np.uint64(24)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64)


def parity_bits(n: int, percent: int) -> int:
    """Bits for the largest band of a set: as many as the band's sets have shingles, so that they tell large ones apart, too."""
    return max(64, FIRST * WIDEN ** (bands_of(n, percent)[-1] + 1))


def signed(rows: DataFrame, size: int, percent: int, doubled: dict[int, int]) -> DataFrame:
    """(id, n, digest, keys, fine, doubled) of (id, text): set size, digest of the set, its signatures and parities, and the doublings of its bands that it needs.

    Of equal sets that a task meets only the first has keys.
    """
    kind = dict(rows.dtypes)["id"]

    def make():
        shingle, seen = Shingler(size), set()

        def apply(batch):
            sets = [shingle(t) for t in batch.column("text").to_pylist()]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            keys, more = [None] * len(sets), [[] for _ in sets]
            for at, (s, d, known) in enumerate(zip(sets, digest, batch.column("id").is_valid().to_pylist(), strict=True)):
                if d is None or not known or d in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(d)
                keys[at] = signatures(s, percent, doubled).view(np.int64)
                if len(keys[at]) < needed(len(s), percent) * len(bands_of(len(s), percent)):
                    more[at] = [(b, k) for b, k in doublings(s, percent).items() if k > doubled.get(b, 0)]
            fine = [parities(s, parity_bits(len(s), percent)) if k is not None else None for s, k in zip(sets, keys, strict=True)]
            return {"id": batch.column("id"), "n": [len(s) for s in sets], "digest": digest, "keys": keys, "fine": fine, "doubled": more}

        return apply

    return map_batches(rows, f"id {kind}, n bigint, digest binary, keys array<bigint>, fine array<bigint>, doubled array<struct<band:int,k:int>>", make)


def set_rows(texts: DataFrame, size: int) -> DataFrame:
    """(rep, n, digest, shingles) of (rep, text)."""

    def make():
        shingle = Shingler(size)

        def apply(batch):
            sets = [shingle(t) for t in batch.column("text").to_pylist()]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            return {"rep": batch.column("rep"), "n": [len(s) for s in sets], "digest": digest, "shingles": [s.view(np.int64) for s in sets]}

        return apply

    return map_batches(texts, "rep bigint, n bigint, digest binary, shingles array<bigint>", make)


def bucket_rows(key: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, rep, leader) of the buckets in whole groups of rows sorted by key: those with two classes or more, each class once.

    Buckets with the same classes get the same key, made of their classes and the band; the leader is the least class.
    """
    same = key[1:] == key[:-1]
    some = np.append(same, False) | np.append(False, same)
    key, rep = key[some], rep[some]
    order = np.lexsort((rep, key))
    key, rep = key[order], rep[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (rep[1:] != rep[:-1]))[: len(key)]
    key, rep = key[fresh], rep[fresh]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    size = np.diff(np.append(start, len(key)))
    whole = np.add.reduceat(scramble(rep.view(np.uint64) ^ SEED), start) if len(start) else np.zeros(0, np.uint64)
    own = ((scramble(whole) & ~np.uint64(BANDS - 1)) | (key[start].view(np.uint64) & np.uint64(BANDS - 1))).view(np.int64)
    kept = np.repeat(size > 1, size)
    return np.repeat(own, size)[kept], rep[kept], np.repeat(rep[start], size)[kept]


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, rep, leader) of (key, rep): the buckets of two classes or more; see bucket_rows.

    Rows meet once, sorted by key. Of a key with more than HELD rows no more are held: they
    go on as they come, under their own key and the leader of the first ones.
    """
    ship(keys.sparkSession)
    schema = T._parse_datatype_string("key bigint, rep bigint, leader bigint")

    def run(batches):
        to, none = to_arrow_schema(schema), np.zeros(0, np.int64)
        key, rep, long = none, none, None  # long: (key, leader) of a key with too many rows to hold
        batch = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=to)
        for b in chain(batches, [None]):
            if b is not None:
                key, rep = (np.concatenate([x, b.column(c).to_numpy()]) for x, c in ((key, "key"), (rep, "rep")))
            if long and len(key):
                end = int(np.argmax(key != long[0])) if key[-1] != long[0] else len(key)
                if end:
                    each = np.unique(rep[:end])
                    yield batch(np.full(len(each), long[0]), each, np.full(len(each), long[1]))
                key, rep = key[end:], rep[end:]
                long = None if len(key) else long
            if not len(key):
                continue
            end = len(key) if b is None else int(np.argmax(key == key[-1]))  # the last key may go on in the next batch
            if end and len((out := bucket_rows(key[:end], rep[:end]))[0]):
                yield batch(*out)
            key, rep = key[end:], rep[end:]
            if len(key) > HELD:
                each = np.unique(rep)
                if len(each) > 1:
                    yield batch(np.full(len(each), key[0]), each, np.full(len(each), each[0]))
                    key, rep, long = none, none, (key[0], each[0])
                else:
                    key, rep = key[:1], each

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def folded(fine: Column, words: Column, percent: int) -> Column:
    """``words`` words of the parities of a set, of which it has as many or, where a partner may be in a lower band, more."""
    for _ in range((99 // percent).bit_length()):
        half = F.floor(F.size(fine) / 2).cast("int")
        halves = F.zip_with(F.slice(fine, F.lit(1), half), F.slice(fine, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        fine = F.when(F.size(fine) > words, halves).otherwise(fine)
    return fine


def possible_pairs(t: pa.Table, percent: int, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of the pairs to confirm among rows sorted by (key, i, j); with ``nearest`` of each row the best one alone.

    Rows of one (key, i, j) meet: with i = j all pairs, else those over the two blocks. A pair
    must be of two components, of sizes that allow the similarity, and of parities that differ
    in no more bits than the sets may in shingles; the fewer, the better it is. A pair is made
    in the first bucket that both of its rows name, and in no other.
    """
    col = {c: t.column(c).to_numpy() for c in ("key", "i", "j", "b", "comp", "n", "rep")}
    named = t.column("named").combine_chunks().flatten().to_numpy().reshape(len(t), NAMED)
    fine = t.column("fine").combine_chunks()
    width = fine.value_lengths().to_numpy().astype(np.int64)
    words, place = fine.flatten().to_numpy(), np.cumsum(width) - width
    new = np.ones(len(t), bool)
    new[1:] = (col["key"][1:] != col["key"][:-1]) | (col["i"][1:] != col["i"][:-1]) | (col["j"][1:] != col["j"][:-1])
    start = np.flatnonzero(new)
    end = np.repeat(np.append(start[1:], len(t)), np.diff(np.append(start, len(t))))
    later = end - np.arange(len(t)) - 1
    found_x, found_y, found_d, at = [], [], [], 0
    while at < len(t):
        # rows that make about half a million pairs at once
        stop = max(at + 1, int(np.searchsorted(np.cumsum(later[at:]), 500_000)) + at)
        x = np.repeat(np.arange(at, stop), later[at:stop])
        y = np.arange(len(x)) - np.repeat(np.cumsum(later[at:stop]) - later[at:stop], later[at:stop]) + x + 1
        at = stop
        ok = (col["comp"][x] != col["comp"][y]) & (100 * np.minimum(col["n"][x], col["n"][y]) >= percent * np.maximum(col["n"][x], col["n"][y]))
        ok &= (col["i"][x] == col["j"][x]) | (col["b"][x] != col["b"][y])
        x, y = x[ok], y[ok]
        most = (100 - percent) * (col["n"][x] + col["n"][y]) // (100 + percent)
        unlike = np.zeros(len(x), np.int64)
        for k in range(width[x].max(initial=0)):
            on = np.flatnonzero((width[x] > k) & (unlike <= most))
            unlike[on] += np.bitwise_count((words[place[x[on]] + k] ^ words[place[y[on]] + k]).view(np.uint64))
        ok = unlike <= most
        found_x.append(x[ok])
        found_y.append(y[ok])
        found_d.append((unlike - most)[ok])
    x, y, unlike = (np.concatenate(f) for f in (found_x, found_y, found_d))
    if nearest:
        a, b = np.concatenate([x, y]), np.concatenate([y, x])
        order = np.lexsort((col["rep"][b], np.concatenate([unlike, unlike]), a))
        best = order[np.append(True, a[order][1:] != a[order][:-1])[: len(a)]]
        x, y = a[best], b[best]
    made = []
    for at in range(0, len(x), 50_000):
        u, v = x[at : at + 50_000], y[at : at + 50_000]
        both = np.zeros((len(u), NAMED), bool)
        for k in range(NAMED):
            both |= named[u] == named[v][:, k, None]
        made.append(~both.any(axis=1) | (named[u, both.argmax(axis=1)] == col["key"][u]))
    made = np.concatenate([np.zeros(0, bool), *made])
    return x[made], y[made]


def met(rest: DataFrame, percent: int, nearest: bool, step: int = 0) -> DataFrame:
    """(a, b): the pairs of ``rest`` to confirm; see possible_pairs.

    A bucket of more than BLOCK rows is cut into blocks by a hash of the ids, and each two of
    its blocks meet in a group of their own, so that no task holds a large bucket. With
    ``nearest`` each block meets by itself alone, so that the work and the pairs grow with the
    rows of a bucket and not with their square; the blocks are others in each step. Blocks are
    a power of two, so that rows of one block share it in all buckets with as many or fewer:
    those that come first among the named ones.
    """
    ship(rest.sparkSession)
    kind = dict(rest.dtypes)["rep"]
    b = F.pmod(F.xxhash64("rep", F.lit(step)), F.col("blocks")).cast("int")
    rows = rest.withColumn("b", b).withColumn("other", F.col("b") if nearest else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("b", "other"), "j": F.greatest("b", "other")}).drop("other", "blocks")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
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
                x, y = possible_pairs(now, percent, nearest)
                rep = now.column("rep").combine_chunks()
                x, y = rep.take(pa.array(x)), rep.take(pa.array(y))
                yield pa.RecordBatch.from_arrays([pc.min_element_wise(x, y), pc.max_element_wise(x, y)], schema=to)

    return rows.mapInArrow(run, schema)


def mixed_rows(buckets: DataFrame, classes: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(key, rep, n, comp, fine, named, blocks): the buckets that have classes of two or more components.

    ``named`` are the first NAMED buckets of the class, those of few blocks first; where it has fewer, the last is repeated.
    """
    comp = F.coalesce("comp", "rep")
    at = stored(buckets.select("key", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", comp.alias("comp")), "labelled")
    mixed = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo < hi")
    blocks = F.expr(f"cast(shiftleft(1, cast(ceil(log2(greatest(1, m / {BLOCK}))) as int)) as int)")
    rest = at.join(mixed.select("key", blocks.alias("blocks")), "key")
    rest = rest.groupBy("rep").agg(F.first("comp").alias("comp"), F.array_sort(F.collect_list(F.struct("blocks", "key"))).alias("at"))
    named = F.transform(F.sequence(F.lit(0), F.lit(NAMED - 1)), lambda k: F.col("at")[F.least(k, F.size("at") - 1)]["key"])
    words = F.expr(f"cast(greatest(1, shiftleft({FIRST * WIDEN}L, cast(key & {BANDS - 1} as int)) div 64) as int)")  # of the bucket's band
    rest = rest.join(classes.select("rep", "n", "fine"), "rep").select("rep", "n", "comp", "fine", named.alias("named"), F.explode("at").alias("bucket"))
    rest = rest.select("bucket.key", "rep", "n", "comp", "fine", "named", "bucket.blocks")
    rest = rest.withColumn("fine", folded(F.col("fine"), words, percent))
    rest = stored(rest, "rest")
    discard(at)
    return rest


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id): a row for each input row, by a join that finds every pair.

    Documents are linked if 100 * intersection >= ``percent`` * union holds of their sets of
    distinct word shingles; component_id is the smallest id that a document reaches over
    links. Words are cut at ASCII white space, A-Z in lower case; a text with fewer words than
    ``size`` has its whole sequence as one shingle. Null texts and texts without words have an
    empty set and are linked with nothing. Rows with a null id are linked with nothing and
    have a null component; rows with equal ids are documents of their own. Ids may be of any
    type that has an order; an empty table gives no rows; other columns are ignored.

    1. Documents with equal sets are one class from here on, which has a number of its own.
    2. Each class is signed for the size bands that the larger set of a pair with it may be
       in; see ``signatures``. Every linked pair shares a signature: there is no threshold on
       chance. That the parts of a band suffice is counted over all documents; where they
       don't for some, the band's parts are doubled. Signatures are exchanged once, and
       buckets with the same classes are one from there on.
    3. Each class is compared with one leader of its buckets, the smallest id that it shares
       most of them with. Buckets whose classes are then in one component need no more; in the
       rest each class is compared with its nearest one of another component, for some rounds,
       so that a group of near copies makes as many pairs as it has classes, and then all
       pairs over two components are. Pairs that can't reach the similarity by size or by
       parities go before; nothing is capped. Large buckets are cut into blocks, which meet
       by themselves in the rounds of nearest ones, other blocks in each, and two by two in
       the last. Two classes that share buckets make their pair in one of them.
    4. Confirmation joins full sets, made anew from the texts of classes in such pairs; a
       shingle is a 64-bit hash.
    """
    rows, doubled = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), {}
    while True:
        looked = stored(signed(rows, size, percent, doubled), "signed")
        bands = looked.select(F.explode("doubled").alias("d")).groupBy("d.band").agg(F.max("d.k").alias("k")).collect()  # at most a row a band, 60 or fewer
        if not bands:
            break
        doubled = doubled | {b: k for b, k in bands}
        discard(looked)
    # a class has a number, so that a doc knows its class without a join; should two share one, others are tried
    sets, seed = looked.filter(F.col("digest").isNotNull() & F.col("id").isNotNull()), 0
    while True:
        number = F.xxhash64("digest", F.lit(seed))
        reps = stored(sets.groupBy(number.alias("rep")).agg(F.min("id").alias("id"), F.first("n").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"), F.first("fine", True).alias("fine")), "classes")
        if not reps.filter("low <> high").limit(1).count():
            break
        seed += 1
        discard(reps)

    buckets = shared_keys(sets.select(F.explode("keys").alias("key"), number.alias("rep")))
    buckets = stored(buckets.groupBy("key", "rep").agg(F.min("leader").alias("leader"), F.count(F.lit(1)).alias("votes")), "buckets")
    slim = stored(looked.select("id", "n", F.when(F.col("digest").isNotNull(), number).alias("rep")), "looked")
    discard(looked)
    sweep(df.sparkSession)

    def full_sets(of: DataFrame) -> DataFrame:
        """(rep, n, shingles) of the classes in (rep); of rows with one id and other texts only the class's own text counts."""
        members = stored(of.distinct().join(reps.select("rep", F.col("id").alias("_of")), "rep"), "members")
        place = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACES))
        few = rows.join(F.broadcast(members.select(place("_of").alias("_place")).distinct()), place("id") == F.col("_place"), "left_semi")  # other texts aren't exchanged
        full = set_rows(few.join(members, F.col("id") == F.col("_of")).select("rep", "text"), size).filter(number == F.col("rep"))
        full = stored(full.drop("digest"), "sets")
        discard(members)
        return full

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    votes = buckets.filter("rep <> leader").groupBy(F.col("rep").alias("a"), F.col("leader").alias("b")).agg(F.sum("votes").alias("count"))
    first = votes.groupBy("a").agg(F.min_by("b", F.struct(-F.col("count"), "b")).alias("b"))
    for x in ("a", "b"):
        first = first.join(reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"f_{x}")), x)
    fewer = F.least(F.size("f_a"), F.size("f_b"))
    unlike = F.aggregate(F.zip_with(folded(F.col("f_a"), fewer, percent), folded(F.col("f_b"), fewer, percent), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    first = first.filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").filter(unlike <= F.expr(f"{100 - percent} * (n_a + n_b) div {100 + percent}"))
    first = stored(first.select("a", "b"), "first")
    full = full_sets(ends(first))
    links = stored(confirmed(first, full, percent), "links")
    discard(first, full)
    sweep(df.sparkSession)
    comps = components(links, "comps")

    # what is left: buckets with classes of two or more components
    full, step, nearest, more = [], 0, True, True
    while more:
        rest = mixed_rows(buckets, reps, comps, percent)
        step += 1
        while True:
            pairs = stored(met(rest, percent, nearest, step).distinct(), "pairs")
            inside = ends(pairs).distinct()
            for made in full:
                inside = inside.join(made.select("rep"), "rep", "left_anti")
            inside = stored(inside, "inside")
            if step == 1 and nearest:  # all that have a candidate at all, and buckets of which not all have met
                large = stored(rest.filter("blocks > 1").select("key").distinct(), "large")
                slimmer = buckets.join(large.withColumn("large", F.lit(True)), "key", "left").join(inside.withColumn("inside", F.lit(True)), "rep", "left")
                slimmer, unmet = stored(slimmer.filter("large or inside").select(*buckets.columns), "candidates"), large.limit(1).count() > 0
                discard(buckets, large)
                buckets = slimmer
            if not full or inside.limit(1).count():
                full.append(full_sets(inside))
            discard(inside)
            found = stored(confirmed(pairs, reduce(DataFrame.unionByName, full), percent), "more")
            links_found, pairs_made = found.count(), pairs.count()
            if links_found or not nearest or not (pairs_made or unmet):
                break
            discard(pairs, found)
            nearest = False  # the nearest ones are no links: all that are left are compared
        discard(pairs, rest)
        if links_found:
            known, comps = comps, merged(comps, found, "all")
            discard(known)
        discard(found)
        more = links_found > 0 and nearest
        nearest = step + 1 < ROUNDS and WORTH * links_found >= pairs_made
        sweep(df.sparkSession)
    discard(buckets, *full)

    # of a component the smallest id of its classes
    named = reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "id", F.coalesce("comp", "rep").alias("comp"))
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    ends = stored(named.join(least, "comp").select(F.col("rep").alias("of"), "component_id"), "ends")
    discard(reps, comps, links)
    out = slim.join(ends, F.col("rep") == F.col("of"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))

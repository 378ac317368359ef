"""Line dedup by winnowing: fingerprints of runs of words are joined, matches extended, and later copies deleted, wherever in a line they begin and end."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .arrow import map_batches
from .common import discard, free_name, stored

#: A run of words is deleted if it has so many words and stands earlier, too.
LEAST_WORDS = 50
#: A fingerprint is a run of so many words.
GRAM = 20
#: The words of an earlier run are fetched by so many.
SEGMENT = 128
#: So often every second match is left out that the ones beside it cover.
THINNINGS = 3
_UNIT = re.compile(r"\s*\S+\s*")
#: Characters that are handled at once, so that their arrays stay in a processor's cache.
GROUP_CHARS = 40_000
STOPS = [ord(c) for c in ".!?"]
SPACES = np.array([chr(c).isspace() for c in range(0x3002)])
#: The base of the hash of a run; odd, so that it can be divided by.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def lines(text: str) -> list[str]:
    """The units that runs are made of, single words with the white space around them; joined they are the text again."""
    return _UNIT.findall(text) or ([text] if text else [])


class RunHashes:
    """Hashes of runs of lines from prefix sums modulo 2^64."""

    def __init__(self) -> None:
        self.grow(1024)

    def grow(self, n: int) -> None:
        one = np.ones(1, np.uint64)
        self.power = np.concatenate([one, np.cumprod(np.full(n, BASE, np.uint64))])
        self.inverse = np.concatenate([one, np.cumprod(np.full(n, BASE_INVERSE, np.uint64))])

    def __call__(self, hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(hashes) >= len(self.power):
            self.grow(2 * len(hashes))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.power[: len(hashes)], dtype=np.uint64)])
        out = (total[end] - total[first]) * self.inverse[first] + (end - first).astype(np.uint64)
        return (out ^ (out >> np.uint64(31))) * np.uint64(BASE)


def code_points(texts: list[str]) -> np.ndarray:
    """The characters of the texts, with a space between each two."""
    return np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def word_edges(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    solid = np.zeros(len(codes) + 2, bool)
    solid[1:-1] = ~SPACES[np.minimum(codes, len(SPACES) - 1)]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


class Words:
    """The words of a text, found by their edges; only those that are asked for become strings."""

    def __init__(self, text: str) -> None:
        self.text, self.codes = text, code_points([text])
        self.start, self.end = word_edges(self.codes)

    def __getitem__(self, span: slice) -> list[str]:
        first, end, _ = span.indices(len(self.start))
        return self.text[self.start[first] : self.end[end - 1]].split() if first < end else []


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Whether each row is the first with its keys."""
    order = np.lexsort(keys)
    later = np.ones(max(len(order) - 1, 0), bool)
    for key in keys:
        later &= key[order[1:]] == key[order[:-1]]
    out = np.ones(len(order), bool)
    out[order[1:][later]] = False
    return out


def hashed(texts: list[str], run_hash: RunHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the hash of each word of the texts one after another, and where each text's words begin, and the end.

    White space between words doesn't count.
    """
    codes = code_points(texts)
    first, end = word_edges(codes)
    letters = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return run_hash(letters ^ (letters >> np.uint64(29)), first, end), np.searchsorted(first, starts)


def selected(order: np.ndarray, size: int) -> np.ndarray:
    """For each window of ``size`` numbers the place of its smallest, the last of equal ones: equal windows choose equal places."""
    best, span = np.arange(len(order)), 1
    while 2 * span <= size:
        a, b = best[:-span], best[span:]
        best = np.where(order[b] <= order[a], b, a)
        span *= 2
    rest = size - span
    if rest:
        a, b = best[:-rest], best[rest:]
        best = np.where(order[b] <= order[a], b, a)
    return best


def chosen(hashes: np.ndarray, bounds: np.ndarray, least: int, run_hash: RunHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, first, picks): hashes of all runs of GRAM words, where each window of ``least`` words of one text begins, and which run it selects."""
    size = min(GRAM, least)
    first = np.flatnonzero(np.arange(len(hashes)) + least <= np.repeat(bounds[1:], np.diff(bounds)))
    if not len(first):
        return hashes[:0], first, first
    at = np.arange(len(hashes) - size + 1)
    grams = run_hash(hashes, at, at + size)
    # selected by the hash's high bits; runs over two texts are in no window of one
    return grams, first, selected(grams >> np.uint64(4), least - size + 1)[first]


def groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of about GROUP_CHARS characters together, with the place of the first."""
    at = size = 0
    for n, text in enumerate(texts):
        size += len(text)
        if size >= GROUP_CHARS or n + 1 == len(texts):
            yield at, texts[at : n + 1]
            at, size = n + 1, 0


def listed(parts: list[np.ndarray], sizes: list[int]) -> pa.ListArray:
    """Lists of numbers, one after another, of the given lengths."""
    ends = np.cumsum([0, *sizes]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))


def blocks_of(rows: DataFrame, least: int, hasher: Callable[[], RunHashes]) -> DataFrame:
    """(gram, run, id, first, windows, own): the fingerprints of (id, text), with the words around.

    Neighbouring windows that select one place are a block, the first of which begins at
    ``first``; ``gram`` is the hash of the fingerprint, ``run`` that of all words of the block,
    ``own`` says that no earlier block of the text has both.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        run_hash = hasher()

        def apply(batch):
            found = {k: [np.zeros(0, np.int64)] for k in ("gram", "run", "first", "windows", "row")} | {"own": [np.zeros(0, bool)]}
            for start, texts in groups(batch.column("text").to_pylist()):
                hashes, bounds = hashed(texts, run_hash)
                grams, first, picks = chosen(hashes, bounds, least, run_hash)
                if not len(first):
                    continue
                begin = np.flatnonzero(np.concatenate([np.ones(1, bool), picks[1:] != picks[:-1]]))
                end = np.append(begin[1:], len(picks))
                row = np.searchsorted(bounds, first[begin], side="right") - 1
                found["gram"].append(grams[picks[begin]].view(np.int64))
                found["run"].append(run_hash(hashes, first[begin], first[end - 1] + least).view(np.int64))
                found["first"].append(first[begin] - bounds[row])
                found["windows"].append(end - begin)
                found["row"].append(row + start)
                found["own"].append(firsts(found["run"][-1], found["gram"][-1], row))
            own = {k: np.concatenate(v) for k, v in found.items()}
            ints = {k: own[k].astype(np.int32) for k in ("first", "windows")}
            return own | ints | {"id": batch.column("id").take(pa.array(own["row"]))}

        return apply

    return map_batches(rows, f"gram bigint, run bigint, id {kind}, first int, windows int, own boolean", make)


def in_company(rows: DataFrame, key: str) -> DataFrame:
    """The rows that are not alone with their ``key``, a number: they meet sorted by it, and a task holds a batch and the row before."""
    ship(rows.sparkSession)

    def run(batches):
        last, kept = None, False
        for batch in chain(batches, [None]):
            if batch is None or not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            same = keys[1:] == keys[:-1]
            before = np.append(last is not None and keys[0] == last.column(key)[0].as_py(), same)
            if last is not None and (kept or before[0]):
                yield last
            some = (before[:-1] | same).nonzero()[0]
            if len(some):
                yield batch.take(pa.array(some))
            last, kept = batch.take(pa.array([len(keys) - 1])), bool(before[-1])
        if kept:
            yield last

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, rows.schema)


def led(rows: DataFrame, least: int, hasher: Callable[[], RunHashes]) -> DataFrame:
    """(id, at, runs, own, segments, words) of (id, text, blocks), where blocks have (first, windows, several).

    ``runs`` has the hash of each window of the blocks that are ``several``, which begins at
    ``at``, ``own`` whether no earlier one of them is alike; ``words`` the words of the segments of SEGMENT words that the blocks touch.
    """
    kind = dict(rows.dtypes)["id"]

    def make():
        run_hash = hasher()

        def apply(batch):
            at, runs, own, segments, words = [], [], [], [], []
            for text, blocks in zip(batch.column("text").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                of = Words(text)
                touched = sorted({n for b in blocks for n in range(b["first"] // SEGMENT, (b["first"] + b["windows"] + least - 2) // SEGMENT + 1)})
                segments.append(np.array(touched, np.int32))
                words.append([" ".join(of[n * SEGMENT : (n + 1) * SEGMENT]) for n in touched])
                spans = [np.arange(b["first"], b["first"] + b["windows"]) for b in blocks if b["several"]]
                at.append(np.sort(np.concatenate([np.zeros(0, np.int64), *spans])))
                runs.append(np.zeros(0, np.int64))
                if spans:
                    runs[-1] = run_hash(hashed([text], run_hash)[0], at[-1], at[-1] + least).view(np.int64)
                own.append(firsts(runs[-1]))
            lists = {k: listed([np.zeros(0, v[0].dtype), *v], [len(x) for x in v]) for k, v in (("at", at), ("runs", runs), ("own", own), ("segments", segments))}
            return lists | {"at": lists["at"].cast(pa.list_(pa.int32())), "id": batch.column("id"), "words": words}

        return apply

    return map_batches(rows, f"id {kind}, at array<int>, runs array<bigint>, own array<boolean>, segments array<int>, words array<string>", make)


def document_key(id_col: str, text_col: str) -> Column:
    """What tells documents apart and puts them in order: the id, and for equal ids a hash of the text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))


def one_text_each(df: DataFrame, id_col: str, text_col: str) -> bool:
    """Whether no id has two texts: a partial aggregate over ids and hashes alone."""
    each = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")).filter("id is not null").groupBy("id")
    return not each.agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").limit(1).count()


def earliest_place() -> list[Column]:
    """(lead, repeated): the earliest place (id, first) of a group's rows, and whether one of them has another.

    ``own`` marks the first row of an id, so that numbers alone are kept: with ids that are
    numbers the engine hashes the rows and sorts none, as it would for the least struct.
    """
    lead = F.struct(F.min("id").alias("id"), F.min_by("first", F.expr("if(own, id, null)")).alias("first"))
    return [lead.alias("lead"), ((F.min("id") != F.max("id")) | ~F.min("own")).alias("repeated")]


def repeated_runs(df: DataFrame, key: Column, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, hasher: Callable[[], RunHashes] = RunHashes) -> DataFrame:
    """(id, pieces): for the documents that repeat earlier runs, the matches with the words of the earlier ones.

    ``id`` is ``key``, which tells documents apart and puts them in order. A piece has the
    words [first, end) of a match, the place ``lead`` where its earlier run begins, a number
    ``of`` that tells the matches of a document apart, and a segment of the earlier document
    with its words.

    1. Each text's words are hashed; of the runs of GRAM words in every window of ``least``
       words, the minimum is a fingerprint, so that any run of so many words has one wherever
       it stands in its lines.
    2. Positions are joined: each with the earliest of its fingerprint that has the same words
       around, so that a passage with many copies makes as many rows, not all pairs. Where one
       fingerprint stands among different words, each window around is joined with the
       earliest one like it.
    3. Matches are extended both ways: joined positions on one diagonal (the same distance
       from one earlier document) that touch are one match, as far as there are any. Of the
       matches of a document that overlap only what ``needed`` leaves goes on.
    4. The words of the earlier run are fetched for each match by segments of SEGMENT words.

    All up to here only proposes; ``confirmed`` compares the words.
    """
    rows = df.filter(F.col(id_col).isNotNull()).select(key.alias("id"), F.col(text_col).alias("text")).filter("text <> ''")
    place, here = F.struct("id", "first"), ["gram", "run"]
    # a fingerprint that stands once repeats nothing
    table = stored(in_company(blocks_of(rows, least, hasher), "gram"), "blocks")
    leads = stored(table.groupBy(*here).agg(*earliest_place(), F.min("windows").alias("windows")), "leads")
    several = stored(leads.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", F.lit(True).alias("several")), "several")
    leading = leads.join(several, "gram", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    leading = stored(leading.filter("several or repeated"), "leading")
    discard(leads, several)
    whole = table.join(leading.filter("repeated").select(*here, "lead"), here).filter(place != F.col("lead"))
    whole = stored(whole.select("id", "first", (F.col("first") + F.col("windows") + F.lit(least - 1)).alias("end"), "lead"), "whole")
    asked = leading.groupBy(F.col("lead.id").alias("id")).agg(F.collect_list(F.struct("lead.first", "windows", "several")).alias("blocks"))
    asked = stored(asked, "asked")
    earlier = stored(led(rows.join(asked, "id"), least, hasher), "earlier")
    if earlier.groupBy("id").count().filter("count > 1").limit(1).count():  # rows that are one document
        earlier = stored(earlier.dropDuplicates(["id"]), "earlier")
    discard(table, leading, asked)
    runs = earlier.select("id", F.explode(F.arrays_zip("at", "runs", "own")).alias("w"))
    runs = stored(runs.select("id", F.col("w.at").alias("first"), F.col("w.runs").alias("run"), F.col("w.own").alias("own")), "windows")
    earliest = stored(runs.groupBy("run").agg(*earliest_place()).filter("repeated").select("run", "lead"), "earliest")
    later = runs.join(earliest, "run").filter(place != F.col("lead")).select("id", "first", (F.col("first") + F.lit(least)).alias("end"), "lead")
    matches = stored(needed(extended(whole.unionByName(later)), least), "matches")
    discard(whole, runs, earliest)
    segments = earlier.select(F.col("id").alias("lead_id"), F.explode(F.arrays_zip("segments", "words")).alias("s")).select("lead_id", F.col("s.segments").alias("segment"), "s.words")
    parts = F.sequence(F.expr(f"lead div {SEGMENT}"), F.expr(f"(lead + end - first - 1) div {SEGMENT}"))
    pieces = matches.withColumn("segment", F.explode(parts.cast("array<int>"))).join(segments, ["lead_id", "segment"])
    return pieces.groupBy("id").agg(F.collect_list(F.struct("first", "end", "lead", F.xxhash64("lead_id").alias("of"), "segment", "words")).alias("pieces"))


def extended(joined: DataFrame) -> DataFrame:
    """(id, first, end, lead_id, lead): joined stretches (id, first, end, lead) on one diagonal that touch or overlap are one match."""
    on = Window.partitionBy("id", "lead_id", "diagonal")
    rows = joined.select("id", "first", "end", F.col("lead.id").alias("lead_id"), (F.col("first") - F.col("lead.first")).alias("diagonal"))
    rows = rows.repartition("id")  # one exchange serves all windows, those of needed, too
    before = F.max("end").over(on.orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("begins", F.coalesce(F.col("first") > before, F.lit(True)).cast("int"))
    rows = rows.withColumn("match", F.sum("begins").over(on.orderBy("first").rowsBetween(Window.unboundedPreceding, 0)))
    each = rows.groupBy("id", "lead_id", "diagonal", "match").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return each.select("id", "first", "end", "lead_id", (F.col("first") - F.col("diagonal")).alias("lead"))


def needed(matches: DataFrame, least: int) -> DataFrame:
    """Matches that have the words of all of them: none within another one of its document, few that others cover.

    A match between two that touch goes, every second one at a time, THINNINGS times; each
    that stays begins where the one before it ends, but has ``least`` words or more. So a
    text whose windows stand in many earlier documents is fetched and compared about once,
    not once for each of them.
    """
    order = Window.partitionBy("id").orderBy("first", F.desc("end"), "lead_id", "lead")
    rows = matches.withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).filter("before is null or end > before")
    for _ in range(THINNINGS):  # first and end both rise from here on
        rows = rows.withColumns({"before": F.lag("end").over(order), "after": F.lead("first").over(order), "at": F.row_number().over(order)})
        rows = rows.filter("at % 2 = 1 or before is null or after is null or before < after")
    before = F.coalesce(F.lag("end").over(order), F.lit(0))
    skip = F.greatest(F.lit(0), F.least(before, F.col("end") - F.lit(least)) - F.col("first"))
    rows = rows.withColumn("skip", skip)
    return rows.select("id", (F.col("first") + F.col("skip")).alias("first"), "end", "lead_id", (F.col("lead") + F.col("skip")).alias("lead"))


def confirmed(words: list[str] | Words, pieces: Iterable[tuple], least: int) -> list[tuple[int, int]]:
    """The cuts [first, end) of a document: stretches of ``least`` words or more of its matches whose words are the earlier ones.

    A piece is (first, end, lead, of, segment, words).
    """
    matches: dict[tuple, list] = {}
    for *match, segment, each in pieces:
        matches.setdefault(tuple(match), []).append((segment, each))
    cuts = []
    for (first, end, lead, _), parts in matches.items():
        parts.sort()
        skip = lead % SEGMENT
        over = (len(parts) - 1) * SEGMENT + parts[-1][1].count(" ") + 1 - skip - (end - first)  # all segments but the last are full
        there = " ".join([each for _, each in parts])
        there = there.split(" ", skip)[-1] if skip else there
        there = there.rsplit(" ", over)[0] if over > 0 else there
        here = words[first:end]
        if " ".join(here) == there:
            cuts.append((first, end))
            continue
        other = there.split(" ")
        unlike = [-1, *(n for n in range(len(here)) if n >= len(other) or here[n] != other[n]), len(here)]
        cuts += [(first + a + 1, first + b) for a, b in zip(unlike, unlike[1:], strict=False) if b - a - 1 >= least]
    return cuts


def without(text: str, cuts: list[tuple[int, int]], words: Words | None = None) -> tuple[str, int, int]:
    """The text without the cut words, the number of lines that lost some, and their number.

    A word goes with the white space after it, the first one with that before it, too; a
    line ends at a line break or at a full stop, exclamation or question mark before a space.
    """
    words = words or Words(text)
    codes, start = words.codes, words.start
    change = np.zeros(len(start) + 1, np.int64)
    np.add.at(change, [c[0] for c in cuts], 1)
    np.add.at(change, [c[1] for c in cuts], -1)
    gone = np.cumsum(change)[:-1] > 0
    bounds = np.concatenate([[0], start[1:], [len(codes)]])
    ends = codes == 10
    ends[:-1] |= np.logical_or.reduce([codes[:-1] == c for c in STOPS]) & (codes[1:] == 32)
    ends = np.add.reduceat(ends, bounds[:-1]) > 0
    line = np.cumsum(ends) - ends
    kept, line = codes[np.repeat(~gone, np.diff(bounds))], line[gone]
    return kept.tobytes().decode("utf-32-le", "surrogatepass"), int(np.count_nonzero(np.diff(line))) + bool(len(line)), len(line)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, hasher: Callable[[], RunHashes] = RunHashes) -> DataFrame:
    """All rows and columns of ``df``, the text without repeated runs, plus removed_lines and removed_words.

    A run of ``least`` words or more that stands earlier in the table (smaller id, or the
    same text above) is deleted, whichever white space is between its words and wherever in
    their lines it begins and ends; shorter repetitions stay. removed_lines counts the lines
    (up to a line break or a sentence end) that lost words, whole or in part. A text may
    become empty. Null texts stay null, rows with a null id stay as they are and count for
    nothing. Rows with equal ids and texts are one document and are cut alike; with equal ids
    and other texts they are documents of their own, of which a hash of the text decides the
    order. Ids may be of any type that has an order. An empty table gives no rows. Existing
    columns removed_lines and removed_words are replaced.

    Hashes (``hasher`` makes what computes them) only propose matches: a word goes if it and
    the words around are the earlier ones, compared one by one. Two unlike runs with one
    hash can hide a repetition, but no word goes for it. Bounded memory: tasks hold single
    texts and the matches of one document; equal blocks and windows are counted by a partial
    aggregate and joined with a written table, which a hot one's rows are split over.
    """
    df = df.drop("removed_lines", "removed_words")
    key, cut = free_name(df, "_cut_id"), free_name(df, "_pieces")
    own = F.col(id_col) if one_text_each(df, id_col, text_col) else document_key(id_col, text_col)
    found = repeated_runs(df, own, id_col, text_col, least, hasher).select(F.col("id").alias(key), F.col("pieces").alias(cut))
    rows = df.join(found, own == F.col(key), "left").drop(key)
    kinds = T.StructType([*df.schema.fields, T.StructField("removed_lines", T.LongType()), T.StructField("removed_words", T.LongType())])

    def make():
        def apply(batch):
            own = {name: batch.column(name) for name in batch.schema.names if name != cut}
            gone = batch.column(cut)
            at = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))  # only documents with matches
            lines_, words = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            if len(at):
                texts, lists = own[text_col].take(pa.array(at)).to_pylist(), gone.take(pa.array(at))
                ends = np.cumsum(lists.value_lengths().to_numpy())
                pieces = list(zip(*(x.to_pylist() for x in lists.flatten().flatten()), strict=True))
                each = [Words(text) for text in texts]
                done = [without(w.text, confirmed(w, pieces[a:b], least), w) for w, a, b in zip(each, [0, *ends], ends, strict=False)]
                mask = np.zeros(batch.num_rows, bool)
                mask[at] = True
                own[text_col] = pc.replace_with_mask(own[text_col], pa.array(mask), pa.array([d[0] for d in done], own[text_col].type))
                lines_[at], words[at] = [d[1] for d in done], [d[2] for d in done]
            return own | {"removed_lines": lines_, "removed_words": words}

        return apply

    return map_batches(rows, kinds, make)

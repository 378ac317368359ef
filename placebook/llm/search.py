"""Ranked lexical search over inverted treaps: a treap per term, in the order of documents, with the highest impact on top."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from .arrow import map_batches
from .common import discard, stored

#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z in lower case.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Documents of a slice of the index and items of a block, on average; documents that a walk scores at once.
SLICE_DOCS, BLOCK_ITEMS, LEAF, STEP = 8_192, 2_000, 256, 64
#: Bits of the filter that says which terms are asked for at all; a fixed size, of any number of terms.
FILTER_BITS = 1 << 20
#: Terms that a worker knows by heart; it starts anew beyond that.
CACHE = 300_000


def terms_of(text: str | None) -> list[bytes]:
    # bytes.split() cuts at ASCII white space, all of which LOWER makes a space
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def counted_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, repeats) of (item, item_id, text)."""
    kind = dict(items.dtypes)["item_id"]

    def make():
        def apply(batch):
            found = [Counter(terms_of(t)) for t in batch.column("text").to_pylist()]
            size = [len(c) for c in found]
            at = np.repeat(np.arange(len(size)), size)
            return {
                "item": batch.column("item").take(at), "item_id": batch.column("item_id").take(at),
                "term": [t.decode("utf-8", "replace") for c in found for t in c], "repeats": [n for c in found for n in c.values()],
            }

        return apply

    return map_batches(items, f"item bigint, item_id {kind}, term string, repeats bigint", make)


def term_filter(asked: DataFrame) -> bytes:
    """FILTER_BITS bits with those of all terms set: at most 32 rows of 4 KB come to the driver."""
    place = (F.crc32(F.col("term").cast("binary")) % FILTER_BITS) + 1
    parts = asked.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    whole = bytearray(FILTER_BITS // 8)
    for part, bits in parts:
        whole[(part - 1) * 4096 : part * 4096] = bits
    return bytes(whole)


def forward(docs: DataFrame, asked: bytes) -> DataFrame:
    """(doc, doc_id, n, terms, tfs) of (doc, doc_id, text): the number of all terms, and those that the filter lets through."""
    kind = dict(docs.dtypes)["doc_id"]

    class Known(dict):
        def __missing__(self, term: bytes) -> str | None:
            at = zlib.crc32(term) % FILTER_BITS
            self[term] = name = term.decode("utf-8", "replace") if asked[at >> 3] >> (at & 7) & 1 else None
            return name

    def make():
        known = Known()

        def apply(batch):
            n, names, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                found = terms_of(text)
                if len(known) > CACHE:
                    known.clear()
                hits = [(name, k) for t, k in Counter(found).items() if (name := known[t]) is not None]
                n.append(len(found))
                names.append([x for x, _ in hits])
                tfs.append([k for _, k in hits])
            return {"doc": batch.column("doc"), "doc_id": batch.column("doc_id"), "n": n, "terms": names, "tfs": tfs}

        return apply

    return map_batches(docs, f"doc bigint, doc_id {kind}, n bigint, terms array<string>, tfs array<bigint>", make)


class Treaps:
    """The treaps of all terms of one slice, in search order: what is below a node is a run of postings.

    ``docs`` and ``impact`` hold the postings of a term one after the other, by document;
    ``left`` and ``right`` are the places of the children, -1 for none. An impact stands above
    all that are lower; equal ones are dealt by a hash of the document, which keeps runs of
    them from making a chain.
    """

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        order = np.lexsort((docs, terms))
        self.docs = np.append(docs[order], -1)
        self.impact = np.append(impact[order], 0)
        self.start = np.searchsorted(terms[order], np.arange(n_terms + 1))
        mixed = (docs[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        rank = ((impact[order].astype(np.uint64) << np.uint64(20)) | mixed).tolist()
        left, right, self.root = [-1] * (len(rank) + 1), [-1] * (len(rank) + 1), np.full(n_terms, -1)
        for t in range(n_terms):
            stack: list[int] = []
            for i in range(self.start[t], self.start[t + 1]):
                last = -1
                while stack and rank[stack[-1]] < rank[i]:
                    last = stack.pop()
                left[i] = last
                if stack:
                    right[stack[-1]] = i
                stack.append(i)
            if stack:
                self.root[t] = stack[0]
        self.left, self.right = np.array(left), np.array(right)

    def top(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each node the highest at or below it whose document is within lo..hi, -1 for none."""
        node = node.copy()
        at = np.flatnonzero(node >= 0)
        while len(at):
            now = node[at]
            over, under = self.docs[now] > hi[at], self.docs[now] < lo[at]
            at, over, now = at[over | under], over[over | under], now[over | under]
            node[at] = np.where(over, self.left[now], self.right[now])
            at = at[node[at] >= 0]
        return node

    def best(self, terms: np.ndarray, weights: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents of the slice with their scores, and how many documents were scored.

        A state is a range of documents with the top of each term within it; the sum of the
        weighted tops is more than any document of the range can reach. The most promising
        states are cut at the document of their heaviest top, until a range has LEAF documents
        or fewer, which are scored from their runs of postings. States that can't enter the k
        best are left out; of equal scores the earlier document is the better one.
        """
        lo, hi = np.zeros(1, np.int64), np.full(1, n_docs - 1)
        nodes = self.root[terms][None, :]
        found_doc, found_score, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        least, last = 0, -1  # the k-th best so far
        while len(lo):
            bound = (self.impact[nodes] * weights).sum(axis=1)
            some = (bound > least) | ((bound == least) & (lo < last))
            lo, hi, nodes, bound = lo[some], hi[some], nodes[some], bound[some]
            if not len(lo):
                break
            now = np.argsort(-bound, kind="stable")[:STEP]
            rest = np.ones(len(lo), bool)
            rest[now] = False
            small = hi[now] - lo[now] < LEAF
            leaf, cut = now[small], now[~small]
            for s in leaf:
                score = np.zeros(hi[s] - lo[s] + 1, np.int64)
                for t, w in zip(terms, weights, strict=True):
                    a, b = self.start[t], self.start[t + 1]
                    a, b = a + np.searchsorted(self.docs[a:b], (lo[s], hi[s] + 1))
                    score[self.docs[a:b] - lo[s]] += w * self.impact[a:b]
                scored += len(score)
                found_doc = np.append(found_doc, lo[s] + np.flatnonzero(score))
                found_score = np.append(found_score, score[score > 0])
            if len(leaf):
                order = np.lexsort((found_doc, -found_score))[:k]
                found_doc, found_score = found_doc[order], found_score[order]
                if len(order) == k:
                    least, last = int(found_score[-1]), int(found_doc[-1])
            if len(cut):
                heavy = (self.impact[nodes[cut]] * weights).argmax(axis=1)
                at = self.docs[nodes[cut, heavy]]
                # the document of the heaviest top goes with the left range, so that each range is a whole one
                new_lo, new_hi = np.concatenate([lo[cut], at + 1]), np.concatenate([at, hi[cut]])
                some = new_lo <= new_hi
                stuck = (at == hi[cut])[: len(cut)]
                if stuck.any():  # a cut at the last document would leave the range as it is
                    new_lo[: len(cut)][stuck], new_hi[: len(cut)][stuck] = lo[cut][stuck], at[stuck] - 1
                    new_lo[len(cut) :][stuck], new_hi[len(cut) :][stuck] = at[stuck], at[stuck]
                    some = new_lo <= new_hi
                below = np.concatenate([nodes[cut], nodes[cut]])[some]
                new_lo, new_hi = new_lo[some], new_hi[some]
                wide = len(terms)
                new = self.top(below.ravel(), np.repeat(new_lo, wide), np.repeat(new_hi, wide)).reshape(below.shape)
                lo, hi, nodes = np.concatenate([lo[rest], new_lo]), np.concatenate([hi[rest], new_hi]), np.concatenate([nodes[rest], new])
            else:
                lo, hi, nodes = lo[rest], hi[rest], nodes[rest]
        return found_doc, found_score, scored


def walked(slice_: pa.Table, items: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """The k best documents of one slice for each item of one block."""
    if not len(slice_) or not len(items):
        return schema.empty_table()
    slice_ = slice_.sort_by([("doc_id", "ascending"), ("doc", "ascending")])
    each = pc.list_value_length(slice_.column("terms")).to_numpy()
    doc = np.repeat(np.arange(len(slice_)), each)
    names = pc.list_flatten(slice_.column("terms")).combine_chunks().dictionary_encode()
    tf = pc.list_flatten(slice_.column("tfs")).to_numpy().astype(np.int64)
    m = slice_.column("m").to_numpy()[doc]
    treaps = Treaps(names.indices.to_numpy(), doc, (1_000_000_000 * tf) // (1_000 * tf + 12 * m), len(names.dictionary))
    place = {name: i for i, name in enumerate(names.dictionary.to_pylist())}
    out_item, out_doc, out_score = [], [], []
    for i, (words, weights) in enumerate(zip(items.column("terms").to_pylist(), items.column("weights").to_pylist(), strict=True)):
        known = [(place[t], w) for t, w in zip(words, weights, strict=True) if t in place]
        if known:
            docs, scores, _ = treaps.best(np.array([t for t, _ in known]), np.array([w for _, w in known], np.int64), len(slice_), k)
            out_item.append(np.full(len(docs), i))
            out_doc.append(docs)
            out_score.append(scores)
    if not out_item:
        return schema.empty_table()
    at, docs = pa.array(np.concatenate(out_item)), pa.array(np.concatenate(out_doc))
    found = [items.column("item").take(at), items.column("item_id").take(at), slice_.column("doc_id").take(docs), slice_.column("doc").take(docs), pa.chunked_array([np.concatenate(out_score)])]
    return pa.table([c.cast(f.type) for c, f in zip(found, schema, strict=True)], schema=schema)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents with the highest scores above 0, in whole numbers.

    N documents have a term, L terms in all; a document has n terms, and tf times the term,
    which df documents hold. w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 75 + 25 n N div L;
    a document scores w (10^9 tf div (1000 tf + 12 m)) for each of the item's terms, repeats
    included. Equal scores are ranked by ascending id, null ids last. Null texts have no
    terms. Rows with equal ids are documents, and items, of their own; items that nothing
    matches have no row, and an empty table of documents or items gives none. Other columns
    are ignored.

    1. A filter of fixed size tells which terms any item asks for; of each document these
       terms are kept with their counts. N, L and df come from all documents.
    2. Documents are dealt into slices by a hash of their row, items into blocks. For each
       slice and block a task builds the treaps of the slice's terms and walks those of an
       item together; see Treaps.best. A third of all rows with one id or text is spread
       over all slices.
    3. The best of all slices are ranked; Spark cuts each partition to k rows before they
       are exchanged.
    """
    spark = docs.sparkSession
    ship(spark)
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    asked = stored(counted_terms(numbered), "asked")
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    index = stored(forward(rows, term_filter(asked)), "forward")
    total, length, n_items = (x or 0 for x in (*index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first(), asked.agg(F.approx_count_distinct("item")).first()[0]))
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", items.schema[item_col].dataType), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("doc", T.LongType()), T.StructField("score", T.LongType())])
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * total + 2)) / (2 * F.col("df") + 1)))
    # terms that only the filter took for asked ones go here
    weighed = stored(asked.join(df, "term").withColumn("weight", (weight * F.col("repeats")).cast("long")).filter("weight > 0"), "weighed")
    pairs = F.collect_list(F.struct("term", "weight"))
    queries = weighed.groupBy("item").agg(F.first("item_id").alias("item_id"), pairs.alias("p")).select("item", "item_id", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights"))
    slices, blocks = max(1, -(-total // SLICE_DOCS)), max(1, -(-n_items // BLOCK_ITEMS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = index.filter(F.size("terms") > 0).withColumn("m", F.expr(f"75 + (25 * n * {total}L) div {max(1, length)}L")).drop("n")
    held = held.withColumn("slice", F.pmod(F.xxhash64("doc"), F.lit(slices)).cast("int")).withColumn("block", every(blocks))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).withColumn("slice", every(slices))
    to = to_arrow_schema(schema)
    found = held.groupBy("slice", "block").cogroup(queries.groupBy("slice", "block")).applyInArrow(lambda left, right: walked(left, right, k, to), schema)
    best = stored(found, "best")
    discard(index, asked, weighed)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "doc"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

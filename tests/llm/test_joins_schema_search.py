"""Operators 11 to 13 against brute force, on small and odd tables."""

import json
import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from placebook.llm import jaccard, minhash, search, shredding
from placebook.llm.minhash import Shingler

CLASHING = "doc_id long, text string, item bigint, rank int, term string, score string, path string, key string, `Comp` string, `SLICE` int"


def words(rng, n, of=4000):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def shingles(text, size):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def linked(rows, size, percent):
    """Brute force: the smallest id that each row reaches."""
    sets = [shingles(t, size) for _, t in rows]
    comp = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = comp[x], comp[y]
                comp = [a if c == b else c for c in comp]
    low = {}
    for (i, _), c in zip(rows, comp, strict=True):
        low[c] = min(low.get(c, i), i)
    return {i: (len(s), low[c]) for (i, _), s, c in zip(rows, sets, comp, strict=True)}


# PartEnum


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**32), st.sampled_from([70, 80, 85, 95]), st.floats(0, 1))
def test_sets_within_the_threshold_share_a_signature(n, seed, percent, share):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    # as many changes as the threshold allows at most: some shingles go, others come
    for gone in range(int(share * n) + 1, -1, -max(1, n // 7)):
        kept = a[gone:]
        added = max((100 * len(kept) - percent * len(a)) // percent, 0)
        b = np.unique(np.concatenate([kept, rng.integers(0, 2**63, added).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            doubled = {}
            for s in (a, b):
                for band, k in jaccard.doublings(s, percent).items():
                    doubled[band] = max(k, doubled.get(band, 0))
            assert len(np.intersect1d(jaccard.signatures(a, percent, doubled), jaccard.signatures(b, percent, doubled)))
            assert np.bitwise_count((jaccard.parities(a) ^ jaccard.parities(b)).view(np.uint64)).sum() <= jaccard.apart(len(a), len(b), percent)
            break


def test_unlike_sets_rarely_share_a_signature():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 2**63, 400).astype(np.uint64)) for _ in range(2))
    assert len(jaccard.signatures(a, 80, {})) <= 2 * jaccard.needed(400, 80) and not len(np.intersect1d(jaccard.signatures(a, 80, {}), jaccard.signatures(b, 80, {})))


def corpus(seed):
    rng = random.Random(seed)
    passage = words(rng, 60)
    rows = []
    for i in range(40):
        base = words(rng, rng.choice([1, 3, 4, 5, 6, 12, 40, 150, 700])).split()
        for _ in range(rng.randint(1, 5)):
            changed = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                changed[rng.randrange(len(changed))] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(changed[: len(changed) - rng.randint(0, max(0, len(base) // 12))]) or "x")
        if i % 3 == 0:
            rows += [f"{words(rng, 30)} {passage} {words(rng, 25)}", f"{passage} {words(rng, 9)}", words(rng, 5, 3)]
    return list(enumerate([*rows, "", None, "  \t\n", rows[0].upper(), *rows[:5]]))


@pytest.mark.parametrize("size,percent", [(5, 80), (3, 85), (5, 60)])
def test_components_equal_brute_force(spark, size, percent):
    rows = corpus(size + percent)
    want = linked(rows, size, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent).collect()}
    assert got == want


def test_all_pairs_of_a_hot_bucket(spark, monkeypatch):
    """Texts of one passage and a little more: unlike classes in shared buckets, over many blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(4)
    passage = words(rng, 50).split()
    rows = []
    for i in range(60):
        cut = rng.randint(0, 6)
        rows.append((i, " ".join(passage[cut:] + [f"v{rng.randrange(4)}" for _ in range(rng.randint(5, 14))])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(rows, 5, 80)


def test_near_copies_make_no_pairs_of_a_group(spark, monkeypatch):
    """Of 120 near copies, most unlike their leader, there are as many pairs in a step as classes, not thousands, and buckets with the same classes are one."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        at = rng.randrange(70)
        rows.append((i, " ".join(base[:at] + [f"x{i}"] + base[at + 1 :])))
    sizes, stored = {}, jaccard.stored

    def counted(df, name):
        out = stored(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(rows, 5, 80) and {c for _, c in got.values()} == {0}
    assert sizes["pairs"] <= 240 and sizes["links"] <= 480


def near_copies(rng, n, length=80):
    base = [f"w{i}" for i in range(length)]
    places = [rng.randrange(length - 10) for _ in range(n)]
    return [(i, " ".join(base[:at] + [f"x{i}"] + base[at + 1 :])) for i, at in enumerate(places)]


def test_rows_that_meet_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    """Of four times the near copies, in many blocks and buckets, about four times the pairs are made, before equal ones go."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    made, met = [0], jaccard.met

    def counted(*args):
        out = jaccard.stored(met(*args), "met")
        made[0] += out.count()
        return out

    monkeypatch.setattr(jaccard, "met", counted)
    counts = []
    for n in (60, 240):
        made[0], rows = 0, near_copies(random.Random(n), n)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == linked(rows, 5, 80)
        counts.append(made[0])
    assert counts[1] <= 6 * max(counts[0], 60) and counts[1] <= 8 * 240


@pytest.mark.parametrize("block", [1, 3])
def test_links_over_blocks_are_found(spark, monkeypatch, block):
    """Where nearly no rows meet within a block, all links are still found over two."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(block) + [(1000 + i, t) for i, t in near_copies(random.Random(block), 30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(rows, 5, 80)


def test_a_pair_is_made_in_one_of_its_buckets(spark):
    """Two sets that share 30 buckets, more than they name, meet in one group's pair; without a common name in each."""
    same = [5] * 16
    for shared, want in ((True, 1), (False, 30)):
        named = [[-9 - 100 * r * (not shared)] * jaccard.NAMED for r in (0, 1)]
        rows = [(k, r, 100, r, same, named[r], 1) for k in [-9, *range(29)] for r in (0, 1)]
        rest = spark.createDataFrame(rows, "key long, rep long, n long, comp long, fine array<long>, named array<long>, blocks int")
        for nearest in (False, True):
            pairs = [tuple(p) for p in jaccard.met(rest, 80, nearest).collect()]
            assert set(pairs) == {(0, 1)} and len(pairs) == want * (1 + nearest)


@pytest.mark.parametrize("held", [2, 65_536])
def test_buckets_are_found_over_batches(spark, monkeypatch, held):
    """Keys that go on over batches, of copies alone, and with more rows than are held."""
    monkeypatch.setattr(jaccard, "HELD", held)
    rows = [(64 * (k % 40), k * k % 97) for k in range(900)] + [(64 * 50, 5)] * 30 + [(64 * 51, 6), (64 * 52, 6), (64 * 51, 7), (64 * 52, 7)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = [(r["key"], r["rep"], r["leader"]) for r in jaccard.shared_keys(spark.createDataFrame(rows, "key long, rep long").coalesce(1)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    meet = lambda rows: {(a, b) for k in {r[0] for r in rows} for a in {r[1] for r in rows if r[0] == k} for b in {r[1] for r in rows if r[0] == k} if a < b}
    assert meet(found) == meet(rows)
    assert held == 2 or len({key for key, rep, _ in found if rep in (6, 7) and {r for k, r, _ in found if k == key} == {6, 7}}) == 1


def test_parts_are_doubled_where_they_do_not_suffice(monkeypatch):
    monkeypatch.setattr(jaccard, "PARTS", 0.01)
    monkeypatch.setattr(jaccard, "MORE_PARTS", 1)
    s = np.unique(np.random.default_rng(1).integers(0, 2**63, 900).astype(np.uint64))
    found = jaccard.doublings(s, 80)
    assert min(found.values()) > 0 and len(jaccard.signatures(s, 80, found)) == len(found) * jaccard.needed(len(s), 80)


# Schema


def brute_schema(rows, most=5):
    """The contract by recursion over whole values: (text, names above, boxed, bad) each."""
    values, bad = [], Counter()
    for text, under, boxed, wrong in rows:
        try:
            v = json.loads(text, parse_constant=lambda s: [][0]) if text is not None else None
        except (ValueError, IndexError):
            v = None
        if not isinstance(v, dict):
            bad[wrong or "!"] += 1
            continue
        v = [v] if boxed else v
        for name in reversed(under or []):
            v = {name: v}
        values.append(v)
    out = {}

    def visit(path, values, holders):
        kinds = Counter({dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "double", type(None): "null"}[type(v)] for v in values)
        names = {k for v in values if isinstance(v, dict) for k in v}
        sizes = [len(v) for v in values if isinstance(v, list)]
        as_map = len(names) > most and path != "$"
        out[path] = ("|".join(f"{k}:{n}" for k, n in sorted(kinds.items())), len(names), as_map, holders is not None and len(values) < holders, min(sizes, default=None), max(sizes, default=None))
        inner = [x for v in values if isinstance(v, list) for x in v]
        if inner:
            visit(path + "[]", inner, None)
        objects = [v for v in values if isinstance(v, dict)]
        if as_map:
            visit(path + ".*", [x for v in objects for x in v.values()], None)
        else:
            for k in names:
                visit(f"{path}.{k}", [v[k] for v in objects if k in v], len(objects))

    if values:
        visit("$", values, None)
    for path, n in bad.items():
        out[path] = (f"bad:{n}", 0, False, False, None, None)
    return out


def inferred(df, **k):
    return {r["path"]: tuple(r)[1:] for r in shredding.infer_schema(df, "text", **k).collect()}


def test_schema_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shredding, "MOST_PATHS", 40)  # footers are handed on often
    monkeypatch.setattr(shredding, "STEP_ROWS", 7)
    rng = random.Random(3)

    def value(depth):
        pick = rng.randrange(9 if depth else 6)
        if pick >= 7:
            return {rng.choice("abcdefghij"): value(depth - 1) for _ in range(rng.randint(0, 6))}
        if pick == 6:
            return [value(depth - 1) for _ in range(rng.randint(0, 4))]
        return [None, True, rng.randint(-5, 10**25), rng.random() * 1e-9, "text", {}][pick]

    rows = []
    for i in range(300):
        text = json.dumps({rng.choice("abc"): value(4) for _ in range(rng.randint(0, 3))})
        text = {7: None, 8: "", 9: text + " x", 10: "[1]", 11: '{"a": NaN}', 12: '{"a": 1', 13: f" \n{text}\t", 14: "﻿" + text, 15: '{"a": 01}'}.get(i % 40, text)
        rows.append((text, [f"g{rng.randrange(3)}", f"x{rng.randrange(9)}"] if i % 11 else None, i % 9 == 0, f"!{i % 4}" if i % 5 else None))
    df = spark.createDataFrame(rows, "text string, under array<string>, boxed boolean, bad string").repartition(5)
    assert inferred(df, under=F.col("under"), boxed=F.col("boxed"), bad=F.col("bad")) == brute_schema(rows)
    assert inferred(df) == brute_schema([(t, None, None, None) for t, *_ in rows])


def test_schema_of_odd_texts(spark):
    deep = '{"a":' * 30_000 + "1" + "}" * 30_000
    assert shredding.whole_object(deep) is not None and shredding.whole_object(deep[:-1]) is None and shredding.whole_object(deep + "}") is None
    long_number = '{"n": ' + "9" * 20_000 + ', "n2": 1e400, "s": "' + "x" * 2_000_000 + '"}'
    texts = [long_number, '{"b\\ud800": 1, "d": 1, "d": "last"}', '{"*": 1, "a.b": {"c": []}}', '{"a":{"a":[{},[[]]]}}', "1", None]
    got = inferred(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert got["$"] == ("object:4", 8, False, False, None, None) and got["$.n"][0] == "integer:1" and got["$.n2"][0] == "double:1" and got["$.d"][0] == "string:1"
    assert got["$.b\\ud800"][0] == "integer:1" and got["$.a.b.c"] == ("array:1", 0, False, False, 0, 0) and got["!"][0] == "bad:2"
    assert got["$.a.a"] == ("array:1", 0, False, False, 2, 2) and got["$.a.a[]"] == ("array:1|object:1", 0, False, False, 1, 1) and got["$.a.a[][]"] == ("array:1", 0, False, False, 0, 0)


@pytest.mark.parametrize("text", ['{"a": [1, 2.5, -0, 1E5, true, false, null, "x\\n\\u00e9", {}, [], [[{"b": []}]]], "": {"c": {}}}', '{"a" 1}', '{"a":}', '{,}', "[1,]", '{"a":1,}', "[}", '{"a":1}}', "{]", '"x"', "", "[1 2]", '{"a":tru}', "[,1]", '{1:2}', "1.", "-", '["\\x"]', '{"a":1 "b":2}', "{} {}", '{"a":[}'])
def test_the_deep_decoder_is_the_plain_one(text):
    def plain():
        try:
            return json.loads(text, parse_int=lambda s: 0, parse_float=lambda s: 0.0)
        except ValueError:
            return ValueError

    def deep():
        try:
            return shredding._decode_deep(text)
        except ValueError:
            return ValueError

    assert deep() == plain()


# Search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k):
    counts = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in counts]
    total, length = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, _), c, x in zip(docs, counts, n, strict=True):
            m = 75 + 25 * x * total // max(1, length)
            score = sum(floor(1000 * log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("leaf,slice_docs,step", [(1, 50, 1), (4, 20, 3), (256, 8192, 64)])
def test_search_equals_brute_force(spark, monkeypatch, leaf, slice_docs, step):
    for name, v in (("LEAF", leaf), ("SLICE_DOCS", slice_docs), ("STEP", step), ("BLOCK_ITEMS", 4)):
        monkeypatch.setattr(search, name, v)
    rng = random.Random(leaf)
    docs = [(i, " ".join(f"t{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.choice([0, 3, 3, 20, 80])))) for i in range(200)]
    docs += [(200 + i, docs[7][1]) for i in range(40)] + [(300, None), (301, ""), (302, "T1,T2;t3\x00é日本 é\x7fÉ"), (303, "tail " * 5000)]
    items = [(i, " ".join(f"t{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(1, 12)))) for i in range(10)] + [(10, None), (11, "nothing here"), (12, "é 日本 TAIL tail"), (13, docs[7][1])]
    rows = search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"), k=7).collect()
    assert sorted(tuple(r) for r in rows) == brute_search(docs, items, 7)


def test_walks_leave_out_what_cannot_enter():
    rng = np.random.default_rng(5)
    n = 20_000
    doc = np.concatenate([np.arange(n), np.sort(rng.choice(n, 300, replace=False))])
    term = np.concatenate([np.zeros(n, np.int64), np.ones(300, np.int64)])
    impact = np.concatenate([rng.integers(1, 40, n), rng.integers(100, 900, 300)])
    treaps = search.Treaps(term, doc, impact, 2)
    docs, scores, scored = treaps.best(np.array([0, 1]), np.array([1, 1000]), n, 5)
    score = np.zeros(n, np.int64)
    np.add.at(score, doc, np.where(term == 1, 1000, 1) * impact)
    best = np.lexsort((np.arange(n), -score))[:5]
    assert docs.tolist() == best.tolist() and scores.tolist() == score[best].tolist() and scored < n / 4
    # each treap is a heap by impact and a search tree by document
    for i in range(len(doc)):
        for child, side in ((treaps.left[i], -1), (treaps.right[i], 1)):
            assert child < 0 or (treaps.impact[child] <= treaps.impact[i] and (treaps.docs[child] - treaps.docs[i]) * side > 0)


# Odd tables


def test_odd_tables(spark):
    odd = [(1, "one two three four five six", 9, 9, "x", "y", "p", "k", "c", 3)] * 2 + [(None, "one two three four five six", None, None, None, None, None, None, None, None), (2, None, 1, 1, "", "", "", "", "", 1), (3, "", 1, 1, "", "", "", "", "", 1)]
    df = spark.createDataFrame(odd, CLASHING)
    none = df.limit(0)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()), key=repr)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (None, 2, None)]
    assert jaccard.jaccard_components(none).count() == 0
    assert shredding.infer_schema(none, "text").count() == 0
    assert inferred(df) == {"!": ("bad:5", 0, False, False, None, None)}
    items = spark.createDataFrame([("a", "three"), ("a", "three SIX six"), (None, "one"), ("b", None)], "item_id string, text string")
    found = [tuple(r) for r in search.ranked_search(df, items, k=2).collect()]
    assert len(found) == 6 and {(i, r, d) for i, r, d, _ in found} == {(x, r, 1) for x in ("a", None) for r in (1, 2)}
    assert search.ranked_search(none, items).count() == search.ranked_search(df, items.limit(0)).count() == 0
    renamed = df.withColumnRenamed("doc_id", "Text2").withColumn("Text2", F.col("Text2").cast("string"))
    assert sorted((r["Text2"] or "", r["component_id"] or "") for r in jaccard.jaccard_components(renamed, id_col="Text2").collect()) == [("", ""), ("1", "1"), ("1", "1"), ("2", "2"), ("3", "3")]


def test_shingles_are_those_of_the_contract():
    assert [len(Shingler(5)(t)) for t in ("a b c d e f", "A b", "a b", "", None)] == [len(shingles(t, 5)) for t in ("a b c d e f", "A b", "a b", "", None)] == [2, 1, 1, 0, 0]


def test_components_read_few_times_the_links(spark, monkeypatch):
    """A chain in any order and stars around large ids: rounds contract the links, and more links only join components."""
    rng = random.Random(13)
    order = rng.sample(range(1500), 1500)
    pairs = [*zip(order, order[1:], strict=False), *((9000 + n % 2, 2000 + n) for n in range(200))]
    read, join = [], DataFrame.join

    def counted(self, *rest, **more):
        if {"a", "b"} <= set(self.columns):
            read.append(self.count())
        return join(self, *rest, **more)

    monkeypatch.setattr(DataFrame, "join", counted)
    got = {r["node"]: r["comp"] for r in minhash.components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    assert got == dict.fromkeys(range(1500), 0) | {n: 2000 + n % 2 for n in [*range(2000, 2200), 9000, 9001]}
    assert sum(read) <= 6 * 2 * len(pairs)
    first = minhash.components(spark.createDataFrame(pairs[:700] + pairs[710:], "a long, b long"), "t")
    more = minhash.merged(first, spark.createDataFrame([*pairs[700:710], (2000, 2001), (7000, 2001), (7001, 7002)], "a long, b long"), "u")
    assert {r["node"]: r["comp"] for r in more.collect()} == {n: min(c, 2000) for n, c in got.items()} | {7000: 2000, 7001: 7001, 7002: 7001}

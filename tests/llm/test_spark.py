"""The corpus operators on small tables with nulls, copies, ties and odd columns, against plain Python."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from placebook.llm import exact, langid, linededup, media, minhash, mixing, packing, pii, queries, sharding, tokencount

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rank int, size string, id string"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Rows: nulls, empty and long texts, exact and near copies, shared passages, a repeated row."""
    rng = random.Random(7)
    passage = ". ".join(words(rng, 12).capitalize() for _ in range(6)) + "."
    base = words(rng, 200)
    texts = [None, "", "   \n", "one", "two words", words(rng, 20_000), base, base, base.upper(), passage]
    for i in range(12):
        w = base.split()
        for _ in range(i):
            w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
        texts.append(" ".join(w))
    texts += [f"{words(rng, 15).capitalize()}. {passage} {words(rng, 9).capitalize()}.\n{words(rng, 5)}" for _ in range(4)]
    texts += [words(rng, rng.randint(1, 80)) for _ in range(25)]
    rows = [(i, t, "en" if i % 3 else None, [None, "a", "b", "c"][i % 4 if i % 5 else 1], None, i, "x", "y") for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[12]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, corpus, empty):
    groups = {}
    for r in corpus:
        groups.setdefault(r[1] or "", []).append(r[0])
    for keep, best in (("min", min), ("max", max)):
        got = sorted(map(tuple, exact.content_sort_dedup(docs, keep=keep).collect()))
        assert got == sorted((r[0], best(g), len(g), r[0] == best(g), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in corpus for g in [groups[r[1] or ""]])
    assert exact.content_sort_dedup(empty).count() == 0


def test_shards(docs, corpus, empty):
    one = sharding.shuffle_into_shards(docs, shards=7)
    rows = one.collect()
    assert one.columns == [*docs.columns, "shard", "slot"]
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(7))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.shuffle_into_shards(docs.repartition(5), shards=7).collect()
    place = lambda rs: sorted((r["doc_id"], r["text"] or "", r["shard"], r["slot"]) for r in rs)
    assert place(rows) == place(again)
    assert sharding.shuffle_into_shards(empty, shards=7).count() == 0


def test_mixing(docs, corpus, empty):
    rows = mixing.curriculum_mix(docs).collect()
    assert len(rows) == len(corpus)
    taken, targets, sizes = {}, {}, {}
    for r in rows:
        size = len([w for w in (r["text"] or "").replace("\n", " ").split(" ") if w])
        assert r["size"] == size and r["taken"] in (0, size, 2 * size, 3 * size)
        assert len(r["positions"]) == (r["taken"] // size if size else 0) and all(0 <= p <= 1 for p in r["positions"])
        s = r["source"]
        taken[s], targets[s] = taken.get(s, 0) + r["taken"], r["target"]
        sizes[s] = max(sizes.get(s, 0), size)
    assert set(taken) == {"a", "b", "c", None}
    assert all(abs(taken[s] - targets[s]) <= sizes[s] / 2 + 1 for s in taken)
    order = [r["position"] for r in mixing.in_training_order(mixing.curriculum_mix(docs)).collect()]
    assert order == sorted(order) and len(order) == sum(len(r["positions"]) for r in rows)
    assert mixing.curriculum_mix(empty).count() == 0


def test_schedule_is_inverted(spark):
    t = spark.range(101).select((F.col("id") / 100).alias("t"))
    for ramp in mixing.RAMPS:
        back = t.select("t", mixing.inverse_schedule(F.col("t") + ramp * (F.col("t") * F.col("t") - F.col("t")), F.lit(ramp)).alias("b"))
        assert back.filter(F.abs(F.col("t") - F.col("b")) > 1e-9).count() == 0


def plain_components(corpus, size, percent):
    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    sets = [(r[0], shingles(r[1])) for r in corpus]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(s), root(i), i == root(i)) for i, s in sets)


def test_near_duplicates(docs, corpus, empty):
    got = minhash.near_duplicates(docs, size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == plain_components(corpus, 3, 85)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_without_an_id(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (5, "a b c")], "doc_id long, text string")
    got = [tuple(r) for r in minhash.near_duplicates(df, size=3).collect()]
    assert sorted(got, key=str) == [(3, 1, 3, True), (5, 1, 3, False), (None, 1, None, False)]


def test_documents_without_an_id_stay_in_the_pipeline(spark):
    import corpus_pipeline

    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text), (None, "other words that stand in no other text here"), (3, text), (5, text)], "doc_id long, text string")
    got = corpus_pipeline.one_of_each(spark, df, DATA)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, text), (None, "other words that stand in no other text here"), (3, text)], key=str)


def plain_line_dedup(corpus, least):
    seen, cuts = {}, {}
    texts = sorted({r[0]: r[1] for r in corpus}.items())
    for key, text in texts:
        units = [" ".join(x.split()) for x in linededup.lines(text or "")]
        count = [len(x.split()) for x in units]
        found = set()
        for i in range(len(units)):
            j = next((j for j in range(i, len(units) + 1) if sum(count[i:j]) >= least), None)
            if j is not None:
                found.add((i, j))
            b = next((b for b in range(i, -1, -1) if sum(count[b : i + 1]) >= least), None)
            if b is not None:
                found.add((b, i + 1))
        for i, j in sorted(found):
            at = seen.setdefault(tuple(units[i:j]), (key, i))
            if at != (key, i):
                cuts.setdefault(key, set()).add((i, j))
    return {key: "".join(x for n, x in enumerate(linededup.lines(text)) if not any(i <= n < j for i, j in cuts.get(key, ()))) if text is not None else None for key, text in texts}


def test_line_dedup(docs, corpus, empty):
    out = linededup.line_dedup(docs)
    assert out.columns == [*docs.columns, "removed_lines", "removed_words"]
    expected = plain_line_dedup(corpus, 50)
    rows = out.collect()
    assert len(rows) == len(corpus) and all(r["text"] == expected[r["doc_id"]] for r in rows)
    assert sum(r["removed_lines"] > 0 for r in rows) >= 5
    assert linededup.line_dedup(empty).count() == 0


def test_line_dedup_on_given_documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    expected = plain_line_dedup([tuple(r) for r in rows.collect()], 50)
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(rows).collect()}
    assert got == expected


def plain_word_dedup(texts, least=50):
    """Words that stay, of (id, text) in the order of ids: brute force over all word windows, without lines."""
    seen, out = set(), {}
    for key, text in sorted(texts):
        w = text.split()
        gone = set()
        for i in range(len(w) - least + 1):
            if tuple(w[i : i + least]) in seen:
                gone.update(range(i, i + least))
            seen.add(tuple(w[i : i + least]))
        out[key] = [x for n, x in enumerate(w) if n not in gone]
    return out


def test_line_dedup_finds_runs_inside_of_lines(spark):
    """Passages that begin and end in mid-sentence, of 49 to 80 words, in one line or several."""
    rng = random.Random(11)
    texts = []
    for n in (49, 50, 51, 60, 80):
        for stops in (0, 7, 25):
            passage = [x + "." if stops and i % stops == stops - 1 else x for i, x in enumerate(words(rng, n).split())]
            texts += [" ".join([words(rng, rng.randint(1, 30)), *passage, words(rng, rng.randint(1, 30))]) for _ in range(3)]
            texts.append(words(rng, 40) + "\n" + "\n".join(passage) + " " + words(rng, 3))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = plain_word_dedup(rows)
    assert {k: r["text"].split() for k, r in got.items()} == expected
    assert all(r["removed_words"] == len(texts[k].split()) - len(expected[k]) for k, r in got.items())
    assert sum(r["removed_words"] >= 50 for r in got.values()) >= 36


def test_line_dedup_leaves_the_words_of_the_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").filter("doc_id is not null and text is not null")
    got = {r["doc_id"]: r["text"].split() for r in linededup.line_dedup(rows).collect()}
    assert got == plain_word_dedup([tuple(r) for r in rows.collect()])


def test_line_dedup_loses_no_word_to_runs_with_one_hash(spark):
    """With hashes of six bits most fingerprints, blocks and windows meet unlike ones."""

    class Narrow(linededup.RunHashes):
        def __call__(self, hashes, first, end):
            return super().__call__(hashes, first, end) >> np.uint64(58) << np.uint64(10)

    rng = random.Random(5)
    passage = words(rng, 70)
    rows = [(n, " ".join([words(rng, 60), passage if n % 3 == 0 else "", words(rng, 90)])) for n in range(40)]
    got = {r["doc_id"]: r for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hasher=Narrow).collect()}
    expected = plain_word_dedup(rows)
    for key, text in rows:
        left = got[key]["text"].split()
        assert got[key]["removed_words"] == len(text.split()) - len(left)
        at = iter(left)
        assert all(w in at for w in expected[key])  # what is left has all that may stay, in order


def test_line_dedup_fetches_words_once(spark):
    """A text whose windows stand in many earlier documents is compared about once, not with each of them."""
    rng = random.Random(8)
    whole = words(rng, 400).split()
    rows = [(n, " ".join([words(rng, 9), *whole[10 * n : 10 * n + 60], words(rng, 9)])) for n in range(35)] + [(99, " ".join(whole))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = linededup.repeated_runs(df, F.col("doc_id")).filter("id = 99").select(F.explode("pieces").alias("p"))
    matches = pieces.select("p.first", "p.end", "p.lead", "p.of").distinct().collect()
    assert {n for m in matches for n in range(m["first"], m["end"])} == set(range(400))
    assert all(m["end"] - m["first"] >= 50 for m in matches) and sum(m["end"] - m["first"] for m in matches) <= 800
    got = {r["doc_id"]: r["text"].split() for r in linededup.line_dedup(df).collect()}
    assert got == plain_word_dedup(rows)


def test_line_dedup_where_rows_are_one_document(spark):
    """Rows with one id and text are cut alike, whether they hold the earlier run or the later one."""
    rng = random.Random(6)
    passage = words(rng, 64)
    a, b = f"{words(rng, 9)} {passage} {words(rng, 40)}", f"{words(rng, 30)} {passage} {words(rng, 8)}"
    rows = [(1, a)] * 7 + [(2, b)] * 5
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = plain_word_dedup([(1, a), (2, b)])
    assert len(got) == 12 and all(r["text"].split() == expected[r["doc_id"]] for r in got)
    assert {(r["doc_id"], r["removed_words"]) for r in got} == {(1, 0), (2, 64)}


def test_media(docs, corpus):
    rows = media.text_media(docs).collect()
    assert len(rows) == len(corpus)
    by_id = {r[0]: (r[1] or "").encode() for r in corpus}
    for r in rows:
        payload = media.padded(by_id[r["doc_id"]])
        png = media.encode_png(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (
            len(by_id[r["doc_id"]]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(),
        )


def test_sequences(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="media:d1" alt="x"><p>b</p>'), (2, None), (3, "")], "page_id long, html string")
    store = spark.createDataFrame([("d1", bytearray(b"\x01"))], "digest string, media binary")
    got = media.sequences(media.resolve(media.interleave(pages), store)).collect()
    assert [(r["page_id"], [(i["kind"], i["text"], i["caption"], i["media"]) for i in r["items"]]) for r in got] == [(1, [("text", "a", None, None), ("image", None, "x", bytearray(b"\x01")), ("text", "b", None, None)])]


def test_pii(docs, spark, empty):
    df = spark.createDataFrame([(1, "mail a.b@c.org or 10.0.0.1"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    got = {(r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"])) for r in pii.detect_pii(df).collect()}
    assert got == {(1, (("email", 5, 14), ("ip", 18, 26))), (2, ()), (3, ())}
    assert pii.detect_pii(docs).count() == docs.count() and pii.detect_pii(empty).count() == 0


def test_packing(docs, corpus, empty):
    e = packing.ChunkEncoder(packing.tokenizer_path())
    rows = packing.pack_documents(docs, with_ids=True).collect()
    texts = {r[0]: r[1] or "" for r in corpus}
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], {}).setdefault(r["piece"], r)
        assert len(r["ids"]) == r["length"] <= 2048
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for key, own in pieces.items():
        ids = [i for n in sorted(own) for i in own[n]["ids"]]
        assert ids == [*e.whole.encode(texts[key], add_special_tokens=False).ids, 0]
        assert all(own[n]["length"] == 2048 for n in own if n) and [own[n]["start"] for n in sorted(own)] == [sum(own[m]["length"] for m in range(n)) for n in sorted(own)]
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack_documents(empty).count() == 0


def test_language_id(spark, docs, empty):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    who = langid.train(given, ~langid.held_out())
    found = langid.identify(given, who).filter(langid.held_out())
    right = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("share"), F.avg(F.col("rejected").cast("int")).alias("rejected")).collect()[0]
    assert right["share"] >= 0.97 and right["rejected"] <= 0.01
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 %%"), (4, "the and of")], "doc_id long, text string")
    rows = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in langid.identify(odd, who).collect()}
    assert all(rows[i] == ("und", 0.0, True) for i in (1, 2, 3)) and rows[4][0] == "en" and 0 < rows[4][1] <= 1
    noise = spark.createDataFrame([(1, "ⴰⴱⴳ ⴷⴹⴻ ⴼⴳⵯ " * 30)], "doc_id long, text string")
    assert langid.identify(noise, who).collect()[0]["rejected"]
    nobody = langid.train(empty, F.lit(True))
    assert langid.identify(docs, nobody).filter("lang_pred <> 'und'").count() == 0


def test_token_counts(docs, corpus, empty):
    trie = tokencount.Trie(*tokencount.piece_scores(tokencount.vocabulary_path()))
    for r in tokencount.count_tokens(docs).collect():
        text = next(c[1] for c in corpus if c[0] == r["doc_id"]) or ""
        assert (r["n_tokens"], r["n_pretokens"]) == (sum(trie.insert(w)[0] for w in text.split()), len(text.split()))
    assert tokencount.count_tokens(empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "clicks"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    found = con.sql(queries.SQL[name])
    at = [found.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = docs.count()
    left, stages = docs, {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        left = corpus_pipeline.stored(stage(spark, left, DATA), name)
        assert left.columns == docs.columns
        stages[name] = {r["doc_id"]: r["text"] for r in left.collect()}
    assert len(stages["language_id"]) >= 0.98 * n
    expected = {k: t for k, t in plain_line_dedup(list(stages["language_id"].items()), 50).items() if t.strip()}
    assert stages["line_dedup"] == expected
    kept = {i for i, _, _, k in plain_components(list(expected.items()), 5, 80) if k}
    assert set(stages["near_dedup"]) == kept
    out = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= kept
    assert out.agg(F.max(F.col("offset") + F.col("length"))).collect()[0][0] <= 2048


def test_fingerprints_that_stand_once_go_first(spark, monkeypatch):
    """Only fingerprints of two rows or more are grouped and joined, wherever Arrow's batches end."""
    rows = [(k * k % 23, f"r{n}") for n, k in enumerate(range(60))] + [(100 + k, "alone") for k in range(20)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = sorted(map(tuple, linededup.in_company(spark.createDataFrame(rows, "gram long, id string"), "gram").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(r for r in rows if sum(r[0] == o[0] for o in rows) > 1)
    sizes, stored = {}, linededup.stored

    def counted(df, name):
        out = stored(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(linededup, "stored", counted)
    docs = [(n, " ".join(f"d{n}w{k}" for k in range(200))) for n in range(5)]
    assert linededup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).filter("removed_words > 0").count() == 0
    assert sizes["blocks"] == sizes["leads"] == 0

"""Many rows with one id, and pre-tokens of millions of characters."""

import random
import tracemalloc

from pyspark.sql import functions as F

from placebook.llm import sharding, tokencount


def test_rows_with_one_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 200)
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    seen = {}
    sums = sharding.prefix_sums

    def watched(rows, group, piece, *more):
        seen["pieces"] = rows.filter("doc_id is null").groupBy(*group, piece).count().agg(F.max("count"), F.count("count")).first()
        return sums(rows, group, piece, *more)

    monkeypatch.setattr(sharding, "prefix_sums", watched)
    placed = sharding.shuffle_into_shards(df, shards=4)
    again = sharding.shuffle_into_shards(df.repartition(13), shards=4)
    got = sorted((r["shard"], r["slot"], r["text"]) for r in placed.collect())
    assert [(s, k) for s, k, _ in got] == [(s, k) for s in range(4) for k in range(5_000)]
    assert got == sorted((r["shard"], r["slot"], r["text"]) for r in again.collect())
    assert seen["pieces"][0] < 20_000 / 3 / 8 and seen["pieces"][1] > 16  # the rows without an id are in many slices


def test_long_words_are_scored_as_in_the_trie(monkeypatch):
    trie = tokencount.Trie(*tokencount.piece_scores(tokencount.vocabulary_path()))
    rng = random.Random(5)
    for size in (1, 2, 17, 300, 990):
        for letters in ("abcdeinorst", "aé日本語x", "\U0001f600z"):
            word = "".join(rng.choice(letters) for _ in range(size))
            assert trie.long(word) == trie.insert(word)


def test_a_word_of_millions_of_characters_needs_little_memory():
    trie = tokencount.Trie(*tokencount.piece_scores(tokencount.vocabulary_path()))
    word = "tokenisation" * 200_000
    tracemalloc.start()
    tokens, *_ = trie.count(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 200_000 < tokens < 1_200_000 and peak < 20_000_000 and len(trie.score) == 1


def test_the_trie_starts_anew_within_a_text(monkeypatch):
    trie, plain = (tokencount.Trie(*tokencount.piece_scores(tokencount.vocabulary_path())) for _ in range(2))
    text = " ".join(f"word{i}x{i * i}" for i in range(2_000))
    want = plain.count(text)
    monkeypatch.setattr(tokencount, "MOST_NODES", 500)
    got = trie.count(text)
    assert got[:3] == want[:3] and abs(got[3] - want[3]) < 1e-6 and len(trie.score) < 600

"""The corpus operators as queries over the whole ``documents`` table, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact import content_sort_dedup
from .jaccard import jaccard_components
from .langid import held_out, identify, train
from .linededup import line_dedup
from .media import interleave, media_store, resolve, sequences, text_media
from .minhash import near_duplicates
from .mixing import curriculum_mix
from .packing import pack_documents
from .pii import BASE_KINDS, KINDS, detect_pii
from .search import ranked_search
from .sharding import shuffle_into_shards
from .shredding import infer_schema
from .tokencount import count_tokens


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_multi_index_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=3, percent=85)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(list_distinct(CASE
    WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 85 * (nx.n + ny.n - common)
), e AS (
  SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS reach FROM documents
  UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a
), c AS (
  SELECT node, min(reach) AS component_id FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shuffle_into_shards(documents(spark, sf_dir).select("doc_id", "text"), shards=40)
    data = F.col("text").cast("binary")
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(data, F.lit(b""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts without later repeated runs, and what went."""
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op5_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_dedup(documents(spark, sf_dir), keep="max")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum_mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    # a result row for each document, range-sorted by its first position; those not taken come last
    out = mixed.select(
        "doc_id", "size", "source_size", "target", "taken", F.size("positions").alias("times"),
        F.get("positions", F.lit(0)).alias("first_position"), F.try_element_at("positions", F.lit(-1)).alias("last_position"),
    )
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s
), w AS (
  SELECT *, rank % 3 + 1 AS weight FROM r
), f AS (
  SELECT *, coalesce(sum(source_size * 3) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent,
         sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights_left,
         sum(source_size) OVER ()::BIGINT AS words FROM w
), l AS (
  SELECT *, CAST(words - spent AS DOUBLE) / weights_left AS level FROM f
), m AS (
  SELECT *, (SELECT arg_min(level, (source_size / weight, rank)) FROM l WHERE NOT level * weight > source_size * 3) AS final FROM l
), t AS (
  SELECT source, rank, source_size, least(final * weight, CAST(source_size * 3 AS DOUBLE)) AS target FROM m
), p AS (
  SELECT d.doc_id, d.source, d.size, d.h, t.rank, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS want,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS passes FROM p
), k AS (
  SELECT *, want - passes * source_size AS rest, 2 * before + size <= 2 * (want - passes * source_size) AS in_last FROM q
), y AS (
  SELECT source, first(rest) - coalesce(sum(size) FILTER (in_last), 0)::BIGINT AS miss FROM k GROUP BY source
), u AS (
  SELECT k.source, abs(miss - CASE WHEN in_last THEN -size ELSE size END) AS after, h, size, doc_id, miss
  FROM k JOIN y ON k.source IS NOT DISTINCT FROM y.source WHERE size > 0
), v AS (
  SELECT arg_min(doc_id, (after, h, size)) AS doc_id FROM u WHERE after < abs(miss) GROUP BY source
), x AS (
  SELECT k.*, CASE WHEN size = 0 THEN 0 ELSE passes + CAST(in_last <> (v.doc_id IS NOT NULL) AS INT) END::INT AS times FROM k LEFT JOIN v ON k.doc_id = v.doc_id
), a AS (
  SELECT *, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][(rank % 3 + 1)::INT] AS r,
         least(greatest((before + size / 2) / greatest(want, 1), 0.0::DOUBLE), 1.0::DOUBLE) AS s0,
         least(greatest(((times - 1) * source_size + before + size / 2) / greatest(want, 1), 0.0::DOUBLE), 1.0::DOUBLE) AS s1 FROM x
)
SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken, times,
       CASE WHEN times > 0 THEN CASE WHEN r = 0 THEN s0 ELSE (sqrt((1 - r) * (1 - r) + 4 * r * s0) - (1 - r)) / (2 * r) END END AS first_position,
       CASE WHEN times > 0 THEN CASE WHEN r = 0 THEN s1 ELSE (sqrt((1 - r) * (1 - r) + 4 * r * s1) - (1 - r)) / (2 * r) END END AS last_position
FROM a
"""


def op3_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption"
    )


def interleaved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as sequences of text and media, in order; what a head says is no content.

    Media would be resolved in the store of the documents' payloads; pages of the tables have none.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = sequences(resolve(interleave(pages), media_store(documents(spark, sf_dir)).select("digest", "media_bytes")))
    text = F.filter(F.transform("items", lambda i: i["text"]), lambda t: t.isNotNull())
    return found.select(
        "page_id", F.size("items").alias("n_items"), F.size(text).alias("n_texts"), F.sha2(F.array_join(text, "\n").cast("binary"), 256).alias("text_sha256"),
        F.array_max(F.transform("items", lambda i: i["position"])).alias("last_position"), F.size(F.filter("items", lambda i: i["media_bytes"].isNotNull())).alias("n_resolved"),
    )


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the law of op2 fixes: rows, slots and the whole content of all shards together."""
    placed = op2_hypergeometric_shards(spark, sf_dir)
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.countDistinct("slot").alias("n_slots"))


SHARD_ROWS_SQL = """
SELECT s::INT AS shard, r // 40 + (s < r % 40)::BIGINT AS n, 0::BIGINT AS first_slot, r // 40 + (s < r % 40)::BIGINT - 1 AS last_slot, r // 40 + (s < r % 40)::BIGINT AS n_slots
FROM (SELECT count(*) AS r FROM documents), (SELECT unnest(range(40)) AS s) WHERE r // 40 + (s < r % 40)::BIGINT > 0
"""


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the size that op2 gives it, and that it stands in one shard and slot."""
    placed = op2_hypergeometric_shards(spark, sf_dir)
    return placed.groupBy("doc_id").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("law").alias("law"))


SHARD_SIZES_SQL = "SELECT doc_id, max(coalesce(strlen(text), 0) + 16)::BIGINT AS size, count(*) AS n, 'rows' AS law FROM documents GROUP BY doc_id"


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express: sizes and the digest of the padded payload."""
    return op3_interleaved_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "position", "caption")


MEDIA_PAYLOADS_SQL = """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS data FROM documents), n AS (SELECT doc_id, data, octet_length(data) AS n FROM t),
 p AS (SELECT *, greatest(64, ((n + 63) // 64) * 64) AS whole FROM n)
SELECT doc_id, n::BIGINT AS n_bytes, whole::BIGINT AS payload_bytes, sha256(data || CAST(repeat('\\x00', (whole - n)::INT) AS BLOB)) AS payload_sha256, 1::INT AS position, n || ' bytes' AS caption FROM p
"""


def base_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op7's base kinds."""
    return op7_pii_spans(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in BASE_KINDS])


BASE_PII_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (
  SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
    len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda y: y::HUGEINT)) <= 255)) AS n_ip,
    list_filter(list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: len(x) BETWEEN 14 AND 19) AS cards,
    len(list_filter(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: len(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)) AS n_phone FROM d)
SELECT doc_id, n_email::BIGINT AS n_email, n_ip::BIGINT AS n_ip, n_phone::BIGINT AS n_phone,
  len(list_filter(cards, lambda x: list_sum(list_transform(range(len(x)), lambda i: CASE WHEN i % 2 = 0 THEN x[-1 - i]::INT WHEN x[-1 - i]::INT > 4 THEN 2 * x[-1 - i]::INT - 9 ELSE 2 * x[-1 - i]::INT END)) % 10 = 0))::BIGINT AS n_card FROM m
"""


def held_out_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 holds out, and which documents have no language by rule."""
    found = op9_kneser_ney(spark, sf_dir)
    return found.select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("without_letters"))


HELD_OUT_SQL = r"""
WITH RECURSIVE b AS (SELECT doc_id, encode(CAST(doc_id AS VARCHAR)) AS d, regexp_matches(coalesce(text, ''), '\p{L}') AS letters FROM documents),
c AS (SELECT doc_id, letters, d, 4294967295::BIGINT AS crc, 0 AS i, octet_length(d) AS n FROM b
  UNION ALL SELECT doc_id, letters, d, list_reduce(list_prepend(xor(crc, ('0x' || hex(array_slice(d, i + 1, i + 1)))::BIGINT), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), i + 1, n FROM c WHERE i < n)
SELECT doc_id, xor(crc, 4294967295) % 3 = 1 AS held_out, NOT letters AS without_letters FROM c WHERE i = n
"""


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_pii(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    scores = F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",")
    return found.select(
        "doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"), scores.alias("scores"),
    )


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    who = train(docs, ~held_out())
    found = identify(docs.select("doc_id", "text"), who)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op10_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


def op11_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), size=5, percent=80)


OP11_SQL = OP1_SQL.replace(
    "len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])",
    "len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))",
)
OP11_SQL = OP11_SQL.replace(">= 85 * (", ">= 80 * (").replace(", d.doc_id = c.component_id AS kept", "")


def op12_shredded_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet").select("click_id", "client_id", "props")
    g = F.coalesce(F.pmod("client_id", F.lit(200)), F.lit(0))
    x = F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary")) % (g % 37 + 1)
    under = F.array(F.concat(F.lit("g"), g), F.concat(F.lit("x"), x))
    return infer_schema(clicks, "props", under=under, boxed=F.coalesce(F.col("click_id") % 9 == 0, F.lit(False)), bad=F.concat(F.lit("!g"), g))


def _op12_sql() -> str:
    """The same from plain trees of values: a level of map names after the other is replaced, as many as the props have."""
    levels, base = [], "s0"
    for level in range(2, 9):
        levels.append(f"""
m{level} AS (SELECT of FROM (SELECT p[1:{level}] AS of, count(DISTINCT p[{level + 1}]) AS n FROM {base} WHERE len(p) > {level} AND p[{level + 1}][1] = '.' GROUP BY 1) WHERE n > 5),
s{level} AS (SELECT CASE WHEN m.of IS NOT NULL THEN list_concat(list_concat(p[1:{level}], ['*']), p[{level + 2}:]) ELSE p END AS p, k, len FROM {base} s
  LEFT JOIN m{level} m ON len(p) > {level} AND p[{level + 1}][1] = '.' AND m.of = p[1:{level}]),
n{level} AS (SELECT p[1:{level}] AS of, count(DISTINCT p[{level + 1}]) AS n FROM {base} WHERE len(p) > {level} AND p[{level + 1}][1] = '.' GROUP BY 1)""")
        base = f"s{level}"
    return (
        r"""
WITH RECURSIVE d AS (SELECT DISTINCT click_id FROM clicks),
c AS (SELECT click_id, encode(CAST(click_id AS VARCHAR)) AS b, 4294967295::BIGINT AS crc, 0 AS i FROM d
  UNION ALL SELECT click_id, b, list_reduce(list_prepend(xor(crc, ('0x' || hex(array_slice(b, i + 1, i + 1)))::BIGINT), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), i + 1 FROM c WHERE i < octet_length(b)),
h AS (SELECT click_id, xor(crc, 4294967295) AS crc FROM c WHERE i = octet_length(b)),
r AS (SELECT coalesce(client_id, 0) % 200 AS g, crc % (coalesce(client_id, 0) % 200 % 37 + 1) AS x, click_id % 9 = 0 AS boxed,
  CASE WHEN json_valid(props) THEN CASE WHEN json_type(props::JSON) = 'OBJECT' THEN props::JSON END END AS v FROM clicks JOIN h USING (click_id)),
t AS (
  SELECT ['$', '.g' || g, '.x' || x] AS p, CASE WHEN boxed THEN json_array(v) ELSE v END AS v FROM r WHERE v IS NOT NULL
  UNION ALL
  SELECT list_append(p, e.s), e.v FROM (SELECT p, unnest(CASE json_type(v)
    WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {'s': '.' || k, 'v': json_extract(v, '$."' || k || '"')})
    WHEN 'ARRAY' THEN list_transform(json_extract(v, '$[*]'), lambda x: {'s': '[]', 'v': x}) ELSE [] END) AS e FROM t)
),
s0 AS (
  SELECT p, CASE json_type(v) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'DOUBLE' THEN 'double' ELSE 'integer' END AS k,
    CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v)::BIGINT END AS len FROM t
  UNION ALL SELECT ['$'], 'object', NULL FROM r WHERE v IS NOT NULL
  UNION ALL SELECT ['$', '.g' || g], 'object', NULL FROM r WHERE v IS NOT NULL
  UNION ALL SELECT ['!g' || g], 'bad', NULL FROM r WHERE v IS NULL
),
n1 AS (SELECT p[1:1] AS of, count(DISTINCT p[2]) AS n FROM s0 WHERE len(p) > 1 GROUP BY 1),"""
        + ",".join(levels)
        + f""",
names AS ({" UNION ALL ".join(f"SELECT * FROM n{level}" for level in range(1, 9))}),
k AS (SELECT p, k, count(*) AS n, min(len) AS lo, max(len) AS hi FROM {base} GROUP BY p, k),
a AS (SELECT p, string_agg(k || ':' || n, '|' ORDER BY k) AS types, sum(n) AS n, coalesce(sum(n) FILTER (k = 'object'), 0) AS objects, min(lo) AS min_len, max(hi) AS max_len FROM k GROUP BY p)
SELECT array_to_string(list_transform(a.p, lambda x: CASE WHEN x = '*' THEN '.*' ELSE x END), '') AS path, types, coalesce(names.n, 0)::BIGINT AS n_names, coalesce(names.n, 0) > 5 AND len(a.p) > 1 AS is_map,
  coalesce(a.p[-1][1] = '.' AND len(a.p) > 1 AND a.n < up.objects, false) AS optional, a.min_len, a.max_len
FROM a LEFT JOIN names ON names.of = a.p LEFT JOIN (SELECT p, objects FROM a) up ON len(a.p) > 1 AND up.p = a.p[1:len(a.p) - 1]
"""
    )


OP12_SQL = _op12_sql()


def op13_inverted_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), f AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), d AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id
), g AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM d
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term
), m AS (
  SELECT doc_id, 75 + (25 * n * docs) // words AS m FROM d, g
), s AS (
  SELECT item_id, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM (SELECT item_id, term, count(*) AS r FROM q GROUP BY ALL) JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 20
"""


def kept_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 leaves of each text as words, and how many go."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"), lambda w: w != "")
    return op4_winnowed_lines(spark, sf_dir).select("doc_id", "removed_words", F.sha2(F.array_join(words, " ").cast("binary"), 256).alias("words_sha256"))


KEPT_WORDS_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50
), h AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM g
), f AS (
  SELECT h, min((doc_id, i)) AS lead FROM h GROUP BY h HAVING count(*) > 1
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h JOIN f USING (h) WHERE (doc_id, i) <> lead
), n AS (
  SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id
)
SELECT doc_id, coalesce(len(gone), 0)::BIGINT AS removed_words,
  sha256(coalesce(array_to_string(list_filter(ws, lambda x, k: gone IS NULL OR NOT list_contains(gone, k)), ' '), '')) AS words_sha256
FROM w LEFT JOIN n USING (doc_id)
"""

QUERIES = {
    "op1_multi_index_minhash": op1_multi_index_minhash,
    "op3_interleaved_media": op3_interleaved_media,
    "op7_pii_spans": op7_pii_spans,
    "op8_best_two_fit": op8_best_two_fit,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_trie_token_counts": op10_trie_token_counts,
    "op11_partenum_join": op11_partenum_join,
    "op12_shredded_schema": op12_shredded_schema,
    "op13_inverted_treaps": op13_inverted_treaps,
    "op2_hypergeometric_shards": op2_hypergeometric_shards,
    "op4_winnowed_lines": op4_winnowed_lines,
    "op5_content_sort": op5_content_sort,
    "op6_curriculum_mix": op6_curriculum_mix,
    "interleaved_pages": interleaved_pages,
    "kept_words": kept_words,
    "shard_rows": shard_rows,
    "shard_sizes": shard_sizes,
    "media_payloads": media_payloads,
    "base_pii_counts": base_pii_counts,
    "held_out_documents": held_out_documents,
}
SQL = {
    "op1_multi_index_minhash": OP1_SQL,
    "op5_content_sort": OP5_SQL,
    "op6_curriculum_mix": OP6_SQL,
    "op11_partenum_join": OP11_SQL,
    "op12_shredded_schema": OP12_SQL,
    "op13_inverted_treaps": OP13_SQL,
    "kept_words": KEPT_WORDS_SQL,
    "shard_rows": SHARD_ROWS_SQL,
    "shard_sizes": SHARD_SIZES_SQL,
    "media_payloads": MEDIA_PAYLOADS_SQL,
    "base_pii_counts": BASE_PII_SQL,
    "held_out_documents": HELD_OUT_SQL,
}

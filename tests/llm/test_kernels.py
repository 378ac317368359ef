"""Python kernels of the corpus operators against plain versions."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placebook.llm import langid, linededup, media, minhash, packing, pii, sharding, tokencount

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    def ok(kind, s):
        digits = [int(c) for c in s if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
        if kind == "phone":
            return 10 <= len(digits) <= 15
        return True

    found = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in p.finditer(text) if ok(k, m[0])]
    return sorted(found, key=lambda x: (x[1], list(PLAIN).index(x[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ 0123459()_é\n", max_size=60) | st.from_regex(r"([a-c.]{0,3}@[a-c.]{0,6} ?){0,5}", fullmatch=True) | st.from_regex(r"(4111[ -]?1111[ -]?1111[ -]?1111|\+1 \(555\) 010-99[0-9]{2}|[0-9.]{1,20}| ){0,5}", fullmatch=True))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert [x[:3] for x in pii.find_spans(text) if x[0] in pii.BASE_KINDS] == plain_spans(text)


def test_checks_and_context():
    assert [x[0] for x in pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32 ok")] == ["iban"]
    assert pii.find_spans("GB83 WEST 1234 5698 7654 32") == []
    assert pii.find_spans("number 123-45-6789") == [] and pii.find_spans("ssn 123-45-6789")[0][0] == "ssn"
    assert pii.redact("write a@b.co now", pii.find_spans("write a@b.co now")) == "write [email] now"


def test_context_after_the_span():
    for text in ("123-45-6789 is my social security number", "123-45-6789 (SSN)"):
        assert [x[:3] for x in pii.find_spans(text)] == [("ssn", 0, 11)]
    assert pii.find_spans("123-45-6789" + " " * (pii.CONTEXT - 3) + "ssn")[0][0] == "ssn"
    assert pii.find_spans("123-45-6789" + " " * (pii.CONTEXT - 2) + "ssn") == [] and pii.find_spans("123-45-6789" + " " * (pii.CONTEXT - 3) + "ssnx") == []


def test_ibans_beside_upper_case_words_and_numbers():
    for text in (
        "IBAN [DE89 3704 0044 0532 0130 00] BIC COBADEFFXXX", "[DE89370400440532013000] BIC: COBADEFF", "pay [DE89370400440532013000] 2024 now", "[FR14 2004 1010 0505 0001 3M02 606] EUR 500",
        "REF AB12 [DE89 3704 0044 0532 0130 00] OK", "[DE89 3704 0044 0532 0130 00] [GB82 WEST 1234 5698 7654 32]", "THE ACCOUNT IS [NO93 8601 1117 947] AND IT IS A VERY LONG LINE IN UPPER CASE",
    ):
        plain = text.replace("[", "").replace("]", "")
        got = [plain[s:e] for k, s, e, _ in pii.find_spans(plain) if k == "iban"]
        assert got == [x.split("]")[0] for x in text.split("[")[1:]], text
    for text in ("DE89370400440532013000X", "DE89 3704 0044 0532 0130 01 BIC COBADEFFXXX"):
        assert not any(x[0] == "iban" for x in pii.find_spans(text))


def test_long_runs_stay_linear():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "1." * 50_000, "+1" * 50_000):
        pii.find_spans(text)


@given(st.binary(max_size=500))
def test_media_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(data)
    assert media.decode_png(media.encode_png(payload)).tobytes() == payload


def test_damaged_media_are_found():
    png = bytearray(media.encode_png(media.padded(b"text")))
    png[45] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(png))


def test_pages_keep_order_and_captions():
    html = '<p>a<p>b &amp; c<figure><img src="media:1" alt="x"><img src="u"><figcaption>both</figcaption></figure><script>no</script>d<img src="media:2" alt="y">'
    assert media.parse_page(html) == [["text", "a", None, None], ["text", "b & c", None, None], ["image", None, "media:1", "both"], ["image", None, "u", "both"], ["text", "d", None, None], ["image", None, "media:2", "y"]]
    assert media.parse_page(None) == [] and media.parse_page("") == []


def test_pages_lose_no_text():
    first = '<figure><figcaption>both</figcaption><img src="media:1"><img src="media:2" alt="x"></figure>after'
    assert media.parse_page(first) == [["image", None, "media:1", "both"], ["image", None, "media:2", "both"], ["text", "after", None, None]]
    for head in ("<head><title>t</title><meta charset=utf-8><script>no</script>", "<html><head><title>t</title><body>", "<head><title>t</title></head>"):
        assert media.parse_page(f"{head}<p>a</p>b") == [["text", "a", None, None], ["text", "b", None, None]]
    assert media.parse_page("<head><title>t</title>a <b>b</b>") == [["text", "a b", None, None]]
    assert media.parse_page('<figure><img src="u"><figcaption>c</figure><p>d</p>') == [["image", None, "u", "c"], ["text", "d", None, None]]
    assert media.parse_page('<p>a</p><figure><img src="u"><figcaption>c') == [["text", "a", None, None], ["image", None, "u", "c"]]
    assert media.parse_page("<figure><figcaption>c</figcaption><pre>code</pre></figure>") == [["text", "c", None, None], ["text", "code", None, None]]
    assert media.parse_page('<figcaption>c</figcaption><p>d</p>') == [["text", "c", None, None], ["text", "d", None, None]]


@given(st.text(alphabet="ab .!?\n\0", max_size=40))
def test_lines_join_to_the_text(text):
    assert "".join(linededup.lines(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 40))
def test_windows_select_their_last_smallest(order, size):
    got = linededup.selected(np.array(order, np.uint64), size) if size <= len(order) else []
    assert list(got) == [max(k for k in range(i, i + size) if order[k] == min(order[i : i + size])) for i in range(len(order) - size + 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b\u3000c d e".split()), max_size=80).map(" ".join), min_size=1, max_size=5), st.integers(1, 30))
def test_runs_of_texts_together_are_those_of_each(texts, least):
    run_hash = linededup.RunHashes()
    hashes, bounds = linededup.hashed(texts, run_hash)
    grams, first, picks = linededup.chosen(hashes, bounds, least, run_hash)
    plain = [t.split() for t in texts]
    assert list(np.diff(bounds)) == [len(w) for w in plain]
    assert [int(i) for i in first] == [int(bounds[t]) + i for t, w in enumerate(plain) for i in range(len(w) - least + 1)]
    at = {int(bounds[t]) + i: (t, i) for t, w in enumerate(plain) for i in range(len(w))}
    size, same, runs = min(linededup.GRAM, least), {}, {}
    for i, p in zip(first.tolist(), picks.tolist(), strict=True):
        t, k = at[i]
        assert k <= p - i + k <= k + least - size
        # equal windows select equal places and have equal hashes, unlike ones unlike hashes
        assert same.setdefault(tuple(plain[t][k : k + least]), p - i) == p - i
        assert runs.setdefault(tuple(plain[t][k : k + least]), int(run_hash(hashes, np.array([i]), np.array([i + least]))[0])) == int(run_hash(hashes, np.array([i]), np.array([i + least]))[0])
    assert len(set(runs.values())) == len(runs)


def test_confirmed_cuts_only_words_that_are_equal():
    here = [f"w{n}" for n in range(200)]
    there = [*["x"] * 40, *here[10:150]]
    there[40 + 60] = "other"

    def pieces(first, end, lead):
        size = linededup.SEGMENT
        return [(first, end, lead, 1, n, " ".join(there[n * size : (n + 1) * size])) for n in range((lead + end - first - 1) // size, lead // size - 1, -1)]

    assert linededup.confirmed(here, pieces(10, 70, 40), 50) == [(10, 70)]
    assert linededup.confirmed(here, pieces(10, 150, 40), 50) == [(10, 70), (71, 150)]
    assert linededup.confirmed(here, pieces(10, 110, 40), 50) == [(10, 70)]
    assert linededup.confirmed(here, pieces(11, 100, 40), 50) == []


def plain_without(text, cuts):
    units, gone, line, touched, kept = linededup.lines(text), set(), 0, set(), []
    for first, end in cuts:
        gone.update(range(first, end))
    for n, unit in enumerate(units):
        if n in gone:
            touched.add(line)
        else:
            kept.append(unit)
        line += re.search(r"\n|[.!?]\x20", unit) is not None
    return "".join(kept), len(touched), len(gone)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .!?\n\u3000é", min_size=1, max_size=60).filter(lambda t: t.strip()), st.data())
def test_cut_texts_are_those_of_the_plain_loop(text, data):
    n = len(text.split())
    cuts = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(1, 9)).map(lambda x: (x[0], min(n, x[0] + x[1]))), min_size=1, max_size=4))
    assert linededup.without(text, cuts) == plain_without(text, cuts)


def test_candidates_are_all_near_pairs_once():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 150, dtype=np.uint64)
    sets = []
    for _ in range(40):
        s = base.copy()
        k = rng.integers(0, 30)
        s[:k] = rng.integers(0, 1 << 62, k, dtype=np.uint64)
        sets.append(np.unique(s))
    a, b = minhash.permutations(minhash.WIDTH, minhash.SEED)
    c, d = minhash.permutations(minhash.FINE, minhash.SEED + 1)
    sig = np.frombuffer(b"".join(minhash.signature(s, a, b) for s in sets), np.uint8).reshape(40, -1)
    fine = np.array([minhash.bits(s, c, d) for s in sets])
    keys = minhash.keys_of(sig)
    chunks = np.zeros((40, minhash.CHUNKS), np.int64)
    for k in range(minhash.SYMBOLS):
        chunks = (chunks << 8) | sig.reshape(40, minhash.CHUNKS, minhash.SYMBOLS).astype(np.int64)[:, :, k]
    rows = sorted((int(keys[i, j]), i) for i in range(40) for j in range(minhash.WIDTH))
    r = [x[1] for x in rows]
    zero = [0] * len(rows)
    t = pa.table({"key": [x[0] for x in rows], "i": zero, "j": zero, "b": zero, "rep": r, "comp": r, "n": [150] * len(rows), "top": [300] * len(rows), "chunks": pa.array(chunks[r].tolist()), "fine": pa.array(fine[r].tolist())})
    x, y = minhash.near_pairs(t, 120)
    got = sorted((min(r[p], r[q]), max(r[p], r[q])) for p, q in zip(x, y, strict=True))
    unlike = lambda i, j: int((sig[i] != sig[j]).sum())
    far = lambda i, j: sum(bin(int(u) & (2**64 - 1)).count("1") for u in fine[i] ^ fine[j])
    expected = sorted((i, j) for j in range(40) for i in range(j) if far(i, j) <= 120 and set(keys[i]) & set(keys[j]))
    assert got == expected
    assert all(set(keys[i]) & set(keys[j]) for j in range(40) for i in range(j) if unlike(i, j) <= minhash.GUARANTEED)


def test_matrix_sums_and_distribution():
    m = sharding.communication_matrix([5, 0, 13, 22], [20, 20], seed=1)
    assert m.sum(axis=1).tolist() == [5, 0, 13, 22] and m.sum(axis=0).tolist() == [20, 20]
    rng = np.random.default_rng(0)
    drawn = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(drawn.mean() - 6) < 0.15 and abs(drawn.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.4
    assert 0 <= sharding.hypergeometric(rng, 4 * 10**10, 6 * 10**10, 10**9) <= 10**9


TEXTS = ["", "a  b\n\n c\t d 's it's  \n", "foo<|endoftext|>bar", "x\x1cy \x85 z　w​q", "1 2  3\r\n 4", "naïve ok don't WE'LL 12ab!!", "日本語 テスト 한국어"]


def test_chunks_encode_as_the_tokenizer_does():
    e = packing.ChunkEncoder(packing.tokenizer_path())
    for text in TEXTS:
        assert e.encode([text])[0] == e.pack(e.whole.encode(text, add_special_tokens=False).ids), text


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_plans_use_up_the_histogram(histogram):
    plan = packing.plan_bins(histogram, 50)
    used = {}
    for bin_, times in plan:
        assert sum(bin_) <= 50
        for n in bin_:
            used[n] = used.get(n, 0) + times
    assert used == histogram


def test_two_small_ones_replace_the_smallest():
    # greedy: 6 + 3 leaves a gap of 1; 2 + 2 in place of 3 fills the bin
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)


def test_cuts():
    assert packing.cut(1, 8) == [(0, 1)] and packing.cut(16, 8) == [(0, 8), (8, 8)] and packing.cut(17, 8) == [(0, 1), (1, 8), (9, 8)]


def test_kneser_ney_sums_to_one():
    text = "the cat sat on the mat and the dog ate the cat " * 3
    model = langid.fit(*np.unique(langid.grams(langid.letters(text)), return_counts=True))
    for order in range(1, langid.ORDER + 1):
        for context in model.contexts[order - 1][:3]:
            codes = (np.uint64(context) << np.uint64(16)) | np.arange(1 << 16, dtype=np.uint64)
            assert abs(np.exp(model.log_prob(codes, order)).sum() - 1) < 1e-9


def test_letters():
    assert "".join(map(chr, langid.letters("Ab, 12 ÉC!"))) == " ab éc "
    assert "".join(map(chr, langid.letters("E\u0301te\u0301"))) == " été "
    assert len(langid.letters("12 %%")) == 0 and len(langid.letters("")) == 0


def plain_best(text, scores, byte_score):
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        options = [(best[i][0] + scores[text[i:end]], best[i][1] + 1) for i in range(end) if text[i:end] in scores]
        if text[end - 1] not in scores:
            n = len(text[end - 1].encode())
            options.append((best[end - 1][0] + n * byte_score, best[end - 1][1] + n))
        top = max(s for s, _ in options)
        best.append((top, min(n for s, n in options if s == top)))
    return best[-1]


def test_trie_counts_as_the_plain_recursion():
    rng = random.Random(3)
    scores = {c: -3.0 for c in "▁abc"} | {"".join(rng.choices("▁abc", k=rng.randint(2, 5))): -rng.random() * 8 for _ in range(60)}
    trie = tokencount.Trie(scores, -20.0)
    for _ in range(300):
        word = "".join(rng.choices("abcé", k=rng.randint(1, 9)))
        score, tokens = plain_best("▁" + word, scores, -20.0)
        got = trie.insert(word)
        assert math.isclose(got[1], score) and got[0] == tokens
    assert trie.count("") == (0, 0, 0, 0) and trie.count("ab ab c")[1:3] == (3, 2)


def test_crc_of_pieces_is_that_of_the_ids():
    e = packing.ChunkEncoder(packing.tokenizer_path())
    ids = e.encode(["hello world"])[0] + b"\0\0\0\0"
    assert zlib.crc32(ids) == zlib.crc32(np.array([*e.whole.encode("hello world", add_special_tokens=False).ids, 0], "<u4").tobytes())

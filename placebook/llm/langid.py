"""Language ID: interpolated Kneser-Ney character models, one for each language, in sorted arrays."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_batches
from .common import discard, stored

ORDER = 4
BITS = 16
SPACE = 32
#: Characters that an unseen one is one of, for the lowest order.
ALPHABET = 65_536
#: Documents and characters of each language that the models are fitted on, on average: a bounded sample.
FIT_DOCS, FIT_CHARS = 800, 4_000_000
UNKNOWN = "und"
#: Score: how many characters count as evidence.
EVIDENCE = 200
#: How often a text whose expected cost is just there may be rejected by the chance of its few letters.
REJECT_RATE = 1e-6
#: Letters that a document needs to calibrate with.
CHECK_LETTERS = 20


def letter_table() -> np.ndarray:
    """For each code unit below 65536: its lower-case letter, or the space if it isn't a letter."""
    out = np.full(1 << BITS, SPACE, np.uint64)
    for i in range(1 << BITS):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and ord(low) < 1 << BITS else i
    return out


_TABLE: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """The text's letters in lower case, other runs as one space, a space at both ends; empty without letters.

    Accents that stand apart are put on their letters first (NFC).
    """
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if not _TABLE:
        _TABLE.append(letter_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    high = points >= 1 << BITS
    if high.any():  # rare scripts: letters share the last place of the table
        alpha = np.array([chr(p).isalpha() for p in points[high]], bool)
        points = points.copy()
        points[high] = np.where(alpha, 0xFFFD, SPACE)
        found = _TABLE[0][points]
        found[points == 0xFFFD] = 0xFFFD
    else:
        found = _TABLE[0][points]
    space = found == SPACE
    if space.all():
        return found[:0]
    keep = ~space
    keep[1:] |= ~space[:-1]
    found = found[keep]
    edges = np.array([SPACE], np.uint64)
    found = found[1:] if found[0] == SPACE else found
    return np.concatenate([edges, found] if found[-1] == SPACE else [edges, found, edges])


def grams(units: np.ndarray) -> np.ndarray:
    """All windows of ORDER characters, packed into 64 bits; the first character is the highest.

    Two more spaces before the text give its first characters a context.
    """
    if not len(units):
        return units
    run = np.concatenate([np.full(ORDER - 2, SPACE, np.uint64), units])
    n = len(run) - ORDER + 1
    code = np.zeros(n, np.uint64)
    for k in range(ORDER):
        code = (code << np.uint64(BITS)) | run[k : k + n]
    return code


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed windows of the text and how often each occurs."""
    return np.unique(grams(letters(text or "")), return_counts=True)


@dataclass
class CharModel:
    """Log probabilities of all seen n-grams of each order, and the back-off of seen contexts.

    keys[n] and contexts[n] are sorted; logs[n] and backoffs[n] belong to them.
    """

    keys: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoffs: list[np.ndarray] = field(default_factory=list)
    unseen: float = 0.0

    def log_prob(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log of the probability of each code's last character after the ones before it."""
        if order == 0:
            return np.full(len(codes), self.unseen)
        keys, n = self.keys[order - 1], len(codes)
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        out = self.logs[order - 1][at]
        missing = np.flatnonzero(keys[at] != codes)
        if len(missing):
            rest = codes[missing]
            heads = rest >> np.uint64(BITS)
            contexts = self.contexts[order - 1]
            where = np.minimum(np.searchsorted(contexts, heads), len(contexts) - 1)
            back = np.where(contexts[where] == heads, self.backoffs[order - 1][where], 0.0)
            low = rest & np.uint64((1 << BITS * (order - 1)) - 1) if order > 1 else rest
            out = out.copy() if n else out
            out[missing] = back + self.log_prob(low, order - 1)
        return out


def fit(codes: np.ndarray, counts: np.ndarray) -> CharModel:
    """Interpolated Kneser-Ney from the counts of the highest order.

    Lower orders count in how many contexts an n-gram occurs. One discount for each
    order: n1 / (n1 + 2 n2).
    """
    order = np.argsort(codes)
    tables = [(codes[order].astype(np.uint64), counts[order].astype(np.float64))]
    for n in range(ORDER - 1, 0, -1):
        tail = tables[-1][0] & np.uint64((1 << BITS * n) - 1)
        keys, kinds = np.unique(tail, return_counts=True)
        tables.append((keys, kinds.astype(np.float64)))
    model = CharModel()
    for n, (keys, c) in enumerate(reversed(tables), 1):
        ones, twos = np.sum(c == 1), np.sum(c == 2)
        discount = min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5
        heads = keys >> np.uint64(BITS) if n > 1 else np.zeros(len(keys), np.uint64)
        contexts, first, kinds = np.unique(heads, return_index=True, return_counts=True)
        totals = np.add.reduceat(c, first)
        left = discount * kinds / totals
        which = np.repeat(np.arange(len(contexts)), kinds)
        lower = np.exp(model.log_prob(keys & np.uint64((1 << BITS * (n - 1)) - 1), n - 1)) if n > 1 else 1 / ALPHABET
        p = np.maximum(c - discount, 0) / totals[which] + left[which] * lower
        if n == 1:
            model.unseen = float(np.log(left[0] / ALPHABET))
            left = np.ones(1)  # unseen has the whole share already
        model.keys.append(keys)
        model.logs.append(np.log(p))
        model.contexts.append(contexts)
        model.backoffs.append(np.log(left))
    return model


@dataclass
class Limit:
    """From a language's calibrating documents: when the cost of a text of n letters is too high."""

    mean: float = np.inf  # of the documents' cross-entropies
    between: float = 0.0  # variance of documents beyond that of their letters
    letter: float = 0.0  # variance of one letter's cost
    worst: float = 0.0  # how many standard deviations over the mean the worst document is
    floor: float = 0.0  # the most that an even mixture costs, of two known languages or of the language and letters in no order

    def at(self, n: int) -> float:
        chance = NormalDist().inv_cdf(1 - REJECT_RATE) * (self.letter / n) ** 0.5
        return max(self.mean + self.worst * (self.between + self.letter / n) ** 0.5, self.floor + chance)


def mixture_cost(means: np.ndarray) -> float:
    """The most that a text, half in one and half in another known language, costs in its best model; means[a, m] is the cost of language a in model m."""
    known = means[~np.isnan(means).any(axis=1)]
    return max((float(((row + known) / 2).min(axis=1).max()) for row in known), default=0.0)


def scrambled(units: np.ndarray) -> np.ndarray:
    """The same letters and spaces in no order; equal texts are scrambled alike."""
    return np.random.default_rng(len(units)).permutation(units)


def calibrated(rows: list[tuple[int, float, float, float]], floor: float) -> Limit:
    """The limit from (letters, cost, variance of a letter's cost, cost of the scrambled text) of the language's documents.

    A text stays whose cost is that of a mixture, half of which is in the language; without
    documents nothing is rejected.
    """
    if not rows:
        return Limit()
    n, cost, letter, noise = (np.array(x, float) for x in zip(*rows, strict=True))
    mean, own = float(cost.mean()), float(letter.mean())
    between = max(0.0, float(cost.var(ddof=1)) - own * float((1 / n).mean())) if len(n) > 1 else 0.0
    worst = float(((cost - mean) / np.sqrt(between + own / n + 1e-12)).max())
    return Limit(mean, between, own, max(worst, 0.0), max(floor, (mean + float(noise.mean())) / 2))


@dataclass
class Identifier:
    langs: list[str]
    models: list[CharModel]
    limits: list[Limit] = field(default_factory=list)
    #: Languages that no document has a letter of; they are never predicted.
    without: list[str] = field(default_factory=list)

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character in nats, texts x languages, and the numbers of characters."""
        found = [counted(t) for t in texts]
        sizes = np.array([int(n.sum()) for _, n in found])
        out = np.zeros((len(texts), len(self.langs)))
        if sizes.sum() and self.models:
            every = np.unique(np.concatenate([u for u, _ in found]))
            logs = np.stack([m.log_prob(every) for m in self.models], axis=1)
            for i, (u, n) in enumerate(found):
                if len(u):
                    out[i] = -(n @ logs[np.searchsorted(every, u)]) / sizes[i]
        return out, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None], list[bool]]:
        """Language, score in 0..1, cross-entropy, and whether it is too high for the language."""
        costs, sizes = self.costs(texts)
        langs, scores, heights, rejected = [], [], [], []
        for cost, n in zip(costs, sizes.tolist(), strict=True):
            if not n or not self.langs:
                langs.append(UNKNOWN), scores.append(0.0), heights.append(None), rejected.append(True)
                continue
            best = int(cost.argmin())
            odds = np.exp(-(cost - cost[best]) * min(n, EVIDENCE))
            langs.append(self.langs[best])
            scores.append(float(1 / odds.sum()))
            heights.append(float(cost[best]))
            rejected.append(bool(self.limits) and bool(cost[best] > self.limits[best].at(n)))
        return langs, scores, heights, rejected


def train(
    df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, seed: int = 5
) -> Identifier:
    """Fit on the rows where ``usable`` holds and that have a language and a text.

    ``fit_docs`` documents and ``fit_chars`` characters of each language on average, whole
    texts, are drawn by a hash of the ids, at a rate from the language's totals; a fifth of
    them only calibrates the rejection, but never the one with the smallest hash, so that
    every language has a document to fit on. Rows with equal ids are drawn alike. The
    windows are counted by executors; what comes to the driver is the counts of distinct
    windows of this bounded sample, three numbers for each calibrating document and rows for
    each language (and two). Without usable rows there are no models. Other columns are
    ignored.
    """
    known = df.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.withColumn("draw", F.xxhash64(F.lit(seed), "id"))
    per = {r["lang"]: r for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.min("draw").alias("first")).collect()}
    if not per:
        return Identifier([], [])
    langs = sorted(per)
    by_lang = lambda value: F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, value(per[lang]))]), F.col("lang"))
    rate = by_lang(lambda r: min(1.0, fit_docs / r["n"], fit_chars / max(r["chars"], 1)))
    first = F.col("draw") == by_lang(lambda r: r["first"])
    sample = known.filter((F.pmod("draw", F.lit(1_000_000)) / 1_000_000.0 < rate) | first)
    sample = sample.withColumn("check", ~first & (F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(5)) == 0)).drop("draw")

    def counting():
        def apply(batch):
            by: dict[str, list] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(letters(text)))
            out = {"lang": [], "code": [], "n": []}
            for lang, runs in by.items():
                codes, n = np.unique(np.concatenate(runs), return_counts=True)
                out["lang"] += [lang] * len(codes)
                out["code"] += codes.view(np.int64).tolist()
                out["n"] += n.tolist()
            return out

        return apply

    counts = map_batches(sample.filter("not check").select("text", "lang"), "lang string, code bigint, n bigint", counting)
    table = counts.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    models = []
    for lang in langs:
        own = table[table["lang"] == lang]
        if len(own):
            models.append((lang, fit(own["code"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy())))
    found = Identifier([lang for lang, _ in models], [m for _, m in models])
    found.without = sorted(set(langs) - set(found.langs))
    if not found.langs:
        return found
    shared = df.sparkSession.sparkContext.broadcast(found)

    def heights():
        who = shared.value

        def apply(batch):
            out = {k: [] for k in ("lang", "model", "n", "cost", "letter", "noise")}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                codes, n = counted(text)
                mixed, letters_ = grams(scrambled(letters(text))), int(n.sum())
                if letters_ < CHECK_LETTERS:
                    continue
                for model, scorer in zip(who.langs, who.models, strict=True):
                    logs = scorer.log_prob(codes)
                    cost = -float(n @ logs) / letters_
                    noise = -float(scorer.log_prob(mixed).mean()) if model == lang else None
                    for k, v in zip(out, (lang, model, letters_, cost, float(n @ (logs + cost) ** 2) / letters_, noise), strict=True):
                        out[k].append(v)
            return out

        return apply

    checks = stored(map_batches(sample.filter("check").select("text", "lang"), "lang string, model string, n bigint, cost double, letter double, noise double", heights), "checks")
    own: dict[str, list] = {}
    for r in checks.filter("lang = model").select("lang", "n", "cost", "letter", "noise").collect():  # fit_docs / 5 a language on average
        own.setdefault(r["lang"], []).append((r["n"], r["cost"], r["letter"], r["noise"]))
    means = np.full((len(found.langs),) * 2, np.nan)
    for r in checks.groupBy("lang", "model").agg(F.avg("cost").alias("cost")).collect():  # a row for two languages
        if r["lang"] in found.langs:
            means[found.langs.index(r["lang"]), found.langs.index(r["model"])] = r["cost"]
    discard(checks)
    floor = mixture_cost(means)
    found.limits = [calibrated(own.get(lang, []), floor) for lang in found.langs]
    return found


def identify(df: DataFrame, who: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df`` plus lang_pred, score, cross_entropy and rejected.

    Whole texts; the language with the lowest cross-entropy per character. Null texts and
    texts without a letter get "und", score 0 and are rejected; others are rejected if
    their cross-entropy is above the limit that the language's calibrating documents give
    for so many letters. Existing columns of these names are replaced. Rows don't meet:
    repeated ids and rows are judged each on its own, and an empty table gives no rows. The models are broadcast: their size is bounded
    by the sample that they are fitted on.
    """
    df = df.drop("lang_pred", "score", "cross_entropy", "rejected")
    shared = df.sparkSession.sparkContext.broadcast(who)
    kinds = T.StructType([*df.schema.fields, *T._parse_datatype_string("lang_pred string, score double, cross_entropy double, rejected boolean").fields])

    def make():
        found = shared.value

        def apply(batch):
            langs, scores, heights, rejected = found.predict(batch.column(text_col).to_pylist())
            return dict(zip(batch.schema.names, batch.columns, strict=True)) | {"lang_pred": langs, "score": scores, "cross_entropy": heights, "rejected": rejected}

        return apply

    return map_batches(df, kinds, make)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is held out of the learning; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))

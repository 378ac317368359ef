"""Interleaved document sequences: parsed pages, media references, payloads resolved by digest."""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .common import discard, free_name, stored

WIDTH = 64
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
#: Elements that end a run of text, those whose text is left out, and those that refer to media.
BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th title tr ul".split())
SILENT = frozenset("script style noscript template".split())
#: Elements that a head may have; any other ends it.
HEAD = frozenset("base head html link meta noscript script style template title".split())
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": None, "embed": "embed"}
PREFIX = "media:"


class PageParser(HTMLParser):
    """Items of a page in reading order: [kind, text, src, caption]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.silent = 0
        self.head = self.title = False  # whether they are open
        self.figures: list[tuple[list, list, list]] = []  # for each open figure: its media items, its captions and the places of these
        self.caption: list[str] | None = None
        self.outer: list[str] = []  # kinds of open video and audio elements

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append(["text", text, None, None])

    def end_caption(self) -> None:
        """Keep the text of an open caption for its figure; without a figure it is the last item's."""
        text = " ".join("".join(self.caption or []).split())
        self.caption = None
        if not text:
            return
        if self.figures:
            _, captions, places = self.figures[-1]
            captions.append(text)
            places.append(len(self.items))
        elif self.items and self.items[-1][0] != "text":
            self.items[-1][3] = text
        else:
            self.items.append(["text", text, None, None])

    def end_figure(self) -> None:
        """Give the captions to all media of the figure; without media they are text where they stood."""
        self.end_caption()
        found, captions, places = self.figures.pop()
        for item in found:
            if captions:
                item[3] = " ".join(captions)
        if not found:
            for at, text in reversed(list(zip(places, captions, strict=True))):
                self.items.insert(at, ["text", text, None, None])

    def end(self) -> None:
        """The end of the page ends all that is open."""
        self.flush()
        while self.figures:
            self.end_figure()
        self.end_caption()

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.head = True
        elif tag not in HEAD and (tag == "body" or not self.silent):
            self.head = self.title = False
        elif tag == "title":
            self.title = True
        if tag in SILENT:
            self.silent += 1
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figures.append(([], [], []))
        elif tag == "figcaption":
            self.end_caption()
            self.caption = []
        if tag in MEDIA:
            given = dict(attrs)
            kind = MEDIA[tag] or (self.outer[-1] if self.outer else "image")
            if tag in ("video", "audio"):
                self.outer.append(kind)
            if given.get("src"):
                self.flush()
                item = [kind, None, given["src"], given.get("alt") or given.get("title")]
                self.items.append(item)
                if self.figures:
                    self.figures[-1][0].append(item)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in ("img", "source", "embed"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = False
        if tag in ("head", "title"):
            self.title = False
        if tag in SILENT and self.silent:
            self.silent -= 1
        if tag in ("video", "audio") and self.outer:
            self.outer.pop()
        if tag == "figcaption" and self.caption is not None:
            self.end_caption()
        elif tag in BLOCKS:
            self.flush()
        if tag == "figure" and self.figures:
            self.end_figure()

    def handle_data(self, data):
        if self.head and not self.title and not self.silent and data.strip():
            self.head = False
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent and not self.head:
            self.text.append(data)


def parse_page(html: str | None) -> list[list]:
    """[kind, text, src, caption] in reading order; a figure's caption goes to each of its media, wherever in the figure it stands."""
    parser = PageParser()
    parser.feed(html or "")
    parser.close()
    parser.end()
    return parser.items


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, position, kind, text, src, digest, caption): the items of every page.

    ``position`` counts from 0 in each page. A src of the form media:<digest> gives the
    digest. Pages without items, null and empty ones give no rows; rows with equal ids
    are pages of their own.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)["id"]

    def make():
        def apply(batch):
            out = {k: [] for k in ("id", "position", "kind", "text", "src", "digest", "caption")}
            for key, html in zip(batch.column("id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for n, (what, text, src, caption) in enumerate(parse_page(html)):
                    digest = src.removeprefix(PREFIX) if src and src.startswith(PREFIX) else None
                    for k, v in zip(out, (key, n, what, text, src, digest, caption), strict=True):
                        out[k].append(v)
            return out

        return apply

    return map_batches(rows, f"id {kind}, position int, kind string, text string, src string, digest string, caption string", make).withColumnRenamed("id", id_col)


def resolve(items: DataFrame, store: DataFrame, digest_col: str = "digest") -> DataFrame:
    """The items with the columns of ``store`` that their digests name; null where none does.

    ``store`` has one row for each digest (of several all would be given). Items that refer to
    one very common payload are split by the engine's skew join: they are the streamed side.
    A column of the store that the items have already is left out; items without a digest
    and items that an empty store has nothing for stay, with nulls.
    """
    own = free_name(items, free_name(store, "_digest"))
    taken = {c.lower() for c in items.columns}
    key = store.select(F.col(digest_col).alias(own), *[c for c in store.columns if c.lower() not in taken])
    return items.join(key, items[digest_col] == F.col(own), "left").drop(own)


def sequences(items: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, items): a page's items as one array in the order of their positions.

    A page's items are one row, so they meet in one task, as its text did. Rows with equal
    ids are one page here. Null ids are one page; an empty table gives no rows.
    """
    fields = [c for c in items.columns if c not in (id_col, "position")]
    return items.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("position", *fields))).alias("items"))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    """Bytes 0 appended, up to a positive multiple of the width."""
    return data + bytes((-len(data)) % WIDTH if data else WIDTH)


def encode_png(payload: bytes) -> bytes:
    """A grey 8-bit picture with a sample for each byte, WIDTH samples a row; lossless."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(grid), WIDTH + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = grid
    head = struct.pack(">IIBBBBB", WIDTH, len(grid), 8, 0, 0, 0, 0)
    return PNG_HEAD + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples of a picture that encode_png made; raises ValueError for damaged ones."""
    if media[:8] != PNG_HEAD:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not a grey picture of 8-bit samples")
            shape = (height, WIDTH + 1)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return np.ascontiguousarray(lines[:, 1:])


def describe(grid: np.ndarray) -> str:
    """Features of the samples: mean, standard deviation, entropy in bits, share of zeros."""
    counts = np.bincount(grid.ravel(), minlength=256).astype(np.float64)
    share = counts / counts.sum()
    values = np.arange(256)
    mean = float((share * values).sum())
    spread = float(np.sqrt((share * (values - mean) ** 2).sum()))
    some = share[share > 0]
    entropy = max(0.0, float(-(some * np.log2(some)).sum()))
    return f"mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f};zeros={share[0]:.6f};rows={len(grid)}"


def pages_of_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, html, digest, media): each text as a page that refers to its payload by digest.

    The payload is the text in UTF-8, padded; ``digest`` is its SHA-256 and ``media`` the
    picture that stores it. Null counts as empty.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data"))
    kind = dict(rows.dtypes)["id"]

    def make():
        def apply(batch):
            ids, sizes, pages, digests, media = batch.column("id"), [], [], [], []
            for key, data in zip(ids.to_pylist(), batch.column("data").to_pylist(), strict=True):
                payload = padded(data or b"")
                digest = hashlib.sha256(payload).hexdigest()
                sizes.append(len(data or b""))
                digests.append(digest)
                media.append(encode_png(payload))
                pages.append(f'<article><p>Document {key}</p><figure><img src="{PREFIX}{digest}"><figcaption>{len(data or b"")} bytes</figcaption></figure></article>')
            return {"id": ids, "n_bytes": sizes, "html": pages, "digest": digests, "media": media}

        return apply

    return map_batches(rows, f"id {kind}, n_bytes bigint, html string, digest string, media binary", make).withColumnRenamed("id", id_col)


FEATURES = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_features(store: DataFrame) -> DataFrame:
    """Read the stored media back: (digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), a row for each digest.

    Every stored row is decoded and its samples must have the digest that it is stored
    under, else ValueError. Only the features are shuffled, never the media.
    """

    def make():
        def apply(batch):
            out = {k: [] for k in ("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
                grid = decode_png(media)
                payload = grid.tobytes()
                found = hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"stored media of {digest} hold {found}")
                row = (digest, len(payload), found, zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), describe(grid))
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            return out

        return apply

    read = map_batches(store.select("digest", "media"), FEATURES, make)
    return read.groupBy("digest").agg(*[F.min(c).alias(c) for c in read.columns if c != "digest"])


def media_store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The features of all payloads of the texts, a row for each digest, written."""
    table = stored(pages_of_texts(df, id_col, text_col), "media")
    features = stored(media_features(table), "features")
    discard(table)
    return features


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store all texts as media, read them back and resolve each page's reference.

    The media are written to the shared folder and read from there. A row for each input
    row: (id, n_bytes, position, caption, src, features...); rows with equal ids are rows
    of their own. Null texts are empty, other columns are ignored, and an empty table gives
    no rows.
    """
    table = stored(pages_of_texts(df, id_col, text_col), "media")
    items = interleave(table.select(id_col, "html"), id_col, "html").filter(F.col("digest").isNotNull())
    features = stored(media_features(table), "features")  # so that both sides of the join are plain exchanges
    found = resolve(items, features)
    # every page here has one medium; its caption tells the number of bytes before padding
    return found.withColumn("n_bytes", F.regexp_extract("caption", "^([0-9]+) bytes$", 1).cast("long"))

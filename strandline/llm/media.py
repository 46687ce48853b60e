"""Media columns: interleaved document sequences.

An HTML page becomes an ordered sequence of segments, texts and media references with their
captions, numbered by position. Payloads live in a store of their own, one row per digest, as 8-bit
greyscale PNGs; a digest join resolves the references, so that captions, positions and decoded media
stay aligned however often one payload is referred to.

The store is written to the shared folder and read back; payloads never move otherwise. Each task stores a payload once, as
far as its bounded memory of digests reaches, so that copies cost one row a task; what is read from
them is reduced to one row a digest. The join moves references and features only, and has a plain
scan on both sides, so that AQE can split a digest with a third of all references.

Edge cases: a null or empty text is a payload of 64 zero bytes; repeated rows and null ids each give a row;
a reference that the store lacks keeps its position and caption with null features; null pages have no segments; bytes that are no
UTF-8 are kept in a payload and replaced in its page; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

WIDTH = 64
SCHEME = "sha256:"
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SEEN_DIGESTS = 200_000
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption", "table", "tr", "td", "br", "section", "article", "blockquote", "ul", "ol"}
SILENT = {"script", "style", "title", "noscript", "template"}


def padded(text: bytes) -> bytes:
    """The payload of a text: zeros appended up to a positive multiple of the width."""
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def encode_png(payload: bytes) -> bytes:
    """Rows of ``WIDTH`` 8-bit grey samples, unfiltered."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit grey image, with all five row filters of the format."""
    if media[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, shape = 8, [], None
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not an 8-bit grey image")
            shape = height, width
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[0], shape[1] + 1)
    if not rows[:, 0].any():
        return rows[:, 1:]
    out, above = np.zeros(shape, np.uint8), np.zeros(shape[1], np.uint8)
    for i, (how, *line) in enumerate(rows.tolist()):
        out[i] = above = np.array(_unfilter(how, line, above.tolist()), np.uint8)
    return out


def _unfilter(how: int, line: list[int], above: list[int]) -> list[int]:
    out: list[int] = []
    for k, x in enumerate(line):
        left, up, corner = (out[k - 1], above[k], above[k - 1]) if k else (0, above[k], 0)
        guess = left + up - corner
        paeth = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
        out.append((x + (0, left, up, (left + up) // 2, paeth)[how]) & 255)
    return out


def feature(samples: np.ndarray) -> str:
    """Height, mean, deviation and an 8 x 8 average hash of the image."""
    flat = samples.astype(np.float64)
    columns = flat.reshape(len(flat), 8, WIDTH // 8).mean(axis=2)
    edges = np.linspace(0, len(flat), 9).astype(int)
    cells = np.array([columns[a : max(b, a + 1)].mean(axis=0) for a, b in zip(np.minimum(edges[:-1], len(flat) - 1), edges[1:], strict=True)])
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return f"h={len(flat)};mean={flat.mean():.4f};std={flat.std():.4f};hash={bits}"


class _Sequencer(HTMLParser):
    """Collects the segments of a page: (kind, text, ref, caption)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.segments: list[list] = []
        self.text: list[str] = []
        self.silent = 0
        self.figure: int | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.segments.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("img", "video", "audio", "source"):
            found = dict(attrs)
            self.flush()
            if found.get("src"):
                self.segments.append(["media", None, found["src"], found.get("alt")])
                if self.figure == -1:
                    self.figure = len(self.segments) - 1
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = -1

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            if self.figure is not None and self.figure >= 0:
                self.segments[self.figure][3] = caption
            elif caption:
                self.segments.append(["text", caption, None, None])
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse_page(page: str | None) -> list[tuple]:
    """The ordered segments (kind, text, ref, caption) of an HTML page.

    A ``noscript`` or ``template`` that is never closed hides all text after it, as one that is closed at the page's end would; media stay.
    """
    if not page:
        return []
    parser = _Sequencer()
    parser.feed(page)
    parser.close()
    if parser.caption:
        parser.text += parser.caption
    parser.flush()
    return [tuple(s) for s in parser.segments]


SEGMENT = "struct<position:int,kind:string,text:string,ref:string,caption:string>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
    for batch in batches:
        found = [[dict(position=i, kind=k, text=t, ref=r, caption=c) for i, (k, t, r, c) in enumerate(parse_page(x))] for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[batch.schema.names[0], "segments"])


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, segments): the interleaved sequence of every page."""
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(_parsed, f"`{id_col}` {kind}, segments array<{SEGMENT}>")


def page_of(text: str, ref: str) -> str:
    """A document as a page: its lines as paragraphs, with its payload as a captioned figure after the first one and as a described image at the end."""
    first, *rest = text.split("\n")
    paragraphs = "".join(f"<p>{html.escape(x, quote=False)}</p>" for x in rest)
    figure = f'<figure><img src="{ref}"><figcaption>{len(text)} characters</figcaption></figure>'
    return f'<p>{html.escape(first, quote=False)}</p>{figure}{paragraphs}<img src="{ref}" alt="{len(rest) + 1} lines">'


#: A segment without its text, which stays in the documents: the number of its characters instead.
PLACED = "struct<position:int,kind:string,chars:int,ref:string,caption:string>"


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text as bytes) -> (id, size, digest of the payload, the segments of the text's page)."""
    placed = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("chars", pa.int32()), ("ref", pa.string()), ("caption", pa.string())]))
    for batch in batches:
        sizes, digests, segments = [], [], []
        for raw in batch.column(1).to_pylist():
            digests.append(hashlib.sha256(padded(raw)).hexdigest())
            sizes.append(len(raw))
            found = parse_page(page_of(raw.decode(errors="replace"), SCHEME + digests[-1]))
            segments.append([dict(position=i, kind=k, chars=len(t or ""), ref=r, caption=c) for i, (k, t, r, c) in enumerate(found)])
        cols = pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(segments, placed)
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "n_bytes", "digest", "segments"])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text as bytes) -> (digest, media), once for each digest of a task as far as the bounded set of them reaches."""
    seen: set[bytes] = set()
    for batch in batches:
        digests, media = [], []
        for raw in batch.column(0).to_pylist():
            payload = padded(raw)
            digest = hashlib.sha256(payload)
            if digest.digest() in seen:
                continue
            if len(seen) >= SEEN_DIGESTS:
                seen.clear()
            seen.add(digest.digest())
            digests.append(digest.hexdigest())
            media.append(encode_png(payload))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in batch.column(1).to_pylist():
            samples = decode_png(media)
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()
        names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)


def store(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """(digest, media): the written store of the texts' payloads, at least one row a digest."""
    raw = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    return scratch.keep(raw.mapInArrow(_stored, "digest string, media binary"))


def resolve(references: DataFrame, media: DataFrame, scratch: Scratch) -> DataFrame:
    """Each reference (``digest``) with what its stored media holds; nulls if the store lacks it."""
    features = scratch.keep(media.mapInArrow(_read_back, FEATURES).dropDuplicates(["digest"]))
    return references.join(features, "digest", "left")


def interleaved(pages: DataFrame, media: DataFrame, scratch: Scratch, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, segments) of every page, each media segment with ``media_sha256`` and ``feature`` of its payload in the store; nulls if it lacks it.

    References travel to the store and come back by row and position, so that a page's segments stay in order.
    """
    rows = scratch.keep(sequences(pages, id_col, html_col).withColumn("row", F.monotonically_increasing_id()))  # written, so that the numbers stay
    each = rows.select("row", F.inline("segments")).filter(F.col("ref").startswith(SCHEME))
    found = resolve(each.select("row", "position", F.substring("ref", len(SCHEME) + 1, 64).alias("digest")), media, scratch)
    of_row = found.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct("media_sha256", "feature")))).alias("of"))  # a page's references at most
    joined = rows.join(of_row, "row", "left")
    at = lambda s, name: F.element_at("of", s["position"])[name].alias(name)
    own = lambda s: [s[c].alias(c) for c in ("position", "kind", "text", "ref", "caption")]
    return joined.select(id_col, F.transform("segments", lambda s: F.struct(*own(s), at(s, "media_sha256"), at(s, "feature"))).alias("segments"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    refs = raw.mapInArrow(_references, f"id {kind}, n_bytes long, digest string, segments array<{PLACED}>")
    scratch = Scratch(spark)
    found = resolve(refs, store(docs, scratch), scratch)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "segments")


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of ``pages`` as its ordered segments, media references resolved by digest in the store of the documents' payloads."""
    scratch = Scratch(spark)
    found = interleaved(table(spark, sf_dir, "pages").select("page_id", "html"), store(table(spark, sf_dir, "documents"), scratch), scratch)
    of_kind = lambda kind: F.size(F.filter("segments", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("page_id", of_kind("text"), of_kind("media"), "segments")

"""Secret scans with a recursive decoding worklist.

Each text is layer 0. A layer is scanned, then decoded: the whole layer with its percent escapes, and with its Unicode or hex
escapes, undone in place, so what crosses a blank or a line stays together; base64 runs, also those wrapped over single line
breaks; and what base64 gives, inflated if it is gzip, zlib, raw deflate, bz2, xz, lzma or zstandard, as often as that gives such bytes again. Bytes that are no UTF-8 become U+FFFD, control characters stay, and ASCII in
UTF-16 is a text too, so a bad byte hides nothing beside it. Each decoded text is a new layer on the worklist, with the place in the text of every one of its characters; a layer that this document has had already is not
entered again, which ends cycles. The worklist is empty at the fixpoint. A finding in a layer covers the span of the text
from which its characters come; a passage that was compressed can only be mapped as a whole.

Nulls: a null text is empty, a null doc_id is passed through. Empty texts have no spans, repeated rows keep a row each, an
empty table gives an empty result. Only doc_id and text are read, so other columns can't clash. Texts are scanned whole.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, batch, documents

#: The base patterns and the least length of what each must match (assign: of its value).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
LEAST = {"assign": 12, "access": 18, "hex": 16}
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")

#: Encoded passages: escapes, and runs of 16 base64 characters at least, in one line or over line breaks.
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"\\(?:u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]{1,6})\}|x([0-9a-fA-F]{2})|U([0-9a-fA-F]{8}))")
BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{16,}|[A-Za-z0-9_-]{16,})={0,2}")
PART = re.compile(r"[A-Za-z0-9]{16,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
#: What bytes need to hold a pattern or another encoded passage: so many printable ones in a row, as no pattern matches less.
STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{16}")
WIDE_LE, WIDE_BE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){16,}"), re.compile(rb"(?:\0[\t\n\r\x20-\x7e]){16,}")
ESCAPED = re.compile("[\udc80-\udcff]")
HIGH, LOW, PAST = 0xD800, 0xDC00, 0xE000  # surrogates
#: A compressed passage is inflated to its end in windows of so many bytes, each a layer that begins OVERLAP bytes before the end
#: of the one before; this bounds a task's memory. A pattern's match has its whole passage as its span, so a match that
#: crosses a border is found in the overlap; only encoded passages over OVERLAP bytes within may be cut there. `capped` counts
#: the windows after the first.
WINDOW, OVERLAP, PIECE = 1 << 22, 1 << 20, 1 << 18
#: Levels of compression are told apart by so many bytes at their beginning.
HEAD = 1 << 12
#: Compressed bytes are read so many at a time.
READ = 1 << 14
#: First bytes of the formats.
GZIP, BZIP, XZ, LZMA, ZSTD = b"\x1f\x8b", b"BZh", b"\xfd7zXZ\0", b"\x5d\0\0", b"\x28\xb5\x2f\xfd"
EMBEDDED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\0|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
DAMAGED = (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, zstandard.ZstdError)

SPANS = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_layers", pa.int32()), ("depth", pa.int32()), ("capped", pa.int32())])
DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers int, depth int, capped int"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns, in that order."""
    found = []
    lower = text.lower() if ":" in text or "=" in text else ""
    if any(k in lower for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text; character k comes from the characters at[k] to to[k] of the document. Layer 0 is the document: no arrays."""

    __slots__ = ("at", "depth", "text", "to")

    def __init__(self, text: str, at: np.ndarray | None, to: np.ndarray | None, depth: int):
        self.text, self.at, self.to, self.depth = text, at, to, depth

    def first(self, places: np.ndarray) -> np.ndarray:
        return places if self.at is None else self.at[places]

    def last(self, places: np.ndarray) -> np.ndarray:
        return places + 1 if self.to is None else self.to[places]


Found = tuple[str, np.ndarray, np.ndarray]


def _utf8(data: bytes) -> tuple[str, np.ndarray]:
    """Text of the bytes, U+FFFD for each that isn't UTF-8; where in them each character begins and the last one ends."""
    text = data.decode("utf-8", "surrogateescape")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    bad = (codes >= HIGH) & (codes < PAST)
    sizes[bad] = 1
    return ESCAPED.sub("\ufffd", text) if bad.any() else text, np.concatenate(([0], np.cumsum(sizes)))


def _wide(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Stretches of ASCII in UTF-16, of either byte order, as _utf8() gives them, with their own places of the bytes."""
    if b"\0" in data:
        for pattern, first in ((WIDE_LE, 0), (WIDE_BE, 1)):
            for m in pattern.finditer(data):
                yield m[0][first::2].decode("ascii"), np.arange(m.start(), m.end() + 1, 2)


def _replaced(layer: Layer, parts: Iterator[tuple[int, int, str, np.ndarray, np.ndarray]]) -> Found | None:
    """The whole layer with its parts (start, end, new text, place of each new character and of its end) decoded."""
    texts, at, to, k = [], [], [], 0
    for start, end, text, first, last in parts:
        plain = np.arange(k, start)
        texts += [layer.text[k:start], text]
        at += [layer.first(plain), layer.first(first)]
        to += [layer.last(plain), layer.last(last)]
        k = end
    if not k:
        return None
    rest = np.arange(k, len(layer.text))
    return "".join([*texts, layer.text[k:]]), np.concatenate([*at, layer.first(rest)]), np.concatenate([*to, layer.last(rest)])


def _percent(layer: Layer) -> Found | None:
    def parts():
        for m in PERCENT.finditer(layer.text):
            text, edges = _utf8(bytes.fromhex(m[0].replace("%", "")))
            yield m.start(), m.end(), text, m.start() + 3 * edges[:-1], m.start() + 3 * edges[1:] - 1

    return _replaced(layer, parts())


def _escapes(layer: Layer) -> Found | None:
    def parts():
        high = None  # the first half of a pair, which waits for the second
        for m in ESCAPES.finditer(layer.text):
            code, start = int(m[1] or m[2] or m[3] or m[4], 16), m.start()
            if high and high[1] == start and LOW <= code < PAST:
                code, start = 0x10000 + ((high[2] - HIGH) << 10) + code - LOW, high[0]
            elif high:
                yield high[0], high[1], "\ufffd", np.array([high[0]]), np.array([high[1] - 1])
            high = None
            if HIGH <= code < LOW:
                high = start, m.end(), code
            elif code <= 0x10FFFF:
                yield start, m.end(), "\ufffd" if HIGH <= code < PAST else chr(code), np.array([start]), np.array([m.end() - 1])
        if high:
            yield high[0], high[1], "\ufffd", np.array([high[0]]), np.array([high[1] - 1])

    return _replaced(layer, parts())


def _runs(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """What may be base64, with the places of its characters: each run, its parts, and runs joined over line breaks."""
    for m in BASE64.finditer(text):
        yield m[0], np.arange(m.start(), m.end())
        for p in PART.finditer(text, m.start(), m.end()):  # +, /, - or _ may stand between runs
            if p[0] != m[0].rstrip("="):
                yield p[0], np.arange(p.start(), p.end())
    for chain in _chains(text):
        for pieces in _wrapped(chain):
            if sum(z - a for a, z in pieces) >= 16:
                yield "".join(text[a:z] for a, z in pieces), np.concatenate([np.arange(a, z) for a, z in pieces])


def _chains(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs (start, end) of base64 characters that only a line break and blanks part; the first may begin and the last may
    end within a line."""
    now, at = [], 0
    for line in text.split("\n") if "\n" in text else ():
        body = line.strip(" \t\r")
        a = at + len(line) - len(line.lstrip(" \t\r"))
        at += len(line) + 1
        head = len(body) - len(body.lstrip(ALPHABET)) if now else 0
        if head:
            now.append((a, a + head))
        if not head or head < len(body):
            if len(now) > 1:
                yield now
            tail = len(body) - len(body.rstrip(ALPHABET))
            now = [(a + len(body) - tail, a + len(body))] if tail else []
    if len(now) > 1:
        yield now


def _wrapped(chain: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """The chain, and its lines of equal length with the shorter one that ends them: a word may stand on the line before."""
    yield chain
    sizes, i = [z - a for a, z in chain], 0
    while i < len(chain):
        j = i + 1
        while j < len(chain) and sizes[j] == sizes[i]:
            j += 1
        end = j + (j < len(chain) and sizes[j] < sizes[i])
        if 1 < end - i < len(chain):
            yield chain[i:end]
        i = j


def _deflated(chunks: Iterator[bytes], bits: int) -> Iterator[bytes]:
    one = zlib.decompressobj(bits)
    for data in chunks:
        while True:
            if one.eof:
                if bits != 31 or data[:1] != GZIP[:1]:  # gzip has members
                    return
                one = zlib.decompressobj(bits)
            got = one.decompress(data, PIECE)
            data = one.unused_data if one.eof else one.unconsumed_tail
            if got:
                yield got
            if not data and len(got) < PIECE:
                break


def _members(make, chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What bz2 and lzma give, member after member."""
    one = make()
    for data in chunks:
        while True:
            if one.eof:
                one = make()
            if got := one.decompress(data, PIECE):
                yield got
            data = one.unused_data if one.eof else b""
            if not data and (one.eof or one.needs_input):
                break


class _Source:
    """Chunks as something to read from."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def read(self, n: int) -> bytes:
        if not self.held:
            self.held = next(self.chunks, b"")
        got, self.held = self.held[:n], self.held[n:]
        return got


def _zstd(chunks: Iterator[bytes]) -> Iterator[bytes]:
    with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(_Source(chunks), read_across_frames=True) as f:
        while got := f.read(PIECE):
            yield got


def _format(head: bytes) -> Callable[[Iterator[bytes]], Iterator[bytes]] | None:
    """How bytes that begin so are inflated."""
    if head[:2] == GZIP:
        return partial(_deflated, bits=31)
    if head[:3] == BZIP:
        return partial(_members, bz2.BZ2Decompressor)
    if head[:6] == XZ or head[:3] == LZMA:
        return partial(_members, partial(lzma.LZMADecompressor, memlimit=1 << 28))
    if head[:4] == ZSTD:
        return _zstd
    if head[:1] == b"\x78" and len(head) > 5 and (head[0] << 8 | head[1]) % 31 == 0:
        return partial(_deflated, bits=15)
    return None


def _windows(stream: Iterator[bytes]) -> Iterator[bytes]:
    """All that a stream gives, up to where it is damaged, in windows that overlap."""
    held, n = bytearray(), 0
    try:
        for got in stream:
            held += got
            while len(held) > WINDOW:
                yield bytes(held[:WINDOW])
                del held[: WINDOW - OVERLAP]
                n += 1
    except DAMAGED:
        pass
    if held and (not n or len(held) > OVERLAP):
        yield bytes(held)


class _Chunks:
    """Bytes from a place on, a few at a time; `at` is how far they were read."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = memoryview(data), at

    def __iter__(self) -> Iterator[bytes]:
        while self.at < len(self.data):
            got = bytes(self.data[self.at : self.at + READ])
            self.at += READ
            yield got


def _starts(data: bytes, bare: bool) -> Iterator[tuple[int, Callable]]:
    """Where a compressed stream may begin: at the first byte, of any format (bare: without a header too), and wherever the
    first bytes of one stand."""
    if make := _format(data[:HEAD]) or (partial(_deflated, bits=-15) if bare else None):
        yield 0, make
    for m in EMBEDDED.finditer(data, 1):
        yield m.start(), _format(data[m.start() : m.start() + 16])


def _inflated(data: bytes, bare: bool) -> Iterator[tuple[bytes, bool]]:
    """Windows of what some bytes give if they are compressed, and of what that gives if it is compressed again, and so on;
    True for windows after the first. Each level is streamed from the bytes anew, so memory holds a window and not a level.
    A level that begins like one before ends it: nothing new can come."""
    done = 0
    for start, make in _starts(data, bare):
        if start < done:
            continue
        chain, seen = [], {data[start : start + HEAD]}
        while make:
            chain.append(make)
            chunks = _Chunks(data, start)
            stream: Iterator[bytes] = iter(chunks)
            for step in chain:
                stream = step(stream)
            head = b""
            for k, window in enumerate(_windows(stream)):
                head = head or window[:HEAD]
                yield window, k > 0
            if head and len(chain) == 1 and _format(data[start : start + HEAD]):
                done = chunks.at - READ  # what stands within the stream isn't looked at as another one
            make = None if not head or head in seen else _format(head)
            seen.add(head)


def _texts(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """The texts in some bytes: as UTF-8, and the stretches in UTF-16. None where no stretch is long enough for a pattern."""
    if STRETCH.search(data):
        yield _utf8(data)
    yield from _wide(data)


def _base64(layer: Layer, run: str, places: np.ndarray) -> Iterator[tuple[Found, bool]]:
    """What a run of base64 characters at these places gives, and whether it is a window after the first. A word may stand
    before it without a blank, so all four places where its groups can begin are tried."""
    whole = run.rstrip("=").replace("-", "+").replace("_", "/")
    for phase in range(4):
        run = whole[phase:]
        run = run[: len(run) - (len(run) % 4 == 1)]
        if len(run) < 16:
            return
        data = base64.b64decode(run + "=" * (-len(run) % 4))
        own = places[phase : phase + len(run)]
        for window, later in _inflated(data, not phase):  # one span for all of it
            for text, _ in _texts(window):
                yield (text, np.broadcast_to(layer.first(own).min(), len(text)), np.broadcast_to(layer.last(own).max(), len(text))), later
        for text, edges in _texts(data):
            # byte k holds bits of the characters 8k // 6 to (8k + 7) // 6
            yield (text, layer.first(own[8 * edges[:-1] // 6]), layer.last(own[(8 * edges[1:] - 1) // 6])), False


def _next(layer: Layer) -> Iterator[tuple[Found | None, bool]]:
    if "%" in layer.text:
        yield _percent(layer), False
    if "\\" in layer.text:
        yield _escapes(layer), False
    for run, places in _runs(layer.text):
        yield from _base64(layer, run, places)


def layers(text: str) -> Iterator[tuple[Layer, bool]]:
    """Layer 0 and all that can be decoded from it, each content once; True for a window after the first. A layer's
    successors are decoded one at a time, and what comes of each before the next."""
    seen = set()
    first = Layer(text, None, None, 0)
    yield first, False
    todo = [(first, _next(first))]
    while todo:
        layer, rest = todo[-1]
        if (got := next(rest, None)) is None:
            todo.pop()
            continue
        new, later = got
        if new and new[0] and new[0] != layer.text and new[0] != text:
            # the key has the place too: the same content elsewhere has spans of its own
            key = (hashlib.sha256(new[0].encode("utf-8", "surrogatepass")).digest(), int(new[1][0]), int(new[2][-1]))
            if key not in seen:
                seen.add(key)
                one = Layer(*new, layer.depth + 1)
                yield one, later
                todo.append((one, _next(one)))


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int, int]:
    """Base spans; all spans, in order of start, kind, end; number of layers, depth, windows after the first."""
    base = base_spans(text)
    spans, n, depth, capped = set(base), 0, 0, 0
    for layer, cut in layers(text):
        n, depth, capped = n + 1, max(depth, layer.depth), capped + cut
        if layer.depth:
            for start, kind, end in base_spans(layer.text):
                spans.add((int(layer.at[start:end].min()), kind, int(layer.to[start:end].max())))
    return base, sorted(spans), n, depth, capped


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for raw in b.column("text"):
            base, spans, n, depth, capped = scan(raw.as_py().decode("utf-8", "replace"))
            counts = [sum(k == kind for _, kind, _ in base) for k in range(3)]
            out.append((*counts, hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(spans), n, depth, capped))
        columns = dict(zip(SPANS.names[1:], zip(*out, strict=True) if out else [[]] * 8, strict=True))
        yield batch(SPANS, doc_id=b.column("doc_id"), **columns)


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, without a shuffle."""
    return as_bytes(docs, docs.doc_id.cast("long").alias("doc_id")).mapInArrow(_scan, DDL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(documents(spark, sf_dir))

"""Secrets in texts and in what the texts encode.

A worklist holds layers, beginning with the text. Each layer is scanned, and everything in it that decodes (percent
escapes, Unicode escapes, base64 also over line ends, and compressed data in any of these or in other compressed data)
is unwrapped into a further layer, until nothing new appears; bytes that are no UTF-8 stay in a layer as lone surrogates; a layer that was seen before in the document is not taken again, so cycles end. Every layer knows for
each character the span of the text that it came from.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import itertools
import lzma
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import ship, table, text_only

ship(__name__)

# Fixed by the contract: the kinds in order, and what each matches.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = ("passw", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LINE_END = r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*"
WRAPPED = [re.compile(rf"(?<![{c}])(?:[{c}]{{16,}}+{LINE_END})+[{c}]++={{0,2}}") for c in ("A-Za-z0-9+/", "A-Za-z0-9_-")]
# How compressed data begins: in bytes, and in text that writes them by percent (decoded before) or other escapes.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00")
STARTS = (b"\x1f\x8b", b"x\x01", b"x^", b"x\x9c", b"x\xda", b"BZh", b"\xfd7zXZ\x00")


def _written(b: int) -> str:
    """The ways to write a byte with an escape or, if it can be read, as it is."""
    ways = [rf"\\x{b:02x}", rf"\\u00{b:02x}", rf"\\u\{{0*{b:x}\}}", rf"\\U000000{b:02x}", rf"&\#x0*{b:x};", rf"&\#0*{b};", rf"\\{b:03o}", rf"\\{b:o}(?![0-7])"]
    return f"(?:{'|'.join(ways + [re.escape(chr(b))] * (32 <= b < 127))})"


PACKED_ESCAPED = re.compile("|".join("".join(map(_written, x)) for x in STARTS), re.I)
SIGN = re.compile(r"""\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\u\{0*([0-9A-Fa-f]{1,2})\}|\\U000000([0-9A-Fa-f]{2})|&\#x0*([0-9A-Fa-f]{1,2});|&\#0*([0-9]{1,3});|\\([0-7]{1,3})|\\([abfnrtv\\'"])|([\x00-\xff])""")
FIRST = {0x1F, 0x78, 0x42, 0xFD}  # of compressed data
SIMPLE = dict(zip("abfnrtv\\'\"", b"\a\b\f\n\r\t\v\\'\"", strict=True))
# What a layer of bytes that are no readable text must hold to be worth a scan.
TELLING = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{32}|%[0-9A-Fa-f]{2}|\\[uUx]|&#|[A-Za-z0-9+/_-]{16}|\x00")
# What data must hold, or begin compressed, if it is decoded with signs glued to its front.
SECRET = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}")
# Long layers are cut only behind signs that are in no match and in nothing that decodes.
CUT = re.compile(r"[,()<>!?*@\[\]|~`^$]|[^A-Za-z0-9+/_=\r\n \t-]\n|\n[ \t]*\n")
URL_SAFE = str.maketrans("-_", "+/")
PIECE = 8 << 20
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers int"


def matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the matches of one layer, kind by its place in KINDS."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


class Layer:
    """Text with, per character, where its source begins and ends; no lists: character i is the text's i-th; two numbers:
    all characters come from there."""

    __slots__ = ("begin", "end", "text")

    def __init__(self, text: str, begin: list[int] | int | None = None, end: list[int] | int | None = None) -> None:
        self.text, self.begin, self.end = text, begin, end

    def span(self, a: int, z: int) -> tuple[int, int]:
        if isinstance(self.begin, int):
            return self.begin, self.end
        return (a, z) if self.begin is None else (min(self.begin[a:z]), max(self.end[a:z]))

    def data(self) -> bytes:
        """The bytes of the layer: as they were, where they are no UTF-8."""
        return self.text.encode("utf-8", "surrogateescape" if not LONE.search(self.text) else "surrogatepass")

    def key(self) -> bytes:
        return hashlib.sha256(self.data()).digest()


LONE = re.compile("[\ud800-\udc7f\udd00-\udfff]")

BROKEN = re.compile("[\udc80-\udcff\\x00\\x01]")


class Packed:
    """Compressed data with the span of the text that it came from."""

    __slots__ = ("begin", "bytes", "end")

    def __init__(self, data: bytes, begin: int, end: int) -> None:
        self.bytes, self.begin, self.end = data, begin, end

    def key(self) -> bytes:
        return hashlib.sha256(b"packed" + self.bytes).digest()


def _chars(data: bytes) -> list[tuple[str, int]]:
    """Characters of UTF-8 bytes with the bytes each took; broken bytes become lone surrogates one by one."""
    out, i = [], 0
    while i < len(data):
        n = 1 if data[i] < 0xC0 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
        try:
            out.append((data[i : i + n].decode(), min(n, len(data) - i)))
            i += n
        except UnicodeDecodeError:
            out.append((data[i : i + 1].decode("utf-8", "surrogateescape"), 1))
            i += 1
    return out


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match of an escape replaced by the characters that ``decode`` gives with their widths."""
    text, parts, begin, end, at = layer.text, [], [], [], 0

    def keep(a: int, z: int) -> None:
        parts.append(text[a:z])
        one = isinstance(layer.begin, int)
        begin.extend([layer.begin] * (z - a) if one else range(a, z) if layer.begin is None else layer.begin[a:z])
        end.extend([layer.end] * (z - a) if one else range(a + 1, z + 1) if layer.begin is None else layer.end[a:z])

    for m in pattern.finditer(text):
        keep(at, m.start())
        a = m.start()
        for c, width in decode(m):
            s, e = layer.span(a, a + width)
            parts.append(c)
            begin.extend([s] * len(c))
            end.extend([e] * len(c))
            a += width
        at = m.end()
    if not at:
        return None
    keep(at, len(text))
    return Layer("".join(parts), begin, end)


def _percent(m: re.Match) -> list[tuple[str, int]]:
    return [(c, 3 * n) for c, n in _chars(bytes.fromhex(m[0].replace("%", "")))]


def _escape(m: re.Match) -> list[tuple[str, int]]:
    if code := m[1] or m[2] or m[3] or m[4]:
        value = int(code, 16)
    elif m[5]:
        value = int(m[5])
    else:  # a run of UTF-16 units, in which two may make one character
        units = [int(x, 16) for x in m[0].split("\\u")[1:]]
        out, i = [], 0
        while i < len(units):
            if 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                out.append((chr(0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00), 12))
                i += 2
            else:
                out.append(("�" if 0xD800 <= units[i] < 0xE000 else chr(units[i]), 6))
                i += 1
        return out
    good = value < 0xD800 or 0xE000 <= value < 0x110000
    return [(chr(value) if good else "�", m.end() - m.start())]


def _inflated(data: bytes, left: list[int]) -> Iterator[bytes]:
    """Decompressed pieces of gzip, zlib, bzip2 or xz data, all streams one after the other; a piece has PIECE bytes at most.

    ``left`` gets the number of bytes behind the last stream."""
    left[:] = [0]
    while PACKED.match(data):
        zipped = data[:1] in b"\x1fx"
        engine = zlib.decompressobj(47) if zipped else bz2.BZ2Decompressor() if data[:1] == b"B" else lzma.LZMADecompressor()
        while not engine.eof:
            try:
                got = engine.decompress(data, PIECE)
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                return
            data = engine.unconsumed_tail if zipped else b""
            if got:
                yield got
            elif not data and not engine.eof:
                return  # cut off
        data = engine.unused_data.lstrip(b"\0")  # streams may be padded
        left[:] = [len(engine.unused_data)]


def _begins(data: bytes) -> bool:
    """Whether the first signs of ``data`` can be compressed data; most chance finds end here."""
    if not PACKED.match(data):
        return False
    if data[:1] not in b"\x1fx":
        return True
    try:
        zlib.decompressobj(47).decompress(data[:64], PIECE)
    except zlib.error:
        return len(data) <= 64 and bool(next(_inflated(data, []), b""))
    return True


def _cut(text: str) -> int:
    """Behind the last place where no match and nothing that decodes can be cut in two, or 0."""
    width = 1 << 12
    while True:
        at = [m.end() for m in CUT.finditer(text, max(0, len(text) - width))]
        if at or width >= len(text):
            return at[-1] if at else 0
        width *= 4


def _texts(pieces: Iterator[bytes], codec: str) -> Iterator[str]:
    """The text of all pieces, in parts of about PIECE signs."""
    decoder, kept = codecs.getincrementaldecoder(codec)("surrogateescape" if codec == "utf-8" else "replace"), ""
    for x in pieces:
        kept += decoder.decode(x)
        if len(kept) >= PIECE and (cut := _cut(kept)):
            yield kept[:cut]
            kept = kept[cut:]
    kept += decoder.decode(b"", True)
    if kept:
        yield kept


def _unpacked(packed: Packed) -> Iterator[Layer | Packed]:
    """The layers in compressed data: its text, read as UTF-16 too where it has zero bytes, and compressed data in it."""
    left: list[int] = []
    tail, zero, more = b"", False, False
    for x in _inflated(packed.bytes, left):
        zero = zero or 0 in x
        x = tail + x
        more = more or any(_begins(x[m.start() : m.start() + 64]) for m in PACKED.finditer(x))
        tail = x[-64:]
    if more:
        data = b"".join(_inflated(packed.bytes, left))
        yield from _packed_from(data, _Same(packed.begin), _Same(packed.end))
    for codec in ("utf-8", "utf-16-le", "utf-16-be") if zero else ("utf-8",):
        for text in _texts(_inflated(packed.bytes, left), codec):
            yield Layer(text, packed.begin, packed.end)


class _Same:
    """The one place of all bytes."""

    def __init__(self, place: int) -> None:
        self.place = place

    def __getitem__(self, _: slice) -> list[int]:
        return [self.place]


def _packed_from(data: bytes, begins: list[int] | _Same, ends: list[int] | _Same) -> Iterator[Packed]:
    """Compressed data anywhere in ``data``, of which each byte has a span."""
    done = 0
    for m in PACKED.finditer(data):
        a = m.start()
        if a < done:
            continue
        left: list[int] = []
        if _begins(data[a : a + 64]) and sum(map(len, _inflated(data[a:], left))):
            done = len(data) - left[0]
            yield Packed(data[a:done], min(begins[a:done]), max(ends[a:done]))


def _packed_in_percent(layer: Layer) -> Iterator[Packed]:
    """Compressed data in a layer that percent escapes gave."""
    if BROKEN.search(layer.text) and not LONE.search(layer.text):
        size = [len(c.encode("utf-8", "surrogateescape")) for c in layer.text]
        begins = [b for b, n in zip(layer.begin, size, strict=True) for _ in range(n)]
        ends = [e for e, n in zip(layer.end, size, strict=True) for _ in range(n)]
        yield from _packed_from(layer.data(), begins, ends)


def _packed_in_escapes(layer: Layer) -> Iterator[Packed]:
    """Compressed data that a layer writes with escapes, as a literal of bytes does."""
    seen: set[int] = set()
    for m in PACKED_ESCAPED.finditer(layer.text):
        if m.start() in seen:  # decoded with what stands before it
            continue
        data, places, at = bytearray(), array("q"), m.start()
        while (x := SIGN.match(layer.text, at)) and not (x[6] and int(x[6]) > 255) and not (x[7] and int(x[7], 8) > 255):
            code = x[1] or x[2] or x[3] or x[4] or x[5]
            data.append(int(code, 16) if code else int(x[6]) if x[6] else int(x[7], 8) if x[7] else SIMPLE[x[8]] if x[8] else ord(x[9]))
            places.append(at)
            if data[-1] in FIRST:
                seen.add(at)
            at = x.end()
        places.append(at)
        data = bytes(data)
        if any(_begins(data[k.start() : k.start() + 64]) for k in PACKED.finditer(data)):
            spans = [layer.span(i, j) for i, j in itertools.pairwise(places)]
            yield from _packed_from(data, [x[0] for x in spans], [x[1] for x in spans])


def _readable(data: bytes) -> bool:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return False
    return sum(c.isprintable() or c in "\t\n\r" for c in text) >= 0.9 * len(text)


def _runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of base64, each as the places of its lines."""
    for m in BASE64.finditer(text):
        yield [(m.start(), m.end())]
    if "\n" not in text and "\\n" not in text:
        return
    for pattern in WRAPPED:
        for m in pattern.finditer(text):
            lines, at = [], m.start()
            for x in re.finditer(LINE_END, m[0]):
                lines.append((at, m.start() + x.start()))
                at = m.start() + x.end()
            lines.append((at, m.end()))
            yield lines
            # lines of one width and a shorter last one, where what stands before or behind them isn't theirs
            a = 0
            for i in range(1, len(lines) + 1):
                if i == len(lines) or lines[i][1] - lines[i][0] != lines[a][1] - lines[a][0]:
                    z = i + (i < len(lines) and lines[i][1] - lines[i][0] < lines[a][1] - lines[a][0])
                    if z - a > 1 and (a, z) != (0, len(lines)):
                        yield lines[a:z]
                    if i - a > 1 and z > i:
                        yield lines[a:i]
                    a = i


def _base64(layer: Layer) -> Iterator[Layer | Packed]:
    for lines in _runs(layer.text):
        whole, places = "".join(layer.text[a:z] for a, z in lines).rstrip("=").translate(URL_SAFE), None
        for shift in range(4):  # signs glued to the front move the groups of four
            run = whole[shift:]
            if len(run) % 4 == 1:
                if len(lines) == 1 and not shift:
                    continue
                run = run[:-1]
            try:
                data = base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
            except (binascii.Error, ValueError):
                continue
            packed = any(_begins(data[m.start() : m.start() + 64]) for m in PACKED.finditer(data)) or not shift and PACKED.match(data)
            if shift and not packed and not SECRET.search(data) and not (TELLING.search(data) and _readable(data.replace(b"\0", b""))):
                continue
            if not packed and not (not shift and _readable(data)) and not TELLING.search(data):
                continue
            places = places or [i for a, z in lines for i in range(a, z)]
            place = places[shift:]
            if packed:
                last = min(len(run), len(place)) - 1
                fours = [layer.span(place[i], place[min(i + 3, last)] + 1) for i in range(0, last + 1, 4)]
                begins, ends = ([x[k] for x in fours for _ in range(3)] for k in (0, 1))
                yield from _packed_from(data, begins, ends)
                if not TELLING.search(data):
                    continue
            yield from _decoded(layer, data, place)


def _decoded(layer: Layer, data: bytes, place: list[int]) -> Iterator[Layer]:
    """The text of decoded base64, of which each sign stands at a place of the layer."""

    def spread(sizes: list[int], begin: list, end: list) -> None:  # three bytes to four signs
        at = 0
        for n in sizes:
            s, e = layer.span(place[at // 3 * 4], place[min(len(place), (at + n - 1) // 3 * 4 + 4) - 1] + 1)
            begin.append(s)
            end.append(e)
            at += n

    for codec in ("utf-8", "utf-16-le", "utf-16-be") if 0 in data else ("utf-8",):
        text = data.decode(codec, "surrogateescape" if codec == "utf-8" else "replace")
        begin: list[int] = []
        end: list[int] = []
        if codec == "utf-8":
            spread([len(c.encode("utf-8", "surrogateescape")) for c in text], begin, end)
        else:  # what is no UTF-16 takes a unit or what is left of it
            sizes = [4 if c > "\uffff" else 2 for c in text]
            if sum(sizes) != len(data) and sizes:
                sizes[-1] = max(1, len(data) - sum(sizes[:-1]))
            spread(sizes, begin, end)
        yield Layer(text, begin, end)


def _wide(layer: Layer) -> Iterator[Layer]:
    """The layer, and without its zero bytes if it has any, as in escaped UTF-16."""
    yield layer
    if "\0" in layer.text:
        at = [i for i, c in enumerate(layer.text) if c != "\0"]
        yield Layer("".join(layer.text[i] for i in at), [layer.begin[i] for i in at], [layer.end[i] for i in at])


def unwrapped(layer: Layer | Packed) -> Iterator[Layer | Packed]:
    """Every layer that one step of decoding gives."""
    if isinstance(layer, Packed):
        yield from _unpacked(layer)
        return
    if "%" in layer.text and (x := _replaced(layer, PERCENT, _percent)):
        yield from _packed_in_percent(x)
        if "+" in layer.text and BROKEN.search(x.text):  # forms write a space so
            yield from _packed_in_percent(_replaced(Layer(layer.text.replace("+", " "), layer.begin, layer.end), PERCENT, _percent))
        yield from _wide(x)
    if "\\" in layer.text or "&#" in layer.text:
        yield from _packed_in_escapes(layer)
        if x := _replaced(layer, ESCAPE, _escape):
            yield from _wide(x)
    yield from _base64(layer)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """(start, kind, end) in the text itself, the same with all layers' mapped matches, and the number of layers."""
    text = text or ""
    base = matches(text)
    found, todo, seen, layers = set(base), [iter([Layer(text)])], set(), 0
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
            continue
        if (key := layer.key()) in seen:
            continue
        seen.add(key)
        if isinstance(layer, Layer):
            layers += 1
            if layer.begin is not None:
                for a, kind, z in matches(layer.text):
                    s, e = layer.span(a, z)
                    found.add((s, kind, e))
        todo.append(unwrapped(layer))
    return base, sorted(found), layers


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base, spans, layers = scan(text)
            counts = [sum(k == i for _, k, _ in base) for i in range(3)]
            out.append((doc, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), layers))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
        names = [f.split()[0] for f in RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of the secrets of every document, one row each, wherever they are encoded.

    Spans are kind:start:end in code points of the whole text, end exclusive, by start, then kind. A null text reads as
    empty and has none. No layer is cut off: very long inflated layers are scanned in pieces that end outside of matches, one
    after the other, so that memory stays near that of the text itself. Repeated rows and equal doc_ids are rows of their
    own, other columns are not read, and an empty table gives no rows.
    """
    return text_only(docs).mapInArrow(_rows, RESULT)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))

"""Secret scan with a recursive decoding worklist.

A text is the first layer. Each layer is scanned by the base patterns, and decoded in every way that applies: percent
escapes, ``\\u``, ``\\u{}``, ``\\U`` and ``\\x`` escapes, numeric character references, ASCII in UTF-16, and runs of base64,
also wrapped over lines. A run is decoded at each of the four alignments, as it may be glued to a path or a key, and its
readable stretches are layers. Where bytes, of base64 or of escapes, hold a gzip, zlib, bz2, xz or zstd stream, it is unpacked
with all its members (again and again, if it unpacks to such a stream); a run of base64 (of 15 characters, as
any) that is one whole stream of plain deflate is, too. Decoded layers go on the worklist until nothing new comes; a layer with the same content and place as an
earlier one is dropped, so cycles end. A layer carries, for each of its characters, the place in the
original text, so what is found in it maps back to the text that hides it.

Unpacked streams are read in parts of ``PART`` bytes that overlap, so a small text that unpacks to a huge one is scanned
whole in bounded memory. The overlap holds an encoded run that a part ends in, up to ``PART`` bytes of it; a longer one is
read once more from its start and decoded piece by piece, so that a stream encoded in it is unpacked to its end. The base spans are those of the first layer; decoding only adds spans.

Defined edge cases: null and empty texts have no spans; rows are independent (one scan, no shuffle), so repeated rows give
repeated results; a text of any length is scanned whole, with 16 bytes of places for each character of a layer that decoding
escapes makes of it; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, texts_of

KINDS = ("assign", "access", "hex")
#: Fixed patterns and least lengths; a match below its least length is dropped after matching.
ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of fewer characters holds no run of 32
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: One escaped character: its code is in the first group that took part, in decimal digits if that is the last one.
ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,8})\}|\\U([0-9A-Fa-f]{8})|&#[xX]([0-9A-Fa-f]{1,8});|&#([0-9]{1,10});")
ESCAPE = re.compile(f"(?:{ONE_ESCAPE.pattern})+")
#: The shortest secret has 14 bytes; 32 equal hexadecimal digits are a stream of 11, which is 15 characters.
LEAST_BYTES = 14
#: A run ends with its padding, which may be escaped for a URL.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{15,}(?:=|%3[Dd]){0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+={0,2}")
URL_SAFE = str.maketrans("-_", "+/")
URL_SAFE_BYTES = bytes.maketrans(b"-_", b"+/")
READABLE = re.compile(rb"(?:[\t-\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){%d,}" % LEAST_BYTES)
#: ASCII in UTF-16 of either byte order: each character beside a NUL.
WIDE = re.compile(r"(?:\0[\t-\r\x20-\x7e]){%d,}\0?|(?:[\t-\r\x20-\x7e]\0){%d,}" % (LEAST_BYTES, LEAST_BYTES))
WIDE_BYTES = re.compile(WIDE.pattern.encode())
#: Escaped bytes between characters that stand for themselves, and one byte of these.
PERCENT_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[!-$&-~])+")
ESCAPE_BYTES = re.compile(r"(?:\\(?:x|u00)[0-9A-Fa-f]{2}|\\[0abfnrtv'\"\\]|[ -\[\]-~])+")
ONE_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|\\(?:x|u00)[0-9A-Fa-f]{2}|\\.|.", re.S)
SHORT = {"\\0": 0, "\\a": 7, "\\b": 8, "\\f": 12, "\\n": 10, "\\r": 13, "\\t": 9, "\\v": 11, "\\'": 39, '\\"': 34, "\\\\": 92}
PART, OVERLAP = 4 << 20, 4096
#: Bytes given to a decompressor at a time, which bounds what comes out of it at a time.
SLICE = 256
CODE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
ENCODED = CODE + b"=%\\\r\n\0"
NOT_CODE = re.compile(rb"[^A-Za-z0-9+/_\r\n-]")
MAGIC = {b"\x1f\x8b": "gzip", b"BZh": "bz2", b"\xfd7zXZ\0": "xz", b"\x28\xb5\x2f\xfd": "zstd", b"\x78\x01": "zlib", b"\x78\x5e": "zlib", b"\x78\x9c": "zlib", b"\x78\xda": "zlib"}
ANY_MAGIC = re.compile(b"|".join(map(re.escape, MAGIC)))


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return out


class Layer:
    """A text, and the original place of each of its characters: all of them at one span, or one each."""

    def __init__(self, text: str, first: np.ndarray | int, last: np.ndarray | int):
        self.text, self.first, self.last = text, first, last

    def place(self, start: int, end: int) -> tuple[int, int]:
        if isinstance(self.first, int):
            return self.first, self.last
        return int(self.first[start]), int(self.last[end - 1])

    def key(self) -> tuple:
        if isinstance(self.first, int):
            return xxhash.xxh3_128_digest(self.text.encode("utf-8", "surrogatepass")), self.first, self.last
        return xxhash.xxh3_128_digest(self.text.encode("utf-8", "surrogatepass")), xxhash.xxh3_64_intdigest(np.ascontiguousarray(self.first).tobytes())


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match decoded; ``decode`` gives characters with their offsets within the match, or None."""
    parts, first, last, at, changed = [], [], [], 0, False
    whole = isinstance(layer.first, int)
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None:
            continue
        changed = True
        chars, begin, end = got
        parts += [layer.text[at : m.start()], chars]
        if not whole:
            first += [layer.first[at : m.start()], layer.first[m.start() + np.array(begin, np.int64)]]
            last += [layer.last[at : m.start()], layer.last[m.start() + np.array(end, np.int64) - 1]]
        at = m.end()
    if not changed:
        return None
    text = "".join([*parts, layer.text[at:]])
    if whole:
        return Layer(text, layer.first, layer.last)
    return Layer(text, np.concatenate([*first, layer.first[at:]]), np.concatenate([*last, layer.last[at:]]))


def _percent(run: str):
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        chars = raw.decode()
    except UnicodeDecodeError:
        chars = raw.decode("latin-1")
        begin = list(range(0, len(run), 3))
        return chars, begin, [b + 3 for b in begin]
    ends = np.cumsum([3 * len(c.encode()) for c in chars]).tolist()
    return chars, [0, *ends[:-1]], ends


def _escape(run: str):
    chars, begin, end = [], [], []
    for m in ONE_ESCAPE.finditer(run):
        code = int(m[m.lastindex], 10 if m.lastindex == 6 else 16)
        code = code if code <= 0x10FFFF else 0xFFFD
        if 0xDC00 <= code < 0xE000 and chars and 0xD800 <= ord(chars[-1]) < 0xDC00:
            chars[-1] = chr(0x10000 + ((ord(chars[-1]) - 0xD800) << 10) + code - 0xDC00)
            end[-1] = m.end()
            continue
        chars.append(chr(code))
        begin.append(m.start())
        end.append(m.end())
    return "".join(chars), begin, end


def _wide(run: str):
    begin = [k for k, c in enumerate(run) if c != "\0"]
    return run.replace("\0", ""), begin, [b + 1 for b in begin]


def _readable(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    bad = sum(c < " " and c not in "\t\n\r\f\v" for c in text)
    return text if bad * 10 <= len(text) else None


def _stream(raw: bytes) -> str | None:
    return next((kind for magic, kind in MAGIC.items() if raw.startswith(magic)), None)


def _tool(kind: str):
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind]()


def unpack(chunks: Iterable[bytes], end: list[int] | None = None) -> Iterator[bytes]:
    """The unpacked streams, one behind the other, in pieces; it ends silently where a stream is broken.

    What isn't a stream, from the start or behind the last one, comes as it is; with ``end``, which takes the length of the
    whole streams, it is left out.
    """
    source = (c[k : k + SLICE] for c in chunks for k in range(0, len(c), SLICE))
    rest, fed, whole = b"", 0, 0
    while True:
        while len(rest) < 6 and (more := next(source, None)) is not None:
            fed += len(more)
            rest += more
            if whole:  # streams may be padded with zeros
                rest = rest.lstrip(b"\0")
        kind = _stream(rest)
        taken, got = rest, b""
        try:
            if kind is None:
                raise ValueError("not a stream")
            tool, data = _tool(kind), rest
            while data is not None:
                more = tool.decompress(data, PART) if kind in ("bz2", "xz") else tool.decompress(data)
                while more:
                    got = more
                    yield more
                    more = tool.decompress(b"", PART) if kind in ("bz2", "xz") and not tool.eof and not tool.needs_input else b""
                if tool.eof:
                    break
                data = next(source, None)
                if data is not None:
                    fed += len(data)
                    taken = b"" if got else taken + data
            if data is None:
                return
            rest = tool.unused_data
            whole = fed - len(rest)
            if end is not None:
                end[0] = whole
        except Exception as e:  # each library has its own error for a broken stream
            if not isinstance(e, (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError)) and type(e).__name__ != "ZstdError":
                raise
            if end is None and not got:
                if taken:
                    yield taken
                yield from source
            return


def _parts(chunks: Iterable[bytes], size: int | None = None) -> Iterator[bytes]:
    """The same bytes, ``PART`` or ``size`` at a time."""
    size = size or PART
    held = bytearray()
    for c in chunks:
        held += c
        while len(held) >= size:
            yield bytes(held[:size])
            del held[:size]
    if held:
        yield bytes(held)


def _decoded(chunks: Iterable[bytes], start: int) -> Iterator[bytes]:
    """What the run of base64 that ``chunks`` hold from byte ``start`` on, line ends aside, decodes to."""
    held = b""
    for c in chunks:
        begin, start = min(start, len(c)), max(0, start - len(c))
        end = NOT_CODE.search(c, begin)
        held += c[begin : end.start() if end else len(c)].translate(URL_SAFE_BYTES, b"\r\n")
        whole = len(held) // 4 * 4
        yield base64.b64decode(held[:whole])
        held = held[whole:]
        if end:
            break
    if len(held) > 1:
        yield base64.b64decode(held + b"=" * (-len(held) % 4))


def _long_run(source: Callable[[], Iterable[bytes]], start: int, seen: frozenset) -> Iterator[str]:
    """The texts of the stream, if it is one, that is encoded in the long run from byte ``start`` of the source on."""
    for shift in range(4):
        head = next(_parts(_decoded(source(), start + shift), 8), b"")
        if _stream(head):
            yield from _texts(lambda at=start + shift: _decoded(source(), at), seen)


def _texts(source: Callable[[], Iterable[bytes]], seen: frozenset = frozenset()) -> Iterator[str]:
    """Texts in overlapping parts, unpacked while they are streams; ``seen`` ends streams that unpack to themselves.

    ``source`` gives the same bytes at each call. A run of base64 that is longer than the overlap may be is taken up again from
    its start, with bounded memory, where it holds a stream.
    """
    parts = _parts(source())
    head = next(parts, None)
    if head is None:
        return
    key = xxhash.xxh3_128_digest(head)
    if _stream(head) and key not in seen:
        parts.close()
        yield from _texts(lambda: unpack(source()), seen | {key})
        return
    tail, read, done = b"", 0, 0
    for part in chain([head], parts):
        read += len(part)
        part = tail + part
        # a part may begin or end within a character
        yield part.decode("utf-8", "ignore")
        run = len(part) - len(part.rstrip(CODE + b"\r\n"))
        if run >= PART:
            if read - run > done or not done:
                yield from _long_run(source, read - run, seen)
            done = read
        else:
            done = 0
        tail = part[max(0, len(part) - PART, min(len(part) - OVERLAP, len(part.rstrip(ENCODED)))) :]


def _streams(raw: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the streams in ``raw`` that unpack to anything; of a broken one, the end of ``raw``."""
    at = 0
    while m := ANY_MAGIC.search(raw, at):
        end = [0]
        some = False
        for _ in unpack([raw[m.start() :]], end):
            some = True
        if some:
            yield m.start(), m.start() + end[0] if end[0] else len(raw)
        at = m.start() + max(1, end[0])


def _stream_texts(raw: bytes, start: int) -> Iterator[str]:
    raw = raw[start:]
    return _texts(lambda: unpack([raw], [0]), frozenset([xxhash.xxh3_128_digest(raw[:PART])]))


def _inflated(raw: bytes) -> Iterator[bytes]:
    """What a whole stream of plain deflate holds, in pieces; an error where ``raw`` isn't one or holds more."""
    tool, data = zlib.decompressobj(-15), raw
    while data and not tool.eof:
        yield tool.decompress(data, PART)
        data = tool.unconsumed_tail
    if not tool.eof or tool.unused_data:
        raise zlib.error("not one whole stream")


def _is_deflate(raw: bytes) -> bool:
    """A stream without a mark of its own, so all of it must be one."""
    if len(raw) < 4 or raw[0] & 6 == 6:
        return False
    try:
        return sum(map(len, _inflated(raw))) >= LEAST_BYTES
    except zlib.error:
        return False


def _run_layers(layer: Layer, start: int, run: str, wrapped: bool) -> Iterator[Layer]:
    """The layers of a run of base64 that starts there; of a wrapped one, those that no line has by itself."""
    body = run.partition("%")[0].rstrip("=")
    where = [i for i, c in enumerate(body) if not c.isspace()] if wrapped else range(len(body))
    code = "".join(body.split()).translate(URL_SAFE)
    for shift in range(4):
        part = code[shift:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        raw = base64.b64decode(part + "=" * (-len(part) % 4))

        def place(b: int, e: int) -> tuple[int, int] | None:
            first = where[shift + b // 3 * 4 + b % 3]
            last = where[shift + (e - 1) // 3 * 4 + (e - 1) % 3 + 1] + 1
            if wrapped and "\n" not in run[first:last]:
                return None
            return layer.place(start + first, start + (len(run) if e == len(raw) else last))

        for b, e in _streams(raw):
            if spot := place(b, e):
                for text in _stream_texts(raw, b):
                    yield Layer(text, *spot)
        if not shift and not _stream(raw) and _is_deflate(raw) and (spot := place(0, len(raw))):
            for text in _texts(lambda raw=raw: _inflated(raw)):
                yield Layer(text, *spot)
        for m in WIDE_BYTES.finditer(raw) if b"\0" in raw else ():
            if spot := place(m.start(), m.end()):
                yield Layer(m[0].replace(b"\0", b"").decode(), *spot)
        if not shift and not wrapped and not _stream(raw) and (text := _readable(raw)) is not None:
            yield Layer(text, *layer.place(start, start + len(run)))
            continue
        for m in READABLE.finditer(raw):
            if spot := place(m.start(), m.end()):
                yield Layer(m[0].decode(), *spot)


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    for m in BASE64.finditer(layer.text):
        yield from _run_layers(layer, m.start(), m[0], False)
    for m in WRAPPED.finditer(layer.text):
        if m.end() - m.start() > 15:
            yield from _run_layers(layer, m.start(), m[0], True)


def _byte(piece: str) -> int:
    if len(piece) == 1:
        return ord(piece)
    return SHORT[piece] if piece in SHORT else int(piece[-2:], 16)


def _escaped_layers(layer: Layer) -> Iterator[Layer]:
    """What streams in escaped bytes unpack to."""
    for pattern, marks in ((PERCENT_BYTES, ("%",)), (ESCAPE_BYTES, ("\\x", "\\u00"))):
        if not any(mark in layer.text for mark in marks):
            continue
        for m in pattern.finditer(layer.text):
            if not any(mark in m[0] for mark in marks):
                continue
            pieces = ONE_BYTE.findall(m[0]) if marks[0] != "%" else re.findall(r"%[0-9A-Fa-f]{2}|.", m[0])
            at = np.cumsum([0, *map(len, pieces)]).tolist()
            raw = bytes(map(_byte, pieces))
            kinds = [raw]
            if marks[0] == "%" and "+" in m[0]:  # a blank of a form
                kinds.append(bytes(32 if p == "+" else c for p, c in zip(pieces, raw)))
            for raw in kinds:
                for b, e in _streams(raw):
                    spot = layer.place(m.start() + at[b], m.start() + at[e])
                    for text in _stream_texts(raw, b):
                        yield Layer(text, *spot)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind, end), sorted."""
    if not text:
        return [], []
    base = sorted((s, k, e) for k, s, e in find_base(text))
    found = set(base)
    work: list[Layer] = []
    start = None
    if "%" in text or "\\" in text or "&#" in text or "\0" in text or BASE64.search(text) or WRAPPED.search(text):
        start = Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1))
        work, seen = [start], {start.key()}
    while work:
        layer = work.pop()
        if layer is not start:
            for k, s, e in find_base(layer.text):
                a, b = layer.place(s, e)
                found.add((a, k, b))
        plain = ((_replaced(layer, PERCENT, _percent) if "%" in layer.text else None), (_replaced(layer, ESCAPE, _escape) if "\\" in layer.text or "&#" in layer.text else None), (_replaced(layer, WIDE, _wide) if "\0" in layer.text else None))
        for new in chain(_base64_layers(layer), _escaped_layers(layer), plain):
            if new is not None and (key := new.key()) not in seen:
                seen.add(key)
                work.append(new)
    return base, sorted(found)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex`` (base spans), ``base`` and ``spans``."""
    rows = texts_of(docs, id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(map(slices, batches)):
            out: list[list] = [[], [], [], [], []]
            for t in b.column("text").to_pylist():
                base, spans = scan(t)
                kinds = [k for _, k, _ in base]
                for col, v in zip(out, (kinds.count(0), kinds.count(1), kinds.count(2), shown(base), shown(spans))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base string, spans string")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its secrets."""
    return find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")

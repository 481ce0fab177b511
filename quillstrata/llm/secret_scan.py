"""Secret scanning through nested encodings.

A text is the first layer. Each layer is scanned for the three kinds of secret,
then unwrapped to layers below: one with all its URL escapes decoded, one with all its
Unicode escapes, and one for every stretch of base64, of UTF-16 and of gzip or zlib, in
whatever layer it stands: compressed bytes are looked for in base64, behind escapes and
among the characters up to U+00FF alike. Escapes of bytes are decoded as UTF-8, and once
more byte by byte, so that compressed bytes survive. Raw deflate has no mark: it is tried
where base64 or an escaped word begins, and counts if it ends whole. A layer that equals one above it is not opened again; one that occurs
elsewhere in the document is scanned once, and its findings are mapped from each place.
Positions of a layer are mapped back through its parents to code points of the original
text: exactly for escapes, to groups of four characters for base64, to the whole stretch
for compressed bytes.

A run of base64 characters goes on over line ends and is decoded from each of its first
four characters, since a path or a word may be joined before the encoded stretch; a
finding that such a run ends with may take in the beginning of what follows. Decoded
bytes are scanned as they are, whatever they hold. A run has at least 16 characters; its
lines may be of any length if one of them has nothing else on it.

Defined results: null and empty texts have no findings; repeated rows are scanned
each; other columns are kept as they are by ``redact`` and dropped by
``scan_secrets``. Compressed layers are inflated and scanned in parts, whatever their
size. Only where one has more than ``UNBROKEN`` bytes without a place to cut may
a compressed stretch within it be missed: ``unopened`` counts these layers, and
``redact`` replaces them.
"""

from __future__ import annotations

import binascii
import hashlib
import heapq
import itertools
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.arrowtext import integer_id, map_batches

# The kinds of secret, in the order of the contract.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 16 or more is the same as a whole run that is long enough.
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|(?:\\u\{[0-9A-Fa-f]{1,6}\})+|(?:\\U[0-9A-Fa-f]{8})+|(?:%u[0-9A-Fa-f]{4})+")
#: Escapes of bytes that are no ASCII, and where an escaped word begins.
HIGH = re.compile(r"%[89A-Fa-f][0-9A-Fa-f]")
BREAKS = str.maketrans(dict.fromkeys("\t\r\n\"'=&?,;:<>()[]{}|/", " "))
#: An escape in a shorter stretch of ASCII can be no part of a secret, however encoded.
ASCII = re.compile(r"[\t\n\r\x20-\x7e]{16,}")
#: Characters that a base64 run, one line of a wrapped one, has at least.
LEAST_BASE64 = 16
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: A line that has nothing but a short part of a run.
SHORT_LINE = re.compile(r"(?m)^[ \t]*([A-Za-z0-9+/_-]{1,15})={0,2}[ \t]*\r?$")
LINES_AFTER = re.compile(r"(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
STANDARD = str.maketrans("-_", "+/")
ALPHABET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")
WIDE = re.compile(r"(?:[\x01-\x7f]\0){12,}[\x01-\x7f]?|(?:\0[\x01-\x7f]){12,}")
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
PACKED_TEXT = re.compile("\x1f\x8b\x08|x[\x01\x5e\x9c\xda]")
BEYOND_BYTES = re.compile("[^\x00-\xff]")
#: Bytes that raw deflate must give, fewer than any secret has.
LEAST_DEFLATED = 16
#: Bytes inflated first, and at once, and bytes of a compressed layer scanned at once where it can be cut.
FIRST, PIECE, WINDOW = 64, 1 << 16, 4 << 20
#: Bytes scanned at once where it cannot be cut, and the overlap of such parts.
UNBROKEN, OVERLAP = 16 << 20, 1 << 20
#: What no secret, escape or base64 run, nor any at a deeper layer, has within it: a cut may follow.
EDGE = re.compile(rb"[^A-Za-z0-9+/_.=%~{}\\\"':\s\0-]|\0{3}|(?<=\s)[A-Za-z0-9]+ (?=[A-Za-z0-9])")
#: Characters that a layer may have for its findings to be kept for the next time it occurs.
CACHED = 1 << 20

Map = Callable[[int, int], tuple[int, int]]


def find(text: str) -> list[tuple[int, int, int]]:
    """Return (start, kind index, end) of the secrets in one layer, sorted."""
    found = []
    low = text.lower()
    if (":" in text or "=" in text) and any(x in low for x in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _escapes(text: str, pattern: re.Pattern, decode: Callable[[str], str], closed: list[tuple[int, int]]) -> Iterator[tuple[str, Map, list[int]]]:
    """Unwrap all escapes of one sort at once and copy the rest, so that a key stays before its value.

    Those in a ``closed`` stretch, and those in stretches of ASCII that are too short for a
    secret, are copied, too.

    The list has the places of the content where an escape, or the word it stands in, begins.
    """
    out, at, parent, starts, size, last = [], [0], [0], [], 0, 0
    for run in itertools.chain.from_iterable(pattern.finditer(text, *m.span()) for m in ASCII.finditer(text)):
        if closed and (k := bisect_right(closed, (run.start(), len(text)))) and run.start() < closed[k - 1][1]:
            continue
        plain, inner = text[last : run.start()], decode(run[0])
        out += [plain, inner]
        starts += {size + plain.translate(BREAKS).rfind(" ") + 1, size + len(plain)}
        for piece, origin in ((len(plain), run.start()), (len(inner), run.end())):
            size += piece
            at.append(size)
            parent.append(origin)
        last = run.end()
    if not out:
        return
    out.append(text[last:])
    at.append(size + len(text) - last)
    parent.append(len(text))

    def inside(p: int, up: bool) -> int:
        k = min(bisect_right(at, p) - 1, len(at) - 2)
        if at[k] == p:
            return parent[k]
        same = at[k + 1] - at[k] == parent[k + 1] - parent[k]
        return parent[k] + p - at[k] if same else parent[k + up]

    yield "".join(out), lambda s, e: (inside(s, False), inside(e, True)), starts


def _bytes_of(run: str) -> bytes:
    return bytes.fromhex(run.replace("%", ""))


def _from_percent(run: str) -> str:
    return _bytes_of(run).decode("utf-8", "replace")


def _from_percent_bytes(run: str) -> str:
    return _bytes_of(run).decode("latin-1")


def _from_escape(run: str) -> str:
    if run[1] == "x":
        return bytes.fromhex(run.replace("\\x", "")).decode("latin-1")
    if run[1] == "U" or run[2] == "{":
        points = [int(x.strip("{}"), 16) for x in re.split(r"\\[uU]", run)[1:]]
        return "".join(chr(x) if x < 0x110000 and not 0xD800 <= x < 0xE000 else "\ufffd" for x in points)
    units = [int(run[k + 2 : k + 6], 16) for k in range(0, len(run), 6)]
    return b"".join(u.to_bytes(2, "big") for u in units).decode("utf-16-be", "replace")


class _Source:
    """Bytes handed out a slice at a time, with the place up to which they were used, and where the last member ended."""

    def __init__(self, raw: bytes, at: int):
        self.raw, self.at, self.used, self.ended = raw, at, at, at

    def __iter__(self) -> Iterator[bytes]:
        step = FIRST
        while self.at < len(self.raw):
            self.at += step
            yield self.raw[self.at - step : self.at]
            step = min(8 * step, PIECE)


def _inflate(source: Iterable[bytes], form: int = 47) -> Iterator[bytes]:
    """Yield the content of gzip or zlib bytes, member after member, in pieces of bounded size.

    ``form`` -15 is raw deflate, of which there is one member.
    """
    engine, rest = zlib.decompressobj(form), b""
    for chunk in source:
        rest += chunk
        while True:
            if engine is None and form < 0:
                return
            if engine is None:
                rest = rest.lstrip(b"\0")
                if len(rest) < 3:
                    break
                if not PACKED.match(rest):
                    return
                engine = zlib.decompressobj(47)
            try:
                out = engine.decompress(rest, PIECE)
            except zlib.error:
                return
            rest = engine.unused_data if engine.eof else engine.unconsumed_tail
            if isinstance(source, _Source):
                source.used = min(source.at, len(source.raw)) - len(rest)
                source.ended = source.used if engine.eof else source.ended
            if out:
                yield out
            if engine.eof:
                engine = None
            elif not rest and len(out) < PIECE:
                break


def _head(pieces: Iterator[bytes]) -> bytes:
    out = b""
    for piece in pieces:
        out += piece
        if len(out) >= PIECE:
            break
    return out


def _opened(source: _Source, form: int) -> tuple[str, Iterator[bytes]]:
    """Return (encodings, content) of compressed bytes, compressed several times over perhaps."""
    pieces: Iterator[bytes] = _inflate(source, form)
    head = _head(pieces)
    name, heads = "compressed", {head}
    while PACKED.match(head):
        kept, tried = itertools.tee(itertools.chain([head], pieces))
        inner = _inflate(tried)
        first = _head(inner)
        if not first or first in heads:
            pieces, head = kept, b""
            break
        del kept, tried
        pieces, head, name = inner, first, name + "+compressed"
        heads.add(head)
    return name, itertools.chain([head], pieces)


def _textual(part: bytes, end: int) -> bool:
    """Whether what stands before a cut is text, so that no compressed stretch goes on over it."""
    tail = part[max(0, end - 64) : end].lstrip(bytes(range(0x80, 0xC0)))
    try:
        return not any(c < " " and c not in "\t\r\n" for c in tail.decode("utf-8"))
    except UnicodeDecodeError as error:
        return error.reason == "unexpected end of data" and error.end == len(tail)


def _windows(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Cut a content where no secret or layer can go on: (part, whether something may be cut).

    Without such a place in ``UNBROKEN`` bytes parts overlap by ``OVERLAP``; only a
    compressed stretch that is longer can then be missed, and the part says so.
    """
    held, size, limit = [], 0, WINDOW
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size < limit:
            continue
        part = b"".join(held)
        near, end = PIECE, 0
        while True:
            ends = [m.end() for m in EDGE.finditer(part, max(0, size - near))]
            end = next((x for x in reversed(ends) if _textual(part, x)), 0)
            if end or near >= size:
                break
            near *= 4
        if end:
            yield part[:end], False
            held, limit = [part[end:]], WINDOW
        elif size >= UNBROKEN:
            yield part, True
            held, limit = [part[-OVERLAP:]], UNBROKEN
        else:
            held, limit = [part], min(2 * size, UNBROKEN)
        size = len(held[0])
        limit = max(limit, size + PIECE)
    yield b"".join(held), False


def _line_before(text: str, low: int, a: int) -> int:
    """Return where the base64 characters begin that end the line before ``a``, else ``a``."""
    p = a
    while p > low and text[p - 1] in " \t":
        p -= 1
    if p == low or text[p - 1] != "\n":
        return a
    p -= 1
    while p > low and text[p - 1] in " \t\r":
        p -= 1
    end = p
    while p > low and text[p - 1] in ALPHABET:
        p -= 1
    return p if p < end else a


def _runs(text: str) -> Iterator[tuple[str, Callable[[int], int], int]]:
    """Yield (characters, place of each in ``text``, end) of base64 runs, lines of one run joined."""
    done = 0
    seeds: Iterator[tuple[int, int]] = (m.span() for m in BASE64.finditer(text))
    if "\n" in text:
        seeds = heapq.merge(seeds, (m.span(1) for m in SHORT_LINE.finditer(text)))
    for a, b in seeds:
        if a < done:
            continue
        first, length = a, b - a
        while (line := _line_before(text, done, a)) < a:
            a = line
        end = LINES_AFTER.match(text, b).end()
        if end == b and a == first:
            if length >= LEAST_BASE64:
                done = b
                yield text[a:b], lambda p, a=a: a + p, b
            continue
        done = b = end
        if "\n" not in text[a:b]:
            run = text[a:b].rstrip("=")
            if len(run) >= LEAST_BASE64:
                yield run, lambda p, a=a: a + p, b
            continue
        parts = list(LINE.finditer(text, a, b))
        starts = [0, *itertools.accumulate(len(x[0]) for x in parts)]
        if starts[-1] < LEAST_BASE64:
            continue

        def place(p: int, starts=starts, parts=parts) -> int:
            k = min(bisect_right(starts, p) - 1, len(parts) - 1)
            return parts[k].start() + p - starts[k]

        yield "".join(x[0] for x in parts), place, b


def _base64(text: str) -> Iterator[tuple[str, str | None, Map]]:
    """Decode every run at all four alignments, so that what is joined before a stretch does not matter."""
    for run, place, top in _runs(text):
        body = run.translate(STANDARD)
        for lead in range(min(4, len(body) - LEAST_BASE64 + 1)):
            part = body[lead : len(body) - ((len(body) - lead) % 4 == 1)]
            raw = binascii.a2b_base64(part + "=" * (-len(part) % 4))

            def back(s: int, e: int, lead=lead, place=place, size=len(body), top=top) -> tuple[int, int]:
                last = lead + -(-e // 3) * 4
                return place(lead + s // 3 * 4), top if last > size else place(last - 1) + 1

            # Secrets and all that encodes them are ASCII, which Latin-1 keeps in any bytes.
            yield "base64", raw.decode("latin-1"), back
            end, _ = _measured(raw, 0, -15)
            for name, inner in _content(raw, 0, -15) if end else ():
                yield f"base64+{name}", inner, lambda s, e, back=back, end=end: back(0, end)


def _measured(raw: bytes, at: int, form: int = 47) -> tuple[int, bool]:
    """Return where compressed bytes that begin at a place end (the place itself if there are none), and whether they are whole."""
    source, size = _Source(raw, at), 0
    for piece in _inflate(source, form):
        size += len(piece)
    whole = source.ended > at
    return (source.used if size and (form > 0 or whole and size >= LEAST_DEFLATED) else at), whole


def _content(raw: bytes, at: int, form: int = 47) -> Iterator[tuple[str, str | None]]:
    """Yield (encoding, a part of the content) of compressed bytes; no content is a part that may hold more."""
    name, pieces = _opened(_Source(raw, at), form)
    for part, cut in _windows(pieces):
        yield name, part.decode("latin-1")
        if cut:
            yield name, None


def _bytes_from(text: str, at: int) -> bytes:
    """The characters up to U+00FF from a place on, as bytes."""
    end = BEYOND_BYTES.search(text, at)
    return text[at : end.start() if end else len(text)].encode("latin-1")


def _stretches(text: str, places: Iterable[int], form: int = 47) -> list[tuple[int, int, bytes, int, bool]]:
    """Return (start, end, bytes, place in the bytes, whether whole) of compressed stretches that begin at some of the places."""
    found: list[tuple[int, int, bytes, int, bool]] = []
    raw, begin, done = b"", 0, 0
    for at in places:
        if at < done:
            continue
        if at >= begin + len(raw):
            raw, begin = _bytes_from(text, at), at
        end, whole = _measured(raw, at - begin, form)
        if end > at - begin:
            done = begin + end
            found.append((at, done, raw, at - begin, whole))
    return found


def _deflated(text: str, starts: list[int], back: Map) -> Iterator[tuple[str, str | None, Map]]:
    """Unwrap raw deflate at places of a layer of escaped bytes, in the positions of the layer above."""
    for s, e, raw, at, _ in _stretches(text, sorted(set(starts)), -15):
        for name, inner in _content(raw, at, -15):
            yield name, inner, lambda p, q, s=s, e=e: back(s, e)


def _wide(text: str) -> Iterator[tuple[str, str, Map]]:
    """Unwrap the ASCII stretches of UTF-16, in which every other byte is NUL."""
    for m in WIDE.finditer(text):
        yield "utf-16", m[0][m[0][0] == "\0" :: 2], lambda s, e, m=m: (m.start() + 2 * s, min(m.start() + 2 * e, m.end()))


def _layers(text: str) -> Iterator[tuple[str, str | None, Map]]:
    """Yield (encoding, content, map to this layer's positions); no content is one that may hold more."""
    packed = _stretches(text, (m.start() for m in PACKED_TEXT.finditer(text)))
    for s, e, raw, at, _ in packed:
        for name, inner in _content(raw, at):
            yield name, inner, lambda p, q, s=s, e=e: (s, e)
    # What looks like an escape within compressed bytes is none.
    closed = [(s, e) for s, e, *_, whole in packed if whole]
    if "%" in text:
        for content, back, _ in _escapes(text, PERCENT, _from_percent, closed):
            yield "url", content, back
        if HIGH.search(text):
            for content, back, starts in _escapes(text, PERCENT, _from_percent_bytes, closed):
                yield "url", content, back
                yield from (("url+" + name, *rest) for name, *rest in _deflated(content, starts, back))
    if "\\" in text or "%u" in text:
        for content, back, starts in _escapes(text, ESCAPE, _from_escape, closed):
            yield "unicode", content, back
            if "\\x" in text:
                yield from (("unicode+" + name, *rest) for name, *rest in _deflated(content, starts, back))
    if "\0" in text:
        yield from _wide(text)
    yield from _base64(text)


def _key(content: str) -> str | bytes:
    """Short contents stand for themselves, long ones are known by a digest."""
    return content if len(content) <= 256 else hashlib.blake2b(content.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class _Layer:
    """A layer whose findings are being gathered, in its own positions."""

    def __init__(self, content: str, key: str | bytes, name: str, back: Map):
        self.key, self.name, self.back, self.size = key, name, back, len(content)
        self.found: dict[tuple[int, int, int], str] = dict.fromkeys(find(content), "")
        self.layers = _layers(content)
        self.whole = True

    def take(self, found: dict[tuple[int, int, int], str], name: str, back: Map) -> None:
        """Add an inner layer's findings; of two paths to one the shorter, then the earlier stays."""
        for (s, kind, e), path in found.items():
            s, e = back(s, e)
            path = f"{name}/{path}" if path else name
            known = self.found.get((s, kind, e))
            if known is None or known and path.count("/") < known.count("/"):
                self.found[s, kind, e] = path


def _scan(text: str) -> dict[tuple[int, int, int], str]:
    """Return the encodings of every (start, kind index, end); kind -1 is a stretch that may hold more."""
    cache: dict[str | bytes, dict[tuple[int, int, int], str]] = {}
    chain = [_Layer(text, _key(text), "", lambda s, e: (s, e))]
    above = {chain[0].key}
    while True:
        top = chain[-1]
        for name, inner, back in top.layers:
            if inner is None:
                top.take({(0, -1, 0): ""}, name, back)
                continue
            key = _key(inner)
            if key in above:
                top.whole = False
            elif key in cache:
                top.take(cache[key], name, back)
            else:
                chain.append(_Layer(inner, key, name, back))
                above.add(key)
                break
        else:
            chain.pop()
            if not chain:
                return top.found
            above.discard(top.key)
            chain[-1].take(top.found, top.name, top.back)
            # What leaves out a layer above holds for this place alone.
            chain[-1].whole &= top.whole
            if top.whole and top.size <= CACHED:
                cache[top.key] = top.found


def scan(text: str) -> tuple[list[tuple[int, int, int, str]], int]:
    """Return (start, kind index, end, encodings) of all secrets, and the number of stretches that may hold more.

    Findings of the text itself have no encodings. A deeper finding at the same
    place and of the same kind as an earlier one is the same finding.
    """
    found = sorted((*k, path) for k, path in _scan(text).items())
    secrets = [x for x in found if x[1] >= 0]
    return secrets, len(found) - len(secrets)


_FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("encodings", pa.string())])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (doc_id, findings, unopened), one row an input row.

    ``findings`` is an array of (kind, start, end, encodings) by start, then kind;
    positions are code points of the original text, ends exclusive.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("findings", pa.list_(_FINDING)), ("unopened", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, missed = [], []
            for text in batch.column(1):
                found, unopened = scan(text.as_py() or "")
                lists.append([{"kind": KINDS[k], "start": s, "end": e, "encodings": path} for s, k, e, path in found])
                missed.append(unopened)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, schema.types[1]), pa.array(missed, pa.int64())], schema=schema)

    rows = df.select(integer_id(df, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, findings array<struct<kind string, start long, end long, encodings string>>, unopened long")


def summarise(scanned: DataFrame) -> DataFrame:
    """Return counts, the digest of plain findings and all spans of ``scan_secrets``."""

    def spans(findings):
        return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    plain = F.filter("findings", lambda x: x["encodings"] == "")

    def count(kind):
        return F.size(F.filter(plain, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *map(count, KINDS), F.sha2(spans(plain), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"), "unopened")


def redact_text(text: str, mark: str) -> str:
    """Replace every finding and what may hold more; overlapping ones are replaced together."""
    merged: list[list[int]] = []
    for s, _, e in sorted(_scan(text)):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    out, last = [], 0
    for s, e in merged:
        out += [text[last:s], mark]
        last = e
    return "".join(out) + text[last:]


def redact(df: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """Return ``df`` with every secret of ``text_col`` replaced; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            column = [None if (t := x.as_py()) is None else redact_text(t, mark) for x in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(column, batch.schema.types[at])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_batches(df, run, df.schema)

"""Secret scans through nested encodings.

A worklist starts with the text. Every layer is scanned for secrets; then each of its lines that holds encoded tokens gives further
layers: the line with all its URL-encoded tokens decoded, with all its Unicode escapes, and with all its readable base64 runs
(compressed or not), so that what stands around a token, such as a key word before it, stays with it. This goes on until
nothing new appears. A layer whose content was already seen in the document is not opened again, so cycles end, but what
is found in it counts for each of its places. Each layer maps its characters to those of the texts it stands in, so a find
is reported as a span of the original text. Each layer takes time in proportion to its text, with or without white space in it.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import gzip
import hashlib
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import column, numbered, place, tune

#: Key words of credentials.
_KEYS = "token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|client[_-]?secret"
#: kind -> pattern; the secret is group 1 where there is one.
PATTERNS = {
    "aws_access_key": r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b",
    "github_token": r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b",
    "slack_token": r"\b(xox[abprs]-[A-Za-z0-9-]{10,})",
    "google_api_key": r"\b(AIza[0-9A-Za-z_-]{35})",
    "stripe_key": r"\b([sr]k_live_[0-9A-Za-z]{16,})\b",
    "quoted_credential": rf"(?i:\b(?:{_KEYS})[\"']?\s*[:=]\s*)[\"']([^\"'\s]{{8,}})[\"']",
}
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
_JWT_HEAD = re.compile(r"\beyJ")
_KEY_BEGIN = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_KEY_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
_BARE = re.compile(rf"(?i:\b(?:{_KEYS})\s*[:=]\s*)([A-Za-z0-9_+/=.-]{{16,}})")
_DIGIT = re.compile(r"[0-9]")


def _jwts(text: str) -> Iterator[tuple[int, int]]:
    """eyJ and at least eight characters, twice, and a signature, with dots between."""
    for m in _DOTTED.finditer(text):
        parts, at, skip = m[0].split("."), m.start(), 0
        for k, part in enumerate(parts):
            if k >= skip and k + 2 < len(parts) and len(parts[k + 1]) >= 11 and parts[k + 1].startswith("eyJ"):
                head = _JWT_HEAD.search(text, at, at + len(part))
                if head and at + len(part) - head.start() >= 11:
                    yield head.start(), at + len(part) + 2 + len(parts[k + 1]) + len(parts[k + 2])
                    skip = k + 3
            at += len(part) + 1


def _private_keys(text: str) -> Iterator[tuple[int, int]]:
    """From a key's first line to the next last line, or the first line alone where none follows."""
    ends = None
    at = 0
    while m := _KEY_BEGIN.search(text, at):
        if ends is None:
            found = [(e.start(), e.end()) for e in _KEY_END.finditer(text)]
            ends = [a for a, _ in found]
        k = bisect_right(ends, m.end() - 1)
        at = found[k][1] if k < len(ends) else m.end()
        yield m.start(), at


def _bare(text: str) -> Iterator[tuple[int, int]]:
    """A key word, : or =, and an unquoted value with a digit."""
    at = 0
    while m := _BARE.search(text, at):
        if _DIGIT.search(text, m.start(1), m.end(1)):
            yield m.span(1)
            at = m.end()
        else:  # a value that begins in this one has no digit either, unless its key word ends this one
            at = max(m.end(1) - 24, m.start(1))


def _pattern(kind: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span(1) for m in _COMPILED[kind].finditer(text))


#: kind -> spans of its secrets; the earlier kind has a place where two overlap.
FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {**{k: _pattern(k) for k in ("aws_access_key", "github_token", "slack_token", "google_api_key", "stripe_key")}, "jwt": _jwts, "private_key": _private_keys, "quoted_credential": _pattern("quoted_credential"), "bare_credential": _bare}
#: Characters of decompressed content that are a layer of their own; longer content gives several, which overlap.
PIECE, SEAM = 1 << 22, 1 << 16

_UNI_ONE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
_URL_ONE = re.compile(r"%(?:25){65,}|(?:%[0-9A-Fa-f]{2})+")
_B64 = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_LINE = re.compile(r"[^\n]+")
#: What a text must hold, in the syntax of Arrow's regular expressions, for any layer to exist or any pattern to match. There \s is
#: ASCII white space only and (?i) knows no dotless i, so both are wider here.
TRIGGER = r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|k_live_|eyJ|PRIVATE KEY|(?i:%s)[\"']?[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]*[:=]|%%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f]{2}|[A-Za-z0-9+/_-]{20,}" % _KEYS.replace("i", ".")


def _unquote(m: re.Match) -> str:
    if len(m[0]) > 130 and m[0][3:5] == "25":  # % encoded over and over: the levels between hold nothing else, so half of them are left out
        return "%" + "25" * ((len(m[0]) - 1) // 4)
    return unquote_to_bytes(m[0]).decode("utf-8", "replace")


def _unescape(m: re.Match) -> str:
    code = int(m[1] or m[2] or m[3], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def _inflated(data: Iterator[bytes]) -> Iterator[bytes] | None:
    """What gzip or zlib data holds, all its members, piece by piece; None if it isn't such data. Ends where the data breaks off or is wrong."""
    head = next(data, b"")
    if head[:2] == b"\x1f\x8b":
        kind = 31
    elif len(head) > 2 and head[0] == 0x78 and (head[0] * 256 + head[1]) % 31 == 0:
        kind = 15
    else:
        return None

    def run() -> Iterator[bytes]:
        d, rest, most = zlib.decompressobj(kind), head, 1 << 16
        while True:
            try:
                out = d.decompress(rest, most)
            except zlib.error:
                return
            if out:
                yield out
            if d.eof:
                rest, d = d.unused_data or next(data, b""), zlib.decompressobj(kind)
            elif len(out) == most:
                rest = d.unconsumed_tail
                continue
            else:
                rest = d.unconsumed_tail or next(data, b"")
            if not rest:
                return

    return run()


def _chained(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def _texts(data: bytes) -> tuple[str, Iterator[str]]:
    """(compressions, the content's text in pieces); no pieces where it isn't text. Content may be compressed more than once.

    Text is UTF-8 of which at most one character in ten is a control character.
    """
    how, stream = "", iter([data])
    while True:
        head = next(stream, b"")
        inner = _inflated(_chained(head, stream))
        if inner is None:
            break
        how += ">gzip" if head[:2] == b"\x1f\x8b" else ">zlib"
        stream = inner

    def run() -> Iterator[str]:
        decoder = codecs.getincrementaldecoder("utf-8")()
        text = ""
        try:
            for part in _chained(head, stream):
                text += decoder.decode(part)
                while len(text) >= PIECE + SEAM:
                    yield text[: PIECE + SEAM]
                    text = text[PIECE:]
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            if not how:
                return
        if text:
            yield text

    return how, (t for t in run() if 10 * sum(not (c.isprintable() or c in "\t\n\r") for c in t[:PIECE]) <= len(t))


def _base64(run: str) -> tuple[str, list[str]]:
    """(encodings, pieces of text) of a base64 run; no pieces where it isn't one."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return "", []
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return "", []
    how, pieces = _texts(data)
    out = []
    for p in pieces:  # of content in several pieces only those matter in which there is anything to find
        if not out or pc.match_substring_regex(pa.array([p]), TRIGGER)[0].as_py():
            out.append(p)
    return "base64" + how, out


class Spans:
    """Where a layer's characters come from: of segment k, from character out[k] on, each stems from one at lo[k] + its number, or all from lo[k] to hi[k]."""

    def __init__(self) -> None:
        self.out: list[int] = []
        self.lo: list[int] = []
        self.hi: list[int | None] = []
        self.length = 0

    def add(self, n: int, lo: int, hi: int | None = None) -> None:
        if n:
            self.out.append(self.length)
            self.lo.append(lo)
            self.hi.append(hi)
            self.length += n

    def of(self, a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(self.out, a) - 1, bisect_right(self.out, max(a, b - 1)) - 1
        start = self.lo[i] if self.hi[i] is not None else self.lo[i] + a - self.out[i]
        end = self.hi[j] if self.hi[j] is not None else self.lo[j] + max(a + 1, b) - self.out[j]
        return start, end


class Content:
    """A distinct text among a document's layers, with its finds and every place where it stands in another.

    found: (start, end, secret) -> (kind, layers below this one), in this text's characters. Places: (the other text, rank among
    its layers, encoding, spans).
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.found: dict[tuple[int, int, str], tuple[str, tuple[str, ...]]] = {}
        self.places: list[tuple[Content, int, str, Spans]] = []


def _decoded(line: str, at: int, one: re.Pattern, decode: Callable[[re.Match], str]) -> tuple[str, Spans] | None:
    """The line, which begins at `at`, with each match of `one` decoded; None if that changes nothing."""
    parts, spans, end = [], Spans(), 0
    for m in one.finditer(line):
        new = decode(m)
        if new == m[0]:
            continue
        parts += [line[end : m.start()], new]
        spans.add(m.start() - end, at + end)
        if 3 * len(new.encode()) == len(m[0]) > 3:  # a run of %XX: each character has its own bytes
            first = at + m.start()
            for c in new:
                spans.add(1, first, first + 3 * len(c.encode()))
                first += 3 * len(c.encode())
        else:
            spans.add(len(new), at + m.start(), at + m.end())
        end = m.end()
    if not end:
        return None
    parts.append(line[end:])
    spans.add(len(line) - end, at + end)
    return "".join(parts), spans


def _layers(text: str) -> Iterator[tuple[str, str, Spans]]:
    """(content, encoding, spans) of all layers of the text's lines."""
    known: dict[str, tuple[str, list[str]]] = {}
    for m in _LINE.finditer(text):
        line = m[0]
        for how, one, decode in (("url", _URL_ONE, _unquote), ("unicode", _UNI_ONE, _unescape)):
            if (new := _decoded(line, m.start(), one, decode)) is not None:
                yield new[0], how, new[1]
        runs = [r for r in _B64.finditer(line)]
        for r in runs:
            if r[0] not in known:
                known[r[0]] = _base64(r[0])
        good = [r for r in runs if known[r[0]][1]]
        for how in dict.fromkeys(known[r[0]][0] for r in good):
            rank = 0
            while some := [r for r in good if known[r[0]][0] == how and len(known[r[0]][1]) > rank]:
                parts, spans, end = [], Spans(), 0
                for r in some:
                    new = known[r[0]][1][rank]
                    parts += [line[end : r.start()], new]
                    spans.add(r.start() - end, m.start() + end)
                    spans.add(len(new), m.start() + r.start(), m.start() + r.end())
                    end = r.end()
                spans.add(len(line) - end, m.start() + end)
                yield "".join([*parts, line[end:]]), how, spans
                rank += 1


def finds(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the secrets that stand in the text as it is."""
    taken: list[tuple[int, int]] = []  # in order, without overlap
    for kind, finder in FINDERS.items():
        for a, b in finder(text):
            k = bisect_right(taken, (a, len(text) + 1))
            if k and taken[k - 1][1] > a or k < len(taken) and taken[k][0] < b:
                continue
            taken.insert(k, (a, b))
            yield kind, a, b


def scan(text: str) -> list[tuple[str, str, int, int, str]]:
    """(kind, layers, start, end, secret) of all secrets, by place; of one secret in one place the outermost layer's report."""
    root = Content(text)
    work, contents = deque([root]), {text: root}
    new: list[tuple[Content, tuple[int, int, str]]] = []
    while work:
        at = work.popleft()
        for kind, a, b in finds(at.text):
            at.found[a, b, at.text[a:b]] = kind, ()
        for rank, (inner, how, spans) in enumerate(_layers(at.text)):
            if inner not in contents:
                contents[inner] = Content(inner)
                work.append(contents[inner])
            contents[inner].places.append((at, rank, how, spans))
        new += [(at, key) for key in at.found]
    # finds rise one layer at a time to all places of their text; each is kept once in a text, so cycles end
    while new:
        risen: dict[tuple[int, tuple[int, int, str]], tuple] = {}
        for at, (a, b, secret) in new:
            kind, chain = at.found[a, b, secret]
            for parent, rank, how, spans in at.places:
                key = *spans.of(a, b), secret
                best = risen.get((id(parent), key))
                if key not in parent.found and (best is None or rank < best[1]):
                    risen[id(parent), key] = parent, rank, kind, (how, *chain)
        for (_, key), (parent, _, kind, chain) in risen.items():
            parent.found[key] = kind, chain
        new = [(parent, key) for (_, key), (parent, *_) in risen.items()]
    return sorted((kind, ">".join(chain), a, b, secret) for (a, b, secret), (kind, chain) in root.found.items())


def redact(text: str, found: list[tuple[str, str, int, int, str]]) -> str:
    """text with each found span, overlapping ones together, replaced by [REDACTED:kind]."""
    merged: list[list] = []
    for kind, _, a, b, _ in sorted(found, key=lambda f: (f[2], -f[3])):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    for a, b, kind in reversed(merged):
        text = f"{text[:a]}[REDACTED:{kind}]{text[b:]}"
    return text


def _triggered(texts: pa.Array) -> list[int]:
    return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, TRIGGER), False)).to_pylist()


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, layers, start, end, secret_sha256) of every secret; start and end are characters of the text.

    Null and empty texts have none. Rows with a null doc_id are reported with a null doc_id, repeated rows each. The
    secret itself isn't in the result. Texts of any length are scanned whole, in time and memory in proportion. An empty table
    gives an empty result. Other columns don't matter.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"]
            rows = [(k, *f) for k in _triggered(texts) for f in scan(texts[k].as_py())]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.record_batch({"doc_id": b["doc_id"].take(pa.array(cols[0], pa.int64())), "kind": pa.array(cols[1], pa.string()), "layers": pa.array(cols[2], pa.string()), "start": pa.array(cols[3], pa.int32()), "end": pa.array(cols[4], pa.int32()), "secret_sha256": pa.array([hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest() for s in cols[5]], pa.string())})

    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, kind string, layers string, start int, end int, secret_sha256 string")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with secrets in `text` replaced by [REDACTED:kind], and `n_chars`, if it is a column of integers, renewed for the changed texts.

    Everything else, null and empty texts and rows with a null doc_id included, stays as it is; repeated rows are changed alike. Texts
    of any length are scanned whole. A table without text stays as it is. No other column is changed, whatever its name.
    """
    tune(docs.sparkSession)
    plain = numbered(docs)
    text, count = place(docs, "text"), place(docs, "n_chars")
    if text is None:
        return docs
    if count is not None and plain.schema[count].dataType.typeName() not in ("byte", "short", "integer", "long"):
        count = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b[text]
            changed = {k: redact(texts[k].as_py(), f) for k in _triggered(texts) if (f := scan(texts[k].as_py()))}
            if changed:
                cols = {n: b[n] for n in b.schema.names}
                every = texts.to_pylist()
                for k, t in changed.items():
                    every[k] = t
                cols[text] = pa.array(every, texts.type)
                if count is not None:
                    counts = b[count].to_pylist()
                    for k, t in changed.items():
                        counts[k] = len(t)
                    cols[count] = pa.array(counts, b[count].type)
                b = pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
            yield b

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def encode_layers(text: str, how: list[str]) -> str:
    """text in the given encodings, the first innermost: url, unicode, base64, gzip64, zlib64. For tests."""
    for h in how:
        data = text.encode()
        text = {
            "url": lambda: "".join(f"%{x:02X}" for x in data),
            "unicode": lambda: "".join(f"\\u{ord(c):04x}" for c in text),
            "base64": lambda: base64.b64encode(data).decode(),
            "gzip64": lambda: base64.b64encode(gzip.compress(data, mtime=0)).decode(),
            "zlib64": lambda: base64.b64encode(zlib.compress(data)).decode(),
        }[h]()
    return text

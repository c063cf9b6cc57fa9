"""Secret scans with structural confirmation.

Base patterns are reported as they match. Further kinds are only reported when what they
hold decodes and parses: a PEM block (also with escaped line breaks, with headers, or encrypted) or a base64 or
hex run whose bytes are a DER key, with every nested length inside the one around it; a base64 run with the magic and the length-prefixed
strings of an OpenSSH key; a token of three base64url parts whose first is a JSON
header that names an algorithm.

Defined results: a null text is empty; offsets are code points, ends are exclusive; repeated rows
and null ids are scanned like others; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuesift.llm.common import batched, rows_of, small_batches, text_of


class Span(NamedTuple):
    start: int
    order: int
    kind: str
    end: int


# Fixed patterns of the base kinds.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32

KINDS = ("assign", "access", "hex", "pem_key", "base64_key", "hex_key", "signed_token")
_ORDER = {kind: at for at, kind in enumerate(KINDS)}

# Line breaks may be escaped once or more, as in JSON; lines of headers may stand before the base64.
_PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----(?:\s|\\++[nrt])*+"
    r"((?:[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]{0,200}+(?:\s|\\++[nrt])++)*+)"
    r"((?:[A-Za-z0-9+/=\s]|\\++(?:[nrt/]|u003[dD]))++)-----END \1-----"
)
_ESCAPE = re.compile(r"\\+(?:[nrt]|u003[dD])")
_CIPHER = re.compile(r"DEK-Info:[ \t]*[A-Za-z0-9-]+,[ \t]*([0-9A-Fa-f]+)")
# One run, or lines of one length and a last one, with line breaks as they are or escaped.
_BASE64 = re.compile(
    r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{64,}+(?:(?:\r?\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/]{48,}+)*+"
    r"(?:(?:\r?\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/]+)?+={0,2}"
)
_URL_BASE64 = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9]*+[_-])[A-Za-z0-9_-]{64,}={0,2}")
_BREAK = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]*")
_ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{96,}")
# A header begins with a brace: "e" and one of the next characters. A full stop behind a token ends a sentence, unless a further part follows.
_TOKEN = re.compile(
    r"(?<![A-Za-z0-9_.-])(e[w-z0-9_-][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-]|\.[A-Za-z0-9_-])"
)
_SSH_MAGIC = b"openssh-key-v1\x00"
# Object identifiers of password based encryption: PKCS #5 and PKCS #12.
_PASSWORD_SCHEMES = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
_INTEGER, _OCTETS, _OBJECT, _SEQUENCE, _CONSTRUCTED = 0x02, 0x04, 0x06, 0x30, 0x20


def _value(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag of the DER value at ``at``, begin and end of its content; None if it does not fit."""
    if at + 2 > end:
        return None
    tag, length, begin = data[at], data[at + 1], at + 2
    if length & 0x80:
        size = length & 0x7F
        if not 0 < size <= 4 or begin + size > end:
            return None
        length, begin = int.from_bytes(data[begin:begin + size], "big"), begin + size
        if length < 0x80:
            return None
    return (tag, begin, begin + length) if begin + length <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill ``at`` to ``end`` exactly."""
    found = []
    while at < end:
        value = _value(data, at, end)
        if value is None:
            return None
        found.append(value)
        at = value[2]
    return found


def _encryption(data: bytes, parts: list[tuple[int, int, int]]) -> bytes | None:
    """The object identifier of the scheme, if the parts are those of an encrypted PKCS#8 key."""
    if [tag for tag, _, _ in parts] != [_SEQUENCE, _OCTETS] or parts[1][2] - parts[1][1] < 16:
        return None
    algorithm = _children(data, parts[0][1], parts[0][2])
    if not algorithm or algorithm[0][0] != _OBJECT:
        return None
    return data[algorithm[0][1]:algorithm[0][2]]


def is_der_key(data: bytes) -> bool:
    """Private keys: RSA (nine numbers), DSA (six), elliptic curve, PKCS#8 around any of them, and PKCS#8
    encrypted with a password."""
    outer = _value(data, 0, len(data))
    if outer is None or outer[0] != _SEQUENCE or outer[2] != len(data):
        return False
    parts = _children(data, outer[1], outer[2])
    if parts and parts[0][0] == _SEQUENCE:
        scheme = _encryption(data, parts)
        return scheme is not None and scheme.startswith(_PASSWORD_SCHEMES)
    if not parts or parts[0][0] != _INTEGER or not 1 <= parts[0][2] - parts[0][1] <= 2:
        return False
    tags = [tag for tag, _, _ in parts]
    if tags[:9] == [_INTEGER] * 9:
        return True
    if tags == [_INTEGER] * 6:
        version, p, q, g, y, x = (data[begin:end].lstrip(b"\x00") for _, begin, end in parts)
        return not version and len(p) >= 64 and len(p) > len(q) >= len(x) > 0 and 0 < max(len(g), len(y)) <= len(p)
    if len(parts) >= 2 and tags[1] == _OCTETS and all(tag & 0xE0 == 0xA0 for tag in tags[2:]):
        return parts[1][2] - parts[1][1] >= 16 and len(parts) > 2
    if len(parts) >= 3 and tags[1] == _SEQUENCE and tags[2] == _OCTETS:
        algorithm = _children(data, parts[1][1], parts[1][2])
        return bool(algorithm) and algorithm[0][0] == _OBJECT
    return False


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH keys: magic, three strings, a count, and as many further strings."""
    if not data.startswith(_SSH_MAGIC):
        return False
    at = len(_SSH_MAGIC)

    def number() -> int | None:
        nonlocal at
        at += 4
        return int.from_bytes(data[at - 4:at], "big") if at <= len(data) else None

    def string() -> bool:
        nonlocal at
        length = number()
        if length is None or at + length > len(data):
            return False
        at += length
        return True

    if not all(string() for _ in range(3)):
        return False
    keys = number()
    return keys is not None and 0 < keys <= 64 and all(string() for _ in range(keys + 1))


def _from_base64(text: str) -> bytes | None:
    compact = "".join(text.split()).rstrip("=")
    try:
        return base64.b64decode(compact + "=" * (-len(compact) % 4), validate=True)
    except binascii.Error:
        return None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    """A JSON header with ``alg``; a signature unless that is ``none``; a payload that is a JSON object."""
    try:
        parts = [base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)) for part in (header, payload, signature)]
        read, said = json.loads(parts[0]), json.loads(parts[1])
    except (ValueError, RecursionError):
        return False
    if not isinstance(read, dict) or not isinstance(read.get("alg"), str):
        return False
    return isinstance(said, dict) and (bool(parts[2]) or read["alg"].lower() == "none")


def _is_key(data: bytes | None) -> bool:
    return data is not None and (is_der_key(data) or is_ssh_key(data))


def _holds_key(data: bytes | None) -> bool:
    """A key, or a text in which one stands in PEM form; what is decoded is looked at once."""
    if _is_key(data):
        return True
    text = data.decode("latin-1") if data and b"PRIVATE KEY" in data else ""
    return any(_is_pem_key(*found.groups()) for found in _PEM.finditer(text))


def _base64_key(text: str, start: int) -> tuple[int, int] | None:
    """The span of a key in a base64 candidate that begins at ``start``: all lines, or all but the last, which may be
    a word of the text."""
    breaks = list(_BREAK.finditer(text))
    for end in [len(text)] + ([breaks[-1].start()] if breaks else []):
        if _holds_key(_from_base64(_BREAK.sub("", text[:end]))):
            return start, start + end
    return None


def _is_pem_key(label: str, headers: str, body: str) -> bool:
    """The body holds a key, or one that the label or the headers call encrypted: then by any scheme, or in
    whole blocks of the size of the initial vector."""
    data = _from_base64(_ESCAPE.sub("", body).replace("\\", ""))
    if not data:
        return False
    if _is_key(data):
        return True
    cipher = _CIPHER.search(headers) if "ENCRYPTED" in headers else None
    if cipher:
        block = len(cipher[1]) // 2
        return len(cipher[1]) in (16, 32) and len(data) >= 2 * block and len(data) % block == 0
    if "ENCRYPTED" in label:
        outer = _value(data, 0, len(data))
        parts = _children(data, outer[1], outer[2]) if outer and outer[0] == _SEQUENCE and outer[2] == len(data) else None
        return bool(parts) and _encryption(data, parts) is not None
    return False


def find_secrets(text: str) -> list[Span]:
    """All spans in order of start, then kind."""
    found = [
        ("assign", m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS
    ] + [
        ("access", m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS
    ] + [
        ("hex", m.span()) for m in _HEX.finditer(text) if len(m[0]) >= HEX_CHARS
    ]
    if "PRIVATE KEY" in text:
        found += [("pem_key", m.span()) for m in _PEM.finditer(text) if _is_pem_key(*m.groups())]
    keys = (_base64_key(m[0], m.start()) for m in _BASE64.finditer(text))
    found += [("base64_key", span) for span in keys if span]
    found += [
        ("base64_key", m.span()) for m in _URL_BASE64.finditer(text)
        if _holds_key(_from_base64(m[0].replace("-", "+").replace("_", "/")))
    ]
    found += [
        ("hex_key", m.span()) for m in _ANY_HEX.finditer(text)
        if len(m[0]) % 2 == 0 and _holds_key(bytes.fromhex(m[0]))
    ]
    found += [("signed_token", m.span()) for m in _TOKEN.finditer(text) if is_signed_token(*m.groups())]
    return sorted(Span(start, _ORDER[kind], kind, end) for kind, (start, end) in found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{span.kind}:{span.start}:{span.end}" for span in spans)


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()), ("n_confirmed", pa.int64()),
])


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches):
                spans = find_secrets(text)
                base = [span for span in spans if span.kind in KINDS[:3]]
                counts = [sum(span.kind == kind for span in base) for kind in KINDS[:3]]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                yield doc_id, *counts, digest, written(spans), len(spans) - len(base)

        return batched(each(), _SCHEMA)

    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long",
    )

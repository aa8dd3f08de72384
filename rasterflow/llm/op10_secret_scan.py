"""Secret scan: pattern candidates, then structural confirmation of what they decode to.

Base kinds are patterns. Further kinds are reported only when a decoded candidate has
the structure of a credential:

* ``jwt``: three base64url parts whose header decodes to JSON with an algorithm and whose
  payload decodes to a JSON object;
* ``rsa``, ``dsa``, ``ec``, ``pkcs8``, ``encrypted``, ``pkcs12``: base64 or hex that decodes to DER with the fields of
  a private key (PKCS#1, the traditional DSA form, SEC1, PrivateKeyInfo, EncryptedPrivateKeyInfo) or of a key store, with
  all nested lengths adding up;
* ``openssh``: base64 of an OpenSSH private key, field by field to its end.

The outermost length tells where a key ends, so base64 and hex may be wrapped in lines of any width, with or without
armour. An armoured block is one span from its first to its last mark; ``encrypted`` is also one of whole cipher blocks under
a header that names the cipher and its initial vector. Public keys, certificates and signatures are left.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import documents

#: The base patterns. The keyword's letters count in either case, ASCII only.
BASE = {
    "assign": re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
}
KINDS = ["assign", "access", "hex", "jwt", "rsa", "dsa", "ec", "pkcs8", "encrypted", "pkcs12", "openssh"]

#: The first characters are those of a brace or of JSON's white space.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([eICD][A-Za-z0-9_-]{7,}+)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)")
#: A sequence of at least 16 bytes begins so in base64 and hex, an OpenSSH key so in base64.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-P]|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/]{6}")
_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{14}")
_BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
_PAD = re.compile("={0,2}")
_RUN = {4: re.compile(r"[A-Za-z0-9+/]+"), 2: re.compile(r"[0-9A-Fa-f]+")}
#: The closing dashes may open the next mark.
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]++)(?=-----)")
_NOT_BODY = re.compile(r"[^A-Za-z0-9+/=\s:,.-]")
_DEK = re.compile(r"(?m)^Proc-Type:\s*4,\s*ENCRYPTED\s*$\s*^DEK-Info:\s*([A-Z0-9-]+),\s*([0-9A-Fa-f]+)\s*$")
_OPENSSH = b"openssh-key-v1\x00"
#: Identifiers of encryption by password (PKCS#5, PKCS#12) and of the contents of a key store, as DER.
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_STORE = (bytes.fromhex("2a864886f70d010701"), bytes.fromhex("2a864886f70d010702"))


def _b64(s: str, url: bool = False) -> bytes | None:
    s = s.rstrip("=")
    if len(s) % 4 == 1:
        return None
    s += "=" * (-len(s) % 4)
    try:
        return base64.b64decode(s.translate(str.maketrans("-_", "+/")) if url else s, validate=True)
    except (binascii.Error, ValueError):
        return None


def _is_jwt(header: str, payload: str) -> bool:
    try:
        head, body = (json.loads((_b64(x, True) or b"").decode()) for x in (header, payload))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str) and bool(head["alg"])


def _element(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end of the contents) of the DER element at a place; null where its length isn't DER or doesn't fit."""
    if end - at < 2:
        return None
    tag, length, at = b[at], b[at + 1], at + 2
    if tag & 31 == 31 or tag == 0:
        return None
    if length & 128:
        k = length & 127
        if not 1 <= k <= 4 or at + k > end or b[at] == 0:
            return None
        length, at = int.from_bytes(b[at : at + k], "big"), at + k
        if length < 128:
            return None
    return (tag, at, at + length) if at + length <= end else None


def _elements(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements side by side from at to end."""
    out = []
    while at < end:
        if (e := _element(b, at, end)) is None:
            return None
        out.append(e)
        at = e[2]
    return out


def _nested(b: bytes) -> bool:
    """Whether all nested lengths add up, at any depth."""
    at, ends = 0, [len(b)]
    while ends:
        if at == ends[-1]:
            ends.pop()
        elif (e := _element(b, at, ends[-1])) is None or e[0] == 2 and e[1] == e[2] or e[0] == 6 and (e[1] == e[2] or b[e[2] - 1] & 128):
            return False
        elif e[0] & 32:
            ends.append(e[2])
            at = e[1]
        else:
            at = e[2]
    return True


def key_kind(b: bytes) -> str | None:
    """The kind of private key or key store that DER is, by its fields; null for anything else."""
    outer = _element(b, 0, len(b))
    if not outer or outer[0] != 0x30 or outer[2] != len(b) or not (e := _elements(b, outer[1], outer[2])):
        return None
    tags = [t for t, _, _ in e]
    size = lambda i: e[i][2] - e[i][1]
    version = int.from_bytes(b[e[0][1] : e[0][2]], "big") if tags[0] == 2 and size(0) == 1 else -1
    found = None
    if version in (0, 1) and tags in ([2] * 9, [2] * 9 + [0x30]) and size(1) >= 16:
        found = "rsa"
    elif version == 0 and tags == [2] * 6 and size(1) >= 16:
        found = "dsa"
    elif version == 1 and tags[1:2] == [4] and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1]) and size(1) >= 16:
        found = "ec"
    elif version in (0, 1) and tags[1:3] == [0x30, 4] and tags[3:] in ([], [0xA0], [0x81], [0xA1], [0xA0, 0x81], [0xA0, 0xA1]) and size(2) >= 16:
        found = "pkcs8" if _identifier(b, e[1]) else None
    elif tags == [0x30, 4] and size(1) >= 16:
        found = "encrypted" if (_identifier(b, e[0]) or b"").startswith(_PBE) else None
    elif version == 3 and tags[1:2] == [0x30] and tags[2:] in ([], [0x30]):
        found = "pkcs12" if _identifier(b, e[1]) in _STORE else None
    return found if found and _nested(b) else None


def _identifier(b: bytes, e: tuple[int, int, int]) -> bytes | None:
    """The object identifier that a sequence begins with."""
    inner = _element(b, e[1], e[2])
    return b[inner[1] : inner[2]] if inner and inner[0] == 6 else None


def _is_sealed(headers: str, b: bytes) -> bool:
    """Whether the body of an encrypted block is whole cipher blocks and its vector one block."""
    if not (m := _DEK.search(headers)):
        return False
    block = 16 if m[1].startswith("AES") else 8
    return len(m[2]) == 2 * block and len(b) >= 2 * block and len(b) % block == 0


def openssh_length(b: bytes) -> int:
    """Where the fields of an OpenSSH key end: cipher, derivation, its options, the number of keys, that many public keys and one private part; 0 if they don't fit."""
    at, fields, n = len(_OPENSSH), [], -1
    if not b.startswith(_OPENSSH):
        return 0
    while n < 0 or len(fields) < 4 + n:
        if len(fields) == 3 and n < 0:
            n, at = int.from_bytes(b[at : at + 4], "big"), at + 4
            if not 1 <= n <= len(b):
                return 0
            continue
        size = int.from_bytes(b[at : at + 4], "big")
        if at + 4 + size > len(b):
            return 0
        fields.append(size)
        at += 4 + size
    return at if fields[0] > 0 and fields[-1] >= 16 else 0


def is_openssh(b: bytes) -> bool:
    return len(b) > 0 and openssh_length(b) == len(b)


def _said(b: bytes) -> int:
    """How many bytes a sequence says that it has, with its own head; 0 if it doesn't begin like a key."""
    if len(b) < 6 or b[0] != 0x30 or b[1] == 128 or b[1] > 132:
        return 0
    k = b[1] & 127 if b[1] & 128 else 0
    inner = b[2 + k : 4 + k]
    if inner and inner[0] not in (2, 0x30) or inner[:1] == b"\2" and inner[1:2] not in (b"", b"\1"):
        return 0
    return 2 + k + (int.from_bytes(b[2 : 2 + k], "big") if k else b[1])


def _unwrapped(text: str, at: int, n: int, per: int) -> tuple[str, int] | None:
    """(n characters of base64 or hex from a place on, across line ends, where they end); null if there are fewer or more on the last line."""
    parts, left = [], n
    while left:
        if (m := _RUN[per].match(text, at)) is None:
            return None
        run = m[0]
        if len(run) > left:
            return None
        parts.append(run)
        left, at = left - len(run), m.end()
        if left:
            if (m := _BREAK.match(text, at)) is None:
                return None
            at = m.end()
    return "".join(parts), at


def _bare(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of keys in base64 or hex without armour, wrapped or not."""
    for m in _BASE64.finditer(text):
        at = m.start()
        if text[at] == "b":
            run, end = [], at
            while piece := _RUN[4].match(text, end):
                run.append(piece[0])
                if (gap := _BREAK.match(text, piece.end())) is None:
                    break
                end = gap.end()
            run = "".join(run)
            total = openssh_length(_b64(run[: len(run) // 4 * 4 + (len(run) % 4 > 1) * (len(run) % 4)]) or b"")
            if total and (got := _unwrapped(text, at, -(-total * 8 // 6), 4)):
                yield "openssh", at, got[1] + len(_PAD.match(text, got[1])[0])
            continue
        total = _said(_b64(text[at : at + 8]) or b"")
        if total >= 24 and total <= len(text) - at and (got := _unwrapped(text, at, -(-total * 8 // 6), 4)):
            kind = key_kind((_b64(got[0]) or b"")[:total])
            if kind:
                yield kind, at, got[1] + len(_PAD.match(text, got[1])[0])
    for m in _HEX.finditer(text):
        total = _said(bytes.fromhex(m[0]))
        if total >= 24 and 2 * total <= len(text) - m.start() and (got := _unwrapped(text, m.start(), 2 * total, 2)):
            if kind := key_kind(bytes.fromhex(got[0])):
                yield kind, m.start(), got[1]


def _armoured(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, label, body) of blocks from a BEGIN mark to the next END mark of its label, one after the other.

    Bodies hold nothing but base64, header characters and white space; their length has no limit. Marks are
    found once and looked up in order, and so is the next character that no body has: the time is linear.
    """
    begins, ends = [], {}
    for m in _MARK.finditer(text):
        if m[1] == "END":
            ends.setdefault(m[2], []).append(m.start())
        else:
            begins.append((m.start(), m.end() + 5, m[2]))
    after, bad = 0, -1
    for start, body, label in begins:
        if start < after or label not in ends:
            continue
        at = bisect_left(ends[label], body)
        if at == len(ends[label]):
            continue
        if bad < body:
            bad = m.start() if (m := _NOT_BODY.search(text, body)) else len(text)
        stop = ends[label][at]
        if stop <= bad:
            after = stop + len("-----END -----") + len(label)
            yield start, after, label, text[body:stop]


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of a text, by start and then by kind, in code points."""
    found: set[tuple[int, int, str, int]] = set()
    add = lambda kind, m: found.add((m.start(), KINDS.index(kind), kind, m.end()))
    if "=" in text or ":" in text:
        for m in BASE["assign"].finditer(text):
            if len(m[2]) >= 8:
                add("assign", m)
    if "AKIA" in text:
        for m in BASE["access"].finditer(text):
            if m.end() - m.start() >= 16:
                add("access", m)
    for m in BASE["hex"].finditer(text):
        add("hex", m)
    for m in _JWT.finditer(text):
        if _is_jwt(m[1], m[2]):
            add("jwt", m)
    armoured = []
    if "-----BEGIN " in text:
        for start, end, _, inner in _armoured(text):
            body = re.sub(r"\s+", "", re.sub(r"(?m)^[A-Za-z-]+:.*$", "", inner))
            b = _b64(body)
            kind = b and (key_kind(b) or is_openssh(b) and "openssh" or _is_sealed(inner, b) and "encrypted")
            if kind:
                found.add((start, KINDS.index(kind), kind, end))
                armoured.append((start, end))
    starts = [start for start, _ in armoured]
    for kind, start, end in _bare(text):
        k = bisect_left(starts, start + 1) - 1
        if k < 0 or start >= armoured[k][1]:
            found.add((start, KINDS.index(kind), kind, end))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names. A null
    text counts as empty and has no spans; base_sha256 is then that of the empty string.
    Null doc_ids pass through, repeated rows are scanned each, an empty table gives none.
    Whole texts of any length are scanned, in time linear in it, one Arrow batch at a time.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                all_ = spans(text.as_py() or "")
                told = [f"{k}:{s}:{e}" for k, s, e in all_]
                base = [x for x, (k, _, _) in zip(told, all_, strict=True) if k in BASE]
                kinds = [k for k, _, _ in all_]
                out.append((*[kinds.count(k) for k in BASE], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(told)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(x, f.type) for x, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    return scan(documents(spark, sf_dir))

"""Secret scans with structural confirmation: what decodes as a key or a signed token is reported, what does not is not."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from docketry.llm._shared import map_arrow

# Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: In the order in which spans of one start are listed: the base kinds, then the confirmed ones.
KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
#: Kinds of elements in key encodings: numbers, strings, null, names, sequences and their tagged parts.
KEY_TAGS, MAX_DEPTH, MIN_KEY = (0x02, 0x03, 0x04, 0x05, 0x06, 0x30, 0xA0, 0xA1), 16, 16
SSH_MAGIC = b"openssh-key-v1\x00"
#: Names of public keys and how many fields each has, the name included.
SSH_NAMES = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3}

#: Candidates of the structural tests: base64 over wrapped lines, hex of even length, three dotted parts.
#: Lines of a blob are joined by line ends, or by their escapes where the text is itself quoted.
JOINT = re.compile(r"\r?\n|(?:\\r)?\\n")
BLOB = re.compile(r"[A-Za-z0-9+/_-]{32,}(?:(?:\r?\n|(?:\\r)?\\n)[A-Za-z0-9+/_-]+)*={0,2}")
HEX_BLOB = re.compile(r"[0-9A-Fa-f]{32,}")
#: Where a key may begin: in base64 a sequence's tag, a short length or the magic; in hex likewise.
STARTS = re.compile(r"(?=M[A-P]|AAAA|b3BlbnNzaC1r)")
HEX_STARTS = re.compile(r"(?=30|0000|6f70656e7373682d6b6579)")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")

# Cheap tests over whole batches that never miss a match of the pattern they stand for.
MAY_ASSIGN = r"""(?i)(?:passwo?r?d|secret|token|api_?key)["']?\x20*[:=]"""
MAY_HEX, MAY_BLOB, MAY_HEX_BLOB = r"[0-9a-f]{32}", r"[A-Za-z0-9+/_-]{32}", r"[0-9A-Fa-f]{32}"


class Span(NamedTuple):
    start: int
    rank: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.rank]}:{self.start}:{self.end}"


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """Content start and end of the element at `at`, in definite minimal form; None if it doesn't fit."""
    if at + 2 > len(data):
        return None
    first, start = data[at + 1], at + 2
    if first < 0x80:
        size = first
    else:
        n = first & 0x7F
        if not 1 <= n <= 4 or start + n > len(data) or data[start] == 0:
            return None
        size, start = int.from_bytes(data[start : start + n], "big"), start + n
        if size < 0x80:
            return None
    return (start, start + size) if start + size <= len(data) else None


def nested(data: bytes, at: int, end: int, depth: int = 0) -> tuple[int, bool] | None:
    """Of the elements that fill at..end exactly, at every level: how many stand at this level, and whether any holds a
    number, bit or octet string of key size. None if a length doesn't fit or an element is of no kind that keys hold."""
    n, large = 0, False
    while at < end:
        if data[at] not in KEY_TAGS or depth > MAX_DEPTH or (inner := der_length(data, at)) is None or inner[1] > end:
            return None
        if data[at] in (0x30, 0xA0, 0xA1):
            below = nested(data, *inner, depth + 1)
            if below is None:
                return None
            large |= below[1]
        else:
            large |= data[at] in (0x02, 0x03, 0x04) and inner[1] - inner[0] >= MIN_KEY
        n, at = n + 1, inner[1]
    return n, large


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that fills the data, whose parts nest exactly at every level and hold something of key size."""
    if len(data) < 24 or data[0] != 0x30 or (top := der_length(data, 0)) is None or top[1] != len(data):
        return False
    found = nested(data, *top)
    return found is not None and found[0] >= 2 and found[1]


def fields(data: bytes, at: int = 0, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed fields from `at` to the data's end, or the first `most`, and where they end; None if a length doesn't fit."""
    found = []
    while at < len(data) and (most is None or len(found) < most):
        if at + 4 > len(data) or (end := at + 4 + int.from_bytes(data[at : at + 4], "big")) > len(data):
            return None
        found.append(data[at + 4 : end])
        at = end
    return found, at


def is_public_key(data: bytes) -> bool:
    """Length-prefixed fields after a known key name, as many as it has, that fill the data."""
    found = fields(data)
    return found is not None and bool(found[0]) and SSH_NAMES.get(found[0][0]) == len(found[0])


def container(data: bytes) -> tuple[list[bytes], int] | None:
    """Public keys and private part of a private key container, and where it ends: magic, cipher, derivation and its options,
    the keys' number, then a field for each key and one for the private part. None if a length doesn't fit."""
    head = fields(data, len(SSH_MAGIC), 3) if data.startswith(SSH_MAGIC) else None
    if head is None or len(head[0]) < 3 or head[1] + 4 > len(data):
        return None
    n = int.from_bytes(data[head[1] : head[1] + 4], "big")
    body = fields(data, head[1] + 4, n + 1)
    return body if body is not None and n >= 1 and len(body[0]) == n + 1 else None


def is_ssh_key(data: bytes) -> bool:
    """A public key, or a private key container whose public keys are such and whose private part is of key size."""
    if not data.startswith(SSH_MAGIC):
        return is_public_key(data)
    found = container(data)
    return found is not None and found[1] == len(data) and all(map(is_public_key, found[0][:-1])) and len(found[0][-1]) >= MIN_KEY


def key_size(data: bytes) -> int | None:
    """How many of the bytes the key takes that they begin with, as its own lengths tell; None if they begin with none."""
    if data[:1] == b"\x30":
        found = der_length(data, 0)
        return found[1] if found else None
    if data.startswith(SSH_MAGIC):
        found = container(data)
        return found[1] if found else None
    name = fields(data, 0, 1)
    if not name or not name[0] or name[0][0] not in SSH_NAMES:
        return None
    found = fields(data, 0, SSH_NAMES[name[0][0]])
    return found[1] if found else None


def decoded(text: str) -> bytes | None:
    """Base64, either alphabet, padding optional; None if it is none."""
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    """The first part decodes to a JSON object with an alg, the second to a JSON object; only alg none may lack a signature."""
    parts = []
    for part in (header, payload):
        try:
            parts.append(json.loads(decoded(part) or b""))
        except (ValueError, RecursionError):
            return False
    if not all(isinstance(p, dict) for p in parts) or not isinstance(alg := parts[0].get("alg"), str):
        return False
    return bool(decoded(signature)) if alg.lower() != "none" else True


def base_spans(text: str, assign: bool = True, access: bool = True, hexed: bool = True) -> list[Span]:
    """The base kinds, each leftmost and without overlaps, too short ones dropped."""
    found = []
    if assign:
        found += [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if access:
        found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if hexed:
        found += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    return sorted(found)


def key_rank(data: bytes) -> int | None:
    """The kind of key that fills the data."""
    return 3 if is_der_key(data) else 4 if is_ssh_key(data) else None


def key_in(body: str, at: int, ends: set[int]) -> tuple[int, int] | None:
    """Kind and end of the key that begins at a place of joined base64 lines and ends where a line does; its own lengths tell which."""
    head = decoded(body[at : at + 32]) or b""
    if head[:1] == b"\x30":
        n = head[1] & 0x7F if len(head) > 1 and head[1] >= 0x80 else 0
        size = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1]) if n <= 4 and len(head) > 2 + n else None
    elif head.startswith(SSH_MAGIC) or any(head[4:].startswith(name) for name in SSH_NAMES):
        rest = body[at:]
        size = key_size(decoded(rest[: len(rest) - (len(rest) % 4 == 1)]) or b"")
    else:
        size = None
    if size is None or (end := at + -(-size * 4 // 3)) not in ends:
        return None
    rank = key_rank(decoded(body[at:end]) or b"")
    return None if rank is None else (rank, end)


def keys_in_lines(text: str, start: int, end: int) -> list[Span]:
    """Keys in a run of base64 lines, wherever in a line they begin; the search goes on behind each."""
    joints = [m.span() for m in JOINT.finditer(text, start, end)]
    starts, stops = [start, *(j[1] for j in joints)], [*(j[0] for j in joints), end]
    pieces = [text[a:b] for a, b in zip(starts, stops, strict=True)]
    pieces[-1] = pieces[-1].rstrip("=")
    body, places = "".join(pieces), [0, *accumulate(map(len, pieces))]
    ends, found, at = set(places), [], 0
    while m := STARTS.search(body, at):
        at = m.start() + 1
        if key := key_in(body, m.start(), ends):
            rank, at = key
            first, last = bisect_right(places, m.start()) - 1, bisect_left(places, at) - 1
            found.append(Span(starts[first] + m.start() - places[first], rank, stops[last]))
    return found


def key_in_hex(text: str, start: int, end: int) -> Span | None:
    """The key that fills a run of hex digits, whole or but for what stands before it."""
    low = text[start:end].lower()
    for m in HEX_STARTS.finditer(low):
        if (len(low) - m.start()) % 2 == 0:
            head = bytes.fromhex(low[m.start() : m.start() + 12])
            whole = head[0] != 0x30 or len(head) < 6 or (head[1] < 0x80 and 2 + head[1] or 2 + (head[1] & 0x7F) + int.from_bytes(head[2 : 2 + min(4, head[1] & 0x7F)], "big")) == (len(low) - m.start()) // 2
            if whole and (rank := key_rank(bytes.fromhex(low[m.start() :]))) is not None:
                return Span(start + m.start(), rank, end)
    return None


def confirmed_spans(text: str, blob: bool = True, hexed: bool = True, token: bool = True) -> list[Span]:
    """Spans that decode as a key encoding or a signed token."""
    found = []
    for m in BLOB.finditer(text) if blob else ():
        found += keys_in_lines(text, *m.span())
    for m in HEX_BLOB.finditer(text) if hexed else ():
        if (key := key_in_hex(text, *m.span())) is not None:
            found.append(key)
    for m in JWT.finditer(text) if token else ():
        if is_signed_token(*m.groups()):
            found.append(Span(m.start(), 5, m.end()))
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, the base spans' counts and digest, all spans as text.

    base_sha256 is over the base spans alone, written kind:start:end in code points, end exclusive, by start and then by
    the order of KINDS; `spans` adds what the structural tests confirmed: der (key encodings with nested lengths) and ssh
    (length-prefixed public keys, private key containers), both from base64 or hex, and jwt (signed tokens). A key may begin
    anywhere in a run of base64 or hex and ends with a line of it; a run's first line has 32 characters or more. Null texts count
    as empty ones and have no spans. Repeated rows are scanned one by one; other columns are ignored. No shuffle; a scan
    over the whole batch by a linear-time matcher decides which texts the exact patterns look at.
    """

    def run(batch: pa.RecordBatch) -> pa.Table:
        texts = pc.fill_null(batch.column(text_col), "")
        may = [pc.match_substring_regex(texts, p).to_pylist() for p in (MAY_ASSIGN, MAY_HEX, MAY_BLOB, MAY_HEX_BLOB)]
        may += [pc.match_substring(texts, p).to_pylist() for p in ("AKIA", "eyJ")]
        rows: list[tuple] = []
        none = hashlib.sha256(b"").hexdigest()
        for i, (assign, hexed, blob, hex_blob, access, token) in enumerate(zip(*may, strict=True)):
            if not (assign or hexed or blob or hex_blob or access or token):
                rows.append((0, 0, 0, none, ""))
                continue
            text = texts[i].as_py()
            base = base_spans(text, assign, access, hexed)
            more = confirmed_spans(text, blob, hex_blob, token)
            n = [sum(s.rank == k for s in base) for k in range(3)]
            listed = ",".join(map(str, base))
            rows.append((*n, hashlib.sha256(listed.encode()).hexdigest(), ",".join(map(str, sorted(base + more)))))
        n_assign, n_access, n_hex, digest, spans = zip(*rows, strict=True)
        return pa.table(
            {
                id_col: batch.column(id_col),
                **{k: pa.array(v, pa.int64()) for k, v in (("n_assign", n_assign), ("n_access", n_access), ("n_hex", n_hex))},
                "base_sha256": pa.array(digest, pa.string()),
                "spans": pa.array(spans, pa.string()),
            }
        )

    own = docs.select(*dict.fromkeys((id_col, text_col)))
    kind = own.schema[id_col].dataType.simpleString()
    return map_arrow(own, run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

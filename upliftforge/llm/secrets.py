"""Secret scans with structural confirmation.

Regular expressions propose candidates; encoded candidates are decoded and parsed before they
are reported: base64 (in one run, or in lines of one width) or hex blobs must hold a DER private key whose
nested lengths add up or an OpenSSH key container whose length-prefixed fields fit, base64 of text a PEM block or
another base64 key (one level), and signed tokens must have a JSON header that names its algorithm and a JSON payload.

Row-wise (one map stage, no shuffle); memory is bounded by one Arrow batch.  A null text counts as
empty.  Repeated rows give repeated results, extra columns are ignored, an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, merge_spans, release

BASE_KINDS = ("assign", "access", "hex")
CONFIRMED_KINDS = ("pem", "key_b64", "key_hex", "nested_key", "signed_token")

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
PEM_MARK = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY)-----")
DEK_INFO = re.compile(r"[A-Za-z0-9-]+,\s?(?:[0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})")
#: How base64 of a key starts: a DER sequence (byte 0x30) or OpenSSH's magic, then base64 of such base64 and of PEM marks.
KEY_START = r"(?<![A-Za-z0-9+/_-])(?:M|b3BlbnNzaC1rZXktdjE|TU|YjNCbGJuTnphQzFyWlhrdGRqR|LS0tLS1CRUdJTi)"
KEY_B64 = re.compile(KEY_START + r"[A-Za-z0-9+/_-]{47,}={0,2}")
#: The same in lines, whose breaks may be escaped.
KEY_HEAD = re.compile(KEY_START)
LINE_BREAK = re.compile(r"(?:\r?\n|\\n)[ \t]*")
KEY_LINES = re.compile(KEY_START + r"[A-Za-z0-9+/]{15,}+(?:(?:\r?\n|\\n)[ \t]*[A-Za-z0-9+/]++)+={0,2}")
KEY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:30|6f70656e7373682d6b65792d7631)[0-9A-Fa-f]{62,}", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")

INTEGER, BIT_STRING, OCTET_STRING, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def decode_b64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64 with or without padding, or None."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of a run of DER values that fills ``data`` exactly, or None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def is_dsa_key(numbers: list[int]) -> bool:
    """Version 0, prime, order, generator, public and private value in the ranges that they must have."""
    version, p, q, g, y, x = numbers
    return version == 0 and p.bit_length() >= 512 and 160 <= q.bit_length() <= 256 and 1 < g < p and 1 < y < p and 0 < x < q


def is_der_private_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted), SEC1 or traditional DSA private key with consistent nested lengths."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    inner = der_items(outer[0][1])
    if not inner:
        return False
    tags = [tag for tag, _ in inner]
    if tags[:1] == [INTEGER]:
        version = int.from_bytes(inner[0][1], "big")
        if len(inner) >= 9 and set(tags[:9]) == {INTEGER} and version in (0, 1):
            return True
        if tags == [INTEGER] * 6:
            return is_dsa_key([int.from_bytes(content, "big", signed=True) for _, content in inner])
        if tags[1:3] == [SEQUENCE, OCTET_STRING] and version in (0, 1):
            algorithm = der_items(inner[1][1])
            return bool(algorithm) and algorithm[0][0] == OID
        return tags[1:2] == [OCTET_STRING] and version == 1 and 16 <= len(inner[1][1]) <= 72
    if tags == [SEQUENCE, OCTET_STRING]:
        algorithm = der_items(inner[0][1])
        return bool(algorithm) and algorithm[0][0] == OID and len(inner[1][1]) >= 16
    return False


def is_openssh_private_key(data: bytes) -> bool:
    """OpenSSH container: magic, three names, a key count and length-prefixed blobs that fit."""
    magic, fields = b"openssh-key-v1\0", []
    if not data.startswith(magic):
        return False
    at = len(magic)
    for k in range(4):
        if k == 3:  # the number of keys stands before the blobs
            if at + 4 > len(data):
                return False
            keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
            if not 1 <= keys <= 16:
                return False
            for _ in range(keys + 1):
                size = int.from_bytes(data[at : at + 4], "big")
                if at + 4 > len(data) or at + 4 + size > len(data) or not size:
                    return False
                at += 4 + size
            return at == len(data)
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return False


def is_private_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_private_key(data) or is_openssh_private_key(data))


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    """Header and payload are JSON objects, the header names its algorithm, and a signature stands
    there unless that algorithm is ``none``."""
    parts = []
    for part in (header, payload):
        try:
            parts.append(json.loads(decode_b64(part) or b""))
        except (ValueError, RecursionError):
            return False
    if not all(isinstance(x, dict) for x in parts) or not isinstance(parts[0].get("alg"), str):
        return False
    return len(signature) >= 20 or (parts[0]["alg"].lower() == "none" and not signature)


def is_pem_body(body: str) -> bool:
    """The base64 between the marks is a private key, or one that its headers say is encrypted: with a
    cipher, an initial vector in hex, and whole blocks of it."""
    body = body.replace("\\n", "\n").replace("\r\n", "\n").strip()
    headers = {}
    if ":" in body:
        head, blank, body = body.partition("\n\n")
        lines = [line.partition(":") for line in head.split("\n")]
        if not blank or not all(colon and name.strip() for name, colon, _ in lines):
            return False
        headers = {name.strip().lower(): value.strip() for name, _, value in lines}
    data = decode_b64("".join(body.split()))
    if headers.get("proc-type", "").replace(" ", "").upper() == "4,ENCRYPTED":
        return bool(DEK_INFO.fullmatch(headers.get("dek-info", ""))) and bool(data) and len(data) >= 16 and len(data) % 8 == 0
    return is_private_key(data)


def pem_spans(text: str) -> list[tuple[int, int]]:
    """Spans from a BEGIN mark to the next END mark of its label; a BEGIN mark in between starts anew."""
    spans, begin = [], None
    for m in PEM_MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin:
            if m[2] == begin[2] and is_pem_body(text[begin.end() : m.start()]):
                spans.append((begin.start(), m.end()))
            begin = None
    return spans


def key_kind(data: bytes | None) -> str | None:
    """``key_b64`` for a private key, ``nested_key`` for ASCII text that holds a PEM block or is base64 of one."""
    if not data:
        return None
    if is_private_key(data):
        return "key_b64"
    if not data.isascii():
        return None
    text = data.decode("ascii")
    return "nested_key" if pem_spans(text) or is_private_key(decode_b64("".join(text.split()))) else None


def wrapped_keys(m: re.Match) -> list[tuple[str, int, int]]:
    """Kind, start and end of keys in a run of base64 lines: full lines of one width and a last one that is no
    wider.  What follows a key that ends with a full line may look like a last line, so both ends are tried;
    a run of full lines is tried from its first one, so that work stays linear."""
    text, found, lines, at = m.string, [], [], m.start()
    for b in LINE_BREAK.finditer(text, m.start(), m.end()):
        lines.append((at, b.start()))
        at = b.end()
    lines.append((at, m.end()))
    width = lambda k: len(text[lines[k][0] : lines[k][1]].rstrip("="))
    k = 0
    while k < len(lines):
        full = k + 1
        while full < len(lines) and width(full) == width(k):
            full += 1
        if KEY_HEAD.match(text, lines[k][0]):
            for stop in ([full + 1] if full < len(lines) and width(full) < width(k) else []) + [full]:
                kind = key_kind(decode_b64("".join(text[a:b] for a, b in lines[k:stop]))) if stop > k + 1 else None
                if kind:
                    found.append((kind, lines[k][0], lines[stop - 1][1]))
                    full = stop
                    break
        k = full
    return found


def key_spans(text: str, outside: list[tuple[int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Spans of base64 keys by kind; keys in lines only ``outside`` PEM blocks, whose bodies they are otherwise."""
    found = {"key_b64": [], "nested_key": []}
    for m in KEY_B64.finditer(text):
        kind = key_kind(decode_b64(m[0]))
        if kind:
            found[kind].append(m.span())
    starts = {start for spans in found.values() for start, _ in spans}
    for m in KEY_LINES.finditer(text):
        for kind, start, end in wrapped_keys(m):
            if start not in starts and not any(a <= start < b for a, b in outside):
                found[kind].append((start, end))
    return {kind: sorted(spans) for kind, spans in found.items()}


def scan(text: str | None) -> list[tuple[str, list[tuple[int, int]]]]:
    """Spans of each kind in one whole text, in code points, the end exclusive."""
    text = text or ""
    low = text.lower()
    pem = pem_spans(text) if "-----BEGIN " in text else []
    keys = key_spans(text, pem)
    hinted = (":" in text or "=" in text) and any(h in low for h in ASSIGN_HINTS)
    return [
        ("assign", [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if hinted else []),
        ("access", [m.span() for m in ACCESS.finditer(text)] if "AKIA" in text else []),
        ("hex", [m.span() for m in HEX.finditer(text)]),
        ("pem", pem),
        ("key_b64", keys["key_b64"]),
        ("key_hex", [m.span() for m in KEY_HEX.finditer(text) if len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0]))]),
        ("nested_key", keys["nested_key"]),
        ("signed_token", [m.span() for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2], m[3])] if "eyJ" in text else []),
    ]


def _scan_batches(batches):
    for batch in batches:
        rows = [scan(t) for t in batch.column(1).to_pylist()]
        count = lambda k: pa.array([len(r[k][1]) for r in rows], pa.int64())
        base = [merge_spans(r[: len(BASE_KINDS)]) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), count(0), count(1), count(2),
                pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                pa.array([merge_spans(r) for r in rows], pa.string()),
                pa.array([sum(len(s) for _, s in r[len(BASE_KINDS) :]) for r in rows], pa.int64()),
            ],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"],
        )
    release()


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the counts and spans of all secrets in its whole text."""
    bound_batches(docs.sparkSession)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(_scan_batches, schema)

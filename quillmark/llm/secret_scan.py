"""Secret scans by structural confirmation.

Base kinds are plain patterns. The added kinds are reported only after their bytes
have been decoded and parsed: PEM and bare DER keys by their nested lengths, OpenSSH
keys by their length-prefixed fields, signed tokens by their JSON header, and base64 or
hex text by the secret that it holds once decoded to printable UTF-8. Patterns ask for no
more characters than the shortest form that the parsers confirm. Base64 may be wrapped in
lines of one width, of four characters at least, and what was decoded may be encoded in
turn, up to three times in all. Encoded text in other wrappings (hex over several lines,
blanks within) is not joined.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order that breaks ties between spans of one start.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt", "enc")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
#: The least that is_der_key confirms has 24 bytes: 32 characters of base64, 48 of hex.
_DER64 = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-P][A-Za-z0-9+/_-]{30,}={0,2}")
_DERHEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}")
#: The least that is_ssh_key confirms has 40 bytes: 54 characters of base64, 80 of hex, the magic's among them.
_SSH64 = re.compile(r"(?<![A-Za-z0-9+/_-])b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/_-]{35,}={0,2}")
_SSHHEX = re.compile(r"(?<![0-9A-Fa-f])6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100[0-9A-Fa-f]{50,}")
#: A header that names a signature algorithm, of one letter even, has 14 characters, and claims have 3.
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{14,}\.[A-Za-z0-9_-]{3,}\.[A-Za-z0-9_-]*")
#: From the shortest secret that _holds_secret confirms, 14 bytes (token= and 8 more): 19 characters of base64, 28 of hex.
_ENC64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{19,}={0,2}")
_ENCHEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{28,}")
#: Base64 over several lines; which lines belong together is decided by their width.
_WRAP64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_LEAST_WIDTH, _LEAST_WRAPPED = 4, 19
_DEPTH = 3
_BLANKS = dict.fromkeys((9, 10, 13), " ")
_SSH_MAGIC = b"openssh-key-v1\x00"


def unbase64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it is neither."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The (tag, start, end) elements that fill data[start:end] exactly, else None."""
    items = []
    while start < end:
        if end - start < 2:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + size > end:
            return None
        items.append((tag, at, at + size))
        start = at + size
    return items


def is_der_key(data: bytes | None) -> bool:
    """A private key in PKCS#1, PKCS#8 (plain or encrypted) or SEC 1 encoding, its nested lengths agreeing to the byte."""
    if not data or data[0] != 0x30:
        return False
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1:
        return False
    inner = der_items(data, *outer[0][1:])
    if not inner:
        return False
    tags = [t for t, _, _ in inner]
    body = [data[a:b] for _, a, b in inner]
    if tags[:1] == [0x02] and len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return body[0] in (b"\x00", b"\x01") and len(body[1]) >= 32
    if tags[:3] == [0x02, 0x30, 0x04]:
        algorithm = der_items(data, *inner[1][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(body[2]) >= 16
    if tags[:2] == [0x02, 0x04]:
        return body[0] == b"\x01" and len(body[1]) in (20, 24, 28, 32, 48, 66)
    if tags == [0x30, 0x04]:
        algorithm = der_items(data, *inner[0][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(body[1]) >= 16
    return False


def is_ssh_key(data: bytes | None) -> bool:
    """An OpenSSH private key: magic, then cipher, kdf and option strings, a key count and as many public keys."""
    if not data or not data.startswith(_SSH_MAGIC):
        return False
    at = len(_SSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        return data[at - size : at] if at <= len(data) else None

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 16 and all(field() is not None for _ in range(keys)) and bool(field())


def is_signed_token(text: str) -> bool:
    """Three parts, the first a JSON object that names a signature algorithm, the second a JSON object."""
    head, body, seal = text.split(".")[:3]
    try:
        header, claims = json.loads(unbase64(head) or b""), json.loads(unbase64(body) or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict) or not isinstance(header.get("alg"), str):
        return False
    return header["alg"].lower() == "none" or len(unbase64(seal) or b"") >= 16


def _pem(text: str) -> list[tuple[str, int, int]]:
    """Armoured keys whose body parses; an encrypted body, which can't, must at least decode."""
    found = []
    for m in _PEM.finditer(text) if "-----BEGIN " in text else ():
        lines = [x for x in m[2].replace("\\n", "\n").split("\n") if ":" not in x]
        data = unbase64(re.sub(r"\s+", "", "".join(lines)))
        locked = "ENCRYPTED" in m[2] and data is not None and len(data) >= 64
        if locked or (is_ssh_key(data) if m[1].startswith("OPENSSH") else is_der_key(data)):
            found.append(("pem", *m.span()))
    return found


def _holds_secret(data: bytes | None, depth: int) -> bool:
    try:
        text = (data or b"").decode()
    except UnicodeDecodeError:
        return False
    if not text.translate(_BLANKS).isprintable():
        return False
    if _ACCESS.search(text) or any(len(m[2]) >= 8 for m in _ASSIGN.finditer(text)):
        return True
    return bool(_confirmed(text, depth - 1))


def _wrapped(text: str) -> list[tuple[int, int, str]]:
    """(start, end, joined) of base64 over two or more lines: lines of one width, with and without a narrower last one."""
    found = []
    for m in _WRAP64.finditer(text) if "\n" in text else ():
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"[A-Za-z0-9+/_=-]+", m[0])]
        i = 0
        while i < len(lines) - 1:
            width, j = lines[i][1] - lines[i][0], i + 1
            while j < len(lines) and lines[j][1] - lines[j][0] == width:
                j += 1
            narrower = j < len(lines) and lines[j][1] - lines[j][0] < width
            for end in (j + 1, j) if narrower else (j,):
                joined = "".join(text[a:b] for a, b in lines[i:end])
                if width >= _LEAST_WIDTH and end > i + 1 and len(joined) >= _LEAST_WRAPPED:
                    found.append((lines[i][0], lines[end - 1][1], joined))
            i = j
    return found


def _confirmed(text: str, depth: int = _DEPTH) -> list[tuple[str, int, int]]:
    """Spans of the kinds that are reported after decoding only."""
    pems = _pem(text)
    found = pems + [("der", *m.span()) for m in _DER64.finditer(text) if is_der_key(unbase64(m[0]))]
    found += [("der", *m.span()) for m in _DERHEX.finditer(text) if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0]))]
    if "b3BlbnNzaC1rZXktdjE" in text:
        found += [("ssh", *m.span()) for m in _SSH64.finditer(text) if is_ssh_key(unbase64(m[0]))]
    found += [("ssh", *m.span()) for m in _SSHHEX.finditer(text) if len(m[0]) % 2 == 0 and is_ssh_key(bytes.fromhex(m[0]))]
    if "." in text:
        found += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    if depth:
        found += [("enc", *m.span()) for m in _ENC64.finditer(text) if _holds_secret(unbase64(m[0]), depth)]
        found += [("enc", *m.span()) for m in _ENCHEX.finditer(text) if len(m[0]) % 2 == 0 and _holds_secret(bytes.fromhex(m[0]), depth)]
        whole = list(pems)
        for a, b, joined in _wrapped(text):
            if any(x <= a and b <= y for _, x, y in whole):
                continue
            data = unbase64(joined)
            if is_der_key(data) or is_ssh_key(data):
                whole.append(("der" if is_der_key(data) else "ssh", a, b))
            elif _holds_secret(data, depth):
                whole.append(("enc", a, b))
        more = whole[len(pems) :]  # in place of what single lines of them gave
        found = [s for s in found if not any(a <= s[1] and s[2] <= b for _, a, b in more)] + more
    return found


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of one text, by start, then kind as listed."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found += _confirmed(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, spans)``, one for each row of ``docs``; offsets in code points, end exclusive.

    A null or empty text has no spans. Repeated rows are scanned each for itself; other
    columns of ``docs`` are neither read nor returned. Narrow: no shuffle.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, _SPAN_TYPE)], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, spans {_SPANS}").withColumnRenamed("id", id_col)


def digest(found: DataFrame) -> DataFrame:
    """The query's digest columns from the spans."""

    def count(k: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

"""Secret scanning: pattern spans, and encoded keys that are decoded and parsed before they are reported.

Base kinds (``assign``, ``access``, ``hex``) are patterns with a length test. The structural kinds report only what
parses: a PEM block, or a run of base64 (on one line or wrapped over several) or hex, whose bytes are a DER private key
with consistent nested lengths (``pem``, ``der``) or an OpenSSH key (``sshkey``), a PEM block whose headers say that
its whole cipher blocks are an encrypted key (``pem``), and a signed token whose header and payload are JSON (``jwt``).
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The kinds in the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "pem", "der", "sshkey", "jwt")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # greedy: the runs of [0-9a-f]+ that are long enough
_BREAK = re.compile(r"\s+|\\+[nr]")  # line ends of a PEM body, or as strings of JSON and configurations write them
# Possessive repeats: what is tried at a place is not tried again in another way, so a search is linear in the text.
_HEADERS = r"(?:(?:Proc-Type|DEK-Info):[^\r\n\\]{0,200}+(?:\r?\n|\\++[nr])++)*+"
_PEM = re.compile(rf"-----BEGIN ([A-Z0-9 ]{{0,40}}PRIVATE KEY)-----(?:\s|\\++[nr])*+({_HEADERS})([A-Za-z0-9+/=\s]*+(?:\\++[nr][A-Za-z0-9+/=\s]*+)*+)-----END \1-----")
_LINE_END = re.compile(r"[\x20\t]*+(?:(?:\r?\n|\\++[nr])[\x20\t]*+)++")
# A run may follow "=" (name=value); a letter n, r or t after a backslash is no part of it (no key begins with one).
_START = r"(?:(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nrt])|(?<=\\[nrt]))"
_RUN = re.compile(rf"{_START}[A-Za-z0-9+/_-]{{40,}}+={{0,2}}")
_WRAPPED = re.compile(rf"{_START}[A-Za-z0-9+/_-]{{40,}}+(?:{_LINE_END.pattern}[A-Za-z0-9+/_-]++)++={{0,2}}")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{40}")  # without such a stretch no run of either kind is there
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_SSH = b"openssh-key-v1\0"


def _elements(b: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill b[at:end] exactly, all nested lengths checked; else None."""
    found = []
    while at < end:
        if at + 2 > end or depth > 12:
            return None
        tag, n, at = b[at], b[at + 1], at + 2
        if n == 0x80 or n > 0x84:
            return None
        if n > 0x80:
            k = n & 0x7F
            if at + k > end:
                return None
            n, at = int.from_bytes(b[at : at + k], "big"), at + k
        if at + n > end:
            return None
        if tag & 0x20 and _elements(b, at, at + n, depth + 1) is None:
            return None
        found.append((tag, at, at + n))
        at += n
    return found


def private_der(b: bytes) -> bool:
    """Whether bytes are one DER private key: PKCS#1, PKCS#8 (plain or encrypted) or an elliptic-curve key."""
    top = _elements(b, 0, len(b))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = _elements(b, *top[0][1:])
    tags = [t for t, *_ in parts or []]
    first = int.from_bytes(b[parts[0][1] : parts[0][2]], "big") if parts else -1
    oid = lambda i: [t for t, *_ in _elements(b, *parts[i][1:]) or []][:1] == [0x06]
    if tags[:9] == [0x02] * 9 and first in (0, 1):
        return True
    if tags[:3] == [0x02, 0x30, 0x04] and first in (0, 1) and oid(1):
        return True
    if tags[:2] == [0x02, 0x04] and first == 1 and parts[1][2] - parts[1][1] >= 20:
        return True
    return tags == [0x30, 0x04] and oid(0) and parts[1][2] - parts[1][1] >= 40


def openssh_key(b: bytes) -> bool:
    """Whether bytes are an OpenSSH private key: its magic, then fields whose lengths fit inside."""
    if not b.startswith(_SSH):
        return False
    at = len(_SSH)
    for _ in range(3):  # cipher, derivation, its options
        n = int.from_bytes(b[at : at + 4], "big")
        if at + 4 + n > len(b):
            return False
        at += 4 + n
    return at + 4 <= len(b) and 1 <= int.from_bytes(b[at : at + 4], "big") <= 16


def _decoded(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    raw = _decoded(part)
    try:
        found = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _kind_of(b: bytes | None, der: str) -> str | None:
    return None if not b else "sshkey" if openssh_key(b) else der if private_der(b) else None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def _encrypted(headers: str, body: bytes | None) -> bool:
    """Whether headers say that a body of whole cipher blocks is an encrypted key."""
    return bool(body) and "ENCRYPTED" in headers and "DEK-Info" in headers and len(body) >= 32 and len(body) % 8 == 0


def _der_size(head: bytes | None) -> int:
    """The size, header included, that a DER private key which begins with these bytes has; 0 if none begins so."""
    if not head or len(head) < 8 or head[0] != 0x30 or head[1] < 0x20 or 0x84 < head[1]:
        return 0
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    if head[1] == 0x80 or head[2 + k] not in (0x02, 0x30):
        return 0
    return 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])


def _wrapped_keys(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Keys in lines of base64: each begins with a line and is as long as its own header says, an OpenSSH key as the rest."""
    lines, at, found = [], start, []
    for m in _LINE_END.finditer(text, start, end):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, end))
    i = 0
    while i < len(lines):
        head = _decoded(text[lines[i][0] : lines[i][0] + 24])
        n = len(lines) if head and head.startswith(_SSH) else _der_size(head)
        if n and head.startswith(_SSH):
            left, j = None, len(lines)
        else:
            left, j = -(-n * 4 // 3), i
        parts, stop = [], lines[i][1]
        while n and (left is None or left > 0) and (j if left is None else len(lines)) > i + len(parts):
            a, b = lines[i + len(parts)]
            take = b - a if left is None else min(b - a, left)
            stop, left = a + take, None if left is None else left - take
            parts.append(text[a : a + take])
        if n and not left and len(parts) > 1 and (kind := _kind_of(_decoded("".join(parts)), "der")):
            while stop < end and text[stop] == "=":
                stop += 1
            found.append((lines[i][0], stop, kind))
            i += len(parts)
        else:
            i += 1
    return found


class _Blocks:
    """Spans that are known, asked whether one of them holds another span; each question takes a search, no scan."""

    def __init__(self):
        self.spans, self.starts, self.reach = [], [], []

    def add(self, spans) -> None:
        self.spans = sorted([*self.spans, *spans])
        self.starts, self.reach, far = [a for a, _ in self.spans], [], -1
        for _, b in self.spans:
            far = max(far, b)
            self.reach.append(far)

    def hold(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.starts, a)
        return i > 0 and self.reach[i - 1] >= b


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the structural kinds; none lies inside another that was found before it in the order of the patterns."""
    found, blocks = [], _Blocks()
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            body = _decoded(_BREAK.sub("", m[3]))
            if kind := _kind_of(body, "pem") or ("pem" if _encrypted(m[2], body) else None):
                found.append((m.start(), m.end(), kind))
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            head = _object(m[1])
            if head and isinstance(head.get("alg"), str) and _object(m[2]) is not None:
                found.append((m.start(), m.end(), "jwt"))
    if not _LONG.search(text):
        return found
    blocks.add(s[:2] for s in found)
    for keys in (
        lambda: ((*m.span(), _kind_of(bytes.fromhex(m[0]), "der")) for m in _HEX_RUN.finditer(text) if not blocks.hold(*m.span())),
        lambda: (k for m in _WRAPPED.finditer(text) for k in _wrapped_keys(text, *m.span()) if not blocks.hold(*k[:2])),
        lambda: ((*m.span(), _kind_of(_decoded(m[0]), "der")) for m in _RUN.finditer(text) if not blocks.hold(*m.span())),
    ):
        more = [k for k in keys() if k[2]]
        found += more
        blocks.add(s[:2] for s in more)
    return found


def _order(spans):
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


_SCAN = T.StructType([T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")])


def scan(text: Column) -> Column:
    """struct of counts per base kind, the digest of the base spans and all spans; null texts count as empty."""

    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base = _order(base_spans(t or ""))
            kinds = [k for *_, k in base]
            rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(_order(base + structural_spans(t or "")))))
        return pd.DataFrame(rows, columns=_SCAN.names)

    return F.pandas_udf(scan, _SCAN).asNondeterministic()(text)


def redact(text: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span (overlapping or touching ones as one) put by ``mask``; null stays null."""

    def redact(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans = sorted((a, b) for a, b, _ in base_spans(t) + structural_spans(t)) if t else []
            if spans:
                parts, at, end = [], 0, -1
                for a, b in spans:
                    if a > end:
                        parts += [t[at:a], mask]
                    at = end = max(end, b)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(redact, "string").asNondeterministic()(text)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, base_sha256 and spans, in code points. One pass, no shuffle.

    Null and empty texts have no spans; whole texts of any length are searched; spans of one start come in the order of
    their kinds; repeated rows and ids, and null ids, have a row each; other columns are ignored.
    """
    return docs.select("doc_id", scan(F.col("text")).alias("s")).select("doc_id", "s.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``find_secrets`` over the whole of ``documents``; an empty table has no rows."""
    return find_secrets(common.table(spark, sf_dir, "documents"))

"""Canonical forms and Keccak-256 fingerprints as Arrow UDFs.

No Spark builtin covers NFKC, RFC 3986 re-encoding or Keccak, so these cross
into Python, a batch at a time; the permutation runs over all rows of a batch.
Common URLs and texts get their canonical form from the engine.
"""

from __future__ import annotations

import posixpath
import re
import unicodedata
import urllib.parse

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threatquery.functions.text import message_tokens

_U = np.uint64
_RATE = 136


def _round_constants() -> list[np.uint64]:
    """From the standard's linear-feedback shift register."""
    out, state = [], 1
    for _ in range(24):
        constant = 0
        for j in range(7):
            if state & 1:
                constant ^= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state & 0x80 else 0)
        out.append(_U(constant))
    return out


def _rotations() -> dict[tuple[int, int], int]:
    """From the standard's walk over the lanes."""
    out, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        out[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


_CONSTANTS, _TURNS = _round_constants(), _rotations()


def _turn(a: np.ndarray, n: int) -> np.ndarray:
    return a if n == 0 else (a << _U(n)) | (a >> _U(64 - n))


def _permute(s: np.ndarray) -> None:
    """Keccak-f[1600] on s[x, y, row], in place."""
    for constant in _CONSTANTS:
        column = s[:, 0] ^ s[:, 1] ^ s[:, 2] ^ s[:, 3] ^ s[:, 4]
        for x in range(5):
            s[x] ^= column[(x - 1) % 5] ^ _turn(column[(x + 1) % 5], 1)
        moved = np.empty_like(s)
        for (x, y), n in _TURNS.items():
            moved[y, (2 * x + 3 * y) % 5] = _turn(s[x, y], n)
        for x in range(5):
            s[x] = moved[x] ^ (~moved[(x + 1) % 5] & moved[(x + 2) % 5])
        s[0, 0] ^= constant


def keccak256(payloads: list[bytes]) -> list[str]:
    """0x and 64 hex digits for each payload, with the original padding.

    Block b of all payloads that have one goes through the permutation at once;
    the longest come first, so that those are always a leading part.
    """
    blocks = np.array([len(p) // _RATE + 1 for p in payloads], np.int64)
    order = np.argsort(-blocks, kind="stable")
    starts = np.cumsum(blocks[order]) - blocks[order]
    data = np.zeros(int(blocks.sum()) * _RATE, np.uint8)
    for at, r in zip(starts * _RATE, order, strict=True):
        p, end = payloads[r], at + blocks[r] * _RATE
        data[at : at + len(p)] = np.frombuffer(p, np.uint8)
        data[at + len(p)] ^= 0x01
        data[end - 1] ^= 0x80
    lanes = data.view("<u8").reshape(-1, _RATE // 8)
    state = np.zeros((5, 5, len(payloads)), _U)
    for b in range(int(blocks.max(initial=0))):
        n = int((blocks[order] > b).sum())
        part = lanes[starts[:n] + b]
        for k in range(_RATE // 8):
            state[k % 5, k // 5, :n] ^= part[:, k]
        _permute(state[:, :, :n])
    digest = np.ascontiguousarray(np.stack([state[k, 0] for k in range(4)], 1)).astype("<u8")
    out = [""] * len(payloads)
    for k, r in enumerate(order):
        out[r] = "0x" + digest[k].tobytes().hex()
    return out


_ESCAPE = re.compile("%([0-9A-Fa-f]{2})")
_PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_PORTS = {"http": 80, "https": 443, "ftp": 21}
_QUOTES = str.maketrans("‘’“”‚„`´", "''\"\"'\"''")
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def settle_escapes(text: str) -> str:
    """Unreserved characters decoded, all other escapes in upper case."""

    def settle(m: re.Match) -> str:
        char = chr(int(m[1], 16))
        return char if char in _PLAIN else m[0].upper()

    return _ESCAPE.sub(settle, text)


def _authority(scheme: str, location: str) -> str:
    user, at, place = location.partition("@") if "@" in location else ("", "", location)
    if place.startswith("["):
        cut = place.find("]") + 1 or len(place)
    else:
        cut = place.index(":") if ":" in place else len(place)
    host, port = place[:cut].lower(), place[cut:]
    if not host.startswith("["):
        host = host.rstrip(".")
    try:
        if port.startswith(":") and int(port[1:]) == _PORTS.get(scheme):
            port = ""
    except ValueError:
        pass
    return f"{user}{at}{host}{port}"


def _path(path: str) -> str:
    if path in ("", "/"):
        return "/"
    quoted = settle_escapes(urllib.parse.quote(path, safe="/:@!$&'()*+,;=-_.~%"))
    settled = posixpath.normpath(quoted)
    settled = settled if settled.startswith("/") else "/" + settled
    return settled + "/" if path.endswith("/") and not settled.endswith("/") else settled


def canonical_url(url: str | None) -> str:
    """The deterministic form of a URL; '' for a null or blank one."""
    text = unicodedata.normalize("NFKC", (url or "").strip())
    if not text:
        return ""
    if "://" in text:
        scheme, rest = text.split("://", 1)
        scheme = scheme.lower()
        text = f"{scheme}://{rest}"
    elif text.startswith("//"):
        scheme = ""
    else:
        scheme, text = "http", "http://" + text
    part = urllib.parse.urlsplit(text)
    out = (f"{scheme}://" if scheme else "//") + _authority(scheme, part.netloc) + _path(part.path)
    if pairs := sorted(urllib.parse.parse_qsl(part.query, keep_blank_values=True)):
        out += "?" + settle_escapes(urllib.parse.urlencode(pairs, quote_via=urllib.parse.quote))
    if part.fragment and (tail := settle_escapes(urllib.parse.quote(part.fragment.strip(), safe="/?#:@!$&'()*+,;=-_.~%"))):
        out += "#" + tail
    return out


def canonical_message(text: str | None) -> str:
    """The deterministic form of a message: NFKC, plain quotes, lower case, every token kept in order."""
    plain = unicodedata.normalize("NFKC", (text or "").strip()).translate(_QUOTES).lower()
    return " ".join(_TOKEN.findall(plain))


def _hashed(prefix: str, forms: list[str]) -> list[str | None]:
    """Fingerprints; null where there is nothing to hash."""
    live = [k for k, f in enumerate(forms) if f]
    found = keccak256([(prefix + forms[k]).encode("utf-8", "surrogatepass") for k in live])
    out: list[str | None] = [None] * len(forms)
    for k, h in zip(live, found, strict=True):
        out[k] = h
    return out


def _safe_url(url: str | None) -> str | None:
    try:
        return canonical_url(url)
    except ValueError:
        return None


#: URLs of plain hosts and segments, without port, query or fragment: lower-casing scheme and host is all they need.
_SIMPLE_URL = r"\A((?i:https?)://)([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)((?:/[A-Za-z0-9_~-][A-Za-z0-9_.~-]*)*/?)\z"
#: Texts that NFKC leaves as they are, and on which the engine agrees with Python about blanks and letters.
_PLAIN_TEXT = r"\A[\t\n\x0B\f\r\x20-\x7E]*\z"


def simple_url(url: Column) -> Column:
    """The canonical form of a simple URL; null for any other."""
    head = F.lower(F.concat(F.regexp_extract(url, _SIMPLE_URL, 1), F.regexp_extract(url, _SIMPLE_URL, 2)))
    path = F.regexp_extract(url, _SIMPLE_URL, 3)
    return F.when(url.rlike(_SIMPLE_URL), F.concat(head, F.when(path == "", "/").otherwise(path)))


#: URLs that the engine can bring into form: printable ASCII; scheme, location, path, query and fragment.
_PARTS = r"\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#\[\]]*)((?:/[^?#]*)?)(\?[^#]*)?(#.*)?\z"
_LOCATION = r"\A([^@]*@)?([^:]*)(:[0-9]*)?\z"
_ESCAPED = "%[0-9A-Fa-f]{2}"
_UNSAFE = r"""["<>\[\\\]^`{|}]"""


def settled(text: Column) -> Column:
    """Characters that may not stand in a path or fragment escaped, unreserved ones not, all escapes in upper case."""
    pieces = F.regexp_extract_all(text, F.lit(f"({_ESCAPED}|{_UNSAFE}|%|[^%\"<>\\[\\\\\\]^`{{|}}]+)"), F.lit(1))

    def one(piece: Column) -> Column:
        char = F.char(F.conv(F.substring(piece, 2, 2), 16, 10).cast("int"))
        return F.when(piece.rlike(f"\\A{_ESCAPED}\\z"), F.when(char.rlike(r"\A[A-Za-z0-9._~-]\z"), char).otherwise(F.upper(piece))).when(piece.rlike(f"\\A{_UNSAFE}\\z"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(piece)), 2, "0"))).otherwise(piece)

    return F.array_join(F.transform(pieces, one), "")


def resolved(path: Column) -> Column:
    """A path from the root without empty, `.` and `..` segments; two slashes at its start stay, as does one at its end."""

    def step(held: Column, segment: Column) -> Column:
        up = F.when(F.size(held) > 0, F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(held)
        return F.when(segment.isin("", "."), held).when(segment == "..", up).otherwise(F.concat(held, F.array(segment)))

    segments = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    root = F.when(path.rlike(r"\A//(?!/)"), "//").otherwise("/")
    end = F.when(path.endswith("/") & (F.size(segments) > 0), "/").otherwise("")
    return F.concat(root, F.array_join(segments, "/"), end)


def sorted_query(query: Column) -> Column:
    """Pairs decoded, sorted and encoded anew; null where an escape is broken or isn't UTF-8."""
    coded = lambda c: F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.try_url_decode(F.regexp_extract(p, "\\A[^=]*", 0)).alias("k"), F.try_url_decode(F.regexp_extract(p, "=(.*)\\z", 1)).alias("v")))
    out = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(coded(p["k"]), F.lit("="), coded(p["v"]))), "&")
    sound = F.forall(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull() & ~p["k"].contains("\ufffd") & ~p["v"].contains("\ufffd"))
    return F.when(query.rlike(r"%(?![0-9A-Fa-f]{2})"), None).when(sound, out)


def ascii_url(url: Column) -> Column:
    """The canonical form of a URL of printable ASCII; null for any other, for a host in brackets, and for ports or query escapes of odd forms."""
    text = F.btrim(url, F.lit(" \t\n\r\x0b\x0c"))
    text = F.when(text.contains("://") | text.startswith("//"), text).otherwise(F.concat(F.lit("http://"), text))
    part = lambda k: F.regexp_extract(text, _PARTS, k)
    scheme, location = F.lower(part(1)), part(2)
    user, host, port = (F.regexp_extract(location, _LOCATION, k) for k in (1, 2, 3))
    default = F.when(scheme == "http", "80").when(scheme == "https", "443").when(scheme == "ftp", "21")
    number = F.regexp_replace(port, "\\A:0*", "")
    port = F.when(F.coalesce(number == default, F.lit(False)), "").otherwise(port)
    host = F.rtrim(F.lower(host), F.lit("."))
    path = F.when(part(3).isin("", "/"), "/").otherwise(resolved(settled(part(3))))
    query = sorted_query(F.substring(part(4), 2, 1 << 30))
    tail = settled(F.substring(part(5), 2, 1 << 30))
    out = F.concat(
        F.when(scheme == "", "//").otherwise(F.concat(scheme, F.lit("://"))), user, host, port, path,
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), F.when(tail == "", "").otherwise(F.concat(F.lit("#"), tail)),
    )
    known = url.rlike(r"\A[\t\n\x0B\f\r ]*[\x21-\x7E]+[\t\n\x0B\f\r ]*\z") & text.rlike(_PARTS) & location.rlike(_LOCATION) & ~text.startswith("://")
    return F.when(known & ((scheme != "") | (text.startswith("//") & ~text.contains("://"))), out)


def plain_message(text: Column) -> Column:
    """The canonical form of a message of printable ASCII; null for any other."""
    return F.when(text.rlike(_PLAIN_TEXT), message_tokens(text))


@F.pandas_udf(StringType())
def _canonical_url(urls: pd.Series) -> pd.Series:
    return urls.map(_safe_url)


@F.pandas_udf(StringType())
def _canonical_message(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_message)


@F.pandas_udf(StringType())
def _url_hash(urls: pd.Series, forms: pd.Series) -> pd.Series:
    return pd.Series(_hashed("url:", [(_safe_url(u) or "") if f is None else f for u, f in zip(urls, forms, strict=True)]), dtype=object)


@F.pandas_udf(StringType())
def _message_hash(texts: pd.Series, forms: pd.Series) -> pd.Series:
    return pd.Series(_hashed("message:", [canonical_message(t) if f is None else f for t, f in zip(texts, forms, strict=True)]), dtype=object)


@F.pandas_udf(StringType())
def _keccak(values: pd.Series) -> pd.Series:
    return pd.Series(keccak256([b"" if v is None else bytes(v) for v in values]), dtype=object)


def native_url(url: Column) -> Column:
    """The canonical form where no Python is needed for it, else null."""
    simple = simple_url(url)
    return F.when(simple.isNotNull(), simple).otherwise(ascii_url(url))


def canonical_url_column(url: Column) -> Column:
    """Simple URLs and those of ASCII by the engine's own functions; Python only for what NFKC may change and for rare forms."""
    native = native_url(url)
    return F.coalesce(native, _canonical_url(F.when(native.isNull(), url)))


def canonical_message_column(text: Column) -> Column:
    plain = plain_message(text)
    return F.coalesce(plain, _canonical_message(F.when(plain.isNull(), text)))


def url_fingerprint(url: Column) -> Column:
    """Null for a URL that is null, blank or can't be split."""
    native = native_url(url)
    return _url_hash(F.when(native.isNull(), url), native)


def message_fingerprint(text: Column) -> Column:
    plain = plain_message(text)
    return _message_hash(F.when(plain.isNull(), text), plain)


def keccak(value: Column) -> Column:
    """Of binary values."""
    return _keccak(value)

"""URL columns: components as the generic syntax gives them, lexical features, risk findings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatquery.functions import lexicons as lex
from threatquery.functions.text import IPV4, strip

#: Schemes whose last path segment may carry ;parameters.
_WITH_PARAMETERS = ["", "ftp", "hdl", "prospero", "http", "https", "imap", "itms-services", "mms", "rtsp", "rtsps", "rtspu", "sftp", "shttp", "sip", "sips", "tel"]
FINDING_HTTPS = "URL is not using HTTPS"
FINDING_IP = "URL uses an IP address instead of a domain name"
FINDING_CHARACTER = "URL contains suspicious character: "
FINDING_KEYWORD = "URL contains suspicious keyword: "
FINDING_REGISTRY = "Blockchain registry identifies this URL as a threat"


def components(url: Column, prefix: bool = False) -> dict[str, Column]:
    """protocol, domain (the network location) and path. ``prefix``: text without a location is read after http://."""
    clean = F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    if prefix:
        clean = strip(clean)
        clean = F.when(_location(_rest(clean)) == "", F.concat(F.lit("http://"), clean)).otherwise(clean)
    scheme, rest = _scheme(clean), _rest(clean)
    path = F.regexp_extract(F.regexp_replace(rest, r"^//[^/?#]*", ""), r"^([^?#]*)", 1)
    path = F.when(scheme.isin(*_WITH_PARAMETERS), F.regexp_replace(path, r";[^/]*\z", "")).otherwise(path)
    return {"protocol": scheme, "domain": _location(rest), "path": path}


def _scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def _rest(url: Column) -> Column:
    return F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")


def _location(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^//([^/?#]*)", 1)


def hostname(domain: Column) -> Column:
    """Lower-cased host without user, port and trailing dots."""
    host = F.lower(F.regexp_replace(domain, r"^.*@", ""))
    host = F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(host, r":.*\z", ""))
    return F.regexp_replace(host, r"\.+\z", "")


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


def is_shortener(host: Column, domains: Iterable[str] = lex.URL_SHORTENERS) -> Column:
    return host.rlike(rf"(^|\.)({lex.alternation(domains)})\z").cast("int")


def has_keyword(url: Column, words: Iterable[str] = lex.URL_KEYWORDS) -> Column:
    return F.lower(url).rlike(rf"(?<![a-z])({lex.alternation(words)})(?![a-z])").cast("int")


#: Full, compressed and IPv4-tailed forms.
IPV6 = (
    r"(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,7}:|:(?::[0-9a-fA-F]{1,4}){1,7}|::"
    + "".join(rf"|(?:[0-9a-fA-F]{{1,4}}:){{1,{7 - k}}}(?::[0-9a-fA-F]{{1,4}}){{1,{k}}}" for k in range(1, 7))
    + rf"|::(?:[fF]{{4}}:)?{IPV4})"
)


def is_ip(domain: Column) -> Column:
    """The whole network location is an address; a port, a user or brackets rule that out."""
    return domain.rlike(rf"^(?:{IPV4}|{IPV6})\z")


def findings(url: Column, protocol: Column, domain: Column, keywords: Iterable[str] = lex.SCAN_KEYWORDS) -> Column:
    """What the scan reports, in its order."""
    tests = [(protocol != "https", FINDING_HTTPS), (is_ip(domain), FINDING_IP)]
    tests += [(url.contains(c), FINDING_CHARACTER + c) for c in lex.SCAN_CHARACTERS]
    tests += [(F.lower(url).contains(w), FINDING_KEYWORD + w) for w in keywords]
    return F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in tests]))


def risk(found: Column) -> Column:
    return F.when(F.size(found) == 0, "SAFE").when(F.size(found) <= 2, "MEDIUM").otherwise("HIGH")


def admissible(url: Column) -> Column:
    """Something that the scan accepts: http or https with a host."""
    part = components(url)
    return F.coalesce(part["protocol"].isin("http", "https") & (hostname(part["domain"]) != ""), F.lit(False))


def lexical(url: Column) -> dict[str, Column]:
    """The 21 lexical features of a URL, in their fixed order."""
    part = components(url, prefix=True)
    host = hostname(part["domain"])
    size = F.length(url)
    labels = F.split(host, r"\.")
    count = lambda pattern: F.regexp_count(url, F.lit(pattern))
    share = lambda n: F.coalesce(F.try_divide(n, size), F.lit(0.0))
    hidden, letters, digits = count("%[0-9A-Fa-f]{2}"), count("[A-Za-z]"), count("[0-9]")
    other = count("[^A-Za-z0-9=?&]")
    return {
        "URLLength": size,
        "DomainLength": F.length(host),
        "IsDomainIP": is_ip(part["domain"]).cast("int"),
        "TLDLength": F.length(F.element_at(labels, -1)),
        "NoOfSubDomain": F.greatest(F.size(labels) - 2, F.lit(0)),
        "HasObfuscation": (hidden > 0).cast("int"),
        "NoOfObfuscatedChar": hidden,
        "ObfuscationRatio": share(hidden),
        "NoOfLettersInURL": letters,
        "LetterRatioInURL": share(letters),
        "NoOfDegitsInURL": digits,
        "DegitRatioInURL": share(digits),
        "NoOfEqualsInURL": count("="),
        "NoOfQMarkInURL": count(r"\?"),
        "NoOfAmpersandInURL": count("&"),
        "NoOfOtherSpecialCharsInURL": other,
        "SpacialCharRatioInURL": share(other),
        "IsHTTPS": (part["protocol"] == "https").cast("int"),
        "IsURLShortener": is_shortener(host),
        "URLDepth": depth(part["path"]),
        "HasSuspiciousKeyword": has_keyword(url),
    }


def with_engineered(rows: DataFrame, column: str = "URL") -> DataFrame:
    """``rows`` with IsURLShortener, URLDepth and HasSuspiciousKeyword of their URLs; no other column changes. Fails without the column."""
    if column not in rows.columns:
        raise ValueError(f"no column {column!r} among {rows.columns}")
    made = lexical(F.col(f"`{column}`"))
    return rows.withColumns({c: made[c] for c in ("IsURLShortener", "URLDepth", "HasSuspiciousKeyword")})


def canonical_simple(url: Column) -> Column:
    """Canonical form of a URL without escapes, user or dot segments: lower host, no default port, sorted query."""
    part = components(url)
    port = F.regexp_extract(part["domain"], r":([0-9]+)\z", 1)
    default = ((part["protocol"] == "http") & (port == "80")) | ((part["protocol"] == "https") & (port == "443"))
    tail = F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.array_sort(F.filter(F.split(query, "&"), lambda p: p != ""))
    sorted_query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    fragment = F.regexp_extract(url, r"#(.*)\z", 1)
    fragment = F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise("")
    path = F.when(part["path"] == "", "/").otherwise(part["path"])
    return F.concat(part["protocol"], F.lit("://"), hostname(part["domain"]), tail, path, sorted_query, fragment)

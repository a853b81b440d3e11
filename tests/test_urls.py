import pytest
from pyspark.sql import functions as F

from threatquery.functions import hashing, urls
from threatquery.operators import scan

CANONICAL = {
    "HTTP://Harbour.Example/Kites": "http://harbour.example/Kites", "https://harbour.example": "https://harbour.example/", "https://harbour.example/a/": "https://harbour.example/a/",
    "http://harbour.example:80/a": "http://harbour.example/a", "https://harbour.example:443": "https://harbour.example/", "ftp://harbour.example:21/f": "ftp://harbour.example/f",
    "https://harbour.example:80/a": "https://harbour.example:80/a", "http://harbour.example./a": "http://harbour.example/a", "http://h.example/x/../y": "http://h.example/y",
    "http://h.example/x/./y/z/..": "http://h.example/x/y", "http://h.example/x/./y/../": "http://h.example/x/", "http://h.example/?z=1&b=&a=2": "http://h.example/?a=2&b=&z=1",
    "http://h.example/q?k=two&j=0&k=one": "http://h.example/q?j=0&k=one&k=two", "http://h.example/q?k=a+b": "http://h.example/q?k=a%20b", "http://h.example/%7e%41/%3f": "http://h.example/~A/%3F",
    "http://h.example/a#part/2": "http://h.example/a#part/2", "http://h.example/a#": "http://h.example/a", "h.example/a": "http://h.example/a", "//h.example/a": "//h.example/a",
    "ftp://Me:Key@H.example/": "ftp://Me:Key@h.example/", "http://[2001:DB8::7]:80/": "http://[2001:db8::7]/", "http://h.example/ä b": "http://h.example/%C3%A4%20b",
    "ｈttp://ｈ.example/": "http://h.example/", "": "", " \n ": "", "https://h[.example/x": None,
}


@pytest.mark.parametrize(("url", "form"), list(CANONICAL.items())[:-1])
def test_canonical(url, form):
    assert hashing.canonical_url(url) == form
    assert hashing.canonical_url(None) == ""


def test_keccak_vectors():
    found = hashing.keccak256([b"", b"hello", b"message:your account is blocked", b"url:http://example.com/", b"x" * 135, b"x" * 136, b"x" * 500])
    assert found[0] == "0xc5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert found[1] == "0x1c8aff950685c2ed4bc3174f3472287b56d9517b9c948127319a09a7a36deac8"
    assert found[2] == "0x72b23a3e7d22a2d1b739b106232625ab7da41df0aab77c4b2808fd2c3dc02a1f"
    assert found[3] == "0x3ec488dfef911dbcc0d4daddec0e7acb656282479e308c95702ed699b2138321"
    assert len(set(found)) == 7 and all(len(x) == 66 for x in found)


def test_fingerprints(spark):
    # Fixed value: the published hash of http://example.com/.
    rows = ["HTTPS://H.example:443/k?z=2&y=1#p", "https://h.example/k?y=1&z=2#p", "http://example.com:80", "http://example.com/", "", None, "https://h[.example/x"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(rows)], "k int, url string")
    h = [r[0] for r in df.orderBy("k").select(hashing.url_fingerprint(F.col("url"))).collect()]
    assert h[0] == h[1] and h[2] == h[3] == "0x3ec488dfef911dbcc0d4daddec0e7acb656282479e308c95702ed699b2138321"
    assert h[4:] == [None, None, None]
    m = df.orderBy("k").select(hashing.message_fingerprint(F.col("url"))).collect()[3][0]
    assert m != h[3]


def test_message_forms():
    one = hashing.canonical_message
    assert one(" low \t tide\n\nat  SIX ") == "low tide at six" and one("see http://h.example/a-b!") == "see http :// h . example / a - b !"
    assert one("ＴＩＤＥ ﬁn ²") == "tide fin 2" and one("the tide‘s in") == one("the tide's in") and one("„in“") == '" in "'
    assert one(None) == one(" \t") == "" and one("go go go") == "go go go"


def test_columns_agree_with_the_plain_forms(spark):
    """Simple URLs and plain texts get their form from the engine, the others from Python."""
    rows = [*CANONICAL, "HTTP://A-b.Example/x.y/~z/", "http://h.example//x", "http://h.example/.x", "http://h.example/..", "http://h.example/x;y", "https://h.example/a%20b", None, "http://h.example\n", "ht tp://x"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(rows)], "k int, url string")
    got = [r[0] for r in df.orderBy("k").select(hashing.canonical_url_column(F.col("url"))).collect()]
    assert got == [hashing._safe_url(u) for u in rows]
    texts = ["Low  TIDE, at 6!", "a\x1cb", "naïve Ⅷ", "`q` \x0c x_y", " \x0b ", "", None, "ﬁn ¨ K", "İx", "tab\there", "del\x7f!"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(texts)], "k int, t string")
    got = [tuple(r) for r in df.orderBy("k").select(hashing.canonical_message_column(F.col("t")), hashing.message_fingerprint(F.col("t"))).collect()]
    assert [g[0] for g in got] == [hashing.canonical_message(t) for t in texts]
    assert [g[1] for g in got] == hashing._hashed("message:", [hashing.canonical_message(t) for t in texts])


def test_native_forms_of_many_urls(spark):
    """Generated URLs of ASCII: what the engine gives is the plain form, and it gives it for nearly all."""
    import random

    rng = random.Random(11)
    some = lambda options, n: "".join(rng.choice(options) for _ in range(rng.randint(0, n)))
    bits = ["a", "B", "7", ".", "..", "/", "//", "/./", "/../", "%41", "%2f", "%2E", "%7e", "%zz", "%", "~", "-", "+", "*", "'", '"', "<", "|", "[", "]", "^", "\\", ":", "@", "=", ";", ",", "!", "%c3%a4"]
    queries = ["a", "B", "=", "&", "&&", "==", "+", "%20", "%26", "%3d", "%C3%A4", "%7E", "*", "/", "?", "~", ".", "%2A", "'", "é"[:0]]
    rows = list(CANONICAL)
    for _ in range(3000):
        scheme = rng.choice(["http://", "HTTPS://", "ftp://", "x+y.z-1://", "", "//", "://", "1a://", "mailto:"])
        host = some(["h", "H", ".", "example", "1", "-"], 5) + rng.choice(["", ".", "..", ":80", ":0443", ":443", ":21", ":", ":8080", ":+80", ":x"])
        user = rng.choice(["", "", "", "Me@", "me:Key@", "a@b@"])
        tail = rng.choice(["", "/"]) + some(bits, 7) + rng.choice(["", "?" + some(queries, 8)]) + rng.choice(["", "", "#" + some([*bits, "?", "#"], 4)])
        rows.append(rng.choice(["", " ", "\n"]) + scheme + user + host + tail + rng.choice(["", " ", "\t"]))
    df = spark.createDataFrame([(k, u) for k, u in enumerate(rows)], "k int, url string")
    got = [r[0] for r in df.orderBy("k").select(hashing.native_url(F.col("url"))).collect()]
    for u, g in zip(rows, got, strict=True):
        assert g is None or g == hashing._safe_url(u), u
    assert sum(g is not None for g in got) > 0.4 * len(rows)  # many are odd on purpose
    real = [u for u in CANONICAL if u.isascii() and "[" not in u and u.strip()]
    assert all(g is not None for u, g in zip(rows, got, strict=True) if u in real)


def test_components(spark):
    cases = {
        "https://Kites.Example:81/a/b;p=1?q#f": ("https", "Kites.Example:81", "/a/b"),
        "\thttp://x/a;v/b": ("http", "x", "/a;v/b"),
        "kites.example:81/x": ("kites.example", "", "81/x"),
        "http://1.2.3.4/": ("http", "1.2.3.4", "/"),
        "": ("", "", ""),
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    for r in df.select("url", *[c.alias(n) for n, c in urls.components(F.col("url")).items()]).collect():
        assert (r.protocol, r.domain, r.path) == cases[r.url], r.url


def test_features(spark):
    df = spark.createDataFrame([("bit.ly/x",), ("http://www.bit.ly./a//b/",), ("https://notbit.ly.example/",), ("http://x.com/signin-now",), ("http://x.com/resignin",)], "url string")
    part = urls.components(F.col("url"), prefix=True)
    got = df.select(urls.is_shortener(urls.hostname(part["domain"])), urls.depth(part["path"]), urls.has_keyword(F.col("url"))).collect()
    assert [tuple(r) for r in got] == [(1, 1, 0), (1, 2, 0), (0, 0, 0), (0, 1, 1), (0, 1, 0)]


def test_ip(spark):
    cases = {"1.2.3.4": True, "01.2.3.4": False, "1.2.3.4:80": False, "256.1.1.1": False, "::1": True, "2001:db8::ff00:42:8329": True, "[::1]": False, "a.b": False, "1:2:3:4:5:6:7:8": True, "1:2:3:4:5:6:7": False}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert {r[0]: r[1] for r in df.select("d", urls.is_ip(F.col("d"))).collect()} == cases


def test_scan(spark):
    registry = spark.createDataFrame([("h", 1, 1, 90)], "threat_hash string, threat_type int, verdict int, confidence int")
    rows = spark.createDataFrame([("https://kites.example", "h"), ("http://10.2.3.4/secure?x=%41&update", "n"), ("nowhere", "n")], "url string, h string")
    got = {r.url: r for r in scan.scan(rows, registry, F.col("h")).collect()}
    a, b, c = got["https://kites.example"], got["http://10.2.3.4/secure?x=%41&update"], got["nowhere"]
    assert a.findings == [urls.FINDING_REGISTRY] and a.risk_level == "MEDIUM" and a.blockchain_found
    assert b.findings == [urls.FINDING_HTTPS, urls.FINDING_IP, urls.FINDING_CHARACTER + "%", urls.FINDING_KEYWORD + "update", urls.FINDING_KEYWORD + "secure"]
    assert b.risk_level == "HIGH" and b.uses_ip and not b.https
    assert (c.status, c.risk_level, c.findings, c.protocol) == ("error", "UNKNOWN", [], "")
    open_ = scan.scan(rows, None).where("url = 'https://kites.example'").first()
    assert open_.status == "processed" and not open_.blockchain_available and not open_.blockchain_found and open_.risk_level == "SAFE"
    assert set(scan.RESPONSE) <= set(open_.asDict())

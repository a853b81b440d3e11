from pyspark.sql import functions as F

from threatquery.operators import lemmas
from threatquery.functions import lexicons as lex, text as tx


def values(spark, rows, *columns):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, t string")
    return [tuple(r) for r in df.orderBy("k").select(*columns).collect()]


URL_FLAGS = {
    None: "FFFF", "": "FFFF", " \t ": "FFFF", "The ferry leaves at noon, bring the blue umbrella": "FFFF",
    "New timetable: http://harbour-ferries.example/summer?day=3": "TFFF", "Tickets via https://tickets.island.example": "TFFT",
    "more on www.lighthouse.example today": "TFFF", "see buff.ly/kite77": "TTFF", "open https://rb.gy/kite now": "TTFT",
    "go to v.gd/x, please": "TTFF", "old link http://tr.im/kite": "TTFF", "router: http://172.16.4.9/setup": "TFTF",
    "console at https://172.16.4.9:9443/ui": "TFTT", "file on 10.20.30.40/share": "TFTF", "build 10.20.30 is out": "FFFF", "address 10.20.30.400/x": "FFFF",
}


def test_url_flags(spark):
    got = values(spark, list(URL_FLAGS), *tx.url_flags(F.col("t")).values())
    for (text, want), flags in zip(URL_FLAGS.items(), got, strict=True):
        assert "".join("FT"[f] for f in flags) == want, text


def test_text_flags(spark):
    cases = {
        None: (0, False, False), "": (0, False, False), "kites over the bay": (18, False, False), "urgent: low tide": (16, True, False),
        "IMMEDIATELY!": (12, True, False), "a fare of £7": (12, False, True), "cash only on the ferry": (22, False, True), "urgent, £7 in cash": (18, True, True),
        "resurgent cashew": (16, False, False),
    }
    assert values(spark, list(cases), *tx.text_flags(F.col("t")).values()) == list(cases.values())


def test_nlp(spark):
    stop = tx.default_stopwords()
    one = lambda s: values(spark, [s], tx.nlp_tokens(F.col("t"), stop))[0][0]
    assert one(None) == one("  ") == []
    assert one("Look: https://kites.example/buy?id=7&x=y soon")[:2] == ["look", "urltoken"]
    assert "numtoken" in one("Ring (020) 7946-0018 before six") and "7946" not in one("Ring (020) 7946-0018 before six")
    assert "numtoken" in one("ticket 8675309") and {"4411", "1987"} <= set(one("gate 4411, built 1987"))
    kept = one("You should not call the harbour; stop now and win a free kite, urgent!")
    assert {"you", "call", "stop", "now", "win", "free", "urgent", "kite"} <= set(kept) and not {"the", "and", "a"} & set(kept)
    assert one("ferries boxes kites glass bus") == ["ferry", "box", "kite", "glass", "bus"]
    given = values(spark, ["geese and kites"], tx.nlp_tokens(F.col("t"), stop, lexicon={"geese": "goose"}))[0][0]
    assert given == ["goose", "kite"]


def test_normal_forms(spark):
    assert values(spark, [" A  b\n\tC "], tx.normalize(F.col("t"))) == [("a b c",)]
    assert values(spark, [" SPAM ", "ham", "Odd ", None], tx.standard_label(F.col("t"))) == [("malicious",), ("benign",), ("odd",), (None,)]
    assert values(spark, ["Tide‘s in — 3pm?", None], tx.message_tokens(F.col("t"))) == [("tide ' s in — 3pm ?",), ("",)]


def test_categories(spark):
    df = spark.createDataFrame([("the DRAW is tonight", "malicious"), ("a camera upgrade", "Malicious "), ("bank holiday", "malicious"), ("low tide", "malicious"), ("draw", "ham"), ("drawer", "malicious"), (None, None)], "t string, l string")
    got = [r[0] for r in df.select(tx.category(F.col("t"), F.col("l"))).collect()]
    assert got == ["prize_premium_scam", "free_offer_scam", "payment_scam", "other_scam", "benign", "other_scam", "benign"]
    m = values(spark, ["Draw a free tone per msg, CLUB"], tx.matched_keywords(F.col("t")))[0][0]
    assert m == {"prize_premium_scam": ["tone", "club", "per msg", "draw"], "free_offer_scam": ["free"]}


def test_trie_matches_its_words_only():
    import re

    words = ["win", "winner", "won", "act now", "now", "a.b"]
    found = re.compile(rf"\b(?:{lex.trie(words)})\b")
    assert all(found.fullmatch(w) for w in words)
    assert not any(found.fullmatch(w) for w in ["winn", "wo", "axb", "act"])


def test_lemmas_that_a_vocabulary_knows(spark):
    rows = spark.createDataFrame([(1, ["users", "received", "prizes", "boxes", "bus", "women"]), (2, ["geese", "glass", "glasses", "wolves", "ladies", "s", "", "buses"]), (3, []), (4, None), (5, ["churches", "unknowns", "users"])], "k int, w array<string>")
    known = spark.createDataFrame([(w,) for w in ["user", "prize", "box", "bus", "woman", "goose", "glass", "wolf", "lady", "church", "bu", None, ""]], "word string")
    exceptions = spark.createDataFrame([("geese", "goose"), ("geese", "gooose"), ("bus", "bus")], "form string, lemma string")
    got = {r.k: r.w for r in lemmas.lemmatized(rows, "k", "w", known, exceptions).collect()}
    assert got == {1: ["user", "received", "prize", "box", "bus", "woman"], 2: ["goose", "glass", "glass", "wolf", "lady", "s", "", "bus"], 3: [], 4: None, 5: ["church", "unknowns", "user"]}
    plain = {r.k: r.w for r in lemmas.lemmatized(rows, "k", "w", known).collect()}
    assert plain[1][4] == "bu" and plain[2][0] == "geese"  # the shortest that is known
    own = {r.k: r.w for r in lemmas.lemmatized(spark.createDataFrame([(1, ["cars", "car", "alerts"])], "k int, w array<string>"), "k", "w").collect()}
    assert own == {1: ["car", "car", "alerts"]}

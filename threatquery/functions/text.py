"""Message columns: normal form, labels, categories, flags, preprocessing."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatquery.functions import lexicons as lex

# The expressions that flags and spans are defined by, up to URL_HINT, which only goes before them.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_TLDS = "|".join(lex.BARE_TLDS)
_STOP = r"""[^\s<>{}"']"""
HTTPS = r"(?iuU)\bhttps://"
IP_HOST = rf"(?iuU)(?:https?://)?\b{IPV4}(?::\d{{1,5}})?(?=[/?#\s]|$)"
ANY_URL = rf"(?iuU)\b(?:https?://|www\.){_STOP}+|\b[a-zA-Z0-9.-]+\.(?:{_TLDS})(?:/{_STOP}*)?"
URL_HINT = rf"(?iu)https?://|ftp://|www\.|\.(?:{lex.trie(lex.BARE_TLDS)})"
DOTTED = r"[0-9]\.[0-9]"
PLAIN_URL = r"http[s]?://|www\."


def shortener_pattern(domains: Iterable[str]) -> str:
    return rf"(?iuU)(?:https?://)?(?:www\.)?(?:{lex.alternation(domains)})(?=[/?#\s]|$)"


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def normalize(text: Column) -> Column:
    """Lower case, one space between words, none around."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), r"^ | \z", "")


def standard_label(label: Column, mapping: Mapping[str, str] = lex.LABELS) -> Column:
    """The mapped label; one that isn't known passes through, trimmed and lower-cased."""
    key = F.lower(strip(label))
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), key)


def category(text: Column, label: Column, categories: Mapping[str, Iterable[str]] = lex.CATEGORIES) -> Column:
    """The first category that matches a malicious text; benign for any other label."""
    out = F.when(F.coalesce(F.lower(strip(label)), F.lit("")) != "malicious", lex.BENIGN)
    for name, pattern in lex.patterns(categories).items():
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(lex.OTHER_SCAM)


def matched_keywords(text: Column, categories: Mapping[str, Iterable[str]] = lex.CATEGORIES) -> Column:
    """category -> its keywords in the text, without categories that have none.

    Whole words can't overlap, so one pass finds all that are a single word;
    only those of several words are sought one by one.
    """
    categories = {name: list(words) for name, words in categories.items()}
    single = {w for words in categories.values() for w in words if w.isalnum()}
    # the two characters that fold to an ASCII letter only when case is ignored
    plain = lambda x: F.lower(F.translate(x, "ſK", "sk"))
    hits = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?iuU)\b({lex.trie(single)})\b"), F.lit(1)), plain)) if single else F.array().cast("array<string>")

    def found(held: Column) -> Column:
        def one(w: str) -> Column:
            return F.array_contains(held, w.lower()) if w in single else text.rlike(lex.bounded([w]))

        parts = [x for name, words in categories.items() for x in (F.lit(name), F.array_compact(F.array(*[F.when(one(w), F.lit(w)) for w in words])))]
        return F.map_filter(F.create_map(*parts), lambda _, v: F.size(v) > 0)

    # one element: the words are extracted once and then looked up
    return F.transform(F.array(hits), found)[0]


def url_flags(text: Column, shorteners: Iterable[str] = lex.MESSAGE_SHORTENERS) -> dict[str, Column]:
    """has_url, shortener_used, ip_as_domain, https_present; all false for a blank text."""
    text = F.coalesce(text, F.lit(""))
    shorteners = list(shorteners)
    https = text.rlike(HTTPS)
    # The cheap test first: the second runs on the few texts that pass.
    short = text.rlike(lex.endings(shorteners)) & text.rlike(shortener_pattern(shorteners))
    ip = text.rlike(DOTTED) & text.rlike(IP_HOST)
    return {"has_url": https | short | ip | (text.rlike(URL_HINT) & text.rlike(ANY_URL)), "shortener_used": short, "ip_as_domain": ip, "https_present": https}


def text_flags(text: Column, urgent: Iterable[str] = lex.URGENT, money: Iterable[str] = lex.MONEY) -> dict[str, Column]:
    """length in code points, has_urgent_word, has_money_word."""
    text = F.coalesce(text, F.lit(""))
    return {
        "length": F.length(text),
        "has_urgent_word": text.rlike(lex.bounded(urgent)),
        "has_money_word": text.rlike(f"[{lex.MONEY_SIGNS}]") | text.rlike(lex.bounded(money)),
    }


def handcrafted(text: Column, **lists) -> Column:
    """The seven features in their fixed order, as doubles."""
    a = url_flags(text, **{k: v for k, v in lists.items() if k == "shorteners"})
    b = text_flags(text, **{k: v for k, v in lists.items() if k != "shorteners"})
    order = [a["has_url"], a["shortener_used"], a["ip_as_domain"], a["https_present"], b["length"], b["has_urgent_word"], b["has_money_word"]]
    return F.array(*[c.cast("double") for c in order])


# What is replaced by urltoken and by numtoken.
URL_SPAN = (
    rf"(?iuU)(?:https?://|ftp://|www\.){_STOP}+"
    rf"|(?:https?://)?(?:{lex.alternation(lex.MESSAGE_SHORTENERS)})(?:/{_STOP}*)?"
    rf"|(?:https?://)?\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?::\d{{1,5}})?(?:/{_STOP}*)?"
    rf"|\b[a-zA-Z0-9.-]+\.(?:{_TLDS})(?:/{_STOP}*)?"
)
NUMBER_SPAN = r"(?U)(?:\+?\d{1,4}[-.\s]?)?(?:\(?\d{2,5}\)?[-.\s]?)?\d{3,5}[-.\s]?\d{3,5}\b|\b\d{5,}\b|\d{5,}"


def default_stopwords() -> list[str]:
    """Spark's English list without the signals."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted(set(StopWordsRemover.loadDefaultStopWords("english")) - set(lex.SIGNALS))


def lemma(token: Column, lexicon: Mapping[str, str] | None = None) -> Column:
    """The lemma of a lexicon that the caller supplies, else noun endings by rule; no lexicon comes with the library."""
    if lexicon:
        held = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in kv])
        return F.coalesce(F.try_element_at(held, token), lemma(token))
    return (
        F.when(~token.endswith("s") | (F.length(token) < 4), token)
        .when(token.rlike("(ss|us|is)$"), token)
        .when(token.rlike("[^aeiou]ies$"), F.regexp_replace(token, "ies$", "y"))
        .when(token.rlike("(x|ch|sh|ss)es$"), F.regexp_replace(token, "es$", ""))
        .otherwise(F.regexp_replace(token, "s$", ""))
    )


def nlp_tokens(text: Column, stopwords: Iterable[str], lemmatize: bool = True, lexicon: Mapping[str, str] | None = None) -> Column:
    """Lower case, urltoken and numtoken in place, no punctuation, stop words or noun endings."""

    def urls(low: Column) -> Column:
        hint = low.rlike(URL_HINT) | low.rlike(lex.endings(lex.MESSAGE_SHORTENERS)) | low.rlike(r"(?U)\d\.\d")
        return F.when(hint, F.regexp_replace(low, URL_SPAN, "urltoken")).otherwise(low)

    def numbers(clean: Column) -> Column:
        return F.when(clean.rlike(r"(?U)\d{3}"), F.regexp_replace(clean, NUMBER_SPAN, "numtoken")).otherwise(clean)

    # arrays of one element: what a step makes is made once, however often the next one reads it
    clean = F.transform(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), urls), numbers)[0]
    clean = F.regexp_replace(clean, r"(?U)[\W_]+", " ")
    tokens = F.filter(F.split(clean, " "), lambda t: (t != "") & ~t.isin(*stopwords))
    return F.transform(tokens, lambda t: lemma(t, lexicon)) if lemmatize else tokens


def edge_stripped_words(text: Column) -> Column:
    """Lower-cased words between white space without punctuation at their edges; emptied ones stay."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.btrim(w, F.lit(""".,!?:;"'""")))


def message_tokens(text: Column) -> Column:
    """Canonical form of a message that NFKC leaves as it is: quotes made plain, lower case, tokens by one space."""
    plain = F.translate(strip(F.coalesce(text, F.lit(""))), "‘’“”‚„`´", "''\"\"'\"''")
    return F.array_join(F.regexp_extract_all(F.lower(plain), F.lit(r"(?U)(\w+|[^\w\s]+)"), F.lit(1)), " ")

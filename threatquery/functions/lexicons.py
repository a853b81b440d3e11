"""Word lists and the patterns built from them. Lists are parameters everywhere; these are the defaults."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

# Categories in the order in which they are tried, with their keywords.
CATEGORIES: dict[str, list[str]] = {
    "prize_premium_scam": [
        "ringtone", "tone", "chat", "dating", "admirer", "txt", "reply", "club", "per msg",
        "rcvd", "landline", "win", "won", "winner", "prize", "draw", "congratulations", "claim",
    ],
    "free_offer_scam": ["free", "upgrade", "upto", "mobile", "camera", "minutes", "entitled"],
    "payment_scam": ["gov", "payment", "covid", "tap here", "apply", "bank", "account", "verify", "suspended"],
}
BENIGN, OTHER_SCAM = "benign", "other_scam"

# Label spellings of raw message tables.
LABELS = {"ham": "benign", "spam": "malicious", "smishing": "malicious", "phishing": "malicious", "benign": "benign", "malicious": "malicious"}

# Shortening services that messages are searched for.
MESSAGE_SHORTENERS = [
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "cutt.ly", "rebrand.ly",
    "tiny.cc", "shorturl.at", "adf.ly", "bl.ink", "lnkd.in", "tr.im", "tiny.pl", "qr.net", "v.gd",
    "soo.gd", "s.id", "trib.al", "bc.vc", "rb.gy", "clck.ru", "rotf.lol", "smarturl.it", "linktr.ee",
]

# Shortening services that URLs are tested for, with their subdomains.
URL_SHORTENERS = [
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly",
    "cutt.ly", "shorturl.at", "s.id", "tiny.cc", "rb.gy", "lnkd.in",
]

# Words in a URL that are security-sensitive when no letter touches them.
URL_KEYWORDS = [
    "account", "activate", "authentication", "confirm", "credential", "login", "password",
    "payment", "recover", "secure", "signin", "update", "verify", "verification",
]

# Substrings and characters that the scan reports, in this order.
SCAN_KEYWORDS = ["login", "verify", "password", "account", "update", "secure"]
SCAN_CHARACTERS = ["@", "%", "\\"]

# Words of pressure.
URGENT = [
    "urgent", "urgently", "immediate", "immediately", "asap", "hurry", "alert", "warning", "critical",
    "suspended", "suspension", "suspend", "expire", "expires", "expired", "expiring", "deadline",
    "attention", "action", "important", "now", "instant", "instantly", "final notice", "last chance", "act now",
]

# Words and signs of money.
MONEY = [
    "cash", "dollar", "dollars", "usd", "cent", "cents", "money", "pound", "pounds", "gbp", "euro", "euros", "eur",
    "prize", "prizes", "reward", "rewards", "refund", "refunds", "win", "won", "winner", "funds", "fund",
    "payment", "payments", "pay", "paid", "fee", "fees", "cost", "costs", "loan", "loans", "credit", "credits",
    "bonus", "bonuses", "crypto", "bitcoin", "btc", "eth", "wallet", "cheque", "check", "checks", "salary",
    "deposit", "deposits", "withdrawal", "withdrawals", "million", "billion", "thousand", "jackpot",
]
MONEY_SIGNS = "$£€¥₹"

# Top-level domains by which a bare domain counts as a URL.
BARE_TLDS = "com org net edu gov io co xyz info biz cc tv me site online top club vip app dev tech".split()

# Words left out of the most common words, and signals that no stop list may remove.
EDA_STOPWORDS = ["the", "a", "to", "you", "your", "and", "is", "for", "of", "in", "on", "i", "it"]
SIGNALS = ["now", "free", "win", "call", "stop", "urgent", "your", "you"]

#: Words that do occur in the supplied tables, so that the same queries have something to find.
DATA_CATEGORIES = {"insult": ["worthless", "stupid", "idiot", "moron"], "article": ["the", "der", "la", "le"], "glue": ["of", "de", "und", "and"]}
DATA_URGENT = ["that", "this", "nicht", "pour"]
DATA_MONEY = ["token", "version", "licensed"]


def alternation(words: Iterable[str]) -> str:
    """Longest first, so that no word hides a longer one."""
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in sorted(words, key=lambda w: (-len(w), w)))


def trie(words: Iterable[str]) -> str:
    """The same alternatives by common beginnings, so that a place in a text is left at the first letter that fits none."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def build(node: dict) -> str:
        parts = [re.escape(c).replace(r"\ ", " ") + build(rest) for c, rest in sorted(node.items()) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})"
        return body + "?" if "" in node else body

    return build(root)


def bounded(words: Iterable[str]) -> str:
    """Words as whole words: Unicode-aware, in either case."""
    return rf"(?iuU)\b(?:{trie(words)})\b"


def endings(domains: Iterable[str]) -> str:
    """A quick test that every text with one of the domains passes."""
    return rf"(?iu)\.(?:{trie({d.rsplit('.', 1)[-1] for d in domains})})"


def bounded_re2(words: Iterable[str]) -> str:
    """The same for engines without look-around and with ASCII boundaries."""
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({alternation(words)})([^\p{{L}}\p{{N}}_]|$)"


def patterns(categories: Mapping[str, Iterable[str]]) -> dict[str, str]:
    return {name: bounded(words) for name, words in categories.items()}

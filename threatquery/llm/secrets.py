"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived:
an AND of clauses, each an OR of strings, each the AND of its trigrams. The
index covers those trigrams over the lower-cased texts; its posting lists are
kept by shard, so that a list is bounded however common its trigram. Lower case
is that of the engine, which folds more than A-Z: that only adds candidates. Posting
lists are intersected and united as the queries say, and only the candidates
that remain are verified by the regular expression. A rule that no trigram must
match (runs of hex digits) scans every text.

Positions are code points. Matches of a rule are leftmost and don't overlap; a
match that fails the rule's test on its length is dropped after matching, as
another expression would match elsewhere.

Edge cases: a null text is empty and has no spans; equal rows get equal
results; rows are told apart by a hash of id and text, and rows that share it
share their candidates only; other columns, whatever their names, pass through
``redact`` untouched; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatquery.llm._native import blocks, cut, greatest_before, let, sums_before

#: Rows of a shard of the index, about.
SHARD = 2048
MASK = "[SECRET]"


def any_case(words: str) -> str:
    """The expression with each letter in either case."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0
    least: int = 0  # characters that the group must have


# The base rules of the contract, then widely published formats of keys.
RULES = (
    Rule("assign", "(" + any_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}"),  # a run of 16 or more is the same as a run that is tested for 16
    Rule("github", "gh[opsru]_[A-Za-z0-9]{36}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)

#: An AND of clauses; a clause is an OR of trigram sets.
Query = list[list[frozenset[str]]]


def trigrams(strings: set[str]) -> list[frozenset[str]]:
    """Some trigrams of each string, a fourth as many as it has characters; first those that many of the strings hold.

    Fewer lists to keep and to intersect than with every trigram; what more candidates that leaves is verified.
    """
    strings = {s for s in strings if not any(o != s and o in s for o in strings)}  # a text with a longer one has the shorter
    held = {s: {s[k : k + 3] for k in range(len(s) - 2)} for s in strings}
    times = Counter(t for own in held.values() for t in own)
    return sorted({frozenset(sorted(own, key=lambda t: (-times[t], t))[: -(-len(s) // 4)]) for s, own in held.items()}, key=sorted)


def derive(regex: str, most: int = 24) -> Query:
    """The trigram query that every text with a match satisfies once A-Z are lower-cased; [] if none is mandatory."""
    parser = re._parser
    query: Query = []

    def flush(exact: set[str]) -> set[str]:
        if exact and all(len(s) >= 3 for s in exact):
            sets = trigrams(exact)
            query.append([s for s in sets if not any(o < s for o in sets)])
        return {""}

    def strings(items) -> set[str] | None:
        """All strings of a part, if they are few."""
        out = {""}
        for op, arg in items:
            if (own := one(op, arg)) is None or len(out) * len(own) > most:
                return None
            out = {a + b for a, b in product(out, own)}
        return out

    def one(op, arg) -> set[str] | None:
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}
        if name == "IN":
            if all(str(o) == "LITERAL" for o, _ in arg):
                return {chr(a).lower() for _, a in arg}
            return None
        if name == "BRANCH":
            parts = [strings(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if name == "SUBPATTERN":
            return strings(arg[-1])
        if name == "MAX_REPEAT" and arg[1] is not parser.MAXREPEAT and arg[1] <= 5:
            own = strings(arg[2])
            return None if own is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(own, repeat=n)}
        return None

    exact = {""}
    for op, arg in parser.parse(regex):
        own = one(op, arg)
        if own is None or len(exact) * len(own) > most:
            exact = flush(exact)
            if own is not None and len(own) <= most:
                exact = own
        else:
            exact = {a + b for a, b in product(exact, own)}
    flush(exact)
    return query


def rows_with_key(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``, so that none of theirs meets one of ours) and key."""
    key = F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))


def index(keyed: DataFrame, terms: list[str], shards: int) -> DataFrame:
    """shard, term, keys: the sorted posting lists of the terms over lower-cased texts."""
    held = let(F.lower("row.text"), lambda low: F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)))
    postings = keyed.select("key", F.explode(held).alias("term"))
    shard = F.pmod(F.col("key"), F.lit(shards)).cast("int")
    return postings.groupBy(shard.alias("shard"), "term").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """key and the kinds of the rules whose query its text satisfies."""
    lists = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("term", "keys"))).alias("lists"))
    empty = F.array().cast("array<bigint>")

    def posting(term: str) -> Column:
        return F.coalesce(F.try_element_at("lists", F.lit(term)), empty)

    def combine(parts: list[Column], how) -> Column:
        out = parts[0]
        for part in parts[1:]:
            out = how(out, part)
        return out

    def tagged(keys: Column, kind: str) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(kind).alias("kind")))

    found = []
    for kind, query in queries.items():
        clauses = [combine([combine([posting(t) for t in sorted(s)], F.array_intersect) for s in clause], F.array_union) for clause in query]
        found.append(tagged(combine(clauses, F.array_intersect), kind))
    return lists.select(F.explode(F.concat(*found)).alias("x")).groupBy("x.key").agg(F.collect_set("x.kind").alias("kinds"))


_SPANS = "array<struct<start:int,place:int,end:int,kind:string>>"


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """Spans of a rule in a text, as structs (start, place, end, kind). The expression is a literal, and so compiled once."""
    sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.length)
    gaps = F.transform(F.split(text, rule.regex, -1), F.length)

    def found(sizes: Column) -> Column:
        tested = F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)), F.length) if rule.group else sizes
        # a match starts after all gaps up to its own and all matches before it
        each = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(sizes)).alias("gap"), sizes.alias("size"), tested.alias("tested"))

        def placed(each: Column) -> Column:
            before = sums_before(F.transform(each, lambda x: x["gap"] + x["size"]))
            starts = F.zip_with(each, before, lambda x, b: F.struct((x["gap"] + b).alias("start"), x["size"].alias("size"), x["tested"].alias("tested")))
            kept = F.filter(starts, lambda x: x["tested"] >= rule.least) if rule.least else starts
            return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), (x["start"] + x["size"]).alias("end"), F.lit(rule.kind).alias("kind")))

        return let(each, placed)

    return let(sizes, found)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row`` (all columns of ``docs``) and spans: all spans by start, then by the order of the rules."""
    spark = docs.sparkSession
    queries = {r.kind: q for r in rules if (q := derive(r.regex))}
    terms = sorted({t for q in queries.values() for clause in q for s in clause for t in s})
    keyed = rows_with_key(docs)
    # Posting lists stay short as shards follow the number of rows.
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // SHARD))
    found = candidates(index(keyed, terms, shards), queries)
    marked = keyed.join(found, "key", "left")
    text = F.coalesce("row.text", F.lit(""))
    none, parts = F.array().cast(_SPANS), []
    for place, r in enumerate(rules):
        matches = F.rlike(text, F.lit(r.regex))
        if r.kind in queries:
            matches = F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) & matches
        parts.append(F.when(matches, spans_of(text, r, place)).otherwise(none))
    return marked.select("row", F.array_sort(F.concat(*parts)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = 3) -> DataFrame:
    """doc_id, the count of each base rule, the digest of base spans and all spans as text."""
    found = scan(docs.select("doc_id", "text"), rules)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(r.kind) for r in rules[:base]]
    own = joined(F.filter("spans", lambda s: s["place"] < base))
    return found.select("row.doc_id", *counts, F.sha2(own.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = MASK) -> DataFrame:
    """``docs`` with every span, overlapping ones merged, replaced by ``mask``; n_chars follows where it is there."""
    own = F.col("row.text")

    def masked(spans: Column) -> Column:
        ends = greatest_before(F.transform(spans, lambda s: s["end"]))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        # The part of the text between a span and all before it, then the mask; a span that begins within another has neither.
        piece = lambda held: lambda s, e: F.when(s["start"] >= e, F.concat(cut(held, e, s["start"] - e), F.lit(mask))).otherwise(F.lit(""))
        return F.concat(let(blocks(own), lambda held: F.array_join(F.zip_with(spans, ends, piece(held)), "")), F.substring(own, last + 1, F.length(own)))

    found = scan(docs, rules)
    whole = let(F.col("spans"), masked)
    hit = F.size("spans") > 0
    found = found.select("row", hit.alias("hit"), F.when(hit, whole).otherwise(own).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("hit"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def oracle(rules: tuple[Rule, ...] = RULES, base: int = 3) -> str:
    """DuckDB SQL for ``report``: the expressions run over every text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lists, spans = [], []
    for place, r in enumerate(rules):
        q = quote(r.regex)
        lists.append(f"regexp_extract_all(t, {q}, 0) AS m{place}, regexp_extract_all(t, {q}, {r.group}) AS g{place}, string_split_regex(t, {q}) AS s{place}")
        begin = f"coalesce(list_sum([length(x) for x in s{place}[1:i]]), 0) + coalesce(list_sum([length(x) for x in m{place}[1:i-1]]), 0)"
        spans.append(f"[{{'start': ({begin})::BIGINT, 'place': {place}, 'end': ({begin} + length(m{place}[i]))::BIGINT, 'kind': '{r.kind}'}} for i in range(1, len(m{place}) + 1) if length(g{place}[i]) >= {r.least}]")
    every = spans[0]
    for s in spans[1:]:
        every = f"list_concat({every}, {s})"
    text = lambda which: f"coalesce(array_to_string([x.kind || ':' || x.start || ':' || x.end for x in {which}], ','), '')"
    counts = ", ".join(f"len([x for x in z if x.place = {k}])::BIGINT AS n_{r.kind}" for k, r in enumerate(rules[:base]))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {", ".join(lists)} FROM d),
s AS (SELECT doc_id, list_sort({every}) AS z FROM m)
SELECT doc_id, {counts}, sha256({text(f"[y for y in z if y.place < {base}]")}) AS base_sha256, {text("z")} AS spans FROM s"""

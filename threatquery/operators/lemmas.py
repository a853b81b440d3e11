"""Noun lemmas by detachment rules whose results must occur in a vocabulary.

A form's own exceptions come first; else its endings are detached by rule, once
and, if nothing is known, again. Of the results that the vocabulary knows, the
form itself among them, the shortest is the lemma; a form without any stays.
The vocabulary is the caller's, or the words of the table itself. Forms meet it
by joins over distinct words, and texts meet only the forms that change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatquery.sources.sinks import materialise

# Endings of nouns and what takes their place, in the order in which they are tried.
RULES = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")]
#: Forms that end otherwise have no rule.
CHANGES = "(s|men)$"


def detached(forms: Column) -> Column:
    """All results of one detachment from an array of forms, in the order of the rules."""
    one = lambda w: F.array_compact(F.array(*[F.when(w.endswith(end), F.concat(F.substring(w, F.lit(1), F.length(w) - len(end)), F.lit(new))) for end, new in RULES]))
    return F.flatten(F.transform(forms, one))


def lexicon(words: DataFrame, vocabulary: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """word, lemma of the distinct ``words`` (a column word) that have another lemma than themselves.

    ``vocabulary``: a column word. ``exceptions``: form and lemma, a form may
    have several.
    """
    known = vocabulary.select(F.col("word").alias("result")).where("result is not null and result <> ''").distinct()
    distinct = words.select("word").where(F.col("word").isNotNull()).distinct()
    irregular = None
    if exceptions is not None:
        own = exceptions.select(F.col("form").alias("word"), F.col("lemma").alias("result")).where("word is not null")
        irregular = distinct.join(own.select("word").distinct(), "word", "left_semi")
        distinct = distinct.join(own.select("word").distinct(), "word", "left_anti")
        listed = irregular.select("word", F.col("word").alias("result"), F.lit(-1).alias("at")).unionByName(irregular.join(own, "word").select("word", "result", F.lit(0).alias("at")))
    forms = distinct.where(F.col("word").rlike(CHANGES))
    once = detached(F.array("word"))
    tried = forms.select("word", F.posexplode(F.concat(F.array("word"), once, detached(once))).alias("at", "result"), (1 + F.size(once)).alias("first"))
    tried = tried.select("word", "result", F.when(F.col("at") < F.col("first"), F.col("at")).otherwise(1000 + F.col("at")).alias("at"))
    if irregular is not None:
        tried = tried.unionByName(listed)
    found = tried.join(known, "result")
    # results of the first turn count before those of the second; then the shortest, then the first
    best = found.groupBy("word").agg(F.min(F.struct((F.col("at") >= 1000).alias("late"), F.length("result").alias("size"), "at", "result")).alias("best"))
    return best.select("word", F.col("best.result").alias("lemma")).where("word <> lemma")


def lemmatized(rows: DataFrame, key: str, tokens: str, vocabulary: DataFrame | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """``key`` and ``tokens`` with each token's lemma in its place. ``key`` is distinct; without a vocabulary the table's own words are it."""
    # written once, as the tokens and the words are read several times
    rows = materialise(rows.select(key, tokens), "tokens")
    every = materialise(rows.select(F.explode(tokens).alias("word")).distinct(), "words")
    found = lexicon(every, every if vocabulary is None else vocabulary, exceptions)
    asked = rows.select(key, F.explode(F.array_distinct(tokens)).alias("word"))
    if exceptions is None:
        asked = asked.where(F.col("word").rlike(CHANGES))
    changed = asked.join(found, "word").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "lemma"))).alias("_lemma"))
    out = rows.select(key, tokens).join(changed, key, "left")
    lemma = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(F.col("_lemma"), t), t))
    return out.select(key, F.when(F.col("_lemma").isNull(), F.col(tokens)).otherwise(lemma).alias(tokens))

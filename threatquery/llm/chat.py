"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered turn by turn as a header, the text and a closing
line. The grammar is deterministic: turns end at closing lines, each begins
with a header, and no control string may occur within a text unless a backslash
precedes it; an escaped one loses one backslash when it is read. The rendered
text is parsed again and compared with the source. Texts that don't come back
are escaped, and the whole is parsed again, then with every text escaped;
should even that differ, the job fails rather than write a wrong text.

Edge cases: a null text or role is empty; other roles than the named ones are
kept in a header of their own; rows of equal turn come by role, then text, and
a null turn comes first; rows with a null conv_id are one conversation; an
empty table gives no rows; other columns, whatever their names, are not read. A conversation is one
row of the result, so its turns meet in one task, as its digests need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatquery.llm._native import blocks, cut, let, sums_before

# Fixed values of the template.
ROLES = ("system", "user", "assistant", "tool")
OTHER = "Other"
CLOSE = "\n</turn>\n"
ROLE_END = "\n<role/>\n"
CONTROL = "(### (?:System|User|Assistant|Tool|Other):|</turn>|<role/>)"
LOSS_ROLE = "assistant"
_TURN = "struct<role:string,text:string>"


def escape(text: Column) -> Column:
    """A backslash more before every control string, with what backslashes it has."""
    return F.regexp_replace(text, r"(\\*)" + CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)" + CONTROL, "$1$2")


def header(role: Column, escaped: bool) -> Column:
    named = F.concat(F.lit("### "), F.initcap(role), F.lit(": "))
    own = escape(role) if escaped else role
    return F.when(role.isin(*ROLES), named).otherwise(F.concat(F.lit(f"### {OTHER}: "), own, F.lit(ROLE_END)))


def render(turn: Column, escaped: bool) -> Column:
    text = escape(turn["text"]) if escaped else turn["text"]
    return F.concat(header(turn["role"], escaped), text, F.lit(CLOSE))


def segments(formatted: Column) -> Column:
    """Turns as written, without their closing lines."""
    parts = F.split(formatted, CLOSE, -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def _label(segment: Column) -> Column:
    return F.regexp_extract(segment, "^### ([A-Z][a-z]+): ", 1)


def _head_size(segment: Column) -> Column:
    """Code points before the text of a segment."""
    plain = F.length(_label(segment)) + 6
    return F.when(_label(segment) == OTHER, F.instr(segment, ROLE_END) + len(ROLE_END) - 1).otherwise(plain)


def _role(segment: Column) -> Column:
    plain = len(f"### {OTHER}: ")
    other = unescape(F.substring(segment, F.lit(plain + 1), F.instr(segment, ROLE_END) - 1 - plain))
    return F.when(_label(segment) == OTHER, other).otherwise(F.lower(_label(segment)))


def _body(segment: Column) -> Column:
    return F.substring(segment, _head_size(segment) + 1, F.length(segment))


def parse(formatted: Column) -> Column:
    """Turns read back; a segment that breaks the grammar gives a null turn, which equals no source."""

    def one(segment: Column) -> Column:
        bare = rf"(?<!\\){CONTROL}"
        raw_role = F.when(_label(segment) == OTHER, F.substring(segment, F.lit(len(OTHER) + 7), F.instr(segment, ROLE_END) - 7 - len(OTHER))).otherwise(F.lit(""))
        sound = _label(segment).isin(OTHER, *[r.capitalize() for r in ROLES]) & ~_body(segment).rlike(bare) & ~raw_role.rlike(bare)
        turn = F.struct(_role(segment).alias("role"), unescape(_body(segment)).alias("text"))
        return F.when(sound, turn)

    return F.transform(segments(formatted), one)


def _text_of(turns: Column, pick) -> Column:
    return F.array_join(F.transform(turns, pick), "")


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss (spans of code points: start from 0, size) of every conversation."""
    rows = conversations.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    whole = whole.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))

    def same(found: Column) -> Column:
        return F.coalesce(found == F.col("turns"), F.lit(False))

    def alone(turn: Column) -> Column:
        return F.coalesce(parse(render(turn, False)) == F.array(turn), F.lit(False))

    whole = whole.withColumn("plain", _text_of(F.col("turns"), lambda t: render(t, False)))
    whole = whole.withColumn("plain_ok", same(parse(F.col("plain"))))
    some = _text_of(F.col("turns"), lambda t: F.when(alone(t), render(t, False)).otherwise(render(t, True)))
    whole = whole.withColumn("some", F.when(F.col("plain_ok"), F.col("plain")).otherwise(some))
    whole = whole.withColumn("some_ok", F.col("plain_ok") | same(parse(F.col("some"))))
    every = F.when(F.col("some_ok"), F.col("some")).otherwise(_text_of(F.col("turns"), lambda t: render(t, True)))
    whole = whole.withColumn("every", every)
    sound = F.col("some_ok") | same(parse(F.col("every")))
    whole = whole.withColumn("formatted", F.when(sound, F.col("every")).otherwise(F.raise_error(F.lit("a conversation doesn't survive the round trip"))))

    # Where a turn starts: after all turns before it with their closing lines.
    def spans(parts: Column) -> Column:
        at = sums_before(F.transform(parts, lambda p: F.length(p) + len(CLOSE)))
        return F.zip_with(parts, at, lambda p, a: F.struct((a + _head_size(p)).cast("int").alias("start"), (F.length(p) - _head_size(p)).cast("int").alias("size"), (_role(p) == LOSS_ROLE).alias("own")))

    loss = F.transform(F.filter(let(segments(F.col("formatted")), spans), lambda s: s["own"]), lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size")))
    return whole.select("conv_id", "formatted", loss.alias("loss"))


def digests(found: DataFrame) -> DataFrame:
    """What ``formatted`` holds, read back from its output."""
    turns = parse(F.col("formatted"))
    loss = let(blocks(F.col("formatted")), lambda held: F.array_join(F.transform("loss", lambda s: unescape(cut(held, s["start"], s["size"]))), ""))
    found = found.withColumn("turns", turns).withColumn("under", loss)
    text = _text_of(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return found.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("under").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("under").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def oracle(extra: tuple[tuple[int, int, str, str], ...]) -> str:
    """DuckDB SQL for ``digests``: everything from the source, and the lengths that the template gives."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = " UNION ALL ".join(f"SELECT {c}::BIGINT, {t}::BIGINT, {quote(r)}, {quote(x)}" for c, t, r, x in extra)
    control = quote(CONTROL)
    return f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {values})
), t AS (
  SELECT *, len(regexp_extract_all(text, {control})) + length(text) + {len(CLOSE)} + CASE WHEN role IN ({", ".join(map(quote, ROLES))}) THEN length(role) + 6
    ELSE {len(OTHER) + 6 + len(ROLE_END)} + length(role) + len(regexp_extract_all(role, {control})) END AS n FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

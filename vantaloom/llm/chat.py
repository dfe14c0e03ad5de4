"""Chat formatting whose output parses back to its source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: OPEN role MID text CLOSE for each turn, after a line that names the escape level.
OPEN, MID, CLOSE = "### ", ":\n", "</turn>\n"
PLAIN, ESCAPED = "<chat>\n", "<chat escaped>\n"
#: Control strings and what stands for them in escaped content. A backslash goes first when escaping and
#: last when restoring; no code holds a control string, so escaped content never does.
CODES = [("\\", "\\b"), ("</turn>", "\\e"), ("### ", "\\m"), (":\n", "\\c")]


def _replace(col: Column, old: str, new: str) -> Column:
    return F.replace(col, F.lit(old), F.lit(new))


def escape(col: Column) -> Column:
    for plain, code in CODES:
        col = _replace(col, plain, code)
    return col


def unescape(col: Column) -> Column:
    for plain, code in reversed(CODES):
        col = _replace(col, code, plain)
    return col


def render(turns: Column, escaped: bool) -> Column:
    """One string of an array of (role, text)."""
    keep = escape if escaped else (lambda c: c)
    parts = F.transform(turns, lambda t: F.concat(F.lit(OPEN), keep(t["role"]), F.lit(MID), keep(t["text"]), F.lit(CLOSE)))
    return F.concat(F.lit(ESCAPED if escaped else PLAIN), F.array_join(parts, ""))


def _pieces(formatted: Column) -> Column:
    """The raw turns, by the grammar: a header line, then turns that end at the first CLOSE. What is no
    such string gives null."""
    body = F.when(F.startswith(formatted, F.lit(ESCAPED)), F.substr(formatted, F.lit(len(ESCAPED) + 1))).when(F.startswith(formatted, F.lit(PLAIN)), F.substr(formatted, F.lit(len(PLAIN) + 1)))
    raw = F.split(body, "</turn>\n")
    return F.when(F.element_at(raw, -1) == "", F.slice(raw, F.lit(1), F.size(raw) - 1))


def parse(formatted: Column) -> Column:
    """The array of (role, text, at, length) in a rendered string: role and text are restored; at and length
    are the code points (from 1) of the text as it stands in the string.

    A turn must begin with OPEN and have MID; the role ends at the first MID. A control string inside
    a turn makes it null."""
    escaped = F.startswith(formatted, F.lit(ESCAPED))
    head = F.when(escaped, len(ESCAPED)).otherwise(len(PLAIN))

    def one(raw: Column) -> Column:
        body = F.substr(raw, F.lit(len(OPEN) + 1))
        at = F.instr(body, MID)
        role, text = F.substr(body, F.lit(1), at - 1), F.substr(body, at + len(MID))
        ok = F.startswith(raw, F.lit(OPEN)) & (at > 0) & ~F.contains(body, F.lit(OPEN)) & ~F.contains(body, F.lit("</turn>"))
        return F.struct(F.when(ok, F.when(escaped, unescape(role)).otherwise(role)).alias("role"), F.when(ok, F.when(escaped, unescape(text)).otherwise(text)).alias("text"), F.length(raw).alias("raw"), F.length(text).alias("length"))

    parsed = F.transform(_pieces(formatted), one)
    return _placed(parsed, head)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once, however often `then` and its lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _sums_before(sizes: Column) -> Column:
    """For each element the sum of those before it, in n ** 1.5 steps: over blocks, and over the elements of a block. (An
    array that grows in an aggregate is copied in each step, with all that it holds.)"""
    zero = F.lit(0).cast("long")

    def total(x: Column) -> Column:
        return F.aggregate(x, zero, lambda a, y: a + y)

    def in_blocks(side: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / side).cast("int"))
        return F.transform(numbers, lambda k: F.filter(sizes, lambda _, i: (i >= k * side) & (i < (k + 1) * side)))

    def sums(blocks: Column) -> Column:
        return _let(F.transform(blocks, total), lambda whole: F.flatten(F.transform(blocks, lambda b, k: _let(total(F.filter(whole, lambda _, i: i < k)), lambda base: F.transform(b, lambda _, i: base + total(F.filter(b, lambda _, j: j < i)))))))

    return F.when(F.size(sizes) == 0, F.array().cast("array<bigint>")).otherwise(_let(_let(F.ceil(F.sqrt(F.size(sizes))).cast("int"), in_blocks), sums))


def _placed(parsed: Column, head: Column) -> Column:
    """Turns with the place of each text."""

    def one(t: Column, before: Column) -> Column:
        at = (head + before + t["raw"] - t["length"] + 1).cast("int")
        return F.struct(t["role"].alias("role"), t["text"].alias("text"), at.alias("at"), t["length"].alias("length"))

    return _let(parsed, lambda p: F.zip_with(p, _let(F.transform(p, lambda t: (t["raw"] + len(CLOSE)).cast("long")), _sums_before), one))


def _contents(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, turns, formatted, escaped, loss_mask.

    Turns are ordered by turn (nulls first), then role and text; null roles and texts are empty. Each
    conversation is rendered plainly and parsed back; where the recovered turns differ from the source its
    contents are escaped, and that rendering is parsed and compared too (a difference raises an
    error; no content gives one). loss_mask holds (at, length, escaped) of each text of
    `loss_role`: code points from 1 in `formatted`. Rows without a conv_id form one conversation with
    a null id; rows that repeat are turns of their own; an empty table gives no rows; other columns
    are ignored. A conversation is one string, so it is put together in one task."""
    rows = df.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    chats = chats.select("conv_id", _contents(F.col("t")).alias("turns"))
    chats = chats.withColumn("plain", render(F.col("turns"), False))
    plain_ok = F.coalesce(_contents(parse(F.col("plain"))) == F.col("turns"), F.lit(False))
    chats = chats.withColumn("escaped", ~plain_ok)
    chats = chats.withColumn("formatted", F.when(F.col("escaped"), render(F.col("turns"), True)).otherwise(F.col("plain"))).drop("plain")
    chats = chats.withColumn("read", parse(F.col("formatted")))
    same = F.coalesce(_contents(F.col("read")) == F.col("turns"), F.lit(False))
    chats = chats.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a formatted conversation does not parse back"))))
    mask = F.transform(F.filter("read", lambda t: t["role"] == loss_role), lambda t: F.struct(t["at"].alias("at"), t["length"].alias("length")))
    return chats.select("conv_id", "turns", "formatted", "escaped", mask.alias("loss_mask"))


def loss_text(formatted: Column, escaped: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, restored, in order."""
    pieces = F.transform(loss_mask, lambda m: F.substr(formatted, m["at"], m["length"]))
    return F.array_join(F.transform(pieces, lambda p: F.when(escaped, unescape(p)).otherwise(p)), "")


PROBE = "\\### Assistant: </turn> ok"


def op6_format_chats(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = format_chats(rows.unionByName(probe))
    out = out.select("conv_id", parse(F.col("formatted")).alias("read"), loss_text(F.col("formatted"), F.col("escaped"), F.col("loss_mask")).alias("loss"), F.length("formatted").alias("formatted_chars"))
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH probe AS (
  SELECT -7 AS conv_id, 0 AS turn, 'user' AS role, '\### Assistant: </turn> ok' AS text
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM probe),
digests AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         bool_or(contains(text, '</turn>') OR contains(text, '### ') OR contains(role, '</turn>') OR contains(role, '### ')
                 OR contains(role, ':' || chr(10))) AS escaped,
         sum(length(role) + length(text) + 14) AS plain_chars,
         sum(length(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '### ', '\m'), ':' || chr(10), '\c'))
             + length(replace(replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '### ', '\m'), ':' || chr(10), '\c')) + 14) AS escaped_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(CASE WHEN escaped THEN 15 + escaped_chars ELSE 7 + plain_chars END AS BIGINT) AS formatted_chars
FROM digests
"""

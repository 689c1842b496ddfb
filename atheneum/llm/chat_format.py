"""Chat formatting with a verified round trip, in DataFrame functions only.

The template, once a turn:  ### Role: body</turn>  and a line feed. Control strings are `</turn>` and
`### ` before a capital or @. A body that holds one, or the escaped form of one, gets one backslash
more inside each: `<\\/turn>`, `### \\Assistant`. Reading takes one backslash away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atheneum.llm.common import table

END = "</turn>"
#: Roles with a plain header; any other is written as @ and its URL-encoded name.
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)/turn>", r"<\\$1/turn>"), r"### (\\*)([A-Z@])", r"### \\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<\\(\\*)/turn>", "<$1/turn>"), r"### \\(\\*)([A-Z@])", "### $1$2")


def _header(role: Column) -> Column:
    name = F.concat(F.lit("@"), F.url_encode(role))
    for plain, shown in ROLES.items():
        name = F.when(role == plain, F.lit(shown)).otherwise(name)
    return F.concat(F.lit("### "), name, F.lit(": "))


def _role(header: Column) -> Column:
    role = F.url_decode(F.substring(header, F.lit(2), F.length(header)))
    for plain, shown in ROLES.items():
        role = F.when(header == shown, F.lit(plain)).otherwise(role)
    return role


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; null where the grammar does not hold."""
    pieces = F.split(formatted, "</turn>", -1)
    starts = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda x, i: F.when(i == 0, x).when(x.startswith("\n"), F.substring(x, F.lit(2), F.length(x))))
    pattern = r"(?s)^### ([A-Z][a-z]+|@[^ ]*?): (.*)$"

    def turn(x: Column) -> Column:
        body = F.regexp_extract(x, pattern, 2)
        sound = x.rlike(pattern) & ~body.rlike("### [A-Z@]")
        return F.when(sound, F.struct(_role(F.regexp_extract(x, pattern, 1)).alias("role"), unescape(body).alias("text")))

    turns = F.transform(starts, turn)
    whole = F.element_at(pieces, -1).isin("", "\n") & ~F.exists(turns, lambda t: t.isNull())
    return F.when(formatted == "", F.array().cast("array<struct<role:string,text:string>>")).when(whole, turns)


def chat_format(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (source), formatted, loss_spans, read_turns, round_trip.

    Turns are ordered by turn, then role and text; null turns come first, null role and text count as
    empty, a null conv_id is a conversation of its own. Each turn is rendered bare, reparsed and, where
    the reading differs from the source or the body holds a control string, escaped; the whole text is
    then reparsed and compared again (round_trip). loss_spans are 0-based code point ranges of the
    assistants' bodies in formatted. An empty table gives no rows; further columns are ignored.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    by = by.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def rendered(t: Column) -> Column:
        bare = F.concat(_header(t["role"]), t["text"], F.lit(END))
        back = parse(bare)
        same = F.coalesce((F.size(back) == 1) & (back[0]["text"] == t["text"]) & (back[0]["role"] == t["role"]), F.lit(False))
        return F.struct(_header(t["role"]).alias("head"), F.when(same, t["text"]).otherwise(escape(t["text"])).alias("body"), (t["role"] == "assistant").alias("learned"))

    by = by.withColumn("r", F.transform("turns", rendered))
    formatted = F.array_join(F.transform("r", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END) + 1).alias("at"), F.when(x["learned"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("r", zero, step, lambda acc: acc["spans"])
    by = by.select("conv_id", "turns", formatted.alias("formatted"), spans.alias("loss_spans"))
    read = by.withColumn("read_turns", parse(F.col("formatted")))
    return read.withColumn("round_trip", F.coalesce(F.col("read_turns") == F.col("turns"), F.lit(False)))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    out = chat_format(told.union(more))
    whole = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = unescape_spans(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "round_trip",
    )


def unescape_spans(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask: each span cut out of the formatted text, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 2 + length(text) + 8 + len(regexp_extract_all(text, '<\\*/turn>'))
           + len(regexp_extract_all(text, '### \\*[A-Z@]')))::BIGINT AS formatted_chars,
       true AS round_trip
FROM t GROUP BY conv_id
"""

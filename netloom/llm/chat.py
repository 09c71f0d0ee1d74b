r"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted by (turn, role, text),
runs of the same role are merged into one message, and all is concatenated:

    <|im_start|>ROLE\nTEXT<|im_sep|>TEXT<|im_end|>\n

Control strings inside a text (or role) get one backslash after their first
character, or one more where backslashes stand there already; ``unescape`` takes
one away.  So texts are read back exactly, and no text can open or close a turn.

Defined results: a null text or role counts as empty; rows that tie in turn are
ordered by role, then text; repeated rows are turns of their own; rows with a
null conv_id are one conversation, a null turn comes first; an empty table gives
an empty result; other columns are ignored; very long texts are formatted whole.
Everything of one conversation meets in one row, as the format asks: one whose
text is beyond what a row of Spark's holds (2 GB) fails, and says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What follows the first character (``<`` or ``[``) of a control string.  None holds ``<`` or ``[``.
RESTS = r"\|[A-Za-z0-9_]+\|>|/?s>|/?SYS>|/?INST\]"
#: A conversation that shows escaping: its texts hold control strings.
EXTRA_ID, EXTRA_TEXT = -7, "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={RESTS})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={RESTS})", r"$1$2")


def escape_role(role: Column) -> Column:
    """A role is one line: its line feeds and backslashes are written out too."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # Pairs are taken from the left, so that "\\n" is a backslash and an n.
    undone = F.regexp_replace(F.regexp_replace(role, r"\\n|\\\\", "$0\u0001"), r"\\n\u0001", "\n")
    return unescape(F.regexp_replace(undone, r"\\\\\u0001", r"\\"))


def formatted(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_runs): the whole text and the loss mask as runs of (loss, code points)."""
    turns = conversations.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # Where runs of one role begin; each run is a slice of the sorted turns.
    begins = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]))
    chats = chats.withColumn("b", begins)
    runs = F.transform("b", lambda b, k: F.struct(F.get("t", b)["role"].alias("role"), F.transform(F.slice("t", b + 1, F.coalesce(F.get("b", k + 1), F.size("t")) - b), lambda x: escape(x["text"])).alias("texts")))
    chats = chats.select("conv_id", runs.alias("runs"))
    text = F.array_join(F.transform("runs", lambda r: F.concat(F.lit(START), escape_role(r["role"]), F.lit("\n"), F.array_join(r["texts"], SEP), F.lit(f"{END}\n"))), "")

    def pieces(r: Column) -> Column:
        """Lengths of a message: its head, then each text and the mark after it."""
        loss = r["role"] == loss_role
        last = F.size(r["texts"]) - 1
        head = F.struct(F.lit(False).alias("loss"), (F.length(escape_role(r["role"])) + len(START) + 1).alias("chars"))
        body = F.flatten(F.transform(r["texts"], lambda x, i: F.array(F.struct(loss.alias("loss"), F.length(x).alias("chars")), F.struct(F.lit(False).alias("loss"), F.when(i == last, len(END) + 1).otherwise(len(SEP)).alias("chars")))))
        return F.concat(F.array(head), body)

    return chats.select("conv_id", text.alias("formatted"), F.flatten(F.transform("runs", pieces)).alias("loss_runs"))


def parsed(text: Column) -> Column:
    """The turns of a formatted conversation, as structs (role, text)."""
    messages = F.filter(F.split(text, START.replace("|", r"\|")), lambda m, i: i > 0)

    def turns(m: Column) -> Column:
        role = unescape_role(F.substring_index(m, "\n", 1))
        body = F.regexp_extract(m, rf"(?s)^[^\n]*\n(.*){END.replace('|', chr(92) + '|')}\n$", 1)
        return F.transform(F.split(body, SEP.replace("|", r"\|")), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(messages, turns))


def masked(text: Column, runs: Column) -> Column:
    """The texts under a loss mask, unescaped, in order: what stands in ``text`` where ``runs`` (loss, chars) say loss."""
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("texts"))

    def cut(done: Column, run: Column) -> Column:
        own = F.array(unescape(text.substr(done["at"], run["chars"])))
        return F.struct((done["at"] + run["chars"]).alias("at"), F.when(run["loss"], F.concat(done["texts"], own)).otherwise(done["texts"]).alias("texts"))

    return F.aggregate(runs, begin, cut)["texts"]


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests read back from the output: turns from ``formatted``, the loss text from it by ``loss_runs``."""
    out = chats.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), F.array_join(masked(F.col("formatted"), F.col("loss_runs")), "").alias("loss"))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_example(conversations: DataFrame) -> DataFrame:
    """The table and the conversation that shows escaping."""
    spark = conversations.sparkSession
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    return rows.unionByName(extra)


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS begins,
    length(regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?SYS>|/?INST\])', '\1\\\2\3', 'g')) AS escaped
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + CASE WHEN begins THEN 12 + length(role) + 1 + 10 + 1 ELSE 10 END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

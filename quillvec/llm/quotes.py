"""Quotation linking for conversations, in DataFrame expressions and joins only.

Quote levels are parsed from line prefixes. Quoted passages, normalised and hashed, are joined to the messages where those words
first stood; the links make reply trees, and the messages come out in reply order without what they quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, few, only

PREFIX = r"^[ \t]{0,3}(?:>[ \t]?+)++"  # possessive: Java runs such loops without recursion
#: A line that only announces a quotation; it goes with the quotation below it.
ANNOUNCES = r"(?i)^\s*(?:(?:on|am|le|el)\b.{0,200}\b(?:wrote|schrieb|a écrit|escribió)|.{1,100}\b(?:wrote|schrieb|a écrit|escribió))\s*:\s*$|^\s*-{2,}\s*(?:original message|forwarded message).*$"


def lines(text: Column) -> Column:
    """Lines as (level, body, announces): the nesting of the quotation, the line without its prefix."""
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, PREFIX, 0), "[^>]", ""))
    body = lambda x: F.regexp_replace(x, PREFIX, "")
    return F.transform(
        F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1),
        lambda x: F.struct(level(x).alias("level"), body(x).alias("body"), body(x).rlike(ANNOUNCES).alias("announces")),
    )


def normalised(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"[\s ]+", " ")))


def passages(rows: Column) -> Column:
    """Passages (level, words): what stands together at one level, and each of its lines where there are several.

    A line continues the passage above it if it has its level and neither is blank.
    """
    empty = F.array().cast("array<struct<level:int,words:string,n:int>>")
    start = F.struct(empty.alias("done"), F.lit(-1).alias("level"), F.lit("").alias("words"), F.lit(0).alias("n"))
    close = lambda s: F.when(s["words"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["level"].alias("level"), s["words"].alias("words"), s["n"].alias("n")))))

    def step(s: Column, x: Column) -> Column:
        words = normalised(x["body"])
        on = (x["level"] == s["level"]) & (words != "") & (s["words"] != "")
        more = F.struct(s["done"].alias("done"), s["level"].alias("level"), F.concat_ws(" ", s["words"], words).alias("words"), (s["n"] + 1).alias("n"))
        fresh = F.struct(close(s).alias("done"), x["level"].alias("level"), words.alias("words"), F.lit(1).alias("n"))
        return F.when(on, more).otherwise(fresh)

    blocks = F.aggregate(rows, start, step, close)
    single = F.transform(F.filter(rows, lambda x: normalised(x["body"]) != ""), lambda x: F.struct(x["level"].alias("level"), normalised(x["body"]).alias("words"), F.lit(1).alias("n")))
    return F.array_distinct(F.concat(blocks, single))


def without_quotes(rows: Column) -> Column:
    """The lines of level 0, without announcements that stand right above a quotation, outer blank lines and runs of them."""
    after = lambda i: F.get(F.filter(F.slice(rows, i + 2, F.lit(2)), lambda x: F.trim(x["body"]) != ""), F.lit(0))
    own = F.filter(rows, lambda x, i: (x["level"] == 0) & ~(x["announces"] & (F.coalesce(after(i)["level"], F.lit(0)) > 0)))
    joined = F.array_join(F.transform(own, lambda x: x["body"]), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n(?:[^\S\n]*+\n){2,}+", "\n\n"), r"^\s*\n|\s+$", "")


def thread(df: DataFrame, rounds: int = 40) -> DataFrame:
    """One row per message: conv_id, turn, role, text without quotations, reply_conv and reply_turn, root_conv and root_turn, depth, n_quoted, n_linked.

    A quoted passage is linked to the nearest earlier message of its conversation that has these words as its own, else to the first message
    that has, if its conversation has a smaller id. A message answers the one to which most of its quoted words of the outermost level lead, the later of
    equals; without a link, the message one turn before, if there is one. root and depth follow these answers. Sorted by conv_id, depth and turn,
    the rows are the conversations in reply order; the order is by ranges, so a conversation of any size is no single task's.
    Rows of one (conv_id, turn) count as one message: the one with the least text. Null texts are empty, rows without conv_id or turn go.
    """
    messages = durable(
        only(df, "conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"))
        .agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "role")).alias("m")).select("conv_id", "turn", "m.role", "m.text")
    )
    has_quote = F.col("text").rlike(r"(?m)" + PREFIX)
    parsed = messages.withColumn("_rows", F.when(has_quote, lines(F.col("text"))))
    content = durable(parsed.select("conv_id", "turn", "role", F.when(has_quote, without_quotes(F.col("_rows"))).otherwise(F.col("text")).alias("text")))
    def parted(df: DataFrame) -> DataFrame:
        made = df.select("conv_id", "turn", F.explode(passages(lines(F.col("text")))).alias("p"))
        return made.select("conv_id", "turn", "p.level", "p.n", F.length("p.words").alias("size"), F.sha2("p.words", 256).alias("hash"))

    # Only what some message quotes is looked for among the others, and nothing if none quotes.
    asked = durable(parted(messages.where(has_quote)).where("level > 0").select(F.col("hash").alias("_h")).distinct())
    sought = durable(few(parted(messages if asked.limit(1).count() else messages.limit(0)), asked, F.col("hash") == F.col("_h"), "left_semi"))
    # The nearest earlier owner of the words in the conversation: a running maximum, not a join of all pairs.
    earlier = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = sought.withColumn("_turn", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(earlier)).where("level > 0")
    first = sought.where("level = 0").groupBy(F.col("hash").alias("_h")).agg(F.min(F.struct("conv_id", "turn")).alias("_first"))
    linked = near.join(first, F.col("hash") == F.col("_h"), "left")
    other = F.when(F.col("_first.conv_id") < F.col("conv_id"), F.col("_first"))  # answers lead to smaller (conv_id, turn): no circles
    target = F.when(F.col("_turn").isNotNull(), F.struct("conv_id", F.col("_turn").alias("turn"))).otherwise(other)
    links = durable(linked.select("conv_id", "turn", "level", "n", "size", "hash", target.alias("to")))
    tally = links.groupBy("conv_id", "turn").agg(
        F.countDistinct("hash").alias("n_quoted"), F.countDistinct(F.when(F.col("to").isNotNull(), F.col("hash"))).alias("n_linked"), F.min("level").alias("_outer")
    )
    votes = links.where("to is not null and level = 1").groupBy("conv_id", "turn", "to").agg(F.sum("size").alias("_size"))
    answer = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("_size", F.col("to.turn").alias("t"), F.col("to.conv_id").alias("c"))).alias("_a")).select("conv_id", "turn", "_a.c", "_a.t")
    before = messages.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("_before"))
    replies = (
        content.join(tally, ["conv_id", "turn"], "left").join(answer, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
        .withColumn("reply_conv", F.when(F.col("t").isNotNull(), F.col("c")).when(F.col("_before").isNotNull(), F.col("conv_id")))
        .withColumn("reply_turn", F.coalesce("t", "_before"))
    )
    replies = durable(replies.select("conv_id", "turn", "role", "text", "reply_conv", "reply_turn", F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked")))
    # Roots and depths by doubling: each round, what a message points to is replaced by what that one points to.
    depth = F.when(F.col("reply_turn").isNotNull(), 1).otherwise(0).cast("long")
    at = durable(replies.select("conv_id", "turn", F.col("reply_conv").alias("pc"), F.col("reply_turn").alias("pt"), depth.alias("depth"), F.col("conv_id").alias("rc"), F.col("turn").alias("rt")))
    for _ in range(rounds):
        if not at.where("pt is not null").limit(1).count():
            break
        up = at.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("pc").alias("_pc"), F.col("pt").alias("_pt"), F.col("depth").alias("_d"), F.col("rc").alias("_rc"), F.col("rt").alias("_rt"))
        # Messages that have found their root take no further part; each answered message is there once.
        step = at.where("pt is not null").join(up, (F.col("pc") == F.col("_c")) & (F.col("pt") == F.col("_t")))
        moved = step.select("conv_id", "turn", F.col("_pc").alias("pc"), F.col("_pt").alias("pt"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_rc").alias("rc"), F.col("_rt").alias("rt"))
        at = durable(at.where("pt is null").unionByName(moved))
    made = replies.join(at.select("conv_id", "turn", "depth", F.col("rc").alias("root_conv"), F.col("rt").alias("root_turn")), ["conv_id", "turn"])
    return made.select("conv_id", "turn", "role", "text", "reply_conv", "reply_turn", "root_conv", "root_turn", "depth", "n_quoted", "n_linked").orderBy("conv_id", "depth", "turn")

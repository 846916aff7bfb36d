"""Chat formatting by quotation linking. DataFrame functions only.

Messages that quote others (lines that begin with ``>``, nested by repetition) are taken apart into
passages per quote level. The hash of a normalised passage is joined to the messages of the same
conversation that say it themselves; the earliest one is the original. A message replies to the
original of its shallowest quotes (most quoted characters, then the latest), else to the message
before it. The result is the conversation in reply order, without quotes.

Reply order: the first reply to a message continues its chain, further replies open chains of their
own; chains follow one another by their first message. So a message always comes after the one it
replies to, and branches stay together. Chains are found by pointer doubling, only in conversations
that branch.

A conversation may hold a third of all rows: positions are prefix sums over ranges of the order, and
links are joins on (conversation, hash) with one original per hash. Only the lines of one message
are ever brought together, and blocks of ``BLOCK_MESSAGES`` messages in :func:`render`.

Defined cases: a null text is an empty message; null conversation ids are one conversation; rows of
one turn are ordered by role, then as read, so repeated rows are separate messages; a quote that no
earlier message of the conversation says is dropped from the text and links nothing; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkseek.llm.common import positions, scratch, stored

BLOCK_MESSAGES = 256
NEW_LINE = r"\r\n|\n|\r"
QUOTED = r"^\s{0,3}>"
#: Languages' words before the colon of an attribution line such as "On Monday Ann wrote:".
ATTRIBUTION = r"(?m)^[^\n>]{1,200}\b(wrote|schrieb|écrit|escribió) ?:[ \t]*\r?\n(?=\s{0,3}>)"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _normal(text: str) -> str:
    """SQL of the normal form of a passage: lower case, single spaces."""
    return f"trim(regexp_replace(lower({text}), {_sql(r'[\s]+')}, ' '))"


def _messages(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    body = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), ATTRIBUTION, "")
    rows = conversations.select(F.col(conv).alias("conv_id"), F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("conv_key"),
                                F.col(turn).alias("turn"), F.col(role).alias("role"), body.alias("body"), F.monotonically_increasing_id().alias("nth"))
    rows = rows.withColumn("quotes", F.expr(f"exists(split(body, {_sql(NEW_LINE)}), x -> x rlike {_sql(QUOTED)})"))
    return stored(positions(rows, "conv_key", ["turn", "role", "nth"], "message", "by-turn"), scratch(conversations.sparkSession, "messages"))


def _own_text() -> Column:
    """The text without quoted lines; a text without quotes as it is."""
    kept = f"array_join(filter(split(body, {_sql(NEW_LINE)}), x -> not x rlike {_sql(QUOTED)}), '\\n')"
    return F.expr(f"if(quotes, regexp_replace({kept}, {_sql(chr(92) + 'A' + chr(92) + 's+|' + chr(92) + 's+' + chr(92) + 'z')}, ''), body)")


def _quoted(messages: DataFrame) -> DataFrame:
    """(conv_key, message, depth, hash, chars): quoted passages, and their single lines."""
    lines = messages.where("quotes").select("conv_key", "message", F.posexplode(F.split("body", NEW_LINE)).alias("line", "raw"))
    lines = (lines.withColumn("mark", F.regexp_extract("raw", r"^((?:\s{0,3}>)+)", 1))
             .withColumn("depth", F.length(F.regexp_replace("mark", "[^>]", "")))
             .withColumn("said", F.expr(_normal("substring(raw, length(mark) + 1)"))))
    w = Window.partitionBy("conv_key", "message").orderBy("line")
    opens = (F.col("depth") != F.lag("depth", 1, -1).over(w)) | (F.col("said") == "")
    runs = lines.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(w)).where("depth > 0 and said <> ''")
    passages = (runs.groupBy("conv_key", "message", "run", "depth").agg(F.sort_array(F.collect_list(F.struct("line", "said"))).alias("l"))
                .select("conv_key", "message", "depth", F.expr("array_join(transform(l, x -> x.said), ' ')").alias("said")))
    both = passages.unionByName(runs.select("conv_key", "message", "depth", "said"))
    return both.select("conv_key", "message", "depth", F.sha2("said", 256).alias("hash"), F.length("said").alias("chars"))


def _originals(messages: DataFrame) -> DataFrame:
    """(conv_key, hash, original): the earliest message that says a passage or line itself."""
    split = f"split(body, {_sql(NEW_LINE)})"
    lines = f"transform({split}, x -> if(x rlike {_sql(QUOTED)}, '', x))"
    said = f"concat(split(array_join({lines}, '\\n'), {_sql(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')}), {lines})"
    units = f"array_except(array_distinct(transform({said}, x -> {_normal('x')})), array(''))"
    return (messages.select("conv_key", "message", F.explode(F.expr(units)).alias("said"))
            .groupBy("conv_key", F.sha2("said", 256).alias("hash")).agg(F.min("message").alias("original")))


def _linked(messages: DataFrame) -> DataFrame:
    """(conv_key, message, linked, n_quotes, n_linked) of the messages that quote."""
    spark = messages.sparkSession
    quoted = stored(_quoted(messages), scratch(spark, "quoted"))
    quoting = quoted.select("conv_key").distinct()
    originals = stored(_originals(messages.join(quoting, "conv_key", "left_semi")), scratch(spark, "originals"))
    hits = (quoted.join(originals, ["conv_key", "hash"], "left")
            .withColumn("original", F.when(F.col("original") < F.col("message"), F.col("original"))))
    by_original = hits.groupBy("conv_key", "message", "depth", "original").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    found = F.col("original").isNotNull()
    return by_original.groupBy("conv_key", "message").agg(
        F.max_by(F.when(found, F.col("original")), F.when(found, F.struct(-F.col("depth"), F.col("chars"), F.col("original")))).alias("linked"),
        F.sum("n").alias("n_quotes"), F.sum(F.when(found, F.col("n")).otherwise(0)).alias("n_linked"))


def _chains(replies: DataFrame) -> DataFrame:
    """(conv_key, message, chain): the first message of the chain, by pointer doubling."""
    spark = replies.sparkSession
    first = replies.where("reply_to is not null").groupBy("conv_key", "reply_to").agg(F.min("message").alias("message"))
    heads = (replies.select("conv_key", "message").join(first, ["conv_key", "message"], "left")
             .select("conv_key", "message", F.coalesce("reply_to", "message").alias("chain")))
    heads = stored(heads, scratch(spark, "chains"))
    while True:
        ahead = heads.select("conv_key", F.col("message").alias("chain"), F.col("chain").alias("next"))
        step = stored(heads.join(ahead, ["conv_key", "chain"]).select("conv_key", "message", "chain", "next"), scratch(spark, "chains"))
        if not step.where("chain <> next").limit(1).count():
            return step.select("conv_key", "message", "chain")
        heads = step.select("conv_key", "message", F.col("next").alias("chain"))


def reply_order(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, message (0-based by turn), reply_to (a message),
    link (``quote``, ``previous`` or ``root``), chain, position (0-based in reply order), n_quotes,
    n_linked (passages and lines quoted, and those with an original), content."""
    spark = conversations.sparkSession
    messages = _messages(conversations, conv, turn, role, text)
    links = stored(_linked(messages), scratch(spark, "links"))
    replies = (messages.select("conv_key", "message").join(links, ["conv_key", "message"], "left")
               .withColumn("reply_to", F.coalesce("linked", F.when(F.col("message") > 0, F.col("message") - 1))))
    replies = stored(replies, scratch(spark, "replies"))
    # only where a quote reaches past the message before can a conversation branch
    branching = stored(replies.where("linked < message - 1").select("conv_key").distinct(), scratch(spark, "branching"))
    if branching.limit(1).count():
        chains = _chains(replies.join(branching, "conv_key", "left_semi"))
        placed = positions(chains, "conv_key", ["chain", "message"], "position", "by-chain")
        replies = stored(replies.join(placed, ["conv_key", "message"], "left"), scratch(spark, "ordered"))
    else:
        replies = replies.withColumn("chain", F.lit(None).cast("long")).withColumn("position", F.lit(None).cast("long"))
    link = F.when(F.col("linked").isNotNull(), "quote").when(F.col("message") > 0, "previous").otherwise("root")
    return (messages.join(replies, ["conv_key", "message"])
            .select("conv_id", "turn", "role", "message", "reply_to", link.alias("link"), F.coalesce("chain", F.lit(0)).alias("chain"),
                    F.coalesce("position", "message").alias("position"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
                    F.coalesce("n_linked", F.lit(0)).alias("n_linked"), _own_text().alias("content")))


def render(ordered: DataFrame, block: int = BLOCK_MESSAGES) -> DataFrame:
    """Chat text of up to ``block`` messages per row: conv_id, block, n_messages, chat."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("content"))
    return (ordered.groupBy("conv_id", F.floor(F.col("position") / block).alias("block"))
            .agg(F.count(F.lit(1)).alias("n_messages"), F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).alias("l"))
            .select("conv_id", "block", "n_messages", F.expr("array_join(transform(l, x -> x.line), '\\n')").alias("chat")))

"""Chat formatting in budgeted windows, with DataFrame operations only.

Turns are rendered with a template whose control strings are escaped inside texts. Running totals of turn tokens choose
windows that begin and end at turns: the totals are cut into strides, a turn belongs to the stride that it begins in, and
one that reaches over the stride's end stays in it if it fits the budget and else is a window of its own. A window opens
with the conversation's system turn and repeats a limited history of the turns before it. Only new assistant turns are
under the loss mask. Totals are taken over narrow rows in ranges of one order, so a conversation of any length is spread
over all tasks, and what is gathered in one row is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import digest, stored

#: Tokens of a window, and at most so many of them repeat earlier turns.
WINDOW_TOKENS = 1024
HISTORY_TOKENS = 128
#: UTF-8 bytes that count as one token: the rate of the public 50k byte-level vocabulary on prose.
BYTES_PER_TOKEN = 4
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LINE_BREAK = "<|nl|>"


def escaped(text: Column) -> Column:
    """Backslashes are doubled, then each <| gets a backslash inside, so no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    """Roles stand on one line: a line break becomes a control string, which escaped text can't hold."""
    return F.replace(escaped(role), F.lit("\n"), F.lit(LINE_BREAK))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(LINE_BREAK), F.lit("\n")))


#: Rows with these equal are the same turn, repeated.
TURN = ("conv_id", "turn", "name")
#: Stands for a null conv_id or turn inside, so that joins need no more shuffles than groups; it comes first in any order.
NONE = -(2**63)


def rendered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, name (60 bits of a hash of role and text), system, target and body of each row."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = F.concat(F.lit(OPEN), escaped_role(role), F.lit("\n"), escaped(text), F.lit(CLOSE))
    name = F.conv(F.substring(F.md5(F.concat(role, F.lit("\n"), text).cast("binary")), 1, 15), 16, 10).cast("long")
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NONE)).alias(c)
    return rows.select(number("conv_id"), number("turn"), name.alias("name"), (role == "system").alias("system"), (role == "assistant").alias("target"), body.alias("body"))


def placed(turns: DataFrame) -> DataFrame:
    """no and start of each turn of rendered(): how many turns and how many tokens of its conversation come before it.

    Narrow rows are dealt in ranges of (conversation, turn, name); sums of ranges are added up, and then windows run inside
    one range of one conversation at a time.
    """
    tokens = F.ceil(F.octet_length("body") / BYTES_PER_TOKEN).cast("long")
    counted = turns.groupBy(*TURN).agg(F.count("*").alias("n"), F.max(tokens).alias("tokens"), F.max("system").alias("system"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    dealt = stored(each.repartitionByRange(*TURN, "copy").withColumn("part", F.spark_partition_id()), "turns")
    sums = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "part", *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_before") for x in ("n", "sum")))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "name", "copy").rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumns({"no": F.count("*").over(inside), "start": F.coalesce(F.sum("tokens").over(inside), F.lit(0))})
    whole = within.join(sums, ["conv_id", "part"])
    return whole.select(*TURN, "tokens", "system", (F.col("no") + F.col("n_before")).alias("no"), (F.col("start") + F.col("sum_before")).alias("start"))


def cut(turns: DataFrame, window_tokens: int, history_tokens: int) -> DataFrame:
    """Each turn of each window, from placed(): conv_id, window, place, context, and the turn's key.

    place orders a window's turns; context tells those that repeat earlier ones. window rises along the conversation.
    """
    turns = stored(turns, "placed")
    head = turns.filter("no = 0 AND system")
    leads = head.select("conv_id", F.col("tokens").alias("fixed"), F.col("turn").alias("lead_turn"), F.col("name").alias("lead_name"))
    after = turns.filter("NOT (no = 0 AND system)").join(leads.select("conv_id", "fixed"), "conv_id", "left").withColumn("fixed", F.coalesce("fixed", F.lit(0)))
    after = after.withColumn("at", F.col("start") - F.col("fixed"))
    stride = F.greatest(F.lit(1), F.lit(window_tokens - history_tokens) - F.col("fixed"))
    after = after.withColumn("cell", F.floor(F.col("at") / stride)).withColumn("first", F.min("at").over(Window.partitionBy("conv_id", "cell")))
    end = F.col("at") + F.col("tokens")
    own = (end > (F.col("cell") + 1) * stride) & (F.col("first") < F.col("at")) & (end - F.col("first") > stride)
    new = stored(after.withColumn("window", F.col("cell") * 2 + F.when(own, 1).otherwise(0)).select(*TURN, "window", "no", "at", "tokens", "fixed"), "new")
    spans = new.groupBy("conv_id", "window").agg(F.min("at").alias("from"), F.sum("tokens").alias("size"), F.max("fixed").alias("fixed"))
    room = F.least(F.lit(history_tokens), F.greatest(F.lit(0), F.lit(window_tokens) - F.col("fixed") - F.col("size")))
    later = stored(spans.filter("from > 0").select("conv_id", F.col("window").alias("w"), "from", room.alias("room")), "later")
    # A turn in reach begins in the same stretch of history_tokens as the window, or in the one before.
    stretch = lambda c: F.floor(F.col(c) / max(1, history_tokens))
    seen = later.filter("room > 0").withColumn("stretch", F.explode(F.array(stretch("from"), stretch("from") - 1)))
    old = new.withColumn("stretch", stretch("at")).join(seen, ["conv_id", "stretch"]).filter((F.col("at") < F.col("from")) & (F.col("at") >= F.col("from") - F.col("room")))
    again = later.select("conv_id", "w").join(leads, "conv_id")
    row = lambda window, place, context, turn="turn", name="name": ["conv_id", F.col(turn).alias("turn"), F.col(name).alias("name"), window.cast("long").alias("window"), place.cast("long").alias("place"), F.lit(context).alias("context")]
    return (
        new.select(*row(F.col("window"), F.col("no"), False))
        .unionByName(head.select(*row(F.lit(0), F.col("no"), False)))
        .unionByName(old.select(*row(F.col("w"), F.col("no"), True)))
        .unionByName(again.select(*row(F.col("w"), F.lit(0), True, "lead_turn", "lead_name")))
    )


def formatted(rows: DataFrame, window_tokens: int = WINDOW_TOKENS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row for each window of the conversations in rows (conv_id, turn, role, text): conv_id, window, text, context,
    turns, loss: the rendered text, how many of its turns repeat earlier ones, how many it has, and the spans (start,
    length in code points, from 0) under the loss mask. window rises along a conversation, from 0 and with gaps.

    Every turn is new in exactly one window. Windows keep to the budget unless one turn with the system turn exceeds it;
    turns are never cut. The system turn is a first turn of that role. Null roles and texts are empty, null turns come
    first, rows with equal turns stand by a hash of role and text, repeated rows are repeated turns, a null conv_id is one
    conversation, -2**63 counts as null, and other columns are not read. An empty table gives no rows.
    """
    turns = rendered(rows)
    texts = turns.groupBy(*TURN).agg(F.max("body").alias("body"), F.max("target").alias("target"))
    met = cut(placed(turns), window_tokens, history_tokens).join(texts, list(TURN))
    # Earlier turns come first; the system turn, where it is repeated, has the place 0.
    made = met.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("place", "context", "target", "body"))).alias("list"))
    begins = F.aggregate("list", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.length(t.body))))
    made = made.withColumn("begins", begins)
    head = lambda t: F.instr(t.body, "\n")
    span = lambda t, k: F.struct((F.get("begins", k) + head(t)).cast("long").alias("start"), (F.length(t.body) - head(t) - len(CLOSE)).cast("long").alias("length"), (t.target & ~t.context).alias("own"))
    loss = F.transform(F.filter(F.transform("list", span), lambda s: s.own), lambda s: F.struct(s.start.alias("start"), s.length.alias("length")))
    return made.select(
        F.nullif(F.col("conv_id"), F.lit(NONE)).alias("conv_id"),
        "window",
        F.concat_ws("", F.transform("list", lambda t: t.body)).alias("text"),
        F.size(F.filter("list", lambda t: t.context)).alias("context"),
        F.size("list").alias("turns"),
        loss.alias("loss"),
    )


def parsed(text: Column) -> Column:
    """The turns (role, text) of a window's text."""
    pieces = F.split(text, r"<\|im_start\|>", -1)

    def read(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(CLOSE))
        return F.struct(unescaped_role(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), read)


def digests(made: DataFrame) -> DataFrame:
    """Read back from what formatted() returns: counts and digests of the turns and of the text under the loss mask.

    A digest needs a conversation's text in order, so here, and only here, a conversation is gathered in one row.
    """
    new = F.slice(parsed(F.col("text")), F.col("context") + 1, F.col("turns") - F.col("context"))
    said = F.concat_ws("", F.transform(new, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    target = F.concat_ws("", F.transform("loss", lambda s: unescaped(F.substr("text", (s.start + 1).cast("int"), s.length.cast("int")))))
    one = F.struct("window", said.alias("said"), target.alias("target"))
    read = made.groupBy("conv_id").agg(
        F.sum(F.col("turns") - F.col("context")).cast("long").alias("n_turns"), F.sum(F.length("text")).cast("long").alias("formatted_chars"), F.array_sort(F.collect_list(one)).alias("list")
    )
    loss = F.concat_ws("", F.transform("list", lambda w: w.target))
    return read.select(
        "conv_id",
        "n_turns",
        digest(F.concat_ws("", F.transform("list", lambda w: w.said))).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        digest(loss).alias("loss_sha256"),
        "formatted_chars",
    )


#: Conversation that holds the template's own control strings.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def with_control_case(rows: DataFrame) -> DataFrame:
    extra = rows.sparkSession.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(extra)


#: The same rows as of digests(formatted(with_control_case(conversations))).
ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), bodies AS (
  SELECT *, '<|im_start|>' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>') || chr(10)
    || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10) AS body FROM rows
), turns AS (
  SELECT *, (octet_length(encode(body)) + 3) // 4 AS tokens, length(body) AS chars, row_number() OVER w - 1 AS no FROM bodies WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(10) || text))
), leads AS (SELECT conv_id, tokens AS fixed, chars AS lead_chars FROM turns WHERE no = 0 AND role = 'system'
), after AS (
  SELECT t.*, coalesce(fixed, 0) AS fixed, coalesce(lead_chars, 0) AS lead_chars, greatest(1, 1024 - 128 - coalesce(fixed, 0)) AS stride,
    CAST(sum(tokens) OVER (PARTITION BY t.conv_id ORDER BY no) - tokens AS BIGINT) AS pos
  FROM turns t LEFT JOIN leads USING (conv_id) WHERE NOT (no = 0 AND role = 'system')
), cells AS (SELECT *, pos // stride AS cell, min(pos) OVER (PARTITION BY conv_id, pos // stride) AS first FROM after
), cut AS (SELECT *, 2 * cell + CASE WHEN pos + tokens > (cell + 1) * stride AND first < pos AND pos + tokens - first > stride THEN 1 ELSE 0 END AS wno FROM cells
), later AS (
  SELECT conv_id, wno, min(pos) AS begin, any_value(lead_chars) AS lead_chars, least(128, greatest(0, 1024 - any_value(fixed) - sum(tokens))) AS room FROM cut GROUP BY conv_id, wno HAVING min(pos) > 0
), repeated AS (
  SELECT l.conv_id, sum(l.lead_chars + coalesce((SELECT sum(c.chars) FROM cut c WHERE c.conv_id = l.conv_id AND c.pos < l.begin AND c.pos >= l.begin - l.room), 0)) AS extra FROM later l GROUP BY l.conv_id
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY no), '')) AS loss_sha256,
  CAST(sum(chars) + coalesce(any_value(extra), 0) AS BIGINT) AS formatted_chars
FROM turns LEFT JOIN repeated USING (conv_id) GROUP BY conv_id
"""

r"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into spans of whole turns: a
turn belongs to the span in whose range its prefix sum falls, and a turn longer
than a range is a span of its own.  Each span becomes one window: the system
turn again (if the conversation opens with one), then the last turns of the
span before that fit the history allowance, then the span.  Assistant texts of
the span are under the loss mask, repeated ones are not, so each is learned
once.  All of it is DataFrame expressions.

Tokens are those of a byte vocabulary: one for each UTF-8 byte of what is
formatted, and one for each of the two marks of a turn.  The system turn,
history and span together hold ``budget`` of them at most, unless the system
turn and one turn alone already hold more.

A turn is ``<|im_start|>role\ntext<|im_end|>\n``.  Control strings inside a
text, of this template and of others, get a backslash behind their first
character and backslashes are doubled, which ``unescaped`` takes back.

Defined results: null text or role counts as empty; rows with the same turn
number are ordered by role and text, null turns come first; a null
conversation identifier is a conversation.  Only a system turn that comes first
is repeated.  An empty table gives an empty result.  Only the named
columns are read, so others never clash.  A window is gathered in one task; a
conversation is only streamed through one, in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>\n"
#: What follows the first character of control strings, as a pattern.
_CONTROL = r"(<|\[)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
_ESCAPED = _CONTROL.replace(")(", r")\\(", 1)


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and of them for history at most."""

    budget: int = 4096
    history: int = 1024


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _ESCAPED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def _role_escaped(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\~"))


def _role_unescaped(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\~"), F.lit("\n")))


def tokens_of(role: Column, text: Column) -> Column:
    """Tokens of a turn: the bytes of its role and text, two line ends and two marks."""
    return F.octet_length(role) + F.octet_length(text) + 4


def windows(df: DataFrame, budget: Budget = Budget(), conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """``(conv, window, formatted, loss, repeated)`` of each window.

    ``loss`` lists ``(start, stop)`` in code points of ``formatted``;
    ``repeated`` counts the turns at the front that an earlier window has too.
    """
    turns = df.select(
        df[conv_column].alias("conv"),
        df[turn_column].alias("turn"),
        _role_escaped(F.coalesce(df[role_column], F.lit(""))).alias("role"),
        escaped(F.coalesce(df[text_column], F.lit(""))).alias("text"),
    )
    by_turn = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumn("place", F.row_number().over(by_turn))
    first = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opener = F.first(F.when((F.col("place") == 1) & (F.col("role") == "system"), F.col("text"))).over(first)
    turns = turns.withColumn("system", opener)
    is_system = (F.col("place") == 1) & (F.col("role") == "system")
    cost = tokens_of(F.col("role"), F.col("text"))
    turns = turns.withColumn("cost", F.when(is_system, 0).otherwise(cost))
    turns = turns.withColumn("room", F.greatest(F.lit(0), F.lit(budget.budget) - F.coalesce(F.first(F.when(is_system, cost)).over(first), F.lit(0))))
    turns = turns.withColumn("history", F.expr(f"least({budget.history}, room div 4)"))
    turns = turns.withColumn("range", F.expr("greatest(1, (room - history) div 2)"))
    turns = turns.withColumn("before", F.sum("cost").over(first) - F.col("cost"))
    turns = turns.withColumns({"large": F.col("cost") > F.col("range"), "part": F.expr("before div range")})
    opens = F.col("large") | F.lag("large").over(by_turn) | (F.col("part") != F.lag("part").over(by_turn))
    opens = (F.col("place") > 1) & ~((F.col("place") == 2) & F.col("system").isNotNull()) & opens
    turns = turns.withColumn("opens", opens)
    turns = turns.withColumn("window", F.sum(F.col("opens").cast("long")).over(first))
    in_window = Window.partitionBy("conv", "window")
    turns = turns.withColumn("allowance", F.greatest(F.lit(0), F.least("history", F.col("room") - F.sum("cost").over(in_window))))
    by_window = Window.partitionBy("conv").orderBy("window").rangeBetween(1, 1)
    turns = turns.withColumns({"next_first": F.min("before").over(by_window), "next_allowance": F.min("allowance").over(by_window)})
    turns = turns.withColumn("system", F.when(F.col("opens"), F.col("system")))
    again = ~is_system & (F.col("next_first") - F.col("before") <= F.col("next_allowance"))
    own = F.struct(F.col("window"), F.lit(False).alias("again"), F.col("system"))
    other = F.struct((F.col("window") + 1).alias("window"), F.lit(True).alias("again"), F.lit(None).cast("string").alias("system"))
    rows = turns.select("conv", "place", "role", "text", F.explode(F.when(again, F.array(own, other)).otherwise(F.array(own))).alias("x"))
    rows = rows.select("conv", "x.window", "x.system", F.struct("place", "x.again", "role", "text").alias("turn"))
    found = rows.groupBy("conv", "window").agg(F.max("system").alias("system"), F.array_sort(F.collect_list("turn")).alias("turns"))
    head = F.expr("IF(system IS NULL, array(), array(struct(0 AS place, true AS again, 'system' AS role, system AS text)))")
    found = found.select("conv", "window", F.concat(head, "turns").alias("turns"))
    start, end = len(START), len(END)
    return found.select(
        "conv",
        "window",
        F.expr(f"array_join(transform(turns, t -> concat('{START}', t.role, '\\n', t.text, '{END.strip()}', '\\n')), '')").alias("formatted"),
        F.expr(f"""aggregate(turns, struct(0L AS at, cast(array() AS array<struct<start: bigint, stop: bigint>>) AS spans),
            (s, t) -> struct(
                s.at + {start + 1 + end} + char_length(t.role) + char_length(t.text) AS at,
                IF(t.role = 'assistant' AND NOT t.again, concat(s.spans, array(struct(
                    s.at + {start + 1} + char_length(t.role) AS start,
                    s.at + {start + 1} + char_length(t.role) + char_length(t.text) AS stop))), s.spans) AS spans),
            s -> s.spans)""").alias("loss"),
        F.expr("size(filter(turns, t -> t.again))").alias("repeated"),
    )


def parsed(df: DataFrame) -> DataFrame:
    """``windows`` read back: ``(conv, window, chars, turns, learned)`` with the unescaped new turns and texts under the mask."""
    marks = r"<\\|im_start\\|>"
    rows = df.select(
        "conv",
        "window",
        F.char_length("formatted").cast("long").alias("chars"),
        F.expr(f"filter(split(formatted, '{marks}'), (x, i) -> i > repeated)").alias("parts"),
        F.expr("transform(loss, s -> substr(formatted, cast(s.start + 1 AS int), cast(s.stop - s.start AS int)))").alias("masked"),
    )

    def turn(part: Column) -> Column:
        cut = F.position(F.lit("\n"), part)
        role = F.substr(part, F.lit(1), cut - 1)
        text = F.substr(part, cut + 1, F.char_length(part) - cut - len(END))
        return F.struct(_role_unescaped(role).alias("role"), unescaped(text).alias("text"))

    return rows.select("conv", "window", "chars", F.transform("parts", turn).alias("turns"), F.transform("masked", unescaped).alias("learned"))


#: Fixed value: the conversation that the query adds.
_EXTRA = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9_chat_windows``: all conversations and conversation -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{_EXTRA}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    back = parsed(windows(rows.union(extra)))
    per_window = back.select(
        "conv",
        "chars",
        F.struct(
            "window",
            F.size("turns").alias("n"),
            F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')").alias("turns"),
            F.array_join("learned", "").alias("learned"),
        ).alias("w"),
    )
    found = per_window.groupBy("conv").agg(F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("ws"))
    return found.select(
        F.col("conv").alias("conv_id"),
        F.expr("cast(aggregate(ws, 0, (s, w) -> s + w.n) AS bigint)").alias("n_turns"),
        F.sha2(F.expr("array_join(ws.turns, '')"), 256).alias("turns_sha256"),
        F.char_length(F.expr("array_join(ws.learned, '')")).cast("long").alias("loss_chars"),
        F.sha2(F.expr("array_join(ws.learned, '')"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


_B = Budget()
_SQL_ESCAPED = r"regexp_replace(replace({}, '\', '\\'), '(<|\[)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g')"
ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{_EXTRA}' UNION ALL SELECT -7, 1, 'assistant', '{_EXTRA}'),
q AS (SELECT *, {_SQL_ESCAPED.format("text")} AS te, replace({_SQL_ESCAPED.format("role")}, chr(10), '<\\~') AS re FROM c),
e AS (SELECT *, length(te) AS tl, length(re) AS rl, strlen(te) + strlen(re) + 4 AS tokens,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM q),
f AS (SELECT *, place = 1 AND role = 'system' AS sys, {len(START) + 1 + len(END)} + tl + rl AS chars FROM e),
f2 AS (SELECT *, CASE WHEN sys THEN 0 ELSE tokens END AS cost,
              greatest(0, {_B.budget} - coalesce(max(tokens) FILTER (sys) OVER (PARTITION BY conv_id), 0)) AS room FROM f),
f3 AS (SELECT *, least({_B.history}, room // 4) AS hist, (sum(cost) OVER (PARTITION BY conv_id ORDER BY place) - cost)::BIGINT AS before FROM f2),
f4 AS (SELECT *, greatest(1, (room - hist) // 2) AS span FROM f3),
g AS (SELECT *, coalesce(place > 1 AND NOT lag(sys) OVER o AND (cost > span OR lag(cost > span) OVER o OR before // span <> lag(before // span) OVER o), false) AS opens
      FROM f4 WINDOW o AS (PARTITION BY conv_id ORDER BY place)),
h AS (SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY place) AS w FROM g),
n AS (SELECT conv_id, w, min(before) AS lo, greatest(0, least(min(hist), min(room) - sum(cost))) AS allowance FROM h GROUP BY conv_id, w),
x AS (SELECT h.conv_id, sum(h.chars * CASE WHEN NOT sys AND n.lo - before <= n.allowance THEN 2 ELSE 1 END) AS chars
      FROM h LEFT JOIN n ON n.conv_id = h.conv_id AND n.w = h.w + 1 GROUP BY h.conv_id),
s AS (SELECT conv_id, max(chars) FILTER (sys) * (count(DISTINCT w) - 1) AS chars FROM h GROUP BY conv_id)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (any_value(x.chars) + coalesce(any_value(s.chars), 0))::BIGINT AS formatted_chars
FROM h JOIN x USING (conv_id) JOIN s USING (conv_id) GROUP BY conv_id
"""

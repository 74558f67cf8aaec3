"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it are context, its
reply alone is trainable. A conversation that does not end with an assistant
turn gets one more example that trains nothing, so that no turn is lost.

Template: each turn is `<turn ROLE>TEXT</turn>`. In roles and texts a backslash
becomes `\\b`, `<` becomes `\\l` and `>` becomes `\\g`, so a text can never hold
a mark and the output can be read back without loss.

Edge cases: a null text or role is empty; turns are ordered by turn, then role,
then text (nulls first), and repeated rows all stay. Rows without a
conversation id form one conversation of their own. An empty table gives an
empty result; other columns do not matter. One conversation is one row, so it
must fit a row; nothing is truncated, however long a text is. Its examples grow
with the square of its turns, as each repeats its context: that is the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(c: Column) -> Column:
    for plain, marked in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        c = F.replace(c, F.lit(plain), F.lit(marked))
    return c


def unescape(c: Column) -> Column:
    for plain, marked in (("<", "\\l"), (">", "\\g"), ("\\", "\\b")):
        c = F.replace(c, F.lit(marked), F.lit(plain))
    return c


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, formatted, loss_start, loss_length): 0-based code points of the trainable part."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    marked = F.transform("turns", lambda t: F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">"), escape(t["text"]), F.lit("</turn>")))
    said = F.transform("turns", lambda t, i: F.struct(i.alias("at"), (t["role"] == "assistant").alias("trained")))
    targets = F.filter(said, lambda x: x["trained"] | (x["at"] == F.size("turns") - 1))
    # of a conversation only its marked turns go into each of its examples
    example = whole.select("conv_id", marked.alias("marked"), F.posexplode(targets).alias("example", "target"))
    formatted = F.array_join(F.slice("marked", 1, F.col("target.at") + 1), "")
    length = F.char_length(F.get("marked", F.col("target.at"))) - len("<turn assistant></turn>")
    return example.select(
        "conv_id", "example", (F.col("target.at") + 1).alias("n_turns"), formatted.alias("formatted"),
        F.when(F.col("target.trained"), F.char_length(formatted) - len("</turn>") - length).otherwise(0).alias("loss_start"),
        F.when(F.col("target.trained"), length).otherwise(0).alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, turns, trained, formatted_chars) from `expand`'s output alone."""
    trained = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    one = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("formatted"),
        F.array_sort(F.collect_list(F.struct("example", trained.alias("text")))).alias("trained"),
        F.sum(F.char_length("formatted").cast("long")).alias("formatted_chars"),
    )
    pieces = F.filter(F.split("formatted", "</turn>"), lambda x: x != "")
    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, F.lit(len("<turn ") + 1), F.char_length(x)), ">", 1)).alias("role"),
        unescape(F.substring_index(x, ">", -1)).alias("text"),
    )
    return one.select("conv_id", F.transform(pieces, turn).alias("turns"), F.array_join(F.transform("trained", lambda x: x["text"]), "").alias("trained"), "formatted_chars")

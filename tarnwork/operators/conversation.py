"""Conversation windows and query rewriting rules."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.defaults import REFERRING


def history_window(messages, max_rounds=10):
    """The last ``2 * max_rounds`` messages of each conversation, without a leading assistant
    message where older ones were dropped."""
    size = 2 * max_rounds
    spoken = messages.filter(F.col("role").isin("user", "assistant"))
    back = spoken.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    trimmed = (F.col("total") > size) & (F.col("back") == size) & (F.col("role") == "assistant")
    return back.filter((F.col("back") <= size) & ~trimmed).select("conv_id", "turn", "role", "text")


def history_at_turns(messages, max_rounds=10):
    """The window that each message leaves behind it: ``conv_id``, ``turn``, ``kept`` (turn, role and
    text in order).  Frames of ``2 * max_rounds`` rows, so no row holds more than that."""
    size = 2 * max_rounds
    spoken = messages.filter(F.col("role").isin("user", "assistant"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    seen = spoken.withColumn("kept", F.collect_list(F.struct("turn", "role", "text")).over(order.rowsBetween(-(size - 1), 0))).withColumn("_n", F.row_number().over(order))
    trimmed = (F.col("_n") > size) & (F.col("kept")[0]["role"] == "assistant")
    return seen.select("conv_id", "turn", F.when(trimmed, F.slice("kept", 2, size)).otherwise(F.col("kept")).alias("kept"))


def recent_context(messages, rounds=3, most=200, names=("用户", "助手")):
    """The last rounds as text, a line a message, each cut at ``most`` characters."""
    spoken = messages.filter(F.col("role").isin("user", "assistant"))
    last = spoken.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("back") <= 2 * rounds)
    cut = F.when(F.length("text") > most, F.concat(F.left("text", F.lit(most)), F.lit("..."))).otherwise(F.col("text"))
    line = F.concat(F.when(F.col("role") == "user", names[0]).otherwise(names[1]), F.lit(": "), cut)
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))


def needs_rewrite(query, history, words=REFERRING, short=10):
    """True with a history and a referring word or a short query."""
    q = F.col(query)
    refers = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(q, w))
    return (F.trim(F.coalesce(F.col(history), F.lit(""))) != "") & (refers | (F.length(q) < short))


def accept_rewrite(query, reply):
    q, r = F.col(query), F.trim(F.col(reply))
    return F.when(F.length(r).between(2, 5 * F.length(q)), r).otherwise(q)

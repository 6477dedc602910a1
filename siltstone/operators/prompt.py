"""Conversations and prompts: history pairs, follow-ups, token-budgeted context, audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T

# What stands between sources, sizes of snippets and follow-ups, pairs of history; so are the words of `prompts`.
SEPARATOR = "\n\n---\n\n"
SNIPPET, FOLLOW_UP, PAIRS = 600, 100, 3


def pairs(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, question, answer, pair): every user message directly followed by an assistant's, numbered from 1."""
    w = Window.partitionBy(conv).orderBy(turn)
    m = messages.withColumns({"__r": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    m = m.where((F.col("role") == "user") & (F.col("__r") == "assistant"))
    return m.select(conv, turn, F.col("text").alias("question"), "answer", F.row_number().over(w).alias("pair"))


def snippet(answer: Column) -> Column:
    return F.when(F.length(answer) > SNIPPET, F.concat(F.left(answer, F.lit(SNIPPET)), F.lit("…"))).otherwise(answer)


def last_pairs(messages: DataFrame, n: int = PAIRS, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n pairs of every conversation."""
    w = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    return pairs(messages, conv, turn).withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def follow_ups(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """User messages with the retrieval query: short ones get the question before them in front."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    m = messages.withColumn("__b", before).where("role = 'user'")
    short = (F.length(T.strip(F.col("text"))) <= FOLLOW_UP) & F.col("__b").isNotNull()
    return m.withColumn("query", F.when(short, F.concat("__b", F.lit(" "), "text")).otherwise(F.col("text"))).drop("__b")


def entry(number: Column, title: Column, kind: Column, date: Column, text: Column) -> Column:
    return F.concat(F.lit("[Source "), number.cast("string"), F.lit("] "), title, F.lit(" ("), kind, F.lit(", "), date, F.lit(")\n"), text)


def budgeted(retrieved: DataFrame, query: str, budget: int, tokens=T.token_count) -> DataFrame:
    """Ranked rows with column entry -> plus tokens, used: those before the first that overflows the budget."""
    w = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = retrieved.withColumn("tokens", tokens(F.col("entry")))
    return r.withColumn("used", F.sum("tokens").over(w) <= budget)


def prompts(retrieved: DataFrame, questions: DataFrame, query: str, budget: int) -> DataFrame:
    """One row per question: the user message, numbers of used and omitted chunks, characters and tokens of the context."""
    b = budgeted(retrieved, query, budget)
    used = F.sort_array(F.collect_list(F.when(F.col("used"), F.struct("rank", "entry"))))
    g = b.groupBy(query).agg(used.alias("u"), F.count_if(~F.col("used")).alias("omitted"), F.coalesce(F.sum(F.when(F.col("used"), F.length("entry"))), F.lit(0)).alias("context_chars"), F.coalesce(F.sum(F.when(F.col("used"), F.col("tokens"))), F.lit(0)).alias("context_tokens"))
    g = questions.join(g, query, "left")
    context = F.array_join(F.transform(F.coalesce("u", F.array().cast("array<struct<rank:int,entry:string>>")), lambda x: x.entry), SEPARATOR)
    n = F.greatest(F.size("u"), F.lit(0))
    message = F.concat(F.coalesce("history", F.lit("")), F.lit("Voici "), n.cast("string"), F.lit(" sources numerotees :\n\n"), context, F.lit("\n\n---\n\nQuestion : "), "question", F.lit("\n\nReponds en citant [Source N] apres chaque affirmation."))
    return g.select(query, message.alias("user_message"), n.alias("used"), "omitted", "context_chars", "context_tokens", F.lit(budget).alias("max_context_tokens"))


def trimmed_contexts(texts: Column, each: int = 900, total: int = 3600) -> Column:
    """Texts cut to `each` characters while `total` lasts; what is empty after stripping is left out."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(total).alias("left"))

    def step(a: Column, x: Column) -> Column:
        cut = T.strip(F.left(T.strip(F.coalesce(x, F.lit(""))), F.least(F.lit(each), F.greatest(a.left, F.lit(0)))))
        return F.when((a.left <= 0) | (cut == ""), a).otherwise(F.struct(F.concat(a.done, F.array(cut)).alias("done"), (a.left - F.length(cut)).alias("left")))

    return F.aggregate(texts, start, step, lambda a: a.done)


def within_total(rows: DataFrame, group: str, order: str, text: str, each: int = 900, total: int = 3600) -> DataFrame:
    """Rows with their text cut to what `trimmed_contexts` may read of it, without blank ones and those behind the total: what is gathered of a group is bounded.

    A text that is cut in the end loses the blanks at the cut, and the next ones may use these places, at least one each: `each` more rows suffice.
    """
    cut = rows.withColumn(text, T.strip(F.left(T.strip(F.coalesce(text, F.lit(""))), F.lit(each)))).where(F.col(text) != "")
    rows_before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("__b", F.coalesce(F.sum(F.length(text)).over(rows_before), F.lit(0)))
    return cut.withColumn("__n", F.count_if(F.col("__b") >= total).over(so_far)).where(F.col("__n") <= each).drop("__b", "__n")


def judge_context(titles: Column, texts: Column, most: int = 5, total: int = 2400, least: int = 120) -> Column:
    """Numbered sources of a judge's prompt: white space collapsed, cut to what is left of `total`, to `least` characters at least."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(total).alias("left"))
    flat = F.transform(F.slice(texts, 1, most), lambda x: T.strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " ")))
    rows = F.transform(flat, lambda x, i: F.struct(F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("] "), F.get(titles, i), F.lit("\n")).alias("p"), x.alias("x")))

    def step(a: Column, r: Column) -> Column:
        cut = F.left(r.x, F.greatest(F.lit(least), a.left - F.length(r.p)))
        grown = T.let(cut, lambda c: F.struct(F.concat(a.done, F.array(F.concat(r.p, c))).alias("done"), (a.left - F.length(r.p) - F.length(c) - 2).alias("left")))
        return F.when((a.left <= 0) | (r.x == ""), a).otherwise(grown)

    return F.aggregate(rows, start, step, lambda a: a.done)


def audit_event(timestamp: Column, question: Column, answer: Column, method: Column, chunks: Column) -> Column:
    """One JSON line of the audit log."""
    text = lambda c: F.struct(T.preview(c).alias("preview"), F.sha2(c, 256).alias("sha256"), F.length(c).alias("chars"))
    return F.to_json(F.struct(timestamp.alias("timestamp"), text(question).alias("query"), text(answer).alias("answer"), method.alias("method"), chunks.alias("chunks")), {"ignoreNullFields": "true"})

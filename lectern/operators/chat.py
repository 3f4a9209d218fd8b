"""Conversations and catalogue: history, follow-ups, prompts, titles, books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import text as T

# Words that lean on the turn before.
PRONOUNS = ("it", "they", "them", "this", "that", "these", "those", "he", "she", "his", "her", "one", "ones")
OPENERS = ("and", "more", "another", "again", "why", "but", "so")
PHRASES = ("what about", "how about", "give me more", "tell me more")
#: Shown in place of an answer that did not pass; any other text may be given.
HIDDEN = "This answer is not shown, as the book does not bear it out."


def turns_with_history(messages: DataFrame, limit: int = SETTINGS.history) -> DataFrame:
    """Each user turn with the messages strictly before it, oldest first, and whether it is
    the first.  Roles other than user and assistant are no part of a conversation."""
    spoken = messages.filter(F.col("role").isin("user", "assistant"))
    before = Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(-limit, -1)
    held = spoken.withColumn("history", F.collect_list(F.struct("ordinal", "role", "content")).over(before))
    return held.filter("role = 'user'").withColumn("is_first_turn", F.size("history") == 0)


def with_answers(turns: DataFrame, messages: DataFrame) -> DataFrame:
    """User turns with the `answer` that comes right after each, null where none does."""
    spoken = messages.filter(F.col("role").isin("user", "assistant"))
    after = F.lead(F.when(F.col("role") == "assistant", F.col("content"))).over(Window.partitionBy("session_id").orderBy("ordinal"))
    answers = spoken.select("session_id", "ordinal", after.alias("answer"), "role").filter("role = 'user'").drop("role")
    return turns.join(answers, ["session_id", "ordinal"], "left")


def needs_rewrite(question: Column, has_history: Column) -> Column:
    """Whether a question leans on its history."""
    low = F.lower(T.stripped(question))
    words = F.regexp_extract_all(low, F.lit("[A-Za-z']+"), F.lit(0))
    leans = F.size(words) < 5
    for p in PHRASES:
        leans = leans | F.startswith(low, F.lit(p))
    leans = leans | F.element_at(words, 1).isin(*OPENERS) | F.arrays_overlap(words, F.array(*map(F.lit, PRONOUNS)))
    return F.when(has_history & (F.size(words) > 0), leans).otherwise(False)


def written_history(history: Column) -> Column:
    return F.array_join(F.transform(history, lambda m: F.concat(F.when(m.role == "user", "Student: ").otherwise("Teacher: "), m.content)), "\n")


def fill(template: str, slots: dict[str, Column]) -> Column:
    """A template with each {name} replaced by a column, all at once: what a column brings in
    is not looked at again."""
    parts, rest = [], template
    while rest:
        found = [(rest.find("{" + n + "}"), n) for n in slots if "{" + n + "}" in rest]
        if not found:
            parts.append(F.lit(rest))
            break
        at, name = min(found)
        parts += [F.lit(rest[:at]), F.coalesce(slots[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def retry_block(feedback: Column) -> Column:
    said = F.concat(F.lit("\nThe attempt before this did not pass: "), feedback, F.lit("\nWrite the answer again so that it does; keep every fact as it is.\n"))
    return F.when(feedback.isNotNull() & (feedback != ""), said).otherwise("")


def turn_note(is_first: Column, citation: Column) -> Column:
    first = F.concat(F.lit("First message of this conversation: greet once and say that this comes from "), citation, F.lit("."))
    return F.when(is_first, first).otherwise("A later message of this conversation: no greeting and no place in the book.")


def fallback_title(question: Column) -> Column:
    found = T.tokens(question)
    short = F.array_join(F.slice(found, 1, 6), " ")
    return F.when(F.size(found) == 0, "New conversation").when(F.size(found) > 6, F.concat(short, F.lit("…"))).otherwise(short)


def session_heads(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, title (from the first question where none is given), updated_at."""
    first = messages.filter("role = 'user'").groupBy("session_id").agg(F.min_by("content", "ordinal").alias("asked"))
    last = messages.groupBy("session_id").agg(F.max("created_at").alias("last"))
    joined = sessions.join(first, "session_id", "left").join(last, "session_id", "left")
    return joined.select("session_id", F.coalesce("title", fallback_title(F.col("asked"))).alias("title"), F.coalesce("last", "updated_at").alias("updated_at"))


def open_sessions(sessions: DataFrame, user_id: str) -> DataFrame:
    return sessions.filter((F.col("user_id") == user_id) & F.col("deleted_at").isNull()).orderBy(F.desc("updated_at"))


def newest_books(books: DataFrame) -> DataFrame:
    """grade, book_id of the newest ready book, and whether the grade has any book at all."""
    ready = F.when(F.col("status") == "ready", F.struct("created_at", "book_id"))
    return books.groupBy("grade").agg(F.max(ready).alias("best")).select("grade", F.col("best.book_id").alias("book_id"), F.when(F.col("best").isNotNull(), "ready").otherwise("not_ready").alias("state"))


def session_messages(messages: DataFrame, session_id: str) -> DataFrame:
    """A session's messages in order; the question before its answer where times tie."""
    return messages.filter(F.col("session_id") == session_id).orderBy("created_at", F.when(F.col("role") == "user", 0).otherwise(1), "ordinal")


def ordered_messages(messages: DataFrame) -> DataFrame:
    """messages with their place in their session, from 1; the question before its answer where
    times tie."""
    order = Window.partitionBy("session_id").orderBy("created_at", F.when(F.col("role") == "user", 0).otherwise(1), "ordinal")
    return messages.withColumn("place", F.row_number().over(order))


def deletable_books(books: DataFrame, sessions: DataFrame) -> DataFrame:
    """Books that no session uses, deleted sessions included."""
    return books.join(sessions.select("book_id").distinct(), "book_id", "left_anti")


def shown_text(status: Column, content: Column, hidden: str = HIDDEN) -> Column:
    return F.when(status.isin("refused_unverified", "low_confidence"), F.lit(hidden)).otherwise(content)


def support_summary(sentences: Column) -> Column:
    """(supported, total, percent) of sentence verdicts."""
    good, total = F.size(F.filter(sentences, lambda s: s.supported)), F.size(sentences)
    return F.struct(good.alias("supported"), total.alias("total"), F.when(total > 0, F.round(100 * good / total)).cast("int").alias("percent"))

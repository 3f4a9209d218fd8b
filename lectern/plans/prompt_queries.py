"""Queries of prompts and of the feedback that a failed attempt gets."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..config import SETTINGS
from ..operators import chat, prompts, support
from .queries import LEANS, LOWER_WORDS, SCAFFOLD, _turns
from .registry import SENTENCES, query, table

TEMPLATES = {
    "plain": "Answer in short.\n{question}\n",
    "stage1": "Use these passages only.\n{context}\n\nAsked: {question}",
    "stage2": "Grade {grade}. {turn_note}\n{style_rules}\n{grade_profile}\n{fewshot}\n{feedback}\nFacts: {stage1_answer}\nAsked: {question}",
    "rewrite": "{history}\n\nSay this on its own: {question}",
    "judge": "Does this suit grade {grade}?\n{answer}",
    "title": "A title for: {question}",
}
FIRST = "First message of this conversation: greet once and say that this comes from Unit {0}."
LATER = "A later message of this conversation: no greeting and no place in the book."
RETRY = "\nThe attempt before this did not pass: {0}\nWrite the answer again so that it does; keep every fact as it is.\n"


def in_sql(template: str, **slots: str) -> str:
    return "'" + re.sub(r"\{(\w+)\}", lambda m: f"' || coalesce(({slots[m[1]]})::VARCHAR, '') || '", template) + "'"


def both(template: str, value: str) -> str:
    return "'" + template.replace("{0}", f"' || {value} || '") + "'"


PROMPTS_SQL = {
    "plain": ("true", in_sql(TEMPLATES["plain"], question="text")),
    "stage1": ("true", in_sql(TEMPLATES["stage1"], question="text", context="said")),
    "stage2": (
        "true",
        in_sql(
            TEMPLATES["stage2"],
            grade="conv_id % 3 + 4",
            turn_note=f"CASE WHEN h IS NULL THEN {both(FIRST, '(conv_id % 9)')} ELSE '{LATER}' END",
            style_rules="CASE WHEN h IS NULL THEN 'Be brief.' || chr(10) || 'Greet.' ELSE 'Be brief.' END",
            grade_profile=f"CASE WHEN conv_id % 3 = 0 THEN '{prompts.NO_PROFILE}' ELSE 'Words: ' || (conv_id % 3) END",
            fewshot="'Q: one' || chr(10) || 'A: 1' || chr(10) || chr(10) || 'Q: ' || chr(10) || 'A: 2'",
            feedback=f"CASE WHEN turn % 3 = 0 THEN {both(RETRY, chr(39) + 'too long; too hard' + chr(39))} ELSE '' END",
            stage1_answer="said",
            question="text",
        ),
    ),
    "rewrite": (f"h IS NOT NULL AND len(w) > 0 AND ({LEANS})", in_sql(TEMPLATES["rewrite"], history="array_to_string(h, chr(10))", question="text")),
    "judge": ("said IS NOT NULL", in_sql(TEMPLATES["judge"], grade="conv_id % 3 + 4", answer="said")),
    "title": ("h IS NULL", in_sql(TEMPLATES["title"], question="text")),
}


@query(
    "d5_prompts",
    f"""WITH m AS (SELECT conv_id, turn, role, text, list(CASE WHEN role = 'user' THEN 'Student: ' ELSE 'Teacher: ' END || text) OVER w AS h,
      lead(CASE WHEN role = 'assistant' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS said FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {SETTINGS.history} PRECEDING AND 1 PRECEDING)),
    q AS (SELECT *, regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') AS low FROM m WHERE role = 'user'), k AS (SELECT *, regexp_extract_all(low, '[A-Za-z'']+') AS w FROM q)
    """
    + " UNION ALL ".join(f"SELECT conv_id, turn, '{kind}' AS kind, md5({text}) AS prompt_md5 FROM k WHERE {when}" for kind, (when, text) in PROMPTS_SQL.items()),
)
def d5_prompts(spark, sf_dir):
    """Prompts of all six kinds for every user turn; the answer is the turn after it."""
    turns = _turns(spark, sf_dir)
    rows = chat.with_answers(chat.turns_with_history(turns), turns)
    asked, said, grade = F.col("content"), F.col("answer"), F.col("session_id") % 3 + 4
    made = {k: prompts.Template(k, t) for k, t in TEMPLATES.items()}
    profile = F.when(F.col("session_id") % 3 > 0, F.concat(F.lit("Words: "), (F.col("session_id") % 3).cast("string")))
    examples = F.expr("array(named_struct('question', 'one', 'teacher_answer', '1'), named_struct('question', null, 'teacher_answer', '2'))")
    feedback = F.when(F.col("ordinal") % 3 == 0, support.style_feedback(F.array(F.lit("too long"), F.lit("too hard"))))
    citation = F.concat(F.lit("Unit "), (F.col("session_id") % 9).cast("string"))
    leans = chat.needs_rewrite(asked, F.size("history") > 0)
    held = {
        "plain": made["plain"].filled(question=asked),
        "stage1": made["stage1"].filled(question=asked, context=said),
        "stage2": prompts.stage2(made["stage2"], asked, said, grade=grade, is_first=F.col("is_first_turn"), citation=citation, style_rules=F.lit("Be brief."), opening_rules=F.lit("Greet."), grade_profile=profile, examples=examples, feedback=feedback),
        "rewrite": F.when(leans, made["rewrite"].filled(history=chat.written_history(F.col("history")), question=asked)),
        "judge": F.when(said.isNotNull(), made["judge"].filled(grade=grade, answer=said)),
        "title": F.when(F.col("is_first_turn"), made["title"].filled(question=asked)),
    }
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.md5(p.cast("binary")).alias("prompt_md5")) for k, p in held.items()]))
    return rows.select(F.col("session_id").alias("conv_id"), F.col("ordinal").alias("turn"), listed.alias("p")).select("conv_id", "turn", "p.kind", "p.prompt_md5").filter("prompt_md5 is not null")


@query(
    "f9_retry_feedback",
    f"""WITH l AS (SELECT conv_id, turn, {SENTENCES.format('text')} AS ss FROM conversations WHERE role = 'assistant'), a AS (SELECT conv_id, turn, unnest(ss) AS s, generate_subscripts(ss, 1) AS k FROM l), n AS (SELECT * FROM a WHERE NOT ({SCAFFOLD})),
    p AS (SELECT conv_id, unnest({SENTENCES.format("regexp_replace(text, '^[^' || chr(10) || ']*' || chr(10), '')")}) AS p FROM conversations WHERE role = 'user'),
    e AS (SELECT n.conv_id, turn, k, max(CASE WHEN len({LOWER_WORDS.format('s')}) = 0 THEN 0.0 ELSE len(list_filter({LOWER_WORDS.format('s')}, lambda w: list_contains({LOWER_WORDS.format('p')}, w))) / len({LOWER_WORDS.format('s')})::DOUBLE END) AS best FROM n JOIN p ON p.conv_id = n.conv_id GROUP BY ALL)
    SELECT n.conv_id, n.turn, 'Not supported by the book: ' || string_agg(s, ' | ' ORDER BY n.k) AS feedback FROM n LEFT JOIN e USING (conv_id, turn, k) WHERE coalesce(best, 0) < {SETTINGS.entailed_from} GROUP BY ALL""",
)
def f9_retry_feedback(spark, sf_dir):
    """What the next attempt is told about each assistant message with unsupported sentences."""
    rows = table(spark, sf_dir, "conversations").withColumn("message_id", F.struct("conv_id", "turn"))
    answers = rows.filter("role = 'assistant'").select("message_id", "conv_id", F.col("text").alias("answer"))
    contexts = answers.select("message_id", "conv_id").join(rows.filter("role = 'user'").select("conv_id", F.col("turn").alias("position"), F.lit("u1-s1").alias("lesson_id"), "text"), "conv_id")
    sentences = support.hypotheses(answers)
    found = support.reports(answers, support.verdicts(sentences, support.score_pairs(support.pairs(sentences, support.premises(contexts)))))
    return found.select("message_id.conv_id", "message_id.turn", support.support_feedback(F.col("unsupported")).alias("feedback")).filter("feedback is not null")

import pytest
from pyspark.sql import functions as F

from lectern.operators import chat, prompts


def test_templates_are_held_to_their_slots(spark):
    prompts.Template("rewrite", "{history} {question} {question}")
    for kind, text in (("plain", "no slot"), ("title", "{question} {answer}"), ("stage1", "{question}"), ("other", "{question}")):
        with pytest.raises(ValueError):
            prompts.Template(kind, text)
    with pytest.raises(ValueError):
        prompts.Template("judge", "{grade} {answer}").filled(grade=F.lit(5))


def test_missing_values_and_braces_in_values(spark):
    made = prompts.Template("judge", "{grade}: {answer}")
    rows = spark.createDataFrame([(5, "{grade} {answer}"), (None, None), (6, "")], "grade int, answer string")
    got = [r[0] for r in rows.select(made.filled(grade=F.col("grade"), answer=F.col("answer"))).collect()]
    assert got == ["5: {grade} {answer}", ": ", "6: "]


def test_notes_of_stage_two(spark):
    text = "|".join("{" + s + "}" for s in prompts.SLOTS["stage2"])
    rows = spark.createDataFrame([(True, "Unit 1", None, None), (False, "Unit 1", "short", "bad")], "first boolean, place string, profile string, feedback string")
    none = F.expr("cast(array() as array<struct<question:string,teacher_answer:string>>)")
    made = prompts.stage2(prompts.Template("stage2", text), F.lit("q"), F.lit("a"), grade=F.lit(5), is_first=F.col("first"), citation=F.col("place"), style_rules=F.lit("R"), opening_rules=F.lit("O"), grade_profile=F.col("profile"), examples=none, feedback=F.col("feedback"))
    one, two = (r[0].split("|") for r in rows.select(made).collect())
    assert "Unit 1" in one[1] and one[2:6] == ["R\nO", prompts.NO_PROFILE, "", ""]
    assert "Unit 1" not in two[1] and two[2:4] == ["R", "short"] and "bad" in two[5]


def test_answers_come_right_after(spark):
    rows = [("s", 1, "user", "a"), ("s", 2, "system", "x"), ("s", 3, "assistant", "b"), ("s", 4, "user", "c"), ("s", 5, "user", "d"), ("t", 1, "user", None)]
    messages = spark.createDataFrame(rows, "session_id string, ordinal int, role string, content string")
    got = {(r.session_id, r.ordinal): r.answer for r in chat.with_answers(chat.turns_with_history(messages), messages).collect()}
    assert got == {("s", 1): "b", ("s", 4): None, ("s", 5): None, ("t", 1): None}

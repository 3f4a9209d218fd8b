"""Prompts of six kinds: templates held to the slots of their kind, filled as columns.

The texts of templates are the caller's.  A prompt is a column of the row that it belongs to, so
prompts of any number of rows need neither a shuffle nor the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chat

# The slots of each kind of prompt.
SLOTS = {
    "plain": ("question",),
    "stage1": ("question", "context"),
    "stage2": ("grade", "turn_note", "style_rules", "grade_profile", "fewshot", "feedback", "stage1_answer", "question"),
    "rewrite": ("history", "question"),
    "judge": ("grade", "answer"),
    "title": ("question",),
}
NO_PROFILE = "Nothing was measured for this grade; keep to the rules above."


@dataclass(frozen=True)
class Template:
    """A text with a {name} for each slot of its kind, and with no other."""

    kind: str
    text: str

    def __post_init__(self):
        if self.kind not in SLOTS:
            raise ValueError(f"no prompt is of kind {self.kind}")
        found, wanted = set(re.findall(r"\{(\w+)\}", self.text)), set(SLOTS[self.kind])
        if found != wanted:
            raise ValueError(f"slots of {self.kind}: missing {sorted(wanted - found)}, unknown {sorted(found - wanted)}")

    def filled(self, **slots: Column) -> Column:
        """The prompt; every slot must be given, and one without a value is empty."""
        if set(slots) != set(SLOTS[self.kind]):
            raise ValueError(f"{self.kind} takes {', '.join(SLOTS[self.kind])}")
        return chat.fill(self.text, slots)


def written_examples(examples: Column) -> Column:
    """Sample answers, array<struct<question, teacher_answer>>, one below the other."""
    return F.array_join(F.transform(examples, lambda e: F.concat(F.lit("Q: "), F.coalesce(e.question, F.lit("")), F.lit("\nA: "), F.coalesce(e.teacher_answer, F.lit("")))), "\n\n")


def stage2(template: Template, question: Column, stage1_answer: Column, *, grade: Column, is_first: Column, citation: Column, style_rules: Column, opening_rules: Column, grade_profile: Column, examples: Column, feedback: Column) -> Column:
    """The prompt that puts an answer into a teacher's words.  The first message of a conversation
    gets the rules for openings and the place in the book, later ones neither; feedback of a failed
    attempt stands in a block of its own; a grade without a profile is told so."""
    rules = F.when(is_first, F.concat_ws("\n", style_rules, opening_rules)).otherwise(style_rules)
    profile = F.when(F.coalesce(grade_profile, F.lit("")) == "", F.lit(NO_PROFILE)).otherwise(grade_profile)
    return template.filled(grade=grade, turn_note=chat.turn_note(is_first, citation), style_rules=rules, grade_profile=profile, fewshot=written_examples(examples), feedback=chat.retry_block(feedback), stage1_answer=stage1_answer, question=question)

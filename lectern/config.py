"""Thresholds of the question-answering jobs, with the defaults they were tuned to."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    top_k: int = 5
    rank_constant: int = 60
    off_book_below: float = 0.35
    entailed_from: float = 0.5
    supported_from: float = 0.5
    verify_retries: int = 1
    style_retries: int = 2
    most_sentence_words: int = 14
    most_grade: float = 4.5
    least_coverage: float = 0.9
    history: int = 8
    chunk_words: int = 600
    chunk_overlap: int = 50
    failures: int = 5
    failure_window_s: int = 300


SETTINGS = Settings()

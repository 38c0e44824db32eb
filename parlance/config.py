"""Thresholds of the reports; each job takes one Settings object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    days: int = 30
    min_word_uses: int = 5
    min_phrase_uses: int = 3
    min_voices: int = 2
    word_min_lift: float = 3.0
    lift_ceiling: float = 100.0
    bigram_min_lift: float = 10.0
    trigram_min_subjects: int = 2
    trend_weeks: int = 13
    min_pair_documents: int = 2
    min_association: float = 0.12
    unit_min_uses: int = 5
    unit_min_voices: int = 3
    unit_min_days: int = 2
    max_reference_ppm: float = 150.0
    topic_min_lift: float = 3.0
    topic_resolution: float = 1.15
    circle_resolution: float = 1.25
    pair_distance: int = 8
    top_terms: int = 80
    top_nodes: int = 240
    node_links: int = 7
    visible_links: int = 5
    person_links: int = 8
    topic_units: int = 18
    topics: int = 12
    excluded_words: tuple[str, ...] = ("lmao", "lol")
    excluded_phrases: tuple[str, ...] = ()
    #: Words that carry talk without saying what it is about: read from a file of
    #: words (``sources.corpus.word_list``); none by default.
    scaffolding: tuple[str, ...] = ()


DEFAULT = Settings()

"""License scan by template markup.

A template is wording with ``<<optional>>…<<end>>`` regions and replaceable
regions ``<<any;m-n>>`` (``m`` to ``n`` arbitrary words) or ``<<one;a|b>>``.  It is
compiled to a token automaton; a stretch of words is accepted when all mandatory
words stand there exactly and in order.  Templates are tried only where one of
their possible first words stands, in texts that hold an anchor: a word that no
accepted stretch can do without, taken from each automaton.  A template without
such a word is tried in all texts.

Besides, fixed base phrases are counted wherever their words stand in a row.

Edge cases: null and empty texts have no words, no labels, score 0.  Repeated
rows get equal results; an empty table gives an empty result.  Texts of any
length are scanned whole.  Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels
from .rows import annotate, table

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_GRANT = "<<optional>>this <<any;1-3>> is<<end>> <<one;licensed|released|distributed|available>> under"
_TERMS = "<<optional>>the<<end>> <<optional>>terms of the<<end>>"
TEMPLATES = {
    "mit-notice": f"{_GRANT} {_TERMS} mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of <<any;1-8>> and associated "
    "documentation <<any;1-4>> to deal in the <<any;1-3>> without restriction",
    "apache-2.0": f"{_GRANT} {_TERMS} apache license <<optional>>version<<end>> 2 <<optional>>0<<end>>",
    "gpl-2.0": f"{_GRANT} {_TERMS} gnu general public license <<optional>>as published by the free software foundation either<<end>> version 2",
    "gpl-3.0": f"{_GRANT} {_TERMS} gnu general public license <<optional>>as published by the free software foundation either<<end>> version 3",
    "cc-by-4.0": f"{_GRANT} <<optional>>a<<end>> <<one;cc|creative commons>> <<one;by|attribution>> 4 0",
    "cc-by-sa-4.0": f"{_GRANT} <<optional>>a<<end>> <<one;cc|creative commons>> <<one;by sa|attribution sharealike>> 4 0",
    "cc-by-nc-4.0": f"{_GRANT} <<optional>>a<<end>> <<one;cc|creative commons>> <<one;by nc|attribution noncommercial>> 4 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "all-rights-reserved": "all rights reserved",
}

FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, template_spans string"
)


class Automaton:
    """Token automaton: ``edges[state]`` maps a word, or None for any word, to next states; ``skips`` cost no word."""

    def __init__(self, template: str):
        self.edges: list[dict[str | None, list[int]]] = [{}]
        self.skips: list[list[int]] = [[]]
        self.end = self._compile(template)
        self.start = self._close({0})
        self.first = {w for s in self.start for w in self.edges[s]}

    def _state(self) -> int:
        self.edges.append({})
        self.skips.append([])
        return len(self.edges) - 1

    def _chain(self, at: int, words: list[str]) -> int:
        for w in words:
            to = self._state()
            self.edges[at].setdefault(w, []).append(to)
            at = to
        return at

    def _compile(self, template: str) -> int:
        at, opened = 0, []
        for mark, word in re.findall(r"<<([^>]*)>>|([^\s<]+)", template):
            if word:
                at = self._chain(at, [word])
            elif mark == "optional":
                opened.append(at)
            elif mark == "end":
                self.skips[opened.pop()].append(at)
            elif mark.startswith("any;"):
                low, high = map(int, mark[4:].split("-"))
                done = self._state()
                for i in range(high):
                    if i >= low:
                        self.skips[at].append(done)
                    at = self._chain(at, [None])
                self.skips[at].append(done)
                at = done
            else:
                ends = [self._chain(at, way.split()) for way in mark[4:].split("|")]
                at = self._state()
                for e in ends:
                    self.skips[e].append(at)
        return at

    def _close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def mandatory(self) -> set[str]:
        """Words that stand in every accepted stretch."""
        return {w for w in {w for edges in self.edges for w in edges if w is not None} if not self._reached_without(w)}

    def _reached_without(self, word: str) -> bool:
        seen, todo = {0}, [0]
        while todo:
            s = todo.pop()
            for t in [*self.skips[s], *(t for w, to in self.edges[s].items() if w != word for t in to)]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return self.end in seen

    def accept(self, words: list[str], at: int) -> int | None:
        """End of the longest accepted stretch from ``at``."""
        states, end = self.start, None
        for i in range(at, len(words)):
            step = {t for s in states for w in (words[i], None) for t in self.edges[s].get(w, ())}
            if not step:
                break
            states = self._close(step)
            if self.end in states:
                end = i + 1
        return end


def compile_all(templates: dict[str, str]) -> dict[str, Automaton]:
    return {label: Automaton(t) for label, t in templates.items()}


def anchors(automata: dict[str, Automaton]) -> re.Pattern[bytes]:
    """Finds, in words parted by blanks, a whole word that each phrase and each accepted stretch must hold."""
    held: set[str] = set()
    for words in [*(set(p.split()) for p in PHRASES), *(a.mandatory() for a in automata.values())]:
        if not words:
            return re.compile(b"")
        if not words & held:
            held.add(max(words, key=lambda w: (len(w), w)))
    return re.compile(rb"(?<![^ ])(?:" + b"|".join(re.escape(w.encode()) for w in sorted(held)) + rb")(?![^ ])")


def scan(texts: pa.Array, automata: dict[str, Automaton]) -> dict[str, pa.Array]:
    out: dict[str, list] = {f.strip().split()[0]: [] for f in FIELDS.split(",")}
    starts: dict[str, list[str]] = {}
    for label, a in automata.items():
        for w in a.first:
            starts.setdefault(w, []).append(label)
    phrases = [(p.split(), label) for p, label in PHRASES.items()]
    anchor = anchors(automata)
    for i, j, data, offs in kernels.slices(texts):
        low = kernels.LOWER[data]
        mask = kernels.WORD_ALNUM[low]
        counts = np.bincount(kernels.spans(mask, offs)[2], minlength=j - i).tolist()
        spaced = np.where(mask, low, 0x20).astype(np.uint8).tobytes()
        for d in range(j - i):
            body = spaced[offs[d] : offs[d + 1]]
            places, base, found, spans = [], set(), set(), []
            if anchor.search(body):
                words = body.decode("utf-8", "replace").split(" ")
                words = [w for w in words if w]
                for at, w in enumerate(words):
                    for phrase, label in phrases:
                        if w == phrase[0] and words[at : at + len(phrase)] == phrase:
                            places.append(at)
                            base.add(label)
                    for label in starts.get(w, ()):
                        end = automata[label].accept(words, at)
                        if end is not None:
                            found.add(label)
                            spans.append(f"{label}:{at}:{end}")
            out["n_words"].append(counts[d])
            out["n_base"].append(len(places))
            out["first_word"].append(min(places, default=None))
            out["last_word"].append(max(places, default=None))
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(base | found)))
            out["score"].append(1.0 if found else 0.5 if base else 0.0)
            out["template_spans"].append(",".join(spans))
    kinds = {"score": pa.float64(), "base_labels": pa.string(), "labels": pa.string(), "template_spans": pa.string()}
    return {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}


def licenses(docs: DataFrame, text: str = "text", id_col: str = "doc_id", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document: base places and labels, accepted templates with their word spans, score.

    The score is 1 where a template is accepted, 0.5 where only a base phrase stands, else 0.
    """
    automata = compile_all(TEMPLATES if templates is None else templates)
    return annotate(docs, text, lambda t: scan(t, automata), FIELDS, keep=(id_col,))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))

"""License scans by template-markup matching (operator 1).

A template is license wording with two kinds of marked regions: ``[[ ... ]]`` is optional, and
``<min-max>`` is replaceable, that many words of any kind. Each template is compiled into an
automaton over words whose states are places in the wording; a text is accepted where the mandatory
words stand exactly, in order and with nothing but the marked regions between them. Base phrases are
templates without regions. An automaton runs only in texts that hold the template's longest run of
mandatory words, and only from words that it can begin with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyspark.llm.common import blocks, id_and_text, table

#: Label and wording of the base phrases.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Label and marked wording.
TEMPLATES = [
    ("mit", "released under the [[terms of the]] mit license"),
    ("mit", "licensed under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of <1-12> to deal in <1-8> without restriction"),
    ("apache-2.0", "licensed under the [[terms of the]] apache license [[version]] 2 0"),
    ("gpl", "licensed under the [[terms of the]] [[gnu]] general public license [[as published by the free software foundation]]"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu <0-1> general public license"),
    ("gpl-3.0", "licensed under the [[terms of the]] [[gnu]] general public license [[as published by the free software foundation either]] version 3"),
    ("gpl-2.0", "licensed under the [[terms of the]] [[gnu]] general public license [[as published by the free software foundation either]] version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] cc by sa 4 0"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] cc by 4 0"),
    ("cc-by", "creative commons attribution [[noncommercial]] [[sharealike]] [[noderivatives]] <0-2> license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "subject to the terms of the mozilla public license [[v]] [[version]] [[v]] 2 0"),
    ("copyright", "copyright [[c]] <1-8> all rights reserved"),
    ("public-domain", "released into the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_MARK = re.compile(r"\[\[|\]\]|<\d+-\d+>|[^\s\[\]<>]+")


@dataclass
class Automaton:
    """``steps[state]``: words to the state that each leads to. ``free[state]``: where any word leads.
    ``skips[state]``: states reached without a word. Words may lead to one state each."""

    label: str
    steps: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    free: list[int | None] = field(default_factory=lambda: [None])
    skips: list[list[int]] = field(default_factory=lambda: [[]])
    mandatory: int = 0
    anchor: bytes = b""
    reach: list[frozenset[int]] = field(default_factory=list)
    first: frozenset[bytes] | None = None

    @property
    def last(self) -> int:
        return len(self.steps) - 1

    def _state(self) -> int:
        self.steps.append({})
        self.free.append(None)
        self.skips.append([])
        return self.last

    @classmethod
    def compiled(cls, label: str, wording: str) -> Automaton:
        out, opened, run, runs = cls(label), [], [], []
        for mark in _MARK.findall(wording):
            if m := re.fullmatch(r"<(\d+)-(\d+)>", mark):
                runs, run = [*runs, run], []
                optional = []
                for k in range(int(m[2])):
                    if k >= int(m[1]):
                        optional.append(out.last)
                    at = out.last
                    out.free[at] = out._state()
                for at in optional:
                    out.skips[at].append(out.last)
            elif mark == "[[":
                runs, run = [*runs, run], []
                opened.append(out.last)
            elif mark == "]]":
                at = opened.pop()
                # a state of its own behind, lest a following region leads back into this one
                before = out.last
                out.skips[before].append(out._state())
                out.skips[at].append(out.last)
            else:
                at = out.last
                out.steps[at][mark.encode()] = out._state()
                if not opened:
                    run = [*run, mark]
                    out.mandatory += 1
        if opened or not out.mandatory:
            raise ValueError(f"a region isn't closed, or no word is mandatory: {wording!r}")
        out.anchor = b" " + " ".join(max([*runs, run], key=lambda r: len(" ".join(r)))).encode() + b" "
        for state in range(len(out.steps)):
            seen, todo = {state}, [state]
            while todo:
                for s in out.skips[todo.pop()]:
                    if s not in seen:
                        seen.add(s)
                        todo.append(s)
            out.reach.append(frozenset(seen))
        start = out.reach[0]
        out.first = None if any(out.free[s] is not None for s in start) else frozenset(w for s in start for w in out.steps[s])
        return out

    def accepts(self, words: Sequence[bytes], at: int) -> bool:
        """Whether the template stands at this word."""
        now, goal = self.reach[0], self.last
        while now:
            if goal in now:
                return True
            if at >= len(words):
                return False
            word, then = words[at], set()
            for s in now:
                if (to := self.steps[s].get(word)) is not None:
                    then |= self.reach[to]
                if (to := self.free[s]) is not None:
                    then |= self.reach[to]
            now, at = then, at + 1
        return False

    def places(self, words: Sequence[bytes]) -> list[int]:
        return [i for i, w in enumerate(words) if (self.first is None or w in self.first) and self.accepts(words, i)]


#: A-Z to lower case, other ASCII characters but digits and a-z to a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


def evidence(mandatory: int) -> float:
    """Of a match of so many mandatory words: nearer 1, the longer the wording."""
    return mandatory / (mandatory + 2)


_OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_templates", T.LongType()),
])
_ARROW = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.int64()]


def scan(df: DataFrame, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), base: Sequence[tuple[str, str]] = tuple(BASE), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``df``: the counts and places of base phrases, the labels, and ``score``,
    the evidence of the longest wording found (0: none). ``n_templates``: places of marked templates.

    Null and empty texts have no words, no labels (the empty string) and score 0. Repeated rows and
    null ids give a row each; other columns of ``df`` are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = [Automaton.compiled(*b) for b in base]
        marked = [Automaton.compiled(*t) for t in templates]
        for block in blocks(batches):
            rows = []
            for doc, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True):
                words = words_of(text)
                joined = b" " + b" ".join(words) + b" "
                found, labels, longest, more = [], set(), 0, 0
                for a in plain:
                    if a.anchor in joined and (at := a.places(words)):
                        found += at
                        labels.add(a.label)
                        longest = max(longest, a.mandatory)
                base_labels = ",".join(sorted(labels))
                for a in marked:
                    if a.anchor in joined and (at := a.places(words)):
                        more += len(at)
                        labels.add(a.label)
                        longest = max(longest, a.mandatory)
                rows.append((doc, len(words), len(found), min(found, default=None), max(found, default=None), base_labels, ",".join(sorted(labels)), evidence(longest), more))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=_OUT.names)

    return id_and_text(df, id_col, text_col).mapInArrow(run, _OUT)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir))


def _pattern(wording: str) -> str:
    """A regular expression for the template over words each led by a space."""
    out = ""
    for mark in _MARK.findall(wording):
        if m := re.fullmatch(r"<(\d+)-(\d+)>", mark):
            out += f"(?: [^ ]+){{{m[1]},{m[2]}}}"
        else:
            out += {"[[": "(?:", "]]": ")?"}.get(mark, f" {mark}")
    return out + " "


def oracle_sql() -> str:
    """DuckDB SQL for the query's rows: base phrases by comparing list entries, templates as regular
    expressions (n_templates: words at which one matches)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    stands = {}
    for _, phrase in BASE:
        parts = phrase.split()
        stands[phrase] = "list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts)) + ")"
    found = ", ".join(f"{x} AS p{k}" for k, x in enumerate(stands.values()))
    labels = [f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (label, _) in enumerate(BASE)]
    marked = [f"CASE WHEN regexp_matches(j, '{_pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES]
    longest = [f"CASE WHEN len(p{k}) > 0 THEN {len(p.split())} ELSE 0 END" for k, (_, p) in enumerate(BASE)]
    longest += [f"CASE WHEN regexp_matches(j, '{_pattern(t)}') THEN {Automaton.compiled(label, t).mandatory} ELSE 0 END" for label, t in TEMPLATES]
    tails = "list_transform(range(len(w)), lambda i: ' ' || array_to_string(w[i + 1:i + 60], ' ') || ' ')"
    counted = " + ".join(f"CASE WHEN regexp_matches(j, '{_pattern(t)}') THEN len(list_filter({tails}, lambda x: regexp_matches(x, '^{_pattern(t)}'))) ELSE 0 END" for _, t in TEMPLATES)
    text = lambda xs: f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS j, {found} FROM a),
c AS (SELECT *, list_concat(list_concat(p0, p1), p2) AS p, greatest({', '.join(longest)}) AS m FROM b)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) AS BIGINT) AS first_word, CAST(list_max(p) AS BIGINT) AS last_word,
  {text(labels)} AS base_labels, {text(labels + marked)} AS labels, CAST(m AS DOUBLE) / (m + 2) AS score, CAST({counted} AS BIGINT) AS n_templates
FROM c"""

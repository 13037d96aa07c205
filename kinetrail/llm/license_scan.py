"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags; tags' expressions are evaluated.

The automaton runs once over each text's words (A-Z lowered, joined by single spaces), so a phrase is found however
its words are spaced or punctuated, and only at word bounds. Where it finds the words of an SPDX tag, the tag's
expression is read from the text, over line ends until its parentheses close, and goes through a shunting-yard parser:
``with`` binds before ``and`` before ``or``. The longest of the phrases that end at a word sets the grade there.

Each licence has a grade of freedom (0 to 1). ``or`` takes the better side (the choice is the user's), ``and`` the
worse (both apply), ``with`` an exception adds ``EXCEPTION``. ``score`` is the worst grade of all notices and
expressions in the text, as all apply; 0 if there's none.

Defined results
* words are ``[0-9a-z]`` and non-ASCII characters; null or empty text has none: labels are empty strings, score 0;
* an expression that can't be parsed labels the identifiers in it as far as known and grades as the worst of them;
* unknown identifiers don't become labels and grade ``UNKNOWN``; repeated rows are scanned each; other columns are
  ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from kinetrail.llm.byte_bpe import blocks
from kinetrail.llm.common import quoted

#: The base phrases of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words of other notices and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person": "mit",
    "licensed under the apache": "apache",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "zlib license": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "artistic license": "artistic",
    "open font license": "ofl",
    "python software foundation license": "psf",
    "common development and distribution license": "cddl",
    "creative commons zero": "cc0",
    "boost software license": "bsl",
    "cc0": "cc0",
    "cc by 4 0": "cc-by",
    "cc by 3 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "all rights reserved": "proprietary",
}
#: How freely a licence lets its text be used.
GRADES = {
    "cc0": 1.0, "0bsd": 1.0, "unlicense": 1.0, "zlib": 1.0, "psf": 0.95, "ofl": 0.9, "artistic": 0.8, "cddl": 0.7, "mit": 1.0, "isc": 1.0, "bsd": 1.0, "bsl": 1.0, "apache": 0.95, "cc-by": 0.9, "mpl": 0.7, "epl": 0.6, "lgpl": 0.6,
    "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "proprietary": 0.0,
}
UNKNOWN = 0.3
EXCEPTION = 0.2
TAG = "spdx license identifier"
_TAG = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier[ \t]*:?", re.IGNORECASE | re.ASCII)
_LINE_END = re.compile(r"[\n\r]|\Z")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str | None:
    """The label of an SPDX identifier: the longest known one that its name begins with."""
    name = identifier.lower().rstrip("+")
    known = [x for x in GRADES if name == x or name.startswith(x + "-")]
    return max(known, key=len, default=None)


def postfix(expression: str) -> list[str] | None:
    """The expression's tokens in postfix order, by a shunting yard; None if it's malformed."""
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # did the last token end an operand?
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _PRECEDENCE:
            if not operand:
                return None
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= _PRECEDENCE[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = False
        elif token == "(":
            if operand:
                return None
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting or not operand:
                return None
            waiting.pop()
        elif operand:
            break  # words behind the expression
        else:
            out.append(token)
            operand = True
    if not operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def expression_at(text: str, start: int) -> str:
    """The licence expression that begins at ``start``: to the end of the line, or on to where its parentheses close.

    What isn't an expression as far as it goes is returned as the whole line.
    """
    depth, operand, end = 0, False, start
    for m in _TOKEN.finditer(text, start):
        gap = text[end : m.start()]
        if not depth and ("\n" in gap or "\r" in gap):
            break
        token = m[0].lower()
        if token == ")":
            if not operand or not depth:
                break
            depth -= 1
        elif token in _PRECEDENCE:
            if not operand:
                break
            operand = False
        elif operand:
            break
        elif token == "(":
            depth += 1
        else:
            operand = True
        end = m.end()
    if depth or not operand:
        end = _LINE_END.search(text, start).start()
    return text[start:end]


def evaluate(expression: str) -> tuple[set[str], float]:
    """(labels, grade) of a licence expression."""
    order = postfix(expression)
    names = [t for t in _TOKEN.findall(expression) if t not in "()" and t.lower() not in _PRECEDENCE]
    if order is None:
        labels = {x for x in map(label_of, names) if x}
        return labels, min((GRADES[x] for x in labels), default=UNKNOWN)
    labels: set[str] = set()
    values: list[tuple[float, str | None]] = []
    for token in order:
        if token not in _PRECEDENCE:
            label = label_of(token)
            values.append((GRADES.get(label, UNKNOWN), label))
            continue
        right, left = values.pop(), values.pop()
        if token == "with":  # the right side names an exception, not a licence
            values.append((min(1.0, left[0] + EXCEPTION), left[1]))
            continue
        labels |= {x for x in (left[1], right[1]) if x}
        values.append(((max if token == "or" else min)(left[0], right[0]), None))
    labels |= {x for _, x in values if x}
    return labels, values[0][0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    kinds: dict[str, tuple] = {p: (p, label, True) for p, label in BASE.items()}
    for p, label in NOTICES.items():
        kinds.setdefault(p, (p, label, False))
    kinds[TAG] = (TAG, None, False)
    for p, value in kinds.items():
        found.add_word(f" {p} ", value)
    found.make_automaton()
    return found


def scan(text: str, machine: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text."""
    words = _WORD.findall(text.encode().lower())
    if not words:
        return 0, 0, None, None, "", "", 0.0
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base: set[str] = set()
    labels: set[str] = set()
    starts: list[int] = []
    grades: list[float] = []
    tagged = False
    graded = -1  # phrases that end at one word come longest first
    counted = spaces = 0  # hits come in order of their ends, so each stretch of the text is counted once
    for end, (phrase, label, is_base) in machine.iter(line):
        if is_base:
            base.add(label)
            spaces += line.count(" ", counted, end)
            counted = end
            starts.append(spaces - phrase.count(" ") - 1)
        if label is None:
            tagged = True
        else:
            labels.add(label)
            if end != graded:
                grades.append(GRADES[label])
            graded = end
    if tagged:
        for m in _TAG.finditer(text):
            more, grade = evaluate(expression_at(text, m.end()))
            labels |= more
            grades.append(grade)
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels | base)), min(grades, default=0.0)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    kinds = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}
    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]):
        machine = automaton()
        for part, texts in blocks(batches):
            cols = zip(*[scan(t, machine) for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, arrow[k]) for c, k in zip(cols, kinds.values())]], ["doc_id", *kinds])

    return rows.mapInArrow(run, ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *[f"{n} {k}" for n, k in kinds.items()]]))

"""Licence scan: Aho-Corasick over words, expressions by a shunting-yard parser.

A text becomes one line of lower-cased words parted by single blanks. One
automaton holds every notice phrase and identifier tag, each with a blank at
both ends, so it finds whole words only and all places in one pass, whatever
the number of phrases. Of phrases that overlap the longest gives the label
(``cc by nc`` is no ``cc by``); the three base phrases count at all places.

Behind an identifier tag the rest of the line is a licence expression:
identifiers joined by ``and``, ``or`` and ``with``, in parentheses. Notices in
running text that only linking words part ("under the MIT License or the
Apache License") make an expression, too. A shunting-yard parser turns each
into postfix order and evaluates it: obligations of ``and`` add up (the
strictest counts), ``or`` is a choice (the freest counts), ``with`` an
exception eases its licence. The document's score is the strictest of its
expressions, from 0 (no licence terms found) to 1 (all rights reserved).

Rows are independent: nothing is shuffled, and a task's memory is bounded by
one Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed phrases of the base scan and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# How strict the obligations of a kind of licence are.
PUBLIC, PERMISSIVE, SHARE_FILES, COPYLEFT, NETWORK, LIMITED, RESERVED = 0.05, 0.1, 0.4, 0.6, 0.7, 0.85, 1.0
UNKNOWN = 0.5
# An exception takes this share off the obligations of its licence.
EXCEPTION_EASES = 0.5


@dataclass(frozen=True)
class Licence:
    label: str
    weight: float
    phrases: tuple[str, ...]  # words as the scan cuts them, parted by blanks


# Licences, and the phrases that name them in notices.
LICENCES = (
    Licence("cc0", PUBLIC, ("cc0", "cc zero", "creative commons zero", "public domain dedication")),
    Licence("unlicense", PUBLIC, ("the unlicense", "unlicense org")),
    Licence("public-domain", PUBLIC, ("released into the public domain", "dedicated to the public domain")),
    Licence("cc-by", PERMISSIVE, ("cc by", "creative commons attribution")),
    Licence("mit", PERMISSIVE, ("mit license", "mit licence", "permission is hereby granted free of charge")),
    Licence("apache", PERMISSIVE, ("apache license", "apache licence", "apache software license")),
    Licence("apache-2.0", PERMISSIVE, ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache licence version 2 0")),
    Licence("bsd", PERMISSIVE, ("bsd license", "bsd licence", "bsd style license")),
    Licence("bsd-2-clause", PERMISSIVE, ("bsd 2 clause", "2 clause bsd", "simplified bsd license")),
    Licence("bsd-3-clause", PERMISSIVE, ("bsd 3 clause", "3 clause bsd", "new bsd license")),
    Licence("isc", PERMISSIVE, ("isc license", "isc licence")),
    Licence("zlib", PERMISSIVE, ("zlib license",)),
    Licence("boost-1.0", PERMISSIVE, ("boost software license",)),
    Licence("cc-by-sa", SHARE_FILES, ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike")),
    Licence("lgpl", SHARE_FILES, ("lesser general public license", "library general public license", "gnu lgpl")),
    Licence("mpl-2.0", SHARE_FILES, ("mozilla public license", "mozilla public licence")),
    Licence("epl", SHARE_FILES, ("eclipse public license",)),
    Licence("cddl", SHARE_FILES, ("common development and distribution license",)),
    Licence("gfdl", COPYLEFT, ("free documentation license", "gnu fdl")),
    Licence("gpl", COPYLEFT, ("general public license", "general public licence", "gnu gpl")),
    Licence("gpl-2.0", COPYLEFT, ("general public license version 2", "gnu gpl v2", "gplv2")),
    Licence("gpl-3.0", COPYLEFT, ("general public license version 3", "gnu gpl v3", "gplv3")),
    Licence("agpl", NETWORK, ("affero general public license", "gnu agpl", "agplv3")),
    Licence("cc-by-nd", LIMITED, ("cc by nd", "creative commons attribution noderivs", "creative commons attribution noderivatives")),
    Licence("cc-by-nc", LIMITED, ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial")),
    Licence("cc-by-nc-sa", LIMITED, ("cc by nc sa", "creative commons attribution noncommercial sharealike")),
    Licence("cc-by-nc-nd", LIMITED, ("cc by nc nd", "creative commons attribution noncommercial noderivs")),
    Licence("reserved", RESERVED, ("all rights reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados")),
    Licence("proprietary", RESERVED, ("proprietary and confidential", "proprietary license")),
)

# Tags that an expression follows on the same line.
TAGS = ("spdx license identifier", "license expression", "licence expression")

# Families of identifiers, most special first: an identifier that starts so has this weight.
FAMILIES = (
    ("cc0", PUBLIC), ("unlicense", PUBLIC), ("0bsd", PUBLIC), ("wtfpl", PUBLIC), ("cc-by-nc", LIMITED), ("cc-by-nd", LIMITED),
    ("cc-by-sa", SHARE_FILES), ("cc-by", PERMISSIVE), ("mit", PERMISSIVE), ("apache", PERMISSIVE), ("bsd", PERMISSIVE),
    ("isc", PERMISSIVE), ("zlib", PERMISSIVE), ("bsl", PERMISSIVE), ("python", PERMISSIVE), ("lgpl", SHARE_FILES),
    ("mpl", SHARE_FILES), ("epl", SHARE_FILES), ("cddl", SHARE_FILES), ("agpl", NETWORK), ("gpl", COPYLEFT), ("gfdl", COPYLEFT),
    ("eupl", COPYLEFT), ("osl", COPYLEFT), ("proprietary", RESERVED), ("none", RESERVED),
)

WORD_GAP = re.compile("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
# Words that may part two notices of one expression; the operators say how they are joined.
OPERATORS = {"or": "or", "and": "and", "with": "with", "und": "and", "oder": "or", "et": "and", "ou": "or", "y": "and", "o": "or"}
LINKING = {"the", "a", "under", "terms", "of", "license", "licence", "version", "v", "either", "at", "your", "option", "gnu", "0", "1", "2", "3", "4"}
MAX_LINKING = 8
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TAG_END = re.compile("[ \t:=\"']*")
EXPRESSION_TOKEN = re.compile(r"[()/&|]|[a-z0-9][a-z0-9.+:-]*")
WEIGHTS = {licence.label: licence.weight for licence in LICENCES}


def lower(text: str) -> str:
    """A-Z to small letters; all else, other alphabets too, stays."""
    return text.encode().lower().decode()


def automaton() -> ahocorasick.Automaton:
    """All phrases between blanks; the value is (words, kind, label, base label or None)."""
    found = ahocorasick.Automaton()
    for licence in LICENCES:
        for phrase in licence.phrases:
            found.add_word(f" {phrase} ", (phrase.count(" ") + 1, "notice", licence.label, BASE.get(phrase)))
    for tag in TAGS:
        found.add_word(f" {tag} ", (tag.count(" ") + 1, "tag", tag, None))
    found.make_automaton()
    return found


def expression_tokens(text: str, at: int = 0) -> list[str]:
    """Operators, parentheses and identifiers of the expression at a place of a lower-cased text.

    It ends at the line's end and at the first other thing.
    """
    out: list[str] = []
    for m in EXPRESSION_TOKEN.finditer(text, at):
        if text[at : m.start()].strip(" \t"):
            break
        token = {"/": "or", "|": "or", "&": "and"}.get(m[0], m[0].rstrip(".:-"))
        operand = token not in PRECEDENCE and token not in ("(", ")")
        if operand and out and out[-1] not in PRECEDENCE and out[-1] != "(":
            break  # two identifiers side by side: prose goes on
        if not (token in PRECEDENCE and out and out[-1] == token):  # "||" and "&&" are one operator
            out.append(token)
        at = m.end()
    return out


def postfix(tokens: list[str]) -> list[str]:
    """Tokens in postfix order, by a shunting yard; ``with`` binds closest, then ``and``, then ``or``.

    A parenthesis without a partner is passed over.
    """
    out: list[str] = []
    yard: list[str] = []
    for token in tokens:
        if token == "(":
            yard.append(token)
        elif token == ")":
            while yard and yard[-1] != "(":
                out.append(yard.pop())
            if yard:
                yard.pop()
        elif token in PRECEDENCE:
            while yard and yard[-1] != "(" and PRECEDENCE[yard[-1]] >= PRECEDENCE[token]:
                out.append(yard.pop())
            yard.append(token)
        else:
            out.append(token)
    while yard:
        last = yard.pop()
        if last != "(":
            out.append(last)
    return out


def weight_of(identifier: str) -> float:
    """How strict the licence of an identifier is; unknown ones lie in the middle."""
    if identifier in WEIGHTS:
        return WEIGHTS[identifier]
    return next((w for family, w in FAMILIES if identifier.startswith(family)), UNKNOWN)


def evaluate(tokens: list[str]) -> tuple[float, set[str]] | None:
    """(strictness, licences named) of an infix expression; None if it names none.

    An operator that lacks an operand leaves the other one as it is; operands
    that no operator joins count as joined by ``and``.
    """
    stack: list[tuple[float, frozenset[str]]] = []
    for token in postfix(tokens):
        if token not in PRECEDENCE:
            stack.append((weight_of(token), frozenset([token])))
        elif len(stack) > 1:
            (b, right), (a, left) = stack.pop(), stack.pop()
            if token == "with":  # the right side names an exception, not a licence
                stack.append((a * EXCEPTION_EASES, left))
            else:
                stack.append((max(a, b) if token == "and" else min(a, b), left | right))
    return (max(w for w, _ in stack), set().union(*(names for _, names in stack))) if stack else None


@dataclass
class Scan:
    """What one text holds."""

    n_words: int
    base: list[tuple[int, str]]  # (first word, label) of every place of a base phrase
    statements: list[tuple[float, set[str]]]  # evaluated expressions and notices

    @property
    def base_labels(self) -> set[str]:
        return {label for _, label in self.base}

    @property
    def labels(self) -> set[str]:
        return self.base_labels.union(*(names for _, names in self.statements))

    @property
    def score(self) -> float:
        return max((w for w, _ in self.statements), default=0.0)


def longest(places: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Places (first word, end word, kind, label) that no longer place holds whole, in order."""
    out: list[tuple[int, int, str, str]] = []
    for place in sorted(places, key=lambda p: (p[0], -p[1])):
        if not out or place[1] > out[-1][1]:
            out.append(place)
    return out


def joint(between: list[str]) -> str | None:
    """The operator that the words between two notices stand for; None if they part two statements."""
    joins = {OPERATORS[w] for w in between if w in OPERATORS}
    if not joins or len(between) > MAX_LINKING or any(w not in OPERATORS and w not in LINKING for w in between):
        return None
    return "or" if "or" in joins else joins.pop()  # "and/or" leaves the choice


def statements(text: str, line: str, places: list[tuple[int, int, str, str]]) -> list[tuple[float, set[str]]]:
    """Evaluated expressions of a text: those behind tags, and notices that linking words join."""
    groups: list[list[str]] = []
    words = line.split() if places else []
    end = 0
    for first, stop, kind, label in places:
        if kind == "notice":
            operator = joint(words[end:first]) if groups and end <= first <= end + MAX_LINKING else None
            if operator:
                groups[-1] += [operator, label]
            else:
                groups.append([label])
            end = stop
    tags = {stop for _, stop, kind, _ in places if kind == "tag"}
    if tags:  # the raw text behind the tag's last word
        small = lower(text)
        for i, m in enumerate(WORD.finditer(small), 1):
            if i in tags:
                groups.append(expression_tokens(small, TAG_END.match(small, m.end()).end()))
    return [found for found in map(evaluate, groups) if found is not None]


def scan(text: str | None, phrases: ahocorasick.Automaton) -> Scan:
    """All that the scan finds in a text; None counts as empty."""
    line = f" {WORD_GAP.sub(' ', lower(text or '')).strip(' ')} "
    if len(line) == 2:
        return Scan(0, [], [])
    base: list[tuple[int, str]] = []
    places: list[tuple[int, int, str, str]] = []
    words = at = 0
    for end, (size, kind, label, base_label) in phrases.iter(line):
        # Words up to the blank that ends the place; ends only grow, so each blank is counted once.
        words += line.count(" ", at, end)
        at = end
        places.append((words - size, words, kind, label))
        if base_label:
            base.append((words - size, base_label))
    return Scan(line.count(" ") - 1, base, statements(text or "", line, longest(places)))


def licence_scan(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``documents`` needs doc_id and text; other columns are not read. A null
    text counts as empty: no words, no places (null first and last word),
    empty labels, score 0. Rows that repeat, and null ids, are scanned each by
    itself. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton()
        for batch in batches:
            found = [scan(t.as_py(), phrases) for t in batch.column(1)]
            starts = [[at for at, _ in f.base] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f.n_words for f in found], pa.int64()),
                    pa.array([len(s) for s in starts], pa.int64()),
                    pa.array([min(s, default=None) for s in starts], pa.int64()),
                    pa.array([max(s, default=None) for s in starts], pa.int64()),
                    pa.array([",".join(sorted(f.base_labels)) for f in found], pa.string()),
                    pa.array([",".join(sorted(f.labels)) for f in found], pa.string()),
                    pa.array([f.score for f in found], pa.float64()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return rows.mapInArrow(run, schema)

"""Labels of a dependency parse, and a default parser as a plug-in; what follows from a parse is in ``functions.parse``.

A parser gives a list of ``Node``, with the usual universal part-of-speech, treebank tag and dependency labels; any can be
passed in. The default, ``parse``, is shallow: it finds clauses by their markers, participles and verbs, and attaches words
within a clause by position. It is right on plain sentences and an approximation beyond.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .nlp import Annotator, annotate
from .registry import Mission
from .text import mentions


class Node(NamedTuple):
    text: str
    pos: str
    tag: str
    dep: str
    head: int  # index of the governing word; the root's own


Parser = Callable[[str], list[Node]]

# The labels that make up each word class.
LABELS = {
    "conjoined": {"dep": {"conj"}}, "conjunction": {"pos": {"CCONJ"}, "tag": {"CC"}}, "root": {"dep": {"ROOT"}},
    "useless": {"dep": {"det", "amod", "advmod"}, "pos": {"DET", "ADJ", "ADV"}, "tag": {"CD", "JJ", "JJR", "JJS", "LS", "PDT", "RB", "RBR", "RBS", "UH", "WRB", "RP"}},
    "verb": {"dep": {"verb", "advcl", "relcl", "acl"}, "tag": {"VBD", "VBN", "VB", "VBP", "VBZ", "VBG", "MD"}},
    "subject": {"dep": {"nsubj", "nsubjpass", "expl"}}, "object": {"dep": {"dobj", "pobj", "attr"}}, "appos": {"dep": {"appos"}}, "ccomp": {"dep": {"ccomp"}},
    "preposition": {"dep": {"prep", "agent", "dative"}, "pos": {"ADP"}, "tag": {"IN"}}, "aux": {"dep": {"aux", "auxpass"}, "pos": {"AUX", "PART"}},
    "passive": {"dep": {"pass", "auxpass"}}, "determinant": {"pos": {"DET", "PRON"}, "tag": {"PDT", "DT", "WDT", "EX"}}, "noun": {"pos": {"PROPN", "NOUN", "PRON"}},
    "pronoun": {"pos": {"PRON"}, "tag": {"PRP", "PRP$", "WP", "WP$"}}, "adjective": {"dep": {"amod"}, "pos": {"ADJ"}, "tag": {"JJ", "JJR", "JJS"}},
    "marker": {"dep": {"mark"}, "tag": {"WRB", "WDT"}}, "negative": {"dep": {"neg"}}, "number": {"pos": {"NUM"}, "tag": {"CD"}}, "x": {"dep": {"X"}, "pos": {"X"}},
    "bracket": {"tag": {"-LRB-", "-RRB-"}}, "possessive": {"tag": {"POS"}}, "punctuation": {"dep": {"punct"}},
}
TENSES = {"past": {"VBD", "VBN"}, "present": {"VB", "VBP", "VBZ", "VBG"}, "future": {"MD"}, "purpose": {"TO"}}
SUBORDINATORS = {"because", "although", "while", "whereas", "if", "when", "where", "once", "since", "unless", "until", "which", "who", "whom", "whose", "that"}
IRREGULAR_PARTICIPLES = {"taken", "made", "given", "shown", "seen", "found", "known", "drawn", "built"}


_TAGS = {"NOUN": ("NOUN", "NN"), "ADJ": ("ADJ", "JJ"), "ADV": ("ADV", "RB"), "DET": ("DET", "DT"), "PREP": ("ADP", "IN"), "PRON": ("PRON", "PRP"), "NEG": ("PART", "RB"), "NUM": ("NUM", "CD"), "PUNCT": ("PUNCT", "."), "POSS": ("PART", "POS")}
_MODALS = {"can", "could", "may", "might", "must", "shall", "should", "will", "would"}


def parse(sentence: str, annotator: Annotator = annotate) -> list[Node]:
    """The shallow parse."""
    tokens = annotator(sentence)
    n = len(tokens)
    low = [t.text.lower() for t in tokens]
    pos = [t.pos for t in tokens]
    content = lambda i: 0 <= i < n and pos[i] in ("NOUN", "PRON", "NUM")

    def participle(i: int) -> bool:
        """A participle that follows a noun or bracket and no auxiliary: it opens a clause of its own."""
        form = low[i] in IRREGULAR_PARTICIPLES or (len(low[i]) > 3 and low[i].endswith(("ed", "ing")))
        return form and pos[i] in ("VERB", "ADJ", "NOUN") and content(i - 1) and i + 1 < n and (pos[i + 1] in ("PREP", "DET", "PRON", "ADV") or low[i + 1] in ("either", "both"))

    # words -> clauses: (first word, kind); a clause ends where the next begins or at a comma after a fronted one
    clause, stack, begun = [0] * n, [0], [("ROOT", -1)]
    for i in range(n):
        marker = low[i] in SUBORDINATORS and (low[i] != "that" or (i + 1 < n and pos[i + 1] in ("VERB", "AUX", "ADV")) or (i > 0 and pos[i - 1] == "VERB"))
        if marker:
            begun.append(("relcl" if low[i] in ("which", "who", "whom", "whose", "that") and content(i - 1) else "advcl", i - 1))
            stack.append(len(begun) - 1)
        elif participle(i):
            begun.append(("acl", i - 1))
            stack.append(len(begun) - 1)
        elif low[i] == "," and len(stack) > 1 and clause[0] == stack[1]:
            clause[i] = stack[-1]
            stack = [0]
            continue
        clause[i] = stack[-1]
    heads = {}
    for c in range(len(begun)):
        own = [i for i in range(n) if clause[i] == c]
        if not own:
            continue
        verb = next((i for i in own if pos[i] == "VERB" or (begun[c][0] == "acl" and i == own[0])), None)
        if verb is None:  # a participle after an auxiliary, else the auxiliary, else the last noun
            aux = next((i for i in own if pos[i] == "AUX"), None)
            later = [i for i in own if aux is not None and i > aux and low[i].endswith(("ed", "ing")) and pos[i] in ("ADJ", "NOUN")]
            verb = later[0] if later else aux if aux is not None else next((i for i in reversed(own) if content(i)), own[0])
        heads[c] = verb
    main = heads.get(0, next(iter(heads.values()), 0))
    out = []
    for i in range(n):
        c = clause[i]
        v = heads[c]
        kind, tag = ("ADP", "IN") if low[i] in SUBORDINATORS and pos[i] == "CONJ" else ("CCONJ", "CC") if pos[i] == "CONJ" else ("AUX", "MD" if low[i] in _MODALS else "VBZ") if pos[i] == "AUX" else ("VERB", "VBG" if low[i].endswith("ing") else "VBN" if low[i].endswith("ed") or low[i] in IRREGULAR_PARTICIPLES else "VBP") if pos[i] == "VERB" or i == v and pos[i] == "ADJ" else _TAGS[pos[i]]
        if low[i] in "([{":
            tag = "-LRB-"
        elif low[i] in ")]}":
            tag = "-RRB-"
        following = next((j for j in range(i + 1, n) if clause[j] == c and pos[j] == "NOUN"), None)
        before = next((j for j in range(i - 1, -1, -1) if clause[j] == c and (pos[j] in ("NOUN", "PREP") or j == v)), None)
        run = following is not None and all(pos[j] in ("ADJ", "NUM", "ADV", "DET", "POSS", "NOUN") and j != v for j in range(i + 1, following))
        if i == v:
            at = begun[c][1]
            dep, head = ("ROOT", i) if i == main else (begun[c][0], at if begun[c][0] in ("relcl", "acl") and at >= 0 and at != i else main)
        elif pos[i] == "PUNCT":
            dep, head = "punct", v
        elif low[i] in SUBORDINATORS and pos[i] == "CONJ" and clause[i - 1 if i else 0] != c or (low[i] in SUBORDINATORS and i == 0):
            dep, head = "mark", v
        elif pos[i] == "CONJ":
            dep, head = "cc", before if before is not None else v
        elif pos[i] == "NEG":
            dep, head = "neg", v
        elif pos[i] == "AUX":
            dep, head = "aux", v
        elif pos[i] == "PREP":
            dep, head = "prep", before if before is not None and i > v else v
        elif pos[i] in ("DET", "ADJ", "NUM") and run:
            dep, head = {"DET": "det", "ADJ": "amod", "NUM": "nummod"}[pos[i]], following
        elif pos[i] == "ADV":
            dep, head = "advmod", i + 1 if i + 1 < n and pos[i + 1] in ("ADJ", "ADV") and clause[i + 1] == c else v
        elif pos[i] == "ADJ":
            dep, head = "acomp", v
        elif pos[i] == "POSS":
            dep, head = "case", before if before is not None else v
        elif i + 1 < n and pos[i] == "NOUN" and pos[i + 1] == "NOUN" and clause[i + 1] == c and i + 1 != v:
            dep, head = "compound", i + 1
        elif before is not None and pos[before] == "PREP":
            dep, head = "pobj", before
        elif any(pos[j] == "CONJ" for j in range((before if before is not None else i), i)) and before is not None and before != v:
            dep, head = "conj", before
        else:
            dep, head = ("nsubj" if i < v else "dobj"), v
        out.append(Node(tokens[i].text, kind, tag, dep, head if head != i or dep == "ROOT" else v))
    return out


_ALWAYS = r"(?iU)\b(?:i|me|my|mine|we|us|our|ours)\b|\b(?:figures?|fig|tables?|tab|plots?)\b|\bet al\b|etal\b"


def importance_of(mission: Mission) -> Callable[[Column], Column]:
    """Whether words matter for a mission: they name it, speak in the first person, show a figure or cite."""
    return lambda text: mentions(text, mission) | text.rlike(_ALWAYS)


def parsed(sentence: Column, parser: Parser = parse) -> Column:
    """array<struct<text, pos, tag, dep, head>> by a parser in Python; Arrow batches, the only step that is not an expression."""

    @F.pandas_udf("array<struct<text:string,pos:string,tag:string,dep:string,head:int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [n._asdict() for n in parser(t)] if t is not None else None)

    return run(sentence)

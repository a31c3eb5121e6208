"""Linguistic annotation as a plug-in, and what rests on it: word chunks, core meanings, the last rungs of disambiguation,
thinning a sentence. The default annotator is a lexicon of closed word classes with suffix rules, an approximation; a better
one (a function sentence -> tokens) can be passed wherever an annotator is taken."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ambiguity import PHRASES
from .registry import MISSIONS, Mission

AUTHOR, NUMBER = "Authorsetal", "000"


class Token(NamedTuple):
    text: str
    pos: str  # NOUN ADJ ADV VERB AUX DET PREP CONJ PRON NEG NUM PUNCT POSS


Annotator = Callable[[str], list[Token]]

# Closed word classes of English.
CLASSES = {
    "DET": "a an the this that these those each every some any no all both either neither such",
    "PREP": "across along around behind beneath beyond inside outside toward towards upon of in on at by for with from to into onto over under between among through during before after about above below against within without via per than as like",
    "CONJ": "and or but nor so yet because although while whereas if when where which who whom whose",
    "PRON": "i me my mine we us our ours you your yours he him his she her hers it its they them their theirs there here what",
    "AUX": "is are was were be been being am has have had do does did can could may might must shall should will would",
    "NEG": "not never n't",
    "VERB": "use used uses show shows showed shown see saw seen find found observe observed give gave given present presented take took taken make made plot plotted publish published follow follows differ differs rely leave left include included",
    "ADV": "very also too again already then thus hence however more most less least just only even still well really often always sometimes soon here there now",
    "ADJ": "high low old new young small large big deep bright faint rich poor neat same other similar different good better best early late long short strong weak hot cold massive raw blue red near far infrared ultraviolet optical several many few recent great full whole",
}
_class = {w: c for c, ws in CLASSES.items() for w in ws.split()}
IRREGULAR = {"radii": "radius", "spectra": "spectrum", "nebulae": "nebula", "novae": "nova", "supernovae": "supernova", "data": "data", "series": "series", "analyses": "analysis", "axes": "axis", "hypotheses": "hypothesis", "indices": "index", "matrices": "matrix", "phenomena": "phenomenon", "foci": "focus"}
_token = re.compile(r"[^\W_]+(?:[-−/.][^\W_]+)*|'s\b|\S")


def annotate(sentence: str) -> list[Token]:
    out = []
    for m in _token.finditer(sentence or ""):
        w, low = m[0], m[0].lower()
        if low == "'s":
            pos = "POSS"
        elif not any(c.isalnum() for c in w):
            pos = "PUNCT"
        elif re.match(r"(ID)?\d", w, re.I):
            pos = "NUM"
        elif low in _class:
            pos = _class[low]
        elif low.endswith("ly") and len(low) > 4:
            pos = "ADV"
        elif low.endswith(("ous", "ive", "ful", "able", "ible", "ical", "ed")) and len(low) > 4:
            pos = "ADJ"
        else:
            pos = "NOUN"
        out.append(Token(w, pos))
    return out


def singular(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if len(w) > 4 and w.endswith(("sses", "shes", "ches", "xes")):
        return w[:-2]
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")) else w


def _names(token: str, m: Mission) -> bool:
    phrase = m.phrase_pattern()
    return bool(phrase and re.search(phrase, token, re.I)) or any((p := m.acronym_pattern(c)) and re.search(p, token, 0 if c else re.I) for c in (True, False))


def wordchunks(tokens: list[Token], mission: Mission) -> list[list[Token]]:
    """Runs of nouns, adjectives, numbers, possessives and slashes around each token that names the mission."""
    chunks, at = [], 0
    inner = ("NOUN", "ADJ", "NUM", "POSS")
    for i, t in enumerate(tokens):
        if i < at or not _names(t.text, mission):
            continue
        lo = hi = i
        while lo > 0 and (tokens[lo - 1].pos in inner or tokens[lo - 1].text == "/"):
            lo -= 1
        while hi + 1 < len(tokens) and (tokens[hi + 1].pos in inner or tokens[hi + 1].text == "/"):
            hi += 1
        chunks.append(tokens[lo : hi + 1])
        at = hi + 1
    return chunks


def meaning(tokens: list[Token], missions: tuple[Mission, ...] = MISSIONS) -> list[str]:
    """Each word's core: a mission's name (a hyphenated word as it is), 000 for a number, else the singular."""
    out = []
    for t in tokens:
        if t.pos in ("PUNCT", "POSS"):
            continue
        own = next((m for m in missions if _names(t.text, m)), None)
        if own:
            out.append(t.text.lower() if re.search(r"[^\w\s]|_", t.text) else own.name.lower())
        elif re.match(r"(ID)?\d+", t.text, re.I):
            out.append(NUMBER)
        else:
            out.append(singular(t.text))
    return out


def _compiled(missions: tuple[Mission, ...]) -> dict[str, list[tuple[re.Pattern, re.Pattern, bool]]]:
    """Per mission name, in order: a phrase's exact pattern, its meaning's pattern, its verdict."""
    names = [m.name.lower() for m in missions if m.ambiguous]
    out: dict[str, list] = {n: [] for n in names}
    for who, phrase, verdict in PHRASES:
        for name in names if who == "AnyMission" else [n for n in names if n == who.lower()]:
            own = phrase.replace("AnyMission", name)
            words = meaning([t._replace(pos="NOUN") if t.pos != "PUNCT" else t for t in annotate(own)], missions)
            spaced = r" (?:\w+ )*".join(rf"\b{re.escape(w)}\b" for w in words)
            out[name].append((re.compile(rf"\b{re.escape(own)}\b", re.I), re.compile(spaced, re.I), verdict))
    return out


def means_mission(sentence: str, mission: Mission, table: dict, missions: tuple[Mission, ...] = MISSIONS, annotator: Annotator = annotate) -> bool | None:
    """The verdict on a sentence that names the mission by an ambiguous word only; null if no phrase tells.

    Per chunk: it is the bare word: yes; it is one of the mission's other terms: yes; else the phrase with the shortest match,
    exact before meaning, decides. The sentence means the mission if any chunk does.
    """
    sentence = re.sub(r"-\b[0-9]+\b", f"-{NUMBER}", sentence)
    verdicts = []
    for chunk in wordchunks(annotator(sentence), mission):
        text = " ".join(t.text for t in chunk if t.pos != "POSS").lower()
        plain = [p.lower() for p in mission.phrases]
        if text in [a.lower() for a in mission.ambiguous] or text.replace(".", "") in [p.replace(".", "") for p in plain]:
            verdicts.append(True)
            continue
        core = " ".join(meaning(chunk, missions))
        rows = table.get(mission.name.lower(), [])
        for which in (0, 1):
            found = [(len(m[0]), i, r[2]) for i, r in enumerate(rows) if (m := r[which].search(core))]
            if found:
                verdicts.append(min(found)[2])
                break
    return any(verdicts) if verdicts else None


def true_match(sentence: str, mission: Mission, table: dict | None = None, annotator: Annotator = annotate) -> bool | None:
    """All rungs for one sentence, in Python; the table form is ``decide``."""
    table = table or _compiled(MISSIONS)
    masked = sentence
    for b in mission.banned:
        masked = re.sub(b, "#" * len(b), masked, flags=re.I)
    acronym = any((p := mission.acronym_pattern(c)) and re.search(p, masked, 0 if c else re.I) for c in (True, False))
    plain = [p for p in mission.phrases if p.lower() not in {a.lower() for a in mission.ambiguous}]
    if acronym or any(re.search(rf"\b{p}\b", masked, re.I) for p in plain):
        return True
    if not re.search(mission.phrase_pattern() or r"(?!)", masked, re.I):
        return False
    return means_mission(masked, mission, table, MISSIONS, annotator)


def spans(text: Column, mission: Mission) -> Column:
    """array<struct<lo, hi>> of every match of a mission's terms, ends inclusive, acronyms with their guards."""

    @F.pandas_udf("array<struct<lo:int,hi:int>>")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            for b in mission.banned:
                t = re.sub(b, "#" * len(b), t or "", flags=re.I)
            patterns = [(rf"\b{p}\b", re.I) for p in mission.phrases] + [(p, 0 if c else re.I) for c in (False, True) if (p := mission.acronym_pattern(c))]
            return [{"lo": m.start(), "hi": m.end() - 1} for p, f in patterns for m in re.finditer(p, t or "", f)]

        return s.map(one)

    return run(text)

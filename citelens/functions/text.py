"""Text functions as Columns: cleansing, sentences, mission matching, anonymising. Stock expressions only."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import MISSIONS, Mission

AUTHOR = "Authorsetal"
ANON = "OBJ"

# What counts as a citation, and what becomes of it: in brackets with its years; with its years in brackets;
# a name with "et al"; placeholders in a row.
CITES = [
    (r"[(\[{](?:(?:\b[A-Z]\. )*[A-Z][A-Za-z'`-]+)(?: (?:(?:and |& )(?:(?:\b[A-Z]\. )*[A-Z][A-Za-z'`-]+)|(?:et al\.?)))* (?:[0-9]{4}|[0-9]{2})(?:[,;] ?(?:[0-9]{4}|[0-9]{2}))*(?:[,;] (?:(?:\b[A-Z]\. )*[A-Z][A-Za-z'`-]+)(?: (?:(?:and |& )(?:(?:\b[A-Z]\. )*[A-Z][A-Za-z'`-]+)|(?:et al\.?)))* (?:[0-9]{4}|[0-9]{2})(?:[,;] ?(?:[0-9]{4}|[0-9]{2}))*)*[)\]}]", ""),
    (r"(?:(?:\b[A-Z]\. )*[A-Z][A-Za-z'`-]+)(?: (?:(?:and |& )(?:(?:\b[A-Z]\. )*[A-Z][A-Za-z'`-]+)|(?:et al\.?)))* [(\[{](?:[0-9]{4}|[0-9]{2})(?:[,;] ?(?:[0-9]{4}|[0-9]{2}))*[)\]}]", AUTHOR),
    (r"\b(?:[A-Z]\. )*(?:\b[A-Z][A-Z|a-z]+) et al\b\.?", AUTHOR),
    (r"Authorsetal(?:(?:,|;|,? and) +Authorsetal)+", AUTHOR),
]
# Marks and spaces to tidy, in this order.
CLEANSE = [
    (r"^[.,;:?!]", ""),
    (r" {2,}", " "),
    (r"([(\[{<]) ?", "$1"),
    (r" ?([)\]}>.,;:?!])", "$1"),
    (r" ?' ?", "'"),
    (r"[(\[{<](?=[)\]}>])|[.,;:?!](?=[.,;:?!])", ""),
    (r"\bet al\b\.", "et al"),
]
SENTENCE_ENDS = (r"(?<=.[.?!]) +(?=[(\[{<])", r"(?<=.[.?!][)\]}>]) +(?=[A-Z])", r"(?<=.[.?!]) +(?=[A-Z])")
EDGES = (r"^\s+|\s+$", "")
# The letters beyond ASCII that match an ASCII letter without regard to case, and those they match; the marks
# that may part an acronym's letters.
FOLDS = ("\u017f\u212a\u0131\u0130", "skii")
PARTING = ". -"


def _replace(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)


def cleanse(text: Column, citations: bool = False) -> Column:
    """White space and punctuation tidied, in this order: one leading mark, runs of spaces, spaces at brackets, marks and
    apostrophes, empty brackets and doubled marks, "et al."; with ``citations``, references to papers become a placeholder
    or go; then the edges are trimmed."""
    return _replace(text, [*CLEANSE, *(CITES if citations else []), EDGES])


def streamline(text: Column, citations: bool = True) -> Column:
    """``cleanse``, tags dropped, abbreviations spelt out, ``cleanse`` again."""
    text = _replace(cleanse(text, citations), [(r"<[A-Z|a-z|/]+>", ""), (r"\bFig\b\.", "Figure"), (r"\bTab\b\.", "Table"), (r"\bvs\b\.", "vs")])
    return cleanse(text, citations)


def sentences(text: Column) -> Column:
    """Sentences of each line; empty ones are kept."""
    parts = F.split(text, "\n")
    for pattern in SENTENCE_ENDS:
        parts = _split_each(parts, pattern)
    return parts


def _split_each(parts: Column, pattern: str) -> Column:
    return F.flatten(F.transform(parts, lambda p: F.split(p, pattern)))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _swapped(t: Column, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, t)


def _small(text: Column) -> Column:
    return F.lower(_swapped(text, zip(*FOLDS, strict=True)))


def _forms(v: Column) -> Column:
    tight = lambda t: _swapped(t, [(c, "") for c in PARTING])
    return F.struct(v["text"].alias("text"), v["small"].alias("small"), tight(v["text"]).alias("tight"), tight(v["small"]).alias("small_tight"))


def forms(text: Column) -> Column:
    """What the missions' patterns are tried on: the text, it in small letters, and either without the marks that may part
    an acronym's letters. Computed once for all missions."""
    return let(F.struct(text.alias("text"), _small(text).alias("small")), _forms)


def where_near(text: Column, missions: tuple[Mission, ...], f: Callable[[Column], Column], none: Column) -> Column:
    """f(``forms`` of the text) where the text may name one of the missions, else ``none``. One pattern, which every text that names
    one matches in small letters, spares most texts the trials of each mission."""
    near = _near_any(missions)
    return let(F.struct(text.alias("text"), _small(text).alias("small")), lambda v: F.when(v["small"].rlike(near), let(_forms(v), f)).otherwise(none))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def masked(text: Column, mission: Mission) -> Column:
    """The text with phrases that must not count for the mission blotted out."""
    for phrase in mission.banned:
        text = F.regexp_replace(text, f"(?i){phrase}", "#" * len(phrase))
    return text


def phrase_in(v: Column, mission: Mission) -> Column:
    """Whether the ``forms`` of a text hold a phrase of the mission. The pattern runs only on texts that hold the letters of
    a phrase, which every text that matches does. Null does not match."""
    short = [p for p in mission.phrases if not any(q != p and q.lower() in p.lower() for q in mission.phrases)]
    may = _any([F.contains(v["small"], F.lit(p.lower())) for p in short])
    return F.when(may, masked(v["text"], mission).rlike(f"(?iU){mission.phrase_pattern()}")).otherwise(False) if short else F.lit(False)


EDGE = ("(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])")


def _parted(word: str) -> str:
    return f"[{re.escape(PARTING)}]{{0,3}}".join(word)


def _near(words: list[str]) -> str:
    """What a text with one of these acronyms matches, by ASCII classes alone: many times cheaper than the pattern itself."""
    return EDGE[0] + "(?:" + "|".join(map(_parted, words)) + ")" + EDGE[1]


def _near_any(missions: tuple[Mission, ...]) -> str:
    """What a text in small letters that names one of the missions matches: their terms between ASCII word boundaries, by first letter.
    Without boundaries where a term has others or where blotting out banned phrases may make one."""
    edged, loose = {}, []
    for m in missions:
        for p, pattern in [(p.lower(), re.escape(p.lower())) for p in m.phrases] + [(w.lower(), _parted(w.lower())) for w in (*m.cased, *m.uncased)]:
            if m.banned or not (p.isascii() and p[0].isalnum() and p[-1].isalnum()):
                loose.append(pattern)
            else:
                edged.setdefault(p[0], set()).add(pattern[1:])
    by_letter = "|".join(f"{c}(?:{'|'.join(sorted(rest))})" for c, rest in sorted(edged.items()))
    return "|".join(([f"{EDGE[0]}(?:{by_letter}){EDGE[1]}"] if edged else []) + sorted(set(loose)))


def acronym_in(v: Column, mission: Mission) -> Column:
    """Whether the ``forms`` of a text hold an acronym of the mission; as ``phrase_in``, but letters parted by marks are in most
    texts ("with st"), so those that have them must also have an acronym between ASCII word boundaries."""
    out = []
    for words, form, tight, flags, cased in ((mission.cased, v["text"], v["tight"], "(?U)", True), (mission.uncased, v["small"], v["small_tight"], "(?iU)", False)):
        if words:
            spelt = [w if cased else w.lower() for w in words]
            may = _any([F.contains(tight, F.lit(w)) for w in spelt])
            may = may if mission.banned else may & form.rlike(_near(spelt))
            out.append(F.when(may, masked(v["text"], mission).rlike(flags + mission.acronym_pattern(cased))).otherwise(False))
    return _any(out)


def mention_in(v: Column, mission: Mission, mode: str | None = None) -> Column:
    """Whether the ``forms`` of a text name the mission, by a phrase ("keyword"), an acronym ("acronym") or either."""
    if mode not in (None, "keyword", "acronym"):
        raise ValueError(f"unknown mode {mode}")
    if mode:
        return phrase_in(v, mission) if mode == "keyword" else acronym_in(v, mission)
    return phrase_in(v, mission) | acronym_in(v, mission)


def has_phrase(text: Column, mission: Mission) -> Column:
    return let(forms(text), lambda v: phrase_in(v, mission))


def has_acronym(text: Column, mission: Mission) -> Column:
    return let(forms(text), lambda v: acronym_in(v, mission))


def mentions(text: Column, mission: Mission, mode: str | None = None) -> Column:
    """Whether the text names the mission, by a phrase ("keyword"), an acronym ("acronym") or either."""
    return let(forms(text), lambda v: mention_in(v, mission, mode))


def mentions_any(text: Column, missions: tuple[Mission, ...] = MISSIONS) -> Column:
    return where_near(text, missions, lambda v: _any([mention_in(v, m) for m in missions]), F.lit(False))


def pieces(text: Column, missions: tuple[Mission, ...]) -> Column:
    """The text cut at marks and line breaks that no term of these missions holds. A term lies within one piece, and what a
    pattern asks of its neighbours (not a dot before, not a letter after, a word's edge) a cut grants as such a mark does."""
    held = {c for m in missions for p in (*m.phrases, *m.banned) for c in p}
    marks = "".join(c for c in "\n\r,;:!?()\"" if c not in held)
    return F.split(text, f"[{re.escape(marks)}]+") if marks else F.array(text)


def missions_of(text: Column, missions: tuple[Mission, ...] = MISSIONS, mode: str | None = None) -> Column:
    """Labels of all missions a text names, in registry order; none of null. Tried piece by piece, so that a long text costs a pattern
    only where it holds a term's letters; one literal pattern each, so that none is compiled per row."""
    found = F.transform(pieces(text, missions), lambda p: where_near(p, missions, lambda v: F.array_compact(F.array(*[F.when(mention_in(v, m, mode), m.label) for m in missions])), F.array().cast("array<string>")))
    return let(F.array_distinct(F.flatten(found)), lambda f: F.filter(F.array(*[F.lit(m.label) for m in missions]), lambda m: F.array_contains(f, m)))


def first_mission(text: Column, missions: tuple[Mission, ...] = MISSIONS) -> Column:
    """Label of the first mission, in registry order, that the text names; null if none."""
    return where_near(text, missions, lambda v: F.coalesce(*[F.when(mention_in(v, m), m.label) for m in missions]), F.lit(None).cast("string"))


def anonymise(text: Column, mission: Mission, placeholder: str = ANON, named: Column | None = None) -> Column:
    """Every phrase and acronym of the mission gives way to the placeholder; long phrases first, banned ones are not spared.
    ``named``: whether the text has any, where that is known for all missions at once (``missions_of`` of ``unbanned`` ones)."""
    def replaced(text: Column) -> Column:
        for phrase in mission.phrases:
            text = F.regexp_replace(text, rf"(?iU)\b{phrase}\b", placeholder)
        for flags, pattern in (("(?U)", mission.acronym_pattern(True)), ("(?iU)", mission.acronym_pattern(False))):
            if pattern:
                text = F.regexp_replace(text, flags + pattern, f"$1{placeholder}$2")
        return text

    if named is not None:
        return F.when(named, replaced(text)).otherwise(text)
    return let(forms(text), lambda v: F.when(mention_in(v, unbanned(mission)), replaced(v["text"])).otherwise(v["text"]))


def unbanned(mission: Mission) -> Mission:
    """The mission with no phrase that must not count."""
    return replace(mission, banned=())


def importance(text: Column, missions: tuple[Mission, ...] = MISSIONS) -> Column:
    """Why a sentence matters: it names a mission, speaks in the first or third person, shows a figure or table, cites.
    Pronouns and figure terms are closed word lists."""
    flags = {
        "is_keyword": mentions_any(text, missions),
        "is_pron_1st": text.rlike(r"(?iU)\b(i|me|my|mine|myself|we|us|our|ours|ourselves)\b"),
        "is_pron_3rd": text.rlike(r"(?iU)\b(he|him|his|himself|she|her|hers|herself|they|them|their|theirs|themselves)\b"),
        "is_term_fig": text.rlike(r"(?iU)\b(figures?|fig|tables?|tab|plots?|images?|panels?|graphs?)\b"),
        "is_etal": text.rlike(r"(?U)\b[A-Z][A-Z|a-z]+etal\b|\bet al\b"),
    }
    every = reduce(lambda a, b: a | b, flags.values())
    return F.struct(*[v.alias(k) for k, v in flags.items()], every.alias("is_any"))


def searchable(title: Column, abstract: Column, body: Column) -> Column:
    """What evaluation searches: first title, abstract and body."""
    return F.concat_ws("; ", F.coalesce(F.get(title, 0), F.lit("")), F.coalesce(abstract, F.lit("")), F.coalesce(body, F.lit("")))


def fill_prompt(template: str, fields: dict[str, Column]) -> Column:
    """``{field}`` replaced by each field's value, empty where null; other braces stay."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def paper_fields(title: Column, abstract: Column, body: Column, missions: tuple[Mission, ...] = MISSIONS) -> dict[str, Column]:
    """A paper's fields for ``fill_prompt``, with ``missions``, all that are asked for, and ``kw_missions``, those that the text names."""
    text = searchable(title, abstract, body)
    return {"title": F.get(title, 0), "abstract": abstract, "body": body, "missions": F.lit(", ".join(m.label for m in missions)), "kw_missions": F.array_join(missions_of(text, missions), ", ")}


def fenced_json(text: Column) -> Column:
    """The first fenced block of JSON, or null."""
    found = F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1)
    return F.when(found != "", found)

"""Words of a sentence as a column, array<struct<text, pos>>, and what they mean: stock expressions.

Any tagger's words will do. The default, ``tagged``, knows closed word classes and endings; it is an approximation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nlp import CLASSES, IRREGULAR, NUMBER
from .registry import MISSIONS, Mission
from .text import first_mission, let

# Fixed value: a word (letters and digits, possibly joined by a hyphen, minus, slash or dot), a possessive, or any other mark.
WORD = r"[^\W_]+(?:[-−/.][^\W_]+)*|'s\b|\S"
ENDINGS = ("ous", "ive", "ful", "able", "ible", "ical", "ed")


def _pos(word: Column, low: Column) -> Column:
    out = F.when(low == "'s", "POSS").when(~word.rlike(r"[\p{L}\p{N}]"), "PUNCT").when(word.rlike(r"(?i)^(?:ID)?\p{Nd}"), "NUM")
    for name in CLASSES:
        # a word of two classes is of the later one
        own = [w for w in CLASSES[name].split() if next(c for c in reversed(CLASSES) if w in CLASSES[c].split()) == name]
        out = out.when(low.isin(own), name)
    return out.when(low.endswith("ly") & (F.length(low) > 4), "ADV").when(low.rlike(f"(?:{'|'.join(ENDINGS)})$") & (F.length(low) > 4), "ADJ").otherwise("NOUN")


def tagged(sentence: Column) -> Column:
    """The default words of a sentence; null has none."""
    found = F.regexp_extract_all(sentence, F.lit(f"(?U)({WORD})"), F.lit(1))
    return F.coalesce(F.transform(found, lambda w: F.struct(w.alias("text"), _pos(w, F.lower(w)).alias("pos"))), F.array().cast("array<struct<text:string,pos:string>>"))


def singular(word: Column) -> Column:
    """A noun's singular in small letters, by endings and a list of irregular ones."""
    def of(w: Column) -> Column:
        cut = lambda k: F.substring(w, F.lit(1), F.length(w) - k)
        irregular = F.element_at(F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair]), w)
        long = F.length(w) > 4
        other = F.when(long & w.endswith("ies"), F.concat(cut(3), F.lit("y"))).when(long & w.rlike("(?:sses|shes|ches|xes)$"), cut(2))
        return F.coalesce(irregular, other.when((F.length(w) > 3) & w.endswith("s") & ~w.rlike("(?:ss|us|is)$"), cut(1)).otherwise(w))

    return let(F.lower(word), of)


def names_mission(word: Column, missions: tuple[Mission, ...]) -> Column:
    """Label of the first of these missions that a single word names, or null."""
    return first_mission(word, missions)


def core(word: Column, missions: tuple[Mission, ...] = MISSIONS) -> Column:
    """What stands for a word whatever a lexicon says: a mission's name in small letters (the word itself if it has a mark in
    it), 000 for a number; null for other words."""
    name = F.element_at(F.create_map(*[F.lit(x) for m in missions for x in (m.label, m.name.lower())]), names_mission(word, missions))
    return F.when(name.isNotNull(), F.when(word.rlike(r"(?U)[^\w\s]|_"), F.lower(word)).otherwise(name)).when(word.rlike(r"(?i)^(?:ID)?\p{Nd}+"), F.lit(NUMBER))

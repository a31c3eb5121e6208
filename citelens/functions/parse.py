"""Grammar over a dependency parse, as expressions on a column array<struct<text, pos, tag, dep, head>>: one element per word, labels
of the universal parts of speech, the treebank and its dependencies, ``head`` the place of the governing word (the root's own).

Any parser's output will do. Walks to ancestors are pointer doublings over the array, so a sentence of n words takes n log n
steps whatever its shape; heads that form a circle or point outside end there. A null parse has no words. Functions add a
column step by step, as one expression for all of it would be too deep to analyse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grammar import LABELS, TENSES
from .text import let

PARSE = "array<struct<text:string,pos:string,tag:string,dep:string,head:int>>"
KINDS = ("ROOT", "VERB", "USELESS", "SUBJECT", "PREPOSITION", "BASE_OBJECT", "DIRECT_OBJECT", "PREPOSITION_OBJECT", "PREPOSITION_SUBJECT", "MARKER", "X", "CONJOINED",
         "DETERMINANT", "AUX", "NOUN", "PRONOUN", "ADJECTIVE", "CONJUNCTION", "PASSIVE", "NEGATIVE", "PUNCTUATION", "BRACKET", "POSSESSIVE", "NUMBER")
# The classes that a word's main one is looked for among, in this order.
MAIN = ("SUBJECT", "PREPOSITION_SUBJECT", "VERB", "DIRECT_OBJECT", "PREPOSITION", "PREPOSITION_OBJECT", "AUX")

Matters = Callable[[Column], Column]


# A word's labels as bits of one number: those of KINDS, in this order, then labels that classes are made of. Labels given here
# set a bit by themselves; a class told by a label alone is such a bit too.
_LABELS = [("determinant", "tag"), ("noun", "pos"), ("aux", "pos"), ("aux", "dep"), ("preposition", "tag"), ("preposition", "pos"), ("preposition", "dep"), ("adjective", "tag"), ("adjective", "pos"),
           ("adjective", "dep"), ("verb", "tag"), ("verb", "dep"), ("ccomp", "dep"), ("object", "dep"), ("conjoined", "dep"), ("appos", "dep"), ("number", "tag"), ("determinant", "pos"), ("marker", "dep"),
           ("marker", "tag"), ("useless", "tag"), ("useless", "dep"), ("useless", "pos"), ("subject", "dep"), ("conjunction", "pos"), ("conjunction", "tag"), ("punctuation", "dep")]
_ALONE = {"X": [("x", "dep"), ("x", "pos")], "PRONOUN": [("pronoun", "tag"), ("pronoun", "pos")], "PASSIVE": [("passive", "dep")], "NEGATIVE": [("negative", "dep")],
          "BRACKET": [("bracket", "tag")], "POSSESSIVE": [("possessive", "tag")], "NUMBER": [("number", "pos")]}
_BIT = {k: 1 << n for n, k in enumerate((*KINDS, *_LABELS, "tensed", "VERB pos"))}


def _marks() -> dict[str, dict[str, int]]:
    """Per field the bits of each label."""
    sets = [(field, LABELS[name][field], _BIT[name, field]) for name, field in _LABELS] + [(field, LABELS[name][field], _BIT[k]) for k, of in _ALONE.items() for name, field in of]
    sets += [("dep", {"ROOT"}, _BIT["ROOT"]), ("tag", set().union(*TENSES.values()), _BIT["tensed"]), ("pos", {"VERB"}, _BIT["VERB pos"])]
    out: dict[str, dict[str, int]] = {"pos": {}, "tag": {}, "dep": {}}
    for field, labels, bit in sets:
        for label in sorted(labels):
            out[field][label] = out[field].get(label, 0) | bit
    return out


def _mask(*names) -> int:
    return sum(_BIT[n] for n in names)


def _any(bits: Column, *names) -> Column:
    return bits.bitwiseAND(F.lit(_mask(*names)).cast("long")) != 0


def _all(bits: Column, *names, but: tuple = ()) -> Column:
    """All of these bits, and none of ``but``."""
    return bits.bitwiseAND(F.lit(_mask(*names, *but)).cast("long")) == _mask(*names)


def _set(bits: Column, kinds: dict[str, Column]) -> Column:
    for k, holds in kinds.items():
        bits = bits.bitwiseOR(F.when(holds, F.lit(_BIT[k]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def _names(bits: Column) -> Column:
    """The classes of KINDS whose bits are set, looked up four at a time."""
    of = lambda n, v: F.array(*[F.lit(k) for j, k in enumerate(KINDS[n : n + 4]) if v >> j & 1]).cast("array<string>")
    return F.concat(*[F.get(F.array(*[of(n, v) for v in range(16)]), F.shiftright(bits, n).bitwiseAND(F.lit(15).cast("long")).cast("int")) for n in range(0, len(KINDS), 4)])


def fixpoint(pointers: Column) -> Column:
    """Where following an array of pointers ends, for each element."""
    doublings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(pointers) + 1)).cast("int"))
    return F.aggregate(doublings, pointers, lambda at, _: F.transform(at, lambda x: F.get(at, x)))


def _local(parse: Column) -> Column:
    """Labels of the word alone, as ``bits``."""
    known = F.coalesce(parse, F.array().cast(PARSE))
    marks = {field: F.create_map(*[x for label, bits in of.items() for x in (F.lit(label), F.lit(bits).cast("long"))]) for field, of in _marks().items()}
    det = ("determinant", "tag")

    def classed(b: Column) -> Column:
        aux, prep = [("aux", "dep"), ("aux", "pos")], ("preposition", "tag")
        return _set(b, {
            "NOUN": _all(b, ("noun", "pos"), but=(det,)), "BASE_OBJECT": _all(b, ("noun", "pos"), ("object", "dep"), but=(det,)),
            "ADJECTIVE": _any(b, ("adjective", "tag"), ("adjective", "pos")) | _all(b, ("adjective", "dep"), "VERB pos", ("verb", "tag")),
            "CONJOINED": _any(b, ("conjoined", "dep"), ("appos", "dep")) & ~_any(b, det), "PREPOSITION": _all(b, ("preposition", "dep"), ("preposition", "pos"), prep) | _all(b, *aux, prep),
            "AUX": _all(b, *aux, "tensed", but=(prep, ("number", "tag"))), "DETERMINANT": _all(b, ("determinant", "pos"), det), "CONJUNCTION": _all(b, ("conjunction", "pos"), ("conjunction", "tag")),
        })

    def one(w: Column, i: Column, n: Column) -> Column:
        labels = [F.coalesce(F.element_at(marks[x], w[x]), F.lit(0).cast("long")) for x in ("pos", "tag", "dep")]
        head = F.when(w["head"].between(0, n), w["head"]).otherwise(i).cast("int")
        plain = [F.coalesce(w[x], F.lit("")).alias(x) for x in ("pos", "tag", "dep")]
        return F.struct(w["text"].alias("text"), *plain, head.alias("head"), i.alias("i"), let(labels[0].bitwiseOR(labels[1]).bitwiseOR(labels[2]), classed).alias("bits"))

    return let(F.struct(known.alias("k"), (F.size(known) - 1).alias("n")), lambda k: F.transform(k["k"], lambda w, i: one(w, i, k["n"])))


def _stepwise(df: DataFrame, name: str, first: Column, steps: list[Callable[[Column], Column]]) -> DataFrame:
    df = df.withColumn(name, first)
    for step in steps:
        df = df.withColumn(name, let(F.col(name), step))
    return df


def words(df: DataFrame, parse: Column, name: str = "words", matters: Matters = lambda text: F.lit(False)) -> DataFrame:
    """Adds ``name``, the words with ``kinds``, an array of the word classes (KINDS) each belongs to, ``origin``, the place of the first word of the
    chain of conjuncts it is in (its own if it is in none), and the labels that other functions here use. A conjunct is what
    the first of its chain is. ``matters``: whether a word's text is important, and so never useless."""
    at = lambda ws, i: F.get(ws, i)
    is_ = lambda w, *names: _any(w["bits"], *names)
    # What later steps find is kept in arrays of its own beside the words ``ws``, so that no step copies these.
    with_ = lambda t, known, **new: F.struct(*[t[k].alias(k) for k in known], *[v.alias(k) for k, v in new.items()])

    def of_origin(t: Column, flags: Column, w: Column) -> Column:
        """The flag of the first word of a conjunct's chain; false where there is none."""
        first = F.get(t["o"], w["i"])
        return is_(w, "CONJOINED") & ~is_(at(t["ws"], first), "CONJOINED") & F.get(flags, first)

    def origins(ws: Column) -> Column:
        return F.struct(ws.alias("ws"), fixpoint(F.transform(ws, lambda w: F.when(is_(w, "CONJOINED"), w["head"]).otherwise(w["i"]))).alias("o"))

    def verbs(t: Column) -> Column:
        ws = t["ws"]

        def own(w: Column) -> Column:
            head = at(ws, w["head"])
            lefts = F.exists(ws, lambda o: (o["head"] == w["i"]) & (o["i"] < w["i"]))
            modifier = is_(w, ("adjective", "dep")) & (w["head"] != w["i"]) & _all(head["bits"], "ROOT", "NOUN") & lefts  # "calibrated" in "Hubble calibrated data"
            return is_(w, ("verb", "tag")) & (is_(w, ("verb", "dep"), ("ccomp", "dep"), "ROOT") | modifier)

        both = lambda d: F.transform(ws, lambda w: F.get(d, w["i"]) | (is_(w, ("verb", "tag")) & of_origin(t, d, w)))
        return with_(t, ["ws", "o"], v=let(F.transform(ws, own), both))

    def subjects(t: Column) -> Column:
        ws = t["ws"]

        def own(w: Column) -> Column:
            left = (w["i"] < w["head"]) & F.get(t["v"], w["head"])
            return (_all(w["bits"], "NOUN", "ROOT") | (is_(w, ("subject", "dep"), "NOUN", "ADJECTIVE") & left)) & ~is_(w, "BASE_OBJECT")

        both = lambda d: F.transform(ws, lambda w: F.get(d, w["i"]) | (of_origin(t, d, w) & ~is_(w, "BASE_OBJECT")))
        return with_(t, ["ws", "o", "v"], s=let(F.transform(ws, own), both))

    def objects(t: Column) -> Column:
        """By the nearest preposition or verb above, as bits."""
        ws = t["ws"]
        stops = F.transform(ws, lambda w: F.when(is_(w, "PREPOSITION") | F.get(t["v"], w["i"]), w["i"]).otherwise(w["head"]))
        bit = lambda k: F.lit(_BIT[k]).cast("long")

        def own(w: Column, end: Column) -> Column:
            above = F.get(end, w["head"])
            prep = let(at(ws, above), lambda a: F.when(is_(a, "PREPOSITION"), F.when(F.get(t["s"], a["head"]), bit("PREPOSITION_SUBJECT")).otherwise(bit("PREPOSITION_OBJECT"))))
            found = F.coalesce(prep, F.when(F.get(t["v"], above), bit("DIRECT_OBJECT")), F.lit(0).cast("long"))
            return F.when(is_(w, "BASE_OBJECT") & (w["head"] != w["i"]), found).otherwise(F.lit(0).cast("long"))

        direct = let(fixpoint(stops), lambda end: F.transform(ws, lambda w: own(w, end)))
        both = lambda d: F.transform(ws, lambda w: F.get(d, w["i"]).bitwiseOR(F.when(is_(w, "CONJOINED"), F.get(d, F.get(t["o"], w["i"]))).otherwise(F.lit(0).cast("long"))))
        return with_(t, ["ws", "o", "v", "s"], d=let(direct, both))

    def kinds(t: Column) -> Column:
        ws = t["ws"]

        def one(w: Column) -> Column:
            below_root = (w["head"] != w["i"]) & is_(at(ws, w["head"]), "ROOT")
            verb, subject = F.get(t["v"], w["i"]), F.get(t["s"], w["i"])
            bits = _set(w["bits"].bitwiseOR(F.get(t["d"], w["i"])), {
                "VERB": verb, "SUBJECT": subject,
                "USELESS": _all(w["bits"], *[("useless", x) for x in ("tag", "dep", "pos")], but=("NEGATIVE", "ROOT")) & ~subject & ~F.coalesce(matters(w["text"]), F.lit(False)),
                "MARKER": (is_(w, ("marker", "dep"), ("marker", "tag")) | (is_(w, "DETERMINANT") & subject & (w["head"] != w["i"]))) & ~below_root,
                "PUNCTUATION": is_(w, ("punctuation", "dep")) & ~F.coalesce(w["text"].rlike(r"(?i)[a-z|0-9]"), F.lit(False)),
            })
            plain = [w[x].alias(x) for x in ("text", "pos", "tag", "dep", "head", "i")]
            return F.struct(*plain, is_(w, "ROOT").alias("root"), is_(w, "CONJOINED").alias("conj"), F.get(t["o"], w["i"]).alias("origin"), let(bits, _names).alias("kinds"))

        return F.transform(ws, one)

    return _stepwise(df, name, _local(parse), [origins, verbs, subjects, objects, kinds])


def chunk_ids(ws: Column, noun_chunks: Column) -> Column:
    """array<int> of the id of each word's chunk: 0 for the root, k + 1 for the words of the k-th noun chunk, null for useless words
    and words of none. ``noun_chunks``: array<struct<first, last>> of places, as a parser finds them."""
    last = lambda i: F.array_max(F.transform(noun_chunks, lambda c, k: F.when(i.between(c["first"], c["last"]), -k)))
    return F.transform(ws, lambda w: F.when(w["root"], 0).when(~F.array_contains(w["kinds"], "USELESS"), 1 - last(w["i"])).cast("int"))


def tree(df: DataFrame, matters: Matters, chunks: Column | None = None, words: str = "words", name: str = "tree") -> DataFrame:
    """Adds ``name``, struct<words, verbs>, to rows with classified ``words``.

    words: i, text, main (the first of MAIN that it or the first of its chain is), chunk, important (its chunk is, or it is a verb
    with something important under it), useless, verb (the nearest verb or root at or above it), above (all verbs and roots above
    it, nearest first), trail (the head of the clause it belongs to: the nearest word at or above whose main class is VERB), outer (of such a head, the
    head of the clause around it), mark (whether it is punctuation).
    verbs: i, text, tense (its auxiliaries' may supersede its own), passive, purpose, important, below (verbs and roots under it).
    ``chunks``: array<int> of ids as ``chunk_ids`` gives; a chunk is as important as all its words together, and a verb within
    it, under its topmost word, opens no clause. By default each word is its own chunk."""
    # Bound once and kept with the words: a column named within a lambda would be computed for each word.
    if chunks is None:
        first = F.transform(words, lambda w: w.withField("chunk", F.lit(None).cast("int")))
    else:
        first = let(F.struct(F.col(words).alias("ws"), chunks.alias("ids")), lambda b: F.transform(b["ws"], lambda w: w.withField("chunk", F.get(b["ids"], w["i"]))))

    def main(ws: Column) -> Column:
        def one(w: Column) -> Column:
            has = lambda k: F.array_contains(w["kinds"], k)
            first = lambda k: F.coalesce(w["conj"] & F.array_contains(F.get(ws, w["origin"])["kinds"], k), F.lit(False)) if k != "AUX" else F.lit(False)
            return F.coalesce(*[F.when(has(k) | first(k), k) for k in MAIN])

        return F.transform(ws, lambda w: w.withField("main", one(w)))

    def chunked(ws: Column) -> Column:
        """The topmost word of a chunk is the one whose head lies outside it."""
        own = lambda w: F.filter(ws, lambda o: o["chunk"] == w["chunk"])
        text = lambda w: F.when(w["chunk"].isNull(), w["text"]).otherwise(F.replace(F.array_join(F.transform(own(w), lambda o: o["text"]), " "), F.lit(" - "), F.lit("-")))
        inner = lambda w: (w["head"] != w["i"]) & F.coalesce(F.get(ws, w["head"])["chunk"] == w["chunk"], F.lit(False))
        return F.transform(ws, lambda w: w.withField("important", F.coalesce(matters(text(w)), F.lit(False))).withField("inner", inner(w)))

    def governed(ws: Column) -> Column:
        verb = lambda w: (F.array_contains(w["kinds"], "VERB") | w["root"]) & ~w["inner"]
        head = lambda w: (w["main"] == "VERB") & ~w["inner"]
        ends = lambda stop: fixpoint(F.transform(ws, lambda w: F.when(F.coalesce(stop(w), F.lit(False)), w["i"]).otherwise(w["head"])))
        stops = lambda e, stop, w: F.when(F.coalesce(stop(F.get(ws, F.get(e, w["i"]))), F.lit(False)), F.get(e, w["i"]))
        return let(F.struct(ends(verb).alias("v"), ends(head).alias("h")), lambda e: F.transform(ws, lambda w: w.withField("verb_at", stops(e["v"], verb, w)).withField("trail", stops(e["h"], head, w))))

    def lifted(ws: Column) -> Column:
        """A verb is important if a word is whose verb it is. The verbs above: paths from verb to verb, doubled until they end."""
        under = lambda w: F.exists(ws, lambda o: (o["verb_at"] == w["i"]) & o["important"])
        step = lambda w: F.when((w["verb_at"] == w["i"]) & (w["head"] != w["i"]), F.get(ws, w["head"])["verb_at"]).otherwise(F.when(w["verb_at"] != w["i"], w["verb_at"]))
        first = F.transform(ws, lambda w: F.struct(F.array_compact(F.array(step(w))).alias("out"), step(w).alias("end")))
        longer = lambda ps: F.transform(ps, lambda p: F.when(p["end"].isNull(), p).otherwise(F.struct(F.concat(p["out"], F.get(ps, p["end"])["out"]).alias("out"), F.get(ps, p["end"])["end"].alias("end"))))
        paths = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(ws) + 1)).cast("int")), first, lambda ps, _: longer(ps))
        own = lambda w: (w["verb_at"] == w["i"]) & under(w)
        return let(paths, lambda ps: F.transform(ws, lambda w: w.withField("important", w["important"] | F.coalesce(own(w), F.lit(False))).withField("above", F.array_distinct(F.get(ps, w["i"])["out"]))))

    def nested(ws: Column) -> Column:
        """Of a clause's head, the head of the clause around it."""
        return let(F.transform(ws, lambda w: w["trail"]), lambda ts: F.transform(ws, lambda w: w.withField("outer", F.when(w["trail"] == w["i"], F.get(ts, F.get(w["above"], 0))))))

    def tables(ws: Column) -> Column:
        is_ = lambda w, k: F.array_contains(w["kinds"], k)
        listed = F.transform(ws, lambda w: F.struct(w["i"].alias("i"), w["text"].alias("text"), w["main"].alias("main"), w["chunk"].alias("chunk"), w["important"].alias("important"), is_(w, "USELESS").alias("useless"), w["verb_at"].alias("verb"), w["above"].alias("above"), w["trail"].alias("trail"), w["outer"].alias("outer"), is_(w, "PUNCTUATION").alias("mark")))
        verbs = F.filter(ws, lambda w: w["verb_at"] == w["i"])

        def verb(v: Column) -> Column:
            own = F.filter(ws, lambda o: (o["verb_at"] == v["i"]) & (o["main"] == "AUX"))
            helps = lambda name: F.exists(own, lambda o: o["tag"].isin(sorted(TENSES[name])))
            finite = is_(v, "VERB")
            bare = {n: finite & v["tag"].isin(sorted(TENSES[n])) for n in ("past", "present", "future")}
            late, none = bare["present"] | ~finite, ~finite
            tense = F.when(bare["future"] | helps("future"), "future").when(bare["past"] | (late & helps("past")), "past").when(bare["present"] | (none & helps("present")), "present")
            below = F.transform(F.filter(verbs, lambda o: F.array_contains(o["above"], v["i"])), lambda o: o["i"])
            return F.struct(v["i"].alias("i"), v["text"].alias("text"), tense.alias("tense"), F.exists(own, lambda o: is_(o, "PASSIVE")).alias("passive"), helps("purpose").alias("purpose"), v["important"].alias("important"), below.alias("below"))

        return F.struct(listed.alias("words"), F.transform(verbs, verb).alias("verbs"))

    return _stepwise(df, name, first, [main, chunked, governed, lifted, nested, tables])


def thinned(df: DataFrame, parse: Column, name: str, matters: Matters, steps: set[str], chunks: Column | None = None) -> DataFrame:
    """Adds ``name``, the text of the words that "skim" (no useless words) and "trim" (no clause without anything important) leave.

    A clause is a word whose main class is VERB with the words that follow it up to further such words, and these themselves; so a
    clause around an important one stays. A last mark of punctuation stays as well."""
    def kept(t: Column) -> Column:
        ws = t["words"]
        clause = lambda h: F.filter(ws, lambda o: (o["trail"] == h) | (o["outer"] == h))
        dull = F.filter(F.array_distinct(F.array_compact(F.transform(ws, lambda w: w["trail"]))), lambda h: ~F.exists(clause(h), lambda o: o["important"]))
        gone = F.flatten(F.transform(dull, lambda h: F.transform(clause(h), lambda o: o["i"])))
        last = F.size(ws) - 1
        out = let(gone, lambda g: F.filter(ws, lambda w: ~F.array_contains(g, w["i"]) | ((w["i"] == last) & w["mark"]))) if "trim" in steps else ws
        out = F.filter(out, lambda w: ~w["useless"]) if "skim" in steps else out
        return joined(F.transform(out, lambda w: w["text"]))

    seen = tree(words(df, parse, "__words", matters), matters, chunks, "__words", "__tree")
    return seen.withColumn(name, F.when(parse.isNotNull(), let(F.col("__tree"), kept))).drop("__words", "__tree")


def joined(texts: Column) -> Column:
    """Words as a text: none but words first, no space before marks, after opening brackets or before a possessive."""
    text = F.regexp_replace(F.array_join(texts, " "), r" ([.,;:?!)\]}])", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"([(\[{]) ", "$1"), r" ?('s)", "$1")
    return F.regexp_replace(text, r"^(?:[,;]\s*)+", "")

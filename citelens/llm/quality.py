"""Quality rules as weak supervision.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of vote patterns (a few
hundred at most, whatever the corpus) estimates each rule's accuracy on good and on bad documents; a document's posterior
probability of being good then decides, in place of "passes every rule".
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [*BASE, "n_lines", "n_upper_words", "n_distinct_words"]


def features_of(text: str | None) -> tuple[int, ...]:
    """FEATURES of a whole text; words are runs of bytes that are not ASCII white space."""
    if not text:
        return (0,) * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits at exactly x09-x0D and x20
    n = len(words)
    chars = len(text) - sum(map(text.count, "\t\n\x0b\x0c\r "))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeated = 0
    if n >= 3:
        pair = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)[1] if len(ids) > 1_000_000 else seq[:-1] * len(ids) + seq[1:]
        _, at, counts = np.unique(pair[:-1] * len(ids) + seq[2:], return_inverse=True, return_counts=True)
        again = counts[at] > 1
        covered = np.zeros(n, bool)
        covered[:-2] |= again
        covered[1:-1] |= again
        covered[2:] |= again
        repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), sum(w.isupper() for w in words), len(ids)


def with_features(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns of ``df``) followed by FEATURES, in one narrow pass."""
    keep = df.columns if keep is None else keep
    names = [f"c{i}" for i in range(len(keep))]  # any column names, even ones that clash with FEATURES
    inner = df.select(F.col(f"`{text_col}`").cast("string").alias("__text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)])
    kinds = [f"{n} {inner.schema[n].dataType.simpleString()}" for n in names]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([features_of(t) for t in batch.column(0).to_pylist()], np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(found[:, i]) for i in range(len(FEATURES))]], names=[*names, *[f"__{f}" for f in FEATURES]])

    out = map_rows(inner, run, ", ".join([*kinds, *[f"__{c} long" for c in FEATURES]]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *[f"__{f}" for f in FEATURES])


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(f"__{a}").cast("double"), F.col(f"__{b}")), F.lit(0.0))


def rules() -> dict[str, Column]:
    """Votes: 1 good, 0 bad, null abstains. Thresholds are of the usual kind for web text. Rules that look for a defect
    abstain where they find none; rules on shape can vote either way."""

    def vote(bad: Column, good: Column | None = None) -> Column:
        return F.when(bad, 0) if good is None else F.when(bad, 0).when(good, 1)

    chars, variety = _share("word_chars", "n_words"), _share("n_distinct_words", "n_words")
    return {
        "length": vote(F.col("__n_words") < 50, F.col("__n_words") >= 80),
        "word_length": vote((chars < 2.5) | (chars > 14), (chars >= 3) & (chars <= 10)),
        "symbols_per_word": vote(_share("n_symbols", "n_words") > 0.15, F.col("__n_symbols") == 0),
        "symbol_chars": vote(_share("n_symbols", "word_chars") > 0.03),
        "lines": vote((_share("n_dup_lines", "n_lines") > 0.3) & (F.col("__n_dup_lines") >= 3)),
        "repeats": vote(_share("n_repeat_words", "n_words") > 0.3),
        "capitals": vote(_share("n_upper_words", "n_words") > 0.4),
        "variety": vote(variety < 0.15, variety > 0.4),
    }


def fit(patterns: list[tuple[list[int | None], int]], steps: int = 200) -> tuple[float, np.ndarray]:
    """EM for a two-class naive model over (votes, count) rows: the prior of good and, as [rule, class (bad, good), vote
    (bad, good, abstain)], the chance of each vote, from which a rule's accuracy on either class follows. It starts from
    "good if no rule objects"; a rule's objection never counts in favour, nor its approval against. No rows: uniform."""
    k = len(patterns[0][0]) if patterns else len(rules())
    chance = np.full((k, 2, 3), 1 / 3)
    if not patterns:
        return 0.5, chance
    votes = np.array([[2 if v is None else v for v in p] for p, _ in patterns])
    counts = np.array([c for _, c in patterns], float)
    onehot = (votes[:, :, None] == np.arange(3)).astype(float)
    post, prior = np.where((votes == 0).any(1), 0.2, 0.95), 0.8
    for _ in range(steps):
        weight = np.stack([counts * (1 - post), counts * post])
        now = (np.einsum("cp,pkv->kcv", weight, onehot) + 0.5) / (weight.sum(1)[None, :, None] + 1.5)
        now[:, 0, 0], now[:, 1, 1] = now[:, :, 0].max(1), now[:, :, 1].max(1)
        prior = float(np.clip(weight[1].sum() / counts.sum(), 0.05, 0.95))
        done = np.abs(now - chance).max() < 1e-8
        chance = now
        z = math.log(prior / (1 - prior)) + np.einsum("pkv,kv->p", onehot, np.log(chance[:, 1] / chance[:, 0]))
        post = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        if done:
            break
    return prior, chance


def quality_rules(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``keep`` columns of every row and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    quality (posterior probability), kept.

    A null or empty text has no words, so base_failed. Repeated rows stay repeated. Texts of any length are read whole.
    Two narrow passes over the texts and one shuffle of pattern counts (at most 3^rules rows reach the driver); an empty
    table gives an empty result. A column of ``keep`` named like a result column is replaced by it.
    """
    votes = rules()
    seen = with_features(df, text_col, []).select(*[v.alias(k) for k, v in votes.items()]).groupBy(*votes).count().collect()
    prior, chance = fit(sorted(([[r[k] for k in votes], r["count"]] for r in seen), key=str))
    z = F.lit(math.log(prior / (1 - prior)))
    for w, v in zip(np.log(chance[:, 1] / chance[:, 0]), votes.values(), strict=True):
        z = z + F.when(v == 0, float(w[0])).when(v == 1, float(w[1])).otherwise(float(w[2]))
    results = {f: F.col(f"__{f}") for f in BASE}
    results["base_failed"] = (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))
    results["quality"] = 1 / (1 + F.exp(-z))
    results["kept"] = ~results["base_failed"] & (results["quality"] >= threshold)
    out = with_features(df, text_col, keep)
    return out.select(*[c for c in out.columns if c not in results and not (c.startswith("__") and c[2:] in FEATURES)], *[v.alias(k) for k, v in results.items()])

"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. Every window of a text (four words) is
compressed with the ordinary dictionary alone and with the toxic one beside it; what the toxic one saves, in bytes, is the
window's distance. Counts of windows by distance, calibrated by a logistic model on labelled texts kept apart from those
that trained the dictionaries, give the score.

Toxic text is mostly ordinary words, which say nothing. So the toxic dictionary is trained in rounds: each half of the toxic
texts trains one, which compresses the other half, and only windows that it saved some bytes on train the next. What a
window shares with toxic texts in general stays; what it has of its own, or shares with ordinary text, goes.

What makes such small differences exact:
* both sides hold the ordinary dictionary at the same offsets; before it, farther from the window, lies the toxic one or
  filler of its length, so a window that gains nothing from toxic text compresses alike;
* every window ends in a tail that both sides hold, since zstandard starts no match within a block's last bytes
  and stores a block raw if it saves under two bytes.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of, discard, map_rows, materialise

TAIL = bytes(range(128, 176))
EDGES = b".,!?;:|*#$%&\"'()[]"
BINS = 8


@dataclass
class Model:
    """Picklable; ``ordinary`` and ``toxic`` are the contents of the two trained dictionaries."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)
    window: int = 4
    level: int = 6


def windows(text: str | None, size: int) -> list[bytes]:
    """All words of a text, lower-cased and stripped of edge punctuation, in windows of ``size``."""
    words = [w for w in (w.strip(EDGES) for w in (text or "").lower().encode("utf-8", "replace").split()) if w]
    return [b" ".join(words[i : i + size]) for i in range(0, len(words), size)]


class Distance:
    """Bytes that the toxic dictionary saves on each of some windows."""

    def __init__(self, toxic: bytes, ordinary: bytes, level: int) -> None:
        of = lambda raw: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw + ordinary + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        self.without, self.beside = of(b"\1" * len(toxic)), of(toxic)

    def __call__(self, found: list[bytes]) -> np.ndarray:
        out = np.zeros(len(found), np.int64)
        for at in range(0, len(found), 50_000):  # bounds the buffers
            padded = [b" " + w + b" " + TAIL for w in found[at : at + 50_000]]
            a, b = self.without.multi_compress_to_buffer(padded), self.beside.multi_compress_to_buffer(padded)
            out[at : at + len(padded)] = [len(a[i]) - len(b[i]) for i in range(len(padded))]
        return out


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.distance = Distance(model.toxic, model.ordinary, model.level) if model.weights else None

    def features(self, text: str | None) -> np.ndarray:
        """Logarithms of the number of windows at each distance, the share of windows at any, the mean distance, and the
        logarithm of all windows, as a long text meets small distances by chance."""
        found = windows(text, self.model.window)
        if not found:
            return np.zeros(BINS + 3)
        saved = self.distance(found)
        counts = np.bincount(np.clip(saved, 0, BINS), minlength=BINS + 1)[1:]
        return np.r_[np.log1p(counts), counts.sum() / len(found), saved.sum() / len(found), math.log1p(len(found))]

    def score(self, text: str | None) -> float:
        if not self.model.weights:
            return 0.0
        z = float(self.model.weights[0] + np.dot(self.model.weights[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _distinct_enough(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without near copies: a text of which a fifth of the 5-word runs was seen before is left out of the fit. An eighth of the
    runs, by hash, stands for all, which keeps the driver's memory small."""
    seen: set[int] = set()
    kept = []
    for text, label in rows:
        w = text.lower().split()
        runs = {h for i in range(max(1, len(w) - 4)) if not (h := zlib.crc32(" ".join(w[i : i + 5]).encode("utf-8", "replace"))) % 8}
        if not runs or len(runs & seen) < 0.2 * len(runs):
            kept.append((text, label))
        seen |= runs
    return kept


def _train(samples: list[bytes], size: int, k: int, d: int = 6) -> bytes:
    """The content of a dictionary that zstandard trains on samples, without its header and entropy tables; with too little
    text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()[200:]
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _spread(found: list[bytes], most: int) -> list[bytes]:
    """At most ``most`` windows, evenly over the whole text, so that no long text outweighs the others in the fit."""
    return found if len(found) <= most else [found[i * len(found) // most] for i in range(most)]


def _toxic_dictionary(texts: list[list[bytes]], ordinary: bytes, size: int, k: int, level: int, rounds: int, gain: int, part: int, least: int) -> bytes:
    """Trained on the windows of toxic texts that a dictionary of the other half of them saves ``gain`` bytes on. It holds one
    ``part``-th of their length (``least`` to ``size`` bytes), as most of the rest is what they have of their own."""
    halves = [[w for t in texts[i::2] for w in t if len(w) >= 8] for i in (0, 1)]

    def trained(picked: list[bytes]) -> bytes:
        padded = [b" " + w + b" " for w in picked]
        return _train(padded, max(least, min(size, sum(map(len, padded)) // part)), k)

    picked = halves
    for _ in range(rounds):
        own = [trained(ws) for ws in picked]
        saved = [Distance(own[1 - i], ordinary, level)(halves[i]) for i in (0, 1)]
        kept = [[w for w, n in zip(halves[i], saved[i], strict=True) if n >= gain] for i in (0, 1)]
        if not kept[0] or not kept[1]:
            break
        picked = kept
    return trained([w for ws in picked for w in ws])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> list[float]:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6), x.T @ (y - p) - penalty * w)
    return [float(v) for v in w]


#: (rounds, gain, part, least) of ``_toxic_dictionary``: a few, as how far to narrow depends on how much text there is.
NARROWING = ((3, 4, 8, 1024), (2, 3, 3, 2048), (2, 4, 3, 4096))


def fit(rows: list[tuple[str, int]], ordinary_bytes: int = 65536, toxic_bytes: int = 8192, window: int = 4, level: int = 6, narrowing: tuple = NARROWING, most: int = 400) -> Model:
    """A model of (text, toxic) rows. Half of them train the dictionaries, with at most ``most`` windows of a text, the others
    calibrate, whole; of the toxic dictionaries by ``narrowing`` the one that the others' labels bear out best stays. With
    under 8 texts of either class there is nothing to learn: every score is then 0."""
    rows = _distinct_enough(rows)
    halves: list[list[tuple[str, int]]] = [[], []]
    for label in (0, 1):
        for i, r in enumerate(r for r in rows if r[1] == label):
            halves[i % 2].append(r)
    n = Counter(label for _, label in rows)
    if min(n[0], n[1]) < 8:
        return Model()
    ordinary = _train([w for t, label in halves[0] if not label for w in _spread(windows(t, 16), most) if len(w) >= 8], ordinary_bytes, 64)
    texts = [_spread(windows(t, window), most) for t, label in halves[0] if label]
    y = np.array([label for _, label in halves[1]], float)
    tried = []
    for i, (rounds, gain, part, least) in enumerate(narrowing):
        model = Model(ordinary, _toxic_dictionary(texts, ordinary, toxic_bytes, 16, level, rounds, gain, part, least), [0.0], window, level)
        scorer = Scorer(model)
        x = np.array([scorer.features(t) for t, _ in halves[1]])
        model.weights = _logistic(x, y)
        z = np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -30, 30)
        tried.append((float(np.sum(np.log1p(np.exp(-np.where(y == 1, z, -z))))), i, model))
    return min(tried)[2]


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int = 2000, max_ordinary: int = 4000, max_chars: int = 32_000_000) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts: of either class the documents first by hash, whatever the corpus' size, at most
    ``max_toxic`` and ``max_ordinary`` of them, and no more once they hold ``max_chars`` characters together. Only rows whose
    crc32(doc_id as text) mod 3 is not 1 are learnt from. Texts of any length may be among them, whole."""
    usable = labels.where((crc32_of("doc_id") % 3 != 1) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    picked = None
    for label, most in ((1, max_toxic), (0, max_ordinary)):
        part = usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # At most max_toxic + max_ordinary ids: fit to broadcast at any size.
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")
    found = materialise(found.distinct(), "labelled")
    sizes = found.select(F.col("doc_id").alias("d"), F.col("toxic").alias("y"), F.xxhash64("text").alias("t"), F.length("text").alias("n"))
    before = Window.partitionBy("y").orderBy(F.xxhash64("d"), "d", "t").rowsBetween(Window.unboundedPreceding, -1)
    fits = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < max_chars // 2).select("d", "y", "t")
    rows = found.join(F.broadcast(fits), (F.col("doc_id") == F.col("d")) & (F.col("toxic") == F.col("y")) & (F.xxhash64("text") == F.col("t"))).select("doc_id", "text", "toxic").collect()
    discard(found)
    return [(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"], r["toxic"]))]


def score_toxicity(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """``keep`` columns (default: all) of every row, with score (0 to 1) and predicted (score >= ``threshold``).

    Reads whole texts; a null or empty text has no windows and gets the score of one without toxic content. Repeated rows
    stay repeated. Columns of ``keep`` named score or predicted are replaced. One narrow pass.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("score", "predicted")]
    names = [f"c{i}" for i in range(len(keep))]
    inner = df.select(F.col(f"`{text_col}`").cast("string").alias("__text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)])

    cache: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not cache:
            cache.append(Scorer(model))
        scores = [cache[0].score(t) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*names, "score"])

    kinds = [f"{n} {inner.schema[n].dataType.simpleString()}" for n in names]
    out = map_rows(inner, run, ", ".join([*kinds, "score double"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

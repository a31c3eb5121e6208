"""Ranked lexical search with block-max pruning, exact.

The index: documents are cut, as they are read, into ranges of up to DOCS documents or POSTINGS postings, the blocks. A row of
the index is a document with its terms (64-bit hashes, sorted) and their counts; a block's first row also holds the block's
terms with the greatest impact and the number of documents of each. An impact is a term's share of a document's score before
the term's weight, so the index serves any queries.

The search, for a bounded piece of the queries at a time:
1. Documents per term are summed over the blocks; they give the weights.
2. A block's bound for a query is the sum of weight times greatest impact. Tasks pass on their few best blocks per query.
3. The documents of the best blocks are scored; each query's k-th score so far is its threshold.
4. Every task goes through its blocks in order of their bounds, scores the documents of a block for the queries whose bound
   reaches their threshold, raises the thresholds by what it finds, and passes on its k best documents per query.

No posting list is built, so a term that every document holds makes no long row, and no task holds more than a batch of rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialise, small_batches

DOCS = 64  # documents of a block
POSTINGS = 65_536  # postings after which a block ends
QUERIES = 256  # queries of a piece
TERMS = 16_384  # distinct terms of a piece, more only if a single query has them
SEEDS = 4  # best blocks of a query that are scored first
SCALE = 1_000_000_000
# Term characters are ASCII letters, digits and everything beyond ASCII; A-Z are lower-cased.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LETTERS).split()


class _Hashes(dict):
    """64-bit hashes of terms; a memo of bounded size."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[term] = xxhash.xxh3_64_intdigest(term)
        return found


def _counted(terms: list[bytes], known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the distinct terms."""
    counts = Counter(terms)
    h = np.fromiter(map(known.__getitem__, counts), np.uint64, len(counts))
    order = np.argsort(h)
    return h[order], np.fromiter(counts.values(), np.int64, len(counts))[order]


class Corpus:
    """What an impact needs to know of the whole corpus: documents with a term and all terms."""

    def __init__(self, documents: int, terms: int) -> None:
        self.documents, self.terms = documents, terms

    def impacts(self, tf: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        m = 100 - 25 + (25 * np.asarray(n, np.int64) * self.documents) // max(1, self.terms)
        return (SCALE * tf) // (1000 * tf + 12 * m)

    def weights(self, df: np.ndarray) -> np.ndarray:
        return np.floor(1000 * np.log((2 * self.documents + 2) / (2 * df + 1))).astype(np.int64)


INDEX = "block long, doc long, n long, terms binary, counts binary, top binary, most binary, docs binary"


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = DOCS, block_postings: int = POSTINGS) -> tuple[DataFrame, Corpus]:
    """The index of all texts, written to the shared folder, and the corpus figures. Texts without a term are left out, as they
    match nothing. Ids are longs and may be null or repeat: each row is a document. Other columns are not read."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [len(terms_of(t)) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)]), pa.array([sum(n)])], names=["documents", "terms"])

    with small_batches(docs.sparkSession):
        total = map_rows(docs.select("text"), sizes, "documents long, terms long").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).first()
    corpus = Corpus(total.documents or 0, total.terms or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, postings, block = _Hashes(), [], 0, 0

        def closed() -> pa.RecordBatch:
            h = np.concatenate([x[2] for x in held])
            impact = np.concatenate([corpus.impacts(x[3], x[1]) for x in held])
            order = np.lexsort((impact, h))
            h, impact = h[order], impact[order]
            last = np.flatnonzero(np.r_[h[1:] != h[:-1], True])
            top = h[last].tobytes(), impact[last].astype(np.int32).tobytes(), np.diff(np.r_[-1, last]).astype(np.int32).tobytes()
            none = [None] * (len(held) - 1)
            columns = [[x[0] for x in held], [x[1] for x in held], [x[2].tobytes() for x in held], [x[3].astype(np.int32).tobytes() for x in held], *([t, *none] for t in top)]
            kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array([block] * len(held), pa.int64()), *map(pa.array, columns, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                terms = terms_of(text)
                if not terms:
                    continue
                h, c = _counted(terms, known)
                held.append((doc, len(terms), h, c))
                postings += len(h)
                if len(held) >= block_docs or postings >= block_postings:
                    yield closed()
                    held, postings, block = [], 0, block + 1
        if held:
            yield closed()

    # Blocks are numbered within their task; the number of the partition makes them unique.
    rows = docs.mapInArrow(run, INDEX).withColumn("block", F.col("block") + F.spark_partition_id().cast("long") * (1 << 32))
    with small_batches(docs.sparkSession):
        return materialise(rows, "index"), corpus


class _Piece:
    """Some queries as arrays: ``terms`` are their distinct terms, ``at`` each query's terms as places in these, query after
    query from ``starts``, ``times`` how often the query has the term."""

    def __init__(self, queries: list[tuple[object, np.ndarray, np.ndarray]]) -> None:
        self.items = [q[0] for q in queries]
        self.terms = np.unique(np.concatenate([q[1] for q in queries]))
        self.at = np.concatenate([np.searchsorted(self.terms, q[1]) for q in queries])
        self.times = np.concatenate([q[2] for q in queries])
        self.starts = np.cumsum([0] + [len(q[1]) for q in queries[:-1]])

    def weigh(self, corpus: Corpus, df: np.ndarray) -> None:
        self.weight = corpus.weights(df)[self.at] * self.times
        query = np.repeat(np.arange(len(self.items)), np.diff(np.r_[self.starts, len(self.at)]))
        self.matrix = np.zeros((len(self.items), len(self.terms)), np.int64)
        self.matrix[query, self.at] = self.weight
        self.exact = float(np.add.reduceat(self.weight.astype(np.float64), self.starts).max()) * SCALE / 1000 < 2.0**53

    def found(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted ``terms`` are the queries', and their places."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        own = self.terms[at] == terms
        return own, at[own]

    def bounds(self, top: bytes, most: bytes) -> np.ndarray:
        own, at = self.found(np.frombuffer(top, np.uint64))
        greatest = np.zeros(len(self.terms), np.int64)
        greatest[at] = np.frombuffer(most, np.int32)[own]
        return np.add.reduceat(greatest[self.at] * self.weight, self.starts)

    def scores(self, queries: np.ndarray, docs: list[tuple], corpus: Corpus) -> np.ndarray:
        """(queries, documents)."""
        rows, places, impacts = [], [], []
        for i, (_, n, terms, counts) in enumerate(docs):
            own, at = self.found(np.frombuffer(terms, np.uint64))
            rows.append(np.full(len(at), i))
            places.append(at)
            impacts.append(corpus.impacts(np.frombuffer(counts, np.int32)[own].astype(np.int64), n))
        used, at = np.unique(np.concatenate(places), return_inverse=True)
        kind = np.float64 if self.exact else np.int64  # in doubles where no sum reaches 2^53: they are exact, and fast
        dense = np.zeros((len(used), len(docs)), kind)
        dense[at, np.concatenate(rows)] = np.concatenate(impacts)
        return (self.matrix[np.ix_(queries, used)].astype(kind) @ dense).astype(np.int64)


def _pieces(rows: Iterator, known: _Hashes) -> Iterator[_Piece]:
    held, terms = [], 0
    for item, text in rows:
        h, c = _counted(terms_of(text), known)
        if not len(h):
            continue
        if held and (len(held) >= QUERIES or terms + len(h) > TERMS):
            yield _Piece(held)
            held, terms = [], 0
        held.append((item, h, c))
        terms += len(h)
    if held:
        yield _Piece(held)


def _best(scores: np.ndarray, docs: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((docs, none, -scores))[:k]


def _scored(corpus: Corpus, share, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(q, doc, score) of a task's best documents; ``share`` broadcasts the piece and the thresholds. Rows of a block follow
    each other; a block that goes on in the next batch is two blocks with one bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, least = share.value
        least = least.copy()
        empty = np.zeros(0, np.int64)
        best = [(empty, empty, empty) for _ in least]  # score, doc, null
        bound, block = None, None
        for b in batches:
            blocks = b.column("block").to_numpy()
            starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
            bounds = []
            for s in starts:
                top = b.column("top")[s].as_py()
                if top is not None:
                    bound = piece.bounds(top, b.column("most")[s].as_py())
                elif blocks[s] != block:  # its first row is another task's: no bound is known
                    bound = np.full(len(least), np.iinfo(np.int64).max)
                block = blocks[s]
                bounds.append(bound)
            ends = np.r_[starts[1:], len(blocks)]
            order = np.argsort([-int(x.max()) for x in bounds])
            for i in order:
                wanted = np.flatnonzero((bounds[i] >= least) & (bounds[i] > 0))
                if not len(wanted):
                    continue
                part = b.slice(starts[i], ends[i] - starts[i])
                docs = list(zip(*(part.column(c).to_pylist() for c in ("doc", "n", "terms", "counts")), strict=True))
                ids, none = np.array([d[0] or 0 for d in docs]), np.array([d[0] is None for d in docs], np.int64)
                scores = piece.scores(wanted, docs, corpus)
                better = (scores >= least[wanted][:, None]) & (scores > 0)
                for row in np.flatnonzero(better.any(1)):
                    q, own = wanted[row], better[row]
                    both = tuple(np.concatenate(x) for x in zip(best[q], (scores[row][own], ids[own], none[own]), strict=True))
                    top = _best(*both, k)
                    best[q] = tuple(x[top] for x in both)
                    if len(top) == k:
                        least[q] = max(least[q], best[q][0][-1])
        q = np.repeat(np.arange(len(best)), [len(x[0]) for x in best])
        score, doc, none = (np.concatenate(x) for x in zip(*best, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(doc, mask=none.astype(bool)), pa.array(score)], names=["q", "doc", "score"])

    return run


def _documents_of(index: DataFrame, piece: _Piece) -> np.ndarray:
    """How many documents hold each of the piece's terms."""
    terms = piece.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for top, docs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.frombuffer(top, np.uint64)
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                own = terms[at] == h
                total[at[own]] += np.frombuffer(docs, np.int32)[own]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["t", "df"])

    out = np.zeros(len(terms), np.int64)
    found = index.where("top IS NOT NULL").select("top", "docs").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()
    out[found.column("t").to_numpy()] = found.column("df").to_numpy()
    return out


def _seeds(index: DataFrame, share, seeds: int) -> DataFrame:
    """(block): for each query the blocks with the greatest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = share.value[0]
        bound, block = np.zeros((len(piece.items), 0), np.int64), np.zeros((len(piece.items), 0), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            now = np.stack([piece.bounds(t, m) for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], axis=1)
            bound, block = np.c_[bound, now], np.c_[block, np.broadcast_to(b.column(0).to_numpy(), now.shape)]
            order = np.argsort(-bound, axis=1)[:, :seeds]
            bound, block = np.take_along_axis(bound, order, 1), np.take_along_axis(block, order, 1)
        q = np.repeat(np.arange(len(bound)), bound.shape[1])
        own = bound.ravel() > 0
        yield pa.RecordBatch.from_arrays([pa.array(q[own]), pa.array(block.ravel()[own]), pa.array(bound.ravel()[own])], names=["q", "block", "bound"])

    each = index.where("top IS NOT NULL").select("block", "top", "most").mapInArrow(run, "q long, block long, bound long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))
    return each.withColumn("place", place).where(F.col("place") <= seeds).select("block").distinct()


def search(index: DataFrame, corpus: Corpus, queries: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 of each query, all if there are fewer;
    equal scores by ascending id, null ids last.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); a document's score is the sum over the query's terms, repeats
    included, of weight times impact, in 64-bit integers. A null or blank query has no terms and no results. Items are longs;
    each row of ``queries`` is a query, whether its item repeats or not; other columns are not read. Queries stream through
    the driver in pieces of at most QUERIES, each of which passes over the index."""
    spark, context = index.sparkSession, index.sparkSession.sparkContext
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    found = None
    asked = queries.select(F.col(f"`{item_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    with small_batches(spark):
        for piece in _pieces(asked.toLocalIterator(), _Hashes()):
            piece.weigh(corpus, _documents_of(index, piece))
            start = context.broadcast((piece, np.zeros(len(piece.items), np.int64)))
            first = index.join(F.broadcast(_seeds(index, start, SEEDS)), "block", "left_semi")  # at most SEEDS blocks a query
            best = first.mapInArrow(_scored(corpus, start, k), "q long, doc long, score long").withColumn("place", place)
            least = np.zeros(len(piece.items), np.int64)
            for r in best.where(F.col("place") == k).select("q", "score").collect():
                least[r.q] = r.score
            share = context.broadcast((piece, least))
            each = index.mapInArrow(_scored(corpus, share, k), "q long, doc long, score long").withColumn("place", place).where(F.col("place") <= k)
            items = spark.createDataFrame(list(enumerate(piece.items)), "q long, item_id long")
            named = materialise(each.join(F.broadcast(items), "q").select("item_id", F.col("place").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score"), "ranked")
            start.destroy()
            share.destroy()
            found = named if found is None else found.unionByName(named)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found

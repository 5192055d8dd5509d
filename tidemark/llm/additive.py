"""Approximate nearest neighbours by additive quantisation (operator 7).

A vector is written as a sum of one full-dimensional word from each of BOOKS codebooks. The codebooks start as k-means of
the residuals that the books before them leave, on a bounded sample of SAMPLE vectors, and are then refitted together by
least squares. Every vector of the table is encoded by beam search and kept with its codes, the squared norm of its
reconstruction, and its distance from it. A query adds up one table of inner products per book (lookup-table scoring)
to get its distance from every reconstruction; the true distance differs by no more than the stored error. Every vector
whose lower bound doesn't exceed the k-th distance found is reranked by its exact distance, so the k nearest are
the k nearest, not only likely to be.

Queries are taken in blocks of QUERY_BYTES, which bounds what is broadcast; for each block every task passes once over its part of
the index, scores AT_ONCE queries at a time against a batch of its rows, and gives k rows for a query. Nothing else moves. The work is queries times
vectors, as a table look-up for each book; exact distances are only taken of the few that the stored errors leave.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, as queries or candidates.
Vectors of different lengths have no distance: each length has an index and queries of its own. Rows that have the query's id are its own; other
rows that repeat an id are candidates each; of query rows that repeat an id the smallest vector asks. A null id is a candidate without a name: it is
left out. Ties go to the smaller id. Only the two named columns are read, so others may have any name and type. Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, named, table
from .vectors import distances, kmeans, matrix, usable

BOOKS, WORDS, BEAM = 48, 64, 4
SAMPLE = 4096
#: Bytes of the queries of one pass over the index, in double precision; queries that are scored at once; rows of the index that are.
QUERY_BYTES, AT_ONCE = 32 << 20, 2048
ROWS = 2048
#: Room for rounding in single precision, relative to the largest norms.
SLACK = 1e-4


@dataclass
class Codebooks:
    books: np.ndarray  # (BOOKS, WORDS, dimensions)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes by beam search: after each book the `beam` best sums so far go on."""
        n, d = x.shape
        rest, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), dtype=np.uint8)
        rows = np.arange(n)[:, None]
        for book in self.books.astype(np.float32):
            width = rest.shape[1]
            lengths = (rest * rest).sum(axis=2)
            off = lengths[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, width, -1) + (book * book).sum(axis=1)
            off = off.reshape(n, -1)
            keep = min(beam, off.shape[1])
            best = np.argpartition(off, keep - 1, axis=1)[:, :keep]
            above, word = best // len(book), best % len(book)
            rest = rest[rows, above] - book[word]
            codes = np.concatenate([codes[rows, above], word[:, :, None].astype(np.uint8)], axis=2)
        return codes[np.arange(n), np.argmin((rest * rest).sum(axis=2), axis=1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.books.shape[2]))
        for m, book in enumerate(self.books):
            out += book[codes[:, m]]
        return out


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 7) -> Codebooks:
    rng, rest, found = np.random.default_rng(seed), x.copy(), []
    for _ in range(books):
        book = kmeans(rest, words, 5, rng)
        near = np.argmax(rest @ book.T - 0.5 * (book * book).sum(axis=1), axis=1)
        rest -= book[near]
        found.append(book)
    first = Codebooks(np.stack(found))
    codes = first.encode(x)
    hot = np.zeros((len(x), books * words), dtype=np.float32)
    hot[np.arange(len(x))[:, None], codes.astype(np.int64) + np.arange(books) * words] = 1
    gram = (hot.T @ hot).astype(np.float64) + 0.5 * np.eye(books * words)
    pull = hot.T.astype(np.float64) @ x + 0.5 * first.books.reshape(books * words, -1)
    return Codebooks(np.linalg.solve(gram, pull).reshape(first.books.shape))


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part."""
    vector = named(vector_col)
    return vectors.where(usable(vector) & named(id_col).isNotNull()).select(named(id_col).cast("long").alias("id"), vector.cast("array<double>").alias("v"))


def build_index(good: DataFrame) -> tuple[DataFrame, Codebooks | None]:
    """good(id, v) of one length -> (id, v, codes, norm, error) for every vector, and the codebooks (None for an empty table)."""
    n = good.count()
    if not n:
        return good.selectExpr("id", "v", "cast(null as binary) codes", "0D norm", "0D error"), None
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / n))
    rows = good.where(part).select("v").limit(2 * SAMPLE).collect()
    rows = rows or good.select("v").limit(SAMPLE).collect()
    model = train(np.array([r["v"] for r in rows]))
    shared = good.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = matrix(batch.column(1))
                codes = shared.value.encode(x)
                near = shared.value.decode(codes)
                norm, error = (near * near).sum(axis=1), np.sqrt(((x - near) ** 2).sum(axis=1))
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array(norm), pa.array(error)], names=["id", "v", "codes", "norm", "error"])

    return cut(good.mapInArrow(run, "id long, v array<double>, codes binary, norm double, error double")), model


class _Search:
    """The k nearest so far for some queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, books: np.ndarray, k: int):
        self.ids, self.queries, self.books, self.k = ids, queries, books, k
        self.best_d, self.best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, dtype=np.int64)
        self.lengths = (queries * queries).sum(axis=1)
        # The tables of one round of queries are kept; those of many are made anew for each batch of rows.
        self.kept = self._tables(slice(0, len(ids))) if len(ids) <= AT_ONCE else None

    def _tables(self, part: slice) -> list[np.ndarray]:
        return [np.ascontiguousarray((self.queries[part] @ b.T).T, dtype=np.float32) for b in self.books]  # (WORDS, queries) each

    def look(self, batch: pa.RecordBatch) -> None:
        """Measure a batch of rows of the index against all queries."""
        row_ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
        codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(len(x), -1)
        norm, error = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        for at in range(0, len(self.ids), AT_ONCE):
            part = slice(at, min(at + AT_ONCE, len(self.ids)))
            tables = self.kept or self._tables(part)
            for low in range(0, len(x), ROWS):
                rows = slice(low, low + ROWS)
                self._round(part, tables, row_ids[rows], x[rows], codes[rows], norm[rows], error[rows])

    def _round(self, part: slice, tables: list[np.ndarray], row_ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, error: np.ndarray) -> None:
        ids, queries, lengths = self.ids[part], self.queries[part], self.lengths[part]
        best_d, best_i, k = self.best_d[part], self.best_i[part], self.k  # views
        inner = np.zeros((len(x), len(ids)), dtype=np.float32)
        for m, looked_up in enumerate(tables):
            inner += looked_up[codes[:, m]]
        apart = np.sqrt(np.maximum(0.0, lengths[None, :] - 2.0 * inner + norm[:, None]))
        slack = SLACK * (1 + np.sqrt(lengths.max(initial=0)) + np.sqrt(norm.max(initial=0)))
        apart[row_ids[:, None] == ids[None, :]] = np.inf
        some = min(k, len(x))
        for q in range(len(ids)):
            column = apart[:, q]
            first = np.argpartition(column, some - 1)[:some]
            limit = best_d[q, -1]
            if some == k and np.isfinite(column[first]).all():
                limit = min(limit, distances(x[first], queries[q]).max())
            rerank = np.flatnonzero((column - error <= limit + slack) & np.isfinite(column))
            if not len(rerank):
                continue
            exact = distances(x[rerank], queries[q])
            d, i = np.concatenate([best_d[q], exact]), np.concatenate([best_i[q], row_ids[rerank]])
            order = np.lexsort((i, d))[:k]
            best_d[q], best_i[q] = d[order], i[order]


def _scan(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, books: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of these rows for each query, exactly."""
    search = _Search(ids, queries, books, k)
    for batch in batches:
        search.look(batch)
    for at in range(0, len(ids), AT_ONCE):
        q, r = np.nonzero(np.isfinite(search.best_d[at : at + AT_ONCE]))
        q += at
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(search.best_i[q, r]), pa.array(search.best_d[q, r])], names=["query_id", "vec_id", "score"])


def nearest(index: DataFrame, model: Codebooks | None, queries: DataFrame, k: int = 10) -> DataFrame:
    """queries(id, v) -> (query_id, rank, vec_id, score), rank from 1."""
    spark = index.sparkSession
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    total = queries.count() if model is not None else 0
    blocks = -(-total * 8 * model.books.shape[2] // QUERY_BYTES) if total else 0
    for b in range(blocks):  # each block's queries are bounded by the even spread of a hash
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        ids, q = rows.column(0).to_numpy(), matrix(rows.column(1).combine_chunks())
        shared = spark.sparkContext.broadcast((ids, q, model.books))
        part = index.mapInArrow(lambda it, s=shared: _scan(it, *s.value, k), "query_id long, vec_id long, score double")
        found = part if b == 0 else found.unionByName(part)
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """The k nearest of all rows to each row that is_query picks (a condition on `id`)."""
    good, found = usable_vectors(vectors, id_col, vector_col), None
    for row in good.select(F.size("v").alias("d")).distinct().orderBy("d").collect():
        index, model = build_index(good.where(F.size("v") == row["d"]))
        part = nearest(index, model, index.where(is_query).select("id", "v"), k)
        found = part if found is None else found.unionByName(part)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


# ---------------------------------------------------------------- query
def op7_additive_quantisation(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)


OP7_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10"""

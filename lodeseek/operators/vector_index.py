"""A stored index of vectors: cells that are partitions of its table, and product codes of what a cell's centre leaves.

A search reads the partitions of the cells nearest to the query, of these only ids and codes, ranks by distances
that a small table per code book gives, and measures the best of them exactly. With every cell and no codes it is
exact. Centres and code books are fitted on a bounded sample; every row is coded. Changed rows are coded by the same centres
and come as a new part of the stored table, so nothing else is written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.operators import vectors as V
from lodeseek.sources.store import Store


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (-2 * x @ centers.T + (centers**2).sum(1)).argmin(1)


def lloyd(x: np.ndarray, n: int, rounds: int, rng: np.random.RandomState) -> np.ndarray:
    centers = x[rng.permutation(len(x))[: min(n, len(x))]].copy()
    for _ in range(rounds):
        near = nearest(x, centers)
        for c in range(len(centers)):
            if (near == c).any():
                centers[c] = x[near == c].mean(0)
    return centers


@dataclass(frozen=True)
class Coder:
    """Cell centres, and for each stretch of dimensions a book of residuals."""

    centers: np.ndarray
    books: tuple[np.ndarray, ...]

    @property
    def cuts(self) -> list[slice]:
        ends = np.cumsum([b.shape[1] for b in self.books])
        return [slice(e - b.shape[1], e) for e, b in zip(ends.tolist(), self.books)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, a code byte per book) of each row."""
        cell = nearest(x, self.centers)
        rest = x - self.centers[cell]
        return cell, np.stack([nearest(rest[:, s], b) for s, b in zip(self.cuts, self.books)], axis=1).astype(np.uint8)

    def distances(self, query: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of the query to what the codes stand for."""
        out = np.zeros(len(cell))
        for c in np.unique(cell):
            own = cell == c
            rest = query - self.centers[c]
            for i, (s, book) in enumerate(zip(self.cuts, self.books)):
                out[own] += ((rest[s] - book) ** 2).sum(1)[codes[own, i]]
        return out

    def table(self, spark) -> DataFrame:
        """(book, number, vector): book -1 has the centres."""
        rows = [(b, i, v.tolist()) for b, book in enumerate([self.centers, *self.books], -1) for i, v in enumerate(book)]
        return spark.createDataFrame(rows, "book int, number int, vector array<double>")

    @staticmethod
    def of_table(table: DataFrame) -> Coder:
        """A coder's own table: as many rows as cells and codes."""
        books: dict[int, list] = {}
        for r in table.orderBy("book", "number").collect():
            books.setdefault(r.book, []).append(r.vector)
        return Coder(np.array(books[-1]), tuple(np.array(books[b]) for b in sorted(books) if b >= 0))


def fit(vectors: DataFrame, cells: int = 64, books: int = 8, codes: int = 64, sample_rows: int = 20_000, rounds: int = 12, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> Coder:
    """Fitted on the rows of the smallest id hashes, at most sample_rows."""
    rows = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(sample_rows).select(vector_col).collect()
    if not rows:
        raise ValueError("no vectors to fit an index on")
    x, rng = np.array([r[0] for r in rows], dtype=np.float64), np.random.RandomState(seed)
    centers = lloyd(x, cells, rounds, rng)
    rest = x - centers[nearest(x, centers)]
    return Coder(centers, tuple(lloyd(part, min(codes, 256), rounds, rng) for part in np.array_split(rest, min(books, x.shape[1]), axis=1)))


def encoded(vectors: DataFrame, coder: Coder, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cell_id, codes, embedding) of every row; rows without an id or a vector are not indexed."""
    sent = vectors.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cell, codes = sent.value.encode(x)
                columns = [batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cell_id", "codes", "embedding"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding")).na.drop()
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cell_id int, codes binary, embedding array<double>")


def search(index: DataFrame, coder: Coder, query: Sequence[float], k: int = 10, probes: int = 8, rerank: int | None = 10) -> DataFrame:
    """(id, score) of the k nearest, score 1 - squared distance, ties to the smaller id. rerank: exact distances for so many times k of
    the best by codes; None: for every row of the cells."""
    q = np.array(query, dtype=np.float64)
    near = ((coder.centers - q) ** 2).sum(1).argsort(kind="stable")[:probes].tolist()
    rows = index.where(F.col("cell_id").isin(*near))
    if rerank is not None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    far = coder.distances(q, batch.column(1).to_numpy(), codes)
                    best = np.argsort(far, kind="stable")[: k * rerank]  # no row beyond these can be among the best of all
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(best)), pa.array(far[best])], names=["id", "far"])

        best = rows.select("id", "cell_id", "codes").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, far double").orderBy("far", "id").limit(k * rerank)
        rows = rows.join(F.broadcast(best.select("id")), "id", "left_semi")  # k * rerank rows
    return V.top_k(rows, query, k, id_col="id")


#: Rows of the index and queries that one task holds at once, and rows and queries whose distances it holds at once.
ROW_BLOCK, QUERY_BLOCK, TILE = 16_384, 8_192, 128
#: Pairs that are measured at once.
MEASURED = 1 << 21


def search_many(index: DataFrame, coder: Coder, queries: DataFrame, k: int = 10, probes: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score) of the k nearest of each row of queries, among the rows of its nearest cells.

    Rows of a cell and the queries that probe it meet in a grid of blocks of bounded size. A task finds by products of matrices what can be
    among a query's k nearest of its block, and measures that exactly; what leaves it is k rows a query. Every row
    of a cell meets every query that probes it, so queries are a stated set, not the table itself."""
    centers = coder.centers.tolist()
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("q")).na.drop()
    n_queries = asked.count()
    sizes = {r.cell_id: r.n for r in index.groupBy("cell_id").agg(F.count("*").alias("n")).collect()}  # a row for each cell
    rows_of = index.select("id", "embedding", "cell_id")
    if probes >= len(centers):  # cells tell nothing then
        sizes, rows_of = {0: sum(sizes.values())}, rows_of.withColumn("cell_id", F.lit(0))
        asked = asked.withColumn("cell_id", F.lit(0))
    else:
        near = F.slice(F.array_sort(F.array(*(F.struct(V.squared_l2(F.col("q"), c).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centers)))), 1, probes)
        asked = asked.select("query_id", "q", F.explode(near).alias("n")).select("query_id", "q", F.col("n.c").alias("cell_id"))
    if not sizes or not n_queries or k < 1:
        return index.limit(0).select(F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), "id", F.lit(0.0).alias("score"))
    cores = index.sparkSession.sparkContext.defaultParallelism
    block = max(1, min(ROW_BLOCK, -(-sum(sizes.values()) // (2 * cores))))
    splits = F.create_map(*(F.lit(x) for c, n in sizes.items() for x in (c, -(-n // block))))
    wide = max(1, -(-n_queries // QUERY_BLOCK))
    left = asked.where(F.col("cell_id").isin(list(sizes))).select(
        "query_id", "q", "cell_id", F.explode(F.sequence(F.lit(0), splits[F.col("cell_id")] - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(wide)).cast("int").alias("group")
    )
    right = rows_of.withColumn("part", F.pmod(F.xxhash64("id"), splits[F.col("cell_id")]).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {index.schema['id'].dataType.simpleString()}, score double"
    keys, names = ("cell_id", "part", "group"), ("query_id", "id", "score")

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        q, odd_q = _matrix(asked.column("q"))
        x, odd_x = _matrix(rows.column("embedding"))
        at, to, score = [np.concatenate(c) for c in zip(*_nearest(q, x, np.array(rows.column("id").to_pylist()), k, odd_q, odd_x))] if len(q) and len(x) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        null = odd_q[at] | odd_x[to]
        return pa.Table.from_arrays([asked.column("query_id").take(pa.array(at)), rows.column("id").take(pa.array(to)), pa.array(score, mask=null)], names=list(names))

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, kinds)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of one width, and which of them hold a null, so that no distance to them is known. Shorter ones count as having nulls."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat, null = lists.flatten(), np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=bool)
    out = np.full(null.shape, np.nan)
    inside = np.arange(null.shape[1]) < sizes[:, None]
    out[inside] = flat.to_numpy(zero_copy_only=False)
    null[inside] = flat.is_null().to_numpy(zero_copy_only=False)
    return out, (null | ~inside).any(axis=1)


def _nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, null_q: np.ndarray, null_x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in q, place in x, score) of each query's k best: NaN first and null last, as Spark orders them, ties to the smaller id. Products screen
    with a bound of their error; where it means nothing (not finite, or huge) all are measured."""
    if q.shape[1] != x.shape[1]:  # all distances are null then
        q, x, null_q, null_x = q[:, :0], x[:, :0], np.ones(len(q), bool), np.ones(len(x), bool)
    with np.errstate(all="ignore"):
        q2, x2 = (q * q).sum(1), (x * x).sum(1)
        plain_q, plain_x = q2 < 1e150, x2 < 1e150  # False for NaN
        plain = np.flatnonzero(plain_x)
        xp, error = x[plain], 1e-15 * (x.shape[1] + 8)
        for start in range(0, len(q), TILE):
            own = np.arange(start, min(start + TILE, len(q)))
            may = np.ones((len(own), len(x)), dtype=bool)
            if len(plain) > k:  # rows that are not plain stay
                far = q2[own, None] + x2[plain] - 2 * (q[own] @ xp.T)
                slack = error * (q2[own, None] + x2[plain])
                kth = np.partition(far + slack, k - 1, axis=1)[:, k - 1 : k]
                may[:, plain] = (far - slack <= kth) | ~plain_q[own, None]
            at, to = np.nonzero(may)
            if len(at) <= MEASURED:
                yield _measured(q, x, ids, k, null_q, null_x, own[at], to)
            else:
                for i in range(len(own)):
                    yield _measured(q, x, ids, k, null_q, null_x, own[at[at == i]], to[at == i])


def _measured(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, null_q: np.ndarray, null_x: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sums = np.zeros(len(at))
    for d in range(x.shape[1]):  # in the order of the dimensions, as a fold of the arrays
        gap = x[to, d] - q[at, d]
        sums += gap * gap
    score, null = 1 - sums, null_q[at] | null_x[to]
    order = np.lexsort((ids[to], np.where(np.isnan(score), 0, sums), ~np.isnan(score), null, at))
    at, to, score = at[order], to[order], score[order]
    first = np.searchsorted(at, at)
    kept = np.arange(len(at)) - first < k
    return at[kept], to[kept], score[kept]


@dataclass
class StoredVectorIndex:
    """The index as tables of a store: rows by cell, and the coder."""

    store: Store
    name: str

    def create(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **fitting) -> None:
        coder = fit(vectors, id_col=id_col, vector_col=vector_col, **fitting)
        with self.store.transaction():
            self.store.write(f"{self.name}_coder", coder.table(self.store.spark))
            self.store.write(self.name, encoded(vectors, coder, id_col, vector_col), partition_by="cell_id")

    def coder(self) -> Coder:
        return Coder.of_table(self.store.read(f"{self.name}_coder"))

    def upsert(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        rows = encoded(vectors, self.coder(), id_col, vector_col)
        self.store.change(self.name, rows, vectors.select(F.col(id_col).alias("id")).na.drop(), ["id"])

    def delete(self, ids: DataFrame, id_col: str = "vec_id") -> None:
        self.store.change(self.name, None, ids.select(F.col(id_col).alias("id")), ["id"])

    def search(self, query: Sequence[float], k: int = 10, probes: int = 8, rerank: int | None = 10) -> DataFrame:
        return search(self.store.read(self.name), self.coder(), query, k, probes, rerank)

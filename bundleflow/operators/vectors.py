"""Nearest vectors by cosine: one query, a batch of queries, or within candidate documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.plan import fence
from ..functions.vectors import cosine
from ..session import cut_lineage

DEFAULT_K = 10  # ours: the number of hits is left open by the design
CENTRES = 256  # cells that vectors are cut into; their centres, a sample of so many rows, travel to every task
QUERY_SLICE = 4096  # queries and vectors of a cell meet in blocks of at most about these sizes
VECTOR_SLICE = 50_000
ASKED_ROWS = 16_384  # query vectors that one frame repeats for the cells they ask
MARGIN = 1e-6  # scores are rounded to six places; bounds are taken that much wider
TILE_BYTES = 32 * 1024 * 1024  # scores held at once, whatever the blocks


def vector_topk(vectors: DataFrame, query: Sequence[float], k: int = DEFAULT_K, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k nearest to one literal vector, ties by id: a per-task top-k and a merge."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = fence(vectors.select(id_col, vec), score=F.round(cosine(F.col(vec), q), 6)).drop(vec)
    return scored.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), F.col(id_col)).limit(k)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; a zero row becomes nan and is never a hit."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores of one query, ties by id."""
    usable = np.flatnonzero(~np.isnan(scores))
    if len(usable) > 4 * k:  # cut to everything at or above the k-th score, then order exactly
        kth = np.partition(scores[usable], len(usable) - k)[len(usable) - k]
        usable = usable[scores[usable] >= kth]
    return usable[np.lexsort((ids[usable], -scores[usable]))[:k]]


def _block_hits(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """k best of one block of vectors for each query of one block, by one matrix product."""
    unit, rows = _unit(v).T, max(1, TILE_BYTES // (8 * max(1, len(v))))
    picks, best = [], []
    for at in range(0, len(q), rows):  # a tile of the score matrix at a time
        scores = np.round(_unit(q[at : at + rows]) @ unit, 6)
        for row in scores:
            picks.append(_best(row, ids, k))
            best.append(row[picks[-1]])
    return pd.DataFrame(
        {
            "query_id": np.repeat(query_ids, [len(p) for p in picks]).astype("int64"),
            "vec_id": np.concatenate([ids[p] for p in picks]).astype("int64"),
            "score": np.concatenate(best).astype("float64"),
        }
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


_HITS = "query_id bigint, vec_id bigint, score double"


def _distances(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (unit @ centres.T), 0))


def _rows_of(frame: pd.DataFrame, column: str) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows with a direction, and their unit vectors."""
    if not len(frame):
        return frame, np.zeros((0, 1))
    unit = _unit(_matrix(frame[column]))
    good = ~np.isnan(unit).any(axis=1)
    return frame[good], unit[good]


class Cut(NamedTuple):
    """Cells around centres, as tasks need to know them."""

    centres: np.ndarray
    size: np.ndarray  # vectors of each cell
    radius: np.ndarray  # distance of its farthest vector from the centre

    def best_possible(self, unit: np.ndarray) -> np.ndarray:
        """Highest score that a vector of each cell can have with each query, by the triangle inequality."""
        if not len(self.centres):
            return np.ones((len(unit), 1))
        apart = np.maximum(_distances(unit, self.centres) - self.radius - MARGIN, 0)
        return 1 - apart**2 / 2 + MARGIN

    def ordered(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the cells by what they promise, that bound, and how many vectors the cells before hold."""
        bound = self.best_possible(unit)
        order = np.argsort(-bound, axis=1, kind="stable")
        return order, np.take_along_axis(bound, order, axis=1), np.cumsum(self.size[order], axis=1) - self.size[order]


class Cells(NamedTuple):
    """A cut of all vectors by nearest centre."""

    vectors: DataFrame  # vec_id, v, cell
    cut: Cut

    @classmethod
    def of(cls, vectors: DataFrame, centres: int = CENTRES) -> Cells:
        """vectors: (vec_id, v).  The centres are the vectors with the smallest hashed ids; every row gets a cell."""
        sample = vectors.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(centres).select("v").toPandas()
        _, matrix = _rows_of(sample, "v")

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows, unit = _rows_of(batch, "v")
                far = _distances(unit, matrix) if len(rows) and len(matrix) else np.zeros((len(rows), 1))
                near = far.argmin(axis=1)
                yield pd.DataFrame({"vec_id": rows["vec_id"], "v": rows["v"], "cell": near.astype("int32"), "far": far[np.arange(len(rows)), near]})

        placed = cut_lineage(vectors.select("vec_id", "v").mapInPandas(assign, "vec_id bigint, v array<double>, cell int, far double"))
        stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).toPandas()  # a row for each centre
        size, radius = np.zeros(max(1, len(matrix)), np.int64), np.zeros(max(1, len(matrix)))
        size[stats["cell"]], radius[stats["cell"]] = stats["n"], stats["r"]
        return cls(placed.drop("far"), Cut(matrix, size, radius))

    def home(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, q, cell): for each query the cells that promise most and together hold k vectors."""
        cut = self.cut

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows, unit = _rows_of(batch, "q")
                order, _, before = cut.ordered(unit)
                row, at = np.nonzero((before < k) & (cut.size[order] > 0))
                yield from _asked(rows, row, order[row, at])

        return queries.mapInPandas(run, _ASKED)

    def others(self, queries: DataFrame, k: int) -> DataFrame:
        """The same for the cells besides, of those that may still hold a vector as good as the k-th so far.

        queries: (query_id, q, kth); kth is null if k were not found.
        """
        cut = self.cut

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows, unit = _rows_of(batch, "q")
                order, bound, before = cut.ordered(unit)
                kth = rows["kth"].to_numpy(dtype="float64", na_value=np.nan)[:, None]
                row, at = np.nonzero((before >= k) & (cut.size[order] > 0) & ~(bound < kth))
                yield from _asked(rows, row, order[row, at])

        return queries.mapInPandas(run, _ASKED)

    def score(self, asked: DataFrame, n_queries: int, k: int) -> DataFrame:
        """k best of every asked cell, or block of a large cell, for each of its queries."""
        blocks = np.maximum(1, -(-self.cut.size // VECTOR_SLICE)).astype(int)
        slices = max(1, -(-n_queries // QUERY_SLICE))
        parts = F.get(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell"))
        left = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), parts - 1)))
        right = self.vectors.withColumn("vb", F.pmod(F.xxhash64("vec_id"), parts).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        if slices > 1:  # only blocks that some query asks for travel
            right = right.join(left.select("cell", "qb").distinct(), ["cell", "qb"], "left_semi")

        def hits(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
            if not len(queries) or not len(vectors):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            return _block_hits(queries["query_id"].to_numpy(), _matrix(queries["q"]), vectors["vec_id"].to_numpy(), _matrix(vectors["v"]), k)

        return left.groupBy("cell", "qb", "vb").cogroup(right.groupBy("cell", "qb", "vb")).applyInPandas(hits, _HITS)


_ASKED = "query_id bigint, q array<double>, cell int"


def _asked(rows: pd.DataFrame, row: np.ndarray, cell: np.ndarray) -> Iterator[pd.DataFrame]:
    """A row for each query and cell, in bounded frames: a batch of queries can ask every cell, each time with its vector."""
    ids, q = rows["query_id"].to_numpy(), rows["q"].to_numpy()
    for at in range(0, len(row), ASKED_ROWS):
        part = row[at : at + ASKED_ROWS]
        yield pd.DataFrame({"query_id": ids[part], "q": q[part], "cell": cell[at : at + ASKED_ROWS].astype("int32")})


class Search(NamedTuple):
    hits: DataFrame  # query_id, vec_id, score, rank
    asked: DataFrame  # query_id, cell: what was scored
    cells: Cells

    def share_scored(self) -> float:
        """Part of all query-vector pairs whose score was computed."""
        asked = self.asked.groupBy("cell").agg(F.count("*").alias("n")).toPandas()
        queries = self.asked.select("query_id").distinct().count()
        return float((self.cells.cut.size[asked["cell"]] * asked["n"]).sum() / max(1, self.cells.cut.size.sum() * queries))


def search(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K, centres: int = CENTRES) -> Search:
    """Exact k nearest per query with what it cost; see ``vector_topk_per_query``."""
    q = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("query_vector").alias("q")).filter("q IS NOT NULL")
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("v")).filter("v IS NOT NULL")
    cells, n = Cells.of(v, centres), q.count()
    home = cells.home(q, k)
    first = cut_lineage(top_per_group(cells.score(home, n, k), ["query_id"], k, [F.desc("score"), F.asc("vec_id")]))
    kth = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = cells.others(q.join(kth, "query_id", "left").select("query_id", "q", "kth"), k)
    both = first.drop("rank").unionByName(cells.score(rest, n, k))
    hits = top_per_group(both, ["query_id"], k, [F.desc("score"), F.asc("vec_id")])
    return Search(hits, home.select("query_id", "cell").unionByName(rest.select("query_id", "cell")), cells)


def vector_topk_per_query(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K, centres: int = CENTRES) -> DataFrame:
    """(query_id, vec_id, score, rank): exact k nearest per query, ties by id.

    vectors: (vec_id, embedding); queries: (query_id, query_vector), ids distinct.  All vectors are cut into
    cells around ``centres`` of them, chosen by hashed id.  A query is scored against the cells that
    promise most until they hold k vectors; its k-th score then rules out every cell whose best
    possible score, by the triangle inequality, is lower.  Cells are scored with matrix products in
    bounded blocks that hand on k rows per query, so no list of all pairs exists.  One plan
    serves every number of queries.  Null and zero vectors are no hits and get none.
    """
    return search(vectors, queries, k, centres).hits


def top_per_group(df: DataFrame, keys: Sequence[str], k: int, order) -> DataFrame:
    """Adds ``rank`` and keeps ranks up to k; Spark limits each task to k rows per key before
    the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def filtered_candidates(vectors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Vectors of the candidate documents only, before anything is scored."""
    return vectors.join(candidates.select("document_id").distinct(), "document_id", "left_semi")


def cosine_search(
    vectors: DataFrame, query: Sequence[float], candidates: DataFrame, k: int = DEFAULT_K, id_col: str = "vec_id", row_id: Column | None = None
) -> DataFrame:
    """Payload filter, then the k nearest.

    An id that is computed comes as ``row_id``, to be added as ``id_col`` after the filter: Spark moves
    the filter below the joins that bring in the vectors only if no computed column lies between.
    """
    found = filtered_candidates(vectors, candidates)
    return vector_topk(found if row_id is None else found.withColumn(id_col, row_id), query, k, id_col)


def payload_snippet(pages: DataFrame, entity_types: DataFrame, length: int = 200, text: str = "raw_text") -> DataFrame:
    """Point payload per page."""
    joined = pages.join(entity_types, ["document_id", "page_num"], "left")
    return joined.select(
        "document_id", "page_num", "page_type", F.coalesce("entity_types", F.lit("")).alias("entity_types"),
        "registration_no", F.substring(F.col(text), 1, length).alias("raw_text_snippet"),
    )

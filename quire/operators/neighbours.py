"""Exact k-nearest-neighbour join and majority-vote classification, and an
approximate join by hash tables.

The exact join covers the base by balls: every base vector belongs to the nearest
of a few pivots, a ball's radius is the largest distance to its pivot. In the first
round a query is compared with its own ball, so its k-th distance so far is a true
bound; in the second it visits only the balls that the bound reaches. In both rounds
large balls are cut, and in the second small ones are put together, into shelves of
about ``block_rows`` vectors; queries that visit a shelf are cut into blocks of the
same size. A shelf and a block of queries are one group, so the copies of a vector are
at most the shelves (of a query) or the blocks of queries (of a base vector): a square
grid, the fewest copies that this memory allows where nothing can be pruned. A block
pair is compared in NumPy and only the k best of each query leave the task. Its vectors
are read where Arrow put them, a bounded number of distances is held at once, and freed
memory goes back to the system, so a worker's memory depends on the block alone.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.lookup import lookup
from quire.operators.ordering import top_n_per_group
from quire.session import materialise

# The helpers below travel to the workers with the tasks that call them, so the
# package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 16_384
MAX_PIVOTS = 256
#: Distances held at once (8 MB), and rows whose distances to all pivots are.
_CELLS, _ROWS = 1 << 20, 1 << 11
_MARGIN = 1e-9


def _pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of every row to every pivot, pivot by pivot."""
    return np.stack(
        [np.sqrt(np.square(vectors - pivot).sum(axis=1)) for pivot in pivots], axis=1
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _slices(column: pd.Series):
    """The rows as small matrices (start, vectors)."""
    for start in range(0, len(column), _ROWS):
        yield start, _matrix(column.iloc[start : start + _ROWS])


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a block, copied only if they lie in several pieces."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    width = len(lists[0])
    if lists.null_count or not (lists.value_lengths().to_numpy() == width).all():
        raise ValueError("all vectors must have the same length")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _give_back() -> None:
    """Hand freed memory back to the system: workers live on between groups and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def nearest_in_block(
    query: np.ndarray,
    base: np.ndarray,
    base_ids: np.ndarray,
    k: int,
    apart: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, distance) of the k nearest base rows per query.

    A matrix product gives squared distances up to rounding. Everything within
    the rounding bound of the k-th is then measured directly, so the result is
    that of direct measurement, with ties in id order. ``apart`` has a group per query
    and base row; rows of equal groups are not compared.
    """
    k = min(k, len(base))
    base_sq = np.square(base).sum(axis=1)
    rank_of_id = np.argsort(np.argsort(base_ids, kind="stable"), kind="stable")
    found = []
    chunk = max(1, _CELLS // len(base))
    slack_of = 8.0 * np.finfo(np.float64).eps * base.shape[1]
    for start in range(0, len(query), chunk):
        part = query[start : start + chunk]
        part_sq = np.square(part).sum(axis=1)
        rough = part @ base.T
        rough *= -2.0
        rough += part_sq[:, None]
        rough += base_sq[None, :]
        if apart is not None:
            rough[apart[0][start : start + chunk, None] == apart[1][None, :]] = np.inf
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        slack = slack_of * (part_sq + base_sq.max())
        for row in range(len(part)):
            near = np.flatnonzero((rough[row] <= kth[row] + 2.0 * slack[row]) & (rough[row] < np.inf))
            exact = np.square(base[near] - part[row]).sum(axis=1)
            best = np.lexsort((rank_of_id[near], exact))[:k]
            found.append((start + row, near[best], np.sqrt(exact[best])))
    rows = np.concatenate([np.full(len(cols), row) for row, cols, _ in found])
    return rows, np.concatenate([c for _, c, _ in found]), np.concatenate([d for *_, d in found])


def _grid_join(
    left: DataFrame,
    right: DataFrame,
    key: str | None,
    schema: T.StructType,
    k: int,
    block_rows: int,
    carry: list[str],
    apart: bool = False,
) -> DataFrame:
    """Compare all ``left`` with all ``right`` rows of equal key (all rows without a key),
    block against block.

    Both have id and v (and cell, if rows of equal cells are to be left out). The numbers
    of blocks come from counts by key, which are looked up as a table.
    """

    def number(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))

    if key is None:
        sizes = [max(1, -(-df.count() // block_rows)) for df in (left, right)]
    else:
        parts = materialise(number(left, "_left").join(number(right, "_right"), key), "blocks")

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own block, once per block of the other side."""
        if key is None:
            df = df.withColumns({"_left": F.lit(sizes[0]), "_right": F.lit(sizes[1])})
        else:
            df = lookup(df, parts, key, "id")
        return (
            df.withColumn("_own", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .drop("_left", "_right")
        )

    grid = [*([] if key is None else [key]), "_x", "_y"]
    query = spread(left, "_left", "_right").withColumnsRenamed({"_own": "_x", "_other": "_y"})
    block = spread(right, "_right", "_left").withColumnsRenamed({"_own": "_y", "_other": "_x"})

    names = [f.name for f in schema.fields]

    def compare(query: pa.Table, block: pa.Table) -> pa.Table:
        if not query.num_rows or not block.num_rows:
            columns = [query["id"].slice(0, 0), block["id"].slice(0, 0), pa.array([], pa.float64())]
            return pa.table([*columns, *[block[c].slice(0, 0) for c in carry]], names=names)
        place = np.empty(block.num_rows, np.int64)  # in order of id, null last
        place[pc.sort_indices(block["id"]).to_numpy()] = np.arange(block.num_rows)
        cells = (query["cell"].to_numpy(), block["cell"].to_numpy()) if apart else None
        rows, cols, distance = nearest_in_block(_vectors(query["v"]), _vectors(block["v"]), place, k, cells)
        near = block.select(["id", *carry]).take(pa.array(cols))
        found = pa.table([query["id"].take(pa.array(rows)), near["id"], pa.array(distance), *[near[c] for c in carry]], names=names)
        if query.num_rows * block.num_rows > _CELLS:
            _give_back()
        return found

    return query.groupBy(*grid).cogroup(block.groupBy(*grid)).applyInArrow(compare, schema)


def _best(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "base_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _prepared(
    queries: DataFrame, base: DataFrame, id_col: str, vector: str, carry: list[str]
) -> tuple[DataFrame, DataFrame, T.StructType]:
    """Both sides as written tables (id, v), the base with the carried columns, and the
    schema of a result."""
    clash = {"id", "v", "cell", "query_id", "base_id", "distance", "rank"} & set(carry)
    if clash:
        raise ValueError(f"rename carried columns {sorted(clash)}")
    as_double = F.col(vector).cast("array<double>").alias("v")
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema[id_col].dataType),
            T.StructField("base_id", base.schema[id_col].dataType),
            T.StructField("distance", T.DoubleType()),
            *[T.StructField(c, base.schema[c].dataType) for c in carry],
        ]
    )
    base = materialise(base.select(F.col(id_col).alias("id"), as_double, *carry), "base")
    queries = materialise(queries.select(F.col(id_col).alias("id"), as_double), "queries")
    return queries, base, schema


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    k: int = 5,
    id_col: str = "id",
    vector: str = "vector",
    block_rows: int = BLOCK_ROWS,
    n_pivots: int | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(query_id, base_id, distance, rank[, carried columns of the base]): the k nearest
    base rows of each query by Euclidean distance, equal distances in order of base id.

    Exact for any data. The driver sees only the pivots and a summary of each ball
    (``MAX_PIVOTS`` rows at most). With a base of one block there is one ball and one
    round. Runs small jobs for the pivots and the summaries first.
    """
    carry = list(carry)
    queries, base, schema = _prepared(queries, base, id_col, vector, carry)
    size = base.count()
    if n_pivots is None:
        n_pivots = min(MAX_PIVOTS, 4 * -(-size // block_rows)) if size > block_rows else 1
    if n_pivots <= 1 or size <= k:
        return _best(_grid_join(queries, base, None, schema, k, block_rows, carry), k)

    picked = base.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()
    pivots = np.unique(np.array([row.v for row in picked], dtype=np.float64), axis=0)

    @F.pandas_udf("struct<cell:int,away:double>")
    def nearest_pivot(column: pd.Series) -> pd.DataFrame:
        cell, least = np.zeros(len(column), np.int32), np.zeros(len(column))
        for at, part in _slices(column):
            away = _pivot_distances(part, pivots)
            cell[at : at + len(part)], least[at : at + len(part)] = away.argmin(axis=1), away.min(axis=1)
        return pd.DataFrame({"cell": cell, "away": least})

    placed = materialise(
        base.withColumn("p", nearest_pivot("v")).select(*base.columns, "p.cell", "p.away"), "placed"
    )
    balls = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    count = np.zeros(len(pivots), np.int64)
    radius = np.full(len(pivots), -np.inf)
    for row in balls:
        count[row.cell], radius[row.cell] = row.n, row.radius
    # Only a ball of k vectors gives a bound; without one, queries visit every ball.
    full = np.flatnonzero(count >= k)

    @F.pandas_udf("int")
    def own_ball(column: pd.Series) -> pd.Series:
        found = [full[_pivot_distances(part, pivots)[:, full].argmin(axis=1)] for _, part in _slices(column)]
        return pd.Series(np.concatenate([[], *found]).astype("int32"))

    between = _pivot_distances(pivots, pivots)
    shelf_of, shelves_of = _shelves(count, block_rows)
    if full.size:
        homes = materialise(queries.withColumn("cell", own_ball("v")), "homes")
        first = materialise(
            _best(_grid_join(homes, placed.drop("away"), "cell", schema, k, block_rows, carry), k), "first-round"
        )
        bounds = first.groupBy(F.col("query_id").alias("id")).agg(F.max("distance").alias("bound"))
        asking = homes.join(bounds, "id")
    else:
        first = None
        asking = queries.withColumns({"cell": F.lit(-1), "bound": F.lit(float("inf"))})

    @F.pandas_udf("array<int>")
    def shelves_to_visit(column: pd.Series, cell: pd.Series, bound: pd.Series) -> pd.Series:
        return pd.Series([shelves for at, part in _slices(column) for shelves in visited(at, part, cell.to_numpy(), bound.to_numpy())])

    def visited(at: int, part: np.ndarray, cell: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
        away = _pivot_distances(part, pivots)
        own, reach = cell[at : at + len(part)], bound[at : at + len(part), None]
        nearest = away.argmin(axis=1)
        gap = between[nearest]
        near = away[np.arange(len(away)), nearest][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(gap > 0, (away**2 - near**2) / (2.0 * gap), 0.0)
        low = np.maximum(np.maximum(away - radius, plane), 0.0)
        visit = (low <= reach * (1.0 + _MARGIN) + _MARGIN) & (count > 0)
        held = np.flatnonzero(own >= 0)
        visit[held, own[held]] = False
        return [_visited(row, shelf_of, shelves_of) for row in visit]

    on_shelf = F.get(F.array(*[F.lit(int(x)) for x in shelf_of]), F.col("cell")) + F.pmod(
        F.xxhash64("id"), F.get(F.array(*[F.lit(int(x)) for x in shelves_of]), F.col("cell"))
    ).cast("int")
    left = asking.withColumn("shelf", F.explode(shelves_to_visit("v", "cell", "bound"))).drop("bound")
    right = placed.drop("away").withColumn("shelf", on_shelf)
    second = _grid_join(materialise(left, "visits"), right, "shelf", schema, k, block_rows, carry, apart=True)
    return _best(second if first is None else first.drop("rank").unionByName(second), k)


def _shelves(count: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shelf, number of shelves) of every ball: large balls have several shelves,
    small ones share one of at most ``block_rows`` vectors."""
    first, many = np.zeros(count.size, np.int64), np.ones(count.size, np.int64)
    now, room = 0, block_rows
    for ball, n in enumerate(count.tolist()):
        if n > block_rows:
            many[ball] = -(-n // block_rows)
            first[ball], now, room = now + 1, now + 1 + int(many[ball]), block_rows
        else:
            if n > room:
                now, room = now + 1, block_rows
            first[ball] = now
            room -= n
    return first, many


def _visited(balls: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The shelves of the marked balls, each once."""
    hit = np.flatnonzero(balls)
    starts, sizes = first[hit], many[hit]
    every = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return np.unique(every).astype("int32")


def knn_approximate(
    queries: DataFrame,
    base: DataFrame,
    width: float,
    k: int = 5,
    tables: int = 8,
    hashes: int = 4,
    seed: int = 5,
    id_col: str = "id",
    vector: str = "vector",
    block_rows: int = BLOCK_ROWS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Like ``knn_join``, but a query is compared only with base rows that share a bucket
    with it in one of ``tables`` hash tables, by their true distances.

    A bucket is ``hashes`` numbers floor((a v + b) / width) with normal a (2-stable, so
    near vectors fall together more often than far ones). A query may find fewer than k
    rows, or others than the nearest: measure the recall on a sample before use. Wider
    buckets and more tables raise it. Large buckets are cut into blocks on both sides.
    """
    carry = list(carry)
    queries, base, schema = _prepared(queries, base, id_col, vector, carry)
    opening = base.select("v").first()
    if opening is None:
        return _best(base.sparkSession.createDataFrame([], schema), k)
    draw = np.random.default_rng(seed)
    slopes = draw.normal(size=(len(opening.v), tables * hashes))
    shifts = draw.uniform(0, width, size=tables * hashes)

    @F.pandas_udf("array<string>")
    def buckets(column: pd.Series) -> pd.Series:
        found = []
        for _, part in _slices(column):
            places = np.floor((part @ slopes + shifts) / width).astype(np.int64)
            found += [[f"{t}:" + ",".join(map(str, row[t * hashes : (t + 1) * hashes])) for t in range(tables)] for row in places]
        return pd.Series(found)

    left, right = (
        materialise(df.withColumn("bucket", F.explode(buckets("v"))), "buckets") for df in (queries, base)
    )
    found = _grid_join(left, right, "bucket", schema, k, block_rows, carry)
    return _best(found.dropDuplicates(["query_id", "base_id"]), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall): the share of the exact neighbours that were found."""
    pairs = ["query_id", "base_id"]
    hit = found.select(*pairs, F.lit(1).alias("hit"))
    return exact.join(hit, pairs, "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def knn_classify(
    queries: DataFrame,
    base: DataFrame,
    label: str,
    k: int = 5,
    id_col: str = "id",
    vector: str = "vector",
    **blocks,
) -> DataFrame:
    """(id, prediction): majority class of the k nearest; the smallest class
    wins a tie."""
    labelled = base.select(id_col, vector, F.col(label).alias("vote"))
    near = knn_join(queries, labelled, k, id_col, vector, carry=("vote",), **blocks)
    votes = near.groupBy("query_id", "vote").agg(F.count("*").alias("n"))
    return top_n_per_group(votes, "query_id", "n", "vote", 1).select(
        F.col("query_id").alias(id_col), F.col("vote").alias("prediction")
    )

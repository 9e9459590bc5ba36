"""Searches over vectors: multiprobe p-stable hashing, and exact top-k by a three-phase uniform threshold."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgrisk.llm.common import arrow_map
from msgrisk.session import materialize


def usable(table: DataFrame, id_column: str, vector_column: str, nonzero: bool) -> DataFrame:
    """(id, vec) of the rows that take part: a key, and only finite components (and one that is not 0, if asked).

    Of rows that share a key the one with the least vector stays, so repeated rows count once.
    """
    vec = F.col(vector_column).cast("array<double>")
    sound = F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & ~F.exists(
        vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    if nonzero:
        sound = sound & F.exists(vec, lambda x: x != 0)
    return table.where(F.coalesce(sound, F.lit(False))).groupBy(F.col(id_column).cast("long").alias("id")).agg(F.min(vec).alias("vec"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as one matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, equal ones by smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))][:k]
    return np.lexsort((ids, -scores))[:k]


# --- exact top-k ------------------------------------------------------------------------


def quantized(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as integers; Python's own beyond 2**31, so that no product overflows."""
    whole = np.floor(vectors * scale)
    if whole.size and np.abs(whole).max() >= 1 << 31:
        return np.asarray([[int(x) for x in row] for row in whole.tolist()], dtype=object)
    return whole.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products a b^T: in doubles while every sum stays below 2**53."""
    if a.dtype == object or b.dtype == object:
        return np.asarray(a.astype(object) @ b.astype(object).T, dtype=object)
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if top < 1 << 62 else np.asarray(a.astype(object) @ b.astype(object).T, dtype=object)


def _blocks(vectors: DataFrame, queries: DataFrame, extra: list[str], rows: int, asked: int) -> DataFrame:
    """Every block of queries beside every block of rows; both sizes are bounded, whatever the table's size."""
    across, down = max(1, -(-vectors.count() // rows)), max(1, -(-queries.count() // asked))
    dim = F.size("vec")
    place = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    none = [F.lit(None).cast("long").alias(c) for c in extra]
    data = vectors.select(dim.alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("qb"), place(across, 1).alias("db"), F.lit(0).alias("kind"), "id", "vec", *none)
    ask = queries.select(dim.alias("dim"), place(down, 2).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("db"), F.lit(1).alias("kind"), "id", "vec", *extra)
    return data.unionByName(ask)


def exact_top_k(
    table: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20,
    scale: float = 64.0, lists: int = 4, rows: int = 16_384, asked: int = 2_048,
) -> DataFrame:
    """The ``k`` highest integer inner products of each query's quantized vector with all other rows' vectors.

    A score is the sum of ``lists`` parts over stretches of components, each a scored list of its own.

    1. Every block of rows gathers the best entries of each local list and scores them in full; the k-th best score
       of a query over all blocks is its cutoff: no score below can be among the k best.
    2. The cutoff goes back to all blocks. A score of at least the cutoff has a part of at least cutoff / lists in some
       list, so the entries at or above that in any list are sufficient.
    3. Their remaining parts are resolved exactly; those that reach the cutoff are ranked.

    Rows with a null key or a null, or with a null or non-finite component, take no part; repeated keys count once;
    vectors are compared with those of their own length. Ties go to the smaller key. A query with fewer than ``k``
    others gets them all; without others it has no row. Result: query_id, rank, the key column, score (long, held at
    the ends of its range if the exact sum lies outside).
    """
    vectors = materialize(usable(table, id_column, vector_column, nonzero=False))
    asking = vectors.join(queries.select(F.col(id_column).cast("long").alias("id")).where("id IS NOT NULL").distinct(), "id", "left_semi")
    low, high = -(1 << 63), (1 << 63) - 1

    def parts(q: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        edges = np.linspace(0, q.shape[1], lists + 1).astype(int)
        return [products(q[:, a:b], x[:, a:b]) for a, b in zip(edges[:-1], edges[1:])]

    def block(group: pa.Table, second: bool) -> pa.Table:
        kind = group.column("kind").to_numpy()
        ids = group.column("id").to_numpy()
        vec = group.column("vec").combine_chunks()
        x_rows, q_rows = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        out: list[tuple] = []
        if len(x_rows) and len(q_rows):
            x = quantized(matrix(vec.take(pa.array(x_rows))), scale)
            q = quantized(matrix(vec.take(pa.array(q_rows))), scale)
            x_ids, q_ids = ids[x_rows], ids[q_rows]
            cuts = group.column("cutoff").to_pylist() if second else []
            for a in range(0, len(q), 256):
                split = parts(q[a : a + 256], x)
                whole = sum(split[1:], split[0])
                for i in range(whole.shape[0]):
                    other = x_ids != q_ids[a + i]
                    if second:
                        cutoff = cuts[q_rows[a + i]]
                        if cutoff is None:  # fewer than k others
                            near = other
                        else:
                            near = np.zeros(len(x), dtype=bool)
                            for part in split:
                                near |= part[i] * lists >= cutoff
                            near &= other & (whole[i] >= cutoff)
                        near = np.flatnonzero(near)
                    else:
                        near = np.unique(np.concatenate([np.argpartition(-part[i], min(k, len(x) - 1))[: k + 1] for part in split]))
                        near = near[other[near]]
                    best = near[best_rows(whole[i][near], x_ids[near], k)]
                    out += [(int(q_ids[a + i]), int(x_ids[j]), min(max(int(whole[i][j]), low), high)) for j in best]
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(("query_id", "id", "score"), columns)})

    schema = "query_id long, id long, score long"
    keys = ["dim", "qb", "db"]
    first = _blocks(vectors, asking, [], rows, asked)
    listed = first.groupBy(*keys).applyInArrow(lambda t: block(t, False), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    cutoffs = listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cutoff"))
    second = _blocks(vectors, asking.join(materialize(cutoffs), "id", "left"), ["cutoff"], rows, asked)
    found = second.groupBy(*keys).applyInArrow(lambda t: block(t, True), schema)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_column), "score")


# --- approximate neighbours -------------------------------------------------------------


def perturbations(functions: int, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """All shifts of up to ``most`` hash values by one: which boundary distances each adds up, and the shifts."""
    shifts = [np.zeros(functions, dtype=np.int64)]
    for r in range(1, min(most, functions) + 1):
        for at in itertools.combinations(range(functions), r):
            for signs in itertools.product((-1, 1), repeat=r):
                shift = np.zeros(functions, dtype=np.int64)
                shift[list(at)] = signs
                shifts.append(shift)
    moves = np.asarray(shifts)
    return np.concatenate([moves < 0, moves > 0], axis=1).astype(np.float64), moves


class StableHash:
    """``tables`` times ``functions`` hashes floor((a . v + b) / width) with normal a: near vectors share values."""

    def __init__(self, dim: int, tables: int, functions: int, width: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.slopes = rng.normal(size=(tables, dim, functions))
        self.offsets = rng.random((tables, functions)) * width
        self.mixers = rng.integers(1, 1 << 62, size=(tables, functions)) | 1
        self.width = width

    def values(self, table: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = (vectors @ self.slopes[table] + self.offsets[table]) / self.width
        cell = np.floor(raw)
        return cell.astype(np.int64), raw - cell

    def keys(self, table: int, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells * self.mixers[table]).sum(-1) * 64 + table


def nearest_neighbours(
    table: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20,
    tables: int = 4, functions: int = 6, width: float = 2.0, probes: int = 80, seed: int = 7, unit_rows: int = 50_000,
) -> DataFrame:
    """The ``k`` rows of largest inner product found for each query by multiprobe p-stable hashing.

    Rows get one more component so that all have the length of the longest vector, and queries are brought to length
    1: then the nearest row is the one of largest inner product. Each row lies in one bucket of each hash table. A
    query visits its own bucket and those next to it in the order of estimated success, the least sum of squared
    distances to the crossed boundaries first, ``probes`` in each table. The rows met there are merged and reranked by
    the inner product of the original vectors in double precision.

    Buckets are dealt out to units by hash; a unit of more than ``unit_rows`` rows is split by row key and its queries
    are repeated, so a bucket of any size is searched whole. Null, zero, or partly null or non-finite vectors, and rows
    with a null key, take no part; repeated keys count once; vectors meet those of their own length only. A query that
    met fewer than ``k`` rows is run against all rows. Ties go to the smaller key. Result: query_id, rank, key, score.
    ``width`` is in units of the longest vector: wider cells and more probes find more and cost more.
    """
    vectors = materialize(usable(table, id_column, vector_column, nonzero=True).withColumn(
        "norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    ))
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).first()
    total, longest = facts["n"], facts["norm"] or 1.0
    asking = vectors.join(queries.select(F.col(id_column).cast("long").alias("id")).where("id IS NOT NULL").distinct(), "id", "left_semi")
    units = max(8, -(-total * tables // unit_rows))

    def lengthened(vec: np.ndarray, norm: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.concatenate([vec / norm[:, None], np.zeros((len(vec), 1))], axis=1)
        return np.concatenate([vec / longest, np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))[:, None]], axis=1)

    def by_length(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            dims = batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                yield d, part.column("id").to_numpy(), part.column("norm").to_numpy(), part.column("vec"), matrix(part.column("vec"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for d, ids, norm, raw, vec in by_length(batches):
            hashing = StableHash(d + 1, tables, functions, width, seed)
            longer = lengthened(vec, norm, False)
            for t in range(tables):
                keys = hashing.keys(t, hashing.values(t, longer)[0])
                yield {"unit": np.abs(keys % units), "id": ids, "keys": [[x] for x in keys.tolist()], "vec": raw}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        weights, moves = perturbations(functions)
        visits = min(probes, len(moves))
        for d, ids, norm, _, vec in by_length(batches):
            hashing = StableHash(d + 1, tables, functions, width, seed)
            longer = lengthened(vec, norm, True)
            visited = []
            for t in range(tables):
                cells, inside = hashing.values(t, longer)
                costs = np.concatenate([inside**2, (1 - inside) ** 2], axis=1) @ weights.T
                chosen = np.argsort(costs, axis=1, kind="stable")[:, :visits]
                visited.append(hashing.keys(t, cells[:, None, :] + moves[chosen]))
            keys = np.concatenate(visited, axis=1)
            where = np.abs(keys % units)
            out: dict[str, list] = {"unit": [], "id": [], "keys": [], "vec": []}
            for i, own in enumerate(ids.tolist()):
                for u in np.unique(where[i]).tolist():
                    out["unit"].append(u)
                    out["id"].append(own)
                    out["keys"].append(np.unique(keys[i][where[i] == u]).tolist())
                    out["vec"].append(vec[i].tolist())
            yield out

    shape = "unit int, id long, keys array<long>, vec array<double>"
    indexed = materialize(arrow_map(vectors, index, shape))
    # One row for each unit, a fixed share of the rows divided by unit_rows.
    splits = F.broadcast(indexed.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / unit_rows).cast("int").alias("parts")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        current = None
        keys = x = x_ids = None
        pending: list[pa.RecordBatch] = []

        def load() -> None:
            nonlocal keys, x, x_ids
            data = pa.Table.from_batches(pending).combine_chunks()
            pending.clear()
            flat = data.column("keys").combine_chunks().flatten().to_numpy()
            order = np.argsort(flat, kind="stable")
            keys, x_ids = flat[order], data.column("id").to_numpy()[order]
            x = data.column("vec").combine_chunks()
            x = x.take(pa.array(order))
            lengths = x.value_lengths().to_numpy()
            x = {d: (np.flatnonzero(lengths == d), matrix(x.filter(pa.array(lengths == d)))) for d in np.unique(lengths).tolist()}

        def answer(batch: pa.RecordBatch) -> Iterator[dict]:
            ids = batch.column("id").to_numpy()
            lists = batch.column("keys")
            count = lists.value_lengths().to_numpy()
            asked = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(ids)), count)
            dims = batch.column("vec").value_lengths().to_numpy()
            got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for d, (rows, vec) in x.items():
                mine = np.flatnonzero(dims == d)
                if not len(mine):
                    continue
                q = matrix(batch.column("vec").filter(pa.array(dims == d)))
                slot = np.full(len(ids), -1)
                slot[mine] = np.arange(len(mine))
                own_keys, own_ids = keys[rows], x_ids[rows]
                ok = np.flatnonzero(slot[owner] >= 0)
                ok = ok[np.argsort(asked[ok], kind="stable")]
                visited, starts = np.unique(asked[ok], return_index=True)
                low, high = np.searchsorted(own_keys, visited, "left"), np.searchsorted(own_keys, visited, "right")
                jobs = [
                    (a, b, vec, own_ids, slot[owner[ok[i:j]]])
                    for a, b, i, j in zip(low.tolist(), high.tolist(), starts.tolist(), [*starts[1:].tolist(), len(ok)]) if b > a
                ]
                everywhere = np.flatnonzero((count == 0) & (slot >= 0))
                if len(everywhere):  # these are run against all rows, each of which is in one bucket of the first table
                    once = own_keys % 64 == 0
                    jobs.append((0, int(once.sum()), vec[once], own_ids[once], slot[everywhere]))
                for a, b, of, of_ids, who in jobs:
                    for c in range(a, b, 8192):
                        part, part_ids = of[c : min(b, c + 8192)], of_ids[c : min(b, c + 8192)]
                        rough = q[who] @ part.T
                        for i, w in enumerate(who.tolist()):
                            near = np.arange(len(part_ids))
                            if len(near) > 2 * k:
                                edge = np.partition(rough[i], len(near) - k - 1)[len(near) - k - 1]
                                near = np.flatnonzero(rough[i] >= edge - 1e-9 * (1 + abs(edge)))
                            near = near[part_ids[near] != ids[mine[w]]]
                            if len(near):
                                exact = (part[near] * q[w]).sum(1)  # the same sum for equal vectors, wherever they lie
                                best = best_rows(exact, part_ids[near], k)
                                got.append((np.full(len(best), ids[mine[w]]), part_ids[near][best], exact[best]))
            if got:
                query, found, score = (np.concatenate(c) for c in zip(*got))
                order = np.lexsort((found, -score, query))
                query, found, score = query[order], found[order], score[order]
                same = np.concatenate([[False], (query[1:] == query[:-1]) & (found[1:] == found[:-1])])
                query, found, score = query[~same], found[~same], score[~same]
                first = np.searchsorted(query, query, "left")
                top = np.arange(len(query)) - first < k
                yield {"query_id": query[top], "id": found[top], "score": score[top]}

        for batch in batches:
            place = batch.column("unit").to_numpy().astype(np.int64) << 32 | batch.column("part").to_numpy()
            kind = batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.diff(place) | np.diff(kind)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(place)]):
                if place[a] != current:
                    current, keys = place[a], None
                    pending.clear()
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    pending.append(part)
                    continue
                if pending:
                    load()
                if keys is not None:
                    yield from answer(part)

    def run(asked: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        data = indexed.join(splits, "unit").select("unit", part.alias("part"), F.lit(0).alias("kind"), "id", "keys", "vec")
        ask = asked.join(splits, "unit").select("unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "id", "keys", "vec")
        both = data.unionByName(ask).repartition("unit", "part").sortWithinPartitions("unit", "part", "kind")
        met = arrow_map(both, search, "query_id long, id long, score double")
        return met.groupBy("query_id", "id").agg(F.max("score").alias("score"))

    found = run(arrow_map(asking, probe, shape))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    enough = ranked.groupBy("query_id").count().where(F.col("count") >= min(k, max(total - 1, 0)))
    short = materialize(asking.join(enough, asking["id"] == enough["query_id"], "left_anti"))
    if short.limit(1).count():
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit")
        rest = run(short.select(everywhere, "id", F.array().cast("array<long>").alias("keys"), "vec"))
        whole = rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = ranked.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(whole)
    return ranked.select("query_id", "rank", F.col("id").alias(id_column), "score")

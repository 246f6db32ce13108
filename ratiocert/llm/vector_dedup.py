"""Near-duplicate vectors by product quantisation over coarse inverted lists.

A bounded sample gives coarse centres and, of the residuals, a code book per subspace. Every vector is indexed: it is a member
of the list of its nearest centre, with its residual's codes and the error they leave. As a query it visits its nearest lists,
as far as a vector within the wanted distance can lie in them (bisecting planes). There the distance to each member's
codes comes from a table per query; members that cannot be ruled out, given their stored error, are compared exactly.
So pairs are lost only where one's list is not among the other's ``probes`` nearest, and the other way round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import checked_broadcast
from ..session import cut_lineage
from .base import bounded, bounded_sample
from .components import components

SAMPLE = 20_000  # at most so many vectors fit centres and code books; there are at most SAMPLE / 16 lists
PROBES = 16
BLOCK = 4096  # members, and queries, that meet in one group
SUBSPACES, CODES = 8, 256


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    at = d.argmin(1)
    return at, np.sqrt(np.maximum(d[np.arange(len(x)), at], 0))


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from distinct random rows; an empty centre moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at, d = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[np.argsort(-d, kind="stable")[:len(empty)]]
    return centres


@dataclass
class Index:
    centres: np.ndarray
    books: list[np.ndarray]
    parts: list[slice]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and the norm of what the codes leave out."""
        home, _ = _nearest(x, self.centres)
        residual = x - self.centres[home]
        codes = np.stack([_nearest(residual[:, p], b)[0] for p, b in zip(self.parts, self.books, strict=True)], 1)
        return home, codes.astype(np.uint8), np.linalg.norm(residual - self.decode(codes), axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)

    def probes(self, x: np.ndarray, reach: float, most: int) -> list[np.ndarray]:
        """Lists to visit: of the ``most`` nearest, those whose cell comes within ``reach`` of the vector."""
        d2 = (x**2).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(1)
        near = np.argsort(d2, 1, kind="stable")[:, :most]
        rows = np.arange(len(x))[:, None]
        home = near[:, :1]
        apart = np.linalg.norm(self.centres[near] - self.centres[home], axis=2)
        plane = (d2[rows, near] - d2[rows, home]) / np.maximum(2 * apart, 1e-12)
        return [n[ok] for n, ok in zip(near, plane <= reach + 1e-9, strict=True)]

    def table(self, q: np.ndarray, of: int) -> list[np.ndarray]:
        """Squared distances of the queries' residuals from every code of each subspace."""
        residual = q - self.centres[of]
        return [
            np.maximum((residual[:, p] ** 2).sum(1)[:, None] - 2 * residual[:, p] @ b.T + (b**2).sum(1), 0)
            for p, b in zip(self.parts, self.books, strict=True)
        ]


def fit_index(x: np.ndarray, lists: int, seed: int = 3) -> Index:
    dims = x.shape[1]
    edge = np.linspace(0, dims, min(SUBSPACES, dims) + 1).astype(int)
    parts = [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    centres = k_means(x, max(1, lists), seed)
    residual = x - centres[_nearest(x, centres)[0]]
    return Index(centres, [k_means(residual[:, p], CODES, seed + 1 + j) for j, p in enumerate(parts)], parts)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable over the pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return _scaled(flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1)))


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links(distinct: DataFrame, cosine: float, sample: int, probes: int, seed: int) -> DataFrame:
    """(node, links, other): for each vector the copies of others that it is linked with, and edges to components' ends."""
    total = distinct.count()
    taken = bounded_sample(distinct, total, sample, "node").select("v").toArrow().column("v").combine_chunks()
    index = fit_index(_unit(taken), min(int(total**0.5), sample // 16), seed)
    sent = distinct.sparkSession.sparkContext.broadcast(index)
    reach = float(np.sqrt(max(2 - 2 * cosine, 0.0)))
    # Vectors travel as they are stored and are scaled where they meet.
    sort = np.float32 if distinct.schema["v"].dataType.elementType.simpleString() == "float" else np.float64

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("v"))
            home, codes, left = index.encode(x)
            visits = index.probes(x, reach, probes)
            n = np.array([len(v) for v in visits])
            row = np.repeat(np.arange(len(x)), n)
            at = np.concatenate(visits)
            stored = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(sort).reshape(len(x), -1)
            packed = [v.tobytes() for v in stored]
            lists = pa.array([v.astype(np.int32).tobytes() for v in visits], pa.binary())
            for query in (True, False):
                r = row if query else np.arange(len(x))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((at if query else home).astype(np.int64)), pa.array([query] * len(r), pa.bool_()), batch.column("node").take(pa.array(r)),
                     batch.column("copies").take(pa.array(r)), pa.array([packed[i] for i in r], pa.binary()),
                     pa.array([codes[i].tobytes() for i in r], pa.binary()), pa.array(left[r]), pa.array(home[r].astype(np.int64)), lists.take(pa.array(r))],
                    names=["list", "query", "node", "copies", "v", "codes", "left", "home", "visits"],
                )

    placed = cut_lineage(distinct.select("node", "copies", "v").mapInArrow(
        place, "list bigint, query boolean, node bigint, copies bigint, v binary, codes binary, left double, home bigint, visits binary"
    ))
    size = placed.groupBy("list").agg(
        F.ceil(F.sum((~F.col("query")).cast("int")) / BLOCK).cast("int").alias("members"),
        F.ceil(F.sum(F.col("query").cast("int")) / BLOCK).cast("int").alias("queries"),
    ).where("members > 0 AND queries > 0")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("query"), F.col("queries")).otherwise(F.col("members"))).cast("int")
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("members")).otherwise(F.col("queries")) - 1))
    dealt = placed.join(checked_broadcast(size), "list").withColumn("own", own).withColumn("across", across).withColumns({
        "mb": F.when(F.col("query"), F.col("across")).otherwise(F.col("own")),
        "qb": F.when(F.col("query"), F.col("own")).otherwise(F.col("across")),
    })

    def search(group: pd.DataFrame) -> pd.DataFrame:
        index = sent.value
        is_query = group["query"].to_numpy(bool)
        members, queries = group[~is_query], group[is_query]
        none = pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
        if not len(members) or not len(queries):
            return none
        of = int(group["list"].iloc[0])
        m, q = (_scaled(np.frombuffer(b"".join(g["v"]), sort).reshape(len(g), -1)) for g in (members, queries))
        codes = np.frombuffer(b"".join(members["codes"]), np.uint8).reshape(len(members), -1)
        bound = (reach + members["left"].to_numpy() + 1e-6) ** 2
        m_id, q_id = members["node"].to_numpy(), queries["node"].to_numpy()
        # A pair that also meets the other way round (the query's list is among the member's) counts once only.
        visits, q_home = [set(np.frombuffer(v, np.int32).tolist()) for v in members["visits"]], queries["home"].to_numpy()
        meets = {h: np.array([h in v for v in visits]) for h in np.unique(q_home).tolist()}
        left, right = [], []
        for lo in range(0, len(q), 256):
            part = q[lo:lo + 256]
            far = np.zeros((len(part), len(m)))
            for j, t in enumerate(index.table(part, of)):
                far += t[:, codes[:, j]]
            both_ways = np.stack([meets[h] for h in q_home[lo:lo + 256].tolist()])
            open_ = (far <= bound) & (q_id[lo:lo + 256, None] != m_id) & ~(both_ways & (q_id[lo:lo + 256, None] > m_id))
            a, b = np.nonzero(open_)
            for k in range(0, len(a), 1 << 17):
                x, y = a[k:k + (1 << 17)], b[k:k + (1 << 17)]
                near = np.einsum("ij,ij->i", part[x], m[y]) >= cosine
                left.append(lo + x[near])
                right.append(y[near])
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
        if not len(a):
            return none
        ids, where = np.unique(np.concatenate([q_id, m_id]), return_inverse=True)
        pa_, pb = where[:len(q)][a], where[len(q):][b]
        links = np.bincount(pa_, members["copies"].to_numpy()[b], len(ids)) + np.bincount(pb, queries["copies"].to_numpy()[a], len(ids))
        label = _labels(len(ids), pa_, pb)
        some = links > 0
        return pd.DataFrame({"node": ids[some], "links": links[some].astype(np.int64), "other": ids[label[some]]})

    # Partitioned by the list alone, all blocks of a list would be in one task.
    return dealt.repartition("list", "mb", "qb").groupBy("list", "mb", "qb").applyInPandas(search, "node bigint, links bigint, other bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95,
                 sample: int = SAMPLE, probes: int = PROBES, seed: int = 3) -> DataFrame:
    """(id, n_links, component_id, kept): how many other rows each vector is linked with (cosine, in double precision, of at
    least ``cosine``), the smallest id reachable over links, and whether that is its own.

    Equal vectors are one vertex of the search and link with each other. Vectors that are null, empty or zero, or hold null or
    non-finite components link with nothing, and vectors of different sizes not with each other. Rows that share an id
    count as rows, but are one vertex; a null id links with nothing and gets null. Other columns are not kept, so that none
    can clash. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bounded(spark)
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.coalesce(sound, F.lit(False)) & F.col(id_col).isNotNull(), v).alias("v"))
    rows = cut_lineage(rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v"), "dims": F.size("v")}))
    copies = cut_lineage(rows.where("v IS NOT NULL").groupBy("h1", "h2", "dims").agg(
        F.min("id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v")
    ))
    found: DataFrame | None = None
    for (dims,) in copies.select("dims").distinct().orderBy("dims").collect():
        part = _links(copies.where(F.col("dims") == dims).select("node", "copies", "v"), cosine, sample, probes, seed)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "node bigint, links bigint, other bigint")
    found = cut_lineage(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    vertex = copies.select("h1", "h2", "dims", "node", "copies").join(links, "node", "left").join(reached, "node", "left")
    out = rows.select("id", "h1", "h2", "dims", F.col("v").isNotNull().alias("sound")).join(
        vertex.withColumn("sound", F.lit(True)), ["h1", "h2", "dims", "sound"], "left"
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id"))
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("sound"), F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("id") == component).alias("kept"),
    )

"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference vectors (pivots) in order of nearness.  An inverted list for each
label and pivot holds the vectors that have it among their nearest.  All vectors that meet in a list are
compared, by cosine in double precision; a link counts in the list of the lowest pivot that its ends share only.

Pivots are kept apart, so that a dense group has one or two of its own and its members agree on them.  A vector needs no
pivot that is further than its nearest one by more than twice the angle of a link: what it links with has
its own nearest pivot within that bound.  So no link is missed of a vector with ``NEAREST`` pivots or fewer within
the bound, as in a dense group; between two vectors with more of them, links are found by the nearest ``NEAREST``, not provably all.

The number of pivots follows the square root of the number of vectors, so that lists grow as its square root
as well.  Long lists, as around many near copies, are compared in blocks; cells hand on counts of links and the
components they found, not the links themselves.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm import common
from runloom.session import stored

COSINE = 0.98
#: Pivots for each square root of a vector, and the most that are fitted (a bounded sample of the table).
PIVOTS_PER_ROOT = 2.0
MOST_PIVOTS = 8192
#: Cosine above which two vectors are not both pivots.
APART = 0.9
#: Nearest pivots kept for each vector.
NEAREST = 8
#: Added to the bound on angles, which are computed in single precision.
SLACK = 0.01
_KEYS = ["label", "dim", "pivot"]


def _pivots(nodes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """At most ``count`` vectors for each dimension, kept apart, from a sample of twice as many by hash order."""
    sample = min(2 * count, MOST_PIVOTS)
    chosen = nodes.select("dim", "embedding").orderBy(F.xxhash64("embedding"), "node").limit(sample).collect()
    by: dict[int, list] = defaultdict(list)
    for r in chosen:
        by[r["dim"]].append(r["embedding"])
    return {d: _apart(_unit(np.array(v, dtype=np.float64)).astype(np.float32), count) for d, v in by.items()}


def _apart(unit: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` rows that are not near one taken before."""
    taken, n = np.empty((min(count, len(unit)), unit.shape[1]), dtype=unit.dtype), 0
    for row in unit:
        if n == len(taken):
            break
        if not n or (taken[:n] @ row).max() <= APART:
            taken[n] = row
            n += 1
    return taken[:n]


def _unit(rows: np.ndarray) -> np.ndarray:
    # scaled first, so that neither very large nor very small components lose their square
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _nearest(unit: np.ndarray, pivots: np.ndarray, nearest: int, cosine: float) -> np.ndarray:
    """The nearest pivots of each vector in order; -1 in place of those out of the bound."""
    k = min(nearest, len(pivots))
    near = unit.astype(np.float32) @ pivots.T
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
    top = np.take_along_axis(top, order, axis=1)
    angle = np.arccos(np.clip(np.take_along_axis(near, top, axis=1), -1, 1))
    return np.where(angle <= angle[:, :1] + 2 * math.acos(max(-1.0, min(1.0, cosine))) + SLACK, top, -1)


def _postings(pivots: dict[int, np.ndarray], nearest: int, cosine: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (dim,), rows in batch.groupby(["dim"]):
                unit = _unit(np.stack(rows["embedding"].to_numpy()).astype(np.float64))
                if dim in pivots:
                    top = _nearest(unit, pivots[dim], nearest, cosine)
                else:
                    top = np.zeros((len(rows), 1), dtype=np.int64)
                found = pd.DataFrame({
                    "label": rows["label"].to_numpy(), "dim": dim, "pivot": 0, "node": rows["node"].to_numpy(),
                    "copies": rows["copies"].to_numpy(), "near": [t.astype("<i4").tobytes() for t in top],
                    "vector": [u.astype("<f8").tobytes() for u in unit]})
                for c in range(top.shape[1]):
                    yield found.assign(pivot=top[:, c])[top[:, c] >= 0]

    return run


def _links(cosine: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, start in common.cells(batches, _KEYS):
            out = []
            for a, b in zip(start, np.append(start[1:], len(frame))):
                if b - a < 2:
                    continue
                rows = frame.iloc[a:b]
                node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
                near = np.frombuffer(b"".join(rows["near"]), dtype="<i4").reshape(b - a, -1)
                unit = np.frombuffer(b"".join(rows["vector"]), dtype="<f8").reshape(b - a, -1)
                near = near[:, (near >= 0).any(axis=0)]
                close = np.triu(unit @ unit.T >= cosine - 1e-9, 1)  # the sum below decides
                if rows["_lo"].iloc[0] != rows["_hi"].iloc[0]:
                    own = rows["_own"].to_numpy()
                    close &= own[:, None] != own[None, :]
                i, j = np.nonzero(close)
                good = np.zeros(len(i), dtype=bool)
                for at in range(0, len(i), 1 << 16):
                    s = slice(at, at + (1 << 16))
                    good[s] = np.einsum("ij,ij->i", unit[i[s]], unit[j[s]]) >= cosine
                i, j = i[good], j[good]
                # the pair belongs to the lowest pivot it shares
                pivot = rows["pivot"].iloc[0]
                first = np.full(len(i), np.iinfo(np.int32).max, dtype=np.int64)
                for c in range(near.shape[1]):
                    has = (near[j] == near[i, c][:, None]).any(axis=1) & (near[i, c] >= 0)
                    first = np.where(has, np.minimum(first, near[i, c]), first)
                i, j = i[first == pivot], j[first == pivot]
                if len(i):
                    links = np.bincount(i, copies[j], b - a) + np.bincount(j, copies[i], b - a)
                    root = common.star_labels(i, j, b - a)
                    at = np.flatnonzero(links)
                    out.append(pd.DataFrame({
                        "node": node[at], "links": links[at].astype(np.int64), "root": node[root[at]]}))
            if out:
                yield pd.concat(out)

    return run


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, pivots_per_root: float = PIVOTS_PER_ROOT,
) -> DataFrame:
    """One row for each vector: ``vec_id, n_links, component_id, kept``.

    Vectors of equal label and length are linked at ``cosine`` or more.  A vector that is null, empty, zero or
    has a component that is null or not finite, and one without a label, links with nothing.  Equal vectors are
    one entry of the index, counted with all their copies.  Rows that repeat a vec_id count as vectors of
    their own; a component takes its least id.  Extra columns are ignored.  An empty table gives no rows.
    """
    usable = (
        F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    nodes, (count,) = stored(
        rows.where("usable").groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
        .select(F.monotonically_increasing_id().alias("node"), "label", "embedding", F.size("embedding").alias("dim"), "copies", "least"),
        "vectors", F.count(F.lit(1)))
    pivots = _pivots(nodes, min(MOST_PIVOTS, max(32, math.ceil(pivots_per_root * math.sqrt(count)))))
    postings = nodes.mapInPandas(
        _postings(pivots, nearest, cosine),
        f"label {dict(rows.dtypes)['label']}, dim int, pivot int, node long, copies long, near binary, vector binary")
    met, _ = stored(
        common.dealt(postings, _KEYS, "node").mapInPandas(_links(cosine), "node long, links long, root long"), "vector-links")
    parts = common.components(met.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(links, "node", "left").join(parts, "node", "left").select(
        "label", "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
        F.coalesce("root", "node").alias("root"))
    names = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(names, "root").select("label", "embedding", "n", "component")
    linked = rows.where("usable").join(known, ["label", "embedding"]).select("vec_id", "n", "component")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))
    return linked.unionByName(alone).select(
        "vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))

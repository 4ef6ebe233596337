"""Embedding whitening: principal components by Golub-Kahan-Lanczos bidiagonalisation over distributed products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowboard.llm.common import cut, drop

#: Components returned.
COMPONENTS = 32
#: Entries are cut to this grid, 1 / 64, and moved by 10^6 (fixed values of the query's contract).
GRID, SHIFT = 64, 1_000_000
#: Rows of one block of vectors, the unit of every product.
BLOCK_ROWS = 2048
#: Steps before convergence may end the process, in components: earlier, equal eigenvalues could go unseen.
LEAST_STEPS = 4
#: A residual, or a step's length, this small against the largest singular value counts as none.
TINY = 1e-13
#: Eigenvalues below this share of the largest are taken for none: their components cannot be scaled to deviation 1.
RANK_TOLERANCE = 1e-12


@dataclass
class Components:
    """The fit: n vectors of `size` entries with sums S; unit components as columns, falling eigenvalues, trace of the covariance, steps taken."""

    n: int
    size: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    steps: int


def usable(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(row, x): rows whose vector is whole, and its entries on the grid as longs; and the vectors' size.

    Vectors that are null, empty or hold null, NaN or infinite entries go. So do vectors of another size than most
    have (the larger of two equally frequent ones), as they lack entries or have some that others lack.
    """
    entries = F.col(vector)
    whole = rows.where(F.size(entries) > 0).where(~F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))))
    sizes = whole.groupBy(F.size(entries).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max(F.struct("n", "size")).alias("m")).first()["m"]
    size = most["size"] if most else 0
    grid = F.transform(entries, lambda c: F.floor(c.cast("double") * GRID).cast("bigint") + SHIFT)
    return whole.where(F.size(entries) == size).select(F.struct("*").alias("row"), grid.alias("x")), size


def _blocks(vectors: DataFrame, size: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The vectors as binary blocks of longs, with each block's sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), block_rows):
                x = np.stack(batch["x"].iloc[at:at + block_rows]).astype("<i8")
                yield pd.DataFrame({"x": [x.tobytes()], "n": [len(x)], "sums": [x.sum(axis=0)]})

    return vectors.select("x").mapInPandas(run, "x binary, n bigint, sums array<bigint>")


def _products(blocks: DataFrame, size: int, work) -> np.ndarray:
    """The sum over all blocks of work(centred rows), a flat double array. Blocks of a task are added there, tasks by number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for x in batch["x"]:
                part = work(np.frombuffer(x, dtype="<i8").reshape(-1, size))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    rows = blocks.select("x").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    got = rows.toPandas().sort_values("i")
    return got["v"].to_numpy()


def _centre(n: int, sums: np.ndarray):
    """x - S / n, rounded once: the integers n x - S are exact."""
    return lambda x: (n * x - sums) / n


def fit(vectors: DataFrame, size: int, components: int = COMPONENTS, seed: int = 0) -> Components | None:
    """Components of the vectors' covariance (divisor n), or None without a vector.

    Golub-Kahan-Lanczos: with X the centred rows, X v_k - b_{k-1} u_{k-1} = a_k u_k and X'u_k - a_k v_k = b_k v_{k+1} from
    a random v_1 turn X into a small upper bidiagonal matrix of the a and b, whose singular values and vectors give those of X. A step is
    one pass over the blocks: a task forms its part of w = X v and adds up w'w, X'w and U'w, so norms, the next product and the
    reorthogonalisation against all earlier u need no further pass. The long vectors u are never stored: u_k = X c_k with a
    short c_k. All v are kept orthogonal by two rounds of projections. Where a chain ends (b = 0), a new random v starts the next, so
    equal eigenvalues are all found. It ends when the components' residuals are below rounding, after 4 x components
    steps at the earliest, or when the v span the space. The driver holds size x steps numbers; a task sends size + steps + 1.
    """
    blocks = cut(_blocks(vectors, size))
    sums = [F.sum(F.get("sums", i)).alias(f"s{i}") for i in range(size)]
    n, *s = blocks.agg(F.sum("n").alias("n"), *sums).first() if size else (None,)
    if not n:
        drop(blocks.sparkSession, blocks)
        return None
    centre = _centre(n, np.array(s, dtype=np.int64))
    rng = np.random.default_rng(seed)

    def apart(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            for b in basis:
                v = v - b * (b @ v)
        return v

    v = rng.standard_normal(size)
    v /= np.linalg.norm(v)
    vs, cs, backs, a, b = [v], [], [], [], []  # backs: X'u of each u
    top = 0.0
    while True:
        last, c = b[-1] if b else 0.0, vs[-1].copy()
        if last:
            c -= last * cs[-1]
        known = np.array(cs).reshape(-1, size).T

        def work(x: np.ndarray, c=c, known=known) -> np.ndarray:
            y = centre(x)
            w = y @ c
            return np.concatenate([[w @ w], y.T @ w, (y @ known).T @ w])

        got = _products(blocks, size, work)
        square, back, on = got[0], got[1:1 + size], got[1 + size:]
        # Reorthogonalise u: what of w lies on earlier u is rounding, taken out of all that was added up.
        c = c - known @ on
        back = back - (np.array(backs).reshape(-1, size).T @ on)
        length = np.sqrt(max(square - on @ on, 0.0))
        top = max(top, length, last)
        if length <= TINY * top or length == 0:
            a.append(0.0)
            cs.append(np.zeros(size))
            backs.append(np.zeros(size))
            rest = np.zeros(size)
        else:
            a.append(length)
            cs.append(c / length)
            backs.append(back / length)
            rest = apart(backs[-1] - length * vs[-1], vs)
        k = len(vs)
        if k == size:
            break
        beta = np.linalg.norm(rest)
        top = max(top, beta)
        if beta <= TINY * top or beta == 0:
            b.append(0.0)
            rest = apart(rng.standard_normal(size), vs)
            vs.append(rest / np.linalg.norm(rest))
            continue
        if k >= LEAST_STEPS * components:
            left, values, _ = np.linalg.svd(np.diag(a) + np.diag(b, 1))
            if (beta * np.abs(left[-1, :components]) <= TINY * values[0]).all():
                break
        b.append(beta)
        vs.append(rest / beta)
    steps = len(a)
    _, values, right = np.linalg.svd(np.diag(a) + np.diag(b[:steps - 1], 1))
    many = min(components, steps)
    found = np.array(vs).T @ right[:many].T
    found /= np.linalg.norm(found, axis=0)
    # The eigenvalues once more from the components themselves, and the trace.
    got = _products(blocks, size, lambda x: np.concatenate([((centre(x) @ found) ** 2).sum(axis=0), [(centre(x) ** 2).sum()]]))
    drop(blocks.sparkSession, blocks)
    eigen, trace = got[:-1] / n, got[-1] / n
    order = np.argsort(-eigen, kind="stable")
    order = order[eigen[order] > RANK_TOLERANCE * max(eigen.max(), 0.0)]
    return Components(int(n), size, [int(x) for x in s], found[:, order], eigen[order], float(trace), steps)


def _scores(x: np.ndarray, fitted: Components) -> np.ndarray:
    return _centre(fitted.n, np.array(fitted.sums, dtype=np.int64))(x) @ (fitted.vectors / np.sqrt(fitted.values))


def identity_error(vectors: DataFrame, fitted: Components) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    k, size = len(fitted.values), fitted.size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            if len(batch):
                w = _scores(np.stack(batch["x"]).reshape(-1, size), fitted)
                total += np.column_stack([w.T @ w, w.sum(axis=0)])
        yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    got = vectors.select("x").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
    total = got["v"].to_numpy().reshape(k, k + 1) / fitted.n
    mean = total[:, -1]
    return float(np.abs(total[:, :-1] - np.outer(mean, mean) - np.eye(k)).max())


def _deviation(x: np.ndarray, fitted: Components) -> list[int]:
    """Sums of (n x - S)^2 over the entries, exact; an error where one does not fit a long."""
    d = fitted.n * x - np.array(fitted.sums, dtype=np.int64)
    if len(d) and float(np.abs(d).max()) ** 2 * fitted.size < 2.0 ** 62:
        return (d * d).sum(axis=1).tolist()
    exact = [sum((fitted.n * int(e) - s) ** 2 for e, s in zip(r, fitted.sums)) for r in x]
    if max(exact, default=0) >= 2 ** 63:
        raise OverflowError("a deviation does not fit a long")
    return exact


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """row, n, deviation, whitened (array, one entry a component), explained (array), identity_error for each usable row.

    `row` holds the input row in whole. x is a vector's entries on the grid; with n vectors and sums S, `deviation`
    is the sum over the entries of (n x - S)^2; `whitened` is x - S / n on the unit components of the covariance, over the square root of their eigenvalues;
    `explained` their shares of the trace; `identity_error` one value for all rows, measured over all of them.

    Rows that `usable` drops have no result. Components beyond the rank (all of them with one vector, or with equal ones) are not
    returned, so the arrays may be shorter. Repeated rows count and return as often as they occur. No rows where none is usable.
    """
    vectors, size = usable(rows, vector)
    kept = cut(vectors)
    fitted = fit(kept, size, components)
    error = identity_error(kept, fitted) if fitted and len(fitted.values) else 0.0

    @F.pandas_udf("deviation bigint, whitened array<double>")
    def project(x: pd.Series) -> pd.DataFrame:
        m = np.stack(x).reshape(len(x), size) if len(x) else np.zeros((0, size), dtype=np.int64)
        return pd.DataFrame({"deviation": _deviation(m, fitted), "whitened": list(_scores(m, fitted))})

    shares = [float(v) / fitted.trace for v in fitted.values] if fitted else []
    explained = F.array(*[F.lit(x) for x in shares]).cast("array<double>")
    if not fitted:
        return kept.select("row", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("deviation"),
                           explained.alias("whitened"), explained.alias("explained"), F.lit(error).alias("identity_error"))
    out = kept.withColumn("p", project("x"))
    return out.select("row", F.lit(fitted.n).cast("bigint").alias("n"), "p.deviation", "p.whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))

"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordis.llm.shared import map_arrow, written
from accordis.llm.stats import FEATURES, with_stats

FOLDS = 5


class Kernel:
    """cos features whose inner products approach a Gaussian kernel on standardised statistics."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, dims: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-12, std, 1.0)
        self.w = rng.normal(0, 1 / width, (len(mean), dims))
        self.b = rng.uniform(0, 2 * np.pi, dims)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES]) if batch.num_rows else np.zeros((0, len(FEATURES)))


def normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over all rows: each partition sums its own, rows of the matrix are then summed apart.
    dims + 1 rows reach the driver, whatever the input."""
    d = len(kernel.b) + 1

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for b in it:
            z = kernel(_matrix(b))
            total[:, :d] += z.T @ z
            total[:, d] += z.T @ b.column("y").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    def add(t: pa.Table) -> pa.Table:
        v = np.vstack([np.asarray(x) for x in t.column("v").to_numpy()]).sum(0)
        return pa.table({"i": t.column("i").slice(0, 1), "v": pa.array([v], pa.list_(pa.float64()))})

    parts = map_arrow(rows, part, "i long, v array<double>")
    a = np.zeros((d, d + 1))
    for r in parts.groupBy("i").applyInArrow(add, "i long, v array<double>").collect():
        a[r["i"]] = r["v"]
    return a[:, :d], a[:, d]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; x rising. Block centres and their means, for linear interpolation."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w, strict=True):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            t = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], t, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def held_out(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary")) % FOLDS == 0


def quality_scores(docs: DataFrame, labels: DataFrame, *, dims: int = 256, width: float = 3.0, ridge: float = 1e-4, bins: int = 400, cut: float = 0.3, seed: int = 11) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of each document.

    Labels of the ids with crc32 mod 5 = 0 are never read into the fit; folds 1 to 3 give the regression, fold 4
    the calibration (without it, or with one class there, the clipped ridge score is the result). Only statistics
    of the text are inputs. Null or empty text scores as a document of no words. Without labels every score is
    0.5. Labels repeated for an id count once (greatest value), null labels and ids not at all. A null doc_id is in no
    fold: held_out is false. Repeated rows give repeated results (and weigh as often in the fit). A very long text is
    read whole. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    stats = written(with_stats(docs), "scores")
    lab = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    rows = written(stats.join(lab, "doc_id").withColumn("fold", fold).where("fold <> 0"), "labelled")
    fit = rows.where("fold < 4")
    m = fit.agg(F.count("*").alias("n"), *(F.avg(f).alias(f"m_{f}") for f in FEATURES), *(F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES)).first()
    n = m["n"]
    model = None
    if n:
        kernel = Kernel(np.array([m[f"m_{f}"] for f in FEATURES]), np.array([m[f"s_{f}"] for f in FEATURES]), dims, width, seed)
        a, b = normal_equations(fit.select("y", *FEATURES), kernel)
        coef = np.linalg.solve(a + (ridge * n + 1e-3) * np.eye(len(a)), b)
        steps = None

        def raw(x: np.ndarray) -> np.ndarray:
            return kernel(x) @ coef

        def rated(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in it:
                yield pa.RecordBatch.from_arrays([pa.array(raw(_matrix(r))), r.column("y")], ["raw", "y"])

        # Calibration: at most `bins` sums reach the driver.
        c = map_arrow(rows.where("fold = 4").select("y", *FEATURES), rated, "raw double, y double").withColumn("bin", F.floor(F.least(F.greatest(F.col("raw"), F.lit(-0.5)), F.lit(1.5)) * (bins / 2)))
        c = c.groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("y").alias("m"), F.count("*").alias("w")).orderBy("bin").collect()
        if len(c) > 1 and any(r["m"] > 0 for r in c) and any(r["m"] < 1 for r in c):
            steps = isotonic(*(np.array([r[k] for r in c], float) for k in ("x", "m", "w")))
        model = (raw, steps)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in it:
            if model is None:
                s = np.full(r.num_rows, 0.5)
            else:
                s = model[0](_matrix(r))
                if model[1] is not None:  # the calibrated value, and a trace of the raw one so that order inside a block stays
                    s = 0.999 * np.interp(s, *model[1]) + 0.001 * np.clip(s, 0, 1)
            yield pa.RecordBatch.from_arrays([r.column("doc_id"), pa.array(np.clip(s, 0, 1))], ["doc_id", "score"])

    out = map_arrow(stats, score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))

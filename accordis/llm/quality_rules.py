"""Quality rules: a decision list learnt by sequential covering, applied as ordered Spark conditions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordis.llm.shared import dropped, plain_names, written
from accordis.llm.stats import BASE, FEATURES, annotated, with_stats


@dataclass
class Rule:
    """A conjunction of (feature, "<=" or ">", threshold); documents that meet all are rejected."""

    tests: list[tuple[str, str, float]] = field(default_factory=list)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, op, t in self.tests:
            out &= x[f] <= t if op == "<=" else x[f] > t
        return out

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for f, op, t in self.tests:
            f = prefix + f
            out = out & (F.col(f) <= F.lit(t) if op == "<=" else F.col(f) > F.lit(t))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:.6g}" for f, op, t in self.tests)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, grid: int) -> Rule:
    """Adds the test with the greatest information gain until no good row is covered or nothing is gained."""
    rule, covered = Rule(), np.ones(len(bad), bool)
    while len(rule.tests) < most and (bad & covered).any() and (~bad & covered).any():
        p, n = (bad & covered).sum(), (~bad & covered).sum()
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for f, v in x.items():
            c = v[covered]
            b = bad[covered]
            edges = np.unique(np.quantile(c, np.linspace(0, 1, grid + 1)))[:-1]
            if not len(edges):
                continue
            cell = np.searchsorted(edges, c, "left")  # value <= edges[i] exactly if cell <= i
            up = np.cumsum(np.bincount(cell, b, len(edges) + 1))[:-1]
            un = np.cumsum(np.bincount(cell, ~b, len(edges) + 1))[:-1]
            for op, pp, nn in (("<=", up, un), (">", p - up, n - un)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), -1)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], (f, op, float(edges[i])))
        if best[1] is None:
            break
        rule.tests.append(best[1])
        covered &= Rule([best[1]]).holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drops final tests while (p - n) / (p + n) on rows that the rule was not grown on does not fall."""
    worth = []
    for k in range(1, len(rule.tests) + 1):
        c = Rule(rule.tests[:k]).holds(x)
        p, n = (bad & c).sum(), (~bad & c).sum()
        worth.append((p - n) / (p + n) if p + n else -1.0)
    return Rule(rule.tests[: int(np.argmax(worth)) + 1]) if worth else rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = 0.9, least: int = 3, rules: int = 24, tests: int = 4, grid: int = 48, seed: int = 0) -> list[Rule]:
    """Sequential covering. Stops at a rule whose precision on all rows still uncovered is below `precision` or
    that covers fewer than `least` rejected rows. No rows, or one class only: no rules."""
    out: list[Rule] = []
    if not len(bad) or bad.all() or not bad.any():
        return out
    rng = np.random.default_rng(seed)
    alive = np.ones(len(bad), bool)
    for _ in range(rules):
        i = np.flatnonzero(alive)
        i = i[rng.permutation(len(i))]
        g, q = i[: 2 * len(i) // 3], i[2 * len(i) // 3 :]
        if bad[g].sum() < 1:
            break
        sub = lambda r: {f: v[r] for f, v in x.items()}
        rule = _grow(sub(g), bad[g], tests, grid)
        if not rule.tests:
            break
        rule = _prune(rule, sub(q), bad[q])
        c = rule.holds(x) & alive
        p, n = (bad & c).sum(), (~bad & c).sum()
        if p < least or p / (p + n) < precision:
            break
        out.append(rule)
        alive &= ~c
    return out


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The decision list as one ordered conditional: the first rule that holds rejects, else the row is kept."""
    out = F
    for r in rules:
        out = out.when(r.column(prefix), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def base_failed(prefix: str = "") -> Column:
    words, repeats = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < 50) | (100 * repeats > 50 * words)


def sampled(labels: DataFrame, sample: int, seed: int = 0) -> DataFrame:
    """doc_id, place and quality of about `sample` labels at most: if there are more, those whose seeded hash is below the
    share that is wanted, so that no partition sends more than its part. The bound is on what is learnt from only."""
    lab = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    share = min(1.0, sample / max(1, lab.count()))
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    return lab.where(place < int(share * (1 << 30))).select("doc_id", place.alias("place"), "quality")


def training_rows(stats: DataFrame, lab: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and rejection of the rows of stats that sampled() labels name, in an order of their own."""
    t = stats.join(lab, "doc_id").select("place", "quality", *FEATURES).toPandas().sort_values(["place", *FEATURES])
    return {f: t[f].to_numpy(float) for f in FEATURES}, t["quality"].to_numpy() == 0


def quality_rules(docs: DataFrame, labels: DataFrame, *, sample: int = 50_000, precision: float = 0.9) -> tuple[DataFrame, list[Rule]]:
    """Base counts, features, base_failed and kept of each document, and the learnt rules in order.

    docs: doc_id, text (others ignored, whatever their names). labels: doc_id, quality (0 rejects; a null label or id is
    none; repeated ids count once, with the greatest value). One pass over the texts; the thin statistics are written to
    the shared folder. Learning sees about `sample` labelled rows at most on the driver. Null or empty text: counts 0,
    base_failed. A very long text is counted whole. No labels, or labels of one class: the base alone decides. Of tests
    of equal gain the first feature's lowest threshold counts. Repeated rows give repeated results. Empty table: no rows.
    """
    stats = written(with_stats(docs), "rules")
    x, bad = training_rows(stats, sampled(labels, sample))
    rules = learn(x, bad, precision=precision)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules


@plain_names
def accepted(docs: DataFrame, labels: DataFrame, *, sample: int = 50_000, precision: float = 0.9) -> DataFrame:
    """The documents, all columns, that the base and the learnt rules keep (cases: see quality_rules). Statistics are
    counted of the sampled labelled documents to learn, and then of all in the pass that keeps or drops them."""
    lab = written(sampled(labels, sample), "labels")
    # About `sample` rows of three numbers, so the join's other side is never moved.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(lab.select("doc_id")), "doc_id", "left_semi")
    rules = learn(*training_rows(with_stats(own), F.broadcast(lab)), precision=precision)
    dropped(lab)
    q = "__q_"
    return annotated(docs).where(~base_failed(q) & verdict(rules, q)).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out, _ = quality_rules(docs, labels)
    return out.select("doc_id", *BASE, "base_failed", "kept")

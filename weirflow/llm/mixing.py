"""Soft-membership mixing: rates of documents whose expected domain totals match target weights.

A classifier trained on the labelled table gives every document one posterior over all domains, the combinations of the
binary label columns. Projected-gradient least squares then finds a rate for each document, zero or more, at which the
expected tokens of each domain match its target. Everything is DataFrame operations; the driver holds a matrix of domains.

The gradient is taken in the norm that weighs a document by its tokens, so a rate depends on what a document is, not on
how long it is. Errors are measured by the inverse of the domains' curvature, that of the documents whose rate is not
zero as long as this halves the loss, else that of all with momentum. Rates are projected to zero or more and have no
upper bound: a scarce domain's documents are repeated as often as its target needs.
"""

from __future__ import annotations

import math
import warnings
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import drop_path, written

BUCKETS = 2048
#: Labelled documents that the classifier is fitted to at most, in the order of a hash.
SAMPLE_DOCS = 10_000
#: Words whose evidence counts in full; that of a longer text is scaled down to so many.
FULL_WORDS = 50
#: Words' worth of the overall frequencies in those of a class.
SMOOTHING = 2000.0
#: No bound: how often a document is repeated follows from the targets alone.
MAX_RATE = math.inf
#: Rounds after which what is left is reported.
ROUNDS = 200
#: Tokens that a domain may be off, as a share of its own target (without one: of the least target).
TOLERANCE = 0.01
#: The loss is as small as it can be when it is proved to be over its minimum by no more than this share.
LEAST = 0.02
#: Rounds with momentum after a step of the free documents' curvature that did not halve the loss.
PLAIN_ROUNDS = 8
WRITE_EVERY = 4
#: Target weights by (quality, toxic), an example of production values.
TARGETS = {(1, 0): 0.80, (1, 1): 0.02, (0, 0): 0.16, (0, 1): 0.02}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}]+"), lambda w: w != "")


def buckets(text: Column) -> Column:
    """Each word's hash bucket, from 1."""
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)) + 1)


def tokens(text: Column) -> Column:
    """Words between spaces and newlines, at least one."""
    t = F.coalesce(text, F.lit(""))
    return (F.char_length(t) - F.char_length(F.translate(t, " \n", "")) + 1).cast("double")


def fit(docs: DataFrame, labels: DataFrame, label_cols: list[str], domains: list[tuple], id_col: str, text_col: str, sample_docs: int) -> list[tuple[list[float], float]]:
    """For each domain but the first its log-odds against the first, by bucket and before any word: multinomial naive Bayes."""
    ys = [f"y_{k}" for k in range(len(label_cols))]
    known = labels.groupBy(F.col(id_col).alias("label_id")).agg(*[F.max(F.col(c).cast("int")).alias(f"y_{k}") for k, c in enumerate(label_cols)])
    known = known.filter(" AND ".join(f"{y} IN (0, 1)" for y in ys))
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample_docs)  # ids and labels only
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    domain = sum((F.col(y) * (1 << k) for k, y in enumerate(reversed(ys))), F.lit(0))  # its place in the order of product((0, 1), ...)
    rows = texts.join(F.broadcast(chosen), F.col("_id") == F.col("label_id")).select(domain.alias("d"), buckets(F.col("_text")).alias("b"))
    sample, path = written(rows, "mix-sample")
    of_docs, cells = np.ones(len(domains)), np.zeros((len(domains), BUCKETS))
    for r in sample.groupBy("d").count().collect():  # a row a domain
        of_docs[r["d"]] += r["count"]
    for r in sample.select("d", F.explode("b").alias("b")).groupBy("d", "b").count().collect():  # at most BUCKETS rows a domain
        cells[r["d"], r["b"] - 1] = r["count"]
    drop_path(docs.sparkSession, path)
    logs, prior = joint(cells, of_docs, domains)
    return [((logs[k] - logs[0]).tolist(), float(prior[k] - prior[0])) for k in range(1, len(domains))]


def joint(cells: np.ndarray, of_docs: np.ndarray, domains: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Logs of P(word | domain) and P(domain) from counts, shrunk towards what the labels tell one by one.

    A domain's words count against SMOOTHING words of the mixture that independent labels would make, and its documents
    against as many as independent labels would give it. So a combination that few or no labelled documents show is told
    by its labels, and one that many show by itself.
    """
    pooled = np.maximum(cells.sum(0), 0.5)
    pooled = pooled / pooled.sum()
    of_words, alone = np.tile(pooled, (len(domains), 1)), np.full(len(domains), of_docs.sum())
    for j in range(len(domains[0])):
        for v in (0, 1):
            own = [k for k, d in enumerate(domains) if d[j] == v]
            words = cells[own].sum(0)
            of_words[own] *= (words + SMOOTHING * pooled) / (words.sum() + SMOOTHING) / pooled
            alone[own] *= of_docs[own].sum() / of_docs.sum()
    of_words /= of_words.sum(1, keepdims=True)
    logs = np.log((cells + SMOOTHING * of_words) / (cells.sum(1, keepdims=True) + SMOOTHING))
    return logs, np.log(of_docs + alone)


def evidence(weights: list[float]) -> Column:
    table = F.array(*[F.lit(round(w, 6)) for w in weights])
    return F.aggregate("_b", F.lit(0.0), lambda acc, b: acc + F.element_at(table, b.cast("int")))


def odds(models: list[tuple[list[float], float]]) -> list[Column]:
    """Columns over ``_b`` (buckets): the log-odds of each domain but the first against the first."""
    scale = F.least(F.lit(1.0), F.lit(float(FULL_WORDS)) / F.greatest(F.size("_b"), F.lit(1)))
    return [F.lit(prior) + evidence(weights) * scale for weights, prior in models]


def posterior(logits: list[Column]) -> list[Column]:
    """Each domain's share, the first's logit being zero; logits are held against the largest, so nothing overflows."""
    every = [F.lit(0.0), *logits]
    top = F.greatest(*every)
    total = sum((F.exp(x - top) for x in every), F.lit(0.0))
    return [F.exp(x - top) / total for x in every]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[tuple, float] | None = None, label_cols: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with its struct column ``mix``: tokens, p (posterior of each domain, 0 before 1), rate, chance.

    A column of that name, in whatever case, is replaced. ``chance`` is a number from 0 to 1 that each row gets by its
    place and that is written, so rows without an id and rows that share one have chances of their own.

    Targets are weights of the domains; they are scaled to one, and the total to the tokens there are. Where no rates
    meet them, the rates of the least loss are given, and a RuntimeWarning names each domain that is off and by how much.
    Null and empty texts count one token and have the prior's posterior.
    Ids may be null or repeat; of labels that repeat an id the largest count, and one that lacks a label or has it neither
    0 nor 1 is left out. Without labels all posteriors are even; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    targets = targets or TARGETS
    domains = list(product((0, 1), repeat=len(label_cols)))
    models = fit(docs, labels, list(label_cols), domains, id_col, text_col, sample_docs)
    keep = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "mix"])
    base = docs.select(keep.alias("_doc"), buckets(F.col(text_col)).alias("_b"), tokens(F.col(text_col)).alias("_n"))
    base = base.select("_doc", "_n", *[x.alias(f"_q{k}") for k, x in enumerate(odds(models), 1)])
    shares = posterior([F.col(f"_q{k}") for k in range(1, len(domains))])
    # Steps of the golden section from row to row of a task are spread evenly, whatever run of rows or every nth one is taken.
    row, turn = F.monotonically_increasing_id(), F.lit(1 << 32)
    chance = F.pmod(row.bitwiseAND((1 << 31) - 1) * F.lit(2654435769) + F.pmod(F.xxhash64(F.lit(11), F.shiftright(row, 33)), turn), turn) / turn.cast("double")
    scored, _ = written(base.select("_doc", "_n", *[p.alias(f"_p{k}") for k, p in enumerate(shares)], chance.alias("_chance")), "mix-scored")
    ps = [F.col(f"_p{k}") for k in range(len(domains))]

    history = solve(start(scored.select("_n", *ps)), ps, [targets.get(d, 0.0) for d in domains], domains, rounds)
    # Each document goes through the same steps as its copy in the loop did.
    return scored.select("_doc.*", F.struct(F.col("_n").alias("tokens"), F.array(*ps).alias("p"), replayed(ps, history).alias("rate"), F.col("_chance").alias("chance")).alias("mix"))


def inverse(curvature: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """The pseudo-inverse of the domains' curvature, each domain scaled by its tokens so that scarce ones count too."""
    scale = 1 / np.sqrt(mass)
    values, vectors = np.linalg.eigh(curvature * scale[:, None] * scale)
    return (vectors * np.where(values > 1e-9, 1 / np.maximum(values, 1e-9), 0)) @ vectors.T * scale[:, None] * scale


def solve(state: DataFrame, ps: list[Column], weights: list[float], domains: list[tuple], rounds: int) -> list[tuple[list[float], float]]:
    """The steps, each a pull by domain and a momentum, that take rates of one to those that meet the weights.

    A step by the free documents' curvature may make the loss larger, and often leads on from there. Where the targets are
    not met the steps end at the rates of the least loss on the way.
    """
    spark, count = state.sparkSession, len(ps)
    cells = [(i, j) for i in range(count) for j in range(i, count)]
    sums = [F.sum(F.col("_n") * p * F.col("_y")).alias(f"s{k}") for k, p in enumerate(ps)]
    free = [F.sum(F.when(F.col("_y") > 0, F.col("_n") * ps[i] * ps[j])).alias(f"h{i}_{j}") for i, j in cells]
    history: list[tuple[list[float], float]] = []
    momentum, path, wait, lowest, last, pull, best = 1.0, None, 0, 0.0, None, np.zeros(count), None
    for t in range(rounds + 1):
        row = state.agg(F.sum("_n").alias("n"), F.min(dot(ps, pull)).alias("down"), *sums, *free).first()
        if not row["n"]:
            return []
        got = np.array([row[f"s{k}"] for k in range(count)])
        curvature = np.zeros((count, count))
        for i, j in cells:
            curvature[i, j] = curvature[j, i] = row[f"h{i}_{j}"] or 0.0
        if not t:
            total, mass = row["n"], np.maximum(got, 1e-6)
            goal = np.array(weights) / (sum(weights) or 1.0) * total
            may = TOLERANCE * np.where(goal > 0, goal, goal[goal > 0].min(initial=total))
            metric = inverse(curvature, mass)
        else:
            # By convexity no rates have a loss under this: the last one, less the gradient's product with the rates and
            # with any that do better, whose tokens are at most the bound.
            bound = total + math.sqrt(2 * last * total)
            lowest = max(lowest, last - pull @ before - max(0.0, -row["down"]) * bound)
        error = got - goal
        loss = float(error @ metric @ error) / 2
        pull, before = metric @ error, got
        met = (abs(error) <= may).all()
        if best is None or met or loss < best[0]:
            best = loss, len(history), got
        if met:
            break
        least = best[0] <= 1e-15 * total or best[0] - lowest <= LEAST * best[0]
        if least or t == rounds:
            off = ", ".join(f"{d}: {g / total:.3g} for {w / total:.3g}" for d, g, w, m in zip(domains, best[2], goal, may, strict=True) if abs(g - w) > m)
            warnings.warn(f"mixing: {'no rates meet all targets' if least else f'targets not met in {t} rounds'}; domains off, as shares of all tokens: {off}", RuntimeWarning, stacklevel=3)
            break
        if wait == 0 and last is not None and fast and loss > last / 2:
            wait, momentum = PLAIN_ROUNDS, 1.0
        elif last is not None and loss > last:
            momentum = 1.0
        fast, last = wait == 0, loss
        if fast:
            step, carry, momentum = inverse(curvature, mass) @ error, 0.0, 1.0
        else:
            after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
            step, carry, momentum, wait = pull, (momentum - 1) / after, after, wait - 1
        history.append((step.tolist(), carry))
        state = stepped(state, ps, *history[-1])
        if t % WRITE_EVERY == WRITE_EVERY - 1:
            state, newer = written(state, "mix-rates")
            if path:
                drop_path(spark, path)
            path = newer
    if path:
        drop_path(spark, path)
    return history[: best[1]]


def dot(ps: list[Column], pull) -> Column:
    return sum((p * F.lit(float(g)) for p, g in zip(ps, pull, strict=True)), F.lit(0.0))


def replayed(ps: list[Column], history: list[tuple[list[float], float]]) -> Column:
    """The rate after all steps."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*[F.struct(*[F.lit(g).alias(f"g{k}") for k, g in enumerate(pull)], F.lit(m).alias("m")) for pull, m in history])

    def step(at: Column, h: Column) -> Column:
        r = F.greatest(F.lit(0.0), at["y"] - sum((p * h[f"g{k}"] for k, p in enumerate(ps)), F.lit(0.0)))
        return F.struct(r.alias("r"), F.greatest(F.lit(0.0), r + h["m"] * (r - at["r"])).alias("y"))

    return F.aggregate(steps, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")), step)["y"]


def start(df: DataFrame) -> DataFrame:
    return df.withColumns({"_r": F.lit(1.0), "_y": F.lit(1.0)})


def stepped(df: DataFrame, ps: list[Column], pull: list[float], momentum: float) -> DataFrame:
    """One projected step against the domains' errors, and the point, projected too, that momentum carries it to."""
    moved = df.withColumn("_m", F.greatest(F.lit(0.0), F.col("_y") - dot(ps, pull)))
    return moved.withColumn("_y", F.greatest(F.lit(0.0), F.col("_m") + F.lit(momentum) * (F.col("_m") - F.col("_r")))).withColumn("_r", F.col("_m")).drop("_m")


def realise(mixed: DataFrame) -> DataFrame:
    """The documents of ``mix``, each row as often as its rate says: the whole part, and one more with the chance of the rest.

    The chance is the row's own, which ``mix`` has written, so it is the same however often the rows are read; the ``mix``
    column goes. An empty table gives no rows.
    """
    times = F.floor(F.col("mix.rate") + F.col("mix.chance")).cast("long")
    own = F.struct(*[F.col(f"`{c}`") for c in mixed.columns if c.lower() != "mix"])
    rows = mixed.select(own.alias("_doc"), times.alias("_times")).filter("_times > 0")
    # In two steps, so that no row holds a list as long as its rate.
    by = 1000
    rows = rows.select("_doc", "_times", F.explode(F.sequence(F.lit(0), F.floor((F.col("_times") - 1) / by))).alias("_k"))
    rows = rows.select("_doc", F.explode(F.sequence(F.lit(1), F.least(F.lit(by).cast("long"), F.col("_times") - F.col("_k") * by))))
    return rows.select("_doc.*")

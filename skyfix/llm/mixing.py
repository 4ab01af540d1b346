"""Mixing sources to target weights with soft memberships.

A classifier learnt from the labelled rows predicts, for each document, how much of it belongs to each domain. Nonnegative
document rates are fitted so that expected domain token totals meet the targets: projected-gradient least squares. The
gradient of a document's rate is its posteriors times the domains' errors, so a step is one number a domain, and a round turns
each rate x into max(0, x - step times posteriors): a column expression over the steps so far, never gathered. Each round is
one distributed sum over the documents, of the totals and of their curvature (domains x domains numbers), which scales the
next step.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bayes import WORD_BUCKETS, feature_counts, posteriors, word_features
from .quality_model import SAMPLE, STATISTICS, Discriminant, _statistics, class_sums, labelled_texts
from .shared import cut, lookup, spare_name, steps, text_function, tidy, without

#: Domain of (quality, toxic) labels, and the share of the mixed tokens that each is to have.
DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.95, "low": 0.05, "toxic": 0.0}
#: The fit ends when each domain's share of the expected tokens is this near to its target, or after so many rounds; each
#: round tries these parts of its step at once.
TOLERANCE, ROUNDS, PARTS = 0.0005, 40, (1.0, 0.5, 0.2, 0.05)
#: Draws that are tried for the whole copies; the one with the best totals is used.
DRAWS = 16
#: Of the classifier: points and steps of the fit of words' shares, and the shrinkage of covariances.
GRID, FIT, SHRINK, RIDGE = 40, 60, 0.05, 1e-3


def domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 0, "low").when(F.col(quality) == 1, "clean")


def word_weights(counts: dict[str, np.ndarray], names: tuple[str, ...] = DOMAINS) -> np.ndarray:
    """(3, domains, buckets): log-odds that each word adds to its text being of the domain. Those of the largest domain are 0.

    A word's share of texts of the domain is shrunk to the distribution of these shares over all words, fitted by EM on a grid:
    a word without texts weighs nothing, one with few weighs as much as such words have proved to. The second and third
    form leave one text out, of the domain and of another one, so that a labelled text can be weighed without itself.
    """
    rows = np.array([counts.get(d, np.zeros(WORD_BUCKETS + 1)) for d in names], np.float64)
    seen, texts = rows[:, :WORD_BUCKETS], rows[:, WORD_BUCKETS]
    out = np.zeros((3, len(names), WORD_BUCKETS), np.float32)
    for j in range(len(names)):
        if j == int(texts.argmax()):
            continue
        kinds, at, number = np.unique(seen[j] + 1j * seen.sum(0), return_inverse=True, return_counts=True)
        own, times = kinds.real, kinds.imag
        number = np.where(times > 0, number, 0)
        share = (texts[j] + 0.5) / (texts.sum() + 0.5 * len(names))
        chance = np.log(share / (1 - share))
        grid = np.sort(np.append(np.linspace(chance - 3, max(chance, 0) + 6, GRID), chance))
        odds = 1 / (1 + np.exp(-grid))

        def likelihood(of, all_, odds=odds):
            log = np.outer(of, np.log(odds)) + np.outer(all_ - of, np.log1p(-odds))
            return np.exp(log - log.max(1, keepdims=True))

        known = likelihood(own, times)
        spread = np.where(grid == chance, 0.5, 0.5 / GRID)
        for _ in range(FIT):
            spread = spread * (known.T @ (number / (known @ spread))) + 1e-3
            spread /= spread.sum()
        for form, (of, all_) in enumerate(((0, 0), (1, 1), (0, 1))):
            all_ = np.maximum(times - all_, 0)
            found = likelihood(np.minimum(np.maximum(own - of, 0), all_), all_)
            mean = (found @ (spread * odds)) / (found @ spread)
            out[form, j] = np.where(all_ > 0, np.log(mean / (1 - mean)) - chance, 0)[at.ravel()]
    return out


def evidence(weights: np.ndarray, row: np.ndarray, bucket: np.ndarray, times: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """(rows, 3 * domains): what the words of each text say for each domain, what they say against it, and how much of the text
    says so for it.

    Squares of weights are added up, so that many faint ones do not drown a strong one, and put on a logarithmic scale.
    """
    told = weights[:, bucket].astype(np.float64)
    above, below = np.maximum(told, 0), np.minimum(told, 0)
    once = [np.bincount(row, w**2, len(tokens)) for side in (above, below) for w in side]
    often = [np.bincount(row, w**2 * times, len(tokens)) / np.maximum(tokens, 1) for w in above]
    return np.hstack((np.log1p(np.sqrt(np.stack(once, axis=1)) / 4), np.sqrt(np.stack(often, axis=1))))


@dataclass
class Memberships:
    """The fitted classifier: weights of the words (domains x buckets) and Gaussians over statistics and evidence."""

    names: tuple[str, ...]
    weights: np.ndarray
    gaussians: Discriminant

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words, posteriors over the domains) of each text; without anything learnt all is of the first domain."""
        row, bucket, times, tokens = word_features(texts)
        p = np.zeros((len(texts), len(self.names)))
        known = sorted(self.gaussians.classes)
        if known:
            x = np.hstack((_statistics(texts), evidence(self.weights, row, bucket, times, tokens)))
            p[:, known] = posteriors(np.stack([self.gaussians.log_joint(x, k) for k in known], axis=1))
        else:
            p[:, 0] = 1
        return tokens.astype(np.int64), p


def fit_memberships(
    docs: DataFrame, labels: DataFrame, names: tuple[str, ...], id_col: str, text_col: str, most: int = SAMPLE,
) -> Memberships:
    """From labels (label_id, label). The Gaussians are fitted to evidence that leaves the labelled text itself out."""
    learnt = labelled_texts(docs, labels, id_col, text_col, most)
    weights = word_weights(feature_counts(learnt.where("text is not null"), word_features, WORD_BUCKETS), names)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def measure(batch: pa.RecordBatch):
        for part in steps(batch, "text"):
            row, bucket, times, tokens = word_features(part.column("text"))
            label = np.array([names.index(x) for x in part.column("label").to_pylist()])
            own, other = (evidence(w, row, bucket, times, tokens) for w in shared.value[1:])
            mine = label[:, None] == np.arange(own.shape[1])[None, :] % len(names)
            yield label, np.hstack((_statistics(part.column("text")), np.where(mine, own, other)))

    sums = class_sums(learnt, measure)
    return Memberships(names, weights[0], Discriminant(sums, SHRINK, RIDGE))


def verdicts(docs: DataFrame, model: Memberships, text_col: str) -> Column:
    """struct(tokens, p) of the texts of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list:
        tokens, p = shared.value.of(texts)
        return [tokens, pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))]

    return text_function(run, "tokens bigint, p array<double>")(F.col(text_col).cast("string"))


def rate_of(p: Column, steps_: list[np.ndarray]) -> Column:
    """Rate of a document with these posteriors after these steps, each projected to what is not negative."""
    rate = F.lit(1.0)
    for step in steps_:
        rate = F.greatest(F.lit(0.0), rate - reduce(lambda a, b: a + b, (p[j] * F.lit(float(s)) for j, s in enumerate(step))))
    return rate


def copies_of(rate: Column, key: Column, draw: int) -> Column:
    """Whole copies: the rate rounded up as often as its fraction says, so that copies are the rate on average."""
    u = F.pmod(F.xxhash64(key, F.lit(draw)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("long")


def _column_sums(rows: DataFrame, values: list[Column]) -> np.ndarray:
    return np.array(rows.agg(*(F.coalesce(F.sum(v), F.lit(0.0)).alias(f"s{i}") for i, v in enumerate(values))).first(), np.float64)


def fit_rates(rows: DataFrame, targets: dict[str, float], tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[list[np.ndarray], float]:
    """The steps, a number a domain each, from rows (tokens, p, banned), see rate_of; and how far the domains' shares are from
    their targets at most. Banned rows have rate 0.

    The domain with the largest target keeps its tokens and the others are fitted to it. Where it has none, all stay at 1.
    """
    weights = np.array(list(targets.values()), np.float64)
    d = len(weights)
    anchor = int(weights.argmax())
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    free = rows.where("not banned and tokens > 0")

    def measured(done: list[np.ndarray], tries: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(totals, curvature) after the steps done and each of the tried ones, in one pass."""
        values = []
        now = free.withColumn("rate", rate_of(F.col("p"), done))
        for k, step in enumerate(tries):
            now = now.withColumn(f"rate_{k}", F.greatest(F.lit(0.0), F.col("rate") - sum(F.col("p")[j] * float(v) for j, v in enumerate(step))))
            rate, t, p = F.col(f"rate_{k}"), F.col("tokens"), F.col("p")
            values += [rate * t * p[j] for j in range(d)] + [F.when(rate > 0, t * p[i] * p[j]).otherwise(0.0) for i, j in pairs]
        out = []
        for found in np.split(_column_sums(now, values), len(tries)):
            curve = np.zeros((d, d))
            for (i, j), value in zip(pairs, found[d:], strict=True):
                curve[i, j] = curve[j, i] = value
            out.append((found[:d], curve))
        return out

    done: list[np.ndarray] = []
    [(totals, curve)] = measured(done, [np.zeros(d)])
    if totals[anchor] <= 0 or weights[anchor] <= 0:
        return done, 0.0 if totals.sum() <= 0 else 1.0
    goal = totals[anchor] * weights / weights[anchor]
    off = lambda totals: float(np.abs(totals / max(totals.sum(), 1e-9) - weights / weights.sum()).max())
    for _ in range(rounds):
        if off(totals) <= tolerance:
            break
        step = np.linalg.lstsq(curve + 1e-9 * np.trace(curve) * np.eye(d), totals - goal, rcond=None)[0]
        tries = [part * step for part in PARTS]
        found = measured(done, tries)
        best = min(range(len(tries)), key=lambda k: np.square(found[k][0] - goal).sum())
        if np.square(found[best][0] - goal).sum() >= np.square(totals - goal).sum():
            break
        done.append(tries[best])
        totals, curve = found[best]
    return done, off(totals)


def best_draw(rows: DataFrame, targets: dict[str, float], at: list[np.ndarray], draws: int = DRAWS) -> int:
    """Of some draws of whole copies the one whose totals are nearest to the expected ones."""
    d = len(targets)
    rate, t, p = rate_of(F.col("p"), at), F.col("tokens"), F.col("p")
    values = [rate * t * p[j] for j in range(d)]
    for draw in range(draws):
        values += [copies_of(rate, F.col("key"), draw) * t * p[j] for j in range(d)]
    wanted, *found = np.split(_column_sums(rows.where("not banned and tokens > 0"), values), draws + 1)
    return int(np.argmin([np.square(f - wanted).sum() for f in found]))


@dataclass
class Mix:
    """A fitted mix: the classifier, the steps and the draw."""

    targets: dict[str, float]
    model: Memberships
    steps: list[np.ndarray]
    draw: int


def _banned(labels: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(id) that labels (label_id, label) place in a domain of which nothing is wanted."""
    unwanted = [d for d, w in targets.items() if w <= 0]
    return labels.where(F.col("label").isin(*unwanted)).select(F.col("label_id").alias("id")).distinct()


def _labelled(labels: DataFrame, targets: dict[str, float], id_col: str, of: Column | None) -> DataFrame:
    known = labels.select(F.col(id_col).alias("label_id"), (domain() if of is None else of).alias("label"))
    return known.where(F.col("label").isin(*targets) & F.col("label_id").isNotNull())


def _fit(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str, text_col: str, most: int, ban: bool,
) -> tuple[Mix, DataFrame]:
    """The fitted mix and the written table (id, key, tokens, p, banned) of all rows."""
    model = fit_memberships(docs, labels, tuple(targets), id_col, text_col, most)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), verdicts(docs, model, text_col).alias("v"))
    rows = rows.select("id", "key", "v.*")
    if ban:
        barred = cut(_banned(labels, targets).withColumn("banned", F.lit(True)), "barred")
        rows = lookup(cut(rows, "memberships"), barred, "id").select("id", "key", "tokens", "p", F.coalesce("banned", F.lit(False)).alias("banned"))
    else:
        rows = rows.withColumn("banned", F.lit(False))
    rows = cut(rows, "rated", keep=True)
    at, miss = fit_rates(rows, targets)
    if miss > TOLERANCE:
        warnings.warn(f"the rates leave a domain's share of the expected tokens {miss:.4f} from its target", stacklevel=3)
    return Mix(targets, model, at, best_draw(rows, targets, at)), rows


def mix_to_targets(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    of: Column | None = None,
    most: int = SAMPLE,
    ban: bool = False,
) -> DataFrame:
    """(id_col, n_tokens, p_<domain> for each domain, rate, copies) for every row of docs.

    targets: the share of the mixed tokens that each domain is to have; of: the domain of a label row (null: none), by
    default toxic 1 is `toxic`, else quality 0 `low` and 1 `clean`. Learns from about `most` label rows at most (a sample by
    the hash of the id) whose document is there. All rows are rated by what the
    classifier says; with `ban`, documents that labels place in a domain of target 0 have rate 0 and are not fitted. Where the
    targets cannot be met within TOLERANCE of the expected shares, a warning says by how much. Null and empty texts have no tokens, and posteriors as texts without words. Without usable labels
    all is of the first domain. Repeated rows count and are rated each; a null id is rated and never learnt from; ids may
    have any type. Where the domain with the largest target has no tokens, every other rate is 1. Other columns are ignored,
    whatever their names; an empty table gives none.
    """
    targets = targets or TARGETS
    with tidy(docs.sparkSession):
        mix, rows = _fit(docs, _labelled(labels, targets, id_col, of), targets, id_col, text_col, most, ban)
    rate = F.when(F.col("banned"), F.lit(0.0)).otherwise(rate_of(F.col("p"), mix.steps))
    shares = [F.col("p")[j].alias(f"p_{d}") for j, d in enumerate(targets)]
    copies = F.when(F.col("banned"), F.lit(0).cast("long")).otherwise(copies_of(rate_of(F.col("p"), mix.steps), F.col("key"), mix.draw))
    return rows.select(F.col("id").alias(id_col), F.col("tokens").alias("n_tokens"), *shares, rate.alias("rate"), copies.alias("copies"))


def mixed_documents(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    of: Column | None = None,
    most: int = SAMPLE,
    ban: bool = False,
) -> DataFrame:
    """The rows of docs that have a copy or more in the mix of mix_to_targets, whole, with `rate` and `copies`.

    Columns of docs with these names are replaced. Rates are made again from the texts, so nothing brings them to the rows.
    """
    targets = targets or TARGETS
    known = _labelled(labels, targets, id_col, of)
    with tidy(docs.sparkSession):
        mix, _ = _fit(docs, known, targets, id_col, text_col, most, ban)
    if ban:
        docs = without(docs, cut(_banned(known, targets), "barred", keep=True).withColumnRenamed("id", id_col), [id_col])
    name = spare_name(docs, "mix_verdict")
    text = F.col(text_col).cast("string")
    rated = docs.select("*", verdicts(docs, mix.model, text_col).alias(name))
    rate = rate_of(F.col(name)["p"], mix.steps)
    own = [c for c in docs.columns if c.lower() not in ("rate", "copies")]
    copies = copies_of(rate, F.xxhash64(F.col(id_col), text), mix.draw)
    return rated.select(*own, rate.alias("rate"), copies.alias("copies")).where("copies > 0")

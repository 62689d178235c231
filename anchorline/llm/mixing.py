"""Mixing documents to target token totals per domain, with soft membership.

1. A classifier learned from a labelled table gives every document a probability for each domain. Its inputs are the
   evidence of the document's words for each domain and the shares of symbols and capitals. It learns from at most
   ``SAMPLE_EACH`` labelled documents per domain: word odds are counted over hashed slots, then one logistic curve per
   domain is fitted by Newton steps on the sample's few inputs; the curves are scaled to sum to one.
2. A document with n tokens and probabilities p gives n p_k tokens to domain k, times its rate. Rates start at 1 and are
   moved by projected gradient steps on the squared distance between expected totals and targets, measured by the
   inverse of sum n p p'. A step needs only the domain totals, so a round is one small aggregate over the stored
   probabilities, and a rate is a function of the document's own probabilities and the steps so far.
3. A mixture may be balanced by a column of few values (languages) first: documents count by the factor that brings each
   value's share of the tokens to a power of it, and the rates are fitted to what these factors leave.

Everything runs as DataFrame expressions. The sampled ids are broadcast, so no text is shuffled. What reaches the driver
has a size set by the number of domains, SLOTS, EVIDENCE and SAMPLE_EACH.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from anchorline.llm.samples import bounded_sample
from anchorline.session import cut_lineage

SLOTS = 1 << 16
SAMPLE_EACH = 15_000
EVIDENCE = 1024  # slots that may speak for a domain
STRONG, HOLDERS = 8.0, 5  # odds and documents of the domain from which on a slot is evidence
NOT_A_WORD = r"[^\p{L}\p{N}]+"


def quality_domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Domain of a labelled document; null if a label is missing."""
    return (
        F.when(F.col(quality).isNull() | F.col(toxic).isNull(), None)
        .when(F.col(quality) == 0, "low").when(F.col(toxic) == 1, "toxic").otherwise("clean")
    )


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD), lambda w: w != "")


def _slots(words: Column) -> Column:
    return F.transform(F.array_distinct(words), lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int"))


def _share(text: Column, pattern_chars: str) -> Column:
    """Share of the characters of ``text`` that occur in ``pattern_chars``."""
    left = F.length(F.translate(text, pattern_chars, ""))
    return F.when(F.length(text) > 0, 1 - left / F.length(text)).otherwise(0.0)


def word_odds(labelled: DataFrame, domains: list[str], most: int = EVIDENCE) -> list[dict[int, float]]:
    """Per domain the log odds of the slots that speak for it; at most ``most`` of them, the strongest first.

    ``labelled`` has ``text`` and ``domain``. Counts are combined on the map side; their number is bounded by SLOTS.
    """
    each = labelled.select("domain", F.explode(_slots(_words(F.col("text")))).alias("slot"))
    held = [F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(domains)]
    totals = labelled.agg(*held).first()
    total, count = sum(totals), [F.col(f"n{k}") for k in range(len(domains))]
    weights = []
    for k in range(len(domains)):
        rest = reduce(lambda x, y: x + y, count) - count[k]
        odds = ((count[k] + 0.5) / (totals[k] + 1)) / ((rest + 0.5) / (total - totals[k] + 1))
        weights.append(F.when((odds >= STRONG) & (count[k] >= HOLDERS), F.log(odds)).alias(f"w{k}"))
    found = each.groupBy("slot").agg(*held).select("slot", *weights).where(F.coalesce(*[f"w{k}" for k in range(len(domains))]).isNotNull())
    rows = found.collect()
    strongest = [sorted(((r[f"w{k}"], r["slot"]) for r in rows if r[f"w{k}"]), key=lambda x: (-x[0], x[1])) for k in range(len(domains))]
    return [{slot: weight for weight, slot in sorted(kept[:most], key=lambda x: x[1])} for kept in strongest]


def _summed(hits: str, weights: dict[int, float]) -> Column:
    """Sum of the weights of a row's strong slots. The weights are one short folded literal."""
    if not weights:
        return F.lit(0.0)
    table = F.str_to_map(F.lit(",".join(f"{slot}:{w:.4g}" for slot, w in weights.items())), F.lit(","), F.lit(":"))
    held = F.transform(hits, lambda slot: F.coalesce(F.element_at(table.cast("map<int,double>"), slot), F.lit(0.0)))
    return F.aggregate(held, F.lit(0.0), lambda total, w: total + w)


def with_inputs(docs: DataFrame, odds: list[dict[int, float]]) -> DataFrame:
    """Add ``x``, the inputs of the classifier, and ``n``, the number of words, to rows with ``text``. Narrow.

    The odds are at most EVIDENCE numbers per domain, whatever the size of the corpus; they pass through the driver. A
    row's slots are first met with the strong ones, so weights are looked up for the few that count.
    """
    text = F.coalesce("text", F.lit(""))
    strong = sorted({slot for w in odds for slot in w})
    spoken = F.split(F.lit(",".join(map(str, strong))), ",").cast("array<int>") if strong else F.array().cast("array<int>")
    symbols, capitals = _share(text, "$%&*#|@^~_=+<>\\"), _share(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    worded = docs.withColumn("__words", _words(F.col("text")))
    worded = worded.withColumn("__hits", F.array_intersect(_slots(F.col("__words")), spoken))
    evidence = [F.log1p(_summed("__hits", w)) for w in odds]
    inputs = F.array(F.lit(1.0), *evidence, F.sqrt(symbols), F.sqrt(capitals))
    return worded.select(*docs.columns, inputs.alias("x"), F.size("__words").cast("long").alias("n"))


def _dot(x: Column, w) -> Column:
    return reduce(lambda a, b: a + b, [F.get(x, i) * float(v) for i, v in enumerate(w)])


def fit_curves(inputs: np.ndarray, domain: np.ndarray, domains: int, rounds: int = 30, ridge: float = 0.1) -> np.ndarray:
    """Weights of one logistic curve per domain, by damped Newton steps on the sample."""
    curves = np.zeros((domains, inputs.shape[1]))
    for k, w in enumerate(curves):
        y = domain == k
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(inputs @ w, -35, 35)))
            hessian = (inputs * (p * (1 - p))[:, None]).T @ inputs + ridge * np.eye(len(w))
            step = np.linalg.solve(hessian, inputs.T @ (p - y) + ridge * w)
            w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-5:
                break
    return curves


def posteriors(rows: DataFrame, curves: np.ndarray) -> Column:
    each = [1 / (1 + F.exp(-_dot(F.col("x"), w))) + 1e-12 for w in curves]
    total = reduce(lambda a, b: a + b, each)
    return F.array(*[e / total for e in each])


def _rate(p: Column, steps: list[np.ndarray]) -> Column:
    """Rate of a row after the steps: each takes its product with ``p`` off, and no rate falls below 0.

    The steps are one array literal, so that a further step changes a value and not the generated code.
    """
    taken = F.lit([[float(v) for v in s] for s in steps]) if steps else F.array().cast("array<array<double>>")
    product = lambda step: F.aggregate(F.zip_with(p, step, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return F.aggregate(taken, F.lit(1.0), lambda rate, step: F.greatest(F.lit(0.0), rate - product(step)))


def fit_rates(rows: DataFrame, domains: int, targets: list[float], rounds: int = 25, tolerance: float = 1e-5) -> list[np.ndarray]:
    """Steps of the projected gradient for rows with ``n`` and ``p``; see ``_rate`` for how a step moves a rate.

    The gradient is scaled by the inverse of sum n p p' over the documents whose rate is not 0; a step that does not
    bring the totals nearer is halved. One aggregate a round gives the totals and these sums.
    """
    p, n = F.col("p"), F.col("n").cast("double")
    wanted = np.array(targets, float)
    steps: list[np.ndarray] = []
    best, whole = np.inf, max(wanted.sum(), 1.0)
    upper = np.triu_indices(domains)
    for _ in range(rounds):
        own = F.when(F.col("__rate") > 0, n).otherwise(0.0)
        got = rows.withColumn("__rate", _rate(p, steps)).agg(
            *[F.sum(n * F.get(p, k) * F.col("__rate")).alias(f"t{k}") for k in range(domains)],
            *[F.sum(own * F.get(p, int(i)) * F.get(p, int(j))).alias(f"g{i}_{j}") for i, j in zip(*upper, strict=True)],
        ).first()
        got = np.array([v or 0.0 for v in got])
        miss = got[:domains] - wanted
        gap = np.abs(miss).max() / whole
        if gap <= tolerance:
            break
        if gap < best:
            gram = np.zeros((domains, domains))
            gram[upper] = got[domains:]
            gram = gram + np.triu(gram, 1).T
            steps.append(np.linalg.pinv(gram, rcond=1e-10) @ miss)
            settled, best = abs(best - gap) <= 1e-3 * tolerance, gap
            if settled:
                break
        else:
            steps[-1] = steps[-1] / 2
    else:
        warnings.warn(f"rates stopped after {rounds} rounds, {gap:.1e} of all tokens from their targets", stacklevel=2)
    return steps


def balance(tokens: dict[str | None, float], power: float) -> dict[str | None, float]:
    """Per value the factor that brings its share of the tokens to this power of the share; the total stays."""
    whole = sum(tokens.values())
    shares = {v: n / whole for v, n in tokens.items() if n > 0}
    powers = sum(s**power for s in shares.values())
    return {v: s ** (power - 1) / powers for v, s in shares.items()}


def _factor(column: str, factors: dict[str | None, float]) -> Column:
    """Factor of a row's value; 1 for values without tokens."""
    out = F.lit(1.0)
    for value, factor in factors.items():
        out = F.when(F.col(column).eqNullSafe(F.lit(value)), float(factor)).otherwise(out)
    return out


@dataclass
class Mixture:
    """What a fitted mixture needs to rate further rows."""

    domains: list[str]
    odds: list[dict[int, float]]
    curves: np.ndarray
    steps: list[np.ndarray]
    balanced: str | None = None  # column whose values have the factors
    factors: dict[str | None, float] = field(default_factory=dict)

    def rated(self, rows: DataFrame) -> DataFrame:
        """Add ``domain`` and ``rate`` to rows with ``n`` and ``p``."""
        best = F.array_position("p", F.array_max("p")).cast("int")
        return rows.select("*", F.element_at(F.array(*map(F.lit, self.domains)), best).alias("domain"), _rate(F.col("p"), self.steps).alias("rate"))

    def drawn(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The rows of ``docs``, each as often as its rate, times its factor, says: its whole part, and once more with the
        odds of the rest, drawn by a hash of the text. All columns stay. Narrow: nothing is joined or shuffled."""
        factor = _factor(self.balanced, self.factors) if self.balanced else F.lit(1.0)
        held = docs.select(F.struct("*").alias("__row"), F.col(text).alias("text"), factor.alias("factor"))
        inputs = with_inputs(held, self.odds)
        rated = self.rated(inputs.select("__row", "text", "factor", "n", posteriors(inputs, self.curves).alias("p")))
        rated = rated.withColumn("rate", F.col("rate") * F.col("factor"))
        draw = F.pmod(F.xxhash64("text", F.lit("mixture")), F.lit(1 << 30)) / float(1 << 30)
        copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
        often = rated.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
        return often.select([F.col("__row")[c].alias(c) for c in docs.columns])


def fit_mixture(
    docs: DataFrame, labels: DataFrame, keep: dict[str, float], doc_id: str = "doc_id", text: str = "text",
    as_kept: bool = False, sample_each: int = SAMPLE_EACH, balanced: str | None = None, power: float = 1.0,
) -> tuple[Mixture, DataFrame]:
    """Fit classifier and rates; returns them and the rows (doc_id, n, p) they were fitted on.

    ``keep`` names the domains and the share of its expected tokens that each shall hold. With ``as_kept`` the targets
    are instead the totals that come out if every document is kept at the mean share of its domains, which no rate
    above 1 is needed for. ``balanced`` names a column of few values whose shares of the tokens are brought to ``power``
    of them before the rates are fitted (``balance``).
    """
    domains, shares = list(keep), list(keep.values())
    value = [F.col(balanced).alias("value")] if balanced else []
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *value)
    known = labels.where(F.col("domain").isin(domains)).select(F.col(doc_id).alias("doc_id"), "domain").where("doc_id IS NOT NULL")
    picked = F.broadcast(bounded_sample(known, "domain", ["doc_id"], sample_each))
    odds = word_odds(rows.join(picked, "doc_id").select("text", "domain"), domains)
    seen = cut_lineage(with_inputs(rows, odds).drop("text"))
    sample = seen.join(picked, "doc_id").select("x", "domain").collect()
    x = np.array([r["x"] for r in sample], float).reshape(len(sample), 3 + len(domains))
    drawn = np.array([domains.index(r["domain"]) for r in sample], int)
    curves = fit_curves(x, drawn, len(domains))
    # the sample holds large domains in part only: move the curves back to the shares among all labelled rows
    there = dict(known.groupBy("domain").count().collect())
    for k, domain in enumerate(domains):
        seen_of, all_of = int((drawn == k).sum()), there.get(domain, 0)
        if 0 < seen_of < len(drawn) and 0 < all_of < sum(there.values()):
            curves[k, 0] += np.log(all_of / (sum(there.values()) - all_of)) - np.log(seen_of / (len(drawn) - seen_of))
    held = cut_lineage(seen.select("doc_id", "n", posteriors(seen, curves).alias("p"), *[c for c in seen.columns if c == "value"]))
    weight = _dot(F.col("p"), shares) if as_kept else F.lit(1.0)
    counted, factors = held, {}
    if balanced:
        factors = balance(dict(held.groupBy("value").agg(F.sum("n")).collect()), power)
        counted = held.withColumn("n", F.col("n") * _factor("value", factors))
    totals = counted.agg(*[F.sum(F.col("n") * F.get("p", k) * weight).alias(f"t{k}") for k in range(len(domains))]).first()
    targets = [(t or 0.0) * (1.0 if as_kept else s) for t, s in zip(totals, shares, strict=True)]
    return Mixture(domains, odds, curves, fit_rates(counted, len(domains), targets), balanced, factors), held.select("doc_id", "n", "p")


def soft_mixture(
    docs: DataFrame, labels: DataFrame, keep: dict[str, float], doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, words, probability of each domain (in the order of ``keep``), likeliest domain, rate.

    ``labels`` has the id and ``domain``; rows without one of them are left out, and an id with several domains counts
    for each. ``keep`` names the domains and, for each, the share of its expected tokens that the mixture shall hold; a
    share above 1 asks for more. Null texts have no words, and a document without words has no part in the totals but
    gets a rate; repeated rows count as often as they stand. Without labelled rows all domains are equally likely.
    """
    mixture, held = fit_mixture(docs, labels, keep, doc_id, text)
    return mixture.rated(held).select("doc_id", F.col("n").alias("n_tokens"), F.col("p").alias("posteriors"), "domain", "rate")

"""Quality rules whose cutoffs are controlled for risk.

Fixed base rules reject texts of under 20 words and those with more than 30 % of their words in repeated windows. Beyond them, rules reject a
text when one statistic exceeds a cutoff, and which rules and cutoffs a stratum (a class of length) gets is learned from labelled documents that pass the base rules. One half of
them, by a hash of doc_id, proposes: for each rule the cutoff that rejects most bad documents over good ones, then the rules by that gain, which makes
a path of ever stricter policies. The other half, the holdout, decides: along the path, each policy as a whole is tested by the exact binomial bound, and the
first that isn't proven ends it. Tests in a sequence fixed beforehand need no correction; the strata share delta (Bonferroni). So with
probability 1 - delta, in every stratum at once, all its rules together reject less than `alpha` of the good documents that pass the base rules. A stratum with too
few labels to prove anything keeps whatever the base rules keep.

Labels are counted by two distributed aggregates over all labelled rows, whose results are of a fixed size: strata x rules x grid steps, and strata x
policies. Null texts have no words and fail the base rules. Repeated rows are judged alike. Extra
columns of documents stay out of the way: only those named are read. No labels: base rules alone. No rows: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from .features import DIGITS, UPPER, base_counts

MIN_WORDS, MAX_REPEAT = 20, 30
#: Share of a stratum's good documents that its rules together may reject, and the chance that any stratum's promise fails.
ALPHA, DELTA = 0.01, 0.05
#: A rule's statistic and the steps of its cutoff, each a share from 0 to 1 or a mean.
RULES: dict[str, list[float]] = {
    "symbols_per_word": [i / 50 for i in range(1, 51)],
    "dup_line_share": [i / 50 for i in range(1, 50)],
    "repeat_share": [i / 100 for i in range(1, 31)],
    "upper_share": [i / 40 for i in range(1, 40)],
    "digit_share": [i / 40 for i in range(1, 40)],
    "bangs_per_word": [i / 40 for i in range(1, 41)],
    "word_chars_mean": [4 + i / 2 for i in range(40)],
}
#: Word counts at which a stratum ends.
LENGTHS = (100, 400, 1600)

_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{r} double" for r in RULES)


def _stats(b: bytes) -> tuple:
    words, chars, symbols, dup, repeat, n_lines, _ = base_counts(b)
    n = len(words)
    if not n:
        return (0, 0, symbols, 0, 0) + (0.0,) * len(RULES)
    less = lambda drop: len(b) - len(b.translate(None, drop))
    return (n, chars, symbols, dup, repeat, symbols / n, dup / n_lines, repeat / n, less(UPPER) / chars, less(DIGITS) / chars, b.count(b"!") / n, chars / n)


def rule_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns, the base counts and the rules' statistics of every text."""
    narrow = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"))
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    ints = 5

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_stats(b.as_py()) for b in batch.column(batch.num_columns - 1)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            made = [pa.array(c, pa.int64() if i < ints else pa.float64()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made, names=[*keep, *names])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [_SCHEMA])
    return narrow.mapInArrow(trimmed(count), schema).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    )


def stratum():
    """Length class: bounded in number whatever the corpus. Taken from counts of the text alone."""
    cls = F.lit(len(LENGTHS))
    for i in reversed(range(len(LENGTHS))):
        cls = F.when(F.col("n_words") < LENGTHS[i], i).otherwise(cls)
    return cls.cast("int")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exact; terms are added from k away from the mean until they no longer count."""
    if k >= n:
        return 1.0
    if k > n * p:
        return 1.0 - binomial_tail(n - k - 1, n, 1 - p)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = term, k
    while i > 0 and term > total * 1e-17:
        term *= i * (1 - p) / ((n - i + 1) * p)
        total, i = total + term, i - 1
    return min(1.0, total)


Path = list[tuple[str, float]]


def propose(counts: pd.DataFrame, alpha: float) -> dict[int, Path]:
    """counts: stratum, rule, step, good, bad (documents of the proposing half whose statistic first stays within the cutoff `step`; the last step is past the grid).

    Of a rule's cutoffs that reject a quarter of alpha of the good documents at most, the one that rejects most bad documents over good ones, the laxest of
    equals; none if it rejects no more bad ones than good. Returns for each stratum (rule, cutoff), the highest gain first.
    """
    out: dict[int, Path] = {}
    for s, own in counts.groupby("stratum", sort=True):
        best = []
        for rule, g in own.groupby("rule", sort=True):
            grid = RULES[rule]
            by = g.groupby("step")[["good", "bad"]].sum().reindex(range(len(grid) + 1), fill_value=0)
            past = by[::-1].cumsum()[::-1].shift(-1, fill_value=0)  # beyond each cutoff
            n = int(by["good"].sum())
            gains = [(int(past["bad"][i]) - int(past["good"][i]), i) for i in range(len(grid)) if past["good"][i] * 4 <= alpha * n]
            gain, i = max(gains, default=(0, 0))
            if gain > 0:
                best.append((-gain, rule, grid[i]))
        out[int(s)] = [(rule, cutoff) for _, rule, cutoff in sorted(best)]
    return out


def certify(counts: pd.DataFrame, paths: dict[int, Path], alpha: float, delta: float) -> dict[int, Path]:
    """counts: stratum, at, good (good documents of the holdout by the first entry of their stratum's path that rejects them; as many as entries: none).

    Each stratum's longest start of its path of which every policy up to it is proven.
    """
    strata = len(LENGTHS) + 1
    out = {}
    for s, path in paths.items():
        by = counts[counts["stratum"] == s].groupby("at")["good"].sum().reindex(range(len(path) + 1), fill_value=0)
        n, rejected, kept = int(by.sum()), 0, []
        for i, entry in enumerate(path):
            rejected += int(by[i])
            if binomial_tail(rejected, n, alpha) > delta / strata:
                break
            kept.append(entry)
        if kept:
            out[s] = kept
    return out


def learn_cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> list[tuple[int, str, float]]:
    """(stratum, rule, cutoff), from all labelled documents that pass the base rules. Of each label's repeats, the best counts."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__q"))
    rows = stats.where(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("__id")).withColumn("__s", stratum()).withColumn("__half", F.pmod(F.xxhash64("__id"), F.lit(2)))
    step = lambda rule: F.lit(len(RULES[rule])) - F.size(F.filter(F.array(*map(F.lit, RULES[rule])), lambda c: F.col(rule) <= c))
    steps = F.array(*(F.struct(F.lit(r).alias("rule"), step(r).alias("step")) for r in RULES))
    of = lambda q: F.count(F.when(F.col("__q") == q, 1))
    counts = rows.where("__half = 0").select(F.col("__s").alias("stratum"), "__q", F.explode(steps).alias("x")).groupBy("stratum", "x.rule", "x.step").agg(of(1).alias("good"), of(0).alias("bad"))
    paths = propose(counts.toPandas(), alpha)  # strata x rules x grid steps at most
    at = F.lit(0)
    for s, path in paths.items():
        first = F.lit(len(path))
        for i in reversed(range(len(path))):
            first = F.when(F.col(path[i][0]) > F.lit(path[i][1]), i).otherwise(first)
        at = F.when(F.col("__s") == s, first).otherwise(at)
    tested = rows.where("__half = 1").groupBy(F.col("__s").alias("stratum"), at.alias("at")).agg(of(1).alias("good")).toPandas()  # strata x policies at most
    return [(s, rule, cutoff) for s, path in certify(tested, paths, alpha, delta).items() for rule, cutoff in path]


def verdict(cutoffs: list[tuple[int, str, float]]):
    """True for what neither the base rules nor a cutoff rejects."""
    bad = F.col("base_failed")
    for s, rule, cutoff in cutoffs:
        bad = bad | ((stratum() == s) & (F.col(rule) > F.lit(cutoff)))
    return ~bad


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], alpha: float = ALPHA, delta: float = DELTA, table=None) -> DataFrame:
    """keep columns, the statistics, base_failed and kept. table: writes the statistics, so that texts are read once."""
    stats = rule_stats(docs, keep)
    stats = table(stats, "rule-stats") if table else stats
    return stats.withColumn("kept", verdict(learn_cutoffs(stats, labels, alpha, delta)))

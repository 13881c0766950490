"""Per-sample metrics as column expressions, in a registry; Arrow functions only where no expression can say it."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.functions.text import once

#: Metrics by name: (prediction, reference, **options) -> score as double.
METRICS: dict[str, Callable[..., Column]] = {}


def register_metric(name: str) -> Callable[[Callable[..., Column]], Callable[..., Column]]:
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        if name in METRICS:
            raise ValueError(f"metric {name} exists")
        METRICS[name] = f
        return f

    return add


def _score(c: Column) -> Column:
    """1.0 or 0.0; null counts as 0."""
    return F.coalesce(c, F.lit(False)).cast("double")


@register_metric("exact_match")
def exact_match(prediction: Column, reference: Column) -> Column:
    return _score(F.lower(text.stripped(prediction)) == F.lower(text.stripped(reference)))


METRICS["acc"] = exact_match


@register_metric("inclusion")
def inclusion(prediction: Column, reference: Column) -> Column:
    """Whether a non-empty prediction stands in the reference."""
    return _score((prediction != "") & F.contains(reference, prediction))


@register_metric("numeric_match")
def numeric_match(prediction: Column, reference: Column) -> Column:
    return _score(prediction == reference)


@register_metric("multi_choice_acc")
def multi_choice_acc(prediction: Column, reference: Column) -> Column:
    """Share of the right letters that were chosen; 0 with any wrong one."""
    letters = lambda c: F.array_distinct(F.filter(F.split(F.upper(F.coalesce(c, F.lit(""))), ""), lambda x: x != ""))
    p, r = letters(prediction), letters(reference)
    return F.when((F.size(p) == 0) | (F.size(r) == 0) | (F.size(F.array_except(p, r)) > 0), 0.0).otherwise(F.size(F.array_intersect(p, r)) / F.size(r))


@register_metric("anls")
def anls(prediction: Column, references: Column, threshold: float = 0.5) -> Column:
    """The best of 1 - edits/length over an array of references, 0 below the threshold. Edits are counted on lower
    case with single blanks, lengths on the texts as they are; two empty texts agree."""
    squeezed = lambda c: F.lower(F.regexp_replace(text.stripped(c), r"\s+", " "))
    longest = lambda r: F.greatest(F.char_length(prediction), F.char_length(r))
    one = lambda r: F.when(longest(r) == 0, 0.0).otherwise(F.levenshtein(squeezed(prediction), squeezed(r)) / longest(r))
    best = F.array_min(F.transform(references, one))
    return F.when(F.coalesce(1 - best, F.lit(0.0)) < threshold, 0.0).otherwise(1 - best)


@register_metric("numeric_equal")
def numeric_equal(prediction: Column, reference: Column, tolerance: float = 1e-4) -> Column:
    """Equal as numbers, also as percentages of each other, with a relative tolerance; text that is no number compares as text."""
    number = lambda c: F.regexp_replace(c, r"[,%$\s]", "").try_cast("double")
    p, r = number(prediction), number(reference)
    near = lambda x: F.abs(p - x) <= tolerance * F.abs(x)
    return _score(F.coalesce((near(r) | near(r / 100) | near(r * 100)), F.lower(text.stripped(prediction)) == F.lower(text.stripped(reference))))


@register_metric("relaxed_accuracy")
def relaxed_accuracy(prediction: Column, reference: Column, tolerance: float = 0.05) -> Column:
    """Numbers within a share of the reference; a reference of 0 and words must be equal."""
    number = lambda c: F.when(F.endswith(text.stripped(c), F.lit("%")), F.regexp_replace(c, "%", "").try_cast("double") / 100).otherwise(text.stripped(c).try_cast("double"))
    p, r = number(prediction), number(reference)
    return F.when(p.isNotNull() & r.isNotNull() & (r != 0), _score(F.abs(p - r) / F.abs(r) <= tolerance)).otherwise(exact_match(prediction, reference))


def _bag_overlap(p: Column, r: Column) -> Column:
    """How many tokens two lists share, with repetition; a token is counted by what removing it takes off, which runs
    without a lambda over the tokens."""
    count = lambda a, w: F.size(a) - F.size(F.array_remove(a, w))
    return F.aggregate(F.array_intersect(p, r), F.lit(0), lambda s, w: s + F.least(count(p, w), count(r, w)))


def bag_scores(p: Column, r: Column) -> Column:
    """struct<precision, recall, f1> of two token lists."""

    def score(x: Column) -> Column:
        precision, recall = F.coalesce(F.try_divide(x["n"], F.size(x["p"])), F.lit(0.0)), F.coalesce(F.try_divide(x["n"], F.size(x["r"])), F.lit(0.0))
        return F.struct(precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))

    return once(_overlap(p, r), score)


def _overlap(p: Column, r: Column) -> Column:
    """struct<p, r, n>: two token lists and how many tokens they share."""
    return once(F.struct(p.alias("p"), r.alias("r")), lambda x: F.struct(x["p"].alias("p"), x["r"].alias("r"), _bag_overlap(x["p"], x["r"]).cast("double").alias("n")))


def rouge_n(prediction: Column, reference: Column, n: int = 1, by: str = "letters") -> Column:
    """struct<precision, recall, f1> over n-grams of words, which text.words() tells apart."""
    return bag_scores(text.ngrams(text.words(prediction, by), n), text.ngrams(text.words(reference, by), n))


def best_over(prediction: Column, references: Column, score: Callable[[Column, Column], Column]) -> Column:
    """The highest score over several references; 0 without any."""
    return F.coalesce(F.array_max(F.transform(references, lambda r: score(prediction, r))), F.lit(0.0))


def clipped_precision(prediction: Column, reference: Column, n: int = 1) -> Column:
    """BLEU's n-gram precision times its brevity penalty; 0 without n-grams."""

    def score(x: Column) -> Column:
        shared = _overlap(text.ngrams(x["p"], n), text.ngrams(x["r"], n))
        brevity = F.when(F.size(x["p"]) >= F.size(x["r"]), 1.0).otherwise(F.exp(1 - F.try_divide(F.size(x["r"]), F.size(x["p"]))))
        return F.coalesce(once(shared, lambda y: F.try_divide(y["n"], F.size(y["p"]))) * brevity, F.lit(0.0))

    return once(F.struct(text.words(prediction).alias("p"), text.words(reference).alias("r")), score)


def diversity(c: Column, orders: tuple[int, ...] = (2, 3, 4)) -> Column:
    """The product of the shares of distinct n-grams; 0 where a text is too short for one of the orders."""

    def score(tokens: Column) -> Column:
        out = F.lit(1.0)
        for n in orders:
            out = out * once(text.ngrams(tokens, n), lambda g: F.coalesce(F.try_divide(F.size(F.array_distinct(g)), F.size(g)), F.lit(0.0)))
        return out

    return once(text.words(c), score)


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct tokens by all distinct tokens; 0 for two empty lists."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal length in double precision; null where one has no length."""
    add = lambda s, x: s + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), add))
    return F.try_divide(dot, norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def mean_pairwise(items: Column, distance: Callable[[Column, Column], Column]) -> Column:
    """The mean of a distance over all pairs i < j of a row's array; 0 with fewer than two items."""
    pairs = F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y: distance(x, y))))
    return F.when(F.size(items) < 2, 0.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d, lambda s: s / F.size(pairs)))


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """The unbiased estimate that one of k samples passes, of n with c passing: 1 - prod(1 - k/i), i = n-c+1..n."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1 - k / i))
    return F.when(c <= 0, 0.0).when(n - c < k, 1.0).otherwise(1 - product)


def pass_hat_k(n: Column, c: Column, k: Column) -> Column:
    """The estimate that all of k samples pass: C(c, k) / C(n, k)."""
    return F.when(c < k, 0.0).otherwise(F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint") - 1), F.lit(1.0), lambda acc, i: acc * (c - i) / (n - i)))


def verdict(c: Column) -> Column:
    """YES or NO by the first word yes, true, no or false of a judge's text, in any case; null where it has none."""
    word = F.lower(F.regexp_extract(c, r"(?i)(?:^|[^a-z0-9_])(yes|no|true|false)(?:[^a-z0-9_]|$)", 1))
    return F.when(word.isin("yes", "true"), "YES").when(word.isin("no", "false"), "NO")


def judged_score(c: Column) -> Column:
    """The last number in a judge's text, clamped to 0..1; null without one."""
    last = F.try_element_at(F.regexp_extract_all(c, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), F.lit(-1)).cast("double")
    return F.when(last.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), last)))  # greatest and least pass over nulls


def pairwise_score(c: Column, reversed_game: bool = False) -> Column:
    """A verdict such as [[A>B]] as the score of A; of the swapped game as the score of B. 0.5 without a verdict."""
    verdict = F.regexp_extract(c, r"\[\[(A>>B|A>B|A=B|B>A|B>>A)\]\]", 1)
    a = F.when(verdict == "A>>B", 1.0).when(verdict == "A>B", 0.75).when(verdict == "B>A", 0.25).when(verdict == "B>>A", 0.0).otherwise(0.5)
    return 1 - a if reversed_game else a


def eq_score(differences: Column) -> Column:
    """Ten less 0.7477 times the scaled differences of four ratings: differences up to 5 count by a logistic curve."""
    scaled = F.transform(differences, lambda d: F.when(d == 0, 0.0).when(d <= 5, 6.5 / (1 + F.exp(-1.2 * (d - 4)))).otherwise(d.cast("double")))
    raw = 10 - 0.7477 * F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw / 10))


def rubric_score(met: Column, points: Column) -> Column:
    """Points of the met criteria by all positive points, from parallel arrays; null without positive points."""
    got = F.aggregate(F.zip_with(met, points, lambda m, p: F.when(m, p).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    best = F.aggregate(F.filter(points, lambda p: p > 0), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(got, best)


def _lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_l(prediction: Column, reference: Column, by: str = "letters") -> Column:
    """F1 over the longest common subsequence of words; an Arrow function, as the recurrence needs a table."""

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ps, rs in batches:
            out = []
            for p, r in zip(ps, rs, strict=True):
                p, r = list(p), list(r)
                n = _lcs(p, r) if p and r else 0
                out.append(2 * n / (len(p) + len(r)) if n else 0.0)
            yield pd.Series(out, dtype="float64")

    return F.pandas_udf(score, "double")(text.words(prediction, by), text.words(reference, by))


def rouge_l_sum(prediction: Column, reference: Column) -> Column:
    """F1 over the union of each reference line's common subsequence words with the prediction's lines (an Arrow function)."""

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ps, rs in batches:
            out = []
            for p, r in zip(ps, rs, strict=True):
                p, r = [list(x) for x in p], [list(x) for x in r]
                left, right = Counter(w for x in p for w in x), Counter(w for x in r for w in x)
                n, sizes = 0, (left.total(), right.total())
                for line in r:
                    for i in sorted(set().union(*(_lcs_places(line, other) for other in p))) if p else []:
                        if left[line[i]] > 0 and right[line[i]] > 0:
                            n, left[line[i]], right[line[i]] = n + 1, left[line[i]] - 1, right[line[i]] - 1
                out.append(2 * n / sum(sizes) if n else 0.0)
            yield pd.Series(out, dtype="float64")

    lines = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), r"\n"), lambda x: text.words(x))
    return F.pandas_udf(score, "double")(lines(prediction), lines(reference))


def _lcs_places(a: list[str], b: list[str]) -> set[int]:
    """The places in ``a`` of one longest common subsequence with ``b``."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = set(), 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def sequence_ratio(a: Column, b: Column) -> Column:
    """Matching-block ratio of two texts (an Arrow function); 0 for null."""

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            yield pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else 0.0 for x, y in zip(xs, ys, strict=True)], dtype="float64")

    return F.pandas_udf(score, "double")(a, b)


def word_error_rate(prediction: Column, reference: Column) -> Column:
    """Word edits by the reference's length (an Arrow function); of an empty reference 0 or 1."""

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ps, rs in batches:
            out = []
            for p, r in zip(ps, rs, strict=True):
                p, r = list(p), list(r)
                row = list(range(len(r) + 1))
                for i, x in enumerate(p, 1):
                    before, row[0] = row[0], i
                    for j, y in enumerate(r, 1):
                        before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
                out.append(row[-1] / len(r) if r else float(bool(p)))
            yield pd.Series(out, dtype="float64")

    return F.pandas_udf(score, "double")(text.words(prediction), text.words(reference))

"""Corpus scores over tagged spans and character n-grams, from per-row counts that add up."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import answers
from tallyloom.operators.aggregate import ratio


def entity_scores(df: DataFrame, by: list[str], gold: str, predicted: str) -> DataFrame:
    """(*by, type, tp, n_gold, n_predicted, precision, recall, f1): micro scores of BIO-tagged spans by type and, as
    type ``all``, together. Null tags hold no spans."""

    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[f"{k}|{s}|{e}" for k, s, e in sorted(answers.entities(list(t)))] if t is not None else [] for t in b])

    find = F.pandas_udf(spans, "array<string>")
    s = df.select(*by, find(gold).alias("g"), find(predicted).alias("p"))
    none = F.array().cast("array<string>")
    sides = lambda g, p: F.transform(F.array_union(g, p), lambda x: F.struct(F.substring_index(x, "|", 1).alias("type"), F.array_contains(g, x).alias("in_g"), F.array_contains(p, x).alias("in_p")))
    each = s.select(*by, F.explode(sides(F.coalesce("g", none), F.coalesce("p", none))).alias("x")).select(*by, F.explode(F.array(F.col("x.type"), F.lit("all"))).alias("type"), "x.in_g", "x.in_p")
    c = each.groupBy(*by, "type").agg(F.count_if(F.col("in_g") & F.col("in_p")).alias("tp"), F.count_if(F.col("in_g")).alias("n_gold"), F.count_if(F.col("in_p")).alias("n_predicted"))
    tp = F.col("tp").cast("double")
    return c.select("*", ratio(tp, F.col("n_predicted")).alias("precision"), ratio(tp, F.col("n_gold")).alias("recall"), ratio(2 * tp, F.col("n_predicted") + F.col("n_gold")).alias("f1"))


def corpus_chrf(df: DataFrame, by: list[str], predicted: str, reference: str, order: int = 6, beta: float = 2.0) -> DataFrame:
    """(*by, chrf): the F-score over character n-grams without blanks, precision and recall averaged over the orders.

    Rows give counts by order, which add up; null texts count as empty.
    """

    def counts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ps, rs in batches:
            out = []
            for p, r in zip(ps, rs, strict=True):
                p, r = "".join((p or "").split()), "".join((r or "").split())
                row: list[float] = []
                for n in range(1, order + 1):
                    a, b = Counter(p[i : i + n] for i in range(len(p) - n + 1)), Counter(r[i : i + n] for i in range(len(r) - n + 1))
                    row += [float(sum((a & b).values())), float(sum(a.values())), float(sum(b.values()))]
                out.append(row)
            yield pd.Series(out)

    c = df.select(*by, F.pandas_udf(counts, "array<double>")(predicted, reference).alias("c"))
    s = c.groupBy(*by).agg(*[F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(3 * order)])
    mean = lambda k: sum((ratio(F.col(f"c{3 * n}"), F.col(f"c{3 * n + k}")) for n in range(order)), F.lit(0.0)) / order
    p, r = mean(1), mean(2)
    return s.select(*by, (100 * ratio((1 + beta**2) * p * r, beta**2 * p + r)).alias("chrf"))

"""Filling containers of fixed capacity with items of varying length.

Method: first-fit decreasing, with a tournament tree over the bins' free space, run independently in randomised
groups of documents. A group is one task's work and has about ``group_items`` items at any size of the input, so
groups only become more. Each group leaves less than about one bin's worth of space unused, on groups of hundreds of
bins.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import durable


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, none above the capacity, by the leftmost bin with room, largest sizes first.

    A node of the tree holds the most free space below it, so the leftmost fitting bin takes log2(bins) steps. Equal
    sizes keep their order.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    width = 1 << max(0, (len(sizes) - 1).bit_length())
    free = [capacity] * (2 * width)
    place = [0] * len(sizes)
    for i in order:
        need, node = sizes[i], 1
        while node < width:
            node *= 2
            if free[node] < need:
                node += 1
        place[i] = node - width
        free[node] -= need
        node //= 2
        while node:
            left, right = free[2 * node], free[2 * node + 1]
            free[node] = left if left >= right else right
            node //= 2
    return place


def pack(items: DataFrame, containers: DataFrame, group_items: int = 10_000, max_containers: int = 1_000) -> DataFrame:
    """(container, capacity, bin, doc_id, piece, token_start, n_tokens): where each item lies, for each container.

    ``items`` (doc_id, n_tokens > 0); ``containers`` (container, capacity_tokens), at most ``max_containers`` rows, of
    which null and non-positive capacities are refused. An item above the capacity is split into full pieces, each a
    bin of its own, and a rest that is packed like any item; no other item is split. Repeated rows are items of
    their own. Bins are numbered uniquely within a container. No items give no rows.
    """
    kinds = [(r["container"], r["capacity_tokens"]) for r in containers.select("container", "capacity_tokens").limit(max_containers + 1).collect()]
    if len(kinds) > max_containers or any(c is None or c <= 0 for _, c in kinds):
        raise ValueError("containers must be few, and their capacities positive")
    stored = durable(items.select("doc_id", "n_tokens"), "sizes")
    groups = max(1, math.ceil(stored.count() / group_items))
    # the id keeps copies of one row apart, which may be a third of all rows; it is stable, as it numbers written files
    grouped = stored.withColumn("_group", F.pmod(F.xxhash64("doc_id", "n_tokens", F.monotonically_increasing_id()), F.lit(groups)))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
        sizes, docs = pdf["n_tokens"].to_numpy(), pdf["doc_id"].to_numpy()
        out = []
        for name, capacity in kinds:
            full, rest = sizes // capacity, sizes % capacity
            left = np.flatnonzero(rest > 0)
            place = first_fit_decreasing(rest[left].tolist(), capacity)
            bins = max(place, default=-1) + 1
            of = np.repeat(np.arange(len(sizes)), full)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(full) - full, full)
            index = np.concatenate([of, left])
            piece = np.concatenate([nth, full[left]])
            where = np.concatenate([bins + np.arange(len(of)), np.array(place, dtype=np.int64)])
            out.append(pd.DataFrame({
                "container": name, "capacity": capacity, "bin": int(key[0]) * 2**32 + where.astype(np.int64), "doc_id": docs[index], "piece": piece.astype(np.int64),
                "token_start": piece.astype(np.int64) * capacity, "n_tokens": np.concatenate([np.full(len(of), capacity), rest[left]]).astype(np.int64),
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=["container", "capacity", "bin", "doc_id", "piece", "token_start", "n_tokens"])

    return grouped.groupBy("_group").applyInPandas(fill, "container string, capacity bigint, bin bigint, doc_id bigint, piece bigint, token_start bigint, n_tokens bigint")


def fill_report(packed: DataFrame) -> DataFrame:
    """(container, capacity, n_bins, n_items, n_split, tokens, fill): how full the bins of each container are."""
    bins = packed.groupBy("container", "capacity", "bin").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.sum((F.col("piece") > 0).cast("int")).alias("s"))
    whole = bins.groupBy("container", "capacity").agg(F.count("*").alias("n_bins"), F.sum("n").alias("n_items"), F.sum("s").alias("n_split"), F.sum("t").alias("tokens"))
    return whole.withColumn("fill", F.col("tokens") / (F.col("n_bins") * F.col("capacity")))

"""What the operators on groups and shards share: groups of positions in a task, runs of equal keys, joins with hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows of numbers up to which a table, once counted, is broadcast.
BROADCAST_ROWS = 200_000
#: A key is hot if it holds more than this part of all rows (and more than LEAST_HOT); so there are at most that many.
HOT_KEYS, LEAST_HOT = 50_000, 1000


def sized(table: DataFrame, count: int) -> DataFrame:
    """Broadcast a table that a count shows to be small; leave the join to Spark beyond that."""
    return F.broadcast(table) if count <= BROADCAST_ROWS else table


def join_unique(rows: DataFrame, key: str, lookup: DataFrame, lookup_key: str, count: int, total: int | None = None) -> DataFrame:
    """rows left-joined to a lookup of `count` rows, one for each key. Keys that hold very many rows are few, so their part of
    a large lookup is broadcast and no task gets all rows of a key."""
    same = F.col(key) == F.col(lookup_key)
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(lookup), same, "left")
    total = rows.count() if total is None else total
    hot = cut(rows.groupBy(F.col(key).alias("__hot")).count().where(F.col("count") > max(LEAST_HOT, total // HOT_KEYS)).select("__hot"))
    if hot.isEmpty():
        return rows.join(lookup, same, "left")
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    few = lookup.join(F.broadcast(hot), F.col(lookup_key) == F.col("__hot"), "left_semi")
    often = marked.where(F.col("__hot").isNotNull()).drop("__hot").join(F.broadcast(few), same, "left")
    return often.unionByName(marked.where(F.col("__hot").isNull()).drop("__hot").join(lookup, same, "left"))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of the batches whose first `keys` columns are equal, with their values."""
    for batch in batches:
        names = list(zip(*[batch.column(i).to_pylist() for i in range(keys)], strict=True))
        start = 0
        for i in range(1, len(names) + 1):
            if i == len(names) or names[i] != names[start]:
                yield names[start], batch.slice(start, i - start)
                start = i


def join_groups(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, each place's smaller place of its group, once the groups of a and b are one."""
    while len(a) and (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        for ends in (root[a], root[b], a, b):
            np.minimum.at(root, ends, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def join_verified(root: np.ndarray, a: np.ndarray, b: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """As join_groups, for pairs that `same` accepts. Pairs inside one group need no answer, so each group first asks about one of its pairs,
    then about twice as many, and so on: in a large group of copies nearly all pairs are never asked about."""
    many = 1
    while True:
        cross = root[a] != root[b]
        a, b = a[cross], b[cross]
        if not len(a):
            return root
        group = root[a]
        order = np.argsort(group, kind="stable")
        sorted_ = group[order]
        place = np.arange(len(a)) - np.searchsorted(sorted_, sorted_)
        pick = order[place < many]
        yes = pick[same(a[pick], b[pick])]
        root = join_groups(root, a[yes], b[yes])
        left = np.ones(len(a), dtype=bool)
        left[pick] = False
        a, b, many = a[left], b[left], 2 * many

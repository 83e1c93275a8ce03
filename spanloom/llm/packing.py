"""Filling containers of fixed capacity with whole items (problem 6).

Only the histogram of item sizes decides which sizes share a container, and it has at most capacity + 2 rows
however many items there are. Shallow combinations of sizes that fill a window below the capacity are
enumerated, non-negative least squares fits how often each is to be repeated so that the histogram is used
up, the counts are rounded down, and what remains is packed greedily, largest size first. Items are then
numbered within their size and take the place of their number, which is a lookup and no sequential pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAPACITY, DEPTH, SWEEPS = 8192, 12, 25
#: The window is this part of the capacity: combinations that leave more room are not offered to the fit.
WINDOW_PART = 170


def _largest_fit(sizes: np.ndarray, left: np.ndarray, room: int, skip: int = 0) -> int:
    """Index of the largest size within ``room`` of which some are left, or -1; ``skip`` passes over that many."""
    k = int(np.searchsorted(sizes, room, side="right")) - 1
    while k >= 0:
        if left[k] > 0:
            if not skip:
                return k
            skip -= 1
        k -= 1
    return -1


def combinations(sizes: np.ndarray, counts: np.ndarray, capacity: int, window: int, depth: int = DEPTH) -> list[dict[int, int]]:
    """Combinations of at most ``depth`` sizes whose sum is within ``window`` of the capacity, as {index: times}.

    Each size begins several: filled up with the largest fitting sizes, with copies of itself, and with the
    commonest sizes below it, each time closed by the size that comes nearest to the rest.
    """
    out: dict[tuple, dict[int, int]] = {}
    common = np.argsort(-counts, kind="stable")[:64]
    for first in range(len(sizes) - 1, -1, -1):
        for style in range(4):
            used: dict[int, int] = {first: 1}
            room, n = capacity - int(sizes[first]), 1
            while room > 0 and n < depth:
                if style == 0:
                    k = _largest_fit(sizes, counts, room)
                elif style == 1 and sizes[first] <= room and counts[first] > used[first]:
                    k = first
                elif style == 2:
                    fits = common[(sizes[common] <= room)]
                    k = int(fits[(first + n) % len(fits)]) if len(fits) and room > 2 * window else _largest_fit(sizes, counts, room)
                else:
                    # Split the room in equal parts: the sizes nearest to a half or a third of it.
                    part = room if n >= 4 else max(1, room // (2 + (first + n) % 2))
                    k = _largest_fit(sizes, counts, part)
                if k < 0 or sizes[k] == 0 or used.get(k, 0) >= counts[k]:
                    k = _largest_fit(sizes, np.where(np.arange(len(sizes)) == k, 0, counts), room) if k >= 0 else -1
                    if k < 0 or sizes[k] == 0 or used.get(k, 0) >= counts[k]:
                        break
                used[k] = used.get(k, 0) + 1
                room -= int(sizes[k])
                n += 1
            if 0 <= room <= window:
                out.setdefault(tuple(sorted(used.items())), used)
    return list(out.values())


def least_squares(columns: list[dict[int, int]], counts: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative x that brings the combinations' sums near to the histogram, by cyclic coordinate descent."""
    keys = [np.fromiter(c.keys(), np.int64) for c in columns]
    times = [np.fromiter(c.values(), np.float64) for c in columns]
    norms = [float(t @ t) for t in times]
    rest, x = counts.astype(np.float64), np.zeros(len(columns))
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(columns)):
            step = max(-x[j], float(times[j] @ rest[keys[j]]) / norms[j])
            if step:
                x[j] += step
                rest[keys[j]] -= step * times[j]
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def _greedy(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Containers of what is left, each filled with the largest size that fits, again and again; as often as the counts allow."""
    out = []
    while left.any():
        alive = np.flatnonzero(left)
        small, have = sizes[alive], left[alive]
        used: dict[int, int] = {}
        room, k = capacity, len(small) - 1
        while k >= 0:
            n = min(int(have[k]), room // int(small[k]))
            if n:
                used[k] = n
                room -= n * int(small[k])
            k = min(k - 1, int(np.searchsorted(small, room, side="right")) - 1)
        n = min(int(have[k]) // t for k, t in used.items())
        for k, t in used.items():
            left[alive[k]] -= n * t
        out.append((n, {int(small[k]): t for k, t in used.items()}))
    return out


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, window: int | None = None) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {size: times}) for every container of the packing of a histogram of sizes 1 to capacity.

    Where sizes above half the capacity abound, combinations of small ones take what would have filled their containers
    up; the rounded fit is therefore tried whole, by half and not at all, and the packing of fewest containers stands.
    """
    order = np.argsort(sizes)
    sizes, counts = sizes[order].astype(np.int64), counts[order].astype(np.int64)
    columns = combinations(sizes, counts, capacity, max(1, capacity // WINDOW_PART) if window is None else window)
    x = least_squares(columns, counts) if columns else np.zeros(0)
    best: list[tuple[int, dict[int, int]]] | None = None
    for share in (1.0, 0.5, 0.0):
        left, out = counts.copy(), []
        for j in np.argsort(-x, kind="stable"):
            n = min([int(x[j] * share), *(int(left[k]) // t for k, t in columns[j].items())])
            if n > 0:
                for k, t in columns[j].items():
                    left[k] -= n * t
                out.append((n, {int(sizes[k]): t for k, t in columns[j].items()}))
        out += _greedy(sizes, left, capacity)
        if best is None or sum(n for n, _ in out) < sum(n for n, _ in best):
            best = out
    return best or []


def _runs(packing: list[tuple[int, dict[int, int]]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted (size, number) starts of runs as one key, the first container and the items a container of each, and the number of containers."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for n, combination in packing:
        for size, times in combination.items():
            at = used.get(size, 0)
            rows.append(((size << 44) + at, base, times))
            used[size] = at + n * times
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2], base


def pack(df: DataFrame, capacity: int = CAPACITY, key: str = "fragment_id", text: str = "text", window: int | None = None) -> DataFrame:
    """One row a key: key, n_bytes, container (bigint from 0). No container exceeds the capacity but by a single larger item.

    Repeated deliveries of a key count once. Null and empty texts take no room: they all go to container 0, which is
    then there even if nothing else is. Null keys form one item. Other columns are not carried. An empty table gives
    no row. The driver receives the histogram, at most ``capacity`` + 2 rows, and nothing else.
    """
    size = F.least(F.coalesce(F.octet_length(F.col(text)), F.lit(0)), F.lit(2**31 - 1)).cast("long")
    items = df.select(F.col(key).alias("_key"), size.alias("_bytes")).groupBy("_key").agg(F.max("_bytes").alias("_bytes"))
    salts = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    items = items.withColumn("_class", F.least(F.col("_bytes"), F.lit(capacity + 1))).withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int"))
    # At most (capacity + 2) * salts rows from here on, whatever the number of items.
    parts = items.groupBy("_class", "_salt").agg(F.count("*").alias("_n"))
    histogram = {r["_class"]: r["n"] for r in parts.groupBy("_class").agg(F.sum("_n").alias("n")).collect()}
    fit = sorted(k for k in histogram if 0 < k <= capacity)
    packing = plan(np.array(fit, np.int64), np.array([histogram[k] for k in fit], np.int64), capacity, window) if fit else []
    starts, bases, times, total = _runs(packing, capacity)
    if not total and 0 in histogram:
        total = 1
    before = Window.partitionBy("_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = items.withColumn("_in", F.row_number().over(Window.partitionBy("_class", "_salt").orderBy("_key"))).join(offsets, ["_class", "_salt"])

    def place(kind: pd.Series, number: pd.Series) -> pd.Series:
        k, n = kind.to_numpy(np.int64), number.to_numpy(np.int64)
        out = np.where(k == 0, 0, total + n)
        inner = (k > 0) & (k <= capacity)
        if inner.any():
            run = np.searchsorted(starts, (k[inner] << 44) + n[inner], side="right") - 1
            out[inner] = bases[run] + ((k[inner] << 44) + n[inner] - starts[run]) // times[run]
        return pd.Series(out)

    container = F.pandas_udf(place, "long")
    return numbered.select(F.col("_key").alias(key), F.col("_bytes").alias("n_bytes"), container(F.col("_class"), F.col("_before") + F.col("_in") - 1).alias("container"))

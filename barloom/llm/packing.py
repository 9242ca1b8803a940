"""Filling fixed-capacity containers with whole texts.

Lengths in tokens go into a histogram of at most UNITS length classes per capacity. Patterns of few
lengths (one length several times, and up to two more) that fill a container are enumerated, and
non-negative least squares finds how often each must repeat to use the histogram up. The repeat
counts are rounded down in every shard of the texts, the shard's texts take the places of the
patterns, and what is left is packed best-fit into the room that remains. A shard holds about
`shard_rows` texts whatever the size of the table, so no task sees more than that.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = 128

_TOKENIZERS: dict[str, object] = {}


def default_vocabulary() -> str:
    """Where the byte-level vocabulary lies; the path is a parameter of everything that counts tokens."""
    folder = os.environ.get("BARLOOM_TOKENIZERS", "/opt/tokenizers")
    return f"{folder}/byte_bpe_50k.tiktoken"


def _tokenizer(path: str, pattern: str | None):
    key = f"{path}|{pattern}"
    if key not in _TOKENIZERS:
        import base64

        import tiktoken

        if pattern is None:
            # The usual splitting pattern of this family of byte-level vocabularies.
            pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        with open(path) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _TOKENIZERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _TOKENIZERS[key]


def _count(batches: Iterator[pd.DataFrame], path: str, pattern: str | None) -> Iterator[pd.DataFrame]:
    enc = _tokenizer(path, pattern)
    for pdf in batches:
        n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["__text"]]
        yield pd.DataFrame({"id": pdf["__id"], "tokens": np.array(n, dtype=np.int64)})


def token_counts(df: DataFrame, *, id_col: str, text: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id_col, tokens) of every row with an id; null and empty texts have 0 tokens. Whole texts are measured."""
    path = vocabulary or default_vocabulary()
    kind = df.schema[id_col].dataType.simpleString()
    out = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).mapInPandas(lambda it: _count(it, path, pattern), schema=f"id {kind}, tokens bigint")
    return out.select(F.col("id").alias(id_col), "tokens")


def patterns(units: int, present: np.ndarray) -> np.ndarray:
    """Columns of length-class counts that fill `units`.

    A pattern repeats one class as often as it fits or less, and adds at most two further texts.
    Classes that nothing completes have no pattern; their texts are left to the best fit.
    """
    have = np.flatnonzero(present)
    have = have[have > 0]
    cols: set[tuple[tuple[int, int], ...]] = set()
    for i in have:
        for m in range(1, units // i + 1):
            rest = units - i * m
            if rest == 0:
                cols.add(((int(i), m),))
                continue
            if present[min(rest, units)] and rest != i:
                cols.add(((int(i), m), (int(rest), 1)))
            for j in have[have <= rest // 2]:
                k = rest - j
                if present[k]:
                    c: dict[int, int] = {int(i): m}
                    c[int(j)] = c.get(int(j), 0) + 1
                    c[int(k)] = c.get(int(k), 0) + 1
                    cols.add(tuple(sorted(c.items())))
    out = np.zeros((units + 1, len(cols)))
    for k, c in enumerate(sorted(cols)):
        for i, m in c:
            out[i, k] = m
    return out


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-8, max_iter: int | None = None) -> np.ndarray:
    """argmin ||a x - b|| over x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    w = a.T @ b
    scale = max(1e-12, float(np.abs(w).max(initial=0.0)))
    for _ in range(max_iter or 3 * a.shape[0] + 30):
        free = ~passive
        if not free.any() or w[free].max() <= tol * scale:
            break
        passive[np.flatnonzero(free)[int(np.argmax(w[free]))]] = True
        while True:
            p = np.flatnonzero(passive)
            s = np.zeros(n)
            s[p] = np.linalg.lstsq(a[:, p], b, rcond=None)[0]
            if (s[p] > 0).all():
                break
            bad = p[s[p] <= 0]
            gap = x[bad] - s[bad]
            step = float(np.min(np.where(gap > 0, x[bad] / np.where(gap > 0, gap, 1.0), 0.0)))
            x = x + step * (s - x)
            passive &= x > 1e-14
            x[~passive] = 0.0
            if not passive.any():
                s = x
                break
        x = s
        w = a.T @ (b - a @ x)
    return x


def fit_patterns(histogram: np.ndarray, units: int = UNITS) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, repeats per text) for a histogram of length classes 1..units."""
    h = histogram.astype(float)
    total = h.sum()
    if total == 0:
        return np.zeros((units + 1, 0)), np.zeros(0)
    a = patterns(units, h > 0)
    # Classes weigh by their length: a long text left over costs more room than a short one.
    weight = np.sqrt(np.arange(units + 1))[:, None]
    x = nnls(a * weight, (h / total) * weight[:, 0])
    used = x > 0
    return a[:, used], x[used]


def length_class(lengths: np.ndarray, capacity: int, units: int) -> np.ndarray:
    """The nearest whole number of units; texts of class 0 are too short for patterns."""
    return np.minimum((2 * lengths * units + capacity) // (2 * capacity), units)


class _Room:
    """Containers by the room they have left; best fit is the smallest room that is large enough."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.by: dict[int, list[int]] = {}

    def put(self, box: int, room: int) -> None:
        if room <= 0:
            return
        if room not in self.by:
            bisect.insort(self.sizes, room)
            self.by[room] = []
        self.by[room].append(box)

    def take(self, need: int) -> tuple[int, int] | None:
        k = bisect.bisect_left(self.sizes, need)
        if k == len(self.sizes):
            return None
        room = self.sizes[k]
        box = self.by[room].pop()
        if not self.by[room]:
            del self.by[room]
            self.sizes.pop(k)
        return box, room


def pack_lengths(lengths: np.ndarray, capacity: int, cols: np.ndarray, rate: np.ndarray, units: int = UNITS) -> np.ndarray:
    """The container of each length (all at most capacity, at least 1); containers are numbered from 0.

    A class stands for the lengths around its middle, so a pattern is full only on average. The last text
    of a pattern, one of its shortest class, is therefore not drawn from its class but left to the best
    fit over exact lengths, which also places what the rounded-down repeat counts leave over. A container
    that its other texts already overfill is given up and its texts are placed by best fit, too.
    """
    n = len(lengths)
    box = np.full(n, -1, np.int64)
    cls = length_class(lengths, capacity, units)
    order = np.argsort(-lengths, kind="stable")  # the longest of a class go first
    lists = [order[cls[order] == c] for c in range(units + 1)]
    used = np.zeros(units + 1, np.int64)
    count = np.array([len(v) for v in lists])
    boxes, fill = 0, []
    for k in np.argsort(-rate, kind="stable"):
        need = cols[:, k].astype(np.int64)
        if need.sum() > 1:
            need[np.flatnonzero(need)[0]] -= 1
        on = need > 0
        times = int(min(np.floor(rate[k] * int(count[1:].sum()) + 1e-9), np.min((count[on] - used[on]) // need[on])))
        if times <= 0:
            continue
        level, drawn = np.zeros(times, np.int64), []
        for c in np.flatnonzero(on):
            got = lists[c][used[c] : used[c] + times * need[c]]
            owner = np.tile(np.arange(times), need[c])
            level += np.bincount(owner, weights=lengths[got], minlength=times).astype(np.int64)
            used[c] += times * need[c]
            drawn.append((got, owner))
        fits = level <= capacity
        number = boxes + np.cumsum(fits) - 1
        for got, owner in drawn:
            box[got] = np.where(fits[owner], number[owner], -1)
        fill.append(level[fits])
        boxes += int(fits.sum())
    level = np.concatenate(fill).tolist() if fill else []
    room = _Room()
    for b, f in enumerate(level):
        room.put(b, capacity - f)
    for i in order[box[order] < 0].tolist():
        need = int(lengths[i])
        hit = room.take(need)
        if hit is None:
            hit = (boxes, capacity)
            boxes += 1
        box[i] = hit[0]
        room.put(hit[0], hit[1] - need)
    return box


#: Shares of the fitted repeat counts that are tried, the largest first.
SHARES = (1.0, 0.75, 0.5, 0.25, 0.1)


def pack_patterns(lengths: np.ndarray, capacity: int, cols: np.ndarray, rate: np.ndarray, units: int = UNITS) -> np.ndarray:
    """The container of each length, by as many of the fitted patterns as cost no container.

    Every pattern that is laid out takes texts that the residual step could have used to fill up others. The largest
    share of the repeat counts that needs no more containers than best fit of all texts is kept; if even the smallest
    needs more, there is no pattern worth its room and the best fit stands.
    """
    alone = pack_lengths(lengths, capacity, cols, rate * 0.0, units)
    for share in SHARES:
        box = pack_lengths(lengths, capacity, cols, rate * share, units)
        if box.max(initial=-1) <= alone.max(initial=-1):
            return box
    return alone


def _pack_shard(pdf: pd.DataFrame, fitted: dict, units: int) -> pd.DataFrame:
    pack, capacity, shard = pdf["pack"].iloc[0], int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
    # A fixed order makes the result independent of how the rows arrived.
    pdf = pdf.sort_values(["size", "id"], ascending=[False, True], kind="stable")
    ids, size = pdf["id"].to_numpy(), pdf["size"].to_numpy(np.int64)
    full, rest = size // capacity, size % capacity
    some = rest > 0
    lengths = rest[some]
    box = pack_patterns(lengths, capacity, *fitted[capacity], units)
    o = np.argsort(box, kind="stable")
    b, l = box[o], lengths[o]
    begin = np.cumsum(l) - l
    first = np.ones(len(b), bool)
    first[1:] = b[1:] != b[:-1]
    at = np.empty(len(b), np.int64)
    at[o] = begin - np.maximum.accumulate(np.where(first, begin, 0)) if len(b) else begin
    # Full pieces each get a container of their own behind the others.
    n_box, n_full = int(box.max(initial=-1)) + 1, int(full.sum())
    piece = np.arange(n_full) - np.repeat(np.cumsum(full) - full, full)
    return pd.DataFrame({
        "pack": pack,
        "container": shard * (1 << 32) + np.concatenate([box, n_box + np.arange(n_full)]),
        "id": np.concatenate([ids[some], np.repeat(ids, full)]),
        "piece": np.concatenate([full[some], piece]),
        "first_token": np.concatenate([(size - rest)[some], piece * capacity]),
        "n_tokens": np.concatenate([lengths, np.full(n_full, capacity)]),
        "at": np.concatenate([at, np.zeros(n_full, np.int64)]),
    })


def pack(
    sizes: DataFrame,
    capacities: DataFrame,
    *,
    id_col: str,
    size: str,
    pack_id: str,
    capacity: str,
    shard_rows: int = 50_000,
    units: int = UNITS,
    capacities_at_once: int = 64,
) -> DataFrame:
    """(pack_id, container, id_col, piece, first_token, n_tokens, at): where every text lies in every packing.

    Texts are never split unless they exceed the capacity; then they give full pieces, each alone in
    its container, and a last piece that is packed like a text. Sizes that are null or below 1 take no
    room and no container. `sizes` is read twice, so cut its lineage first if it is dear. Ids may repeat: every row is packed. Capacities below 1 or null are left out; many are
    worked off `capacities_at_once` at a time, and the list of them, one row each, is read to the driver. `at` is where in its container a piece begins. The result
    depends only on the rows, not on their order. Container numbers are unique within a packing.
    """
    caps = capacities.where(F.col(capacity) >= 1).select(F.col(pack_id).alias("pack"), F.col(capacity).cast("bigint").alias("capacity")).distinct()
    rows = sorted(caps.collect(), key=lambda r: (r.capacity, repr(r.pack)))
    pk, ik = capacities.schema[pack_id].dataType.simpleString(), sizes.schema[id_col].dataType.simpleString()
    if not rows:
        return sizes.sparkSession.createDataFrame([], f"{pack_id} {pk}, container bigint, {id_col} {ik}, piece bigint, first_token bigint, n_tokens bigint, at bigint")
    if len(rows) > capacities_at_once:
        parts = []
        for i in range(0, len(rows), capacities_at_once):
            some = capacities.sparkSession.createDataFrame([(r.pack, r.capacity) for r in rows[i : i + capacities_at_once]], f"{pack_id} {pk}, {capacity} bigint")
            parts.append(pack(sizes, some, id_col=id_col, size=size, pack_id=pack_id, capacity=capacity, shard_rows=shard_rows, units=units, capacities_at_once=capacities_at_once))
        return reduce(DataFrame.unionByName, parts)
    live = sizes.where(F.col(size) >= 1).select(F.col(id_col).alias("id"), F.col(size).cast("bigint").alias("size"))
    offer = F.array(*[F.struct(F.lit(r.pack).cast(pk).alias("pack"), F.lit(int(r.capacity)).cast("bigint").alias("capacity")) for r in rows])
    each = live.select("id", "size", F.explode(offer).alias("o")).select("id", "size", "o.*")
    each = each.withColumn("rest", F.pmod("size", "capacity"))

    # One histogram per capacity: at most `units` rows each.
    twice = F.col("capacity") * 2
    nearest = F.floor((F.col("rest") * (2 * units) + F.col("capacity")) / twice)
    cls = F.least(nearest, F.lit(units)).cast("int")
    hist = each.groupBy("capacity", cls.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    table: dict[int, np.ndarray] = {int(r.capacity): np.zeros(units + 1) for r in rows}
    for r in hist:
        table[r.capacity][r.c] += r.n
    most = max(h.sum() for h in table.values())
    for h in table.values():
        h[0] = 0
    fitted = {c: fit_patterns(h, units) for c, h in table.items()}
    shards = max(1, int(np.ceil(most / shard_rows)))
    shard = F.pmod(F.xxhash64("id", "size"), F.lit(shards)).cast("bigint")
    packed = each.select("pack", "capacity", shard.alias("shard"), "id", "size").groupBy("pack", "capacity", "shard").applyInPandas(
        lambda pdf: _pack_shard(pdf, fitted, units), schema=f"pack {pk}, container bigint, id {ik}, piece bigint, first_token bigint, n_tokens bigint, at bigint"
    )
    return packed.select(F.col("pack").alias(pack_id), "container", F.col("id").alias(id_col), "piece", "first_token", "n_tokens", "at")

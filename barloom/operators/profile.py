"""Column-level data quality from maintained value counts.

A load contributes a delta: how often each value occurs in each column. Deltas carry a sign and are kept in a
store, load by load, so a load can be added to or taken out of the maintained counts without reading anything
else again, and every profile metric (null share, distinct count, range, value forms, entropy) is exact because
it is derived from the counts. Changes between loads are judged from the same kept deltas: the profile of a load is
held against those of the loads around it, so slow growth over many loads is no change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import stamp_of
from barloom.session import cut

NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}
KEYS = ("column_name", "num", "txt")


def _kind(dtype: str) -> str:
    return "num" if dtype in NUMERIC or dtype.startswith("decimal") else "txt"


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_name, num, txt, n): a delta. Numbers stand in num, everything else as text in txt.

    Null values count under num and txt both null; NaN counts as null. Integers beyond 2^53 keep their
    exact digits in txt beside the rounded num. The rows are counted before they are shuffled.
    """
    columns = [c for c in (columns or df.columns) if c not in by]
    types = dict(df.dtypes)

    def entry(c: str) -> Column:
        col = F.col(f"`{c}`")
        if _kind(types[c]) == "num":
            num = F.nanvl(col.cast("double"), F.lit(None).cast("double")) if types[c] in ("float", "double") else col.cast("double")
            exact = F.when(F.abs(num) > 9007199254740992.0, col.cast("string")) if types[c] not in ("float", "double") else F.lit(None).cast("string")
            # Negative zero and zero are one value.
            return F.struct(F.lit(c).alias("column_name"), (num + F.lit(0.0)).alias("num"), exact.alias("txt"))
        return F.struct(F.lit(c).alias("column_name"), F.lit(None).cast("double").alias("num"), col.cast("string").alias("txt"))

    if not columns:
        raise ValueError("no columns to count")
    long = df.select(*[F.col(f"`{b}`") for b in by], F.explode(F.array(*[entry(c) for c in columns])).alias("__e")).select(*by, "__e.*")
    return long.groupBy(*by, *KEYS).agg(F.count(F.lit(1)).alias("n"))


def apply_delta(counts: DataFrame | None, delta: DataFrame, sign: int = 1) -> DataFrame:
    """Counts after adding (sign 1) or withdrawing (sign -1) a delta; values whose count falls to 0 vanish."""
    if sign not in (1, -1):
        raise ValueError("sign must be 1 or -1")
    d = delta.withColumn("n", F.col("n") * F.lit(sign).cast("bigint"))
    both = d if counts is None else counts.unionByName(d)
    keys = [c for c in both.columns if c != "n"]
    return both.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") != 0)


class CountStore:
    """Value counts kept in a folder as signed deltas, load by load.

    Every change is one more set of files and an entry in a log, whose number only one writer can create: a reader
    sees the counts before or after a change, a failed write leaves nothing but files that no entry names, and of
    two writers the second looks at the log again. Loads are remembered by name: adding one twice, or withdrawing
    one that is not there, is refused. A withdrawal reads the load's own delta from the store and writes it with the
    other sign. `compact` merges the files and drops what cancels out.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/log"))

    def _entries(self) -> list[dict]:
        """Changes since the last compaction, which is the first of them."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/log")))
        out: list[dict] = []
        for name in (n for n in names if n.endswith(".json")):
            stream = self._fs.open(self._path(f"{self.folder}/log/{name}"))
            try:
                e = json.loads(bytes(stream.readAllBytes()).decode()) | {"number": int(name[:-5])}
            finally:
                stream.close()
            out = [e] if e["kind"] == "compact" else [*out, e]
        return out

    def _names(self, entries: list[dict]) -> list:
        have: dict = {}
        for e in entries:
            for n in e["loads"]:
                if e["kind"] == "withdraw":
                    have.pop(n, None)
                else:
                    have[n] = None
        return list(have)

    def loads(self) -> set:
        return set(self._names(self._entries()))

    def _commit(self, number: int, kind: str, loads: list, files: str) -> bool:
        try:
            out = self._fs.create(self._path(f"{self.folder}/log/{number:09d}.json"), False)
        except Exception as e:  # noqa: BLE001
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps({"kind": kind, "loads": loads, "files": files}).encode()))
        out.close()
        return True

    def _append(self, kind: str, loads: list, delta: DataFrame) -> None:
        files = f"d-{uuid.uuid4().hex}"
        delta.select("load", *KEYS, "n").write.parquet(f"{self.folder}/{files}")
        while True:
            entries = self._entries()
            had = set(self._names(entries))
            wrong = [n for n in loads if (n in had) != (kind == "withdraw")]
            if wrong:
                raise ValueError(f"loads {wrong!r} are {'not' if kind == 'withdraw' else 'already'} in the counts")
            if self._commit((entries[-1]["number"] if entries else 0) + 1, kind, loads, files):
                return

    def _check(self, kind: str, loads: list) -> None:
        """Refuses before anything is written; _append looks again."""
        had = self.loads()
        wrong = [n for n in loads if (n in had) != (kind == "withdraw")]
        if wrong:
            raise ValueError(f"loads {wrong!r} are {'not' if kind == 'withdraw' else 'already'} in the counts")

    def add(self, load, delta: DataFrame) -> None:
        """One load's delta."""
        self._check("add", [load])
        have = self.deltas()
        kind = have.schema["load"].dataType if have is not None else "bigint" if isinstance(load, int) else "string"
        self._append("add", [load], delta.withColumn("load", F.lit(load).cast(kind)))

    def add_loads(self, deltas: DataFrame, load: str) -> list:
        """The deltas of many loads in one write; their names, which are read to the driver, one a load. Null is no load."""
        d = deltas.where(F.col(load).isNotNull()).withColumnRenamed(load, "load")
        files = f"d-{uuid.uuid4().hex}"
        d.select("load", *KEYS, "n").write.parquet(f"{self.folder}/{files}")
        names = sorted(r.load for r in self.spark.read.parquet(f"{self.folder}/{files}").select("load").distinct().collect())
        while names:
            entries = self._entries()
            twice = sorted(set(names) & set(self._names(entries)))
            if twice:
                raise ValueError(f"loads {twice!r} are already in the counts")
            if self._commit((entries[-1]["number"] if entries else 0) + 1, "add", names, files):
                break
        return names

    def withdraw(self, load) -> DataFrame:
        """Takes a load out; returns its delta, read from the store."""
        self._check("withdraw", [load])
        own = self.by_load().where(F.col("load") == F.lit(load))
        self._append("withdraw", [load], own.withColumn("n", -F.col("n")))
        return own.drop("load")

    def deltas(self) -> DataFrame | None:
        """(load, column_name, num, txt, n): the kept deltas, a withdrawn load's with both signs; None of an empty store."""
        paths = [f"{self.folder}/{e['files']}" for e in self._entries()]
        return self.spark.read.parquet(*paths) if paths else None

    def by_load(self) -> DataFrame | None:
        """The deltas of the loads that are in; withdrawn ones cancel out."""
        entries = self._entries()
        d = self.deltas()
        gone = sorted({n for e in entries if e["kind"] == "withdraw" for n in e["loads"]})
        if d is None or not gone:
            return d
        # Only what was ever withdrawn has more than one sign.
        net = d.where(F.col("load").isin(gone)).groupBy("load", *KEYS).agg(F.sum("n").alias("n")).where(F.col("n") != 0)
        return d.where(~F.col("load").isin(gone)).unionByName(net)

    def counts(self) -> DataFrame | None:
        """(column_name, num, txt, n) over all loads that are in."""
        d = self.deltas()
        return None if d is None else d.groupBy(*KEYS).agg(F.sum("n").alias("n")).where(F.col("n") != 0)

    def compact(self) -> None:
        """Merges all files into one set. The files from before stay until `sweep`, for readers that still hold them."""
        while True:
            entries = self._entries()
            if len(entries) < 2:
                return
            files = f"d-{uuid.uuid4().hex}"
            merged = self.deltas().groupBy("load", *KEYS).agg(F.sum("n").alias("n")).where(F.col("n") != 0)
            merged.write.parquet(f"{self.folder}/{files}")
            if self._commit(entries[-1]["number"] + 1, "compact", self._names(entries), files):
                return

    def sweep(self) -> None:
        """Deletes files that no entry since the last compaction names; no writer may be at work."""
        used = {e["files"] for e in self._entries()}
        for s in self._fs.listStatus(self._path(self.folder)):
            name = s.getPath().getName()
            if name.startswith("d-") and name not in used:
                self._fs.delete(s.getPath(), True)


def value_form(txt: Column) -> Column:
    """The pattern of a text: runs of digits become 9, of capitals A, of small letters a; the rest stays."""
    lower = F.regexp_replace(txt, r"\p{Ll}+", "a")
    return F.regexp_replace(F.regexp_replace(lower, r"\p{Lu}+", "A"), r"[0-9]+", "9")


def profile(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact metrics per column from maintained counts.

    (by..., column_name, rows, null_share, distinct_values, min_num, max_num, min_txt, max_txt, entropy_bits,
    top_form, top_form_share). Entropy and distinct values leave nulls out; a column of nulls only has
    entropy 0, no range and no form. Ties among forms go to the first in binary order.
    """
    keys = [*by, "column_name"]
    null = F.col("num").isNull() & F.col("txt").isNull()
    nd = F.when(~null, F.col("n")).cast("double")
    # Counts go by form first; what a column's forms have in common is added up from them, so values are read once.
    form = F.when(F.col("num").isNull(), value_form(F.col("txt")))
    forms = counts.groupBy(*keys, form.alias("form")).agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(null, F.col("n"))).alias("nulls"),
        F.count(F.when(~null, F.lit(1))).alias("values"),
        F.min("num").alias("min_num"),
        F.max("num").alias("max_num"),
        F.min(F.when(F.col("num").isNull(), F.col("txt"))).alias("min_txt"),
        F.max(F.when(F.col("num").isNull(), F.col("txt"))).alias("max_txt"),
        F.sum(nd).alias("__n"),
        F.sum(nd * F.log2(nd)).alias("__nlog"),
    )
    first = F.when(F.col("form").isNotNull(), F.struct(-F.col("rows"), F.col("form")))
    base = forms.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"),
        F.sum("values").alias("distinct_values"),
        F.min("min_num").alias("min_num"),
        F.max("max_num").alias("max_num"),
        F.min("min_txt").alias("min_txt"),
        F.max("max_txt").alias("max_txt"),
        F.coalesce(F.sum("__n"), F.lit(0.0)).alias("__n"),
        F.coalesce(F.sum("__nlog"), F.lit(0.0)).alias("__nlog"),
        F.min(first).alias("__top"),
    )
    return base.select(
        *keys,
        "rows",
        F.try_divide(F.col("nulls").cast("double"), F.col("rows").cast("double")).alias("null_share"),
        "distinct_values",
        "min_num",
        "max_num",
        "min_txt",
        "max_txt",
        F.when(F.col("__n") > 0, F.log2("__n") - F.col("__nlog") / F.col("__n")).otherwise(F.lit(0.0)).alias("entropy_bits"),
        F.col("__top.form").alias("top_form"),
        F.try_divide((-F.col("__top.col1")).cast("double"), F.col("__n")).alias("top_form_share"),
    )


#: Buckets of value forms. In each the most frequent form keeps a bin of its own, so a new form hides in no old one.
FORM_BUCKETS = 4096
#: Loads of a column that are judged in one task.
LOADS_PER_TASK = 64


def stamp_days(t: Column) -> Column:
    """Days since 1970 of a text that spells a stamp, without closing Z and blanks, else null; 13 digits are milliseconds, 10 seconds."""
    part = lambda i, n: F.substring(t, i, n)
    dotted = F.when((F.length(t) == 16) & (part(3, 1) == ".") & (part(6, 1) == "."), stamp_of(F.concat(part(7, 4), F.lit("-"), part(4, 2), F.lit("-"), part(1, 2), part(11, 6))))
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.coalesce(stamp_of(t, date_only=True), dotted)).cast("double")
    number = F.when(F.length(t).isin(10, 13), t.try_cast("bigint")).cast("double")
    digits = F.when(number > 0, F.when(F.length(t) == 13, number / 1000.0).otherwise(number))
    return F.when(F.substring(t, 1, 1).between("0", "9"), F.coalesce(digits, seconds)) / 86400.0


def load_features(counts: DataFrame, load: str) -> DataFrame:
    """(load, column_name, feature, bin, n) from deltas per load.

    Features: `null` (bins null, value), `form` (hashed value forms of texts), `size` (numbers in
    half-octave bins of the signed logarithm; booleans by value) and `stamp` (days).
    A load and column has at most two bins per bucket of forms.
    """
    null = F.col("num").isNull() & F.col("txt").isNull()
    keys = [load, "column_name", "feature", "bucket"]
    mag = F.floor(F.log2(F.lit(1.0) + F.abs("num")) * 2.0)
    size = F.when(F.col("num") == 0, F.lit(0.0)).otherwise(F.signum("num") * (mag + 1.0)).cast("bigint")
    text = F.col("num").isNull() & F.col("txt").isNotNull()
    truth = F.when(text & F.col("txt").isin("true", "false"), (F.col("txt") == "true").cast("bigint"))
    ready = counts.withColumn("__t", F.rtrim(F.col("txt"), F.lit(" Z")))
    # Values are first counted by all their bins together: few rows are left to be unfolded by feature.
    flat = ready.select(
        load, "column_name", "n", null.cast("bigint").alias("__null"), F.when(F.col("num").isNotNull(), size).otherwise(truth).alias("__size"),
        F.when(text, F.xxhash64(value_form(F.col("txt")))).alias("__form"), F.when(text, F.round(stamp_days(F.col("__t")))).cast("bigint").alias("__stamp"),
    ).groupBy(load, "column_name", "__null", "__size", "__form", "__stamp").agg(F.sum("n").alias("n"))
    # Only forms can share a bucket.
    part = lambda feature, bucket=None: F.struct(F.lit(feature).alias("feature"), (F.col(f"__{feature}") if bucket is None else bucket).alias("bucket"), F.col(f"__{feature}").alias("bin"))
    parts = F.array(part("null"), part("size"), part("form", F.pmod("__form", F.lit(FORM_BUCKETS).cast("bigint"))), part("stamp"))
    binned = flat.select(load, "column_name", "n", F.explode(parts).alias("p")).select(load, "column_name", "p.*", "n")
    bins = binned.where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    tops = bins.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("n").alias("m"), F.max_by("bin", F.struct("n", "bin")).alias("top"))
    rest = F.when(F.col("n") > F.col("m"), F.struct(F.col("bucket").alias("bin"), (F.col("n") - F.col("m")).alias("n")))
    two = F.array_compact(F.array(F.struct(F.col("top").alias("bin"), F.col("m").alias("n")), rest))
    return tops.select(load, "column_name", "feature", F.explode(two).alias("p")).select(load, "column_name", "feature", "p.bin", "p.n")


#: Features that are one number a load, between 0 and 1, kept in millionths.
SCALARS = ("top", "distinct", "entropy")


def load_spread(counts: DataFrame, load: str) -> DataFrame:
    """(load, column_name, feature, bin, n): how the values of each column spread over its rows, from deltas per load.

    `top` is the share of the most frequent value, `distinct` and `entropy` the logarithm of the distinct count and the
    entropy as shares of what as many different values would have. Nulls are left out; n are the rows with a value.
    """
    # Not a filter, which would be pushed under the counting and keep its shuffle from being shared with load_features.
    n = F.when(F.col("num").isNotNull() | F.col("txt").isNotNull(), F.col("n"))
    nd = n.cast("double")
    a = counts.groupBy(load, "column_name").agg(F.sum(n).alias("n"), F.max(nd).alias("__m"), F.count(n).alias("__d"), F.sum(nd * F.log2(nd)).alias("__l"))
    most = F.log2(F.col("n").cast("double"))
    value = {"top": F.col("__m") / F.col("n"), "distinct": F.log2(F.col("__d").cast("double")) / most, "entropy": (most - F.col("__l") / F.col("n")) / most}
    parts = [F.struct(F.lit(f).alias("feature"), F.round(value[f] * 1e6).cast("bigint").alias("bin")) for f in SCALARS]
    return a.where(F.col("n") > 1).select(load, "column_name", F.explode(F.array(*parts)).alias("p"), "n").select(load, "column_name", "p.feature", "p.bin", "n")


def _departures(pdf: pd.DataFrame, chunk: int, load: str, around: int, floor: float) -> pd.DataFrame:
    """One column of a range of loads: distances of each load from the loads around it, by feature."""
    col = pdf["column_name"].iloc[0]
    middle = pdf[pdf["__i"] < 0]  # the median profile of all loads
    pdf = pdf[pdf["__i"] >= 0]
    base, last = int(pdf["__i"].min()), int(pdf["__i"].max())
    loads = np.full(last - base + 1, None, dtype=object)
    loads[pdf["__i"].to_numpy() - base] = pdf[load].to_numpy()
    pdf = pdf.assign(__i=pdf["__i"] - base)
    own = [i for i in range(len(loads)) if (i + base) // LOADS_PER_TASK == chunk]
    out: dict[tuple[int, str], float] = {}
    reach = range(-2 * around, 2 * around + 1)
    near = {i: np.array([i + d for d in sorted(reach, key=lambda d: (abs(d), d)) if d and 0 <= i + d < len(loads)][: 2 * around], dtype=int) for i in own}
    for feature, part in pdf.groupby("feature"):
        if feature in SCALARS:
            x, rows = np.full(len(loads), np.nan), np.full(len(loads), np.nan)
            x[part["__i"]], rows[part["__i"]] = part["bin"] / 1e6, part["n"]
            for i in own:
                nb = near[i][np.isfinite(x[near[i]])]
                if np.isfinite(x[i]) and len(nb) >= 2:
                    mid = np.median(x[nb])
                    # Less than what the neighbours differ among themselves, or few rows let expect, is no departure.
                    usual = 6 * np.median(np.abs(x[nb] - mid)) + 1.5 / np.sqrt(min(rows[i], np.median(rows[nb])))
                    out[(i, str(feature))] = float(abs(x[i] - mid) - usual)
            continue
        if feature == "stamp":
            # Stamps move on from load to load: judge the spread around the load's middle, and the middle by its steps.
            mids = np.full(len(loads), np.nan)
            spread = np.full(len(loads), np.nan)
            bins = []
            for i, g in part.groupby("__i"):
                x, n = g["bin"].to_numpy(float), g["n"].to_numpy(float)
                o = np.argsort(x)
                c = np.cumsum(n[o]) / n.sum()
                q = [x[o][min(np.searchsorted(c, p), len(o) - 1)] for p in (0.25, 0.5, 0.75)]
                mids[i], spread[i] = q[1], q[2] - q[0]
                d = x - q[1]
                bins.append(pd.DataFrame({"__i": i, "bin": np.sign(d) * np.ceil(np.log2(1 + np.abs(d))), "n": n}))
            for i in own:
                nb = near[i][np.isfinite(mids[near[i]])]
                if np.isfinite(mids[i]) and len(nb) >= 2:
                    steps = np.abs(np.diff(mids[np.sort(nb)]))
                    allowed = max(10.0, np.median(spread[nb]), 6 * np.median(steps) * around) if len(steps) else np.inf
                    out[(i, "place")] = abs(mids[i] - np.median(mids[nb])) / allowed - 1 + floor if abs(mids[i] - np.median(mids[nb])) > allowed else 0.0
            part = pd.concat(bins)
        usual_bins = middle[middle["feature"] == feature]
        wide = part.pivot_table(index="__i", columns="bin", values="n", aggfunc="sum", fill_value=0).reindex(range(len(loads)), fill_value=0)
        wide = wide.reindex(columns=sorted({*wide.columns, *usual_bins["bin"]}), fill_value=0)
        usual_share = usual_bins.set_index("bin")["share"].reindex(wide.columns, fill_value=0.0).to_numpy(float)
        wide = wide.to_numpy(float)
        tot = wide.sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.where(tot[:, None] > 0, wide / tot[:, None], 0.0)
        for i in own:
            nb = near[i][tot[near[i]] > 0]
            if tot[i] == 0 or len(nb) < 2:
                continue
            dist = 0.5 * np.abs(share[nb] - share[i]).sum(axis=1)
            used = (share[nb].mean(axis=0) + share[i] > 0).sum()
            noise = 1.1 * np.sqrt(used / np.pi) * np.sqrt(0.5 / tot[i] + 0.5 / np.median(tot[nb]))
            far = float(np.median(dist))
            if usual_share.sum() > 0.5:
                # What does not drift has all loads for neighbours: a long run of bad loads cannot hide, nor spoil the loads beside it.
                far = 0.5 * float(np.abs(usual_share / usual_share.sum() - share[i]).sum())
            out[(i, str(feature))] = far - noise
    r = [(loads[i], col, f, v) for (i, f), v in out.items() if v > floor]
    return pd.DataFrame(r, columns=[load, "column_name", "feature", "distance"])


def changed_columns(deltas: DataFrame, *, load: str = "load", around: int = 5, floor: float = 0.12) -> DataFrame:
    """(load, column_name, features, distance): columns that depart plainly from the loads around it, from kept deltas per load.

    A load's null share, value forms, sizes and stamps are compared with each of the 2 * around nearest loads,
    and the share of its most frequent value, its distinct count and its entropy with their median there;
    the median of those distances (half the summed difference of shares), less what the number of
    rows lets expect by chance, must exceed `floor`. A median is unmoved by single bad loads among
    the neighbours. Null shares and forms, which do not drift, are held against the median profile of all
    loads instead, if there is one, so that a long run of bad loads comes out. Values without a load do not count. With fewer than three
    loads nothing is judged.
    """
    d = deltas.where(F.col(load).isNotNull())
    kind = d.schema[load].dataType.simpleString()
    # One row per load, column and bin is left: its number does not grow with the rows.
    feats = cut(load_features(d, load).unionByName(load_spread(d, load)))
    # The loads themselves, one small row each, are numbered in one task.
    order = feats.select(load).distinct().select(load, (F.row_number().over(Window.orderBy(load)) - 1).cast("bigint").alias("__i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("__all"))
    placed = feats.join(order, load)
    steady = placed.where(F.col("feature").isin("null", "form"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(load, "column_name", "feature"))
    sides = steady.withColumn("__s", share).groupBy("column_name", "feature", "bin").agg(F.sort_array(F.collect_list("__s")).alias("__s"), F.max("__all").alias("__all"))
    # The median over all loads of a bin's share; loads without the bin have none.
    at = F.floor(F.col("__all") / 2) - (F.col("__all") - F.size("__s"))
    middle = sides.where(at >= 0).select("column_name", "feature", "bin", F.element_at("__s", (at + 1).cast("int")).alias("share"))
    chunk = lambda c: F.floor(c / F.lit(LOADS_PER_TASK)).cast("bigint")
    spread = placed.withColumn("__chunk", F.explode(F.sequence(F.greatest(chunk(F.col("__i") - 2 * around), F.lit(0).cast("bigint")), F.least(chunk(F.col("__i") + 2 * around), chunk(F.col("__all") - 1)))))
    cols = [load, "column_name", "feature", "bin", "n", "__i", "__chunk"]
    rows = spread.select(*cols, F.lit(None).cast("double").alias("share"))
    chunks = order.select(chunk(F.col("__i")).alias("__chunk")).distinct()
    # One row a chunk against the few rows of the median profile.
    usual_rows = middle.join(chunks, F.lit(True)).select(F.lit(None).cast(kind).alias(load), "column_name", "feature", "bin", F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("__i"), "__chunk", "share")
    found = rows.unionByName(usual_rows).groupBy("column_name", "__chunk").applyInPandas(
        lambda key, pdf: _departures(pdf, int(key[1]), load, around, floor), schema=f"{load} {kind}, column_name string, feature string, distance double"
    )
    return found.groupBy(load, "column_name").agg(F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("features"), F.max("distance").alias("distance"))

"""Text cut off by field limits or broken transfers.

Cut texts are made from intact ones: a copy of a text is cut at a random place inside a word or a
sentence, and a logistic regression over hashed features of the ending learns to tell the copy from
the original. What it sees: the last characters and words, the punctuation and shape of the last
line, how the last sentence stands, and how far the length is from the limit of the text's source.
Limits are measured over all rows: a limit is a largest length that many rows of a source share,
in characters or in bytes. Every record is scored, in Arrow batches; nothing is shuffled but the
counts per source.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import BLANKS
from barloom.session import cut

BITS = 16
TAIL = 240  # characters of the last line that features look at; the last sentence is looked at whole, the limits at the whole length
SENT_SOURCES = 100_000
LEAST = 50  # texts under which nothing is learned
_TERMINAL = ".!?。！？"
_CLOSERS = ")]}\"'”’»』」|*_`"
_SENT = re.compile(r"[.!?。！？](?=\s|$)|\n")
_ID = re.compile(r"^[^\s:]{2,20}: [0-9a-f]+$")
_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”"}


def _shape(s: str) -> str:
    s = re.sub(r"[a-z]+", "a", s)
    s = re.sub(r"[A-Z]+", "A", s)
    s = re.sub(r"[0-9]+", "9", s)
    s = re.sub(r"[가-힣]+", "k", s)
    return re.sub(r"\s+", " ", s)


def last_sentence(text: str) -> str:
    """What follows the last end of a sentence before the text's own; looked for from behind, however far it lies."""
    size = TAIL
    while True:
        part = text[-size:].rstrip().rstrip(_TERMINAL)
        pieces = _SENT.split(part)
        if len(pieces) > 1 or size >= len(text):
            return pieces[-1]
        size *= 4


def ending_features(text: str, at_limit: str) -> list[str]:
    """Names of the features of a text's ending."""
    text = text.rstrip(" \t\r\n") + text[len(text.rstrip(" \t\r\n")) :][:1]  # one blank says as much as many
    tail = text[-TAIL:]
    body = tail.rstrip()
    blank = len(body) < len(tail)
    out = [f"limit={at_limit}", f"blank={blank}"]
    dots = body.endswith(("…", "..."))
    if dots:
        out.append("dots")
        out.append(f"dots&limit={at_limit}")
        body = body.rstrip("….").rstrip() if not body.endswith("…") else body[:-1].rstrip()
    last = body[-1:]
    kind = (
        "none" if not last else "stop" if last in _TERMINAL else "close" if last in _CLOSERS else "comma" if last in ",;:，、" else "digit" if last.isdigit()
        else "upper" if last.isupper() else "lower" if last.islower() else "letter" if last.isalpha() else "mark"
    )
    line = body.rsplit("\n", 1)[-1].strip()
    parts = line.split()
    head, shape = (parts[0] if parts else ""), _shape(line)
    word = parts[-1] if parts else ""
    low = word.casefold()
    sent = last_sentence(text[:-1] if dots else text) if body else ""
    n_words = len(sent.split())
    tail_mark = "stop" if kind == "stop" else "close" if kind == "close" else "open"
    out += [
        f"kind={kind}",
        f"kind&limit={kind}&{at_limit}",
        f"c1={body[-1:]}",
        f"c2={body[-2:]}",
        f"c3={body[-3:]}",
        f"w1={low}",
        f"w2={' '.join(parts[-2:]).casefold()}",
        f"w3={' '.join(parts[-3:]).casefold()}",
        f"head={head[:12]}",
        f"head&mark={head[:12]}&{tail_mark}",
        f"shape={shape[:10]}&{shape[-4:]}",
        f"lineshape={shape[:24]}",
        f"line={line[:60].casefold()}",
        f"id={bool(_ID.match(line))}&{tail_mark}",
        f"words={min(n_words, 12)}&{tail_mark}",
        f"wordlen={min(len(word), 9)}&{kind}",
        f"wshape={_shape(word)}",
        f"kv={bool(re.match(r'^[^ :]{2,20}: ', line))}&{tail_mark}",
        f"item={line[:2] in ('- ', '* ', '— ', '– ', '• ')}&{tail_mark}",
        f"row={line[:1] == '|'}{line[-1:] == '|'}",
        f"json={line[:1] == '{'}{line[-1:] == '}'}",
        f"unclosed={[a for a, b in _OPEN.items() if sent.count(a) > sent.count(b)][:1]}&{tail_mark}",
    ]
    return out


def _ids(names: list[str]) -> list[int]:
    return sorted({zlib.crc32(n.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for n in names})


def source_limits(df: DataFrame, *, source: str, text: str, at_least: int = 5, share: float = 0.01) -> DataFrame:
    """(source, chars, bytes): the limit of each source, null where it has none.

    The largest length of a source is its limit if at least `at_least` rows and `share` of the rows
    have it exactly; in bytes, lengths up to three below count too, as no character is split. Where the
    character limit explains the longest rows there is no byte limit unless more rows stand at it.
    """
    return _limits(lengths(df, source=source, text=text), source, at_least, share)


def lengths(df: DataFrame, *, source: str, text: str) -> DataFrame:
    """(__s, __c, __b, n): how many texts of a source have so many characters and bytes."""
    t = df.where(F.col(text).isNotNull()).select(F.col(source).alias("__s"), F.length(text).alias("__c"), F.octet_length(text).alias("__b"))
    return t.groupBy("__s", "__c", "__b").agg(F.count(F.lit(1)).alias("n"))


def _limits(sizes: DataFrame, source: str, at_least: int = 5, share: float = 0.01) -> DataFrame:
    # Counts per length: what is left per source is bounded by the number of different lengths.
    c = sizes.groupBy("__s", "__c").agg(F.sum("n").alias("n")).groupBy("__s").agg(F.max(F.struct("__c", "n")).alias("c"), F.sum("n").alias("rows"))
    b = sizes.groupBy("__s", "__b").agg(F.sum("n").alias("n"))
    top = b.groupBy(F.col("__s").alias("__s1")).agg(F.max("__b").alias("top"))
    near = b.join(top, F.col("__s").eqNullSafe(F.col("__s1"))).where(F.col("__b") >= F.col("top") - 3)
    b = near.groupBy(F.col("__s1").alias("__s2")).agg(F.max("top").alias("top"), F.sum("n").alias("nb"))
    need = F.greatest(F.lit(at_least), F.col("rows") * share)
    return (
        c.join(b, F.col("__s").eqNullSafe(F.col("__s2")))
        .select(
            F.col("__s").alias(source),
            F.when(F.col("c.n") >= need, F.col("c.__c")).cast("bigint").alias("chars"),
            F.when((F.col("nb") >= need) & ((F.col("c.n") < need) | (F.col("nb") > F.col("c.n"))), F.col("top")).cast("bigint").alias("bytes"),
        )
    )


def _near(chars: int, size: int, limit: tuple[int | None, int | None]) -> str:
    if limit[0] is None and limit[1] is None:
        return "none"
    if (limit[0] is not None and chars >= limit[0]) or (limit[1] is not None and size >= limit[1] - 3):
        return "at"
    if (limit[0] is not None and chars >= limit[0] - 3) or (limit[1] is not None and size >= limit[1] - 8):
        return "close"
    return "far"


def cut_points(text: str, rng: np.random.Generator) -> int | None:
    """A place inside a word or a sentence, or None. Generated identifiers at the end are left alone:
    a shorter one is as good a value, so nothing could tell it from the whole."""
    end = len(text.rstrip())
    keyed = re.search(r"\n[^\n ]{2,20}: [0-9a-f]{6,}\s*$", text)
    if keyed:
        end = keyed.start()
    if end < 24:
        return None
    for _ in range(8):
        p = int(rng.integers(12, end))
        before = text[:p].rstrip()
        if not before or before[-1] in _TERMINAL or before[-1] in _CLOSERS or before[-1] == "…" or text[p - 1] == "\n" or text[p] == "\n":
            continue
        if before[-1] in "#-—|:" or before.rsplit("\n", 1)[-1][:1] in "#[":
            continue  # headings and bare markers end nowhere in particular
        return p
    return None


class Model:
    """Hashed logistic regression."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def score(self, ids: list[int]) -> float:
        z = self.bias + float(self.weights[ids].sum())
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(samples: list[tuple[list[int], int]], epochs: int = 5, rate: float = 0.25, l2: float = 1e-5, seed: int = 7, least: int = 4) -> Model:
    """Adaptive-gradient logistic regression; deterministic for a given sample.

    Features of fewer than `least` samples keep weight 0: they could only memorise single texts.
    """
    w, g = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    bias, gb = 0.0, 1e-3
    rng = np.random.default_rng(seed)
    feats = [np.array(f, dtype=np.int64) for f, _ in samples]
    common = np.bincount(np.concatenate(feats), minlength=1 << BITS) >= least if feats else np.zeros(1 << BITS, bool)
    feats = [f[common[f]] for f in feats]
    y = np.array([t for _, t in samples], dtype=float)
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            f = feats[k]
            p = 1.0 / (1.0 + np.exp(-np.clip(bias + w[f].sum(), -30, 30)))
            d = p - y[k]
            if abs(d) < 1e-3:
                continue
            step = d + l2 * w[f]
            g[f] += step * step
            w[f] -= rate * step / np.sqrt(g[f])
            gb += d * d
            bias -= rate * d / np.sqrt(gb)
    return Model(w, bias)


def train(rows: list[tuple[str, tuple[int | None, int | None]]], seed: int = 11, cuts: int = 2, rounds: int = 2) -> Model:
    """rows: (text, limits of its source). Originals are taken for intact and their cut copies for cut.

    Some originals are cut themselves, so originals that fill their field and end openly are not taken for
    intact at first. A model of one half of the texts then judges the other half, and the originals that
    look cut to it are left out; after `rounds` of this the final model is fitted on what is left and
    all the copies.
    """
    rng = np.random.default_rng(seed)
    originals, copies, keep = [], [], []  # (half, features); places of intact originals
    for i, (text, lim) in enumerate(rows):
        near = _near(len(text), len(text.encode("utf-8", "surrogatepass")), lim)
        originals.append((i % 2, _ids(ending_features(text, near))))
        if near != "at" or text.rstrip()[-1:] in _TERMINAL + _CLOSERS:
            keep.append(i)
        for _ in range(cuts):
            p = cut_points(text, rng)
            if p is None:
                continue
            short = text[:p]
            # A cut copy stands for a value that met its limit as often as for a broken transfer.
            near = "none" if lim == (None, None) else ("at" if rng.random() < 0.5 else "far")
            if rng.random() < 0.15:
                short = short.rstrip() + "…"
            copies.append((i % 2, _ids(ending_features(short, near))))
    for k in range(rounds):
        halves = [fit([(originals[i][1], 0) for i in keep if originals[i][0] == h] + [(c, 1) for half, c in copies if half == h], epochs=3, seed=seed + k) for h in (0, 1)]
        keep = [i for i, (h, f) in enumerate(originals) if halves[1 - h].score(f) < 0.5]
    return fit([(originals[i][1], 0) for i in keep] + [(c, 1) for _, c in copies], seed=seed + rounds)


def plain_score(text: str, near: str) -> float:
    """Where there is too little to learn from: a text that ends openly, more surely so at its limit."""
    body = text.rstrip()
    open_ = body[-1:] not in _TERMINAL + _CLOSERS and not re.match(r"^([-*•—–#|]|[^ :]{2,20}: )", body.rsplit("\n", 1)[-1])
    return (0.9 if near == "at" else 0.6) if open_ and len(last_sentence(text).split()) > 3 else 0.1


def _score(batches: Iterator[pd.DataFrame], model: Model | None) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        s = []
        for t, c, b, lc, lb in zip(pdf["__text"], pdf["__c"], pdf["__b"], pdf["__lc"], pdf["__lb"]):
            near = _near(int(c), int(b), (None if pd.isna(lc) else int(lc), None if pd.isna(lb) else int(lb)))
            s.append(plain_score(t, near) if model is None else model.score(_ids(ending_features(t, near))))
        yield pd.DataFrame({"id": pdf["__id"], "source": pdf["__src"], "score": np.array(s, dtype=float)})


def truncation_scores(df: DataFrame, *, id_col: str, source: str, text: str, sample_rows: int = 12000) -> DataFrame:
    """(id_col, source, score): how much each text's ending looks cut, between 0 and 1.

    The model is fitted on at most `sample_rows` texts, those with the smallest hashes of their ids whatever the
    size of the table or the order of its rows; limits and scores cover all rows. Null and blank texts have no ending
    and give no row. Repeated ids give a row per occurrence. With fewer than LEAST texts to learn from, a plain rule
    on the ending stands in. Three reads of the table: lengths, sample, scores.
    """
    live = df.where(F.length(F.trim(F.col(text), F.lit(BLANKS))) > 0)
    sizes = cut(lengths(live, source=source, text=text))
    # One small row a source; joined, so that any number of sources can have limits, and sent to all only while they are few.
    limits = cut(_limits(sizes, "__s")).select(F.col("__s").alias("__ls"), F.col("chars").alias("__lc"), F.col("bytes").alias("__lb"))
    if limits.count() <= SENT_SOURCES:
        limits = F.broadcast(limits)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # A hash threshold keeps most texts from being sorted; the sort makes the bound certain and the sample one and the same.
    bar = int(min(1.0, 1.2 * sample_rows / max(1, total)) * 1_000_000)
    at = F.xxhash64(F.col(id_col))
    near = live.where(F.pmod(at, F.lit(1_000_000)) < bar).select(F.col(source).alias("__src"), F.col(text).alias("__text"), at.alias("__h"), F.xxhash64(text).alias("__h2"))
    picked = near.join(limits, F.col("__src").eqNullSafe(F.col("__ls")), "left").orderBy("__h", "__h2").select("__text", "__lc", "__lb").limit(sample_rows).collect()
    kind = df.schema[id_col].dataType.simpleString()
    model = train([(r[0], (r[1], r[2])) for r in picked]) if len(picked) >= LEAST else None
    # Only the source and the lengths are joined; the text goes where its row goes.
    rows = live.select(F.col(id_col).alias("__id"), F.col(source).cast("string").alias("__src"), F.col(source).alias("__s"), F.col(text).alias("__text"), F.length(text).alias("__c"), F.octet_length(text).alias("__b"))
    rows = rows.join(limits, F.col("__s").eqNullSafe(F.col("__ls")), "left").drop("__s", "__ls")
    out = rows.mapInPandas(lambda it: _score(it, model), schema=f"id {kind}, source string, score double")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source), "score")

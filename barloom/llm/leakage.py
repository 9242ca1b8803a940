"""Evaluation passages leaking into documents: spaced-seed hashing, a join on the hashes, tolerant verification.

A spaced seed looks at some of the words in a short span and ignores the others, so a changed word only breaks the
seeds that look at it. The seeds of both sides are rows, and equal hashes are joined. Three things keep the join small,
and none of them loses a pair that has enough agreeing seeds:

* A passage needs agreeing seeds at `need` of its n places, so it must have some at `t` of any n - need + t places. Only
  the places whose hashes fewest passages share are joined: stock sentences drop out.
* The hashes that are joined are put into a bit array of fixed size, by which the documents' seeds are sifted where
  they are read. What passes by chance finds no partner in the join.
* A hash that many documents have is spread over `salts` parts.

The pairs that come out are aligned, word by word, around their seeds. Any number of passages can be asked; nothing of
the documents, and of the passages nothing but the bit array, reaches the driver.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut

#: Looked-at (1) and ignored (0) positions. The shorter finds passages of which six words are left, the longer what it meets by chance least.
MASKS = ("11011", "1101011")
BITS = 24  # the bit array has two to the power of this many bits, 2 MB
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[^<>]{0,200}>")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")


def words(text: str | None) -> list[str]:
    """Lower-case words without punctuation, markup, entities, invisible marks or compatibility forms."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.casefold())


def lcs_pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The index pairs of a longest common subsequence, by bit-parallel rows and a walk back."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v, rows = full, [full]
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, out = len(a) - 1, []
    # A zero bit i in row j says that a[i] lengthens the best match of a[:i+1] with b[:j].
    j = len(b)
    while i >= 0 and j > 0:
        if rows[j] >> i & 1:
            i -= 1
        elif not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.append((i, j - 1))
            i, j = i - 1, j - 1
    return out[::-1]


class _Memo(dict):
    """Hashes of words, the same in every process; forgotten before they fill the memory."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_MEMO = _Memo()


def word_hashes(text: str | None) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(_MEMO.__getitem__, w), np.uint64, len(w))


def seeds(t: np.ndarray, j: int) -> np.ndarray:
    """The hash of mask j at every place of a text of word hashes."""
    at = np.flatnonzero(np.frombuffer(MASKS[j].encode(), np.uint8) == 49)
    n = len(t) - int(at[-1])
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(j + 1))
    for off in at:
        h = (h ^ t[off : off + n]) * _SPREAD
        h ^= h >> np.uint64(29)
    return h


def all_seeds(t: np.ndarray) -> list[np.ndarray]:
    return [seeds(t, j) for j in range(len(MASKS))]


class Passage:
    """A passage's words and its seeds in order, made once for all documents that are compared with it."""

    def __init__(self, text: str):
        self.words = word_hashes(text)
        self.list = self.words.tolist()
        self.order = [np.argsort(h, kind="stable") for h in all_seeds(self.words)]
        self.sorted = [h[o] for h, o in zip(all_seeds(self.words), self.order)]

    def hits(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(place in the passage, place in the text) of every agreeing seed of a text with these seeds."""
        ips, dps = [], []
        for h, order, ht in zip(self.sorted, self.order, found):
            if not len(h) or not len(ht):
                continue
            lo = np.searchsorted(h, ht, "left")
            at = np.flatnonzero(h[np.minimum(lo, len(h) - 1)] == ht)
            if len(at):
                lo = lo[at]
                n = np.searchsorted(h, ht[at], "right") - lo
                if len(n) == n.sum():
                    ips.append(order[lo])
                    dps.append(at)
                else:
                    flat = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    ips.append(order[flat])
                    dps.append(np.repeat(at, n))
        if not ips:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(ips), np.concatenate(dps)


def need(words: int, share: float) -> int:
    """Places of a passage at which seeds must agree."""
    return max(min(2, words - len(MASKS[0]) + 1), int(np.ceil(share * words)))


def cover(passage: list[int], text: np.ndarray, ip: np.ndarray, dp: np.ndarray, reach: int, run: int) -> tuple[int, int]:
    """(words of the passage repeated in order, where in the text), around the best-supported place.

    The place is a window of the passage's length and `reach` more words, so that two parts may stand
    apart. Words count from the first to the last of a run of at least `run` aligned words that lets single
    words be changed, so chance matches and brief quotations of a few words do not count.
    """
    starts = np.sort(dp - ip)  # where the passage would begin
    upto = np.searchsorted(starts, starts + reach, "right")
    k = int(np.argmax(upto - np.arange(len(starts))))
    lo = max(0, int(starts[k]) - 2)
    b = text[lo : lo + len(passage) + reach + 4].tolist()
    pairs = lcs_pairs(passage, b)
    good, first, done = 0, 0, -1
    for i in range(1, len(pairs) + 1):
        if i == len(pairs) or pairs[i][0] - pairs[i - 1][0] > 2 or pairs[i][1] - pairs[i - 1][1] > 2:
            if i - first >= run:
                (x, y), (u, v) = pairs[first], pairs[i - 1]
                # A word at the end of a copied stretch can have been aligned with a chance one further off.
                while x > done + 1 and y > 0 and passage[x - 1] == b[y - 1]:
                    x, y = x - 1, y - 1
                while u + 1 < len(passage) and v + 1 < len(b) and passage[u + 1] == b[v + 1]:
                    u, v = u + 1, v + 1
                good += max(0, u - max(x, done + 1) + 1)
                done = max(done, u)
            first = i
    return good, lo


def _passage_seeds(batches: Iterator[pd.DataFrame], seed_share: float) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for item, passage in zip(pdf["__item"], pdf["__passage"]):
            t = word_hashes(passage)
            for j in range(len(MASKS)):
                h = seeds(t, j)
                out.append(pd.DataFrame({"item": item, "ip": np.arange(len(h)), "h": h.view(np.int64), "places": max(0, len(t) - len(MASKS[0]) + 1), "need": need(len(t), seed_share)}))
        yield pd.concat(out) if out else pd.DataFrame({"item": [], "ip": [], "h": [], "places": [], "need": []})


def _portions(docs: pd.Series, texts: pd.Series, chars: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    """Runs of rows with about `chars` characters, so that long texts do not add up in memory."""
    d, t, n = [], [], 0
    for doc, text in zip(docs, texts):
        d.append(doc)
        t.append(text)
        n += len(text)
        if n >= chars:
            yield d, t
            d, t, n = [], [], 0
    if d:
        yield d, t


def _sift(batches: Iterator[pd.DataFrame], array) -> Iterator[pd.DataFrame]:
    """(doc, h): the seeds of the documents that the bit array lets pass, once per document."""
    bits = array.value
    gap = max(len(m) for m in MASKS)
    for pdf in batches:
        for docs, texts in _portions(pdf["__doc"], pdf["__text"]):
            parts = [word_hashes(x) for x in texts]
            sizes = np.array([len(p) + gap for p in parts])
            # Words of two documents are kept apart by a gap, and seeds that look into it are left out.
            flow, doc = np.zeros(int(sizes.sum()), np.uint64), np.repeat(np.arange(len(parts)), sizes)
            inside = np.zeros(len(flow), bool)
            for p, end in zip(parts, np.cumsum(sizes)):
                flow[end - gap - len(p) : end - gap] = p
                inside[end - gap - len(p) : end - gap] = True
            found, owner = [], []
            for j, mask in enumerate(MASKS):
                h = seeds(flow, j)
                k = h >> np.uint64(64 - BITS)
                at = np.flatnonzero((bits[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & inside[: len(h)] & inside[len(mask) - 1 : len(mask) - 1 + len(h)])
                found.append(h[at])
                owner.append(doc[at])
            h, d = np.concatenate(found), np.concatenate(owner)
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            ids = pd.Series(docs)
            yield pd.DataFrame({"doc": ids.take(d[fresh]).to_numpy(), "h": h[fresh].view(np.int64)})


def _verify(batches: Iterator[pd.DataFrame], share: float, reach: int, run: int, seed_share: float) -> Iterator[pd.DataFrame]:
    last, tokens, found = None, np.zeros(0, np.uint64), []
    passages: dict[str, Passage] = {}
    for pdf in batches:
        out = []
        for item, passage, doc, text in zip(pdf["__item"], pdf["__passage"], pdf["__doc"], pdf["__text"]):
            if text != last:  # the rows of a document follow each other
                last, tokens = text, word_hashes(text)
                found = all_seeds(tokens)
            p = passages.get(passage)
            if p is None:
                if len(passages) > 5000:
                    passages.clear()
                p = passages[passage] = Passage(passage)
            ip, dp = p.hits(found)
            if len(ip) and len(set(ip.tolist())) >= need(len(p.words), seed_share):
                got, at = cover(p.list, tokens, ip, dp, reach, run)
                if got >= share * len(p.words):
                    out.append((item, doc, got, len(p.words), at))
        yield pd.DataFrame(out, columns=["item", "doc", "words_matched", "words_total", "at_word"])


def leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str,
    text: str,
    item_id: str,
    passage: str,
    share: float = 0.5,
    reach: int = 300,
    run: int = 5,
    seed_share: float = 0.12,
    least_hits: int = 4,
    salts: int = 4,
) -> DataFrame:
    """(item_id, doc_id, words_matched, words_total, at_word): each document with each passage it repeats.

    A passage counts as repeated if at least `share` of its words occur in its order within a window
    of the passage's length and `reach` words, counting runs of at least `run` equal words in which
    single words may be changed, and if seeds agree at `seed_share` of its words or more, at two at least.
    Null or empty texts and passages, and rows with a null id, match nothing; passages of fewer than five words have
    no seeds and match nothing. Repeated documents each give their row; a document id that occurs twice
    gives a row per occurrence. `least_hits` is the t of the module's first rule; it changes the cost only.
    """
    ik, dk = items.schema[item_id].dataType.simpleString(), documents.schema[doc_id].dataType.simpleString()
    asked = items.where(F.col(passage).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("__item"), F.col(passage).alias("__passage"))
    docs = documents.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text"))

    every = asked.mapInPandas(lambda it: _passage_seeds(it, seed_share), schema=f"item {ik}, ip bigint, h bigint, places bigint, need bigint")
    common = every.groupBy("h").agg(F.count_distinct("item").alias("__m"))
    # A place is as common as its commonest hash.
    places = every.join(common, "h").groupBy("item", "ip", "places", "need").agg(F.max("__m").alias("__m"), F.collect_set("h").alias("__hs"))
    t = F.least(F.lit(least_hits).cast("bigint"), F.col("need"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("__m", "ip"))
    rare = places.withColumn("__k", rank).where(F.col("__k") <= F.col("places") - F.col("need") + t)
    rare = cut(rare.select("item", "ip", t.alias("t"), F.explode("__hs").alias("h")))

    # One bit a hash, 64 to a row: at most 2 ^ (BITS - 6) rows, however many passages there are.
    bit = F.shiftrightunsigned("h", 64 - BITS)
    word = rare.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    packed = np.zeros(1 << (BITS - 6), np.int64)
    for r in word.toLocalIterator():
        packed[r.w] = r.b
    array = documents.sparkSession.sparkContext.broadcast(packed.view(np.uint8))

    sifted = docs.mapInPandas(lambda it: _sift(it, array), schema=f"doc {dk}, h bigint").withColumn("__salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    spread = rare.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    met = sifted.join(spread, ["h", "__salt"]).groupBy("item", "doc").agg(F.size(F.collect_set("ip")).alias("__n"), F.max("t").alias("t"))
    pairs = met.where(F.col("__n") >= F.col("t")).select(F.col("item").alias("__item"), F.col("doc").alias("__doc"))
    full = docs.join(pairs, "__doc").join(asked, "__item")
    found = full.mapInPandas(lambda it: _verify(it, share, reach, run, seed_share), schema=f"item {ik}, doc {dk}, words_matched bigint, words_total bigint, at_word bigint")
    return found.select(F.col("item").alias(item_id), F.col("doc").alias(doc_id), "words_matched", "words_total", "at_word")

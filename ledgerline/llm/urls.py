"""URL verdicts with a Bloom filter cascade.

A rule list holds keys (host and path prefix) with verdicts.  What a url could match is a set of keys: each
suffix of its host at a label, with each prefix of its path of a length that some rule has.  Those candidate
keys over the whole corpus are the complete key universe.  Level 1 of the cascade encodes the listed keys.
Some candidates that aren't listed hit it by chance; level 2 encodes exactly those.  Listed keys that hit
level 2 by chance go into level 3, and so on until no key is wrong.  A key is listed if the number of levels
it passes in a row is odd; for every key of the universe that is exact, so urls are judged without a join.

At scale: the filters' sizes follow the lists, not the corpus.  The false-positive rate of level 1 is chosen
from a bound on the number of candidates so that at most about ``strays`` of them pass, and the listed keys and
all built levels are checked against ``max_bits`` before they are broadcast.  Of a host only as many labels are
looked at as the longest listed host has, so a hostile url costs no more than its length.  The urls are scanned
twice: once for the strays of all lists together, once to judge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import by_place, place_of

#: Unlisted candidates that level 1 lets through on average, and the largest cascade that is broadcast.
STRAYS, MAX_BITS = 4096, 1 << 28
#: Seeds of the two hashes from which all others follow.
SEEDS = (101, 202)


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidates(host_: Column, path_: Column, lengths: list[int], labels: int) -> Column:
    """All keys that a url could match, longest first: array of host suffix + path prefix.

    Suffixes have at most ``labels`` labels, prefixes one of the ``lengths``: no listed key has others.
    """
    parts = F.slice(F.reverse(F.split(host_, r"\.", -1)), 1, labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.reverse(F.slice(parts, 1, i)), "."))
    prefixes = F.filter(
        F.array(*[F.when(F.length(path_) >= n, F.substring(path_, 1, n)) for n in lengths]),
        lambda x: x.isNotNull(),
    )
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    ordered = F.array_sort(F.array_distinct(keys), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.when(host_ != "", ordered).otherwise(F.array().cast("array<string>"))


class Level:
    """One Bloom filter: bits from two 64-bit hashes by double hashing."""

    def __init__(self, count: int, rate: float, number: int):
        self.number = number
        self.bits = max(64, int(math.ceil(max(1, count) * -math.log(rate) / math.log(2) ** 2)))
        self.hashes = max(1, round(self.bits / max(1, count) * math.log(2)))
        self.set = np.zeros(-(-self.bits // 8), np.uint8)

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        step = (b | np.uint64(1)) * np.uint64(2 * self.number + 1)
        k = np.arange(self.hashes, dtype=np.uint64)[:, None]
        mixed = a + k * step
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed ^ (mixed >> np.uint64(32))) % np.uint64(self.bits)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        at = self.places(a, b).ravel()
        np.bitwise_or.at(self.set, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.places(a, b)
        return ((self.set[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


class Cascade:
    """Levels in turn for listed keys and for strays; exact on the keys it was built over."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    @property
    def bits(self) -> int:
        return sum(x.bits for x in self.levels)

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether keys, given by their hashes, are listed."""
        inside, result = np.ones(len(a), bool), np.zeros(len(a), bool)
        for k, level in enumerate(self.levels):
            at = np.flatnonzero(inside)
            hit = level.has(a[at], b[at])
            inside[at[~hit]] = False
            # A key that passes k + 1 levels and fails the next is listed if k + 1 is odd.
            result[at[hit]] = k % 2 == 0
        return result

    def extend(self, keys: np.ndarray, others: np.ndarray, rate: float = 0.5) -> None:
        """Encode ``keys``; then the ``others`` that pass, then the keys that pass those, until none does."""
        while len(keys):
            level = Level(len(keys), rate, len(self.levels))
            level.add(keys[:, 0], keys[:, 1])
            self.levels.append(level)
            keys, others = others[level.has(others[:, 0], others[:, 1])] if len(others) else others, keys
            if len(self.levels) > 200:
                raise ValueError("two different keys share both hashes")


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), key) for seed in SEEDS]


def _pairs(rows: list) -> np.ndarray:
    return np.array([(r[0], r[1]) for r in rows], np.int64).reshape(-1, 2).view(np.uint64)


def _known(a: np.ndarray, b: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which hash pairs are among ``keys`` (sorted by their first hash)."""
    found = np.zeros(len(a), bool)
    lo, hi = np.searchsorted(keys[:, 0], a, "left"), np.searchsorted(keys[:, 0], a, "right")
    for step in range(int((hi - lo).max(initial=0))):  # pairs that share their first hash
        at = np.flatnonzero(lo + step < hi)
        found[at] |= keys[lo[at] + step, 1] == b[at]
    return found


def build(lists: list[np.ndarray], universe: DataFrame, most: int, strays: int = STRAYS, max_bits: int = MAX_BITS) -> list[Cascade]:
    """A cascade for each list of keys (hash pairs), exact over a universe of keys (columns a, b: hash pairs).

    One pass over the universe, of at most ``most`` keys, finds the strays of all first levels; only those come to
    the driver.  Should more than 16 * strays of a list pass by chance, the levels are rebuilt with a lower rate.
    """
    spark = universe.sparkSession
    lists = [keys[np.lexsort((keys[:, 1], keys[:, 0]))] for keys in lists]
    if 128 * sum(map(len, lists)) > max_bits:
        raise ValueError(f"{sum(map(len, lists))} listed keys need more than the {max_bits} bits that are allowed")
    rate = min(0.5, strays / max(1, most))
    while True:
        firsts = [Level(len(keys), rate, 0) for keys in lists]
        if sum(x.bits for x in firsts) > max_bits:
            raise ValueError(f"the lists need {sum(x.bits for x in firsts)} bits; {max_bits} are allowed")
        for level, keys in zip(firsts, lists, strict=True):
            level.add(keys[:, 0], keys[:, 1])
        shared = spark.sparkContext.broadcast(list(zip(firsts, lists, strict=True)))

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                a, b = (frame[c].to_numpy().view(np.uint64) for c in ("a", "b"))
                for k, (level, keys) in enumerate(shared.value):
                    at = np.flatnonzero(level.has(a, b)) if len(keys) else np.zeros(0, np.int64)
                    at = at[~_known(a[at], b[at], keys)]
                    yield frame.iloc[at].drop_duplicates().assign(k=k)

        limit = 16 * strays * len(lists)
        passed = universe.select("a", "b").mapInPandas(work, "a long, b long, k int").distinct().limit(limit + 1).collect()
        if len(passed) <= limit:
            break
        rate /= 64
    cascades = []
    for k, (level, keys) in enumerate(zip(firsts, lists, strict=True)):
        cascade = Cascade()
        if len(keys):
            cascade.levels.append(level)
            cascade.extend(_pairs([r for r in passed if r["k"] == k]), keys)
        cascades.append(cascade)
    if sum(c.bits for c in cascades) > max_bits:
        raise ValueError(f"the cascades need {sum(c.bits for c in cascades)} bits; {max_bits} are allowed")
    return cascades


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", strays: int = STRAYS) -> DataFrame:
    """Judge the urls of a table by rules (verdict, key); a key is a host and a path prefix, as in ``net/es/``.

    Adds host, path, rule (the longest rule that fits: its host is the url's or a parent domain, and the
    url's path starts with its path; null if none) and verdict (the rule's, else ``default``).  Defined
    results: a null url or one without :// has empty host and path, fits no rule and gets the default; of
    two rules of one length the smaller key wins; of one key listed twice the first verdict counts; repeated
    rows are judged alike; an empty table gives no rows; without rules every url gets the default.  Columns of
    those four names are replaced, columns of any other name stay.
    """
    spark = pages.sparkSession
    verdict_of: dict[str, str] = {}
    for verdict, key in rules:
        verdict_of.setdefault(key, verdict)
    lengths = sorted({len(k) - k.index("/") for k in verdict_of})
    labels = max((k[: k.index("/")].count(".") + 1 for k in verdict_of), default=1)
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    url = F.col(place_of(pages, "url"))
    parts = by_place(pages).select(*[place_of(pages, c) for c in keep], host(url).alias("host"), path(url).alias("path"))
    keyed = parts.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths, labels) if lengths else F.array().cast("array<string>"))
    universe = keyed.select(F.explode("keys").alias("k")).select(*[h.alias(n) for h, n in zip(_hashes(F.col("k")), "ab", strict=True)])
    verdicts = sorted(set(verdict_of.values()))
    listed = spark.createDataFrame(list(verdict_of.items()), "k string, v string").select(*_hashes(F.col("k")), "v").collect()
    own = [_pairs([r for r in listed if r["v"] == v]) for v in verdicts]
    most = pages.count() * labels * len(lengths)
    shared = spark.sparkContext.broadcast(list(zip(verdicts, build(own, universe, most, strays) if own else [], strict=True)))

    @F.pandas_udf("struct<place:int,verdict:string>")
    def first_listed(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        size = np.array([len(x) for x in a], np.int64)
        starts = np.concatenate([[0], np.cumsum(size)])[:-1]
        x, y = (np.concatenate([np.asarray(v, np.int64) for v in s]).view(np.uint64) if size.sum() else np.zeros(0, np.uint64) for s in (a, b))
        kind = np.full(len(x), -1)
        for k, (_, cascade) in enumerate(shared.value):
            kind[cascade.listed(x, y)] = k
        place, names = np.zeros(len(size), np.int32), [None] * len(size)
        row = np.repeat(np.arange(len(size)), size)
        for i in np.flatnonzero(kind >= 0)[::-1]:  # the first of a row is written last
            place[row[i]], names[row[i]] = i - starts[row[i]] + 1, shared.value[kind[i]][0]
        return pd.DataFrame({"place": place, "verdict": names})

    found = keyed.withColumn("found", first_listed(F.transform("keys", lambda k: _hashes(k)[0]), F.transform("keys", lambda k: _hashes(k)[1])))
    rule = F.when(F.col("found.place") > 0, F.element_at("keys", F.greatest(F.col("found.place"), F.lit(1))))
    out = [place_of(pages, c) for c in keep]
    judged = found.select(*out, "host", "path", rule.alias("rule"), F.coalesce(F.col("found.verdict"), F.lit(default)).alias("verdict"))
    return judged.toDF(*keep, "host", "path", "rule", "verdict")

"""Verbatim spans: where a quote stands in a text, by words, in DataFrame functions.

Quote and text are brought to one form (composed characters, single spaces); then one pattern decides: the quote as
it is, between places that aren't inside a word or a number.  "3" isn't in "3.4", "ell" not in "well".
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import collapse, is_ascii, nfc, nfc_each, tokens

#: A place that isn't strictly inside a token (a word, or a number with a mark between digits).
EDGE = r"(?!(?<=\w)(?:\w|[.,]\w))(?!(?<=\w[.,])\w)"
#: Words of a key by which texts meet what they may contain.
KEY_WORDS = 3
#: Characters of all different items up to which they go to every task as one automaton.
AUTOMATON_CHARS = 1 << 20


def before(text: Column, wanted: Column) -> Column:
    """What stands before the first occurrence of ``wanted`` (both collapsed) whose edges cut no token; null if there is none."""
    literal = F.concat(F.lit(r"\Q"), F.replace(wanted, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(rf"(?Us)^(.*?){EDGE}"), literal, F.lit(EDGE))
    return F.when((wanted != "") & F.contains(text, wanted), F.when(F.rlike(text, pattern), F.call_function("regexp_extract", text, pattern, F.lit(1))))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _line_of(word: Column, sizes: Column) -> Column:
    """Index from 0 of the line that holds a word, given its number from 0 and the lines' numbers of words."""
    start = F.struct(word.cast("int").alias("left"), F.lit(0).alias("line"))
    step = lambda s, n: F.when(s["left"] < 0, s).otherwise(F.struct(F.when(s["left"] < n, -1).otherwise(s["left"] - n).alias("left"), F.when(s["left"] < n, s["line"]).otherwise(s["line"] + 1).alias("line")))
    return F.aggregate(sizes, start, step, lambda s: s["line"])


def prepared(rows: DataFrame, lines: str = "lines", composed: bool = True) -> DataFrame:
    """Rows with what a search in their lines needs, so that it is made once for all spans: all words in one text, and how many each line has."""
    texts = F.transform(F.col(lines), lambda x: x["text"])
    # Composition is Python's; rows of ASCII have nothing to compose and don't go there.
    each = F.coalesce(nfc_each(F.when(~is_ascii(F.array_join("_texts", "")), F.col("_texts"))), F.col("_texts")) if composed else F.col("_texts")
    words = F.transform("_texts", lambda t: F.filter(F.split(collapse(F.coalesce(t, F.lit(""))), " "), lambda w: w != ""))
    rows = rows.withColumn("_texts", texts).withColumn("_texts", each).withColumn("_words", words)
    return rows.withColumns({"_body": F.array_join(F.flatten("_words"), " "), "_sizes": F.transform("_words", lambda w: F.size(w))}).drop("_texts", "_words")


def find_spans(pairs: DataFrame, lines: str = "lines", span: str = "span", name: str = "match", found: Column | None = None) -> DataFrame:
    """Add ``match``: struct of first_line, last_line, position and text of the span in the row's lines, or null.

    ``lines`` is an array of (no, text, position).  The first occurrence counts; text is the source's own, white
    space apart.  Null or empty spans and lines give null.  ``found``: what stands before the span in the collapsed
    text, where a search has told it already; then nothing is searched again.  Pairs whose texts are ``prepared`` keep that.
    """
    rows = pairs if "_sizes" in pairs.columns else prepared(pairs, lines, found is None)
    wanted = F.col(span) if found is not None else F.coalesce(nfc(F.when(~is_ascii(F.col(span)), F.col(span))), F.col(span))
    rows = rows.withColumn("_wanted", wanted).withColumn("_wanted", collapse(F.col("_wanted")))
    rows = rows.withColumn("_before", before(F.col("_body"), F.col("_wanted")) if found is None else found)
    first = _spaces(F.col("_before"))
    rows = rows.withColumn("_first", _line_of(first, F.col("_sizes"))).withColumn("_last", _line_of(first + _spaces(F.col("_wanted")), F.col("_sizes")))
    line = lambda at: F.get(F.col(lines), F.col(at))
    match = F.struct(line("_first")["no"].cast("int").alias("first_line"), line("_last")["no"].cast("int").alias("last_line"), line("_first")["position"].alias("position"), F.col("_wanted").alias("text"))
    return rows.withColumn(name, F.when(F.col("_before").isNotNull(), match)).drop("_body", "_sizes", "_wanted", "_before", "_first", "_last")


def _grams(words: Column, n: int) -> Column:
    """Hashes of all runs of n words."""
    none = F.array().cast("array<bigint>")
    runs = lambda i: F.xxhash64(F.lit(n), *[F.element_at(words, i + k) for k in range(n)])
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), runs)).otherwise(none)


@lru_cache(1)
def _automaton(items: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for n, item in enumerate(items):
        found.add_word(item, n)
    found.make_automaton()
    return found


def _held(text: Column, items: tuple[str, ...]) -> Column:
    """Numbers of the items that are substrings of a text, by one pass over it."""

    @F.pandas_udf("array<int>")
    def held(texts: pd.Series) -> pd.Series:
        found = _automaton(items)
        return texts.map(lambda t: sorted({n for _, n in found.iter(t)}), na_action="ignore")

    return held(text)


def contained(texts: DataFrame, wanted: DataFrame, text: str, item: str, key: str, chars: int = AUTOMATON_CHARS) -> DataFrame:
    """All pairs in which an item stands verbatim in a text (both collapsed), with its 0-based start.

    ``key`` names a text.  Items of up to ``chars`` characters altogether become one automaton that every task runs
    over its texts, each read once and none shuffled; the edges of what it finds are then looked at.  Of more items
    each meets the texts by a join on the hash of its first words.  Both ways give the same rows: null or empty texts and
    items give none, repeated texts and items give theirs again, a null key is a key.
    """
    asked = wanted.filter(F.col(item) != "")
    if asked.agg(F.coalesce(F.sum(F.length(item)), F.lit(0))).first()[0] > chars:
        return _contained_by_words(texts, asked, text, item, key)
    items = tuple(r[0] for r in asked.select(item).distinct().sort(item).collect())
    if not items:
        return _contained_by_words(texts, asked, text, item, key)
    numbers = texts.sparkSession.createDataFrame(list(enumerate(items)), "_n int, _asked string")
    known = F.broadcast(asked.join(numbers, F.col(item) == F.col("_asked")).drop("_asked"))
    pairs = texts.withColumn("_n", F.explode(_held(F.col(text), items))).join(known, "_n").drop("_n")
    return pairs.withColumn("start", F.length(before(F.col(text), F.col(item)))).filter("start is not null")


def _contained_by_words(texts: DataFrame, asked: DataFrame, text: str, item: str, key: str) -> DataFrame:
    """The same with a shuffle.

    A containment join has no equal key, so one is made: no token may be cut at an item's edges, so an item's first
    KEY_WORDS tokens are tokens side by side in the text (an item without tokens is keyed by its first mark).  Texts
    are split into tokens once and meet items on a hash of such runs, as bare (key, hash) rows; only pairs that meet
    are fetched and searched.
    """
    asked = asked.withColumn("_t", tokens(F.col(item))).withColumn("_n", F.least(F.size("_t"), F.lit(KEY_WORDS)))
    hashes = [F.when(F.col("_n") == n, F.element_at(_grams(F.slice("_t", 1, n), n), 1)) for n in range(1, KEY_WORDS + 1)]
    asked = asked.withColumn("_gram", F.coalesce(*hashes, F.xxhash64(F.lit(0), F.substring(item, 1, 1))))
    used = sorted(r["_n"] for r in asked.select("_n").distinct().collect())  # KEY_WORDS + 1 numbers at most
    held = texts.select(F.col(key).alias("_key"), tokens(F.col(text)).alias("_t"), F.col(text).alias("_text"))
    grams = [_grams(F.col("_t"), n) for n in used if n]
    if 0 in used:
        grams.append(F.transform(F.array_distinct(F.regexp_extract_all("_text", F.lit(r"(?U)([^\w\s])"), F.lit(1))), lambda m: F.xxhash64(F.lit(0), m)))
    found = held.select("_key", F.explode(F.array_distinct(F.concat(*grams)) if grams else F.array().cast("array<bigint>")).alias("_gram"))
    met = found.join(asked.select("_gram", F.col(item).alias("_item")).distinct(), "_gram").select("_key", "_item").distinct()
    pairs = texts.join(met, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_before", before(F.col(text), F.col("_item"))).filter("_before is not null")
    pairs = pairs.withColumn("start", F.length("_before")).drop("_before")
    return pairs.join(asked.drop("_t", "_n", "_gram").withColumnRenamed(item, "_asked"), F.col("_item") == F.col("_asked")).withColumnRenamed("_asked", item).drop("_key", "_item")

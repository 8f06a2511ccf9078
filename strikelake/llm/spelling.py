"""Spelling variants: pairs of words one edit apart, found by asymmetric q-chunks, and the form each word is a variant of.

Of two words the shorter (or, of equal length, either) contributes two disjoint chunks that cover it, the other the positional
grams of a chunk's size. One inserted, deleted or replaced code point leaves one of the chunks whole, moved by at most one
place, so chunks and grams are joined by (length, chunk, text) within shift one; grams at a shift that the difference of
the lengths rules out meet no chunk and aren't sent. Every candidate is verified.

A chunk that very many words share doesn't make a group of all its pairs: the place that the edit must be in, which is the
word outside the chunk, is halved, and the half that stays joins the key, as often as needed. Where one place is left, a group
holds no more words than two places have letters. All steps are column expressions over the distinct words.

Defined cases: null ids count as empty ones, null texts have no words; repeated rows count as often as they come; words
shorter than ``least_length`` or rarer than ``least_count`` take no part; of forms of equal count the first in code-point order
counts; empty tables give empty results; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikelake.llm.common import ascii_lower
from strikelake.session import materialize

#: Letters of a word after A-Z are lower-cased. Fixed value.
LETTERS = "[a-zÀ-ÿ]+"
#: Groups of more pairs than this are divided. Changes no result.
HOT_PAIRS = 512
KEY = ["l", "s", "e", "rest"]


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, edit: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts, ``edit`` (of id and word) applied to each occurrence before it is counted.

    ``edit`` may shorten a word, never lengthen it.
    """
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    found = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"({LETTERS})"), F.lit(1))).alias("word"))
    found = found.filter(F.char_length("word") >= least_length)
    if edit is not None:
        found = found.select(edit(F.col("id"), F.col("word")).alias("word")).filter(F.char_length("word") >= least_length)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds ``rest``, the word without its open place: [s, e) in a word of length l, one longer in a word of length l + d."""
    return rows.withColumn("rest", F.concat(F.expr("substring(word, 1, s)"), F.expr("substring(word, e + d + 1)")))


def _first_keys(counts: DataFrame) -> DataFrame:
    """The two chunks of every word (d = 0) and its grams for the chunks of words shorter by one (d = 1).

    The left chunk leaves the place to its right open, and the other way round. Against words of its own length a word's
    chunks are its grams, as such an edit moves nothing.
    """
    forms = []
    for d in (0, 1):
        size = F.char_length("word") - d
        half = F.floor(size / 2)
        for start, end in ((half, size), (F.lit(0), half)):
            forms.append(F.struct(size.cast("int").alias("l"), start.cast("int").alias("s"), end.cast("int").alias("e"), F.lit(d).alias("d")))
    return _keyed(counts.select("word", "n", F.explode(F.array(*forms)).alias("k")).select("word", "n", "k.*"))


def _halved(rows: DataFrame) -> DataFrame:
    """Two keys for each, one for either half of the open place that the edit may be in."""
    middle = F.floor((F.col("s") + F.col("e")) / 2).cast("int")
    halves = F.array(F.struct(F.col("s").alias("s"), middle.alias("e")), F.struct(middle.alias("s"), F.col("e").alias("e")))
    return _keyed(rows.withColumn("k", F.explode(halves)).select("word", "n", "l", "k.s", "k.e", "d"))


def near_pairs(counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(x, x_n, y, y_n), once for every two words of (word, n) that differ by exactly one code point."""
    rows, parts = _first_keys(counts), []
    while True:
        sizes = rows.groupBy(*KEY).agg(F.sum(1 - F.col("d")).alias("chunks"), F.sum("d").alias("grams")).filter("chunks > 0 and chunks + grams > 1")
        level = materialize(rows.join(sizes, KEY), "spelling-keys")
        hot = (F.col("chunks") * (F.col("chunks") + F.col("grams")) > hot_pairs) & (F.col("e") - F.col("s") > 1)
        cold = level.filter(~hot)
        x = cold.filter("d = 0").select(*KEY, F.col("word").alias("x"), F.col("n").alias("x_n"))
        y = cold.select(*KEY, "d", F.col("word").alias("y"), F.col("n").alias("y_n"))
        met = x.join(y, KEY).filter((F.col("d") == 1) | (F.col("x") < F.col("y")))
        opened = met.withColumns({"open_x": F.expr("substring(x, s + 1, e - s)"), "open_y": F.expr("substring(y, s + 1, e + d - s)")})  # the words agree outside
        parts.append(materialize(opened.filter(F.levenshtein("open_x", "open_y", 1) == 1).select("x", "x_n", "y", "y_n"), "spelling-pairs"))
        left = level.filter(hot)
        if left.isEmpty():
            break
        rows = _halved(left.select("word", "n", "l", "s", "e", "d"))
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last one, the distance doubled in every round."""
    known = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        after = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(known.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if moved.filter("moved").isEmpty():
            return known
        known = moved.select("word", "root")


def group_variants(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """For every word of (word, n): ``form``, its near word of largest n if that is ``ratio`` times its own or more, ``root``,
    where forms lead to in the end, and ``n_near`` and ``form_n``."""
    counts = materialize(counts.select("word", "n"), "spelling-words")
    pairs = near_pairs(counts)
    both = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("word"), F.col("y").alias("near"), F.col("y_n").alias("m")), F.struct(F.col("y").alias("word"), F.col("x").alias("near"), F.col("x_n").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("near"))).alias("best"))
    joined = counts.join(best, "word", "left")
    is_form = -F.col("best.m") >= ratio * F.col("n")
    joined = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")), "spelling-forms")
    ends = roots(joined.filter("form is not null").select("word", "form"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

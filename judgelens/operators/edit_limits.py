"""How far an update may change a prompt: edit size, sections per update, strength of the modal words.

The learning rate limits a step: an update may change one section, by at most a number of characters
that shrinks with the rate, and how binding its words are counts beside their number. Both full texts
of a section are compared, never their previews.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import join_on
from .prompts import section_pairs

#: Modal words by rising strength; the first two classes are soft, the others hard.
MODAL_CLASSES = (("can",), ("should",), ("must",), ("always",))
HARD_FROM = 3
#: Words are runs of letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"


def char_limit(learning_rate: Column, initial_lr: float, max_chars: int) -> Column:
    """Characters an update may change: ``max_chars`` scaled by the share of the initial rate (0 to 1; a
    missing rate allows none)."""
    if initial_lr <= 0:
        raise ValueError(f"initial_lr must be positive, got {initial_lr}")
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(learning_rate, F.lit(0.0)) / F.lit(float(initial_lr))))
    return F.floor(F.lit(float(max_chars)) * ratio).cast("int")


def _common(a: Column, b: Column) -> Column:
    """Characters that both texts have in common at their start, by halving steps."""
    n = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    same = lambda at, s: F.substring(a, at + 1, s) == F.substring(b, at + 1, s)
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((s <= n - at) & same(at, s), at + s).otherwise(at))


def banded_distance(a: str, b: str, limit: int) -> int:
    """Edit distance of two texts up to ``limit``, else -1. One row of the distance table is kept,
    ``2 * limit + 1`` wide, and the walk ends once all of it is above the limit."""
    if abs(len(a) - len(b)) > limit:
        return -1
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    width, above = 2 * limit + 1, 2 * limit + 2     # place k of row i stands for column i + k - limit
    offsets = np.arange(width)
    padded = np.concatenate([np.zeros(limit, np.uint32), y, np.zeros(width, np.uint32)])
    row = np.where((offsets >= limit) & (offsets - limit <= len(y)), offsets - limit, above)
    for i in range(1, len(x) + 1):
        column = offsets + (i - limit)
        take = row + (padded[i - 1:i - 1 + width] != x[i - 1])  # keep or change a character
        drop = np.append(row[1:], above) + 1                    # leave one of x out
        row = np.where(column < 1, above, np.minimum(take, drop))
        if i <= limit:
            row[limit - i] = i                                  # column 0
        row = np.minimum.accumulate(row - offsets) + offsets    # put one of y in
        row[(column < 0) | (column > len(y))] = above
        if row.min() > limit:
            return -1
    d = int(row[limit + len(y) - len(x)])
    return d if d <= limit else -1


def _banded(limit: int):
    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else banded_distance(s, t, limit) for s, t in zip(a, b)], dtype="Int32")

    return distance


#: Longest differing middle (characters) that the built-in distance takes; its cost grows with the square.
BUILT_IN_CHARS = 2048


def with_distance(df: DataFrame, old: str, new: str, limit: int, out: str = "distance") -> DataFrame:
    """``df`` with the edit distance of two text columns in characters, or -1 where it is above ``limit``.

    What both share at either end is cut off first, as an update mostly touches one spot. What is left
    goes to the built-in distance if it is short, else to a banded table in Arrow batches, whose cost is the
    length times the limit and which stops early for unlike texts. Each step is a projection of its own, so
    that what several later ones read is worked out once.
    """
    cols = [F.col(c) for c in df.columns if c not in ("_a", "_b", "_n", out)]
    a, b, n = F.col("_a"), F.col("_b"), F.col("_n")
    x = df.select(*cols, F.col(old).alias("_a"), F.col(new).alias("_b"))
    x = x.select(*cols, "_a", "_b", _common(a, b).alias("_n"))
    x = x.select(*cols, F.substring(a, n + 1, F.length(a)).alias("_a"), F.substring(b, n + 1, F.length(b)).alias("_b"))
    x = x.select(*cols, "_a", "_b", _common(F.reverse(a), F.reverse(b)).alias("_n"))
    x = x.select(*cols, F.substring(a, F.lit(1), F.length(a) - n).alias("_a"), F.substring(b, F.lit(1), F.length(b) - n).alias("_b"))
    apart = F.abs(F.length(a) - F.length(b)) > limit
    long = ~apart & (F.greatest(F.length(a), F.length(b)) > BUILT_IN_CHARS)
    return x.select(*cols, F.when(apart, F.lit(-1)).when(long, _banded(limit)(F.when(long, a), F.when(long, b)))
                    .otherwise(F.levenshtein(F.when(~long & ~apart, a), F.when(~long & ~apart, b), limit)).alias(out))


def edit_audit(old: DataFrame, new: DataFrame, rates: DataFrame, initial_lr: float = 1.0, max_chars: int = 200,
               max_sections: int = 1) -> DataFrame:
    """Each section that an update touches, checked against the step limits.

    ``old`` and ``new`` are sections of one version each, ``rates(prompt_id, learning_rate)`` the rate of
    the update; without one nothing may change. Per touched section: status (added, removed, changed),
    char_limit, chars_changed (edit distance between both texts, NULL where it is above the limit, see
    :func:`with_distance`), section_no (its place among
    the prompt's touched sections by name) and verdict: ``ok``, ``too_many_sections`` (beyond
    ``max_sections``) or ``too_long``.
    """
    pairs = section_pairs(old, new).filter("status <> 'unchanged'")
    limited = join_on(pairs, rates.select("prompt_id", "learning_rate"), ["prompt_id"], "left").withColumn(
        "char_limit", char_limit(F.col("learning_rate"), initial_lr, max_chars))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    # distances are cut at max_chars, the same for all rows, and then held against the row's own limit
    limited = with_distance(limited.withColumns({c: text(c) for c in ("old_content", "new_content")}), "old_content", "new_content", max_chars, "_d")
    within = (F.col("_d") >= 0) & (F.col("_d") <= F.col("char_limit"))
    place = F.row_number().over(Window.partitionBy("prompt_id").orderBy("section"))
    return limited.select(
        "prompt_id", "section", "status", "char_limit", F.when(within, F.col("_d")).alias("chars_changed"),
        place.alias("section_no")).withColumn(
        "verdict", F.when(F.col("section_no") > max_sections, "too_many_sections")
        .when(F.col("chars_changed").isNull(), "too_long").otherwise("ok"))


def modal_counts(text: Column, classes=MODAL_CLASSES) -> list[Column]:
    """How often the words of each class occur in the text: whole words, in any case."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)
    among = lambda c: lambda w: w.isin(*c)
    return [F.size(F.filter(words, among(c))).cast("bigint") for c in classes]


def modal_strength(old: DataFrame, new: DataFrame, classes=MODAL_CLASSES, hard_from: int = HARD_FROM) -> DataFrame:
    """Per changed section how binding its words are, before and after.

    Class number i (from 1) weighs i. ``strength`` is the weighted count, ``level`` the highest class
    used (0: none); ``soft_to_hard`` marks a section in which soft words (below class ``hard_from``) gave
    way to hard ones: fewer of the former and more of the latter. A missing text has no words.
    """
    pairs = section_pairs(old, new).filter("status <> 'unchanged'")
    counted = pairs.select("prompt_id", "section", "status", F.array(*modal_counts(F.col("old_content"), classes)).alias("o"),
                           F.array(*modal_counts(F.col("new_content"), classes)).alias("n"))
    total = lambda a, weigh, start=0, end=len(classes): sum(
        (F.col(a)[i] * F.lit((i + 1) if weigh else 1) for i in range(start, end)), F.lit(0).cast("bigint"))
    level = lambda a: F.greatest(F.lit(0), *[F.when(F.col(a)[i] > 0, F.lit(i + 1)) for i in range(len(classes))])
    soft, hard = hard_from - 1, len(classes)
    rises = (total("n", False, 0, soft) < total("o", False, 0, soft)) & (total("n", False, soft, hard) > total("o", False, soft, hard))
    return counted.select(
        "prompt_id", "section", "status", total("o", True).alias("old_strength"), total("n", True).alias("new_strength"),
        (total("n", True) - total("o", True)).alias("rise"), level("o").alias("old_level"), level("n").alias("new_level"),
        rises.alias("soft_to_hard"))

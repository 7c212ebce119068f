"""Quality rules, line first: lines are judged, then what is lost decides about the document.

A line with a word fails if it

* is navigation: at most ``nav_words`` words and two separators (``|``, ``»``, ``›``, ``>``), or
  three such separators of any length,
* is boilerplate: at most ``notice_words`` words and one of the notices below,
* is marks rather than text: ``#*$%&|<>`` and exclamation marks are over a tenth of it,
* lacks punctuation: it does not end as a sentence does and has under ``open_words`` words.

Failing lines are removed (`cleaned`); a document is rejected if they hold over ``most_lost``
percent of its words.  Before that, documents fail the base rules: under 50 words, or over half the
words in repeated three-word windows.

Column functions only.  Repeated windows are found inside each document by sorting: 40 bits of the
digest and the position share one long (a cheap filter over all windows), then the few that share
those bits are compared by all 64 bits; nothing is exploded or shuffled, so a document's cost is
its own and hot sources or copies cannot meet in a task.

Defined cases: a null text has no words and fails the base rules; an empty table gives no rows;
repeated rows repeat; texts of any length are whole (over 2^24 words, all windows are compared by
64 bits); columns of the documents that are named like a result are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, restored

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Notices of the kinds that web pages repeat.
NOTICES = (
    r"(?i)cookie|javascript|privacy policy|terms of (use|service)|all rights reserved|copyright|\(c\) ?\d{4}|©|licen[sc]e|subscribe|newsletter|sign (in|up)|log ?in|"
    r"click here|read more|share (this|on)|follow us|powered by|skip to|back to top|lorem ipsum|alle rechte vorbehalten|datenschutz|tous droits réservés|todos los derechos"
)
ENDS = r"[.!?…:;][\"'”’»)\]]*$"
BITS = 24


def words_in(line: Column) -> Column:
    return F.filter(F.split(line, SPACES), lambda w: w != "")


def line_passes(line: Column, n: Column, nav_words: int, notice_words: int, open_words: int) -> Column:
    size = F.length(line)
    separators = size - F.length(F.translate(line, "|»›>", ""))
    marks = size - F.length(F.translate(line, SYMBOLS + "!", ""))
    navigation = (separators >= 3) | ((n <= nav_words) & (separators >= 2))
    notice = (n <= notice_words) & line.rlike(NOTICES)
    unended = (n < open_words) & ~F.rtrim(line).rlike(ENDS)
    return ~(navigation | notice | (10 * marks > size) | unended)


def quality_rules(
    docs: DataFrame, text_col: str = "text", nav_words: int = 12, notice_words: int = 40, open_words: int = 6, most_lost: int = 50
) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost
    (words in failing lines), cleaned (text without them) and kept."""
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost", "cleaned", "kept")
    work, column, kept = numbered(docs, new)
    text = F.coalesce(F.col(column(text_col)).cast("string"), F.lit(""))
    step = work.select(*(k for k, _ in kept), text.alias("_text"), F.split(text, "\n").alias("_lines"))
    step = step.withColumn("_lw", F.transform("_lines", words_in))
    step = step.withColumns({"_w": F.flatten("_lw"), "_n": F.transform("_lw", lambda w: F.size(w))}).drop("_lw")
    n = F.size("_w")
    digests = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    used = F.filter(F.zip_with("_lines", "_n", lambda x, k: F.when(k > 0, x)), lambda x: x.isNotNull())
    good = F.transform(F.arrays_zip(F.col("_lines").alias("x"), F.col("_n").alias("k")), lambda z: (z["k"] == 0) | line_passes(z["x"], z["k"], nav_words, notice_words, open_words))
    step = step.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.regexp_replace("_text", SPACES, "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
            "_used": used,
            "_good": good,
            "_d": digests,
        }
    ).drop("_w", "_text")
    low = (1 << BITS) - 1
    step = step.withColumns(
        {
            "n_dup_lines": (F.size("_used") - F.size(F.array_distinct("_used"))).cast("long"),
            "_p": F.when(F.size("_d") < low, F.sort_array(F.transform("_d", lambda h, i: h.bitwiseAND(~low).bitwiseOR(i.cast("long"))))),
            "n_lost": F.aggregate(F.zip_with("_n", "_good", lambda k, g: F.when(g, 0).otherwise(k)), F.lit(0).cast("long"), lambda a, k: a + k),
            "cleaned": F.array_join(F.filter(F.zip_with("_lines", "_good", lambda x, g: F.when(g, x)), lambda x: x.isNotNull()), "\n"),
        }
    ).drop("_used", "_lines", "_good", "_n")
    same = lambda x, y: F.coalesce(F.shiftright(x, BITS) == F.shiftright(y, BITS), F.lit(False))
    alike = F.transform(F.filter("_p", lambda x, i: same(x, F.get("_p", i - 1)) | same(x, F.get("_p", i + 1))), lambda x: x.bitwiseAND(low).cast("int"))
    at = F.coalesce(alike, F.sequence(F.lit(0), F.size("_d") - 1))
    step = step.withColumn("_at", at).drop("_p")
    step = step.withColumn("_s", F.sort_array(F.transform("_at", lambda i: F.struct(F.get("_d", i).alias("h"), i.alias("i"))))).drop("_d", "_at")
    equal = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    step = step.withColumn("_r", F.sort_array(F.transform(F.filter("_s", lambda x, i: equal(x, F.get("_s", i - 1)) | equal(x, F.get("_s", i + 1))), lambda x: x["i"]))).drop("_s")
    covered = F.aggregate(F.transform("_r", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_r", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, k: a + k)
    step = step.withColumn("n_repeat_words", covered).drop("_r")
    step = step.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    step = step.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_lost") <= most_lost * F.col("n_words")))
    # A filter on a result must not be pushed below: it would repeat the expressions of every step within
    # each other.  A partition id is never negative, but Spark keeps filters above such a column.
    here = F.spark_partition_id() >= 0
    return restored(step.withColumns({c: F.when(here, F.col(c)) for c in new}), kept, new)

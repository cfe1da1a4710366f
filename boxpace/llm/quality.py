"""Line-first quality rules (operator 10), column expressions only.

Each line with a word is judged on its own by punctuation, navigation and
boilerplate rules; lines that fail are removed, and a document that loses more
than ``max_lost_pct`` of its words that way is rejected. Document-level figures
(words, symbols, repeated lines and windows) give the base verdict.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, lower_ascii, texts

WORD_SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LINE_SYMBOLS = "#*$%&<>"
WINDOW = 8
# Sentence ends of the scripts the corpus may hold.
SENTENCE_ENDS = ".!?。！？؟।…"
SEPARATORS = "|»›·•"
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "privacy policy",
    "terms of service",
    "terms of use",
    "subscribe to our newsletter",
    "share on facebook",
    "back to top",
    "skip to content",
    "lorem ipsum",
)


def count_chars(c: Column, chars: str) -> Column:
    """How many characters of ``c`` are in ``chars``."""
    rest = c
    for ch in chars:
        rest = F.replace(rest, F.lit(ch), F.lit(""))
    return F.length(c) - F.length(rest)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_words(line: Column) -> Column:
    """Words of a line that has one."""
    return F.size(F.split(F.btrim(line, F.lit(BLANKS)), WORD_SPLIT))


def any_of(text: Column, parts) -> Column:
    """Does ``text`` hold one of ``parts``."""
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def line_fails(line: Column, symbols: Column, marks: Column, separators: Column, phrases: Column) -> Column:
    """True if a line with a word fails a rule.

    Punctuation: three words or more and no sentence end; or more symbols than
    half the words, three at least; or as many ``!`` as words, three at least.
    Navigation: three separators or more, and at least one for four words.
    Boilerplate: holds one of the fixed phrases, whatever its case.
    The other arguments tell whether the whole text has any such characters or phrases; a
    rule is evaluated only where it does.
    """
    n = line_words(line)
    n_sym, n_mark, n_sep = count_chars(line, LINE_SYMBOLS), count_chars(line, "!"), count_chars(line, SEPARATORS)
    return ((~line.rlike("[" + SENTENCE_ENDS + "]") & (n >= 3))
            | (symbols & (n_sym >= 3) & (2 * n_sym > n)) | (marks & (n_mark >= 3) & (n_mark >= n))
            | (separators & (n_sep >= 3) & (4 * n_sep >= n))
            | (phrases & any_of(lower_ascii(line), BOILERPLATE)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20,
            max_repeat_pct: int = 30, max_lost_pct: int = 50) -> DataFrame:
    """One row per row of ``docs``: figures, base verdict, cleaned text, kept.

    (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines, n_bad_lines, n_lost_words, kept, clean_text). A NULL or empty text has
    no words and fails the base. NULL ids stay NULL, repeated rows are judged
    each, an empty table gives no rows. ``clean_text`` holds the lines with a word that
    pass, joined by newlines; it is not computed unless it is selected.

    Repeated windows are found inside the row: window hashes (64 bits) are
    sorted, equal neighbours are repeats, and the union of their word positions
    is summed in one pass. Only texts with an equal pair pay for the positions.
    """
    t = F.col("text")
    d = texts(docs, id_col, text_col)
    d = d.withColumn("_words", F.filter(F.split(t, WORD_SPLIT), lambda x: x != ""))
    d = d.withColumn("_w", F.transform("_words", lambda x: F.xxhash64(x)))
    d = d.withColumns({"_l": F.filter(F.split(t, "\n"), has_word), "_sym": any_of(t, LINE_SYMBOLS),
                       "_mark": t.contains("!"), "_sep": any_of(t, SEPARATORS),
                       "_phrase": any_of(lower_ascii(t), BOILERPLATE)})
    n = F.size("_w")
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.slice(F.col("_w"), i + 1, WINDOW)))
    d = d.withColumn("_h", F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    hints = [F.col(c) for c in ("_sym", "_mark", "_sep", "_phrase")]
    d = d.withColumn("_bad", F.filter("_l", lambda x: line_fails(x, *hints)))
    pairs = F.sort_array(F.transform(F.col("_h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.withColumn("_p", F.when(repeats, pairs))
    p = F.col("_p")
    same = F.filter(p, lambda x, i: (F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)))
                    | (F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))))
    d = d.withColumn("_at", F.sort_array(F.transform(same, lambda x: x["i"])))
    covered = F.aggregate(
        F.col("_at"), F.struct(F.lit(0).alias("e"), F.lit(0).alias("c")),
        lambda a, i: F.struct((i + WINDOW).alias("e"), (a["c"] + WINDOW - F.greatest(a["e"] - i, F.lit(0))).alias("c")),
        lambda a: a["c"])
    lost = F.aggregate(F.col("_bad"), F.lit(0), lambda a, x: a + line_words(x))
    d = d.withColumns({"_r": F.coalesce(covered, F.lit(0)), "_lost": lost})
    base_failed = (n < min_words) | (100 * F.col("_r").cast("long") > max_repeat_pct * n.cast("long"))
    clean = F.filter("_l", lambda x: ~line_fails(x, *hints))
    return d.select(
        "doc_id", n.cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count_chars(t, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.col("_r").cast("long").alias("n_repeat_words"), base_failed.alias("base_failed"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size("_bad").cast("long").alias("n_bad_lines"),
        F.col("_lost").cast("long").alias("n_lost_words"),
        (~base_failed & (100 * F.col("_lost").cast("long") <= max_lost_pct * n.cast("long"))).alias("kept"),
        F.array_join(clean, "\n").alias("clean_text"))

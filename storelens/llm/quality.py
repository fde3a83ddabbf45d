"""Quality rules: one threshold table compiled into Spark projections (no user functions).

``RULES`` lists a measure, the side on which it fails and the threshold; each
row becomes a boolean expression over the measured columns, and a document is
kept when no rule fails. Measures are array and string functions over one
split of the whole text into words and lines. Repeated windows are found
among the document's own 64-bit window fingerprints, which are sorted with their
places only where one occurs twice: at most n log n in the words of a document. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from storelens.llm.common import WORD, text_or_empty

WINDOW_WORDS = 8
SYMBOLS = "#*$%&|<>"
#: Removed at both ends of a word before it is looked up among the stop words.
PUNCTUATION = ".,;:!?()"
#: Common function words by language (fixed values); compared with words in lower case.
STOP_WORDS = {
    "en": "a and are as at be by for from he in is it of on or that the this to was were with you",
    "fr": "au aux avec ce dans de des du elle en est et il la le les ne ou par pas pour que qui se sur un une",
    "de": "auf das dem den der des die ein eine er es für ich im in ist mit nicht sich sie und von zu",
    "es": "al como con de del el en es la las lo los no o para por que se su un una y",
}

#: Thresholds (measure, failing side, threshold). Ratios are shares of words, lines or code points.
RULES = (
    ("n_words", "<", 20),
    ("repeat_ratio", ">", 0.30),
    ("mean_word_chars", "<", 1.5),
    ("mean_word_chars", ">", 25.0),
    ("symbol_ratio", ">", 0.30),
    ("dup_line_ratio", ">", 0.50),
    ("stop_ratio", "<", 0.02),
    ("upper_ratio", ">", 0.50),
    ("run_ratio", ">", 0.50),
)
#: The rules behind base_failed.
BASE = RULES[0], RULES[1]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the ratios of RULES.

    Null and empty texts count 0 everywhere, and their ratios are 0. Rows are
    measured one by one, so ties and repeated rows change nothing, and other
    columns are not read.
    """
    k = WINDOW_WORDS
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    stop_sql = ", ".join(f"'{w}'" for w in stop)
    word = WORD.replace("\\", "\\\\")
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        text_or_empty(text_col).alias("__t"),
    ).select(
        "doc_id",
        "__t",
        F.expr(f"regexp_extract_all(__t, '{word}', 0)").alias("__w"),
        F.expr(f"filter(split(__t, '\\n', -1), l -> l rlike '{word}')").alias("__l"),
    )
    windows = split.select(
        "doc_id",
        F.size("__w").cast("long").alias("n_words"),
        F.expr("length(array_join(__w, ''))").cast("long").alias("word_chars"),
        F.expr(f"regexp_count(__t, '[{SYMBOLS}]')").cast("long").alias("n_symbols"),
        F.size("__l").alias("__lines"),
        F.expr("size(__l) - size(array_distinct(__l))").cast("long").alias("n_dup_lines"),
        F.expr(f"size(filter(__w, w -> trim(BOTH '{PUNCTUATION}' FROM lower(w)) in ({stop_sql})))").alias("__stop"),
        F.expr("size(filter(__w, (w, i) -> i > 0 and __w[i - 1] = w))").alias("__runs"),
        F.expr("regexp_count(__t, '\\\\p{Lu}')").alias("__upper"),
        F.expr(
            f"if(size(__w) > {k}, transform(sequence(1, size(__w) - {k - 1}), i -> xxhash64(slice(__w, i, {k}))),"
            " cast(array() as array<bigint>))"
        ).alias("__h"),
    )
    # places of the windows found twice or more; most documents have none, and are not sorted
    repeated = windows.withColumn(
        "__s",
        F.expr(
            "if(size(array_distinct(__h)) = size(__h), array(),"
            " sort_array(transform(__h, (h, i) -> struct(h, i as p))))"
        ),
    ).withColumn(
        "__p",
        F.expr(
            "sort_array(transform(filter(__s, (x, i) -> (i > 0 and __s[i - 1].h = x.h)"
            " or (i < size(__s) - 1 and __s[i + 1].h = x.h)), x -> x.p))"
        ),
    )
    counted = repeated.withColumn(
        "n_repeat_words",
        F.expr(
            "aggregate(transform(__p, (p, i) ->"
            f" if(i < size(__p) - 1, least({k}, __p[i + 1] - p), {k})), 0L, (a, b) -> a + b)"
        ),
    )
    share = lambda part, whole: F.expr(f"if({whole} > 0, {part} / {whole}, 0D)")
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_repeat_words", "n_words").alias("repeat_ratio"),
        share("n_symbols", "n_words").alias("symbol_ratio"),
        share("n_dup_lines", "__lines").alias("dup_line_ratio"),
        share("__stop", "n_words").alias("stop_ratio"),
        share("__runs", "n_words").alias("run_ratio"),
        share("__upper", "word_chars").alias("upper_ratio"),
    )


def verdicts(measured: DataFrame, rules=RULES) -> DataFrame:
    """``measured`` with failed_rules (the texts of all failed rules, in table order) and kept (none failed)."""
    failed = F.filter(
        F.array(*[F.when(F.expr(f"{m} {op} {t}"), F.lit(f"{m} {op} {t}")) for m, op, t in rules]), lambda x: x.isNotNull()
    )
    return measured.withColumn("failed_rules", failed).withColumn("kept", F.size("failed_rules") == 0)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, base_failed (integer form: n_words < 20 or 100 n_repeat_words > 30 n_words), failed_rules and kept.

    The stop-word rule knows words of English, French, German and Spanish alone: a text in a language with other function
    words fails it, so apply the table where language ID names one of these. A null or empty text has no words and fails
    the base rule; texts of any length are measured whole; repeated rows give repeated results; an empty table gives none.
    """
    out = verdicts(measures(docs, id_col, text_col))
    return out.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")).withColumn(
        "kept", F.expr("kept and not base_failed")
    )

"""Quality rules whose thresholds come from the corpus: quantile sketches per language and source, then a joined filter.

Everything is DataFrame functions. Texts are read once and become a few counts each. A sketch is a log-linear histogram of
whole numbers: a value falls into the bucket of its leading BITS binary digits, so a bucket is at most 1 / 2^(BITS - 1) wide
for its size. Sketches are rows (group, rule, bucket, n) and merge by adding up n, which does not depend on order: reruns
agree, hot groups combine before they are shuffled, and a group with fewer than ENOUGH documents takes the merged sketch
of its language or of all. Each group's fences (quartiles and their distance, per rule) are joined to its documents.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from nightfold.llm.common import WORD, stored

MIN_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
BITS = 6
SCALE = 10_000  # shares are counted in this part
ENOUGH = 200  # documents that have words
SALTS = 16
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A measure of a document as a whole number; it fails above (or below) quartile +- reach * their distance.

    The distance counts as `least` at least: where nearly all documents agree, small deviations are no reason.
    """

    name: str
    measure: Callable[[], Column]
    above: float | None
    below: float | None
    least: int


def _share(part: str, whole: str = "n_words", scale: int = SCALE) -> Callable[[], Column]:
    return lambda: F.floor(F.col(part) * scale / F.col(whole)).cast("long")


RULES = (
    Rule("word_length", _share("word_chars", scale=100), 4.0, 4.0, 50),
    Rule("symbol_share", _share("n_symbols"), 4.0, None, 200),
    Rule("dup_lines", _share("n_dup_lines"), 4.0, None, 100),
    Rule("repeat_share", _share("n_repeat_words"), 4.0, None, 500),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body (or a function in it) uses it."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """How many words lie in a window of three words that occurs twice or more among the words (by 64-bit hashes)."""

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

    def covered(at: Column) -> Column:
        """Words in the windows that begin at the ascending places `at`."""
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def twice(pairs: Column) -> Column:
        """Places of the windows that have an equal neighbour in the order of hashes."""
        own = F.filter(pairs, lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(own, lambda x: x["i"]))

    def found(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_let(_let(placed, twice), covered))

    return _let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), found)


def counts(docs: DataFrame, text_col: str = "text") -> list[Column]:
    """The columns COUNTS of each whole text; a null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return [
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(words).cast("long").alias("n_repeat_words"),
    ]


def bucket(v: Column) -> Column:
    """The whole number v >= 0 without all but its BITS leading binary digits."""
    drop = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(values: DataFrame, keys: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """(keys, rule, bucket, n) of rows with one column a rule; null values are not counted."""
    long = values.select(*keys, F.inline(F.array(*[F.struct(F.lit(r.name).alias("rule"), bucket(F.col(r.name)).alias("bucket")) for r in rules])))
    return long.where("bucket is not null").groupBy(*keys, "rule", "bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rule, total, q1, q3): the buckets of the values with ranks floor(total / 4) and floor(3 total / 4), from 0."""
    group = [*keys, "rule"]
    upto = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)  # buckets: a bounded number
    s = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(W.partitionBy(*group)))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("total") * q / 4), F.col("bucket")))
    return s.groupBy(*group).agg(F.max("total").alias("total"), at(1).alias("q1"), at(3).alias("q3"))


def fences(sketch: DataFrame, rules: Sequence[Rule] = RULES, enough: int = ENOUGH) -> DataFrame:
    """(lang, source, {rule}_low, {rule}_high) of every group in `sketch` (keys without nulls); a group takes the
    merged sketch of its language, or else of all, where its own counts fewer than `enough`."""
    own = quartiles(sketch, ["lang", "source"])
    by_lang = quartiles(sketch.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n")), ["lang"])
    whole = quartiles(sketch.groupBy("rule", "bucket").agg(F.sum("n").alias("n")), [])
    renamed = lambda df, p: df.withColumnsRenamed({c: p + c for c in ("total", "q1", "q3")})
    f = own.join(renamed(by_lang, "l_"), ["lang", "rule"]).join(F.broadcast(renamed(whole, "w_")), "rule")  # whole: one row a rule
    pick = lambda c: F.when(F.col("total") >= enough, F.col(c)).when(F.col("l_total") >= enough, F.col(f"l_{c}")).otherwise(F.col(f"w_{c}"))
    f = f.select("lang", "source", "rule", pick("q1").alias("q1"), pick("q3").alias("q3"))
    aggs = []
    for r in rules:
        mine = lambda c, r=r: F.max(F.when(F.col("rule") == r.name, F.col(c)))
        reach = F.greatest(mine("q3") - mine("q1"), F.lit(r.least))
        if r.below is not None:
            aggs.append((mine("q1") - r.below * reach).alias(f"{r.name}_low"))
        if r.above is not None:
            aggs.append((mine("q3") + r.above * reach).alias(f"{r.name}_high"))
    return f.groupBy("lang", "source").agg(*aggs)


def _key(c: str) -> Column:
    """A key without nulls: null is a group of its own."""
    s = F.col(c).cast("string")
    return F.when(s.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), s))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rules: Sequence[Rule] = RULES, enough: int = ENOUGH) -> DataFrame:
    """One row per document: doc_id, the COUNTS, base_failed, kept, failed (names of the rules that it broke).

    base_failed: fewer than MIN_WORDS words, or more than MOST_REPEATED per cent of them in repeated windows. Such
    documents count in the sketches as others do if they have words; wordless ones have no measures. Nulls in language
    or source are groups of their own, a null text is wordless, repeated rows are separate documents, values
    on a fence are inside. Other columns are not read; an empty table gives an empty result.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = docs.select(F.col(id_col).alias("doc_id"), _key(lang_col).alias("lang"), _key(source_col).alias("source"), *counts(docs, text_col))
    rows = stored(rows, "counts")
    rows = rows.withColumns({r.name: F.when(F.col("n_words") > 0, r.measure()) for r in rules}).withColumn("base_failed", base)
    limits = stored(fences(stored(sketches(rows, ["lang", "source"], rules), "sketch"), rules, enough), "fences")
    # A source may hold a third of all documents: its rows are dealt out, and its one row of fences to all of them.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    limits = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = salted.join(limits, ["lang", "source", "salt"], "left")
    broken = []
    for r in rules:
        low, high = (F.col(r.name) < F.col(f"{r.name}_low") if r.below is not None else F.lit(False)), (F.col(r.name) > F.col(f"{r.name}_high") if r.above is not None else F.lit(False))
        broken.append(F.when(F.coalesce(low, F.lit(False)) | F.coalesce(high, F.lit(False)), F.lit(r.name)))
    out = out.withColumn("failed", F.array_compact(F.array(*broken)))
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")

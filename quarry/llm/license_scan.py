"""Licence scan by ordered signature rules, in DataFrame functions only.

A text becomes its words in lower case with two spaces between, so that a rule matches whole
words, a space on either side, and neighbouring matches do not share a space. One prefilter over all
keywords passes few texts on; of those only the rules run whose keyword is there. Every
match becomes a row (words before it since the last one, words in it); running sums give
its interval of words. A match that lies inside another one's interval is suppressed, and of
two that overlap otherwise the one of the earlier rule stays.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .license_rules import Rule, rules

# A run of what is no part of a word, once A-Z are in lower case.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The one letter outside ASCII whose lower case is an ASCII letter, and one that stays outside.
_KELVIN, _ANGSTROM = "\u212a", "\u212b"


def spaced_words(text: Column) -> Column:
    """The words of a text in lower case, two spaces between, before and after them.

    Only A-Z become other words by that: other letters stay what they are, letters outside ASCII.
    """
    low = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(_KELVIN), F.lit(_ANGSTROM)))
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), NOT_WORD, "  ")


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def count_words(part: Column) -> Column:
    """Words of a part of such a text that begins and ends between words: two spaces each, and one at either end of the text."""
    return F.floor(_spaces(part) / 2).cast("long")


def spaced_pattern(pattern: str) -> str:
    """A rule's expression over words with one space between, for the spaced form."""
    return " " + pattern.replace(" ?", "(?:_)?").replace(" ", "  ").replace("_", "  ") + " "


def _spaced_keyword(keyword: str) -> str:
    """A keyword as it stands in a spaced text: a whole word, or the beginning of one."""
    return " " + keyword[:-1] if keyword.endswith("*") else f" {keyword} "


def prefilter(known: list[Rule]) -> str:
    """One expression that finds any keyword, branching on first letters."""
    keywords = sorted({_spaced_keyword(r.keyword)[1:] for r in known})
    branches = [first + "(?:" + "|".join(re.escape(k[1:]) for k in same) + ")"
                for first, same in ((f, list(g)) for f, g in itertools.groupby(keywords, key=lambda k: k[0]))]
    return " (?:" + "|".join(branches) + ")"


def _rule_groups(known: list[Rule]) -> Column:
    """The rules by keyword, as one constant: array of (keyword, array of (number, pattern))."""
    groups = []
    for keyword, same in itertools.groupby(sorted(known, key=lambda r: (r.keyword, r.number)), key=lambda r: r.keyword):
        each = [F.struct(F.lit(r.number).alias("number"), F.lit(spaced_pattern(r.pattern)).alias("pattern")) for r in same]
        groups.append(F.struct(F.lit(_spaced_keyword(keyword)).alias("keyword"), F.array(*each).alias("rules")))
    return F.array(*groups)


def _matches(spaced: Column, known: list[Rule]) -> Column:
    """Every match of every rule: array of (rule, nth, gap, width), in words; gap: since the rule's last match."""
    def of_rule(rule: Column) -> Column:
        found = F.regexp_extract_all(spaced, rule["pattern"], F.lit(0))
        gaps = F.split(spaced, rule["pattern"])
        return F.transform(found, lambda m, k: F.struct(
            rule["number"].alias("rule"), k.alias("nth"), count_words(F.get(gaps, k)).alias("gap"), count_words(m).alias("width")))
    active = F.filter(_rule_groups(known), lambda g: F.contains(spaced, g["keyword"]))
    return F.flatten(F.transform(active, lambda g: F.flatten(F.transform(g["rules"], of_rule))))


def license_matches(docs: DataFrame, known: list[Rule] | None = None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Every match, and one row with null ``rule`` for a text without any:
    (row, id, n_words, rule, first, last, kept), words counted from 0, last included.

    ``row`` numbers the input's rows, so rows that repeat an id stay apart; it alone is what
    a shuffle goes by, and no text travels. ``kept`` is false for suppressed matches.
    """
    known = rules() if known is None else known
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                       spaced_words(F.col(text_col)).alias("spaced"))
    none = F.array().cast("array<struct<rule:int,nth:int,gap:bigint,width:bigint>>")
    found = F.when(F.col("spaced").rlike(prefilter(known)), _matches(F.col("spaced"), known)).otherwise(none)
    flat = (base.select("row", "id", (count_words(F.col("spaced")) - 1).alias("n_words"), F.explode_outer(found).alias("m"))
            .select("row", "id", "n_words", "m.*"))
    so_far = Window.partitionBy("row", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.sum(F.col("gap") + F.col("width")).over(so_far) - 1
    placed = flat.withColumn("last", last).withColumn("first", F.col("last") - F.col("width") + 1)
    # inside another interval: an earlier one in this order reaches as far
    by_place = Window.partitionBy("row").orderBy(F.col("first"), F.col("last").desc(), "rule")
    reach = F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    free = placed.withColumn("free", F.col("rule").isNotNull() & (F.coalesce(reach, F.lit(-1)) < F.col("last")))
    # free ones begin and end in the same order, so only neighbours can overlap first
    beside = Window.partitionBy("row", "free").orderBy("first")
    before, after = F.lag(F.struct("last", "rule")).over(beside), F.lead(F.struct("first", "rule")).over(beside)
    loses = ((before["last"] >= F.col("first")) & (before["rule"] < F.col("rule"))) | (
        (after["first"] <= F.col("last")) & (after["rule"] < F.col("rule")))
    return free.select("row", "id", "n_words", "rule", "first", "last",
                       (F.col("free") & ~F.coalesce(loses, F.lit(False))).alias("kept"))


def _by_number(known: list[Rule], value) -> Column:
    """A property of the rule in column ``rule``, from one constant array."""
    return F.get(F.array(*[F.lit(value(r)) for r in known]), F.col("rule"))


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licences found, one row each: (id, label, rule, confidence, base, first_word, last_word).

    ``first_word`` and ``last_word`` bound the words, counted from 0. Base phrases are always
    listed, also inside a longer match; of the others only matches that are not suppressed.
    """
    known = rules()
    found = license_matches(docs, known, id_col, text_col).where("rule is not null")
    base = _by_number(known, lambda r: r.base)
    return found.where(base | F.col("kept")).select(
        "id", _by_number(known, lambda r: r.label).alias("label"), "rule",
        _by_number(known, lambda r: r.confidence).alias("confidence"), base.alias("base"),
        F.col("first").alias("first_word"), F.col("last").alias("last_word"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are the
    smallest and largest start of one (null without any); ``base_labels`` and ``labels`` are
    distinct, sorted and joined by commas, empty without any; ``score`` is the highest
    confidence of a match that counts, 0 without any. Null and empty texts have no words;
    rows that repeat an id are scanned each; a null id stays null.
    """
    known = rules()
    base = F.coalesce(_by_number(known, lambda r: r.base), F.lit(False))
    label = _by_number(known, lambda r: r.label)
    counts = base | F.col("kept")
    found = license_matches(docs, known, id_col, text_col).select(
        "row", "id", "n_words", F.when(base, F.col("first")).alias("start"),
        F.when(base, label).alias("base_label"), F.when(counts, label).alias("label"),
        F.when(counts, _by_number(known, lambda r: r.confidence)).alias("confidence"))
    return found.groupBy("row").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.count("start").alias("n_base"),
        F.min("start").alias("first_word"), F.max("start").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set("base_label")), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max("confidence"), F.lit(0.0)).alias("score")).drop("row")

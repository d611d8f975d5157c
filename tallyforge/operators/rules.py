"""Keyword rules that come as a table: a user's own categories by the thousand, joined rather than written into the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import bind, fold_upper
from tallyforge.operators.skew import lookup_join
from tallyforge.session import materialised

#: Letters of a keyword that are joined on; shorter keywords are joined whole.
PREFIX = 4
#: Rules that begin alike up to which a text that holds that beginning is searched for each of them.
CROWDED = 64
#: Beginnings up to this many are broadcast (a few dozen bytes each); more are met in a shuffle join.
BROADCAST_RULES = 100_000


def rules_by_prefix(rules: DataFrame) -> DataFrame:
    """`rules` (keyword, category, place) by the first letters of the keyword: gram, keyword in capitals, place and
    category. Rules without a keyword or a category say nothing. Of equal keywords the first place decides."""
    said = rules.filter("keyword <> '' AND category IS NOT NULL").select(
        F.expr(fold_upper("keyword")).alias("keyword"), F.struct("place", "category").alias("rule")
    )
    firsts = said.groupBy("keyword").agg(F.min("rule").alias("rule"))
    return firsts.select(F.left("keyword", F.lit(PREFIX)).alias("gram"), "keyword", "rule.place", "rule.category")


def categorised_by_table(rows: DataFrame, rules: DataFrame, text: str = "description", name: str = "category") -> DataFrame:
    """`rows` with the category of the first rule (smallest place, then category) whose keyword occurs in the text, in any
    case; NULL where none does.

    Each distinct text is cut into its pieces of up to four letters, which meet those that rules begin with. Where few rules
    begin with a piece, all of them are looked for in the text. Where more than CROWDED do, the text is cut there once more, at
    each of their lengths, and meets them whole: what a text meets does not grow with the number of rules. Rules are data on
    both sides of a join: their number is limited by nothing in the plan. A text that many rows share is read once, and a
    text with very many rows does not make one task of its join.
    """
    prepared = materialised(rules_by_prefix(rules), "keyword-rules")
    few = F.count("*") <= CROWDED
    lengths = F.when(~few, F.collect_set(F.char_length("keyword"))).alias("lengths")
    grams = materialised(prepared.groupBy("gram").agg(lengths), "rule-grams")
    sizes = grams.groupBy(F.char_length("gram").alias("size")).agg(F.count("*").alias("n")).collect()  # PREFIX rows at most
    listed = sum(r["n"] for r in sizes) <= BROADCAST_RULES

    def with_lengths(pieces: DataFrame) -> DataFrame:
        return pieces.join(F.broadcast(grams), "gram") if listed else lookup_join(pieces, grams, ["gram"], large=True)

    rule = F.struct("keyword", F.struct("place", "category").alias("rule"))
    keyed = with_lengths(prepared).groupBy(F.expr("if(lengths IS NULL, gram, keyword)").alias("key")).agg(F.collect_list(rule).alias("rules"))
    distinct = rows.select(F.col(text).alias("_text")).filter("_text <> ''").distinct()
    # Dealt out again: few texts would sit in few tasks after the shuffle, and cutting them is the work here.
    texts = materialised(distinct.repartition(rows.sparkSession.sparkContext.defaultParallelism), "rule-texts")
    places = ", ".join(
        f"transform(sequence(1, greatest(char_length(u) - {r['size'] - 1}, 1)), i -> struct(i AS at, substring(u, i, {r['size']}) AS gram))"
        for r in sizes
    )
    cut = texts.select("_text", F.expr(f"inline({bind(fold_upper('_text'), 'u', f'flatten(array({places}))')})")) if sizes else texts.select(
        "_text", F.lit(1).alias("at"), F.lit("").alias("gram")
    )
    whole = bind(fold_upper("_text"), "u", "transform(filter(lengths, n -> at + n - 1 <= char_length(u)), n -> substring(u, at, n))")
    pieces = with_lengths(cut).select("_text", F.explode(F.expr(f"if(lengths IS NULL, array(gram), {whole})")).alias("key"))
    met = lookup_join(materialised(pieces.distinct(), "rule-pieces"), materialised(keyed, "rules-by-key"), ["key"], large=True)
    occurring = bind(fold_upper("_text"), "u", "array_min(transform(filter(rules, r -> contains(u, r.keyword)), r -> r.rule))")
    first = met.groupBy("_text").agg(F.min(F.expr(occurring)).alias("_rule")).filter("_rule IS NOT NULL")
    found = materialised(first.select("_text", F.col("_rule.category").alias(name)), "rule-categories")
    kept = [c for c in rows.columns if c != name]
    return lookup_join(rows.select(*kept, F.col(text).alias("_text")), found, ["_text"], "left", large=True).select(*kept, name)

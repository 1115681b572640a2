"""Checking stated figures and words against computed facts, for many texts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.functions.numbers import figure_value
from plumbline.functions.text import first_contained, fold


def licences(headers: DataFrame) -> DataFrame:
    """answer_id with the kinds of claim its facts support.

    ``headers``: answer_id, operation, complete, truncated_range,
    categorical_truncation, omitted, n_series, n_points.
    """
    sound = F.col("complete") & ~F.col("truncated_range") & ~F.col("categorical_truncation")
    return headers.select(
        "answer_id",
        (sound & F.col("operation").isin("sum", "count") & (F.col("omitted") == 0)).alias("superlative_ok"),
        (sound & (F.col("operation") == "none") & (F.col("n_series") <= 1) & (F.col("n_points") > 2)).alias("trend_ok"),
    )


def figures(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("text_id", "answer_id")) -> DataFrame:
    """Every pure number written in a text, with its value in the text's language."""
    tokens = texts.select(*keep, "language", F.posexplode(F.regexp_extract_all(text, F.lit(vocab.FIGURE_TOKEN), F.lit(0))).alias("pos", "token"))
    pure = tokens.filter(F.col("token").rlike(vocab.PURE_FIGURE))
    return pure.select(*keep, "pos", "token", figure_value(F.col("token"), F.col("language")).alias("value"))


def numbers_in(text: Column, language: Column) -> Column:
    """Values of all numbers in one of our own sentences, as an array."""
    found = F.regexp_extract_all(text, F.lit("[0-9][0-9.,]*"), F.lit(0))
    return F.array_compact(F.transform(found, lambda t: figure_value(t, language)))


def allowed_values(facts: DataFrame, headers: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """answer_id, value: every figure a text about the answer may contain.

    ``facts``: answer_id, value, n_used - ``headers``: answer_id, language,
    row_basis, stated_total, row_coverage, observed_from, observed_to,
    limitation.  Dates are allowed only as far as the data itself covers them.
    """
    number = "decimal(38,12)"
    parts = [
        facts.select("answer_id", F.explode(F.array(F.col("value").cast(number), F.col("n_used").cast(number))).alias("value")),
    ]
    if series is not None:
        parts.append(series.select("answer_id", F.col("value").cast(number).alias("value")))
    bounds = F.regexp_extract_all(F.concat_ws(" ", F.col("observed_from").cast("string"), F.col("observed_to").cast("string")), F.lit("[0-9]+"), F.lit(0))
    own = F.concat(
        F.array(F.col("stated_total").cast(number), F.col("row_basis").cast(number)),
        F.transform(bounds, lambda t: t.try_cast(number)),
        F.coalesce(numbers_in(F.col("row_coverage"), F.col("language")), F.array().cast(f"array<{number}>")),
        F.coalesce(numbers_in(F.col("limitation"), F.col("language")), F.array().cast(f"array<{number}>")),
    )
    parts.append(headers.select("answer_id", F.explode(own).alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter("value is not null").distinct()


def unlicensed_figures(found: DataFrame, allowed: DataFrame) -> DataFrame:
    """Figures that are not among the allowed ones; unreadable numbers never are."""
    return found.join(allowed, ["answer_id", "value"], "left_anti")


def rejected_tokens(unlicensed: DataFrame, first: int = 5) -> DataFrame:
    """text_id, number of rejected figures, and the first few in text order."""
    return unlicensed.groupBy("text_id").agg(
        F.count(F.lit(1)).alias("n_rejected"), F.min(F.struct("pos", "token")).alias("_first"),
        F.slice(F.array_sort(F.collect_list(F.struct("pos", "token"))), 1, first).alias("_few"),
    ).select("text_id", "n_rejected", F.col("_first.token").alias("first_rejected"), F.transform("_few", lambda s: s["token"]).alias("rejected"))


def mislabelled_figures(texts: DataFrame, facts: DataFrame, split_colon: bool = True) -> DataFrame:
    """Figures inside a clause that names one category but belong to others.

    The labels of an answer are at most its top categories and a remainder, so
    they ride along as one array and nothing is paired up row by row.
    """
    owned = facts.groupBy("answer_id").agg(F.collect_set(F.struct(
        fold(F.col("label")).alias("label"), F.col("value").cast("decimal(38,12)").alias("value"))).alias("owned"))
    cut = vocab.CLAUSE_BREAK if split_colon else vocab.CLAUSE_BREAK.replace(":", "")
    clauses = texts.select("text_id", "answer_id", "language", F.explode(F.split("text", cut)).alias("clause"))
    # exploding the one list, and the one folded text, fixes it as a value: inlined into the filter or the
    # lambda below it would be worked out again each time; clauses without a figure are not folded
    pure = F.filter(F.regexp_extract_all("clause", F.lit(vocab.FIGURE_TOKEN), F.lit(0)), lambda t: t.rlike(vocab.PURE_FIGURE))
    stated = clauses.select("*", F.explode(F.array(pure)).alias("tokens")).filter(F.size("tokens") > 0).join(owned, "answer_id")
    folded = stated.select("text_id", "language", "owned", "tokens", F.explode(F.array(fold(F.col("clause")))).alias("folded"))
    labels = F.array_distinct(F.transform(
        F.filter("owned", lambda f: (f["label"] != "") & F.contains(F.col("folded"), f["label"])), lambda f: f["label"]))
    named = folded.select("text_id", "language", "owned", labels.alias("named"), "tokens")
    tokens = named.select(
        "text_id", F.get("named", F.lit(0)).alias("label"), "owned", "language",
        F.explode(F.when(F.size("named") == 1, F.col("tokens"))).alias("token"))
    figures_read = tokens.select("text_id", "label", "owned", "token", F.explode(F.array(figure_value(F.col("token"), F.col("language")))).alias("value"))
    owners = F.transform(F.filter("owned", lambda f: f["value"] == F.col("value")), lambda f: f["label"])
    wrong = F.when((F.size(owners) > 0) & ~F.array_contains(owners, F.col("label")), F.col("token"))
    return figures_read.select("text_id", "label", wrong.alias("token")).filter("token is not null")


def text_rules(texts: DataFrame, licensed: DataFrame) -> DataFrame:
    """Rules that need only the words: first broken one and the word behind it."""
    joined = texts.join(licensed, "answer_id", "left").withColumn("folded", fold(F.col("text")))
    markup = F.lit(False)
    for pattern in vocab.MARKUP_PATTERNS:
        markup = markup | F.col("text").rlike(pattern)
    words = joined.withColumns({
        "_number": first_contained(F.col("folded"), vocab.NUMBER_WORDS),
        "_best": F.when(~F.coalesce("superlative_ok", F.lit(False)), first_contained(F.col("folded"), vocab.SUPERLATIVE_WORDS)),
        "_trend": F.when(~F.coalesce("trend_ok", F.lit(False)), first_contained(F.col("folded"), vocab.TREND_WORDS)),
    })
    reason = (
        F.when(F.trim("text") == "", F.lit("empty narration"))
        .when(F.length("text") > vocab.MAX_NARRATION_CHARS, F.lit("narration far longer than a summary"))
        .when(markup, F.lit("narration contains markup or a link"))
        .when(F.col("_number").isNotNull(), F.lit("magnitude written as a word"))
        .when(F.col("_best").isNotNull(), F.lit("superlative not licensed by the facts"))
        .when(F.col("_trend").isNotNull(), F.lit("trend claim not licensed by the facts"))
        .when(F.col("limitation").isNotNull() & ~F.contains("folded", fold(F.col("limitation"))),
              F.lit("stated limitation omitted from the answer"))
    )
    word = (
        F.when(reason == "magnitude written as a word", F.col("_number"))
        .when(reason == "superlative not licensed by the facts", F.col("_best"))
        .when(reason == "trend claim not licensed by the facts", F.col("_trend"))
    )
    return words.select("text_id", "answer_id", reason.alias("text_reason"), word.alias("word"))


def check_texts(texts: DataFrame, facts: DataFrame, headers: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """text_id, ok, reason, rejected: the first broken rule of every text.

    ``texts``: text_id, answer_id, text, language, limitation.
    """
    rules = text_rules(texts, licences(headers))
    extra = headers.drop("language", "limitation").join(
        texts.groupBy("answer_id").agg(F.max("language").alias("language"), F.max("limitation").alias("limitation")), "answer_id")
    figures_off = rejected_tokens(unlicensed_figures(figures(texts), allowed_values(facts, extra, series)))
    labels_off = mislabelled_figures(texts, facts).groupBy("text_id").agg(F.min("token").alias("mislabelled"))
    joined = rules.join(figures_off, "text_id", "left").join(labels_off, "text_id", "left")
    reason = F.coalesce(
        "text_reason",
        F.when(F.col("n_rejected") > 0, F.lit("figure not present in the computed facts")),
        F.when(F.col("mislabelled").isNotNull(), F.lit("figure attached to a category it does not belong to")),
    )
    rejected = (
        F.when(F.col("text_reason").isNotNull(), F.array_compact(F.array("word")))
        .when(F.col("n_rejected") > 0, F.col("rejected"))
        .otherwise(F.array_compact(F.array("mislabelled")))
    )
    return joined.select("text_id", "answer_id", reason.isNull().alias("ok"), reason.alias("reason"), rejected.alias("rejected"))

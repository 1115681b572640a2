"""Plans, answers, refusals, caveats, provenance and chart series as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import dates, numbers, vocab, web
from plumbline.functions.text import detect_language, group_key, normalise_question, output_language, safe_label, strip
from plumbline.operators import catalogue, retrieval

PARAMS = "struct<date_from:string,date_to:string,region:string,metrics:array<string>,aggregation:string,group_by:string,limit:string>"


# --- plans ----------------------------------------------------------------------


def valid_params(raw_json: Column, limit_max: int = vocab.LIMIT_MAX) -> Column:
    """Typed intent from a proposed JSON object; anything unusable becomes null."""
    raw = F.from_json(raw_json, PARAMS)

    def day(value: Column) -> Column:
        return F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), value.try_cast("date").cast("string"))

    def words(value: Column) -> Column:
        return F.nullif(strip(value), F.lit(""))

    start, end = day(raw["date_from"]), day(raw["date_to"])
    broken = F.coalesce(start > end, F.lit(False))
    aggregation = F.lower(raw["aggregation"])
    limit = F.when(raw["limit"].rlike("^[0-9]+$"), raw["limit"].try_cast("long"))
    return F.struct(
        F.when(~broken, start).alias("date_from"), F.when(~broken, end).alias("date_to"), words(raw["region"]).alias("region"),
        F.filter(F.transform(F.coalesce(raw["metrics"], F.array().cast("array<string>")), strip), lambda m: m != "").alias("metrics"),
        F.when(aggregation.isin("count", "sum", "avg", "min", "max"), aggregation).alias("aggregation"),
        words(raw["group_by"]).alias("group_by"),
        F.when(limit > 0, F.least(limit, F.lit(limit_max))).alias("limit"),
    )


def choose_candidates(hits: DataFrame, choices: DataFrame | None = None, pool: int = vocab.DISAMBIGUATE_POOL) -> DataFrame:
    """The candidate each question goes on with: rank 0 unless a choice says otherwise.

    ``choices``: qid, choice.  -1 means none fits; an impossible index means 0.
    """
    shortlist = hits.filter(F.col("rank") < pool)
    if choices is None:
        return shortlist.filter("rank = 0").withColumn("none_fits", F.lit(False))
    sizes = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("rank") == 0, F.col("score"))).alias("top_score"))
    wanted = sizes.join(choices, "qid", "left").select(
        "qid", "top_score", (F.coalesce("choice", F.lit(0)) == -1).alias("none_fits"),
        F.when(F.col("choice").between(0, F.col("_n") - 1), F.col("choice")).otherwise(0).alias("rank"))
    return hits.join(wanted, ["qid", "rank"]).withColumn("score", F.col("top_score")).drop("top_score")


def make_plans(questions: DataFrame, hits: DataFrame, datasets: DataFrame, resources: DataFrame, verdicts: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """One plan per question.

    ``verdicts``: qid, relevant, params (JSON), reason - whoever judged.  Without a
    verdict the retrieval confidence decides and the plan is marked degraded.
    """
    chosen = choose_candidates(hits, choices).select("qid", F.col("doc_id").alias("dataset_id"), "score", "none_fits")
    known = datasets.select(F.col("id").alias("dataset_id"), F.col("title").alias("dataset_title"), F.lit(True).alias("_known"))
    best = catalogue.best_resources(resources).select("dataset_id", F.col("id").alias("resource_id"), F.col("format").alias("resource_format"), "access_path")
    language = detect_language(F.col("question"))
    joined = (
        questions.withColumn("language", language).withColumn("normalised", normalise_question(F.col("question"), F.col("language")))
        .join(chosen, "qid", "left").join(known, "dataset_id", "left").join(best, "dataset_id", "left")
        .join(verdicts.select("qid", "relevant", "params", F.col("reason").alias("said")), "qid", "left")
        .withColumn("confidence", F.coalesce(retrieval.confidence(F.col("score")), F.lit(0.0)))
    )
    short = F.length(strip(F.col("question"))) < vocab.MIN_QUESTION_CHARS
    nothing = F.col("dataset_id").isNull()
    missing = F.col("_known").isNull()
    unjudged, readable = F.col("relevant").isNull(), F.col("resource_id").isNotNull()
    low = F.col("confidence") < vocab.SCORE_FLOOR
    said = F.nullif("said", F.lit(""))
    def outcome_of(status: str, why, degraded) -> Column:
        return F.struct(
            F.lit(status).alias("status"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"),
            (degraded if isinstance(degraded, Column) else F.lit(degraded)).alias("degraded"))

    outcome = (
        F.when(short, outcome_of("no_match", "question too short to plan", False))
        .when(nothing, outcome_of("no_match", "no dataset retrieved for this question", False))
        .when(F.col("none_fits"), outcome_of("no_match", "no relevant dataset among the candidates", False))
        .when(missing, outcome_of("no_match", "dataset row missing", True))
        .when(unjudged & low, outcome_of("no_match", "no verdict and retrieval confidence below the floor", True))
        .when(~unjudged & ~F.col("relevant"), outcome_of("no_match", F.coalesce(said, F.lit("dataset judged not relevant")), False))
        .when(~readable, outcome_of("unsupported", "dataset matched but has no readable resource", unjudged))
        .when(unjudged, outcome_of("matched", "no verdict; matched by retrieval score", True))
        .otherwise(outcome_of("matched", F.coalesce(said, F.lit("dataset matched")), False))
    )
    matched = F.col("o.status") == "matched"
    return joined.withColumn("o", outcome).select(
        "qid", "question", "normalised", "language", F.col("o.status").alias("status"), F.col("o.reason").alias("reason"),
        F.col("o.degraded").alias("degraded"), F.when(~short & ~nothing, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.when(~short, F.col("dataset_id")).alias("dataset_id"), "dataset_title",
        *[F.when(matched, F.col(c)).alias(c) for c in ("resource_id", "resource_format", "access_path")],
        F.when(matched & ~unjudged, valid_params(F.col("params"))).otherwise(valid_params(F.lit(None).cast("string"))).alias("params"),
    )


def direct_plans(pairs: DataFrame, resources: DataFrame) -> DataFrame:
    """Plans for questions that name their resource: no retrieval, full confidence.

    ``pairs``: qid, question, resource_id.
    """
    found = catalogue.lookup_resources(pairs, resources.select("id", "dataset_id", "format"))
    return found.filter("error_kind is null").select(
        "qid", "question", F.col("question").alias("normalised"), detect_language(F.col("question")).alias("language"),
        F.lit("matched").alias("status"), F.lit("resource named directly").alias("reason"), F.lit(False).alias("degraded"),
        F.lit(1.0).alias("confidence"), "dataset_id", "resource_id", F.col("format").alias("resource_format"))


def near_misses(plans: DataFrame, hits: DataFrame, datasets: DataFrame, n: int = vocab.NEAR_MISSES) -> DataFrame:
    """First candidates of unmatched questions, in rank order."""
    open_questions = plans.filter("status = 'no_match'").select("qid")
    titled = retrieval.hydrate(hits.filter(F.col("rank") < n).join(open_questions, "qid", "left_semi"), datasets)
    return titled.groupBy("qid").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.coalesce("title", "name").alias("title")))), lambda s: s["title"]).alias("near_misses"))


def refusal_shape(answer_status: Column, plan_status: Column) -> Column:
    return F.when(
        answer_status == "refused",
        F.when(plan_status == "matched", F.lit("matched_but_refused")).when(plan_status == "unsupported", F.lit("unsupported")).otherwise(F.lit("no_match")))


# --- intent against tables ----------------------------------------------------------


def unbound_params(asked: DataFrame, bindings: DataFrame, values: DataFrame, roles: DataFrame) -> DataFrame:
    """Which requested filters a table cannot apply: qid, unbound, notes, region_column.

    ``asked``: qid, rid, params.
    """
    wanted = asked.filter("params.region is not null").select("qid", "rid", group_key(F.col("params.region")).alias("key"))
    labels = roles.filter(F.col("role").isin("dimension", "code")).select("rid", "col_idx", "col_name")
    holders = (
        values.join(labels, ["rid", "col_idx"]).select("rid", "col_idx", "col_name", group_key(F.col("text_value")).alias("key")).distinct()
        .join(wanted, ["rid", "key"]).groupBy("qid").agg(F.min_by("col_name", "col_idx").alias("region_column"))
    )
    joined = asked.join(bindings.select("rid", "temporal", "dimension", "observed_from"), "rid").join(holders, "qid", "left")
    dated = F.col("params.date_from").isNotNull() | F.col("params.date_to").isNotNull()
    no_time, no_region = F.col("temporal").isNull(), F.col("params.region").isNotNull() & F.col("region_column").isNull()
    return joined.select(
        "qid",
        F.array_compact(F.array(
            F.when(dated & (no_time | F.col("observed_from").isNull()), F.lit("date")), F.when(no_region, F.lit("region")),
            F.when(F.col("params.group_by").isNotNull() & F.col("dimension").isNull(), F.lit("group_by")))).alias("unbound"),
        F.array_compact(F.array(
            F.when(dated & no_time, F.lit("this dataset is not broken down by time")),
            F.when(no_region & F.col("dimension").isNull(), F.lit("this dataset is not broken down by region")))).alias("notes"),
        "region_column")


# --- answers --------------------------------------------------------------------


def _say(el: Column, greek, english) -> Column:
    return F.when(el, greek if isinstance(greek, Column) else F.lit(greek)).otherwise(english if isinstance(english, Column) else F.lit(english))


def caveats(language: Column) -> Column:
    """Limits of an answer, most important first.

    Reads the columns of a fact header plus overlap, notes and unbound.
    """
    el = language == "el"
    ranged = F.col("observed_from").isNotNull()
    start, end = F.col("observed_from").cast("string"), F.col("observed_to").cast("string")
    partial = ~F.col("complete")
    omitted = F.col("omitted").cast("string")
    listed = F.array(
        F.when(F.col("categorical_truncation"), _say(
            el, "Τα δεδομένα κόπηκαν στη μέση: ολόκληρες κατηγορίες μπορεί να λείπουν.",
            "The data was cut short: whole categories may be missing entirely."))
        .when(partial & ranged, _say(
            el, F.format_string("Τα δεδομένα που ανακτήθηκαν καλύπτουν μόνο %s έως %s.", start, end),
            F.format_string("The retrieved data covers only %s to %s.", start, end)))
        .when(partial, _say(el, "Ανακτήθηκε μέρος μόνο των δεδομένων.", "Only part of the data was retrieved.")),
        F.when(F.col("measure_role").isin("running_cumulative", "index"), _say(
            el, "Η στήλη είναι αθροιστική ή δείκτης, οπότε δεν αθροίζεται.",
            "The column is cumulative or an index, so it is not summed.")),
        F.when((F.col("overlap") == "partial") & ranged, _say(
            el, F.format_string("Η ζητούμενη περίοδος καλύπτεται μόνο εν μέρει (%s–%s).", start, end),
            F.format_string("The requested period is only partly covered (%s–%s).", start, end))),
        F.when(~F.col("header_trusted"), _say(
            el, "Οι επικεφαλίδες του αρχείου δεν είναι αξιόπιστες· τα ονόματα στηλών δεν ερμηνεύονται.",
            "The file's headers are unreliable, so column names are not interpreted.")),
        F.when(F.col("merged_spellings") > 0, _say(
            el, "Παραλλαγές γραφής της ίδιας κατηγορίας ενοποιήθηκαν.", "Spelling variants of the same category were merged.")),
        F.when(F.col("omitted") > 0, _say(
            el, F.format_string("Εμφανίζονται οι μεγαλύτερες κατηγορίες· άλλες %s ομαδοποιήθηκαν.", omitted),
            F.format_string("The largest categories are shown; %s others were grouped.", omitted))),
    )
    filters = F.transform("unbound", lambda u: _say(
        el, F.format_string("Το φίλτρο «%s» δεν μπόρεσε να εφαρμοστεί σε αυτό το σύνολο δεδομένων.", u),
        F.format_string("The '%s' filter could not be applied to this dataset.", u)))
    return F.concat(F.array_compact(listed), F.col("notes"), filters)


def access_reason(error_kind: Column, language: Column) -> Column:
    el = language == "el"
    return (
        F.when(error_kind == "unavailable", _say(
            el, "Ο διακομιστής του φορέα δεν απάντησε, οπότε τα δεδομένα δεν ανακτήθηκαν.",
            "The publisher's server did not respond, so the data could not be retrieved."))
        .when(error_kind == "malformed", _say(
            el, "Το αρχείο δεν είχε τη μορφή που δηλώνει ο κατάλογος, οπότε δεν διαβάστηκε.",
            "The file was not the format the catalogue declares, so it was not read."))
        .when(error_kind == "unsupported", _say(
            el, "Ο πόρος είναι σε μορφή που δεν υποστηρίζεται ακόμη.", "The resource is in a format that is not supported yet."))
        .when(error_kind.isNotNull(), _say(el, "Τα δεδομένα δεν ανακτήθηκαν.", "The data could not be retrieved."))
    )


def plan_refusal(language: Column) -> Column:
    """Why a plan gives no answer; reads status, dataset_title, publisher, formats, near_misses."""
    el = language == "el"
    title = F.coalesce(F.nullif("dataset_title", F.lit("")), F.lit("—"))
    publisher = F.coalesce(F.nullif("publisher", F.lit("")), _say(el, "άγνωστος φορέας", "unknown publisher"))
    formats = F.coalesce(F.nullif(F.array_join("formats", ", "), F.lit("")), F.lit("—"))
    closest = F.nullif(F.array_join(F.slice(F.coalesce("near_misses", F.array().cast("array<string>")), 1, 3), ", "), F.lit(""))
    none = _say(el, "Κανένα σύνολο δεδομένων του καταλόγου δεν καλύπτει αυτό το ερώτημα.", "No dataset in the catalogue covers this question.")
    near = F.coalesce(_say(el, F.concat(F.lit(" Πλησιέστερα, χωρίς να ταιριάζουν: "), closest, F.lit(".")),
                           F.concat(F.lit(" Closest, though not a match: "), closest, F.lit("."))), F.lit(""))
    return F.when(F.col("status") == "unsupported", _say(
        el,
        F.format_string("Το σύνολο δεδομένων «%s» (%s) υπάρχει, αλλά ο κατάλογος δεν δημοσιεύει CSV ή JSON γι' αυτό — διαθέσιμες μορφές: %s.", title, publisher, formats),
        F.format_string("The dataset '%s' (%s) exists, but the catalogue lists no CSV or JSON for it — formats listed: %s.", title, publisher, formats),
    )).when(F.col("status") == "no_match", F.concat(none, near))


def row_coverage(rows: Column, complete: Column, upstream_total: Column, language: Column) -> Column:
    el = language == "el"
    shown = numbers.format_number(rows, language)
    total = numbers.format_number(upstream_total, language)
    share = F.bround(F.lit(100) * rows / upstream_total).cast("long").cast("string")
    return (
        F.when(complete, _say(el, F.format_string("όλες οι %s γραμμές", shown), F.format_string("all %s rows", shown)))
        .when(upstream_total > 0, _say(
            el, F.format_string("%s από %s γραμμές (%s%%)", shown, total, share), F.format_string("%s of %s rows (%s%%)", shown, total, share)))
        .otherwise(_say(el, F.format_string("%s γραμμές· το πλήρες μέγεθος δεν είναι γνωστό", shown),
                        F.format_string("%s rows; the full size is not known", shown)))
    )


def footer(language: Column, today: Column, base_url: str) -> Column:
    """Provenance of an answer, with explicit words for what is not recorded.

    Reads dataset_title, publisher, last_updated, dataset_id, source_url,
    row_count, complete and upstream_total.
    """
    el = language == "el"

    def known(column: str, greek: str, english: str) -> Column:
        return F.coalesce(F.nullif(strip(F.col(column)), F.lit("")), _say(el, greek, english))

    days = dates.age_days(F.col("last_updated"), today)
    return F.struct(
        known("dataset_title", "χωρίς τίτλο στον κατάλογο", "untitled in the catalogue").alias("dataset_title"),
        known("publisher", "ο φορέας δεν καταγράφεται στον κατάλογο", "publisher not recorded in the catalogue").alias("publisher"),
        known("last_updated", "άγνωστη ημερομηνία ενημέρωσης", "update date unknown").alias("last_updated"),
        web.dataset_link(base_url, F.col("dataset_id")).alias("dataset_url"), web.redact_secrets(F.col("source_url")).alias("source_url"),
        row_coverage(F.col("row_count"), F.col("complete"), F.col("upstream_total"), language).alias("row_coverage"),
        dates.staleness_text(days, language).alias("staleness"), dates.staleness_step(days).alias("staleness_step"))


def answer_rows(plans: DataFrame, headers: DataFrame, unbound: DataFrame, errors: DataFrame, context: DataFrame) -> DataFrame:
    """Status and reason of every question's answer.

    ``plans`` as made above - ``headers``: fact headers with rid as resource id -
    ``errors``: resource_id, error_kind - ``context``: qid, publisher, formats,
    near_misses.
    """
    language = output_language(F.col("language"))
    empty = F.array().cast("array<string>")
    joined = plans.join(headers.withColumnRenamed("rid", "resource_id").drop("title", "unit"), "resource_id", "left").join(
        unbound, "qid", "left").join(errors, "resource_id", "left").join(context, "qid", "left")
    joined = joined.withColumns({
        "answer_language": language,
        "unbound": F.coalesce("unbound", empty), "notes": F.coalesce("notes", empty),
        "overlap": dates.range_overlap(
            F.col("observed_from").cast("string"), F.col("observed_to").cast("string"), F.col("params.date_from"), F.col("params.date_to")),
    })
    el = F.col("answer_language") == "el"
    start, end = F.col("observed_from").cast("string"), F.col("observed_to").cast("string")
    refused = F.coalesce(
        access_reason(F.col("error_kind"), F.col("answer_language")),
        plan_refusal(F.col("answer_language")),
        F.when(F.col("overlap") == "none", _say(
            el, F.format_string("τα δεδομένα καλύπτουν %s έως %s· δεν καλύπτουν την περίοδο που ζητήθηκε", start, end),
            F.format_string("the data covers %s to %s; it does not cover the period requested", start, end))),
        F.when(~F.coalesce("has_facts", F.lit(False)), _say(
            el, "δεν υπάρχουν γραμμές που να ταιριάζουν με το ερώτημα", "no rows match the question")),
    )
    answered = joined.withColumn("refusal_reason", refused).withColumn(
        "caveats", F.when(F.col("refusal_reason").isNull(), caveats(F.col("answer_language"))).otherwise(empty))
    limited = (
        (F.size("caveats") > 0) | ~F.col("complete") | ~F.col("header_trusted") | (F.size("unbound") > 0)
        | F.col("truncated_range") | F.col("categorical_truncation")
    )
    status = F.when(F.col("refusal_reason").isNotNull(), F.lit("refused")).when(
        (F.col("operation") == "listing") | limited, F.lit("partial")).otherwise(F.lit("answered"))
    return answered.withColumn("answer_status", status).withColumn(
        "refusal_shape", refusal_shape(F.col("answer_status"), F.col("status"))).withColumn("limitation", F.get("caveats", F.lit(0)))


def top_figures(facts: DataFrame, key: str = "rid", n: int = 3) -> DataFrame:
    """First facts of an answer in order: key, figures array."""
    return facts.filter(F.col("pos") <= n).groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("pos", "label", "value", "unit", "basis"))).alias("figures"))


def answer_text(language: Column) -> Column:
    """The answer in plain sentences; reads a fact header, figures, footer and limitation."""
    el = language == "el"
    lead = F.get("figures", F.lit(0))
    unit = F.coalesce(F.concat(F.lit(" "), lead["unit"]), F.lit(""))
    value = numbers.format_number(lead["value"], language)
    shown = F.array_join(F.transform("figures", lambda f: F.concat(f["label"], F.lit(": "), numbers.format_number(f["value"], language))), ", ")
    basis = F.col("row_basis").cast("string")
    body = (
        F.when(F.coalesce(F.size("figures"), F.lit(0)) <= 0, _say(
            el, "Βρέθηκαν δεδομένα αλλά δεν προκύπτει από αυτά συγκεκριμένο μέγεθος.", "Data was found, but no specific figure follows from it."))
        .when(F.col("operation") == "latest", _say(
            el, F.concat(F.lit("Σύμφωνα με τα δεδομένα, «"), lead["label"], F.lit("»: "), value, unit, F.lit(" ("), lead["basis"], F.lit(").")),
            F.concat(F.lit("According to the data, '"), lead["label"], F.lit("': "), value, unit, F.lit(" ("), lead["basis"], F.lit(")."))))
        .when(F.col("operation").isin("sum", "count"), _say(
            el, F.format_string("Με βάση %s γραμμές, οι μεγαλύτερες κατηγορίες είναι — %s.", basis, shown),
            F.format_string("Across %s rows, the largest categories are — %s.", basis, shown)))
        .otherwise(_say(
            el, F.format_string("Η σειρά «%s» καταγράφεται όπως δημοσιεύτηκε, χωρίς υπολογισμό.", F.col("measure")),
            F.format_string("The series '%s' is reported as published, without computation.", F.col("measure"))))
    )
    total = numbers.format_number(F.col("stated_total"), language)
    stated = F.when(F.col("total_confirmed"), _say(
        el, F.concat(F.lit(" Ο φορέας δημοσιεύει και συνολικό μέγεθος: "), total, F.lit(".")),
        F.concat(F.lit(" The source also publishes a total of its own: "), total, F.lit("."))))
    f = F.col("footer")
    source = _say(
        el, F.concat(F.lit("Πηγή: "), f["dataset_title"], F.lit(" — "), f["publisher"], F.lit(". Κάλυψη: "), f["row_coverage"], F.lit(". "), f["staleness"], F.lit(".")),
        F.concat(F.lit("Source: "), f["dataset_title"], F.lit(" — "), f["publisher"], F.lit(". Coverage: "), f["row_coverage"], F.lit(". "), f["staleness"], F.lit(".")))
    return F.concat_ws(" ", F.concat(body, F.coalesce(stated, F.lit(""))), F.col("limitation"), source)


def fill_placeholders(draft: Column, values: Column) -> Column:
    """Put labels and figures into a draft: every key of the map is replaced."""
    return F.aggregate(F.map_entries(values), draft, lambda text, e: F.replace(text, e["key"], e["value"]))


PUBLIC = ("qid", "question", "answer_language", "answer_status", "refusal_shape", "refusal_reason", "caveats", "text", "footer")


def public_view(answers: DataFrame) -> DataFrame:
    """Only the fields meant to be published: no plans and no scores."""
    return answers.select(*[c for c in PUBLIC if c in answers.columns])


# --- chart series ---------------------------------------------------------------


def chart_kind(operation: Column, n_series: Column, temporal: Column) -> Column:
    """A line needs a proven time axis; anything aggregated is bars."""
    several = n_series > 1
    bars = F.when(several, F.lit("grouped_bar")).otherwise(F.lit("bar"))
    return F.when((operation == "none") & temporal, F.lit("line")).otherwise(bars)


def looks_temporal(first_dim: Column) -> Column:
    return first_dim.rlike("^[0-9]{4}-..")


def chart_series(points: DataFrame, headers: DataFrame, max_points: int = vocab.MAX_CHART_POINTS) -> DataFrame:
    """Chart-ready points: kind, series, pos, dim, value, ``too_many`` and the shortened ``series_label``.

    ``points``: rid, series, dim, value, pos, and ``key`` where two categories may
    show the same ``dim`` - ``headers``: rid, operation, complete, temporal (flag),
    categorical_truncation.  A table with fewer than two points, a listing, or
    categories cut away has no chart.  Bars get a null cell for every category a
    series lacks; a table of over ``max_points`` points is marked and keeps to the points it has.
    """
    points = points.withColumn("key", points["key"] if "key" in points.columns else points["dim"])
    sizes = points.groupBy("rid").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("series").alias("n_series"))
    fit = (
        sizes.filter(F.col("_n") >= 2)
        .join(headers.filter((F.col("operation") != "listing") & ~F.col("categorical_truncation")), "rid")
        .select("rid", "complete", (F.col("_n") > max_points).alias("too_many"), chart_kind(F.col("operation"), F.col("n_series"), F.col("temporal")).alias("kind"))
    )
    shown = points.join(fit, "rid").withColumn("value", F.col("value").cast("double"))
    lines = shown.filter("kind = 'line'").withColumn("pos", F.row_number().over(W.partitionBy("rid", "series").orderBy("dim")) - 1)
    bars = shown.filter("kind <> 'line'")
    categories = bars.groupBy("rid", "kind", "too_many", "key", "dim").agg(
        F.sum("value").alias("total"), F.min("pos").alias("first"), F.max("complete").alias("complete"))
    ranked = categories.select("rid", "kind", "too_many", "key", "dim", (F.row_number().over(W.partitionBy("rid").orderBy(
        F.when(F.col("complete"), -F.col("total")), F.when(F.col("complete"), F.col("dim")), "first", "dim")) - 1).alias("bar"))
    names = bars.filter("not too_many").select("rid", "series").distinct()
    grid = ranked.join(names, "rid").select("rid", "series", "key").unionByName(bars.filter("too_many").select("rid", "series", "key"))
    filled = grid.join(ranked, ["rid", "key"]).join(bars.select("rid", "series", "key", "value"), ["rid", "series", "key"], "left").withColumnRenamed("bar", "pos")
    told = ["rid", "kind", "series", "pos", "dim", "value", "too_many"]
    return lines.select(*told).unionByName(filled.select(*told)).withColumn("series_label", safe_label(F.col("series"), vocab.MAX_SERIES_LABEL_CHARS))

"""Reports over runs: envelopes, totals, validation of a corpus, summaries of changes, views and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tindra.operators.evidence import STATES


def terminal_state(status: Column, module: Column, publishable: Column) -> Column:
    """The state that a module ends in: its published state, but an available website that is not the company's own is ambiguous; null is failed."""
    return F.when((status == "available") & (module == "website") & ~F.coalesce(publishable, F.lit(True)), "ambiguous").otherwise(F.coalesce(status, F.lit("failed")))


def envelopes(companies: DataFrame, modules: DataFrame, activities: dict[str, tuple[DataFrame, str, list[Column]]], key: str = "organisation_number", latest: int = 5) -> DataFrame:
    """(key, state, modules, <name>_count, <name>_latest...): one row of each company.

    ``modules`` has key, module and state, one row each.  The company's state is failed
    where its registry module is failed or missing, not_available where that is, else
    available.  ``activities`` names a frame, its id column and its order, of which the
    first ``latest`` ids are listed.
    """
    per = modules.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "module", "state"))), ",").alias("modules"),  # a row for each of the few modules
        F.max(F.when(F.col("module") == "registry", F.col("state"))).alias("_registry"),
    )
    state = F.when(F.coalesce("_registry", F.lit("failed")) == "failed", "failed").when(F.col("_registry") == "not_available", "not_available").otherwise("available")
    rows = companies.select(key).distinct().join(per, key, "left").select(key, state.alias("state"), F.coalesce("modules", F.lit("")).alias("modules"))
    for name, (df, item, order) in activities.items():
        counts = df.groupBy(key).agg(F.count("*").alias(f"{name}_count"))
        first = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= latest)
        listed = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.col(item).cast("string").alias("i")))), lambda x: x["i"]), ",").alias(f"{name}_latest"))
        rows = rows.join(counts, key, "left").join(listed, key, "left").na.fill(0, [f"{name}_count"]).na.fill("", [f"{name}_latest"])
    return rows


def envelope_checks(rows: DataFrame, expected: DataFrame, key: str = "organisation_number") -> DataFrame:
    """One row: envelopes, expected ones, whether each company has one and each state is a published one, and the checks together."""
    counts = rows.agg(F.count("*").alias("envelopes"), F.countDistinct(key).alias("companies"), F.count_if(~F.col("state").isin(*STATES)).alias("unknown_states"))
    wanted = expected.agg(F.countDistinct(key).alias("expected"))
    both = counts.crossJoin(F.broadcast(wanted))  # one row each
    return both.withColumn("passed", (F.col("envelopes") == F.col("expected")) & (F.col("companies") == F.col("envelopes")) & (F.col("unknown_states") == 0))


def operations(fetches: DataFrame, *by: str) -> DataFrame:
    """(by..., requests, received, elapsed, errors): totals of a log of fetches."""
    return fetches.groupBy(*by).agg(F.count("*").alias("requests"), F.sum(F.coalesce("bytes_received", F.lit(0))).cast("bigint").alias("received"), F.sum(F.coalesce("elapsed_ms", F.lit(0))).cast("bigint").alias("elapsed"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def run_report(rows: DataFrame, modules: DataFrame, fetches: DataFrame) -> DataFrame:
    """(section, name, n): companies by state, modules by state, and totals of the fetches, as one long table."""
    parts = [
        rows.groupBy(F.col("state").alias("name")).agg(F.count("*").alias("n")).select(F.lit("companies").alias("section"), "name", "n"),
        modules.groupBy(F.concat_ws(".", "module", "state").alias("name")).agg(F.count("*").alias("n")).select(F.lit("modules").alias("section"), "name", "n"),
        operations(fetches).select(F.explode(F.create_map(*(x for c in ("requests", "received", "elapsed", "errors") for x in (F.lit(c), F.col(c))))).alias("name", "n")).select(F.lit("fetches").alias("section"), "name", "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


def order_mismatches(frames: list[tuple[str, DataFrame]], ordinal: str, key: str) -> DataFrame:
    """(ordinal, <name>...): the places at which lists in order do not hold the same key; a list that ends early has null there."""
    parts = [df.select(ordinal, F.lit(name).alias("_l"), F.col(key).cast("string").alias("_k")) for name, df in frames]
    wide = reduce(DataFrame.unionByName, parts).groupBy(ordinal).agg(*(F.max(F.when(F.col("_l") == name, F.col("_k"))).alias(name) for name, _ in frames))
    first = frames[0][0]
    differ = reduce(lambda a, b: a | b, (~F.col(first).eqNullSafe(F.col(name)) for name, _ in frames[1:]))
    return wide.where(differ)


def history_summary(changes: DataFrame, *by: str) -> DataFrame:
    """(by..., change_type, n) of change events."""
    return changes.groupBy(*by, "change_type").agg(F.count("*").alias("n"))


def change_notes(changes: DataFrame, key: str = "organisation_number") -> DataFrame:
    """(key, changes, notes, provenance): of each company its field changes in words, in the order of the fields, and whether all have a hash.

    ``changes`` has field, old_value, new_value and content_sha256; at most one row of a field.
    """
    said = lambda prefix: F.concat_ws(" ", F.lit(prefix), F.coalesce("old_value", F.lit("nothing")), F.lit("->"), F.coalesce("new_value", F.lit("nothing")))
    f = F.col("field")
    note = F.when(f.contains("employees"), said("employees:")).when(f.contains("financials"), "new annual accounts").when(f.contains("roles"), "roles changed").when(f.contains("website"), said("website:")).otherwise(F.concat(f, F.lit(" changed")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("field", note.alias("note")))), lambda x: x["note"])
    return changes.groupBy(key).agg(F.count("*").alias("changes"), F.array_join(listed, "; ").alias("notes"), F.every(F.col("content_sha256").isNotNull()).alias("provenance"))


def facts_and_states(facts: DataFrame, states: DataFrame) -> DataFrame:
    """Facts, and under them the states of the modules that are not available, as one table for export."""
    return facts.unionByName(states.where("state <> 'available'").select("organisation_number", "module", F.lit("state").alias("claim"), F.col("state").alias("value")), allowMissingColumns=True)


#: Names of the filters of a list of companies.
VIEW_FILTERS = ("all", "website", "news", "jobs", "ambiguous", "failed", "none")


def view_filter(name: str) -> Column:
    """A filter of the rows of ``company_views``."""
    nothing = ~F.col("has_website") & (F.col("news") == 0) & (F.col("jobs") == 0)
    return {"all": F.lit(True), "website": F.col("has_website"), "news": F.col("news") > 0, "jobs": F.col("jobs") > 0, "ambiguous": F.col("ambiguous") > 0, "failed": F.col("failed") > 0, "none": nothing}[name]


def company_views(companies: DataFrame, modules: DataFrame, news: DataFrame, jobs: DataFrame, key: str = "organisation_number") -> DataFrame:
    """(key, name, municipality, has_website, ambiguous, failed, news, jobs): what a list of companies shows."""
    states = modules.groupBy(key).agg(F.coalesce(F.bool_or((F.col("module") == "website") & (F.col("state") == "available")), F.lit(False)).alias("has_website"), F.count_if(F.col("state") == "ambiguous").alias("ambiguous"), F.count_if(F.col("state") == "failed").alias("failed"))
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    rows = companies.select(key, "name", "municipality").join(states, key, "left").join(count(news, "news"), key, "left").join(count(jobs, "jobs"), key, "left")
    return rows.na.fill(0, ["ambiguous", "failed", "news", "jobs"]).na.fill(False, ["has_website"])


def found_in(df: DataFrame, words: str, *columns: str) -> DataFrame:
    """The rows that hold the words in one of their columns, letter case ignored; no words, all rows."""
    text = F.lower(F.concat_ws(" ", *columns))
    return df if not words.strip() else df.where(F.contains(text, F.lit(words.strip().lower())))


def suite_scores(cases: list[tuple[str, DataFrame, DataFrame]], key: str) -> DataFrame:
    """(case, expected, found, both, right): of each case what its screen found against what was expected; right where they are the same."""
    tagged = [df.select(F.lit(name).alias("case"), F.col(key).alias("_k")).distinct().withColumn("_side", F.lit(side)) for name, found, wanted in cases for side, df in ((1, found), (2, wanted))]
    keys = reduce(DataFrame.unionByName, tagged).groupBy("case", "_k").agg(F.sum("_side").alias("s"))
    counts = keys.groupBy("case").agg(F.count_if(F.col("s") >= 2).alias("expected"), F.count_if(F.col("s") != 2).alias("found"), F.count_if(F.col("s") == 3).alias("both"))
    names = keys.sparkSession.createDataFrame([(name,) for name, _, _ in cases], "case string")
    return names.join(counts, "case", "left").na.fill(0).withColumn("right", (F.col("expected") == F.col("both")) & (F.col("found") == F.col("both")))


def against_truth(rows: DataFrame, profiles: DataFrame, truth: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, state, <field>_agrees...): from the truth's side, each company's envelope and whether its profile says the same, letter case ignored; null where one side says nothing."""
    said = profiles.select(key, *(F.col(f).cast("string").alias(f"_s_{f}") for f in fields)).dropDuplicates([key])
    joined = truth.select(key, *(F.col(f).cast("string").alias(f) for f in fields)).dropDuplicates([key]).join(rows.select(key, "state"), key, "left").join(said, key, "left")
    blank = lambda c: F.when(F.trim(c) != "", F.lower(F.trim(c)))
    return joined.select(key, F.coalesce("state", F.lit("missing")).alias("state"), *((blank(F.col(f)) == blank(F.col(f"_s_{f}"))).alias(f"{f}_agrees") for f in fields))


def shown_number(c: Column) -> Column:
    """A whole number with commas between thousands; null as a dash."""
    return F.coalesce(F.format_number(c, 0), F.lit("–"))


def summaries(companies: DataFrame, trends: DataFrame, key: str = "organisation_number") -> DataFrame:
    """(key, summary): one sentence of each company on its revenue, the change of that, and its employees, leaving out what is not known.

    ``companies`` has name and employees; ``trends`` as from ``history.trend`` with the
    columns year, revenue and change_pct.
    """
    rows = companies.join(trends, key, "left")
    sign = F.when(F.col("change_pct") >= 0, "up ").otherwise("down ")
    change = F.when(F.col("change_pct").isNotNull(), F.concat(F.lit(" ("), sign, F.format_string("%.1f", F.abs(F.col("change_pct").cast("double"))), F.lit(" %)")))
    money = F.when(F.col("revenue").isNotNull(), F.concat(F.lit("revenue of NOK "), shown_number(F.col("revenue")), F.lit(" in "), F.col("year").cast("string"), F.coalesce(change, F.lit(""))))
    staff = F.when(F.col("employees").isNotNull(), F.concat(F.col("employees").cast("string"), F.lit(" registered employees")))
    known = F.concat_ws(" and ", money, staff)
    return rows.select(key, F.concat(F.coalesce("name", F.lit("The company")), F.lit(": "), F.when(known != "", known).otherwise("nothing known"), F.lit(".")).alias("summary"))


def what_changed(events: list[tuple[str, DataFrame]], key: str, as_of: Column, n: int = 20) -> DataFrame:
    """(key, day, type, title, source_url, place): the newest ``n`` dated events of each company that are not after ``as_of``.

    Each frame has key, day (YYYY-MM-DD), title and source_url; the type is named with it.
    """
    rows = reduce(DataFrame.unionByName, [df.select(key, "day", F.lit(name).alias("type"), "title", "source_url") for name, df in events])
    dated = rows.where(F.col("day").isNotNull() & (F.col("day") <= as_of) & F.col(key).isNotNull()).distinct()
    w = Window.partitionBy(key).orderBy(F.desc("day"), "type", "title", "source_url")
    return dated.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)

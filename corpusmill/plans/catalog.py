"""The slot schema, templates and a rule-made table of domains.

The slot schema is this package's own. Tables of domains are parameters of the
plans; domains() makes a synthetic one of any length by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (slot, value type, required, description, standard question), in the order in which they are asked.
SLOTS = (
    ("intent", "enum", True, "whether a forecast is wanted", "Would you like to create a time-series forecast?"),
    ("target_column", "string", True, "column to forecast", "Which column should be forecast?"),
    ("time_column", "string", True, "column with timestamps", "Which column holds the timestamps?"),
    ("frequency", "duration", True, "spacing of observations", "How often are observations recorded?"),
    ("forecast_horizon", "duration", True, "how far ahead to forecast", "How far ahead should the forecast reach?"),
    ("problem_statement", "string", True, "problem to solve", "Which problem should the forecast solve?"),
    ("source_mode", "enum", True, "way the data is provided", "How will the data be provided?"),
    ("target_description", "string", True, "meaning of the target", "What does the target represent?"),
    ("dataset_type", "enum", True, "one series or several", "Is there one series or are there several?"),
    ("business_goal", "string", True, "decision that is supported", "Which decision does the forecast support?"),
    ("source_reference", "string", True, "file or table with the data", "Where is the data?"),
    ("target_unit", "string", True, "unit of the target", "What unit is the target measured in?"),
    ("forecast_type", "enum", True, "point or probabilistic", "Should the forecast be point or probabilistic?"),
    ("output_granularity", "duration", True, "spacing of the results", "At which granularity are results needed?"),
    ("primary_metric", "enum", True, "metric to judge by", "Which metric should judge the forecast?"),
    ("success_criteria", "string", True, "what counts as success", "What result counts as success?"),
    ("file_format", "enum", False, "format of the file", "Which format does the file have?"),
    ("contains_sensitive_data", "boolean", False, "whether data is sensitive", "Does the data contain sensitive information?"),
    ("series_id_columns", "list", False, "columns that identify a series", "Which columns identify each series?"),
    ("prediction_interval_levels", "list", False, "levels of intervals", "Which interval levels are needed?"),
    ("known_future_covariates", "list", False, "covariates known ahead", "Which covariates are known ahead?"),
    ("covariate_availability", "list", False, "when covariates are known", "When will each covariate be available?"),
    ("privacy_constraints", "list", False, "restrictions on the data", "Which privacy restrictions apply?"),
    ("baseline_model", "string", False, "model to compare with", "Which model should be the baseline?"),
    ("authentication_reference", "string", False, "where credentials are kept", "Where are the credentials kept?"),
)
REQUIRED = tuple(s[0] for s in SLOTS if s[2])
MAX_DEFINITIONS = 24
INTENT_QUESTION = SLOTS[0][4]

#: Answers that give no value, in the order in which they rotate. Fixed values.
NON_ANSWERS = ("I don't know yet.", "Not sure.", "Can we decide that later?")
#: Answers in a sentence. Fixed values.
SENTENCES = {
    "intent": "Yes, I want to create a time-series forecast.",
    "problem_statement": "The forecasting problem is {value}.",
    "business_goal": "It will support {value}.",
    "success_criteria": "Success means {value}.",
    "target_column": "The target column is {value}.",
    "target_description": "The target represents {value}.",
    "target_unit": "It is measured in {value}.",
    "time_column": "The time column is {value}.",
    "frequency": "The observations arrive every {value}.",
    "forecast_horizon": "Forecast the next {value}.",
    "dataset_type": "The dataset type is {value}.",
    "source_mode": "The data will be provided by {value}.",
    "source_reference": "Use {value}.",
    "file_format": "The file format is {value}.",
    "forecast_type": "Use a {value} forecast.",
    "output_granularity": "Return results every {value}.",
    "primary_metric": "Use {value} as the primary metric.",
    "contains_sensitive_data": "The data contains sensitive information: {value}.",
    "privacy_constraints": "The restrictions are {value}.",
    "series_id_columns": "The series identifiers are {value}.",
    "covariate_availability": "The covariates will be available {value}.",
}
SENTENCE = "The answer is {value}."
#: Answers in Roman Urdu. Fixed values.
ROMAN_URDU = {
    "intent": "Haan, mujhe time-series forecast chahiye.",
    "problem_statement": "Mujhe {value} forecast karna hai.",
    "business_goal": "Yeh {value} ke liye hai.",
    "success_criteria": "Kamyabi ka matlab {value} hai.",
    "target_column": "Target column {value} hai.",
    "target_description": "Yeh {value} represent karta hai.",
    "target_unit": "Iski unit {value} hai.",
    "time_column": "Time column {value} hai.",
    "frequency": "Yeh har {value} observe hota hai.",
    "forecast_horizon": "Agle {value} ke liye forecast karo.",
    "dataset_type": "Dataset type {value} hai.",
    "source_mode": "Data {value} se aayega.",
    "source_reference": "{value} use karo.",
    "file_format": "File format {value} hai.",
    "forecast_type": "{value} forecast chahiye.",
    "output_granularity": "Result har {value} chahiye.",
    "primary_metric": "Primary metric {value} honi chahiye.",
}
ROMAN_URDU_ANY = "Jawab {value} hai."
#: Answers that give a related slot as well: the template and that slot. Fixed values.
MULTI = {
    "target_column": ("The target column is {value}, which represents {target_description}.", "target_description"),
    "target_description": ("We measure {target_description} in {unit}.", "target_unit"),
    "target_unit": ("{target_column} is measured in {value}.", "target_column"),
    "time_column": ("Use {value} as the timestamp; observations are {frequency}.", "frequency"),
    "frequency": ("Data is {value} and we need the next {horizon}.", "forecast_horizon"),
    "forecast_horizon": ("Forecast {value} ahead; the data is {frequency}.", "frequency"),
    "source_mode": ("We'll {value} the file {source}.", "source_reference"),
    "source_reference": ("Use {value}; it is a CSV upload.", "file_format"),
    "file_format": ("The file {source} is in {value} format.", "source_reference"),
    "forecast_type": ("Use a {value} forecast at {frequency} granularity.", None),
    "output_granularity": ("Return forecasts every {value}, matching the input frequency.", None),
    "primary_metric": ("Judge the forecast with {value} as the main metric.", None),
    "business_goal": ("The goal is {value}; success means {success_criteria}.", "success_criteria"),
    "success_criteria": ("We need {value} to support {business_goal}.", "business_goal"),
    "problem_statement": ("We need to forecast {target_description} from {source}.", None),
}
#: Messages that fill several slots. Fixed values.
CLUSTERS = (
    ("source", ("source_mode", "source_reference", "file_format"), "We will {source_mode} the data in {source_reference}, which is a {file_format} file."),
    ("target", ("target_column", "target_description", "target_unit"), "The target is {target_column}, representing {target_description}, measured in {target_unit}."),
    ("time", ("time_column", "frequency", "forecast_horizon"), "Use {time_column} as the timestamp. The series is {frequency} and we need a forecast for the next {forecast_horizon}."),
    ("output", ("forecast_type", "output_granularity", "primary_metric"), "Produce a {forecast_type} forecast at {output_granularity} granularity, judged by {primary_metric}."),
    ("business", ("business_goal", "success_criteria"), "The forecast supports {business_goal}. Success means {success_criteria}."),
)

DOMAIN = "domain_index int, slug string, target_column string, target_description string, unit string, time_column string, frequency string, frequency_unit string, horizon string, horizon_periods int, source string, business_goal string, success_criteria string, primary_metric string"
_PERIODS = (("daily", "day"), ("weekly", "week"), ("monthly", "month"), ("quarterly", "quarter"))


def domains(spark: SparkSession, n: int = 20) -> DataFrame:
    """n synthetic domains by rule."""
    rows = []
    for i in range(n):
        frequency, unit = _PERIODS[i % 4]
        periods = 4 + 3 * (i % 7)
        rows.append((i, f"series_{i:02d}", f"value_{i:02d}", f"demand of region {i:02d}", f"unit {i % 5}", f"{unit}_start", frequency, unit, f"{periods} {unit}s", periods, f"series_{i:02d}.csv", f"planning of depot {i % 9}", f"MAE below {5 + i} percent", "smape" if i % 8 == 7 else "mae"))
    return spark.createDataFrame(rows, DOMAIN)


def domains_of(rows: DataFrame, key: str, size: str, n: int = 33) -> DataFrame:
    """n domains that rows of a table make: a group by key modulo n, described by its number of rows and the sum of size, in one aggregate."""
    group = F.pmod(F.col(key), F.lit(n)).cast("int")
    counted = rows.where(F.col(key).isNotNull()).groupBy(group.alias("i")).agg(F.count("*").alias("c"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("t"))
    name, text = F.lpad(F.col("i").cast("string"), 2, "0"), lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    at = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in _PERIODS]), F.col("i") % 4 + 1)
    unit, periods = at(1), (4 + 3 * (F.col("t") % 7)).cast("int")
    made = {
        "domain_index": F.col("i"), "slug": text("series_", name), "target_column": text("value_", name, "_", F.col("c")), "target_description": text("demand of region ", name, "-", F.col("c")), "unit": text("unit ", F.col("t") % 5),
        "time_column": text(unit, "_start"), "frequency": at(0), "frequency_unit": unit, "horizon": text(periods, " ", unit, "s"), "horizon_periods": periods, "source": text("series_", name, ".csv"),
        "business_goal": text("planning of depot ", F.col("t") % 9), "success_criteria": text("MAE below ", 5 + F.col("c") % 40, " percent"), "primary_metric": F.when(F.col("t") % 8 == 7, "smape").otherwise("mae"),
    }
    return counted.select(*[c.alias(k) for k, c in made.items()])


def quoted(c: Column) -> Column:
    """A string as JSON text."""
    return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))


def duration_json(periods: Column, unit: Column) -> Column:
    return F.concat(F.lit('{"periods": '), periods.cast("string"), F.lit(', "unit": '), quoted(unit), F.lit("}"))


def gold(d=F.col) -> dict[str, Column]:
    """The value of each of 18 slots of a domain, as JSON text."""
    each = duration_json(F.lit(1), d("frequency_unit"))
    fixed = lambda s: F.lit(f'"{s}"')
    return {
        "intent": fixed("create_forecast"), "problem_statement": quoted(F.concat(F.lit("forecast "), d("target_description"))), "business_goal": quoted(d("business_goal")),
        "success_criteria": quoted(d("success_criteria")), "target_column": quoted(d("target_column")), "target_description": quoted(d("target_description")), "target_unit": quoted(d("unit")),
        "time_column": quoted(d("time_column")), "frequency": each, "forecast_horizon": duration_json(d("horizon_periods"), d("frequency_unit")), "dataset_type": fixed("single_series"),
        "source_mode": fixed("upload"), "source_reference": quoted(d("source")), "file_format": fixed("csv"), "forecast_type": fixed("point"), "output_granularity": each,
        "primary_metric": quoted(d("primary_metric")), "contains_sensitive_data": F.lit("false"),
    }


def words() -> dict[str, Column]:
    """The value of each of 18 slots of a domain, as it is said."""
    c = F.col
    each = F.concat(F.lit("1 "), c("frequency_unit"))
    horizon = F.concat(c("horizon_periods").cast("string"), F.lit(" "), c("frequency_unit"), F.when(c("horizon_periods") != 1, "s").otherwise(""))
    return {
        "intent": F.lit("create_forecast"), "problem_statement": F.concat(F.lit("forecast "), c("target_description")), "business_goal": c("business_goal"), "success_criteria": c("success_criteria"),
        "target_column": c("target_column"), "target_description": c("target_description"), "target_unit": c("unit"), "time_column": c("time_column"), "frequency": each, "forecast_horizon": horizon,
        "dataset_type": F.lit("single_series"), "source_mode": F.lit("upload"), "source_reference": c("source"), "file_format": F.lit("csv"), "forecast_type": F.lit("point"), "output_granularity": each,
        "primary_metric": c("primary_metric"), "contains_sensitive_data": F.lit("no"),
    }

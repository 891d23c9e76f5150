"""Delimited files of reports: their checks, their records, and templates to fill in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns that a medical report file is expected to have, and words that tell one.
REPORT_FIELDS = [
    "patient_id", "full_name", "date_of_birth", "admission_date", "discharge_date", "sex", "service", "attending", "unit_no",
    "chief_complaint", "history_present_illness_hopi", "past_medical_history_pmh", "medications_admission", "medications_discharge",
    "brief_hospital_course", "pertinent_results", "social_history", "family_history", "discharge_diagnosis", "discharge_instructions",
    "follow_up_instructions", "full_report_text",
]
REPORT_WORDS = ["history", "hospital", "medication", "diagnosis", "complaint"]
LEAST_COLUMNS, LEAST_LENGTH, LEAST_WORDS, MOST_ERRORS = 25, 100, 3, 2


def delimited(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """A delimited file with a header, all columns as strings."""
    return spark.read.csv(path, header=True, sep=delimiter, multiLine=True, quote='"', escape='"', inferSchema=False)


def check_columns(spark: SparkSession, path: str, text_column: str, id_column: str | None = None, delimiter: str = ",") -> dict:
    """What a file's columns are, and which of the wanted ones it lacks. Only the header is read."""
    names = delimited(spark, path, delimiter).columns
    wanted = [("text_column", text_column), *([("id_column", id_column)] if id_column else [])]
    errors = [f"{kind} {name} isn't among {names}" for kind, name in wanted if name not in names]
    return {"is_valid": not errors, "delimiter": delimiter, "num_columns": len(names), "column_names": names, "validation_errors": errors}


def field_mapping(names: list[str], fields: list[str] | None = None) -> dict[str, str]:
    """For each field the column whose name holds it and little else; underscores, blanks and case don't count."""
    bare = lambda name: name.lower().replace("_", "").replace(" ", "")
    out = {}
    for field in fields or REPORT_FIELDS:
        fits = [(len(bare(field)) / len(bare(name)), -k, name) for k, name in enumerate(names) if bare(field) in bare(name)]
        if fits:
            out[field] = max(fits)[2]
    return out


def check_reports(spark: SparkSession, path: str, delimiter: str = "|") -> dict:
    """Whether a file looks like one of medical reports: enough columns, long last ones, telling names; more than two faults make it invalid.

    The length is the mean of all rows.
    """
    rows = delimited(spark, path, delimiter)
    names = rows.columns
    sample = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.length(F.coalesce(F.col(f"`{names[-1]}`"), F.lit("nan")))).alias("length")).first()
    if not sample["n"]:
        return {"is_valid": False, "error": "no rows", "delimiter": delimiter}
    faults = {
        "columns": len(names) < LEAST_COLUMNS,
        "length": sample["length"] < LEAST_LENGTH,
        "fields": sum(any(word in name.lower() for word in REPORT_WORDS) for name in names) < LEAST_WORDS,
    }
    errors = [name for name, found in faults.items() if found]
    return {"is_valid": len(errors) <= MOST_ERRORS, "delimiter": delimiter, "num_columns": len(names), "column_names": names, "field_mapping": field_mapping(names), "validation_errors": errors}


def read_reports(spark: SparkSession, path: str, delimiter: str = "|") -> DataFrame:
    """(patient_id, text, sections, metadata) of medical reports: fields by their likely columns, missing values empty.

    Sections are a map of the fields that have text; other columns are metadata.
    """
    rows = delimited(spark, path, delimiter)
    mapping = field_mapping(rows.columns)
    value = lambda name: F.coalesce(F.trim(F.col(f"`{name}`")), F.lit(""))

    def as_map(pairs: list[tuple[str, str]]) -> Column:
        entries = F.array(*[F.struct(F.lit(key), value(name)) for key, name in pairs]) if pairs else F.array().cast("array<struct<key:string,value:string>>")
        return F.map_filter(F.map_from_entries(entries), lambda _, v: v != "")

    text = value(mapping["full_report_text"]) if "full_report_text" in mapping else value(rows.columns[-1])
    key = value(mapping["patient_id"]) if "patient_id" in mapping else F.lit("")
    sections = [(field, name) for field, name in mapping.items() if field not in ("patient_id", "full_report_text")]
    rest = [(name, name) for name in rows.columns if name not in mapping.values()]
    return rows.select(key.alias("patient_id"), text.alias("text"), as_map(sections).alias("sections"), as_map(rest).alias("metadata"))


def write_template(spark: SparkSession, path: str, delimiter: str = "|", rows: list[dict[str, str]] | None = None) -> None:
    """A file with the expected columns and the given rows, missing fields empty."""
    values = [tuple(row.get(name, "") for name in REPORT_FIELDS) for row in rows or []]
    schema = ", ".join(f"`{name}` string" for name in REPORT_FIELDS)
    spark.createDataFrame(values, schema).coalesce(1).write.mode("overwrite").csv(path, sep=delimiter, header=True, quote='"', escape='"', emptyValue="")

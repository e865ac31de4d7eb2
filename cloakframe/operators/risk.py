"""Re-identification risk from combinations of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name, risk, fields that must be there, fields, note if all are there, note if only some are.
COMBINATIONS: list[tuple[str, str, int, tuple[str, ...], str, str]] = [
    ("ZIP + DOB + Gender", "high", 2, ("dob", "gender_indicator", "zip_us"), "the three together single out 87% of US residents (Sweeney 2000)", "two of ZIP, birth date and gender single out most US residents (Sweeney 2000)"),
    ("Postcode + DOB", "high", 2, ("dob", "postcode_uk"), "a UK postcode with a birth date singles out a person", ""),
    ("Name + Employer + City", "medium", 3, ("GPE", "ORG", "PERSON"), "name, employer and city single out a person in most cities", ""),
    ("Name + SSN", "high", 2, ("PERSON", "ssn"), "a name with its SSN allows identity theft", ""),
    ("Name + DOB", "high", 2, ("PERSON", "dob"), "name and birth date are what identity checks ask for", ""),
    ("Email + Location", "medium", 2, ("GPE", "email"), "an address for mail with a place narrows down to a named person", ""),
    ("Phone + Name", "high", 2, ("PERSON", "phone_us"), "a name with its phone number is a person", ""),
    ("Phone + Location", "medium", 2, ("GPE", "phone_us"), "a phone number with a place narrows down to a local person", ""),
    ("IP Address + Name", "high", 2, ("PERSON", "ip_address"), "a name with an IP address identifies a device", ""),
    ("DOB + Location + Employer", "medium", 3, ("GPE", "ORG", "dob"), "birth date, place and employer are rare together", ""),
]
#: Fields in the order in which they are shown, with their labels.
LABELS = dict(zip("PERSON email ssn phone_us ip_address zip_us postcode_uk dob gender_indicator ORG GPE".split(), "Name,Email,SSN,Phone,IP Address,ZIP,Postcode,DOB,Gender,Employer,Location".split(",")))
RISK = "array<struct<combination:string,matched_fields:array<string>,risk_level:string,all_fields_matched:boolean,reference:string>>"


def risks(types: Column) -> Column:
    """The combinations that an array of types meets, in the order of the table; fields in display order."""
    rank = {t: i for i, t in enumerate(LABELS)}
    found = []
    for name, level, least, fields, whole, part in COMBINATIONS:
        shown = F.array(*[F.lit(f) for f in sorted(fields, key=lambda f: rank[f])])
        met = F.filter(shown, lambda f: F.array_contains(types, f))
        all_met = F.size(met) == len(fields)
        row = F.struct(F.lit(name).alias("combination"), met.alias("matched_fields"), F.lit(level).alias("risk_level"), all_met.alias("all_fields_matched"), F.when(all_met, F.lit(whole)).otherwise(F.lit(part or whole)).alias("reference"))
        found.append(F.when(F.size(met) >= least, row))
    return F.array_compact(F.array(*found)).cast(RISK)


def warning(matches: Column) -> Column:
    """One line for each combination: the fields' labels, and the note."""
    label = F.create_map(*[x for t, name in LABELS.items() for x in (F.lit(t), F.lit(name))])
    line = lambda m: F.concat(F.lit("Quasi-identifier risk: "), F.array_join(F.transform(m["matched_fields"], lambda f: F.coalesce(label[f], f)), " + "), F.lit(" ("), m["reference"], F.lit(")"))
    return F.array_join(F.transform(matches, line), "\n")


def risk_rows(entities: DataFrame, key: str, type_: str = "type") -> DataFrame:
    """(key, combination, risk_level, n_fields, all_fields_matched) from one row for each entity.

    A join of the distinct types with the table of combinations; the shuffle is by key, after map-side
    distinct.
    """
    spark = entities.sparkSession
    table = spark.createDataFrame([(name, level, least, len(fields), f) for name, level, least, fields, _, _ in COMBINATIONS for f in fields], "combination string, risk_level string, least int, n_all int, type string")
    joined = entities.select(key, F.col(type_).alias("type")).distinct().join(F.broadcast(table), "type")
    return joined.groupBy(key, "combination", "risk_level", "least", "n_all").agg(F.count("*").cast("int").alias("n_fields")).filter("n_fields >= least").select(key, "combination", "risk_level", "n_fields", (F.col("n_fields") == F.col("n_all")).alias("all_fields_matched"))

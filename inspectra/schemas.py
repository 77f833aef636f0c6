"""Column sets of the stored tables."""

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "int": T.IntegerType(),
          "array<string>": T.ArrayType(T.StringType()), "array<double>": T.ArrayType(T.DoubleType())}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in text.split(","))])


# Names and types of the stored tables.
INSPECTION_EVENTS = _schema("""
    inspection_id string, restaurant_id string, source_id string, jurisdiction string, inspection_date date, inspection_type string, inspection_type_raw string,
    action string, action_conflict boolean, action_conflict_values array<string>, score double, score_conflict boolean, score_conflict_values array<double>,
    grade string, grade_conflict boolean, grade_conflict_values array<string>, grade_date date, violation_count int, critical_violation_count int,
    high_priority_count int, intermediate_count int, basic_count int, dba string, boro_raw string, building string, street string, zipcode string,
    cuisine_description string, latitude double, longitude double, source_dataset string, source_snapshot_date date, source_retrieved_at_utc timestamp,
    source_sha256 string, ingested_at timestamp, pipeline_version string, disposition string, disposition_status string, native_inspection_group_id string,
    native_visit_sequence int""")
VIOLATION_EVENTS = _schema("""
    violation_event_id string, inspection_id string, restaurant_id string, jurisdiction string, inspection_date date, violation_code string, violation_code_norm string,
    violation_description string, violation_description_norm string, critical_flag_raw string, severity string, corrected_on_site boolean, count int,
    source_dataset string, source_snapshot_date date, source_retrieved_at_utc timestamp, source_sha256 string, ingested_at timestamp, pipeline_version string""")
NYC_REQUIRED = ["camis", "inspection_date", "inspection_type", "action", "violation_code", "violation_description", "critical_flag", "score", "grade", "grade_date", "record_date"]
NYC_OPTIONAL = ["dba", "boro", "building", "street", "zipcode", "phone", "cuisine_description", "latitude", "longitude"]
FL_CATEGORIES = [f"violation_{i:02d}" for i in range(1, 59)]
FL_REQUIRED = ["license_type_code", "license_number", "inspection_number", "visit_number", "inspection_class", "inspection_type", "inspection_disposition", "inspection_date",
               "total_violations", "high_priority_count", "intermediate_count", "basic_count", "inspection_visit_id", *FL_CATEGORIES]
FL_OPTIONAL = ["district", "county_number", "county_name", "dba", "location_address", "location_city", "location_zip", "pda_status", "license_id"]
#: Headers of the published Florida layouts, beside those that only differ in case and blanks.
FL_HEADERS = {
    "Business (DBA-Does Business As) Name": "dba", "Location Zip Code": "location_zip", "Number of Total Violations": "total_violations",
    "Number of High Priority Violations": "high_priority_count", "Number of Intermediate Violations": "intermediate_count", "Number of Basic Violations": "basic_count",
    "PROFESSION": "license_type_code", "LICENSE_NO": "license_number", "DBA_NAME": "dba", "LOC_ADDRESS": "location_address", "LOC_CITY": "location_city", "LOC_ZIP": "location_zip",
    "INSP_NO": "inspection_number", "VISIT_NO": "visit_number", "INSPCLASS": "inspection_class", "INSPTYPE": "inspection_type", "DISPOSITION": "inspection_disposition",
    "INSP_DATE": "inspection_date", "VIOLATIONS": "total_violations", "HIGH_VIOL": "high_priority_count", "INTERMED_VIOL": "intermediate_count", "BASIC_VIOL": "basic_count",
    "LIC_ID": "license_id", "INSP_VST_ID": "inspection_visit_id", "COUNTYCODE": "county_number", "CNTY_DESC": "county_name", "PDA": "pda_status",
} | {x.replace("_", " ").title(): x for x in [*FL_REQUIRED, *FL_OPTIONAL]} | {f"V_{i:02d}": f"violation_{i:02d}" for i in range(1, 59)}
NYC_HEADERS = {x.replace("_", " ").upper(): x for x in [*NYC_REQUIRED, *NYC_OPTIONAL]} | {x: x for x in [*NYC_REQUIRED, *NYC_OPTIONAL]}

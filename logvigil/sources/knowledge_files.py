"""Reading knowledge-base files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PATTERN_SCHEMA = (
    "id string, name string, description string, indicators array<string>, "
    "sector array<string>, mitre_technique_ids array<string>, source string"
)
COMPLIANCE_SCHEMA = (
    "id string, legislation string, section string, title string, summary string, "
    "trigger_conditions array<string>, required_action string, reporting_body string, "
    "deadline string"
)
OBJECTS = (
    "array<struct<id:string,type:string,name:string,description:string,modified:string,"
    "revoked:boolean,x_mitre_deprecated:boolean,"
    "external_references:array<struct<source_name:string,external_id:string>>,"
    "kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,"
    "x_mitre_platforms:array<string>>>"
)


def read_kb_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects; malformed files fail the read.

    Parsed from the whole text, so that a file holding a single object, or an
    array with anything but objects, is told from an array of objects.
    """
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    fault = lambda message: F.raise_error(F.lit(message)).cast("variant")
    checked = text.select(
        F.when(F.col("doc").isNull(), fault("Source file contains invalid JSON"))
        .when(~F.schema_of_variant("doc").startswith("ARRAY"),
              fault("Source file must contain a JSON array of objects"))
        .otherwise(F.col("doc")).alias("doc")
    )
    items = checked.select(F.explode(F.variant_get("doc", "$", "array<variant>")).alias("item"))
    sound = items.select(
        F.when(F.schema_of_variant("item").startswith("OBJECT"), F.col("item"))
        .otherwise(fault("Source file must contain a JSON array of objects")).alias("item")
    )
    return sound.select(F.from_json(F.to_json("item"), schema).alias("r")).select("r.*")


def read_stix_bundle(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The objects of a STIX bundle with their place in it.

    A file is one bundle, laid out as it may be; with ``lines``, each line of a file is one, so
    that very many bundles need not be as many files, and a large file is read in parts.
    """
    bundle = (
        spark.read.option("multiLine", not lines).option("mode", "FAILFAST")
        .schema(f"objects {OBJECTS}").json(path)
    )
    guarded = bundle.select(
        F.when(F.col("objects").isNull(),
               F.raise_error(F.lit("Bundle does not contain an objects array")).cast(OBJECTS))
        .otherwise(F.col("objects")).alias("objects")
    )
    return guarded.select(F.posexplode("objects").alias("position", "o")).select("position", "o.*")

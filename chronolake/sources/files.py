"""Names of static files: version, entity, range and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: v<version>-<name>.<from>-<to>.<extension>
NAME = r"^v(\d+)-(.+)\.(\d+)-(\d+)\.([a-z]+)$"


def parse(name: Column) -> Column:
    """A struct of the parts of a file name; NULL if it isn't one."""
    part = lambda i: F.regexp_extract(name, NAME, i)
    fields = F.struct(part(1).cast("int").alias("version"), part(2).alias("entity"), part(3).cast("bigint").alias("start_step"), part(4).cast("bigint").alias("end_step"), part(5).alias("ext"))
    return F.when(name.rlike(NAME), fields)


def format_name(version: Column, entity: Column, start: Column, end: Column, ext: Column) -> Column:
    return F.concat(F.lit("v"), version, F.lit("-"), entity, F.lit("."), start, F.lit("-"), end, F.lit("."), ext)


def listing(files: DataFrame, name: str) -> DataFrame:
    """Files of valid names with their parts; others are left out."""
    return files.withColumn("__p", parse(F.col(name))).where("__p is not null").select(*files.columns, "__p.*")

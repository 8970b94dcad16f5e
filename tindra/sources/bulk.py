"""Readers of registry dumps and request lists, and writers of results."""

from __future__ import annotations

import zlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tindra.functions.text import digits, filled, number

# The columns of a registry row, with the names that dumps give them.
ALIASES = {
    "organisation_number": ("organisation_number", "organisasjonsnummer", "Organisasjonsnummer"),
    "name": ("name", "navn", "Navn"),
    "legal_form": ("legal_form", "organisasjonsform.kode", "Organisasjonsform.kode"),
    "employees": ("employees", "antallAnsatte", "Antall ansatte"),
    "bankrupt": ("bankrupt", "konkurs", "Konkurs"),
    "liquidating": ("liquidating", "underAvvikling", "Under avvikling"),
    "municipality": ("municipality", "forretningsadresse.kommune", "Forretningsadresse.kommune"),
    "municipality_number": ("municipality_number", "forretningsadresse.kommunenummer", "Forretningsadresse.kommunenummer"),
    "industry_code": ("industry_code", "naeringskode1.kode", "Næringskode 1"),
    "industry_label": ("industry_label", "naeringskode1.beskrivelse", "Næringskode 1.beskrivelse"),
    "website": ("website", "hjemmeside", "Hjemmeside"),
    "latest_submitted_accounts": ("latest_submitted_accounts", "sisteInnsendteAarsregnskap", "Siste innsendte årsregnskap"),
}


def _head(spark: SparkSession, path: str, size: int) -> bytes | None:
    """The first bytes of a file, or of the first file of a folder, on any file system that Spark reads; None where there is none."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(place):
        raise FileNotFoundError(path)
    if files.getFileStatus(place).isDirectory():
        found = sorted((f.getPath().toString() for f in files.listStatus(place) if f.isFile() and f.getPath().getName()[0] not in "._"), key=str)
        if not found:
            return None
        place = jvm.org.apache.hadoop.fs.Path(found[0])
    stream = files.open(place)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def sniff(spark: SparkSession, path: str, size: int = 8192) -> tuple[str, str]:
    """("json" or "csv", delimiter) of a file, told from its first bytes; gzip is known by its mark.

    A file that only points to one kept elsewhere is an error.
    """
    head = _head(spark, path, size)
    if head is None:
        return "json", ""
    if head[:2] == b"\x1f\x8b":
        head = zlib.decompressobj(31).decompress(head, size)
    text = head.decode("utf-8-sig", "replace")
    if text.startswith("version https://git-lfs"):
        raise ValueError(f"{path} is a pointer, the file itself is elsewhere")
    line = next((x for x in text.splitlines() if x.strip()), "")
    if line.lstrip()[:1] == "{":
        return "json", ""
    return "csv", max((";", ",", "\t"), key=line.count)


def normalised(raw: DataFrame) -> DataFrame:
    """Registry rows under the names and types of this package; a row without a nine-digit number is dropped.

    Of two names for a column the first that is filled counts.  Works on flat columns,
    whose names may hold dots.
    """

    def first(name: str):
        found = [filled(F.col(f"`{c}`").cast("string")) for c in ALIASES[name] if c in raw.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    text = {c: first(c) for c in ALIASES}
    text["employees"] = number(text["employees"])
    for c in ("bankrupt", "liquidating"):
        text[c] = F.coalesce(F.lower(text[c]) == "true", F.lit(False))
    return raw.select(*(v.alias(k) for k, v in text.items())).where(F.length("organisation_number") == 9)


def read_bulk(spark: SparkSession, path: str) -> DataFrame:
    """A registry dump as CSV or JSON lines, gzipped or not; blank and broken lines are skipped."""
    kind, delimiter = sniff(spark, path)
    if kind == "json":
        raw = spark.read.option("mode", "DROPMALFORMED").option("primitivesAsString", True).json(path)
    else:
        raw = spark.read.option("header", True).option("sep", delimiter).option("encoding", "UTF-8").option("multiLine", False).csv(path)
        if raw.columns and raw.columns[0].startswith("﻿"):
            raw = raw.withColumnRenamed(raw.columns[0], raw.columns[0].lstrip("﻿"))
    return normalised(flat(raw))


def flat(df: DataFrame) -> DataFrame:
    """Structs opened into columns named with dots, one level."""
    columns = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            columns += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}.{g.name}") for g in f.dataType.fields]
        else:
            columns.append(F.col(f"`{f.name}`"))
    return df.select(*columns)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, organisation_number, evaluation_split, sample_slice) from a text file, JSON lines, a JSON list or ``{"organisation_numbers": [...]}``, in the order of the file.

    Only digits count, and there have to be nine; a number that is asked for twice is
    an error.  A list of requests is one small file, read whole.
    """
    whole = spark.read.option("wholetext", True).text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    listed = F.coalesce(F.get_json_object("value", "$.organisation_numbers"), F.when(F.trim("value").startswith("["), F.col("value")))
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    rows = whole.select(F.posexplode(F.coalesce(F.from_json(listed, "array<string>"), lines)).alias("ordinal", "line"))
    said = F.coalesce(F.get_json_object("line", "$.organisation_number"), F.when(~F.trim("line").startswith("{"), F.col("line")))
    extra = lambda c: F.get_json_object("line", f"$.{c}").alias(c)
    numbers = rows.select("ordinal", digits(said).alias("organisation_number"), extra("evaluation_split"), extra("sample_slice"))
    wrong = numbers.where(F.length("organisation_number") != 9).limit(10).collect()
    twice = numbers.groupBy("organisation_number").count().where("count > 1").limit(10).collect()
    if wrong or twice:
        raise ValueError(f"not nine digits: {[r.ordinal for r in wrong]}; asked for more than once: {[r.organisation_number for r in twice]}")
    return numbers


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log of JSON lines; broken lines are skipped, and a log that is not there is empty."""
    if not Path(path.removeprefix("file://")).exists() and "://" not in path.removeprefix("file://"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; the commit protocol makes the result appear whole or not at all."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with all values quoted; nested columns become JSON."""
    nested = ("array", "map", "struct", "variant")
    plain = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in nested else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*plain).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)

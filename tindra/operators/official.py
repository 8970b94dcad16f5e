"""Answers of the official registers, in JSON, as tables: accounts, roles, sub-units, entities.

A body that is null, no JSON or of another shape gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of the registers' answers, by the names of this package.
ACCOUNT_FIELDS = {
    "record_id": "$.id",
    "account_type": "$.regnskapstype",
    "currency": "$.valuta",
    "period_from": "$.regnskapsperiode.fraDato",
    "period_to": "$.regnskapsperiode.tilDato",
    "revenue": "$.resultatregnskapResultat.driftsresultat.driftsinntekter.sumDriftsinntekter",
    "operating_result": "$.resultatregnskapResultat.driftsresultat.driftsresultat",
    "profit_before_tax": "$.resultatregnskapResultat.ordinaertResultatFoerSkattekostnad",
    "annual_result": "$.resultatregnskapResultat.aarsresultat",
    "assets": "$.eiendeler.sumEiendeler",
    "equity": "$.egenkapitalGjeld.egenkapital.sumEgenkapital",
    "debt": "$.egenkapitalGjeld.gjeldOversikt.sumGjeld",
}
AMOUNTS = ("revenue", "operating_result", "profit_before_tax", "annual_result", "assets", "equity", "debt")
LOCATION_FIELDS = {
    "location_number": "$.organisasjonsnummer",
    "name": "$.navn",
    "employees": "$.antallAnsatte",
    "industry_code": "$.naeringskode1.kode",
    "town": "$.beliggenhetsadresse.poststed",
    "website": "$.hjemmeside",
    "email": "$.epostadresse",
}
ENTITY_FIELDS = {
    "number": "$.organisasjonsnummer",
    "name": "$.navn",
    "legal_form": "$.organisasjonsform.kode",
    "employees": "$.antallAnsatte",
    "employees_registered_at": "$.registreringsdatoAntallAnsatteEnhetsregisteret",
    "bankrupt": "$.konkurs",
    "liquidating": "$.underAvvikling",
    "website": "$.hjemmeside",
    "email": "$.epostadresse",
    "phone": "$.telefon",
    "mobile": "$.mobil",
    "industry_code": "$.naeringskode1.kode",
    "industry_label": "$.naeringskode1.beskrivelse",
    "street": "$.forretningsadresse.adresse[0]",
    "post_code": "$.forretningsadresse.postnummer",
    "town": "$.forretningsadresse.poststed",
    "municipality": "$.forretningsadresse.kommune",
    "founded_at": "$.stiftelsesdato",
    "in_group": "$.erIKonsern",
    "latest_submitted_accounts": "$.sisteInnsendteAarsregnskap",
}


def _fields(item: Column, fields: dict[str, str]) -> list[Column]:
    return [F.get_json_object(item, path).alias(name) for name, path in fields.items()]


def accounts(df: DataFrame, key: str, body: str, keep: int = 3) -> DataFrame:
    """(key, place, year, fields...): the newest ``keep`` annual accounts of each body, company accounts before those of a group with the same end.

    Amounts are decimals of two places; the year is that of the period's end.
    """
    items = F.from_json(F.col(body), "array<string>")
    end = lambda x: F.coalesce(F.get_json_object(x, "$.regnskapsperiode.tilDato"), F.lit(""))
    own = lambda x: F.coalesce((F.get_json_object(x, "$.regnskapstype") == "SELSKAP").cast("int"), F.lit(0))
    ranked = F.transform(F.filter(items, lambda x: x.startswith("{")), lambda x, k: F.struct(end(x).alias("e"), own(x).alias("o"), (-k).alias("k"), x.alias("x")))
    rows = df.select(key, F.posexplode(F.slice(F.sort_array(ranked, asc=False), 1, keep)).alias("_p", "_i")).select(key, (F.col("_p") + 1).alias("place"), F.col("_i.x").alias("_x"))
    rows = rows.select(key, "place", *_fields(F.col("_x"), ACCOUNT_FIELDS))
    return rows.withColumns({a: F.col(a).try_cast("decimal(20,2)") for a in AMOUNTS}).withColumn("year", F.regexp_extract("period_to", r"^(\d{4})", 1).try_cast("int"))


def account_years(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, year): the years in a list of years, in text or numbers; each once."""
    years = F.transform(F.from_json(F.col(body), "array<string>"), lambda y: F.regexp_extract(y, r"^\"?([0-9]+)\"?$", 1))
    return df.select(key, F.explode(F.array_distinct(F.filter(years, lambda y: y != ""))).alias("year"))


_ROLE = "struct<type:struct<kode:string,beskrivelse:string>,person:struct<navn:struct<fornavn:string,mellomnavn:string,etternavn:string>>,enhet:struct<organisasjonsnummer:string,navn:string>,avregistrert:boolean>"
_GROUPS = f"struct<rollegrupper:array<struct<type:struct<kode:string,beskrivelse:string>,sistEndret:string,roller:array<{_ROLE}>>>>"


def roles(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, name, role_number, role_code, role, group_code, group, last_changed, inactive) of every role in a body, in any order."""
    groups = df.select(key, F.explode(F.from_json(F.col(body), _GROUPS)["rollegrupper"]).alias("g"))
    each = groups.select(key, "g", F.explode("g.roller").alias("r"))
    person = F.concat_ws(" ", *(F.when(F.col(f"r.person.navn.{p}") != "", F.col(f"r.person.navn.{p}")) for p in ("fornavn", "mellomnavn", "etternavn")))
    return each.select(
        key, F.when(person != "", person).otherwise(F.col("r.enhet.navn")).alias("name"), F.col("r.enhet.organisasjonsnummer").alias("role_number"), F.col("r.type.kode").alias("role_code"), F.col("r.type.beskrivelse").alias("role"),
        F.col("g.type.kode").alias("group_code"), F.col("g.type.beskrivelse").alias("group"), F.col("g.sistEndret").alias("last_changed"), F.coalesce("r.avregistrert", F.lit(False)).alias("inactive"),
    )


def locations(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, place, fields...) of the sub-units in a body, in its order."""
    items = F.from_json(F.get_json_object(F.col(body), "$._embedded.underenheter"), "array<string>")
    return df.select(key, F.posexplode(items).alias("_p", "_x")).select(key, (F.col("_p") + 1).alias("place"), *_fields(F.col("_x"), LOCATION_FIELDS))


def entities(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, fields...) of each body that describes an entity; numbers and truth values are typed."""
    rows = df.select(key, *_fields(F.col(body), ENTITY_FIELDS)).where("number is not null")
    return rows.withColumns({"employees": F.col("employees").try_cast("int"), **{c: F.col(c).try_cast("boolean") for c in ("bankrupt", "liquidating", "in_group")}})


def role_events(df: DataFrame, key: str) -> DataFrame:
    """(key, group, changed): each change of a group of roles once, by its day; roles without day are left out."""
    day = F.regexp_extract("last_changed", r"^(\d{4}-\d{2}-\d{2})", 1)
    return df.select(key, F.coalesce("group", "group_code", F.lit("Roles")).alias("group"), day.alias("changed")).where("changed <> ''").distinct()


def recent_roles(df: DataFrame, key: str, as_of: Column, codes: tuple[str, ...] | None = None, days: int = 365, n: int = 3) -> DataFrame:
    """(key, group, changed, place): the newest ``n`` changes of groups within ``days`` before ``as_of``; of ``codes`` only where they are given."""
    from tindra.operators.ranking import newest

    events = role_events(df if codes is None else df.where(F.col("group_code").isin(*codes)), key)
    age = F.date_diff(as_of, F.try_to_timestamp("changed", F.lit("yyyy-MM-dd")).cast("date"))
    return newest(events.where(age.between(0, days)), key, n, [F.desc("changed"), F.col("group")])

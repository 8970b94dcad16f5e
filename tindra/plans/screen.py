"""A small closed language of company screens, compiled to filters, an order and a limit.

``companies in Oslo with revenue over 10 million top 5 by employees``

A screen is read by a cursor over its words.  What the language cannot answer makes
the plan abstain with a reason instead of answering something else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of subjects that no evidence answers, by the kind of evidence that is missing, and the words of the language.
ABSTAIN = {
    "opinions": ("sentiment", "glassdoor", "review", "culture"),
    "reach": ("linkedin", "traffic", "buzz"),
    "absence": ("without a website", "no website"),
    "conduct": ("velocity", "fraud"),
}
REASONS = {
    "opinions": "what people think of a company is in none of the tables",
    "reach": "how widely a company is seen is in none of the tables",
    "absence": "a site that was not found may still exist",
    "conduct": "how a company acts is in none of the tables",
}
COMPARATORS = {
    "more than": ">", "over": ">", "above": ">", "at least": ">=", "fewer than": "<", "less than": "<", "under": "<", "at most": "<=",
    ">": ">", "<": "<", ">=": ">=", "<=": "<=", "=": "=",
}
UNITS = {"billion": 10**9, "bn": 10**9, "million": 10**6, "m": 10**6}
LEGAL_FORMS = ("as", "asa", "enk", "nuf", "ans", "da", "sa", "sti", "brl")
MOST = 100
_STOP = ("with", "and", "having", "that", "where", "top")
_WORD = re.compile(r"\"[^\"]*\"|'[^']*'|>=|<=|[<>=]|[^\s<>=]+")


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: object


@dataclass(frozen=True)
class Plan:
    query: str
    filters: tuple[Filter, ...] = ()
    sort: tuple[str, int] | None = None
    unsupported: tuple[str, ...] = field(default=())

    @property
    def executable(self) -> bool:
        return bool(self.filters or self.sort) and not self.unsupported


class _Cursor:
    def __init__(self, text: str) -> None:
        self.words, self.at = _WORD.findall(text), 0

    def here(self, *phrase: str) -> bool:
        return tuple(w.lower() for w in self.words[self.at : self.at + len(phrase)]) == phrase

    def take(self, *phrase: str) -> bool:
        if self.here(*phrase):
            self.at += len(phrase)
            return True
        return False

    def any(self, options) -> str | None:
        """The longest of the options that stands here, taken."""
        for option in sorted(options, key=lambda o: -len(o.split())):
            if self.take(*option.split()):
                return option
        return None

    def number(self) -> float | None:
        """An amount with optional currency and unit; commas and spaces group thousands, one point or comma before other than three digits is decimal."""
        start = self.at
        self.take("nok")
        word = self.words[self.at] if self.at < len(self.words) else ""
        found = re.fullmatch(r"(\d[\d.,]*?)(bn|m|billion|million)?[.,;]?", word.lower())
        if not found:
            self.at = start
            return None
        self.at += 1
        digits = found[1].rstrip(".,")
        if re.fullmatch(r"\d{1,3}([.,]\d{3})+", digits):
            digits = re.sub(r"[.,]", "", digits)
        unit = found[2] or self.any(UNITS)
        try:
            return float(digits.replace(",", ".")) * (UNITS[unit] if unit else 1)
        except ValueError:
            self.at = start
            return None


def parse(query: str) -> Plan:
    """The plan of a screen; what is not understood is skipped."""
    text = " ".join(query.split())
    lower = text.casefold()
    unsupported = tuple(REASONS[kind] for kind, words in ABSTAIN.items() if any(word in lower for word in words))
    filters: dict[str, Filter] = {}
    sort = None
    c = _Cursor(text)
    whole = lambda x: int(x) if float(x).is_integer() else x

    def put(name: str, operator: str, value: object) -> None:
        filters.setdefault(name, Filter(name, operator, value))

    while c.at < len(c.words):
        start = c.at
        if c.any(("in", "municipality is", "municipality =", "municipality")):
            place = []
            while c.at < len(c.words) and c.words[c.at].lower() not in _STOP:
                place.append(c.words[c.at].strip(",;"))
                c.at += 1
            if place:
                put("municipality", "eq", " ".join(place).upper())
        elif c.any(("legal form is", "legal form =", "legal form", "organisation form is", "organisation form =", "organisation form")):
            if form := c.any(LEGAL_FORMS):
                put("legal_form", "eq", form.upper())
        elif name := c.any(("revenue", "employees", "employee")):
            if (operator := c.any(COMPARATORS)) and (amount := c.number()) is not None:
                put("revenue" if name == "revenue" else "employees", COMPARATORS[operator], whole(amount))
        elif operator := c.any(COMPARATORS):
            amount = c.number()
            c.take("registered")
            if amount is not None and (name := c.any(("revenue", "employees", "employee"))):
                put("revenue" if name == "revenue" else "employees", COMPARATORS[operator], whole(amount))
        elif c.any(("unprofitable", "loss-making", "loss making", "negative annual result")):
            put("annual_result", "<", 0)
        elif c.any(("profitable", "positive annual result")):
            put("annual_result", ">", 0)
        elif c.any(("industry contains", "industry is", "industry =", "industry")):
            word = c.words[c.at] if c.at < len(c.words) else ""
            if word[:1] in "\"'" and len(word) > 2:
                put("industry", "contains", word[1:-1].casefold())
                c.at += 1
        elif c.take("top"):
            amount = c.number()
            if amount is not None and c.take("by") and (name := c.any(("revenue", "employees"))):
                sort = (name, min(int(amount), MOST))
        elif c.any(("that have", "with", "has", "have")):
            c.any(("an", "a"))
            c.any(("official", "annual"))
            if c.take("website"):
                put("website", "present", True)
            elif c.take("accounts"):
                put("financials", "available", True)
        if c.at == start:
            c.at += 1
    order = ("municipality", "legal_form", "employees", "revenue", "annual_result", "website", "financials", "industry")
    return Plan(text, tuple(filters[f] for f in order if f in filters), sort, unsupported)


def condition(f: Filter) -> Column:
    """A filter as a column: never null; a null value meets no comparison and equals the empty text."""
    c, text = F.col(f.field), F.coalesce(F.col(f.field).cast("string"), F.lit(""))
    made = {
        "eq": lambda: F.lower(text) == str(f.value).lower(),
        "contains": lambda: F.contains(F.lower(text), F.lit(str(f.value).lower())),
        "present": lambda: F.trim(text) != "",
        "available": lambda: F.coalesce(c.cast("boolean"), F.lit(False)),
        ">": lambda: c > f.value, "<": lambda: c < f.value, ">=": lambda: c >= f.value, "<=": lambda: c <= f.value, "=": lambda: c == f.value,
    }[f.operator]
    return F.coalesce(made(), F.lit(False))


def run(base: DataFrame, plan: Plan, key: str = "organisation_number") -> DataFrame:
    """The companies of a plan; an abstaining plan gives none.

    ``base`` has the key and the fields that the plan names.  Filters reach the scan, and
    a top list is a take-ordered, so no more than the limit leaves a task.
    """
    if not plan.executable:
        return base.limit(0)
    rows = base
    for f in plan.filters:
        rows = rows.where(condition(f))
    if plan.sort:
        name, n = plan.sort
        return rows.orderBy(F.desc_nulls_last(name), key).limit(n)
    return rows


def involved(plan: Plan) -> list[str]:
    """The modules whose evidence a plan reads, by name."""
    module = {"revenue": "financials", "annual_result": "financials", "financials": "financials", "website": "website"}
    fields = [f.field for f in plan.filters] + ([plan.sort[0]] if plan.sort else [])
    return sorted({module.get(f, "registry") for f in fields})


def cited(found: DataFrame, evidence: DataFrame, plan: Plan, key: str = "organisation_number") -> DataFrame:
    """(key, module, source_url, retrieved_at, content_sha256): what the companies of a screen rest on: of each module involved the newest available evidence.

    ``evidence`` has field, state and ingested_at beside the columns that come out.
    """
    rows = evidence.where((F.col("state") == "available") & F.col("field").isin(*involved(plan), "")).join(found.select(key).distinct(), key, "left_semi")
    newest = rows.groupBy(key, F.col("field").alias("module")).agg(F.max_by(F.struct("source_url", "retrieved_at", "content_sha256"), F.struct("ingested_at", "evidence_id")).alias("_r"))
    return newest.select(key, "module", "_r.*")

"""Pages matched with companies that share no key, with a confidence for each match.

1. *Parts.*  Each page and each company is read once into its parts (``entity_parts``).
   Which words of names tell a trade is learnt from all companies: a word most of
   whose companies are of one industry.
2. *Candidate pairs.*  Names meet through deletion keys (a word and the word without
   any one of its letters, so one typing error never parts them) and through the
   beginnings of url labels.
3. *Features.*  Each pair is described by a small pattern: how the name occurs, and
   whether trade, place, region word, legal form and head count agree, disagree or
   are unknown.  Which words mean which trade is learnt from the pairs whose places
   agree, over all pairs.
4. *Prior.*  The patterns are counted over all pairs and a two-class mixture is
   fitted to the counts (Fellegi and Sunter, by expectation maximisation).  The
   table of patterns is as small as the product of the feature values.  That a page
   is a parked site, a list of companies or of a related entity weighs against every
   pair of it, by ``KINDS``.
5. *Belief propagation.*  Two kinds of factors tie the pairs together: a page is of
   at most one company, and all pages of a company are of one place.  Messages are
   sums per page, per company and place, and per company, exchanged through joins
   until no belief moves by more than ``tolerance``; that they did not is warned of.

Company side: a company has many pages, so the one-to-one factor is between a
company and its place, not between a company and a page.

Defined results: rows without key are left out, a key that is repeated counts once
(its rows agree); pages without title and url and companies without name match
nothing.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tindra.llm.address_parts import Towns
from tindra.llm.entity_parts import LEGAL_FORMS, REGIONS, company, name_words, page, plain, shortened
from tindra.session import release, stored

FEATURES = {"name": (1, 2, 3, 4), "trade": (-1, 0, 1), "place": (-1, 0, 1), "region": (-1, 0, 1, 2), "legal": (-1, 0, 1), "staff": (-1, 0, 1)}
#: Log odds that a page of this kind adds to each of its pairs.
KINDS = {"": 0.0, "related": -12.0, "parked": -12.0, "listing": -12.0}
_CLIP = 30.0
#: Letters of a url label by which it meets names; what follows is compared in the pair.
_PREFIX = 8


def _deletions(word: str) -> set[str]:
    return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}


def _towns(places: DataFrame) -> list[tuple[str, str, str]]:
    """The register of post codes, a fixed table of a few thousand rows."""
    return [tuple(r) for r in places.select("postnummer", "poststed", "kommune").distinct().collect()]


def trades_of_names(companies: DataFrame, partners: int = 8, share: float = 0.5) -> DataFrame:
    """(company, trades): the words of each company's name that tell a trade.

    Such a word stands beside at least ``partners`` different words, each counted once,
    and most of its names (``share``) are of one industry; a word that names somebody
    stands beside few.  Counted and met by joins over all companies.
    """

    @F.pandas_udf("array<string>")
    def words_of(names: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(name_words(n)[0])) if isinstance(n, str) else [] for n in names], dtype=object)

    words = companies.select("company", "industry", words_of("name").alias("_w")).withColumn("word", F.explode("_w"))
    beside = words.select("word", F.explode("_w").alias("other")).where(F.col("word") != F.col("other")).distinct().groupBy("word").agg(F.count("*").alias("partners"))
    counts = words.groupBy("word", "industry").agg(F.count("*").alias("n"))
    best = counts.groupBy("word").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    told = best.join(beside, "word").where((F.col("partners") >= partners) & (F.col("top") >= share * F.col("all")))
    found = words.join(told.select("word"), "word").groupBy("company").agg(F.collect_set("word").alias("trades"))
    return companies.select("company").join(found, "company", "left").select("company", F.coalesce("trades", F.array().cast("array<string>")).alias("trades"))


def page_parts(pages: DataFrame, places: DataFrame) -> DataFrame:
    """(page, kind, words, labels, region, legal, at, trade, staff, keys) of pages: page, url, title, place, trade, staff."""
    shared = pages.sparkSession.sparkContext.broadcast(_towns(places))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        towns = Towns(shared.value)
        for frame in frames:
            rows = []
            for key, url, title, place, trade, staff in frame.itertuples(index=False, name=None):
                p = page(url, title, place, towns)
                keys = set()
                for w in p.words:
                    if len(w) > 1 and w not in LEGAL_FORMS and w not in REGIONS:
                        keys |= {"d" + x for x in _deletions(w)}
                        if w.endswith("s"):
                            keys |= {"d" + x for x in _deletions(w[:-1])}
                for label in p.labels:
                    keys |= {"u" + label[:n] for n in range(3, min(len(label), _PREFIX) + 1)}
                    keys.add("a" + label)
                digits = "".join(x for x in staff or "" if x in "0123456789")[:9]
                rows.append((key, p.kind, p.words, p.labels, p.region, p.legal, sorted(p.places), "=" + plain(trade) if trade else None, int(digits) if digits else None, sorted(keys)))
            yield pd.DataFrame(rows, columns=["page", "kind", "words", "labels", "region", "legal", "at", "said_trade", "said_staff", "keys"]).astype({"said_staff": "Int64"})

    rows = pages.select("page", "url", "title", "place", "trade", F.col("staff").cast("string").alias("staff"))
    return rows.mapInPandas(read, f"page {pages.schema['page'].dataType.simpleString()}, kind string, words array<string>, labels array<string>, region string, legal string, at array<string>, said_trade string, said_staff bigint, keys array<string>")


def company_parts(companies: DataFrame, places: DataFrame) -> DataFrame:
    """(company, stem, own_region, own_trade, own_legal, towns, industry, employees, short, own_keys) of companies: company, name, municipality, industry, employees."""
    shared = companies.sparkSession.sparkContext.broadcast(_towns(places))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        towns = Towns(shared.value)
        for frame in frames:
            rows = []
            for key, name, municipality, industry, employees, trades in frame.itertuples(index=False, name=None):
                c = company(name, municipality, towns, frozenset(trades))
                if c:
                    short = sorted(shortened(c))
                    keys = {"u" + c.stem[:_PREFIX], *("d" + x for x in _deletions(c.stem)), *("a" + x for x in short)}
                    rows.append((key, c.stem, c.region, c.trade, c.legal, sorted(c.municipalities), industry, employees, short, sorted(keys)))
            yield pd.DataFrame(rows, columns=["company", "stem", "own_region", "own_trade", "own_legal", "towns", "industry", "employees", "short", "own_keys"]).astype({"employees": "Int64"})

    rows = companies.select("company", "name", "municipality", "industry", F.col("employees").cast("bigint").alias("employees")).join(trades_of_names(companies), "company")
    return rows.mapInPandas(read, f"company {companies.schema['company'].dataType.simpleString()}, stem string, own_region string, own_trade string, own_legal string, towns array<string>, industry string, employees bigint, short array<string>, own_keys array<string>")


def _near(a: Column, b: Column) -> Column:
    """At most one letter more, less, other, or two swapped."""
    swapped = (F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return F.levenshtein(a, b, 1).between(0, 1) | swapped


def name_level() -> Column:
    """How a page names a company: 4 in its title, 3 there with a typing error, 2 in its url, 1 in a shortened url, 0 not at all."""
    stem = F.col("stem")
    rough = lambda w: (F.length(w) > 5) & (_near(w, stem) | (w.endswith("s") & _near(F.regexp_replace(w, "s$", ""), stem)))
    return (
        F.when(F.array_contains("words", stem) | F.array_contains("words", F.concat(stem, F.lit("s"))), 4)
        .when((F.length(stem) > 5) & F.exists("words", rough), 3)
        .when((F.length(stem) > 2) & F.exists("labels", lambda x: F.startswith(x, stem)), 2)
        .when(F.arrays_overlap("labels", "short"), 1)
        .otherwise(0)
    )


def described_pairs(pages: DataFrame, companies: DataFrame) -> DataFrame:
    """The candidate pairs with their features (all but trade) and the words that may tell a trade; frames as from the two functions of parts."""
    keyed = lambda df, key, keys: df.select(key, F.explode(keys).alias("k")).select(key, F.xxhash64("k").alias("k"))
    # The keys are many times the size that a plan expects of an exploded table, so they are never broadcast.
    pairs = keyed(pages, "page", "keys").join(keyed(companies, "company", "own_keys").hint("merge"), "k").select("page", "company").distinct()
    full = pairs.join(pages.drop("keys"), "page").join(companies.drop("own_keys"), "company").withColumn("name", name_level()).where("name > 0")
    agree = lambda a, b: F.when((a == "") | (b == ""), 0).when(a == b, 1).otherwise(-1)
    region = F.when(F.col("region") == "", F.when(F.col("own_region") == "", 0).otherwise(2)).when(F.col("region") == F.col("own_region"), 1).otherwise(-1)
    close = F.abs(F.col("said_staff") - F.col("employees")) <= F.greatest(F.lit(1.0), 0.2 * F.col("employees"))
    known = F.filter("words", lambda w: (w != F.col("stem")) & ~w.isin(*LEGAL_FORMS, *REGIONS))
    joined = F.transform(F.filter("labels", lambda x: F.startswith(x, F.col("stem")) & (x != F.col("stem"))), lambda x: F.substr(x, F.length("stem") + 1))
    words = F.array_distinct(F.concat(known, joined, F.when(F.col("said_trade").isNotNull(), F.array("said_trade")).otherwise(F.array().cast("array<string>"))))
    return full.select(
        "page", "company", "kind", F.col("name"),
        F.when((F.size("at") == 0) | (F.size("towns") == 0), 0).when(F.arrays_overlap("at", "towns"), 1).otherwise(-1).alias("place"),
        region.alias("region"), agree(F.col("legal"), F.col("own_legal")).alias("legal"),
        F.when(close, 1).when(~close, -1).otherwise(0).alias("staff"),
        words.alias("words"), "own_trade", "industry", F.array_min("at").alias("town"),
    ).withColumn("same_trade", (F.col("own_trade") != "") & (F.array_contains("words", F.col("own_trade")) | F.array_contains("words", F.concat(F.lit("="), "own_trade")))).drop("own_trade")


def trade_words(pairs: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """(word, industry): words that, on pages at a company's place, occur ``least`` times and mostly stand beside one industry.  Over all pairs."""
    sure = pairs.where("place = 1 and name >= 2 and industry is not null")
    counts = sure.select(F.explode("words").alias("word"), "industry").groupBy("word", "industry").agg(F.count("*").alias("n"))
    best = counts.groupBy("word").agg(F.max(F.struct("n", "industry")).alias("b"), F.sum("n").alias("all"))
    return best.where((F.col("b.n") >= least) & (F.col("b.n") >= F.lit(share) * F.col("all"))).select("word", F.col("b.industry").alias("industry"))


def with_trade(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs with the feature trade: what their words say against the company's industry, by joins."""
    said = pairs.select("page", "company", F.col("industry").alias("_own"), F.explode("words").alias("word")).join(words, "word")
    told = said.groupBy("page", "company").agg(F.bool_or(F.col("industry") == F.col("_own")).alias("_agrees"))
    trade = F.when(F.col("same_trade") | F.coalesce("_agrees", F.lit(False)), 1).when(F.col("_agrees").isNotNull() & F.col("industry").isNotNull(), -1).otherwise(0)
    return pairs.join(told, ["page", "company"], "left").withColumn("trade", trade).drop("words", "industry", "same_trade", "_agrees")


def fit_mixture(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, dict[str, dict[int, float]]]:
    """(constant, weight of each value of each feature), whose sum is the log odds of a match.

    A mixture of matches and others, features independent in each.

    The start says that matches agree; a few pseudo-counts of that keep small inputs sane.
    """
    names = list(FEATURES)
    start = {
        "name": {1: 0.02, 2: 0.15, 3: 0.13, 4: 0.70}, "trade": {-1: 0.01, 0: 0.04, 1: 0.95}, "place": {-1: 0.01, 0: 0.07, 1: 0.92},
        "region": {-1: 0.01, 0: 0.75, 1: 0.12, 2: 0.12}, "legal": {-1: 0.02, 0: 0.58, 1: 0.40}, "staff": {-1: 0.01, 0: 0.79, 1: 0.20},
    }
    other = {
        "name": {1: 0.03, 2: 0.20, 3: 0.17, 4: 0.60}, "trade": {-1: 0.85, 0: 0.05, 1: 0.10}, "place": {-1: 0.90, 0: 0.07, 1: 0.03},
        "region": {-1: 0.08, 0: 0.70, 1: 0.02, 2: 0.20}, "legal": {-1: 0.15, 0: 0.70, 1: 0.15}, "staff": {-1: 0.12, 0: 0.80, 1: 0.08},
    }
    m, u, share, weight = {k: dict(v) for k, v in start.items()}, {k: dict(v) for k, v in other.items()}, 0.25, 20.0
    counts = np.array([n for _, n in patterns], dtype=float)
    score = lambda t, x: sum(math.log(max(t[f][v], 1e-9)) for f, v in zip(names, x, strict=True))
    for _ in range(rounds if patterns else 0):
        odds = np.array([math.log(share / (1 - share)) + score(m, x) - score(u, x) for x, _ in patterns])
        belief = 1 / (1 + np.exp(-np.clip(odds, -_CLIP, _CLIP)))
        share = float((counts @ belief + 5) / (counts.sum() + 20))
        for table, base, b in ((m, start, belief), (u, other, 1 - belief)):
            total = float(counts @ b) + weight
            for k, f in enumerate(names):
                for v in FEATURES[f]:
                    at = np.array([x[k] == v for x, _ in patterns])
                    table[f][v] = (float((counts * b)[at].sum()) + weight * base[f][v]) / total
    return math.log(share / (1 - share)), {f: {v: math.log(max(m[f][v], 1e-9) / max(u[f][v], 1e-9)) for v in FEATURES[f]} for f in names}


def scored(pairs: DataFrame) -> DataFrame:
    """(page, company, town, theta): the pairs with the prior log odds of their pattern and of their page's kind."""
    names = list(FEATURES)
    patterns = [(tuple(r[f] for f in names), r["n"]) for r in pairs.where("kind = ''").groupBy(*names).agg(F.count("*").alias("n")).collect()]
    constant, weights = fit_mixture(sorted(patterns))
    theta = F.lit(constant)
    for f, table in (*weights.items(), ("kind", KINDS)):
        weight = F.lit(0.0)
        for value, w in table.items():
            weight = F.when(F.col(f) == value, F.lit(w)).otherwise(weight)
        theta = theta + weight
    return pairs.select("page", "company", "town", theta.alias("theta"))


def _clip(c):
    return F.greatest(F.least(c, F.lit(_CLIP)), F.lit(-_CLIP))


def propagate(edges: DataFrame, tolerance: float = 1e-3, rounds: int = 200) -> DataFrame:
    """(page, company, confidence): the marginal probability of each pair.

    ``edges``: page, company, town, theta.  Messages are damped by half.  Each round
    stores the edges, and the loop ends when no belief moves by more than
    ``tolerance``; if that has not come after ``rounds`` there is a warning.  Only
    pairs whose page or company has another pair hear messages; the rest have their
    prior as marginal and take no part in the rounds.
    """
    sigmoid = lambda x: 1 / (1 + F.exp(-_clip(x)))
    softplus = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    edges = edges.select("page", "company", "town", "theta")
    by_page = edges.groupBy("page").agg((F.count("*") > 1).alias("_p"))
    by_company = edges.groupBy("company").agg((F.min("town") < F.max("town")).alias("_c"))
    tied = F.col("_p") | F.coalesce("_c", F.lit(False))
    start = stored(edges.join(by_page, "page").join(by_company, "company").select("page", "company", "town", "theta", F.lit(0.0).alias("m_page"), F.lit(0.0).alias("m_company"), tied.alias("tied")))
    state, done = start.where("tied").drop("tied"), False
    older = None
    for _ in range(rounds):
        to_page = state.withColumn("e", F.exp(_clip(F.col("theta") + F.col("m_company"))))
        pages = to_page.groupBy("page").agg(F.sum("e").alias("s"))
        first = to_page.join(pages, "page").withColumn("new_page", -F.log1p(F.greatest(F.col("s") - F.col("e"), F.lit(0.0))))
        eta = _clip(F.col("theta") + F.col("m_page"))
        groups = state.where("town is not null").groupBy("company", "town").agg(F.sum(softplus(eta)).alias("l"))
        # Of each place the log of its weight less the empty choice; sums over a company are taken relative to the greatest.
        heavy = F.col("l") + F.log(-F.expm1(-F.greatest("l", F.lit(1e-12))))
        groups = groups.withColumn("h", heavy)
        tops = groups.groupBy("company").agg(F.max("h").alias("top"))
        scaled = groups.join(tops, "company").withColumn("x", F.exp(F.col("h") - F.col("top")))
        whole = scaled.groupBy("company").agg(F.sum("x").alias("z"))
        both = scaled.join(whole, "company").select("company", "town", "l", (F.log(F.greatest(F.col("z") - F.col("x"), F.lit(1e-300))) + F.col("top")).alias("rest"))
        second = first.join(both, ["company", "town"], "left")
        # ``l`` less the pair's own part against the company's other places.
        message = F.when(F.col("rest").isNull(), 0.0).otherwise(_clip(-softplus(F.col("rest") - (F.col("l") - softplus(eta)))))
        damped = second.select(
            "page", "company", "town", "theta",
            (0.5 * F.col("m_page") + 0.5 * F.col("new_page")).alias("m_page"),
            (0.5 * F.col("m_company") + 0.5 * message).alias("m_company"),
            (F.col("theta") + F.col("m_page") + F.col("m_company")).alias("_before"),
        )
        moved = F.abs(sigmoid(F.col("theta") + F.col("m_page") + F.col("m_company")) - sigmoid(F.col("_before")))
        table = stored(damped.withColumn("_moved", moved))
        largest = table.agg(F.max("_moved")).first()[0]
        if older is not None:
            release(older)
        older, state = table, table.drop("_before", "_moved")
        if largest is None or largest < tolerance:
            done = True
            break
    if not done:
        warnings.warn(f"beliefs have not converged in {rounds} rounds: the last moved one by {largest:.2g}", stacklevel=2)
    whole = state.unionByName(start.where("not tied").drop("tied"))
    return whole.select("page", "company", sigmoid(F.col("theta") + F.col("m_page") + F.col("m_company")).alias("confidence"))


def match(pages: DataFrame, companies: DataFrame, places: DataFrame) -> DataFrame:
    """(page, company, confidence) of all candidate pairs.  Runs jobs: see ``scored`` and ``propagate``."""
    pages = pages.where("page is not null").dropDuplicates(["page"])
    companies = companies.where("company is not null").dropDuplicates(["company"])
    pairs = stored(described_pairs(stored(page_parts(pages, places)), stored(company_parts(companies, places))))
    return propagate(scored(with_trade(pairs, trade_words(pairs))))

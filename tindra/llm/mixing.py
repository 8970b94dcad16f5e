"""Mixing of sources to target shares of all tokens.

1. *Posteriors.*  A classifier (softmax regression on hashed words and length) is
   fitted on a bounded sample of the labelled table, at most ``SAMPLE`` documents of each
   source that has a target, and tempered on the part of the sample that was held out.  A
   document's probabilities over the domains (the sources with a target) join what its
   text says with the label that the table gives it, which is trusted with ``TRUST``.
2. *Rates.*  Each document gets a rate, the expected number of its copies, between 0
   and its source's ``max_repeats``.  From one flat rate for all, projected gradient
   descent on least squares makes the expected token totals of the domains match the
   targets.  A step needs one short vector of residuals, which one aggregation over all
   documents gives; it is taken with momentum, and the rounds end when the projected
   gradient is small.  Documents are never shuffled for it.
3. *Copies.*  A rate becomes a whole number by a hash of the document's key; the
   rounding point of each source is set from a histogram so that rounding leaves the
   source's tokens as they were fitted.

The total is the greatest at which every domain that has documents can meet its share
within its repeats, unless it is given.

Defined results: documents without source, or of a source without target, have rate
0; null and empty texts have no tokens and rate 0; a source without tokens is
reported with share 0, and the shares of the others then keep their proportions.
Document keys are taken to be unique.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.llm.encoding import TOKENIZERS, tokenizer
from tindra.operators.sampling import least_hashed_of_each
from tindra.session import release, stored

#: Labelled documents of each source that the classifier is fitted on, at most.
SAMPLE = 500
#: How far the table's label is trusted before the text is read.
TRUST = 0.99
_HASHES, _LENGTHS = 4096, 18
#: Features in all: hashed words, classes of length, and a constant.
_WIDTH = _HASHES + _LENGTHS + 1
_BUCKETS = 2000
_WORD = re.compile(r"\S+")


@lru_cache(maxsize=200_000)
def _slot(word: str) -> int:
    return zlib.crc32(word.encode()) % _HASHES


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the distinct features of each whole text, end to end."""
    rows, ids = [], []
    for k, text in enumerate(texts):
        own = {_slot(w) for w in _WORD.findall(text.lower())}
        own.add(_HASHES + min(len(text).bit_length(), _LENGTHS - 1))
        own.add(_WIDTH - 1)
        ids.extend(own)
        rows.append(len(own))
    return np.array(ids, dtype=np.int64), np.concatenate(([0], np.cumsum(rows, dtype=np.int64))).astype(np.int64)


@dataclass
class Domains:
    """Log likelihoods of texts by domain, up to a constant for each text: the sample gives all domains the same weight."""

    weights: np.ndarray
    temper: float = 1.0

    def scores(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = self.weights.shape[1]
        return np.add.reduceat(self.weights[ids], offsets[:-1], axis=0) * self.temper if len(offsets) > 1 else np.zeros((0, n))

    def posteriors(self, texts: list[str], label: np.ndarray, trust: float = TRUST) -> np.ndarray:
        """Probabilities over the domains; ``label`` is the number of the document's own domain, -1 for none."""
        n = self.weights.shape[1]
        prior = np.full((len(texts), n), 1.0 / n)
        known = np.flatnonzero(label >= 0)
        if n > 1:
            prior[known] = (1 - trust) / (n - 1)
            prior[known, label[known]] = trust
        return _softmax(self.scores(*features(texts)) + np.log(prior))


def _softmax(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    return p / p.sum(1, keepdims=True) if len(scores) else p


def fit_softmax(ids: np.ndarray, offsets: np.ndarray, label: np.ndarray, n: int, rounds: int = 60, l2: float = 0.02, rate: float = 0.1) -> np.ndarray:
    """Weights of a softmax regression with classes of equal weight, by full-batch Adam."""
    weights = np.zeros((_WIDTH, n))
    a, b = np.zeros_like(weights), np.zeros_like(weights)
    one = np.eye(n)[label]
    balance = (len(label) / n / np.maximum(np.bincount(label, minlength=n), 1))[label][:, None]
    rows = np.repeat(np.arange(len(label)), np.diff(offsets))
    for k in range(1, rounds + 1):
        error = (_softmax(Domains(weights).scores(ids, offsets)) - one) * balance
        g = np.stack([np.bincount(ids, error[rows, c], _WIDTH) for c in range(n)], 1) + l2 * weights
        a += 0.1 * (g - a)
        b += 0.01 * (g * g - b)
        weights = weights - rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return weights


def fit_domains(documents: DataFrame, targets: list[str], sample: int = SAMPLE) -> Domains:
    """The classifier of the domains.  Only features of a bounded number of documents come to the driver, not their texts."""
    place = {s: k for k, s in enumerate(targets)}
    rows = least_hashed_of_each(documents.where(F.col("text") != "").select("doc_id", "text", "source"), "doc_id", "source", targets, sample, 5)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, offsets = features(frame["text"].tolist())
            yield pd.DataFrame({"h": frame["text"].map(lambda t: zlib.crc32(t.encode())), "source": frame["source"], "ids": np.split(ids, offsets[1:-1]) if len(frame) else []})

    taken = rows.select("text", "source").mapInPandas(read, "h bigint, source string, ids array<int>").collect()
    taken = sorted(taken, key=lambda r: (r.h, r.source, r.ids))
    n = len(targets)
    if not taken:
        return Domains(np.zeros((_WIDTH, n)))
    label = np.array([place[r.source] for r in taken])
    pack = lambda at: (np.concatenate([taken[k].ids for k in at]).astype(np.int64), np.concatenate(([0], np.cumsum([len(taken[k].ids) for k in at]))))
    held = np.arange(len(taken)) % 5 == 4
    train, rest = np.flatnonzero(~held), np.flatnonzero(held)
    weights = fit_softmax(*pack(train), label[train], n)
    if not len(rest):
        return Domains(weights)
    scores = Domains(weights).scores(*pack(rest))
    likely = lambda t: np.log(_softmax(scores * t)[np.arange(len(rest)), label[rest]] + 1e-12).sum()
    return Domains(weights, max(np.linspace(0.02, 1.0, 50), key=likely))


def sized(documents: DataFrame, model: Domains, targets: list[str], path: str) -> DataFrame:
    """(doc_id, source, tokens, p) of every document; texts are read once, here."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = {s: k for k, s in enumerate(targets)}

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizer(path)
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            label = np.array([place.get(s, -1) for s in frame["source"]], dtype=np.int64)
            sizes = [len(x) for x in encoder.encode_ordinary_batch(texts, num_threads=1)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "source": frame["source"], "tokens": sizes, "p": list(shared.value.posteriors(texts, label))})

    rows = documents.select("doc_id", "text", "source")
    return rows.mapInPandas(measure, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, tokens bigint, p array<double>")


def _plan(targets: DataFrame) -> list[tuple[str, float, float]]:
    """The table of targets: a configuration of a few rows."""
    rows = targets.where("source is not null").dropDuplicates(["source"]).orderBy("source").collect()
    return [(r.source, float(r.target_share or 0.0), float(r.max_repeats or 0)) for r in rows]


def _walked(batch: pa.RecordBatch, steps: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, rates, the points ahead of them and the last moves (of the projected step, of the rate) after ``steps``, each a gradient by residual and a momentum."""
    cap, scale, rate, ahead = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cap", "scale", "rate", "ahead"))
    p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(len(cap), -1)
    moves = np.zeros((2, len(cap)))
    for pull, momentum in steps:
        new = np.clip(ahead - scale * (p @ pull), 0.0, cap)
        moves = np.stack((new - ahead, new - rate))
        ahead = new + momentum * (new - rate)
        rate = new
    return p, rate, ahead, moves


def _sums(rows: DataFrame, n: int, steps: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Over all documents: expected tokens of each domain at the points ahead, the tokens the last projected step moved, and whether momentum went against it."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            p, _, ahead, (step, move) = _walked(batch, steps)
            tokens, scale = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tokens", "scale"))
            against = -(step * move * tokens / np.where(scale > 0, scale, np.inf)).sum()
            total += np.concatenate(((ahead * tokens) @ p, [(np.abs(step) * tokens).sum(), against]))
        yield pa.RecordBatch.from_pydict({"s": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = rows.select("tokens", "p", "cap", "scale", "rate", "ahead").mapInArrow(partial, "s array<double>").agg(*(F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(n + 2))).first()
    return np.array([float(x or 0.0) for x in parts])


def _moved(rows: DataFrame, steps: list[tuple[np.ndarray, float]]) -> DataFrame:
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rate, ahead, _ = _walked(batch, steps) if batch.num_rows else (None, np.zeros(0), np.zeros(0), None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(rate), pa.array(ahead)], schema=batch.schema)

    return stored(rows.mapInArrow(move, rows.schema))


def fit_rates(documents: DataFrame, plan: list[tuple[str, float, float]], total: float | None = None, tolerance: float = 1e-5, rounds: int = 500) -> tuple[DataFrame, dict]:
    """The documents with their rate, and what was fitted.  ``documents`` as from ``sized``, stored.

    Rounds end when a projected step moves less than ``tolerance`` of the total;
    ``converged`` tells it from the end of ``rounds``, of which there is a warning too.
    ``residual`` is that of the rates returned, relative to the target of each domain.
    """
    names, n = [s for s, _, _ in plan], len(plan)
    share, cap = np.array([x for _, x, _ in plan]), np.array([c for _, _, c in plan])
    table = documents.sparkSession.createDataFrame([(s, k, float(cap[k])) for k, s in enumerate(names)], "source string, k int, cap double")
    joined = documents.join(F.broadcast(table), "source", "left")  # the few targets
    own = F.col("p")[F.col("k")] * F.col("tokens")
    held = {r.k: (float(r.t or 0), float(r.o or 0)) for r in joined.where("k is not null").groupBy("k").agg(F.sum("tokens").alias("t"), F.sum(own).alias("o")).collect()}
    tokens = np.array([held.get(k, (0.0, 0.0))[0] for k in range(n)])
    sure = np.array([held.get(k, (0.0, 0.0))[1] for k in range(n)])
    usable = (tokens > 0) & (share > 0) & (cap > 0)
    if total is None:  # what a domain's own documents can give at most
        total = float(min((cap * sure)[usable] / share[usable], default=0.0))
    goal = np.where(usable, total * share, 0.0)
    how = {"names": names, "share": share, "cap": cap, "total": total, "goal": goal, "residual": np.zeros(n), "rounds": 0, "projected_gradient": 0.0, "converged": True}
    if not usable.any() or total <= 0:
        return joined.withColumn("rate", F.lit(0.0)), how
    # All start at one rate; a step is scaled by the rate that a domain's own documents would need.
    flat, need = float(goal.sum() / tokens[usable].sum()), np.where(usable, goal / np.maximum(tokens, 1.0), 0.0)
    of_source = lambda values: F.element_at(F.array(*(F.lit(float(x)) for x in values)), F.col("k") + 1)
    rows = joined.where("k is not null").withColumns({"cap": of_source(np.where(usable, cap, 0.0)), "scale": of_source(need)})
    rows = rows.withColumn("rate", F.least(F.lit(flat), F.col("cap"))).withColumn("ahead", F.col("rate"))
    # A document's rate is a function of what it holds and of the residuals of all rounds; ``steps`` are those since the last stored table.
    steps: list[tuple[np.ndarray, float]] = []
    done, age, length, moved, older_rows = 0, 1.0, 1.0, np.inf, None
    relative = lambda sums: np.where(usable, (sums[:n] - goal) / np.maximum(goal, 1.0), 0.0)
    while True:
        sums = _sums(rows, n, steps)
        residual = relative(sums)
        moved = sums[n] / goal.sum() if done else np.inf
        if moved < tolerance or done >= rounds:
            break
        if not done:  # no greater step is safe with momentum: the norm of the problem is at most this
            length = 1.0 / max(1.0, (1.0 + relative(_sums(rows.withColumn("ahead", F.col("scale")), n, [])))[usable].max())
        if len(steps) == 25:
            rows, steps = _moved(rows, steps), []
            if older_rows is not None:
                release(older_rows)
            older_rows = rows
        if done and sums[n + 1] > 0:
            age = 1.0
        older, age = age, (1.0 + np.sqrt(1.0 + 4.0 * age * age)) / 2.0
        steps = [*steps, (residual * length, (older - 1.0) / age)]
        done += 1
    rows = _moved(rows, steps)
    how |= {"residual": relative(_sums(rows.withColumn("ahead", F.col("rate")), n, [])), "rounds": done, "projected_gradient": float(moved), "converged": bool(moved < tolerance)}
    if not how["converged"]:
        warnings.warn(f"rates have not converged in {done} rounds: the last step moved {moved:.2g} of all tokens", stacklevel=2)
    return rows.drop("ahead", "scale").unionByName(joined.where("k is null").withColumn("rate", F.lit(0.0))), how


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, tokens, p, rate, copies) of every document.  Fits the classifier and the rates; stores the sizes."""
    plan = _plan(targets)
    names = [s for s, _, _ in plan]
    model = fit_domains(documents, names)
    sizes = stored(sized(documents, model, names, f"{folder}/{vocabulary}.tiktoken"))
    fitted, how = fit_rates(sizes, plan, total)
    fitted = fitted.select("doc_id", "source", "k", "tokens", "p", "rate", "cap")
    # Rounded up where the hash falls below the fraction; the point is moved for each source until rounding leaves its tokens as they are.
    u = (F.xxhash64(F.lit(17), "doc_id") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    fraction = F.col("rate") - F.floor("rate")
    rows = fitted.withColumn("_gap", F.when(fraction > 0, u - fraction))
    bucket = F.floor((F.col("_gap") + 1) * _BUCKETS / 2).cast("int")
    counted = rows.where("k is not null and tokens > 0").groupBy("k", bucket.alias("b")).agg(F.sum("tokens").alias("t"), F.sum(fraction * F.col("tokens")).alias("need"))
    table = counted.toPandas()  # at most (sources) x (buckets) rows
    limits = []
    for k in range(len(names)):
        own = table[table["k"] == k]
        up = own.dropna(subset=["b"]).sort_values("b")
        total_up = np.concatenate(([0.0], up["t"].cumsum().to_numpy(float)))
        at = int(np.abs(total_up - up["need"].sum()).argmin())
        limits.append(-1.0 if at == 0 else float(up["b"].iloc[at - 1] + 1) * 2 / _BUCKETS - 1)
    point = F.element_at(F.array(*(F.lit(x) for x in limits or [-1.0])), F.coalesce(F.col("k"), F.lit(0)) + 1)
    copies = F.floor("rate") + F.when(F.col("k").isNotNull() & F.col("_gap").isNotNull() & (bucket < F.round((point + 1) * _BUCKETS / 2)), 1).otherwise(0)
    return rows.select("doc_id", "source", "tokens", "p", "rate", F.when(F.col("tokens") > 0, copies).otherwise(0).cast("int").alias("copies"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: what was available and used, the share reached, and the share expected by posterior."""
    names = [s for s, _, _ in _plan(targets)]
    used = F.col("copies") * F.col("tokens")
    per = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available_tokens"), F.sum(used).alias("used_tokens"), F.max("copies").alias("most_copies"))
    whole = mixed.agg(F.sum(used).alias("all_tokens"), *(F.sum(used * F.col("p")[k]).alias(f"_e{k}") for k in range(len(names))))
    expected = F.element_at(F.array(*(F.col(f"_e{k}") for k in range(len(names)))), F.array_position(F.array(*(F.lit(s) for s in names)), F.col("source")).cast("int")) if names else F.lit(None)
    rows = targets.where("source is not null").dropDuplicates(["source"]).join(per, "source", "left").crossJoin(F.broadcast(whole))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "source", "target_share", F.col("max_repeats"), zero("documents").alias("documents"), zero("available_tokens").alias("available_tokens"), zero("used_tokens").alias("used_tokens"),
        F.when(F.col("all_tokens") > 0, zero("used_tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"),
        F.when(F.col("all_tokens") > 0, expected / F.col("all_tokens")).otherwise(0.0).alias("expected_share"),
        zero("most_copies").alias("most_copies"),
    )

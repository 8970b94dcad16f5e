"""The main content of pages without menus, notices, sidebars and footers.

A page is cut into DOM leaf blocks, a text without markup into lines and a title at
its separators; a linear-chain conditional random field labels the sequence and is
decoded by Viterbi.

*Labelled pages.*  Pages whose markup declares a ``<main>`` label themselves: what is
outside is furniture, and inside headings, quotes, list items and sentences are
content.  At most ``sample`` such pages (those with the least hash of their key, so
the choice does not depend on order) are collected for training, each also in forms
without the declaring markup: with other element and class names, as extracted text,
and as loose lines.  So the model has to know the others by their text, by their
ancestors as compared with the headline's, and by their neighbours.

Defined results: null, empty and JSON bodies have no content; neither have texts of
which no line is content.  Where no page declares its main part nothing can be learnt
and nothing is found.  Texts are taken whole.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.llm.crf import LinearChain
from tindra.llm.page_blocks import Block, html_blocks, is_html, line_blocks, page_context, page_features, sequence_context, sequence_features, text_features, words
from tindra.operators.sampling import least_hashed

OUTSIDE, HEADLINE, CONTENT, INSIDE = range(4)
#: Training pages at most.
SAMPLE = 400
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_TITLE_CUT = re.compile(r"\s+(?:[|»>·•–-]|//)\s+|^(?:[^\W\d_]+): ")


def is_json(text: str) -> bool:
    if text.lstrip()[:1] not in ("{", "["):
        return False
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def label_page(blocks: list[Block]) -> list[int]:
    """The labels of a page that declares its main part."""
    labels, seen = [], False
    for b in blocks:
        if "main" not in b.ancestors or {"nav", "aside", "footer"} & set(b.ancestors):
            labels.append(OUTSIDE)
        elif b.tag in _HEADINGS:
            labels.append(CONTENT if seen else HEADLINE)
            seen = True
        elif b.tag in ("blockquote", "li") or b.text[-1:] in ".!?»" and len(words(b.text)) >= 4:
            labels.append(CONTENT)
        else:
            labels.append(INSIDE)
    return labels


def _as_text(blocks: list[Block], labels: list[int], rng: random.Random) -> tuple[list[Block], list[int]]:
    """The page as a text extractor leaves it: links of a menu in one line or as a list."""
    out, own = [], []
    together, bullets = rng.random() < 0.5, rng.random()
    separator = rng.choice([" | ", " / ", "  ", " · "])
    k = 0
    while k < len(blocks):
        b = blocks[k]
        end = k
        while end < len(blocks) and labels[end] == OUTSIDE and blocks[end].container == b.container and blocks[end].linked > 0.8 and len(blocks[end].text) < 40 and "nav" in blocks[end].ancestors:
            end += 1
        if together and end - k > 1:
            out.append(Block(separator.join(x.text for x in blocks[k:end]), [0]))
            own.append(OUTSIDE)
            k = end
            continue
        out.append(Block(("- " if b.tag == "li" and rng.random() < bullets else "") + b.text, [0]))
        own.append(labels[k])
        k += 1
    return out, own


def _furniture(pages: list[tuple[list[Block], list[int]]]) -> list[str]:
    """Texts that are furniture wherever they stand.

    A sentence outside of the main part that reads like the sentences inside (a teaser)
    tells nothing without its place and is left out: it is known by its word pairs.
    """
    pairs: Counter = Counter()
    for blocks, labels in pages:
        for b, y in zip(blocks, labels, strict=True):
            if y == CONTENT:
                w = words(b.text)
                pairs.update(set(zip(w, w[1:], strict=False)))
    found = []
    for blocks, labels in pages:
        for b, y in zip(blocks, labels, strict=True):
            if y in (OUTSIDE, INSIDE) and not _is_teaser(b):
                w = words(b.text)
                known = sum(pairs[p] > 2 for p in zip(w, w[1:], strict=False)) / max(len(w) - 1, 1)
                if not (len(w) > 5 and known > 0.5):
                    found.append(b.text)
    return found


def _is_teaser(b: Block) -> bool:
    return "aside" in b.ancestors and (b.tag == "li" or b.linked > 0.8)


def _loose(pages: list[tuple[list[Block], list[int]]], rng: random.Random) -> tuple[list[list[list[str]]], list[list[int]]]:
    """Sequences of content and furniture lines in any order, as records carry them."""
    furniture = _furniture(pages)
    content = [b.text for blocks, labels in pages for b, y in zip(blocks, labels, strict=True) if y == CONTENT and b.text[-1:] in ".!?»"]
    sequences, labels = [], []
    for _ in range(4 * len(pages)):
        lines = [(rng.choice(furniture), OUTSIDE) for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 4)))] if furniture else []
        lines += [(rng.choice(content), CONTENT) for _ in range(rng.choice((0, 1, 1, 2, 2, 3)))] if content else []
        rng.shuffle(lines)
        if lines:
            sequences.append([text_features(t) for t, _ in lines])
            labels.append([y for _, y in lines])
    return sequences, labels


def title_parts(title: str) -> list[str]:
    """A title cut at its separators."""
    parts = [p.strip() for p in _TITLE_CUT.split(title)]
    return [p for p in parts if p] or [title.strip()]


def _titles(pages: list[tuple[list[Block], list[int]]], rng: random.Random) -> tuple[list[list[list[str]]], list[list[int]]]:
    """Headlines with and without furniture around them, and furniture alone."""
    other = _furniture(pages)
    heads = [b.text for blocks, labels in pages for b, y in zip(blocks, labels, strict=True) if y == HEADLINE or _is_teaser(b) and len(words(b.text)) > 2]
    sequences, labels = [], []
    if not other:
        return sequences, labels
    for head in heads:
        for kind in range(3):
            parts = [(p, HEADLINE) for p in title_parts(head)]
            if kind == 0:
                before, after = [], []
            else:
                before = [(rng.choice(other), OUTSIDE) for _ in range(rng.choice((0, 0, 1, 2)))]
                after = [(rng.choice(other), OUTSIDE) for _ in range(rng.choice((0, 0, 1, 2)))]
            parts = [*before, *parts, *after] if kind < 2 else [*before, *after] or [(rng.choice(other), OUTSIDE)]
            features = [[*text_features(t), f"parts={min(len(parts), 3)}"] for t, _ in parts]
            sequences.append(features)
            labels.append([y for _, y in parts])
            if kind == 0 and len(words(head)) > 2 and rng.random() < 0.3:
                # A title of words that no page of the sample has is a headline rather than furniture.
                sequences.append([[f for f in own if f[:2] not in ("w=", "b=", "p=") and not f.startswith(("first=", "last="))] for own in features])
                labels.append([HEADLINE] * len(features))
    return sequences, labels


def _renamed(blocks: list[Block], rng: random.Random) -> list[Block]:
    """The page as another author would have marked it up: other names of classes and, by chance, of its elements; ``main`` is always another."""
    css = f"c{rng.randrange(900)}", f"c{rng.randrange(900)}", f"c{rng.randrange(900)}"
    tags: dict[str, str] = {}
    regions: dict[str, str] = {}
    result = []
    for b in blocks:
        tag = tags.setdefault(b.tag, rng.choice((b.tag, "div", "td", "span", "p")))
        inside = [regions.setdefault(a, rng.choice(("", "", "section", "article", "table") if a == "main" else (a, "", "section", "article", "table"))) for a in b.ancestors]
        result.append(replace(b, css=css[0 if b.tag in ("p", "span") else 1 if b.tag in _HEADINGS else 2], tag=tag, ancestors=tuple(a for a in inside if a)))
    return result


def train(pages: list[tuple[str, str]], seed: int = 7) -> dict[str, LinearChain]:
    """The models for pages, extracted texts, loose lines and titles from (url, body) of pages that declare a main part."""
    rng = random.Random(seed)
    read = [(url, *html_blocks(body)) for url, body in pages]
    read = [(url, blocks, title, label_page(blocks)) for url, blocks, title in read if blocks]
    read = [r for r in read if HEADLINE in r[3]]
    x, y = [], []
    for url, blocks, title, labels in read:
        if rng.random() < 0.3:
            x.append(page_features(blocks, title, url))
            y.append(labels)
        x.append(page_features(_renamed(blocks, rng), title, url))
        y.append(labels)
    models = {"page": LinearChain(4).fit(x, y)}
    texts = [(url, *_as_text(blocks, labels, rng)) for url, blocks, _, labels in read for _ in range(2)]
    models["text"] = LinearChain(4).fit([sequence_features(blocks, url) for url, blocks, _ in texts], [labels for _, _, labels in texts])
    bare = [(blocks, labels) for _, blocks, _, labels in read]
    models["lines"] = LinearChain(4).fit(*_loose(bare, rng))
    models["title"] = LinearChain(4).fit(*_titles(bare, rng))
    return models


#: Texts, and contexts, whose score is remembered, at most: menus and notices recur on page after page.
_REMEMBERED = 50_000
#: Texts that are decoded at once.
_AT_ONCE = 500


def _recalled(model: LinearChain, kind: str, key, features) -> np.ndarray:
    known = model.__dict__.setdefault(kind, {})
    if (own := known.get(key)) is None:
        if len(known) >= _REMEMBERED:
            known.clear()
        own = known[key] = model.score(features())
    return own


def _scores(model: LinearChain, blocks: list[Block], context: list[list[str]] | None = None) -> np.ndarray:
    """The scores of blocks by their texts and what else is known of them."""
    scores = np.zeros((len(blocks), model.labels))
    for k, b in enumerate(blocks):
        own = _recalled(model, "texts", b.text, lambda b=b: text_features(b.text))
        scores[k] = own if context is None else own + _recalled(model, "contexts", tuple(context[k]), lambda k=k: context[k])
    return scores


def _labels(model: LinearChain, blocks: list[Block], context: list[list[str]] | None = None) -> list[int]:
    return model.viterbi(_scores(model, blocks, context))


def contents(texts: list[str], urls: list[str], kind: str, models: dict[str, LinearChain]) -> list[list[int]]:
    """The numbers of the lines with main content of each text; ``kind`` is page, lines or title."""
    found: list[set[int]] = [set() for _ in texts]
    waiting: dict[str, list[tuple[int, list[list[int]], np.ndarray]]] = {}
    for k, (text, url) in enumerate(zip(texts, urls, strict=True)):
        if not text or not text.strip() or is_json(text):
            continue
        if kind == "title":
            model = models["title"]
            for n, line in enumerate(text.split("\n")):
                parts = title_parts(line) if line.strip() else []
                size = f"parts={min(len(parts), 3)}"
                if parts:
                    scores = np.array([_recalled(model, "texts", (p, size), lambda p=p, size=size: [*text_features(p), size]) for p in parts])
                    waiting.setdefault("title", []).append((k, [[n]] * len(parts), scores))
            continue
        if kind == "page" and is_html(text):
            blocks, title = html_blocks(text)
            name, context = "page", page_context(blocks, title, url)
        elif kind == "page":
            blocks = line_blocks(text)
            name, context = "text", sequence_context(blocks, url)
        else:
            name, blocks, context = "lines", line_blocks(text), None
        waiting.setdefault(name, []).append((k, [b.lines for b in blocks], _scores(models[name], blocks, context)))
    for name, own in waiting.items():
        for (k, lines, _), labels in zip(own, models[name].viterbi_all([s for _, _, s in own]), strict=True):
            found[k].update(n for at, y in zip(lines, labels, strict=True) if y in (HEADLINE, CONTENT) for n in at)
    return [sorted(x) for x in found]


def content_lines(text: str, url: str, kind: str, models: dict[str, LinearChain]) -> list[int]:
    return contents([text], [url], kind, models)[0]


def training_pages(pages: DataFrame, key: str, url: str, body: str, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """(url, body) of at most ``sample`` pages that declare a main part, chosen by the hash of their key."""
    declared = pages.where(F.col(body).rlike(r"(?i)<main[ >]")).select(F.col(key), F.col(url), F.col(body))
    rows = least_hashed(declared, key, sample, 11).collect()
    return [(r[1] or "", r[2]) for r in rows]


def extract(df: DataFrame, key: str, text: str, kind: str, models: dict[str, LinearChain], url: str | None = None) -> DataFrame:
    """(record_id, line_no, line) of the lines with main content.  No shuffle but the one that counts repeated rows once."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    rows = df.select(F.col(key).cast("string").alias("record_id"), (F.col(url) if url else F.lit("")).cast("string").alias("url"), F.col(text).cast("string").alias("text"))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frames:
            for start in range(0, len(frame), _AT_ONCE):
                part = frame.iloc[start : start + _AT_ONCE]
                texts, out = part["text"].tolist(), []
                for record, text, numbers in zip(part["record_id"], texts, contents(texts, [u or "" for u in part["url"]], kind, own), strict=True):
                    lines = text.split("\n") if numbers else []
                    out.extend((record, k, lines[k]) for k in numbers)
                yield pd.DataFrame(out, columns=["record_id", "line_no", "line"])

    found = rows.where(r"record_id is not null and text rlike '\\S'").mapInPandas(find, "record_id string, line_no int, line string")
    return found.dropDuplicates(["record_id", "line_no"])

"""The leaf blocks of a page, or of a text, and what can be said about each of them."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from html import unescape

# Elements by what they do to the flow of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
WRAPPER_TAGS = frozenset("tr tbody thead tfoot ul ol dl".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN_TAGS = frozenset("head script style template noscript svg title iframe select".split())
REGIONS = frozenset("main article aside nav header footer section form table".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9-]*)([^>]*)>|([^<]+|<)", re.DOTALL)
_CLASS = re.compile(r"class\s*=\s*[\"']?([\w -]+)")


@dataclass
class Block:
    text: str
    lines: list[int]
    tag: str = ""
    ancestors: tuple[str, ...] = ()
    container: int = 0
    linked: float = 0.0
    css: str = ""


def is_html(text: str) -> bool:
    return bool(re.match(r"\s*<(?:!doctype|html|head|body|[a-z]+[ >])", text[:300], re.IGNORECASE))


def html_blocks(text: str) -> tuple[list[Block], str]:
    """Leaf blocks of a page in order, and its title.

    A leaf block is the text between two borders of block elements; a span that
    begins a run of text is a block too.  The container of a block is its parent, of a
    table cell the table and of a list item what holds the list; blocks with the same
    number have the same container.
    """
    stack: list[tuple[str, int, str]] = [("", 0, "")]
    elements = 0
    blocks: list[Block] = []
    parts: list[tuple[int, str, bool]] = []  # place, text, in a link
    title: list[str] = []
    linked = 0
    breaks = [found.start() for found in re.finditer("\n", text)]

    def flush() -> None:
        if parts and any(p[1].strip() for p in parts):
            joined = " ".join(unescape(p[1]) for p in parts)
            lines = set()
            for at, part, _ in parts:
                line = bisect_left(breaks, at)
                for k, piece in enumerate(part.split("\n")):
                    if piece.strip():
                        lines.add(line + k)
            size = sum(len(p[1].strip()) for p in parts)
            tag, _, css = stack[-1]
            parent = next(e[1] for e in reversed(stack[:-1] or stack) if e[0] not in WRAPPER_TAGS)
            blocks.append(Block(re.sub(r"\s+", " ", joined).strip(), sorted(lines), tag, tuple(e[0] for e in stack if e[0] in REGIONS), parent, sum(len(p[1].strip()) for p in parts if p[2]) / max(size, 1), css))
        parts.clear()

    for found in _TOKEN.finditer(text):
        close, tag, attributes, run = found.groups()
        if run is not None:
            if stack[-1][0] == "title":
                title.append(run)
            elif not any(e[0] in UNSEEN_TAGS for e in stack[-3:]):
                parts.append((found.start(), run, linked > 0))
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            linked = 0 if close else 1
            continue
        if tag not in BLOCK_TAGS and tag not in UNSEEN_TAGS and not (tag == "span" and (close or not any(p[1].strip() for p in parts))):
            continue
        if close:
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), None)
            if at is not None:
                flush()
                del stack[at:]
            continue
        flush()
        linked = 0
        if tag in ("li", "p", "td", "tr", "option", "dt", "dd") and stack[-1][0] == tag:
            stack.pop()
        if tag in VOID_TAGS or attributes.endswith("/"):
            continue
        elements += 1
        css = _CLASS.search(attributes)
        stack.append((tag, elements, css[1].strip() if css else ""))
    flush()
    return blocks, re.sub(r"\s+", " ", unescape("".join(title))).strip()


def line_blocks(text: str) -> list[Block]:
    """The lines of a text that is no page."""
    return [Block(re.sub(r"\s+", " ", line).strip() if "  " not in line else line.strip(), [k]) for k, line in enumerate(text.split("\n")) if line.strip()]


def slug(text: str) -> str:
    text = text.lower().replace("ø", "o").replace("æ", "ae").replace("å", "a")
    return re.sub(r"[^a-z0-9]+", "-", unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()).strip("-")


def is_headline(text: str, title: str, url_slug: str) -> bool:
    """Whether a block is what the page's title or its address calls the page."""
    if len(text) < 3:
        return False
    core = re.sub(r"^[-•*] ", "", text)
    if title:
        head = title[: title.rfind(" | ")] if " | " in title else title
        if core == head or core == title:
            return True
    own = slug(core)
    if not url_slug or len(own) < 3:
        return False
    bare = re.sub(r"-*\d*$", "", url_slug)
    return own == bare or own == url_slug or (len(bare) >= 12 and own.startswith(bare)) or (len(bare) >= 12 and own[: len(bare) - 1] == bare[:-1])


_WORDS = re.compile(r"[^\W\d_]+|\d+")


def words(text: str) -> list[str]:
    return ["0" if w[0].isdigit() else w for w in _WORDS.findall(text.lower())]


def text_features(text: str) -> list[str]:
    """Features of a block's text alone."""
    bare = re.sub(r"^[-•*] ", "", text).strip()
    w = words(bare)
    n = len(w)
    out = ["bias", f"n={n if n < 6 else 6 + min((n - 6) // 4, 6)}"]
    out.extend({"w=" + x for x in w})
    out.extend({f"b={a}_{b}" for a, b in zip(w, w[1:], strict=False)})
    out.extend({"p=" + x[:6] for x in w if len(x) > 6})
    if w:
        out += [f"first={w[0]}", f"last={w[-1]}"]
    end = bare[-1:] if bare else ""
    sentence = end in ".!?…»\"" and n >= 4
    out.append("sentence" if sentence else "no sentence")
    out.append(f"sentences={min(len(re.findall(r'[.!?](?: |$)', bare)), 4)}")
    if bare.startswith(("– ", "— ", "«")):
        out.append("quote")
    separators = bare.count(" | ") + bare.count(" · ") + bare.count(" / ") + bare.count("  ") + bare.count(" » ") + bare.count(" > ") + bare.count(" • ")
    out.append(f"separators={min(separators, 3)}")
    capital = sum(1 for x in re.findall(r"[^\W\d_]+", bare) if x[0].isupper())
    out.append(f"capital={int(4 * capital / max(n, 1))}")
    if any(c.isdigit() for c in bare):
        out.append("digits")
    if "©" in bare:
        out.append("©")
    if n >= 8:
        out.append("long sentence" if sentence else "long")
    return out


def page_context(blocks: list[Block], title: str, url: str) -> list[list[str]]:
    """Features of each block of a page but for its text: its tag and ancestors, alone and against those of the headline, its container and its place."""
    path = [s for s in re.sub(r"^[a-z]+://[^/]*", "", url or "").split("?")[0].split("/") if s]
    url_slug = path[-1] if path else ""
    heads = [k for k, b in enumerate(blocks) if is_headline(b.text, title, url_slug)]
    by_container: dict[int, list[Block]] = {}
    for b in blocks:
        by_container.setdefault(b.container, []).append(b)
    # Of several blocks that could be the headline, the one in the container with most sentences.
    sentences = {c: sum(1 for b in own if b.text[-1:] in ".!?»" and len(b.text) > 40) for c, own in by_container.items()}
    head = max(heads, key=lambda k: (sentences[blocks[k].container], blocks[k].linked < 0.5, -k), default=None)
    order = {c: k for k, c in enumerate(by_container)}
    links = {c: int(3 * sum(x.linked > 0.8 for x in own) / len(own)) for c, own in by_container.items()}
    main = blocks[head].container if head is not None else None
    css = Counter(b.css for b in blocks)
    common = css.most_common(1)[0][0] if css else ""
    has_main = any("main" in b.ancestors for b in blocks)
    result = []
    for k, b in enumerate(blocks):
        out = ["linked" if b.linked > 0.8 else "part linked" if b.linked > 0 else "not linked"]
        own = by_container[b.container]
        out.append(f"container links={links[b.container]}")
        out.append(f"container size={min(len(own), 4)}")
        place = "none" if main is None else "same" if b.container == main else "before" if order[b.container] < order[main] else "after"
        out.append("container=" + place)
        sentence = "sentence" if b.text[-1:] in ".!?»" and len(b.text) > 20 else "words"
        out.append(f"container={place} {sentence}")
        if b.linked > 0.8:
            out.append(f"container={place} linked {'long' if len(b.text) > 45 else 'short'}")
        if head is not None:
            out.append("at head" if k == head else "before head" if k < head else "after head")
            if b.css and b.css == blocks[head].css:
                out.append("head's class")
                out.append("head's class " + place)
            out.append("head's ancestors " + sentence if b.ancestors == blocks[head].ancestors else "other ancestors " + sentence)
            out.append("head's tag" if b.tag == blocks[head].tag else "other tag")
        out.append("common class" if b.css == common else "rare class")
        if b.css and b.css != common:
            out.append(f"rare class {place} {sentence}")
        out.append("tag=" + b.tag)
        out.extend("in=" + a for a in set(b.ancestors))
        out.append(f"depth={min(len(b.ancestors), 3)}")
        if has_main:
            inside = "in main " if "main" in b.ancestors else "out of main "
            out += [inside + b.tag, inside + sentence]
        result.append(out)
    return result


def page_features(blocks: list[Block], title: str, url: str) -> list[list[str]]:
    return [text_features(b.text) + own for b, own in zip(blocks, page_context(blocks, title, url), strict=True)]


def sequence_context(blocks: list[Block], url: str) -> list[list[str]]:
    """Features of each line of an extracted text but for its text: its neighbours and its place."""
    path = [s for s in re.sub(r"^[a-z]+://[^/]*", "", url or "").split("?")[0].split("/") if s]
    heads = [k for k, b in enumerate(blocks) if is_headline(b.text, "", path[-1] if path else "")]
    sentence = [b.text[-1:] in ".!?»" and len(b.text) > 30 for b in blocks]
    # Of several, the one that is followed by most sentences.
    head = max(heads, key=lambda k: (blocks[k].text[:2] not in ("- ", "• ", "* "), sum(sentence[k : k + 8]), -k), default=None)
    result = []
    for k, b in enumerate(blocks):
        out = []
        for d in (-2, -1, 1, 2):
            out.append(f"{d}:{'sentence' if 0 <= k + d < len(blocks) and sentence[k + d] else 'words' if 0 <= k + d < len(blocks) else 'end'}")
        if head is not None:
            where = "at head" if k == head else "before head" if k < head else "after head"
            out += [where, f"{where} {'sentence' if sentence[k] else 'words'}"]
        out.append(f"tenth={int(10 * k / len(blocks))}")
        result.append(out)
    return result


def sequence_features(blocks: list[Block], url: str) -> list[list[str]]:
    return [text_features(b.text) + own for b, own in zip(blocks, sequence_context(blocks, url), strict=True)]

"""HTML to content: block lists, inline nodes, and the parts of a place page. Trees are JSON texts with sorted keys."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectorised import vectorised

INLINE = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic"}
HEADINGS = {"h2", "h3", "h4", "h5", "h6"}
SILENT = {"script", "style", "noscript", "template"}


def squeezed(text: str) -> str:
    return " ".join(text.split())


class Blocks(HTMLParser):
    """Gathers paragraphs, headings, lists and images in the order of the document.

    Text outside of them makes paragraphs of its own; a line break ends a paragraph.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.inline: list[dict] = []
        self.marks: list[str] = []
        self.href: str | None = None
        self.heading: int | None = None
        self.items: list[list[dict]] | None = None
        self.ordered = False
        self.silent = 0

    def add(self, text: str) -> None:
        node = {"type": "text", "text": text, **{m: True for m in self.marks}}
        if self.href:
            node = {"type": "link", "url": self.href, "children": [{"type": "text", "text": text}]}
        last = self.inline[-1] if self.inline else None
        same = last and {k: v for k, v in last.items() if k not in ("text", "children")} == {k: v for k, v in node.items() if k not in ("text", "children")}
        if same:
            (last["children"][0] if self.href else last)["text"] += text
        else:
            self.inline.append(node)

    def children(self) -> list[dict]:
        found = []
        for node in self.inline:
            own = node["children"][0] if node["type"] == "link" else node
            own["text"] = " ".join(own["text"].replace("\n", " ").split(" ")) if own["text"].strip() else " "
            own["text"] = (" " if own["text"][:1].isspace() else "") + squeezed(own["text"]) + (" " if own["text"][-1:].isspace() and squeezed(own["text"]) else "")
            found.append(node)
        text = lambda n: n["children"][0] if n["type"] == "link" else n
        if found:
            text(found[0])["text"] = text(found[0])["text"].lstrip()
            text(found[-1])["text"] = text(found[-1])["text"].rstrip()
        self.inline = []
        return [n for n in found if text(n)["text"]]

    def close_block(self) -> None:
        children = self.children()
        if not children:
            return
        if self.items is not None:
            self.items.append(children)
        elif self.heading:
            self.blocks.append({"type": "heading", "level": self.heading, "children": children})
        else:
            self.blocks.append({"type": "paragraph", "children": children})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = dict(attrs)
        if tag in SILENT:
            self.silent += 1
        elif tag in HEADINGS:
            self.close_block()
            self.heading = int(tag[1])
        elif tag in ("ul", "ol"):
            self.close_block()
            self.items, self.ordered = [], tag == "ol"
        elif tag in ("p", "li", "br", "div", "section", "table", "tr"):
            self.close_block()
        elif tag == "img" and at.get("src"):
            self.close_block()
            self.blocks.append({"type": "image", "src": at["src"].strip(), "alt": squeezed(at.get("alt") or "")})
        elif tag in INLINE:
            self.marks.append(INLINE[tag])
        elif tag == "a":
            href = (at.get("href") or "").strip()
            self.href = href if href.startswith(("http://", "https://", "/", "mailto:", "tel:", "#")) else None

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in HEADINGS:
            self.close_block()
            self.heading = None
        elif tag in ("ul", "ol"):
            self.close_block()
            if self.items:
                self.blocks.append({"type": "list", "format": "ordered" if self.ordered else "unordered", "children": [{"type": "list-item", "children": c} for c in self.items]})
            self.items = None
        elif tag in ("p", "li", "div", "section", "table", "tr"):
            self.close_block()
        elif tag in INLINE and INLINE[tag] in self.marks:
            self.marks.remove(INLINE[tag])
        elif tag == "a":
            self.href = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.add(data)

    def finish(self) -> list[dict]:
        self.close()
        self.close_block() if self.items is None else self.handle_endtag("ul")
        return self.blocks


def blocks_of(html: str | None) -> list[dict]:
    parser = Blocks()
    parser.feed(html or "")
    return parser.finish()


@vectorised("string")
def to_blocks(html: pd.Series) -> pd.Series:
    """The blocks of an HTML text; an empty list for null."""
    return html.map(lambda x: json.dumps(blocks_of(x), ensure_ascii=False, sort_keys=True))


@vectorised("string")
def to_inline(html: pd.Series) -> pd.Series:
    """The inline nodes of an HTML text: plain, bold and italic text, and links."""
    return html.map(lambda x: json.dumps([c for b in blocks_of(x) for c in b.get("children", [])], ensure_ascii=False, sort_keys=True))


def block_counts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Per page and type of block, how many there are."""
    kinds = F.from_json(to_blocks(F.col(html)), "array<struct<type: string>>")
    return pages.select(key, F.explode(kinds).alias("b")).groupBy(key, F.col("b.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


class PlacePage(HTMLParser):
    """Questions with answers, route cards, videos, and the running text by headings."""

    VOID = {"img", "br", "hr", "input", "meta", "link", "source", "wbr"}

    def __init__(self, card_links: tuple[str, ...]) -> None:
        super().__init__(convert_charrefs=True)
        self.card_links = card_links
        self.open: list[tuple[str, str]] = []  # tag and role
        self.faqs: list[dict] = []
        self.cards: list[dict] = []
        self.videos: list[str] = []
        self.sections: list[dict] = [{"title": "", "text": ""}]
        self.card: dict = {}
        self.title: str | None = None

    def roles(self) -> set[str]:
        return {role for _, role in self.open}

    def role(self, tag: str, at: dict) -> str:
        kind, prop, classes = at.get("itemtype") or "", at.get("itemprop") or "", (at.get("class") or "").split()
        if kind.endswith("schema.org/Question"):
            self.faqs.append({"question": "", "answer": ""})
            return "question"
        if "question" in self.roles() and prop in ("name", "text"):
            return prop
        if "card" in classes:
            self.card = {"label": "", "url": "", "anchor": ""}
            return "card"
        if "card" in self.roles():
            if tag in ("h2", "h3", "h5"):
                return "label"
            href = at.get("href") or ""
            if tag == "a" and href.startswith(self.card_links) and not self.card["url"]:
                self.card["url"] = href
                return "anchor"
            return ""
        if at.get("id") == "map" or tag in SILENT:
            return "skip"
        if "question" not in self.roles() and tag in ("h2", "h3"):
            self.sections.append({"title": "", "text": ""})
            return "title"
        return "prose" if tag in ("p", "ul", "ol") and "question" not in self.roles() else ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = dict(attrs)
        if tag == "iframe" and (src := (at.get("src") or "").strip()) and ("youtube.com" in src.lower() or "youtu.be" in src.lower()) and src not in self.videos:
            self.videos.append(src)
        if tag not in self.VOID:
            self.open.append((tag, self.role(tag, at)))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            closed, role = self.open.pop()
            if role == "card":
                label = squeezed(self.card["label"] or self.card["anchor"])
                if label and self.card["url"] and all(c["url"] != self.card["url"] for c in self.cards):
                    self.cards.append({"label": label, "url": self.card["url"]})
            if closed == tag:
                break

    def handle_data(self, data: str) -> None:
        roles = self.roles()
        if "skip" in roles:
            return
        if "question" in roles:
            if "name" in roles:
                self.faqs[-1]["question"] += data
            elif "text" in roles:
                self.faqs[-1]["answer"] += data
        elif "card" in roles:
            for role in ("label", "anchor"):
                self.card[role] += data if role in roles else ""
        elif "title" in roles:
            self.sections[-1]["title"] += data
        elif "prose" in roles:
            self.sections[-1]["text"] += data + " "

    def result(self) -> dict:
        self.close()
        clean = lambda x: {k: squeezed(v) for k, v in x.items()}
        faqs = [f for f in map(clean, self.faqs) if f["question"] and f["answer"]]
        sections = [s for s in map(clean, self.sections) if s["title"] or s["text"]]
        return {"faqs": faqs, "cards": self.cards, "videos": self.videos, "sections": sections}


PLACE = (
    "struct<faqs: array<struct<question: string, answer: string>>, cards: array<struct<label: string, url: string>>, "
    "videos: array<string>, sections: array<struct<title: string, text: string>>>"
)


def place_page(card_links: tuple[str, ...] = ("/wandelroutes/", "/fietsroutes/", "/wandelnetwerken/")):
    """A column function: the parts of a place page."""

    @F.pandas_udf(PLACE)
    def of(html: pd.Series) -> pd.DataFrame:
        found = []
        for x in html:
            page = PlacePage(card_links)
            page.feed(x or "")
            found.append(page.result())
        return pd.DataFrame(found, columns=["faqs", "cards", "videos", "sections"])

    return of


def canonical(value: object, drop: tuple[str, ...] = ("id", "documentId")) -> object:
    """A value without its ids, so that two can be compared."""
    if isinstance(value, dict):
        return {k: canonical(v, drop) for k, v in value.items() if k not in drop and v is not None}
    if isinstance(value, list):
        return [canonical(v, drop) for v in value]
    return value


@vectorised("string")
def canonical_json(x: pd.Series) -> pd.Series:
    """JSON with sorted keys, without ids and nulls; null where it can't be read."""

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(canonical(json.loads(text)), sort_keys=True, ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return x.map(one)

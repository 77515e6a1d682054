"""Main text of web pages by tree scoring.

The page is read into a tree of block elements. A paragraph passes points for
its length and commas to its parent and half of them to its grandparent; a
container's points are discounted by the share of its text inside links. The
best container, the paragraphs beside it and those of its siblings that come
near it are kept, without the subtrees that are menus, headers, footers,
sidebars, notices, adverts, forms, code or reader comments by their element,
role, class or id. Of names that an article's own blocks bear as well ("share",
"related", "widget-text") those inside an article count only where the block is
mostly links or holds no sentence.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset("script style textarea title noscript template iframe xmp noembed noframes head nav footer aside form button select dialog menu svg math canvas object audio video map datalist fieldset".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul head title button select textarea script style noscript template iframe".split())
CLOSES_P = BLOCKS - frozenset("head title script style noscript template iframe button select textarea html body".split())
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "option": ("option",), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
LEAVES = frozenset("p pre h1 h2 h3 h4 h5 h6 li blockquote dd dt tr figcaption caption summary address".split())
PRIOR = {"article": 30.0, "main": 15.0, "section": 2.0, "div": 1.0, "body": -3.0, "html": -10.0}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
# Words of class and id names of what is no article, and of what may be one inside an article.
NOISE_WORDS = "ads? adverts? advertisements? advertising adsense banners? breadcrumbs? comments? commentlist disqus cookies? consent gdpr footer masthead menus? nav navbar navigation newsletter popups? modal overlay replies respond sidebars? sponsors? sponsored subscribe subscription toolbar signup login paywall pagination pager"
SUSPECT_WORDS = "header notices? alerts? promos? promotion related recommended reply share sharing social widgets?"


def _named(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words.replace(' ', '|')})(?=$|[\s_-])", re.I)


NOISE, SUSPECT = _named(NOISE_WORDS), _named(SUSPECT_WORDS)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$|[\"'])", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
SIBLING_SHARE = 0.2
LINKED_SHARE = 0.3  # share of link text from which a suspect block of an article is dropped
SENTENCE = re.compile(r"[.,;:!?。，！？…]")


def _tag_end(text: str, at: int) -> int:
    """Index of the > that ends the tag at ``at``, outside quotes if they close; -1: none."""
    end = text.find(">", at)
    while end >= 0:
        part = text[at:end]
        quote = re.search(r"=\s*([\"'])", part)
        if not quote:
            return end
        at += quote.end()
        close = text.find(quote[1], at)
        if close < 0:
            return end
        at = close + 1
        end = text.find(">", at)
    return end


class Page:
    """Block elements in page order with parents, and the text blocks in them."""

    def __init__(self, text: str):
        self.tag, self.parent, self.stop, self.noise, self.suspect = ["#page"], [-1], [0], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.open, self.count = [0], {}
        self.link = 0
        self._parts: list[str] = []
        self._linked = 0
        self._read(text)

    def _flush(self) -> None:
        if self._parts:
            words = " ".join("".join(self._parts).split())
            if words and not self.noise[self.open[-1]]:
                self.blocks.append((self.open[-1], words, min(self._linked, len(words))))
            self._parts, self._linked = [], 0

    def _push(self, tag: str, rest: str) -> None:
        self._flush()
        up = self.open[-1]
        inside = self.count.get("article", 0) > 0
        noise = self.noise[up] or tag in DROPPED or tag == "header" and not inside
        suspect = self.suspect[up]
        if not noise and rest and tag not in ("html", "body", "main", "article"):
            for m in ATTRIBUTE.finditer(rest):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES or name in ("class", "id") and (NOISE.search(value) or not inside and SUSPECT.search(value)):
                    noise = True
                elif name in ("class", "id") and not suspect and SUSPECT.search(value):
                    suspect = len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.stop.append(0)
        self.noise.append(noise)
        self.suspect.append(suspect)
        self.open.append(len(self.tag) - 1)
        self.count[tag] = self.count.get(tag, 0) + 1

    def _pop(self) -> None:
        self._flush()
        k = self.open.pop()
        self.stop[k] = len(self.tag)
        self.count[self.tag[k]] -= 1

    def _close(self, names: tuple[str, ...], within: frozenset = frozenset()) -> None:
        """Close the innermost open element of these names, if one is open."""
        if any(self.count.get(n) for n in names):
            for k in reversed(self.open):
                if self.tag[k] in names:
                    break
                if self.tag[k] in within:
                    return
            while self.tag[self.open[-1]] not in names:
                self._pop()
            self._pop()

    def _text(self, raw: str) -> None:
        if raw:
            s = html.unescape(raw) if "&" in raw else raw
            self._parts.append(s)
            if self.link:
                self._linked += len(s.strip())

    def _read(self, text: str) -> None:
        at, n = 0, len(text)
        while at < n:
            lt = text.find("<", at)
            if lt < 0:
                self._text(text[at:])
                break
            if text.startswith("<!--", lt):
                self._text(text[at:lt])
                end = text.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if text[lt + 1 : lt + 2] in ("!", "?"):
                self._text(text[at:lt])
                end = text.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            closing = text.startswith("</", lt)
            m = NAME.match(text, lt + 1 + closing)
            if not m:
                self._text(text[at : lt + 1])
                at = lt + 1
                continue
            self._text(text[at:lt])
            end = _tag_end(text, m.end())
            if end < 0:
                break
            tag, rest, at = m[0].lower(), text[m.end() : end], end + 1
            if tag == "a":
                self.link = 0 if closing else 1
            elif tag in ("br", "td", "th", "img", "hr", "option"):
                self._text(" ") if tag != "hr" else self._flush()
            elif tag in BLOCKS or tag in DROPPED:
                if closing:
                    self._close((tag,))
                else:
                    if tag in CLOSES_P and self.count.get("p"):
                        self._close(("p",), frozenset(("table", "button", "object")))
                    if tag in SIBLINGS:
                        self._close(SIBLINGS[tag], frozenset(("ul", "ol", "dl", "table")))
                    self._push(tag, rest)
                    if tag in RAW and not rest.endswith("/"):
                        close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
                        at = n if close is None else close.start()
                    if tag in VOID:
                        self._pop()
        while len(self.open) > 1:
            self._pop()
        self._flush()
        self.stop[0] = len(self.tag)

    def _clear(self) -> None:
        """Drop the blocks of suspect elements that are mostly links or hold no sentence."""
        held: dict[int, list[tuple[str, int]]] = {}
        for k, words, in_links in self.blocks:
            if self.suspect[k]:
                held.setdefault(self.suspect[k], []).append((words, in_links))
        drop = set()
        for root, found in held.items():
            size = sum(len(w) for w, _ in found)
            if sum(n for _, n in found) > LINKED_SHARE * size or not any(SENTENCE.search(w) for w, _ in found) and size <= 40:
                drop.add(root)
        if drop:
            self.blocks = [x for x in self.blocks if self.suspect[x[0]] not in drop]

    def main_text(self) -> str:
        """The kept blocks joined by empty lines."""
        self._clear()
        if not self.blocks:
            return ""
        score: dict[int, float] = {}
        size, linked = [0] * len(self.tag), [0] * len(self.tag)
        for k, words, in_links in self.blocks:
            size[k] += len(words)
            linked[k] += in_links
            box = self.parent[k] if self.tag[k] in LEAVES and k else k
            points = (1 + words.count(",") + min(len(words) / 100, 3)) * (1 - in_links / len(words))
            for share in (1.0, 0.5):
                if box >= 0:
                    if box not in score:
                        score[box] = PRIOR.get(self.tag[box], 0.0)
                    score[box] += share * points
                    box = self.parent[box]
        for k in range(len(self.tag) - 1, 0, -1):
            size[self.parent[k]] += size[k]
            linked[self.parent[k]] += linked[k]
        ranked = {k: s * (1 - linked[k] / size[k]) if s > 0 and size[k] else s for k, s in score.items()}
        best = max(ranked, key=lambda k: (ranked[k], -k))
        keep = [k for k in ranked if k == best or self.parent[k] == self.parent[best] and self.tag[k] not in LEAVES and ranked[k] >= SIBLING_SHARE * ranked[best] > 0]
        spans = sorted((k, self.stop[k]) for k in keep)
        beside = self.parent[best]
        bare = self.tag[beside] in ("body", "html", "#page") if beside >= 0 else True

        def kept(k: int, words: str, in_links: int) -> bool:
            if any(a <= k < b for a, b in spans):
                return True
            if self.parent[k] != beside or self.tag[k] not in LEAVES or 2 * in_links > len(words):
                return False
            return not bare or len(words) > 80 or SENTENCE.search(words[-1]) is not None and not in_links

        return "\n\n".join(words for k, words, in_links in self.blocks if kept(k, words, in_links))


def main_text(page: str | None) -> str:
    return Page(page).main_text() if page else ""


def _extract(batches):
    for batch in batches:
        text = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: id, url, text (empty if none), n_chars.

    Null, empty and tagless pages are read like any other; repeated rows and ties of ids give a row each; extra columns
    are ignored; very long pages are read whole, in memory of a few times their size; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col)

"""Records of HTML pages by selectors.

Pages are parsed in Arrow batches by the standard library's tokenizer over a stack of open elements; what a page gives are the fields of a table
of rules. Nothing is kept of a page but the texts that a rule captures.

A rule names a field, its selectors and what it takes: the first match (`first`), all matches (`all`, in document order, outermost first), the number
of matches (`count`), or an attribute (`attr:name`) of the first match. Selectors have tags, classes, ids, attributes (`[name]`, `[name=value]`,
`[name*=part]`), descendants (`div.content p`), children (`ul > li`) and, by comma, several of these, of which the first in the document counts. Behind `|` is
what to take if there is nothing before it, or if the first match before it has under `least` characters.

Defined cases: end tags that close nothing are ignored; an end tag closes what is open inside its element; paragraphs, list items, cells and rows end where
the next one of their kind starts, paragraphs at any block; what is open at the end of the page ends there; `>` in quoted attributes and markup
in comments, scripts and styles is no markup; a null page has no matches: null for `first` and attributes, an empty list, 0. Character references are read
as browsers do, also those that lack their semicolon; with `references` only those named there, with it, and all others stay as they are written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements that end where one of the given elements starts, unless an element of `within` lies between.
ENDS = {"p": (BLOCKS, frozenset()), "li": (frozenset(["li"]), frozenset(["ul", "ol"])), "td": (frozenset(["td", "th", "tr"]), frozenset(["table"])), "th": (frozenset(["td", "th", "tr"]), frozenset(["table"])),
        "tr": (frozenset(["tr"]), frozenset(["table"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "option": (frozenset(["option"]), frozenset(["select"]))}
SKIPPED = frozenset(["script", "style", "noscript", "template"])
PART = re.compile(r"([\w*-]+)|\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$]?=)\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]")

#: A named character reference with its semicolon, or an ampersand that starts none.
REFERENCE = re.compile(r"&(?:(\w+);)?")


@dataclass(frozen=True)
class Rule:
    field: str
    select: str
    take: str = "first"
    least: int = 0  # characters that a first match has at least

    @property
    def kind(self) -> str:
        return {"all": "array<string>", "count": "int"}.get(self.take, "string")


class Step:
    """Conditions on one element, and whether it is a child of what the step before matches."""

    def __init__(self, written: str, child: bool):
        self.child, self.tag, self.classes, self.attributes = child, None, set(), []
        at = 0
        while at < len(written):
            m = PART.match(written, at)
            if not m or (m[1] and at):
                raise ValueError(f"selector part {written!r} is not understood")
            if m[1]:
                self.tag = None if m[1] == "*" else m[1].lower()
            elif m[2]:
                self.classes.add(m[2])
            elif m[3]:
                self.attributes.append(("id", "=", m[3]))
            else:
                self.attributes.append((m[4].lower(), m[5], m[6]))
            at = m.end()

    def holds(self, element: Element) -> bool:
        if (self.tag and self.tag != element.tag) or not self.classes <= element.classes:
            return False
        for name, how, value in self.attributes:
            have = element.attributes.get(name)
            if have is None or not {None: True, "=": have == value, "*=": bool(value) and value in have, "^=": bool(value) and have.startswith(value or "\0"), "$=": bool(value) and have.endswith(value or "\0")}[how]:
                return False
        return True


def selectors(written: str) -> list[list[list[Step]]]:
    """For every choice its selectors, each of steps from the outermost on."""
    return [_union(choice) for choice in written.split("|")]


def _union(written: str) -> list[list[Step]]:
    out = []
    for one in written.split(","):
        steps, child = [], False
        for part in one.replace(">", " > ").split():
            if part == ">":
                child = True
            else:
                steps.append(Step(part, child))
                child = False
        if not steps or child:
            raise ValueError(f"selector {written!r} is not understood")
        out.append(steps)
    return out


class Element:
    __slots__ = ("tag", "attributes", "classes", "opened")

    def __init__(self, tag: str, attributes: list[tuple[str, str | None]]):
        self.tag, self.attributes = tag, {k: v or "" for k, v in reversed(attributes)}
        self.classes = set(self.attributes.get("class", "").split())
        self.opened: list[list[str]] = []


def matches(steps: list[Step], stack: list[Element]) -> bool:
    """Whether the last element of the stack matches."""

    def up(step: int, at: int) -> bool:
        if not steps[step].holds(stack[at]):
            return False
        if step == 0:
            return True
        over = [at - 1] if steps[step].child else range(at - 1, -1, -1)
        return any(i >= 0 and up(step - 1, i) for i in over)

    return up(len(steps) - 1, len(stack) - 1)


class Reader(HTMLParser):
    """One page: the matches of every selector of every rule, in document order."""

    def __init__(self, rules: list[tuple[Rule, list[list[list[Step]]]]]):
        super().__init__(convert_charrefs=True)
        self.rules = rules

    def read(self, page: str, references: frozenset[str] | None = None) -> list:
        if references is not None:
            page = REFERENCE.sub(lambda m: m[0] if m[1] in references else f"&amp;{m[0][1:]}", page)
        self.reset()
        self.stack: list[Element] = []
        self.found: list[list[list]] = [[[] for _ in choices] for _, choices in self.rules]
        self.open: list[list[str]] = []
        self.feed(page)
        self.close()
        return [self.taken(rule, found) for (rule, _), found in zip(self.rules, self.found, strict=True)]

    def taken(self, rule: Rule, found: list[list]):
        if rule.take == "count":
            return len({at for one in found for at, _ in one})
        if rule.take == "all":
            ordered = {at: text for one in found for at, text in one}
            return ["".join(ordered[at]).strip() for at in sorted(ordered)]
        if rule.take.startswith("attr:"):
            return next((one[0][1] for one in found if one), None)
        return next((t for one in found if one and len(t := "".join(one[0][1]).strip()) >= rule.least), None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            starts, within = ENDS.get(self.stack[i].tag, (frozenset(), frozenset()))
            if tag in starts and not any(e.tag in within for e in self.stack[i + 1 :]):
                self._close(i)
                break
        element = Element(tag, attrs)
        self.stack.append(element)
        at = self.getpos()
        for n, (rule, choices) in enumerate(self.rules):
            for j, union in enumerate(choices):
                if any(matches(steps, self.stack) for steps in union):
                    if rule.take.startswith("attr:"):
                        self.found[n][j].append((at, element.attributes.get(rule.take[5:])))
                    else:
                        text: list[str] = []
                        self.found[n][j].append((at, text))
                        element.opened.append(text)
                        self.open.append(text)
        if tag in VOID:
            self._close(len(self.stack) - 1)
        if tag == "br":
            self.handle_data("\n")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self._close(i)
                return

    def handle_data(self, data: str) -> None:
        if self.open and not any(e.tag in SKIPPED for e in self.stack):
            for text in self.open:
                text.append(data)

    def _close(self, i: int) -> None:
        gone = {id(t) for e in self.stack[i:] for t in e.opened}
        del self.stack[i:]
        if gone:
            self.open = [t for t in self.open if id(t) not in gone]


def records(pages: DataFrame, html: str, rules: list[Rule], references: frozenset[str] | None = None) -> DataFrame:
    """pages without their html column, but with the field of every rule. references: names of the character references that are read; None: all there are."""
    kept = [c for c in pages.columns if c != html and c not in {r.field for r in rules}]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), *(f"`{r.field}` {r.kind}" for r in rules)])
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "int": pa.int32()}
    parsed = [(r, selectors(r.select)) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(parsed)
        for b in batches:
            rows = [reader.read(page.as_py() or "", references) for page in b.column(b.num_columns - 1)]
            fields = [pa.array([row[i] for row in rows], kinds[r.kind]) for i, r in enumerate(rules)]
            yield pa.record_batch([*b.columns[:-1], *fields], [*b.schema.names[:-1], *(r.field for r in rules)])

    return pages.select(*kept, html).mapInArrow(run, schema)


# What the pages of decisions, of articles of a code and of an official journal look like.
DECISION = [Rule("titre", "h1.title"), Rule("parts", "div.decision-content p", "all"), Rule("date_text", "div.decision-date"), Rule("juridiction", "div.juridiction")]
ARTICLE = [Rule("id", "article", "attr:id"), Rule("titre", "h1.title"), Rule("parts", "div.article-content p", "all"), Rule("date_text", "div.article-date")]
JOURNAL = [Rule("heading", "h1 | h2 | .article-title", least=11), Rule("page_title", "title"), Rule("date_text", "[class*=date]"), Rule("category", ".breadcrumbs, [class*=categorie], [class*=category]"), Rule("body", "body")]


def _iso(text: Column) -> Column:
    return F.date_format(F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("dd/MM/yyyy")), "yyyy-MM-dd")


def _last_part(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def decisions(pages: DataFrame, url: str = "url", html: str = "html", source: str = "jurica") -> DataFrame:
    """id, titre, text, date, juridiction, source, url of court decisions; a page that lacks one of the elements gives no record."""
    r = records(pages.select(url, html), html, DECISION).withColumn("date", _iso(F.col("date_text")))
    r = r.where("titre is not null and date is not null and juridiction is not null")
    return r.select(_last_part(F.col(url)).alias("id"), "titre", F.array_join("parts", " ").alias("text"), "date", "juridiction", F.lit(source).alias("source"), F.col(url).alias("url"))


def articles(pages: DataFrame, url: str = "url", html: str = "html", source: str = "legifrance") -> DataFrame:
    """id, titre, text, date, source, url of the articles of a code; a page that lacks one of the elements gives no record, one without an id an empty id."""
    r = records(pages.select(url, html), html, [*ARTICLE, Rule("n_articles", "article", "count")]).withColumn("date", _iso(F.col("date_text")))
    r = r.where("n_articles > 0 and titre is not null and date is not null")
    return r.select(F.coalesce("id", F.lit("")).alias("id"), "titre", F.array_join("parts", " ").alias("text"), "date", F.lit(source).alias("source"), F.col(url).alias("url"))


def journal(pages: DataFrame, url: str = "url", html: str = "html", least: int = 50) -> DataFrame:
    """id, titre, text, date, source, type, journal_numero, category of journal pages; pages not found and those with less text give no record."""
    r = records(pages.select(url, html), html, JOURNAL)
    link, body = F.col(url), F.coalesce(F.col("body"), F.lit(""))
    year = F.regexp_extract(link, r"/Journaux/(\d{4})/", 1)
    number = F.regexp_extract(link, r"Journal-(\d+)", 1)
    slug = F.left(_last_part(F.regexp_replace(link, "/+$", "")), F.lit(80))
    title = F.coalesce("heading", T.strip(F.get(F.split(F.coalesce("page_title", F.lit("")), "-"), 0)))
    r = r.where(~F.lower(body).contains("erreur 404"))
    date = F.coalesce(F.nullif(T.parse_date(F.col("date_text")), F.lit("")), year)
    text = T.strip(F.regexp_replace(body, r"[ \t\r\x0b\f]+", " "))
    out = r.select(F.concat(F.lit("JDM-"), number, F.lit("-"), slug).alias("id"), title.alias("titre"), text.alias("text"), date.alias("date"), link.alias("source"), F.lit("journal_monaco").alias("type"), number.alias("journal_numero"), F.replace(F.coalesce("category", F.lit("")), F.lit("\n"), F.lit(" > ")).alias("category"))
    return out.where(F.length("text") >= least)

"""Markdown files to sections, and glossary tables to entries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_HEADING = re.compile(r"(#{1,6})(?!#)\s*(.*\S)\s*$")
_FENCE = re.compile(r"\s*(```|~~~)")


def without_front_matter(text: str) -> str:
    """What follows the first line that begins with three dashes, if three dashes open the text; else all of it."""
    rest = text.lstrip()
    if not rest.startswith("---") or (end := rest.find("\n---", 3)) < 0:
        return text
    return rest[end + 4 :].removeprefix("\n")


def lines(text: str) -> list[str]:
    """Lines end at line feeds, with a carriage return before them or not; other separators are text."""
    return [x.removesuffix("\r") for x in text.split("\n")]


def title(text: str, stem: str) -> str:
    """The first heading of level one, wherever it is; else the file's stem."""
    for line in lines(text):
        m = _HEADING.match(line.strip())
        if m and len(m[1]) == 1:
            return m[2]
    return stem


def slug(heading: str) -> str:
    return re.sub(r"-+", "-", "".join(c if c.isalnum() else "-" for c in heading.lower())).strip("-") or "section"


def sections(text: str) -> Iterator[tuple[str, str | None, str]]:
    """(locator, heading path, text) of each part with text. Headings within fences are text; a fence ends at the next line
    that begins with its three marks, or never. A heading of level n keeps at most n - 1 headings above it, so levels may
    be skipped. Text before the first heading is `intro`; repeated locators get -2, -3 and so on."""
    path: list[str] = []
    fence, kept, used = None, [], {"intro"}

    def part():
        body = "\n".join(kept).strip()
        kept.clear()
        if not body:
            return None
        if not path:
            return "intro", None, body
        locator = base = slug(path[-1])
        n = 1
        while locator in used:
            n += 1
            locator = f"{base}-{n}"
        used.add(locator)
        return locator, " > ".join(path), body

    for line in lines(without_front_matter(text)):
        f = _FENCE.match(line)
        if f and fence in (None, f[1]):
            fence = f[1] if fence is None else None
        m = None if fence or f else _HEADING.match(line.strip())
        if not m:
            kept.append(line)
            continue
        if done := part():
            yield done
        path[len(m[1]) - 1 :] = [m[2]]
    if done := part():
        yield done


def section_rows(files: DataFrame) -> DataFrame:
    """Sections of (path, text) files: path, title, ordinal, locator, heading, text. Each file is read by itself."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, title(t, p.rsplit("/", 1)[-1].removesuffix(".md")), n, *s) for p, t in zip(f.path, f.text, strict=True) for n, s in enumerate(sections(t or ""))]
            yield pd.DataFrame(rows, columns=["path", "title", "ordinal", "locator", "heading", "text"])

    return files.select("path", "text").mapInPandas(parse, "path string, title string, ordinal long, locator string, heading string, text string")


def table_rows(text: str) -> list[list[str]]:
    """Cells of the rows of pipe tables, after their line of dashes."""
    out, inside = [], False
    for line in lines(text):
        line = line.strip()
        cells = [c.strip() for c in line[1:].removesuffix("|").split("|")]
        if not line.startswith("|"):
            inside = False
        elif all(re.fullmatch(":*-+:*", c) for c in cells):
            inside = True
        elif inside:
            out.append(cells)
    return out


# Words that are no terms of an entry.
STOP = (
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "for", "from", "if", "in", "is", "it", "its", "just", "no", "not", "of", "on", "or", "re", "s", "say", "t",
    "that", "the", "then", "this", "to", "use", "we", "with",
)


def words(text: str) -> list[str]:
    """Lower-cased words; an underscore parts words, and words with an ASCII digit are identifiers and are dropped."""
    return [w.lower() for w in re.findall(r"[^\W_]+", text) if not re.search("[0-9]", w)]


def without_code(text: str) -> str:
    """The text without code between backticks and without tags in square brackets; an open one runs to the end."""
    return re.sub(r"`[^`]*(?:`|\Z)|\[[^\]]*(?:\]|\Z)", "", text)


def without_parentheses(text: str) -> str:
    """The text outside of parentheses, however deep; one that is never closed hides the rest."""
    depth, out = 0, []
    for part in re.split(r"([()])", text):
        if part in ("(", ")"):
            depth = max(depth + (1 if part == "(" else -1), 0)
        elif not depth:
            out.append(part)
    return "".join(out)


def is_acronym(word: str) -> bool:
    upper = sum(c.isupper() for c in word)
    return upper >= 2 and upper >= sum(c.islower() for c in word)


def entry(cells: list[str]) -> tuple[list[str], list[str], list[str]] | None:
    """(phrases, acronyms, terms) of a glossary row, or nothing where no key is left.

    The first cell names the row, in straight quotes or parted by slashes and commas. A key is a part of the name that
    isn't all of it: questions with the whole name find the row's words by themselves. Keys are in the order of the cell,
    phrases first; acronyms are in small letters.
    """
    cells = [without_code(c) for c in cells]
    name = words(cells[0])
    variants = cells[0].split('"')[1::2] or re.split(r"[/,]", without_parentheses(cells[0]))
    phrases = dict.fromkeys(" ".join(w) for v in variants if len(w := words(v)) >= 2 and w != name)
    parts = [[p for p in t.split("-") if p] for t in re.findall(r"(?:[^\W_]|-)+", cells[0])]
    short = dict.fromkeys(a.lower() for ps in parts for a in [*filter(is_acronym, ps), *(["".join(p[0] for p in ps)] if len(ps) >= 3 else [])])
    short = [a for a in short if name != [a]]
    if not phrases and not short:
        return None
    terms = list(dict.fromkeys(w for c in cells for w in words(c) if w not in STOP))
    return list(phrases), short, terms


def glossary_entries(chunks: DataFrame) -> DataFrame:
    """A row a glossary table row with keys of (id, ordinal, text): id, ordinal, line, phrases, acronyms, terms."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, o, n, *e) for i, o, t in zip(f.id, f.ordinal, f.text, strict=True) for n, cells in enumerate(table_rows(t or "")) if (e := entry(cells))]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "line", "phrases", "acronyms", "terms"])

    return chunks.select("id", "ordinal", "text").mapInPandas(parse, "id string, ordinal long, line long, phrases array<string>, acronyms array<string>, terms array<string>")

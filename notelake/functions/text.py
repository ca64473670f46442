"""Column functions on text: tokens, estimates, frontmatter, titles, links, lines and previews. All JVM-side unless said."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges and the patterns of the notes' grammar.
CJK = "㐀-鿿豈-﫿"
HAN = r"[㐀-䶿一-鿿豈-﫿]"
FRONTMATTER = r"(?U)(?s)\A---\s*\n(.*?)---\s*\n"
EDGE_SPACE = r"(?U)^\s+|\s+$"
LIST_INLINE = r"(?Um)^{}\s*:\s*\[([^\]]*)\]"
LIST_BLOCK = r"(?Udm)^{}\s*:\s*\n((?:\s+-\s+.+\n?)+)"
LIST_ITEM = r"(?Udm)^\s+-\s+(.+)$"
LIST_SINGLE = r"(?Udm)^{}\s*:\s+(.+)$"
FENCED_CODE = r"(?sdm)^(`{3,})[^\n]*\n(.*?)^\1\s*$"
INLINE_CODE = "`[^`]+`"
WIKI_LINK = r"\[\[([^\[\]|]+?)(?:\|[^\[\]]*?)?\]\]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
SKIPPED_FOLDERS = ("todo", "archive")
WORDS, HAN_RUN, HAN_OR_WORD = re.compile("[a-zA-Z0-9]+"), re.compile(HAN + "+"), re.compile(HAN + "+|[a-zA-Z0-9]+")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits; everything else separates."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.lower)


def pairs(run: str) -> list[str]:
    """The overlapping pairs of a run of Han, or the run itself: any part of two characters or more is then found as a phrase."""
    return [run] if len(run) < 3 else [run[i : i + 2] for i in range(len(run) - 1)]


def starts(run: str, own: list[str], known: Callable[[str], list[int]] | None = None) -> list[int]:
    """Where each of a run's tokens starts in it: as its segmenter says, else each at or behind the one before."""
    if known is not None:
        return known(run)
    out, at, last = [], 0, ""
    for t in own:
        at = max(at, run.find(t, at + (t == last)))
        last = t
        out.append(at)
    return out


@dataclass(frozen=True)
class Tokenizer:
    """Lower-cased runs of ASCII letters and digits after NFKC, and the segments of runs of Han: one rule for texts and queries.

    segment(run) -> tokens may be any segmenter, ``han.Segmenter`` for example. Texts also hold the single characters of their runs of Han, outside the sequence of tokens: a
    query of one character finds them, phrases and lengths don't see them.
    """

    segment: Callable[[str], list[str]] = pairs

    def split(self, text: str) -> tuple[str, ...]:
        if text.isascii():
            return tuple(WORDS.findall(text.lower()))
        text = unicodedata.normalize("NFKC", text)
        if not HAN_RUN.search(text):
            return tuple(" ".join(WORDS.findall(text)).lower().split())
        return tuple(x.lower() for w in HAN_OR_WORD.findall(text) for x in (self.segment(w) if HAN_RUN.match(w) else [w]) if x.strip())

    def characters(self, text: str) -> list[tuple[str, int]]:
        """(character, place of the first token that holds it) for the characters of runs of Han that aren't tokens there themselves."""
        if text.isascii():
            return []
        out, place = [], 0
        text = unicodedata.normalize("NFKC", text)
        if not HAN_RUN.search(text):
            return []
        for w in HAN_OR_WORD.findall(text):
            if not HAN_RUN.match(w):
                place += 1
                continue
            own = [x for x in self.segment(w) if x.strip()]
            holder: list[int | None] = [None] * len(w)
            for k, start in reversed(list(enumerate(starts(w, own, getattr(self.segment, "starts", None))))):
                holder[start : start + len(own[k])] = [k] * len(w[start : start + len(own[k])])
            out += [(c, place + k) for c, k in zip(w, holder) if k is not None and own[k] != c]
            place += len(own)
        return out

    def column(self, text: Column | str) -> Column:
        """The tokens of a text column, in Arrow batches."""
        split = self.split

        @F.pandas_udf("array<string>")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [] if t is None else list(split(t)))

        return run(col(text))


def token_estimate(text: Column | str) -> Column:
    """max(1, floor((other characters) / 4 + (CJK characters) / 1.5)), 0 for empty text."""
    c = F.coalesce(col(text), F.lit(""))
    cjk = F.length(F.regexp_replace(c, f"[^{CJK}]", ""))
    return F.when(c == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor((F.length(c) - cjk) / F.lit(4.0) + cjk / F.lit(1.5)))).cast("long")


def content_hash(text: Column | str) -> Column:
    return F.sha2(col(text).cast("binary"), 256)


def normalized_newlines(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"\r\n?", "\n")


def frontmatter(content: Column | str) -> Column:
    """The text between the fences, empty if there is none."""
    return F.regexp_extract(col(content), FRONTMATTER, 1)


def body(content: Column | str) -> Column:
    """What follows the frontmatter and the blank space after it."""
    c = col(content)
    return F.substring(c, F.length(F.regexp_extract(c, FRONTMATTER, 0)) + 1, F.length(c))


def list_field(yaml: Column | str, field: str) -> Column:
    """A list in frontmatter: inline, else an indented block, else a single value, else empty. Empty items go."""
    y = col(yaml)
    strip = lambda x: F.regexp_replace(F.regexp_replace(x, EDGE_SPACE, ""), "^[\"']+|[\"']+$", "")
    inline, block, single = (F.regexp_extract(y, p.replace("{}", field, 1), 1) for p in (LIST_INLINE, LIST_BLOCK, LIST_SINGLE))
    has_inline = y.rlike(LIST_INLINE.replace("{}", field, 1))
    items = (
        F.when(has_inline, F.transform(F.split(inline, ","), strip))
        .when(block != "", F.transform(F.regexp_extract_all(block, F.lit(LIST_ITEM), F.lit(1)), strip))
        .when((single != "") & ~strip(single).startswith("["), F.array(strip(single)))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.filter(items, lambda x: x != "")


def stem(path: Column | str) -> Column:
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]*$", "")


def title(body_text: Column | str, path: Column | str) -> Column:
    """The first line that starts with '# ' once stripped, else the file's stem."""
    lines = F.filter(F.transform(F.split(col(body_text), LINE_END), lambda x: F.regexp_replace(x, EDGE_SPACE, "")), lambda x: x.startswith("# "))
    return F.coalesce(F.regexp_replace(F.get(lines, F.lit(0)).substr(F.lit(3), F.lit(1 << 30)), EDGE_SPACE, ""), stem(path))


def wiki_links(text: Column | str) -> Column:
    """Distinct link targets in order, outside fenced and inline code."""
    fences = F.regexp_replace(F.coalesce(col(text), F.lit("")), FENCED_CODE, " ")
    clean = F.regexp_replace(fences, INLINE_CODE, " ")
    found = F.transform(F.regexp_extract_all(clean, F.lit(WIKI_LINK), F.lit(1)), lambda x: F.regexp_replace(x, EDGE_SPACE, ""))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def is_hidden(rel_path: Column | str, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> Column:
    """Whether any component starts with a dot or is a skipped folder."""
    return F.exists(F.split(col(rel_path), "/"), lambda p: p.startswith(".") | p.isin(*skipped))


def line_of(content: Column | str, offset: Column | int) -> Column:
    """Line in the file (from 1) of a character offset in the body."""
    c = col(content)
    head = F.regexp_extract(c, FRONTMATTER, 0)
    before = F.substring(body(c), F.lit(1), offset if isinstance(offset, Column) else F.lit(offset))
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return (breaks(head) + breaks(before) + 1).cast("long")


def line_window(content: Column | str, start: int, count: int = 100) -> Column:
    """count lines from line start (clamped to 1), without the line end of the last; empty beyond the end."""
    c = col(content)
    lines = F.split(F.when(c.endswith("\n"), c.substr(F.lit(1), F.length(c) - 1)).otherwise(c), "\n")
    return F.array_join(F.slice(lines, max(1, start), max(0, count)), "\n")


def preview(content: Column | str, length: int = 200) -> Column:
    return F.substring(F.replace(col(content), F.lit("\n"), F.lit(" ")), 1, length)


def sentences(text: Column | str) -> Column:
    """Split after a full stop, exclamation or question mark that white space follows."""
    return F.split(col(text), r"(?U)(?<=[.!?。！？])\s+")


def has_cjk(text: Column | str) -> Column:
    return col(text).rlike("[㐀-鿿]")


def ascii_fold(c: Column | str) -> Column:
    """A-Z to lower case and nothing else, as SQL LIKE compares."""
    return F.translate(col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

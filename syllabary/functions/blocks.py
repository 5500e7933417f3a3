"""Blocks of Markdown: the sections of a page, with their blocks as plain text or as they are written.

A page is read line by line into headings, paragraphs, lists, quotes, fenced and indented code and markup; list items and quotes are
read again inside. One page is one Python call inside an Arrow batch, so no line is shuffled.

Plain text: a link becomes its label and its target in brackets, an image its alternative text, code and emphasised words
themselves; items of a list are numbered from 1 (or have a dash), what an item holds besides goes on two blanks to the right;
quotes have ``> `` before each line; code stays between fences. Text as it is written: the lines of the section, between headings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r"^( {0,3})([-*+]|[0-9]{1,9}[.)])(?:([ \t]+)(.*))?$")
_QUOTE = re.compile(r"^ {0,3}> ?(.*)$")
# The tags that begin a block of markup, whatever follows them in their line.
_BLOCK_TAGS = (
    "address article aside blockquote body center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe "
    "li link main menu meta nav ol option p pre script section style summary table tbody td tfoot th thead title tr ul"
)
_MARKUP = re.compile(rf"(?i)^ {{0,3}}<(?:!--|/?(?:{_BLOCK_TAGS.replace(' ', '|')})(?=[\s/>]|$)|/?[a-z][a-z0-9-]*(?:\s[^<>]*)?/?>[ \t]*$)")
_HELD = "\ue001"
_TOKEN = re.compile(
    r"\\(?P<escaped>[!-/:-@\[-`{-~])|(?P<ticks>`+)(?P<code>.+?)(?<!`)(?P=ticks)(?!`)|<(?P<auto>[a-zA-Z][a-zA-Z0-9+.-]+:[^<>\s]*)>"
    r"|(?P<image>!?)\[(?P<label>(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\([ \t\n]*(?P<to><[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?[ \t\n]*\)",
    re.DOTALL,
)
_STRONG = [re.compile(p, re.DOTALL) for p in (r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"(?<!\w)__(?=\S)(.+?)(?<=\S)__(?!\w)", r"\*(?=[^\s*])(.+?)(?<=\S)\*", r"(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)")]


def squeezed(x: str) -> str:
    """Blanks squeezed within lines, lines stripped, runs of empty lines squeezed to one, the ends stripped."""
    lines = [re.sub(r"[ \t]+", " ", y).strip() for y in x.replace("\xa0", " ").splitlines()]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def inline_text(x: str) -> str:
    """A paragraph without its marks."""
    held: list[str] = []

    def hold(said: str) -> str:
        held.append(said)
        return f"{_HELD}{len(held) - 1}{_HELD}"

    def one(m: re.Match) -> str:
        if m["escaped"] or m["auto"]:
            return hold(m["escaped"] or m["auto"])
        if m["ticks"]:
            return hold(m["code"].strip())
        label, to = inline_text(m["label"]).strip(), m["to"].strip("<>")
        return hold(label if m["image"] or not to else f"{label} ({to})" if label else to)

    x = _TOKEN.sub(one, x.replace(_HELD, ""))
    for mark in _STRONG:
        x = mark.sub(r"\1", x)
    x = re.sub(r"(?: {2,}|\\)\n", "\n", x)
    return re.sub(f"{_HELD}([0-9]+){_HELD}", lambda m: held[int(m[1])], x)


def _begins(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    item = _ITEM.match(line)
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _QUOTE.match(line) or (item and item[4] and (not item[2][0].isdigit() or item[2][:-1] == "1")))


def _item(lines: list[str], at: int, first: re.Match) -> tuple[list[str], int]:
    """(lines of the item that begins at ``at``, without its indentation; the line after it)."""
    gap = first[3] or " "
    inner = len(first[1]) + len(first[2]) + (len(gap) if len(gap) <= 4 else 1)
    out, i = [lines[at][inner:]], at + 1
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            ahead = next((x for x in lines[i:] if x.strip()), "")
            if len(ahead) - len(ahead.lstrip(" ")) < inner:
                break
            out.append("")
        elif len(line) - len(line.lstrip(" ")) >= inner:
            out.append(line[inner:])
        elif lines[i - 1].strip() and not _begins(line) and not _ITEM.match(line):
            out.append(line.lstrip(" "))  # the paragraph goes on without indentation
        else:
            break
        i += 1
    return out, i


def read(lines: list[str]) -> Iterator[tuple]:
    """Blocks: ("heading", level, text), ("text", text), ("list", ordered, items as lines), ("quote", lines), ("code", info, text), ("markup", text),
    each with its first line and the line after it at the end."""
    i, n = 0, len(lines)
    while i < n:
        line, start = lines[i], i
        if not line.strip():
            i += 1
        elif fence := _FENCE.match(line):
            close, i = re.compile(rf"^ {{0,3}}{fence[1][0]}{{{len(fence[1])},}}[ \t]*$"), i + 1
            while i < n and not close.match(lines[i]):
                i += 1
            i += 1
            yield "code", fence[2].split(" ")[0].strip(), "\n".join(lines[start + 1 : i - 1]), start, i
        elif head := _HEADING.match(line):
            i += 1
            yield "heading", len(head[1]), head[2] or "", start, i
        elif _RULE.match(line):
            i += 1
        elif _QUOTE.match(line):
            inside = []
            while i < n and lines[i].strip() and ((found := _QUOTE.match(lines[i])) or (inside[-1].strip() and not _begins(lines[i]) and not _begins(inside[-1]))):
                inside.append(found[1] if found else lines[i])
                i += 1
            yield "quote", inside, start, i
        elif item := _ITEM.match(line):
            items, kind = [], item[2][-1]
            while i < n and (one := _ITEM.match(lines[i])) and one[2][-1] == kind and not _RULE.match(lines[i]):
                own, i = _item(lines, i, one)
                items.append(own)
                while i < n and not lines[i].strip():
                    i += 1
            yield "list", kind in ".)", items, start, i
        elif line.startswith("    ") or line.startswith("\t"):
            while i < n and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                i += 1
            yield "code", "", "\n".join(re.sub("^(?:    |\t)", "", x) for x in lines[start:i]).strip("\n"), start, i
        elif _MARKUP.match(line):
            while i < n and lines[i].strip():
                i += 1
            yield "markup", "\n".join(lines[start:i]), start, i
        else:
            i += 1
            while i < n and lines[i].strip() and not _UNDERLINE.match(lines[i]) and not _begins(lines[i]):
                i += 1
            body = "\n".join(x.lstrip() for x in lines[start:i])
            if i < n and (under := _UNDERLINE.match(lines[i])):
                i += 1
                yield "heading", 1 if under[1][0] == "=" else 2, body, start, i
            else:
                yield "text", body, start, i


def _paragraphs(parts: Iterator[str]) -> str:
    return "\n\n".join(p.strip() for p in parts if p.strip())


def plain(block: tuple) -> str:
    """A block as plain text."""
    kind = block[0]
    if kind in ("text", "heading"):
        return squeezed(inline_text(block[2] if kind == "heading" else block[1]))
    if kind == "quote":
        inside = _paragraphs(plain(b) for b in read(block[1]))
        return "\n".join(f"> {x}" if x else ">" for x in inside.splitlines())
    if kind == "code":
        return f"```{block[1]}\n{squeezed(block[2])}\n```"
    if kind == "markup":
        return squeezed(block[1])
    said = []
    for number, item in enumerate(block[2], 1):
        lines = _paragraphs(plain(b) for b in read(item)).splitlines()
        if lines:
            said.append("\n".join([(f"{number}. " if block[1] else "- ") + lines[0], *(f"  {x}" for x in lines[1:])]))
    return "\n".join(said)


def sections(markdown: str, as_written: bool = False) -> list[tuple[str, str]]:
    """(title, text) under headings of level two and deeper, in order.

    Level-one headings are passed over; text before the first section and sections without text are left out; sections of one title
    are joined at the place of the first. A heading inside of a fence, a list item or a quote is none.
    """
    lines, found, title, parts = markdown.splitlines(), {}, "", []

    def close() -> None:
        said = squeezed("\n".join(parts)) if as_written else _paragraphs(iter(parts))
        if title and said:
            found[title] = f"{found[title]}\n\n{said}" if title in found else said
        parts.clear()

    end = 0
    for block in read(lines):
        start, stop = block[-2:]
        if as_written and title:
            parts += lines[end:start]
        if block[0] == "heading":
            if block[1] > 1:
                close()
                title = squeezed(block[2]) if as_written else plain(block)
        elif title:
            parts += lines[start:stop] if as_written else [plain(block)]
        end = stop
    close()
    return list(found.items())

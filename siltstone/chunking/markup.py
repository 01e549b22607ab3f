"""What is a tag in HTML text and what is not, and the elements of a page in order."""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

#: Comments, scripts and styles with what they hold, declarations, and tags: a name right after the bracket, quoted values that
#: may hold brackets. What else begins with a bracket is text.
TAG = re.compile(r"""<!--.*?-->|<(?P<code>script|style)\b.*?</(?P=code)\s*>|<[!?][^<>]*>|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?=[\s/>])(?:[^"'<>]|"[^"<]*"|'[^'<]*')*>|</?[a-z][a-z0-9:-]*(?=[\s/])[^<>]*>""", re.I | re.S)
#: Tags that end a run of text.
BLOCKS = frozenset("address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form head header hgroup hr html li main nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
_HEADING = re.compile("h[1-6]", re.I)


def shown(text: str) -> str:
    """Text with its references as characters and its white space squeezed."""
    return " ".join(references.unescape(text).split())


def _closed(page: str) -> dict[int, int]:
    """Where each outermost table that is closed begins and ends."""
    depth, begin, out = 0, 0, {}
    for m in TAG.finditer(page):
        if (m["name"] or "").lower() == "table":
            if m["end"]:
                depth = max(0, depth - 1)
                if depth == 0 and begin is not None:
                    out[begin], begin = m.end(), None
            else:
                begin = m.start() if depth == 0 else begin
                depth += 1
    return out


def elements(page: str | None) -> Iterator[tuple[str, str]]:
    """(kind, text) in order: titles, whole tables as HTML, and runs of text; nothing that is shown is left out.

    Tables in tables belong to the outermost one; a table that is not closed is a run of blocks; a heading that is not closed
    begins a run of text.
    """
    page = page or ""
    tables = _closed(page)
    last_end = max((m.start() for m in TAG.finditer(page) if m["end"] and _HEADING.fullmatch(m["name"])), default=-1)
    run: list[str] = []
    kind, at, skip = "text", 0, -1
    for m in TAG.finditer(page):
        if m.start() < skip:
            continue
        run.append(page[at : m.start()])
        at, name = m.end(), (m["name"] or "").lower()
        heading = bool(_HEADING.fullmatch(name))
        ends = heading or m.start() in tables or (name in BLOCKS and kind == "text")
        if ends:
            if text := shown("".join(run)):
                yield kind, text
            run = []
            if heading:
                kind = "title" if not m["end"] and m.start() < last_end else "text"
        else:
            run.append(" ")
        if m.start() in tables:
            at = skip = tables[m.start()]
            kind = "text"
            yield "table", page[m.start() : at]
    run.append(page[at:])
    if text := shown("".join(run)):
        yield kind, text

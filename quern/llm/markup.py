"""Markup residue in text: finding it, and clean text that keeps headings, lists, code and formulas.

Four formats are known: HTML, Markdown, wiki text and LaTeX. A construct counts only if its format
would render it, so every rule states both what opens and what closes it and what may stand beside
it. Comparisons, prices, paths, indexes, operators, type parameters, placeholders and identifiers
in running text match none.

Clean text keeps the structure in one plain notation: headings as "# ", list items as "- " or
"1. ", table rows with " | " between the cells, code between lines of three backticks, formulas
with their dollar signs. Everything else that only marks up is taken away, links leave their text.

Defined results: null stays null; text without a construct is returned as it is, byte for byte.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import wrapper
from quern.llm.wrapper import TAG

# LaTeX commands that are written without braces.
BARE_COMMANDS = """
item par noindent newline newpage clearpage maketitle tableofcontents centering hline bigskip medskip smallskip
ldots dots cdots LaTeX TeX quad qquad hfill vfill bfseries itshape ttfamily footnotesize large Large appendix
"""

#: Names with two underscores around them that every object of Python has: identifiers, not emphasis.
_SPECIAL = "|".join(sorted(n.strip("_") for n in dir(object)))

COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>", re.I | re.S)
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

#: A line break inside a paragraph: no blank line and no line that starts a block of its own.
_SOFT = r"\n(?![ \t]*(?:\n|\Z|[-+][ \t]|\*+[ \t]|\d{1,9}[.)][ \t]|#+[ \t]|[:;>|!]|`{3}|~{3}|={3}|-{3}|\{\||\$\$|\\(?:begin|end|item)\b))"

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n`]*$", re.M)
INLINE_CODE = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+|(?![^`]*'')(?:[^`\n]|" + _SOFT + r")+)(?<!`)\1(?!`)")
ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M)
SETEXT = re.compile(r"^(?![ \t]*[|>])[ \t]*(\S[^\n]*)\n {0,3}(={3,}|-{3,})[ \t]*$", re.M)
ITEM = re.compile(r"^([ \t]{0,12})([-*+])[ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)", re.M)
NUMBERED = re.compile(r"^[ \t]{0,12}\d{1,9}[.)][ \t]+(?=\S)", re.M)
QUOTE = re.compile(r"^ {0,3}>(?![=>])[ \t]?(?=\S)", re.M)
TABLE_LINE = re.compile(r"^[ \t]*(?=[^\n]*\|)\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$", re.M)
STRONG = re.compile(r"(?<![A-Za-z0-9_*\\)\]])\*\*(?=[^\s*])((?:[^*\n]|" + _SOFT + r")+?)(?<=[^\s*])\*\*(?![A-Za-z0-9_*])")
TRIPLE = re.compile(r"(?<![A-Za-z0-9_*\\)\]])(\*{3}|_{3})(?=[^\s*_])((?:[^*\n]|" + _SOFT + r")+?)(?<=[^\s*_])\1(?![A-Za-z0-9_*])")
EM = re.compile(r"(?<![A-Za-z0-9_*\\)\]])\*(?=[^\s*)=.,;/])(?:(?=(?:[^*\n]|" + _SOFT + r")*?[^\W\d_])|(?<!\d \*)(?=[\d.,%]+\*(?! ?\d)))((?:[^*\n]|" + _SOFT + r")+?)(?<=[^\s*(])\*(?![A-Za-z0-9_*(])")
UNDER_STRONG = re.compile(rf"(?<!\w)__(?=[^\s_])(?!(?:{_SPECIAL})__)((?:[^_\n]|{_SOFT}|(?<=\w)_(?=[^\W_]))+?)(?<=[^\s_])__(?!\w)")
UNDER_EM = re.compile(r"(?<!\w)_(?=[^\s_])((?:[^_\n]|" + _SOFT + r"|(?<=\w)_(?=[^\W_]))+?)(?<=[^\s_])_(?!\w)")
STRIKE = re.compile(r"~~(?=[^\s~])((?:[^~\n]|" + _SOFT + r")+?)(?<=[^\s~])~~")
LINK = re.compile(r"""(?<![\w\])])(!?)\[((?:[^\[\]\n]|""" + _SOFT + r""")*)\]\(\s*(?:<[^<>\n]*>|(?:[^()\s]|\([^()\s]*\))+)(?:\s+(?:"[^"\n]*"|'[^'\n]*'))?\s*\)""")
REF_LINK = re.compile(r"(?<![\w\])])(!?)\[((?:[^\[\]\n]|" + _SOFT + r")+)\]\[([^\[\]\n]*)\]")
REF_DEF = re.compile(r"^ {0,3}\[[^\[\]\n]+\]:[ \t]*(?:<[^>\n]+>|\S*(?:://|mailto:|www\.)\S*|[/#]\S+)[^\n]*$", re.M)
AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+|[\w.+-]+@[\w-]+\.[\w.-]+)>")

WIKI_HEADING = re.compile(r"^(={1,6})[ \t]*([^=\s](?:[^=\n]*[^=\s])?)[ \t]*\1[ \t]*$", re.M)


class _Quotes:
    """Wiki emphasis of two, three or five apostrophes; a line is read once, however long it is.

    A run opens if neither a word nor an apostrophe is before it and no space after it, and is
    closed by the next run of its length that has no space before it.
    """

    _RUN = re.compile(r"'+")

    def _pairs(self, line: str) -> Iterator[tuple[re.Match[str], re.Match[str]]]:
        runs = list(self._RUN.finditer(line))
        closer: dict[int, int] = {}
        ends = [-1] * len(runs)
        for i in range(len(runs) - 1, -1, -1):
            a, b = runs[i].span()
            ends[i] = closer.get(b - a, -1)
            if a and not line[a - 1].isspace():
                closer[b - a] = i
        i = 0
        while i < len(runs):
            a, b = runs[i].span()
            opens = b - a in (2, 3, 5) and b < len(line) and not line[b].isspace() and not (a and (line[a - 1].isalnum() or line[a - 1] == "_"))
            if opens and ends[i] >= 0:
                yield runs[i], runs[ends[i]]
                i = ends[i]
            i += 1

    def search(self, text: str) -> bool:
        return any(next(self._pairs(line), None) for line in text.split("\n") if "''" in line)

    def strip(self, text: str) -> str:
        """Text without the outermost marks."""
        out = []
        for line in text.split("\n"):
            at, parts = 0, []
            for first, last in self._pairs(line) if "''" in line else ():
                parts += [line[at : first.start()], line[first.end() : last.start()]]
                at = last.end()
            out.append("".join([*parts, line[at:]]))
        return "\n".join(out)


QUOTES = _Quotes()
WIKI_LINK = re.compile(r"(?<![\w\])])\[\[(?![\d\s,.;-]+\]\])([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")
_FILE = re.compile(r"\s*(?:file|image|media)\s*:", re.I)
# Options of a wiki picture that are not its caption.
_PICTURE = re.compile(r"thumb|thumbnail|frame|framed|frameless|border|left|right|center|none|upright.*|\d*x?\d+px|(?:alt|link|page|lang)=.*", re.I)
EXT_LINK = re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+([^\]\n]*))?\]")
TEMPLATE = re.compile(r"\{\{(?=[^{}]*\|)[^{}]+\}\}|\{\{[A-Za-z#][\w -]*:[^{}]+\}\}")
WIKI_TABLE = re.compile(r"^(?:\{\|[^\n]*|\|\}[ \t]*|\|-[^\n]*)$", re.M)
WIKI_LIST = re.compile(r"^[*#:;]{2,6}[ \t]+(?=\S)|^[:;][ \t]+(?=\S)", re.M)
MAGIC = re.compile(r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|INDEX|NOINDEX)__")

ENVIRONMENT = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}")
COMMAND = re.compile(r"(?<![\w\\:])\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{")
BARE = re.compile(rf"(?<![\w\\:])\\(?:{'|'.join(BARE_COMMANDS.split())})(?![\w\\])")
PAREN_MATH = re.compile(r"\\\((?=[^\n]*?\\\))(.+?)\\\)")
BRACKET_MATH = re.compile(r"\\\[(.+?)\\\]", re.S)
DISPLAY_MATH = re.compile(r"\$\$(?=[^\s$]|\s)([^$]+?)\$\$")
DOLLAR_MATH = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\w$])")
TEX_QUOTES = re.compile(r"``(?=[^\s`])[^`'\n]+''")

#: Rules by name; a text has residue if one of them matches, or a reference to a known character.
RULES: dict[str, re.Pattern[str] | _Quotes] = {
    "tag": TAG, "comment": COMMENT, "fence": FENCE, "code": INLINE_CODE, "atx": ATX, "setext": SETEXT, "item": ITEM, "numbered": NUMBERED,
    "quote": QUOTE, "table": TABLE_LINE, "triple": TRIPLE, "strong": STRONG, "em": EM, "under_strong": UNDER_STRONG, "under_em": UNDER_EM, "strike": STRIKE,
    "link": LINK, "ref_link": REF_LINK, "ref_def": REF_DEF, "autolink": AUTOLINK, "wiki_heading": WIKI_HEADING, "quotes": QUOTES,
    "wiki_link": WIKI_LINK, "ext_link": EXT_LINK, "template": TEMPLATE, "wiki_table": WIKI_TABLE, "wiki_list": WIKI_LIST, "magic": MAGIC,
    "environment": ENVIRONMENT, "command": COMMAND, "bare": BARE, "paren_math": PAREN_MATH, "bracket_math": BRACKET_MATH,
    "display_math": DISPLAY_MATH, "dollar_math": DOLLAR_MATH, "tex_quotes": TEX_QUOTES,
}

#: Which rules can match at all, by a character that they need.
_NEEDS = {
    "<": ("tag", "comment", "autolink"), "`": ("fence", "code", "tex_quotes"), "~~": ("fence", "strike"), "*": ("strong", "em", "triple"), "_": ("triple", "under_strong", "under_em", "magic"),
    "[": ("link", "ref_link", "ref_def", "wiki_link", "ext_link"), "{{": ("template",), "\\": ("environment", "command", "bare", "paren_math", "bracket_math"), "$": ("display_math", "dollar_math"),
    "''": ("quotes",), "|": ("table", "wiki_table"),
}
_LINES = ("item", "numbered", "quote", "atx", "setext", "wiki_heading", "wiki_list")
_LINE_START = re.compile(r"^[ \t]*(?:[-*+#>=:;]|\d{1,9}[.)][ \t])", re.M)


def constructs(text: str | None) -> Iterator[str]:
    """Names of the rules that match."""
    if not text:
        return
    if "&" in text and any(m[0][1] == "#" or m[0][1:] in html5 for m in ENTITY.finditer(text)):
        yield "entity"
    for mark, names in _NEEDS.items():
        if mark in text:
            for n in names:
                if RULES[n].search(text):
                    yield n
    if _LINE_START.search(text):
        for n in _LINES:
            if RULES[n].search(text):
                yield n


def has_markup(text: str | None) -> bool:
    return next(constructs(text), None) is not None


# --- clean text -------------------------------------------------------------------------------

_OPEN, _CLOSE = "\ue000", "\ue001"
_HELD = re.compile(f"{_OPEN}(\\d+){_CLOSE}")
_MATH_ENV = re.compile(r"\\begin\{(equation|align|gather|multline|displaymath|math|eqnarray)(\*?)\}(.*?)\\end\{\1\2\}", re.S)
_CODE_ENV = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}(?:\[[^\]\n]*\])?(.*?)\\end\{\1\}", re.S)
_PRE = re.compile(r"<pre\b[^<>]*>((?:(?!<pre\b).)*?)</pre\s*>", re.S | re.I)
_CODE = re.compile(r"<(code|tt|kbd|samp)\b[^<>]*>(.*?)</\1\s*>", re.S | re.I)
#: Elements whose content is not shown. One that is never closed is text about the element, and stays.
_UNSEEN = ("script", "style", "template", "head")
_EDGE = re.compile(rf"<(/?)({'|'.join(_UNSEEN)})\b[^<>]*>", re.I)
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I)
_NOWIKI = re.compile(r"</?(?:nowiki|references|includeonly|noinclude|onlyinclude)\b[^<>]*>", re.I)
_SECTIONS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_SECTION = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}")
_POINTERS = re.compile(r"~?\\(?:ref|eqref|pageref|label|cite|citep|citet|index)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}")
_TAIL_SPACE = re.compile(r"[ \t]+$", re.M)
_BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "ul", "ol", "dl", "table", "blockquote", "figure", "form", "details", "address", "center"}


class _Holder:
    """Code and formulas, kept away from the rules for prose."""

    def __init__(self) -> None:
        self.kept: list[str] = []

    def hold(self, text: str) -> str:
        self.kept.append(text)
        return f"{_OPEN}{len(self.kept) - 1}{_CLOSE}"

    def block(self, code: str) -> str:
        body = code.strip("\n")
        return f"\n{self.hold(f'```\n{body}\n```')}\n"

    def release(self, text: str) -> str:
        done: list[str] = []  # what is held names only what was held before

        def known(m: re.Match[str]) -> str:
            return done[int(m[1])] if int(m[1]) < len(done) else m[0]

        for held in self.kept:
            done.append(_HELD.sub(known, held))
        return _HELD.sub(known, text)


def _fences(text: str, h: _Holder) -> str:
    out, at = [], 0
    while m := FENCE.search(text, at):
        end = re.compile(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", re.M).search(text, m.end() + 1)
        stop, after = (end.start(), end.end()) if end else (len(text), len(text))
        out += [text[at : m.start()], h.block(text[m.end() + 1 : stop])]
        at = after
    return "".join([*out, text[at:]])


def _without_hidden(text: str, h: _Holder) -> str:
    """Text without what a browser does not show; tags of elements that are not closed are held as text."""
    tags = list(_EDGE.finditer(text))
    ends: dict[str, list[int]] = {}
    for i, m in enumerate(tags):
        if m[1]:
            ends.setdefault(m[2].lower(), []).append(i)
    out, at = [], 0
    for i, m in enumerate(tags):
        if m.start() < at:
            continue
        out.append(text[at : m.start()])
        later = ends.get(m[2].lower(), [])
        j = bisect_right(later, i)
        if m[1] or j == len(later):
            out.append(h.hold(m[0]))
            at = m.end()
        else:
            at = tags[later[j]].end()
    return "".join([*out, text[at:]])


def _wiki_label(m: re.Match[str]) -> str:
    """What a wiki link shows: its last part; of a picture the caption, if it has one."""
    if m[2] is None:
        return "" if _FILE.match(m[1]) else m[1]
    if _FILE.match(m[1]):
        return "".join([p for p in m[2].split("|") if not _PICTURE.fullmatch(p.strip())][-1:]).strip()
    return m[2].split("|")[-1] or m[1]


def _html(text: str) -> str:
    """Elements to the plain notation; ``lists`` has the open lists, numbers for ordered ones."""
    out, at, lists, row = [], 0, [], 0
    for m in TAG.finditer(text):
        out.append(text[at : m.start()])
        at, closing, name = m.end(), bool(m[1]), m[2].lower()
        if name in ("ul", "ol", "menu", "dir"):
            if closing:
                lists = lists[:-1]
            else:
                first = re.search(r"""\bstart\s*=\s*["']?(\d+)""", m[3] or "", re.I)
                lists.append(int(first[1]) - 1 if first else 0) if name == "ol" else lists.append(None)
            out.append("\n")
        elif name == "li":
            if not closing:
                if lists and lists[-1] is not None:
                    lists[-1] += 1
                out.append("\n" + "  " * max(0, len(lists) - 1) + ("- " if not lists or lists[-1] is None else f"{lists[-1]}. "))
            else:
                out.append("\n")
        elif name[0] == "h" and name[1:].isdigit():
            out.append("\n\n" if closing else "\n\n" + "#" * int(name[1:]) + " ")
        elif name == "br":
            out.append("\n")
        elif name == "hr":
            out.append("\n\n")
        elif name == "tr":
            row = 0
            out.append("\n")
        elif name in ("td", "th"):
            if not closing:
                out.append(" | " if row else "")
                row += 1
        elif name in ("dt", "dd"):
            out.append("" if closing else "\n")
        elif name in _BLOCKS:
            out.append("\n\n" if name in ("p", "blockquote", "table") else "\n")
        elif name == "img" and (alt := re.search(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)')""", m[3] or "", re.I)):
            out.append(alt[1] or alt[2] or "")
    return "".join([*out, text[at:]])


def _wiki_tables(text: str) -> str:
    """Rows of wiki tables with their cells side by side."""
    if not WIKI_TABLE.search(text):
        return text
    out, cells, inside = [], [], False

    def end_row() -> None:
        if cells:
            out.append(" | ".join(cells))
            cells.clear()

    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("{|"):
            inside = True
        elif inside and bare.startswith("|}"):
            end_row()
            inside = False
        elif inside and bare.startswith("|-"):
            end_row()
        elif inside and bare[:1] in ("|", "!"):
            cells += [c.split("|")[-1].strip() for c in re.split(r"\|\||!!", bare[1:])]
        elif inside and bare:
            cells.append(bare)
        elif not inside:
            out.append(line)
    end_row()
    return "\n".join(out)


_BRACES = re.compile(r"\{\{(?!\{)|\}\}|[{}]")
_WRAP_OR_BRACE = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|[{}]")


def _without_templates(text: str) -> str:
    """Templates of any depth, inner ones first, in one pass.

    ``opened`` has the place in ``out`` of each open pair and whether a brace stays inside it.
    """
    out, opened, at = [], [], 0
    for m in _BRACES.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        if m[0] == "{{":
            opened.append([len(out), False])
            out.append("{{")
        elif m[0] == "}}" and opened:
            start, dirty = opened.pop()
            out.append("}}")
            if not dirty and TEMPLATE.fullmatch("".join(out[start:])):
                del out[start:]
            elif opened:
                opened[-1][1] = True
        else:
            out.append(m[0])
            if opened:
                opened[-1][1] = True
    return "".join([*out, text[at:]])


def _without_wraps(text: str) -> str:
    """Arguments of commands of any depth without the commands, inner ones first, in one pass."""
    out, opened, at = [], [], 0
    for m in _WRAP_OR_BRACE.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        if m[0] != "}":
            opened.append([len(out), len(m[0]) == 1])
            out.append(m[0])
            continue
        if opened and not opened[-1][1]:
            out[opened.pop()[0]] = ""
            continue
        out.append("}")
        if opened:
            opened.pop()
        if opened:
            opened[-1][1] = True
    return "".join([*out, text[at:]])


def _until_same(rule: Callable[[str], str], text: str) -> str:
    while (new := rule(text)) != text:
        text = new
    return text


def _emphasis(text: str) -> str:
    text = TRIPLE.sub(lambda m: m[2], QUOTES.strip(text))
    for rule in (STRONG, EM, UNDER_STRONG, UNDER_EM, STRIKE):
        text = rule.sub(lambda m: m[1], text)
    return text


def clean_text(text: str | None) -> str | None:
    """Text without markup; text that has none is returned as it is."""
    if not text or not has_markup(text):
        return text
    h, t = _Holder(), text.replace("\r\n", "\n").replace(_OPEN, "").replace(_CLOSE, "")
    t = _fences(t, h)
    t = _CODE_ENV.sub(lambda m: h.block(m[2]), t)
    t = _PRE.sub(lambda m: h.block(html.unescape(TAG.sub("", m[1]))), t)
    t = _CODE.sub(lambda m: h.hold(html.unescape(TAG.sub("", m[2]))), t)
    t = INLINE_CODE.sub(lambda m: h.hold(m[2].strip()), t)
    t = _MATH_ENV.sub(lambda m: h.hold(f"$${m[3].strip()}$$"), t)
    t = BRACKET_MATH.sub(lambda m: h.hold(f"$${m[1].strip()}$$"), t)
    t = DISPLAY_MATH.sub(lambda m: h.hold(m[0]), t)
    t = PAREN_MATH.sub(lambda m: h.hold(f"${m[1].strip()}$"), t)
    t = DOLLAR_MATH.sub(lambda m: h.hold(m[0]), t)
    t = COMMENT.sub("", t)
    t = _without_hidden(t, h)
    t = _REF.sub("", t)
    t = _NOWIKI.sub("", t)
    t = _wiki_tables(t)
    t = WIKI_HEADING.sub(lambda m: "#" * len(m[1]) + " " + m[2], t)
    t = SETEXT.sub(lambda m: ("# " if m[2][0] == "=" else "## ") + m[1], t)
    t = REF_DEF.sub("", t)
    t = _until_same(_without_templates, t)
    t = _until_same(lambda x: WIKI_LINK.sub(_wiki_label, x), t)
    t = EXT_LINK.sub(lambda m: m[1] or "", t)
    t = LINK.sub(lambda m: m[2], t)
    t = REF_LINK.sub(lambda m: m[2], t)
    t = AUTOLINK.sub(lambda m: m[1], t)
    t = MAGIC.sub("", t)
    t = _until_same(_emphasis, t)
    t = QUOTE.sub("", t)
    t = ITEM.sub(lambda m: m[1] + "- ", t)
    if TABLE_LINE.search(t):
        t = TABLE_LINE.sub("", t)
        t = re.sub(r"^[ \t]*\|[ \t]*(.*?)[ \t]*\|[ \t]*$", lambda m: " | ".join(c.strip() for c in m[1].split("|")), t, flags=re.M)
    t = _SECTION.sub(lambda m: "#" * _SECTIONS[m[1]] + " " + m[2], t)
    t = _POINTERS.sub("", t)
    t = re.sub(r"^[ \t]*\\item(?:\[([^\]\n]*)\])?[ \t]*", lambda m: "- " + (f"{m[1]} " if m[1] else ""), t, flags=re.M)
    t = ENVIRONMENT.sub("", t)
    t = _until_same(_without_wraps, t)
    t = re.sub(r"``([^`'\n]+)''", r"“\1”", t)
    t = BARE.sub("", t)
    t = html.unescape(_html(t))
    t = re.sub(r"\n{3,}", "\n\n", _TAIL_SPACE.sub("", t)).strip()
    return h.release(t)


# --- columns ----------------------------------------------------------------------------------

#: Texts without any of these characters, and without a line that starts with one of the second kind, hold no construct.
_MAYBE = r"(?m)[<&`*_\[\\$|~{]|''|^[ \t]*(?:[-+#>=:;]|\d{1,9}[.)][ \t])"


def maybe_markup(text: str) -> Column:
    """A filter that stays in the JVM and passes every text with a construct."""
    return F.col(text).rlike(_MAYBE)


def marked_up(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key): once for every key with a text that holds a construct."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = pa.array([has_markup(t) for t in b.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(hit)], [key])

    rows = df.where(F.col(key).isNotNull() & maybe_markup(text)).select(key, text)
    return rows.mapInArrow(run, f"`{key}` {kind}").distinct()


def clean_column(df: DataFrame, key: str, text: str, host: str | None = None) -> DataFrame:
    """(key, text): the clean text of every row.

    ``host``: column that names where a page comes from; text that the pages of a host have in
    common in one place of their trees is template and goes first.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            if host:
                texts = [wrapper.without_template(t, w) if w else t for t, w in zip(texts, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([clean_text(t) for t in texts], pa.string())], [key, "text"])

    rows = df.select(key, text, *([host] if host else []))
    plain = rows.where(F.col(text).isNull() | ~maybe_markup(text)).select(key, F.col(text).alias("text"))
    marked = rows.where(maybe_markup(text))
    if host:
        found = wrapper.wrappers(rows, key, text, host).where("q_constant > 0").select("q_host", "q_wrapper")
        marked = marked.join(found, F.col(host).eqNullSafe(F.col("q_host")), "left").select(key, text, "q_wrapper")
    return plain.unionByName(marked.mapInArrow(run, f"`{key}` {kind}, text string"))

"""Clean text from pieces that carry Markdown, HTML, wiki or LaTeX markup (problem 6).

Each language has a lexer. What the lexers find becomes marks in the text, and all marks together are parsed with a
stack into one tree, whose nodes carry the language they come from: elements, headings, items, rows, links,
emphasis, code blocks and formulas. Code blocks and formulas are taken out first, so that nothing in them is taken for markup.

The tree is scored: paragraphs pass points for length and commas to their parent and, halved, to their grandparent,
discounted by the share of text in links. The best container and what stands beside it or its ancestors is kept, but
for HTML containers that are mostly links and score little. The languages of a piece are those of its nodes.
Structure stays recognisable in a neutral form:

    [h2] heading    • item    (1) item    cells parted by tabs
    [code] and [/code] around code lines    [math] and [/math] around formulas

Defined results: null stays null with no markup; blank text becomes empty. Text without
markup comes back as it is, but for trailing blanks and runs of blank lines. Elements nested deeper than DEEPEST are not told apart.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("markdown", "html", "wiki", "latex")

# Element names of HTML, and commands of LaTeX in text and in formulas.
TAGS = frozenset(
    """a abbr address article aside audio b blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em
    figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav
    noscript ol option p picture pre q s samp script section select small span strike strong style sub summary sup svg table tbody td
    textarea tfoot th thead time title tr tt u ul var video wbr""".split()
)
COMMANDS = "cite|citep|citet|ref|eqref|pageref|label|footnote|emph|textbf|textit|texttt|textsc|underline|section|subsection|subsubsection|chapter|paragraph|subparagraph|part|caption|url|href|title|author|date|usepackage|documentclass|includegraphics|input|begin|end|verb"
MATH = "frac|dfrac|sqrt|sum|prod|int|cdot|cdots|ldots|times|div|pm|le|leq|ge|geq|neq|ne|approx|sim|equiv|infty|partial|nabla|alpha|beta|gamma|delta|epsilon|lambda|mu|sigma|theta|omega|pi|phi|rho|tau|log|ln|exp|min|max|lim|to|in|left|right|mathbf|mathrm|hat|bar|vec|quad"

TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[^<>\n]*|\s*/)?)>")
ELEMENT = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*|\s*/)?)>")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|\A[^<\n]*-->[ ]*$", re.S | re.M)
ENTITY = re.compile(r"&(?:[a-z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,5});")
FENCE = re.compile(r"^[ ]{0,3}(?:```|~~~)[^\n`]*$", re.M)
TRAILING = re.compile(r"[ \t]+(?=\n)")
DRIVE = re.compile(r"(?<![A-Za-z])[A-Za-z]:\\\S*")
CODE_LINE = re.compile(r"\s*(?:- )?[\w\"'./-]+:(?:\s|$)|\s+# |\s+- ")
#: Private-use characters around the numbers of what is taken out, and of marks.
PRIVATE = re.compile("[\ue000-\ue003\ue010\ue011]")
MARK = re.compile("\ue000(\\d+)\ue001|\ue010(\\d+)\ue011")

WIKI = re.compile(
    r"^[ ]*(?:\{\|[^\n]*$|\|\}[ ]*$|\|-[^\n|]*$|![ ]*[^!\s][^!\n]*!![^\n]*|\|[^\n]*\|\|)|\[\[(?![\s\]:-])[^\[\]\n]+\]\]|(?<!')'''(?!')|(?<![\w'`])''(?=[^'\s])[^\n']+?''(?!')"
    r"|\{\{(?![\s{%.])[^{}]*(?:\}\}|\Z)|^(={2,6})[ ]?[^=\n].*?\1[ ]*$|(?<!\])\[https?://[^\s\]]+[ ][^\]\n]+\](?!\()|<(?:ref|nowiki|references)\b[^<>]*>|^\|[ ]*\w[\w ]*=[^\n]*$|^#REDIRECT|__(?:TOC|NOTOC|NOEDITSECTION)__",
    re.M,
)
LATEX = re.compile(
    rf"\\(?:{COMMANDS})\*?(?:\[[^\]\n]*\])*\{{|^[ ]*\\item(?![A-Za-z\\])|\\(?:maketitle|tableofcontents|newpage|noindent|centering)\b|(?<!\\)\\[\[(](?=\s|[^\n]*\\[\])])|\\[\])](?=\s|$|[.,;])|\\(?:{MATH})(?![A-Za-z\\])|(?<![\w\\$])\$(?=[^\s$])[^$\n]*?(?:\\[a-z]+|[_^]\{{)[^$\n]*?\$|\$\$[^$]*\$\$",
    re.M,
)
INLINE = (
    re.compile(r"(?<![\w*\\])\*\*(?=[^\s*])[^\n]*?[^\s*]\*\*|(?<=[^\x00-\x7f])\*\*(?=[^\s*])[^\n*]*?[^\s*]\*\*"),
    re.compile(r"(?<![A-Za-z0-9_])__(?=[^\W_])(?!\w+__(?:\.py\b|\())[^\n_]*?[^\s_]__(?![A-Za-z0-9_])"),
    re.compile(r"(?<![A-Za-z0-9*\\])\*(?=[^\W_]|[“„«「¿¡(])[^\n*]*?[^\s*]\*(?![A-Za-z0-9*])"),
    re.compile(r"(?<![A-Za-z0-9_/.~])_(?=[^\W_]|[“„«「¿¡(])[^\n_]*?[^\s_/]_(?![A-Za-z0-9_/.])"),
    re.compile(r"~~(?=\S)[^\n~]+?~~"),
    re.compile(r"(?<!`)`(?=[^`\s'])[^`\n]*[^`\s]`(?![`'])|(?<!`)`[^`\s']`(?![`'])"),
    re.compile(r"!?\[[^\[\]\n]*\]\([^()\s]+(?:\s[^()\n]*)?\)"),
)
LINES = re.compile(
    r"^[ ]{0,3}#{1,6}[ \t]+\S|^[ ]{0,6}[-+*][ \t]+\S|^[ ]{0,6}\d{1,3}[.)][ \t]+\S|^[ ]{0,3}>[ \t]?\S|^\|?[ ]*:?-{3,}:?[ ]*\|[-:| ]*$|^\|(?!\|)(?:[^\n|]+\|){2,}[ ]*$|^[ ]{0,3}\[[^\]\n^]+\]:[ ]+\S+|^[ ]{0,3}(?:\*[ ]?){3,}$|(?<!\S)\{#[\w-]+\}[ ]*$",
    re.M,
)

UNDERLINED = re.compile(r"^[^\n]*\S\n(?:={3,}|-{3,})[ ]*$", re.M)


class Held:
    """Text with its code blocks and formulas set aside, each behind a private-use mark."""

    def __init__(self, text: str):
        self.parts: list[tuple[str, str, str | None]] = []
        self.text = self._formulas(self._code(text if text.isascii() else PRIVATE.sub("", text)))

    @property
    def kinds(self) -> set[str]:
        return {kind for _, _, kind in self.parts if kind}

    def keep(self, form: str, content: str, kind: str | None = None) -> str:
        self.parts.append((form, content, kind))
        return f"\ue000{len(self.parts) - 1}\ue001"

    def _span(self, text: str, start: int, end: int, kind: str, content: str) -> str:
        return text[:start] + "\n" + self.keep("code", content.strip("\n"), kind) + "\n" + text[end:]

    def _code(self, text: str) -> str:
        if "\\begin{" in text or "\\end{" in text:
            text = self._delimited(text, r"\\begin\{(?:verbatim|lstlisting|minted|Verbatim)\*?\}(?:\[[^\]\n]*\])?(?:\{\w+\})?", r"\\end\{(?:verbatim|lstlisting|minted|Verbatim)\*?\}", "latex")
        if "<" in text:
            text = self._delimited(text, r"<(?:nowiki|syntaxhighlight|source)\b[^<>]*>", r"</(?:nowiki|syntaxhighlight|source)>", "wiki")
            text = self._delimited(text, r"<pre\b[^<>]*>(?:\s*<code\b[^<>]*>)?", r"(?:</code>\s*)?</pre>", "html")
        if "```" in text or "~~~" in text:
            text = self._fences(text)
        return self._bare(text)

    def _delimited(self, text: str, opening: str, closing: str, kind: str) -> str:
        """Blocks between delimiters; without its other end, a piece of one from its beginning or to its end."""
        while True:
            a, b = re.search(opening, text), re.search(closing, text)
            if a and b and b.start() < a.start():
                a = None
            if a:
                end = re.compile(closing).search(text, a.end())
                stop = end.end() if end else len(text)
                text = self._span(text, a.start(), stop, kind, text[a.end() : end.start() if end else stop])
            elif b:  # the block began before this piece
                start = text.rfind("\n\n", 0, b.start()) + 1
                text = self._span(text, start, b.end(), kind, text[start : b.start()])
            else:
                return text

    def _fences(self, text: str) -> str:
        while m := FENCE.search(text):
            mark = m[0].strip()[:3]
            plain = m[0].strip() in ("```", "~~~")
            end = next((x for x in FENCE.finditer(text, m.end()) if x[0].strip() == mark), None)
            above = text[: m.start()].rstrip("\n")
            cut = plain and above and not text[: m.start()].endswith("\n\n") and CODE_LINE.match(above.rsplit("\n", 1)[-1])
            if cut:  # it closes a block that began before this piece
                start = text.rfind("\n\n", 0, m.start()) + 1
                text = self._span(text, start, m.end(), "markdown", text[start : m.start()])
            else:
                stop = end.end() if end else len(text)
                text = self._span(text, m.start(), stop, "markdown", text[m.end() : end.start() if end else stop])
        return text

    def _bare(self, text: str) -> str:
        """Code lines whose delimiters lie outside this piece: paragraphs made of keys and indented entries."""
        if "\n  " not in text and not text.startswith("  "):
            return text
        out = []
        for block in re.split(r"(\n[ \t]*\n)", text):
            lines = block.strip("\n").split("\n")
            keyed = sum(bool(CODE_LINE.match(x)) for x in lines)
            if keyed and keyed == len(lines) and any(x.startswith("  ") for x in lines):
                block = self.keep("code", block.strip("\n"))
            out.append(block)
        return "".join(out)

    def _formulas(self, text: str) -> str:
        if "\\" not in text and "$" not in text:
            return text

        def keep(m: re.Match) -> str:
            inner = re.sub(r"^(?:\\begin\{[a-z]+\*?\}|\\\[|\\\(|\$\$?)|(?:\\end\{[a-z]+\*?\}|\\\]|\\\)|\$\$?)$", "", m[0]).strip()
            return self.keep("math", inner, "latex")

        text = re.sub(r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math)(\*?)\}.*?(?:\\end\{\1\2\}|\Z)", keep, text, flags=re.S)
        text = re.sub(r"\$\$[^$]+\$\$|(?<![\w:\\])\\\[(?=\s).*?\\\]|(?<![\w:\\])\\\((?=\s).*?\\\)", keep, text, flags=re.S)
        return re.sub(r"(?<![\w\\$])\$(?=[^\s$])[^$\n]*?(?:\\[a-z]+|[_^]\{)[^$\n]*?\$", keep, text)


def lexed(held: Held) -> set[str]:
    """The languages of which a lexer finds something, code blocks and formulas counting for their delimiters."""
    t, found = held.text, held.kinds
    if "<" in t or "&" in t or "-->" in t:
        if any(m[2].lower() in TAGS and not (m[2][0].isupper() and t[m.start() - 1 : m.start()].isalnum() and f"</{m[2]}" not in t) for m in TAG.finditer(t)) or COMMENT.search(t) or any(m[0][1] == "#" or html.unescape(m[0]) != m[0] for m in ENTITY.finditer(t)):
            found.add("html")
    if ("[" in t or "{" in t or "''" in t or "|" in t or "==" in t) and WIKI.search(t):
        found.add("wiki")
    if "\\" in t or "$" in t:
        plain = DRIVE.sub(" ", t)
        if LATEX.search(plain) or re.search(r"\\\\?(?:emph|texttt|textbf|textit)\{", t):
            found.add("latex")
    if LINES.search(t) or any(c in t and p.search(t) for p, c in zip(INLINE, ("**", "__", "*", "_", "~~", "`", "]("))) or ("\n===" in t or "\n---" in t) and UNDERLINED.search(t):
        found.add("markdown")
    return found


class Marks:
    """What marks in a text stand for: an element opening, closing or without content, by name, language and attributes."""

    def __init__(self) -> None:
        self.known: dict[tuple, str] = {}
        self.list: list[tuple[str, str, str, str]] = []

    def __call__(self, action: str, name: str, language: str, attributes: str = "") -> str:
        key = (action, name, language, attributes)
        if key not in self.known:
            self.known[key] = f"\ue010{len(self.list)}\ue011"
            self.list.append(key)
        return self.known[key]

    def around(self, name: str, language: str, inner: str) -> str:
        return self("open", name, language) + inner + self("close", name, language)


class Node:
    __slots__ = ("name", "language", "attributes", "children", "parent", "score", "chars", "linked", "links")

    def __init__(self, name: str, language: str | None = None, attributes: str = "", parent: Node | None = None):
        self.name, self.language, self.attributes, self.parent = name, language, attributes, parent
        self.children: list[Node | str] = []
        self.score, self.chars, self.linked, self.links = 0.0, 0, 0, 0

    def density(self) -> float:
        """The share of text within links."""
        return self.linked / max(1, self.chars)

    def own(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))


DEEPEST = 200
VOID = frozenset("br hr img input link meta wbr col".split())
# What an element ends when it begins, up to the next list, table or container.
ENDS = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
CONTAINERS = frozenset("root div section article main td body html".split())
PARAGRAPHS = frozenset("p pre li blockquote dd".split())
# Containers that may be left out, and from which share of links on.
BESIDE = {"nav": 0.3, "footer": 0.3, "aside": 0.3, "header": 0.3, "form": 0.3, "div": 0.6, "section": 0.6, "ul": 0.6, "ol": 0.6, "table": 0.6}
UNSEEN = frozenset("script style head noscript meta link".split())


def parsed(text: str, marks: Marks, held: Held, entities: bool) -> tuple[Node, list[Node]]:
    """The tree of a marked text, and its nodes, each after its parent."""
    root = at = Node("root")
    nodes, depth, pos = [root], 0, 0

    def child(name: str, language: str | None, attributes: str = "") -> Node:
        node = Node(name, language, attributes, at)
        at.children.append(node)
        nodes.append(node)
        return node

    def words(upto: int) -> None:
        if upto > pos:
            at.children.append(html.unescape(text[pos:upto]) if entities else text[pos:upto])

    for m in MARK.finditer(text) if marks.list or held.parts else ():
        words(m.start())
        pos = m.end()
        if m[1]:
            form, content, language = held.parts[int(m[1])]
            child(f"#{form}", language).children.append(content)
            continue
        action, name, language, attributes = marks.list[int(m[2])]
        if action == "close":
            up, n = at, depth
            while up is not root and (up.name, up.language) != (name, language):
                up, n = up.parent, n - 1
            if up is not root:
                at, depth = up.parent, n - 1
            continue
        for ended in ENDS.get(name, ()) if action == "open" else ():
            up, n = at, depth
            while up is not root and up.name not in ("ul", "ol", "table", "div", ended):
                up, n = up.parent, n - 1
            if up.name == ended:
                at, depth = up.parent, n - 1
        node = child(name, language, attributes)
        if action == "open" and name not in VOID and depth < DEEPEST:
            at, depth = node, depth + 1
    words(len(text))
    return root, nodes


def scored(nodes: list[Node]) -> Node:
    """Score the nodes and give the best one. Lengths are summed from the leaves up, points go from paragraphs up."""
    for node in reversed(nodes):
        node.chars += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.name == "a":
            node.linked, node.links = node.chars, node.links + 1
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.links += node.links
    for node in nodes:
        if node.name in CONTAINERS:
            said, up = node.own(), node
        elif node.name in PARAGRAPHS:
            said, up = "".join(c if isinstance(c, str) else c.own() for c in node.children), node.parent
        else:
            continue
        if len(said.strip()) >= 25:
            points = (1 + said.count(",") + said.count("，") + said.count("、") + min(len(said) / 100, 3)) * (1 - node.density())
            up.score += points
            if up.parent is not None:
                up.parent.score += points / 2
    for node in nodes:
        node.score *= 1 - node.density()
    return max(nodes, key=lambda n: n.score)


def left_out(nodes: list[Node], best: Node) -> frozenset[int]:
    """The nodes to leave out: HTML containers that are mostly links and score little, unless they hold the best one."""
    if best.score <= 0:
        return frozenset()
    chain, up = set(), best
    while up is not None:
        chain.add(id(up))
        up = up.parent
    return frozenset(
        id(n) for n in nodes if n.language == "html" and n.name in BESIDE and id(n) not in chain and n.links >= 2 and n.density() >= BESIDE[n.name] and n.score < 0.2 * best.score
    )


def render(root: Node, without: frozenset[int]) -> str:
    """Text of a tree with its structure in the neutral form."""
    out: list[str] = []
    ordered: list[int] = []

    def show(node: Node) -> None:
        cells = 0
        for c in node.children:
            if isinstance(c, str):
                out.append(c)
                continue
            name = c.name
            if id(c) in without or c.language == "html" and name in UNSEEN:
                continue
            if name == "#code":
                out.append(f"[code]\n{c.own()}\n[/code]")
            elif name == "#math":
                out.append(f"[math] {re.sub(r'\s+', ' ', c.own())} [/math]")
            elif c.language != "html":
                show(c)
            elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                out.append(f"\n[{name}] ")
                show(c)
                out.append("\n")
            elif name in ("ul", "ol"):
                ordered.append(0 if name == "ol" else -1)
                out.append("\n")
                show(c)
                ordered.pop()
                out.append("\n")
            elif name == "li":
                if ordered and ordered[-1] >= 0:
                    ordered[-1] += 1
                    out.append(f"\n({ordered[-1]}) ")
                else:
                    out.append("\n• ")
                show(c)
            elif name in ("td", "th"):
                if cells:
                    out.append("\t")
                cells += 1
                at = len(out)
                show(c)
                out[at:] = [re.sub(r"\s*\n\s*", " ", "".join(out[at:])).strip()]
            elif name in ("tr", "br", "hr"):
                out.append("\n")
                show(c)
            elif name in ("p", "div", "table", "blockquote", "section", "article", "figure", "dl", "dt", "dd", "caption"):
                out.append("\n")
                show(c)
                out.append("\n")
            elif name == "img":
                out.append((re.search(r"\balt=[\"']?(.*?)[\"']?(?=\s\w+=|$)", c.attributes) or ["", ""])[1])
            else:
                show(c)

    show(root)
    return "".join(out)


def mark_html(text: str, mark: Marks) -> str:
    """Known elements as marks; comments, and what stands in elements that are not shown, go."""
    text = COMMENT.sub(mark("void", "comment", "html"), text)
    text = re.sub(r"(?is)<(script|style|head|noscript)\b[^<>]*>.*?</\1\s*>", mark("void", "unseen", "html"), text)

    def element(m: re.Match) -> str:
        name = m[2].lower()
        if name not in TAGS:
            return m[0]
        if m[1]:
            return mark("close", name, "html")
        rest = m[3].strip()
        return mark("void" if name in VOID or rest.endswith("/") else "open", name, "html", rest.rstrip("/").strip() if name == "img" else "")

    return ELEMENT.sub(element, text)


def joined(lines: list[str | tuple[str]]) -> str:
    """Lines, and marks alone in a tuple, which go before the line that follows."""
    out, before = [], ""
    for line in lines:
        if isinstance(line, tuple):
            before += line[0]
        else:
            out.append(before + line)
            before = ""
    if before:
        out = [*out[:-1], out[-1] + before] if out else [before]
    return "\n".join(out)


def mark_wiki(text: str, mark: Marks) -> str:
    gone = mark("void", "reference", "wiki")
    text = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|</?(?:ref|references|nowiki)\b[^<>]*>", gone, text, flags=re.S)
    text = re.sub(r"\[\[(?:File|Image|Category|Datei|Fichier|Archivo|Kategorie)\s*:[^\[\]\n]*\]\]\n?", gone, text, flags=re.I)
    link = lambda m: mark.around("a", "wiki", m[1])
    text = re.sub(r"\[\[(?![\s-])(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", link, text)
    text = re.sub(r"(?<!\])\[https?://[^\s\]]+ ([^\]\n]+)\](?!\()", link, text)

    def template(m: re.Match) -> str:
        name, *args = m[1].split("|")
        named = [tuple(y.strip() for y in a.split("=", 1)) for a in args if "=" in a]
        said = "\n".join([name.strip(), *("\t".join(x) for x in named)]) if named else args[-1].strip() if args else ""
        return mark("void", "template", "wiki") + said

    inner = re.compile(r"\{\{(?![\s{%.])([^{}]*)\}\}")
    while inner.search(text):  # from the innermost out; every round takes a pair of braces away
        text = inner.sub(template, text)
    text = re.sub(r"'{2,5}", mark("void", "b", "wiki"), text)
    out: list = []
    for line in text.split("\n"):
        if m := re.fullmatch(r"(={1,6})[ ]?([^=].*?)\1[ ]*", line):
            line = mark("void", "heading", "wiki") + f"[h{len(m[1])}] {m[2].strip()}"
        elif re.match(r"\s*(?:\{\||\|\}|\|-|\}\}|__[A-Z]+__)", line):
            line = (mark("void", "table", "wiki"),)
        elif re.match(r"\s*!", line) and ("!!" in line or not re.search(r"[.!?]\s*$", line)):
            line = mark("void", "row", "wiki") + "\t".join(x.strip() for x in re.split(r"!!|\|\|", line.strip()[1:]))
        elif re.match(r"\|\+", line):
            line = mark("void", "row", "wiki") + line[2:].strip()
        elif "||" in line and line.lstrip().startswith("|"):
            line = mark("void", "row", "wiki") + "\t".join(x.strip() for x in line.strip()[1:].split("||"))
        elif m := re.fullmatch(r"\|[ ]*(\w[\w ]*?)[ ]*=[ ]*(.*)", line):
            line = mark("void", "row", "wiki") + f"{m[1]}\t{m[2]}"
        out.append(line)
    return joined(out)


def mark_latex(text: str, mark: Marks) -> str:
    paths: list[str] = []

    def keep(m: re.Match) -> str:
        paths.append(m[0])
        return f"\ue002{len(paths) - 1}\ue003"

    text = DRIVE.sub(lambda m: m[0] if "{" in m[0] or "](" in m[0] else keep(m), text)
    level = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
    text = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{([^{}\n]*)\}", lambda m: f"\n{mark('void', 'heading', 'latex')}[h{level[m[1]]}] {m[2]}\n", text)
    number: list[int] = []
    out: list = []
    for line in text.split("\n"):
        if m := re.search(r"\\(begin|end)\{(itemize|enumerate|description|center|document|figure|table|tabular|quote|abstract)\*?\}(?:\[[^\]]*\]|\{[^{}]*\})*", line):
            if m[1] == "begin":
                number.append(0 if m[2] == "enumerate" else -1)
            elif number:
                number.pop()
            out.append((mark("void", m[2], "latex"),))
            line = line.replace(m[0], "")
            if not line.strip():
                continue
        if m := re.match(r"\s*\\item(?![A-Za-z\\])(?:\[([^\]]*)\])?\s*", line):
            rest = (f"{m[1]} " if m[1] else "") + line[m.end() :]
            item = mark("void", "item", "latex")
            if number and number[-1] >= 0:
                number[-1] += 1
                line = f"{item}({number[-1]}) {rest}"
            else:
                line = f"{item}• {rest}"
        out.append(line)
    text = joined(out)
    gone = mark("void", "command", "latex")
    text = re.sub(r"[ ~]?\\(?:cite|citep|citet|ref|eqref|pageref|label|usepackage|documentclass|includegraphics|input)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}", gone, text)
    styled = re.compile(r"\\\\?(?:emph|textbf|textit|texttt|textsc|underline|footnote|caption|title|author|date|url|text|verb|href)\{([^{}\n]*)\}")
    while styled.search(text):  # from the innermost out
        text = styled.sub(lambda m: mark.around("emphasis", "latex", m[1]), text)
    text = re.sub(r"\\(?:begin|end)\{[a-zA-Z]+\*?\}|\\(?:maketitle|tableofcontents|newpage|noindent|centering)\b", gone, text)
    loose = re.compile(rf"\\(?:{MATH})(?![A-Za-z\\])")
    if loose.search(text):  # a formula whose delimiters lie outside
        text = "\n".join(f"{mark('void', 'formula', 'latex')}[math] {x.strip()} [/math]" if loose.search(x) and "[math]" not in x else x for x in text.split("\n"))
        text = re.sub(r"(?m)^\s*\\[\[\]]\s*$", "", text)
    text = re.sub(r"\\([%&#_{}$])", r"\1", text)
    return re.sub("\ue002(\\d+)\ue003", lambda m: paths[int(m[1])], text)


def mark_markdown(text: str, mark: Marks) -> str:
    void = lambda name: mark("void", name, "markdown")
    text = re.sub(r"(?m)^[ ]{0,3}\[[^\]\n^]+\]:[ ]+\S+.*\n?", void("definition"), text)
    text = INLINE[6].sub(lambda m: mark.around("a", "markdown", re.match(r"!?\[([^\[\]\n]*)\]", m[0])[1]), text)
    text = re.sub(r"(?m)^([^\n|]*\S)\n(={3,}|-{3,})[ ]*$", lambda m: f"{void('heading')}[h{1 if m[2][0] == '=' else 2}] {m[1]}", text)
    out: list = []
    for line in text.split("\n"):
        if m := re.match(r"[ ]{0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*(?:\{#[\w-]+\})?[ ]*$", line):
            line = f"{void('heading')}[h{len(m[1])}] {m[2]}"
        elif re.match(r"^\|?[ ]*:?-{3,}:?[ ]*\|[-:| ]*$", line) or re.fullmatch(r"[ ]{0,3}(?:\*[ ]?){3,}", line):
            line = (void("rule"),)
        elif m := re.match(r"([ ]{0,6})[-+*][ \t]+(?=\S)", line):
            line = f"{m[1]}{void('item')}• {line[m.end() :]}"
        elif m := re.match(r"([ ]{0,6})(\d{1,3})[.)][ \t]+(?=\S)", line):
            line = f"{m[1]}{void('item')}({m[2]}) {line[m.end() :]}"
        elif m := re.match(r"[ ]{0,3}(?:>[ \t]?)+", line):
            line = void("quote") + line[m.end() :]
        elif re.match(r"^\|(?!\|)(?:[^\n|]+\|){2,}[ ]*$", line):
            line = void("row") + "\t".join(x.strip() for x in line.strip().strip("|").split("|"))
        out.append(re.sub(r"[ ]*\{#[\w-]+\}[ ]*$", "", line) if isinstance(line, str) else line)
    text = joined(out)
    for p, n in ((INLINE[0], 2), (INLINE[1], 2), (INLINE[4], 2), (INLINE[5], 1), (INLINE[2], 1), (INLINE[3], 1)):
        text = p.sub(lambda m, n=n: mark.around("emphasis", "markdown", m[0][n:-n]), text)
    return text


def tree_of(text: str) -> tuple[Node, list[Node]]:
    """The tree of a text, and its nodes. What a lexer finds and no rule marks is a node of its own."""
    held, mark = Held(text), Marks()
    found, t = lexed(held), held.text
    for language, rule in (("html", mark_html), ("wiki", mark_wiki), ("latex", mark_latex), ("markdown", mark_markdown)):
        if language in found:
            t = rule(t, mark)
    root, nodes = parsed(t, mark, held, "html" in found)
    for language in sorted(found - {n.language for n in nodes}):
        nodes.append(Node("token", language, "", root))
        root.children.append(nodes[-1])
    return root, nodes


def convert(text: str | None) -> tuple[str | None, list[str]]:
    """Clean text, and the languages whose markup was in it."""
    if text is None:
        return None, []
    root, nodes = tree_of(text)
    languages = {n.language for n in nodes}
    t = render(root, left_out(nodes, scored(nodes)) if "html" in languages else frozenset())
    if "html" in languages:
        t = t.replace("\xa0", " ")
    if " \n" in t or "\t\n" in t:
        t = TRAILING.sub("", t)
    if "\n\n\n" in t:
        t = re.sub(r"\n{3,}", "\n\n", t)
    t = t.rstrip(" \t\n").strip("\n ")
    return t, [k for k in KINDS if k in languages]


CLEANED = "clean_text string, markups array<string>"


def clean_pieces(pieces: DataFrame) -> DataFrame:
    """piece_id, clean_text and markups of pieces (piece_id, text); repeated rows give repeated rows."""

    @F.pandas_udf(CLEANED)
    def clean(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([convert(t) for t in texts], columns=["clean_text", "markups"])

    return pieces.select("piece_id", clean("text").alias("c")).select("piece_id", "c.clean_text", "c.markups")


def markup_found(pieces: DataFrame) -> DataFrame:
    """piece_id and markup, one row each."""
    return clean_pieces(pieces).select("piece_id", F.explode("markups").alias("markup")).distinct()

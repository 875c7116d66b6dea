"""Section text to Markdown, and commands to markers, as pure functions of one text; ``udfs`` runs them.

The rules are an ordered list.  Each names a string without which it changes nothing, so most
texts skip most rules.  Math is taken out first under numbered marks and put back last, so no rule touches it,
and math in a block that a rule drops goes with the block.  Add a rule by inserting it into ``RULES``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

from scriptorium.functions import kernels as K

Rule = Callable[[str], str]

#: For Java's patterns too.
MATH = r"(?s)\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|(?<!\\)\$(?:\\.|[^$\\])++\$"
_MARK = "\ue000"
#: White space as Java's ``\s`` has it, and all that Unicode calls so.
_S = r"[ \t\n\x0b\f\r]"
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Environments that become block quotes.
THEOREMS = ["definition", "theorem", "lemma", "proof", "proposition", "corollary", "claim", "remark", "example", "fact", "observation", "conjecture", "assumption"]
CALLOUTS = [
    "mdframed", "tcolorbox", "tcb", "framed", "shaded", "colorbox", "takeaway", "monoquote", "SQLVerbatim", "verbatimcode", "finding", "remark", "note",
    "highlight", "insight", "observation", "recipe", "callout", "infobox", "warningbox", "errorbox", "examplebox", "promptbox", "attackbox", "defensebox",
]
# Commands without content, by the number of their arguments.
BARE = (
    "maketitle tableofcontents printbibliography appendix centering noindent linebreak newline newpage clearpage smallskip medskip bigskip par quad qquad "
    "hfill vfill FloatBarrier ignorespaces protect parttoc xspace arraystretch tabcolsep itemsep topsep parsep parskip columnwidth textwidth linewidth "
    "gdef global let balance onecolumn twocolumn enddocument endinput cleardoublepage dotfill hrulefill"
).split()
ONE_ARGUMENT = r"bibliographystyle bibliography input include hspace\*? vspace\*? afterpage thispagestyle pagestyle part color ding".split()
TWO_ARGUMENTS = "setcounter addtocounter setlength renewcommand providecommand rule".split()
FRAMES = (
    "minipage monoquote takeaway mybox comment highlight SQLVerbatim verbatimcode prompt attack defense finding remark note callout infobox warningbox "
    "errorbox examplebox insight tcb recipe"
).split()
SYMBOLS = r"bm operatorname\*? mathcal mathbb mathfrak mathrm mathit mathbf mathring widetilde widehat overline underline ensuremath".split()
SIZES = "Large large huge Huge small footnotesize scriptsize tiny normalsize bf bfseries it itshape sf sffamily tt ttfamily rm rmfamily em sl slshape sc scshape".split()

_A = r"\{[^{}]*+\}"
_NOISE = "|".join((
    rf"\\(?:{'|'.join(BARE)})(?![a-z])",
    rf"\\(?:{'|'.join(ONE_ARGUMENT)}){_A}",
    rf"\\(?:{'|'.join(TWO_ARGUMENTS)}){_A}{_A}",
    rf"\\addcontentsline{_A}{_A}{_A}",
    r"\\(?:hypersetup|graphicspath)\{(?:[^{}]|\{[^{}]*+\})*+\}",
    rf"\\(?:begin|end)(?:{'|'.join(FRAMES)})(?![a-z])",
))


def strip(text: str) -> str:
    return text.strip(_BLANK)


def _sub(pattern: str, by: str | Callable[[re.Match], str] = "") -> Rule:
    compiled = re.compile(pattern)
    return lambda text: compiled.sub(by, text)


def _turns(*rules: tuple[str, Rule]) -> Rule:
    """(needle, rule) in turn."""

    def run(text: str) -> str:
        for needle, rule in rules:
            if needle in text:
                text = rule(text)
        return text

    return run


# Markers.
CITE = rf"\\[A-Za-z]*[cC]ite[A-Za-z]*+\*?{_S}*+(?:\[[^\]]*+\]{_S}*+){{0,2}}\{{([^{{}}]*+)\}}"
REF = r"\\(?:eqref|autoref|cref|Cref|nameref|pageref|vref|prettyref|ref)\{([^{}]*+)\}"
NOTE = r"(?s)\\footnote\{((?:[^{}\\]|\\.|\{[^{}]*+\})*+)\}"
_CITE, _REF, _NOTE = re.compile(CITE), re.compile(REF), re.compile(NOTE)


def _names(arguments: str) -> list[str]:
    """Trimmed names of a comma-separated argument, in order, repeats kept."""
    return [n for x in arguments.split(",") if (n := strip(x))]


def _marked(text: str, pattern: re.Pattern, sign: str, seen: list[str]) -> str:
    """The text with markers; their names are added to those seen."""

    def put(m: re.Match) -> str:
        names = _names(m[1])
        seen.extend(names)
        return "[" + "; ".join([sign + n for n in names]) + "]"

    return pattern.sub(put, text)


def mark_cites(text: str) -> str:
    return _marked(text, _CITE, "@", []) if "ite" in text else text


def mark_refs(text: str) -> str:
    return _marked(text, _REF, "#", []) if "ref" in text else text


def markers(text: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """(cites, refs, bodies of footnotes, the text with markers as it stands around the footnotes)."""
    cites: list[str] = []
    refs = [n for x in _REF.findall(text) for n in _names(x)] if "ref" in text else []
    text = mark_refs(_marked(text, _CITE, "@", cites) if "ite" in text else text)
    parts = _NOTE.split(text) if "\\footnote{" in text else [text]
    return cites, refs, parts[1::2], parts[::2]


def marked_headings(text: str) -> list[tuple]:
    """``kernels.headings`` with (cites, refs, notes, marked) of each slice in place of the slice; footnotes count through the text."""
    out, n = [], 0
    for *heading, raw in K.headings(text):
        cites, refs, bodies, rest = markers(raw)
        notes = [{"number": n + i, "text": strip(b)} for i, b in enumerate(bodies, 1)]
        marked = "".join([rest[0], *(f"[^fn:{n + i}]{part}" for i, part in enumerate(rest[1:], 1))])
        out.append((*heading, cites, refs, notes, marked))
        n += len(bodies)
    return out


# Cleaning.
def _quote_lines(body: str) -> str:
    return "\n".join("> " + x if x else ">" for x in strip(body).split("\n"))


def _quoted(pattern: str, body: int, head: Callable[[re.Match], str] = lambda m: "") -> Rule:
    """Environments as block quotes."""
    return _sub(pattern, lambda m: f"\n\n{head(m)}{_quote_lines(m[body])}\n")


def _theorem_head(m: re.Match) -> str:
    return f"> **{m[1].capitalize()}{f' ({m[2]})' if m[2] else ''}.**\n"


_THEOREM = rf"(?s)\\begin\{{({'|'.join(THEOREMS)})\*?\}}{_S}*(?:\[([^\]]*+)\])?(.*?)\\end\{{\1\*?\}}"
_CALLOUT = rf"(?s)\\begin\{{({'|'.join(CALLOUTS)})\*?\}}{_S}*(?:\[(?:[^\[\]]|\[[^\]]*+\])*+\])?{_S}*(?:\{{[^{{}}]*+\}})?(.*?)\\end\{{\1\*?\}}"
_FLOAT = rf"(?s)\\begin\{{((?:figure|table|sidewaystable|wraptable|wrapfigure)\*?|longtable|listing)\}}{_S}*(?:\[[^\]]*+\])?(.*?)\\end\{{\1\}}"
_WRAPPER = re.compile(r"\\(?:caption|centering|label)(?:\[[^\]]*+\])?(?:\{(?:[^{}]|\{[^{}]*+\})*+\})?")
_DROPPED = re.compile(r"\\includegraphics\b|\\begin\{(?:tabular\*?|tabularx|longtable)\}")
_LISTS = r"\\begin\{(?:itemize|enumerate|description)\}" + _S + r"*(?:\[[^\]]*+\])?|\\end\{(?:itemize|enumerate|description)\}"


def _structure(text: str) -> str:
    return K.unwrap_boxes(K.links(K.paragraph_heads(K.drop_headings(text))))


def tidy(text: str) -> str:
    """Blanks collapsed, edges of lines trimmed, at most one empty line in a row."""
    return strip(_LINES(_BLANKS(text.replace("\t", " ")).replace(" \n", "\n").replace("\n ", "\n")))


_BLANKS, _LINES = _turns(("  ", _sub(r"  +", " "))), _turns(("\n\n\n", _sub(r"\n\n\n+", "\n\n")))

#: (name, needle, rule) in order; the order is part of the meaning.
RULES: list[tuple[str, str, Rule]] = [
    ("code-listings", "\\begin{", _sub(r"(?s)\\begin\{(lstlisting|minted|verbatim)\*?\}.*?\\end\{\1\*?\}")),
    ("theorem-envs", "\\begin{", _quoted(_THEOREM, 3, _theorem_head)),
    ("callout-envs", "\\begin{", _quoted(_CALLOUT, 2)),
    ("frame-box", "\\fcolorbox{", _quoted(r"\\fcolorbox\{[^}]*+\}\{[^}]*+\}\{((?:[^{}]|\{[^{}]*+\})*+)\}", 1)),
    ("false-blocks", "\\if0", _sub(r"(?s)\\if0\b.*?\\fi\b")),
    ("equations", "\\begin{", _sub(r"(?s)\\begin\{((?:equation|align|gather|multline|eqnarray)\*?)\}.*?\\end\{\1\}")),
    ("algorithms", "\\begin{", _sub(r"(?s)\\begin\{((?:algorithm|algorithmic)\*?|algorithm2e)\}.*?\\end\{\1\}")),
    ("floats", "\\begin{", _sub(_FLOAT, lambda m: "" if _DROPPED.search(m[0]) else _WRAPPER.sub("", m[2]))),
    ("labels", "\\label{", _sub(r"\\label\{[^{}]*+\}")),
    ("headings-paragraphs-links-boxes", "{", _structure),
    ("lists", "\\", _turns(("{", _sub(_LISTS, "\n")), ("\\item", _sub(rf"\\item\b{_S}*+(?:\[[^\]]*+\])?{_S}*+", "\n- ")))),
    ("linebreaks", "\\\\", _sub(r"\\\\\*?(?:\[[^\]]*+\])?", "\n")),
    ("markup", "", _turns(("{", K.markup), ("****", _sub(r"\*{4,}", "**")))),
    ("noise", "\\", _turns(("\\", _sub(_NOISE, " ")), *[("{", _sub(rf"\\(?:{'|'.join(SYMBOLS)})\{{([^{{}}]*+)\}}", r"\1"))] * 3)),
    ("section-sign", "\\S", _sub(rf"\\S{_S}*+(?=\[#)", "§ ")),
    ("escapes", "", _turns(
        *[(f"\\{x}", lambda text, x=x: text.replace(f"\\{x}", x)) for x in "%&$_#"], ("\\textquotesingle", _sub(r"\\textquotesingle\b", "'")), ("\\textquotedbl", _sub(r"\\textquotedbl(?:left|right)\b", '"')),
        ("dots", _sub(r"\\l?dots\b", "…")), ("\\textbackslash", _sub(r"\\textbackslash\b", r"\\\\")),
        *[(x, lambda text, x=x, y=y: text.replace(x, y)) for x, y in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))])),
    ("tilde", "~", lambda text: text.replace("~", " ")),
    ("empty-commands", "{}", _sub(r"\\[A-Za-z]+\*?\{\}", " ")),
    ("font-sizes", "\\", _sub(rf"\\(?:{'|'.join(SIZES)})\b", " ")),
    ("groups", "{", _turns(*[("{", _sub(r"\{([^{}\\]++)\}", r"\1")), ("{", _sub(rf"\{{{_S}*+\}}"))] * 3)),
    ("whitespace", "", tidy),
]
_MATH, _PLACE = re.compile(MATH), re.compile(f"{_MARK}([0-9]+){_MARK}")


def apply_rules(text: str, names: Collection[str] | None = None) -> str:
    """All rules, or some by name, in the order of the list, on text without math."""
    for name, needle, rule in RULES:
        if needle in text and (names is None or name in names):
            text = rule(text)
    return text


def denoise(text: str) -> str:
    """A text cleaned by all rules, math untouched."""
    text, math = text.replace(_MARK, ""), []
    if "$" not in text and "\\[" not in text and "\\(" not in text:
        return apply_rules(text)

    def out(m: re.Match) -> str:
        math.append(m[0])
        return f"{_MARK}{len(math) - 1}{_MARK}"

    return _PLACE.sub(lambda m: math[int(m[1])], apply_rules(_MATH.sub(out, text)))


def cleaned_headings(text: str) -> list[tuple]:
    """``marked_headings`` with the cleaned slice alone."""
    return [(*row[:-4], denoise(row[-1])) for row in marked_headings(text)]

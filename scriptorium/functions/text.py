"""String functions as Column expressions.

Repeated groups over alternatives are possessive throughout: Java's matcher recurses on
the plain form and would exhaust the stack on long documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"(?U)^\s++|\s++$"


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, _EDGES, "")


def fold(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Regex replacements in turn."""
    return reduce(lambda a, r: F.regexp_replace(a, r[0], r[1]), rules, c)


def slug(c: Column, limit: int | None = 60, empty: str = "untitled") -> Column:
    """Lower-case ASCII words joined by dashes, cut at ``limit``."""
    out = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    out = F.substring(out, 1, limit) if limit else out
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit(empty)).otherwise(out)


def yaml_text(c: Column) -> Column:
    """A YAML scalar: quoted where plain text would be ambiguous."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(c.isNull(), F.lit("null")).when(c.rlike(r"""[:#\n"'\[\]{}|>`]|^\s|\s$""") | (c == ""), quoted).otherwise(c)


def shorten(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


_BRACED = r"\{((?:[^{}\\]|\\.|\{(?:[^{}\\]|\\.|\{[^{}]*+\})*+\})*+)\}"
# Fixed values of the inline cleaner.
WRAPPERS = "tcolorbox|center|minipage|adjustwidth|quote|quotation|mdframed|framed"
INLINE_MARKUP = "textit|textbf|texttt|emph|textsc|textsf|textrm|text|underline|uline|sout|mbox|hbox|mathbf|mathit|mathrm"
FONTS = "Large|large|huge|Huge|small|footnotesize|scriptsize|tiny|normalsize|bf|bfseries|it|itshape|sf|sffamily|tt|ttfamily|rm|rmfamily|em|sl|slshape|sc|scshape"


def _listed(command: str, sign: str) -> list[tuple[str, str]]:
    """A command with comma-separated names as a marker; private characters hold its place meanwhile."""
    return [(command + r"\{([^{}]++)\}", "\ue001$1\ue002"), (r"\s*+,\s*+(?=[^\ue001\ue002]*+\ue002)", f"; {sign}"), (r"\ue001\s*+", f"[{sign}"), (r"\s*+\ue002", "]")]


_INLINE = [
    (rf"\\begin\{{(?:{WRAPPERS})\}}\s*+(?:\[(?:[^\[\]]|\[[^\]]*+\])*+\])?\s*+(?:\{{[^{{}}]*+\}})?", " "),
    (rf"\\end\{{(?:{WRAPPERS})\}}", " "),
    (r"\\label\{[^{}]*+\}", ""),
    (r"\\\\|~", " "),
    *_listed(r"\\[A-Za-z]*[cC]ite[A-Za-z]*+\*?(?:\[[^\]]*+\]){0,2}", "@"),
    *_listed(r"\\(?:eq|auto|c|C|name|page|v|pretty)?ref", "#"),
    (r"\\href\{[^{}]*+\}" + _BRACED, "$1"),
    (r"\\url\{([^{}]*+)\}", "$1"),
    *[(r"\\textcolor\{[^{}]*+\}" + _BRACED, "$1")] * 3,
    *[(rf"\\(?:{INLINE_MARKUP})" + _BRACED, "$1")] * 3,
    (r"\\texorpdfstring" + _BRACED + r"\{([^{}]*+)\}", "$2"),
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    (r"\\([%&$_#])", "$1"),
    (r"\\textquotesingle\b", "'"), (r"\\textquotedbl(?:left|right)\b", '"'), (r"\\l?dots\b", "…"),
    (r"\\[A-Za-z]++\*?\{\}", ""),
    (rf"\\(?:{FONTS})\b", " "),
    (r"\\[A-Za-z]++\*?\s*+(?:\[[^\]]*+\])++", " "),
    *[(r"\{([^{}\\]++)\}", "$1"), (r"\{\s*+\}", "")] * 3,
    (r"\s++", " "),
]


def inline_clean(c: Column) -> Column:
    """Titles and captions: wrappers, labels, breaks, colours and markup off, markers kept.

    A text without any character of markup takes the short way.
    """
    return F.when(c.rlike(r"[\\{}~&]"), strip(fold(c, _INLINE))).otherwise(strip(F.regexp_replace(c, r"\s++", " ")))

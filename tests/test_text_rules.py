"""Cleaning, markers, front matter and pure kernels on literal inputs."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import kernels as K
from scriptorium.functions.text import inline_clean
from scriptorium.operators import clean as D
from scriptorium.operators import frontmatter as P
from scriptorium.operators import markers as M
from scriptorium.operators import sections as S
from scriptorium.sources.folder_view import extension, section_file, yaml_text


def one(spark, make, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in rows.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


#: Strike-out marks are tildes, which the later tilde rule turns into blanks.
CLEAN = [
    (r"a \textbf{b \emph{c}} d", "a **b *c*** d"), (r"\texttt{x} \sout{y} \underline{z}", "`x` y z"), (r"x $\mathbf{v}~\to$ y", r"x $\mathbf{v}~\to$ y"),
    (r"\begin{definition}[Big] One.\end{definition}", "> **Definition (Big).**\n> One."), (r"\begin{takeaway}Two" + "\n" + r"lines\end{takeaway}", "> Two\n> lines"),
    (r"\begin{itemize}\item A\item[x] B\end{itemize}", "- A\n- B"), (r"\paragraph{\textbf{P}} text", "****P****\ntext".replace("****", "**")),
    (r"\begin{figure}\includegraphics{a}\caption{c}\end{figure}after", "after"), (r"\begin{figure}\centering kept \caption{c {d}}\label{x}\end{figure}", "kept"),
    (r"\begin{table}\begin{tabular}{l}a\end{tabular}\end{table}x", "x"), (r"a\\[2mm]b\\c", "a\nb\nc"), (r"\href{u}{seen} \url{http://a} \hyperref[l]{here}", "seen http://a here"),
    (r"\parbox[t]{3cm}{body} \textcolor{red}{r} \fcolorbox{a}{b}{in}", "body r\n\n> in"), (r"50\% \& \$5 \#1 a\_b &lt; \ldots", "50% & $5 #1 a_b < …"), (r"\S [#sec:a]", "§ [#sec:a]"),
    (r"\vspace{1em}\noindent Text\newpage", "Text"), (r"{\bf x} {{y}}{}", "x y"), (r"\noindention", r"\noindention"), (r"\if0 gone \fi stays", "stays"), (r"\xyz{} a", "a"),
    (r"\begin{lstlisting}code\end{lstlisting}b", "b"), (r"\section{Gone \emph{too}} t", "t"), (r"\bm{x} and \mathcal{F}", "x and F"), ("", ""), (None, None), (r"\textbf{open", r"\textbf{open"),
]


def test_clean(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLEAN)], "i int, t string")
    got = {r["i"]: r["text"] for r in D.denoise(rows, "t").collect()}
    assert [got[i] for i in range(len(CLEAN))] == [b for _, b in CLEAN]


@pytest.mark.parametrize("text,want", [
    (r"\begin{lstlisting}$a$\end{lstlisting} $b$ c", "$b$ c"), (r"\begin{equation}\mbox{$a$}\end{equation}$b$ and \(c\)", r"$b$ and \(c\)"), (r"$a$ \label{$b$}", "$a$"),
    (r"\begin{lemma}$a$\end{lemma}\if0 $b$ \fi $c$", "> **Lemma.**\n> $a$\n$c$"),
])
def test_math_goes_with_its_block_and_stays_in_its_place(spark, text, want):
    rows = spark.createDataFrame([(text,)], "t string")
    assert D.denoise(rows, "t").collect()[0]["text"] == want


def test_documents_marked_whole_and_by_section(spark):
    tex = r"\section{A}x\footnote{ n \cite{a, b} } \ref{f}\footnote{m} $z$ \section{B}\subsection{C}\citep[p. \ref{g}]{c}\footnote{o {\bf p}}~q"
    docs = spark.createDataFrame([("p", tex), ("q", r"\section{D}no notes"), ("r", None), ("s", "no section")], "paper_id string, tex string")
    whole, by_section = M.marked_documents(docs), M.marked_sections(S.sections(docs))
    rows = whole.orderBy("paper_id", "order").collect()
    assert rows == by_section.select(whole.columns).orderBy("paper_id", "order").collect()
    assert [[(n["number"], n["text"]) for n in r["notes"]] for r in rows] == [[(1, "n [@a; @b]"), (2, "m")], [], [(3, r"o {\bf p}")], []]
    assert [r["marked"] for r in rows] == ["x[^fn:1] [#f][^fn:2] $z$ ", "", "[@c][^fn:3]~q", "no notes"]
    clean = [r["text"] for r in D.denoise(whole, "marked").orderBy("paper_id", "order").collect()]
    assert clean == [r["text"] for r in D.cleaned_sections(docs).orderBy("paper_id", "order").collect()] == ["x[^fn:1] [#f][^fn:2] $z$", "", "[@c][^fn:3] q", "no notes"]


def test_long_documents_do_not_exhaust_the_matcher(spark):
    text = "word \\textbf{b} $x_{1}$ \\\\ {a} " * 20000 + "$" + "y" * 200000
    rows = spark.createDataFrame([(text,)], "t string")
    assert len(D.denoise(rows, "t").collect()[0]["text"]) > 100000


def test_inline_clean(spark):
    got = one(spark, inline_clean, r"A~{\bf B} \textit{\emph{c}} \cite[p.]{k1, k2}\label{z}", r"\texorpdfstring{$x$}{plain} \Cref{fig:a,b} 5\%", r"\begin{quote}[o]{c}Q\end{quote}", r"\vskip[2] x {}")
    assert got == ["A B c [@k1; @k2]", "plain [#fig:a; #b] 5%", "Q", "x"]


def test_markers(spark):
    assert one(spark, M.mark_cites, r"x \citep[a][b]{k1,k2} \parencite*{k3}", "none") == ["x [@k1; @k2] [@k3]", "none"]
    assert one(spark, M.mark_refs, r"\ref{a} \Cref{b, c} \pageref{d}") == ["[#a] [#b; #c] [#d]"]
    assert one(spark, M.cites, r"\cite{a,b} \cite{a}") == [["a", "b", "a"]]


@pytest.mark.parametrize("text,want", [
    ("a % b\nc \\% d % e\n % whole\nf", "a\nc \\% d\nf"), ("\\begin{verbatim}\n% kept\n\\end{verbatim}", "\\begin{verbatim}\n% kept\n\\end{verbatim}"),
    ("\\verb|%| x % y", "\\verb|%| x"), ("a \\\\% gone", "a \\\\"), ("\\iffalse no\\fi yes", " yes"), ("", ""),
])
def test_comments(text, want):
    assert K.strip_comments(text) == want


@pytest.mark.parametrize("text,want", [
    (r"\newcommand{\x}{y}\x", "y"), (r"\newcommand{\x}[2][d]{#1-#2}\x{a} \x[b]{c}", "d-a b-c"), (r"\def\x{\y}\newcommand{\y}{z}\x", "z"), (r"\newcommand{\section}{no}\section{T}", r"\section{T}"),
    (r"\DeclareMathOperator{\argmax}{arg\,max}\argmax", r"\operatorname{arg\,max}"), (r"\newcommand{\x}[1]{<#1>}\x y", r"\x y"), (r"\newcommand{\citex}{no}\citex", r"\citex"), (r"\newcommand{\x}{y}\xx", r"\xx"),
])
def test_macros(text, want):
    assert K.expand_macros(text) == want


def test_macros_that_grow_stop():
    assert len(K.expand_macros(r"\newcommand{\x}{\x\x\x\x}\x")) < 10**6


def test_flatten():
    files = {"main.tex": "A \\input{b}\n% \\input{c}\n\\include{b.tex}\\input{none}", "b.tex": "B\\input{c}", "c.tex": "C"}
    assert K.flatten(files, "main.tex") == "A BC\n% \\input{c}\n" and K.flatten(files, "x") == ""


def test_bibliography():
    text = '@comment{x}@article{a, title = {The {Big} One}, author="Doe, Jane and {Team X}", year=2001}\n@misc{open, title={x'
    (key, kind, fields, _), = K.bib_entries(text)
    assert (key, kind, fields["year"]) == ("a", "article", "2001") and K.bib_value(fields["title"]) == "The Big One" and K.bib_authors(fields["author"]) == ["Jane Doe", "Team X"]


def test_braces():
    assert K.close_brace(r"{a\}{b}}", 0) == 7 and K.close_brace("{a", 0) == -1 and K.close_bracket("[a{]}]", 0) == 5


def test_titles_and_abstracts(spark):
    docs = spark.createDataFrame([("a", r"\title[short]{Long \textbf{name}\thanks{x {y}}}\titleformat{\section}{}{}{}"), ("b", r"\title{Untitled}"), ("c", "nothing")], "paper_id string, tex string")
    assert [r["title"] for r in P.titles(docs).orderBy("paper_id").collect()] == ["Long name", "", ""]
    assert {r["abstract_source"] for r in P.abstracts(docs).collect()} == {"none"}
    assert {tuple(r["affiliations"]) for r in P.affiliations(docs).collect()} == {("individual",)}


def test_landing_page_without_authors(spark):
    page = '<meta name="citation_title" content="T"/>[v2]'
    r = P.landing_pages(spark.createDataFrame([(page,), (page + '<meta name="citation_author" content="Roe, Ann">',), (None,)], "html string")).collect()
    assert r[0]["title"] is None and r[1]["authors"] == ["Ann Roe"] and r[1]["version"] == "v2" and r[2]["title"] is None


def test_file_names(spark):
    rows = spark.createDataFrame([("sec:2.10.3", "Éa / B!"), ("sec:1", "")], "a string, b string")
    assert [r[0] for r in rows.select(section_file(F.col("a"), F.col("b"))).collect()] == ["02.10.03-a-b.md", "01-untitled.md"]
    assert one(spark, extension, "Python", "c++", "?", None) == [".py", ".cpp", ".txt", ".txt"]
    assert one(spark, yaml_text, "plain", 'a: "b"', " x", "back\\slash", "c\\: d") == ["plain", '"a: \\"b\\""', '" x"', "back\\slash", '"c\\\\: d"']

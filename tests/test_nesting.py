"""Braces and environments of any depth, and listing floats in records."""

from scriptorium.functions.scan import leveled, unmarked
from scriptorium.operators import entities, frontmatter, quality, record, sections

DEEP = "A \\textbf{\\textcolor{red}{\\emph{\\textsf{\\underline{deep} one} two} three}} four"


def _docs(spark, tex):
    return spark.createDataFrame([("p", tex)], "paper_id string, tex string")


def test_levels_pair_braces_and_can_be_taken_away(spark):
    text = r"a{b{c}\{d}e} }f{ {g}"
    row = leveled(_docs(spark, text), "tex", "out").select("out", unmarked("out").alias("back")).first()
    assert row["back"] == text
    assert [x.split("\uE001")[0] for x in row["out"].split("\uE000")[1:]] == ["1", "2", "2", "1", "0", "-1", "-1", "0", "0"]


def test_deep_headings(spark):
    tex = f"\\section{{First}}\nx\n\\section[short]{{{DEEP}}}\ny\n\\subsection*{{With \\footnote{{see \\href{{u}}{{\\texttt{{x_{{1}}}}}}}}}}\nz\n\\section{{open\n"
    rows = sections.sections(_docs(spark, tex)).orderBy("start").collect()
    assert [r["section_id"] for r in rows] == ["sec:1", "sec:2", "sec:2.1"]
    assert rows[1]["title"].startswith("A ") and rows[1]["title"].endswith("four") and "deep" in rows[1]["title"]
    assert [r["raw"].strip()[:1] for r in rows] == ["x", "y", "z"]
    assert all(tex[r["start"] :].startswith("\\s") for r in rows)


def test_deep_captions_and_nested_tabulars(spark):
    inner = "\\begin{tabular}{c}1 \\\\ 2\\end{tabular}"
    table = f"\\begin{{tabular}}{{ll}}a & {inner} \\\\ b & c\\end{{tabular}}"
    tex = f"é\\begin{{table}}\\caption{{{DEEP}}}\\label{{tab:x}}{table}\\end{{table}}\n\\begin{{figure}}\\caption{{{DEEP}}} some text of the figure that is long enough to count\\end{{figure}}"
    t = entities.tables(_docs(spark, tex)).first()
    assert t["raw_tex"] == table and t["caption"].endswith("four") and t["label"] == "tab:x" and t["position"] == 1
    f = entities.figures(_docs(spark, tex)).first()
    assert f["body_tex"] == "some text of the figure that is long enough to count" and f["caption"].endswith("four")


def test_deep_front_matter(spark):
    deep = "University of \\textbf{\\emph{{{{Deep} Things}}}}"
    tex = f"\\title{{{DEEP}}}\n\\institution{{{deep}}}\n\\begin{{document}}\\abstract{{{DEEP} {'word ' * 20}}}"
    row = frontmatter.affiliations(frontmatter.abstracts(frontmatter.titles(_docs(spark, tex)))).first()
    assert row["title"].endswith("four") and row["abstract_source"] == "abstract_cmd" and "Deep" in row["affiliations"][0]


def test_listing_floats_in_records(spark):
    tex = (
        "\\section{S}\n\\begin{listing}\\caption{Of the float}\\label{lst:f}\n\\begin{minted}{python}\na\n\\end{minted}\n\\begin{minted}{c}\nb\n\\end{minted}\\end{listing}\n"
        "\\begin{listing}\\begin{lstlisting}[caption=Own,label=lst:own]\nc\n\\end{lstlisting}\\caption{No}\\label{lst:no}\\end{listing}"
    )
    found = record.digest(_docs(spark, tex)).select("listings").first()[0]
    assert [(x["latex_label"], x["caption"]) for x in found] == [("lst:f", "Of the float"), ("lst:1", ""), ("lst:own", "Own")]
    assert quality.EXPECTED_SCHEMA == record.SCHEMA_VERSION

"""LaTeX built from plain documents by a fixed rule, for tests and benchmarks.

The rule depends on the document's id and the line's number only, so expected results
can be computed from the plain tables without parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.tables import table


def escaped(line: Column) -> Column:
    """Special characters escaped; braces, tildes, carets and backslashes become spaces."""
    return F.regexp_replace(F.regexp_replace(line, r"[{}~^\\]", " "), r"[%$&#_]", r"\\$0")


def _line(doc: Column, line: Column, i: Column) -> Column:
    """What stands for a line, which is escaped."""

    def tag(kind: str) -> Column:
        return F.concat(F.lit(kind + ":d"), doc, F.lit("i"), i.cast("string"))

    def name(head: str) -> Column:
        return F.concat(F.lit(head), doc, F.lit("x"), i.cast("string"))

    def some(when: Column, *parts) -> Column:
        return F.when(when, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))).otherwise(F.lit(""))

    n = doc.cast("long")
    heading = (
        F.when(i % 5 == 0, F.concat(F.lit("\\section{"), name("S"), F.lit("}\n")))
        .when(i % 5 == 3, F.concat(F.lit("\\subsection{"), name("B"), F.lit("}\n")))
        .when(i % 11 == 7, F.concat(F.lit("\\subsubsection{"), name("C"), F.lit("}\n")))
        .otherwise(F.lit(""))
    )
    key = F.concat(F.lit("k"), ((n * 7 + i) % 97).cast("string"))
    second = F.when(i % 3 == 0, F.concat(F.lit(", k"), (i % 13).cast("string"))).otherwise(F.lit(""))
    i_text = i.cast("string")
    return F.concat(
        some(i == 20, "\\appendix\n"), heading, line,
        F.lit(" \\cite{"), key, second, F.lit("}"),
        some(i % 8 == 5, "\\footnote{Note ", doc, " ", i_text, "}"),
        some(i % 4 == 2, " see \\ref{fig:d", doc, "i", (i - 1).cast("string"), "}"),
        some(i % 4 == 1, "\n\\begin{figure}\n\\includegraphics[width=1cm]{img/d", doc, "i", i_text, ".png}\n\\caption{Cap \\textbf{", i_text, "} of ", doc, "}\n\\label{", tag("fig"), "}\n\\end{figure}"),
        some(i % 6 == 2, "\n\\begin{table}\n\\caption{Tab ", i_text, "}\n\\label{", tag("tab"), "}\n\\begin{tabular}{ll}\na & ", i_text, " \\cite{k", (i % 5).cast("string"), "} \\\\\n\\end{tabular}\n\\end{table}"),
        some(i % 7 == 3, "\n\\begin{equation}\\label{", tag("eq"), "}x_{", i_text, "}=1\\end{equation}"),
        some(i % 9 == 4, "\n\\begin{lstlisting}[language=Python]\nprint(", i_text, ")\n\\end{lstlisting}"),
        some(i % 10 == 6, "\n\\begin{algorithm}\n\\caption{Alg ", i_text, "}\nstep ", i_text, "\n\\end{algorithm}"),
    )


def latex(spark: SparkSession, folder: str) -> DataFrame:
    """(paper_id string, tex string): one paper for each document with a text."""
    return paper_text(table(spark, folder, "documents"))


def paper_text(docs: DataFrame) -> DataFrame:
    """The same for any (doc_id, text)."""
    # Dealt by paper once: windows and joins on paper_id then need no exchange of their own.
    docs = docs.where("text is not null").select(F.col("doc_id").cast("string").alias("paper_id"), "text").repartition("paper_id")
    doc = F.col("paper_id")
    return docs.select("paper_id", F.array_join(F.transform(F.split(escaped(F.col("text")), "\n"), lambda x, i: _line(doc, x, i)), "\n").alias("tex"))


def bibliography(spark: SparkSession, keys: int = 80) -> DataFrame:
    """(file, size, content): two .bib files; the larger one wins where both have a key."""
    k = F.col("id").cast("string")
    entry = F.concat(F.lit("@article{k"), k, F.lit(",\n title = {Title {"), k, F.lit("}},\n author = \"Doe, J"), k, F.lit(" and Ann Roe\",\n year = "), (F.col("id") % 30 + 1990).cast("string"), F.lit(",\n journal = {Venue "), (F.col("id") % 7).cast("string"), F.lit("}\n}\n"))
    short = F.concat(F.lit("@misc{k"), k, F.lit(", title={Short "), k, F.lit("}}\n"))
    whole = spark.range(keys).select(entry.alias("e"), "id").groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "e"))), lambda x: x["e"]), "").alias("content")).select(F.lit("main.bib").alias("file"), "content")
    other = spark.range(0, keys, 3).select(short.alias("e"), "id").groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "e"))), lambda x: x["e"]), "").alias("content")).select(F.lit("extra.bib").alias("file"), "content")
    return whole.unionByName(other).select("file", F.length("content").cast("long").alias("size"), "content")


def bibliographies(spark: SparkSession, folder: str) -> DataFrame:
    """(paper_id, file, size, content): two .bib files for each document with a text, which is an entry's abstract; both have its key."""
    docs = table(spark, folder, "documents").where("text is not null and doc_id is not null")
    n, d = F.col("doc_id"), F.col("doc_id").cast("string")
    main = F.concat(
        F.lit("@article{d"), d, F.lit(",\n title = {Title {"), d, F.lit("}},\n abstract = {"), escaped(F.col("text")), F.lit("},\n author = \"Doe, J"), d, F.lit(" and Ann Roe\",\n year = "),
        (n % 30 + 1990).cast("string"), F.lit(",\n journal = {Venue "), (n % 7).cast("string"), F.lit("}\n}\n"),
    )
    extra = F.concat(F.lit("@misc{d"), d, F.lit(", title={Short "), d, F.lit("}}\n@misc{x"), d, F.lit(", title={Other "), d, F.lit("}}\n"))
    files = F.array(F.struct(F.lit("main.bib").alias("file"), main.alias("content")), F.struct(F.lit("extra.bib").alias("file"), extra.alias("content")))
    return docs.select(d.alias("paper_id"), F.explode(files).alias("f")).select("paper_id", "f.file", F.length("f.content").cast("long").alias("size"), "f.content")

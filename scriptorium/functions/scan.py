"""Occurrences of a pattern as rows with places, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = 256


def running(lengths: Column) -> Column:
    """Sums of the elements up to and with each element, in blocks, so that long arrays stay cheap."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    zero = F.array(F.lit(0))

    def grow(a: Column, x: Column) -> Column:
        return F.concat(a, F.array(F.element_at(a, -1) + x))

    starts = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), zero, grow)
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, grow))
    return F.flatten(F.zip_with(sums, F.slice(starts, 1, F.size(starts) - 1), lambda b, s: F.transform(F.slice(b, 2, F.size(b) - 1), lambda x: x + s)))


#: A level's mark, as it stands behind each brace of a leveled text: private-use characters around a number.
LEVEL = r"\uE000-?\d++\uE001"
#: The same behind each begin and end of the environments that were asked for.
ENV_LEVEL = r"\uE002-?\d++\uE001"


def braced(before: int = 0) -> str:
    """Pattern of a balanced argument of a leveled text, at any depth; it has two groups, of which the second is the content.

    before: groups of the whole pattern that come before these.
    """
    return rf"\{{({LEVEL})(.*?)\}}\{before + 1}"


def unmarked(c: Column) -> Column:
    """A part of a leveled text as it was."""
    return F.regexp_replace(c, r"[\uE000\uE002]-?\d++\uE001", "")


def leveled(df: DataFrame, text: str, out: str, names: str | None = None) -> DataFrame:
    """``df`` with ``out``: the text with its level behind each brace, so that patterns can match braces at any depth.

    An opening brace and the one that closes it have the same level, and no brace between
    them has.  Escaped braces don't count.  names: a pattern of environments; their begins and
    ends then have levels of their own, counted for all of them together.
    """
    token = (rf"\\(?:begin|end)\{{(?:{names})\}}|" if names else "") + r"\\.|[{}]"
    token = "(?s)" + token
    some = F.size("_lt") > 0
    ends = lambda t: (F.length(t) > 2) & t.startswith("\\end")
    begins = lambda t: (F.length(t) > 2) & ~t.startswith("\\end")
    found = df.withColumn("_lt", F.regexp_extract_all(text, F.lit(token), F.lit(0))).withColumn("_lg", F.split(text, token, -1))
    found = found.withColumn("_lb", F.when(some, running(F.transform("_lt", lambda t: F.when(t == "{", 1).when(t == "}", -1).otherwise(0)))))
    if names:
        found = found.withColumn("_le", F.when(some, running(F.transform("_lt", lambda t: F.when(begins(t), 1).when(ends(t), -1).otherwise(0)))))

    def mark(t: Column, i: Column) -> Column:
        level = lambda c, plus: F.concat(F.get(F.col(c), i) + plus, F.lit("\uE001"))
        done = F.when(t == "{", F.concat(F.lit("{\uE000"), level("_lb", 0))).when(t == "}", F.concat(F.lit("}\uE000"), level("_lb", 1)))
        if names:
            done = done.when(begins(t), F.concat(t, F.lit("\uE002"), level("_le", 0))).when(ends(t), F.concat(t, F.lit("\uE002"), level("_le", 1)))
        return done.otherwise(t)

    found = found.withColumn("_lm", F.transform("_lt", mark))
    whole = F.concat(F.array_join(F.flatten(F.zip_with(F.slice("_lg", 1, F.size("_lm")), "_lm", lambda g, m: F.array(g, m))), ""), F.element_at("_lg", -1))
    return found.withColumn(out, F.when(some, whole).otherwise(F.col(text))).drop("_lt", "_lg", "_lb", "_le", "_lm")


def located(df: DataFrame, text: str, pattern: str, out: str, length=F.length) -> DataFrame:
    """``df`` with ``out``: struct(start, end, match) of each match in order, in code points from 0; no shuffle.

    length: of a part of the text; for a leveled text ``plain_length`` gives places in the text as it was.
    """
    some = F.size("_m") > 0
    found = df.withColumn("_m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    found = found.withColumn("_g", F.when(some, F.transform(F.split(text, pattern, -1), length)))
    found = found.withColumn("_s", F.when(some, F.zip_with(F.slice("_g", 1, F.size("_m")), "_m", lambda g, m: g + length(m))))
    found = found.withColumn("_e", F.when(some, running(F.col("_s"))))
    spans = F.zip_with("_e", "_m", lambda e, m: F.struct((e - length(m)).alias("start"), e.alias("end"), m.alias("match")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")
    return found.withColumn(out, F.when(some, spans).otherwise(none)).drop("_m", "_g", "_s", "_e")


def plain_length(c: Column) -> Column:
    return F.length(unmarked(c))


def occurrences(docs: DataFrame, pattern: str, groups: dict[str, int] | None = None, key: str = "paper_id", text: str = "tex", length=F.length) -> DataFrame:
    """(key, ordinal, start, end, match, groups...) of each match, in code points from 0.

    Groups are taken from the match, not from the text, so a pattern must not look beyond
    what it matches.
    """
    # Outer, as for an inner explode the optimizer adds a filter on the array's size, which
    # it would push below and so compute all of ``located`` twice.
    found = located(docs.select(key, text), text, pattern, "_spans", length).select(key, F.posexplode_outer("_spans").alias("ordinal", "x")).where("ordinal is not null")
    taken = [F.regexp_extract("x.match", pattern, n).alias(name) for name, n in (groups or {}).items()]
    return found.select(key, "ordinal", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.match").alias("match"), *taken)


def braces(docs: DataFrame, key: str = "paper_id", text: str = "tex") -> DataFrame:
    """(key, open, close) of each brace; close is null where nothing matches.  Escaped braces don't count.

    The partner of an opening brace is the next bracket of its level.
    """
    found = occurrences(docs, r"(?s)\\.|[{}]", key=key, text=text).where(F.col("match").isin("{", "}"))
    order = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("match") == "{"
    depth = F.sum(F.when(opens, 1).otherwise(-1)).over(order)
    leveled = found.withColumn("depth", depth).withColumn("level", F.when(opens, F.col("depth")).otherwise(F.col("depth") + 1))
    after = Window.partitionBy(key, "level").orderBy("start")
    paired = leveled.select(key, "match", F.col("start").alias("open"), F.when(F.lead("match").over(after) == "}", F.lead("start").over(after)).alias("close"))
    return paired.where(F.col("match") == "{").drop("match")

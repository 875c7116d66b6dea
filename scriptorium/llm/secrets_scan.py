"""Operator 9: secrets, told from examples by corpus-wide ownership, in DataFrame operations only.

Patterns find candidates with their places.  The value of each candidate is hashed, and
the hashes are aggregated over the corpus by distinct repositories and owners: a value
that several owners or many repositories have is a copied example, one that few of one
owner's have looks live.  Where rows name no repository, a distinct text counts as one, so
copies of a text are no evidence of an example.  Tokens that no keyword announces are candidates as well; those that look random and
belong to few owners are added to the findings, never taken from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.scan import running
from scriptorium.plans.scratch import Scratch

#: Kind -> (pattern, group that holds the value, least length of that group), in the order of the kinds.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}+", 0, 24),
    # Added by ownership: a long token that mixes cases and digits.
    "token": (r"[A-Za-z0-9_-]{20,}+", 0, 20),
}
BASE = ("assign", "access", "hex")
#: From so many owners, or from so many repositories on, a value is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 20


def may_hold(text: Column) -> Column:
    """Whether a text can have any candidate: each is an assignment or a run of 20 token characters.

    Access keys and hex strings are such runs, so this never misses one.
    """
    assigned = (text.contains(":") | text.contains("=")) & text.rlike(KINDS["assign"][0])
    return assigned | text.rlike(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20}")


def with_matches(df: DataFrame, text: str, kind: str) -> DataFrame:
    """``df`` with an array column named by the kind: struct(start, end, value) of each match.

    Places are code points, the end exclusive.  Matches are leftmost and don't overlap;
    those with too short a value are dropped after matching, as they still use up text.
    """
    pattern, group, least = KINDS[kind]
    found, rest, value = f"_{kind}_found", f"_{kind}_rest", f"_{kind}_value"
    some = F.size(found) > 0
    out = df.withColumn(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    out = out.withColumn(rest, F.when(some, F.split(text, pattern, -1)))
    out = out.withColumn(value, F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.col(found)))
    # Lengths of what is between matches and of the matches, in turn.
    both = F.flatten(F.zip_with(F.slice(F.col(rest), 1, F.size(found)), F.col(found), lambda g, m: F.array(F.length(g), F.length(m))))
    out = out.withColumn(f"_{kind}_both", F.when(some, both))
    out = out.withColumn(f"_{kind}_sums", F.when(some, running(F.col(f"_{kind}_both"))))
    spans = F.transform(F.col(found), lambda m, i: F.struct(
        F.element_at(f"_{kind}_sums", 2 * i + 1).alias("start"), F.element_at(f"_{kind}_sums", 2 * i + 2).alias("end"), F.element_at(value, i + 1).alias("value")))
    kept = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    nothing = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    out = out.withColumn(kind, F.coalesce(F.when(some, kept), nothing))
    return out.drop(found, rest, value, f"_{kind}_both", f"_{kind}_sums")


def _tagged(kind: str, with_value: bool = False) -> Column:
    """A kind's spans as structs that sort by start and then by kind."""
    place = list(KINDS).index(kind)

    def one(s: Column) -> Column:
        fields = [s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind")]
        return F.struct(*fields, F.sha2(s["value"], 256).alias("hash")) if with_value else F.struct(*fields)

    return F.transform(F.col(kind), one)


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str | None, repo_col: str | None) -> DataFrame:
    """(id, text_key, owner, repo, base, tokens) of rows that may have a candidate: spans with value hashes; no texts.

    Rows without one are told by two searches; the spans of the others are few.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    owner = F.col(owner_col).cast("string") if owner_col else F.lit(None).cast("string")
    repo = F.col(repo_col).cast("string") if repo_col else F.lit(None).cast("string")
    repo = F.coalesce(repo, F.concat(F.lit("text:"), F.sha2(text, 256)))
    out = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), owner.alias("owner"), repo.alias("repo"), text.alias("text")).where(may_hold(text))
    for kind in KINDS:
        out = with_matches(out, "text", kind)
    # A token mixes lower case, upper case and digits, and no base span covers part of it.
    random_looking = F.filter("token", lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]"))
    out = out.withColumn("base", F.concat(*(_tagged(k, True) for k in BASE))).withColumn("token", random_looking)
    free = F.filter("token", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.withColumn("token", free).withColumn("tokens", _tagged("token", True)).select("id", "text_key", "owner", "repo", "base", "tokens")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repos, owners): distinct repositories and owners of each candidate value.

    Counted by way of (hash, owner) and (hash, repo), so a value that a third of all rows
    hold is summed in parts.  Rows without an owner count as owned by their repository, rows
    without a repository as one of their own text.
    """
    each = found.select(F.coalesce("owner", F.concat(F.lit("repo:"), "repo")).alias("owner"), "repo", F.explode(F.concat("base", "tokens")).alias("s")).select("owner", "repo", F.col("s.hash").alias("hash"))
    owners = each.groupBy("hash", "owner").agg(F.lit(1).alias("x")).groupBy("hash").agg(F.count("*").alias("owners"))
    repos = each.groupBy("hash", "repo").agg(F.lit(1).alias("x")).groupBy("hash").agg(F.count("*").alias("repos"))
    return owners.join(repos, "hash")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = None, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """(id, text_key, base, added, live): spans of each row and how many of them look live.

    A value looks live that has fewer than ``EXAMPLE_OWNERS`` owners and fewer than
    ``example_repos`` repositories.  base holds every base finding; added holds tokens that
    look live.  Each span is struct(start, place, end, kind, hash, owners, repos, live).
    One row for each row of ``docs``; null and empty texts have no spans.
    """
    found = candidates(docs, id_col, text_col, owner_col, repo_col)
    key = ["id", "text_key"]
    # Texts are searched in this one pass.  A filter on the spans would be pushed below them and search again.
    some = Scratch(docs.sparkSession, "secrets").keep(found, "candidates")
    spans = some.select(*key, F.explode(F.concat("base", "tokens")).alias("s")).select(*key, "s.*").distinct()
    few = (F.col("owners") < EXAMPLE_OWNERS) & (F.col("repos") < example_repos)
    known = spans.join(ownership(some), "hash").withColumn("live", few)
    kept = known.where((F.col("kind") != "token") | F.col("live"))
    grouped = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "place", "end", "kind", "hash", "owners", "repos", "live"))).alias("all"))
    kind = grouped.schema["all"].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"))
    same = (rows["id"].eqNullSafe(grouped["id"])) & (rows["text_key"] == grouped["text_key"])
    out = rows.join(grouped, same, "left").select(rows["id"], rows["text_key"], F.coalesce("all", F.expr(f"cast(array() as {kind})")).alias("all"))
    return out.select(
        "id", "text_key",
        F.filter("all", lambda s: s["kind"] != "token").alias("base"), F.filter("all", lambda s: s["kind"] == "token").alias("added"),
        F.size(F.filter("all", lambda s: s["live"])).cast("long").alias("live"),
    )


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans, all spans, and how many look live."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return scanned.select(F.col("id").alias(id_col), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"), "live")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", mark: str = "[secret]", repo_col: str | None = None, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """``docs`` with the spans of live-looking findings replaced by ``mark``; all rows and columns stay.

    Values of copied examples stay, as nothing is lost by showing them.  Overlapping spans
    are cut as one.  No column of ``docs`` meets one of the work's, whatever its name.
    """
    found = scan(docs, id_col, text_col, owner_col, repo_col, example_repos)
    live = found.select("id", "text_key", F.filter(F.concat("base", "added"), lambda s: s["live"]).alias("cuts")).where(F.size("cuts") > 0).dropDuplicates(["id", "text_key"])
    rows = docs.select(
        F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_key"), F.col(text_col).alias("text"),
        F.struct(*(F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col)).alias("others"),
    )
    out = rows.join(live, (F.col("own_key") == F.col("text_key")) & F.col("own_id").eqNullSafe(F.col("id")), "left")
    # Text between the cuts, in order: (text so far, place reached).
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    text = F.col("text")

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        piece = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        return F.struct(F.when(fresh, F.concat(a["parts"], F.array(piece, F.lit(mark)))).otherwise(a["parts"]).alias("parts"), F.greatest(a["at"], s["end"]).alias("at"))

    folded = F.aggregate(F.array_sort("cuts"), start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    new = F.when(F.col("cuts").isNotNull(), folded).otherwise(text)
    return out.select(*(new.alias(c) if c == text_col else F.col(f"others.c{i}").alias(c) for i, c in enumerate(docs.columns)))

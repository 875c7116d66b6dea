"""Kernels as Arrow-batched column functions."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from scriptorium.functions import kernels as K
from scriptorium.functions import rules as R

# Types are objects, as a DDL string could be parsed by a running session only.
_S = T.StringType()
_ENTRY = T.ArrayType(
    T.StructType()
    .add("key", _S).add("type", _S).add("fields", T.MapType(_S, _S)).add("raw", _S).add("title", _S).add("authors", T.ArrayType(_S))
)
_HEADING = pa.struct([
    ("start", pa.int32()), ("end_heading", pa.int32()), ("level", pa.int32()), ("title", pa.string()), ("ordinal", pa.int32()), ("section_id", pa.string()), ("parent_id", pa.string()),
    ("stop", pa.int32()), ("raw", pa.string()),
])
_NAMES = pa.list_(pa.string())
_MARKED = pa.struct([*list(_HEADING)[:-1], ("cites", _NAMES), ("refs", _NAMES), ("notes", pa.list_(pa.struct([("number", pa.int32()), ("text", pa.string())]))), ("marked", pa.string())])
_CLEANED = pa.struct([*list(_HEADING)[:-1], ("text", pa.string())])
_BLOCK = pa.struct([
    ("kind", pa.string()), ("ordinal", pa.int32()), ("position", pa.int32()), ("stop", pa.int32()), ("env", pa.string()), ("body", pa.string()), ("caption", pa.string()), ("rest", pa.string()),
    ("tabular", pa.string()), ("float_label", pa.string()), ("float_caption", pa.string()),
])
_ENTRIES = pa.list_(pa.struct([
    ("key", pa.string()), ("type", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("raw", pa.string()), ("title", pa.string()), ("authors", pa.list_(pa.string())),
]))
_NOTES = pa.struct([("bodies", _NAMES), ("rest", _NAMES)])
#: Texts that are Python objects at a time, in UTF-8 bytes; what is built from them goes to Arrow before the next ones.
STEP = 4 << 20
_SEGMENT = T.ArrayType(T.StructType().add("text", _S).add("region", _S).add("role", _S).add("confidence", _S))


def _text(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A function of text applied by batch; null stays null."""

    @F.pandas_udf(_S)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


strip_comments = _text(K.strip_comments)
expand_macros = _text(K.expand_macros)
unwrap_boxes = _text(K.unwrap_boxes)
plain_text = _text(K.braced_text)


def _ddl(item: pa.StructType) -> T.ArrayType:
    return T.ArrayType(from_arrow_type(item))


def steps(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of a batch of about ``STEP`` bytes, one row at least."""
    at, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if held and held + n > STEP:
            yield texts.slice(at, i - at)
            at, held = i, 0
        held += n
    yield texts.slice(at)


def _listed(f: Callable[[str], list[tuple]], item: pa.StructType, texts: pa.Array) -> pa.Array:
    """A function of a text that gives rows, by slices of a batch; null stays null."""
    def part(some: pa.Array) -> pa.Array:
        offsets: list[int | None] = []
        rows: list[tuple] = []
        for x in some:
            text = x.as_py()
            offsets.append(len(rows) if text is not None else None)
            if text is not None:
                rows += f(text)
        columns = zip(*rows) if rows else ((),) * item.num_fields
        inner = pa.StructArray.from_arrays([pa.array(c, field.type) for c, field in zip(columns, item)], fields=list(item))
        return pa.ListArray.from_arrays(pa.array([*offsets, len(rows)], pa.int32()), inner)

    return pa.concat_arrays([part(some) for some in steps(texts)])


@F.arrow_udf(_ddl(_HEADING))
def headings(tex: pa.Array) -> pa.Array:
    return _listed(K.headings, _HEADING, tex)


def _each(f: Callable[[str], object], kind: pa.DataType, texts: pa.Array) -> pa.Array:
    """A function of a text, by slices of a batch; null stays null."""
    return pa.concat_arrays([pa.array([f(t) if (t := x.as_py()) is not None else None for x in some], kind) for some in steps(texts)])


@F.arrow_udf(_S)
def denoised(texts: pa.Array) -> pa.Array:
    return _each(R.denoise, pa.string(), texts)


@F.arrow_udf(_S)
def mark_cites(texts: pa.Array) -> pa.Array:
    return _each(R.mark_cites, pa.string(), texts)


@F.arrow_udf(_S)
def mark_refs(texts: pa.Array) -> pa.Array:
    return _each(R.mark_refs, pa.string(), texts)


@F.arrow_udf(from_arrow_type(_NOTES))
def noted(texts: pa.Array) -> pa.Array:
    """Footnotes of a text and what stands around them, with markers."""
    return _each(lambda t: dict(zip(_NOTES.names, R.markers(t)[2:])), _NOTES, texts)


def by_rules(c: Column, names: list[str]) -> Column:
    @F.arrow_udf(_S)
    def run(texts: pa.Array) -> pa.Array:
        return _each(lambda t: R.apply_rules(t, names), pa.string(), texts)

    return run(c)


@F.arrow_udf(_ddl(_MARKED))
def marked_headings(tex: pa.Array) -> pa.Array:
    return _listed(R.marked_headings, _MARKED, tex)


@F.arrow_udf(_ddl(_CLEANED))
def cleaned_headings(tex: pa.Array) -> pa.Array:
    return _listed(R.cleaned_headings, _CLEANED, tex)


def environments(tex: Column | str, kinds: dict[str, str]) -> Column:
    """Environments of some kinds, given by the names they have, as ``kernels.environments`` finds them."""
    tokens, names = K.environment_tokens("|".join(kinds.values())), {k: re.compile(v) for k, v in kinds.items()}

    @F.arrow_udf(_ddl(_BLOCK))
    def run(texts: pa.Array) -> pa.Array:
        return _listed(lambda t: K.environments(t, names, tokens), _BLOCK, texts)

    return run(tex)


@F.pandas_udf(_S)
def flatten_files(paths: pd.Series, texts: pd.Series, main: pd.Series) -> pd.Series:
    return pd.Series([K.flatten(dict(zip(p, t)), m) if m else None for p, t, m in zip(paths, texts, main)], dtype=object)


def bib_entries(content: Column | str, fields: list[str]) -> Column:
    """Entries with some of their fields."""
    @F.arrow_udf(_ENTRY)
    def run(texts: pa.Array) -> pa.Array:
        def one(text: str) -> list[dict]:
            return [
                {"key": k, "type": t, "fields": [(n, f[n]) for n in fields if n in f], "raw": r, "title": K.bib_value(f.get("title", "")) or None, "authors": K.bib_authors(f.get("author", "")) if f.get("author") else []}
                for k, t, f, r in K.bib_entries(text)
            ]

        return pa.concat_arrays([pa.array([one(x.as_py() or "") for x in some], _ENTRIES) for some in steps(texts)])

    return run(content)


@F.pandas_udf(T.ArrayType(_S))
def unescape_html(values: pd.Series) -> pd.Series:
    """Character references of all kinds, for which there is no built-in."""
    return values.map(lambda a: [html.unescape(x) for x in a] if a is not None else None)


@F.pandas_udf(_SEGMENT)
def visible_segments(tex: pd.Series) -> pd.Series:
    """Texts that a figure environment shows, with region, role and confidence."""
    names = ("text", "region", "role", "confidence")
    return tex.map(lambda t: [dict(zip(names, s)) for s in K.visible_segments(t)] if t is not None else None)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def first_places(keys: pa.Array) -> pa.Array:
    """Places, from 0, of the keys that no earlier one equals; in linear time."""
    def one(row: list) -> list[int]:
        first: dict = {}
        for i, k in enumerate(row):
            first.setdefault(k, i)
        return list(first.values())

    return pa.array([one(r.as_py()) if r.is_valid else None for r in keys], pa.list_(pa.int32()))

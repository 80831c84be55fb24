"""Deeply nested records to related flat tables, through path-value-ordinal triples.

``path_triples`` reads each record once, as a stream of events, without
building it, and emits one triple per leaf: the path of keys, the ordinals of
all list elements above it, and the value as text. ``pivot_groups`` groups paths
by the list they repeat under and pivots each group, all in one pass;
``group_tables`` gives one table for each group. Rows keep the ordinals as the
link to their parents: a child row's ordinals begin with those of its parent row.

A record is parsed alone, so there is no limit on the number of records; only
one record's text must fit in memory. Parsing costs no shuffle; a pivot
shuffles leaf rows by record and ordinals, which are never skewed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLE = "path string, ordinals array<int>, value string"


OBJECT, LIST, END, KEY, STRING, NUMBER, WORD = range(7)

_TOKEN = re.compile(
    r"[ \t\n\r]*(?:([{}\[\]:,])"
    r'|"([^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*)"'
    r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null|NaN|-?Infinity))"
)


def events(text: str) -> Iterator[tuple[int, str | None]]:
    """Events of a JSON text, one token after another; of what was read only the open brackets are held.

    OBJECT, LIST and END have no value; strings come as written, with their
    escapes. Text that is no JSON raises ValueError where that shows.
    """
    match, at, closing, want = _TOKEN.match, 0, [], "value"
    while True:
        m = match(text, at)
        if m is None:
            raise ValueError(f"no JSON at {at}")
        at, kind, token = m.end(), m.lastindex, m[m.lastindex]
        mark = token if kind == 1 else None
        if want == "next":
            if mark == ",":
                want = "key" if closing[-1] == "}" else "value"
                continue
            if mark != closing.pop():
                raise ValueError(f"no JSON at {at}")
            yield END, None
        elif want == "colon":
            if mark != ":":
                raise ValueError(f"no JSON at {at}")
            want = "value"
            continue
        elif want in ("key", "first key"):
            if kind == 2:
                yield KEY, token
                want = "colon"
                continue
            if mark != "}" or want == "key":
                raise ValueError(f"no JSON at {at}")
            closing.pop()
            yield END, None
        elif mark == "{":
            yield OBJECT, None
            closing.append("}")
            want = "first key"
            continue
        elif mark == "[":
            yield LIST, None
            closing.append("]")
            want = "first"
            continue
        elif mark == "]" and want == "first":
            closing.pop()
            yield END, None
        elif mark:
            raise ValueError(f"no JSON at {at}")
        else:
            yield (STRING, NUMBER, WORD)[kind - 2], token
        # A value is complete.
        if not closing:
            if text[at:].strip(" \t\n\r"):
                raise ValueError(f"no JSON at {at}")
            return
        want = "next"


def _plain(token: str) -> str:
    return json.loads(f'"{token}"') if "\\" in token else token


class _Walk:
    """Which paths are visited, which give triples, and which are lists by nature."""

    def __init__(self, wanted: frozenset[str], repeated: frozenset[str]) -> None:
        self.wanted, self.repeated, self.known = wanted, repeated, {}
        # Paths above a wanted one are visited, those beside it are passed over.
        self.above = frozenset(p.rsplit(".", i)[0] for p in wanted for i in range(1, p.count(".") + 1)) | {""} if wanted else frozenset()

    def __call__(self, path: str) -> tuple[bool, bool, bool, bool]:
        """(visited, gives triples, list by nature, may be JSON written as text)"""
        flags = self.known.get(path)
        if flags is None:
            inside = not self.wanted or path in self.wanted or any(path.startswith(w + ".") for w in self.wanted)
            above, rep = path in self.above, path in self.repeated
            flags = (inside or above, inside, rep, above or rep)
            if len(self.known) < 100_000:
                self.known[path] = flags
        return flags

    def run(self, text: str, path: str, at: list[int], element: bool, out: list) -> None:
        """Adds the triples of a JSON text whose root stands at ``path``."""
        frames: list[list] = []  # path, ordinals, number of the next element (None in an object), visited
        below = path
        for event, token in events(text):
            if event == END:
                frames.pop()
                continue
            if event == KEY:
                if frames[-1][3]:
                    below = f"{frames[-1][0]}.{_plain(token)}" if frames[-1][0] else _plain(token)
                continue
            if frames:
                top = frames[-1]
                if not top[3]:
                    if event in (OBJECT, LIST):
                        frames.append(top)
                    continue
                if top[2] is None:
                    here, ordinals, one = below, top[1], False
                else:
                    # A list directly within a list gets a further ordinal.
                    here, ordinals, one = top[0], [*top[1], top[2]], True
                    top[2] += 1
            else:
                here, ordinals, one = path, at, element
            visited, gives, rep, may_be_text = self(here)
            if event == STRING and may_be_text and token.lstrip()[:1] in ("{", "["):
                inner: list = []
                try:
                    self.run(_plain(token), here, ordinals, one, inner)
                except ValueError:
                    pass
                else:
                    out.extend(inner)
                    continue
            if rep and not one and event != LIST and token != "null":
                ordinals = [*ordinals, 0]
            if event in (OBJECT, LIST):
                frames.append([here, ordinals, 0 if event == LIST else None, visited])
            elif gives and not (event == WORD and token == "null"):
                out.append((here, ordinals, _plain(token) if event == STRING else token))


def stream_triples(text: str | None, wanted: frozenset[str], repeated: frozenset[str]) -> list[tuple[str, list[int], str]]:
    """Triples of one record, in document order.

    ``wanted`` keeps the leaves at or below these paths (empty: all).
    ``repeated`` names paths that are lists by nature: a lone value or object
    there counts as a list of one, and an object or list written as JSON text
    above or at a wanted path counts as what it says. Nulls give no triple but
    keep their place in a list. Broken text gives none at all. A key that an
    object has twice gives triples twice.
    """
    out: list = []
    if text:
        try:
            _Walk(wanted, repeated).run(text, "", [], False, out)
        except ValueError:
            return []
    return out


def path_triples(df: DataFrame, payload: str, keys: Iterable[str], wanted: Iterable[str] = (), repeated: Iterable[str] = ()) -> DataFrame:
    """``keys``, ``path``, ``ordinals``, ``value``: one row per leaf of each record.

    Null, empty and broken payloads yield nothing; an empty table gives an
    empty result. Columns of ``df`` that aren't named are dropped, so they
    can't clash.
    """
    keys, want, rep = list(keys), frozenset(wanted), frozenset(repeated)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(*head, *triple) for head, text in zip(pdf[keys].itertuples(index=False, name=None), pdf[payload]) for triple in stream_triples(text, want, rep)]
            yield pd.DataFrame(rows, columns=[*keys, "path", "ordinals", "value"])

    # Keys travel as texts: beside a null, whole numbers would become inexact ones.
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys] + T._parse_datatype_string(TRIPLE).fields)
    rows = df.where(F.col(payload).isNotNull()).select(*(F.col(k).cast("string").alias(k) for k in keys), payload).mapInPandas(run, schema)
    return rows.select(*(F.col(k).cast(df.schema[k].dataType).alias(k) for k in keys), "path", "ordinals", "value")


def pivot_groups(triples: DataFrame, keys: Iterable[str], groups: dict[str, list[str]]) -> DataFrame:
    """All groups ``{ancestor: leaf paths below it}`` in one pass: ``keys``, ``ancestor``, ``ordinals`` and the map ``leaves`` of path to value.

    Where a leaf occurs twice in a row, the least value is kept.
    """
    ancestor = F.lit(None).cast("string")
    for name, leaves in groups.items():
        ancestor = F.when(F.col("path").isin(leaves), name).otherwise(ancestor)
    paths = sorted({p for leaves in groups.values() for p in leaves})
    found = triples.withColumn("ancestor", ancestor).where(F.col("ancestor").isNotNull()).groupBy(*keys, "ancestor", "ordinals")
    each = found.agg(*(F.min(F.when(F.col("path") == p, F.col("value"))).alias(f"leaf_{n}") for n, p in enumerate(paths)))
    leaves = F.map_filter(F.create_map(*(x for n, p in enumerate(paths) for x in (F.lit(p), F.col(f"leaf_{n}")))), lambda _, v: v.isNotNull())
    return each.select(*keys, "ancestor", "ordinals", leaves.alias("leaves"))


def group_tables(triples: DataFrame, keys: Iterable[str], groups: dict[str, list[str]]) -> dict[str, DataFrame]:
    """One flat table for each repeated ancestor: ``{ancestor: leaf paths below it}``.

    Table columns: ``keys``, ``ordinals`` and one column for each leaf, named by
    the path below the ancestor (or ``value`` for the ancestor itself). The
    tables are parts of one pivot, which they share.
    """
    keys = list(keys)
    whole = pivot_groups(triples, keys, groups)
    name = lambda p, a: p[len(a):].lstrip(".") or "value"
    return {
        a: whole.where(F.col("ancestor") == a).select(*keys, "ordinals", *(F.try_element_at("leaves", F.lit(p)).alias(name(p, a)) for p in leaves))
        for a, leaves in groups.items()
    }


#: The nested fields that are looked for in provider payloads, their lists, and their lists' paths.
FIELDS = {
    "usajobs": ("usajobs.MatchedObjectId", "SearchResult.SearchResultItems", "SearchResult.SearchResultItems.MatchedObjectId"),
    "jsearch": ("jsearch.job_highlights.Qualifications", "data.job_highlights.Qualifications", "data.job_highlights.Qualifications"),
    "ashby": ("ashby.compensation.summaryComponents.value", "jobs.compensation.summaryComponents", "jobs.compensation.summaryComponents.value"),
}
LISTS = ("SearchResult.SearchResultItems", "data", "data.job_highlights.Qualifications", "jobs", "jobs.compensation.summaryComponents")


def nested_values(pages: DataFrame) -> DataFrame:
    """``page_id, item_no, field, elem_no, value`` of the nested provider fields, distinct.

    ``elem_no`` is -1 where the field is no list.
    """
    ours = pages.where(F.col("source").isin(list(FIELDS)))
    triples = path_triples(ours, "payload", ["page_id", "source"], [leaf for _, _, leaf in FIELDS.values()], LISTS).where(
        F.col("path") == _leaf_of("source")
    )
    # Pages delivered twice give the same triples twice, and one row of the pivot.
    rows = pivot_groups(triples, ["page_id"], {ancestor: [leaf] for _, ancestor, leaf in FIELDS.values()})
    field = F.lit(None).cast("string")
    for name, ancestor, _ in FIELDS.values():
        field = F.when(F.col("ancestor") == ancestor, name).otherwise(field)
    elem = F.coalesce(F.try_element_at("ordinals", F.lit(2)), F.lit(-1))
    return rows.select(
        "page_id", F.col("ordinals")[0].alias("item_no"), field.alias("field"), elem.alias("elem_no"), F.explode(F.map_values("leaves")).alias("value")
    ).distinct()


def _leaf_of(source: str) -> Column:
    leaf = F.lit(None).cast("string")
    for name, (_, _, path) in FIELDS.items():
        leaf = F.when(F.col(source) == name, path).otherwise(leaf)
    return leaf

"""Byte-pair encoding of a corpus inside the JVM, by higher-order functions.

Texts are cut into words by the tokenizer's pattern. A word that is an entry of
the vocabulary gets its id by one lookup. All other words are gathered, made
distinct, and each distinct word is encoded once: a fold over its array of
bytes merges, step by step, the adjacent pair of least rank, looked up in a
literal rank map. Ids then go back to the words' positions by a join on the
word and a regrouping by text; decoding concatenates the pieces' bytes.

The rank map is a constant of the plan (about one megabyte), cut into buckets
by checksum so that a lookup compares a handful of keys. Nothing that grows
with the corpus is broadcast or collected. A frequent word costs one encoding;
its occurrences are join rows, which adaptive execution splits when skewed.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.text import let

#: Fixed value: how byte-level BPE with these vocabularies cuts texts into words.
WORDS = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
BUCKETS = 8192


def default_vocabulary() -> str:
    """Place of the public vocabulary byte_bpe_50k as a file of ranks."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


@lru_cache(maxsize=4)
def _rank_json(path: str) -> str:
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in _ranks(path).items():
        h = piece.decode("latin-1")
        buckets[zlib.crc32(h.encode()) % BUCKETS][h] = rank
    return json.dumps(buckets, separators=(",", ":"), ensure_ascii=False)


@lru_cache(maxsize=4)
def _piece_json(path: str) -> str:
    ranks = _ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return json.dumps(pieces, separators=(",", ":"), ensure_ascii=False)


def _with_ranks(path: str, body) -> Column:
    """``body(rank)``, where ``rank`` looks up a piece: the map occurs once in the plan, bound to a name.

    Pieces are strings with one character for each byte.
    """
    table = F.from_json(F.lit(_rank_json(path)), "array<map<string,int>>")

    def bound(t: Column) -> Column:
        return body(lambda piece: F.try_element_at(F.get(t, F.pmod(F.crc32(piece.cast("binary")), F.lit(BUCKETS)).cast("int")), piece))

    return let(table, bound)


def _bytes(text: Column) -> Column:
    """One character for each byte of the text's UTF-8 form."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def words(text: Column) -> Column:
    """The words of a text as ``array<string>``; concatenated they are the text."""
    return F.regexp_extract_all(text, F.lit(WORDS), 0)


def encode_word(word: Column, path: str) -> Column:
    """Ids of one word: ``array<int>``, by merging pairs of least rank first.

    The state is the array of pieces and the array of the ranks of adjacent
    pairs; a merge replaces two pieces by one and looks up the two new pairs,
    so a word of n bytes needs 3n lookups. Of equal pairs the left one merges
    first.
    """
    return _with_ranks(path, lambda rank: let(_bytes(word), lambda w: _merged(w, rank)))


def _merged(w: Column, rank) -> Column:
    state = "struct<p:array<string>,r:array<int>>"
    none = F.lit(2147483647)
    pair = lambda a, b: F.coalesce(rank(F.concat(a, b)), none)
    n = F.length(w)
    char = lambda i: F.substr(w, i, F.lit(1))
    pieces = F.transform(F.sequence(F.lit(1), n), char)
    ranks = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.coalesce(rank(F.substr(w, i, F.lit(2))), none)))
    start = F.struct(pieces.alias("p"), F.coalesce(ranks, F.array().cast("array<int>")).alias("r")).cast(state)

    def merge(acc: Column, _: Column) -> Column:
        p, r = acc["p"], acc["r"]
        least = F.array_min(r)

        def at(i: Column) -> Column:
            new = F.concat(F.get(p, i - 1), F.get(p, i))
            left = F.when(i > 1, F.array(pair(F.get(p, i - 2), new))).otherwise(F.array().cast("array<int>"))
            right = F.when(i < F.size(r), F.array(pair(new, F.get(p, i + 1)))).otherwise(F.array().cast("array<int>"))
            size = F.size(r)
            return F.struct(
                F.concat(F.slice(p, F.lit(1), i - 1), F.array(new), F.slice(p, i + 2, F.greatest(size - i, F.lit(0)))).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, F.greatest(size - i - 1, F.lit(0)))).alias("r"),
            ).cast(state)

        # The position is bound to a name through a list of one, so it is computed once.
        done = F.coalesce(least, none) == none
        return F.when(done, acc).otherwise(F.get(F.transform(F.array(F.array_position(r, least).cast("int")), at), F.lit(0)))

    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.aggregate(steps, start, merge, lambda acc: F.transform(acc["p"], rank)))


def encode(df: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``id, ids``: the ids of each row's text, one row for each row of ``df``.

    Null and empty texts give the empty list. Rows may repeat, with or without
    equal ids or texts, and ids may be null. Extra columns are dropped, so they
    can't clash. There are no special tokens: their strings are plain text.
    """
    path = path or default_vocabulary()
    rows = df.select(F.col(id_column).alias("id"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    cut = F.coalesce(words(F.col("t")), F.array().cast("array<string>"))
    # Words without an id of their own keep their place as null; only these words move, with their places.
    known = rows.select("id", "h", _with_ranks(path, lambda rank: F.transform(cut, lambda w: rank(_bytes(w)))).alias("plain"))
    strange = _with_ranks(path, lambda rank: F.filter(F.transform(cut, lambda w, k: F.struct(k.alias("pos"), w.alias("w"))), lambda x: rank(_bytes(x["w"])).isNull()))
    rest = rows.select("id", "h", F.inline(strange))
    # Distinct words are few bytes but much work: a fixed number of partitions keeps them from being merged into one task.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = rest.select("w").distinct().repartition(n, "w").withColumn("ids", encode_word(F.col("w"), path))
    back = rest.join(coded, "w").groupBy("id", "h").agg(F.collect_set(F.struct("pos", "ids")).alias("more"))
    back = back.select(F.col("id").alias("b_id"), F.col("h").alias("b_h"), "more")
    both = known.join(back, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("h") == F.col("b_h")), "left")
    entry = "array<struct<pos:int,ids:array<int>>>"
    plain = F.filter(F.transform("plain", lambda i, k: F.struct(k.alias("pos"), F.array(i).alias("ids"))), lambda e: e["ids"][0].isNotNull()).cast(entry)
    ordered = F.flatten(F.transform(F.array_sort(F.concat(plain, F.col("more").cast(entry))), lambda e: e["ids"]))
    # A text of known words only is done as it is.
    return both.select(F.col("id").alias(id_column), F.when(F.col("more").isNull(), F.col("plain")).otherwise(ordered).alias("ids"))


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of an array of ids: pieces' bytes, concatenated, read as UTF-8."""
    table = F.from_json(F.lit(_piece_json(path or default_vocabulary())), "array<string>")
    joined = let(table, lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i)), ""))
    return F.decode(F.encode(joined, "ISO-8859-1"), "UTF-8")

"""Evaluation passages inside training text, found with suffix arrays of the training side.

Every shard of the corpus (one Arrow batch of documents) gets a suffix array:
its word positions sorted by the words that follow. Words are numbered by the
evaluation side's vocabulary, which is small and fixed; suffixes that begin
with words no item uses can match nothing and are left out of the array. Every
suffix of every item is searched in the array by bisection, and each hit is
extended to the longest verbatim match. Verbatim matches of one document and
item that follow each other closely are chained, so single changed words don't
break a passage.

A shard is searched on its own and needs no shuffle; only passages found leave
it. The evaluation items travel with the task: they are checked to be few.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most characters of evaluation text that travel with each task.
MAX_ITEM_CHARS = 50_000_000
#: Successive words that make a passage a leak.
MIN_WORDS = 12
#: Words of a verbatim match that may start a chain.
SEED = 3
#: Words a suffix is sorted by; longer matches are found by extension.
DEPTH = 8
#: Most words between two verbatim matches of a chain, on either side.
GAP = 4
#: Words that a passage with changed words must keep and span, and the share it must keep.
MIN_KEPT, MIN_SPAN, MIN_SHARE = 13, 15, 0.7
#: In a changed passage, one word of so many may be what another item has in the same slot.
FOREIGN_EVERY = 25
#: Words that a changed passage of fewer than MIN_SPAN words must keep.
MIN_KEPT_SHORT = 10

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[^<>]{0,200}>")
_HIDDEN = re.compile("[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]")


def passage_words(text: str | None) -> list[str]:
    """Words without case, accents, punctuation, spacing and markup; [] for null."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return _WORD.findall(text.casefold())


class Slots:
    """What the items have in a slot, that is beside or between given words."""

    def __init__(self, items: list[list[int]]) -> None:
        self.pairs = {p for ws in items for p in zip(ws, ws[1:])}
        self.fillers: dict[tuple[int, int], set[int]] = defaultdict(set)
        for ws in items:
            for left, word, right in zip(ws, ws[1:], ws[2:]):
                self.fillers[left, right].add(word)

    def compare(self, doc: list[int], d: int, d_to: int, item: list[int], i: int, i_to: int) -> tuple[int, int, int]:
        """Words kept, foreign words and changes at open slots in a gap between two verbatim matches.

        Foreign is a word that some item has beside the same neighbour, or a
        word left out between two that some item has side by side. An open slot
        is one that items fill differently; more than one word exchanged at
        once counts as such.
        """
        same = foreign = opened = 0
        for tag, a, a_to, b, b_to in SequenceMatcher(None, doc[d:d_to], item[i:i_to], autojunk=False).get_opcodes():
            if tag == "equal":
                same += a_to - a
                continue
            for k in range(d + a, d + a_to):
                foreign += doc[k] > 0 and ((doc[k - 1], doc[k]) in self.pairs or (doc[k], doc[k + 1]) in self.pairs)
            if a == a_to:
                foreign += (doc[d + a - 1], doc[d + a]) in self.pairs
            other = len(self.fillers.get((item[i + b - 1], item[i + b_to]), ())) > b_to - b
            opened += other or max(a_to - a, b_to - b) > 1
        return same, foreign, opened


def chains(hits: list[tuple[int, int, int]], doc: list[int], item: list[int], slots: Slots) -> list[tuple[int, int, int, int, int, int, int]]:
    """Maximal verbatim matches (doc position, item position, length) of one document and item to passages.

    A match continues a chain when it begins within GAP words after the
    chain's last match on both sides. ``doc`` and ``item`` hold the words'
    numbers. Returns (doc from, doc to, item words spanned, words kept,
    longest match, foreign words, changes at open slots), most words kept
    first. A gap's words are judged by ``slots``: a single word that was
    changed is rarely what another item has there, the slots of a shared turn
    of phrase always are.
    """
    best: list[list[int]] = []  # doc from, item from, doc to, item to, kept, longest, foreign, opened
    near = best  # those that a later match may still continue
    for d, i, n in sorted(hits):
        found = None
        near = [c for c in near if d - c[2] <= GAP]
        for c in reversed(near):
            skip = max(c[2] - d, c[3] - i, 0)
            if skip < n and 0 <= d + skip - c[2] <= GAP and 0 <= i + skip - c[3] <= GAP and (found is None or c[4] > found[4]):
                found = c
        if found is None:
            best.append([d, i, d + n, i + n, n, n, 0, 0])
            near.append(best[-1])
            continue
        skip = max(found[2] - d, found[3] - i, 0)
        same, foreign, opened = slots.compare(doc, found[2], d + skip, item, found[3], i + skip)
        found[6] += foreign
        found[7] += opened
        found[2], found[3], found[4], found[5] = d + n, i + n, found[4] + same + n - skip, max(found[5], n)
    return sorted(((c[0], c[2], c[3] - c[1], *c[4:]) for c in best), key=lambda c: -c[3])


def is_leak(span: int, kept: int, longest: int, foreign: int, opened: int) -> bool:
    """Twelve successive words verbatim, or a passage in which only scattered words changed.

    One of fewer than MIN_SPAN words is too short to bear a change where
    items differ: any look-alike would do.
    """
    if longest >= MIN_WORDS:
        return True
    if span < MIN_SPAN or kept < MIN_KEPT:
        return span >= MIN_WORDS and kept >= max(MIN_KEPT_SHORT, MIN_SHARE * span) and foreign == opened == 0
    return kept >= MIN_SHARE * span and foreign * FOREIGN_EVERY <= span


class SuffixSearch:
    """Items to be searched in shards. Built on the driver, used in tasks."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        words = [(k, w) for k, t in items if (w := passage_words(t))]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in words for w in ws}), 1)}
        self.items = [(k, [self.vocabulary[w] for w in ws]) for k, ws in words]
        self.slots = Slots([ws for _, ws in self.items])

    def suffixes(self, docs: list[list[str]]):
        """The shard's words as numbers (0: in no item), and its suffix array with sort keys."""
        import numpy as np

        get = self.vocabulary.get
        flat = np.fromiter((get(w, 0) for ws in docs for w in (*ws, "")), dtype=np.int64)
        starts = np.cumsum([0] + [len(ws) + 1 for ws in docs])
        padded = np.concatenate([flat, np.zeros(DEPTH, np.int64)])
        alive = np.flatnonzero(np.logical_and.reduce([padded[k : k + len(flat)] > 0 for k in range(SEED)]))
        rows = np.stack([padded[alive + k] for k in range(DEPTH)], axis=1).astype(">u4")
        keys = np.ascontiguousarray(rows).view(f"S{4 * DEPTH}").ravel() if len(alive) else np.empty(0, f"S{4 * DEPTH}")
        order = np.argsort(keys, kind="stable")
        return flat, starts, alive[order], keys[order]

    def search(self, docs: list[list[str]]) -> list[tuple[int, int, int, int, int, int]]:
        """(document, item, words spanned, kept, longest, words in common) of each leak in the shard."""
        import numpy as np

        flat, starts, array, keys = self.suffixes(docs)
        if not len(array):
            return []
        hits: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for item, numbers in self.items:
            if len(numbers) < MIN_WORDS:
                continue
            heads = np.stack([np.array(numbers[k : len(numbers) - SEED + 1 + k]) for k in range(SEED)], axis=1).astype(">u4")
            low = np.zeros((len(heads), DEPTH), ">u4")
            low[:, :SEED] = heads
            high = np.full((len(heads), DEPTH), 0xFFFFFFFF, ">u4")
            high[:, :SEED] = heads
            lo = np.searchsorted(keys, np.ascontiguousarray(low).view(f"S{4 * DEPTH}").ravel(), "left")
            hi = np.searchsorted(keys, np.ascontiguousarray(high).view(f"S{4 * DEPTH}").ravel(), "right")
            for p in np.flatnonzero(hi > lo):
                at = array[lo[p] : hi[p]]
                # A hit that goes on from the word before is part of a match that began there.
                if p > 0:
                    at = at[flat[at - 1] != numbers[p - 1]] if at.min() > 0 else at[(at == 0) | (flat[at - 1] != numbers[p - 1])]
                for pos, doc in zip(at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist()):
                    n, end = SEED, len(numbers)
                    while p + n < end and flat[pos + n] == numbers[p + n]:
                        n += 1
                    hits[doc, item].append((pos, int(p), n))
        return self._decide(hits, flat, starts)

    def _decide(self, hits, flat, starts) -> list[tuple[int, int, int, int, int, int]]:
        by_doc: dict[int, list[tuple]] = defaultdict(list)
        numbers = dict(self.items)
        for (doc, item), found in hits.items():
            if sum(n for _, _, n in found) >= MIN_WORDS - 2:
                at = int(starts[doc])
                words = flat[at : starts[doc + 1]].tolist()
                for lo, hi, span, kept, longest, foreign, opened in chains([(d - at, i, n) for d, i, n in found], words, numbers[item], self.slots):
                    if is_leak(span, kept, longest, foreign, opened):
                        by_doc[doc].append((kept, item, lo, hi, span, longest))
        out = []
        for doc, passages in by_doc.items():
            passages.sort(key=lambda x: (-x[0], x[1]))
            for n, (kept, item, lo, hi, span, longest) in enumerate(passages):
                # Items share turns of phrase: a passage that another item explains better, word for word, is a look-alike of it.
                rival = any(p[1] != item and p[0] >= kept + 2 and min(hi, p[3]) - max(lo, p[2]) > 0.5 * (hi - lo) for p in passages[:n])
                if longest >= MIN_WORDS or not rival:
                    out.append((doc, item, span, kept, longest, hi - lo))
        return out


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, words, kept, longest``: passages of items in documents, the best one for each pair.

    ``words`` is the passage's length in the item, ``kept`` its words in
    verbatim matches, ``longest`` the longest verbatim match. Null and empty
    texts and items of under twelve words find nothing. Equal items are all
    reported. Rows may repeat; extra columns are dropped.
    """
    small = items.where(F.col("text").isNotNull()).select("item_id", "text")
    size = small.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > MAX_ITEM_CHARS:
        raise ValueError(f"evaluation items hold {size} characters; search them in parts of at most {MAX_ITEM_CHARS}")
    search = SuffixSearch([(r.item_id, r.text) for r in small.distinct().collect()])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            ids = pdf["doc_id"].tolist()
            found = search.search([passage_words(t) for t in pdf["text"]])
            yield pd.DataFrame([(ids[d], *rest) for d, *rest in found], columns=["doc_id", "item_id", "words", "kept", "longest", "length"])

    # Ids travel as texts: beside a null, whole numbers would become inexact ones.
    item_type = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id string, item_id {item_type}, words int, kept int, longest int, length int"
    found = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)
    found = found.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("kept", "words", "longest")).alias("b")).select("doc_id", "item_id", "b.words", "b.kept", "b.longest")


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``documents`` without those that hold a passage; rows with a null id stay."""
    return documents.join(find_leaks(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")

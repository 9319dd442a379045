"""Evaluation texts leaking into training text: winnowing on both sides, hits extended along their diagonal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import spread
from .common import flat_longs, ship, word_hashes
from .overlaps import grams, winnow

#: Words of a seed and seeds of a window: every shared run of 5 words gives a common seed.
GRAM, WINDOW = 3, 3
#: Words of test items that are held by a task at a time; more items go in further passes.
ITEM_WORDS = 1 << 20
#: A line mark: list signs, quote signs, numbers of a list, or a speaker with a colon, at the start of a line.
LINE_MARK = r"(?m)^[ \t]*(?:(?:[-*•>#]+|\d{1,3}[.)]|\p{L}{2,16}:)[ \t]+)+"


def bare_words(text: Column) -> Column:
    """Hashes of the words in order, without line marks."""
    return word_hashes(F.regexp_replace(text, LINE_MARK, ""))


class Items:
    """Test items with their winnowed seeds in sorted order."""

    def __init__(self, numbers: np.ndarray, flat: np.ndarray, off: np.ndarray, gram: int, window: int):
        self.numbers, self.flat, self.off = numbers, flat, off
        h, inside = grams(flat, off, gram)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(h)]
        at = winnow(h, inside, doc, None, window) if len(h) else np.zeros(0, np.int64)
        order = np.argsort(h[at], kind="stable")
        self.key, self.item = h[at][order], doc[at][order]
        self.pos = at[order] - off[self.item]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into h, index into the seeds) of all equal pairs."""
        lo, hi = np.searchsorted(self.key, h, "left"), np.searchsorted(self.key, h, "right")
        n = hi - lo
        at = np.repeat(np.arange(len(h)), n)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def stretches(match: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the longest stretch of matches with single misses inside: (length, matches in it, start)."""
    rows, width = match.shape
    ok = match.copy()
    if width > 2:
        ok[:, 1:-1] |= match[:, :-2] & match[:, 2:]
    run, hit = np.zeros(rows, np.int32), np.zeros(rows, np.int32)
    best, found, end = np.zeros(rows, np.int32), np.zeros(rows, np.int32), np.zeros(rows, np.int32)
    for j in range(width):
        run = (run + 1) * ok[:, j]
        hit = (hit + match[:, j]) * ok[:, j]
        up = run > best
        best, found, end = np.where(up, run, best), np.where(up, hit, found), np.where(up, j, end)
    return best, found, end - best + 1


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.6, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_no, item_words, stretch, matched, doc_word, item_word): documents that hold a test item.

    documents: doc_id, text; items: item_no, text; further columns are ignored.  A document holds an item if at least
    ``share`` of the item's words stand in it in one stretch and in the item's order; single words within may be
    replaced.  Case, punctuation, spacing and line marks don't count.  stretch counts all words of the stretch, matched
    those that are equal; doc_word and item_word are the 0-based places where it begins.  Null and empty texts hold
    nothing and stand nowhere; every different text of a number is looked for; of one pair the longest stretch
    stays.  Seeds are joined in the map stage against the items' seeds, of which at most ITEM_WORDS words are sent at
    a time, so documents are never shuffled and a common phrase can't be hot.
    """
    test = items.select("item_no", bare_words(F.col("text")).alias("w")).filter((F.size("w") > 0) & F.col("item_no").isNotNull()).distinct()
    words = test.agg(F.sum(F.size("w"))).first()[0] or 0
    passes = max(1, -(-words // ITEM_WORDS))
    docs = spread(documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")).select("doc_id", bare_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    out = None
    for p in range(passes):
        t = (test if passes == 1 else test.filter(F.pmod(F.xxhash64("item_no"), F.lit(passes)) == p)).orderBy("item_no", "w").toArrow()
        flat, off = flat_longs(t.column("w")) if t.num_rows else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        part = _scan(docs, Items(t.column("item_no").to_numpy(), np.ascontiguousarray(flat), off, gram, window), share, gram, window)
        out = part if out is None else out.unionByName(part)
    best = F.max_by(F.struct("item_words", "stretch", "matched", "doc_word", "item_word"), F.struct("stretch", "matched", -F.col("doc_word"))).alias("b")
    return out.groupBy("doc_id", "item_no").agg(best).select("doc_id", "item_no", "b.*")


def _scan(docs: DataFrame, items: Items, share: float, gram: int, window: int) -> DataFrame:
    get = ship(docs.sparkSession, items)
    names = ["doc_id", "item_no", "item_words", "stretch", "matched", "doc_word", "item_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = get()
        need = np.ceil(np.diff(it.off) * share - 1e-9).astype(np.int64)
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                flat, off = flat_longs(b.column("w"))
                h, inside = grams(np.ascontiguousarray(flat), off, gram)
                if not len(h) or not len(it.key):
                    continue
                doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(h)]
                at = winnow(h, inside, doc, None, window)
                x, y = it.hits(h[at])
                if not len(x):
                    continue
                place, item = at[x], it.item[y]
                d = doc[place]
                start = place - it.pos[y]  # where the item's first word would stand in flat
                items_n, longest = len(it.off) - 1, int(np.diff(it.off).max())
                span = len(flat) + longest + 1
                code = np.unique((d * items_n + item) * span + (start + longest))  # start is at least -longest
                both, at_word = np.divmod(code, span)
                cand = np.stack([both // items_n, both % items_n, at_word - longest], 1)
                size = np.diff(it.off)[cand[:, 1]]
                order = np.argsort(size, kind="stable")
                cand, size = cand[order], size[order]
                got = []
                for c0 in range(0, len(cand), 20_000):
                    c, n = cand[c0 : c0 + 20_000], size[c0 : c0 + 20_000]
                    j = np.arange(int(n.max()), dtype=np.int32)
                    pos = c[:, 2:].astype(np.int32) + j
                    legal = (j < n[:, None]) & (pos >= off[c[:, 0]][:, None]) & (pos < off[c[:, 0] + 1][:, None])
                    same = legal & (flat.take(pos, mode="clip") == it.flat.take(it.off[c[:, 1]][:, None] + j, mode="clip"))
                    # A stretch has no two misses in a row, so at least half of its words match.
                    enough = 2 * same.sum(1) >= need[c[:, 1]]
                    c, n, same = c[enough], n[enough], same[enough]
                    length, matched, first = stretches(same)
                    hit = length >= need[c[:, 1]]
                    got.append(np.stack([c[hit, 0], c[hit, 1], n[hit], length[hit], matched[hit], c[hit, 2] + first[hit] - off[c[hit, 0]], first[hit]], 1))
                r = np.concatenate(got)
                if len(r):
                    ids = b.column("doc_id").take(pa.array(r[:, 0]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(it.numbers[r[:, 1]]), *(pa.array(r[:, k].astype(np.int32)) for k in range(2, 7))], names=names)

    return docs.mapInArrow(run, "doc_id long, item_no long, item_words int, stretch int, matched int, doc_word int, item_word int")

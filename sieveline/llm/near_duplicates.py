"""Near-duplicate records with small edits: MinHash banding with verification on the full word sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import save
from .buckets import ENDS, AlikeSets, band_keys, candidates, ends, minhash, named, records_of, sketches, with_size
from .common import flat_longs, word_set
from .components import components

#: A pair of similarity 0.7 meets in a band with probability 0.996, of 0.75 with 0.9997.
ROWS, BANDS = 5, 30
#: Bands for the classes in hot buckets: a pair of similarity 0.7 meets with probability 0.999, of 0.5 with 0.36.
FINE_ROWS, FINE_BANDS = 8, 116
#: Members of a class that one task joins at most.
CLASS_BLOCK = 4096


def sketched(rows: DataFrame, members: str, keep: str) -> DataFrame:
    """Rows (``keep``, as names and types) with s1, s2 and n, the sketch and size of the set in the array<bigint> ``members``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s, n = sketches(*flat_longs(b.column(members)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(n.astype(np.int32))], names=[*names, "s1", "s2", "n"])

    names = [c.split()[0] for c in keep.split(", ")]
    return rows.select(*dict.fromkeys([*names, members])).mapInArrow(run, f"{keep}, s1 long, s2 long, n int")


def word_sets(docs: DataFrame, min_words: int, name: str = "word-sets") -> DataFrame:
    """(id, ck, words, s1, s2, n) of the texts with ``min_words`` different words, written to the shared folder.

    ck is a 64-bit hash of the sorted word set: texts of the same set are one class.  Null texts and texts of
    fewer words have no row.  A row delivered twice is there twice; readers take distinct (id, ck).
    """
    sets = docs.select(F.col("id").cast("string").alias("id"), word_set(F.col("text")).alias("words")).filter((F.size("words") >= min_words) & F.col("id").isNotNull())
    return save(sketched(sets.select("id", F.xxhash64("words").alias("ck"), "words"), "words", "id string, ck long, words array<long>"), name)


def band_rows(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, s1, s2) for every band of every set; a task sends a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            new = np.zeros(b.num_rows, bool)
            for i, c in enumerate(b.column("ck").to_pylist()):
                if c not in seen:
                    seen.add(c)
                    new[i] = True
            if new.any():
                b = b.filter(pa.array(new))
                keys = with_size(band_keys(minhash(*flat_longs(b.column("words")), bands * rows, 0), bands, rows), b.column("n").to_numpy()[:, None])
                for j in range(0, bands, 10):
                    part = keys[:, j : j + 10]
                    wide = part.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(part.ravel()), *(pa.array(np.repeat(b.column(c).to_numpy(), wide)) for c in ("s1", "s2"))], names=["key", "s1", "s2"])

    return sets.select("ck", "words", "s1", "s2", "n").mapInArrow(run, "key long, s1 long, s2 long")


def class_links(sets: DataFrame, threshold: float, bands: int = BANDS, rows: int = ROWS, name: str = "links") -> DataFrame:
    """(a, b, similarity) for classes a < b whose word sets have at least ``threshold`` of all words in common.

    Classes in a bucket of more than HOT classes are banded again, with more rows to a band.
    """

    def finer(hot: DataFrame) -> DataFrame:
        return band_rows(records_of(sets, hot), FINE_BANDS, FINE_ROWS)

    near = save(candidates(band_rows(sets, bands, rows), f"{name}-candidates", AlikeSets(threshold), refine=finer, expected=sets.count() * bands), f"{name}-near")
    return save(verify(near, sets, threshold), name)


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The classes of the pairs of sketches, and the different classes of one sketch, whose full word sets reach the threshold."""
    shared = sets.groupBy("s1", "s2", "n").agg(F.min("ck").alias("least"), F.max("ck").alias("most")).filter("least < most").select("s1", "s2", "n")
    alone = shared.select(*(F.col(c).alias(f"{e}{k}") for e in "ab" for c, k in (("s1", "1"), ("s2", "2"), ("n", "n"))))
    every = save(pairs.select(*ENDS).unionByName(alone), "links-sketches")
    w = save(records_of(sets, ends(every)).select("s1", "s2", "n", "ck", "words").dropDuplicates(["ck"]), "links-words")
    side = lambda e: named(w.withColumnsRenamed({"ck": e, "words": f"w{e}"}), e)
    both = every.join(side("a"), ["a1", "a2", "an"]).join(side("b"), ["b1", "b2", "bn"]).filter((F.col("a") < F.col("b")) | (F.struct("a1", "a2", "an") != F.struct("b1", "b2", "bn")) & (F.col("a") != F.col("b")))
    common = F.size(F.array_intersect("wa", "wb")).cast("double")
    both = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (common / (F.size("wa") + F.size("wb") - common)).alias("similarity"))
    return both.filter(F.col("similarity") >= threshold - 1e-12)


def near_duplicates(docs: DataFrame, threshold: float = 0.7, min_words: int = 8, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Members (id, ck) and links (a, b, similarity) between classes of equal word sets.

    ``docs`` has id and text; further columns are ignored.  Null, empty and short texts (fewer than ``min_words``
    different words) are in no class.  Rows delivered twice count once.
    """
    sets = word_sets(docs, min_words)
    return sets.select("id", "ck").distinct(), class_links(sets, threshold, bands, rows)


def pairs_of_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: members of one class, and members of linked classes.

    A class of many members is cut in blocks of about CLASS_BLOCK and a link becomes one link per pair of blocks.
    """
    sizes = members.groupBy("ck").agg(F.count(F.lit(1)).alias("m"))
    cut = F.ceil(F.col("m") / CLASS_BLOCK).cast("int")
    linked = links.select("a", "b").join(sizes.select(F.col("ck").alias("a"), cut.alias("sa")), "a").join(sizes.select(F.col("ck").alias("b"), cut.alias("sb")), "b")
    own = sizes.filter("m > 1").select(F.col("ck").alias("a"), F.col("ck").alias("b"), cut.alias("sa"), cut.alias("sb"))
    steps = linked.select("a", "b", "sa", "sb").unionByName(own)
    steps = steps.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("sa") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("sb") - 1))).filter((F.col("a") != F.col("b")) | (F.col("i") <= F.col("j")))
    placed = members.join(sizes, "ck").select("id", "ck", F.pmod(F.xxhash64("id"), cut).cast("int").alias("block"))
    left = placed.select(F.col("id").alias("id_l"), F.col("ck").alias("a"), F.col("block").alias("i"))
    right = placed.select(F.col("id").alias("id_r"), F.col("ck").alias("b"), F.col("block").alias("j"))
    both = steps.drop("sa", "sb").join(left, ["a", "i"]).join(right, ["b", "j"]).filter((F.col("a") != F.col("b")) | (F.col("i") != F.col("j")) | (F.col("id_l") < F.col("id_r")))
    return both.select(F.least("id_l", "id_r").alias("id_a"), F.greatest("id_l", "id_r").alias("id_b"))


def near_duplicate_groups(docs: DataFrame, threshold: float = 0.7, min_words: int = 8) -> DataFrame:
    """(id, class_id, group_id, class_size, n_links): one row per record in a class of at least two records or with a link.

    group_id is the connected component of the class, n_links the number of links of the class to others.
    """
    members, links = near_duplicates(docs, threshold, min_words)
    ends = links.select(F.explode(F.array("a", "b")).alias("ck")).groupBy("ck").agg(F.count(F.lit(1)).alias("n_links"))
    sizes = members.groupBy("ck").agg(F.count(F.lit(1)).alias("class_size"))
    label = components(links.select("a", "b"))
    kept = sizes.join(ends, "ck", "left").join(label.withColumnRenamed("node", "ck"), "ck", "left").filter((F.col("class_size") > 1) | F.col("n_links").isNotNull())
    kept = kept.select("ck", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "ck").alias("root"))
    return members.join(kept, "ck").select("id", F.hex("ck").alias("class_id"), F.hex("root").alias("group_id"), "class_size", "n_links")

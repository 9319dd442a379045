"""Reading level of documents: smoothed unigram language models per grade level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.shared import save, spread
from .common import flat_longs, ship

#: Upper bounds of the levels, in school years; the last level is open.
LEVELS = (4.0, 6.0, 8.0, 10.0, 13.0, 17.0)
#: Words of highest count that every executor holds; all others are joined.
VOCABULARY = 50_000
#: Weight of the level's own counts against all levels' (Dirichlet prior of that many words), and of a labelled text.
PRIOR_WORDS, LABEL_WEIGHT = 2000.0, 5.0

# Frequent English function words that German, French, Spanish and Dutch texts seldom have.
ENGLISH = "the of and to that is it for with this by which not has been have are my our your we they be".split()


def measured(texts: DataFrame, *keep: str) -> DataFrame:
    """``keep`` with words (array), n_words, n_sentences, n_syllables and n_english of the text; null counts as empty.

    A line end also ends a sentence.  The words are extracted once and used by all that follows.
    """
    t = texts.withColumn("_t", F.coalesce("text", F.lit(""))).withColumn("_low", F.lower("_t")).withColumn("words", words(F.col("_t")))
    sentences = F.size(F.filter(F.split("_t", r"[.!?]+[\"”’')]*(?=\s|$)|[\n\r]+"), lambda s: s.rlike(r"\p{L}")))
    silent = F.regexp_count("_low", F.lit(r"e(?!\p{L})(?<=[aeiouy][^aeiouy\P{L}]{1,4}(?<!l)e)"))
    groups = F.regexp_count("_low", F.lit(r"[aeiouyàâäéèêëíîïóôöúùûü]+"))
    english = F.size(F.filter("words", lambda w: w.isin(ENGLISH)))
    n = F.size(F.filter("words", lambda w: w.rlike(r"^\p{L}")))
    out = t.select(*keep, "words", n.alias("n_words"), sentences.alias("n_sentences"), (groups - silent).alias("_s"), english.alias("n_english"))
    return out.withColumn("n_syllables", F.greatest("_s", "n_words")).drop("_s")


def formula_grade() -> Column:
    """School years by sentence length and syllables per word (Flesch-Kincaid); null without words."""
    w = F.col("n_words").cast("double")
    return F.when((F.col("n_words") > 0) & (F.col("n_sentences") > 0), 0.39 * w / F.col("n_sentences") + 11.8 * F.col("n_syllables") / w - 15.59)


def is_english(least: float = 0.15) -> Column:
    return (F.col("n_words") > 0) & (F.col("n_english") >= least * F.col("n_words"))


def _level(grade: Column) -> Column:
    out = F.lit(len(LEVELS))
    for k in range(len(LEVELS) - 1, -1, -1):
        out = F.when(grade <= LEVELS[k], k).otherwise(out)
    return out


class Models:
    """Log probabilities of all training words per level, levels without training text left out.

    The words of highest count are held here; ``rest`` is the table of the others (key, and per level g0, g1, ... what the
    word adds to the value of an unknown one), None where there are no others.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, sums: np.ndarray, n_words: int, grades: np.ndarray, texts: np.ndarray):
        """keys and counts are of the words held here, sums and n_words of all words."""
        self.levels = np.flatnonzero(sums > 0)
        self.scale = (sums.sum() + n_words) / PRIOR_WORDS
        self.unknown = -np.log(self.scale * (sums[self.levels] + PRIOR_WORDS))
        self.prior = np.log((texts[self.levels] + 1) / (texts[self.levels] + 1).sum())
        self.grade = grades[self.levels]
        order = np.argsort(keys)
        gain = np.log(counts[:, self.levels] * self.scale + counts.sum(1, keepdims=True) + 1.0)
        self.keys, self.log = keys[order], (self.unknown + gain)[order]
        self.rest: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}

    def gains(self, words: DataFrame) -> DataFrame:
        """The table for ``rest``, from key, total and the counts of the levels."""
        return words.select("key", *(F.log(F.col(f"n{k}") * float(self.scale) + F.col("total") + 1.0).alias(f"g{i}") for i, k in enumerate(self.levels)))

    def sums(self, flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, levels) log likelihoods of texts of at least one word, and which of the words are held here."""
        at = np.minimum(np.searchsorted(self.keys, flat), len(self.keys) - 1)
        known = self.keys[at] == flat
        each = np.where(known[:, None], self.log[at], self.unknown)
        return np.add.reduceat(each, off[:-1], axis=0), known

    def posterior(self, sums: np.ndarray) -> np.ndarray:
        s = sums + self.prior
        s -= s.max(1, keepdims=True)
        p = np.exp(s)
        return p / p.sum(1, keepdims=True)


def prepared(documents: DataFrame) -> DataFrame:
    """(doc_id, w, formula, english), written once: hashes of all words in order, the formula's grade, the language check.

    One row per doc_id: the least text where texts differ.  The texts are shuffled only if an id is repeated.
    """
    if {"w", "formula", "english"} <= set(documents.columns):
        return documents
    d = documents.select("doc_id", "text")
    if not d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        d = d.groupBy("doc_id").agg(F.min("text").alias("text"))
    return save(measured(spread(d), "doc_id").select("doc_id", _hashes(), formula_grade().alias("formula"), F.coalesce(is_english(), F.lit(False)).alias("english")), "reading-documents")


def _hashes() -> Column:
    return F.transform("words", lambda x: F.xxhash64(x)).alias("w")


def train(passages: DataFrame, documents: DataFrame) -> Models | None:
    """Models from labelled passages and from documents whose level the formula gives; None without any text.

    passages: text, grade (null: left out); documents: doc_id, text, or what ``prepared`` made of them.  All English
    documents and all their words count, each doc_id once; the VOCABULARY words of highest count reach the driver.
    """
    labelled = measured(passages.filter(F.col("grade").isNotNull() & F.col("text").isNotNull()), "grade").select(_hashes(), F.col("grade").cast("double").alias("grade"), F.lit(LABEL_WEIGHT).alias("weight"))
    seeded = prepared(documents).filter("english").select("w", F.col("formula").alias("grade"), F.lit(1.0).alias("weight"))
    texts = labelled.unionByName(seeded).filter("grade is not null").withColumn("level", _level(F.col("grade")))
    heads = {r.level: r for r in texts.groupBy("level").agg(F.sum("weight").alias("n"), (F.sum(F.col("weight") * F.col("grade")) / F.sum("weight")).alias("grade")).collect()}
    if not heads:
        return None
    own = [f"n{k}" for k in range(len(LEVELS) + 1)]
    each = texts.select("level", "weight", F.explode("w").alias("key")).groupBy("key").agg(*(F.sum(F.when(F.col("level") == k, F.col("weight")).otherwise(0.0)).alias(c) for k, c in enumerate(own)))
    count = save(each.withColumn("total", sum((F.col(c) for c in own), F.lit(0.0))), "reading-words")
    whole = count.agg(F.count(F.lit(1)).alias("words"), *(F.sum(c).alias(c) for c in own)).first()
    if not whole.words:
        return None
    t = count.orderBy(F.desc("total"), "key").limit(VOCABULARY).toArrow()
    grades, n = np.zeros(len(own)), np.zeros(len(own))
    for k, r in heads.items():
        grades[k], n[k] = r.grade, r.n
    out = Models(t.column("key").to_numpy(), np.stack([t.column(c).to_numpy() for c in own], 1), np.array([whole[c] for c in own]), whole.words, grades, n)
    if whole.words > t.num_rows:
        total, key = (t.column(c)[-1].as_py() for c in ("total", "key"))
        out.rest = out.gains(count.filter((F.col("total") < total) | ((F.col("total") == total) & (F.col("key") > key))))
    return out


def reading_levels(documents: DataFrame, models: Models | None) -> DataFrame:
    """(doc_id, level, grade, expected_grade, posterior, formula, english): the level of highest posterior likelihood.

    documents: doc_id, text, or what ``prepared`` made of them.  grade is the level's mean grade, expected_grade the
    posterior mean.  Texts without words (null, empty) have null level, grade and posterior.  Rows of one doc_id count once.
    """
    rows = prepared(documents)
    if models is None:
        return rows.select("doc_id", F.lit(None).cast("int").alias("level"), *(F.lit(None).cast("double").alias(c) for c in ("grade", "expected_grade", "posterior")), "formula", "english")
    get = ship(documents.sparkSession, models)
    sums, rare = [f"s{i}" for i in range(len(models.levels))], models.rest is not None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the words held by the models, and the words that they don't hold."""
        m = get()
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                flat, off = flat_longs(b.column("w"))
                some, known = np.diff(off) > 0, np.zeros(0, bool)
                s = np.zeros((b.num_rows, len(sums)))
                if some.any():
                    s[some], known = m.sums(flat, np.r_[off[:-1][some], off[-1]])
                cols = [b.column("doc_id"), b.column("formula"), b.column("english"), *(pa.array(v, mask=~some) for v in s.T)]
                if rare:
                    at = np.r_[0, np.cumsum(~known)][off]
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat[~known], pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "formula", "english", *sums, *(["rare"] if rare else [])])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = get()
        for b in batches:
            s = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in sums], 1)
            none = np.isnan(s[:, 0])
            p = m.posterior(np.where(none[:, None], 0.0, s))
            best = p.argmax(1)
            cols = [pa.array(m.levels[best].astype(np.int32), mask=none), *(pa.array(v, mask=none) for v in (m.grade[best], p @ m.grade, p.max(1)))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, b.column("formula"), b.column("english")], names=["doc_id", "level", "grade", "expected_grade", "posterior", "formula", "english"])

    out = "doc_id long, level int, grade double, expected_grade double, posterior double, formula double, english boolean"
    if not rare:
        return rows.mapInArrow(lambda batches: decide(add(batches)), out)
    part = save(rows.mapInArrow(add, f"doc_id long, formula double, english boolean, {', '.join(f'{c} double' for c in sums)}, rare array<long>"), "reading-sums")
    gains = [c.replace("s", "g") for c in sums]
    more = part.select(F.col("doc_id").alias("_id"), F.explode("rare").alias("key")).join(models.rest, "key").groupBy("_id").agg(*(F.sum(c).alias(c) for c in gains))
    both = part.drop("rare").join(more, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return both.select("doc_id", "formula", "english", *((F.col(c) + F.coalesce(g, F.lit(0.0))).alias(c) for c, g in zip(sums, gains))).mapInArrow(decide, out)

"""Documents as chunks: chunking by sentences, chunk vectors pooled per document, all or nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hash_embedding, mean_embedding, norm
from ..sources.shared import spread

MAX_CHUNKS = 64
ERROR_CODES = ("empty_document", "too_many_chunks", "wrong_width", "not_finite", "not_unit", "duplicate_id")


def chunks(documents: DataFrame, max_words: int = 60, key: str = "doc_id") -> DataFrame:
    """(key, pos, chunk): whole sentences in order, filled up to the word budget; a longer sentence is a chunk of its own.

    Null and empty texts have no chunk.
    """
    return documents.filter(F.col("text").isNotNull()).select(key, F.posexplode(packed(max_words)).alias("pos", "chunk"))


def packed(max_words: int) -> Column:
    """The chunks of ``text`` as an array."""
    sentences = F.filter(F.split(F.trim(F.col("text")), r"(?<=[.!?])\s+|\n+"), lambda s: F.length(F.trim(s)) > 0)
    counted = F.transform(sentences, lambda s: F.struct(s.alias("s"), F.size(F.split(F.trim(s), r"\s+")).alias("n")))
    start = F.struct(F.lit(0).alias("fill"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        counted,
        start,
        lambda a, x: F.when(
            (a["fill"] > 0) & (a["fill"] + x["n"] <= max_words),
            F.struct((a["fill"] + x["n"]).alias("fill"), F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(F.concat_ws(" ", F.element_at(a["out"], -1), x["s"]))).alias("out")),
        ).otherwise(F.struct(x["n"].alias("fill"), F.concat(a["out"], F.array(x["s"])).alias("out"))),
        lambda a: a["out"],
    )


def plan_chunks(documents: DataFrame, budget: int, count: Callable[[list[str]], list[int]] | None = None, *, embed: Callable[[list[str]], np.ndarray] | None = None, least_cosine: float | None = None, key: str = "doc_id") -> DataFrame:
    """(key, pos, chunk, tokens): chunks by a tokenizer of the caller, within ``budget`` tokens each.

    ``count`` gives the tokens of strings (words where None).  Sentences fill a chunk in order; one longer than the budget
    is cut between words, and a word longer than it stands alone.  With ``embed`` (strings to unit vectors) a chunk also
    ends where neighbouring sentences are less than ``least_cosine`` alike.  Both work on the sentences of whole documents
    in Arrow batches.  Null and empty texts have no chunk.
    """
    kind = documents.schema[key].dataType.simpleString()
    size = count or (lambda texts: [len(t.split()) for t in texts])

    def fit(sentence: str) -> list[str]:
        words, out = sentence.split(), []
        while words:
            n = len(words)
            while n > 1 and size([" ".join(words[:n])])[0] > budget:
                n //= 2
            out.append(" ".join(words[:n]))
            words = words[n:]
        return out

    def plan(sentences: list[str]) -> list[tuple[str, int]]:
        pieces = [p for s, n in zip(sentences, size(sentences)) for p in ([s] if n <= budget else fit(s))]
        like = None
        if embed is not None and least_cosine is not None and len(pieces) > 1:
            v = np.asarray(embed(pieces), float)
            like = (v[1:] * v[:-1]).sum(1)
        out: list[tuple[str, int]] = []
        for i, p in enumerate(pieces):
            both = f"{out[-1][0]} {p}" if out else p
            n = size([both])[0]
            if out and n <= budget and (like is None or like[i - 1] >= least_cosine):
                out[-1] = both, n
            else:
                out.append((p, size([p])[0]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, pos, c, n) for i, s in enumerate(b.column("s").to_pylist()) for pos, (c, n) in enumerate(plan(s))]
            at, pos, chunk, tokens = zip(*got) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(chunk, pa.string()), pa.array(tokens, pa.int32())], names=[key, "pos", "chunk", "tokens"])

    rows = documents.filter(F.col("text").isNotNull()).select(key, sentences_of(F.col("text")).alias("s"))
    return spread(rows.filter(F.size("s") > 0)).mapInArrow(run, f"{key} {kind}, pos int, chunk string, tokens int")


def sentences_of(text: Column) -> Column:
    """Sentences in order, trimmed; a line end also ends one."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def embed_chunks(chunked: DataFrame, dimensions: int = 64) -> DataFrame:
    """Chunk vectors by the deterministic hash embedding, each different text embedded once."""
    once = spread(chunked.select("chunk").distinct()).withColumn("embedding", hash_embedding(F.col("chunk"), dimensions))
    return chunked.join(once, "chunk")


def pool(vectors: DataFrame, width: int, key: str = "doc_id", max_chunks: int | None = None) -> DataFrame:
    """(key, chunks, embedding): mean of the chunk vectors per position, never renormalised.

    One aggregate per position, added up before the shuffle.  Documents with a chunk of another width, or of more than
    ``max_chunks`` chunks, have no row.
    """
    at = [F.sum(F.get("embedding", F.lit(i)).cast("double")).alias(f"_s{i}") for i in range(width)]
    wrong = F.count_if(F.coalesce(F.size("embedding") != width, F.lit(True))).alias("_wrong")
    g = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), wrong, *at).filter("_wrong = 0")
    g = g if max_chunks is None else g.filter(F.col("_n") <= max_chunks)
    return g.select(key, F.col("_n").cast("int").alias("chunks"), F.array(*(F.col(f"_s{i}") / F.col("_n") for i in range(width))).alias("embedding"))


def problems(vectors: DataFrame, width: int, *, max_chunks: int = MAX_CHUNKS, unit_length: bool = False, key: str = "doc_id") -> DataFrame:
    """(key, error_code): documents of which a chunk is refused; such documents give no result at all."""
    v = F.col("embedding")
    bad = F.when(v.isNull() | (F.size(v) != width), "wrong_width").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
    if unit_length:
        bad = bad.when(F.abs(norm(v) - 1) > 1e-3, "not_unit")
    own = vectors.withColumn("error_code", bad).filter("error_code is not null").groupBy(key).agg(F.min("error_code").alias("error_code"))
    many = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_chunks).select(key, F.lit("too_many_chunks").alias("error_code"))
    return own.unionByName(many).groupBy(key).agg(F.min("error_code").alias("error_code"))


def document_features(documents: DataFrame, dimensions: int = 64, *, max_words: int = 60, max_chunks: int = MAX_CHUNKS, key: str = "doc_id") -> DataFrame:
    """(key, chunks, embedding, text_digest) of the documents without a problem; no raw text comes out.

    Chunks, their hash embeddings and the mean stay within the document's row: nothing is shuffled but repeated keys.
    """
    rows = documents.filter(F.col("text").isNotNull() & F.col(key).isNotNull()).select(key, "text").dropDuplicates([key])
    cut = spread(rows).select(key, F.sha2("text", 256).alias("text_digest"), packed(max_words).alias("_c")).filter(F.size("_c").between(1, max_chunks))
    return cut.select(key, F.size("_c").alias("chunks"), mean_embedding(F.col("_c"), dimensions).alias("embedding"), "text_digest")


def divided_groups(rows: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """Groups whose documents sit in more than one split."""
    return rows.groupBy(group).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


def context_features(rows: DataFrame, context: DataFrame, key: str = "id") -> DataFrame:
    """Message and context vectors side by side; the width is the sum of both."""
    return rows.join(context.select(key, F.col("embedding").alias("_ctx")), key).withColumn("embedding", F.concat("embedding", "_ctx")).drop("_ctx")

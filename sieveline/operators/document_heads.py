"""Heads over whole documents: identity of the feature space, training, the artifact around it, and scoring in batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import canonical_digest
from ..functions.vectors import mean_embedding, mean_vector, norm
from ..sources.shared import spread
from . import artifact, training
from .documents import MAX_CHUNKS, divided_groups, packed
from .scoring import score

SCHEMA, FEATURES_SCHEMA = "sieveline-document-heads/1", "sieveline-document-features/1"
#: Why a document has no scores.
ERROR_CODES = ("INVALID_INPUT", "PREPROCESSING_FAILURE", "INPUT_LIMIT_EXCEEDED", "IDENTITY_MISMATCH", "ENCODER_FAILURE", "INVALID_EMBEDDING", "INVALID_SCORE", "ABORTED", "DEADLINE_EXCEEDED")
FIELDS = ("schema", "version", "created_at", "encoder", "pipeline", "feature_identity", "classifier")
#: Deviation from unit length that a normalised chunk vector may have.
UNIT = 1e-3


class DocumentError(ValueError):
    """What stops a whole batch; documents that fail alone carry the code in a column instead."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Encoder:
    """The chunk encoder."""

    model_id: str
    revision: str
    dimensions: int
    normalized: bool = False
    max_input_words: int | None = None


@dataclass(frozen=True)
class Pipeline:
    """How a text becomes chunks."""

    max_words: int = 60
    max_chunks: int = MAX_CHUNKS
    max_bytes: int = 1 << 24


def compatibility_problems(encoder: Encoder, pipeline: Pipeline) -> list[str]:
    bad = []
    if not encoder.model_id or not encoder.revision:
        bad.append("an encoder needs a model and a revision")
    if encoder.dimensions < 1 or pipeline.max_words < 1 or pipeline.max_chunks < 1:
        bad.append("dimensions, words and chunks must be positive")
    if encoder.max_input_words is not None and encoder.max_input_words < pipeline.max_words:
        bad.append(f"the encoder takes {encoder.max_input_words} words, a chunk has up to {pipeline.max_words}")
    return bad


def feature_identity(encoder: Encoder, pipeline: Pipeline) -> str:
    """Digest of everything that decides a document's vector."""
    return canonical_digest({"schema": FEATURES_SCHEMA, "encoder": asdict(encoder), "pipeline": asdict(pipeline)})


def feature_embedding(encoder: Encoder) -> dict:
    """The embedding spec of pooled vectors, which is not the chunk encoder's own."""
    return {"model_id": f"{FEATURES_SCHEMA}:mean({encoder.model_id}@{encoder.revision})", "dimensions": encoder.dimensions, "normalize": False}


def _code(*checks: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for bad, code in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(True)), code).otherwise(out)
    return out


def document_vectors(documents: DataFrame, encoder: Encoder, pipeline: Pipeline, embed: Callable[[DataFrame], DataFrame] | None = None, key: str = "doc_id") -> DataFrame:
    """(key, chunks, embedding, error_code): one vector per document, or the reason that it has none; never part of one.

    ``embed`` maps (key, pos, chunk) to (key, pos, embedding) by an encoder of the caller; without it the hash embedding
    is taken within the document's row.  Of rows of one key one counts.
    """
    wrong = compatibility_problems(encoder, pipeline)
    if wrong:
        raise DocumentError("IDENTITY_MISMATCH", "; ".join(wrong))
    rows = spread(documents.filter(F.col(key).isNotNull()).select(key, "text").dropDuplicates([key]))
    cut = rows.select(key, F.octet_length("text").alias("_bytes"), packed(pipeline.max_words).alias("_c")).withColumn("chunks", F.coalesce(F.size("_c"), F.lit(0)))
    early = _code((F.col("_bytes").isNull() | (F.col("chunks") < 1), "INVALID_INPUT"), ((F.col("_bytes") > pipeline.max_bytes) | (F.col("chunks") > pipeline.max_chunks), "INPUT_LIMIT_EXCEEDED"))
    cut = cut.select(key, "chunks", "_c", early.alias("error_code"))
    if embed is None:
        made = cut.withColumn("embedding", mean_embedding(F.when(F.col("error_code").isNull(), F.col("_c")), encoder.dimensions)).drop("_c")
        return made.select(key, "chunks", "embedding", "error_code")
    sent = cut.filter("error_code is null").select(key, F.posexplode("_c").alias("pos", "chunk"))
    back = embed(sent).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "embedding"))), lambda c: c["embedding"]).alias("_v"))  # at most max_chunks of a document
    ok = F.forall("_v", lambda v: v.isNotNull() & (F.size(v) == encoder.dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    if encoder.normalized:
        ok = ok & F.forall("_v", lambda v: F.abs(norm(v) - 1) <= UNIT)
    joined = cut.drop("_c").join(back, key, "left")
    late = _code((F.size("_v") < F.col("chunks"), "ENCODER_FAILURE"), (~ok, "INVALID_EMBEDDING"))
    code = F.when(F.col("error_code").isNotNull(), F.col("error_code")).when(F.col("_v").isNull(), "ENCODER_FAILURE").otherwise(late)
    return joined.withColumn("error_code", code).select(key, "chunks", F.when(F.col("error_code").isNull(), mean_vector(F.col("_v"), encoder.dimensions)).alias("embedding"), "error_code")


def train_document_heads(features: DataFrame, policies: dict[str, dict], encoder: Encoder, pipeline: Pipeline, **options) -> dict:
    """Linear heads on (id, x, split, group, y_<head>), one row per document; a group must sit in one split."""
    wrong = compatibility_problems(encoder, pipeline)
    wrong += [f"head {n}: document heads are linear only" for n, p in policies.items() if p.get("type", "linear") != "linear"]
    shared = divided_groups(features, "group").limit(1).collect()
    wrong += [f"group {r.group} spans several splits" for r in shared]
    if wrong:
        raise DocumentError("IDENTITY_MISMATCH" if not shared else "INVALID_INPUT", "; ".join(wrong))
    heads = training.train_heads(features, policies, encoder.dimensions, **options)
    documents, groups = features.agg(F.count(F.lit(1)), F.countDistinct("group")).first()
    return {"heads": heads, "encoder": encoder, "pipeline": pipeline, "feature_identity": feature_identity(encoder, pipeline), "documents": documents, "groups": groups}


def build_document_artifact(result: dict, version: str, created_at: str) -> dict:
    """The envelope: chunk encoder, pipeline, their digest and the classifier over pooled vectors."""
    record = {"document": {"feature_identity": result["feature_identity"], "documents": result["documents"], "groups": result["groups"], "unit": "document"}}
    classifier = artifact.build(result["heads"], feature_embedding(result["encoder"]), training=record, created_at=created_at)
    return {"schema": SCHEMA, "version": version, "created_at": created_at, "encoder": asdict(result["encoder"]), "pipeline": asdict(result["pipeline"]), "feature_identity": result["feature_identity"], "classifier": classifier}


def is_document_artifact(doc: object) -> bool:
    return isinstance(doc, dict) and doc.get("schema") == SCHEMA


def validate_document_artifact(doc: dict) -> list[str]:
    """Every reason that an envelope can't be used."""
    if not is_document_artifact(doc):
        return ["not a document artifact of this schema"]
    bad = [f"unknown field {k}" for k in doc if k not in FIELDS] + [f"missing field {k}" for k in FIELDS if k not in doc]
    if bad:
        return bad
    try:
        encoder, pipeline = Encoder(**doc["encoder"]), Pipeline(**doc["pipeline"])
    except TypeError as e:
        return [f"encoder or pipeline: {e}"]
    classifier = doc["classifier"]
    bad += compatibility_problems(encoder, pipeline) + [f"classifier: {x}" for x in artifact.validate(classifier)]
    record = (classifier.get("training") or {}).get("document") or {}
    agree = {
        "the digest is not that of encoder and pipeline": doc["feature_identity"] == feature_identity(encoder, pipeline),
        "the classifier's embedding is not that of pooled vectors": canonical_digest(classifier.get("embedding")) == canonical_digest(feature_embedding(encoder)),
        "the classifier was trained on other features": record.get("feature_identity", doc["feature_identity"]) == doc["feature_identity"],
        "the classifier's unit is not the document": record.get("unit", "document") == "document",
        "document heads are linear only": not classifier.get("reference") and not classifier.get("finer") and not any(h.get("features") for h in classifier.get("heads", {}).values()),
    }
    return bad + [why for why, fine in agree.items() if not fine]


def score_vectors(vectors: DataFrame, doc: dict, key: str = "doc_id") -> DataFrame:
    """(key, chunks, error_code, p_<head>): scores of document vectors; all scores of a document or none."""
    heads = [artifact.head_of(n, h) for n, h in doc["classifier"]["heads"].items()]
    p = score(vectors, heads, "embedding")
    odd = F.lit(False)
    for h in heads:
        odd = odd | ~F.coalesce(F.col(f"p_{h.name}").between(0, 1) & ~F.isnan(f"p_{h.name}"), F.lit(False))
    p = p.withColumn("error_code", F.when(F.col("error_code").isNotNull(), F.col("error_code")).when(odd, "INVALID_SCORE"))
    return p.select(key, "chunks", "error_code", *(F.when(F.col("error_code").isNull(), F.col(f"p_{h.name}")).alias(f"p_{h.name}") for h in heads))


def score_documents(documents: DataFrame, doc: dict, embed: Callable[[DataFrame], DataFrame] | None = None, key: str = "doc_id") -> DataFrame:
    """Plan, embed, pool and score documents with a validated artifact."""
    wrong = validate_document_artifact(doc)
    if wrong:
        raise DocumentError("IDENTITY_MISMATCH", "; ".join(wrong))
    return score_vectors(document_vectors(documents, Encoder(**doc["encoder"]), Pipeline(**doc["pipeline"]), embed, key), doc, key)

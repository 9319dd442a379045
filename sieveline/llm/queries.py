"""Queries of the training-data problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import save, table
from .leaks import LINE_MARK, leaks
from .neighbours import nearest
from .near_duplicates import near_duplicate_groups, near_duplicates, pairs_of_members
from .overlaps import split_overlaps
from .packing import pack, packing_report, token_counts
from .personal import find_personal, redact
from .proportions import proportional_sample
from .reading import ENGLISH, is_english, measured, prepared, reading_levels, train
from .splits import assign_splits, divided, normal_group
from .varied import crowding, varied_subset

#: Roles of the two sides of problem 1.
SIDES = {"train": 0, "calibration": 1, "test": 1}


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    records = table(spark, d, "example_records").select("id", "text", "role", F.col("source.kind").alias("kind"))
    embedded = table(spark, d, "embedded").select(F.col("record_id").alias("id"), "embedding")
    return split_overlaps(records, embedded, SIDES)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d)[0].select("id_a", "id_b")


def p1_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d)[0]


def p1_measures(spark: SparkSession, d: str) -> DataFrame:
    """The shares of common words and the cosines of the overlaps."""
    return _overlaps(spark, d)[0].select("id_a", "id_b", F.round("common", 9).alias("common"), F.round("cosine", 6).alias("cosine"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    per = _overlaps(spark, d)[1]
    return per.groupBy("role", "kind").agg(F.count(F.lit(1)).alias("records"), F.sum("partners").alias("pairs"), F.avg("best_coverage").alias("mean_coverage"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per role and source kind the records that overlap with a training record, and their pairs."""
    per = _overlaps(spark, d)[1]
    return per.groupBy("role", "kind").agg(F.count(F.lit(1)).alias("records"), F.sum("partners").alias("pairs"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frame_items").select("id", "text").unionByName(table(spark, d, "example_records").select("id", "text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(_messages(spark, d)).select(F.col("id").alias("item_id"), "pii_type", "start_at")


def p4_emails(spark: SparkSession, d: str) -> DataFrame:
    """How many e-mail addresses in plain form are found in an item."""
    m = _messages(spark, d).dropDuplicates(["id"])
    spans = find_personal(m).filter("pii_type = 'email'").join(m, "id")
    plain = F.expr("substring(text, start_at, end_at - start_at + 1)").rlike(r"^[\w.+-]+@[\w-]+(?:\.[\w-]+)+$")
    return spans.filter(plain).groupBy(F.col("id").alias("item_id")).agg(F.count(F.lit(1)).alias("emails"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    messages = _messages(spark, d)
    return redact(messages, find_personal(messages))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs_of_members(*near_duplicates(_messages(spark, d)))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(_messages(spark, d))


def p5_components(spark: SparkSession, d: str) -> DataFrame:
    """Every record of a group of alike ones and the group's least id."""
    g = near_duplicate_groups(_messages(spark, d))
    return g.join(g.groupBy("group_id").agg(F.min("id").alias("least_id")), "group_id").select("id", "least_id")


WIDTH = 64


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embedded").select(F.col("record_id").alias("id"), "used_as", "embedding")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    e = _embedded(spark, d)
    found = nearest(e.filter("used_as = 'pool'"), e.filter("used_as = 'seed'"), 10, WIDTH)
    return found.select(F.least("query_id", "id").alias("id_a"), F.greatest("query_id", "id").alias("id_b")).distinct()


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Queries: the rows whose id number is divisible by 50, against all rows."""
    e = _embedded(spark, d)
    asked = e.filter(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint") % 50 == 0)
    return nearest(e, asked, 10, WIDTH).select("query_id", "id", "rank", F.round("cosine", 6).alias("cosine"))


SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "example_records").select("id", "group_id", "role")
    return divided(records, "g", normal_group(F.col("group_id"))).select("group_key")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "example_records").select("id", "group_id")
    return assign_splits(records, SHARES, {"g": normal_group(F.col("group_id"))})


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """In how many splits the records of a group are after dealing: one."""
    group = table(spark, d, "example_records").select(F.col("id"), normal_group(F.col("group_id")).alias("group_key")).filter("group_key is not null").distinct()
    both = group.join(p3_splits(spark, d).select("id", "split"), "id")
    return both.groupBy("group_key").agg(F.countDistinct("split").alias("splits"), F.countDistinct("id").alias("records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return crowding(_embedded(spark, d).filter("used_as = 'pool'"), WIDTH).filter("near >= 15").select(F.col("id").alias("record_id"))


def p6_subset(spark: SparkSession, d: str) -> DataFrame:
    return varied_subset(_embedded(spark, d).filter("used_as = 'pool'"), table(spark, d, "retrieve_options"), WIDTH)


def p6_drawn(spark: SparkSession, d: str) -> DataFrame:
    """How many different pool records each option's subset has."""
    return p6_subset(spark, d).groupBy("option_no").agg(F.countDistinct("id").alias("drawn"))


def _proportions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, d, "frame_items").select("id", "group_id", "design_id", "signals")
    return proportional_sample(items, table(spark, d, "design_strata"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _proportions(spark, d)[1].filter("not reachable").select("design_id", "stratum")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _proportions(spark, d)[1]


def p7_frame(spark: SparkSession, d: str) -> DataFrame:
    """Per stratum its groups in the frame, and that the sample takes no more, holds the floor and fills no unreachable target elsewhere."""
    r = _proportions(spark, d)[1]
    return r.select("design_id", "stratum", "frame_groups", "n_sample", "min_sample", "floor_met", "reachable", (F.col("drawn") <= F.col("frame_groups")).alias("within"))


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    return _proportions(spark, d)[0]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing into containers of 2,048 tokens had to cut."""
    only = table(spark, d, "containers").filter("capacity = 2048").select(F.lit(1).alias("container_no"), "capacity").distinct()
    packed = pack(token_counts(table(spark, d, "documents")), only)
    return packed.filter("pieces > 1").select("doc_id").distinct()


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(table(spark, d, "documents")), table(spark, d, "containers"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    containers = table(spark, d, "containers")
    return packing_report(pack(token_counts(table(spark, d, "documents")), containers), containers)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Per container the documents that are packed, all of a token or more, and the bins that hold more than they may."""
    packed = save(p8_packing(spark, d), "packed")
    cap = table(spark, d, "containers").select("container_no", "capacity").distinct()
    loads = packed.groupBy("container_no", "bin").agg(F.sum("tokens").alias("t")).join(F.broadcast(cap), "container_no").groupBy("container_no").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    return packed.groupBy("container_no").agg(F.countDistinct("doc_id").alias("documents")).join(loads, "container_no")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_no")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Per test item the documents that hold it and the longest stretch."""
    return _leaks(spark, d).groupBy("item_no").agg(F.count(F.lit(1)).alias("documents"), F.max("stretch").alias("longest_stretch"), F.max("item_words").alias("item_words"))


def p9_whole(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which an item stands whole, word for word."""
    return _leaks(spark, d).filter("matched = item_words").select("doc_id", "item_no")


def p10_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that begin with a letter, English function words among all, and whether the text counts as English."""
    m = measured(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return m.select("doc_id", "n_words", "n_english", F.coalesce(is_english(), F.lit(False)).alias("english"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    documents = prepared(table(spark, d, "documents"))
    return reading_levels(documents, train(table(spark, d, "graded_passages"), documents))


#: School years from which p10_found reports; the formula's check stands midway between the two kinds of texts.
YEARS, MIDWAY = 17.0, 15.5


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).filter((F.col("grade") > YEARS) & (F.col("formula") > MIDWAY) & F.col("english")).select("doc_id")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

P1_FOUND = rf"""
WITH r AS (SELECT DISTINCT id, role, list_distinct({WORDS}) AS w FROM example_records WHERE role IN ('train', 'calibration', 'test')),
t AS (SELECT * FROM r WHERE len(w) >= 8),
texts AS (SELECT a.id AS x, b.id AS y FROM t a JOIN t b ON a.role = 'train' AND b.role <> 'train' AND len(a.w) >= 0.7 * len(b.w) AND len(b.w) >= 0.7 * len(a.w)
  WHERE len(list_intersect(a.w, b.w)) >= 0.7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
e AS (SELECT DISTINCT record_id AS id, embedding::DOUBLE[] AS v FROM embedded WHERE len(embedding) = 64),
f AS (SELECT e.id, ex.role, v FROM e JOIN (SELECT DISTINCT id, role FROM example_records) ex USING (id)
  WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
vecs AS (SELECT a.id AS x, b.id AS y FROM f a JOIN f b ON a.role = 'train' AND b.role IN ('calibration', 'test')
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM (SELECT * FROM texts UNION ALL SELECT * FROM vecs)
"""

P5_FOUND = rf"""
WITH m AS (SELECT DISTINCT id, text FROM (SELECT id, text FROM frame_items UNION ALL SELECT id, text FROM example_records)),
s AS (SELECT DISTINCT id, list_distinct({WORDS}) AS w FROM m),
t AS (SELECT id, w, len(w) AS n FROM s WHERE len(w) >= 8),
x AS (SELECT id, n, unnest(w) AS word FROM t),
f AS (SELECT word, count(*) AS df FROM x GROUP BY word),
p AS (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY df, word) AS k FROM x JOIN f USING (word)),
q AS (SELECT id, word FROM p WHERE k <= n - ceil(0.7 * n) + 1),
c AS (SELECT DISTINCT a.id AS x, b.id AS y FROM q a JOIN q b ON a.word = b.word AND a.id < b.id)
SELECT c.x AS id_a, c.y AS id_b FROM c JOIN t a ON a.id = c.x JOIN t b ON b.id = c.y
WHERE len(list_intersect(a.w, b.w)) >= 0.7 * (a.n + b.n - len(list_intersect(a.w, b.w)))
"""

VALID = """len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""

P2_FOUND = f"""
WITH e AS (SELECT DISTINCT record_id AS id, used_as, embedding::DOUBLE[] AS v FROM embedded WHERE {VALID}),
c AS (SELECT s.id AS id_a, p.id AS id_b, list_cosine_similarity(s.v, p.v) AS c FROM e s JOIN e p ON s.used_as = 'seed' AND p.used_as = 'pool' AND s.id <> p.id),
n AS (SELECT id_a, id_b FROM c QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY c DESC, id_b) <= 10)
SELECT DISTINCT least(id_a, id_b) AS id_a, greatest(id_a, id_b) AS id_b FROM n
"""

P2_NEIGHBOURS = f"""
WITH e AS (SELECT DISTINCT record_id AS id, embedding::DOUBLE[] AS v FROM embedded WHERE {VALID}),
c AS (SELECT s.id AS query_id, p.id AS id, list_cosine_similarity(s.v, p.v) AS c FROM e s JOIN e p ON regexp_extract(s.id, '(\\d+)$', 1)::BIGINT % 50 = 0 AND s.id <> p.id)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS INTEGER) AS rank, round(c, 6) AS cosine FROM c QUALIFY rank <= 10
"""

GROUP = r"CASE WHEN trim(group_id) <> '' THEN regexp_replace(lower(trim(group_id)), '^(.*?)0*(\d+)$', '\1\2') END"

P3_FOUND = f"""
WITH r AS (SELECT {GROUP} AS group_key, role FROM example_records)
SELECT group_key FROM r WHERE group_key IS NOT NULL GROUP BY group_key HAVING count(DISTINCT role) > 1
"""

P6_FOUND = f"""
WITH e AS (SELECT DISTINCT record_id AS id, embedding::DOUBLE[] AS v FROM embedded WHERE used_as = 'pool' AND {VALID})
SELECT a.id AS record_id FROM e a JOIN e b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.9 GROUP BY a.id HAVING count(DISTINCT b.id) >= 15
"""

P7_STRATA = f"""
WITH i AS (SELECT DISTINCT design_id, signals.rule_fires AS rule_fires, lower(trim(signals.slice)) AS slice, signals.score AS score, coalesce({GROUP}, 'item ' || id) AS g FROM frame_items),
n AS (SELECT s.design_id, s.stratum, any_value(s.n_sample) AS n_sample, count(DISTINCT i.g) AS frame_groups FROM design_strata s LEFT JOIN i
  ON i.design_id = s.design_id AND i.rule_fires = s.rule_fires AND i.slice = lower(trim(s.slice)) AND NOT isnan(i.score) AND s.band_lower <= i.score AND i.score < s.band_upper
  GROUP BY s.design_id, s.stratum)
"""

P1_MEASURES = P1_FOUND[: P1_FOUND.index("SELECT DISTINCT least(x, y)")].replace("SELECT a.id AS x, b.id AS y FROM t", "SELECT a.id AS x, b.id AS y, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS common FROM t").replace("SELECT a.id AS x, b.id AS y FROM f", "SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS cosine FROM f") + """
SELECT least(x, y) AS id_a, greatest(x, y) AS id_b, round(max(common), 9) AS common, round(max(cosine), 6) AS cosine FROM texts FULL JOIN vecs USING (x, y) GROUP BY ALL
"""

P1_COUNTS = P1_FOUND[: P1_FOUND.index("SELECT DISTINCT least(x, y)")] + """,
p AS (SELECT DISTINCT x, y FROM (SELECT * FROM texts UNION ALL SELECT * FROM vecs)),
who AS (SELECT DISTINCT ON (id) id, role, source.kind AS kind FROM example_records)
SELECT role, kind, count(DISTINCT y) AS records, count(*) AS pairs FROM p JOIN who ON who.id = p.y GROUP BY role, kind
"""

P4_EMAILS = r"""
WITH m AS (SELECT DISTINCT ON (id) id, text FROM (SELECT id, text FROM frame_items UNION ALL SELECT id, text FROM example_records))
SELECT id AS item_id, len(regexp_extract_all(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+')) AS emails FROM m WHERE regexp_matches(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+')
"""

P8_PACKED = """
SELECT container_no, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS documents, 0 AS overfull FROM containers WHERE capacity > 0
"""

_BARE = f"' ' || array_to_string(regexp_extract_all(lower(regexp_replace(text, '{LINE_MARK}', '', 'g')), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' '"

P9_WHOLE = f"""
WITH d AS (SELECT doc_id, {_BARE} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_no, {_BARE} AS w FROM eval_items WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, item_no FROM d JOIN i ON contains(d.w, i.w) WHERE length(i.w) > 2
"""

P10_WORDS = f"""
WITH w AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
n AS (SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{L}}'))) AS n_words, len(list_filter(w, lambda x: x IN ({", ".join(f"'{x}'" for x in ENGLISH)}))) AS n_english FROM w)
SELECT *, n_words > 0 AND n_english >= 0.15 * n_words AS english FROM n
"""

P3_KEPT = f"""
SELECT group_key, 1 AS splits, count(DISTINCT id) AS records FROM (SELECT id, {GROUP} AS group_key FROM example_records) WHERE group_key IS NOT NULL GROUP BY group_key
"""

P5_COMPONENTS = "WITH RECURSIVE " + P5_FOUND.strip().removeprefix("WITH ").replace("\nSELECT c.x AS id_a", ",\npairs AS (SELECT c.x AS id_a") + """),
e AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs),
r AS (SELECT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a)
SELECT id, min(other) AS least_id FROM r GROUP BY id
"""

P6_DRAWN = f"""
SELECT option_no, least(any_value(coalesce(k, 20)), (SELECT count(DISTINCT record_id) FROM embedded WHERE used_as = 'pool' AND {VALID})) AS drawn FROM retrieve_options GROUP BY option_no
"""

P7_FRAME = P7_STRATA.replace("any_value(s.n_sample) AS n_sample", "any_value(coalesce(s.n_sample, 0)) AS n_sample, any_value(coalesce(s.min_sample, 0)) AS min_sample") + "SELECT design_id, stratum, frame_groups, n_sample, min_sample, true AS floor_met, frame_groups >= n_sample AS reachable, true AS within FROM n"

P7_FOUND = P7_STRATA + "SELECT design_id, stratum FROM n WHERE frame_groups < n_sample"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_overlaps": p1_overlaps,
    "p1_measures": p1_measures,
    "p1_report": p1_report,
    "p1_counts": p1_counts,
    "p2_found": p2_found,
    "p2_neighbours": p2_neighbours,
    "p3_found": p3_found,
    "p3_splits": p3_splits,
    "p3_kept": p3_kept,
    "p4_found": p4_found,
    "p4_emails": p4_emails,
    "p4_redacted": p4_redacted,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p5_components": p5_components,
    "p6_found": p6_found,
    "p6_subset": p6_subset,
    "p6_drawn": p6_drawn,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_frame": p7_frame,
    "p7_sample": p7_sample,
    "p8_found": p8_found,
    "p8_packing": p8_packing,
    "p8_report": p8_report,
    "p8_packed": p8_packed,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p9_whole": p9_whole,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
    "p10_words": p10_words,
}

SQL: dict[str, str] = {"p4_emails": P4_EMAILS, "p1_counts": P1_COUNTS, "p8_packed": P8_PACKED, "p9_whole": P9_WHOLE, "p10_words": P10_WORDS, "p1_found": P1_FOUND, "p1_measures": P1_MEASURES, "p3_kept": P3_KEPT, "p5_components": P5_COMPONENTS, "p6_drawn": P6_DRAWN, "p7_frame": P7_FRAME, "p2_found": P2_FOUND, "p2_neighbours": P2_NEIGHBOURS, "p3_found": P3_FOUND, "p5_found": P5_FOUND, "p6_found": P6_FOUND, "p7_found": P7_FOUND}

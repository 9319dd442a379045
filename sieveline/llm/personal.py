"""Personal information in free text: labelers vote, expectation-maximisation weighs them, a classifier decides.

Candidates come from open patterns; regex, gazetteer and context labelers vote +, - or 0 on each.  The votes of all
candidates are counted per pattern by Spark; expectation-maximisation over these counts estimates the labelers'
reliabilities, and a logistic model of votes and span features, trained on its posteriors, decides every span.

The name lists and the cues are taken from the texts themselves: names from titles and signatures, cues from the words
that stand before candidates which the first round of the model took or left; the cue is one more labeler of the second.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import save, spread
from .common import ship

TYPES = ("email", "phone", "id_number", "address", "name")
#: Entries of each name list that are kept at most, and the least count of an entry.
GAZETTEER, LEAST = 20_000, 2
#: Cues (the two words before a candidate) of each type that are kept at most, the least count of one, and the log odds from which it votes.
CUES, CUE_LEAST, CUE_ODDS = 20_000, 20, 1.5

# Words of the labelers.
TITLES = "mr mrs ms miss dr prof"
STREETS = "street st road rd avenue ave lane ln drive dr close court ct crescent terrace way place pl square sq boulevard blvd"
UNITS = "unit flat apt apartment suite"
PHONE_CUES = "call|phone|number is|mobile|tel|reach me|ring|dial|ext"
ID_CUES = "ssn|social security|insurance|ni number|passport|identity|id card|tax file|licen[cs]e|national id|personal number"
THINGS = "tracking|ref|reference|order|ord|ticket|barcode|serial|batch|server|parcel|code|version|invoice|item|sku|article"
NAME_BEFORE = "name is|regards|yours|sincerely|contact|spoke with|signed by|this is|card says|attn|ask for|dear"
NAME_AFTER = "handled|promised|told|writing|on the phone|called|said|wrote"

WORD = r"[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)*"
WORDS = re.compile(WORD)
CUE_WORDS = re.compile(r"[^\W\d_]+")
#: Characters before the sign in which an address begins: the local part has at most 64.
LOCAL = 80
EMAIL_SIGN = re.compile(r"\s*@\s*|\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+(?=[\w-]+\s+dot\s)", re.I)
EMAIL_LEFT = re.compile(r"[\w][\w.+-]*$")
EMAIL_RIGHT = re.compile(r"[a-z0-9-]+(?:(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)[a-z0-9-]+)+", re.I)
DIGITS = re.compile(r"[+(\d](?<![\w#$€/+.-].)(?:(?<=\d)|(?<=\+)\d|(?<=\()(?=\d+\))\d)(?:[\d()]|[\s.-]{1,3}(?=[\d(])){5,20}\d(?![\w/-])(?!\.\d)")
CODES = re.compile(r"[A-Za-z](?<![\w#$€/-].)[A-Za-z]?-?\s{0,2}\d(?:[\s-]{0,2}\d){4,9}(?:-?[A-Za-z]{1,2}|\s{1,2}[A-Da-d])?(?![\w-])")
ADDRESS = re.compile(rf"[0-9](?<![\w/.,$€-].)[0-9]{{0,4}}[A-Za-z]?(?:(\s*[,/-]\s*|\s+)([0-9]{{1,5}}[A-Za-z]?))?\s+(?:{WORD}\s+){{1,4}}?(?:{'|'.join(STREETS.split())})(?![\w'’])", re.I)
UNIT = re.compile(rf"(?<![\w'’])(?:{'|'.join(UNITS.split())})\s+$", re.I)
BEFORE = tuple(NAME_BEFORE.split("|")) + tuple(TITLES.split())
AFTER = tuple(NAME_AFTER.split("|"))
ACTING = re.compile(r"(?<![\w'’-])([^\W\d_a-z][\w'’]+)(?:\s+[^\W\d_]\.?)?\s+([^\W\d_a-z][\w'’]*(?:-[^\W\d_][\w'’]*)*)\s+$")
NAMED = re.compile(rf"\.?[,:]?\s+({WORD})(?:\s+[^\W\d_]\.?)?\s+({WORD})")
FOLLOWING = re.compile(rf"(?:\s+[^\W\d_]\.?)?\s+({WORD})")

PHONE_SHAPES = re.compile(
    r"\+\d{10,13}|\+\d{1,3}(?:[\s.-]+\(?\d{2,4}\)?){2,4}|\+\d{2}\s+\d{4}\s+\d{6}|\(0\d\)\s*\d{4}\s+\d{4}|\(\d{3}\)\s*\d{3}[\s.-]+\d{4}|0\d{4}\s+\d{6}|0\d{4}\s+\d{3}\s+\d{3}|04\d\d\s+\d{3}\s+\d{3}|0\d\s+\d{4}\s+\d{4}|00\d\d-\d{4}-\d{6}|\d{3}([\s.-]+)\d{3}\1\d{4}"
)
ID_SHAPES = re.compile(r"\d{3}([\s-]+)\d{2}\1\d{4}|[a-z]{2}\s*\d{2}\s*\d{2}\s*\d{2}\s*[a-d]|[a-z]{2}\d{7}|[a-z]\d{8}[a-z]|dl-\d{5}-[a-z]{2}", re.I)
NINE = re.compile(r"\d{3}\s+\d{3}\s+\d{3}")
CUE = {k: re.compile(rf"(?<![a-z])(?:{v})(?![a-z])", re.I) for k, v in (("phone", PHONE_CUES), ("id", ID_CUES), ("thing", THINGS), ("title", TITLES.replace(" ", "|")), ("before", NAME_BEFORE), ("after", NAME_AFTER))}
PLACE = re.compile(r"^,?\s*(?:,\s*)?(?:[A-Z][a-z]+\s*)?", re.I)
ADDRESS_CUE = re.compile(r"(?:live at|moved to|send it to|went to|address|instead of|ship|deliver\w*|,)\W*$", re.I)

STRONG = r"(?:\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?|name is|egards,?|Yours,|Contact:|spoke with|signed by|card says)\s+(\p{Lu}[\p{L}'’]+)(?:\s+\p{Lu}\.?)?\s+(\p{Lu}[\p{L}'’]*(?:-\p{Lu}[\p{L}'’]*)*)"


def gazetteers(texts: DataFrame) -> tuple[list[str], list[str]]:
    """Given and family names that stand after titles and signatures, counted over all texts; at most GAZETTEER each."""
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(STRONG), F.lit(0))).alias("m"))
    both = found.select(F.explode(F.array(*(F.struct(F.lit(g).alias("g"), F.lower(F.regexp_extract("m", STRONG, g)).alias("w")) for g in (1, 2)))).alias("x")).groupBy("x.g", "x.w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST)
    top = Window.partitionBy("g").orderBy(F.desc("n"), "w")
    rows = both.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= GAZETTEER).orderBy("g", "_r").collect()
    return [r.w for r in rows if r.g == 1], [r.w for r in rows if r.g == 2]


class Labelers:
    """Candidates of a text with the votes of the labelers of their type."""

    def __init__(self, given: list[str], family: list[str]):
        self.given, self.family = frozenset(given), frozenset(family)

    def _given_at(self, low: str) -> Iterator[tuple[int, int]]:
        """Places of listed given names."""
        for m in WORDS.finditer(low) if self.given else ():
            if m.group() in self.given:
                yield m.span()

    def spans(self, text: str) -> list[tuple[str, int, int, str, str]]:
        """(type, start, end, votes, features) with 0-based code points; a span may come for several types."""
        out: dict[tuple[str, int], tuple[int, str, str]] = {}
        taken: list[tuple[int, int]] = []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower()[:1] or c for c in text)
        if "@" in low or "at)" in low or "at]" in low or " dot " in low:
            for m in EMAIL_SIGN.finditer(text):
                a, b = EMAIL_LEFT.search(text, max(0, m.start() - LOCAL), m.start()), EMAIL_RIGHT.match(text, m.end())
                if a and b:
                    votes = self._email(text, a.start(), b.end(), m.group())
                    out["email", a.start()] = (b.end(), votes, "d" if "." in b.group() else "w")
                    taken.append((a.start(), b.end()))
        for m in DIGITS.finditer(text):
            self._number(text, m.start(), m.end(), out)
        for m in CODES.finditer(text):
            head = re.match(r"[a-z]+", m.group(), re.I).group()
            if ID_SHAPES.fullmatch(m.group()) or m.group()[len(head)] in "-0123456789":
                for kind in ("phone", "id_number"):  # its digits alone are no candidate
                    for x in [x for k, x in out if k == kind and m.start() < x < m.end()]:
                        del out[kind, x]
                self._number(text, m.start(), m.end(), out)
        for m in ADDRESS.finditer(text):
            at, unit = m.start(), UNIT.search(text, max(0, m.start() - 14), m.start())
            if unit:
                at = unit.start()
            elif m.group(2) and "/" not in m.group(1) and "-" not in m.group(1):
                at = m.start(2)  # an unrelated number stands before
            left = text[max(0, at - 24) : at]
            body = re.findall(WORD, m.group())
            upper = all(w[:1].isupper() for w in body)
            lower = all(w.islower() for w in body)
            right = text[m.end() : m.end() + 24]
            votes = ("+" if unit else "0") + ("+" if ADDRESS_CUE.search(left) else "0") + ("+" if upper or lower else "-") + ("-" if re.search(r"(?:gate|platform|level|floor|room|page|step|clause)\s*$", left, re.I) else "0")
            votes += "+" if re.match(r"\s*[,.]|\s*$|\s+(?:last|instead)|\s*\n", right) else "-"
            out["address", at] = (m.end(), votes, str(min(len(body), 5)))
        for a, b in self._given_at(low):
            if (a == 0 or not (text[a - 1].isalnum() or text[a - 1] in "_.@-'’")) and (b == len(text) or not (text[b].isalnum() or text[b] in "_-'’")):
                m = FOLLOWING.match(text, b)
                if m:
                    self._name(text, a, m.end(), low[a:b], m.group(1), out, taken)
        for cue in BEFORE:
            i = low.find(cue)
            while i >= 0:
                if i == 0 or not low[i - 1].isalnum():
                    m = NAMED.match(text, i + len(cue))
                    if m:
                        self._name(text, m.start(1), m.end(2), m.group(1).lower(), m.group(2), out, taken)
                i = low.find(cue, i + 1)
        for cue in AFTER:
            i = low.find(cue)
            while i >= 0:
                m = ACTING.search(text, max(0, i - 80), i) if text.startswith(cue, i) else None
                if m:
                    self._name(text, m.start(1), m.end(2), m.group(1).lower(), m.group(2), out, taken)
                i = low.find(cue, i + 1)
        return [(k, a, b, votes, features) for (k, a), (b, votes, features) in out.items()]

    @staticmethod
    def _email(text: str, a: int, b: int, sign: str) -> str:
        span = text[a:b]
        votes = "+" if re.fullmatch(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", span) else "0"
        votes += "+" if re.search(r"[\w-]{2,}(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)[a-z]{2,}$", span, re.I) else "-"
        votes += "+" if re.search(r"(?:reach me at|write to|mail is|went to|and to|login|mailto:|e-?mail|contact\W.*,)\W*$|[<(]$", text[max(0, a - 40) : a], re.I) else "0"
        return votes + ("+" if re.search(r"[@\[(]", sign) or re.search(r"\bdot\b", span, re.I) else "0")

    @staticmethod
    def _number(text: str, a: int, b: int, out: dict) -> None:
        span = text[a:b]
        digits = sum(c.isdigit() for c in span)
        letters = any(c.isalpha() for c in span)
        left = text[max(0, a - 34) : a]
        cut = max(left.rfind(". "), left.rfind("! "), left.rfind("? "), left.rfind("\n"))
        near = left[cut + 1 :] if cut >= 0 and not re.search(r"no\.\s*$", left[: cut + 2], re.I) else left
        thing = bool(CUE["thing"].search(near[-16:]))
        phone, ident = bool(CUE["phone"].search(near)), bool(CUE["id"].search(near))
        after = bool(re.match(r"\s*,?\s*ext|[.,\s]*$|\n", text[b : b + 12], re.I))
        bins = f"{digits}{'a' if letters else 'n'}"
        shape = bool(PHONE_SHAPES.fullmatch(span))
        if not letters and 7 <= digits <= 14 and (shape or not ident):
            votes = ("+" if shape else "-") + ("+" if phone else "0") + ("-" if thing else "0") + ("-" if ident else "0") + ("+" if after else "0") + ("+" if re.search(r"(?:,|\n)\s*$", left) and shape else "0")
            out["phone", a] = (b, votes, bins)
        if (5 if letters else 6) <= digits <= 12 and not (shape and phone and not ident):
            own, nine = bool(ID_SHAPES.fullmatch(span)), bool(NINE.fullmatch(span))
            votes = ("+" if own else "0" if nine else "-") + ("+" if ident else "-" if nine else "0") + ("-" if thing else "0") + ("-" if phone and not ident else "0") + ("-" if shape and not own else "0") + ("+" if ident and re.search(r"(?:is|:|\(|no\.?|number|passport|card|ssn|licen[cs]e)\s*\(?$", near.rstrip() + ("(" if near.endswith("(") else ""), re.I) else "0")
            out["id_number", a] = (b, votes, bins)

    def _name(self, text: str, a: int, b: int, first: str, last: str, out: dict, taken: list) -> None:
        if ("name", a) in out or any(x < b and a < y for x, y in taken):
            return
        left, right = text[max(0, a - 16) : a], text[b : b + 16]
        title = bool(re.search(rf"(?<![a-z])(?:{TITLES.replace(' ', '|')})\.?\s+$", left, re.I))
        before = bool(re.search(rf"(?<![a-z])(?:{NAME_BEFORE})[,:]?\s+$", left, re.I))
        after = bool(re.match(rf"\s+(?:{NAME_AFTER})\b|,\s|\.|\n|\s*$", right, re.I))
        f, l = text[a : a + len(first)], last
        shape = "+" if f[:1].isupper() and l[:1].isupper() else "0" if f.islower() == l.islower() else "-"
        listed = lambda w, names: "+" if w in names else "-" if names else "0"
        votes = listed(first, self.given) + listed(last.lower().rstrip("'’"), self.family) + ("+" if title else "0") + ("+" if before else "0") + ("+" if after else "0") + shape
        out["name", a] = (b, votes, "U" if f.isupper() else "T" if f[:1].isupper() else "l")


def candidates(texts: DataFrame, labelers: Labelers) -> DataFrame:
    """(id, pii_type, start_at, end_at, votes, features, cue) of every candidate of the whole texts; start_at is 1-based."""
    get = ship(texts.sparkSession, labelers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = get().spans
        for b in batches:
            ids, rows, cues = [], [], []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                if t:
                    got = find(t)
                    rows += got
                    ids += [i] * len(got)
                    cues += [" ".join(CUE_WORDS.findall(t[max(0, g[1] - 24) : g[1]].lower())[-2:]) for g in got]
            kind, start, end, votes, features = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(kind, pa.string()), pa.array([s + 1 for s in start], pa.int64()), pa.array(end, pa.int64()), pa.array(votes, pa.string()), pa.array(features, pa.string()), pa.array(cues, pa.string())],
                names=["id", "pii_type", "start_at", "end_at", "votes", "features", "cue"],
            )

    rows = spread(texts.select(F.col("id").cast("string").alias("id"), "text").filter(F.col("id").isNotNull() & F.col("text").isNotNull()))
    return rows.mapInArrow(run, "id string, pii_type string, start_at long, end_at long, votes string, features string, cue string")


def reliabilities(votes: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior, tables, share) by expectation-maximisation of a two-class model with votes in {-1, 0, 1}.

    tables[c, labeler, vote + 1] are the vote probabilities of class c.  The start is the balance of votes; labelers
    are held to be better than chance by pseudo-counts in their favour.
    """
    n, m = votes.shape
    post = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    favour = np.array([[3.0, 1.0, 0.5], [0.5, 1.0, 3.0]])
    share = 0.5
    table = np.zeros((2, m, 3))
    for _ in range(rounds):
        for c, p in ((1, post), (0, 1 - post)):
            for v in range(3):
                table[c, :, v] = ((votes == v - 1) * (p * count)[:, None]).sum(0) + favour[c, v]
            table[c] /= table[c].sum(1, keepdims=True)
        share = float(np.clip((post * count).sum() / max(count.sum(), 1e-9), 0.01, 0.99))
        at = np.arange(m)
        like = np.stack([np.log(table[c][at, votes + 1]).sum(1) for c in (0, 1)], 1) + np.log([1 - share, share])
        post = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
    return post, table, share


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Weights of a ridge logistic model with soft targets, by Newton's method."""
    beta = np.zeros(x.shape[1])
    w = w / w.sum() * len(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge * beta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(patterns: list[tuple[str, str, str, int]]) -> list[tuple[str, str, str, float]]:
    """(type, votes, features, probability) of every pattern from (type, votes, features, count)."""
    out = []
    for kind in TYPES:
        own = [p for p in patterns if p[0] == kind]
        if not own:
            continue
        votes = np.array([[{"-": -1, "0": 0, "+": 1}[c] for c in p[1]] for p in own])
        count = np.array([p[3] for p in own], float)
        post, _, _ = reliabilities(votes, count)
        bins = sorted({p[2] for p in own})
        x = np.concatenate([np.ones((len(own), 1)), votes == 1, votes == -1, np.array([[p[2] == b for b in bins] for p in own])], 1).astype(float)
        beta = logistic(x, post, np.sqrt(count))
        prob = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        out += [(k, v, f, float(q)) for (k, v, f, _), q in zip(own, prob)]
    return out


def scored(found: DataFrame) -> DataFrame:
    """Candidates with the probability of their pattern of votes and features."""
    patterns = found.groupBy("pii_type", "votes", "features").agg(F.count(F.lit(1)).alias("n")).collect()  # votes and bins: bounded by their number
    model = fit([(r.pii_type, r.votes, r.features, r.n) for r in sorted(patterns)])
    prob = found.sparkSession.createDataFrame(model, "pii_type string, votes string, features string, probability double")
    return found.join(F.broadcast(prob), ["pii_type", "votes", "features"])


def context_cues(rated: DataFrame) -> DataFrame:
    """(pii_type, cue, vote): cues whose candidates were taken far more, or far less, often than those of the type; at most CUES of a type."""
    taken = F.sum("probability")
    every = rated.groupBy("pii_type").agg((taken / F.count(F.lit(1))).alias("share"))
    cues = rated.filter("cue <> ''").groupBy("pii_type", "cue").agg(taken.alias("s"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CUE_LEAST)
    odds = F.log((F.col("s") + F.col("share")) / (F.col("n") - F.col("s") + 1 - F.col("share"))) - F.log((F.col("share") + 1e-6) / (1 - F.col("share") + 1e-6))
    voted = cues.join(F.broadcast(every), "pii_type").withColumn("vote", F.when(odds > CUE_ODDS, "+").when(odds < -CUE_ODDS, "-")).filter("vote is not null")
    top = Window.partitionBy("pii_type").orderBy(F.desc("n"), "cue")
    return voted.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= CUES).select("pii_type", "cue", "vote")


def find_personal(texts: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, pii_type, start_at, end_at, probability): the accepted spans, 1-based and inclusive, in code points.

    texts: id, text; further columns are ignored.  Null and empty texts have none; rows delivered twice count once.
    Of the types of one start the most probable stays.
    """
    found = save(candidates(texts, Labelers(*gazetteers(texts))), "personal-candidates")
    cued = found.join(F.broadcast(context_cues(scored(found))), ["pii_type", "cue"], "left").withColumn("votes", F.concat("votes", F.coalesce("vote", F.lit("0")))).drop("vote")
    kept = scored(cued).filter(F.col("probability") >= least)
    first = Window.partitionBy("id", "start_at").orderBy(F.desc("probability"), F.desc("end_at"), "pii_type")
    return kept.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("id", "pii_type", "start_at", "end_at", "probability")


def redact(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, text, redacted, found): every text with its spans replaced by typed placeholders such as [EMAIL].

    Of overlapping spans the one that begins first (then the longer) is replaced.  Texts without spans and null texts
    come back unchanged; rows delivered twice count once.
    """
    marks = spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start_at", (-F.col("end_at")).alias("e"), "pii_type"))).alias("marks"))  # spans of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, found = [], []
            for t, marks in zip(b.column("text").to_pylist(), b.column("marks").to_pylist()):
                at, parts, n = 0, [], 0
                for m in marks or ():
                    if t is not None and m["start_at"] - 1 >= at:
                        parts += [t[at : m["start_at"] - 1], f"[{m['pii_type'].upper()}]"]
                        at, n = -m["e"], n + 1
                done.append(None if t is None else "".join(parts) + t[at:])
                found.append(n)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), pa.array(done, pa.string()), pa.array(found, pa.int32())], names=["id", "text", "redacted", "found"])

    rows = texts.select(F.col("id").cast("string").alias("id"), "text").dropDuplicates(["id"])
    return rows.join(marks, "id", "left").mapInArrow(run, "id string, text string, redacted string, found int")

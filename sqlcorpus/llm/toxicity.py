"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration.

The learning rows are dealt by a hash of the id into three parts: the lexicon is learned on the first,
the trees on the second, the calibration on the third, so that no part scores its own rows. A lexicon
entry is a word or the first 4 to 6 letters of words, as several languages bend one stem. Fitting uses
at most about ``FIT_ROWS`` labelled rows (hash sampling by id); scoring reads every whole text.

Features use the text only: lexicon densities, also after undoing obfuscation (digits for letters, marks
within words), closeness of second-person words to lexicon hits, capitals, punctuation, obfuscated words
and length.

Defined cases: null and empty texts are scored like any other (all features zero); without labels of
both classes in the second part, or with an empty lexicon, every score is the share of toxic labels (0
without labels); without labels of both classes in the third part the trees' own probability is the score;
rows with a null label or id are not learned from; further columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlcorpus.llm.common import free_name, released, unused
from sqlcorpus.session import stage

#: Bounds of what is learned: labelled rows, lexicon entries, trees and their depth.
FIT_ROWS = 30_000
LEXICON = 500
TREES = 12
DEPTH = 3
#: An entry's share of toxic texts is, at a bound of so many standard errors, so many times that of clean ones.
LIFT = 4.0
ERRORS = 2.2
STRONG = 0.6
STEMS = (4, 5, 6)
#: Words between a lexicon hit and a second-person word that count as close.
NEAR = 5
#: FIXED VALUES: second-person words of English, German, French and Spanish.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros"
)
#: FIXED VALUES: characters that stand for letters in obfuscated words.
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = (
    "strong_rate strong_log strong_distinct lexicon_rate deobfuscated_rate near_second_person second_person_rate capital_rate "
    "capital_word_rate punctuation_rate exclamation_rate obfuscation_rate words_log"
).split()


def _terms(text: Column) -> Column:
    """Distinct words (longer than two letters) and stems of a text."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) > 2))

    def stems(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    return F.array_distinct(F.concat(words, *map(stems, STEMS)))


def learn_lexicon(rows: DataFrame) -> list[tuple[str, bool]]:
    """(entry, strong) of the entries that mark toxic texts; ``rows``: ``text, toxic``.

    Copies of a text count once. Strong entries have a log lift of at least STRONG times the greatest.
    """
    rows = rows.dropDuplicates(["text"])
    totals = rows.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals.t or 0, totals.n - (totals.t or 0)
    if not toxic or not clean:
        return []
    lift = F.log(((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1)))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    entries = (
        rows.select("toxic", F.explode(_terms(F.col("text"))).alias("term"))
        .groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .withColumn("lift", lift - ERRORS * error).where(F.col("lift") >= F.log(F.lit(LIFT)))
        .orderBy(F.desc("lift"), "term").limit(LEXICON)
    )
    found = entries.collect()
    return [(r.term, r.lift >= STRONG * found[0].lift) for r in found]


def feature_udf(lexicon: list[tuple[str, bool]]):
    """A pandas UDF from texts to the array of FEATURES; the lexicon has at most LEXICON entries."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import math
        import re

        whole = {t: 1 if strong else 16 for t, strong in lexicon if not t.endswith("*")}
        stems = {t[:-1]: 1 if strong else 16 for t, strong in lexicon if t.endswith("*")}
        sizes = sorted({len(s) for s in stems})
        person = set(SECOND_PERSON.split())
        token, mark = re.compile(r"\S+"), re.compile(r"[^\W\d_]")
        alike = str.maketrans(LOOK_ALIKES)
        edges = "".join(map(chr, range(33, 48))) + ":;<=>?[\\]^_`{|}~…«»“”„’‘¡¿"
        upper = bytes(range(65, 91))
        punctuation = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
        known: dict[str, bool] = {}

        def listed(word):
            found = whole.get(word, 0)
            for n in sizes:
                if len(word) > n:
                    found |= stems.get(word[:n], 0)
            return found

        def kind(raw):
            """bits of a token: 1 strong entry, 16 other entry, 2 strong after undoing obfuscation, 4 second person, 8 obfuscated"""
            word = raw.strip(edges).lower()
            if word.isalpha():
                return listed(word) | 4 * (word in person)
            plain = "".join(c for c in word.translate(alike) if mark.match(c))
            hidden = bool(len(plain) > 2 and mark.match(word) and "-" not in word)
            parts = re.split(r"[^\w]+", word)
            found = 0
            for p in parts:
                found |= listed(p)
            return found | 2 * (hidden and listed(plain) & 1) | 4 * any(p in person for p in parts) | 8 * hidden

        def one(text):
            raws = token.findall(text) if text else []
            n = len(raws)
            if not n:
                return [0.0] * len(FEATURES)
            kinds = []
            for r in raws:
                k = known.get(r)
                if k is None:
                    if len(known) > 100_000:
                        known.clear()
                    k = known[r] = int(kind(r))
                kinds.append(k)
            hits = [i for i, k in enumerate(kinds) if k & 3]
            persons = [i for i, k in enumerate(kinds) if k & 4]
            near, j = 0, 0
            for i in hits:
                while j < len(persons) and persons[j] < i - NEAR:
                    j += 1
                near += j < len(persons) and persons[j] <= i + NEAR
            data = text.encode("utf-8", "replace")
            size = len(data)
            capitals = size - len(data.translate(None, upper))
            marks = size - len(data.translate(None, punctuation))
            return [
                len(hits) / n, math.log1p(len(hits)), float(len({raws[i].strip(edges).lower() for i in hits})),
                sum(1 for k in kinds if k & 17) / n, sum(1 for i in hits if kinds[i] & 2) / n, near / max(1, len(hits)), len(persons) / n, capitals / size,
                sum(r.isupper() and len(r) > 1 for r in raws) / n, marks / size, data.count(b"!") / n,
                sum(1 for k in kinds if k & 8) / n, math.log1p(n),
            ]

        for texts in batches:
            yield pd.Series([one(None if pd.isna(t) else t) for t in texts])

    return F.pandas_udf(released(of), "array<double>")


class ToxicityModel:
    """A fitted lexicon, ensemble and calibration; ``prior`` alone where nothing could be fitted."""

    def __init__(self, prior: float, lexicon=(), trees=None, calibration=None):
        self.prior, self.lexicon, self.trees, self.calibration = prior, list(lexicon), trees, calibration

    def score(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with a column ``name`` between 0 and 1; ``name`` must be free."""
        unused(docs, name)
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.prior))
        inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        text = F.col(f"c{docs.columns.index(text_col)}").cast("string")
        raw = _raw(self.trees, inner.withColumn("features", array_to_vector(feature_udf(self.lexicon)(text))))
        scored = self.calibration.transform(raw) if self.calibration else raw.withColumn("calibrated", F.col("raw_score"))
        scored = scored.withColumn("_score", F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0)))
        return scored.select(*inner.columns, "_score").toDF(*docs.columns, name)


def _raw(trees, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn("raw_score", vector_to_array("probability")[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on the labelled rows of ``docs`` (a document with several labels is toxic if one is)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col(label_col).cast("int")).alias("toxic"))
    n = known.count()
    part = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1_000_000))
    sampled = known.where(part < int(1_000_000 * min(1.0, rows / max(1, n))))
    learn = stage(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(sampled, "_id")
        .withColumn("part", F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(5))), "toxicity-fit")
    counts = {(r.third, r.toxic): r["count"] for r in learn.groupBy(F.expr("int(part / 2)").alias("third"), "toxic").count().collect()}
    total = sum(counts.values())
    prior = sum(v for (_, y), v in counts.items() if y == 1) / total if total else 0.0
    lexicon = learn_lexicon(learn.where("part < 2"))
    if not lexicon or not counts.get((1, 0)) or not counts.get((1, 1)):
        return ToxicityModel(prior)
    features = stage(
        learn.where("part >= 2").select("part", F.col("toxic").cast("double").alias("label"), feature_udf(lexicon)(F.col("text")).alias("f")),
        "toxicity-features").withColumn("features", array_to_vector("f"))
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=42).fit(
        features.where("part < 4").coalesce(4))
    if not counts.get((2, 0)) or not counts.get((2, 1)):
        return ToxicityModel(prior, lexicon, trees)
    held = _raw(trees, features.where("part = 4"))
    calibration = IsotonicRegression(featuresCol="raw_score", labelCol="label", predictionCol="calibrated").fit(
        held.select("raw_score", "label").coalesce(1))
    return ToxicityModel(prior, lexicon, trees, calibration)


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` when divided by ``folds``; a null id is held out never."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(folds)) == fold, F.lit(False))


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents scored below ``threshold``, with their own columns."""
    name = free_name(docs, "score")
    return model.score(docs, text_col, name).where(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])

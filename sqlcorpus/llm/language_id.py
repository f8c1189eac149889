"""Language identification: multinomial naive Bayes over hashed character n-grams.

Runs of letters are framed by blanks and lower-cased; every 1- to 4-gram of the frame is hashed to one of
``BUCKETS`` buckets. Fitting counts the buckets of each language over at most about ``FIT_ROWS`` rows of
a language (hash sampling by id) of every language; the log-probability matrix, ``BUCKETS`` x languages
floats, is broadcast in blocks of at most ``LANGUAGES`` languages. Scoring reads every whole text once: its
distinct bucket counts meet the blocks one after the other in numpy, and the best over all blocks is taken.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with nothing to learn from
every other text is ``und`` as well; rows with a null language or id are not learned from; ties go to the
language that sorts first; further columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcorpus.llm.common import unused
from sqlcorpus.session import stage

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
FIT_ROWS = 20_000
#: Languages of one broadcast block (64 MB); a task holds one block at a time.
LANGUAGES = 256
#: Bucket counts of texts that wait for the blocks at once.
HELD = 1 << 21
#: Letters of a text that are hashed at once.
BLOCK = 1 << 20
UNKNOWN = "und"
PREDICTION = "struct<lang_pred:string,score:double>"


def _codes(text: str) -> np.ndarray:
    """Code points of the text, lower-cased, with every run of other characters than letters as one blank."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else None
    if kept is None:
        data = np.frombuffer(text.lower().encode(), dtype=np.uint8)
        codes = np.where((data >= 97) & (data <= 122), data, 32).astype(np.uint32)
    else:
        codes = np.frombuffer(kept.encode("utf-32-le", "replace"), dtype="<u4")
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    return codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]


def bucket_counts(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets of a text's n-grams and their counts; empty without a letter."""
    codes = _codes(text) if text else np.empty(0, np.uint32)
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    parts = []
    for at in range(0, len(codes), BLOCK):
        block = codes[at : at + BLOCK + max(ORDERS) - 1].astype(np.uint64)
        for n in ORDERS:
            size = min(BLOCK, len(block) - n + 1)
            if size < 1:
                continue
            h = np.full(size, n, dtype=np.uint64)
            for i in range(n):
                h = (h ^ block[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            if n == 1:
                h = h[block[:size] != 32]
            parts.append((h & np.uint64(buckets - 1)).astype(np.int64))
    if len(codes) < 4096:
        return np.unique(np.concatenate(parts), return_counts=True)
    dense = np.bincount(np.concatenate(parts), minlength=buckets)
    found = np.flatnonzero(dense)
    return found, dense[found]


def _counter(buckets: int):
    def flushed(sums: dict) -> Iterator[pd.DataFrame]:
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                at, n = bucket_counts(None if pd.isna(text) else text, buckets)
                if lang not in sums and len(sums) == LANGUAGES:
                    yield from flushed(sums)
                    sums.clear()
                sums.setdefault(lang, np.zeros(buckets, np.int64))[at] += n
        yield from flushed(sums)

    return count


def _released(block):
    """The value of a broadcast, which is read from its file again the next time, so that one block is held at once."""
    value = block.value
    if getattr(block, "_path", None):
        block.__dict__.pop("_value", None)
    return value


class LanguageModel:
    """Broadcast blocks of languages (sorted over all blocks), the log probabilities (buckets x languages) of their
    n-gram buckets, and log priors."""

    def __init__(self, blocks: list, buckets: int):
        self.blocks, self.buckets = blocks, buckets

    def predict(self, docs: DataFrame, text_col: str = "text", name: str = "language") -> DataFrame:
        """``docs`` with a struct ``name`` (which must be free) of ``lang_pred`` and ``score``, the posterior of that language."""
        unused(docs, name)
        shared, buckets = self.blocks, self.buckets

        def best_of(counts, found):
            """Take the best over all blocks: ``found`` is filled with (language, its log, sum of exp(log - its log))."""
            for block in shared:
                languages, matrix, priors = block.value if len(shared) == 1 else _released(block)
                for i, (at, n) in counts:
                    logs = priors + n.astype(np.float64) @ matrix[at]
                    k = int(np.argmax(logs))
                    new = languages[k], logs[k], np.exp(logs - logs[k]).sum()
                    if i in found:
                        old = found[i]
                        top = new if new[1] > old[1] else old
                        new = top[0], top[1], old[2] * np.exp(old[1] - top[1]) + new[2] * np.exp(new[1] - top[1])
                    found[i] = new

        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                found, counts, held = {}, [], 0
                for i, text in enumerate(texts):
                    at, n = bucket_counts(None if pd.isna(text) else text, buckets)
                    if len(at):
                        counts.append((i, (at, n)))
                        held += len(at)
                    if held > HELD:
                        best_of(counts, found)
                        counts, held = [], 0
                best_of(counts, found)
                rows = [(found[i][0], float(1 / found[i][2])) if i in found else (UNKNOWN, 0.0) for i in range(len(texts))]
                yield pd.DataFrame(rows, columns=["lang_pred", "score"])

        return docs.withColumn(name, F.pandas_udf(score, PREDICTION)(F.col(text_col).cast("string")))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, buckets: int = BUCKETS) -> LanguageModel:
    """Learn from the rows of ``docs`` that have a language, an id and a text."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = stage(known.groupBy("lang").count(), "languages")
    number = {r["lang"]: r["count"] for r in sizes.toLocalIterator()}
    if not number:
        return LanguageModel([], buckets)
    part = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1_000_000))
    share = (1_000_000 * F.least(F.lit(1.0), F.lit(rows) / F.col("count"))).cast("int")
    chosen = known.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where(part < F.col("share"))
    counts = chosen.select("lang", "text").mapInPandas(_counter(buckets), "lang string, bucket long, n long")
    counts = stage(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    languages, blocks = sorted(number), []
    for start in range(0, len(languages), LANGUAGES):
        block = languages[start : start + LANGUAGES]
        place = {x: i for i, x in enumerate(block)}
        totals = np.zeros((buckets, len(block)))
        # at most BUCKETS x LANGUAGES counts, read in parts
        for r in counts.where(F.col("lang").isin(block)).toLocalIterator():
            totals[r["bucket"], place[r["lang"]]] = r["n"]
        matrix = np.log((totals + 0.5) / (totals.sum(axis=0) + 0.5 * buckets)).astype(np.float32)
        priors = np.log(np.array([number[x] for x in block]) / sum(number.values()))
        blocks.append(docs.sparkSession.sparkContext.broadcast((block, matrix, priors)))
        if len(languages) > LANGUAGES:
            _released(blocks[-1])
    return LanguageModel(blocks, buckets)

"""The audit of sources against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from sqlcorpus.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, docs bigint, total string, code string, _v string"


def rows_of():
    random.seed(11)
    words = [f"W{'abcdefghijklmnopqrstuvwxyz'[i]}ört" for i in range(26)] + ["straße", "東京", "É", "é", "x"]
    rows = []
    for i in range(260):
        n = random.choice([0, 1, 5, 40])
        text = random.choice([" ", "-", "1", "\n", "\x00", "~"]).join(random.choices(words, weights=range(1, len(words) + 1), k=n))
        rows.append((i, random.choice([text, text.upper(), text]), random.choice(["en", "en", "de", None]), random.choice(["a", "b", "Z", "é", None, "a a"])))
    rows += [(1, None, "en", "onlynull"), (2, "", "fr", "alone"), (3, "rare words here", "it", "a"), (4, "rare words", "it", "b"), (4, "rare words", "it", "b")]
    rows += [(5, "long tail " * 30_000, "en", "a"), (None, "Xx yy", None, None)]
    return rows


def slow(rows, min_docs, top):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = {s: c for (x, s), c in groups.items() if x == lang}

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(sum(own.values(), Counter()))
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize("tile,counts,cells,size,flush", [(1024, 2_000_000, 4_000_000, 1 << 24, 2_000_000), (2, 20, 7, 900, 50)])
def test_audit(spark, monkeypatch, tile, counts, cells, size, flush):
    for name, value in (("TILE", tile), ("SHARD_COUNTS", counts), ("CELLS", cells), ("SLICE_BYTES", size), ("FLUSH", flush)):
        monkeypatch.setattr(divergence, name, value)
    rows = rows_of()
    df = spark.createDataFrame([(*r, 1, 2, "t", "c", "v") for r in rows], SCHEMA).repartition(3)
    for min_docs, top in ((30, 50), (3, 4), (1000, 50)):
        got = divergence.audit(df, min_docs=min_docs, top=top)
        assert sorted(map(tuple, got.collect())) == slow(rows, min_docs, top)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    counts = [(0, 10**13, 7), (10**13, 10**13 + 3, 9), (987_654_321_987, 5 * 10**12, 10**8)]
    df = spark.createDataFrame(counts, "c bigint, n bigint, v bigint").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v) for r in df.collect())

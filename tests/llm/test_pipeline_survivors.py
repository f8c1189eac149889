"""run() on a small corpus with nulls, repeated ids and planted copies: the rows that stay after every stage, and the pieces."""

import re
import zlib
from array import array
from collections import Counter, defaultdict

import corpus_pipeline
import xxhash
from sqlcorpus.llm import queries
from sqlcorpus.llm.common import table


def words(mark, n=60):
    return [f"{i}{mark}" for i in range(n)]


def fingerprint(text):
    own = (text or "").encode().lower().split()
    shingles = [b" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - 2**64 if value >> 63 else value


def by_id(i):
    return (i is None, i or 0)


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[ \t-\r]", "", t or "")].append((-len(t or ""), by_id(i), i, t))
    return [min(g, key=lambda r: r[:2])[2:] for g in groups.values()]


def near(rows):
    prints, groups = [(fingerprint(t), i, t) for i, t in rows], []
    for row in prints:
        joined = [g for g in groups if any(((row[0] ^ f) % 2**64).bit_count() <= 3 for f, _, _ in g)]
        groups = [g for g in groups if g not in joined] + [sum(joined, [row])]
    return [min(g, key=lambda r: (by_id(r[1]), r[0]))[1:] for g in groups]


def test_survivors_of_every_stage(spark, sf, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    a, b, c, d, e, f = (words(x) for x in "abcdef")
    rows = [(1, " ".join(a)), (2, " ".join(a)), (3, "  ".join(a)), (None, " ".join(b)), (None, " ".join(c)), (12, " ".join(c).upper()),
            (7, " ".join(d)), (7, " ".join(e)), (8, " ".join(e).upper()), (9, " ".join(f)), (10, None), (11, " \t"), (None, None)]
    like = table(spark, sf, "documents")
    base = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = base.selectExpr(*[c if c in base.columns else f"CAST(NULL AS {t}) AS {c}" for c, t in like.dtypes])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    items = table(spark, sf, "benchmark")
    items.limit(1).selectExpr(*[f"'{' '.join(f)}' AS {c}" if c == "text" else c for c in items.columns]).write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = []
    keep = corpus_pipeline.stage
    monkeypatch.setattr(corpus_pipeline, "stage", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # without labels no text is toxic
    want = [rows, exact(rows), near(exact(rows))]
    want.append([(i, t) for i, t in want[-1] if t != " ".join(f)])
    assert len(want[2]) == 7 and len(want[3]) == 6
    for got, expected in zip(seen, want, strict=False):
        assert Counter(tuple(r) for r in got.select("doc_id", "text").collect()) == Counter(expected)
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    matched = 0
    for i, t in want[3]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((p.start, p.length) for p in pieces if p.doc_id == i and zlib.crc32(array("I", ids[p.start : p.start + p.length]).tobytes()) == p.ids_crc32)
        assert [start for start, _ in own] + [len(ids)] == [0, *(start + n for start, n in own)]
        matched += len(own)
    assert matched == len(pieces)

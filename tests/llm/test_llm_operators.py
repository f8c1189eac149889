"""Operators against brute force on small and awkward input."""

import hashlib
import io
import random
import zlib
from array import array
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from sqlcorpus.llm import (
    decontaminate, exact_dedup, language_id, line_dedup, packing, queries, simhash, substring_dedup, toxicity, url_reputation, warc,
)
from sqlcorpus.llm.common import table


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_exact_dedup(odd, empty):
    texts = pairs(odd, "doc_id", "text")
    groups = defaultdict(list)
    for i, t in texts:
        key = hashlib.sha256("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r").encode()).hexdigest()
        groups[key].append((-len(t or ""), i is None, i or 0))
    got = exact_dedup.mark(odd).collect()
    assert len(got) == len(texts) and sum(r.kept for r in got) == len(groups)
    for r in got:
        best = min(groups[r.text_sha256])
        assert (r.keep_id is None, r.keep_id or 0) == best[1:] and r.group_size == len(groups[r.text_sha256])
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.mark(empty).count() == 0 == exact_dedup.deduplicate(empty).count()


def test_full_filter_gives_the_same(odd, monkeypatch):
    want = Counter(map(tuple, exact_dedup.mark(odd).collect()))
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows: 2)
    assert Counter(map(tuple, exact_dedup.mark(odd).collect())) == want


def _slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _slow_components(values, near):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if near(a, b):
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_simhash(odd, empty):
    rows = pairs(odd, "doc_id", "text")
    fps = [(i, _slow_fingerprint(t)) for i, t in rows]
    root = _slow_components({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = Counter((i, f"{f:016x}", least.get(root[f])) for i, f in fps)
    assert Counter(map(tuple, simhash.mark(odd).select("doc_id", "fingerprint", "component_id").collect())) == want
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(root.values()))
    assert simhash.mark(empty).count() == 0 == simhash.deduplicate(empty).count()


def test_simhash_keeps_one_row_of_each_component(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b.upper()), (7, c), (7, d), (8, d + " "), (9, c.upper()), (None, d), (3, "z y x"), (3, "z  y x"), (4, None), (None, " ")]
    fps = [(i, _slow_fingerprint(t)) for i, t in rows]
    root = _slow_components({f for _, f in fps}, lambda x, y: (x ^ y).bit_count() <= 3)
    assert len(set(root.values())) == 6
    best = {}
    for i, f in fps:
        best[root[f]] = min(best.get(root[f], (True, 0, 2**63)), (i is None, i or 0, f - 2**64 if f >> 63 else f))
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = Counter((i is None, i or 0, f - 2**64 if f >> 63 else f) for i, f in ((i, _slow_fingerprint(t)) for i, t in pairs(kept, "doc_id", "text")))
    assert got == Counter(best.values())


def test_links_and_components(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(12)} | {0, 2**64 - 1, 7}
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    got = {frozenset((r.a % 2**64, r.b % 2**64)) for r in simhash.links(spark.createDataFrame(signed, "fp bigint")).collect()}
    assert got == {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 52), (51, 52)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 50, 51, 52, 60]], "node bigint")
    assert dict(pairs(simhash.components(nodes, chain), "node", "root")) == {i: 0 if i < 41 else 60 if i == 60 else 50 for i in [*range(41), 50, 51, 52, 60]}


def test_decontaminate(spark, odd, empty):
    items = spark.createDataFrame([(1, odd.where("doc_id = 6").first().text), (2, "one two"), (3, None), (3, ""), (None, "straße")], "item_id bigint, text string")
    got = {(r.doc_id, r.text): r.matches for r in decontaminate.with_hits(odd, items, name="matches").collect()}
    for (_, text), found in got.items():
        words = decontaminate.words_of(text)
        hit, listed = set(), set()
        for item, t in pairs(items, "item_id", "text"):
            own = decontaminate.words_of(t)
            for w in [own[i : i + 13] for i in range(max(1, len(own) - 12))] if own else []:
                for i in range(len(words) - len(w) + 1):
                    if words[i : i + len(w)] == w:
                        hit.update(range(i, i + len(w)))
                        listed |= {str(item)} if item else set()
        assert (found.n_words, found.hits, found["items"]) == (len(words), sorted(hit), sorted(listed))
        assert decontaminate.words_of(" ".join(text[s.start : s.end] for s in found.spans) if text else "") == [words[i] for i in sorted(hit)]
    blocks = decontaminate.with_hits(odd, items, limit=40, name="matches")
    assert {(r.doc_id, r.text, tuple(r.matches.hits)) for r in blocks.collect()} == {(*k, tuple(v.hits)) for k, v in got.items()}
    assert decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.clean(odd, items.limit(0)).count() == odd.count() and decontaminate.clean(empty, items).count() == 0


def test_random_windows(spark):
    """Few distinct words, so that pieces repeat within items and documents, and runs of 12, 13 and more words occur."""
    rng = random.Random(9)
    items = [[rng.choice("ab") + str(rng.randint(0, 3)) for _ in range(rng.choice([1, 3, 7, 12, 13, 14, 40, 90]))] for _ in range(60)] + [["same"] * 30]
    docs = []
    for i in range(300):
        words = [rng.choice("abc") + str(rng.randint(0, 3)) for _ in range(rng.randint(0, 40))]
        for own in rng.choices(items, k=2):
            a = rng.randint(0, len(own) - 1)
            words += own[a : a + rng.choice([6, 7, 12, 13, 14, 30, 90])] + [rng.choice(["x", "a1"])]
        docs.append((i, " ".join(words + ["same"] * rng.choice([0, 0, 12, 13, 50]))))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    plan = decontaminate.with_hits(spark.createDataFrame(docs, "doc_id bigint, text string"), frame)
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for r in plan.collect():
        words, hit, listed = r.text.split(), set(), set()
        for item, own in enumerate(items):
            for w in {tuple(own[i : i + 13]) for i in range(max(1, len(own) - 12))}:
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i : i + len(w)]) == w:
                        hit.update(range(i, i + len(w)))
                        listed.add(str(item))
        assert (r.found.hits, r.found["items"]) == (sorted(hit), sorted(listed))


def test_taken_names_are_errors(spark, odd):
    taken = odd.withColumnRenamed("c0", "language").withColumnRenamed("_id", "removal")
    model = language_id.fit(odd)
    for add in (
        lambda: decontaminate.with_hits(taken, odd.selectExpr("doc_id AS item_id", "text")), lambda: model.predict(taken),
        lambda: substring_dedup.remove(taken), lambda: toxicity.ToxicityModel(0.0).score(taken),
    ):
        with pytest.raises(ValueError, match="give another name"):
            add()


@pytest.mark.parametrize("apply", [
    exact_dedup.deduplicate, simhash.deduplicate, line_dedup.remove, lambda d: decontaminate.clean(d, d.selectExpr("doc_id AS item_id", "text")),
    lambda d: toxicity.keep_clean(d, toxicity.ToxicityModel(0.0)), lambda d: substring_dedup.remove(d, name="r").drop("r")])
def test_filters_keep_columns_of_any_name(spark, apply):
    names = ["doc_id", "text", "found", "score", "c0", "c1", "_row", "_fp", "_sha", "_id", "_text", "norm", "key", "row_key", "spans", "features", "_out"]
    rows = [(i, f"text number {i} of some words", *[f"{n} {i}" for n in names[2:]]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, " + ", ".join(f"{n} string" for n in names[1:]))
    got = apply(df)
    assert got.columns == names
    assert {tuple(r)[2:] for r in got.collect()} <= {r[2:] for r in rows}


def test_packing(odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    for length, windows in ((2048, 64), (64, 2)):
        got = packing.pack(odd, queries.tokenizer_path(), length=length, windows=windows, keep_ids=True).collect()
        sequences, documents = defaultdict(list), defaultdict(list)
        for r in got:
            assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
            sequences[r.sequence_id].append((r.offset, r.length))
            documents[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
        for parts in sequences.values():
            ends = [0, *(a + n for a, n in sorted(parts))]
            assert [a for a, _ in sorted(parts)] == ends[:-1]
            assert ends[-1] == length or ends[-1].bit_count() == 1
        want = Counter()
        for i, t in pairs(odd, "doc_id", "text"):
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
            want[i, len(ids)] += len(ids)
            if i not in (None, 7):
                assert b"".join(x for _, x in sorted(documents[i, len(ids)])) == array("I", ids).tobytes()
        assert want == Counter({k: sum(len(x) // 4 for _, x in v) for k, v in documents.items()})
    assert packing.pack(empty, queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["a<|endoftext|>b\nc", "it's  I'm\tΣΑΣ x y", "é ́x", "x" * 3000])
def test_words_have_the_ids_of_the_text(text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(queries.tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert packing.encoder(queries.tokenizer_path())([text]) == [array("I", ids).tobytes()]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_has_its_own_ids(file, monkeypatch):
    """Random texts of words, marks, odd white space and special tokens; few remembered words, small slices."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SLICE_CHARS", 200)
    rng = random.Random(7)
    letters = [*"abAB'sSdtrevm019.,!<>|\"-_ \n\t    éÉßÀ÷×ÿªµſİΣς東\x1c\x85\xa0", "\u0301", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "'RE", "\U0001F600", " the ", " Der "]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(4000)]
    path = public_tokenizers.path(file)
    tokenizer = Tokenizer.from_file(path)
    want = [array("I", e.ids).tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert packing.encoder(path, words=300)(texts) == want


def test_new_words_are_learned_without_calls_for_each():
    import sys

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeéß", k=9)) for _ in range(20_000)]
    encode = packing.encoder(queries.tokenizer_path())
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        got = encode([" ".join(words)])
    finally:
        sys.setprofile(None)
    assert calls["call"] + calls["c_call"] < len(words) / 10
    assert got == [b"".join(encode(words))]


def test_substring_dedup(odd, empty):
    rows = sorted({(i is None, i or 0, t) for i, t in pairs(odd, "doc_id", "text")}, key=lambda r: (r[:2], r[2] or ""))
    got = {(r.doc_id is None, r.doc_id or 0, r.text): r.removal for r in substring_dedup.remove(odd).collect()}
    seen, want = set(), {}
    for row in rows:
        words = substring_dedup.words_of(row[2])
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        want[row] = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert got[row].n_words == len(words) and got[row].n_removed == len(gone)
        assert got[row].kept == want[row].decode() and got[row].kept_sha256 == hashlib.sha256(want[row]).hexdigest()
    assert substring_dedup.remove(empty).count() == 0


def test_suffix_automaton():
    rng = random.Random(3)
    for _ in range(200):
        automaton, past = substring_dedup.SuffixAutomaton(), []
        for _ in range(4):
            words = [rng.randrange(3) for _ in range(rng.randrange(1, 12))]
            got = automaton.statistics(words)
            for i in range(len(words)):
                earlier = [*past, words[:i]]
                best = max((n for n in range(1, i + 2) if any(words[i + 1 - n : i + 1] == e[j : j + n] for e in earlier for j in range(len(e)))), default=0)
                assert got[i] == best
            past.append(words)


def test_line_dedup(odd, empty):
    lines = []
    for k, (i, t) in enumerate(pairs(odd, "doc_id", "text")):
        for n, line in enumerate((t or "").split("\n")):
            words = line.lower().split()
            if words:
                shingles = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
                lines.append((k, (i is None, i or 0, n), shingles, " ".join(words)))
    want = Counter()
    for k, place, a, s in lines:
        match = [(p, t) for _, p, b, t in lines if 5 * len(a & b) >= 4 * len(a | b)]
        want[k] += min(p for p, _ in match) < place
    got = [r.n_removed for r in line_dedup.report(odd).collect()]
    assert sorted(got) == sorted(want[k] for k in range(len(got)))
    kept = line_dedup.remove(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() and line_dedup.report(empty).count() == 0


def test_archives_are_read_by_several_tasks(spark, tmp_path):
    pages = spark.range(600).selectExpr("id AS page_id", "'http://h/' AS url", "repeat(md5(cast(id AS string)), 40) AS html").repartition(3)
    manifest = warc.write(pages, str(tmp_path / "archives"), limit=60_000)
    archives, back = manifest.count(), warc.read(manifest)
    assert archives > 2 * warc.ARCHIVES_A_TASK
    assert back.rdd.getNumPartitions() == -(-archives // warc.ARCHIVES_A_TASK)
    assert sorted(r.page_id for r in back.collect()) == list(range(600))


def test_warc(spark):
    rows = [(1, "http://a/ü x\r\ny", "<p>é</p>"), (2, None, None), (3, "http://b", ""), (4, "http://c", "<p>é</p>"), (None, "u", "q"), (5, "u", "q"), (5, "u", "q"), (6, "v", "z" * 400000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter((i, len((h or "").encode()), warc.digest_of((h or "").encode()), "response" if i == first[h or ""] else "revisit", None if i == first[h or ""] else first[h or ""]) for i, _, h in rows)
    assert Counter(tuple(r)[:5] for r in warc.round_trip(pages, limit=100_000).collect()) == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archive_starts_with_its_dictionary():
    records = [warc.record(i, "http://x", f"<p>{i % 7} some text</p>".encode() * 9, 18, "D") for i in range(300)]
    data = warc.archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and data[8:12] == b"\x37\xa4\x30\xec"
    assert list(warc.read_records(io.BytesIO(data), chunk=37)) == records


def test_url_reputation(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.shop{i % 3}.co.uk/p{i}") for i in range(400)] + [(900, None), (901, "no url"), (902, "http://h.net/fr/x"), (903, "HTTP://WWW.Example.com?x"), (904, "http://new.shop1.co.uk/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    outcomes = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (1, None)], "page_id bigint, bad int")
    got = {r.page_id: r for r in url_reputation.judge(pages, outcomes, queries.URL_RULES).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(400))
    assert (got[900].host, got[901].path, got[902].rule, got[902].verdict) == ("", "", "net/fr/", "block")
    assert (got[903].host, got[903].path, got[903].rule, got[904].verdict) == ("www.example.com", "", None, "allow")
    assert {r.verdict for r in url_reputation.judge(pages, outcomes.limit(0), []).collect()} == {"allow"}


def test_language_id(spark, sf, odd, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    held = toxicity.held_out(F.col("doc_id"), 3, 1)
    model = language_id.fit(docs.where(~held))
    share = model.predict(docs.where(held)).agg(F.avg((F.col("language.lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert share > 0.95
    found = {(r.doc_id, r.text): r.language for r in model.predict(odd).collect()}
    assert found[1, None].lang_pred == found[2, ""].lang_pred == found[12, "12345 !!! ???"].lang_pred == "und" and found[4, "One two"].score > 0
    assert language_id.fit(empty).predict(odd).where("language.lang_pred <> 'und'").count() == 0


def test_toxicity(spark, odd, empty):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    held = toxicity.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, labels.where(~held), rows=6000)
    scored = model.score(docs.where(held)).join(labels, "doc_id")
    right = scored.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.98
    assert model.score(odd, name="p").where("p BETWEEN 0 AND 1").count() == odd.count()
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.fit(empty, labels).score(odd, name="p").where("p <> 0").count() == 0


def test_hot_keys_meet_their_rows(spark, monkeypatch):
    from sqlcorpus.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 2)
    rows = spark.range(100).selectExpr("id", "id % 7 AS k")
    facts = rows.where("k < 6").groupBy("k").count()
    got = common.attach(rows, facts, ["k"], "count")
    assert got.count() == 100 and got.where("count IS NULL").count() == rows.where("k = 6").count()


def test_settled_copies_spread_over_shards():
    import pyarrow as pa
    from types import SimpleNamespace

    text = " ".join(f"w{i}" for i in range(40))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array([5] * 300, pa.int64()), pa.array([text] * 300)], names=["doc_id", "row_key", "text"])
    out = pa.Table.from_batches(list(substring_dedup._passages(SimpleNamespace(value=(b"\xff" * 8, [])))([batch])))
    settled = [r for r in out.to_pylist() if r["words"] is None]
    assert {r["doc_id"] for r in settled} == set(range(1, 300))
    assert max(Counter(r["shard"] for r in settled).values()) == 1


def test_every_language_is_learned(spark, monkeypatch):
    words = {f"l{i}": " ".join(chr(97 + i) + chr(97 + (i * 7 + j) % 26) * 3 for j in range(9)) for i in range(7)}
    rows = [(k, t, x) for k, (x, t) in enumerate((x, t) for i, (x, t) in enumerate(words.items()) for _ in range(i + 1))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    whole = {r.doc_id: r.language for r in language_id.fit(docs).predict(docs).collect()}
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    got = {r.doc_id: (r.lang, r.language) for r in language_id.fit(docs).predict(docs).collect()}
    assert len(got) == len(rows) and all(x == found.lang_pred for x, found in got.values())
    assert all(found.score == pytest.approx(whole[k].score) for k, (_, found) in got.items())


def test_suffixes_of_the_caller(spark):
    hosts = spark.createDataFrame([("a.shop.co.id",), ("x.k12.ca.us",), ("b.k12.ca.us",), ("a.b.co.uk",), ("z.com",)], "host string")
    suffixes = ["co.id", "ca.us", "k12.ca.us", "co.uk"]
    got = {r.host: (r.d, r.s) for r in hosts.select("host", *[c.alias(n) for c, n in zip(url_reputation.units_of(F.col("host"), suffixes), "ds")]).collect()}
    assert got == {"a.shop.co.id": ("shop.co.id", "co.id"), "x.k12.ca.us": ("x.k12.ca.us", "k12.ca.us"), "b.k12.ca.us": ("b.k12.ca.us", "k12.ca.us"), "a.b.co.uk": ("b.co.uk", "co.uk"), "z.com": ("z.com", "com")}
    assert {r.d for r in hosts.limit(1).select(url_reputation.units_of(F.col("host"))[0].alias("d")).collect()} == {"co.id"}
    pages = spark.createDataFrame([(i, f"http://bad{i % 40}.co.id/") for i in range(400)] + [(900, "http://new.co.id/")], "page_id bigint, url string")
    outcomes = spark.createDataFrame([(i, 1) for i in range(400)], "page_id bigint, bad int")
    assert url_reputation.judge(pages, outcomes, [], suffixes=suffixes).count() == 401

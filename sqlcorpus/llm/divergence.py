"""Divergence of sources: how far the words of each source lie from the other sources of its language.

1. ``partial_counts`` runs as an Arrow compute pipeline in ``mapInArrow``: ``ascii_lower``,
   ``split_pattern_regex``, ``dictionary_encode`` and hash ``group_by`` turn each slice of a batch into
   occurrences and documents per (language, source, term); a task merges its slices before they leave.
2. The partial counts meet by (language, term). Terms in at least ``MIN_DOCS`` documents of the language
   are kept.
3. The merged counts are cut into columnar shards of bounded size by a hash of the term. Each shard holds
   all counts of its terms as a matrix of smoothed shares and adds up the distances of every two sources;
   the shards' sums are added. Terms that neither source of a tile has cost nothing: they are counted.

Shares are whole numbers: ``1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))``, computed exactly.

Defined cases: null text, language or source count as empty; a group without kept terms still has a row
for every other source; a language without kept terms has distances 0; a source alone in its language has
no pair; equal values are ordered by the item's UTF-8 bytes; repeated rows are documents of their own; a
text of any length is counted whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sqlcorpus.llm.common import attach, released
from sqlcorpus.session import stage

#: FIXED VALUES: what separates terms; the smoothing; the documents that a kept term needs; terms reported a group.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
PRIOR = 5
MIN_DOCS = 30
TOP = 50
#: Bytes of text that are split at once, counts that a task keeps before it sends them on.
SLICE_BYTES = 8 << 20
FLUSH = 2_000_000
#: Counts of a shard, cells of a matrix, sources of a tile.
SHARD_COUNTS = 100_000
CELLS = 4_000_000
TILE = 1024
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def partial_counts(batches) -> Iterator:
    """Batches of ``lang, source, text`` without nulls to batches of ``_COUNTS``."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    keys = ["lang", "source", "term"]

    def split(batch):
        """Slices of at most SLICE_BYTES; a longer text is a slice of its own."""
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype("int64"))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to

    def counted(part):
        lists = pc.split_pattern_regex(pc.ascii_lower(part.column("text")), SEPARATORS)
        doc, term = pc.list_parent_indices(lists), pc.list_flatten(lists)
        real = pc.not_equal(term, "")
        coded = term.filter(real).dictionary_encode()
        words = pa.table({"doc": doc.filter(real), "code": coded.indices})
        per_doc = words.group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
        lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
        doc = per_doc.column("doc")
        merged = pa.table({
            "lang": lang.indices.take(doc), "source": source.indices.take(doc), "code": per_doc.column("code"), "n": per_doc.column("count_all"),
        }).group_by(["lang", "source", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
        return pa.table({
            "lang": pa.chunked_array([lang.dictionary]).take(merged.column("lang")), "source": pa.chunked_array([source.dictionary]).take(merged.column("source")),
            "term": pa.chunked_array([coded.dictionary]).take(merged.column("code")), "n": merged.column("n_sum"), "docs": merged.column("n_count"),
        })

    def merge(tables):
        both = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return both.rename_columns([*keys, "n", "docs"]) if both.column_names[:3] == keys else both.select([*keys, "n_sum", "docs_sum"]).rename_columns([*keys, "n", "docs"])

    kept, rows = [], 0
    for batch in batches:
        for part in split(batch):
            kept.append(counted(part))
            rows += kept[-1].num_rows
            if rows > FLUSH:
                kept = [merge(kept)]
                rows = kept[0].num_rows
                if rows > FLUSH // 2:
                    yield from kept[0].to_batches(max_chunksize=100_000)
                    kept, rows = [], 0
    if kept:
        yield from merge(kept).to_batches(max_chunksize=100_000)


def kept_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str, min_docs: int) -> DataFrame:
    """``lang, source, term, n`` of kept terms with their ``total`` in the language; ``one`` marks one row a term."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = texts.mapInArrow(released(partial_counts), _COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    return (
        counts.withColumn("_docs", F.sum("docs").over(term)).withColumn("total", F.sum("n").over(term))
        .withColumn("one", F.col("source") == F.min("source").over(term)).where(F.col("_docs") >= min_docs)
        .select("lang", "source", "term", "n", "total", "one"))


def share(count: Column, n: Column, v: Column) -> Column:
    """The smoothed share of a count among ``n`` occurrences of ``v`` kept terms; 0 where nothing is kept."""
    over = (count + F.lit(PRIOR)).cast("decimal(22,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.call_function("div", over, (n + v * PRIOR).cast("decimal(20,0)"))
    return F.when(v > 0, whole + F.lit(1)).otherwise(F.lit(0)).cast("long")


def group_facts(docs: DataFrame, kept: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Every occurring group: ``lang, source``, its number ``code`` in the language, ``n_group`` occurrences, the language's ``n_lang`` and ``n_terms`` kept."""
    names = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.sum(F.col("one").cast("long")).alias("_v"))
    lang = W.partitionBy("lang")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return names.join(sums, ["lang", "source"], "left").select(
        "lang", "source", zero(F.col("n_group")).alias("n_group"), zero(F.sum("n_group").over(lang)).alias("n_lang"), zero(F.sum("_v").over(lang)).alias("n_terms"),
        (F.row_number().over(lang.orderBy("source")) - 1).cast("int").alias("code"))


def _distances(key, left, right):
    """Sums of the distances of the sources of a tile over the terms of one shard.

    ``left``: ``term, code, p`` of the counts above zero; ``right``: ``code, p0`` of the tile's sources.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lang, _, bi, bj = (k.as_py() for k in key)
    codes, p0 = right.column("code").to_numpy(), right.column("p0").to_numpy()
    order = np.argsort(codes)
    codes, p0 = codes[order], p0[order]
    rows, cols = np.flatnonzero(codes // TILE == bi), np.flatnonzero(codes // TILE == bj)
    sums, terms = np.zeros((len(rows), len(cols)), dtype=np.int64), 0
    if left.num_rows:
        coded = left.column("term").combine_chunks().dictionary_encode()
        term, terms = coded.indices.to_numpy(), len(coded.dictionary)
        at, p = np.searchsorted(codes, left.column("code").to_numpy()), left.column("p").to_numpy()
        by = np.argsort(term, kind="stable")
        term, at, p = term[by], at[by], p[by]
        step = max(1, CELLS // len(codes))
        for lo in range(0, terms, step):
            a, b = np.searchsorted(term, [lo, lo + step])
            shares = np.repeat(p0[:, None], min(step, terms - lo), axis=1)
            shares[at[a:b], term[a:b] - lo] = p[a:b]
            for i, x in enumerate(rows):
                sums[i] += np.abs(shares[cols] - shares[x]).sum(axis=1)
    i, j = np.nonzero(np.ones_like(sums) if bi != bj else np.triu(np.ones_like(sums), 1))
    return pa.table({
        "lang": pa.array([lang] * len(i), pa.string()), "a": pa.array(codes[rows[i]], pa.int32()), "b": pa.array(codes[cols[j]], pa.int32()),
        "part": pa.array(sums[i, j], pa.int64()), "terms": pa.array([terms] * len(i), pa.int64()),
    })


def pair_distances(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for every two codes ``a < b`` of a language."""
    size = groups.agg(F.max("code").alias("c")).first()["c"]
    tiles = (size or 0) // TILE + 1
    shards = max(1, -(-entries.count() // SHARD_COUNTS))
    block = F.floor(F.col("code") / TILE).cast("int")
    others = F.sequence(F.lit(0), F.lit(tiles - 1))
    tiled = lambda df: df.withColumn("_o", F.explode(others)).select(
        "*", F.least(block, "_o").alias("bi"), F.greatest(block, "_o").alias("bj")).drop("_o")
    left = tiled(entries.select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard"), "term", "code", "p"))
    right = tiled(groups.select("lang", "code", "p0").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))))
    keys = ["lang", "shard", "bi", "bj"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_distances, "lang string, a int, b int, part bigint, terms bigint")
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("terms").alias("terms"))
    ends = [groups.select("lang", F.col("code").alias(c), F.col("source").alias(f"s{c}"), F.col("p0").alias(f"p{c}"), F.col("n_terms").alias(f"v{c}")) for c in "ab"]
    both = summed.join(ends[0], ["lang", "a"]).join(ends[1], ["lang", "b"])
    return both.select("lang", F.col("sa").alias("a"), F.col("sb").alias("b"), (F.col("part") + (F.col("va") - F.col("terms")) * F.abs(F.col("pa") - F.col("pb"))).alias("value"))


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: a ``pair`` row for each other source of the language, and a
    ``term`` row for each of the ``top`` terms that the source uses more than its language does."""
    kept = stage(kept_counts(docs, text_col, lang_col, source_col, min_docs), "divergence-counts")
    facts = group_facts(docs, kept, text_col, lang_col, source_col)
    groups = stage(facts.withColumn("p0", share(F.lit(0), F.col("n_group"), F.col("n_terms"))), "divergence-groups")
    known = attach(kept, groups, ["lang", "source"], "n_group", "inner")
    entries = known.withColumn("p", share(F.col("n"), F.col("n_group"), F.col("n_terms"))).select("lang", "source", "term", "code", "p", share(F.col("total"), F.col("n_lang"), F.col("n_terms")).alias("q"))
    entries = stage(entries, "divergence-shares")
    pairs = stage(pair_distances(entries, groups), "divergence-pairs")
    pair = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    term = entries.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select("*", F.lit("pair").alias("part"), rank).select(*columns).unionByName(
        term.select("*", F.lit("term").alias("part"), rank).where(F.col("rank") <= top).select(*columns))

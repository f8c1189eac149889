"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct shingles of ``SHINGLE`` words (A-Z and other letters lower-cased, words
separated by ASCII white space; a shorter line is one shingle). Lines match when the Jaccard similarity
of their tokens is at least 4/5. A line goes when a matching line stands earlier: smaller id, or the same
document and a smaller line number; lines are judged on the input, so no chain of matches builds up.

1. Lines are staged once, normalised; lines with the same words are one class, known by ``KEY``, two hashes of the normal
   line with different seeds. The first alone names it in postings and pairs. Whether a line is blank is a column of its
   own, so that steps that need no text read none.
2. Tokens are ordered by rarity: levels of ``RARITY`` hash buckets counted over all lines, a table of fixed size,
   then by hash. Any order gives the same result; a rare first token keeps the join small.
3. Each line posts its prefix: two classes that match share a token of their prefixes. Only numbers are posted, no
   text. Postings of a token that no other class posts are dropped, the others are joined with the length filter and
   the positional filter: two sets that match have all their shared tokens from the first shared one on, so that this
   one stands early in both. Tokens are cut to ``TOKEN_BITS`` for this: tokens that fall together only add candidates.
4. Candidates, as one class with many, are compared by sketches of ``SKETCH`` times 64 parity bits: every token that only
   one of two sets has flips one bit at most, so that matching sets differ in few. What is left is verified on the whole
   token sets. Tokens are made again for both, only for lines whose class is in a bitmap of the candidates, of bounded size.
   (Explodes are outer ones: no array is empty, and others would push a filter on it below the projection
   that splits the words.)
5. Each line learns the earliest match of its class; the most frequent lines by a broadcast of fixed size.

Defined cases: lines without words are kept and not counted; null texts have no lines; rows that share an
id are one document for what is earlier, and lines at the same place do not remove each other; null ids
come last; an empty table gives an empty result; ``remove`` keeps the other columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sqlcorpus.llm.common import BLOCK_BITS, attach, bitmaps, probe
from sqlcorpus.session import scratch_path, stage

SHINGLE = 5
#: Least Jaccard similarity, as numerator and denominator.
SIMILARITY = (4, 5)
RARITY = 1 << 16
KEY = ["class", "check"]
#: Bits of a token in the order and in the postings.
TOKEN_BITS = 40
#: Words of 64 parity bits in a sketch.
SKETCH = 8
#: A class has its candidates in so many arrays at most, dealt by their hash.
BLOCKS = 64
#: Bits of the candidates' bitmap for each pair, and the most bits it may have: 64 MB, the bound of the broadcast.
BITS_PER_PAIR = 32
MAX_BITS = 1 << 29


def normal(line: Column) -> Column:
    """Lower-cased words of a lower-cased line joined by single spaces; only lines that need it are rewritten."""
    other = F.contains(line, F.lit("  "))
    for char in "\t\x0b\f\r":
        other = other | F.contains(line, F.lit(char))
    return F.trim(F.when(other, F.regexp_replace(line, "[ \\t\\x0B\\f\\r]+", " ")).otherwise(line))


def _token(at, pair, size: int) -> Column:
    """The hash of ``size`` words: of their ``pair`` hashes from 0, and of the last word where the number is odd."""
    pairs = [pair(k) for k in range(0, size - 1, 2)]
    return F.xxhash64(*pairs, *([at(size - 1)] if size % 2 else []))


def with_tokens(lines: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Adds ``tokens``, the distinct 64-bit hashes of the ``size``-word sequences of the normal line ``norm``.

    Words and the hashes of two neighbours are made in projections of their own, because they are used several
    times. The lambdas are as small as can be, because they are not compiled.
    """
    words, two, n = F.col("_words"), F.col("_two"), F.size("_words")
    shingles = F.transform(
        F.slice(two, 1, n - size + 1),
        lambda first, i: _token(lambda k: F.get(words, i + k), lambda k: F.get(two, i + k) if k else first, size))
    tokens = F.when(n < size, F.array(F.xxhash64("norm"))).otherwise(F.array_distinct(shingles))
    return (
        lines.withColumn("_words", F.split("norm", " "))
        .withColumn("_two", F.transform(words, lambda word, i: F.xxhash64(word, F.get(words, i + 1))))
        .withColumn("tokens", tokens).drop("_words", "_two"))


def _bucket(token: Column) -> Column:
    return token.bitwiseAND(F.lit(RARITY - 1))


def _levels(lines: DataFrame) -> Column:
    """A constant array: by how many quarters of a doubling each of the RARITY buckets has more tokens than the mean,
    in the bits above those of a token."""
    words, n = F.col("_words"), F.size("_words")
    places = lines.select("norm", F.split("norm", " ").alias("_words")).select(
        "norm", "_words", F.explode_outer(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0)))).alias("_i"))
    at = lambda k: F.get(words, F.col("_i") + k)
    token = F.when(n < SHINGLE, F.xxhash64("norm")).otherwise(_token(at, lambda k: F.xxhash64(at(k), at(k + 1)), SHINGLE))
    counts = [0] * RARITY
    for row in places.groupBy(_bucket(token).alias("b")).count().collect():
        counts[row["b"]] = row["count"]
    mean = max(1.0, sum(counts) / RARITY)
    levels = [int(4 * math.log2(c / mean)) << TOKEN_BITS if c > mean else 0 for c in counts]
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>")


def _lines(docs: DataFrame) -> DataFrame:
    """Normal lines of ``docs(_row, _id, _text)`` with their keys, staged; the first line of a row always, others only with words."""
    lines = docs.select("_row", "_id", F.posexplode(F.split(F.coalesce("_text", F.lit("")), "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.lower("line")).withColumn("norm", normal(F.col("line"))).where("norm <> '' OR line_no = 0")
    path = scratch_path(docs.sparkSession, "lines")
    lines.select(
        "_row", "_id", "line_no", "norm", (F.col("norm") == "").alias("blank"), F.xxhash64("norm").alias("class"), F.xxhash64(F.lit(1), "norm").alias("check")
    ).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _place() -> Column:
    """Order of lines; null ids last."""
    return F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("line_no").alias("line"))


def _candidates(lines: DataFrame) -> DataFrame:
    """Pairs of classes that pass the filters on their prefixes: a class ``a`` with an array ``bs`` of larger ones."""
    num, den = SIMILARITY
    levels = _levels(lines)

    def order(t):
        level = F.coalesce(F.get(levels, _bucket(t).cast("int")), F.lit(0).cast("long"))  # not null: primitives are sorted faster
        return level + F.call_function("shiftrightunsigned", t, F.lit(64 - TOKEN_BITS))

    n = F.size("tokens")
    prefix = n - F.floor((num * n + den - 1) / den).cast("int") + 1
    ranked = with_tokens(lines.select("class", "norm")).select(
        "class", n.cast("long").alias("n"), F.slice(F.sort_array(F.transform("tokens", order)), F.lit(1), prefix).alias("first"))
    posts = ranked.select("class", "n", F.posexplode_outer("first").alias("pos", "t")).select(
        "t", "class", (F.col("n") * (1 << 32) + F.col("pos")).alias("at"))
    w = W.partitionBy("t")
    shared = posts.withColumn("_least", F.min("class").over(w)).withColumn("_most", F.max("class").over(w)).where("_least <> _most")
    # copies of a line go before the rows are moved once more
    shared = stage(shared.select("t", "class", "at").distinct(), "shared-tokens").select(
        "t", "class", F.call_function("shiftright", "at", F.lit(32)).alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"))
    a, b = (shared.select("t", F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("pos").alias(f"p{c}")) for c in "ab")
    nx, ny, i, j = F.col("na"), F.col("nb"), F.col("pa"), F.col("pb")
    overlap = F.least(nx - i, ny - j)  # if this is the first token that both have
    lengths = F.least(nx, ny) * den >= F.greatest(nx, ny) * num
    positions = overlap * (num + den) >= (nx + ny) * num
    pairs = a.join(b, "t").where((F.col("a") < F.col("b")) & lengths & positions).select("a", "b")
    return pairs.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(BLOCKS)).alias("block")).agg(F.collect_set("b").alias("bs")).select("a", "bs")


def _wanted(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lines whose class is in one of the ``pairs``, and few others."""
    number = pairs.agg(F.sum(F.size("bs"))).first()[0]
    bits = min(MAX_BITS, max(BLOCK_BITS, 1 << (max(1, number or 0) * BITS_PER_PAIR - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    ends = pairs.select(F.explode(F.concat(F.array("a"), "bs")).alias("c")).select(place(F.col("c")).alias("_p"))
    return probe(lines, stage(bitmaps(ends, "_p"), "candidate-bits"), [place(F.col("class"))], "_in").where("_in")


def _ends(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``pairs`` one by one with the facts of both classes, as ``(name)_a`` and ``(name)_b``."""
    fact = lambda c: facts.select(F.col("class").alias(c), *[F.col(f).alias(f"{f}_{c}") for f in facts.columns if f != "class"])
    return pairs.join(fact("a"), "a").withColumn("b", F.explode("bs")).drop("bs").join(fact("b"), "b")


def _sketches(lines: DataFrame) -> DataFrame:
    """Each class of ``lines`` with the number ``n`` of its tokens and their parity bits, as ``SKETCH`` numbers."""
    numbered = lines.select("class", "norm", F.monotonically_increasing_id().alias("_line"))  # not in one projection with explode
    tokens = with_tokens(numbered).select(
        "_line", "class", F.size("tokens").alias("n"), F.explode_outer("tokens").alias("t"))
    word, bit = F.call_function("shiftrightunsigned", F.col("t"), F.lit(6)).bitwiseAND(F.lit(SKETCH - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t").bitwiseAND(F.lit(63)).cast("int"))
    bits = [F.coalesce(F.bit_xor(F.when(word == k, bit)), F.lit(0).cast("long")).alias(f"bits{k}") for k in range(SKETCH)]
    return tokens.groupBy("_line", "class", "n").agg(*bits).drop("_line").distinct()


def _links(lines: DataFrame) -> DataFrame:
    """Verified pairs, both ways: ``KEY``, and the other's ``first`` place."""
    num, den = SIMILARITY
    pairs = stage(_candidates(lines), "candidate-lines")
    sketches = stage(_sketches(_wanted(lines, pairs)), "candidate-sketches")
    differ = sum((F.bit_count(F.col(f"bits{k}_a").bitwiseXOR(F.col(f"bits{k}_b"))) for k in range(SKETCH)), F.lit(0))
    near = _ends(pairs, sketches).where(differ * (num + den) <= (F.col("n_a") + F.col("n_b")) * (den - num))
    near = stage(near.select("a", F.array("b").alias("bs")), "near-lines")
    classes = _wanted(lines, near).groupBy(*KEY).agg(F.min(_place()).alias("first"), F.first("norm").alias("norm"))
    # no shuffled row is tokenized twice
    facts = stage(with_tokens(classes).select(*KEY, "first", "tokens"), "near-tokens")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    true = _ends(near, facts).where(both * (num + den) >= (F.size("tokens_a") + F.size("tokens_b")) * num)
    true = stage(true.select("a", "b", "check_a", "check_b", "first_a", "first_b"), "line-links")
    ways = [true.select(F.col(c).alias("class"), F.col(f"check_{c}").alias("check"), F.col(f"first_{d}").alias("other")) for c, d in ("ab", "ba")]
    return ways[0].unionByName(ways[1])


def matched_lines(lines: DataFrame) -> DataFrame:
    """Those of the staged ``lines`` with words whose text has links or copies: ``_row, _id, line_no, links, match``.

    ``links`` counts the other texts that the line's text matches; ``match`` is the place of the earliest
    line that matches it, null when there is none before it.
    """
    lines = lines.where("NOT blank")
    links = _links(lines)
    known = links.groupBy(*KEY).agg(F.count(F.lit(1)).alias("links"), F.min("other").alias("other"))
    grouped = lines.groupBy(*KEY).agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("rows"))
    facts = stage(
        grouped.join(known, KEY, "left").where("rows > 1 OR links IS NOT NULL").select(
            *KEY, "rows", F.coalesce("links", F.lit(0)).alias("links"), F.least("first", "other").alias("earliest")), "line-facts")
    found = attach(lines.select("_row", "_id", "line_no", *KEY), facts, KEY, "rows", "inner")
    return found.select("_row", "_id", "line_no", "links", F.when(F.col("earliest") < _place(), F.col("earliest")).alias("match"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_removed, n_links`` and ``removed``, the removed
    lines in order as ``line:id of the earliest match``, comma-joined."""
    lines = _lines(docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")))
    gone = F.when(F.col("match").isNotNull(), F.struct("line_no", F.concat_ws(":", F.col("line_no").cast("string"), F.coalesce(F.col("match.id").cast("string"), F.lit("null"))).alias("s")))
    per_row = matched_lines(lines).groupBy("_row").agg(F.sum("links").alias("n_links"), F.sort_array(F.collect_list(gone)).alias("gone"))
    rows = lines.groupBy("_row").agg(F.first("_id").alias("_id"), F.count_if(~F.col("blank")).alias("n_lines"))
    none = F.lit(0).cast("long")
    return rows.join(per_row, "_row", "left").select(
        F.col("_id").alias("doc_id"), "n_lines",
        F.coalesce(F.size("gone").cast("long"), none).alias("n_removed"), F.coalesce("n_links", none).alias("n_links"),
        F.coalesce(F.array_join(F.transform("gone", lambda g: g["s"]), ","), F.lit("")).alias("removed"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed lines taken out of the text; its other columns stay as they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = stage(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()), "line-documents")
    text = names[docs.columns.index(text_col)]
    rows = inner.select("_row", F.col(names[docs.columns.index(id_col)]).alias("_id"), F.col(text).cast("string").alias("_text"))
    gone = matched_lines(_lines(rows)).where("match IS NOT NULL").groupBy("_row").agg(F.collect_set("line_no").alias("_gone"))
    kept = F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains("_gone", i))
    cut = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return inner.join(gone, "_row", "left").withColumn(text, cut).select(*names).toDF(*docs.columns)

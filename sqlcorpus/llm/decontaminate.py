"""Benchmark decontamination with one Aho-Corasick automaton.

Text is normalised to words: runs of ASCII letters, digits and every non-ASCII character, A-Z lower-cased.
A window is ``WINDOW`` consecutive words of a benchmark item, or the whole item if it is shorter. The
automaton runs over word numbers and holds each word of an item once: items are cut into consecutive
pieces of half a window (seven words), of which every window contains a whole one. A document is scanned once; where a
piece occurs, the match is extended word by word in both directions, and a run of at least a window is
hit. Hits are mapped back to code-point offsets of the original text.

The items are a test set, not the corpus: they are read through the driver and broadcast, up to
``BLOCK_WORDS`` words to an automaton (about 100 bytes each). Only a larger set is scanned in several
blocks, one after another with each result staged, so that memory stays that of a block.

Defined cases: a null or empty text has no words and is clean; an item without words has no window; an
item that is repeated counts once; items with a null id mark words but are not listed; an empty
benchmark leaves every document clean; a text of any length is scanned whole; other columns pass
unchanged, and a name for the new column that is taken is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlcorpus.llm.common import free_name, released, unused
from sqlcorpus.session import stage

WINDOW = 13
#: A document is contaminated when at least one word in SHARE is hit.
SHARE = 20
#: Words of the items in one automaton.
BLOCK_WORDS = 2_000_000
FOUND = "struct<n_words:bigint,hits:array<int>,items:array<string>,spans:array<struct<start:int,end:int>>>"
#: Bytes to their normalised form: letters lower-cased, other ASCII outside 0-9a-z a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    return [] if text is None else [w.decode() for w in text.encode("utf-8", "replace").translate(_TABLE).split()]


def item_blocks(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str | None, list[str]]]]:
    """Items as (id, words) in blocks of at most ``limit`` words (or of one item)."""
    block, size = [], 0
    for row in items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        words = words_of(row[1])
        if block and size + len(words) > limit:
            yield block
            block, size = [], 0
        if words:
            block.append((row[0], words))
            size += len(words)
    yield block


def _scanner(block, size: int):
    """A pandas UDF over texts; ``block`` is a broadcast of items."""

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import re

        import ahocorasick

        word = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
        piece = (size + 1) // 2
        numbers: dict[str, int] = {}
        ids, items = [], []
        places: dict[tuple, list[tuple[int, int]]] = {}  # item and place of a piece; place -1 is a whole short item
        for item, words in block.value:
            coded = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words)
            if len(coded) < size:
                places.setdefault(coded, []).append((len(items), -1))
            else:
                for at in range(0, len(coded) - piece + 1, piece):
                    places.setdefault(coded[at : at + piece], []).append((len(items), at))
            ids.append(item)
            items.append(coded)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, where in places.items():
            automaton.add_word(key, (len(key), where))
        automaton.make_automaton()
        number = numbers.get

        def runs(coded):
            """``(item, first, end)`` of all occurrences of windows, joined where they overlap in one item."""
            seen: dict[tuple[int, int], int] = {}
            for end, (length, where) in automaton.iter(coded):
                first = end - length + 1
                for item, at in where:
                    if at < 0:
                        yield item, first, end + 1
                        continue
                    if seen.get((item, first - at), 0) > end:
                        continue  # inside a run that was extended before
                    own, a, b = items[item], first, end + 1
                    while a and at and coded[a - 1] == own[at - 1]:
                        a, at = a - 1, at - 1
                    stop = at + b - a
                    while b < len(coded) and stop < len(own) and coded[b] == own[stop]:
                        b, stop = b + 1, stop + 1
                    seen[item, a - at] = b
                    if b - a >= size:
                        yield item, a, b

        def of(text):
            words = words_of(text)
            if not words or not places:
                return len(words), [], [], []
            found = list(runs(tuple([number(w, 0) for w in words])))
            if not found:
                return len(words), [], [], []
            hit, listed = set(), set()
            for item, a, b in found:
                hit.update(range(a, b))
                listed.add(ids[item])
            hits, spans, at = sorted(hit), [], [m.span() for m in word.finditer(text)]
            for i in hits:
                if spans and i - 1 in hit:
                    spans[-1][1] = at[i][1]
                else:
                    spans.append(list(at[i]))
            return len(words), hits, sorted(listed - {None}), [{"start": a, "end": b} for a, b in spans]

        for texts in batches:
            yield pd.DataFrame([of(None if pd.isna(t) else t) for t in texts], columns=["n_words", "hits", "items", "spans"])

    return F.pandas_udf(released(scan), FOUND)


def with_hits(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    size: int = WINDOW, limit: int = BLOCK_WORDS, name: str = "found",
) -> DataFrame:
    """``docs`` with a column ``name``: number of words, indexes of hit words, ids of the items with
    occurring windows (sorted as strings), and the hit spans of the original text."""
    unused(docs, name)
    context, out, parts = docs.sparkSession.sparkContext, docs, []
    blocks = item_blocks(items, item_id, item_text, limit)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        parts.append(free_name(out, f"{name}_{len(parts)}"))
        out = out.withColumn(parts[-1], _scanner(context.broadcast(block), size)(F.col(text_col).cast("string")))
        out = stage(out, "decontaminate") if following is not None or len(parts) > 1 else out
        block = following

    def all_of(field: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(p)[field] for p in parts]))))

    merged = F.col(parts[0]) if len(parts) == 1 else F.struct(
        F.col(parts[0])["n_words"].alias("n_words"), *[all_of(f).alias(f) for f in ("hits", "items", "spans")])
    return out.withColumn(name, merged).drop(*parts)


def contaminated(found: Column, share: int = SHARE) -> Column:
    n_hit = F.size(found["hits"])
    return (n_hit > 0) & (n_hit * share >= found["n_words"])


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    name = free_name(docs, "found")
    return with_hits(docs, items, name=name, **options).where(~contaminated(F.col(name))).select(*[F.col(f"`{c}`") for c in docs.columns])

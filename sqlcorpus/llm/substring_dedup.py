"""Removal of repeated word sequences with suffix automata of reference passages.

A window is ``WINDOW`` consecutive words of a document; a word goes when a window that covers it also
starts earlier (smaller id, or the same document and an earlier start). The reference is the corpus
itself, which no broadcast can hold, so it is dealt into shards by content: the anchor of a window is the
smallest hash of its ``GRAM``-word sequences, equal windows have equal anchors, and neighbouring windows
share one. Passages with the same anchor form a reference shard.

1. Anchors are counted, aggregated before the shuffle; those seen more than once become a bitmap of
   bounded size that is broadcast (a fuller one passes more passages on, with the same result).
2. Documents are read again; passages with possibly repeated anchors go to their shard. A passage that a
   partition has seen at an earlier place is settled there, so copies collapse before the shuffle.
   Windows of the most frequent anchors go out one by one under a hash of the window itself, so a
   frequent anchor is no shard of its own.
3. A shard's passages come in document order. Each is streamed through the suffix automaton of all
   before it: the matching statistics give the windows that started earlier, and the passage is added.
4. The spans meet their documents by id, which spreads evenly.

Defined cases: null and short texts lose nothing; rows that share an id are taken as one document for
what is earlier within it, told apart by a hash of the text; rows equal in id and text get equal results;
null ids come last; an empty table gives an empty result; other columns of ``remove`` are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcorpus.llm.common import BLOCK_BITS, bitmaps, unused
from sqlcorpus.session import stage

WINDOW = 20
GRAM = 10
#: Bits of the filter for each repeated anchor, and the most bits it may have: 64 MB, the bound of the broadcast.
BITS_PER_ANCHOR = 32
MAX_BITS = 1 << 29
#: Anchors counted more often than this, at most so many of them (the most frequent), are dealt by window.
HOT_COUNT = 10_000
HOT_ANCHORS = 65_536
#: Passages that a task remembers to settle copies, and windows of one passage.
SEEN = 200_000
PASSAGE = 64
_PRIME = 0x9E3779B97F4A7C15
_PLACE = "doc_id bigint, row_key bigint"


class SuffixAutomaton:
    """Suffix automaton of word sequences, grown word by word; ``match`` follows a text through it."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, word, q: int) -> int:
        copy = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, word) -> int:
        """Add ``word`` after the sequence that ends in state ``last`` (0: a new sequence); its new state."""
        q = self.next[last].get(word)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.len[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, word, q)
        return new

    def match(self, state: int, length: int, word) -> tuple[int, int]:
        """State and length of the longest suffix of the followed text plus ``word`` that the automaton holds."""
        while state and length <= self.len[self.link[state]]:
            state = self.link[state]  # states may have been split since
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        if word not in self.next[state]:
            return 0, 0
        return self.next[state][word], length + 1

    def statistics(self, words: list) -> list[int]:
        """For each word, how long a sequence that ends there occurred earlier; the words are added."""
        state = length = last = 0
        out = []
        for word in words:
            state, length = self.match(state, length, word)
            out.append(length)
            last = self.extend(last, word)
        return out


def words_of(text: str | None) -> list[bytes]:
    """Runs of other characters than ASCII white space."""
    return text.encode("utf-8", "replace").split() if text else []


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the GRAM-word sequences, the anchors of the windows, and hashes of the windows."""
    import xxhash

    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))

    def joined(a, size_a, b, size_b):
        """hash of size_a words followed by size_b words"""
        n = len(words) - size_a - size_b + 1
        return a[:n] * np.uint64(pow(_PRIME, size_b, 1 << 64)) + b[size_a : size_a + n]

    two = joined(h, 1, h, 1)
    four = joined(two, 2, two, 2)
    eight = joined(four, 4, four, 4)
    gram, window = joined(eight, 8, two, 2), joined(joined(eight, 8, eight, 8), 16, four, 4)

    def mixed(x):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    gram = mixed(gram)
    least, size = gram, 1
    while size < WINDOW - GRAM + 1:
        step = min(size, WINDOW - GRAM + 1 - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    return gram, least, mixed(window)


def _count_anchors(batches) -> Iterator:
    """(anchor, number of places up to 2 in a document), summed over a batch."""
    import pyarrow as pa

    for batch in batches:
        keys, counts = [], []
        for text in batch.column(0):
            words = words_of(text.as_py())
            if len(words) < WINDOW:
                continue
            gram, anchors, _ = _hashes(words)
            own, gram = np.unique(anchors), np.sort(gram)
            keys.append(own)
            counts.append(np.minimum(2, np.searchsorted(gram, own, "right") - np.searchsorted(gram, own, "left")))
        if keys:
            own, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate(counts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(sums)], names=["anchor", "n"])


def _passages(shared):
    """Passages with possibly repeated anchors (``words``), and spans settled within the partition (no words)."""

    def passages(batches) -> Iterator:
        import pyarrow as pa
        import xxhash

        bits, hot = shared.value
        table, mask = np.frombuffer(bits, np.uint8), np.uint64(8 * len(bits) - 1)
        seen: dict[bytes, tuple] = {}

        def spread(*place) -> int:
            return int.from_bytes(xxhash.xxh3_64_digest(repr(place).encode()), "little", signed=True)

        kind = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("shard", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("words", pa.binary())])
        for batch in batches:
            rows = []
            for doc, row_key, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
                words = words_of(text.as_py())
                if len(words) < WINDOW:
                    continue
                _, anchors, windows = _hashes(words)
                at = anchors & mask
                flagged = (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if not flagged.any():
                    continue
                shards = anchors.copy()
                if len(hot):
                    frequent = np.isin(anchors, hot)
                    shards[frequent] = windows[frequent]
                edge = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | (flagged[1:] != flagged[:-1])]))
                settled: list[list[int]] = []
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(shards)], strict=True):
                    if not flagged[a]:
                        continue
                    for start in range(a, b, PASSAGE):
                        stop = min(b, start + PASSAGE)
                        passage = b" ".join(words[start : stop + WINDOW - 1])
                        digest, place = xxhash.xxh3_128_digest(passage), (doc is None, doc or 0, row_key, start)
                        first = seen.get(digest)
                        if first is not None and first < place:
                            if settled and start <= settled[-1][1]:
                                settled[-1][1] = stop
                            else:
                                settled.append([start, stop])
                            continue
                        if len(seen) > SEEN:
                            seen.clear()
                        seen[digest] = place
                        rows.append((doc, row_key, int(shards[a].view(np.int64)), start, stop, passage))
                # settled spans need no neighbours: spread, as all copies of a text share its row_key
                rows += [(doc, row_key, spread(doc, row_key, start), start, stop, None) for start, stop in settled]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind, strict=True)], schema=kind)

    return passages


def _match(batches) -> Iterator:
    """Spans of windows ``[start, stop)`` that started earlier; rows come by shard and in document order."""
    import pyarrow as pa

    kind = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
    shard, known, single, automaton = None, {}, None, None
    for batch in batches:
        rows = []
        for doc, row_key, key, start, stop, passage in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if passage is None:
                rows.append((doc, row_key, start, stop))
                continue
            if key != shard:
                shard, known, single, automaton = key, {}, None, None
            place = (doc, row_key, start)
            if passage in known:
                if known[passage] != place:
                    rows.append((doc, row_key, start, stop))
                continue
            known[passage] = place
            words = passage.split(b" ")
            windows = stop - start
            if automaton is None:
                if single is None and len({tuple(words[i : i + WINDOW]) for i in range(windows)}) == windows:
                    single = words  # alone in its shard so far, and without a window of its own twice
                    continue
                automaton = SuffixAutomaton()
                if single is not None:
                    automaton.statistics(single)
            run = None
            for i, length in enumerate(automaton.statistics(words)[WINDOW - 1 :]):
                if length >= WINDOW:
                    run = [start + i, start + i + 1] if run is None else [run[0], start + i + 1]
                elif run is not None:
                    rows.append((doc, row_key, *run))
                    run = None
            if run is not None:
                rows.append((doc, row_key, *run))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind, strict=True)], schema=kind)


def _filter(repeated: DataFrame) -> bytes:
    """The bits of the repeated anchors, at most MAX_BITS of them."""
    bits = min(MAX_BITS, max(BLOCK_BITS, 1 << (max(1, repeated.count()) * BITS_PER_ANCHOR - 1).bit_length()))
    data = bytearray(bits // 8)
    for row in bitmaps(repeated.select((F.pmod("anchor", F.lit(bits)) + 1).alias("_p")), "_p").toLocalIterator():
        at = (row["_block"] - 1) * (BLOCK_BITS // 8)
        data[at : at + BLOCK_BITS // 8] = row["_map"]
    return bytes(data)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Windows that started earlier, for ``docs(doc_id, row_key, text)``: ``doc_id, row_key, spans``.

    A span ``(start, stop)`` stands for the windows that start in it; a document's spans are one row.
    """
    counted = docs.select("text").mapInArrow(_count_anchors, "anchor bigint, n int")
    repeated = stage(counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")
    hot = [r["anchor"] for r in repeated.where(F.col("n") > HOT_COUNT).orderBy(F.desc("n"), "anchor").limit(HOT_ANCHORS).collect()]
    shared = docs.sparkSession.sparkContext.broadcast((_filter(repeated), np.sort(np.array(hot, np.int64).view(np.uint64))))
    found = docs.select("doc_id", "row_key", "text").mapInArrow(
        _passages(shared), f"{_PLACE}, shard bigint, start int, stop int, words binary")
    ordered = found.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_last("doc_id"), "row_key", "start")
    spans = ordered.mapInArrow(_match, f"{_PLACE}, start int, stop int")
    return spans.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def _kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    import hashlib

    for texts, spans in batches:
        rows = []
        for text, found in zip(texts, spans, strict=True):
            words = words_of(None if pd.isna(text) else text)
            n, kept, at = len(words), [], 0
            for s in [] if found is None else found:
                kept += words[at : max(at, s["start"])]
                at = max(at, s["stop"] + WINDOW - 1)
            kept = b" ".join(kept + words[at:]) if n else b""
            rows.append((n, n - (kept.count(b" ") + 1 if kept else 0), kept.decode(), hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept", "kept_sha256"])


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "removal") -> DataFrame:
    """``docs`` with a struct ``name`` (which must be free): ``n_words, n_removed, kept`` (kept words joined by a space) ``, kept_sha256``."""
    unused(docs, name)
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    keyed = inner.withColumns({"_id": F.col(at[id_col]).cast("long"), "_key": F.xxhash64(at[text_col])})
    spans = repeated_spans(keyed.select(F.col("_id").alias("doc_id"), F.col("_key").alias("row_key"), F.col(at[text_col]).alias("text")))
    joined = keyed.join(spans, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("row_key")), "left")
    kept = F.pandas_udf(_kept, "struct<n_words:bigint,n_removed:bigint,kept:string,kept_sha256:string>")
    return joined.withColumn("_out", kept(F.col(at[text_col]), F.col("spans"))).select(*inner.columns, "_out").toDF(*docs.columns, name)

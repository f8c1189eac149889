"""Bounded-space online packing of tokenised documents.

Each input partition is packed where it is read, with at most ``WINDOWS`` open windows. Whole windows of
a long document leave at once; its rest goes whole to the window that it fits best. When it fits none
and all windows are open, the fullest window is topped up with the head of the piece and leaves full.
Only the windows that are open at a partition's end are left over: less than ``WINDOWS`` windows a
partition. They are merged across partitions by running lengths, and the last sequence is cut into
powers of two, which need no padding.

Each document's ids are those of the tokenizer and then ``END``; how texts are encoded is told at
``encoder``. What a task remembers of words is bounded and ends with the task.

Defined cases: null counts as empty text, which has the one id ``END``; repeated rows are documents of
their own; a null ``doc_id`` is carried; a text of any length is encoded whole and cut into pieces; further
columns are ignored, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sqlcorpus.llm.common import released
from sqlcorpus.session import stage

LENGTH = 2048
WINDOWS = 64
END = 1
#: Words whose ids a task remembers (about 50 bytes each), characters and texts that are encoded at once.
WORDS = 200_000
SLICE_CHARS = 2 << 20
DOCS = 500
#: Marks that are parted from words before words are looked up.
MARKS = '.,;:!?"()-'
#: FIXED VALUES: the steps of a tokenizer under which words are encoded one by one.
BY_WORDS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split", "behavior": "Removed", "invert": True,
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Sequences merged from left-over windows are numbered from here; others by partition and window.
MERGED = 1 << 62
_PIECE = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, part int, window bigint, offset bigint, "
    "ids_crc32 bigint, ids binary, left_over boolean"
)


def encoder(path: str, words: int = WORDS):
    """A function from a list of texts to their ids as little-endian unsigned 32-bit bytes.

    A tokenizer with exactly the steps of ``BY_WORDS`` never joins what blanks or newlines part, so each
    distinct word is encoded once while it is remembered: at most ``words`` words, for the caller's life
    only. Words of ASCII and Latin letters skip the normaliser; any other word takes all steps. Every other
    tokenizer encodes whole texts.
    """
    import json
    import re

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import regex
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    steps = json.loads(tokenizer.to_str())
    special = [t["content"] for t in steps["added_tokens"]]

    def whole(texts):
        return [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    if {k: steps[k] for k in BY_WORDS} != BY_WORDS or any(c.isspace() for t in special for c in t) or not all(t.startswith("<") for t in special):
        return whole

    # words without "<" hold no special token; the others of Latin letters, lower-cased, need no normaliser
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    # the last id of a word, and no other, may be told by a suffix of its token
    suffix, vocabulary = steps["model"].get("end_of_word_suffix"), tokenizer.get_vocab()
    last = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
    last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
    lower_word = "^[a-z\u00DF-\u00F6\u00F8-\u00FF]+$"
    plain = re.compile("[!-;=-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
    parts = regex.compile(BY_WORDS["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
    # the steps make one piece of two marks in a row, and of an apostrophe and some letters
    close_marks = re.compile("[^ \\t\\n\\r0-9A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]{2}")
    none = pa.array([], pa.large_string()), np.zeros(0, dtype="int64"), np.zeros(0, dtype="<u4")
    known = none  # words, their numbers of ids, their ids end to end

    def latin(text):
        try:
            return text.isascii() or bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            return False

    def apart(text):
        """A text in which blanks part the words: Latin text lower-cased, with single marks apart, so that fewer words are distinct."""
        if "<" not in text and latin(text):
            text = text.lower()
            if not close_marks.search(text):
                for mark in MARKS:
                    text = text.replace(mark, f" {mark} ")
        return text.replace("\n", " ")

    def stretches(ids, sizes, which):
        """Ids of the words with the numbers ``which``, end to end, and how many each has."""
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        starts = (np.cumsum(sizes) - sizes)[which]
        return ids[np.arange(lengths.sum()) + np.repeat(starts - (ends - lengths), lengths)], lengths

    def pieces(words):
        """Ids of ``words``, each one piece of lower-case letters, a digit or marks, end to end, and how many each has."""
        ids, sizes = [none[2]], [none[1]]
        for at in range(0, len(words), 1000):
            some = words.slice(at, 1000).to_pylist()
            n, some = len(some), " ".join(some)
            found = np.array(bare.encode_batch_fast([some], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(last[found]) + 1
            if len(ends) != n:
                of = np.array(bare.encode(some, add_special_tokens=False).word_ids, dtype="int64")
                ends = np.searchsorted(of, np.arange(n), side="right")
            ids.append(found)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(new):
        """Ids of all ``new`` words end to end and how many each has, in the order of the third result."""
        easy = pc.match_substring_regex(new, lower_word).to_numpy(zero_copy_only=False)
        numbers: dict[str, int] = {}
        several, of, counts, slow, slow_words = [], [], [], [], []
        for i, w in zip(np.flatnonzero(~easy).tolist(), new.filter(pa.array(~easy)).to_pylist(), strict=True):
            if plain.fullmatch(w):
                found = parts.findall(w.lower())
                several.append(i)
                of += [numbers.setdefault(p, len(numbers)) for p in found]
                counts.append(len(found))
            else:
                slow.append(i)
                slow_words.append(w)
        easy_ids, easy_sizes = pieces(new.filter(pa.array(easy)))
        several_ids, lengths = stretches(*pieces(pa.array(numbers, pa.large_string())), np.array(of, dtype="int64"))
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts, dtype="int64")]
        slow_ids = whole(slow_words)
        ids = [easy_ids, several_ids, np.frombuffer(b"".join(slow_ids), dtype="<u4")]
        sizes = [easy_sizes, np.diff(ends, prepend=0), np.array([len(x) // 4 for x in slow_ids], dtype="int64")]
        order = [np.flatnonzero(easy), np.array(several, dtype="int64"), np.array(slow, dtype="int64")]
        return np.concatenate(ids), np.concatenate(sizes), np.concatenate(order)

    def encode(texts):
        nonlocal known
        out, at = [], 0
        while at < len(texts):
            if len(known[0]) > words:
                known = none
            split, size = [], 0
            while at < len(texts) and size < SLICE_CHARS:
                split.append(apart(texts[at]))
                size, at = size + len(split[-1]), at + 1
            lists = pc.split_pattern(pa.array(split, pa.large_string()), " ")
            coded = lists.flatten().dictionary_encode()
            found = pc.index_in(coded.dictionary, value_set=known[0])
            absent = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
            # places of the slice's distinct words among the known ones
            places = found.fill_null(-1).to_numpy(zero_copy_only=False).astype("int64")
            if len(absent):
                new = coded.dictionary.take(pa.array(absent))
                ids, sizes, order = learn(new)
                places[absent[order]] = len(known[0]) + np.arange(len(order))
                known = (
                    pa.concat_arrays([known[0], new.take(pa.array(order))]),
                    np.concatenate([known[1], sizes]), np.concatenate([known[2], ids]),
                )
            ids, lengths = stretches(known[2], known[1], places[coded.indices.to_numpy()])
            bounds = np.concatenate([[0], np.cumsum(lengths)])[lists.offsets.to_numpy()]
            out += [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return out

    return encode


def _packer(tokenizer: str, length: int, windows: int, keep_ids: bool):
    def pack(batches) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        encode, end, part = encoder(tokenizer), END.to_bytes(4, "little"), TaskContext.get().partitionId()
        kind = pa.schema([
            ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()),
            ("window", pa.int64()), ("offset", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("left_over", pa.bool_()),
        ])
        rows: list[tuple] = []
        opened: list[list] = []  # [number, fill, pieces]
        number = 0

        def leave(window, left_over=False):
            offset = 0
            for doc, start, ids, total in window[2]:
                n = len(ids) // 4
                rows.append((doc, start, n, total, part, window[0], offset, zlib.crc32(ids), ids if keep_ids or left_over else None, left_over))
                offset += n

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind, strict=True)], schema=kind)
            rows.clear()
            return batch

        def encoded(batch):
            """Ids of a batch's documents, a few texts at a time; a long text is encoded whole."""
            for at in range(0, batch.num_rows, DOCS):
                some = batch.slice(at, DOCS)
                yield from zip(some.column(0).to_pylist(), encode([t or "" for t in some.column(1).to_pylist()]), strict=True)

        for batch in batches:
            for doc, ids in encoded(batch):
                ids += end
                total, start = len(ids) // 4, 0
                while total - start >= length:
                    leave([number, length, [(doc, start, ids[4 * start : 4 * (start + length)], total)]])
                    number, start = number + 1, start + length
                rest = total - start
                if not rest:
                    continue
                fits = [w for w in opened if w[1] + rest <= length]
                if fits:
                    best = max(fits, key=lambda w: w[1])
                elif len(opened) < windows:
                    best = [number, 0, []]
                    number += 1
                    opened.append(best)
                else:
                    fullest = max(opened, key=lambda w: w[1])
                    head = length - fullest[1]
                    fullest[2].append((doc, start, ids[4 * start : 4 * (start + head)], total))
                    leave(fullest)
                    start, rest = start + head, rest - head
                    best = [number, 0, []]
                    number += 1
                    opened[opened.index(fullest)] = best
                best[1] += rest
                best[2].append((doc, start, ids[4 * start :], total))
                if best[1] == length:
                    leave(best)
                    opened.remove(best)
            if rows:
                yield out()
        for window in opened:
            leave(window, left_over=True)
        if rows:
            yield out()

    return pack


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    length: int = LENGTH, windows: int = WINDOWS, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and
    ``ids`` (the piece's ids as little-endian bytes; null unless ``keep_ids``).

    ``length`` is a power of two. The online pass is staged once; merging reads its left-over rows only.
    """
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    pieces = stage(texts.mapInArrow(released(_packer(tokenizer, length, windows, keep_ids)), _PIECE), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    closed = pieces.where("NOT left_over").withColumn("sequence_id", F.col("part").cast("long") * (1 << 32) + F.col("window"))
    merged = merge(pieces.where("left_over"), length)
    if not keep_ids:
        merged = merged.withColumn("ids", F.lit(None).cast("binary"))
    return closed.select(*columns).unionByName(merged.select(*columns))


def merge(left: DataFrame, length: int) -> DataFrame:
    """Left-over pieces laid end to end and cut every ``length`` ids; the last stretch at powers of two.

    The running length is one within partitions and one over the partitions' sums.
    """
    sums = left.groupBy("part").agg(F.sum("length").alias("_sum"))
    before = F.sum("_sum").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("part", F.coalesce(before, F.lit(0)).alias("_base"), F.sum("_sum").over(W.partitionBy()).alias("_total"))
    inner = F.sum("length").over(W.partitionBy("part").orderBy("window", "offset").rowsBetween(W.unboundedPreceding, -1))
    placed = left.withColumn("_from", F.coalesce(inner, F.lit(0))).join(sums, "part").withColumn("_from", F.col("_from") + F.col("_base"))
    size, full = F.lit(length), F.floor(F.col("_total") / length) * length
    rest = F.col("_total") - full
    bits = length.bit_length() - 1
    # the powers of two in the rest, largest first, as (start, end, number) after the last full sequence
    tail = F.filter(
        F.array(*[
            F.struct(
                (full + F.floor(rest / (2 << b)) * (2 << b)).alias("lo"),
                (full + F.floor(rest / (2 << b)) * (2 << b) + (1 << b)).alias("hi"),
                (F.floor(full / length) + (bits - b)).alias("no"),
                (F.floor(rest / (1 << b)) % 2 == 1).alias("set"),
            )
            for b in reversed(range(bits))
        ]),
        lambda x: x["set"],
    )
    last = F.col("_from") + F.col("length") - 1
    blocks = F.transform(
        F.sequence(F.floor(F.col("_from") / length), F.floor(last / length)),
        lambda q: F.struct((q * size).alias("lo"), ((q + 1) * size).alias("hi"), q.alias("no"), F.lit(True).alias("set")),
    )
    pieces = (
        placed.withColumn("_cut", F.explode(F.concat(F.filter(blocks, lambda x: x["hi"] <= full), tail)))
        .withColumn("_a", F.greatest(F.col("_from"), F.col("_cut.lo")))
        .withColumn("_b", F.least(last + 1, F.col("_cut.hi")))
        .where("_a < _b")
    )
    skip = F.col("_a") - F.col("_from")
    ids = F.substring(F.col("ids"), (4 * skip + 1).cast("int"), (4 * (F.col("_b") - F.col("_a"))).cast("int"))
    return pieces.select(
        "doc_id", (F.col("start") + skip).alias("start"), (F.col("_b") - F.col("_a")).alias("length"), F.crc32(ids).alias("ids_crc32"),
        "doc_tokens", (F.lit(MERGED) + F.col("_cut.no")).alias("sequence_id"), (F.col("_a") - F.col("_cut.lo")).alias("offset"), ids.alias("ids"),
    )

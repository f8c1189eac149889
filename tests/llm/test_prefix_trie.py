"""The trie of conversations against plain Python, with whole and tiny trees."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from sqlcorpus.llm import prefix_trie
from sqlcorpus.llm.prefix_trie import RadixNode, common, insert

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, words int, kind string, _base int"


def rows_of(seed):
    """Shared beginnings, copies, nulls in any column, repeated turns, absent bases, negative ids."""
    random.seed(seed)
    rows = []
    for c in [*range(0, 130), 2000, 2001, -3, -20, 66_000, 131_072]:
        if c % 20 == 0 and c % 3 == 1:
            continue
        script = random.choice([3, 5, 7]) if c % 4 else 3
        for t in range(random.choice([0, 1, 2, 4, 6, 30 if c == 17 else 3])):
            rows.append((c, t, "user" if t % 2 else "assistant", f"turn {script} {t if random.random() < 0.8 else random.random()}  x"))
        rows.append((c, None, None if c % 2 else "system", random.choice([None, "", "be kind"])))
    rows += [(5, 1, "user", "twin b"), (5, 1, "user", "twin a"), (5, 1, "assistant", "z"), (5, None, "a", "b"), (9, 2, "x", "same"), (9, 2, "x", "same")]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None)]
    return rows


def slow(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    original = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    convs = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c > 0 else -1)
        convs[c] = original.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        out.append((
            min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), sum(not kids[x] for x in below), saved,
            hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("turns,bits,parts", [(100_000, 16, 1), (4, 3, 5), (1, 0, 3)])
def test_trie(spark, monkeypatch, turns, bits, parts):
    monkeypatch.setattr(prefix_trie, "TREE_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", bits)
    rows = rows_of(turns)
    df = spark.createDataFrame([(*r, "k", 1, "kind", 2) for r in rows], SCHEMA).repartition(parts)
    got = prefix_trie.trie(prefix_trie.grafted(prefix_trie.turns_of(df)))
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(prefix_trie.grafted(prefix_trie.turns_of(df))).count() == 0


def test_one_long_conversation(spark):
    rows = [(1, t, "user", f"word {t % 7} w{t}") for t in range(3000)] + [(2, t, "user", f"word {t % 7} w{t}") for t in range(2990)]
    turns = prefix_trie.turns_of(spark.createDataFrame([(*r, "", 0, "", 0) for r in rows], SCHEMA))
    got = {r.depth: r for r in prefix_trie.trie(turns).collect()}
    assert len(got) == 3001 and got[2990].n_convs == 2 and got[2991].n_convs == 1
    assert got[0].saved_tokens == 3 * 2990 and {r.n_leaves for r in got.values()} == {1}


def test_layouts_grow_and_paths_split():
    random.seed(4)
    keys = {bytes(random.choices(range(256), k=3)) + b"tail" * random.randint(0, 2) for _ in range(3000)} | {b"", b"a", b"ab", b"abc"}
    root, seen = RadixNode(b""), set()
    for key in random.sample(sorted(keys), len(keys)):
        insert(root, key, key)
    todo, found = [(root, b"")], []
    while todo:
        node, at = todo.pop()
        at += node.path
        seen.add(node.room)
        assert node.count == len(node.children()) <= node.room and [b for b, _ in node.children()] == sorted(b for b, _ in node.children())
        assert node.value is not None or node.count > 1 or node is root  # paths are compressed
        if node.value is not None:
            assert node.value == at
            found.append(at)
        todo += [(kid, at + bytes([b])) for b, kid in node.children()]
    assert set(found) == keys and len(found) == len(keys) and seen == {4, 16, 48, 256}


def test_common():
    for a in (b"", b"a", b"ab", b"abcd", b"abxd", b"zz", b"abcdefgh"):
        for b in (b"", b"a", b"abcd", b"abxdzz", b"q", b"abcdefgi"):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert common(a, b) == n

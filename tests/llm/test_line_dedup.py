"""Line deduplication against brute force, and how much of the input its last step works on."""

import random

from sqlcorpus.llm import line_dedup


def tokens(words):
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute(docs):
    lines = {(i, n): tuple(line.lower().split()) for i, text in docs for n, line in enumerate((text or "").split("\n")) if line.split()}
    first, sets = {}, {w: tokens(w) for w in lines.values()}
    for place, w in sorted(lines.items()):
        first.setdefault(w, place)
    links = {w: [v for v in sets if v != w and 5 * len(s & sets[v]) >= 4 * len(s | sets[v])] for w, s in sets.items()}
    out = {}
    for i, _ in docs:
        mine = [(n, w) for (d, n), w in sorted(lines.items()) if d == i]
        best = {n: min(first[v] for v in [w, *links[w]]) for n, w in mine}
        gone = [f"{n}:{best[n][0]}" for n, _ in mine if best[n] < (i, n)]
        out[i] = (len(mine), len(gone), sum(len(links[w]) for _, w in mine), ",".join(gone))
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    plain = [[rng.choice("ab cd EF gh ij kl mn op qr st uv wx yz é".split()) for _ in range(rng.randint(1, 70))] for _ in range(40)]
    made = []
    for words in plain:
        for _ in range(rng.randint(1, 5)):
            near = list(words)
            for _ in range(rng.randint(0, 2)):
                near[rng.randrange(len(near))] = rng.choice(["new", "ab", "cd"])
            made.append(rng.choice([" ", "  ", "\t", " \r"]).join(near) + rng.choice(["", " ", "\t"]))
    rng.shuffle(made)
    made += ["", " \t", "one two", "ONE  two"]
    return [(i, "\n".join(made[i * 4:i * 4 + 4])) for i in range(len(made) // 4 + 1)] + [(1000, None), (1001, "\n\n")]


def test_links_and_removed_lines_are_those_of_brute_force(spark):
    docs = corpus()
    got = line_dedup.report(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_links, r.removed) for r in got} == brute(docs)


def test_links_do_not_depend_on_the_bits_of_posted_tokens(spark, monkeypatch):
    docs = corpus(6)
    monkeypatch.setattr(line_dedup, "TOKEN_BITS", 6)  # tokens that fall together only add candidates
    got = line_dedup.report(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_links, r.removed) for r in got} == brute(docs)


def test_tokens_are_verified_only_for_lines_in_near_pairs(spark, monkeypatch):
    rng, sizes, plain = random.Random(1), [], line_dedup.with_tokens
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(30)] for _ in range(200)]
    # fifty lines that share a run of words and are not similar, and one that is
    for words in texts[:50]:
        words[10:18] = "a shared run of some words for all".split()
    texts.append(["other", *texts[0][1:]])

    def counted(lines, *args):
        sizes.append(lines.count())
        return plain(lines, *args)

    monkeypatch.setattr(line_dedup, "with_tokens", counted)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    removed = [(r.doc_id, r.removed) for r in line_dedup.report(docs).collect() if r.removed]
    assert removed == [(200, "0:0")] and sizes[0] == 201 and sizes[-1] == 2


def test_lines_a_little_too_far_apart_are_told_from_links_before_verification(spark, monkeypatch):
    rng, staged, plain = random.Random(3), {}, line_dedup.stage
    words = [f"w{rng.randrange(10**6)}" for _ in range(72)]
    # one word changed in each at a place of its own: every two have 58 of 78 tokens, and are no links
    lines = [" ".join(words[:k] + [f"x{k}"] + words[k + 1:]) for k in range(5, 65, 5)]

    def seen(df, name):
        staged[name] = plain(df, name)
        return staged[name]

    monkeypatch.setattr(line_dedup, "stage", seen)
    got = line_dedup.report(spark.createDataFrame(list(enumerate(lines + lines[:3])), "doc_id bigint, text string")).collect()
    assert sum(r.n_links for r in got) == 0 and sorted(r.removed for r in got if r.removed) == ["0:0", "0:1", "0:2"]
    assert staged["near-lines"].count() <= 6  # of 66 pairs


def test_copies_of_a_line_have_one_sketch(spark):
    text = " ".join(f"v{i % 23}" for i in range(40))
    docs = spark.createDataFrame([(i, i, text) for i in range(3)], "_row bigint, _id bigint, _text string").repartition(1)
    rows = line_dedup._sketches(line_dedup._lines(docs)).collect()
    assert len(rows) == 1 and rows[0]["n"] == 23 and sum(bin(rows[0][f"bits{k}"] & (2**64 - 1)).count("1") for k in range(line_dedup.SKETCH)) % 2 == 1

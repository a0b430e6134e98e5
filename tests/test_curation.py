"""Near duplicates of turns against brute force."""

import random

import pytest

from millrace.operators import curation


@pytest.mark.parametrize("least", [0.92, 0.4])
def test_keep_first_equals_brute_force(spark, least):
    """Pairs that differ in the first word or lie on either side of a power of two in length, chains, copies, tiny texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = " ".join(word() for _ in range(36))
    texts = ["", "", "a", "aaa", "aaaa", "aaab", "abc", base, "X" + base, base[:254], base[:256], base[:252] + "zz", base.replace(base[:6], "zzzzzz", 1)]
    for _ in range(30):
        w = base.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(36)] = word()
        texts.append(" ".join(w))
    rows = [(i, "user", s) for i, s in enumerate(texts)] + [(100, "other", base)]
    kept = []
    for i, role, s in rows:
        g = curation.trigrams(s)
        if not any(r == role and len(g & k) >= least * len(g | k) for _, r, k in kept):
            kept.append((i, role, g))
    got = curation.keep_first(spark.createDataFrame(rows, "id bigint, role string, shape string"), least)
    assert sorted(r.id for r in got.collect()) == [i for i, _, _ in kept]


def test_query_crosses_openings_and_lengths(spark, tmp_path):
    base = " ".join("w" + chr(97 + i % 26) + chr(97 + i // 3) + "xyz"[i % 3] for i in range(60))
    rows = [(1, 0, "user", base[:256]), (2, 0, "user", base[:254]), (3, 0, "user", "Zq" + base[2:256])]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    from millrace.registry import QUERIES

    assert [r.id for r in QUERIES["dedup_near_trigram"](spark, str(tmp_path)).collect()] == [1000]


def test_candidates_are_few_and_none_is_missed(spark):
    """Texts of common trigrams: the keys in common lead to few pairs that are not near, and to every pair that is."""
    rng, parts = random.Random(3), ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", " ", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 160))) for _ in range(500)]
    texts += [t[: len(t) - k] + "x" * (k % 2) for t in texts[:200] for k in (1, 2, 3, 5)] + ["", "a", "ab", "abc"]
    three, n = curation.trigram_sets(texts)
    grams = [curation.trigrams(t) for t in texts]
    assert n.tolist() == [len(g) for g in grams]
    sets, keys = curation.signatures(three, n, 0.92)
    assert len(keys) < 30 * len(texts)
    groups = {}
    for i, k in zip(sets.tolist(), keys.tolist(), strict=True):
        groups.setdefault(k, set()).add(i)
    met = {(i, j) for g in groups.values() for i in g for j in g if i < j}
    near = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(grams[i] & grams[j]) >= 0.92 * len(grams[i] | grams[j])}
    assert near <= met and len(met) < 4 * len(near)
    p, q = curation.sketches(three, n)
    for i, j in near:
        differ = int(p[i] ^ p[j]) & (1 << 64) - 1, int(q[i] ^ q[j]) & (1 << 64) - 1
        assert sum(x.bit_count() for x in differ) <= len(grams[i] ^ grams[j])

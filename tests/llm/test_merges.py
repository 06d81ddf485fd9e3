"""Token counts by whole numbers and aging caches, against plain merging."""

import random

from millrace.llm.token_counts import AgingCache, Merges, merged_length


def plain(symbols, ranks):
    symbols = list(symbols)
    while found := [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]:
        _, i = min(found)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return len(symbols)


def test_random_merges():
    rng = random.Random(3)
    for _ in range(200):
        known, ranks = list("abcd"), {}
        for rank in range(12):
            pair = rng.choice(known), rng.choice(known)
            if pair not in ranks:
                ranks[pair] = rank
                known.append("".join(pair))
        merges = Merges(ranks)
        for n in (0, 1, 2, 3, 9, 40):
            word = rng.choices("abcde", k=n)
            assert merged_length([merges.id_of(s) for s in word], merges) == plain(word, ranks)


def test_used_entries_stay_in_an_aging_cache():
    made = []
    cache = AgingCache(lambda key: made.append(key) or 7, 0.05)
    for i in range(2000):
        assert cache[f"rare {i}"] == cache["often"] == 7
    assert made.count("often") == 1 and len(made) == 2001
    assert len(cache) + len(cache.older) < 500
    cache.clear()
    assert not cache and not cache.older and cache.held == 0

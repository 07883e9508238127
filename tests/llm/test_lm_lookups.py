import numpy as np

from tabulight.llm import lm_scoring, words


def test_frequent_ngrams_are_probed_once():
    """Levels equal those of plain probing, in every part, and the filter is asked only once for what comes often."""
    rng = np.random.default_rng(5)
    grams = words.mix(np.arange(1, 6001, dtype=np.uint64))
    counts = np.where(np.arange(6000) < 1000, 50, 1)
    bits = lm_scoring.filter_bits(grams, counts)
    for order in (0, 1):
        size = np.zeros((lm_scoring.ORDERS, 1), np.int64)
        size[order] = len(bits)
        known = lm_scoring.Filter(bits, np.zeros_like(size), size)
        lookup, asked = lm_scoring.Lookup(known, order), []
        plain = known.levels
        known.levels = lambda g, o, plain=plain, asked=asked: (asked.append(len(g)), plain(g, o))[1]
        for _ in range(3):
            some = np.concatenate((rng.choice(grams[:1000], 20_000), grams[1000:3000], words.mix(rng.integers(1 << 40, 1 << 50, 500).astype(np.uint64))))
            assert (lookup.levels(some) == plain(some, order)).all()
        assert asked[2] < 4000 < len(some)


def test_places_are_those_of_a_binary_search():
    rng = np.random.default_rng(6)
    for size in (1, 40, 90_000):
        grams = np.sort(rng.integers(0, 1 << 64, size, np.uint64, endpoint=False))
        ends = np.array([0, (1 << 64) - 1], np.uint64)
        asked = np.concatenate((grams, grams + np.uint64(1), rng.integers(0, 1 << 64, 5000, np.uint64), ends))
        assert (lm_scoring.Sorted(grams).places(asked) == np.searchsorted(grams, asked)).all()


def test_words_are_cut_and_hashed_as_one_by_one():
    texts = [b"", b"  ", b"One two\tTHREE", b"\n\n x\x0by ", b"end", "Ä ä ß".encode()]
    for values in (words.VALUES, words.EXACT_VALUES):
        hashes, edges = words.word_hashes(texts, values)
        assert np.diff(edges).tolist() == [0, 0, 3, 2, 1, 3]
        single = [words.word_hashes([w], values)[0] for t in texts for w in t.split()]
        assert (hashes == np.concatenate(single)).all()

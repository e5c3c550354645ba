"""Properties of the parts that need no session."""

from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shutterlake.llm import mixing, packing, simhash, token_counts, token_output, warc

from . import brute


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60), st.sampled_from([1, 8, 64, 1024]))
def test_pack_places_every_token_once_without_padding(lengths, sequence):
    rows = packing.pack(lengths, sequence)
    pieces, used = defaultdict(list), defaultdict(list)
    for doc, start, n, s, offset in rows:
        pieces[doc].append((start, n))
        used[s].append((offset, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, k in sorted(pieces[doc]):
            assert start == at and k > 0
            at += k
        assert at == n
    for own in used.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= sequence and at & (at - 1) == 0
    assert sorted(used) == list(range(len(used)))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**63))
def test_permutation(n, key):
    slots = token_output.permuted(np.arange(n), n, key)
    assert np.array_equal(np.sort(slots), np.arange(n))
    assert np.array_equal(token_output.permuted(slots, n, key, inverse=True), np.arange(n))


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=3)), st.integers(0, 10**6), max_size=8))
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert list(got) == sorted(sizes, key=lambda s: (s is None, s or ""))
    assert all(0 <= got[s] <= 3 * sizes[s] + 1e-6 for s in sizes)
    assert abs(sum(got.values()) - sum(sizes.values())) <= 1e-6 * max(1, sum(sizes.values()))
    want = brute.targets(sizes)
    assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in sizes)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=6), st.integers(1, 20), st.integers(0, 10))
def test_split_is_exact(quotas, shards, seed):
    total = sum(quotas)
    capacities = np.full(shards, total // shards) + (np.arange(shards) < total % shards)
    got = np.zeros((shards, len(quotas)), np.int64)
    for shard, sources, units in mixing.split(np.arange(len(quotas)), np.array(quotas), capacities, np.random.default_rng(seed)):
        got[shard, sources] += units
    assert got.sum(axis=0).tolist() == quotas and got.sum(axis=1).tolist() == capacities.tolist() and (got >= 0).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(0, 50)), max_size=14, unique_by=lambda x: x[0]), st.floats(0, 300))
def test_closest_subset_is_the_nearest(rows, left):
    rows = sorted(rows)
    taken = mixing._closest(rows, left)
    sums = {0}
    for _, n in rows:
        sums |= {s + n for s in sums}
    got = sum(n for k, n in rows if k in taken)
    assert abs(got - left) <= min(abs(s - left) for s in sums) + 1e-9


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=120))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode("utf-8", "replace")) == brute.simhash(text.encode("utf-8", "replace").decode())


def test_token_counts_of_any_text():
    from tokenizers import Tokenizer

    from shutterlake.llm import queries

    path = queries.tokenizer("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_counts.Lengths(open(path, encoding="utf-8").read(), {})

    @settings(max_examples=200, deadline=None)
    @given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n'sé!İΣ\x1c\x85")), max_size=60))
    def check(text):
        assert own.count(text.encode()) == len(library.encode(text, add_special_tokens=False))

    check()


def test_token_ids_of_any_text():
    from tokenizers import Tokenizer

    from shutterlake.llm import queries, token_ids

    path = queries.tokenizer("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_ids.Encoder(token_ids.tokenizer_text(path))

    @settings(max_examples=200, deadline=None)
    @given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n'sé!　\x1c\x85\xa0")), max_size=60))
    def check(text):
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids

    check()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("<>/!-ab \"'=&;pscript"), max_size=80))
def test_any_page_is_read(page):
    text, title, links = warc.read_page(page)
    assert isinstance(text, str) and "\n\n" not in text

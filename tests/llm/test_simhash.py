from collections import Counter

import numpy as np
import pytest
import xxhash

from ambilens.llm import simhash
from ambilens.llm.components import connected_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(codes, distance):
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    codes = np.array(codes, np.uint64)
    for a, b in zip(*np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None]) <= distance)):
        parent[find(a)] = find(b)
    return [find(i) for i in range(len(codes))]


def near_codes(rng, n):
    """Random codes, and chains and dense balls of near ones."""
    centres = rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    codes = [int(c) for c in rng.integers(0, 1 << 63, n, dtype=np.uint64)]
    for centre in centres:
        for _ in range(40):
            code = int(centre)
            for bit in rng.integers(0, 64, 3):
                code ^= 1 << int(bit)
            codes.append(code)
    return sorted(set(codes))


@pytest.mark.parametrize("leaf_rows", [4, 50, 10_000])
def test_links_have_the_components_of_all_pairs(spark, leaf_rows):
    codes = near_codes(np.random.default_rng(leaf_rows), 300)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), 2, leaf_rows).collect()
    parent = dict.fromkeys(signed)
    parent = {c: c for c in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        assert r.a in parent and r.b in parent
        parent[find(r.a)] = find(r.b)
    whole = components(codes, 2)
    pairs = Counter(zip(map(find, signed), whole))
    assert len(pairs) == len(set(whole)) == len({find(c) for c in signed})
    assert len(links) < 2 * len(codes) * 8


def test_gray_rank():
    codes = np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(8))
    assert simhash.gray_rank(np.array([1 << 63], np.uint64))[0] == (1 << 64) - 1


def test_leaf_search_meets_every_pair():
    codes = np.array(near_codes(np.random.default_rng(5), 200), np.uint64)
    members = codes[np.argsort(simhash.gray_rank(codes))]
    met = {(int(a), int(b)) for left, right in simhash.leaf_links(members, members[:0], 2) for a, b in zip(left, right)}
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 2
    assert met == {(int(codes[a]), int(codes[b])) for a, b in zip(*np.nonzero(near))}


def test_documents_like_brute_force(sf_docs, plain_docs):
    found = {r.doc_id: r for r in simhash.near_duplicates(sf_docs).collect()}
    prints = [plain_fingerprint(text) for _, text, *_ in plain_docs]
    assert [int(found[d].fingerprint, 16) for d, *_ in plain_docs] == prints
    roots = components(prints, 2)
    first = {}
    for (doc, *_), root in zip(plain_docs, roots):
        first.setdefault(root, doc)
    assert [found[d].component_id for d, *_ in plain_docs] == [first[r] for r in roots]


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    of = {r.doc_id: r for r in rows}
    assert of[2].fingerprint == of[3].fingerprint == "0" * 16 and of[3].component_id == 2
    assert of[4].component_id == 1 and sum(r.doc_id == 1 for r in rows) == 2
    assert simhash.near_duplicates(no_docs).count() == 0


def test_words_as_defined():
    assert simhash.fingerprint("A B\tC\x0bD".encode()) == simhash.fingerprint(b"a b c d")
    assert simhash.fingerprint("É b c".encode()) != simhash.fingerprint("é b c".encode())
    assert simhash.fingerprint("a b".encode()) == xxhash.xxh64_intdigest("a b".encode(), 42)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (139, 90)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(1, 61)} == {1} and {found[i] for i in range(100, 140)} == {90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

"""Near-duplicate components against brute force."""

import random
import string
import tracemalloc

import numpy as np
import pytest

from quinhao.llm import parity_join
from quinhao.llm.components import components
from quinhao.llm.shingles import shingle_set

LOWER = {ord(c): c.lower() for c in string.ascii_uppercase}


def shingles(text):
    words = (text or "").translate(LOWER).encode().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if not x or not y or sets[a][0] is None or sets[b][0] is None:
                continue
            if 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return sorted(
        ((d, len(s), least[find(k)] if d is not None else None) for k, (d, s) in enumerate(sets)),
        key=repr,
    )


def made_rows(seed, n=150):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 6)))
    bases = [[word() for _ in range(rnd.choice([3, 6, 9, 20, 60, 200]))] for _ in range(25)]
    rows = []
    for k in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
            at = rnd.randrange(len(words))
            what = rnd.random()
            if what < 0.4:
                words[at] = word()
            elif what < 0.7:
                words.insert(at, word())
            elif len(words) > 1:
                del words[at]
        rows.append((1000 - 7 * k, rnd.choice([" ", "  ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(make, clash, seed, rows_of):
    rows = made_rows(seed)
    assert rows_of(parity_join.near_duplicates(clash(make(rows)))) == brute(rows)


def test_labels_decide_no_link(make, rows_of, monkeypatch):
    """Sets that get their label from a single key are compared across labels instead."""
    monkeypatch.setattr(parity_join, "MEETINGS", 1)
    rows = made_rows(4)
    assert rows_of(parity_join.near_duplicates(make(rows))) == brute(rows)


def test_copies_that_are_linked_with_their_source_only(make, rows_of):
    """A hub whose copies are not linked with each other, and a chain."""
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    rows = [(50, " ".join(words))]
    for k in range(40):
        copy = list(words)
        for at in rnd.sample(range(200), 5):
            copy[at] = f"x{rnd.randrange(10**6)}"
        rows.append((100 + k, " ".join(copy)))
    chain = [f"c{k}" for k in range(160)]
    rows += [(10 + k, " ".join(chain[8 * k : 8 * k + 80])) for k in range(11)]
    assert rows_of(parity_join.near_duplicates(make(rows))) == brute(rows)


def test_odd_rows(odd, odd_rows, clash, rows_of):
    assert rows_of(parity_join.near_duplicates(clash(odd))) == brute(odd_rows)


def test_pigeonhole_never_misses_a_link():
    """Linked sets agree in enough of their parts in a band that both are in."""
    rnd = np.random.default_rng(3)
    for _ in range(600):
        n = int(rnd.integers(3, 400))
        a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        change = int(rnd.integers(0, len(a) // 3 + 1))
        b = np.unique(
            np.concatenate([a[change:], rnd.integers(0, 1 << 63, int(rnd.integers(0, change + 1)), dtype=np.uint64)])
        )
        if not parity_join.linked(a, b) or min(len(a), len(b)) < parity_join.LEAST_SIZE:
            continue
        for x, y in ((a, b), (b, a)):
            other = np.concatenate([k for _, _, k in parity_join.band_keys(y)])
            shared = [
                (need, int(np.isin(keys, other).sum()))
                for _, need, keys in parity_join.band_keys(x)
            ]
            assert any(count >= need for need, count in shared)


def test_linked_sets_meet_on_a_part_of_their_sketches():
    """Whatever the counters say, linked sets have one of their rarest keys in common."""
    rnd = np.random.default_rng(6)
    tried = 0
    for k in range(1500):
        n = int(rnd.integers(3, 40 if k % 2 else 600))
        if k % 100 == 0:
            counts = rnd.integers(0, 4, 1 << parity_join.CELL_BITS, dtype=np.uint32)
        a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        change = int(rnd.integers(0, len(a) // 3 + 1))
        more = rnd.integers(0, 1 << 63, int(rnd.integers(0, change + 1)), dtype=np.uint64)
        b = np.unique(np.concatenate([a[change:], more]))
        if min(len(a), len(b)) < parity_join.LEAST_SIZE or not parity_join.linked(a, b):
            continue
        tried += 1
        keys = [parity_join.meeting_keys(x, counts) for x in (a, b)]
        assert np.isin(*keys).any()
    assert tried > 300


def test_only_rare_parts_are_joined():
    """A third of a set's size, and less than the set's shingles, in its own band."""
    rnd = np.random.default_rng(7)
    counts = np.zeros(1 << parity_join.CELL_BITS, dtype=np.uint32)
    for n in (64, 100, 127, 1000, 5000):
        a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        bands = list(parity_join.band_keys(a))
        assert len(parity_join.meeting_keys(a, counts)) == len(bands) * (len(a) // 3 + 1)


def test_sketch_distance_never_exceeds_the_difference():
    rnd = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(rnd.integers(0, 500, 200, dtype=np.uint64)) for _ in range(2))
        sketches = [parity_join.bit_sketch(parity_join.mix(x), 4) for x in (a, b)]
        distance = int(np.bitwise_count(sketches[0] ^ sketches[1]).sum())
        assert distance <= len(np.setxor1d(a, b))
        assert parity_join.linked(a, a)


def test_shingles_of_bytes():
    for text in ("", "  ", "one", "a b c d", "a b c d e", "A\tb  c\nd e f", "x " * 50, "é Ü ß a b É"):
        data = np.frombuffer(text.encode(), np.uint8)
        assert len(shingle_set(data)) == len(shingles(text)), text
    same = [shingle_set(np.frombuffer(t, np.uint8)) for t in (b"A b c d e f", b"a  B\nc D e\tf ")]
    assert (same[0] == same[1]).all()


def test_words_across_pieces(monkeypatch):
    from quinhao.llm import shingles as module

    rnd = random.Random(1)
    text = " ".join("w" * rnd.randrange(1, 90) + str(rnd.randrange(99)) for _ in range(300)).encode()
    data = np.frombuffer(text, np.uint8)
    whole = module.word_hashes(data)
    monkeypatch.setattr(module, "PIECE", 64)
    assert (module.word_hashes(data) == whole).all()


def test_one_of_each(make, clash, rows_of, holds_schema):
    rows = [*made_rows(5, 60), (7, None), (8, ""), (None, "a b c d e f"), (None, "a b c d e f")]
    rows += [rows[0], rows[0]]
    docs = clash(make(rows))
    kept = parity_join.one_of_each(docs)
    assert holds_schema(docs, kept)
    got = rows_of(kept.select("doc_id", "text"))
    want = {(d, r[1]) for r, (d, _, c) in zip(sorted(rows, key=lambda r: repr(r[0])), sorted(brute(rows), key=lambda r: repr(r[0]))) if d == c}
    ids = [d for d, _ in got if d is not None]
    assert ids == sorted(set(ids), key=repr) and set(ids) == {d for d, _ in want if d is not None}
    assert sum(d is None for d, _ in got) == 2


def test_two_texts_of_one_id(make, rows_of):
    """A near copy goes, whatever other text has its id; clean texts stay, run after run."""
    rnd = random.Random(12)
    body = [f"w{rnd.randrange(999)}" for _ in range(80)]
    near = " ".join([*body[:-1], "other"])
    clean = [" ".join(f"c{rnd.randrange(999)}" for _ in range(50)) for _ in range(3)]
    rows = [
        (5, " ".join(body)), (5, clean[0]), (9, near), (9, clean[1]), (11, near), (11, clean[2]),
        (5, " ".join(body)), (7, ""), (7, " "), (7, None), (7, ""),
    ]
    want = {(5, " ".join(body)), (5, clean[0]), (9, clean[1]), (11, clean[2]), (7, " ")}
    for partitions in (1, 3):
        got = rows_of(parity_join.one_of_each(make(rows, partitions)).select("doc_id", "text"))
        assert {(d, t) for d, t in got if (t or "").strip() or t == " "} == want
        assert len(got) == len(want) + 1  # of the empty and the null text, which are equal, one


def test_empty(empty):
    assert parity_join.near_duplicates(empty).count() == 0
    assert parity_join.one_of_each(empty).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(7, 7), (3, 5)]
    edges += edges
    got = dict(
        tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    )
    want = dict.fromkeys(range(100, 161), 100) | dict.fromkeys([3, *range(5, 40)], 3)
    assert got == want


def test_packing_a_tasks_keys_takes_bounded_memory():
    """Millions of keys, and sets that have many in common; of equal keys two are shipped."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    made = told = shipped = 0

    def sets():
        for k in range(35_000):
            own = rng.integers(0, 1 << 63, 50 if k % 50 == 0 else 200, dtype=np.uint64)
            yield k, np.unique(np.concatenate([own, common]) if k % 50 == 0 else own)

    def keys_of(shingles):
        nonlocal made
        for unit, need, keys in parity_join.band_keys(shingles):
            made += len(keys)
            yield unit, need, keys

    tracemalloc.start()
    for batch in parity_join._emit(sets(), keys_of, 6, 5):
        for entries, replies in zip(batch["entries"].to_pylist(), batch["replies"].to_pylist()):
            shipped += len(entries or b"") // parity_join.ENTRY.itemsize
            found = np.frombuffer(replies or b"", dtype=parity_join.REPLY)
            told += int(found["count"].sum())
            assert not len(found) or (found["set"] % 50 == 0).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made > 2_500_000 and told > 0 and told + shipped == made
    assert peak < 100e6, peak

"""Repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from quinhao.llm import suffix_dedup


def brute(rows, length, keep):
    """Kept bytes of each row; for keep="first", repeated rows are one document."""
    datas = [(r[0], (r[1] or "").encode()) for r in rows]
    counts, out = {}, []
    for k, (_, data) in enumerate(datas):
        for i in range(len(data) - length + 1):
            counts.setdefault(data[i : i + length], []).append((k, i))
    order = sorted(
        range(len(datas)), key=lambda k: (-(1 << 63) if datas[k][0] is None else datas[k][0], k)
    )
    seen, gone = set(), {}
    done = {}
    for k in order:
        doc_id, data = datas[k]
        if keep == "first" and (doc_id, data) in done:
            gone[k] = gone[done[doc_id, data]]
            continue
        done[doc_id, data] = k
        marks = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            hit = len(counts[window]) > 1 if keep == "none" else window in seen
            if hit:
                marks[i : i + length] = True
            seen.add(window)
        gone[k] = marks
    for k, (doc_id, data) in enumerate(datas):
        out.append((doc_id, np.frombuffer(data, np.uint8)[~gone[k]].tobytes(), gone[k]))
    return out


def made_rows(seed):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice("abc é") for _ in range(rnd.randrange(5, 90))) for _ in range(6)]
    rows = []
    for k in range(80):
        parts = [
            rnd.choice(passages)
            if rnd.random() < 0.4
            else "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(60)))
            for _ in range(rnd.randrange(1, 7))
        ]
        rows.append((k, "".join(parts)))
    rows += [(200 + k, rows[3][1]) for k in range(5)]
    rows += [(300, "ab" * 120), (301, "ab" * 40 + "x"), (302, "a" * 200), (303, None), (304, "")]
    return rows


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("seed", [1, 2])
def test_removed_bytes_equal_brute_force(make, clash, keep, seed, rows_of):
    rows = made_rows(seed)
    got = suffix_dedup.dedup_bytes(clash(make(rows)), 24, keep)
    have = rows_of(got.select("doc_id", "kept"))
    want = [(d, bytearray(b)) for d, b, _ in brute(rows, 24, keep)]
    assert have == sorted(want, key=repr)


def whole_characters(text: str, gone: np.ndarray) -> str:
    ends = np.cumsum([len(c.encode()) for c in text])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else []
    return "".join(c for c, a, b in zip(text, starts, ends) if not gone[a:b].any())


def test_text_has_the_characters_that_are_kept_whole(make, rows_of):
    shared = b"\xa9 a passage of \xe4\xb8".decode("latin-1")  # bytes of two characters, cut
    middle = shared.encode("latin-1")
    rows = [
        (1, (b"one\xc3" + middle + b"\xad1").decode()),
        (2, (b"two \xc2" + middle + b"\xaa2").decode()),
    ]
    got = rows_of(suffix_dedup.dedup_bytes(make(rows), len(middle), "none").select("kept", "text"))
    want = [(b"one\xc3\xad1", "one1"), (b"two \xc2\xaa2", "two 2")]
    assert got == sorted([(bytearray(a), b) for a, b in want], key=repr)


def test_digests(make, rows_of):
    rows = made_rows(7)
    got = rows_of(suffix_dedup.digests(make(rows), 24))
    want = []
    for (doc_id, kept, gone), row in zip(brute(rows, 24, "none"), rows):
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        want.append(
            (doc_id, len((row[1] or "").encode()), int(gone.sum()), int((edge == 1).sum()),
             hashlib.sha256(kept).hexdigest(), whole_characters(row[1] or "", gone))
        )
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_odd_rows(odd, odd_rows, clash, keep, rows_of):
    got = rows_of(suffix_dedup.dedup_bytes(clash(odd), 64, keep).select("doc_id", "kept"))
    want = [(d, bytearray(b)) for d, b, _ in brute(odd_rows, 64, keep)]
    assert got == sorted(want, key=repr)


def test_pieces_and_crowds(make, rows_of, monkeypatch):
    """Long documents in pieces, tasks that pack often, and minimizers with many texts."""
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdef") for _ in range(120))
    rows = [
        (k, "".join(rnd.choice("uvwxyz") for _ in range(rnd.randrange(50))) + passage
         + "".join(rnd.choice("uvwxyz") for _ in range(50)))
        for k in range(150)
    ]
    for row in rows:
        data = row[1].encode()
        whole = [np.concatenate(x) for x in zip(*suffix_dedup.runs(np.frombuffer(data, np.uint8), 40, 20))]
        assert whole[2][0] == 0 and (whole[3] + 1).sum() == len(data) - 39
    got = rows_of(suffix_dedup.dedup_bytes(make(rows, 1), 40, "none").select("doc_id", "kept"))
    want = [(d, bytearray(b)) for d, b, _ in brute(rows, 40, "none")]
    assert got == sorted(want, key=repr)


def test_a_long_text_in_pieces_has_the_same_minimizers(monkeypatch):
    rnd = random.Random(11)
    data = np.frombuffer("".join(rnd.choice("abc") for _ in range(5000)).encode(), np.uint8)

    def owned():
        found = {}
        for key, _, start, more in suffix_dedup.runs(data, 40, 20):
            for h, s, m in zip(key.tolist(), start.tolist(), more.tolist()):
                found |= dict.fromkeys(range(s, s + m + 1), h)
        return found

    whole = owned()
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert owned() == whole


def test_smaller_positions_against_a_stack():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 300):
        place = rnd.permutation(n)
        before, after = suffix_dedup.smaller_positions(place)
        for r in range(n):
            left = [q for q in range(r) if place[q] < place[r]]
            right = [q for q in range(r + 1, n) if place[q] < place[r]]
            assert before[r] == (left[-1] if left else -1)
            assert after[r] == (right[0] if right else -1)


def test_empty(empty):
    assert suffix_dedup.digests(empty, 24).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeats(empty, keep="last")

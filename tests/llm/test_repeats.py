from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

import affinia.llm.repeats as R
from affinia.llm.repeats import remove_repeats, repeated_strings


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(left).hexdigest())
    return out


def texts(seed):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice("abé \n") for _ in range(rnd.choice((60, 99, 100, 130, 300)))) for _ in range(6)]
    out = ["", None, "x" * 99, "x" * 100, "x" * 101, "ab" * 300]
    for _ in range(30):
        parts = [rnd.choice([*passages, "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 150)))]) for _ in range(rnd.randint(1, 6))]
        out.append("".join(parts))
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(docs_of, seed):
    rows = texts(seed)
    random.Random(seed).shuffle(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in remove_repeats(docs_of(rows).repartition(3, "doc_id"), digest=True).collect()}
    assert got == brute(rows)


def test_one_shard():
    contexts = [(t or "").encode() for _, t in texts(3) if t and len(t.encode()) >= 100]
    seen, want = set(), []
    for c in contexts:
        flags = []
        for k in range(len(c) - 99):
            flags.append(c[k : k + 100] in seen)
            seen.add(c[k : k + 100])
        want.append(flags)
    flags, least = repeated_strings(contexts)
    assert [f.tolist() for f in flags] == want and len(least) == len(seen)


def test_crowded_anchors_slices_and_lots(docs_of, monkeypatch):
    """One gram with many different neighbours: anchors of several shards; long texts in slices."""
    for name, value in (("SHARD", 2000), ("LOT", 5), ("OFTEN", 2), ("SLICE", 150), ("FLUSH", 3000)):
        monkeypatch.setattr(R, name, value)
    rnd = random.Random(9)
    other = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    line = "All rights are reserved by the owner of this page."
    tails = [other(90) for _ in range(6)]
    rows = [(i, other(rnd.randint(0, 90)) + line + rnd.choice(tails)[: rnd.randint(20, 90)] + other(60)) for i in range(80)]
    rows += [(100, "ab" * 400 + rows[3][1] * 3), (101, rows[7][1] + "ab" * 90)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in remove_repeats(docs_of(rows), digest=True).collect()}
    assert got == brute(rows)


def test_anchors_far_into_a_text():
    """A passage past byte 2**26 has the anchors that it has at the start."""
    passage = np.frombuffer(bytes(random.Random(5).choices(range(97, 123), k=300)), np.uint8)
    far = np.concatenate((np.arange(70_000_000, dtype=np.uint32).view(np.uint8)[: (1 << 26) + 5], passage))
    near = {int(k) for _, found in R.sliced(passage, np.array([0, 300])) for k in found[0]}
    late = {int(k) for low, found in R.sliced(far, np.array([0, len(far)])) if low + R.SLICE >= 1 << 26 for k in found[0]}
    assert near and len(near & late) >= len(near) - 1


def test_earlier_strings():
    rnd = np.random.default_rng(1)
    a, b, doc, start = (rnd.integers(0, n, 300) for n in (4, 3, 5, 1000))
    row = np.arange(300)
    first = {}
    for x in zip(a, b, doc, row, start, strict=True):
        key, place = x[:2], x[2:]
        first[key] = min(first.get(key, place), place)
    want = [first[x[:2]] != x[2:] for x in zip(a, b, doc, row, start, strict=True)]
    assert R.earlier_strings(a, b, (doc, row, start)).tolist() == want


def test_round_trip_nulls_and_nothing(docs_of):
    passage = "0123456789" * 12
    got = {(r.doc_id, r.n_removed, bytes(r.kept)) for r in remove_repeats(docs_of([(1, passage + "!"), (2, "é" + passage), (None, passage), (3, None)])).collect()}
    first = {r for r in got if r[0] == 1}
    assert got - first == {(2, 120, "é".encode()), (None, 120, b""), (3, 0, b"")}
    assert remove_repeats(docs_of([])).count() == 0

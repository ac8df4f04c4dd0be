"""SimHash near-duplicates, periodic runs and ranked search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from affinia.llm import periods, ranked, simhash
from affinia.llm.queries import QUERIES, with_repeats

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def smallest_reachable(nodes):
    """nodes: (id, fingerprint); the smallest id reachable by links of at most two bits."""
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(nodes):
        for j in range(i):
            if (a ^ nodes[j][1]).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(nodes):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(nodes))]


def test_golay_code():
    """Each word of 23 bits is within three bits of one codeword: the balls of 4,096 codewords fill them all."""
    bits, errors = simhash._code()
    assert len(set(errors.tolist())) == 2048 and max(e.bit_count() for e in errors.tolist()) == 3
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    for k in range(23):
        rows, found = simhash.near_codewords(words, 23)
        rows2, found2 = simhash.near_codewords(words ^ (1 << k), 23)
        both = set(zip(rows.tolist(), found.tolist(), strict=True)) & set(zip(rows2.tolist(), found2.tolist(), strict=True))
        assert {r for r, _ in both} == set(range(len(words)))


def test_keys_meet_at_every_two_bits():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 20, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    home = [set() for _ in fps]
    for r, k in zip(*simhash.fuzzy_keys(fps), strict=True):
        home[r].add(int(k))
    for i in range(64):
        for j in range(i, 64):
            flip = np.uint64(1 << i) | np.uint64(1 << j)
            there = [set() for _ in fps]
            for r, k in zip(*simhash.fuzzy_keys(fps ^ flip), strict=True):
                there[r].add(int(k))
            assert all(a & b for a, b in zip(home, there, strict=True))


@pytest.mark.parametrize("crowd", [0, 300])
def test_components_of_fingerprints(spark, monkeypatch, crowd):
    """Chains, pairs and a crowd around one fingerprint that shares keys with more than GROUP others."""
    rnd = random.Random(3 + crowd)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:20]:
        at = base
        for _ in range(6):
            for k in rnd.sample(range(64), rnd.randint(1, 3)):
                at ^= 1 << k
            fps.add(at)
    middle = rnd.getrandbits(64)
    for _ in range(crowd):
        at = middle
        for k in rnd.sample(range(44, 64), rnd.randint(0, 6)):
            at ^= 1 << k
        fps.add(at)
    rows = [(i, fp) for i, fp in enumerate(sorted(fps))]
    signed = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in rows]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: docs)
    got = {r.doc_id: r.component_id for r in simhash.near_components(spark.createDataFrame(signed, "doc_id long, fp long")).collect()}
    want = smallest_reachable(rows)
    assert [got[i] for i, _ in rows] == want
    assert len(set(want)) < len(want)


def test_simhash(spark, docs_of):
    rnd = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)] + ["Ärger", "x y", "ÉTÉ"]
    texts = [None, "", " \t\n", "one", "One two", " "]
    for _ in range(30):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 400))]
        texts += [" ".join(words), "\t".join(words).upper() if rnd.random() < 0.3 else " ".join(words[:-1]), " ".join(words[1:])]
    texts.append(" ".join(rnd.choice(vocabulary) for _ in range(90000)))
    rows = [(None if i == 9 else i, t) for i, t in enumerate(texts)] + [(500, texts[8]), (501, texts[8])]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64), r.component_id) for r in simhash.near_components(docs_of(rows)).collect())
    nodes = [(i, fingerprint(t)) for i, t in rows]
    want = sorted((i is None, i or 0, fp, c) for (i, fp), c in zip(nodes, smallest_reachable(nodes), strict=True))
    assert got == want
    assert simhash.near_components(docs_of([])).count() == 0


def test_simhash_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    nodes = [(r.doc_id, fingerprint(r.text)) for r in docs]
    want = {(i, f"{fp:016x}", c) for (i, fp), c in zip(nodes, smallest_reachable(nodes), strict=True)}
    assert {tuple(r) for r in QUERIES["op11_simhash"](spark, SF).collect()} == want


def runs_of(words):
    """By definition: all stretches for each period, the smallest period by trying."""
    found, n = [], len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            start, length = i, j + p - i
            if length >= max(6, 4 * p) and not any(words[start : start + length - q] == words[start + q : start + length] for q in range(1, p)):
                found.append((start, length, p))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_of(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def hard_texts():
    rnd = random.Random(5)
    out = [None, "", "a", "a a a a a", "a a a a a a", "ab " * 7, "A a " * 9]
    for letters in ("ab", "aab", "abc", "abcdefgh"):
        out += [" ".join(rnd.choice(letters) for _ in range(rnd.randint(1, 120))) for _ in range(40)]
    # A period of 11 whose every period holds a run of period 3, and short runs that border on longer ones.
    out += [" ".join("abaabaabaab" * 5), " ".join("x" + "abaabaabaab" * 4 + "abaab"), " ".join("aaaaaaab" * 6 + "c" * 9)]
    for _ in range(60):
        unit = [rnd.choice("ab") for _ in range(rnd.randint(1, 30))]
        text = [rnd.choice("abc") for _ in range(rnd.randint(0, 20))] + (unit * 9)[: rnd.randint(1, len(unit) * 8)] + [rnd.choice("abc") for _ in range(rnd.randint(0, 20))]
        out.append("  ".join(text))
    return out


def test_runs_by_definition(spark, docs_of):
    texts = hard_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b b b b b b b"), (3, texts[3])]
    got = periods.collapse(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = sorted(((r.doc_id is None, r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed, r.n_words, r.lang) for r in got), key=str)
    want = []
    for i, t in rows:
        words = WORD.findall(t or "")
        runs = runs_of(words)
        want.append((i is None, i or 0, runs, collapsed_of(words, runs), len(words), "en"))
    assert by == sorted(want, key=str)
    assert sum(len(w[2]) for w in want) > 150
    assert periods.collapse(docs_of([])).count() == 0
    with pytest.raises(ValueError, match="runs"):
        periods.collapse(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, runs long"))


@pytest.mark.parametrize("seed", range(6))
def test_long_periods(seed):
    """Periods over SHORT are probed for each text on its own; short runs lie within and across their border."""
    rnd = random.Random(seed)
    p = rnd.randint(257, 600)
    unit = [rnd.choice("abcdefghij") for _ in range(p)]
    if seed % 2:
        unit[10:80] = "ab" * 35
    if seed == 3:
        unit = list("a" * (p - 1) + "b")
    long = [rnd.choice("abc") for _ in range(rnd.randint(0, 300))] + (unit * 6)[: rnd.randint(4 * p, 6 * p)] + list("c" * 40) + [rnd.choice("abcdefghij") for _ in range(200)]
    texts = [" ".join(rnd.choice("ab") for _ in range(50)), " ".join(long), "", " ".join("a" * 2000)]
    column = pa.array(texts)
    from affinia.llm.hashing import WHITE, buffers
    from affinia.llm.tokens import words

    data, at = buffers(column)
    found, first = words(data, ~WHITE[data], at)
    text, runs = periods.find_runs(found.dictionary_encode().indices.to_numpy(), first)
    for k, t in enumerate(texts):
        assert [(s, e - s, q) for s, e, q in runs[text == k].tolist()] == runs_of(t.split()), k
    assert any(q == p for _, _, q in runs.tolist())


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_repeats_are_planted_by_the_rule(spark, docs_of):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 60)))) for i in range(300)] + [(None, "a b"), (1000, None)]
    got = {r.doc_id: WORD.findall(r.text or "") for r in with_repeats(docs_of(rows)).collect()}
    assert got == {i: planted(i, WORD.findall(t or "")) for i, t in rows}


def test_runs_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 8000 OR text IS NULL").collect()
    got = {r.doc_id: r for r in QUERIES["op12_periods"](spark, SF).collect()}
    for r in docs:
        words = planted(r.doc_id, WORD.findall(r.text or ""))
        runs = runs_of(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        g = got[r.doc_id]
        assert (g.n_runs, g.start, g.length, g.period) == (len(runs), *best)
        assert g.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert g.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert g.collapsed_sha256 == hashlib.sha256(collapsed_of(words, runs).encode()).hexdigest()
    assert sum(g.n_runs for g in got.values()) > 5


def ranked_by_hand(docs, items, best):
    held = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    N, L = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c, n in held:
            m = 100 - 50 + 50 * n * N // L
            score = 0
            for t in set(TERM.findall(lower(text))):
                if t in c:
                    score += math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
            if score:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(rows)[:best])]
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


@pytest.mark.parametrize("most", [1 << 20, 12, 1])
def test_search(spark, docs_of, most):
    rnd = random.Random(7)
    vocabulary = [f"t{k}" for k in range(60)] + ["Über", "日本", "a_b", "x-1"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.randint(0, 80)))) for i in range(200)]
    docs += [(None, docs[5][1]), (300, docs[5][1]), (5, docs[5][1]), (301, None), (302, "--- !!"), (303, "T0 t0 t0 "), (304, " ".join(rnd.choices(vocabulary, weights, k=60000)))]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 9)))) for i in range(12)] + [(20, None), (21, "?"), (None, "t1 t2"), (3, "t1 t2"), (22, "never seen")]
    table = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, score string")
    got = ranked.search(docs_of(docs), table, best=7, most=most)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(ranked_by_hand(docs, items, 7), key=key)


def test_search_without_rows(spark, docs_of):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(docs_of([]), items).count() == 0
    assert ranked.search(docs_of([(1, "a")]), items.limit(0)).count() == 0
    assert ranked.search(docs_of([(1, "b"), (2, None)]), items).count() == 0


def test_radix_order():
    rng = np.random.default_rng(8)
    for below in (1, 60000, 70000, 1 << 40):
        keys = rng.integers(0, below, 5000)
        assert (keys[ranked.radix_order(keys, below - 1)] == np.sort(keys)).all()
        assert (ranked.radix_order(keys, below - 1) == np.argsort(keys, kind="stable")).all()

"""Quality, personal data, pieces, fingerprints, language, archives."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from affinia.llm import fingerprints as IB
from affinia.llm import language, personal, pieces, quality, warc
from affinia.llm.queries import model_bytes


@pytest.fixture(scope="module")
def rated(spark):
    rnd = random.Random(2)
    good, bad, ugly = ["tree", "river", "house", "walks", "slowly"], ["zzz%%%", "buy!!", "qqq&&&"], ["idiotic", "moronic"]
    docs, labels = [], []
    for i in range(600):
        kind = i % 4
        words = [rnd.choice(good) for _ in range(rnd.randint(20, 60))]
        if kind == 1:
            words = [rnd.choice(bad) for _ in words]
        if kind == 2:
            words[5] = rnd.choice(ugly)
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return docs, labels


def test_quality(spark, docs_of, rated):
    docs, labels = rated
    table = docs_of([*docs, (9000, None), (9001, ""), (None, "tree river house walks")])
    known = spark.createDataFrame([*labels[:400], (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(table, known).collect()}
    right = [got[i].kept == (q == 1 and t == 0) for i, q, t in labels[400:]]
    assert sum(right) / len(right) >= 0.97
    assert all(0 <= r.p_good <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())
    assert got[9000].p_good == got[9001].p_good
    kept = quality.select(table, known)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.classify(docs_of([]), known).count() == 0


def test_thresholds_are_ordered(rated):
    import numpy as np
    import pyarrow as pa

    docs, labels = rated
    rows = list(quality.features(pa.array([t for _, t in docs])))
    model = quality.fit(rows, np.array([q + 1 - t for _, q, t in labels]))
    assert (np.diff(model.thresholds) > 0).all() and model.weights.max() <= 0


def test_quality_of_held_out_documents(spark):
    """Labelled documents of the tables: most clean ones are kept, hardly any of low quality, and fewer toxic ones."""
    from affinia.llm.common import read

    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("no tables")
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    learned = labels.where("doc_id % 3 <> 1")
    rows = quality.classify(docs, learned).join(labels.where("doc_id % 3 = 1"), "doc_id").collect()
    share = lambda some: sum(r.kept for r in some) / len(some)
    assert share([r for r in rows if r.quality and not r.toxic]) >= 0.95
    assert share([r for r in rows if not r.quality]) <= 0.05
    assert share([r for r in rows if r.quality and r.toxic]) <= 0.5


def test_quality_of_long_texts_and_clashing_names(spark, docs_of, rated):
    docs, labels = rated
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rnd = random.Random(4)
    long_ = " ".join(rnd.choice(("tree", "river", "house", "walks", "slowly")) for _ in range(100_000))
    table = docs_of([*docs, (700, long_), (701, long_ + " idiotic"), (702, "zzz%%%" * 200_000)]).withColumnRenamed("size", "kept").withColumnRenamed("source", "p_good")
    kept = quality.select(table, known)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == table.columns and 701 not in ids and len(ids & {i for i, q, t in labels if q and not t}) > 280


def test_no_labels_keep_all(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.p_good for r in quality.classify(docs_of([(1, "a")]), none).collect()} == {0.5}


PII = [
    ("mail a.b+c@x-y.co.uk, or @home or a@b", [("email", 5, 20)]),
    ("1.2.3.4 256.1.1.1 1.2.3 10.0.0.10.5 001.2.3.4", [("ip", 0, 7), ("ip", 24, 33), ("ip", 36, 45)]),
    ("4111 1111 1111 1111 and 4111111111111112", [("card", 0, 19)]),
    ("call +1 (974) 555-3436 or +12", [("phone", 5, 22)]),
    ("é😀 a@b.cc", [("email", 3, 9)]),
]


@pytest.mark.parametrize(("text", "spans"), PII)
def test_base_spans(text, spans):
    assert [(personal.KINDS[k], s, e) for s, k, e in personal.base_spans(text)] == spans


def test_base_spans_like_the_patterns():
    rnd = random.Random(7)
    for _ in range(3000):
        text = "".join(rnd.choice("a.@-1 2+%(") for _ in range(rnd.randint(0, 30)))
        assert [(s, e) for s, k, e in personal.base_spans(text) if k == 0] == [m.span() for m in personal.EMAIL.finditer(text)]
        ips = [m.span() for m in personal.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [(s, e) for s, k, e in personal.base_spans(text) if k == 1] == ips


def test_contexts_find_more(docs_of):
    rows = [(i, f"please write to card number: {4111111111111111} today") for i in range(8)]
    cards = ["4012888888881881", "5555555555554444", "5105105105105100", "378282246310005", "6011111111111117", "6011000990139424", "30569309025904", "3530111333300000"]
    rows = [(i, f"his card number: {c} is known") for i, c in enumerate(cards)] + [(50, "my card number: XK-99887766 was lost"), (51, "in the year 19845 it rained"), (52, None), (53, "")]
    got = {r.doc_id: r for r in personal.find(docs_of(rows)).collect()}
    assert got[50].spans == "card:16:27" and got[50].base == "" and got[50].n_card == 0
    assert got[51].spans == "" and got[52].spans == got[53].spans == ""
    assert got[0].spans == got[0].base == "card:17:33"
    assert personal.find(docs_of([])).count() == 0


def test_contexts_find_other_shapes(docs_of):
    kinds = {"email": ("write to", [f"p{i}@host{i}.org" for i in range(9)]), "ip": ("node at", [f"10.0.{i}.7" for i in range(9)]), "phone": ("please ring", [f"+49 30 55512{i}0" for i in range(9)])}
    rows = [f"{before} {v} now" for before, values in kinds.values() for v in values]
    odd = {"write to jane@intranet now": "email:9:22", "write to jane(at)host now": "email:9:21", "node at fe80::a:b now": "ip:8:17", "please ring 030-123-45-67 now": "phone:12:25", "please ring 030 123 45 67 now": "phone:12:25", "please ring jane@intranet now": ""}
    got = {r.doc_id: r.spans for r in personal.find(docs_of(list(enumerate([*rows, *odd])))).collect()}
    assert [got[len(rows) + i] for i in range(len(odd))] == list(odd.values())


def bootstrap_by_hand(tokens, rounds, seeds, least, doubt):
    """The loop on plain sets. tokens: (kind or None, value of four digits, pattern)."""
    edges = set(tokens)
    size = Counter(p for _, _, p in edges)
    fixed = Counter((p, k) for k, _, p in edges if k is not None and size[p] > 1)
    tied = defaultdict(list)
    for k, v, p in edges:
        if k is None and size[p] > 1:
            tied[v].append(p)
    scored = {x: (n / size[x[0]], n) for x, n in fixed.items()}
    for _ in range(rounds if tied else 0):
        good, grown = defaultdict(float), Counter()
        for v, patterns in tied.items():
            of = {k: sum(scored.get((p, k), (0, 0))[0] for p in patterns) / len(patterns) for k in (1, 2, 3) if any((p, k) in scored for p in patterns)}
            if of:
                sure = {k: math.prod(1 - min(x, 0.999999) for x, n in (scored.get((p, k), (0, 0)) for p in patterns) if n >= seeds and x >= least) for k in of}
                k = min(of, key=lambda k: (sure[k], k))
                if sure[k] <= doubt:
                    of[k] = 1.0
                    grown.update((p, k) for p in patterns)
            for k, x in of.items():
                for p in patterns:
                    good[p, k] += x
        scored = {(p, k): ((fixed[p, k] + good[p, k]) / size[p], fixed[p, k] + grown[p, k]) for p, k in set(fixed) | set(good)}
    best = {}
    for (p, k), (x, n) in scored.items():
        if n >= seeds and x >= least:
            best[p] = max(best.get(p, (0, -9)), (x, -k))
    return {p: (-k, x) for p, (x, k) in best.items()}


def test_bootstrapping_like_by_hand(spark):
    rnd = random.Random(3)
    tokens = []
    for v in range(300):
        kind = rnd.choice((None, None, 0, 1, 3))
        home = rnd.randrange(12)
        for _ in range(rnd.randint(1, 4)):
            tokens.append((kind, f"{1000 + v}", f"p{rnd.choice((home, home, rnd.randrange(40)))}"))
    tokens += [(k, f"{2000 + i}", "sure") for i in range(90) for k in (2,)] + [(None, f"{3000 + i}", p) for i in range(9) for p in ("sure", "next")] + [(None, f"{4000 + i}", p) for i in range(4) for p in ("next", "last")]
    df = spark.createDataFrame(tokens, "kind int, value string, pattern string")
    for rounds, seeds, least in ((0, 5, 0.6), (1, 3, 0.4), (4, 5, 0.6)):
        got = {r.pattern: (r.kind, r.score) for r in personal.bootstrapped(df, rounds, seeds, least).collect()}
        want = bootstrap_by_hand(tokens, rounds, seeds, least, personal.DOUBT)
        assert {p: k for p, (k, _) in got.items()} == {p: k for p, (k, _) in want.items()}
        assert all(got[p][1] == pytest.approx(want[p][1]) for p in want)
    assert "next" in got and "sure" in got


def test_planted_identifiers_are_found(docs_of):
    """Unseen shapes in contexts that seeds share, and in contexts that only found identifiers share, among other tokens."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7)))
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    seed = [lambda: f"{word()}@{word()}.org", lambda: f"10.{rnd.randrange(256)}.{rnd.randrange(256)}.{rnd.randrange(256)}", lambda: f"+49 {digits(3)} {digits(6)}"]
    odd = [lambda: f"{word()}(at){word()}", lambda: f"fe80::{word()[:2].translate(str.maketrans('ghijklmnop', 'abcdefabcd'))}:{digits(2)}:a", lambda: f"0{digits(2)}-{digits(3)}-{digits(2)}"]
    first = [("mail me at", "or call"), ("from host address", "came traffic"), ("please ring number", "after six")]
    then = [("my inbox is", "today"), ("blocked node", "again"), ("fax line", "works")]
    text = lambda left, x, right: " ".join([*(word() for _ in range(9)), left, x, right, *(word() for _ in range(9))])
    rows, want = [], {}
    for k in range(3):
        rows += [text(first[k][0], seed[k](), first[k][1]) for _ in range(25)]
        for i in range(40):
            x = odd[k]()
            pairs = [first[k]] if i < 20 else [then[k]]
            if i < 10:
                pairs.append(then[k])  # the same identifier in a context that no seed has
            for left, right in pairs:
                t = text(left, x, right)
                want[len(rows)] = (personal.KINDS[(0, 1, 3)[k]], t.index(f" {x} ") + 1, x)
                rows.append(t)
    others = [text(rnd.choice(("in the year", "page", "total of", "room")), rnd.choice((digits(4), f"{digits(2)}.{digits(2)}.{digits(2)}", digits(6))), rnd.choice(("it rained", "was read", "euros", "is free"))) for _ in range(150)]
    got = {r.doc_id: r for r in personal.find(docs_of(list(enumerate(rows + others)))).collect()}
    hits = sum(got[i].spans == f"{kind}:{at}:{at + len(x)}" for i, (kind, at, x) in want.items())
    wrong = sum(got[len(rows) + i].n_spans for i in range(len(others)))
    assert hits >= 0.9 * len(want) and wrong <= 0.05 * len(others), (hits, len(want), wrong)


def test_personal_data_in_repeats_and_long_texts(docs_of):
    long_ = "x" * 300_000 + " a@b.cc " + "1.2.3.4," * 2000 + " 5 " * 100_000
    rows = [(1, long_), (1, long_), (None, "a@b.cc"), (2, "a@b.cc " * 5000)]
    got = sorted(((r.doc_id or 0, r.n_email, r.n_ip, r.n_spans) for r in personal.find(docs_of(rows)).collect()))
    assert got == [(0, 1, 0, 1), (1, 1, 2000, 2001), (1, 1, 2000, 2001), (2, 5000, 0, 5000)]


def test_pieces(docs_of):
    import sentencepiece

    model = model_bytes()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["", " ", "  a", "a  b ", "\ta\n b", "▁a", "a▁▁b", "ﬁ Ａ", "x<s>y</s>", "a b", "\x00a", "😀 é́ ", "long" * 5000, "word " * 3000, None]
    table = docs_of(list(enumerate(texts)))
    ids = {r.doc_id: list(r.ids) for r in pieces.encode(table, model).collect()}
    assert ids == {i: sp.encode(t or "") + [sp.eos_id()] for i, t in enumerate(texts)}
    back = {r.doc_id: r.decoded for r in pieces.decode(pieces.encode(table, model), model).collect()}
    for r in pieces.digests(table, model).collect():
        assert r.n_tokens == len(ids[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids[r.doc_id]).encode()).hexdigest()
        assert back[r.doc_id] == sp.decode(ids[r.doc_id])
    assert pieces.digests(docs_of([]), model).count() == 0


def test_fingerprints(docs_of):
    rnd = random.Random(3)
    lines = [f"line {i}" for i in range(400)]
    texts = ["\n".join(rnd.sample(lines, n)) for n in (1, 3, 8, 20, 60, 150)] + ["", None, "same\nsame", "same\nsame", "é😀" * 9, "\n".join(f"{i}" for i in range(2000))]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in IB.fingerprints(docs_of([*rows, (None, "a\nb")])).collect()}
    cut = lambda t: {x for x in t.split("\n") if x}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(cut(t), cut(edited))) and r.near_next == pytest.approx(like(cut(t), cut(after)))
    assert got[8].fingerprint == got[9].fingerprint != got[0].fingerprint
    assert got[None].near_next == 0
    assert IB.fingerprints(docs_of([])).count() == 0


def test_a_fingerprint_holds_all_digests_three_times(docs_of):
    """Each third of the cells counts every distinct digest once, and its keys' xor is that of all digests."""
    texts = ["\n".join(f"l{i}" for i in range(n)) for n in (0, 1, 5, 40, 300)]
    rows = IB.fingerprints(docs_of([*enumerate(texts), (4, "another text\nof the same id")])).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 3, 4, 4]
    for r in rows:
        cells = [c.split(".") for c in r.fingerprint.split(":")]
        assert len(cells) == IB.CELLS
        parts = [cells[k : k + IB.CELLS // 3] for k in range(0, IB.CELLS, IB.CELLS // 3)]
        sums = {(sum(int(n, 16) for n, _ in p), functools.reduce(lambda x, c: x ^ int(c[1], 16), p, 0)) for p in parts}
        want = len({x for x in texts[r.doc_id].split("\n") if x}) if r.n_chars == len(texts[r.doc_id]) else 2
        assert len(sums) == 1 and sums.pop()[0] == want


def test_a_long_line_edited_in_part_stays_near(docs_of):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(6)) for _ in range(3000)]
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (60, 400, 2000)] + ["".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(900)), "x" * 5000, "".join(rnd.choice("abcdef0123") for _ in range(4000))]
    got = {r.doc_id: r for r in IB.fingerprints(docs_of(list(enumerate(texts)))).collect()}
    assert all(got[i].near_edited > 0.3 for i in (0, 1, 2, 3, 5)) and got[4].near_edited > 0
    assert all(got[i].near_next < 0.05 and got[i].near_edited > got[i].near_next for i in range(6))
    moved = "one more word " + texts[2]
    pair = docs_of([(0, texts[2]), (1, moved)])
    assert IB.fingerprints(pair).where("doc_id = 0").first().near_next > 0.95


def total(found):
    return {r.pair: r.n for r in found.groupBy("pair").agg(F.sum("found").alias("n")).collect()}


def test_peeling_recovers_or_fails(spark):
    """24 cells hold a difference of 9 but not one of 40, which larger sketches do."""
    keys = lambda a, b: F.transform(F.sequence(F.lit(a), F.lit(b)), lambda x: F.xxhash64(x))
    none = F.array().cast("array<bigint>")
    pairs = [(0, keys(1, 40), keys(8, 42)), (1, keys(1, 40), none), (2, keys(1, 40), keys(1, 40)), (3, none, none), (4, none, keys(1, 1500))]
    table = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), a.alias("a"), b.alias("b")) for k, a, b in pairs])).alias("x")).select("x.*")
    found, stuck = IB.peeled(IB.difference(table.withColumn("cells", F.lit(24)), ["pair"]), ["pair"])
    assert {r.pair for r in stuck.collect()} == {1, 4} and found.where("pair = 0").agg(F.sum("found")).first()[0] == 9
    assert total(IB.differing(table, ["pair"])) == {0: 9, 1: 40, 4: 1500}


def test_stuck_pairs_are_tried_larger(spark, monkeypatch):
    """With far too few cells at first, every difference is still found whole."""
    monkeypatch.setattr(IB, "ROOM", 0.05)
    monkeypatch.setattr(IB, "LEAST", 6)
    rnd = random.Random(12)
    sets = [(k, [rnd.getrandbits(63) for _ in range(rnd.randint(0, 300))]) for k in range(60)]
    rows = [(k, a, a[: len(a) // 2] + [rnd.getrandbits(63) for _ in range(rnd.randint(0, 99))]) for k, a in sets]
    table = spark.createDataFrame(rows, "pair long, a array<long>, b array<long>").repartition(3)
    assert total(IB.differing(table, ["pair"])) == {k: len(set(a) ^ set(b)) for k, a, b in rows if set(a) != set(b)}


def test_language(docs_of):
    rnd = random.Random(5)
    alphabets = {"aa": "abcde", "bb": "vwxyz", "cc": "éèêàç"}
    rows = [(i, " ".join("".join(rnd.choice(alphabets[lang]) for _ in range(5)) for _ in range(12)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    odd = [(1000, None, "aa"), (1001, "123 !?", "bb"), (1002, "", None), (1003, rows[0][1], None), (1004, rows[0][1].upper(), None)]
    got = {r.doc_id: r for r in language.identify(docs_of([*rows, *odd])).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[1000].score == 0 and got[1000].rejected
    assert got[1003].lang_pred == got[1004].lang_pred == "aa"
    assert 40 < sum(r.held_out for r in got.values()) < 90
    assert {r.lang_pred for r in language.identify(docs_of([(1, "abc", None)])).collect()} == {"und"}
    assert language.identify(docs_of([])).count() == 0


def test_archives(spark, tmp_path):
    pages = [(1, "http://www.B.example/x", "<p>é</p>"), (2, "http://a.example/", "<p>é</p>"), (3, "http://a.example/", None), (4, None, ""), (5, "x\ny", "WARC/1.1\r\n\r\nWARC-Type: response\r\n"), (6, "http://a.example/", "<p>é</p>"), (7, "u", "long" * 100_000)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.archived(df).collect()}
    import base64

    for page, _, text in pages:
        payload = (text or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 6), 2: ("revisit", 6), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert got[1].url_key == "example,b)/x"
    assert {r.record_type for r in warc.archived(df.where("page_id < 3"), min_bytes=100).collect()} == {"response"}
    assert warc.archived(df.limit(0)).count() == 0


def test_index_is_in_order(spark):
    df = spark.createDataFrame([(i, f"http://h{i % 5}.example/{i % 3}", f"page {i}") for i in range(200)], "page_id long, url string, html string").repartition(7)
    keys = [(r.url_key, r.captured_at) for r in warc.archived(df).collect()]
    assert len(keys) == 200 and keys == sorted(keys)


def test_loser_tree():
    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(("k%d" % rnd.randrange(9), rnd.randrange(9), rnd.randrange(9), 0, "", "", None, "", f"f{j}", i) for i in range(rnd.randrange(12))) for j in range(k)]
        got = list(warc.LoserTree([iter(sorted(r, key=warc.order_of)) for r in runs]))
        assert got == sorted((x for r in runs for x in r), key=warc.order_of)


def test_words():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a b c") == ["a b", "c"]

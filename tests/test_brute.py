"""Registered queries that SQL can't express, against plain versions on the smallest tables."""

from __future__ import annotations

import html.parser
import json
import re
import unicodedata
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from affinia.functions.text import NEVER_FOLD
from affinia.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


def table(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def rows(spark, name):
    return [tuple(r) for r in QUERIES[name](spark, SF).collect()]


def roots(pairs):
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up}


def test_greedy_matches(spark):
    e = table("events")
    e["t"] = e.ts.astype("datetime64[us]").astype("int64") // 1_000_000
    want = set()
    for _, some in e.groupby("user_id"):
        free = {(r.t, r.event_id) for r in some.itertuples() if r.event_type == "click"}
        for r in some[some.event_type == "purchase"].sort_values("event_id").itertuples():
            best = min(((abs(t - r.t), t, i) for t, i in free), default=None)
            if best and best[0] <= 900:
                want.add((r.event_id, best[2], best[0]))
                free.remove(best[1:])
    assert set(rows(spark, "greedy_matches")) == want


def test_greedy_matches_of_a_dense_log(spark):
    from affinia.operators.matching import greedy_matches

    rnd = np.random.default_rng(2)
    left = [(int(i), 1, int(t)) for i, t in enumerate(rnd.integers(0, 60_000, 120))]
    right = [(int(i), 1, int(t)) for i, t in enumerate(rnd.integers(0, 60_000, 90))]
    free, want = {(t, i) for i, _, t in right}, set()
    for i, _, t in left:
        best = min(((abs(u - t), u, j) for u, j in free), default=None)
        if best and best[0] <= 900:
            want.add((i, best[2], best[0]))
            free.remove(best[1:])
    frames = spark.createDataFrame(left, "left_id long, k int, t long"), spark.createDataFrame(right, "right_id long, k int, t long")
    assert {tuple(r) for r in greedy_matches(*frames, ["k"]).collect()} == want


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        line, before = [i], line
        for j, y in enumerate(b, 1):
            line.append(min(before[j] + 1, line[-1] + 1, before[j - 1] + (x != y)))
    return line[-1]


def test_merge_map(spark):
    titles = Counter(table("part").p_name)
    words = sorted(titles)
    pairs = [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if 1 - distance(a, b) / max(len(a), len(b)) >= 0.6]
    groups = defaultdict(list)
    for w, r in roots(pairs).items():
        groups[r].append(w)
    want = {(w, min(g, key=lambda x: (x.endswith(" film"), -titles[x], x))) for g in groups.values() for w in g}
    assert set(rows(spark, "merge_map")) == want and len(want) > 5


def test_device_clusters(spark):
    e = table("events")
    plays = [(r.user_id, f"{r.user_id}-{r.event_type}", f"{r.user_id}.{json.loads(r.props)['k']}") for r in e.itertuples()]
    by_ip = defaultdict(list)
    for p in plays:
        by_ip[p[2]].append(p)
    good = {ip for ip, some in by_ip.items() if len(some) >= 2 and len({p[0] for p in some}) == 1}
    groups = roots([("d:" + d, "i:" + ip) for _, d, ip in plays if ip in good])
    count = Counter(d for _, d, _ in plays)
    cluster = {d: groups.get("d:" + d, "d:" + d) for d in count}
    total, many = Counter(), Counter(cluster.values())
    for d, n in count.items():
        total[cluster[d]] += n
    tier = lambda c: "unclustered" if total[c] < 20 else "ip" if many[c] > 1 else "device"
    assert set(rows(spark, "device_clusters")) == {(d, c, count[d], tier(c)) for d, c in cluster.items()}


def test_platforms_take_small_clusters(spark):
    from affinia.operators.clusters import device_clusters

    plays = [("a", f"tv{i}", None, "Roku") for i in range(7) for _ in range(3)] + [("a", "lone", None, "Web")] + [("b", "big", None, "Web")] * 25
    got = {r.device: (r.cluster, r.tier) for r in device_clusters(spark.createDataFrame(plays, "account string, device string, ip string, platform string")).collect()}
    assert got["tv0"] == got["tv6"] == ("p:Roku", "platform") and got["lone"][1] == "unclustered" and got["big"] == ("d:big", "device")


def keyword(raw):
    text = re.sub(r"\s", " ", raw.lower().replace("’", "'"))
    words = "".join(" " if unicodedata.category(c) in ("Pd", "Pc") else c for c in text).split(" ")
    edge = lambda c: unicodedata.category(c)[0] in "PM" and c not in "#%" or unicodedata.category(c) == "Cf"
    out = []
    for w in words:
        while w and edge(w[0]):
            w = w[1:]
        while w and edge(w[-1]):
            w = w[:-1]
        if not w:
            continue
        if w in NEVER_FOLD or len(w) < 4 or re.search("(ics|news|eries|ecies)$", w):
            pass
        elif re.search("[^aeiou]ies$", w):
            w = w[:-3] + "y"
        elif re.search("(s|x|ch|sh)es$", w):
            w = w[:-2]
        elif not re.search("(ss|us|is)$", w) and w.endswith("s"):
            w = w[:-1]
        out.append(w)
    return " ".join(out)


def test_keyword_forms(spark):
    want = {(w, keyword(w)) for t in table("documents").text for w in re.split(r"[ \n]+", t)}
    assert set(rows(spark, "keyword_forms")) == want


def test_words_that_never_fold(spark):
    from pyspark.sql import functions as F

    from affinia.functions import text as T

    raw = ["Mars", "Wales", "customs", "falls", "Robots", "News", "heist_stories", "“Witches”"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(T.keyword(F.col("x"))).collect()]
    assert got == ["mars", "wales", "customs", "falls", "robot", "news", "heist story", "witch"]


def test_file_changes(spark):
    part = table("part")
    known = {f"/a/{r.p_partkey}": (r.p_size, r.p_retailprice, r.p_name) for r in part.itertuples() if r.p_size < 40}
    listed = {f"/a/{r.p_partkey}": (r.p_size, r.p_retailprice, r.p_name) for r in part.itertuples() if r.p_size > 10}
    first = {}
    for path, (_, _, h) in known.items():
        first[h] = min(first.get(h, path), path)
    want = {(p, "missing") for p in known if p not in listed}
    for p, (_, _, h) in listed.items():
        if p in known:
            want.add((p, "same"))
        else:
            want.add((p, "new" if h not in first else "copy" if first[h] in listed else "moved"))
    assert set(rows(spark, "file_changes")) == want


def test_quantized_agreement(spark):
    e = table("embeddings")
    v = np.stack(e.embedding).astype(np.float64)
    q = np.rint(v * 127 / np.abs(v).max(axis=1, keepdims=True))
    cos = lambda m: m[:, 0] / np.linalg.norm(m, axis=1)
    want = set()
    for label, at in e.groupby("label").indices.items():
        tops = [[int(e.vec_id.iloc[i]) for i in sorted(at, key=lambda i, s=cos(m): (-s[i], e.vec_id.iloc[i]))[:10]] for m in (v, q)]
        want.add((int(label), len(set(tops[0]) & set(tops[1])), tops[0][0] == tops[1][0]))
    assert set(rows(spark, "quantized_agreement")) == want


def test_shot_draw(spark):
    """Ten of the shots, the same each time, with their own scores."""
    scores = {(r[0], r[1]): r[2] for r in rows(spark, "shot_search")}
    drawn = rows(spark, "shot_draw")
    assert drawn == rows(spark, "shot_draw") and len(set(drawn)) == 10 and all(scores[r[0], r[1]] == r[2] for r in drawn)


class Text(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template")

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def test_page_text(spark):
    """The letters of each page's visible text are those that a tolerant parser sees in its body."""
    pages = table("pages").set_index("page_id").html
    same = 0
    for page_id, text in rows(spark, "page_text"):
        parser = Text()
        parser.feed(re.sub(r"(?is)<title.*?</title>", "", pages[page_id] or ""))
        plain = lambda t: re.sub(r"\W", "", t or "")
        same += plain(text).replace(plain(re.sub(r"(?is).*<title[^>]*>(.*?)</title>.*", r"\1", pages[page_id] or "")), "") == plain("".join(parser.found)) or plain("".join(parser.found)) in plain(text)
    assert same >= 0.95 * len(pages)


def test_nearest_titles_in_blocks(spark, monkeypatch):
    """A tag on every title and several strips in each pair of blocks, against all pairs."""
    from affinia.operators import tags

    monkeypatch.setattr(tags, "CELLS", 300)
    rnd = np.random.default_rng(5)
    have = {f"t{i:02d}": {"all", *(f"g{k}" for k in rnd.integers(0, 15, 4))} for i in range(50)}
    count = Counter(g for some in have.values() for g in some)
    idf = {g: 1 + np.log(len(have) / n) for g, n in count.items()}
    norm = {t: np.sqrt(sum(idf[g] ** 2 for g in some)) for t, some in have.items()}
    want = set()
    for t, some in have.items():
        cosines = [(-round(sum(idf[g] ** 2 for g in some & more) / norm[t] / norm[o], 6), o) for o, more in have.items() if o != t]
        want |= {(t, o, -c, k + 1) for k, (c, o) in enumerate(sorted(cosines)[:5])}
    tagged = spark.createDataFrame([(t, g) for t, some in have.items() for g in sorted(some)], "title string, tag string")
    got = {tuple(r) for r in tags.nearest_titles(tagged, top=5, per_block=8).select("title", "other", "cosine", "place").collect()}
    assert got == want
    assert tags.nearest_titles(tagged.limit(0)).count() == 0

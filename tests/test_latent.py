"""The report on shared accounts on a few plays, and against SQL in test_oracles."""

from __future__ import annotations

from affinia.operators import latent

PLAYS = "account long, device string, ip string, platform string, item string, unit string"


def play(account, device, ip, platform="tv", item="i", unit="u"):
    return (account, device, ip, platform, item, unit)


def test_clusters_by_hand(spark):
    rows = [play(1, "a", "h"), play(1, "b", "h"), play(1, "b", "g", "web", "j", "v"), play(1, "c", "g")]  # a, b and c by two addresses
    rows += [play(1, "d", "w"), play(1, "e", "w"), play(2, "x", "w")]  # w is under two accounts
    rows += [play(1, None, "p"), play(1, None, "p"), play(1, None, "q"), play(1, None, None, None), play(1, "", None), play(1, None, None, "")]
    rows += [play(2, "a", "h2"), play(2, "b", "h3")]  # the same devices elsewhere are others
    table = spark.createDataFrame(rows, PLAYS)
    joins = {(r.account, r.ip): r.reason for r in latent.join_addresses(table).collect()}
    assert joins == {(1, "h"): None, (1, "g"): None, (1, "w"): "many accounts"}
    of = latent.clustered(table)
    assert of.count() == len(rows) and of.columns == [*table.columns, "tier", "value"]
    found = latent.latent_clusters(of, floor=2)
    got = {(r.account, r.tier, r.value): (r.plays, r["items"], r.units, r.devices, r.ips, r.number) for r in found.collect()}
    assert got == {
        (1, "client_identifier", "a"): (4, 2, 2, ["a", "b", "c"], ["g", "h"], 1),
        (1, "client_identifier", "d"): (1, 1, 1, ["d"], ["w"], None),
        (1, "client_identifier", "e"): (1, 1, 1, ["e"], ["w"], None),
        (1, "client_identifier", ""): (1, 1, 1, [], [], None),
        (1, "ip", "p"): (2, 1, 1, [], ["p"], 2),
        (1, "platform", "tv"): (1, 1, 1, [], ["q"], None),
        (1, "platform", ""): (1, 1, 1, [], [], None),
        (1, "unclustered", None): (1, 1, 1, [], [], None),
        (2, "client_identifier", "a"): (1, 1, 1, ["a"], ["h2"], None),
        (2, "client_identifier", "b"): (1, 1, 1, ["b"], ["h3"], None),
        (2, "client_identifier", "x"): (1, 1, 1, ["x"], ["w"], None),
    }
    assert {r.account: (r.plays, r.clusters, r.devices) for r in latent.unattributed(found).collect()} == {1: (6, 6, 6), 2: (3, 3, 3)}
    words = spark.createDataFrame([("u", "x"), ("u", "y"), ("u", "x"), ("v", "z")], "unit string, keyword string")
    best, coverage = latent.profiles(of, found, words, top=2)
    assert sorted((r.account, r.number, r.keyword, r.titles, r.place) for r in best.collect()) == [(1, 1, "x", 1, 1), (1, 1, "y", 1, 2), (1, 2, "x", 1, 1), (1, 2, "y", 1, 2)]
    assert sorted(tuple(r) for r in coverage.collect()) == [(1, 1, 2, 2, 4, 4), (1, 2, 1, 1, 2, 2)]
    assert [tuple(r) for r in latent.overlaps(best).collect()] == [(1, 1, 2, 1.0)]


def test_no_plays(spark):
    of = latent.clustered(spark.createDataFrame([], PLAYS))
    assert latent.latent_clusters(of).count() == 0

"""Communities, their parts and certificates, and the links of a graph of people."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import community, people, topics


def graph(seed, nodes, links, parts=1):
    r = np.random.default_rng(seed)
    at = r.integers(0, nodes, (links, 2))
    at[:, 1] = at[:, 1] - at[:, 1] % parts + at[:, 0] % parts  # ends of one residue only
    pairs = {(min(a, b), max(a, b)): round(float(w), 3) for (a, b), w in zip(at.tolist(), r.random(links)) if a != b}
    return [(f"n{a:03d}", f"n{b:03d}", w) for (a, b), w in sorted(pairs.items())]


def plain_communities(edges, resolution):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    degree = {n: sum(v.values()) for n, v in near.items()}
    whole, mine = sum(degree.values()), {n: n for n in near}
    for _ in range(30):
        before = dict(mine)
        for n in sorted(near, key=lambda n: (-round(degree[n], 9), n)):
            total = lambda c: sum(degree[x] for x in near if mine[x] == c and x != n)
            own = mine[n]
            gains = {c: sum(w for o, w in near[n].items() if mine[o] == c) - resolution * degree[n] * total(c) / whole for c in {mine[o] for o in near[n]}}
            gains[own] = max(0.0, gains.get(own, 0.0))
            mine[n] = min(c for c, g in gains.items() if g >= max(gains.values()) - 1e-12)
        if mine == before:
            break
    return mine


def groups(found):
    out = {}
    for n, c in found.items():
        out.setdefault(c, set()).add(n)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize(("seed", "nodes", "links", "parts", "resolution"), [(1, 12, 20, 1, 1.0), (2, 40, 90, 1, 1.15), (3, 60, 70, 4, 1.25), (4, 30, 200, 1, 0.5)])
def test_parts_solved_apart_are_the_whole_solved_at_once(spark, seed, nodes, links, parts, resolution):
    edges = graph(seed, nodes, links, parts)
    df = spark.createDataFrame([("s", *e) for e in edges] + [("t", *e) for e in edges[: links // 3]], "server_id string, l string, r string, weight double").repartition(3)
    want = {"s": groups(plain_communities(edges, resolution)), "t": groups(plain_communities(edges[: links // 3], resolution))}
    for split in (True, False):
        rows = community.communities(df, resolution, split).collect()
        assert {s: groups({r.term: r.community for r in rows if r.server_id == s}) for s in "st"} == want


def test_parts_of_a_long_chain_and_a_star(spark):
    edges = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(70)] + [("hub", f"leaf{k}") for k in range(50)] + [("x", "y")]
    df = spark.createDataFrame([("s", min(e), max(e), 1.0) for e in edges], "server_id string, l string, r string, weight double")
    found = {r.term: r.part for r in community.parts(df).collect()}
    assert all(found[n] == ("c000" if n[0] == "c" else "x" if n in "xy" else "hub") for n in found) and len(found) == 71 + 51 + 2


def test_certificate_of_a_finished_and_of_an_arbitrary_assignment(spark):
    edges = graph(7, 30, 80)
    df = spark.createDataFrame([("s", *e) for e in edges], "server_id string, l string, r string, weight double")
    found = community.communities(df, 1.15)
    one = community.certificate(df, found, 1.15).first()
    mine = {r.term: r.community for r in found.collect()}
    degree = {n: sum(w for a, b, w in edges if n in (a, b)) for n in mine}
    whole = sum(degree.values())
    worth = lambda m: sum(2 * sum(w for a, b, w in edges if m[a] == m[b] == c) / whole - 1.15 * (sum(degree[n] for n in m if m[n] == c) / whole) ** 2 for c in set(m.values()))
    assert (one.nodes, one.links, one.communities) == (len(mine), len(edges), len(set(mine.values())))
    assert one.best_move <= community.NEAR and abs(one.modularity - worth(mine)) < 1e-12
    # A move's gain is what the modularity changes by, times half the whole weight.
    odd = {n: f"g{k % 3}" for k, n in enumerate(sorted(mine))}
    other = spark.createDataFrame([("s", n, c) for n, c in odd.items()], "server_id string, term string, community string")
    assert community.certificate(df, other, 1.15).first().best_move > 0.01
    gain = {(r.term, r.community): r.gain for r in community.moves(df, other, 1.15).collect()}
    n, c = next(k for k in gain if odd[k[0]] != k[1] and (k[0], odd[k[0]]) in gain)
    assert abs((worth({**odd, n: c}) - worth(odd)) * whole / 2 - (gain[n, c] - gain[n, odd[n]])) < 1e-9


PART = "server_id string, speaker string, channel string, messages long"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_without_all_pairs_are_the_strongest_of_all_pairs(spark, seed):
    r = np.random.default_rng(seed)
    rows = {(s, f"u{u:02d}", f"c{c}"): int(r.choice([1, 1, 2, 3, 40])) for s, u, c in zip(r.choice(["s", "t"], 400), r.integers(0, 60, 400), (r.random(400) ** 3 * 9).astype(int))}
    part = spark.createDataFrame([(*k, m) for k, m in rows.items()], PART).repartition(3)
    key = lambda df: sorted((x.server_id, x.l, x.r, round(x.weight, 9)) for x in df.collect())
    want = key(topics.strongest(people.affinity(part), 4))
    assert key(people.strongest_links(part, 4, depth=2, growth=2)) == want == key(people.strongest_links(part, 4))
    assert len(want) > 100


def test_pairs_of_a_very_broad_room_are_linear(spark):
    n, depth = 100_000, 16
    rows = spark.range(n).select(F.lit("s").alias("server_id"), F.format_string("u%06d", "id").alias("speaker"), F.lit("all").alias("channel"), (3 + F.col("id") % 7).alias("messages"))
    rooms = people.rooms_of_regulars(rows)
    assert people.candidates(rooms, people.heads(rooms, depth)).count() <= depth * n
    got = people.strongest_links(rows, 8, depth=depth).groupBy("r").count().collect()
    # The nine busiest and largest names: everyone else links to eight of these.
    assert sum(x["count"] for x in got) == 8 * (n - 9) + 36 and len([x for x in got if x["count"] > 8]) == 8

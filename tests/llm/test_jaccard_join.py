import math
import random
from collections import Counter

import pytest
from fixtures import dicts, empty, frame, prose, texts

from tallyforge.llm.components import components
from tallyforge.llm.jaccard_join import PLACES, RECALL, SEED, chosen_paths, jaccard_join, runs_needed, sketches


def sets_of(rows):
    out = []
    for _, text, *_ in rows:
        w = "".join(c.lower() if c < "\x80" else c for c in text or "").split(" ")
        w = [x for part in w for x in part.replace("\t", "\n").replace("\x0b", "\n").replace("\x0c", "\n").replace("\r", "\n").split("\n") if x]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def plain(rows):
    sets, n = sets_of(rows), len(rows)
    parent, links = list(range(n)), Counter()

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        named = min((rows[m][0] for m in members if rows[m][0] is not None), default=None)
        out += [(str(rows[m][0]), str(named), len(members), links[m]) for m in members]
    return sorted(out)


def mine(df):
    return sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"], r["n_links"]) for r in dicts(df))


def variants(n, seed=1, words=120, edits=6):
    draw = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(draw.randint(0, edits)):
            w[draw.randrange(len(w))] = f"edit{draw.randrange(10**6)}"
        out.append((1000 + i, " ".join(w), "en", "s"))
    return out


def test_awkward_rows(spark):
    rows = [r for r in texts() if r[0] != 20]
    assert mine(jaccard_join(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("limit", [8, 256])
def test_a_large_group_is_split_into_buckets_and_tiles(spark, limit):
    rows = variants(150) + variants(40, 2, 300, 10) + [(r[0] + 500, *r[1:]) for r in variants(20)] + texts()[:10]
    assert mine(jaccard_join(frame(spark, rows), limit=limit)) == plain(rows)


def test_empty_table(spark):
    assert jaccard_join(empty(spark)).collect() == []


def test_runs_reach_the_recall():
    chance = 1 - math.exp(-1)
    assert 1 - (1 - chance) ** runs_needed(0.99, 1) >= 0.99 > 1 - (1 - chance) ** (runs_needed(0.99, 1) - 1)
    assert runs_needed(0.999, 3) > runs_needed(0.99, 3) > runs_needed(0.99, 1)


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_components(spark, kind):
    draw = random.Random(4)
    n = 300
    edges = {
        "path": [(i, i + 1) for i in range(n)],
        "star": [(0, i) for i in range(1, n)],
        "random": [(draw.randrange(n), draw.randrange(n)) for _ in range(200)],
    }[kind]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    got = {r["node"]: r["component"] for r in dicts(components(spark.createDataFrame(edges, "a long, b long")))}
    assert set(got) == set(parent)
    assert len({(got[i], find(i)) for i in got}) == len(set(got.values())) == len({find(i) for i in got})


def test_recall_where_every_bucket_splits(spark):
    """Pairs whose sketches agree in each place with probability 0.8, in buckets that all count as large."""
    draw, rows, pairs = random.Random(8), [], 3000
    for pair in range(pairs):
        one = [draw.randrange(1 << 15) for _ in range(PLACES)]
        two = [v if draw.random() < 0.8 else draw.randrange(1 << 15) for v in one]
        rows += [(f"{pair}a", one), (f"{pair}b", two)]
    nodes = spark.createDataFrame(rows, "node string, sketch array<int>")
    leaves = chosen_paths(nodes, 0.8, 1, 3, RECALL, SEED).selectExpr("path", "node", "left(node, length(node) - 1) AS pair")
    met = leaves.groupBy("path", "pair").count().filter("count = 2").select("pair").distinct().count()
    assert met / pairs >= RECALL - 0.004


def test_path_values_keep_all_bits(spark):
    rows = [(i, prose(i, 8, 4000), "en", "s") for i in range(50)]
    values = [v for r in dicts(sketches(frame(spark, rows))) for v in r["sketch"]]
    assert max(abs(v) for v in values) >= 1 << 60


def test_two_tiles_add_only_what_joins_their_parts():
    import numpy as np

    from tallyforge.llm.jaccard_join import Forest, parts_of, spanning

    draw = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        for share in (0.02, 0.1, 0.6):
            upper = np.triu(draw.random((n, n)) < share, 1)
            tile = draw.integers(0, 2, n)
            inner = upper & (tile[:, None] == tile[None, :])
            plain = Forest(n)
            for i, j in np.argwhere(upper):
                plain.join(int(i), int(j))
            for known, pairs in ((inner, upper & ~inner), (np.zeros_like(upper), upper)):
                own = Forest(n)
                for i, j in np.argwhere(known):
                    own.join(int(i), int(j))
                assert [own.find(i) for i in range(n)] == parts_of(known | known.T).tolist()
                added = spanning(pairs, known)
                assert all(pairs[i, j] and own.join(i, j) for i, j in added)  # none is idle
                assert [own.find(i) for i in range(n)] == [plain.find(i) for i in range(n)]
    # A group of close copies: one link between two tiles.
    assert len(spanning(np.triu(np.ones((60, 60), bool), 1), np.ones((60, 60), bool))) == 0
    tile = np.repeat([0, 1], 30)
    both = np.triu(np.ones((60, 60), bool), 1)
    assert len(spanning(both & (tile[:, None] != tile[None, :]), tile[:, None] == tile[None, :])) == 1

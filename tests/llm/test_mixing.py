import hashlib
from collections import defaultdict

import pytest
from fixtures import dicts, empty, frame, prose, texts
from pyspark.sql import functions as F

from tallyforge.llm.mixing import WEIGHTS, domain_of, mix


def levels():
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def domain(source):
    number = int(source[3:]) if source and source[:3] == "src" and source[3:].isdigit() else 0
    return "web" if number < 10 else "books" if number < 15 else "reference"


def fill(budget, children):
    """Shares of {name: (capacity, weight)}; whoever is full drops out and the rest share again."""
    out, left, todo = {}, budget, dict(children)
    while todo:
        weight = sum(w for _, w in todo.values())
        name = min(todo, key=lambda n: (todo[n][0] / todo[n][1], n))
        capacity, own = todo[name]
        if capacity * weight > left * own:
            return out | {n: left * w // weight for n, (_, w) in todo.items()}
        out[name] = capacity
        left -= capacity
        del todo[name]
    return out


def plain(rows, per_mille, epochs, seed=17):
    leaves = defaultdict(list)
    for doc_id, text, lang, source in rows:
        words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        leaves[domain(source), lang or "none", source or "none"].append((doc_id, len(words)))
    supply = {leaf: sum(n for _, n in docs) for leaf, docs in leaves.items()}
    given = {(): min(sum(supply.values()) * per_mille // 1000, sum(supply.values()) * epochs)}
    for depth, level in enumerate(("domain", "lang", "source")):
        below = defaultdict(dict)
        for leaf in leaves:
            children = below[leaf[:depth]]
            capacity, _ = children.get(leaf[depth], (0, 0))
            children[leaf[depth]] = (capacity + supply[leaf] * epochs, WEIGHTS[level].get(leaf[depth], 1))
        given = {(*parent, n): b for parent, children in below.items() for n, b in fill(given[parent], children).items()}
    out = []
    for leaf, docs in leaves.items():
        if not supply[leaf]:
            continue
        whole, wanted = divmod(given[leaf], supply[leaf])
        out += [(str(i), *leaf, e) for i, _ in docs for e in range(whole)]
        place = lambda i: int(hashlib.md5(f"{seed}:{whole}:{'' if i is None else i}".encode()).hexdigest()[:15], 16)  # noqa: B023,E731
        upto = 0
        for at in sorted({place(i) for i, _ in docs}):
            same = [(i, n) for i, n in docs if place(i) == at]
            upto += sum(n for _, n in same)
            if upto > wanted:
                break
            out += [(str(i), *leaf, whole) for i, _ in same]
    return sorted(out)


def mine(df):
    return sorted((str(r["doc_id"]), domain(r["source"]), r["lang"] or "none", r["source"] or "none", r["epoch"]) for r in dicts(df))


MORE = [(100 + i, prose(i, 20 + i % 50), ("en", "de", "fr", "es", None)[i % 5], f"src{i * i % 21}") for i in range(200)]


@pytest.mark.parametrize("per_mille,epochs", [(600, 2), (1000, 1), (1500, 2), (5000, 3), (1, 1), (0, 1)])
def test_against_plain_python(spark, per_mille, epochs):
    rows = texts() + MORE
    got = mix(frame(spark, rows), levels(), budget_per_mille=per_mille, max_epochs=epochs)
    assert mine(got) == plain(rows, per_mille, epochs)


def test_columns_stay(spark):
    rows = dicts(mix(frame(spark), levels(), budget_per_mille=1000, max_epochs=1))
    assert rows and all((r["words"], r["node"], r["budget"], r["hash"]) == ("w", 3, 4, "h") for r in rows)


def test_empty_table(spark):
    assert mix(empty(spark), levels()).collect() == []

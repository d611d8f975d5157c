import re

import pytest
from fixtures import dicts, empty, frame, prose, texts

from tallyforge.llm.license_scan import PHRASES, TEMPLATES, license_scan, template_windows

NOTICES = [
    "Released under the MIT License. mit license!",
    "licensed under the apache license, version 2.0 and Licensed under CC BY-NC 4.0.",
    "This work is licensed under the NEW GNU General Public License, version 3",
    "general public license general public license",
    "all rights reserved all rights reserved", "rights reserved", "MIT", "the mit", "mit licenseé", "mit-license", "MIT\nLicense",
    "permission is hereby granted free of charge to any person getting a copy of this software and associated documentation files",
    "this work is licensed under a",
]
ROWS = texts() + [(50 + i, t, "en", "s") for i, t in enumerate(NOTICES)] + [(80, prose(3, 60) + " " + NOTICES[0] + prose(4, 50), "en", "s")]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def judged(text):
    words = words_of(text)
    places, base = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    found, best = set(), 0.0
    for _, (label, wording) in enumerate(TEMPLATES):
        t = words_of(wording)
        votes = {}
        for i in range(len(words) - 2):
            for j in range(len(t) - 2):
                if words[i : i + 3] == t[j : j + 3]:
                    votes.setdefault(i - j, set()).add(j)
        last, reached = None, set()
        for diagonal in [*sorted(votes), None]:
            if last is not None and (diagonal is None or diagonal - last > 2):
                cover = len({j + k for j in reached for k in range(3)}) / len(t)
                if cover >= 0.75:
                    found.add(label)
                    best = max(best, cover)
                reached = set()
            if diagonal is not None:
                reached |= votes[diagonal]
                last = diagonal
    return (
        len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | found)), 1.0 if places else best,
    )


def test_against_plain_python(spark):
    rows = dicts(license_scan(frame(spark, ROWS)))
    held = sorted((str(i), judged(t)) for i, t, *_ in ROWS)
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    got = sorted((str(r["doc_id"]), tuple(r[c] for c in columns)) for r in rows)
    assert [g[0] for g in got] == [h[0] for h in held]
    for (i, mine), (_, plain) in zip(sorted(got, key=repr), sorted(held, key=repr)):
        assert mine[:-1] == plain[:-1] and mine[-1] == pytest.approx(plain[-1]), i


def test_inserted_word_moves_the_diagonal(spark):
    rows = {r["doc_id"]: r for r in dicts(license_scan(frame(spark, ROWS)))}
    assert rows[52]["labels"] == "gpl" and rows[61]["labels"] == "mit" and rows[62]["labels"] == ""
    assert rows[51]["labels"] == "apache,cc-by-nc"


def test_empty_table_and_short_template(spark):
    assert license_scan(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        template_windows((("x", "two words"),))

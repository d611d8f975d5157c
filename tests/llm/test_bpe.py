import hashlib
import pickle
import random

import public_tokenizers
import pytest
from fixtures import EXTRA, dicts, empty, frame, texts
from tokenizers import Tokenizer

from tallyforge.llm.bpe import Encoder, TokenAutomaton, bpe_encode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return Encoder(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    draw = random.Random(8)
    letters = "abcdeinorstuéàß '!.19\n\t"
    out = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    out += ["".join(draw.choice("aothe") for _ in range(draw.randint(1, 30))) for _ in range(1500)]
    return out + [
        "", "  ", "Hello<|endoftext|>World <|startoftext|>x<|endoftext", "ΑΣ ΟΔΟΣ İstanbul ſ ﬁ", "don't I'LL it'd 're", "a\x1cb\x1d c\x85d\xa0e",
        "1234 ½ ² Ⅷ ٣", "é ́x 한국어 日本語 🎉🎉", "a" * 300, "aaa aaaa aaaaa", "\x00\x7f", "　x y​z", "ẛ̣ ﷺ \U00010400 ẞ ŉ",
    ]


def test_same_ids_and_texts_as_the_library(encoder, library):
    said = odd_texts() + [t for _, t, *_ in texts() if t]
    for text, other in zip(said, library.encode_batch(said, add_special_tokens=False)):
        ids, decoded, count = encoder.encode(text)
        assert [int(i) for i in ids.split()] == other.ids and count == len(other.ids), text
        assert decoded == library.decode(other.ids, skip_special_tokens=False), text


def test_code_points_of_all_planes(encoder, library):
    """Also those that this Python and the library's version of Unicode class or lower differently."""
    draw = random.Random(21)
    planes = [(1, 0xD800), (1, 0x250), (0x10000, 0x20000), (0xE000, 0x110000), (0x20000, 0x40000)]
    said = ["\u1c89x", "\ua7cbx", "\U00010d50x", "a\U00018d80b", "\U00019003", "1\U0001df2f!", "a\U0003d3b4", "!\U0003d3b4"]
    for _ in range(8000):
        said.append("".join(chr(draw.randrange(*draw.choice(planes))) if draw.random() < 0.7 else draw.choice("ab 1!") for _ in range(draw.randint(1, 8))))
    again = pickle.loads(pickle.dumps(encoder))
    for text, other in zip(said, library.encode_batch(said, add_special_tokens=False)):
        ids, decoded, _ = again.encode(text)
        assert [int(i) for i in ids.split()] == other.ids, ascii(text)
        assert decoded == library.decode(other.ids, skip_special_tokens=False), ascii(text)


def test_one_reading_without_a_way_back(encoder):
    """Each symbol moves the reading state once; forgetting what was found on the way changes nothing."""
    automaton = encoder.automaton
    words = ["".join(random.Random(i).choice("aeinorst") for _ in range(i % 40 + 1)) for i in range(300)]
    first = [automaton.read(word.encode().translate(encoder.codes)) for word in words]
    spelled = sum(automaton.length[s] == automaton.length[k >> 9] + 1 for k, s in automaton.moves.items())
    automaton._forget()
    assert len(automaton.moves) == spelled and not automaton.arcs
    assert [automaton.read(word.encode().translate(encoder.codes)) for word in words] == first
    for word, ids in zip(words, first):
        assert "".join(automaton.labels[i] for i in ids) == word + "</w>"
        assert all(automaton.has(a, b) for a, b in zip(ids, ids[1:]))


def merged(symbols, merges):
    """The usual way: join the pair with the earliest merge, again and again."""
    rank = {pair: i for i, pair in enumerate(merges)}
    while len(symbols) > 1:
        best = min(zip(symbols, symbols[1:]), key=lambda p: rank.get(p, len(rank)))
        if best not in rank:
            break
        out, i = [], 0
        while i < len(symbols):
            step = 2 if tuple(symbols[i : i + 2]) == best else 1
            out.append("".join(symbols[i : i + step]))
            i += step
        symbols = out
    return symbols


@pytest.mark.parametrize("seed", range(12))
def test_gadgets_on_random_merges(seed):
    draw = random.Random(seed)
    known = ["a", "b", "a</w>", "b</w>"]
    merges = []
    while len(merges) < 25:
        u, v = draw.choice([k for k in known if not k.endswith("</w>")]), draw.choice(known)
        if u + v not in known:
            known.append(u + v)
            merges.append((u, v))
    automaton = TokenAutomaton({k: i for i, k in enumerate(known)}, merges)
    for _ in range(300):
        word = "".join(draw.choice("ab") for _ in range(draw.randint(1, 14)))
        want = merged([*word[:-1], word[-1] + "</w>"], merges)
        assert [automaton.labels[i] for i in automaton.encode(word)] == want, (word, merges)


def test_awkward_rows(spark, library):
    rows = dicts(bpe_encode(frame(spark), PATH))
    assert len(rows) == len(texts())
    for row in rows:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert [row[c] for c in EXTRA] == ["w", 3, 4, "t", "h"]


def test_empty_table(spark):
    assert bpe_encode(empty(spark), PATH).collect() == []

"""Finding many keywords in one pass over a text.

A few hundred substring tests per row cost more than everything else a classifier does. Here the words become one
prefix-tree pattern that is tried at every position of the text: it gives the longest word starting there, and every
shorter word starting there is a prefix of it, so the words found this way tell exactly which keywords occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from tallyforge.functions.text import bind, fold_upper, quote

_CHUNKS = 16


def _escaped(letter: str) -> str:
    return letter if letter.isalnum() else "\\" + letter


def _tree(words: Iterable[str]) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}
    return root


def _pattern(node: dict) -> str:
    branches = sorted((letter, child) for letter, child in node.items() if letter)
    if not branches:
        return ""
    body = _choice(branches)
    return f"(?:{body})?" if "" in node else body


def _choice(branches: list[tuple[str, dict]]) -> str:
    """Alternatives by first letter; longer lists are halved behind a look at the letter, so that a position costs a
    handful of tests instead of one per letter."""
    if len(branches) == 1:
        letter, child = branches[0]
        return _escaped(letter) + _pattern(child)
    if len(branches) <= 3:
        return "(?:" + "|".join(_escaped(letter) + _pattern(child) for letter, child in branches) + ")"
    middle = len(branches) // 2
    halves = (branches[:middle], branches[middle:])
    looked = (f"(?=[{''.join(_escaped(letter) for letter, _ in half)}]){_choice(half)}" for half in halves)
    return "(?:" + "|".join(looked) + ")"


def occurring(folded: str, words: Iterable[str]) -> str:
    """The distinct longest words found at the positions of the folded text, as an array."""
    return f"array_distinct(regexp_extract_all({folded}, {quote(f'(?=({_pattern(_tree(words))}))')}, 1))"


def prefixes(word: str, words: set[str]) -> list[str]:
    """The words that occur wherever `word` does at its own position."""
    return [word[:n] for n in range(1, len(word) + 1) if word[:n] in words]


def lookup(word: str, values: dict[str, str]) -> str:
    """The value (SQL text) of a word: a choice of small literal maps by sorted order."""
    ordered = sorted(values.items())
    size = -(-len(ordered) // _CHUNKS)
    chunks = [ordered[n : n + size] for n in range(0, len(ordered), size)]
    maps = [
        f"try_element_at(map({', '.join(f'{quote(k)}, {v}' for k, v in chunk)}), {word})" for chunk in chunks
    ]
    if len(chunks) == 1:
        return maps[0]
    cases = (f"WHEN {word} < {quote(after[0][0])} THEN {part}" for part, after in zip(maps, chunks[1:]))
    return f"CASE {' '.join(cases)} ELSE {maps[-1]} END"


def pick(number: str, choices: dict[int, str], otherwise: str) -> str:
    """The expression of a number, found by halving, so that a row tests a few bounds and not every number."""
    if not choices:
        return otherwise
    if len(choices) == 1:
        ((only, value),) = choices.items()
        return f"if({number} = {only}, {value}, {otherwise})"
    ordered = sorted(choices.items())
    middle = len(ordered) // 2
    below, above = dict(ordered[:middle]), dict(ordered[middle:])
    return f"if({number} < {ordered[middle][0]}, {pick(number, below, otherwise)}, {pick(number, above, otherwise)})"


def with_words(text: str, words: Iterable[str], body: Callable[[str, str], str]) -> str:
    """`body(folded text, words found)`, each computed once per row."""
    return bind(fold_upper(text), "u", bind(occurring("u", words), "found", body("u", "found")))

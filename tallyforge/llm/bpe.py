"""BPE encoding by a token automaton that is built from the merges one gadget at a time.

The automaton starts as one state with a loop for every byte symbol. The gadget of the merge (u, v) -> w takes the state q that
u leads to: u is led to a copy of q without the arc v, and every state that has the arc u gets the arc w, to where v led. What it
accepts after the last merge are exactly the correct tokenizations, and its state only depends on the last token: the states
are numbered by it. A copy is held as its difference, the arc it lacks and when it was made.

For encoding, the spellings of the tokens that gadgets left alive are compiled into a second table, (state, byte symbol) ->
state, whose states are the longest ends of what was read that begin a token, and into the tokens that end in each of those
states, the longest first. A word is read once, from left to right, without a way back: each symbol moves the reading state by
one look into that table. Of the tokens that end at a place exactly one is an arc of the token automaton's state at the place
where it begins. From the word's end on, that arc is settled, once for each place that is asked for; the arcs back from the end
are the word's ids, and decoding emits the arc labels.

Both tables are compiled once by the driver and broadcast as arrays; their size follows the vocabulary's. Documents are encoded
row by row without a shuffle. Which arcs a state has is worked out from the gadgets when first asked and remembered in a table
of bounded size, and so are encoded words: memory stays bounded, results do not depend on it.

Characters that the vocabulary file's library takes for another class or lowers otherwise than Python, for another version of
Unicode, are found by the driver; words with one of them are split and lowered by that library.

Defined results: a null or empty text has no tokens. Strings of special tokens in a text become those tokens, as the
vocabulary file's library does. Texts of any length are encoded whole. Repeated rows give the same ids; an empty table
gives an empty result; other columns of the input are kept unless named like a result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm.common import own

#: Words remembered at once are at most twice as many, other stretches as many, and arcs twice as many.
MEMO = 200_000
_END = "</w>"
#: Code points that are compared: all but ASCII, surrogates and planes without a class of their own.
_BLOCKS = (range(0x80, 0xD800), range(0xE000, 0x40000), range(0xE0000, 0xE1000))
#: The symbol after a word's last one; places in the alphabet are smaller.
_STOP = 511
#: Moves remembered beside those along spellings are at most as many.
_MOVES = 1_000_000
_NEVER = 1 << 60
#: Characters that Python takes for white space and the vocabulary's library does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[\\t-\\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next one from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class TokenAutomaton:
    """Compiled from a vocabulary and its merges in order; the state after a token is named by the token."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocabulary.values(), default=-1) + 1
        self.labels = {number: label for label, number in vocabulary.items()}
        self.born, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        #: (u << 32 | v): when the state after u was replaced by a copy without the arc v.
        self.lacks: dict[int, int] = {}
        dead: set[int] = set()
        self.arcs: dict[int, bool] = {}
        for when, (first, second) in enumerate(merges):
            self._gadget(when, vocabulary[first], vocabulary[second], vocabulary[first + second], dead)
        self.arcs.clear()
        self._compile({label: number for label, number in vocabulary.items() if number not in dead})

    def _gadget(self, when: int, u: int, v: int, w: int, dead: set[int]) -> None:
        """Leads u to a copy of its state without v. The arc w then exists wherever u does, and leads to where v led:
        both follow from its parts and its time, so nothing else has to be stored."""
        if u in dead or v in dead or not self.has(u, v):
            dead.add(w)
            return
        self.lacks[u << 32 | v] = when
        self.born[w], self.left[w], self.right[w] = when, u, v

    def has(self, last: int, token: int) -> bool:
        """Whether the state after `last` has the arc `token`.

        That state was copied from the one its right part led to, so it lacks what that one lacked by then; and the arc
        was made where its left part was an arc at that time."""
        lacks, born, left = self.lacks, self.born, self.left
        state, until = last, _NEVER
        while True:
            arc, made = token, _NEVER
            while True:
                when = lacks.get(state << 32 | arc)
                if when is not None and when < until and when <= made:
                    return False
                if left[arc] < 0:
                    break
                made, arc = born[arc], left[arc]
            if self.right[state] < 0:
                return True
            until, state = born[state], self.right[state]

    def _compile(self, living: dict[str, int]) -> None:
        """The table of reading states over the spellings: state 0 has read nothing that begins a token."""
        self.alphabet = sorted({symbol for label in living for symbol in label.removesuffix(_END)})
        code = {symbol: i for i, symbol in enumerate(self.alphabet)}
        self.moves: dict[int, int] = {}
        self.token, self.length, below = [-1], [0], [[]]
        for label, number in living.items():
            state = 0
            for symbol in [*map(code.get, label.removesuffix(_END)), *[_STOP] * label.endswith(_END)]:
                key = state << 9 | symbol
                if key not in self.moves:
                    self.moves[key] = len(self.token)
                    below[state].append((symbol, len(self.token)))
                    self.token.append(-1)
                    self.length.append(self.length[state] + 1)
                    below.append([])
                state = self.moves[key]
            self.token[state] = number
        #: The reading state of the longest proper end, and the nearest state in which a token ends.
        self.shorter, self.ending = [0] * len(self.token), [0] * len(self.token)
        order = [0]
        for state in order:
            for symbol, following in below[state]:
                order.append(following)
                self.shorter[following] = self._move(self.shorter[state], symbol) if state else 0
                self.ending[following] = following if self.token[following] >= 0 else self.ending[self.shorter[following]]
        self._made_ready()

    def _move(self, state: int, symbol: int) -> int:
        while (found := self.moves.get(state << 9 | symbol)) is None and state:
            state = self.shorter[state]
        return found or 0

    def _made_ready(self) -> None:
        self.code = {symbol: i for i, symbol in enumerate(self.alphabet)}
        self.next_ending = [self.ending[s] for s in self.shorter]

    def __getstate__(self) -> dict:
        whole = ("born", "left", "right", "token", "length", "shorter", "ending")
        pairs = {name: (np.fromiter(d.keys(), np.int64), np.fromiter(d.values(), np.int32)) for name, d in (("lacks", self.lacks), ("moves", self.moves))}
        return {"alphabet": self.alphabet, "labels": self.labels} | {n: np.array(getattr(self, n), np.int32) for n in whole} | pairs

    def __setstate__(self, state: dict) -> None:
        for name, value in state.items():
            if isinstance(value, tuple):
                value = dict(zip(value[0].tolist(), value[1].tolist()))
            setattr(self, name, value.tolist() if isinstance(value, np.ndarray) else value)
        self.arcs = {}
        self._made_ready()

    def encode(self, symbols: str) -> list[int]:
        """The ids of one word, given as byte symbols."""
        return self.read([self.code[s] for s in symbols])

    def read(self, codes: Iterable[int]) -> list[int]:
        """The ids of one word, given as places in the alphabet."""
        moves, token, length, next_ending, arcs = self.moves, self.token, self.length, self.next_ending, self.arcs
        if len(moves) > _MOVES or len(arcs) > 2 * MEMO:
            self._forget()
            moves = self.moves
        ending, state, ends = self.ending, 0, [0]
        for symbol in [*codes, _STOP]:
            following = moves.get(state << 9 | symbol)
            if following is None:
                following = moves[state << 9 | symbol] = self._move(state, symbol)
            state = following
            ends.append(ending[state])
        # The token at a place is settled once, after that at the place where it begins; places no token begins at stay open.
        lasts, place = [-1] * len(ends), len(ends) - 1
        waiting = []
        while True:
            at = ends[place]
            begin, last = place - length[at], token[at]
            if begin:
                before = lasts[begin]
                if before < 0:
                    waiting.append(place)
                    place = begin
                    continue
                allowed = arcs.get(before << 32 | last)
                if allowed is None:
                    allowed = arcs[before << 32 | last] = self.has(before, last)
                if not allowed:
                    ends[place] = next_ending[at]
                    continue
            lasts[place] = last
            if not waiting:
                break
            place = waiting.pop()
        out = []
        while place:
            out.append(lasts[place])
            place -= length[ends[place]]
        return out[::-1]

    def _forget(self) -> None:
        """Keeps the moves along spellings; those found on the way are found again."""
        self.arcs.clear()
        self.moves = {k: s for k, s in self.moves.items() if self.length[s] == self.length[k >> 9] + 1}

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.labels[number] for number in ids])


class Memo:
    """At most 2 * size entries: when the new ones reach the size they become the old ones, and the old ones go."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.new: dict[str, tuple[str, str, int]] = {}
        self.old: dict[str, tuple[str, str, int]] = {}

    def again(self, key: str) -> tuple[str, str, int] | None:
        """An old entry, which is new again."""
        found = self.old.get(key)
        return None if found is None else self.keep(key, found)

    def keep(self, key: str, value: tuple[str, str, int]) -> tuple[str, str, int]:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value


def spans(characters: Iterable[str]) -> list[tuple[str, str]]:
    """First and last of each run of neighbouring characters."""
    out: list[list[str]] = []
    for c in sorted(characters):
        if out and ord(c) == ord(out[-1][1]) + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


class Encoder:
    """Texts to ids as a vocabulary file says: special strings, NFC, lower case, split into words, bytes, automaton."""

    def __init__(self, definition: bytes):
        said = json.loads(definition)
        model = said["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.definition = definition
        self.automaton = TokenAutomaton(model["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.automaton.labels |= {number: label for label, number in self.special.items()}
        self.pattern = said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(self.pattern)
        self.odd = self._odd_characters()
        self._made_ready()

    def __getstate__(self) -> dict:
        return {name: getattr(self, name) for name in ("definition", "automaton", "special", "pattern", "odd")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._made_ready()

    def _made_ready(self) -> None:
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.words, self.odds = regex.compile(self.pattern), re.compile(self.odd)
        self.codes = bytes(self.automaton.code[s] for s in byte_symbols())
        self.library: Tokenizer | None = None
        self.known, self.composed = Memo(MEMO), Memo(MEMO // 2)

    def _odd_characters(self) -> str:
        """A pattern of the characters that the file's library lowers, composes or classes otherwise than Python does."""
        library = Tokenizer.from_buffer(self.definition)
        odd: set[str] = set()

        def compare(some: list[str], between: str) -> None:
            """Each character stands between two of a known class: it belongs to that class where no word ends at it."""
            text = between + "".join([c + between for c in some])
            mine = {place for m in self.words.finditer(text) for place in m.span()}
            theirs = {place for _, span in library.pre_tokenizer.pre_tokenize_str(text) for place in span}
            odd.update(some[(place - 1) // 2] for place in mine ^ theirs)

        for block in _BLOCKS:
            for at in range(block.start, block.stop, 8192):
                some = [chr(c) for c in range(at, min(at + 8192, block.stop)) if not chr(c).isspace()]
                # What neither composes nor is white space keeps them apart.
                theirs = library.normalizer.normalize_str("\x01".join(some)).split("\x01")
                ours = self._normalised("\x01".join(some)).split("\x01")
                odd.update(c for c, x, y in zip(some, theirs, ours) if x != y)
                plain = [c for c, x in zip(some, ours) if c == x]
                compare(plain, "a")
                compare([c for c in plain if not c.isalpha()], "!")
        return "[" + "".join(f"{re.escape(a)}-{re.escape(b)}" for a, b in spans(odd)) + "]" if odd else "(?!)"

    def _word(self, word: str) -> tuple[str, str, int]:
        """A word is remembered as the stretch that it may be as well."""
        found = self.known.new.get(word) or self.known.again(word)
        if found is None:
            ids = self.automaton.read(word.encode().translate(self.codes))
            found = self.known.keep(word, (" ".join(map(str, ids)), self.automaton.decode(ids), len(ids)))
        return found

    def _normalised(self, piece: str) -> str:
        """NFC, then lower case character by character: no rule that looks at a letter's place in its word."""
        return piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()

    def _words_of(self, piece: str) -> list[str]:
        if not self.odds.search(piece):
            return self.words.findall(self._normalised(piece))
        if self.library is None:
            self.library = Tokenizer.from_buffer(self.definition)
        lowered = self.library.normalizer.normalize_str(piece)
        return [lowered[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(lowered)]

    def _parts(self, piece: str) -> list[tuple[str, str, int]]:
        parts, at = [], 0
        for match in self.specials.finditer(piece):
            parts += map(self._word, self._words_of(piece[at : match.start()]))
            parts.append((str(self.special[match[0]]), match[0], 1))
            at = match.end()
        return parts + [self._word(w) for w in self._words_of(piece[at:] if at else piece)]

    def _piece(self, piece: str) -> tuple[str, str, int]:
        """Ids, labels and count of a stretch without white space that is no word remembered of late."""
        if piece.isascii() and piece.isalpha():
            return self.known.again(piece) or self.known.keep(piece, self._word(piece.lower()))
        found = self.composed.new.get(piece) or self.composed.again(piece)
        if found is None:
            parts = self._parts(piece)
            if len(parts) == 1:
                found = parts[0]
            else:
                found = (" ".join([p[0] for p in parts]), " ".join([p[1] for p in parts]), sum([p[2] for p in parts]))
            self.composed.keep(piece, found)
        return found

    def encode(self, text: str) -> tuple[str, str, int]:
        """The ids joined by spaces, the decoded text, and the number of ids."""
        pieces = _SPACES.split(text) if _NOT_SPACE.search(text) else text.split()
        known = self.known.new
        found = [known.get(piece) or self._piece(piece) for piece in pieces if piece]
        return " ".join([f[0] for f in found]), " ".join([f[1] for f in found]), sum([f[2] for f in found])


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Adds n_tokens, ids (if `with_ids`), ids_sha256 and decoded_sha256 to every row of `docs`.

    `vocabulary` is the path of the vocabulary file, read and compiled once by the driver."""
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(Encoder(file.read()))
    made = ["n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
    kept = [c for c in docs.columns if c not in made]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept]
        + ["n_tokens long", *["ids array<int>"] * with_ids, "ids_sha256 string", "decoded_sha256 string"]
    )

    def digest(value: str) -> str:
        return hashlib.sha256(value.encode()).hexdigest()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            counts, numbers, ids_digests, decoded_digests = [], [], [], []
            for value in batch.column(batch.num_columns - 1):
                ids, decoded, count = encoder.encode(value.as_py() or "")
                counts.append(count)
                if with_ids:
                    numbers.append(np.fromstring(ids, np.int32, sep=" "))
                ids_digests.append(digest(ids))
                decoded_digests.append(digest(decoded))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(counts, pa.int64()),
                    *([pa.array(numbers, pa.list_(pa.int32()))] * with_ids),
                    pa.array(ids_digests, pa.string()),
                    pa.array(decoded_digests, pa.string()),
                ],
                names=[*kept, *made],
            )

    body = F.col(f"`{text}`").cast("string").alias(own("text"))
    return docs.select(*[f"`{c}`" for c in kept], body).mapInArrow(encoded, schema)

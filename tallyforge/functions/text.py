"""SQL expression text shared by redaction, detection and extraction.

The rule lists here run to hundreds of patterns, so the helpers write one SQL expression instead of building it node
by node: an operand is SQL text (a column name or any expression), and so is the result; `F.expr` makes it a column.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

# Case-insensitive with Unicode letters, digits and spaces, whatever the Java version's own default for \b is.
ANY_CASE = "(?iU)"
UNICODE = "(?U)"
# The number and date shapes statements use.
NUMBER = r"([\d,]+\.?\d*)"
DATE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
AFTER_LABEL = r"[:\s]+"
# The same with digits of any script named as such, and white space of any script inside a class: without the flag that
# widens every class a search is far quicker.
ANY_NUMBER, ANY_DATE = (shape.replace(r"\d", r"\p{Nd}") for shape in (NUMBER, DATE))
ANY_SPACE = r"\s\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_LABELLED_NUMBER = ANY_NUMBER[1:-1]
_SPACES = r"[\s\x1c-\x1f]+"
# The same class without the flag.
_ANY_SPACES = ANY_SPACE + r"\x1c-\x1f"
# The characters of that class, as SQL text: white space of any script, and four separators.
_WHITE = "".join(f"\\u{code:04x}" for code in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
# Letters that count as a plain one when case is ignored: long s, dotless and dotted i, kelvin sign.
_SMALL = "abcdefghijklmnopqrstuvwxyzſıİK"
_LARGE = "ABCDEFGHIJKLMNOPQRSTUVWXYZSIIK"


def quote(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(value: str, name: str, body: str) -> str:
    """`body` with `name` standing for a value computed once per row, however often the body uses it. The body is
    evaluated branch by branch and stays out of generated code, which a few hundred rules would overflow."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _is_ascii(text: str) -> str:
    return f"octet_length({text}) = char_length({text})"


def fold_upper(text: str) -> str:
    """Capitals throughout, so that a case-insensitive search for plain letters becomes a byte search."""
    return f"CASE WHEN {_is_ascii(text)} THEN upper({text}) ELSE translate({text}, '{_SMALL}', '{_LARGE}') END"


def fold_case(text: str) -> str:
    """Small letters throughout, for patterns written in small letters. The text is computed once, also where a filter
    on what is read from it brings its whole expression along."""
    wide = "translate(lower(translate(f, 'İ', 'i')), 'ſı', 'si')"
    return bind(text, "f", f"CASE WHEN {_is_ascii('f')} THEN lower(f) ELSE {wide} END")


def coalesce(*parts: str) -> str:
    return parts[0] if len(parts) == 1 else f"coalesce({', '.join(parts)})"


def matches(text: str, pattern: str) -> str:
    return f"{text} RLIKE {quote(pattern)}"


def replace(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, {quote(pattern)}, {quote(to)})"


def labels(text: str) -> list[str]:
    """'net pay | take home' -> ['net pay', 'take home']."""
    return [label.strip() for label in text.split("|")]


def labelled(label: str, value: str, flags: str = UNICODE) -> str:
    """Pattern for a label, spaces of any kind between its words, then the value as group 1."""
    return flags + r"\s+".join(label.split(" ")) + AFTER_LABEL + value


def labelled_plain(label: str, value: str) -> str:
    """The same for text whose spaces are collapsed: single plain spaces, and digits of any script named as such. Without
    the flag that widens every class the search is far quicker."""
    return label + "[: ]+" + value.replace(r"\d", r"\p{Nd}").replace(r"\s", " ")


def where_seen(label: str, text: str, read: str) -> str:
    """`read` only where the label's longest plain word occurs at all, which a byte search tells."""
    plain = re.findall(r"[a-z0-9']+", re.sub(r"\([^)]*\)\?|.\?|\\.", " ", label))
    return f"CASE WHEN contains({text}, {quote(max(plain, key=len))}) THEN {read} END" if plain else read


def captured(text: str, pattern: str, group: int = 1) -> str:
    """The group's text, or NULL where the pattern does not match."""
    return f"nullif(regexp_extract({text}, {quote(pattern)}, {group}), '')"


def money(text: str, kind: str = "decimal(18,2)") -> str:
    """Nothing is no number; it never meets the cast, as a failed cast costs far more than all else here."""
    return f"try_cast(nullif(translate({text}, '$,', ''), '') AS {kind})"


def number_at(text: str, pattern: str, group: int = 1, kind: str = "decimal(18,2)") -> str:
    """The group read as a number; NULL where nothing matches or it does not read as one."""
    return money(f"regexp_extract({text}, {quote(pattern)}, {group})", kind)


def spelled(label: str) -> list[str]:
    """The plain spellings of a label with optional parts: 'taxes?' -> ['taxes', 'taxe']. Parts are a character, an escaped
    one or a (?:group), each with or without `?`."""
    made = [""]
    for part in re.finditer(r"(\(\?:([^()]*)\)|\\(.)|([^\\()?]))(\?)?", label):
        text = next(g for g in part.groups()[1:4] if g is not None)
        made = [m + t for m in made for t in ((text, "") if part[5] else (text,))]
    return made


class LabelReader:
    """Numbers behind labels, all found in one walk over a text.

    A number counts as labelled where only spaces and colons, and perhaps a dollar sign, stand between it and a label. So the
    text is searched once for such numbers, each with the few characters before it; the longest label those end with says
    which others they end with. The text has small letters and single plain spaces; a label holds no number behind a space or
    colon. `before` and `values` are the SQL of the two arrays the fields are read from."""

    def __init__(self, labels_of: Iterable[str]):
        spellings = {s for names in labels_of for label in labels(names) for s in spelled(label)}
        self.known = sorted(spellings, key=lambda s: (-len(s), s))
        self.width = len(self.known[0])

    def before(self, text: str) -> str:
        """The longest label before each number, NULL where there is none."""
        pattern = rf"(?s)(?=[: ]+\$?[\p{{Nd}},])(?<=(.{{{self.width}}}))[: ]+\$?{_LABELLED_NUMBER}"
        held = f"regexp_extract_all(concat(repeat('\\n', {self.width}), {text}), {quote(pattern)}, 1)"
        # By the last character first, so that few labels are compared.
        last: dict[str, list[str]] = {}
        for label in self.known:
            last.setdefault(label[-1], []).append(f"WHEN endswith(b, {quote(label)}) THEN {quote(label)}")
        chosen = " ".join(f"WHEN endswith(b, {quote(c)}) THEN CASE {' '.join(branches)} END" for c, branches in last.items())
        return f"transform({held}, b -> CASE {chosen} END)"

    def values(self, text: str) -> str:
        return f"regexp_extract_all({text}, {quote(rf'[: ]+(\$?{_LABELLED_NUMBER})')}, 1)"

    def number(self, before: str, values: str, names: str, kind: str = "decimal(18,2)", dollar: bool = True) -> str:
        """The first label whose first value also reads as a number; without `dollar` only values without that sign."""

        def value(label: str) -> str:
            held = [quote(known) for known in self.known if known.endswith(tuple(spelled(label)))]
            if dollar and len(held) == 1:
                found = f"array_position({before}, {held[0]})"
            else:
                plain = "" if dollar else f" AND NOT startswith({values}[i], '$')"
                found = f"array_position(transform({before}, (b, i) -> b IN ({', '.join(held)}){plain}), true)"
            # No label gives NULL, not an empty text, so that it need not be asked for, which would look for the label twice.
            return f"try_cast(translate(get({values}, cast({found} AS int) - 1), '$,', '') AS {kind})"

        return coalesce(*[value(label) for label in labels(names)])


def first_capture(lowered: str, names: str, value: str) -> str:
    """The first label that matches decides. Labels are looked for in case-folded text."""
    return coalesce(
        *[where_seen(label, lowered, captured(lowered, labelled(label, value))) for label in labels(names)]
    )


def first_name(text: str, names: str, value: str) -> str:
    """Like `first_capture`, over text in its own case."""
    return coalesce(*[captured(text, labelled(label, value, ANY_CASE)) for label in labels(names)])


def first_number(lowered: str, names: str, kind: str = "decimal(18,2)", sign: str = r"\$?") -> str:
    """The first label whose value also reads as a number. Labels are looked for in case-folded text."""
    return coalesce(
        *[
            where_seen(label, lowered, number_at(lowered, labelled(label, sign + NUMBER), 1, kind))
            for label in labels(names)
        ]
    )


def first_date(lowered: str, names: str) -> str:
    return first_capture(lowered, names, f"({DATE})")


def any_of(patterns: Iterable[str], flags: str = UNICODE) -> str:
    return flags + "|".join(f"(?:{pattern})" for pattern in patterns)


_LITERAL = re.compile(r"(?:[a-z0-9 ]|\\s[+*]|\\b|\[[^\]\\]*(?:\\s)?\]\?|\(\?:[^()]*\))+")


def needed(pattern: str) -> str:
    """A word that every match of the pattern holds, in small letters; empty where that is not plain to see. Plain are small
    letters and digits with white space, word ends, optional classes and groups between them."""
    if not _LITERAL.fullmatch(pattern):
        return ""
    return max(re.sub(r"\\s[+*]|\\b|\[[^\]]*\]\?|\(\?:[^()]*\)", "\0", pattern).split("\0"), key=len)


def holds_any(text: str, words: Iterable[str]) -> str:
    """Whether one of the words occurs, by byte searches."""
    return "(" + " OR ".join(f"contains({text}, {quote(word)})" for word in dict.fromkeys(words)) + ")"


def first_kind(text: str, kinds: dict[str, tuple[str, ...]], flags: str = UNICODE) -> str:
    """Name of the first kind one of whose patterns occurs in the text. Patterns that need a plain word run only where one
    of their kind's words occurs."""

    def branch(name: str, patterns: tuple[str, ...]) -> str:
        words = [needed(pattern) for pattern in patterns]
        found = matches("t", any_of(patterns, flags))
        if flags == UNICODE and all(words):
            plain = all(pattern == word for pattern, word in zip(patterns, words))
            found = holds_any("t", words) + ("" if plain else f" AND {found}")
        return f"WHEN {found} THEN {quote(name)}"

    return bind(text, "t", f"CASE {' '.join(branch(name, patterns) for name, patterns in kinds.items())} END")


def keyword_count(lowered: str, keywords: tuple[str, ...]) -> str:
    """How many of the keywords occur at least once."""
    return "(" + " + ".join(f"int(contains({lowered}, {quote(keyword)}))" for keyword in keywords) + ")"


def collapse_spaces(text: str) -> str:
    """White space of any kind and length as one plain space; a plain space that stands alone is passed over."""
    return replace(text, rf"[{_ANY_SPACES}&&[^ ]][{_ANY_SPACES}]*| [{_ANY_SPACES}]+", " ")


def strip_spaces(text: str) -> str:
    """Without what `_SPACES` matches at both ends, by a plain comparison of characters."""
    return f"trim(BOTH '{_WHITE}' FROM {text})"


def words(text: str) -> str:
    return f"filter(split({text}, {quote(UNICODE + _SPACES)}), w -> w <> '')"


def title_case(text: str) -> str:
    """Capital after every non-letter, small letters elsewhere ("o'reilly" -> "O'Reilly")."""
    runs = f"regexp_extract_all({text}, {quote(r'(\p{L}+|\P{L}+)')}, 1)"
    return f"array_join(transform({runs}, r -> concat(upper(left(r, 1)), lower(substring(r, 2)))), '')"

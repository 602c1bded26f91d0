"""Definitions and calls of the brace languages, read from the tokens of whole files.

Spark cuts the bare text of a file (no comments, no literals) into tokens with one pattern and hands
them over as an array. Here the arrays of a batch of files become flat numpy arrays: line of each token,
bracket depth as a running sum, partners by a search in the brackets of one depth. Preprocessor
branches all start at the depth that stands at their ``#if``, and what follows ``#endif`` goes on from the
end of the first branch. The rules then look from a name outwards: its bracket, the partner, what stands
behind and in front. A statement may run over any number of lines.

The rules stay an approximation: macros are not expanded, names are not looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .languages import KEYWORDS, _FIRST, _PART
from .text import LINE_BREAK

# Words of the languages that stand in front of a bracket and call nothing.
_C_WORDS = (
    "__attribute__ __attribute __declspec __asm__ __asm asm alignas _Alignas _Alignof _Static_assert _Generic __typeof__ typeof "
    "void bool char short int long float double signed unsigned _Bool defined"
)
_CPP_WORDS = f"{_C_WORDS} auto constexpr const_cast dynamic_cast reinterpret_cast static_cast explicit requires wchar_t co_await co_yield co_return and or not throw"
NO_CALLS = {
    "c": {*KEYWORDS["c"].split(), *_C_WORDS.split()},
    "cpp": {*KEYWORDS["cpp"].split(), *_CPP_WORDS.split()},
    "go": set(KEYWORDS["go"].split()),
    "rs": {*KEYWORDS["rs"].split(), "Fn", "FnMut", "FnOnce"},
}
# Words that can't be the type in front of a function's name.
_NO_TYPE = {
    "return", "else", "new", "delete", "throw", "goto", "case", "do", "sizeof", "typedef", "co_return", "co_await", "co_yield", "using", "if", "while",
    "for", "switch", "and", "or", "not", "default", "operator", "namespace", "public", "private", "protected",
}
_ATTRIBUTES = {"__attribute__", "__attribute", "__declspec", "alignas", "_Alignas"}
# Signs of the bounds in a list of type parameters.
_BOUNDS = frozenset({":", "+", "=", "?", "(", ")", "=>"})
# Signs that may follow a parameter list before the body.
_HEADER_SIGNS = {"&", "&&", "->", ":", "[", "("}

_DIRECTIVE = r"(?m:^)[ \t]*+#(?:[^\n\r\\]++|\\(?:\r\n|[\s\S]))*+"
_OPERATOR = (
    rf"operator(?!{_PART})\s*(?:\(\s*\)|\[\s*\]|\"\"\s*{_FIRST}{_PART}*+|(?:new|delete)(?!{_PART})(?:\s*\[\s*\])?"
    rf"|[^\s\p{{L}}\p{{N}}_()\[\]{{}};,\"]++|{_FIRST}[\p{{L}}\p{{N}}\p{{M}}_:<>*&\s]*?)(?=\s*[(<])"
)
_COMMON = rf"{LINE_BREAK}|{_FIRST}{_PART}*+|\p{{N}}(?:{_PART}|\.|')*+|->|=>|::|==|!=|<=|>=|&&|\|\||\"\"|\S"
#: Suffix -> pattern of the next token; white space but line breaks gives none.
TOKENS = {
    "c": f"{_DIRECTIVE}|{_COMMON}",
    "cpp": f"{_DIRECTIVE}|{_OPERATOR}|{_COMMON}",
    "go": _COMMON,
    "rs": rf"'{_FIRST}{_PART}*+(?!')|{_COMMON}",
}
SCHEMA = "path string, line_no int, kind string, name string, end_line int, calls array<string>"
_BREAK = re.compile(LINE_BREAK)
#: Files whose tokens are worked on together, and the most tokens of a type argument list.
FILES_AT_ONCE, MOST_ARGUMENTS = 200, 64


class Stream:
    """Tokens of some files without their line breaks, one after the other; each file ends with an empty token."""

    def __init__(self, tokens: pa.Array, suffixes: list[str]):
        lengths = np.asarray(tokens.value_lengths().fill_null(0), np.int64)
        coded = tokens.flatten().dictionary_encode()
        words = [*coded.dictionary.to_pylist(), ""]
        ends = np.cumsum(lengths)
        codes = np.insert(np.asarray(coded.indices, np.int64), ends, len(words) - 1)
        lengths = lengths + 1
        file = np.repeat(np.arange(len(lengths)), lengths)
        first = np.cumsum(lengths) - lengths
        # line breaks: a token of their own, or those inside a continued directive
        solid = np.array([not w.isspace() for w in words])
        breaks = np.array([len(_BREAK.findall(w)) for w in words], np.int64)[codes]
        before = np.cumsum(breaks) - breaks
        line = before - before[first][file] + 1 if len(first) else before
        keep = solid[codes]
        self.file, self.line = file[keep], line[keep]
        self.word = [words[c] for c in codes[keep].tolist()]
        self.suffix = suffixes
        named = np.array([w[:1].isidentifier() for w in words])
        self.named = named[codes[keep]]
        delta = np.array([1 if w in ("(", "[", "{") else -1 if w in (")", "]", "}") else 0 for w in words], np.int64)[codes[keep]]
        kind = np.array([w if w in ("(", ")", "[", "]", "{", "}") else "" for w in words])[codes[keep]]
        self._match(delta, kind, np.array([w.lstrip(" \t").startswith("#") for w in words])[codes[keep]])
        stops = np.array([w in ("{", ";", "=", "") for w in words])[codes[keep]]
        self._stops = self._sorted(np.flatnonzero(stops | (delta < 0)), self.level + (delta < 0))

    def _match(self, delta: np.ndarray, kind: np.ndarray, directive: np.ndarray) -> None:
        """Depth of every token (a bracket has that of its surroundings) and the partner of every bracket."""
        n = len(delta)
        after = np.cumsum(delta)
        starts = np.flatnonzero(np.diff(self.file, prepend=-1))
        after = after - np.repeat((after - delta)[starts], np.diff(starts, append=n))
        shift = np.zeros(n + 1, np.int64)
        offset, held, places = 0, [], np.flatnonzero(directive).tolist()
        for i, following in zip(places, [*places[1:], n - 1]):
            name = "".join(self.word[i].lstrip(" \t")[1:].split(None, 1)[:1])[:4]
            now, old = int(after[i]) + offset, offset
            if name[:2] == "if":
                held.append([now, None])
            elif name in ("else", "elif") and held:
                held[-1][1] = now if held[-1][1] is None else held[-1][1]
                offset = held[-1][0] - int(after[i])
            elif name == "endi" and held:
                start, end = held.pop()
                offset = (now if end is None else end) - int(after[i])
            shift[i] += offset - old
            if self.file[following] != self.file[i]:  # each file starts anew
                shift[starts[self.file[i] + 1]] -= offset
                offset, held = 0, []
        after = after + np.cumsum(shift[:n])
        self.level = np.where(delta > 0, after - delta, after)
        self.partner = np.full(n, -1, np.int64)
        self._opens = self._sorted(np.flatnonzero(delta > 0), self.level)
        # by kind: a brace that each of two branches opens has its partner behind the round brackets between
        for pair in ("()", "[]", "{}"):
            opens, closes = (np.flatnonzero(kind == sign) for sign in pair)
            self.partner[opens] = self._next(self._sorted(closes, self.level), opens, self.level[opens])
            self.partner[closes] = self._last(self._sorted(opens, self.level), closes, self.level[closes])

    def _key(self, at: np.ndarray, level: np.ndarray) -> np.ndarray:
        low = np.int64(1) << 20
        return ((self.file[at] << 21) + np.clip(level, -low + 1, low - 1) + low) * (len(self.file) + 1) + at

    def _sorted(self, at: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self._key(at, level[at])
        order = np.argsort(key, kind="stable")
        return key[order], at[order]

    def _next(self, entries: tuple[np.ndarray, np.ndarray], at: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The first entry of the level after each place (of the same file), -1 is none."""
        keys, places = entries
        own = self._key(at, level)
        found = np.searchsorted(keys, own, "right")
        there = found < len(keys)
        group = len(self.file) + 1
        there[there] = keys[found[there]] // group == own[there] // group
        return np.where(there, places[np.minimum(found, len(places) - 1)] if len(places) else -1, -1)

    def _last(self, entries: tuple[np.ndarray, np.ndarray], at: np.ndarray, level: np.ndarray) -> np.ndarray:
        keys, places = entries
        own = self._key(at, level)
        found = np.searchsorted(keys, own, "left") - 1
        there = found >= 0
        group = len(self.file) + 1
        there[there] = keys[found[there]] // group == own[there] // group
        return np.where(there, places[np.maximum(found, 0)] if len(places) else -1, -1)

    def stop(self, i: int) -> int:
        """The first ``{``, ``;``, ``=`` or end of scope on the level of token ``i``, from it on; -1 is none."""
        at = np.array([i])
        if self.word[i] in ("{", ";", "=", ""):
            return i
        return int(self._next(self._stops, at, self.level[at])[0])

    def scope(self, i: int) -> int:
        """The bracket around token ``i``, -1 at the top."""
        at = np.array([i])
        return int(self._last(self._opens, at, self.level[at] - 1)[0])

    def behind(self, i: int) -> int:
        """The place after the partner of bracket ``i``; -1 if it has none."""
        return int(self.partner[i]) + 1 if self.partner[i] >= 0 else -1

    def arguments(self, i: int, more: frozenset[str] = frozenset()) -> int:
        """The place after type arguments that start at ``<``; -1 if this is no such list."""
        depth = 0
        for j in range(i, min(i + MOST_ARGUMENTS, len(self.word))):
            w = self.word[j]
            depth += (w == "<") - (w == ">")
            if not depth:
                return j + 1
            if not (self.named[j] or w in ("<", ">", "::", ",", "*", "&", "[", "]", ";", "->") or w[:1].isdigit() or w[:1] == "'" or w in more):
                return -1
        return -1


def _c_attributes(s: Stream, j: int) -> int:
    """The place after attribute groups."""
    while True:
        if s.word[j] == "[" and s.word[j + 1] == "[" and s.partner[j] >= 0:
            j = s.behind(j)
        elif s.word[j] in _ATTRIBUTES and s.word[j + 1] == "(" and s.partner[j + 1] >= 0:
            j = s.behind(j + 1)
        else:
            return j


def _c_class(s: Stream, k: int) -> tuple[int, int] | None:
    """Name and body of a struct, union, enum or class that has both."""
    before = s.word[k - 1] if k else ""
    if before in ("enum", "friend", "typename") and s.word[k] != "enum":
        return None
    around = s.scope(k)
    if around >= 0 and s.word[around] != "{":
        return None
    j = k + 2 if s.word[k] == "enum" and s.word[k + 1] in ("class", "struct") else k + 1
    j, name = _c_attributes(s, j), -1
    while s.named[j] and s.word[j] != "final":
        if name >= 0 and s.word[j - 1] != "::" and not s.word[name].isupper():
            return None
        name, j = j, _c_attributes(s, j + 1)
        j += s.word[j] == "::"
    if name < 0:
        return None
    if s.word[j] == "<":
        j = s.arguments(j)
    j += j >= 0 and s.word[j] == "final"
    if j < 0 or s.word[j] not in ("{", ":"):
        return None
    body = s.stop(j)
    return (name, body) if body >= 0 and s.word[body] == "{" else None


def _c_function(s: Stream, k: int, opening: int, cpp: bool, classes: set[int]) -> tuple[int, int] | None:
    """Body of the function named at ``k``, and the place behind its parameters; None if it is none.

    A declarator may wrap the name in brackets: ``int (*pick(void))(int)``.
    """
    at, outer = s.behind(opening), k
    if at < 1:
        return None
    while s.word[at] == ")" and s.partner[at] >= 0 and s.word[s.partner[at] + 1] in ("*", "&", "&&", "^"):
        outer, at = int(s.partner[at]), at + 1
        if s.word[at] not in ("(", "["):  # a condition such as ``if (*next(x)) {``
            return None
        while s.word[at] in ("(", "[") and s.partner[at] >= 0:
            at = s.behind(at)
    body = s.stop(at)
    if s.word[at] in (":", "try"):  # member initialisers may be in braces: ``: x{a}, y(b) {``
        while body > 0 and s.word[body] == "{" and (s.named[body - 1] or s.word[body - 1] == ">") and s.word[body - 1] != "try":
            body = s.behind(body)
            body = s.stop(body) if body > 0 else -1
    if body < 0 or s.word[body] != "{":
        return None
    if at != body and not (s.named[at] or s.word[at] in _HEADER_SIGNS):
        return None
    around = s.scope(outer)
    if around >= 0 and s.word[around] != "{":
        return None
    before = s.word[outer - 1] if outer and s.file[outer - 1] == s.file[outer] else ""
    typed = before in ("*", "&", "&&", ">") or (outer > 0 and bool(s.named[outer - 1]) and before and before not in _NO_TYPE)
    if before == ")" and s.partner[outer - 1] > 0:
        typed = s.word[s.partner[outer - 1] - 1] in {*_ATTRIBUTES, "decltype", "explicit", "noexcept"}
    if typed:
        return body, at
    if not cpp or (s.word[k].isupper() and len(s.word[k]) > 1):
        return None
    member = around in classes
    qualified = before == "::" or (before == "~" and s.word[outer - 2] == "::")
    return (body, at) if member or qualified else None


def _c(s: Stream, first: int, last: int, cpp: bool) -> tuple[list, list]:
    stop_words, found, calls = NO_CALLS["cpp" if cpp else "c"], [], []
    skip = np.zeros(last - first + 1, bool)
    direct: dict[int, int] = {}  # of member initialisers: the level on which names call nothing
    classes: set[int] = set()
    word, kinds = s.word, {"struct", "union", "enum", *(["class"] if cpp else [])}
    for k in range(first, last):
        w = word[k]
        if w in kinds:
            hit = _c_class(s, k)
            if hit:
                classes.add(hit[1])
                found.append(("class", hit[0], hit[0], hit[1]))
        elif (w in _ATTRIBUTES and word[k + 1] == "(") or (w == "[" and word[k + 1] == "["):
            start = k if w == "[" else k + 1
            if s.partner[start] >= 0:
                skip[start - first : s.partner[start] - first] = True
        if not s.named[k] or w in stop_words or skip[k - first] or direct.get(k) == s.level[k]:
            continue
        opening = k + 1
        if cpp and word[opening] == "<":
            opening = s.arguments(opening)
        if opening < 0 or word[opening] != "(":
            continue
        hit = _c_function(s, k, opening, cpp, classes)
        if hit:
            found.append(("function", k, k, hit[0]))
            behind = hit[1]
            while behind < hit[0] and not (word[behind] == ":" and s.level[behind] == s.level[hit[0]]):
                behind += 1
            for j in range(behind, hit[0]):
                direct[j] = s.level[hit[0]]
        else:
            calls.append(k)
    return found, calls


def _go_type(s: Stream, j: int) -> int:
    """The body of a struct or interface whose name stands at ``j``; -1 if it is none."""
    at = j + 1
    if s.word[at] == "[" and s.word[at + 1] != "]" and s.partner[at] >= 0:
        at = s.behind(at)
    return at + 1 if s.word[at] in ("struct", "interface") and s.word[at + 1] == "{" else -1


def _go(s: Stream, first: int, last: int) -> tuple[list, list]:
    stop_words, found, names, calls, word = NO_CALLS["go"], [], set(), [], s.word
    for k in range(first, last):
        w = word[k]
        if w == "func":
            j = k + 1
            if word[j] == "(":
                j = s.behind(j)
            # methods have no type parameters: with them, a literal's result type stands here
            if j < 1 or s.level[k] or not s.named[j] or word[j] in stop_words or word[j + 1] not in ("(", "[")[: 1 + (j == k + 1)]:
                continue
            names.add(j)
            at = s.behind(j + 1)
            if at > 0 and word[at] == "(" and word[j + 1] == "[":
                at = s.behind(at)
            if at > 0 and word[at] == "(":  # several results
                at = s.behind(at)
            while 0 < at < last and word[at] != "{" and s.line[at] == s.line[at - 1]:
                if word[at] in ("struct", "interface") and word[at + 1] == "{":
                    at += 1
                at = s.behind(at) if word[at] in ("(", "[", "{") else at + 1
            if 0 < at < last and word[at] == "{" and s.line[at] == s.line[at - 1]:
                found.append(("function", j, j, at))
        elif w == "type":
            grouped = word[k + 1] == "(" and s.partner[k + 1] >= 0
            inside = range(k + 2, int(s.partner[k + 1])) if grouped else [k + 1]
            for j in inside:
                if s.named[j] and s.level[j] == s.level[k] + grouped and (not grouped or s.line[j] > s.line[j - 1] or word[j - 1] in ("(", ";")):
                    body = _go_type(s, j)
                    if body >= 0:
                        found.append(("class", j, j, body))
        elif s.named[k] and w not in stop_words and k not in names:
            at = k + 1
            if word[at] == "[" and s.line[at] == s.line[k] and s.partner[at] >= 0:
                at = s.behind(at)
            if word[at] == "(" and s.line[at] == s.line[at - 1]:
                calls.append(k)
    return found, calls


def _rust_path(s: Stream, j: int) -> int:
    """The first name of a type behind references, ``dyn`` and lifetimes; -1 if there is none."""
    while s.word[j] in ("&", "*", "mut", "const", "dyn", "(", "[", "!", "?", "for") or s.word[j][:1] == "'":
        j += 1
    return j if s.named[j] else -1


def _rust(s: Stream, first: int, last: int) -> tuple[list, list]:
    stop_words, found, names, calls, word = NO_CALLS["rs"], [], set(), [], s.word
    skip_to = first
    for k in range(first, last):
        w, before = word[k], word[k - 1] if k > first else ""
        if k < skip_to:
            continue
        if w == "#":
            j = k + 1 + (word[k + 1] == "!")
            if word[j] == "[" and s.partner[j] >= 0:
                skip_to = s.behind(j)
            continue
        if w == "fn" and s.named[k + 1]:
            names.add(k + 1)
            body = s.stop(k)
            while body >= 0 and word[body] == "=":  # a default of a type parameter
                body = s.stop(body + 1)
            if body >= 0 and word[body] == "{":
                found.append(("function", k + 1, k, body))
        elif w in ("struct", "enum", "trait", "union", "impl") and before not in ("->", "(", ":", "&", "<", ",", "+", "=", "::", ".", "dyn"):
            j = k + 1
            if w == "impl":
                j = s.arguments(j, _BOUNDS) if word[j] == "<" else j
                body = s.stop(j) if j >= 0 else -1
                if body < 0:
                    continue
                level = s.level[j]
                traits = [i for i in range(j, body) if word[i] == "for" and s.level[i] == level and word[i + 1] != "<"]
                j = _rust_path(s, traits[0] + 1 if traits else j)
                while j >= 0 and word[j + 1] == "::" and s.named[j + 2]:
                    j += 2
            elif not s.named[j]:
                continue
            body = s.stop(k) if j >= 0 else -1
            while body >= 0 and word[body] == "=":
                body = s.stop(body + 1)
            if body >= 0 and word[body] == "{":
                found.append(("class", j, k, body))
        elif s.named[k] and w not in stop_words and k not in names:
            at = k + 1
            if word[at] == "::" and word[at + 1] == "<":
                at = s.arguments(at + 1)
            if at > 0 and word[at] == "(":
                calls.append(k)
    return found, calls


def _spelled(name: str) -> str:
    """``operator ==`` as ``operator==``, ``operator  bool`` as ``operator bool``."""
    parts = name.split()
    return " ".join(parts) if len(parts) < 2 or parts[1][0].isidentifier() else "".join(parts)


def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, suffix, tokens`` -> a row for each definition with a body, and a row for each line with calls."""
    rules = {
        "c": lambda s, a, b: _c(s, a, b, False),
        "cpp": lambda s, a, b: _c(s, a, b, True),
        "go": _go,
        "rs": _rust,
    }
    for batch in batches:
        for start in range(0, batch.num_rows, FILES_AT_ONCE):
            part = batch.slice(start, FILES_AT_ONCE)
            paths, suffixes = part.column(0).to_pylist(), part.column(1).to_pylist()
            s = Stream(part.column(2), suffixes)
            ends = np.searchsorted(s.file, np.arange(len(paths)), "right") - 1  # the empty token of each file
            rows, first = [], 0
            for path, suffix, end in zip(paths, suffixes, ends.tolist()):
                last_line = int(s.line[end - 1]) if end > first else 1
                found, calls = rules[suffix](s, first, end)
                for kind, name, at, body in found:
                    close = s.partner[body]
                    rows.append((path, int(s.line[at]), kind, _spelled(s.word[name]), int(s.line[close]) if close >= 0 else last_line, None))
                by_line: dict[int, list[str]] = {}
                for k in calls:
                    by_line.setdefault(int(s.line[k]), []).append(_spelled(s.word[k]))
                rows.extend((path, line, None, None, None, names) for line, names in by_line.items())
                first = end + 1
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()))
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "line_no", "kind", "name", "end_line", "calls"])

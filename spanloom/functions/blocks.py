"""Lines, definitions, calls and blocks of indented languages; whole files in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import languages as lang

SCHEMA = (
    "path STRING, line_no INT, kind STRING, name STRING, calls ARRAY<STRING>, has_bracket BOOLEAN, "
    "end_line INT, owners ARRAY<STRING>, n_named INT"
)
_NAMES = ["path", "line_no", "kind", "name", "calls", "has_bracket", "end_line", "owners", "n_named"]
# Text worked on at a time; one longer file is taken alone.
SLICE_BYTES = 8 << 20
# The rules of ``languages`` without look-around, which Arrow's patterns lack: the run of name signs that ends
# in front of a bracket starts at its leftmost match, and first sign and keywords are tested on the run.
_RUN = r"(?P<name>[\p{L}\p{N}\p{M}_]+)"
_BEFORE_BRACKET = _RUN + r"\s*$"
_LAST_RUN = _RUN + r"[ \t]*\\?$"
_STARTS_NAME = r"^[\p{L}\p{Nl}_]"
_FUNCTION, _CLASS = (
    rules["py"].replace("*+", "*").replace("([", "(?P<name>[") for rules in (lang.FUNCTION_RULES, lang.CLASS_RULES)
)
_KEYWORDS = pa.array(lang.KEYWORDS["py"].split())


def _last_rows(first: np.ndarray, indent: np.ndarray, goes_on: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For the rows ``asked``: the last row of the block that starts there.

    ``first`` marks the first row of a file. A line closes the levels from its own indent to below the one
    above it; after a line of closing brackets the deeper of the two lines above counts.
    """
    n = len(first)
    file = np.cumsum(first)
    back = np.concatenate([indent[:1], indent[:-1]])
    back2 = np.concatenate([indent[:1], back[:-1]])
    has_two = ~first & ~np.concatenate([[True], first[:-1]])
    above = np.where(np.concatenate([[False], goes_on[:-1]]) & has_two, np.maximum(back, back2), back)
    closers = np.flatnonzero(~first & ~goes_on & (above > indent))
    starts = np.append(np.flatnonzero(first), n)
    ends = starts[file[asked]] - 1
    deeper = np.zeros(n, bool)
    deeper[:-1] = ~first[1:] & (indent[1:] > indent[:-1])
    ends[~deeper[asked]] = asked[~deeper[asked]]
    low, high = indent[closers], above[closers]
    for level in np.unique(indent[asked[deeper[asked]]]):
        mine = np.flatnonzero(deeper[asked] & (indent[asked] == level))
        crossed = closers[(low <= level) & (level < high)]
        at = np.searchsorted(crossed, asked[mine], "right")
        known = at < len(crossed)
        stop, mine = crossed[at[known]], mine[known]
        same = file[stop] == file[asked[mine]]
        ends[mine[same]] = stop[same] - 1
    return ends


def _mask(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values, False).to_numpy(zero_copy_only=False)


def _matched(texts: pa.Array, pattern: str) -> tuple[np.ndarray, pa.Array]:
    """Which texts the pattern matches, and its name in those."""
    found = pc.extract_regex(texts, pattern)
    return found.is_valid().to_numpy(zero_copy_only=False), pc.struct_field(found.drop_null(), "name")


def _named(rest: pa.Array, word: str, pattern: str) -> tuple[np.ndarray, pa.Array]:
    """Rows that define something, and its name; the plain test for ``word`` stands for nothing but speed."""
    rows = np.flatnonzero(_mask(pc.match_substring(rest, word)))
    hit, names = _matched(rest.take(pa.array(rows)), pattern)
    return rows[hit], names


def _called(rest: pa.Array, bracket: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Row and name of each call in order; rows ``below`` end with a name that the next line's bracket calls."""
    rows = np.flatnonzero(bracket)
    pieces = pc.split_pattern(rest.take(pa.array(rows)), "(")
    count = pc.list_value_length(pieces).to_numpy()
    inner = np.ones(count.sum(), bool)
    inner[np.cumsum(count) - 1] = False
    hit, names = _matched(pieces.flatten().filter(pa.array(inner)), _BEFORE_BRACKET)
    site = np.repeat(rows, count - 1)[hit]
    good = _mask(pc.and_(pc.match_substring_regex(names, _STARTS_NAME), pc.invert(pc.is_in(names, value_set=_KEYWORDS))))
    site, names = site[good], names.filter(pa.array(good))
    if len(below):
        last = pc.fill_null(pc.struct_field(pc.extract_regex(rest.take(pa.array(below)), _LAST_RUN), "name"), "")
        site, names = np.concatenate([site, below]), pa.concat_arrays([names, last])
        order = np.argsort(site, kind="stable")
        site, names = site[order], names.take(pa.array(order))
    return site, names


def _file_rows(path: pa.Array, content: pa.Array, joined: pa.Array) -> pa.RecordBatch:
    """One row for each non-blank line of some files."""
    split = pc.split_pattern(content, "\n")
    count = pc.fill_null(pc.list_value_length(split), 0).to_numpy()
    text = split.flatten()
    file = np.repeat(np.arange(len(count)), count)
    line = np.arange(len(file)) - np.repeat(np.cumsum(count) - count, count) + 1
    rest = pc.ascii_ltrim(text, characters=" \t")
    size = pc.binary_length(rest).to_numpy()
    filled = np.flatnonzero(size > 0)
    file, line = file[filled], line[filled].astype(np.int32)
    indent = (pc.binary_length(text).to_numpy() - size)[filled].astype(np.int32)
    rest = rest.take(pa.array(filled))
    n = len(filled)

    starts = np.frombuffer(rest.buffers()[1], np.int32)[rest.offset : rest.offset + n]
    goes_on = np.isin(np.frombuffer(rest.buffers()[2] or b"", np.uint8)[starts], list((")]}" + lang.CARRIED).encode()))
    below = np.empty(0, np.int64)
    if joined.null_count < len(joined):
        place = pc.list_parent_indices(joined).to_numpy().astype(np.int64) << 32 | joined.flatten().to_numpy()
        below = np.flatnonzero(np.isin(file.astype(np.int64) << 32 | line, place))

    functions, function_names = _named(rest, "def", _FUNCTION)
    classes, class_names = _named(rest, "class", _CLASS)
    at = np.full(n, -1)
    at[classes] = len(functions) + np.arange(len(classes))
    at[functions] = np.arange(len(functions))
    none = at < 0
    name = pa.concat_arrays([function_names, class_names]).take(pa.array(at, mask=none))
    kind = pa.array(["function", "class"]).take(pa.array((at >= len(functions)).astype(np.int8), mask=none))

    bracket = _mask(pc.match_substring(rest, "("))
    site, names = _called(rest, bracket, below)
    bracket[below] = True
    first = np.append(True, site[1:] != site[:-1])[: len(site)]
    kept = ~(first & _mask(pc.equal(names, name.take(pa.array(site)))))
    site, names = site[kept], names.filter(pa.array(kept))
    per_row = np.bincount(site, minlength=n)
    ends = np.append(0, np.cumsum(per_row)).astype(np.int32)
    calls = pa.ListArray.from_arrays(pa.array(ends), names, mask=pa.array(~bracket))
    leads, n_named = _leads(path, file, functions, function_names)
    named = np.zeros(n, np.int32)
    named[leads] = n_named
    rows = _finished(path.take(pa.array(file)), file, line, indent, goes_on, kind, name, calls, per_row, bracket, functions)
    return pa.record_batch([*rows, pa.array(named, mask=named == 0)], _NAMES)


def _leads(path: pa.Array, file: np.ndarray, functions: np.ndarray, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each name among these files' functions: the row of the first in (path, line) order, and how many there are."""
    rank = np.empty(len(path), np.int64)
    rank[pc.sort_indices(path, null_placement="at_start").to_numpy()] = np.arange(len(path))
    codes = pc.dictionary_encode(names).indices.to_numpy()
    order = np.lexsort((functions, rank[file[functions]], codes))
    first = np.append(True, np.diff(codes[order]) != 0)[: len(order)]
    return functions[order[first]], np.bincount(codes) if len(codes) else np.empty(0, np.int64)


def _finished(path, file, line, indent, goes_on, kind, name, calls, per_row, bracket, functions) -> list[pa.Array]:
    """Adds the last lines of the definitions and the functions around each line with calls, as ids without their path."""
    n = len(line)
    first = np.append(True, file[1:] != file[:-1])[:n]
    asked = np.flatnonzero(kind.is_valid().to_numpy(zero_copy_only=False))
    ends = _last_rows(first, indent, goes_on, asked) if n else asked
    end_line, known = np.zeros(n, np.int32), np.zeros(n, bool)
    end_line[asked], known[asked] = line[ends], True

    sites = np.flatnonzero(per_row)
    rows_of = np.sort(functions)
    last_of = ends[np.searchsorted(asked, rows_of)]
    begin, end = np.searchsorted(sites, rows_of), np.searchsorted(sites, last_of, "right")
    count = end - begin
    owner = np.repeat(np.arange(len(rows_of)), count)
    site = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    owner = owner[np.argsort(site, kind="stable")]
    owned = np.zeros(n, np.int64)
    owned[sites] = np.bincount(site, minlength=len(sites))
    taken = pa.array(rows_of)
    line_no = pa.array(line)
    ids = pc.binary_join_element_wise(pc.cast(line_no.take(taken), pa.string()), name.take(taken), ":")
    owners = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(owned)), pa.int32()), ids.take(pa.array(owner)))
    return [path, line_no, kind, name, calls, pa.array(bracket), pa.array(end_line, mask=~known), owners]


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, content, joined`` -> ``SCHEMA``: a file a row, without comments and literals, every break ``\\n``.

    ``joined`` holds the lines whose last name is called by the bracket that starts the next line. ``n_named``: of the
    functions of one name in the files worked on together, the first in (path, line) order knows their number.
    """
    for batch in batches:
        path, content, joined = batch.columns
        size = pc.fill_null(pc.binary_length(content), 0).to_numpy()
        part = np.cumsum(size) // SLICE_BYTES
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]).tolist() + [len(part)]
        for low, high in zip(edges[:-1], edges[1:]):
            some = [c.slice(low, high - low) for c in (path, content, joined)]
            yield _file_rows(some[0].cast(pa.string()), some[1].cast(pa.string()), some[2])

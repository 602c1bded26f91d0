"""Line rules per language: what starts a definition, what is a call, how blocks nest.

Comments and string literals are taken out of the whole text first (``bare_text``); the rules then
look at one line at a time. They are a stated approximation of the languages; recorded answers or
a caller's batch function give the same tables with other quality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LINE_BREAK, SINGLE_BREAKS

# File suffix -> block style.
STYLES = {"py": "indent", "c": "brace", "cpp": "brace", "go": "brace", "rs": "brace"}

# Words that look like a call or a definition name but are neither.
KEYWORDS = {
    "py": "and as assert async await class def del elif else except finally for from global if "
    "import in is lambda nonlocal not or pass raise return try while with yield",
    "c": "alignof case defined do else for goto if return sizeof switch typedef while",
    "cpp": "alignof case catch decltype delete do else for goto if new noexcept return sizeof "
    "static_assert switch throw typeid while",
    "go": "case chan defer else for func go if import interface map range return select struct "
    "switch type var",
    "rs": "as async await dyn else fn for if impl in let loop match move mut pub ref return "
    "self super unsafe use where while",
}
# Names in any script; the possessive end is the closing boundary.
_FIRST = r"[\p{L}\p{Nl}_]"
_PART = r"[\p{L}\p{N}\p{M}_]"
_NAME = rf"({_FIRST}{_PART}*+)"
_TYPE = r"[\p{L}\p{N}\p{M}_:<>,&*\s]*"
# Type parameters, nested up to three deep; ``->`` closes nothing.
_GENERIC = "<(?:->|[^<>]|<(?:->|[^<>]|<(?:->|[^<>])*+>)*+>)*+>"
_BODY = r"\s*\([^;{]*(?:\{.*)?$"

# A Python literal over several lines leaves this in front of its last line, which goes on with the statement.
CARRIED = "\x01"


def _no_word(suffix: str) -> str:
    """Look-ahead that refuses the keywords of a language."""
    return rf"(?!(?:{'|'.join(KEYWORDS[suffix].split())})(?!{_PART}))"


def _c_function(suffix: str) -> str:
    """Return type, name and bracket; a statement such as ``else if (x) {`` is refused."""
    stop = _no_word(suffix)
    return rf"^\s*{stop}(?:{_FIRST}{_TYPE}[\s*&])(?:{_FIRST}{_PART}*+::)*~?{stop}{_NAME}{_BODY}"


def _cpp_function() -> str:
    """As in C, and without a return type: qualified, or with a body on the same line.

    In the last form a name all in capitals is a macro, and square brackets belong to a lambda.
    """
    stop = _no_word("cpp")
    typed = rf"{_FIRST}{_TYPE}[\s*&](?:{_FIRST}{_PART}*+::)*~?(?={_FIRST}{_PART}*+{_BODY})"
    qualified = rf"(?:{_FIRST}{_PART}*+(?:{_GENERIC})?::)+~?(?={_FIRST}{_PART}*+\s*\([^;{{\[]*(?:\{{.*)?$)"
    member = rf"~?(?!\p{{Lu}}[\p{{Lu}}\p{{N}}_]+\s*\()(?={_FIRST}{_PART}*+\s*\([^;{{\[]*\)[^;{{\[]*\{{.*$)"
    return rf"^\s*(?:template\s*{_GENERIC}\s*)?{stop}(?:{typed}|{qualified}|{member}){stop}{_NAME}"


def _call(suffix: str) -> str:
    """Name and bracket; between them, in C++ and Rust, type arguments."""
    arguments = r"<(?![^()]*&&)[\p{L}\p{N}\p{M}_\s,:*&<>\[\];']*>"
    between = {"cpp": f"(?:{arguments})?", "rs": f"(?:::{arguments})?"}.get(suffix, "")
    return rf"(?<!{_PART}){_no_word(suffix)}{_NAME}{between}\s*\("


# Suffix -> pattern of a line that starts a function, name in group 1.
FUNCTION_RULES = {
    "py": r"^\s*(?:async\s+)?def\s+" + _NAME,
    "rs": r'^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|async|const|unsafe|extern(?:\s+"[^"]*")?)\s+)*fn\s+'
    + _NAME,
    "go": r"^\s*func\s+(?:\([^)]*\)\s*)?" + _NAME + r"\s*[(\[]",
    "c": _c_function("c"),
    "cpp": _cpp_function(),
}
# Suffix -> pattern of a line that starts a class-like definition.
CLASS_RULES = {
    "py": r"^\s*class\s+" + _NAME,
    "rs": rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:struct|enum|union|trait|impl(?:{_GENERIC})?(?:\s+[^{{;]+\s+for)?)\s+"
    + _NAME,
    "go": r"^\s*type\s+" + _NAME + r"(?:\[[^\]]*\])?\s+(?:struct|interface)\b",
    "c": r"^\s*(?:typedef\s+)?(?:struct|union|enum)\s+" + _NAME + r"\s*(?:\{.*)?$",
    "cpp": rf"^\s*(?:template\s*{_GENERIC}\s*)?(?:class|struct|union|enum)\s+" + _NAME + r"[^;()]*(?:\{.*)?$",
}
# Python: a line that ends with a name, and a text where the next line starts with a bracket.
LAST_NAME = rf"(?<!{_PART}){_no_word('py')}{_NAME}[ \t]*+\\?$"
CROSSING = rf"{_PART}[ \t]*+\\?(?:{LINE_BREAK})\s*+\("
# Suffix -> pattern of a call, name in group 1, keywords refused.
CALL_RULES = {suffix: _call(suffix) for suffix in KEYWORDS}
# C and C++: a line that is only a type, and a line that starts with the name the type belongs to.
TYPE_LINE = rf"^{_FIRST}{_TYPE}$"
NAME_LINE = rf"^(?:{_FIRST}{_PART}*+::)*~?{_FIRST}{_PART}*+\s*\("


def _quoted(mark: str, lines: bool = False) -> str:
    """A literal with backslash escapes; ``lines`` lets it run over line ends, or to the end of the text."""
    stop, end = ("", rf"(?:{mark}|\z)") if lines else (r"\n\r", mark)
    return rf"{mark}(?:[^{mark}\\{stop}]++|\\(?:\r\n|[\s\S]))*+{end}"


def _tripled(mark: str) -> str:
    return rf"{mark * 3}(?:[^{mark}\\]++|\\[\s\S]|{mark}(?!{mark * 2}))*+(?:{mark * 3}|\z)"


def _nested_comment(depth: int = 8) -> str:
    """Block comments inside block comments; one nested deeper ends at its first end mark."""
    plain = r"[^*/]++|\*(?!/)|/(?!\*)"
    body = plain
    for _ in range(depth):
        body = rf"{plain}|/\*(?:{body})*+\*/"
    return rf"/\*(?:{body})*+\*/"


_BLOCK = r"/\*[\s\S]*?(?:\*/|\z)"
_LINE = r"//[^\n\r]*+"
_LONG_LINE = r"//(?:[^\n\r\\]++|\\(?:\r\n|[\s\S]))*+"
_C_CHAR = r"(?:(?<=u8)|(?<![0-9a-fA-F]))" + _quoted("'")
_CHAR = r"'(?:[^'\\\n\r]|\\[^\n\r]{1,10}?)'"
_CPP_RAW = rf'(?:(?<=u8|[uUL])|(?<!{_PART}))R"([^()\\\s]{{0,16}})\([\s\S]*?(?:\)\1"|\z)'
_RS_RAW = rf'(?:(?<=[bc])|(?<!{_PART}))r(#*)"[\s\S]*?(?:"\1|\z)'
_PY_LITERALS = "|".join([_tripled("'"), _tripled('"'), _quoted("'"), _quoted('"')])
# Lines inside a literal stand deeper than any block, so that the line behind it still ends its blocks.
_DEEP = " " * 1024
# A Python literal with replacement fields, and one field of it: format specs may hold fields too.
_FORMATTED = "(?:[fF][rR]?|[rR][fF])"
_FIELD = r"\{((?:[^{}]|\{[^{}]*+\})*+)\}"
_PY_RUN = f"(?:[^'\"#fFrR]++|[fFrR](?!['\"]|[fFrR]['\"]))++"
# Suffix -> pattern of the next comment, literal or plain run; the matches make up the whole text.
LEXEMES = {
    "py": "|".join([f"(?<!{_PART}){_FORMATTED}(?:{_PY_LITERALS})", _PY_LITERALS, r"#[^\n\r]*+", _PY_RUN, r"[\s\S]"]),
    "c": "|".join([_BLOCK, _LONG_LINE, _quoted('"'), _C_CHAR, "[^/\"']++", r"[\s\S]"]),
    "cpp": "|".join([_BLOCK, _LONG_LINE, _CPP_RAW, _quoted('"'), _C_CHAR, "(?:[^/\"'R]++|R(?!\"))++", r"[\s\S]"]),
    "go": "|".join([_BLOCK, _LINE, r"`[^`]*+(?:`|\z)", _quoted('"'), _CHAR, "[^/\"'`]++", r"[\s\S]"]),
    "rs": "|".join(
        [_nested_comment(), _BLOCK, _LINE, _RS_RAW, _quoted('"', True), _CHAR, "(?:[^/\"'r]++|r(?!#*\"))++", r"[\s\S]"]
    ),
}


def by_suffix(suffix: Column, table: dict, build) -> Column:
    """CASE over the suffixes of ``table``; NULL for any other file."""
    out = None
    for key, value in table.items():
        test = suffix == key
        out = F.when(test, build(value)) if out is None else out.when(test, build(value))
    return out


def is_source(path: Column, style: str | None = None) -> Column:
    suffixes = [s for s in STYLES if style in (None, STYLES[s])]
    return path.rlike(r"\.(?:" + "|".join(suffixes) + r")$")


def block_style(suffix: Column) -> Column:
    return by_suffix(suffix, STYLES, F.lit)


def _fields_of(piece: Column) -> Column:
    """``""`` and the replacement fields of a formatted literal, each on its line; inner literals taken out.

    Fields over several lines are not seen.
    """
    lines = F.split(F.regexp_replace(piece, r"\{\{", ""), LINE_BREAK, -1)
    breaks = F.regexp_extract_all(piece, F.lit(LINE_BREAK), F.lit(0))

    def shown(line: Column, i: Column) -> Column:
        fields = F.array_join(F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1)), " ")
        bare = F.regexp_replace(fields, "'[^']*+'|\"[^\"]*+\"", '""')
        inside = F.when(bare != "", _DEEP + CARRIED)
        carried = F.when(i == 0, "").when(i == F.size(lines) - 1, CARRIED).otherwise(F.coalesce(inside, F.lit("")))
        return F.concat(F.coalesce(F.get(breaks, i - 1), F.lit("")), carried, F.when(bare != "", F.concat(F.lit(" "), bare)).otherwise(""))

    return F.concat(F.lit('""'), F.array_join(F.transform(lines, shown), ""))


def bare_text(text: Column, suffix: Column) -> Column:
    """The text with a blank for each comment and ``""`` for each literal; all line breaks stay.

    Of Python's formatted literals the replacement fields stay too.
    The text is cut into comments, literals and plain runs from its start on, so a mark inside
    another literal or comment starts nothing. Texts without any such mark are passed on as they are.
    """
    pieces = F.regexp_extract_all(text, by_suffix(suffix, LEXEMES, F.lit), F.lit(0))

    def shown(piece: Column) -> Column:
        comment = F.when(suffix == "py", F.startswith(piece, F.lit("#"))).otherwise(
            F.startswith(piece, F.lit("//")) | F.startswith(piece, F.lit("/*"))
        )
        literal = (F.length(piece) > 1) & piece.rlike(r"""^(?:["'`]|R"|r#*")""")
        breaks = F.regexp_replace(piece, f"[^{SINGLE_BREAKS}]+", "")
        carried = F.when((suffix == "py") & (breaks != ""), CARRIED).otherwise("")
        formatted = (suffix == "py") & piece.rlike(f"^{_FORMATTED}['\"]")
        return (
            F.when(comment, F.concat(F.lit(" "), breaks))
            .when(formatted, _fields_of(piece))
            .when(literal, F.concat(F.lit('""'), breaks, carried))
            .otherwise(piece)
        )

    marked = reduce(Column.__or__, [F.contains(text, F.lit(mark)) for mark in ('"', "'", "`", "#", "//", "/*")])
    return F.when(marked, F.array_join(F.transform(pieces, shown), "")).otherwise(text)


def rule_for(suffix: Column, rules: dict) -> Column:
    """The pattern of a row's language.

    One expression with a pattern column instead of one per language: the pattern is compiled
    once per run of equal values, and the generated code stays small enough for the JIT.
    """
    return by_suffix(suffix, rules, F.lit)


def match_name(text: Column, rule: Column) -> Column:
    """Group 1 of the pattern, '' when it does not match."""
    return F.call_function("regexp_extract", text, rule, F.lit(1))


def call_names(bare: Column, rule: Column) -> Column:
    """Names followed by ``(``, in order, without the keywords of the language."""
    return F.when(F.instr(bare, "(") > 0, F.regexp_extract_all(bare, rule, 1))


def calls_below(body: Column) -> Column:
    """Indices of the lines whose last name is called by the bracket that starts the next line.

    ``body`` is the array of a Python text's non-blank lines; the bracket goes on with the statement
    inside other brackets or behind a backslash.
    """

    def step(at: Column, i: Column) -> Column:
        line, above = F.get(body, i)["rest"], F.get(body, i - 1)["rest"]
        goes_on = (at["depth"] > 0) | F.endswith(above, F.lit("\\"))
        hit = F.startswith(line, F.lit("(")) & goes_on & above.rlike(LAST_NAME)
        opened = F.length(F.translate(line, ")]}", "")) - F.length(F.translate(line, "([{", ""))
        return F.struct(
            F.greatest(at["depth"] + opened, F.lit(0)).alias("depth"),
            F.when(hit, F.concat(at["lines"], F.array(i - 1))).otherwise(at["lines"]).alias("lines"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("lines"))
    return F.aggregate(F.sequence(F.lit(0), F.size(body) - 1), start, step, lambda at: at["lines"])


def braces_of(bare: Column) -> Column:
    """Only the braces of the line."""
    return F.when(bare.rlike("[{}]"), F.regexp_replace(bare, r"[^{}]+", "")).otherwise(F.lit(""))


def depth_change(braces: Column) -> Column:
    """Change of depth over the line."""
    opens = F.octet_length(F.replace(braces, F.lit("}"), F.lit("")))
    return opens * 2 - F.octet_length(braces)


def depth_dip(braces: Column) -> Column:
    """Lowest depth reached in the line, relative to its start; never above 0.

    Pairs are taken out from the inside; the ``}`` left in front are the blocks closed. Where four
    steps leave pairs, the rest is folded sign by sign.
    """
    rest = braces
    for _ in range(4):
        rest = F.replace(rest, F.lit("{}"), F.lit(""))
    closed = F.octet_length(rest) - F.octet_length(F.ltrim(rest, F.lit("}")))

    def step(at: Column, sign: Column) -> Column:
        depth = at["depth"] + F.when(sign == "{", 1).when(sign == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.least(at["low"], depth).alias("low"))

    folded = F.aggregate(F.split(rest, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")), step)
    return F.when(F.contains(rest, F.lit("{}")), folded["low"]).otherwise(-closed)


def first_mark(bare: Column) -> Column:
    """``{`` or ``;``, whichever comes first outside brackets; NULL when the line has neither.

    One level of brackets is taken out by pattern; where brackets are left, signs are folded by depth.
    """
    flat = F.regexp_replace(F.regexp_replace(bare, r"\[[^\[\]]*\]", ""), r"\([^()]*\)", "")
    none = F.lit(None).cast("string")

    def step(at: Column, sign: Column) -> Column:
        depth = at["depth"] + F.when(sign.isin("(", "["), 1).when(sign.isin(")", "]"), -1).otherwise(0)
        seen = F.when((at["depth"] == 0) & sign.isin("{", ";"), sign)
        return F.struct(F.greatest(depth, F.lit(0)).alias("depth"), F.coalesce(at["mark"], seen).alias("mark"))

    signs = F.split(F.regexp_replace(flat, r"[^\[\](){;]+", ""), "")
    folded = F.aggregate(signs, F.struct(F.lit(0).alias("depth"), none.alias("mark")), step)["mark"]
    plain = F.nullif(F.regexp_extract(flat, "[{;]", 0), F.lit(""))
    return F.when(bare.rlike("[{;]"), F.when(flat.rlike(r"[\[\]()]"), folded).otherwise(plain))

"""Text expressions on source code: identifiers, branches, noise, tags and token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"[\p{L}_$][\p{L}\p{N}_$]*"
#: Whole-word branch keywords and operators, over raw text.
BRANCH = r"(?<![A-Za-z0-9_])(?:if|else|elif|for|while|match|case|switch|catch|except|when)(?![A-Za-z0-9_])|&&|\|\||\?\?|\?(?=[^?])"
SCRIPT = ("ts", "tsx", "js", "jsx")


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def branches(text: Column) -> Column:
    """Branch count plus one."""
    return (F.regexp_count(text, F.lit(BRANCH)) + 1).cast("int")


#: What is no code, each as one alternative; possessive so that long literals keep the matcher off the stack.
_BLOCK, _LINE, _HASH = r"/\*(?:[^*]|\*+[^*/])*+\*+/", r"//[^\n]*+", r"#[^\n]*+"
_TEXT, _QUOTED, _CHAR, _TEMPLATE = r'"(?:[^"\\\n]|\\[^\n])*+"', r"'(?:[^'\\\n]|\\[^\n])*+'", r"'(?:\\[^\n]|[^'\\\n])'", r"`(?:[^`\\]|\\[\s\S])*+`"
#: What ends a value, a tag or a comment: a slash after it divides, or is no pattern's beginning.
_ENDED = r"[\w$)\]}\"'`<>*/+\-.]"
#: A pattern between slashes: where nothing has ended, or after the word that hands a value back.
_PATTERN = rf"(?:(?<!{_ENDED}\s{{0,40}})|(?<=\breturn\s{{1,40}}))/(?![\s*/])(?:\\[^\n]|\[[^\]\n]*+\]|[^/\\\n\[])++/[a-z]*"
#: Two slashes that begin no comment: they are kept.
_KEPT = r"([:A-Za-z0-9_]//)"


def noise(lang: str) -> str:
    """One pattern for comments and literals of a language (``rust``, ``script``, ``py`` or any other); group 1 is kept."""
    quoted = _CHAR if lang == "rust" else _QUOTED
    parts = {"py": [_HASH], "script": [_PATTERN, _BLOCK]}.get(lang, [_BLOCK])
    return "|".join([_KEPT, *parts, _LINE, _TEXT, quoted, _TEMPLATE])


def strip_noise(text: Column, lang: Column) -> Column:
    """text with a blank for each comment and literal, found from left to right in one scan."""
    blank = lambda of: F.regexp_replace(text, noise(of), "$1 ")
    return F.when(lang == "py", blank("py")).when(lang == "rust", blank("rust")).when(lang.isin(*SCRIPT), blank("script")).otherwise(blank("other"))


def escaped(text: Column) -> Column:
    """text for an attribute of a tag."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def token_estimate(text: Column) -> Column:
    """A quarter for each narrow character, one for each wide one, rounded up."""
    wide = F.char_length(F.regexp_replace(text, r"[\x{0}-\x{2e7f}]", ""))
    return F.ceil((F.char_length(text) - wide) / 4 + wide).cast("long")

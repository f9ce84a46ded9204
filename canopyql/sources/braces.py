"""Declarations of languages with braces (Rust and the ECMAScript family), read from their tokens.

A text is cut into tokens without comments; brackets are paired; statements that declare something are found
by their leading words wherever a statement may begin, and what lies in their braces is read in turn. Each
symbol then gets the names used in its span: bound names (parameters, local variables) are left out, names in
type position go to ``trefs``, calls through a path (``A::run(``) to ``qrefs``.
"""

from __future__ import annotations

import re

_STRING = r'"(?:\\.|[^"\\])*"'
_SCAN = {
    "rust": re.compile(
        rf"(?P<skip>\s+|//[^\n]*)|(?P<open>/\*)|(?P<text>b?r(?P<h>#*)\".*?\"(?P=h)|b?{_STRING}|b?'(?:\\(?:x[0-9a-fA-F]{{2}}|u\{{[^}}]*\}}|.)|[^'\\\n])')"
        r"|(?P<life>'[A-Za-z_]\w*)|(?P<name>(?:r#)?[^\W\d]\w*)|(?P<number>\d\w*(?:\.\d\w*)?)|(?P<sign>::|->|=>|&&|\|\||\.\.=?|\S)",
        re.S,
    ),
    "script": re.compile(
        rf"(?P<skip>\s+|//[^\n]*)|(?P<open>/\*)|(?P<text>{_STRING}|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"
        r"|(?P<name>[#]?(?:[^\W\d]|\$)[\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|&&|\|\||\?\?|\?\.|\.\.\.|===?|!==?|\S)",
        re.S,
    ),
}
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_BEFORE_PATTERN = frozenset("( , = : [ ! & | ? { } ; => && || ?? return typeof case in of".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
#: Roots of paths that name no module of a tree.
ROOTS = frozenset({"self", "crate", "super", "std", "core", "alloc"})
_RUST_WORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while".split())
_SCRIPT_WORDS = frozenset(
    "abstract as async await break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in instanceof interface "
    "is keyof let namespace new null of private protected public readonly return satisfies set static super switch this throw true try type typeof undefined var void while with yield".split()
)
_PRIMITIVE = frozenset("string number boolean any unknown never object bigint symbol u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 bool char str".split())


class Symbol:
    __slots__ = ("chain", "exp", "first", "kind", "last", "local", "name", "tr")

    def __init__(self, name: str, kind: str, first: int, last: int, chain: tuple[str, ...], exp: bool, local: bool = False, tr: str | None = None):
        self.name, self.kind, self.first, self.last, self.chain, self.exp, self.local, self.tr = name, kind, first, last, chain, exp, local, tr


class Reader:
    """The tokens of one text and what has been read from them."""

    def __init__(self, text: str, rust: bool):
        self.text, self.rust = text, rust
        self.words = _RUST_WORDS if rust else _SCRIPT_WORDS
        self.t: list[str] = []  # token texts, kinds, lines and places
        self.kind: list[str] = []
        self.line: list[int] = []
        self.at: list[int] = []
        self._scan()
        self.n = len(self.t)
        self.pair = self._pairs()
        # some empty tokens, so that a look ahead ends there
        for column, x in ((self.t, ""), (self.kind, "end"), (self.line, self.lines), (self.at, len(text)), (self.pair, self.n)):
            column.extend([x] * 8)
        self.bound, self.typed = bytearray(self.n + 8), bytearray(self.n + 8)
        self.symbols: list[Symbol] = []
        self.imports: list[tuple[str, str]] = []  # (name, local)
        self.handed: list[tuple[str, str]] = []

    def _scan(self) -> None:
        scan, text, at, line = _SCAN["rust" if self.rust else "script"], self.text, 0, 1
        while at < len(text):
            m = scan.match(text, at)
            kind, end = m.lastgroup if m.lastgroup != "h" else "text", m.end()
            if kind == "open":  # block comments; Rust's nest
                depth, end = 1, at + 2
                while depth:
                    close = text.find("*/", end)
                    inner = text.find("/*", end, close + 1 if close >= 0 else len(text)) if self.rust else -1
                    if close < 0 and inner < 0:
                        end = len(text)
                        break
                    depth, end = (depth + 1, inner + 2) if inner >= 0 else (depth - 1, close + 2)
            elif kind != "skip":
                if not self.rust and m[0] == "/" and (not self.t or self.t[-1] in _BEFORE_PATTERN) and (p := _PATTERN.match(text, at)):
                    kind, end = "text", p.end()
                self.t.append(text[at:end] if kind != "text" else '""')
                self.kind.append(kind)
                self.line.append(line)
                self.at.append(at)
            line += text.count("\n", at, end)
            at = end
        self.lines = line

    def _pairs(self) -> list[int]:
        """For each opening bracket the place of its closing one, or of the end."""
        pair, stack = [0] * len(self.t), []
        for i, (x, kind) in enumerate(zip(self.t, self.kind, strict=True)):
            if kind == "sign" and x in _OPEN:
                stack.append(i)
            elif kind == "sign" and x in _CLOSE:
                # a bracket that doesn't fit closes what was left open inside
                while stack and _OPEN[self.t[stack[-1]]] != x and any(_OPEN[self.t[j]] == x for j in stack):
                    pair[stack.pop()] = i
                if stack and _OPEN[self.t[stack[-1]]] == x:
                    pair[stack.pop()] = i
        for i in stack:
            pair[i] = len(self.t) - 1
        return pair

    def is_name(self, i: int) -> bool:
        return i < len(self.t) and self.kind[i] == "name" and self.t[i] not in self.words

    def word(self, i: int) -> str:
        return self.t[i] if i < len(self.t) else ""

    def until(self, i: int, end: int, *stops: str) -> int:
        """The first place from i on, outside brackets, of one of the stops."""
        while i < end and self.t[i] not in stops:
            i = self.pair[i] + 1 if self.kind[i] == "sign" and self.t[i] in _OPEN else i + 1
        return min(i, end)

    def angles(self, i: int, end: int) -> int:
        """Past a list in angle brackets that may begin at i."""
        if self.word(i) != "<":
            return i
        depth = 0
        while i < end:
            x = self.t[i]
            depth += (x == "<") - (x == ">")
            i = self.pair[i] + 1 if self.kind[i] == "sign" and x in _OPEN else i + 1
            if depth == 0:
                return i
        return end

    def types(self, i: int, end: int) -> None:
        for k in range(i, end):
            if self.kind[k] == "name":
                self.typed[k] = 1

    def type_from(self, i: int, end: int, *stops: str) -> int:
        """Marks a type that begins at i; returns where it ends, at a stop outside all brackets."""
        depth, k = 0, i
        while k < end:
            x = self.t[k]
            if depth == 0 and (x in stops or x in _CLOSE):
                break
            depth += (x == "<") - (x == ">")
            if self.kind[k] == "sign" and x in _OPEN and not (x == "{" and "{" in stops):
                self.types(k, self.pair[k])
                k = self.pair[k]
            elif self.kind[k] == "name":
                self.typed[k] = 1
            k += 1
        return k

    def bind(self, i: int, end: int) -> None:
        """Names of a pattern; what stands before a colon in braces is a field, what is written large a type."""
        for k in range(i, end):
            if self.is_name(k) and not self.typed[k] and not (self.rust and self.t[k][:1].isupper()):
                self.bound[k] = 1

    def add(self, *values, **more) -> None:
        if len(values[0]) >= 2 or more.get("local"):
            self.symbols.append(Symbol(*values, **more))

    def starts(self, i: int) -> bool:
        """Whether a statement may begin at i."""
        if i == 0:
            return True
        x = self.t[i - 1]
        return x in ("{", "}", ";", "]", ")") or (not self.rust and self.line[i - 1] < self.line[i] and x not in ("=", ",", "(", ".", "=>", ":", "&&", "||", "?"))

    # --- Rust -----------------------------------------------------------------------------------------

    def rust_items(self, i: int, end: int, chain: tuple[str, ...], inside: bool) -> None:
        while i < end:
            x = self.t[i]
            if x == "#" and self.word(i + 1) in ("[", "!"):
                b = i + 1 + (self.word(i + 1) == "!")
                i = self.pair[b] + 1 if self.word(b) == "[" else b
                continue
            if self.kind[i] == "name" and self.starts(i):
                first, exp, k = i, False, i
                if x == "pub":
                    exp, k = True, i + 1
                    k = self.pair[k] + 1 if self.word(k) == "(" else k
                while self.word(k) in ("default", "async", "unsafe", "extern", "const") and (self.word(k) != "const" or self.word(k + 1) in ("fn", "async", "unsafe", "extern")):
                    k += 1 + (self.word(k + 1) == '""')
                after = self.rust_item(first, k, end, chain, exp, inside)
                if after:
                    i = after
                    continue
            if x == "let":
                k = i + 1
                stop = self.until(k, end, "=", ";", ":", "else")
                self.bind(k, stop)
                i = self.type_from(stop + 1, end, "=", ";") if self.word(stop) == ":" else stop
            elif x == "for" and not self.starts(i + 1):
                stop = self.until(i + 1, end, "in", "{")
                if self.word(stop) == "in":
                    self.bind(i + 1, stop)
                i = stop
            elif x in ("|", "||") and self.word(i - 1) in ("(", ",", "=", "{", "move", ";", "=>", "return"):
                if x == "|":
                    stop = self.until(i + 1, end, "|")
                    self.rust_params(i, stop)
                    i = stop
                i += 1
            elif x == "as":
                i = self.type_from(i + 1, end, ",", ";", ")", "}", "{", "=", "+", "-", "*", "/", "&&", "||", "?", ".", "..", "==", "<")
            elif x == "{" and self.is_name(i - 1) and self.t[i - 1][:1].isupper() and self.word(i - 2) not in ("match", "if", "while", "in"):
                self.typed[i - 1] = 1  # a value of a struct
                i += 1
            else:
                i += 1

    def rust_item(self, first: int, k: int, end: int, chain: tuple[str, ...], exp: bool, inside: bool) -> int:
        """Reads the item whose declaring word is at k; returns the place after what was read, 0 if there is none."""
        word, name = self.word(k), self.word(k + 1)
        if word == "use":
            stop = self.until(k, end, ";")
            self.rust_use(k + 1, stop, exp)
            return stop + 1
        if word == "macro_rules" and name == "!" and self.is_name(k + 2):
            stop = self.pair[k + 3] if self.word(k + 3) in _OPEN else k + 3
            self.add(self.t[k + 2], "macro", first, stop, chain, exp)
            return stop + 1
        if word == "impl":
            return self.rust_impl(first, k, end, chain)
        if word in ("const", "static"):
            n = k + 1 + (name == "mut")
            if not self.is_name(n):
                return 0
            stop = self.until(n, end, ";")
            self.add(self.t[n], "const", first, stop, chain, exp)
            if self.word(n + 1) == ":":
                self.type_from(n + 2, stop, "=", ";")
            return n + 1
        if word not in ("fn", "struct", "union", "enum", "trait", "mod", "type") or not self.is_name(k + 1):
            return 0
        after = self.angles(k + 2, end)
        self.types(k + 2, after)
        if word == "fn":
            if self.word(after) != "(":
                return 0
            close = self.pair[after]
            self.rust_params(after, close)
            stop = self.until(close + 1, end, "{", ";")
            self.types(close + 1, stop)
            last = self.pair[stop] if self.word(stop) == "{" else stop
            self.add(name, "fn", first, last, chain, exp)
            if self.word(stop) == "{":
                self.rust_items(stop + 1, last, (*chain, name), True)
            return last + 1
        stop = self.until(after, end, "{", ";") if word != "type" else self.until(after, end, ";")
        if word in ("struct", "union", "type"):
            self.types(after, stop)
        last = self.pair[stop] if self.word(stop) == "{" else stop
        kind = {"union": "struct"}.get(word, word)
        self.add(name, kind, first, last, chain, exp)
        if self.word(stop) == "{":
            if word in ("struct", "union"):
                self.rust_fields(stop + 1, last, (*chain, name))
            elif word == "enum":
                self.rust_variants(stop + 1, last, (*chain, name))
            else:
                self.types(after, stop)
                self.rust_items(stop + 1, last, (*chain, name), inside)
        return last + 1

    def rust_params(self, open_: int, close: int) -> None:
        i = open_ + 1
        while i < close:
            stop = self.until(i, close, ":", ",")
            self.bind(i, stop)
            i = self.type_from(stop + 1, close, ",") + 1 if self.word(stop) == ":" else stop + 1

    def rust_fields(self, i: int, end: int, chain: tuple[str, ...]) -> None:
        while i < end:
            if self.t[i] == "#":
                i = self.pair[i + 1] + 1
                continue
            first, exp = i, self.t[i] == "pub"
            i += exp
            i = self.pair[i] + 1 if exp and self.word(i) == "(" else i
            if self.is_name(i) and self.word(i + 1) == ":":
                stop = self.type_from(i + 2, end, ",")
                self.add(self.t[i], "field", first, max(first, stop - 1), chain, exp)
                i = stop
            i += 1

    def rust_variants(self, i: int, end: int, chain: tuple[str, ...]) -> None:
        while i < end:
            if self.t[i] == "#":
                i = self.pair[i + 1] + 1
                continue
            stop = self.until(i, end, ",")
            if self.is_name(i):
                self.add(self.t[i], "variant", i, max(i, stop - 1), chain, False)
                self.types(i + 1, stop)
            i = stop + 1

    def rust_impl(self, first: int, k: int, end: int, chain: tuple[str, ...]) -> int:
        begin = self.angles(k + 1, end)
        brace = self.until(begin, end, "{", ";")
        if self.word(brace) != "{":
            return 0
        self.types(k + 1, brace)
        head = brace
        for j in range(begin, brace):
            if self.t[j] == "where":
                head = j
                break
        split, depth = None, 0
        for j in range(begin, head):
            depth += (self.t[j] == "<") - (self.t[j] == ">")
            if self.t[j] == "for" and depth == 0:
                split = j

        def last_name(a: int, b: int) -> str | None:
            found, j = None, a
            while j < b and self.t[j] not in ("<", "("):
                if self.is_name(j):
                    found = self.t[j]
                j += 1
            return found

        name = last_name(split + 1 if split is not None else begin, head)
        close = self.pair[brace]
        if name:
            self.add(name, "impl", first, close, chain, False, tr=last_name(begin, split) if split is not None else None)
        self.rust_items(brace + 1, close, (*chain, name) if name else chain, False)
        return close + 1

    def rust_use(self, i: int, end: int, handed: bool) -> None:
        last = None
        while i < end:
            x = self.t[i]
            if x == "{":
                at = i + 1
                while at < self.pair[i]:
                    stop = self.until(at, self.pair[i], ",")
                    self.rust_use(at, stop, handed)
                    at = stop + 1
                return
            if x == "as":
                if last:
                    self._import(last, self.word(i + 1), handed)
                return
            if self.kind[i] == "name":
                last = x if x not in ROOTS else None
            elif x == "*":
                return
            i += 1
        if last:
            self._import(last, last, handed)

    def _import(self, name: str, local: str, handed: bool) -> None:
        if name not in ROOTS:
            self.imports.append((name, local))
            if handed:
                self.handed.append((name, local))

    # --- the ECMAScript family ------------------------------------------------------------------------

    def script_items(self, i: int, end: int, chain: tuple[str, ...], inside: bool) -> None:
        while i < end:
            x = self.t[i]
            if self.kind[i] == "name" and self.starts(i):
                first, exp, k = i, False, i
                while self.word(k) in ("export", "default", "declare", "abstract", "async"):
                    if self.word(k) in ("abstract", "async") and self.word(k + 1) not in ("class", "function"):
                        break
                    exp |= self.word(k) == "export"
                    k += 1
                after = self.script_item(first, k, end, chain, exp, inside)
                if after:
                    i = after
                    continue
            if x == "function" and not self.starts(i):  # an expression
                k = i + 1 + (self.word(i + 1) == "*")
                if self.is_name(k):
                    self.bound[k] = 1
                    k += 1
                k = self.angles(k, end)
                if self.word(k) == "(":
                    self.script_params(k, self.pair[k])
                    i = self.pair[k]
            elif x == "=>" and self.is_name(i - 1) and not self.typed[i - 1]:
                self.bound[i - 1] = 1
            elif x == "(":
                self._arrow(i, end)
            elif x == "catch" and self.word(i + 1) == "(":
                self.bind(i + 2, self.pair[i + 1])
            elif x in ("as", "satisfies"):
                i = self.type_from(i + 1, end, ",", ";", ")", "}", "=", "?", "&&", "||", ".") - 1
            elif x == "for" and self.word(i + 1) == "(" and self.word(i + 2) in ("const", "let", "var"):
                stop = self.until(i + 3, self.pair[i + 1], "of", "in", "=", ";")
                self.bind(i + 3, stop)
                i = stop
            i += 1

    def _arrow(self, open_: int, end: int) -> None:
        """Parameters, and the type of the result, if an arrow follows the bracket."""
        after = self.pair[open_] + 1
        if self.word(after) == ":":
            stop = self.until(after + 1, end, "=>", ";", ",", "{", "}", "=", "?")
            if self.word(stop) != "=>":
                return
            self.types(after, stop)
            after = stop
        if self.word(after) == "=>":
            self.script_params(open_, self.pair[open_])

    def script_item(self, first: int, k: int, end: int, chain: tuple[str, ...], exp: bool, inside: bool) -> int:
        word = self.word(k)
        if word == "import" and self.word(k + 1) != "(":
            return self.script_import(k + 1, end)
        if exp and word == "{":
            return self.script_handed(k, end)
        if exp and word == "type" and self.word(k + 1) == "{":
            return self.script_handed(k + 1, end)
        if word == "function":
            n = k + 1 + (self.word(k + 1) == "*")
            if not self.is_name(n):
                return 0
            return self._function(self.t[n], "fn", first, n + 1, end, chain, exp)
        if word in ("class", "interface"):
            if not self.is_name(k + 1):
                return 0
            name, brace = self.t[k + 1], self.until(k + 2, end, "{")
            after = self.angles(k + 2, end)
            self.types(k + 2, after)
            for j in range(after, brace):
                if self.t[j] == "implements" or (self.t[j] == "extends" and word == "interface"):
                    self.types(j, brace)
            if self.word(brace) != "{":
                return 0
            self.add(name, "class" if word == "class" else "iface", first, self.pair[brace], chain, exp)
            members = self.class_members if word == "class" else self.interface_members
            members(brace + 1, self.pair[brace], (*chain, name))
            return self.pair[brace] + 1
        if word == "type" and self.is_name(k + 1) and self.word(k + 2) in ("=", "<"):
            after = self.angles(k + 2, end)
            self.types(k + 2, after)
            stop = self._value_end(after + 1, end)
            self.types(after, stop)
            self.add(self.t[k + 1], "type", first, max(first, stop - 1), chain, exp)
            return stop
        if word == "enum" or (word == "const" and self.word(k + 1) == "enum"):
            n = k + 1 + (word == "const")
            if not self.is_name(n) or self.word(n + 1) != "{":
                return 0
            self.add(self.t[n], "type", first, self.pair[n + 1], chain, exp)
            return self.pair[n + 1] + 1
        if word in ("namespace", "module") and self.is_name(k + 1):
            brace = self.until(k + 1, end, "{", ";")
            if self.word(brace) != "{":
                return 0
            self.script_items(brace + 1, self.pair[brace], (*chain, self.t[k + 1]), inside)
            return self.pair[brace] + 1
        if word in ("const", "let", "var"):
            return self._variables(first, k + 1, end, chain, exp, inside)
        return 0

    def _function(self, name: str, kind: str, first: int, i: int, end: int, chain: tuple[str, ...], exp: bool) -> int:
        after = self.angles(i, end)
        self.types(i, after)
        if self.word(after) != "(":
            return 0
        close = self.pair[after]
        self.script_params(after, close)
        stop = close + 1
        if self.word(stop) == ":":
            stop = self.type_from(stop + 1, end, "{", ";") if self.word(stop + 1) != "{" else self.pair[stop + 1] + 1
        last = self.pair[stop] if self.word(stop) == "{" else min(stop, end) - (self.word(stop) != ";")
        self.add(name, kind, first, max(first, last), chain, exp)
        if self.word(stop) == "{":
            self.script_items(stop + 1, last, (*chain, name), True)
        return max(last, first) + 1

    def script_params(self, open_: int, close: int) -> None:
        i = open_ + 1
        while i < close:
            stop = self.until(i, close, ":", ",", "=", "?")
            stop += self.word(stop) == "?" and self.word(stop + 1) in (":", ",")
            self.bind(i, stop)
            if self.word(stop) == ":" and stop < close:
                stop = self.type_from(stop + 1, close, ",", "=")
            i = self.until(stop, close, ",") + 1

    def _value_end(self, i: int, end: int) -> int:
        """Past the value that begins at i: at a semicolon, or at a line end after which nothing carries it on."""
        begun = False
        while i < end:
            x = self.t[i]
            if x == ";" or x in _CLOSE:
                return i
            carried = x in (".", "?.", "?", ":", "+", "-", "*", "/", "=", "&&", "||", "??", ",", "|", "&", "=>", "===", "==", "!==", "!=", "<", ">", "as", "instanceof", "in")
            if begun and self.line[i - 1] < self.line[i] and not carried and self.t[i - 1] not in ("=", "=>", ",", ".", "?", ":", "+", "-", "*", "/", "&&", "||", "??", "|", "&", "(", "return"):
                return i
            begun = True
            i = self.pair[i] + 1 if self.kind[i] == "sign" and x in _OPEN else i + 1
        return end

    def _variables(self, first: int, n: int, end: int, chain: tuple[str, ...], exp: bool, inside: bool) -> int:
        if not self.is_name(n):  # a pattern binds names, but is no symbol
            if self.word(n) in ("{", "["):
                self.bind(n, self.pair[n])
                return self.pair[n] + 1
            return 0
        name, k = self.t[n], n + 1
        if inside:
            self.bound[n] = 1
        if self.word(k) == ":":
            k = self.type_from(k + 1, end, "=", ";")
        stop = self._value_end(k + 1, end) if self.word(k) == "=" else k
        self.add(name, "var", first, max(n, min(stop, end) - 1), chain, exp, local=inside)
        self.script_items(k + 1, stop, (*chain, name), True)
        return max(stop, k, n + 1)

    def class_members(self, i: int, end: int, chain: tuple[str, ...]) -> None:
        while i < end:
            if self.t[i] == "@":
                i = self.until(i, end, "(") if self.word(i + 2) == "(" else i + 2
                i = self.pair[i] + 1 if self.word(i) == "(" else i
                continue
            first, k = i, i
            while self.word(k) in ("public", "private", "protected", "static", "readonly", "abstract", "override", "async", "get", "set", "declare", "*", "#") and self.word(k + 1) not in ("(", "=", ":", ";"):
                k += 1
            named = self.kind[k] == "name" if k < end else False
            after = self.angles(k + 1, end) if named else k + 1
            if named and self.word(after) == "(":
                self.types(k + 1, after)
                i = self._function(self.t[k], "method", first, k + 1, end, chain, False) or k + 1
            elif named and self.word(k + 1) in (":", "=", ";", "?", "!", "}") or named and k + 1 < end and self.line[k + 1] > self.line[k]:
                j = k + 1 + (self.word(k + 1) in ("?", "!"))
                if self.word(j) == ":":
                    j = self.type_from(j + 1, end, "=", ";")
                    # without semicolons a type ends with its line
                stop = self._value_end(j + 1, end) if self.word(j) == "=" else j
                self.add(self.t[k], "field", first, max(k, min(stop, end) - 1), chain, False)
                self.script_items(j + 1, stop, (*chain, self.t[k]), True)
                i = max(stop, k + 1)
            elif self.t[i] in _OPEN and self.kind[i] == "sign":
                self.script_items(i + 1, self.pair[i], chain, True)
                i = self.pair[i] + 1
            else:
                i += 1

    def interface_members(self, i: int, end: int, chain: tuple[str, ...]) -> None:
        while i < end:
            k = i + (self.word(i) == "readonly" and self.kind[min(i + 1, end)] == "name")
            if self.kind[k] == "name" and self.word(k + 1) in (":", "?", "(", "<"):
                stop = k + 1
                while stop < end and self.t[stop] not in (";", ",") and not (self.line[stop] > self.line[stop - 1] and self.t[stop - 1] not in ("|", "&", ":", "=>") and self.t[stop] not in ("|", "&")):
                    stop = self.pair[stop] + 1 if self.kind[stop] == "sign" and self.t[stop] in _OPEN else stop + 1
                self.types(k + 1, min(stop, end))
                self.add(self.t[k], "prop", i, max(k, min(stop, end) - 1), chain, False)
                i = stop
            else:
                i += 1
            while i < end and self.t[i] in (";", ","):
                i += 1

    def _names_list(self, brace: int, into) -> None:
        at = brace + 1
        while at < self.pair[brace]:
            stop = self.until(at, self.pair[brace], ",")
            k = at + (self.word(at) == "type" and stop - at > 1 and self.word(at + 1) != "as")
            if k < stop and self.kind[k] == "name":
                into(self.t[k], self.t[k + 2] if self.word(k + 1) == "as" else self.t[k])
            at = stop + 1

    def script_import(self, i: int, end: int) -> int:
        i += self.word(i) == "type" and self.word(i + 1) != "from"
        while i < end and self.t[i] not in ("from", ";") and self.kind[i] != "text":
            if self.t[i] == "{":
                self._names_list(i, lambda n, a: self.imports.append((n, a)))
                i = self.pair[i]
            elif self.t[i] == "*":
                i += 2
            elif self.is_name(i):
                self.imports.append((self.t[i], self.t[i]))
            i += 1
        return max(i, 1) + 1

    def script_handed(self, brace: int, end: int) -> int:
        close = self.pair[brace]
        if self.word(close + 1) == "from":
            self._names_list(brace, lambda n, a: self.handed.append((n, a)))
        return close + 1

    # --- what a symbol's span holds ---------------------------------------------------------------------

    def read(self) -> list[dict]:
        (self.rust_items if self.rust else self.script_items)(0, self.n, (), False)
        branches, calls = self._marks()
        out, seen = [], set()
        for s in self.symbols:
            key = (self.line[s.first], s.name, s.kind)
            if key in seen:
                continue
            seen.add(key)
            span = range(s.first, min(s.last + 1, self.n))
            bound = {self.t[k] for k in span if self.bound[k]}
            refs, trefs = [], set()
            for k in span:
                x = self.t[k]
                if self.kind[k] != "name" or x in self.words or x == s.name or x in bound:
                    continue
                if self.typed[k]:
                    if len(x) >= 2 and x not in _PRIMITIVE:
                        trefs.add(x)
                elif len(x) >= 3:
                    refs.append(x)
            start = self.at[s.first]
            q = [c for c in s.chain if c != s.name]
            out.append(
                {
                    "n": s.name, "t": s.kind, "l": self.line[s.first], "el": self.line[min(s.last, self.n - 1)], "sig": self.text[start : start + 200].split("\n")[0].strip(),
                    "cx": 1 + sum(branches[k] for k in span), "local": s.local, "q": "::".join([*q, s.name]) if q else None, "tr": s.tr, "exp": s.exp,
                    "refs": list(dict.fromkeys(refs)), "trefs": sorted(trefs), "qrefs": list(dict.fromkeys((p, n) for k, p, n in calls if k in span and n != s.name and len(n) >= 3)),
                }
            )
        return sorted(out, key=lambda r: (r["l"], r["n"]))

    def _marks(self) -> tuple[list[int], list[tuple[int, str, str]]]:
        """Where the flow branches, and calls through paths: (place, path, name)."""
        deciding = {"if", "while", "for", "loop", "&&", "||"} if self.rust else {"if", "while", "for", "do", "case", "catch", "&&", "||", "??"}
        branches, calls = [0] * len(self.t), []
        for k, x in enumerate(self.t):
            if x in deciding and self.kind[k] in ("name", "sign"):
                branches[k] = 1
            elif self.rust and x == "=>" or x == "?" and (self.rust or (not self.typed[k + 1] and self.word(k + 1) not in (":", ",", ")", ";"))):
                branches[k] = 1
            if self.rust and x == "(" and self.is_name(k - 1) and k >= 3 and self.t[k - 2] == "::":
                j, path = k - 2, []
                while j > 0 and self.t[j] == "::" and self.kind[j - 1] == "name":
                    path.append(self.t[j - 1])
                    j -= 2
                if path:
                    calls.append((j + 1, "::".join(reversed(path)), self.t[k - 1]))
        if self.rust:  # "for" of an impl, and of a bound, decides nothing
            for k, x in enumerate(self.t):
                if x == "for" and self.typed[k]:
                    branches[k] = 0
        return branches, calls


def read(lang: str, text: str) -> tuple[list[dict], list[tuple[str, str]], list[tuple[str, str]]]:
    """(symbols, imports (name, local), names handed on (name, as)) of one text."""
    r = Reader(text, lang == "rust")
    found = r.read()
    return found, list(dict.fromkeys(r.imports)), list(dict.fromkeys(r.handed))

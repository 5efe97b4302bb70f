"""Function and class spans, imports and lexical errors of JavaScript, TypeScript, Go, Rust and Java sources.

A file is read once by a lexical automaton: strings, templates, comments, character and pattern literals are skipped over, brackets
are matched with a stack, so depth costs no recursion. Declarations are then told by the few tokens around their
keyword or name. What is wrong with a file (brackets without partner, texts and comments without end) comes out as marks of its own; grammar
beyond brackets isn't checked, so a file without marks may still not compile.
"""

from __future__ import annotations

import bisect
import re
from functools import lru_cache
from typing import NamedTuple

# Node types by language, as the consumers of a node table know them.
NODE_TYPES = {
    "javascript": {"function_declaration", "function_expression", "arrow_function", "method_definition", "class_declaration", "class_expression"},
    "typescript": {"function_declaration", "function_expression", "arrow_function", "method_definition", "class_declaration", "method_signature", "function_signature"},
    "tsx": {"function_declaration", "function_expression", "arrow_function", "method_definition", "class_declaration"},
    "go": {"function_declaration", "method_declaration", "func_literal"},
    "rust": {"function_item", "closure_expression", "impl_item"},
    "java": {"method_declaration", "constructor_declaration", "class_declaration", "interface_declaration"},
}
LANGUAGES = tuple(NODE_TYPES)

_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")", "]", "}"}
_CONTROL = {"if", "for", "while", "switch", "catch", "with", "function", "return", "do", "else", "typeof", "await", "yield", "new", "throw", "case", "in", "of", "instanceof", "try", "synchronized", "super", "this"}
_MEMBER_WORDS = {"async", "static", "get", "set", "*", "public", "private", "protected", "readonly", "override", "accessor", "abstract", "declare"}
_JAVA_WORDS = {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "default", "strictfp", "sealed", "transient", "volatile", "non", "-"}

_WORD = r"[^\W\d][\w$]*|[$#][\w$]+"
_NUMBER = r"\d[\w.]*"
_DOUBLE = r'"(?:\\.|[^"\\\n])*"'
_SINGLE = r"'(?:\\.|[^'\\\n])*'"
_LEX = {
    "js": rf"(?P<gap>//[^\n]*|/\*[\s\S]*?\*/|(?<=\w)'(?=\w))|(?P<text>{_DOUBLE}|{_SINGLE})|(?P<word>{_WORD})|(?P<num>{_NUMBER})|(?P<op>=>|\.\.\.|\?\.|&&|\|\||[=!<>]=+|\S)",
    "go": rf"(?P<gap>//[^\n]*|/\*[\s\S]*?\*/)|(?P<text>{_DOUBLE}|`[^`]*`|'(?:\\.[^']*|[^'\\\n])')|(?P<word>{_WORD})|(?P<num>{_NUMBER})|(?P<op>\.\.\.|:=|<-|\S)",
    "rust": rf"(?P<gap>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<text>\b[bc]?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|[bc]?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\[^\n]+?|[^'\\\n])'|'[^\W\d]\w*)|(?P<word>r#\w+|{_WORD})|(?P<num>\d[\w]*(?:\.\d\w*)?)|(?P<op>->|=>|::|\.\.=?|&&|\|\||\S)",
    "java": rf"(?P<gap>//[^\n]*|/\*[\s\S]*?\*/)|(?P<text>\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|{_DOUBLE}|{_SINGLE})|(?P<word>{_WORD})|(?P<num>{_NUMBER})|(?P<op>->|::|\.\.\.|\S)",
}
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_TEMPLATE = re.compile(r"\\[\s\S]|`|\$\{")
_NESTED = re.compile(r"/\*|\*/")


class Node(NamedTuple):
    node_type: str
    name: str
    start_row: int
    end_row: int


class Source:
    """Tokens of a text: words, brackets with their partners, the bracket around each, and error places."""

    def __init__(self, text: str, family: str):
        self.text, self.family = text, family
        self.tok: list[str] = []
        self.kind: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.pair: dict[int, int] = {}
        self.around: list[int] = []
        self.errors: list[tuple[str, int]] = []
        self._read()
        self.lines = [m.end() for m in re.finditer("\n", text)]

    def _add(self, tok: str, kind: str, a: int, b: int) -> int:
        for held, x in ((self.tok, tok), (self.kind, kind), (self.start, a), (self.end, b), (self.around, self.stack[-1] if self.stack else -1)):
            held.append(x)
        return len(self.tok) - 1

    def _read(self) -> None:
        text, lex = self.text, re.compile(_LEX[self.family])
        self.stack: list[int] = []
        at = 0
        while m := lex.search(text, at):
            at, kind, tok = m.end(), m.lastgroup if m.lastgroup != "h" else "text", m.group()
            if kind == "gap":
                if self.family == "rust" and tok.startswith("/*"):
                    at = self._nested(m.start())
                continue
            if kind != "op":
                self._add(tok, kind, m.start(), at)
            elif tok == "/" and self.family == "js" and self._prefix() and (p := _PATTERN.match(text, m.start())):
                at = p.end()
                self._add(p.group(), "text", m.start(), at)
            elif text.startswith("/*", m.start()):
                self.errors.append(("comment without end", m.start()))
                at = self._nested(m.start()) if self.family == "rust" else len(text)
            elif tok == "`" and self.family == "js":
                at = self._template(m.start(), at)
            elif tok in "\"'`" and not (tok == "'" and self.family == "rust"):
                self.errors.append(("text without end", m.start()))
                at = end if (end := text.find("\n", at)) >= 0 else len(text)
                self._add(tok, "text", m.start(), at)
            elif tok in _OPEN:
                self.stack.append(self._add(tok, "op", m.start(), at))
            elif tok in _CLOSE:
                if self.stack and _OPEN[self.tok[self.stack[-1]]] == tok:
                    first = self.stack.pop()
                    self.pair[first] = self._add(tok, "op", m.start(), at)
                    self.pair[len(self.tok) - 1] = first
                    if self.tok[first] == "${":
                        at = self._template(self.start[first], at)
                else:
                    self.errors.append((f"{tok} without partner", m.start()))
            else:
                self._add(tok, "op", m.start(), at)
        for first in self.stack:
            self.errors.append((f"{self.tok[first]} without partner", self.start[first]))
            self.pair[first] = len(self.tok) - 1

    def _nested(self, at: int) -> int:
        """End of a comment that may hold comments."""
        depth = 0
        for m in _NESTED.finditer(self.text, at):
            depth += 1 if m.group() == "/*" else -1
            if depth == 0:
                return m.end()
        if not any(e[1] == at for e in self.errors):
            self.errors.append(("comment without end", at))
        return len(self.text)

    def _template(self, start: int, at: int) -> int:
        """Reads on in a template; at its end, or at ``${``, which opens a bracket."""
        while m := _TEMPLATE.search(self.text, at):
            at = m.end()
            if m.group() == "`":
                self._add("`", "text", start, at)
                return at
            if m.group() == "${":
                self.stack.append(self._add("${", "op", m.start(), at))
                return at
        self.errors.append(("text without end", start))
        return len(self.text)

    def _prefix(self) -> bool:
        """Whether an operand has to follow, so that a slash begins a pattern."""
        if not self.tok:
            return True
        last = self.tok[-1]
        return last in _CONTROL or self.kind[-1] == "op" and last not in (")", "]", "}")

    def row(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at)

    def is_(self, i: int, *toks: str) -> bool:
        return 0 <= i < len(self.tok) and self.tok[i] in toks and self.kind[i] != "text"

    def same_row(self, i: int, j: int) -> bool:
        return self.row(self.start[i]) == self.row(self.start[j])

    def angles(self, i: int) -> int:
        """The token after <...> at ``i``; ``i`` itself if there is none."""
        if not self.is_(i, "<"):
            return i
        depth, j = 0, i
        while j < len(self.tok):
            if self.is_(j, "<"):
                depth += 1
            elif self.is_(j, ">"):
                depth -= 1
                if depth == 0:
                    return j + 1
            elif self.is_(j, "(", "[", "{"):
                j = self.pair[j]
            elif self.is_(j, ";", ")", "]", "}"):
                return i
            j += 1
        return i

    def node(self, kind: str, name: str, i: int, j: int) -> tuple[int, int, Node]:
        j = min(j, len(self.tok) - 1)
        return self.start[i], -self.end[j], Node(kind, name, self.row(self.start[i]), self.row(max(self.start[i], self.end[j] - 1)))


def _body(s: Source, i: int, types: bool) -> int | None:
    """The { of a body after the closing bracket ``i`` of parameters, over a result type; None if there is no body."""
    j = i + 1
    if s.is_(j, "{"):
        return j
    if not types or not s.is_(j, ":"):
        return None
    j += 1
    while j < len(s.tok):
        if s.is_(j, "{"):
            if not s.is_(j - 1, ":", "|", "&", "=>", "<", ","):
                return j
            j = s.pair[j]
        elif s.is_(j, "(", "["):
            j = s.pair[j]
        elif s.is_(j, "<") and (k := s.angles(j)) > j:
            j = k - 1
        elif s.is_(j, ";", ")", "]", "}", "=", ","):
            return None
        elif not s.same_row(j - 1, j) and s.kind[j] != "op" and not s.is_(j - 1, ":", "|", "&", "=>"):
            return None
        j += 1
    return None


def _statement(s: Source, i: int) -> bool:
    """Whether a statement begins at ``i``."""
    if i == 0 or s.is_(i - 1, ";", "{", "}", "export", "default", "declare"):
        return True
    return not s.same_row(i - 1, i) and (s.kind[i - 1] != "op" or s.is_(i - 1, ")", "]"))


def _script(s: Source, types: bool, wanted: set[str]) -> list:
    out, members, classes = [], set(), set()
    for i, tok in enumerate(s.tok):
        if s.kind[i] == "word" and not s.is_(i - 1, ".", "?."):
            if tok == "class" and not s.is_(i + 1, ":", "(", ",", "=", ")"):
                named = s.kind[i + 1] == "word" if i + 1 < len(s.tok) else False
                named = named and s.tok[i + 1] not in ("extends", "implements")
                j = i + 1
                while j < len(s.tok) and not s.is_(j, "{", ";"):
                    j = s.pair[j] + 1 if s.is_(j, "(", "[") else max(s.angles(j), j + 1) if s.is_(j, "<") else j + 1
                if s.is_(j, "{"):
                    classes.add(j)
                    kind = "class_declaration" if named and _statement(s, i) else "class_expression"
                    if not s.is_(i - 1, "abstract"):
                        out.append(s.node(kind, s.tok[i + 1] if named else "<anonymous>", i, s.pair[j]))
            elif types and tok == "interface" and s.kind[i + 1 : i + 2] == ["word"]:
                j = s.angles(i + 2)
                while j < len(s.tok) and not s.is_(j, "{", ";"):
                    j = max(s.angles(j), j + 1)
                members.add(j)
            elif types and tok == "type" and s.kind[i + 1 : i + 2] == ["word"] and s.is_(j := s.angles(i + 2), "=") and s.is_(j + 1, "{"):
                members.add(j + 1)
            elif tok == "function" and not s.is_(i + 1, "*", ":"):
                named = s.kind[i + 1 : i + 2] == ["word"]
                j = s.angles(i + 1 + named)
                if s.is_(j, "("):
                    first = i - 1 if s.is_(i - 1, "async") else i
                    name = s.tok[i + 1] if named else "<anonymous>"
                    body = _body(s, s.pair[j], types)
                    if body is not None:
                        out.append(s.node("function_declaration" if named and _statement(s, first) else "function_expression", name, first, s.pair[body]))
                    elif types and named:
                        end = s.pair[j]
                        while end + 1 < len(s.tok) and s.same_row(end, end + 1) and not s.is_(end, ";"):
                            end += 1
                        out.append(s.node("function_signature", name, first, end))
        if tok == "=>" and i and s.kind[i] == "op":
            first = s.pair.get(i - 1) if s.is_(i - 1, ")") else i - 1 if s.kind[i - 1] == "word" else None
            if types:
                k = i - 1
                while k > 0 and s.around[k] == s.around[i] and not s.is_(k, ";", ",", "=", "=>", "{") and i - k < 40:
                    if s.is_(k, ":"):
                        first = s.pair.get(k - 1, first) if s.is_(k - 1, ")") else first
                        break
                    k = s.pair[k] - 1 if s.is_(k, ")", "]", "}") and k in s.pair else k - 1
            if first is not None and first >= 0:
                if s.is_(first - 1, "async"):
                    first -= 1
                if not (types and _in_type(s, first, classes | members)):
                    out.append(s.node("arrow_function", "<arrow>", first, _expression(s, i + 1)))
        if s.is_(i, "(") and i and s.around[i] >= 0 and s.is_(s.around[i], "{"):
            j = i - 1
            if s.is_(j, ">"):  # type parameters
                while j > 0 and not (s.is_(j, "<") and s.angles(j) == i):
                    j -= 1
                j -= 1
            name = j if j >= 0 and (s.kind[j] in ("word", "text", "num") or s.is_(j, "]")) else None
            if name is None or s.kind[name] == "word" and s.tok[name] in _CONTROL or s.around[name] != s.around[i]:
                continue
            lead = s.pair.get(name, name) if s.is_(name, "]") else name
            first = lead
            while first > 0 and s.tok[first - 1] in _MEMBER_WORDS and s.around[first - 1] == s.around[i]:
                first -= 1
            starts = s.is_(first - 1, "{", "}", ";", ",", ")") or not s.same_row(first - 1, first) or s.is_(first - 2, "@")
            if not starts or s.is_(first - 1, ".", "=>", "=", "new", "function") or s.is_(lead - 1, ".", "function", "new"):
                continue
            text = s.text[s.start[lead] : s.end[name]]
            body = _body(s, s.pair[i], types)
            if body is not None and s.same_row(s.pair[i], s.pair[i]) and not (s.is_(first - 1, ")") and s.same_row(first - 1, first)):
                out.append(s.node("method_definition", text, first, s.pair[body]))
            elif types and body is None and s.around[i] in members | classes:
                end = s.pair[i]
                while end + 1 < len(s.tok) and s.same_row(end, end + 1) and not s.is_(end + 1, ";", ",", "}"):
                    end += 1
                out.append(s.node("method_signature", text, first, end))
    return [x for x in out if x[2].node_type in wanted]


def _in_type(s: Source, first: int, bodies: set[int]) -> bool:
    """Whether (..) => .. at ``first`` is a function's type: after a colon in parameters, in a class or type body, or of a variable."""
    before = first - 1
    if s.is_(before, "|", "&", "<", "as", "extends", "implements"):
        return True
    if s.is_(before, "=") and s.is_(before - 2, "type"):
        return True
    if not s.is_(before, ":"):
        return False
    return s.around[first] in bodies or s.is_(s.around[first], "(") or s.is_(before - 2, "const", "let", "var") or s.is_(before - 1, "?", ")")


def _expression(s: Source, i: int) -> int:
    """The last token of the expression, or of the block, that begins at ``i``."""
    if s.is_(i, "{"):
        return s.pair[i]
    j = i
    while j < len(s.tok):
        if s.is_(j, "(", "[", "{", "${"):
            j = s.pair[j]
        after = j + 1
        if after >= len(s.tok) or s.is_(after, ",", ";", ")", "]", "}", ":"):
            return j
        if not s.same_row(j, after) and s.kind[after] != "op" and (s.kind[j] != "op" or s.is_(j, ")", "]", "}")):
            return j
        j = after
    return len(s.tok) - 1


def _go(s: Source, wanted: set[str]) -> list:
    out = []
    for i, tok in enumerate(s.tok):
        if tok != "func" or s.kind[i] != "word":
            continue
        kind, name, j = "function_declaration", "", i + 1
        if s.is_(j, "("):
            k = s.pair[j] + 1
            if s.kind[k : k + 1] == ["word"] and s.is_(k + 1, "(") and s.tok[k] != "func" and (i == 0 or not s.same_row(i - 1, i)):
                kind, name, j = "method_declaration", s.tok[k], k + 1
            else:
                kind, name = "func_literal", "<anonymous>"
        elif s.kind[j : j + 1] == ["word"]:
            name = s.tok[j]
            j = s.pair[j + 1] + 1 if s.is_(j + 1, "[") else j + 1
        if not s.is_(j, "("):
            continue
        end = j = s.pair[j]
        while j + 1 < len(s.tok) and s.same_row(j, j + 1):
            j += 1
            if s.is_(j, "{"):
                if s.is_(j - 1, "interface", "struct"):
                    j = s.pair[j]
                    continue
                end = s.pair[j]
                break
            if s.is_(j, ",", ")", "]", "}", ";", "="):
                j = None
                break
            j = s.pair[j] if s.is_(j, "(", "[") else j
            if kind != "func_literal":
                end = j
        if kind != "func_literal" or s.is_(end, "}") and end != s.pair.get(i + 1):
            out.append(s.node(kind, name, i, end))
    return [x for x in out if x[2].node_type in wanted]


def _rust(s: Source, wanted: set[str]) -> list:
    out = []
    for i, tok in enumerate(s.tok):
        if s.kind[i] == "word" and tok == "fn" and s.kind[i + 1 : i + 2] == ["word"]:
            j = i + 2
            while j < len(s.tok) and not s.is_(j, "{", ";"):
                j = s.pair[j] + 1 if s.is_(j, "(", "[") else j + 1
            first = i
            while first and (s.tok[first - 1] in ("pub", "async", "unsafe", "const", "extern", "default") or s.kind[first - 1] == "text" and s.is_(first - 2, "extern") or s.is_(first - 1, ")") and s.is_(s.pair.get(first - 1, 0) - 1, "pub")):
                first = s.pair[first - 1] - 1 if s.is_(first - 1, ")") else first - 1
            if s.is_(j, "{"):
                out.append(s.node("function_item", s.tok[i + 1], first, s.pair[j]))
        elif s.kind[i] == "word" and tok == "impl" and (i == 0 or s.is_(i - 1, "}", ";", "{", "]", "unsafe", "default")):
            j = i + 1
            while j < len(s.tok) and not s.is_(j, "{", ";"):
                j = s.pair[j] + 1 if s.is_(j, "(", "[") else j + 1
            if s.is_(j, "{"):
                out.append(s.node("impl_item", "<anonymous>", i - 1 if s.is_(i - 1, "unsafe") else i, s.pair[j]))
        elif s.is_(i, "|", "||") and (i == 0 or s.is_(i - 1, "(", ",", "=", "{", ";", "return", "move", "=>", "[", "async", "else", "in")):
            j = i
            if tok == "|":
                j = i + 1
                while j < len(s.tok) and not s.is_(j, "|"):
                    j = s.pair[j] + 1 if s.is_(j, "(", "[", "{") else j + 1
            if j + 1 >= len(s.tok) or s.is_(j + 1, "=>"):
                continue
            k = j + 1
            if s.is_(k, "->"):
                while k < len(s.tok) and not s.is_(k, "{"):
                    k += 1
            end = _expression(s, k)
            name = s.tok[k] if end == k and s.kind[k] == "word" else "<anonymous>"
            out.append(s.node("closure_expression", name, i - 1 if s.is_(i - 1, "move") else i, end))
    return [x for x in out if x[2].node_type in wanted]


def _java(s: Source, wanted: set[str]) -> list:
    out, bodies = [], {}

    def begin(i: int) -> int:
        """Back over modifiers and annotations to where a member begins."""
        while i > 0 and s.around[i - 1] == s.around[i]:
            if s.tok[i - 1] in _JAVA_WORDS and s.kind[i - 1] != "text":
                i -= 1
            elif s.is_(i - 1, ")") and s.kind[k := s.pair.get(i - 1, 0) - 1] == "word" and s.is_(k - 1, "@"):
                i = k - 1
            elif s.kind[i - 1] == "word" and s.is_(i - 2, "@"):
                i -= 2
            else:
                break
        return i

    for i, tok in enumerate(s.tok):
        if s.kind[i] == "word" and tok in ("class", "interface", "enum", "record") and s.kind[i + 1 : i + 2] == ["word"] and not s.is_(i - 1, ".", "@"):
            j = i + 2
            while j < len(s.tok) and not s.is_(j, "{", ";"):
                j = s.pair[j] + 1 if s.is_(j, "(", "[") else j + 1
            if s.is_(j, "{"):
                bodies[j] = s.tok[i + 1]
                if tok in ("class", "interface"):
                    out.append(s.node(f"{tok}_declaration", s.tok[i + 1], begin(i), s.pair[j]))
        elif s.is_(i, "new"):  # an anonymous class has a body after its arguments
            j = i + 1
            while j < len(s.tok) and (s.kind[j] == "word" or s.is_(j, ".", "<", ">", ",", "?", "@", "&")):
                j += 1
            if s.is_(j, "(") and s.is_(s.pair[j] + 1, "{"):
                bodies[s.pair[j] + 1] = ""
        elif s.is_(i, "(") and i and s.around[i] in bodies and s.kind[i - 1] == "word" and s.tok[i - 1] not in _CONTROL:
            j = s.pair[i] + 1
            if s.is_(j, "throws"):
                while j < len(s.tok) and not s.is_(j, "{", ";"):
                    j += 1
            if s.is_(j, "default"):
                while j < len(s.tok) and not s.is_(j, ";"):
                    j += 1
            if not s.is_(j, "{", ";") or s.is_(i - 2, "@", "new", ".", "=", "->", "return"):
                continue
            name, first = s.tok[i - 1], i - 1
            member = begin(first)
            if name == bodies[s.around[i]] and (member == 0 or s.is_(member - 1, "{", "}", ";", ">")):
                kind = "constructor_declaration"
            else:
                kind = "method_declaration"
                while first > 0 and not s.is_(first - 1, ";", "{", "}") and s.around[first - 1] == s.around[i]:
                    if s.is_(first - 1, "="):
                        kind = ""
                        break
                    first -= 1
                member = first
                if first == i - 1:  # no type before the name: a call or an enum constant
                    continue
            if kind:
                out.append(s.node(kind, name, member, s.pair[j] if s.is_(j, "{") else j))
    return [x for x in out if x[2].node_type in wanted]


def _family(language: str) -> str:
    return "js" if language in ("javascript", "typescript", "tsx") else language


def _imports(s: Source) -> list[str]:
    word = "use" if s.family == "rust" else "import"
    out = []
    for i, tok in enumerate(s.tok):
        if tok != word or s.kind[i] != "word" or s.is_(i - 1, ".") or s.is_(i + 1, "(") and s.family == "js" or s.is_(i + 1, ".") and s.family == "js":
            continue
        if s.around[i] >= 0 and s.family != "rust" or not (i == 0 or s.is_(i - 1, ";", "}", "{", "pub", ")", "]") or not s.same_row(i - 1, i)):
            continue
        first, j = i, i + 1
        if s.family == "rust" and s.is_(i - 1, "pub"):
            first = i - 1
        if s.family == "go":
            end = s.pair[j] if s.is_(j, "(") else j if j < len(s.tok) and s.kind[j] == "text" else j + 1
            out.append(s.text[s.start[first] : s.end[min(end, len(s.tok) - 1)]])
            if s.is_(j, "("):  # each of its specs again
                rows: dict[int, list[int]] = {}
                for k in range(j + 1, s.pair[j]):
                    rows.setdefault(s.row(s.start[k]), []).append(k)
                out += [s.text[s.start[ks[0]] : s.end[ks[-1]]] for ks in rows.values()]
            elif end < len(s.tok):
                out.append(s.text[s.start[j] : s.end[end]])
            continue
        while j < len(s.tok) and not s.is_(j, ";") and not (s.family == "js" and s.kind[j] == "text"):
            j = s.pair[j] + 1 if s.is_(j, "{") else j + 1
        if s.family == "js" and s.is_(j + 1, ";"):
            j += 1
        out.append(s.text[s.start[first] : s.end[min(j, len(s.tok) - 1)]].strip())
    return out


@lru_cache(maxsize=4)
def read(text: str, language: str) -> Source:
    return Source(text, _family(language))


def nodes(text: str, language: str) -> list[Node]:
    """Function and class nodes in order of their place, outer ones first; rows from 0."""
    s, wanted = read(text, language), NODE_TYPES[language]
    found = _go(s, wanted) if language == "go" else _rust(s, wanted) if language == "rust" else _java(s, wanted) if language == "java" else _script(s, language != "javascript", wanted)
    return [n for _, _, n in sorted(found, key=lambda x: x[:2])]


def import_lines(text: str, language: str) -> list[str]:
    return _imports(read(text, language))


def errors(text: str, language: str) -> list[tuple[str, int]]:
    """(what is wrong, row from 0)."""
    s = read(text, language)
    return [(what, s.row(at)) for what, at in sorted(s.errors, key=lambda e: e[1])]

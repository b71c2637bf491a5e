"""Declarations of brace and `end` languages: one scanner and one island grammar, driven by a table for each language.

The scanner knows what a brace in a comment, string, template, character or regular-expression literal is not. The grammar reads only
declarations (imports, types, functions, methods, arrow functions) and jumps from bracket to bracket over the rest, so that it gives right spans without
a full grammar, and stays linear in the text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Language:
    """What differs between languages: comments, literals, the words that begin functions and types, and how blocks end."""

    line: str = "//"
    block: bool = True
    nested: bool = False  # block comments nest
    raw: str = ""  # a pattern of raw strings
    quotes: str = "\"'"
    regex: bool = False
    templates: bool = False
    lifetimes: bool = False
    functions: frozenset = frozenset()
    types: frozenset = frozenset("class struct interface trait enum object protocol record".split())
    scopes: frozenset = frozenset()  # hold declarations, but are none
    typed: bool = False  # functions need no word: type name(...) {
    ends: bool = False  # blocks end with `end`
    lines: bool = False  # a declaration begins with its line
    extends: tuple = ("extends", ":")


_C = Language(line="//|#", typed=True, raw=r'R"(?P<d>[^()\\\s]{0,16})\((?s:.*?)\)(?P=d)"', scopes=frozenset({"namespace"}), types=frozenset("class struct enum union".split()))
_JAVA = Language(typed=True, raw=r'"""(?s:.*?)"""')
LANGUAGES = {
    "go": Language(raw=r"`[^`]*`", functions=frozenset({"func"}), types=frozenset({"type"})),
    "typescript": Language(regex=True, templates=True, functions=frozenset({"function"}), types=frozenset({"class"})),
    "c": _C, "cpp": _C, "java": _JAVA, "csharp": Language(typed=True, raw=r'@"(?:[^"]|"")*"|"""(?s:.*?)"""', scopes=frozenset({"namespace"})), "groovy": _JAVA,
    "rust": Language(nested=True, lifetimes=True, raw=r'b?r(?P<d>#*)"(?s:.*?)"(?P=d)', functions=frozenset({"fn"}), types=frozenset("struct enum trait union".split()), scopes=frozenset({"impl", "mod"}), extends=(":",)),
    "kotlin": Language(lines=True, nested=True, raw=r'"""(?s:.*?)"""', functions=frozenset({"fun"})),
    "scala": Language(lines=True, nested=True, raw=r'"""(?s:.*?)"""', functions=frozenset({"def"})),
    "swift": Language(lines=True, nested=True, raw=r'"""(?s:.*?)"""', functions=frozenset({"func"}), types=frozenset("class struct enum protocol actor".split()), scopes=frozenset({"extension"})),
    "php": Language(lines=True, line="//|#(?!\\[)", functions=frozenset({"function"})),
    "ruby": Language(lines=True, line="#", block=False, ends=True, regex=True, functions=frozenset({"def"}), types=frozenset({"class", "module"}), extends=("<",)),
    "lua": Language(lines=True, line=r"--\[\[(?s:.*?)\]\]|--", block=False, ends=True, raw=r"\[\[(?s:.*?)\]\]", functions=frozenset({"function"}), types=frozenset()),
    "elixir": Language(lines=True, line="#", block=False, ends=True, raw=r'"""(?s:.*?)"""', functions=frozenset({"def", "defp"}), types=frozenset({"defmodule"})),
}
#: What is not in the table: braces, // and # comments, and every word that begins a function or type somewhere.
OTHER = Language(line="//|#", typed=True, functions=frozenset("function func fn fun def sub proc".split()), scopes=frozenset({"namespace", "module", "impl"}))
NOT_NAMES = frozenset("if for while switch catch return function func new typeof await else do try defer select case match when unless sizeof assert with in delete throw yield super void elif foreach synchronized and or not".split())
#: Words before a bracket and a block that are no function either.
BLOCKS = NOT_NAMES | frozenset("lock using until fixed end".split())
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do yield await and or not if unless while when puts".split())
PAIRS = {"(": ")", "[": "]", "{": "}"}
_WORD = re.compile(r"[^\W\d][\w$]*[?!]?|\$\w+|@@?\w+|#\w+", re.U)
_PUNCT = re.compile(r"=>|->|::|\?\.|\.\.\.|==|<=|>=|&&|\|\||.", re.S)


@dataclass(slots=True)
class Token:
    kind: str  # word, text (any literal), comment, punct
    text: str
    start: int
    end: int
    line: int
    close: int = -1  # of an opening bracket: the index of the one that closes it


@dataclass
class Scanner:
    code: str
    language: Language
    jsx: bool = False
    out: list[Token] = field(default_factory=list)

    def run(self) -> list[Token]:
        lang = self.language
        quoted = "|".join(rf"{q}(?:\\(?s:.)|[^{q}\\\n])*{q}" for q in lang.quotes if not (q == "'" and lang.lifetimes))
        if lang.lifetimes:
            quoted += r"|'(?:\\(?:u\{[^}]*\}|x\w\w|.)|[^'\\\n])'"
        parts = [rf"(?P<comment>(?:{lang.line})[^\n]*" + (r"|/\*(?s:.*?)(?:\*/|\Z)" if lang.block and not lang.nested else "") + ")"]
        parts += [rf"(?P<raw>{lang.raw})"] if lang.raw else []
        parts += [rf"(?P<quoted>{quoted})", r"(?P<number>\d[\w.]*)"]
        self.lexer = re.compile("|".join(parts))
        self.line_at, self.line = 0, 1
        self._upto(0, len(self.code), "")
        return self.out

    def _add(self, kind: str, start: int, end: int) -> int:
        self.line += self.code.count("\n", self.line_at, start)
        self.line_at = start
        self.out.append(Token(kind, self.code[start:end], start, end, self.line))
        return end

    def _operand(self) -> bool:
        """Whether what stands before ends an operand, so that / divides and < compares."""
        last = next((t for t in reversed(self.out[-8:]) if t.kind != "comment"), None)
        if last is None:
            return False
        return last.kind == "text" or (last.text not in BEFORE_REGEX if last.kind == "word" else last.text in (")", "]", "}"))

    def _upto(self, at: int, end: int, stop: str) -> int:
        """Scans until an unmatched `stop` or the end; the place behind."""
        code, depth = self.code, 0
        while at < end:
            c = code[at]
            if c.isspace():
                at += 1
                continue
            if self.language.nested and code.startswith("/*", at):
                at = self._add("comment", at, self._nested(at))
            elif self.language.ends and c == "=" and code.startswith("=begin", at) and (not at or code[at - 1] == "\n"):
                found = code.find("\n=end", at)
                at = self._add("comment", at, end if found < 0 else found + 5)
            elif c == "`" and self.language.templates:
                at = self._template(at)
            elif m := self.lexer.match(code, at):
                at = self._add("comment" if m["comment"] is not None else "text", at, m.end())
            elif c == "/" and self.language.regex and not self._operand() and (m := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*").match(code, at)):
                at = self._add("text", at, m.end())
            elif c == "<" and self.jsx and not self._operand() and re.compile(r"<(?:>|[A-Za-z])").match(code, at):
                at = self._element(at)
            elif m := _WORD.match(code, at):
                at = self._add("word", at, m.end())
            else:
                if stop and c in "{}":
                    depth += 1 if c == "{" else -1
                    if depth < 0:
                        return at + 1
                at = self._add("punct", at, _PUNCT.match(code, at).end())
        return end

    def _nested(self, at: int) -> int:
        depth = 0
        for m in re.compile(r"/\*|\*/").finditer(self.code, at):
            depth += 1 if m[0] == "/*" else -1
            if not depth:
                return m.end()
        return len(self.code)

    def _template(self, at: int) -> int:
        """A template string; what its ${} hold is scanned as code."""
        start, code = at, self.code
        at += 1
        while at < len(code):
            if code[at] == "\\":
                at += 2
            elif code[at] == "`":
                return self._add("text", start, at + 1)
            elif code.startswith("${", at):
                self._add("text", start, at + 2)
                start = at = self._upto(at + 2, len(code), "}")
            else:
                at += 1
        return self._add("text", start, len(code))

    def _element(self, at: int) -> int:
        """A JSX element: tags and words are text, what braces hold is code."""
        code, open_ = self.code, 0
        start = at
        piece = re.compile(r"<!--|</[^>]*>|<(?:>|[A-Za-z][\w.:-]*)|/>|>|\"[^\"]*\"|'[^']*'|\{")
        tag = False
        while m := piece.search(code, at):
            at = m.end()
            if m[0] == "{":
                self._add("text", start, at)
                start = at = self._upto(at, len(code), "}")
            elif m[0][0] == "<" and m[0] != "<!--":
                open_ += -1 if m[0].startswith("</") else 1
                tag = not m[0].startswith("</") and m[0] != "<>"
            elif tag and m[0] in ("/>", ">"):
                open_ -= m[0] == "/>"
                tag = False
            elif m[0][0] in "\"'" and not tag:
                at = m.start() + 1  # an apostrophe in the text
            if not open_ and not tag:
                return self._add("text", start, at)
        return self._add("text", start, len(code))


def scan(code: str, language: Language, jsx: bool = False) -> tuple[list[Token], list[Token]]:
    """(tokens without comments, comments), brackets paired; a bracket that nothing closes ends with its parent."""
    found = Scanner(code, language, jsx).run()
    tokens, comments, open_ = [t for t in found if t.kind != "comment"], [t for t in found if t.kind == "comment"], []
    for i, t in enumerate(tokens):
        if t.kind != "punct":
            continue
        if t.text in PAIRS:
            open_.append(i)
        elif t.text in PAIRS.values():
            while open_:
                k = open_.pop()
                tokens[k].close = i
                if PAIRS[tokens[k].text] == t.text:
                    break
    for k in open_:
        tokens[k].close = len(tokens) - 1
    return tokens, comments


@dataclass
class Found:
    """A declaration: its tokens [first, last], where its head ends, and what it says."""

    name: str
    kind: str
    parent: str
    first: int
    last: int
    head: int
    extends: str = ""
    implements: list[str] = field(default_factory=list)
    exported: bool = False
    body: int = -1


class Grammar:
    """The declarations among a file's tokens."""

    def __init__(self, code: str, name: str, jsx: bool = False):
        self.name, self.language, self.code = name, LANGUAGES.get(name, OTHER), code
        self.tokens, self.comments = scan(code, self.language, jsx)
        self.found: list[Found] = []
        self.end_of = self._ends() if self.language.ends else {}
        {"go": self.go, "typescript": self.script}.get(name, self.other)(0, len(self.tokens), "")
        self.found.sort(key=lambda f: (f.first, -f.last))

    # -- steps -----------------------------------------------------------------------------------

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def after(self, i: int) -> int:
        """The place behind a token, or behind its bracket's end."""
        return (self.tokens[i].close if self.tokens[i].close >= 0 else i) + 1

    def angles(self, i: int) -> int:
        """Behind the type parameters at i, if there are any."""
        if self.text(i) != "<":
            return i
        depth = 0
        for k in range(i, min(i + 400, len(self.tokens))):
            depth += {"<": 1, ">": -1}.get(self.text(k), 0)
            if not depth:
                return k + 1
        return i

    def said(self, a: int, b: int) -> str:
        """The source of tokens [a, b)."""
        return self.code[self.tokens[a].start : self.tokens[b - 1].end] if a < b else ""

    def new_line(self, i: int) -> bool:
        return i <= 0 or i >= len(self.tokens) or self.tokens[i].line > self.last_line(i - 1)

    def last_line(self, i: int) -> int:
        return self.tokens[i].line + self.tokens[i].text.count("\n")

    def line_end(self, i: int) -> int:
        """The last token of the statement at i: a semicolon, the last before a closing bracket, or before a line that does not go on."""
        k = i
        while k < len(self.tokens):
            if self.text(k) in (";", ",", ")", "]", "}"):
                return k - 1
            n = self.after(k)
            if self.new_line(n) and not (self.text(n) in tuple(".?:&|+-*/=([`") + ("=>", "?.", "&&", "||") and self.name != "go") and self.text(n - 1) not in tuple("=+-*/&|?:(,.") + ("=>", "&&", "||"):
                return n - 1
            k = n
        return len(self.tokens) - 1

    # -- Go --------------------------------------------------------------------------------------

    def go(self, i: int, end: int, parent: str) -> None:
        while i < end:
            if self.text(i) == "func" and (self.word(i + 1) or self.text(i + 1) == "("):
                i = self._go_func(i)
            elif self.text(i) == "type" and self.text(i + 1) == "(":
                k = i + 2
                while k < self.tokens[i + 1].close:
                    k = self._go_type(k, k) if self.word(k) else k + 1
                i = self.after(i + 1)
            elif self.text(i) == "type" and self.word(i + 1):
                i = self._go_type(i, i + 1)
            else:
                i = self.after(i)

    def _go_func(self, i: int) -> int:
        k, owner = i + 1, ""
        if self.text(k) == "(":
            names = [self.text(x) for x in range(k + 1, self.tokens[k].close) if self.word(x)]
            stop = next((x for x in range(k + 1, self.tokens[k].close) if self.text(x) == "["), 0)  # type parameters of the receiver
            owner = self.text(stop - 1) if stop else names[-1] if names else ""
            k = self.after(k)
        name = self.text(k)
        if not self.word(k):
            return k + 1
        k += 1
        while self.text(k) in ("[", "("):
            done = self.text(k) == "("
            k = self.after(k)
            if done:
                break
        while k < len(self.tokens) and self.text(k) != "{" and not self.new_line(k):
            braced = self.text(k) in ("interface", "struct") and self.text(k + 1) == "{"
            k = self.after(k + 1) if braced else self.after(k)
        body = k if self.text(k) == "{" else -1
        last = self.tokens[k].close if body >= 0 else k - 1
        self.found.append(Found(name, "method" if owner else "function", owner, i, last, k, exported=name[0].isupper(), body=body))
        return last + 1

    def _go_type(self, first: int, at: int) -> int:
        name, k, extends = self.text(at), at + 1, ""
        if self.text(k) == "[" and self.word(k + 1) and self.word(k + 2):
            k = self.after(k)
        shape = self.text(k)
        last = self.line_end(k)
        head = last + 1
        if shape in ("struct", "interface") and self.text(k + 1) == "{":
            head, last = k + 1, self.tokens[k + 1].close
            if shape == "struct":
                extends = next((x for x in map(self._embedded, self._lines(k + 2, last)) if x), "")
        self.found.append(Found(name, "struct", "", first, last, head, extends=extends, exported=name[0].isupper()))
        return last + 1

    def _lines(self, a: int, b: int) -> list[tuple[int, int]]:
        out, start, k = [], a, a
        while k < b:
            n = self.after(k)
            if n >= b or self.new_line(n) or self.text(k) == ";":
                out.append((start, min(n, b)))
                start = n
            k = n
        return out

    def _embedded(self, part: tuple[int, int]) -> str:
        """The type of a field line that has no name."""
        shown = re.sub(r"\s+", "", "".join(self.text(i) for i in range(*part) if self.tokens[i].kind != "text" and self.text(i) != ";"))
        words = sum(self.word(i) for i in range(*part) if not any(self.text(x) == "[" for x in range(part[0], i)))
        m = re.fullmatch(r"\*?((?:\w+\.)?\w+)(\[.*\])?", shown)
        return m[1] if m and words <= 2 and (words == 1 or "." in m[1]) else ""

    # -- TypeScript and JavaScript -------------------------------------------------------------------

    def script(self, i: int, end: int, parent: str) -> None:
        first, said = i, False
        while i < end:
            t = self.text(i)
            if t in ("export", "default", "async", "abstract", "declare", "public") and self.word(i):
                first, said = (first if said else i), True
                i += 1
                continue
            first = first if said else i
            said = False
            fresh = self.text(first - 1) in ("", ";", "{", "}", ")", ":") or self.new_line(first) or self.text(first) == "export"
            if t == "function" and fresh and self.text(i - 1) != ".":
                k = i + 1 + (self.text(i + 1) == "*")
                i = self._callable(first, k, k + 1, parent, "method" if parent else "function") if self.word(k) else k
            elif t == "class" and fresh and self.word(i + 1) and self.text(i + 1) not in ("extends", "implements"):
                i = self._class(first, i + 1)
            elif t in ("const", "let", "var") and self.word(i + 1):
                i = self._variables(first, i + 1, end, parent)
            else:
                i += 1  # into brackets, too: callbacks hold declarations

    def _exported(self, first: int) -> bool:
        return self.text(first) == "export"

    def _callable(self, first: int, at: int, k: int, parent: str, kind: str) -> int:
        """A function or method whose name is at `at` and whose parameters follow at k; the place behind it."""
        k = self.angles(k)
        if self.text(k) != "(":
            return k
        head = k = self.after(k)
        if self.text(k) == ":":  # the type of the result, which may be braced itself
            k += 1
            while k < len(self.tokens) and self.text(k) not in ("{", ";") and not self.new_line(k):
                k = self.angles(k) if self.text(k) == "<" and self.angles(k) > k else self.after(k)
            if self.text(k) == "{" and self.text(self.after(k)) == "{" and self.text(k - 1) in (":", "|", "&"):
                k = self.after(k)
            head = k
        if self.text(k) != "{":
            return k
        last = self.tokens[k].close
        self.found.append(Found(self.text(at), kind, parent, first, last, head, exported=self._exported(first), body=k))
        self.script(k + 1, last, parent)
        return last + 1

    def _class(self, first: int, at: int) -> int:
        name, k, extends, implements = self.text(at), self.angles(at + 1), "", []
        while k < len(self.tokens) and self.text(k) != "{":
            if self.text(k) == "extends":
                n = k + 1
                while self.word(n) or self.text(n) == ".":
                    n += 1
                    if self.text(n) in ("implements", "{", "<", "("):
                        break
                extends, k = self.said(k + 1, n), self.after(n) if self.text(n) == "(" else self.angles(n)
            elif self.text(k) == "implements":
                k += 1
                while k < len(self.tokens) and self.text(k) != "{":
                    n = k
                    while self.word(n) or self.text(n) == ".":
                        n += 1
                    if n > k:
                        implements.append(self.said(k, n))
                    k = max(self.angles(n), k + 1)
            else:
                k = max(self.angles(k), k + 1)
        if k >= len(self.tokens):
            return at + 1
        last = self.tokens[k].close
        self.found.append(Found(name, "class", "", first, last, k, extends, implements, self._exported(first)))
        self._members(k + 1, last, name)
        return last + 1

    def _members(self, k: int, end: int, owner: str) -> None:
        while k < end:
            if self.text(k).startswith("@"):  # a decorator
                k = self.after(k + 1) if self.text(k + 1) == "(" else k + 1
                continue
            first = k
            while self.word(k) and self.text(k) in ("public", "private", "protected", "static", "async", "get", "set", "readonly", "override", "abstract", "declare", "accessor") and self.text(k + 1) not in ("(", "=", ":", ";", "?"):
                k += 1
            k += self.text(k) == "*"
            at = k
            if self.text(k) in ("{", "[", "("):
                n = self.after(k)
                if self.text(k) == "{":  # a static block
                    self.script(k + 1, n - 1, owner)
                    k = n
                    continue
                k = n
            else:
                k += 1
            k += self.text(k) in ("?", "!")
            n = self.angles(k)
            if self.text(n) == "(" and self.tokens[at].kind in ("word", "text"):
                k = max(self._callable(first, at, n, owner, "method"), n + 1)
            else:
                k = self._value(first, at, k, end, owner, "method")
            while k < end and self.text(k) in (";", ","):
                k += 1

    def _variables(self, first: int, at: int, end: int, parent: str) -> int:
        return self._value(first, at, at + 1, end, parent, "method" if parent else "function")

    def _value(self, first: int, at: int, k: int, end: int, parent: str, kind: str) -> int:
        """A variable or field: a declaration if its value is a function; the place behind its value."""
        while k < end and self.text(k) not in ("=", ";", ",") and not (self.new_line(k) and self.text(k - 1) not in (":", "|", "&", "=>") and self.text(k) not in ("|", "&", "=")):
            k = self.angles(k) if self.text(k) == "<" and self.angles(k) > k else self.after(k)
        if self.text(k) != "=":
            return max(k, at + 1)
        k += 1
        start = k
        k += self.text(k) == "async"
        if self.text(k) == "function":
            n = k + 1 + (self.text(k + 1) == "*")
            return max(self._callable(first, at, n + self.word(n), parent, kind), k + 1)
        k = self.angles(k)
        n = self.after(k) if self.text(k) == "(" else k + 1 if self.word(k) else k
        if self.text(n) == ":":
            n += 1
            while n < end and self.text(n) not in ("=>", ";", "=") and not (self.new_line(n) and self.text(n - 1) != "|"):
                n = self.after(n)
        if self.text(n) != "=>":
            return start  # any other value is read on as code
        body = n + 1
        last = self.tokens[body].close if self.text(body) == "{" else self.line_end(body)
        self.found.append(Found(self.text(at), kind, parent, first, last, n, exported=self._exported(first), body=body))
        self.script(body, last + 1, parent)
        return last + 1

    # -- all others --------------------------------------------------------------------------------

    def _ends(self) -> dict[int, int]:
        """Of each word that opens a block, the `end` that closes it."""
        opens = frozenset("def defp class module defmodule do begin case if unless while until for function repeat".split())
        out, stack, loop = {}, [], 0
        for i, t in enumerate(self.tokens):
            if t.kind != "word" or self.text(i - 1) in (".", ":"):
                continue
            if t.text in ("end", "until") and stack and (t.text == "end" or self.text(stack[-1]) == "repeat"):
                out[stack.pop()] = i
            elif t.text in opens and not (self.text(i + 1) == ":" and not self.new_line(i + 1)):
                modifier = t.text in ("if", "unless", "while", "until") and not self.new_line(i) and self.text(i - 1) not in ("=", "(", ",", "then", "else", "do")
                if t.text == "do" and loop == t.line:
                    loop = 0
                    continue
                if modifier or (self.name == "elixir" and t.text != "do"):
                    continue
                if self.name == "lua" and t.text == "if" and self.text(i - 1) == "else":
                    continue
                if t.text in ("while", "until", "for"):
                    loop = t.line
                stack.append(i)
        return out

    def other(self, i: int, end: int, owner: str) -> None:
        lang, first = self.language, i
        while i < end:
            t = self.text(i)
            if t in (";", "}") or (lang.lines and self.new_line(i)):
                first = i if t not in (";", "}") else i + 1
            if t in ("@",) or (self.word(i) and t.startswith("@")):  # an annotation
                i += 1 + (t == "@")
                i = self.after(i) if self.text(i) == "(" else i
                first = i
                continue
            if t == "#" and self.text(i + 1) == "[":  # an attribute
                i = first = self.after(i + 1)
                continue
            if self.word(i) and t in lang.types | lang.scopes and (self.word(i + 1) or (t == "impl" and self.text(i + 1) == "<")) and self.text(i - 1) not in (".", "::"):
                i = first = self._type(first, i)
            elif self.word(i) and t in lang.functions and self.word(self.angles(i + 1)):
                i = first = self._function(first, i, self.angles(i + 1), owner)
            elif lang.typed and self.word(i) and self.text(i + 1) == "(" and t not in BLOCKS and (i > first or t == owner) and self.text(i - 1) not in (".", "=", "->", "(", ","):
                n = self._typed(first, i, owner)
                first, i = (n, n) if n > i else (first, self.after(i + 1))
            else:
                n = self.after(i)
                if t == "{" or (t == ":" and self.text(i - 1) in ("public", "private", "protected")):
                    first = n
                i = n

    def _close(self, opener: int, k: int) -> tuple[int, int]:
        """(where the head ends, the last token) of a declaration whose opening word is known and whose head has been read up to k."""
        if self.language.ends:
            word = next((x for x in (opener, *range(k, min(k + 60, len(self.tokens)))) if x in self.end_of), None)
            head = next((x for x in range(k, len(self.tokens)) if self.new_line(x) or self.text(x) in ("do", ";")), len(self.tokens))
            return head, self.end_of[word] if word is not None else head - 1
        while k < len(self.tokens) and self.text(k) not in ("{", ";", "}"):
            if self.text(k) == "=" or (self.new_line(k) and self.name in ("kotlin", "scala", "swift") and self.text(k) not in (":", "->", "where")):
                last = self.line_end(k) if self.text(k) == "=" else k - 1
                return (k, last)
            k = self.after(k)
        return (k, self.tokens[k].close) if self.text(k) == "{" else (k, k if self.text(k) == ";" else k - 1)

    def _type(self, first: int, i: int) -> int:
        lang, at = self.language, i + 1
        k = self.angles(at) if self.text(i) == "impl" else at
        name = self.text(k)
        k = self.angles(k + 1)
        while self.text(k) in ("::", ".") and self.word(k + 1):
            name, k = f"{name}{self.text(k)}{self.text(k + 1)}", self.angles(k + 2)
        if self.text(i) == "impl" and self.text(k) == "for":
            name, k = self.text(k + 1), self.angles(k + 2)
        if self.text(k) == "(":  # a constructor's parameters, or a tuple
            k = self.after(k)
        extends, implements = "", []
        if self.text(k) in lang.extends and (self.word(k + 1) or self.text(k + 1) in ("::",)):
            n = k + 1
            while self.text(n) in ("public", "private", "protected", "virtual"):
                n += 1
            m = n
            while self.word(m) or self.text(m) in (".", "::"):
                m += 1
                if self.text(m) in ("implements", "with", "permits") or self.new_line(m):
                    break
            extends, k = self.said(n, m), self.angles(m)
        while k < len(self.tokens) and self.text(k) in ("implements", "with", ","):
            n = k + 1
            while (self.word(n) and self.text(n) not in ("implements", "with")) or self.text(n) == ".":
                n += 1
            implements.append(self.said(k + 1, n))
            k = self.angles(n)
        head, last = self._close(i, k)
        if self.text(i) not in lang.scopes:
            kind = "struct" if self.text(i) == "struct" else "class"
            self.found.append(Found(name, kind, "", first, last, head, extends, [x for x in implements if x], self._public(first, i)))
        self.other(head if lang.ends else head + 1, last, name if self.text(i) != "namespace" and self.text(i) != "mod" else "")
        return last + 1

    def _public(self, first: int, i: int) -> bool:
        return not any(self.text(x) in ("private", "local", "defp") for x in range(first, i + 1))

    def _function(self, first: int, opener: int, at: int, owner: str) -> int:
        k = at + 1
        while self.text(k) in (".", "::", ":") and self.word(k + 1) and not self.new_line(k + 1):  # self.name, Owner::name
            k += 2
        name = self.text(k - 1)
        k = self.angles(k)
        k = self.after(k) if self.text(k) == "(" else k
        head, last = self._close(opener, k)
        self.found.append(Found(name, "method" if owner else "function", owner, first, last, head, exported=self._public(first, opener), body=head))
        return last + 1

    def _typed(self, first: int, at: int, owner: str) -> int:
        """A function that no word announces: name(...) followed by a block. The place behind it, or at where it is none."""
        k = self.after(at + 1)
        while k < len(self.tokens) and self.text(k) not in ("{", ";", "}", "="):
            if self.text(k) == "(" and self.text(k - 1) not in ("noexcept", "throw") and not self.word(k - 1):
                return at
            k = self.after(k + 1) if self.text(k) == ":" and self.text(k + 2) == "{" else self.after(k)
        if self.text(k) != "{":
            return at
        qualified = self.text(at - 1) == "::" and self.word(at - 2)
        parent = owner or (self.text(at - 2) if qualified else "")
        self.found.append(Found(self.text(at), "method" if parent else "function", parent, first, self.tokens[k].close, k, exported=self._public(first, at), body=k))
        return self.tokens[k].close + 1

    # -- what a declaration says -----------------------------------------------------------------------

    def calls(self, f: Found) -> list[dict]:
        """name, qualifier and line of the calls in a function's body."""
        out = []
        for i in range(max(f.body, 0), f.last + 1) if f.body >= 0 else ():
            named = self.word(i) and self.text(i + 1) == "(" and (self.text(i) not in NOT_NAMES or self.text(i - 1) in (".", "?.", "->", "::"))
            if not named or self.text(i - 1) in ("func", "function", "fn", "def"):
                continue
            k = i
            while self.text(k - 1) in (".", "::", "?.", "->") and self.word(k - 2):
                k -= 2
            out.append({"name": self.text(i), "qualifier": self.said(k, i - 1) if k < i else "", "line": self.tokens[k].line})
        return out

    def comment(self, f: Found) -> str:
        """The comments right above, without an empty line between."""
        start = self.tokens[f.first].start
        start = self.code.rfind("\n", 0, start) + 1 if not self.code[self.code.rfind("\n", 0, start) + 1 : start].strip() else start
        out: list[str] = []
        for c in reversed(self.comments):
            if c.end > start:
                continue
            own_line = not self.code[self.code.rfind("\n", 0, c.start) + 1 : c.start].strip()
            alone = c.text.startswith("/*") or (out and out[-1].startswith("/*"))
            if self.code[c.end : start].strip() or self.code.count("\n", c.end, start) > 1 or not own_line or (out and alone):
                break
            out.append(c.text)
            start = c.start
        return "\n".join(reversed(out))

    def imports(self) -> list[str]:
        quoted = lambda i: self.text(i)[1:-1]
        out, i = [], 0
        while i < len(self.tokens):
            if self.name == "go" and self.text(i) == "import":
                last = self.tokens[i + 1].close if self.text(i + 1) == "(" else self.line_end(i)
                out += [quoted(x) for x in range(i, min(last + 1, len(self.tokens))) if self.tokens[x].kind == "text"]
                i = last + 1
                continue
            if self.name == "typescript" and self.tokens[i].kind == "text" and self.text(i)[:1] in "\"'" and (self.text(i - 1) in ("from", "import") or (self.text(i - 1) == "(" and self.text(i - 2) in ("require", "import"))):
                out.append(quoted(i))
            i += 1
        return out

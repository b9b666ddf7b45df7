"""Items and calls of Rust sources: a tokenizer and a recursive-descent parser over declarations and expressions.

``parse(text, rel_path)`` gives symbols in source order and calls as (number of the calling symbol, callee text).  Not
looked into for calls: macro arguments, unsafe and async blocks, struct literals, casts, ranges, break values, and items
inside bodies.  Spans are byte offsets.  A text that doesn't parse gives None.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(r"""
  (?P<ws>\s+|//[^\n]*)
 |(?P<open>/\*)
 |(?P<str>(?:b|c)?"(?:[^"\\]|\\.)*"|(?:b|c)?r(?P<h>\#*)".*?"(?P=h)(?!\#)|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.))')
 |(?P<life>'[A-Za-z_]\w*)
 |(?P<num>\d[\d_]*(?:\.(?![.A-Za-z_])[\d_]*)?(?:[eE][+-]?[\d_]+)?\w*)
 |(?P<id>(?:r\#)?[^\W\d]\w*)
 |(?P<p>::|->|=>|\.\.=|\.\.\.|\.\.|&&|\|\||==|!=|<=|\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<=|<<|[-+*/%^!&|=<>@.,;:\#$?~(){}\[\]\\])
""", re.X | re.S)
_COMMENT = re.compile(r"/\*|\*/")
_OPENERS = {"(": ")", "[": "]", "{": "}"}
_ITEMS = frozenset("fn mod struct enum trait impl const static type use extern macro_rules union".split())
HANDLERS = frozenset("get post put delete patch head options trace connect route routes debug_handler endpoint".split())
FRAMEWORKS = ("axum", "actix_web", "rocket", "warp", "tide", "poem", "salvo")
EXTRACTORS = frozenset("Path Query State Json Form Header TypedHeader Extension Request Bytes Cookie Payload Multipart ConnectInfo OriginalUri".split())


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


class Symbol(NamedTuple):
    name: str
    qual: str
    kind: str
    start: int
    end: int
    name_start: int
    name_end: int
    entry_reason: str | None


class Unparsable(ValueError):
    pass


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    if text.startswith("#!") and not text.startswith("#!["):
        at = text.find("\n") if "\n" in text else len(text)
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Unparsable(f"no token at {at}")
        kind = m.lastgroup if m.lastgroup != "h" else "str"
        at = m.end()
        if kind == "open":
            depth = 1
            while depth:
                c = _COMMENT.search(text, at)
                if not c:
                    raise Unparsable("a comment doesn't end")
                depth += 1 if c[0] == "/*" else -1
                at = c.end()
        elif kind != "ws":
            out.append(Token(kind, m[0], m.start(), m.end()))
    return out


def module_of(rel_path: str) -> str:
    """Module path of a file: without src/ and .rs; mod, lib and main are their folder."""
    p = rel_path.removesuffix(".rs").removeprefix("src/").replace("/", "::")
    head, _, last = p.rpartition("::")
    return head if last in ("mod", "lib", "main") else p


def qualified(modules: list[str], name: str) -> str:
    """Modules and name joined; an empty root module leaves its separator before nested ones."""
    joined = "".join(("::" if i else "") + m for i, m in enumerate(modules) if m)
    return f"{joined}::{name}" if joined else name


def entry_reason(name: str, attrs: list[str], types: list[str]) -> str | None:
    """Why a function is an entry point: its name, a handler attribute, or the first parameter that is an extractor."""
    if name == "main":
        return "fn main"
    for a in attrs:
        if a.rpartition("::")[2] in HANDLERS:
            return f"handler attribute #[{a}]"
    for t in types:
        hit = next((f for f in FRAMEWORKS if f in t), None)
        if hit:
            return f"extractor parameter `{t}` ({hit})"
        if re.split(r"[< &(]", t, maxsplit=1)[0].rpartition("::")[2] in EXTRACTORS:
            return f"extractor parameter `{t}`"
    return None


class Parser:
    def __init__(self, text: str, rel_path: str):
        self.t, self.i = tokenize(text), 0
        self.modules, self.symbols, self.calls = [module_of(rel_path)], [], []
        self.bytes = None if text.isascii() else [0, *(_running(len(c.encode()) for c in text))]

    # -- tokens
    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k].text if self.i + k < len(self.t) and self.t[self.i + k].kind != "str" else "" if self.i + k >= len(self.t) else '"'

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k].kind if self.i + k < len(self.t) else ""

    def next(self) -> Token:
        if self.i >= len(self.t):
            raise Unparsable("the text ends early")
        self.i += 1
        return self.t[self.i - 1]

    def eat(self, text: str) -> bool:
        if self.peek() == text:
            self.i += 1
            return True
        return False

    def want(self, text: str) -> Token:
        if self.peek() != text:
            raise Unparsable(f"{text!r} expected, {self.peek()!r} found")
        return self.next()

    def group(self) -> Token:
        """Skip a bracketed group; its closing token."""
        first = self.next()
        close, depth = [_OPENERS[first.text]], 1
        while depth:
            tok = self.next()
            if tok.kind == "p" and tok.text in _OPENERS:
                close.append(_OPENERS[tok.text])
                depth += 1
            elif tok.kind == "p" and tok.text in ")]}":
                if close.pop() != tok.text:
                    raise Unparsable("brackets don't match")
                depth -= 1
        return self.t[self.i - 1]

    def at(self, pos: int) -> int:
        return self.bytes[pos] if self.bytes else pos

    def add(self, name: Token | str, kind: str, start: int, end: int, name_span: tuple[int, int] | None = None, qual: str | None = None, reason: str | None = None) -> int:
        text = name if isinstance(name, str) else name.text
        a, b = name_span or (name.start, name.end)
        self.symbols.append(Symbol(text, qualified(self.modules, qual or text), kind, self.at(start), self.at(end), self.at(a), self.at(b), reason))
        return len(self.symbols) - 1

    # -- items
    def attributes(self) -> list[str]:
        out = []
        while self.peek() == "#":
            self.next()
            self.eat("!")
            if self.peek() != "[":
                raise Unparsable("an attribute lacks its bracket")
            self.next()
            out.append(self.simple_path())
            depth = 1
            while depth:
                x = self.next()
                if x.kind == "p":
                    depth += (x.text == "[") - (x.text == "]")
        return out

    def simple_path(self) -> str:
        parts = []
        self.eat("::")
        while self.kind() == "id":
            parts.append(self.next().text)
            if not self.eat("::"):
                break
        return "::".join(parts)

    def items(self, until: str) -> None:
        while self.peek() != until:
            if self.i >= len(self.t):
                raise Unparsable(f"{until!r} is missing")
            self.item()

    def modifiers(self) -> None:
        while True:
            if self.peek() == "pub":
                self.next()
                if self.peek() == "(":
                    self.group()
            elif self.peek() in ("default", "async", "unsafe", "safe") and self.kind(1) == "id" or self.peek() == "const" and self.peek(1) in ("fn", "unsafe", "async", "extern") or self.peek() == "extern" and self.peek(1) in ("fn", '"') and (self.peek(1) == "fn" or self.peek(2) == "fn"):
                self.next()
                if self.kind() == "str":
                    self.next()
            else:
                return

    def item(self) -> None:
        attrs = self.attributes()
        self.modifiers()
        word = self.peek()
        if word == "fn":
            self.function(attrs, None)
        elif word == "mod":
            kw, name = self.next(), self.next()
            if self.eat(";"):
                self.add(name, "Mod", kw.start, kw.end)
                return
            at = self.add(name, "Mod", kw.start, kw.end)
            self.want("{")
            self.modules.append(name.text)
            self.attributes() if self.peek() == "#" and self.peek(1) == "!" else None
            self.items("}")
            self.modules.pop()
            self.symbols[at] = self.symbols[at]._replace(end=self.at(self.next().end))
        elif word == "struct":
            self.structure()
        elif word == "enum":
            self.enumeration()
        elif word in ("trait", "impl"):
            self.block_item(word)
        elif word in ("const", "static"):
            kw = self.next()
            self.eat("mut")
            name = self.next()
            self.add(name, word.capitalize(), kw.start, name.end)
            self.to_semicolon()
        elif word == "type":
            kw, name = self.next(), self.next()
            self.add(name, "TypeAlias", kw.start, name.end)
            self.to_semicolon()
        elif word in ("use", "extern") and self.peek(1) != "{" and not (self.kind(1) == "str" and self.peek(2) == "{"):
            self.to_semicolon()
        elif word == "extern":
            self.next()
            if self.kind() == "str":
                self.next()
            self.group()
        elif word == "union" and self.kind(1) == "id":
            while self.peek() != "{":
                self.next()
            self.group()
        elif self.kind() == "id" and self.peek(1) in ("!", "::"):  # a macro
            self.simple_path()
            self.want("!")
            if self.kind() == "id":
                self.next()
            brace = self.peek() == "{"
            self.group()
            if not brace:
                self.eat(";")
        elif not self.eat(";"):
            raise Unparsable(f"no item starts with {word!r}")

    def to_semicolon(self) -> None:
        while self.peek() != ";":
            if self.kind() == "p" and self.peek() in _OPENERS:
                self.group()
            else:
                self.next()
        self.next()

    def generics(self) -> None:
        if self.peek() != "<":
            return
        depth = 0
        while True:
            x = self.next()
            if x.kind == "p":
                if x.text in _OPENERS:
                    self.i -= 1
                    self.group()
                else:
                    depth += {"<": 1, "<<": 2, ">": -1}.get(x.text, 0)
            if depth <= 0:
                return

    def where(self) -> None:
        if self.peek() == "where":
            while self.peek() not in ("{", ";"):
                if self.peek() in ("(", "["):
                    self.group()
                elif self.peek() == "<":
                    self.generics()
                else:
                    self.next()

    def function(self, attrs: list[str], self_type: str | None) -> None:
        kw, name = self.next(), self.next()
        self.generics()
        types = self.parameters(self_type)
        if self.eat("->"):
            self.type_()
        self.where()
        at = self.add(name, "Fn", kw.start, kw.end, reason=entry_reason(name.text, attrs, types))
        if self.eat(";"):
            return
        out: list[str] = []
        end = self.block(out)
        self.symbols[at] = self.symbols[at]._replace(end=self.at(end))
        self.calls += [(at, c) for c in out]

    def parameters(self, self_type: str | None) -> list[str]:
        self.want("(")
        types = []
        while not self.eat(")"):
            self.attributes()
            k = 0
            while self.peek(k) in ("&", "mut") or self.kind(k) == "life":
                k += 1
            if self.peek(k) == "self":
                self.i += k + 1
                if self.eat(":"):
                    self.type_()
                if self_type is not None:
                    types.append(f"self:{self_type}")
            elif self.eat("..."):
                pass
            else:
                self.pattern((":",))
                self.want(":")
                types.append(self.type_())
            if not self.eat(","):
                self.want(")")
                break
        return types

    def pattern(self, stop: tuple[str, ...]) -> None:
        while self.peek() not in stop:
            if self.i >= len(self.t):
                raise Unparsable("a pattern doesn't end")
            if self.kind() == "p" and self.peek() in _OPENERS:
                self.group()
            elif self.peek() == "<":
                self.generics()
            else:
                self.next()

    def structure(self) -> None:
        kw, name = self.next(), self.next()
        self.generics()
        at = self.add(name, "Struct", kw.start, name.end)
        self.where()
        if self.peek() == "(":
            self.symbols[at] = self.symbols[at]._replace(end=self.at(self.group().end))
            self.where()
            self.want(";")
        elif self.peek() == "{":
            self.symbols[at] = self.symbols[at]._replace(end=self.at(self.fields(True)))
        else:
            self.want(";")

    def fields(self, named: bool) -> int:
        self.want("{")
        while self.peek() != "}":
            self.attributes()
            self.modifiers()
            name = self.next()
            self.want(":")
            self.type_()
            if named:
                self.add(name, "Field", name.start, name.end)
            self.eat(",")
        return self.next().end

    def enumeration(self) -> None:
        kw, name = self.next(), self.next()
        self.generics()
        self.where()
        at = self.add(name, "Enum", kw.start, kw.end)
        self.want("{")
        while self.peek() != "}":
            self.attributes()
            variant = self.next()
            end = variant.end
            if self.peek() == "(":
                end = self.group().end
            elif self.peek() == "{":
                end = self.group().end
            self.add(variant, "Variant", variant.start, end)
            if self.eat("="):
                self.pattern((",", "}"))
            self.eat(",")
        self.symbols[at] = self.symbols[at]._replace(end=self.at(self.next().end))

    def block_item(self, word: str) -> None:
        kw = self.next()
        self_type = None
        if word == "trait":
            name = self.next()
            at = self.add(name, "Trait", kw.start, kw.end)
            self.generics()
            while self.peek() not in ("{", ";", "where"):
                if self.peek() == "<":
                    self.generics()
                else:
                    self.next()
        else:
            self.generics()
            self.eat("const")
            self.eat("!")
            self_type = self.type_()
            if self.eat("for"):
                self_type = self.type_()
            at = self.add(self_type, "Impl", kw.start, kw.end, (kw.start, kw.end), f"<impl {self_type}>")
        self.where()
        self.want("{")
        while self.peek() != "}":
            attrs = self.attributes()
            self.modifiers()
            if self.peek() == "fn":
                self.function(attrs, self_type)
            elif self.peek() in ("const", "type"):
                self.to_semicolon()
            elif self.kind() == "id" and self.peek(1) in ("!", "::"):
                self.simple_path()
                self.want("!")
                self.group()
                self.eat(";")
            elif self.peek() != "}":
                raise Unparsable(f"no member starts with {self.peek()!r}")
        self.symbols[at] = self.symbols[at]._replace(end=self.at(self.next().end))

    # -- types
    def type_(self) -> str:
        tok = self.peek()
        if tok in ("&", "&&"):
            self.next()
            if self.kind() == "life":
                self.next()
            self.eat("mut")
            inner = self.type_()
            return ("&" if tok == "&" else "&&") + inner
        if tok == "*":
            self.next()
            self.next()  # const or mut
            return "*" + self.type_()
        if tok == "(":
            self.next()
            parts, tuple_ = [], False
            while not self.eat(")"):
                parts.append(self.type_())
                tuple_ |= self.eat(",")
            return parts[0] if len(parts) == 1 and not tuple_ else f"({', '.join(parts)})"
        if tok == "[":
            self.next()
            inner = self.type_()
            self.pattern(("]",))
            self.next()
            return f"[{inner}]"
        if tok in ("impl", "dyn") or self.kind() == "life" or tok == "?":
            self.bounds()
            return "_"
        if tok in ("fn", "unsafe", "extern", "for"):
            while self.peek() != "(":
                self.generics() if self.peek() == "<" else self.next()
            self.group()
            if self.eat("->"):
                self.type_()
            return "_"
        if tok in ("!", "_"):
            self.next()
            return "_"
        if tok == "<":
            self.generics()
            self.want("::")
            return self.type_path()
        text = self.type_path()
        if self.peek() == "!":
            self.next()
            self.group()
            return "_"
        if self.peek() == "+" and self.kind(1) in ("id", "life"):
            self.bounds()
        return text

    def bounds(self) -> None:
        while True:
            if self.peek() in ("impl", "dyn", "?", "+", "~", "const"):
                self.next()
            elif self.kind() == "life":
                self.next()
            elif self.peek() == "for":
                self.next()
                self.generics()
            elif self.peek() == "(":
                self.group()
            elif self.kind() == "id" and self.peek() not in ("where", "as"):
                self.type_path()
            else:
                return
            if self.peek() != "+" and self.kind() != "id" and self.kind() != "life" and self.peek() not in ("?", "("):
                return

    def type_path(self) -> str:
        out = ""
        self.eat("::")
        while True:
            if self.kind() != "id":
                raise Unparsable(f"a type can't hold {self.peek()!r}")
            out += self.next().text
            if self.peek() == "::" and self.peek(1) == "<":
                self.next()
            if self.peek() == "<":
                args = self.type_args()
                if args:
                    out += f"<{', '.join(args)}>"
            elif self.peek() == "(":
                self.group()
                if self.eat("->"):
                    self.type_()
            if not (self.peek() == "::" and self.kind(1) == "id"):
                return out
            self.next()
            out += "::"

    def type_args(self) -> list[str]:
        self.want("<")
        args = []
        while not self.eat(">"):
            if self.kind() == "life":
                self.next()
            elif self.kind() in ("num", "str") or self.peek() in ("true", "false", "-"):
                self.eat("-")
                self.next()
            elif self.peek() == "{":
                self.group()
            elif self.kind() == "id" and self.peek(1) == "=":
                args.append(self.next().text)
                self.next()
                self.type_()
            elif self.kind() == "id" and self.peek(1) == ":":
                self.i += 2
                self.bounds()
            else:
                args.append(self.type_())
            if not self.eat(","):
                self.want(">")
                break
        return args

    # -- bodies: every function adds the calls it sees to ``out``, or to a list that is thrown away
    def block(self, out: list[str]) -> int:
        self.want("{")
        while self.peek() != "}":
            self.statement(out)
        return self.next().end

    def statement(self, out: list[str]) -> None:
        if self.eat(";"):
            return
        self.attributes()
        word = self.peek()
        if word == "let":
            self.next()
            self.pattern(("=", ";", ":"))
            if self.eat(":"):
                self.type_()
            if self.eat("="):
                self.expr(out)
                if self.eat("else"):
                    self.block(out)
            self.want(";")
            return
        ahead = self.peek(1)
        if word in ("fn", "mod", "struct", "enum", "trait", "impl", "static", "type", "use", "pub") or word == "const" and ahead != "{" or word == "extern" or word in ("unsafe", "async") and ahead in ("fn", "impl", "trait", "extern", "unsafe") or word == "macro_rules" and ahead == "!" or word == "union" and self.kind(1) == "id":
            kept = len(self.symbols), len(self.calls)
            self.item()
            del self.symbols[kept[0] :], self.calls[kept[1] :]
            return
        if self.kind() == "life" and ahead == ":":
            word, ahead = self.peek(2), self.peek(3)
        blocklike = word in ("if", "match", "loop", "while", "for", "{") or word in ("unsafe", "async", "const") and (ahead == "{" or ahead == "move")
        if blocklike:
            self.prefix(out, True)
            if self.peek() in (".", "?"):
                self.postfix(out, "", len(out), True)
                self.binary(out, 0, True, started=True)
            self.eat(";")
            return
        self.expr(out)
        if not self.eat(";") and self.peek() != "}":
            if self.t[self.i - 1].text == "}":  # a macro in braces
                return
            raise Unparsable(f"a statement ends at {self.peek()!r}")

    def expr(self, out: list[str], struct: bool = True) -> None:
        self.binary(out, 0, struct)

    _LEVELS = [("=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="), ("..", "..="), ("||",), ("&&",), ("==", "!=", "<", ">", "<=", ">="), ("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "%")]

    def operator(self) -> tuple[str, int]:
        """The binary operator here and its number of tokens: greater-than signs and equals are joined if they touch."""
        text, n = self.peek(), 1
        if self.kind() != "p":
            return ("as", 1) if text == "as" else ("", 0)
        if text == ">":
            while n < 3 and self.peek(n) in (">", "=", "==") and self.t[self.i + n].start == self.t[self.i + n - 1].end and not text.endswith("="):
                text += self.peek(n)
                n += 1
        return text, n

    def binary(self, out: list[str], level: int, struct: bool, started: bool = False) -> None:
        if level == len(self._LEVELS):
            self.cast(out, struct, started)
            return
        mark = len(out)
        if level == 1 and self.peek() in ("..", "..=") and not started:  # a range is not looked into
            self.next()
            if self.starts(struct):
                self.binary([], level + 1, struct)
            return
        self.binary(out, level + 1, struct, started)
        while True:
            op, n = self.operator()
            if op not in self._LEVELS[level]:
                return
            self.i += n
            if level == 1:
                del out[mark:]
                if self.starts(struct):
                    self.binary([], level + 1, struct)
                return
            self.binary(out, level if level == 0 else level + 1, struct)
            if level == 0:
                return

    def starts(self, struct: bool) -> bool:
        return self.kind() in ("id", "num", "str", "life") and self.peek() not in ("else", "as") or self.peek() in ("(", "[", "-", "*", "!", "&", "&&", "|", "||", "<", "::") or struct and self.peek() == "{"

    def cast(self, out: list[str], struct: bool, started: bool) -> None:
        mark = len(out)
        if not started:
            self.unary(out, struct)
        while self.peek() == "as":  # nor is what is cast
            self.next()
            self.type_()
            del out[mark:]

    def unary(self, out: list[str], struct: bool) -> None:
        if self.peek() in ("-", "*", "!"):
            self.next()
            self.unary(out, struct)
        elif self.peek() in ("&", "&&"):
            self.next()
            if self.peek() == "raw" and self.peek(1) in ("const", "mut"):
                self.i += 2
            self.eat("mut")
            self.unary(out, struct)
        else:
            self.prefix(out, struct)

    def prefix(self, out: list[str], struct: bool) -> None:
        """An expression from its first token through its postfix operators."""
        mark = len(out)
        self.attributes()
        if self.kind() == "life" and self.peek(1) == ":":
            self.i += 2
        word, path = self.peek(), ""
        if self.kind() in ("num", "str"):
            self.next()
        elif word == "(" or word == "[":
            close = _OPENERS[self.next().text]
            while not self.eat(close):
                self.expr(out)
                if not (self.eat(",") or self.eat(";")):
                    self.want(close)
                    break
        elif word == "{":
            self.block(out)
            return
        elif word in ("unsafe", "async", "const", "try") and self.peek(1) in ("{", "move") and (self.peek(1) == "{" or self.peek(2) == "{"):
            self.next()
            self.eat("move")
            self.block([])
        elif word == "if":
            self.next()
            self.expr(out, False)
            self.block(out)
            if self.eat("else"):
                self.prefix(out, struct) if self.peek() == "if" else self.block(out)
            return
        elif word == "match":
            self.next()
            self.expr(out, False)
            self.want("{")
            while not self.eat("}"):
                self.attributes()
                self.pattern(("=>", "if"))
                if self.eat("if"):
                    self.expr(out)
                self.want("=>")
                self.expr(out) if self.peek() != "{" else self.arm(out)
                self.eat(",")
            return
        elif word in ("loop", "while", "for"):
            self.next()
            if word == "while":
                self.expr(out, False)
            elif word == "for":
                self.pattern(("in",))
                self.next()
                self.expr(out, False)
            self.block(out)
            return
        elif word == "let":
            self.next()
            self.pattern(("=",))
            self.next()
            self.binary(out, 4, False)
            return
        elif word in ("return", "yield", "break", "continue"):
            self.next()
            if self.kind() == "life":
                self.next()
            if word != "continue" and self.starts(struct):
                self.expr(out if word == "return" else [], struct)
            return
        elif word in ("|", "||", "move", "static", "async", "for"):
            while self.peek() not in ("|", "||"):
                self.next()
            if self.next().text == "|":
                self.pattern(("|",)) if self.peek() != "|" else None
                self.want("|")
            if self.eat("->"):
                self.type_()
                self.block(out)
            else:
                self.expr(out, struct)
            return
        elif self.kind() == "id" or word in ("::", "<"):
            if word == "<":
                self.generics()
            parts = []
            self.eat("::")
            while self.kind() == "id":
                parts.append(self.next().text)
                if self.peek() == "::" and self.peek(1) == "<":
                    self.next()
                    self.generics()
                if not self.eat("::"):
                    break
            path = "::".join(parts)
            if self.peek() == "!" and self.peek(1) in _OPENERS:
                self.next()
                self.group()
                path = ""
            elif self.peek() == "{" and struct and self.struct_literal():
                self.group()
                path = ""
        else:
            raise Unparsable(f"no expression starts with {word!r}")
        self.postfix(out, path, mark, struct)

    def arm(self, out: list[str]) -> None:
        self.block(out)
        if self.peek() in (".", "?"):
            self.postfix(out, "", len(out), True)
            self.binary(out, 0, True, started=True)

    def struct_literal(self) -> bool:
        return self.peek(1) == "}" or self.peek(1) == ".." or self.kind(1) in ("id", "num") and self.peek(2) in (":", ",", "}") or self.peek(1) == "#"

    def postfix(self, out: list[str], path: str, mark: int, struct: bool) -> None:
        while True:
            word = self.peek()
            if word == "?":
                self.next()
            elif word == "(":
                out.append(path or "_")
                if not path:
                    del out[mark:-1]  # the function itself is not looked into
                self.arguments(out)
            elif word == "[":
                self.next()
                self.expr(out)
                self.want("]")
            elif word == ".":
                self.next()
                name = self.next().text
                if self.peek() == "::" and self.peek(1) == "<":
                    self.next()
                    self.generics()
                if self.peek() == "(" and name != "await" and not name[0].isdigit():
                    out.append(name)
                    self.arguments(out)
            else:
                return
            path = ""

    def arguments(self, out: list[str]) -> None:
        self.want("(")
        while not self.eat(")"):
            self.expr(out)
            if not self.eat(","):
                self.want(")")
                break


def _running(sizes):
    total = 0
    for n in sizes:
        total += n
        yield total


def parse(text: str, rel_path: str) -> tuple[list[Symbol], list[tuple[int, str]]] | None:
    try:
        p = Parser(text, rel_path)
        while p.peek() == "#" and p.peek(1) == "!":
            p.attributes()
        while p.i < len(p.t):
            p.item()
        return p.symbols, p.calls
    except (Unparsable, RecursionError, IndexError):
        return None

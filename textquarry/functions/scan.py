"""Declarations of one source text: a pass over its tokens with a stack of open scopes.

Every token is looked at once, and a scope is left when its bracket closes, so the time is linear
in the text. Strings, comments, template literals, regular expressions and JSX text are tokens or
scopes of their own: what they hold declares nothing, except code within ``${...}`` and ``{...}``.
All offsets are bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Span:
    start: int
    own: int  # where the declaration itself begins, without `export`, `const` or decorators
    kind: str
    node_type: str
    name: str | None
    parent: str | None
    end: int = -1
    indent: int = 0


# ---- Python ------------------------------------------------------------------

PYTHON_TOKEN = re.compile(
    rb'(?P<skip>[ \t\r\f]+|\#[^\n]*|\\\r?\n)'
    rb'|(?P<string>"""[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*(?:"""|\Z)' + rb"|'''[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*(?:'''|\Z)"
    rb'|"[^"\\\n]*(?:\\.[^"\\\n]*)*"?' + rb"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'?)"
    rb"|(?P<line>\n[ \t]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<word>[A-Za-z_\x80-\xff][\w\x80-\xff]*)|(?P<other>.)",
    re.S,
)


def python_spans(data: bytes) -> list[Span]:
    """A declaration ends with the last token before a line that is indented no deeper."""
    found: list[Span] = []
    around: list[Span] = []
    depth = last_end = 0
    line_start, fresh = 0, True  # where the line begins; whether its first token is still to come
    indent, decorated, header = 0, -1, None
    first = re.match(rb"[ \t]*", data)
    indent = first.end() if first else 0
    for token in PYTHON_TOKEN.finditer(data):
        kind, at = token.lastgroup, token.start()
        if kind == "skip":
            continue
        if kind == "line":
            if depth == 0:
                indent, fresh = token.end() - at - 1, True
            continue
        word = token.group() if kind == "word" else b""
        if fresh and depth == 0:
            while around and around[-1].indent >= indent:
                around.pop().end = last_end
            fresh, line_start, header = False, at, word in (b"async", b"def", b"class")
            if token.group() == b"@":
                decorated = at if decorated < 0 else decorated
            elif not header:
                decorated = -1
        if header and word and word not in (b"async", b"def", b"class"):
            inner = around[-1] if around else None
            label = "class" if keyword == b"class" else "method" if inner and inner.kind == "class" else "function"
            node = "class_definition" if keyword == b"class" else "function_definition"
            start = decorated if decorated >= 0 else line_start
            span = Span(start, line_start, label, node, word.decode(errors="replace"), inner.name if inner else None, indent=indent)
            found.append(span)
            around.append(span)
            header, decorated = None, -1
        elif header and word in (b"def", b"class"):
            keyword = word
        elif header and word != b"async":
            header = None
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(depth - 1, 0)
        last_end = token.end()
    for span in around:
        span.end = last_end
    return found


# ---- the JavaScript family ---------------------------------------------------

SCRIPT_TOKEN = re.compile(
    rb"(?P<skip>[ \t\r\f]+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<line>\n)"
    rb'|(?P<string>"[^"\\\n]*(?:\\.[^"\\\n]*)*"?' + rb"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'?)"
    rb"|(?P<word>[A-Za-z_$#\x80-\xff][\w$\x80-\xff]*)|(?P<number>\d[\w.]*)|(?P<at>@[\w$.]+)"
    rb"|(?P<mark>=>|&&|\|\||\?\?|\?\.|\.\.\.|[=!]==?|[-+]{2}|.)",
    re.S,
)
TEMPLATE_TOKEN = re.compile(rb"[^`\\$]+|\\.|\$\{|\$|`|\\", re.S)
TAG_TOKEN = re.compile(rb"""[^"'{/>]+|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|/>|.""", re.S)
TEXT_TOKEN = re.compile(rb"[^<{]+|</[^>]*(?:>|\Z)|.", re.S)
REGEX = re.compile(rb"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
JSX_OPEN = re.compile(rb"<(?:>|[A-Za-z_$][\w$.:-]*(?=[\s/>])(?!\s+extends\b))")
NAME = re.compile(rb"[A-Za-z_$#\x80-\xff]")
OPENS = {b"(": b")", b"[": b"]", b"{": b"}"}
CLOSES = {b")", b"]", b"}"}
# Words before a declaration that belong to it.
LEADS = frozenset(b"export default declare abstract async public private protected static override readonly get set accessor".split())
BINDERS = frozenset((b"const", b"let", b"var"))
NODES = {
    b"class": ("class", "class_declaration"), b"interface": ("class", "interface_declaration"), b"enum": ("class", "enum_declaration"),
    b"function": ("function", "function_declaration"), b"type": ("function", "type_alias_declaration"),
}
CLASS_NODES = frozenset(("class_declaration", "abstract_class_declaration", "class"))
STATEMENTS = frozenset(b"const let var function class export import return if for while switch try throw do break continue interface enum type".split())
# After these a value follows: a slash begins a pattern there, an angle a tag, and a line break ends nothing.
BEFORE_VALUE = frozenset(
    b"( , = => [ { ; ? : ! && || ?? ... == === != !== + - * / % & | ^ ~ < > return typeof case in of new delete throw else do await yield extends".split()
)
AFTER_VALUE = frozenset(b", . ?. = => ? : && || ?? == === != !== + - * / % & | ^ < > ) ] } { ( [ `".split()) | frozenset((b"in", b"of", b"instanceof", b"as", b"satisfies", b"extends", b"implements"))


@dataclass
class _Scope:
    mark: bytes = b""  # the open bracket, or ` for a template, <tag and <text for JSX
    body: Span | None = None  # the declaration that ends with the scope
    lead: int = -1
    decorator: bool = False
    pending: Span | None = None  # a header that waits for its body
    binding: _Binding | None = None
    member: tuple[bytes, int] | None = None  # the word that may name a method or field of a class
    open: list[Span] = field(default_factory=list)  # values that end with their expression


@dataclass
class _Binding:
    name: bytes | None
    start: int
    many: bool = False
    first: Span | None = None
    value: int = -1  # where the value begins
    fits: bool = False  # whether the value may still be a function
    angles: int = 0  # open angles in the type of the name


class _Script:
    def __init__(self, data: bytes, jsx: bool, types: bool):
        self.data, self.jsx, self.types = data, jsx, types
        self.found: list[Span] = []
        self.stack = [_Scope()]
        self.before, self.last_end, self.fresh = b";", 0, False

    def around(self) -> Span | None:
        for scope in reversed(self.stack):
            if scope.open:
                return scope.open[-1]
            if scope.body:
                return scope.body
        return None

    def declare(self, kind: str, node: str, name: bytes | None, start: int, own: int) -> Span:
        around = self.around()
        if kind == "function" and around is not None and around.node_type in CLASS_NODES and node != "type_alias_declaration":
            kind = "method"
        return Span(start, own, kind, node, name.decode(errors="replace") if name else None, around.name if around else None)

    def end_values(self, scope: _Scope) -> None:
        for span in scope.open:
            span.end = self.last_end
        scope.open.clear()

    def end_statement(self, scope: _Scope) -> None:
        self.end_values(scope)
        scope.pending = scope.binding = scope.member = None
        scope.lead = -1

    def close(self, mark: bytes, end: int) -> None:
        if not any(OPENS.get(s.mark) == mark for s in self.stack[1:]):
            return
        while True:
            scope = self.stack.pop()
            self.end_values(scope)
            fits = OPENS.get(scope.mark) == mark
            if scope.body is not None:
                scope.body.end = end if fits else self.last_end
            if fits:
                break
        outer = self.stack[-1]
        if scope.decorator:
            outer.lead = scope.lead
        elif scope.body is not None and outer.binding is None:
            self.last_end = end
            self.end_statement(outer)

    def run(self) -> list[Span]:
        at, size = 0, len(self.data)
        while at < size:
            mark = self.stack[-1].mark
            at = self.template(at) if mark == b"`" else self.tag(at) if mark == b"<tag" else self.text(at) if mark == b"<text" else self.code(at)
        while self.stack:
            scope = self.stack.pop()
            self.end_values(scope)
            if scope.body is not None:
                scope.body.end = self.last_end
        return self.found

    def template(self, at: int) -> int:
        token = TEMPLATE_TOKEN.match(self.data, at)
        if token.group() == b"${":
            self.stack.append(_Scope(b"{"))
            self.before = b"{"
        elif token.group() == b"`":
            self.stack.pop()
            self.before = b")"
        self.last_end = token.end()
        return token.end()

    def tag(self, at: int) -> int:
        token = TAG_TOKEN.match(self.data, at)
        if token.group() == b"{":
            self.stack.append(_Scope(b"{"))
            self.before = b"{"
        elif token.group() == b"/>":
            self.stack.pop()
            self.before = b")"
        elif token.group() == b">":
            self.stack[-1] = _Scope(b"<text")
        self.last_end = token.end()
        return token.end()

    def text(self, at: int) -> int:
        opened = JSX_OPEN.match(self.data, at)
        if opened:
            self.stack.append(_Scope(b"<text" if opened.group() == b"<>" else b"<tag"))
            self.last_end = opened.end()
            return opened.end()
        token = TEXT_TOKEN.match(self.data, at)
        if token.group() == b"{":
            self.stack.append(_Scope(b"{"))
            self.before = b"{"
        elif token.group().startswith(b"</"):
            self.stack.pop()
            self.before = b")"
        self.last_end = token.end()
        return token.end()

    def code(self, at: int) -> int:
        token = SCRIPT_TOKEN.match(self.data, at)
        kind, word = token.lastgroup, token.group()
        if kind == "skip":
            return token.end()
        if kind == "line":
            self.fresh = True
            return token.end()
        scope = self.stack[-1]
        if self.fresh:
            in_class = scope.mark == b"{" and scope.body is not None and scope.body.node_type in CLASS_NODES
            ends = self.before not in BEFORE_VALUE and (word not in AFTER_VALUE or (in_class and word in (b"*", b"[")))
            if scope.mark in (b"", b"{") and ends and scope.lead < 0:
                self.end_statement(scope)
                self.before = b";"
            self.fresh = False
        if scope.pending is not None and self.before == b"=>" and word != b"{":
            # An arrow function whose body is an expression ends with it.
            self.found.append(scope.pending)
            scope.open.append(scope.pending)
            scope.pending = None
        if word == b"/" and self.before in BEFORE_VALUE:
            pattern = REGEX.match(self.data, at)
            if pattern:
                self.before, self.last_end = b")", pattern.end()
                return pattern.end()
        if self.jsx and word == b"<" and self.before in BEFORE_VALUE:
            opened = JSX_OPEN.match(self.data, at)
            if opened:
                self.stack.append(_Scope(b"<text" if opened.group() == b"<>" else b"<tag"))
                self.last_end = opened.end()
                return opened.end()
        if kind == "word" and self.before not in (b".", b"?."):
            self.word(scope, word, at)
        elif kind == "at":
            scope.lead = at if scope.lead < 0 else scope.lead
        elif kind == "mark":
            self.mark(scope, word, at, token.end())
        elif scope.binding is not None and scope.binding.fits and kind != "word":
            scope.binding.fits = False
        self.before = b"@" if kind == "at" else b"x" if kind in ("word", "string", "number") and word not in BEFORE_VALUE and word not in LEADS else word
        if kind == "word" and (word in LEADS or word in BINDERS):
            self.before = b"lead"
        self.last_end = max(self.last_end, token.end())
        return token.end()

    def word(self, scope: _Scope, word: bytes, at: int) -> None:
        binding, body = scope.binding, scope.body
        in_class = body is not None and body.node_type in CLASS_NODES and scope.mark == b"{"
        if word in BINDERS and not in_class:
            scope.binding = _Binding(None, scope.lead if scope.lead >= 0 else at)
            scope.member = None
            if word == b"const" and re.match(rb"\s+enum\b", self.data[at + 5 : at + 40]):
                scope.binding, scope.lead = None, scope.lead if scope.lead >= 0 else at
            return
        if binding is not None and binding.value >= 0 and binding.fits and word == b"async":
            return
        if binding is not None and binding.value < 0 and binding.name is None and self.before != b":":
            binding.name = word
            return
        header = NODES.get(word)
        if header and not (word in (b"interface", b"enum", b"type") and (not self.types or not re.match(rb"\s+[A-Za-z_$]", self.data[at + len(word) : at + len(word) + 40]) or self.before == b"x")):
            named = re.compile(rb"[\s*]*([A-Za-z_$\x80-\xff][\w$\x80-\xff]*)?").match(self.data, at + len(word))
            name = named.group(1) if named.group(1) not in (b"extends", b"implements") else None
            if word in (b"function", b"class") and binding is not None and binding.value >= 0 and binding.fits:
                node = "function_expression" if word == b"function" else "class"
                self.bind(scope, "class" if word == b"class" else "function", node, at, name)
                return
            if in_class and self.before not in (b"=",):
                scope.member = (word, scope.lead if scope.lead >= 0 else at)
                return
            if name is None and scope.lead < 0:
                return  # a value without a name
            node = header[1]
            start = scope.lead if scope.lead >= 0 else at
            if word == b"class" and b"abstract" in self.data[start:at].split():
                node = "abstract_class_declaration"
            if word == b"function" and b"*" in named.group():
                node = "generator_function_declaration"
            if word in (b"function", b"class") and scope.lead < 0 and self.before in BEFORE_VALUE and self.before not in (b";", b"{", b"else", b"do"):
                node = "function_expression" if word == b"function" else "class"
            scope.pending = self.declare(header[0], node, name, start, at)
            scope.lead = -1
            return
        if word in LEADS:
            scope.lead = at if scope.lead < 0 else scope.lead
            scope.member = (word, scope.lead) if in_class else None  # also the name of a method
            return
        if in_class and scope.pending is None and self.before in (b";", b"{", b"}", b"x", b"lead", b"@", b"*", b")", b"]") and (binding is None or binding.value < 0):
            scope.member = (word, scope.lead if scope.lead >= 0 else at)
        elif not in_class and binding is None and scope.pending is None and self.before in (b";", b"{", b"}", b"x", b")", b"lead"):
            scope.member = (word, at)
        if binding is not None and binding.value >= 0 and binding.fits and self.before not in (b"=", b":", b"lead", b"<", b",", b"|", b"&", b">"):
            binding.fits = False
        if scope.pending is None:
            scope.lead = -1

    def bind(self, scope: _Scope, kind: str, node: str, own: int, name: bytes | None = None) -> None:
        """A function or class bound to a name: it begins with the statement unless that binds several."""
        binding = scope.binding
        span = self.declare(kind, node, name or binding.name, own if binding.many else binding.start, own)
        if not binding.many and binding.first is None:
            binding.first = span
        binding.fits = False
        scope.pending = span
        scope.lead = -1

    def mark(self, scope: _Scope, word: bytes, at: int, end: int) -> None:
        binding = scope.binding
        in_class = scope.body is not None and scope.body.node_type in CLASS_NODES and scope.mark == b"{"
        if binding is not None and binding.value < 0 and word in (b"<", b">"):
            binding.angles = max(0, binding.angles + (1 if word == b"<" else -1))
        if word == b"`":
            self.stack.append(_Scope(b"`"))
        elif word == b"=>":
            if binding is not None and binding.value >= 0 and binding.fits:
                self.bind(scope, "function", "arrow_function", binding.value)
        elif word == b"=":
            if binding is not None and binding.value < 0 and (binding.name is not None or self.before == b"}"):
                binding.value, binding.fits = _after_blank(self.data, end), bool(binding.name)
            elif scope.pending is not None and scope.pending.node_type == "type_alias_declaration":
                self.found.append(scope.pending)
                scope.open.append(scope.pending)
                scope.pending = None
            elif scope.member is not None and binding is None and scope.pending is None:
                name, start = scope.member
                scope.binding = _Binding(name, start, value=_after_blank(self.data, end), fits=True)
                scope.member, scope.lead = None, -1
        elif word == b".":
            if scope.member is not None and not in_class:
                rest = re.compile(rb"[\w$]+").match(self.data, end)
                scope.member = (rest.group(), scope.member[1]) if rest else None
            if binding is not None:
                binding.fits = False
        elif word in OPENS:
            if word == b"(" and in_class and scope.member is not None and scope.pending is None and binding is None:
                name, start = scope.member
                if name not in STATEMENTS or name == b"type":
                    scope.pending = self.declare("method", "method_definition", name, start, start)
                    scope.lead = -1
                scope.member = None
            if not in_class:
                scope.member = None
            inner = _Scope(word)
            if word == b"(" and self.before == b"@":
                inner.decorator, inner.lead = True, scope.lead
            if word == b"{" and scope.pending is not None and self.before not in (b":", b"|", b"&", b"<", b","):
                inner.body, scope.pending = scope.pending, None
                self.found.append(inner.body)
                if scope.binding is None:
                    scope.lead = -1
            if binding is not None and binding.value >= 0 and binding.fits and word != b"(" and self.before != b":":
                binding.fits = False
            if binding is not None and binding.value < 0 and binding.name is None and word != b"(":
                binding.name = b""  # a pattern
                binding.fits = False
            self.stack.append(inner)
        elif word in CLOSES:
            self.close(word, end)
        elif word == b";":
            self.end_statement(scope)
        elif word == b",":
            self.end_values(scope)
            if binding is not None and binding.angles > 0:
                return  # within the type of a name
            if binding is not None and scope.pending is None:
                if binding.first is not None:
                    binding.first.start = binding.first.own
                scope.binding = _Binding(None, binding.start, many=True)
            if scope.mark not in (b"", b"{"):
                scope.binding = None
        elif word not in (b":", b"<", b">", b"*", b"|", b"&", b"?", b"!") or (word == b"?" and binding is not None and binding.value >= 0):
            if binding is not None:
                binding.fits = False
            scope.member = None

def _after_blank(data: bytes, at: int) -> int:
    return re.compile(rb"\s*").match(data, at).end()


def script_spans(data: bytes, jsx: bool = True, types: bool = True) -> list[Span]:
    return _Script(data, jsx, types).run()


# ---- rules for documents -----------------------------------------------------


@dataclass(frozen=True)
class SpanRule:
    """Blocks of a document, found by a pattern over its bytes.

    With ``sections`` a match begins a block that runs to the next match of no greater level (group
    ``level``, its digit or its length); otherwise the match itself is the block. Group ``name``
    names it, and what lies in a named block has it as parent. Matches within ``ignore`` do not count.
    """

    pattern: bytes
    kind: str
    node_type: str
    sections: bool = False
    ignore: bytes | None = None


MARKDOWN = (
    SpanRule(rb"(?m)^(?P<level>#{1,6})[ \t]+(?P<name>[^\n]*?)[ \t#]*$", "section", "heading", True, rb"(?ms)^(```|~~~).*?(?:^\1|\Z)"),
)
HTML = (
    SpanRule(rb"(?is)<h(?P<level>[1-6])\b[^>]*>(?P<name>.*?)</h(?P=level)\s*>", "section", "heading", True, rb"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"),
    SpanRule(rb"(?is)<p\b[^>]*>.*?</p\s*>", "block", "paragraph", False, rb"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"),
)


def _matches(rule: SpanRule, data: bytes) -> Iterator[re.Match]:
    hidden = [m.span() for m in re.finditer(rule.ignore, data)] if rule.ignore else []
    k = 0
    for found in re.finditer(rule.pattern, data):
        while k < len(hidden) and hidden[k][1] <= found.start():
            k += 1
        if k == len(hidden) or found.start() < hidden[k][0]:
            yield found


def rule_spans(data: bytes, rules: tuple[SpanRule, ...]) -> list[Span]:
    sections: list[Span] = []
    blocks: list[Span] = []
    for rule in rules:
        for found in _matches(rule, data):
            named = found.groupdict()
            name = re.sub(rb"<[^>]*>", b"", named["name"]).decode(errors="replace").strip() if "name" in named else None
            span = Span(found.start(), found.start(), rule.kind, rule.node_type, name, None, found.end())
            if rule.sections:
                span.indent = int(named["level"]) if named["level"].isdigit() else len(named["level"])
                sections.append(span)
            else:
                blocks.append(span)
    sections.sort(key=lambda s: s.start)
    around: list[Span] = []
    for span in sections:
        while around and around[-1].indent >= span.indent:
            around.pop().end = span.start
        span.parent = around[-1].name if around else None
        around.append(span)
    for span in around:
        span.end = len(data)
    around, k = [], 0
    for span in sorted(blocks, key=lambda s: s.start):
        while k < len(sections) and sections[k].start <= span.start:
            around.append(sections[k])
            k += 1
        while around and around[-1].end <= span.start:
            around.pop()
        span.parent = around[-1].name if around else None
    return sections + blocks


def find_spans(content: str | None, language: str | None, rules: dict[str, tuple[SpanRule, ...]]) -> list[Span]:
    """All declarations or blocks, in order; none for other languages."""
    if not content:
        return []
    data = content.encode()
    if language in rules:
        spans = rule_spans(data, rules[language])
    elif language == "python":
        spans = python_spans(data)
    elif language in ("javascript", "jsx", "typescript", "tsx"):
        spans = script_spans(data, jsx=language != "typescript", types=language in ("typescript", "tsx"))
    else:
        return []
    return sorted((s for s in spans if s.end > s.start), key=lambda s: (s.start, s.end))

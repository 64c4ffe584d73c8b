"""A tolerant Java reader: tokens, then a syntax tree with preorder intervals.

It knows the constructs that the analysis looks at and skips over what it can't read, one member or statement at a
time; it never raises on bad syntax. A tree becomes rows in which `node_id BETWEEN a.node_id AND a.end_id` tests descent.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

_TOKEN = re.compile(
    r'(?P<space>\s+|//[^\n]*|/\*.*?\*/|/\*.*\Z)|(?P<block>"""(?:\\.|[^\\])*?""")|(?P<string>"(?:\\.|[^"\\\n])*"?)|(?P<char>\'(?:\\.|[^\'\\\n])*\'?)'
    r"|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>->|::|\+\+|--|&&|\|\||[=!<>+\-*/&|^%]=|<<=|\.\.\.|.)",
    re.S,
)
_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed non".split())
_PRIMITIVE = frozenset("byte short int long float double boolean char void var".split())
_TYPES = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration"}
_BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
_ASSIGN = frozenset("= += -= *= /= &= |= ^= %= <<=".split())


class Node:
    __slots__ = ("kind", "start", "end", "children", "field", "parent", "source")

    def __init__(self, kind: str, start: int, source: Source):
        self.kind, self.start, self.end, self.source = kind, start, start, source
        self.children: list[Node] = []
        self.field: str | None = None
        self.parent: Node | None = None

    def add(self, child: Node | None, field: str | None = None) -> Node | None:
        if child is not None:
            child.field, child.parent = field, self
            self.children.append(child)
        return child

    def get(self, field: str) -> Node | None:
        return next((c for c in self.children if c.field == field), None)

    @property
    def text(self) -> str:
        return self.source.text[self.start : self.end]

    @property
    def line(self) -> int:
        return self.source.line(self.start)

    def walk(self, into=lambda n: True) -> Iterator[Node]:
        """This node and its descendants in preorder, without recursion; into() says whose children are visited."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if into(node):
                stack.extend(reversed(node.children))

    def of(self, *kinds: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.kind in kinds)

    def above(self, *kinds: str) -> Node | None:
        node = self.parent
        while node is not None and node.kind not in kinds:
            node = node.parent
        return node


class Source:
    def __init__(self, text: str):
        self.text = text
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        from bisect import bisect_left

        return bisect_left(self.breaks, at) + 1


class Parser:
    def __init__(self, text: str):
        self.source = Source(text)
        self.tokens = [(m.lastgroup, m[0], m.start()) for m in _TOKEN.finditer(text) if m.lastgroup != "space"]
        self.tokens.append(("end", "", len(text)))
        self.at = 0

    # tokens
    def peek(self, ahead: int = 0) -> str:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][1]

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][0]

    def place(self) -> int:
        return self.tokens[self.at][2]

    def next(self) -> str:
        text = self.tokens[self.at][1]
        if self.at < len(self.tokens) - 1:
            self.at += 1
        return text

    def take(self, text: str) -> bool:
        if self.peek() == text and self.kind() != "end":
            self.next()
            return True
        return False

    def begin(self, kind: str) -> Node:
        return Node(kind, self.place(), self.source)

    def done(self, node: Node) -> Node:
        kind, text, at = self.tokens[self.at - 1] if self.at else ("", "", 0)
        node.end = max(node.start, at + len(text))
        return node

    def leaf(self, kind: str) -> Node:
        node = self.begin(kind)
        self.next()
        return self.done(node)

    def skip_balanced(self) -> None:
        """Past the bracket that closes the one at hand."""
        depth = 0
        while self.kind() != "end":
            t = self.next()
            depth += t in ("(", "[", "{")
            depth -= t in (")", "]", "}")
            if depth <= 0:
                return

    # types
    def skip_type(self) -> bool:
        """Past a type, if there is one here."""
        start = self.at
        while self.peek() == "@":
            self.annotation(None)
        if self.kind() != "name":
            self.at = start
            return False
        self.next()
        while True:
            if self.peek() == "<" and not self.skip_angles():
                self.at = start
                return False
            if self.peek() == "." and self.kind(1) == "name":
                self.next()
                self.next()
                continue
            break
        while self.peek() == "[" and self.peek(1) == "]":
            self.next()
            self.next()
        self.take("...")
        return True

    def skip_angles(self) -> bool:
        depth = 0
        while True:
            t, kind = self.peek(), self.kind()
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
            elif not (kind == "name" or t in (",", ".", "?", "&", "[", "]", "@")):
                return False
            self.next()
            if not depth:
                return True

    def type(self) -> Node | None:
        node = self.begin("type")
        return self.done(node) if self.skip_type() else None

    def annotation(self, into: Node | None) -> None:
        node = self.begin("annotation")
        self.next()
        while self.kind() == "name":
            self.next()
            if not self.take("."):
                break
        if self.peek() == "(":
            if into is not None:
                node.add(self.arguments(), "arguments")
            else:
                self.skip_balanced()
        if into is not None:
            into.add(self.done(node))

    def modifiers(self, into: Node) -> None:
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                self.annotation(into)
            elif self.peek() in _MODIFIERS and not (self.peek() == "default" and self.peek(1) in (":", "->")):
                self.next()
                if self.peek() == "-":  # non-sealed
                    self.next()
            else:
                return

    # declarations
    def unit(self) -> Node:
        root = self.begin("program")
        while self.kind() != "end":
            before = self.at
            if self.peek() in ("package", "import"):
                while self.kind() != "end" and not self.take(";"):
                    self.next()
            else:
                root.add(self.member())
            if self.at == before:
                self.next()
        return self.done(root)

    def member(self) -> Node | None:
        start, node = self.at, self.begin("member")
        try:
            self.modifiers(node)
            t = self.peek()
            if t == "@" and self.peek(1) == "interface":
                self.next()
                t = self.peek()
            if t in _TYPES and self.kind(1) == "name" and not (t == "record" and self.peek(2) not in ("(", "<")):
                return self.type_declaration(node)
            if t == "{":
                node.kind = "initializer"
                node.add(self.block(), "body")
                return self.done(node)
            if t == ";":
                self.next()
                return None
            if t == "<":
                self.skip_angles()
            if self.kind() == "name" and self.peek(1) in ("(", "{"):
                node.kind = "constructor_declaration"
            else:
                if node.add(self.type(), "type") is None:
                    raise SyntaxError
                node.kind = "method_declaration" if self.kind() == "name" and self.peek(1) == "(" else "field_declaration"
            if node.kind == "field_declaration":
                self.declarators(node)
                self.take(";")
                return self.done(node)
            node.add(self.leaf("identifier"), "name")
            if self.peek() == "(":
                node.add(self.parameters(), "parameters")
            while self.kind() != "end" and self.peek() not in ("{", ";"):
                self.next()
            if self.peek() == "{":
                node.add(self.block(), "body")
            else:
                self.take(";")
            return self.done(node)
        except (SyntaxError, RecursionError):
            self.at = start
            broken = self.begin("ERROR")
            while self.kind() != "end" and self.peek() != "}":
                if self.peek() == "{":
                    self.skip_balanced()
                    break
                if self.next() == ";":
                    break
            return self.done(broken)

    def type_declaration(self, node: Node) -> Node:
        node.kind = _TYPES[self.next()]
        node.add(self.leaf("identifier"), "name")
        if self.peek() == "<":
            self.skip_angles()
        if self.peek() == "(":
            node.add(self.parameters(), "parameters")
        while self.kind() != "end" and self.peek() not in ("{", ";"):
            word = self.next()
            if word in ("extends", "implements", "permits"):
                listed = self.begin("super_interfaces" if word == "implements" or (word == "extends" and node.kind == "interface_declaration") else "supers")
                while (one := self.type()) is not None:
                    one.kind = "type_identifier"
                    listed.add(one)
                    if not self.take(","):
                        break
                node.add(self.done(listed), "interfaces")
        body = self.begin("class_body")
        if self.take("{"):
            if node.kind == "enum_declaration":
                while self.kind() == "name" or self.peek() in (",", "@"):
                    self.next()
                    if self.peek() in ("(", "{"):
                        self.skip_balanced()
                self.take(";")
            while self.kind() != "end" and self.peek() != "}":
                before = self.at
                body.add(self.member())
                if self.at == before:
                    self.next()
            self.take("}")
        node.add(self.done(body), "body")
        return self.done(node)

    def parameters(self) -> Node:
        node = self.begin("formal_parameters")
        self.next()
        while self.kind() != "end" and self.peek() != ")":
            one = self.begin("formal_parameter")
            self.modifiers(one)
            if one.add(self.type(), "type") is None or self.kind() != "name":
                while self.kind() != "end" and self.peek() not in (",", ")"):
                    self.next()
            else:
                one.add(self.leaf("identifier"), "name")
                while self.take("["):
                    self.take("]")
                node.add(self.done(one))
            self.take(",")
        self.take(")")
        return self.done(node)

    def declarators(self, into: Node) -> None:
        while self.kind() == "name":
            one = self.begin("variable_declarator")
            one.add(self.leaf("identifier"), "name")
            while self.take("["):
                self.take("]")
            if self.take("="):
                one.add(self.array() if self.peek() == "{" else self.expression(), "value")
            into.add(self.done(one))
            if not self.take(","):
                return

    # statements
    def block(self) -> Node:
        node = self.begin("block")
        self.next()
        while self.kind() != "end" and self.peek() != "}":
            before = self.at
            node.add(self.statement())
            if self.at == before:
                self.next()
        self.take("}")
        return self.done(node)

    def parenthesized(self, node: Node, field: str = "condition") -> None:
        if self.take("("):
            node.add(self.expression(), field)
            self.take(")")

    def declares(self) -> bool:
        """Whether a local variable declaration begins here."""
        start = self.at
        try:
            while self.peek() == "final" or self.peek() == "@":
                self.annotation(None) if self.peek() == "@" else self.next()
            return self.skip_type() and self.kind() == "name" and self.peek(1) in ("=", ";", ",", ":", "[")
        finally:
            self.at = start

    def statement(self) -> Node | None:
        t = self.peek()
        if t == "{":
            return self.block()
        if t == ";":
            self.next()
            return None
        node = self.begin("statement")
        if t in ("if", "while", "switch", "synchronized") and self.peek(1) == "(":
            node.kind = f"{self.next()}_statement"
            self.parenthesized(node)
            if t == "switch":
                node.add(self.switch_body(), "body")
            else:
                node.add(self.statement(), "body")
                if t == "if" and self.take("else"):
                    node.add(self.statement(), "alternative")
            return self.done(node)
        if t == "do":
            self.next()
            node.add(self.statement(), "body")
            if self.take("while"):
                self.parenthesized(node)
            self.take(";")
            return self.done(node)
        if t == "for":
            self.next()
            self.take("(")
            if self.declares():
                declared = self.begin("local_variable_declaration")
                self.modifiers(declared)
                declared.add(self.type(), "type")
                if self.peek(1) == ":":
                    node.kind = "enhanced_for_statement"
                    node.add(declared.children[-1], "type")
                    node.add(self.leaf("identifier"), "name")
                    self.next()
                    node.add(self.expression(), "value")
                else:
                    node.kind = "for_statement"
                    self.declarators(declared)
                    node.add(self.done(declared), "init")
            while self.kind() != "end" and self.peek() != ")":
                before = self.at
                if self.peek() not in (";", ","):
                    node.add(self.expression())
                else:
                    self.next()
                if self.at == before:
                    self.next()
            self.take(")")
            node.add(self.statement(), "body")
            return self.done(node)
        if t == "try":
            node.kind = "try_statement"
            self.next()
            if self.take("("):
                while self.kind() != "end" and self.peek() != ")":
                    before = self.at
                    node.add(self.declaration() if self.declares() else self.expression())
                    self.take(";")
                    if self.at == before:
                        self.next()
                self.take(")")
            if self.peek() == "{":
                node.add(self.block(), "body")
            while self.peek() in ("catch", "finally"):
                if self.next() == "catch" and self.peek() == "(":
                    self.skip_balanced()
                if self.peek() == "{":
                    node.add(self.block())
            return self.done(node)
        if t in ("return", "throw", "yield", "assert") and self.peek(1) not in ("=", ".", "("[: t != "yield"]):
            node.kind = f"{self.next()}_statement"
            while self.kind() != "end" and self.peek() not in (";", "}"):
                before = self.at
                node.add(self.expression(), "value")
                self.take(":")
                if self.at == before:
                    self.next()
            self.take(";")
            return self.done(node)
        if t in ("return", "throw"):
            node.kind = f"{self.next()}_statement"
            node.add(self.expression(), "value")
            self.take(";")
            return self.done(node)
        if t in ("break", "continue"):
            while self.kind() != "end" and self.peek() not in (";", "}"):
                self.next()
            self.take(";")
            return self.done(node)
        if self.kind() == "name" and self.peek(1) == ":" and self.peek(2) != ":":
            self.next()
            self.next()
            return self.statement()
        ahead = 0
        while self.peek(ahead) in _MODIFIERS:
            ahead += 1
        if self.peek(ahead) in _TYPES and self.kind(ahead + 1) == "name" and self.peek(ahead + 2) in ("{", "(", "<", "extends", "implements"):
            return self.member()
        if self.declares():
            node = self.declaration()
            self.take(";")
            return self.done(node)
        node.kind = "expression_statement"
        node.add(self.expression())
        self.take(";")
        return self.done(node)

    def declaration(self) -> Node:
        node = self.begin("local_variable_declaration")
        self.modifiers(node)
        node.add(self.type(), "type")
        self.declarators(node)
        return self.done(node)

    def switch_body(self) -> Node:
        node = self.begin("switch_block")
        if not self.take("{"):
            return self.done(node)
        while self.kind() != "end" and self.peek() != "}":
            before = self.at
            if self.peek() in ("case", "default"):
                while self.kind() != "end" and self.peek() not in (":", "->", "{", "}"):
                    self.next()
                self.next()
            else:
                node.add(self.statement())
            if self.at == before:
                self.next()
        self.take("}")
        return self.done(node)

    # expressions
    def wrap(self, kind: str, first: Node) -> Node:
        return Node(kind, first.start, self.source)

    def expression(self) -> Node | None:
        left = self.ternary()
        if left is not None and self.peek() in _ASSIGN:
            node = self.wrap("assignment_expression", left)
            node.add(left, "left")
            self.next()
            node.add(self.array() if self.peek() == "{" else self.expression(), "right")
            return self.done(node)
        return left

    def ternary(self) -> Node | None:
        test = self.binary(1)
        if test is None or self.peek() != "?":
            return test
        node = self.wrap("ternary_expression", test)
        node.add(test, "condition")
        self.next()
        node.add(self.expression(), "consequence")
        self.take(":")
        node.add(self.lambda_or(self.ternary), "alternative")
        return self.done(node)

    def lambda_or(self, other) -> Node | None:
        return self.unary() if self.is_lambda() else other()

    def binary(self, least: int) -> Node | None:
        left = self.unary()
        while left is not None and (power := self.power()) >= least:
            op = self.next()
            if op in ("<", ">"):  # shifts come as single signs
                while self.peek() in (">", "<", ">="):
                    self.next()
            node = self.wrap("binary_expression" if op != "instanceof" else "instanceof_expression", left)
            node.add(left, "left")
            if op == "instanceof":
                self.take("final")
                self.skip_type()
                if self.kind() == "name":
                    self.next()
            else:
                node.add(self.binary(power + 1), "right")
            left = self.done(node)
        return left

    def power(self) -> int:
        return _BINARY.get(self.peek(), 0) if self.kind() in ("op", "name") else 0

    def is_lambda(self) -> bool:
        if self.kind() == "name" and self.peek(1) == "->":
            return True
        if self.peek() != "(":
            return False
        depth, i = 0, self.at
        while i < len(self.tokens) - 1:
            depth += self.tokens[i][1] == "("
            depth -= self.tokens[i][1] == ")"
            i += 1
            if not depth:
                return self.tokens[i][1] == "->"
        return False

    def is_cast(self) -> bool:
        start = self.at
        try:
            self.next()
            primitive = self.peek() in _PRIMITIVE
            if not self.skip_type():
                return False
            while self.take("&"):
                self.skip_type()
            if not self.take(")"):
                return False
            return self.kind() in ("name", "string", "char", "block", "number") and self.peek() != "instanceof" or self.peek() in ("(", "!", "~") or (primitive and self.peek() in ("-", "+"))
        finally:
            self.at = start

    def unary(self) -> Node | None:
        t = self.peek()
        if self.is_lambda():
            node = self.begin("lambda_expression")
            if t == "(":
                self.skip_balanced()
            else:
                self.next()
            self.take("->")
            node.add(self.block() if self.peek() == "{" else self.expression(), "body")
            return self.done(node)
        if t in ("!", "~", "-", "+", "++", "--") and self.kind() == "op":
            node = self.begin("unary_expression")
            self.next()
            node.add(self.unary(), "operand")
            return self.done(node)
        if t == "(" and self.is_cast():
            node = self.begin("cast_expression")
            self.next()
            while self.kind() != "end" and not self.take(")"):
                self.skip_type()
                self.take("&")
            node.add(self.unary(), "value")
            return self.done(node)
        return self.postfix(self.primary())

    def primary(self) -> Node | None:
        kind, t = self.kind(), self.peek()
        if kind == "string":
            return self.leaf("string_literal")
        if kind == "block":
            return self.leaf("text_block")
        if kind in ("char", "number"):
            return self.leaf("literal")
        if t == "(":
            node = self.begin("parenthesized_expression")
            self.next()
            node.add(self.expression())
            self.take(")")
            return self.done(node)
        if t == "new":
            return self.creation()
        if t == "switch":
            node = self.begin("switch_expression")
            self.next()
            self.parenthesized(node)
            node.add(self.switch_body(), "body")
            return self.done(node)
        if t in ("null", "true", "false"):
            return self.leaf("null_literal" if t == "null" else "literal")
        if t in ("this", "super"):
            node = self.leaf(t)
            if self.peek() == "(":
                call = self.wrap("explicit_constructor_invocation", node)
                call.add(self.arguments(), "arguments")
                return self.done(call)
            return node
        if kind == "name" and t not in ("case", "default", "else", "instanceof"):
            if self.peek(1) == "(":
                node = self.begin("method_invocation")
                node.add(self.leaf("identifier"), "name")
                node.add(self.arguments(), "arguments")
                return self.done(node)
            return self.leaf("identifier")
        return None

    def creation(self) -> Node:
        node = self.begin("object_creation_expression")
        self.next()
        made = self.begin("type")
        while self.peek() == "@":
            self.annotation(None)
        while self.kind() == "name":
            self.next()
            if self.peek() == "<":
                self.skip_angles()
            if not self.take("."):
                break
        node.add(self.done(made), "type")
        if self.peek() == "[":
            node.kind = "array_creation_expression"
            while self.take("["):
                if self.peek() != "]":
                    node.add(self.expression())
                self.take("]")
            if self.peek() == "{":
                node.add(self.array(), "value")
            return self.done(node)
        if self.peek() == "(":
            node.add(self.arguments(), "arguments")
        if self.peek() == "{":
            body = self.begin("class_body")
            self.next()
            while self.kind() != "end" and self.peek() != "}":
                before = self.at
                body.add(self.member())
                if self.at == before:
                    self.next()
            self.take("}")
            node.add(self.done(body), "body")
        return self.done(node)

    def array(self) -> Node:
        node = self.begin("array_initializer")
        self.next()
        while self.kind() != "end" and self.peek() != "}":
            before = self.at
            node.add(self.array() if self.peek() == "{" else self.expression())
            self.take(",")
            if self.at == before:
                self.next()
        self.take("}")
        return self.done(node)

    def arguments(self) -> Node:
        node = self.begin("argument_list")
        self.next()
        while self.kind() != "end" and self.peek() != ")":
            before = self.at
            node.add(self.array() if self.peek() == "{" else self.expression())
            if not self.take(",") and self.peek() != ")":
                if self.at == before or self.peek() in (";", "{", "}"):
                    break
        self.take(")")
        return self.done(node)

    def postfix(self, node: Node | None) -> Node | None:
        while node is not None:
            t = self.peek()
            if t == ".":
                self.next()
                if self.peek() == "<":
                    self.skip_angles()
                if self.peek() == "new":
                    made = self.wrap("object_creation_expression", node)
                    made.add(node, "object")
                    made.add(self.creation())
                    node = self.done(made)
                elif self.kind() == "name" and self.peek(1) == "(":
                    call = self.wrap("method_invocation", node)
                    call.add(node, "object")
                    call.add(self.leaf("identifier"), "name")
                    call.add(self.arguments(), "arguments")
                    node = self.done(call)
                elif self.kind() == "name":
                    access = self.wrap("field_access", node)
                    access.add(node, "object")
                    access.add(self.leaf("identifier"), "field")
                    node = self.done(access)
                else:
                    return node
            elif t == "[":
                access = self.wrap("array_access", node)
                access.add(node, "array")
                self.next()
                if self.peek() != "]":
                    access.add(self.expression(), "index")
                self.take("]")
                node = self.done(access)
            elif t == "::":
                self.next()
                self.next()
                ref = self.wrap("method_reference", node)
                ref.add(node)
                node = self.done(ref)
            elif t in ("++", "--"):
                step = self.wrap("update_expression", node)
                step.add(node)
                self.next()
                node = self.done(step)
            else:
                return node
        return node


def parse(text: str) -> Node:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8000))
    return Parser(text).unit()


def rows(file_path: str, root: Node) -> Iterator[tuple]:
    """(file_path, node_id, end_id, parent_id, depth, field, node_type, text, start_line, start_byte) in preorder."""
    ids: dict[int, int] = {}
    last: dict[int, int] = {}
    order = list(root.walk())
    depth: dict[int, int] = {}
    for i, n in enumerate(order):
        ids[id(n)] = last[id(n)] = i
        depth[id(n)] = depth[id(n.parent)] + 1 if n.parent is not None and id(n.parent) in depth else 0
    for n in reversed(order):
        if n.parent is not None and id(n.parent) in last:
            last[id(n.parent)] = max(last[id(n.parent)], last[id(n)])
    for n in order:
        parent = ids.get(id(n.parent)) if n.parent is not None else None
        yield file_path, ids[id(n)], last[id(n)], parent, depth[id(n)], n.field, n.kind, n.text, n.line, len(root.source.text[: n.start].encode())

"""A syntax checker for ECMAScript and TypeScript, with and without JSX.

Statements are parsed by recursive descent and expressions by precedence climbing. At an error the parser goes
into panic mode: it notes the error, skips to the next statement boundary and goes on, so that all errors of a
file are reported, the first of which is the cause to look at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .ecma_lexer import EOF, NAME, NUMBER, PRIVATE, PUNCT, REGEX, STRING, TEMPLATE, Lexer, SourceError

#: Reserved words of ECMAScript (fixed values).
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for"
    " function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
#: Binary operators and their precedence (fixed values); the power operator binds to the right.
BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8,
    ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
#: Names that are no plain operand, and what ends an expression after one.
_NO_OPERAND = RESERVED | {"async", "await", "yield"}
_ENDERS = frozenset(",);]}")
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
UNARY = frozenset("delete void typeof + - ~ !".split())
#: Words that begin a statement; panic mode stops at one that stands first in its line.
STARTERS = frozenset(
    "break class const continue debugger do export for function if import let return switch throw try var while"
    " async interface type enum declare namespace abstract".split()
)
MODIFIERS = frozenset("public private protected static readonly abstract override declare async accessor get set in out const".split())

# what an expression is, as far as the parser needs to know
VALUE, TARGET, PATTERN, ARROW, FURTHER = range(5)

#: What is noted where the interpreter's recursion limit, which the caller sets, ends; that is no verdict on the source.
TOO_DEEP = "nested too deeply"


@dataclass(frozen=True)
class Dialect:
    """What a file name extension allows."""

    typescript: bool
    jsx: bool
    goal: str  # module, script or either


#: By extension (fixed values).
DIALECTS = {
    "js": Dialect(False, False, "either"), "mjs": Dialect(False, False, "module"), "cjs": Dialect(False, False, "script"),
    "jsx": Dialect(False, True, "either"), "ts": Dialect(True, False, "either"), "mts": Dialect(True, False, "module"),
    "cts": Dialect(True, False, "script"), "tsx": Dialect(True, True, "either"),
}

_CONFLICT = re.compile(r"(?:<{7}(?: .*)?|={7}|>{7}(?: .*)?|\|{7}(?: .*)?)\r?$", re.M).match
_GENERIC_ARROW = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b)").match
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$-]*(?:\s*(?:[.:])\s*[A-Za-z_$][\w$-]*)*").match
_JSX_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*(?s:.*?)\*/)*").match
_JSX_TEXT = re.compile(r"[^{}<>]*").match
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'").match


class Parser(Lexer):
    """Parses one source; ``errors`` holds (offset, message) of everything that is wrong."""

    __slots__ = ("ts", "jsx", "goal", "errors", "trying", "depth", "in_function", "in_async", "in_generator", "no_in", "cover", "loops", "no_cond_types", "strict", "ambient")

    def __init__(self, src: str, dialect: Dialect):
        super().__init__(src)
        self.ts, self.jsx, self.goal = dialect.typescript, dialect.jsx, dialect.goal
        self.errors: list[tuple[int, str]] = []
        self.trying = 0  # speculative parses in progress, whose errors are not noted
        self.depth = 0
        self.in_function = False
        self.in_async = self.goal != "script"  # a module may await at its top level
        self.in_generator = False
        self.no_in = False
        self.cover = -1  # offset of a shorthand initialiser not yet known to be in a pattern
        self.loops = 0
        self.no_cond_types = False
        self.strict = self.goal == "module"
        self.ambient = False  # inside declare, where nothing is initialised

    # --- driver and panic mode -------------------------------------------------------------------------------

    def run(self) -> list[tuple[int, str]]:
        src = self.src
        if src.startswith("#!"):
            stop = re.search(r"[\n\r]|$", src)
            self.end = stop.start()
        self._advance_safely()
        self.statements("")
        self.errors.sort()
        return self.errors

    def _advance_safely(self) -> None:
        while True:
            try:
                self.next()
                return
            except SourceError as e:
                self.errors.append((e.at, e.message))

    def statements(self, closer: str) -> None:
        """Statements up to the closing token, which stays current."""
        while True:
            if self.kind == EOF or self.text == closer and self.kind == PUNCT:
                return
            before = self.start
            try:
                self.statement(True)
            except SourceError as e:
                if self.trying:
                    raise
                self.note(e)
                self.skip(before, closer)
            except RecursionError:
                if self.trying:
                    raise
                self.note(SourceError(self.start, TOO_DEEP))
                self.kind, self.text, self.start = EOF, "", len(self.src)
                self.end = self.start

    def note(self, e: SourceError) -> None:
        if not self.errors or self.errors[-1][0] != e.at:
            line = self.src.rfind("\n", 0, e.at) + 1
            self.errors.append((e.at, "merge conflict marker" if _CONFLICT(self.src, line) else e.message))

    def skip(self, before: int, closer: str) -> None:
        """Panic mode: go to the next statement boundary, past the failed statement's start."""
        if self.start == before and self.kind != EOF:
            self._advance_safely()
        while self.kind != EOF:
            t = self.text
            if self.kind == PUNCT:
                if t == ";":
                    self._advance_safely()
                    return
                if t == "}":
                    if closer != "}":
                        self._advance_safely()
                    return
            elif self.newline and t in STARTERS:
                return
            self._advance_safely()

    def fail(self, message: str | None = None) -> None:
        raise SourceError(self.start, message or ("unexpected end of file" if self.kind == EOF else f"unexpected {self.text!r}"))

    # --- token helpers ---------------------------------------------------------------------------------------

    def eat(self, text: str) -> bool:
        if self.text == text and self.kind != STRING:
            self.next()
            return True
        return False

    def need(self, text: str) -> None:
        if self.text != text or self.kind == STRING:
            self.fail(f"expected {text!r}" + (" before the end of file" if self.kind == EOF else f" but found {self.text!r}"))
        self.next()

    def semicolon(self) -> None:
        if self.text == ";" and self.kind == PUNCT:
            self.next()
        elif not (self.newline or self.kind == EOF or self.text == "}" and self.kind == PUNCT):
            self.fail(f"expected ';' but found {self.text!r}")

    def is_name(self) -> bool:
        """Whether the token can be an identifier."""
        if self.kind != NAME:
            return False
        t = self.text
        return t not in RESERVED and not (t == "yield" and (self.in_generator or self.strict))

    def name(self) -> str:
        if not self.is_name():
            self.fail(f"expected a name but found {self.text!r}" if self.kind != EOF else None)
        t = self.text
        self.next()
        return t

    def peek(self) -> tuple[int, str, bool]:
        """Kind, text and preceding line break of the next token."""
        state = self.save()
        try:
            self.next()
            return self.kind, self.text, self.newline
        except SourceError:
            return PUNCT, "", False
        finally:
            self.load(state)

    def attempt(self, parse) -> bool:
        """Run a parse; on an error go back and return False."""
        state, cover, depth = self.save(), self.cover, self.depth
        self.trying += 1
        try:
            parse()
            return True
        except SourceError:
            self.load(state)
            self.cover, self.depth = cover, depth
            return False
        finally:
            self.trying -= 1

    # --- statements ------------------------------------------------------------------------------------------

    def statement(self, declaration: bool = False) -> None:
        self.depth += 1
        try:
            kind, t = self.kind, self.text
            if kind == NAME:
                handler = _STATEMENTS.get(t)
                if handler is not None and handler(self, declaration):
                    return
            elif kind == PUNCT:
                if t == "{":
                    self.block()
                    return
                if t == ";":
                    self.next()
                    return
                if t == "@":
                    self.decorators()
                    if self.text == "export":
                        self.export_statement(declaration)
                        return
                    self.eat("abstract")
                    self.class_(True)
                    return
            self.expression_statement(declaration)
        finally:
            self.depth -= 1

    def expression_statement(self, declaration: bool) -> None:
        if self.kind == NAME:
            if self.text == "enum" and not self.ts or self.text in ("else", "catch", "finally", "case", "default", "extends"):
                self.fail()
            if self.is_name() and self.src[self.end : self.end + 1] in ": " and self.peek()[1] == ":":
                self.next()
                self.next()
                self.statement(False)
                return
        self.expression()
        self.semicolon()

    def block(self) -> None:
        self.need("{")
        self.statements("}")
        self.need("}")

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def _variables(self, declaration: bool, in_for: bool = False) -> bool:
        word = self.text
        if word == "let" or word == "using":
            kind, t, line = self.peek()
            if not (kind == NAME and t not in ("in", "instanceof", "of") or t in "[{" and kind == PUNCT and word == "let" and t):
                return False
            if word == "using" and (line or t in RESERVED):
                return False
        elif word == "const" and self.ts and self.peek()[1] == "enum":
            self.next()
            self.enum()
            return True
        if not declaration and word != "var" and not in_for:
            self.fail(f"{word} is not allowed here")
        self.next()
        self.variable_list(in_for, word)
        if not in_for:
            self.semicolon()
        return True

    def variable_list(self, in_for: bool = False, word: str = "var", ambient: bool = False) -> None:
        while True:
            pattern = self.text in ("[", "{") and self.kind == PUNCT
            self.binding()
            if self.ts:
                if self.text == "!" and not self.newline:
                    self.next()
                if self.text == ":":
                    self.next()
                    self.type()
            if self.text == "=" and self.kind == PUNCT:
                self.next()
                self.assignment()
            elif not in_for and not ambient and not self.ambient and (pattern or word == "const"):
                self.fail("missing initialiser")
            if self.text != "," or self.kind != PUNCT:
                return
            self.next()

    def binding(self) -> None:
        """A name or a destructuring pattern that declares names."""
        if self.kind == PUNCT:
            if self.text == "[":
                self.next()
                while not self.eat("]"):
                    if self.eat(","):
                        continue
                    rest = self.eat("...")
                    self.binding()
                    if not rest and self.eat("="):
                        self.assignment()
                    if self.text != "]":
                        self.need(",")
                return
            if self.text == "{":
                self.next()
                while not self.eat("}"):
                    if self.eat("..."):
                        self.binding()
                    else:
                        plain = self.is_name()
                        self.property_name()
                        if self.eat(":"):
                            self.binding()
                        elif not plain:
                            self.fail("expected ':'")
                        if self.eat("="):
                            self.assignment()
                    if self.text != "}":
                        self.need(",")
                return
        self.name()

    def _if(self, declaration: bool) -> bool:
        while True:  # a chain of else-if is no nesting
            self.next()
            self.paren()
            self.statement()
            if self.text != "else" or self.kind != NAME:
                return True
            self.next()
            if self.text != "if" or self.kind != NAME:
                self.statement()
                return True

    def _for(self, declaration: bool) -> bool:
        self.next()
        if self.text == "await":
            if not self.in_async:
                self.fail()
            self.next()
        self.need("(")
        outer, self.no_in = self.no_in, True
        if self.text == ";":
            self.next()
        else:
            declared = self.text in ("var", "const", "let", "using") and self._variables(True, True)
            if not declared:
                start = self.start
                shape = self.expression(True)
                if self.text in ("of", "in") and self.kind == NAME and shape not in (TARGET, PATTERN):
                    raise SourceError(start, "invalid loop target")
            if self.text in ("of", "in") and self.kind == NAME:
                self.cover = -1
                of = self.text == "of"
                self.next()
                self.no_in = outer
                self.assignment() if of else self.expression()
                self.need(")")
                self._loop_body()
                return True
            self._check_cover()
            self.need(";")
        self.no_in = outer
        if self.text != ";":
            self.expression()
        self.need(";")
        if self.text != ")":
            self.expression()
        self.need(")")
        self._loop_body()
        return True

    def _loop_body(self) -> None:
        self.loops += 1
        try:
            self.statement()
        finally:
            self.loops -= 1

    def _while(self, declaration: bool) -> bool:
        self.next()
        self.paren()
        self._loop_body()
        return True

    def _do(self, declaration: bool) -> bool:
        self.next()
        self._loop_body()
        self.need("while")
        self.paren()
        self.eat(";")
        return True

    def _jump(self, declaration: bool) -> bool:
        word, at = self.text, self.start
        self.next()
        if self.is_name() and not self.newline:
            self.next()
        elif not self.loops:
            raise SourceError(at, f"{word} outside of a loop")
        self.semicolon()
        return True

    def _return(self, declaration: bool) -> bool:
        if not self.in_function:
            self.fail("return outside of a function")
        self.next()
        if not (self.newline or self.kind == EOF or self.text in (";", "}") and self.kind == PUNCT):
            self.expression()
        self.semicolon()
        return True

    def _throw(self, declaration: bool) -> bool:
        self.next()
        if self.newline:
            self.fail("line break after throw")
        self.expression()
        self.semicolon()
        return True

    def _try(self, declaration: bool) -> bool:
        self.next()
        self.block()
        caught = self.text == "catch"
        if self.eat("catch"):
            if self.eat("("):
                self.binding()
                if self.ts and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.text == "finally":
            self.next()
            self.block()
        elif not caught:
            self.fail("expected catch or finally")
        return True

    def _switch(self, declaration: bool) -> bool:
        self.next()
        self.paren()
        self.need("{")
        self.loops += 1
        try:
            while not self.eat("}"):
                if self.eat("case"):
                    self.expression()
                else:
                    self.need("default")
                self.need(":")
                while not (self.kind == NAME and self.text in ("case", "default") or self.kind == PUNCT and self.text == "}"):
                    if self.kind == EOF:
                        self.fail()
                    self.statement(True)
        finally:
            self.loops -= 1
        return True

    def _with(self, declaration: bool) -> bool:
        if self.strict:
            self.fail("with is not allowed in modules")
        self.next()
        self.paren()
        self.statement()
        return True

    def _debugger(self, declaration: bool) -> bool:
        self.next()
        self.semicolon()
        return True

    def _function(self, declaration: bool) -> bool:
        self.function(True)
        return True

    def _async(self, declaration: bool) -> bool:
        kind, t, line = self.peek()
        if t == "function" and kind == NAME and not line:
            self.next()
            self.function(True, True)
            return True
        return False

    def _class(self, declaration: bool) -> bool:
        if not declaration:
            self.fail("a class is not allowed here")
        self.class_(True)
        return True

    # --- functions and classes -------------------------------------------------------------------------------

    def function(self, statement: bool, is_async: bool = False, optional_name: bool = False) -> None:
        """From the word function; a TypeScript declaration may have no body."""
        self.need("function")
        generator = self.eat("*")
        if self.text != "(" and self.text != "<":
            if statement:
                self.name()
            else:
                saved = self.in_generator
                self.in_generator = generator
                if self.kind == NAME and self.text not in RESERVED:
                    self.next()
                self.in_generator = saved
        elif statement and not optional_name:
            self.fail("expected a function name")
        self.signature(is_async, generator)
        if self.text == "{" and self.kind == PUNCT:
            self.body(is_async, generator)
        elif self.ts and statement:
            self.semicolon()
        else:
            self.need("{")

    def signature(self, is_async: bool = False, generator: bool = False) -> None:
        """Type parameters, parameters and return type."""
        if self.ts and self.text == "<":
            self.type_parameters()
        saved = self.in_async, self.in_generator, self.no_in
        self.in_async, self.in_generator, self.no_in = is_async, generator, False
        try:
            self.parameters()
        finally:
            self.in_async, self.in_generator, self.no_in = saved
        if self.ts and self.text == ":" and self.kind == PUNCT:
            self.next()
            self.return_type()

    def parameters(self) -> None:
        self.need("(")
        while not (self.text == ")" and self.kind == PUNCT):
            while self.text == "@" and self.kind == PUNCT:
                self.decorators()
            if self.ts and self.kind == NAME and self.text in ("public", "private", "protected", "readonly", "override"):
                while self.text in ("public", "private", "protected", "readonly", "override") and self.peek()[1] not in (",", ")", ":", "=", "?"):
                    self.next()
            rest = self.eat("...")
            if self.ts and self.text == "this" and self.kind == NAME:
                self.next()
            else:
                self.binding()
            if self.ts:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if self.text == "=" and self.kind == PUNCT and not rest:
                self.next()
                self.assignment()
            if self.text != ")":
                if rest and not self.ts:
                    self.fail("a rest parameter must be the last")
                self.need(",")
        self.next()

    def body(self, is_async: bool = False, generator: bool = False) -> None:
        saved = self.in_function, self.in_async, self.in_generator, self.no_in, self.loops, self.no_cond_types
        self.in_function, self.in_async, self.in_generator, self.no_in, self.loops, self.no_cond_types = True, is_async, generator, False, 0, False
        try:
            self.block()
        finally:
            self.in_function, self.in_async, self.in_generator, self.no_in, self.loops, self.no_cond_types = saved

    def decorators(self) -> None:
        while self.text == "@" and self.kind == PUNCT:
            self.next()
            if self.text == "(" and self.kind == PUNCT:
                self.paren()
            else:
                self.subscripts(self.primary(), decorator=True)

    def class_(self, statement: bool, optional_name: bool = False) -> None:
        self.need("class")
        if self.is_name() and self.text != "implements":
            self.next()
        elif statement and not optional_name:
            self.fail("expected a class name")
        if self.ts and self.text == "<":
            self.type_parameters()
        if self.eat("extends"):
            self.subscripts(self.primary(), heritage=True)
            if self.ts and self.text == "<":
                self.type_arguments()
        if self.ts and self.text == "implements" and self.kind == NAME:
            self.next()
            self.type_list()
        self.need("{")
        saved = self.in_function, self.loops, self.no_in, self.in_async, self.in_generator
        self.in_function, self.loops, self.no_in = False, 0, False
        try:
            while not (self.text == "}" and self.kind == PUNCT):
                if self.kind == EOF:
                    self.fail()
                if self.text == ";" and self.kind == PUNCT:
                    self.next()
                else:
                    self.member()
            self.next()
        finally:
            self.in_function, self.loops, self.no_in, self.in_async, self.in_generator = saved

    def member(self) -> None:
        """A field, method, accessor, index signature or static block."""
        if self.text == "@":
            self.decorators()
        is_async = False
        while self.kind == NAME and self.text in MODIFIERS:
            word = self.text
            if not self.ts and word not in ("static", "async", "accessor", "get", "set"):
                break
            kind, t, line = self.peek()
            if kind == PUNCT and t in ("(", "=", ";", "}", ":", "?", "!", "<", ","):
                break  # the word is the member's own name
            if kind == EOF or line and word not in ("static", "public", "private", "protected", "readonly", "abstract", "override"):
                break
            if word == "static" and t == "{" and kind == PUNCT:
                self.next()
                self.body()
                return
            self.next()
            is_async = is_async or word == "async"
            if word in ("get", "set"):
                break
        generator = self.eat("*")
        if self.ts and self.text == "[" and self.kind == PUNCT and self.attempt(self._index_head):
            self.type()
            self.need("]")
            if self.eat(":"):
                self.type()
            self._member_end()
            return
        self.property_name(True)
        if self.ts and self.kind == PUNCT and self.text in ("?", "!"):
            self.next()
        if self.kind == PUNCT and self.text in ("(", "<"):
            self.signature(is_async, generator)
            if self.text == "{" and self.kind == PUNCT:
                self.body(is_async, generator)
            elif self.ts:
                self._member_end()
            else:
                self.need("{")
            return
        if generator or is_async:
            self.need("(")
        if self.ts and self.eat(":"):
            self.type()
        if self.text == "=" and self.kind == PUNCT:
            self.next()
            saved = self.in_function, self.in_async
            self.in_async = False
            self.assignment()
            self.in_function, self.in_async = saved
        self._member_end()

    def _member_end(self) -> None:
        if self.text == ";" and self.kind == PUNCT:
            self.next()
        elif not (self.newline or self.text == "}" and self.kind == PUNCT):
            self.fail(f"expected ';' but found {self.text!r}" if self.kind != EOF else None)

    def _index_head(self) -> None:
        self.need("[")
        self.name()
        self.need(":")

    def property_name(self, private: bool = False) -> None:
        if self.kind in (NAME, STRING, NUMBER) or private and self.kind == PRIVATE:
            self.next()
        elif self.text == "[" and self.kind == PUNCT:
            self.next()
            saved, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = saved
            self.need("]")
        else:
            self.fail()

    # --- modules ---------------------------------------------------------------------------------------------

    def _import(self, declaration: bool) -> bool:
        kind, t, _ = self.peek()
        if kind == PUNCT and t in ("(", "."):
            return False
        if not declaration or self.depth > 1 and not self.ts:
            self.fail("import is only allowed at the top level")
        at = self.start
        self.next()
        if self.kind == STRING:
            self._script_check(at)
            self._from_string()
            return True
        if self.ts and self.text == "type":
            kind, t, _ = self.peek()
            if kind == PUNCT and t in ("{", "*") or kind == NAME and (t != "from" or self._type_from()):
                self.next()
        if self.is_name():
            self.next()
            if self.ts and self.eat("="):
                if self.text == "require" and self.peek()[1] == "(":
                    self.next()
                    self.next()
                    if self.kind != STRING:
                        self.fail()
                    self.next()
                    self.need(")")
                else:
                    self.entity_name()
                self.semicolon()
                return True
            if self.text != "from":
                self.need(",")
                self._import_names()
        else:
            self._import_names()
        self._script_check(at)
        self.need("from")
        self._from_string()
        return True

    def _type_from(self) -> bool:
        return bool(re.compile(r"\s+from\s+from\b").match(self.src, self.end))

    def _script_check(self, at: int) -> None:
        if self.goal == "script":
            raise SourceError(at, "import and export are not allowed in scripts")

    def _import_names(self) -> None:
        if self.eat("*"):
            self.need("as")
            self.name()
            return
        self.need("{")
        self._specifiers(True)

    def _specifiers(self, binding: bool) -> None:
        while not self.eat("}"):
            if self.ts and self.text == "type" and self.peek()[0] in (NAME, STRING) and self.peek()[1] != "as":
                self.next()
            elif self.ts and self.text == "type" and re.compile(r"\s+as\s+(?:as\s+)?\w").match(self.src, self.end) and re.compile(r"\s+as\s*[,}]|\s+as\s+as\b").match(self.src, self.end):
                self.next()
            if self.kind not in (NAME, STRING):
                self.fail()
            plain = self.is_name()
            self.next()
            if self.text == "as" and self.kind == NAME:
                self.next()
                if binding:
                    self.name()
                elif self.kind in (NAME, STRING):
                    self.next()
                else:
                    self.fail()
            elif binding and not plain:
                self.fail("expected as")
            if self.text != "}":
                self.need(",")

    def _from_string(self) -> None:
        if self.kind != STRING:
            self.fail()
        self.next()
        if self.kind == NAME and self.text in ("with", "assert") and not self.newline:
            self.next()
            self.need("{")
            while not self.eat("}"):
                if self.kind not in (NAME, STRING):
                    self.fail()
                self.next()
                self.need(":")
                if self.kind != STRING:
                    self.fail()
                self.next()
                if self.text != "}":
                    self.need(",")
        self.semicolon()

    def export_statement(self, declaration: bool) -> bool:
        if not declaration or self.depth > 1 and not self.ts:
            self.fail("export is only allowed at the top level")
        at = self.start
        self.next()
        if self.ts and self.kind == PUNCT and self.text == "=":
            self.next()
            self.expression()
            self.semicolon()
            return True
        if self.goal == "script" and not (self.ts and self.depth > 1):
            raise SourceError(at, "import and export are not allowed in scripts")
        if self.ts and self.text == "as" and self.peek()[1] == "namespace":
            self.next()
            self.next()
            self.name()
            self.semicolon()
            return True
        if self.eat("default"):
            self._export_default()
            return True
        if self.ts and self.text == "type":
            kind, t, _ = self.peek()
            if kind == PUNCT and t in ("{", "*"):
                self.next()
        if self.ts and self.text == "import":
            self.statement(True)
            return True
        if self.eat("*"):
            if self.eat("as"):
                if self.kind not in (NAME, STRING):
                    self.fail()
                self.next()
            self.need("from")
            self._from_string()
            return True
        if self.text == "{" and self.kind == PUNCT:
            self.next()
            self._specifiers(False)
            if self.eat("from"):
                self._from_string()
            else:
                self.semicolon()
            return True
        if self.kind == NAME and (
            self.text in ("var", "let", "const", "function", "class", "async")
            or self.ts and self.text in ("interface", "type", "enum", "declare", "namespace", "module", "abstract", "global")
        ) or self.text == "@":
            kind, t, _ = self.peek()
            if self.text == "async" and t != "function":
                self.fail()
            self.statement(True)
            return True
        self.fail()
        return True

    def _export_default(self) -> None:
        t = self.text
        if t == "function" and self.kind == NAME:
            self.function(True, optional_name=True)
        elif t == "async" and self.peek()[1] == "function":
            self.next()
            self.function(True, True, True)
        elif t == "class" or t == "@" and self.kind == PUNCT:
            self.decorators()
            self.class_(True, True)
        elif self.ts and t == "abstract" and self.peek()[1] == "class":
            self.next()
            self.class_(True, True)
        elif self.ts and t == "interface" and self.peek()[0] == NAME:
            self.statement(True)
        else:
            self.assignment()
            self._check_cover()
            self.semicolon()

    # --- TypeScript declarations -----------------------------------------------------------------------------

    def _interface(self, declaration: bool) -> bool:
        kind, t, line = self.peek()
        if not self.ts or kind != NAME or line or t in ("in", "instanceof", "of"):
            return False
        self.next()
        self.name()
        if self.text == "<":
            self.type_parameters()
        if self.eat("extends"):
            self.type_list()
        self.object_type()
        return True

    def _type_alias(self, declaration: bool) -> bool:
        kind, t, line = self.peek()
        if not self.ts or kind != NAME or line or t in ("in", "instanceof", "of"):
            return False
        self.next()
        self.name()
        if self.text == "<":
            self.type_parameters()
        self.need("=")
        self.type()
        self.semicolon()
        return True

    def _enum(self, declaration: bool) -> bool:
        if not self.ts:
            return False
        self.enum()
        return True

    def enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        while not self.eat("}"):
            self.property_name()
            if self.eat("="):
                self.assignment()
            if self.text != "}":
                self.need(",")

    def _namespace(self, declaration: bool) -> bool:
        kind, t, line = self.peek()
        if not self.ts or line or not (kind == NAME or kind == STRING and self.text == "module") or t in ("in", "instanceof"):
            return False
        self.next()
        if self.kind == STRING:
            self.next()
        else:
            self.entity_name()
        if self.text == "{" and self.kind == PUNCT:
            self.block()
        else:
            self.semicolon()
        return True

    def _global(self, declaration: bool) -> bool:
        if not self.ts or self.peek()[1] != "{":
            return False
        self.next()
        self.block()
        return True

    def _declare(self, declaration: bool) -> bool:
        kind, t, line = self.peek()
        if not self.ts or line or kind != NAME or t not in (
            "var", "let", "const", "function", "class", "interface", "type", "enum", "namespace", "module", "abstract", "global", "async", "import",
        ):
            return False
        self.next()
        if self.text in ("var", "let", "const") and self.peek()[1] != "enum":
            word = self.text
            self.next()
            self.variable_list(word=word, ambient=True)
            self.semicolon()
        else:
            outer, self.ambient = self.ambient, True
            try:
                self.statement(True)
            finally:
                self.ambient = outer
        return True

    def _abstract(self, declaration: bool) -> bool:
        kind, t, line = self.peek()
        if not self.ts or t != "class" or line:
            return False
        self.next()
        self.class_(True)
        return True

    # --- expressions -----------------------------------------------------------------------------------------

    def expression(self, keep_cover: bool = False) -> int:
        shape = self.assignment()
        while self.text == "," and self.kind == PUNCT:
            self.next()
            self.assignment()
            shape = VALUE
        if not keep_cover:
            self._check_cover()
        return shape

    def _check_cover(self) -> None:
        if self.cover >= 0:
            at, self.cover = self.cover, -1
            raise SourceError(at, "unexpected '='")

    def assignment(self) -> int:
        """An assignment expression; tells what it is for the sake of a following = or loop."""
        kind, cover = self.kind, self.cover
        if kind == STRING or kind == NAME and self.text not in _NO_OPERAND or kind == NUMBER and self.text[0] != "0":
            # most expressions begin with a plain operand, and many are nothing else
            start = self.start
            self.next()
            shape = TARGET if kind == NAME else VALUE
            if self.kind == PUNCT and self.text in _ENDERS:
                return shape
            self.cover = -1
            shape = self._assigned(self.binary(0, self._postfix(self.subscripts(shape))), start, cover, kind)
        else:
            shape = self._assignment()
        if shape != FURTHER:
            return shape
        while shape == FURTHER:  # the arms of chained conditionals are no nesting
            shape = self._assignment()
        self._check_cover()
        self.cover = cover
        return VALUE

    def _assignment(self) -> int:
        kind, t = self.kind, self.text
        if kind == NAME:
            if t == "async" and self._async_arrow():
                return ARROW
            if t == "yield" and self.in_generator:
                self.next()
                if not self.newline:
                    star = self.eat("*")
                    if star or not (self.kind == EOF or self.kind == PUNCT and self.text in (")", "]", "}", ",", ";", ":")) and self.text not in ("in", "of"):
                        self.assignment()
                return VALUE
        elif kind == PUNCT and t == "<" and self.ts:
            if (not self.jsx or _GENERIC_ARROW(self.src, self.start)) and self.attempt(self._generic_arrow_head):
                self.arrow_body()
                return ARROW
        start, cover = self.start, self.cover
        self.cover = -1
        return self._assigned(self.binary(0), start, cover, kind)

    def _assigned(self, shape: int, start: int, cover: int, kind: int) -> int:
        """What follows the operand or operation at ``start``, whose first token is of ``kind``."""
        if shape == ARROW:
            self.cover = cover
            return ARROW
        if self.kind == PUNCT:
            t = self.text
            if t == "=>" and shape == TARGET and not self.newline and kind == NAME:
                # a lone name before the arrow
                self.next_arrow_body()
                self.cover = cover
                return ARROW
            if t == "?":
                self._check_cover()
                self.next()
                saved, self.no_in = self.no_in, False
                self.conditional_middle()
                self.no_in = saved
                self.need(":")
                return FURTHER
            if t == ">":
                t = self.angle()
            if t in ASSIGN:
                if shape == PATTERN and t == "=":
                    self.cover = -1
                elif shape != TARGET:
                    raise SourceError(start, "invalid assignment target")
                self.jump(self.start + len(t))
                self.assignment()
                self._check_cover()
                self.cover = cover
                return VALUE
        if self.cover < 0:
            self.cover = cover
        return shape

    def conditional_middle(self) -> None:
        self.assignment()
        self._check_cover()

    def _async_arrow(self) -> bool:
        kind, t, line = self.peek()
        if line:
            return False
        if kind == NAME and t not in RESERVED:
            state = self.save()
            self.next()
            self.next()
            if self.text == "=>" and self.kind == PUNCT:
                self.next()
                self.arrow_body(True, True)
                return True
            self.load(state)
        elif kind == PUNCT and (t == "(" or t == "<" and self.ts):
            if self.attempt(self._async_arrow_head):
                self.arrow_body(True)
                return True
        return False

    def _async_arrow_head(self) -> None:
        self.next()
        self._arrow_head(True)

    def _generic_arrow_head(self) -> None:
        self._arrow_head()

    def _arrow_head(self, is_async: bool = False) -> None:
        if self.text == "<" and self.ts:
            self.type_parameters()
        self.signature(is_async or self.in_async, False)
        if self.newline or self.text != "=>" or self.kind != PUNCT:
            self.fail()

    def next_arrow_body(self) -> None:
        self.next()
        self.arrow_body(self.in_async if not self.in_function else False, True)

    def arrow_body(self, is_async: bool = False, past_arrow: bool = False) -> None:
        if not past_arrow:
            self.need("=>")
        if self.text == "{" and self.kind == PUNCT:
            no_in = self.no_in
            self.body(is_async)
            self.no_in = no_in
            return
        saved = self.in_function, self.in_async, self.in_generator
        self.in_async, self.in_generator = is_async, False
        try:
            self.assignment()
            self._check_cover()
        finally:
            self.in_function, self.in_async, self.in_generator = saved

    def binary(self, least: int, shape: int | None = None) -> int:
        """Precedence climbing over operators that bind tighter than ``least``; ``shape`` is the first operand's, if
        that is read already."""
        if shape is None:
            shape = self.unary()
        if shape == ARROW:
            return shape
        while True:
            op = self.text
            kind = self.kind
            if kind == PUNCT:
                if op == ">":
                    op = self.angle()
                power = BINARY.get(op)
                if power is None:
                    return shape
            elif kind == NAME:
                if self.ts and op in ("as", "satisfies") and not self.newline and least < 8:
                    self.next()
                    if self.text == "const" and self.kind == NAME:
                        self.next()
                    else:
                        self.type()
                    shape = TARGET if shape == TARGET and op == "as" else VALUE
                    continue
                if op != "in" and op != "instanceof" or op == "in" and self.no_in:
                    return shape
                power = 8
            else:
                return shape
            if power <= least:
                return shape
            if self.cover >= 0:
                self._check_cover()
            self.jump(self.start + len(op))
            right = self.binary(power - 1 if op == "**" else power)
            if right == ARROW:
                self.fail("an arrow function needs brackets here")
            if self.cover >= 0:
                self._check_cover()
            shape = VALUE

    def unary(self) -> int:
        kind, t = self.kind, self.text
        if kind == NAME:
            if t in ("typeof", "void", "delete"):
                self.next()
                self.unary()
                return VALUE
            if t == "await":
                if self.in_async:
                    self.next()
                    self.unary()
                    return VALUE
                if self.in_function and self.peek()[0] in (NAME, STRING, NUMBER) and not self.peek()[2]:
                    self.fail("await outside of an async function")
        elif kind == PUNCT:
            if t in UNARY:
                self.next()
                self.unary()
                return VALUE
            if t == "++" or t == "--":
                self.next()
                at = self.start
                if self.unary() != TARGET:
                    raise SourceError(at, "invalid update target")
                return VALUE
            if t == "<" and self.ts and not self.jsx:
                self.next()
                if self.text == "const" and self.kind == NAME:
                    self.next()
                else:
                    self.type()
                self.need(">")
                self.unary()
                return VALUE
        return self._postfix(self.subscripts(self.primary()))

    def _postfix(self, shape: int) -> int:
        if self.kind == PUNCT and (self.text == "++" or self.text == "--") and not self.newline:
            if shape != TARGET:
                self.fail("invalid update target")
            self.next()
            return VALUE
        return shape

    def subscripts(self, shape: int, new: bool = False, heritage: bool = False, decorator: bool = False) -> int:
        """Members, calls, tagged templates and, in TypeScript, type arguments and non-null marks."""
        if shape == ARROW:
            return shape
        optional = False
        while True:
            kind = self.kind
            if kind == TEMPLATE:
                self.template_literal()
                shape = VALUE
                continue
            if kind != PUNCT:
                return shape
            t = self.text
            if t == ".":
                self.next()
                if self.kind != NAME and self.kind != PRIVATE:
                    self.fail()
                self.next()
                shape = VALUE if optional else TARGET
            elif t == "(":
                if new:
                    return shape
                if self.cover >= 0:
                    self._check_cover()
                self.arguments()
                shape = VALUE
            elif t == "[":
                if decorator:
                    return shape
                self.next()
                saved, self.no_in = self.no_in, False
                self.expression()
                self.no_in = saved
                self.need("]")
                shape = VALUE if optional else TARGET
            elif t == "?.":
                if new:
                    self.fail()
                optional = True
                self.next()
                if self.kind in (NAME, PRIVATE):
                    self.next()
                elif self.kind == PUNCT and self.text == "(":
                    self.arguments()
                elif self.kind == PUNCT and self.text == "[":
                    self.next()
                    self.expression()
                    self.need("]")
                elif self.ts and self.text == "<":
                    self.type_arguments()
                    self.arguments()
                else:
                    self.fail()
                shape = VALUE
            elif t == "`":
                self.template_literal()
                shape = VALUE
            elif self.ts and t == "!" and not self.newline:
                self.next()
            elif self.ts and t == "<" and not heritage:
                if not self.attempt(self._call_type_arguments):
                    return shape
                shape = VALUE
            else:
                return shape

    def _call_type_arguments(self) -> None:
        self.type_arguments()
        if self.kind == PUNCT and self.text in ("(", "`"):
            return
        # an instantiation expression, unless an operand follows
        if self.kind in (NAME, NUMBER, STRING, PRIVATE) and not self.newline and self.text not in ("as", "satisfies", "in", "instanceof", "of"):
            self.fail()
        if self.kind == PUNCT and self.text in ("{", "[", "+", "-", "!", "~", "<", "/") and not self.newline:
            self.fail()

    def arguments(self) -> None:
        self.next()
        saved, self.no_in = self.no_in, False
        while not (self.text == ")" and self.kind == PUNCT):
            if self.text == "..." and self.kind == PUNCT:
                self.next()
            self.assignment()
            if self.cover >= 0:
                self._check_cover()
            if self.text != ")" or self.kind != PUNCT:
                if self.text != "," or self.kind != PUNCT:
                    self.need(",")
                self.next()
        self.no_in = saved
        self.next()

    def template_literal(self, types: bool = False) -> None:
        start = self.start
        more = self.template(self.start + 1)
        saved, self.no_in = self.no_in, False
        while more:
            self.next()
            self.type() if types else self.expression()
            if self.text != "}" or self.kind != PUNCT:
                self.fail("expected '}' in a template")
            end = self.start + 1
            self.start = start
            more = self.template(end)
        self.no_in = saved
        self.next()

    def primary(self) -> int:
        kind, t = self.kind, self.text
        if kind == NAME:
            if t not in RESERVED:
                if t == "async" and self._async(False):
                    return VALUE
                if t == "yield" and (self.in_generator or self.strict) or t == "await" and self.in_async and self.in_function:
                    self.fail()
                self.next()
                return TARGET
            if t == "this" or t == "null" or t == "true" or t == "false":
                self.next()
                return VALUE
            if t == "function":
                self.function(False)
                return VALUE
            if t == "class":
                self.class_(False)
                return VALUE
            if t == "new":
                self.new()
                return VALUE
            if t == "super":
                self.next()
                if self.text not in ("(", ".", "["):
                    self.fail()
                return VALUE
            if t == "import":
                self.next()
                if self.text == ".":
                    self.next()
                    if self.text not in ("meta", "source", "defer") or self.text == "meta" and self.goal == "script":
                        self.fail()
                    self.next()
                elif self.text != "(":
                    self.fail()
                return VALUE
            self.fail()
        if kind == STRING:
            self.next()
            return VALUE
        if kind == NUMBER:
            if self.strict and len(t) > 1 and t[0] == "0" and t[1] in "0123456789":
                self.fail("octal number in a module")
            self.next()
            return VALUE
        if kind == PUNCT:
            if t == "(":
                return self.parenthesis()
            if t == "[":
                return self.array()
            if t == "{":
                return self.object()
            if t == "/" or t == "/=":
                self.regex()
                self.next()
                return VALUE
            if t == "<" and self.jsx:
                self.jump(self.jsx_element(self.start))
                return VALUE
            if t == "@":
                self.decorators()
                self.class_(False)
                return VALUE
        elif kind == TEMPLATE:
            self.template_literal()
            return VALUE
        elif kind == PRIVATE and self.peek()[1] == "in":
            self.next()
            return VALUE
        self.fail()
        return VALUE

    def new(self) -> None:
        self.next()
        if self.text == "." and self.kind == PUNCT:
            self.next()
            self.need("target")
            return
        if self.text == "new" and self.kind == NAME:
            self.new()
            shape = VALUE
        elif self.text == "import" and self.kind == NAME and self.peek()[1] == "(":
            self.fail()
        else:
            shape = self.primary()
        self.subscripts(shape, new=True)
        if self.text == "(" and self.kind == PUNCT:
            self.arguments()

    def parenthesis(self) -> int:
        """A bracketed expression, or the parameters of an arrow function with its body."""
        m = _ARROW_HINT(self.src, self.end)
        if m is not None and self.attempt(self._plain_arrow_head):
            self.arrow_body(self.in_async and not self.in_function)
            return ARROW
        self.next()
        saved, self.no_in, cover = self.no_in, False, self.cover
        self.cover = -1
        shape = self.expression()
        self.no_in, self.cover = saved, cover
        self.need(")")
        return TARGET if shape == TARGET else VALUE

    def _plain_arrow_head(self) -> None:
        self._arrow_head()

    def array(self) -> int:
        self.next()
        shape = PATTERN
        saved, self.no_in = self.no_in, False
        while not (self.text == "]" and self.kind == PUNCT):
            if self.text == "," and self.kind == PUNCT:
                self.next()
                continue
            if self.text == "..." and self.kind == PUNCT:
                self.next()
            self.assignment()
            if self.text != "]" or self.kind != PUNCT:
                if self.text != "," or self.kind != PUNCT:
                    self.need(",")
                self.next()
        self.no_in = saved
        self.next()
        return shape

    def object(self) -> int:
        self.next()
        saved, self.no_in = self.no_in, False
        while not (self.text == "}" and self.kind == PUNCT):
            self.property()
            if self.text != "}" or self.kind != PUNCT:
                if self.text != "," or self.kind != PUNCT:
                    self.need(",")
                self.next()
        self.no_in = saved
        self.next()
        return PATTERN

    def property(self) -> None:
        kind, t = self.kind, self.text
        if kind == PUNCT and t == "...":
            self.next()
            self.assignment()
            return
        is_async = generator = False
        plain = kind == NAME
        at = self.start
        if plain and t in ("get", "set", "async"):
            nk, nt, line = self.peek()
            if not (nk == PUNCT and nt in (",", ":", "(", "}", "=", "<")):
                if t == "async" and line:
                    self.fail()
                is_async = t == "async"
                plain = False
                self.next()
        if self.text == "*" and self.kind == PUNCT:
            self.next()
            generator, plain = True, False
        reserved = self.kind == NAME and not self.is_name()
        self.property_name()
        if self.kind == PUNCT:
            if self.text == ":" and (plain or kind != NAME) and not generator:
                self.next()
                self.assignment()
                return
            if self.text == "(" or self.text == "<" and self.ts:
                self.signature(is_async, generator)
                self.body(is_async, generator)
                return
            if plain and not reserved:
                if self.text == "=":
                    if self.cover < 0:
                        self.cover = self.start
                    self.next()
                    held, self.cover = self.cover, -1
                    self.assignment()
                    self._check_cover()
                    self.cover = held
                    return
                if self.text == "," or self.text == "}":
                    return
        if self.kind == EOF:
            self.fail()
        raise SourceError(at if plain and reserved else self.start, f"unexpected {self.text!r} in an object")

    # --- JSX -------------------------------------------------------------------------------------------------

    def _jsx_error(self, at: int, message: str) -> None:
        at = min(at, len(self.src))
        self.start = at
        self.end = max(self.end, min(at + 1, len(self.src)))
        raise SourceError(at, "unexpected end of file" if at >= len(self.src) else message)

    def jsx_element(self, at: int) -> int:
        """An element or fragment whose opening angle is at ``at``; returns the offset after it."""
        src = self.src
        pos = _JSX_SPACE(src, at + 1).end()
        name = ""
        if src.startswith(">", pos):
            pos += 1
        else:
            m = _JSX_NAME(src, pos)
            if m is None:
                self._jsx_error(pos, "malformed element")
            name = re.sub(r"\s", "", m[0])
            pos = m.end()
            if self.ts and src.startswith("<", pos):
                self.end = pos
                self.next()
                self.type_arguments()
                pos = self.start if self.kind != EOF else len(src)
                pos = self.last_end
            while True:
                pos = _JSX_SPACE(src, pos).end()
                if src.startswith("/", pos):
                    pos = _JSX_SPACE(src, pos + 1).end()
                    if not src.startswith(">", pos):
                        self._jsx_error(pos, "malformed element")
                    return pos + 1
                if src.startswith(">", pos):
                    pos += 1
                    break
                pos = self._jsx_attribute(pos)
        while True:
            pos = _JSX_TEXT(src, pos).end()
            c = src[pos : pos + 1]
            if c == "{":
                pos = self._jsx_container(pos, True)
            elif c == "<":
                inner = _JSX_SPACE(src, pos + 1).end()
                if src.startswith("/", inner):
                    inner = _JSX_SPACE(src, inner + 1).end()
                    m = _JSX_NAME(src, inner)
                    closing = ""
                    if m is not None:
                        closing, inner = re.sub(r"\s", "", m[0]), m.end()
                    inner = _JSX_SPACE(src, inner).end()
                    if closing != name or not src.startswith(">", inner):
                        self._jsx_error(pos, f"expected the end of {name or 'the fragment'}")
                    return inner + 1
                pos = self.jsx_element(pos)
            else:
                self._jsx_error(pos, f"unexpected {c!r} in text")

    def _jsx_attribute(self, pos: int) -> int:
        src = self.src
        if src.startswith("{", pos):
            self.jump(pos + 1)
            self.need("...")
            self.assignment()
            if self.text != "}" or self.kind != PUNCT:
                self.fail()
            return self.end
        m = _JSX_NAME(src, pos)
        if m is None:
            self._jsx_error(pos, "malformed attribute")
        pos = _JSX_SPACE(src, m.end()).end()
        if not src.startswith("=", pos):
            return m.end()
        pos = _JSX_SPACE(src, pos + 1).end()
        if src.startswith("{", pos):
            return self._jsx_container(pos, False)
        if src.startswith("<", pos):
            return self.jsx_element(pos)
        m = _JSX_STRING(src, pos)
        if m is None:
            self._jsx_error(pos, "malformed attribute value")
        return m.end()

    def _jsx_container(self, pos: int, empty: bool) -> int:
        self.jump(pos + 1)
        if self.text == "}" and self.kind == PUNCT:
            if not empty:
                self.fail()
            return self.end
        if empty and self.text == "..." and self.kind == PUNCT:
            self.next()
        saved, self.no_in = self.no_in, False
        self.expression()
        self.no_in = saved
        if self.text != "}" or self.kind != PUNCT:
            self.fail()
        return self.end

    # --- types -----------------------------------------------------------------------------------------------

    def type_list(self) -> None:
        self.type()
        while self.eat(","):
            self.type()

    def return_type(self) -> None:
        if self.text == "asserts" and self.kind == NAME:
            kind, t, line = self.peek()
            if kind == NAME and not line and t != "is":
                self.next()
                self.next()
                if self.text == "is" and not self.newline:
                    self.next()
                    self.type()
                return
        if self.kind == NAME and (self.is_name() or self.text == "this"):
            kind, t, line = self.peek()
            if t == "is" and kind == NAME and not line:
                self.next()
                self.next()
        self.type()

    def type(self) -> None:
        if self.kind == NAME and self.text in ("new", "abstract"):
            if self.text == "abstract" and self.peek()[1] == "new":
                self.next()
            if self.text == "new":
                self.next()
                self._function_type()
                return
        if self.kind == PUNCT and (self.text == "<" or self.text == "(" and self._is_function_type()):
            self._function_type()
            return
        self.union_type()
        if self.text == "extends" and self.kind == NAME and not self.newline and not self.no_cond_types:
            self.next()
            saved, self.no_cond_types = self.no_cond_types, True
            self.type()
            self.no_cond_types = saved
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def _is_function_type(self) -> bool:
        kind, t, _ = self.peek()
        if kind == PUNCT and t in (")", "..."):
            return True
        if not (kind == NAME or kind == PUNCT and t in ("{", "[")):
            return False
        return self.attempt_only(self._function_type_head)

    def attempt_only(self, parse) -> bool:
        """Whether a parse succeeds here; nothing is consumed."""
        state = self.save()
        ok = self.attempt(parse)
        self.load(state)
        return ok

    def _function_type_head(self) -> None:
        self.parameters()
        if self.text != "=>" or self.kind != PUNCT:
            self.fail()

    def _function_type(self) -> None:
        if self.text == "<":
            self.type_parameters()
        self.parameters()
        self.need("=>")
        saved, self.no_cond_types = self.no_cond_types, False
        self.return_type()
        self.no_cond_types = saved

    def union_type(self) -> None:
        if self.kind == PUNCT and self.text in ("|", "&"):
            self.next()
        while True:
            self.operator_type()
            if self.kind != PUNCT or self.text not in ("|", "&"):
                return
            self.next()
            if self.kind == NAME and self.text in ("new", "abstract") or self.kind == PUNCT and (self.text == "<" or self.text == "(" and self._is_function_type()):
                self._type()
                return

    def operator_type(self) -> None:
        while self.kind == NAME and self.text in ("keyof", "unique", "readonly", "infer"):
            word = self.text
            kind, t, _ = self.peek()
            if not (kind in (NAME, STRING) or kind == PUNCT and t in ("(", "[", "{") or kind == TEMPLATE):
                break
            if kind == PUNCT and word != "keyof" and t != "(" and word != "readonly":
                break
            self.next()
            if word == "infer":
                self.name()
                if self.text == "extends" and self.kind == NAME:
                    self.attempt(self._infer_constraint)
                return self._array_suffix()
        self.simple_type()
        self._array_suffix()

    def _infer_constraint(self) -> None:
        self.next()
        saved, self.no_cond_types = self.no_cond_types, True
        try:
            self.type()
        finally:
            self.no_cond_types = saved
        if not self.no_cond_types and self.text == "?":
            self.fail()

    def _array_suffix(self) -> None:
        while self.kind == PUNCT and self.text == "[" and not self.newline:
            self.next()
            if self.text == "]" and self.kind == PUNCT:
                self.next()
            else:
                self.type()
                self.need("]")

    def simple_type(self) -> None:
        kind, t = self.kind, self.text
        if kind == NAME:
            if t == "typeof":
                self.next()
                if self.text == "import":
                    self._import_type()
                    return
                self.entity_name(True)
                if self.text == "<" and not self.newline:
                    self.type_arguments()
                return
            if t == "import":
                self._import_type()
                return
            if t in ("this", "void", "null", "true", "false"):
                self.next()
                if t == "this" and self.text == "is" and not self.newline:
                    self.next()
                    self.type()
                return
            if t in RESERVED:
                self.fail()
            self.entity_name()
            if self.text == "<" and self.kind == PUNCT and not self.newline:
                self.type_arguments()
            return
        if kind == STRING or kind == NUMBER:
            self.next()
            return
        if kind == PUNCT:
            if t == "{":
                self.object_type()
                return
            if t == "[":
                self.tuple_type()
                return
            if t == "(":
                self.next()
                saved, self.no_cond_types = self.no_cond_types, False
                self.type()
                self.no_cond_types = saved
                self.need(")")
                return
            if t == "-":
                self.next()
                if self.kind != NUMBER:
                    self.fail()
                self.next()
                return
        if kind == TEMPLATE:
            self.template_literal(True)
            return
        self.fail()

    def _import_type(self) -> None:
        self.need("import")
        self.need("(")
        self.type()
        if self.eat(","):
            self.assignment()
        self.need(")")
        while self.eat("."):
            if self.kind != NAME:
                self.fail()
            self.next()
        if self.text == "<":
            self.type_arguments()

    def entity_name(self, value: bool = False) -> None:
        if value and self.text == "this":
            self.next()
        else:
            self.name()
        while self.text == "." and self.kind == PUNCT:
            self.next()
            if self.kind not in (NAME, PRIVATE):
                self.fail()
            self.next()

    def type_arguments(self) -> None:
        self.need("<")
        saved, self.no_cond_types = self.no_cond_types, False
        while True:
            self.type()
            if self.text != "," or self.kind != PUNCT:
                break
            self.next()
        self.no_cond_types = saved
        self.need(">")

    def type_parameters(self) -> None:
        self.need("<")
        while not (self.text == ">" and self.kind == PUNCT):
            while self.kind == NAME and self.text in ("const", "in", "out") and self.peek()[0] == NAME and self.peek()[1] != "extends":
                self.next()
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if self.text != ">":
                self.need(",")
        self.next()

    def tuple_type(self) -> None:
        self.next()
        saved, self.no_cond_types = self.no_cond_types, False
        while not self.eat("]"):
            self.eat("...")
            if self.kind == NAME and self.peek()[1] in (":", "?") and self.attempt(self._tuple_label):
                pass
            self.type()
            self.eat("?")
            if self.text != "]":
                self.need(",")
        self.no_cond_types = saved

    def _tuple_label(self) -> None:
        self.next()
        self.eat("?")
        self.need(":")

    def object_type(self) -> None:
        self.need("{")
        saved, self.no_cond_types = self.no_cond_types, False
        if self.attempt(self._mapped_head):
            self.type()
            if self.eat("as"):
                self.type()
            self.need("]")
            if self.text in ("+", "-"):
                self.next()
                self.need("?")
            else:
                self.eat("?")
            if self.eat(":"):
                self.type()
            self.eat(";") or self.eat(",")
            self.need("}")
        else:
            while not (self.text == "}" and self.kind == PUNCT):
                self.type_member()
            self.next()
        self.no_cond_types = saved

    def _mapped_head(self) -> None:
        if self.text in ("+", "-"):
            self.next()
            self.need("readonly")
        elif self.text == "readonly" and self.peek()[1] == "[":
            self.next()
        self.need("[")
        self.name()
        self.need("in")

    def type_member(self) -> None:
        if self.kind == PUNCT and self.text in ("(", "<"):
            self.signature()
        elif self.text == "new" and self.kind == NAME and self.peek()[1] in ("(", "<"):
            self.next()
            self.signature()
        else:
            while self.kind == NAME and self.text in ("readonly", "get", "set"):
                kind, t, _ = self.peek()
                if kind == PUNCT and t in (":", "?", "(", "<", ";", ",", "}"):
                    break
                self.next()
            if self.text == "[" and self.kind == PUNCT and self.attempt(self._index_head):
                self.type()
                self.need("]")
            else:
                self.property_name()
            self.eat("?")
            if self.kind == PUNCT and self.text in ("(", "<"):
                self.signature()
            elif self.eat(":"):
                self.type()
        if self.kind == PUNCT and self.text in (";", ","):
            self.next()
        elif not (self.newline or self.text == "}" and self.kind == PUNCT):
            self.fail(f"expected ';' but found {self.text!r}" if self.kind != EOF else None)


#: After an opening bracket: what the parameters of an arrow function can begin with. A name must be followed by
#: something that can follow a parameter.
_ARROW_HINT = re.compile(r"\s*(?:\)|\.\.\.|[{\[@]|(?:[^\W\d]|\$)[\w$]*\s*(?:[,)=:?]|$)|/[*/]|this\s*:)").match

_STATEMENTS = {
    "if": Parser._if, "for": Parser._for, "while": Parser._while, "do": Parser._do, "return": Parser._return,
    "var": Parser._variables, "let": Parser._variables, "const": Parser._variables, "using": Parser._variables,
    "function": Parser._function, "async": Parser._async, "class": Parser._class, "throw": Parser._throw, "try": Parser._try,
    "switch": Parser._switch, "break": Parser._jump, "continue": Parser._jump, "with": Parser._with,
    "debugger": Parser._debugger, "import": Parser._import, "export": Parser.export_statement,
    "interface": Parser._interface, "type": Parser._type_alias, "enum": Parser._enum, "namespace": Parser._namespace,
    "module": Parser._namespace, "declare": Parser._declare, "abstract": Parser._abstract, "global": Parser._global,
}


def syntax_errors(source: str, extension: str) -> list[tuple[int, str]]:
    """All (offset, message) of a source of the given extension; empty if it is valid. Unknown extensions give
    one error at 0."""
    dialect = DIALECTS.get(extension)
    if dialect is None:
        return [(0, "unknown language")]
    return Parser(source, dialect).run()

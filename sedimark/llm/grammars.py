"""Lexers and parsing expression grammars of the languages of a code collection.

A lexer gives a string of token characters, the tokens that begin a line, and on request the places of the tokens.
``ERROR`` tokens fit no rule, so a lexical error is a syntax error at its place.
"""

from __future__ import annotations

import re
from itertools import accumulate

from sedimark.llm.peg import END, Grammar, Tokens

CONFLICT = re.compile(r"^(?:<<<<<<<|=======|>>>>>>>|\|\|\|\|\|\|\|)(?: |\r?$)", re.M)


class Language:
    """``lex(text, places)`` -> (kinds, lines, places or None), and the grammar."""

    def __init__(self, name: str) -> None:
        self.name, self.tokens = name, Tokens()
        self.grammar: Grammar | None = None

    def lex(self, text: str, places: bool = False) -> tuple[str, list[int], list[int] | None]:
        raise NotImplementedError

    def check(self, text: str) -> int | None:
        """None where the whole text is accepted, else the furthest character at which anything failed."""
        kinds, lines, _ = self.lex(text)
        if self.grammar.accepts(kinds, lines):
            return None
        kinds, lines, places = self.lex(text, True)
        return places[self.grammar.furthest(kinds, lines)]


# -- JavaScript and TypeScript -----------------------------------------------------------------------------------------

_JS_RESERVED = "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split()
_JS_SOFT = "async await of as from get set static let yield type interface namespace module declare abstract public private protected readonly implements keyof infer is asserts unique satisfies global override accessor require target meta out".split()
_JS_PUNCT = "... => ?. ?? ??= && || &&= ||= ** **= ++ -- += -= *= /= %= &= |= ^= <<= == != === !== <= >= << + - * / % & | ^ ! ~ ? : = < > ( ) [ ] { } ; , . @ #".split()

_REGEX = r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*"
_JS_TOKEN = re.compile(
    r"(?:[^\S\n]|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*+"
    r"(\n|[A-Za-z_$\u0080-\U0010ffff][\w$‌‍]*|\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
    r"|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}`\"'/\\]*\})*`|`"
    rf"|(?:(?<=[=(,:\[!&|?;] )|(?<=[(,\[!])){_REGEX}"
    r"|0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?|\#[A-Za-z_$][\w$]*"
    r"|\.\.\.|=>|\?\?=|\?\?|\?\.(?!\d)|&&=|\|\|=|&&|\|\||\*\*=|\*\*|\+\+|--|===|!==|==|!=|<<=|<<|<=|>=|[-+*%&|^]=|/=|[-+*/%&|^!~?:=<>()\[\]{};,.@#]|[\s\S]|\Z)"
)
_JS_REGEX = re.compile(_REGEX)
_TEMPLATE_PART = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$-]*(?:[.:][A-Za-z_$][\w$-]*)*")
_JSX_GAP = re.compile(r"(?:\s|/\*(?:[^*]|\*(?!/))*\*/|//[^\n]*)*")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_JSX_TEXT = re.compile(r"[^<>{}]+")

_JS_GRAMMAR = r"""
Program <- ModuleItem* END
ModuleItem <- Import / Export / Stmt
Semi <- ';' / &'}' / &END / ~
Stmt <== Block / VarDecl / FunctionDecl / ClassDecl / If / For / While / Do / Try / Switch / Return / Jump / Throw / Labelled / TsDecl / ';' / ExprStmt
Block <- '{' Stmt* '}'
VarDecl <- 'const' ConstBind (',' ConstBind)* Semi / ('let' / 'var') Bind (',' Bind)* Semi
ConstBind <- Pattern TypeAnn? '=' Assign
Bind <- Ident Definite? TypeAnn? ('=' Assign)? / Pattern TypeAnn? '=' Assign
If <- 'if' '(' Expr ')' Stmt ('else' Stmt)?
For <- 'for' 'await'? '(' ForHead ')' Stmt
ForHead <- ('const' / 'let' / 'var') Pattern TypeAnn? ('of' Assign / 'in' Expr) / (('const' / 'let' / 'var') Bind (',' Bind)*)? ';' Expr? ';' Expr? / LeftHand ('of' Assign / 'in' Expr) / Expr ';' Expr? ';' Expr?
While <- 'while' '(' Expr ')' Stmt
Do <- 'do' Stmt 'while' '(' Expr ')' ';'?
Try <- 'try' Block (Catch Finally? / Finally)
Catch <- 'catch' ('(' Pattern TypeAnn? ')')? Block
Finally <- 'finally' Block
Switch <- 'switch' '(' Expr ')' '{' (('case' Expr / 'default') ':' Stmt*)* '}'
Return <- 'return' (!~ Expr)? Semi
Jump <- ('break' / 'continue') (!~ Ident)? Semi / 'debugger' Semi
Throw <- 'throw' !~ Expr Semi
Labelled <- Ident ':' Stmt
ExprStmt <- !'function' !'class' !'{' Expr Semi
FunctionDecl <- ('async' !~)? 'function' '*'? Ident TypeParams? '(' Params ')' RetType? (Block / Overload)
Params <- (Param (',' Param)* ','?)?
Param <- Decorator* ParamMod* '...'? (Pattern / 'this') '?'? TypeAnn? ('=' Assign)?
ClassDecl <- Decorator* Abstract? 'class' ClassTail
ClassTail <- (!'implements' Ident)? TypeParams? ('extends' LeftHand TypeArgs?)? Implements? '{' Member* '}'
Member <== ';' / 'static' Block / Decorator* Mod* MemberBody
Mod <- MODIFIER !MEMBEREND !(~)
MemberBody <- ('get' / 'set') PropName '(' Params ')' RetType? (Block / Overload) / '*'? PropName Optional? TypeParams? '(' Params ')' RetType? (Block / Overload) / PropName (Optional / Definite)? TypeAnn? ('=' Assign)? Semi / IndexSig Semi
Expr <- Assign (',' Assign)*
Assign <= Arrow / Yield / LeftHand ASSIGNOP Assign / LeftHand '>' '>=' Assign / Cond
Arrow <- &ARROWSTART (('async' !~)? (Ident / TypeParams? '(' Params ')' RetType?) '=>' (Block / !'{' Assign))
Yield <- 'yield' (!~ ('*' Assign / &EXPRSTART Assign))?
Cond <- Binary ('?' Assign ':' Assign)?
Binary <- Unary (Operator Unary / Cast)*
Operator <- BINOP / '>' ('>' '>'?)?
Unary <- UNOP Unary / 'await' &EXPRSTART Unary / Assertion / Postfix
Postfix <- LeftHand (!~ ('++' / '--'))?
LeftHand <= Head Suffix*
Head <- 'new' ('.' 'target' / NewHead Args?) / 'super' &('(' / '.' / '[') / 'import' ('(' Assign (',' Assign)? ','? ')' / '.' 'meta') / Primary
NewHead <- 'new' NewHead Args? / Primary ('.' (PropName / PRIVATE) / '[' Expr ']')* TypeArgs?
Suffix <- '.' (IdentName / PRIVATE) / '?.' (IdentName / PRIVATE / '[' Expr ']' / TypeArgs? Args) / '[' Expr ']' / Args / TEMPLATE / NonNull / &'<' (TypeArgs &('(' / TEMPLATE) / Instance)
Args <- '(' (Item (',' Item)* ','?)? ')'
Item <- '...'? Assign
Primary <- NUMBER / STRING / TEMPLATE / REGEX / 'this' / 'null' / 'true' / 'false' / ('async' !~)? 'function' '*'? Ident? TypeParams? '(' Params ')' RetType? Block / Decorator* 'class' ClassTail / '[' Item? (',' Item?)* ']' / Object / '(' Expr ')' / Jsx / Ident
Object <- '{' (Prop (',' Prop)* ','?)? '}'
Prop <= '...' Assign / ('get' / 'set') PropName '(' Params ')' RetType? Block / ('async' !~)? '*'? PropName TypeParams? '(' Params ')' RetType? Block / PropName ':' Assign / Ident ('=' Assign)?
PropName <- IdentName / STRING / NUMBER / '[' Assign ']' / PRIVATE
Pattern <- Ident / '[' Element? (',' Element?)* ']' / '{' (PatternProp (',' PatternProp)* ','?)? '}'
Element <- '...' Pattern / Pattern ('=' Assign)?
PatternProp <- '...' Pattern / PropName ':' Pattern ('=' Assign)? / Ident ('=' Assign)?
Ident <- NAME / SOFT
IdentName <- NAME / SOFT / RESERVED
Import <== 'import' (STRING / ImportClause 'from' STRING) With? Semi / ImportAlias
ImportClause <- TypeOnly? (Ident (',' (Named / Star))? / Named / Star)
Star <- '*' 'as' Ident
Named <- '{' (Spec (',' Spec)* ','?)? '}'
Spec <- SpecType? (IdentName / STRING) ('as' (IdentName / STRING))?
With <- 'with' Object
Export <- Decorator* 'export' ('default' (FunctionAny / ClassDecl / DefaultInterface / !'function' !'class' Assign Semi) / TypeOnly? '*' ('as' (IdentName / STRING))? 'from' STRING With? Semi / TypeOnly? Named ('from' STRING With?)? Semi / VarDecl / FunctionDecl / ClassDecl / TsDecl / ExportEquals)
FunctionAny <- ('async' !~)? 'function' '*'? Ident? TypeParams? '(' Params ')' RetType? (Block / Overload)
"""

_JS_ONLY = r"""
Decorator <- NEVER
TypeAnn <- NEVER
TypeParams <- NEVER
TypeArgs <- NEVER
RetType <- NEVER
TsDecl <- NEVER
Overload <- NEVER
Abstract <- NEVER
Implements <- NEVER
Optional <- NEVER
Definite <- NEVER
IndexSig <- NEVER
ParamMod <- NEVER
Cast <- NEVER
Assertion <- NEVER
NonNull <- NEVER
Instance <- NEVER
ImportAlias <- NEVER
TypeOnly <- NEVER
SpecType <- NEVER
DefaultInterface <- NEVER
ExportEquals <- NEVER
"""

_TS_ONLY = r"""
Decorator <- '@' (Ident / '(' Expr ')') ('.' PropName / Args)*
TypeAnn <- ':' Type
TypeParams <- '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam <- ('const' / 'in' / 'out')* Ident ('extends' Type)? ('=' Type)?
TypeArgs <= '<' Type (',' Type)* '>'
RetType <- ':' TypeOrGuard
TypeOrGuard <- 'asserts' !~ (Ident / 'this') ('is' Type)? / (Ident / 'this') !~ 'is' !~ Type / Type
Overload <- Semi
Abstract <- 'abstract' !~
Implements <- 'implements' Type (',' Type)*
Optional <- '?'
Definite <- '!' &':'
IndexSig <- '[' Ident ':' Type ']' TypeAnn
ParamMod <- ('public' / 'private' / 'protected' / 'readonly' / 'override') &('{' / '[' / NAME / SOFT)
Cast <- !~ ('as' / 'satisfies') ('const' / Type)
NonNull <- !~ '!'
Instance <- TypeArgs !(NAME / NUMBER / STRING / '(' / '[' / '{')
ImportAlias <- 'import' TypeOnly? Ident '=' ('require' '(' STRING ')' / Ident ('.' IdentName)*) Semi
TypeOnly <- 'type' !('from' !'from') !',' !'='
SpecType <- 'type' &(NAME / SOFT / RESERVED / STRING) !('as' !('as' / NAME / SOFT))
DefaultInterface <- 'interface' Ident TypeParams? ('extends' Type (',' Type)*)? TypeBody
ExportEquals <- '=' Expr Semi / 'as' 'namespace' Ident Semi
TsDecl <- DefaultInterface / 'type' !~ Ident TypeParams? '=' Type Semi / 'const'? 'enum' Ident '{' (EnumMember (',' EnumMember)* ','?)? '}' / 'declare' !~ ('global' Block / VarDecl / DeclareVar / FunctionDecl / ClassDecl / TsDecl) / ('namespace' / 'module') !~ (Ident ('.' IdentName)* / STRING) (ModuleBlock / Semi)
DeclareVar <- 'const' Pattern TypeAnn? (',' Pattern TypeAnn?)* Semi
ModuleBlock <- '{' ('export'? DeclareVar / ModuleItem)* '}'
EnumMember <- (IdentName / STRING) ('=' Assign)?
Type <= FunctionType / Union ('extends' !~ Union '?' Type ':' Type)?
FunctionType <- 'abstract'? 'new'? TypeParams? '(' Params ')' '=>' TypeOrGuard
Union <- ('|' / '&')? TypeOp (('|' / '&') TypeOp)*
TypeOp <- ('keyof' / 'unique' / 'readonly' / 'infer') TypeOp ('extends' TypeOp !'?')? / TypePost
TypePost <- TypePrimary (!~ '[' Type? ']')*
TypePrimary <- '(' Type ')' / TypeBody / Mapped / '[' (TupleItem (',' TupleItem)* ','?)? ']' / STRING / '-'? NUMBER / TEMPLATE / 'null' / 'true' / 'false' / 'this' / 'void' / 'typeof' (ImportType / Ident ('.' (IdentName / PRIVATE))*) (!~ TypeArgs)? / ImportType / !('keyof' / 'infer' / 'unique') Ident ('.' IdentName)* (!~ TypeArgs)?
ImportType <- 'import' '(' STRING ')' ('.' IdentName)* TypeArgs?
TupleItem <- '...'? Ident '?'? ':' Type / '...'? Type '?'?
Mapped <- '{' (('+' / '-')? 'readonly')? '[' Ident 'in' Type ('as' Type)? ']' (('+' / '-')? '?')? TypeAnn? ';'? '}'
TypeBody <- '{' TypeMember* '}'
TypeMember <== TypeMemberBody (';' / ',' / &'}' / ~)
TypeMemberBody <- 'readonly'? IndexSig / 'new'? TypeParams? '(' Params ')' RetType? / ('get' / 'set') PropName '(' Params ')' RetType? / ('readonly' !(':' / '?' / '('))? PropName '?'? (TypeParams? '(' Params ')' RetType? / TypeAnn?)
Assertion <- '<' (Type / 'const') '>' Unary
"""

_TSX_ONLY = _TS_ONLY.replace("Assertion <- '<' (Type / 'const') '>' Unary", "Assertion <- NEVER")

_JSX_ON = r"""
Jsx <- JSXBEGIN JsxAttr* (JSXSELFEND / JSXOPENEND JsxChild* JSXCLOSE)
JsxAttr <- JSXNAME (JSXEQ (JSXSTRING / JSXLB Assign JSXRB / Jsx))? / JSXLB '...' Assign JSXRB
JsxChild <- JSXTEXT / JSXLB ('...'? Expr)? JSXRB / Jsx
"""
_JSX_OFF = "Jsx <- NEVER\n"

_BINARY = "?? || && | ^ & == != === !== < <= >= << + - * / % ** in instanceof".split()
_ASSIGN = "= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split()
_UNARY = "! ~ + - ++ -- typeof void delete".split()
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % ~ ^ < > => && || ?? ... == != === !== <= >= += -= *= %= return typeof instanceof in of new delete void throw case do else yield await".split())


class _Kinds(dict):
    """Token spelling -> character; names, numbers, strings and templates are classified once per spelling."""

    def __init__(self, owner: EcmaScript) -> None:
        super().__init__({x: owner.tokens.code(x) for x in [*_JS_RESERVED, *_JS_SOFT, *_JS_PUNCT]})
        self["\n"], self[""] = "\n", ""
        self.fixed, self.owner = len(self), owner
        code = owner.tokens.code
        self.kinds = code("NAME"), code("NUMBER"), code("STRING"), code("PRIVATE"), code("ERROR"), code("TEMPLATE")
        self.regex = code("REGEX")

    def __missing__(self, token: str) -> str:
        first = token[0]
        name, number, string, private, error, template = self.kinds
        if first in "\"'":
            kind = string if len(token) > 1 else error
        elif first == "/":
            return self.regex
        elif first == "`":
            holes = _HOLE.findall(token) if len(token) > 1 else ["("]
            return template if all(self.owner.expression(h) for h in holes) else error
        elif first.isdigit() or first == "." and len(token) > 1 and token[1].isdigit():
            kind = number
        elif first == "#" and len(token) > 1:
            kind = private
        elif first == "_" or first == "$" or first.isalpha() or (ord(first) > 127 and token.isidentifier()):
            kind = name
        else:
            kind = error
        if len(self) > 300_000:
            for k in list(self)[self.fixed :]:
                del self[k]
        self[token] = kind
        return kind


_HOLE = re.compile(r"(?<!\\)\$\{([^{}]*)\}")


class EcmaScript(Language):
    """JavaScript modules or TypeScript, with or without JSX."""

    def __init__(self, name: str, types: bool, jsx: bool) -> None:
        super().__init__(name)
        self.jsx, self.types = jsx, types
        text = _JS_GRAMMAR + ((_TSX_ONLY if jsx else _TS_ONLY) if types else _JS_ONLY) + (_JSX_ON if jsx else _JSX_OFF)
        starts = "( [ { + - ! ~ ++ -- typeof void delete new this super null true false function class import async await yield <".split()
        sets = {
            "BINOP": _BINARY,
            "ASSIGNOP": _ASSIGN,
            "UNOP": _UNARY,
            "SOFT": _JS_SOFT,
            "RESERVED": _JS_RESERVED,
            "MODIFIER": "static async abstract public private protected readonly declare override accessor".split() if types else ["static", "async", "accessor"],
            "MEMBEREND": "( = : ; ? ! } , <".split(),
            "ARROWSTART": ["(", "<", "NAME", *_JS_SOFT],
            "EXPRSTART": ["NAME", "NUMBER", "STRING", "TEMPLATE", "REGEX", "JSXBEGIN", "@", *starts, *_JS_SOFT],
        }
        self.kind = _Kinds(self)
        self.grammar = Grammar(text, self.tokens, "Program", sets)
        code = self.tokens.code
        self.c = {x: code(x) for x in ("TEMPLATE", "REGEX", "ERROR", "JSXBEGIN", "JSXSELFEND", "JSXOPENEND", "JSXCLOSE", "JSXNAME", "JSXEQ", "JSXSTRING", "JSXLB", "JSXRB", "JSXTEXT")}

    def lex(self, text, places=False):
        start = 1 if text[:1] == "\ufeff" else 0
        if text.startswith("#!", start):
            start = (text.find("\n", start) + 1) or len(text)
        if not self.jsx and not places:
            tokens = _JS_TOKEN.findall(text, start)
            if not self._in_context(tokens):
                # nothing depends on context: all tokens at once, then the line breaks out of them
                parts = [x for x in "".join(map(self.kind.__getitem__, tokens)).split("\n") if x]
                lines = [0, *accumulate(map(len, parts))]
                return "".join(parts) + END, lines, None
        kinds: list[str] = []
        lines: list[int] = []
        at: list[int] = []
        self._scan(text, start, kinds, lines, at)
        lines.append(len(kinds))
        kinds.append(END)
        at.append(len(text))
        return "".join(kinds), lines, at if places else None

    def _in_context(self, tokens: list[str]) -> bool:
        """Whether some token can only be told by what is before it: a slash that may begin a pattern, a nested template."""
        if "`" in tokens:
            return True
        for slash in ("/", "/="):
            at = -1
            while True:
                try:
                    at = tokens.index(slash, at + 1)
                except ValueError:
                    break
                before = at - 1
                while before >= 0 and tokens[before] == "\n":
                    before -= 1
                if before < 0 or tokens[before] in _BEFORE_REGEX:
                    return True
        return False

    def expression(self, text: str) -> bool:
        """Whether ``text`` is one expression."""
        kinds, _, _ = self.lex(text)
        return self._expression(kinds[:-1])

    def _scan(self, text: str, i: int, kinds: list[str], lines: list[int], at: list[int]) -> None:
        """Tokens one by one, with a stack for what is nested: blocks, template holes and elements."""
        kind, c, n = self.kind, self.c, len(text)
        match = _JS_TOKEN.match
        fresh, last = True, ""
        stack: list[list] = []  # ["{"], ["`"], ["<", name, in_tag], ["jsx{"]
        template_at: list[int] = []

        def put(code: str, place: int) -> None:
            nonlocal fresh
            if fresh:
                lines.append(len(kinds))
                fresh = False
            kinds.append(code)
            at.append(place)

        def template(i: int) -> int:
            """From inside a template literal on: its end, or the begin of a hole (which is pushed)."""
            nonlocal last
            i = _TEMPLATE_PART.match(text, i).end()
            if i >= n:
                put(c["ERROR"], n - 1)
                return n
            if text[i] == "`":
                return -(i + 1)
            return i + 2

        holes: list[int] = []  # tokens before each open hole
        while i < n:
            top = stack[-1] if stack else None
            if top and top[0] == "<":
                i, fresh_line = self._element(text, i, stack, put)
                if fresh_line:
                    fresh = True
                last = ")" if not (stack and stack[-1][0] == "<") else ""
                if stack and stack[-1][0] == "jsx{":
                    last = "{"
                continue
            m = match(text, i)
            if m is None:
                break
            token = m.group(1)
            if token == "\n":
                fresh = True
                i = m.end()
                continue
            if not token:
                break
            place = m.start(1)
            i = m.end()
            if token[0] in "`/" and len(token) > 1 and token != "/=":
                put(kind[token], place)
                last = ")"
                continue
            if token == "`":
                begin = len(kinds)
                put(c["TEMPLATE"], place)
                stack.append(["`", begin])
                i = template(i)
                if i < 0:
                    i = -i
                    stack.pop()
                    last = ")"
                else:
                    last = "("
                    holes.append(len(kinds))
                continue
            if token == "}" and stack:
                if top[0] == "`":
                    # the hole's tokens are an expression of their own; it is checked and taken out
                    hole = holes.pop()
                    inner, places = kinds[hole:], at[hole:]
                    if not self._expression(inner):
                        kinds.append(c["ERROR"])
                        at.append(place)
                    else:
                        del kinds[hole:], at[hole:]
                        while lines and lines[-1] >= len(kinds):
                            lines.pop()
                    fresh = False
                    i = template(i)
                    if i < 0:
                        i = -i
                        stack.pop()
                        last = ")"
                    else:
                        last = "("
                        holes.append(len(kinds))
                    continue
                if top[0] == "jsx{":
                    put(c["JSXRB"], place)
                    stack.pop()
                    continue
                stack.pop()
            elif token == "{":
                stack.append(["{"])
            elif token == "/" or token == "/=":
                if last in _BEFORE_REGEX or not last:
                    r = _JS_REGEX.match(text, place)
                    if r:
                        put(c["REGEX"], place)
                        i, last = r.end(), ")"
                        continue
            elif token == "<" and self.jsx and (last in _BEFORE_REGEX or not last):
                gap = _JSX_GAP.match(text, i).end()
                name = _JSX_NAME.match(text, gap)
                generic = name and self.types and re.match(r"\s*(?:,|extends\b)", text[name.end() : name.end() + 40])
                if not generic and (name or text[gap : gap + 1] == ">"):
                    put(c["JSXBEGIN"], place)
                    stack.append(["<", name.group() if name else "", True])
                    i = name.end() if name else gap
                    continue
            put(kind[token], place)
            last = token if token in _BEFORE_REGEX else ")" if token != "." else "."
        if stack and any(x[0] in ("`", "<", "jsx{") for x in stack):
            put(c["ERROR"], max(0, n - 1))

    def _expression(self, kinds: list[str]) -> bool:
        key = "".join(kinds)
        known = self.grammar.shared.get(("hole", key))
        if known is None:
            from sedimark.llm.peg import _State

            body = key + END
            known = self.grammar.fast["r_Expr"](_State([len(key)]), body, 0) == len(key)
            self.grammar.shared["hole", key] = known
        return known

    def _element(self, text: str, i: int, stack: list[list], put) -> tuple[int, bool]:
        """One step within an element: an attribute, an end of a tag, a child."""
        c, n, top = self.c, len(text), stack[-1]
        if top[2]:
            gap = _JSX_GAP.match(text, i).end()
            line = "\n" in text[i:gap]
            i = gap
            if i >= n:
                return n, line
            if text.startswith("/>", i):
                put(c["JSXSELFEND"], i)
                stack.pop()
                return i + 2, line
            if text[i] == ">":
                put(c["JSXOPENEND"], i)
                top[2] = False
                return i + 1, line
            if text[i] == "=":
                put(c["JSXEQ"], i)
                return i + 1, line
            if text[i] == "{":
                put(c["JSXLB"], i)
                stack.append(["jsx{"])
                return i + 1, line
            if m := _JSX_STRING.match(text, i):
                put(c["JSXSTRING"], i)
                return m.end(), line
            if m := _JSX_NAME.match(text, i):
                put(c["JSXNAME"], i)
                return m.end(), line
            put(c["ERROR"], i)
            return i + 1, line
        if m := _JSX_TEXT.match(text, i):
            if not m.group().isspace():
                put(c["JSXTEXT"], i)
            return m.end(), "\n" in m.group()
        if text[i] == "{":
            put(c["JSXLB"], i)
            stack.append(["jsx{"])
            return i + 1, False
        if text[i] == "<":
            gap = _JSX_GAP.match(text, i + 1).end()
            if text[gap : gap + 1] == "/":
                gap = _JSX_GAP.match(text, gap + 1).end()
                name = _JSX_NAME.match(text, gap)
                end = _JSX_GAP.match(text, name.end() if name else gap).end()
                same = (name.group() if name else "") == top[1] and text[end : end + 1] == ">"
                put(c["JSXCLOSE"] if same else c["ERROR"], i)
                stack.pop()
                return end + 1, False
            name = _JSX_NAME.match(text, gap)
            if name or text[gap : gap + 1] == ">":
                put(c["JSXBEGIN"], i)
                stack.append(["<", name.group() if name else "", True])
                return name.end() if name else gap, False
        put(c["ERROR"], i)
        return i + 1, False


# -- Python ------------------------------------------------------------------------------------------------------------

_PY_KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
_PY_SOFT = "match case type _".split()
_PY_PUNCT = "** **= // //= << <<= >> >>= == != <= >= -> += -= *= /= %= @= &= |= ^= := ... + - * / % @ & | ^ ~ < > = ( ) [ ] { } , : ; .".split()
_PY_PREFIX = r"(?:[rR][bB]?|[bB][rR]?|[uU])?"
_PY_HEAD = r"(?:[rR]?[fFtT]|[fFtT][rR])(?=[\"'])|"
_PY_TOKEN = re.compile(
    r"(?:[ \t\f]|\\\r?\n|#[^\n]*)*+"
    rf"(\r?\n[ \t\f]*|{_PY_HEAD}{_PY_PREFIX}(?:\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*')"
    r"|[A-Za-z_\u0080-\U0010ffff]\w*|0[xX](?:_?[\da-fA-F])+(?!\w)|0[bB](?:_?[01])+(?!\w)|0[oO](?:_?[0-7])+(?!\w)|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?(?![A-Za-z_0-9])"
    r"|\*\*=|//=|<<=|>>=|\.\.\.|\*\*|//|<<|>>|==|!=|<=|>=|->|:=|[-+*/%@&|^]=|[-+*/%@&|^~<>=()\[\]{},:;.]|[\s\S]|\Z)"
)

_PY_GRAMMAR = r"""
File <- Stmt* END
Stmt <== Compound / Line
Line <- Simple (';' Simple)* ';'? NEWLINE
Simple <- 'pass' / 'break' / 'continue' / 'return' Exprs? / 'raise' (Expr ('from' Expr)?)? / 'global' NameTok (',' NameTok)* / 'nonlocal' NameTok (',' NameTok)* / 'del' Target (',' Target)* ','? &(NEWLINE / ';') / 'assert' Expr (',' Expr)? / Import / TypeAlias / ExprStmt
Import <- 'import' Dotted ('as' NameTok)? (',' Dotted ('as' NameTok)?)* / 'from' (('.' / '...')* Dotted / ('.' / '...')+) 'import' ('*' / '(' ImportAs (',' ImportAs)* ','? ')' / ImportAs (',' ImportAs)*)
ImportAs <- NameTok ('as' NameTok)?
Dotted <- NameTok ('.' NameTok)*
TypeAlias <- 'type' NameTok TypeParams? '=' Expr
ExprStmt <- Single ':' Expr ('=' Rhs)? / Single AUGOP Rhs / Targets* Rhs &(NEWLINE / ';')
Single <- Primary &(':' / AUGOP) / '(' Single ')'
Targets <- StarTarget (',' StarTarget)* ','? '='
StarTarget <- '*'? TargetAtom
TargetAtom <- Primary / '(' (StarTarget (',' StarTarget)* ','?)? ')' / '[' (StarTarget (',' StarTarget)* ','?)? ']'
Target <- TargetAtom
Rhs <- Yield / Exprs
Yield <- 'yield' ('from' Expr / Exprs)?
Exprs <- StarExpr (',' StarExpr)* ','?
StarExpr <- '*' BitOr / Named
Block <- NEWLINE INDENT Stmt+ DEDENT / Line
Compound <- If / While / For / Try / With / Def / Class / Match
If <- 'if' Named ':' Block ('elif' Named ':' Block)* ('else' ':' Block)?
While <- 'while' Named ':' Block ('else' ':' Block)?
For <- 'async'? 'for' ForTargets 'in' Exprs ':' Block ('else' ':' Block)?
ForTargets <- StarTarget (',' StarTarget)* ','?
Try <- 'try' ':' Block (Except+ ('else' ':' Block)? Finally? / Finally)
Except <- 'except' ('*'? Expr (',' Expr)* ('as' NameTok)?)? ':' Block
Finally <- 'finally' ':' Block
With <- 'async'? 'with' ('(' WithItem (',' WithItem)* ','? ')' ':' / WithItem (',' WithItem)* ':') Block
WithItem <- Expr ('as' StarTarget)?
Decorator <- '@' Named NEWLINE
Def <- Decorator* 'async'? 'def' NameTok TypeParams? '(' Params ')' ('->' Expr)? ':' Block
Class <- Decorator* 'class' NameTok TypeParams? ('(' Arguments? ')')? ':' Block
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- ('*' / '**')? NameTok (':' Expr)? ('=' Expr)?
Params <- (Param (',' Param)* ','?)?
Param <- '**' NameTok Ann? / '*' NameTok StarAnn? / '*' / '/' / NameTok Ann? ('=' Expr)?
StarAnn <- ':' '*'? Expr
Ann <- ':' Expr
LambdaParams <- (LambdaParam (',' LambdaParam)* ','?)?
LambdaParam <- '**' NameTok / '*' NameTok / '*' / '/' / NameTok ('=' Expr)?
Match <- 'match' Exprs ':' NEWLINE INDENT Case+ DEDENT
Case <- 'case' CasePattern ('if' Named)? ':' Block
CasePattern <- StarPat (',' StarPat)* ','?
StarPat <- '*' NameTok / AsPat
AsPat <- OrPat ('as' NameTok)?
OrPat <- ClosedPat ('|' ClosedPat)*
ClosedPat <- '-'? NUMBER (('+' / '-') NUMBER)? / Strings / 'None' / 'True' / 'False' / Dotted ('(' (PatArg (',' PatArg)* ','?)? ')')? / '(' (StarPat (',' StarPat)* ','?)? ')' / '[' (StarPat (',' StarPat)* ','?)? ']' / '{' (MapPat (',' MapPat)* ','?)? '}'
PatArg <- NameTok '=' AsPat / AsPat
MapPat <- '**' NameTok / ('-'? NUMBER / Strings / 'None' / 'True' / 'False' / Dotted) ':' AsPat
Named <- NameTok ':=' Expr / Expr !':='
Expr <= 'lambda' LambdaParams ':' Expr / Or ('if' Or 'else' Expr)?
Or <- Not (('and' / 'or') Not)*
Not <- 'not' Not / Comparison
Comparison <- BitOr (Compare BitOr)*
Compare <- COMPOP / 'in' / 'not' 'in' / 'is' 'not'?
BitOr <- Factor (ARITH Factor)*
Factor <- ('+' / '-' / '~') Factor / Power
Power <- 'await'? Primary ('**' Factor)?
Primary <= Atom ('.' NameTok / '(' Arguments? ')' / '[' Slices ']')*
Arguments <- Argument (',' Argument)* ','?
Argument <- '*' Expr / '**' Expr / NameTok '=' Expr / Named CompFor?
CompFor <- ('async'? 'for' ForTargets 'in' Or ('if' OrNamed)*)+
OrNamed <- NameTok ':=' Or / Or
Slices <- Slice (',' Slice)* ','?
Slice <- Expr? ':' Expr? (':' Expr?)? / StarExpr
Atom <- NameTok / NUMBER / Strings / 'None' / 'True' / 'False' / '...' / '(' (Yield / StarExpr CompFor / StarExpr (',' StarExpr)* ','?)? ')' / '[' (StarExpr CompFor / StarExpr (',' StarExpr)* ','?)? ']' / '{' (DictItem (CompFor / (',' DictItem)* ','?) / StarExpr (CompFor / (',' StarExpr)* ','?))? '}'
DictItem <- '**' BitOr / Expr ':' Expr
Strings <- STRING+
NameTok <- NAME / SOFT
"""


class _PyKinds(dict):
    def __init__(self, owner: Python) -> None:
        code = owner.tokens.code
        super().__init__({x: code(x) for x in [*_PY_KEYWORDS, *_PY_SOFT, *_PY_PUNCT]})
        self.fixed = len(self)
        self.kinds = code("NAME"), code("NUMBER"), code("STRING"), code("ERROR")

    def __missing__(self, token: str) -> str:
        name, number, string, error = self.kinds
        if token[-1] in "\"'":
            kind = string if len(token) > 1 else error
        elif token[0].isdigit() or token[0] == "." and len(token) > 1:
            kind = error if re.match(r"0\d*[1-9_]", token) and not re.search(r"[.eEjJ]", token) and token[1:2] not in "xXbBoO" else number
        elif token.isidentifier():
            kind = name
        else:
            kind = error
        if len(self) > 300_000:
            for k in list(self)[self.fixed :]:
                del self[k]
        self[token] = kind
        return kind


class _QuickKinds(dict):
    """Like _PyKinds for the line-wise lexer, whose tokens hold whole format strings and line breaks."""

    def __init__(self, owner: Python) -> None:
        super().__init__(owner.kind)
        self.owner, self[""] = owner, ""

    def __missing__(self, token: str) -> str:
        if token[0] == "\n" or token[0] == "\r" and len(token) > 1:
            kind = "\n"
        elif token[-1] in "\"'" and (m := _PY_FORMAT.match(token)):
            kind = self.owner.c["STRING"] if self.owner._fstring(token, m.end(), "r" in m.group().lower()) == len(token) else self.owner.c["ERROR"]
        else:
            kind = self.owner.kind[token]
        if len(self) > 300_000:
            self.clear()
            self.update(self.owner.kind)
            self[""] = ""
        self[token] = kind
        return kind


_PY_FORMAT = re.compile(r"(?:[rR]?[fFtT]|[fFtT][rR])(?=[\"'])")
#: the same tokens with format strings whole, where no quote of their own kind is nested in them
_PY_QUICK = re.compile(_PY_TOKEN.pattern.replace(_PY_HEAD + _PY_PREFIX, r"(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?"))
assert _PY_QUICK.pattern != _PY_TOKEN.pattern


class Python(Language):
    """Python 3."""

    def __init__(self) -> None:
        super().__init__("py")
        sets = {
            "AUGOP": "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split(),
            "COMPOP": "== != < > <= >=".split(),
            "ARITH": "| ^ & << >> + - * / // % @".split(),
            "SOFT": _PY_SOFT,
        }
        self.kind = _PyKinds(self)
        self.grammar = Grammar(_PY_GRAMMAR, self.tokens, "File", sets)
        code = self.tokens.code
        self.c = {x: code(x) for x in ("NEWLINE", "INDENT", "DEDENT", "STRING", "ERROR")}
        self.quick = _QuickKinds(self)
        self.brackets = [code(x) for x in "([{"], [code(x) for x in ")]}"]

    def lex(self, text, places=False):
        if not places and "\x00" not in text and (quick := self._quick(text)) is not None:
            return quick
        kinds: list[str] = []
        lines: list[int] = [0]
        at: list[int] = []
        kind, c = self.kind, self.c
        start = 1 if text[:1] == "﻿" else 0
        if "\x00" in text:
            return c["ERROR"] + END, [0, 1], [text.index("\x00"), len(text)]
        newline, indent, dedent, string, error = (c[x] for x in ("NEWLINE", "INDENT", "DEDENT", "STRING", "ERROR"))
        opened: list[str] = []
        levels = [0]
        waiting: str | None = ""  # the indentation of a line whose first token has not come
        first = re.compile(r"[ \t\f]*").match(text, start)
        waiting = first.group()
        i, n = first.end(), len(text)
        add, place = kinds.append, at.append
        closing = {")": "(", "]": "[", "}": "{"}
        scan = _PY_TOKEN.scanner(text, i)
        while True:
            m = scan.match()
            if m is None:
                break
            token = m.group(1)
            if not token:
                break
            head = token[0]
            if head == "\n" or head == "\r" and len(token) > 1:
                if opened:
                    continue
                if waiting is None:
                    add(newline)
                    place(m.start(1))
                waiting = token.lstrip("\r\n")
                continue
            if waiting is not None:
                width = 0
                for x in waiting:
                    width = width + 1 if x == " " else (width // 8 + 1) * 8 if x == "\t" else 0
                waiting = None
                if width != levels[-1]:
                    if width > levels[-1]:
                        levels.append(width)
                        add(indent)
                        place(m.start(1))
                    else:
                        while width < levels[-1]:
                            levels.pop()
                            add(dedent)
                            place(m.start(1))
                        if width != levels[-1]:
                            add(error)
                            place(m.start(1))
                lines.append(len(kinds))
            if token[-1] in "fFtTrR" and text[m.end() : m.end() + 1] in ("'", '"') and head in "fFtTrR" and len(token) <= 2:
                end = self._fstring(text, m.end(), "r" in token.lower())
                add(string if end > 0 else error)
                place(m.start(1))
                if end < 0:
                    break
                scan = _PY_TOKEN.scanner(text, end)
                continue
            if token in "([{":
                opened.append(token)
            elif token in ")]}":
                if not opened or opened.pop() != closing[token]:
                    add(error)
                    place(m.start(1))
                    break
            add(kind[token])
            place(m.start(1))
            if m.end() == m.start():
                break
        if opened:
            add(error)
            place(n)
        if waiting is None:
            add(newline)
            place(n)
        for _ in levels[1:]:
            add(dedent)
            place(n)
        if not lines or lines[-1] != len(kinds):
            lines.append(len(kinds))
        add(END)
        place(n)
        return "".join(kinds), sorted(set(lines)), at if places else None

    def _quick(self, text: str) -> tuple[str, list[int], None] | None:
        """Line by line instead of token by token; None where that does not do (uneven indentation, odd brackets, tabs,
        format strings that nest quotes, line ends within brackets before a dedent)."""
        tokens = _PY_QUICK.findall(text, 1 if text[:1] == "\ufeff" else 0)
        first = re.match(r"\ufeff?([ \t\f]*)", text).group(1)
        breaks = [x for x in tokens if x and (x[0] == "\n" or x[0] == "\r" and len(x) > 1)]
        parts = "".join(map(self.quick.__getitem__, tokens)).split("\n")
        newline, indent, dedent = self.c["NEWLINE"], self.c["INDENT"], self.c["DEDENT"]
        out: list[str] = []
        lines: list[int] = []
        levels, size, depth, pending = [0], 0, 0, ""
        opening, closing = self.brackets
        for white, part in zip([first, *breaks], parts):
            if not part:
                continue
            if depth:
                pending += part
            else:
                white = white.lstrip("\r\n")
                if "\t" in white or "\f" in white:
                    return None
                width = len(white)
                lead = ""
                if width != levels[-1]:
                    if width > levels[-1]:
                        levels.append(width)
                        lead = indent
                    else:
                        while width < levels[-1]:
                            levels.pop()
                            lead += dedent
                        if width != levels[-1]:
                            return None
                if lead:
                    out.append(lead)
                    size += len(lead)
                lines.append(size)
                pending = part
            for x in opening:
                depth += part.count(x)
            for x in closing:
                depth -= part.count(x)
            if depth < 0:
                return None
            if not depth:
                out.append(pending + newline)
                size += len(pending) + 1
        if depth or self.c["ERROR"] in "".join(out):
            return None
        out.append(dedent * (len(levels) - 1))
        size += len(levels) - 1
        if not lines or lines[0] != 0:
            lines.insert(0, 0)
        if lines[-1] != size:
            lines.append(size)
        return "".join(out) + END, lines, None

    def _fstring(self, text: str, i: int, raw: bool) -> int:
        """The end of a format string whose quote is at ``i``; -1 where it is malformed."""
        quote = text[i : i + 3] if text[i : i + 3] in ('"""', "'''") else text[i]
        i += len(quote)
        n = len(text)
        while i < n:
            x = text[i]
            if text.startswith(quote, i):
                return i + len(quote)
            if x == "\\":
                i += 2
            elif x == "\n" and len(quote) == 1:
                return -1
            elif text.startswith("{{", i) or text.startswith("}}", i):
                i += 2
            elif x == "{":
                i = self._hole(text, i + 1, quote)
                if i < 0:
                    return -1
            elif x == "}":
                return -1
            else:
                i += 1
        return -1

    def _hole(self, text: str, i: int, quote: str) -> int:
        """The end of a replacement field that begins before ``i``."""
        begin, depth, n = i, 0, len(text)
        while i < n:
            x = text[i]
            if x in "\"'":
                m = _PY_TOKEN.match(text, i)
                if not m or len(m.group(1)) < 2:
                    return -1
                i = m.end()
                continue
            if x in "([{":
                depth += 1
            elif x in ")]" or x == "}" and depth:
                depth -= 1
                if depth < 0:
                    return -1
            elif not depth and (x in "}:" or x == "!" and text[i + 1 : i + 2] != "="):
                break
            elif x == "\n" and len(quote) == 1:
                return -1
            i += 1
        else:
            return -1
        body = text[begin:i].rstrip()
        if body.endswith("=") and not body.endswith(("==", "!=", "<=", ">=")):
            body = body[:-1]
        if not body.strip() or not self._expression(body):
            return -1
        if text[i] == "!":
            if text[i + 1 : i + 2] not in ("r", "s", "a") or text[i + 2 : i + 3] not in (":", "}"):
                return -1
            i += 2
        if text[i] == ":":
            i += 1
            while i < n and text[i] != "}":
                if text[i] == "{":
                    i = self._hole(text, i + 1, quote)
                    if i < 0:
                        return -1
                elif text[i] == "\n" and len(quote) == 1 or text.startswith(quote, i):
                    return -1
                else:
                    i += 1
            if i >= n:
                return -1
        return i + 1

    def _expression(self, body: str) -> bool:
        from sedimark.llm.peg import _State

        kinds, _, _ = self.lex("(" + body + ")")
        key = ("hole", kinds)
        known = self.grammar.shared.get(key)
        if known is None:
            end = self.grammar.fast["r_Exprs"](_State([len(kinds)]), kinds, 0)
            known = self.grammar.shared[key] = end == len(kinds) - 2
        return known


# -- CSS ---------------------------------------------------------------------------------------------------------------

_CSS_TOKEN = re.compile(
    r"(?:\s|/\*(?:[^*]|\*(?!/))*\*/|<!--|-->)*+"
    r"(\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|url\(\s*[^\"'()\\\s]*(?:\\.[^\"'()\\\s]*)*\s*\)|@(?:--|-?(?:[A-Za-z_\u0080-\U0010ffff]|\\.))(?:[\w\u0080-\U0010ffff-]|\\.)*"
    r"|[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:%|(?:[A-Za-z_\u0080-\U0010ffff-]|\\.)(?:[\w-]|\\.)*)?|\#(?:[\w\u0080-\U0010ffff-]|\\.)+|(?:--|-?(?:[A-Za-z_\u0080-\U0010ffff]|\\.))(?:[\w\u0080-\U0010ffff-]|\\.)*|[~|^$*]=|::|!\s*important\b|[\s\S]|\Z)"
)
_CSS_GRAMMAR = r"""
Sheet <- (At / Rule)* END
At <- AT Prelude* (';' / '{' Inner* '}' / &END)
Prelude <- IDENT / NUMBER / STRING / HASH / URL / OP / ':' / '::' / ',' / '=' / '<' / '>' / '.' / '[' Prelude* ']' / '(' Prelude* ')'
Rule <- Selector+ '{' Inner* '}'
Selector <- IDENT / HASH / NUMBER / '.' / ':' / '::' / '>' / '+' / '~' / '*' / ',' / '&' / '|' / '[' (IDENT / '|' / '*')+ ((ATTROP / '=') (STRING / IDENT / NUMBER) IDENT?)? ']' / '(' ParenPart* ')'
ParenPart <- Selector / STRING / '-' / '%'
Inner <== ';' / Decl / At / Rule
Decl <- (IDENT / '*' IDENT) ':' Value+ IMPORTANT? (';' / &'}') / CUSTOM ':' Any* (';' / &'}')
Value <- IDENT / CUSTOM / NUMBER / STRING / HASH / URL / OP / ',' / '=' / ':' / '.' / '(' Value* ')' / '[' Value* ']' / IMPORTANT
Any <- Value / '{' (Any / ';')* '}' / '>' / '<' / AT / '&' / '!'
"""


class Css(Language):
    """Style sheets, strictly: every block closed, every declaration with a name, a colon and a value."""

    def __init__(self) -> None:
        super().__init__("css")
        sets = {"OP": ["/", "+", "-", "*", "%", "~", "|"], "ATTROP": ["~=", "|=", "^=", "$=", "*="], "IDENT": ["IDENT", "CUSTOM"]}
        punct = ["{", "}", "(", ")", "[", "]", ";", ":", "::", ",", ".", ">", "<", "=", "&", "!", *sets["OP"], *sets["ATTROP"]]
        code = self.tokens.code
        self.map = {x: code(x) for x in punct}
        self.k = {x: code(x) for x in ("IDENT", "CUSTOM", "NUMBER", "STRING", "HASH", "URL", "AT", "IMPORTANT", "ERROR")}
        self.grammar = Grammar(_CSS_GRAMMAR, self.tokens, "Sheet", sets)

    def classify(self, token: str) -> str:
        k, x = self.k, token[0]
        if x in "\"'":
            kind = "STRING" if len(token) > 1 else "ERROR"
        elif x == "@":
            kind = "AT" if len(token) > 1 else "ERROR"
        elif x == "#":
            kind = "HASH" if len(token) > 1 else "ERROR"
        elif x == "!":
            kind = "IMPORTANT"
        elif token.startswith("--"):
            kind = "CUSTOM" if len(token) > 2 else "ERROR"
        elif x.isdigit() or len(token) > 1 and x in "+-." and (token[1].isdigit() or token[1] == "."):
            kind = "NUMBER"
        elif token.startswith("url("):
            kind = "URL"
        elif x.isalpha() or x in "_-\\" or ord(x) > 127:
            kind = "IDENT" if len(token) > 1 or x not in "-\\" else "ERROR"
        else:
            kind = "ERROR"
        return k[kind]

    def lex(self, text, places=False):
        start = 1 if text[:1] == "﻿" else 0
        kinds, lines, at = [], [], []
        known, line_end = self.map, -1
        for m in _CSS_TOKEN.finditer(text, start):
            token = m.group(1)
            if not token:
                continue
            kind = known.get(token)
            if kind is None:
                kind = self.classify(token)
                if len(known) < 200_000:
                    known[token] = kind
            place = m.start(1)
            if place > line_end:
                lines.append(len(kinds))
                line_end = text.find("\n", place)
                if line_end < 0:
                    line_end = len(text)
            kinds.append(kind)
            at.append(place)
        lines.append(len(kinds))
        kinds.append(END)
        at.append(len(text))
        return "".join(kinds), lines, at if places else None


# -- HTML --------------------------------------------------------------------------------------------------------------

#: elements that have no end tag (fixed values of the HTML standard)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_HTML_TOKEN = re.compile(
    r"<!--(?:[^-]|-(?!->))*-->|<!DOCTYPE[^>]*>|<!\[CDATA\[[\s\S]*?\]\]>|<\?[^>]*>"
    r"|<(/?)([A-Za-z][^\s/>\x00\"'<=]*)((?:\s++|/(?!>)|[^\s\"'<>/=\x00]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'=<>`]++))?+)*+)(/?)>"
    r"|\{\{[\s\S]*?\}\}|[^<{]+|[\s\S]",
    re.I,
)
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "title")}
_HTML_GRAMMAR = r"""
Document <- Node* END
Node <- TEXT / VOID / Element
Element <- OPEN Node* CLOSE
"""


class Html(Language):
    """HTML with every element but the void ones closed. The lexer pairs names: an end tag that closes another element is an error."""

    def __init__(self) -> None:
        super().__init__("html")
        code = self.tokens.code
        self.k = {x: code(x) for x in ("TEXT", "VOID", "OPEN", "CLOSE", "ERROR")}
        self.grammar = Grammar(_HTML_GRAMMAR, self.tokens, "Document")

    def lex(self, text, places=False):
        k = self.k
        kinds, at = [], []
        names: list[str] = []
        i, n = (1 if text[:1] == "﻿" else 0), len(text)
        while i < n:
            m = _HTML_TOKEN.match(text, i)
            place, i = i, m.end()
            name = m.group(2)
            if name is None:
                kind = "ERROR" if m.group() == "<" else "TEXT"
                if kind == "TEXT" and kinds and kinds[-1] == k["TEXT"]:
                    continue
            elif m.group(1):
                kind = "CLOSE" if names and names.pop() == name.lower() and not m.group(3).strip() else "ERROR"
            elif name.lower() in VOID or m.group(4):
                kind = "VOID"
            elif (raw := _RAW_END.get(name.lower())) is not None:
                end = raw.search(text, i)
                kind = "VOID" if end else "ERROR"
                i = end.end() if end else n
            else:
                names.append(name.lower())
                kind = "OPEN"
            kinds.append(k[kind])
            at.append(place)
        kinds.append(END)
        at.append(n)
        return "".join(kinds), [0, len(kinds) - 1], at if places else None


# -- Prisma ------------------------------------------------------------------------------------------------------------

_PRISMA_TOKEN = re.compile(r"(?:[^\S\n]|//[^\n]*)*+(\n|\"(?:[^\"\\\n]|\\.)*\"|[A-Za-z][\w-]*|-?\d+(?:\.\d+)?|@@|[@{}()\[\],:=?.]|[\s\S]|\Z)")
_PRISMA_GRAMMAR = r"""
Schema <- NL* (Block NL*)* END
Block <- ('model' / 'type' / 'view') NameTok '{' NL+ (Field NL+)* '}' / 'enum' NameTok '{' NL+ (Value NL+)* '}' / ('datasource' / 'generator') NameTok '{' NL+ (Setting NL+)* '}' / 'model' NameTok '{' '}'
Field <== BlockAttr / NameTok FieldType Attr*
FieldType <- NameTok ('(' STRING ')')? ('?' / '[' ']' '?'?)?
Value <== BlockAttr / NameTok Attr*
Setting <== NameTok '=' Expr
Attr <- '@' AttrName CallArgs?
BlockAttr <- '@@' AttrName CallArgs?
AttrName <- NameTok ('.' NameTok)*
CallArgs <- '(' NL* (Arg (',' NL* Arg)* ','? NL*)? ')'
Arg <- NameTok ':' NL* Expr NL* / Expr NL*
Expr <- STRING / NUMBER / '[' NL* (Expr NL* (',' NL* Expr NL*)* ','? NL*)? ']' / AttrName CallArgs? 
NameTok <- NAME / 'model' / 'type' / 'view' / 'enum' / 'datasource' / 'generator'
"""


class Prisma(Language):
    """Prisma schemas."""

    def __init__(self) -> None:
        super().__init__("prisma")
        code = self.tokens.code
        self.map = {x: code(x) for x in ["model", "type", "view", "enum", "datasource", "generator", "@@", "@", "{", "}", "(", ")", "[", "]", ",", ":", "=", "?", "."]}
        self.map["\n"] = code("NL")
        self.k = {x: code(x) for x in ("NAME", "NUMBER", "STRING", "ERROR")}
        self.grammar = Grammar(_PRISMA_GRAMMAR, self.tokens, "Schema")

    def lex(self, text, places=False):
        start = 1 if text[:1] == "﻿" else 0
        kinds, lines, at = [], [0], []
        for m in _PRISMA_TOKEN.finditer(text, start):
            token = m.group(1)
            if not token:
                continue
            kind = self.map.get(token)
            if kind is None:
                x = token[0]
                kind = self.k["STRING" if x == '"' and len(token) > 1 else "NAME" if x.isalpha() else "NUMBER" if token[-1].isdigit() else "ERROR"]
            kinds.append(kind)
            at.append(m.start(1))
            if token == "\n":
                lines.append(len(kinds))
        if lines[-1] != len(kinds):
            lines.append(len(kinds))
        kinds.append(END)
        at.append(len(text))
        return "".join(kinds), lines, at if places else None


_LANGUAGES: dict[str, Language] = {}


def language(extension: str) -> Language | None:
    """The language of a file extension, built once per process; None where there is none."""
    if extension not in _LANGUAGES:
        make = {
            "py": Python,
            "js": lambda: EcmaScript("js", False, False),
            "jsx": lambda: EcmaScript("jsx", False, True),
            "ts": lambda: EcmaScript("ts", True, False),
            "tsx": lambda: EcmaScript("tsx", True, True),
            "css": Css,
            "html": Html,
            "prisma": Prisma,
        }.get(extension)
        if make is None:
            return None
        _LANGUAGES[extension] = make()
    return _LANGUAGES[extension]

"""Lexers and grammars of the source languages that problem 1 judges.

Each language is a token pattern, a table of token classes and an EBNF grammar
for :mod:`weirstone.llm.derivatives`.  Grammars only judge syntax; where a rule
would need names or types, both readings are followed.
"""

from __future__ import annotations

import functools
import re

from .derivatives import Grammar, run

_NUMBER = re.compile(
    r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO]?[0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)(?:[jJnLlUuFfDdri]|[uU]?[lL]{1,2}|[lL]{1,2}[uU])?\Z"
)


class Classes(dict):
    """Token text -> code; unknown texts are classified once."""

    LIMIT = 400_000

    def __init__(self, lang):
        super().__init__()
        self.lang = lang

    def __missing__(self, tok):
        if len(self) > self.LIMIT:
            self.clear()
        self[tok] = code = self.lang.classify(tok)
        return code


class Language:
    grammar_text = ""
    pairs = {"(": ")", "[": "]", "{": "}"}
    words: tuple = ()
    classes: tuple = ()
    merged: dict = {}
    pattern = ""
    expression = None

    def __init__(self):
        self.grammar = Grammar(self.grammar_text, self.pairs, self.words, self.classes)
        self.codes = self.grammar.codes
        self.regex = re.compile(self.pattern)
        self.table = Classes(self)

    def classify(self, tok):
        c = self.codes
        if tok in self.merged:
            return c[self.merged[tok]]
        if tok in c and not (tok.isupper() and tok in self.classes):
            return c[tok]
        x = tok[0]
        if x.isalpha() or x in "_$" and len(tok) >= 1 and (x == "_" or "$" in self.name_start):
            return c["ID"]
        if x.isdigit() or x == "." and len(tok) > 1 and tok[1].isdigit():
            return c["NUM"] if _NUMBER.match(tok) else self.grammar.bad
        return self.other(tok)

    name_start = ""

    def other(self, tok):
        return self.codes["STR"] if tok[0] in "\"'`" and len(tok) > 1 else self.grammar.bad

    def tokens(self, text):
        toks = self.regex.findall(text)
        while toks and not toks[-1]:
            toks.pop()
        return toks

    def check(self, text):
        """None if valid, else (failing token's index, token or None at the end)."""
        toks = self.tokens(text)
        at = self.judge(text, toks)
        if at is None:
            return None
        return at, toks[at] if any(t.strip() for t in toks[at:]) else None

    def judge(self, text, toks):
        return run(self.grammar, list(map(self.table.__getitem__, toks)))


# -- Python ------------------------------------------------------------------
_NL = 1 << 40


class Python(Language):
    pairs = {"(": ")", "[": "]", "{": "}", "INDENT": "DEDENT"}
    classes = ("NEWLINE", "ID", "NUM", "STR", "BIN", "AUG")
    merged = dict.fromkeys("/ // % & ^ << >> < > <= >= == != and or".split(), "BIN") | dict.fromkeys(
        "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split(), "AUG"
    ) | {"/": "/", "|": "|", "@": "@"}
    pattern = (
        r"(?:[ \t\f]|\\\r?\n)*+("
        r"(?:\#[^\n\r]*)?(?:\r\n?|\n)(?:[ \t\f]*(?:\#[^\n\r]*)?(?:\r\n?|\n))*[ \t]*(?:\#[^\n\r]*\Z)?|\#[^\n\r]*\Z|"
        r"[^\W\d]\w*(?![\w\"'])|"
        r"(?i:[rbuft]|br|rb|fr|rf|tr|rt)?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*+\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*+'|\"\"(?!\")|''(?!'))|"
        r"[^\W\d]\w*|"
        r"(?:0[xXbBoO]\w+|(?:\d|\.\d)(?:[\w.]|(?<=[eE])[+-])*)|"
        r"\*\*=?|//=?|>>=?|<<=?|->|:=|[-+*/%&|^@=!<>]=|\.\.\.|[-+*/%@&|^~<>()\[\]{},:;.=]|\Z|[\s\S])"
    )
    grammar_text = r"""
    file = stmt* ;
    stmt = simple | compound ;
    block = NEWLINE 'INDENT' stmt+ 'DEDENT' | simple ;
    simple = small (';' small)* ';'? NEWLINE ;
    name = ID | 'match' | 'case' | 'type' ;
    small = estmt | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (test ('from' test)?)?
          | 'global' name % ',' | 'nonlocal' name % ',' | 'del' targets | 'assert' test (',' test)?
          | 'import' modas % ','
          | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | impas % ',' | '(' impas % ',' ','? ')')
          | 'type' name tparams? '=' test ;
    modas = dotted ('as' name)? ;
    impas = name ('as' name)? ;
    dotted = name % '.' ;
    estmt = (targets '=')* (exprs | yield) | targets '=' (targets '=')* (exprs | yield) | tprim AUG (exprs | yield)
          | (tprim | '(' tprim ')') ':' test ('=' (exprs | yield))? ;
    exprs = exprel % ',' ','? ;
    exprel = named | '*' ortest ;
    targets = target % ',' ','? ;
    target = '*'? tprim ;
    tprim = name | 'await'? atom trailer* lasttrailer | '(' targets? ')' | '[' targets? ']' ;
    lasttrailer = '.' name | '[' subs ']' ;
    test = 'lambda' lparams? ':' test | ortest ('if' ortest 'else' test)? ;
    named = test | name ':=' test ;
    ortest = unary (binop unary)* ;
    binop = BIN | '/' | '|' | '@' | '-' | '+' | '*' | '**' | 'in' | 'not' 'in' | 'is' 'not'? ;
    unary = ('not' | '-' | '+' | '~')* 'await'? primary ;
    primary = atom trailer* ;
    trailer = '(' args? ')' | '[' subs ']' | '.' name ;
    atom = name | NUM | STR+ | '...' | 'None' | 'True' | 'False'
         | '(' (yield | exprel comp | exprel % ',' ','?)? ')' | '[' (exprel comp | exprel % ',' ','?)? ']'
         | '{' (dictel % ',' ','? | test ':' test comp | exprel comp | exprel % ',' ','?)? '}' ;
    dictel = test ':' test | '**' ortest ;
    comp = compfor+ ;
    compfor = 'async'? 'for' targets 'in' ortest ('if' (ortest | 'lambda' lparams? ':' test | name ':=' test))* ;
    args = arg % ',' ','? ;
    arg = named comp? | name '=' test | '*' test | '**' test ;
    subs = sub % ',' ','? ;
    sub = test? ':' test? (':' test?)? | named | '*' ortest ;
    yield = 'yield' ('from' test | exprs)? ;
    lparams = lparam % ',' ','? ;
    lparam = name ('=' test)? | '*' name? | '**' name | '/' ;
    params = param % ',' ','? ;
    param = name (':' test)? ('=' test)? | '*' (name (':' exprel)?)? | '**' name (':' test)? | '/' ;
    tparams = '[' tparam % ',' ','? ']' ;
    tparam = ('*' | '**')? name (':' test)? ('=' test)? ;
    compound = 'async'? (funcdef | withst | forst) | ifst | whilest | tryst | classdef | matchst
             | ('@' named NEWLINE)+ ('async'? funcdef | classdef) ;
    funcdef = 'def' name tparams? '(' params? ')' ('->' exprs)? ':' block ;
    classdef = 'class' name tparams? ('(' args? ')')? ':' block ;
    ifst = 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)? ;
    whilest = 'while' named ':' block ('else' ':' block)? ;
    forst = 'for' targets 'in' exprs ':' block ('else' ':' block)? ;
    withst = 'with' (withitem % ',' | '(' withitem % ',' ','? ')') ':' block ;
    withitem = test ('as' target)? ;
    tryst = 'try' ':' block ( ('except' (test ('as' name)?)? ':' block | 'except' '*' test ('as' name)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block ) ;
    matchst = 'match' exprs ':' NEWLINE 'INDENT' caseblk+ 'DEDENT' ;
    caseblk = 'case' pats ('if' named)? ':' block ;
    pats = pat % ',' ','? ;
    pat = '*' name | orpat ('as' name)? ;
    orpat = closed % '|' ;
    closed = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted ('(' (patarg % ',' ','?)? ')')?
           | '(' pats? ')' | '[' pats? ']' | '{' (mpat % ',' ','?)? '}' ;
    patarg = pat | name '=' pat ;
    mpat = ('-'? NUM | STR+ | dotted | 'None' | 'True' | 'False') ':' pat | '**' name ;
    """

    def classify(self, tok):
        x = tok[0]
        if x.isdigit() and (re.match(r"0[\d_]*[1-9][\d_]*\Z", tok) or tok[-1] in "lLnNuUrRiIdDfF" and tok[:2].lower() != "0x"):
            return self.grammar.bad
        if x in "\r\n#":
            w8 = w1 = 0
            line = re.split(r"[\r\n]", tok)[-1] if x != "#" or "\n" in tok or "\r" in tok else ""
            for ch in line.partition("#")[0]:
                w8, w1 = (w8 // 8 * 8 + 8, w1 + 1) if ch == "\t" else (w8 + 1, w1 + 1)
            return _NL + (w8 << 16) + w1
        if tok.startswith("!") and tok != "!=":
            return self.grammar.bad
        if len(tok) > 1 and tok[-1] in "\"'" and x not in "\"'":
            return self.codes["STR"]
        if tok in ("NEWLINE", "INDENT", "DEDENT"):
            return self.codes["ID"]
        return super().classify(tok)

    def judge(self, text, toks):
        g, table, dead = self.grammar, self.table, self.grammar.dead
        newline, indent, dedent = (self.codes[x] for x in ("NEWLINE", "INDENT", "DEDENT"))
        n_open, n_group = g.n_open, g.n_group
        s, frames, widths, codes = g.begin(), [], [0], list(map(table.__getitem__, toks))
        if toks and toks[0].startswith("﻿"):
            return 0
        i, n = 0, len(codes)
        while n and codes[n - 1] >= _NL:
            n -= 1
        if n and codes[0] < _NL and text[:1] in " \t":
            return 0
        for i in range(n):
            c = codes[i]
            if c >= _NL:
                if frames and frames[-1].closer != dedent:
                    continue
                if i:
                    s = s[newline]
                    if s is dead:
                        return i
                w = c - _NL
                if w != widths[-1]:
                    if w > widths[-1]:
                        if w >> 16 <= widths[-1] >> 16 or w & 65535 <= widths[-1] & 65535:
                            return i
                        nxt = s[indent]
                        if nxt is None:
                            return i
                        s = nxt[0]
                        frames.append(nxt[1])
                        widths.append(w)
                    else:
                        while widths[-1] > w:
                            widths.pop()
                            s = frames.pop()[s.tags]
                            if s is dead:
                                return i
                        if widths[-1] != w:
                            return i
            elif c >= n_group:
                s = s[c]
                if s is dead:
                    return i
            elif c < n_open:
                nxt = s[c]
                if nxt is None:
                    return i
                s = nxt[0]
                frames.append(nxt[1])
            else:
                if not frames or frames[-1].closer != c:
                    return i
                s = frames.pop()[s.tags]
                if s is dead:
                    return i
        if n:
            if frames and frames[-1].closer != dedent:
                return n
            s = s[newline]
        while frames and s is not dead:
            s = frames.pop()[s.tags]
        if not s.tags:
            return n
        for i, tok in enumerate(toks[:n]):
            if "{" in tok and len(tok) > 4 and tok[0] in "fFrR" and tok[-1] in "\"'" and "f" in tok[:2].lower():
                if not self.fstring(tok):
                    return i
        return None

    @functools.lru_cache(4096)  # noqa: B019 - one object per process
    def fstring(self, tok):
        """Whether an f-string's replacement fields hold expressions."""
        body = re.sub(r"^\w{1,2}('''|\"\"\"|'|\")([\s\S]*)\1$", r"\2", tok)
        depth, start = 0, 0
        i = 0
        while i < len(body):
            ch = body[i]
            if depth == 0 and ch in "{}" and body[i : i + 2] == ch * 2:
                i += 2
                continue
            if ch == "{":
                if depth == 0:
                    start = i + 1
                depth += 1
            elif ch == "}":
                depth -= 1
                if depth < 0:
                    return False
                if depth == 0 and not self.field(body[start:i]):
                    return False
            i += 1
        return depth == 0

    def field(self, src):
        for cut in [len(src), *(m.start() for m in re.finditer(r"=?\s*(?:![rsa])?\s*(?::|$)", src))]:
            toks = [t for t in self.tokens(src[:cut].strip()) if t[0] not in "\r\n"]
            if toks and run(self.grammar, [self.table[t] for t in toks], "exprs") is None:
                return True
        return False


# -- JavaScript and TypeScript ---------------------------------------------------
_JS_RESERVED = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while null true false enum".split()
_JS_SOFT = "as from of async get set static let yield await target".split()
_TS_SOFT = "type interface namespace module declare abstract readonly public private protected override implements keyof infer is asserts unique satisfies accessor out".split()

_JS_COMMON = r"""
    module = item* ;
    importclause = name | (name ',')? ('*' 'as' name | '{' (impspec % ',' ','?)? '}') ;
    modname = anyname | STR ;
    anyname = ID | anykw ;
    block = '{' stmt* '}' ;
    expr = assign % ',' ;
    xexpr = !{'{' 'function' 'class'} expr ;
    arrowbody = block | !{'{'} assign ;
    elems = (elem? ',')* elem? ;
    elem = '...'? assign ;
    binding = name | '{' (bprop % ',' ','?)? '}' | '[' (belem? ',')* belem? ']' ;
    bprop = name ('=' assign)? | propname ':' binding ('=' assign)? | '...' binding ;
    belem = '...'? binding ('=' assign)? ;
    propname = anyname | STR | NUM | PRIV | '[' assign ']' ;
    args = (elem % ',' ','?)? ;
    cond = binary ('?' assign ':' assign)? ;
    binop = BIN | '+' | '-' | '*' | '<' | '>' ('>' '>'?)? | 'in' | 'instanceof' | '|' | '&' ;
    ASGN = ASG | '=' | '>' '>' '>'? GEASG ;
    postfix = lhs ('++' | '--')? ;
    unop = '+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' ;
    elseif = ('else' stmt)? ;
"""

_JS_STMTS = r"""
    stmt = block | ';' | vardecl ';' | func | class | 'if' '(' expr ')' stmt ('else' stmt)?
         | 'for' 'await'? '(' (xexpr? ';' | vardecl ';') expr? ';' expr? ')' stmt
         | 'for' 'await'? '(' (fordecl | lhs) ('in' | 'of') expr ')' stmt
         | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'? | 'continue' ID? ';' | 'break' ID? ';'
         | 'return' expr? ';' | 'throw' expr ';'
         | 'try' block ('catch' ('(' catchparam ')')? block ('finally' block)? | 'finally' block)
         | 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' stmt*)* '}' | 'debugger' ';' | name ':' stmt | xexpr ';' EXTRA ;
"""


class JavaScript(Language):
    name_start = "$"
    classes = ("ID", "NUM", "STR", "TPL", "REGEX", "PRIV", "BIN", "ASG", "GEASG")
    words = tuple(_JS_RESERVED + _JS_SOFT)
    merged = dict.fromkeys("/ % ** ^ << == != === !== <= && || ??".split(), "BIN") | dict.fromkeys(
        "+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split(), "ASG"
    ) | {">=": "GEASG"}
    soft = _JS_SOFT
    expression = "expr"
    pattern = (
        r"(?:\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)*+("
        r"[#@]?(?:[^\W\d]|\$)[\w$]*|"
        r"(?:(?<=[=(,:;!&|?{\[~^+*%<>\-])|(?<=[=(,:;!&|?{\[] )|(?<=return )|(?<=\n)|(?<=  )|(?<=\t))/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])+/\w*|"
        r"\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}`]*\}|`[^`]*`)*+\})*+`|"
        r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?(?:[A-Za-z_$][\w$]*)?|"
        r"=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|\*\*=?|<<=?|[=!]==?|[<>]=|\+\+|--|[-+*/%&|^]=|[-+*/%&|^!~?:=.,;<>(){}\[\]@]|\Z|[\s\S])"
    )
    grammar_text = (
        _JS_COMMON.replace("ASGN = ASG", "asgn = ASG").replace("binop = BIN", "binop = BIN | GEASG")
        + r"""
    item = 'import' (STR | importclause 'from' STR) (('with') '{' (modname ':' STR) % ',' ','? '}')? ';'
         | 'export' ('default' (func0 | class0 | !{'function' 'class'} assign ';') | vardecl ';' | func | class
            | '*' ('as' modname)? 'from' STR ';' | '{' (impspec % ',' ','?)? '}' ('from' STR)? ';') | stmt ;
    impspec = modname ('as' modname)? ;
    name = ID | """
        + " | ".join(f"'{w}'" for w in _JS_SOFT if w not in ("yield", "await"))
        + r""" ;
    vardecl = ('var' | 'let') vdecl % ',' | 'const' cdecl % ',' ;
    vdecl = binding ('=' assign)? ;
    cdecl = binding '=' assign ;
    fordecl = ('var' | 'let' | 'const') binding ;
    catchparam = binding ;
    func = 'async'? 'function' '*'? name '(' params ')' block ;
    func0 = 'async'? 'function' '*'? name? '(' params ')' block ;
    params = (belem % ',' ','?)? ;
    class = 'class' name classtail ;
    class0 = 'class' name? classtail ;
    classtail = ('extends' lhs)? '{' member* '}' ;
    member = ';' | 'static' block | 'static'? 'async'? '*'? ('get' | 'set')? propname '(' params ')' block | 'static'? propname ('=' assign)? ';' ;
    assign = arrow | 'yield' ('*'? assign)? | lhs asgn assign | cond ;
    arrow = 'async'? (name | '(' params ')') '=>' arrowbody ;
    binary = unary (binop unary)* ;
    unary = unop* postfix ;
    lhs = 'new'* primary suffix* ;
    suffix = '.' (anyname | PRIV) | '?.' (anyname | '(' args ')' | '[' expr ']' | PRIV) | '[' expr ']' | '(' args ')' | TPL ;
    primary = name | NUM | STR | TPL | REGEX | PRIV | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | '[' elems ']'
            | '{' (prop % ',' ','?)? '}' | func0 | class0 | 'import' ('(' args ')' | '.' name) ;
    prop = '...' assign | propname ':' assign | name ('=' assign)? | ('get' | 'set')? 'async'? '*'? propname '(' params ')' block ;
    """
        + _JS_STMTS.replace(" EXTRA", "")
    )

    def __init__(self):
        super().__init__()
        self.grammar.semi = self.codes[";"]
        self._strict = {self.codes[w] for w in ("return", "break", "continue", "throw", "yield") if w in self.codes}

    def classify(self, tok):
        if tok[0] == "0" and re.match(r"0\d+\Z", tok):
            return self.grammar.bad
        return super().classify(tok)

    def other(self, tok):
        x = tok[0]
        if x == "/" and len(tok) > 2:
            return self.codes["REGEX"]
        if x == "#" and len(tok) > 1:
            return self.codes["PRIV"]
        if x == "`":
            return self.codes["TPL"] if len(tok) > 1 else self.grammar.bad
        return super().other(tok)

    def judge(self, text, toks):
        if toks and toks[0] == "#" and text.startswith("#!"):
            text = "//" + text
            toks[:] = self.tokens(text)
        codes, lines = list(map(self.table.__getitem__, toks)), []

        def repair(at, closing):
            if closing and toks[at] == "}":
                return True
            if not lines:
                ends = [(m.start(1), m.end(1)) for m in self.regex.finditer(text)]
                lines.extend(i > 0 and "\n" in text[ends[i - 1][1] : ends[i][0]] for i in range(len(toks)))
            return lines[at] or toks[at] == "}"

        at = run(self.grammar, codes, None, repair)
        if at is None:
            for i, tok in enumerate(toks):
                if tok[0] == "`" and "${" in tok and not self.template(tok):
                    return i
        return at

    @functools.lru_cache(4096)  # noqa: B019
    def template(self, tok):
        """Whether a template's substitutions are expressions."""
        i = 1
        while i < len(tok) - 1:
            if tok[i] == "\\":
                i += 2
            elif tok.startswith("${", i):
                depth, j = 1, i + 2
                while depth and j < len(tok):
                    depth += (tok[j] == "{") - (tok[j] == "}")
                    j += 1
                toks = self.tokens(tok[i + 2 : j - 1])
                if depth or run(self.grammar, [self.table[t] for t in toks], "expr") is not None:
                    return False
                i = j
            else:
                i += 1
        return True


class TypeScript(JavaScript):
    words = tuple(_JS_RESERVED + _JS_SOFT + _TS_SOFT)
    grammar_text = (
        _JS_COMMON.replace("ASGN = ASG", "asgn = ASG").replace("binop = BIN", "binop = BIN | GEASG")
        + r"""
    item = decorator* 'import' 'type'? (STR | importclause 'from' STR) (('with') '{' (modname ':' STR) % ',' ','? '}')? ';'
         | 'import' name '=' (name '(' STR ')' | name % '.') ';'
         | decorator* 'export' ('default' (func0 | decorator* 'abstract'? class0 | interface | !{'function' 'class'} assign ';') | vardecl ';' | func | decorator* 'abstract'? class | tsdecl
            | '*' ('as' modname)? 'from' STR ';' | 'type'? '{' (impspec % ',' ','?)? '}' ('from' STR)? ';' | '=' assign ';' | 'as' 'namespace' name ';') | stmt ;
    impspec = 'type'? modname ('as' modname)? ;
    name = ID | """
        + " | ".join(f"'{w}'" for w in _JS_SOFT + _TS_SOFT if w not in ("yield", "await"))
        + r""" ;
    decorator = '@' lhs | DECO ('.' name)* ('(' args ')')? ;
    vardecl = ('var' | 'let') vdecl % ',' | 'const' cdecl % ',' ;
    vdecl = binding '!'? (':' type)? ('=' assign)? ;
    cdecl = binding (':' type)? ('=' assign)? ;
    fordecl = ('var' | 'let' | 'const') binding (':' type)? ;
    catchparam = binding (':' type)? ;
    sig = tparams? '(' params ')' (':' rettype)? ;
    func = 'async'? 'function' '*'? name sig (block | ';') ;
    func0 = 'async'? 'function' '*'? name? sig (block | ';') ;
    params = (param % ',' ','?)? ;
    param = decorator* mod* '...'? (binding | 'this') '?'? (':' type)? ('=' assign)? ;
    mod = 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'static' | 'abstract' | 'declare' | 'accessor' ;
    class = 'class' name classtail ;
    class0 = 'class' name? classtail ;
    classtail = tparams? ('extends' lhs)? ('implements' type % ',')? '{' member* '}' ;
    member = ';' | 'static' block | decorator* mod* 'async'? '*'? ('get' | 'set')? propname ('?' | '!')? sig (block | ';')
           | decorator* mod* propname ('?' | '!')? (':' type)? ('=' assign)? ';' | mod* '[' name ':' type ']' ':' type ';' ;
    tsdecl = 'declare'? (interface | 'type' name tparams? '=' type ';' | 'const'? 'enum' name '{' (enumel % ',' ','?)? '}'
           | ('namespace' | 'module') (name % '.' | STR) '{' item* '}' | 'abstract'? class) | 'declare' (func | vardecl ';' | 'global' block) ;
    interface = 'interface' name tparams? ('extends' type % ',')? objtype ;
    enumel = propname ('=' assign)? ;
    objtype = '{' (tmember (';' | ','))* tmember? '}' ;
    tmember = 'readonly'? propname '?'? (':' type)? | ('get' | 'set')? propname '?'? sig | 'new'? sig
            | (('-' | '+')? 'readonly')? '[' name (':' type | 'in' type ('as' type)?) ']' (('-' | '+')? '?')? ':' type ;
    tparams = '<' tparam % ',' ','? '>' ;
    tparam = ('const' | 'in' | 'out')* name ('extends' type)? ('=' type)? ;
    targs = '<' type % ',' ','? '>' ;
    rettype = type | 'asserts'? (name | 'this') 'is' type | 'asserts' name ;
    type = tfunc | utype ('extends' utype '?' type ':' type)? ;
    tfunc = 'abstract'? 'new'? tparams? '(' params ')' '=>' rettype ;
    utype = ('|' | '&')? tpost (('|' | '&') tpost)* ;
    tpost = ('keyof' | 'readonly' | 'unique' | 'infer')* tprim ('[' type? ']')* ;
    tprim = (name | 'this') ('.' anyname)* targs? | 'typeof' (name | 'this' | 'import' '(' STR ')') ('.' anyname)* targs? | STR | '-'? NUM | 'true' | 'false' | 'null' | 'void' | TPL
          | objtype | '[' (tuplel % ',' ','?)? ']' | '(' type ')' | 'import' '(' STR ')' ('.' name)* targs? ;
    tuplel = '...'? (name '?'? ':')? type '?'? ;
    assign = arrow | 'yield' ('*'? assign)? | lhs asgn assign | cond ;
    arrow = 'async'? (name | sig) '=>' arrowbody ;
    binary = unary (binop unary | ('as' | 'satisfies') ('const' | type))* ;
    unary = (unop | targs)* postfix ;
    lhs = 'new'* primary suffix* ;
    suffix = '.' (anyname | PRIV) | '?.' (anyname | targs? '(' args ')' | '[' expr ']' | PRIV) | '[' expr ']' | targs? '(' args ')' | TPL | '!' ;
    primary = name | NUM | STR | TPL | REGEX | PRIV | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | '[' elems ']'
            | '{' (prop % ',' ','?)? '}' | func0 | class0 | 'import' ('(' args ')' | '.' name) ;
    prop = '...' assign | propname ':' assign | name ('=' assign)? | ('get' | 'set')? 'async'? '*'? propname sig block ;
    """
        + _JS_STMTS.replace(" EXTRA", "| tsdecl | decorator+ 'abstract'? class | 'abstract' class")
    )
    classes = (*JavaScript.classes, "DECO")

    def other(self, tok):
        return self.codes["DECO"] if tok[0] == "@" and len(tok) > 1 else super().other(tok)


# -- Java ------------------------------------------------------------------------
class Java(Language):
    name_start = "$"
    classes = ("ID", "NUM", "STR", "MOD", "PRIM", "BIN", "ASG", "GEASG")
    merged = dict.fromkeys("public private protected abstract native synchronized_ transient volatile strictfp sealed".split(), "MOD") | dict.fromkeys(
        "int long short byte char boolean float double".split(), "PRIM"
    ) | dict.fromkeys("/ % ^ << == != <= && || |".split(), "BIN") | dict.fromkeys("+= -= *= /= %= <<= &= |= ^=".split(), "ASG") | {">=": "GEASG"}
    pattern = (
        r"(?:\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)*+("
        r"(?:[^\W\d]|\$)[\w$]*|"
        r"\"\"\"[ \t]*\r?\n(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\u+[\da-fA-F]{4}|\\[0-7]{1,3}|\\.)'|"
        r"(?:0[xXbB])?(?:\d|\.\d)(?:[\w.]|(?<=[eEpP])[+-])*|"
        r"->|::|\.\.\.|&&|\|\||<<=?|[=!]=|[<>]=|\+\+|--|[-+*/%&|^]=|[-+*/%&|^!~?:=.,;<>(){}\[\]@]|\Z|[\s\S])"
    )
    grammar_text = r"""
    unit = (annotation* 'package' qname ';')? ('import' 'static'? qname ('.' '*')? ';' | ';')* (typedecl | ';')* ;
    qname = ID % '.' ;
    mod = MOD | 'static' | 'final' | 'default' | 'synchronized' | annotation ;
    annotation = '@' qname ('(' annargs ')')? ;
    annargs = (annarg % ',')? ;
    annarg = (ID '=')? annval ;
    annval = cond | annotation | '{' (annval % ',' ','?)? '}' ;
    typedecl = mod* typebody ;
    typebody = 'class' ID tparams? ('extends' type)? ('implements' type % ',')? (ID type % ',')? body
             | 'interface' ID tparams? ('extends' type % ',')? (ID type % ',')? body
             | '@' 'interface' ID body
             | 'enum' ID ('implements' type % ',')? '{' (enumel % ',')? ','? (';' member*)? '}'
             | ID ID tparams? '(' params ')' ('implements' type % ',')? body ;
    enumel = annotation* ID ('(' args ')')? body? ;
    body = '{' member* '}' ;
    member = ';' | 'static'? block | mod* typebody
           | mod* tparams? (type | 'void') ID '(' params ')' dims ('throws' type % ',')? (block | ';' | 'default' annval ';')
           | mod* tparams? ID '(' params ')' ('throws' type % ',')? block | mod* ID block | mod* type declr % ',' ';' ;
    dims = ('[' ']')* ;
    declr = ID dims ('=' vinit)? ;
    vinit = expr | '{' (vinit % ',' ','?)? '}' ;
    params = (param % ',')? ;
    param = mod* type '...'? (ID | 'this') dims ;
    type = annotation* (PRIM | ID targs? ('.' ID targs?)*) dims ;
    targs = '<' (targ % ',')? '>' ;
    targ = type | annotation* '?' (('extends' | 'super') type)? ;
    tparams = '<' tparam % ',' '>' ;
    tparam = annotation* ID ('extends' type ('&' type)*)? ;
    block = '{' bstmt* '}' ;
    bstmt = mod* type declr % ',' ';' | mod* typebody | stmt ;
    stmt = block | ';' | sexpr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
         | 'for' '(' ((sexpr % ',')? | mod* type declr % ',') ';' expr? ';' (sexpr % ',')? ')' stmt
         | 'for' '(' mod* type ID ':' expr ')' stmt | 'return' expr? ';' | 'throw' expr ';' | 'break' ID? ';' | 'continue' ID? ';'
         | 'assert' expr (':' expr)? ';' | 'synchronized' '(' expr ')' block | ID ':' stmt | switch | ID expr ';'
         | 'try' ('(' resource % ';' ';'? ')' block (catch)* ('finally' block)? | block (catch+ ('finally' block)? | 'finally' block)) ;
    resource = mod* type ID '=' expr | postfix ;
    catch = 'catch' '(' mod* type ('|' type)* ID ')' block ;
    switch = 'switch' '(' expr ')' '{' ((label ':')+ bstmt* | label '->' (expr ';' | block | 'throw' expr ';'))* '}' ;
    label = 'case' caselabel % ',' ('when' expr)? | 'default' ;
    caselabel = cond | mod* type ID | 'default' | pattern ;
    pattern = mod* type (ID | '(' (pattern % ',')? ')' ID?) ;
    sexpr = lhs asgn expr | ('++' | '--') postfix | postfix ('++' | '--') | primary suffix* call | 'new' creator suffix* ;
    call = '(' args ')' ;
    args = (expr % ',')? ;
    expr = lambda | lhs asgn expr | cond ;
    asgn = ASG | '=' | '>' '>'? GEASG ;
    lambda = (ID | '(' (ID % ',' | params) ')') '->' (block | expr) ;
    cond = binary ('?' expr ':' (cond | lambda))? ;
    binary = unary (binop unary | 'instanceof' (mod* type ID? | pattern))* ;
    binop = BIN | GEASG | '+' | '-' | '*' | '<' | '&' | '>' ('>' '>'?)? ;
    unary = ('+' | '-' | '!' | '~' | '++' | '--')* (postfix | '(' type ('&' type)* ')' (unary | lambda)) ;
    postfix = lhs ('++' | '--')* ;
    lhs = primary suffix* ;
    suffix = '.' (targs? (ID | 'super') | 'class' | 'this' | 'new' creator) | '[' expr ']' | '(' args ')' | '::' targs? (ID | 'new') ;
    primary = ID | NUM | STR | 'true' | 'false' | 'null' | 'this' | 'super' | '(' expr ')' | 'new' creator | (PRIM | 'void') dims '.' 'class' | type ('::' 'new' | '.' 'class') | switch | type '::' ID ;
    creator = annotation* (PRIM | ID targs? ('.' ID targs?)*) ( '(' args ')' body? | ('[' expr ']')+ dims | ('[' ']')+ '{' (vinit % ',' ','?)? '}' ) ;
    """

    def classify(self, tok):
        if tok == "|":
            return self.codes["|"]
        if tok == "when":
            return self.codes["ID"]
        return super().classify(tok)

    def other(self, tok):
        return self.codes["STR"] if tok[0] in "\"'" and len(tok) > 1 else self.grammar.bad


Java.grammar_text = Java.grammar_text.replace("binop = BIN |", "binop = BIN | '|' |").replace("('when' expr)?", "(ID expr)?")


# -- Go ------------------------------------------------------------------------------
class Go(Language):
    classes = ("ID", "NUM", "STR", "BIN", "ASG")
    merged = dict.fromkeys("/ % | << >> &^ == != < <= > >= && ||".split(), "BIN") | dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>= &^=".split(), "ASG")
    pattern = (
        r"(?:[ \t\r\f\v]+|//[^\n]*|/\*(?:[^*\n]|\*(?!/))*+\*/)*+("
        r"\n(?:\s+|//[^\n]*\n)*+|/\*(?:[^*]|\*(?!/))*+\*/|[^\W\d]\w*|"
        r"\"(?:[^\"\\\n]|\\.)*+\"|`[^`]*`|'(?:[^'\\\n]|\\(?:[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|.))'|"
        r"(?:0[xX])?(?:\d|\.\d)(?:[\w.]|(?<=[eEpP])[+-])*|"
        r"\.\.\.|<-|:=|\+\+|--|&\^=?|<<=?|>>=?|&&|\|\||[-+*/%&|^=!<>]=|[-+*/%&|^~!?:=.,;<>(){}\[\]]|\Z|[\s\S])"
    )
    grammar_text = r"""
    file = 'package' ID ';' ('import' (impspec | '(' (impspec ';')* impspec? ')') ';')* (topdecl ';')* ;
    impspec = (ID | '.')? STR ;
    topdecl = decl | func ;
    decl = 'var' (vspec | '(' (vspec ';')* vspec? ')') | 'const' (cspec | '(' (cspec ';')* cspec? ')') | 'type' (tspec | '(' (tspec ';')* tspec? ')') ;
    vspec = ID % ',' (type ('=' exprs)? | '=' exprs) ;
    cspec = ID % ',' (type? '=' exprs)? ;
    tspec = ID ('[' tparam % ',' ','? ']')? '='? type ;
    tparam = ID % ',' constraint ;
    constraint = '~'? type (BIN '~'? type)* ;
    func = 'func' ('(' params ')')? ID ('[' tparam % ',' ','? ']')? '(' params ')' result? block? ;
    result = type | '(' params ')' ;
    params = (param % ',' ','?)? ;
    param = ID '...'? type | '...'? type ;
    type = ID ('.' ID)? ('[' type % ',' ','? ']')? | '*' type | '(' type ')' | littype ;
    littype = '[' ('...' | expr)? ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' '(' params ')' result?
            | 'struct' '{' (field ';')* field? '}' | 'interface' '{' (ielem ';')* ielem? '}' ;
    field = (ID % ',' type | '*'? type) STR? ;
    ielem = ID '(' params ')' result? | constraint ;
    block = '{' stmts '}' ;
    stmts = (stmt? ';')* stmt? ;
    stmt = decl | simple | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | block | if | for | 'go' expr | 'defer' expr | ID ':' stmt?
         | 'switch' (simple? ';')? simple? '{' (('case' texprs | 'default') ':' stmts)* '}'
         | 'select' '{' (('case' simple | 'default') ':' stmts)* '}' ;
    simple = exprs (('=' | ':=' | ASG) exprs)? | expr ('++' | '--') | expr '<-' expr ;
    if = 'if' (simple? ';')? expr block ('else' (if | block))? ;
    for = 'for' (block | expr block | simple? ';' expr? ';' simple? block | (exprs ('=' | ':='))? 'range' expr block) ;
    exprs = expr % ',' ;
    texprs = texpr % ',' ;
    texpr = expr | type ;
    expr = unary (binop unary)* ;
    binop = BIN | '+' | '-' | '*' | '^' | '&' ;
    unary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* primary ;
    primary = operand suffix* ;
    suffix = '.' ID | '.' '(' (type | 'type') ')' | '[' index ']' | '(' args ')' | lit ;
    index = texpr % ',' ','? | expr? ':' expr? (':' expr)? ;
    args = (arg % ',' ','?)? ;
    arg = texpr '...'? ;
    lit = '{' (el % ',' ','?)? '}' ;
    el = (elv ':')? elv ;
    elv = expr | lit ;
    operand = ID | NUM | STR | '(' texpr ')' | 'func' '(' params ')' result? block | littype ;
    """

    def __init__(self):
        super().__init__()
        self.codes["\n"] = self.nl = -1
        names = "ID NUM STR ) ] } break continue fallthrough return ++ --".split()
        self.enders = {self.codes[x] for x in names}

    def classify(self, tok):
        if tok[0] == "\n" or tok.startswith("/*"):
            return -1
        return super().classify(tok)

    def judge(self, text, toks):
        semi, enders, prev = self.codes[";"], self.enders, -2
        codes, places = [], []
        for i, c in enumerate(map(self.table.__getitem__, toks)):
            if c == -1:
                if prev not in enders or toks[i][0] == "/" and "\n" not in toks[i]:
                    continue
                c = semi
            codes.append(c)
            places.append(i)
            prev = c
        if prev in enders:
            codes.append(semi)
            places.append(len(toks))
        at = run(self.grammar, codes)
        return at if at is None else places[at] if at < len(places) else len(toks)


# -- C --------------------------------------------------------------------------------
class C(Language):
    name_start = "$"
    classes = ("ID", "NUM", "STR", "SPEC", "BIN", "ASG")
    merged = dict.fromkeys(
        "int char void long short unsigned signed float double const volatile static extern register inline restrict _Bool auto typedef __inline __inline__ __restrict _Noreturn _Thread_local".split(), "SPEC"
    ) | dict.fromkeys("/ % | ^ << >> < > <= >= == != && ||".split(), "BIN") | dict.fromkeys("+= -= *= /= %= <<= >>= &= |= ^=".split(), "ASG")
    pattern = (
        r"(?:(?m:^)[ \t]*\#(?:[^\\\n]|\\[\s\S])*+|[ \t\r\f\v]+|\n|//(?:[^\\\n]|\\[\s\S])*+|/\*(?:[^*]|\*(?!/))*+\*/)*+("
        r"(?:L|u8?|U)?\"(?:[^\"\\\n]|\\[\s\S])*+\"|(?:L|u|U)?'(?:[^'\\\n]|\\.)++'|(?:[^\W\d]|\$)[\w$]*|"
        r"(?:\d|\.\d)(?:[\w.]|(?<=[eEpP])[+-])*|"
        r"\.\.\.|->|\+\+|--|<<=?|>>=?|&&|\|\||[-+*/%&|^=!<>]=|[-+*/%&|^~!?:=.,;<>(){}\[\]]|\Z|[\s\S])"
    )
    grammar_text = r"""
    unit = ext* ;
    ext = ';' | decl | spec+ declr decl* block | declr block ;
    decl = spec+ (initdeclr % ',')? ';' | '_Static_assert' '(' args ')' ';' ;
    spec = SPEC | ID | attr | ('struct' | 'union') attr? (ID | ID? '{' field* '}') | 'enum' (ID | ID? '{' enumel % ',' ','? '}') | 'typeof' '(' (expr | typename) ')' ;
    attr = '__attribute__' '(' '(' args ')' ')' ;
    field = spec+ (fdeclr % ',')? ';' | ';' ;
    fdeclr = declr? (':' cond)? attr? ;
    enumel = ID ('=' cond)? ;
    initdeclr = declr attr? ('=' init)? ;
    init = assign | '{' (initel % ',' ','?)? '}' ;
    initel = (('[' cond ('...' cond)? ']' | '.' ID)+ '=')? init ;
    ptr = '*' (SPEC | attr)* ;
    declr = ptr* (ID | '(' attr? declr ')') dsuffix* ;
    dsuffix = '[' SPEC* (assign | '*')? ']' | '(' params? ')' ;
    absdeclr = ptr+ absdir? | absdir ;
    absdir = dsuffix+ | '(' absdeclr ')' dsuffix* ;
    params = param % ',' (',' '...')? | ID % ',' ;
    param = spec+ (declr | absdeclr)? ;
    typename = spec+ absdeclr? ;
    block = '{' (stmt | decl | func)* '}' ;
    func = spec+ declr block ;
    stmt = block | expr? ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
         | 'for' '(' (expr? ';' | decl) expr? ';' expr? ')' stmt | 'switch' '(' expr ')' stmt | 'case' cond ('...' cond)? ':' stmt? | 'default' ':' stmt?
         | ID ':' stmt? | 'goto' ID ';' | 'break' ';' | 'continue' ';' | 'return' expr? ';' ;
    expr = assign % ',' ;
    assign = unary ('=' | ASG) assign | cond ;
    cond = binary ('?' expr? ':' cond)? ;
    binary = unary (binop unary)* ;
    binop = BIN | '+' | '-' | '*' | '&' ;
    unary = ('++' | '--' | '&' | '*' | '+' | '-' | '~' | '!' | '&&')* (postfix | 'sizeof' (unary | '(' typename ')') | '_Alignof' '(' typename ')' | '(' typename ')' unary) ;
    postfix = primary suffix* ;
    suffix = '[' expr ']' | '(' args ')' | ('.' | '->') ID | '++' | '--' ;
    args = (arg % ',')? ;
    arg = assign | typename ;
    primary = ID | NUM | (STR | ID)* STR (STR | ID)* | '(' expr ')' | '(' typename ')' '{' (initel % ',' ','?)? '}' | '(' block ')'
            | '_Generic' '(' assign ',' ((typename | 'default') ':' assign) % ',' ')' ;
    """.replace("((typename | 'default') ':' assign) % ',' ')'", "gassoc % ',' ')'") + " gassoc = (typename | 'default') ':' assign ; "
    directives = re.compile(r"(?m)^[ \t]*\#[ \t]*(\w*)[ \t]*([^\n]*)")
    known = frozenset("if ifdef ifndef elif elifdef elifndef else endif define undef include include_next import pragma error warning line ident".split())

    def classify(self, tok):
        if tok[0] in "LuU" and tok[-1] in "\"'" and len(tok) > 2:
            return self.codes["STR"]
        return super().classify(tok)

    def other(self, tok):
        return self.codes["STR"] if tok[0] in "\"'" and len(tok) > 1 else self.grammar.bad

    def judge(self, text, toks):
        if "#" in text:
            bare = re.sub(r"/\*(?:[^*]|\*(?!/))*+\*/|\"(?:[^\"\\\n]|\\.)*+\"", lambda m: "\n" * m[0].count("\n") if m[0][0] == "/" else m[0], text) if "/*" in text else text
            depth = 0
            for word, rest in self.directives.findall(bare):
                if word and word not in self.known or word.startswith("include") and not re.match(r"<[^>]+>|\"[^\"]+\"|\w", rest) or word in ("define", "ifdef", "ifndef", "undef") and not re.match(r"[^\W\d]\w*", rest):
                    return len(toks)
                depth += word in ("if", "ifdef", "ifndef")
                depth -= word == "endif"
                if depth < 0 or depth < 1 and word in ("else", "elif"):
                    return len(toks)
            if depth:
                return len(toks)
        return super().judge(text, toks)


# -- Ruby ------------------------------------------------------------------------------
_RB_OPEN = "def class module if unless while until for case begin do_block".split()


class Ruby(Language):
    pairs = {"(": ")", "[": "]", "{": "}"} | dict.fromkeys(_RB_OPEN, "end")
    classes = ("NL", "ID", "CONST", "NUM", "STR", "SYM", "LABEL", "VAR", "BIN", "ASG", "UN")
    words = ()
    merged = dict.fromkeys("/ % ^ << >> == != === =~ !~ < > <= >= <=> && ||".split(), "BIN") | dict.fromkeys(
        "+= -= *= /= %= **= <<= >>= &= |= ^= &&= ||=".split(), "ASG"
    ) | dict.fromkeys("nil true false __FILE__ __LINE__ __method__ redo retry".split(), "VAR") | {"~": "UN", "defined?": "UN"}
    pattern = (
        r"(?:[ \t\r\f\v]+|\\\r?\n|\#[^\n]*|(?m:^)=begin\b[\s\S]*?(?m:^)=end\b[^\n]*|(?m:^)__END__\r?\n[\s\S]*)*+("
        r"\n(?:\s+|\#[^\n]*|(?<=\n)=begin\b[\s\S]*?\n=end\b[^\n]*)*+|"
        r"(?<![\w)\]}:]):(?:\"(?:[^\"\\]|\\[\s\S])*+\"|'(?:[^'\\]|\\[\s\S])*+'|[^\W\d]\w*[?!=]?(?![\w=>~])|[^\W\d]\w*[?!]?|\[\]=?|[-+*/<=>!~%&|^]+)|"
        r"[^\W\d]\w*[?!]?:(?!:)(?=[\s,)\]}]|$)|\"(?:[^\"\\\n]|\\[\s\S])*+\":(?!:)|"
        r"defined\?|[^\W\d]\w*(?:[?!](?![=~]))?|@{1,2}[^\W\d]\w*|\$(?:\w+|[!@&~0-9$?:\"<>,./\;])|"
        r"\"(?:[^\"\\]|\\[\s\S])*+\"|'(?:[^'\\]|\\[\s\S])*+'|`(?:[^`\\]|\\[\s\S])*+`|"
        r"(?:(?<=[=(,:;!&|?{\[~\s]))%[wWiIqQrsx]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|<[^>]*>|\|[^|]*\||![^!]*!)[a-z]*|"
        r"(?:(?<=[=(,:;!&|?{\[~])|(?<=[=(,:;!&|?{\[~] )|(?<=\n)|(?<=  )|(?<=when )|(?<=if )|(?<=and ))/(?![ ])(?:[^/\\\n]|\\.)+/[a-z]*|"
        r"\?[^\s\w](?=[\s,)\]])|\?\w(?!\w)|"
        r"0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]?|"
        r"\.\.\.?|&\.|::|->|=>|<=>|===?|=~|![=~]|\*\*=?|&&=?|\|\|=?|<<=?|>>=?|[-+*/%&|^<>]=|[-+*/%&|^!~?:=.,;<>(){}\[\]]|\Z|[\s\S])"
    )
    grammar_text = r"""
    prog = body ;
    sep = NL | ';' ;
    body = sep* (stmt (sep+ stmt)* sep*)? ;
    bodyr = body (rescue)* ('else' body)? ('ensure' body)? ;
    rescue = 'rescue' ((operand | '*' operand) % ',')? ('=>' lhs)? ('then' | sep) body ;
    nl = NL* ;
    stmt = estmt (('if_mod' | 'unless_mod' | 'while_mod' | 'until_mod' | 'rescue') estmt)* ;
    estmt = nexpr (('and' | 'or') nl nexpr)* ;
    nexpr = 'not' nexpr | expr | command | ('return' | 'break' | 'next') (args0)? | 'alias' fname fname | 'undef' fname
          | mlhs '=' nl (expr | command | splat) (',' nl (expr | splat))* | lhs ('=' | ASG) nl (command | splat (',' nl (expr | splat))* | nexpr) ;
    mlhs = mitem (',' mitem)+ ','? | '*' lhs | mitem ',' ;
    mitem = '*'? lhs | '(' mitem (',' mitem)* ')' ;
    splat = '*' operand ;
    lhs = ID | VAR | CONST | operand0 (dot (ID | CONST) | '[' cargs ']') ;
    command = cmdhead carg (',' nl carg)* doblock? ;
    cmdhead = ID | CONST | operand0 dot mname | 'super' | 'yield' ;
    expr = lhs ('=' | ASG) nl (expr | splat) | tern | 'not' expr ;
    tern = range ('?' nl tern nl (':' nl | LABELC) tern)? ;
    range = bin (('..' | '...') bin?)? | ('..' | '...') bin ;
    bin = unary (binop nl unary)* ;
    binop = BIN | '+' | '-' | '*' | '**' | '&' | '|' ;
    unary = ('!' | '-' | '+' | UN | '&')* operand ;
    operand = operand0 ;
    operand0 = atom suffix* ;
    dot = nl ('.' | '&.') | '::' ;
    mname = ID | CONST | VAR | kwname ;
    kwname = 'class' 'end'? ;
    suffix = dot (ID | CONST | VAR | LABELM | '(' cargs ')') | '.' KWM | '(' cargs ')' | '[' cargs ']' | brace | doblock ;
    brace = '{' blockparams? body '}' ;
    doblock = 'do_block' blockparams? bodyr 'end' ;
    blockparams = '|' (bparam % ',' ','?)? (';' ID % ',')? '|' ;
    bparam = ID ('=' unary)? | '*' ID? | '**' ID? | '&' ID | LABEL unary? | '(' bparam % ',' ')' ;
    cargs = nl (carg nl (',' nl carg nl)* (',' nl)?)? ;
    carg = '*' expr | '**' expr | '&' expr? | LABEL nl (expr | command)? | expr (nl '=>' nl expr)? | command ;
    args0 = carg (',' nl carg)* ;
    fname = ID | CONST | VAR | SYM | binop | '[' ']' '='? | '!' | UN | ID '=' | '<' ;
    atom = ID | CONST | VAR | NUM | STR+ | SYM | 'self' | 'super' | 'yield' | '::' CONST | '(' body ')' | '[' cargs ']' | '{' nl (hel nl (',' nl hel nl)* (',' nl)?)? '}'
         | '->' ('(' params ')' | params1)? (brace | doblock)
         | 'def' ((ID | CONST | 'self' | VAR) '.')? fname ('(' params ')' | params1)? sep bodyr 'end'
         | 'def' ((ID | CONST | 'self' | VAR) '.')? fname '(' params ')' body 'end'
         | 'class' (cpath ('<' expr)? | BIN 'self') sep bodyr 'end' | 'class' cpath BIN expr sep bodyr 'end'
         | 'module' cpath bodyr 'end'
         | 'if' estmt then body ('elsif' estmt then body)* ('else' body)? 'end'
         | 'unless' estmt then body ('else' body)? 'end'
         | 'while' estmt ('do_loop' | sep) body 'end' | 'until' estmt ('do_loop' | sep) body 'end'
         | 'for' lhs (',' lhs)* 'in' estmt ('do_loop' | sep) body 'end'
         | 'case' estmt? sep* ('when' carg (',' nl carg)* then body | 'in' pat (('if_mod' | 'unless_mod') estmt)? then body)+ ('else' body)? 'end'
         | 'begin' bodyr 'end' | 'begin' bodyr 'end' ;
    pat = expr | '{' nl (hel nl (',' nl hel nl)* (',' nl)?)? '}' | LABEL expr? (',' nl LABEL expr?)* | '*' ID | '^' ID ;
    then = sep* 'then' | sep+ ;
    cpath = '::'? CONST ('::' CONST)* ;
    hel = LABEL nl (expr | command)? | expr nl '=>' nl expr | '**' expr ;
    params = nl (param nl (',' nl param nl)* (',' nl)?)? ;
    params1 = param (',' nl param)* ;
    param = ID ('=' expr)? | '*' ID? | '**' (ID | VAR)? | '&' ID? | LABEL expr? | '(' ID % ',' ')' | '...' ;
    """.replace("| LABELM ", "").replace(" | '.' KWM", "").replace("(':' nl | LABELC)", "':' nl").replace(" | kwname", "").replace("    kwname = 'class' 'end'? ;\n", "").replace("'class' (cpath ('<' expr)? | BIN 'self')", "'class' (cpath | BIN 'self')").replace(" | '<' ;", " ;").replace(" | '^' ID", "")

    kw = frozenset("def class module if unless while until for case begin do end else elsif when then in rescue ensure and or not return break next alias undef self super yield".split())
    value = frozenset("ID CONST VAR NUM STR SYM ) ] } end self super yield".split())

    def __init__(self):
        super().__init__()
        self.value_codes = {self.codes[x] for x in self.value}
        names = "BIN ASG + - * ** & | , = => . &. :: ( [ { ? ! and or not UN -> .. ... do_ LABEL".split()
        self.joins = {self.codes[x] for x in names if x in self.codes and x not in ("LABEL", "..", "...")}
        self.special = {w: self.codes.get(w, -5) for w in ("if", "unless", "while", "until")}

    def classify(self, tok):
        x = tok[0]
        if x == "\n":
            return -1
        if tok == "do":
            return -3
        if len(tok) > 1 and tok[-1] == ":" and tok != "::" and x != ":":
            return self.codes["LABEL"]
        if x.isalpha() or x == "_":
            if tok in self.merged:
                return self.codes[self.merged[tok]]
            if tok in self.kw:
                return self.codes[tok]
            return self.codes["CONST" if x.isupper() else "ID"]
        if x in "@$" and len(tok) > 1:
            return self.codes["VAR"]
        if x == ":" and len(tok) > 1 and tok != "::":
            return self.codes["SYM"]
        if x in "%/?" and len(tok) > 1 and tok[1] != "=":
            return self.codes["STR"]
        return super().classify(tok)

    def judge(self, text, toks):
        if "<<" in text:
            text2 = self.heredocs(text)
            if text2 != text:
                toks[:] = self.tokens(text2)
        codes, places, c_ = [], [], self.codes
        nl, value, joins, special = c_["NL"], self.value_codes, self.joins, self.special
        prev, brackets, loops, afterdot = nl, [], [], {c_["."], c_["&."]}
        openers, n_open, n_group = {c_[x] for x in ("while", "until", "for")}, self.grammar.n_open, self.grammar.n_group
        starts = {nl, c_[";"], c_["="], c_["("], c_["["], c_["{"], c_["ASG"], c_[","], c_["=>"], c_["then"], c_["else"], c_["ensure"], c_["BIN"], c_["and"], c_["or"], c_["not"], c_["do_block"], c_["do_loop"], c_["return"], c_["begin"], c_["!"], c_["|"], c_["->"], c_["LABEL"]}
        ids = {c_["ID"]: 0}
        for i, c in enumerate(map(self.table.__getitem__, toks)):
            tok = toks[i]
            if prev in afterdot and c >= -3 and (tok[0].isalpha() or tok[0] == "_"):
                c = c_["ID"] if tok[-1] != ":" else c
            elif prev == c_["def"] and c >= -3 and tok in self.kw and tok != "self":
                c = c_["ID"]
            elif c == -1:
                if prev == nl or prev in joins and not (prev == c_["|"]) or i + 1 < len(toks) and toks[i + 1] in (".", "&.") or i + 1 < len(toks) and toks[i + 1] == "":
                    continue
                c = nl
            elif c == -3:
                c = c_["do_loop"] if loops and loops[-1] == len(brackets) else c_["do_block"]
                if c == c_["do_loop"]:
                    loops.pop()
            elif tok in special:
                if prev not in starts:
                    c = c_[tok + "_mod"]
            if c < n_open:
                brackets.append(c)
            elif c < n_group and brackets:
                brackets.pop()
            if c in openers:
                loops.append(len(brackets))
            elif c == nl and loops and loops[-1] == len(brackets):
                loops.pop()
            codes.append(c)
            places.append(i)
            prev = c
        at = run(self.grammar, codes)
        if at is None:
            for i, tok in enumerate(toks):
                if tok[:1] == '"' and "#{" in tok and not self.interpolation(tok):
                    return i
            return None
        return places[at] if at < len(places) else len(toks)

    @functools.lru_cache(4096)  # noqa: B019
    def interpolation(self, tok):
        for part in re.findall(r"(?<!\\)#\{([^{}\"]*)\}", tok):
            toks = self.tokens(part)
            if toks and self.judge(part, toks) is not None:
                return False
        return True

    @staticmethod
    def heredocs(text):
        """The text with the bodies of here-documents folded into one string each."""
        out, lines, i = [], text.split("\n"), 0
        while i < len(lines):
            line = lines[i]
            tags = re.findall(r"(?<![\w\]])<<([~-]?)([\"'`]?)([A-Z_][A-Z_0-9]*)\2", line) if "<<" in line else []
            j = i + 1
            for dash, _, tag in tags:
                while j < len(lines) and (lines[j].strip() if dash else lines[j].rstrip("\r")) != tag:
                    j += 1
                if j >= len(lines):
                    return text
                j += 1
            out.append(re.sub(r"(?<![\w\]])<<[~-]?[\"'`]?[A-Z_][A-Z_0-9]*[\"'`]?", '""', line) if tags else line)
            i = j
        return "\n".join(out)


KINDS = {".py": Python, ".js": JavaScript, ".mjs": JavaScript, ".jsx": JavaScript, ".ts": TypeScript, ".java": Java, ".go": Go, ".c": C, ".cc": C, ".rb": Ruby}
NAMES = {".py": "Python", ".js": "JavaScript", ".mjs": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".java": "Java", ".go": "Go", ".c": "C", ".cc": "C", ".rb": "Ruby"}


@functools.lru_cache(None)
def language(suffix):
    """The language of a path's ending; its grammar and memo live as long as the process."""
    for other, kind in KINDS.items():
        if kind is KINDS[suffix] and other != suffix:
            return language(other)
        if other == suffix:
            return kind()

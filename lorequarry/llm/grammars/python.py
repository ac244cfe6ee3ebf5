"""Python: logical lines and indentation are marked first, then parsed."""
from __future__ import annotations

import re

from lorequarry.llm.peg import Grammar

NEWLINE, INDENT, DEDENT = "\x01", "\x02", "\x03"
_LEX = re.compile(
    r"(?P<triple>[rRbBfFuUtT]{0,2}(?:\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''))"
    r"|(?P<str>[rRbBfFuUtT]{0,2}(?:\"(?!\"\")(?:[^\\\"\n]|\\[\s\S])*\"|'(?!'')(?:[^\\'\n]|\\[\s\S])*'))"
    r"|(?P<quote>[\"'])|(?P<comment>#[^\n]*)|(?P<cont>\\\n)|(?P<nl>\n)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<other>[^\"'#\\\n()\[\]{}rRbBfFuUtT]+|[\s\S])"
)


def mark_lines(source: str) -> tuple[str, int]:
    """The text with marks for the ends and indents of logical lines, comments left out; where it is broken or -1."""
    s = source.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n").replace("\f", " ")
    if any(c in s for c in "\x00\x01\x02\x03"):
        return "", 0
    out, depth, stack, pos, n, first = [], 0, [0], 0, len(s), True
    while pos < n:
        if depth == 0 and first:  # at the beginning of a logical line
            m = re.compile(r"[ \t]*").match(s, pos)
            end = m.end()
            if end >= n:
                break
            if s[end] == "\n":
                pos = end + 1
                continue
            if s[end] == "#":
                nl = s.find("\n", end)
                pos = n if nl < 0 else nl + 1
                continue
            width = len(m.group().expandtabs(8))
            if width > stack[-1]:
                stack.append(width)
                out.append(INDENT)
            while width < stack[-1]:
                stack.pop()
                out.append(DEDENT)
            if width != stack[-1]:
                return "", pos
            pos, first = end, False
        m = _LEX.match(s, pos)
        k, t = m.lastgroup, m.group()
        pos = m.end()
        if k == "quote":
            return "", m.start()
        if k == "comment":
            continue
        if k == "nl":
            if depth:
                out.append(" ")
            else:
                out.append(NEWLINE)
                first = True
            continue
        if k == "cont":
            out.append(" ")
            continue
        if k == "open":
            depth += 1
        elif k == "close":
            depth -= 1
            if depth < 0:
                return "", m.start()
        out.append(t)
    if depth:
        return "", n
    if not first:
        out.append(NEWLINE)
    out.append(DEDENT * (len(stack) - 1))
    return "".join(out), -1


GRAMMAR = r"""
start <- Stmt* EOF
NLINE <- /\x01/
Kw <- /(?:False|None|True|and|as|assert|async|await|break|class|continue|def|del|elif|else|except|finally|for|from|global|if|import|in|is|lambda|nonlocal|not|or|pass|raise|return|try|while|with|yield)(?!\w)/
Ident <- !Kw !Str /[^\W\d]\w*/
Str <- /[rRbBfFuUtT]{0,2}(?:\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"(?:[^\\\"\n]|\\[\s\S])*\"|'(?:[^\\'\n]|\\[\s\S])*')/
Num <- /(?:0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?![\w])/
Stmt <- Compound / Simple
Simple <- Small (';' Small)* ';'? NLINE
Block <- NLINE /\x02/ Stmt+ /\x03/ / Simple
Small <- "pass" / "break" / "continue" / "return" Stars? / "raise" (Expr ("from" Expr)?)? / "global" Ident (',' Ident)* / "nonlocal" Ident (',' Ident)* / "del" DelEl (',' DelEl)* ','? / "assert" Expr (',' Expr)? / Import / TypeAlias / Assign
TypeAlias <- /type(?=[ \t]+[^\W\d])/ Ident TypeParams? '=' Expr
Import <- "import" Dotted ("as" Ident)? (',' Dotted ("as" Ident)?)* / "from" (/\.+/ Dotted? / Dotted) "import" ('*' / '(' Alias (',' Alias)* ','? ')' / Alias (',' Alias)*)
Dotted <- Ident ('.' Ident)*
Alias <- Ident ("as" Ident)?
Assign <- Target Annot / Target Aug (Yield / Stars) / (Targets Eq)* (Yield / Stars)
Annot <- ':' Expr (Eq (Yield / Stars))?
Eq <- /=(?!=)/
Aug <- /(?:\*\*|\/\/|<<|>>|[+\-*\/%@&|^])=/
Target <- Place / '(' Target ')'
Place <- Atom (Trail &Trail)* LastTrail / Ident
Trail <- Call / Index / '.' Ident
LastTrail <- Index / '.' Ident
DelEl <- Place / '(' (DelEl (',' DelEl)* ','?)? ')' / '[' (DelEl (',' DelEl)* ','?)? ']'
Targets <- TargetEl (',' TargetEl)* ','?
TargetEl <- '*'? (Place / '(' Targets? ')' / '[' Targets? ']')
Yield <- "yield" ("from" Expr / Stars)?
Stars <- Star (',' Star)* ','?
Star <- '*' Or / Named
Compound <- Decorated / Class / Def / If / While / For / Try / With / Match / "async" (Def / For / With)
Decorated <- ('@' Named NLINE)+ (Class / "async"? Def)
Class <- "class" Ident TypeParams? ('(' Args ')')? ':' Block
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- /\*{0,2}/ Ident (':' Expr)? (Eq Expr)?
Def <- "def" Ident TypeParams? '(' Params ')' ('->' Expr)? ':' Block
Params <- (PlainParams (',' OtherParams)? / OtherParams)? ','?
PlainParams <- PlainParam (',' (PlainParam / Slash))*
OtherParams <- GivenParam (',' (GivenParam / Slash))* (',' StarParams)? / StarParams
StarParams <- '*' !'*' (Ident (':' Star)?)? (',' KeyParam)* (',' Rest)? / Rest
PlainParam <- Ident (':' Expr)? !Eq
GivenParam <- Ident (':' Expr)? Eq Expr
KeyParam <- Ident (':' Expr)? (Eq Expr)?
Rest <- '**' Ident (':' Expr)?
Slash <- /\/(?!\/)/
If <- "if" Named ':' Block ("elif" Named ':' Block)* ("else" ':' Block)?
While <- "while" Named ':' Block ("else" ':' Block)?
For <- "for" Targets "in" Stars ':' Block ("else" ':' Block)?
Try <- "try" ':' Block ((Except+ ("else" ':' Block)?) ("finally" ':' Block)? / "finally" ':' Block)
Except <- "except" '*'? (Expr (',' Expr)* ("as" Ident)?)? ':' Block
With <- "with" ('(' WithItem (',' WithItem)* ','? ')' &':' / WithItem (',' WithItem)*) ':' Block
WithItem <- Expr ("as" TargetEl)?
Match <- /match(?!\w)/ Stars ':' NLINE /\x02/ (/case(?!\w)/ Patterns ("if" Named)? ':' Block)+ /\x03/
Patterns <- Pattern (',' Pattern)* ','?
Pattern <- '*' Ident / PatAlt ('|' PatAlt)* ("as" Ident)?
PatAlt <- /-?/ Num (/[+\-]/ Num)? / Str+ / /(?:None|True|False)(?!\w)/ / '(' Patterns? ')' / '[' Patterns? ']' / '{' (PatKey (',' PatKey)*)? ','? '}' / Dotted ('(' (PatArg (',' PatArg)*)? ','? ')')?
PatKey <- '**' Ident / PatAlt ':' Pattern
PatArg <- Ident Eq Pattern / Pattern
Named <- Ident ':=' Expr / Expr
Expr <- Lambda / Or ("if" Or "else" Expr)?
Lambda <- "lambda" LParams ':' Expr
LParams <- (LParam (',' LParam)*)? ','?
LParam <- '**' Ident / '*' Ident? / /\/(?!\/)/ / Ident (Eq Expr)?
Or <- Not (BoolOp Not)*
BoolOp <- /(?:and|or)(?!\w)/
Not <- "not" Not / Compare
Compare <- Arith (CompOp Arith)*
CompOp <- /==|!=|<=|>=|<(?!<)|>(?!>)/ / "not" "in" / "in" / "is" "not" / "is"
Arith <- Unary (ArithOp Unary)*
ArithOp <- /\*\*(?!=)|\/\/(?!=)|<<(?!=)|>>(?!=)|[+\-*\/%@&|^](?!=)/
Unary <- /[+\-~]/ Unary / "await"? Postfix
Postfix <- Atom (Call / Index / '.' Ident)*
Call <- '(' Args ')'
Args <- (PlaceArg (',' PlaceArg)* (',' NameArgs)? / NameArgs)? ','?
PlaceArg <- '*' !'*' Expr / !(Ident Eq) Named Comp?
NameArgs <- NameArg (',' (NameArg / '*' !'*' Expr))* (',' RestArg)* / RestArg (',' RestArg)*
NameArg <- Ident Eq Expr
RestArg <- '**' Expr / NameArg
Index <- '[' Slice (',' Slice)* ','? ']'
Slice <- Expr? ':' Expr? (':' Expr?)? / '*' Or / Named
Comp <- ("async"? "for" Targets "in" Or ("if" OrIf)*)+
OrIf <- Ident ':=' Or / Lambda / Or
Atom <- Str+ / Num / /(?:None|True|False)(?!\w)|\.\.\./ / Paren / List / Brace / Ident
Paren <- '(' (Yield / Star Comp / Stars)? ')'
List <- '[' (Star Comp / Stars)? ']'
Brace <- '{' (DictEl (Comp / (',' DictEl)* ','?) / Star Comp / Stars)? '}'
DictEl <- '**' Or / Expr ':' Expr
"""


def python() -> Grammar:
    return Grammar(GRAMMAR, r"(?:[ \t]+|\\\n)*", prepare=mark_lines)

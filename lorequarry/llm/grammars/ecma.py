"""JavaScript modules, TypeScript and TSX: one grammar with parts for each."""
from __future__ import annotations

import re

from lorequarry.llm.peg import Grammar

TRIVIA = r"(?:[\s﻿]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*"

# Lines that begin with @ts are of TypeScript only, with @js of JavaScript only, with @jsx of TSX only.
GRAMMAR = r"""
start <- Hashbang? Item* EOF
Hashbang <- ~/#![^\n]*/
EOS <- ';' / NL / &'}' / EOF
Word <- /[A-Za-z_$\x80-￿\\][\w$\x80-￿\\]*/
Reserved <- /(?:break|case|catch|class|const|continue|debugger|default|delete|do|else|enum|export|extends|false|finally|for|function|if|import|in|instanceof|new|null|return|super|switch|this|throw|true|try|typeof|var|void|while|with)(?![\w$])/
Ident <- !Reserved Word
Str <- /"(?:[^"\\\n]|\\[\s\S])*"/ / /'(?:[^'\\\n]|\\[\s\S])*'/
Num <- /(?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$])/
Template <- '`' TChars (~/\$\{/ Expr '}' TChars)* ~/`/
TChars <- ~/(?:[^`\\$]|\\[\s\S]|\$(?!\{))*/
Regex <- /\/(?![*\/])(?:[^\/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+\/[a-z]*/

Item <- Import / Export / Stmt
Import <- "import" !(~/\s*[(.]/) ImportBody EOS
@js ImportBody <- Str With? / ImportWhat "from" Str With?
@ts ImportBody <- Str With? / "type"? !"from" ImportWhat "from" Str With? / ImportWhat "from" Str With? / "type"? Ident '=' ("require" '(' Str ')' / QName)
With <- /(?:with|assert)(?![\w$])/ '{' ((Word / Str) ':' Str (',' (Word / Str) ':' Str)*)? ','? '}'
ImportWhat <- Names / '*' "as" Ident / Ident (',' (Names / '*' "as" Ident))?
Names <- '{' (Name (',' Name)*)? ','? '}'
@js Name <- (Word / Str) ("as" (Word / Str))?
@ts Name <- ("type" !/[,}]/ !"as")? (Word / Str) ("as" (Word / Str))?
Export <- Decorator* "export" ExportBody
@js ExportBody <- "default" (Func / Class / Expr EOS) / '*' ("as" (Word / Str))? "from" Str With? EOS / Names ("from" Str With?)? EOS / Decl
@ts ExportBody <- "default" (Func / Class / Interface / "abstract" Class / Expr EOS) / "type"? '*' ("as" (Word / Str))? "from" Str With? EOS / "type"? Names ("from" Str With?)? EOS / '=' Expr EOS / "as" "namespace" Ident EOS / Import / Decl
@js Decl <- Decorator* (Func / Class) / VarStmt
@ts Decl <- Decorator* (Func / "abstract"? Class) / VarStmt / Interface / TypeAlias / Enum / Namespace / Declare

Stmt <- Block / ';' / VarStmt / Func / Decorated / If / For / While / DoWhile / "return" (!NL Expr)? EOS / "break" (!NL Ident)? EOS / "continue" (!NL Ident)? EOS / "throw" !NL Expr EOS / Try / Switch / "debugger" EOS / "with" '(' Expr ')' Stmt / TypeStmt / Label / ExprStmt
@js Decorated <- Decorator* Class
@ts Decorated <- Decorator* "abstract"? Class
@js TypeStmt <- !Word Word
@ts TypeStmt <- Interface / TypeAlias / Enum / Namespace / Declare
Label <- Ident ':' Stmt
ExprStmt <- !/\{|(?:function|class)(?![\w$])/ Expr EOS
Block <- '{' Stmt* '}'
VarStmt <- VarKind VarOne (',' VarOne)* EOS
VarKind <- "var" / "const" !"enum" / "let" &(/[A-Za-z_$\[{\x80-￿]/) !/(?:in|instanceof|of)(?![\w$])/ / "await"? "using" !NL &Ident
@js VarOne <- Binding ('=' Assign)?
@ts VarOne <- Binding '!'? (':' Type)? ('=' Assign)?
Binding <- Ident / ArrBind / ObjBind
ArrBind <- '[' ((BindEl / '...' Binding)? ',')* (BindEl / '...' Binding)? ']'
ObjBind <- '{' (ObjBindEl (',' ObjBindEl)*)? ','? '}'
ObjBindEl <- '...' Ident / PropName ':' BindEl / Ident ('=' Assign)?
BindEl <- Binding ('=' Assign)?
If <- "if" '(' Expr ')' Stmt ("else" Stmt)?
While <- "while" '(' Expr ')' Stmt
DoWhile <- "do" Stmt "while" '(' Expr ')' ';'?
For <- "for" "await"? '(' (ForIn / ForSemi) ')' Stmt
ForIn <- (VarKind Binding / Postfix) ("of" Assign / "in" Expr)
ForSemi <- (VarKind VarOne (',' VarOne)* / Expr)? ';' Expr? ';' Expr?
Try <- "try" Block (Catch Finally? / Finally)
@js Catch <- "catch" ('(' Binding ')')? Block
@ts Catch <- "catch" ('(' Binding (':' Type)? ')')? Block
Finally <- "finally" Block
Switch <- "switch" '(' Expr ')' '{' (("case" Expr / "default") ':' Stmt*)* '}'

@js Func <- "async"? "function" '*'? Ident? '(' Params ')' Block
@ts Func <- "async"? "function" '*'? Ident? TypeParams? '(' Params ')' (':' RetType)? (Block / EOS)
Params <- (Param (',' Param)*)? ','?
@js Param <- Decorator* ('...' Binding / BindEl)
@ts Param <- Decorator* Modifier* ('...' Binding '?'? (':' Type)? / ("this" / Binding) '?'? (':' Type)? ('=' Assign)?)
@ts Modifier <- /(?:public|private|protected|readonly|override|static|abstract|declare|accessor)(?![\w$])/ !/[,:;=?()!}]/
Decorator <- '@' ('(' Expr ')' / Word ('.' Word)* Args?)
@js Class <- "class" Ident? ("extends" Postfix)? '{' Member* '}'
@ts Class <- "class" (!/(?:implements|extends)(?![\w$])/ Ident)? TypeParams? ("extends" Postfix TypeArgs?)? ("implements" Type (',' Type)*)? '{' Member* '}'
@js Member <- ';' / Decorator* (StaticBlock / ("static" !/[=;(}]/)? Method / ("static" !/[=;(}]/)? Field)
@ts Member <- ';' / IndexSig EOS / Decorator* (StaticBlock / Modifier* IndexSig EOS / Modifier* Method / Modifier* Field)
StaticBlock <- "static" Block
@js Method <- (/(?:get|set)(?![\w$])/ !/[(=;}]/ / ("async" !NL !/[(=;}]/)? '*'?) MemberName '(' Params ')' Block
@ts Method <- (/(?:get|set)(?![\w$])/ !/[(=;}<]/ / ("async" !NL !/[(=;}<]/)? '*'?) MemberName '?'? TypeParams? '(' Params ')' (':' RetType)? (Block / EOS)
@js Field <- MemberName ('=' Assign)? EOS
@ts Field <- MemberName /[?!]/? (':' Type)? ('=' Assign)? EOS
MemberName <- /#[\w$]+/ / PropName
PropName <- Word / Str / Num / '[' Assign ']'

Expr <- Assign (',' Assign)*
Assign <- Arrow / Yield / Place !NoOp AssignOp Assign / Binary
AssignOp <- /(?:>>>|<<|>>|\*\*|&&|\|\||\?\?|[+\-*\/%&|^])?=(?![=>])/
Place <- Primary (Suffix &Suffix)* LastSuffix / Ident / Arr / Obj / '(' Expr ')'
@js LastSuffix <- '?.' ('[' Expr ']' / MemberName) / '.' !/\./ (/#[\w$]+/ / Word) / '[' Expr ']'
@ts LastSuffix <- '?.' ('[' Expr ']' / MemberName) / '.' !/\./ (/#[\w$]+/ / Word) / '[' Expr ']' / '!' !~/=/
Yield <- "yield" (!NL '*'? Assign)?
Binary <- Unary (!NoOp BinOp Assign0 / '?' !/[.](?!\d)/ Assign ':' Assign / AsType)*
Assign0 <- Arrow / Yield / Unary
@js AsType <- !Word Word
@ts AsType <- !NL /(?:as|satisfies)(?![\w$])/ ("const" / Type)
NoOp <- /=>|\?\.(?!\d)/
BinOp <- /(?:>>>|<<|>>|\*\*|&&|\|\||\?\?)(?!=)|[=!]==?|[<>]=?|[+\-*\/%&|^](?!=)|(?:instanceof|in)(?![\w$])/
@js Unary <- Prefix* Postfix
@ts Unary <- Prefix* Postfix / Cast
@ts Cast <- '<' ("const" / Type) '>' Unary
Prefix <- /\+\+|--|[!~]|\+(?!\+)|-(?!-)/ / /(?:typeof|void|delete|await)(?![\w$])/ !/=>|[=,;)\]}:.?]/
Postfix <- Primary Suffix* (!NL /\+\+|--/)?
@js Suffix <- '?.' (Args / '[' Expr ']' / MemberName / Template) / '.' !/\./ (/#[\w$]+/ / Word) / '[' Expr ']' / Args / Template
@ts Suffix <- '?.' (TypeArgs? Args / '[' Expr ']' / MemberName / Template) / '.' !/\./ (/#[\w$]+/ / Word) / '[' Expr ']' / Args / Template / '!' !/=/ / TypeArgs (Args / Template / &/[\])},;:]|$/)
Args <- '(' (Arg (',' Arg)*)? ','? ')'
Arg <- '...'? Assign
@jsx Primary <- Jsx / Core
@nojsx Primary <- Core
Core <- Num / Str / Template / Regex / '(' Expr ')' / Arr / Obj / Func / Decorated / New / "import" ('.' Word / &'(') / /(?:this|super|null|true|false)(?![\w$])/ / /#[\w$]+/ &"in" / Ident
@js New <- "new" ('.' Word / (New / Core) NewPart* Args?)
@ts New <- "new" ('.' Word / (New / Core) NewPart* TypeArgs? Args?)
NewPart <- '.' (/#[\w$]+/ / Word) / '[' Expr ']' / Template
Arr <- '[' (Arg? ',')* Arg? ']'
Obj <- '{' (Prop (',' Prop)*)? ','? '}'
Prop <- '...' Assign / ObjMethod / PropName ':' Assign / Ident ('=' Assign)?
@js ObjMethod <- (/(?:get|set)(?![\w$])/ !/[(,:}=]/ / ("async" !/[(,:}=]/)? '*'?) PropName '(' Params ')' Block
@ts ObjMethod <- (/(?:get|set)(?![\w$])/ !/[(,:}=<]/ / ("async" !/[(,:}=<]/)? '*'?) PropName TypeParams? '(' Params ')' (':' RetType)? Block
@js Arrow <- ("async" !NL)? ('(' Params ')' / Ident) !NL '=>' (Block / Assign)
@ts Arrow <- ("async" !NL)? (TypeParams? '(' Params ')' (':' RetType)? / Ident) !NL '=>' (Block / Assign)

@jsx Jsx <- '<' JsxBody
@jsx JsxBody <- '>' JsxKids '</' '>' / JsxName TypeArgs? JsxAttr* ('/' '>' / '>' JsxKids '</' JsxName '>')
@jsx JsxName <- /[A-Za-z_$][\w$\-]*(?:[.:][A-Za-z_$][\w$\-]*)*/
@jsx JsxAttr <- '{' '...' Assign '}' / JsxName ('=' (/"[^"]*"|'[^']*'/ / '{' Assign '}' / Jsx))?
@jsx JsxKids <- (JsxText / '{' ('...'? Expr)? '}' / !'</' Jsx)*
@jsx JsxText <- ~/[^<>{}]+/

@ts QName <- Word ('.' Word)*
@ts RetType <- "asserts" (Ident / "this") ("is" Type)? / (Ident / "this") "is" Type / Type
@ts Type <- FnType / UnionType (!NL "extends" UnionType '?' Type ':' Type)?
@ts FnType <- "abstract"? "new"? TypeParams? '(' Params ')' '=>' RetType
@ts UnionType <- /[|&]/? PostType (/[|&](?![|&=])/ PostType)*
@ts PostType <- TypeOp* PrimType (!NL '[' Type? ']')*
@ts TypeOp <- /(?:keyof|readonly|unique|infer)(?![\w$])/ !/[,;=>)\]|&}]/
@ts PrimType <- FnType / '(' Type ')' / Mapped / '{' (TypeMember /[,;]/? )* '}' / '[' (TupleEl (',' TupleEl)*)? ','? ']' / Str / /-?/ Num / TypeTemplate / "typeof" ("import" '(' Str ')' / QName) TypeArgs? / "import" '(' Str ')' ('.' Word)* TypeArgs? / /(?:this|void|null|undefined|true|false)(?![\w$])/ / !Reserved QName (!NL TypeArgs)?
@ts TypeTemplate <- '`' TChars (~/\$\{/ Type '}' TChars)* ~/`/
@ts TupleEl <- '...'? (Word '?'? ':' Type / Type '?'?)
@ts Mapped <- '{' /[+-]?readonly(?![\w$])/? '[' Ident "in" Type ("as" Type)? ']' /[+-]?\?/? (':' Type)? /[;,]/? '}'
@ts TypeMember <- IndexSig / /(?:get|set)(?![\w$])/ !/[(:;,?<}]/ PropName '(' Params ')' (':' RetType)? / "new" TypeParams? '(' Params ')' (':' RetType)? / TypeParams? '(' Params ')' (':' RetType)? / ("readonly" !/[:?(;,<}]/)? PropName '?'? (TypeParams? '(' Params ')' (':' RetType)? / (':' Type)?)
@ts IndexSig <- /[+-]?readonly(?![\w$])/? '[' Ident ':' Type ']' (':' Type)?
@ts TypeParams <- '<' TypeParam (',' TypeParam)* ','? '>'
@ts TypeParam <- (/(?:const|in|out)(?![\w$])/ !/[,>=]/)* Ident ("extends" Type)? ('=' Type)?
@ts TypeArgs <- '<' !/<|=/ Type (',' Type)* '>'
@ts Interface <- "interface" !NL Ident TypeParams? ("extends" Type (',' Type)*)? '{' (TypeMember (/[,;]/ / NL / &'}'))* '}'
@ts TypeAlias <- "type" !NL Ident TypeParams? '=' Type EOS
@ts Enum <- "const"? "enum" Ident '{' (EnumEl (',' EnumEl)*)? ','? '}'
@ts EnumEl <- PropName ('=' Assign)?
@ts Namespace <- ("namespace" / "module") !NL (QName / Str) ('{' Item* '}' / EOS)
@ts Declare <- "declare" !NL ("global" '{' Item* '}' / "abstract"? Class / Decl)
"""


def _part(*kinds: str) -> str:
    out = []
    for line in GRAMMAR.split("\n"):
        m = re.match(r"@(\w+) (.*)", line)
        if not m:
            out.append(line)
        elif m[1] in kinds:
            out.append(m[2])
    return "\n".join(out)


def javascript() -> Grammar:
    return Grammar(_part("js", "nojsx"), TRIVIA)


def typescript() -> Grammar:
    return Grammar(_part("ts", "nojsx"), TRIVIA)


def tsx() -> Grammar:
    g = _part("ts", "jsx")
    return Grammar(g.replace("Unary <- Prefix* Postfix / Cast", "Unary <- Prefix* Postfix"), TRIVIA)

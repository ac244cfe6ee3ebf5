"""Go, Rust, Java and C#."""
from __future__ import annotations

import re

from lorequarry.llm.peg import Grammar

C_TRIVIA = r"(?:[\s﻿]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*"

GO = r"""
start <- Package (Import)* Top* EOF
EOS <- ';' / NL / &/[)}]/ / EOF
Reserved <- /(?:break|case|chan|const|continue|default|defer|else|fallthrough|for|func|go|goto|if|import|interface|map|package|range|return|select|struct|switch|type|var)(?!\w)/
Ident <- !Reserved /[^\W\d]\w*/
Str <- /"(?:[^"\\\n]|\\.)*"/ / /`[^`]*`/
Rune <- /'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|.))'/
Num <- /(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[oO]?[0-7_]+(?![.\deE])|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w)/
Package <- "package" Ident EOS
Import <- "import" ('(' (ImportOne EOS)* ')' / ImportOne) EOS
ImportOne <- (/\./ / Ident)? Str
Top <- Func / Decl EOS
Decl <- "var" (VarOne / '(' (VarOne EOS)* ')') / "const" (ConstOne / '(' (ConstOne EOS)* ')') / "type" (TypeOne / '(' (TypeOne EOS)* ')')
VarOne <- Idents (Type ('=' Exprs)? / '=' Exprs)
ConstOne <- Idents (!NL Type)? ('=' Exprs)?
TypeOne <- Ident TypeParams? '='? Type
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- Idents TypeSet
TypeSet <- '~'? Type ('|' '~'? Type)*
Idents <- Ident (',' Ident)*
Exprs <- Expr (',' Expr)*
Func <- "func" Params? Ident TypeParams? Signature (!NL Block)? EOS
Signature <- Params (!NL (Params / Type))?
Params <- '(' (Param (',' Param)* ','?)? ')'
Param <- Idents '...'? Type / '...'? Type
Type <- '*' Type / '(' Type ')' / '[' '...' ']' Type / '[' Expr? ']' Type / "map" '[' Type ']' Type / "chan" /<-/? Type / /<-/ "chan" Type / "func" Signature / Struct / Interface / Ident ('.' Ident)? ('[' Type (',' Type)* ','? ']')?
Struct <- "struct" '{' (Field EOS)* '}'
Field <- (Idents Type / '*'? Ident ('.' Ident)? ('[' Type (',' Type)* ']')?) Str?
Interface <- "interface" '{' ((Ident Signature / TypeSet) EOS)* '}'
Block <- '{' (Stmt EOS / ';')* '}'
Stmt <- Decl / "return" (!NL Exprs)? / If / For / Switch / Select / Block / "go" Expr / "defer" Expr / "break" (!NL Ident)? / "continue" (!NL Ident)? / "goto" Ident / "fallthrough" / Ident ':' !'=' Stmt? / Simple
Simple <- Exprs (AssignOp Exprs / /\+\+|--/ / /<-/ Expr)?
AssignOp <- /:=|(?:<<|>>|&\^|[+\-*\/%&|^])?=(?!=)/
If <- "if" (HSimple? ';')? HExpr Block ("else" (If / Block))?
For <- "for" (HSimple? ';' HExpr? ';' HSimple? / (HExprs /:?=/)? "range" HExpr / HExpr)? Block
Switch <- "switch" (HSimple? ';')? (Ident ':=' HUnary / HUnary !HBin / HSimple)? '{' (("case" CaseEls / "default") ':' (Stmt EOS / ';')*)* '}'
CaseEls <- CaseEl (',' CaseEl)*
CaseEl <- Expr / Type
Select <- "select" '{' (("case" Simple / "default") ':' (Stmt EOS / ';')*)* '}'
Expr <- Unary (BinOp Unary)*
HBin <- BinOp
BinOp <- /\|\||&&|==|!=|<=|>=|<<(?!=)|>>(?!=)|&\^(?!=)|[+\-*\/%|&^](?![=])(?!\+\+)|<(?!-)|>/
Unary <- !/\+\+|--/ /[+\-!^*&]|<-/ Unary / Primary
Primary <- Operand Suffix*
Suffix <- '.' (Ident / '(' ("type" / Type) ')') / !NL '[' (Expr? ':' Expr? (':' Expr)? / TypeOrExpr (',' TypeOrExpr)* ','?) ']' / !NL '(' (TypeOrExpr (',' TypeOrExpr)* '...'? ','?)? ')' / !NL LitBody
TypeOrExpr <- Expr / Type
Operand <- Num / Str / Rune / "func" Signature Block / LitType LitBody / '(' (Expr / Type) ')' / Ident / /(?=[\[]|map|chan|struct|interface|\*)/ Type &'('
LitType <- '[' '...' ']' Type / '[' Expr? ']' Type / "map" '[' Type ']' Type / Struct
LitBody <- '{' (LitEl (',' LitEl)* ','?)? '}'
LitEl <- (LitBody / Expr) (':' (LitBody / Expr))?
HExprs <- HExpr (',' HExpr)*
HSimple <- HExprs (AssignOp HExprs / /\+\+|--/ / /<-/ HExpr)?
HExpr <- HUnary (BinOp HUnary)*
HUnary <- !/\+\+|--/ /[+\-!^*&]|<-/ HUnary / HPrimary
HPrimary <- Operand HSuffix*
HSuffix <- '.' (Ident / '(' ("type" / Type) ')') / !NL '[' (Expr? ':' Expr? (':' Expr)? / TypeOrExpr (',' TypeOrExpr)* ','?) ']' / !NL '(' (TypeOrExpr (',' TypeOrExpr)* '...'? ','?)? ')'
"""


def go() -> Grammar:
    return Grammar(GO, C_TRIVIA)


RUST = r"""
start <- Shebang? InnerAttr* Item* EOF
Shebang <- ~/#![^\[\n][^\n]*/
InnerAttr <- '#!' '[' Trees ']'
Attr <- '#' '[' Trees ']'
Trees <- (Tree)*
Tree <- '(' Trees ')' / '[' Trees ']' / '{' Trees '}' / Str / Char / Num / Life / /[^\s()\[\]{}"']/ 
Reserved <- /(?:as|async|await|break|const|continue|dyn|else|enum|extern|fn|for|if|impl|in|let|loop|match|mod|move|mut|pub|ref|return|static|struct|trait|type|unsafe|use|where|while|true|false)(?!\w)/
Ident <- !Reserved /(?:r#)?[^\W\d]\w*/
Str <- /(?:b|c)?"(?:[^"\\]|\\[\s\S])*"|(?:br|cr|r)(#*)"[\s\S]*?"\1/
Char <- /b?'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u\{[\da-fA-F_]+\}|.))'/
Life <- /'[^\W\d]\w*(?!')/
Num <- /(?:0[xX][\da-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w)/
Item <- Attr* Vis? ItemBody
Vis <- "pub" ('(' ("in" Path / "crate" / "self" / "super") ')')?
ItemBody <- Use / Mod / Fn / Struct / Enum / Union / Trait / Impl / TypeAlias / Const / Static / ExternBlock / ExternCrate / MacroRules / MacroItem
Use <- "use" UseTree ';'
UseTree <- '::'? '{' (UseTree (',' UseTree)* ','?)? '}' / '*' / '::'? PathSeg ('::' PathSeg)* ('::' ('*' / '{' (UseTree (',' UseTree)* ','?)? '}'))? ("as" /[^\W\d]\w*/)?
PathSeg <- /(?:crate|self|super|Self)(?!\w)/ / Ident
Mod <- "unsafe"? "mod" Ident (';' / '{' InnerAttr* Item* '}')
Fn <- /(?:(?:const|async|unsafe|default|extern(?:\s+"[^"]*")?)\s+)*(?=fn\b)/ "fn" Ident Generics? '(' FnParams ')' ('->' Type)? Where? (Block / ';')
FnParams <- (FnParam (',' FnParam)* ','?)?
FnParam <- Attr* ('&' Life? "mut"? /self(?!\w)/ / "mut"? /self(?!\w)/ (':' Type)? / '...' / Pat ':' Type)
Generics <- '<' (GenParam (',' GenParam)* ','?)? '>'
GenParam <- Attr* (Life (':' Life? ('+' Life)*)? / "const" Ident ':' Type ('=' (Block / Lit / Ident))? / Ident (':' Bounds?)? ('=' Type)?)
Bounds <- Bound ('+' Bound)* '+'?
Bound <- Life / '?'? ("for" Generics)? TypePath / '(' '?'? ("for" Generics)? TypePath ')'
Where <- "where" (WherePred (',' WherePred)* ','?)?
WherePred <- Life ':' (Life ('+' Life)*)? / ("for" Generics)? Type ':' Bounds?
Struct <- "struct" Ident Generics? (Where? '{' Fields '}' / '(' TupleFields ')' Where? ';' / Where? ';')
Fields <- (FieldDef (',' FieldDef)* ','?)?
FieldDef <- Attr* Vis? Ident ':' Type
TupleFields <- (Attr* Vis? Type (',' Attr* Vis? Type)* ','?)?
Enum <- "enum" Ident Generics? Where? '{' (Variant (',' Variant)* ','?)? '}'
Variant <- Attr* Vis? Ident ('{' Fields '}' / '(' TupleFields ')')? ('=' Expr)?
Union <- /union(?=\s+[^\W\d])/ Ident Generics? Where? '{' Fields '}'
Trait <- "unsafe"? /(?:auto\s+)?/ "trait" Ident Generics? (':' Bounds?)? Where? '{' InnerAttr* AssocItem* '}'
Impl <- "unsafe"? "impl" Generics? '!'? Type ("for" Type)? Where? '{' InnerAttr* AssocItem* '}'
AssocItem <- Attr* Vis? (Fn / TypeAlias / Const / MacroItem)
TypeAlias <- "type" Ident Generics? (':' Bounds)? Where? ('=' Type Where?)? ';'
Const <- "const" (Ident / '_') ':' Type ('=' Expr)? ';'
Static <- "static" "mut"? Ident ':' Type ('=' Expr)? ';'
ExternBlock <- "unsafe"? "extern" Str? '{' InnerAttr* (Attr* Vis? (Fn / Static / TypeAlias / MacroItem))* '}'
ExternCrate <- "extern" "crate" /\w+/ ("as" Ident)? ';'
MacroRules <- "macro_rules" '!' Ident ('{' Trees '}' / '(' Trees ')' ';' / '[' Trees ']' ';')
MacroItem <- Path '!' Ident? ('{' Trees '}' / ('(' Trees ')' / '[' Trees ']') ';')
Path <- '::'? PathSeg ('::' PathSeg)*
Type <- '(' (Type (',' Type)* ','?)? ')' / '!' / '&' '&'? Life? "mut"? TypeNoPlus / '*' ("const" / "mut") TypeNoPlus / '[' Type (';' Expr)? ']' / ("impl" / "dyn") Bounds / ("for" Generics)? FnType / "for" Generics TypePath / '_' / TypePath '!' ('(' Trees ')' / '[' Trees ']' / '{' Trees '}') / TypePath
TypeNoPlus <- ("impl" / "dyn") Bound / Type
FnType <- "unsafe"? ("extern" Str?)? "fn" '(' ((Ident ':')? Type (',' (Ident ':')? Type)* ','? / '...')? ')' ('->' TypeNoPlus)?
TypePath <- '<' Type ("as" TypePath)? '>' ('::' TypeSeg)+ / '::'? TypeSeg ('::' TypeSeg)*
TypeSeg <- PathSeg ('::'? GenArgs / '(' (Type (',' Type)* ','?)? ')' ('->' TypeNoPlus)?)?
GenArgs <- '<' (GenArg (',' GenArg)* ','?)? '>'
GenArg <- Life / Ident GenArgs? '=' Type / Ident GenArgs? ':' Bounds / Type / Block / '-'? Lit
Block <- '{' InnerAttr* Stmt* Expr? '}'
Stmt <- ';' / Attr* Let / Attr* Vis? !MacroCall ItemBody / Attr* BlockExpr !/[.?]/ ';'? / Attr* MacroBrace !/[.?]/ / Attr* Expr ';'
MacroCall <- Path '!' !'='
MacroBrace <- Path '!' '{' Trees '}'
Let <- "let" Pat (':' Type)? ('=' Expr ("else" Block)?)? ';'
BlockExpr <- (Life ':')? ("unsafe" Block / "const" Block / "async" "move"? Block / Block / "loop" Block / "while" NExpr Block / "for" Pat "in" NExpr Block) / If / Match
If <- "if" NExpr Block ("else" (If / Block))?
Match <- "match" NExpr '{' InnerAttr* Arm* '}'
Arm <- Attr* '|'? Pat ("if" Expr)? '=>' (BlockExpr !/[.?]|[+\-*\/%=<>&|^](?!=?\s*[^\n]*=>)/ ','? / Expr (',' / &'}'))
Pat <- '|'? PatOne ('|' !/\|/ PatOne)*
PatOne <- PatRange / '&' '&'? "mut"? PatOne / '(' (PatEl (',' PatEl)* ','?)? ')' / '[' (PatEl (',' PatEl)* ','?)? ']' / '_' !/\w/ / "ref"? "mut"? Ident !/::|[!({]/ ('@' PatOne)? / TypePathX ('{' (PatField (',' PatField)* ','?)? '}' / '(' (PatEl (',' PatEl)* ','?)? ')' / '!' ('(' Trees ')' / '[' Trees ']'))?
PatEl <- Attr* ('..' !/[=\w\d'"]/ / Pat)
PatField <- Attr* ('..' / (Ident / Num) ':' Pat / "ref"? "mut"? Ident)
PatRange <- PatLit (/\.\.=?|\.\.\./ PatLit?)? / /\.\.=/ PatLit / TypePathX /\.\.=?/ PatLit? 
PatLit <- '-'? Num / Str / Char / /(?:true|false)(?!\w)/ / TypePathX &/\.\./
TypePathX <- '<' Type ("as" TypePath)? '>' ('::' ExprSeg)+ / '::'? ExprSeg ('::' ExprSeg)*
ExprSeg <- PathSeg / GenArgs
Lit <- Num / Str / Char / /(?:true|false)(?!\w)/
Expr <- Closure / Jump / Unary (BinOp (Closure / Jump / Unary) / "as" TypeNoPlus / /\.\.=?/ (!/[)\]},;]/ Unary)?)*
Jump <- "return" Expr? / "break" Life? Expr? / "continue" Life?
Closure <- ("for" Generics)? "static"? "async"? "move"? ('||' / '|' (ClosParam (',' ClosParam)* ','?)? '|') ('->' Type Block / Expr)
ClosParam <- Attr* PatOne (':' Type)?
BinOp <- /(?:<<|>>)=?|&&|\|\||[=!]=|[<>]=?|[+\-*\/%^|&]=?|=(?![=>])/
Unary <- /[!*]|-(?!>)/ Unary / '&' '&'? ("raw" ("const" / "mut"))? "mut"? Unary / /\.\.=?/ (!/[)\]},;]/ Unary)? / Primary Suffix*
Suffix <- '?' / '.' ("await" / Num / Ident ('::' GenArgs)? ('(' Args ')')?) / '(' Args ')' / '[' Expr ']'
Args <- (Attr* Expr (',' Attr* Expr)* ','?)?
Primary <- BlockExpr / Lit / MacroExpr / StructLit / TypePathX / '(' (Expr (',' Expr)* ','?)? ')' / '[' (Expr (';' Expr / (',' Expr)* ','?))? ']' / "let" Pat '=' Unary
MacroExpr <- Path '!' !'=' ('(' Trees ')' / '[' Trees ']' / '{' Trees '}')
StructLit <- TypePathX '{' (StructField (',' StructField)* ','?)? '}'
StructField <- Attr* ('..' Expr? / (Ident / Num) ':' Expr / Ident)
NExpr <- NUnary (BinOp (Closure / NUnary) / "as" TypeNoPlus / /\.\.=?/ (!/[)\]},;{]/ NUnary)?)*
NUnary <- /[!*]|-(?!>)/ NUnary / '&' '&'? "mut"? NUnary / "let" Pat '=' NUnary / NPrimary Suffix*
NPrimary <- Lit / MacroExpr / If / Match / "unsafe" Block / TypePathX / '(' (Expr (',' Expr)* ','?)? ')' / '[' (Expr (';' Expr / (',' Expr)* ','?))? ']' / Closure
"""


def _nested_comments(source: str) -> tuple[str, int]:
    """Block comments nest: blank them first, outside of strings; where one does not end or -1."""
    if "/*" not in source:
        return source, -1
    out, pos, depth, start = [], 0, 0, 0
    lex = re.compile(r"(?:br|r)(#*)\"[\s\S]*?\"\1|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\\n]|\\.)'|//[^\n]*|/\*|\*/")
    for m in iter(lambda: (re.compile(r"/\*|\*/") if depth else lex).search(source, pos), None):
        t = m.group()
        if depth == 0:
            out.append(source[pos : m.start()])
            if t == "/*":
                depth, start = 1, m.start()
            else:
                out.append(t)
        else:
            depth += 1 if t == "/*" else -1
            if depth == 0:
                out.append(re.sub(r"[^\n]", " ", source[start : m.end()]))
        pos = m.end()
    if depth:
        return "", start
    out.append(source[pos:])
    return "".join(out), -1


def rust() -> Grammar:
    return Grammar(RUST, r"(?:[\s﻿]+|//[^\n]*)*", prepare=_nested_comments)


JAVA = r"""
start <- (Annot* "package" QName ';')? Import* (TypeDecl / ';')* ModuleDecl? EOF
Reserved <- /(?:abstract|assert|boolean|break|byte|case|catch|char|class|const|continue|default|do|double|else|enum|extends|final|finally|float|for|goto|if|implements|import|instanceof|int|interface|long|native|new|package|private|protected|public|return|short|static|strictfp|super|switch|synchronized|this|throw|throws|transient|try|void|volatile|while|true|false|null)(?![\w$])/
Ident <- !Reserved /[^\W\d$]?[$\w]+/
Str <- /\"\"\"[ \t]*\r?\n(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|"(?:[^"\\\n]|\\.)*"/
Char <- /'(?:[^'\\\n]|\\u+[\da-fA-F]{4}|\\[0-7]{1,3}|\\.)'/
Num <- /(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$])/
QName <- Ident ('.' Ident)*
Import <- "import" "static"? QName ('.' '*')? ';'
ModuleDecl <- Annot* "open"? "module" QName '{' (/[a-z]+/ /[^;{}]*/ ';')* '}'
Annot <- '@' !"interface" QName ('(' (AnnArg (',' AnnArg)*)? ')')?
AnnArg <- (Ident '=')? AnnVal
AnnVal <- Annot / '{' (AnnVal (',' AnnVal)*)? ','? '}' / Ternary
Mod <- Annot / /(?:public|protected|private|static|abstract|final|native|synchronized|transient|volatile|strictfp|default|non-sealed)(?![\w$])/ !':' !'->' / /sealed(?=\s+\w)/
TypeDecl <- Mod* (Class / Enum / Record / Interface / AnnotDecl)
Class <- "class" Ident TypeParams? ("extends" Type)? ("implements" Types)? ("permits" Types)? ClassBody
Interface <- "interface" Ident TypeParams? ("extends" Types)? ("permits" Types)? ClassBody
AnnotDecl <- '@' "interface" Ident ClassBody
Record <- "record" Ident TypeParams? '(' Params? ')' ("implements" Types)? ClassBody
Enum <- "enum" Ident ("implements" Types)? '{' (EnumConst (',' EnumConst)*)? ','? (';' Member*)? '}'
EnumConst <- Annot* Ident Args? ClassBody?
ClassBody <- '{' Member* '}'
Member <- ';' / "static"? Block / Mod* (Class / Enum / Record / Interface / AnnotDecl / TypeParams? Method / Field)
Method <- (("void" / Type) Ident '(' Params? ')' Dims / Ident '(' Params? ')' / Ident &'{') ("throws" Types)? ("default" AnnVal)? (Block / ';')
Field <- Type VarOne (',' VarOne)* ';'
VarOne <- Ident Dims ('=' VarInit)?
VarInit <- ArrInit / Expr
ArrInit <- '{' (VarInit (',' VarInit)*)? ','? '}'
Params <- Param (',' Param)*
Param <- Mod* Type (Annot* '...')? ("this" / Ident ('.' "this")? Dims)
Dims <- (Annot* '[' ']')*
TypeParams <- '<' TypeParam (',' TypeParam)* '>'
TypeParam <- Annot* Ident ("extends" Type ('&' Type)*)?
Types <- Type (',' Type)*
Prim <- /(?:boolean|byte|short|int|long|char|float|double)(?![\w$])/
Type <- Annot* (Prim / ClassType) Dims
ClassType <- Ident TypeArgs? ('.' Annot* Ident TypeArgs?)*
TypeArgs <- '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg <- Annot* '?' (("extends" / "super") Type)? / Type
Block <- '{' BlockStmt* '}'
BlockStmt <- LocalVar ';' / Mod* (Class / Enum / Record / Interface) / Stmt
LocalVar <- Mod* Type VarOne (',' VarOne)*
Stmt <- Block / ';' / "if" '(' Expr ')' Stmt ("else" Stmt)? / For / "while" '(' Expr ')' Stmt / "do" Stmt "while" '(' Expr ')' ';' / Try / Switch / "synchronized" '(' Expr ')' Block / "return" Expr? ';' / "throw" Expr ';' / "break" Ident? ';' / "continue" Ident? ';' / "assert" Expr (':' Expr)? ';' / "yield" !/[=.(+\-\[]/ Expr ';' / Ident ':' Stmt / ExprStmt ';'
ExprStmt <- &(/\+\+|--/ / Assign / Unary) Expr
For <- "for" '(' (Mod* Type Ident Dims ':' Expr / (LocalVar / Expr (',' Expr)*)? ';' Expr? ';' (Expr (',' Expr)*)?) ')' Stmt
Try <- "try" ('(' Resource (';' Resource)* ';'? ')' Block Catch* Finally? / Block (Catch+ Finally? / Finally))
Resource <- Mod* Type Ident '=' Expr / Postfix
Catch <- "catch" '(' Mod* Type ('|' Type)* Ident ')' Block
Finally <- "finally" Block
Switch <- "switch" '(' Expr ')' '{' (Label ('->' (Block / "throw" Expr ';' / Expr ';') / ':' BlockStmt*))* '}'
Label <- "case" CaseEl (',' CaseEl)* ("when" Expr)? / "default"
CaseEl <- "default" / Pattern / Ternary
Pattern <- Mod* Type ('(' (Pattern (',' Pattern)*)? ')' Ident? / Ident)
Expr <- Lambda / Ternary (AssignOp Expr)?
Assign <- Ternary AssignOp
AssignOp <- /(?:>>>|<<|>>|[+\-*\/%&|^])?=(?!=)/
Lambda <- ('(' (Params / Ident (',' Ident)*)? ')' / Ident) '->' (Block / Expr)
Ternary <- Binary ('?' (Lambda / Expr) ':' (Lambda / Ternary))?
Binary <- Unary (BinOp (Lambda / Unary) / "instanceof" ("final"? Pattern / Type))*
BinOp <- /\|\||&&|==|!=|<=|>=|>>>(?!=)|<<(?!=)|>>(?!=)|[<>](?!=)|[+\-*\/%&|^](?!=)/
Unary <- /\+\+|--|[+\-!~]/ Unary / Cast / Postfix
Cast <- '(' Prim Dims ')' Unary / '(' Type ('&' Type)* ')' !/[+\-*\/%&|^<>=?:,;)\].\[]/ !/instanceof/ (Lambda / Unary)
Postfix <- Primary Suffix* /\+\+|--/?
Suffix <- '.' ("new" NewBody / "this" / "class" / "super" / TypeArgs? Ident Args?) / '[' Expr ']' / '::' (TypeArgs? Ident / "new") 
Args <- '(' (Expr (',' Expr)*)? ')'
Primary <- Num / Str / Char / /(?:true|false|null)(?![\w$])/ / Switch / "this" Args? / "super" (Args / &/[.:]/) / "new" NewBody / '(' Expr ')' / Prim Dims ('.' "class" / '::' "new") / "void" '.' "class" / Type &'::' / ClassType Dims '.' "class" / Ident Args?
NewBody <- Annot* (Prim / ClassType) ((Annot* '[' Expr ']')+ Dims / (Annot* '[' ']')+ ArrInit / Args ClassBody?)
"""


def java() -> Grammar:
    return Grammar(JAVA, C_TRIVIA)


CSHARP = r"""
start <- Unit EOF
Unit <- (("extern" "alias" Ident ';') / Using)* GlobalAttr* TopEl*
Using <- "global"? "using" !'(' ("static" / "unsafe")? (Ident '=' Type / QName) ';'
GlobalAttr <- '[' ("assembly" / "module") ':' AttrOne (',' AttrOne)* ','? ']'
TopEl <- Namespace / Attrs Mod* TypeDecl / BlockStmt
Namespace <- "namespace" QName (';' Unit / '{' Unit '}' ';'?)
Reserved <- /(?:abstract|as|base|bool|break|byte|case|catch|char|checked|class|const|continue|decimal|default|delegate|do|double|else|enum|event|explicit|extern|false|finally|fixed|float|for|foreach|goto|if|implicit|in|int|interface|internal|is|lock|long|namespace|new|null|object|operator|out|override|params|private|protected|public|readonly|ref|return|sbyte|sealed|short|sizeof|stackalloc|static|string|struct|switch|this|throw|true|try|typeof|uint|ulong|unchecked|unsafe|ushort|using|virtual|void|volatile|while)(?!\w)/
Ident <- !Reserved /[^\W\d]\w*/ / /@[^\W\d]\w*/
QName <- (Ident '::')? Ident TypeArgs? ('.' Ident TypeArgs?)*
Str <- RawStr / /@"(?:[^"]|"")*"(?:u8)?/ / Interp / /"(?:[^"\\\n]|\\.)*"(?:u8)?/
RawStr <- /\$*("{3,})[\s\S]*?\1(?!")/
Interp <- /(?:\$@|@\$)"/ (~/(?:[^"{}]|""|\{\{|\}\})+/ / ~/\{/ Expr Format '}')* ~/"/ / /\$"/ (~/(?:[^"\\{}\n]|\\.|\{\{|\}\})+/ / ~/\{/ Expr Format '}')* ~/"/
Format <- (',' Expr)? (':' ~/[^"{}]*/)?
Char <- /'(?:[^'\\\n]|\\u[\da-fA-F]{4}|\\x[\da-fA-F]{1,4}|\\.)'/
Num <- /(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)(?:[uU][lL]?|[lL][uU]?|[fFdDmM])?(?!\w)/
Attrs <- ('[' ((/[a-z]+/ ':' !':')? AttrOne (',' AttrOne)* ','?) ']')*
AttrOne <- QName ('(' (AttrArg (',' AttrArg)*)? ')')?
AttrArg <- (Ident ('=' !'=' / ':'))? Expr
Mod <- /(?:public|protected|internal|private|static|abstract|sealed|virtual|override|readonly|extern|unsafe|new|volatile|partial|async|required|file|ref|const|fixed|scoped)(?!\w)/ !/[=;,.()+\-<>]/
TypeDecl <- ("class" / "record" ("class" / "struct")? / "struct" / "interface") Ident TypeParams? ('(' Params? ')')? (':' Type Args? (',' Type)*)? Constraint* ('{' Member* '}' ';'? / ';') / "enum" Ident (':' Type)? '{' (EnumEl (',' EnumEl)*)? ','? '}' ';'? / "delegate" Type Ident TypeParams? '(' Params? ')' Constraint* ';'
EnumEl <- Attrs Ident ('=' Expr)?
TypeParams <- '<' Attrs /(?:in|out)(?!\w)/? Ident (',' Attrs /(?:in|out)(?!\w)/? Ident)* '>'
Constraint <- "where" Ident ':' ConOne (',' ConOne)*
ConOne <- "new" '(' ')' / ("class" / "struct" / "notnull" / "unmanaged" / "default") '?'? / Type
Member <- ';' / Attrs Mod* (TypeDecl / Event / Operator / Ctor / Method / Property / Field)
Event <- "event" Type (QName '{' Accessor* '}' / VarOne (',' VarOne)* ';')
Operator <- ("implicit" / "explicit") "operator" "checked"? Type '(' Params ')' Body / Type (QName '.')? "operator" "checked"? /true|false|\+\+|--|<<|>>>?|[=!<>]=|[+\-!~*\/%&|^<>]/ '(' Params ')' Body
Ctor <- '~'? Ident '(' Params? ')' (':' ("base" / "this") Args)? Body
Method <- Type (QName '.')? MName TypeParams? '(' Params? ')' Constraint* Body
MName <- QName
Body <- Block / '=>' Expr ';' / ';'
Property <- Type (QName '.')? ("this" '[' Params ']' / QName) ('{' Accessor* '}' ('=' VarInit ';')? / '=>' Expr ';')
Accessor <- Attrs Mod* ("get" / "set" / "init" / "add" / "remove") Body
Field <- Type VarOne (',' VarOne)* ';'
VarOne <- Ident ('[' Expr ']')? ('=' VarInit)?
VarInit <- ArrInit / "ref"? Expr
ArrInit <- '{' (VarInit (',' VarInit)*)? ','? '}'
Params <- Param (',' Param)*
Param <- Attrs /(?:(?:this|ref|out|in|params|scoped|readonly)(?!\w)\s*)*/ Type Ident? ('=' Expr)? / "__arglist"
Pre <- /(?:bool|byte|sbyte|short|ushort|int|uint|long|ulong|float|double|decimal|char|string|object|void|dynamic)(?!\w)/
Type <- ("ref" "readonly"?)? TypeCore TypeTail*
TypeCore <- Pre / '(' TupleEl (',' TupleEl)+ ')' / "delegate" '*' /\w*/ TypeArgs / QName
TypeTail <- '?' !/[^)>,;\s\[\]={}(*&]?[^)>,;\s\[\]={}]*[?:]/ / '[' ','* ']' / '*'
TupleEl <- Type Ident?
TypeArgs <- '<' (','+ / Attrs Type (',' Type)*)? '>'
Block <- '{' BlockStmt* '}'
BlockStmt <- LocalFunc / LocalVar ';' / Stmt
LocalFunc <- Attrs Mod* !/(?:return|throw|await|new|else|yield|goto|case)(?!\w)/ Type Ident TypeParams? '(' Params? ')' Constraint* (Block / '=>' Expr ';')
LocalVar <- ("await"? "using" !'(')? ("const" / "scoped")? !/(?:return|throw|await|new|else|yield|goto|case)(?!\w)/ Type VarOne (',' VarOne)*
Stmt <- Block / ';' / "if" '(' Expr ')' Stmt ("else" Stmt)? / For / "while" '(' Expr ')' Stmt / "do" Stmt "while" '(' Expr ')' ';' / Try / Switch / "lock" '(' Expr ')' Stmt / "await"? "using" '(' (LocalVar / Expr) ')' Stmt / "fixed" '(' LocalVar ')' Stmt / ("checked" / "unchecked" / "unsafe") Block / "return" ("ref"? Expr)? ';' / "throw" Expr? ';' / "break" ';' / "continue" ';' / "goto" ("case" Expr / "default" / Ident) ';' / "yield" ("return" Expr / "break") ';' / Ident ':' !':' Stmt / Expr ';'
For <- "await"? "foreach" '(' (Type Ident / "var"? '(' Designators ')') "in" Expr ')' Stmt / "for" '(' (LocalVar / Expr (',' Expr)*)? ';' Expr? ';' (Expr (',' Expr)*)? ')' Stmt
Designators <- Designator (',' Designator)*
Designator <- '(' Designators ')' / Type Ident / Ident
Try <- "try" Block (("catch" ('(' Type Ident? ')')? ("when" '(' Expr ')')? Block)+ ("finally" Block)? / "finally" Block)
Switch <- "switch" ('(' Expr ')' / Expr) '{' (("case" Pattern ("when" Expr)? / "default") ':' / BlockStmt)* '}'
Pattern <- PatAnd ("or" PatAnd)*
PatAnd <- PatNot ("and" PatNot)*
PatNot <- "not" PatNot / PatOne
PatOne <- /[<>]=?/ Shift / '[' (PatSub (',' PatSub)*)? ','? ']' Ident? / '(' Pattern ')' !Ident !'{' / "var" (Ident / '(' Designators ')') / Type? ('(' (PatSub (',' PatSub)*)? ')')? '{' (PatSub (',' PatSub)*)? ','? '}' Ident? / Type '(' (PatSub (',' PatSub)*)? ')' Ident? / '(' PatSub (',' PatSub)* ')' Ident? / Type !/(?:or|and|when)(?!\w)/ Ident / Shift / Type
PatSub <- (Ident ('.' Ident)* ':')? ('..' Pattern? / Pattern)
Shift <- Unary (/[+\-*\/%]|<<|>>/ Unary)*
Expr <- Lambda / Query / Ternary (AssignOp "ref"? Expr)?
AssignOp <- /(?:\?\?|>>>|<<|>>|[+\-*\/%&|^])?=(?![=>])/
Lambda <- Attrs /(?:(?:static|async)(?!\w)\s*)*/ (("delegate" ('(' Params? ')')? Block) / (Type? '(' (Params / Ident (',' Ident)*)? ')' / Ident) '=>' (Block / "ref"? Expr))
Query <- /from(?=\s+[^\W\d])/ Type? Ident "in" Expr ("from" Type? Ident "in" Expr / "let" Ident '=' Expr / "where" Expr / "join" Type? Ident "in" Expr "on" Expr "equals" Expr ("into" Ident)? / "orderby" Expr Dir? (',' Expr Dir?)*)* ("select" Expr / "group" Expr "by" Expr) ("into" Ident ("where" Expr / "orderby" Expr Dir? / "let" Ident '=' Expr)* ("select" Expr / "group" Expr "by" Expr))?
Dir <- /(?:ascending|descending)(?!\w)/
Ternary <- Binary ('?' !/[.\[]/ (Lambda / Expr) ':' (Lambda / Expr))?
Binary <- Range (BinOp (Lambda / "throw" Expr / Range) / "is" Pattern / "as" Type / "switch" '{' (Pattern ("when" Expr)? '=>' Expr (',' / &'}'))* '}' / "with" '{' (Ident '=' Expr (',' Ident '=' Expr)*)? ','? '}')*
BinOp <- /\?\?(?!=)|\|\||&&|==|!=|<=|>=|>>>(?!=)|<<(?!=)|>>(?!=)|[<>](?!=)|[+\-*\/%&|^](?!=)/
Range <- '..' Unary? / Unary ('..' Unary?)?
Unary <- /\+\+|--|[+\-!~&*^]/ Unary / "await" !/[.;,)=]/ Unary / "throw" Expr / Cast / Postfix
Cast <- '(' Type ')' !/[+\-*\/%&|^<>=?:,;)\].\[}]/ !/(?:is|as|switch|with|in|and|or|equals|select|where|on|by)(?!\w)/ Unary
Postfix <- Primary Suffix*
Suffix <- '?' ('.' Ident TypeArgsCall? / '[' ArgList ']') / '.' Ident TypeArgsCall? / '->' Ident / '[' ArgList ']' / Args / '!' !'=' / /\+\+|--/
TypeArgsCall <- TypeArgs &/[()\].,;:?!=|^&}]|$/
Args <- '(' ArgList? ')'
ArgList <- Arg (',' Arg)*
Arg <- (Ident ':' !':')? ("out" (Type Ident / Expr) / ("ref" / "in") Expr / Expr)
Primary <- Num / Str / Char / /(?:true|false|null|this|base)(?!\w)/ / "new" New / "typeof" '(' Type ')' / "sizeof" '(' Type ')' / "nameof" '(' Expr ')' / "default" ('(' Type ')')? / ("checked" / "unchecked") '(' Expr ')' / "stackalloc" Type? ('[' Expr? ']')? ArrInit? / '(' TupleArg (',' TupleArg)* ')' / '[' (CollEl (',' CollEl)*)? ','? ']' / Pre '.' Ident TypeArgsCall? / Type Ident &/[,)=]/ / (Ident '::')? Ident TypeArgsCall?
TupleArg <- (Ident ':' !':')? ("var" Ident &/[,)]/ / Expr)
CollEl <- '..' Expr / Expr
New <- Args ObjInit? / '[' ','* ']' ArrInit / ObjInit / TypeCore '?'? ('[' Expr (',' Expr)* ']' TypeTail* ArrInit? / ('[' ','* ']')+ ArrInit / Args ObjInit? / ObjInit)
ObjInit <- '{' (InitEl (',' InitEl)*)? ','? '}'
InitEl <- (Ident / '[' ArgList ']') '=' !'=' (ObjInit / Expr) / ObjInit / Expr
"""


def csharp() -> Grammar:
    # preprocessor lines are no syntax of their own here
    return Grammar(CSHARP, r"(?:[\s﻿]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|(?<![^\n])[ \t]*#(?:if|elif|else|endif|region|endregion|pragma|nullable|define|undef|line|error|warning)\b[^\n]*)*")

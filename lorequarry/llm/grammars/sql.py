"""SQL: statements, queries and definitions as the common dialects share them."""
from __future__ import annotations

from lorequarry.llm.peg import Grammar

GRAMMAR = r"""
start <- ';'* (Stmt (';'+ Stmt)* ';'*)? EOF
Kw <- /(?:select|from|where|group|having|order|union|intersect|except|join|inner|left|right|full|cross|on|using|and|or|not|in|is|null|like|between|exists|case|when|then|else|end|create|table|view|index|insert|into|values|update|set|delete|as|distinct|limit|offset|primary|foreign|references|check|constraint|default|unique|drop|alter|add|with|all|asc|desc|returning)(?!\w)/
Name <- /"(?:[^"]|"")+"|`[^`]+`|\[[^\]\n]+\]/ / !Kw /[^\W\d][\w$]*/
AnyName <- /"(?:[^"]|"")+"|`[^`]+`|\[[^\]\n]+\]|[^\W\d][\w$]*/
QName <- Name ('.' (AnyName / '*'))*
Str <- /(?:[eEnNxXbB]|[uU]&)?'(?:[^']|'')*'/ / /\$(\w*)\$[\s\S]*?\$\1\$/
Num <- /(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?!\w)/
Stmt <- Create / Insert / Update / Delete / Alter / Drop / Truncate / Grant / Comment / Txn / SetVar / Explain / Pragma / Merge / Query
Create <- "create" ("or" "replace")? /(?:(?:global|local|temp|temporary|unlogged|external|materialized|recursive|unique|clustered|virtual)(?!\w)\s*)*/ (Table / View / Index / Func / Trigger / Schema / TypeDef / Sequence / OtherObj)
IfNot <- "if" "not" "exists"
IfEx <- "if" "exists"
Table <- "table" IfNot? QName (ColDefs TableOpt* ("as" Query)? / "as" Query / "like" QName / "partition" "of" QName Any*)
ColDefs <- '(' ColEl (',' ColEl)* ','? ')'
ColEl <- TableCon / "like" QName Word* / Name Type? ColCon*
Type <- TypeWord+ ('(' (TypeArg (',' TypeArg)*)? ')')? TypeTail* ('[' Num? ']')*
TypeWord <- !ColStart Name
ColStart <- /(?:not|null|primary|unique|default|check|references|collate|generated|auto_increment|autoincrement|constraint|identity|comment|on)(?!\w)/
TypeTail <- /(?:unsigned|zerofill|varying|precision|(?:with|without)\s+(?:local\s+)?time\s+zone)(?!\w)/
TypeArg <- Num / Str / Name ('(' Num ')')? / '*'
ColCon <- ("constraint" Name)? (("not")? "null" / "primary" "key" /(?:asc|desc)(?!\w)/? Conflict? AutoInc? / "unique" "key"? Conflict? / "default" DefaultVal / "check" '(' Expr ')' / Refs / "collate" QName / "generated" ("always" / "by" "default") "as" ("identity" ParenAny? / '(' Expr ')' /(?:stored|virtual)(?!\w)/?) / "as" '(' Expr ')' /(?:stored|virtual|persisted)(?!\w)/? / AutoInc / "identity" ParenAny? / "comment" Str / "on" "update" Expr / Defer)
Defer <- "not"? "deferrable" / "initially" Word
Conflict <- "on" "conflict" Word
AutoInc <- "auto_increment" / "autoincrement"
DefaultVal <- Unary
Refs <- "references" QName Cols? (("on" ("delete" / "update") ("cascade" / "restrict" / "set" ("null" / "default") / "no" "action")) / "match" Word / Defer)*
Cols <- '(' IndexCol (',' IndexCol)* ')'
TableCon <- ("constraint" Name)? ("primary" "key" Word? Cols Conflict? / "unique" ("key" / "index")? Name? Cols Conflict? / "check" '(' Expr ')' / "foreign" "key" Name? Cols Refs / ("index" / "key") Name? Cols / "exclude" Any*) Defer*
TableOpt <- "without" "rowid" / "strict" / "inherits" Cols / "partition" "by" Word ParenAny / "with" ParenAny / "tablespace" Name / "on" "commit" Word Word? / Word '=' (Word / Num / Str) / Word Word? '=' (Word / Num / Str) / ',' &Word / "clustered"? "by" ParenAny / "stored" "as" Word / "using" Word ParenAny? / "location" Str / "comment" Str
View <- "view" IfNot? QName Cols? ("with" ParenAny)? "as" Query ("with" /(?:cascaded|local)(?!\w)/? "check" "option" / "with" "no"? "data")?
Index <- "index" "concurrently"? IfNot? (!"on" QName)? "on" "only"? QName ("using" Word)? '(' IndexCol (',' IndexCol)* ')' ("include" Cols)? ("with" ParenAny)? ("tablespace" Name)? ("where" Expr)?
IndexCol <- Expr ("collate" QName)? Word? /(?:asc|desc)(?!\w)/? ("nulls" Word)?
Func <- ("function" / "procedure") IfNot? QName ParenAny FuncPart*
FuncPart <- "returns" ("table" ParenAny / "setof"? Type / "trigger") / "language" (Word / Str) / "as" Str (',' Str)? / "as"? "begin" Body "end" / "return" Expr / /(?:immutable|stable|volatile|strict|deterministic|leakproof|security|definer|invoker|called|on|null|input|not|cost|parallel|safe|unsafe|restricted|reads|modifies|sql|data|no|contains)(?!\w)/ / Num
Body <- (!"end" BodyEl)*
BodyEl <- "case" Body "end" "case"? / "begin" Body "end" / "if" Body "end" "if" / "loop" Body "end" "loop" / ParenAny / Str / Num / ';' / /[^\s;()'"]+/ / Name
Trigger <- "constraint"? "trigger" IfNot? QName ("before" / "after" / "instead" "of") TrigEv ("or" TrigEv)* "on" QName ("for" "each"? ("row" / "statement"))? ("when" '(' Expr ')')? ("execute" ("function" / "procedure") QName ParenAny / "begin" (Stmt ';')* "end" / Stmt)
TrigEv <- ("insert" / "delete" / "update" ("of" Name (',' Name)*)? / "truncate")
Schema <- ("schema" / "database") IfNot? (!"authorization" QName)? ("authorization" Name)?
TypeDef <- ("type" / "domain") QName ("as" ("enum" '(' (Str (',' Str)*)? ')' / "range" ParenAny / ColDefs / Type)) ColCon*
Sequence <- "sequence" IfNot? QName (/(?:start|increment|minvalue|maxvalue|cache|cycle|no|with|by|owned|as)(?!\w)/ / /-?\d+/ / QName)*
OtherObj <- ("extension" / "role" / "user" / "policy" / "rule" / "aggregate" / "operator" / "collation" / "server" / "publication" / "subscription" / "catalog") IfNot? Any+
Any <- !';' (ParenAny / Str / Num / AnyName / /[^\s;()'"\w]+/)
ParenAny <- '(' (ParenAny / Str / /[^()';]+/)* ')'
Word <- /[^\W\d]\w*/
Insert <- With? ("insert" ("or" Word)? "into"? / "replace" "into") QName ("as" Name)? ('(' QName (',' QName)* ')' !"select")? ("overriding" Word "value")? ("default" "values" / Query) OnConf? Returning?
OnConf <- "on" "conflict" (Cols ("where" Expr)? / "on" "constraint" Name)? "do" ("nothing" / "update" "set" SetList ("where" Expr)?) / "on" "duplicate" "key" "update" SetList
Returning <- "returning" Items
Update <- With? "update" ("or" Word)? QName ("as"? Name)? "set" SetList ("from" Tables)? ("where" Expr)? Returning?
SetList <- SetOne (',' SetOne)*
SetOne <- (QName / '(' QName (',' QName)* ')') '=' ("default" / Expr)
Delete <- With? "delete" "from" QName ("as"? Name)? ("using" Tables)? ("where" Expr)? Returning?
Alter <- "alter" /(?:table|view|index|sequence|schema|type|database|role|user|function|column|domain)(?!\w)/ IfEx? "only"? QName AlterOne (',' AlterOne)*
AlterOne <- "add" "column"? IfNot? TableCon / "add" ("column"? IfNot? Name Type? ColCon* / '(' ColEl (',' ColEl)* ')' / "value" IfNot? Str Any*) / "drop" ("column" / "constraint")? IfEx? Name /(?:cascade|restrict)(?!\w)/? / "rename" (("column"? Name)? "to" Name / "constraint" Name "to" Name) / "alter" "column"? Name Any+ / ("modify" / "change") "column"? Name Any+ / ("owner" "to" / "set" / "enable" / "disable" / "attach" / "detach" / "validate" / "inherit" / "cluster" / "replica") Any+
Drop <- "drop" /(?:table|view|index|sequence|schema|type|database|role|user|function|procedure|trigger|extension|domain|policy|materialized\s+view)(?!\w)/ "concurrently"? IfEx? QName ParenAny? (',' QName)* ("on" QName)? /(?:cascade|restrict)(?!\w)/?
Truncate <- "truncate" "table"? QName (',' QName)* /(?:restart|continue)\s+identity(?!\w)/? /(?:cascade|restrict)(?!\w)/?
Grant <- ("grant" / "revoke") AnyName Any* ("to" / "from") AnyName Any*
Comment <- "comment" "on" Word QName ParenAny? ("on" QName)? "is" (Str / "null")
Txn <- ("begin" / "commit" / "rollback" / "start" "transaction" / "end" / "savepoint" Name / "release" "savepoint"? Name) /(?:transaction|work|immediate|deferred|exclusive)(?!\w)/? ("to" "savepoint"? Name)? &(';' / EOF)
SetVar <- ("set" / "reset") /(?:session|local|global)(?!\w)/? AnyName ('.' AnyName)? (('=' / "to") SetVal (',' SetVal)*)? &(';' / EOF) / "use" QName
SetVal <- Str / Num / "on" / "off" / "default" / AnyName
Explain <- "explain" "analyze"? ParenAny? Stmt / ("analyze" / "vacuum") QName?
Pragma <- "pragma" QName ('=' SetVal / '(' SetVal ')')?
Merge <- With? "merge" "into" QName ("as"? Name)? "using" TableOne "on" Expr ("when" "not"? "matched" ("by" Word)? ("and" Expr)? "then" ("update" "set" SetList / "delete" / "do" "nothing" / "insert" Cols? "values" '(' ExprList ')'))+
With <- "with" "recursive"? Cte (',' Cte)*
Cte <- Name Cols? "as" ("not"? "materialized")? '(' (Insert / Update / Delete / Query) ')'
Query <- With? QTerm (("union" / "intersect" / "except" / "minus") ("all" / "distinct")? QTerm)* OrderBy? Limit*
QTerm <- '(' Query ')' / Select / "values" '(' ExprList ')' (',' '(' ExprList ')')* / "table" QName
Select <- "select" ("distinct" ("on" '(' ExprList ')')? / "all")? ("top" Num)? Items ("into" QName)? ("from" Tables)? ("where" Expr)? ("group" "by" ("all" / GroupEl (',' GroupEl)*))? ("having" Expr)? ("window" Name "as" Over (',' Name "as" Over)*)? ("qualify" Expr)?
GroupEl <- ("rollup" / "cube" / "grouping" "sets") ParenAny / Expr
Items <- Item (',' Item)*
Item <- '*' / QName '.' '*' / Expr ("as" (AnyName / Str) / Name)?
Tables <- TableOne (',' TableOne / Join)*
TableOne <- "lateral"? ('(' Query ')' / '(' Tables ')' / QName ('(' ExprList? ')')?) ("as"? Name Cols?)? ("tablesample" Word ParenAny)?
Join <- "natural"? /(?:(?:inner|cross|(?:left|right|full)(?:\s+outer)?|asof|semi|anti)(?!\w)\s*)*/ "join" TableOne ("on" Expr / "using" Cols)?
OrderBy <- "order" "by" OrderEl (',' OrderEl)*
OrderEl <- Expr /(?:asc|desc)(?!\w)/? ("nulls" ("first" / "last"))?
Limit <- "limit" Expr (',' Expr)? / "offset" Expr ("rows" / "row")? / "fetch" ("first" / "next") Num? ("rows" / "row") "only" / "for" ("update" / "share") Word*
ExprList <- Expr (',' Expr)*
Expr <- Not (("and" / "or") Not)*
Not <- "not" Not / Pred
Pred <- Arith (PredTail)*
PredTail <- CmpOp ("any" / "all" / "some")? Arith / "is" "not"? ("null" / "true" / "false" / "unknown" / "distinct" "from" Arith) / "isnull" / "notnull" / "not"? ("in" ('(' (Query / ExprList)? ')' / QName) / /(?:like|ilike|glob|regexp|rlike|match|similar\s+to)(?!\w)/ Arith ("escape" Arith)? / "between" "symmetric"? Arith "and" Arith)
CmpOp <- /<>|!=|<=|>=|==|=|<(?![<@])|>(?!>)|!?~~?\*?/
Arith <- Unary (/\|\||->>?|#>>?|<<|>>|@>|<@|&&|[+*\/%&|^\-](?!-)/ Unary)*
Unary <- /[+~]|-(?!-)/ Unary / Atom Post*
Post <- '::' Type / '[' Expr? (':' Expr?)? ']' / "at" "time" "zone" Atom / "collate" QName / "over" (Over / Name) / "filter" '(' "where" Expr ')' / "within" "group" '(' OrderBy ')'
Over <- '(' Name? ("partition" "by" ExprList)? OrderBy? (/(?:rows|range|groups)(?!\w)/ /[^()]+/)? ')'
Atom <- Num / Str / Case / Cast / "exists" '(' Query ')' / "not"? "exists" '(' Query ')' / ("array" / "row")? '[' ExprList? ']' / "interval" (Str / Num) Word? / /(?:date|time|timestamp)(?!\w)/ Str / '(' (Query / ExprList) ')' / "extract" '(' Word "from" Expr ')' / /(?:substring|trim|position|overlay)(?!\w)/ ParenAny / Call / /(?:null|true|false|default|current_timestamp|current_date|current_time|current_user)(?!\w)/ / /[?:@$]\w*/ / QName
Call <- (Name ('.' AnyName)* / /(?:left|right|replace|values|set|exists|insert)(?=\s*\()/) '(' ('*' / ("distinct" / "all")? ExprList OrderBy? Limit?)? ')'
Case <- "case" (!"when" Expr)? ("when" Expr "then" Expr)+ ("else" Expr)? "end"
Cast <- ("cast" / "try_cast") '(' Expr "as" Type ')'
"""


def sql() -> Grammar:
    return Grammar(GRAMMAR, r"(?:\s+|﻿|--[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*", ignore_case=True)

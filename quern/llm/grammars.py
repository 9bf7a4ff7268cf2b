"""Grammars of Python 3.13 (logical lines and blocks), JSON (RFC 8259) and TOML 1.0 for the derivative parser.

The Python grammar is that of the language whole: what it rejects is not valid. Tokens beginning with @ name the sort of
line. n: name, d: real number, j: imaginary number, s: string, b: bytes, f: f-string whose fields are plain names, F< and
F>: ends of any other f-string, between which F: opens a format and !r, !s, !a convert."""

PYTHON_LINE = """
line = simple_line '@simple'
  | 'if' named ':' ('@if' | simple_line '@if1') | 'elif' named ':' ('@elif' | simple_line '@elif1') | 'else' ':' ('@else' | simple_line '@else1')
  | 'while' named ':' ('@while' | simple_line '@while1') | ['async'] 'for' targets 'in' star_exprs ':' ('@for' | simple_line '@for1')
  | 'try' ':' ('@try' | simple_line '@try1') | 'finally' ':' ('@finally' | simple_line '@finally1')
  | 'except' [expr ['as' name]] ':' ('@except' | simple_line '@except1') | 'except' '*' expr ['as' name] ':' ('@group' | simple_line '@group1')
  | ['async'] 'with' (witem (',' witem)* | '(' witem (',' witem)* [','] ')') ':' ('@with' | simple_line '@with1')
  | ['async'] 'def' name [tparams] '(' [params] ')' ['->' expr] ':' ('@def' | simple_line '@def1')
  | 'class' name [tparams] ['(' [args] ')'] ':' ('@def' | simple_line '@def1') | '@' named '@deco'
  | 'match' (snamed ',' [snamed (',' snamed)* [',']] | named) ':' '@match' | 'case' patterns ['if' named] ':' ('@case' | simple_line '@case1')
simple_line = simple (';' simple)* [';']
simple = (targets '=')* (yield_expr | star_exprs) | single augop (yield_expr | star_exprs) | single ':' expr ['=' (yield_expr | star_exprs)]
  | 'return' [star_exprs] | 'pass' | 'break' | 'continue' | 'raise' [expr ['from' expr]] | 'assert' expr [',' expr]
  | 'global' name (',' name)* | 'nonlocal' name (',' name)* | 'del' deleted (',' deleted)* [','] | 'import' dotted ['as' name] (',' dotted ['as' name])*
  | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | imported (',' imported)* | '(' imported (',' imported)* [','] ')')
  | 'type' name [tparams] '=' expr
augop = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**='
imported = name ['as' name]
dotted = name ('.' name)*
witem = expr ['as' star_target]
name = 'n' | '_' | 'match' | 'case' | 'type'
place = atom trailer* ('.' name | '[' slices ']')
targets = star_target (',' star_target)* [',']
star_target = ['*'] target
target = name | place | '(' target ')' | '(' [star_target ',' [star_target (',' star_target)* [',']]] ')' | '[' [targets] ']'
single = name | place | '(' single ')'
deleted = name | place | '(' [deleted (',' deleted)* [',']] ')' | '[' [deleted (',' deleted)* [',']] ']'
star_exprs = star_expr (',' star_expr)* [',']
star_expr = expr | '*' arith
named = name ':=' expr | expr
snamed = named | '*' arith
expr = disj ['if' disj 'else' expr] | 'lambda' [lparams] ':' expr
disj = 'not'* comparison (('and' | 'or') 'not'* comparison)*
comparison = arith (compop arith)*
compop = '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' ['not']
arith = unit (binop unit)*
binop = '+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>' | '**'
unit = ('-' | '+' | '~')* ['await'] atom trailer*
trailer = '.' name | '(' [args | named comp_for] ')' | '[' slices ']'
string = 's' | 'f' | fstring
fstring = 'F<' field* 'F>'
field = '{' (yield_expr | star_exprs) ['='] ['!r' | '!s' | '!a'] ['F:' field*] '}'
atom = name | 'd' | 'j' | string string* | 'b' 'b'* | 'None' | 'True' | 'False' | '...'
  | '(' [yield_expr | named | named comp_for | snamed ',' [snamed (',' snamed)* [',']]] ')'
  | '[' [snamed (',' snamed)* [','] | named comp_for] ']'
  | '{' [pair (',' pair)* [','] | expr ':' expr comp_for | snamed (',' snamed)* [','] | named comp_for] '}'
pair = expr ':' expr | '**' arith
comp_for = (['async'] 'for' targets 'in' disj ('if' disj)*) (['async'] 'for' targets 'in' disj ('if' disj)*)*
yield_expr = 'yield' ['from' expr | star_exprs]
slices = slice (',' slice)* [',']
slice = named | '*' expr | [expr] ':' [expr] [':' [expr]]
args = (positional (',' positional)* [',' keywords] | keywords) [',']
positional = named | '*' expr
keyword = name '=' expr
keywords = keyword (',' (keyword | '*' expr))* [',' doubles] | doubles
doubles = '**' expr (',' (keyword | '**' expr))*
tparams = '[' tparam (',' tparam)* [','] ']'
tparam = name [':' expr] ['=' expr] | '*' name ['=' star_expr] | '**' name ['=' expr]
param = name [':' expr]
default = param '=' expr
plain = param (',' param)*
defaults = default (',' default)*
before = plain [',' '/' [',' plain]] [',' defaults] | [plain ','] defaults [',' '/' [',' defaults]]
star_param = name [':' star_expr]
rest = '*' star_param (',' (param | default))* [',' '**' param] | '*' ',' (param | default) (',' (param | default))* [',' '**' param] | '**' param
params = (before [',' rest] | rest) [',']
lplain = name (',' name)*
ldefault = name '=' expr
ldefaults = ldefault (',' ldefault)*
lbefore = lplain [',' '/' [',' lplain]] [',' ldefaults] | [lplain ','] ldefaults [',' '/' [',' ldefaults]]
lany = name ['=' expr]
lrest = '*' name (',' lany)* [',' '**' name] | '*' ',' lany (',' lany)* [',' '**' name] | '**' name
lparams = (lbefore [',' lrest] | lrest) [',']
patterns = pattern | spattern ',' [spattern (',' spattern)* [',']]
spattern = pattern | '*' name
pattern = closed ('|' closed)* ['as' capture]
capture = 'n' | 'match' | 'case' | 'type'
literal = ['-'] ('d' | 'j') | ['-'] 'd' ('+' | '-') 'j' | string string* | 'b' 'b'* | 'None' | 'True' | 'False'
closed = literal | dotted ['(' [pargs] ')'] | '(' [pattern | spattern ',' [spattern (',' spattern)* [',']]] ')' | '[' [spattern (',' spattern)* [',']] ']'
  | '{' [mapped (',' mapped)* [',' '**' capture] [','] | '**' capture [',']] '}'
mapped = (literal | name '.' dotted) ':' pattern
pargs = (pattern (',' pattern)* [',' kpattern (',' kpattern)*] | kpattern (',' kpattern)*) [',']
kpattern = name '=' pattern
"""

PYTHON_BLOCK = """
file = stmt*
block = '>' stmt stmt* '<'
stmt = '@simple' | ('@if' block | '@if1') ('@elif' block | '@elif1')* [orelse] | ('@while' block | '@while1' | '@for' block | '@for1') [orelse]
  | '@with' block | '@with1' | '@deco'* ('@def' block | '@def1')
  | ('@try' block | '@try1') (final | handler handler* [orelse] [final] | ghandler ghandler* [orelse] [final])
  | '@match' '>' ('@case' block | '@case1') ('@case' block | '@case1')* '<'
orelse = '@else' block | '@else1'
final = '@finally' block | '@finally1'
handler = '@except' block | '@except1'
ghandler = '@group' block | '@group1'
"""

JSON = """
value = 's' | 'd' | 'true' | 'false' | 'null' | '{' [member (',' member)*] '}' | '[' [value (',' value)*] ']'
member = 's' ':' value
"""

#: k: key, v: value without parts, l: line end.
TOML = """
file = [entry] ('l' [entry])*
entry = key '=' value | '[' key ']' | '[[' key ']]'
key = 'k' ('.' 'k')*
value = 'v' | '[' 'l'* [value 'l'* (',' 'l'* value 'l'*)* [',' 'l'*]] ']' | '{' [key '=' value (',' key '=' value)*] '}'
"""

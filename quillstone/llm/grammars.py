"""Grammars of the source languages, as token rules for :mod:`derive`.

``<`` and ``>`` are single tokens everywhere but in Python, so that nested type arguments need no special case."""

JAVA = """
unit = { ';' } [ pkg { ';' } ] { import { ';' } } { typedecl | ';' } ;
pkg = { ann } 'package' qname ';' ;
import = 'import' [ 'static' ] ID { '.' ID } [ '.' '*' ] ';' ;
qname = ID { '.' ID } ;
ann = '@' qname [ '(' [ annargs ] ')' ] ;
annargs = annarg { ',' annarg } ;
annarg = [ ID '=' ] annvalue ;
annvalue = ternary | ann | '{' [ annvalue { ',' annvalue } ] [ ',' ] '}' ;
mod = 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | ann ;
typedecl = { mod } kind ;
kind = class | iface | enum | annot | record ;
class = 'class' ID [ tparams ] [ 'extends' type ] [ 'implements' types ] [ ID types ] body ;
iface = 'interface' ID [ tparams ] [ 'extends' types ] [ ID types ] body ;
annot = '@' 'interface' ID body ;
record = ID ID [ tparams ] '(' [ params ] ')' [ 'implements' types ] body ;
enum = 'enum' ID [ 'implements' types ] '{' [ const { ',' const } ] [ ',' ] [ ';' { member } ] '}' ;
const = { ann } ID [ args ] [ body ] ;
tparams = '<' tparam { ',' tparam } '>' ;
tparam = { ann } ID [ 'extends' type { '&' type } ] ;
types = type { ',' type } ;
body = '{' { member } '}' ;
member = ';' | { mod } ( block | kind | named ) ;
named = [ tparams ] ( ID '(' [ params ] ')' [ 'throws' types ] block | ID block | ( type | 'void' ) ID ( '(' [ params ] ')' dims [ 'throws' types ] ( block | [ 'default' annvalue ] ';' ) | declrest ';' ) ) ;
declrest = dims [ '=' init ] { ',' ID dims [ '=' init ] } ;
init = expr | '{' [ init { ',' init } ] [ ',' ] '}' ;
dims = { { ann } '[' ']' } ;
params = param { ',' param } ;
param = { mod } type [ '...' ] ( ID { '.' ID } [ '.' 'this' ] | 'this' ) dims ;
prim = 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' ;
type = { ann } ( prim | ID [ targs ] { '.' { ann } ID [ targs ] } ) dims ;
targs = '<' [ targ { ',' targ } ] '>' ;
targ = type | { ann } '?' [ ( 'extends' | 'super' ) type ] ;
block = '{' { stmt } '}' ;
par = '(' expr ')' ;
stmt = block | ';' | 'if' par stmt [ 'else' stmt ] | 'while' par stmt | 'do' stmt 'while' par ';' | 'for' '(' forctl ')' stmt
  | 'return' [ expr ] ';' | 'break' [ ID ] ';' | 'continue' [ ID ] ';' | 'throw' expr ';' | 'assert' expr [ ':' expr ] ';'
  | 'try' [ '(' resource { ';' resource } [ ';' ] ')' ] block { catch } [ 'finally' block ] | 'synchronized' par block
  | switch | ID ':' stmt | { mod } type ID declrest ';' | { mod } kind | action ';' | ID expr ';' ;
catch = 'catch' '(' { mod } type { '|' type } ID ')' block ;
resource = { mod } type ID '=' expr | postfix ;
forctl = [ { mod } type ID declrest | action { ',' action } ] ';' [ expr ] ';' [ action { ',' action } ] | { mod } type ID ':' expr ;
switch = 'switch' par '{' { label | stmt } '}' ;
label = 'case' pattern { ',' pattern } ( ':' | '->' ) | 'default' ( ':' | '->' ) ;
pattern = ternary | 'default' | { mod } type ID ;
action = postfix asg expr | incdec postfix | postfix incdec | atom { suffix } args | atom { suffix } '.' 'new' ID [ targs ] args [ body ] | creator { suffix } ;
incdec = '++' | '--' ;
asg = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<' '<=' | '>' '>=' | '>' '>' '>=' ;
expr = ternary [ asg expr ] | lambda ;
lambda = ( ID | '(' [ lparam { ',' lparam } ] ')' ) '->' ( expr | block ) ;
lparam = ID | param ;
ternary = binary [ '?' expr ':' ( ternary | lambda ) ] ;
binary = unary { op unary | 'instanceof' [ 'final' ] type [ ID ] } ;
op = '+' | '-' | '*' | '/' | '%' | '&&' | '||' | '&' | '|' | '^' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<' '<' | '>' '>' | '>' '>' '>' ;
unary = ( '+' | '-' | '!' | '~' | '++' | '--' ) unary | '(' type { '&' type } ')' ( unary | lambda ) | postfix [ incdec ] ;
postfix = atom { suffix } ;
args = '(' [ expr { ',' expr } ] ')' ;
creator = 'new' { ann } ( prim | ID [ targs ] { '.' ID [ targs ] } ) ( args [ body ] | { '[' expr ']' } dims | '[' ']' dims init ) ;
atom = NUM | STR | CHR | 'true' | 'false' | 'null' | 'this' | 'super' | ID | '(' expr ')' | creator | ( prim | 'void' ) dims '.' 'class' | type '::' ( ID | 'new' ) | switch ;
suffix = '.' [ targs ] ( ID | 'this' | 'super' ) | '.' 'class' | '[' expr ']' | '[' ']' dims '.' 'class' | args | '::' ( ID | 'new' ) | '.' creator ;
"""

C = """
unit = { external } ;
external = ';' | [ '__extension__' ] specs ( declarator ( block | { kr } block | declrest ';' ) | ';' ) | declarator block | 'asm' '(' STR ')' ';' | '_Static_assert' '(' expr ',' STR ')' ';' ;
kr = specs declarator { ',' declarator } ';' ;
declrest = [ asmattr ] [ '=' init ] { ',' declarator [ asmattr ] [ '=' init ] } ;
asmattr = attr { attr } ;
attr = '__attribute__' '(' '(' [ attrs ] ')' ')' | 'asm' '(' STR ')' ;
attrs = ID [ '(' [ args ] ')' ] { ',' ID [ '(' [ args ] ')' ] } ;
qual = 'const' | 'volatile' | 'restrict' | 'static' | 'extern' | 'register' | 'auto' | 'typedef' | 'inline' | '_Noreturn' | '_Atomic' | '_Thread_local' | attr ;
prim = 'int' | 'long' | 'short' | 'char' | 'void' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Complex' ;
specs = { qual } ( prim { prim | qual } | ( ID | record | enum | 'typeof' '(' ( expr | typename ) ')' ) { qual } ) | qual { qual } ;
record = ( 'struct' | 'union' ) { attr } ( ID [ fields ] | fields ) ;
fields = '{' { ';' | specs [ fielddecl { ',' fielddecl } ] ';' } '}' { attr } ;
fielddecl = declarator [ ':' ternary ] { attr } | ':' ternary ;
enum = 'enum' ( ID [ values ] | values ) ;
values = '{' value { ',' value } [ ',' ] '}' ;
value = ID [ '=' ternary ] ;
pointer = '*' { qual } ;
declarator = { pointer } ( ID | '(' { attr } declarator ')' ) { direct } ;
direct = '[' { qual } [ '*' | expr ] ']' | '(' [ params ] ')' ;
params = param { ',' param } [ ',' '...' ] | '...' ;
param = specs [ declarator | abstract ] ;
abstract = pointer { pointer } { direct } | { pointer } '(' abstract ')' { direct } | direct { direct } ;
typename = specs [ abstract ] ;
init = expr1 | '{' [ element { ',' element } ] [ ',' ] '}' ;
element = [ designator { designator } '=' ] init ;
designator = '.' ID | '[' expr ']' ;
block = '{' { stmt } '}' ;
par = '(' expr ')' ;
stmt = block | ';' | expr ';' | 'if' par stmt [ 'else' stmt ] | 'while' par stmt | 'do' stmt 'while' par ';' | 'for' '(' ( decl | [ expr ] ';' ) [ expr ] ';' [ expr ] ')' stmt
  | 'switch' par stmt | 'case' ternary [ '...' ternary ] ':' | 'default' ':' | 'return' [ expr ] ';' | 'break' ';' | 'continue' ';' | 'goto' ID ';' | ID ':' | decl | 'asm' [ 'volatile' ] '(' STR { ( ':' | ',' ) [ STR [ par ] ] } ')' ';' ;
decl = specs [ declarator declrest ] ';' | '_Static_assert' '(' expr ',' STR ')' ';' ;
expr = expr1 { ',' expr1 } ;
args = expr1 { ',' expr1 } ;
expr1 = ternary [ asg expr1 ] ;
asg = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<' '<=' | '>' '>=' ;
ternary = binary [ '?' [ expr ] ':' ternary ] ;
binary = unary { op unary } ;
op = '+' | '-' | '*' | '/' | '%' | '&&' | '||' | '&' | '|' | '^' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<' '<' | '>' '>' ;
unary = ( '+' | '-' | '!' | '~' | '++' | '--' | '*' | '&' ) unary | 'sizeof' ( unary | '(' typename ')' ) | '(' typename ')' ( unary | '{' [ element { ',' element } ] [ ',' ] '}' ) | postfix ;
postfix = atom { '[' expr ']' | '(' [ carg { ',' carg } ] ')' | '.' ID | '->' ID | '++' | '--' } ;
carg = expr1 | typename ;
atom = NUM | CHR | ID | STR { STR | ID } | '(' expr ')' | '(' block ')' ;
"""

GO = """
unit = { ';' } 'package' ID ';' { import ';' | ';' } { top ';' | ';' } ;
import = 'import' ( spec | '(' [ spec { ';' spec } ] [ ';' ] ')' ) ;
spec = [ ID | '.' ] STR ;
top = func | decl ;
decl = 'var' ( var | '(' [ var { ';' var } ] [ ';' ] ')' ) | 'const' ( cons | '(' [ cons { ';' cons } ] [ ';' ] ')' ) | 'type' ( tdef | '(' [ tdef { ';' tdef } ] [ ';' ] ')' ) ;
ids = ID { ',' ID } ;
exprs = expr { ',' expr } ;
var = ids ( type [ '=' exprs ] | '=' exprs ) ;
cons = ids [ [ type ] '=' exprs ] ;
tdef = ID [ '[' tparams ']' ] [ '=' ] type ;
tparams = tparam { ',' tparam } [ ',' ] ;
tparam = ID { ',' ID } constraint ;
constraint = [ '~' ] type { '|' [ '~' ] type } ;
func = 'func' [ params ] ID [ '[' tparams ']' ] params [ result ] [ block ] ;
params = '(' [ param { ',' param } ] [ ',' ] ')' ;
param = [ ID ] [ '...' ] type ;
result = params | type ;
type = ID [ '.' ID ] [ '[' type { ',' type } [ ',' ] ']' ] | '*' type | '[' [ expr | '...' ] ']' type | 'map' '[' type ']' type | 'chan' [ '<' '-' ] type | '<' '-' 'chan' type | 'func' params [ result ]
  | 'struct' '{' [ field { ';' field } ] [ ';' ] '}' | 'interface' '{' [ method { ';' method } ] [ ';' ] '}' | '(' type ')' ;
field = ( ids type | [ '*' ] ID [ '.' ID ] [ '[' type { ',' type } ']' ] ) [ STR ] ;
method = ID params [ result ] | constraint ;
block = '{' stmts '}' ;
stmts = [ stmt ] { ';' [ stmt ] } ;
stmt = simple | decl | block | if | for | switch | select | 'go' expr | 'defer' expr | 'return' [ exprs ] | 'break' [ ID ] | 'continue' [ ID ] | 'goto' ID | 'fallthrough' | ID ':' [ stmt ] ;
simple = exprs [ ( ':=' | asg ) exprs | '++' | '--' | '<' '-' expr ] ;
asg = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<' '<=' | '>' '>=' | '&^=' ;
if = 'if' [ [ simple ] ';' ] expr block [ 'else' ( if | block ) ] ;
for = 'for' [ expr | [ simple ] ';' [ expr ] ';' [ simple ] | [ exprs ( ':=' | '=' ) ] 'range' expr ] block ;
switch = 'switch' [ [ simple ] ';' ] [ simple ] '{' { clause } '}' ;
clause = ( 'case' exprtypes | 'default' ) ':' stmts ;
exprtypes = exprtype { ',' exprtype } ;
exprtype = expr ;
select = 'select' '{' { ( 'case' simple | 'default' ) ':' stmts } '}' ;
expr = unary { op unary } ;
op = '+' | '-' | '*' | '/' | '%' | '&&' | '||' | '&' | '|' | '^' | '&^' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<' '<' | '>' '>' ;
unary = ( '+' | '-' | '!' | '^' | '*' | '&' | '<' '-' ) unary | primary ;
primary = operand { suffix } ;
operand = NUM | STR | CHR | ID | '(' expr ')' | 'func' params [ result ] [ block ] | complex ;
complex = '[' [ expr | '...' ] ']' type | 'map' '[' type ']' type | 'struct' '{' [ field { ';' field } ] [ ';' ] '}' | 'chan' [ '<' '-' ] type | '<' '-' 'chan' type | 'interface' '{' [ method { ';' method } ] [ ';' ] '}' ;
suffix = '.' ID | '.' '(' ( type | 'type' ) ')' | '[' ( expr ( { ',' expr } [ ',' ] | ':' [ expr ] [ ':' expr ] ) | ':' [ expr ] [ ':' expr ] ) ']' | '(' [ args ] ')' | elements ;
args = exprtype { ',' exprtype } [ '...' ] [ ',' ] ;
elements = '{' [ element { ',' element } [ ',' ] ] '}' ;
element = ( expr | elements ) [ ':' ( expr | elements ) ] ;
"""

JAVASCRIPT = """
unit = { stmt } ;
stmt = block | ';' | var ';' | expr ';' | function | class | if | 'while' par stmt | 'do' stmt 'while' par [ ';' ] | 'for' [ 'await' ] '(' forctl ')' stmt
  | 'return' [ expr ] ';' | 'break' [ ID ] ';' | 'continue' [ ID ] ';' | 'throw' expr ';' | 'try' block ( 'catch' [ '(' binding ')' ] block [ 'finally' block ] | 'finally' block )
  | 'switch' par '{' { ( 'case' expr | 'default' ) ':' { stmt } } '}' | ID ':' stmt | 'debugger' ';' | import | export | 'with' par stmt ;
block = '{' { stmt } '}' ;
par = '(' expr ')' ;
if = 'if' par stmt [ 'else' stmt ] ;
var = ( 'var' | 'let' | 'const' ) declared { ',' declared } ;
declared = binding [ '=' asgn ] ;
binding = ID | '[' [ bindelem ] { ',' [ bindelem ] } ']' | '{' [ bindprop { ',' bindprop } ] [ ',' ] '}' ;
bindelem = [ '...' ] binding [ '=' asgn ] ;
bindprop = ID [ '=' asgn ] | key ':' bindelem | '...' binding ;
forctl = [ var | expr ] ';' [ expr ] ';' [ expr ] | ( ( 'var' | 'let' | 'const' ) binding | primary ) ( 'in' | 'of' ) expr ;
function = [ 'async' ] 'function' [ '*' ] ID params block ;
params = '(' [ bindelem { ',' bindelem } ] [ ',' ] ')' ;
class = 'class' ID [ 'extends' primary ] classbody ;
classbody = '{' { classmember } '}' ;
classmember = ';' | [ 'static' ] [ 'async' ] [ '*' ] [ 'get' | 'set' ] key params block | [ 'static' ] [ 'get' | 'set' | 'async' ] key [ '=' asgn ] ';' | 'static' block | 'static' params block | 'static' [ '=' asgn ] ';' ;
key = name | STR | NUM | '[' asgn ']' | '#' ID ;
name = ID | 'if' | 'else' | 'while' | 'do' | 'for' | 'return' | 'break' | 'continue' | 'throw' | 'try' | 'catch' | 'finally' | 'switch' | 'case' | 'default' | 'debugger' | 'import' | 'export' | 'with' | 'var' | 'const' | 'in' | 'instanceof' | 'function' | 'class' | 'extends' | 'static' | 'new' | 'delete' | 'typeof' | 'void' | 'this' | 'super' | 'null' | 'true' | 'false' | 'async' | 'await' | 'yield' | 'let' | 'of' | 'get' | 'set' ;
import = 'import' ( STR | importwhat ID STR ) ';' ;
importwhat = ID [ ',' ( '*' ID ID | imports ) ] | '*' ID ID | imports ;
imports = '{' [ imported { ',' imported } ] [ ',' ] '}' ;
imported = name [ ID name ] ;
export = 'export' ( 'default' ( asgn ';' | function | class | 'class' [ 'extends' primary ] classbody ) | imports [ ID STR ] ';' | '*' [ ID name ] ID STR ';' | var ';' | function | class ) ;
expr = asgn { ',' asgn } ;
asgn = arrow | 'yield' [ [ '*' ] asgn ] | ternary [ asg asgn ] ;
arrow = [ 'async' ] ( ID | params ) '=>' ( asgn | block ) ;
asg = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<' '<=' | '>' '>=' | '>' '>' '>=' | '**=' | '&&=' | '||=' | '??=' ;
ternary = binary [ '?' asgn ':' asgn ] ;
binary = unary { op unary } ;
op = '+' | '-' | '*' | '/' | '%' | '**' | '&&' | '||' | '??' | '&' | '|' | '^' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<' '<' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof' ;
unary = ( '+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' ) unary | primary [ '++' | '--' ] ;
primary = atom { suffix } ;
suffix = '.' ( name | '#' ID ) | '?.' ( name | '[' expr ']' | args ) | '[' expr ']' | args | TPL ;
args = '(' [ arg { ',' arg } ] [ ',' ] ')' ;
arg = [ '...' ] asgn ;
atom = NUM | STR | TPL | REX | ID | 'async' | 'of' | 'get' | 'set' | 'let' | 'static' | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | '[' [ arg ] { ',' [ arg ] } ']' | '{' [ prop { ',' prop } ] [ ',' ] '}'
  | [ 'async' ] 'function' [ '*' ] [ ID ] params block | 'class' [ ID ] [ 'extends' primary ] classbody | 'new' newrest | 'import' args ;
newrest = 'new' newrest | '.' ID | atom { '.' ( name | '#' ID ) | '[' expr ']' } [ args ] ;
prop = ID [ '=' asgn ] | 'async' | 'get' | 'set' | 'of' | 'let' | 'static' | key ':' asgn | [ 'async' ] [ '*' ] [ 'get' | 'set' ] key params block | '...' asgn ;
"""

PYTHON = """
unit = { NL | stmt } ;
stmt = line | compound ;
line = small { ';' small } [ ';' ] NL ;
small = exprstmt | 'pass' | 'break' | 'continue' | 'return' [ tests ] | 'raise' [ test [ 'from' test ] ] | ( 'global' | 'nonlocal' ) ID { ',' ID } | 'del' tests | 'assert' test [ ',' test ]
  | 'import' dotted { ',' dotted } | 'from' ( { '.' | '...' } path | ( '.' | '...' ) { '.' | '...' } ) 'import' ( '*' | names | '(' names [ ',' ] ')' ) ;
path = ID { '.' ID } ;
dotted = path [ 'as' ID ] ;
names = ID [ 'as' ID ] { ',' ID [ 'as' ID ] } ;
exprstmt = tests [ ':' test [ '=' value ] | aug value | '=' value { '=' value } ] | yield { '=' value } ;
value = tests | yield ;
aug = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '**=' | '>>=' | '<<=' | '&=' | '^=' | '|=' | '@=' ;
yield = 'yield' [ 'from' test | tests ] ;
suite = line | NL { NL } INDENT stmt { NL | stmt } DEDENT ;
compound = if | 'while' named ':' suite [ 'else' ':' suite ] | [ 'async' ] 'for' tests0 'in' tests ':' suite [ 'else' ':' suite ]
  | 'try' ':' suite ( except { except } [ 'else' ':' suite ] [ 'finally' ':' suite ] | 'finally' ':' suite )
  | [ 'async' ] 'with' ( item { ',' item } | '(' item { ',' item } [ ',' ] ')' ) ':' suite | { '@' named NL { NL } } ( [ 'async' ] def | class ) ;
if = 'if' named ':' suite { 'elif' named ':' suite } [ 'else' ':' suite ] ;
except = 'except' [ '*' ] [ tests [ 'as' ID ] ] ':' suite ;
item = test [ 'as' target ] ;
def = 'def' ID [ '[' tests ']' ] '(' [ params ] ')' [ '->' test ] ':' suite ;
class = 'class' ID [ '[' tests ']' ] [ '(' [ args ] ')' ] ':' suite ;
params = param { ',' param } [ ',' ] ;
param = ID [ ':' [ '*' ] test ] [ '=' test ] | '*' [ ID [ ':' [ '*' ] test ] ] | '**' ID [ ':' test ] | '/' ;
lparams = lparam { ',' lparam } [ ',' ] ;
lparam = ID [ '=' test ] | '*' [ ID ] | '**' ID | '/' ;
target = [ '*' ] bitor ;
tests0 = target { ',' target } [ ',' ] ;
tests = starred { ',' starred } [ ',' ] ;
starred = '*' bitor | named ;
named = [ ID ':=' ] test ;
test = or [ 'if' or 'else' test ] | 'lambda' [ lparams ] ':' test ;
or = not { ( 'or' | 'and' ) not } ;
not = { 'not' } compare ;
compare = bitor { comp bitor } ;
comp = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' [ 'not' ] ;
bitor = unary { op unary } ;
op = '+' | '-' | '*' | '/' | '//' | '%' | '**' | '&' | '|' | '^' | '<<' | '>>' | '@' ;
unary = { '+' | '-' | '~' } [ 'await' ] atom { suffix } ;
suffix = '.' ID | '(' [ args ] ')' | '[' subscript { ',' subscript } [ ',' ] ']' ;
subscript = '*' bitor | ID ':=' test | test [ slice ] | slice ;
slice = ':' [ test ] [ ':' [ test ] ] ;
args = arg { ',' arg } [ ',' ] ;
arg = named [ comprehension ] | ID '=' test | '*' test | '**' test ;
comprehension = [ 'async' ] 'for' tests0 'in' or { 'if' ornamed } [ comprehension ] ;
ornamed = [ ID ':=' ] or | 'lambda' [ lparams ] ':' test ;
atom = ID | NUM | STR { STR } | 'None' | 'True' | 'False' | '...' | '(' [ yield | several ] ')' | '[' [ several ] ']' | '{' [ dictorset ] '}' ;
several = starred ( comprehension | more ) ;
more = { ',' starred } [ ',' ] ;
dictorset = '**' bitor pairs | '*' bitor ( comprehension | more ) | ID ':=' test ( comprehension | more ) | test ( ':' test ( comprehension | pairs ) | comprehension | more ) ;
pairs = { ',' dictitem } [ ',' ] ;
dictitem = test ':' test | '**' bitor ;
"""

TAL = """
unit = { item } ;
item = ';' | ( DECL | block ) { part } ';' ;
part = WORD | DECL | block ;
block = 'BEGIN' { part | ';' } 'END' ;
"""

"""Words of the texts of Python's manual by frequency there: English prose with many words of programming."""

PLAIN = """class object value type function method name statement exception self used other list
attribute instance module will expression when string which return also only defined same code version should objects
sequence except argument arguments values built must dictionary using types following clause pattern called suite
methods number tuple they such first then parameter within given namespace names block case than call identifier does
classes attributes keyword raise definition executed functions more characters import range special current global
result operations implementation evaluated print variable line items section there implement character returns
variables assignment execution context empty created base support mapping parameters target raised annotation item
syntax keys bound finally operation most length scope point left iterable expressions like their sequences local
comparison form raises positional else equivalent single each after where reference either always before found through
define dict subject mutable standard cannot last strings statements descriptor integer present these assigned right
equal bytes instances defines containing those operator numbers passed lists index start literals order specified
corresponding different manager interpreter slice async returned frame command part contains true match yield numeric
uses means scopes into occurs were being been including some while explicitly negative behavior binding pass possible
body available described hash continue generic program normal both references next step metaclass iterator over level
between multiple instead nested data whose matches breakpoint copy original immutable implemented elements format
width debugger exceptions create rather considered annotations contain calls runtime yields unless future error
provide directly evaluation literal complex without break allows operators formatting time traceback digits count
division represent false loop matching information arbitrary decimal stack slicing definitions nonlocal evaluate
optional decorators would invoked precision option source defaults await func imported another subclass float valid
compare handler patterns about added appropriate even floating otherwise converted integers container field simple
rules treated read because owner arithmetic operand enclosing commands evaluates least primary detail handled actually
examples sets itself space sign indicates mappings display refer comma less during assignments coroutine documentation
search override additional formal semantics until calling builtins determined subscription property similar meaning
stored iteration exit made identity common custom note contained group stop view generator specification binary
augmented back done them allow identifiers modules follows below lookup globals whether required allowed execute alias
representation prefix presentation include place addition inside asynchronous leading still certain descriptors recent
formatted file separator separated resulting square side pair never static iter text customize control accessed
interpreted defining exec once stdin immediately cases provided typically exist lines omitted change digit feature
debugging under brackets trailing occur already keywords aliases total setting protocol followed follow particular
around clear clauses repr caught guard lambda above constructor currently reversed latter targets hand exactly removed
named supports needs attr declared slot help inheritance customized since bitwise truth useful need executes
introduced collections garbage condition pairs conversion args hashable free chars parentheses cause usually specific
tuples provides transformed computed language event accept represents super affect just creation bases results modulo
second executable appear notation library handling double versions replacement represented table reverse bytecode
compile remaining applies underscore callable changes derived eval replaced nearest specify contents becomes decorator
doesn bytearray binds iterate continues entire normally subpatterns terms defparameter full reflected lineno efficient
buffer enclosed creating refers description bounds collection regular proper package important auditing specifying
general overridden classmethod listed needed produce priority power intended compiled written flow supplied explicit
often effect retrieved abstract tests words substring header selects locals generally underlying resolution supported
identified concatenation resolved errors happened includes unary membership newline escape bind depending various
hierarchy operands automatically however spam deletion fails take implicit specifies kind dynamic precedence depends
saved slots check output floor metaclasses what equality well cleanup repeated deleted managers against guaranteed
subpattern constraints related cased subclasses environment correctly insertion features encoding trace bpnumber
removes suffix maxsplit backslash convenient insert assign apply lower actual difference proposal semantically outside
enter occurring inserted imaginary avoid invocation third looked decorated declaration works parent applied style
containers dictionaries terminates possibly interpretation rich constructed based compared ordered ordering frozenset
sorted executing testing makes previous usage loaded later included quotes matched blocks succeed irrefutable real
times fixed formed isinstance lazily recommended interactive breakpoints script letters locale remove make fail
details copied quote fill positive indices bacon views unpacking writable points running lexical searched accessible
appears adding invoke bindings individual differ prevent divmod known boolean roughly comprehension excess although
grammar comparisons direct element colon rest inner translated exited soft further byte penguin options implements
builds enabled middle greater referenced entries occurred fields align larger representing sort bits indexed requested
prefixed many previously creates properties existing implies modified caused attempt occurrence mechanism inserting
delete starting neither automatic repetition builtin convert processed could inherit checkers changed bool though
implementing restriction handlers reached handle cycle reraise wrapped guarantees write takes skip steps associated
modifies declarations implicitly causes files compute look fall size recognized whitespace here filename ignore
qualified digitpart alignment position category uppercase lowercase falls shift kwargs column assert assigns
recursively outer occurrences subscript upper evaluating typing funcname able aexit longer hence looking sensitive
store converts overrides customization likely require passes inspect indicate unbound said desired overriding strictly
commonly syntactically filled purpose therefore compound illegal virtual surrounding cleared attached preceding
temporarily proceeds reason ignored discussed succeeds flag every detected work syntactic initialized again entry
necessary printed resource extension usable requires process interface split displays find ways aligned centered
coefficient large emulate become memory behaviour popitem update fillchar spacious splits escapes juice failed message
attributeref starred rebound asked leaving combination augtarget unlike performs performed mangled parenthesized
coroutines begins underscores accesses raising accessing weak produced multiplication absolute really placed determine
shared collected descriptions newly mostly preserved much lead indirect fact across numerical ranges internal depend
iterating groups separate conditional elif starts handles grouping denote logical precise unchanged missing anything
purposes quoted established users several happens wrapper gets mentioned enables immediate lazy propagated inherits
memoryview docstring state resources suppress upon returning together doing frames themselves post mortem understood
prompt debug debugged active indicated convenience jump namespaces word braces denotes earlier extend introduce
contexts flags octal zeros letter significant shows respectively restrictions titlecase reserved relative release
close open indexes proxy algorithm comparing removing extra iterated eggs sausage sorting optimization displayed
perform optionally asterisk minus final necessarily replace thus taken sometimes augop assigning looks consists aenter
transformation member rule lookups parents party expected chain contrast staticmethod declare members speed limited
child retrieving levels former mathematical equals passing produces providing regardless having proposed classname
gives discarded restrictive unexpected chained imply indirectly identities unequal performance consistency
initialization subsequent none problem tested skips generate along suppressed background input success shorthand
capture scoping usual compares duplicate accepted receiving defaulting presence hint forward behave listing kinds
flavors translation capitalized registered invoking wishes modifying ensure destroyed warning informal printable
singleton swapped reflection python retrieve unhashable checking affects want explained give typed determines interact
curly comprehensions exceptional model main selected constructs structural beginning extends introduces anywhere
exponent escaped padding scientific show latitude longitude coord center compatibility compiler ternary ndigits sense
unique preserve versus improper stride hook meets enum might parameterized getattribute positions stripped delimiter
backslashes finite intrinsic instruction yielded accepts dictview operates expr circumstances modify writes
subscripted invalid prints updated achieve annotated tools suspended standalone supporting textually front floatnumber
obtain intentional reasons infinite meaningful deletions sorts excluding dotted inheriting action conventional smaller
printf series unfilled calculated consequence unpackings classdef perhaps motivation intuitive identical inputs
consistent enforce negation inverse ends funcdef suites long repeats turn keeping alive reset combined leaves
encapsulated location surrounded failure attempted successful rely exact dependent cache bubbles happen purely failing
corresponds forms stops soon construction hasattr expressed especially appending anonymous powerful preserving
primarily subtype locking describe caller conversions postpone cyclic cycles nicely differs convention paragraph
interoperate attempts remain constant invocations easily tracebacks typical restart optimized slightly nosigint readrc
touch tracing spaces exclamation entered separating directory breaks quit stopping bottom originally initialised
recursive very resolving breaking piece relied limitation searching resolve pointfloat share brace preceded specifiers
coercion dynamically alternate thousands aware formats directive referred plus backwards ordinary basic loading
initializing commas locally dots behaves prior integral situations whenever math delegation mutability unreachable
detection linked keep external almost chaining approach involving tightly setdefault append subscripting consider
degree cell issubclass cost strict according iskeyword excepting combinations mapped splitting consecutive keepends
stringprefix longstringitem bytesprefix shortbytesitem longbytesitem bytesescapeseq triple machine getting updates
storing shallow dishes symbol easier imposed concatenating meet economy remind""".split()

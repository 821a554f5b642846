"""Diagnostics and comments in wordings of public tools, written apart from the tables: a test of readers on what they were not tuned to."""

from graphloom.llm import docpairs, repair

#: What public compilers and parsers say of a text that breaks their grammar.
BREAKS = """SyntaxError: Unexpected token '}'
SyntaxError: missing ) after argument list
SyntaxError: Unexpected end of input
SyntaxError: Invalid or unexpected token
SyntaxError: EOL while scanning string literal
SyntaxError: '(' was never closed
IndentationError: unindent does not match any outer indentation level
IndentationError: expected an indented block after 'if' statement on line 3
TabError: inconsistent use of tabs and spaces in indentation
SyntaxError: closing parenthesis ']' does not match opening parenthesis '('
SyntaxError: cannot assign to function call
error: expected ';' before 'return'
error: expected '}' at end of input
error: stray '\\302' in program
error: unterminated #ifdef
error: missing terminating " character
error: expected unqualified-id before numeric constant
error: expected primary-expression before ')' token
fatal error: extraneous closing brace ('}')
error: expected expression
class, interface, or enum expected
reached end of file while parsing
unclosed string literal
illegal start of type
not a statement
';' expected
<identifier> expected
error[E0765]: unterminated double quote string
error: this file contains an unclosed delimiter
error: mismatched closing delimiter: `)`
error: expected one of `!` or `::`, found `fn`
error: unexpected closing delimiter: `}`
syntax error: unexpected newline, expecting comma or )
syntax error: non-declaration statement outside function body
expected 'package', found 'func'
missing return type or unexpected semicolon or newline before {
syntax error, unexpected end-of-input, expecting 'end'
syntax error, unexpected '}', expecting end of file
PHP Parse error: syntax error, unexpected token ";", expecting "]"
Parse error: syntax error, unexpected identifier "foo"
error TS1005: ',' expected.
error TS1109: Expression expected.
error TS1128: Declaration or statement expected.
error TS1002: Unterminated string literal.
error TS1185: Merge conflict marker encountered.
error: consecutive statements on a line must be separated by ';'
error: expected '{' in body of function declaration
error CS1002: ; expected
error CS1513: } expected
error CS8300: Merge conflict marker encountered
error CS1525: Invalid expression term ')'
Fatal: Syntax error, "BEGIN" expected but "identifier END" found
line 3:0 mismatched input '<EOF>' expecting {';', '}'}
line 1:14 token recognition error at: '#'
no viable alternative at input 'int x'
unexpected "}" in template
Element is missing end tag.
Invalid end tag.
Liquid syntax error: 'for' tag was never closed
Unexpected keyword lock
expected ';' after signal declaration
syntax error: missing catch after exception handler
unterminated string literal (bad encoding declaration nearby)
Invalid decode expression: unexpected ')'
syntax error in merge statement
Unbalanced parentheses in file
Unterminated heredoc
Unmatched ']' at column 4
unfinished string near '"abc'
'=' expected near 'local'
'end' expected (to close 'function' at line 3) near '<eof>'
Malformed declaration
Parsing failed: tokenization error near "0b2"
the text stops in the middle of a function body
Lexical error at line 4, column 7
error de sintaxis: símbolo inesperado '}'
Erreur de syntaxe : jeton inattendu ')'
语法错误: 意外的标记 '}'""".splitlines()
#: Failures that are not about the text.
SPARES = """EACCES: permission denied, open 'src/a.ts'
ENOENT: no such file or directory
EMFILE: too many open files
[Errno 21] Is a directory: 'src'
Cannot read file: device not ready
I/O error while reading block 17
JavaScript heap out of memory
java.lang.OutOfMemoryError: Java heap space
Worker terminated due to reaching memory limit
Worker exited with code 137
Killed
signal SIGKILL received
Segmentation fault (core dumped)
Timeout of 10000ms exceeded while parsing
parse timed out
Parsing aborted after 30 s
Operation was cancelled
No parser registered for language cobol
Parser module tree-sitter-go could not be loaded
tree-sitter-kotlin.wasm: failed to fetch
Language not supported: brainfuck
unsupported file type
Cannot find module 'tree-sitter-rust'
Network unreachable while downloading grammar
connect ECONNREFUSED 127.0.0.1:443
disk quota exceeded
No space left on device
File is larger than the limit of 1 MB
File too large (12 MB), skipped
Binary file skipped
Path escapes the project root
Symlink loop detected
database is locked
Could not acquire lock on index
Failed to decode file: unknown charset
stat failed: Input/output error
Request to language server failed: connection reset
The parse worker was restarted
Maximum call stack size exceeded in extractor
Extractor crashed: TypeError: x is undefined
Failed to spawn parser process
plugin 'vue' not installed
rate limit reached, retry later
File changed on disk during indexing
stale file handle
Skipped: listed in .gitignore
unexpected internal error
git: cannot lock ref
index write failed
parser pool is shutting down""".splitlines()


def test_diagnostics_in_other_wordings():
    found = [m for m in BREAKS if repair.repair(repair.message_skeleton(m))[0]]
    wrong = [m for m in SPARES if repair.repair(repair.message_skeleton(m))[0]]
    lost = [m for m in BREAKS if m not in found]
    assert len(found) >= 0.9 * len(BREAKS), lost
    assert len(wrong) <= 0.1 * len(SPARES), wrong


#: Fixed values: (name, signature, docstring) that tell something, in the manner of public libraries.
TELL = [
    ("read", "(n=-1)", "Read up to n bytes. If n is negative, read until EOF."),
    ("close", "()", "Safe to call more than once."),
    ("insert", "(key, value)", "Overwrites an existing key."),
    ("size", "()", "Counts deleted entries too."),
    ("get", "(key)", "Returns null when absent."),
    ("sort", "(xs)", "Stable."),
    ("sort", "(xs)", "Not stable."),
    ("sleep", "(ms)", "Yields to other goroutines."),
    ("open", "(path)", "@throws FileNotFoundException if the path does not exist"),
    ("parse", "(s)", ":param s: ISO 8601 timestamp\n:return: seconds since the epoch"),
    ("max", "(xs)", "Raises ValueError on empty input."),
    ("next", "()", "None at the end."),
    ("lock", "()", "Reentrant."),
    ("hash", "(s)", "FNV-1a, 64 bit."),
    ("scale", "(x)", "x is in degrees."),
    ("connect", "()", "Retries thrice with backoff."),
    ("delete", "(id)", "Soft delete: rows stay for 30 days."),
    ("encode", "(s)", "Percent-encodes reserved characters."),
    ("render", "()", "Call on the UI thread."),
    ("render", "()", "Must run before layout."),
    ("equals", "(o)", "Ignores case."),
    ("trim", "(s)", "Entfernt auch geschützte Leerzeichen."),
    ("trim", "(s)", "Supprime aussi les espaces insécables."),
    ("trim", "(s)", "先頭と末尾の空白を取り除く。"),
    ("trim", "(s)", "Удаляет пробелы с обоих концов."),
    ("flush", "()", "/** Blocks. */"),
    ("fetch", "(url)", "<p>Follows at most five redirects.</p>"),
    ("merge", "(a, b)", "Later maps win."),
    ("pop", "()", "O(1) amortised."),
    ("exec", "(sql)", "Deprecated, prefer query()."),
    ("copy", "(src, dst)", "Returns the number of bytes copied."),
    ("main", "()", "Entry point of the scheduler daemon."),
]
#: The same that tell nothing.
MUTE = [
    ("readFile", "(path: string)", "Reads file."),
    ("readFile", "(path: string)", "Read the file at path."),
    ("getName", "()", "Gets the name."),
    ("getName", "()", "@return the name"),
    ("setName", "(String name)", "Sets the name.\n@param name the name"),
    ("isOpen", "()", "Is open?"),
    ("close_all", "(self)", "Close all."),
    ("UserService", "()", "Constructor."),
    ("process", "(data)", "Processes the data."),
    ("handleClick", "(event)", "Handle click event."),
    ("helper", "()", "A helper function."),
    ("run", "()", "TODO"),
    ("run", "()", "FIXME: broken"),
    ("run", "()", "..."),
    ("run", "()", "No documentation available."),
    ("run", "()", "Documentation goes here."),
    ("run", "()", "TODO(anna): document this"),
    ("run", "()", "{@inheritDoc}"),
    ("run", "()", "@inheritdoc"),
    ("run", "()", "See superclass."),
    ("run", "()", "@see Runnable#run"),
    ("run", "()", "eslint-disable-line"),
    ("run", "()", "# type: ignore"),
    ("run", "()", "SPDX-License-Identifier: Apache-2.0"),
    ("run", "()", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("run", "()", "=================="),
    ("run", "()", "---- private ----"),
    ("run", "(a, b)", "@param a\n@param b\n@returns"),
    ("run", "()", "return x + 1"),
    ("run", "()", "Internal."),
    ("run", "()", "noqa"),
    ("toString", "()", "Returns a string."),
    ("addUser", "(user)", "This method adds a user."),
    ("add_user", "(user)", "Function to add users"),
]


def test_comments_in_other_wordings():
    lost = [d for n, s, d in TELL if not docpairs.tells(d, n, s)]
    wrong = [d for n, s, d in MUTE if docpairs.tells(d, n, s)]
    print(len(TELL), lost, len(MUTE), wrong)
    assert len(lost) <= 0.1 * len(TELL), lost
    assert len(wrong) <= 0.15 * len(MUTE), wrong

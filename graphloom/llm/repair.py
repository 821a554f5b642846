"""Source files that do not parse (problem 2): minimum-cost syntax repair by error-correcting chart parsing.

The table holds no source text, only what a parser said about it. Each diagnostic is therefore read back into the
skeleton of the text it describes. Reading goes clause by clause: a relation (expected, found, left open) with an operand
that is part of a program (a quoted fragment, a token, a literal, a block, the end of the text) adds tokens, as many as
the diagnostic counts; a relation or a failing action whose operand is machinery (a file, memory, a worker, a parser that
is missing) adds none. The first clause that says either governs the others. A chart parser then finds the cheapest edits
(insert or delete a token, each at cost 1) that make the skeleton a sentence of the grammar of nested statements. A nonzero
cost flags the file, and the places of the edits tell truncation (an insertion at the end), conflict (a marker deleted)
and mismatch (a foreign token deleted, or one inserted before the end) apart. A language that its extension does not have
is a foreign token as well. The same parser repairs the skeleton of a real text, see text_skeleton().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.model import newest, trimmed_lower

#: Terminals: a statement; openers and closers of blocks, of literals and comments, and of statements that need a certain
#: token next; a conflict marker; a foreign token.
STATEMENT, OPEN, CLOSE, QUOTE, UNQUOTE, HEAD, TAIL, MARKER, FOREIGN = "s", "{", "}", '"', "'", "[", "]", "M", "X"
#: Grammar in binary form: P -> I P | I; I -> s | { R | " Q | [ S; R -> P } | }; Q -> P ' | '; S -> ].
_TERMINAL = {STATEMENT: {"P": 0, "I": 0}, CLOSE: {"R": 0}, UNQUOTE: {"Q": 0}, TAIL: {"S": 0}, OPEN: {"o": 0}, QUOTE: {"q": 0}, HEAD: {"g": 0}}
_RULES = [("P", "I", "P"), ("P", "o", "R"), ("P", "q", "Q"), ("P", "g", "S"), ("I", "o", "R"), ("I", "q", "Q"), ("I", "g", "S"), ("R", "P", "c"), ("Q", "P", "u")]
_CLOSERS, _OPENER = {CLOSE: "c", UNQUOTE: "u"}, {CLOSE: OPEN, UNQUOTE: QUOTE}
#: Cheapest way to make each symbol out of nothing: the tokens to insert.
_NOTHING = {"P": "", "I": STATEMENT, "R": CLOSE, "Q": UNQUOTE, "c": CLOSE, "u": UNQUOTE, "o": OPEN, "q": QUOTE, "S": TAIL, "g": HEAD}
#: Tokens left after the reduction up to which all of them go through the chart, see repair().
CHART_TOKENS = 24


@lru_cache(maxsize=4096)
def repair(tokens: str) -> tuple[int, tuple[tuple[str, int, str], ...]]:
    """Least number of edits that make tokens a program, and the edits as (insert or delete, place, token).

    A chart over all spans holds, for each symbol, the cheapest derivation after edits: a token may be deleted, and any
    symbol may be built from nothing by inserting its tokens. The work is cubic in the tokens; balanced parts are reduced
    to statements first, which cannot change the cost, so only what does not nest is left for the chart. Where more than
    CHART_TOKENS are left and no tail is given, markers, foreign tokens and heads are settled first: nothing else can be done
    with them, each is one edit. What a single kind of bracket leaves, closers before openers, is one edit a token as well.
    """
    settled: list[tuple[str, int, str]] = []
    stack = _nest(list(enumerate(tokens)))
    if len(stack) > CHART_TOKENS and TAIL not in tokens:
        settled = [("insert", k + 1, TAIL) if t == HEAD else ("delete", k, t) for t, k in stack if t in (MARKER, FOREIGN, HEAD)]
        stack = _nest([(k, STATEMENT if t == HEAD else t) for t, k in stack if t not in (MARKER, FOREIGN)])
    rest = [(t, k) for t, k in stack if t != STATEMENT]
    if len(rest) > CHART_TOKENS and len({_OPENER.get(t, t) for t, _ in rest} | {HEAD}) == 2:
        settled += [("delete", k, t) if t in _OPENER else ("insert", len(tokens), CLOSE if t == OPEN else UNQUOTE) for t, k in rest]
        stack = []
    edits = _chart(stack, len(tokens))
    return len(settled) + len(edits), (*settled, *edits)


def _nest(tokens: list[tuple[int, str]]) -> list[tuple[str, int]]:
    """Tokens (place, token) as (token, place) with balanced parts and runs of statements reduced to one statement."""
    stack: list[tuple[str, int]] = []
    for k, t in tokens:
        back = len(stack) - 1
        if t in _OPENER:
            back -= back >= 0 and stack[back][0] == STATEMENT
            if back >= 0 and stack[back][0] == _OPENER[t]:
                t, k = STATEMENT, stack[back][1]
                del stack[back:]
        if t != STATEMENT or not stack or stack[-1][0] != STATEMENT:
            stack.append((t, k))
    return stack


def _chart(stack: list[tuple[str, int]], end: int) -> tuple[tuple[str, int, str], ...]:
    """The cheapest edits (what, place, token) of tokens (token, place)."""
    kept, places = "".join(t for t, _ in stack), [k for _, k in stack]
    if kept in ("", STATEMENT):
        return ()
    n, unit = len(kept), 1 << 20  # an edit weighs a unit; of equally many edits, later insertions win
    nothing = {a: (len(t), tuple(("insert", -1, x) for x in t)) for a, t in _NOTHING.items()}
    chart: list[list[dict]] = [[{} for _ in range(n + 1)] for _ in range(n + 1)]

    def better(cell: dict, symbol: str, cost: int, edits: tuple) -> bool:
        if symbol in cell and cell[symbol][0] <= cost:
            return False
        cell[symbol] = (cost, edits)
        return True

    def at(i: int, symbol: str) -> tuple[int, tuple]:
        cost, edits = nothing[symbol]
        return cost * (unit - i), tuple((what, i, t) for what, _, t in edits)

    for width in range(1, n + 1):
        for i in range(n - width + 1):
            j, cell = i + width, chart[i][i + width]
            if width == 1:
                t = kept[i]
                for symbol in _TERMINAL.get(t, ()):
                    better(cell, symbol, 0, ())
                if t in _CLOSERS:
                    better(cell, _CLOSERS[t], 0, ())
                for symbol in nothing:  # delete the token
                    cost, edits = at(i, symbol)
                    better(cell, symbol, cost + unit, (("delete", i, t), *edits))
            else:  # delete the first or the last token
                for symbol, (cost, edits) in chart[i + 1][j].items():
                    better(cell, symbol, cost + unit, (("delete", i, kept[i]), *edits))
                for symbol, (cost, edits) in chart[i][j - 1].items():
                    better(cell, symbol, cost + unit, (*edits, ("delete", j - 1, kept[j - 1])))
            for m in range(i + 1, j):
                left, right = chart[i][m], chart[m][j]
                for a, b, c in _RULES:
                    if b in left and c in right:
                        better(cell, a, left[b][0] + right[c][0], left[b][1] + right[c][1])
            changed = True
            while changed:  # one side from nothing
                changed = False
                for a, b, c in _RULES:
                    if b in cell:
                        cost, edits = at(j, c)
                        changed |= better(cell, a, cell[b][0] + cost, cell[b][1] + edits)
                    if c in cell:
                        cost, edits = at(i, b)
                        changed |= better(cell, a, cost + cell[c][0], edits + cell[c][1])
    return tuple((what, places[k] if k < n else end, t) for what, k, t in chart[0][n]["P"][1])


#: Words for parts of a program text.
_PART = (
    r"(?:tokens?|symbols?|characters?|operators?|operands?|keywords?|identifiers?|names?|literals?|strings?|comments?|docstrings?|templates?|heredocs?|regexp?|regular expression|numbers?|numeric|constants?|digits?|expressions?|statements?|declarations?|declarators?|"
    r"definitions?|blocks?|braces?|brackets?|parenthes[ie]s|parens?|indent(?:ed|ation|s)?|dedents?|tabs?|newlines?|line breaks?|eof|eos|end[- ]of[- ](?:file|input|stream|source|line|text|string|statement)|end tag|arguments?|parameters?|types?|(?:class|function|loop|method) body|body|clauses?|"
    r"semicolons?|colons?|commas?|dots?|quotes?|quotation|apostrophes?|tags?|elements?|attributes?|markup|syntax|input|items?|nodes?|markers?|separators?|delimiters?|labels?|modifiers?|imports?|functions?|class(?:es)?|methods?|variables?|return|escapes?|sequences?|directives?|annotations?|decorators?|lambda|"
    r"patterns?|assignments?|bytes?|hunks?|source|module|production|ausdruck|anweisung|zeichen|bezeichner|klammer|jeton|expresión|instrucción|símbolo|标记|符号|字符|文字|トークン|токен|символ)"
)
#: Words for the machinery around a text: storage, processes, limits, tools.
_MACHINE = re.compile(
    r"\b(?:files? (?:mode|size|handle|descriptor|system|format|type|vanished|disappeared|changed|lock)|mode|path|director(?:y|ies)|folder|permissions?|access|memory|heap|time(?:d)?[ -]?out|deadline|(?:max(?:imum)?|size|depth|time|rate|memory|file) (?:size|limit)|limit|quota|worker|process|thread|pool|child|"
    r"network|connection|socket|host|server|proxy|http|tls|download(?:ed|ing)?|disk|device|i/o|encoding|charset|codec|utf-?8|extractor|plugin|wasm|binary|library|dependency|shared object|cache|database|index|lock|signal|sig[a-z]{3,}|segfault|symlink|mount|parser (?:for|is|was|not|package)|grammar (?:for|file|package|not|is not)|"
    r"language (?:is )?(?:not|un)|unsupported (?:language|file|encoding|version)|tree-sitter|traversal|e(?:acces|noent|busy|io|perm|mfile|nfile|isdir|notdir|nospc|timedout|again|pipe|loop|nametoolong|connreset|connrefused|stale)|stack overflow|recursion|internal|assertion|exit(?:ed)? (?:code|with)|status|oom|ms|seconds)\b"
)
#: Actions on machinery that can fail, and what is said when they do.
_ACTION = re.compile(
    r"\b(?:(?:fail(?:ed|ure|s)?|unable|could(?: no|n.)t|can(?:no|')?t|not able|refus(?:ed|ing)|error) (?:to |while |when |in )?(?:read(?:ing)?|open(?:ing)?|load(?:ing)?|fetch(?:ing)?|download(?:ing)?|get(?:ting)?|stat|start(?:ing)?|spawn(?:ing)?|allocat(?:e|ing)|find|access(?:ing)?|write|writing|connect(?:ing)?|decod(?:e|ing)|lock|create|acquire|resolve host|index)\b(?! as)|"
    r"abort(?:ed|ing)?|killed|cancel(?:l?ed|lation)?|crash(?:ed)?|timed? ?out|exceed(?:s|ed)|blocked|recycled|vanished|disappeared|skipped|too (?:slow|large|big|long|many open)|no such file|out of (?:memory|disk|space)|permission denied|access denied|no space|not (?:available|installed|loaded|supported|found on disk|readable)|unavailable|unsupported|interrupted|hung up|no (?:parser|grammar)|gave up|shut ?down|evicted|restarted)\b"
)
_SUBJECT_FAILED = re.compile(r"\b(?:fail(?:ed|ure|s)?|error|missing|lost|gone|unexpected|invalid|bad|not|no|died|exited|full)\b")
#: What says by itself that a text breaks its grammar.
_BREACH = re.compile(
    r"\b(?:(?:syntax|parse|parsing|parser|lexical|lexer|tokeni[sz]er|tokeni[sz]ation|indentation|grammar)[ _-]?(?:error|exception|violation|failure)s?(?! (?:worker|process))|taberror|malformed|ill-formed|ungrammatical|no viable alternative|cannot be (?:read|parsed) as|does(?: no|n.)t parse|not well[- ]formed|recovery failed|cannot continue at|(?:is|was) not valid|"
    r"not known to the [\w+# ]*grammar|grammar rejected|rejected \d+|not a statement|syntaxfehler|erreur de syntaxe|error de sintaxis|语法错误|構文エラー|синтаксическая ошибка)|\bERROR\b.*\bnodes?\b"
)
_MERGE = re.compile(r"<{7}|={7}|>{7}|\|{7}|\b(?:conflict|merge) (?:marker|hunk)s?\b|\b(?:merge|unresolved) conflicts?\b|\bhead marker\b")
_FOUND = r"unexpected|unerwartet\w*|inattendu\w*|inesperad\w*|invalid|illegal|stray|extraneous|dangling|misplaced|mismatched|unrecogni[sz]ed|unmatched|bad|found|got|nicht erwartet|意外|予期しない|неожиданн\w*"
_WANTED = r"expect(?:ed|ing|s)?|missing|required|requires|needs?|fehlt|erwartet|manquant\w*|attendu\w*|falta|esperab\w*|缺少|期待|ожидал\w*|пропущен\w*"
_LEFT = (
    r"unclosed|unterminated|unbalanced|unfinished|incomplete|truncated|never (?:closed|ends?|ended|terminated|finished)|not (?:closed|terminated|finished|complete)|still open|cut off|(?:ended|ends|stops?|stopped) (?:inside|within|in the middle|before)|ran out of|premature(?:ly)?|unexpected(?:ly)? (?:end|eof)|end(?:ed|s)? (?:too early|abruptly)|"
    r"(?:reached|hit|at) (?:the )?(?:eof|end of (?:file|input|stream|source))|before (?:the )?(?:eof|end of (?:file|input|stream|source))|unvollständig|last byte|got end|found end"
)
_END = re.compile(rf"\b(?:eof|eos|end[- ]of[- ](?:file|input|stream|source|text)|{_LEFT})\b")
_LITERAL = re.compile(r"\b(?:strings?|literals?|comments?|docstrings?|quot\w*|templates?|heredocs?|regexp?)\b")
_OPERAND = rf"(?:\x01\d+\x02|\b{_PART}\b)"
_BEFORE = re.compile(rf"(?:\b(?:{_FOUND}|{_WANTED}|{_LEFT})\b|意外|予期しない|缺少|期待)\W{{0,3}}(?:[\w#+.-]+:? ){{0,3}}?{_OPERAND}")
_AFTER = re.compile(rf"{_OPERAND}(?: [\w#+.-]+){{0,6}}? (?:\b(?:{_FOUND}|{_WANTED}|{_LEFT})\b)")
_WANT = re.compile(rf"\b(?:{_WANTED})\b(?P<after>\W{{0,3}}(?:an? |the )?(?P<a>\x01\d+\x02|[\w-]+))?|(?P<b>\x01\d+\x02) (?:was |is )?(?:{_WANTED})\b")
_SAW = re.compile(rf"\b(?:{_FOUND})\b")
_QUOTED = re.compile(r"(?<!\w)'([^'\n]{1,200})'(?!\w)|\"([^\"\n]{1,200})\"|`([^`\n]{1,200})`|[\u201c\u201e\u00ab]([^\u201c\u201d\u00bb\n]{1,200})[\u201d\u201c\u00bb]|'(')'")
_CODED = re.compile(r"parse|syntax|lex|gramm")


def message_skeleton(message: str, code: str = "") -> str:
    """The skeleton of the text that a diagnostic describes: STATEMENT alone if the text is not to blame.

    A diagnostic that says neither is told by its code and, without one, by whether it names more parts of a program than
    of machinery.
    """
    quoted: list[str] = []

    def keep(m: re.Match) -> str:
        quoted.append(next(g for g in m.groups() if g is not None))
        return f"\x01{len(quoted) - 1}\x02"

    text = _QUOTED.sub(keep, message)
    about, told = False, []
    for clause in re.split(r":\s(?!\x01)|[;,()\[\]]\s|[.!?](?:\s|$)|\s[-\u2013\u2014]+\s|[:;,]$|[()]", text):
        low = clause.lower()
        breach = bool(_BREACH.search(low) or _MERGE.search(low) or re.search(r"\bERROR\b.*\bnodes?\b", clause) or any(_MERGE.match(q) for q in quoted) and "\x01" in low)
        machine = _MACHINE.search(low)
        pair = _BEFORE.search(low) or _AFTER.search(low)
        if pair and machine and machine.start() < pair.end() and machine.end() > pair.start():
            pair = None  # the operand is machinery
        action = _ACTION.search(low)
        if not told and not breach and (action and not (pair and pair.start() < action.start()) or machine and not pair and _SUBJECT_FAILED.search(low)):
            return STATEMENT
        if breach or pair or re.search(rf"\b(?:{_LEFT})\b", low) and not machine:
            about = True
            told.append(low)
    if not about:
        low = text.lower()
        if _CODED.search(code.lower()) and not _MACHINE.search(low) and not _ACTION.search(low):
            about = True
        elif low.strip() and not code.strip():
            about = len(re.findall(rf"\b{_PART}\b", low)) > len(_MACHINE.findall(low)) + len(_ACTION.findall(low))
    return _told_skeleton(text, quoted) if about else STATEMENT


def _told_skeleton(text: str, quoted: list[str]) -> str:
    """Tokens of a text that a diagnostic (its quotes as numbers between \x01 and \x02) is about."""
    low, out = text.lower(), STATEMENT
    whole = low + " " + " ".join(quoted).lower()
    value = lambda g: quoted[int(g[1:-1])] if g and g[0] == "\x01" else g or ""
    at_end = bool(_END.search(low)) or any(re.fullmatch(r"<?(eof|eos|end[- ]of[- ](file|input|stream))>?", q.strip().lower()) for q in quoted)
    if m := re.search(r"(\d+) errors?\b.*?(\d+) missing", low):  # a tree with that many broken and absent nodes
        return (STATEMENT + FOREIGN) * int(m[1]) + (STATEMENT + HEAD) * int(m[2]) + STATEMENT
    if m := re.search(r"rejected (\d+) of", low):
        return (STATEMENT + FOREIGN) * max(1, int(m[1])) + STATEMENT
    if m := re.search(r"(\d+) open(?:ed|ing)?\D{1,12}(\d+) clos", low):
        opened, closed = int(m[1]), int(m[2])
        return STATEMENT + OPEN * opened + STATEMENT + CLOSE * closed if opened != closed else out + FOREIGN + STATEMENT
    if _MERGE.search(low) or any(_MERGE.match(q.strip()) for q in quoted):
        return out + MARKER + STATEMENT
    if m := re.search(r"(\d+) (?:brackets?|braces?|blocks?|parenthes[ie]s|tags?)[\w ]* (?:open|unclosed|not closed)", low):
        return out + (OPEN + STATEMENT) * max(1, int(m[1]))
    wanted = [value(m["a"] or m["b"]) for m in _WANT.finditer(low)]
    closer = any(re.fullmatch(r"[\])}]|end\w*|</.*>|fi|done|esac", w.strip()) for w in wanted)
    saw = bool(_SAW.search(re.sub(r"unexpected(?:ly)? (?:end|eof)|(?:found|got) (?:the )?end|unexpected (?:\x01\d+\x02)?$", " ", low))) and not re.search(r"(?:found|got) \x01(\d+)\x02", low) or any(value(f"\x01{g}\x02").lower() not in ("<eof>", "eof") for g in re.findall(r"(?:found|got|unexpected|input) \x01(\d+)\x02", low))
    if at_end and not (wanted and not closer):
        return out + (QUOTE if _LITERAL.search(whole) else OPEN) + STATEMENT
    if closer:
        return out + OPEN + STATEMENT + (FOREIGN + STATEMENT if saw and not at_end else "")
    if wanted:
        return out + HEAD + ("" if at_end else (FOREIGN if saw else "") + STATEMENT)
    return out + FOREIGN + STATEMENT


#: Longest diagnostic whose skeleton a worker keeps.
KEPT_CHARS = 300


@lru_cache(maxsize=20_000)
def _short_skeleton(message: str, code: str) -> str:
    return message_skeleton(message, code)


def text_skeleton(text: str) -> str:
    """The skeleton of a source text: brackets outside literals, literals left open, conflict markers; the rest is statements."""
    out, pairs, stack = [STATEMENT], {"(": ")", "[": "]", "{": "}"}, []
    for line in text.splitlines():
        if re.match(r"(<{7}|={7}|>{7}|\|{7})( |$)", line):
            out += [MARKER, STATEMENT]
            continue
        line = re.sub(r"(?<!\\)(\"(\\.|[^\"\\])*\"|'(\\.|[^'\\])*'|`(\\.|[^`\\])*`)", " ", line)
        line = re.sub(r"(//|#(?!\w+\s*[<\"])).*", "", line)
        for c in line:
            if c in pairs:
                out.append(OPEN)
                stack.append(pairs[c])
            elif c in ")]}":
                out.append(CLOSE if stack and stack[-1] == c else FOREIGN if stack else CLOSE)
                if stack and stack[-1] == c:
                    stack.pop()
            elif not c.isspace() and out[-1] != STATEMENT:
                out.append(STATEMENT)
    return "".join(out)


def kind_of(edits: tuple[tuple[str, int, str], ...], length: int) -> str:
    """What the places of the edits say: conflict, truncation or mismatch; empty without edits."""
    gone = {t for what, _, t in edits if what == "delete"}
    if MARKER in gone:
        return "conflict"
    if FOREIGN not in gone and any(what == "insert" and place >= length for what, place, _ in edits):
        return "truncation"
    return "mismatch" if edits else ""


_RESULT = T.StructType([T.StructField("cost", T.IntegerType()), T.StructField("kind", T.StringType())])


@F.pandas_udf(_RESULT)
def _judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for messages, codes, foreigns in batches:
        costs, kinds = [], []
        for own, named, foreign in zip(messages, codes, foreigns):
            skeletons = [(_short_skeleton if len(message or "") <= KEPT_CHARS else message_skeleton)(message or "", code or "") for message, code in zip(own if own is not None else (), named if named is not None else ())]
            best, kind = 0, ""
            for tokens in [*skeletons, FOREIGN] if foreign else skeletons:  # a text in another language: one foreign token
                cost, edits = repair(tokens)
                best += cost
                kind = kind or kind_of(edits, len(tokens))
            costs.append(best)
            kinds.append(kind or None)
        yield pd.DataFrame({"cost": costs, "kind": kinds})


def broken_sources(files: DataFrame, file_types: DataFrame) -> DataFrame:
    """Every path once, by its newest row: (path, repository, language, repair_cost int, reason string, broken boolean).

    The newest row is the one of the largest indexed_at (a null one counts as oldest; equal ones by content, so that the
    choice is stable). A file is broken if its diagnostics other than warnings cost a repair, or if its language is not
    among those that file_types lists for its extension. reason is conflict, truncation or mismatch. A null or `unknown`
    language and an unlisted extension are no mismatch; case and blanks do not matter. Null and empty errors, entries and
    messages are allowed; rows with a null path do not count; empty tables and an empty file_types are allowed; further
    columns are not read.

    One shuffle by path after columns are cut to four; each distinct short diagnostic is read, and each distinct skeleton
    parsed, once a worker. The extensions are joined, so Spark broadcasts them by their size.
    """
    rows = newest(files, "path", "indexed_at", ["language", "errors"])
    told = F.filter("errors", lambda e: e.isNotNull() & (F.coalesce(trimmed_lower(e["severity"]), F.lit("")) != "warning"))
    extension = F.lower(F.regexp_extract(F.regexp_extract("path", r"([^/]*)$", 1), r"(\.[^.]*)$", 1))
    known = file_types.groupBy(trimmed_lower(file_types["ext"]).alias("ext")).agg(F.collect_set(trimmed_lower(file_types["lang_name"])).alias("names"))
    rows = rows.withColumn("told", told).withColumn("own_ext", extension).withColumn("language", trimmed_lower(F.col("language"))).join(known, F.col("own_ext") == F.col("ext"), "left")
    foreign = F.col("names").isNotNull() & F.col("language").isNotNull() & ~F.col("language").isin("unknown", "") & ~F.array_contains("names", F.col("language"))
    verdict = _judge(F.transform("told", lambda e: e["message"]), F.transform("told", lambda e: e["code"]), F.coalesce(foreign, F.lit(False)))
    rows = rows.withColumn("verdict", verdict)
    return rows.select("path", F.substring_index("path", "/", 1).alias("repository"), "language", F.col("verdict.cost").alias("repair_cost"), F.col("verdict.kind").alias("reason"), (F.col("verdict.cost") > 0).alias("broken"))


def broken_rates(files: DataFrame, file_types: DataFrame) -> DataFrame:
    """Files, broken files, their rate and reasons by repository and language; a null language forms its own group."""
    rows = broken_sources(files, file_types)
    count = lambda reason: F.count(F.when(F.col("broken") & (F.col("reason") == reason), 1)).alias(reason)
    return rows.groupBy("repository", "language").agg(F.count("*").alias("files"), F.count(F.when(F.col("broken"), 1)).alias("broken"), count("truncation"), count("conflict"), count("mismatch")).withColumn("rate", F.col("broken") / F.col("files"))

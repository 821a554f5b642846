"""Functions paired with their documentation (problem 3).

Two entrances share one judgement of a comment. documented_functions() takes symbols with a signature and a docstring.
extract_functions() takes source text: regular expressions find signatures, also wrapped ones, a stack of indentations,
braces or end keywords delimits bodies, and the nearest comment is attached by line distance. Inside a docstring the same
signature patterns and the same stack find lines that are code, which describe nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.extract import language_sections
from graphloom.operators.model import newest, trimmed_lower

#: Most lines between a comment and the signature that it describes.
COMMENT_DISTANCE = 1
#: Longest comment whose verdict a worker keeps.
KEPT_CHARS = 300

_NAME = r"[A-Za-z_$][\w$]*"
#: Signatures, by how the body is delimited.
SIGNATURES = {
    "indent": re.compile(rf"^(?P<indent>\s*)(?:async\s+)?def\s+(?P<name>{_NAME})\s*(?:\[[^\]]*\]\s*)?(?P<sig>\(.*?\)\s*(?:->[^:]+)?):"),
    "end": re.compile(rf"^(?P<indent>\s*)(?:(?:defp?|(?:local\s+)?function)\s+(?:[\w.]+[.:])?(?P<name>{_NAME}[?!=]?)(?P<sig>\s*\([^{{}}]*?\)|\s+\w[^{{}}=]*|)(?:\s*::\s*\w+)?(?:\s+do)?|(?:local\s+)?(?:[\w.]+[.:])?(?P<name2>{_NAME})\s*=\s*function\s*(?P<sig2>\([^{{}}]*?\)))\s*$"),
    "brace": re.compile(
        rf"^(?P<indent>\s*)(?:(?:export|default|public|private|protected|internal|static|final|async|override|abstract|virtual|inline|suspend|open|pub(?:\([\w:]+\))?|unsafe|const|extern|synchronized|func|fn|fun|function)\s+)*"
        rf"(?:\([^()]*\)\s*)?(?:[\w$<>\[\],.:&*?]+\s+[*&]?)?(?P<name>(?!(?:if|for|while|switch|catch|return|else|elif|match|with|new|throw|await|case|do)\b){_NAME})\s*(?:<[^<>()]*>)?(?P<sig>\([^;{{}}]*\)[^;{{}}=]*)\{{"
    ),
    "arrow": re.compile(rf"^(?P<indent>\s*)(?:export\s+)?(?:default\s+)?(?:(?:const|let|var)\s+|(?:(?:public|private|protected|static|readonly)\s+)*)(?P<name>{_NAME})\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:<[^<>()]*>\s*)?(?P<sig>(?:\([^;{{}}]*?\)|\([^()]*\)|{_NAME})\s*(?::\s*[^=;{{}}]+)?)\s*=>"),
}
#: Languages whose bodies are not delimited by braces.
LANGUAGE_STYLES = {"python": ["indent"], "ruby": ["end"], "lua": ["end"], "julia": ["end"], "elixir": ["end"]}
#: Lines where a signature may start.
_STARTS = re.compile(rf"^\s*(?:(?:async\s+)?def\s|defp?\s|(?:local\s+)?function\b|.*=>|.*=\s*(?:async\s*)?(?:function\b|\()|[^=;{{}}#\"'`]*{_NAME}\s*(?:<[^<>()]*>)?\()")
_OPENS_END = re.compile(r"^\s*(?:defp?|class|module|if|unless|while|until|case|begin|for|(?:local\s+)?function)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*function\b")
_CLOSES_END = re.compile(r"^\s*end\b|(?<![.\w:])end\s*[;),]*\s*$")
_LINE_COMMENT = re.compile(r"^\s*(?://+[/!]?|#(?!\[|include|define|region|endregion)|--)\s?(.*)$")


def body_end(lines: list[str], start: int, style: str, indent: int | None = None) -> int:
    """Last line of the body whose signature starts (indented: ends) on lines[start]; the last line of the text if nothing ends it."""
    if style == "brace":
        depth, seen = 0, False
        for k in range(start, len(lines)):
            bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*", "", lines[k])
            for c in bare:
                depth += (c == "{") - (c == "}")
                seen |= c == "{"
                if seen and not depth:
                    return k
        return len(lines) - 1
    if style == "end":
        depth = 0
        for k in range(start, len(lines)):
            depth += bool(_OPENS_END.search(lines[k])) - bool(_CLOSES_END.search(lines[k]))
            if not depth:
                return k
        return len(lines) - 1
    indents = [len(lines[start]) - len(lines[start].lstrip()) if indent is None else indent]
    last, k = start, start + 1
    while k < len(lines):
        if lines[k].strip():
            own = len(lines[k]) - len(lines[k].lstrip())
            while indents and own <= indents[-1]:
                indents.pop()
            if not indents:
                break
            indents.append(own)
            last = k
        k += 1
    return last


def comments(lines: list[str]) -> list[tuple[int, int, str]]:
    """Comment blocks as (first line, last line, text): runs of line comments and delimited comments."""
    out, k = [], 0
    while k < len(lines):
        line = lines[k].strip()
        if line.startswith("/*"):
            j = k
            while j < len(lines) and "*/" not in lines[j]:
                j += 1
            j = min(j, len(lines) - 1)
            out.append((k, j, "\n".join(x.strip() for x in lines[k : j + 1])))
            k = j + 1
        elif m := _LINE_COMMENT.match(lines[k]):
            j, text = k, [m[1]]
            while j + 1 < len(lines) and (m := _LINE_COMMENT.match(lines[j + 1])):
                j += 1
                text.append(m[1])
            out.append((k, j, "\n".join(text)))
            k = j + 1
        else:
            k += 1
    return out


def _signature(lines: list[str], k: int) -> tuple[str, int]:
    """The text of a signature that may start on lines[k], joined over line breaks, and its last line.

    Lines join while a round bracket is open, and with a line that opens the body; a statement's end, a body or a blank line stop it.
    """
    joined, depth = lines[k], lines[k].count("(") - lines[k].count(")")
    while depth > 0 and k + 1 < len(lines) and lines[k + 1].strip() and not re.search(r"[;{}]\s*$", joined):
        k += 1
        depth += lines[k].count("(") - lines[k].count(")")
        joined = f"{joined.rstrip()} {lines[k].strip()}"
    if "(" in joined and not depth and "{" not in joined and k + 1 < len(lines) and lines[k + 1].strip().startswith("{") and not joined.rstrip().endswith((";", ":", ",")):
        k, joined = k + 1, joined.rstrip() + " {"
    return joined, k


def extract_functions(text: str, language: str | None = None) -> list[tuple[str, str, int, int, str]]:
    """(name, signature, first line, last line, comment) of each function of a source text; lines count from 1.

    A comment belongs to the signature that follows it within COMMENT_DISTANCE lines; in Python the string that opens the
    body comes first. Without either the comment is empty. Unknown languages are read with all patterns.
    """
    lines = text.splitlines()
    known = (language or "").strip().lower()
    styles = list(SIGNATURES) if known in ("", "unknown") else LANGUAGE_STYLES.get(known, ["brace", "arrow"])
    notes = {last: note for _, last, note in comments(lines)}
    out = []
    for k, line in enumerate(lines):
        if not _STARTS.match(line):
            continue
        joined, stop = _signature(lines, k)
        for style in styles:
            m = SIGNATURES[style].match(joined if style != "end" else joined if stop == k or not joined.endswith("{") else line)
            if not m or style == "end" and (joined.rstrip().endswith((":", "{")) or not any(_CLOSES_END.search(x) for x in lines[k:])):
                continue
            name, sig = (m["name"] or m["name2"], m["sig"] if m["name"] else m["sig2"]) if style == "end" else (m["name"], m["sig"])
            if style == "arrow":
                last = body_end(lines, k, "brace") if re.match(r"\s*\{|\s*$", joined[m.end() :]) else stop
            else:
                last = body_end(lines, k if style != "indent" else stop, style, len(line) - len(line.lstrip()))
            note = ""
            if style == "indent":
                inside = re.match(r"\s*[rRuU]?(\"\"\"|''')(.*?)(\1|\Z)", "\n".join(lines[stop + 1 : last + 1]), re.S)
                note = inside[2] if inside else ""
            above = k - 1
            while above >= 0 and re.match(r"\s*(@|#\[|\[)", lines[above]) and above not in notes:  # decorators
                above -= 1
            for d in range(COMMENT_DISTANCE + 1):
                if not note and above - d in notes:
                    note = notes[above - d]
                    break
                if above - d >= 0 and lines[above - d].strip():
                    break
            out.append((name, (sig or "").strip().rstrip("{: "), k + 1, last + 1, note))
            break
    return out


#: Phrases of comments that say nothing about the symbol they stand at.
_LICENCE = re.compile(
    r"copyright\s*(?:\(c\)|©|\d{4}|by\b|holders?\b|notice)|©|\(c\)\s*\d{4}|\blicen[cs]ed? (?:under|to|file|text|terms|header)\b|(?:under|see) the [\w .-]*licen[cs]e|\b(?:mit|apache|bsd|mozilla|gnu|general public|isc)\b[\w .,-]*licen[cs]e|\blicen[cs]e\W*(?:mit|apache|bsd|gpl|lgpl|mpl|isc)\b|licen[cs]e file|"
    r"spdx-|all rights reserved|without warranty|warranty of|this file is part of|free software|redistribution and use|may (?:be )?redistribute|provided \W?as[ -]is\b|terms (?:in|of) the licen[cs]e", re.I)
#: A paragraph that starts so is a licence to its end.
_NOTICE = re.compile(r"\W*(?:copyright\s*(?:\(c\)|©|\d{4})|©\s*\d{4}|spdx-)", re.I)
_TOOL = re.compile(
    r"^\W*(?:(?:eslint|tslint|jshint|jslint|prettier|clang-format|clang-tidy|noqa|pylint|flake8|mypy|pyright|nolint|rubocop|nosonar|noinspection|swiftlint|ktlint|detekt|phpcs|phpstan|codecov|cspell|stylelint|biome-ignore|deno-|suppresswarnings|yapf)\b|ts-(?:ignore|expect-error|nocheck)|go:\w+|"
    r"(?:pragma|type|fmt|ruff|isort|coverage|sonar|checkstyle|spotless|formatter|psalm)\s*[:=-]\s*\w|(?:istanbul|c8|v8) ignore|(?:end)?region(?:\W+\w+){0,2}\W*$)|^\s*#\s*(?:end)?region\b",
    re.I,
)
_TASK = re.compile(r"^\W*(?:todo|fixme|xxx|hack|tbd|wip|tbc|n/?a|none|null|undocumented|override|inherit\s*doc|internal|generated|ditto|idem)\b(?!\s+\w+\s+\w+\s+\w+\s+\w+)|^\W*(?:todo|fixme|xxx|hack)\b|^\W*deprecated\W*$", re.I)
_POINTER = re.compile(r"^\W*(@?see\b|see also|refer to|same as|as above|cf\.?|siehe|voir|ver|см\.?)\W*(\S+\W*){0,4}$|\{@(link|inherit\s*doc)[^}]*\}\W*$|inherit\s*doc", re.I)
_PLACE = r"(?:\W+(?:in|out|the|a|an|your|some|any|this|that|proper|real|actual|missing|short|brief|long|better|method|function|class|own))*"
_AFTERWARDS = r"(?:\W+(?:here|of|for|to|the|this|that|a|an|method|function|class|later|please|below|above|by|with|real|proper|one|before|you|commit|file|tree|it|follow|follows|needed|required|pending|available|yet|soon|is|are|goes))*"
_EMPTY = re.compile(
    rf"^\W*(?:(?:auto(?:matically)?[- ]?)?(?:generated|created)(?:\W+(?:by|from|with|using|via)\b.*)?|auto[- ]?generated\b.*|(?:no|missing|insert|add|fill|write|your|replace|put|enter|provide){_PLACE}\W+(?:descriptions?|documentation|docs?|comments?|docstring|code|text|summary){_AFTERWARDS}|(?:description|documentation|docs?|comment|summary){_AFTERWARDS}|"
    r"(?:method|function|class|short|long|brief)\s+(?:description|documentation|stub|body|summary)|default implementation|internal use(?: only)?|for internal use(?: only)?|constructor|destructor|getters?(?:\s*(?:/|and|or)\s*setters?)?|setters?|accessors?|mutators?|helpers?(?: (?:function|method))?|utility(?: (?:function|method))?)\W*$",
    re.I,
)
_CODE = re.compile(
    r"^\s*(?:(?:return|await|throw|raise|yield|assert|del|import|from|let|const|var|val|print|echo|puts|use|using|package|break|continue|pass)\b(?:[^.]*[;(=\[]|\s*$|\s+[\w.]+\s*[+*/%-]\s*\w+\s*;?\s*$)|(?:if|while|for|switch|elif|else if|catch)\s*\(.*\)|(?:if|for|while|elif|with|def|class|try|else|except)\b[^.]*:\s*$|"
    r"[\w$.\[\]]+\s*(?:[-+*/|&]?=|:=)\s*[^=].*|[\w$.\[\]>:-]+\([^()]*(?:\([^()]*\)[^()]*)*\)\s*;?\s*(?:(?:#|//).*)?$|[})\]]+[;,]?\s*$|@\w+\(.*\)\s*$|.*[{};]\s*$)"
)
#: Words that carry no content of their own: grammar, and what every function is, has and does.
_COMMON = frozenset(
    """a an the this that these those it its of for to in on at by with from into as is are be been was were and or not no if then so do does did done has have had will would can could should may might must
    function functions method methods procedure routine constructor class object instance field property member variable value values result results return returns returned returning param params parameter parameters arg args
    argument arguments type types void null none nil true false undefined self cls get gets set sets getter setter given new current default simple basic main helper util utility internal use used implementation implements
    entry entries item items element elements thing things data info stuff call calls called invoke invokes perform performs execute executes handle handles process processes operation action which what when where who how
    deprecated related work works job does way certain specified respective corresponding appropriate
    der die das den dem ein eine und oder für von zu mit le la les un une des du de et ou pour el los las una y o para en il lo gli""".split()
)
#: Conditions and negations, and values; together they tell something without any other word.
_CONDITION = re.compile(r"\b(?:if|unless|when|whenever|until|only|never|always|not|no|without|must|except|otherwise|else|wenn|falls|nie|nur|si|sauf|jamais|solo|nunca|если|только|никогда)\b", re.I)
_VALUE = re.compile(r"\b(?:null|none|nil|true|false|undefined|empty|zero|void)\b|(?<![\w.])-?\d+(?:\.\d+)?(?![\w.]*\w)", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0e00-\u0e7f]")
_TAG = re.compile(r"^\s*(?:[@\\:](?P<tag>[A-Za-z][\w-]*):?(?:\s*\{[^}]*\})?)(?P<rest>.*)$", re.S)
_NAMED_TAGS = frozenset("param parameter arg argument property prop tparam typeparam field var throws throw exception raises raise".split())
_SILENT_TAGS = frozenset("see seealso inheritdoc override internal private public protected author since version copyright license todo fixme link generated hidden ignore module namespace file package access api virtual final async static readonly".split())
_HTML = re.compile(r"<(/?)(\w+)([^<>]*)>")


def stem(word: str) -> str:
    """A word without its commonest English endings, so that a restated name is recognised."""
    w = word.lower()
    for end, keep in (("ies", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")):
        if w.endswith(end) and len(w) - len(end) >= 2 and not w.endswith("ss" if end == "s" else "\0"):
            w = w[: len(w) - len(end)] + keep
            break
    w = w.rstrip("e")
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def name_words(*texts: str | None) -> set[str]:
    """Stems of the words in identifiers, cut at case changes and underscores."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+", " ".join(t for t in texts if t))
    whole = re.findall(r"[^\W\d_]+", " ".join(t for t in texts if t))
    return {stem(p) for p in [*parts, *whole]}


def _says(text: str, known: set[str]) -> bool:
    """Whether a sentence says something that the names in known do not.

    It does by a word of content of its own, by three letters of a script without blanks, or by a value under a condition
    or as what comes back.
    """
    wide = len(_WIDE.findall(text))
    plain = _WIDE.sub(" ", text)
    words = [w.lower() for w in _WORD.findall(plain) if len(w) > 1]
    new = {stem(w) for w in set(words) if w not in _COMMON} - known
    if new and (len(words) < 4 or len(set(words)) > 1) or wide >= 3:  # one word said over and over is a filler
        return True
    return bool(_VALUE.search(plain) and (_CONDITION.search(plain) or re.search(r"\breturns?\b\W*(?:-?\d|true\b|false\b)", plain, re.I)))


def prose(docstring: str) -> list[str]:
    """Sentences of a comment that could describe something, without markup, markers, code, banners and tool hints."""
    text = re.sub("[\u00ad\u200b-\u200f\u2060\ufeff]", "", docstring.replace("\r\n", "\n").replace("\r", "\n"))
    text = re.sub(r"<param\s+name=\"(\w+)\"\s*>", r"\n@param \1 ", text, flags=re.I)
    text = re.sub(r"</?(summary|remarks|returns|value|p|br|ul|li|para|exception|example)\b[^<>]*>", "\n", text, flags=re.I)
    text = _HTML.sub(" ", text)
    text = re.sub(r"^[ \t]*([-=~*/#_])\1{2,}.*\1{2,}[ \t]*$", "", text, flags=re.M)  # banners
    lines = [re.sub(r"\*+/\s*$", "", re.sub(r"^\s*(?:/\*+|\*+(?!\w)|///?!?|#+(?!\w)|--+(?=\s)|\"\"\"|''')?", lambda m: " " * (len(m[0]) - len(m[0].lstrip()) if not m[0].strip() else 0), raw)) for raw in text.split("\n")]
    kept, k = [], 0
    while k < len(lines):
        line = lines[k]
        if any(p.match(line) and (s != "end" or re.match(r"\s*(?:def|local function)\s", line)) for s, p in SIGNATURES.items()) or re.match(r"^\s*(?:for|while|if|with|def|class)\b.*:\s*$", line):
            k = body_end(lines, k, "brace" if line.rstrip().endswith("{") else "indent") + 1  # an example: code to the end of its block
            kept.append("")
            continue
        bare = line.strip()
        silent = not bare or not _WORD.search(bare) or _CODE.match(bare) and not _TAG.match(bare) or _TOOL.match(bare) or re.match(r"^[\w ]{1,40}:\s*$", bare)
        kept.append("" if silent else bare)
        k += 1
    out: list[str] = []
    for block in re.split(r"\n{2,}", "\n".join(kept)):
        if _NOTICE.match(block):
            continue
        joined = re.sub(r"\n(?=\s*(?:[@\\:][A-Za-z]|[-*] |\w+:\s*$))", "\0", block).replace("\n", " ")
        for part in joined.split("\0"):
            out += [part] if _TAG.match(part) else re.split(r"(?<=[.!?。！？])\s+|(?<=[。！？])", part)
    return [s for s in out if s.strip()]


def tells(docstring: str | None, name: str | None, signature: str | None) -> bool:
    """Whether a comment says at least one thing that the name and the signature do not. Short comments repeat and are kept."""
    return _tells_kept(docstring, name, signature) if docstring and len(docstring) <= KEPT_CHARS else _judge(docstring, name, signature)


def _judge(docstring: str | None, name: str | None, signature: str | None) -> bool:
    if not docstring or not docstring.strip():
        return False
    known = name_words(name, signature)
    for sentence in prose(docstring):
        if _LICENCE.search(sentence):
            continue
        tag = _TAG.match(sentence)
        own = known
        if tag:
            label, rest = tag["tag"].lower(), tag["rest"]
            if label in _SILENT_TAGS or _TOOL.match(sentence):
                continue
            if label in _NAMED_TAGS:
                called = re.match(r"\s*(?:\{[^}]*\}\s*)?(\$?[\w.\[\]]+)\s*:?", rest)
                if called:
                    own, rest = known | name_words(called[1]), rest[called.end() :]
            sentence = rest
        if _TASK.match(sentence) or _POINTER.search(sentence) or _EMPTY.match(sentence) or _TOOL.match(sentence):
            continue
        if _says(sentence, own):
            return True
    return False


@lru_cache(maxsize=20_000)
def _tells_kept(docstring: str, name: str | None, signature: str | None) -> bool:
    return _judge(docstring, name, signature)


@F.pandas_udf(T.BooleanType())
def _tells(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for docs, names, signatures in batches:
        yield pd.Series([tells(d, n, s) for d, n, s in zip(docs, names, signatures)], dtype="bool")


def documented_functions(nodes: DataFrame) -> DataFrame:
    """Pairs of code and description: (node_id, name, signature, docstring), one row for each function or method that has both.

    A node counts by its newest row (largest updated_at). It must then be of kind function or method, have a signature
    that is not blank, and a docstring that tells something which name and signature do not, in any language. Rows with a
    null id do not count; null and blank fields, ties and repeated rows are allowed; an empty table gives no rows;
    further columns are not read.

    One shuffle by id, of five columns; rows that cannot be the newest drop out before it in part. The judgement runs
    after it, on candidates only.
    """
    rows = newest(nodes, "id", "updated_at", ["kind", "name", "signature", "docstring"])
    rows = rows.filter(trimmed_lower(F.col("kind")).isin("function", "method")).filter("btrim(signature, ' \\t\\n\\r\\f') <> '' AND btrim(docstring, ' \\t\\n\\r\\f') <> ''")
    return rows.filter(_tells("docstring", "name", "signature")).select(F.col("id").alias("node_id"), "name", "signature", "docstring")


_PAIR = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("signature", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("comment", T.StringType())]))


def functions_by_language(text: str, language: str | None) -> list[tuple[str, str, int, int, str]]:
    """extract_functions() of each language of a text: the given one or, without it, those that its declarations show."""
    if language and language.strip():
        return extract_functions(text, language)
    return sorted((f for own, part in language_sections(text) for f in extract_functions(part, own)), key=lambda f: f[2])


@F.pandas_udf(_PAIR)
def _extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, languages in batches:
        yield pd.Series([[f for f in functions_by_language(t, lang) if tells(f[4], f[0], f[1])] if t else [] for t, lang in zip(texts, languages)])


def source_functions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str | None = None) -> DataFrame:
    """Documented functions found in source text: (id_col, name, signature, start_line, end_line, comment).

    Without language_col, and where it is null or blank, the languages of a text are told by its declarations and each
    part is read with the patterns of its own. A narrow pass over whole texts. Null and empty texts give nothing; repeated
    rows give repeated pairs.
    """
    language = df[language_col] if language_col else F.lit(None).cast("string")
    found = df.select(df[id_col], F.explode(_extract(df[text_col], language)).alias("f"))
    return found.select(id_col, "f.*")

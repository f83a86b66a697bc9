"""Functions paired with their documentation.

Comment spans and function spans are extracted independently, from the same text, in which strings and comments were
blanked for the latter. An as-of interval join then attaches to each function the nearest comment that ends before
it, if nothing but annotations stands on the lines between. In Python the documentation is the string that is the
first statement of the body.

Documentation counts if, without comment marks, tag entries and markup, at least four words are left that are not
only the function's name and articles, and that do not merely call it unwritten, generated or to be done.

Defined results: files without content or that do not parse give nothing; nested functions count, classes, body-less
declarations and commented-out code do not; exact copies of a row count once."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from .validity import KEYWORDS, check, language_of

_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_C_COMMENT = r"(?P<line>//[^\n]*)|(?P<block>/\*[\s\S]*?\*/)"
#: Comments and literals of each language; everything else is code.
_SCAN = {
    "java": re.compile(rf'{_C_COMMENT}|"""[\s\S]*?(?<!\\)"""|{_DQ}|{_SQ}'),
    "c": re.compile(rf"{_C_COMMENT}|{_DQ}|{_SQ}|(?P<cpp>^[ \t]*\#(?:[^\n\\/]|\\[\s\S]|/(?![/*]))*)", re.M),
    "go": re.compile(rf"{_C_COMMENT}|{_DQ}|{_SQ}|`[^`]*`"),
    "javascript": re.compile(rf"{_C_COMMENT}|{_DQ}|{_SQ}|`(?:[^`\\]|\\[\s\S])*`|(?<=[(,=:\[!&|?{{}};])\s*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/"),
    "python": re.compile(rf'(?P<line>\#[^\n]*)|"""(?:[^\\]|\\[\s\S])*?"""|\'\'\'(?:[^\\]|\\[\s\S])*?\'\'\'|{_DQ}|{_SQ}'),
    "tal": re.compile(r'(?P<line>--[^\n]*|![^!\n]*!?)|"(?:[^"\n]|"")*"|(?P<cpp>^\?[^\n]*)', re.M),
}
_NAME = r"(?:[^\W\d]|\$)[\w$]*"
#: Where a declaration may stand on blanked text, by its name; the parentheses behind it are matched by a scan.
_HEADS = {
    "java": re.compile(rf"(?<![.\w$])(?P<name>{_NAME})\s*\("),
    "c": re.compile(r"(?<![.\w])(?P<name>[^\W\d]\w*)\s*\("),
    "go": re.compile(r"^func\b\s*", re.M),
    "javascript": re.compile(
        rf"(?<![\w$])(?:function\b\s*\*?\s*(?P<f>{_NAME})\s*\(|(?P<v>\#?{_NAME})\s*(?P<op>=(?![=>])|:)\s*(?:async\b\s*)?(?:function\b\s*\*?\s*(?:{_NAME})?\s*\(|(?P<arrow>\()|(?P<one>{_NAME}\s*=>\s*\{{?))|(?P<m>\#?{_NAME})\s*\()"
    ),
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>[^\W\d]\w*)", re.M),
    "tal": re.compile(r"(?i)\b(?:sub)?proc\s+(?P<name>[^\W\d][\w^]*)"),
}
#: What may stand between a declaration's parentheses and its block.
_TAIL = {"java": re.compile(r"(?:\s*\[\s*\])*\s*(?:throws\b[\w.,\s<>@]+)?\{"), "c": re.compile(r"\s*\{"), "javascript": re.compile(r"\s*\{"), "arrow": re.compile(r"\s*=>\s*\{?")}
#: Declarations of parameters between the parentheses and the block, in old C.
_OLD_C = re.compile(r"\s*(?:[^\W\d][\w\s*,\[\]]*;\s*)+\{")
#: Reserved words of each language, which name no function there.
_RESERVED = {language: frozenset(KEYWORDS[language].split()) for language in ("java", "c")}
#: What stands before the name of a Java or C function; words that only open statements.
_BEFORE = {"java": re.compile(r"[\w\s.,<>\[\]?&*$@()]*[\w>\]*]"), "c": re.compile(r"[\w\s*()]*[\w*]")}
_STATEMENT = re.compile(r"\b(?:new|return|else|throw|case|goto|record)\b")
_TYPE = re.compile(r"\b(?:class|enum|record|interface)\s+([\w$]+)")
#: Indent and words before a function's name on its line.
_LEAD = re.compile(r"([ \t]*)(?:(?:export|default|async|static|get|set|const|let|var|function)\b\s*)*(?:[\w$]+\s*\.\s*)*[*#]?\s*$")
_MODIFIERS = re.compile(r"(?:.*[{},;])?\s*(?:(?:static|async|get|set)\b\s*)*\*?\s*", re.S)
_ASSIGNED = re.compile(r"(?:(?:export\s+)?(?:const|let|var)\b|static\b|(?:[\w$]+\s*\.\s*)*)\s*")
_ANNOTATION = re.compile(r"\s*@(?!interface\b)[\w.]+\s*")
_SPACE = re.compile(r"\s*")


class Function(NamedTuple):
    name: str
    line: int
    signature: str
    body: str
    docstring: str | None


class _Text:
    """A text with its comments, and its code with literals and comments blanked."""

    def __init__(self, text: str, language: str) -> None:
        self.text = text
        self.comments: list[tuple[int, int, str]] = []
        self.literals: dict[int, int] = {}
        parts, last = [], 0
        for m in _SCAN[language].finditer(text):
            a, b = m.span()
            kind = m.lastgroup
            if kind in ("line", "block"):
                self.comments.append((a, b, kind))
            elif kind is None:
                self.literals[a] = b
            parts += [text[last:a], _blank(m.group())]
            last = b
        self.code = "".join([*parts, text[last:]])
        self.starts = [0, *itertools.accumulate(len(x) + 1 for x in text.split("\n"))][:-1]

    def line(self, at: int) -> int:
        """Line from 1."""
        return bisect.bisect_right(self.starts, at)

    def row(self, line: int) -> str:
        return self.code[self.starts[line - 1] : self.starts[line] - 1 if line < len(self.starts) else len(self.code)]

    def match(self) -> None:
        """Pair the brackets of the code; of a C conditional, the first branch counts."""
        self.marks: list[int] = []
        self.within: list[int] = []  # index of the mark that encloses each mark, or -1
        self.ends: dict[int, int] = {}  # end of the group of each opening mark
        self.opens: dict[int, int] = {}  # index of the opening mark of each closing one, by index
        stack: list[int] = []
        for k, m in enumerate(re.finditer(r"[;{}()]", self.code)):
            c, at = m.group(), m.start()
            self.marks.append(at)
            if c in ")}":
                kind = "(" if c == ")" else "{"
                if c == "}":
                    while stack and self.code[self.marks[stack[-1]]] == "(":
                        stack.pop()
                if stack and self.code[self.marks[stack[-1]]] == kind:
                    self.opens[k] = stack.pop()
                    self.ends[self.marks[self.opens[k]]] = at + 1
            self.within.append(stack[-1] if stack else -1)
            if c in "({":
                stack.append(k)
        self.kinds: dict[int, str] = {}

    def declaration(self, at: int) -> int:
        """First character of the declaration that holds ``at``: behind the latest ; { } or unclosed parenthesis."""
        k, code = bisect.bisect_left(self.marks, at) - 1, self.code
        while k >= 0:
            c = code[self.marks[k]]
            if c == ")" and k in self.opens:
                k = self.opens[k] - 1
            elif c == "(" and re.fullmatch(r"\s*\*[\s*]*", code[self.marks[k] + 1 : at]):  # a function that gives a pointer to one
                k -= 1
            else:
                break
        i = self.marks[k] + 1 if k >= 0 else 0
        return _SPACE.match(code, i, at).end()

    def inside(self, at: int) -> int:
        """Index of the bracket that encloses ``at``, or -1."""
        k = bisect.bisect_left(self.marks, at) - 1
        return -1 if k < 0 else k if self.code[self.marks[k]] in "({" and self.ends.get(self.marks[k], at + 1) > at else self.within[k]

    def kind(self, k: int) -> str:
        """Whether a bracket of JavaScript opens a class, an object or something else."""
        if k < 0 or self.code[self.marks[k]] != "{":
            return ""
        found = self.kinds.get(k)
        if found is None:
            at = self.marks[k]
            head = self.code[self.declaration(at) : at].rstrip()
            if re.search(r"(?:^|[\s=(,])class\b(?!\s*\()", head):
                found = "class"
            elif re.search(r"(?:[=(,\[?&|]|\breturn|\bdefault)$", self.code[max(0, at - 200) : at].rstrip()):
                found = "object"
            elif head.endswith(":"):
                found = "object" if self.kind(self.within[k]) == "object" else ""
            else:
                found = ""
            self.kinds[k] = found
        return found

    def documents(self) -> tuple[list[int], list[tuple[int, int, int]]]:
        """End lines, and (end line, start, end) of the comments that fill their lines, runs of line comments joined."""
        found: list[list] = []
        for a, b, kind in self.comments:
            first, last = self.line(a), self.line(b - 1)
            if self.row(first).strip() or last != first and self.row(last).strip():
                continue
            mark = self.text[a] if kind == "line" else ""
            if mark and found and found[-1][3] == mark and found[-1][0] == first - 1:
                found[-1][0], found[-1][2] = last, b
            else:
                found.append([last, a, b, mark])
        return [x[0] for x in found], [(x[0], x[1], x[2]) for x in found]


def _blank(span: str) -> str:
    """A span of the same extent and lines without its characters."""
    return " " * len(span) if "\n" not in span else "\n".join(" " * len(x) for x in span.split("\n"))


def _without_branches(code: str, text: str) -> str:
    """C code in which all but the first branch of each conditional is blank."""
    out, skip, depth = [], 0, 0
    for mine, line in zip(code.split("\n"), text.split("\n"), strict=True):
        m = re.match(r"[ \t]*#[ \t]*(if|ifdef|ifndef|elif|else|endif)\b", line)
        if m:
            word = m[1]
            if word.startswith("if"):
                depth += 1
            elif word == "endif":
                skip, depth = (0 if skip == depth else skip), depth - 1
            elif not skip:
                skip = depth
        out.append(" " * len(mine) if skip else mine)
    return "\n".join(out)


def _java_or_c(t: _Text, language: str, m: re.Match[str]) -> tuple[int, int, int] | None:
    """(start of the declaration, of what stands before its block, of the block) if a function is declared."""
    name, at, code = m["name"], m.start("name"), t.code
    if name in _RESERVED[language]:
        return None
    after = t.ends.get(m.end() - 1)
    if after is None:
        return None
    tail = _TAIL[language].match(code, after)
    if not tail and language == "c":
        if code[after : after + 40].lstrip()[:1] == ")":  # the parameters of the function that it gives a pointer to
            second = t.ends.get(code.find("(", after))
            tail = _TAIL["c"].match(code, second) if second else None
        elif t.inside(at) < 0:
            tail = _OLD_C.match(code, after)
    if not tail:
        return None
    begin = annotated = t.declaration(at)
    if language == "java":
        begin = _unannotated(t, begin, at)
    before = code[begin:at].strip()
    if before:
        if not _BEFORE[language].fullmatch(before) or _STATEMENT.search(before):
            return None
    elif language == "c":
        if t.inside(at) >= 0:
            return None
    else:
        k = t.inside(at)
        owner = _TYPE.search(code, t.declaration(t.marks[k]), t.marks[k]) if k >= 0 else None
        if not owner or owner[1] != name:  # a constant of an enumeration may have a body as well
            return None
    return annotated, begin, tail.end() - 1


def _unannotated(t: _Text, begin: int, at: int) -> int:
    while a := _ANNOTATION.match(t.code, begin, at):
        begin = t.ends.get(a.end(), a.end()) if t.code[a.end() : a.end() + 1] == "(" else a.end()
        begin = _SPACE.match(t.code, begin, at).end()
    return begin


def _go_head(t: _Text, at: int) -> tuple[str, int, int] | None:
    """(name, its place, opening brace) of a function of Go; none without a block."""
    code = t.code
    if code[at : at + 1] == "(":
        if at not in t.ends:
            return None
        at = _SPACE.match(code, t.ends[at]).end()
    m = re.compile(r"([^\W\d]\w*)\s*").match(code, at)
    if not m:
        return None
    i = m.end()
    if code[i : i + 1] == "[":
        depth = 0
        for b in re.compile(r"[\[\]]").finditer(code, i):
            depth += 1 if b.group() == "[" else -1
            if not depth:
                i = _SPACE.match(code, b.end()).end()
                break
    i = t.ends.get(i, -1) if code[i : i + 1] == "(" else -1
    while i >= 0:
        b = re.compile(r"[({\n]").search(code, i)
        if not b or b.group() == "\n":
            return None
        if b.group() == "{" and not re.search(r"\b(?:interface|struct)\s*$", code[i : b.start()]):
            return m[1], m.start(1), b.start()
        i = t.ends.get(b.start(), -1)
    return None


def _script_head(t: _Text, m: re.Match[str]) -> tuple[str, int, int, int] | None:
    """(name, its place, start of the declaration, end of what stands before its body) of a function of JavaScript."""
    code, group = t.code, "f" if m["f"] else "v" if m["v"] else "m"
    at, name = m.start(group), m[group]
    if group == "m" and name == "function":
        return None
    if m["one"]:
        after = m.end()
    else:
        close = t.ends.get(m.end() - 1)
        tail = _TAIL["arrow" if m["arrow"] else "javascript"].match(code, close) if close else None
        if not tail:
            return None
        after = tail.end()
    row = code.rfind("\n", 0, at) + 1
    lead = _LEAD.match(code, row, at)
    begin = lead.end(1) if lead else t.declaration(m.start())
    if group == "m" and (t.kind(t.inside(at)) == "" or not _MODIFIERS.fullmatch(code, row, at)):
        return None
    if group == "v":
        if m["op"] == ":":
            if t.kind(t.inside(at)) != "object" or code[max(0, at - 2000) : at].rstrip()[-1:] not in ("{", ","):
                return None
        elif not _ASSIGNED.fullmatch(code, begin, at):
            return None
    return name, at, begin, after


def functions(text: str, language: str) -> Iterator[Function]:
    """All functions with a body, with the raw comment or string attached to them."""
    text = re.sub("\r\n?", "\n", text)
    t = _Text(text, language)
    if language == "python":
        yield from _python(t)
        return
    if language == "c":
        t.code = _without_branches(t.code, text)
    t.match()
    ends, documents = t.documents()
    for m in _HEADS[language].finditer(t.code):
        if language == "tal":
            name, at = m["name"], m.start("name")
            begin = annotated = t.declaration(at)
            stop = _tal_end(t.code, m.end())
            if stop is None:
                continue
            signature = text[begin : t.code.find(";", m.end()) + 1]
        else:
            if language == "go":
                head = _go_head(t, m.end())
                if head is None:
                    continue
                name, at, open_at = head
                begin = annotated = m.start()
            elif language == "javascript":
                found = _script_head(t, m)
                if found is None:
                    continue
                name, at, annotated, after = found
                begin, open_at = _unannotated(t, annotated, at), after - 1
            else:
                place = _java_or_c(t, language, m)
                if place is None:
                    continue
                name, at = m["name"], m.start("name")
                annotated, begin, open_at = place
            if t.code[open_at] != "{":  # an arrow function of one expression
                line = t.line(open_at)
                stop = t.starts[line] - 1 if line < len(t.starts) else len(text)
            else:
                stop = t.ends.get(open_at, len(text))
            signature = text[begin : open_at + 1]
        yield Function(name, t.line(at), signature.strip(), text[begin:stop], _attached(t, ends, documents, annotated, begin))


def _attached(t: _Text, ends: list[int], documents: list[tuple[int, int, int]], annotated: int, begin: int) -> str | None:
    """As-of join: the nearest comment before a declaration, unless a statement or blank line stands between."""
    first, line = t.line(annotated), t.line(begin)
    i = bisect.bisect_left(ends, line) - 1
    if i < 0:
        return None
    end, a, b = documents[i]
    between = range(end + 1, line)
    if end >= first - 1 and (end == line - 1 or all(t.row(k).strip() for k in between)):
        start = t.starts[t.line(a) - 1]
        return t.text[start:b]
    return None


def _tal_end(code: str, at: int) -> int | None:
    """End of a TAL procedure's block, or None if it has none."""
    head = code.find(";", at)
    if head < 0 or re.search(r"(?i)\b(?:forward|external)\b", code[at:head]):
        return None
    depth = 0
    for m in re.compile(r"(?i)\b(begin|end|proc)\b").finditer(code, head):
        word = m[1].lower()
        if word == "proc" and depth == 0:
            return None
        depth += (word == "begin") - (word == "end")
        if word == "end" and depth == 0:
            return m.end() + (code[m.end() : m.end() + 1] == ";")
    return None


def _python(t: _Text) -> Iterator[Function]:
    for m in _HEADS["python"].finditer(t.code):
        begin, depth, i = m.start() + len(m.group()) - len(m.group().lstrip()), 0, m.end()
        while i < len(t.code):
            c = t.code[i]
            depth += (c in "([{") - (c in ")]}")
            if c == ":" and not depth:
                break
            i += 1
        indent = begin - t.starts[t.line(begin) - 1]
        line, last = t.line(i), t.line(i)
        for k in range(line + 1, len(t.starts) + 1):
            row = t.row(k)
            body = row.lstrip()
            if body:
                if len(row) - len(body) <= indent:
                    break
                last = k
            elif k < len(t.starts) and any(a < t.starts[k - 1] < b for a, b in t.literals.items()):
                last = k
        stop = t.starts[last] - 1 if last < len(t.starts) else len(t.text)
        doc = None
        # The first statement: a literal in the text where the code has only blanks before it.
        n = re.compile(r"(?:\s|#[^\n]*)*").match(t.text, i + 1).end()
        p = re.compile(r"[rRuUbBfF]{0,2}(?=[\"'])").match(t.text, n)
        if p and t.line(n) <= last + 1 and not set(p.group()) & set("bBfF") and p.end() in t.literals:
            end = t.literals[p.end()]
            after = t.text[end : t.text.find("\n", end) if "\n" in t.text[end:] else len(t.text)].strip()
            if (not after or after[0] in ";#") and (t.line(n) == t.line(i) or n - t.starts[t.line(n) - 1] > indent):
                doc = t.text[n:end]
                stop = max(stop, end)
        yield Function(m["name"], t.line(m.start("name")), t.text[begin : i + 1], t.text[begin:stop], doc)


_WORD = re.compile(r"[^\W\d_](?:[\w'’]|-(?=\w))*")
_TAG = re.compile(r"^(?:[@\\][A-Za-z]\w*|:[a-z]+(?:\s+[^:\n]*)?:)(?:\s|$)")
_SECTION = re.compile(r"^(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws):?\s*$")
#: What a sentence says that is about documentation itself: marks of unfinished work, then unwritten, generated or
#: to be written. Verbs such as add or write count only with documentation as their object or a mere later behind.
_DOC = r"(?:documentation|docs?|descriptions?|comments?|docstrings?|javadoc)"
_UNDONE = re.compile(
    r"\b(?:todo|fixme|xxx|tbd|tbc)\b|\bto be (?:done|written|documented|described|defined|filled|completed)\b|\bauto[- ]?generated\b|\bdo not edit\b|^\W*generated (?:by|code|automatically|method|function|stub)\b"
    r"|^\W*(?:this|the)?\s*(?:\w+\s+){0,2}(?:is|was|has been|were|are) (?:automatically )?generated\b|\bundocumented\b|\b(?:not|un) ?(?:yet )?(?:documented|written|described)(?: yet)?\W*$"
    rf"|^\W*no {_DOC}\b|\b{_DOC} (?:is |are )?(?:missing|needed|pending|to follow|follows)\b|\bmissing {_DOC}\b"
    rf"|^\W*(?:please )?(?:add|write|insert|put|fill in|provide)\s+(?:(?:a|an|the|some|any|proper|real|better|more|missing|your)\s+)*{_DOC}\b"
    r"|^\W*(?:please )?(?:describe|document|explain|write|add|fill|complete)\b(?:\s+(?:this|the|it|me|in))*(?:\s+(?:function|method|procedure|code|text|one))?(?:\s+(?:later|here|soon|me))*\W*$"
    r"|^\W*(?:this (?:is |was )?)?(?:an? |the |only |just |mere )*(?:\w+ )?(?:placeholder|stub)\W*$",
    re.I,
)
_ARTICLES = frozenset(["a", "an", "the"])


def prose(raw: str, language: str) -> str:
    """Documentation without comment marks, tag entries and markup; sentences stay on lines."""
    if language == "python":
        raw = re.sub(r"^[rRuU]?(\"\"\"|'''|\"|')([\s\S]*)\1$", r"\2", raw)
    else:
        raw = re.sub(r"^\s*(?:/\*+|//+[!/]?|!+|--+)|\*+/\s*$|!\s*$", "", raw)
    kept, tag = [], False
    for line in raw.split("\n"):
        if language != "python":
            line = re.sub(r"^\s*(?:///?!?|\*(?!/)|!|--+)+|\*+/\s*$|!\s*$" if language == "tal" else r"^\s*(?://+!?|\*+)?|\*+/\s*$", "", line)
        line = line.strip().strip("-=*#~_/ \t")
        if not line:
            tag = False
            continue
        if _TAG.match(line) or _SECTION.match(line):
            tag = True
        if not tag:
            kept.append(line)
    text = "\n".join(kept)
    text = re.sub(r"\{@\w+\s+([^}]*)\}", r"\1", text)
    return re.sub(r"</?[A-Za-z][^>\n]*>|&[a-z]+;|[`*]", " ", text)


def says_something(raw: str | None, name: str, language: str) -> bool:
    """Whether documentation is more than a name, a tag list or a promise."""
    if not raw:
        return False
    text = prose(raw, language)
    words = _WORD.findall(text)
    if len(words) < 4:
        return False
    own = {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+|\d+", name)} | {name.lower()}
    plain = [p for w in words for p in ([w.lower()] if w.lower() in own else re.findall(r"[^\W\d_]+|\d+", w.lower()))]
    if not [w for w in plain if w not in own and w not in _ARTICLES]:
        return False
    # What is left without the sentences that only promise.
    told = [s for s in re.split(r"(?<=[.!?;])\s+|\n(?=[A-Z])", text) if not _UNDONE.search(s)]
    if len(told) == len(re.split(r"(?<=[.!?;])\s+|\n(?=[A-Z])", text)):
        return True
    return len(_WORD.findall(" ".join(told))) >= 4


def documented_functions(df: DataFrame, key: str = "file_id", path: str = "file_path", content: str = "content", with_text: bool = True) -> DataFrame:
    """``(key, line_no, func_name[, signature, body, docstring])`` of the documented functions of files that parse.

    Copies of a file are dropped by what was found in them, so that no whole file is shuffled."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, path, content).filter(f"`{content}` is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for k, p, t in zip(x[key], x[path], x[content], strict=True):
                language = language_of(p)
                if language and t.strip() and check(language, t) is None:
                    out += [(k, f.line, f.name, f.signature, f.body, f.docstring) for f in functions(t, language) if says_something(f.docstring, f.name, language)]
            yield pd.DataFrame([r[: len(names)] for r in out], columns=names).astype({key: x[key].dtype})

    names = [key, "line_no", "func_name", *(("signature", "body", "docstring") if with_text else ())]
    schema = f"`{key}` {kind}, line_no int, func_name string" + (", signature string, body string, docstring string" if with_text else "")
    return rows.mapInPandas(run, schema).distinct()

"""Source files that do not parse, by memoised derivatives over token streams.

A file is read line by line. Identifiers and numbers are masked first, so that equal line shapes are equal strings;
what a shape does to a parser state (lexer mode, open preprocessor branches or indents, grammar node) is kept, and
most lines cost one lookup. A new shape is cut into tokens, and the grammar node is derived by each. An empty
derivative marks the failing token; an end that is not nullable is a truncation.

C is judged with any set of macros: the branches of a conditional are alternatives of the node. TAL is judged by its
comments, strings, BEGIN/END, closing semicolons, the marks that it has (braces, bars, tildes, backquotes, runs of
``=``, ``<`` or ``>`` and, outside comments and strings, characters beyond ASCII are none) and by the words that may
open a declaration, so a conflict's lines or another language's text fail.

Defined results: null contents have no verdict (null); empty and blank contents are valid, and so are files of an
extension without grammar; exact copies of a row count once in rates; an unknown language counts under its extension."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grammars
from .derive import EMPTY, Grammar

#: Language of an extension.
LANGUAGES = {"py": "python", "pyw": "python", "java": "java", "c": "c", "h": "c", "js": "javascript", "mjs": "javascript", "go": "go", "tal": "tal"}

#: Reserved words.
KEYWORDS = {
    "java": "abstract assert boolean break byte case catch char class continue default do double else enum extends false final finally float for if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true try void volatile while",
    "c": "asm auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef typeof union unsigned void volatile while _Atomic _Bool _Complex _Noreturn _Static_assert _Thread_local __attribute__ __extension__",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "javascript": "async await break case catch class const continue debugger default delete do else export extends false finally for function get if import in instanceof let new null of return set static super switch this throw true try typeof var void while with yield",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "tal": "begin end block byte callable char define entry external fixed forward int interrupt label literal main name priv proc real resident string struct subproc unsigned variable",
}
_OPS = {
    "java": "-> :: ++ -- && || == != <= >= += -= *= /= %= &= |= ^= ...",
    "c": "-> ++ -- && || == != <= >= += -= *= /= %= &= |= ^= ...",
    "go": ":= ++ -- && || == != <= >= += -= *= /= %= &= |= ^= &^= &^ ...",
    "javascript": "=> ?. ++ -- && || ?? === !== == != <= >= += -= *= /= %= &= |= ^= ** **= &&= ||= ??= ...",
    "python": "-> := == != <= >= += -= *= /= %= &= |= ^= ** **= // //= << >> <<= >>= @= ...",
}
_SINGLE = {"java": "+-*/%&|^!~?:;,.()[]{}=<>@", "c": "+-*/%&|^!~?:;,.()[]{}=<>", "go": "+-*/%&|^!~:;,.()[]{}=<>", "javascript": "+-*/%&|^!~?:;,.()[]{}=<>#", "python": "+-*/%&|^~:;,.()[]{}=<>@"}
_NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)"
_SUFFIX = {"java": "[lLfFdD]?", "c": "[uUlLfF]*", "go": "i?", "javascript": "n?", "python": "[jJ]?"}
_STRING = r'"(?:[^"\\\n]|\\.)*"'


def _op_pattern(language: str) -> str:
    longest = sorted([*_OPS[language].split(), *_SINGLE[language]], key=len, reverse=True)
    return "|".join(map(re.escape, longest))


@functools.cache
def _lexer(language: str) -> re.Pattern[str]:
    parts = [r"(?P<ws>[ \t\f\v ﻿]+)"]
    if language == "python":
        parts += [r"(?P<cm>\#.*)", r"(?P<cont>\\$)", r"(?P<tri>[a-zA-Z]{0,2}(?:\"\"\"|'''))", r"(?P<str>[a-zA-Z]{0,2}(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'))", r"(?P<open>[a-zA-Z]{0,2}(?:\"(?:[^\"\\]|\\.)*\\|'(?:[^'\\]|\\.)*\\)$)"]
    else:
        parts += [r"(?P<cm>//.*)", r"(?P<bc>/\*)"]
        if language == "java":
            parts.append(r'(?P<tb>""")')
        if language in ("go", "javascript"):
            parts.append(r"(?P<tick>`)")
        if language == "c":
            parts += [r'(?P<str>(?:u8|[LuU])?"(?:[^"\\]|\\.)*")', r"(?P<chr>[LuU]?'(?:[^'\\]|\\.)+')", r"(?P<cont>\\$)"]
        elif language == "javascript":
            parts += [r"(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')", r"(?P<open>(?:\"(?:[^\"\\]|\\.)*\\|'(?:[^'\\]|\\.)*\\)$)"]
        else:
            parts += [rf"(?P<str>{_STRING})", r"(?P<chr>'(?:[^'\\]|\\.[^']*)')"]
    parts += [rf"(?P<num>{_NUMBER}{_SUFFIX[language]}(?![\w]))", r"(?P<id>[^\W\d][\w$]*)" if language != "javascript" and language != "java" else r"(?P<id>(?:[^\W\d]|\$)[\w$]*)", rf"(?P<op>{_op_pattern(language)})", r"(?P<bad>.)"]
    return re.compile("|".join(parts))


_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[]|\\.|\[(?:[^\]\\]|\\.)*\])+/[a-zA-Z]*")
#: Preprocessor words, which the mask must keep.
_CPP = "ifdef ifndef elif endif define undef include pragma error line defined"
#: Identifiers (but for prefixes of Python strings and what opens an expression in a template) and numbers.
_WORDS = {language: re.compile((r"(?:[^\W\d]|\$(?!\{))(?:\w|\$(?!\{))*+" if language in ("java", "javascript") else r"[^\W\d]\w*+") + ("(?![\"'])" if language == "python" else "") + r"|\d[\w.]*+") for language in KEYWORDS}


class _Masks(dict):
    """What stands for a word: itself if it is reserved, ``a`` for an identifier, ``1`` for a plain number."""

    def __init__(self, language: str) -> None:
        self.reserved = frozenset((KEYWORDS[language] + (" " + _CPP if language == "c" else "")).split())
        self.lower = language == "tal"

    def __missing__(self, word: str) -> str:
        if word[0].isdigit():
            out = "1" if word.isdecimal() and word[0] != "0" else word
        else:
            out = word if (word.lower() if self.lower else word) in self.reserved else "a"
        if len(self) > 500_000:
            self.clear()
        self[word] = out
        return out


_CRLF = re.compile(r"\r\n?")
_MANY = re.compile(r"a (?:a ){3,}")


class Failure(NamedTuple):
    line: int
    token: str
    truncated: bool


class State(NamedTuple):
    """Where a parse stands at a line end."""

    mode: str
    node: int
    prev: str = ""
    stack: tuple = ()


class Checker:
    """Validity of one language's files."""

    def __init__(self, language: str) -> None:
        self.language = language
        self.grammar = Grammar(getattr(grammars, language.upper()), "unit")
        self.states: list[State] = []
        self._ids: dict[State, int] = {}
        self._steps: dict[tuple[int, str], int | tuple[str, str]] = {}
        self._masks, self._word = _Masks(language), _WORDS[language]
        self.words = frozenset(KEYWORDS[language].split())
        self._line = {"python": self._python, "tal": self._tal, "c": self._c, "go": self._go, "javascript": self._javascript, "java": self._plain}[language]
        self.begin = self._id(State("", self.grammar.start, stack=(0,) if language == "python" else ()))

    def _id(self, state: State) -> int:
        found = self._ids.get(state)
        if found is None:
            found = self._ids[state] = len(self.states)
            self.states.append(state)
        return found

    def mask(self, text: str) -> str:
        """The text with ``a`` for identifiers and ``1`` for decimal numbers."""
        masks = self._masks
        return _MANY.sub("a a a a ", self._word.sub(lambda m: masks[m[0]], text))

    def check(self, text: str) -> Failure | None:
        text = _CRLF.sub("\n", text.removeprefix("﻿"))
        if not text.strip():
            return None
        at, steps = self.begin, self._steps
        for number, line in enumerate(self.mask(text).split("\n"), 1):
            after = steps.get((at, line))
            if after is None:
                if len(steps) > 400_000:
                    steps.clear()
                after = steps[at, line] = self._step(at, line)
            if after.__class__ is tuple:
                return Failure(number, after[1], False)
            at = after
        return self._end(self.states[at], number)

    def _step(self, at: int, line: str) -> int | tuple[str, str]:
        try:
            return self._id(self._line(self.states[at], line))
        except _Stop as stop:
            return "failed", stop.token

    def _end(self, state: State, number: int) -> Failure | None:
        try:
            node = state.node
            if self.language == "python" and not state.mode:
                if state.prev:
                    return Failure(number, "", True)
                for _ in state.stack[1:]:
                    node = self._derive(node, "DEDENT")
            if state.mode in ("", "pp") and not (self.language == "c" and state.stack):
                if self.grammar.nullable(node):
                    return None
                if self.language == "javascript" and self.grammar.nullable(self._maybe(node, ";")):
                    return None
        except _Stop:
            pass
        return Failure(number, "", True)

    # Grammar.

    def _maybe(self, node: int, kind: str) -> int:
        token = self.grammar.tokens.get(kind)
        return EMPTY if token is None else self.grammar.derive(node, token)

    def _derive(self, node: int, kind: str, shown: str = "") -> int:
        node = self._maybe(node, kind)
        if node == EMPTY:
            raise _Stop(shown or kind)
        return node

    def _kind(self, group: str, text: str) -> str:
        if group == "id":
            return text if text in self.words else "ID"
        return {"num": "NUM", "str": "STR", "chr": "CHR", "tpl": "TPL", "rex": "REX"}.get(group, text)

    def _tokens(self, line: str, mode: str, prev: str = "") -> Iterator[tuple[str, str]]:
        """Tokens (kind, text) of a line of a language with C's comments; the last is (MODE, mode after the line)."""
        lexer, i, n = _lexer(self.language), 0, len(line)
        if mode:
            end = {"/*": "*/", '"""': '"""', "`": "`"}.get(mode, "")
            if mode in "\"'":  # a string continued over a line end
                m = re.compile(rf"(?:[^{mode}\\]|\\.)*({mode}|\\$)").match(line)
                if not m:
                    raise _Stop(line[:20])
                if m[1] != mode:
                    yield "MODE", mode
                    return
                i = m.end()
                yield "STR", "string"
            elif mode.startswith("`"):
                i, depths = self._template(line, 0, tuple(map(int, mode[1:].split(","))))
                if i < 0:
                    yield "MODE", "`" + ",".join(map(str, depths))
                    return
                yield self._tick(), "`"
            else:
                j = _close(line, end)
                if j < 0:
                    yield "MODE", mode
                    return
                i = j
                if mode == '"""':
                    yield "STR", mode
        while i < n:
            if line[i] == "/" and self.language == "javascript" and prev not in _VALUE and (m := _REGEX.match(line, i)):
                yield "REX", m.group()
                prev, i = "REX", m.end()
                continue
            m = lexer.match(line, i)
            group, text = m.lastgroup, m.group()
            i = m.end()
            if group == "ws":
                continue
            if group == "cm":
                break
            if group == "bc":
                j = line.find("*/", i)
                if j < 0:
                    yield "MODE", "/*"
                    return
                i = j + 2
            elif group == "tb":
                j = _close(line[i:], '"""')
                if j < 0:
                    yield "MODE", '"""'
                    return
                i += j
                prev = "STR"
                yield "STR", text
            elif group == "tick":
                i, depths = self._template(line, i)
                if i < 0:
                    yield "MODE", "`" + ",".join(map(str, depths))
                    return
                prev = self._tick()
                yield prev, text
            elif group == "open":
                yield "MODE", text[0]
                return
            elif group == "cont":
                continue
            elif group == "bad":
                raise _Stop(text)
            else:
                prev = self._kind(group, text)
                yield prev, text
        yield "MODE", ""

    def _tick(self) -> str:
        return "TPL" if self.language == "javascript" else "STR"

    def _template(self, line: str, i: int, open_: tuple[int, ...] = (0,)) -> tuple[int, tuple[int, ...]]:
        """End of a raw or template literal from i, or -1 and what is open at the line end: for each nested template,
        the open braces of its expression, or 0 in its text."""
        if self.language == "go":
            j = line.find("`", i)
            return (j + 1, ()) if j >= 0 else (-1, (0,))
        depths = list(open_)
        while i < len(line):
            c = line[i]
            if c == "\\":
                i += 1
            elif depths[-1]:
                if c == "`":
                    depths.append(0)
                elif c in "\"'" and (m := _QUOTED[c].match(line, i)):
                    i = m.end() - 1
                else:
                    depths[-1] += (c == "{") - (c == "}")
            elif c == "`":
                depths.pop()
                if not depths:
                    return i + 1, ()
            elif c == "$" and line[i + 1 : i + 2] == "{":
                depths[-1], i = 1, i + 1
            i += 1
        return -1, tuple(depths)

    # Lines by language.

    def _plain(self, state: State, line: str) -> State:
        node, mode = state.node, state.mode
        for kind, text in self._tokens(line, mode):
            if kind == "MODE":
                mode = text
            else:
                node = self._derive(node, kind, text)
        return State(mode, node, stack=state.stack)

    def _c(self, state: State, line: str) -> State:
        if state.mode == "pp":
            return state._replace(mode="pp" if line.endswith("\\") else "")
        bare = line.lstrip(" \t")
        if state.mode == "" and bare.startswith("#"):
            m = re.match(r"#\s*(ifdef|ifndef|if|elif|else|endif)\b", bare)
            word, stack, node = m[1] if m else "", state.stack, state.node
            if word in ("if", "ifdef", "ifndef"):
                stack = (*stack, (node, EMPTY, False))
            elif word in ("elif", "else", "endif"):
                if not stack:
                    raise _Stop(f"#{word}")
                start, done, last = stack[-1]
                done = self.grammar.alt([done, node])
                if last and word != "endif":
                    raise _Stop(f"#{word}")
                if word == "endif":
                    node, stack = done if last else self.grammar.alt([done, start]), stack[:-1]
                    if node == EMPTY:
                        raise _Stop("#endif")
                else:
                    node, stack = start, (*stack[:-1], (start, done, word == "else"))
            comment = re.sub(r'"(?:[^"\\]|\\.)*"', "", bare)
            opened = comment.rfind("/*") > comment.rfind("*/") and "//" not in comment[: comment.rfind("/*")]
            return State("/*" if opened else "pp" if line.endswith("\\") else "", node, stack=stack)
        if not state.stack:
            return self._plain(state, line)
        try:
            return self._plain(state, line)
        except _Stop:
            # This branch can't be the one that is taken; another may.
            if state.node == EMPTY:
                mode = state.mode
                for kind, text in self._tokens(line, mode):
                    mode = text if kind == "MODE" else mode
                return state._replace(mode=mode)
            return self._c(state._replace(node=EMPTY), line)

    def _go(self, state: State, line: str) -> State:
        node, mode, last = state.node, state.mode, ""
        for kind, text in self._tokens(line, mode):
            if kind == "MODE":
                mode = text
            else:
                node, last = self._derive(node, kind, text), kind
        if not mode.startswith("`") and last in _GO_ENDS:
            node = self._derive(node, ";", "newline")
        return State(mode, node)

    def _javascript(self, state: State, line: str) -> State:
        node, mode, prev, fresh = state.node, state.mode, state.prev, True
        if state.mode.startswith("`") or state.mode and state.mode in "\"'":
            fresh = False
        for kind, text in self._tokens(line, mode, prev):
            if kind == "MODE":
                mode = text
                continue
            after = self._maybe(node, kind)
            if after == EMPTY and (fresh or kind == "}" or prev == "}"):
                after = self._maybe(self._maybe(node, ";"), kind)
            if after == EMPTY:
                raise _Stop(text)
            node, prev, fresh = after, kind, False
        if prev in ("return", "break", "continue") and not fresh and (asi := self._maybe(node, ";")):
            node, prev = asi, ";"
        return State(mode, node, prev)

    def _python(self, state: State, line: str) -> State:
        mode, node, indents = state.mode, state.node, state.stack
        i, said = 0, ""
        opened = list(state.prev[1:]) if state.prev[:1] == "(" else []
        lexer = _lexer("python")
        if mode in ('"""', "'''"):
            j = _close(line, mode)
            if j < 0:
                return state
            i, mode, said = j, "", "STR"
            node = self._derive(node, "STR", "string")
        elif mode in ('"', "'") and mode:
            m = re.compile(rf"(?:[^{mode}\\]|\\.)*({mode}|\\$)").match(line)
            if not m:
                raise _Stop("string")
            if m[1] != mode:
                return state
            i, mode, said = m.end(), "", "STR"
            node = self._derive(node, "STR", "string")
        elif mode == "\\":
            mode, said = "", "\\"
        elif not opened:
            body = line.lstrip(" \t\f")
            if not body or body[0] == "#":
                return state
            width = len(line[: len(line) - len(body)].expandtabs(8))
            if width > indents[-1]:
                node, indents = self._derive(node, "INDENT", "indent"), (*indents, width)
            while width < indents[-1]:
                node, indents = self._derive(node, "DEDENT", "dedent"), indents[:-1]
            if width != indents[-1]:
                raise _Stop("dedent")
        n = len(line)
        while i < n:
            m = lexer.match(line, i)
            group, text = m.lastgroup, m.group()
            i = m.end()
            if group == "ws":
                continue
            if group == "cm":
                break
            if group == "cont":
                mode = "\\"
                break
            if group == "tri":
                quote = text[-3:]
                j = _close(line[i:], quote)
                if j < 0:
                    return State(quote, node, "(" + "".join(opened) if opened else "", indents)
                i += j
                text = group = "str"
            elif group == "open":
                quote = '"' if '"' in text[:3] else "'"
                return State(quote, node, "(" + "".join(opened) if opened else "", indents)
            if group == "bad" or group == "num" and re.fullmatch(r"0[\d_]*[1-9][\d_]*", text):
                raise _Stop(text)
            kind = self._kind(group, text)
            if kind in "([{" and group == "op":
                opened.append(kind)
            elif kind in ")]}" and group == "op":
                if not opened or opened.pop() + kind not in ("()", "[]", "{}"):
                    raise _Stop(text)
            node, said = self._derive(node, kind, text), kind
        if mode == "\\" or opened:
            return State(mode, node, "(" + "".join(opened) if opened else "", indents)
        if said:
            node = self._derive(node, "NL", "newline")
        return State("", node, "", indents)

    def _tal(self, state: State, line: str) -> State:
        node = state.node
        if line.startswith("?"):
            return state
        i, n = 0, len(line)
        while i < n:
            m = _TAL.match(line, i)
            i = m.end()
            if m.lastgroup == "bad":
                raise _Stop(m.group())
            if m.lastgroup in ("word", "mark", "str"):
                word = m.group().upper()
                kind = word if word in ("BEGIN", "END", ";") else "DECL" if word.lower() in self.words else "WORD"
                node = self._derive(node, kind, m.group())
        return State("", node)


class _Stop(Exception):
    def __init__(self, token: str) -> None:
        super().__init__(token)
        self.token = token


_TAL = re.compile(r'(?P<cm>--.*|![^!]*(?:!|$))|(?P<str>"(?:[^"]|"")*")|(?P<bad>"|<{3,}|>{3,}|={2,}|[{}|~`]|[^\x00-\x7f])|(?P<word>[A-Za-z_^][\w^]*)|(?P<ws>\s+)|(?P<mark>.)')
_QUOTED = {q: re.compile(rf"{q}(?:[^{q}\\]|\\.)*{q}") for q in "\"'"}
_GO_ENDS = frozenset("ID NUM STR CHR break continue fallthrough return ++ -- ) ] }".split())
_VALUE = frozenset("ID NUM STR TPL REX ) ] } this super null true false".split())


def _close(line: str, end: str) -> int:
    """End after an unescaped closing mark, or -1."""
    i = 0
    while (j := line.find(end, i)) >= 0:
        k = j
        while end != "*/" and k > i and line[k - 1] == "\\":
            k -= 1
        if (j - k) % 2 == 0:
            return j + len(end)
        i = j + 1
    return -1


@functools.cache
def checker(language: str) -> Checker:
    return Checker(language)


def language_of(path: str | None) -> str | None:
    return LANGUAGES.get((path or "").rpartition(".")[2].lower())


def check(language: str | None, text: str | None) -> Failure | None:
    """The failure of a text, or None if it is valid."""
    if language is None or not text:
        return None
    one = checker(language)
    failure = one.check(text)
    if len(one.grammar.nodes) > MOST_NODES:  # kept derivatives are a cache; a worker starts anew
        checker.cache_clear()
    return failure


#: Nodes of a language's kept derivatives, beyond which they are dropped after a file; bounds a worker's memory.
MOST_NODES = 1_000_000
_VERDICT = "valid boolean, line int, token string, truncated boolean"


def file_verdicts(df: DataFrame, key: str = "file_id", path: str = "file_path", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, *keep, language, valid, line, token, truncated)``, each once: copies of a row are dropped by their
    verdicts, so that no text is shuffled."""
    rows = df.select(key, path, content, *keep)
    schema = rows.select(key, *keep).schema
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = x[[key, *keep]].copy()
            out["language"] = [language_of(p) for p in x[path]]
            found = [None if t is None else check(k, t) for k, t in zip(out["language"], x[content], strict=True)]
            out["valid"] = [None if t is None else f is None for f, t in zip(found, x[content], strict=True)]
            out["line"] = pd.array([f.line if f else None for f in found], "Int32")
            out["token"] = [f.token if f else None for f in found]
            out["truncated"] = [f.truncated if f else None for f in found]
            yield out

    return rows.mapInPandas(run, f"{names}, language string, {_VERDICT}").distinct()


def failure_rates(verdicts: DataFrame) -> DataFrame:
    """Files, failures and their share per repository and language."""
    return verdicts.filter("valid is not null").groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum((~F.col("valid")).cast("int")).alias("failed")).withColumn("rate", F.round(F.col("failed") / F.col("files"), 6))

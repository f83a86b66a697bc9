"""Several values packed in one field, by delimiter skeletons.

Every field is cut into tokens (a run of ordinary characters, a run of spaces, or one delimiter), and its
*skeleton* has one character per token: ``w``, a space, or the delimiter itself. How a field splits depends on the
skeleton only, so the rules are resolved once per distinct skeleton, broadcast if there are few enough of them (else
joined by salted keys), and applied to the tokens by position.

Cutting runs in Arrow batches: the classes of wide separators and spaces cost the regular expressions of the JVM a
chain of tests per character (on 60,000 rows 5.4 s in the JVM at best, 2.4 s here).

Defined results: null, blank and separator-only fields give no rows; empty pieces take no position; repeated values
stay; an unclosed quote is an ordinary character; exact copies of a row count once; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded_broadcast, salted_join

#: Separators between values.
SEPARATORS = ",;|\uff0c\uff1b\u3001\uff5c\u00a6\u2022\u2023\u25aa\u25cf\u25e6\u2219"
#: Spaces that belong to no value (line ends and tabs separate).
SPACES = " \u00a0\u1680\u2000-\u200b\u202f\u205f\u2060\u3000\ufeff"
CONTROL = "\u0000-\u001f\u007f-\u009f\u2028\u2029"
#: Stand for a slash and a middle dot between spaces while a field is cut.
SLASH, DOT = "\ue000", "\ue001"

_MARKS = f'{SEPARATORS}{SLASH}{DOT}"'
_PLAIN = re.compile(f'[^{_MARKS}{SPACES}{CONTROL}]+(?:[{SPACES}]+[^{_MARKS}{SPACES}{CONTROL}]+)*|[{SPACES}]+|[{_MARKS}{CONTROL}]')
_CHAR = f"(?:[^,\\[\\]\"'\\\\{SPACES}{CONTROL}]|\\\\[\\s\\S])"
_LITERAL = re.compile(f"{_CHAR}+(?:[{SPACES}]+{_CHAR}+)*|[{SPACES}]+|[,\\[\\]\"'{CONTROL}\\\\]")
_IS_MARK = re.compile(f"[{_MARKS}{CONTROL}]")
_IS_LITERAL_MARK = re.compile(f"[,\\[\\]\"'{CONTROL}\\\\]")
_NUMBER = re.compile("[-+]?[0-9]+(?:[.][0-9]+)?")
_EDGES = re.compile(f"^[{SPACES}{CONTROL}]+|[{SPACES}{CONTROL}]+$")
_ENDS = re.compile(f"^[{SPACES}]+|[{SPACES}]+$")
_SPACED_SLASH, _SPACED_DOT = re.compile(f"(?<=[{SPACES}])/(?=[{SPACES}])"), re.compile(f"(?<=[{SPACES}])\u00b7(?=[{SPACES}])")
_BACK = {ord(SLASH): "/", ord(DOT): "\u00b7"}
_ELEMENT = r"""(?:"[^"]*"|'[^']*'|0)\s*"""
#: A literal's skeleton: quoted strings and numbers between commas.
_LIST = re.compile(rf"\[\s*(?:{_ELEMENT}(?:,\s*{_ELEMENT})*,?\s*)?\]")


class _Kinds(dict):
    """What stands for a token in a skeleton, by its first character; words are not kept one by one."""

    def __init__(self, mark: re.Pattern[str]) -> None:
        self.mark = mark

    def __missing__(self, first: str) -> str:
        out = self[first] = first if self.mark.match(first) else " " if _ENDS.match(first) else "w"
        return out


_PLAIN_KINDS, _LITERAL_KINDS = _Kinds(_IS_MARK), _Kinds(_IS_LITERAL_MARK)


def cut(text: str) -> tuple[str, list[str]]:
    """(skeleton, tokens) of a field; nothing for one of separators' spaces only."""
    if "/" in text or "\u00b7" in text:
        text = _SPACED_DOT.sub(DOT, _SPACED_SLASH.sub(SLASH, text))
    text = _EDGES.sub("", text)
    if text.startswith("["):
        tokens = _LITERAL.findall(text)
        kinds = [_LITERAL_KINDS[t[0]] if t[0] != "\\" or len(t) == 1 else "w" for t in tokens]
        shape = "".join("0" if k == "w" and _NUMBER.fullmatch(t) else k for k, t in zip(kinds, tokens, strict=True))
        if _LIST.fullmatch(shape):
            return shape, tokens
    tokens = _PLAIN.findall(text)
    return "".join([_PLAIN_KINDS[t[0]] for t in tokens]), tokens


def _literal(s: str) -> list[tuple[int, int, str]]:
    spans, i = [], 1
    while i < len(s) - 1:
        if s[i] in "\"'":
            j = s.index(s[i], i + 1)
            spans.append((i + 1, j, s[i]))
            i = j
        elif s[i] == "0":
            spans.append((i, i + 1, "0"))
        i += 1
    return [x for x in spans if any(c != " " and ord(c) >= 32 for c in s[x[0] : x[1]])]


def resolve(skeleton: str) -> list[tuple[int, int, str]]:
    """The (first token, end token, quoting) of each value; quoting is ``"`` or ``'`` for elements of list
    literals, ``q`` for a quoted value, ``0`` for a bare one. Only a list literal's skeleton starts with ``[``."""
    if skeleton.startswith("["):
        return _literal(skeleton)
    out, i, n = [], 0, len(skeleton)
    while i < n:
        while i < n and skeleton[i] == " ":
            i += 1
        if i < n and skeleton[i] == '"':
            j = i + 1
            while j < n and (skeleton[j] != '"' or skeleton[j + 1 : j + 2] == '"'):
                j += 1 + (skeleton[j] == '"')
            k = j + 1
            while k < n and skeleton[k] == " ":
                k += 1
            if j < n and (k >= n or skeleton[k] not in 'w"'):
                if any(c != " " and ord(c) >= 32 for c in skeleton[i + 1 : j]):
                    out.append((i + 1, j, "q"))
                i = k + 1
                continue
        j = i
        while j < n and skeleton[j] in 'w "':
            j += 1
        if any(c in 'w"' for c in skeleton[i:j]):
            out.append((i, j, "0"))
        i = j + 1
    return out


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        yield x.assign(rules=[[{"a": a, "b": b, "q": q} for a, b, q in resolve(s)] for s in x["skeleton"]])


def _value(tokens: list[str], a: int, b: int, quoting: str) -> str:
    """Text of the tokens from a to b."""
    raw = tokens[a] if b == a + 1 else "".join(tokens[a:b])
    if quoting == "q":
        raw = raw.replace('""', '"')
    elif quoting in "\"'" and "\\" in raw:
        body = re.sub(r"\\x([0-9a-fA-F]{2})", r"\\u00\1", raw.replace("\\'", "'"))
        if quoting == "'":
            body = re.sub(r'(?<!\\)"', r'\\"', body)
        try:
            raw = json.loads(f'"{body}"', strict=False)
        except ValueError:
            pass
    if SLASH in raw or DOT in raw:
        raw = raw.translate(_BACK)
    return _ENDS.sub("", raw)


def _skeletons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        yield pd.DataFrame({"skeleton": np.array(list({s for s in (cut(t)[0] for f in x for t in x[f] if t) if s}), object)})


#: Most bytes of rules that are broadcast.
RULE_BYTES = 16 << 20


def split_packed(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row ``(key, field, pos, item)`` per value of the packed ``fields``."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), *(F.col(f).cast("string").alias(f"_{n}") for n, f in enumerate(fields))).distinct()
    shapes = rows.drop("_key").mapInPandas(_skeletons, "skeleton string").distinct()
    rules, small = bounded_broadcast(shapes.mapInPandas(_rules, "skeleton string, rules array<struct<a:int,b:int,q:string>>"), size=F.length("skeleton") + 40 * F.size("rules"), most_bytes=RULE_BYTES)
    schema = f"_key {kind}, field string, pos int, item string"

    def put(out: list[list], k: object, field: str, tokens: list[str], spans: list) -> None:
        for pos, (a, b, q) in enumerate(spans):
            out[0].append(k)
            out[1].append(field)
            out[2].append(pos)
            out[3].append(_value(tokens, a, b, q))

    def frame(out: list[list], like: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"_key": pd.Series(out[0], dtype=like.dtype), "field": np.array(out[1], object), "pos": np.array(out[2], np.int32), "item": np.array(out[3], object)})

    if small:
        table = {r["skeleton"]: [(x["a"], x["b"], x["q"]) for x in r["rules"]] for r in rules.collect()}
        shared = df.sparkSession.sparkContext.broadcast(table)

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = shared.value
            for x in batches:
                out: list[list] = [[], [], [], []]
                for n, f in enumerate(fields):
                    for k, t in zip(x["_key"], x[f"_{n}"], strict=True):
                        if t:
                            skeleton, tokens = cut(t)
                            if skeleton:
                                put(out, k, f, tokens, known[skeleton])
                yield frame(out, x["_key"])

        return rows.mapInPandas(apply, schema).withColumnRenamed("_key", key)

    def tokens_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = [(k, f, *cut(t)) for n, f in enumerate(fields) for k, t in zip(x["_key"], x[f"_{n}"], strict=True) if t]
            yield pd.DataFrame([r for r in out if r[2]], columns=["_key", "field", "skeleton", "tokens"]).astype({"_key": x["_key"].dtype})

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out: list[list] = [[], [], [], []]
            for k, f, tokens, spans in zip(x["_key"], x["field"], x["tokens"], x["rules"], strict=True):
                put(out, k, f, list(tokens), [(r["a"], r["b"], r["q"]) for r in spans])
            yield frame(out, x["_key"])

    cuts = rows.mapInPandas(tokens_of, f"_key {kind}, field string, skeleton string, tokens array<string>")
    joined = salted_join(cuts, rules, ["skeleton"], "inner", by="_key").select("_key", "field", "tokens", "rules")
    return joined.mapInPandas(extract, schema).withColumnRenamed("_key", key)

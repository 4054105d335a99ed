"""Tokens of build files and headers, and the scans that read them: dependencies of module rules, annotation macros.

Each scan is a table function that goes through a file's tokens once, with its open brackets on a stack. It gives rows, or,
where the file can't be read, nothing but a row that says why; what is read but not understood is told beside the rows.
"""

from __future__ import annotations

import json
import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.validate import ValidationError

#: The dependency lists of module rules, the annotation macros, and limits.
VISIBILITY = {"PublicDependencyModuleNames": "public", "PrivateDependencyModuleNames": "private", "DynamicallyLoadedModuleNames": "dynamic"}
MACROS = ("UCLASS", "UFUNCTION", "UPROPERTY")
RULES_BYTES, HEADER_BYTES, MOST_ROWS, MOST_ARGUMENTS, AFTER = 2 << 20, 16 << 20, 100_000, 1024, 16_384
STRING = r"\"(?:\\.|[^\"\\])*\""
_TOKEN = r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>{strings})|(?P<char>'(?:\\.|[^'\\])*')|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<broken>/\*|{at}\"|')|(?P<other>\S)"
CSHARP = re.compile(_TOKEN.format(strings=rf"@\"(?:[^\"]|\"\")*\"(?!\")|{STRING}", at="@?"), re.S)
CPP = re.compile(_TOKEN.format(strings=STRING, at=""), re.S)
CLOSES = {")": "(", "]": "[", "}": "{"}
#: Forms of plain metadata and of declared names.
_PLAIN, _NAME = re.compile(r"[A-Za-z0-9_.:/ +-]{1,4096}"), r"[A-Za-z_][A-Za-z0-9_]*"
_CLASS, _FUNCTION = re.compile(rf"\b(?:class|struct)\s+((?:{_NAME}\s+)+)"), re.compile(rf"\b({_NAME})\s*\(")


class LexError(ValueError):
    """(code, line) of what makes a file unreadable."""


def line_at(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def cleaned(text: str | None, kind: re.Pattern, most: int) -> str:
    """``text`` with comments blanked. Lines and places stay; strings stay whole; one that never ends is an error."""
    if text is None or "\0" in text or len(text.encode("utf-8", "surrogatepass")) > most:
        raise LexError("SOURCE_OUT_OF_BOUNDS", 1)
    text = text.replace("\r\n", "\n")

    def keep(m):
        if m.lastgroup == "broken":
            raise LexError("UNTERMINATED_TOKEN", line_at(text, m.start()))
        return re.sub(r"[^\n]", " ", m[0]) if m.lastgroup == "comment" else m[0]

    return kind.sub(keep, text)


def _literal(token: str) -> str:
    return token[2:-1].replace('""', '"') if token.startswith("@") else json.loads(token, strict=False)


def condition(text: str) -> str | None:
    """A guard in the store's form; None for what it can't say."""
    text = " ".join(text.split())
    if not text or len(text) > 512 or re.search(r"[;{}\"']", text):
        return None
    for what, values in (("Platform", "UnrealTargetPlatform"), ("Configuration", "UnrealTargetConfiguration")):
        text = re.sub(rf"Target\.{what}\s*([=!]=)\s*{values}\.([A-Za-z][A-Za-z0-9_]*)", rf"{what.lower()} \1 \2", text)
    return text


def _dependencies(text: str | None):
    """(name, visibility, condition, diagnostic, line) rows of a module rules file; the first names the module."""
    code = cleaned(text, CSHARP, RULES_BYTES)
    module = re.search(r"\bclass\s+([A-Za-z][A-Za-z0-9_]*)\s*:\s*ModuleRules\b", code)
    if not module:
        raise LexError("NO_MODULE_RULES", 1)
    rows, stack, recent, guard = [(module[1], None, None, None, line_at(code, module.start()))], [], deque(maxlen=3), None
    for m in CSHARP.finditer(code):
        kind, token = m.lastgroup, m[0]
        if kind == "open":
            told = None  # a call: [visibility, line, names]; a guard: its place; a guarded block: the guard
            if token == "(" and len(recent) == 3 and recent[0] in VISIBILITY and recent[1] == "." and recent[2] in ("Add", "AddRange"):
                told = ["call", VISIBILITY[recent[0]], line_at(code, list_at), 0]
            elif token == "(" and recent and recent[-1] == "if":
                told = ["if", m.end(), line_at(code, m.start())]
            elif token == "{" and guard:
                told = ["guarded", guard[0] or "unsupported"]
                if guard[0] is None:
                    rows.append((None, None, None, "UNSUPPORTED_CONDITION_EXPRESSION", guard[1]))
            stack.append((token, told))
            guard = None
        elif kind == "close":
            guard = None
            if stack and stack[-1][0] == CLOSES[token]:
                _, told = stack.pop()
                if told and told[0] == "if":
                    guard = condition(code[told[1] : m.start()]), told[2]
                elif told and told[0] == "call" and not told[3]:
                    rows.append((None, None, None, "DYNAMIC_DEPENDENCY_EXPRESSION", told[2]))
        else:
            guard = None
            call = next((told for _, told in reversed(stack) if told and told[0] == "call"), None)
            if kind == "string" and call:
                name = _literal(token)
                if not re.fullmatch("[A-Za-z][A-Za-z0-9_]*", name):  # as the store names modules
                    raise LexError("INVALID_MODULE_NAME", line_at(code, m.start()))
                call[3] += 1
                guards = [f"({told[1]})" for _, told in stack if told and told[0] == "guarded"]
                rows.append((name, call[1], " && ".join(guards) or None, None, call[2]))
        if token in VISIBILITY:
            list_at = m.start()
        recent.append(token)
    if open_ := next((told for _, told in stack if told), None):
        raise LexError("UNBALANCED", open_[2] if open_[0] != "guarded" else line_at(code, len(code)))
    return rows


def _split(text: str) -> list[str]:
    """The arguments between commas that stand in no bracket or string."""
    parts, begin, depth = [], 0, 0
    for m in CPP.finditer(text + ","):
        depth += {"open": 1, "close": -1}.get(m.lastgroup, 0)
        if m[0] == "," and not depth:
            parts.append(text[begin : m.start()].strip())
            begin = m.end()
    if depth or len(parts) > MOST_ARGUMENTS:
        raise ValueError
    return [p for p in parts if p]


def _said(text: str) -> tuple[list[str], dict[str, str]]:
    """(specifiers, metadata) of a macro's arguments; keys of both kinds are specifiers."""
    keys, values = [], {}
    for argument in _split(text):
        meta = re.fullmatch(r"meta\s*=\s*\((.*)\)", argument, re.S)
        for one in _split(meta[1]) if meta else [argument]:
            key, equals, value = (x.strip() for x in one.partition("="))
            if not re.fullmatch(_NAME, key) or key in values and equals:
                raise ValueError
            if key not in keys:
                keys.append(key)
            if equals:
                values[key] = json.loads(value, strict=False) if value.startswith('"') else value
                if not value.startswith('"') and not _PLAIN.fullmatch(value):
                    raise ValueError
    return keys, values


def _declared(code: str, at: int, macro: str) -> tuple[str, int]:
    """(name, place) of the declaration after a macro: a class's last name, what a function's last call names, the last word before a value."""
    end = re.compile("[{:;]" if macro == "UCLASS" else "[;{]").search(code, at, at + AFTER)
    part = code[at : end.start() if end else at + AFTER]
    if macro == "UCLASS":
        names = _CLASS.search(part + " ")
        found = names and list(re.finditer(_NAME, names[1]))
        return found and (found[-1][0], at + names.start(1) + found[-1].start())
    found = list(_FUNCTION.finditer(part) if macro == "UFUNCTION" else re.finditer(rf"\b({_NAME})\b", part.partition("=")[0]))
    return found and (found[-1][1], at + found[-1].start(1))


def _annotations(text: str | None):
    """(macro, macro_line, declaration_line, symbol_name, specifiers, metadata) rows of a header."""
    code = cleaned(text, CPP, HEADER_BYTES)
    rows, stack, last = [], [], None  # open brackets, of a macro's with the macro; the last token
    for m in CPP.finditer(code):
        if m.lastgroup == "open":
            told = None
            if m[0] == "(" and last and last[0] in MACROS and not any(told for _, told in stack) and not code[code.rfind("\n", 0, last.start()) + 1 : last.start()].lstrip().startswith("#"):
                told = last, m.end()
            stack.append((m[0], told))
        elif m.lastgroup == "close" and stack and stack[-1][0] == CLOSES[m[0]]:
            _, told = stack.pop()
            if told:
                macro, line = told[0][0], line_at(code, told[0].start())
                try:
                    keys, values = _said(code[told[1] : m.start()])
                    target = _declared(code, m.end(), macro)
                except ValueError:
                    raise LexError("INVALID_ARGUMENTS", line) from None
                if not target:
                    raise LexError("NO_DECLARATION", line)
                rows.append((macro, line, line_at(code, target[1]), target[0], keys, values))
        last = m
    if open_ := next((told for _, told in stack if told), None):
        raise LexError("UNBALANCED", line_at(code, open_[0].start()))
    if len(rows) > MOST_ROWS:
        raise LexError("TOO_MANY_ANNOTATIONS", 1)
    return rows


@F.udtf(returnType="module string, name string, visibility string, condition string, diagnostic string, line int, readable boolean")
class Dependencies:
    """The dependencies and diagnostics of a file, each with its module; a file without dependencies has a row of its module alone."""

    def eval(self, text: str):
        try:
            (module, *_), *rows = _dependencies(text)
        except LexError as e:
            yield None, None, None, None, *e.args, False
            return
        if not any(row[1] for row in rows):
            yield module, None, None, None, None, None, True
        for row in rows:
            yield module, *row, True


@F.udtf(returnType="macro string, macro_line int, declaration_line int, symbol_name string, specifiers array<string>, metadata map<string,string>, diagnostic string, line int")
class Annotations:
    def eval(self, text: str):
        try:
            rows = _annotations(text)
        except LexError as e:
            yield None, None, None, None, None, None, *e.args
            return
        for row in rows:
            yield *row, None, None


def _scan(files: DataFrame, function, path: str, text: str) -> DataFrame:
    """The rows of a scan of each file."""
    return files.select(F.col(path).alias(path), F.col(text).alias("_text")).lateralJoin(function(F.col("_text").outer())).drop("_text")


def _refused(bad: DataFrame, path: str) -> None:
    """Raises with the first files that can't be read, and how many there are."""
    if found := bad.select(path, "diagnostic", "line").orderBy(path).limit(5).collect():
        raise ValidationError(f"{bad.count()} files can't be read: " + ", ".join(f"{r[path]} line {r['line']}: {r['diagnostic']}" for r in found))


def module_rules(files: DataFrame, path: str = "path", text: str = "text", strict: bool = False) -> DataFrame:
    """(path, module, name, visibility, condition, line): a row per dependency of a module rules file; one of nulls for none.

    ``strict`` raises for files that can't be read; else they have a row without a module. ``module_diagnostics`` says why.
    """
    rows = _scan(files, Dependencies, path, text)
    if strict:
        _refused(rows.where("not readable"), path)
    line = F.when(F.col("readable"), F.col("line")).alias("line")
    return rows.where("not readable or diagnostic is null").select(path, "module", "name", "visibility", "condition", line)


def module_diagnostics(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, diagnostic, line, readable): what the scan of module rules didn't understand, or why it gave up."""
    return _scan(files, Dependencies, path, text).where("diagnostic is not null").select(path, "diagnostic", "line", "readable")


def annotations(files: DataFrame, path: str = "path", text: str = "text", strict: bool = False) -> DataFrame:
    """A row per annotation macro of a header: what it says and the declaration that it stands at. ``strict`` raises for headers that can't be read."""
    rows = _scan(files, Annotations, path, text)
    if strict:
        _refused(rows.where("diagnostic is not null"), path)
    own = rows.where("diagnostic is null").drop("diagnostic", "line")
    return own.withColumn("annotation_id", F.sha2(F.concat_ws("\x1f", path, "macro", "macro_line", "symbol_name"), 256))


def annotation_diagnostics(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, diagnostic, line) of the headers that can't be read."""
    return _scan(files, Annotations, path, text).where("diagnostic is not null").select(path, "diagnostic", "line")

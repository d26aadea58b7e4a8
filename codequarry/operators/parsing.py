"""Definitions, docstrings, imports and calls of source files.

Plain functions from one file's bytes to rows, and ``parse_files``, which runs
them over a table of files in Arrow batches. Python is read with the standard
library's parser; a file it refuses is scanned by indentation. JavaScript and
TypeScript are read by a tokenizer and bracket matching.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas


@dataclass
class Definition:
    node_type: str
    name: str | None
    start_line: int
    end_line: int
    text: str
    class_name: str | None = None
    nested: bool = False
    docstring: str | None = None
    calls: list[str] = field(default_factory=list)


@dataclass
class Parsed:
    definitions: list[Definition]
    imports: list[str]
    parse_errors: bool
    line_count: int


# ---------------------------------------------------------------- Python


def clean_python_docstring(raw: str) -> str:
    """A string literal without its quotes; a triple-quoted one also without the indent common to all its lines. A literal with a prefix stays as it is."""
    for quote in ('"""', "'''"):
        if raw.startswith(quote) and raw.endswith(quote) and len(raw) >= 6:
            lines = raw[3:-3].split("\n")
            indent = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
            return "\n".join(x[indent:] for x in lines).strip()
    if len(raw) >= 2 and raw[0] == raw[-1] and raw[0] in "\"'":
        return raw[1:-1].strip()
    return raw


class _Calls(ast.NodeVisitor):
    def __init__(self) -> None:
        self.names: dict[str, None] = {}

    def visit_Call(self, node: ast.Call) -> None:
        name = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
        if name:
            self.names.setdefault(name)
        self.generic_visit(node)


def _python_tree(source: str, tree: ast.Module) -> list[Definition]:
    lines = source.split("\n")
    raw = [line.encode() for line in lines]
    found: list[Definition] = []

    def segment(start: int, column: int, end: int, end_column: int) -> str:
        if start == end:
            return raw[start - 1][column:end_column].decode(errors="replace")
        return b"\n".join([raw[start - 1][column:], *raw[start : end - 1], raw[end - 1][:end_column]]).decode(errors="replace")

    def walk(node: ast.AST, class_name: str | None, inside_function: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                walk(child, class_name, inside_function)
                continue
            first = min([child, *child.decorator_list], key=lambda n: n.lineno)
            column = child.col_offset if first is not child else first.col_offset
            calls = _Calls()
            calls.visit(child)
            is_class = isinstance(child, ast.ClassDef)
            opening = child.body[0]
            text = None
            if isinstance(opening, ast.Expr) and isinstance(opening.value, ast.Constant) and isinstance(opening.value.value, str):
                v = opening.value
                text = clean_python_docstring(segment(v.lineno, v.col_offset, v.end_lineno, v.end_col_offset))
            found.append(Definition("class_definition" if is_class else "function_definition", child.name, first.lineno, child.end_lineno, segment(first.lineno, column, child.end_lineno, child.end_col_offset), class_name, inside_function, text, list(calls.names)))
            walk(child, child.name if is_class else None, inside_function or not is_class)

    walk(tree, None, False)
    return found


_DEF = re.compile(r"^(\s*)(?:async\s+def|def|class)\s+(\w+)")


def _python_by_indent(source: str) -> list[Definition]:
    """Definitions of a file with syntax errors: a block ends before the next line that is indented no deeper."""
    lines = source.split("\n")
    found, open_ = [], []
    for at, line in enumerate(lines):
        depth = len(line) - len(line.lstrip())
        if not (m := _DEF.match(line)):
            continue
        end = next((k for k in range(at + 1, len(lines)) if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) <= depth and not lines[k].lstrip().startswith(")")), len(lines))
        while end > at + 1 and not lines[end - 1].strip():
            end -= 1
        open_ = [o for o in open_ if o[0] < depth and o[3] > at]
        is_class = line.lstrip().startswith("class")
        owner = open_[-1] if open_ else None
        text = "\n".join([line[depth:], *lines[at + 1 : end]])
        calls = dict.fromkeys(n for n in re.findall(r"(\w+)\s*\(", text) if n not in ("def", "if", "while", "for", "return", "and", "or", "not", "in", m[2]))
        found.append(Definition("class_definition" if is_class else "function_definition", m[2], at + 1, end, text, owner[1] if owner and owner[2] else None, any(not o[2] for o in open_), None, list(calls)))
        open_.append((depth, m[2], is_class, end))
    return found


def parse_python(source: str) -> Parsed:
    lines = source.split("\n")
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        imports = [x.strip() for x in lines if re.match(r"(import|from)\s", x)]
        return Parsed(_python_by_indent(source), imports, True, len(lines))
    imports = ["\n".join(lines[n.lineno - 1 : n.end_lineno]).strip() for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))]
    return Parsed(_python_tree(source, tree), imports, False, len(lines))


# ---------------------------------------------------------------- JavaScript, TypeScript

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<word>[A-Za-z_$\u0080-￿][\w$]*)|(?P<number>\d[\w.]*)|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<sign>=>|\?\.|\.\.\.|[{}()\[\];,.:?=<>+\-*/%&|^!~@#`\\])""",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_BEFORE_REGEX = set("( , = : [ ! & | ? { } ; + - * % < > ~ ^ =>".split()) | {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}
_NOT_CALLED = set("if for while switch catch function return typeof instanceof await yield delete void throw super import with new else do in of".split())
_NOT_METHODS = set("if for while switch catch with function".split())
_CLOSING = {"(": ")", "[": "]", "{": "}"}


def _tokens(source: str) -> tuple[list[tuple[str, str, int, int]], bool]:
    """(kind, text, start, end) of every token; whether all was understood. A template literal is a string for each of its plain parts, with the tokens of ``${...}`` between braces."""
    out: list[tuple[str, str, int, int]] = []
    at, sound = 0, True
    braces: list[int] = []  # open braces within each ``${`` that is open

    def template(begin: int, inside: int) -> int:
        """Take the plain part of a template that begins at ``begin``; where the tokens go on after it."""
        nonlocal sound
        end = inside
        while end < len(source) and source[end] != "`" and not source.startswith("${", end):
            end += 2 if source[end] == "\\" else 1
        if end >= len(source):
            sound = False
            out.append(("string", "`", begin, len(source)))
            return len(source)
        if source[end] == "`":
            out.append(("string", "`", begin, end + 1))
            return end + 1
        out.append(("string", "`", begin, end + 1))
        out.append(("sign", "{", end + 1, end + 2))
        braces.append(0)
        return end + 2

    while at < len(source):
        if source[at] == "`":
            at = template(at, at + 1)
        elif source[at] == "}" and braces and not braces[-1]:
            braces.pop()
            out.append(("sign", "}", at, at + 1))
            at = template(at + 1, at + 1)
        elif source[at] == "/" and (not out or out[-1][1] in _BEFORE_REGEX) and (m := _REGEX.match(source, at)):
            out.append(("string", "/", at, m.end()))
            at = m.end()
        elif not (m := _TOKEN.match(source, at)):
            sound, at = False, at + 1
        else:
            if m.lastgroup != "skip":
                out.append((m.lastgroup, m[0], at, m.end()))
                if braces and m[0] in "{}":
                    braces[-1] += 1 if m[0] == "{" else -1
            at = m.end()
    return out, sound and not braces


def _pairs(tokens) -> tuple[dict[int, int], bool]:
    """The closing token's number for each opening one; whether all are matched."""
    pair, stack, sound = {}, [], True
    for k, (kind, text, _, _) in enumerate(tokens):
        if kind == "sign" and text in _CLOSING:
            stack.append(k)
        elif kind == "sign" and text in _CLOSING.values():
            if stack and _CLOSING[tokens[stack[-1]][1]] == text:
                pair[stack.pop()] = k
            else:
                sound = False
    return pair, sound and not stack


def _jsdoc(lines: list[str], start_line: int) -> str | None:
    """The block comment that ends on the line before start_line, without its markers."""
    last = start_line - 2
    if last < 0 or not lines[last].strip().endswith("*/"):
        return None
    first = next((k for k in range(last, -1, -1) if "/*" in lines[k]), None)
    if first is None:
        return None
    kept = [x.strip() for x in lines[first : last + 1] if x.strip() not in ("/**", "/*", "*/")]
    kept = [re.sub(r"^\* ?", "", x) for x in kept]
    return "\n".join(kept).strip() or None


def parse_javascript(source: str, typed: bool = False) -> Parsed:
    """``typed``: parameter lists may be followed by return types, as in TypeScript."""
    tokens, understood = _tokens(source)
    pair, matched = _pairs(tokens)
    text = [t[1] for t in tokens]
    kinds = [t[0] for t in tokens]
    opening = {v: k for k, v in pair.items()}
    n = len(tokens)
    lines = source.split("\n")
    breaks = [k for k, c in enumerate(source) if c == "\n"]
    line_of = lambda at: bisect_left(breaks, at) + 1
    spans: list[tuple[int, int, str, str | None]] = []  # first and last token, kind, name
    names: set[int] = set()  # tokens that name a definition

    def block_after(k: int) -> int | None:
        """The closing token of the body that follows a parameter list ending before token k; a return type may stand between."""
        angles = 0
        while k < n and text[k] not in ("{", ";", "=>", ")", "}") and (angles or text[k] != ","):
            angles = max(0, angles + (text[k] == "<") - (text[k] == ">"))
            k = pair.get(k, k) + 1
        return pair.get(k) if k < n and text[k] == "{" else None

    def after_types(k: int) -> int:
        """The token after type parameters in ``<`` and ``>`` that may begin at token k."""
        angles, j = 0, k
        while j < n and (text[j] == "<" or angles):
            angles += (text[j] == "<") - (text[j] == ">")
            j = pair.get(j, j) + 1
        return j

    def before_return_type(k: int) -> int:
        """The token before a return type that ends at token k, or k if there is none."""
        for j in range(k, 0, -1):
            if text[j] == ":":
                return j - 1 if text[j - 1] == ")" else k
            if kinds[j] == "sign" and text[j] not in ("<", ">", "[", "]", "|", "&", ".", ","):
                return k
        return k

    def expression_end(k: int) -> int:
        """The last token of the expression that begins at token k."""
        while k < n:
            if k in pair:
                k = pair[k]
            following = k + 1
            if following >= n or text[following] in (",", ";", ")", "]", "}"):
                return min(k, n - 1)
            if "\n" in source[tokens[k][3] : tokens[following][2]] and kinds[following] in ("word", "string") and kinds[k] != "sign":
                return k
            if "\n" in source[tokens[k][3] : tokens[following][2]] and text[k] in (")", "]", "}") and kinds[following] == "word":
                return k
            k = following
        return n - 1

    class_bodies: set[int] = set()
    for k in range(n):
        if kinds[k] != "word" and text[k] != "=>":
            continue
        if text[k] == "class" and (k == 0 or text[k - 1] != ".") and k + 1 < n and kinds[k + 1] == "word":
            body = next((j for j in range(k + 1, n) if text[j] == "{"), None)
            if body in pair and text[k + 1] != "extends":
                class_bodies.add(body)
                if k == 0 or text[k - 1] in (";", "}", "{", "default", "export", "abstract") or "\n" in source[tokens[k - 1][3] : tokens[k][2]]:
                    spans.append((k, pair[body], "class_definition", text[k + 1]))
                    names.add(k + 1)
        elif text[k] == "function" and (k == 0 or text[k - 1] != "."):
            star = k + 1 < n and text[k + 1] == "*"
            at = k + 1 + star
            name = text[at] if at < n and kinds[at] == "word" else None
            if name:
                names.add(at)
            params = after_types(at + 1 if name else at)
            end = block_after(pair[params] + 1) if params < n and text[params] == "(" and params in pair else None
            if end is None:
                continue
            first = k - 1 if k and text[k - 1] == "async" else k
            stands = first == 0 or text[first - 1] in (";", "}", "{", "export", "default", ")") or "\n" in source[tokens[first - 1][3] : tokens[first][2]] and text[first - 1] not in ("=", "(", ",", ":", "?", "=>", "return")
            kind = ("generator_function_declaration" if star else "function_declaration") if stands and name else "function_expression"
            spans.append((first, end, kind, name))
        elif text[k] == "=>" and k:
            head = before_return_type(k - 1) if typed else k - 1
            first, name = head, None
            if text[head] == ")" and head in opening:
                first = opening[head]
            elif kinds[head] == "word":
                name = text[head]
            if first and text[first - 1] == "async":
                first -= 1
            if k + 1 < n:
                spans.append((first, pair[k + 1] if text[k + 1] == "{" and k + 1 in pair else expression_end(k + 1), "arrow_function", name))
    owner = sorted((b, e) for b, e in pair.items() if text[b] == "{")
    starts = [b for b, _ in owner]
    for k in range(n - 1):
        if kinds[k] not in ("word", "string") or text[k + 1] != "(" or k + 1 not in pair or text[k] in _NOT_METHODS or k in names:
            continue
        end = block_after(pair[k + 1] + 1)
        if end is None or k and text[k - 1] in (".", "new", "function", "?."):
            continue
        at = bisect_right(starts, k) - 1
        while at >= 0 and owner[at][1] < k:
            at -= 1
        body = owner[at][0] if at >= 0 else -1
        object_body = body > 0 and text[body - 1] in ("=", "(", ",", ":", "return", "[", "default") and text[k - 1] in ("{", ",", "async", "get", "set", "*")
        if body in class_bodies or object_body:
            first = k
            while first - 1 > body and text[first - 1] in ("async", "static", "get", "set", "*", "public", "private", "protected", "readonly", "override"):
                first -= 1
            spans.append((first, end, "method_definition", text[k].strip("\"'")))
            names.add(k)

    called = [k for k in range(n - 1) if kinds[k] == "word" and text[k + 1] == "(" and k not in names and text[k] not in _NOT_CALLED]
    called += [k + 1 for k in range(n - 1) if text[k] == "new" and kinds[k + 1] == "word" and k + 2 < n and text[k + 2] != "("]
    called.sort()
    spans.sort(key=lambda s: (s[0], -s[1]))
    found, stack = [], []
    for first, last, kind, name in spans:
        while stack and stack[-1][1] < first:
            stack.pop()
        outer = stack[-1] if stack else None
        a, b = tokens[first][2], tokens[last][3]
        calls = dict.fromkeys(text[k] for k in called[bisect_left(called, first) : bisect_right(called, last)])
        start = line_of(a)
        found.append(Definition(kind, name, start, line_of(b - 1), source[a:b], outer[3] if outer and outer[2] == "class_definition" else None, any(s[2] != "class_definition" for s in stack), _jsdoc(lines, start), list(calls)))
        stack.append((first, last, kind, name))
    imports, depth = [], 0
    for k in range(n):
        depth += (text[k] in _CLOSING) - (text[k] in _CLOSING.values())
        if text[k] == "import" and depth == 0 and (k == 0 or text[k - 1] != ".") and k + 1 < n and text[k + 1] not in ("(", "."):
            end = next((j for j in range(k + 1, n) if kinds[j] == "string"), None)
            if end is not None:
                stop = end + 1 if end + 1 < n and text[end + 1] == ";" else end
                imports.append(source[tokens[k][2] : tokens[stop][3]])
    return Parsed(found, imports, not (understood and matched), len(lines))


def parse_typescript(source: str) -> Parsed:
    return parse_javascript(source, typed=True)


#: Extractors by language; register a function from text to Parsed to add one.
EXTRACTORS: dict[str, Callable[[str], Parsed]] = {"python": parse_python, "javascript": parse_javascript, "js": parse_javascript, "typescript": parse_typescript, "tsx": parse_typescript}


def extractor(language: str) -> Callable[[str], Parsed]:
    """The extractor of a language; ValueError if there is none."""
    if language.lower() not in EXTRACTORS:
        raise ValueError(f"no parser for {language!r}; there are {', '.join(sorted(EXTRACTORS))}")
    return EXTRACTORS[language.lower()]


def register_extractor(language: str, function: Callable[[str], Parsed]) -> None:
    EXTRACTORS[language] = function


# ---------------------------------------------------------------- rows


def count_tokens(text: str) -> int:
    return max(1, (len(text) + 3) // 4)


def make_chunk_id(path: str, node_type: str, line: int, name: str | None) -> str:
    return hashlib.sha256(f"{path}|{node_type}|{line}|{name or ''}".encode()).hexdigest()[:16]


def split_lines(text: str, max_tokens: int, overlap_tokens: int) -> list[tuple[str, int]]:
    """(slice, number of its first line): runs of lines within the budget, each going back into the one before by at least the overlap. A line over the budget is a slice of its own. Every slice begins after the one before."""
    lines = text.split("\n")
    total = [0]
    for line in lines:
        total.append(total[-1] + count_tokens(line + "\n"))
    if total[-1] <= max_tokens:
        return [(text, 0)]
    out, start = [], 0
    while True:
        end = max(start + 1, bisect_right(total, total[start] + max_tokens) - 1)
        out.append(("\n".join(lines[start:end]), start))
        if end >= len(lines):
            return out
        back = bisect_right(total, total[end] - overlap_tokens) - 1 if overlap_tokens > 0 else end
        start = max(start + 1, min(back, end))


def chunk_rows(path: str, language: str, content: bytes, max_tokens: int = 512, overlap_tokens: int = 64, include_nested: bool = True) -> list[dict]:
    """The chunks of one file as rows of ``schemas.PARSED``, by start line. Content that isn't UTF-8 is decoded with replacements. Unknown languages give none."""
    if language not in EXTRACTORS:
        return []
    parsed = EXTRACTORS[language](content.decode(errors="replace"))
    rows = []
    for d in parsed.definitions:
        if d.nested and not include_nested:
            continue
        local = [x.strip() for x in d.text.split("\n") if x.strip().startswith(("import ", "from "))] if language == "python" else []
        base = {
            "file_path": path, "language": language, "node_type": d.node_type, "function_name": d.name, "class_name": d.class_name, "docstring": d.docstring, "has_docstring": d.docstring is not None,
            "imports": list(dict.fromkeys([*parsed.imports, *local])), "calls": d.calls, "nested": d.nested, "parse_errors": parsed.parse_errors, "line_count": parsed.line_count, "error": None,
        }
        parts = split_lines(d.text, max_tokens, overlap_tokens) if count_tokens(d.text) > max_tokens else [(d.text, 0)]
        for k, (text, offset) in enumerate(parts):
            many = len(parts) > 1
            start = d.start_line + offset
            rows.append(base | {
                "chunk_id": make_chunk_id(path, d.node_type, start, d.name), "start_line": start, "end_line": start + text.count("\n") if many else d.end_line, "raw_code": text, "token_count": count_tokens(text),
                "is_split_chunk": many, "split_index": k if many else None, "total_splits": len(parts) if many else None,
            })
    return sorted(rows, key=lambda r: r["start_line"])


def parse_files(files: DataFrame, max_tokens: int = 512, overlap_tokens: int = 64, include_nested: bool = True) -> DataFrame:
    """Chunks (``schemas.PARSED``) of files (file_path, language, content).

    A file that fails gives one row with ``error`` and no chunk_id; the others
    go on. Files of unknown language, or without content, give none.
    """
    columns = [c.split()[0] for c in schemas.PARSED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for path, language, content in zip(batch["file_path"], batch["language"], batch["content"], strict=True):
                try:
                    rows += chunk_rows(path, language, bytes(content), max_tokens, overlap_tokens, include_nested) if content is not None and language else []
                except Exception as e:  # one file's failure must not end the run
                    rows.append({"file_path": path, "language": language, "error": f"{type(e).__name__}: {e}"})
            frame = pd.DataFrame(rows, columns=columns)
            whole = ["start_line", "end_line", "split_index", "total_splits", "token_count", "line_count"]
            flags = ["has_docstring", "is_split_chunk", "nested", "parse_errors"]
            yield frame.astype(dict.fromkeys(whole, "Int32") | dict.fromkeys(flags, "boolean"))

    wanted = files.filter(F.col("language").isin(*EXTRACTORS)).select("file_path", "language", "content")
    return wanted.mapInPandas(run, schemas.PARSED)



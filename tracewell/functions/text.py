"""Scalar text functions of the engine.

Column functions are built-in expressions. The bracket-aware ones need a stack, so they are plain Python;
vec_... at the end of the module are the same over columns, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per unit of textual durations, and the languages whose bare sleeps are milliseconds.
UNIT_SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "sec": 1.0, "second": 1.0, "m": 60.0, "min": 60.0, "minute": 60.0, "h": 3600.0, "hour": 3600.0, "d": 86400.0, "day": 86400.0}
MILLISECOND_LANGS = ("javascript", "typescript", "java")
FAMILIES = {"typescript": "javascript", "tsx": "javascript", "cpp": "c", "kotlin": "jvm", "scala": "jvm", "java": "jvm"}
EXTENSIONS = {".rs": "rust", ".py": "python", ".js": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp"}


def _case(c: Column, table: dict, other: Column) -> Column:
    out = other
    for k, v in reversed(table.items()):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def family(lang: Column) -> Column:
    """join.family"""
    return _case(lang, FAMILIES, lang)


def language_of(path: Column) -> Column:
    """src.lang_dispatch: by the lower-case extension; null where none is known."""
    return _case(F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)), EXTENSIONS, F.lit(None).cast("string"))


def norm_qualname(q: Column) -> Column:
    """fn.norm_qual: every separator is a dot, a trailing argument list goes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(q, r"\(.*\)$", ""), r"::|[#/$\\]", "."), r"\.{2,}", ".")


def canon(path: Column, imports: Column) -> Column:
    """fn.canon: the first segment is replaced by what it is imported as."""
    head, rest = F.substring_index(path, ".", 1), F.regexp_extract(path, r"^[^.]*(\..*)?$", 1)
    return F.concat(F.coalesce(F.try_element_at(imports, head), head), rest)


def default_module(rel: Column, file_is_module: Column) -> Column:
    """fn.default_module: folders, then the file's stem unless it is a package's own file."""
    parts = F.split(F.regexp_replace(rel, r"\.[^./]+$", ""), "/")
    n = F.size(parts)
    own = F.element_at(parts, -1)
    return F.when(file_is_module & ~own.isin("__init__", "mod", "lib", "main", "index"), parts).otherwise(F.slice(parts, 1, n - 1))


def rust_module(rel: Column, root: Column) -> Column:
    """fn.rust_module: crate root, then the path below src."""
    inner = F.regexp_replace(F.regexp_replace(rel, r"^.*?src/", ""), r"(/?(mod|lib|main))?\.rs$", "")
    return F.when(inner == "", F.array(root)).otherwise(F.concat(F.array(root), F.split(inner, "/")))


def parse_default(text: Column) -> Column:
    """fn.parse_default: the seconds that a default's text begins with, in ms, s or min."""
    return duration(F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?\s*(?:ms|s|min))\b", 1))


def duration(text: Column) -> Column:
    """Seconds of a literal such as `1.5s`, `200 ms` or `2min`; null if there is none."""
    n = F.try_to_number(F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("999999999.999999")).cast("double")
    unit = F.regexp_replace(F.lower(F.regexp_extract(text, r"^\s*[0-9.]+\s*([a-zA-Zµ]+)", 1)), "(?<=..)s$", "")
    return n * _case(unit, UNIT_SECONDS, F.lit(None).cast("double"))


def format_seconds(s: Column) -> Column:
    """fn.fmt: 120 ms, 2 s, 2.0 min, unbounded."""
    short = lambda x: F.regexp_replace(F.format_string("%.3f", x), r"\.?0+$", "")
    return F.when(s == float("inf"), "unbounded").when(s < 1, F.concat(F.format_string("%.0f", s * 1000), F.lit(" ms"))).when(s < 60, F.concat(short(s), F.lit(" s"))).otherwise(F.concat(F.format_string("%.1f", s / 60), F.lit(" min")))


def format_trace(s: Column) -> Column:
    """fn.fmt_trace: the shorter form used in evidence."""
    return F.when(s >= 1, F.format_string("%.2f s", s)).otherwise(F.format_string("%.0f ms", s * 1000))


def uri_path(uri: Column) -> Column:
    """fn.uri_path: file URIs lose their scheme, %xx is decoded, a plus sign stays."""
    bare = F.regexp_replace(uri, "^file://(localhost)?", "")
    return F.url_decode(F.regexp_replace(bare, r"\+", "%2B"))


def otlp_id(v: Column) -> Column:
    """src.otlp_id: hexadecimal as it is, base64 as hexadecimal."""
    return F.when(v.rlike("^[0-9a-fA-F]+$") & F.length(v).isin(16, 32), F.lower(v)).otherwise(F.lower(F.hex(F.unbase64(v))))


def test_name(function: Column) -> Column:
    """fn.test_name"""
    return F.concat(F.lit("test_"), F.trim(F.regexp_replace(F.lower(function), "[^a-z0-9]+", "_"), F.lit("_")))


def line_of(source: Column, offset: Column) -> Column:
    """fn.line_of: 1-based line of a character offset."""
    return F.size(F.split(F.substring(source, F.lit(1), offset), "\n", -1))


def sql_values(line: Column) -> Column:
    """fn.sql_values: a query text with an interpolated value that is no placeholder, column or table name."""
    names = F.regexp_extract_all(line, F.lit(r"\{([a-zA-Z_][a-zA-Z0-9_.]*)"), 1)
    return F.lower(line).rlike(r"\b(select|insert|update|delete)\b") & F.exists(names, lambda x: ~F.lower(x).rlike("placeholder|column|table|field|where|order|limit"))


def excerpt(source: Column, line: Column, around: int = 20) -> Column:
    """proj.excerpt: numbered lines around a line, forty at most."""
    lines = F.split(source, "\n", -1)
    first = F.greatest(line - around, F.lit(1))
    return F.array_join(F.transform(F.slice(lines, first, 2 * around), lambda x, i: F.concat(F.lpad((i + first).cast("string"), 5, " "), F.lit("  "), x)), "\n")


def dependency(path: Column) -> Column:
    """pred.dep_dir: vendored code never maps by a path's end."""
    return path.rlike(r"(^|/)(node_modules|site-packages|dist-packages|vendor|third_party|\.cargo)(/|$)")


def signature(source: Column, line: Column, body_line: Column) -> Column:
    """proj.signature: the header lines of a function, before its body."""
    return F.trim(F.regexp_replace(F.array_join(F.slice(F.split(source, "\n", -1), line, F.greatest(body_line - line, F.lit(1))), " "), r"\s+", " "))


def constant(name: Column, values: Column) -> Column:
    """fn.constant: a dotted name's value, by its last segment."""
    return F.try_element_at(values, F.substring_index(name, ".", -1))


# The words in a loop's text that tell what it does, for loop_flags.
LOOP_WORDS = {
    "handles_errors": r"\bexcept\b|\bcatch\b|\.is_err\(|if err != nil|\bErr\(",
    "sleeps": r"\b(sleep|delay|backoff|wait_for|setTimeout)\w*\s*\(",
    "exponential": r"\*\*|\*=\s*2|<<\s*\w|\bpow\(|expo",
    "exits": r"\bbreak\b|\breturn\b|\braise\b|\bthrow\b",
    "retryish": r"(?i)retr(y|ies)|attempt|tries",
    "wall_bound": r"(?i)deadline|elapsed|time\.time\(\)|monotonic\(\)|Instant::now|timeout",
}


def loop_flags(body: Column) -> Column:
    """fn.loop_info: the flags of a loop's text, as a struct."""
    return F.struct(*[body.rlike(p).alias(k) for k, p in LOOP_WORDS.items()])


def retry_like(flags: Column) -> Column:
    """pred.retry_like on loop_flags."""
    return flags["handles_errors"] & (flags["retryish"] | flags["sleeps"]) & flags["exits"]


def guard_reason(command: Column) -> Column:
    """pred.guard: why a command is refused; null if it is not."""
    return (
        F.when(command.rlike(r"\brm\s+-[a-z]*r[a-z]*f|\bgit\s+push\s+.*--force|\bdrop\s+(table|database)\b|\bmkfs\b"), "destructive")
        .when(command.rlike(r"(?i)\bprod(uction)?\b.*\.(com|net|io)\b|https?://(?!localhost|127\.0\.0\.1)[a-z0-9.-]*prod"), "live host")
        .when(command.rlike(r"(?i)(\.env\b|id_rsa|credentials\.json|aws_secret)"), "secret")
    )


# -- bracket-aware helpers -----------------------------------------------------------------------------------------------

_OPEN, _CLOSE = "([{<", ")]}>"


def split_top(s: str, sep: str = ",") -> list[str]:
    """fn.split_top, fn.split_params, fn.args: parts between separators outside all brackets and quotes; empty parts go."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(s):
        if quote:
            quote = "" if c == quote and s[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in _OPEN:
            depth += 1
        elif c in _CLOSE and not (c == ">" and i and s[i - 1] in "-="):
            depth = max(0, depth - 1)
        elif c == sep and not depth:
            out.append(s[at:i].strip())
            at = i + 1
    out.append(s[at:].strip())
    return [p for p in out if p]


def argc(args: str) -> int:
    """fn.argc: how many arguments a call's text has."""
    return len(split_top(args))


def matching_paren(s: str, start: int) -> int:
    """fn.matching_paren: index of the bracket that closes the one at `start`, -1 if none."""
    depth = 0
    for i in range(start, len(s)):
        depth += (s[i] == "(") - (s[i] == ")")
        if not depth:
            return i
    return -1


def normalize(raw: str) -> str:
    """fn.normalize: a callee's text as a dotted path: white space, arguments and type parameters go until nothing changes."""
    s = re.sub(r"\s+", "", raw)
    while True:
        t = re.sub(r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]", "", s)
        if t == s:
            break
        s = t
    return re.sub(r"\.{2,}", ".", re.sub(r"::|->|\?\.|\?", ".", s)).strip(".!&*")


def expand_braced(spec: str, sep: str = "::", prefix: str = "", alias: str = " as ") -> list[tuple[str, str]]:
    """fn.expand_braced: (alias, full path) of each leaf of a nested import list."""
    spec = spec.strip()
    if spec.endswith("}"):
        head, _, body = spec.partition("{")
        base = prefix + head.strip()
        return [pair for part in split_top(body[:-1]) for pair in expand_braced(part, sep, base, alias)]
    path, _, name = spec.partition(alias)
    path = path.strip()
    full = prefix.removesuffix(sep) if path == "self" else prefix + path
    return [((name.strip() or full.split(sep)[-1]), full)]


def arity(params: str) -> tuple[int, float, bool]:
    """fn.arity, fn.argc: (least, most, takes an explicit receiver) of a parameter list."""
    parts = split_top(params)
    takes_self = bool(parts) and re.sub(r"^(&|mut|\s)+", "", parts[0]).split(":")[0].strip() in ("self", "cls", "this")
    rest = [p for p in parts[takes_self:] if p not in ("*", "/")]
    least, most = 0, 0.0
    for p in rest:
        if p.startswith(("*", "...")) or p.split(":")[0].strip().startswith("..."):
            most = float("inf")
        else:
            most += 1
            least += "=" not in p
    return least, most, takes_self


def parse_duration(text: str, lang: str = "python") -> float | None:
    """fn.parse_duration: the earliest duration in a call's text, in seconds."""
    n = r"([0-9][0-9_]*(?:\.[0-9]+)?)"
    forms: list[tuple[str, object]] = [
        (rf"Duration::from_(secs|millis|micros|nanos)(?:_f(?:32|64))?\(\s*{n}", {"secs": 1.0, "millis": 1e-3, "micros": 1e-6, "nanos": 1e-9}),
        (rf"Duration\.of(Seconds|Millis|Minutes|Nanos|Hours)\(\s*{n}", {"Seconds": 1.0, "Millis": 1e-3, "Minutes": 60.0, "Nanos": 1e-9, "Hours": 3600.0}),
        (rf"{n}\s*\*\s*time\.(Second|Millisecond|Microsecond|Minute|Hour)", {"Second": 1.0, "Millisecond": 1e-3, "Microsecond": 1e-6, "Minute": 60.0, "Hour": 3600.0}),
        (rf"{n}\s*,\s*TimeUnit\.(SECONDS|MILLISECONDS|MINUTES)", {"SECONDS": 1.0, "MILLISECONDS": 1e-3, "MINUTES": 60.0}),
        (rf"timedelta\(\s*(seconds|milliseconds|minutes|hours)\s*=\s*{n}", {"seconds": 1.0, "milliseconds": 1e-3, "minutes": 60.0, "hours": 3600.0}),
        (rf"\b{n}\s*(ms|us|µs|ns|s|min|h)\b", {"ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9, "s": 1.0, "min": 60.0, "h": 3600.0}),
    ]
    best: tuple[int, int, float] | None = None
    for k, (pattern, units) in enumerate(forms):
        m = re.search(pattern, text)
        if m:
            a, b = m[1], m[2]
            number, unit = (a, b) if a[0].isdigit() else (b, a)
            hit = (m.start(), k, float(number.replace("_", "")) * units[unit])
            best = min(best, hit) if best else hit
    for m in re.finditer(r"\b(wait_for|timeout|sleep_for|withTimeout)\s*\(", text):
        # the deadline is a bare number: the second argument of wait_for, the first of the others
        close = matching_paren(text, m.end() - 1)
        args = split_top(text[m.end() : close if close >= 0 else len(text)])
        mine = args[1:2] if m[1] == "wait_for" else args[:1]
        if mine and re.fullmatch(r"[0-9][0-9_]*(?:\.[0-9]+)?", mine[0]):
            hit = (m.start(), len(forms), float(mine[0].replace("_", "")) * (1e-3 if m[1] == "withTimeout" or lang in MILLISECOND_LANGS else 1.0))
            best = min(best, hit) if best else hit
            break
    bare = re.search(rf"\b(?:timeout|deadline|connect_timeout|read_timeout|total|seconds)\w*\s*[=:]\s*{n}(?![\w.])", text)
    if bare and (best is None or bare.start() < best[0]):
        return float(bare[1].replace("_", "")) * (1e-3 if lang in MILLISECOND_LANGS else 1.0)
    return best[2] if best else None


def sleep_duration(text: str, lang: str = "python") -> float | None:
    """fn.sleep_duration: also bare-number sleeps, in the language's unit."""
    found = parse_duration(text, lang)
    if found is not None:
        return found
    m = re.search(r"\b(usleep|[sS]leep|delay|setTimeout|wait)\w*\s*\(\s*(?:[^(),]*,\s*)?([0-9][0-9_]*(?:\.[0-9]+)?)\s*\)", text)
    if not m:
        return None
    unit = 1e-6 if m[1] == "usleep" else 1e-3 if m[1] == "delay" or lang in MILLISECOND_LANGS else 1.0
    return float(m[2].replace("_", "")) * unit


def resolve_constants(text: str, values: dict[str, float]) -> str:
    """fn.resolve_constants: known upper-case names as their numbers."""
    return re.sub(r"\b(?:[A-Za-z_]\w*\.)*([A-Z][A-Z0-9_]+)\b", lambda m: f"{values[m[1]]:g}" if m[1] in values else m[0], text)


def retry_decorator(text: str) -> tuple[int | None, str] | None:
    """fn.retry_decorator: (attempts, backoff kind) of a retry decorator; null attempts are unbounded."""
    if not re.search(r"\b(retry|retrying|backoff|tenacity)\b", text):
        return None
    m = re.search(r"stop_after_attempt\(\s*(\d+)|(?:max_tries|tries|attempts|max_attempts|stop_max_attempt_number)\s*=\s*(\d+)", text)
    kind = "exponential" if re.search(r"expo|wait_random_exponential", text) else "fixed" if re.search(r"wait_fixed|interval|constant|delay|wait\s*=", text) else "none"
    return (int(m[1] or m[2]) if m else None), kind


def loop_count(header: str, constants: dict[str, float] | None = None) -> tuple[str, int | None]:
    """fn.count, fn.const: (kind, bound) of a loop header."""
    def number(s: str) -> int | None:
        s = s.strip()
        if re.fullmatch(r"[0-9_]+", s):
            return int(s.replace("_", ""))
        v = (constants or {}).get(s.split(".")[-1])
        return int(v) if v is not None else None

    if re.match(r"\s*(while\s*\(?\s*(True|true|1)\b|loop\b|for\s*(\(\s*;\s*;\s*\)|\{))", header):
        return "forever", None
    m = re.search(r"\brange\(\s*(?:([^,()]+)\s*,\s*)?([^,()]+)\)", header)
    if m:
        lo, hi = (number(m[1]) if m[1] else 0), number(m[2])
        return "counted", None if lo is None or hi is None else max(0, hi - lo)
    m = re.search(r"\b(\w+)\s*\.\.(=?)\s*(\w+)", header)
    if m and (number(m[3]) is not None or number(m[1]) is not None):
        lo, hi = number(m[1]), number(m[3])
        return "counted", None if lo is None or hi is None else max(0, hi - lo + bool(m[2]))
    m = re.search(r";\s*\w+\s*(<=?)\s*(\w+)\s*;", header)
    if m:
        n = number(m[2])
        return "counted", None if n is None else n + (m[1] == "<=")
    return ("conditional", None) if re.match(r"\s*while\b", header) else ("collection", None)


def joined_lines(lines: list[str]) -> list[tuple[int, str]]:
    """proj.joined_lets: continuation lines merged into one logical line, with the first line's number."""
    out: list[tuple[int, str]] = []
    depth, held, first = 0, "", 0
    for n, line in enumerate(lines, 1):
        if not held:
            first = n
        held = f"{held} {line.strip()}" if held else line.rstrip()
        depth += sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
        if depth <= 0 and not held.endswith(("\\", "=", ",")):
            out.append((first, held.removesuffix("\\")))
            held, depth = "", 0
    if held:
        out.append((first, held))
    return out


# -- the same functions over columns: Arrow batches, null in and null out --------------------------------------------------


def _over_columns(f: Callable, kind: str) -> Callable[..., Column]:
    """f over columns; rows travel in Arrow batches, and one with a null argument gives null."""

    def row(*values):
        return None if any(v is None for v in values) else f(*values)

    return lambda *columns: F.udf(row, kind, useArrow=True)(*columns)


vec_split_top = _over_columns(split_top, "array<string>")
vec_argc = _over_columns(argc, "int")
vec_matching_paren = _over_columns(matching_paren, "int")
vec_normalize = _over_columns(normalize, "string")
vec_expand_braced = _over_columns(lambda spec, sep: [{"alias": a, "path": p} for a, p in expand_braced(spec, sep)], "array<struct<alias: string, path: string>>")
#: `most` is null where a rest parameter leaves it open.
vec_arity = _over_columns(lambda params: (lambda a: {"least": a[0], "most": None if a[1] == float("inf") else float(a[1]), "takes_self": a[2]})(arity(params)), "struct<least: int, most: double, takes_self: boolean>")
vec_duration = _over_columns(parse_duration, "double")
vec_sleep = _over_columns(sleep_duration, "double")
vec_resolve_constants = _over_columns(lambda text, values: resolve_constants(text, dict(values)), "string")
vec_retry_decorator = _over_columns(lambda text: (lambda d: d and {"attempts": d[0], "backoff": d[1]})(retry_decorator(text)), "struct<attempts: int, backoff: string>")
vec_loop_count = _over_columns(lambda header: dict(zip(("kind", "bound"), loop_count(header))), "struct<kind: string, bound: int>")
vec_joined_lines = _over_columns(lambda text: [{"line": n, "text": t} for n, t in joined_lines(text.split("\n"))], "array<struct<line: int, text: string>>")

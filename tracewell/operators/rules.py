"""The line-rule engine: named patterns over source lines, first hit per function and rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import first_per_key

#: Longer lines are not looked at; they are generated or data.
MAX_LINE = 400
COMMENT = r"^\s*(//|#|\*|/\*|--)"


@dataclass(frozen=True)
class LineRule:
    """Hits lines that match `pattern` and, where given, do not match `unless`."""

    name: str
    severity: str
    pattern: str
    unless: str | None = None
    langs: tuple[str, ...] = ()

    def hit(self, text: Column, lang: Column | None = None) -> Column:
        c = text.rlike(self.pattern)
        if self.unless:
            c = c & ~text.rlike(self.unless)
        if self.langs and lang is not None:
            c = c & lang.isin(*self.langs)
        return c


_SCRIPT = ("javascript", "typescript", "tsx")


def _any(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def _calls(names: str, arguments: str = "") -> str:
    """A call of one of these dotted names, with arguments that begin like this."""
    return rf"(?<![\w.]){_any(names.replace('.', '[.]'))}\s*[(]\s*{arguments}"


def _method(names: str, arguments: str = "") -> str:
    """A method call on any receiver."""
    return rf"[.]{_any(names)}\s*[(]\s*{arguments}"


def _since(clock: str) -> str:
    """The clock is read and something is subtracted, or it is subtracted from a name that tells of a beginning."""
    return rf"{clock}\s*-(?!>)|-\s*(?:\w*_)?{_any('begin began start started since')}\w*\b.*{clock}|{clock}.*-\s*\w*(?i:begin|began|start|since)"


# A string that a value is put into, per language: an f-string, a template, or a literal that is added to.
_PY_FILLED = r"(?:f\"[^\"{]*[{]\w|f'[^'{]*[{]\w|(?:\"[^\"]*\"|'[^']*')\s*(?:[%+]\s*[\w(]|[.]format[(]))"
_JS_FILLED = r"(?:`[^`]*[$][{]|(?:\"[^\"]*\"|'[^']*')\s*[+]\s*\w)"
_ADDED = r"\"[^\"]*\"\s*[+]\s*\w"
_MONEY = _any("price amount balance cost fee salary payment subtotal revenue tax")
_FLOATS = _any("float double f32 f64 float32 float64")
_EMPTY = r"[)]"
# What each rule's line must show, by language; names and severities are fixed values.
SOURCE_RULES = (
    LineRule("unbounded-channel", "low", r"\bmpsc::channel(?:::<.*>)?[(][)]|\bunbounded(?:_channel)?(?:::<.*>)?[(][)]", None, ("rust",)),
    LineRule("unbounded-channel", "low", rf"(?:\w*Queue[(]\s*(?:maxsize\s*=\s*)?0?\s*{_EMPTY})|\bdeque[(]\s*{_EMPTY}", None, ("python",)),
    LineRule("unbounded-channel", "low", rf"\bnew\s+\w*(?:Queue|Deque)(?:<.*>)?[(]\s*{_EMPTY}", r"\b(Array|Synchronous)\w*(Queue|Deque)\b", ("java",)),
    LineRule("unbounded-channel", "low", r"\bmake[(]\s*chan\s.*,\s*\d{5,}\s*[)]", None, ("go",)),
    LineRule("float-money", "medium", rf"(?i)\w*{_MONEY}\w*\s*:\s*(?:mut\s+)?{_FLOATS}\b|\b{_FLOATS}\s+\w*{_MONEY}\w*\s*[=;,)]|\w*{_MONEY}\w*\s*=\s*float[(]"),
    LineRule("wallclock-interval", "medium", r"\bSystemTime::now[(][)].*[.]elapsed[(]|[.]duration_since[(].*\bSystemTime\b", None, ("rust",)),
    LineRule("wallclock-interval", "medium", _since(r"\btime[.]time[(][)]"), None, ("python",)),
    LineRule("wallclock-interval", "medium", _since(r"\bDate[.]now[(][)]"), None, _SCRIPT),
    LineRule("wallclock-interval", "medium", _since(r"\bcurrentTimeMillis[(][)]"), None, ("java",)),
    LineRule("panic-on-external-data", "medium", r"(?:\bfrom_(?:str|slice|reader|value)|[.](?:parse|json|text|bytes))(?:::<.*>)?[(].*[)](?:[.]await)?[.](?:unwrap|expect)[(]", None, ("rust",)),
    LineRule("panic-on-external-data", "medium", r",\s*_\s*:?=\s*strconv[.]\w+[(]|(?:^\s*|,\s*_\s*:?=\s*|_\s*=\s*)json[.]Unmarshal[(]", None, ("go",)),
    LineRule("redos-regex", "medium", r"[(][^()]*[+*][)][+*]|[(][^()]*[+*][)][{]\d+,"),
    LineRule("unbounded-query", "low", r"[\"'](?i:select)\s.*\s(?i:from)\s+\w+\s*[\"']|[.]objects[.]all[(][)]\s*$|[.]fetchall[(][)]", r"(?i)\slimit\s|\swhere\s|count[(]", ("python",)),
    LineRule("unbounded-query", "low", _method("fetch_all"), None, ("rust",)),
    LineRule("unbounded-query", "low", _method("findAll getResultList", _EMPTY), None, ("java",)),
    LineRule("unbounded-query", "low", rf"{_method('findMany findAll', _EMPTY)}|{_method('find', '[{][ ]*[}]')}", None, _SCRIPT),
    LineRule("fire-and-forget-task", "low", r"^\s*(?:\w+::)*spawn[(]", None, ("rust",)),
    LineRule("fire-and-forget-task", "medium", r"^\s*(?:\w+[.])*(?:create_task|ensure_future)[(]", None, ("python",)),
    LineRule("fire-and-forget-task", "low", r"^\s*new\s+Thread[(].*[)][.]start[(]", None, ("java",)),
    LineRule("sql-injection", "high", rf"{_method('execute executemany executescript raw', _PY_FILLED)}|f[\"'](?i:select|insert|update|delete)\s[^\"']*[{{]", None, ("python",)),
    LineRule("sql-injection", "high", _method("query execute raw [$]queryRawUnsafe [$]executeRawUnsafe", _JS_FILLED), None, _SCRIPT),
    LineRule("sql-injection", "high", _method("execute executeQuery executeUpdate prepareStatement createQuery createNativeQuery", _ADDED), None, ("java",)),
    LineRule("sql-injection", "high", rf"[.](?:Query|QueryRow|Exec)(?:Context)?[(].*(?:fmt[.]Sprintf[(]|{_ADDED})", None, ("go",)),
    LineRule("unsanitized-url-query", "medium", _method("get post put patch delete request", r"f[\"'][^\"'?]*[?][^\"']*=[{]"), None, ("python",)),
    LineRule("unsanitized-url-query", "medium", r"\b(?:fetch|get|post)[(]\s*`[^`?]*[?][^`]*=[$][{]", None, _SCRIPT),
    LineRule("uncommitted-write", "medium", r"[.]execute\w*[(]\s*[\"'](?i:insert|update|delete)\s", r"(?i)commit"),
    LineRule("unbounded-concurrency", "medium", r"\bgather[(]\s*[*]", r"(?i)semaphore|limit|pool", ("python",)),
    LineRule("unbounded-concurrency", "medium", r"^\s*go\s+[\w.]+[(]", r"(?i)semaphore|limit|pool", ("go",)),
    LineRule("unbounded-threads", "medium", _calls("threading.Thread Thread"), None, ("python",)),
    LineRule("defer-in-loop", "low", r"^(?:\t|[ ]{2})\s*defer\s", None, ("go",)),
    LineRule("panic-on-io-error", "medium", rf"{_method('connect send read write open get post query', '.*[)](?:[.]await)?[.](?:unwrap|expect)[(]')}", None, ("rust",)),
    LineRule("ignored-io-error", "low", rf",\s*_\s*:?=\s*(?:\w+[.])+{_any('Get Post Do Query Exec Read Write Open')}[(]", None, ("go",)),
    LineRule("client-per-call", "medium", _calls("requests.Session httpx.Client httpx.AsyncClient aiohttp.ClientSession"), None, ("python",)),
    LineRule("client-per-call", "medium", r"\breqwest::(?:blocking::)?Client::(?:new|builder)[(]", None, ("rust",)),
)
# The same engine over documents; their texts have licences, secrets, addresses and bars.
DOCUMENT_RULES = (
    LineRule("license", "low", "licen[sc]ed under"),
    LineRule("secret", "high", "(token|secret|password|key) = "),
    LineRule("mail", "medium", "[a-z0-9.]+@[a-z0-9.]+[.]com"),
    LineRule("host-address", "medium", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"),
    LineRule("shouting", "low", "[!]{2}", "[?]"),
    LineRule("bars", "info", " [|] .* [|] "),
)
JITTER, BACKOFF, RETRY = r"(?i)jitter|random", r"(?i)backoff|\*\*\s*attempt|\*=\s*2|<<\s*attempt|expo", r"(?i)retry|retries|attempt"


def code_lines(source: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """proj.lines: numbered lines without comments and overlong lines."""
    lines = source.select(*ids, F.posexplode(F.split(text, "\n", -1)).alias("_p", "line")).withColumn("line_no", F.col("_p") + 1).drop("_p")
    return lines.where(~F.col("line").rlike(COMMENT) & (F.length("line") < MAX_LINE))


def hits(lines: DataFrame, rules: tuple[LineRule, ...], function: list[str], lang: str | None = None) -> DataFrame:
    """(function, rule, severity, line_no) of every hit; a line shows a rule once, whichever of its patterns it matches.

    All rules are tested in one pass over the lines; each pattern is a constant, so it compiles once.
    """
    text, tongue = F.col("line"), F.col(lang) if lang else None
    found = F.array_distinct(F.filter(F.array(*[F.when(r.hit(text, tongue), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules]), lambda x: x.isNotNull()))
    return lines.withColumn("_h", F.explode(found)).select(*function, F.col("_h.rule").alias("rule"), F.col("_h.severity").alias("severity"), "line_no")


def first_hits(lines: DataFrame, rules: tuple[LineRule, ...], function: list[str], lang: str | None = None) -> DataFrame:
    """topk.first_per_fn: (function, rule, severity, line_no) of each rule's first hit in a function."""
    return hits(lines, rules, function, lang).groupBy(*function, "rule", "severity").agg(F.min("line_no").alias("line_no"))


def backoff_without_jitter(body: Column, retry: str = RETRY, backoff: str = BACKOFF, jitter: str = JITTER) -> Column:
    """Rule backoff-without-jitter: a body that retries and backs off, with nothing random in it."""
    return body.rlike(retry) & body.rlike(backoff) & ~body.rlike(jitter)


def regex_constants(lines: DataFrame, file: str = "file") -> DataFrame:
    """Rule redos-regex (module constant): (file, line_no, name) of lines that compile a name whose constant has a repeat inside a repeated group."""
    unsafe = next(r.pattern for r in SOURCE_RULES if r.name == "redos-regex")
    name = F.regexp_extract("line", r"^([A-Z][A-Z0-9_]*)\s*=\s*r?[\"']", 1)
    sets = lines.withColumn("name", name).where((F.col("name") != "") & F.col("line").rlike(unsafe)).select(file, "name").distinct()
    uses = lines.withColumn("name", F.regexp_extract("line", r"\b(?:compile|match|search|fullmatch|findall|finditer|sub|split)\s*\(\s*([A-Z][A-Z0-9_]*)\b", 1)).where("name <> ''")
    return uses.join(sets, [file, "name"]).select(file, "line_no", "name")


def wallclock_variable(lines: DataFrame, function: list[str]) -> DataFrame:
    """Rule wallclock-interval (variable): a name set from a clock and subtracted later."""
    sets = lines.withColumn("name", F.regexp_extract("line", r"(\w+)\s*=\s*(?:time\.time\(\)|Date\.now\(\)|SystemTime::now\(\))", 1)).where("name <> ''").select(*function, "name", F.col("line_no").alias("_set"))
    uses = lines.withColumn("name", F.regexp_extract("line", r"-\s*(\w+)\b", 1)).where("name <> ''").select(*function, "name", "line_no")
    return first_per_key(sets.join(uses, [*function, "name"]).where("line_no > _set"), function, ["line_no"]).select(*function, "name", "line_no")


def unbounded_container(ops: DataFrame) -> DataFrame:
    """Rule unbounded-module-container: containers of a file that grow and never shrink."""
    return ops.groupBy("file", "name").agg(F.count_if(F.col("op") == "grow").alias("grows"), F.count_if(F.col("op") == "shrink").alias("shrinks"), F.min(F.when(F.col("op") == "grow", F.col("line"))).alias("line")).where("grows > 0 AND shrinks = 0")

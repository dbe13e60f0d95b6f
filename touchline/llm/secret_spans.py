"""Secrets in text: sure ones by their form, weak ones only where their other parts stand near by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from touchline.llm.common import text_of

#: Code points that may lie between two parts of one credential: a part's scope is its interval, this much wider on both sides.
REACH = 256
EMPTY = "CAST(array() AS array<struct<start:int,kind:int,end:int>>)"

#: Kinds in the order of their names; the first three are reported wherever they stand.
KINDS = ("assign", "access", "hex", "ident", "token", "endpoint")
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "ident": r"""(?i:username|user|login|account|client_id|access_key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]+""",
    "token": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}",
    "endpoint": r"""(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|s3)://[^\x20\x09-\x0D"'<>]+""",
}
#: What every match holds: a cheap test that spares most texts the search.
HOLDS = {"assign": "(contains({0}, '=') OR contains({0}, ':'))", "access": "contains({0}, 'AKIA')",
         "ident": "(contains({0}, '=') OR contains({0}, ':'))", "token": "{0} RLIKE '[0-9]'", "endpoint": "contains({0}, '://')"}
#: Parts of a credential: who, with what, where.
ROLES = {"who": ("access", "ident"), "what": ("assign", "hex", "token"), "where": ("endpoint",)}
#: What must stand in a common scope before a weak kind is reported.
NEEDS = {"ident": ("what",), "token": ("who",), "endpoint": ("who", "what")}


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, kind: str) -> Column:
    """Leftmost non-overlapping matches of a kind in the column ``text``, as an array of (start, kind, end).

    The text before each match is matched too, lazily, and so is the rest after the last one, so places are sums
    of lengths in code points and every character is passed once.
    """
    pattern, number = PATTERNS[kind], KINDS.index(kind)
    cut = _sql(rf"(?s)(.*?)(?:({pattern})|\z)")
    value = f"regexp_extract_all({text}, {cut}, 3)" if kind == "assign" else f"regexp_extract_all({text}, {cut}, 2)"
    pieces = f"arrays_zip(regexp_extract_all({text}, {cut}, 1), regexp_extract_all({text}, {cut}, 2), {value})"
    pieces = (f"transform(filter({pieces}, x -> x.`1` <> ''), x -> named_struct('gap', length(x.`0`), "
              f"'hit', length(x.`1`), 'value', x.`2`))")
    tests = {"assign": "length(x.value) >= 8", "token": "x.value RLIKE '[A-Z]' AND x.value RLIKE '[a-z]'"}
    one = f"named_struct('start', a.at + x.gap, 'kind', {number}, 'end', a.at + x.gap + x.hit)"
    fold = scan(pieces, "0", "a.at + x.gap + x.hit", one, "struct<start:int,kind:int,end:int>", tests.get(kind, "true"))
    first = f"{HOLDS[kind].format(text)} AND " if kind in HOLDS else ""
    return F.expr(f"CASE WHEN {first}{text} RLIKE {_sql(pattern)} THEN {fold} ELSE {EMPTY} END")


def scan(items: str, start: str, step: str, made: str, made_type: str, where: str = "true") -> str:
    """SQL of an array: for each item x of an array in order, ``made`` where ``where`` holds, with the state a.at before it;
    ``step`` is the state after it.

    Arrays are copied to grow, so one list would cost the square of its length: items are taken in runs of about the
    square root of their number, each run grows a list of its own, and the lists are put together at the end.
    """
    run = "CAST(ceil(sqrt(greatest(size(t.items), 1))) AS INT)"
    runs = f"transform(sequence(0, (size(t.items) - 1) div {run}), i -> slice(t.items, CAST(i AS INT) * {run} + 1, {run}))"
    empty, lists = f"CAST(array() AS array<{made_type}>)", f"CAST(array() AS array<array<{made_type}>>)"
    inner = (f"aggregate(r, named_struct('at', o.at, 'out', {empty}), (a, x) -> named_struct('at', {step}, 'out', "
             f"CASE WHEN {where} THEN concat(a.out, array({made})) ELSE a.out END))")
    outer = (f"aggregate({runs}, named_struct('at', {start}, 'lists', {lists}), (o, r) -> "
             f"transform(array({inner}), n -> named_struct('at', n.at, 'lists', concat(o.lists, array(n.out))))[0], o -> flatten(o.lists))")
    return f"transform(array(named_struct('items', {items})), t -> CASE WHEN size(t.items) > 0 THEN {outer} ELSE {empty} END)[0]"


def _among(kinds) -> str:
    return ", ".join(str(KINDS.index(k)) for k in kinds)


def linked(parts: str) -> Column:
    """Of the found parts, in order, the sure ones, and the weak ones within whose reach their complements lie.

    Two parts are linked when at most ``REACH`` code points lie between their intervals. Going forwards, the farthest end of each role
    so far tells whether one before reaches the part; going backwards, the nearest start tells it of those behind. So parts are
    joined to intervals in two passes, not to each other.
    """
    far = 1 << 30
    part = "struct<start:int,kind:int,end:int>"

    def passing(items: str, start: int, pick: str, edge: str) -> str:
        names = list(ROLES)
        zero = "named_struct(" + ", ".join(f"'{r}', {start}" for r in names) + ")"
        step = "named_struct(" + ", ".join(
            f"'{r}', CASE WHEN x.kind IN ({_among(ROLES[r])}) THEN {pick}(a.at.{r}, x.{edge}) ELSE a.at.{r} END" for r in names) + ")"
        kind = "struct<" + ",".join(f"{r}:int" for r in names) + ">"
        return scan(items, zero, step, "a.at", kind)

    before, behind = passing(parts, -far, "greatest", "end"), passing(f"reverse({parts})", far, "least", "start")

    def near(role: str) -> str:
        return f"(z.`1`.{role} + {REACH} >= z.`0`.start OR z.`2`.{role} <= z.`0`.end + {REACH})"

    rules = [f"(z.`0`.kind = {KINDS.index(k)} AND {' AND '.join(near(r) for r in needs)})" for k, needs in NEEDS.items()]
    sure = f"z.`0`.kind IN ({_among(KINDS[:3])})"
    # All parts as they stand, with what lies before and behind each.
    zipped = f"arrays_zip(transform({parts}, p -> p), {before}, reverse({behind}))"
    kept = f"transform(filter({zipped}, z -> {sure} OR {' OR '.join(rules)}), z -> CAST(z.`0` AS {part}))"
    return F.expr(f"CASE WHEN exists({parts}, p -> p.kind > 2) THEN {kept} ELSE {parts} END")


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, p -> concat_ws(':', {names}[p.kind], p.start, p.end)), ',')")


def find_secrets(docs: DataFrame, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """Each row's text with ``spans``: an array of (start, kind, end) in order, in code points, the end exclusive.

    Sure kinds are reported wherever they stand: assignments of 8 or more characters to a telling name, access
    identifiers, long hexadecimal runs. Weak kinds (account names, mixed tokens of 20 or more characters, addresses) are reported
    only where complementary parts lie within ``REACH`` of their interval. Overlapping matches of different kinds are all listed. A
    null or empty text has no spans; repeated rows are treated alike; an empty table gives an empty result. Only columns named
    in ``keep`` are carried. No row leaves its place: there is no shuffle. A text costs its length and the number of its matches to the
    power of one and a half.
    """
    text = text_of(docs, text_col)
    found = docs.select(*[c.alias(n) for n, c in (keep or {}).items()], text.alias("_text"))
    found = found.withColumns({f"_{k}": matches("`_text`", k) for k in KINDS})
    parts = F.array_sort(reduce(lambda a, b: F.concat(a, b), [F.col(f"_{k}") for k in KINDS]))
    return found.withColumn("_parts", parts).withColumn("spans", linked("`_parts`")).drop("_parts", *[f"_{k}" for k in KINDS])


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of sure kinds, a digest of their spans, and all spans as text. Spans that begin alike follow the kinds' order."""
    found = find_secrets(docs, text_col, {"doc_id": docs[f"`{id_col}`"]}).withColumn(
        "base", F.expr(f"filter(spans, p -> p.kind IN ({_among(KINDS[:3])}))"))
    counts = [F.expr(f"CAST(size(filter(base, p -> p.kind = {i})) AS BIGINT)").alias(f"n_{k}")
              for i, k in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
                        joined("spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span, overlapping ones as one, replaced by ``mark``; other texts stay as they are, and so do other
    columns, whatever their names."""
    names = {f"_c{i}": docs[f"`{c}`"] for i, c in enumerate(docs.columns)}
    found = find_secrets(docs, text_col, names)
    # Spans that overlap one before them only lengthen it; the text is cut at the others. Cutting goes run by run, as cutting far into a
    # long text costs its length: a run's own stretch first, then the pieces of it.
    run = "CAST(ceil(sqrt(greatest(size(spans), 1))) AS INT)"
    runs = f"transform(sequence(0, (size(spans) - 1) div {run}), i -> slice(spans, CAST(i AS INT) * {run} + 1, {run}))"
    none, lists = "CAST(array() AS array<string>)", "CAST(array() AS array<array<string>>)"
    cut = f"CASE WHEN p.start + 1 < a.at THEN array() ELSE array(substring(s, a.at - o.at + 1, p.start + 1 - a.at), {_sql(mark)}) END"
    inner = (f"aggregate(r, named_struct('at', o.at, 'out', {none}), (a, p) -> named_struct('at', greatest(a.at, p.end + 1), "
             f"'out', CASE WHEN p.end < a.at THEN a.out ELSE concat(a.out, {cut}) END))")
    stretch = "substring(`_text`, o.at, greatest(0, array_max(transform(r, p -> p.end)) + 1 - o.at))"
    outer = (f"aggregate({runs}, named_struct('at', 1, 'lists', {lists}), (o, r) -> transform(transform(array({stretch}), s -> {inner}), "
             "n -> named_struct('at', n.at, 'lists', concat(o.lists, array(n.out))))[0], "
             "o -> concat(array_join(flatten(o.lists), ''), substring(`_text`, o.at)))")
    text = F.when(F.size("spans") > 0, F.expr(outer))
    return found.select(*[
        (F.coalesce(text, F.col(n)) if c == text_col else F.col(n)).alias(c) for n, c in zip(names, docs.columns)])

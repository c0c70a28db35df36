"""Scalar expressions of the log analytics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, half to even."""
    return F.greatest(F.lit(0), F.bround(F.length(text) / 4)).cast("long")


def whole_total(amount: Column, rate: Column) -> Column:
    """Aggregate: the sum of products to a whole number, half away from zero.

    Doubles add up differently in another order, on either side of a half; decimals do not. The sum of doubles stands in
    only where a number has more than 6 decimals or 12 digits before them.
    """
    product = _as_written(amount) * _as_written(rate)
    all_are = F.count(product) == F.count(amount * rate)
    return F.when(all_are, F.round(F.try_sum(product)).cast("long")).otherwise(F.round(F.sum(amount * rate)).cast("long"))


def _as_written(number: Column) -> Column:
    """A double as the shortest decimal that is read as it; NULL if that is too long."""
    exact = number.try_cast("decimal(18,6)")
    return F.when(exact.cast("double") == number, exact)


def normalize_line(line: Column) -> Column:
    """Any run of Unicode white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(line, r"(?U)\s+", " "))


def matchable(line: Column) -> Column:
    return F.length(line) >= 4


def short_id(prefix: str, *parts: Column, length: int = 15) -> Column:
    """A deterministic id: the beginning of the SHA-1 of the fields."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length))


def normal_form(ts: Column) -> Column:
    """A time of any usual spelling in UTC, whole seconds (cut off, not rounded); empty if there is none."""
    at = F.date_trunc("second", F.try_to_timestamp(ts))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def finite(number: Column) -> Column:
    """NULL for what is not a number, so that it reads as not recorded."""
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def share(part: Column, rest: Column) -> Column:
    """Percent of part in part and rest; NULL if both are missing or add to nothing."""
    return F.when(part + rest > 0, F.bround(100 * part / (part + rest)).cast("long"))


def basename(uri: Column) -> Column:
    """The last part of a path or URI, with its percent signs decoded; what cannot be decoded stays as it is."""
    last = F.regexp_extract(uri, r"([^/]*)/*$", 1)
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)


def agent_name(agent: Column) -> Column:
    return F.when(agent == "claude-code", "claude").otherwise(agent)


def first_number(*aliases: Column, kind: str = "long") -> Column:
    """The first alias that holds a usable number: neither missing nor infinite nor none."""
    return F.coalesce(*(finite(F.expr("null").cast("double") if a is None else a.try_cast("double")) for a in aliases)).cast(kind)


def digest(*parts: Column, length: int = 16) -> Column:
    """The beginning of the SHA-1 of the parts, set apart by zero characters."""
    return F.substring(F.sha1(F.concat_ws("\0", *parts)), 1, length)


def content_signature(argv: Column, answer: Column) -> Column:
    """(args_hash, answer_hash) of a tool run, whatever its program is called and however its answer is padded."""
    tail = F.slice(argv, 2, F.greatest(F.size(argv) - 1, F.lit(0)))
    return F.struct(digest(F.array_join(tail, "\0")).alias("args_hash"), digest(F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)^\s+|\s+\z", "")).alias("answer_hash"))


def read_signature(path: Column, revision: Column) -> Column:
    """(args_hash, answer_hash) of a report that was read: its path in one spelling, and the second of its graph's last change."""
    return F.struct(digest(F.lower(F.replace(path, F.lit("\\"), F.lit("/")))).alias("args_hash"), digest(F.coalesce(F.floor(revision).cast("string"), F.lit(""))).alias("answer_hash"))


def key_of(text: Column) -> Column:
    """The key of a prompt or a place: the beginning of its SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def under(path: Column, root: Column) -> Column:
    """Whether a directory is the root or lies below it."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def relative_to(path: Column, root: Column) -> Column:
    """A path within a repository, from its root; NULL for one outside."""
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path)))


def result_text(content: Column) -> Column:
    """The text of a tool's result: a JSON string as it is, or its blocks' texts, one a line; empty for anything else."""
    blocks = F.from_json(content, "array<struct<text: string, content: string>>")
    many = F.array_join(F.filter(F.transform(blocks, lambda b: F.coalesce(b["text"], b["content"])), lambda t: t.isNotNull()), "\n")
    bare = F.when(~F.ltrim(content).startswith("{"), content)
    return F.coalesce(F.when(F.ltrim(content).startswith("["), many), bare, F.lit(""))


def cell(value: Column, kind: str) -> Column:
    """A value as it stands in a CSV file: never an exponent, lists joined by semicolons, nothing for NULL."""
    if kind == "boolean":
        text = F.when(value, "true").otherwise("false")
    elif kind in ("double", "float"):
        fixed = F.format_string("%.6f", value.cast("double"))
        text = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")
    elif kind.startswith("array"):
        text = F.array_join(F.transform(value, lambda v: cell(v, kind[6:-1])), ";")
    elif kind.startswith(("struct", "map")):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "").otherwise(text)


def thousands(n: Column) -> Column:
    return F.format_number(F.bround(n).cast("long"), 0)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.concat(F.bround(100 * part / whole).cast("long").cast("string"), F.lit("%"))).otherwise("—")


def ago(seconds: Column) -> Column:
    """How long ago, in words; below a minute and a half nothing is counted."""
    s = F.greatest(seconds, F.lit(0))
    unit = lambda size, mark: F.concat(F.floor(s / size).cast("string"), F.lit(f"{mark} ago"))
    return F.when(s < 90, "just now").when(s < 5400, unit(60, "m")).when(s < 172800, unit(3600, "h")).otherwise(unit(86400, "d"))


def round_exact(x: Column, places: int) -> Column:
    """A double rounded by the binary value it holds, exact halves to even: 0.575 holds a little less, so it is 0.57 (``round`` goes by its decimal digits)."""
    return F.regexp_replace(F.format_number(x, places), ",", "").cast("double")


def hours(wall: Column, span: Column, attested_min: Column, cap_s: int = 0, estimate: bool = True, exact: bool = False) -> Column:
    """(value, tier, reason): what a person attested, else the wall clock less the agents' span, else why there is none; ``exact``: rounded by ``round_exact``."""
    cents = round_exact if exact else F.round
    said = cents(attested_min / 60.0, 2)
    guess = cents(F.greatest(wall - span, F.lit(0)) / 3600.0, 2)
    why = F.when(F.lit(not estimate), "no-estimate").when(wall.isNull(), "no-wall").when(span.isNull(), "no-agent-span").when(F.lit(cap_s > 0) & (wall > cap_s), "gap-too-wide")
    return F.struct(
        F.coalesce(said, F.when(why.isNull(), guess)).alias("value"), F.when(attested_min.isNotNull(), "attested").when(why.isNull(), "estimated").alias("tier"),
        F.when(attested_min.isNotNull(), "").otherwise(F.coalesce(why, F.lit(""))).alias("reason"),
    )


def agent_percent(agent: Column, agent_lines: Column, residual: Column, rows: Column, pre_upgrade: Column, blind: list[str]) -> Column:
    """(value, refusal): the agents' share of landed lines, or why there is none; the most structural reason first."""
    refusal = (
        F.when(agent.isin(blind), "coverage").when(F.coalesce(rows, F.lit(0)) == 0, "no-evidence").when(rows == pre_upgrade, "pre-upgrade")
        .when(F.coalesce(agent_lines + residual, F.lit(0)) == 0, "no-evidence").otherwise("")
    )
    return F.struct(F.when(refusal == "", 100.0 * agent_lines / (agent_lines + residual)).alias("value"), refusal.alias("refusal"))


#: Model names to providers (fixed values).
PROVIDERS = [("openai", r"^(gpt|o1|o3|o4|text-|davinci)"), ("anthropic", r"^claude"), ("google", r"^gemini")]


def provider_of(model: Column) -> Column:
    """The provider that a model's name tells; empty if it tells none."""
    out = F.lit("")
    for name, pattern in reversed(PROVIDERS):
        out = F.when(F.lower(model).rlike(pattern), name).otherwise(out)
    return out


def duration_minutes(spec: Column) -> Column:
    """Minutes of 90, 90m, 2h or 1h30m; NULL for anything else and for nothing."""
    hours, minutes = (F.try_to_number(F.nullif(F.regexp_extract(spec, p, 1), F.lit("")), F.lit("999999999")) for p in (r"^\s*(\d+)h", r"(\d+)m?\s*$"))
    total = F.coalesce(hours, F.lit(0)) * 60 + F.coalesce(minutes, F.lit(0))
    return F.when(spec.rlike(r"^\s*(\d+h)?(\d+m?)?\s*$") & (total > 0), total.cast("long"))


def rename_target(path: Column) -> Column:
    """The destination of a rename as numstat writes it: ``d/{a => b}/f`` or ``a => b``; other paths stay."""
    braces = F.regexp_replace(F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1"), "//+", "/")
    return F.when(path.rlike(r"\{[^{}]* => [^{}]*\}"), braces).when(path.contains(" => "), F.substring_index(path, " => ", -1)).otherwise(path)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;?]*[ -/]*[@-~]", "")


def confidence(rank: Column, corroborated: Column) -> Column:
    """Of a method's rank (0 to 2), and more where another method agrees; 1 at most."""
    return F.round(F.least(F.lit(1.0), (rank + 1) / 3 + F.when(corroborated, 0.2).otherwise(0.0)), 4)


def label(name: Column, session: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(session, F.lit("")), F.lit("(no session)"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def topic_score(asked: list[str], own: Column, keywords: Column) -> Column:
    """How well a topic answers: for each asked word three if it is a word of the topic's ``own`` name, two if it is a keyword; else, if it and a word
    of the name begin one another (both of four letters or more), two, and one for a keyword."""

    def stem(words: Column, q: str) -> Column:
        return F.exists(words, lambda k: (F.length(k) >= 4) & (k.startswith(q) | F.lit(q).startswith(k)))

    total = F.lit(0)
    for q in asked:
        near = F.when(stem(own, q), 2).when(stem(keywords, q), 1).otherwise(0) if len(q) >= 4 else F.lit(0)
        total = total + F.when(F.array_contains(own, q), 3).when(F.array_contains(keywords, q), 2).otherwise(near)
    return total

"""Text written by models, parsed into typed columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from loomspan.functions.text import let, strip

# Names of sections that are recognised without fences.
SECTIONS = ("FORMAT", "EPISODE", "SPEAKERS", "ENTITIES", "CONCEPTS", "RELATIONSHIPS", "SOURCES")
# Formats whose sources are traced.
TRACED = ("news", "commentary", "reaction", "embed")
VERDICTS = ("discard", "score", "need_transcript")
FIELDS = {
    "SPEAKERS": ("name", "role", "description"), "ENTITIES": ("name", "category", "aliases"), "CONCEPTS": ("keyword", "description"),
    "RELATIONSHIPS": ("entities", "description"), "SOURCES": ("description", "clues", "url"),
}


_FENCED = re.compile(r"^===\s*(.+?)\s*===$", re.A)
_MARKED = re.compile(r"^#{2,6}\s*([A-Z][A-Z_ ]*?)\s*:?$", re.A)
_NAMED = re.compile(r"^([A-Z][A-Z_ ]*?):$", re.A)
_ROW = "array<struct<{}>>"
_EXTRACTION = "formats array<string>, episode struct<series:string,episode:string>, " + ", ".join(
    f"{name.lower()} " + _ROW.format(",".join(f"{f}:string" for f in fields)) for name, fields in FIELDS.items()
)


def _header(line: str) -> str | None:
    """The section a line opens, null if it opens none."""
    if m := _FENCED.match(line):
        return m[1].strip().upper().replace(" ", "_")
    if m := _MARKED.match(line) or _NAMED.match(line):
        name = m[1].strip().upper().replace(" ", "_")
        return name if name in SECTIONS else None
    return None


def split_sections(text: str | None) -> dict[str, str] | None:
    """Section to its text, in one pass over the lines; null for null. See sections()."""
    if text is None:
        return None
    found: dict[str, list[str]] = {}
    body: list[str] | None = None
    for line in re.split("\r?\n", text):
        bare = line.strip()
        if bare.startswith("```"):
            continue
        if name := _header(bare):
            found.pop(name, None)
            body = found[name] = []
        elif body is not None:
            body.append(line)
    return {name: "\n".join(lines).strip() for name, lines in found.items()}


def _rows(text: str | None, fields: Sequence[str]) -> list[dict[str, str]]:
    parts = ([p.strip() for p in line.split(" | ")] for line in map(str.strip, (text or "").split("\n")) if line)
    return [{f: p[n] if n < len(p) else "" for n, f in enumerate(fields)} for p in parts]


def extract(text: str | None) -> dict | None:
    """The typed result of a text of seven sections; null for null. See extraction()."""
    s = split_sections(text)
    if s is None:
        return None
    out: dict = {name.lower(): _rows(s.get(name), fields) for name, fields in FIELDS.items()}
    for e in out["entities"]:
        e["category"] = e["category"].strip(" |")
    for r in out["sources"]:
        r["url"] = None if r["url"].lower() in ("", "none") else r["url"]
    out["sources"] = [r for r in out["sources"] if r["description"].lower() not in ("none", "n/a", "-")]
    episode = s.get("EPISODE", "").strip()
    parts = [p.strip() for p in episode.split(" | ")]
    named = parts[0] != "" and episode.lower() != "none"
    return {"formats": [x.strip().lower() for x in s.get("FORMAT", "").split("\n") if x.strip()], "episode": {"series": parts[0], "episode": parts[1] if len(parts) > 1 else None} if named else None, **out}


def _parser(parse: Callable[[str | None], object], kind: str) -> Callable[[Column], Column]:
    """A column function that parses each text once in Arrow batches.

    It counts as nondeterministic, so that Spark doesn't evaluate it again for a
    filter that it pushes below.
    """

    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def parsed(texts: pa.Array) -> pa.Array:
        return pa.array([parse(t) for t in texts.to_pylist()], arrow)

    return parsed.asNondeterministic()


def sections(text: Column) -> Column:
    """A map from section to its text. Code fences are skipped, text before the first header is dropped, of sections with the same name the last holds."""
    return _parser(lambda t: s if (s := split_sections(t)) is None else list(s.items()), "map<string,string>")(text)


def text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), strip), lambda x: x != "")


def pipe_rows(text: Column, fields: Sequence[str]) -> Column:
    """Structs of lines 'a | b | c'; what is missing is empty, what is over is dropped."""
    split = F.transform(text_lines(text), lambda x: F.transform(F.split(x, r" \| ", -1), strip))
    return F.transform(split, lambda p: F.struct(*(F.coalesce(F.get(p, n), F.lit("")).alias(f) for n, f in enumerate(fields))))


def prefixed(text: Column) -> Column:
    """A map from small-letter prefix to value of lines 'PREFIX: value'; the last of equal prefixes holds."""
    lines = F.filter(text_lines(text), lambda x: x.rlike(r"^[A-Z_]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([A-Z_]+):", 1)).alias("k"), strip(F.regexp_replace(x, r"^[A-Z_]+:", "")).alias("v")))
    return let(pairs, lambda all_: F.map_from_entries(F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["k"] == p["k"]))))


def extraction(text: Column) -> Column:
    """The typed result of a text of seven sections."""
    return _parser(extract, f"struct<{_EXTRACTION.replace(' ', ':').replace(',:', ',')}>")(text)


def traced(formats: Column, sources: Column) -> Column:
    """Whether sources are to be traced: the format asks for it, or there are sources and none has an address."""
    return F.arrays_overlap(formats, F.array(*(F.lit(f) for f in TRACED))) | (F.size(sources) > 0) & F.forall(sources, lambda s: s["url"].isNull())


def evaluation(text: Column) -> Column:
    """Coverage, gaps, supported, scores and verdict of an evaluation."""
    body = lambda label: F.regexp_extract(F.concat(F.lit("\n"), text), rf"(?s)\n{label}:[ \t]*(.*?)(?=\n(?:COVERAGE|GAPS|SUPPORTED|VALUE|VERDICT):|$)", 1)
    coverage, verdict, value = F.lower(strip(body("COVERAGE"))), F.lower(strip(body("VERDICT"))), F.lower(body("VALUE"))
    bullets = lambda t: F.transform(text_lines(t), lambda x: strip(F.regexp_replace(x, "^- ", "")))
    grade = lambda k: F.when(~value.contains("insufficient"), F.nullif(F.regexp_extract(value, rf"{k}:\s*(\d)", 1), F.lit("")).cast("int")).alias(k)
    first = F.coalesce(*(F.when(verdict.contains(v), F.lit(v)) for v in VERDICTS), F.lit("need_transcript"))
    return F.struct(
        F.when(coverage.isin("full", "partial", "minimal"), coverage).otherwise("minimal").alias("coverage"), bullets(body("GAPS")).alias("gaps"), bullets(body("SUPPORTED")).alias("supported"),
        *(grade(k) for k in ("insight", "novelty", "quality", "delivery")), first.alias("verdict"),
    )


def rendered(e: Column) -> Column:
    """An extraction as text again."""
    rows = lambda part, fields: F.array_join(F.transform(e[part], lambda r: F.concat_ws(" | ", *(F.coalesce(r[f], F.lit("none")) for f in fields))), "\n")
    episode = F.when(e["episode"].isNull(), "none").otherwise(F.concat_ws(": ", e["episode"]["series"], F.coalesce(e["episode"]["episode"], F.lit(""))))
    parts = [F.lit("FORMAT:"), F.array_join(e["formats"], "\n"), F.lit("\nEPISODE:"), episode]
    for name, fields in FIELDS.items():
        parts += [F.lit(f"\n{name}:"), rows(name.lower(), fields)]
    return F.concat_ws("\n", *parts)


def warnings(df: DataFrame, key: str, categories: Sequence[str]) -> DataFrame:
    """What is odd about extractions: ``key``, warning. ``df`` has extraction, offsets (array of int) and duration."""
    e = F.col("extraction")
    names = F.transform(e["entities"], lambda x: F.lower(x["name"]))
    lone = F.transform(F.filter(e["speakers"], lambda s: ~F.array_contains(names, F.lower(s["name"]))), lambda s: F.concat(F.lit("speaker not among entities: "), s["name"]))
    odd = F.transform(F.filter(e["entities"], lambda x: ~F.lower(x["category"]).isin(*categories)), lambda x: F.concat(F.lit("unknown category: "), x["category"]))
    o = F.col("offsets")
    falling = F.transform(F.filter(F.transform(o, lambda x, i: F.struct(x.alias("x"), F.coalesce(x < F.get(o, i - 1), F.lit(False)).alias("f"))), lambda t: t["f"]), lambda t: F.concat(F.lit("not ascending: "), t["x"].cast("string")))
    beyond = F.transform(F.filter(o, lambda x: F.coalesce((F.col("duration") > 0) & (x > F.col("duration")), F.lit(False))), lambda x: F.concat(F.lit("beyond the end: "), x.cast("string")))
    return df.select(key, F.explode(F.concat(lone, odd, falling, beyond)).alias("warning"))

"""Models as pluggable providers. The defaults work offline and always answer alike."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    def ask(self, prompt: str, history: list[str]) -> str: ...


class Cleaner:
    """Takes hesitation out of the text after the prompt's last line mark; keeps everything else."""

    def ask(self, prompt: str, history: list[str]) -> str:
        text = prompt.rsplit("\n---\n", 1)[-1]
        return re.sub(r"\s{2,}", " ", re.sub(r"\b(?:u+h+|u+m+|er+m*|hm+)\b[,.…]*\s?", "", text, flags=re.I)).strip()


class Analyst:
    """Answers the questions of the extraction pipeline by rule, from the title and description in the prompt; a stand-in for a model."""

    def ask(self, prompt: str, history: list[str]) -> str:
        question, _, text = prompt.partition("\n---\n")
        title, _, description = text.partition("\n")
        links = list(dict.fromkeys(re.findall(r"https?://\S+", description, re.A)))
        if question == "FORMAT":
            return "commentary" if re.search("news|why", title.lower()) else "tutorial"
        if question == "SOURCES":
            return "\n".join(f"link {n} | description | {u}" for n, u in enumerate(links)) or "none"
        if question == "TRACE":
            return "\n".join(links) or "nothing to trace"
        if question == "EVALUATE":
            n = len(description)
            coverage = "full" if n >= 200 else "partial" if n else "minimal"
            return f"COVERAGE: {coverage}\nVALUE: insight: {min(5, 1 + n // 100)}\nVERDICT: {'need_transcript' if not n else 'discard' if n < 40 else 'score'}"
        return "none"


class Organizer:
    """Puts chapters that found no heading into a table of contents by their time; a stand-in for a model."""

    def ask(self, prompt: str, history: list[str]) -> str:
        merged, _, unmatched = prompt.partition("\n---\n")[2].partition("\n===\n")
        lines = [line for line in merged.split("\n") if line] + [f"{at} ## {title}" for at, _, title in (line.partition(" ") for line in unmatched.split("\n") if line)]
        return "\n".join(sorted(lines, key=lambda line: int(re.match(r"\d*", line)[0] or 0)))


PROVIDERS: dict[str, Callable[[], Provider]] = {"offline": Cleaner, "analyst": Analyst, "organizer": Organizer}


class Profile(NamedTuple):
    """How a named task is asked: by which provider, and how many earlier answers it is reminded of."""

    provider: str
    remember: int = 2


PROFILES: dict[str, Profile] = {"default": Profile("offline"), "analyst": Profile("analyst", 7), "headings": Profile("organizer")}


def profile_of(name: str) -> Profile:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; there are {', '.join(sorted(PROFILES))}")
    return PROFILES[name]


def asked(df: DataFrame, key: str, prompt: str, *, provider: str = "offline") -> DataFrame:
    """``key`` and the answer to each row's prompt, one question each. The provider is made once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = PROVIDERS[provider]()
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "answer": [None if p is None else model.ask(p, []) for p in pdf[prompt]]})

    return df.select(key, prompt).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, answer string")


def conversed(df: DataFrame, key: str, order: str, prompt: str, *, provider: str = "offline", remember: int = 2) -> DataFrame:
    """Prompts of a key asked in order, each with the last answers before it: key, order, answer.

    One answer needs the one before, so a key is one sequence; the task streams
    over sorted rows and holds a few answers. An error is the answer of its row
    (error:<kind>) and ends nothing.
    """
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, now, history = PROVIDERS[provider](), None, []
        for pdf in batches:
            answers = []
            for k, p in zip(pdf[key], pdf[prompt]):
                if k != now:
                    now, history = k, []
                try:
                    answer = None if p is None else model.ask(p, history[-remember:])
                except Exception as error:  # noqa: BLE001
                    answer = f"error:{type(error).__name__}"
                if answer:
                    history = [*history, answer][-remember:]
                answers.append(answer)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "answer": answers})

    rows = df.select(key, order, prompt).repartition(key).sortWithinPartitions(key, order)
    return rows.mapInPandas(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, answer string")


#: The questions of the first step, in order: the sections of an extraction.
QUESTIONS = ("FORMAT", "EPISODE", "SPEAKERS", "ENTITIES", "CONCEPTS", "RELATIONSHIPS", "SOURCES")


def extracted(df: DataFrame, key: str, title: str, text: str, *, profile: str = "default") -> DataFrame:
    """``key``, extraction, traced, trace and evaluation of texts, in three steps.

    First seven questions, asked in order with the answers before them, whose
    answers are the sections of an extraction; then, where its format or its
    sources ask for it, a trace of the sources; last an evaluation. Each step is
    a stage of its own; texts are null-safe, a key has one row.
    """
    from loomspan.operators import parsing as P

    p = profile_of(profile)
    body = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    questions = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(q).alias("q")) for n, q in enumerate(QUESTIONS)))
    prompt = lambda q: F.concat(q, F.lit("\n---\n"), body)
    rows = df.select(key, title, text, F.explode(questions).alias("q")).select(key, F.col("q.n").alias("n"), prompt(F.col("q.q")).alias("prompt"))
    answers = conversed(rows, key, "n", "prompt", provider=p.provider, remember=p.remember)
    names = F.array(*(F.lit(q) for q in QUESTIONS))
    section = F.concat(F.lit("=== "), F.element_at(names, F.col("n") + 1), F.lit(" ===\n"), F.coalesce("answer", F.lit("none")))
    joined = answers.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", section.alias("s")))), lambda x: x["s"]), "\n").alias("sections"))
    found = joined.select(key, P.extraction(F.col("sections")).alias("extraction"))
    found = df.select(key, title, text).join(found, key).withColumn("traced", P.traced(F.col("extraction.formats"), F.col("extraction.sources")))
    trace = asked(found.filter("traced").select(key, prompt(F.lit("TRACE")).alias("prompt")), key, "prompt", provider=p.provider).withColumnRenamed("answer", "trace")
    judged = asked(found.select(key, prompt(F.lit("EVALUATE")).alias("prompt")), key, "prompt", provider=p.provider)
    return found.join(trace, key, "left").join(judged, key).select(key, "extraction", "traced", "trace", P.evaluation(F.col("answer")).alias("evaluation"))


# Labels of entities that refer to people, places, works and the like.
REFERENT = ("PERSON", "ORG", "GPE", "LOC", "WORK_OF_ART", "EVENT", "PRODUCT", "FAC", "NORP", "LAW", "LANGUAGE")
_NAMED = re.compile(r"(?<=[^.!?\s] )(?:[A-Z][a-z]+(?: [A-Z][a-z]+)*|[A-Z]{2,5})\b")
_KINDS = ((re.compile(r"(?:Bridge|Museum|Tower|Hall|Station|Airport)$"), "FAC"), (re.compile(r"(?:Lake|Bay|River|Mount|Island)\b"), "LOC"), (re.compile(r"^[A-Z]{2,5}$|(?:Inc|Ltd|Club|Studio|University)$"), "ORG"),
          (re.compile(r"^(?:January|February|March|April|May|June|July|August|September|October|November|December|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)$"), "DATE"), (re.compile(r"^[A-Z][a-z]+ [A-Z][a-z]+$"), "PERSON"))


def name_entities(text: str) -> list[tuple[str, str]]:
    """(label, text) of names within sentences, by rule: a stand-in for a model."""
    return [(next((label for pattern, label in _KINDS if pattern.search(m[0])), "GPE"), m[0]) for m in _NAMED.finditer(text)]


def entities(df: DataFrame, key: str, text: str, *, find: Callable[[str], list[tuple[str, str]]] = name_entities, labels: tuple[str, ...] = REFERENT, least: int = 30) -> DataFrame:
    """``key``, label, entity of the texts worth looking at (of some length), with the labels asked for.

    Short texts are filtered before Python sees them. ``find`` may be a model's function; it is shipped to the executors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, label, e) for k, t in zip(pdf[key], pdf[text]) for label, e in find(t) if label in labels], columns=[key, "label", "entity"])

    some = df.filter(F.length(text) >= least).select(key, text)
    return some.mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, label string, entity string")

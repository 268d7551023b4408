"""Requests to extraction models: prompts, retries, alignment of what they say with the text, linking and verification.

A model is a function registered by name (``models.register_model``): ``request`` takes a prompt and gives text or raises. Requests are rows; a request whose
attempts are used up gives a row with its error, never a failed job.

Defined results: null texts are not asked; an answer that is no JSON gives no extractions; an extraction that the text does not hold keeps null offsets; an empty
table gives no rows.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import dedupe_key
from quillstone.operators import models
from quillstone.operators.spans import chunks, folded, rebase
from quillstone.session import ship

LEAST_ALIGNED = 0.75
#: what an error has to say to be tried again
AGAIN = re.compile(r"\b(429|5\d\d)\b|overload|rate limit|timeout|timed out|unavailable", re.I)


@dataclass(frozen=True)
class Prompt:
    """What is asked about one kind of entity."""

    entity: str
    description: str
    fields: tuple[str, ...]
    extraction_class: str = ""
    version: str = ""
    examples: tuple[dict, ...] = ()
    overrides: dict = field(default_factory=dict)

    def text(self, document: str, target: str | None = None) -> str:
        """Description, the fields' own prompts, examples of the asked fields alone, the target entity, and the document."""
        notes = [f"- {name}: {self.overrides[name]}" for name in self.fields if name in self.overrides]
        shown = [json.dumps({"text": e.get("text", ""), "attributes": self.shown(e)}, ensure_ascii=False, sort_keys=True) for e in self.examples]
        parts = [self.description, "Fields: " + ", ".join(self.fields), *notes, *shown, *([f"Only about: {target}"] if target else []), document]
        return "\n".join(parts)

    def shown(self, example: dict) -> dict:
        return {k: v for k, v in (example.get("attributes") or {}).items() if k in self.fields}


def read_prompts(folder: str, entities: list[str]) -> dict[str, Prompt]:
    """One JSON file an entity; a missing file or key is an error."""
    found = {}
    for entity in entities:
        path = Path(folder, f"{entity}.json")
        if not path.exists():
            raise FileNotFoundError(path)
        data = json.loads(path.read_text())
        found[entity] = Prompt(
            data["entity"], data["prompt_description"], tuple(data["fields"]), data["extraction_class"], str(data["version"]), tuple(data["examples"]), dict(data.get("field_prompt_overrides") or {})
        )
    return found


def attempt(call: Callable[[], str], attempts: int = 5, least: float = 2.0, most: float = 30.0, sleep=time.sleep) -> tuple[str | None, str | None, int]:
    """(answer, error, attempts made): errors that may pass are tried again after a time that doubles, with jitter."""
    for n in range(1, attempts + 1):
        try:
            return call(), None, n
        except Exception as error:  # a model may raise anything
            said = f"{type(error).__name__}: {error}"
            if n == attempts or not AGAIN.search(said):
                return None, said, n
            sleep(min(most, least * 2 ** (n - 1)) * (0.5 + random.random() / 2))
    return None, "no attempt", 0


def asked(docs: DataFrame, prompts: dict[str, Prompt], passes: int = 1) -> DataFrame:
    """document_id, entity, pass and prompt: a request for each text, kind of entity and pass."""
    ship(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, e, n, p.text(t)) for d, t in zip(frame["document_id"], frame["text"]) if t is not None for e, p in prompts.items() for n in range(passes)]
            yield pd.DataFrame(rows, columns=["document_id", "entity", "pass", "prompt"])

    kind = docs.schema["document_id"].dataType.simpleString()
    return docs.select("document_id", "text").mapInPandas(run, f"document_id {kind}, entity string, pass int, prompt string")


def answered(requests: DataFrame, attempts: int = 5, least: float = 2.0, most: float = 30.0) -> DataFrame:
    """``requests`` (with ``prompt``) and answer, error and attempts. No model gives an error a row."""
    ship(requests.sparkSession)
    model = models._models.get("request")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [attempt(lambda p=p: model(p), attempts, least, most) if model else (None, "no model", 0) for p in frame["prompt"]]
            yield frame.drop(columns=["prompt"]).assign(answer=[x[0] for x in found], error=[x[1] for x in found], attempts=[x[2] for x in found])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields if f.name != "prompt")
    return requests.mapInPandas(run, f"{kinds}, answer string, error string, attempts int")


def align(text: str, said: str, least: float = LEAST_ALIGNED) -> tuple[int, int, str] | None:
    """Where a text holds an extraction: exactly, case aside, as a part of it that the text has (lesser), or by the most similar run of as many words."""
    if not text or not said or not said.strip():
        return None
    low, wanted = folded(text), folded(said)
    at = low.find(wanted)
    if at >= 0:
        return at, at + len(wanted), "match_exact"
    words, asked_words = [m.span() for m in re.finditer(r"\S+", low)], wanted.split()
    if not words:
        return None
    first = " ".join(asked_words[: max(1, round(len(asked_words) * least))])
    at = low.find(first) if len(asked_words) > 1 else -1
    if at >= 0:
        return at, at + len(first), "match_lesser"
    n, best = min(len(asked_words), len(words)), (0.0, 0)
    bag = set(asked_words)
    share = sum(low[a:b] in bag for a, b in words[:n])
    for i in range(len(words) - n + 1):
        if i:
            share += (low[slice(*words[i + n - 1])] in bag) - (low[slice(*words[i - 1])] in bag)
        if share >= n * least / 2:  # only runs that share words are compared letter by letter
            ratio = SequenceMatcher(None, low[words[i][0] : words[i + n - 1][1]], wanted, autojunk=False).ratio()
            best = max(best, (ratio, -i))
    if best[0] < least:
        return None
    return words[-best[1]][0], words[-best[1] + n - 1][1], "match_fuzzy"


EXTRACTED = "entity string, pass int, idx int, extraction_class string, extraction_text string, attributes map<string,string>, start int, end int, alignment_status string"


def extracted(answers: DataFrame, docs: DataFrame, least: float = LEAST_ALIGNED) -> DataFrame:
    """Extractions of answers (document_id, entity, pass, answer), aligned with their document's text; values of attributes stay JSON where they are no text."""
    ship(docs.sparkSession)
    kind = docs.schema["document_id"].dataType.simpleString()
    names = [x.split()[0] for x in re.sub("<[^>]*>", "", EXTRACTED).split(", ")]

    def items(answer: str | None) -> list[dict]:
        try:
            data = json.loads(answer or "")
        except ValueError:
            return []
        listed = data.get("extractions", []) if isinstance(data, dict) else data
        return [x for x in listed if isinstance(x, dict)] if isinstance(listed, list) else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                for i, x in enumerate(items(r.answer)):
                    said = str(x.get("extraction_text") or "")
                    place = align(r.text or "", said, least) or (None, None, None)
                    attributes = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in (x.get("attributes") or {}).items() if v is not None}
                    rows.append((r.document_id, r.entity, r.pass_no, i, x.get("extraction_class"), said, attributes, *place))
            out = pd.DataFrame(rows, columns=["document_id", *names])
            yield out.astype({"start": "Int32", "end": "Int32"})

    both = answers.select("document_id", "entity", F.col("pass").alias("pass_no"), "answer").join(docs.select("document_id", "text"), "document_id")
    return both.mapInPandas(run, f"document_id {kind}, {EXTRACTED}")


def to_link(records: DataFrame) -> DataFrame:
    """Records (document_id, n_entities, n_links) that need links: entities, and none yet."""
    return records.where((F.col("n_entities") > 0) & (F.coalesce("n_links", F.lit(0)) == 0))


def verified(records: DataFrame, results: DataFrame) -> DataFrame:
    """Records (document_id, record as JSON) with the corrected form of results (document_id, answer: corrected, changes); those without one stay, unverified."""
    told = results.select("document_id", F.get_json_object("answer", "$.corrected").alias("_new"), F.get_json_object("answer", "$.changes").alias("changes"))
    both = records.join(told, "document_id", "left")
    return both.select("document_id", F.coalesce("_new", "record").alias("record"), F.col("_new").isNotNull().alias("verified"), "changes")


def names_and_edges(names: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First of equal names (document_id, kind, pos, name) and of equal edges (document_id, kind, pos, source, target), case and spaces aside; blank ones go."""

    def once(rows: DataFrame, columns: list[str]) -> DataFrame:
        keys = [dedupe_key(F.col(c)) for c in columns]
        whole = rows.where(F.lit(True) if not keys else ~F.exists(F.array(*keys), lambda k: k.isNull()))
        rank = F.row_number().over(Window.partitionBy("document_id", "kind", *keys).orderBy("pos"))
        return whole.withColumn("_n", rank).where("_n = 1").drop("_n")

    return once(names, ["name"]), once(edges, ["source", "target"])


def entity_mentions(docs: DataFrame, most: int = 2048, overlap: int = 200, least: float = 0.5) -> DataFrame:
    """Mentions (document_id, chunk, kind, text, confidence, start, end) that the model ``ner`` (text to a list of kind, text, confidence, start, end) finds in chunks of
    each document, moved to document offsets; those below ``least`` go. No model gives no rows."""
    ship(docs.sparkSession)
    model = models._models.get("ner") or (lambda text: [])
    cut = chunks(docs, most, overlap)
    kind = docs.schema["document_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, c, *m) for d, c, t in zip(frame["document_id"], frame["chunk"], frame["text"]) for m in model(t)]
            yield pd.DataFrame(rows, columns=["document_id", "chunk", "kind", "text", "confidence", "start", "end"])

    found = cut.select("document_id", "chunk", "text").mapInPandas(run, f"document_id {kind}, chunk long, kind string, text string, confidence double, start long, end long")
    return rebase(found.where(F.col("confidence") >= least), cut)

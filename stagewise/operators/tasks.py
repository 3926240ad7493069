"""Model tasks as DataFrame operators: a provider answers prompts, answers are validated, failures retried with the reason."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from stagewise.shipping import ship


def render(template: str, **values: str) -> str:
    """The template with its {{names}} filled in; an error if one is left."""
    out = re.sub(r"\{\{(\w+)\}\}", lambda m: str(values.get(m[1], m[0])), template)
    if left := re.findall(r"\{\{(\w+)\}\}", template):
        missing = [n for n in left if n not in values]
        if missing:
            raise ValueError(f"no value for {', '.join(missing)}")
    return out


def extract_json(text: str):
    """The JSON of a fenced block, else from the first bracket to the last."""
    fenced = re.search(r"```(?:json)?\s*\n(.*?)```", text, re.S)
    body = fenced[1] if fenced else text
    at = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    end = max(body.rfind("}"), body.rfind("]"))
    if at < 0 or end < at:
        raise ValueError("no JSON in the answer")
    return json.loads(body[at : end + 1])


def required(fields: dict[str, type]) -> Callable[[object], None]:
    """A check that an answer is an object with these fields."""

    def check(answer: object) -> None:
        if not isinstance(answer, dict):
            raise ValueError("not an object")
        for name, kind in fields.items():
            if not isinstance(answer.get(name), kind):
                raise ValueError(f"{name} is no {kind.__name__}")

    return check


def sections(*names: str) -> Callable[[str], None]:
    """A check that a text has these headings, in any case."""

    def check(text: str) -> None:
        if missing := [n for n in names if n.lower() not in text.lower()]:
            raise ValueError(f"missing sections: {', '.join(missing)}")

    return check


#: Tiers, the lower first; waits in seconds before a call that broke off is repeated.
TIERS = ("low", "medium", "high")
WAITS = (2.0, 8.0)


def ladder(tiers: dict[str, str], model: str | None = None, tier: str | None = None, default: str = "medium", attempts: int = 3) -> list[str]:
    """Models for the attempts: a named model never changes; a tier's last attempt goes one tier up, if there is a model for that."""
    at = tier or default
    base = model or tiers[at]
    up = TIERS[min(TIERS.index(at) + 1, len(TIERS) - 1)]
    last = base if model or attempts < 2 else tiers.get(up, base)
    return [base] * (max(attempts, 1) - 1) + [last]


class Broken(Exception):
    """A call broke off on the way: the same prompt may be sent again."""


def sent(provider: Callable[[str], str], prompt: str, waits: Sequence[float] = WAITS) -> str:
    """The provider's raw answer; a call that broke off is repeated, unchanged, after each of the waits."""
    for wait in waits:
        try:
            return provider(prompt)
        except Broken:
            time.sleep(wait)
    return provider(prompt)


class Queue:
    """A provider that gives prepared answers in turn and keeps the prompts; an exception among them is raised."""

    def __init__(self, *answers: str | Exception) -> None:
        self.answers, self.prompts = list(answers), []

    def __call__(self, prompt: str) -> str:
        self.prompts.append(prompt)
        if not self.answers:
            raise LookupError("no answer is left")
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def ask(provider: Callable[[str], str] | Sequence[Callable[[str], str]], prompt: str, check: Callable, parse: Callable = extract_json, tries: int = 3, waits: Sequence[float] = WAITS):
    """The first valid answer; each further try tells what was wrong with the last. Providers in a list take one try each."""
    rungs = list(provider) if isinstance(provider, (list, tuple)) else [provider] * tries
    said = prompt
    for k, rung in enumerate(rungs):
        raw = sent(rung, said, waits)
        try:
            answer = parse(raw)
            check(answer)
            return answer
        except ValueError as e:
            if k + 1 == len(rungs):
                raise
            said = f"{prompt}\n\nThe last answer was not valid: {e}"


def run_task(df: DataFrame, key: str, template: str, inputs: list[str], provider: Callable[[str], str] | Sequence[Callable[[str], str]], fields: dict[str, type], tries: int = 3) -> DataFrame:
    """key, answer (JSON) and error of one task a row; a row that fails has no answer and says why."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = required(fields)
        for batch in batches:
            answers, errors = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                try:
                    answers.append(json.dumps(ask(provider, render(template, **dict(zip(inputs, row, strict=True))), check, tries=tries)))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[key, "answer", "error"])

    return df.select(key, *inputs).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, answer string, error string")

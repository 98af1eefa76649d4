"""Who fills in the fields: an extractor takes a text, a schema and a request, and returns a record and its usage."""

from __future__ import annotations

import random
import re
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field
from typing import Any, Protocol

from fieldspark.plans.config import Config
from fieldspark.plans.schema import Schema
from fieldspark.plans.validate import compiled, empty_required, pruned

Usage = dict[str, int]


class Extractor(Protocol):
    def extract(self, text: str, schema: Schema, prompt: str) -> tuple[Any, Usage]: ...


#: Field name (or its singular) to the pattern whose group 1, or whole, is the value.
RULES: dict[str, str] = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ipv4": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "license": r"(?:[Ll]icensed under|[Rr]eleased under) (?:the )?[^\n]*?(?:License(?:, [Vv]ersion [0-9.]*[0-9])?|CC [A-Z-]+ [0-9.]*[0-9])",
    "phone": r"\+[0-9][0-9 ()-]{6,}[0-9]",
    "url": r"https?://[^\s<>\"]+",
    "date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "token": r"\b(?:sk|ghp|AKIA)[-_A-Za-z0-9]{16,}",
}


@dataclass
class RuleExtractor:
    """Deterministic: each field by the pattern of its name, a list of all its distinct places or the first. Other fields are null."""

    rules: dict[str, str] = field(default_factory=lambda: dict(RULES))

    def _value(self, name: str, node: Schema, text: str) -> Any:
        if node.get("type") == "object":
            return {k: self._value(k, v, text) for k, v in node.get("properties", {}).items()}
        name = name.lower()
        pattern = self.rules.get(name) or self.rules.get(name.removesuffix("s"))
        if node.get("type") == "array":
            if node.get("items", {}).get("type") == "object":
                return []
            return [m.group() for m in re.finditer(pattern, text)] if pattern else []
        found = re.search(pattern, text) if pattern else None
        return found.group() if found else None

    def extract(self, text: str, schema: Schema, prompt: str) -> tuple[Any, Usage]:
        data = {k: self._value(k, v, text) for k, v in schema.get("properties", {}).items()}
        return data, {"requests": 1, "input_tokens": (len(text) + len(prompt)) // 4, "output_tokens": sum(len(str(v)) for v in data.values()) // 4}


@dataclass
class CallableExtractor:
    """Any function of (text, schema, prompt) that returns a record, or a record and its usage."""

    fn: Callable[[str, Schema, str], Any]

    def extract(self, text: str, schema: Schema, prompt: str) -> tuple[Any, Usage]:
        out = self.fn(text, schema, prompt)
        return out if isinstance(out, tuple) else (out, {"requests": 1})


@dataclass
class Answer:
    data: Any
    usage: Usage
    attempts: int
    rounds: int
    warnings: list[str]


#: A thread beside each thread that waits for answers; making one for each call takes longer than many calls do.
_beside = threading.local()


def _within(seconds: float, call: Callable[[], Any]) -> Any:
    if getattr(_beside, "pool", None) is None:
        _beside.pool = ThreadPoolExecutor(1)
    answer = _beside.pool.submit(call)
    try:
        return answer.result(seconds)
    except Late:
        if not answer.done():  # its thread is left to the call; the next one gets another
            _beside.pool.shutdown(wait=False, cancel_futures=True)
            _beside.pool = None
        raise TimeoutError(f"no answer within {seconds:g} s") from None


def _add(a: Usage, b: Usage) -> Usage:
    return {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}


def ask(extractor: Extractor, text: str, schema: Schema, prompt: str, config: Config, sleep: Callable[[float], None] = time.sleep, retriable: tuple[type[BaseException], ...] = (TimeoutError, ConnectionError, OSError, RuntimeError), check: Callable[[Any], list[str]] | None = None) -> Answer:
    """One answer: failed calls are tried again after a random, growing wait, and wrong answers are asked anew.

    After ``max_validation_rounds`` more rounds an answer is taken as it is, with a warning for each fault. check: the
    compiled schema, if there are many calls.
    """
    check = check or compiled(schema)
    usage, attempts, faults, data = {}, 0, [], None
    for round_ in range(config.max_validation_rounds + 1):
        request = prompt if not faults else "\n".join([prompt, "Correct the earlier answer:", *faults])
        for turn in range(max(1, config.max_retries)):
            attempts += 1
            try:
                direct = isinstance(extractor, RuleExtractor)
                data, used = extractor.extract(text, schema, request) if direct else _within(config.timeout_secs, lambda r=request: extractor.extract(text, schema, r))
                break
            except retriable:
                if turn + 1 >= config.max_retries:
                    raise
                sleep(random.uniform(0, min(10.0, 2.0**turn)))
        usage = _add(usage, used)
        faults = [f"{p}: required" for p in empty_required(data, schema)] or check(pruned(data, schema))
        if not faults:
            break
    return Answer(data, usage, attempts, round_, faults)

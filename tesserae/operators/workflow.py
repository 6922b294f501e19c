"""Control flow of answering a question: routing, expansion, the generate-and-judge loop, retries.

The transition rules are small pure functions; models, retrieval and search are callables that the
caller injects.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attempts, waits and the error codes with whether a retry can help.
MAX_ROUNDS, ATTEMPTS, FIRST_WAIT_S = 3, 3, 1.0
EMBED_WAIT_MS, EMBED_WAIT_MOST_MS = 1000, 8000
EMBED_BATCH, EMBED_TOKENS = 64, 8192
MAX_FAILURES = 3
ERROR_CODES = {
    "NO_PROVIDER_CONFIGURED": False,
    "EMBEDDING_MODEL_MISSING": False,
    "MODEL_CATALOG_EMPTY": False,
    "MODEL_NOT_FOUND": False,
    "LOCAL_SERVER_URL_MISSING": False,
    "PROVIDER_UNREACHABLE": True,
    "INVALID_API_KEY": False,
    "RATE_LIMIT_EXCEEDED": True,
    "PROVIDER_TIMEOUT": True,
    "CORS_BLOCKED": False,
    "STREAM_INTERRUPTED": True,
    "TOKEN_BUDGET_EXCEEDED": False,
    "GENERATION_FAILED": True,
    "VECTOR_STORE_CORRUPTED": False,
    "VECTOR_STORE_QUOTA_EXCEEDED": False,
    "WEB_SEARCH_PROVIDER_FAILED": True,
    "CODE_EXECUTION_ERROR": False,
    "UNKNOWN_ERROR": False,
}


def classify_status(status: Column) -> Column:
    """The error code of an HTTP status."""
    code = F.when(status.isin(401, 403), "INVALID_API_KEY").when(status == 429, "RATE_LIMIT_EXCEEDED")
    return code.when(status >= 500, "PROVIDER_UNREACHABLE").when(status == 404, "MODEL_NOT_FOUND").otherwise("UNKNOWN_ERROR")


def is_retryable(code: Column) -> Column:
    return code.isin([c for c, again in ERROR_CODES.items() if again])


def route_of(answer: Column) -> Column:
    """The data source that a router's JSON names; vectorstore if it cannot be read or names none."""
    return F.coalesce(F.nullif(F.get_json_object(answer, "$.datasource"), F.lit("")), F.lit("vectorstore"))


def fallback_of(source: Column) -> Column:
    return F.when(source == "vectorstore", "websearch").otherwise("vectorstore")


def says_yes(answer: Column) -> Column:
    return F.coalesce(F.lower(F.get_json_object(answer, "$.binary_score")) == "yes", F.lit(False))


def embed_wait_ms(attempt: Column, retry_after_s: Column) -> Column:
    return F.least(F.coalesce(retry_after_s * 1000, attempt * EMBED_WAIT_MS), F.lit(EMBED_WAIT_MOST_MS))


def embed_batches(tokens: Column) -> Column:
    """Batch number of each input of an array of estimated tokens, in order: full at EMBED_BATCH inputs or EMBED_TOKENS tokens."""
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("t"), F.array().cast("array<int>").alias("out"))

    def step(s, t):
        t = t.cast("long")
        full = (s["n"] >= EMBED_BATCH) | ((s["n"] > 0) & (s["t"] + t > EMBED_TOKENS))
        b = F.when(full, s["b"] + 1).otherwise(s["b"])
        return F.struct(b.alias("b"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, t).otherwise(s["t"] + t).alias("t"), F.concat(s["out"], F.array(b)).alias("out"))

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def embed_rejects(tokens: Column) -> Column:
    """Whether a call is refused because an input is too long."""
    return F.exists(tokens, lambda t: t > EMBED_TOKENS)


def expand_question(question: str, ask: Callable[[str], str]) -> str:
    """The question with a hypothetical passage behind it, or alone if none comes."""
    try:
        passage = (ask(question) or "").strip()
    except Exception:  # noqa: BLE001  the question alone is the answer to any failure
        passage = ""
    return f"{question}\n\n{passage}" if passage else question


def with_retry(call: Callable[[], object], retryable: Callable[[Exception], bool], sleep: Callable[[float], None] = time.sleep) -> object:
    for attempt in range(ATTEMPTS):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if attempt == ATTEMPTS - 1 or not retryable(e):
                raise
            sleep(FIRST_WAIT_S * 2**attempt)


@dataclass
class Circuit:
    """Opens after several failures of a provider in a row."""

    failures: int = 0

    def record(self, ok: bool) -> None:
        self.failures = 0 if ok else self.failures + 1
        if self.failures >= MAX_FAILURES:
            raise RuntimeError("PROVIDER_UNREACHABLE: too many failures in a row")


@dataclass
class Run:
    """One question on its way; steps are (name, detail) in order."""

    question: str
    source: str = "vectorstore"
    answer: str = ""
    retries: int = 0
    context: str = ""
    steps: list[tuple[str, str]] = field(default_factory=list)


def answer_question(question: str, route: Callable[[str], str], retrieve: Callable[[str, str], str], generate: Callable[[str, str], str], judges: tuple[Callable[[str, str], str], Callable[[str, str], str]], rounds: int = MAX_ROUNDS) -> Run:
    """Route, retrieve, then generate and judge up to `rounds` times, changing source after each failure.

    judges answer JSON with binary_score about (context, answer) and (question, answer); a judge that
    fails counts as content, an empty context as not.
    """
    run = Run(question)
    try:
        run.source = (json.loads(route(question) or "{}") or {}).get("datasource") or "vectorstore"
    except (ValueError, AttributeError):
        run.source = "vectorstore"
    run.steps.append(("route", run.source))
    run.context = retrieve(run.source, question)
    yes = lambda text: str(json.loads(text or "{}").get("binary_score") or "").lower() == "yes"
    useful = False
    while not useful and run.retries < rounds:
        if run.context:
            run.answer = generate(run.context, question)
            run.steps.append(("generate", run.source))
            try:
                useful = yes(judges[0](run.context, run.answer)) and yes(judges[1](question, run.answer))
            except Exception:  # noqa: BLE001  a broken judge must not loop
                useful = True
        else:
            run.answer = "I couldn't find relevant information to answer your question."
            run.steps.append(("generate", "no context"))
        run.steps.append(("evaluate", "useful" if useful else "not useful"))
        if not useful:
            run.retries += 1
            run.source = "websearch" if run.source == "vectorstore" else "vectorstore"
            run.steps.append(("decide", run.source))
            run.context = retrieve(run.source, question)
    return run

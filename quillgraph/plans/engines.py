"""Extraction engines: what runs in a worker to turn a chunk into propositions.

An engine is an object with id, model, extract(chunk, context) and, optionally,
suggest_title(excerpt). It is pickled to the workers, where init() and dispose() frame its
use. Two here need no model: one by rule, one that replays stored replies. ChatEngine talks to
any chat-completions endpoint.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from ..functions.taxonomy import ENTITY_TYPES
from ..operators.chunking import _BLANKS
from ..operators.extraction import EXTRACTION_SCHEMA, MAX_ATTEMPTS, RETRY_PROMPT, SYSTEM_PROMPT, TITLE_PROMPT, strict_schema, user_prompt_text

READY, DOWNLOADABLE, UNAVAILABLE = "ready", "downloadable", "unavailable"


class FatalEngineError(Exception):
    """No retry and no later chunk can succeed."""


@dataclass
class ChunkContext:
    index: int
    title: str | None = None
    prior_entities: list[str] = field(default_factory=list)
    document: str | None = None


class ExtractionEngine(Protocol):
    id: str
    model: str

    def availability(self) -> str: ...
    def init(self) -> None: ...
    def extract(self, chunk: str, context: ChunkContext) -> list[dict]: ...
    def dispose(self) -> None: ...


# -- validation of one reply, for engines that talk to a model in a worker -----


def _no_constant(name: str):
    raise ValueError(name)


def parse_reply(reply: str) -> list[dict] | None:
    """The well-formed propositions of a reply, or None if it can't be used; as extraction.parse_replies."""
    text = reply.strip(_BLANKS)
    if not text.startswith("{"):
        m = re.search(r"\{[\s\S]*\}", text)
        text = m[0] if m else ""
    try:
        got = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    items = got.get("propositions") if isinstance(got, dict) else None
    if not isinstance(items, list):
        return None

    def clean(value) -> str | None:
        return (value.strip(_BLANKS) or None) if isinstance(value, str) else None

    def mention(value) -> dict | None:
        if not isinstance(value, dict) or not (name := clean(value.get("name"))):
            return None
        kind = value.get("type")
        return {"name": name, "type": kind if isinstance(kind, str) and kind in ENTITY_TYPES else "other"}

    out = []
    for i, item in enumerate(items):
        if not isinstance(item, dict):
            continue
        p = {"local_id": item["id"] if isinstance(item.get("id"), str) and item["id"] else f"p{i + 1}", "text": clean(item.get("text")), "subject": mention(item.get("subject")), "predicate": clean(item.get("predicate")), "object": mention(item.get("object")), "confidence": None}
        score = item.get("confidence")
        if isinstance(score, int | float) and not isinstance(score, bool) and 0 <= score <= 1:
            p["confidence"] = float(score)
        if p["text"] and p["predicate"] and p["subject"] and p["object"]:
            out.append(p)
    return out


def extract_with_retries(ask: Callable[[list[dict]], str], chunk: str, context: ChunkContext, *, attempts: int = MAX_ATTEMPTS) -> list[dict]:
    """Ask, and ask again with the failed reply and a correction, up to `attempts` times."""
    talk = [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": user_prompt_text(chunk, context.title, context.prior_entities)}]
    reply = ""
    for _ in range(attempts):
        reply = ask(talk)
        if (got := parse_reply(reply)) is not None:
            return got
        talk = [*talk, {"role": "assistant", "content": reply}, {"role": "user", "content": RETRY_PROMPT}]
    raise ValueError(f"no usable reply for chunk {context.index} in {attempts} tries; the last one begins {reply[:80]!r}")


# -- engines -------------------------------------------------------------------

_SENTENCE = re.compile(r"[^.!?]+[.!?]?")
_WORD = re.compile(r"[^\s,;:()\"“”]+")


class RuleEngine:
    """A proposition a sentence: first word, the words between as predicate, last word. Deterministic and offline.

    Sentences of fewer than three words have no proposition; max_words, if given, leaves out
    longer ones. The last sentence of a chunk needs no stop.
    """

    id, model = "rule", "first-last"

    def __init__(self, max_words: int | None = None):
        self.max_words = max_words

    def availability(self) -> str:
        return READY

    def init(self) -> None: ...

    def dispose(self) -> None: ...

    def extract(self, chunk: str, context: ChunkContext) -> list[dict]:
        out = []
        for sentence in _SENTENCE.findall(chunk):
            words = _WORD.findall(sentence.rstrip(".!?"))
            if len(words) >= 3 and (self.max_words is None or len(words) <= self.max_words):
                out.append({"local_id": f"p{len(out) + 1}", "text": " ".join(sentence.split()), "subject": {"name": words[0], "type": "concept"}, "predicate": " ".join(words[1:-1]), "object": {"name": words[-1], "type": "concept"}, "confidence": None})
        return out

    def suggest_title(self, excerpt: str) -> str:
        return " ".join(excerpt.split()[:8])


class ReplayEngine:
    """Replies from a list for each chunk index: strings to validate, or exceptions to raise."""

    id, model = "replay", "stored"

    def __init__(self, replies: dict[int, list], title: str | None = None):
        self.replies, self.title = replies, title

    def availability(self) -> str:
        return READY

    def init(self) -> None: ...

    def dispose(self) -> None: ...

    def extract(self, chunk: str, context: ChunkContext) -> list[dict]:
        stored = list(self.replies.get(context.index, []))

        def ask(_: list[dict]) -> str:
            reply = stored.pop(0) if stored else ""
            if isinstance(reply, Exception):
                raise reply
            return reply

        return extract_with_retries(ask, chunk, context)

    def suggest_title(self, excerpt: str) -> str:
        if self.title is None:
            raise ValueError("no title stored")
        return self.title


@dataclass
class HttpReply:
    status: int
    body: str
    retry_after: str | None = None


def _post(url: str, headers: dict, payload: dict) -> HttpReply:
    request = urllib.request.Request(url, json.dumps(payload).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=300) as r:
            return HttpReply(r.status, r.read().decode())
    except urllib.error.HTTPError as e:
        return HttpReply(e.code, e.read().decode(errors="replace"), e.headers.get("Retry-After"))


class ChatEngine:
    """A chat-completions endpoint, at temperature 0 and with a strict output schema.

    models: one id, or several that the endpoint may fall back on in order. A 429 is waited
    out up to three times, for the time it names (15 s if none, 65 s at most). A 400 that
    blames the schema switches to plain prompting for good. 401, 402 and a lasting 429 are fatal.
    """

    id = "chat"

    def __init__(self, url: str, key: str, models: tuple[str, ...] | str, *, post: Callable[[str, dict, dict], HttpReply] = _post, sleep: Callable[[float], None] = time.sleep):
        self.url, self.key, self.post, self.sleep = url, key.strip(), post, sleep
        self.models = (models,) if isinstance(models, str) else tuple(models)
        self.model = self.models[0] if len(self.models) == 1 else "auto"
        self.schema_accepted = True

    def availability(self) -> str:
        return READY if self.key else UNAVAILABLE

    def init(self) -> None:
        if not self.key:
            raise FatalEngineError("the key is missing")

    def dispose(self) -> None: ...

    def ask(self, messages: list[dict], constrained: bool = True) -> str:
        waits = 0
        while True:
            with_schema = constrained and self.schema_accepted
            payload: dict = {"messages": messages, "temperature": 0}
            payload |= {"model": self.models[0]} if len(self.models) == 1 else {"models": list(self.models)}
            if with_schema:
                payload["response_format"] = {"type": "json_schema", "json_schema": {"name": "extraction", "strict": True, "schema": strict_schema(EXTRACTION_SCHEMA)}}
            got = self.post(self.url, {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}, payload)
            if got.status == 429 and waits < 3:
                waits += 1
                try:
                    seconds = float(got.retry_after or 0)
                except ValueError:
                    seconds = 0
                self.sleep(min(seconds if seconds > 0 else 15, 65))
            elif got.status == 400 and with_schema and re.search("schema|response_format|structured", got.body, re.IGNORECASE):
                self.schema_accepted = False
            elif got.status in (401, 402, 429):
                raise FatalEngineError({401: "the key was rejected (401)", 402: "credits are used up (402)", 429: "still rate limited after waiting (429)"}[got.status])
            elif not 200 <= got.status < 300:
                raise RuntimeError(f"the endpoint refused with status {got.status}, saying {got.body[:400]!r}")
            else:
                choices = json.loads(got.body).get("choices") or [{}]
                return (choices[0].get("message") or {}).get("content") or ""

    def extract(self, chunk: str, context: ChunkContext) -> list[dict]:
        return extract_with_retries(self.ask, chunk, context)

    def suggest_title(self, excerpt: str) -> str:
        return self.ask([{"role": "user", "content": f"{TITLE_PROMPT}\n\n{excerpt}"}], constrained=False)


ENGINES: dict[str, Callable[..., ExtractionEngine]] = {"rule": RuleEngine, "replay": ReplayEngine, "chat": ChatEngine}
LOCAL_ENGINES = ("rule", "replay")


def register_engine(name: str, factory: Callable[..., ExtractionEngine]) -> None:
    ENGINES[name] = factory


def create_engine(name: str, **options) -> ExtractionEngine:
    if name not in ENGINES:
        raise ValueError(f"no engine {name!r}; there are {sorted(ENGINES)}")
    return ENGINES[name](**options)


def check_availability(options: dict[str, dict]) -> dict[str, str]:
    """Availability of each engine named, made with its options."""
    return {name: create_engine(name, **o).availability() for name, o in options.items()}


def private_engine(availability: dict[str, str], preference: tuple[str, ...] = LOCAL_ENGINES) -> str:
    """The first engine of the preference that isn't unavailable, else the last of it: data stays on the cluster."""
    return next((n for n in preference if availability.get(n, UNAVAILABLE) != UNAVAILABLE), preference[-1])

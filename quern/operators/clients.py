"""Language models behind a call (system, user) -> Reply: an HTTP client of chat completions, and a scripted stand-in."""

from __future__ import annotations

import json
import socket
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from quern.functions.tokens import estimate
from quern.operators.generation import Reply, Retryable


class ModelError(RuntimeError):
    """A failure that another attempt would not mend."""


def seconds(header: str | None) -> float | None:
    """The wait of a Retry-After header in seconds; a date counts as none."""
    try:
        return max(0.0, float(header)) if header else None
    except ValueError:
        return None


@dataclass(frozen=True)
class ChatClient:
    """Chat completions of an endpoint, called in the tasks.

    Time-outs, broken connections, statuses 429 and 500 and above, and replies that can't be read raise Retryable; other
    statuses from 400 on raise ModelError. ``generation.with_retry`` adds the attempts.
    """

    url: str
    model: str
    key: str | None = None
    max_tokens: int = 512
    temperature: float = 0.0
    timeout_s: float = 60.0

    def __call__(self, system: str, user: str) -> Reply:
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "max_tokens": self.max_tokens, "temperature": self.temperature}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        began = time.perf_counter()
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as r:
                raw = r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            text = e.read().decode("utf-8", "replace")[:200]
            if e.code == 429:
                raise Retryable("rate limited", seconds(e.headers.get("Retry-After"))) from e
            raise (Retryable if e.code >= 500 else ModelError)(f"HTTP {e.code}: {text}") from e
        except (urllib.error.URLError, socket.timeout, ConnectionError) as e:
            raise Retryable(f"no reply from {self.url}: {getattr(e, 'reason', e)}") from e
        try:
            found = json.loads(raw)
            used = found.get("usage") or {}
            content = found["choices"][0]["message"]["content"] or ""
            return Reply(content, found.get("model") or self.model, int(used.get("prompt_tokens", 0)), int(used.get("completion_tokens", 0)), time.perf_counter() - began)
        except (ValueError, KeyError, IndexError, TypeError, AttributeError) as e:
            raise Retryable(f"malformed reply: {raw[:200]}") from e


@dataclass
class Scripted:
    """Replies from a queue, then from ``responder``; an exception in the queue is raised. Keeps what it was asked."""

    replies: Iterable[str | Exception] = ()
    responder: Callable[[str, str], str] = lambda system, user: "ok"
    model: str = "scripted"
    asked: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.replies = deque(self.replies)

    def __call__(self, system: str, user: str) -> Reply:
        self.asked.append((system, user))
        reply = self.replies.popleft() if self.replies else self.responder(system, user)
        if isinstance(reply, Exception):
            raise reply
        if not isinstance(reply, str):
            raise ModelError(f"a reply must be text, not {type(reply).__name__}")
        return Reply(reply, self.model, estimate(system) + estimate(user), estimate(reply))

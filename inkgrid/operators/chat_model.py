"""A translator that asks a chat server over HTTP.

The server's answers decide what becomes of a failure: one that can't be
reached (refused, timed out while connecting, 502, 503) is lost for the whole
run; any other failed, empty or malformed answer is the failure of that
request alone, which the ladder of ``translate`` handles.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request

from inkgrid.operators.translate import ConnectionLost, tidy, with_model
from inkgrid.plans.pipeline import register

# Sampling options of a request, statuses of a server that is away.
OPTIONS = {"temperature": 0.3, "top_p": 0.8, "num_ctx": 4096}
AWAY = (502, 503)
TIMEOUT = 120  # seconds


class BadAnswer(RuntimeError):
    """A request failed or its answer is of no use; the server is there."""


def unfenced(text: str) -> str:
    """The Python form of ``functions.text.strip_fence``."""
    t = text.strip()
    if not t.startswith("```"):
        return t
    body = t.partition("\n")[2] if "\n" in t else t[3:]
    return re.sub(r"```\Z", "", body).strip()


def asker(url: str, model: str, system: str, source: str, target: str, timeout: float = TIMEOUT):
    """``ask(text, context, stop, max_tokens)`` over HTTP."""

    def ask(text: str, context: str, stop: list[str] | None, max_tokens: int) -> str:
        said = f"Translate from {source} to {target}:\n{text}"
        if context.strip():
            said = f"Earlier lines:\n{context.strip()}\n\n{said}"
        body = {"model": model, "stream": False, "think": False, "options": {**OPTIONS, "num_predict": max_tokens, **({"stop": stop} if stop else {})}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": said}]}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                raw = r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            kind = ConnectionLost if e.code in AWAY else BadAnswer
            raise kind(f"{url} answered {e.code}: {e.read()[:500]!r}") from e
        except urllib.error.URLError as e:
            if isinstance(e.reason, (ConnectionError, OSError)) and not isinstance(e.reason, TimeoutError):
                raise ConnectionLost(f"{url} can't be reached: {e.reason}") from e
            raise BadAnswer(f"{url}: {e.reason}") from e
        except ConnectionError as e:
            raise ConnectionLost(f"{url} broke off: {e}") from e
        except TimeoutError as e:
            raise BadAnswer(f"{url} took more than {timeout} s") from e
        if not raw.strip():
            raise BadAnswer(f"{url} answered nothing")
        try:
            content = json.loads(raw)["message"]["content"]
            reply = unfenced(content)
        except (KeyError, TypeError, ValueError, AttributeError) as e:
            raise BadAnswer(f"{url}: no content in {raw[:500]!r}") from e
        if not tidy(reply):
            raise BadAnswer(f"{url}: the content has no text")
        return reply

    return ask


def filled(template: str, source: str, target: str) -> str:
    """The Python form of ``functions.text.fill_template``."""
    for name, value in (("source_language", source), ("target_language", target), ("context", "")):
        template = template.replace("{{" + name + "}}", value)
    return template.strip()


@register("translator", "chat")
def chat(url: str, model: str, source: str, target: str, template: str = "You translate {{source_language}} into {{target_language}}.", batch: int = 8, timeout: float = TIMEOUT):
    """Plug-in for ``plans.pipeline``; one connection is made a request, in the worker that has its rows."""
    return with_model(lambda: asker(url, model, filled(template, source, target), source, target, timeout), batch)

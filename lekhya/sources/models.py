"""Language models that answer with JSON: contract, services, retries, choice.

A model is a function from a text to its answer.  ``local_model`` asks a chat
service at an address; a hosted one is any function, as clients need keys and
packages that the engine does not have.  Services differ in what may be tried
again and how long to wait: that is a ``Policy``.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from lekhya.operators.entities import MIN_STEP_WORDS, resolve_model

#: What the model is told: the fields that ``entities.parse_variant`` reads.
CONTRACT = (
    "You read one clause of a law or notice and report what it asks of a person who wants something registered or permitted. "
    "Answer with one JSON object and nothing else. Its keys: "
    '"office" (string, the office that decides, as named in the clause), '
    '"documents_required" (list of strings, papers to hand in), '
    f'"steps" (list of strings, each an action in at least {MIN_STEP_WORDS} words), '
    '"price" (string, the fee with its currency), '
    '"duration_days" (string, the period with its unit), '
    '"prerequisites" (string, what must hold before). '
    "Copy the words of the clause, in its language. Use null or an empty list for what it does not say; never guess, and leave out penalties and references to other clauses."
)


@dataclass(frozen=True)
class Policy:
    """When and how a failed call is made again."""

    retries: int = 5
    wait: Callable[[int], float] = lambda attempt: 2.0 * attempt
    again: Callable[[Exception], bool] = lambda error: True
    delay: float = 0.0


def overloaded(error: Exception) -> bool:
    """Does the error speak of a limit of calls or a failing server?"""
    return any(code in str(error) for code in ("429", "500", "502", "503"))


LOCAL = Policy()
HOSTED = Policy(wait=lambda attempt: 3.0**attempt, again=overloaded, delay=2.0)


def installed_models(host: str, timeout: float = 1.5) -> list[str]:
    """Names of the models of a local service; none if it does not answer."""
    try:
        with urllib.request.urlopen(f"{host.rstrip('/')}/api/tags", timeout=timeout) as got:
            return [m["name"] for m in json.load(got).get("models", []) if m.get("name")]
    except (OSError, ValueError):
        return []


def local_model(host: str, model: str, timeout: float = 180.0) -> Callable[[str], str | None]:
    """The extractor that asks a local chat service for JSON."""
    url = f"{host.rstrip('/')}/api/chat"

    def ask(text: str) -> str | None:
        said = [{"role": "system", "content": CONTRACT}, {"role": "user", "content": text}]
        body = json.dumps({"model": model, "messages": said, "format": "json", "stream": False}).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as got:
            return json.load(got).get("message", {}).get("content")

    return ask


def chosen(provider: str, host: str, model: str | None, hosted: Callable[[str], str | None] | None = None) -> tuple[Callable[[str], str | None], Policy]:
    """(extractor, policy) of "auto", "local" or "hosted".

    Auto is local where the service has a model, else hosted; hosted without a
    function and any other name are errors.
    """
    if provider not in ("auto", "local", "hosted"):
        raise ValueError(f"unknown provider: {provider}")
    have = installed_models(host) if provider != "hosted" else []
    if provider == "local" or have:
        name = resolve_model(model, have) or model
        if not name:
            raise ValueError(f"no model at {host}")
        return local_model(host, name), LOCAL
    if hosted is None:
        raise ValueError("a hosted model needs a function that asks it")
    return hosted, HOSTED


def device() -> tuple[str, bool]:
    """(device, half precision) for an encoder on this worker: a GPU with half precision if there is one."""
    try:
        import torch
    except ImportError:
        return "cpu", False
    if torch.cuda.is_available():
        return "cuda", True
    return ("mps", False) if getattr(torch.backends, "mps", None) is not None and torch.backends.mps.is_available() else ("cpu", False)

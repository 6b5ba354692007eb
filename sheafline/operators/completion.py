"""Asking an outside model for a document, where one is given; nothing is asked by default.

A completion is a function: prompt -> text or None. It runs on the executors, in
batches, by way of a table of answers (``answers.answer_once``).
"""

from __future__ import annotations

import os
from collections.abc import Callable

#: Fixed values of a request.
TEMPERATURE, MAX_TOKENS = 0.3, 4000
SYSTEM = "You are an expert at creating AI coding agent rules. You create specific, example-driven rules that follow best practices for Cursor and Claude Code."


def openai_completion(model: str, key: str | None) -> Callable[[str], str | None]:
    def ask(prompt: str) -> str | None:
        secret = key or os.getenv("OPENAI_API_KEY")
        if not secret:
            return None
        try:
            import openai

            got = openai.OpenAI(api_key=secret).chat.completions.create(
                model=model, messages=[{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}], temperature=TEMPERATURE, max_tokens=MAX_TOKENS
            )
            return got.choices[0].message.content.strip()
        except Exception:  # any failure means: use the template
            return None

    ask.model = f"openai/{model}"
    return ask


def anthropic_completion(model: str, key: str | None) -> Callable[[str], str | None]:
    def ask(prompt: str) -> str | None:
        secret = key or os.getenv("ANTHROPIC_API_KEY")
        if not secret:
            return None
        try:
            import anthropic

            got = anthropic.Anthropic(api_key=secret).messages.create(
                model=model, system=SYSTEM, messages=[{"role": "user", "content": prompt}], temperature=TEMPERATURE, max_tokens=MAX_TOKENS
            )
            return got.content[0].text.strip()
        except Exception:  # any failure means: use the template
            return None

    ask.model = f"anthropic/{model}"
    return ask


def completion(provider: str, model: str, openai_key: str | None = None, anthropic_key: str | None = None) -> Callable[[str], str | None] | None:
    """The provider's completion; None for ``none`` and unknown providers."""
    if provider == "openai":
        return openai_completion(model, openai_key)
    if provider == "anthropic":
        return anthropic_completion(model, anthropic_key)
    return None

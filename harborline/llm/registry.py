"""The subpackage's modules with QUERIES and SQL."""

from __future__ import annotations

from harborline.llm import language, mixture, nearest_time, tokenize


def modules() -> list:
    return [nearest_time, tokenize, mixture, language]

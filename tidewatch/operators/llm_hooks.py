"""Summaries and filters by an outside model, in Arrow batches, with the rule that holds where the model fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

EXCERPT = 400


def excerpt(title: str | None, body: str | None) -> str:
    """A body under 30 characters is its own summary, or the title where it is empty; else its first 400 characters."""
    body = (body or "").strip()
    return (body or title or "") if len(body) < 30 else body[:EXCERPT]


def summarised(posts: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """post_id and summary; long bodies go to the model, and where that fails the excerpt stands."""

    def one(title: str | None, body: str | None) -> str:
        if model is None or len((body or "").strip()) < 30:
            return excerpt(title, body)
        try:
            return model(body)
        except Exception:  # whatever a model raises, a digest goes out
            return excerpt(title, body)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"post_id": rows["post_id"], "summary": [one(t, b) for t, b in zip(rows["title"], rows["text"], strict=True)]})

    return posts.select("post_id", "title", "text").mapInPandas(step, "post_id string, summary string")


def filtered(posts: DataFrame, model: Callable[[str, str], bool]) -> DataFrame:
    """The posts that the model lets pass for their prompt; an empty prompt or a failing model lets all pass."""

    def passes(prompt: str | None, text: str | None) -> bool:
        if not prompt:
            return True
        try:
            return bool(model(prompt, text or ""))
        except Exception:  # open where it fails
            return True

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[[passes(p, t) for p, t in zip(rows["prompt"], rows["text"], strict=True)]]

    return posts.mapInPandas(step, posts.schema)

"""Class probabilities of texts by pluggable scorers, in one pass over the posts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_column


class TextScorer(Protocol):
    """labels: class names; score(texts): a probability for each text and label. Built anew in each worker."""

    labels: list[str]

    def score(self, texts: list[str]) -> list[list[float]]: ...


class LexiconScorer:
    """Shares of listed words, for runs without a model: a class's hits + 1 over all hits + classes."""

    def __init__(self, lexicon: dict[str, list[str]]):
        self.labels, self.words = list(lexicon), [frozenset(v) for v in lexicon.values()]

    def score(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            words = (t or "").lower().split()
            hits = [1 + sum(w in ws for w in words) for ws in self.words]
            out.append([h / sum(hits) for h in hits])
        return out


def score_affect(posts: DataFrame, sentiment: TextScorer, emotion: TextScorer, toxicity: TextScorer, post: str = "post_id", text: str = "body_clean", ids: DataFrame | None = None) -> DataFrame:
    """(post, sentiment_label, sentiment_score, a column for each class). Each post once; the first label wins a tie."""
    rows = posts.select(post, text)
    if ids is not None:
        rows = rows.join(ids.select(post), post, "left_semi")
    prefixes = ((sentiment, "sentiment_"), (emotion, "emotion_"), (toxicity, "toxicity_"))
    columns = [label_column(x, p) for s, p in prefixes for x in s.labels]
    kind = rows.schema[post].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b[text].fillna("").tolist()
            scores = [s.score(texts) for s, _ in prefixes]
            out = pd.DataFrame([[x for part in row for x in part] for row in zip(*scores, strict=True)], columns=columns, index=b.index)
            best = [max(range(len(r)), key=lambda k: (r[k], -k)) for r in scores[0]]
            out.insert(0, post, b[post])
            out.insert(1, "sentiment_label", [sentiment.labels[k] for k in best])
            out.insert(2, "sentiment_score", [r[k] for r, k in zip(scores[0], best, strict=True)])
            yield out

    return rows.where(F.col(post).isNotNull()).dropDuplicates([post]).mapInPandas(run, f"{post} {kind}, sentiment_label string, sentiment_score double, " + ", ".join(f"{c} double" for c in columns))

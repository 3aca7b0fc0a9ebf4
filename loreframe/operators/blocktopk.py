"""Best k rows per query out of numpy scores of a block of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

QUERIES_PER_BLOCK = 2048
_STEP = 2048
_BITS = 12
_NO_MATCH = -(1 << 62)

Scorer = Callable[[pd.DataFrame], np.ndarray]


def _best(block: pd.DataFrame, scores: np.ndarray, query_ids: np.ndarray, k: int) -> pd.DataFrame:
    """Best k rows per query column; ``block`` is already in tie order, NaN means no match."""
    n = len(block)
    valid = ~np.isnan(scores)
    scaled = np.rint(np.where(valid, scores, 0.0) * 1e9).astype(np.int64)
    place = np.arange(n - 1, -1, -1, dtype=np.int64)[:, None]
    key = np.where(valid, (scaled << _BITS) + place, _NO_MATCH)
    keep = min(k, n)
    top = np.argpartition(-key, keep - 1, axis=0)[:keep]
    cols = np.broadcast_to(np.arange(scores.shape[1]), top.shape)
    rows, cols = top.ravel(), cols.ravel()
    hit = valid[rows, cols]
    rows, cols = rows[hit], cols[hit]
    return pd.DataFrame(
        {
            "query_id": query_ids[cols],
            "id": block["id"].to_numpy()[rows],
            "tie": block["tie"].to_numpy()[rows],
            "score": np.round(scores[rows, cols], 9),
        }
    )


def _trim(frames: list[pd.DataFrame], k: int) -> pd.DataFrame:
    merged = pd.concat(frames, ignore_index=True)
    merged = merged.sort_values(["query_id", "score", "tie", "id"], ascending=[True, False, False, True])
    best = merged.groupby("query_id", sort=False).head(k)
    # concatenated string columns may be chunked; the Arrow writer wants one plain array
    return best.assign(id=best["id"].astype(object)).reset_index(drop=True)


def _score_rows(
    batches: Iterator[pd.DataFrame], scorer: Scorer, query_ids: np.ndarray, k: int
) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for batch in batches:
        ordered = batch.sort_values(["tie", "id"], ascending=[False, True])
        for start in range(0, len(ordered), _STEP):
            block = ordered.iloc[start : start + _STEP]
            held.append(_best(block, scorer(block), query_ids, k))
        if len(held) > 16:
            held = [_trim(held, k)]
    best = _trim(held, k) if held else pd.DataFrame()
    if len(best):
        yield best

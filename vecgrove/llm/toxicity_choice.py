"""Chooses the toxicity learner's strengths by cross-validation that never sees the held-out fold.

``python -m vecgrove.llm.toxicity_choice DIR`` reads ``documents`` and ``labels`` of DIR on one machine
and prints every setting of the grid, best first. The three folds other than the held-out one take turns
as the validation fold; the setting with the best mean F1 at the contract's threshold wins, ties going to
the lower log loss. Rows of the held-out fold are removed before anything else is done. It is a tool for
development, not part of any query.
"""

from __future__ import annotations

import sys
from concurrent.futures import ProcessPoolExecutor
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq

from vecgrove.llm.toxicity import HELD_OUT, THRESHOLD, Hasher, train_ftrl

BITS = 22
GRID = [dict(alpha=a, l1=l, l2=r, epochs=4) for a, l, r in product((0.3, 1.0, 2.0, 4.0, 8.0, 16.0), (4.0, 6.0, 9.0, 13.0, 18.0), (0.5, 2.0))]
FOLDS = [f for f in range(4) if f != HELD_OUT]

Row = tuple[int, np.ndarray, int]


def load(folder: str) -> list[Row]:
    """(fold, distinct features, label) of the labelled documents outside the held-out fold, in the learner's order."""
    labels = pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", "toxic"]).to_pylist()
    toxic: dict[int, int] = {}
    for r in labels:
        i = r["doc_id"]
        if i is not None and r["toxic"] is not None and crc32(str(i).encode()) % 4 != HELD_OUT:
            toxic[i] = max(toxic.get(i, 0), int(r["toxic"] > 0))
    hashed, rows = Hasher(BITS), []
    for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        if r["doc_id"] in toxic:
            i = r["doc_id"]
            rows.append((crc32(str(i).encode()), np.unique(hashed(r["text"])), toxic[i]))
    rows.sort(key=lambda r: r[0])
    return [(h % 4, x, y) for h, x, y in rows]


def trial(rows: list[Row], setting: dict) -> tuple[float, float]:
    """Mean F1 and mean log loss over the validation folds."""
    f1, loss = [], []
    for fold in FOLDS:
        m = train_ftrl([(x, y) for f, x, y in rows if f != fold], BITS, **setting)
        w = m.dense()
        seen = [(x, y) for f, x, y in rows if f == fold]
        raw = np.array([m.bias + float(w[x].sum(dtype=np.float64)) for x, _ in seen])
        p, y = 1 / (1 + np.exp(-np.clip(raw, -35, 35))), np.array([y for _, y in seen])
        hit = int(((p >= THRESHOLD) & (y == 1)).sum())
        f1.append(2 * hit / max(1, int((p >= THRESHOLD).sum()) + int(y.sum())))
        q = np.clip(np.where(y == 1, p, 1 - p), 1e-12, 1)
        loss.append(float(-np.log(q).mean()))
    return float(np.mean(f1)), float(np.mean(loss))


def _run(args: tuple[str, dict]) -> tuple[float, float, dict]:
    return (*trial(load(args[0]), args[1]), args[1])


def main(folder: str) -> None:
    with ProcessPoolExecutor(8) as pool:
        found = list(pool.map(_run, [(folder, s) for s in GRID]))
    for f1, loss, setting in sorted(found, key=lambda r: (-r[0], r[1])):
        print(f"{f1:.4f} {loss:.4f} {setting}")


if __name__ == "__main__":
    main(sys.argv[1])

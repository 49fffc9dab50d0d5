"""Train the tagger: python -m tidewatch.llm.pii.train SF_DIR [SECONDS [N]]; with N, the N-th time that training goes on from the parameters that are there.

Labelled rows: SAMPLE texts of the folder's complaints and summaries (a documented bound; the training only), with the spans of
annotate.py, into most of which written sentences of labelled.py are put. A fifth of the written sentences is held out. All
random choices come from SEED. The parameters go to model.npz beside this file.
"""

from __future__ import annotations

import multiprocessing
import os
import random
import sys
import time
from pathlib import Path

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ.setdefault("OMP_NUM_THREADS", "1")

import numpy as np  # noqa: E402

from tidewatch.llm.pii import labelled, model  # noqa: E402
from tidewatch.llm.pii.annotate import find as annotate  # noqa: E402

SAMPLE, SEED, LENGTH, BATCH, PROCESSES = 24_000, 20, 208, 72, 8
FILE = Path(__file__).with_name("model.npz")
Row = tuple[str, list[tuple[int, int, str]]]


def rows(sf_dir: str) -> list[Row]:
    """Texts of the folder with annotated spans; those that have any, and summaries, are a larger share than in the tables."""
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf_dir}/complaints.parquet", columns=["text"])["text"].to_pylist()
    short = [t for t in pq.read_table(f"{sf_dir}/labels_llm.parquet", columns=["summary_ko"])["summary_ko"].to_pylist() if t]
    texts, short = sorted({t for t in texts if t}), sorted(set(short))
    r = random.Random(SEED)
    r.shuffle(texts)
    r.shuffle(short)
    out = [(t, sorted(annotate(t))) for t in texts[:SAMPLE] + short[: SAMPLE // 3]]
    r.shuffle(out)
    return out


def prepared(row: Row, r: random.Random, held_out: bool | None = False) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of a stretch of at most LENGTH characters of a text."""
    text, spans = labelled.mixed(r, *row, held_out=held_out) if len(row[0]) < 2000 else row
    at = 0 if len(text) <= LENGTH else r.randrange(len(text) - LENGTH + 1)
    if spans and len(text) > LENGTH and r.random() < 0.7:
        a = r.choice(spans)[0]
        at = min(max(0, a - r.randrange(LENGTH)), len(text) - LENGTH)
    tags = model.tags_of(spans, len(text))[at : at + LENGTH]
    return model.classes(text[at : at + LENGTH]), tags


def batch_of(data: list[Row], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = random.Random(seed)
    parts = [p for p in (prepared(r.choice(data), r) for _ in range(BATCH)) if len(p[0])]
    lengths = np.array([len(c) for c, _ in parts])
    ids, tags = np.zeros((lengths.max(), len(parts)), np.int32), np.zeros((lengths.max(), len(parts)), np.int64)
    for j, (c, t) in enumerate(parts):
        ids[: len(c), j], tags[: len(t), j] = c, t
    return ids, lengths, tags


_DATA: list[Row] = []


def _work(args: tuple[dict[str, np.ndarray], int]) -> tuple[float, dict[str, np.ndarray]]:
    return model.loss(args[0], *batch_of(_DATA, args[1]))


def train(data: list[Row], seconds: float, rate: float = 4e-3, begin: dict[str, np.ndarray] | None = None, again: int = 0) -> dict[str, np.ndarray]:
    """Adam on the mean gradient of PROCESSES batches a step, for a time; the rate falls to zero along a cosine."""
    _DATA[:] = data
    p = begin or model.fresh(np.random.default_rng(SEED))
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    began, step = time.time(), 0
    with multiprocessing.get_context("fork").Pool(PROCESSES) as pool:
        while (done := (time.time() - began) / seconds) < 1:
            got = pool.map(_work, [(p, (SEED + again) * 10**9 + step * PROCESSES + i) for i in range(PROCESSES)], chunksize=1)
            step += 1
            g = {k: np.mean([x[1][k] for x in got], axis=0) for k in p}
            norm = float(np.sqrt(sum((x**2).sum() for x in g.values())))
            now = rate * 0.5 * (1 + np.cos(np.pi * done)) * min(1, step / 50)
            for k in p:
                d = g[k] * min(1, 1 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            if step % 100 == 0:
                print(f"step {step}, {time.time() - began:.0f} s, loss {np.mean([x[0] for x in got]):.5f}", flush=True)
    return p


def held_out(p: dict[str, np.ndarray], data: list[Row]) -> dict[str, tuple[int, int, int]]:
    """Found, right and true (text, kind) cases by language and kind, on written sentences that training never saw."""
    from collections import Counter

    r, found, right, true = random.Random(SEED + 1), Counter(), Counter(), Counter()
    tests = [labelled.mixed(r, *r.choice(data), held_out=True) for _ in range(3000)]
    for (text, spans), got in zip(tests, model.find(p, [t for t, _ in tests])):
        lang, a, b = labelled.language(text), {k for *_, k in got}, {k for *_, k in spans}
        for where in (lang, "all"):
            found.update((where, k) for k in a)
            right.update((where, k) for k in a & b)
            true.update((where, k) for k in b)
    return {f"{w} {k}": (found[w, k], right[w, k], true[w, k]) for w, k in sorted(true)}


if __name__ == "__main__":
    all_rows = rows(sys.argv[1])
    fit, test = all_rows[: len(all_rows) * 9 // 10], all_rows[len(all_rows) * 9 // 10 :]
    marked = [x for x in fit if x[1]]
    p = train(fit + marked * 2, float(sys.argv[2]) if len(sys.argv) > 2 else 900, begin=dict(np.load(FILE)) if sys.argv[3:] else None, again=int((*sys.argv[3:], 0)[0]))
    np.savez_compressed(FILE, **{k: x.astype(np.float32) for k, x in p.items()})
    for k, (found, right, true) in held_out(p, test).items():
        print(f"{k}: precision {right / max(found, 1):.3f}, recall {right / max(true, 1):.3f} of {true}")

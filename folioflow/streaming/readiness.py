"""Groups of candidate pages, released from a stream of detections as soon as nothing can lengthen them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RELEASED = "doc long, lead int, pages int"
STATE = "pages array<int>, merges array<boolean>, candidates array<boolean>, selected array<int>, released array<int>"


def settled(known: dict[int, tuple[bool, bool]], selected: set[int]) -> list[list[int]]:
    """Runs of candidate pages whose ends are known; ``known`` has page -> (may merge, is candidate)."""
    runs: list[list[int]] = []
    for page in sorted(p for p, (_, candidate) in known.items() if candidate):
        if runs and runs[-1][-1] == page - 1 and known[page][0]:
            runs[-1].append(page)
        else:
            runs.append([page])
    unknown = selected - known.keys()
    return [r for r in runs if r[-1] + 1 not in unknown and not (known[r[0]][0] and r[0] - 1 in unknown)]


def release_groups(detections: DataFrame) -> DataFrame:
    """doc, lead, pages: each group once, in the batch whose detections complete it; append mode.

    ``detections``: doc, page, may_merge, candidate, selected (the document's pages to be detected).  The
    state holds a document's pages; a page detected again counts with its last values."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pages, merges, candidates, selected, released = state.get if state.exists else ([], [], [], [], [])
        known = {int(p): (bool(m), bool(c)) for p, m, c in zip(pages, merges, candidates)}
        selected, released = {int(p) for p in selected}, {int(p) for p in released}
        for batch in batches:
            for row in batch.itertuples():
                known[int(row.page)] = (bool(row.may_merge), bool(row.candidate))
                selected |= {int(p) for p in row.selected}
        new = [r for r in settled(known, selected) if released.isdisjoint(r)]
        released |= {p for r in new for p in r}
        order = sorted(known)
        state.update((order, [known[p][0] for p in order], [known[p][1] for p in order], sorted(selected), sorted(released)))
        yield pd.DataFrame({"doc": [int(key[0])] * len(new), "lead": [r[0] for r in new], "pages": [len(r) for r in new]})

    rows = detections.select("doc", "page", "may_merge", "candidate", "selected")
    return rows.groupBy("doc").applyInPandasWithState(step, RELEASED, STATE, "append", GroupStateTimeout.NoTimeout)

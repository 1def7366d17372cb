"""Attribution over a stream: chunks wait until their document is complete, then are folded like a batch.

A line may depend on the narration after it, and a document's first chunk may come
last; so state is the chunks not yet told, and a row that closes the document (with
``n_chunks``) releases them. Results equal those of the batch operator. A document that is not completed
keeps its state for ever, unless ``patience_ms`` says how long to wait after its last chunk: then what is there is
told as it stands.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkstream.operators.attribution import attribute_document
from inkstream.operators.cast_spec import Member

OUTPUT = "doc_id long, seq long, chunk_type string, text string, character string, gender string"


def attribute_stream(chunks: DataFrame, cast: list[Member] | None = None, patience_ms: int | None = None) -> DataFrame:
    """``doc_id, seq, chunk_type, text, n_chunks`` in any order to attributed rows, once a document has all its chunks (or has waited for ``patience_ms`` of processing time)."""
    members = cast or []

    def told(doc_id: Any, held: dict[int, tuple[str, str]]) -> pd.DataFrame:
        order = sorted(held)
        kinds, texts = [held[s][0] for s in order], [held[s][1] for s in order]
        found = attribute_document(kinds, texts, members)
        return pd.DataFrame({"doc_id": doc_id, "seq": order, "chunk_type": kinds, "text": texts, "character": [f[0] for f in found], "gender": [f[1] for f in found]})

    def fold(key: tuple[Any], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[str, str]] = pickle.loads(state.get[0]) if state.exists else {}
        total = state.get[1] if state.exists else 0
        late = state.hasTimedOut
        for pdf in parts if not late else ():
            held |= {int(s): (k, t) for s, k, t in zip(pdf.seq, pdf.chunk_type, pdf.text, strict=True)}
            total = max(total, int(pdf.n_chunks.max()))
        if len(held) < total and not late:
            state.update((pickle.dumps(held), total))
            if patience_ms is not None:
                state.setTimeoutDuration(patience_ms)
            return
        state.remove()
        yield told(key[0], held)

    waits = GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return chunks.groupBy("doc_id").applyInPandasWithState(fold, OUTPUT, "held binary, total long", "append", waits)

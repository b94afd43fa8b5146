"""Token counts with a whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import texts
from panelweave.llm.pretokens import Apart, Memo, Splitter


def whole_tokens(path: str) -> list[str]:
    """Pre-tokens proven to encode alone as one token: every vocabulary string is encoded and checked.

    At most one entry a vocabulary string, so the size of what is sent to the tasks is known.
    """
    split = Splitter(path)
    if split.find is None:
        return []
    model, suffix = split.model, split.model.end_of_word_suffix or ""
    raw = {mapped: chr(c) for c, mapped in split.bytes.items() if c < 128}
    strings = ("".join(raw.get(c, "\0") for c in v.removesuffix(suffix)) for v in split.tokenizer.get_vocab(with_added_tokens=False))
    return sorted(s for s in strings if "\0" not in s and split.find(s) == [s] and len(split.whole(s)) == 1 and len(model.tokenize(s.translate(split.bytes))) == 1)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: (id, n_bytes, n_tokens, over_limit), one row per input row.

    Pre-tokens in the proven list count one directly; only the others go through the merges, and a
    task remembers the counts of a bounded number of words. No shuffle: a task streams Arrow batches.

    A null text counts as empty (0 bytes, 0 tokens, not over the limit). Null and repeated ids are
    kept row by row. Other columns of the input, whatever their names, play no part. An empty table
    gives an empty result. ``tokenizer_path`` must exist on the executors.
    """
    known = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, single = Splitter(tokenizer_path), frozenset(known.value)
        merges = Memo(lambda piece: len(split.merged(piece)), 300_000)
        count_of = Memo(lambda chunk: sum(1 if p in single else merges[p] for p in split.pieces(chunk))).__getitem__

        def tokens(text: str) -> int:
            if (chunks := split.chunks(text)) is None:
                return len(split.whole(text))
            try:
                return (sum(1 if p in single else merges[p] for p in split.find(chunks[0])) if split.space else count_of(chunks[0])) + sum(map(count_of, chunks[1:]))
            except Apart:
                return len(split.whole(text))

        for batch in batches:
            counts = pa.array([tokens(t) for t in texts(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
